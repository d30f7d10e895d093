"""Check queries: statements run through `query()`.

Each entry is a statement over `metadata` and `chemistry`; where the dialects differ the
DuckDB text is given too.  Statements with a LIMIT carry a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..plans.sql import query

# Statements that read the same in both dialects.
SHARED = {
    "default_query": """
        SELECT * FROM metadata ORDER BY CAST(sequenced_id AS BIGINT) LIMIT 10""",
    "sql_qc_limit": """
        SELECT * FROM metadata WHERE percent_mitochondrial < 20
        ORDER BY CAST(sequenced_id AS BIGINT) LIMIT 5""",
    "sql_qc_projection": """
        SELECT sequenced_id, user_compound_id, percent_mitochondrial FROM metadata
        WHERE percent_mitochondrial < 20""",
    "sql_control_filter": """
        SELECT * FROM metadata WHERE user_compound_id = (
            SELECT max(user_compound_id) FROM metadata WHERE is_control)""",
    "sql_join_chem": """
        SELECT m.sequenced_id, m.user_compound_id, c.smiles, c.log_p
        FROM metadata m JOIN chemistry c ON c.compound = m.compound""",
    "join_chem_by_job": """
        SELECT m.sequenced_id, m.job_id, m.user_compound_id, c.smiles, c.log_p
        FROM metadata m JOIN chemistry_by_job c ON c.compound = m.compound AND c.job_id = m.job_id""",
    "sql_join_limit": """
        SELECT m.sequenced_id, m.user_compound_id, c.log_p
        FROM metadata m JOIN chemistry c ON c.compound = m.compound
        ORDER BY c.log_p DESC, CAST(m.sequenced_id AS BIGINT) LIMIT 5""",
    "sql_multi_job": """
        SELECT user_compound_id, COUNT(DISTINCT job_id) AS n_experiments FROM metadata
        GROUP BY user_compound_id HAVING COUNT(DISTINCT job_id) > 1""",
    "sql_count": """
        SELECT COUNT(*) AS n FROM metadata""",
    "sql_project_limit": """
        SELECT sequenced_id, cell_line FROM metadata ORDER BY CAST(sequenced_id AS BIGINT) LIMIT 1""",
    "sql_chem_limit": """
        SELECT compound, user_compound_id, smiles, log_p FROM chemistry
        ORDER BY log_p, CAST(compound AS BIGINT) LIMIT 5""",
    "sql_predicates": """
        SELECT sequenced_id, cell_line,
               CASE WHEN percent_mitochondrial < 10 THEN 'low' WHEN percent_mitochondrial < 30 THEN 'mid'
                    ELSE 'high' END AS band
        FROM metadata
        WHERE percent_mitochondrial BETWEEN 5 AND 40 AND cell_line IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
          AND user_compound_id LIKE 'Customer#%' AND user_compound_id ILIKE '%7%'
          AND compound IS NOT NULL AND NOT is_control""",
    "sql_left_join": """
        SELECT m.job_id, m.sequenced_id, c.n_releases
        FROM metadata m
        LEFT JOIN (SELECT compound, COUNT(*) AS n_releases FROM chemistry WHERE log_p > 5000 GROUP BY compound) c
          ON c.compound = m.compound""",
    "sql_right_full_join": """
        SELECT COALESCE(a.compound, b.compound) AS compound, a.n AS n_control, b.n AS n_treated
        FROM (SELECT compound, COUNT(*) AS n FROM metadata WHERE is_control GROUP BY compound) a
        FULL JOIN (SELECT compound, COUNT(*) AS n FROM metadata WHERE NOT is_control GROUP BY compound) b
          ON a.compound = b.compound""",
    "sql_right_join": """
        SELECT c.compound, c.n_releases, m.n AS n_control
        FROM (SELECT compound, COUNT(*) AS n FROM metadata WHERE is_control GROUP BY compound) m
        RIGHT JOIN (SELECT compound, COUNT(*) AS n_releases FROM chemistry GROUP BY compound) c
          ON c.compound = m.compound""",
    "sql_unpivot": """
        SELECT job_id, sequenced_id, measure, amount
        FROM (SELECT job_id, sequenced_id, CAST(total_sequenced_reads AS DOUBLE) AS reads,
                     percent_mitochondrial AS mitochondrial
              FROM metadata) m
        UNPIVOT (amount FOR measure IN (reads, mitochondrial))""",
    "sql_agg_basic": """
        SELECT cell_line, COUNT(*) AS n, CAST(SUM(total_sequenced_reads) AS BIGINT) AS reads,
               MIN(percent_mitochondrial) AS lo, MAX(percent_mitochondrial) AS hi,
               ROUND(AVG(percent_mitochondrial), 6) AS mean,
               ROUND(STDDEV_SAMP(percent_mitochondrial), 6) AS spread,
               ROUND(CORR(percent_mitochondrial, CAST(compound AS BIGINT)), 6) AS r,
               COUNT(*) FILTER (WHERE is_control) AS n_control, COUNT(DISTINCT compound) AS n_compounds
        FROM metadata GROUP BY cell_line""",
    "sql_grouping_sets": """
        SELECT COALESCE(cell_line, 'all') AS cell_line, COALESCE(timepoint, 'all') AS timepoint, COUNT(*) AS n,
               CAST(GROUPING(cell_line) AS BIGINT) AS over_lines, CAST(GROUPING(timepoint) AS BIGINT) AS over_times
        FROM metadata GROUP BY GROUPING SETS ((cell_line, timepoint), (cell_line), (timepoint), ())""",
    "sql_cube_rollup": """
        SELECT 'cube' AS kind, COALESCE(job_id, 'all') AS a, COALESCE(cell_line, 'all') AS b, COUNT(*) AS n
        FROM metadata GROUP BY CUBE (job_id, cell_line)
        UNION ALL
        SELECT 'rollup', COALESCE(job_id, 'all'), COALESCE(cell_line, 'all'), COUNT(*)
        FROM metadata GROUP BY ROLLUP (job_id, cell_line)""",
    "sql_window_rank": """
        SELECT cell_line, sequenced_id, total_sequenced_reads, CAST(place AS BIGINT) AS place FROM (
            SELECT cell_line, sequenced_id, total_sequenced_reads,
                   ROW_NUMBER() OVER (PARTITION BY cell_line
                                      ORDER BY total_sequenced_reads DESC, sequenced_id) AS place
            FROM metadata) ranked
        WHERE place <= 3""",
    "sql_window_frame": """
        SELECT cell_line, sampled_month, n,
               CAST(SUM(n) OVER (PARTITION BY cell_line ORDER BY sampled_month) AS BIGINT) AS so_far,
               CAST(SUM(n) OVER (PARTITION BY cell_line ORDER BY sampled_month
                                 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around,
               LAG(n) OVER (PARTITION BY cell_line ORDER BY sampled_month) AS before,
               CAST(DENSE_RANK() OVER (PARTITION BY cell_line ORDER BY n DESC) AS BIGINT) AS busiest
        FROM (SELECT cell_line, substr(sampled_on, 1, 7) AS sampled_month, COUNT(*) AS n
              FROM metadata GROUP BY cell_line, substr(sampled_on, 1, 7)) monthly""",
    "sql_topk": """
        SELECT compound, CAST(SUM(total_sequenced_reads) AS BIGINT) AS reads FROM metadata
        GROUP BY compound ORDER BY reads DESC, compound LIMIT 20""",
    "sql_set_ops": """
        SELECT compound, 'both kinds' AS found FROM (
            SELECT compound FROM metadata WHERE is_control
            INTERSECT SELECT compound FROM metadata WHERE NOT is_control) a
        UNION ALL
        SELECT compound, 'early only' FROM (
            SELECT compound FROM metadata WHERE timepoint = '24h'
            EXCEPT SELECT compound FROM metadata WHERE timepoint = '48h') b
        UNION
        SELECT compound, 'low quality' FROM metadata WHERE percent_mitochondrial > 49""",
    "sql_cte": """
        WITH RECURSIVE per_job AS (
            SELECT CAST(substr(job_id, 5) AS INT) AS k, COUNT(*) AS n FROM metadata GROUP BY job_id),
        running (k, total) AS (
            SELECT k, n FROM per_job WHERE k = 1
            UNION ALL
            SELECT p.k, r.total + p.n FROM running r JOIN per_job p ON p.k = r.k + 1)
        SELECT k, total, (SELECT COUNT(*) FROM metadata) AS of_all FROM running""",
    "sql_strings": """
        SELECT sequenced_id, LOWER(cell_line) AS line, substr(user_compound_id, 10) AS tail,
               CAST(LENGTH(user_compound_id) AS BIGINT) AS len, CONCAT(job_id, '/', sequenced_id) AS path,
               REPLACE(timepoint, 'h', ' hours') AS hours, LPAD(compound, 8, '0') AS padded,
               SPLIT_PART(user_compound_id, '#', 1) AS kind, TRIM(CONCAT(' ', cell_line, ' ')) AS trimmed
        FROM metadata""",
    "sql_math": """
        SELECT sequenced_id, ROUND(LOG10(percent_mitochondrial + 1), 8) AS lg,
               ROUND(SQRT(percent_mitochondrial), 8) AS root, ABS(20 - percent_mitochondrial) AS off,
               GREATEST(percent_mitochondrial, 20) AS floor20, LEAST(percent_mitochondrial, 20) AS cap20,
               total_sequenced_reads % 7 AS rest, ROUND(POWER(percent_mitochondrial, 0.5), 8) AS p
        FROM metadata""",
    # As-of match: for each sample the last day, up to its own, with a control on that line.
    # The window runs over distinct (line, day) only, so a line of any size stays small.
    "asof_recipe": """
        SELECT m.sequenced_id, m.cell_line, m.sampled_on, d.control_on
        FROM metadata m JOIN (
            SELECT cell_line, sampled_on,
                   MAX(control_day) OVER (PARTITION BY cell_line ORDER BY sampled_on) AS control_on
            FROM (SELECT cell_line, sampled_on, MAX(CASE WHEN is_control THEN sampled_on END) AS control_day
                  FROM metadata GROUP BY cell_line, sampled_on) days) d
          ON d.cell_line = m.cell_line AND d.sampled_on = m.sampled_on""",
}

# (Spark text, DuckDB text)
BY_DIALECT = {
    "sql_semi_anti": (
        """
        SELECT 'semi' AS kind, COUNT(*) AS n, CAST(SUM(total_sequenced_reads) AS BIGINT) AS reads FROM (
            SELECT m.* FROM metadata m LEFT SEMI JOIN chemistry c ON c.compound = m.compound AND c.log_p < 0) s
        UNION ALL
        SELECT 'anti', COUNT(*), CAST(SUM(total_sequenced_reads) AS BIGINT) FROM (
            SELECT m.* FROM metadata m LEFT ANTI JOIN chemistry c ON c.compound = m.compound AND c.log_p < 0) a""",
        """
        SELECT 'semi' AS kind, COUNT(*) AS n, CAST(SUM(total_sequenced_reads) AS BIGINT) AS reads FROM metadata
        WHERE compound IN (SELECT compound FROM chemistry WHERE log_p < 0)
        UNION ALL
        SELECT 'anti', COUNT(*), CAST(SUM(total_sequenced_reads) AS BIGINT) FROM metadata
        WHERE compound NOT IN (SELECT compound FROM chemistry WHERE log_p < 0)""",
    ),
    # Bands carry their bin as an equality key, so the range test is a filter on a hash join.
    "sql_range_join": (
        """
        SELECT b.lo, b.hi, COUNT(*) AS n, CAST(SUM(m.total_sequenced_reads) AS BIGINT) AS reads
        FROM metadata m JOIN (
            SELECT DISTINCT CAST(FLOOR(percent_mitochondrial / 10) AS INT) AS bin,
                   FLOOR(percent_mitochondrial / 5) * 5.0D AS lo, FLOOR(percent_mitochondrial / 5) * 5.0D + 5 AS hi
            FROM metadata) b
          ON b.bin = CAST(FLOOR(m.percent_mitochondrial / 10) AS INT)
         AND m.percent_mitochondrial >= b.lo AND m.percent_mitochondrial < b.hi
        GROUP BY b.lo, b.hi""",
        """
        SELECT b.lo, b.lo + 5 AS hi, COUNT(*) AS n, CAST(SUM(m.total_sequenced_reads) AS BIGINT) AS reads
        FROM metadata m JOIN (SELECT DISTINCT floor(percent_mitochondrial / 5) * 5.0 AS lo FROM metadata) b
          ON m.percent_mitochondrial >= b.lo AND m.percent_mitochondrial < b.lo + 5
        GROUP BY b.lo""",
    ),
    # As-of match of two tables whose keys do not meet: for each sample the largest log_p of its release
    # at or below 200 times its percentage.  Both tables are put in one order; the window is cut into
    # buckets of that order, and a bucket starts from the last value of the buckets before it.
    "asof_join": (
        """
        WITH points AS (
            SELECT job_id, CAST(FLOOR(log_p / 50) AS BIGINT) AS bucket, log_p AS at, log_p AS found,
                   CAST(NULL AS STRING) AS sequenced_id, FALSE AS is_sample
            FROM chemistry_by_job WHERE log_p IS NOT NULL
            UNION ALL
            SELECT job_id, CAST(FLOOR(percent_mitochondrial * 200 / 50) AS BIGINT), percent_mitochondrial * 200,
                   CAST(NULL AS DOUBLE), sequenced_id, TRUE
            FROM metadata),
        inside AS (
            SELECT *, MAX(found) OVER (PARTITION BY job_id, bucket ORDER BY at) AS here FROM points),
        earlier AS (
            SELECT job_id, bucket, MAX(top) OVER (
                       PARTITION BY job_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM (SELECT job_id, bucket, MAX(found) AS top FROM points GROUP BY job_id, bucket) b)
        SELECT i.job_id, i.sequenced_id, i.at, COALESCE(i.here, e.before) AS log_p
        FROM inside i LEFT JOIN earlier e ON e.job_id = i.job_id AND e.bucket = i.bucket
        WHERE i.is_sample""",
        """
        SELECT m.job_id, m.sequenced_id, m.at, c.log_p
        FROM (SELECT *, percent_mitochondrial * 200 AS at FROM metadata) m
        ASOF LEFT JOIN (SELECT DISTINCT job_id, log_p FROM chemistry_by_job WHERE log_p IS NOT NULL) c
          ON c.job_id = m.job_id AND m.at >= c.log_p""",
    ),
    "sql_agg_ext": (
        """
        SELECT cell_line, percentile_cont(0.25) WITHIN GROUP (ORDER BY band) AS q25, median(band) AS mid,
               max_by(total_sequenced_reads, percent_mitochondrial) AS reads_at_top,
               approx_count_distinct(timepoint) AS n_times,
               listagg(DISTINCT timepoint, ',') WITHIN GROUP (ORDER BY timepoint) AS times,
               array_join(sort_array(collect_set(job_id)), ',') AS jobs,
               bool_or(is_control) AS any_control
        FROM (SELECT *, CAST(FLOOR(percent_mitochondrial) AS INT) AS band FROM metadata) banded
        GROUP BY cell_line""",
        """
        SELECT cell_line, quantile_cont(band, 0.25) AS q25, median(band) AS mid,
               arg_max(total_sequenced_reads, percent_mitochondrial) AS reads_at_top,
               count(DISTINCT timepoint) AS n_times,
               string_agg(DISTINCT timepoint, ',' ORDER BY timepoint) AS times,
               string_agg(DISTINCT job_id, ',' ORDER BY job_id) AS jobs,
               bool_or(is_control) AS any_control
        FROM (SELECT *, CAST(floor(percent_mitochondrial) AS INT) AS band FROM metadata) banded
        GROUP BY cell_line""",
    ),
    "sql_dates": (
        """
        SELECT sequenced_id, date_format(date_trunc('MONTH', CAST(sampled_on AS DATE)), 'yyyy-MM-dd') AS month_start,
               CAST(year(CAST(sampled_on AS DATE)) AS BIGINT) AS y,
               CAST(quarter(CAST(sampled_on AS DATE)) AS BIGINT) AS q,
               CAST(datediff(CAST(sampled_on AS DATE), DATE '1995-01-01') AS BIGINT) AS days,
               date_format(date_add(CAST(sampled_on AS DATE), 30), 'yyyy-MM-dd') AS due
        FROM metadata""",
        """
        SELECT sequenced_id, strftime(date_trunc('month', CAST(sampled_on AS DATE)), '%Y-%m-%d') AS month_start,
               CAST(year(CAST(sampled_on AS DATE)) AS BIGINT) AS y,
               CAST(quarter(CAST(sampled_on AS DATE)) AS BIGINT) AS q,
               date_diff('day', DATE '1995-01-01', CAST(sampled_on AS DATE)) AS days,
               strftime(CAST(sampled_on AS DATE) + 30, '%Y-%m-%d') AS due
        FROM metadata""",
    ),
    "sql_arrays": (
        """
        SELECT tag, COUNT(*) AS n, CAST(SUM(n_tags) AS BIGINT) AS tags FROM (
            SELECT explode(tags) AS tag, size(tags) AS n_tags FROM (
                SELECT array_distinct(filter(array(cell_line, timepoint, job_id), x -> x <> 'BUILDING')) AS tags
                FROM metadata) t
            WHERE array_contains(tags, '24h')) e
        GROUP BY tag""",
        """
        SELECT tag, COUNT(*) AS n, CAST(SUM(n_tags) AS BIGINT) AS tags FROM (
            SELECT unnest(tags) AS tag, len(tags) AS n_tags FROM (
                SELECT list_distinct(list_filter([cell_line, timepoint, job_id], lambda x: x <> 'BUILDING')) AS tags
                FROM metadata) t
            WHERE list_contains(tags, '24h')) e
        GROUP BY tag""",
    ),
    "sql_regexp": (
        """
        SELECT regexp_extract(user_compound_id, '([0-9])$', 1) AS last_digit, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE regexp_like(cell_line, '^[A-H]')) AS early_letter
        FROM metadata GROUP BY regexp_extract(user_compound_id, '([0-9])$', 1)""",
        """
        SELECT regexp_extract(user_compound_id, '([0-9])$', 1) AS last_digit, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE regexp_matches(cell_line, '^[A-H]')) AS early_letter
        FROM metadata GROUP BY 1""",
    ),
    "sql_pivot": (
        """
        SELECT * FROM (SELECT cell_line, timepoint, total_sequenced_reads FROM metadata)
        PIVOT (SUM(total_sequenced_reads) FOR timepoint IN ('24h' AS reads_24h, '48h' AS reads_48h))""",
        """
        SELECT cell_line, CAST(SUM(total_sequenced_reads) FILTER (WHERE timepoint = '24h') AS BIGINT) AS reads_24h,
               CAST(SUM(total_sequenced_reads) FILTER (WHERE timepoint = '48h') AS BIGINT) AS reads_48h
        FROM metadata GROUP BY cell_line""",
    ),
}

# JSON is read from an extra text column of the samples of mapping E.
JSON = {
    "sql_json": (
        """
        SELECT job_id, COUNT(*) AS n, CAST(SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
               MAX(from_json(props, 'k BIGINT').k) AS top,
               COUNT(DISTINCT element_at(from_json(props, 'map<string, string>'), 'k')) AS n_values
        FROM metadata GROUP BY job_id""",
        """
        SELECT job_id, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
               MAX(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top,
               COUNT(DISTINCT json_extract_string(props, '$.k')) AS n_values
        FROM metadata GROUP BY job_id""",
    ),
}


def _on_a(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, fx.release_a(sf_dir), sql=statement)


def _on_e(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, fx.release_e(sf_dir), sql=statement)


def sql_with_sequencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in matrix table: expression per release and cell line."""
    return query(spark, fx.release_a(sf_dir), sql=SEQUENCING, with_sequencing=True)


SEQUENCING = """
    SELECT m.job_id, m.cell_line, COUNT(*) AS cells, SUM(s.value) AS total, COUNT(DISTINCT s.gene_id) AS genes
    FROM sequencing s JOIN metadata m ON m.sequenced_id = s.sequenced_id AND m.job_id = s.job_id
    WHERE s.value > 0 GROUP BY m.job_id, m.cell_line"""

QUERIES = {
    **{key: _on_a(text) for key, text in SHARED.items()},
    **{key: _on_a(spark_text) for key, (spark_text, _) in BY_DIALECT.items()},
    **{key: _on_e(spark_text) for key, (spark_text, _) in JSON.items()},
    "sql_with_sequencing": sql_with_sequencing,
}

_TABLES = """, metadata AS (SELECT * FROM metadata_a), chemistry_by_job AS (SELECT * FROM chemistry_a),
              chemistry AS (SELECT * EXCLUDE (job_id) FROM chemistry_a)"""


def _duck(text: str) -> str:
    """A statement may start its own WITH list; its CTEs then follow the tables."""
    body = text.strip()
    if body.startswith("WITH RECURSIVE"):
        tables = fx.with_views("metadata_a chemistry_a", _TABLES).replace("WITH", "WITH RECURSIVE", 1)
        return f"{tables}, {body.removeprefix('WITH RECURSIVE')}"
    return fx.with_views("metadata_a chemistry_a", f"{_TABLES} {body}")


ORACLE = {
    **{key: _duck(text) for key, text in SHARED.items()},
    **{key: _duck(text) for key, (_, text) in BY_DIALECT.items()},
    **{
        key: fx.with_views("metadata_e", f", metadata AS (SELECT * FROM metadata_e) {text}")
        for key, (_, text) in JSON.items()
    },
    "sql_with_sequencing": fx.with_views(
        "metadata_a sequencing_a",
        f""", metadata AS (SELECT * FROM metadata_a), sequencing AS (SELECT * FROM sequencing_a) {SEQUENCING}""",
    ),
}
