"""Check queries: analytics over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import sketches as sk
from ..operators.intervals import interval_join
from ..operators.ordered import asof_join, running
from ..operators.profile import merge_states, profile_of, profile_state
from ..operators.selection import exact_quantiles, stratified_sample
from ..session import materialize

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
PROBABILITIES = [0.01, 0.25, 0.5, 0.99]
SAMPLE_ROWS = 500
SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
# Orders last some days, those of every hundredth customer long.
SHORT_DAYS, LONG_DAYS = 7, 400
PROFILED = ["sequenced_id", "job_id", "cell_line", "timepoint", "is_control", "percent_mitochondrial", "total_sequenced_reads"]
# Cells that one task counts exactly, about.
CELLS_PER_TASK = 500_000


def running_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over one partition that holds all rows."""
    lines = fx.table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity", "l_returnflag")
    lines = lines.withColumn("returned", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
    found = running(
        lines,
        [],
        LINE_ORDER,
        {
            "place": ("count", None),
            "quantity": ("sum", "l_quantity"),
            "top_price": ("max", "l_extendedprice"),
            "n_returned": ("count", "returned"),
            "last_returned": ("last", "returned"),
        },
    )
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "place", "quantity", "top_price", "n_returned", "last_returned"
    )


def asof_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors before, after and nearest to each event, within an hour; a third of the users share one key."""
    events = fx.table(spark, sf_dir, "events")
    key = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k")
    ours = events.select("event_id", key, "ts")
    errors = events.filter(F.col("event_type") == "error").select(key, "ts", F.col("event_id").alias("error_id"))
    found = []
    for direction in ("backward", "forward", "nearest"):
        near = asof_join(ours, errors, "ts", ["k"], direction, F.expr("INTERVAL '1' HOUR"))
        found.append(near.select("event_id", F.lit(direction).alias("direction"), "error_id"))
    return reduce(DataFrame.unionByName, found)


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, the orders of its customer that are open at the same time."""
    first = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    days = F.when(F.col("o_custkey") % 100 == 0, LONG_DAYS).otherwise(SHORT_DAYS + F.col("o_orderkey") % 90)
    orders = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", first.alias("first"))
    orders = orders.withColumn("last", F.col("first") + days)
    others = orders.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("first").alias("f"), F.col("last").alias("l"))
    pairs = interval_join(orders, others, ("first", "last"), ("f", "l"), ["o_custkey"])
    return pairs.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_open"), F.sum("other").alias("sum_open"))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of unrounded prices; a return flag holds a third of all rows."""
    return exact_quantiles(fx.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", PROBABILITIES)


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", *SAMPLE_KEY)
    return stratified_sample(lines, ["l_returnflag"], SAMPLE_ROWS, SAMPLE_KEY)


def profile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the samples, from one state for each release."""
    samples = fx.metadata_a(spark, sf_dir).select(*PROFILED)
    jobs = [r["job_id"] for r in fx.catalog_a(spark, sf_dir).select("job_id").orderBy("job_id").collect()]
    states = reduce(DataFrame.unionByName, [profile_state(samples.filter(F.col("job_id") == job)) for job in jobs])
    found = profile_of(merge_states(materialize(states, "profile")))
    return found.select(
        "column_name",
        "n_rows",
        "n_null",
        F.when(~F.col("column_type").isin("double", "bigint"), F.col("min_value")).alias("min_text"),
        F.when(F.col("column_type").isin("double", "bigint"), F.col("max_value").cast("double")).alias("max_number"),
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
    )


def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all releases merged by gene, held against exact counts and ranks."""
    cells = fx.observed_b(spark, sf_dir)
    stored = materialize(sk.gene_sketches(cells), "sketches")
    merged = sk.merge_sketches(stored, ["gene_id"]).select(
        "gene_id", "n_cells", sk.n_samples().alias("about"), sk.quantile(0.5).alias("middle")
    )
    # A task counts the cells of some genes exactly, so tasks follow the number of cells.
    n_cells = stored.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_cells // CELLS_PER_TASK)
    exact = cells.repartition(tasks, "gene_id").join(merged.repartition(tasks, "gene_id"), "gene_id").groupBy("gene_id", "n_cells", "about").agg(
        F.count_distinct("sequenced_id").alias("n"),
        F.count_if(F.col("value") < F.col("middle")).alias("below"),
        F.count_if(F.col("value") <= F.col("middle")).alias("upto"),
    )
    slack = F.col("n_cells") * sk.RANK_ERROR + 1
    middle = F.col("n_cells") / 2
    return exact.select(
        "gene_id",
        "n_cells",
        (F.abs(F.col("about") - F.col("n")) <= F.col("n") * 4 * sk.SAMPLES_ERROR + 1).alias("samples_close"),
        ((F.col("below") <= middle + slack) & (F.col("upto") >= middle - slack)).alias("median_close"),
    )


QUERIES = {
    "running_window": running_window,
    "asof_directions": asof_directions,
    "interval_overlaps": interval_overlaps,
    "exact_quantiles": quantiles,
    "stratified_sample": sample,
    "profile_metadata": profile_metadata,
    "stored_sketches": stored_sketches,
}

_LINES = ", ".join(LINE_ORDER)
_KEY = " || '|' || ".join(["'0'", *[f"CAST({c} AS VARCHAR)" for c in SAMPLE_KEY]])
_PROFILE_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    + (
        f"CAST(NULL AS VARCHAR) AS min_text, CAST(max({c}) AS DOUBLE) AS max_number, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std FROM metadata_a"
        if c in ("percent_mitochondrial", "total_sequenced_reads")
        else f"min(CAST({c} AS VARCHAR)) AS min_text, CAST(NULL AS DOUBLE) AS max_number, CAST(NULL AS DOUBLE) AS mean, "
        "CAST(NULL AS DOUBLE) AS std FROM metadata_a"
    )
    for c in PROFILED
)

ORACLE = {
    "running_window": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER run AS place, sum(l_quantity) OVER run AS quantity,
               max(l_extendedprice) OVER run AS top_price,
               count(CASE WHEN l_returnflag = 'R' THEN 1 END) OVER run AS n_returned,
               last_value(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END IGNORE NULLS) OVER run AS last_returned
        FROM lineitem WINDOW run AS (ORDER BY {_LINES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "asof_directions": """
        WITH l AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k, ts FROM events),
        r AS (SELECT k, ts, max(event_id) AS error_id
              FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k, ts FROM events
                    WHERE event_type = 'error') GROUP BY 1, 2),
        b AS (SELECT l.event_id, l.ts, r.ts AS found, r.error_id FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts),
        f AS (SELECT l.event_id, l.ts, r.ts AS found, r.error_id FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts <= r.ts),
        n AS (SELECT b.event_id, b.ts,
                     CASE WHEN b.found IS NULL THEN f.found WHEN f.found IS NULL OR b.ts - b.found <= f.found - b.ts THEN b.found
                          ELSE f.found END AS found,
                     CASE WHEN b.found IS NULL THEN f.error_id
                          WHEN f.found IS NULL OR b.ts - b.found <= f.found - b.ts THEN b.error_id ELSE f.error_id END AS error_id
              FROM b JOIN f ON f.event_id = b.event_id)
        SELECT event_id, 'backward' AS direction, CASE WHEN ts - found <= INTERVAL 1 HOUR THEN error_id END AS error_id FROM b
        UNION ALL
        SELECT event_id, 'forward', CASE WHEN found - ts <= INTERVAL 1 HOUR THEN error_id END FROM f
        UNION ALL
        SELECT event_id, 'nearest',
               CASE WHEN greatest(ts, found) - least(ts, found) <= INTERVAL 1 HOUR THEN error_id END FROM n""",
    "interval_overlaps": f"""
        WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS first,
                          CASE WHEN o_custkey % 100 = 0 THEN {LONG_DAYS} ELSE {SHORT_DAYS} + o_orderkey % 90 END AS days
                   FROM orders)
        SELECT a.o_orderkey, count(*) AS n_open, CAST(sum(b.o_orderkey) AS BIGINT) AS sum_open
        FROM o a JOIN o b ON b.o_custkey = a.o_custkey AND a.first <= b.first + b.days AND b.first <= a.first + a.days
        GROUP BY 1""",
    "exact_quantiles": f"""
        WITH placed AS (SELECT l_returnflag, l_extendedprice AS v,
                               row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS at,
                               count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
        wanted AS (SELECT l_returnflag, p AS probability, p * (max(n) - 1) AS place
                   FROM placed, (SELECT unnest([{", ".join(f"CAST({p} AS DOUBLE)" for p in PROBABILITIES)}]) AS p)
                   GROUP BY 1, 2)
        SELECT w.l_returnflag, probability, a.v + (b.v - a.v) * (place - floor(place)) AS quantile
        FROM wanted w JOIN placed a ON a.l_returnflag = w.l_returnflag AND a.at = floor(place)
        JOIN placed b ON b.l_returnflag = w.l_returnflag AND b.at = ceil(place)""",
    "stratified_sample": f"""
        SELECT l_returnflag, {", ".join(SAMPLE_KEY)}
        FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
                                           ORDER BY substr(md5({_KEY}), 1, 13), {", ".join(SAMPLE_KEY)}) AS n FROM lineitem)
        WHERE n <= {SAMPLE_ROWS}""",
    "profile_metadata": fx.with_views("metadata_a", _PROFILE_ROWS),
    "stored_sketches": fx.with_views(
        "metadata_b observed_b",
        """SELECT gene_id, count(value) AS n_cells, true AS samples_close, true AS median_close
           FROM observed_b GROUP BY 1""",
    ),
}
