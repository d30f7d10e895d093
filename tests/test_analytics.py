"""Windows, as-of and interval joins, quantiles, samples, profiles and sketches against plain Python."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from exprlake.operators import profile as pf
from exprlake.operators import selection
from exprlake.operators import sketches as sk
from exprlake.operators.intervals import _nodes, interval_join
from exprlake.operators.ordered import asof_join, running
from exprlake.operators.selection import exact_quantiles, order_statistics, stratified_sample
from exprlake.queries import analytics

KINDS = {"n": ("count", None), "known": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "top": ("max", "v"), "last": ("last", "v")}


def skewed(seed=1, n=400):
    """Rows (group, place, value): one group holds most rows, some values and groups are NULL."""
    draw = random.Random(seed)
    return [
        (draw.choice(["hot"] * 6 + ["a", "b", None]), i, draw.choice([None, float(draw.randrange(50))])) for i in range(n)
    ]


class TestRunning:
    def test_against_a_loop(self, spark):
        rows = skewed()
        df = spark.createDataFrame(rows, "g string, at long, v double").repartition(5)
        for by in (["g"], []):
            got = {r["at"]: tuple(r[k] for k in KINDS) for r in running(df, by, ["at"], KINDS, range_rows=20).collect()}
            seen = collections.defaultdict(list)
            for g, at, v in rows:
                group = seen[g if by else 0]
                group.append(v)
                known = [x for x in group if x is not None]
                want = (len(group), len(known), sum(known) if known else None)
                want += (min(known), max(known), known[-1]) if known else (None,) * 3
                assert got[at] == want, (by, at)

    def test_no_task_holds_the_hot_group(self, spark):
        df = spark.range(2000).select(F.lit("hot").alias("g"), F.col("id").alias("at"), F.lit(1).alias("v"))
        out = running(df, ["g"], ["at"], {"n": ("count", None)}, range_rows=100)
        text = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        # Windows over rows are cut by range; the one over the whole group sees a row for each range.
        assert "windowspecdefinition(g#" in text and "__range" in text
        assert out.agg(F.max("n")).first()[0] == 2000

    def test_ties_and_nothing(self, spark):
        df = spark.createDataFrame([("g", 1, float(i)) for i in range(50)], "g string, at long, v double")
        places = sorted(r["n"] for r in running(df, ["g"], ["at"], {"n": ("count", None)}, range_rows=5).collect())
        assert places == list(range(1, 51))
        assert running(df.limit(0), ["g"], ["at"], KINDS).count() == 0
        with pytest.raises(ValueError, match="running values"):
            running(df, ["g"], ["at"], {"n": ("median", "v")})


class TestAsof:
    def want(self, left, right, direction, tolerance):
        out = {}
        for i, k, t in left:
            near = [(x, p) for j, x, p in right if k is not None and j == k and x is not None and t is not None]
            back = max([c for c in near if c[0] <= t], default=None) if t is not None else None
            ahead = min([c for c in near if c[0] >= t], key=lambda c: (c[0], -c[1]), default=None) if t is not None else None
            match = back if direction == "backward" else ahead
            if direction == "nearest":
                match = back if ahead is None or (back and t - back[0] <= ahead[0] - t) else ahead
            if match and tolerance is not None and abs(match[0] - t) > tolerance:
                match = None
            out[i] = match
        return out

    @pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
    @pytest.mark.parametrize("tolerance", [None, 2])
    def test_against_a_loop(self, spark, direction, tolerance):
        draw = random.Random(3)
        keys = ["hot"] * 5 + ["a", None]
        left = [(i, draw.choice(keys), draw.choice([None, *range(60)])) for i in range(200)]
        right = [(draw.choice(keys), draw.choice([None, *range(0, 60, 3)]), p) for p in range(80)]
        ours = spark.createDataFrame(left, "i long, k string, t long")
        theirs = spark.createDataFrame(right, "k string, t long, p long")
        found = asof_join(ours, theirs, "t", ["k"], direction, tolerance, range_rows=15)
        assert found.columns == ["i", "k", "t", "t_right", "p"]
        got = {r["i"]: None if r["t_right"] is None else (r["t_right"], r["p"]) for r in found.collect()}
        assert got == self.want(left, right, direction, tolerance)
        assert found.count() == 200

    def test_times_and_empty_sides(self, spark):
        at = dt.datetime(2024, 1, 1, 12)
        left = spark.createDataFrame([(1, at)], "i long, ts timestamp")
        right = spark.createDataFrame([(at - dt.timedelta(minutes=30), "x")], "ts timestamp, p string")
        near = F.expr("INTERVAL '1' HOUR")
        assert asof_join(left, right, "ts", tolerance=near).first()["p"] == "x"
        assert asof_join(left, right, "ts", tolerance=F.expr("INTERVAL '10' MINUTE")).first()["p"] is None
        assert asof_join(left, right.limit(0), "ts", direction="nearest").first()["p"] is None
        assert asof_join(left.limit(0), right, "ts").count() == 0
        with pytest.raises(ValueError, match="both sides"):
            asof_join(left, right.withColumnRenamed("p", "i"), "ts")
        with pytest.raises(ValueError, match="direction"):
            asof_join(left, right, "ts", direction="up")


class TestIntervals:
    def test_nodes_make_up_the_interval(self, spark):
        ends = [(a, b) for a in range(-9, 18, 4) for b in range(a, 40, 3)] + [(-(2**60), 2**60)]
        rows = spark.createDataFrame(ends, "lo long, hi long").select("lo", "hi", _nodes("lo", "hi").alias("nodes"))
        for r in rows.collect():
            covered = sorted((n["node"] << n["k"], (n["node"] + 1) << n["k"]) for n in r["nodes"])
            assert covered[0][0] == r["lo"] and covered[-1][1] == r["hi"] + 1
            assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
            assert len(covered) <= 2 * max(1, math.ceil(math.log2(r["hi"] - r["lo"] + 2)))

    @pytest.mark.parametrize("by", [["k"], []])
    def test_against_a_loop(self, spark, by):
        draw = random.Random(6)

        def some(n):
            rows = []
            for i in range(n):
                low = draw.randrange(-50, 200)
                length = draw.choice([-1, 0, 0, 1, 5, 30, 300])
                high = draw.choice([low + length] * 9 + [None])
                rows.append((draw.choice(["hot"] * 4 + ["a", None]), i, low, high))
            return rows

        left, right = some(120), some(90)
        ours = spark.createDataFrame(left, "k string, i long, lo long, hi long")
        theirs = spark.createDataFrame(right, "k string, j long, f long, l long")
        ours, theirs = (ours, theirs) if by else (ours.drop("k"), theirs.drop("k"))
        pairs = interval_join(ours, theirs, ("lo", "hi"), ("f", "l"), by)
        want = collections.Counter(
            (i, j)
            for k, i, a, b in left
            for m, j, c, d in right
            if (not by or (k is not None and k == m)) and b is not None and d is not None and a <= b and c <= d and a <= d and c <= b
        )
        assert collections.Counter((r["i"], r["j"]) for r in pairs.collect()) == want
        plan = pairs._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan

    def test_nodes_are_not_broadcast(self, spark):
        """A side that looks small is many times larger once it is cut into nodes."""
        one = spark.createDataFrame([(1, 1, 5)], "i long, lo long, hi long")
        other = spark.createDataFrame([(2, 5, 9)], "j long, f long, l long")
        assert "Broadcast" not in interval_join(one, other, ("lo", "hi"), ("f", "l"))._jdf.queryExecution().toString()

    def test_empty_sides(self, spark):
        one = spark.createDataFrame([(1, 1, 5)], "i long, lo long, hi long")
        other = spark.createDataFrame([(2, 5, 9)], "j long, f long, l long")
        assert interval_join(one, other, ("lo", "hi"), ("f", "l")).count() == 1
        assert interval_join(one.limit(0), other, ("lo", "hi"), ("f", "l")).count() == 0
        assert interval_join(one, other.limit(0), ("lo", "hi"), ("f", "l")).count() == 0


class TestSelection:
    def rows(self):
        draw = random.Random(8)
        rows = [("hot", float(draw.randrange(7))) for _ in range(900)]  # ties
        rows += [("wide", draw.choice([-1e300, 1e300, 0.0, draw.random(), draw.gauss(0, 1e-9)])) for _ in range(700)]
        rows += [("one", 3.5), (None, 1.0), (None, None), ("none", None)]
        return rows

    @pytest.mark.parametrize("sort_rows", [1, 40, 100_000])
    def test_quantiles(self, spark, sort_rows, monkeypatch):
        monkeypatch.setattr(selection, "EDGES", 5)
        df = spark.createDataFrame(self.rows(), "g string, v double")
        p = [0.0, 0.1, 0.5, 0.999, 1.0]
        got = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", p, sort_rows).collect()}
        groups = collections.defaultdict(list)
        for g, v in self.rows():
            if v is not None:
                groups[g].append(v)
        want = {}
        for g, values in groups.items():
            values.sort()
            for q in p:
                at = q * (len(values) - 1)
                a, b = values[math.floor(at)], values[math.ceil(at)]
                want[g, q] = a + (b - a) * (at - math.floor(at))
        assert got == want

    def test_rows_are_counted_without_a_sort(self, spark, monkeypatch):
        """An aggregate that carries the edges would sort all rows, each with the whole list."""
        plans, kept = [], selection.materialize

        def seen(df, label):
            plans.append(df._jdf.queryExecution().toString())
            return kept(df, label)

        monkeypatch.setattr(selection, "materialize", seen)
        rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
        targets = spark.createDataFrame([("g", r) for r in (0, 77, 4999)], "g string, rank long")
        got = {r["rank"]: (r["value"], r["below"]) for r in order_statistics(rows, targets, 30).collect()}
        assert got == {r: (r, r) for r in (0, 77, 4999)}
        assert plans and not any("SortAggregate" in p for p in plans)

    def test_ranks(self, spark):
        rows = spark.createDataFrame([("g", v) for v in [5, 1, 5, 5, 9]], "g string, v long")
        targets = spark.createDataFrame([("g", r) for r in range(7)], "g string, rank long")
        for sort_rows in (1, 100):
            got = {r["rank"]: (r["value"], r["below"]) for r in order_statistics(rows, targets, sort_rows, 3).collect()}
            assert got == {0: (1, 0), 1: (5, 1), 2: (5, 1), 3: (5, 1), 4: (9, 4)}

    @pytest.mark.parametrize("sort_rows", [10, 100_000])
    def test_sample(self, spark, sort_rows):
        rows = [("hot", i) for i in range(800)] + [("few", i) for i in range(3)] + [(None, i) for i in range(60)]
        df = spark.createDataFrame(rows, "g string, i long")
        out = stratified_sample(df, ["g"], 50, ["g", "i"], seed=1, sort_rows=sort_rows)
        taken = collections.Counter(r["g"] for r in out.collect())
        assert taken == {"hot": 50, "few": 3, None: 50} and out.distinct().count() == 103
        again = stratified_sample(df.repartition(7), ["g"], 50, ["g", "i"], seed=1)
        assert out.exceptAll(again).isEmpty()
        other = stratified_sample(df, ["g"], 50, ["g", "i"], seed=2)
        assert not out.exceptAll(other).isEmpty()
        assert stratified_sample(df, ["g"], 0, ["i"]).count() == 0
        assert stratified_sample(df.limit(0), ["g"], 5, ["i"]).count() == 0

    def test_a_sample_with_equal_keys(self, spark):
        df = spark.createDataFrame([("g", 1)] * 20 + [("g", 2)] * 20, "g string, i long")
        assert stratified_sample(df, ["g"], 7, ["i"]).count() == 7
        assert stratified_sample(df, ["g"], 27, ["i"]).count() == 27


class TestProfile:
    def test_parts_are_the_whole(self, spark):
        draw = random.Random(2)
        rows = [(draw.choice([None, *"abcdef"]), draw.choice([None, float(draw.randrange(1000))]), i, i % 2 == 0) for i in range(500)]
        df = spark.createDataFrame(rows, "t string, `x y` double, i long, f boolean")
        whole = {r["column_name"]: r for r in pf.summarize_table(df).collect()}
        parts = {r["column_name"]: r for r in pf.summarize_parts([df.filter("i < 100"), df.filter("i >= 100"), df.limit(0)]).collect()}
        numbers = [r[1] for r in rows if r[1] is not None]
        for found in (whole, parts):
            x = found["x y"]
            assert (x["n_rows"], x["n_null"]) == (500, 500 - len(numbers))
            assert (float(x["min_value"]), float(x["max_value"])) == (min(numbers), max(numbers))
            assert math.isclose(x["mean"], statistics.mean(numbers)) and math.isclose(x["std"], statistics.stdev(numbers))
            assert abs(x["n_distinct"] - len(set(numbers))) < 0.1 * len(set(numbers))
            for q in ("q25", "q50", "q75"):
                place = sum(v <= x[q] for v in numbers) / len(numbers)
                assert abs(place - pf.QUARTILES[q]) < 0.05
            t = found["t"]
            assert (t["column_type"], t["min_value"], t["max_value"], t["n_distinct"]) == ("string", "a", "f", 6)
            assert t["mean"] is None and t["q50"] is None and found["f"]["min_value"] == "false"

    def test_one_scan(self, spark):
        df = spark.range(10).selectExpr("id", "cast(id as string) s")
        plan = pf.profile_state(df)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Range (") == 1 and plan.count("Exchange") <= 1
        none = {r["column_name"]: r for r in pf.summarize_table(df.limit(0)).collect()}
        assert (none["id"]["n_rows"], none["id"]["min_value"], none["s"]["n_distinct"]) == (0, None, 0)


def test_sketches_merge(spark):
    cells = spark.range(6000).selectExpr(
        "concat('r', id % 3) job_id", "concat('g', id % 2) gene_id", "cast(id % 500 as string) sequenced_id", "cast(id as double) value"
    )
    by_gene = sk.merge_sketches(sk.gene_sketches(cells), ["gene_id"])
    for r in by_gene.select("n_cells", sk.n_samples().alias("n"), sk.quantile(0.5).alias("m")).collect():
        assert r["n_cells"] == 3000 and abs(r["n"] - 250) < 250 * 3 * sk.SAMPLES_ERROR and abs(r["m"] - 3000) < 6000 * 3 * sk.RANK_ERROR


def test_tasks_of_sketches_follow_the_number_of_cells(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(analytics, "CELLS_PER_TASK", 20, raising=False)
        plan = analytics.stored_sketches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Some 2,000 cells: both sides of the join come in as many partitions, and no others are made above.
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(gene_id#\d+, (\d+)\)", plan)]
    assert len(dealt) >= 2 and sorted(dealt)[-2] == max(dealt) >= 90
