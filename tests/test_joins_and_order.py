"""Interval and fuzzy joins on both of their paths, and ordered scans, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from breakwater.operators import counting
from breakwater.operators.ordered import OrderedRows, exact_quantiles, first_rows
from breakwater.operators.ranges import first_overlap, grid_join, overlap_join
from breakwater.operators.skew import lookup_join

BROADCAST = {}
SALTED = {"broadcast_rows": 0, "task_rows": 20}


def spans(n, seed, longest):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows sits in one place.
        start = 500 if i % 3 == 0 else rng.randrange(0, 5000)
        rows.append(("S0" if i % 4 else "S1", i, start, start + rng.randrange(1, longest)))
    return rows


@pytest.mark.parametrize("options", [BROADCAST, SALTED])
@pytest.mark.parametrize("width", [64, 333])
def test_overlap_join_equals_loop(spark, options, width):
    left, right = spans(120, 1, 150), spans(60, 2, 700)
    expected = sorted(
        (l[1], r[1]) for l in left for r in right if l[0] == r[0] and l[2] < r[3] and r[2] < l[3]
    )
    ldf = spark.createDataFrame(left, "sample string, a long, f long, t long")
    rdf = spark.createDataFrame(right, "sample string, b long, g long, u long")
    pairs, _ = overlap_join(
        ldf, rdf, ["sample"], (F.col("f"), F.col("t")), (F.col("g"), F.col("u")), width, **options
    )
    assert sorted((x.a, x.b) for x in pairs.collect()) == expected


@pytest.mark.parametrize("options", [BROADCAST, SALTED])
def test_first_overlap_and_anti_join(spark, options):
    points, intervals = spans(150, 3, 2), spans(40, 4, 400)
    pdf = spark.createDataFrame(points, "sample string, a long, f long, t long")
    idf = spark.createDataFrame(intervals, "sample string, b long, g long, u long")
    got = first_overlap(
        pdf, idf, ["sample"], F.col("f"), (F.col("g"), F.col("u") + 1), F.col("b"), F.col("b"), "hit", 128, **options
    )
    expected = {}
    for s, a, f, _ in points:
        hits = [b for (r, b, g, u) in intervals if r == s and g <= f <= u]
        expected[a] = min(hits) if hits else None
    assert {x.a: x.hit for x in got.collect()} == expected
    free, _ = overlap_join(
        pdf, idf, ["sample"], (F.col("f"), F.col("f") + 1), (F.col("g"), F.col("u") + 1), 128, how="left_anti", **options
    )
    assert sorted(x.a for x in free.collect()) == sorted(a for a, h in expected.items() if h is None)


@pytest.mark.parametrize("options", [BROADCAST, SALTED])
@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_grid_join_equals_loop(spark, options, how):
    rng = random.Random(5)

    def rows(n):
        return [(i, 100 if i % 3 == 0 else rng.randrange(300), rng.randrange(150)) for i in range(n)]

    left, right = rows(100), rows(100)
    ldf = spark.createDataFrame(left, "a long, p long, q long").withColumn("k", F.lit("x"))
    rdf = spark.createDataFrame(right, "b long, r long, s long").withColumn("k", F.lit("x"))
    out, _ = grid_join(
        ldf, rdf, ["k"], (F.col("p"), F.col("q")), (F.col("r"), F.col("s")), 10, how=how, **options
    )
    pairs = [(l[0], r[0]) for l in left for r in right if abs(l[1] - r[1]) < 10 and abs(l[2] - r[2]) < 10]
    if how == "inner":
        assert sorted((x.a, x.b) for x in out.collect()) == sorted(pairs)
    else:
        assert sorted(x.a for x in out.collect()) == sorted({l[0] for l in left} - {a for a, _ in pairs})


def test_lookup_join_salted_keeps_every_row_once(spark):
    big = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key")
    )
    small = big.select("key").distinct().filter("key <> 'k1'").withColumn("value", F.length("key"))
    out = lookup_join(big, small, ["key"], limit=0, task_rows=10)
    assert out.count() == 300
    assert out.filter("value IS NULL").select("key").distinct().collect()[0].key == "k1"
    assert out.filter("key = 'hot' AND value = 3").count() == 100


@pytest.mark.parametrize("ranges", [1, 5])
def test_ordered_rows_equal_plain_windows(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(6)
        rows = [("g" if i % 3 else "h", rng.randrange(40), i, rng.randrange(9)) for i in range(200)]
        df = spark.createDataFrame(rows, "k string, o long, i long, v long")
        big = F.when(F.col("v") > 5, F.struct("o", "i"))
        got = OrderedRows(df, ["k"], ["o", "i"]).scan(
            previous={"p": F.col("v")},
            following={"f": F.col("v")},
            sums={"s": F.col("v")},
            maxima={"m": big},
            maxima_before={"mb": big},
            minima_ahead={"n": big},
            minima_after={"na": big},
        )
        w = Window.partitionBy("k").orderBy("o", "i")
        up, down = Window.unboundedPreceding, Window.unboundedFollowing
        want = df.withColumns(
            {
                "p": F.lag("v").over(w),
                "f": F.lead("v").over(w),
                "s": F.sum("v").over(w.rowsBetween(up, 0)),
                "m": F.max(big).over(w.rowsBetween(up, 0)),
                "mb": F.max(big).over(w.rowsBetween(up, -1)),
                "n": F.min(big).over(w.rowsBetween(0, down)),
                "na": F.min(big).over(w.rowsBetween(1, down)),
            }
        )
        columns = want.columns
        assert sorted(map(str, got.rows().select(*columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_first_rows_in_rounds(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 501).alias("v"))
    out = first_rows(df, ["k"], [F.col("v")], 7, spread=(8, 3))
    for k in (0, 1):
        want = sorted(i * 37 % 501 for i in range(500) if i % 2 == k)[:7]
        assert sorted(x.v for x in out.filter(F.col("k") == k).collect()) == want


@pytest.mark.parametrize("narrowing", [{}, {"cuts": 4, "task_rows": 12}])
def test_exact_quantiles_like_numpy(spark, narrowing):
    """Also with one value far from all others, which leaves even-width ranges all but empty."""
    rng = random.Random(7)
    values = [rng.choice([rng.random() * 90, float(rng.randrange(20))]) for _ in range(257)] + [50.0] * 100
    far = [*values, 1e12]
    rows = [("a", v) for v in values] + [("b", 3.0), ("d", None)] + [("c", v) for v in far]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0}
    out = {r.k: r for r in exact_quantiles(df, ["k"], F.col("v"), probs, **narrowing).collect()}
    for k, known in (("a", values), ("c", far)):
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(np.percentile(known, 100 * p), rel=1e-12)
    assert out["b"].q1 == out["b"].q3 == 3.0 and set(out) == {"a", "b", "c"}
    assert exact_quantiles(df.limit(0), ["k"], F.col("v"), probs).collect() == []


@pytest.mark.parametrize("options", [BROADCAST, SALTED])
@pytest.mark.parametrize("bin_width", [64, 4096])
def test_window_depth_equals_pairs(spark, options, bin_width):
    """The sweep counts what a join of reads and windows would, with a third of each in one place."""
    reads, windows = spans(400, 8, 150), spans(90, 9, 700)
    rdf = spark.createDataFrame(reads, "sample string, i long, ref_start long, ref_end long").withColumn("chrom", F.lit("1"))
    rdf = rdf.unionByName(spark.createDataFrame([("S0", -1, 9, 9), ("S0", -2, 30, 20), (None, -3, 1, 9000)], "sample string, i long, ref_start long, ref_end long").withColumn("chrom", F.lit("1")))
    wdf = spark.createDataFrame(windows, "sample string, sv_id long, win_from long, win_to long").withColumns({"chrom": F.lit("1"), "bp": F.lit(1)})
    wdf = wdf.unionByName(wdf.limit(20).withColumn("bp", F.lit(2))).unionByName(wdf.limit(5).withColumn("chrom", F.lit("X")).withColumn("bp", F.lit(3)))
    expected = {}
    for s, i, a, b in windows:
        n = sum(r[0] == s and r[2] < b and a < r[3] for r in reads)
        if n:
            expected[i] = n
    out = counting.window_depth(wdf, rdf, bin_width=bin_width, **options)
    got = {r.sv_id: r.depth for r in out.filter("bp = 1").collect()}
    assert got == expected
    assert out.filter("bp = 2").count() == len([r for r in wdf.filter("bp = 2").collect() if r.sv_id in expected])
    assert out.filter("bp = 3").count() == 0 and dict(out.dtypes)["depth"] == "bigint"


def test_window_depth_makes_no_pairs(spark):
    """A thousand reads over a thousand windows of one place: counts of places, not a million pairs."""
    reads = spark.createDataFrame([("S", "1", i % 10, 500) for i in range(1000)], "sample string, chrom string, ref_start long, ref_end long")
    windows = spark.createDataFrame([("S", i, 1, "1", 99, 200) for i in range(1000)], "sample string, sv_id long, bp int, chrom string, win_from long, win_to long")
    out = counting.window_depth(windows, reads)
    assert out.count() == 1000 and out.select("depth").distinct().collect()[0].depth == 1000
    # reads are in the stored counts, no further
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "ref_start" not in plan
