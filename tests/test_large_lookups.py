"""Look-ups and salted joins where tables are beyond a broadcast."""

import random

from pyspark.sql import functions as F

from breakwater.operators import copynumber, skew, stabbing
from breakwater.plans import views
from breakwater.session import cut_lineage
from test_entry import SF

SEGMENTS = "sample string, chr string, ordinal long, startpos long, endpos long, states string"


def tiles(spark, n):
    rows = [("S0", "1", i, i * 100, i * 100 + 80, f"g{i}") for i in range(n)]
    return spark.createDataFrame(rows, SEGMENTS)


def test_rows_without_a_segment_are_spread(spark):
    """Rows on a chromosome without segments share no key of a join."""
    segments = tiles(spark, 50)
    index = stabbing.index_segments(segments, broadcast_rows=0)
    svs = spark.range(3000).select(F.lit("S0").alias("sample"), F.col("id").alias("sv_id"))
    asked = svs.withColumns({"chr": F.lit("Y"), "nth": F.when(F.col("sv_id") < 0, F.col("sv_id"))})
    values = index.segments.select("sample", "chr", "ordinal", F.col("states").alias("value"))
    out = stabbing.attach(asked, index, values, F.col("chr"), F.col("nth"), "state", task_rows=100)
    assert out.count() == 3000 and out.filter("state IS NOT NULL").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_d_spread" in plan
    places = asked.select(skew.spread(asked).alias("s"))
    assert places.distinct().count() > 2500


def test_values_go_along_with_stretches(spark):
    """Beyond a broadcast SNVs are shuffled for their place and not again for the states."""
    segments = tiles(spark, 50)
    rng = random.Random(1)
    snvs = spark.createDataFrame([("S0", rng.choice("1Y"), rng.randrange(-50, 6000)) for _ in range(400)], "sample string, chrom string, pos long")
    out = copynumber.match_snvs(snvs, segments, broadcast_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2, plan  # the ends of chromosomes, and the stretches
    for row in out.collect():
        i = row.pos // 100
        held = row.chrom == "1" and 0 <= i < 50 and row.pos % 100 <= 80
        assert row.states == (f"g{i}" if held else None)


def test_no_salts_without_crowded_keys(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("key"), F.col("id").alias("a"))
    right = spark.range(7).select(F.col("id").alias("key"), F.col("id").alias("b"))
    same, other, keys = skew.salt_both(left, right, ["key"], 1000)
    assert keys == ["key"] and same.columns == ["key", "a"] and other.columns == ["key", "b"]
    some, _, keys = skew.salt_both(left, right, ["key"], 10, split_right=False)
    assert keys == ["key", *skew.SALTS] and some.count() == 100


def test_tables_that_were_not_counted_small_are_not_broadcast(spark):
    """Stored tables of a few bytes of files: their rows are many, however small the files are."""
    left = cut_lineage(spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id").alias("a")))
    right = cut_lineage(spark.range(7).select(F.col("id").alias("key"), F.col("id").alias("b")))
    joined = skew.lookup_join(left, right, ["key"], "left", 0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 1000
    out = copynumber.match_snvs(spark.createDataFrame([("S0", "1", 150)], "sample string, chrom string, pos long"), tiles(spark, 50), broadcast_rows=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1, plan  # the ends of chromosomes
    counted = views.view(spark, SF, "sv_cnt")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in counted
