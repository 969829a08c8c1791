"""Depths of windows: counts packed by bin, and the look-up of edges over batches."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from breakwater.operators import counting, depth
from breakwater.plans import views
from test_entry import SF

SPANS = "sample string, chrom string, ref_start long, ref_end long"
WINDOWS = "sample string, sv_id long, bp int, chrom string, win_from long, win_to long"


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "task_rows": 20}])
def test_depth_over_small_batches_and_chunks(spark, monkeypatch, options):
    """Cells longer than a batch, counts of many chunks, edges at events, places below zero."""
    rng = random.Random(5)
    reads = [("S" + str(rng.randrange(2)), rng.choice("12"), a, a + rng.randrange(0, 40)) for a in (rng.randrange(-50, 300) for _ in range(700))]
    windows = [("S" + str(rng.randrange(2)), i // 2, i % 2 + 1, rng.choice("123"), a, a + rng.randrange(-3, 200)) for i, a in enumerate(rng.randrange(-60, 320) for _ in range(160))]
    want = {}
    for s, i, e, c, a, b in windows:
        n = sum(r[:2] == (s, c) and r[2] < r[3] and r[2] < b and r[3] > a for r in reads)
        if a < b and n:
            want[s, i, e] = n
    monkeypatch.setattr(depth.tallied, "__defaults__", (90,))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for width in (64, 100_000):
            out = counting.window_depth(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(reads, SPANS), bin_width=width, **options)
            assert {(r.sample, r.sv_id, r.bp): r.depth for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_status_shuffles_no_row_for_an_event(spark):
    """20,000 reads in five bins: the counts have a row for each bin, kind and task."""
    reads = spark.range(20_000).select(F.lit("S").alias("sample"), F.lit("1").alias("chrom"), F.col("id").alias("ref_start"), (F.col("id") + 100).alias("ref_end"))
    held = reads.repartition(3).withColumns({"near_start": F.lit(True), "near_end": F.col("ref_end") < 8192})
    rows = depth.tallied(held, 4096).collect()
    assert len(rows) <= 3 * 2 * 5 and sum(r.n for r in rows) == 40_000
    assert {r.bin for r in rows if r.kind == depth.ENDS and len(r.offsets)} == {0, 1}


def test_reads_in_one_pass_are_those_of_the_union(spark):
    views_text = views.ONE_PASS.pop("reads")
    try:
        union = views.view(spark, SF, "reads")
        plan = union._jdf.queryExecution().optimizedPlan().toString()
    finally:
        views.ONE_PASS["reads"] = views_text
    once = views.view(spark, SF, "reads")
    assert union.dtypes == once.dtypes and union.columns == once.columns
    assert union.exceptAll(once).count() == once.exceptAll(union).count() == 0
    assert plan.count("Union") == 1 and "Union" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_capped_status_stores_counts_only(spark, monkeypatch):
    """The query looks at its reads once and does not store them."""
    kept = []
    cut = counting.cut_lineage
    monkeypatch.setattr(counting, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    monkeypatch.setattr(views, "stored", lambda *a, **k: pytest.fail("reads are stored"))
    assert entry.queries()["sv_status_capped"](spark, SF).count() > 0
    assert kept == [["sample", "chrom", "kind", "bin", "n", "offsets", "numbers"]]
