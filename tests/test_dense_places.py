"""Many reads and windows in one place: results without a row for each of their pairs."""

import pytest
from pyspark.sql import functions as F

from breakwater.operators import annotate, counting
from test_steps import LIMITS, READ, SV


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "task_rows": 50}])
def test_only_split_reads_meet_ends(spark, options):
    """200 SVs share their ends with 400 ordinary reads; two reads are split, one written twice."""
    svs = spark.createDataFrame([("S", i, "1", 1000, "+", "1", 3000, "-") for i in range(200)] + [("S", 900, "1", 9000, "+", "1", 9900, "-")], SV)
    svs = svs.withColumn("tags", F.array().cast("array<string>"))
    rows = [("S", f"q{i}", "1", at - 50, at + 50, 0, 100, 100, 300, False) for i in range(200) for at in (1000, 3000)]
    rows += [("S", "x", "1", 943, 1003, 0, 60, 100, 300, False)] * 2 + [("S", "y", "1", 2998, 3058, 40, 100, 100, 300, True)]
    limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, 1e6)], LIMITS)
    near, status = annotate.split_reads_at_ends(svs, spark.createDataFrame(rows, READ), limits, **options)
    assert near.count() == 400 and near.filter("ref_start IS NULL").count() == 0 and status.count() == 201
    moved = {(r.sv_id, r.bp): r.new_pos for r in annotate.recalibrated_positions(near).collect()}
    assert moved == {(i, e): p for i in range(200) for e, p in ((1, 1003), (2, 2999))}
    told = annotate.infer_directions(svs, spark.createDataFrame(rows, READ), limits, **options).collect()
    assert {(r.dir1, r.dir2, *r.tags) for r in told if r.sv_id < 900} == {("+", "-")}
    assert [r.tags for r in told if r.sv_id == 900] == [["UNKNOWN_DIR", "UNKNOWN_DIR"]]


def test_an_end_with_ordinary_reads_only_stays_in_place(spark):
    svs = spark.createDataFrame([("S", 1, "1", 1000, "+", "1", 3000, "-")], SV)
    reads = spark.createDataFrame([("S", "q", "1", 950, 1050, 0, 100, 100, 300, False)], READ)
    limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, 1e6)], LIMITS)
    near, _ = annotate.split_reads_at_ends(svs, reads, limits)
    assert [tuple(r) for r in annotate.recalibrated_positions(near).collect()] == [("S", 1, 1, 1000)]
    assert [(r.bp, r.dir, r.mixed) for r in annotate.end_evidence(near).collect()] == [(1, None, False)]


def test_counts_make_no_row_for_a_read_clear_of_the_break(spark):
    """100 SVs share their windows with 300 ordinary pairs that stay clear of the breaks; two
    pairs lie across end 1, one supports the junctions, and one fragment has three reads."""
    svs = spark.createDataFrame([("S", i, "1", 1000, "+", "1", 3000, "-") for i in range(100)], SV)

    def pair(name, at, size=300):
        return [("S", name, "1", at, at + 100, 0, 100, 100, size, False), ("S", name, "1", at + 200, at + 300, 0, 100, 100, -size, True)]

    rows = [r for i in range(300) for r in pair(f"q{i}", (1100, 2600)[i % 2])] + pair("x", 850) + pair("x2", 945)
    rows += [("S", "s", "1", 880, 980, 0, 100, 100, 9000, False), ("S", "s", "1", 3020, 3120, 0, 100, 100, -9000, True)] * 2
    rows += pair("t", 1200) + [("S", "t", "1", 2900, 3000, 0, 100, 100, 9000, True)]
    limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, 1e6)], LIMITS)
    reads = spark.createDataFrame(rows, READ)
    labels, _ = counting.labelled_reads(svs, reads, limits)
    assert labels.met.count() <= 500 and labels.several.count() == 300
    ends = {(r.sv_id, r.bp): r for r in counting.breakend_counts(labels).collect()}
    assert len(ends) == 200
    for i in range(100):
        one, two = ends[i, 1], ends[i, 2]
        # of the three reads of t, which lies in windows by place, two are at end 1
        assert (one.split_norm, one.span_norm, one.win_norm, one.total_reads) == (1, 1, 2 * 153, 2 * 153 + 1)
        assert (two.split_norm, two.span_norm, two.win_norm, two.total_reads) == (0, 0, 2 * 150, 2 * 150 + 2)
    spanning = {r.sv_id: (r.spanning, r.anomalous) for r in counting.spanning_counts(labels).collect()}
    assert spanning == {i: (1, 0) for i in range(100)}
    assert counting.anomalous_recount(labels).count() == 0
    assert {r.anomalous for r in counting.anomalous_recount(labels, exclude_supporting=False).collect()} <= {1}


def test_pairs_of_reads_and_windows_are_not_shuffled(spark):
    svs = spark.createDataFrame([("S", i, "1", 1000, "+", "1", 3000, "-") for i in range(50)], SV).withColumn("max_ins", F.lit(450.0))
    reads = spark.createDataFrame([("S", f"q{i % 60}", "1", 900, 1000, 0, 100, 100, 300, False) for i in range(120)], READ)
    found = counting.reads_in_windows(counting.breakend_windows(svs, F.col("max_ins")), reads)
    assert found.count() == 50 * 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    # from the top: no shuffle of the pairs
    assert plan.index("Join") < plan.index("Exchange")


def test_reads_of_windows_are_shuffled_once(spark):
    """Beyond a broadcast the shuffle to the windows also makes reads distinct, crowded or not."""
    svs = spark.createDataFrame([("S", i, "1", 1000 + 7 * i, "+", "1", 3000, "-") for i in range(50)], SV).withColumn("max_ins", F.lit(450.0))
    rows = [("S", f"q{i % 60}", "1", 900 + i % 60 * 40, 1000 + i % 60 * 40, 0, 100, 100, 300, False) for i in range(120)]
    reads, windows = spark.createDataFrame(rows, READ), counting.breakend_windows(svs, F.col("max_ins"))
    few = sorted(map(str, counting.reads_in_windows(windows, reads).collect()))
    for options in ({}, {"task_rows": 20}):
        found = counting.reads_in_windows(windows, reads, broadcast_rows=0, **options)
        assert sorted(map(str, found.collect())) == few
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1
        if not options:
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("Exchange") == 1  # and one that the join adds for the windows
