"""Blacklists of many overlapping intervals, and cells of grid joins."""

import random

import pytest
from pyspark.sql import functions as F

from breakwater.operators import audit, filters, ranges


@pytest.mark.parametrize("few", [0, 1000])
def test_merged_intervals_cover_the_same_places(spark, few):
    rng = random.Random(2)
    rows = [(rng.choice("12"), s := rng.randrange(2000), s + rng.choice([-3, 0, 5, 60])) for _ in range(150)]
    rows += [("1", 5000, 5009), ("1", 5010, 5020), ("1", 5000, 5002), (None, 1, 5), ("2", None, 7)]
    out = filters.merged(spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long"), few)
    got = sorted(map(tuple, out.select("chrom", "start_pos", "end_pos").collect()))
    covered = {(c, p) for c, s, e in rows if c and s is not None for p in range(s, e + 1)}
    assert {(c, p) for c, s, e in got for p in range(s, e + 1)} == covered
    # none overlaps or touches the next one
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(got, got[1:]))
    assert ("1", 5000, 5020) in got


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "task_rows": 20}])
def test_audit_keeps_a_row_in_many_intervals_one_row(spark, options):
    intervals = spark.createDataFrame([("1", 100 + i, 300 + i) for i in range(40)], "chrom string, start_pos long, end_pos long")
    rows = [(i, "1" if i % 2 else "2", 90 + i, None) for i in range(400)] + [(1000, "1", None, None), (1001, "1", 200, "size")]
    df = spark.createDataFrame(rows, "sv_id long, chrom string, pos long, verdict string")
    out = audit.fail_blacklisted(df, intervals, [("chrom", "pos")], **options)
    assert out.columns == df.columns
    got = {r.sv_id: r.verdict for r in out.collect()}
    want = {i: "blacklist" if c == "1" and p and 100 <= p <= 339 and not v else v for i, c, p, v in rows}
    assert out.count() == len(rows) and got == want


def test_grid_join_enters_a_row_in_few_cells(spark):
    """Far from the edge of a cell a right row is one row of the join, not nine."""
    left = spark.createDataFrame([(1, 40, 40)], "a long, p long, q long").withColumn("k", F.lit("x"))
    right = spark.createDataFrame([(i, 40, 40) for i in range(10)], "b long, r long, s long").withColumn("k", F.lit("x"))
    out, by = ranges.grid_join(left, right, ["k"], (F.col("p"), F.col("q")), (F.col("r"), F.col("s")), 10, broadcast_rows=0)
    assert out.count() == 10 and set(by) >= {"k", "_cell_a", "_cell_b"}
    assert ranges.GRID >= 4 and ranges.CELLS == 4
