"""Fragments counted where they meet breaks, against labels read by read."""

import random

from pyspark.sql import functions as F

from breakwater.operators import counting, meeting
from test_steps import LIMITS, READ, SV


def table(n, seed):
    """Ordinary, clipped, far and turned pairs and single reads around ends near and far from each
    other, on two chromosomes, some below zero, and reads with an unknown field."""
    rng = random.Random(seed)
    svs = []
    for i in range(n // 6):
        at, far = rng.choice([300, 8190, 8500, 16_300]) + rng.randrange(-60, 60), rng.choice([60, 150, 400, 1500, 8000])
        chrom = rng.choice(["1", "1", "X"])
        svs.append((f"S{i % 2}", i, chrom, at, rng.choice("+-"), rng.choice([chrom, chrom, "X"]), at + rng.choice([far, far, -far]), rng.choice("+-")))
    reads = []
    for i in range(n):
        sample, _, chr1, pos1, _, chr2, pos2, _ = svs[rng.randrange(len(svs))]
        for k in range(rng.choice([1, 2, 2, 2, 2, 2, 3])):
            chrom, at = rng.choice([(chr1, pos1), (chr1, pos1), (chr2, pos2)])
            at += rng.choice([-350, -200, -110, -100, -97, -60, -40, -3, 0, 2, 10, 95, 120, 300]) + rng.randrange(-2, 3)
            clip = rng.choice([(0, 100), (0, 100), (0, 100), (40, 100), (0, 60), (1, 100), (0, 94)])
            size = rng.choice([300, 300, -300, 9000, -9000, 250])
            reads.append([sample, f"q{i}", chrom, at, at + clip[1] - clip[0], *clip, 100, size, bool(k % 2) ^ (rng.random() < 0.2)])
        if i % 40 == 7:
            reads[-1][rng.choice([2, 3, 5, 8, 9])] = None
    return svs, reads


def test_counts_are_those_read_by_read(spark, monkeypatch):
    svs, reads = table(900, 3)
    limits = spark.createDataFrame([("S0", 100, 300.0, 200.0, 450.5, 1e6), ("S1", 100, 300.0, 200.0, 330.0, 1e6)], LIMITS)
    sv, rd = spark.createDataFrame(svs, SV), spark.createDataFrame(reads, READ)

    def counted(**options):
        out = counting.sv_counts(sv, rd, limits, **options)
        labels, _ = counting.labelled_reads(sv, rd, limits, **options)
        again = [sorted(map(tuple, counting.anomalous_recount(labels, exclude_supporting=x).collect())) for x in (True, False)]
        return sorted(map(str, out.collect())), again, labels

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    monkeypatch.setattr(meeting, "PAIRS", 500)
    try:
        found, again, labels = counted(broadcast_rows=0, task_rows=60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    names = [r.query_name for r in labels.several.select("query_name").distinct().collect()]
    assert 0 < len(names) < 300
    monkeypatch.setattr(meeting, "known", lambda fields: F.lit(False))
    want, want_again, each = counted()
    assert each.short.isEmpty() and found == want and again == want_again
    sums = labels.sums.agg(*[F.sum(c) for c in meeting.SUMS]).first()
    assert min(sums) > 0 and all(again)


def test_a_pair_of_a_fragment_and_a_break_is_no_row(spark):
    """100 breaks in one place and 400 pairs across it: a row for each break."""
    svs = spark.createDataFrame([("S", i, "1", 1000, "+", "1", 3000, "-") for i in range(100)], SV)
    rows = [("S", f"q{i}", "1", at, at + 100, 0, 100, 100, size, turned) for i in range(400) for at, size, turned in ((950, 300, False), (1150, -300, True))]
    rows += [("S", "z", "1", at, at + 100, 0, 100, 100, 300, False) for at in (2900, 2990)]
    limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, 1e6)], LIMITS)
    labels, _ = counting.labelled_reads(svs, spark.createDataFrame(rows, READ), limits)
    assert labels.met.count() == 200 and labels.several is None
    assert {(r.split_norm1, r.norm_olap_bp1) for r in labels.sums.collect()} == {(400, 400 * 50)}
