"""Counting, annotation, filters and clustering on hand-made and random tables."""

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from breakwater.functions import genotype
from breakwater.operators import annotate, audit, clustering, copynumber, counting, filters, mixed
from breakwater.params import DEFAULTS
from breakwater.plans import pipelines, queries_filter, views

SF = "/root/testdata/sf0.001"

READ = (
    "sample string, query_name string, chrom string, ref_start long, ref_end long, align_start long, "
    "align_end long, len long, ins_len long, is_reverse boolean"
)
SV = "sample string, sv_id long, chr1 string, pos1 long, dir1 string, chr2 string, pos2 long, dir2 string"
LIMITS = "sample string, read_len long, insert_mean double, min_ins double, max_ins double, max_dp double"


def random_reads(n, seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(n):
        at = rng.choice([1000, 3000]) + rng.randrange(-120, 60)
        clip = rng.choice([(0, 100), (0, 100), (0, 100), (40, 100), (0, 60), (1, 100)])
        size = rng.choice([300, 300, -300, -300, 9000, 250])
        rows.add(("S", f"q{rng.randrange(n // 3)}", "1", at, at + clip[1] - clip[0], *clip, 100, size, rng.random() < 0.5))
    return sorted(rows, key=str)


def labels_by_hand(reads, pos, direction, lo, hi, already):
    """One window, read by read in sorted order; the set of normal fragments grows."""
    normal, out = set(already), {}
    reads = sorted(reads, key=lambda r: r[1:])

    def ok(r):
        return lo < abs(r[8]) < hi

    def clip(r):
        return r[5] != 0 or r[6] != r[7]

    def over(r):
        return r[3] < pos + 6 and r[4] > pos - 6

    def across(r):
        return r[5] < 2 and r[7] - r[6] < 2 and ok(r) and r[3] < pos - 10 and r[4] > pos + 10

    def right(r):
        return abs(r[4] - pos) < 6 and r[7] - r[6] >= 6 and abs(r[8]) < hi

    def left(r):
        return abs(r[3] - pos) < 6 and r[5] >= 6 and abs(r[8]) < hi

    for i, r in enumerate(reads):
        if r[1] in normal:
            continue
        m = reads[i + 1] if i + 1 < len(reads) and reads[i + 1][1] == r[1] else None
        if not clip(r) and ok(r) and not over(r) and (
            m is None or (ok(m) and not over(m) and not (r[3] < pos and m[4] > pos))
        ):
            continue
        if across(r):
            normal.add(r[1])
            out["split_norm"] = out.get("split_norm", 0) + 1
        elif right(r) if r[5] < 6 else left(r):
            if right(r) if direction == "+" else left(r):
                out["split"] = out.get("split", 0) + 1
        elif m and not clip(r) and not clip(m) and r[9] != m[9] and ok(r) and r[3] < pos and m[4] > pos:
            if not across(m):
                normal.add(r[1])
                out["span_norm"] = out.get("span_norm", 0) + 1
    return out, normal


def test_passed_over_reads_equal_sequential_count(spark):
    reads = random_reads(900, 11)
    svs = spark.createDataFrame([("S", 1, "1", 1000, "+", "1", 3000, "-")], SV)
    limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, 1e6)], LIMITS)
    got = counting.sv_counts(svs, spark.createDataFrame(reads, READ), limits).first()
    # The shuffled join with crowded bins spread over salts gives the same counts.
    salted = counting.sv_counts(
        svs, spark.createDataFrame(reads, READ), limits, broadcast_rows=0, task_rows=50
    ).first()
    assert salted == got
    normal = set()
    for end, pos, direction in ((1, 1000, "+"), (2, 3000, "-")):
        near = [r for r in reads if r[3] < pos + 450 and r[4] > pos - 451]
        counts, normal = labels_by_hand(near, pos, direction, 200, 450, normal)
        for name in ("split_norm", "split", "span_norm"):
            assert got[f"{name}{end}"] == counts.get(name, 0) > 0, (name, end)
        assert got[f"total_reads{end}"] == len(near)


def test_too_deep_and_empty_windows(spark):
    reads = [("S", f"q{i}", "1", 950, 1050, 0, 100, 100, 300, False) for i in range(5)]
    svs = [("S", 1, "1", 1000, "+", "1", 9000, "-"), ("S", 2, "1", 1000, "+", "1", 1100, "-")]
    df, rd = spark.createDataFrame(svs, SV), spark.createDataFrame(reads, READ)
    for cap, tags in ((1e6, {1: ["NO_READS"], 2: None}), (3.0, {1: ["HIDEP"], 2: ["HIDEP"]})):
        limits = spark.createDataFrame([("S", 100, 300.0, 200.0, 450.0, cap)], LIMITS)
        rows = {r.sv_id: r for r in counting.sv_counts(df, rd, limits).collect()}
        assert {k: r.tags for k, r in rows.items()} == tags
        assert rows[1].total_reads1 == 0


def test_documented_fractions(spark):
    # split1, split2, spanning, norm1, norm2 and the published fractions (fixed values).
    rows = [
        (4, 4, 4, 12, 13, 15, 8, 0.32432432432432434, 0.34285714285714286),
        (1, 8, 12, 19, 23, 19, 13, 0.33333333333333331, 0.39622641509433965),
        (6, 6, 6, 14, 12, 12, 16, 0.40909090909090912, 0.39130434782608697),
        (8, 8, 9, 11, 18, 17, 15, 0.46296296296296297, 0.43859649122807015),
        (9, 5, 9, 13, 15, 16, 21, 0.45098039215686275, 0.38333333333333336),
    ]
    names = "split1 long, split2 long, spanning long, split_norm1 long, span_norm1 long, split_norm2 long, span_norm2 long, v1 double, v2 double"
    for r in counting.with_support(spark.createDataFrame(rows, names)).collect():
        assert (r.vaf1, r.vaf2) == pytest.approx((r.v1, r.v2))


def test_interspersed_duplications_equal_fold(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        at = rng.randrange(40) * 60 + 1
        first, second = rng.choice(["-+", "+-", "+-", "++", "-+", "??"])
        rows.append(("S", i, "1", at, first, "1", at + rng.choice([400, 430, 900]), second))
    tags = {i: (["BLACKLIST"] if i % 17 == 3 else []) for i in range(400)}
    df = spark.createDataFrame([(*r, tags[r[1]]) for r in rows], SV + ", tags array<string>")
    got = {r.sv_id: r.classification for r in annotate.classify_pairs(df).collect()}
    ids = {r.sv_id: r.event_id for r in annotate.classify_pairs(df).collect()}
    prev, number = None, 0
    for _, i, _, p1, d1, _, p2, d2 in sorted(rows, key=lambda r: (r[3], r[4], r[6], r[7], r[1])):
        code = {"-+": "DUP", "+-": "DEL", "++": "INV", "??": "Unknown"}[d1 + d2]
        if tags[i]:
            number += 1
            assert ids[i] == number
            continue
        if prev and (abs(prev[0] - p1) < 100 or abs(prev[1] - p2) < 100):
            if {prev[2], code} == {"DUP", "DEL"} or (prev[2] == "INTDUP" and code == "Unknown"):
                code = "INTDUP"
        number += code != "INTDUP"
        assert (got[i], ids[i]) == (code, number)
        prev = (p1, p2, code)


def test_translocation_takes_three_svs(spark):
    rows = [
        ("S", 1, "1", 1000, "-", "1", 6000, "+"),
        ("S", 2, "1", 1004, "+", "1", 9000, "-"),
        ("S", 3, "1", 6002, "+", "1", 8997, "-"),
        ("S", 4, "1", 50, "+", "2", 70, "-"),
    ]
    out = {r.sv_id: (r.classification, r.event_id) for r in annotate.classify(spark.createDataFrame(rows, SV)).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("TRX", 0)] * 3 and out[4][0] == "INTRX"


def test_mixed_ends(spark):
    def sv(i, p1, p2, tags="MIXED;MIXED", d1=None):
        return ("S", i, "1", p1, d1, "1", p2, None, tags.split(";"), p1 + 2, p1 - 1, p2 + 2, None)

    rows = [
        sv(1, 100, 900),
        sv(2, 5000, 6000),
        sv(3, 5003, 5998),
        sv(4, 10000, 12000),
        sv(5, 12002, 15000),
        sv(6, 10001, 15003),
        sv(7, 20000, 21000),
        sv(8, 20003, 23000),
        sv(9, 300, 400, "MIXED", "+"),
        sv(10, 500, 600, "UNKNOWN_DIR;MIXED"),
    ]
    schema = SV + ", tags array<string>, ca_right1 long, ca_left1 long, ca_right2 long, ca_left2 long"
    out = {}
    for r in mixed.resolve_mixed(spark.createDataFrame(rows, schema)).orderBy("sv_id", "part").collect():
        out.setdefault(r.sv_id, []).append((r.dir1, r.pos1, r.dir2, r.pos2, ";".join(r.tags)))
    assert out[1] == [("-", 99, "-", 900, ""), ("+", 102, "+", 902, "")]
    assert out[2] == [("+", 5002, "+", 6002, "")] and out[3] == [("-", 4999, "-", 6000, "")]
    assert [out[i][0][:3:2] for i in (4, 5, 6)] == [("+", "-"), ("+", "-"), ("-", "+")]
    assert out[7][0][4] == out[8][0][4] == "UNKNOWN_DIR"
    assert out[9] == [("+", 300, "-", 400, ""), ("+", 300, "+", 602 - 200, "")]
    assert out[10][0][4] == "UNKNOWN_DIR"


def test_copy_number_filter_order_and_ties(spark):
    rows = [(i, t) for i, t in enumerate(["1,1,1.0", "2,1,0.7|1,1,0.3", "0,0,1.0", "12,0,1.0", "", "x,1,1", "-1,1,1.0"])]
    df = spark.createDataFrame(rows, "id long, g string").select(
        "id", genotype.parse(F.col("g")).alias("states1"), F.lit(2.0).alias("ploidy")
    ).withColumn("states2", F.col("states1"))

    def ids(p):
        return sorted(r.id for r in filters.cn_filters_sv(df, p).collect())

    assert ids(DEFAULTS) == [0, 1]
    assert ids(replace(DEFAULTS, neutral=True)) == [0]
    assert ids(replace(DEFAULTS, filter_subclonal_cnvs=True)) == [0]
    assert ids(replace(DEFAULTS, strict_cnv=False)) == [0, 1, 2, 4, 5, 6]
    seg = [("S", "1", i, a, b, f"{i},1,1.0") for i, (a, b) in enumerate([(100, 200), (150, 300), (400, 500)])]
    segments = spark.createDataFrame(seg, "sample string, chr string, ordinal long, startpos long, endpos long, g string").select(
        "sample", "chr", "ordinal", "startpos", "endpos", genotype.parse(F.col("g")).alias("states")
    )
    svs = spark.createDataFrame(
        [("S", 1, "1", 160, "+", "1", 350, "-", "DEL"), ("S", 2, "1", 350, "+", "7", 1, "-", "INTRX")], SV + ", classification string"
    )
    out = {r.sv_id: r for r in copynumber.match_svs(svs, segments, replace(DEFAULTS, sv_offset=0)).collect()}
    # The first segment in the file wins; a place as near to an end as to a start takes the end.
    assert out[1].states1[0].major == 0 and out[1].states2 is None and out[1].adjacent_states2[0].major == 1
    assert (out[1].boundary_dist1, out[1].boundary_dist2) == (10, 50)
    assert out[2].states2 is None and out[2].adjacent_states2 is None


def test_fit_recovers_planted_fractions(spark):
    rng = random.Random(13)
    rows = []
    for i in range(500):
        ccf = 1.0 if i % 5 < 3 else 0.3
        total = 45 + rng.randrange(30)
        share = ccf * 0.8 / (0.8 * 2 + 0.2 * 2)
        var = sum(rng.random() < share for _ in range(total))
        rows.append(("S", "12", i, float(total - var), float(var)))
    snvs = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref double, var double").filter("var > 0")
    snvs = snvs.withColumns({"purity": F.lit(0.8), "states": genotype.parse(F.lit("1,1,1.0"))})
    loci = clustering.snv_loci(clustering.model_input_snv(snvs))
    model = clustering.fit_clusters(loci, replace(DEFAULTS, clus_limit=3, repeat=1, n_iter=25), tolerance=1e-3)
    found = sorted(r.ccf for r in model.collect())
    assert found == pytest.approx([0.3, 1.0], abs=0.05)
    alone = clustering.single_variant_model(loci.limit(1)).collect()
    assert len(alone) == 1 and alone[0].weight == 1.0


def _counted(spark, samples):
    rows = [(s, i, "1", 1000, "1", 1000 + size, 5, 5, 5, 30, 30, 15, "DEL", "+", "-") for s in samples for i, size in enumerate((100, 5000))]
    names = "sample sv_id chr1 pos1 chr2 pos2 split1 split2 spanning norm1 norm2 support classification dir1 dir2".split()
    return spark.createDataFrame(rows, names)


def test_a_sample_without_parameters_keeps_its_svs(spark):
    params = spark.createDataFrame([("S1", 0.8, 3.0, 100, 300.0, 20.0)], "sample string, purity double, ploidy double, read_len long, insert_mean double, insert_std double")
    kept = pipelines.filter_svs(_counted(spark, ["S1", "S2"]), params).collect()
    # the short SV of each sample is below the size limit of the default parameters, the long one stays
    assert sorted((r.sample, r.sv_id, r.purity, r.ploidy) for r in kept) == [("S1", 1, 0.8, 3.0), ("S2", 1, 1.0, 2.0)]


def test_variants_without_reads_stay_in_result_tables(spark):
    names = "sample string, variant_id long, var1 double, total1 double, weight1 double, mult1 double, top1 int, copies1 double, var2 double, total2 double, weight2 double, mult2 double, top2 int, copies2 double"
    none = (None,) * 6
    loci = spark.createDataFrame(
        [("S", 1, 10.0, 40.0, 0.5, 1.0, 1, 2.0, *none), ("S", 2, 0.0, 0.0, 0.5, 1.0, 1, 2.0, *none), ("S", 3, 5.0, 20.0, None, 1.0, 1, 2.0, *none)], names
    )
    model = spark.createDataFrame([("S", 1, 0.5, 0.6), ("S", 2, 1.0, 0.4)], "sample string, cluster int, ccf double, weight double")
    purity = spark.createDataFrame([("S", 0.9)], "sample string, purity double")
    assigned = clustering.assign(loci, model)
    rows = {r.variant_id: r for r in assigned.collect()}
    assert set(rows) == {1, 2, 3} and rows[1].label == 1 and rows[2].label is None and rows[3].probs is None
    assert clustering.assignment_probability(assigned).count() == 3
    copies = {r.variant_id: r.multiplicity1 for r in clustering.multiplicity(assigned).collect()}
    assert copies == {1: 1, 2: None, 3: None}
    assert {r.variant_id for r in clustering.cluster_certainty(assigned, purity).collect()} == {1, 2, 3}
    assert [r.n_ssms for r in clustering.subclonal_structure(assigned, model, purity).collect()] == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_audit_agrees_with_the_filters_and_is_observed(spark):
    """What has no verdict is what the filters keep, and writing it gives the counts."""
    given = [views.view(spark, SF, n) for n in ("sv_cnt", "params", "blacklist", "germline")]
    svs, params, blacklist, germline = given
    segments = queries_filter.segments(spark, SF)
    for rules in (queries_filter.AUDITED, replace(DEFAULTS, strict_cnv=False, min_dep=2), replace(DEFAULTS, neutral=True, filter_outliers=True)):
        labelled = audit.label_svs(pipelines.with_params(svs, params), segments, blacklist, germline, rules)
        kept, seen = audit.observed(labelled, audit.SV_RULES)
        ids = sorted((r.sample, r.sv_id) for r in kept.select("sample", "sv_id").collect())
        want = pipelines.filter_svs(svs, params, segments, blacklist, germline, rules)
        assert ids == sorted((r.sample, r.sv_id) for r in want.select("sample", "sv_id").collect()) and (ids or rules.neutral)
        total = {}
        for r in audit.counts(labelled).collect():
            total[r.rule] = total.get(r.rule, 0) + r.n
        assert {k: v for k, v in seen.get.items() if v} == total and sum(total.values()) == svs.count()
    snvs = queries_filter.snvs(spark, SF)
    labelled = audit.label_snvs(pipelines.with_params(snvs, params), segments, blacklist, queries_filter.AUDITED)
    kept, seen = audit.observed(labelled, audit.SNV_RULES)
    want = pipelines.filter_snvs(snvs, params, segments, blacklist, queries_filter.AUDITED)
    assert kept.count() == want.count() == seen.get["kept"] and sum(seen.get.values()) == snvs.count()
