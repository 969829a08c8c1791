"""The steps one after the other on the driver tables."""

import os
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from breakwater.operators import clustering, counting
from breakwater.params import DEFAULTS
from breakwater.plans import pipelines, queries_cluster, queries_filter, views
from breakwater.sources import cnv, sample_tables, sinks, sv
from breakwater.sources.text import read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_annotate_count_filter(spark):
    svs, params = views.view(spark, SF, "sv"), views.view(spark, SF, "params")
    reads = views.stored(views.view(spark, SF, "reads"))
    limits = counting.read_limits(params)
    annotated = pipelines.annotate_svs(svs, reads, limits, views.view(spark, SF, "blacklist"))
    classes = {r["classification"]: r["count"] for r in annotated.groupBy("classification").count().collect()}
    assert sum(classes.values()) == svs.count()
    assert set(classes) <= {"BLACKLIST", "INTRX", "DEL", "DUP", "INV", "INTDUP", "TRX", "INS", "Unknown"}
    counts = views.stored(pipelines.count_svs(annotated, reads, limits))
    assert counts.count() == svs.count() - classes["BLACKLIST"]
    rules = replace(DEFAULTS, min_dep=1, min_split=0, min_span=0, strict_cnv=False)
    kept = pipelines.filter_svs(counts, params, segments=queries_filter.segments(spark, SF), p=rules)
    assert 0 < kept.count() <= counts.filter("support + least(norm1, norm2) >= 1").count()


def _to_text(df, path):
    rows = df.collect()
    lines = ["\t".join(df.columns)] + ["\t".join("NA" if v is None else str(v) for v in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_from_files_to_results(spark, tmp_path):
    """Text files in, result tables out, without a step in between that a user has to add."""
    one = views.view(spark, SF, "sv").filter("sample = 'S1'")
    calls = _to_text(one.select("chr1", "pos1", "dir1", "chr2", "pos2", "dir2"), tmp_path / "svs.txt")
    bed = tmp_path / "black.bed"
    bed.write_text("1\t20000\t40000\n")
    segs = views.view(spark, SF, "cnv").filter("sample = 'S1'")
    named = {"nmaj1": "nMaj1_A", "nmin1": "nMin1_A", "frac1": "frac1_A"}
    second = {c: F.lit(None).cast("double") for c in ("nMaj2_A", "nMin2_A", "frac2_A")}
    text = _to_text(segs.drop("sample", "ordinal").withColumnsRenamed(named).withColumns(second), tmp_path / "cnv.txt")

    svs = sv.sv_simple(read_table(spark, calls).withColumn("sample", F.lit("S1")), use_dir=True)
    assert svs.select("sv_id").distinct().count() == one.count()
    blacklist = sv.blacklist_bed(read_table(spark, str(bed), header=False))
    segments = cnv.segments(read_table(spark, text).withColumn("sample", F.lit("S1")))
    params = sample_tables.sample_params(svs, None, None)
    limits = counting.read_limits(params)
    reads = views.stored(views.view(spark, SF, "reads").filter("sample = 'S1'"))

    pipelines.check_chromosomes(svs, segments)
    with pytest.raises(ValueError, match="share no chromosome"):
        pipelines.check_chromosomes(svs, segments.withColumn("chr", F.concat(F.lit("chr"), "chr")))
    annotated = pipelines.annotate_svs(svs, reads, limits, blacklist)
    sinks.write_parquet(pipelines.count_svs(annotated, reads, limits), str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    rules = replace(DEFAULTS, min_dep=1, min_split=0, min_span=0, strict_cnv=False)
    kept = views.stored(pipelines.filter_svs(counts, params, segments=segments, p=rules))
    assert kept.count() > 0 and kept.filter("states1 IS NOT NULL").count() > 0
    loci = clustering.sv_loci(clustering.model_input_sv(kept, rules))
    short = replace(rules, clus_limit=2, repeat=1, n_iter=20)
    tables = pipelines.cluster(loci, params, short)
    sinks.write_results(tables, str(tmp_path / "out"))
    for name in tables:
        assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / name)).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_postassign_of_both_kinds(spark):
    params = views.view(spark, SF, "params")
    loci = {kind: views.stored(queries_cluster._loci(spark, SF, kind)) for kind in ("sv", "snv")}
    short = replace(DEFAULTS, clus_limit=2, repeat=1, n_iter=10)
    models = {kind: views.stored(pipelines.fit(x, short)) for kind, x in loci.items()}
    out = pipelines.postassign(loci["sv"], loci["snv"], models["sv"], models["snv"], params)
    for kind in ("sv", "snv"):
        wide = out[kind]["assignment_probability"]
        probs = [F.coalesce(F.col(c), F.lit(0.0)) for c in wide.columns if c.startswith("cluster")]
        sums = wide.select(sum(probs, F.lit(0.0)).alias("s")).agg(F.min("s"), F.max("s")).first()
        # clusters that no variant is most likely in are left out of the wide table
        assert 0.3 < sums[0] <= sums[1] < 1.0001


def test_samples_without_limits_or_model_keep_their_rows(spark):
    svs = spark.createDataFrame(
        [("A", 1, "1", 1000, "+", "1", 2000, "-"), ("B", 2, "1", 1000, "+", "1", 2000, "-")],
        "sample string, sv_id long, chr1 string, pos1 long, dir1 string, chr2 string, pos2 long, dir2 string",
    )
    params = spark.createDataFrame([("A", 100, 300.0, 20.0)], "sample string, read_len int, insert_mean double, insert_std double")
    with_default = counting.countable(svs, counting.read_limits(params)).orderBy("sample").collect()
    assert [r.sample for r in with_default] == ["A", "B"] and with_default[0].max_dp == with_default[1].max_dp
    loci = clustering.snv_loci(
        spark.createDataFrame(
            [(s, "m", 1.0, 2.0, 30.0, 30.0, 60.0, 0.5, 1.0, 1.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0) for s in "AB"],
            "sample string, mutation_id string, purity double, normal_cn double, var_counts double, ref_counts double, total_counts double,"
            " vaf double, major_cn_sub1 double, minor_cn_sub1 double, total_cn_sub1 double, frac_cn_sub1 double,"
            " major_cn_sub2 double, minor_cn_sub2 double, total_cn_sub2 double, frac_cn_sub2 double",
        )
    )
    model = spark.createDataFrame([("A", i, 1.0 - i / 10, 0.125) for i in range(1, 9)], "sample string, cluster int, ccf double, weight double")
    assigned = clustering.assign(loci, model)
    assert {r.sample: r.label for r in assigned.collect()}["B"] is None
    wide = clustering.assignment_probability(assigned)
    assert len([c for c in wide.columns if c.startswith("cluster")]) == 8
