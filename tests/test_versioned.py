"""Tables of steps: cut short, repeated, read by another job."""

import pytest
from pyspark.sql import functions as F

from breakwater.plans import pipelines
from breakwater.sources import versioned

ROW = "sample string, id long, tags array<string>"


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_step_cut_short_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "step")
    one = spark.createDataFrame([("1", 1, ["a"]), ("1", 2, None), ("S2", 3, [])], ROW)
    two = spark.createDataFrame([("1", 9.5), ("S2", 1.0)], "sample string, x double")
    versioned.commit({"one": one, "two": two}, folder)
    before = [rows(versioned.read(spark, folder, t)) for t in ("one", "two")]
    assert before == [rows(one), rows(two)]

    new_one = spark.createDataFrame([("1", 7, ["b"])], ROW)
    fails = F.when(F.col("x") > 5, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("x"))
    new_two = spark.createDataFrame([("1", 2.0), ("1", 8.0)], "sample string, x double")
    with pytest.raises(Exception, match="killed"):
        versioned.commit({"one": new_one, "two": new_two.withColumn("x", fails)}, folder)
    assert [rows(versioned.read(spark, folder, t)) for t in ("one", "two")] == before

    # Repeated twice: sample 1 is replaced, S2 stays.
    for _ in range(2):
        versioned.commit({"one": new_one, "two": new_two}, folder)
        assert rows(versioned.read(spark, folder, "one")) == rows(new_one.union(one.filter("sample = 'S2'")))
        assert rows(versioned.read(spark, folder, "two")) == rows(new_two.union(two.filter("sample = 'S2'")))


def test_a_table_that_has_lost_its_rows(spark, tmp_path):
    folder = str(tmp_path / "step")
    one = spark.createDataFrame([("A", 1, ["a"]), ("B", 2, ["b"])], ROW)
    versioned.commit({"one": one}, folder)
    versioned.commit({"one": one.filter("sample = 'B'")}, folder, one.select("sample"))
    assert [r.sample for r in versioned.read(spark, folder, "one").collect()] == ["B"]
    with pytest.raises(ValueError):
        versioned.read(spark, folder, "two")
    with pytest.raises(Exception, match="no sample"):
        versioned.commit({"one": spark.createDataFrame([(None, 1, [])], ROW)}, folder)


def loci(spark, kind, two_loci):
    out = []
    for i in range(90):
        f = 1.0 if i % 3 else 0.3
        var, total = round(80 * f / 2) + i % 3 - 1, 80.0
        second = (float(var), total, 0.5, 1.0, 1, 2.0) if two_loci else (0.0, 0.0, None, None, None, None)
        out.append(("S", f"{kind}{i}", float(var), total, 0.5, 1.0, 1, 2.0, *second))
    fields = ", ".join(f"var{e} double, total{e} double, weight{e} double, mult{e} double, top{e} int, copies{e} double" for e in (1, 2))
    return spark.createDataFrame(out, f"sample string, variant_id string, {fields}")


def test_both_kinds_are_scored_against_stored_fits(spark, tmp_path):
    svs, snvs = loci(spark, "sv", True), loci(spark, "snv", False)
    few = pipelines.DEFAULTS.__class__(clus_limit=2, repeat=1, n_iter=20)
    for name, table in (("sv", svs), ("snv", snvs)):
        pipelines.fit_and_store(table, str(tmp_path / name), few)
    stored = versioned.read(spark, str(tmp_path / "snv"), "model")
    assert sorted((r.cluster, round(r.ccf, 1), r.n) for r in stored.collect()) == [(1, 1.0, 60), (2, 0.3, 30)]
    params = spark.createDataFrame([("S", 1.0, 2.0)], "sample string, purity double, ploidy double")
    out = pipelines.postassign_stored(svs, snvs, str(tmp_path / "sv"), str(tmp_path / "snv"), params)
    for kind in ("sv", "snv"):
        model = {r.cluster: r.ccf for r in out[kind]["model"].collect()}
        certain = {r.variant_id: model[r.most_likely_assignment] for r in out[kind]["cluster_certainty"].collect()}
        assert len(certain) == 90
        assert all(abs(ccf - (1.0 if int(v.removeprefix(kind)) % 3 else 0.3)) < 0.06 for v, ccf in certain.items())
    folder = str(tmp_path / "results")
    pipelines.store_results(out["sv"], folder)
    assert versioned.read(spark, folder, "multiplicity").count() == 90
