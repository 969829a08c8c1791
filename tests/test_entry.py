"""The driver contract: keys, and a few queries against DuckDB."""

import glob
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from breakwater.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ("filter_sv_basic", "read_stats", "nearest_cnv", "sv_status_capped", "pair_vcf_mates", "match_cnv_snv", "blacklist_sv", "anti_germline", "position_ranks")


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(queries)


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, also):
    """Without the training-data folders everything else imports and has its queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    gone = ["llm", "__pycache__", ".git", *also]
    shutil.copytree(root, tmp_path / "repo", ignore=lambda _, names: [n for n in names if n in gone])
    said = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "repo", env={"PATH": os.environ["PATH"]}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == sorted(catalog.QUERIES)


def test_class_works_on_a_stream(spark, tmp_path):
    """Row-wise operators take a streaming DataFrame as they are."""
    from breakwater.functions.genome import sv_class

    schema = "sample string, sv_id long, chr1 string, pos1 long, dir1 string, chr2 string, pos2 long, dir2 string"
    spark.createDataFrame([("S", 1, "1", 5, "+", "1", 900, "-")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("cls", sv_class())
    query = stream.writeStream.format("memory").queryName("classes").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.cls for r in spark.sql("SELECT cls FROM classes").collect()] == ["DEL"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = [tuple(dict(zip(names, r))[c] for c in columns) for r in want.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
