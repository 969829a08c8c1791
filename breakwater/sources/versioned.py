"""Tables of a step that may be cut short and repeated.

A step writes its tables under a name of its own run, and then one small file that says which
samples the run stands for.  Readers take, of each sample, the run named last, so they see all
tables of a step or none, whatever file system holds them.  What a run that was cut short left
behind is never read; a repeated step takes the place of the earlier one for its samples and
leaves other samples as they are."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import skew

COMMITS = "commits"
COMMIT = "sample string, version long, run string, schemas map<string, string>"


def _path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The run that stands for each sample: (sample, version, run, schemas)."""
    path = f"{folder}/{COMMITS}"
    if not _path_exists(spark, path):
        return spark.createDataFrame([], COMMIT)
    # Of two runs of one version, written side by side, the greater name stands.
    last = spark.read.schema(COMMIT).parquet(path).groupBy("sample").agg(
        F.max(F.struct("version", "run", F.map_entries("schemas").alias("entries"))).alias("c")
    )
    return last.select("sample", "c.version", "c.run", F.map_from_entries("c.entries").alias("schemas"))


def commit(tables: dict[str, DataFrame], folder: str, samples: DataFrame | None = None) -> str:
    """Write the tables of a step, all with a ``sample``, and name the run for its samples:
    those of ``samples``, or all that any table has.  A sample without rows in a table is empty
    there, also where an earlier run had some; rows without a sample are an error.  Returns
    the name of the run."""
    run = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    missing = F.raise_error(F.lit("a row of a step has no sample")).cast("string")
    for name, table in tables.items():
        named = table.withColumn("sample", F.coalesce(F.col("sample").cast("string"), missing))
        named.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "sample").parquet(f"{folder}/{name}")
    schemas = {name: json.dumps(table.schema.jsonValue()) for name, table in tables.items()}
    if samples is None:
        found = [_run_of(spark, folder, name, table.schema).filter(F.col("run") == run).select("sample") for name, table in tables.items()]
        samples = found[0]
        for other in found[1:]:
            samples = samples.union(other)
    last = commits(spark, folder).agg(F.max("version")).first()[0] or 0
    # One narrow row for each sample, in one file, so that the run appears at once.
    row = samples.select("sample").distinct().select(
        "sample",
        F.lit(last + 1).cast("long").alias("version"),
        F.lit(run).alias("run"),
        F.create_map(*[F.lit(x) for pair in schemas.items() for x in pair]).alias("schemas"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")
    return run


def _run_of(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    inner = [f for f in schema.fields if f.name != "sample"]
    places = [T.StructField("run", T.StringType()), T.StructField("sample", T.StringType())]
    return spark.read.schema(T.StructType([*inner, *places])).parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as the runs that stand wrote it.  A table that none of them has is an error; of
    columns that runs differ in, those of the newest run that has the table are read."""
    standing = commits(spark, folder)
    newest = standing.filter(F.map_contains_key("schemas", F.lit(name))).agg(F.max_by(F.col("schemas")[name], "version")).first()[0]
    if newest is None:
        raise ValueError(f"no finished run in {folder} has a table {name}")
    schema = T.StructType.fromJson(json.loads(newest))
    held = skew.lookup_join(_run_of(spark, folder, name, schema), standing.select("sample", "run"), ["sample", "run"], "left_semi")
    return held.select(*schema.names)
