"""Session construction and the reliable checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "breakwater", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one the cluster names in
    ``spark.checkpoint.dir``.  A local master without one gets a folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="breakwater-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Paths given out by ``scratch_path`` and not yet released.
_written: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A path for a table in the checkpoint folder that ``release`` deletes."""
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there, so that
    what follows does not recompute it, survives the loss of executors, reads only the
    columns it needs, and is planned with the size known.  ``release`` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """While a table of very long expressions is written: code that the JVM would not compile
    for its size (8,000 bytes a method) is generated in pieces instead."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice that the shuffles behind a stored table are over, so that their
    files go now and not whenever it happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Delete the tables written under scratch paths so far, once their results have been
    used or written elsewhere.  Returns how many there were."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
