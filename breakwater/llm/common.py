"""What several operators share: tables, scratch tables, row numbers over any number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

#: Text handed to numpy at once, in characters: batches from Spark are cut into such blocks.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    return cut_lineage(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing needs any more."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/").rpartition("/")[2]
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root not in folder:
            raise ValueError(f"{folder} is not a scratch table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def renamed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns of ``df``, under the names that an operator works with, so
    that further columns of the input cannot clash with its own."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def small_table(spark: SparkSession, rows: Sequence[tuple], **kinds: pa.DataType) -> DataFrame:
    """A table of few rows that the driver holds (handed over as Arrow, so that no worker
    processes start for it)."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return spark.createDataFrame(
        pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items(), strict=True)})
    )


def numbered(df: DataFrame, order: Sequence[str], group: str | None = None, name: str = "number") -> DataFrame:
    """``df`` with a gapless number from 0 in the given order (within ``group``, an int), without
    one task for all: rows are dealt by range of the whole order, counted in each range,
    and shifted by the rows of the ranges before.  The ranges are stored, so the numbers
    stay the same if a task runs again.  What is broadcast is one row for each range and
    group that meet, which is at most the number of ranges plus the number of groups."""
    by = [*([group] if group else []), *order]
    ranged = stored(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.spark_partition_id())
    )
    keys = [group] if group else []
    marked = ranged.withColumn("_mark", F.col(group) if group else F.lit(0))
    found = marked.groupBy("_range", "_mark").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).collect()
    found.sort(key=lambda r: (r["_range"], r["_first"]))
    before: dict = {}
    shifts = []
    for r in found:
        shifts.append((r["_range"], r["_mark"], before.get(r["_mark"], 0) - r["_first"]))
        before[r["_mark"]] = before.get(r["_mark"], 0) + r["_n"]
    shift = small_table(df.sparkSession, shifts, _range=pa.int32(), _mark=pa.int32(), _shift=pa.int64())
    return marked.join(F.broadcast(shift), ["_range", "_mark"]).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name)
    )


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of about ``most`` characters; a longer text is a run of its own."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > most:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)



def free_shuffles(df: DataFrame) -> None:
    """Let the driver notice that the shuffles behind a stored table are over, so that their
    files go now and not whenever it happens to collect its garbage."""
    import gc

    gc.collect()
    df.sparkSession._jvm.System.gc()


#: What this worker keeps from task to task.
_kept: dict[str, object] = {}


def keep(owner: str, make: Callable[[], object]) -> object:
    """What ``make`` returned when ``owner`` first asked in this worker.  A worker keeps things
    for one owner at a time: turning to other work frees them, and hands back to the system
    what earlier work has left unused."""
    if owner not in _kept:
        _kept.clear()
        _hand_back()
        _kept[owner] = make()
    return _kept[owner]


def _hand_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    # the C library keeps freed blocks; only glibc has this call
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        keep(each.__qualname__, lambda: None)
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)
