"""Lines of text files, and the columns in them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, ordinal, line).  ``ordinal`` rises with the place in the file: the start
    of the block a task reads, then the row within the task."""
    raw = spark.read.text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ordinal"),
        F.col("value").alias("line"),
    )


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = "\t",
    header: bool = True,
    comment: str | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text as string columns with ``path`` and ``ordinal``."""
    reader = spark.read.option("sep", sep).option("header", header)
    if comment:
        reader = reader.option("comment", comment)
    if names:
        reader = reader.schema(", ".join(f"`{n}` STRING" for n in names))
    raw = reader.csv(paths)
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ordinal"),
    )


def lines_to_table(lines: DataFrame, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """Columns of delimited ``line`` values; other columns are kept."""
    schema = ", ".join(f"`{n}` STRING" for n in names)
    parsed = lines.withColumn("_row", F.from_csv("line", schema, {"sep": sep}))
    rest = [c for c in lines.columns if c != "line"]
    return parsed.select(*rest, "_row.*")


def row_id(df: DataFrame) -> Column:
    """A number of its own for each row of a table read from text: its place in the file,
    or the ordinal itself where that is a number."""
    kind = df.schema["ordinal"].dataType
    return (F.col("ordinal.row") if isinstance(kind, StructType) else F.col("ordinal")).cast("long")


def number(col: Column | str, kind: str = "double") -> Column:
    """Number in a text field; NULL for NA and the like."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(col.cast("string")).try_cast(kind)


def emit(df: DataFrame, row: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """One output row for each input row whose struct ``row`` passes ``keep``.

    A plain filter on parsed columns is pushed below the projection that parses them,
    which then parses everything twice; here the struct is made once and tested."""
    return df.select(F.inline(F.filter(F.array(row), keep)))
