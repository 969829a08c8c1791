"""VCF lines as records, and access to their INFO and sample fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join


def _samples(part: Column) -> Column:
    return F.slice(part, 10, F.greatest(F.size(part) - 9, F.lit(0)))


def records(lines: DataFrame) -> DataFrame:
    """One row per data line.  Columns of ``lines`` other than ``line`` are kept."""
    rest = [c for c in lines.columns if c != "line"]
    part = F.col("_part")
    split = lines.filter(~F.col("line").startswith("#") & (F.col("line") != "")).select(
        *rest, F.split("line", "\t").alias("_part")
    )
    return split.select(
        *rest,
        F.get(part, 0).alias("chrom"),
        F.get(part, 1).try_cast("long").alias("pos"),
        F.get(part, 2).alias("id"),
        F.get(part, 3).alias("ref_base"),
        F.get(part, 4).alias("alt"),
        F.get(part, 6).alias("filter"),
        F.get(part, 7).alias("info"),
        F.split(F.get(part, 8), ":").alias("format"),
        _samples(part).alias("calls"),
    )


def with_sample_names(lines: DataFrame) -> DataFrame:
    """Records plus ``names``, the sample names of their file's header line."""
    headers = lines.filter(F.col("line").startswith("#CHROM")).select(
        "path", _samples(F.split("line", "\t")).alias("names")
    )
    return lookup_join(records(lines), headers, ["path"])


def passes() -> Column:
    """No failed filter named."""
    return F.col("filter").isNull() | F.col("filter").isin(".", "PASS", "")


def info(key: str) -> Column:
    """Value of an INFO key, NULL where it is absent."""
    return F.nullif(F.regexp_extract("info", f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def call_of(name: Column | str) -> Column:
    """Sample column of the sample so named; NULL where there is none."""
    at = F.array_position(F.col("names"), name)
    return F.when(at > 0, F.get(F.col("calls"), (at - 1).cast("int")))


def field(values: Column, key: str) -> Column:
    """One FORMAT field of a sample column that is split at its colons."""
    at = F.array_position(F.col("format"), key)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))
