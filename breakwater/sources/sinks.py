"""Outputs: Parquet for the next step, tab-separated text for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import genotype


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("sample").parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """Copy-number states as text and tag lists joined, so that csv can hold them."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StructType):
                out[f.name] = genotype.render(F.col(f.name))
            else:
                out[f.name] = F.concat_ws(";", f.name)
    return df.withColumns(out) if out else df


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered text under one folder per sample; NULL is written as nothing."""
    writer = as_text(df).write.mode(mode).partitionBy("sample")
    writer.option("sep", "\t").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def write_results(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Result tables of the cluster or post-assignment step, a folder of text for each."""
    for name, table in tables.items():
        write_tsv(table, f"{folder}/{name}", mode)
