"""Fragments of reads, and what is told of a fragment by itself.

What a window holds is counted by sweeps; which fragments count at a break is found where they
meet (``meeting``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R

REST = tuple(c for c in R.FIELDS if c != "query_name")


def of(reads: DataFrame) -> DataFrame:
    """(sample, query_name, n, a, b) of distinct reads: their number in the fragment, the first
    and, of several, the last."""
    read = F.struct(*REST)
    out = reads.groupBy("sample", "query_name").agg(F.count("*").alias("n"), F.min(read).alias("a"), F.max(read).alias("b"))
    return out.withColumn("b", F.when(F.col("n") > 1, F.col("b")))


def named(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Reads of the fragments in ``names``; those without a name are one fragment."""
    names = names.select(F.col("sample").alias("_s"), F.col("query_name").alias("_q"))
    same = F.col("sample").eqNullSafe(F.col("_s")) & F.col("query_name").eqNullSafe(F.col("_q"))
    return reads.join(names, same, "left_semi")


def facing(short: DataFrame) -> DataFrame:
    """Pairs that face each other at an ordinary distance, as the places that a window must
    reach to hold both reads: from the later start to the earlier end."""
    a, b = R.nested(F.col("a")), R.nested(F.col("b"))
    span = b("ref_end") - a("ref_start")
    held = (
        (a("chrom") == b("chrom")) & ~a("is_reverse") & b("is_reverse") & ~R.clipped(a) & ~R.clipped(b)
        & (span > F.col("min_ins")) & (span < F.col("max_ins"))
    )
    return short.filter(held).select(
        "sample", F.col("a.chrom").alias("chrom"), F.greatest("a.ref_start", "b.ref_start").alias("ref_start"), F.least("a.ref_end", "b.ref_end").alias("ref_end")
    )
