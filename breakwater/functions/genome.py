"""Chromosome names, breakend order and single-row variant classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_UNKNOWN, CODE_DUP, CODE_DEL = "Unknown", "DUP", "DEL"


def natural_key(col: Column | str) -> Column:
    """Sort key under which runs of digits compare as integers."""
    col = F.col(col) if isinstance(col, str) else col
    runs = F.regexp_extract_all(col, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))


    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        # the number of digits first, so that a run of any length stays whole
        return F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)

    padded = F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), key(run)).otherwise(run))
    return F.concat_ws("", padded)


def strip_chr(col: Column) -> Column:
    return F.regexp_replace(col, "^chr", "")


def text_flag(col: Column) -> Column:
    """Boolean given as text (fixed values: yes, true, t, 1)."""
    return F.lower(col).isin("yes", "true", "t", "1")


def canonical_breakends(df: DataFrame, order: str = "natural") -> DataFrame:
    """Swap the ends of an SV so that (chromosome, position) ascends.  ``order`` is
    ``natural`` or ``string``, the comparison used between unlike chromosomes."""
    key = natural_key if order == "natural" else F.col
    swap = F.when(F.col("chr1") == F.col("chr2"), F.col("pos1") > F.col("pos2")).otherwise(
        key("chr1") > key("chr2")
    )
    swapped = {}
    for field in ("chr", "pos", "dir"):
        if f"{field}1" not in df.columns:
            continue
        one, two = F.col(f"{field}1"), F.col(f"{field}2")
        swapped[f"{field}1"] = F.when(swap, two).otherwise(one)
        swapped[f"{field}2"] = F.when(swap, one).otherwise(two)
    return df.withColumns(swapped)


def sv_class(insertion_distance: int = 15) -> Column:
    """Class of one SV from its two ends; ends need not be in order."""
    same = F.col("chr1") == F.col("chr2")
    ordered = F.col("pos1") <= F.col("pos2")
    lo_dir = F.when(ordered, F.col("dir1")).otherwise(F.col("dir2"))
    hi_dir = F.when(ordered, F.col("dir2")).otherwise(F.col("dir1"))
    apart = F.col("pos1") != F.col("pos2")
    known = F.col("dir1").isin("+", "-") & F.col("dir2").isin("+", "-")
    return (
        F.when(~same, "INTRX")
        .when(known & (F.col("dir1") == F.col("dir2")), "INV")
        .when(known & apart & (lo_dir == "-"), CODE_DUP)
        .when(known & apart & (lo_dir == "+") & (hi_dir == "-"), CODE_DEL)
        .when(known & (F.abs(F.col("pos1") - F.col("pos2")) < insertion_distance), "INS")
        .otherwise(CODE_UNKNOWN)
    )


def normal_copy_number(chrom: Column, male: Column | bool = True) -> Column:
    """Copies of a chromosome in a normal cell."""
    male = F.lit(male) if isinstance(male, bool) else male
    bare = strip_chr(chrom)
    return F.when((bare == "Y") | ((bare == "X") & male), 1.0).otherwise(2.0)
