"""Alignments, from tables or from SAM text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import FIELDS
from .text import emit

# SAM flag bits (fixed values).
FLAG_PAIRED, FLAG_PROPER, FLAG_UNMAPPED, FLAG_REVERSE = 0x1, 0x2, 0x4, 0x10


def reads_table(df: DataFrame) -> DataFrame:
    """The read fields; rows without coordinates drop."""
    present = F.lit(True)
    for name in FIELDS:
        present &= F.col(name).isNotNull()
    extra = [c for c in ("ordinal", "is_proper_pair", "is_paired", "is_mapped") if c in df.columns]
    return df.filter(present).select("sample", *FIELDS, *extra)


def _cigar_sum(cigar: Column, ops: str) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))


def _end_clip(cigar: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(cigar, pattern, 1).try_cast("long"), F.lit(0).cast("long"))


def _plain(cigar: Column) -> dict[str, Column]:
    """Clips and match of a CIGAR that is one match, clipped or not, without a regular
    expression; ``_match`` is NULL for any other."""
    ops = F.translate(cigar, "0123456789", "")
    shaped = ops.isin("M", "SM", "MS", "SMS") & F.right(cigar, F.lit(1)).isin("M", "S")
    left = F.when(ops.startswith("S"), F.substring_index(cigar, "S", 1)).otherwise("0").try_cast("long")
    right = F.when(ops.endswith("S"), F.substring_index(F.substring_index(cigar, "M", -1), "S", 1)).otherwise("0").try_cast("long")
    match = F.substring_index(F.substring_index(cigar, "M", 1), "S", -1).try_cast("long")
    whole = shaped & left.isNotNull() & right.isNotNull()
    return {"_match": F.when(whole, match), "_left": left, "_right": right}


def sam_lines(lines: DataFrame) -> DataFrame:
    """SAM text to reads: 0-based half-open reference span, and the aligned part of the
    read between its soft clips."""
    rest = [c for c in lines.columns if c != "line"]
    part, cigar, flag, start = F.col("_part"), F.col("_cigar"), F.col("_flag"), F.col("_start")
    match = F.col("_match")
    split = lines.filter(~F.col("line").startswith("@")).select(
        *rest, F.split("line", "\t", 10).alias("_part")
    )

    def parsed(plain: Column, other: Column) -> Column:
        return F.when(match.isNotNull(), plain).otherwise(other)

    # All columns are made here: what stands inside ``emit`` is not compiled.
    fields = (
        split.withColumns(
            {
                "_name": F.get(part, 0),
                "_chrom": F.nullif(F.get(part, 2), F.lit("*")),
                "_cigar": F.get(part, 5),
                "_flag": F.get(part, 1).try_cast("int"),
                "_start": F.get(part, 3).try_cast("long") - 1,
                "_ins": F.get(part, 8).try_cast("long"),
            }
        )
        .withColumns(_plain(cigar))
        .withColumns(
            {
                "_len": parsed(F.col("_left") + match + F.col("_right"), _cigar_sum(cigar, "MIS=X")),
                "_end": F.when(cigar != "*", start + parsed(match, _cigar_sum(cigar, "MDN=X"))),
                "_from": parsed(F.col("_left"), _end_clip(cigar, r"^(?:[0-9]+H)?([0-9]+)S")),
                "_cut": parsed(F.col("_right"), _end_clip(cigar, r"[0-9]+[^0-9H]([0-9]+)S(?:[0-9]+H)?$")),
            }
        )
    )
    row = F.struct(
        *rest,
        F.col("_name").alias("query_name"),
        F.col("_chrom").alias("chrom"),
        start.alias("ref_start"),
        F.col("_end").alias("ref_end"),
        F.col("_from").alias("align_start"),
        (F.col("_len") - F.col("_cut")).alias("align_end"),
        F.col("_len").alias("len"),
        F.col("_ins").alias("ins_len"),
        (flag.bitwiseAND(FLAG_REVERSE) != 0).alias("is_reverse"),
        (flag.bitwiseAND(FLAG_PROPER) != 0).alias("is_proper_pair"),
        (flag.bitwiseAND(FLAG_PAIRED) != 0).alias("is_paired"),
        (flag.bitwiseAND(FLAG_UNMAPPED) == 0).alias("is_mapped"),
    )
    placed = emit(
        fields,
        row,
        lambda r: r["chrom"].isNotNull() & r["ref_start"].isNotNull() & r["ref_end"].isNotNull(),
    )
    return placed.select(
        "sample", *FIELDS, *[c for c in placed.columns if c not in ("sample", *FIELDS)]
    )
