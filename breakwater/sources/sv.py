"""Structural-variant call formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vcf
from ..functions.genome import canonical_breakends, strip_chr
from .text import number, row_id


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _direction(col: Column) -> Column:
    """Only + and - are known directions."""
    text = F.trim(col)
    return F.when(text.isin("+", "-"), text)


def sv_simple(
    table: DataFrame, use_dir: bool = False, class_field: str | None = None
) -> DataFrame:
    """Plain SV table: chr1, pos1, chr2, pos2 and optionally dir1, dir2, ID and a class.
    ``table`` also has ``sample`` and ``ordinal``."""
    unknown = F.lit(None).cast("string")
    svs = table.select(
        "sample",
        row_id(table).alias("sv_id"),
        "ordinal",
        F.col("chr1").cast("string").alias("chr1"),
        number("pos1", "bigint").alias("pos1"),
        (_direction(_optional(table, "dir1")) if use_dir else unknown).alias("dir1"),
        F.col("chr2").cast("string").alias("chr2"),
        number("pos2", "bigint").alias("pos2"),
        (_direction(_optional(table, "dir2")) if use_dir else unknown).alias("dir2"),
        (F.col(class_field) if class_field else unknown).alias("classification"),
        _optional(table, "ID").alias("original_id"),
    )
    svs = svs.withColumns({"original_pos1": F.col("pos1"), "original_pos2": F.col("pos2")})
    return canonical_breakends(svs, "string")


def sv_caller_table(
    table: DataFrame,
    use_dir: bool = True,
    min_mapq: float = 20,
    repeats: Sequence[str] = ("Satellite", "Simple_repeat"),
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Anchor / realignment table of a caller: positions as chrom:pos, mapping quality
    and repeat class for each end.  ``columns`` renames the expected names."""
    name = {
        "pos1": "C1_anchor",
        "dir1": "C1_anchor_dir",
        "pos2": "C1_realign",
        "dir2": "C1_realign_dir",
        "mapq1": "C1_avg_realign_mapq",
        "mapq2": "C2_avg_realign_mapq",
        "repeat1": "repeat1",
        "repeat2": "repeat2",
    } | (columns or {})
    missing = [c for c in name.values() if c not in table.columns]
    if missing:
        raise ValueError(f"columns not in the caller table: {missing}")
    keep = (number(name["mapq1"]) >= min_mapq) & (number(name["mapq2"]) >= min_mapq)
    if "normal" in table.columns:
        keep &= ~F.coalesce(F.col("normal") == "normal", F.lit(False))
    listed = [r.strip() for r in repeats if r.strip()]
    if listed:
        both = F.col(name["repeat1"]).isin(*listed) & F.col(name["repeat2"]).isin(*listed)
        keep &= ~F.coalesce(both, F.lit(False))
    unknown = F.lit(None).cast("string")

    def end(which: str) -> tuple[Column, Column]:
        part = F.split(F.col(name[which]), ":")
        return F.get(part, 0), F.get(part, 1).try_cast("long")

    (chr1, pos1), (chr2, pos2) = end("pos1"), end("pos2")
    svs = table.filter(keep).select(
        "sample",
        row_id(table).alias("sv_id"),
        "ordinal",
        chr1.alias("chr1"),
        pos1.alias("pos1"),
        (_direction(F.col(name["dir1"])) if use_dir else unknown).alias("dir1"),
        chr2.alias("chr2"),
        pos2.alias("pos2"),
        (_direction(F.col(name["dir2"])) if use_dir else unknown).alias("dir2"),
    )
    svs = svs.withColumns({"original_pos1": F.col("pos1"), "original_pos2": F.col("pos2")})
    return canonical_breakends(svs, "string")


def sv_vcf(lines: DataFrame, use_dir: bool = True, class_field: str | None = None) -> DataFrame:
    """Breakend records paired with their mates, one row per pair.

    ``lines`` has ``sample``, ``path``, ``ordinal`` and ``line``.  The record that comes
    first in its file gives end 1."""
    named_mate = F.coalesce(vcf.info("PARID"), vcf.info("MATEID"))
    alt = F.col("alt")
    direction = F.when(alt.rlike(r"[\[\]]$"), "+").when(alt.rlike(r"^[\[\]]"), "-")
    ends = (
        vcf.records(lines)
        .filter(vcf.passes())
        .select(
            "sample",
            "path",
            row_id(lines).alias("sv_id"),
            "ordinal",
            "id",
            F.get(F.split(named_mate, ","), 0).alias("mate"),
            "chrom",
            "pos",
            (direction if use_dir else F.lit(None).cast("string")).alias("dir"),
            (vcf.info(class_field) if class_field else F.lit(None).cast("string")).alias("cls"),
        )
    )
    a, b = ends.alias("a"), ends.alias("b")
    mutual = F.col("b.mate").eqNullSafe(F.col("a.id"))
    pairs = a.join(
        b, (F.col("a.path") == F.col("b.path")) & (F.col("a.mate") == F.col("b.id"))
    ).filter(~mutual | (F.col("a.ordinal") < F.col("b.ordinal")))
    return pairs.select(
        F.col("a.sample").alias("sample"),
        F.col("a.sv_id").alias("sv_id"),
        F.col("a.ordinal").alias("ordinal"),
        F.col("a.chrom").alias("chr1"),
        F.col("a.pos").alias("pos1"),
        F.col("a.dir").alias("dir1"),
        F.col("b.chrom").alias("chr2"),
        F.col("b.pos").alias("pos2"),
        F.col("b.dir").alias("dir2"),
        F.col("a.cls").alias("classification"),
        F.col("a.id").alias("original_id"),
        F.col("a.pos").alias("original_pos1"),
        F.col("b.pos").alias("original_pos2"),
    )


def sv_counts_table(table: DataFrame) -> DataFrame:
    """Counts written earlier, typed, with the mean of the two normal counts."""
    text = {"sample", "chr1", "dir1", "chr2", "dir2", "classification", "original_ID", "path"}
    fractions = {"vaf1", "vaf2"}
    typed = {
        c: number(c, "double" if c in fractions else "bigint")
        for c in table.columns
        if c not in text and c != "ordinal"
    }
    return with_norm_mean(table.withColumns(typed))


def with_norm_mean(svs: DataFrame) -> DataFrame:
    return svs.withColumn("raw_norm_mean", (F.col("norm1") + F.col("norm2")) / 2)


def blacklist_bed(table: DataFrame) -> DataFrame:
    """Intervals closed at both ends; rows whose bounds are no integers drop."""
    names = [c for c in table.columns if c not in ("path", "ordinal", "sample")][:3]
    chrom, start, end = names
    return table.select(
        strip_chr(F.col(chrom)).alias("chrom"),
        number(start, "bigint").alias("start_pos"),
        number(end, "bigint").alias("end_pos"),
    ).filter(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
