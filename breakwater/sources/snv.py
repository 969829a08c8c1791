"""Point-mutation formats: (sample, chrom, pos, ref, var)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vcf
from .text import emit, number

BASES = ("A", "C", "G", "T")


def _row(ref: Column, var: Column, sample: Column | None = None) -> Column:
    return F.struct(
        (F.col("sample") if sample is None else sample).alias("sample"),
        F.col("chrom").alias("chrom"),
        F.col("pos").alias("pos"),
        ref.try_cast("double").alias("ref"),
        var.try_cast("double").alias("var"),
    )


def _has_variant(row: Column) -> Column:
    return row["var"] != 0


def callstats(table: DataFrame) -> DataFrame:
    """Call-statistics table; rows judged KEEP."""
    return table.filter(F.col("judgement") == "KEEP").select(
        "sample",
        F.col("contig").cast("string").alias("chrom"),
        number("position", "bigint").alias("pos"),
        number("t_ref_sum").alias("ref"),
        number("t_alt_sum").alias("var"),
    )


def mutect_vcf(lines: DataFrame) -> DataFrame:
    """Allelic depths of the row's sample, or of the first sample of the file where the
    name is not in it.  Rows with variant reads in a sample named ``normal`` drop."""
    recs = vcf.with_sample_names(lines).filter(vcf.passes())
    own = F.coalesce(vcf.call_of(F.col("sample")), F.get(F.col("calls"), 0))
    recs = recs.withColumns(
        {"_values": F.split(own, ":"), "_normal": F.split(vcf.call_of("normal"), ":")}
    )
    recs = recs.withColumns(
        {
            "_depths": F.split(vcf.field(F.col("_values"), "AD"), ","),
            "_germ": F.get(F.split(vcf.field(F.col("_normal"), "AD"), ","), 1).try_cast("double"),
        }
    )
    row = F.struct(
        _row(F.get("_depths", 0), F.get("_depths", 1)).alias("r"), F.col("_germ").alias("germ")
    )
    kept = emit(
        recs, row, lambda x: _has_variant(x["r"]) & ~F.coalesce(x["germ"] > 0, F.lit(False))
    )
    return kept.select("r.*")


def base_counts_vcf(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """Counts per base (``BCOUNT`` in the order A, C, G, T) for one sample, or a row
    for every sample of the file."""
    recs = vcf.with_sample_names(lines).filter(vcf.passes())
    if sample is None:
        each = F.explode(F.arrays_zip("names", "calls"))
        recs = recs.withColumn("_each", each)
        name, call = F.col("_each.names"), F.col("_each.calls")
    else:
        absent = F.raise_error(F.concat(F.lit(f"sample {sample} is not in "), F.col("path")))
        call = F.when(F.array_contains("names", sample), vcf.call_of(F.lit(sample))).otherwise(
            absent.cast("string")
        )
        name = F.lit(sample)
    recs = recs.withColumn("_values", F.split(call, ":"))
    recs = recs.withColumn("_bases", F.split(vcf.field(F.col("_values"), "BCOUNT"), ","))

    def of(base: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(b) for b in BASES]), base)
        return F.when(place > 0, F.get("_bases", (place - 1).cast("int")))

    first_alt = F.get(F.split("alt", ","), 0)
    return emit(recs, _row(of(F.col("ref_base")), of(first_alt), name), _has_variant)


def consensus_vcf(lines: DataFrame) -> DataFrame:
    """Tumour counts in INFO; rows lacking either drop."""
    row = _row(vcf.info("t_ref_count"), vcf.info("t_alt_count"))
    return emit(vcf.records(lines), row, lambda r: _has_variant(r) & r["ref"].isNotNull())


def strand_counts_vcf(lines: DataFrame) -> DataFrame:
    """Per-strand base counts of a NORMAL and a TUMOUR sample.

    The genotype pair comes from INFO ``TG`` or else ``SG`` (normal/tumour), or from an
    INFO key with a slash in it (tumour/normal).  The normal must be homozygous; its base
    is the reference and a base that only the tumour has is the variant."""
    recs = vcf.with_sample_names(lines).filter(vcf.passes())
    first, second = F.lower(F.get("names", 0)), F.lower(F.get("names", 1))
    fits = (first == "normal") & second.isin("tumour", "tumor")
    tumour = F.when(F.coalesce(fits, F.lit(False)), F.get("calls", 1)).otherwise(
        F.raise_error(
            F.concat(F.lit("NORMAL and TUMOUR samples expected in "), F.col("path"))
        ).cast("string")
    )
    # A key with a slash is two genotypes; one with equal sides tells nothing.
    slash_key = F.regexp_extract(
        "info", r"(?:^|;)((?:(\w+)/(?!\2(?:[=;]|$))\w+))(?:=|;|$)", 1
    )
    recs = recs.withColumns(
        {
            "_values": F.split(tumour, ":"),
            "_tg": vcf.info("TG"),
            "_sg": vcf.info("SG"),
            "_key": F.nullif(slash_key, F.lit("")),
        }
    )
    listed = F.col("_tg").isNotNull() & F.col("_sg").isNotNull()

    def pair(text: Column, normal: int) -> Column:
        sides = F.split(text, "/")
        return F.struct(
            F.get(sides, normal).alias("normal"), F.get(sides, 1 - normal).alias("tumour")
        )

    candidates = F.when(listed, F.array(pair(F.col("_tg"), 0), pair(F.col("_sg"), 0))).when(
        F.col("_key").isNotNull(), F.array(pair(F.col("_key"), 1))
    )

    def resolved(p: Column) -> Column:
        ref = F.substring(p["normal"], 1, 1)
        new = F.array_sort(F.array_except(F.split(p["tumour"], ""), F.array(ref, F.lit(""))))
        homozygous = ref == F.substring(p["normal"], 2, 1)
        return F.struct(ref.alias("ref"), F.when(homozygous, F.get(new, 0)).alias("var"))

    recs = recs.withColumn("_tried", F.transform(candidates, resolved))
    usable = F.get(F.filter("_tried", lambda p: p["var"].isNotNull()), 0)
    by_base = F.create_map(
        *[
            x
            for b in BASES
            for x in (
                F.lit(b),
                vcf.field(F.col("_values"), f"F{b}Z").try_cast("double")
                + vcf.field(F.col("_values"), f"R{b}Z").try_cast("double"),
            )
        ]
    )
    recs = recs.withColumns({"_pair": usable, "_counts": by_base})
    row = _row(F.col("_counts")[F.col("_pair.ref")], F.col("_counts")[F.col("_pair.var")])
    return emit(recs, row, _has_variant)
