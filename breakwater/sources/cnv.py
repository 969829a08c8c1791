"""Copy-number segment formats: (sample, chr, ordinal, startpos, endpos, states)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype
from ..operators.skew import lookup_join
from ..session import cut_lineage
from .text import lines_to_table, number

# Column names of the headerless csv format (fixed values).
CSV_NAMES = (
    "id",
    "chr",
    "startpos",
    "endpos",
    "norm_total",
    "norm_minor",
    "tumour_total",
    "tumour_minor",
)


def _segments(df: DataFrame, chrom: str, start: str, end: str, states: Column) -> DataFrame:
    return df.select(
        "sample",
        F.col(chrom).cast("string").alias("chr"),
        "ordinal",
        number(start, "bigint").alias("startpos"),
        number(end, "bigint").alias("endpos"),
        states.alias("states"),
    )


def battenberg(df: DataFrame, prefix: str = "", start: str = "startpos", end: str = "endpos") -> DataFrame:
    """Two allelic states with fractions; the second counts where the first is not
    in all cells."""

    def at(name: str) -> Column:
        return number(f"{prefix}{name}_A")

    first = genotype.state(at("nMaj1"), at("nMin1"), at("frac1"))
    second = genotype.state(at("nMaj2"), at("nMin2"), at("frac2"))
    states = F.when(at("frac1") != 1, F.array(first, second)).otherwise(F.array(first))
    return _segments(df.filter(at("nMaj1").isNotNull()), "chr", start, end, states)


def consensus(df: DataFrame) -> DataFrame:
    """Major and minor calls, with a clonal frequency or taken as clonal."""
    frac = number("clonal_frequency") if "clonal_frequency" in df.columns else F.lit(1.0)
    states = F.array(genotype.state(number("major_cn"), number("minor_cn"), frac))
    return _segments(
        df.filter(number("major_cn").isNotNull()), "chromosome", "start", "end", states
    )


def titan(df: DataFrame) -> DataFrame:
    """Prevalence calls.  Without a major copy number the total stands for it, and the
    cells left over have one copy rather than 1 + 1."""
    share = F.coalesce(number("Cellular_Prevalence"), F.lit(1.0))
    single = number("Corrected_MajorCN").isNull()
    major = F.when(single, number("Corrected_Copy_Number")).otherwise(number("Corrected_MajorCN"))
    minor = F.when(single, 0.0).otherwise(number("Corrected_MinorCN"))
    other = genotype.state(F.lit(1.0), F.when(single, 0.0).otherwise(1.0), 1 - share)
    first = genotype.state(major, minor, share)
    states = F.when(share != 1, F.array(first, other)).otherwise(F.array(first))
    return _segments(df, "Chromosome", "Start", "End", states)


def ascat(df: DataFrame) -> DataFrame:
    """Total and minor copies of the tumour, clonal."""
    total, minor = number("tumour_total"), number("tumour_minor")
    states = F.array(genotype.state(total - minor, minor, F.lit(1.0)))
    return _segments(df.filter(total.isNotNull()), "chr", "startpos", "endpos", states)


def segments(df: DataFrame) -> DataFrame:
    """Read any of the formats, told apart by a column only it has.  A table without columns
    (an empty file) gives no segments; whole lines (``line``, from ``read_lines``) are those of
    the headerless csv format."""
    names = set(df.columns) - {"sample", "path", "ordinal"}
    if not names:
        unknown = F.lit(None).cast("string")
        nothing = df.withColumns({c: unknown for c in CSV_NAMES})
        return ascat(nothing).filter(F.lit(False))
    if names == {"line"}:
        return ascat(lines_to_table(df, CSV_NAMES, ","))
    if "nMaj1_A" in names:
        return battenberg(df)
    if "battenberg_nMaj1_A" in names:
        return battenberg(df, "battenberg_", "start", "end")
    if "clonal_frequency" in names or "star" in names:
        return consensus(df)
    if "TITAN_call" in names:
        return titan(df)
    if "tumour_total" in names:
        return ascat(df)
    raise ValueError(f"copy-number columns not recognised: {sorted(names)}")


# Columns of each format with a header; the first named tells it apart (fixed values).
_ALLELIC = tuple(f"{n}_A" for n in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2"))
HEADERED = {
    "battenberg": (*_ALLELIC, "chr", "startpos", "endpos"),
    "prefixed": (*(f"battenberg_{n}" for n in _ALLELIC), "chr", "start", "end"),
    "frequency": ("clonal_frequency", "chromosome", "start", "end", "major_cn", "minor_cn"),
    "star": ("star", "chromosome", "start", "end", "major_cn", "minor_cn"),
    "titan": (
        "TITAN_call",
        "Chromosome",
        "Start",
        "End",
        "Corrected_Copy_Number",
        "Corrected_MajorCN",
        "Corrected_MinorCN",
        "Cellular_Prevalence",
    ),
    "ascat": ("tumour_total", "tumour_minor", "chr", "startpos", "endpos"),
}


def mixed_segments(lines: DataFrame) -> DataFrame:
    """Segments of many files at once (path, sample, ordinal, line), each in a format of its own.

    The first line of a file says which: a line with tabs is a header, and columns are found by
    it wherever they stand; without tabs the file is of the headerless csv format.  An empty
    file has no lines and no segments, empty lines are passed over, and a header that no format
    has raises.  Headers are one row per file; every format reads its own rows of one table."""
    lines = lines.select("path", "sample", "ordinal", "line").filter(F.trim("line") != "")
    heads = lines.groupBy("path").agg(
        F.min_by("line", "ordinal").alias("_head"), F.min("ordinal").alias("_at")
    )
    names = F.transform(F.split("_head", "\t"), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    heads = heads.withColumn("_names", names)
    kind = F.when(F.size("_names") == 1, "csv")
    for name, columns in HEADERED.items():
        kind = kind.when(F.array_contains("_names", columns[0]), name)
    unknown = F.raise_error(F.concat(F.lit("copy-number columns not recognised in "), F.col("path")))
    heads = heads.select("path", "_at", "_names", kind.otherwise(unknown).alias("_kind"))
    rows = lookup_join(lines, heads, ["path"])
    rows = cut_lineage(rows.filter((F.col("_kind") == "csv") | (F.col("ordinal") != F.col("_at"))))

    cells = F.split("line", "\t", -1)
    out = ascat(lines_to_table(rows.filter(F.col("_kind") == "csv").select("sample", "ordinal", "line"), CSV_NAMES, ","))
    for name, columns in HEADERED.items():
        found = {c: F.get(cells, F.array_position("_names", c).cast("int") - 1) for c in columns}
        table = rows.filter(F.col("_kind") == name).select(
            "sample", "ordinal", *[F.regexp_replace(v, '"', "").alias(c) for c, v in found.items()]
        )
        out = out.unionByName(segments(table))
    return out
