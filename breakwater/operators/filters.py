"""Row filters on counted SVs and SNVs, and the adjustment of counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype
from ..params import DEFAULTS, SKIP_TAGS, Params
from ..session import cut_lineage
from .ordered import OrderedRows, exact_quantiles
from .ranges import overlap_join
from .skew import BROADCAST_ROWS, lookup_join

BLACKLIST_BIN = 65_536


# ---------------------------------------------------------------- basic filters


def sv_rules(p: Params = DEFAULTS) -> list[tuple[str, Column]]:
    """(name, passes) in the order they are applied.  Rows have read_len and
    insert_mean of their sample."""
    limit = (
        F.lit(p.size_filter)
        if p.size_filter >= 0
        else 2 * F.col("read_len") + F.col("insert_mean")
    )
    rules = [
        (
            "size",
            (F.col("chr1") != F.col("chr2")) | (F.abs(F.col("pos1") - F.col("pos2")) > limit),
        ),
        (
            "depth",
            (F.col("support") + F.col("norm1") >= p.min_dep)
            & (F.col("support") + F.col("norm2") >= p.min_dep),
        ),
        (
            "support",
            (F.col("spanning") >= p.min_span)
            & (F.col("split1") + F.col("split2") >= p.min_split),
        ),
    ]
    if p.filter_chroms:
        rules.append(("chrom", F.col("chr1").isin(*p.chroms) & F.col("chr2").isin(*p.chroms)))
    return rules


def filter_sv_basic(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    keep = F.lit(True)
    for _, passes in sv_rules(p):
        keep &= passes
    return svs.filter(keep)


def filter_audit(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows dropped by each rule, counted at the first rule that fails, and rows kept."""
    verdict = None
    for name, passes in sv_rules(p):
        failed = ~F.coalesce(passes, F.lit(False))
        verdict = F.when(failed, name) if verdict is None else verdict.when(failed, name)
    return (
        svs.select("sample", verdict.otherwise("kept").alias("rule"))
        .groupBy("sample", "rule")
        .agg(F.count("*").alias("n"))
    )


def filter_snv_basic(snvs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Depth and chromosome limits; positions listed more than once drop entirely."""
    place = ["sample", "chrom", "pos"]
    once = snvs.groupBy(*place).agg(
        F.count("*").alias("_n"),
        *[F.first(c).alias(c) for c in snvs.columns if c not in place],
    )
    keep = (F.col("_n") == 1) & (F.col("ref") + F.col("var") >= p.min_dep)
    if p.filter_chroms:
        keep &= F.col("chrom").isin(*p.chroms)
    return once.filter(keep).select(*snvs.columns)


def filter_sv_tags(svs: DataFrame, tags: Column | str = "tags") -> DataFrame:
    """Drop SVs with a tag that takes them out of counting."""
    col = F.col(tags) if isinstance(tags, str) else tags
    skip = F.arrays_overlap(col, F.array(*[F.lit(t) for t in SKIP_TAGS]))
    return svs.filter(~F.coalesce(skip, F.lit(False)))


# ---------------------------------------------------------------- blacklist


def _closed(start: str, end: str) -> tuple[Column, Column]:
    return F.col(start), F.col(end) + 1


def merged(intervals: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """The places of the intervals (chrom, start_pos, end_pos, closed at both ends) as intervals
    that neither overlap nor touch, so that a place meets one at most however deep the given
    ones lie upon each other."""
    whole = intervals.select("chrom", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))
    whole = whole.filter((F.col("start_pos") <= F.col("end_pos")) & F.col("chrom").isNotNull())
    # One row per start, the farthest.
    rows = cut_lineage(whole.groupBy("chrom", "start_pos").agg(F.max("end_pos").alias("end_pos")))
    if rows.count() <= few:
        along = Window.partitionBy("chrom").orderBy("start_pos")
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_reach", F.max("end_pos").over(earlier))
        rows = rows.withColumn("_opens", _opens())
        rows = rows.withColumn("_run", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ordered = OrderedRows(rows, ["chrom"], ["start_pos"]).scan(maxima_before={"_reach": F.col("end_pos")})
        rows = ordered.add(_opens=_opens()).scan(sums={"_run": F.col("_opens")}).rows()
    runs = rows.groupBy("chrom", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return cut_lineage(runs.drop("_run"))


def _opens() -> Column:
    """1 where an interval does not touch any that start before it."""
    return F.when(F.col("_reach") + 1 >= F.col("start_pos"), 0).otherwise(1)


def blacklist_hits(
    places: DataFrame, intervals: DataFrame, how: str, **options
) -> DataFrame:
    """``places`` (chrom, pos, ...) that do (left_semi) or do not (left_anti) lie in an
    interval closed at both ends; of ``merged`` intervals a place looks at few."""
    joined, partitioning = overlap_join(
        places,
        intervals.select("chrom", "start_pos", "end_pos"),
        ["chrom"],
        (F.col("pos"), F.col("pos") + 1),
        _closed("start_pos", "end_pos"),
        BLACKLIST_BIN,
        how=how,
        **options,
    )
    return joined.drop(*[c for c in partitioning if c not in places.columns])


def drop_blacklisted_snvs(snvs: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    return blacklist_hits(snvs, merged(intervals), "left_anti", **options)


def drop_blacklisted_svs(svs: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """Drop SVs with either end in an interval: one anti-join for each end."""
    kept, intervals = svs, merged(intervals)
    for end in ("1", "2"):
        names = {f"chr{end}": "chrom", f"pos{end}": "pos"}
        placed = blacklist_hits(kept.withColumnsRenamed(names), intervals, "left_anti", **options)
        kept = placed.withColumnsRenamed({v: k for k, v in names.items()})
    return kept.select(*svs.columns)


# ---------------------------------------------------------------- outliers


INSIDE = "_inside"


def fenced(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Rows with ``_inside``: whether their values all lie strictly inside the quartile fences
    of their sample; the quartile distance counts as one at least, and NULLs count nowhere."""
    # The rows are needed for the quartiles and again for the fences.
    kept = cut_lineage(df.withColumns({f"_v_{n}": c.cast("double") for n, c in values.items()}))
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_v_{n}").alias("v")) for n in values])
    )
    long = kept.select(*keys, each.alias("_e")).select(*keys, "_e.name", "_e.v")
    q = exact_quantiles(long, [*keys, "name"], F.col("v"), {"_q1": 0.25, "_q3": 0.75})
    reach = 1.5 * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1.0))
    low, high = F.col("_q1") - reach, F.col("_q3") + reach
    fences = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, low)).alias(f"_lo_{n}") for n in values],
        *[F.max(F.when(F.col("name") == n, high)).alias(f"_hi_{n}") for n in values],
    )
    inside = F.lit(True)
    for name in values:
        value = F.col(f"_v_{name}")
        inside &= (value > F.col(f"_lo_{name}")) & (value < F.col(f"_hi_{name}"))
    return lookup_join(kept, fences, keys).select(*df.columns, F.coalesce(inside, F.lit(False)).alias(INSIDE))


def inside_fences(
    df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("sample",)
) -> DataFrame:
    """The rows that ``fenced`` finds inside."""
    return fenced(df, values, keys).filter(INSIDE).drop(INSIDE)


def per_copy(value: Column, states: Column) -> Column:
    """Value divided by copies over two, where that is not zero."""
    ratio = genotype.weighted_ratio(states)
    return F.when(ratio == 0, value).otherwise(value / ratio)


def sv_depths() -> dict[str, Column]:
    return {e: per_copy(F.col(f"win_norm{e}"), F.col(f"states{e}")) for e in ("1", "2")}


def snv_depths(by_copies: bool = True) -> dict[str, Column]:
    depth = F.col("ref") + F.col("var")
    return {"depth": per_copy(depth, F.col("states")) if by_copies else depth}


def filter_sv_outliers(svs: DataFrame) -> DataFrame:
    return inside_fences(svs, sv_depths())


def filter_snv_outliers(snvs: DataFrame, by_copies: bool = True) -> DataFrame:
    return inside_fences(snvs, snv_depths(by_copies))


# ---------------------------------------------------------------- copy-number filters


def all_ends(df: DataFrame, test: Callable[[Column], Column]) -> Column:
    """The test on every state column the rows have (one for SNVs, two for SVs)."""
    out = F.lit(True)
    for name in ("states", "states1", "states2"):
        if name in df.columns:
            out &= test(F.col(name))
    return out


def filter_cn_neutral(df: DataFrame) -> DataFrame:
    return df.filter(all_ends(df, genotype.is_neutral))


def filter_cn_subclonal(df: DataFrame) -> DataFrame:
    return df.filter(all_ends(df, genotype.is_clonal))


def filter_cn_ceiling(df: DataFrame, max_cn: int = DEFAULTS.max_cn) -> DataFrame:
    return df.filter(all_ends(df, lambda s: ~genotype.exceeds(s, max_cn)))


def filter_cn_known(df: DataFrame) -> DataFrame:
    return df.filter(all_ends(df, lambda s: s.isNotNull()))


def blank_invalid_cn(df: DataFrame) -> DataFrame:
    names = [n for n in ("states", "states1", "states2") if n in df.columns]
    return df.withColumns({n: genotype.blank_invalid(F.col(n)) for n in names})


def fill_missing_cn(df: DataFrame) -> DataFrame:
    """Half of the sample's ploidy for each allele where no state is known."""
    default = genotype.default_states(F.col("ploidy"))
    names = [n for n in ("states", "states1", "states2") if n in df.columns]
    return df.withColumns({n: F.coalesce(F.col(n), default) for n in names})


def cn_filters_sv(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Copy-number filters in their order; the outlier fences depend on what the
    filters before them leave."""
    if p.neutral:
        out = filter_cn_neutral(svs)
        return filter_sv_outliers(out) if p.filter_outliers else out
    out = blank_invalid_cn(svs)
    out = filter_cn_known(out) if p.strict_cnv else fill_missing_cn(out)
    if p.filter_subclonal_cnvs:
        out = filter_cn_subclonal(out)
    if p.filter_outliers:
        out = filter_sv_outliers(out)
    return filter_cn_ceiling(out, p.max_cn)


def cn_filters_snv(snvs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    if p.neutral:
        out = filter_cn_neutral(snvs)
        return filter_snv_outliers(out, by_copies=False) if p.filter_outliers else out
    out = filter_cn_known(blank_invalid_cn(snvs))
    if p.filter_outliers:
        out = filter_snv_outliers(out)
    if p.filter_subclonal_cnvs:
        out = filter_cn_subclonal(out)
    return filter_cn_ceiling(out, p.max_cn)


# ---------------------------------------------------------------- adjusted counts


def adjust_counts(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Normal counts of DNA gains scaled for the extra copies, support scaled for reads
    lost in alignment, and the fractions that follow.  Rows have purity and ploidy."""
    gain = F.col("classification").isin(*p.gain_classes)
    share = 1 - F.col("purity") / F.col("ploidy")
    raw = (F.col("split1") + F.col("split2") + F.col("spanning")).cast("double")
    out = svs.withColumns(
        {
            f"adjusted_norm{e}": F.when(gain, F.col(f"norm{e}") * share)
            .otherwise(F.col(f"norm{e}"))
            .cast("double")
            for e in ("1", "2")
        }
    )
    factor = 1 + F.lit(p.support_adjust_factor) * F.col("purity")
    out = out.withColumns(
        {
            "raw_norm_mean": (F.col("norm1") + F.col("norm2")) / 2,
            "adjusted_norm_mean": (F.col("adjusted_norm1") + F.col("adjusted_norm2")) / 2,
            "adjusted_support": F.bround(raw * factor).cast("long"),
        }
    )
    total = {e: F.col(f"adjusted_norm{e}") + F.col("adjusted_support") for e in ("1", "2")}
    ratio = F.try_divide
    return out.withColumns(
        {
            "adjusted_depth1": F.bround(total["1"]).cast("long"),
            "adjusted_depth2": F.bround(total["2"]).cast("long"),
            "raw_mean_vaf": ratio(raw, raw + F.col("raw_norm_mean")),
            "adjusted_vaf1": ratio(F.col("adjusted_support"), total["1"]),
            "adjusted_vaf2": ratio(F.col("adjusted_support"), total["2"]),
            "adjusted_mean_vaf": ratio(
                raw, F.col("adjusted_norm_mean") + F.col("adjusted_support")
            ),
        }
    )
