"""The filters of a step as verdicts: no row is dropped, each carries the first rule that it fails.

Verdicts are columns that go along through the joins of the step.  Rows that the cheap rules
fail are set aside before the copy-number joins, from one stored table, so that nothing is read
or joined a second time for the sake of the counts.  ``observed`` takes the counts of all
rules while the kept rows are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import genotype
from ..params import DEFAULTS, Params
from ..session import cut_lineage
from . import copynumber, filters, matching
from .ranges import overlap_join
from .skew import lookup_join

VERDICT, ROWS = "verdict", "n_rows"
KEPT = "kept"
SV_RULES = ("size", "depth", "support", "chrom", "blacklist", "germline", "neutral", "no_state", "subclonal", "outlier", "ceiling")
SNV_RULES = ("repeated", "depth", "chrom", "blacklist", "neutral", "no_state", "subclonal", "outlier", "ceiling")


def _open() -> Column:
    return F.col(VERDICT).isNull()


def fail(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Give rows without a verdict the name of the first rule that does not hold (one that is
    unknown does not)."""
    verdict = F.col(VERDICT)
    for name, passes in rules:
        verdict = F.coalesce(verdict, F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)))
    return df.withColumn(VERDICT, verdict)


def fail_blacklisted(df: DataFrame, intervals: DataFrame, ends: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Rows with an end (chromosome and position column) in an interval closed at both ends.
    Only ends of rows without a verdict are looked up."""
    columns = df.columns
    # A place lies in one merged interval at most, so a row stays one row.
    side = filters.merged(intervals).withColumnsRenamed({"chrom": "_chrom"})
    out, clear = df, F.lit(True)
    for chrom, pos in ends:
        place = F.when(_open(), F.col(pos))
        out, by = overlap_join(
            out.withColumn("_chrom", F.col(chrom)),
            side.withColumn(f"_in_{pos}", F.lit(True)),
            ["_chrom"],
            (place, place + 1),
            (F.col("start_pos"), F.col("end_pos") + 1),
            filters.BLACKLIST_BIN,
            how="left",
            **options,
        )
        out = out.drop("start_pos", "end_pos", *[c for c in by if c not in columns])
        clear &= F.col(f"_in_{pos}").isNull()
    return fail(out, [("blacklist", clear)]).select(*columns)


def fail_germline(df: DataFrame, svs: DataFrame, germline: DataFrame, p: Params = DEFAULTS, **options) -> DataFrame:
    """Rows whose SV is near a germline SV; ``svs`` has the ends of the rows without a verdict,
    ``sv_id`` names an SV in its sample."""
    ends = svs.select("sample", "sv_id", "chr1", "pos1", "chr2", "pos2")
    hits = matching.germline_join(ends, germline, "left_semi", p, **options).select("sample", "sv_id").distinct()
    looked = lookup_join(df, hits.withColumn("_germline", F.lit(True)), ["sample", "sv_id"])
    return fail(looked, [("germline", F.col("_germline").isNull())]).drop("_germline")


def fail_outliers(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows outside the quartile fences of the rows that have no verdict yet."""
    fenced = filters.fenced(df, {n: F.when(_open(), v) for n, v in values.items()})
    return fail(fenced, [("outlier", F.col(filters.INSIDE))]).drop(filters.INSIDE)


def _all_states(df: DataFrame, name: str, test) -> tuple[str, Column]:
    return name, filters.all_ends(df, test)


def fail_states(df: DataFrame, values: dict[str, Column], p: Params = DEFAULTS, sv: bool = True) -> DataFrame:
    """The copy-number rules in the order in which the filters apply them."""
    if p.neutral:
        out = fail(df, [_all_states(df, "neutral", genotype.is_neutral)])
        return fail_outliers(out, values) if p.filter_outliers else out
    out = filters.blank_invalid_cn(df)
    if p.strict_cnv or not sv:
        out = fail(out, [_all_states(out, "no_state", lambda s: s.isNotNull())])
    else:
        out = filters.fill_missing_cn(out)
    clonal = _all_states(out, "subclonal", genotype.is_clonal)
    if p.filter_subclonal_cnvs and sv:
        out = fail(out, [clonal])
    if p.filter_outliers:
        out = fail_outliers(out, values)
    if p.filter_subclonal_cnvs and not sv:
        out = fail(out, [clonal])
    return fail(out, [_all_states(out, "ceiling", lambda s: ~genotype.exceeds(s, p.max_cn))])


def label_svs(
    svs: DataFrame,
    segments: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    germline: DataFrame | None = None,
    p: Params = DEFAULTS,
    **options,
) -> DataFrame:
    """All of the counted SVs (with the parameters of their samples) and the rule that each
    fails, NULL for those that ``filter_svs`` keeps; these have their states."""
    rows = fail(svs.withColumns({VERDICT: F.lit(None).cast("string"), ROWS: F.lit(1).cast("long")}), filters.sv_rules(p))
    if blacklist is not None:
        rows = fail_blacklisted(rows, blacklist, [("chr1", "pos1"), ("chr2", "pos2")], **options)
    if germline is not None:
        rows = cut_lineage(rows)
        rows = fail_germline(rows, rows.filter(_open()), germline, p, **options)
    rows = cut_lineage(rows)
    left = rows.filter(_open())
    if segments is None:
        default = genotype.default_states(F.col("ploidy"))
        left = left.withColumns({"states1": default, "states2": default})
        left = fail_outliers(left, filters.sv_depths()) if p.filter_outliers else left
    else:
        match = copynumber.match_sv_states if p.strict_cnv else copynumber.match_svs
        left = fail_states(match(left, segments, p, **options), filters.sv_depths(), p)
    return left.unionByName(rows.filter(~_open()), allowMissingColumns=True)


def label_snvs(
    snvs: DataFrame, segments: DataFrame | None = None, blacklist: DataFrame | None = None, p: Params = DEFAULTS, **options
) -> DataFrame:
    """One row for each place of the SNVs, ``n_rows`` how often it was listed, and the rule
    that it fails, NULL for those that ``filter_snvs`` keeps."""
    place = ["sample", "chrom", "pos"]
    once = snvs.groupBy(*place).agg(F.count("*").alias(ROWS), *[F.first(c).alias(c) for c in snvs.columns if c not in place])
    rules = [("repeated", F.col(ROWS) == 1), ("depth", F.col("ref") + F.col("var") >= p.min_dep)]
    if p.filter_chroms:
        rules.append(("chrom", F.col("chrom").isin(*p.chroms)))
    rows = fail(once.withColumn(VERDICT, F.lit(None).cast("string")), rules)
    if blacklist is not None:
        rows = fail_blacklisted(rows, blacklist, [("chrom", "pos")], **options)
    rows = cut_lineage(rows)
    left = rows.filter(_open())
    if segments is None:
        left = left.withColumn("states", genotype.default_states(F.col("ploidy")))
        left = fail_outliers(left, filters.snv_depths(True)) if p.filter_outliers else left
    else:
        left = fail_states(copynumber.match_snvs(left, segments, **options), filters.snv_depths(not p.neutral), p, sv=False)
    return left.unionByName(rows.filter(~_open()), allowMissingColumns=True)


def counts(labelled: DataFrame) -> DataFrame:
    """(sample, rule, n): input rows that each rule dropped, and rows kept."""
    rule = F.coalesce(F.col(VERDICT), F.lit(KEPT)).alias("rule")
    return labelled.groupBy("sample", rule).agg(F.sum(ROWS).alias("n"))


def observed(labelled: DataFrame, rules: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The kept rows, and an observation that has the rows of every rule, over all samples,
    once the kept rows have been written."""
    seen = Observation("filters")
    rule = F.coalesce(F.col(VERDICT), F.lit(KEPT))
    sums = [F.coalesce(F.sum(F.when(rule == r, F.col(ROWS))), F.lit(0)).alias(r) for r in (*rules, KEPT)]
    return labelled.observe(seen, *sums).filter(_open()).drop(VERDICT, ROWS), seen
