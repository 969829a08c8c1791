"""The steps of an analysis, from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype
from ..operators import annotate, clustering, copynumber, counting, filters, matching, mixed
from ..operators.skew import lookup_join
from ..params import DEFAULTS, PARAM_DEFAULTS, Params
from ..session import cut_lineage
from ..sources import versioned


def annotate_svs(
    svs: DataFrame,
    reads: DataFrame,
    limits: DataFrame,
    blacklist: DataFrame | None = None,
    use_dir: bool = True,
    trust_position: bool = False,
    p: Params = DEFAULTS,
    **options,
) -> DataFrame:
    """SVs with directions, positions, classes and event ids.

    Without ``use_dir`` directions are inferred from reads and mixed evidence is
    resolved; otherwise positions move to the split-read consensus, unless trusted."""
    if "tags" not in svs.columns:
        svs = svs.withColumn("tags", F.array().cast("array<string>"))
    if blacklist is not None:
        svs = annotate.tag_blacklisted(svs, blacklist, **options)
    listed = F.array_contains("tags", "BLACKLIST")
    open_svs, shut = svs.filter(~listed), svs.filter(listed)
    if not use_dir:
        inferred = annotate.infer_directions(open_svs, reads, limits, p, **options)
        resolved = mixed.resolve_mixed(inferred, p).drop("ca_right1", "ca_left1", "ca_right2", "ca_left2")
        svs = resolved.unionByName(shut.withColumn("part", F.lit(0)))
        # Records made from one SV get ids of their own.
        svs = svs.withColumn("sv_id", F.col("sv_id") * 2 + F.col("part")).drop("part")
    elif not trust_position:
        svs = annotate.recalibrate(open_svs, reads, limits, p, **options).unionByName(shut)
    return annotate.dedupe(annotate.classify(svs, p, **options))


def count_svs(
    svs: DataFrame, reads: DataFrame, limits: DataFrame, p: Params = DEFAULTS, **options
) -> DataFrame:
    """Counts of the SVs whose tags allow it."""
    return counting.sv_counts(filters.filter_sv_tags(svs), reads, limits, p, **options)


def with_params(variants: DataFrame, params: DataFrame) -> DataFrame:
    """Variants with the parameters of their sample; where the sample or a value is absent,
    the documented default."""
    joined = lookup_join(variants, params, ["sample"])
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in PARAM_DEFAULTS.items() if c in params.columns}
    return joined.withColumns(filled)


def filter_svs(
    svs: DataFrame,
    params: DataFrame,
    segments: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    germline: DataFrame | None = None,
    p: Params = DEFAULTS,
    adjacent: bool = True,
    **options,
) -> DataFrame:
    """Counted SVs that pass all filters, with states and adjusted counts.  Cheap row
    filters come before the joins; without ``adjacent`` only the matched states are
    looked up."""
    kept = filters.filter_sv_basic(with_params(svs, params), p)
    if blacklist is not None:
        kept = filters.drop_blacklisted_svs(kept, blacklist, **options)
    if germline is not None:
        kept = matching.drop_germline(kept, germline, p, **options)
    if segments is None:
        default = genotype.default_states(F.col("ploidy"))
        kept = kept.withColumns({"states1": default, "states2": default})
        if p.filter_outliers:
            kept = filters.filter_sv_outliers(kept)
    else:
        # A lenient match needs the nearest segment where none is hit.
        if adjacent or not p.strict_cnv:
            kept = copynumber.match_svs(kept, segments, p, **options)
        else:
            kept = copynumber.match_sv_states(kept, segments, p, **options)
        kept = filters.cn_filters_sv(kept, p)
    return filters.adjust_counts(kept, p)


def filter_snvs(
    snvs: DataFrame,
    params: DataFrame,
    segments: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    p: Params = DEFAULTS,
    **options,
) -> DataFrame:
    """SNVs that pass all filters, with states."""
    kept = filters.filter_snv_basic(snvs, p)
    if blacklist is not None:
        kept = filters.drop_blacklisted_snvs(kept, blacklist, **options)
    kept = with_params(kept, params.select("sample", "purity", "ploidy"))
    if segments is None:
        kept = kept.withColumn("states", genotype.default_states(F.col("ploidy")))
        return filters.filter_snv_outliers(kept) if p.filter_outliers else kept
    return filters.cn_filters_snv(copynumber.match_snvs(kept, segments, **options), p)


def check_chromosomes(svs: DataFrame, segments: DataFrame) -> None:
    """Raise if no SV lies on a chromosome that the segments name, as when one of the two
    writes ``chr1`` and the other ``1``; every state would be NULL without a word."""
    named = svs.select(F.explode(F.array("chr1", "chr2")).alias("chr")).distinct()
    if named.join(segments.select("chr").distinct(), "chr", "left_semi").isEmpty() and not named.isEmpty():
        raise ValueError("SVs and copy-number segments share no chromosome name")


def fit(loci: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Model of each sample; a sample with one variant has one cluster at its cell fraction."""
    alone = clustering.single_variant_model(clustering.usable(loci)).select(
        "sample", F.lit(1).alias("k"), "cluster", "ccf", "weight", F.lit(True).alias("converged")
    )
    several = loci.join(alone.select("sample"), "sample", "left_anti")
    return clustering.fit_clusters(several, p).unionByName(alone)


def cluster(loci: DataFrame, params: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Model of each sample and its result tables."""
    model = fit(loci, p)
    return results(clustering.assign(loci, model), model, params, p)


def postassign(
    sv_loci: DataFrame, snv_loci: DataFrame, sv_model: DataFrame, snv_model: DataFrame, params: DataFrame, p: Params = DEFAULTS
) -> dict[str, dict[str, DataFrame]]:
    """Result tables of SVs and of SNVs under the model that both were merged into."""
    sized = [
        clustering.with_sizes(model, clustering.assign(loci, model))
        for loci, model in ((snv_loci, snv_model), (sv_loci, sv_model))
    ]
    joint = cut_lineage(clustering.merged_model(*sized))
    return {
        kind: results(clustering.assign(loci, joint), joint, params, p)
        for kind, loci in (("sv", sv_loci), ("snv", snv_loci))
    }


def fit_and_store(loci: DataFrame, folder: str, p: Params = DEFAULTS) -> None:
    """Fit and store the model of each sample, with the number of variants in each cluster,
    for other jobs to assign variants to."""
    model = cut_lineage(fit(loci, p))
    sized = clustering.with_sizes(model, clustering.assign(loci, model))
    versioned.commit({"model": sized}, folder, loci.select("sample").distinct())


def postassign_stored(
    sv_loci: DataFrame, snv_loci: DataFrame, sv_folder: str, snv_folder: str, params: DataFrame, p: Params = DEFAULTS
) -> dict[str, dict[str, DataFrame]]:
    """Result tables of SVs and of SNVs under the stored models of both, merged."""
    spark = sv_loci.sparkSession
    models = [versioned.read(spark, folder, "model") for folder in (snv_folder, sv_folder)]
    joint = cut_lineage(clustering.merged_model(*models))
    return {
        kind: results(clustering.assign(loci, joint), joint, params, p)
        for kind, loci in (("sv", sv_loci), ("snv", snv_loci))
    }


def store_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Result tables of a step, replaced for its samples all at once."""
    versioned.commit(tables, folder)


def results(
    assigned: DataFrame, model: DataFrame, params: DataFrame, p: Params = DEFAULTS
) -> dict[str, DataFrame]:
    return {
        "model": model,
        "assignment_probability": clustering.assignment_probability(assigned),
        "multiplicity": clustering.multiplicity(assigned),
        "subclonal_structure": clustering.subclonal_structure(assigned, model, params),
        "cluster_certainty": clustering.cluster_certainty(assigned, params),
    }
