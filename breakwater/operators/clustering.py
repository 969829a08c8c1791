"""Cancer cell fractions, their clusters, and assignment of variants to clusters.

A variant is in ``loci`` form: (sample, variant_id, and for each of two loci var, total,
weight, mult, top and copies).  SNVs have no second locus: no reads there, other columns
NULL.  The share of variant reads expected at cell fraction f is f x weight x mult, with
weight = purity / (purity x tumour copies + (1 - purity) x normal copies)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype
from ..functions.genome import normal_copy_number
from ..params import DEFAULTS, Params
from ..session import cut_lineage
from .ordered import first_rows
from .skew import BROADCAST_ROWS, lookup_join, salt_both

# Expected shares are kept off 0 and 1 by this much.
EDGE = 1e-6
# Clusters of a joint model closer than this are one.
MERGE_DISTANCE = 0.1
# Steps of a fit between two writes.
STEPS_PER_WRITE = 5


# ---------------------------------------------------------------- model input


def model_input_snv(snvs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Counts and copy-number states of SNVs; rows have purity and states."""
    total = F.col("ref") + F.col("var")
    return snvs.select(
        "sample",
        F.concat_ws("_", "chrom", F.col("pos").cast("string")).alias("mutation_id"),
        "purity",
        normal_copy_number(F.col("chrom"), p.male).alias("normal_cn"),
        F.col("var").cast("double").alias("var_counts"),
        F.col("ref").cast("double").alias("ref_counts"),
        total.cast("double").alias("total_counts"),
        F.try_divide(F.col("var").cast("double"), total).alias("vaf"),
        *[c.alias(n) for n, c in genotype.state_columns(F.col("states")).items()],
    )


def model_input_sv(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Counts and copy-number states of both ends; rows lacking a state drop.  The
    normal counts are the adjusted ones, whatever ``adjusted`` says of the support."""
    both = svs.filter(F.col("states1").isNotNull() & F.col("states2").isNotNull())
    support = F.col("adjusted_support" if p.adjusted else "support").cast("double")
    ends = [
        F.concat_ws(":", F.col(f"chr{e}"), F.col(f"pos{e}").cast("string"), F.col(f"dir{e}"))
        for e in (1, 2)
    ]
    out = {
        "id": F.col("sv_id"),
        "mutation_id": F.concat_ws("_", *ends),
        "purity": F.col("purity"),
        "normal_cn": normal_copy_number(F.col("chr1"), p.male),
    }
    for e in (1, 2):
        norm = F.bround(F.col(f"adjusted_norm{e}")).cast("long")
        out[f"var_counts{e}"] = support
        out[f"ref_counts{e}"] = norm
        out[f"total_counts{e}"] = support + norm
        out[f"vaf{e}"] = F.try_divide(support, support + norm)
        out |= genotype.state_columns(F.col(f"states{e}"), str(e))
    return both.select("sample", *[c.alias(n) for n, c in out.items()])


# ---------------------------------------------------------------- cell fractions


def vaf_to_ccf(
    vaf: Column, purity: Column, normal_cn: Column, tumour_cn: Column, mult: Column
) -> Column:
    """Cell fraction from the share of variant reads, with one tumour copy number."""
    copies = purity * tumour_cn + (1 - purity) * normal_cn
    return vaf * copies / (purity * mult)


def tumour_copies(tag: str = "") -> Column:
    """Mean total copies over the tumour's states."""
    return F.col(f"total_cn{tag}_sub1") * F.col(f"frac_cn{tag}_sub1") + F.col(
        f"total_cn{tag}_sub2"
    ) * F.col(f"frac_cn{tag}_sub2")


LOCUS = ("var", "total", "weight", "mult", "top", "copies")


def _locus(tag: str) -> dict[str, Column]:
    copies = tumour_copies(tag)
    depth_copies = F.col("purity") * copies + (1 - F.col("purity")) * F.col("normal_cn")
    weight = F.try_divide(F.col("purity"), depth_copies)
    top = F.greatest(F.col(f"major_cn{tag}_sub1"), F.col(f"major_cn{tag}_sub2"), F.lit(1.0))
    # Copies that would give this share of reads if all cells had the variant.
    implied = F.bround(F.try_divide(F.col(f"vaf{tag}"), weight))
    mult = F.coalesce(F.greatest(F.lit(1.0), F.least(implied, top)), F.lit(1.0))
    values = (
        F.col(f"var_counts{tag}"),
        F.col(f"total_counts{tag}"),
        weight,
        mult,
        top.cast("int"),
        copies,
    )
    return dict(zip(LOCUS, values, strict=True))


def _no_locus() -> dict[str, Column]:
    values = [F.lit(0.0), F.lit(0.0)] + [F.lit(None).cast("double")] * 4
    return dict(zip(LOCUS, values, strict=True))


def _loci(model_input: DataFrame, first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    return model_input.select(
        "sample",
        F.col("mutation_id").alias("variant_id"),
        *[c.alias(f"{n}1") for n, c in first.items()],
        *[c.alias(f"{n}2") for n, c in second.items()],
    )


def snv_loci(model_input: DataFrame) -> DataFrame:
    return _loci(model_input, _locus(""), _no_locus())


def sv_loci(model_input: DataFrame) -> DataFrame:
    return _loci(model_input, _locus("1"), _locus("2"))


def _is_usable() -> Column:
    first = (F.col("total1") > 0) & F.col("weight1").isNotNull()
    second = F.col("mult2").isNull() | ((F.col("total2") > 0) & F.col("weight2").isNotNull())
    return F.coalesce(first & second, F.lit(False))


def usable(loci: DataFrame) -> DataFrame:
    """Variants with reads at every locus and a known weight."""
    return loci.filter(_is_usable())


def _share_term(var: Column, total: Column, share: Column) -> Column:
    """Binomial log-likelihood without the term free of ``share``."""
    kept = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), share))
    return var * F.log(kept) + (total - var) * F.log(1 - kept)


def _log_likelihood(ccf: Column, reach1: Column, reach2: Column) -> Column:
    """Over both loci; ``reach`` is weight x mult.  A locus without reads adds nothing."""
    one = _share_term(F.col("var1"), F.col("total1"), ccf * reach1)
    two = _share_term(F.col("var2"), F.col("total2"), ccf * reach2)
    return one + F.when(F.col("total2") > 0, two).otherwise(0.0)


# ---------------------------------------------------------------- assignment


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use as they are.  Merged into those, they would
    be worked out again for every element of an array."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _model_rows(clusters: DataFrame) -> DataFrame:
    """One row per sample with its clusters in order; a model has few clusters."""
    return clusters.groupBy("sample").agg(
        F.array_sort(F.collect_list(F.struct("cluster", "ccf", "weight"))).alias("model")
    )


def assign(loci: DataFrame, clusters: DataFrame) -> DataFrame:
    """Probability of each cluster for each variant, and the most likely one.

    ``clusters``: (sample, cluster, ccf, weight).  Adds probs (cluster, ccf, prob in the
    order of cluster), label and label_ccf, all NULL for a sample without a model and for a
    variant without reads at a locus or of unknown weight."""
    ready = loci.withColumns(
        {
            "_reach1": F.col("weight1") * F.col("mult1"),
            "_reach2": F.coalesce(F.col("weight2") * F.col("mult2"), F.lit(0.5)),
        }
    )
    joined = lookup_join(ready, _model_rows(clusters), ["sample"])
    joined = joined.withColumn("model", F.when(_is_usable(), F.col("model")))
    scores = F.transform(
        "model",
        lambda m: F.log(F.greatest(m["weight"], F.lit(1e-300)))
        + _log_likelihood(m["ccf"], F.col("_reach1"), F.col("_reach2")),
    )
    scored = once(joined, _scores=scores)
    scored = once(scored, _top=F.array_max("_scores"))
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_top")))
    scored = once(
        scored,
        _norm=F.col("_top") + F.log(total),
        _best=F.get("model", (F.array_position("_scores", F.col("_top")) - 1).cast("int")),
    )
    probs = F.zip_with(
        "model",
        "_scores",
        lambda m, v: F.struct(
            m["cluster"].alias("cluster"), m["ccf"].alias("ccf"), F.exp(v - F.col("_norm")).alias("prob")
        ),
    )
    return scored.select(
        *loci.columns,
        probs.alias("probs"),
        F.col("_best.cluster").alias("label"),
        F.col("_best.ccf").alias("label_ccf"),
    )


def assignment_long(assigned: DataFrame) -> DataFrame:
    return assigned.select(
        "sample", "variant_id", "label", F.explode("probs").alias("_p")
    ).select("sample", "variant_id", "label", "_p.cluster", "_p.prob")


def assignment_probability(assigned: DataFrame, n_clusters: int | None = None) -> DataFrame:
    """Wide form: cluster0, cluster1, ... in the order of the clusters that have any
    variant; NULL beyond.  ``n_clusters`` is the width at least; the table is as wide as the
    largest model needs."""
    largest = assigned.agg(F.max(F.size("probs"))).first()[0] or 0
    n_clusters = max(n_clusters or 0, largest, 1)
    present = assigned.filter("label IS NOT NULL").select("sample", "label").distinct()
    used = present.groupBy("sample").agg(F.array_sort(F.collect_set("label")).alias("_used"))
    joined = lookup_join(assigned, used, ["sample"])
    kept = F.filter("probs", lambda q: F.array_contains("_used", q["cluster"]))
    return joined.withColumn("_kept", kept).select(
        "sample",
        "variant_id",
        *[F.get("_kept", i)["prob"].alias(f"cluster{i}") for i in range(n_clusters)],
    )


def subclonal_structure(
    assigned: DataFrame, clusters: DataFrame, purity: DataFrame
) -> DataFrame:
    """Clusters that have variants: how many, and their share of all cells; with the
    number of such clusters."""
    sizes = assigned.groupBy("sample", F.col("label").alias("cluster")).agg(
        F.count("*").alias("n_ssms")
    )
    # One row per sample and cluster from here on.
    per_sample = Window.partitionBy("sample")
    named = sizes.join(clusters.select("sample", "cluster", "ccf"), ["sample", "cluster"]).join(
        purity.select("sample", "purity"), "sample"
    )
    return named.select(
        "sample",
        "cluster",
        "n_ssms",
        (F.col("ccf") * F.col("purity")).alias("proportion"),
        F.count("*").over(per_sample).alias("n_clusters"),
    )


def multiplicity(assigned: DataFrame) -> DataFrame:
    """Copies each variant most likely sits on, given its cluster (NULL without one), and
    total copies; one pair of columns per locus."""

    def best(e: int) -> Column:
        var, total = F.col(f"var{e}"), F.col(f"total{e}")
        unit = F.col("label_ccf") * F.col(f"weight{e}")
        tried = F.transform(
            F.sequence(F.lit(1), F.col(f"top{e}").cast("int")),
            lambda m: F.struct(
                F.round(_share_term(var, total, unit * m), 9).alias("score"), (-m).alias("neg")
            ),
        )
        return F.when(F.col("label_ccf").isNotNull(), -F.array_max(tried)["neg"])

    return assigned.select(
        "sample",
        "variant_id",
        *[F.col(f"copies{e}").alias(f"tumour_copynumber{e}") for e in (1, 2)],
        *[best(e).alias(f"multiplicity{e}") for e in (1, 2)],
    )


def raw_ccf(e: int) -> Column:
    """Cell fraction that the reads of one locus give by themselves."""
    share = F.try_divide(F.col(f"var{e}"), F.col(f"total{e}"))
    return F.try_divide(share, F.col(f"weight{e}") * F.col(f"mult{e}"))


def cluster_certainty(assigned: DataFrame, purity: DataFrame) -> DataFrame:
    """Most likely cluster, and the raw cell fraction of each locus as a share of all
    cells."""
    return lookup_join(assigned, purity.select("sample", "purity"), ["sample"]).select(
        "sample",
        "variant_id",
        F.col("label").alias("most_likely_assignment"),
        *[(raw_ccf(e) * F.col("purity")).alias(f"average_proportion{e}") for e in (1, 2)],
    )


def single_variant_model(loci: DataFrame) -> DataFrame:
    """Model of a sample with one variant: one cluster at its mean raw cell fraction."""
    ends = [
        F.try_divide(F.try_divide(F.col(f"var{e}"), F.col(f"total{e}")), F.col(f"weight{e}"))
        for e in (1, 2)
    ]
    mean = F.coalesce((ends[0] + ends[1]) / 2, ends[0])
    alone = loci.groupBy("sample").agg(F.count("*").alias("_n"), F.first(mean).alias("ccf"))
    return alone.filter(F.col("_n") == 1).select(
        "sample", F.lit(1).alias("cluster"), "ccf", F.lit(1.0).alias("weight")
    )


def merged_model(
    snv_clusters: DataFrame, sv_clusters: DataFrame, distance: float = MERGE_DISTANCE
) -> DataFrame:
    """Joint model: clusters of both models, (sample, cluster, ccf, n), with those closer
    than ``distance`` to the next one merged at their mean, weighted by variants."""
    both = snv_clusters.select("sample", "ccf", "n").unionByName(
        sv_clusters.select("sample", "ccf", "n")
    )
    # A sample has at most two models' worth of clusters.
    order = Window.partitionBy("sample").orderBy("ccf", "n")
    gap = F.col("ccf") - F.lag("ccf").over(order)
    starts = F.when(gap.isNull() | (gap >= distance), 1).otherwise(0)
    grouped = both.withColumn("_new", starts).withColumn("cluster", F.sum("_new").over(order))
    merged = grouped.groupBy("sample", "cluster").agg(
        (F.sum(F.col("ccf") * F.col("n")) / F.sum("n")).alias("ccf"), F.sum("n").alias("n")
    )
    whole = Window.partitionBy("sample")
    return merged.select(
        "sample",
        F.col("cluster").cast("int").alias("cluster"),
        "ccf",
        (F.col("n") / F.sum("n").over(whole)).alias("weight"),
    )


def with_sizes(clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clusters with ``n``, the variants most likely in them."""
    sizes = assigned.groupBy("sample", F.col("label").alias("cluster")).agg(F.count("*").alias("n"))
    return clusters.join(sizes, ["sample", "cluster"])


def post_assign(loci: DataFrame, clusters: DataFrame) -> DataFrame:
    """Variants scored against a model fitted to others."""
    return assign(loci, clusters)


def post_assign_joint(
    loci: DataFrame, snv_clusters: DataFrame, sv_clusters: DataFrame
) -> DataFrame:
    return assign(loci, merged_model(snv_clusters, sv_clusters))


# ---------------------------------------------------------------- fitting


def _distinct_loci(loci: DataFrame) -> DataFrame:
    """Variants with equal counts and copies are the same to the model, so each distinct
    one is kept once with its frequency.  This is exact, and for large samples far
    smaller than the variants."""
    reach2 = F.coalesce(F.col("weight2") * F.col("mult2"), F.lit(0.5))
    return loci.groupBy(
        "sample",
        "var1",
        "total1",
        (F.col("weight1") * F.col("mult1")).alias("reach1"),
        "var2",
        "total2",
        reach2.alias("reach2"),
    ).agg(F.count("*").cast("double").alias("freq"))


# Variant reads, and reads at which a cell fraction of one would show, of both loci.
_TOTALS = ("var1 + var2", "total1 * reach1 + total2 * reach2")


def _centre(i: int) -> str:
    return f"c{i}"


def _share(i: int) -> str:
    return f"w{i}"


def _starts(data: DataFrame, p: Params) -> DataFrame:
    """Starting centres for every number of clusters and repeat: quantiles of the raw
    cell fractions, moved a little more with each repeat.  One row per fit, with the
    centre c and the weight w of each cluster, NULL beyond its number of clusters."""
    grid = 100
    marks = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    var, reach = (F.expr(t) for t in _TOTALS)
    # Cell fractions to three places: a bounded number of them for each sample, so that
    # the quantiles over all variants are exact at that precision.
    ccf = F.round(F.least(F.try_divide(var, reach), F.lit(20.0)), 3)
    raw = data.select("sample", ccf.alias("ccf"), "freq")
    counted = raw.groupBy("sample", "ccf").agg(F.sum("freq").alias("freq"))
    spread = counted.groupBy("sample").agg(
        F.percentile("ccf", marks, F.col("freq").cast("long")).alias("marks"), F.sum("freq").alias("n")
    )

    def start(k: int, r: int) -> Column:
        cells = []
        for i in range(p.clus_limit):
            at = int(grid * (((i + 0.5) / k + r / (p.repeat * k)) % 1.0))
            centre = F.greatest(F.lit(0.01), F.get("marks", at)) if i < k else F.lit(None)
            cells.append(centre.cast("double").alias(_centre(i)))
            cells.append((F.lit(1.0 / k) if i < k else F.lit(None)).cast("double").alias(_share(i)))
        return F.struct(F.lit(k).alias("k"), F.lit(r).alias("repeat"), *cells)

    # With one cluster all starts end at the same centre.
    tried = [(k, r) for k in range(1, p.clus_limit + 1) for r in range(p.repeat if k > 1 else 1)]
    fits = F.inline(F.array(*[start(k, r) for k, r in tried]))
    return (
        spread.select("sample", "n", "marks", fits)
        .drop("marks")
        .filter(F.col("k") <= F.col("n"))
        .withColumns({"loglik": F.lit(None).cast("double"), "done": F.lit(False)})
    )


def _step(
    data: DataFrame, fits: DataFrame, limit: int, tolerance: float, few: bool
) -> DataFrame:
    """One expectation and maximisation step of the fits.  Each distinct variant meets
    the few fits of its sample; sums combine before the shuffle."""
    cells = [f(i) for i in range(limit) for f in (_centre, _share)]
    slim = fits.select("sample", "n", "k", "repeat", *cells)
    if few:
        joined = data.join(F.broadcast(slim), "sample")
    else:
        left, right, keys = salt_both(data, slim, ["sample"])
        joined = left.join(right, keys)
    absent = F.lit(-1e300)
    scored = joined.withColumns(
        {
            f"s{i}": F.coalesce(
                F.log(F.greatest(F.col(_share(i)), F.lit(1e-300)))
                + _log_likelihood(F.col(_centre(i)), F.col("reach1"), F.col("reach2")),
                absent,
            )
            for i in range(limit)
        }
    )
    score = [F.col(f"s{i}") for i in range(limit)]
    scored = scored.withColumn("top", F.greatest(*score) if limit > 1 else score[0])
    scored = scored.withColumns({f"e{i}": F.exp(score[i] - F.col("top")) for i in range(limit)})
    scored = scored.withColumn("z", sum((F.col(f"e{i}") for i in range(limit)), F.lit(0.0)))
    var, reach = (F.expr(t) for t in _TOTALS)
    scored = scored.withColumns({"var": var, "reach": reach, "scale": F.col("freq") / F.col("z")})
    key = ["sample", "k", "repeat"]
    sums = [F.first(c).alias(c) for c in ("n", *cells)]
    for i in range(limit):
        r = F.col("scale") * F.col(f"e{i}")
        sums += [
            F.sum(r).alias(f"n{i}"),
            F.sum(r * F.col("var")).alias(f"v{i}"),
            F.sum(r * F.col("reach")).alias(f"d{i}"),
        ]
    stepped = scored.groupBy(*key).agg(
        F.sum(F.col("freq") * (F.col("top") + F.log("z"))).alias("loglik"), *sums
    )
    fresh, moves = {}, []
    for i in range(limit):
        centre = F.coalesce(F.try_divide(F.col(f"v{i}"), F.col(f"d{i}")), F.col(_centre(i)))
        inside = F.col(_centre(i)).isNotNull()
        fresh[_centre(i)] = F.when(inside, centre)
        fresh[_share(i)] = F.when(inside, F.col(f"n{i}") / F.col("n"))
        moves.append(F.when(inside, F.abs(centre - F.col(_centre(i)))).otherwise(0.0))
    move = F.greatest(*moves) if limit > 1 else moves[0]
    return stepped.select(
        "sample",
        "n",
        "k",
        "repeat",
        *[c.alias(n) for n, c in fresh.items()],
        "loglik",
        (move < tolerance).alias("done"),
    )


def fit_clusters(
    loci: DataFrame, p: Params = DEFAULTS, tolerance: float = 1e-4
) -> DataFrame:
    """Mixture fit per sample: (sample, k, cluster, ccf, weight, converged), clusters from
    the highest cell fraction down.

    All numbers of clusters and repeats of all samples step together, a few steps in one
    job; then the fits are written, which cuts the lineage.  A fit stops when no centre
    moves by ``tolerance``; the fit with the lowest information criterion is taken, and
    ``converged`` is false if it was still moving after ``n_iter`` steps."""
    spark = loci.sparkSession
    data = _distinct_loci(usable(loci))
    data = cut_lineage(data.repartition(spark.sparkContext.defaultParallelism))
    fits = cut_lineage(_starts(data, p))
    few = fits.count() <= BROADCAST_ROWS
    for first in range(0, p.n_iter, STEPS_PER_WRITE):
        moving = fits.filter(~F.col("done"))
        for _ in range(min(STEPS_PER_WRITE, p.n_iter - first)):
            moving = _step(data, moving, p.clus_limit, tolerance, few)
        fits = cut_lineage(fits.filter("done").unionByName(moving))
        if fits.filter(~F.col("done")).isEmpty():
            break
    criterion = -2 * F.col("loglik") + (2 * F.col("k") - 1) * F.log(F.col("n"))
    pairs = F.array(
        *[
            F.struct(F.col(_centre(i)).alias("ccf"), F.col(_share(i)).alias("weight"))
            for i in range(p.clus_limit)
        ]
    )
    best = (
        fits.withColumns({"_bic": F.round(criterion, 6), "centres": pairs})
        .groupBy("sample")
        .agg(F.min(F.struct("_bic", "k", "repeat", "centres", "done")).alias("b"))
    )
    ordered = F.reverse(F.array_sort(F.filter("b.centres", lambda c: c["ccf"].isNotNull())))
    named = best.select("sample", F.col("b.k").alias("k"), F.col("b.done").alias("converged"), F.posexplode(ordered).alias("i", "c"))
    return named.select(
        "sample",
        "k",
        (F.col("i") + 1).alias("cluster"),
        F.col("c.ccf").alias("ccf"),
        F.col("c.weight").alias("weight"),
        "converged",
    )


# ---------------------------------------------------------------- subsample


def subsample_key(seed: int, columns: Sequence[str] = ("pos",)) -> Column:
    """Repeatable shuffling key by integer arithmetic on whole-number columns."""
    key = F.lit(seed).cast("long")
    for c in columns:
        key = (key * 31 + F.col(c).cast("long") * 7919) % 1_000_003
    return key


def subsample(
    snvs: DataFrame, n: int, seed: int, columns: Sequence[str] = ("pos",)
) -> DataFrame:
    """``n`` SNVs of each sample, the same for the same seed."""
    keyed = snvs.withColumn("_key", subsample_key(seed, columns))
    order = [F.col("_key"), *[F.col(c) for c in snvs.columns if c != "sample"]]
    return first_rows(keyed, ["sample"], order, n).drop("_key")
