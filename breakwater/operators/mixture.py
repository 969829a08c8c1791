"""Mixture fit with the exact binomial likelihood and the copies of each variant inside.

At cell fraction f a variant on m copies shows in a share f x weight x m of the reads at a
locus.  Which m of 1..top holds is not known: each is as likely beforehand, each locus has its
own, and a fit weighs all of them, where ``clustering.fit_clusters`` sets one ahead.

Loci are as in ``clustering``.  Every step works out the responsibilities of clusters and
copies, and sums the first and second derivative of the expected log-likelihood by the centres;
a Newton step follows.  A step after which the log-likelihood is lower is halved until it is
not, so that it never falls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..session import cut_lineage
from .clustering import EDGE, LOCUS, _is_usable, usable
from .skew import BROADCAST_ROWS, lookup_join, salt_both

# Least centre that a fit moves to.
LEAST = 1e-3
# Loss of log-likelihood, as a share of it, that counts as rounding.
ROUNDING = 1e-12
# Halvings of one step after which the fit stays where it is.
MOST_HALVINGS = 30
# A step that gains less log-likelihood ends the fit: no criterion turns on so little.
LEAST_GAIN = 1e-2
# Steps between two writes.
STEPS_PER_WRITE = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def locus_states(ccf: Column, var: Column, total: Column, weight: Column, top: Column) -> Column:
    """Every number of copies with its log-likelihood (without the term free of the share)
    and its first and second derivative by ``ccf``; both are zero where the share is cut off."""

    def state(m: Column) -> Column:
        unit = weight * m
        share = ccf * unit
        kept = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), share))
        free = (share > EDGE) & (share < 1 - EDGE)
        rest = total - var
        slope = var / ccf - rest * unit / (1 - kept)
        bend = -var / (ccf * ccf) - rest * unit * unit / ((1 - kept) * (1 - kept))
        return F.struct(
            (var * F.log(kept) + rest * F.log(1 - kept)).alias("l"),
            F.when(free, slope).otherwise(0.0).alias("g"),
            F.when(free, bend).otherwise(0.0).alias("h"),
        )

    return F.transform(F.sequence(F.lit(1), F.greatest(top.cast("int"), F.lit(1))), state)


def _summed(states: Column) -> Column:
    """Log-likelihood over the copies, and the derivatives in their mean."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("z", "g", "h")])

    def total(s: Column, highest: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            e = F.exp(x["l"] - highest)
            return F.struct((acc["z"] + e).alias("z"), (acc["g"] + e * x["g"]).alias("g"), (acc["h"] + e * x["h"]).alias("h"))

        def end(acc: Column) -> Column:
            return F.struct(
                (highest + F.log(acc["z"]) - F.log(F.size(s).cast("double"))).alias("l"),
                (acc["g"] / acc["z"]).alias("g"),
                (acc["h"] / acc["z"]).alias("h"),
            )

        return F.aggregate(s, zero, add, end)

    return let(states, lambda s: let(F.array_max(F.transform(s, lambda x: x["l"])), lambda highest: total(s, highest)))


def _locus(ccf: Column, e: int) -> Column:
    return locus_states(ccf, *[F.col(f"{c}{e}") for c in ("var", "total", "weight", "top")])


def _point(ccf: Column) -> Column:
    """(l, g, h) of a variant at a cell fraction; a locus without reads adds nothing."""
    none = F.struct(*[F.lit(0.0).alias(n) for n in ("l", "g", "h")])
    second = F.when(F.col("total2") > 0, _summed(_locus(ccf, 2))).otherwise(none)

    def both(a: Column, b: Column) -> Column:
        return F.struct(*[(a[n] + b[n]).alias(n) for n in ("l", "g", "h")])

    return let(_summed(_locus(ccf, 1)), lambda a: let(second, lambda b: both(a, b)))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as they are, not to be merged into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _weighed(df: DataFrame, centres: str, shares: str) -> DataFrame:
    """Adds ``points``, (l, g, h) of each cluster, ``parts``, their responsibilities, and
    ``ll``, the log-likelihood of the variant."""

    def whole(points: Column, scores: Column, highest: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - highest))
        row = lambda ll: F.struct(
            points.alias("points"), F.transform(scores, lambda s: F.exp(s - ll)).alias("parts"), ll.alias("ll")
        )
        return let(highest + F.log(total), row)

    def of_points(points: Column) -> Column:
        scores = F.zip_with(points, F.col(shares), lambda x, w: x["l"] + F.log(F.greatest(w, F.lit(1e-300))))
        return let(scores, lambda s: let(F.array_max(s), lambda highest: whole(points, s, highest)))

    return df.select("*", F.inline(F.array(let(F.transform(centres, _point), of_points))))


def _distinct(loci: DataFrame) -> DataFrame:
    """Variants that are the same to the model, once with their frequency."""
    key = [f"{c}{e}" for e in (1, 2) for c in ("var", "total", "weight", "top")]
    return loci.groupBy("sample", *key).agg(F.count("*").cast("double").alias("freq"))


def _starts(data: DataFrame, p: Params) -> DataFrame:
    """Starts of every number of clusters and repeat: quantiles of the cell fractions that
    the first locus gives with each number of copies, those above one left out where others
    are there, moved a little with each repeat."""
    grid = 100
    marks = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    raw = F.col("var1") / F.col("total1") / F.col("weight1")
    tried = F.transform(F.sequence(F.lit(1), F.greatest(F.col("top1").cast("int"), F.lit(1))), lambda m: F.round(raw / m, 3))
    most = F.array_min(tried)
    kept = F.filter(tried, lambda c: (c <= 1.1) | (c == most))
    spread = data.select("sample", "freq", F.explode(kept).alias("ccf"))
    # Three places: a bounded number of values for each sample.
    counted = spread.groupBy("sample", "ccf").agg(F.sum("freq").alias("freq"))
    marked = counted.groupBy("sample").agg(F.percentile("ccf", marks, F.col("freq").cast("long")).alias("marks"))
    sized = marked.join(data.groupBy("sample").agg(F.sum("freq").alias("n")), "sample")

    def start(k: int, r: int) -> Column:
        at = [int(grid * (((i + 0.5) / k + r / (p.repeat * k)) % 1.0)) for i in range(k)]
        centres = F.array(*[F.greatest(F.lit(LEAST * 10), F.get("marks", i)) for i in at])
        return F.struct(
            F.lit(k).alias("k"),
            F.lit(r).alias("repeat"),
            centres.alias("centres"),
            F.array(*[F.lit(1.0 / k)] * k).alias("shares"),
        )

    # With one cluster, copies make several optima too, so every number has all starts.
    fits = F.inline(F.array(*[start(k, r) for k in range(1, p.clus_limit + 1) for r in range(p.repeat)]))
    number = F.lit(None).cast("double")
    return sized.select("sample", "n", "marks", fits).drop("marks").filter(F.col("k") <= F.col("n")).withColumns(
        {
            "base": F.lit(None).cast("array<double>"),
            "base_shares": F.lit(None).cast("array<double>"),
            "halvings": F.lit(0),
            "loglik": number,
            "worst": number,
            "done": F.lit(False),
        }
    )


STATE = ("sample", "n", "k", "repeat", "centres", "shares", "base", "base_shares", "halvings", "loglik", "worst", "done")


def _step(data: DataFrame, fits: DataFrame, limit: int, tolerance: float, few: bool) -> DataFrame:
    """Weigh every variant under every fit of its sample, then take, halve or end the step.

    ``centres`` and ``shares`` are tried; ``base`` and ``base_shares`` are the last ones
    taken, ``loglik`` their log-likelihood, and ``worst`` the least gain of a step taken."""
    key = ["sample", "k", "repeat"]
    kept = [c for c in STATE if c not in key]
    if few:
        joined = data.join(F.broadcast(fits), "sample")
    else:
        left, right, keys = salt_both(data, fits, ["sample"])
        joined = left.join(right, keys)
    weighed = _weighed(joined, "centres", "shares")
    # The state goes along in the sums, so that no step reads the fits twice.
    sums = [F.first(c).alias(c) for c in kept] + [F.sum(F.col("freq") * F.col("ll")).alias("fresh")]
    for i in range(limit):
        part = F.col("freq") * F.get("parts", i)
        point = F.get("points", i)
        sums += [F.sum(part).alias(f"n{i}"), F.sum(part * point["g"]).alias(f"g{i}"), F.sum(part * point["h"]).alias(f"h{i}")]
    both = weighed.groupBy(*key).agg(*sums)
    moved, parted = [], []
    for i in range(limit):
        centre = F.get("centres", i)
        # Concave in the centre, so this goes uphill; never further than to half or twice.
        newton = centre - F.coalesce(F.try_divide(F.col(f"g{i}"), F.col(f"h{i}")), F.lit(0.0))
        near = F.greatest(centre / 2, F.least(centre * 2, newton))
        moved.append(F.greatest(F.lit(LEAST), near))
        parted.append(F.col(f"n{i}") / F.col("n"))
    gain = F.col("fresh") - F.col("loglik")
    both = _once(
        both,
        gain=gain,
        fell=F.coalesce(gain < -ROUNDING * F.abs("loglik"), F.lit(False)),
        next=F.slice(F.array(*moved), 1, F.col("k")),
        part=F.slice(F.array(*parted), 1, F.col("k")),
    )

    def middle(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: (x + y) / 2)

    def unless_fell(taken: Column, else_: Column) -> Column:
        return F.when(F.col("fell"), else_).otherwise(taken)

    gap = F.array_max(F.zip_with("next", "centres", lambda x, y: F.abs(x - y)))
    small = F.coalesce(F.col("gain") < LEAST_GAIN, F.lit(False))
    out = {
        "centres": unless_fell(F.col("next"), middle("base", "centres")),
        "shares": unless_fell(F.col("part"), middle("base_shares", "shares")),
        "base": unless_fell(F.col("centres"), F.col("base")),
        "base_shares": unless_fell(F.col("shares"), F.col("base_shares")),
        "halvings": unless_fell(F.lit(0), F.col("halvings") + 1),
        "loglik": unless_fell(F.col("fresh"), F.col("loglik")),
        "worst": unless_fell(F.least("worst", "gain"), F.col("worst")),
        "done": unless_fell((gap < tolerance) | small, F.col("halvings") + 1 >= MOST_HALVINGS),
    }
    return both.select(*key, "n", *[c.alias(n) for n, c in out.items()]).select(*STATE)


def fits_of(loci: DataFrame, p: Params = DEFAULTS, tolerance: float = 1e-4) -> DataFrame:
    """Every fit of every sample when it ended: (sample, n, k, repeat, base, base_shares,
    loglik, worst, done).  Steps go on to the next write after a fit is done, so ``done`` is that
    of the last one."""
    spark = loci.sparkSession
    data = _distinct(usable(loci))
    data = cut_lineage(data.repartition(spark.sparkContext.defaultParallelism))
    fits = cut_lineage(_starts(data, p).select(*STATE))
    few = fits.count() <= BROADCAST_ROWS
    for first in range(0, p.n_iter, STEPS_PER_WRITE):
        ended, moving = fits.filter("done"), fits.filter(~F.col("done"))
        for _ in range(min(STEPS_PER_WRITE, p.n_iter - first)):
            moving = _step(data, moving, p.clus_limit, tolerance, few)
        fits = cut_lineage(ended.unionByName(moving))
        if fits.filter(~F.col("done")).isEmpty():
            break
    return fits


def fit_with_copies(loci: DataFrame, p: Params = DEFAULTS, tolerance: float = 1e-4) -> DataFrame:
    """Mixture fit per sample: (sample, k, cluster, ccf, weight, converged), as
    ``clustering.fit_clusters`` gives it; variants without reads or weight at a locus are not
    looked at, a sample without others is absent, and of equal criteria the fewest clusters win."""
    criterion = -2 * F.col("loglik") + (2 * F.col("k") - 1) * F.log("n")
    pairs = F.arrays_zip(F.col("base").alias("ccf"), F.col("base_shares").alias("weight"))
    best = (
        fits_of(loci, p, tolerance)
        .withColumns({"_bic": F.round(criterion, 6), "centres": pairs})
        .groupBy("sample")
        .agg(F.min(F.struct("_bic", "k", "repeat", "centres", "done")).alias("b"))
    )
    ordered = F.reverse(F.array_sort("b.centres"))
    named = best.select("sample", F.col("b.k").alias("k"), F.col("b.done").alias("converged"), F.posexplode(ordered).alias("i", "c"))
    return named.select(
        "sample", "k", (F.col("i") + 1).alias("cluster"), "c.ccf", "c.weight", "converged"
    )


def copies_and_clusters(loci: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each variant with its most likely cluster and, over all clusters, the most likely
    number of copies of each locus: label, label_ccf, label_prob, copies_of1, copies_of1_prob,
    copies_of2, copies_of2_prob.  NULL without a model, reads or weight; ties go to the first cluster
    and the fewest copies."""
    rows = clusters.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("cluster", "ccf", "weight"))).alias("model"))
    joined = lookup_join(loci, rows, ["sample"])
    joined = _once(joined, _model=F.when(_is_usable(), F.col("model"))).drop("model")
    joined = _once(joined, _c=F.transform("_model", lambda m: m["ccf"]), _w=F.transform("_model", lambda m: m["weight"]))
    found = _weighed(joined, "_c", "_w")

    def copies(e: int) -> Column:
        """Probability of each number of copies, summed over the clusters."""

        def of_cluster(states: Column, part: Column) -> Column:
            highest = F.array_max(F.transform(states, lambda x: x["l"]))
            return let(highest, lambda h: let(F.aggregate(states, F.lit(0.0), lambda a, x: a + F.exp(x["l"] - h)), lambda z: F.transform(states, lambda x: part * F.exp(x["l"] - h) / z)))

        top = F.greatest(F.col(f"top{e}").cast("int"), F.lit(1))
        each = F.zip_with("_c", "parts", lambda c, part: of_cluster(_locus(c, e), part))
        none = F.array_repeat(F.lit(0.0), top)
        whole = F.aggregate(each, none, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
        return F.when((F.col(f"total{e}") > 0) & F.col("_model").isNotNull(), whole)

    found = _once(found, _p1=copies(1), _p2=copies(2))
    out = [F.array_position("parts", F.array_max("parts")).cast("int").alias("_at")]
    found = found.select("*", *out)
    best = F.get("_model", F.col("_at") - 1)
    return found.select(
        *[c for c in loci.columns if c not in LOCUS],
        best["cluster"].alias("label"),
        best["ccf"].alias("label_ccf"),
        F.array_max("parts").alias("label_prob"),
        *[
            c
            for e in (1, 2)
            for c in (
                F.array_position(f"_p{e}", F.array_max(f"_p{e}")).cast("int").alias(f"copies_of{e}"),
                F.array_max(f"_p{e}").alias(f"copies_of{e}_prob"),
            )
        ],
    )
