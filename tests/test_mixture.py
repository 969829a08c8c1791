"""The fit with copies inside: derivatives, no loss of log-likelihood, what was planted."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from breakwater.operators import mixture
from breakwater.params import DEFAULTS

FEW = replace(DEFAULTS, clus_limit=2, repeat=2, n_iter=40)
FIELDS = ", ".join(f"var{e} double, total{e} double, weight{e} double, mult{e} double, top{e} int, copies{e} double" for e in (1, 2))
SCHEMA = f"sample string, variant_id string, {FIELDS}"


def planted(n=240):
    rng = random.Random(7)
    out = []
    for i in range(n):
        f, total = (0.95 if i % 3 else 0.35), rng.randrange(80, 120)
        draw = [float(sum(rng.random() < f * 0.5 * m for _ in range(total))) for m in (1 + i % 2, 1 + i // 2 % 2)]
        second = (draw[1], float(total), 0.5, 1.0, 2, 2.0) if i % 4 == 0 else (0.0, 0.0, None, None, None, None)
        out.append(("S", str(i), draw[0], float(total), 0.5, 1.0, 2, 2.0, *second))
    # No reads, no weight, a sample of its own with neither.
    out += [("S", "x", 0.0, 0.0, 0.5, 1.0, 2, 2.0, 0.0, 0.0, None, None, None, None), ("T", "y", 1.0, 9.0, None, 1.0, 2, 2.0, 0.0, 0.0, None, None, None, None)]
    return out


def by_hand(f, var, total, weight, top):
    states = [var * math.log(f * weight * m) + (total - var) * math.log(1 - f * weight * m) for m in range(1, top + 1)]
    high = max(states)
    return high + math.log(sum(math.exp(s - high) for s in states) / top)


def test_points_equal_a_loop_and_its_slope(spark):
    loci = spark.createDataFrame(planted(40), SCHEMA).filter("weight1 IS NOT NULL AND total1 > 0")
    for f in (0.2, 0.7, 0.97):
        for r in loci.select("*", mixture._point(F.lit(f)).alias("p")).collect():

            def whole(x, r=r):
                return by_hand(x, r.var1, r.total1, r.weight1, r.top1) + (by_hand(x, r.var2, r.total2, r.weight2, r.top2) if r.total2 else 0.0)

            assert r.p.l == pytest.approx(whole(f), abs=1e-9)
            assert r.p.g == pytest.approx((whole(f + 1e-6) - whole(f - 1e-6)) / 2e-6, rel=1e-4, abs=1e-3)


def test_fit_recovers_fractions_and_copies_and_never_falls(spark):
    loci = spark.createDataFrame(planted(), SCHEMA)
    fits = mixture.fits_of(loci, FEW).collect()
    assert {r["sample"] for r in fits} == {"S"}
    for r in fits:
        assert r.worst >= -1e-9 * abs(r.loglik)
        assert sum(r.base_shares) == pytest.approx(1.0)
    best = max(fits, key=lambda r: r.loglik)
    assert sorted(best.base) == pytest.approx([0.35, 0.95], abs=0.02)
    rows = [("S", i + 1, c, w) for i, (c, w) in enumerate(sorted(zip(best.base, best.base_shares), reverse=True))]
    model = spark.createDataFrame(rows, "sample string, cluster int, ccf double, weight double")
    found = {r.variant_id: r for r in mixture.copies_and_clusters(loci, model).collect()}
    assert len(found) == 242 and found["x"].label is None and found["y"].copies_of1 is None
    right = [i for i in range(240) if found[str(i)].label == (1 if i % 3 else 2) and found[str(i)].copies_of1 == 1 + i % 2]
    assert len(right) >= 230
