"""Look-ups among segments on both paths, against plain loops."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from breakwater.functions import genotype
from breakwater.operators import copynumber, stabbing
from breakwater.params import DEFAULTS

PATHS = [{}, {"broadcast_rows": 0, "task_rows": 20}]
SEGMENT = "sample string, chr string, ordinal long, startpos long, endpos long"


def crowded(n, seed):
    """Segments of which a third lie within one place, some reach over everything, some touch,
    some are one base long, and some end before they start."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = 5000 + i % 7 if i % 3 == 0 else rng.randrange(1, 200_000)
        size = 150_000 if i % 11 == 0 else rng.choice([0, 1, 40, 3000, 9000]) - (i % 17 == 0) * 5000
        rows.append(("S0" if i % 4 else "S1", str(1 + i % 2), i, start, start + size))
        if i % 5 == 0:
            rows.append((*rows[-1][:2], n + i, rows[-1][4] + 1, rows[-1][4] + 700))
    return rows


def looked_up(segments, sample, chrom, pos):
    """Ordinal of the first cover, and (distance, ordinal) of the nearest start and end."""
    own = [s for s in segments if s[:2] == (sample, chrom) and None not in s]
    hit = min((s[2] for s in own if s[3] <= pos <= s[4]), default=None)
    start = min(((abs(s[3] - pos), s[2]) for s in own), default=None)
    end = min(((abs(s[4] - pos), s[2]) for s in own), default=None)
    return hit, start, end


@pytest.mark.parametrize("options", PATHS)
@pytest.mark.parametrize("n", [0, 1, 90])
def test_look_up_equals_loop(spark, options, n):
    segments = [*crowded(n, n), ("S0", "1", 999, None, 80), ("S0", "1", 998, 70, None)]
    segments = segments if n else []
    rng = random.Random(3)
    edges = [s[k] + d for s in segments if None not in s for k in (3, 4) for d in (-1, 0, 1)]
    asked = [rng.choice([*edges, rng.randrange(-50, 400_000)]) for _ in range(300)]
    rows = [(rng.choice(["S0", "S1", "S2"]), rng.choice(["1", "2", "9"]), p, rng.choice(asked)) for p in asked]
    rows += [("S0", "1", None, 7), (None, "1", 5, 5), ("S0", None, 5, 5), rows[0], rows[0], ("S0", "1", 10**11, -(10**11))]
    df = spark.createDataFrame(rows, "sample string, chr string, p long, q long")
    index = stabbing.index_segments(spark.createDataFrame(segments, SEGMENT), **options)
    assert index.within == (not options or n == 0)
    rows_each = {k: v for k, v in options.items() if k == "task_rows"}
    found = stabbing.look_up(df, index, {"a": (F.col("chr"), F.col("p")), "b": (F.col("chr"), F.col("q"))}, **rows_each)
    out = ["sample", "chr", "p", "q"]
    for name, pos in (("a", "p"), ("b", "q")):
        out.append(F.col(f"{name}.hit").alias(f"{name}_hit"))
        out += [stabbing.nearest(name, F.col(pos), k).alias(f"{name}_{k}") for k in ("start", "end")]
    got = sorted((str(tuple(r)[:4]), str([x if x is None or isinstance(x, int) else tuple(x) for x in tuple(r)[4:]])) for r in found.select(*out).collect())

    def one(sample, chrom, pos):
        return list(looked_up(segments, sample, chrom, pos)) if None not in (sample, chrom, pos) else [None] * 3

    # A segment without a start has an end, and the other way about.
    want = sorted((str(r), str([*one(r[0], r[1], r[2]), *one(r[0], r[1], r[3])])) for r in rows)
    if n:
        half = {999: (None, 80), 998: (70, None)}
        want = []
        for r in rows:
            line = []
            for pos in r[2:]:
                hit, start, end = one(r[0], r[1], pos)
                if r[:2] == ("S0", "1") and pos is not None:
                    start = min(x for x in (start, (abs(half[998][0] - pos), 998)) if x)
                    end = min(x for x in (end, (abs(half[999][1] - pos), 999)) if x)
                line += [hit, start, end]
            want.append((str(r), str(line)))
        want.sort()
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_paths_give_the_same_matches(spark, strict):
    p = replace(DEFAULTS, strict_cnv=strict, sv_offset=30)
    rows = [(*r, f"{r[2] % 5},1,1.0") for r in crowded(60, 8)]
    segments = spark.createDataFrame(rows, SEGMENT + ", g string")
    segments = segments.withColumn("states", genotype.parse(F.col("g"))).drop("g")
    rng = random.Random(4)
    svs = spark.createDataFrame(
        [(f"S{i % 3}", i, str(1 + i % 3), rng.randrange(1, 220_000), rng.choice("+-."), "1", rng.randrange(1, 220_000), rng.choice("+-"), rng.choice(["DEL", "INTRX"])) for i in range(200)],
        "sample string, sv_id long, chr1 string, pos1 long, dir1 string, chr2 string, pos2 long, dir2 string, classification string",
    )
    one, other = (sorted(map(str, copynumber.match_svs(svs, segments, p, **o).collect())) for o in PATHS)
    assert one == other and len(one) == 200
    states = [sorted(map(str, copynumber.match_sv_states(svs, segments, p, **o).collect())) for o in PATHS]
    assert states[0] == states[1]
    snvs = svs.select("sample", F.col("chr1").alias("chrom"), F.col("pos1").alias("pos"))
    held = [sorted(map(str, copynumber.match_snvs(snvs, segments, **o).collect())) for o in PATHS]
    assert held[0] == held[1] and len(held[0]) == 200
