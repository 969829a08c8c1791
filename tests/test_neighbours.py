"""Ends near each other."""

import random

from breakwater.operators import matching

SVS = "sample string, sv_id long, chr1 string, pos1 long, dir1 string, chr2 string, pos2 long, dir2 string, classification string"


def test_neighbours_across_edges_of_stretches(spark, monkeypatch):
    """Ends on both sides of an edge of a stretch see each other; one row per place goes on."""
    threshold = 6
    edge = matching.STRETCH * threshold
    rng = random.Random(3)
    near = [edge + d for d in range(-8, 9)] + [2 * edge - 1, 2 * edge, 5, 0, -3]
    rows = [("S0", i, "1", rng.choice(near), "+", rng.choice("12"), rng.choice(near), "-", "DEL") for i in range(60)]
    sides = []
    join = matching.lookup_join
    monkeypatch.setattr(matching, "lookup_join", lambda big, small, on: sides.append(small) or join(big, small, on))
    out = matching.breakend_neighbours(spark.createDataFrame(rows, SVS), threshold)
    got = {(r.sv_id, r.bp): (r.n_end1, r.n_end2, r.only_neighbour) for r in out.collect()}
    ends = [(r[1], bp, r[2 if bp == 1 else 5], r[3 if bp == 1 else 6]) for r in rows for bp in (1, 2)]
    assert sides[0].count() == len({e[2:] for e in ends})
    for i, bp, chrom, pos in ends:
        others = [(j, b) for j, b, c, p in ends if j != i and c == chrom and abs(p - pos) < threshold]
        one, two = (sum(b == e for _, b in others) for e in (1, 2))
        assert got[i, bp] == (one, two, others[0][0] if len(others) == 1 else None)
