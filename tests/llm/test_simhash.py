import re

import numpy as np
import pytest
import xxhash

from breakwater.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, bits=4):
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{f:016x}", least.get(find(i))) for i, (doc, f) in enumerate(zip([d for d, _ in docs], fps, strict=True))), key=str)


@pytest.mark.parametrize("groups", [None, 7, 10])
def test_equal_to_brute_force(documents, groups):
    # near copies of one document, each a few words away from the one before
    words = documents.orderBy("doc_id").first().text.split() * 5
    chain = []
    for i in range(60):
        words[(7 * i) % len(words)] = f"w{i}"
        chain.append((10_000 + i, " ".join(words)))
    df = documents.select("doc_id", "text").unionByName(documents.sparkSession.createDataFrame(chain, "doc_id long, text string"))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(df.repartition(5), groups=groups).collect()), key=str) == brute(docs)


def test_messy_table(messy, no_rows):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(messy).collect()), key=str) == brute(docs)
    assert simhash.near_duplicates(no_rows).collect() == []


def test_close_fingerprints_meet_in_a_cell_and_the_bound_holds():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    hamming = np.bitwise_count(a ^ b)
    ea, eb = simhash.embed(a), simhash.embed(b)
    assert (simhash.manhattan(ea, eb) <= hamming).all()
    segments = lambda e: np.stack([(e >> np.uint64(2 * s)) & np.uint64(3) for s in range(32)]).astype(int)
    assert (np.abs(segments(ea) - segments(eb)).sum(axis=0) == simhash.manhattan(ea, eb)).all()
    for groups in simhash.GROUPS:
        met = np.zeros(len(a), bool)
        for mask in simhash.cell_masks(groups):
            met |= (ea & mask) == (eb & mask)
        assert met.all()


def test_one_chain_and_one_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def alike(docs, words=5, least=0.8):
    """(component of each document, similar pairs) by comparing all pairs."""

    def shingles(text):
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    pairs = []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                pairs.append((docs[i][0], docs[j][0]))
                root[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return sorted(((doc, lowest.get(find(i))) for i, (doc, _) in enumerate(docs)), key=str), pairs


def test_near_copies_by_brute_force(documents, messy, no_rows):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    planted = []
    for k in range(150):
        text = [word() for _ in range(rng.integers(30, 400))]
        copy = list(text)
        for at in rng.choice(len(text), max(1, len(text) // 50), replace=False):
            copy[at] = word()
        planted += [(20_000 + 2 * k, " ".join(text)), (20_001 + 2 * k, " ".join(copy))]
    df = documents.select("doc_id", "text").unionByName(documents.sparkSession.createDataFrame(planted, "doc_id long, text string"))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    want, pairs = alike(docs)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df.repartition(5)).collect()}
    # cells cut into blocks give the same
    assert got == {r.doc_id: r.component_id for r in simhash.near_copies(df, cell_bytes=4000).collect()}
    assert len(pairs) > 100
    # none that is not alike, and all but what meets in no band
    assert all(got[doc] == least or got[doc] == doc for doc, least in want)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    close = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sum(close[a] == close[b] for a, b in pairs) < 0.8 * len(pairs)
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert sorted((tuple(r) for r in simhash.near_copies(messy).collect()), key=str) == alike(rows)[0]
    assert simhash.near_copies(no_rows).collect() == []
