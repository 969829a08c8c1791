import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from breakwater.llm import queries
from breakwater.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            s = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total)))
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    # few different words and lengths, so that scores tie
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 40)}"
    docs = [(i * 2, " ".join(word() for _ in range(rng.choice((1, 2, 5, 5, 30))))) for i in range(n)]
    docs += [(7, "W3, w4; É-é"), (9, None), (11, ""), (13, "!?"), (7, "w3 w4"), (None, "w3 w4"), (15, "w3 w4")]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 8)))) for k in range(12)]
    items += [(90, None), (91, "..."), (92, "nowhere"), (93, "é w3 w3 W3"), (None, "w0 w1")]
    return docs, items


@pytest.mark.parametrize("kw", [{}, {"top": 3}, {"top": 5, "block_items": 4, "shard_postings": 60}])
def test_equals_brute_force(spark, kw):
    docs, items = corpus(150)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in rs.search(d, q, **kw).collect()), key=str)
    assert got == brute(docs, items, kw.get("top", rs.TOP))


def test_reads_stop_early():
    """The best are known before the lists end, and no row below them is read."""
    n = 4000
    tfs = np.concatenate((np.arange(n, 0, -1), np.ones(n, np.int64)))
    terms = np.repeat([0, 1], n)
    both = np.argsort(np.concatenate((np.arange(n), np.arange(n))), kind="stable")
    shard = rs.Shard(list(range(n)), np.full(n, 100), np.full(n, 2), terms[both], tfs[both], np.array([5000, 1]), 100 * n, n)
    seen = []
    impact = shard.impact

    class Watched:
        def __getitem__(self, k):
            if isinstance(k, slice):
                seen.append(k.stop)
            return impact[k]

    shard.impact = Watched()
    assert [i for i, _ in shard.best(np.array([0]), top=5, first_depth=8)] == [0, 1, 2, 3, 4]
    assert max(seen) < n // 50


def test_messy_tables(messy, no_rows, spark):
    items = spark.createDataFrame([(1, "quick maison", "x"), (1, "quick maison", "x"), (2, None, "x")], "item_id long, text string, rank string")
    rows = rs.search(messy, items).collect()
    assert {r.item_id for r in rows} == {1} and {r.doc_id for r in rows} == {1, 2, 7}
    assert len(rows) == 2 * 4  # items of equal id are items of their own; each row is a document
    assert rs.search(no_rows, items).collect() == [] and rs.search(messy, items.filter("false")).collect() == []


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLES["op12_nra_search"]).fetchall())
    got = queries.QUERIES["op12_nra_search"](spark, sf).select("item_id", "rank", "doc_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == want
