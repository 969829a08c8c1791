import random
import re
import zlib
from collections import Counter

import pytest
from breakwater.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(u, v):
    """One insertion, deletion or replacement apart, by trying each."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def brute(words):
    out = {}
    keys = sorted(words)
    form = {}
    for u in keys:
        found = [v for v in keys if near(u, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[u] = best if best and words[best] >= 2 * words[u] else None
        out[u] = [words[u], len(found), form[u]]
    for u in keys:
        root = u
        while form[root]:
            root = form[root]
        out[u].append(root)
    return out


def as_dict(rows, words):
    assert all(r.form_n == (words[r.form] if r.form else None) for r in rows)
    return {r.word: [r.n, r.n_near, r.form, r.root] for r in rows}


@pytest.mark.parametrize("block_words", [spelling.BLOCK_WORDS, 3])
def test_equals_brute_force(spark, block_words):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(25)]
    rows = []
    for i in range(400):
        run = []
        for _ in range(12):
            w = rng.choice(stems[: rng.randint(2, 25)])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]))
            run.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(run)))
    rows += [(None, "abbab, ABBAB abbab"), (1, None), (2, ""), (3, ("x" * 200 + " ") * 3)]
    words = counted(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = spelling.spelling_variants(docs, block_words=block_words).collect()
    assert as_dict(found, words) == brute(words)
    assert len(words) > 100 and any(r.root not in (r.word, r.form) for r in found)


def test_counts_with_slips(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in spelling.count_words(documents).collect()} == counted(rows)


def test_query_equals_brute_force(spark, documents):
    words = counted([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    some = sorted(words)[::3]
    want = brute({w: words[w] for w in some})
    table = spark.createDataFrame([(w, words[w]) for w in some], "word string, n long")
    assert as_dict(spelling.group_variants(table).collect(), words) == want
    found = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    assert {r.word: r.n for r in found} == words


def test_messy_table(messy, no_rows):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    words = counted(rows)
    assert as_dict(spelling.spelling_variants(messy).collect(), words) == brute(words) and words
    assert spelling.spelling_variants(no_rows).collect() == []
