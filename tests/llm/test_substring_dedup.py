import random

import numpy as np
import pytest
from breakwater.llm import hashing, queries, substring_dedup as sd


def brute(rows):
    """doc_id -> (text that stays, words, removed), by a dictionary of all windows."""
    words = [(i, t.replace("\t", " ").replace("\n", " ").split(" ") if t else []) for i, t in rows]
    words = [(i, [w for w in ws if w]) for i, ws in words]
    seen, out = set(), {}
    for i, ws in sorted(words, key=lambda r: r[0]):
        gone = set()
        for at in range(len(ws) - 19):
            window = tuple(ws[at : at + 20])
            if window in seen:
                gone |= set(range(at, at + 20))
            seen.add(window)
        out[i] = (" ".join(w for k, w in enumerate(ws) if k not in gone), len(ws), len(gone))
    return out


def planted(n=60, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(1, 4)
    passages = [[word() for _ in range(k)] for k in (19, 20, 21, 33, 60)]
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        if i % 7 == 3 and rows:
            ws = rows[rng.randrange(len(rows))][1].split()
            if i % 2:
                ws[len(ws) // 2 : len(ws) // 2] = ["changed"]
        rows.append((i * 3 - 20, rng.choice((" ", "\n", " \t ")).join(ws)))
    rows.append((500, " ".join(["again"] * 75)))  # windows of one document that overlap
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1_000_000, 500])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK_ROWS", chunk)
    rows = planted()
    found = sd.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.text, r.n_words, r.n_removed) for r in found} == brute(rows)
    assert sum(r.n_removed for r in found) > 500


def test_cover_aligns_any_two_places():
    for a in range(13):
        for b in range(13):
            assert any((a + s) % sd.PERIOD in sd.COVER and (b + s) % sd.PERIOD in sd.COVER for s in range(sd.WINDOW - sd.ANCHOR + 1))


def test_pieces_do_not_change_hashes(monkeypatch):
    text = ("short " + "x" * 3000 + " y\t" + "zé" * 700 + "  end").encode()
    codes = np.frombuffer(text, np.uint8)
    whole = hashing.words(codes, hashing.NOT_SPACE)
    monkeypatch.setattr(hashing, "PIECE", 64)
    cut = hashing.words(codes, hashing.NOT_SPACE)
    for a, b in zip(whole, cut, strict=True):
        assert a.tolist() == b.tolist()
    assert [text[i:j] for i, j in zip(cut[1], cut[2], strict=True)] == text.split()


def test_rolled_is_the_hash_of_a_run():
    h = hashing.mix(np.arange(100, dtype=np.uint64) % np.uint64(7))
    for size in (1, 8, 20):
        r = hashing.rolled(h, size)
        assert len(r) == 101 - size
        assert all((r[i] == r[j]) == (h[i : i + size] == h[j : j + size]).all() for i in range(20) for j in range(20))


def test_messy_table(messy, no_rows, spark):
    found = sd.drop_repeats(messy).collect()
    assert len(found) == messy.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].text is None and by[3][0].n_words == 0
    assert by[4][0].text == "" and by[5][0].text == ""
    (long,) = by[7]
    assert long.n_words == 48_000 and long.n_removed == 47_992  # a phrase of eight words, over and over
    assert len(by[1]) == 2 and by[1][0] == by[1][1]  # rows equal in id and text are one document
    assert by[None][0].n_removed == 0
    assert sd.drop_repeats(no_rows).collect() == []


def test_ties_of_ids_and_null_ids(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(None, a), (4, a), (4, a + " tail"), (4, a), (2, "few words")]
    found = sd.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = [(r.doc_id, r.n_words, r.n_removed) for r in found]
    assert (None, 30, 30) in of  # a null id comes last
    four = sorted(x for x in of if x[0] == 4)
    # of two different texts under one id one comes first; equal rows have equal results
    assert four in ([(4, 30, 0), (4, 30, 0), (4, 31, 30)], [(4, 30, 30), (4, 30, 30), (4, 31, 0)])


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLES["op11_substring_dedup"]).fetchall())
    got = queries.QUERIES["op11_substring_dedup"](spark, sf)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
