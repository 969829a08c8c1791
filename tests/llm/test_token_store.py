import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from breakwater.llm import token_store
from breakwater.session import ensure_checkpoint_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def expected(docs):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_round_trip(documents, spark, id_bytes):
    at = folder(spark)
    manifest = token_store.write(documents.repartition(3), at, PATH, id_bytes=id_bytes)
    want = expected([(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()])
    assert sorted(tuple(r) for r in token_store.read_back(manifest, at).collect()) == want
    found = token_store.lookup(spark, manifest, at, [0, 77, 10**9, -5])
    assert set(found) == {0, 77}
    assert zlib.crc32(found[77].tobytes()) == want[77][3]


def test_messy_table(messy, no_rows, spark):
    at = folder(spark)
    manifest = token_store.write(messy, at, PATH)
    rows = [tuple(r) for r in token_store.read_back(manifest, at).collect()]
    want = expected([(r.doc_id, r.text) for r in messy.collect()])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in rows) == sorted((w[0] is not None, w[0] or 0, w[2], w[3]) for w in want)
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in rows] == np.cumsum([0, *[r[2] for r in rows[:-1]]]).tolist()
    at = folder(spark)
    assert token_store.read_back(token_store.write(no_rows, at, PATH), at).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = token_store.PerfectHash.build(keys)
        assert sorted(index.places(keys).tolist()) == list(range(len(keys)))
        if n:
            bits = sum(8 * len(b) for b in index.levels)
            assert bits <= 5 * n + 64 * len(index.levels)


def test_rows_come_through_the_index(documents, spark, monkeypatch):
    """With an index that leads to the wrong records, the rows are wrong."""
    at = folder(spark)
    token_store.write(documents.limit(50).repartition(1), at, PATH)
    shard = next(s for s in (token_store.Shard(at, f"shard-{k:06d}.tok") for k in range(1)) if len(s.records) > 2)
    keys, records = next(token_store._found(shard))
    assert records.tolist() == list(range(len(shard.records))) and keys.tolist() == shard.records["key"].tolist()
    shard._table = np.roll(shard._table, 1)
    shard._table["fingerprint"][shard._hash.places(keys)] = token_store.fingerprints(keys)
    monkeypatch.setattr(shard, "records", shard.records)
    with pytest.raises(ValueError):
        list(token_store._found(shard))
