import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from breakwater.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, capacity):
    """Pieces are those of the tokenizer, and sequences hold together."""
    t = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(by), -(-total // capacity)


def test_documents(documents):
    rows = packing.pack(documents.repartition(3), PATH).collect()
    used, least = check([(r.doc_id, r.text) for r in documents.collect()], rows, 4096)
    assert used <= least + 3


def test_rounds_of_packing(documents):
    # small tasks, few open bins: several rounds, the same pieces
    rows = packing.pack(documents.repartition(8), PATH, capacity=512, open_bins=4, repack_pieces=40).collect()
    used, least = check([(r.doc_id, r.text) for r in documents.collect()], rows, 512)
    assert used <= 1.05 * least + 4


def test_messy_table(messy, no_rows):
    rows = packing.pack(messy, PATH, capacity=64).collect()
    check([(r.doc_id, r.text) for r in messy.collect()], rows, 64)
    assert packing.pack(no_rows, PATH).collect() == []


def test_bins_are_best_fit():
    rng = random.Random(5)
    bins = packing.OpenBins(100, 5)
    free: dict[int, int] = {}  # by definition: tightest open bin; the fullest closes
    for _ in range(2000):
        size = rng.choice((1, 3, 10, 40, 60, 99, 100))
        fitting = [f for f in free.values() if f >= size]
        at, offset, closed = bins.put(size)
        if fitting:
            assert free[at] == min(fitting) and offset == 100 - free[at]
            free[at] -= size
        else:
            if len(free) == 5 and size < 100:
                assert free[closed] == min(free.values())
                del free[closed]
            assert offset == 0
            free[at] = 100 - size
        if not free[at]:
            del free[at]
        assert len(free) == bins.open <= 5
