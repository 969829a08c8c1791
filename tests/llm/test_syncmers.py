import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breakwater.llm import syncmers


def brute(text, k, s):
    """Closed syncmers by definition, with the hashes of single s-mers and k-mers."""

    def h(part):
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        return int(syncmers._window_hashes(codes, len(codes))[0])

    out = []
    for i in range(len(text) - k + 1):
        inner = [h(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i : i + k])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeé ", min_size=12, max_size=60), st.sampled_from([(5, 2), (8, 3), (12, 5), (7, 7)]))
def test_anchors_by_definition(text, sizes):
    k, s = sizes
    at, hashes = syncmers.anchors(text, k, s)
    assert list(zip(at.tolist(), hashes.tolist(), strict=True)) == brute(text, k, s)


def test_anchors_do_not_depend_on_context_and_leave_no_gap():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    passage = word(400)
    at, hashes = syncmers.anchors(passage)
    moved, moved_hashes = syncmers.anchors(word(77) + passage + word(90))
    assert set(zip((at + 77).tolist(), hashes.tolist(), strict=True)) <= set(zip(moved.tolist(), moved_hashes.tolist(), strict=True))
    assert np.diff(at).max() <= syncmers.K - syncmers.S


def edited(docs):
    """doc -> (text, edited text, next text), sorted as the operator states."""
    out = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        out.append((doc, text, text[: len(text) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edited_texts(documents, parts):
    rows = syncmers.fingerprint_documents(documents.repartition(3), parts=parts).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(docs)
    for doc, text, new, after in edited(docs):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == syncmers.text_of(syncmers.sketch(text))
        assert r.near_edited == syncmers.likeness(syncmers.sketch(text), syncmers.sketch(new))
        assert r.near_next == syncmers.likeness(syncmers.sketch(text), syncmers.sketch(after))
    mean = np.mean([r.near_edited for r in rows if r.n_chars > 500])
    assert 0.4 < mean < 0.6


def test_messy_table(messy, no_rows):
    rows = syncmers.fingerprint_documents(messy, parts=4).collect()
    assert len(rows) == 12
    assert len({r.fingerprint for r in rows if r.n_chars == 74}) == 1
    assert {r.near_next for r in rows if r.n_chars == 0} <= {0.0, 1.0}
    assert [r.n_chars for r in rows if r.doc_id is None] == [20]
    assert syncmers.fingerprint_documents(no_rows).collect() == []


def test_only_null_ids(spark):
    t = spark.createDataFrame([(None, "one text here"), (None, "another one")], "doc_id long, text string")
    assert len(syncmers.fingerprint_documents(t, parts=3).collect()) == 2


def test_short_texts_without_anchors():
    rng = np.random.default_rng(16)
    texts = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, n)) for n in range(16, 22) for _ in range(40)]
    bare = [t for t in texts if not len(syncmers.anchors(t)[0])]
    assert {16, 17, 18} <= {len(t) for t in bare}
    sketches = [syncmers.sketch(t) for t in bare]
    assert all(len(x) for x in sketches) and len({syncmers.text_of(x) for x in sketches}) == len(set(bare))
    assert syncmers.likeness(sketches[0], sketches[1]) == 0.0 and syncmers.likeness(sketches[0], sketches[0]) == 1.0
    assert not len(syncmers.sketch(""))
