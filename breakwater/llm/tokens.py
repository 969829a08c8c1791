"""Token ids of whole texts with the tokenizers library, each different word encoded once.

Both public vocabularies cut a text before every space or newline that follows something
else, so a text is encoded as the concatenation of its segments: a run of spaces and
newlines with the word behind it.  The segments of a block are made different by Arrow,
the new ones are encoded together (with a special token between them), and ids are laid
out by numpy.  Texts that hold other white space or a piece of a special token go through
the library whole, as the boundary may not hold there."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import blocks, keep

#: What a worker may remember of words and their ids, in bytes; a word takes its length, its ids
#: and about so much besides.
CACHE_BYTES, WORD_BYTES = 80_000_000, 200
#: Characters of texts that are encoded together, about.
BLOCK_CHARS = 2_000_000
#: Different words that go through the library in one call.
JOINED = 512

_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
# First bytes, in UTF-8, of the characters above.
_LEADS = np.zeros(256, bool)
_LEADS[[*range(10), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _may_have_other_space(texts: list[str]) -> bool:
    return bool(_LEADS[np.frombuffer("".join(texts).encode("utf-8"), np.uint8)].any())


class Encoder:
    """``ids(texts)``: for each text its ids, as one numpy array of 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.between, self.between_id = special[-1] if special else (None, None)
        self.special = sorted({text[:2] for text, _ in special})
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _new(self, words: list[str]) -> dict[str, bytes]:
        if not self.between:
            found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}
        out = {}
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            # one call after the other: what the library makes of a text is far larger than its ids
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)]
            start = 0
            for word, end in zip(part, ends, strict=True):
                out[word] = ids[start:end].tobytes()
                start = end + 1
        return out

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text ends among them."""
        data = np.frombuffer("".join(texts).encode("utf-8"), np.uint8)
        ends = np.cumsum([len(t.encode("utf-8")) for t in texts])
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        space = (data == 32) | (data == 10)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[0] = True
        cut[ends] = True
        at = np.flatnonzero(cut).astype(np.int32)  # the last one is the end
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        index = words.indices.to_numpy()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        each = [known.get(w) for w in different]
        missing = [i for i, found in enumerate(each) if found is None]
        fresh = self._new([different[i] for i in missing])
        for i in missing:
            each[i] = fresh[different[i]]
        more = sum(map(len, fresh)) + sum(map(len, fresh.values())) + WORD_BYTES * len(fresh)
        # the first words to come are the frequent ones
        if self.known_bytes + more <= CACHE_BYTES:
            known.update(fresh)
            self.known_bytes += more
        ids = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(size) - size
        sizes = size[index]
        out_end = np.cumsum(sizes)
        out = ids[np.repeat(first[index] - (out_end - sizes), sizes) + np.arange(out_end[-1])]
        word_of = np.searchsorted(at, ends)  # words before the end of each text
        return out, np.concatenate(([0], out_end))[word_of]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for start, end in blocks(texts, BLOCK_CHARS):
            part = texts[start:end]
            odd = _OTHER_SPACE.search("\n".join(part)) if _may_have_other_space(part) else None
            whole = {
                i: self._whole(t)
                for i, t in enumerate(part)
                if odd and _OTHER_SPACE.search(t) or any(m in t for m in self.special)
            }
            ids, ends = self._block(["" if i in whole else t for i, t in enumerate(part)])
            at = 0
            for i, stop in enumerate(ends.tolist()):
                yield whole[i] if i in whole else ids[at:stop]
                at = stop


def encoder(path: str) -> Encoder:
    """The encoder of this worker for the vocabulary file at ``path`` (a local file that
    every executor has)."""
    return keep(path, lambda: Encoder(path))
