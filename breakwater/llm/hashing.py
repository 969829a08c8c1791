"""Hashes of words and of runs of words in whole texts, in memory that does not grow with a text.

Bytes are looked at in pieces of fixed size; a word that a piece's end cuts is carried on, so
texts and words of any length give the hashes that they would give in one piece."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes looked at together.
PIECE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 2**64))


def byte_class(*members: int | range) -> np.ndarray:
    """Which of the 256 bytes are among ``members``."""
    out = np.zeros(256, bool)
    for m in members:
        out[m] = True
    return out


#: All bytes but space and 0x09 to 0x0D.
NOT_SPACE = ~byte_class(32, range(9, 14))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words(codes: np.ndarray, member: np.ndarray, finish: Callable[[np.ndarray], np.ndarray] = mix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes of a class: their hashes, and where they begin and end."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cut = None  # begin and sum of a run that the end of the last piece cut
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE]
        inside = member[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # sum of code * factor ** place up to each place; a run's part of it, moved to place 0
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        sums = (total[end] - total[begin]) * _DOWN[begin]
        begin, end = begin + at, end + at
        if cut is not None:
            if inside[0]:
                begin[0] = cut[0]
                sums[0] = (cut[1] + int(sums[0]) * pow(_FACTOR, at - cut[0], 2**64)) & _MASK
            else:
                found.append((np.array([cut[1]], np.uint64), np.array([cut[0]]), np.array([at])))
        cut = (int(begin[-1]), int(sums[-1])) if inside[-1] and at + len(part) < len(codes) else None
        stop = len(sums) - (cut is not None)
        found.append((sums[:stop], begin[:stop], end[:stop]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return finish(sums), begin, end


class Block:
    """The words of several texts: ``codes`` are their bytes with a line feed between them,
    ``first[i]`` is the number of the first word of text i (``first[-1]``: of all words)."""

    def __init__(self, texts: list[bytes], member: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None):
        self.codes = np.frombuffer(b"\n".join(texts), np.uint8)
        if fold is not None:
            self.codes = fold[self.codes]
        self.hashes, self.begin, self.end = words(self.codes, member)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.begin, self.at)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every run of ``size`` words inside a text: the number of the text and of the first word."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return text, self.first[text] + place


def rolled(hashes: np.ndarray, size: int, factor: int = 0xD1B54A32D192ED03) -> np.ndarray:
    """A hash of ``hashes[i : i + size]`` for each i, made of runs of 1, 2, 4, ... hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, hashes, 1
    while True:
        if size & width:
            if out is None:
                out = power[:]
            else:
                k = len(hashes) - done - width + 1
                out = out[:k] * np.uint64(pow(factor, width, 2**64)) + power[done : done + k]
            done += width
        if done == size:
            return mix(out[:n])
        power = power[: len(power) - width] * np.uint64(pow(factor, width, 2**64)) + power[width:]
        width *= 2
