"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

Two words are one edit apart if their common prefix and suffix together reach the length of the
longer one, less one.  Words are padded rows of code points (Latin letters, a byte each); a tile
compares two blocks of rows at once, column by column.

One edit leaves the first half or the second half as it is, so a pair lies in a cell of equal
first halves or of equal second halves, for lengths l and l or l + 1; a cell of second halves
leaves out pairs with equal first halves, so a pair is met once.  A cell with more words than a
block is cut into blocks by a hash of the word, and each pair of blocks is a tile of its own,
in any task.  A tile hands on one row for each word: how many near words it has there and the best."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from . import common, hashing

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A planted slip: the code point that a hash names is lost in one of so many runs.
SLIP = 97
#: A form has so many times the occurrences of its variant.
FORM_TIMES = 2
#: Words of a block, and rows of it compared at once (so that a step stays in the cache).
BLOCK_WORDS, STEP_ROWS = 2048, 128
#: Text whose words are counted together, in bytes.
COUNT_BYTES = 8_000_000

# À to ÿ are two bytes in UTF-8, the first of them 0xC3, which begins no other character.
_LETTER = hashing.byte_class(range(0x41, 0x5B), range(0x61, 0x7B), 0xC3)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_CRC = reduce(lambda t, _: np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1), range(8), np.arange(256, dtype=np.uint32))
#: Longer runs are hashed one by one.
_TABLE_BYTES = 64


def _after_zeros(crc: np.ndarray) -> np.ndarray:
    """For each crc32 of a prefix and each length: what it adds to the crc32 of a text of that length."""
    out = np.empty((_TABLE_BYTES + 1, len(crc)), np.uint32)
    out[0] = crc
    for k in range(_TABLE_BYTES):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ _CRC[out[k] & np.uint32(255)]
    return out


def _count_block(ids: list[int | None], texts: list[bytes]) -> dict[str, int] | pa.Table:
    """(word, n) of the texts, slips made."""
    codes = _FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
    inside = _LETTER[codes]
    inside[1:] |= codes[:-1] == 0xC3
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return {}
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(codes[inside])).dictionary_encode()
    index, different = runs.indices.to_numpy(), runs.dictionary
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, begin, side="right")
    prefixes = [f"{'' if i is None else i}:".encode() for i in ids]
    shifted = _after_zeros(np.array([zlib.crc32(p) for p in prefixes], np.uint32))
    own = np.array([zlib.crc32(w.as_py().encode()) for w in different], np.uint32)
    short = size <= _TABLE_BYTES
    crc = shifted[np.minimum(size, _TABLE_BYTES), doc] ^ own[index]
    for k in np.flatnonzero(~short).tolist():
        crc[k] = zlib.crc32(prefixes[doc[k]] + different[int(index[k])].as_py().encode())
    slip = crc % np.uint32(SLIP) == 0
    counts = np.bincount(index[~slip], minlength=len(different))
    long_enough = pc.utf8_length(different).to_numpy(zero_copy_only=False) >= LEAST_CHARS
    found: dict[str, int] = {}
    for w, h in zip(index[slip].tolist(), crc[slip].tolist(), strict=True):
        word = different[w].as_py()
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_CHARS:
            found[word] = found.get(word, 0) + 1
    kept = np.flatnonzero((counts > 0) & long_enough)
    words = pa.concat_arrays([different.take(pa.array(kept)).cast(pa.string()), pa.array(list(found), pa.string())])
    return pa.table({"word": words, "n": pa.array(np.concatenate((counts[kept], np.fromiter(found.values(), np.int64, len(found)))), pa.int64())})


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of Latin letters of all texts, A-Z lower-cased, slips made, of five code
    points or more, with their occurrences, ``least`` or more.  A null text has none; a null
    id is an empty string in the hash that decides on slips."""
    src = common.renamed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def result():
            found = _count_block(ids, texts)
            if found:
                yield from found.to_batches(max_chunksize=100_000)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= COUNT_BYTES:
                    yield from result()
                    ids, texts, size = [], [], 0
        yield from result()

    counted = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def _matrix(words: list[bytes], width: int, right: bool) -> np.ndarray:
    out = np.zeros((width, len(words)), np.uint8)
    data = b"".join(w.rjust(width, b"\0") if right else w.ljust(width, b"\0") for w in words)
    out[:] = np.frombuffer(data, np.uint8).reshape(len(words), width).T
    return out


def compare(a: list[bytes], b: list[bytes], same: bool, half: int, prefix_cell: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words (code points as bytes) one edit apart, in a cell whose words have
    the first ``half`` code points in common (``prefix_cell``) or all code points from there on.
    The words of ``a`` have one length, those of ``b`` the same or one more.  ``same``: both are
    one block, and i is below j."""
    if not a or not b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide, shorter = len(b[0]), len(a[0])
    left_a, left_b = _matrix(a, shorter, False), _matrix(b, wide, False)
    right_a, right_b = left_a[::-1], left_b[::-1]
    out = []
    for at in range(0, len(a), STEP_ROWS):
        part = slice(at, at + STEP_ROWS)
        reach = np.zeros((len(left_a[0, part]), len(b)), np.uint8)
        for one, other, known in ((left_a, left_b, half if prefix_cell else 0), (right_a, right_b, 0 if prefix_cell else shorter - half)):
            reach += np.uint8(known)
            equal = np.ones(reach.shape, bool)
            for k in range(known, shorter):
                equal &= one[k, part, None] == other[k, None, :]
                if k % 2 and not equal.any():
                    break
                reach += equal
        near = reach >= wide - 1
        if not prefix_cell:
            near &= ~(left_a[:half, part, None] == left_b[:half, None, :]).all(axis=0)
        if same:
            near &= np.arange(len(b)) > np.arange(at, at + len(near))[:, None]
        i, j = np.nonzero(near)
        out.append((i + at, j))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _tile(length: int, prefix_cell: bool, own: bool, words: list[list[str]], counts: list[list[int]]) -> pa.Table | None:
    """Near words within one block (``own``) or between two, a row for each word that has any."""
    half = length // 2
    coded = [[w.encode("latin-1") for w in side] for side in words]
    by = [[[i for i, w in enumerate(side) if len(w) == n] for n in (length, length + 1)] for side in coded]
    pairs: list[tuple[int, int, int, int]] = []
    sides = [(0, 0, 0, 0), (0, 0, 0, 1)] if own else [(0, 0, 1, 0), (0, 0, 1, 1), (1, 0, 0, 1)]
    for s, p, t, q in sides:
        one, other = by[s][p], by[t][q]
        i, j = compare([coded[s][k] for k in one], [coded[t][k] for k in other], own and q == 0, half, prefix_cell)
        pairs += [(s, one[x], t, other[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    best: dict[tuple[int, int], list] = {}
    for s, x, t, y in pairs:
        for (u, k), (v, m) in (((s, x), (t, y)), ((t, y), (s, x))):
            rank = (-counts[v][m], words[v][m])
            row = best.setdefault((u, k), [0, rank])
            row[0] += 1
            row[1] = min(row[1], rank)
    if not best:
        return None
    rows = [(words[u][k], found, -rank[0], rank[1]) for (u, k), (found, rank) in best.items()]
    word, found, top_n, top = zip(*rows, strict=True)
    return pa.table({"word": word, "found": pa.array(found, pa.int64()), "top_n": pa.array(top_n, pa.int64()), "top": top})


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, top, top_n) of the words of (word, n) that have words one edit apart; the
    table has each word once.  ``top`` is the near word of the largest n, of equal ones the first."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda x: x >= LEAST_CHARS)
    dealt = words.select("word", "n", F.explode(lengths).alias("length"), F.explode(F.array(F.lit(True), F.lit(False))).alias("prefix"))
    half = F.floor(F.col("length") / 2).cast("int")
    shared = F.when(F.col("prefix"), F.substring("word", 1, half)).otherwise(F.expr("right(word, length - floor(length / 2))"))
    cells = common.stored(dealt.withColumn("shared", shared))
    keys = ["length", "prefix", "shared"]
    # only cells of several blocks are looked up: there are at most (rows / block_words) of them
    crowded = cells.groupBy(*keys).agg(F.ceil(F.count("*") / block_words).cast("int").alias("blocks")).filter("blocks > 1")
    placed = lookup_join(cells, crowded, keys).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")

    def run(batches):
        open_tile, sides = None, [[], []]
        held, rows = [], 0

        def result():
            length, prefix, _, i, j = open_tile
            if sides[0] or sides[1]:
                split = [list(zip(*s, strict=True)) if s else [[], []] for s in sides]
                found = _tile(length, prefix, i == j, [list(s[0]) for s in split], [list(s[1]) for s in split])
                if found is not None:
                    held.append(found)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*keys, "i", "j", "block", "word", "n")]
            for *tile, block, word, n in zip(*columns, strict=True):
                if tile != open_tile:
                    if open_tile is not None and len(sides[0]) + len(sides[1]) > 1:
                        result()
                        rows += len(held[-1]) if held else 0
                    open_tile, sides = tile, [[], []]
                sides[block != tile[3]].append((word, n))
                if rows > 50_000:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if open_tile is not None and len(sides[0]) + len(sides[1]) > 1:
            result()
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    by = [*keys, "i", "j"]
    found = tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "word string, found long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), "top"))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("best")).select("word", "n_near", "best.top", (-F.col("best.less")).alias("top_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): the last word that is reached over forms.  Every
    round doubles the steps; as n at least doubles with each form, a handful of rounds is enough."""
    reached = common.stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = reached.join(ahead, reached["root"] == ahead["at"], "left")
        new = common.stored(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        common.discard(reached)
        reached = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return reached
        reached = new.select("word", "root")


def group_variants(words: DataFrame, block_words: int = BLOCK_WORDS, form_times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).  The form of a word is
    its near word of the largest n (of equal ones the first in code-point order) if that has at
    least ``form_times`` its n; the root is the last word reached over forms."""
    near = near_words(words, block_words)
    has_form = F.col("top_n") >= form_times * F.col("n")
    found = common.stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("top")).alias("form"), F.when(has_form, F.col("top_n")).alias("form_n")
        )
    )
    rooted = roots(found.filter("form is not null"))
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``group_variants`` of the words of all texts (see ``count_words``).  Null and empty texts
    have no words; repeated rows count again; words of any length are whole; other columns are
    ignored; an empty table gives no rows."""
    words = common.stored(count_words(docs, id_col, text_col))
    return group_variants(words, block_words)
