"""Removal of passages that stand elsewhere, found through difference-cover anchors.

A window of 20 words is removed where the same words begin earlier, in a document before or
in the same one.  Hashing every window would deal out more than the corpus itself, so runs of
8 words are hashed only at places whose remainder modulo 13 is in the difference cover
{0, 1, 3, 9}: for any two places there is a shift below 13 that takes both into the cover, and
8 + 12 words are a window.  So two equal windows share an aligned anchor, wherever they stand.

1. Anchors are dealt by hash.  Those that occur at two places or more are marks.
2. Marks return to their texts and are extended to the windows around them; only these windows
   are hashed whole (128 bits) and dealt.  The earliest of equal windows stays.
3. The others return to their documents as runs of words to be left out.

Equal texts are settled before: the first one stands for all, and of the others every word
goes (if there are 20).  An anchor or window that stands in a third of all documents is no hot key:
each task sends one row of it for each of its chunks and settles the other ones itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

WINDOW = 20
ANCHOR, PERIOD, COVER = 8, 13, (0, 1, 3, 9)
#: Rows that a task looks at together before it sends them out.
CHUNK_ROWS = 1_000_000
#: Rows of a batch handed to Spark.
BATCH_ROWS = 100_000
_FACTORS = (0xD1B54A32D192ED03, 0xA24BAED4963EE407)
#: Kinds of dealt rows: one place; a key known to have several places; a settled place.
PLACE, KNOWN, SETTLED = 0, 1, 2


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of about BLOCK_CHARS bytes, with the number of the first."""
    parts = [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    for start, end in common.blocks(parts):
        yield start, parts[start:end]


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, BATCH_ROWS):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[at : at + BATCH_ROWS]) for k, v in columns.items()})


def _grouped(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def anchors_of(block: hashing.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and hash of every anchor."""
    text, word = block.runs(ANCHOR)
    place = word - block.first[text]
    covered = np.isin(place % PERIOD, COVER)
    text, word, place = text[covered], word[covered], place[covered]
    return text, place, hashing.rolled(block.hashes, ANCHOR)[word]


def _anchor_rows(key: np.ndarray, text: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key, kind="stable")
    key, text, pos = key[order], text[order], pos[order]
    new = _grouped(key)
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    several = np.repeat(size > 1, size)
    sent = new  # of each key one row, which says whether there are more
    kind = np.where(several[sent], KNOWN, PLACE).astype(np.int8)
    settled = {"key": hashing.mix(text[several].view(np.uint64)).view(np.int64), "kind": np.full(several.sum(), SETTLED, np.int8), "text": text[several], "pos": pos[several]}
    yield from _batches({"key": key[sent].view(np.int64), "kind": kind, "text": text[sent], "pos": pos[sent]})
    yield from _batches(settled)


def _find_anchors(batches):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows, seen = 0, set()
    for b in batches:
        names = b.column("t1").to_numpy()
        for start, texts in _texts(b.column("text")):
            # equal texts of a chunk are looked at once
            fresh = [i for i in range(len(texts)) if not (int(names[start + i]) in seen or seen.add(int(names[start + i])))]
            block = hashing.Block([texts[i] for i in fresh])
            text, pos, key = anchors_of(block)
            held.append((key, names[start + np.array(fresh, np.int64)][text] if len(text) else np.zeros(0, np.int64), pos.astype(np.int32)))
            rows += len(key)
            if rows >= CHUNK_ROWS:
                yield from _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, rows, seen = [], 0, set()
    if rows:
        yield from _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _marks(batches):
    """Places of anchors that have several, from rows sorted by key and falling kind."""
    carry = None
    for b in batches:
        key, kind, text, pos = (b.column(c).to_numpy() for c in ("key", "kind", "text", "pos"))
        done = kind == SETTLED
        yield from _batches({"text": text[done], "pos": pos[done]})
        columns = [x[~done] for x in (key, kind, text, pos)]
        if not len(columns[0]):
            continue
        if carry is not None:
            columns = [np.concatenate((c, x)) for c, x in zip(carry, columns, strict=True)]
        key, kind, text, pos = columns
        new = _grouped(key)
        starts = np.flatnonzero(new)
        places = np.where(kind == KNOWN, 2, _grouped(key, text, pos))
        several = np.add.reduceat(places, starts) > 1
        out = np.repeat(several, np.diff(np.append(starts, len(key)))) & (kind == PLACE)
        yield from _batches({"text": text[out], "pos": pos[out]})
        # what the next batch has to know of the last group
        last = starts[-1]
        carry = [x[last : last + 1].copy() for x in columns]
        if several[-1]:
            carry[1][:] = KNOWN


def _packed(df: DataFrame, key: str, each, name: str) -> DataFrame:
    """One row for each ``key`` with what ``each`` makes of its sorted places, no more of
    which there are than words in a text."""

    def run(batches):
        open_key, parts = None, []

        def result(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()), pa.array([each(p) for _, p in found], pa.list_(pa.int32()))], [key, name]
            )

        for b in batches:
            keys, pos = b.column(key).to_numpy(), b.column("pos").to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(_grouped(keys))
            found = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                if keys[start] != open_key:
                    if parts:
                        found.append((open_key, np.concatenate(parts)))
                    open_key, parts = int(keys[start]), []
                parts.append(pos[start:end].copy())
            if found:
                yield result(found)
        if parts:
            yield result([(open_key, np.concatenate(parts))])

    return df.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(run, f"{key} long, {name} array<int>")


def _window_rows(h1: np.ndarray, h2: np.ndarray, node: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((pos, node, h2, h1))
    h1, h2, node, pos = h1[order], h2[order], node[order], pos[order]
    first = _grouped(h1, h2)
    # within the chunk an equal window stands earlier (a repeated row of a table is the same place)
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (node != node[start]) | (pos != pos[start])
    settled = np.full(later.sum(), SETTLED, np.int8)
    none = np.zeros(len(settled), np.int64)
    yield from _batches({"h1": h1[first].view(np.int64), "h2": h2[first].view(np.int64), "kind": np.zeros(first.sum(), np.int8), "node": node[first], "pos": pos[first]})
    yield from _batches({"h1": hashing.mix(node[later].view(np.uint64)).view(np.int64), "h2": none, "kind": settled, "node": node[later], "pos": pos[later]})


def windows_of(block: hashing.Block, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a mark among their aligned anchors: number of the text, number of the first word."""
    edge = np.zeros(len(block.hashes) + 1, np.int32)
    for i, own in enumerate(marks):
        first, stop = int(block.first[i]), int(block.first[i + 1])
        own = own[own < stop - first]
        np.add.at(edge, first + np.maximum(own - (WINDOW - ANCHOR), 0), 1)
        np.add.at(edge, first + own + 1, -1)
    near = np.cumsum(edge) > 0
    text, word = block.runs(WINDOW)
    keep = near[word]
    return text[keep], word[keep]


def _find_windows(batches):
    held, rows = [], 0
    for b in batches:
        nodes = b.column("node").to_numpy()
        for start, texts in _texts(b.column("text")):
            block = hashing.Block(texts)
            marks = [b.column("marks")[start + i].values.to_numpy() for i in range(len(texts))]
            text, word = windows_of(block, marks)
            h1, h2 = (hashing.rolled(block.hashes, WINDOW, f) for f in _FACTORS)
            held.append((h1[word], h2[word], nodes[start + text], (word - block.first[text]).astype(np.int32)))
            rows += len(word)
            if rows >= CHUNK_ROWS:
                yield from _window_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, rows = [], 0
    if rows:
        yield from _window_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _later(batches):
    """All places of equal windows but the earliest, from rows sorted by hash and place."""
    carry = None  # hash and place of the earliest window of the last group
    for b in batches:
        h1, h2, kind, node, pos = columns = [b.column(c).to_numpy() for c in ("h1", "h2", "kind", "node", "pos")]
        done = kind == SETTLED
        yield from _batches({"node": node[done], "pos": pos[done]})
        columns = [x[~done] for x in columns]
        if not len(columns[0]):
            continue
        if carry is not None:
            columns = [np.concatenate((c, x)) for c, x in zip(carry, columns, strict=True)]
        h1, h2, _, node, pos = columns
        first = _grouped(h1, h2)
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (node != node[start]) | (pos != pos[start])
        yield from _batches({"node": node[later], "pos": pos[later]})
        carry = [x[start[-1] : start[-1] + 1].copy() for x in columns]


def _as_runs(pos: np.ndarray) -> np.ndarray:
    """Begins and ends, in turn, of the words that windows at these sorted places cover."""
    apart = np.flatnonzero(np.diff(pos) > WINDOW)
    begin = pos[np.concatenate(([0], apart + 1))]
    end = pos[np.append(apart, len(pos) - 1)] + WINDOW
    return np.stack((begin, end), axis=1).ravel()


def _kept(texts: list[bytes], runs: list[np.ndarray | None], copies: list[bool]) -> Iterator[tuple[str, int, int]]:
    """The words of each text that stay, joined by a space, how many there were and how many went."""
    block = hashing.Block(texts)
    n = np.diff(block.first)
    gone = np.zeros(len(block.hashes) + 1, np.int8)
    for i, own in enumerate(runs):
        if copies[i]:
            own = np.array([0, n[i]]) if n[i] >= WINDOW else None
        if own is not None:
            np.add.at(gone, block.first[i] + own[0::2], 1)
            np.add.at(gone, block.first[i] + own[1::2], -1)
    stays = np.cumsum(gone[:-1], dtype=np.int8) == 0
    # the byte behind a word is white space and becomes the space after it
    edge = np.zeros(len(block.codes) + 2, np.int8)
    np.add.at(edge, block.begin[stays], 1)
    np.add.at(edge, block.end[stays] + 1, -1)
    chosen = np.cumsum(edge[: len(block.codes)], dtype=np.int8) > 0
    codes = np.where(hashing.NOT_SPACE[block.codes], block.codes, np.uint8(32))
    kept = np.concatenate(([0], np.cumsum(stays)))[block.first]
    for i, (start, end) in enumerate(zip(block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)):
        own = codes[start:end][chosen[start:end]].tobytes()
        left = int(kept[i + 1] - kept[i])
        yield own.removesuffix(b" ").decode("utf-8", "surrogatepass"), int(n[i]), int(n[i]) - left


def _repeated_anchors(src: DataFrame) -> DataFrame:
    """(text, marks): the places in each text of anchors that stand at several places."""
    dealt = src.select("t1", "text").mapInArrow(_find_anchors, "key long, kind byte, text long, pos int")
    met = dealt.repartition("key").sortWithinPartitions("key", F.desc("kind"), "text", "pos").mapInArrow(_marks, "text long, pos int")
    return common.stored(_packed(met, "text", np.unique, "marks"))


def _repeated_runs(src: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, runs): the words of each node's text that equal windows before it cover."""
    own = (src["t1"] == nodes["t1"]) & (src["t2"] == nodes["t2"]) & src["doc_id"].eqNullSafe(nodes["doc_id"])
    read = src.join(nodes, own).select("node", "text", "marks")
    dealt = read.mapInArrow(_find_windows, "h1 long, h2 long, kind byte, node long, pos int")
    later = dealt.repartition("h1").sortWithinPartitions("h1", "h2", "kind", "node", "pos").mapInArrow(_later, "node long, pos int")
    return common.stored(_packed(later, "node", lambda p: _as_runs(np.unique(p)), "runs"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, text (the words that stay, joined by one space), n_words, n_removed.

    Words are runs of anything but space and 0x09 to 0x0D.  Documents follow each other by
    id, null ids last, documents of one id by a hash of their text; rows equal in id and text
    are one document and get the same result.  A null text has no words and gives a null text.
    Texts of any length are whole; other columns are ignored; an empty table gives no rows."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = common.renamed(
        docs,
        doc_id=F.col(f"`{id_col}`").cast("long"),
        text=text,
        t1=F.xxhash64(text),
        t2=F.xxhash64(F.lit(7), text),
        none=F.col(f"`{text_col}`").isNull(),
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    firsts = common.stored(src.groupBy("t1", "t2").agg(F.min(place).alias("p")).select("t1", "t2", "p.doc_id", F.col("p.last").alias("last")))

    marks = _repeated_anchors(src)
    marked = firsts.join(marks, firsts["t1"] == marks["text"]).select("t1", "t2", "doc_id", "last", "marks")
    nodes = common.numbered(marked, ["last", "doc_id", "t1", "t2"], name="node")
    common.free_shuffles(marks)
    runs = _repeated_runs(src, nodes)
    common.discard(marks)
    common.free_shuffles(runs)

    placed = nodes.join(runs, "node").select("t1", "t2", "doc_id", "runs")
    same = (firsts["t1"] == placed["t1"]) & (firsts["t2"] == placed["t2"]) & firsts["doc_id"].eqNullSafe(placed["doc_id"])
    verdicts = firsts.join(placed, same, "left").select(firsts["t1"], firsts["t2"], firsts["doc_id"], "runs", F.lit(True).alias("first"))
    own = (src["t1"] == verdicts["t1"]) & (src["t2"] == verdicts["t2"]) & src["doc_id"].eqNullSafe(verdicts["doc_id"])
    judged = src.join(verdicts, own, "left").select(src["doc_id"], "text", "none", "runs", F.col("first").isNull().alias("copy"))

    def keep(batches):
        for b in batches:
            copies, empty = b.column("copy").to_pylist(), b.column("none").to_pylist()
            for start, texts in _texts(b.column("text")):
                runs = [None if r is None else r.values.to_numpy() for r in (x if x.is_valid else None for x in b.column("runs")[start : start + len(texts)])]
                out = list(_kept(texts, runs, copies[start : start + len(texts)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[start : start + len(texts)],
                        pa.array([None if empty[start + i] else t for i, (t, _, _) in enumerate(out)], pa.string()),
                        pa.array([n for _, n, _ in out], pa.int64()),
                        pa.array([g for _, _, g in out], pa.int64()),
                    ],
                    ["doc_id", "text", "n_words", "n_removed"],
                )

    return judged.mapInArrow(keep, "doc_id long, text string, n_words long, n_removed long")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w WHERE len(ws) > 0),
win AS (SELECT doc_id, pos, array_to_string(ws[pos:(pos + 19)], ' ') AS s FROM p WHERE pos + 19 <= len(ws)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM ranked WHERE k > 1),
kept AS (
  SELECT p.doc_id, count(gone.pos) AS n_removed,
    coalesce(string_agg(p.ws[p.pos], ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL), '') AS rest
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
