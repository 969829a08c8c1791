"""Ranked lexical search by NRA: impact-sorted lists read in sequence, no random access.

Statistics (documents, terms, document frequencies) are sums over all documents.  Documents
then lie in shards, each a part of a task; a shard sorts the impacts of every term and reads
the lists of an item's terms from the top, a block of rows at a time.  A document's score lies
between the impacts read for it and that plus, for each list in which it has not been met, the
last impact read there.  Reading goes on until no other document can reach the best ones or tie
with them, and their own intervals are closed.  The best of all shards are the best of all.

Items are taken in blocks of bounded size, each against all documents, so what is broadcast (the
terms of a block) does not grow with the benchmark or the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import first_rows
from . import common, hashing

TOP = 50
#: Items of a block, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 4000, 16_000_000
#: Postings of a shard.
SHARD_POSTINGS = 2_000_000
#: Rows of each list that are read first; every further read is twice as deep.
FIRST_DEPTH = 128

#: Bytes of a term: ASCII letters and digits, and all bytes of other characters.
TERM = hashing.byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def _blocks(column: pa.Array) -> Iterator[tuple[int, hashing.Block]]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    for start, end in common.blocks(texts):
        yield start, hashing.Block(texts[start:end], TERM, FOLD)


def item_terms(texts: list[str | None]) -> list[np.ndarray]:
    """The different terms of each text, as hashes."""
    block = hashing.Block([(t or "").encode("utf-8", "surrogatepass") for t in texts], TERM, FOLD)
    return [np.unique(block.hashes[a:b]) for a, b in zip(block.first[:-1], block.first[1:], strict=True)]


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row per row of (doc_id, text): doc_id, n (terms with repeats), terms (numbers in the
    sorted ``vocabulary``) and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(b):
        known = shared.value
        for start, block in _blocks(b.column("text")):
            n = len(block.first) - 1
            place = np.minimum(np.searchsorted(known, block.hashes), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[place] == block.hashes) if len(known) else np.zeros(0, np.int64)
            text = np.searchsorted(block.first, hit, side="right") - 1
            key, tf = np.unique(text * max(len(known), 1) + place[hit], return_counts=True)
            ends = np.searchsorted(key, np.arange(n + 1) * max(len(known), 1))
            term = key - np.repeat(np.arange(n) * max(len(known), 1), np.diff(ends))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id")[start : start + n],
                    pa.array(np.diff(block.first), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    return common.map_batches(docs, each, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """The impact-sorted lists of some documents, in the order of their ids."""

    def __init__(self, ids: list[int | None], n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, count: int):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids = [ids[i] for i in order]
        # 64-bit integers, divided as the score says
        m = 50 + (50 * n * count) // max(total, 1)
        doc = np.repeat(np.arange(len(ids)), sizes)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        by = np.lexsort((-impact, terms))
        self.doc, self.impact = rank[doc[by]], impact[by]
        self.start = np.searchsorted(terms[by], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, top: int = TOP, first_depth: int = FIRST_DEPTH) -> Iterator[tuple[int | None, int]]:
        """The ``top`` documents of an item: NRA over the lists of its terms."""
        lists = [(int(self.start[t]), int(self.start[t + 1])) for t in terms.tolist()]
        lists = [(a, b) for a, b in lists if a < b and self.impact[a] > 0]
        lower = np.zeros(len(self.ids), np.int64)
        met = [np.zeros(len(self.ids), bool) for _ in lists]
        at, depth = [a for a, _ in lists], first_depth
        while True:
            last = []
            for k, (a, b) in enumerate(lists):
                end = min(b, a + depth)
                new = slice(at[k], end)
                # a list names a document once
                lower[self.doc[new]] += self.impact[new]
                met[k][self.doc[new]] = True
                at[k] = end
                last.append(0 if end == b else int(self.impact[end - 1]))
            open_lists = [k for k, x in enumerate(last) if x]
            above = np.zeros(len(lower), np.int64)  # by how much a score may exceed what was read
            for k in open_lists:
                above += np.where(met[k], 0, last[k])
            order = np.lexsort((np.arange(len(lower)), -lower))[:top]
            order = order[lower[order] > 0]
            least = int(lower[order[-1]]) if len(order) == top else 0
            others = np.ones(len(lower), bool)
            others[order] = False
            rivals = others & (above > 0) & (lower + above >= max(least, 1))
            if not (above[order] > 0).any() and not rivals.any():
                return ((self.ids[i], int(lower[i])) for i in order)
            depth *= 2


def search_block(stored: DataFrame, items: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, top: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every shard for each item."""
    count, total = stored.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    count, total = int(count or 0), int(total or 0)
    # a row for each term of the block
    found = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in found:
        weights[r["term"]] = math.floor(1000 * math.log((2 * count + 2) / (2 * r["df"] + 1)))
    shared = stored.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        held, size = [], 0

        def result(held):
            ids = [i for h in held for i in h[0]]
            shard = Shard(ids, *(np.concatenate([h[k] for h in held]) for k in range(1, 5)), weights, total, count)
            rows = [(number, *r) for number, terms in items for r in shard.best(terms, top)]
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

        for b in batches:
            terms = b.column("terms")
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((b.column("doc_id").to_pylist(), b.column("n").to_numpy().copy(), sizes, terms.flatten().to_numpy().copy(), b.column("tfs").flatten().to_numpy().copy()))
            size += int(sizes.sum()) + len(sizes)
            if size >= shard_postings:
                yield from result(held)
                held, size = [], 0
        if held:
            yield from result(held)

    return stored.filter(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with a score above 0 for each item,
    equal scores by ascending doc_id.

    Null texts have no terms: such documents are never found and such items find nothing.
    Documents without an id come after the others of their score; rows of equal id are
    documents of their own.  Rows of ``items`` with equal ids are items of their own, each
    with its own ranks.  Other columns are ignored; either table may be empty.  Terms are
    compared by 64-bit hashes."""
    spark = docs.sparkSession
    src = common.renamed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    asked = common.renamed(items, item_id=F.col(f"`{item_col}`").cast("long"), text=F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")))
    asked = common.numbered(asked, ["item_id", "text"], name="item")
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-n // block_items), -(-int(size or 0) // block_bytes))
    best = None
    for k in range(n_blocks):
        rows = asked.filter(F.pmod("item", F.lit(n_blocks)) == k).select("item", "text").collect()
        hashes = item_terms([r["text"] for r in rows])
        vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        numbered = [(r["item"], np.searchsorted(vocabulary, h)) for r, h in zip(rows, hashes, strict=True)]
        stored = common.stored(postings(src, vocabulary))
        found = common.stored(search_block(stored, numbered, vocabulary, top, shard_postings))
        common.discard(stored)
        best = found if best is None else best.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # shards' best are narrowed in salted rounds, so one item's rows never meet in one task before they are few
    few = first_rows(best, ["item"], order, top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dl),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, nn),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM it JOIN w USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, tot GROUP BY item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
