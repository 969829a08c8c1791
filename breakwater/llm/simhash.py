"""SimHash near-duplicates through an embedding of bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its segments.  The Manhattan
distance of two such vectors never exceeds the number of differing bits, so it bounds the
distance from below.  The coordinates form groups: a Manhattan distance of ``bits`` or less
leaves all but ``bits`` groups equal, so two close fingerprints meet in the grid cell of at
least one choice of (groups - bits) groups, and the range join needs no neighbouring cells.
In a cell the Manhattan bound is checked over all coordinates, then the bits themselves.

Only different fingerprints enter the join, one row for each however many documents have
it.  A cell yields a forest, not pairs: members are reached from one another, and each that
is reached leaves the cell, so close copies cost one step and one row each.  Which cells
are made depends on the number of fingerprints only through the number of groups, which
balances rows against chance meetings; any number gives the same links."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from . import common, hashing

SEED = 42
WORDS = 4
BITS = 4
SEGMENT_BITS = 2
GROUPS = range(7, 13)
#: Near copies by likeness: words of a shingle, the least Jaccard similarity of the sets of
#: shingles, and the bits by which fingerprints of such texts may differ (10 on average, 12
#: for sets of five, each with a deviation of 3).
COPY_WORDS, COPY_LEAST, COPY_BITS = 5, 0.8, 28
#: Texts meet that have the same least hashes under all functions of a band.  Of pairs at
#: 0.8, a part of (1 - 0.8 ** 4) ** 16 = 0.0002 meets in no band.
BANDS, BAND_ROWS = 16, 4
#: Bytes of sets that meet in one task: cells with more are compared block by block.
CELL_BYTES = 16_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FOLD = np.frombuffer(_LOWER, np.uint8)


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Hashes of a text's shingles, repeats included (none without words)."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    # bytes.split() cuts at exactly the six white-space bytes 0x09-0x0D and 0x20
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    if n <= 1:
        return [digest(joined, SEED)]
    starts = np.cumsum([0, *map(len, parts)]) + np.arange(len(parts) + 1)
    begin, end = starts[:n].tolist(), (starts[words:] - 1).tolist()
    return [digest(joined[b:e], SEED) for b, e in zip(begin, end, strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bits that are set in more than half of the hashes (0 without any)."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text over its shingles, repeats included (0 without words)."""
    return majority(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit number.  A null text is empty."""
    src = common.renamed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def each(b):
        found = [signed(fingerprint(t.as_py(), words)) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return common.map_batches(src, each, "doc_id long, fp long")


def groups_for(n: int, bits: int = BITS) -> int:
    """How many groups cost least for ``n`` fingerprints: rows written plus chance meetings."""

    def cost(groups: int) -> float:
        cells = comb(groups, bits)
        # a segment of two bits has 1.5 bits of information
        return cells * n + cells * n * n / 2 / 2 ** (1.5 * 64 / SEGMENT_BITS * (groups - bits) / groups)

    return min((g for g in GROUPS if g > bits), key=cost)


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the segments, each in the two bits of its segment."""
    low = np.uint64(0x5555555555555555)
    return (fps & low) + ((fps >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embedded fingerprints (two-bit coordinates of 0 to 2)."""
    # thermometer code: 0 -> 00, 1 -> 01, 2 -> 11, whose differing bits are the difference
    low = np.uint64(0x5555555555555555)

    def code(x):
        high = (x >> np.uint64(1)) & low
        return ((x & low) | high) | (high << np.uint64(1))

    return np.bitwise_count(code(a) ^ code(b))


def cell_masks(groups: int, bits: int = BITS) -> list[np.uint64]:
    """Masks over the embedded fingerprint of each choice of (groups - bits) groups."""
    segments = 64 // SEGMENT_BITS
    of = [sum(3 << (2 * s) for s in range(segments) if s * groups // segments == g) for g in range(groups)]
    return [np.uint64(sum(of[g] for g in c)) for c in combinations(range(groups), groups - bits)]


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join whatever members of a cell can be reached over links."""
    out: list[tuple[int, int]] = []
    pool, pool_embedded = members, embed(members)
    queue: list[np.uint64] = []
    while len(pool) and (queue or len(pool) > 1):
        if queue:
            at = queue.pop()
        else:
            at, pool, pool_embedded = pool[0], pool[1:], pool_embedded[1:]
        maybe = np.flatnonzero(manhattan(pool_embedded, embed(at)) <= bits)
        if len(maybe):
            near = maybe[np.bitwise_count(pool[maybe] ^ at) <= bits]
            if len(near):
                out += [(int(at), int(x)) for x in pool[near]]
                queue += list(pool[near])
                left = np.ones(len(pool), bool)
                left[near] = False
                pool, pool_embedded = pool[left], pool_embedded[left]
    return out


def links(fps: DataFrame, bits: int = BITS, groups: int | None = None) -> DataFrame:
    """(a, b) pairs of different fingerprints at ``bits`` or fewer differing bits, enough of
    them that whatever links connect is connected.  ``fps`` has one row per fingerprint."""
    groups = groups or groups_for(fps.count(), bits)
    masks = cell_masks(groups, bits)

    def cells(b):
        fp = b.column("fp").to_numpy().view(np.uint64)
        where = embed(fp)
        for at in range(0, len(fp), 20_000):
            part, own = where[at : at + 20_000], fp[at : at + 20_000].view(np.int64)
            for k, mask in enumerate(masks):
                # the choice of groups is part of the cell's name
                key = (part & mask) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD1B54A32D192ED03 % 2**64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], ["cell", "fp"])

    def joined(batches):
        open_cell, members = None, []

        def result(groups_found):
            pairs = [p for m in groups_found for p in forest(np.unique(m.view(np.uint64)), bits)]
            if pairs:
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            cell, fp = b.column("cell").to_numpy(), b.column("fp").to_numpy()
            if not len(cell):
                continue
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            ends = np.append(starts[1:], len(cell))
            found = []
            if open_cell is not None and cell[0] != open_cell:
                found.append(np.concatenate(members))
                members = []
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                last = end == len(cell)
                if members and start == 0:
                    members.append(fp[start:end])
                    if not last:
                        found.append(np.concatenate(members))
                        members = []
                elif last:
                    members = [fp[start:end]]
                elif end - start > 1:
                    found.append(fp[start:end])
            open_cell = cell[-1]
            yield from result(found)
        if members:
            yield from result([np.concatenate(members)])

    dealt = common.map_batches(fps.select("fp"), cells, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(joined, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node that it reaches.

    Alternating large-star and small-star: every node links its larger neighbours, then its
    smaller ones, to the least node of its neighbourhood, until nothing changes; the number
    of rounds grows with the logarithm of the largest component.  Each round is a pre-aggregated
    minimum and a join, stored in the shared folder."""
    edges = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        new = common.stored(small)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        common.discard(edges)
        edges = new
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    bits: int = BITS,
    groups: int | None = None,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, the
    least doc_id reachable over links of ``bits`` or fewer differing bits.

    Null and wordless texts have fingerprint zero, which links like any other.  A null id
    gets the component of its fingerprint but is never a least id.  Repeated rows and ids
    are all returned; other columns are ignored; an empty table gives no rows."""
    marked = common.stored(fingerprints(docs, id_col, text_col, words))
    least = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(links(least, bits, groups))
    rooted = least.join(reached, least["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


_FLIP, _FACTOR = (
    np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A name for each band of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def copy_links(
    keys: list[int], fps: list[int], sets: list[np.ndarray], least: float = COPY_LEAST, bits: int = COPY_BITS
) -> list[tuple[int, int]]:
    """Edges that join whatever of ``keys`` can be reached over pairs of sets at a Jaccard
    similarity of ``least`` or more, whose fingerprints differ in ``bits`` or fewer bits."""
    sizes = np.array([len(s) for s in sets])
    fps = np.array(fps, np.int64).view(np.uint64)
    out: list[tuple[int, int]] = []
    pool, queue = np.arange(len(keys)), []
    while len(pool) and (queue or len(pool) > 1):
        if queue:
            at = queue.pop()
        else:
            at, pool = int(pool[0]), pool[1:]
        # sizes bound the similarity
        maybe = pool[
            (np.bitwise_count(fps[pool] ^ fps[at]) <= bits)
            & (np.minimum(sizes[pool], sizes[at]) >= least * np.maximum(sizes[pool], sizes[at]))
        ]
        near = []
        for k in maybe.tolist():
            place = np.searchsorted(sets[at], sets[k])
            both = int((sets[at][np.minimum(place, sizes[at] - 1)] == sets[k]).sum())
            if both >= least * (sizes[at] + sizes[k] - both):
                near.append(k)
        out += [(keys[at], keys[k]) for k in near]
        queue += near
        pool = pool[~np.isin(pool, near)]
    return out


def shingle_sets(texts: list[str], words: int = COPY_WORDS) -> list[np.ndarray]:
    """The sorted different hashes of each text's runs of ``words`` words, A-Z lower-cased; of
    fewer words one run.  All texts of a block are hashed together."""
    out: list[np.ndarray] = []
    for start, end in common.blocks(texts):
        block = hashing.Block([t.encode("utf-8", "surrogatepass") for t in texts[start:end]], hashing.NOT_SPACE, _FOLD)
        runs = hashing.rolled(block.hashes, words)
        for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
            out.append(np.unique(runs[a : b - words + 1] if b - a >= words else hashing.rolled(block.hashes[a:b], b - a) if b > a else runs[:0]))
    return out


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = COPY_WORDS,
    least: float = COPY_LEAST,
    bits: int = COPY_BITS,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, component_id, the least doc_id reachable over pairs
    of texts whose sets of shingles have a Jaccard similarity of ``least`` or more.

    At that similarity too many bits may differ for cells of equal counts, so texts meet by
    bands of least shingle hashes; in a cell the fingerprints' radius comes first, then the
    similarity is counted exactly.  Texts of equal sets are one node; cells of the same nodes
    are looked at once; only one text of each node that meets others is read again for its set.
    A cell whose sets have more than ``cell_bytes`` is cut into blocks by a hash, and every two of
    its blocks meet in a task of their own.  Null and wordless texts are copies of each other; a
    null id is never a least id; repeated rows and ids are all returned; other columns are
    ignored; an empty table gives no rows."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.col(f"`{id_col}`").cast("long")
    src = common.renamed(docs, doc_id=doc, none=doc.isNull(), id0=F.coalesce(doc, F.lit(0).cast("long")), text=text, tid=F.xxhash64(text))

    def mark(b):
        import xxhash

        sets = shingle_sets(b.column("text").to_pylist(), words)
        keys = [signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
        fps = [signed(majority(s)) for s in sets]
        cells = [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        columns = [b.column("doc_id"), b.column("tid"), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "key", "fp", "size", "cells"])

    def read(b):
        for start, end in common.blocks(b.column("text").to_pylist()):
            part = b.slice(start, end - start)
            sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("fp"), pa.array(sets, pa.binary())], ["key", "fp", "set"])

    def compared(batches):
        open_cell, keys, fps, sets = None, [], [], []

        def result(keys, fps, sets):
            pairs = copy_links(keys, fps, sets, least, bits)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "i", "j", "key", "fp")]
            for *cell, key, fp, own in zip(*columns, batch.column("set"), strict=True):
                if cell != open_cell:
                    yield from result(keys, fps, sets)
                    open_cell, keys, fps, sets = cell, [], [], []
                keys.append(key)
                fps.append(fp)
                # a copy, so that the batch is not kept
                sets.append(np.frombuffer(own.as_buffer(), np.uint64).copy())
        yield from result(keys, fps, sets)

    marked = common.stored(common.map_batches(src.select("doc_id", "tid", "text"), mark, "doc_id long, tid long, key long, fp long, size long, cells array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first")
    nodes = common.stored(marked.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("cells").alias("cells")))
    dealt = nodes.select("key", "size", F.explode("cells").alias("cell"))
    alike = [F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("all")]
    met = dealt.groupBy("cell").agg(*alike).filter("n > 1").groupBy("n", "low", "high", "all").agg(F.min("cell").alias("cell"))
    members = common.stored(dealt.join(met.select("cell"), "cell", "left_semi"))
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select(
        "key", "fp", "first.none", "first.tid", F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("id0")
    )
    # equal rows become one before their shuffle; copies under other ids do not meet here
    own = ["tid", "none", "id0"]
    texts = src.groupBy(*own).agg(F.first("text").alias("text")).join(wanted, own).select("key", "fp", "text")
    sets = common.stored(common.map_batches(texts, read, "key long, fp long, set binary"))
    # there are at most (bytes of members / cell_bytes) crowded cells
    crowded = members.groupBy("cell").agg(F.ceil(F.sum(8 * F.col("size")) / cell_bytes).cast("int").alias("blocks")).filter("blocks > 1")
    placed = lookup_join(members.select("cell", "key"), crowded, ["cell"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    placed = placed.withColumn("other", F.explode(others))
    tiles = placed.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key")
    by = ["cell", "i", "j"]
    edges = tiles.join(sets, "key").select(*by, "key", "fp", "set").repartition(*by).sortWithinPartitions(*by)
    reached = components(edges.mapInArrow(compared, "a long, b long"))
    rooted = nodes.join(reached, nodes["key"] == reached["node"], "left").select("key", F.col("first.doc_id").alias("least"), F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "key").join(rooted.join(lowest, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
