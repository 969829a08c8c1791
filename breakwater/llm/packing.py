"""Best-fit packing of token sequences with a fixed number of open bins.

Each task packs its own pieces as they come.  Its open bins stand in a bitset keyed by
free space: bit f is set if some open bin has f tokens free, so the tightest bin that
takes a piece of n tokens is the lowest set bit from n on.  When all bins are open and
none takes the piece, the fullest one closes.  Memory of a task is the open bins.

Pieces in bins that still have room when their task ends are packed once more, those of
many tasks together and long ones first, until what has room fits one small task."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Bins a task has open at once.
OPEN_BINS = 256
#: Pieces that a task of a later round gets, about; a round of one task is the last.
REPACK_PIECES = 20_000
#: Later rounds at most; each leaves a small part of what it gets.
ROUNDS = 4


class OpenBins:
    """Bounded-space online best-fit.  ``put`` places a piece and tells which bin closed."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free_bits = 0
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = 0
        self.bins = 0

    def _take(self, free: int) -> int:
        here = self.by_free[free]
        at = here.pop()
        if not here:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return at

    def put(self, size: int) -> tuple[int, int, int | None]:
        """(bin, offset, closed bin or None) for a piece of ``size`` tokens."""
        closed = None
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.most and size < self.capacity:  # the fullest closes
                closed = self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, at = self.capacity, self.bins
            self.bins += 1
        if free > size:
            self.by_free[free - size].append(at)
            self.free_bits |= 1 << (free - size)
            self.open += 1
        else:
            closed = at  # full; in this case no other one has closed
        return at, self.capacity - free, closed

    def slack(self, least: int) -> set[int]:
        """Open bins with more than ``least`` tokens free."""
        return {at for free, here in self.by_free.items() if free > least for at in here}


PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, bin long, offset long, is_open boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "is_open"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _placed(task: int, pieces: Iterator[tuple], capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pack ``pieces`` (doc_id, piece, start, length, crc).  Rows leave when their bin
    closes; those of bins with room at the end are marked, for a later round."""
    bins = OpenBins(capacity, most)
    waiting: dict[int, list[tuple]] = defaultdict(list)
    out: list[tuple] = []
    for row in pieces:
        at, offset, closed = bins.put(row[3])
        waiting[at].append((*row, (task << 34) + at, offset))
        if closed is not None:
            out += [(*r, False) for r in waiting.pop(closed)]
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    slack = bins.slack(capacity // 128)
    out += [(*r, at in slack) for at, rows in waiting.items() for r in rows]
    if out:
        yield _batch(out)


def pieces_of(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc of the ids) of a document that is cut only if it must be."""
    for k, start in enumerate(range(0, len(ids), most)):
        part = ids[start : start + most]
        yield k, start, len(part), zlib.crc32(part.tobytes())


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    open_bins: int = OPEN_BINS,
    repack_pieces: int = REPACK_PIECES,
) -> DataFrame:
    """Every document as ids and ``end_id``, in sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Documents longer than ``capacity`` are cut into full pieces and a rest.  A null text is
    empty (one piece, the end id alone); a null id stays null; repeated rows are packed as
    often as they come; other columns are ignored; an empty table gives no rows.
    ``tokenizer`` is a vocabulary file that every executor has."""
    src = common.renamed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def first(batches):
        from pyspark import TaskContext

        def pieces():
            end = np.array([end_id], "<u4")
            for b in batches:
                ids = tokens.encoder(tokenizer).ids(b.column("text").to_pylist())
                for doc, found in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                    for piece in pieces_of(np.concatenate((found, end)), capacity):
                        yield (doc, *piece)

        yield from _placed(TaskContext.get().partitionId(), pieces(), capacity, open_bins)

    placed = common.stored(src.mapInArrow(first, PLACED))
    done = []
    for number in range(1, ROUNDS + 1):
        rest = placed.filter("is_open")
        tasks = -(-rest.count() // repack_pieces)
        if tasks == 0:
            break

        def again(batches, number=number):
            from pyspark import TaskContext

            rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            rows.sort(key=lambda r: (-r[3], r))
            yield from _placed((number << 24) + TaskContext.get().partitionId(), iter(rows), capacity, len(rows))

        dealt = rest.repartition(tasks, F.xxhash64("bin", "offset"))
        packed = common.stored(dealt.select(*PIECES).mapInArrow(again, PLACED))
        done.append(placed.filter("not is_open"))
        placed = packed
        if tasks == 1:
            break
    out = placed
    for earlier in done:
        out = out.unionByName(earlier)
    return out.select(*PIECES, F.col("bin").alias("sequence_id"), "offset")
