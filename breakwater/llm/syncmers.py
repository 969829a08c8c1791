"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers (by hash) is
the first or the last one.  That is a property of the k-mer alone, so the same passage
gives the same anchors in any document and at any place, and two neighbouring anchors are
never more than k - s characters apart: anchors can be matched by position.  A fingerprint
keeps the least ``size`` anchor hashes of a text, from which the share of common anchors
of two texts follows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 16
S = 9
#: Anchors that a fingerprint keeps; eight hex digits each.
SIZE = 96

_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` codes, made of runs of half the width again."""
    # runs of 1, 2, 4, ... codes; a run of 2w is (run of w) * factor**w + next run of w
    out, have = None, 0
    run, length = codes, 1
    while True:
        if width & length:
            if out is None:
                out, have = run, length
            else:
                # what is had stands before this run
                power = np.uint64(pow(_MULTIPLIER, length, 2**64))
                n = min(len(out), len(run) - have)
                out, have = out[:n] * power + run[have : have + n], have + length
        if 2 * length > width:
            break
        power = np.uint64(pow(_MULTIPLIER, length, 2**64))
        run, length = run[:-length] * power + run[length:], 2 * length
    return _mix(out[: len(codes) - width + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window."""
    run, length = values, 1
    while 2 * length <= width:
        run, length = np.minimum(run[:-length], run[length:]), 2 * length
    if length < width:
        rest = width - length
        run = np.minimum(run[:-rest], run[rest:])
    return run


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers, in order.  A text shorter than k is one
    anchor, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes += np.uint64(1)
    if len(codes) < k:
        return np.zeros(1, np.int64), _window_hashes(codes, len(codes))
    inner = _window_hashes(codes, s)
    width = k - s + 1
    least = _least(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return at, _window_hashes(codes, k)[at]


def sketch(text: str, k: int = K, s: int = S, size: int = SIZE) -> np.ndarray:
    """The least anchor hashes, 32 bits each, ascending, different; of a text that has
    characters but no anchor, the hash of the whole text."""
    hashes = anchors(text, k, s)[1]
    if text and not len(hashes):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        hashes = _window_hashes(codes, len(codes))
    return np.unique(hashes >> np.uint64(32))[:size].astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of anchors that two texts have in common, 2 |A and B| / (|A| + |B|), estimated
    from the least hashes of both together; 1 if neither has any."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    j = len(both) / len(union)
    return 2 * j / (1 + j)


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_next(src: DataFrame, parts: int) -> DataFrame:
    """``src`` (doc_id, text) dealt by ranges of descending doc_id; the first document of a
    range also goes, marked, to the end of the range before (that of the first range to the
    last), so that every document stands in front of its next one."""
    # exact values of the column, each the greatest id of its range
    marks = src.filter("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts + 1)], 1 / (4 * parts))
    highest = src.agg(F.max("doc_id")).first()[0]
    tops = sorted({int(m) for m in marks} | ({highest} if highest is not None else {0}), reverse=True)
    ranges = len(tops)

    def search(first: int, last: int):
        """Number of the range of an id, by halving."""
        if first == last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        return F.when(F.col("doc_id") <= tops[middle], search(middle, last)).otherwise(search(first, middle - 1))

    own = F.when(F.col("doc_id").isNull(), ranges - 1).otherwise(search(0, ranges - 1))
    is_top = F.col("doc_id").isin(tops) if highest is not None else F.lit(True)
    wide = src.withColumn("_range", own)
    rows = wide.withColumn(
        "_copy",
        F.explode(F.when(is_top, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))),
    ).withColumn(
        "_range", F.when(F.col("_copy"), F.pmod(F.col("_range") - 1, F.lit(ranges))).otherwise(F.col("_range"))
    )
    return rows.repartition(ranges, "_range").sortWithinPartitions(
        "_range", "_copy", F.col("doc_id").desc_nulls_last(), F.col("_hash")
    )


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SIZE, parts: int = 0
) -> DataFrame:
    """Fingerprint each document and its edited text (its last half, rounded down, replaced
    by as much of the beginning of the next document in descending order of ids).

    A null text is empty.  Rows of equal ids follow each other by a hash of their text; null
    ids come last; the next document of the last one is the first.  Repeated rows are all
    returned; other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = common.renamed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text, _hash=F.xxhash64(text))
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_next(src, parts)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        last = None  # the document before, of which the next one is not known yet
        done_range = None
        for b in batches:
            out = []
            for doc, text, at, copy in zip(
                b.column("doc_id").to_pylist(), b.column("text"), b.column("_range").to_pylist(), b.column("_copy").to_pylist(), strict=True
            ):
                if at == done_range:
                    continue  # further rows of the id that starts the next range
                text = text.as_py()
                own = sketch(text, k, s, size)
                if last is not None and last[3] == at:
                    before, old, old_sketch, _ = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    edited_sketch = sketch(edited, k, s, size)
                    out.append(
                        (
                            before,
                            len(old),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            text_of(old_sketch),
                            text_of(edited_sketch),
                            likeness(old_sketch, edited_sketch, size),
                            likeness(old_sketch, own, size),
                        )
                    )
                if copy:
                    done_range, last = at, None
                else:
                    last = (doc, text, own, at)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return ordered.drop("_hash").mapInArrow(run, OUT)
