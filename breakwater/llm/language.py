"""Language identification with bit-sliced Bloom filters of n-grams.

One table of slots holds a filter for every language: bit i of a slot belongs to the
filter of language i.  An n-gram is looked up in all of them at once, as the AND of its
slots is the mask of the languages that contain it.  A text's n-grams are counted by
language, and the count is freed of false positives: a filter of which the part f is set
takes a strange n-gram with probability f ** hashes.

The filters are fitted on at most about ``sample`` texts of each language, drawn by a hash
of the id; an n-gram belongs to a language if it is there at least twice and not much
rarer than in the language that has it most, so that stray passages in other languages
leave no trace."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

N = 4
SLOT_BITS = 22
HASHES = 3
#: Texts of a language that a fit sees, about.
SAMPLE = 2000
#: An n-gram needs this part of the frequency it has in the language that has it most.
LEAST_SHARE = 0.2
UNKNOWN = "und"

_FACTOR = 0x9E3779B97F4A7C15
_SLOT_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased letters, other runs as one space; a text of
    fewer letters gives the one it has.  Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    codes = np.concatenate(([32], codes[keep], [32] if letter[-1] else [])).astype(np.uint64)
    if len(codes) < n:
        codes = np.concatenate((codes, np.full(n - len(codes), 32, np.uint64)))
    count = len(codes) - n + 1
    out = codes[:count]
    for i in range(1, n):
        out = out * np.uint64(_FACTOR) + codes[i : i + count]
    out = out * np.uint64(_FACTOR)
    return out ^ (out >> np.uint64(29))


def slots(grams: np.ndarray, slot_bits: int, hashes: int) -> list[np.ndarray]:
    return [(grams * np.uint64(f) >> np.uint64(64 - slot_bits)).astype(np.int64) for f in _SLOT_FACTORS[:hashes]]


@dataclass
class Filters:
    """``slices``: for each word of 64 languages, the slots' masks in the least type that holds them."""

    languages: list[str]
    slices: list[np.ndarray]
    slot_bits: int
    hashes: int

    def __post_init__(self):
        filled = [
            np.count_nonzero(self.slices[i // 64] >> self.slices[i // 64].dtype.type(i % 64) & self.slices[i // 64].dtype.type(1))
            for i in range(len(self.languages))
        ]
        self.false_positive = (np.array(filled) / 2**self.slot_bits) ** self.hashes

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Expected true n-grams of each language, and the n-grams of the text."""
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return np.zeros(len(self.languages)), len(grams)
        at = slots(grams, self.slot_bits, self.hashes)
        hits = np.zeros(len(self.languages))
        for word, table in enumerate(self.slices):
            mask = table[at[0]]
            for more in at[1:]:
                mask &= table[more]
            one = table.dtype.type(1)
            for bit in range(min(64, len(self.languages) - 64 * word)):
                hits[64 * word + bit] = np.count_nonzero(mask & (one << table.dtype.type(bit)))
        free = (hits - len(grams) * self.false_positive) / (1 - self.false_positive)
        return np.clip(free, 0, len(grams)), len(grams)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, part of the n-grams that the language has).  The score is the
        language's part of its own and the next one's count."""
        counts, total = self.counts(text) if text else ((), 0)
        if not total or not self.languages:
            return UNKNOWN, 0.0, 0.0
        order = np.argsort(-counts, kind="stable")
        best = counts[order[0]]
        second = counts[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(best / (best + second)) if best else 0.0, float(best / total)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    labelled: DataFrame, slot_bits: int = SLOT_BITS, hashes: int = HASHES, sample: int = SAMPLE, least_share: float = LEAST_SHARE
) -> Filters:
    """Filters from rows (draw, text, lang), ``draw`` a long by which the sample is drawn.
    Rows without text or language teach nothing.  What reaches the driver is a row per
    language and one per filled slot, at most 2 ** ``slot_bits``."""
    labelled = labelled.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))  # the first one is taken if no n-gram is known
    number = {name: i for i, name in enumerate(languages)}
    if not languages:
        return Filters([], [], slot_bits, hashes)
    spark = labelled.sparkSession
    parts = common.small_table(
        spark,
        [(name, number[name], int(min(1.0, sample / n) * 2**32)) for name, n in sizes.items()],
        lang=pa.string(),
        number=pa.int32(),
        upto=pa.int64(),
    )
    drawn = labelled.join(F.broadcast(parts), "lang").filter(F.pmod(F.xxhash64("draw"), F.lit(2**32)) < F.col("upto")).select("number", "text")

    def count(batches):
        for b in batches:
            by = {}
            for i, text in zip(b.column("number").to_pylist(), b.column("text"), strict=True):
                by.setdefault(i, []).append(ngrams(text.as_py()))
            for i, found in by.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), i, np.int32)), pa.array(n.astype(np.int64))],
                    ["gram", "number", "n"],
                )

    counted = common.stored(drawn.mapInArrow(count, "gram long, number int, n long").groupBy("gram", "number").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("number").agg(F.sum("n").alias("total"))
    rates = counted.join(F.broadcast(totals), "number").withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("number", "n", "rate")).alias("each"))
    kept = most.select(
        "gram", F.explode(F.filter("each", lambda e: (e["n"] >= 2) & (e["rate"] >= least_share * F.col("most")))).alias("e")
    ).select("gram", (F.col("e.number") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(e.number % 64 as int))").alias("mask"))

    def spread(b):
        for at in slots(b.column("gram").to_numpy().view(np.uint64), slot_bits, hashes):
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(at), b.column("mask")], ["word", "slot", "mask"])

    filled = common.map_batches(kept, spread, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= most)
    slices = [np.zeros(2**slot_bits, kind) for _ in range(-(-len(languages) // 64))]
    got = filled.toArrow()
    word, slot, mask = (got.column(c).to_numpy() for c in ("word", "slot", "mask"))
    for w, table in enumerate(slices):
        table[slot[word == w]] = mask[word == w].view(np.uint64).astype(kind)
    common.discard(counted)
    return Filters(languages, slices, slot_bits, hashes)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and known (the part of its n-grams that the language
    has) for every row.  A null text, or one without a letter, is ``und`` with score 0;
    everything else gets a language that was learned.  Columns of these names are replaced;
    no rows are dealt anew."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "known")]
    src = docs.select(*[f"`{c}`" for c in keep])
    schema = StructType(list(src.schema.fields)).add("lang_pred", "string").add("score", "double").add("known", "double")

    def each(b):
        found = [shared.value.predict(t.as_py()) for t in b.column(text_col)]
        langs, scores, known = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())],
            [*b.schema.names, "lang_pred", "score", "known"],
        )

    def run(batches):
        for b in batches:
            yield from each(b)

    return src.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of a documents table that a language may be learned from."""
    return docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("draw"), "text", "lang")
