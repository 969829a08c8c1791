"""Token ids in shard files with an index for keyed access in constant time.

A shard is one file: the raw ids of its documents in ascending order of their keys, then
a record for each document (start and number of ids), then the index.  The index is a
minimal perfect hash of the shard's keys: levels of bits, where a key takes the first
level in which no other remaining key hashes to its bit, and its place is the number of
bits set before.  For each place the index keeps a fingerprint of the key, so that a key
that was never written is refused, and the number of its first record.  Looking a key up
takes a search among shard bounds, one hash per level, and one read of its ids.

    header   16 bytes: magic, version, bytes per id
    ids      uint16 or uint32, little-endian
    records  per document: int64 start, int64 number of ids, int64 key, uint8 key is null
    index    per key: uint32 fingerprint, int64 first record; then the levels
    footer   32 bytes: where records, index and levels begin, magic

Files are written by tasks under a name of their own and renamed when complete, so a task
that runs twice leaves the same shard.  The manifest lists the shards."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"BWTOKEN1"
HEADER = struct.Struct("<8sII")
FOOTER = struct.Struct("<qqq8s")
RECORD = np.dtype([("start", "<i8"), ("length", "<i8"), ("key", "<i8"), ("null", "u1")])
MANIFEST = "shard int, file string, records long, ids long, first_key long, last_key long"
#: Bits of a level for each key that is still to be placed.
BITS_PER_KEY = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bytes of bits each
        self.before, total = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(np.cumsum(ones) - ones + total)
            total += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = -(-max(64, BITS_PER_KEY * len(rest)) // 64) * 64
            at = (mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some keys that were not in the set."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (mixed(keys[rest], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (bits[byte] >> bit) & 1 == 1
            below = bits[byte] & ((np.uint8(1) << bit) - np.uint8(1))
            place = self.before[level][byte] + np.bitwise_count(below)
            out[rest[here]] = place[here]
            rest = rest[~here]
        return out


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shard(folder: str, shard: int, docs: Iterator[tuple[int | None, np.ndarray]], id_bytes: int) -> tuple | None:
    """Write documents, in the order in which they come, as one file; its manifest row.
    Ids go out as they come; 25 bytes a document stay in memory until the end."""
    fs, path = _filesystem(folder)
    fs.create_dir(path)
    name = f"shard-{shard:06d}.tok"
    attempt = f"{path}/_{name}-{uuid.uuid4().hex}"
    lengths, keys, nulls, at = [], [], [], 0
    kind = f"<u{id_bytes}"
    with fs.open_output_stream(attempt, buffer_size=1 << 20) as out:
        out.write(HEADER.pack(MAGIC, 1, id_bytes))
        for key, ids in docs:
            out.write(ids.astype(kind).tobytes())
            lengths.append(len(ids))
            keys.append(key or 0)
            nulls.append(key is None)
            at += len(ids)
        records = np.zeros(len(lengths), RECORD)
        records["length"], records["key"], records["null"] = lengths, keys, nulls
        records["start"] = np.cumsum(records["length"]) - records["length"]
        own, first = np.unique(records["key"][records["null"] == 0], return_index=True)
        first = first + int(records["null"].sum())  # nulls come first
        index = PerfectHash.build(own)
        place = index.places(own)
        table = np.zeros(len(own), [("fingerprint", "<u4"), ("record", "<i8")])
        table["fingerprint"][place], table["record"][place] = fingerprints(own), first
        records_at = HEADER.size + at * id_bytes
        index_at = records_at + records.nbytes
        levels_at = index_at + table.nbytes
        out.write(records.tobytes())
        out.write(table.tobytes())
        for bits in index.levels:
            out.write(struct.pack("<q", len(bits)) + bits.tobytes())
        out.write(FOOTER.pack(records_at, index_at, levels_at, MAGIC))
    if not lengths:
        fs.delete_file(attempt)
        return None
    fs.move(attempt, f"{path}/{name}")
    bounds = (int(own[0]), int(own[-1])) if len(own) else (None, None)
    return shard, name, len(lengths), at, *bounds


class Shard:
    """Reads one shard file."""

    def __init__(self, folder: str, name: str):
        fs, path = _filesystem(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        self.size = self.file.size()
        magic, version, self.id_bytes = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        self.records_at, self.index_at, self.levels_at, end = FOOTER.unpack(
            self.file.read_at(FOOTER.size, self.size - FOOTER.size)
        )
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError(f"{name} is not a complete shard")
        self.records = np.frombuffer(self.file.read_at(self.index_at - self.records_at, self.records_at), RECORD)
        self._hash: PerfectHash | None = None

    def ids(self, record: int, many: int = 1) -> np.ndarray:
        """The ids of ``many`` records from ``record`` on."""
        part = self.records[record : record + many]
        n = int(part["length"].sum())
        data = self.file.read_at(n * self.id_bytes, HEADER.size + int(part["start"][0]) * self.id_bytes)
        return np.frombuffer(data, f"<u{self.id_bytes}").astype("<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First record of each key, -1 if it has none (a stranger passes by mistake once
        in 2**32 times by its fingerprint, and is then told by the record's key)."""
        if self._hash is None:
            data = self.file.read_at(self.size - FOOTER.size - self.levels_at, self.levels_at)
            levels, at = [], 0
            while at < len(data):
                (n,) = struct.unpack_from("<q", data, at)
                levels.append(np.frombuffer(data, np.uint8, n, at + 8))
                at += 8 + n
            self._hash = PerfectHash(levels)
            kind = [("fingerprint", "<u4"), ("record", "<i8")]
            self._table = np.frombuffer(self.file.read_at(self.levels_at - self.index_at, self.index_at), kind)
        keys = np.asarray(keys, np.int64)
        if not len(self._table):
            return np.full(len(keys), -1, np.int64)
        place = self._hash.places(keys)
        row = self._table[np.maximum(place, 0)]
        record = np.where((place >= 0) & (row["fingerprint"] == fingerprints(keys)), row["record"], -1)
        return np.where((record >= 0) & (self.records["key"][record] == keys), record, -1)


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    id_bytes: int = 2,
) -> DataFrame:
    """Encode every document, append ``end_id``, and write shard files to ``folder`` (one
    that all executors share) in ascending order of ids, shards as ranges of that order.
    Returns the manifest.

    A null text is empty (the end id alone); null ids come first, are records but not in the
    index; documents with equal ids follow each other by text, and the index leads to the
    first.  Other columns are ignored; an empty table gives an empty manifest.  ``id_bytes``
    is 2 for vocabularies below 65,536 ids, else 4."""
    src = common.renamed(docs, key=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    ordered = src.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))

    def one(batches):
        from pyspark import TaskContext

        end = np.array([end_id], "<u4")

        def encoded():
            for b in batches:
                found = tokens.encoder(tokenizer).ids(b.column("text").to_pylist())
                for key, ids in zip(b.column("key").to_pylist(), found, strict=True):
                    yield key, np.concatenate((ids, end))

        row = write_shard(folder, TaskContext.get().partitionId(), encoded(), id_bytes)
        if row:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "ids", "first_key", "last_key"), row, strict=True))], MANIFEST_ARROW)

    return common.stored(ordered.mapInArrow(one, MANIFEST))


MANIFEST_ARROW = pa.schema(
    [("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]
)


def _with_starts(manifest: DataFrame) -> DataFrame:
    """Each shard with the ids of all shards before it.  The manifest has a row per shard,
    a task's worth of documents each, so the driver adds them up."""
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((*r, start))
        start += r["ids"]
    kinds = {f.name: f.type for f in MANIFEST_ARROW} | {"shard_start": pa.int64()}
    return common.small_table(manifest.sparkSession, rows, **kinds).repartition(max(1, len(rows)), "shard")


def _found(shard: Shard, step: int = 5000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a shard and the record of each, as the index finds it.  Records without a key
    are at the front, and those that repeat a key follow the one found for it."""
    nulls = int(shard.records["null"].sum())
    if nulls:
        yield np.zeros(nulls, np.int64), np.arange(nulls)
    keys, copies = np.unique(shard.records["key"][nulls:], return_counts=True)
    for at in range(0, len(keys), step):
        many = copies[at : at + step]
        first = shard.find(keys[at : at + step])
        if (first < 0).any():
            raise ValueError("the index misses keys of its shard")
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(keys[at : at + step], many), np.repeat(first, many) + nth


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files, each key looked up in the index and its ids read at the
    record found there: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def one(batches):
        common.keep("read_back", lambda: None)  # frees the words that writing remembered
        for b in batches:
            for s in b.to_pylist():
                shard = Shard(folder, s["file"])
                for keys, records in _found(shard):
                    part = shard.records[records]
                    crcs = [zlib.crc32(shard.ids(i)) for i in records.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, mask=part["null"] == 1),
                            pa.array(part["start"] + s["shard_start"]),
                            pa.array(part["length"]),
                            pa.array(crcs, pa.int64()),
                        ],
                        schema=kinds,
                    )

    return _with_starts(manifest).mapInArrow(one, schema)


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, keys: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents, for interactive use: bounds of shards, index, one read."""
    shards = sorted(manifest.filter("first_key is not null").collect(), key=lambda r: r["first_key"])
    out = {}
    for key in keys:
        for r in shards:
            if r["first_key"] <= key <= r["last_key"]:
                shard = Shard(folder, r["file"])
                (record,) = shard.find(np.array([key]))
                if record >= 0:
                    out[key] = shard.ids(int(record))
                    break
    return out
