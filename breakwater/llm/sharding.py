"""Balanced label propagation: documents into shards of equal count, linked ones together.

Documents are linked if they share a group.  They start dealt out evenly; in each round
every group wishes for the shard where most of its documents are and the others have room,
documents elsewhere ask to move there, and quotas decide: a move is taken only if no shard
ends above its share, with what leaves a shard making room for what comes.  Moves of larger
groups go first.  Documents without links have no wish; they fill what room is left, which makes the counts
exact.  Rounds work on counts of (group, home shard), never on single documents, and a
document finds its shard at the end by that pair.

A group beyond a shard's share cannot stay whole: it is cut into parts that fit.  So a part
in one home shard has at most 1 / shards ** 2 of all documents, and no join or count meets
more than that under one key, even if a third of all documents are the same text."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 40
ROUNDS = 12
#: Hash buckets of groups within a demand of one size; the quotas take buckets whole.
BUCKETS = 8

DEMAND = ("shard", "wish", "gain", "bucket")


def quotas(
    demand: list[tuple[int, int, int, int, int]], have: dict[int, int], share: dict[int, int]
) -> set[tuple[int, int, int, int]]:
    """Which demands (from, to, gain, bucket, documents) can all be met without any shard
    going above its share.  Starts with all, and takes back the least gains into shards that
    would overflow; taking back may fill the shards left behind, so it goes on until none
    overflows.  At worst nothing moves."""
    taken = {d[:4]: d[4] for d in demand}
    into = defaultdict(list)
    for d in sorted(demand, key=lambda d: (-d[2], d[3], d[0])):
        into[d[1]].append(d[:4])
    size = dict(have)
    for (a, b, _, _), n in taken.items():
        size[a] -= n
        size[b] += n
    over = [s for s in size if size[s] > share[s]]
    while over:
        s = over.pop()
        while size[s] > share[s]:
            back = into[s].pop()
            n = taken.pop(back)
            size[s] -= n
            size[back[0]] += n
            if size[back[0]] > share[back[0]]:
                over.append(back[0])
    return set(taken)


def _wish(room: dict[int, int], number: int):
    """The shard a group asks for: of those with room for the rest of it, the one where most
    of it is; else one that could take it whole; else where most of it is, in the hope that
    others leave."""
    rooms = F.array(*[F.lit(room[s]).cast("long") for s in sorted(room)])
    fitting = F.filter("votes", lambda v: F.get(rooms, v["shard"]) >= F.col("size") - v["votes"])
    open_shards = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.get(rooms, s) >= F.col("size"))
    turn = F.pmod(F.xxhash64("grp", F.lit(number)), F.greatest(F.size(open_shards), F.lit(1))).cast("int")
    drawn = F.get(open_shards, turn)
    return F.coalesce(F.array_max(fitting)["shard"], drawn, F.array_max("votes")["shard"])


def propagate(classes: DataFrame, share: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """``classes`` (grp, home, n): documents of a group that started in shard ``home``.
    Returns it with the shard where each class ends."""
    spark = classes.sparkSession
    state = common.stored(classes.withColumn("shard", F.col("home")))
    have = {s: 0 for s in share} | {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    for number in range(rounds):
        room = {s: share[s] - have[s] for s in share}
        votes = state.groupBy("grp", "shard").agg(F.sum("n").alias("votes"))
        # at most a vote per shard; ties by a hash of the group, the same for all its documents
        vote = F.struct("votes", F.xxhash64("grp", "shard", F.lit(number)).alias("tie"), "shard")
        groups = votes.groupBy("grp").agg(F.collect_list(vote).alias("votes"), F.sum("votes").alias("size"))
        wish = groups.select("grp", _wish(room, number).alias("wish"), F.floor(F.log2("size")).cast("int").alias("gain"))
        bucket = F.pmod(F.xxhash64("grp", F.lit(number)), F.lit(BUCKETS)).cast("int").alias("bucket")
        asked = state.join(wish, "grp").select(*state.columns, "wish", "gain", bucket)
        asked = common.stored(asked)
        # at most shards x shards x 40 x BUCKETS rows, however many documents
        demand = [tuple(r) for r in asked.filter("shard <> wish").groupBy(*DEMAND).agg(F.sum("n")).collect()]
        taken = quotas(demand, have, share)
        if not taken:
            common.discard(asked)
            break
        for a, b, g, k, n in demand:
            if (a, b, g, k) in taken:
                have[a] -= n
                have[b] += n
        moves = F.broadcast(common.small_table(spark, sorted(taken), **{c: pa.int32() for c in DEMAND}).withColumn("moves", F.lit(True)))
        new = common.stored(
            asked.join(moves, list(DEMAND), "left").select(
                "grp", "home", "n", F.when(F.col("moves"), F.col("wish")).otherwise(F.col("shard")).alias("shard")
            )
        )
        common.discard(state)
        common.discard(asked)
        state = new
    return state


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Put every row into one of ``shards`` shards whose counts differ by one at most, rows
    of equal text together as far as the counts allow.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, shard, slot (gapless
    from 0 in each shard, by doc_id).  A null text has size 16, checksum 0, and no links;
    null ids come first in their shard; repeated rows are rows like others and stay
    together; other columns are ignored; an empty table gives no rows."""
    text = F.col(f"`{text_col}`")
    base = common.renamed(
        docs,
        doc_id=F.col(f"`{id_col}`").cast("long"),
        size=(F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"),
        text_crc32=F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
        grp=F.when(text.isNotNull(), F.substring(F.sha2(text.cast("binary"), 256), 1, 32)),
    )
    base = common.numbered(base, ["doc_id", "text_crc32"], name="number")
    base = common.stored(base.withColumn("home", (F.col("number") % shards).cast("int")))
    total = base.count()
    share = {s: total // shards + (s < total % shards) for s in range(shards)}
    quota = max(1, total // shards)
    linked = base.groupBy("grp").agg(F.count("*").alias("n")).filter("grp is not null and n > 1")
    linked = common.stored(linked)
    # groups that fill more than a shard: fewer than there are shards
    large = linked.filter(F.col("n") > quota).select(
        F.col("grp").alias("_grp"), F.ceil(F.col("n") * 1.1 / quota).cast("long").alias("parts")
    )
    parted = base.join(F.broadcast(large), F.col("grp") == F.col("_grp"), "left").select(
        *base.columns, F.coalesce(F.pmod(F.xxhash64("number"), F.col("parts")), F.lit(0)).alias("part")
    )
    classes = (
        parted.filter("grp is not null")
        .groupBy("grp", "part", "home")
        .agg(F.count("*").alias("n"))
        .join(linked.select("grp"), "grp", "left_semi")
        .select(F.concat_ws(":", "grp", "part").alias("grp"), "home", "n")
    )
    ended = propagate(classes, share, rounds).select(F.col("grp").alias("_key"), F.col("home").alias("_home"), "shard")
    on = (F.concat_ws(":", "grp", "part") == F.col("_key")) & (F.col("home") == F.col("_home"))
    placed = common.stored(parted.join(ended, on, "left").select("doc_id", "size", "text_crc32", "number", "shard"))
    used = {r["shard"]: r["n"] for r in placed.filter("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    loose = common.numbered(placed.filter("shard is null").drop("shard"), ["number"], name="turn")
    upto, ends = 0, []
    for s in range(shards):
        upto += share[s] - used.get(s, 0)
        ends.append(upto)
    # the first shard whose room, with that of the shards before, reaches beyond the turn
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("turn")))
    all_rows = placed.filter("shard is not null").unionByName(loose.select("doc_id", "size", "text_crc32", "number", fill.cast("int").alias("shard")))
    slotted = common.numbered(all_rows, ["number"], "shard", "slot")
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot")
