"""Joins that hold when one key has a large share of all rows.

A side is broadcast only after its rows were counted and found within a limit.  Beyond
that the join shuffles, and keys with many rows are spread over salts: rows of the
crowded side take one salt each, rows of the other side are repeated for every salt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rows a broadcast side may have; rows are narrow (below about 200 bytes).
BROADCAST_ROWS = 200_000
# Rows of one join key that one task should meet.
TASK_ROWS = 2_000_000
# Buckets in which keys are counted first, so that the count combines before its shuffle.
BUCKETS = 16_384

SALTS = ("_left_salt", "_right_salt")


# Bytes of files below which a side is small without a look at its rows.
SMALL_BYTES = 4_000_000
# Nodes under which the planner's size is no bound on the rows.
_GROWING = ("Generate", "Join", "Expand", "Range", "MapIn", "FlatMap", "RDD", "Hive")


def planned_bytes(df: DataFrame) -> int | None:
    """Bytes that ``df`` is read from, if no part of its plan can make more rows of them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in _GROWING):
        return None
    return int(str(plan.stats().sizeInBytes()))


def measured(df: DataFrame, limit: int, rows_each: Column | None = None) -> tuple[DataFrame, bool]:
    """``df`` computed once and kept, and whether it has ``limit`` rows at most.
    ``rows_each`` counts a row as several; without it, a side read from few bytes, with no
    node that makes rows, is small as it is: nothing is written or counted for it."""
    planned = planned_bytes(df)
    if rows_each is None and planned is not None and planned <= SMALL_BYTES and limit >= BROADCAST_ROWS:
        return df, True
    kept = cut_lineage(df)
    if rows_each is None:
        return kept, kept.count() <= limit
    return kept, (kept.agg(F.sum(rows_each)).first()[0] or 0) <= limit


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that was not counted small.  By itself the planner would go by the bytes of
    a stored table's files, into which many rows may be packed, and have the driver gather them
    for a broadcast of many times that size."""
    return df.hint("merge")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Attach the one row per key of ``small`` to ``big``; the keys of ``big`` may be
    very uneven (one sample with a third of all variants)."""
    on = list(on)
    # Without room for a broadcast there is nothing to measure.
    small, within = measured(small, limit) if limit > 0 else (small, False)
    if within:
        return big.join(F.broadcast(small), on, how)
    left, right, keys = salt_both(big, small, on, task_rows, split_right=False)
    return left.join(shuffled(right), keys, how).drop(*SALTS)


def crowded_buckets(df: DataFrame, keys: Sequence[Sequence[Column]], task_rows: int) -> list[list[int]]:
    """For each of ``keys`` the buckets with more than ``task_rows`` rows, all from one look at
    ``df``.  A crowded key lies in a crowded bucket, and almost always there is none."""
    buckets = F.array(*[F.struct(F.lit(k).alias("k"), _bucket(key).alias("b")) for k, key in enumerate(keys)])
    each = df.select(F.explode(buckets).alias("_b")) if len(keys) > 1 else df.select(buckets[0].alias("_b"))
    counted = each.groupBy("_b.k", "_b.b").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows)
    found: list[list[int]] = [[] for _ in keys]
    for row in counted.collect():
        found[row.k].append(row.b)
    return found


def spread(df: DataFrame) -> Column:
    """A number that differs between most rows, for rows whose key meets nothing, which would all
    land in one task."""
    whole = [c for c, kind in df.dtypes if kind in ("bigint", "int")]
    return F.pmod(F.xxhash64(*(whole or df.columns[:1])), F.lit(BUCKETS))


def _bucket(key: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def crowded_keys(df: DataFrame, on: Sequence[str], task_rows: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """Keys of ``df`` with more than ``task_rows`` rows and their number, NULL keys among them;
    None where no key can have that many."""
    key = [F.col(c) for c in on]
    if buckets is None:
        (buckets,) = crowded_buckets(df, [key], task_rows)
    if not buckets:
        return None
    # An IN list over most of the buckets would sift nothing.
    rows = df.filter(_bucket(key).isin(list(buckets))) if len(buckets) <= 100 else df
    return rows.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > task_rows)


def salt_both(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    task_rows: int = TASK_ROWS,
    split_right: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Give both sides salt columns so that equal rows still meet exactly once and no
    key brings one task more than about ``task_rows`` of either side.  Joins that keep
    unmatched left rows ask for ``split_right=False``, so that a left row stays one row.
    Where no key is crowded both sides stay as they are.

    Crowded keys are found by a count of buckets, which combines before its shuffle, and an
    exact one in crowded buckets.  There are at most (rows of both sides) / ``task_rows`` of
    them, which bounds what is broadcast."""
    on = list(on)
    of_left = crowded_keys(left, on, task_rows)
    of_right = crowded_keys(right, on, task_rows) if split_right else None
    return salted(left, right, on, of_left, of_right, task_rows)


def salted(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    of_left: DataFrame | None,
    of_right: DataFrame | None,
    task_rows: int,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``salt_both`` with the crowded keys of the sides given."""
    on = list(on)
    if of_left is None and of_right is None:
        return left, right, on
    parts = F.ceil(F.col("n") / task_rows).cast("long")
    one = F.lit(1).cast("long")

    def shares(keys: DataFrame, left_parts: Column, right_parts: Column) -> DataFrame:
        return keys.select(*on, left_parts.alias("_left_parts"), right_parts.alias("_right_parts"))

    hot = [shares(of_left, parts, one)] if of_left is not None else []
    hot += [shares(of_right, one, parts)] if of_right is not None else []
    if len(hot) > 1:
        both = hot[0].unionByName(hot[1]).groupBy(*on)
        hot = [both.agg(*[F.max(c).alias(c) for c in ("_left_parts", "_right_parts")])]
    hot = F.broadcast(hot[0])
    zero = F.lit(0).cast("long")

    def add(df: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        columns = df.columns
        joined = df.join(hot, on, "left")
        mine = F.pmod(
            F.xxhash64(*[F.col(c) for c in columns]), F.coalesce(F.col(own), one)
        )
        repeat = F.sequence(zero, F.coalesce(F.col(other), one) - 1)
        return joined.select(*columns, mine.alias(own_salt), F.explode(repeat).alias(other_salt))

    salted_l = add(left, "_left_parts", "_right_parts", *SALTS)
    salted_r = add(right, "_right_parts", "_left_parts", *reversed(SALTS))
    return salted_l, salted_r, [*on, *SALTS]
