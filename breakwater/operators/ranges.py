"""Interval and fuzzy-position joins through bins.

A bare range condition has no equality to hash on, so Spark would compare every pair.
Here positions fall into bins, the bin is an equality key, and the range stays as the
residual condition of that equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew

BIN = "_bin"
# Width of the cells of a grid join, in radii, and the cells in which a row is entered at most.
GRID = 8
CELLS = 4


def bin_of(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def _binned(df: DataFrame, start: Column, end: Column, width: int, first: str) -> DataFrame:
    """One row per bin that [start, end) touches."""
    lo, hi = bin_of(start, width), bin_of(end - 1, width)
    return (
        df.filter(start < end)
        .withColumn(first, lo)
        .withColumn(BIN, F.explode(F.sequence(F.col(first), F.greatest(hi, F.col(first)))))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    width: int,
    how: str = "inner",
    broadcast_rows: int = skew.BROADCAST_ROWS,
    task_rows: int = skew.TASK_ROWS,
    distinct_left: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Pairs whose half-open spans overlap, within equal ``on`` columns.

    ``how`` is inner, left, left_semi or left_anti; all but inner ask for points on the
    left (a span of one base), which sit in one bin only.  Other columns must differ in
    name between the sides.  With ``distinct_left`` equal left rows of an inner join count once;
    where the join shuffles they are found in their bin, by the shuffle that the join needs.

    Returns the pairs and the columns they are partitioned by when the join shuffles:
    grouping by these and an id of the left row needs no further shuffle.  A pair that
    shares several bins is kept in the first of them, so no distinct is needed."""
    on = list(on)
    l_start, l_end = left_span
    r_start, r_end = right_span
    # An interval counts once for each bin it is entered in.
    right = right.withColumn("_r_start", r_start.cast("double")).withColumn(
        "_r_end", r_end.cast("double")
    )
    bins = F.ceil((F.col("_r_end") - F.col("_r_start")) / width) + 1
    right, within = skew.measured(right, broadcast_rows, bins)
    if distinct_left and within:
        left = left.distinct()
    left = left.withColumn("_l_start", l_start.cast("double")).withColumn(
        "_l_end", l_end.cast("double")
    )
    if how == "inner":
        left = _binned(left, F.col("_l_start"), F.col("_l_end"), width, "_l_first")
    else:
        at = F.coalesce(bin_of(F.col("_l_start"), width), skew.spread(left))
        left = left.withColumn(BIN, at).withColumn("_l_first", F.col(BIN))
    right = _binned(right, F.col("_r_start"), F.col("_r_end"), width, "_r_first")
    keys = [*on, BIN]

    if within:
        right = F.broadcast(right.withColumnsRenamed({k: f"_r{k}" for k in keys}))
        same = [F.col(k) == F.col(f"_r{k}") for k in keys]
        partitioning = keys
    else:
        left, right, salted = skew.salt_both(left, right, keys, task_rows, how == "inner")
        if distinct_left:
            left = left.repartition(*salted).distinct()
        right = skew.shuffled(right.withColumnsRenamed({k: f"_r{k}" for k in salted}))
        same = [F.col(k) == F.col(f"_r{k}") for k in salted]
        partitioning = salted
    condition = (F.col("_l_start") < F.col("_r_end")) & (F.col("_r_start") < F.col("_l_end"))
    if how == "inner":
        condition &= F.col(BIN) == F.greatest(F.col("_l_first"), F.col("_r_first"))
    for equality in same:
        condition &= equality
    joined = left.join(right, condition, how)
    dropped = [
        c
        for c in joined.columns
        if c in ("_l_start", "_l_end", "_l_first", "_r_start", "_r_end", "_r_first")
        or c in {f"_r{k}" for k in [*keys, *skew.SALTS]}
    ]
    return joined.drop(*dropped), partitioning


def first_overlap(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    point: Column,
    interval_span: tuple[Column, Column],
    order: Column,
    value: Column,
    name: str,
    width: int,
    **options,
) -> DataFrame:
    """Each point with ``value`` of the covering interval that is lowest in ``order``
    (NULL where none covers it).  Places are looked up once each, in narrow rows, and the
    rows find their place again, so equal rows stay apart."""
    columns = points.columns
    side = intervals.select(
        *on,
        order.alias("_order"),
        value.alias("_value"),
        interval_span[0].alias("_from"),
        interval_span[1].alias("_to"),
    )
    placed = points.withColumn("_at", point)
    places = placed.select(*on, "_at").filter(F.col("_at").isNotNull()).distinct()
    pairs, _ = overlap_join(
        places,
        side,
        on,
        (F.col("_at"), F.col("_at") + 1),
        (F.col("_from"), F.col("_to")),
        width,
        **options,
    )
    found = pairs.groupBy(*on, "_at").agg(F.min_by("_value", "_order").alias(name))
    return skew.lookup_join(placed, found, [*on, "_at"]).select(*columns, name)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_at: tuple[Column, Column],
    right_at: tuple[Column, Column],
    radius: int,
    how: str = "inner",
    broadcast_rows: int = skew.BROADCAST_ROWS,
    task_rows: int = skew.TASK_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Rows whose two positions both differ by less than ``radius``.

    Cells are ``GRID`` times the radius wide in both positions; a left row looks in its own cell
    and a right row is entered in the cells that its reach touches, mostly one.  Where the right
    side has one row per place, a cell sees at most ((GRID + 2) x radius)^2 of them, however
    crowded."""
    on = list(on)
    width = GRID * radius
    left = left.withColumns(
        {
            "_la": left_at[0].cast("long"),
            "_lb": left_at[1].cast("long"),
            "_cell_a": bin_of(left_at[0], width),
            "_cell_b": bin_of(left_at[1], width),
        }
    )
    right = right.withColumns({"_ra": right_at[0].cast("long"), "_rb": right_at[1].cast("long")})
    right, within = skew.measured(right, broadcast_rows, F.lit(CELLS))
    for source, cell in (("_ra", "_cell_a"), ("_rb", "_cell_b")):
        first, last = (bin_of(F.col(source) + step, width) for step in (1 - radius, radius - 1))
        right = right.withColumn(cell, F.explode(F.sequence(first, last)))
    keys = [*on, "_cell_a", "_cell_b"]
    if within:
        right = F.broadcast(right.withColumnsRenamed({k: f"_r{k}" for k in keys}))
        partitioning = keys
    else:
        left, right, partitioning = skew.salt_both(left, right, keys, task_rows, how == "inner")
        right = skew.shuffled(right.withColumnsRenamed({k: f"_r{k}" for k in partitioning}))
    condition = (F.abs(F.col("_la") - F.col("_ra")) < radius) & (
        F.abs(F.col("_lb") - F.col("_rb")) < radius
    )
    for k in partitioning:
        condition &= F.col(k) == F.col(f"_r{k}")
    joined = left.join(right, condition, how)
    spent = {"_la", "_lb", "_ra", "_rb", *[f"_r{k}" for k in partitioning]}
    return joined.drop(*[c for c in joined.columns if c in spent]), partitioning
