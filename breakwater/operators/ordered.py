"""Running values, neighbours, first rows and quantiles over groups of any size.

A plain window sends a whole group to one task.  ``OrderedRows`` cuts the sorted table
into even ranges instead, works inside each range, and carries totals across ranges; the
carried part has one row per range and group, however many rows the group has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import lookup_join

RANGE = "_range"


class OrderedRows:
    """Rows sorted by ``keys`` and then ``order``, which must identify a row."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        sorting = [F.col(c) for c in [*self.keys, *self.order]]
        ranged = df.repartitionByRange(*sorting).withColumn(RANGE, F.spark_partition_id())
        # The range of a row has to stay what it is from here on.
        self.df = cut_lineage(ranged)
        self.stored = True

    def _with(self, df: DataFrame) -> OrderedRows:
        other = object.__new__(OrderedRows)
        other.keys, other.order, other.df, other.stored = self.keys, self.order, df, False
        return other

    def add(self, **columns: Column) -> OrderedRows:
        return self._with(self.df.withColumns(columns))

    def scan(
        self,
        keys: Sequence[str] | None = None,
        previous: Mapping[str, Column] | None = None,
        following: Mapping[str, Column] | None = None,
        sums: Mapping[str, Column] | None = None,
        maxima: Mapping[str, Column] | None = None,
        maxima_before: Mapping[str, Column] | None = None,
        minima_ahead: Mapping[str, Column] | None = None,
        minima_after: Mapping[str, Column] | None = None,
    ) -> OrderedRows:
        """Add columns, within groups of ``keys`` (a prefix of the sort keys):
        the value in the row before / after; the sum and the maximum of all rows up to
        this one (``maxima_before``: without it); the minimum of this and all later rows
        (``minima_after``: without it)."""
        keys = self.keys if keys is None else list(keys)
        rest = [c for c in [*self.keys, *self.order] if c not in keys]
        place = F.struct(*[F.col(c) for c in rest])
        forward = Window.partitionBy(*keys, RANGE).orderBy(*rest)
        so_far = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        across = Window.partitionBy(*keys).orderBy(RANGE)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        # Frames that reach back from a descending order are kept up row by row; frames
        # that reach ahead would be added up again for every row.
        backward = Window.partitionBy(*keys, RANGE).orderBy(*[F.desc(c) for c in rest])
        after = (
            Window.partitionBy(*keys)
            .orderBy(F.desc(RANGE))
            .rowsBetween(Window.unboundedPreceding, -1)
        )

        totals, carried, final, local = [], [], {}, {}
        for name, col in (previous or {}).items():
            totals.append(F.max_by(F.struct(col.alias("v")), place).alias(f"_t_{name}"))
            carried.append(F.lag(f"_t_{name}").over(across)["v"].alias(f"_c_{name}"))
            local[name] = F.lag(F.struct(col.alias("v"))).over(forward)
            final[name] = F.when(F.col(name).isNull(), F.col(f"_c_{name}")).otherwise(
                F.col(name)["v"]
            )
        for name, col in (following or {}).items():
            totals.append(F.min_by(F.struct(col.alias("v")), place).alias(f"_t_{name}"))
            carried.append(F.lead(f"_t_{name}").over(across)["v"].alias(f"_c_{name}"))
            local[name] = F.lead(F.struct(col.alias("v"))).over(forward)
            final[name] = F.when(F.col(name).isNull(), F.col(f"_c_{name}")).otherwise(
                F.col(name)["v"]
            )
        for name, col in (sums or {}).items():
            totals.append(F.sum(col).alias(f"_t_{name}"))
            carried.append(F.sum(f"_t_{name}").over(before).alias(f"_c_{name}"))
            local[name] = F.sum(col).over(so_far)
            zero = F.lit(0)
            final[name] = F.coalesce(F.col(name), zero) + F.coalesce(F.col(f"_c_{name}"), zero)
        for columns, frame in (
            (maxima, so_far),
            (maxima_before, forward.rowsBetween(Window.unboundedPreceding, -1)),
        ):
            for name, col in (columns or {}).items():
                totals.append(F.max(col).alias(f"_t_{name}"))
                carried.append(F.max(f"_t_{name}").over(before).alias(f"_c_{name}"))
                local[name] = F.max(col).over(frame)
                final[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
        for columns, frame in (
            (minima_ahead, backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            (minima_after, backward.rowsBetween(Window.unboundedPreceding, -1)),
        ):
            for name, col in (columns or {}).items():
                totals.append(F.min(col).alias(f"_t_{name}"))
                carried.append(F.min(f"_t_{name}").over(after).alias(f"_c_{name}"))
                local[name] = F.min(col).over(frame)
                final[name] = F.least(F.col(name), F.col(f"_c_{name}"))

        # Rows and totals both come from the table, so it is computed once before.
        df = self.df if self.stored else cut_lineage(self.df)
        edges = (
            df.groupBy(*keys, RANGE).agg(*totals).select(*keys, RANGE, *carried)
        )
        inside = df.withColumns(local)
        joined = inside.join(edges, [*keys, RANGE], "left").withColumns(final)
        return self._with(joined.drop(*[f"_c_{name}" for name in final]))

    def rows(self) -> DataFrame:
        return self.df.drop(RANGE)


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[int] = (4096, 64),
) -> DataFrame:
    """The first ``n`` rows of each group.  The group is narrowed in rounds: the first
    ``n`` of each salted part, then the first ``n`` of what is left; so no task sorts
    more than its part of the group, and the result is exact."""
    for parts in (*spread, 1):
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != "_part"]), F.lit(parts))
        df = df.withColumn("_part", salt)
        window = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
        df = df.drop("_rank")
    return df.drop("_part")


def first_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the lowest in ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    cuts: int = 64,
    task_rows: int = 100_000,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group.

    Equal values are counted first.  While a group has more different values than one task
    should sort, a mergeable sketch cuts them to ranges with about equally many, whatever their
    spread; exact counts tell in which ranges the wanted ranks lie, and only these go on.  The
    sketch decides where to cut and nothing else, so the result is exact."""
    keys = list(keys)
    counts = df.groupBy(*keys, value.cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = cut_lineage(counts.filter(F.col("_v").isNotNull()))
    totals = rows.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"_cell": zero, "_before": zero})
    ranks = []
    for p in probs.values():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        ranks += [F.floor(rank), F.ceil(rank)]

    def holds_a_rank(start: Column, end: Column) -> Column:
        inside = F.lit(False)
        for rank in ranks:
            inside |= (rank >= start) & (rank < end)
        return inside

    cell = [*keys, "_cell"]
    shares = [k / cuts for k in range(1, cuts)]
    while (rows.groupBy(*cell).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0] or 0) > task_rows:
        marks = rows.groupBy(*cell).agg(F.percentile_approx("_v", shares, 100 * cuts).alias("_marks"))
        nth = F.size(F.filter("_marks", lambda m: m < F.col("_v")))
        ranged = lookup_join(rows, marks, cell).withColumn("_nth", nth).drop("_marks")
        # a cell has as many ranges as cuts at most
        along = Window.partitionBy(*cell).orderBy("_nth")
        sizes = ranged.groupBy(*cell, "_nth").agg(F.sum("_n").alias("_size"), F.first("_before").alias("_before"))
        sizes = sizes.withColumn("_upto", F.col("_before") + F.sum("_size").over(along)).withColumn("_from", F.col("_upto") - F.col("_size"))
        needed = sizes.join(totals, keys).filter(holds_a_rank(F.col("_from"), F.col("_upto"))).select(*cell, "_nth", "_from")
        kept = lookup_join(ranged.drop("_before"), needed, [*cell, "_nth"], "inner")
        deeper = (F.col("_cell") * cuts + F.col("_nth")).alias("_cell")
        rows = cut_lineage(kept.select(*keys, "_v", "_n", deeper, F.col("_from").alias("_before")))
    within = Window.partitionBy(*cell).orderBy("_v")
    ranked = (
        rows.withColumn("_to", F.col("_before") + F.sum("_n").over(within))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .join(totals, keys)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))

    out = []
    for name, p in probs.items():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        weight = F.max(rank - F.floor(rank))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * weight).alias(name))
    return ranked.filter(holds_a_rank(F.col("_from"), F.col("_to"))).groupBy(*keys).agg(*out)
