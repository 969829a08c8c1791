"""Look-up of places among segments: the first segment that covers a place, and the nearest
starts and ends on both sides.

Between two neighbouring boundaries the answer is the same for every place.  So the segments
are cut once into stretches that do not overlap, each with its whole answer, and a place meets
one stretch.  No row for a place and a segment is made, however deep segments overlap."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import skew
from .ordered import OrderedRows
from .ranges import bin_of

ON = ("sample", "chr")
# Nodes of BASE^0, BASE^1 .. marks; a segment fills few nodes, a mark lies in one of each size.
BASE = 16
# Rows that a segment brings to the broadcast index: its stretches and the bins they touch.
ROWS_EACH = 5
FOUND = ("hit", "behind_start", "ahead_start", "behind_end", "ahead_end")


@dataclass(frozen=True)
class SegmentIndex:
    """``segments`` is a stored table, and so are the others unless they are small; ``outer``
    has the first and the last stretch of each chromosome; ``within`` says that all of it was
    counted and is small."""

    segments: DataFrame
    stretches: DataFrame
    outer: DataFrame
    width: int
    within: bool

    def binned(self) -> DataFrame:
        lo, hi = bin_of(F.col("at"), self.width), bin_of(F.col("to") - 1, self.width)
        return self.stretches.select(
            *[F.col(c).alias(f"_b_{c}") for c in ON],
            F.col("at").alias("_from"),
            F.col("to").alias("_to"),
            F.struct(*FOUND).alias("_found"),
            F.explode(F.sequence(lo, hi)).alias("_b_bin"),
        )


def _marks(segments: DataFrame) -> DataFrame:
    """One row per position at which a segment starts or has just ended, with the first such
    segments, and one row before the first position of each chromosome."""
    none = F.lit(None).cast("long")
    start, stop = F.col("startpos").cast("long"), F.col("endpos").cast("long") + 1
    both = F.array(
        F.struct(start.alias("at"), F.col("ordinal").alias("start_nth"), none.alias("end_nth")),
        F.struct(stop.alias("at"), none.alias("start_nth"), F.col("ordinal").alias("end_nth")),
    )
    marks = (
        segments.select(*ON, F.explode(both).alias("_m"))
        .select(*ON, "_m.*")
        .filter(F.col("at").isNotNull())
        .groupBy(*ON, "at")
        .agg(F.min("start_nth").alias("start_nth"), F.min("end_nth").alias("end_nth"))
    )
    before = marks.groupBy(*ON).agg((F.min("at") - 1).alias("at"))
    return marks.unionByName(before, allowMissingColumns=True)


def _first_cover(marks: DataFrame, segments: DataFrame, n: int, within: bool, task_rows: int) -> DataFrame:
    """(sample, chr, at, hit): the lowest ordinal of the segments that cover a mark.

    A segment covers marks of consecutive ranks.  These are the sum of few aligned nodes whose
    size is a power of ``BASE`` (one node where segments do not overlap); nodes keep their
    lowest ordinal, and a mark asks the node of each size that it lies in."""
    levels = 1
    while BASE**levels < 2 * n + 2:
        levels += 1
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    size = F.pow(F.lit(float(BASE)), F.col("_level"))

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        return left.join(right, keys) if within else skew.lookup_join(left, right, keys, "inner", 0, task_rows)

    def up(rank: str, by: Column) -> Column:
        return F.ceil(F.col(rank) / by).cast("long")

    def down(rank: str, by: Column) -> Column:
        return F.floor(F.col(rank) / by).cast("long")

    def run(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    spans = segments.select(
        *ON, F.col("startpos").cast("long").alias("_start"), (F.col("endpos").cast("long") + 1).alias("_stop"), "ordinal"
    )
    spans = spans.filter(F.col("_start") < F.col("_stop")).groupBy(*ON, "_start", "_stop").agg(F.min("ordinal").alias("ordinal"))
    for place, rank in (("_start", "_first"), ("_stop", "_end")):
        ranks = marks.select(*ON, F.col("at").alias(place), F.col("rank").alias(rank))
        spans = meet(spans, ranks, [*ON, place])
    first, end = up("_first", size), down("_end", size)
    # Nodes of the next size that lie inside, counted in nodes of this size.
    upper_first, upper_end = up("_first", BASE * size) * BASE, down("_end", BASE * size) * BASE
    covered = (upper_first < upper_end) & (F.col("_level") < levels - 1)
    own = F.when(covered, F.concat(run(first, upper_first), run(upper_end, end))).otherwise(run(first, end))
    nodes = (
        spans.select(*ON, "_first", "_end", "ordinal", level)
        .select(*ON, "_level", "ordinal", F.explode(own).alias("_node"))
        .groupBy(*ON, "_level", "_node")
        .agg(F.min("ordinal").alias("hit"))
    )
    if not within:
        # Where segments hardly overlap there are nodes of the smallest sizes only.
        nodes = cut_lineage(nodes)
        held = sorted(row[0] for row in nodes.select("_level").distinct().collect())
        level = F.explode(F.array(*[F.lit(k) for k in held]).cast("array<int>")).alias("_level")
    asked = marks.select(*ON, "at", "rank", level).withColumn("_node", down("rank", size))
    met = meet(asked, nodes, [*ON, "_level", "_node"])
    return met.groupBy(*ON, "at").agg(F.min("hit").alias("hit"))


def index_segments(
    segments: DataFrame,
    broadcast_rows: int = skew.BROADCAST_ROWS,
    task_rows: int = skew.TASK_ROWS,
) -> SegmentIndex:
    """Stretches of the segments (sample, chr, ordinal, startpos, endpos, ...), closed at both
    ends.  Segments without a position are in none; one that ends before it starts covers
    nothing, but has its two boundaries.  While the counted segments are few, plain windows
    carry the values along a chromosome; beyond that ranges of even size do."""
    segments = cut_lineage(segments.withColumn("ordinal", F.col("ordinal").cast("long")))
    sizes = segments.groupBy(*ON).agg(
        F.count("*").alias("n"), (F.max("endpos") - F.min("startpos")).cast("long").alias("span")
    )
    n, span = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("span")).first())
    within = ROWS_EACH * n <= broadcast_rows
    # About as many bins as segments.
    width = 1 << max(10, int(max(span, 0) // max(n, 1)).bit_length())

    marks = _marks(segments)
    starts, ends = F.col("start_nth").isNotNull(), F.col("end_nth").isNotNull()
    a_start = F.when(starts, F.struct("at", F.col("start_nth").alias("nth")))
    an_end = F.when(ends, F.struct((F.col("at") - 1).alias("at"), F.col("end_nth").alias("nth")))
    behind = {"behind_start": a_start, "behind_end": an_end}
    ahead = {"ahead_start": a_start, "ahead_end": an_end, "to": F.col("at")}
    if within:
        along = Window.partitionBy(*ON)
        so_far = along.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        later = along.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
        values = {name: F.max(c).over(so_far) for name, c in behind.items()}
        values |= {name: F.min(c).over(later) for name, c in ahead.items()}
        scanned = marks.withColumns(values | {"rank": F.row_number().over(along.orderBy("at")).cast("long")})
    else:
        one = F.lit(1).cast("long")
        scanned = OrderedRows(marks, ON, ["at"]).scan(maxima=behind, minima_after=ahead, sums={"rank": one}).rows()
    scanned = cut_lineage(scanned.drop("start_nth", "end_nth").withColumn("to", F.coalesce("to", F.col("at") + 1)))
    hits = _first_cover(scanned, segments, n, within, task_rows)
    stretches = scanned.join(hits if within else skew.shuffled(hits), [*ON, "at"], "left").select(*ON, "at", "to", *FOUND)
    outer = scanned.groupBy(*ON).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    if not within:
        stretches, outer = cut_lineage(stretches), cut_lineage(outer)
    return SegmentIndex(segments, stretches, outer, width, within)


def _meet(placed: DataFrame, stretches: DataFrame, keys: Mapping[str, str], how: str) -> DataFrame:
    same = (F.col("_from") <= F.col("_in")) & (F.col("_in") < F.col("_to"))
    for left, right in keys.items():
        same &= F.col(left) == F.col(right)
    return placed.join(stretches, same, how)


def look_up(
    df: DataFrame,
    index: SegmentIndex,
    places: Mapping[str, tuple[Column, Column]],
    task_rows: int = skew.TASK_ROWS,
) -> DataFrame:
    """Rows of ``df`` (with ``sample``) and, for each named place (chromosome, position), a
    struct of that name: ``hit``, the ordinal of the first segment that covers the place, and
    the nearest boundaries ``behind_`` and ``ahead_`` (position and ordinal).  NULL for a place
    without a position, or on a chromosome without segments.

    A small index is broadcast and the rows stay where they are.  Otherwise the rows, stored,
    shuffle to the stretches once for each place."""
    width = index.width
    # Places beyond all boundaries have the answer of the outermost stretch.
    inner = F.when(F.col("_at").isNotNull(), F.greatest(F.least("_at", "_last"), F.col("_first")))
    given = df.columns
    if index.within:
        outer = F.broadcast(index.outer.withColumnsRenamed({"sample": "_o_sample", "chr": "_o_chr"}))
        stretches = F.broadcast(index.binned())
        reach: dict[str, int] = {}
        for name, (chrom, at) in places.items():
            nth = reach.setdefault(str(chrom), len(reach))
            ends = [f"_first{nth}", f"_last{nth}"]
            if ends[0] not in df.columns:
                on_it = (F.col("sample") == F.col("_o_sample")) & (chrom == F.col("_o_chr"))
                df = df.join(outer, on_it, "left").withColumnsRenamed(dict(zip(("_first", "_last"), ends)))
                df = df.drop("_o_sample", "_o_chr")
            columns = df.columns
            placed = df.withColumns({"_chr": chrom, "_at": at.cast("long"), "_first": F.col(ends[0]), "_last": F.col(ends[1])})
            placed = placed.withColumn("_in", inner).withColumn("_bin", bin_of(F.col("_in"), width))
            met = _meet(placed, stretches, {"sample": "_b_sample", "_chr": "_b_chr", "_bin": "_b_bin"}, "left")
            df = met.select(*columns, F.col("_found").alias(name))
        return df.select(*given, *places)
    asked = {name: (*place, index.binned()) for name, place in places.items()}
    return _ask(cut_lineage(df), index, asked, task_rows).select(*given, *places)


def _ask(df: DataFrame, index: SegmentIndex, places: Mapping[str, tuple[Column, Column, DataFrame]], task_rows: int) -> DataFrame:
    """The rows of a stored table with ``_found`` of the binned stretches of each place (chromosome,
    position, stretches), joined one after the other; a place meets one stretch, so a row stays
    one.  Rows of crowded bins are counted for all places in one look at the table."""
    on = ["_b_sample", "_b_chr", "_b_bin"]
    out, keys = df, {}
    for name, (chrom, at, _) in places.items():
        edges = index.outer.select("sample", *[F.col(c).alias(f"_{name}{c}") for c in ("chr", "_first", "_last")])
        at = at.cast("long")
        out = skew.lookup_join(out.withColumn(f"_{name}chr", chrom), edges, ["sample", f"_{name}chr"], task_rows=task_rows)
        # Places beyond all boundaries have the answer of the outermost stretch.
        inner = F.greatest(F.least(at, f"_{name}_last"), F.col(f"_{name}_first"))
        out = out.withColumn(f"_{name}_in", F.when(at.isNotNull(), inner)).drop(f"_{name}_first", f"_{name}_last")
        keys[name] = [F.col("sample"), F.col(f"_{name}chr"), F.coalesce(bin_of(F.col(f"_{name}_in"), index.width), skew.spread(df))]
    counted = out
    crowded = skew.crowded_buckets(counted, list(keys.values()), task_rows)
    for (name, key), buckets in zip(keys.items(), crowded):
        keyed = [c.alias(n) for n, c in zip(on, key)]
        hot = skew.crowded_keys(counted.select(*keyed), on, task_rows, buckets)
        left, right, joined = skew.salted(out.select(*out.columns, *keyed), places[name][2], on, hot, None, task_rows)
        right = skew.shuffled(right.withColumnsRenamed({k: f"_r{k}" for k in joined}))
        kept = [c for c in out.columns if c not in (f"_{name}chr", f"_{name}_in")]
        met = _meet(left.withColumn("_in", F.col(f"_{name}_in")), right, {k: f"_r{k}" for k in joined}, "left")
        out = met.select(*kept, F.col("_found").alias(name))
    return out


def look_up_values(
    df: DataFrame,
    index: SegmentIndex,
    places: Mapping[str, tuple[Column, Column]],
    values: DataFrame,
    task_rows: int = skew.TASK_ROWS,
) -> DataFrame:
    """Rows of ``df`` and, for each named place, a struct of that name: ``hit`` and ``value``, the
    column ``value`` of ``values`` (sample, chr, ordinal, value) at that ordinal; NULL where no
    segment covers the place.  Beyond the broadcast a value goes along with its stretches, so
    that rows are not joined again for it."""
    given = df.columns
    if index.within:
        found = look_up(df, index, places, task_rows)
        for name, (chrom, _) in places.items():
            hit = F.col(f"{name}.hit")
            found = attach(found, index, values, chrom, hit, "_value", task_rows)
            both = F.struct(hit.alias("hit"), F.col("_value").alias("value"))
            found = found.withColumn(name, F.when(hit.isNotNull(), both)).drop("_value")
        return found.select(*given, *places)
    held = covering(index, values, task_rows)
    asked = {name: (*place, held) for name, place in places.items()}
    return _ask(cut_lineage(df), index, asked, task_rows).select(*given, *places)


def covering(index: SegmentIndex, values: DataFrame, task_rows: int = skew.TASK_ROWS) -> DataFrame:
    """Binned stretches that a segment covers, found: its ordinal and its value."""
    asked = index.stretches.filter(F.col("hit").isNotNull()).select(*ON, "at", "to", F.col("hit").alias("ordinal"))
    held = skew.lookup_join(asked, values, [*ON, "ordinal"], "inner", 0, task_rows)
    lo, hi = bin_of(F.col("at"), index.width), bin_of(F.col("to") - 1, index.width)
    return cut_lineage(
        held.select(
            *[F.col(c).alias(f"_b_{c}") for c in ON],
            F.col("at").alias("_from"),
            F.col("to").alias("_to"),
            F.struct(F.col("ordinal").alias("hit"), "value").alias("_found"),
            F.explode(F.sequence(lo, hi)).alias("_b_bin"),
        )
    )


def nearest(found: str, pos: Column, kind: str) -> Column:
    """Struct (distance, ordinal) of the nearest ``start`` or ``end`` either way; among equally
    near ones the first in the file."""
    behind, ahead = F.col(f"{found}.behind_{kind}"), F.col(f"{found}.ahead_{kind}")
    pos = pos.cast("long")

    def away(edge: Column, distance: Column) -> Column:
        return F.when(edge.isNotNull(), F.struct(distance.alias("distance"), edge["nth"].alias("ordinal")))

    return F.least(away(behind, F.abs(pos - behind["at"])), away(ahead, F.abs(ahead["at"] - pos)))


def attach(
    df: DataFrame,
    index: SegmentIndex,
    values: DataFrame,
    chrom: Column,
    ordinal: Column,
    name: str,
    task_rows: int = skew.TASK_ROWS,
) -> DataFrame:
    """``name``: the column ``value`` of ``values`` (sample, chr, ordinal, value) at an ordinal."""
    columns = df.columns
    keys = ["sample", "_d_chr", "_d_nth"]
    detail = values.select("sample", F.col("chr").alias("_d_chr"), F.col("ordinal").alias("_d_nth"), F.col("value").alias(name))
    asked = df.withColumns({"_d_chr": chrom, "_d_nth": ordinal})
    if index.within:
        return asked.join(F.broadcast(detail), keys, "left").select(*columns, name)
    # Rows without an ordinal meet nothing, and spread out they do not all land in one task.
    asked = asked.withColumn("_d_spread", F.when(F.col("_d_nth").isNull(), skew.spread(df) + 1).otherwise(0).cast("long"))
    detail = detail.withColumn("_d_spread", F.lit(0).cast("long"))
    joined = skew.lookup_join(asked, detail, [*keys, "_d_spread"], "left", 0, task_rows)
    return joined.select(*columns, name)
