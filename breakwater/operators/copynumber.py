"""Variants matched to copy-number segments.

Segments: (sample, chr, ordinal, startpos, endpos, states), closed at both ends;
``ordinal`` is the place in the file, which decides between overlapping segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..params import DEFAULTS, Params
from ..session import cut_lineage, small_methods
from . import stabbing
from .ordered import OrderedRows


def in_file_order(segments: DataFrame) -> DataFrame:
    """Segments whose ``ordinal`` is a whole number; the place in a text file (a struct)
    becomes the rank in its sample, which has few segments."""
    if not isinstance(segments.schema["ordinal"].dataType, StructType):
        return segments
    order = Window.partitionBy("sample").orderBy("ordinal")
    return segments.withColumn("ordinal", F.row_number().over(order).cast("long"))


def with_neighbours(segments: DataFrame, few: bool = False) -> DataFrame:
    """Each segment with the states of the segment before and after it in the file on
    its chromosome; at the edge its own.  ``few`` says that all segments were counted and
    may lie in one task."""
    own = F.col("states")
    if few:
        along = Window.partitionBy("sample", "chr").orderBy("ordinal")
        return segments.withColumns(
            {
                "prev_states": F.coalesce(F.lag("states").over(along), own),
                "next_states": F.coalesce(F.lead("states").over(along), own),
            }
        )
    scan = OrderedRows(segments, ["sample", "chr"], ["ordinal"]).scan(
        previous={"prev_states": own}, following={"next_states": own}
    )
    return scan.rows().withColumns(
        {c: F.coalesce(c, own) for c in ("prev_states", "next_states")}
    )


def match_snvs(snvs: DataFrame, segments: DataFrame, **options) -> DataFrame:
    """SNVs with the ``states`` of the first segment that holds them."""
    index = stabbing.index_segments(in_file_order(segments), **options)
    values = index.segments.select("sample", "chr", "ordinal", F.col("states").alias("value"))
    place = {"_hit": (F.col("chrom"), F.col("pos"))}
    found = stabbing.look_up_values(snvs, index, place, values, **_rows(options))
    return found.withColumn("states", F.col("_hit.value")).drop("_hit")


def look_up_position(
    end: int, sv_offset: int, classification: Column | None = None
) -> Column:
    """Position at which an SV end is looked up: ``sv_offset`` away from the break, on
    the side that stays in the derivative chromosome."""
    pos, direction = F.col(f"pos{end}"), F.col(f"dir{end}")
    cls = F.col("classification") if classification is None else classification
    step = F.when(cls == "INTRX", F.when(direction == "+", -1).otherwise(1)).otherwise(
        -1 if end == 1 else 1
    )
    return F.when(direction == ".", F.lit(-1)).otherwise(pos + step * sv_offset)


def match_sv_states(
    svs: DataFrame, segments: DataFrame, p: Params = DEFAULTS, value: str = "states", **options
) -> DataFrame:
    """Add states1 and states2: those of the first segment at each look-up position."""
    index = stabbing.index_segments(in_file_order(segments), **options)
    values = index.segments.select("sample", "chr", "ordinal", F.col(value).alias("value"))
    places = {f"_hit{e}": (F.col(f"chr{e}"), look_up_position(e, p.sv_offset)) for e in (1, 2)}
    out = stabbing.look_up_values(svs, index, places, values, **_rows(options))
    return out.withColumns({f"states{e}": F.col(f"_hit{e}.value") for e in (1, 2)}).drop(*places)


def _rows(options: dict) -> dict:
    return {k: v for k, v in options.items() if k == "task_rows"}


def match_svs(
    svs: DataFrame,
    segments: DataFrame,
    p: Params = DEFAULTS,
    ends: tuple[int, ...] = (1, 2),
    **options,
) -> DataFrame:
    """For each end, add states, adjacent_states and boundary_dist.

    A look-up position inside a segment takes its states, and the neighbour on the side
    of the nearest boundary as adjacent.  Otherwise the segment with the nearest boundary
    is adjacent (strict) or taken as the match with its neighbour as adjacent.  Boundaries
    are measured from the break itself; among equally near ones an end counts before a start."""
    index = stabbing.index_segments(in_file_order(segments), **options)
    around = with_neighbours(index.segments, index.within).select(
        "sample", "chr", "ordinal", F.struct("states", "prev_states", "next_states").alias("value")
    )
    places = {}
    for e in ends:
        places[f"_hit{e}"] = (F.col(f"chr{e}"), look_up_position(e, p.sv_offset))
        places[f"_at{e}"] = (F.col(f"chr{e}"), F.col(f"pos{e}"))
    out = stabbing.look_up(svs, index, places, **_rows(options))
    for e in ends:
        start, end = (stabbing.nearest(f"_at{e}", F.col(f"pos{e}"), kind) for kind in ("start", "end"))
        out = out.withColumns({f"_start{e}": start, f"_end{e}": end, f"_nth{e}": F.col(f"_hit{e}.hit")})
    out = out.drop(*places)
    if not index.within:
        # Read once to count crowded segments and once to join, for each end; no states yet.
        with small_methods(out.sparkSession):
            out = cut_lineage(out)
    columns = list(svs.columns)
    for e in ends:
        chrom, hit = F.col(f"chr{e}"), F.col(f"_nth{e}")
        to_start, to_end = F.col(f"_start{e}.distance"), F.col(f"_end{e}.distance")
        from_start = to_start < to_end
        nearer = F.when(from_start, F.col(f"_start{e}.ordinal")).otherwise(F.col(f"_end{e}.ordinal"))
        out = stabbing.attach(out, index, around, chrom, F.coalesce(hit, nearer), "_seg", **_rows(options))
        inside, seg = hit.isNotNull(), F.col("_seg")
        outer = F.when(from_start, seg["prev_states"]).otherwise(seg["next_states"])
        inner = F.when(to_start > to_end, seg["next_states"]).otherwise(seg["prev_states"])
        added = {
            f"states{e}": F.when(inside, seg["states"]).otherwise(
                F.lit(None) if p.strict_cnv else seg["states"]
            ),
            f"adjacent_states{e}": F.when(inside, inner).otherwise(
                seg["states"] if p.strict_cnv else outer
            ),
            f"boundary_dist{e}": F.least(to_start, to_end),
        }
        columns += added
        out = out.withColumns(added).drop(f"_start{e}", f"_end{e}", f"_nth{e}", "_seg")
    return out.select(*columns)
