"""Direction, position and class of SVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions.genome import canonical_breakends, natural_key, sv_class
from ..params import DEFAULTS, Params
from ..session import cut_lineage, free_shuffles
from . import placed_reads
from .counting import breakend_windows, window_depth, with_limits
from .filters import blacklist_hits, merged
from .matching import breakends
from .ordered import OrderedRows, first_of_each
from .ranges import BIN, grid_join, overlap_join
from .skew import SALTS, lookup_join

# A share of left-anchored split reads strictly between these is mixed evidence.
MIXED_LOW, MIXED_HIGH = 0.1, 0.9


# ---------------------------------------------------------------- evidence at the ends


# Bins of ends and split reads, which meet within a few bases.
END_BIN = 256


def split_reads_at_ends(
    svs: DataFrame, reads: DataFrame, limits: DataFrame, p: Params = DEFAULTS, **options
) -> tuple[DataFrame, DataFrame]:
    """Split reads near each end, one row without a read for an end that has other reads only,
    and the SVs with ``depth_tag`` HIDEP where a window is above the depth cap (no reads are
    returned for an SV with such an end).

    Whether an end has reads follows from the depth sweep, and ordinary reads are no evidence,
    so only split reads anchored near an end make pairs; they are made distinct before.  An end
    lies in one bin, which its rows are partitioned by (see ``_end_keys``)."""
    reach = 2 * p.threshold
    ready = with_limits(svs, limits.select("sample", "max_dp"), p)
    depth = window_depth(breakend_windows(ready, F.lit(reach)), reads, **options)
    deepest = depth.groupBy("sample", "sv_id").agg(
        *[F.max(F.when(F.col("bp") == e, F.col("depth"))).alias(f"_depth{e}") for e in (1, 2)]
    )
    ready = cut_lineage(ready.join(deepest, ["sample", "sv_id"], "left"))
    free_shuffles(svs.sparkSession)
    deep = F.coalesce(F.greatest("_depth1", "_depth2") > F.col("max_dp"), F.lit(False))
    ready = ready.withColumn("depth_tag", F.when(deep, "HIDEP"))
    shallow = ready.filter(F.col("depth_tag").isNull())
    ends = breakends(shallow, ("dir", "_depth")).filter(F.col("_depth") > 0)
    ends = ends.select("sample", "sv_id", "bp", "chrom", "pos", "dir")
    near = _with_split_reads(ends, placed_reads.near(reads, breakend_windows(shallow, F.lit(reach))), p, **options)
    return near, ready.drop("_depth1", "_depth2", "max_dp")


def _with_split_reads(ends: DataFrame, reads: DataFrame, p: Params, **options) -> DataFrame:
    """Ends with the distinct split reads of their windows, by the anchor of the clipped side: a
    consensus lies less than a reach from its end, and its own split reads less than another."""
    reach = 2 * p.threshold
    read = R.flat()
    left_anchored = R.left_clip(read) < R.LENIENT_ANCHOR
    clipped = F.when(left_anchored, R.right_clip(read)).when(~left_anchored, R.left_clip(read)) >= p.threshold
    split = reads.filter(clipped & (F.col("ref_start") < F.col("ref_end"))).select("sample", *R.FIELDS).distinct()
    split = split.select(
        "sample", F.col("chrom"), F.when(left_anchored, F.col("ref_end")).otherwise(F.col("ref_start")).alias("_anchor"), *[c for c in R.FIELDS if c not in ("query_name", "chrom", "ins_len", "is_reverse")]
    )
    pairs, _ = overlap_join(
        ends,
        split,
        ["sample", "chrom"],
        (F.col("pos"), F.col("pos") + 1),
        (F.col("_anchor") - 2 * reach, F.col("_anchor") + 2 * reach),
        END_BIN,
        how="left",
        **options,
    )
    # of the window, which is narrower than the consensus reaches
    inside = (F.col("ref_start") < F.col("pos") + reach) & (F.col("ref_end") > F.greatest(F.col("pos") - reach, F.lit(0)) - 1)
    fields = ("ref_start", "ref_end", "align_start", "align_end", "len")
    return pairs.withColumns({c: F.when(inside, F.col(c)) for c in fields}).drop("_anchor")


def _end_keys(near: DataFrame) -> list[str]:
    """What names an end, and what its rows are partitioned by already."""
    return ["sample", "sv_id", "bp", *[c for c in ("chrom", BIN, *SALTS) if c in near.columns]]


def consensus_positions(near: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Most frequent end and start of the split reads around each end (the lowest of
    equally frequent ones)."""
    split = R.split_lenient(R.flat(), F.col("pos"), 2 * p.threshold)
    return (
        near.filter(split)
        .groupBy(*_end_keys(near))
        .agg(
            F.mode("ref_end", True).alias("ca_right"),
            (F.mode("ref_start", True) + 1).alias("ca_left"),
        )
    )


def recalibrated_positions(near: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(sample, sv_id, bp, new_pos): the consensus on the side of the direction."""
    keys = _end_keys(near)
    cons = consensus_positions(near, p)
    ends = near.groupBy(*keys).agg(
        F.first("pos").alias("pos"), F.first("dir").alias("dir")
    )
    side = F.when(F.col("dir") == "+", F.col("ca_right")).otherwise(F.col("ca_left"))
    found = F.coalesce(F.nullif(side, F.lit(0)), F.col("pos"))
    return ends.join(cons, keys, "left").select(
        "sample", "sv_id", "bp", found.alias("new_pos")
    )


def _left_share(read_at: Column, sc_len: int) -> Column:
    """Share of left-anchored reads among those for which ``read_at`` holds."""
    anchored = F.when(F.col("align_start") < sc_len, 1.0).otherwise(0.0)
    return F.avg(F.when(read_at, anchored))


def end_evidence(near: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per end: dir (NULL where unclear), mixed, and the consensus positions that lie
    close enough to the end."""
    reach = 2 * p.threshold
    cons = consensus_positions(near, p)
    keys = _end_keys(near)
    joined = near.join(cons, keys, "left")
    joined = joined.withColumns(
        {
            c: F.when(F.abs(F.col(c) - F.col("pos")) < reach, F.nullif(F.col(c), F.lit(0)))
            for c in ("ca_right", "ca_left")
        }
    )
    read = R.flat()
    shares = {
        name: _left_share(R.split_lenient(read, F.col(name), reach), p.sc_len)
        for name in ("pos", "ca_right", "ca_left")
    }
    toward = _left_share(R.split_lenient(read, F.col("pos"), p.threshold), p.threshold)
    per_end = joined.groupBy(*keys).agg(
        F.first("ca_right").alias("ca_right"),
        F.first("ca_left").alias("ca_left"),
        toward.alias("_toward"),
        *[c.alias(f"_share_{n}") for n, c in shares.items()],
    )
    mixed = F.lit(False)
    for name in shares:
        share = F.col(f"_share_{name}")
        mixed |= F.coalesce((share > MIXED_LOW) & (share < MIXED_HIGH), F.lit(False))
    per_end = per_end.withColumn("mixed", mixed)
    direction = F.when(F.col("mixed"), None).when(F.col("_toward") > 0.5, "+").when(
        F.col("_toward").isNotNull(), "-"
    )
    return per_end.select(
        "sample", "sv_id", "bp", direction.alias("dir"), "mixed", "ca_right", "ca_left"
    )


def infer_directions(
    svs: DataFrame, reads: DataFrame, limits: DataFrame, p: Params = DEFAULTS, **options
) -> DataFrame:
    """SVs with inferred directions, tags and consensus positions of both ends.  An end
    without split reads is UNKNOWN_DIR, one with evidence for both sides MIXED."""
    near, status = split_reads_at_ends(svs, reads, limits, p, **options)
    evidence = end_evidence(near, p)
    wide = evidence.groupBy("sample", "sv_id").agg(
        *[
            F.max(F.when(F.col("bp") == e, F.col(c))).alias(f"{c}{e}")
            for e in (1, 2)
            for c in ("dir", "mixed", "ca_right", "ca_left")
        ]
    )
    taken = ["dir1", "dir2", "tags"]
    out = status.drop(*taken).join(wide, ["sample", "sv_id"], "left")

    def tag(e: int) -> Column:
        return F.when(F.coalesce(F.col(f"mixed{e}"), F.lit(False)), "MIXED").when(
            F.col(f"dir{e}").isNull(), "UNKNOWN_DIR"
        )

    tags = F.when(F.col("depth_tag").isNotNull(), F.array("depth_tag")).otherwise(
        F.array_compact(F.array(tag(1), tag(2)))
    )
    return out.withColumn("tags", tags).drop("depth_tag", "mixed1", "mixed2")


def recalibrate(
    svs: DataFrame, reads: DataFrame, limits: DataFrame, p: Params = DEFAULTS, **options
) -> DataFrame:
    """SVs moved to the consensus position of their split reads, where there is one."""
    near, _ = split_reads_at_ends(svs, reads, limits, p, **options)
    moved = recalibrated_positions(near, p)
    wide = moved.groupBy("sample", "sv_id").agg(
        *[F.max(F.when(F.col("bp") == e, F.col("new_pos"))).alias(f"_new{e}") for e in (1, 2)]
    )
    out = svs.join(wide, ["sample", "sv_id"], "left")
    return out.withColumns(
        {f"pos{e}": F.coalesce(F.col(f"_new{e}"), F.col(f"pos{e}")) for e in (1, 2)}
    ).select(*svs.columns)


def tag_blacklisted(svs: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """Adds BLACKLIST to the tags of SVs with an end in an interval."""
    ends = breakends(svs)
    hit = (
        blacklist_hits(ends, merged(intervals), "left_semi", **options)
        .select("sample", "sv_id")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    joined = svs.join(hit, ["sample", "sv_id"], "left")
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return joined.withColumn(
        "tags", F.when(F.col("_hit"), F.array_append(tags, F.lit("BLACKLIST"))).otherwise(tags)
    ).drop("_hit")


# ---------------------------------------------------------------- classes and events

_PLACE = ["pos1", "_dir1", "pos2", "_dir2", "sv_id"]


def _intra_rows(svs: DataFrame, p: Params) -> OrderedRows:
    """SVs within one chromosome in natural order; ``open`` ones have no tag yet."""
    tags = F.col("tags") if "tags" in svs.columns else F.lit(None).cast("array<string>")
    rows = svs.filter(F.col("chr1") == F.col("chr2")).withColumns(
        {
            "chr_key": natural_key("chr1"),
            "_dir1": F.coalesce(F.col("dir1"), F.lit("?")),
            "_dir2": F.coalesce(F.col("dir2"), F.lit("?")),
            "open": F.coalesce(F.size(tags), F.lit(0)) <= 0,
            "code": sv_class(p.insertion_distance),
        }
    )
    return OrderedRows(rows, ["sample", "chr_key"], _PLACE)


def interspersed_duplications(svs: DataFrame, p: Params = DEFAULTS) -> OrderedRows:
    """Ordered intra-chromosomal SVs with ``intdup``: rows that form an interspersed
    duplication with the open row before them, called ``prev``.

    A row pairs with the row before it when they are near and one is DUP, the other DEL,
    and that row is not itself the second of a pair.  In a run of such rows every second
    one is marked.  Near rows of unknown class that follow a marked row are marked too."""
    scan = _intra_rows(svs, p)
    is_open, code = F.col("open"), F.col("code")
    scan = scan.scan(
        maxima_before={"prev": F.when(is_open, F.struct(*_PLACE, "code"))},
        sums={"_nth": F.when(is_open, 1).otherwise(0)},
    )
    prev = F.col("prev")
    near = (F.abs(prev["pos1"] - F.col("pos1")) < p.neighbour_distance) | (
        F.abs(prev["pos2"] - F.col("pos2")) < p.neighbour_distance
    )
    near = is_open & F.coalesce(near, F.lit(False))
    pair = ((code == "DUP") & (prev["code"] == "DEL")) | ((code == "DEL") & (prev["code"] == "DUP"))
    scan = scan.add(_link=near & F.coalesce(pair, F.lit(False)), _vague=near & (code == "Unknown"))
    loose = is_open & ~F.col("_link")
    firm = is_open & ~F.col("_vague")
    scan = scan.scan(
        maxima={
            # Where the run of a row starts, with and without vague rows as starts.
            "_run_from": F.when(loose, F.col("_nth")),
            "_firm_from": F.when(loose & firm, F.col("_nth")),
            # The row that a run of vague rows follows.
            "_anchor": F.when(firm, F.struct("_nth", "_link")),
        }
    )
    second = F.col("_link") & ((F.col("_nth") - F.col("_run_from")) % 2 == 1)
    anchor = F.col("_anchor")
    anchor_second = anchor["_link"] & ((anchor["_nth"] - F.col("_firm_from")) % 2 == 1)
    marked = second | (F.col("_vague") & anchor_second)
    return scan.add(intdup=is_open & F.coalesce(marked, F.lit(False)))


def with_event_ids(scan: OrderedRows) -> OrderedRows:
    """Running number over the sample that an interspersed duplication does not advance."""
    return scan.scan(
        keys=["sample"],
        sums={
            "event_id": F.when(F.col("intdup"), 0).otherwise(1),
            "_index": F.lit(1),
        },
    )


def classify_pairs(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Class of each SV within a chromosome before events are joined up."""
    cls = F.when(F.col("intdup"), "INTDUP").otherwise(F.col("code"))
    scan = with_event_ids(interspersed_duplications(svs, p))
    return scan.rows().select("sample", "sv_id", "open", cls.alias("classification"), "event_id")


def translocations(rows: DataFrame, tolerance: int, **options) -> DataFrame:
    """(sample, _index, trx_id) of rows that take part in a translocation: the two rows
    of an interspersed duplication and the first other SV that deletes its mobile part."""
    ahead = F.abs(F.col("pos1") - F.col("prev.pos1")) > tolerance
    one = F.when(ahead, F.col("prev.pos1")).otherwise(F.col("prev.pos2"))
    two = F.when(ahead, F.col("pos1")).otherwise(F.col("pos2"))
    events = rows.filter("intdup").select(
        "sample",
        "chr_key",
        F.col("_index").alias("_at"),
        F.col("prev_index").alias("_prev_at"),
        F.least(one, two).alias("_from"),
        F.greatest(one, two).alias("_to"),
    )
    # Two rows of a place can be the pair itself, so its first three are enough.
    place = Window.partitionBy("sample", "chr_key", "pos1", "pos2").orderBy("_index")
    deletions = (
        rows.filter((F.col("dir1") == "+") & (F.col("dir2") == "-"))
        .select("sample", "chr_key", "pos1", "pos2", "_index")
        .withColumn("_n", F.row_number().over(place))
        .filter(F.col("_n") <= 3)
        .drop("_n")
    )
    pairs, _ = grid_join(
        events,
        deletions,
        ["sample", "chr_key"],
        (F.col("_from"), F.col("_to")),
        (F.col("pos1"), F.col("pos2")),
        tolerance,
        **options,
    )
    others = pairs.filter(
        (F.col("_index") != F.col("_at")) & (F.col("_index") != F.col("_prev_at"))
    )
    third = others.groupBy("sample", "_at", "_prev_at").agg(F.min("_index").alias("_third"))
    members = third.select(
        "sample",
        (F.col("_at") - 2).alias("trx_id"),
        F.explode(F.array("_at", "_prev_at", "_third")).alias("_index"),
    )
    return members.groupBy("sample", "_index").agg(F.max("trx_id").alias("trx_id"))


def classify(svs: DataFrame, p: Params = DEFAULTS, **options) -> DataFrame:
    """All SVs with ``classification`` and ``event_id``.  Tagged rows keep their tags as
    class.  The row before an interspersed duplication belongs to it; both become TRX,
    with a third SV, where that one deletes the part that moved."""
    svs = canonical_breakends(svs)
    scan = with_event_ids(interspersed_duplications(svs, p))
    is_open = F.col("open")
    scan = scan.scan(
        maxima_before={"prev_index": F.when(is_open, F.col("_index"))},
        minima_after={"_next_open": F.when(is_open, F.struct("_index", "intdup"))},
    )
    joined_by_next = is_open & F.coalesce(F.col("_next_open")["intdup"], F.lit(False))
    scan = scan.add(_joined=F.col("intdup") | joined_by_next)
    rows = cut_lineage(scan.rows())
    trx = translocations(rows, p.threshold, **options)
    rows = rows.join(trx, ["sample", "_index"], "left")
    moved = F.col("trx_id").isNotNull()
    tags = F.concat_ws(";", "tags") if "tags" in svs.columns else F.lit("")
    label = (
        F.when(moved, "TRX")
        .when(F.col("_joined"), "INTDUP")
        .when(is_open, F.col("code"))
        .otherwise(tags)
    )
    intra = rows.withColumns(
        {
            "classification": label,
            "event_id": F.coalesce(F.col("trx_id"), F.col("event_id")).cast("long"),
        }
    )
    columns = [c for c in svs.columns if c not in ("classification", "event_id")]
    inter = svs.filter(F.col("chr1") != F.col("chr2"))
    between = F.when(tags == "", "INTRX").otherwise(tags)
    inter = inter.withColumns(
        {"classification": between, "event_id": F.col("sv_id").cast("long")}
    )
    out = [*columns, "classification", "event_id"]
    return intra.select(*out).unionByName(inter.select(*out))


def dedupe(svs: DataFrame) -> DataFrame:
    """One SV per set of positions and directions, the first by id."""
    return first_of_each(
        svs, ["sample", "chr1", "pos1", "dir1", "chr2", "pos2", "dir2"], "sv_id"
    )


def position_ranks(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rank of each end among the distinct positions of its sample and chromosome, where
    positions within the threshold of their neighbour count as one."""
    ends = breakends(svs.filter(F.col("chr1") == F.col("chr2")))
    scan = OrderedRows(ends, ["sample", "chrom"], ["pos", "sv_id", "bp"]).scan(
        previous={"_before": F.col("pos")}
    )
    apart = F.col("_before").isNull() | (F.col("pos") - F.col("_before") > p.threshold)
    scan = scan.add(_new=F.when(apart, 1).otherwise(0)).scan(sums={"rank": F.col("_new")})
    return (
        scan.rows()
        .groupBy("sample", "sv_id")
        .agg(
            F.max(F.when(F.col("bp") == 1, F.col("rank"))).alias("rank1"),
            F.max(F.when(F.col("bp") == 2, F.col("rank"))).alias("rank2"),
        )
    )
