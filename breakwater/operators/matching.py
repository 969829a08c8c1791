"""SVs matched to other SVs by nearby ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import canonical_breakends
from ..params import DEFAULTS, Params
from .ranges import bin_of, grid_join
from .skew import lookup_join

# Length of the stretches in which ends are compared with their neighbours, in thresholds.
STRETCH = 512


def drop_germline(svs: DataFrame, germline: DataFrame, p: Params = DEFAULTS, **options) -> DataFrame:
    """SVs without a germline SV (of enough support) at nearly the same ends."""
    return germline_join(svs, germline, "left_anti", p, **options)


def germline_join(svs: DataFrame, germline: DataFrame, how: str, p: Params = DEFAULTS, **options) -> DataFrame:
    """SVs with (left_semi) or without (left_anti) a germline SV at nearly the same ends.  Both
    sides are put in canonical order, so that swapped ends match too."""
    places = (
        canonical_breakends(germline.filter(F.col("support") > p.germline_min_support))
        .select(
            "sample",
            F.col("chr1").alias("_chr_a"),
            F.col("chr2").alias("_chr_b"),
            F.col("pos1").alias("_germ_a"),
            F.col("pos2").alias("_germ_b"),
        )
        .distinct()
    )
    ends = svs.select("sample", "chr1", "pos1", "chr2", "pos2", F.struct(*svs.columns).alias("_sv"))
    ends = canonical_breakends(ends).withColumnsRenamed({"chr1": "_chr_a", "chr2": "_chr_b"})
    kept, _ = grid_join(
        ends,
        places,
        ["sample", "_chr_a", "_chr_b"],
        (F.col("pos1"), F.col("pos2")),
        (F.col("_germ_a"), F.col("_germ_b")),
        p.germline_threshold,
        how=how,
        **options,
    )
    return kept.select("_sv.*")


def match_sv_sets(
    left: DataFrame, right: DataFrame, pairs: DataFrame | None = None, p: Params = DEFAULTS, **options
) -> DataFrame:
    """Full outer match of two call sets.

    ``left`` and ``right``: (sample, ordinal, chr1, pos1, dir1, chr2, pos2, dir2).
    ``pairs`` says which samples to compare (left_sample, right_sample); without it the
    sets are compared as they are, under one name.  A left row takes the first right row
    that has equal chromosomes and directions, or all swapped, and both positions within
    the distance; a right row may serve several left rows.  Result: left_sample,
    left_ordinal, right_sample, right_ordinal, NULL where unmatched."""
    named_l = left.withColumnsRenamed({"sample": "left_sample", "ordinal": "left_ordinal"})
    named_r = right.withColumnsRenamed({"sample": "right_sample", "ordinal": "right_ordinal"})
    group = ["_group"]
    if pairs is None:
        named_l = named_l.withColumn("_group", F.lit(""))
        named_r = named_r.withColumn("_group", F.lit(""))
    else:
        named_l = lookup_join(named_l, pairs, ["left_sample"])
        named_l = named_l.withColumnRenamed("right_sample", "_group")
        named_r = named_r.withColumn("_group", F.col("right_sample"))

    shape = ["chr1", "chr2", "dir1", "dir2"]
    ends_l = canonical_breakends(named_l)
    ends_r = canonical_breakends(named_r)
    # One right row per place is enough: the first of those that lie there.
    first_r = (
        ends_r.groupBy(*group, *shape, F.col("pos1").alias("_pos_a"), F.col("pos2").alias("_pos_b"))
        .agg(F.min(F.struct("right_ordinal", "right_sample")).alias("_right"))
    )
    pairs_found, partitioning = grid_join(
        ends_l.select("left_sample", "left_ordinal", *group, *shape, "pos1", "pos2"),
        first_r,
        [*group, *shape],
        (F.col("pos1"), F.col("pos2")),
        (F.col("_pos_a"), F.col("_pos_b")),
        p.pair_distance,
        how="left",
        **options,
    )
    extra = [c for c in partitioning if c not in (*group, *shape)]
    matched = (
        pairs_found.groupBy(*group, *shape, *extra, "left_sample", "left_ordinal")
        .agg(F.min("_right").alias("_right"))
        .select(
            "left_sample",
            "left_ordinal",
            F.col("_right.right_sample").alias("right_sample"),
            F.col("_right.right_ordinal").alias("right_ordinal"),
        )
    )
    used = matched.filter(F.col("right_ordinal").isNotNull()).select(
        "right_sample", "right_ordinal"
    ).distinct()
    alone = named_r.join(used, ["right_sample", "right_ordinal"], "left_anti").select(
        F.lit(None).cast(matched.schema["left_sample"].dataType).alias("left_sample"),
        F.lit(None).cast(matched.schema["left_ordinal"].dataType).alias("left_ordinal"),
        "right_sample",
        "right_ordinal",
    )
    return matched.unionByName(alone)


def breakends(svs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per SV: (sample, sv_id, bp, chrom, pos) and the ``extra`` columns; each
    name in ``extra`` stands for a column that ends in 1 or 2."""
    ends = F.array(
        *[
            F.struct(
                F.lit(e).alias("bp"),
                F.col(f"chr{e}").alias("chrom"),
                F.col(f"pos{e}").alias("pos"),
                *[F.col(f"{x}{e}").alias(x) for x in extra],
            )
            for e in (1, 2)
        ]
    )
    return svs.select("sample", "sv_id", F.explode(ends).alias("_end")).select(
        "sample", "sv_id", "_end.*"
    )


def breakend_neighbours(svs: DataFrame, threshold: int = DEFAULTS.threshold) -> DataFrame:
    """For each end: how many ends 1 and ends 2 of other SVs lie within the threshold,
    and the id of the other SV where it is only one such end.

    Ends are counted by position first, so a crowded place costs no more than an empty one.  A
    position is entered in its stretch of the chromosome and, near an edge, in the next one;
    within a stretch, which has few positions, a window adds up those around each."""
    ends = breakends(svs)
    by_place = ends.groupBy("sample", "chrom", "pos").agg(
        F.sum(F.when(F.col("bp") == 1, 1).otherwise(0)).alias("ends1"),
        F.sum(F.when(F.col("bp") == 2, 1).otherwise(0)).alias("ends2"),
        F.sum("sv_id").alias("ids"),
    )
    width, at = STRETCH * threshold, F.col("pos").cast("long")
    first, last = (bin_of(at + step, width) for step in (1 - threshold, threshold - 1))
    near = (
        Window.partitionBy("sample", "chrom", "_stretch")
        .orderBy(at)
        .rangeBetween(1 - threshold, threshold - 1)
    )
    around = (
        by_place.withColumn("_stretch", F.explode(F.sequence(first, last)))
        .withColumns({c: F.sum(c).over(near) for c in ("ends1", "ends2", "ids")})
        .filter(F.col("_stretch") == bin_of(at, width))
        .drop("_stretch")
    )
    # What an SV adds to its own count: the end itself, and its other end if that is near.
    both_near = (F.col("chr1") == F.col("chr2")) & (
        F.abs(F.col("pos1") - F.col("pos2")) < threshold
    )
    rows = breakends(svs.withColumns({"near1": both_near, "near2": both_near}), ("near",))
    joined = lookup_join(rows, around, ["sample", "chrom", "pos"])
    other_end = F.when(F.col("near"), 1).otherwise(0)
    first, second = F.col("bp") == 1, F.col("bp") == 2
    n1 = F.col("ends1") - F.when(first, 1).otherwise(other_end)
    n2 = F.col("ends2") - F.when(second, 1).otherwise(other_end)
    only = F.col("ids") - F.col("sv_id") * (1 + other_end)
    return joined.select(
        "sample",
        "sv_id",
        "bp",
        n1.alias("n_end1"),
        n2.alias("n_end2"),
        F.when(n1 + n2 == 1, only).alias("only_neighbour"),
    )
