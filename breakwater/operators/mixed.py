"""SVs whose ends show evidence for both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .matching import breakend_neighbours

ENDS = ("ca_right1", "ca_left1", "ca_right2", "ca_left2")


def _n_mixed() -> Column:
    return F.size(F.filter("tags", lambda t: t == "MIXED"))


def _record(cond_dir1, cond_dir2, pos1: Column, pos2: Column) -> Column:
    return F.struct(
        cond_dir1.alias("dir1"),
        pos1.alias("pos1"),
        cond_dir2.alias("dir2"),
        pos2.alias("pos2"),
    )


def _at(side: str, end: int, source: str = "") -> Column:
    """Consensus of a side (+ right, - left), or the position where there is none."""
    name = "ca_right" if side == "+" else "ca_left"
    prefix = f"{source}." if source else ""
    return F.coalesce(
        F.nullif(F.col(f"{prefix}{name}{end}"), F.lit(0)), F.col(f"{prefix}pos{end}")
    )


def _both(side1: str, side2: str, source: str = "") -> Column:
    return _record(F.lit(side1), F.lit(side2), _at(side1, 1, source), _at(side2, 2, source))


def doubly_mixed_patterns(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """For SVs mixed at both ends: ``pattern`` and the two partners.

    alone: no end shared.  pair: both ends shared with the same SV and nothing else.
    triple: three SVs that share ends in a ring over three places of a chromosome.
    one_sided: only one end shared.  complex: anything else.

    A pair or a triple is closed: each member shares each end with exactly one end of
    the others.  So partners of partners settle it, without a search over components."""
    near = breakend_neighbours(svs, p.threshold)
    total = F.col("n_end1") + F.col("n_end2")
    wide = near.groupBy("sample", "sv_id").agg(
        *[F.max(F.when(F.col("bp") == e, total)).alias(f"n{e}") for e in (1, 2)],
        *[F.max(F.when(F.col("bp") == e, F.col("only_neighbour"))).alias(f"mate{e}") for e in (1, 2)],
    )
    full = svs.join(wide, ["sample", "sv_id"])
    single = full.filter((F.col("n1") == 1) & (F.col("n2") == 1))
    shape = F.struct(
        F.array_sort(F.array("mate1", "mate2")).alias("mates"),
        "chr1",
        "pos1",
        "chr2",
        "pos2",
        *ENDS,
    )
    for e in (1, 2):
        other = single.select(
            "sample",
            F.col("sv_id").alias(f"mate{e}"),
            F.lit(0).cast("long").alias("_spread"),
            shape.alias(f"partner{e}"),
        )
        # SVs without a mate meet nobody; spread out, they do not all land in one task
        spread = F.when(F.col(f"mate{e}").isNull(), F.col("sv_id")).otherwise(0).cast("long")
        full = full.withColumn("_spread", spread).join(other, ["sample", f"mate{e}", "_spread"], "left").drop("_spread")
    one_each = (F.col("n1") == 1) & (F.col("n2") == 1)
    closed = one_each & F.col("partner1").isNotNull() & F.col("partner2").isNotNull()
    same = F.col("mate1") == F.col("mate2")
    me, a, b = F.col("sv_id"), F.col("mate1"), F.col("mate2")
    ring = (F.col("partner1.mates") == F.array_sort(F.array(me, b))) & (
        F.col("partner2.mates") == F.array_sort(F.array(me, a))
    )
    chroms = [F.col(f"{s}chr{e}") for s in ("", "partner1.", "partner2.") for e in (1, 2)]
    one_chrom = F.size(F.array_distinct(F.array(*chroms))) == 1
    places = F.array_sort(
        F.array(*[F.col(f"{s}pos{e}") for s in ("", "partner1.", "partner2.") for e in (1, 2)])
    )
    steps = F.zip_with(F.slice(places, 1, 5), F.slice(places, 2, 5), lambda x, y: y - x)
    three = F.size(F.filter(steps, lambda d: d > p.threshold)) == 2
    pattern = (
        F.when((F.col("n1") == 0) & (F.col("n2") == 0), "alone")
        .when((F.col("n1") == 0) | (F.col("n2") == 0), "one_sided")
        .when(closed & same, "pair")
        .when(closed & ~same & ring & one_chrom & three, "triple")
        .otherwise("complex")
    )
    low, high = F.get(places, 0), F.get(places, 5)
    return full.withColumn("pattern", F.coalesce(pattern, F.lit("complex"))).withColumns(
        {
            "_reaches_low": F.abs(F.least("pos1", "pos2") - low) <= p.threshold,
            "_reaches_high": F.abs(F.greatest("pos1", "pos2") - high) <= p.threshold,
        }
    )


def resolve_mixed(svs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """SVs with mixed ends replaced by records of clear direction where the evidence
    allows it.  ``svs`` also has tags and the consensus positions of both ends; ``part``
    numbers the records made from one SV.

    One mixed end: a + and a - record.  Two mixed ends: see ``doubly_mixed_patterns``;
    alone gives -,- and +,+; of a pair the first SV is +,+ and the other -,-; in a triple
    the SV over the outer places is -,+ and the others +,-."""
    known = F.array_contains("tags", "UNKNOWN_DIR")
    n_mixed = _n_mixed()
    columns = svs.columns
    single = svs.filter((n_mixed == 1) & ~known)
    double = svs.filter((n_mixed == 2) & ~known)
    unclear = svs.filter((n_mixed > 0) & known)
    rest = svs.filter(F.coalesce(n_mixed, F.lit(0)) <= 0)

    none = F.array().cast("array<string>")
    fixed = [c for c in columns if c not in ("dir1", "pos1", "dir2", "pos2", "tags")]

    def emit(df: DataFrame, records: Column, tags: Column) -> DataFrame:
        return df.select(
            *fixed, tags.alias("tags"), F.posexplode(records).alias("part", "_r")
        ).select(*fixed, "tags", "part", "_r.*")

    end1_open = F.col("dir1").isNull()
    halves = F.array(
        *[
            F.when(
                end1_open, _record(F.lit(s), F.col("dir2"), _at(s, 1), F.col("pos2"))
            ).otherwise(_record(F.col("dir1"), F.lit(s), F.col("pos1"), _at(s, 2)))
            for s in ("-", "+")
        ]
    )
    as_is = F.array(_record(F.col("dir1"), F.col("dir2"), F.col("pos1"), F.col("pos2")))
    shaped = doubly_mixed_patterns(double, p)
    is_first = F.col("sv_id") < F.col("mate1")
    outer = F.col("_reaches_low") & F.col("_reaches_high")
    pattern = F.col("pattern")
    records = (
        F.when(pattern == "alone", F.array(_both("-", "-"), _both("+", "+")))
        .when((pattern == "pair") & is_first, F.array(_both("+", "+")))
        .when(pattern == "pair", F.array(_both("-", "-", "partner1")))
        .when((pattern == "triple") & outer, F.array(_both("-", "+")))
        .when(pattern == "triple", F.array(_both("+", "-")))
        .otherwise(as_is)
    )
    tags = (
        F.when(pattern == "one_sided", F.array(F.lit("UNKNOWN_DIR")))
        .when(pattern == "complex", F.array(F.lit("COMPLEX")))
        .otherwise(none)
    )
    parts = [
        emit(rest, as_is, F.col("tags")),
        emit(unclear, as_is, F.array(F.lit("UNKNOWN_DIR"))),
        emit(single, halves, none),
        emit(shaped, records, tags),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "part")
