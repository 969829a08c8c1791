"""Queries of the filter step: row filters, copy-number matching, adjusted counts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import genotype
from ..functions.genome import canonical_breakends, natural_key, normal_copy_number
from ..operators import annotate, audit, copynumber, filters, matching
from ..operators.ordered import OrderedRows
from ..operators.skew import lookup_join
from ..params import DEFAULTS
from . import pipelines, views
from .registry import register

SIZED = replace(DEFAULTS, size_filter=500)


def sv_cnt(spark, sf_dir):
    return views.view(spark, sf_dir, "sv_cnt")


def params(spark, sf_dir):
    return views.view(spark, sf_dir, "params")


def segments(spark, sf_dir):
    """Segments in operator form, by way of the allelic format with a second state."""
    cnv = views.view(spark, sf_dir, "cnv")
    first = genotype.state(F.col("nmaj1"), F.col("nmin1"), F.col("frac1"))
    second = genotype.state(F.lit(1.0), F.lit(1.0), 1 - F.col("frac1"))
    states = F.when(F.col("frac1") != 1, F.array(first, second)).otherwise(F.array(first))
    return cnv.select("sample", "chr", "ordinal", "startpos", "endpos", states.alias("states"))


def snvs(spark, sf_dir):
    return views.view(spark, sf_dir, "snv").withColumnsRenamed({"ref_n": "ref", "var_n": "var"})


# What a look-up of both ends reads; rows are stored for it, so other columns stay out.
PLACED = ("sample", "sv_id", "chr1", "pos1", "dir1", "chr2", "pos2", "dir2", "classification")


# ---------------------------------------------------------------- SQL building blocks

# Segments with their states as text, and the neighbours in the file.
SEG = (
    "seg",
    """
SELECT *, COALESCE(LAG(gt) OVER w, gt) AS prev_gt, COALESCE(LEAD(gt) OVER w, gt) AS next_gt
FROM (SELECT sample, chr, ordinal, startpos, endpos, nmaj1, nmin1, frac1,
    CAST(nmaj1 AS VARCHAR) || ',' || CAST(nmin1 AS VARCHAR) || ',' || CAST(frac1 AS VARCHAR)
      || CASE WHEN frac1 <> 1 THEN '|1.0,1.0,' || CAST(1 - frac1 AS VARCHAR) ELSE '' END AS gt
  FROM cnv) c WINDOW w AS (PARTITION BY sample, chr ORDER BY ordinal)
""",
)

# Both ends of the counted SVs with their look-up positions.
LOOK = (
    "look",
    """
SELECT sample, sv_id, 1 AS e, chr1 AS chr, pos1 AS pos, CASE WHEN classification = 'INTRX'
    THEN CASE WHEN dir1 = '+' THEN pos1 - 100000 ELSE pos1 + 100000 END ELSE pos1 - 100000 END AS look FROM sv_cnt
UNION ALL
SELECT sample, sv_id, 2, chr2, pos2, CASE WHEN classification = 'INTRX'
    THEN CASE WHEN dir2 = '+' THEN pos2 - 100000 ELSE pos2 + 100000 END ELSE pos2 + 100000 END FROM sv_cnt
""",
)

# First segment in the file at each look-up position.
HIT = (
    "hit",
    """
SELECT l.sample, l.sv_id, l.e, MIN(s.ordinal) AS ordinal
FROM look l JOIN seg s ON l.sample = s.sample AND l.chr = s.chr AND l.look BETWEEN s.startpos AND s.endpos
GROUP BY l.sample, l.sv_id, l.e
""",
)

ENDS = (
    "ends",
    """
SELECT l.sample, l.sv_id, l.e, l.chr, l.pos, s.gt, s.prev_gt, s.next_gt, s.nmaj1, s.nmin1, s.frac1
FROM look l LEFT JOIN hit h ON l.sample = h.sample AND l.sv_id = h.sv_id AND l.e = h.e
  LEFT JOIN seg s ON s.sample = l.sample AND s.chr = l.chr AND s.ordinal = h.ordinal
""",
)

# Nearest segment start and nearest segment end of each SV end.
NEAR = (
    "near",
    """
SELECT l.sample, l.sv_id, l.e, MIN(ABS(s.startpos - l.pos)) AS ds, MIN(ABS(s.endpos - l.pos)) AS de,
  ARG_MIN(s.gt, ABS(s.startpos - l.pos) * 1000000 + s.ordinal) AS gs, ARG_MIN(s.prev_gt, ABS(s.startpos - l.pos) * 1000000 + s.ordinal) AS ps,
  ARG_MIN(s.gt, ABS(s.endpos - l.pos) * 1000000 + s.ordinal) AS ge, ARG_MIN(s.next_gt, ABS(s.endpos - l.pos) * 1000000 + s.ordinal) AS ne
FROM look l JOIN seg s ON l.sample = s.sample AND l.chr = s.chr GROUP BY l.sample, l.sv_id, l.e
""",
)

# SVs with the states of both ends (NULL where no segment is hit).
MATCHED = (
    "m",
    """
SELECT v.*, a.gt AS gt1, a.nmaj1 AS maj1, a.nmin1 AS min1, a.frac1 AS frac1, b.gt AS gt2, b.nmaj1 AS maj2, b.nmin1 AS min2, b.frac1 AS frac2
FROM sv_cnt v JOIN ends a ON a.sample = v.sample AND a.sv_id = v.sv_id AND a.e = 1
  JOIN ends b ON b.sample = v.sample AND b.sv_id = v.sv_id AND b.e = 2
""",
)

CN_STEPS = (SEG, LOOK, HIT, ENDS, MATCHED)

INVALID = "(({m} = 0 AND {n} = 0) OR {m} < 0 OR {n} < 0) AND {f} = 1"
BAD1 = "(" + INVALID.format(m="maj1", n="min1", f="frac1") + ")"
BAD2 = "(" + INVALID.format(m="maj2", n="min2", f="frac2") + ")"

BASIC = """(chr1 <> chr2 OR ABS(pos1 - pos2) > 500) AND support + norm1 >= 8 AND support + norm2 >= 8
  AND spanning >= 1 AND split1 + split2 >= 1"""


# ---------------------------------------------------------------- basic filters


@register(
    "filter_sv_basic",
    over=("sv_cnt",),
    sql=f"SELECT sample, sv_id, support FROM sv_cnt WHERE {BASIC}",
)
def filter_sv_basic(spark, sf_dir):
    kept = filters.filter_sv_basic(sv_cnt(spark, sf_dir), SIZED)
    return kept.select("sample", "sv_id", "support")


@register(
    "filter_audit",
    over=("sv_cnt", "params"),
    sql="""
SELECT sample, rule, COUNT(*) AS n FROM (SELECT v.sample, CASE
    WHEN NOT (chr1 <> chr2 OR ABS(pos1 - pos2) > 2 * read_len + insert_mean) THEN 'size'
    WHEN NOT (support + norm1 >= 8 AND support + norm2 >= 8) THEN 'depth'
    WHEN NOT (spanning >= 1 AND split1 + split2 >= 1) THEN 'support'
    WHEN chr1 = 'Y' OR chr2 = 'Y' THEN 'chrom' ELSE 'kept' END AS rule
  FROM sv_cnt v JOIN params p ON v.sample = p.sample) t GROUP BY sample, rule
""",
)
def filter_audit(spark, sf_dir):
    svs = lookup_join(sv_cnt(spark, sf_dir), params(spark, sf_dir), ["sample"])
    rules = replace(DEFAULTS, filter_chroms=True, chroms=tuple(c for c in DEFAULTS.chroms if c != "Y"))
    return filters.filter_audit(svs, rules)


@register(
    "filter_snv_basic",
    over=("snv",),
    sql="""
SELECT sample, chrom, pos, ref_n, var_n FROM (SELECT *, COUNT(*) OVER (PARTITION BY sample, chrom, pos) AS n FROM snv) s
WHERE n = 1 AND ref_n + var_n >= 8 AND chrom <> 'Y'
""",
)
def filter_snv_basic(spark, sf_dir):
    rules = replace(DEFAULTS, filter_chroms=True, chroms=tuple(c for c in DEFAULTS.chroms if c != "Y"))
    kept = filters.filter_snv_basic(snvs(spark, sf_dir), rules)
    return kept.withColumnsRenamed({"ref": "ref_n", "var": "var_n"})


@register(
    "filter_sv_tags",
    over=("sv_cnt",),
    sql="""
SELECT sample, sv_id FROM sv_cnt
WHERE NOT (support % 5 = 0) AND NOT (norm1 % 6 = 1) AND NOT (norm2 % 7 = 2) AND NOT (spanning = 3 AND split1 = 2)
""",
)
def filter_sv_tags(spark, sf_dir):
    tags = F.split(
        F.concat_ws(
            ";",
            F.when(F.col("support") % 5 == 0, "BLACKLIST"),
            F.when(F.col("norm1") % 6 == 1, "HIDEP"),
            F.when(F.col("norm2") % 7 == 2, "UNKNOWN_DIR"),
            F.when((F.col("spanning") == 3) & (F.col("split1") == 2), "MIXED"),
            F.when(F.col("split2") == 1, "NO_READS"),
        ),
        ";",
    )
    tagged = sv_cnt(spark, sf_dir).withColumn("tags", tags)
    return filters.filter_sv_tags(tagged).select("sample", "sv_id")


# ---------------------------------------------------------------- copy-number filters


def _matched(spark, sf_dir, *more):
    svs = sv_cnt(spark, sf_dir).select(*PLACED, *more)
    return copynumber.match_sv_states(svs, segments(spark, sf_dir))


def _shown(df, *more):
    return df.select(
        "sample",
        "sv_id",
        *[F.coalesce(genotype.render(F.col(f"states{e}")), F.lit("")).alias(f"gtype{e}") for e in (1, 2)],
        *more,
    )


@register(
    "filter_cn_neutral",
    over=("sv_cnt", "cnv"),
    steps=CN_STEPS,
    sql="SELECT sample, sv_id, gt1 AS gtype1, gt2 AS gtype2 FROM m WHERE gt1 = '1.0,1.0,1.0' AND gt2 = '1.0,1.0,1.0'",
)
def filter_cn_neutral(spark, sf_dir):
    return _shown(filters.filter_cn_neutral(_matched(spark, sf_dir)))


@register(
    "filter_cn_ceiling",
    over=("sv_cnt", "cnv"),
    steps=CN_STEPS,
    sql="""
SELECT sample, sv_id, COALESCE(gt1, '') AS gtype1, COALESCE(gt2, '') AS gtype2 FROM m
WHERE NOT COALESCE(maj1 > 2 OR min1 > 2, FALSE) AND NOT COALESCE(maj2 > 2 OR min2 > 2, FALSE)
""",
)
def filter_cn_ceiling(spark, sf_dir):
    return _shown(filters.filter_cn_ceiling(_matched(spark, sf_dir), 2))


@register(
    "blank_invalid_cn",
    over=("sv_cnt", "cnv"),
    steps=CN_STEPS,
    sql=f"""
SELECT sample, sv_id, CASE WHEN {BAD1} THEN '' ELSE COALESCE(gt1, '') END AS gtype1,
  CASE WHEN {BAD2} THEN '' ELSE COALESCE(gt2, '') END AS gtype2 FROM m
""",
)
def blank_invalid_cn(spark, sf_dir):
    return _shown(filters.blank_invalid_cn(_matched(spark, sf_dir)))


@register(
    "cn_missing_policy",
    over=("sv_cnt", "cnv", "params"),
    steps=(
        *CN_STEPS,
        (
            "d",
            """
SELECT sample, CAST(CASE WHEN ROUND_EVEN(ploidy, 0) > 1 THEN ROUND_EVEN(ploidy / 2, 0) ELSE 1 END AS DOUBLE) AS dmaj,
  CAST(CASE WHEN ROUND_EVEN(ploidy, 0) > 1 THEN ROUND_EVEN(ploidy / 2, 0) ELSE 0 END AS DOUBLE) AS dmin FROM params
""",
        ),
    ),
    sql="""
SELECT m.sample, sv_id, COALESCE(gt1, CAST(dmaj AS VARCHAR) || ',' || CAST(dmin AS VARCHAR) || ',1.0') AS gtype1,
  COALESCE(gt2, CAST(dmaj AS VARCHAR) || ',' || CAST(dmin AS VARCHAR) || ',1.0') AS gtype2,
  gt1 IS NOT NULL AND gt2 IS NOT NULL AS strict_keeps
FROM m JOIN d ON m.sample = d.sample
""",
)
def cn_missing_policy(spark, sf_dir):
    matched = lookup_join(_matched(spark, sf_dir), params(spark, sf_dir), ["sample"])
    strict = F.col("states1").isNotNull() & F.col("states2").isNotNull()
    filled = filters.fill_missing_cn(matched.withColumn("strict_keeps", strict))
    return _shown(filled, "strict_keeps")


@register(
    "filter_cn_subclonal",
    over=("sv_cnt", "cnv"),
    steps=CN_STEPS,
    sql="SELECT sample, sv_id, gt1 AS gtype1, gt2 AS gtype2 FROM m WHERE frac1 = 1 AND frac2 = 1",
)
def filter_cn_subclonal(spark, sf_dir):
    return _shown(filters.filter_cn_subclonal(_matched(spark, sf_dir)))


# Copies over two of a segment state (NULL states count as two copies).
_RATIO = "COALESCE((({m} + {n}) * {f} + CASE WHEN {f} <> 1 THEN 2 * (1 - {f}) ELSE 0 END) / 2, 1.0)"


@register(
    "filter_depth_outliers",
    over=("sv_cnt", "cnv"),
    steps=(
        *CN_STEPS,
        (
            "w",
            f"""
SELECT sample, sv_id, CASE WHEN r1 = 0 THEN win_norm1 ELSE win_norm1 / r1 END AS w1,
  CASE WHEN r2 = 0 THEN win_norm2 ELSE win_norm2 / r2 END AS w2
FROM (SELECT *, {_RATIO.format(m='maj1', n='min1', f='frac1')} AS r1, {_RATIO.format(m='maj2', n='min2', f='frac2')} AS r2 FROM m) t
""",
        ),
        (
            "q",
            """
SELECT sample, QUANTILE_CONT(w1, 0.25) AS a1, QUANTILE_CONT(w1, 0.75) AS b1, QUANTILE_CONT(w2, 0.25) AS a2, QUANTILE_CONT(w2, 0.75) AS b2
FROM w GROUP BY sample
""",
        ),
    ),
    sql="""
SELECT w.sample, sv_id FROM w JOIN q ON w.sample = q.sample
WHERE w1 > a1 - 1.5 * GREATEST(b1 - a1, 1) AND w1 < b1 + 1.5 * GREATEST(b1 - a1, 1)
  AND w2 > a2 - 1.5 * GREATEST(b2 - a2, 1) AND w2 < b2 + 1.5 * GREATEST(b2 - a2, 1)
""",
)
def filter_depth_outliers(spark, sf_dir):
    matched = _matched(spark, sf_dir, "win_norm1", "win_norm2")
    return filters.filter_sv_outliers(matched).select("sample", "sv_id")


# ---------------------------------------------------------------- order and class basics


_TURNED = """
SELECT sample, sv_id, CASE WHEN sv_id % 2 = 1 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN sv_id % 2 = 1 THEN pos2 ELSE pos1 END AS pos1,
  CASE WHEN sv_id % 2 = 1 THEN dir2 ELSE dir1 END AS dir1, CASE WHEN sv_id % 2 = 1 THEN chr1 ELSE chr2 END AS chr2,
  CASE WHEN sv_id % 2 = 1 THEN pos1 ELSE pos2 END AS pos2, CASE WHEN sv_id % 2 = 1 THEN dir1 ELSE dir2 END AS dir2 FROM sv
"""
_RANK = "CASE {c} WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '10' THEN 3 WHEN 'X' THEN 4 ELSE 5 END"


@register(
    "canonical_breakends",
    over=("sv",),
    steps=(("t", _TURNED),),
    sql=f"""
SELECT sample, sv_id, CASE WHEN k THEN chr2 ELSE chr1 END AS chr1, CASE WHEN k THEN pos2 ELSE pos1 END AS pos1,
  CASE WHEN k THEN dir2 ELSE dir1 END AS dir1, CASE WHEN k THEN chr1 ELSE chr2 END AS chr2,
  CASE WHEN k THEN pos1 ELSE pos2 END AS pos2, CASE WHEN k THEN dir1 ELSE dir2 END AS dir2
FROM (SELECT *, CASE WHEN chr1 = chr2 THEN pos1 > pos2 ELSE {_RANK.format(c='chr1')} > {_RANK.format(c='chr2')} END AS k FROM t) u
""",
)
def q_canonical_breakends(spark, sf_dir):
    return canonical_breakends(views.query(spark, sf_dir, f"SELECT * FROM ({_TURNED}) t", "sv"))


@register(
    "natural_sort",
    over=("sv",),
    sql=f"""
SELECT sample, sv_id, 'chr' || chr1 AS chrom, CAST(DENSE_RANK() OVER (ORDER BY {_RANK.format(c='chr1')}) AS BIGINT) AS place FROM sv
""",
)
def natural_sort(spark, sf_dir):
    svs = views.view(spark, sf_dir, "sv").withColumn("chrom", F.concat(F.lit("chr"), "chr1"))
    names = svs.select("chrom").distinct().withColumns({"key": natural_key("chrom"), "all": F.lit(0)})
    ranked = OrderedRows(names, ["all"], ["key", "chrom"]).scan(sums={"place": F.lit(1)}).rows()
    ranked = ranked.select("chrom", F.col("place").cast("long").alias("place"))
    return lookup_join(svs, ranked, ["chrom"]).select("sample", "sv_id", "chrom", "place")


@register(
    "normal_copy_number",
    over=("snv",),
    sql="""
SELECT sample, chrom, pos, CASE WHEN chrom = 'Y' OR chrom = 'X' THEN 1.0 ELSE 2.0 END AS normal_male,
  CASE WHEN chrom = 'Y' THEN 1.0 ELSE 2.0 END AS normal_female FROM snv
""",
)
def q_normal_copy_number(spark, sf_dir):
    return snvs(spark, sf_dir).select(
        "sample",
        "chrom",
        "pos",
        normal_copy_number(F.col("chrom"), True).alias("normal_male"),
        normal_copy_number(F.concat(F.lit("chr"), "chrom"), False).alias("normal_female"),
    )


@register(
    "dedupe_sv",
    over=("sv",),
    steps=(
        (
            "t",
            "SELECT sample, sv_id, chr1, pos1 - pos1 % 4000 AS pos1, dir1, chr2, pos2 - pos2 % 4000 AS pos2, dir2 FROM sv",
        ),
    ),
    sql="""
SELECT sample, MIN(sv_id) AS sv_id, chr1, pos1, dir1, chr2, pos2, dir2 FROM t
GROUP BY sample, chr1, pos1, dir1, chr2, pos2, dir2
""",
)
def dedupe_sv(spark, sf_dir):
    rounded = views.query(
        spark,
        sf_dir,
        "SELECT sample, sv_id, chr1, pos1 - pos1 % 4000 AS pos1, dir1, chr2, pos2 - pos2 % 4000 AS pos2, dir2 FROM sv",
        "sv",
    )
    return annotate.dedupe(rounded)


# ---------------------------------------------------------------- joins


@register(
    "match_cnv_sv",
    over=("sv_cnt", "cnv"),
    steps=(SEG, LOOK, HIT, ENDS, NEAR),
    sql="""
SELECT sample, sv_id, MAX(CASE WHEN e = 1 THEN g END) AS gtype1, MAX(CASE WHEN e = 1 THEN a END) AS adjacent1, MAX(CASE WHEN e = 1 THEN d END) AS dist1,
  MAX(CASE WHEN e = 2 THEN g END) AS gtype2, MAX(CASE WHEN e = 2 THEN a END) AS adjacent2, MAX(CASE WHEN e = 2 THEN d END) AS dist2
FROM (SELECT x.sample, x.sv_id, x.e, COALESCE(gt, '') AS g, COALESCE(CASE WHEN gt IS NOT NULL THEN CASE WHEN ds > de THEN next_gt ELSE prev_gt END
    ELSE CASE WHEN ds < de THEN gs ELSE ge END END, '') AS a, COALESCE(LEAST(ds, de), -1) AS d
  FROM ends x LEFT JOIN near n ON x.sample = n.sample AND x.sv_id = n.sv_id AND x.e = n.e) t GROUP BY sample, sv_id
""",
)
def match_cnv_sv(spark, sf_dir):
    out = copynumber.match_svs(sv_cnt(spark, sf_dir).select(*PLACED), segments(spark, sf_dir))
    cols = []
    for e in (1, 2):
        cols += [
            F.coalesce(genotype.render(F.col(f"states{e}")), F.lit("")).alias(f"gtype{e}"),
            F.coalesce(genotype.render(F.col(f"adjacent_states{e}")), F.lit("")).alias(f"adjacent{e}"),
            F.coalesce(F.col(f"boundary_dist{e}"), F.lit(-1)).alias(f"dist{e}"),
        ]
    return out.select("sample", "sv_id", *cols)


@register(
    "nearest_cnv",
    over=("sv_cnt", "cnv"),
    steps=(
        SEG,
        LOOK,
        HIT,
        ENDS,
        NEAR,
        (
            "each",
            """
SELECT x.sample, x.sv_id, x.e, COALESCE(gt, CASE WHEN ds < de THEN gs ELSE ge END, '') AS gtype,
  COALESCE(CASE WHEN gt IS NOT NULL THEN CASE WHEN ds > de THEN next_gt ELSE prev_gt END ELSE CASE WHEN ds < de THEN ps ELSE ne END END, '') AS adjacent,
  COALESCE(LEAST(ds, de), -1) AS dist
FROM ends x LEFT JOIN near n ON x.sample = n.sample AND x.sv_id = n.sv_id AND x.e = n.e
""",
        ),
    ),
    sql="""
SELECT a.sample, a.sv_id, a.gtype AS gtype1, a.adjacent AS adjacent1, a.dist AS dist1, b.gtype AS gtype2, b.adjacent AS adjacent2, b.dist AS dist2
FROM each a JOIN each b ON a.sample = b.sample AND a.sv_id = b.sv_id AND a.e = 1 AND b.e = 2
""",
)
def nearest_cnv(spark, sf_dir):
    lenient = replace(DEFAULTS, strict_cnv=False)
    out = copynumber.match_svs(sv_cnt(spark, sf_dir).select(*PLACED), segments(spark, sf_dir), lenient)
    shown = {}
    for e in (1, 2):
        shown[f"gtype{e}"] = F.coalesce(genotype.render(F.col(f"states{e}")), F.lit(""))
        shown[f"adjacent{e}"] = F.coalesce(genotype.render(F.col(f"adjacent_states{e}")), F.lit(""))
        shown[f"dist{e}"] = F.coalesce(F.col(f"boundary_dist{e}"), F.lit(-1))
    return out.select("sample", "sv_id", *[c.alias(n) for n, c in shown.items()])


@register(
    "adjacent_cnv",
    over=("cnv",),
    steps=(SEG,),
    sql="SELECT sample, chr, ordinal, gt AS gtype, prev_gt AS prev_gtype, next_gt AS next_gtype FROM seg",
)
def adjacent_cnv(spark, sf_dir):
    out = copynumber.with_neighbours(segments(spark, sf_dir))
    return out.select(
        "sample",
        "chr",
        "ordinal",
        genotype.render(F.col("states")).alias("gtype"),
        genotype.render(F.col("prev_states")).alias("prev_gtype"),
        genotype.render(F.col("next_states")).alias("next_gtype"),
    )


@register(
    "match_cnv_snv",
    over=("snv", "cnv"),
    steps=(
        SEG,
        ("u", "SELECT DISTINCT sample, chrom, pos FROM snv"),
        (
            "h",
            """
SELECT u.sample, u.chrom, u.pos, ARG_MIN(gt, ordinal) AS gt FROM u JOIN seg s
  ON u.sample = s.sample AND u.chrom = s.chr AND u.pos BETWEEN s.startpos AND s.endpos GROUP BY u.sample, u.chrom, u.pos
""",
        ),
    ),
    sql="""
SELECT u.sample, u.chrom, u.pos, COALESCE(h.gt, '') AS gtype FROM u
LEFT JOIN h ON u.sample = h.sample AND u.chrom = h.chrom AND u.pos = h.pos
""",
)
def match_cnv_snv(spark, sf_dir):
    places = snvs(spark, sf_dir).select("sample", "chrom", "pos").distinct()
    out = copynumber.match_snvs(places, segments(spark, sf_dir))
    return out.select(
        "sample", "chrom", "pos", F.coalesce(genotype.render(F.col("states")), F.lit("")).alias("gtype")
    )


@register(
    "blacklist_sv",
    over=("sv", "blacklist"),
    sql="""
SELECT sample, sv_id FROM sv WHERE NOT EXISTS (SELECT 1 FROM blacklist b
  WHERE (b.chrom = sv.chr1 AND sv.pos1 BETWEEN b.start_pos AND b.end_pos) OR (b.chrom = sv.chr2 AND sv.pos2 BETWEEN b.start_pos AND b.end_pos))
""",
)
def blacklist_sv(spark, sf_dir):
    kept = filters.drop_blacklisted_svs(
        views.view(spark, sf_dir, "sv"), views.view(spark, sf_dir, "blacklist")
    )
    return kept.select("sample", "sv_id")


@register(
    "blacklist_snv",
    over=("snv", "blacklist"),
    sql="""
SELECT sample, chrom, pos, ref_n, var_n FROM snv WHERE NOT EXISTS (SELECT 1 FROM blacklist b
  WHERE b.chrom = snv.chrom AND snv.pos BETWEEN b.start_pos AND b.end_pos)
""",
)
def blacklist_snv(spark, sf_dir):
    return filters.drop_blacklisted_snvs(
        views.view(spark, sf_dir, "snv"), views.view(spark, sf_dir, "blacklist")
    )


@register(
    "anti_germline",
    over=("sv", "germline"),
    sql="""
SELECT sample, sv_id FROM sv WHERE NOT EXISTS (SELECT 1 FROM germline g WHERE g.sample = sv.sample AND g.support > 0
  AND g.chr1 = sv.chr1 AND g.chr2 = sv.chr2 AND ABS(g.pos1 - sv.pos1) < 10 AND ABS(g.pos2 - sv.pos2) < 10)
""",
)
def anti_germline(spark, sf_dir):
    kept = matching.drop_germline(
        views.view(spark, sf_dir, "sv"), views.view(spark, sf_dir, "germline")
    )
    return kept.select("sample", "sv_id")


@register(
    "match_sv_pairs",
    over=("sv", "sv2"),
    steps=(
        ("r", "SELECT 'S' || substr(sample, 2, 1) AS g, * FROM sv2"),
        (
            "f",
            """
SELECT l.sample, l.sv_id, MIN(r.sv2_id) AS sv2_id FROM sv l JOIN r ON l.sample = r.g
  AND ((l.chr1 = r.chr1 AND l.chr2 = r.chr2 AND l.dir1 = r.dir1 AND l.dir2 = r.dir2 AND ABS(l.pos1 - r.pos1) < 15 AND ABS(l.pos2 - r.pos2) < 15)
    OR (l.chr2 = r.chr1 AND l.chr1 = r.chr2 AND l.dir2 = r.dir1 AND l.dir1 = r.dir2 AND ABS(l.pos2 - r.pos1) < 15 AND ABS(l.pos1 - r.pos2) < 15))
GROUP BY l.sample, l.sv_id
""",
        ),
    ),
    sql="""
SELECT l.sample AS left_sample, l.sv_id AS left_id, COALESCE(f.sv2_id, -1) AS right_id FROM sv l LEFT JOIN f ON l.sample = f.sample AND l.sv_id = f.sv_id
UNION ALL
SELECT '', -1, sv2_id FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.sample = r.g AND f.sv2_id = r.sv2_id)
""",
)
def match_sv_pairs(spark, sf_dir):
    left = views.view(spark, sf_dir, "sv").withColumnRenamed("sv_id", "ordinal")
    right = views.view(spark, sf_dir, "sv2").withColumnRenamed("sv2_id", "ordinal")
    pairs = (
        right.select(F.col("sample").alias("right_sample"))
        .distinct()
        .withColumn("left_sample", F.concat(F.lit("S"), F.substring("right_sample", 2, 1)))
    )
    out = matching.match_sv_sets(left, right, pairs)
    return out.select(
        F.coalesce("left_sample", F.lit("")).alias("left_sample"),
        F.coalesce("left_ordinal", F.lit(-1)).alias("left_id"),
        F.coalesce("right_ordinal", F.lit(-1)).alias("right_id"),
    )


@register(
    "breakend_neighbours",
    over=("mixed",),
    steps=(
        (
            "b",
            """
SELECT sample, sv_id, 1 AS bp, chr1 AS chrom, pos1 AS pos FROM mixed UNION ALL SELECT sample, sv_id, 2, chr2, pos2 FROM mixed
""",
        ),
        (
            "n",
            """
SELECT a.sample, a.sv_id, a.bp, SUM(CASE WHEN o.bp = 1 THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN o.bp = 2 THEN 1 ELSE 0 END) AS n2, MIN(o.sv_id) AS one
FROM b a JOIN b o ON a.sample = o.sample AND a.chrom = o.chrom AND a.sv_id <> o.sv_id AND o.pos BETWEEN a.pos - 5 AND a.pos + 5
GROUP BY a.sample, a.sv_id, a.bp
""",
        ),
    ),
    sql="""
SELECT b.sample, b.sv_id, b.bp, CAST(COALESCE(n1, 0) AS BIGINT) AS n_end1, CAST(COALESCE(n2, 0) AS BIGINT) AS n_end2,
  CASE WHEN n1 + n2 = 1 THEN one ELSE -1 END AS only_neighbour
FROM b LEFT JOIN n ON b.sample = n.sample AND b.sv_id = n.sv_id AND b.bp = n.bp
""",
)
def breakend_neighbours(spark, sf_dir):
    out = matching.breakend_neighbours(views.view(spark, sf_dir, "mixed"))
    return out.withColumn("only_neighbour", F.coalesce("only_neighbour", F.lit(-1)))


# ---------------------------------------------------------------- adjusted counts

_ADJUSTED = """
SELECT *, CASE WHEN gain THEN norm1 * share ELSE CAST(norm1 AS DOUBLE) END AS an1, CASE WHEN gain THEN norm2 * share ELSE CAST(norm2 AS DOUBLE) END AS an2,
  ROUND_EVEN(CAST(support AS DOUBLE) * (1 + CAST(0.12 AS DOUBLE) * purity), 0) AS asup
FROM (SELECT v.*, purity, ploidy, classification IN ('DUP', 'INTDUP') AS gain, 1 - purity / ploidy AS share FROM sv_cnt v JOIN params p ON v.sample = p.sample) t
"""

ADJUST = replace(DEFAULTS, support_adjust_factor=0.12)


def _r(expr: str, name: str) -> str:
    return f"ROUND(COALESCE({expr}, -1), 6) AS {name}"


@register(
    "adjust_counts",
    over=("sv_cnt", "params"),
    steps=(("a", _ADJUSTED),),
    sql=f"""
SELECT sample, sv_id, ROUND(an1, 6) AS adjusted_norm1, ROUND(an2, 6) AS adjusted_norm2, CAST(asup AS BIGINT) AS adjusted_support,
  CAST(ROUND_EVEN(asup + an1, 0) AS BIGINT) AS adjusted_depth1, CAST(ROUND_EVEN(asup + an2, 0) AS BIGINT) AS adjusted_depth2,
  {_r("support / NULLIF(support + (norm1 + norm2) / 2.0, 0)", "raw_mean_vaf")}, {_r("asup / NULLIF(asup + an1, 0)", "adjusted_vaf1")},
  {_r("asup / NULLIF(asup + an2, 0)", "adjusted_vaf2")}, {_r("support / NULLIF((an1 + an2) / 2 + asup, 0)", "adjusted_mean_vaf")}
FROM a
""",
)
def adjust_counts(spark, sf_dir):
    svs = lookup_join(sv_cnt(spark, sf_dir), params(spark, sf_dir), ["sample"])
    out = filters.adjust_counts(svs, ADJUST)
    shares = ("raw_mean_vaf", "adjusted_vaf1", "adjusted_vaf2", "adjusted_mean_vaf")
    return out.select(
        "sample",
        "sv_id",
        F.round("adjusted_norm1", 6).alias("adjusted_norm1"),
        F.round("adjusted_norm2", 6).alias("adjusted_norm2"),
        "adjusted_support",
        "adjusted_depth1",
        "adjusted_depth2",
        *[F.round(F.coalesce(F.col(c), F.lit(-1.0)), 6).alias(c) for c in shares],
    )


# ---------------------------------------------------------------- the whole step

_FILTERED = f"""
SELECT m.sample, sv_id, classification, gt1, gt2, norm1, norm2, support, purity, ploidy
FROM m JOIN params p ON m.sample = p.sample
WHERE {BASIC} AND gt1 IS NOT NULL AND gt2 IS NOT NULL AND NOT {BAD1} AND NOT {BAD2}
  AND maj1 <= 10 AND min1 <= 10 AND maj2 <= 10 AND min2 <= 10
  AND NOT EXISTS (SELECT 1 FROM blacklist b WHERE (b.chrom = m.chr1 AND m.pos1 BETWEEN b.start_pos AND b.end_pos)
    OR (b.chrom = m.chr2 AND m.pos2 BETWEEN b.start_pos AND b.end_pos))
  AND NOT EXISTS (SELECT 1 FROM germline g WHERE g.sample = m.sample AND g.support > 0
    AND g.chr1 = m.chr1 AND g.chr2 = m.chr2 AND ABS(g.pos1 - m.pos1) < 10 AND ABS(g.pos2 - m.pos2) < 10)
"""


def _filtered_svs(spark, sf_dir):
    return pipelines.filter_svs(
        sv_cnt(spark, sf_dir),
        params(spark, sf_dir),
        segments=segments(spark, sf_dir),
        blacklist=views.view(spark, sf_dir, "blacklist"),
        germline=views.view(spark, sf_dir, "germline"),
        p=SIZED,
        adjacent=False,
    )


@register(
    "filtered_svs",
    over=("sv_cnt", "cnv", "params", "blacklist", "germline"),
    steps=(*CN_STEPS, ("x", _FILTERED)),
    sql="SELECT sample, sv_id, gt1 AS gtype1, gt2 AS gtype2 FROM x",
)
def filtered_svs(spark, sf_dir):
    return _shown(_filtered_svs(spark, sf_dir))


@register(
    "filtered_snvs",
    over=("snv", "cnv", "blacklist"),
    steps=(
        SEG,
        (
            "b",
            """
SELECT sample, chrom, pos, ref_n, var_n FROM (SELECT *, COUNT(*) OVER (PARTITION BY sample, chrom, pos) AS n FROM snv) s
WHERE n = 1 AND ref_n + var_n >= 8 AND NOT EXISTS (SELECT 1 FROM blacklist k WHERE k.chrom = s.chrom AND s.pos BETWEEN k.start_pos AND k.end_pos)
""",
        ),
        (
            "h",
            """
SELECT b.sample, b.chrom, b.pos, MIN(ordinal) AS ordinal FROM b JOIN seg s
  ON b.sample = s.sample AND b.chrom = s.chr AND b.pos BETWEEN s.startpos AND s.endpos GROUP BY b.sample, b.chrom, b.pos
""",
        ),
        (
            "v",
            """
SELECT b.*, gt, nmaj1, nmin1, frac1, (ref_n + var_n) / (((nmaj1 + nmin1) * frac1 + CASE WHEN frac1 <> 1 THEN 2 * (1 - frac1) ELSE 0 END) / 2) AS d
FROM b JOIN h ON b.sample = h.sample AND b.chrom = h.chrom AND b.pos = h.pos
  JOIN seg s ON s.sample = b.sample AND s.chr = b.chrom AND s.ordinal = h.ordinal WHERE NOT (nmaj1 = 0 AND nmin1 = 0 AND frac1 = 1)
""",
        ),
        (
            "q",
            "SELECT sample, QUANTILE_CONT(d, 0.25) AS a, QUANTILE_CONT(d, 0.75) AS c FROM v GROUP BY sample",
        ),
    ),
    sql="""
SELECT v.sample, chrom, pos, gt AS gtype, ref_n, var_n FROM v JOIN q ON v.sample = q.sample
WHERE d > a - 1.5 * GREATEST(c - a, 1) AND d < c + 1.5 * GREATEST(c - a, 1) AND frac1 = 1 AND nmaj1 <= 10 AND nmin1 <= 10
""",
)
def filtered_snvs(spark, sf_dir):
    rules = replace(DEFAULTS, filter_outliers=True, filter_subclonal_cnvs=True)
    out = pipelines.filter_snvs(
        snvs(spark, sf_dir),
        params(spark, sf_dir),
        segments=segments(spark, sf_dir),
        blacklist=views.view(spark, sf_dir, "blacklist"),
        p=rules,
    )
    return out.select(
        "sample",
        "chrom",
        "pos",
        genotype.render(F.col("states")).alias("gtype"),
        F.col("ref").alias("ref_n"),
        F.col("var").alias("var_n"),
    )


@register(
    "class_summary",
    over=("sv_cnt", "cnv", "params", "blacklist", "germline"),
    steps=(
        *CN_STEPS,
        ("x", _FILTERED),
        (
            "y",
            """
SELECT *, CASE WHEN classification IN ('DUP', 'INTDUP') THEN 1 - purity / ploidy ELSE 1 END AS share FROM x
""",
        ),
    ),
    sql="""
SELECT sample, classification, COUNT(*) AS n, CAST(SUM(support) AS BIGINT) AS support,
  ROUND(AVG(support / ((norm1 * share + norm2 * share) / 2 + support)), 6) AS mean_vaf
FROM y GROUP BY sample, classification
""",
)
def class_summary(spark, sf_dir):
    return (
        _filtered_svs(spark, sf_dir)
        .groupBy("sample", "classification")
        .agg(
            F.count("*").alias("n"),
            F.sum("support").alias("support"),
            F.round(F.avg("adjusted_mean_vaf"), 6).alias("mean_vaf"),
        )
    )


# ---------------------------------------------------------------- audit

AUDITED = replace(
    SIZED, filter_outliers=True, filter_subclonal_cnvs=True, filter_chroms=True, chroms=("1", "2", "10", "X")
)


@register(
    "audit_sv_filters",
    over=("sv_cnt", "cnv", "params", "blacklist", "germline"),
    steps=(
        *CN_STEPS,
        (
            "r",
            f"""
SELECT *, CASE WHEN NOT (chr1 <> chr2 OR ABS(pos1 - pos2) > 500) THEN 'size'
  WHEN NOT (support + norm1 >= 8 AND support + norm2 >= 8) THEN 'depth' WHEN NOT (spanning >= 1 AND split1 + split2 >= 1) THEN 'support'
  WHEN chr1 NOT IN ('1', '2', '10', 'X') OR chr2 NOT IN ('1', '2', '10', 'X') THEN 'chrom'
  WHEN EXISTS (SELECT 1 FROM blacklist k WHERE (k.chrom = m.chr1 AND m.pos1 BETWEEN k.start_pos AND k.end_pos)
    OR (k.chrom = m.chr2 AND m.pos2 BETWEEN k.start_pos AND k.end_pos)) THEN 'blacklist'
  WHEN EXISTS (SELECT 1 FROM germline g WHERE g.sample = m.sample AND g.support > 0 AND g.chr1 = m.chr1 AND g.chr2 = m.chr2
    AND ABS(g.pos1 - m.pos1) < 10 AND ABS(g.pos2 - m.pos2) < 10) THEN 'germline'
  WHEN gt1 IS NULL OR gt2 IS NULL OR {BAD1} OR {BAD2} THEN 'no_state' WHEN frac1 <> 1 OR frac2 <> 1 THEN 'subclonal' END AS failed
FROM m
""",
        ),
        (
            "w",
            f"""
SELECT sample, sv_id, maj1, min1, maj2, min2, CASE WHEN r1 = 0 THEN win_norm1 ELSE win_norm1 / r1 END AS w1,
  CASE WHEN r2 = 0 THEN win_norm2 ELSE win_norm2 / r2 END AS w2
FROM (SELECT *, {_RATIO.format(m='maj1', n='min1', f='frac1')} AS r1, {_RATIO.format(m='maj2', n='min2', f='frac2')} AS r2 FROM r
  WHERE failed IS NULL) t
""",
        ),
        (
            "q",
            """
SELECT sample, QUANTILE_CONT(w1, 0.25) AS a1, QUANTILE_CONT(w1, 0.75) AS b1, QUANTILE_CONT(w2, 0.25) AS a2, QUANTILE_CONT(w2, 0.75) AS b2
FROM w GROUP BY sample
""",
        ),
        (
            "o",
            """
SELECT w.sample, CASE WHEN NOT (w1 > a1 - 1.5 * GREATEST(b1 - a1, 1) AND w1 < b1 + 1.5 * GREATEST(b1 - a1, 1)
  AND w2 > a2 - 1.5 * GREATEST(b2 - a2, 1) AND w2 < b2 + 1.5 * GREATEST(b2 - a2, 1)) THEN 'outlier'
  WHEN GREATEST(maj1, min1, maj2, min2) > 10 THEN 'ceiling' ELSE 'kept' END AS rule FROM w JOIN q ON w.sample = q.sample
""",
        ),
    ),
    sql="""
SELECT sample, rule, COUNT(*) AS n FROM (SELECT sample, failed AS rule FROM r WHERE failed IS NOT NULL UNION ALL SELECT sample, rule FROM o) u
GROUP BY sample, rule
""",
)
def audit_sv_filters(spark, sf_dir):
    svs = pipelines.with_params(sv_cnt(spark, sf_dir), params(spark, sf_dir))
    labelled = audit.label_svs(
        svs, segments(spark, sf_dir), views.view(spark, sf_dir, "blacklist"), views.view(spark, sf_dir, "germline"), AUDITED
    )
    return audit.counts(labelled)


@register(
    "audit_snv_filters",
    over=("snv", "cnv", "blacklist"),
    steps=(
        SEG,
        ("b", "SELECT sample, chrom, pos, COUNT(*) AS n, MIN(ref_n) AS ref_n, MIN(var_n) AS var_n FROM snv GROUP BY sample, chrom, pos"),
        (
            "h",
            """
SELECT b.sample, b.chrom, b.pos, MIN(ordinal) AS ordinal FROM b JOIN seg s
  ON b.sample = s.sample AND b.chrom = s.chr AND b.pos BETWEEN s.startpos AND s.endpos GROUP BY b.sample, b.chrom, b.pos
""",
        ),
        (
            "r",
            """
SELECT b.*, s.nmaj1, s.nmin1, s.frac1, (ref_n + var_n) / (((nmaj1 + nmin1) * frac1 + CASE WHEN frac1 <> 1 THEN 2 * (1 - frac1) ELSE 0 END) / 2) AS d,
  CASE WHEN n > 1 THEN 'repeated' WHEN ref_n + var_n < 8 THEN 'depth' WHEN b.chrom NOT IN ('1', '2', '10', 'X') THEN 'chrom'
    WHEN EXISTS (SELECT 1 FROM blacklist k WHERE k.chrom = b.chrom AND b.pos BETWEEN k.start_pos AND k.end_pos) THEN 'blacklist'
    WHEN s.gt IS NULL OR (nmaj1 = 0 AND nmin1 = 0 AND frac1 = 1) THEN 'no_state' END AS failed
FROM b LEFT JOIN h ON b.sample = h.sample AND b.chrom = h.chrom AND b.pos = h.pos
  LEFT JOIN seg s ON s.sample = b.sample AND s.chr = b.chrom AND s.ordinal = h.ordinal
""",
        ),
        ("q", "SELECT sample, QUANTILE_CONT(d, 0.25) AS a, QUANTILE_CONT(d, 0.75) AS c FROM r WHERE failed IS NULL GROUP BY sample"),
        (
            "o",
            """
SELECT r.sample, n, CASE WHEN NOT (d > a - 1.5 * GREATEST(c - a, 1) AND d < c + 1.5 * GREATEST(c - a, 1)) THEN 'outlier'
  WHEN frac1 <> 1 THEN 'subclonal' WHEN GREATEST(nmaj1, nmin1) > 10 THEN 'ceiling' ELSE 'kept' END AS rule
FROM r JOIN q ON r.sample = q.sample WHERE failed IS NULL
""",
        ),
    ),
    sql="""
SELECT sample, rule, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT sample, n, failed AS rule FROM r WHERE failed IS NOT NULL
  UNION ALL SELECT sample, n, rule FROM o) u GROUP BY sample, rule
""",
)
def audit_snv_filters(spark, sf_dir):
    labelled = audit.label_snvs(
        pipelines.with_params(snvs(spark, sf_dir), params(spark, sf_dir)), segments(spark, sf_dir), views.view(spark, sf_dir, "blacklist"), AUDITED
    )
    return audit.counts(labelled)
