"""Queries of the annotate step: directions, positions, classes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.genome import sv_class
from ..operators import annotate, counting, mixed
from ..params import DEFAULTS
from . import views
from .queries_count import OVER, tables, window_steps
from .registry import register

_LEN = "CASE WHEN align_start < 5 THEN len - align_end >= {t} AND ABS(ref_end - {at}) < {t} ELSE align_start >= {t} AND ABS(ref_start - {at}) < {t} END"


def _split(at: str, t: int) -> str:
    return "COALESCE(" + _LEN.format(at=at, t=t) + ", FALSE)"


# Reads near ends (only SVs below the cap), consensus of their split reads.
_NEAR = (
    *window_steps("12"),
    (
        "ok",
        """
SELECT raw.sample, raw.sv_id FROM raw JOIN lim ON raw.sample = lim.sample GROUP BY raw.sample, raw.sv_id, max_dp HAVING MAX(bp) > 0
""",
    ),
    (
        "deep",
        "SELECT DISTINCT dep.sample, dep.sv_id FROM dep JOIN lim ON dep.sample = lim.sample WHERE n > max_dp",
    ),
    (
        "nr",
        "SELECT DISTINCT raw.* FROM raw WHERE NOT EXISTS (SELECT 1 FROM deep d WHERE d.sample = raw.sample AND d.sv_id = raw.sv_id)",
    ),
    (
        "cr",
        f"""
SELECT sample, sv_id, bp, ref_end AS ca_right FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, sv_id, bp ORDER BY n DESC, ref_end) AS k
  FROM (SELECT sample, sv_id, bp, ref_end, COUNT(*) AS n FROM nr WHERE {_split('pos', 12)} GROUP BY sample, sv_id, bp, ref_end) a) b WHERE k = 1
""",
    ),
    (
        "cl",
        f"""
SELECT sample, sv_id, bp, ref_start + 1 AS ca_left FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, sv_id, bp ORDER BY n DESC, ref_start) AS k
  FROM (SELECT sample, sv_id, bp, ref_start, COUNT(*) AS n FROM nr WHERE {_split('pos', 12)} GROUP BY sample, sv_id, bp, ref_start) a) b WHERE k = 1
""",
    ),
)

# Evidence per end.
_EVIDENCE = (
    *_NEAR,
    (
        "nc",
        """
SELECT nr.*, CASE WHEN ABS(ca_right - pos) < 12 AND ca_right <> 0 THEN ca_right END AS cr, CASE WHEN ABS(ca_left - pos) < 12 AND ca_left <> 0 THEN ca_left END AS cl
FROM nr LEFT JOIN cr ON nr.sample = cr.sample AND nr.sv_id = cr.sv_id AND nr.bp = cr.bp LEFT JOIN cl ON nr.sample = cl.sample AND nr.sv_id = cl.sv_id AND nr.bp = cl.bp
""",
    ),
    (
        "sh",
        "SELECT sample, sv_id, bp, MIN(cr) AS cr, MIN(cl) AS cl, "
        + ", ".join(
            f"AVG(CASE WHEN {_split(at, t)} THEN CASE WHEN align_start < {a} THEN 1.0 ELSE 0.0 END END) AS {n}"
            for n, at, t, a in (("s0", "pos", 12, 10), ("s1", "cr", 12, 10), ("s2", "cl", 12, 10), ("td", "pos", 6, 6))
        )
        + " FROM nc GROUP BY sample, sv_id, bp",
    ),
    (
        "ev",
        """
SELECT *, COALESCE(s0 > 0.1 AND s0 < 0.9, FALSE) OR COALESCE(s1 > 0.1 AND s1 < 0.9, FALSE) OR COALESCE(s2 > 0.1 AND s2 < 0.9, FALSE) AS mixed FROM sh
""",
    ),
    (
        "dr",
        "SELECT *, CASE WHEN mixed THEN '?' WHEN td > 0.5 THEN '+' WHEN td IS NOT NULL THEN '-' ELSE '?' END AS dir FROM ev",
    ),
)


def _near(spark, sf_dir):
    svs, reads, limits = tables(spark, sf_dir)
    return annotate.split_reads_at_ends(svs, reads, limits)[0]


@register(
    "consensus_breakpoint",
    over=OVER,
    steps=_NEAR,
    sql="""
SELECT p.sample, p.sv_id, p.bp, CASE WHEN COALESCE(CASE WHEN dir = '+' THEN ca_right ELSE ca_left END, 0) = 0 THEN pos
  ELSE CASE WHEN dir = '+' THEN ca_right ELSE ca_left END END AS new_pos
FROM (SELECT DISTINCT sample, sv_id, bp, pos, dir FROM nr) p LEFT JOIN cr ON p.sample = cr.sample AND p.sv_id = cr.sv_id AND p.bp = cr.bp
  LEFT JOIN cl ON p.sample = cl.sample AND p.sv_id = cl.sv_id AND p.bp = cl.bp
""",
)
def consensus_breakpoint(spark, sf_dir):
    return annotate.recalibrated_positions(_near(spark, sf_dir))


@register(
    "mixed_evidence",
    over=OVER,
    steps=_EVIDENCE,
    sql="SELECT sample, sv_id, bp, mixed, COALESCE(cr, -1) AS ca_right, COALESCE(cl, -1) AS ca_left FROM ev",
)
def mixed_evidence(spark, sf_dir):
    out = annotate.end_evidence(_near(spark, sf_dir))
    return out.select(
        "sample",
        "sv_id",
        "bp",
        "mixed",
        F.coalesce("ca_right", F.lit(-1)).alias("ca_right"),
        F.coalesce("ca_left", F.lit(-1)).alias("ca_left"),
    )


def _tag(e: str) -> str:
    return f"CASE WHEN COALESCE({e}.mixed, FALSE) THEN 'MIXED' WHEN COALESCE({e}.dir, '?') = '?' THEN 'UNKNOWN_DIR' END"


@register(
    "infer_direction",
    over=OVER,
    steps=_EVIDENCE,
    sql=f"""
SELECT s.sample, s.sv_id, COALESCE(a.dir, '?') AS dir1, COALESCE(b.dir, '?') AS dir2,
  CASE WHEN d.sv_id IS NOT NULL THEN 'HIDEP' ELSE CONCAT_WS(';', {_tag('a')}, {_tag('b')}) END AS tags
FROM sv s LEFT JOIN dr a ON a.sample = s.sample AND a.sv_id = s.sv_id AND a.bp = 1 LEFT JOIN dr b ON b.sample = s.sample AND b.sv_id = s.sv_id AND b.bp = 2
  LEFT JOIN deep d ON d.sample = s.sample AND d.sv_id = s.sv_id
""",
)
def infer_direction(spark, sf_dir):
    svs, reads, limits = tables(spark, sf_dir)
    untagged = svs.withColumn("tags", F.array().cast("array<string>"))
    out = annotate.infer_directions(untagged, reads, limits)
    return out.select(
        "sample",
        "sv_id",
        *[F.coalesce(f"dir{e}", F.lit("?")).alias(f"dir{e}") for e in (1, 2)],
        F.concat_ws(";", "tags").alias("tags"),
    )


# ---------------------------------------------------------------- classes and events

_CLASS = """CASE WHEN chr1 <> chr2 THEN 'INTRX' WHEN dir1 = dir2 THEN 'INV' WHEN pos1 < pos2 AND dir1 = '-' THEN 'DUP'
  WHEN pos1 < pos2 AND dir1 = '+' THEN 'DEL' WHEN ABS(pos1 - pos2) < 15 THEN 'INS' ELSE 'Unknown' END"""


@register(
    "classify_sv", over=("sv",), sql=f"SELECT sample, sv_id, {_CLASS} AS classification FROM sv"
)
def classify_sv(spark, sf_dir):
    # Every other SV is given with its ends swapped; the class does not depend on it.
    svs = views.query(
        spark,
        sf_dir,
        """
SELECT sample, sv_id, IF(sv_id % 2 = 1, chr2, chr1) AS chr1, IF(sv_id % 2 = 1, pos2, pos1) AS pos1, IF(sv_id % 2 = 1, dir2, dir1) AS dir1,
  IF(sv_id % 2 = 1, chr1, chr2) AS chr2, IF(sv_id % 2 = 1, pos1, pos2) AS pos2, IF(sv_id % 2 = 1, dir1, dir2) AS dir2 FROM sv""",
        "sv",
    )
    return svs.select("sample", "sv_id", sv_class().alias("classification"))


def _event_steps(table: str, threshold: int = 100) -> tuple[tuple[str, str], ...]:
    """Ordered SVs of one chromosome, pairs, runs, and marked rows."""
    rank = "CASE chr1 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '10' THEN 3 WHEN 'X' THEN 4 ELSE 5 END"
    place = "pos1, dir1, pos2, dir2, sv_id"
    return (
        ("o", f"SELECT *, {rank} AS ck, {_CLASS} AS code FROM {table} WHERE chr1 = chr2"),
        (
            "pv",
            f"""
SELECT *, LAG(pos1) OVER w AS b1, LAG(pos2) OVER w AS b2, LAG(code) OVER w AS bc, ROW_NUMBER() OVER w AS rn,
  ROW_NUMBER() OVER (PARTITION BY sample ORDER BY ck, {place}) AS idx FROM o WINDOW w AS (PARTITION BY sample, ck ORDER BY {place})
""",
        ),
        (
            "lk",
            f"""
SELECT *, COALESCE((ABS(b1 - pos1) < {threshold} OR ABS(b2 - pos2) < {threshold}) AND ((code = 'DUP' AND bc = 'DEL') OR (code = 'DEL' AND bc = 'DUP')), FALSE) AS link FROM pv
""",
        ),
        (
            "rs",
            "SELECT *, MAX(CASE WHEN NOT link THEN rn END) OVER (PARTITION BY sample, ck ORDER BY rn) AS r0 FROM lk",
        ),
        ("mk", "SELECT *, link AND (rn - r0) % 2 = 1 AS intdup FROM rs"),
    )


@register(
    "classify_interspersed_dup",
    over=("sv",),
    steps=_event_steps("sv"),
    sql="SELECT sample, sv_id, CASE WHEN intdup THEN 'INTDUP' ELSE code END AS classification FROM mk",
)
def classify_interspersed_dup(spark, sf_dir):
    out = annotate.classify_pairs(views.view(spark, sf_dir, "sv"))
    return out.select("sample", "sv_id", "classification")


@register(
    "event_id",
    over=("moved",),
    steps=_event_steps("moved"),
    sql="""
SELECT sample, sv_id, CAST(SUM(CASE WHEN intdup THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY idx) AS BIGINT) AS event_id FROM mk
""",
)
def event_id(spark, sf_dir):
    out = annotate.classify_pairs(views.view(spark, sf_dir, "moved"))
    return out.select("sample", "sv_id", "event_id")


@register(
    "detect_translocation",
    over=("moved",),
    steps=(
        *_event_steps("moved"),
        (
            "e",
            """
SELECT *, SUM(CASE WHEN intdup THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY idx) AS ev,
  intdup OR COALESCE(LEAD(intdup) OVER (PARTITION BY sample, ck ORDER BY rn), FALSE) AS joined FROM mk
""",
        ),
        (
            "mv",
            """
SELECT sample, ck, idx, CASE WHEN ABS(pos1 - b1) > 6 THEN LEAST(pos1, b1) ELSE LEAST(pos2, b2) END AS f,
  CASE WHEN ABS(pos1 - b1) > 6 THEN GREATEST(pos1, b1) ELSE GREATEST(pos2, b2) END AS t FROM e WHERE intdup
""",
        ),
        (
            "th",
            """
SELECT mv.sample, mv.idx, MIN(d.idx) AS third FROM mv JOIN e d ON d.sample = mv.sample AND d.ck = mv.ck AND d.dir1 = '+' AND d.dir2 = '-'
  AND ABS(d.pos1 - f) < 6 AND ABS(d.pos2 - t) < 6 AND d.idx <> mv.idx AND d.idx <> mv.idx - 1 GROUP BY mv.sample, mv.idx
""",
        ),
        (
            "mb",
            """
SELECT sample, idx, MAX(id) AS id FROM (SELECT sample, idx, idx - 2 AS id FROM th UNION ALL SELECT sample, idx - 1, idx - 2 FROM th
  UNION ALL SELECT sample, third, idx - 2 FROM th) u GROUP BY sample, idx
""",
        ),
    ),
    sql="""
SELECT e.sample, e.sv_id, CASE WHEN mb.id IS NOT NULL THEN 'TRX' WHEN joined THEN 'INTDUP' ELSE code END AS classification,
  CAST(COALESCE(mb.id, ev) AS BIGINT) AS event_id FROM e LEFT JOIN mb ON e.sample = mb.sample AND e.idx = mb.idx
""",
)
def detect_translocation(spark, sf_dir):
    out = annotate.classify(views.view(spark, sf_dir, "moved"))
    return out.select("sample", "sv_id", "classification", "event_id")


@register(
    "position_ranks",
    over=("sv",),
    steps=(
        (
            "b",
            """
SELECT sample, sv_id, 1 AS bp, chr1 AS chrom, pos1 AS pos FROM sv WHERE chr1 = chr2
UNION ALL SELECT sample, sv_id, 2, chr2, pos2 FROM sv WHERE chr1 = chr2
""",
        ),
        (
            "g",
            "SELECT *, COALESCE(pos - LAG(pos) OVER (PARTITION BY sample, chrom ORDER BY pos, sv_id, bp) > 6, TRUE) AS fresh FROM b",
        ),
        (
            "r",
            "SELECT *, SUM(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY pos, sv_id, bp) AS k FROM g",
        ),
    ),
    sql="""
SELECT sample, sv_id, CAST(MAX(CASE WHEN bp = 1 THEN k END) AS BIGINT) AS rank1, CAST(MAX(CASE WHEN bp = 2 THEN k END) AS BIGINT) AS rank2 FROM r GROUP BY sample, sv_id
""",
)
def position_ranks(spark, sf_dir):
    return annotate.position_ranks(views.view(spark, sf_dir, "sv"))


# ---------------------------------------------------------------- mixed ends

_PAT = (
    ("dm", "SELECT * FROM mixed WHERE tags = 'MIXED;MIXED'"),
    (
        "b",
        "SELECT sample, sv_id, 1 AS bp, chr1 AS c, pos1 AS pos FROM dm UNION ALL SELECT sample, sv_id, 2, chr2, pos2 FROM dm",
    ),
    (
        "ed",
        """
SELECT a.sample, a.sv_id, a.bp, o.sv_id AS oid, o.bp AS obp FROM b a JOIN b o ON a.sample = o.sample AND a.c = o.c AND a.sv_id <> o.sv_id AND ABS(a.pos - o.pos) < 6
""",
    ),
    # All SVs that can be reached over shared ends.
    (
        "rc",
        """
SELECT sample, sv_id, MIN(oid) AS root, COUNT(*) AS size FROM (
  WITH RECURSIVE w(sample, sv_id, oid) AS (SELECT sample, sv_id, sv_id FROM dm UNION SELECT w.sample, w.sv_id, ed.oid FROM w JOIN ed ON ed.sample = w.sample AND ed.sv_id = w.oid)
  SELECT * FROM w) x GROUP BY sample, sv_id
""",
    ),
    (
        "nn",
        """
SELECT d.*, size, root, (SELECT COUNT(*) FROM ed WHERE ed.sample = d.sample AND ed.sv_id = d.sv_id AND ed.bp = 1) AS n1,
  (SELECT COUNT(*) FROM ed WHERE ed.sample = d.sample AND ed.sv_id = d.sv_id AND ed.bp = 2) AS n2 FROM dm d JOIN rc ON rc.sample = d.sample AND rc.sv_id = d.sv_id
""",
    ),
    (
        "cp",
        """
SELECT sample, root, BOOL_AND(n1 = 1 AND n2 = 1) AS tidy, COUNT(*) AS members, MIN(sv_id) AS first_id, MIN(LEAST(pos1, pos2)) AS lo, MAX(GREATEST(pos1, pos2)) AS hi
FROM nn GROUP BY sample, root
""",
    ),
    (
        "pt",
        """
SELECT nn.*, lo, hi, first_id, CASE WHEN n1 = 0 AND n2 = 0 THEN 'alone' WHEN n1 = 0 OR n2 = 0 THEN 'one_sided' WHEN tidy AND size = 2 THEN 'pair'
  WHEN tidy AND size = 3 THEN 'triple' ELSE 'complex' END AS pattern FROM nn JOIN cp ON nn.sample = cp.sample AND nn.root = cp.root
""",
    ),
    (
        "fs",
        "SELECT pt.*, f.pos1 AS f_pos1, f.pos2 AS f_pos2, f.ca_left1 AS f_left1, f.ca_left2 AS f_left2 FROM pt JOIN mixed f ON f.sample = pt.sample AND f.sv_id = pt.first_id",
    ),
)


@register(
    "resolve_mixed_sv",
    over=("mixed",),
    steps=_PAT,
    sql="""
SELECT sample, sv_id, 0 AS part, dir1, pos1, '?' AS dir2, pos2, 'UNKNOWN_DIR' AS tags FROM (SELECT sample, sv_id, COALESCE(dir1, '?') AS dir1, pos1, pos2 FROM mixed WHERE tags = 'UNKNOWN_DIR;MIXED') u
UNION ALL
SELECT sample, sv_id, k, dir1, pos1, CASE WHEN k = 0 THEN '-' ELSE '+' END, COALESCE(CASE WHEN k = 0 THEN ca_left2 ELSE ca_right2 END, pos2), ''
FROM mixed CROSS JOIN (VALUES (0), (1)) v(k) WHERE tags = 'MIXED'
UNION ALL
SELECT sample, sv_id, k, CASE WHEN k = 0 THEN '-' ELSE '+' END, COALESCE(CASE WHEN k = 0 THEN ca_left1 ELSE ca_right1 END, pos1),
  CASE WHEN k = 0 THEN '-' ELSE '+' END, COALESCE(CASE WHEN k = 0 THEN ca_left2 ELSE ca_right2 END, pos2), '' FROM fs CROSS JOIN (VALUES (0), (1)) v(k) WHERE pattern = 'alone'
UNION ALL
SELECT sample, sv_id, 0, CASE WHEN sv_id = first_id THEN '+' ELSE '-' END, CASE WHEN sv_id = first_id THEN COALESCE(ca_right1, pos1) ELSE COALESCE(f_left1, f_pos1) END,
  CASE WHEN sv_id = first_id THEN '+' ELSE '-' END, CASE WHEN sv_id = first_id THEN COALESCE(ca_right2, pos2) ELSE COALESCE(f_left2, f_pos2) END, '' FROM fs WHERE pattern = 'pair'
UNION ALL
SELECT sample, sv_id, 0, CASE WHEN outr THEN '-' ELSE '+' END, CASE WHEN outr THEN COALESCE(ca_left1, pos1) ELSE COALESCE(ca_right1, pos1) END,
  CASE WHEN outr THEN '+' ELSE '-' END, CASE WHEN outr THEN COALESCE(ca_right2, pos2) ELSE COALESCE(ca_left2, pos2) END, ''
FROM (SELECT *, ABS(pos1 - lo) <= 6 AND ABS(pos2 - hi) <= 6 AS outr FROM fs WHERE pattern = 'triple') t
UNION ALL
SELECT sample, sv_id, 0, '?', pos1, '?', pos2, CASE WHEN pattern = 'complex' THEN 'COMPLEX' ELSE 'UNKNOWN_DIR' END FROM fs WHERE pattern IN ('complex', 'one_sided')
""",
)
def resolve_mixed_sv(spark, sf_dir):
    svs = views.view(spark, sf_dir, "mixed").withColumn("tags", F.split("tags", ";"))
    out = mixed.resolve_mixed(svs)
    return out.select(
        "sample",
        "sv_id",
        "part",
        F.coalesce("dir1", F.lit("?")).alias("dir1"),
        "pos1",
        F.coalesce("dir2", F.lit("?")).alias("dir2"),
        "pos2",
        F.concat_ws(";", "tags").alias("tags"),
    )
