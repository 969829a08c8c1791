"""Queries of the count step: reads around breakends and the counts taken from them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import counting, placed_reads
from ..params import DEFAULTS
from ..session import scratch_path
from . import views
from .registry import register

# The cap of a sample sequenced to a fifth of a read, for the query that shows the cap.
CAPPED = replace(DEFAULTS, mean_cov=0.2)


# Cells of the reads by place: the tables lie on the first five million positions.
CELL = 1 << 19


def tables(spark, sf_dir, p=DEFAULTS, by_place=False, stored=True):
    """SVs, stored reads (or, for a single look, as they come), and limits."""
    svs = views.view(spark, sf_dir, "sv")
    reads = views.view(spark, sf_dir, "reads")
    if by_place:
        reads = placed_reads.write(reads, scratch_path(spark), CELL)
    elif stored:
        reads = views.stored(reads, spread=False)
    limits = counting.read_limits(views.view(spark, sf_dir, "params"), p)
    return svs, reads, limits


# ---------------------------------------------------------------- SQL building blocks

def limits_step(mean_cov: float = DEFAULTS.mean_cov) -> tuple[str, str]:
    return (
        "lim",
        f"""
SELECT sample, read_len, insert_mean, 2.0 * read_len AS min_ins, insert_mean + 3 * insert_std AS max_ins,
  CAST({mean_cov} AS DOUBLE) * 2 * (insert_mean + 3 * insert_std) / read_len * 10 AS max_dp FROM params
""",
    )


def window_steps(reach: str, mean_cov: float = DEFAULTS.mean_cov) -> tuple[tuple[str, str], ...]:
    """CTEs: ends with their windows, all read pairs, SV status, distinct reads."""
    return (
        limits_step(mean_cov),
        (
            "win",
            f"""
SELECT s.sample, sv_id, e AS bp, CASE WHEN e = 1 THEN chr1 ELSE chr2 END AS chrom, CASE WHEN e = 1 THEN pos1 ELSE pos2 END AS pos,
  CASE WHEN e = 1 THEN dir1 ELSE dir2 END AS dir, chr1, pos1, dir1, chr2, pos2, dir2, min_ins, max_ins, max_dp,
  GREATEST(CAST(FLOOR((CASE WHEN e = 1 THEN pos1 ELSE pos2 END) - {reach}) AS BIGINT), 0) AS lo,
  CAST(FLOOR((CASE WHEN e = 1 THEN pos1 ELSE pos2 END) + {reach}) AS BIGINT) AS hi
FROM sv s JOIN lim ON s.sample = lim.sample CROSS JOIN (VALUES (1), (2)) v(e)
""",
        ),
        (
            "raw",
            """
SELECT w.sv_id, w.bp, w.pos, w.dir, w.chr1, w.pos1, w.dir1, w.chr2, w.pos2, w.dir2, w.min_ins, w.max_ins, r.*
FROM win w JOIN reads r ON w.sample = r.sample AND w.chrom = r.chrom AND r.ref_start < w.hi AND r.ref_end > w.lo - 1
""",
        ),
        ("dep", "SELECT sample, sv_id, bp, COUNT(*) AS n FROM raw GROUP BY sample, sv_id, bp"),
        (
            "stat",
            """
SELECT s.sample, s.sv_id, CASE WHEN GREATEST(COALESCE(a.n, 0), COALESCE(b.n, 0)) > max_dp THEN 'HIDEP'
  WHEN a.n IS NULL OR b.n IS NULL THEN 'NO_READS' ELSE '' END AS status
FROM sv s JOIN lim ON lim.sample = s.sample LEFT JOIN dep a ON a.sample = s.sample AND a.sv_id = s.sv_id AND a.bp = 1
  LEFT JOIN dep b ON b.sample = s.sample AND b.sv_id = s.sv_id AND b.bp = 2
""",
        ),
        (
            "rd",
            "SELECT DISTINCT raw.* FROM raw JOIN stat ON raw.sample = stat.sample AND raw.sv_id = stat.sv_id WHERE status = ''",
        ),
    )


WINDOWS = window_steps("max_ins")

_NINE = "query_name, chrom, ref_start, ref_end, align_start, align_end, len, ins_len, is_reverse"
_EIGHT = "chrom, ref_start, ref_end, align_start, align_end, len, ins_len, is_reverse"

# Labels of reads, and which of them count.
LABELS = (
    *WINDOWS,
    (
        "nx",
        f"""
SELECT *, LEAD(chrom) OVER w AS m_chrom, LEAD(ref_start) OVER w AS m_start, LEAD(ref_end) OVER w AS m_end, LEAD(align_start) OVER w AS m_as,
  LEAD(align_end) OVER w AS m_ae, LEAD(len) OVER w AS m_len, LEAD(ins_len) OVER w AS m_ins, LEAD(is_reverse) OVER w AS m_rev
FROM rd WINDOW w AS (PARTITION BY sample, sv_id, bp, query_name ORDER BY {_EIGHT})
""",
    ),
    (
        "pr",
        """
SELECT *, align_start <> 0 OR align_end <> len AS clip, m_as <> 0 OR m_ae <> m_len AS m_clip,
  ABS(ins_len) > min_ins AND ABS(ins_len) < max_ins AS ok, ABS(m_ins) > min_ins AND ABS(m_ins) < max_ins AS m_ok,
  align_start < 2 AND len - align_end < 2 AND ABS(ins_len) > min_ins AND ABS(ins_len) < max_ins AND ref_start < pos - 10 AND ref_end > pos + 10 AS across,
  m_as < 2 AND m_len - m_ae < 2 AND ABS(m_ins) > min_ins AND ABS(m_ins) < max_ins AND m_start < pos - 10 AND m_end > pos + 10 AS m_across,
  ABS(ref_end - pos) < 6 AND len - align_end >= 6 AND ABS(ins_len) < max_ins AS sr, ABS(ref_start - pos) < 6 AND align_start >= 6 AND ABS(ins_len) < max_ins AS sl
FROM nx
""",
    ),
    (
        "lb",
        f"""
SELECT *, CASE
  WHEN NOT clip AND ok AND NOT (ref_start < pos + 6 AND ref_end > pos - 6) AND (m_start IS NULL OR
    (chrom = m_chrom AND m_ok AND NOT (m_start < pos + 6 AND m_end > pos - 6) AND NOT (ref_start < pos AND m_end > pos))) THEN 'off_break'
  WHEN across THEN 'split_norm'
  WHEN CASE WHEN align_start < 6 THEN sr ELSE sl END THEN CASE WHEN CASE WHEN dir = '+' THEN sr ELSE sl END THEN 'split' ELSE 'other' END
  WHEN m_start IS NOT NULL AND NOT clip AND NOT m_clip AND is_reverse <> m_rev AND ok AND ref_start < pos AND m_end > pos
    THEN CASE WHEN m_across THEN 'span_other' ELSE 'span_norm' END
  ELSE 'other' END AS label FROM pr
""",
    ),
    (
        "ct",
        f"""
SELECT *, NOT (COALESCE(MAX(CASE WHEN label IN ('split_norm', 'span_norm') THEN 1 ELSE 0 END) OVER (PARTITION BY sample, sv_id, bp, query_name
    ORDER BY {_EIGHT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
  OR (bp = 2 AND MAX(CASE WHEN bp = 1 AND label IN ('split_norm', 'span_norm') THEN 1 ELSE 0 END) OVER (PARTITION BY sample, sv_id, query_name) = 1)) AS counted
FROM lb
""",
    ),
)

ENDS = (
    "ec",
    """
SELECT sample, sv_id, bp, SUM(CASE WHEN counted AND label = 'split_norm' THEN 1 ELSE 0 END) AS split_norm,
  SUM(CASE WHEN counted AND label = 'split_norm' THEN LEAST(ABS(ref_start - pos), ABS(ref_end - pos)) ELSE 0 END) AS norm_olap_bp,
  SUM(CASE WHEN counted AND label = 'span_norm' THEN 1 ELSE 0 END) AS span_norm,
  SUM(CASE WHEN chrom = m_chrom AND NOT is_reverse AND m_rev AND NOT clip AND NOT m_clip AND m_end - ref_start > min_ins AND m_end - ref_start < max_ins THEN 2 ELSE 0 END) AS win_norm,
  SUM(CASE WHEN counted AND label = 'split' THEN 1 ELSE 0 END) AS split,
  SUM(CASE WHEN counted AND label = 'split' THEN CASE WHEN align_start < 6 THEN len - align_end ELSE align_start END ELSE 0 END) AS sc_bases, COUNT(*) AS total_reads
FROM ct GROUP BY sample, sv_id, bp
""",
)


def _lenient(pre: str, at: str) -> str:
    return (
        f"(CASE WHEN {pre}as < 5 THEN {pre}len - {pre}ae >= 6 AND ABS({pre}end - {at}) < 6 ELSE {pre}as >= 6 AND ABS({pre}start - {at}) < 6 END)"
    )


def _below(pre: str) -> str:
    return f"({pre}as < 6 AND {pre}len - {pre}ae < 6)"


def _dist(pre: str, at: str) -> str:
    return f"(CASE WHEN {pre}rev THEN {pre}end - {at} ELSE {at} - {pre}start END)"


# Pairs of left-over reads, in the order of the ends, and whether they span the junction.
PAIRS = (
    (
        "re",
        f"""
SELECT DISTINCT sample, sv_id, chr1, pos1, dir1, chr2, pos2, dir2, max_ins, {_NINE} FROM ct WHERE counted AND label = 'other'
""",
    ),
    (
        "rp",
        f"""
SELECT * FROM (SELECT sample, sv_id, query_name, chr1, pos1, dir1, chr2, pos2, dir2, max_ins, chrom AS x_chrom, ref_start AS x_start, ref_end AS x_end, align_start AS x_as, align_end AS x_ae,
    len AS x_len, is_reverse AS x_rev, LEAD(chrom) OVER w AS y_chrom, LEAD(ref_start) OVER w AS y_start, LEAD(ref_end) OVER w AS y_end, LEAD(align_start) OVER w AS y_as,
    LEAD(align_end) OVER w AS y_ae, LEAD(len) OVER w AS y_len, LEAD(is_reverse) OVER w AS y_rev
  FROM re WINDOW w AS (PARTITION BY sample, sv_id, query_name ORDER BY {_EIGHT})) t WHERE y_start IS NOT NULL
""",
    ),
    (
        "rt",
        """
SELECT * FROM rp WHERE NOT ((chr1 <> chr2 AND x_chrom = chr2) OR (chr1 = chr2 AND pos1 > pos2))
UNION ALL
SELECT sample, sv_id, query_name, chr1, pos1, dir1, chr2, pos2, dir2, max_ins, y_chrom, y_start, y_end, y_as, y_ae, y_len, y_rev,
  x_chrom, x_start, x_end, x_as, x_ae, x_len, x_rev FROM rp WHERE (chr1 <> chr2 AND x_chrom = chr2) OR (chr1 = chr2 AND pos1 > pos2)
""",
    ),
    (
        "sp",
        f"""
SELECT sample, sv_id, query_name, NOT (x_chrom = y_chrom AND CASE WHEN x_start < y_start THEN y_start - x_end ELSE x_start - y_end END < max_ins)
  AND d1 > 0 AND d2 > 0 AND ABS(d1) + ABS(d2) < max_ins
  AND CASE WHEN {_lenient('x_', 'pos1')} THEN {_below('y_')} WHEN {_lenient('y_', 'pos2')} THEN {_below('x_')} ELSE TRUE END
  AND CASE WHEN dir1 = '+' THEN x_start < pos1 AND NOT x_rev ELSE x_end > pos1 AND x_rev END
  AND CASE WHEN dir2 = '+' THEN y_start < pos2 AND NOT y_rev ELSE y_end > pos2 AND y_rev END AS spans
FROM (SELECT *, {_dist('x_', 'pos1')} AS d1, {_dist('y_', 'pos2')} AS d2 FROM rt) t
""",
    ),
)

OVER = ("sv", "reads", "params")


def _labels(spark, sf_dir):
    svs, reads, limits = tables(spark, sf_dir)
    return counting.labelled_reads(svs, reads, limits)[0]


@register(
    "reads_in_breakend_window",
    over=OVER,
    steps=WINDOWS,
    sql=f"SELECT sample, sv_id, bp, {_NINE} FROM rd",
)
def reads_in_breakend_window(spark, sf_dir):
    svs, reads, limits = tables(spark, sf_dir)
    ready = counting.countable(svs, limits)
    windows = counting.breakend_windows(ready, F.col("max_ins"))
    status = counting.sv_status(ready, windows, reads)
    usable = counting.breakend_windows(status.filter("status IS NULL"), F.col("max_ins"))
    return counting.reads_in_windows(usable, reads)


@register(
    "breakend_read_counts",
    over=OVER,
    steps=(*LABELS, ENDS),
    sql="""
SELECT sample, sv_id, bp, CAST(split_norm AS BIGINT) AS split_norm, CAST(norm_olap_bp AS BIGINT) AS norm_olap_bp, CAST(span_norm AS BIGINT) AS span_norm,
  CAST(split AS BIGINT) AS split, CAST(sc_bases AS BIGINT) AS sc_bases, total_reads FROM ec
""",
)
def breakend_read_counts(spark, sf_dir):
    return counting.breakend_counts(_labels(spark, sf_dir)).drop("win_norm")


@register(
    "window_normal_count",
    over=OVER,
    steps=(*LABELS, ENDS),
    sql="SELECT sample, sv_id, bp, CAST(win_norm AS BIGINT) AS win_norm FROM ec",
)
def window_normal_count(spark, sf_dir):
    counts = counting.breakend_counts(_labels(spark, sf_dir))
    return counts.select("sample", "sv_id", "bp", "win_norm")


@register(
    "spanning_pair_counts",
    over=OVER,
    steps=(*LABELS, *PAIRS),
    sql="""
SELECT sample, sv_id, CAST(SUM(CASE WHEN spans THEN 1 ELSE 0 END) AS BIGINT) AS spanning, CAST(SUM(CASE WHEN spans THEN 0 ELSE 2 END) AS BIGINT) AS anomalous
FROM sp GROUP BY sample, sv_id
""",
)
def spanning_pair_counts(spark, sf_dir):
    return counting.spanning_counts(_labels(spark, sf_dir))


def _wide(name: str, e: int) -> str:
    return f"CAST(COALESCE(MAX(CASE WHEN bp = {e} THEN {name} END), 0) AS BIGINT) AS {name}{e}"


@register(
    "sv_counts",
    over=OVER,
    steps=(
        *LABELS,
        ENDS,
        *PAIRS,
        (
            "wd",
            "SELECT sample, sv_id, "
            + ", ".join(_wide(c, e) for e in (1, 2) for c in counting.COUNTS)
            + " FROM ec GROUP BY sample, sv_id",
        ),
        (
            "sc",
            """
SELECT sample, sv_id, SUM(CASE WHEN spans THEN 1 ELSE 0 END) AS spanning, SUM(CASE WHEN spans THEN 0 ELSE 2 END) AS anomalous FROM sp GROUP BY sample, sv_id
""",
        ),
        (
            "al",
            "SELECT t.sample, t.sv_id, status, "
            + ", ".join(f"COALESCE({c}{e}, 0) AS {c}{e}" for e in (1, 2) for c in counting.COUNTS)
            + """, CAST(COALESCE(spanning, 0) AS BIGINT) AS spanning, CAST(COALESCE(anomalous, 0) AS BIGINT) AS anomalous
FROM stat t LEFT JOIN wd ON wd.sample = t.sample AND wd.sv_id = t.sv_id LEFT JOIN sc ON sc.sample = t.sample AND sc.sv_id = t.sv_id
""",
        ),
        (
            "sm",
            "SELECT *, split_norm1 + span_norm1 AS norm1, split_norm2 + span_norm2 AS norm2, split1 + split2 + spanning AS support FROM al",
        ),
    ),
    sql="""
SELECT *, ROUND(CASE WHEN support = 0 THEN 0 ELSE support / CAST(support + norm1 AS DOUBLE) END, 6) AS vaf1,
  ROUND(CASE WHEN support = 0 THEN 0 ELSE support / CAST(support + norm2 AS DOUBLE) END, 6) AS vaf2 FROM sm
""",
)
def sv_counts(spark, sf_dir):
    svs, reads, limits = tables(spark, sf_dir, by_place=True)
    out = counting.sv_counts(svs, reads, limits)
    names = [f"{c}{e}" for e in (1, 2) for c in counting.COUNTS]
    return out.select(
        "sample",
        "sv_id",
        F.coalesce(F.concat_ws(";", "tags"), F.lit("")).alias("status"),
        *names,
        "spanning",
        "anomalous",
        "norm1",
        "norm2",
        "support",
        F.round("vaf1", 6).alias("vaf1"),
        F.round("vaf2", 6).alias("vaf2"),
    )


@register(
    "sv_status_capped",
    over=OVER,
    steps=window_steps("max_ins", CAPPED.mean_cov),
    sql="SELECT sample, sv_id, status FROM stat",
)
def sv_status_capped(spark, sf_dir):
    """Windows above the depth cap, of which the fixture has many at so low a coverage."""
    svs, reads, limits = tables(spark, sf_dir, CAPPED, stored=False)
    ready = counting.countable(svs, limits, CAPPED)
    windows = counting.breakend_windows(ready, F.col("max_ins"))
    out = counting.sv_status(ready, windows, reads)
    return out.select("sample", "sv_id", F.coalesce("status", F.lit("")).alias("status"))


@register(
    "anomalous_recount",
    over=OVER,
    steps=(
        *LABELS,
        *PAIRS,
        (
            "od",
            """
SELECT DISTINCT sample, query_name FROM sp p WHERE NOT spans
  AND NOT EXISTS (SELECT 1 FROM sp q WHERE q.sample = p.sample AND q.query_name = p.query_name AND q.spans)
  AND NOT EXISTS (SELECT 1 FROM ct c WHERE c.sample = p.sample AND c.query_name = p.query_name AND c.counted AND c.label = 'split')
""",
        ),
    ),
    sql="""
SELECT rd.sample, rd.sv_id, COUNT(DISTINCT rd.query_name) AS anomalous FROM rd JOIN od ON rd.sample = od.sample AND rd.query_name = od.query_name
GROUP BY rd.sample, rd.sv_id
""",
)
def anomalous_recount(spark, sf_dir):
    return counting.anomalous_recount(_labels(spark, sf_dir))


# ---------------------------------------------------------------- read parameters


@register(
    "read_stats",
    over=("reads",),
    sql="""
SELECT sample, CAST(MIN(len) AS BIGINT) AS read_len,
  ROUND(AVG(CASE WHEN ins_len > 0 AND ABS(ins_len) < 1000 THEN CAST(ins_len + ref_start % 7 AS DOUBLE) END), 6) AS insert_mean,
  ROUND(STDDEV_POP(CASE WHEN ins_len > 0 AND ABS(ins_len) < 1000 THEN CAST(ins_len + ref_start % 7 AS DOUBLE) END), 6) AS insert_std,
  TRUE AS is_paired, COUNT(*) AS n_mapped FROM reads GROUP BY sample
""",
)
def read_stats(spark, sf_dir):
    drift = F.when(F.col("ins_len") > 0, F.col("ref_start") % 7).otherwise(0)
    reads = views.stored(views.view(spark, sf_dir, "reads"), spread=False).select(
        "sample",
        "len",
        (F.col("ins_len") + drift).alias("ins_len"),
        (F.abs("ins_len") < 1000).alias("is_proper_pair"),
        F.lit(True).alias("is_paired"),
        F.lit(True).alias("is_mapped"),
    )
    out = counting.read_stats(reads)
    return out.withColumns({c: F.round(c, 6) for c in ("insert_mean", "insert_std")})


@register(
    "read_limits",
    over=("params", "reads"),
    steps=(
        (
            "r",
            """
SELECT sample, MAX(len) AS read_len, AVG(CASE WHEN ins_len > 0 THEN CAST(ins_len AS DOUBLE) END) AS m,
  STDDEV_POP(CASE WHEN ins_len > 0 THEN CAST(ins_len AS DOUBLE) END) AS s FROM reads GROUP BY sample
""",
        ),
    ),
    sql="""
SELECT sample, CAST(read_len AS BIGINT) AS read_len, 2.0 * read_len AS min_ins, ROUND(GREATEST(m, 2.0 * read_len) + 3 * s, 3) AS max_ins,
  ROUND(CAST(50 AS DOUBLE) * 2 * (GREATEST(m, 2.0 * read_len) + 3 * s) / read_len * 10, 3) AS max_dp FROM r
""",
)
def read_limits(spark, sf_dir):
    reads = views.view(spark, sf_dir, "reads")
    size = F.when(F.col("ins_len") > 0, F.col("ins_len").cast("double"))
    measured = reads.groupBy("sample").agg(
        F.max("len").alias("read_len"),
        F.avg(size).alias("insert_mean"),
        F.stddev_pop(size).alias("insert_std"),
    )
    out = counting.read_limits(measured, inferred=True)
    return out.select(
        "sample",
        "read_len",
        "min_ins",
        F.round("max_ins", 3).alias("max_ins"),
        F.round("max_dp", 3).alias("max_dp"),
    )
