"""Queries of the cluster step: model input, cell fractions, assignment, fit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import clustering, copynumber, filters
from ..operators.skew import lookup_join
from ..params import DEFAULTS
from ..session import scratch_path
from ..sources import versioned
from . import pipelines, views
from .queries_filter import CN_STEPS, SEG, params, segments, snvs, sv_cnt
from .registry import register

# ---------------------------------------------------------------- SQL building blocks

# Distinct mutation places with the first segment that holds them.
_SNV = (
    SEG,
    (
        "u",
        "SELECT sample, chrom, pos, ref_n, var_n FROM (SELECT *, COUNT(*) OVER (PARTITION BY sample, chrom, pos) AS n FROM snv) s WHERE n = 1 AND ref_n + var_n > 0",
    ),
    (
        "h",
        """
SELECT u.sample, u.chrom, u.pos, MIN(ordinal) AS ordinal FROM u JOIN seg s ON u.sample = s.sample AND u.chrom = s.chr AND u.pos BETWEEN s.startpos AND s.endpos
GROUP BY u.sample, u.chrom, u.pos
""",
    ),
    (
        "i",
        """
SELECT u.sample, u.chrom || '_' || CAST(u.pos AS VARCHAR) AS mutation_id, purity, CASE WHEN u.chrom IN ('X', 'Y') THEN 1.0 ELSE 2.0 END AS normal_cn,
  CAST(var_n AS DOUBLE) AS var_counts, CAST(ref_n AS DOUBLE) AS ref_counts, CAST(ref_n + var_n AS DOUBLE) AS total_counts, var_n / CAST(ref_n + var_n AS DOUBLE) AS vaf,
  nmaj1 AS major_cn_sub1, nmin1 AS minor_cn_sub1, nmaj1 + nmin1 AS total_cn_sub1, frac1 AS frac_cn_sub1, CASE WHEN frac1 <> 1 THEN 1.0 ELSE 0.0 END AS major_cn_sub2,
  CASE WHEN frac1 <> 1 THEN 1.0 ELSE 0.0 END AS minor_cn_sub2, CASE WHEN frac1 <> 1 THEN 2.0 ELSE 0.0 END AS total_cn_sub2, CASE WHEN frac1 <> 1 THEN 1 - frac1 ELSE 0.0 END AS frac_cn_sub2
FROM u JOIN h ON u.sample = h.sample AND u.chrom = h.chrom AND u.pos = h.pos JOIN seg s ON s.sample = u.sample AND s.chr = u.chrom AND s.ordinal = h.ordinal
  JOIN params p ON p.sample = u.sample
""",
    ),
)


def _sv_states(e: int) -> str:
    return ", ".join(
        (
            f"maj{e} AS major_cn{e}_sub1",
            f"min{e} AS minor_cn{e}_sub1",
            f"maj{e} + min{e} AS total_cn{e}_sub1",
            f"frac{e} AS frac_cn{e}_sub1",
            f"CASE WHEN frac{e} <> 1 THEN 1.0 ELSE 0.0 END AS major_cn{e}_sub2",
            f"CASE WHEN frac{e} <> 1 THEN 1.0 ELSE 0.0 END AS minor_cn{e}_sub2",
            f"CASE WHEN frac{e} <> 1 THEN 2.0 ELSE 0.0 END AS total_cn{e}_sub2",
            f"CASE WHEN frac{e} <> 1 THEN 1 - frac{e} ELSE 0.0 END AS frac_cn{e}_sub2",
        )
    )


_SV = (
    *CN_STEPS,
    (
        "n",
        """
SELECT m.*, purity, CAST(support AS DOUBLE) AS s, CAST(ROUND_EVEN(CASE WHEN classification = 'DUP' THEN norm1 * (1 - purity / ploidy) ELSE CAST(norm1 AS DOUBLE) END, 0) AS BIGINT) AS r1,
  CAST(ROUND_EVEN(CASE WHEN classification = 'DUP' THEN norm2 * (1 - purity / ploidy) ELSE CAST(norm2 AS DOUBLE) END, 0) AS BIGINT) AS r2
FROM m JOIN params p ON m.sample = p.sample WHERE gt1 IS NOT NULL AND gt2 IS NOT NULL
""",
    ),
    (
        "j",
        f"""
SELECT sample, sv_id AS id, chr1 || ':' || CAST(pos1 AS VARCHAR) || ':' || dir1 || '_' || chr2 || ':' || CAST(pos2 AS VARCHAR) || ':' || dir2 AS mutation_id, purity,
  CASE WHEN chr1 IN ('X', 'Y') THEN 1.0 ELSE 2.0 END AS normal_cn, s AS var_counts1, r1 AS ref_counts1, s + r1 AS total_counts1, s / NULLIF(s + r1, 0) AS vaf1, {_sv_states(1)},
  s AS var_counts2, r2 AS ref_counts2, s + r2 AS total_counts2, s / NULLIF(s + r2, 0) AS vaf2, {_sv_states(2)} FROM n
""",
    ),
)


def _locus(e: str, source: str) -> str:
    """Counts, weight, starting multiplicity and copies of one locus."""
    w = (
        f"NULLIF(purity * (total_cn{e}_sub1 * frac_cn{e}_sub1 + total_cn{e}_sub2 * frac_cn{e}_sub2) + (1 - purity) * normal_cn, 0)"
    )
    return f"""
SELECT *, COALESCE(GREATEST(1.0, LEAST(ROUND_EVEN(vaf / weight, 0), top)), 1.0) AS mult FROM (
  SELECT sample, mutation_id AS vid, {e or 1} AS e, var_counts{e} AS var, total_counts{e} AS total, vaf{e} AS vaf, purity / {w} AS weight,
    GREATEST(major_cn{e}_sub1, major_cn{e}_sub2, 1.0) AS top, total_cn{e}_sub1 * frac_cn{e}_sub1 + total_cn{e}_sub2 * frac_cn{e}_sub2 AS copies
  FROM {source}) t{e}"""


# Loci of SNVs (l) or SVs (l), all with reads and a weight.
_SNV_LOCI = (*_SNV, ("l", f"SELECT * FROM ({_locus('', 'i')}) a WHERE weight IS NOT NULL AND total > 0"))
_SV_LOCI = (
    *_SV,
    ("l0", f"{_locus('1', 'j')} UNION ALL {_locus('2', 'j')}"),
    (
        "l",
        """
SELECT * FROM l0 WHERE NOT EXISTS (SELECT 1 FROM l0 b WHERE b.sample = l0.sample AND b.vid = l0.vid AND NOT (b.total > 0 AND b.weight IS NOT NULL))
""",
    ),
)

# A model that does not come from a fit: two clusters for each sample.
_TWO = """
SELECT sample, k AS cluster, CAST(CASE WHEN k = 1 THEN {a} ELSE {b} END AS DOUBLE) AS ccf, CAST(CASE WHEN k = 1 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS weight,
  CASE WHEN k = 1 THEN {n} ELSE 100 END AS n
FROM (SELECT sample, 1 AS k FROM params UNION ALL SELECT sample, 2 FROM params) x
"""


def two(a: float, b: float, n: int = 300) -> str:
    return _TWO.format(a=a, b=b, n=n)


def scored(model: str) -> tuple[tuple[str, str], ...]:
    """Score, probability and label of every variant under the model CTE."""
    return (
        (
            "sc",
            f"""
SELECT l.sample, l.vid, c.cluster, c.ccf, LN(c.weight) + SUM(l.var * LN(q) + (l.total - l.var) * LN(1 - q)) AS score FROM (
  SELECT l.*, c.cluster AS k, GREATEST(0.000001, LEAST(0.999999, c.ccf * l.weight * l.mult)) AS q FROM l JOIN {model} c ON l.sample = c.sample) l
JOIN {model} c ON c.sample = l.sample AND c.cluster = l.k GROUP BY l.sample, l.vid, c.cluster, c.ccf, c.weight
""",
        ),
        ("mx", "SELECT sample, vid, MAX(score) AS top FROM sc GROUP BY sample, vid"),
        (
            "pb",
            """
SELECT sc.sample, sc.vid, cluster, ccf, score, EXP(score - top) / SUM(EXP(score - top)) OVER (PARTITION BY sc.sample, sc.vid) AS prob,
  ROW_NUMBER() OVER (PARTITION BY sc.sample, sc.vid ORDER BY score DESC, cluster) AS rk
FROM sc JOIN mx ON sc.sample = mx.sample AND sc.vid = mx.vid
""",
        ),
        ("lb", "SELECT sample, vid, cluster AS label, ccf AS label_ccf FROM pb WHERE rk = 1"),
    )


MODEL = ("model", two(1.0, 0.3))


# ---------------------------------------------------------------- Spark side


def _snv_input(spark, sf_dir):
    once = filters.filter_snv_basic(snvs(spark, sf_dir), replace(DEFAULTS, min_dep=1))
    matched = copynumber.match_snvs(once, segments(spark, sf_dir))
    known = lookup_join(matched.filter("states IS NOT NULL"), params(spark, sf_dir), ["sample"])
    return clustering.model_input_snv(known)


def _sv_input(spark, sf_dir):
    matched = copynumber.match_sv_states(sv_cnt(spark, sf_dir), segments(spark, sf_dir))
    known = lookup_join(matched, params(spark, sf_dir), ["sample"])
    return clustering.model_input_sv(filters.adjust_counts(known))


def _model(spark, sf_dir, a=1.0, b=0.3, n=300):
    return views.query(spark, sf_dir, two(a, b, n), "params")


def _loci(spark, sf_dir, kind: str):
    if kind == "snv":
        return clustering.snv_loci(_snv_input(spark, sf_dir))
    return clustering.sv_loci(_sv_input(spark, sf_dir))


def _assigned(spark, sf_dir, kind: str):
    return clustering.assign(_loci(spark, sf_dir, kind), _model(spark, sf_dir))


_INPUT = (
    "normal_cn",
    "var_counts",
    "ref_counts",
    "total_counts",
    "vaf",
    "major_cn_sub1",
    "minor_cn_sub1",
    "total_cn_sub1",
    "frac_cn_sub1",
    "major_cn_sub2",
    "minor_cn_sub2",
    "total_cn_sub2",
    "frac_cn_sub2",
)


@register(
    "model_input_snv",
    over=("snv", "cnv", "params"),
    steps=_SNV,
    sql="SELECT sample, mutation_id, ROUND(purity, 6) AS purity, "
    + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _INPUT)
    + " FROM i",
)
def model_input_snv(spark, sf_dir):
    out = _snv_input(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in ("purity", *_INPUT)})


_SV_NUMBERS = ["purity", "normal_cn"] + [
    c
    for e in (1, 2)
    for c in (
        f"var_counts{e}",
        f"total_counts{e}",
        f"vaf{e}",
        *[f"{k}_cn{e}_sub{i}" for i in (1, 2) for k in ("major", "minor", "total", "frac")],
    )
]


@register(
    "model_input_sv",
    over=("sv_cnt", "cnv", "params"),
    steps=_SV,
    sql="SELECT sample, id, mutation_id, ref_counts1, ref_counts2, "
    + ", ".join(f"ROUND(COALESCE({c}, -1), 6) AS {c}" for c in _SV_NUMBERS)
    + " FROM j",
)
def model_input_sv(spark, sf_dir):
    out = _sv_input(spark, sf_dir)
    return out.withColumns({c: F.round(F.coalesce(F.col(c), F.lit(-1.0)), 6) for c in _SV_NUMBERS})


@register(
    "vaf_to_ccf",
    over=("snv", "cnv", "params"),
    steps=_SNV,
    sql="""
SELECT sample, mutation_id, ROUND(vaf * (purity * (total_cn_sub1 * frac_cn_sub1 + total_cn_sub2 * frac_cn_sub2) + (1 - purity) * normal_cn) / purity, 6) AS ccf FROM i
""",
)
def vaf_to_ccf(spark, sf_dir):
    ccf = clustering.vaf_to_ccf(
        F.col("vaf"), F.col("purity"), F.col("normal_cn"), clustering.tumour_copies(), F.lit(1.0)
    )
    return _snv_input(spark, sf_dir).select("sample", "mutation_id", F.round(ccf, 6).alias("ccf"))


_OVER_SNV, _OVER_SV = ("snv", "cnv", "params"), ("sv_cnt", "cnv", "params")


@register(
    "assign_to_clusters",
    over=_OVER_SV,
    steps=(*_SV_LOCI, MODEL, *scored("model")),
    sql="""
SELECT pb.sample, pb.vid AS variant_id, label, cluster, ROUND(prob, 6) AS prob FROM pb JOIN lb ON pb.sample = lb.sample AND pb.vid = lb.vid
""",
)
def assign_to_clusters(spark, sf_dir):
    out = clustering.assignment_long(_assigned(spark, sf_dir, "sv"))
    return out.withColumn("prob", F.round("prob", 6))


@register(
    "assignment_probability",
    over=_OVER_SNV,
    steps=(*_SNV_LOCI, MODEL, *scored("model")),
    sql="""
SELECT sample, vid AS variant_id, ROUND(MAX(CASE WHEN cluster = 1 THEN prob END), 6) AS cluster0, ROUND(MAX(CASE WHEN cluster = 2 THEN prob END), 6) AS cluster1
FROM pb GROUP BY sample, vid
""",
)
def assignment_probability(spark, sf_dir):
    out = clustering.assignment_probability(_assigned(spark, sf_dir, "snv"), 2)
    return out.withColumns({c: F.round(c, 6) for c in ("cluster0", "cluster1")})


_TRIES = (
    "tr",
    """
SELECT l.sample, l.vid, l.e, t.m, copies, ROUND(var * LN(GREATEST(0.000001, LEAST(0.999999, label_ccf * weight * t.m)))
  + (total - var) * LN(1 - GREATEST(0.000001, LEAST(0.999999, label_ccf * weight * t.m))), 9) AS score
FROM l JOIN lb ON l.sample = lb.sample AND l.vid = lb.vid, LATERAL (SELECT UNNEST(RANGE(1, CAST(top AS BIGINT) + 1)) AS m) t
""",
)


@register(
    "multiplicity",
    over=_OVER_SV,
    steps=(
        *_SV_LOCI,
        MODEL,
        *scored("model"),
        _TRIES,
        (
            "bm",
            "SELECT sample, vid, e, copies, m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, vid, e ORDER BY score DESC, m) AS k FROM tr) x WHERE k = 1",
        ),
    ),
    sql="""
SELECT sample, vid AS variant_id, ROUND(MAX(CASE WHEN e = 1 THEN copies END), 6) AS tumour_copynumber1, ROUND(MAX(CASE WHEN e = 2 THEN copies END), 6) AS tumour_copynumber2,
  CAST(MAX(CASE WHEN e = 1 THEN m END) AS BIGINT) AS multiplicity1, CAST(MAX(CASE WHEN e = 2 THEN m END) AS BIGINT) AS multiplicity2 FROM bm GROUP BY sample, vid
""",
)
def multiplicity(spark, sf_dir):
    out = clustering.multiplicity(_assigned(spark, sf_dir, "sv"))
    return out.withColumns(
        {
            **{f"tumour_copynumber{e}": F.round(f"tumour_copynumber{e}", 6) for e in (1, 2)},
            **{f"multiplicity{e}": F.col(f"multiplicity{e}").cast("long") for e in (1, 2)},
        }
    )


@register(
    "subclonal_structure",
    over=_OVER_SNV,
    steps=(
        *_SNV_LOCI,
        MODEL,
        *scored("model"),
        ("sz", "SELECT sample, label AS cluster, label_ccf, COUNT(*) AS n_ssms FROM lb GROUP BY sample, label, label_ccf"),
    ),
    sql="""
SELECT sz.sample, cluster, n_ssms, ROUND(label_ccf * purity, 6) AS proportion, COUNT(*) OVER (PARTITION BY sz.sample) AS n_clusters FROM sz JOIN params p ON sz.sample = p.sample
""",
)
def subclonal_structure(spark, sf_dir):
    out = clustering.subclonal_structure(
        _assigned(spark, sf_dir, "snv"), _model(spark, sf_dir), params(spark, sf_dir)
    )
    return out.withColumn("proportion", F.round("proportion", 6))


@register(
    "cluster_certainty",
    over=_OVER_SV,
    steps=(*_SV_LOCI, MODEL, *scored("model")),
    sql="""
SELECT l.sample, l.vid AS variant_id, MAX(label) AS most_likely_assignment, ROUND(MAX(CASE WHEN e = 1 THEN var / total / (weight * mult) * purity END), 6) AS average_proportion1,
  ROUND(MAX(CASE WHEN e = 2 THEN var / total / (weight * mult) * purity END), 6) AS average_proportion2
FROM l JOIN lb ON l.sample = lb.sample AND l.vid = lb.vid JOIN params p ON p.sample = l.sample GROUP BY l.sample, l.vid
""",
)
def cluster_certainty(spark, sf_dir):
    out = clustering.cluster_certainty(_assigned(spark, sf_dir, "sv"), params(spark, sf_dir))
    return out.withColumns({f"average_proportion{e}": F.round(f"average_proportion{e}", 6) for e in (1, 2)})


@register(
    "post_assign",
    over=_OVER_SV,
    steps=(*_SV_LOCI, ("model", two(0.95, 0.4)), *scored("model")),
    sql="""
SELECT lb.sample, lb.vid AS variant_id, label, ROUND(prob, 6) AS prob FROM lb JOIN pb ON pb.sample = lb.sample AND pb.vid = lb.vid AND pb.rk = 1
""",
)
def post_assign(spark, sf_dir):
    out = clustering.post_assign(_loci(spark, sf_dir, "sv"), _model(spark, sf_dir, 0.95, 0.4))
    best = F.array_max(F.transform("probs", lambda q: q["prob"]))
    return out.select("sample", "variant_id", "label", F.round(best, 6).alias("prob"))


@register(
    "post_assign_joint",
    over=_OVER_SV,
    steps=(
        *_SV_LOCI,
        ("ma", two(1.0, 0.3)),
        ("mb", two(0.94, 0.5, 500)),
        ("un", "SELECT sample, ccf, n FROM ma UNION ALL SELECT sample, ccf, n FROM mb"),
        (
            "gp",
            """
SELECT *, SUM(f) OVER (PARTITION BY sample ORDER BY ccf, n) AS cluster FROM (SELECT *, CASE WHEN COALESCE(ccf - LAG(ccf) OVER (PARTITION BY sample ORDER BY ccf, n), 1) >= 0.1
  THEN 1 ELSE 0 END AS f FROM un) x
""",
        ),
        ("mg", "SELECT sample, cluster, SUM(ccf * n) / SUM(n) AS ccf, SUM(n) AS n FROM gp GROUP BY sample, cluster"),
        (
            "model",
            "SELECT sample, CAST(cluster AS INT) AS cluster, ccf, CAST(n / SUM(n) OVER (PARTITION BY sample) AS DOUBLE) AS weight FROM mg",
        ),
        *scored("model"),
    ),
    sql="""
SELECT lb.sample, lb.vid AS variant_id, label, ROUND(label_ccf, 6) AS label_ccf, ROUND(prob, 6) AS prob FROM lb JOIN pb ON pb.sample = lb.sample AND pb.vid = lb.vid AND pb.rk = 1
""",
)
def post_assign_joint(spark, sf_dir):
    out = clustering.post_assign_joint(
        _loci(spark, sf_dir, "sv"), _model(spark, sf_dir), _model(spark, sf_dir, 0.94, 0.5, 500)
    )
    best = F.array_max(F.transform("probs", lambda q: q["prob"]))
    return out.select(
        "sample", "variant_id", "label", F.round("label_ccf", 6).alias("label_ccf"), F.round(best, 6).alias("prob")
    )


@register(
    "subsample_snvs",
    over=("snv",),
    steps=(
        ("d", "SELECT DISTINCT sample, chrom, pos FROM snv"),
        ("k", "SELECT *, ((17 * 31 + pos * 7919) % 1000003) AS key FROM d"),
    ),
    sql="SELECT sample, chrom, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY key, chrom, pos) AS n FROM k) x WHERE n <= 500",
)
def subsample_snvs(spark, sf_dir):
    places = snvs(spark, sf_dir).select("sample", "chrom", "pos").distinct()
    return clustering.subsample(places, 500, 17)


# Loci of two copies in pure samples, all cells of which have two thirds of the variants, and
# three in ten cells the others.
PLANTED = """
SELECT sample, v AS variant_id, CAST(FLOOR(total * ccf * 0.5 + 0.5) AS DOUBLE) + jitter AS var1, CAST(total AS DOUBLE) AS total1
FROM (SELECT 'S' || CAST(l_suppkey % 4 AS STRING) AS sample, CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS v,
    60 + CAST(l_quantity AS INT) AS total, CASE WHEN l_linenumber % 3 = 0 THEN 0.3 ELSE 1.0 END AS ccf, CAST(l_partkey % 5 AS INT) - 2 AS jitter
  FROM lineitem) x
"""


def planted_loci(spark, sf_dir):
    rows = views.query(spark, sf_dir, PLANTED, "lineitem")
    none = F.lit(None).cast("double")
    return rows.withColumns(
        {
            "weight1": F.lit(0.5),
            "mult1": F.lit(1.0),
            "top1": F.lit(1),
            "copies1": F.lit(2.0),
            "var2": F.lit(0.0),
            "total2": F.lit(0.0),
            **{f"{c}2": none for c in ("weight", "mult", "top", "copies")},
        }
    )


@register(
    "fit_ccf_clusters",
    over=(),
    sql="""
SELECT DISTINCT 'S' || CAST(l_suppkey % 4 AS VARCHAR) AS sample, 2 AS k, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS cluster,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS ccf, TRUE AS converged
FROM lineitem
""",
)
def fit_ccf_clusters(spark, sf_dir):
    """The fit at its defaults recovers what was planted."""
    out = clustering.fit_clusters(planted_loci(spark, sf_dir))
    return out.select("sample", "k", "cluster", F.round("ccf", 1).alias("ccf"), "converged")


@register(
    "post_assign_stored",
    over=_OVER_SNV,
    steps=(
        *_SNV_LOCI,
        ("pl", "SELECT 'S' || CAST(l_suppkey % 4 AS VARCHAR) AS sample, l_linenumber % 3 = 0 AS low FROM lineitem"),
        (
            "model",
            """
SELECT sample, CASE WHEN low THEN 2 ELSE 1 END AS cluster, CAST(CASE WHEN low THEN 0.3 ELSE 1.0 END AS DOUBLE) AS ccf,
  ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY sample) AS DOUBLE), 1) AS weight FROM pl GROUP BY sample, low
""",
        ),
        *scored("model"),
    ),
    sql="""
SELECT lb.sample, lb.vid AS variant_id, label, ROUND(prob, 6) AS prob FROM lb JOIN pb ON pb.sample = lb.sample AND pb.vid = lb.vid AND pb.rk = 1
""",
)
def post_assign_stored(spark, sf_dir):
    """SNVs under the model that a fit to the planted loci stored; to one decimal, as the
    SQL knows what was planted."""
    folder = scratch_path(spark)
    pipelines.fit_and_store(planted_loci(spark, sf_dir), folder)
    model = versioned.read(spark, folder, "model").withColumns({c: F.round(c, 1) for c in ("ccf", "weight")})
    out = clustering.post_assign(_loci(spark, sf_dir, "snv"), model)
    best = F.array_max(F.transform("probs", lambda q: q["prob"]))
    return out.select("sample", "variant_id", "label", F.round(best, 6).alias("prob"))
