"""Queries over the input formats.

The lines are put together from the driver tables and parsed; the checking SQL goes from
the tables to the expected rows without any text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype
from ..operators import placed_reads
from ..session import scratch_path
from ..sources import alignments, cnv, sample_tables, snv, sv
from ..sources.text import lines_to_table
from . import views
from .registry import register

# ---------------------------------------------------------------- structural variants


@register(
    "scan_sv_simple",
    over=("sv",),
    sql="""
SELECT sample, sv_id AS original_id, CASE WHEN turn THEN chr2 ELSE chr1 END AS chr1,
  CASE WHEN turn THEN pos2 ELSE pos1 END AS pos1, CASE WHEN turn THEN dir2 ELSE dir1 END AS dir1,
  CASE WHEN turn THEN chr1 ELSE chr2 END AS chr2, CASE WHEN turn THEN pos1 ELSE pos2 END AS pos2,
  CASE WHEN turn THEN dir1 ELSE dir2 END AS dir2, 'C' || CAST(sv_id % 5 AS STRING) AS classification,
  pos1 AS original_pos1
FROM (SELECT *, CASE WHEN chr1 = chr2 THEN pos1 > pos2 ELSE chr1 > chr2 END AS turn
  FROM (SELECT sample, CAST(sv_id AS STRING) AS id, sv_id,
      CASE WHEN sv_id % 2 = 1 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN sv_id % 2 = 1 THEN pos2 ELSE pos1 END AS pos1,
      CASE WHEN sv_id % 2 = 1 THEN dir2 ELSE dir1 END AS dir1, CASE WHEN sv_id % 2 = 1 THEN chr1 ELSE chr2 END AS chr2,
      CASE WHEN sv_id % 2 = 1 THEN pos1 ELSE pos2 END AS pos2, CASE WHEN sv_id % 2 = 1 THEN dir1 ELSE dir2 END AS dir2
    FROM sv) s) t
""",
)
def scan_sv_simple(spark, sf_dir):
    lines = views.query(
        spark,
        sf_dir,
        """
SELECT sample, sv_id AS ordinal, concat_ws('\\t',
  CASE WHEN sv_id % 2 = 1 THEN chr2 ELSE chr1 END, CASE WHEN sv_id % 2 = 1 THEN pos2 ELSE pos1 END,
  CASE WHEN sv_id % 2 = 1 THEN dir2 ELSE dir1 END, CASE WHEN sv_id % 2 = 1 THEN chr1 ELSE chr2 END,
  CASE WHEN sv_id % 2 = 1 THEN pos1 ELSE pos2 END, CASE WHEN sv_id % 2 = 1 THEN dir1 ELSE dir2 END,
  'C' || sv_id % 5, sv_id) AS line FROM sv""",
        "sv",
    )
    names = ("chr1", "pos1", "dir1", "chr2", "pos2", "dir2", "classification", "ID")
    svs = sv.sv_simple(lines_to_table(views.stored(lines), names), use_dir=True, class_field="classification")
    return svs.select(
        "sample",
        F.col("original_id").cast("long").alias("original_id"),
        "chr1",
        "pos1",
        "dir1",
        "chr2",
        "pos2",
        "dir2",
        "classification",
        "original_pos1",
    )


_VCF_SV = """
SELECT sample, sample AS path, sv_id * 2 + m AS ordinal, concat_ws('\\t',
  CASE WHEN m = 0 THEN chr1 ELSE chr2 END, CASE WHEN m = 0 THEN pos1 ELSE pos2 END, sv_id || '_' || (m + 1), 'N',
  CASE WHEN m = 0 THEN CASE WHEN dir1 = '+' THEN concat('N[', chr2, ':', pos2, '[') ELSE concat(']', chr2, ':', pos2, ']N') END
    ELSE CASE WHEN dir2 = '+' THEN concat('N]', chr1, ':', pos1, ']') ELSE concat('[', chr1, ':', pos1, '[N') END END,
  '50', CASE WHEN sv_id % 13 = 5 AND m = 1 THEN 'LowQual' WHEN sv_id % 2 = 0 THEN 'PASS' ELSE '.' END,
  concat('SVTYPE=BND;', CASE WHEN sv_id % 3 = 0 THEN 'PARID=' ELSE 'MATEID=' END, sv_id, '_', 2 - m, ';QC=1')) AS line
FROM sv LATERAL VIEW explode(array(0, 1)) e AS m"""


@register(
    "pair_vcf_mates",
    over=("sv",),
    sql="""
SELECT sample, CAST(sv_id AS STRING) || '_1' AS original_id, chr1, pos1, dir1, chr2, pos2, dir2
FROM sv WHERE sv_id % 13 <> 5
""",
)
def pair_vcf_mates(spark, sf_dir):
    lines = views.stored(views.query(spark, sf_dir, _VCF_SV, "sv"))
    return sv.sv_vcf(lines).select(
        "sample", "original_id", "chr1", "pos1", "dir1", "chr2", "pos2", "dir2"
    )


@register(
    "scan_sv_caller_table",
    over=("sv",),
    sql="""
SELECT sample, chr1, pos1, dir1, chr2, pos2, dir2 FROM (
  SELECT sample, sv_id, CASE WHEN turn THEN chr2 ELSE chr1 END AS chr1,
    CASE WHEN turn THEN pos2 ELSE pos1 END AS pos1, CASE WHEN turn THEN dir2 ELSE dir1 END AS dir1,
    CASE WHEN turn THEN chr1 ELSE chr2 END AS chr2, CASE WHEN turn THEN pos1 ELSE pos2 END AS pos2,
    CASE WHEN turn THEN dir1 ELSE dir2 END AS dir2
  FROM (SELECT *, chr1 > chr2 AS turn FROM sv) s) t
WHERE sv_id % 60 >= 20 AND (sv_id * 7) % 90 >= 20 AND sv_id % 19 <> 3
  AND NOT (sv_id % 4 = 1 AND sv_id % 3 = 1)
""",
)
def scan_sv_caller_table(spark, sf_dir):
    lines = views.query(
        spark,
        sf_dir,
        """
SELECT sample, sv_id AS ordinal, concat_ws('\\t', concat(chr1, ':', pos1), dir1, concat(chr2, ':', pos2), dir2,
  sv_id % 60, (sv_id * 7) % 90, CASE WHEN sv_id % 4 = 1 THEN 'Satellite' ELSE 'LINE' END,
  CASE WHEN sv_id % 3 = 1 THEN 'Simple_repeat' ELSE 'none' END,
  CASE WHEN sv_id % 19 = 3 THEN 'normal' ELSE 'tumour' END) AS line FROM sv""",
        "sv",
    )
    names = (
        "C1_anchor",
        "C1_anchor_dir",
        "C1_realign",
        "C1_realign_dir",
        "C1_avg_realign_mapq",
        "C2_avg_realign_mapq",
        "repeat1",
        "repeat2",
        "normal",
    )
    return sv.sv_caller_table(lines_to_table(views.stored(lines), names)).select(
        "sample", "chr1", "pos1", "dir1", "chr2", "pos2", "dir2"
    )


@register(
    "sv_norm_mean",
    over=("sv_cnt",),
    sql="SELECT sample, sv_id, norm1, norm2, (norm1 + norm2) / 2.0 AS raw_norm_mean FROM sv_cnt",
)
def sv_norm_mean(spark, sf_dir):
    lines = views.query(
        spark,
        sf_dir,
        "SELECT sample, sv_id AS ordinal, concat_ws('\\t', sv_id, norm1, norm2) AS line FROM sv_cnt",
        "sv_cnt",
    )
    table = sv.sv_counts_table(lines_to_table(lines, ("sv_id", "norm1", "norm2")))
    return table.select("sample", "sv_id", "norm1", "norm2", "raw_norm_mean")


# ---------------------------------------------------------------- copy number

_PART = """
SELECT 'S' || CAST(p_partkey % 4 AS STRING) AS sample, p_partkey AS ordinal, p_partkey % 5 AS k,
  p_partkey * 1000 AS lo, p_partkey * 1000 + 900 AS hi, p_partkey % 4 AS a, p_partkey % 3 AS b,
  p_partkey % 17 = 4 AS gone, CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 0.75 ELSE 0.5 END AS f
FROM part
"""


def _cnv_lines(spark, sf_dir, fields: str):
    return views.query(
        spark,
        sf_dir,
        f"SELECT sample, CAST(ordinal AS BIGINT) AS ordinal, concat_ws('\\t', {fields}) AS line FROM ({_PART}) p",
        "part",
    )


def _shown(segments):
    return segments.select(
        "sample", "chr", "ordinal", "startpos", "endpos", genotype.render(F.col("states")).alias("gtype")
    )


_SQL_HEAD = "SELECT sample, CAST(k AS STRING) AS chr, CAST(ordinal AS BIGINT) AS ordinal, CAST(lo AS BIGINT) AS startpos, CAST(hi AS BIGINT) AS endpos, "


def _num(expr: str) -> str:
    return f"CAST(CAST({expr} AS DOUBLE) AS STRING)"


@register(
    "cnv_from_battenberg",
    steps=(("p", _PART),),
    sql=_SQL_HEAD
    + f"{_num('a')} || ',' || {_num('b')} || ',' || {_num('f')} || CASE WHEN f <> 1 THEN '|' || {_num('a + 1')}"
    + f" || ',' || {_num('b')} || ',' || {_num('1 - f')} ELSE '' END AS gtype FROM p WHERE NOT gone",
)
def cnv_from_battenberg(spark, sf_dir):
    lines = _cnv_lines(
        spark,
        sf_dir,
        "k, lo, hi, IF(gone, 'NA', CAST(a AS STRING)), b, f, IF(f = 1, 'NA', CAST(a + 1 AS STRING)),"
        " IF(f = 1, 'NA', CAST(b AS STRING)), IF(f = 1, 'NA', CAST(1 - f AS STRING))",
    )
    names = ("chr", "startpos", "endpos", "nMaj1_A", "nMin1_A", "frac1_A", "nMaj2_A", "nMin2_A", "frac2_A")
    return _shown(cnv.segments(lines_to_table(lines, names)))


@register(
    "cnv_from_consensus",
    steps=(("p", _PART),),
    sql=_SQL_HEAD
    + f"{_num('a')} || ',' || {_num('b')} || ',' || {_num('f')} AS gtype FROM p WHERE NOT gone",
)
def cnv_from_consensus(spark, sf_dir):
    lines = _cnv_lines(spark, sf_dir, "k, lo, hi, IF(gone, 'NA', CAST(a AS STRING)), b, f")
    names = ("chromosome", "start", "end", "major_cn", "minor_cn", "clonal_frequency")
    return _shown(cnv.segments(lines_to_table(lines, names)))


@register(
    "cnv_from_titan",
    steps=(("p", _PART),),
    sql=_SQL_HEAD
    + f"CASE WHEN gone THEN {_num('a + b')} || ',0.0' ELSE {_num('a')} || ',' || {_num('b')} END || ',' || {_num('f')}"
    + f" || CASE WHEN f <> 1 THEN '|1.0,' || CASE WHEN gone THEN '0.0' ELSE '1.0' END || ',' || {_num('1 - f')}"
    + " ELSE '' END AS gtype FROM p",
)
def cnv_from_titan(spark, sf_dir):
    lines = _cnv_lines(
        spark,
        sf_dir,
        "k, lo, hi, 'HET', a + b, IF(gone, 'NA', CAST(a AS STRING)), b, IF(f = 1, 'NA', CAST(f AS STRING))",
    )
    names = (
        "Chromosome",
        "Start",
        "End",
        "TITAN_call",
        "Corrected_Copy_Number",
        "Corrected_MajorCN",
        "Corrected_MinorCN",
        "Cellular_Prevalence",
    )
    return _shown(cnv.segments(lines_to_table(lines, names)))


@register(
    "cnv_from_ascat",
    steps=(("p", _PART),),
    sql=_SQL_HEAD + f"{_num('a')} || ',' || {_num('b')} || ',1.0' AS gtype FROM p WHERE NOT gone",
)
def cnv_from_ascat(spark, sf_dir):
    lines = _cnv_lines(
        spark, sf_dir, "ordinal, k, lo, hi, 2, 1, IF(gone, 'NA', CAST(a + b AS STRING)), b"
    )
    table = lines_to_table(lines.withColumnRenamed("ordinal", "file_row"), cnv.CSV_NAMES)
    return _shown(cnv.segments(table.withColumnRenamed("file_row", "ordinal")))


# Six files, one of each format, their columns in an order of their own.
_MIXED = {
    "M0": ("chr startpos endpos frac1_A nMaj1_A nMin1_A nMaj2_A nMin2_A frac2_A", "k, lo, hi, f, IF(gone, 'NA', CAST(a AS STRING)), b, a + 1, b, 1 - f"),
    "M1": (
        " ".join(f"battenberg_{n}_A" for n in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2")) + " start end chr",
        "IF(gone, 'NA', CAST(a AS STRING)), b, f, a + 1, b, 1 - f, lo, hi, k",
    ),
    "M2": ("chromosome start end clonal_frequency minor_cn major_cn", "k, lo, hi, f, b, IF(gone, 'NA', CAST(a AS STRING))"),
    "M3": ("star chromosome start end major_cn minor_cn", "'1', k, lo, hi, IF(gone, 'NA', CAST(a AS STRING)), b"),
    "M4": (
        "TITAN_call Chromosome Start End Corrected_Copy_Number Corrected_MajorCN Corrected_MinorCN Cellular_Prevalence",
        "'HET', k, lo, hi, a + b, IF(gone, 'NA', CAST(a AS STRING)), b, f",
    ),
    "M5": (None, "ordinal, k, lo, hi, 2, 1, IF(gone, 'NA', CAST(a + b AS STRING)), b"),
}
_SIX = f"SELECT *, 'M' || CAST(ordinal % 6 AS STRING) AS m FROM ({_PART}) p"
_SECOND = f"CASE WHEN f <> 1 THEN '|' || {_num('a + 1')} || ',' || {_num('b')} || ',' || {_num('1 - f')} ELSE '' END"
_LEFT = f"CASE WHEN f <> 1 THEN '|1.0,' || CASE WHEN gone THEN '0.0' ELSE '1.0' END || ',' || {_num('1 - f')} ELSE '' END"


@register(
    "cnv_mixed_formats",
    steps=(("p", _SIX),),
    sql=_SQL_HEAD.replace("sample,", "m AS sample,")
    + f"CASE WHEN m = 'M4' AND gone THEN {_num('a + b')} || ',0.0' ELSE {_num('a')} || ',' || {_num('b')} END || ',' ||"
    + f" CASE WHEN m IN ('M3', 'M5') THEN '1.0' ELSE {_num('f')} END || CASE WHEN m IN ('M0', 'M1') THEN {_SECOND}"
    + f" WHEN m = 'M4' THEN {_LEFT} ELSE '' END AS gtype FROM p WHERE m = 'M4' OR NOT gone",
)
def cnv_mixed_formats(spark, sf_dir):
    given = views.stored(views.query(spark, sf_dir, _SIX, "part"))
    lines = None
    for m, (header, fields) in _MIXED.items():
        sep = "," if header is None else "\\t"
        body = given.filter(F.col("m") == m).select(
            F.col("m").alias("sample"), F.col("ordinal").cast("long").alias("ordinal"), F.expr(f"concat_ws('{sep}', {fields})").alias("line")
        )
        if header:
            first = body.groupBy("sample").agg((F.min("ordinal") - 1).alias("ordinal"))
            body = body.unionByName(first.withColumn("line", F.lit(header.replace(" ", "\t"))))
        lines = body if lines is None else lines.unionByName(body)
    return _shown(cnv.mixed_segments(lines.withColumn("path", F.concat("sample", F.lit(".txt")))))


# ---------------------------------------------------------------- point mutations

# Line items as mutations: position and counts, and flags that make rows drop.
_ITEM = """
SELECT 'S' || CAST(l_suppkey % 4 AS STRING) AS sample, CAST(l_partkey % 22 + 1 AS STRING) AS chrom,
  l_orderkey * 10 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS n_ref,
  CAST((l_suppkey + l_linenumber) % 30 AS BIGINT) AS n_var, l_partkey % 7 = 2 AS bad,
  l_partkey % 11 = 3 AS germ, CAST(l_suppkey % 4 AS INT) AS s, CAST(l_partkey % 4 AS INT) AS rb,
  CAST((l_partkey + 1 + l_linenumber % 3) % 4 AS INT) AS ab
FROM lineitem
"""

_COUNTED = "SELECT sample, chrom, pos, CAST(n_ref AS DOUBLE) AS ref_n, CAST(n_var AS DOUBLE) AS var_n FROM i "


def _lines(spark, sf_dir, fields: str, names: str | None = None, path: str = "sample"):
    data = views.query(
        spark,
        sf_dir,
        f"SELECT sample, {path} AS path, pos AS ordinal, concat_ws('\\t', {fields}) AS line FROM ({_ITEM}) i",
        "lineitem",
    )
    if names is None:
        return views.stored(data)
    head = "'#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT'"
    header = views.query(
        spark,
        sf_dir,
        f"SELECT DISTINCT sample, {path} AS path, CAST(-1 AS BIGINT) AS ordinal,"
        f" concat_ws('\\t', {head}, {names}) AS line FROM ({_ITEM}) i",
        "lineitem",
    )
    return views.stored(data.unionByName(header))


def _snv_shown(df):
    return df.select(
        "sample", "chrom", "pos", F.col("ref").alias("ref_n"), F.col("var").alias("var_n")
    )


@register(
    "snv_from_callstats", steps=(("i", _ITEM),), sql=_COUNTED + "WHERE NOT bad"
)
def snv_from_callstats(spark, sf_dir):
    lines = _lines(
        spark, sf_dir, "chrom, pos, n_ref, n_var, IF(bad, 'REJECT', 'KEEP')"
    )
    names = ("contig", "position", "t_ref_sum", "t_alt_sum", "judgement")
    return _snv_shown(snv.callstats(lines_to_table(lines, names)))


@register(
    "snv_from_mutect",
    steps=(("i", _ITEM),),
    sql=_COUNTED + "WHERE NOT bad AND NOT germ AND n_var <> 0",
)
def snv_from_mutect(spark, sf_dir):
    tumour = "concat('0/1:', n_ref, ',', n_var, ':99')"
    normal = "concat('0/0:', 20, ',', IF(germ, 2, 0), ':99')"
    lines = _lines(
        spark,
        sf_dir,
        "chrom, pos, '.', 'A', 'C', '.', IF(bad, 'REJECT', 'PASS'), '.', 'GT:AD:DP',"
        f" IF(s % 2 = 0, {tumour}, {normal}), IF(s % 2 = 0, {normal}, {tumour})",
        "IF(s % 2 = 0, sample, 'normal'), IF(s % 2 = 0, 'normal', sample)",
    )
    return _snv_shown(snv.mutect_vcf(lines))


_BASE = "substr('ACGT', {b} + 1, 1)"


@register(
    "snv_from_basecounts",
    steps=(("i", _ITEM),),
    sql="""
SELECT x.name AS sample, chrom, pos, CAST(CASE WHEN x.name = 'T0' THEN n_ref ELSE n_ref + 1 END AS DOUBLE) AS ref_n,
  CAST(CASE WHEN x.name = 'T0' THEN n_var ELSE n_ref % 3 END AS DOUBLE) AS var_n
FROM i CROSS JOIN (VALUES ('T0'), ('T1')) x(name)
WHERE NOT bad AND rb <> ab AND CASE WHEN x.name = 'T0' THEN n_var ELSE n_ref % 3 END <> 0
""",
)
def snv_from_basecounts(spark, sf_dir):
    def counts(ref: str, var: str) -> str:
        each = ", ',', ".join(f"CASE WHEN rb = {b} THEN {ref} WHEN ab = {b} THEN {var} ELSE 0 END" for b in range(4))
        return f"concat({each})"

    lines = _lines(
        spark,
        sf_dir,
        f"chrom, pos, '.', {_BASE.format(b='rb')}, {_BASE.format(b='ab')}, '.', IF(bad, 'LOW', 'PASS'), '.', 'GT:BCOUNT',"
        f" concat('0/1:', {counts('n_ref', 'n_var')}), concat('0/1:', {counts('n_ref + 1', 'n_ref % 3')})",
        "'T0', 'T1'",
    )
    return _snv_shown(snv.base_counts_vcf(lines))


@register(
    "snv_from_consensus",
    steps=(("i", _ITEM),),
    sql=_COUNTED + "WHERE NOT germ AND n_var <> 0",
)
def snv_from_consensus(spark, sf_dir):
    lines = _lines(
        spark,
        sf_dir,
        "chrom, pos, '.', 'A', 'C', '.', IF(bad, 'LOWSUPPORT', '.'),"
        " concat('Callers=x,y;', IF(germ, '', concat('t_ref_count=', n_ref, ';')), 't_alt_count=', n_var)",
    )
    return _snv_shown(snv.consensus_vcf(lines))


@register(
    "snv_from_strand_counts",
    steps=(("i", _ITEM),),
    sql=_COUNTED + "WHERE NOT bad AND rb <> ab AND n_var <> 0 AND NOT (germ AND s < 2)",
)
def snv_from_strand_counts(spark, sf_dir):
    r, a = _BASE.format(b="rb"), _BASE.format(b="ab")
    forward = [f"CASE WHEN rb = {b} THEN n_ref - n_ref % 5 WHEN ab = {b} THEN n_var - n_var % 2 ELSE 0 END" for b in range(4)]
    reverse = [f"CASE WHEN rb = {b} THEN n_ref % 5 WHEN ab = {b} THEN n_var % 2 ELSE 0 END" for b in range(4)]
    tumour = "concat_ws(':', '0|1', " + ", ".join(forward + reverse) + ")"
    listed = f"concat('DP=9;TG=', IF(germ, concat({r}, {a}), concat({r}, {r})), '/', {r}, {r}, ';SG=', IF(germ, concat({a}, {r}), concat({r}, {r})), '/', {r}, {a})"
    slashed = f"concat('DP=9;', {r}, {r}, '/', {r}, {r}, '=1;', {r}, {a}, '/', {r}, {r}, '=3')"
    lines = _lines(
        spark,
        sf_dir,
        f"chrom, pos, '.', {r}, {a}, '.', IF(bad, 'F1', 'PASS'), IF(s < 2, {listed}, {slashed}),"
        f" 'GT:FAZ:FCZ:FGZ:FTZ:RAZ:RCZ:RGZ:RTZ', '0|0:1:1:1:1:1:1:1:1', {tumour}",
        "'NORMAL', IF(s = 1, 'TUMOR', 'TUMOUR')",
    )
    return _snv_shown(snv.strand_counts_vcf(lines))


# ---------------------------------------------------------------- alignments, parameters


@register(
    "scan_reads",
    over=("reads",),
    sql="SELECT sample, query_name, chrom, ref_start, ref_end, align_start, align_end, len, ins_len, is_reverse FROM reads",
)
def scan_reads(spark, sf_dir):
    lines = views.query(
        spark,
        sf_dir,
        """
SELECT sample, concat_ws('\\t', query_name, 3 + IF(is_reverse, 16, 0), chrom, ref_start + 1, 60,
  concat(IF(align_start > 0, concat(align_start, 'S'), ''), ref_end - ref_start, 'M',
    IF(align_end < len, concat(len - align_end, 'S'), '')), '=', ref_start + 1, ins_len, '*', '*') AS line
FROM reads""",
        "reads",
    )
    reads = alignments.sam_lines(views.stored(lines, spread=False)).drop("is_proper_pair", "is_paired", "is_mapped")
    return placed_reads.write(reads, scratch_path(spark)).scan()


@register(
    "sample_params",
    over=("params",),
    sql="""
SELECT c.sample, COALESCE(purity, 1.0) AS purity, COALESCE(ploidy, 2.0) AS ploidy, COALESCE(read_len, 100) AS read_len,
  COALESCE(insert_mean, 300.0) AS insert_mean, COALESCE(insert_std, 20.0) AS insert_std
FROM (SELECT DISTINCT 'S' || CAST(c_custkey % 7 AS STRING) AS sample FROM customer) c LEFT JOIN params ON c.sample = params.sample
""",
)
def sample_params(spark, sf_dir):
    given = views.view(spark, sf_dir, "params")
    samples = views.query(
        spark, sf_dir, "SELECT 'S' || CAST(c_custkey % 7 AS STRING) AS sample FROM customer", "customer"
    )
    return sample_tables.sample_params(
        samples,
        given.select("sample", "purity", "ploidy"),
        given.select("sample", "read_len", "insert_mean", "insert_std"),
    )
