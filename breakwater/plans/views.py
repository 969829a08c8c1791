"""Genomic tables derived from the driver tables by integer arithmetic.

The text is valid in Spark and in DuckDB.  In Spark the driver tables come in as CTEs
over their Parquet files; in DuckDB they are views of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, free_shuffles

CHROM = "CASE {k} WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["sv"] = (
    ("orders",),
    """
SELECT 'S' || CAST(o_custkey % 4 AS STRING) AS sample, o_orderkey AS sv_id,
  CASE k1 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chr1,
  p1 AS pos1, CASE WHEN d % 2 = 0 THEN '+' ELSE '-' END AS dir1,
  CASE k2 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chr2,
  p1 + len AS pos2, CASE WHEN d < 2 THEN '+' ELSE '-' END AS dir2
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS k1,
    CASE WHEN o_orderkey % 10 = 9 THEN (o_orderkey + 2) % 5 ELSE o_orderkey % 5 END AS k2,
    10000 + (o_orderkey * 7919 + o_custkey * 104729) % 5000000 AS p1,
    CASE WHEN o_orderkey % 17 = 0 THEN 120 ELSE 800 + (o_custkey * 37 + o_orderkey) % 4000 END AS len,
    (o_orderkey + o_custkey) % 4 AS d
  FROM orders) o
""",
)

VIEWS["reads"] = (
    ("lineitem", "sv"),
    """
WITH f AS (SELECT s.sample, s.sv_id, s.chr1, s.pos1, s.dir1, s.chr2, s.pos2, s.dir2,
    l_partkey % 5 AS kind, (l_suppkey * 3 + l_linenumber) % 40 AS j, l_suppkey % 2 AS side,
    'q' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_'
      || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS query_name
  FROM lineitem JOIN sv s ON l_orderkey = s.sv_id),
p AS (SELECT DISTINCT sample, query_name, kind, j,
    CASE WHEN side = 0 THEN chr1 ELSE chr2 END AS c,
    CASE WHEN side = 0 THEN pos1 ELSE pos2 END AS b,
    CASE WHEN sv_id % 6 = 0 AND j % 2 = 1 THEN CASE WHEN side = 0 THEN dir2 ELSE dir1 END
      WHEN side = 0 THEN dir1 ELSE dir2 END AS dr,
    chr1, pos1, dir1, chr2, pos2, dir2 FROM f)
SELECT sample, query_name, chrom, CAST(ref_start AS BIGINT) AS ref_start,
  CAST(ref_end AS BIGINT) AS ref_end, CAST(align_start AS BIGINT) AS align_start,
  CAST(align_end AS BIGINT) AS align_end, CAST(100 AS BIGINT) AS len,
  CAST(ins_len AS BIGINT) AS ins_len, is_reverse
FROM (
  SELECT sample, query_name, CASE WHEN kind = 3 THEN chr1 ELSE c END AS chrom,
    CASE kind WHEN 0 THEN b - 50 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 60 ELSE b END
      WHEN 2 THEN b - 150 - j
      WHEN 3 THEN CASE WHEN dir1 = '+' THEN pos1 - 110 - j ELSE pos1 + 10 + j END
      ELSE b - 320 END AS ref_start,
    CASE kind WHEN 0 THEN b + 50 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b ELSE b + 60 END
      WHEN 2 THEN b - 50 - j
      WHEN 3 THEN CASE WHEN dir1 = '+' THEN pos1 - 10 - j ELSE pos1 + 110 + j END
      ELSE b - 220 END AS ref_end,
    CASE WHEN kind = 1 AND dr = '-' THEN 40 ELSE 0 END AS align_start,
    CASE WHEN kind = 1 AND dr = '+' THEN 60 ELSE 100 END AS align_end,
    CASE WHEN kind = 3 THEN 9000 ELSE 300 END AS ins_len,
    CASE WHEN kind = 3 THEN dir1 = '-' ELSE FALSE END AS is_reverse FROM p
  UNION ALL
  SELECT sample, query_name, CASE WHEN kind = 3 THEN chr2 ELSE c END,
    CASE kind WHEN 0 THEN b + 150 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 240 ELSE b + 200 END
      WHEN 2 THEN b + 50 - j
      WHEN 3 THEN CASE WHEN dir2 = '+' THEN pos2 - 110 - j ELSE pos2 + 10 + j END
      ELSE b - 120 END,
    CASE kind WHEN 0 THEN b + 250 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 140 ELSE b + 300 END
      WHEN 2 THEN b + 150 - j
      WHEN 3 THEN CASE WHEN dir2 = '+' THEN pos2 - 10 - j ELSE pos2 + 110 + j END
      ELSE b - 20 END,
    0, 100, CASE WHEN kind = 3 THEN -9000 ELSE -300 END,
    CASE WHEN kind = 3 THEN dir2 = '-' ELSE TRUE END FROM p) r
""",
)

# Texts for Spark alone that give the same rows.
ONE_PASS: dict[str, str] = {}

# In one pass over the fragments, which the union makes distinct twice: a fragment's two reads are
# made from its one row.
ONE_PASS["reads"] = (
    VIEWS["reads"][1].split("SELECT sample, query_name, chrom,")[0]
    + """
SELECT sample, query_name, CASE WHEN kind = 3 THEN CASE WHEN e = 1 THEN chr1 ELSE chr2 END ELSE c END AS chrom,
  CAST(CASE WHEN e = 1 THEN
    CASE kind WHEN 0 THEN b - 50 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 60 ELSE b END
      WHEN 2 THEN b - 150 - j
      WHEN 3 THEN CASE WHEN dir1 = '+' THEN pos1 - 110 - j ELSE pos1 + 10 + j END
      ELSE b - 320 END ELSE
    CASE kind WHEN 0 THEN b + 150 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 240 ELSE b + 200 END
      WHEN 2 THEN b + 50 - j
      WHEN 3 THEN CASE WHEN dir2 = '+' THEN pos2 - 110 - j ELSE pos2 + 10 + j END
      ELSE b - 120 END END AS BIGINT) AS ref_start,
  CAST(CASE WHEN e = 1 THEN
    CASE kind WHEN 0 THEN b + 50 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b ELSE b + 60 END
      WHEN 2 THEN b - 50 - j
      WHEN 3 THEN CASE WHEN dir1 = '+' THEN pos1 - 10 - j ELSE pos1 + 110 + j END
      ELSE b - 220 END ELSE
    CASE kind WHEN 0 THEN b + 250 - j % 20 WHEN 1 THEN CASE WHEN dr = '+' THEN b - 140 ELSE b + 300 END
      WHEN 2 THEN b + 150 - j
      WHEN 3 THEN CASE WHEN dir2 = '+' THEN pos2 - 10 - j ELSE pos2 + 110 + j END
      ELSE b - 20 END END AS BIGINT) AS ref_end,
  CAST(CASE WHEN e = 1 AND kind = 1 AND dr = '-' THEN 40 ELSE 0 END AS BIGINT) AS align_start,
  CAST(CASE WHEN e = 1 AND kind = 1 AND dr = '+' THEN 60 ELSE 100 END AS BIGINT) AS align_end,
  CAST(100 AS BIGINT) AS len,
  CAST(CASE WHEN kind = 3 THEN 9000 ELSE 300 END * CASE WHEN e = 1 THEN 1 ELSE -1 END AS BIGINT) AS ins_len,
  CASE WHEN kind = 3 THEN CASE WHEN e = 1 THEN dir1 = '-' ELSE dir2 = '-' END ELSE e = 2 END AS is_reverse
FROM p LATERAL VIEW explode(array(1, 2)) each AS e
"""
)

# One segment for each part: 40 kb tiles on four chromosomes (none on Y), some with a
# gap before them, some running into the next one, some invalid, some subclonal.
VIEWS["cnv"] = (
    ("part",),
    """
SELECT sample, CASE k WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' ELSE 'X' END AS chr,
  t AS ordinal, t * 40000 + 1 + CASE WHEN t % 7 = 6 THEN 30000 ELSE 0 END AS startpos,
  t * 40000 + 39800 + CASE WHEN t % 5 = 2 THEN 15000 ELSE 0 END AS endpos,
  CAST(CASE WHEN t % 11 = 5 THEN 0 ELSE 1 + (t + k) % 3 END AS DOUBLE) AS nmaj1,
  CAST(CASE WHEN t % 11 = 5 THEN 0 ELSE (t + s) % 2 END AS DOUBLE) AS nmin1,
  CAST(CASE WHEN t % 4 = 3 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS frac1
FROM (SELECT 'S' || CAST(p_partkey % 4 AS STRING) AS sample, p_partkey % 4 AS s,
    CAST(FLOOR(p_partkey / 4) AS BIGINT) % 4 AS k,
    CAST(FLOOR(p_partkey / 16) AS BIGINT) AS t FROM part) x
""",
)

VIEWS["snv"] = (
    ("lineitem",),
    """
SELECT 'S' || CAST(l_suppkey % 4 AS STRING) AS sample,
  CASE l_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chrom,
  1 + (l_orderkey * 331 + l_partkey * 17) % 5000000 AS pos, CAST(l_quantity AS BIGINT) AS ref_n,
  CAST((l_suppkey + l_linenumber) % 30 AS BIGINT) AS var_n FROM lineitem
""",
)

VIEWS["sv_cnt"] = (
    ("orders", "sv"),
    """
SELECT sv.*, split1, split2, spanning, norm1, norm2, split1 + split2 + spanning AS support,
  norm1 * 4 + o_custkey % 9 AS win_norm1, norm2 * 4 + o_custkey % 5 AS win_norm2,
  CASE WHEN chr1 <> chr2 THEN 'INTRX' WHEN dir1 = dir2 THEN 'INV' WHEN dir1 = '+' THEN 'DEL' ELSE 'DUP' END AS classification
FROM sv JOIN (SELECT o_orderkey, o_custkey, o_custkey % 7 AS split1,
    (o_custkey + o_orderkey) % 5 AS split2, o_orderkey % 4 AS spanning,
    (o_orderkey * 13 + o_custkey) % 40 AS norm1, (o_orderkey * 29) % 43 AS norm2
  FROM orders) c ON sv.sv_id = c.o_orderkey
""",
)

# Orders beside their SVs are not gathered for a broadcast, however well their files are packed.
ONE_PASS["sv_cnt"] = VIEWS["sv_cnt"][1].replace("SELECT sv.*", "SELECT /*+ MERGE(c) */ sv.*")

VIEWS["blacklist"] = (
    ("supplier",),
    """
SELECT CASE s_suppkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chrom,
  (s_suppkey * 48611) % 5000000 AS start_pos, (s_suppkey * 48611) % 5000000 + 4000 AS end_pos
FROM supplier
""",
)

VIEWS["germline"] = (
    ("sv",),
    """
SELECT sample, sv_id AS gl_id, chr1, pos1 + sv_id % 41 - 20 AS pos1, chr2,
  pos2 - sv_id % 37 + 18 AS pos2, sv_id % 3 AS support FROM sv
""",
)

VIEWS["sv2"] = (
    ("sv",),
    """
SELECT sample, sv_id AS sv2_id,
  CASE WHEN sv_id % 2 = 0 THEN chr1 ELSE chr2 END AS chr1,
  CASE WHEN sv_id % 2 = 0 THEN pos1 ELSE pos2 END + sv_id % 31 - 15 AS pos1,
  CASE WHEN sv_id % 2 = 0 THEN dir1 ELSE dir2 END AS dir1,
  CASE WHEN sv_id % 2 = 0 THEN chr2 ELSE chr1 END AS chr2,
  CASE WHEN sv_id % 2 = 0 THEN pos2 ELSE pos1 END + sv_id % 23 AS pos2,
  CASE WHEN sv_id % 2 = 0 THEN dir2 ELSE dir1 END AS dir2
FROM sv
""",
)

VIEWS["params"] = (
    ("orders",),
    """
SELECT 'S' || CAST(k AS STRING) AS sample, CAST(0.6 + 0.1 * k AS DOUBLE) AS purity,
  CAST(2 + k % 2 AS DOUBLE) AS ploidy, CAST(100 AS BIGINT) AS read_len,
  CAST(300 AS DOUBLE) AS insert_mean, CAST(50 AS DOUBLE) AS insert_std
FROM (SELECT DISTINCT o_custkey % 4 AS k FROM orders) o
""",
)

# Orders in sixes: one SV alone, two that share both ends, three in a ring; some sixes
# have an end moved away.  Most are mixed at both ends.
VIEWS["mixed"] = (
    ("orders",),
    """
SELECT 'S' || CAST(g % 4 AS STRING) AS sample, o_orderkey AS sv_id, chrom AS chr1,
  b + o1 AS pos1, CASE WHEN one THEN '+' END AS dir1, chrom AS chr2, b + o2 AS pos2,
  CAST(NULL AS STRING) AS dir2,
  CASE WHEN lost THEN 'UNKNOWN_DIR;MIXED' WHEN one THEN 'MIXED' ELSE 'MIXED;MIXED' END AS tags,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE b + o1 + 2 END AS ca_right1, b + o1 - 1 AS ca_left1,
  b + o2 + 3 AS ca_right2, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE b + o2 - 2 END AS ca_left2
FROM (SELECT o_orderkey, g, b, o_custkey % 10 = 1 AS one, o_custkey % 10 = 2 AS lost,
    CASE g % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chrom,
    CASE m WHEN 0 THEN 20000 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 40000 WHEN 4 THEN 42001
      ELSE 40002 END AS o1,
    CASE m WHEN 0 THEN 21000 WHEN 1 THEN 3000
      WHEN 2 THEN CASE WHEN g % 7 = 1 THEN 3500 ELSE 2998 END WHEN 3 THEN 42000
      WHEN 4 THEN CASE WHEN g % 7 = 2 THEN 45300 WHEN g % 7 = 3 THEN 40004 ELSE 45000 END
      ELSE 45002 END AS o2
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS m,
      CAST(FLOOR(o_orderkey / 6) AS BIGINT) AS g,
      10000 + (CAST(FLOOR(o_orderkey / 6) AS BIGINT) * 12007) % 5000000 AS b FROM orders) x) y
""",
)

# Orders in fours: a duplication and a deletion that start together, a deletion of the
# part that moved, an inversion.
VIEWS["moved"] = (
    ("orders",),
    """
SELECT 'S' || CAST(g % 4 AS STRING) AS sample, o_orderkey AS sv_id,
  CASE g % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chr1,
  b + CASE m WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN g % 4 = 1 THEN 50 ELSE 4 END
    WHEN 2 THEN 5003 ELSE 7000 END AS pos1,
  CASE m WHEN 0 THEN '-' WHEN 3 THEN '-' ELSE '+' END AS dir1,
  CASE g % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '10' WHEN 3 THEN 'X' ELSE 'Y' END AS chr2,
  b + CASE m WHEN 0 THEN 5000 WHEN 1 THEN 9000
    WHEN 2 THEN CASE WHEN g % 3 = 1 THEN 9040 ELSE 8998 END ELSE 7500 END AS pos2,
  CASE m WHEN 0 THEN '+' ELSE '-' END AS dir2
FROM (SELECT o_orderkey, o_orderkey % 4 AS m, CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS g,
    10000 + (CAST(FLOOR(o_orderkey / 4) AS BIGINT) * 12007) % 5000000 AS b FROM orders) x
""",
)


def _needed(names: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Views in dependency order, and the driver tables below them."""
    views: list[str] = []
    tables: list[str] = []

    def visit(name: str) -> None:
        if name not in VIEWS:
            if name not in tables:
                tables.append(name)
            return
        for dependency in VIEWS[name][0]:
            visit(dependency)
        if name not in views:
            views.append(name)

    for name in names:
        visit(name)
    return views, tables


def ctes(*names: str) -> str:
    """CTE list (without WITH) that defines the views, for DuckDB."""
    views, _ = _needed(names)
    return ",\n".join(f"{v} AS ({VIEWS[v][1].strip()})" for v in views)


def query(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run ``sql`` over the named views and driver tables."""
    views, tables = _needed(names)
    parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    parts += [f"{v} AS ({ONE_PASS.get(v, VIEWS[v][1]).strip()})" for v in views]
    return spark.sql("WITH " + ",\n".join(parts) + "\n" + sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}", name)


def stored(df: DataFrame, spread: bool = True) -> DataFrame:
    """``df`` written once and read from there on, as the tables and files are that
    operators get in use; a driver table may be a single Parquet row group, so the rows
    are spread over the cores first, unless (``spread``) a shuffle of the view does it."""
    if spread:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    kept = cut_lineage(df)
    free_shuffles(df.sparkSession)
    return kept
