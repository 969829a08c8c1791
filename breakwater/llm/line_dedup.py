"""Site-relative frequency of lines.

A line is boilerplate of a host if the share of the host's pages that contain it is above
``ratio`` (and it is on ``min_pages`` pages at least, so that small hosts, where any line
has a large share, lose nothing).  Pages of one host with equal text count as one page, as
copies say nothing about a site's layout.  The ratio decides on every page alike, also where
little is left of it.

Counts are combined before they are dealt, so a line or host with a third of all rows is
no hot key.  The lines above the ratio are few: a host can have at most (lines per page) /
``ratio`` of them.  They are broadcast if they are below a checked number, else joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 0.02
MIN_PAGES = 4
#: Lines above the ratio that may be broadcast (16 bytes each and their host).
BROADCAST_LINES = 100_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """What lines are compared by; null for an empty line."""
    return F.when(_trimmed(line) != "", F.xxhash64(_trimmed(line)))


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with its text freed of boilerplate lines, and n_lines and n_dropped (columns
    of these names are replaced).  Lines are compared without the blanks around them; empty
    lines stay.  All rows stay.  A null text stays null with no lines; null hosts are one
    host; an empty table gives no rows."""
    text = F.col(f"`{text_col}`")
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    pages = common.stored(
        docs.select(host.alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(F.array_compact(F.transform(lines, _key))).alias("keys"))
        .filter(text.isNotNull())
        .groupBy("host", "page")
        .agg(F.first("keys").alias("keys"))
    )
    counted = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    above = common.stored(counted.join(totals, "host").filter(F.col("n") > F.lit(float(ratio)) * F.col("total")).select("host", "key"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row stays packed, so that its columns may have any names
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text.alias("text"), host.alias("host"), F.xxhash64(text).alias("page"))
    if above.count() <= broadcast_lines:
        dropped = above.groupBy("host").agg(F.collect_list("key").alias("drop"))
        joined = base.join(F.broadcast(dropped), "host", "left")
    else:
        hits = pages.select("host", "page", F.explode("keys").alias("key")).join(above, ["host", "key"])
        dropped = hits.groupBy("host", "page").agg(F.collect_list("key").alias("drop"))
        joined = base.join(dropped, ["host", "page"], "left")
    text = F.col("text")
    each = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    lost = F.filter("lines", lambda e: e["key"].isNotNull() & F.array_contains(F.coalesce("drop", F.array().cast("array<bigint>")), e["key"]))
    marked = joined.withColumn("lines", each).withColumn("lost", lost)
    whole = text.isNull() | (F.size("lost") == 0)
    kept = F.filter("lines", lambda e: e["key"].isNull() | ~F.array_contains("drop", e["key"]))
    rest = F.array_join(F.transform(kept, lambda e: e["line"]), "\n")
    return marked.select(
        *[F.when(whole, text).otherwise(rest).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns],
        F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text FROM documents),
l AS (
  SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
counted AS (SELECT host, bare, count(DISTINCT text) AS n FROM k WHERE bare <> '' GROUP BY host, bare),
totals AS (SELECT host, count(DISTINCT text) AS total FROM d GROUP BY host),
above AS (
  SELECT host, bare FROM counted JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * total),
marked AS (
  SELECT k.rid, k.line, k.pos, above.bare IS NOT NULL AS gone
  FROM k LEFT JOIN above ON k.host = above.host AND k.bare = above.bare),
pages AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM marked GROUP BY rid)
SELECT d.doc_id, CASE WHEN n_gone = 0 OR d.text IS NULL THEN d.text ELSE rest END AS text,
  coalesce(n_lines, 0) AS n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE n_gone END AS n_dropped
FROM d LEFT JOIN pages USING (rid)
"""
