"""Line deduplication by site-relative frequency, in DataFrame functions only.

For each host, a line's ratio is (pages of the host that contain it) / (pages of the host).  Lines
whose ratio is above ``ratio`` and that stand on at least ``min_pages`` pages (two: one page repeats
nothing) are boilerplate and are dropped from every page of that host.  Exact copies of a page are one
page, on both sides of the division, so a page is not taken for boilerplate because it was crawled often.

A host has at most (lines per page) / ratio such lines, so the list kept for a host is short however
many pages it has, and a page is cleaned in place: texts are not shuffled and lines not regrouped.

Cases: lines are compared without surrounding blanks, blank lines are always kept; a null text stays
null; a null host is a host of its own; repeated rows are all kept and cleaned; an empty table gives
an empty result; columns of the input are kept as they are, but for ``text``, and ``dropped_lines`` comes in place of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, stored

RATIO, REPEATED = 0.05, 2
#: hosts whose lists are broadcast; beyond that, the lists are joined by host
BROADCAST_LINES = 1_000_000
NO_HOST = "\x00"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def line_hashes(text: Column) -> Column:
    """A hash for each line that isn't blank, in order."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.xxhash64(x))


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """host, lines: the hashes of each host's boilerplate lines."""
    pages = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(host, F.lit(NO_HOST)).alias("host"), F.xxhash64("text").alias("page"), F.array_distinct(line_hashes(F.col("text"))).alias("lines"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", "page", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    often = seen.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """``docs`` with cleaned ``text`` and a column ``dropped_lines``."""
    docs = docs.drop("dropped_lines")
    own, at, many = spare(docs.columns, "__host", "__lines", "__host_of")
    found = stored(boilerplate(docs, host, ratio, min_pages).select(F.col("host").alias(many), F.col("lines").alias(at)))
    size = found.agg(F.sum(F.size(at))).head()[0] or 0
    side = F.broadcast(found) if size <= BROADCAST_LINES else found
    joined = docs.withColumn(own, F.coalesce(host, F.lit(NO_HOST))).join(side, F.col(own) == F.col(many), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(at), F.xxhash64(F.trim(x))))
    hit = F.col(at).isNotNull() & F.col("text").isNotNull()
    dropped = F.when(hit, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long")
    text = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return joined.select(*(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns), dropped.alias("dropped_lines"))


#: DuckDB; {src} is the table
SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM {{src}}),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
seen AS (SELECT source, line, count(*) AS n FROM (
    SELECT DISTINCT source, text, trim(line, ' ') AS line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages))
  WHERE line <> '' GROUP BY source, line),
often AS (SELECT s.source, list(s.line) AS lines FROM seen s JOIN totals t ON s.source = t.source
  WHERE s.n >= {REPEATED} AND s.n > {RATIO} * t.pages GROUP BY s.source)
SELECT d.doc_id, d.source,
  CASE WHEN o.lines IS NULL THEN d.text ELSE
    array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(o.lines, trim(x, ' '))), chr(10)) END AS text,
  CASE WHEN o.lines IS NULL THEN 0 ELSE
    len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(o.lines, trim(x, ' ')))) END AS dropped_lines
FROM {{src}} d LEFT JOIN often o ON d.source = o.source
"""
