"""Sources and sinks: CSV with provenance, folders, BibTeX, JSON caches, counts with sum expressions, timing rows."""

from __future__ import annotations

import csv
import json
import re
import warnings
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import pick, sum_expression

#: fixed values: the headers of a field in order of precedence; additions stand after a bar
ALIASES = {
    "title": "title, Document Title | Item Title, Title",
    "doi": "DOI, doi | Item DOI",
    "abstract": "Abstract, abstract",
    "year": "Publication Year, Year, year",
    "venue": "Publication Title, Source title, journal, booktitle, venue",
    "link": "Link, url, PDF Link | URL, link",
}
#: fixed values: the headers of keywords, all of which are taken
KEYWORDS = ("Author Keywords", "keywords", "keyword", "IEEE Terms")
CSV = {"header": False, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1, "encoding": "UTF-8"}
#: fixed values: the sections of a configuration and their defaults
CONFIG = {
    "input": {"csv_files": [], "title_column": "Title", "encoding": "utf-8"},
    "output": {"included_csv": "included_papers.csv", "excluded_csv": "excluded_papers.csv", "duplicates_csv": "duplicates_removed.csv"},
    "filters": {"keywords": "", "exclude-keywords": "", "include-papers": [], "whole_word": False},
    "deduplicate": {"enabled": True, "keep": "first"},
}
#: fixed values: the columns of a timing row
TIMING = "run int, elapsed_seconds string, timestamp_utc string, lang string, file string, command string, opt_level string, rustc_flags string"


def config(text: str) -> dict:
    """Defaults, overlaid section by section; of ``deduplicate.keep``, what isn't first or last counts as first, with a warning."""
    given = json.loads(text)
    out = {name: {**section, **(given.get(name) if isinstance(given.get(name), dict) else {})} for name, section in CONFIG.items()}
    if out["deduplicate"]["keep"] not in ("first", "last"):
        warnings.warn(f"deduplicate.keep is {out['deduplicate']['keep']!r}; first is used", stacklevel=2)
        out["deduplicate"]["keep"] = "first"
    return out


def distinct_files(paths: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(paths))


def files_of(spark: SparkSession, folder: str, pattern: str = "*.csv", own: Iterable[str] = ("merged_csvs.csv",)) -> list[str]:
    """Paths of a folder's files in order of their names, in any store that Spark reads; ``own`` are results that aren't read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(str(f.getPath()) for f in found if f.getPath().getName() not in set(own))


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_csv(spark: SparkSession, path: str, title: str | None = None, encoding: str = "UTF-8") -> DataFrame | None:
    """One file's rows: its header's columns, extra_columns (surplus fields joined by ' | ', however many) and __source_file.

    None, with a warning, without the file, a header or the title column.  A BOM is stripped; short rows are filled with ''.
    A row with surplus fields comes with its text, and only such rows are split again in Python.
    """
    how = {**CSV, "encoding": encoding}
    if not there(spark, path):
        warnings.warn(f"{path}: not found", stacklevel=2)
        return None
    head = spark.read.options(**how).csv(path).limit(1).collect()
    names = [re.sub("^\ufeff", "", x or "") for x in head[0]] if head else []
    if not any(names) or title is not None and title not in names:
        warnings.warn(f"{path}: no header" if not any(names) else f"{path}: no column {title!r}", stacklevel=2)
        return None
    names = [n if n and n not in names[:k] else f"_c{k}" for k, n in enumerate(names)]
    width = len(names)
    schema = ", ".join(f"`{n}` string" for n in names) + ", __raw string"
    rows = spark.read.schema(schema).options(**how | {"header": True, "enforceSchema": True, "columnNameOfCorruptRecord": "__raw"}).csv(path)

    @F.pandas_udf("string")
    def surplus(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: "" if x is None else " | ".join(next(csv.reader([x], strict=False), [])[width:]))

    more = F.when(F.col("__raw").isNull(), "").otherwise(surplus("__raw"))
    return rows.select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names), more.alias("extra_columns"), F.input_file_name().alias("__source_file"))


def read_all(spark: SparkSession, paths: Sequence[str], title: str | None = None, encoding: str = "UTF-8") -> DataFrame | None:
    """The rows of several files under the ordered union of their columns, each file once; None if none could be read."""
    frames = [f for p in distinct_files(paths) if (f := read_csv(spark, p, title, encoding)) is not None]
    return union_all(frames, title) if frames else None


def read_folder(spark: SparkSession, folder: str, title: str = "title", own: Iterable[str] = ("merged_csvs.csv",)) -> DataFrame | None:
    """All CSV files of a folder that have the title column, which leads; surplus fields are left out, as they have no header."""
    out = read_all(spark, files_of(spark, folder, own=own), title)
    return None if out is None else out.drop("extra_columns")


def union_all(frames: Sequence[DataFrame], first: str | None = None) -> DataFrame:
    """Rows of unlike tables under the ordered union of their columns; absent fields are ''; ``first`` leads."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    columns = [first, *(c for c in out.columns if c != first)] if first else out.columns
    return out.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns))


def aliases(name: str) -> list[str]:
    return [x.strip() for x in ALIASES[name].replace("|", ",").split(",")]


def canonical(rows: DataFrame) -> DataFrame:
    """title, nt (its key), doi (lower case, without the resolver), abstract, kw (all keywords), year, venue, link; rows without a title go."""
    def field(name: str) -> Column:
        found = [F.col(f"`{c}`") for c in aliases(name) if c in rows.columns]
        return pick(*found) if found else F.lit("")

    parts = [pick(F.col(f"`{c}`")) if c in rows.columns else F.lit("") for c in KEYWORDS]
    made = {"title": field("title"), "nt": X.key_screen(field("title")), "doi": X.doi_key(field("doi")), "abstract": field("abstract"), "kw": X.join_kept(*parts)}
    return rows.select(*(c.alias(n) for n, c in (made | {n: field(n) for n in ("year", "venue", "link")}).items())).where("title <> ''")


def with_log_columns(rows: DataFrame) -> DataFrame:
    """Empty columns for a screener: decision, criterion, notes."""
    return rows.withColumns({n: F.lit("") for n in ("decision", "criterion", "notes")})


def with_default_stratum(rows: DataFrame, default: str = "all") -> DataFrame:
    """``stratum``, which is ``default`` where it is absent or null."""
    return rows.withColumn("stratum", F.coalesce(F.col("stratum"), F.lit(default)) if "stratum" in rows.columns else F.lit(default))


def append_by_hand(rows: DataFrame, added: DataFrame, source: str = "added by hand") -> DataFrame:
    """Records that no search found, under the columns of the others, with their own provenance."""
    return union_all([rows, added.withColumn("__source_file", F.lit(source))])


def timing_rows(rows: DataFrame, run: Column, seconds: Column, at: Column, lang: Column, file: Column, command: Column, opt_level: Column, flags: Column) -> DataFrame:
    """TIMING: one row for each run, seconds with six digits and times as ISO-8601 in UTC; absent options are ''."""
    made = (run.cast("int"), X.number(seconds, 6), X.utc_iso(at), lang, file, command, F.coalesce(opt_level, F.lit("")), F.coalesce(flags, F.lit("")))
    return rows.select(*(c.alias(n.split()[0]) for c, n in zip(made, TIMING.split(", "), strict=True)))


def bibtex(texts: DataFrame, text: str = "value", balanced: bool = False) -> DataFrame:
    """fields: a map for each entry of whole files.  A value ends at its first '}' (or, balanced, at its own).

    White space is collapsed, of repeated fields the last counts, type and key of an entry are dropped.
    """
    entries = texts.select(F.explode(F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(r"(?s)(@\w+\{.*?\n\s*\})"), 1)).alias("e"))
    value = r"(?s)(\w+)\s*=\s*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}" if balanced else r"(?s)(\w+)\s*=\s*\{(.*?)\}"
    names, values = F.regexp_extract_all("e", F.lit(value), 1), F.regexp_extract_all("e", F.lit(value), 2)
    pairs = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(F.lower(x["n"]).alias("n"), F.trim(F.regexp_replace(x["v"], r"(?U)\s+", " ")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["n"] == x["n"]))
    return entries.select(F.map_from_entries(last).alias("fields"))


def cache_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """key, value of a JSON object in a text."""
    return texts.select(F.explode(F.from_json(text, "map<string,string>")))


def write_cache(rows: DataFrame, path: str) -> None:
    """key, value as JSON lines, any number of them; ``cache_lines`` reads them."""
    rows.select("key", "value").write.mode("overwrite").json(path)


def cache_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string").json(path)


def cache_text(rows: DataFrame) -> DataFrame:
    """The object again, for a cache that is meant to be one file; ``write_cache`` has no such bound."""
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value"))


def stage_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """date, stage, count of lines 'date,stage,count or sum,notes'; comments and the header go."""
    part = lambda k: F.regexp_extract(text, r"^([^,]*),([^,]*),([^,]*),?(.*)$", k)
    rows = lines.where(~F.col(text).rlike("^(#|date,)") & (F.trim(text) != ""))
    return rows.select(F.to_date(part(1), "d/M/yyyy").alias("date"), F.trim(part(2)).alias("stage"), sum_expression(part(3)).alias("count"), F.trim(part(4)).alias("notes"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, one_file: bool = False) -> None:
    """Columns in order, absent values ''.  One file only for results that fit it."""
    out = rows.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns or rows.columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
