"""Queries over the driver's tables, by name, with their SQL.

Documents stand for records: the first 80 characters are the title, the text is the abstract, doc_id is
the order, and two of three have a doi made of the title key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, judge, keyword, lookup, report, rules, sample, stats
from ..operators.ranks import numbered
from ..scratch import scratch_dir
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RULES = rules.Facets(
    facets={"ART": (r"\bthe\b", r"\bla\b", r"\bder\b", r"\bel\b"), "LINK": (r"\band\b", r"\bet\b", r"\bund\b", r"\by\b"), "PLACE": (r"\bin\b", r"\bdans\b", r"\bim\b", r"\bde\b"), "SIGN": (r"[#$%&]{3}",)},
    strong=(r"\blicen[cs]ed?\b", r"\bbenchmark\b"), off=(r"!!", r"\|"), compounds=((r"\bis\b", r"\bfor\b"), (r"\bque\b", r"\bpar\b")), literal=r"^the and\b", primary="ART",
)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    SQL[name] = text


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def title() -> Column:
    return F.substring("text", 1, 80)


def long(c: Column) -> Column:
    return c.cast("long")


# -- SQL of the pieces that several queries share
def sql_match(text: str, p: str) -> str:
    p = "(^|[^\\pL\\pN_])" + p[2:] if p.startswith(r"\b") else p
    p = p[:-2] + "([^\\pL\\pN_]|$)" if p.endswith(r"\b") else p
    return f"regexp_matches({text}, '{p}')"


def sql_any(text: str, ps) -> str:
    return "(" + " OR ".join(sql_match(text, p) for p in ps) + ")"


NORM = "trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}),'[^\\x00-\\x7F]','','g')),'[^a-z0-9 ]',' ','g'),' +',' ','g'), ' ')"
TRIM = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
WS = "regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')"


def norm(x: str) -> str:
    return NORM.replace("{x}", x)


def trim_(x: str) -> str:
    return TRIM.format(x=x)


RECORDS = f"""SELECT doc_id, substring(text,1,80) AS title, text AS abstract, {norm("substring(text,1,80)")} AS nt,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5({norm("substring(text,1,40)")}) END AS doi FROM documents"""
LONGEST = f"""r AS ({RECORDS}),
g1 AS (SELECT *, CASE WHEN doi <> '' THEN 'd:' || doi WHEN nt = '' THEN 'o:' || doc_id ELSE 't:' || nt END AS g FROM r),
p1 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length(abstract) DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY g) AS place FROM g1),
g2 AS (SELECT * EXCLUDE (g, rn), CASE WHEN nt = '' THEN 'o:' || doc_id ELSE 't:' || nt END AS g FROM p1 WHERE rn = 1),
p2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length(abstract) DESC, place) AS rn2, min(place) OVER (PARTITION BY g) AS place2 FROM g2),
kept AS (SELECT doc_id, title, abstract, nt, doi, place2 AS place FROM p2 WHERE rn2 = 1)"""


def records(spark, d) -> DataFrame:
    nt = X.key_screen(title())
    return t(spark, d, "documents").select("doc_id", title().alias("title"), F.col("text").alias("abstract"), nt.alias("nt"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5(X.key_screen(F.substring("text", 1, 40)))).alias("doi"))


def longest(spark, d) -> DataFrame:
    return dedup.keep_longest(records(spark, d), "doc_id", F.col("doi"), F.col("nt"), F.col("abstract"))


@query
def dedup_keep_longest(spark, d):
    return longest(spark, d).select("doc_id", "title", "doi", "place")


sql("dedup_keep_longest", f"WITH {LONGEST} SELECT doc_id, title, doi, place FROM kept")


def banded(spark, d) -> DataFrame:
    """Bands are taken where a record is read, so what travels with it is short; the abstract is cut after it was banded whole."""
    rows = rules.with_bands(records(spark, d), F.col("title"), F.col("abstract"), RULES).withColumns({"cut": F.substring("abstract", 1, 2000), "has_abstract": F.length("abstract") > 0})
    kept = dedup.keep_longest(rows, "doc_id", F.col("doi"), F.col("nt"), F.col("abstract"), keep=["doc_id", "title", "doi", "cut", "has_abstract", "title_facets", "all_facets", "score", "band", "why"])
    return kept.withColumnRenamed("cut", "abstract")


@query
def band_documents(spark, d):
    return banded(spark, d).select("doc_id", long(F.col("score")).alias("score"), long(F.col("band")).alias("band"), F.array_join("title_facets", "+").alias("facets"), "why")


def sql_bands() -> str:
    names = sorted(RULES.facets)
    ft = {n: sql_any("t", RULES.facets[n]) for n in names}
    fx = {n: f"(x <> '' AND {sql_any('x', RULES.facets[n])})" for n in names}
    n_t = " + ".join(f"CAST(t_{n} AS INT)" for n in names)
    n_a = " + ".join(f"CAST(t_{n} OR x_{n} AS INT)" for n in names)
    strong = " + ".join(f"CAST({sql_match('t', p)} OR {sql_match('x', p)} AS INT)" for p in RULES.strong)
    compound = " OR ".join(f"({sql_match('t', a)} AND {sql_match('t', b)})" for a, b in RULES.compounds)
    labels = {n: "list_filter([" + ", ".join(f"CASE WHEN {sql_match('t', p)} THEN '{X.pattern_label(p)}' END" for p in RULES.facets[n]) + "], lambda q: q IS NOT NULL)" for n in names}
    why = ", ".join([f"CASE WHEN comp THEN 'COMPOUND' END", *(f"CASE WHEN len({labels[n]}) > 0 THEN '{n}:' || array_to_string(({labels[n]})[1:3], ',') END" for n in names),
        "CASE WHEN " + " OR ".join(f"(x_{n} AND NOT t_{n})" for n in names) + " THEN 'abs:' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN x_{n} AND NOT t_{n} THEN '{n}' END" for n in names) + "], lambda q: q IS NOT NULL), '+') END"])
    facets = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN t_{n} THEN '{n}' END" for n in names) + "], lambda q: q IS NOT NULL), '+')"
    return f"""WITH {LONGEST},
low AS (SELECT doc_id, place, title, doi, abstract, lower(title) AS t, lower(abstract) AS x FROM kept),
f AS (SELECT *, {", ".join(f"{ft[n]} AS t_{n}, {fx[n]} AS x_{n}" for n in names)}, {strong} AS strong, {sql_match("t", RULES.literal)} AS lit,
  ({compound}) AND NOT {sql_match("t", RULES.literal)} AS comp, {sql_any("t", ("!!", chr(92) + "|"))} AS off FROM low),
n AS (SELECT *, {n_t} AS nt, {n_a} AS na FROM f),
b AS (SELECT *, off AND nt < 2 AND strong = 0 AND NOT comp AS weak,
  CASE WHEN lit AND nt < 2 THEN 5 WHEN strong > 0 OR comp OR nt >= 2 THEN 1 WHEN na >= 2 AND (t_ART OR nt = 1) THEN 2 WHEN t_ART THEN 3
    WHEN nt = 1 OR {" OR ".join(f"x_{n}" for n in names)} THEN 4 ELSE 5 END AS b0 FROM n),
banded AS (SELECT *, CAST(3*nt + 2*(na-nt) + 4*strong + 3*CAST(comp AS INT) - 3*CAST(weak AS INT) AS BIGINT) AS score,
  CAST(CASE WHEN weak AND NOT t_ART THEN least(b0+1, 5) ELSE b0 END AS BIGINT) AS band, {facets} AS facets,
  coalesce(nullif(array_to_string(list_filter([{why}], lambda q: q IS NOT NULL), '; '), ''), '-') AS why FROM b)"""


sql("band_documents", sql_bands() + " SELECT doc_id, score, band, facets, why FROM banded")


@query
def rank_emit(spark, d):
    """Numbered by band, score and title; the abstract is cut after it was banded whole."""
    rows = banded(spark, d).select("doc_id", long(F.col("band")).alias("band"), "score", F.lower("title").alias("t"), "place", "abstract")
    return numbered(rows, [F.col("band"), F.desc("score"), F.col("t"), F.col("place")], "order").select(long(F.col("order")).alias("order"), "doc_id", "band", "abstract")


sql("rank_emit", sql_bands() + " SELECT row_number() OVER (ORDER BY band, score DESC, lower(title), place) AS \"order\", doc_id, band, substring(abstract,1,2000) AS abstract FROM banded")


@query
def band_groups(spark, d):
    group = F.when(F.col("band") <= 2, "screen").when(F.col("band") == 3, "held").when(F.col("band") == 4, "low").otherwise("excluded")
    return banded(spark, d).groupBy(group.alias("band_group")).agg(F.count("*").alias("n"))


@query
def screening_set(spark, d):
    """The rows a screener gets, of all bands, with empty columns for what the screener decides."""
    plus = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(c), "+"), F.lit("")), F.lit("-"))
    more = F.array_except("all_facets", "title_facets")
    rows = banded(spark, d).select("doc_id", long(F.col("band")).alias("band"), long(F.col("score")).alias("score"), "title", F.when(F.col("has_abstract"), "yes").otherwise("no").alias("has_abstract"), F.substring("abstract", 1, 2000).alias("abstract"), "doi", plus(F.col("title_facets")).alias("facets_title"), plus(more).alias("facets_abstract"), "why")
    return tables.with_log_columns(rows)


sql("screening_set", sql_bands() + f""" SELECT doc_id, band, score, '' AS decision, '' AS criterion, '' AS notes, title, CASE WHEN x <> '' THEN 'yes' ELSE 'no' END AS has_abstract, substring(abstract,1,2000) AS abstract, doi,
  coalesce(nullif(facets, ''), '-') AS facets_title,
  coalesce(nullif(array_to_string(list_filter([{", ".join(f"CASE WHEN x_{n} AND NOT t_{n} THEN '{n}' END" for n in sorted(RULES.facets))}], lambda q: q IS NOT NULL), '+'), ''), '-') AS facets_abstract, why FROM banded""")

sql("band_groups", sql_bands() + " SELECT CASE WHEN band <= 2 THEN 'screen' WHEN band = 3 THEN 'held' WHEN band = 4 THEN 'low' ELSE 'excluded' END AS band_group, count(*) AS n FROM banded GROUP BY 1")


@query
def facet_setops(spark, d):
    found = t(spark, d, "documents").select("doc_id", rules.facet_names(F.lower(title()), RULES).alias("x"), rules.facet_names(F.lower("text"), RULES).alias("y"))
    either = F.array_union("x", "y")
    return found.select("doc_id", F.array_join(F.array_sort(either), "+").alias("either"), F.array_join(F.array_sort(F.array_except("y", "x")), "+").alias("only_ext"), long(F.size(either)).alias("n"))


def _facet_sql() -> str:
    names = sorted(RULES.facets)
    pick = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {c(n)} THEN '{n}' END" for n in names) + "], lambda q: q IS NOT NULL)"
    a, b = (lambda n: sql_any("lower(substring(text,1,80))", RULES.facets[n])), (lambda n: sql_any("lower(text)", RULES.facets[n]))
    either, only = pick(lambda n: f"({a(n)} OR {b(n)})"), pick(lambda n: f"({b(n)} AND NOT {a(n)})")
    return f"SELECT doc_id, array_to_string({either}, '+') AS either, array_to_string({only}, '+') AS only_ext, CAST(len({either}) AS BIGINT) AS n FROM documents"


sql("facet_setops", _facet_sql())


@query
def norm_keys(spark, d):
    return X.keys(t(spark, d, "documents"), F.col("text"), "doc_id")


sql("norm_keys", f"""SELECT doc_id, {norm("text")} AS screen, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS pack,
  lower(regexp_replace({WS.format(x=trim_("text"))}, '\\.$', '')) AS filter, {WS.format(x=f"lower({trim_('text')})")} AS exclude, lower({trim_("text")}) AS joined,
  'title:' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS cache FROM documents""")


@query
def title_keys_pages(spark, d):
    return t(spark, d, "pages").select("page_id", X.key_title(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("key"))


def _unescape(x: str) -> str:
    """The references that the pages hold; HTML takes these old ones without a semicolon too."""
    for a, b in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{a};?', '{b}', 'g')"
    return x


sql("title_keys_pages", f"SELECT page_id, {norm(_unescape(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>([^<]*)' + chr(39) + ', 1)'))} AS key FROM pages")


@query
def markup_strip(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


sql("markup_strip", f"SELECT page_id, {trim_(WS.format(x='regexp_replace(html, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')'))} AS text FROM pages")


def _keep(last: bool):
    def run(spark, d):
        df = dedup.keep_one(t(spark, d, "part"), "p_partkey", X.key_filter(F.col("p_name")), "p_name", "p_brand", last)
        return df.where("kept").select("p_partkey", "p_name", "duplicate_count", "sources", "group_order")

    return run


for _name, _last in (("dedup_keep_first", False), ("dedup_keep_last", True)):
    QUERIES[_name] = _keep(_last)
    sql(_name, f"""WITH g AS (SELECT *, lower(trim(p_name)) AS k, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey {"DESC" if _last else ""}) AS rn FROM part),
b AS (SELECT k, p_brand, min(p_partkey) AS o FROM g GROUP BY 1, 2), s AS (SELECT k, string_agg(p_brand, ' | ' ORDER BY o) AS sources FROM b GROUP BY k),
n AS (SELECT k, count(*) AS duplicate_count, min(p_partkey) AS group_order FROM g GROUP BY k)
SELECT p_partkey, p_name, duplicate_count, sources, group_order FROM g JOIN s USING (k) JOIN n USING (k) WHERE rn = 1""")


@query
def dedup_removed(spark, d):
    df = dedup.keep_one(t(spark, d, "part"), "p_partkey", X.key_filter(F.col("p_name")), "p_name")
    return df.where("not kept").select("p_partkey", "duplicate_of_title")


sql("dedup_removed", "SELECT p_partkey, first_value(p_name) OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS duplicate_of_title FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) > 1")


@query
def duplicate_groups(spark, d):
    return dedup.grouped(t(spark, d, "part"), "p_partkey", X.key_filter(F.col("p_name")), "p_brand")


sql("duplicate_groups", """WITH b AS (SELECT lower(trim(p_name)) AS key, p_brand, min(p_partkey) AS o, count(*) AS n FROM part GROUP BY 1, 2)
SELECT key, min(o) AS first_order, CAST(sum(n) AS BIGINT) AS duplicate_count, string_agg(p_brand, ' | ' ORDER BY o) AS sources FROM b GROUP BY key""")

WORDS = ['"the and" OR license', "idiot AND (moron OR clown)"]


def _decided(whole: bool):
    def run(spark, d):
        c = keyword.decision(title(), F.col("text"), WORDS, ["token"], ["Les."], whole)
        return t(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.keep", "c.reason")

    return run


def _term(w: str, whole: bool) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" if whole else f"contains(lower(text), '{w}')"


for _name, _whole in (("keyword_filter_decision", False), ("keyword_filter_whole_word", True)):
    QUERIES[_name] = _decided(_whole)
    _hit = f"({_term('the and', _whole)} OR {_term('license', _whole)} OR ({_term('idiot', _whole)} AND ({_term('moron', _whole)} OR {_term('clown', _whole)})))"
    sql(_name, f"""SELECT doc_id, CASE WHEN listed THEN true WHEN bad THEN false ELSE hit END AS keep,
  CASE WHEN listed THEN 'include-papers override' WHEN bad THEN 'matched exclude-keywords' WHEN hit THEN 'kept (matched keywords or no keyword filter set)' ELSE 'did not match keywords' END AS reason
  FROM (SELECT doc_id, lower({trim_("substring(text,1,80)")}) = 'les.' AS listed, {_term("token", _whole)} AS bad, {_hit} AS hit FROM documents)""")


@query
def must_keep_semi(spark, d):
    return lookup.only_listed(t(spark, d, "documents"), F.col("doc_id"), t(spark, d, "labels").where("quality = 1"), F.col("doc_id")).select("doc_id", "source")


sql("must_keep_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")


@query
def exclude_anti(spark, d):
    """Documents whose text, as a whole, isn't one of the benchmark's."""
    return lookup.exclude_listed(t(spark, d, "documents"), X.key_exclude(F.col("text")), t(spark, d, "benchmark"), X.key_exclude(F.col("text"))).select("doc_id", "lang")


_k = WS.format(x=f"lower({trim_('text')})")
sql("exclude_anti", f"SELECT doc_id, lang FROM documents WHERE coalesce({_k}, '') = '' OR {_k} NOT IN (SELECT {_k} FROM benchmark WHERE text IS NOT NULL)")


@query
def abstract_backfill(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("abstract"))
    cache = t(spark, d, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    more = t(spark, d, "benchmark").select(F.concat(F.lit("title:"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("value"))
    keys = [F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.concat(F.lit("title:"), F.col("doc_id").cast("string"))]
    return lookup.backfill(docs, "abstract", cache.unionByName(more), keys)


sql("abstract_backfill", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS abstract FROM documents)
SELECT r.doc_id, coalesce(nullif(CASE WHEN trim(abstract) <> '' THEN abstract END, ''), 'q' || l.quality, b.text, '') AS abstract,
  trim(abstract) = '' AND coalesce('q' || l.quality, b.text) IS NOT NULL AS filled
FROM r LEFT JOIN labels l ON l.doc_id = r.doc_id LEFT JOIN benchmark b ON b.item_id = r.doc_id""")


@query
def first_wins_index(spark, d):
    return dedup.first_index(t(spark, d, "conversations"), "turn", F.col("conv_id"), F.col("text"), "first_text")


sql("first_wins_index", "SELECT conv_id AS key, arg_min(text, turn) AS first_text FROM conversations WHERE text <> '' GROUP BY conv_id")


@query
def last_wins_index(spark, d):
    return dedup.first_index(t(spark, d, "conversations"), "turn", F.col("conv_id"), F.col("text"), "last_text", last=True)


sql("last_wins_index", "SELECT conv_id AS key, arg_max(text, turn) AS last_text FROM conversations WHERE text <> '' GROUP BY conv_id")


@query
def keyword_parts(spark, d):
    """Distinct parts that aren't blank, joined and cut."""
    return t(spark, d, "documents").select("doc_id", X.join_distinct(F.col("lang"), F.col("source"), F.col("lang"), F.lit(""), limit=6).alias("keywords"), X.join_kept(F.col("lang"), F.lit(""), F.col("source")).alias("kept"), X.pick(F.lit(" "), F.col("source")).alias("picked"))


sql("keyword_parts", "SELECT doc_id, substring(lang || '; ' || source, 1, 6) AS keywords, lang || '  ' || source AS kept, source AS picked FROM documents")


@query
def keyword_reattach(spark, d):
    """Keywords of the first record of a title that has some, joined to all records of the title; every third record has none of its own."""
    rows = t(spark, d, "documents").select("doc_id", X.key_join(title()).alias("k"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("").alias("a"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(" ").alias("b"))
    index = dedup.first_index(rows.where("k <> ''"), "doc_id", F.col("k"), X.join_distinct(F.col("a"), F.col("b")), "keywords")
    return lookup.side_value(rows, F.col("k"), index, "keywords").select("doc_id", "keywords")


_T = f"lower({trim_('substring(text,1,80)')})"
sql("keyword_reattach", f"""WITH r AS (SELECT doc_id, {_T} AS k, CASE WHEN doc_id % 3 <> 0 THEN lang || '; ' || source END AS kw FROM documents),
i AS (SELECT k, arg_min(kw, doc_id) AS kw FROM r WHERE kw IS NOT NULL AND k <> '' GROUP BY k)
SELECT r.doc_id, coalesce(i.kw, '') AS keywords FROM r LEFT JOIN i ON r.k = i.k""")


@query
def abstract_side_table(spark, d):
    """Documents with the last text of the conversation of their number, or ''."""
    index = dedup.first_index(t(spark, d, "conversations"), "turn", F.col("conv_id"), F.col("text"), "said", last=True)
    return lookup.side_value(t(spark, d, "documents").select("doc_id"), F.col("doc_id"), index, "said").select("doc_id", "said")


sql("abstract_side_table", "SELECT doc_id, coalesce(said, '') AS said FROM documents LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS said FROM conversations WHERE text <> '' GROUP BY conv_id) ON conv_id = doc_id")


@query
def rounds_alignment(spark, d):
    c = t(spark, d, "conversations")
    rounds = [c.where(F.col("turn") == k).select(F.col("conv_id").alias("doc_id"), F.col("text").alias(f"r{k}")) for k in (0, 2, 4)]
    df = t(spark, d, "documents").select("doc_id", "source")
    for r in rounds:
        df = df.join(r, "doc_id", "left")
    final = t(spark, d, "labels").where("quality = 1")
    df = lookup.flag_listed(df, F.col("doc_id"), final, F.col("doc_id"), "final")
    n = F.size(F.array_compact(F.array("r0", "r2", "r4")))
    return df.select("doc_id", F.coalesce(lookup.later_stands(F.col("r0"), F.col("r2"), F.col("r4")), F.lit("")).alias("stands"), long(n).alias("rounds"), F.when(F.col("final"), "include").otherwise("exclude").alias("decision"))


sql("rounds_alignment", """SELECT d.doc_id, coalesce(c.text, b.text, a.text, '') AS stands,
  CAST((a.text IS NOT NULL)::INT + (b.text IS NOT NULL)::INT + (c.text IS NOT NULL)::INT AS BIGINT) AS rounds,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'include' ELSE 'exclude' END AS decision
FROM documents d LEFT JOIN conversations a ON a.conv_id = d.doc_id AND a.turn = 0 LEFT JOIN conversations b ON b.conv_id = d.doc_id AND b.turn = 2 LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 4""")


PATTERNS = ("^r", "red", "ing$", "o.*o", "zzz", "bolt", "red bolt|ring", "^r.*g$")


@query
def pattern_first_hit(spark, d):
    """Each pattern's first part that no pattern before it has taken, dearest first."""
    return lookup.first_hits(t(spark, d, "part"), "p_name", [F.desc("p_retailprice"), F.col("p_partkey")], PATTERNS, "p_partkey")


def _hits_sql() -> str:
    steps = []
    for k, p in enumerate(PATTERNS):
        taken = " AND ".join(f"p_partkey NOT IN (SELECT p_partkey FROM h{j})" for j in range(k))
        steps.append(f"h{k} AS (SELECT '{p}' AS pattern, p_partkey FROM part WHERE regexp_matches(p_name, '{p}')" + (f" AND {taken}" if taken else "") + " ORDER BY p_retailprice DESC, p_partkey LIMIT 1)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(len(PATTERNS)))


sql("pattern_first_hit", _hits_sql())


@query
def fallback_lookup(spark, d):
    missing = t(spark, d, "documents").select("doc_id")
    lab = t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    ben = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("value"))
    return lookup.fallback_chain(missing, "doc_id", [lambda m: m.join(lab, "doc_id"), lambda m: m.join(ben, "doc_id")])


sql("fallback_lookup", """SELECT d.doc_id, coalesce('q' || l.quality, b.text) AS value, CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END AS stage
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE coalesce('q' || l.quality, b.text, '') <> ''""")



@query
def accepted_abstracts(spark, d):
    """Found texts: those of the first stage as they are, those of the second only above 80 characters."""
    missing = t(spark, d, "documents").select("doc_id")
    one = t(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("value"))
    two = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.substring("text", 1, F.lit(60) + F.col("item_id")).alias("value"))
    short = one.where("doc_id % 2 = 0")
    return lookup.fallback_chain(missing, "doc_id", [lambda m: m.join(short, "doc_id"), lambda m: m.join(two, "doc_id")], least=[0, 80])


sql("accepted_abstracts", """WITH a AS (SELECT d.doc_id, c.text AS value, 0 AS stage FROM documents d JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0 AND d.doc_id % 2 = 0 WHERE c.text <> '')
SELECT * FROM a UNION ALL SELECT d.doc_id, substring(b.text, 1, 60 + b.item_id), 1 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM a) AND length(substring(b.text, 1, 60 + b.item_id)) > 80""")


@query
def wanted_dois(spark, d):
    """Distinct DOIs of records without an abstract that no cache has."""
    r = records(spark, d).select(F.concat(F.lit(" "), F.upper("doi")).alias("doi"), F.when(F.col("doc_id") % 2 == 0, F.col("abstract")).otherwise(" ").alias("abstract"))
    cache = records(spark, d).where("doc_id % 5 = 0").select(F.col("doi").alias("key"), F.lit("known").alias("value"))
    return lookup.wanted(r, F.col("doi"), F.col("abstract"), cache)


sql("wanted_dois", f"WITH r AS ({RECORDS}) SELECT DISTINCT doi FROM r WHERE doi <> '' AND (doc_id % 2 <> 0 OR trim(abstract) = '') AND doi NOT IN (SELECT doi FROM r WHERE doc_id % 5 = 0) ORDER BY doi")


@query
def cache_merge(spark, d):
    """A cache of labelled documents, merged with finds for all documents."""
    lab = t(spark, d, "labels").where("quality is not null").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    found = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("value"))
    return lookup.merged_cache(lab, found)


sql("cache_merge", "SELECT CAST(doc_id AS VARCHAR) AS key, 'q' || quality AS value FROM labels WHERE quality IS NOT NULL UNION ALL SELECT CAST(doc_id AS VARCHAR), min(source) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) GROUP BY 1")


@query
def url_queries(spark, d):
    """Addresses as parts of other addresses."""
    return t(spark, d, "pages").select("page_id", X.url_quoted(F.col("url")).alias("quoted"), X.url_quoted(F.col("url"), "|").alias("strict"))


sql("url_queries", "SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted, replace(url_encode(url), '%7C', '|') AS strict FROM pages")

HIGH, TIMING, LANGUAGES = (r"\bthe\b", r"\bque\b"), (r"\bwas\b", r"\bsich\b"), (r"\band\b", r"\bund\b")


def with_relevance(spark, d) -> DataFrame:
    lab = t(spark, d, "labels").select("doc_id", "quality")
    return t(spark, d, "documents").join(lab, "doc_id", "left").select("doc_id", title().alias("title"), F.col("text"), (F.col("n_chars") % 6).alias("relevance"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))


@query
def borderline_select(spark, d):
    chosen = with_relevance(spark, d).where(rules.borderline(F.col("title"), F.col("decision"), F.col("relevance"), HIGH, TIMING, LANGUAGES))
    return lookup.exclude_listed(chosen, F.col("doc_id").cast("string"), t(spark, d, "labels").where("toxic = 1"), F.col("doc_id").cast("string")).select("doc_id", "relevance", "decision")


_REL = "SELECT d.doc_id, lower(substring(d.text,1,80)) AS t, substring(d.text,1,80) AS title, d.n_chars % 6 AS relevance, CASE WHEN l.quality = 1 THEN 'include' ELSE 'exclude' END AS decision, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
sql("borderline_select", f"SELECT doc_id, relevance, decision FROM ({_REL}) WHERE ((relevance IN (2,3) AND {sql_any('t', HIGH)}) OR (decision <> 'include' AND {sql_any('t', TIMING)} AND {sql_any('t', LANGUAGES)})) AND coalesce(toxic, 0) <> 1")


@query
def borderline_ranked(spark, d):
    """Borderline records, most relevant first, in the order of their titles' code points."""
    rows = with_relevance(spark, d).where(rules.borderline(F.concat_ws(" ", "title", "text"), F.col("decision"), F.col("relevance"), HIGH, TIMING, LANGUAGES)).select("doc_id", "relevance", "title")
    return numbered(rows, [F.desc("relevance"), F.col("title"), F.col("doc_id")], "place").select("doc_id", "relevance", long(F.col("place")).alias("place"))


_WHOLE = _REL.replace("SELECT d.doc_id,", "SELECT d.doc_id, lower(substring(d.text,1,80) || ' ' || d.text) AS whole,")
sql("borderline_ranked", f"SELECT doc_id, relevance, row_number() OVER (ORDER BY relevance DESC, title, doc_id) AS place FROM ({_WHOLE}) WHERE (relevance IN (2,3) AND {sql_any('whole', HIGH)}) OR (decision <> 'include' AND {sql_any('whole', TIMING)} AND {sql_any('whole', LANGUAGES)})")


@query
def included_ranked(spark, d):
    """Included records by relevance and title."""
    rows = with_relevance(spark, d).where("decision = 'include'").select("doc_id", "relevance", F.lower("title").alias("t"))
    return numbered(rows, [F.desc("relevance"), F.col("t"), F.col("doc_id")], "place").select("doc_id", "relevance", long(F.col("place")).alias("place"))


sql("included_ranked", f"SELECT doc_id, relevance, row_number() OVER (ORDER BY relevance DESC, lower(title), doc_id) AS place FROM ({_REL}) WHERE decision = 'include'")


@query
def score_terciles(spark, d):
    return sample.terciles(t(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", long(F.col("tercile")).alias("tercile"))


sql("score_terciles", "SELECT doc_id, CAST(CASE WHEN rn - 1 < n // 3 THEN 0 WHEN rn - 1 < 2 * (n // 3) THEN 1 ELSE 2 END AS BIGINT) AS tercile FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER () AS n FROM documents)")


@query
def verification_sample(spark, d):
    return sample.equal_allocation(with_relevance(spark, d), "doc_id", "decision", 30).select("doc_id", "decision", long(F.col("draw")).alias("draw"))


sql("verification_sample", f"SELECT doc_id, decision, row_number() OVER (PARTITION BY decision ORDER BY md5('20261016:' || doc_id), doc_id) AS draw FROM ({_REL}) QUALIFY draw <= 30")


@query
def stratified_sample(spark, d):
    """Known items first, then thirds of the order, records of high risk, short ones, and others up to the total."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("risk")), "doc_id", "left").select("doc_id", "n_chars", "risk", title().alias("title"))
    rows = sample.terciles(docs, [F.desc("n_chars"), F.col("doc_id")])
    known = [r.doc_id for r in lookup.first_hits(rows, "title", [F.desc("n_chars"), F.col("doc_id")], KNOWN, "doc_id").collect()]
    return sample.stratified(rows, "doc_id", [("top", F.col("tercile") == 0, 20), ("middle", F.col("tercile") == 1, 20), ("bottom", F.col("tercile") == 2, 20), ("high_risk", F.col("risk"), 15), ("short", F.col("n_chars") < 800, 10)], 90, known=known)


KNOWN = ("^The ", "^Der ", "zzz", "^The th")


def _stratified_sql() -> str:
    known = []
    for k, p in enumerate(KNOWN):
        taken = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM k{j})" for j in range(k))
        known.append(f"k{k} AS (SELECT doc_id, 'known item' AS stratum FROM r WHERE regexp_matches(title, '{p}'){taken} ORDER BY n_chars DESC, doc_id LIMIT 1)")
    steps, before = [], [f"k{k}" for k in range(len(KNOWN))]
    for name, condition, size in (("top", "tercile = 0", 20), ("middle", "tercile = 1", 20), ("bottom", "tercile = 2", 20), ("high_risk", "risk", 15), ("short", "n_chars < 800", 10)):
        steps.append(f"s_{name} AS (SELECT doc_id, '{name}' AS stratum FROM r WHERE {condition}" + "".join(f" AND doc_id NOT IN (SELECT doc_id FROM {b})" for b in before) + f" ORDER BY h, doc_id LIMIT {size})")
        before.append(f"s_{name}")
    every = " UNION ALL ".join(f"SELECT * FROM {b}" for b in before)
    return f"""WITH r AS (SELECT doc_id, n_chars, title, risk, md5('20261016:' || doc_id) AS h, CASE WHEN rn - 1 < n // 3 THEN 0 WHEN rn - 1 < 2 * (n // 3) THEN 1 ELSE 2 END AS tercile
  FROM (SELECT doc_id, n_chars, substring(text,1,80) AS title, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS risk, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER () AS n FROM documents)),
{", ".join(known + steps)}, chosen AS ({every}),
more AS (SELECT doc_id, 'top-up' AS stratum FROM r WHERE doc_id NOT IN (SELECT doc_id FROM chosen) ORDER BY h, doc_id LIMIT (SELECT 90 - count(*) FROM chosen))
SELECT * FROM chosen UNION ALL SELECT * FROM more"""


sql("stratified_sample", _stratified_sql())


@query
def filter_routes(spark, d):
    """Titles filtered by keywords and deduplicated on both sides: where each record goes, why, and for whom it stands."""
    parts = t(spark, d, "part").select("p_partkey", "p_name")
    c = keyword.decision(F.col("p_name"), F.col("p_name"), ["red AND (bolt OR ring)", "old"], ["anvil"], ["hot gear"], True)
    rows = dedup.routed(parts, "p_partkey", "p_name", X.key_filter(F.col("p_name")), c["keep"], c["reason"])
    return rows.select("p_partkey", "route", F.col("__filter_reason").alias("reason"), F.coalesce("__duplicate_count", F.lit(0)).alias("duplicates"), F.coalesce("__duplicate_of_title", F.lit("")).alias("of_title"))


sql("filter_routes", """WITH f AS (SELECT p_partkey, p_name, CASE WHEN lower(trim(p_name)) = 'hot gear' THEN 1 WHEN regexp_matches(p_name, '(^|[^a-z0-9])anvil([^a-z0-9]|$)') THEN 2
  WHEN regexp_matches(p_name, '(^|[^a-z0-9])old([^a-z0-9]|$)') OR (regexp_matches(p_name, '(^|[^a-z0-9])red([^a-z0-9]|$)') AND regexp_matches(p_name, '(^|[^a-z0-9])(bolt|ring)([^a-z0-9]|$)')) THEN 3 ELSE 4 END AS c FROM part),
g AS (SELECT *, c IN (1, 3) AS keep, lower(trim(p_name)) AS k FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY keep, k ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY keep, k) AS n, first_value(p_name) OVER (PARTITION BY keep, k ORDER BY p_partkey) AS first FROM g)
SELECT p_partkey, CASE WHEN rn > 1 THEN 'duplicates' WHEN keep THEN 'included' ELSE 'excluded' END AS route,
  CASE c WHEN 1 THEN 'include-papers override' WHEN 2 THEN 'matched exclude-keywords' WHEN 3 THEN 'kept (matched keywords or no keyword filter set)' ELSE 'did not match keywords' END AS reason,
  CASE WHEN rn = 1 THEN n ELSE 0 END AS duplicates, CASE WHEN rn > 1 THEN first ELSE '' END AS of_title FROM w""")


@query
def decision_counts(spark, d):
    return with_relevance(spark, d).groupBy("decision").agg(F.count("*").alias("n"), F.sum("relevance").alias("tokens"), F.count_if(F.col("relevance") == 0).alias("failures"))


sql("decision_counts", f"SELECT decision, count(*) AS n, CAST(sum(relevance) AS BIGINT) AS tokens, count(*) FILTER (relevance = 0) AS failures FROM ({_REL}) GROUP BY decision")


@query
def relevance_hist(spark, d):
    return with_relevance(spark, d).where("decision = 'include'").groupBy("relevance").agg(F.count("*").alias("n")).orderBy(F.desc("relevance"))


sql("relevance_hist", f"SELECT relevance, count(*) AS n FROM ({_REL}) WHERE decision = 'include' GROUP BY relevance ORDER BY relevance DESC")


@query
def coverage_ratio(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").agg(F.round(stats.coverage(F.col("quality").isNotNull()), 9).alias("coverage"), F.count_if(F.col("quality").isNull()).alias("without"))


sql("coverage_ratio", "SELECT round(avg((l.quality IS NOT NULL)::INT), 9) AS coverage, count(*) FILTER (l.quality IS NULL) AS without FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


@query
def run_counters(spark, d):
    return report.counters(t(spark, d, "documents"), F.col("n_chars") < 1000)


sql("run_counters", "SELECT count(*) AS total, count(*) FILTER (n_chars < 1000) AS excluded, count(*) FILTER (n_chars >= 1000) AS remaining FROM documents")


@query
def kappa_labels(spark, d):
    k = stats.kappa(stats.confusion(t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0))
    return k.select("yy", "yn", "ny", "nn", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa", "se", "low", "high")), "band")


sql("kappa_labels", """WITH c AS (SELECT count(*) FILTER (quality=1 AND toxic=0) AS yy, count(*) FILTER (quality=1 AND toxic<>0) AS yn, count(*) FILTER (quality<>1 AND toxic=0) AS ny, count(*) FILTER (quality<>1 AND toxic<>0) AS nn FROM labels),
p AS (SELECT *, yy+yn+ny+nn AS n, (yy+nn)::DOUBLE/(yy+yn+ny+nn) AS po, ((yy+yn)*(yy+ny) + (ny+nn)*(yn+nn))::DOUBLE/((yy+yn+ny+nn)::DOUBLE*(yy+yn+ny+nn)) AS pe FROM c),
k AS (SELECT *, (po-pe)/(1-pe) AS kappa, CASE WHEN po IN (0,1) THEN 0 ELSE sqrt(po*(1-po)/(n*(1-pe)*(1-pe))) END AS se FROM p)
SELECT yy, yn, ny, nn, round(po,6) AS po, round(pe,6) AS pe, round(kappa,6) AS kappa, round(se,6) AS se, round(greatest(-1, kappa-1.96*se),6) AS low, round(least(1, kappa+1.96*se),6) AS high,
CASE WHEN kappa<0.2 THEN 'poor' WHEN kappa<0.4 THEN 'fair' WHEN kappa<0.6 THEN 'moderate' WHEN kappa<0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")


_VERIFIED = "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'include' ELSE 'exclude' END AS decision, CASE l.toxic WHEN 1 THEN ' Yes' WHEN 0 THEN '' END AS disagree FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


def verified(spark, d) -> DataFrame:
    """Decisions with a reviewer's mark where the reviewer disagreed."""
    lab = t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), F.when(F.col("toxic") == 1, " Yes").when(F.col("toxic") == 0, "").alias("disagree"))
    return t(spark, d, "documents").select("doc_id").join(lab, "doc_id")


@query
def disagreement_counts(spark, d):
    return stats.disagreements(verified(spark, d), "decision", X.truthy(F.col("disagree")))


sql("disagreement_counts", f"SELECT decision, count(*) AS n FROM ({_VERIFIED}) WHERE lower(trim(coalesce(disagree, ''))) IN ('d', 'y', 'yes', 'x', '1', 'true', 'disagree', 'disagreed') GROUP BY decision")


@query
def kappa_disagreements(spark, d):
    """Agreement from a column of disagreements."""
    k = stats.kappa(stats.from_disagreements(verified(spark, d), F.col("decision"), X.truthy(F.col("disagree"))))
    return k.select("yy", "yn", "ny", "nn", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")))


sql("kappa_disagreements", f"""WITH v AS (SELECT decision = 'include' AS a, lower(trim(coalesce(disagree, ''))) = 'yes' AS dis FROM ({_VERIFIED})),
c AS (SELECT count(*) FILTER (a AND NOT dis) AS yy, count(*) FILTER (a AND dis) AS yn, count(*) FILTER (NOT a AND dis) AS ny, count(*) FILTER (NOT a AND NOT dis) AS nn FROM v),
p AS (SELECT *, (yy+nn)::DOUBLE/(yy+yn+ny+nn) AS po, ((yy+yn)*(yy+ny) + (ny+nn)*(yn+nn))::DOUBLE/((yy+yn+ny+nn)::DOUBLE*(yy+yn+ny+nn)) AS pe FROM c)
SELECT yy, yn, ny, nn, round(po,6) AS po, round(pe,6) AS pe, round((po-pe)/(1-pe),6) AS kappa FROM p""")


def _rounded(df: DataFrame, by: str) -> DataFrame:
    return df.select(by, "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "low", "high", "deviation")))


def _summary_sql(by: str, v: str, table: str) -> str:
    return f"SELECT {by}, count({v}) AS n, round(avg({v}),4) AS mean, round(median({v}),4) AS median, round(min({v}),4) AS low, round(max({v}),4) AS high, round(stddev_samp({v}),4) AS deviation FROM {table} GROUP BY {by}"


@query
def summary_stats(spark, d):
    return _rounded(stats.summary(t(spark, d, "lineitem"), "l_returnflag", F.col("l_extendedprice")), "l_returnflag")


sql("summary_stats", _summary_sql("l_returnflag", "l_extendedprice", "lineitem"))


@query
def event_stats(spark, d):
    return _rounded(stats.summary(t(spark, d, "events"), "event_type", F.col("value")), "event_type")


sql("event_stats", _summary_sql("event_type", "value", "events"))


@query
def trend_line(spark, d):
    return stats.trend(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(*(F.round(c, 4).alias(c) for c in ("slope", "intercept", "most")))


sql("trend_line", "SELECT round(regr_slope(l_extendedprice,l_quantity),4) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(max(l_quantity),4) AS most FROM lineitem")


@query
def trend_points(spark, d):
    return stats.trend_points(stats.trend(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity")).select("i", F.round("x", 6).alias("x"), F.round("y", 2).alias("y"))


sql("trend_points", "SELECT CAST(i AS INT) AS i, round(i * m / 199, 6) AS x, round(s * i * m / 199 + b, 2) AS y FROM (SELECT regr_slope(l_extendedprice,l_quantity) AS s, regr_intercept(l_extendedprice,l_quantity) AS b, max(l_quantity) AS m FROM lineitem), range(200) r(i)")


@query
def range_sums(spark, d):
    return stats.range_sums(spark, 1_000_000_000)


sql("range_sums", "SELECT CAST(sum(i) AS BIGINT) AS total, CAST(sum(i + [1,2,4,9,8,4,5][i % 7 + 1]) AS BIGINT) AS pooled, count(*) AS counted, 1000000000::DOUBLE * 999999999 / 2 AS closed FROM range(1000000000) r(i)")


@query
def inverted_index(spark, d):
    words = t(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    return words.groupBy("item_id", "w").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("places"))


sql("inverted_index", "SELECT item_id, w, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS places FROM (SELECT item_id, unnest(string_split(text,' ')) AS w, generate_subscripts(string_split(text,' '),1) - 1 AS p FROM benchmark) GROUP BY 1, 2")


@query
def inverted_to_text(spark, d):
    words = t(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("p"))
    return words.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("m")).select("item_id", X.index_to_text(F.col("m")).alias("text"))


sql("inverted_to_text", "SELECT item_id, text FROM benchmark")


@query
def schema_union(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("stratum"))
    b = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return tables.union_all([tables.with_default_stratum(f) for f in (a, b)], "name")


sql("schema_union", "SELECT name, segment, nation, stratum FROM (SELECT c_name AS name, c_mktsegment AS segment, '' AS nation, coalesce(nullif(c_mktsegment, 'BUILDING'), 'all') AS stratum FROM customer UNION ALL SELECT s_name, '', CAST(s_nationkey AS VARCHAR), 'all' FROM supplier)")


@query
def hand_added(spark, d):
    """Suppliers and two that no search found."""
    found = t(spark, d, "supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("year"), F.lit("search").alias("__source_file"))
    return tables.append_by_hand(found, spark.createDataFrame([("Known A", "x"), ("Known B", "y")], "title string, doi string"))


sql("hand_added", "SELECT s_name AS title, CAST(s_nationkey AS VARCHAR) AS year, 'search' AS __source_file, '' AS doi FROM supplier UNION ALL SELECT * FROM (VALUES ('Known A', '', 'added by hand', 'x'), ('Known B', '', 'added by hand', 'y'))")


@query
def timing_rows(spark, d):
    """Events as rows of timed runs."""
    c = F.col
    return tables.timing_rows(t(spark, d, "events"), c("event_id"), c("value"), c("ts"), F.lit("python"), c("event_type"), F.concat(F.lit("python "), c("event_type")), F.lit(None).cast("string"), F.lit(""))


sql("timing_rows", "SELECT CAST(event_id AS INTEGER) AS run, printf('%.6f', value) AS elapsed_seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_utc, 'python' AS lang, event_type AS file, 'python ' || event_type AS command, '' AS opt_level, '' AS rustc_flags FROM events")


@query
def number_forms(spark, d):
    """Sums as people read them: digits in groups, a share, an exponent."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("s")).select("l_returnflag", X.grouped_number(F.col("n") * 1000).alias("grouped"), X.percent(F.col("s")).alias("share"), X.exponent(F.lit(1000000)).alias("power"))


sql("number_forms", "SELECT l_returnflag, format('{:,}', count(*) * 1000) AS grouped, printf('%.0f', avg((l_quantity > 25)::INT) * 100) || '%' AS share, printf('%.0E', 1000000.0) AS power FROM lineitem GROUP BY l_returnflag")


@query
def csv_ragged(spark, d):
    """A file with a byte order mark, quotes, line breaks, short rows and rows with more fields than headers."""
    path = scratch_dir(spark)
    spark.createDataFrame([(x,) for x in RAGGED], "value string").coalesce(1).write.text(path)
    return tables.read_csv(spark, path, "title").drop("__source_file")


RAGGED = ("\ufefftitle,venue", '"A, ""q""",V', "B,W,2,3,4,5,6,7,8", "C", '"multi', 'line",X,"s, t"')
sql("csv_ragged", "SELECT * FROM (VALUES ('A, \"q\"', 'V', ''), ('B', 'W', '2 | 3 | 4 | 5 | 6 | 7 | 8'), ('C', '', ''), ('multi' || chr(10) || 'line', 'X', 's, t')) v(title, venue, extra_columns)")


@query
def json_judgement(spark, d):
    n = F.get_json_object("props", "$.k").cast("int")
    reply = F.concat(F.lit('Result: {"decision": "'), F.when(n % 3 == 0, "include").when(n % 3 == 1, "maybe").otherwise("exclude"), F.lit('", "criterion": "I1", "relevance": "'), (n % 6).cast("string"), F.lit('", "evidence": "e", "reason": "r"} end'))
    j = X.judgement(reply)
    return t(spark, d, "events").select("event_id", j.alias("j")).select("event_id", F.coalesce("j.decision", F.lit("uncertain")).alias("decision"), long(F.coalesce("j.relevance", F.lit(-1))).alias("relevance"), X.consistent(F.col("j.decision"), F.col("j.relevance")).alias("consistent"))


sql("json_judgement", """SELECT event_id, CASE WHEN n % 3 = 0 THEN 'include' WHEN n % 3 = 1 THEN 'uncertain' ELSE 'exclude' END AS decision, CAST(CASE WHEN n % 3 = 1 THEN -1 ELSE n % 6 END AS BIGINT) AS relevance,
CASE WHEN n % 3 = 1 THEN true WHEN n % 6 >= 4 THEN n % 3 = 0 WHEN n % 6 <= 1 THEN n % 3 <> 0 ELSE true END AS consistent FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS n FROM events)""")


@query
def title_similarity(spark, d):
    """Ratcliff-Obershelp ratio of names, of all pairs that reach 0.6; not sayable in SQL."""
    names = t(spark, d, "part").select("p_name").distinct()
    return lookup.guarded_match(lookup.alike(names, "p_name", 0.6), F.col("a"), F.col("b"), X.similarity_ratio, 0.6).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query
def title_distance(spark, d):
    """Edit distances of names that differ in two fifths of the longer one at most.

    Such names share three fifths of its characters, so the blocks of the similarity ratio hold all of them, and no pair of all is looked at.
    """
    pairs = lookup.alike(t(spark, d, "part").select("p_name").distinct(), "p_name", 0.6)
    distance = F.levenshtein("a", "b")
    return pairs.where(5 * distance <= 2 * F.greatest(F.length("a"), F.length("b"))).select("a", "b", long(distance).alias("distance"))


sql("title_distance", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_name < b.p_name WHERE 5 * levenshtein(a.p_name, b.p_name) <= 2 * greatest(length(a.p_name), length(b.p_name))")


@query
def title_best_match(spark, d):
    """Each name's likeliest other name, if it is alike enough; not sayable in SQL."""
    names = t(spark, d, "part").select("p_name").distinct()
    pairs = lookup.alike(names, "p_name", 0.85)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = lookup.guarded_match(both, F.col("a"), F.col("b"), X.similarity_ratio)
    return lookup.best_match(found, "a", "b").select("a", "b", F.round("ratio", 6).alias("ratio"))


TEMPLATE = "Title: {title}\nYear: {year}\nKeywords: {keywords}\nAbstract: {abstract}"


@query
def prompt_fill(spark, d):
    p = X.fill(TEMPLATE, {"title": (title(), ""), "year": (F.col("n_chars"), ""), "keywords": (F.lit(""), "(none supplied)"), "abstract": (F.when(F.col("doc_id") % 2 == 0, F.col("text")), "(not available)")})
    return t(spark, d, "documents").select("doc_id", F.substring(F.sha2(p, 256), 1, 16).alias("hash"), p.alias("prompt"))


sql("prompt_fill", """SELECT doc_id, substring(sha256(p),1,16) AS hash, p AS prompt FROM (SELECT doc_id, replace(replace(replace(replace('Title: {title}
Year: {year}
Keywords: {keywords}
Abstract: {abstract}', '{title}', substring(text,1,80)), '{year}', CAST(n_chars AS VARCHAR)), '{keywords}', '(none supplied)'), '{abstract}', CASE WHEN doc_id % 2 = 0 THEN text ELSE '(not available)' END) AS p FROM documents)""")


@query
def tex_pages(spark, d):
    """A page for each document, with the rounds of the conversation of its number and the decision of its label."""
    c = t(spark, d, "conversations").where("turn % 2 = 0")
    told = F.struct(F.concat(F.lit("Round "), F.col("turn").cast("string")).alias("label"), F.when(F.col("turn") == 0, "include").otherwise("exclude").alias("decision"), F.lit("I1").alias("criterion"), (F.col("turn") % 6).cast("string").alias("relevance"), F.col("text").alias("reason"))
    rounds = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", told.alias("r")))), lambda x: x["r"]).alias("rounds"))
    docs = t(spark, d, "documents").join(rounds, "doc_id", "left").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    abstract = F.when(F.col("doc_id") % 4 == 0, "(not available)").otherwise(F.col("text"))
    return report.pages(docs, F.col("doc_id"), F.lit(60), title(), [F.col("lang"), F.col("source")], F.when(F.col("doc_id") % 3 == 0, F.col("lang")), abstract, F.col("rounds"), F.when(F.col("quality") == 1, "include").otherwise("exclude"))


def sql_tex(x: str) -> str:
    x = f"coalesce({x}, '')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in X.TYPOGRAPHIC.items():
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    x = f"regexp_replace(regexp_replace({x}, '[\\p{{Cf}}\\p{{Cc}}\\p{{Co}}\\p{{Cs}}]', '', 'g'), '[^\\x{{0000}}-\\x{{017F}}]', ' ', 'g')"
    x = f"replace({x}, chr(92), chr(1))"
    for a, b in X.LATEX.items():
        x = x if a == "\\" else f"replace({x}, {quoted(a)}, {quoted(b)})"
    return trim_(WS.format(x=f"replace({x}, chr(1), {quoted(X.LATEX[chr(92)])})"))


sql("tex_pages", f"""WITH c AS (SELECT conv_id, string_agg('\\paragraph{{Round ' || turn || '}} ' || CASE WHEN turn = 0 THEN 'include' ELSE 'exclude' END || ', criterion I1, relevance ' || (turn % 6) || ' of 5: ' || {sql_tex("text")}, chr(10) ORDER BY turn) AS told
  FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id)
SELECT d.doc_id AS record, concat_ws(chr(10), '\\section*{{Record ' || d.doc_id || ' of 60}}', '\\textbf{{' || {sql_tex("substring(d.text,1,80)")} || '}}', '\\emph{{' || nullif(concat_ws(' \\textbullet{{}} ', nullif({sql_tex("d.lang")}, ''), nullif({sql_tex("d.source")}, '')), '') || '}}',
  '\\paragraph{{Keywords}} ' || CASE WHEN d.doc_id % 3 = 0 THEN nullif({sql_tex("d.lang")}, '') END,
  coalesce('\\paragraph{{Abstract}} ' || CASE WHEN d.doc_id % 4 <> 0 THEN nullif({sql_tex("d.text")}, '') END, '\\emph{{Without an abstract; the title alone was judged.}}'), c.told,
  '\\paragraph{{Final decision}} ' || CASE WHEN l.quality = 1 THEN 'include' ELSE 'exclude' END, '$\\square$ agree \\quad $\\square$ disagree, because: \\hrulefill', '\\newpage') AS page
FROM documents d LEFT JOIN c ON c.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")


@query
def bibtex_parse(spark, d):
    text = "@article{k1,\n title = {A  B},\n year = {2020},\n year = {2021}\n}\n@book{k2,\n title = {C {D} E},\n month = jun\n}\n"
    return tables.bibtex(spark.createDataFrame([(text,)], "value string")).select(F.col("fields")["title"].alias("title"), F.coalesce(F.col("fields")["year"], F.lit("")).alias("year"))


sql("bibtex_parse", "SELECT * FROM (VALUES ('A B', '2021'), ('C {D', '')) v(title, year)")


@query
def prisma_expr(spark, d):
    lines = ["# note", "date,stage,count,notes", "5/9/2026,identified,48 + 4 + x,a, b", "6/9/2026,eligible,623,"]
    return tables.stage_counts(spark.createDataFrame([(x,) for x in lines], "value string")).select(F.col("date").cast("string").alias("date"), "stage", long(F.col("count")).alias("count"), "notes")


sql("prisma_expr", "SELECT * FROM (VALUES ('2026-09-05', 'identified', CAST(52 AS BIGINT), 'a, b'), ('2026-09-06', 'eligible', 623, '')) v(date, stage, count, notes)")


def fake_judge(prompt: str) -> str:
    """Stands for a model: decides by length, fails for some."""
    n = len(prompt)
    if n % 11 == 0:
        raise ValueError("no answer")
    return f'{{"decision": "{("include", "exclude", "uncertain")[n % 3]}", "criterion": "I1", "relevance": "{n % 6}", "evidence": "", "reason": "length {n}"}}'


@query
def judge_map(spark, d):
    prompts = t(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return judge.judged(prompts, "doc_id", fake_judge, tries=2)


sql("judge_map", """SELECT doc_id, CASE WHEN n % 11 = 0 THEN 'uncertain' WHEN n % 3 = 0 THEN 'include' WHEN n % 3 = 1 THEN 'exclude' ELSE 'uncertain' END AS decision, CASE WHEN n % 11 = 0 THEN 'NA' ELSE 'I1' END AS criterion,
CAST(CASE WHEN n % 11 = 0 THEN -1 ELSE n % 6 END AS INT) AS relevance, '' AS evidence, CASE WHEN n % 11 = 0 THEN 'failed' ELSE 'length ' || n END AS reason FROM (SELECT doc_id, length(text) AS n FROM documents)""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
