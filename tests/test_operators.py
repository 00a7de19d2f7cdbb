"""Operators on small rows with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recordloom import scratch
from recordloom.functions import text as X
from recordloom.operators import dedup, judge, keyword, lookup, ranks, report, sample, stats
from recordloom.sources import tables
from recordloom.streaming import incremental


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize(("tree", "text"), [
    (keyword.Both((keyword.Term("a"), keyword.Term("b"))), "a b"),
    (keyword.Either((keyword.Term("a"), keyword.Both((keyword.Term("b"), keyword.Term("c"))))), "a or b AND c"),
    (keyword.Both((keyword.Term("model checker"), keyword.Term("x"))), '"model checker"AND (x)'),
    (keyword.Term("type-safe"), "((Type-Safe))"),
    (None, "  "),
])
def test_parse(tree, text):
    assert keyword.parse(text) == tree


@pytest.mark.parametrize("text", ["(a", "a)", '"a', "a OR", "AND a", ")"])
def test_parse_errors(text):
    with pytest.raises(keyword.KeywordError):
        keyword.parse(text)


def test_lint():
    assert keyword.ambiguous("a AND b OR c")
    assert not keyword.ambiguous("(a AND b) OR c")


@pytest.mark.parametrize(("text", "expr", "whole", "hit"), [
    ("Python-like", "python", True, True), ("cpython", "python", True, False), ("cpython", "python", False, True), ("a_b", "a", True, True),
    ("x", '""', False, False), ("x", None, False, True), (None, "x", False, False), ("a.c", "a.c", True, True), ("abc", "a.c", True, False),
])
def test_matches(spark, text, expr, whole, hit):
    assert one(spark, text, lambda c: keyword.matches(c, expr, whole)) is hit


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.key_screen, "Ünï ﬁx—It!  2", "uni fixit 2"), (X.key_title, "A&amp;B", "a b"), (X.key_pack, "A b-C", "abc"), (X.key_filter, "  A   b..", "a b."),
    (X.key_exclude, "\xa0A  B.", "a b."), (X.key_cache, "A-B", "title:a b"), (X.doi_key, "https://doi.org/10.1/X", "10.1/x"), (X.strip_tags, "<p>a</p> <b>b</b>", "a b"),
    (X.latex, "50% of \\x_{1}", r"50\% of \textbackslash{}x\_\{1\}"), (X.sum_expression, "48 + 4", 52), (lambda c: X.truthy(c), " Yes ", True), (X.key_screen, None, None),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_similarity_and_template(spark):
    row = spark.sql("SELECT 'kitten' a, 'sitting' b").select(X.similarity_ratio("a", "b").alias("r"), X.fill("{t}|{k}", {"t": (F.lit("{k}"), ""), "k": (F.lit(" "), "none")}).alias("f")).head()
    assert round(row.r, 3) == 0.615
    assert row.f == "none|none"
    assert X.prompt_sections("x## SYSTEM\na\n## USER\nb") == ("a", "b")
    assert X.pattern_label(r"\bunit tests?\b") == "unit tests?"


@pytest.mark.parametrize(("reply", "relevance"), [
    ('so {"decision":"include","criterion":"I1","relevance":"4","evidence":"","reason":"r"}.', 4), ('{"decision":"include","criterion":"I1","relevance":4,"evidence":"","reason":"r"}', 4),
    ('{"decision":"maybe","criterion":"I1","relevance":4,"evidence":"","reason":"r"}', None), ('{"decision":"include"}', None), ("none", None), (None, None),
])
def test_judgement(spark, reply, relevance):
    got = one(spark, reply, X.judgement)
    assert (got and got.relevance) == relevance


def brute_longest(rows):
    for key in (lambda r: ("d", r["doi"]) if r["doi"] else (("t", r["nt"]) if r["nt"] else ("o", r["o"])), lambda r: ("t", r["nt"]) if r["nt"] else ("o", r["o"])):
        groups = {}
        for r in sorted(rows, key=lambda r: r["place"]):
            groups.setdefault(key(r), []).append(r)
        rows = [dict(max(g, key=lambda r: len(r["a"])), place=min(r["place"] for r in g)) for g in groups.values()]
    return sorted((r["o"], r["place"]) for r in rows)


def test_keep_longest_random(spark):
    rng = random.Random(1)
    rows = [{"o": i, "place": i, "doi": rng.choice(["", "x", "y", "z"]), "nt": rng.choice(["", "a", "b", "c", "d", "e"]), "a": "w" * rng.randrange(4)} for i in range(200)]
    df = spark.createDataFrame([(r["o"], r["doi"], r["nt"], r["a"]) for r in rows], "o long, doi string, nt string, a string")
    got = dedup.keep_longest(df, "o", F.col("doi"), F.col("nt"), F.col("a"))
    assert sorted((r.o, r.place) for r in got.collect()) == brute_longest(rows)
    assert dedup.keep_longest(df.limit(0), "o", F.col("doi"), F.col("nt"), F.col("a")).count() == 0


def test_kappa_golden(spark):
    row = stats.kappa(spark.sql("SELECT 27L yy, 3L yn, 1L ny, 29L nn")).head()
    assert [round(x, 4) for x in (row.po, row.pe, row.kappa, row.low, row.high)] == [0.9333, 0.5, 0.8667, 0.7404, 0.9929]
    assert row.band == "almost perfect"
    assert stats.kappa(spark.sql("SELECT 5L yy, 0L yn, 0L ny, 0L nn")).head().kappa is None
    assert stats.kappa(spark.sql("SELECT 0L yy, 0L yn, 0L ny, 0L nn")).head().po is None


def test_summary_single_row(spark):
    assert stats.summary(spark.sql("SELECT 'a' k, 1.0D v"), "k", F.col("v")).head().deviation is None
    assert stats.range_sums(spark, 1000).head().total == 499500


def test_terciles_and_samples(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    counts = {r.tercile: r.n for r in sample.terciles(df, [F.col("k")]).groupBy("tercile").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 3, 1: 3, 2: 5}
    got = sample.stratified(df, "k", [("a", F.col("k") < 4, 3), ("b", F.col("k") < 6, 3)], 8).collect()
    assert len({r.k for r in got}) == 8
    assert [sum(r.stratum == s for r in got) for s in ("a", "b", "top-up")] == [3, 3, 2]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿title,venue\nA \"\"q,V\n\"B, \"\"x\"\"\nnext\",W,extra,more\nC\n".encode())
    (tmp_path / "b.csv").write_text("nothing\n1\n")
    a = tables.read_csv(spark, f"file://{tmp_path}/a.csv", "title")
    rows = {r.title: (r.venue, r.extra_columns) for r in a.collect()}
    assert rows['B, "x"\nnext'] == ("W", "extra | more")
    assert rows["C"] == ("", "")
    with pytest.warns(UserWarning):
        assert tables.read_csv(spark, f"file://{tmp_path}/b.csv", "title") is None
    tables.write_csv(a, f"file://{tmp_path}/out", ["title"], one_file=True)
    assert spark.read.csv(f"file://{tmp_path}/out", header=True, multiLine=True, escape='"').count() == 3
    both = tables.union_all([a.select("title"), spark.sql("SELECT 'z' `Item Title`, 5 Year")])
    assert both.columns == ["title", "Item Title", "Year"]
    assert sorted(r.title for r in tables.canonical(both).collect())[-1] == "z"
    assert tables.config(json.dumps({"filters": {"whole_word": True}}))["filters"]["whole_word"] is True
    assert tables.distinct_files(["b", "a", "b"]) == ["b", "a"]


def test_cache_round_trip(spark):
    rows = tables.cache_rows(spark.createDataFrame([('{"a": "1", "b": "2"}',)], "value string"))
    assert json.loads(tables.cache_text(rows).head().value) == {"a": "1", "b": "2"}


def test_bibtex_balanced(spark):
    df = spark.createDataFrame([("@a{k,\n author = {L{\\'o}pez and B},\n}\n",)], "value string")
    assert tables.bibtex(df, balanced=True).head().fields["author"] == "L{\\'o}pez and B"
    assert tables.bibtex(df).head().fields["author"] == "L{\\'o"


def test_backfill_and_lists(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "own", "x"), (3, None, "y")], "id int, abstract string, k string")
    cache = spark.createDataFrame([("x", "found")], "key string, value string")
    assert {r.id: (r.abstract, r.filled) for r in lookup.backfill(df, "abstract", cache, [F.col("k")]).collect()} == {1: ("found", True), 2: ("own", False), 3: ("", False)}
    listed = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    assert [r.id for r in lookup.exclude_listed(df, F.col("k"), listed, F.col("t")).collect()] == [3]
    assert lookup.exclude_listed(df, F.col("abstract"), listed, F.col("t")).count() == 3


def test_lookup_in_batches(spark):
    keys = spark.range(7).select(F.col("id").cast("string").alias("doi"))

    def resolve(part):
        if "3" in part:
            raise OSError
        return [f"v{x}" for x in part]

    got = {r.doi for r in judge.looked_up(keys.coalesce(1), "doi", resolve, batch=2, tries=2).collect()}
    assert got == {"0", "1", "4", "5", "6"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "id int, t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, t string").parquet(f"{tmp_path}/in")
    out = incremental.exclude_stream(stream, F.col("t"), spark.createDataFrame([("a",)], "x string"), F.col("x"))
    q = incremental.append_rows(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 3]


def test_any_number_of_surplus_fields(spark, tmp_path):
    (tmp_path / "r.csv").write_text('title,venue\nA,1,2,3,4,5,6,7,8,"9, x"\nB,V\n')
    rows = {r.title: r for r in tables.read_csv(spark, f"file://{tmp_path}/r.csv", "title").collect()}
    assert (rows["A"].venue, rows["A"].extra_columns) == ("1", "2 | 3 | 4 | 5 | 6 | 7 | 8 | 9, x")
    assert rows["B"].extra_columns == ""


def test_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text("year,title\n2020,B\n")
    (tmp_path / "a.csv").write_text("title,venue\nA,V,more\n")
    (tmp_path / "c.csv").write_text("Title\nC\n")
    (tmp_path / "merged_csvs.csv").write_text("title\nown result\n")
    with pytest.warns(UserWarning, match="no column"):
        got = tables.read_folder(spark, f"file://{tmp_path}")
    assert got.columns[:3] == ["title", "venue", "__source_file"] and got.columns[3] == "year"
    assert sorted((r.title, r.venue, r.year) for r in got.collect()) == [("A", "V", ""), ("B", "", "2020")]
    with pytest.warns(UserWarning, match="not found"):
        assert tables.read_csv(spark, f"file://{tmp_path}/none.csv") is None
    with pytest.warns(UserWarning):
        assert tables.read_all(spark, [f"file://{tmp_path}/none.csv"]) is None


def test_canonical(spark):
    row = spark.createDataFrame([("T é", "https://doi.org/10.1/X", "2001", "1999", "P", "v", "k1", "k2")], "`Document Title` string, DOI string, `Publication Year` string, year string, `Publication Title` string, venue string, keywords string, `IEEE Terms` string")
    r = tables.canonical(row).head()
    assert (r.title, r.nt, r.doi, r.abstract, r.kw, r.year, r.venue, r.link) == ("T é", "t e", "10.1/x", "", " k1  k2", "2001", "P", "")
    assert tables.canonical(spark.createDataFrame([(" ",)], "title string")).count() == 0


def test_config_and_log_columns(spark):
    with pytest.warns(UserWarning):
        assert tables.config('{"deduplicate": {"keep": "middle"}, "filters": 3}')["deduplicate"] == {"enabled": True, "keep": "first"}
    assert tables.config("{}")["output"]["duplicates_csv"] == "duplicates_removed.csv"
    assert tables.with_log_columns(spark.range(1)).columns == ["id", "decision", "criterion", "notes"]
    assert [r.stratum for r in tables.with_default_stratum(spark.sql("SELECT explode(array('x', null)) stratum")).collect()] == ["x", "all"]


@pytest.mark.parametrize(("text", "want"), [("3×4 a\nb • c", r"3x4 ab c"), ("–—−‘’“” …", "------`'``'' ..."), ("a​b­c", "abc"), (r"\{x}~^_&%$#", r"\textbackslash{}\{x\}\textasciitilde{}\textasciicircum{}\_\&\%\$\#"), (None, ""), ("é Ω", "é")])
def test_latex(spark, text, want):
    assert one(spark, text, X.latex) == want


def test_forms(spark):
    assert one(spark, "a b/ü~*-_.|&", X.url_quoted) == "a%20b/%C3%BC~%2A-_.%7C%26"
    assert one(spark, "x|y/", lambda c: X.url_quoted(c, "|")) == "x|y%2F"
    assert one(spark, 1234567, X.grouped_number, "long") == "1,234,567"
    assert one(spark, 1e6, X.exponent, "double") == "1E+06"
    assert one(spark, 0.5, lambda c: X.number(c, 4), "double") == "0.5000"
    assert one(spark, "\x1c　 a b \x85", X.strip) == "a b"


def test_numbered(spark):
    rng = random.Random(4)
    values = [rng.randrange(50) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    got = ranks.numbered(rows, [F.desc("v"), F.col("id")], "place").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(range(500), key=lambda i: (-values[i], i))
    assert sorted(r.place for r in got) == list(range(1, 501))
    assert ranks.numbered(rows.limit(0), [F.col("v")], "place").count() == 0


def test_median_is_exact(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random()])) for _ in range(301)] + [("lone", 2.0), ("empty", None)]
    rows += [("ties", float(rng.randrange(3))) for _ in range(4000)] + [("long", rng.gauss(0, 1)) for _ in range(5000)]
    got = {r.k: r for r in stats.summary(spark.createDataFrame(rows, "k string, v double"), "k", F.col("v")).collect()}
    for k in {k for k, _ in rows}:
        v = sorted(v for g, v in rows if g == k and v is not None)
        want = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
        assert got[k].median == want if want is None else abs(got[k].median - want) < 1e-12
        assert got[k].n == len(v)


def test_keep_one_and_routes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "f"), (2, "a", "g"), (3, "a ", "f"), (4, "b", "g"), (5, None, "f"), (6, None, "f")], "o int, t string, s string")
    key = X.key_filter(F.col("t"))
    got = {r.o: r for r in dedup.keep_one(rows, "o", key, "t", "s", last=True).collect()}
    assert {o: (r.kept, r.duplicate_count, r.duplicate_of_title, r.sources) for o, r in got.items()} == {1: (False, 3, "a ", "f | g"), 2: (False, 3, "a ", "f | g"), 3: (True, 3, "a ", "f | g"), 4: (True, 1, "b", "g"), 5: (False, 2, None, "f"), 6: (True, 2, None, "f")}
    routed = dedup.routed(rows.where("t is not null"), "o", "t", key, F.col("o") != 3, F.lit("r"))
    assert {r.o: (r.route, r["__duplicate_count"], r["__duplicate_of_title"]) for r in routed.collect()} == {1: ("included", 2, None), 2: ("duplicates", None, "A"), 3: ("excluded", 1, None), 4: ("included", 1, None)}
    dedup.write_routes(routed, f"file://{tmp_path}/out")
    assert {r.route: r.n for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").groupBy("route").agg(F.count("*").alias("n")).collect()} == {"included": 2, "excluded": 1, "duplicates": 1}


def test_known_items_come_first(spark):
    got = sample.stratified(spark.range(30).withColumnRenamed("id", "k"), "k", [("a", F.col("k") < 10, 4), ("b", F.lit(True), 2)], 9, known=[3, 25]).collect()
    assert [(r.k, r.stratum) for r in got[:2]] == [(3, "known item"), (25, "known item")]
    assert [sum(r.stratum == s for r in got) for s in ("a", "b", "top-up")] == [4, 2, 1]
    assert len({r.k for r in got}) == 9


def test_caches(spark, tmp_path):
    cache = spark.createDataFrame([("x", "old"), ("z", "z")], "key string, value string")
    merged = lookup.merged_cache(cache, spark.createDataFrame([("x", "new"), ("y", "b"), ("y", "a")], "key string, value string"))
    tables.write_cache(merged, f"file://{tmp_path}/c")
    assert {r.key: r.value for r in tables.cache_lines(spark, f"file://{tmp_path}/c").collect()} == {"x": "old", "y": "a", "z": "z"}
    rows = spark.createDataFrame([("10.1/B ", ""), ("10.1/a", " "), ("10.1/b", None), ("x", ""), ("", ""), ("10.2/c", "has")], "doi string, abstract string")
    assert [r.doi for r in lookup.wanted(rows, F.col("doi"), F.col("abstract"), cache).collect()] == ["10.1/a", "10.1/b"]


def test_best_match(spark):
    pairs = spark.createDataFrame([("a", "y", 0.9), ("a", "x", 0.9), ("a", "z", 0.1), ("b", "q", 0.2)], "a string, b string, ratio double")
    assert sorted((r.a, r.b, r.ratio) for r in lookup.best_match(pairs, "a", "b").collect()) == [("a", "x", 0.9), ("b", "q", 0.2)]


def test_disagreements(spark):
    rows = spark.createDataFrame([("include", "d")] * 3 + [("include", "")] * 27 + [("exclude", "Yes")] + [("exclude", None)] * 29, "decision string, disagree string")
    dis = X.truthy(F.col("disagree"))
    assert {r.decision: r.n for r in stats.disagreements(rows, "decision", dis).collect()} == {"include": 3, "exclude": 1}
    assert round(stats.kappa(stats.from_disagreements(rows, F.col("decision"), dis)).head().kappa, 4) == 0.8667


def test_progress_is_observed(spark):
    rows, seen = report.observed(spark.range(10), F.col("id") > 6)
    assert rows.count() == 10
    assert seen.get == {"done": 10, "failed": 3}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Cluster)


def test_scratch_tables_are_removed(spark):
    folder = scratch.scratch_dir(spark).rsplit("/", 1)[0]
    there = lambda: set(tables.files_of(spark, folder, "*"))
    before = there()
    with scratch.temporary(spark):
        with scratch.temporary(spark):
            scratch.stored(spark.range(3))
            kept = scratch.stored(spark.range(4), outlive=True)
        assert len(there() - before) == 1 and kept.count() == 4
    assert there() == before
    assert scratch.stored(spark.range(5)).count() == 5


def test_quoted_terms(spark):
    assert one(spark, r"a\eb.c x", lambda c: keyword.matches(c, r'"a\Eb.c"', True)) is True
    assert one(spark, r"a\ebxc", lambda c: keyword.matches(c, r'"a\Eb.c"', True)) is False


def test_bands_go_to_their_outputs(spark, sf, tmp_path):
    from recordloom.plans import registry

    group = F.when(F.col("band") <= 2, "screen").when(F.col("band") == 3, "held").when(F.col("band") == 4, "low").otherwise("excluded")
    dedup.write_routes(registry.queries()["screening_set"](spark, sf).withColumn("band_group", group), f"file://{tmp_path}/bands", "band_group")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/bands")
    want = {r.band_group: r.n for r in registry.queries()["band_groups"](spark, sf).collect()}
    assert {r.band_group: r.n for r in rows.groupBy("band_group").agg(F.count("*").alias("n")).collect()} == want


def test_long_keys_equal_keys_one_by_one(spark):
    rng = random.Random(2)
    some = list("aAbZ09 .,'ΣσİIıßKÅſ…①ⅧÀé℡ﬁ中😀\u0301\u0307\u00ad\u200b\x00\x1b") + list(X.BLANKS)
    texts = [None, "", " ", ".", " . ", "a .", "ΑΣ.", None, "End.\u2003"] + ["".join(rng.choices(some, k=rng.randrange(25))) for _ in range(1500)]
    table = spark.createDataFrame(list(enumerate(texts)), "n long, x string").coalesce(1)
    got = X.keys(table, F.col("x"), "n")
    x = F.col("x")
    want = table.select("n", X.key_screen(x).alias("screen"), X.key_pack(x).alias("pack"), X.key_filter(x).alias("filter"), X.key_exclude(x).alias("exclude"), X.key_join(x).alias("joined"), X.key_cache(x).alias("cache"))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert X.keys(table.limit(0), x, "n").count() == 0


def test_norm_keys_run_no_pattern_over_texts(spark, sf):
    plan = __spark_entry__.queries()["norm_keys"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("MapInArrow") == 1
