"""Queries read all of a record: small tables whose result hangs on what stands late or apart."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recordloom.operators import lookup
from recordloom.plans import registry


@pytest.fixture
def at(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_abstract_is_banded_whole(spark, at):
    late, astride = "xx " * 400 + "benchmark and", "xx " * 25 + "xx benchmark xx"
    d = at("documents", [(1, late), (2, "zz " * 400), (3, astride)], "doc_id long, text string")
    q = registry.queries()
    assert {r.doc_id: (r.band, r.score, r.why) for r in q["band_documents"](spark, d).collect()} == {1: (1, 6, "abs:LINK"), 2: (5, 0, "-"), 3: (1, 4, "-")}
    assert {r.doc_id: r.band for r in q["rank_emit"](spark, d).collect()} == {1: 1, 2: 5, 3: 1}
    assert {r.band_group: r.n for r in q["band_groups"](spark, d).collect()} == {"screen": 2, "excluded": 1}
    assert {r.doc_id: r.only_ext for r in q["facet_setops"](spark, d).collect()} == {1: "LINK", 2: "", 3: ""}


def test_exclusion_list_is_the_benchmark(spark, at):
    opening = "the same opening line of many records, "
    at("benchmark", [(1, opening + "listed"), (2, " ")], "item_id long, text string")
    d = at("documents", [(7, opening + "other", "en"), (8, " " + opening.upper() + " Listed", "en"), (14, opening + "third", "de"), (15, "", "fr"), (16, None, "fr")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in registry.queries()["exclude_anti"](spark, d).collect()) == [7, 14, 15, 16]


def test_similar_titles_need_no_first_letter(spark, at):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdé😀 ") for _ in range(rng.randrange(1, 12))) for _ in range(90)} | {"forest green", "green forest", "dark forest", "x"})
    d = at("part", [(n,) for n in [*names, names[0], None, ""]], "p_name string")
    want = {(a, b): round(r, 6) for a in names for b in names if a < b and (r := SequenceMatcher(None, a, b).ratio()) >= 0.6}
    got = registry.queries()["title_similarity"](spark, d).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.ratio for r in got} == want
    assert any(a[0] != b[0] for a, b in want)


def test_title_distance_finds_all_near_pairs(spark, at):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9))) for _ in range(80)} | {"kitten", "sitting", "kit", "itten"})
    d = at("part", [(n,) for n in [*names, names[0]]], "p_name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b, n) for a in names for b in names if a < b and 5 * (n := distance(a, b)) <= 2 * max(len(a), len(b))}
    assert ("itten", "kitten", 1) in want
    assert {(r.a, r.b, r.distance) for r in registry.queries()["title_distance"](spark, d).collect()} == want


def test_all_patterns_are_looked_up(spark):
    patterns = spark.range(1200).selectExpr("concat('^n', id, '$') as pattern")
    rows = spark.range(1200).selectExpr("id", "concat('n', id) as name")
    assert lookup.first_hits(rows, "name", [F.col("id")], patterns, "id").count() == 1200


def test_patterns_take_records_in_turn(spark):
    rows = spark.createDataFrame([(i, f"a{i} b") for i in range(40)], "id int, name string")
    got = lookup.first_hits(rows, "name", [F.col("id")], ["a", "b", "zzz", *["a.* b"] * 20, "a1 "], "id").collect()
    assert [(r.pattern, r.id) for r in got] == [("a", 0), ("b", 1), *[("a.* b", i) for i in range(2, 22)]]
