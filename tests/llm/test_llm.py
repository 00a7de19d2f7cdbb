"""Operators against brute force, round trips, held-out accuracy, SQL and odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import ann, htmltext, jaccard, linededup, mixing, packing, quality, queries, sharding, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, key string"
ODD = [
    (1, None, None, None, None, 1, "k"), (2, "", "en", "src1", 0, 1, None), (None, "a b c", "en", "src1", 5, 2, "x"), (3, "a b c", None, "src1", 5, 2, "x"), (3, "a b c", None, "src1", 5, 2, "x"),
    (4, "w " * 30_000, "fr", "src2", 60_000, 3, ""), (5, "one line\n\none line\n" * 3, "de", None, 60, 0, "y"), (6, "é ü 1d10t <|endoftext|> x", "de", "odd", 9, 0, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_classes(rows):
    """doc_id -> smallest doc_id reachable."""
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    first = {}
    for k, (d, _) in enumerate(rows):
        first[top(k)] = min(d, first.get(top(k), d))
    return {d: first[top(k)] for k, (d, _) in enumerate(rows)}


def test_jaccard_brute_force(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for base in range(12):
        words = [f"w{base}_{i}" for i in range(rng.choice([3, 6, 60, 150]))] + passage * (base % 3 == 0)
        for _ in range(rng.choice([1, 4, 25])):
            mine = list(words)
            for _ in range(rng.randrange(0, 5)):
                mine[rng.randrange(len(mine))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    want = brute_classes(rows)
    assert {d: c for d, (_, c) in got.items()} == want
    assert all(got[d][0] == len(shingle_set(t)) for d, t in rows)
    assert {r.doc_id for r in jaccard.one_of_each(df).select("doc_id").collect()} == set(want.values())


def near_copies(n, edits, rng):
    """Copies of 100 words, each with so many others at random places."""
    out = []
    for k in edits[:n]:
        words = [f"w{i}" for i in range(100)]
        for at in rng.sample(range(100), k):
            words[at] = f"e{rng.randrange(10**7)}"
        out.append(" ".join(words))
    return out


def test_jaccard_large_blocks_brute_force(spark, monkeypatch):
    """Blocks of many chunks lose no link, whichever component its ends are in and however many rounds of forests there are."""
    monkeypatch.setattr(jaccard, "CHUNK", 12)
    rng = random.Random(7)
    texts = near_copies(160, [rng.choice([0, 1, 2, 3, 4]) for _ in range(160)], rng)
    other = " ".join(f"v{i}" for i in range(30))
    texts += [" ".join(t.split()[:70]) + " " + other for t in near_copies(60, [rng.choice([0, 1, 2]) for _ in range(60)], rng)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (64, 0):
        monkeypatch.setattr(jaccard, "FEW", few)
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == brute_classes(rows)


def test_jaccard_rows_of_a_group_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    sent, plain = [], jaccard.block_pairs

    def counted(rows, percent, mode, turn=0):
        sent[-1] += rows.count()
        return plain(rows, percent, mode, turn)

    monkeypatch.setattr(jaccard, "block_pairs", counted)
    for n in (100, 400):
        rng = random.Random(n)
        texts = near_copies(n, [5] * 12 + [1] * n, rng)
        sent.append(0)
        classes = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("component_id").count()
        assert [r["count"] for r in classes.collect() if r["count"] > 1] == [n - 12]
    assert 0 < sent[1] < 6 * sent[0]


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(80) < p, rng.integers(0, 1 << 60, 80).astype(np.uint64), base)) for p in (0, 0.05, 0.1, 0.2)]
    at = jaccard.points([jaccard.point(s) for s in sets], 1 << int(jaccard.level(80)))
    size, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {(min(a, b), max(a, b)) for x, y in jaccard.tree_pairs(ids, ids, size, at, 75, False) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    links = {(i, j) for j in ids for i in range(j) if 4 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 3 * (size[i] + size[j] - k)}
    assert links <= found
    assert len(found) < len(ids) * 6


def test_odd_rows(spark, odd):
    empty = odd.limit(0)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df, n in ((odd, len(ODD)), (empty, 0)):
        assert jaccard.near_duplicates(df).count() == n
        assert linededup.drop_boilerplate(df, F.col("source"), min_pages=2).count() == n
        assert sharding.shard_documents(df).count() == n
        assert quality.score_documents(df, labels, "quality", F.lit(True)).where("score between 0 and 1").count() == n
        model = toxicity.fit(df, labels, "toxic", F.lit(True))
        assert toxicity.score_documents(df, model, restored=True).where("score between 0 and 1").count() == n
        assert mixing.mix(df, max_epochs=2).columns == [*df.columns, "epoch"]
        assert mixing.mix(df, max_epochs=2).count() >= 0
        assert packing.pack(df).select("doc_id").distinct().count() == len({r[0] for r in ODD}) * bool(n)


def test_linededup_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(linededup.SQL.format(src="documents")).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op4_line_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got.columns)].astype(str).equals(want[sorted(want.columns)].astype(str))


def test_linededup_copies_are_one_page(spark):
    df = spark.createDataFrame([(i, "same\ntext", "s") for i in range(50)] + [(100 + i, f"top\nown {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    rows = linededup.drop_boilerplate(df, F.col("source")).collect()
    assert {r.text for r in rows if r.doc_id < 100} == {"same\ntext"}
    assert {r.text for r in rows if r.doc_id >= 100} == {f"own {i}" for i in range(20)}


def test_budgets_redistribute_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 1000}
    got = mixing.budgets(leaves, 200, 1, [{"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5}, {}], 1.0)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "x", "4"): 100}
    full = mixing.budgets(leaves, 600, 1, [{"a": 0.5, "b": 0.5}, {}, {}], 1.0)
    assert full == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 390}


def test_mix_prefix_is_longest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens = {r.doc_id: (r.t, r.lang, r.source) for r in docs.select("doc_id", mixing.token_count(F.col("text")).alias("t"), "lang", "source").collect()}
    leaf = lambda d: (f"web{int(tokens[d][2][3:]) % 4}", tokens[d][1], tokens[d][2])
    held = {}
    for d, (t, _, _) in tokens.items():
        held[leaf(d)] = held.get(leaf(d), 0) + t
    given = mixing.budgets(held, 0.7 * sum(held.values()), 2, [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], 0.05)
    rows = mixing.mix(docs, budget_share=0.7, max_epochs=2).select("doc_id", "epoch").collect()
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    spent = {}
    for r in rows:
        spent[leaf(r.doc_id)] = spent.get(leaf(r.doc_id), 0) + tokens[r.doc_id][0]
    most = {}
    for d, (t, _, _) in tokens.items():
        most[leaf(d)] = max(most.get(leaf(d), 0), t)
    assert all(given[k] - most[k] < spent.get(k, 0) <= given[k] or spent.get(k, 0) == given[k] for k in given)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_files()[0])
    rows = packing.pack(odd, with_ids=True).toPandas()
    for d, text in ((4, ODD[5][1]), (6, ODD[7][1]), (2, ""), (1, "")):
        mine = rows[rows.doc_id == d].sort_values("piece")
        ids = [i for p in mine.ids for i in p]
        assert ids == [*tk.encode(text, add_special_tokens=False).ids, 2]
        assert list(mine.start) == list(np.cumsum([0, *mine.length])[:-1])
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(mine.ids, mine.ids_crc32, strict=True))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(np.cumsum([0, *s.length])[:-1])
        assert s.length.sum() <= 1024


def test_packing_is_tight():
    lengths = np.random.default_rng(1).integers(1, 1024, 5000)
    sequence, _ = packing.pack_lengths(lengths)
    assert np.bincount(sequence, lengths).max() <= 1024
    assert sequence.max() + 1 <= 1.01 * lengths.sum() / 1024 + 1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 24) for i in range(90)]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [0.0] * 24), (None, [1.0] * 24), (2020, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(rows, f, zero):
    x = {r.vec_id: f(np.array(r.embedding)) for r in rows if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and (zero or any(r.embedding))}
    out = {}
    for q, v in x.items():
        if q % 20 == 0:
            s = sorted((-float(v @ w), i) for i, w in x.items() if i != q and len(w) == len(v))[:20]
            out[q] = [(i, -a) for a, i in s]
    return {q: s for q, s in out.items() if s}


def test_topk_exact(vectors):
    got = {}
    for r in topk.top_k(vectors, lambda i: i % 20 == 0, query_block=16, chunk=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(vectors.collect(), lambda v: np.floor(64 * v), True)


def test_ann_recall(vectors):
    got = {}
    for r in ann.nearest(vectors, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(vectors.collect(), lambda v: v, False)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-9 for q in want for i, s in got[q])


def test_sharding_laws(spark, sf, odd):
    got = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert set(got.shard) == set(range(8))
    assert sizes.max() <= 1.2 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert {(r.doc_id, r.size, r.text_crc32) for r in sharding.shard_documents(odd).collect()} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ODD}


def test_classifiers_held_out(spark, sf):
    """Recall and precision of either class, on rows that were not learned from."""
    big = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    for name, label in (("op1_toxicity", "toxic"), ("op7_quality", "quality")):
        rows = queries.QUERIES[name](spark, big).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
        for y in (0, 1):
            hits = sum(r.predicted == y == r[label] for r in rows)
            assert hits >= 0.85 * sum(r[label] == y for r in rows)
            assert hits >= 0.85 * sum(r.predicted == y for r in rows)


def test_deobfuscation():
    counts = np.ones(27**3)
    words = frozenset(["idiot", "worthless", "trash", "scum"])
    r = toxicity.Restorer(toxicity.Model(counts, words).log, words)
    assert [r.word(w) for w in ("1d10t", "$cum", "i.d.i.o.t", "tr@sh", "idioooot", "plain", "the,")] == ["idiot", "scum", "idiot", "trash", "idiot", "plain", "the"]
    assert r.words("an i d i o t here") == ["an", "idiot", "here"]
    assert r.words(None) == []
    s = toxicity.Scorer(r, -3.0, dict.fromkeys(words, 6.0))
    assert s("you 1d10t") > 0.5 > s("you plain person")


def test_toxic_stage_keeps_columns(spark, odd):
    model = (toxicity.Model(np.ones(27**3)).log, -3.0, {"idiot": 9.0})
    assert {r.doc_id for r in toxicity.passing(odd, model).collect()} == {1, 2, None, 3, 4, 5}
    assert toxicity.passing(odd, model).columns == odd.columns


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"),
    ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One, two.<p><b>bold<br>line</b> &lt;x&gt;</article><footer>f</footer>", "T One, two. bold line <x>"),
    ("<div class=comments><p>long, comment, with, commas, and much text to score high in points.</div><div id=main><p>Main, text.</p></div>", "Main, text."),
    ("<article><p>a</p><div class='ad'>buy</div><form>f</form><script>var t='</p>';</script><p>b", "a b"), ("<article>" + "<div>" * 3000 + "<p>deep, text</p>", "deep, text"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body one, two.</p><div class="comments"><h2>Comments</h2><p>no</p></div></article>', "Title Body one, two."),
    ('<article><p>a <span class="search">search</span> word and <a class="share">link</a>.</p></article>', "a search word and link."),
    ('<div class=menu><a href=x>a</a></div><div id=c>Prose of the article that stands in a div, without any paragraph tag,<br>and goes on.</div><p>small</p><div class="footer">f</div>', "Prose of the article that stands in a div, without any paragraph tag, and goes on. small"),
    ("<table><tr><td>one, two<td>three, four<tr><td>five, six</table>", "one, two three, four five, six"), ("<div class='content has-sidebar'><p>Some, text.</p></div>", "Some, text."),
])
def test_main_text(html, want):
    assert htmltext.main_text(html) == want


def test_pages_query(spark, sf):
    rows = queries.op10_main_text(spark, sf).collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any("<p>" in r.text for r in rows)


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = P.drop_toxic(spark, docs, sf)
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    lined = P.drop_lines(spark, clean, sf)
    assert {r.doc_id for r in lined.select("doc_id").collect()} == kept
    single = P.drop_near_copies(spark, lined, sf)
    want = set(brute_classes([(r.doc_id, r.text) for r in lined.select("doc_id", "text").collect()]).values())
    assert {r.doc_id for r in single.select("doc_id").collect()} == want
    mixed = P.mix_sources(spark, single, sf)
    assert mixed.columns == docs.columns
    packed = P.pack_sequences(spark, mixed, sf)
    ids = {r.doc_id for r in mixed.select("doc_id").collect()}
    assert ids <= want
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert P.run(spark, sf).count() == packed.count()


def test_footer_of_a_small_host_goes(spark):
    df = spark.createDataFrame([(i, f"own {i}\nfooter", "small") for i in range(4)] + [(9, "only\nfooter", "single")], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in linededup.drop_boilerplate(df, F.col("source")).collect()} == {**{i: f"own {i}" for i in range(4)}, 9: "only\nfooter"}


def test_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {step: " ".join(words[step : step + 60]) for step in (0, 6, 12)}  # neighbours share 50 of 62 shingles, the ends 44 of 68
    for one in ([(5, texts[0]), (None, texts[6]), (9, texts[12])], [(5, texts[0]), (None, texts[6]), (None, texts[6]), (9, texts[12]), (None, "a lone text")]):
        df = spark.createDataFrame(one, "doc_id long, text string").coalesce(1)
        got = [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()]
        assert sorted(got, key=str) == sorted([(d, None if t == "a lone text" else 5) for d, t in one], key=str)
        assert [r.doc_id for r in jaccard.one_of_each(df).where("doc_id is not null").collect()] == [5]


def test_sharding_places_by_dot_product():
    rng = np.random.default_rng(3)
    units = rng.random((60, 3)) / 8
    got = sharding.place(units, np.ones((4, 3)))
    left, want = [[1.0] * 3 for _ in range(4)], {}
    for k in sorted(range(60), key=lambda k: (-max(units[k]), k)):
        fits = [sum(a * b for a, b in zip(units[k], r, strict=True)) for r in left]
        want[k] = fits.index(max(fits))
        left[want[k]] = [a - b for a, b in zip(left[want[k]], units[k], strict=True)]
    assert [want[k] for k in range(60)] == got.tolist()
    size = rng.integers(1, 100, 500).astype(float)
    moved = sharding.evened(size, np.zeros(500, np.int64), np.zeros(4))
    loads = np.bincount(moved, size, 4)
    assert loads.max() - loads.min() <= 100


def test_sharding_keeps_groups(spark):
    rows = [(i, f"text {i % 40} " + "w " * (i % 40)) for i in range(400)] + [(1000 + i, "copy " * 40) for i in range(150)] + [(None, "x")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell_groups=8).toPandas()
    copies = got[got["size"] == 201]
    shards_of = got[got["size"] != 201].groupby("text_crc32").shard.nunique()
    assert shards_of.max() == 1  # only the group above a shard is cut
    assert copies.shard.nunique() == -(-150 * 201 // (got["size"].sum() / 8)) or copies.shard.nunique() <= 8
    assert len(got) == len(rows)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() <= 1.25 * sums.mean()


def brute_pack(lengths, capacity):
    """The rule as it is said: of all open sequences and a new one, the one with the least sum of squares; a new one only while it can't be too many, or if none has room."""
    least, open_ = -(-sum(lengths) // capacity), []
    where = {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        def squares(gaps):
            gaps = [g for g in gaps if g]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        choices = [(squares(open_[:j] + [g - lengths[k]] + open_[j + 1 :]), g, j) for j, g in enumerate(open_) if g >= lengths[k]]
        if len(open_) < least or not choices:
            choices.append((squares([*open_, capacity - lengths[k]]), capacity, len(open_)))
        best = min(choices, key=lambda c: (c[0], c[1]))
        where[k] = best[1] - lengths[k]
        open_[best[2] : best[2] + 1] = [best[1] - lengths[k]]
    return len(open_), sorted(open_)


def test_packing_follows_the_rule():
    rng = np.random.default_rng(8)
    for _ in range(20):
        lengths = rng.integers(1, 30, rng.integers(1, 60))
        sequence, offset = packing.pack_lengths(lengths, 30)
        gaps = sorted(30 - np.bincount(sequence, lengths).astype(int))
        assert (len(gaps), [int(g) for g in gaps]) == brute_pack(lengths.tolist(), 30)


def test_mixing_prefix_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 9)), rng.choice(["en", "fr", None]), f"src{rng.randrange(3)}") for i in range(400)]
    rows += [rows[5]] * 3 + [(None, "a b", "en", "src1"), (None, "a b c", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("EPOCH", F.lit("x")).withColumn("__d", F.lit(1))
    held = {}
    for _, t, lang, s in rows:
        leaf = (f"web{int(s[3:])}", lang, s)
        held[leaf] = held.get(leaf, 0) + len(t.split())
    given = mixing.budgets(held, 0.7 * sum(held.values()), 2, [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], 0.05)
    # places of rows in each epoch, from Spark's hash alone
    hashed = df.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"))
    hashed = hashed.select("*", *(F.shiftrightunsigned(F.xxhash64("h", F.lit(7), F.lit(e)), 1).alias(f"o{e}") for e in (0, 1))).collect()
    want = []
    for leaf, budget in given.items():
        mine = [r for r in hashed if (f"web{int(r.source[3:])}", r.lang, r.source) == leaf]
        whole, rest = min(2, budget // held[leaf]), budget % held[leaf]
        want += [(r.doc_id, r.text, r.lang, r.source, e) for r in mine for e in range(whole)]
        if whole < 2:
            for o in sorted({r[f"o{whole}"] for r in mine}):
                unit = [r for r in mine if r[f"o{whole}"] == o]
                rest -= sum(len(r.text.split()) for r in unit)
                if rest < 0:
                    break
                want += [(r.doc_id, r.text, r.lang, r.source, whole) for r in unit]
    for leaves in (mixing.DRIVER_LEAVES, 0):
        mixed = mixing.mix(df, budget_share=0.7, max_epochs=2, driver_leaves=leaves)
        assert mixed.columns == ["doc_id", "text", "lang", "source", "__d", "epoch"]
        assert sorted(((r.doc_id, r.text, r.lang, r.source, r.epoch) for r in mixed.collect()), key=str) == sorted(want, key=str)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "own\nfooter", "s", 7, "a", "b"), (2, "other\nfooter", "s", 8, "a", "b")], "doc_id long, text string, source string, Dropped_Lines int, `__lines` string, `__host` string")
    got = linededup.drop_boilerplate(df, F.col("source"))
    assert got.columns == ["doc_id", "text", "source", "__lines", "__host", "dropped_lines"]
    assert {(r.text, r["__lines"], r.dropped_lines) for r in got.collect()} == {("own", "a", 1), ("other", "a", 1)}


def test_quality_by_brute_force(spark):
    good = [f"a calm sentence about item {i} and its uses" for i in range(60)]
    bad = [f"buy now!!! $$$ {i}{i} CLICK http://x{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels, "quality", F.lit(True)).collect()}
    # the same learner in plain Python, a coordinate at a time
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows = sorted(((order[i], t, int(i < 60)) for i, t in enumerate(good + bad)), key=lambda r: (r[0], r[1]))
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= 0.05 else ((0.05 if v > 0 else -0.05) - v) / ((1 + n.get(k, 0.0) ** 0.5) / 0.5 + 0.5)

    for e in range(3):
        for j in np.random.default_rng(e).permutation(len(rows)).tolist():
            at = quality.features(rows[j][1]).tolist()
            x = dict.fromkeys(at, len(at) ** -0.5) | dict.fromkeys([*at[-quality.SHARES :], quality.BUCKETS], 1.0)
            p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in x.items())))
            w = {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - rows[j][2]) * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / 0.5 * w[k]
                n[k] = n.get(k, 0.0) + g * g
    for i, t in enumerate(good + bad):
        at = quality.features(t).tolist()
        s = weight(quality.BUCKETS) + sum(weight(k) * (1.0 if j >= len(at) - quality.SHARES else len(at) ** -0.5) for j, k in enumerate(at))
        assert abs(got[i] - 1 / (1 + np.exp(-s))) < 1e-4
        assert (got[i] >= 0.5) == (i < 60)


def test_toxicity_by_brute_force():
    """Decoding against all paths of a lattice."""
    from itertools import product

    rng = np.random.default_rng(4)
    words = frozenset(["idiot", "scum", "trash"])
    log = toxicity.Model(rng.integers(0, 50, 27**3).astype(float), words).log
    for token in ("1d10t", "$cum", "tr@@sh", "id!0t", "a8b6", "llool", "5-c-u-m", "x|y"):
        costs = {}
        for path in product(*toxicity.lattice(token)):
            text = "".join(x for x, _ in path)
            cost, a, b = sum(c for _, c in path), 0, 0
            for k in [*(ord(x) - 96 if "a" <= x <= "z" else 0 for x in text), 0]:
                cost -= log[a * 729 + b * 27 + k]
                a, b = b, k
            costs[text] = min(cost, costs.get(text, np.inf))
        assert abs(costs[toxicity.decode(token, log)] - min(costs.values())) < 1e-9


def test_sorted_lists_stop_early():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(4000, 3)) * [500, 3, 1])
    lists = topk.SortedLists(np.arange(4000), x)
    for (at, scores, depth), i in zip(lists.best(np.arange(20), x[:20], 10), range(20), strict=True):
        s = (x @ x[i]).astype(int)
        want = sorted((k for k in range(4000) if k != i), key=lambda k: (-s[k], k))[:10]
        assert at.tolist() == want and scores.tolist() == [s[k] for k in want]
        assert depth < 1


def test_topk_of_huge_components(spark):
    rows = [(20, [1e20, 1.0]), (1, [1e20, 2.0]), (2, [-1e20, 0.0]), (3, [1e-9, 5.0]), (4, [3.0e15, 1.0])]
    got = {(r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 20).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63), 3: int(64e20) * 0 + 64 * 320, 4: 2**63 - 1}


def test_searches_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [0.0, 1.0]), (3, [2.0, 1.0]), (4, [2.0, 1.0])], schema)
    for search in (topk.top_k, ann.nearest, lambda t, q: ann.nearest(t, q, rerank=None)):
        assert search(few.limit(0), lambda i: i % 20 == 0).count() == 0
        got = [(r.rank, r.vec_id) for r in search(few, lambda i: i == 0).orderBy("rank").collect()]
        assert got == [(1, 3), (2, 4), (3, 20), (4, 20)]
        assert search(few, lambda i: i == 77).count() == 0


def test_exact_search_and_recall(spark, sf):
    big = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    asked = lambda i: F.pmod(i, F.lit(20)) == 0
    found, exact = ({(r.query_id, r.vec_id) for r in ann.nearest(big, asked, rerank=n).collect()} for n in (64, None))
    assert len(found & exact) >= 0.95 * len(exact)
    x = {r.vec_id: np.array(r.embedding, float) for r in big.collect()}
    for q in sorted(x)[:60:20]:
        want = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        assert {i for a, i in exact if a == q} == set(want)


@pytest.mark.parametrize("kind", ["offset", "near copies", "uneven"])
def test_nearest_misses_none_on_other_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16))
    x = {"offset": (5 + x / 10) / np.linalg.norm(5 + x / 10, axis=1, keepdims=True), "near copies": rng.normal(size=(4, 16))[rng.integers(0, 4, 1200)] + x / 1000, "uneven": x * np.exp(3 * rng.normal(size=(1200, 1)))}[kind]
    x[600:700] = x[:100]
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, lambda i: i % 20 == 0, query_block=16, chunk=1024).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 1200, 20):
        s = sum(x[:, k] * x[q, k] for k in range(16))
        assert got[q] == [(i, s[i]) for i in sorted(set(range(1200)) - {q}, key=lambda i: (-s[i], i))[:20]]


def points_by_brute_force(html):
    """Points of containers in well-formed pages of divs and paragraphs, by recursion."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.points, self.made, self.text = [0], {}, 0, ""

        def handle_starttag(self, tag, attrs):
            self.made += 1
            self.path.append(self.made)
            self.text = ""

        def handle_data(self, data):
            self.text += data

        def handle_endtag(self, tag):
            if tag == "p" and self.text.strip():
                worth = 1 + self.text.count(",") + min(len(self.text.strip()) / 100, 3)
                for k, node in enumerate(self.path[-2::-1][:5]):
                    self.points[node] = self.points.get(node, 0) + worth * (1 if k == 0 else 1 / 2 if k == 1 else 1 / (3 * k))
            self.text = ""
            self.path.pop()

    r = Reader()
    r.feed(html)
    return sorted(round(v, 9) for v in r.points.values())


def test_points_are_passed_up():
    rng = random.Random(9)

    def page(depth):
        return "".join(f"<div>{page(depth - 1)}</div>" if depth and rng.random() < 0.5 else "<p>" + "word, " * rng.randrange(0, 60) + "x</p>" for _ in range(rng.randrange(1, 4)))

    for _ in range(30):
        html = page(7)
        root = htmltext.tree(html)
        got = htmltext.passed(htmltext.measure(root))
        assert sorted(round(x.points, 9) for x in got) == points_by_brute_force(html)


@pytest.mark.parametrize("html", ["<b>" * 50_000, "<nav>" + "<b>" * 50_000, "<div>" * 50_000 + "<p>x", "<i>" + "<div><b>" * 50_000 + "</i>" * 50_000, "<li><div>" + "<b>" * 50_000 + "</li>" * 50_000, "</x>" * 50_000, '<a "' * 50_000])
def test_deep_pages_take_linear_time(html):
    import time

    began = time.process_time()
    htmltext.main_text(html)
    assert time.process_time() - began < 5


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in htmltext.extract(pages).collect()] == [("", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0
