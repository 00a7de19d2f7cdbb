"""Mixing sources to target weights by hierarchical budgeting.

Weights are propagated through a tree domain -> language -> source.  A node's budget is dealt to its
children by weight, and no child gets more than it holds (its tokens times ``max_epochs``).  What a
child cannot take goes to its siblings by weight; only when all children are full does a shortage
remain with the parent, which then is full itself and leaves it to its own siblings.  That is the
filling of each node top-down under the capacities summed bottom-up.

Each leaf's budget is spent as whole epochs plus a token-prefix of the next: rows ordered by a seeded
hash of doc_id and text, as many whole rows as fit.  The prefix is a threshold on that hash: token sums of
256 hash ranges for each leaf find the range where the budget ends, sums of 256 ranges within it narrow it, once more for one in
16 million, and only the rows left there are ordered, so a leaf that
holds a third of all rows is never sorted in a task.  Tokens are counted once; the final pass compares hashes.

Up to ``DRIVER_LEAVES`` leaves are dealt on the driver, more by the same rule as rounds of sums over a table of leaves.

Cases: null domain, language or source are values of their own; a null text has no tokens; rows
without tokens come with any prefix that reaches their place, and a leaf without any token gives none; repeated rows (equal doc_id and
text) come together or not at all, and null doc_ids are ordered by their text; unlisted children get ``default_weight``; an empty table gives an empty result; columns
of the input are kept and ``epoch`` is added, in place of a column of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stored, temporary

#: where the bits begin that name a range, 8 of 63 at a time
SHIFTS = (55, 47, 39)
#: so many leaves at most reach the driver
DRIVER_LEAVES = 100_000

DOMAIN_WEIGHTS = {"web0": 0.4, "web1": 0.3, "web2": 0.2, "web3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four."""
    digits = F.try_cast(F.regexp_extract(source, r"(\d{1,9})$", 1), "int") if hasattr(F, "try_cast") else F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int")
    return F.concat(F.lit("web"), F.pmod(digits, F.lit(4)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def deal(amount: float, children: Mapping, weight: Callable, capacity: Callable) -> dict:
    """``amount`` to children by weight, none above its capacity; the overflow goes to the others."""
    given, active, left = {}, dict.fromkeys(children), float(amount)
    while active:
        total = sum(weight(c) for c in active)
        full = [c for c in active if total <= 0 or left * weight(c) / total >= capacity(c)] if total > 0 else []
        if not full:
            given |= {c: left * weight(c) / total if total > 0 else 0.0 for c in active}
            break
        for c in full:
            given[c] = capacity(c)
            del active[c]
        left = max(0.0, amount - sum(given.values()))
    return given


def budgets(leaves: dict[tuple, int], budget: float, max_epochs: int, weights: list[Mapping], default_weight: float) -> dict[tuple, int]:
    """The tokens of each leaf (domain, language, source), given the tokens it holds."""
    nodes: dict[tuple, set] = {}
    capacity: dict[tuple, float] = {}
    for leaf, tokens in leaves.items():
        for depth in range(len(leaf) + 1):
            node = leaf[:depth]
            capacity[node] = capacity.get(node, 0) + tokens * max_epochs
            if depth:
                nodes.setdefault(leaf[: depth - 1], set()).add(node)
    given = {(): min(float(budget), capacity.get((), 0))}
    for depth in range(3):
        for node in [n for n in given if len(n) == depth]:
            order = sorted(nodes.get(node, ()), key=str)
            given |= deal(given[node], dict.fromkeys(order), lambda c: weights[len(c) - 1].get(c[-1], default_weight), lambda c: capacity[c])
    return {n: int(v + 1e-6) for n, v in given.items() if len(n) == 3}


def spread(leaves: DataFrame, budget: float, max_epochs: int, weights: list[Mapping], default_weight: float) -> DataFrame:
    """``budgets`` for any number of leaves: k0, k1, k2, t with ``given``, as rounds of sums."""
    keys = ["k0", "k1", "k2"]
    name = lambda n: F.concat_ws("\x00", F.lit(""), *(F.coalesce(k, F.lit("\x01")) for k in keys[:n]))
    base = stored(leaves.select(*keys, "t", (F.col("t") * max_epochs).cast("double").alias("cap")))
    given = base.agg(F.least(F.coalesce(F.sum("cap"), F.lit(0.0)), F.lit(float(budget))).alias("given")).select(F.lit("").alias("node"), "given")
    for depth in range(1, 4):
        listed = weights[depth - 1]
        weight = reduce(lambda rest, kv: F.when(F.col(keys[depth - 1]).eqNullSafe(F.lit(kv[0])), float(kv[1])).otherwise(rest), listed.items(), F.lit(float(default_weight)))
        children = base.groupBy(name(depth - 1).alias("up"), name(depth).alias("node"), weight.alias("w")).agg(F.sum("cap").alias("cap"))
        children = stored(children.join(given.select(F.col("node").alias("up"), F.col("given").alias("amount")), "up").withColumn("full", F.lit(False)))
        while True:
            open_ = children.groupBy("up").agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("used"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("total"))
            share = F.try_divide(F.greatest(F.lit(0.0), F.col("amount") - F.coalesce("used", F.lit(0.0))) * F.col("w"), F.col("total"))
            turn = stored(children.join(open_, "up").withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("more", ~F.col("full") & (F.col("total") > 0) & (F.col("share") >= F.col("cap"))))
            if turn.where("more").isEmpty():
                break
            children = turn.withColumn("full", F.col("full") | F.col("more")).select("up", "node", "w", "cap", "amount", "full")
        given = turn.select("node", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share")).alias("given"))
    return base.withColumn("node", name(3)).join(given, "node").select(*keys, "t", F.floor(F.col("given") + 1e-6).cast("long").alias("given"))


def mix(docs: DataFrame, budget_share: float = 1.0, max_epochs: int = 4, seed: int = 7, domains: Mapping = DOMAIN_WEIGHTS, languages: Mapping = LANGUAGE_WEIGHTS, sources: Mapping | None = None, default_weight: float = 0.05, driver_leaves: int = DRIVER_LEAVES) -> DataFrame:
    """Rows of ``docs``, once for each epoch that takes them, with ``epoch`` from 0."""
    with temporary(docs.sparkSession):
        return _mix(docs.drop("epoch"), budget_share, max_epochs, seed, [domains, languages, sources or {}], default_weight, driver_leaves)


def _mix(docs: DataFrame, budget_share: float, max_epochs: int, seed: int, weights: list[Mapping], default_weight: float, driver_leaves: int) -> DataFrame:
    spark = docs.sparkSession
    leaf = [domain_of(F.col("source")), F.col("lang"), F.col("source")]
    own = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keys = ["k0", "k1", "k2"]
    narrow = stored(docs.select(*(c.cast("string").alias(k) for k, c in zip(keys, leaf, strict=True)), own.alias("h"), token_count(F.col("text").cast("string")).alias("t")))
    leaves = narrow.groupBy(*keys).agg(F.sum("t").alias("t"))
    leaves = stored(leaves)
    count, total = leaves.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0))).head()
    if count <= driver_leaves:
        held = {(r.k0, r.k1, r.k2): r.t for r in leaves.collect()}
        given = budgets(held, budget_share * total, max_epochs, weights, default_weight)
        dealt = spark.createDataFrame([(*k, t, given[k]) for k, t in held.items()], "k0 string, k1 string, k2 string, t long, given long")
    else:
        dealt = spread(leaves, budget_share * total, max_epochs, weights, default_weight)
    epochs = F.least(F.lit(max_epochs), F.coalesce(F.expr("given div nullif(t, 0)"), F.lit(0))).cast("int")
    plan = dealt.withColumn("whole", epochs).select(*keys, "whole", F.when(F.col("whole") < max_epochs, F.coalesce(F.expr("given % nullif(t, 0)"), F.lit(0))).otherwise(0).alias("rest"))
    small = F.broadcast if count <= driver_leaves else lambda df: df

    def on_leaf(left: DataFrame, right: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
        return left.alias("a").join(small(right).alias("b"), same).select("a.*", *(f"b.{c}" for c in right.columns if c not in keys))

    # place: 63 bits of a hash of the row and its epoch; 8 of them name a range, the next 8 a range within it
    place = lambda h, whole: F.shiftrightunsigned(F.xxhash64(h, F.lit(seed), whole), 1)
    rows = on_leaf(narrow, plan.where("rest > 0")).withColumn("o", place(F.col("h"), F.col("whole")))
    ends = plan.where("rest > 0").select(*keys, F.lit(0).cast("long").alias("low"), F.col("rest").alias("left"))
    for shift in SHIFTS:
        inside = on_leaf(rows, ends).where(F.shiftright("o", shift + 8) == F.shiftright("low", shift + 8)).withColumn("range", F.shiftright("o", shift))
        sums = inside.groupBy(*keys, "left", "range").agg(F.sum("t").alias("t"))
        # a window of 256 rows for each leaf
        upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("range"))
        over = sums.withColumn("u", upto).where("u > left").groupBy(*keys).agg(F.min(F.struct("range", (F.col("left") - F.col("u") + F.col("t")).alias("left"))).alias("m"))
        ends = stored(over.select(*keys, F.shiftleft(F.col("m.range"), shift).alias("low"), F.col("m.left").alias("left")))
    units = on_leaf(rows, ends).where(F.shiftright("o", SHIFTS[-1]) == F.shiftright("low", SHIFTS[-1])).groupBy(*keys, "low", "left", "o").agg(F.sum("t").alias("t"))
    fits = units.withColumn("u", F.sum("t").over(Window.partitionBy(*keys).orderBy("o"))).where("u <= left").groupBy(*keys).agg(F.max("o").alias("last"))
    limits = on_leaf(ends.select(*keys, "low"), plan).alias("a").join(fits.alias("b"), reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "left")
    limits = limits.select(*(f"a.{k}" for k in keys), F.coalesce("last", F.col("low") - 1).alias("limit"))
    plan = plan.alias("a").join(limits.alias("b"), reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "left").select("a.*", "b.limit")
    plan = stored(plan, outlive=True)
    names = spare(docs.columns, "__d", "__l", "__s")
    wanted = spare(docs.columns, "__whole", "__limit", "__dd", "__ll", "__ss")
    side = small(plan.select("whole", "limit", *keys).toDF(*wanted))
    keyed = docs.withColumns({n: c.cast("string") for n, c in zip(names, leaf, strict=True)})
    joined = keyed.join(side, reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(w)) for n, w in zip(names, wanted[2:], strict=True))))
    taken = F.when(F.col(wanted[0]) > 0, F.sequence(F.lit(0), F.col(wanted[0]) - 1)).otherwise(F.array().cast("array<int>"))
    more = F.when(place(own, F.col(wanted[0])) <= F.col(wanted[1]), F.array(F.col(wanted[0]))).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("epoch", F.explode(F.concat(taken, more))).select(*docs.columns, "epoch")
