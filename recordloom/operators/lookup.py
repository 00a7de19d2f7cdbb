"""Lookups as joins.  Sides are left to the planner to broadcast, by their size at run time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import stored


def exclude_listed(records: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> DataFrame:
    """Records whose key isn't listed; blank keys are never excluded and blank list entries exclude nothing."""
    side = listed.select(F.nullif(listed_key, F.lit("")).alias("__x")).where("__x is not null").distinct()
    return records.withColumn("__x", F.nullif(key, F.lit(""))).join(side, "__x", "left_anti").drop("__x")


def only_listed(records: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> DataFrame:
    side = listed.select(listed_key.alias("__x")).distinct()
    return records.withColumn("__x", key).join(side, "__x", "left_semi").drop("__x")


def flag_listed(records: DataFrame, key: Column, listed: DataFrame, listed_key: Column, name: str) -> DataFrame:
    side = listed.select(listed_key.alias("__x")).distinct().withColumn(name, F.lit(True))
    return records.withColumn("__x", key).join(side, "__x", "left").drop("__x").withColumn(name, F.coalesce(name, F.lit(False)))


def backfill(records: DataFrame, target: str, cache: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Blank targets from cache (key, value), by the first key that is found; ``filled`` tells which."""
    side = cache.groupBy("key").agg(F.min("value").alias("value"))
    out = records
    for k, key in enumerate(keys):
        out = out.withColumn(f"__k{k}", F.when(F.coalesce(F.trim(target), F.lit("")) == "", key)).join(side.select(F.col("key").alias(f"__k{k}"), F.col("value").alias(f"__v{k}")), f"__k{k}", "left")
    found = F.coalesce(*(F.nullif(F.col(f"__v{k}"), F.lit("")) for k in range(len(keys))))
    own = F.nullif(F.trim(target), F.lit(""))
    return out.withColumns({"filled": own.isNull() & found.isNotNull(), target: F.coalesce(F.when(own.isNotNull(), F.col(target)), found, F.lit(""))}).select(*records.columns, "filled")


def side_value(records: DataFrame, key: Column, index: DataFrame, value: str, default: str = "") -> DataFrame:
    """Records with ``value`` from an index (key, value) of one row a key, or the default."""
    side = index.select(F.col("key").alias("__i"), F.col(value).alias("__v"))
    return records.withColumn("__x", key).join(side, F.col("__x") == F.col("__i"), "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__x", "__i", "__v")


def fallback_chain(missing: DataFrame, key: str, resolvers: Sequence[Callable[[DataFrame], DataFrame]], least: Sequence[int] | None = None) -> DataFrame:
    """key, value, stage: each resolver (rows -> key, value) sees only what the ones before didn't find.

    A value counts if it isn't blank and longer than the stage's ``least`` (0).  What a stage found is stored, so that no resolver is asked twice.
    """
    out, left = None, missing
    for stage, resolve in enumerate(resolvers):
        got = stored(resolve(left).where(F.length(F.coalesce("value", F.lit(""))) > (least[stage] if least else 0)).select(key, "value", F.lit(stage).alias("stage")))
        out = got if out is None else out.unionByName(got)
        left = left.join(got, key, "left_anti")
    return out


def wanted(records: DataFrame, doi: Column, abstract: Column, cache: DataFrame) -> DataFrame:
    """The distinct DOIs, sorted, of records that have one, lack an abstract and aren't in the cache (key, value)."""
    lacking = records.select(F.lower(X.strip(doi)).alias("doi"), X.strip(abstract).alias("a")).where("doi <> '' and coalesce(a, '') = ''")
    return not_cached(lacking.select("doi"), F.col("doi"), cache).distinct().orderBy("doi")


def merged_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """key, value of a cache and what was found; known keys keep their value, and of several finds of a key the least counts."""
    new = found.groupBy("key").agg(F.min("value").alias("value")).join(cache, "key", "left_anti")
    return cache.select("key", "value").unionByName(new)


def not_cached(records: DataFrame, key: Column, cache: DataFrame) -> DataFrame:
    return exclude_listed(records, key, cache, F.col("key"))


def later_stands(*rounds: Column) -> Column:
    """The value of the last round that has one."""
    return F.coalesce(*reversed(rounds))


def first_hits(records: DataFrame, title: str, order: Sequence[Column], patterns: DataFrame | Sequence[str], key: str) -> DataFrame:
    """pattern, key: in turn, each pattern's first record in the order that no pattern before it has taken.

    patterns is a configuration, and all of it is used.  Each pattern's first few hits come to the driver, more
    of them only while some pattern finds all of its own taken.
    """
    spark = records.sparkSession
    listed = [r[0] for r in patterns.select("pattern").collect()] if isinstance(patterns, DataFrame) else list(patterns)
    kind = records.schema[key].dataType.simpleString()
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(listed)), "i int, pattern string"))
    first = F.row_number().over(Window.partitionBy("i").orderBy(*order))
    hits = records.join(numbers, F.expr(f"`{title}` rlike pattern")).withColumn("r", first)
    few = 4
    while True:
        by: dict[int, list] = {}
        for h in hits.where(F.col("r") <= few).select("i", "r", F.col(key).alias("k")).collect():
            by.setdefault(h.i, []).append((h.r, h.k))
        taken: dict = {}
        for i in range(len(listed)):
            got = next((k for _, k in sorted(by.get(i, ()), key=lambda x: x[0]) if k not in taken), None)
            if got is not None:
                taken[got] = i
            elif len(by.get(i, ())) == few:
                break
        else:
            return spark.createDataFrame([(listed[i], k) for k, i in taken.items()], f"pattern string, `{key}` {kind}")
        few *= 4


def alike(names: DataFrame, name: str, least: float) -> DataFrame:
    """a < b: the pairs of distinct names whose shared characters allow 2 M / T to reach ``least``, which is above 0.

    M is at most the number of characters in common, each counted as often as in both.  So both lengths are at
    least ``least / (2 - least)`` of one another, a name shares at least that part of its characters with the
    other, and two names that share so many have one in common among the rarest of each (prefix filter).
    """
    each = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))
    nth = F.transform(each, lambda x, i: F.concat(x, F.size(F.filter(F.slice(each, 1, i + 1), lambda y: y == x)).cast("string")))
    named = names.where(F.length(name) > 0).select(F.col(name).alias("a"), nth.alias("chars"))
    chars = named.select("a", F.explode("chars").alias("c"))
    ranked = chars.join(chars.groupBy("c").agg(F.count("*").alias("n")), "c").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("chars"))
    due = F.ceil(F.lit(least / (2 - least)) * F.size("chars") - 1e-9).cast("int")
    ranked = ranked.select("a", F.col("chars")["c"].alias("chars"), F.slice(F.col("chars")["c"], 1, F.size("chars") - F.greatest(due, F.lit(1)) + 1).alias("first"))
    left = ranked.select("a", F.col("chars").alias("__a"), F.col("first").alias("__p"), F.explode("first").alias("__c"))
    right = ranked.select(F.col("a").alias("b"), F.col("chars").alias("__b"), F.col("first").alias("__q"), F.explode("first").alias("__c"))
    total, shared = F.size("__a") + F.size("__b"), F.size(F.array_intersect("__a", "__b"))
    # a pair comes once, from the first character that both prefixes hold
    once = F.array_min(F.array_intersect("__p", "__q")) == F.col("__c")
    return left.join(right, "__c").where("a < b").where((2 * F.least(F.size("__a"), F.size("__b")) >= least * total) & once & (2 * shared >= least * total)).select("a", "b")


def guarded_match(pairs: DataFrame, a: Column, b: Column, ratio: Callable[[Column, Column], Column], least: float = 0.85) -> DataFrame:
    """Pairs whose ratio reaches the threshold; a bound by lengths spares most ratios: 2 min / (a + b)."""
    la, lb = F.length(a), F.length(b)
    return pairs.where(2 * F.least(la, lb) >= least * (la + lb)).withColumn("ratio", ratio(a, b)).where(F.col("ratio") >= least)


def best_match(pairs: DataFrame, a: str, b: str, ratio: str = "ratio") -> DataFrame:
    """Each a with its likeliest b; of equal ratios the least b."""
    best = F.min_by(F.struct(b, ratio), F.struct(-F.col(ratio), F.col(b)))
    return pairs.groupBy(a).agg(best.alias("m")).select(a, f"m.{b}", f"m.{ratio}")
