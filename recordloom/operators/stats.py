"""Counts, summaries, trends and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .ranks import numbered

#: groups whose counts are broadcast
GROUPS = 100_000
#: the shares of a group that the bracket of its median has on either side
BRACKET = 0.01


def summary(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """Mean, median, extremes and sample deviation (null for a single row).

    The median is exact, and no buffer holds a group: approximate quantiles bracket it, values below the bracket are counted, and only those
    inside are put in order, in ranges.  A group whose middle is not in its bracket (no bound is taken on trust) is put in order whole.
    """
    fs = {"mean": F.avg, "low": F.min, "high": F.max, "deviation": F.stddev_samp}
    pairs = rows.select(F.col(by).alias("g"), value.alias("v"))
    around = F.percentile_approx("v", [0.5 - BRACKET, 0.5 + BRACKET], int(4 / BRACKET))
    base = stored(pairs.groupBy(F.col("g").alias("h")).agg(F.count("v").alias("n"), *(f("v").alias(n) for n, f in fs.items()), around.alias("q")))
    side = F.broadcast(base) if base.count() <= GROUPS else base
    joined = pairs.where("v is not null").join(side.select("h", "n", F.col("q")[0].alias("q0"), F.col("q")[1].alias("q1")), F.col("g").eqNullSafe(F.col("h")))
    counts = joined.groupBy("h", "n").agg(F.count_if(F.col("v") < F.col("q0")).alias("below"), F.count_if(F.col("v") <= F.col("q1")).alias("upto"))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    counts = stored(counts.select("h", "below", ((F.col("below") <= first) & (second < F.col("upto"))).alias("good")))
    known = F.broadcast(counts.withColumnRenamed("h", "k")) if counts.count() <= GROUPS else counts.withColumnRenamed("h", "k")
    inside = joined.join(known, F.col("h").eqNullSafe(F.col("k"))).where(~F.col("good") | F.col("v").between(F.col("q0"), F.col("q1")))
    placed = numbered(inside.select("g", "v", "n", F.when(F.col("good"), F.col("below")).otherwise(0).alias("below")), [F.col("g"), F.col("v")], "p")
    starts = placed.groupBy("g").agg(F.min("p").alias("start")).withColumnRenamed("g", "k")
    starts = F.broadcast(starts) if counts.count() <= GROUPS else starts
    at = F.col("p") - F.col("start") + F.col("below")
    middle = placed.join(starts, F.col("g").eqNullSafe(F.col("k"))).where((at == first) | (at == second))
    median = middle.groupBy(F.col("g").alias("k")).agg(F.avg("v").alias("median"))
    return base.join(median, F.col("h").eqNullSafe(F.col("k")), "left").select(F.col("h").alias(by), "n", "mean", "median", "low", "high", "deviation")


def coverage(condition: Column) -> Column:
    """Share of rows; null for none."""
    return F.avg(condition.cast("int"))


def trend(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(x).alias("most"))


def trend_points(line: DataFrame, points: int = 200) -> DataFrame:
    """Evenly spaced points from 0 to the greatest x."""
    step = F.col("most") / (points - 1)
    return line.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("i", (F.col("i") * step).alias("x"), (F.col("slope") * F.col("i") * step + F.col("intercept")).alias("y"))


def confusion(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts yy, yn, ny, nn of two raters in one pass; null ratings are left out."""
    ok = rows.where(a.isNotNull() & b.isNotNull())
    return ok.agg(*(F.count_if((a if p == "y" else ~a) & (b if q == "y" else ~b)).alias(p + q) for p in "yn" for q in "yn"))


def kappa(table: DataFrame) -> DataFrame:
    """Agreement beyond chance, its error and 95 % interval in [-1, 1], and a word for it; null where undefined."""
    n = F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")
    t = table.withColumn("n", n).withColumns({"po": F.try_divide(F.col("yy") + F.col("nn"), F.col("n"))})
    chance = (F.col("yy") + F.col("yn")) * (F.col("yy") + F.col("ny")) + (F.col("ny") + F.col("nn")) * (F.col("yn") + F.col("nn"))
    t = t.withColumn("pe", F.try_divide(chance.cast("double"), F.col("n").cast("double") * F.col("n")))
    t = t.withColumn("kappa", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    error = F.when(F.col("po").isin(0.0, 1.0), 0.0).otherwise(F.sqrt(F.col("po") * (1 - F.col("po")) / (F.col("n") * (1 - F.col("pe")) ** 2)))
    t = t.withColumn("se", F.when(F.col("kappa").isNotNull(), error))
    k = F.col("kappa")
    # fixed values: words of agreement and their bounds
    word = F.when(k < 0.2, "poor").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").when(k.isNotNull(), "almost perfect")
    return t.withColumns({"low": F.greatest(F.lit(-1.0), k - 1.96 * F.col("se")), "high": F.least(F.lit(1.0), k + 1.96 * F.col("se")), "band": word})


def disagreements(rows: DataFrame, decision: str, disagree: Column) -> DataFrame:
    """decision, n: how many of each automated decision the reviewer disagreed with."""
    return rows.where(disagree).groupBy(decision).agg(F.count("*").alias("n"))


def from_disagreements(rows: DataFrame, decision: Column, disagree: Column) -> DataFrame:
    """The table yy, yn, ny, nn of automated decision and reviewer: a disagreement means that the reviewer took the other view."""
    yes = decision == "include"
    listed = rows.where(decision.isin("include", "exclude"))
    return confusion(listed, yes, yes != disagree)


#: fixed values: what is added in turn
POOL = (1, 2, 4, 9, 8, 4, 5)


def range_sums(spark, n: int) -> DataFrame:
    """Sum of 0..n-1, its closed form, the sum with a cyclic pool added, and the count."""
    pool = F.element_at(F.array(*(F.lit(p).cast("long") for p in POOL)), (F.col("id") % len(POOL) + 1).cast("int"))
    return spark.range(n).agg(F.sum("id").alias("total"), F.sum(F.col("id") + pool).alias("pooled"), F.count("*").alias("counted")).withColumn("closed", F.lit(n * (n - 1) / 2))
