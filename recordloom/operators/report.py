"""Report pages, run counters and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import latex


def pages(records: DataFrame, number: Column, total: Column, title: Column, about: Sequence[Column], keywords: Column, abstract: Column, rounds: Column, final: Column) -> DataFrame:
    """record, page: a LaTeX page for each record, made where its row is.

    It shows where the record appeared, its keywords and abstract (or that it has none), what each round decided
    (an array of structs label, decision, criterion, relevance, reason), the final decision, and boxes to agree or not.
    """
    nonblank = lambda c: F.nullif(latex(c), F.lit(""))
    line = lambda before, c, after="": F.concat(F.lit(before), c, F.lit(after))
    place = F.nullif(F.array_join(F.array_compact(F.array(*map(nonblank, about))), r" \textbullet{} "), F.lit(""))
    shown = F.when(abstract == "(not available)", None).otherwise(nonblank(abstract))
    told = F.array_join(F.transform(rounds, lambda r: F.concat(
        F.lit(r"\paragraph{"), latex(r["label"]), F.lit("} "), latex(r["decision"]), F.lit(", criterion "), latex(r["criterion"]), F.lit(", relevance "), latex(r["relevance"]), F.lit(" of 5: "), latex(r["reason"]))), "\n")
    page = F.concat_ws(
        "\n", F.concat(F.lit(r"\section*{Record "), number.cast("string"), F.lit(" of "), total.cast("string"), F.lit("}")), line(r"\textbf{", latex(title), "}"), line(r"\emph{", place, "}"),
        line(r"\paragraph{Keywords} ", nonblank(keywords)), F.coalesce(line(r"\paragraph{Abstract} ", shown), F.lit(r"\emph{Without an abstract; the title alone was judged.}")), F.nullif(told, F.lit("")),
        line(r"\paragraph{Final decision} ", latex(final)), F.lit(r"$\square$ agree \quad $\square$ disagree, because: \hrulefill"), F.lit(r"\newpage"))
    return records.select(number.alias("record"), page.alias("page"))


def counters(rows: DataFrame, excluded: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(excluded).alias("excluded"), F.count_if(~excluded).alias("remaining"))


def observed(rows: DataFrame, failed: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counts of done and failed ones that the next action over them fills in without a pass of its own."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(failed).alias("failed")), seen
