"""Facet rules: flags, score, band and explanation, from a configuration of patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pattern_label


@dataclass(frozen=True)
class Facets:
    facets: Mapping[str, Sequence[str]]
    strong: Sequence[str] = ()
    off: Sequence[str] = ()
    compounds: Sequence[tuple[str, str]] = ()
    literal: str | None = None
    #: the facet that bands 2 and 3 look for
    primary: str = ""
    labels: int = field(default=3)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """One alternation: a text is scanned once."""
    return text.rlike("(?U)(?:" + "|".join(patterns) + ")") if patterns else F.lit(False)


def facet_names(text: Column, rules: Facets) -> Column:
    """Names of the facets that match, sorted."""
    flags = [F.when(any_match(text, p), F.lit(name)) for name, p in sorted(rules.facets.items())]
    return F.array_compact(F.array(*flags))


def evidence(title: Column, ext: Column, rules: Facets) -> dict[str, Column]:
    """What the patterns find: title_facets, ext_facets, strong (a count), literal, compound, off, labels."""
    t, x = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(ext, F.lit("")))
    strong = reduce(lambda a, b: a + b, [(t.rlike("(?U)" + p) | x.rlike("(?U)" + p)).cast("int") for p in rules.strong], F.lit(0))
    literal = t.rlike("(?U)" + rules.literal) if rules.literal else F.lit(False)
    pairs = [t.rlike("(?U)" + a) & t.rlike("(?U)" + b) for a, b in rules.compounds]
    labels = []
    for name, patterns in sorted(rules.facets.items()):
        hits = F.array_compact(F.array(*(F.when(t.rlike("(?U)" + p), F.lit(pattern_label(p))) for p in patterns)))
        labels.append(F.when(F.size(hits) > 0, F.concat(F.lit(name + ":"), F.array_join(F.slice(hits, 1, rules.labels), ","))))
    return {
        "title_facets": facet_names(t, rules),
        "ext_facets": F.when(x != "", facet_names(x, rules)).otherwise(F.array().cast("array<string>")),
        "strong": strong, "literal": literal, "compound": reduce(lambda a, b: a | b, pairs, F.lit(False)) & ~literal,
        "off": any_match(t, rules.off), "labels": F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>"),
    }


def decided(e: Mapping[str, Column], rules: Facets) -> dict[str, Column]:
    """title_facets, all_facets, score, band, why from the evidence."""
    on_title, on_ext, strong, compound = e["title_facets"], e["ext_facets"], e["strong"], e["compound"]
    both = F.array_sort(F.array_union(on_title, on_ext))
    n_title, n_all = F.size(on_title), F.size(both)
    off = e["off"] & (n_title < 2) & (strong == 0) & ~compound
    score = 3 * n_title + 2 * (n_all - n_title) + 4 * strong + 3 * compound.cast("int") - 3 * off.cast("int")
    primary = F.array_contains(on_title, rules.primary)
    band = (
        F.when((strong > 0) | compound | (n_title >= 2), 1)
        .when((n_all >= 2) & (primary | (n_title == 1)), 2)
        .when(primary, 3)
        .when((n_title == 1) | (F.size(on_ext) > 0), 4)
        .otherwise(5)
    )
    band = F.when(e["literal"] & (n_title < 2), 5).otherwise(band)
    band = F.when(off & ~primary, F.least(band + 1, F.lit(5))).otherwise(band)
    # COMPOUND; FACET:label,label; abs:FACET+FACET, or '-'
    more = F.array_sort(F.array_except(on_ext, on_title))
    ends = F.array_compact(F.array(F.when(F.size(more) > 0, F.concat(F.lit("abs:"), F.array_join(more, "+")))))
    text = F.array_join(F.concat(F.array_compact(F.array(F.when(compound, F.lit("COMPOUND")))), e["labels"], ends), "; ")
    return {"title_facets": on_title, "all_facets": both, "score": score, "band": band, "why": F.when(text == "", F.lit("-")).otherwise(text)}


def scored(title: Column, ext: Column, rules: Facets) -> dict[str, Column]:
    """Columns title_facets, all_facets, score, band, why; ext is abstract and keywords.  Each of them scans the text again; ``with_bands`` scans it once."""
    return decided(evidence(title, ext, rules), rules)


def with_bands(rows: DataFrame, title: Column, ext: Column, rules: Facets) -> DataFrame:
    """The rows with the columns of ``scored``.  The evidence is a step of its own, so that a text is scanned once for all columns."""
    found = evidence(title, ext, rules)
    first = rows.select("*", *(c.alias(f"__{n}") for n, c in found.items()))
    made = decided({n: F.col(f"__{n}") for n in found}, rules)
    return first.select(*rows.columns, *(c.alias(n) for n, c in made.items()))


def borderline(text: Column, decision: Column, relevance: Column, high: Sequence[str], timing: Sequence[str], languages: Sequence[str]) -> Column:
    """Relevance 2 or 3 with a high-interest term, or not included though timing and a language are named."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (relevance.isin(2, 3) & any_match(t, high)) | ((decision != "include") & any_match(t, timing) & any_match(t, languages))
