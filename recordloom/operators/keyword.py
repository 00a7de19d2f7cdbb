"""A boolean keyword language, compiled to one Column.

Grammar: terms are quoted phrases or bare words; AND binds before OR, neighbours are ANDed, case of the
operators doesn't matter, parentheses group.  A list of expressions is ORed, each parsed by itself, so an
unbalanced quote is an error where it stands.  No expression at all passes everything.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


class KeywordError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


SCAN = re.compile(r'\s*(?:"(?P<phrase>[^"]*)"|(?P<paren>[()])|(?P<word>[^\s()"]+))')


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = SCAN.match(text, at)
        if m is None:
            raise KeywordError(f"unbalanced quote at {at} in {text!r}")
        at = m.end()
        if m["paren"]:
            out.append((m["paren"], m["paren"]))
        elif m["word"] and m["word"].upper() in ("AND", "OR"):
            out.append((m["word"].upper(), m["word"]))
        else:
            out.append(("term", m["phrase"] if m["phrase"] is not None else m["word"]))
    return out


def parse(text: str):
    """The tree of one expression, None if it is blank."""
    rest = tokens(text)[::-1]
    if not rest:
        return None

    def either():
        parts = [both()]
        while rest and rest[-1][0] == "OR":
            rest.pop()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both():
        parts = [one()]
        while rest and rest[-1][0] not in ("OR", ")"):
            if rest[-1][0] == "AND":
                rest.pop()
            parts.append(one())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def one():
        if not rest:
            raise KeywordError(f"{text!r} ends where a term is due")
        kind, value = rest.pop()
        if kind == "term":
            return Term(value.strip().lower())
        if kind != "(":
            raise KeywordError(f"unexpected {value!r} in {text!r}")
        inner = either()
        if not rest or rest.pop()[0] != ")":
            raise KeywordError(f"missing ')' in {text!r}")
        return inner

    tree = either()
    if rest:
        raise KeywordError(f"unexpected {rest[-1][1]!r} in {text!r}")
    return tree


def ambiguous(text: str) -> bool:
    """AND and OR stand side by side outside parentheses."""
    depth, seen = 0, set()
    for kind, _ in tokens(text):
        depth += (kind == "(") - (kind == ")")
        if depth == 0:
            seen.add(kind)
    return {"AND", "OR"} <= seen


def term_matches(text: Column, term: str, whole_word: bool = False) -> Column:
    """Lower-cased text contains the term; whole words end at anything but a-z and 0-9.  An empty term matches nothing."""
    if not term:
        return F.lit(False)
    if whole_word:
        quoted = term.replace(r"\E", r"\E\\E\Q")
        return text.rlike(rf"(?<![a-z0-9])\Q{quoted}\E(?![a-z0-9])")
    return text.contains(term)


def matches(text: Column, expressions: str | Sequence[str] | None, whole_word: bool = False) -> Column:
    """The expressions, ORed, as a condition on text."""
    items = [expressions] if isinstance(expressions, str) else list(expressions or ())
    for x in items:
        if ambiguous(x):
            warnings.warn(f"AND and OR without parentheses in {x!r}: AND binds first", stacklevel=2)
    trees = [t for t in map(parse, items) if t is not None]
    low = F.lower(F.coalesce(text, F.lit("")))

    def compiled(tree) -> Column:
        if isinstance(tree, Term):
            return term_matches(low, tree.text, whole_word)
        out = compiled(tree.parts[0])
        for p in tree.parts[1:]:
            out = out & compiled(p) if isinstance(tree, Both) else out | compiled(p)
        return out

    return compiled(Either(tuple(trees))) if trees else F.lit(True)


#: fixed values: what a decision is put down to
LISTED, EXCLUDED, UNMATCHED, KEPT = "include-papers override", "matched exclude-keywords", "did not match keywords", "kept (matched keywords or no keyword filter set)"


def decision(title: Column, text: Column, keywords=None, exclude=None, keep_titles: Sequence[str] = (), whole_word: bool = False) -> Column:
    """struct(keep, reason): titles to keep, then what excludes, then what includes, then the default."""
    listed = F.lower(X.strip(title)).isin(*(t.strip().lower() for t in keep_titles)) if keep_titles else F.lit(False)
    verdict = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))
    out = F.when(listed, verdict(True, LISTED))
    if exclude:
        out = out.when(matches(text, exclude, whole_word), verdict(False, EXCLUDED))
    if keywords:
        out = out.when(~matches(text, keywords, whole_word), verdict(False, UNMATCHED))
    return out.otherwise(verdict(True, KEPT))
