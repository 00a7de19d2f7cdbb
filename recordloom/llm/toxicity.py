"""Toxicity by noisy-channel deobfuscation.

A disguised token is a character lattice: a leet sign may stand for letters or for nothing, a repeated
letter for one or two, marks between letters for nothing, a lone letter among lone letters for a part
of a word or a word.  A trigram model of the characters of all documents, with a cost for each disguise, picks
the path by Viterbi decoding; a token with a single path is itself.  Then restored text is scored: the
score is the logistic function of a bias and the weights of distinct lexicon words that it holds.

The lexicon is learned from a bounded sample of labelled rows (labelled.SAMPLE, SAMPLE_CHARS).  A word counts by the different
neighbours it has been seen between, so that a passage copied a thousand times counts as one, and
enters if it is nearly always toxic.  The language model is 27**3 counts summed over all documents.

Cases: a null or empty text holds no words and gets the score of the bias; repeated rows get equal
scores; without usable labels the lexicon is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back
from .labelled import SAMPLE, sample, within

#: fixed values: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "§": "s",
}
#: costs in nats: a sign read as a letter, a sign or mark read as nothing, a repeated letter dropped, kept
SIGN, MARK, DROPPED, KEPT = 0.5, 1.0, 0.5, 1.5
TRIPLE = re.compile(r"([a-z])\1\1|([a-z])\2.*?([a-z])\3")
DOUBLE = re.compile(r"([a-z])\1+")
EDGE = ".,;:!?\"'`#%&*^~_-=/\\()[]{}<>|…«»“”‘’„"
MEMO = 100_000
#: texts are handed to Python in batches of so many bytes
BATCH = "8m"
#: characters counted at a time
SLICE = 1 << 20
ALPHABET = np.zeros(256, np.int32)
for _c in range(26):
    ALPHABET[97 + _c] = ALPHABET[65 + _c] = 1 + _c


def trigrams(texts: DataFrame) -> np.ndarray:
    """Counts of three neighbouring characters (letters, or 0 for all else) over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(27**3, np.int64)
        for b in batches:
            raw = np.frombuffer("  ".join(t for t in b["text"] if t).encode("utf-8", "replace"), np.uint8)
            # the counting takes 25 bytes a character, so it is done by slices that overlap by two
            for k in range(0, len(raw) - 2, SLICE):
                c = ALPHABET[raw[k : k + SLICE + 2]]
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"g": at, "n": total[at]})
        give_back()

    counts = np.zeros(27**3)
    # at most 27**3 rows
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        counts[r.g] = r.n
    return counts


class Model:
    """Log-probabilities of a character after two others, interpolated with shorter histories.

    Words of a lexicon count as more of the text than they are, since that is what disguises hide.
    """

    def __init__(self, counts: np.ndarray, lexicon: frozenset[str] | set[str] = frozenset()):
        c = counts.reshape(27, 27, 27).copy()
        for w in sorted(lexicon):
            if w.isascii() and w.isalpha():
                k = [0, 0, *(ord(x) - 96 for x in w), 0]
                for a in zip(k, k[1:], k[2:], strict=False):
                    c[a] += counts.sum() * 3e-4
        one = (c.sum((0, 1)) + 1) / (c.sum() + 27)
        two = (c.sum(0) + 50 * one) / (c.sum((0, 2))[:, None] + 50)
        three = (c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)
        self.log = np.log(three).ravel().tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may stand for ('' for nothing) and at which cost.

    The second of two equal letters is ordinary spelling; of three or more, one or two are meant.
    """
    out = []
    for k, x in enumerate(token):
        again = k > 0 and x == token[k - 1]
        third = again and k > 1 and x == token[k - 2]
        longer = third or again and token[k + 1 : k + 2] == x
        if x.isalpha() and x.isascii():
            out.append([("", DROPPED / 2)] if third else [("", DROPPED), (x, KEPT)] if longer else [("", 2 * DROPPED), (x, 0.0)] if again else [(x, 0.0)])
        elif x in LEET:
            out.append([("", DROPPED / 2)] if third else [*((y, SIGN) for y in LEET[x]), ("", MARK * (1 if again else 4 if x in "|<{(" else 10))])
        elif x.isalpha():
            out.append([(x, 0.0)])
        elif x == " ":
            out.append([("", 0.0), (" ", 3.0)])
        else:
            out.append([("", MARK * 0.2)])
    return out


def decode(token: str, log: list[float]) -> str:
    """The cheapest path under the model; states are the last two letters, 27 * 27 at most, and none is left out."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in options:
                if letter:
                    k = ord(letter) - 96 if "a" <= letter <= "z" else 0
                    total, at = cost + extra - log[a * 729 + b * 27 + k], (b, k)
                    way = (path, letter)
                else:
                    total, at, way = cost + extra, (a, b), path
                if at not in new or total < new[at][0]:
                    new[at] = (total, way)
        states = new
    (_, path) = min((c - log[a * 729 + b * 27], p) for (a, b), (c, p) in states.items())
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    def __init__(self, log: list[float], lexicon: frozenset[str] = frozenset()):
        self.log, self.memo = log, {}
        self.single = {DOUBLE.sub(r"\1", w) for w in lexicon if not w.endswith("*")}

    def word(self, w: str) -> str:
        """A token's restored form; ordinary words lose the marks at their edges."""
        core = w.strip(EDGE)
        if core.isalpha():
            plain = core
        else:
            core = w.rstrip(EDGE).lstrip(EDGE.replace("(", "").replace("{", "").replace("<", "").replace("!", "").replace("|", ""))
            core = core.rstrip("$@+") if core[-2:-1] == core[-1:] else core
            plain = ""
        if plain:
            if DOUBLE.search(core) and (TRIPLE.search(core) or self.single and DOUBLE.sub(r"\1", core) in self.single):
                out = decode(plain, self.log)
            else:
                out = plain
        elif (letters := sum("a" <= x <= "z" for x in core)) and 2 * letters >= sum(x in LEET for x in core) / 2:
            out = decode(core, self.log)
        else:
            out = core or w
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[w] = out
        return out

    def words(self, text: str | None) -> list[str]:
        """Restored words of a text, in order."""
        raw = (text or "").lower().split()
        get, word = self.memo.get, self.word
        out = [get(w) or word(w) for w in raw]
        lone = [i for i, w in enumerate(raw) if len(w) == 1]
        if len(lone) >= 3:
            runs, start = [], 0
            for k in range(1, len(lone) + 1):
                if k == len(lone) or lone[k] != lone[k - 1] + 1:
                    if k - start >= 3:
                        runs.append((lone[start], lone[k - 1] + 1))
                    start = k
            for a, b in reversed(runs):
                run = raw[a:b]
                if len(set(run)) > 1 and sum(x.isalpha() for x in run) >= 2:
                    out[a:b] = decode(" ".join(run), self.log).split()
        return out

    def text(self, text: str | None) -> str:
        return " ".join(self.words(text))


def stems(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in range(3, min(9, len(word)))] if word.isalpha() else []


def learn(documents: Iterator[tuple[list[str], int]], support: int = 5, precision: float = 0.8) -> tuple[float, dict[str, float]]:
    """(bias, lexicon weights) from restored words and labels; ``abc*`` is a stem that many toxic words share."""
    names: dict[str, int] = {}
    docs, seen = [], (Counter(), Counter())
    for words, y in documents:
        ids = np.array([names.setdefault(w, len(names)) for w in words], np.int32)
        docs.append((ids, y))
        seen[y].update(np.unique(ids).tolist())
    text = {i: w for w, i in names.items()}
    # only stems that toxic documents hold often enough are counted over all words
    often = Counter()
    for i, n in seen[1].items():
        for s in stems(text[i]):
            often[s] += n
    total = {s: [0, 0, 0] for s, n in often.items() if n >= 2 * support}
    for i, w in text.items():
        for s in stems(w):
            if (at := total.get(s)) is not None:
                at[0] += seen[0][i]
                at[1] += seen[1][i]
                at[2] += 1
    # word or stem: what it counts for, by the words it covers
    entry = {w: (seen[0][i], seen[1][i]) for w, i in names.items() if len(w) > 2 and w.isalpha() and seen[1][i] >= support and seen[1][i] >= precision * (seen[0][i] + seen[1][i])}
    entry |= {s: (c, t) for s, (c, t, forms) in total.items() if forms >= 4 and t >= 2 * support and t >= 0.95 * (c + t)}
    covers: dict[int, list[str]] = {}
    for w, i in names.items():
        if found := [s for s in (w, *stems(w)) if s in entry]:
            covers[i] = found
    around: tuple[dict, dict] = ({}, {})
    mark = np.zeros(len(names) + 1, bool)
    mark[list(covers)] = True
    for ids, y in docs:
        for k in np.flatnonzero(mark[ids]) if len(ids) else ():
            near = (int(ids[k]), int(ids[k - 1]) if k else -1, int(ids[k + 1]) if k + 1 < len(ids) else -1)
            for s in covers[int(ids[k])]:
                around[y].setdefault(s, set()).add(near)
    n1, n0 = sum(y for _, y in docs), sum(1 - y for _, y in docs)
    weights = {}
    for s, (_, df) in entry.items():
        t, c = len(around[1].get(s, ())), len(around[0].get(s, ()))
        # different neighbours, and in most documents: a copied passage has one neighbourhood
        if t >= support and t >= precision * (t + c) and t >= 0.6 * df:
            w = math.log((min(t, n1) + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
            if w > 3:
                weights[s] = w
    own = {i for i, found in covers.items() if any(s in weights for s in found)}
    rest = [y for ids, y in docs if not own.intersection(ids.tolist())]
    return math.log((sum(rest) + 0.5) / (len(rest) - sum(rest) + 0.5)) if docs else -2.0, weights


class Scorer:
    def __init__(self, restorer: Restorer, bias: float, weights: dict[str, float]):
        self.restorer, self.bias, self.weights = restorer, bias, weights
        self.single = {DOUBLE.sub(r"\1", s): w for s, w in weights.items() if not s.endswith("*")}
        self.starts = {s[:3] for s in weights}  # entries have three letters at least

    def weight(self, word: str) -> float:
        """The highest weight of a word and its stems; doubled letters count as one for words."""
        w = max([self.weights.get(s, 0.0) for s in (word, *stems(word))]) if word[:3] in self.starts else 0.0
        return max(w, self.single.get(DOUBLE.sub(r"\1", word) if DOUBLE.search(word) else word, 0.0))

    def __call__(self, text: str | None) -> float:
        s = min(self.bias, -0.5) + sum(map(self.weight, sorted(set(self.restorer.words(text)))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, n: int = SAMPLE) -> tuple[list[float], float, dict[str, float]]:
    """(model, bias, lexicon weights)."""
    with batches_of(docs.sparkSession, BATCH):
        counts = trigrams(docs)
    log = Model(counts).log

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(log)
        bias, weights = learn((restorer.words(t), int(y)) for t, y in within(pair for b in batches for pair in zip(b["text"], b["y"], strict=True)))
        words = sorted(weights)
        yield pd.DataFrame({"word": ["", *words], "weight": [bias, *(weights[w] for w in words)]})
        give_back()

    with batches_of(docs.sparkSession, BATCH):
        found = sample(docs, labels, label, learn_from, n).mapInPandas(run, "word string, weight double").collect()
    weights = {r.word: r.weight for r in found}
    bias = weights.pop("", -2.0)
    return Model(counts, weights.keys()).log, bias, weights


def score_documents(docs: DataFrame, model: tuple[list[float], float, dict[str, float]], restored: bool = False) -> DataFrame:
    """doc_id, score (and the restored text): one row for each document."""
    log, bias, weights = model
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Restorer(log, frozenset(weights)), bias, weights)
        for b in batches:
            out = pd.DataFrame({"doc_id": b["doc_id"], "score": [scorer(t) for t in b["text"]]})
            yield out.assign(restored=[scorer.restorer.text(t) for t in b["text"]]) if restored else out
        del scorer
        give_back()

    return kept.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double" + ", restored string" * restored)


def passing(docs: DataFrame, model: tuple[list[float], float, dict[str, float]], threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, all columns as they are."""
    log, bias, weights = model

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Restorer(log, frozenset(weights)), bias, weights)
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")
        del scorer
        give_back()

    return docs.where(toxic(F.col("text").cast("string")) < threshold)
