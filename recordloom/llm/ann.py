"""Nearest neighbours by inner product: anisotropic quantisation, table scans, exact reranking.

Codebooks have 16 words for each dimension, so a code is four bits.  They are fitted to make
small not the plain residual but a score-aware loss: the part of the residual that is parallel to the
vector counts ``eta`` times, because it is what moves the highest inner products.  Codes are chosen
by coordinate descent under the same loss.  The fit takes at most ``SAMPLE`` rows (those with the
smallest hashes of their id); every row is coded.

A row travels with its codes, with the length of the residual that they leave, and with its original vector.  In a cell, the queries'
tables (two dimensions at a time, 256 sums) are looked up for all codes; the inner product can differ from this estimate by the query's length times the
residual's at most.  Each query's ``rerank`` highest estimates are scored exactly first; then every row is that the bound doesn't hold below the k-th best of
these.  So no row of the k nearest is missed, whatever the rows are, and how many are scored hangs on the data alone: near copies and few codes for
uneven components cost time, not recall.  ``rerank=None`` makes no codes: plain products are the estimates.

Cases: vectors null, empty, zero or with null or non-finite components take no part, nor do rows
without an id; a row is not its own candidate, nor are rows of the same id; rows that share an id are queried each and ranked together; ties go to the smaller id,
in estimates too; with fewer than k candidates all are returned; vectors of unlike lengths never meet; a length that the sample doesn't hold is
not coded; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import CHUNK, blocks, chunks, k_best, search, usable

SAMPLE, WORDS, WIDTH = 8192, 16, 1


class Quantiser:
    def __init__(self, x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5):
        """x: the sample, n x d; d is filled up with zeros to a multiple of WIDTH."""
        self.d = x.shape[1]
        self.eta = max(1.0, (self.d - 1) * threshold**2 / (1 - threshold**2))
        x = self.padded(x)
        self.parts = x.shape[1] // WIDTH
        rng = np.random.default_rng(seed)
        pieces = x.reshape(len(x), self.parts, WIDTH)
        pick = rng.integers(0, len(x), (self.parts, WORDS))
        self.words = pieces[pick, np.arange(self.parts)[:, None]] + rng.normal(0, 1e-6, (self.parts, WORDS, WIDTH))
        for k in range(rounds):
            codes = self.encode(x[:, : self.d], sweeps=0 if k < rounds - 3 else 1)
            self.update(pieces, codes, 1.0 if k < rounds - 3 else self.eta)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))

    def encode(self, x: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """Codes, n x parts: nearest words, then better ones under the score-aware loss."""
        pieces = self.padded(x).reshape(len(x), self.parts, WIDTH)
        codes = np.empty((len(x), self.parts), np.uint8)
        for s in range(self.parts):
            codes[:, s] = ((pieces[:, s, None] - self.words[s]) ** 2).sum(2).argmin(1)
        if not sweeps:
            return codes
        norm = np.maximum((pieces**2).sum((1, 2)), 1e-30)
        along = sum(((pieces[:, s] - self.words[s][codes[:, s]]) * pieces[:, s]).sum(1) for s in range(self.parts))
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for s in range(self.parts):
                residual = pieces[:, s, None] - self.words[s]
                part = (residual * pieces[:, s, None]).sum(2)
                rest = along - part[rows, codes[:, s]]
                loss = (residual**2).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2 / norm[:, None]
                codes[:, s] = loss.argmin(1)
                along = rest + part[rows, codes[:, s]]
        return codes

    def update(self, pieces: np.ndarray, codes: np.ndarray, eta: float) -> None:
        """Words that minimise the loss under given codes: a small linear system for each."""
        norm = np.maximum((pieces**2).sum((1, 2)), 1e-30)
        along = sum(((pieces[:, s] - self.words[s][codes[:, s]]) * pieces[:, s]).sum(1) for s in range(self.parts))
        for s in range(self.parts):
            own = pieces[:, s]
            rest = along - ((own - self.words[s][codes[:, s]]) * own).sum(1)
            weight = (eta - 1) / norm
            for w in np.unique(codes[:, s]):
                of = codes[:, s] == w
                v, g = own[of], weight[of]
                left = np.eye(WIDTH) * of.sum() + (v * g[:, None]).T @ v
                right = v.sum(0) + (v * (g * (rest[of] + (v**2).sum(1)))[:, None]).sum(0)
                self.words[s, w] = np.linalg.solve(left, right)
            along = rest + ((own - self.words[s][codes[:, s]]) * own).sum(1)

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, two in a byte, and how far an estimate may be off for a query of length 1 (rounding in single precision included)."""
        codes = self.encode(x)
        near = self.words[np.arange(self.parts), codes].reshape(len(x), -1)[:, : self.d]
        off = length(x - near) * (1 + 1e-6) + length(near) * (self.d + 4) * 2.0**-23
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, 0::2] << 4 | codes[:, 1::2], off

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The products of the words: bytes of a code x 256 x queries."""
        q = self.padded(queries).reshape(len(queries), self.parts, WIDTH)
        one = np.einsum("qsw,skw->skq", q, self.words).astype(np.float32)
        one = np.concatenate([one, np.zeros((self.parts % 2, WORDS, len(q)), np.float32)])
        return (one[0::2, :, None] + one[1::2, None]).reshape(len(one) // 2, WORDS * WORDS, len(q))

    def scan(self, tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Estimates, rows x queries, by table look-ups alone."""
        total = np.zeros((len(packed), tables.shape[2]), np.float32)
        for s in range(len(tables)):
            total += tables[s][packed[:, s]]
        return total


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def exact_bytes(x: np.ndarray) -> bytes:
    """A byte that tells the kind, and the vectors in single precision if that holds them."""
    single = x.astype(np.float32)
    return b"\0" + single.tobytes() if (single == x).all() else b"\1" + x.tobytes()


def exact(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if data[0] else np.float32, offset=1).reshape(rows, -1).astype(np.float64)


def full(blocks_: list[tuple[np.ndarray, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors by their length."""
    by: dict[int, list] = {}
    for ids, data in blocks_:
        x = exact(data, len(ids))
        by.setdefault(x.shape[1], []).append((ids, x))
    return {d: tuple(map(np.concatenate, zip(*parts, strict=True))) for d, parts in by.items()}


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, size: int = 1 << 18) -> np.ndarray:
    """Inner products of columns i of q with columns j of x, added dimension by dimension, so that equal vectors have equal products."""
    out = np.zeros(len(i))
    for a in range(0, len(i), size):
        part = slice(a, a + size)
        for s in range(len(q)):
            out[part] += q[s][i[part]] * x[s][j[part]]
    return out


def highest(query_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, ids: np.ndarray, x: np.ndarray, estimates: np.ndarray, off: np.ndarray, k: int, first: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The k highest of each query (a row of estimates) but its own id, if they reach its bar, which is raised to the k-th of them."""
    upper = estimates + length(q)[:, None] * off
    upper[~np.isfinite(upper)] = np.inf  # numbers so large that nothing is known
    upper[ids == query_ids[:, None]] = -np.inf
    n, q, x = len(ids), np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    if n > first >= k:
        top = np.argpartition(np.where(np.isfinite(upper), estimates, upper), n - first, axis=1)[:, n - first :]
        sums = products(q, x, np.repeat(np.arange(len(top)), first), top.ravel()).reshape(top.shape)
        sums[np.isneginf(np.take_along_axis(upper, top, 1)) | np.isnan(sums)] = -np.inf
        np.maximum(bar, np.partition(sums, first - k, axis=1)[:, first - k], out=bar)
    i, j = np.nonzero((upper >= bar[:, None]) & ~np.isneginf(upper))
    sums, at = products(q, x, i, j), np.searchsorted(i, np.arange(len(bar) + 1))
    for m, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        scores, near = sums[a:b], j[a:b]
        best = k_best(np.where(np.isnan(scores), np.inf, scores), ids[near], k)
        if len(best) == k and scores[best[-1]] > bar[m]:
            bar[m] = scores[best[-1]]
        yield np.full(len(best), query_ids[m]), ids[near[best]], scores[best]


def nearest(table: DataFrame, is_query, k: int = 20, rerank: int | None = 64, query_block: int = 256, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score for each row with is_query."""
    rows = usable(table, zero=False)
    queries = blocks(rows.where(is_query(F.col("vec_id"))), exact_bytes)
    sample = [] if rerank is None else rows.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(SAMPLE).collect()
    fitted = {d: Quantiser(np.array([r.v for r in sample if len(r.v) == d], np.float64)) for d in {len(r.v) for r in sample}}

    def coded(x: np.ndarray) -> bytes:
        """The length, codes if there is a fit, how far estimates may be off, and the vectors."""
        d = x.shape[1]
        codes, off = fitted[d].packed(x) if d in fitted else (np.empty((len(x), 0), np.uint8), length(x) * (d + 4) * 2.0**-50)
        return d.to_bytes(4, "little") + codes.tobytes() + off.tobytes() + exact_bytes(x)

    def parsed(ids: np.ndarray, data: bytes) -> tuple[np.ndarray, ...]:
        n, d = len(ids), int.from_bytes(data[:4], "little")
        at = 4 + n * (-(-fitted[d].parts // 2) if d in fitted else 0)
        return ids, np.frombuffer(data[4:at], np.uint8).reshape(n, -1) if at > 4 else np.empty((n, 0), np.uint8), np.frombuffer(data[at : at + 8 * n]), exact(data[at + 8 * n :], n)

    candidates = blocks(rows, coded)

    def unit(left: list, right: list) -> Iterator[tuple[np.ndarray, ...]]:
        by = full(left)
        bars = {d: np.full(len(ids), -np.inf) for d, (ids, _) in by.items()}
        for some in chunks(right, chunk):
            parts: dict[int, list] = {}
            for ids, data in some:
                parts.setdefault(int.from_bytes(data[:4], "little"), []).append((ids, data))
            for d, found in parts.items():
                if d not in by:
                    continue
                ids, codes, off, x = map(np.concatenate, zip(*(parsed(*block) for block in found), strict=True))
                (query_ids, q), fit = by[d], fitted.get(d)
                for s in range(0, len(q), query_block):
                    part = slice(s, s + query_block)
                    estimates = np.ascontiguousarray(fit.scan(fit.tables(q[part]), codes).T) if fit else q[part] @ x.T
                    yield from highest(query_ids[part], q[part], bars[d][part], ids, x, estimates, off, k, max(rerank or 0, k))

    return search(queries, candidates, unit, k, "double")
