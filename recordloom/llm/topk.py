"""Exact top-k inner products by aggregation without random access.

Vectors become integers, floor(scale * x).  The candidates of a cell, ``chunk`` at a time, are held as one list for each
dimension, sorted by the component.  For a query, a list is read from the end where the product with
the query's component is highest, all lists to the same depth and each entry once.  What is read is added to a candidate's
lower bound (lists that have not shown it count with their least product); its upper bound has the product at the list's
present depth instead.  Reading stops when no candidate
outside a short list can reach the k-th best lower bound; the short list's scores are then resolved.  How deep it goes hangs on the data:
few or uneven dimensions stop early, many even ones hardly ever (``SortedLists.best`` tells the depth of each query).

Cases: vectors null, empty, or with null or non-finite components take no part, nor do rows without
an id; a row is not its own candidate, nor are rows of the same id; rows that share an id are queried each and ranked together; ties go to the smaller id; with
fewer than k candidates all are returned; vectors of unlike lengths never meet; an empty table gives
an empty result.  Scores are exact at any size of the components: where sums might pass 2**53, Python's integers are used,
and a score beyond a long is the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import CHUNK, blocks, chunks, k_best, search, usable

#: shares of the lists read after each stretch
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 1.0)
KINDS = (np.int8, np.int16, np.int32, np.float64)


class SortedLists:
    """A cell's lists: its rows, their places in the lists (sorted upwards), and the lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(x), dtype=np.int32)[:, None], order.shape), 0)
        self.sorted = np.take_along_axis(x, order, 0)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, slack: int = 4) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """(places, scores, depth) of the k best for each query.

        A list is read from its high end for a positive component and from its low end for a negative one; all
        queries of the block read to the same depth, so what a stretch adds to all of them is a product of matrices.
        """
        n, d = self.x.shape
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * d
        if most * n >= 1 << 53:
            return self.all_of(query_ids, queries, k)
        # whole numbers, exact in single precision where all sums stay below 2**24
        kind = np.float32 if most < 1 << 23 else np.float64
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1).astype(kind)
        worst = signed * np.concatenate([self.sorted[0], self.sorted[-1]]).astype(kind)
        lower = np.repeat(worst.sum(1, keepdims=True), n, 1)
        names = np.empty(n, np.int64)  # smaller ids are worth more among equal scores
        names[np.argsort(self.ids, kind="stable")] = np.arange(n)[::-1]
        out: list = [None] * len(queries)
        active, before = np.arange(len(queries)), 0
        for depth in DEPTHS:
            read = max(1, int(np.ceil(n * depth)))
            if read > before:
                new = np.concatenate([(self.place >= n - read) & (self.place < n - before), (self.place < read) & (self.place >= before)], 1).astype(kind)
                lower += signed[active] @ (new * np.concatenate([self.x, self.x], 1).astype(kind)).T
                lower -= worst[active] @ new.T
                before = read
            own = self.ids[None] == query_ids[active][:, None]
            if read == n:  # every score is known
                worth = lower.astype(np.int64) * n + names
                worth[own] = np.iinfo(np.int64).min
                top = np.argpartition(worth, n - min(k, n), axis=1)[:, n - min(k, n) :]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(worth, top, 1), axis=1), 1)
                for j, at in enumerate(top):
                    at = at[~own[j, at]]
                    out[active[j]] = at, lower[j, at].astype(np.int64), depth
                break
            hidden = np.concatenate([self.place < n - read, self.place >= read], 1).astype(kind)
            at = signed[active] * np.concatenate([self.sorted[n - read], self.sorted[read - 1]]).astype(kind)
            upper = lower + (at - worst[active]) @ hidden.T
            upper[own] = -np.inf
            bar = np.partition(np.where(own, -np.inf, lower), n - min(k, n), axis=1)[:, n - min(k, n)]
            viable = upper >= bar[:, None]
            viable &= ~own
            done = viable.sum(1) <= max(slack * k, n // 16)
            for j in np.flatnonzero(done):
                near = np.flatnonzero(viable[j])
                sums = (self.x[near] @ queries[active[j]]).astype(np.int64)
                best = k_best(sums, self.ids[near], k)
                out[active[j]] = near[best], sums[best], depth
            if done.any():
                active, lower = active[~done], lower[~done]
            if not len(active):
                break
        return out

    def all_of(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """The same in whole numbers of any size."""
        whole = np.array([[int(v) for v in row] for row in self.x.tolist()], object)
        out = []
        for i, q in zip(query_ids.tolist(), queries.tolist(), strict=True):
            near = np.flatnonzero(self.ids != i)
            sums = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in (whole[near] * np.array([int(v) for v in q], object)).sum(1).tolist()]
            top = sorted(range(len(near)), key=lambda m: (-sums[m], self.ids[near[m]]))[:k]
            out.append((near[top], np.array([sums[m] for m in top], np.int64), 1.0))
        return out


def quantised(scale: float):
    """A byte that tells the kind, and the whole numbers in the smallest kind that holds them (doubles hold those beyond 32 bits exactly)."""

    def pack(x: np.ndarray) -> bytes:
        whole = np.floor(x * scale)
        most = float(np.abs(whole).max(initial=0))
        kind = next(i for i, t in enumerate(KINDS) if t is np.float64 or most <= np.iinfo(t).max)
        return bytes([kind]) + whole.astype(KINDS[kind]).tobytes()

    return pack


def unpacked(blocks_: list[tuple[np.ndarray, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and whole numbers (as doubles) by the length of vectors."""
    by: dict[int, list] = {}
    for ids, data in blocks_:
        x = np.frombuffer(data, KINDS[data[0]], offset=1).reshape(len(ids), -1).astype(np.float64)
        by.setdefault(x.shape[1], []).append((ids, x))
    return {d: tuple(map(np.concatenate, zip(*parts, strict=True))) for d, parts in by.items()}


def top_k(table: DataFrame, is_query, k: int = 20, scale: float = 64.0, query_block: int = 256, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query, the k highest integer inner products."""
    rows = usable(table)
    queries = blocks(rows.where(is_query(F.col("vec_id"))), quantised(scale))
    candidates = blocks(rows, quantised(scale))

    def unit(left: list, right: list) -> Iterator[tuple[np.ndarray, ...]]:
        asked = unpacked(left)
        for d, ids, x in ((d, *found) for some in chunks(right, chunk) for d, found in unpacked(some).items() if d in asked):
            lists, (query_ids, q) = SortedLists(ids, x), asked[d]
            for s in range(0, len(q), query_block):
                part = slice(s, s + query_block)
                for i, (at, scores, _) in zip(query_ids[part], lists.best(query_ids[part], q[part], k), strict=True):
                    yield np.full(len(at), i), ids[at], scores

    return search(queries, candidates, unit, k, "long")
