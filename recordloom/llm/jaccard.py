"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.75 or more.

Sets.  Bytes A-Z become lower case, words are runs without white space, a shingle is a 64-bit hash of
five words.  Documents with equal sets are one node from the start.

Blocks.  Sets of n shingles that reach the threshold share one of the first n - ceil(0.75 n) + 1
shingles under any common order, and of the smaller set it is one of the first n - ceil(6/7 n) + 1, so
a shingle that no node has so early makes no block.  The order is by hash, with common shingles last, so that a passage that
many documents share makes no block unless a document is little else.  A shingle in two nodes' prefixes is
a block; of blocks with the same nodes one is kept, and a large block is cut into chunks.

Most shingles stand in one node, so postings travel packed: a task sends each range of keys as one
binary row (sorted keys as differences, nodes, sizes), and what receives a range keeps the keys of two nodes or more.
Of these, it keeps nodes that have a partner: one of a like size, such that the smaller of both has the key early.
Postings of a very common shingle are dealt to several ranges by their node, and the parts of its block are put
together by sums.

Points.  A node's shingles are hashed into groups, two to four times as many as it has (64 to 16384, powers of two, so that
the next finer point folds into a coarser one); the counts up to three are
its point, what they leave out its excess.  Points of a block are indexed by an R-tree.  Two sets
overlap in at most the summed minima of their coordinates and the larger excess, and two boxes in at
most the same of their upper corners; boxes and points below the needed overlap are pruned, and those
of unlike sizes.  What survives is verified on the texts.

Blocks with one least node meet in a cell, so that a point is sent once for all blocks of a group of copies.
The chunks of large blocks are dealt by component, and pairs of chunks of one component never meet, so the rows of a group of
near copies grow with its size, not with its square.

Rounds.  Links within a component need not be known for its class, so pairs are never expanded inside a
group of near copies: first each node is compared with the likeliest leader (least node) of its blocks, then in ``FORESTS``
rounds, and more while they join much, with a few nodes of other components that the tree joins give, then all surviving pairs between
different components are compared (of blocks of one leaf, those that the first of these rounds put off).
After that no link between two components is missing.

Cases: null and empty texts have no shingles and are linked with nothing; fewer than five words are one
shingle; repeated rows share a class; a class is named by its smallest doc_id, and rows without an id
link as any other (a class of them alone has no name); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import batches_of, discard, give_back, release, scratch_dir, stored, temporary
from .components import components

WORDS, PERCENT = 5, 75
#: a point has 2**6 to 2**14 groups, and counts up to three
LEVELS, MOST = (6, 14), 3
FORESTS, TRIES, CHUNK = 2, 12, 2048
#: forests go on, up to so many, while one gives more links than that and than a thousandth of the nodes in blocks
MORE_FORESTS, FEW = 12, 64
#: texts are handed to Python in batches of so many bytes
BATCH = "8m"
#: rows of a side that is broadcast; beyond that it is joined by key
BROADCAST_ROWS = 500_000
#: at most so many shingles are common (8 MB, sent to all tasks): those seen so often, or twice, four times and so on that, that there are no more
COMMON_MOST, COMMON_LEAST = 1 << 20, 8
#: rows of blocks that a cell holds at most, about
CELL = 16_384
#: postings that a task packs at a time, and those of a range: a thousandth of all, between both
PACKED, RANGE = 1_000_000, (200_000, 4_000_000)
LEAF = 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    h = (h ^ (h >> np.uint64(29))) * M1
    return h ^ (h >> np.uint64(32))


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; bytes are taken as UTF-8."""
    raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, raw), np.uint64, len(raw))
    if len(h) == 0:
        return h
    if len(h) < words:
        total = np.array([len(h)], np.uint64)
        for x in h:
            total = mixed(total * M1 + x)
        return total
    total = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        total = total * M1 + h[k : len(h) - words + 1 + k]
    return np.unique(mixed(total))


def needed(n: np.ndarray | int, percent: int = PERCENT):
    return -(-n * percent // 100)


def early(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a prefix may be shared with a set that isn't smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def prefix(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of s that make blocks; s is sorted."""
    length = len(s) - int(needed(len(s), percent)) + 1
    if not len(common):
        return s[:length]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = common[at] == s
    own = s[~late][:length]
    return own if len(own) == length else np.append(own, s[late][: length - len(own)])


def node_of(s: np.ndarray) -> int:
    """A set's name."""
    return int(np.array([xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def level(n):
    """Groups of the point of n shingles, as a power of two."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) * 2)), *LEVELS).astype(np.int64)


def point(s: np.ndarray) -> bytes:
    """Counts up to three, four of them in a byte."""
    groups = 1 << int(level(len(s)))
    c = np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), MOST).astype(np.uint8)
    return (c[0::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def points(packed: list[bytes], groups: int) -> np.ndarray:
    """Counts, a row for each point; points of the next finer level are folded."""
    out = np.empty((len(packed), groups), np.uint8)
    lengths = np.array([len(p) for p in packed])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join([packed[k] for k in at.tolist()]), np.uint8).reshape(len(at), n)
        c = np.empty((len(at), 4 * n), np.uint8)
        for k in range(4):
            c[:, k::4] = raw >> 2 * k & 3
        out[at] = c if 4 * n == groups else c.reshape(len(at), -1, groups).sum(1, dtype=np.uint8)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, alt; a row without an id is found again by alt, a hash of its text (as a string: pandas has no null integers)."""
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.withColumn("alt", F.when(F.col("doc_id").isNull(), F.xxhash64("text").cast("string")))


def described(docs: DataFrame, percent: int) -> DataFrame:
    """Rows of documents (doc_id, n, node, point, alt) and, with n null, rows of shingles seen repeatedly in a part (node, seen)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        known: set[int] = set()

        def repeated() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pd.DataFrame({"doc_id": None, "n": None, "node": keys[n > 1].view(np.int64), "point": None, "seen": n[n > 1], "alt": None})

        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(s) for s in sets], "node": pd.array(nodes, "Int64"), "point": [point(s) if len(s) else None for s in sets], "seen": None, "alt": b["alt"]})
            for s, node in zip(sets, nodes, strict=True):
                if node is not None and node not in known:
                    known.add(node)
                    held.append(s[: 2 * (len(s) - int(needed(len(s), percent)) + 1)])
            if sum(map(len, held)) > 2 * PACKED:
                yield repeated()
                known.clear()
        yield repeated()
        give_back()

    rows = keyed(docs)
    return rows.mapInPandas(run, f"doc_id {id_type}, n long, node long, point binary, seen long, alt string")


def pack(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Postings in order of their keys; the bytes of like worth stand together, so that the upper ones take no room."""
    planes = lambda x: x.view(np.uint8).reshape(len(x), -1).T.tobytes()
    raw = planes(np.diff(keys, prepend=np.uint64(0))) + nodes.tobytes() + planes(sizes)
    return len(keys).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], 20 * n, "zstd", asbytes=True)
    plain = lambda part, kind: np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(-1, n).T).view(kind).ravel()
    return np.cumsum(plain(raw[: 8 * n], np.uint64), dtype=np.uint64), np.frombuffer(raw[8 * n : 16 * n], np.int64), plain(raw[16 * n :], np.uint32)


def postings(docs: DataFrame, common: np.ndarray, shares: np.ndarray, ranges: int, bits: int, percent: int) -> DataFrame:
    """bucket, blob: packed postings (key, node, size) of the shingles of each node's prefix, in each part that has the node.

    A key is the first ``bits`` of a shingle: two that share them make one block, which costs a comparison at most.
    A size is four times the set's, two more for a key that is dealt to several ranges, and one more for early shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, shares))
    step = np.uint64((1 << bits) // ranges + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, share = shared.value
        known: set[int] = set()
        held: list[tuple] = []

        def packed() -> pd.DataFrame:
            keys, nodes, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            bucket = (keys >> np.uint64(64 - bits)) // step
            if len(late):
                at = np.minimum(np.searchsorted(late, keys), len(late) - 1)
                split = (late[at] == keys) & (share[at] > 1)
                sizes = sizes | (split.astype(np.uint32) << np.uint32(1))
                turn = mixed(nodes.view(np.uint64)) % share[at].astype(np.uint64)
                bucket = np.where(split, (bucket + turn) % np.uint64(ranges), bucket)
            keys = keys >> np.uint64(64 - bits)
            order = np.lexsort((keys, bucket))
            keys, nodes, sizes, bucket = keys[order], nodes[order], sizes[order], bucket[order]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            return pd.DataFrame({"bucket": bucket[edges[:-1]].astype(np.int64), "blob": [pack(keys[i:j], nodes[i:j], sizes[i:j]) for i, j in zip(edges, edges[1:], strict=False)]})

        count = 0
        for b in batches:
            for t in b["text"]:
                s = shingles(t)
                if len(s) and (node := node_of(s)) not in known:
                    known.add(node)
                    p = prefix(s, late, percent)
                    held.append((p, np.full(len(p), node, np.int64), (4 * len(s) + (np.arange(len(p)) < early(len(s), percent))).astype(np.uint32)))
                    count += len(p)
                    if count >= PACKED:
                        yield packed()
                        count = 0
                    if len(known) > 1_000_000:
                        known.clear()
        if count:
            yield packed()
        give_back()

    return docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInPandas(run, "bucket long, blob binary")


PARTS = "key long, nodes array<long>, m long, x long, y long, lo long, hi long, near int"


def block_parts(packed: DataFrame, percent: int) -> DataFrame:
    """PARTS: the nodes of each key that have a partner there, of equal blocks of a range one; keys dealt to several ranges as they are.

    Nodes of a key whose sizes are too far apart make blocks of their own, so a block's name is of its key and its number there.
    """

    def of_range(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        keys, nodes, sizes = (np.concatenate(part) for part in zip(*map(unpack, blobs), strict=True))
        order = np.lexsort((nodes, keys))
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        # a node that two parts hold, or two shingles of a node with one key: early if one of them is
        flags = np.bitwise_or.reduceat(sizes, starts)
        keys, nodes, sizes = keys[starts], nodes[starts], (sizes[starts] >> np.uint32(2)).astype(np.int64)
        is_early, split = flags & np.uint32(1) > 0, flags & np.uint32(2) > 0
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes, is_early, split = keys[order], nodes[order], sizes[order], is_early[order], split[order]
        same = np.append(keys[1:] == keys[:-1], False)
        larger = np.append(sizes[1:], 0)
        # the next larger, if this one has the key early, or the last smaller one that has
        after = is_early & same & (100 * sizes >= percent * larger)
        last = np.append(-1, np.maximum.accumulate(np.where(is_early, np.arange(len(keys)), -1))[:-1])
        before = (last >= 0) & (keys[last] == keys) & (100 * sizes[last] >= percent * sizes)
        kept = split | after | before
        keys, nodes, sizes, is_early, split = keys[kept], nodes[kept], sizes[kept], is_early[kept], split[kept]
        if not len(keys):
            return
        new = np.append(True, keys[1:] != keys[:-1])
        apart = new | np.append(False, (100 * sizes[:-1] < percent * sizes[1:]) & ~split[1:])
        starts = np.flatnonzero(apart)
        number = np.arange(len(starts)) - np.maximum.accumulate(np.where(new[starts], np.arange(len(starts)), 0))
        names = mixed(keys[starts] + number.astype(np.uint64) * M1).view(np.int64)
        m, split = np.diff(np.append(starts, len(keys))), split[starts]
        h = mixed(nodes.view(np.uint64))
        x, y = np.bitwise_xor.reduceat(h, starts).view(np.int64), np.add.reduceat((mixed(h) & np.uint64((1 << 30) - 1)).astype(np.int64), starts)
        lo, hi, near = np.minimum.reduceat(nodes, starts), np.maximum.reduceat(nodes, starts), np.maximum.reduceat(is_early, starts)
        whole = np.flatnonzero(~split)
        _, first = np.unique(np.stack([x[whole], y[whole], m[whole], lo[whole]], 1), axis=0, return_index=True) if len(whole) else (None, whole)
        out: list[tuple] = []
        for k in [*np.flatnonzero(split).tolist(), *whole[first].tolist()]:
            s, n = int(starts[k]), int(m[k])
            for c in range(s, s + n, CHUNK):
                # a block's sums are told by its first part
                out.append((names[k], nodes[c : min(c + CHUNK, s + n)], *((n, x[k], y[k]) if c == s else (0, 0, 0)), lo[k], hi[k], int(near[k])))
        yield pd.DataFrame(out, columns=["key", "nodes", "m", "x", "y", "lo", "hi", "near"]).astype({"near": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            for bucket, blob in zip(b["bucket"], b["blob"], strict=True):
                if bucket != at and held:
                    yield from of_range(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from of_range(held)
        give_back()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, PARTS)


def blocks_of(parts: DataFrame) -> DataFrame:
    """key, lo, m, g, nodes of the blocks; of blocks with the same nodes one is kept.  (lo, g) is the cell of a block of a chunk at most."""
    sums = {"m": "sum(m)", "x": "bit_xor(x)", "y": "sum(y)", "lo": "min(lo)", "hi": "max(hi)", "near": "max(near)"}
    whole = parts.groupBy("key").agg(*(F.expr(f).alias(c) for c, f in sums.items())).where("lo <> hi and near > 0")
    # x and y name a block's nodes; x alone would not tell nodes that come twice
    one = whole.groupBy("lo", "hi", "x", "y", "m").agg(F.min("key").alias("key")).select("key", "lo", "m")
    cells = one.where(F.col("m") <= CHUNK).groupBy("lo").agg(F.ceil(F.sum("m") / CELL).alias("cells"))
    one = one.join(cells, "lo", "left").select("key", "lo", "m", F.when(F.col("m") <= CHUNK, F.pmod(F.xxhash64("key"), F.col("cells"))).cast("int").alias("g"))
    return parts.select("key", "nodes").join(one, "key")


class Tree:
    """An R-tree of count vectors, packed by component, size and the widest coordinate."""

    def __init__(self, at: np.ndarray, size: np.ndarray, comp: np.ndarray):
        self.points, self.size, self.comp = at, size, comp
        self.excess = size - at.sum(1, dtype=np.int64)
        self.boxes: list[tuple] = []  # upper corner, most excess, least and most size, only component or None, members or None, children or None
        self.root = self.build(np.lexsort((size, comp)))

    def build(self, at: np.ndarray) -> int:
        corner, size, comp = self.points[at].max(0), self.size[at], self.comp[at]
        only = int(comp[0]) if (comp == comp[0]).all() else None
        inner, children = at, None
        if len(at) > LEAF:
            if only is not None:
                spread = np.ptp(self.points[at], 0)
                at = at[np.argsort(self.points[at, int(spread.argmax())], kind="stable")] if np.ptp(size) < 16 else at
            cut = len(at) // 2
            inner, children = None, (self.build(at[:cut]), self.build(at[cut:]))
        self.boxes.append((corner, int(self.excess[at].max()), int(size.min()), int(size.max()), only, inner, children))
        return len(self.boxes) - 1

    def joined(self, percent: int, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, places) of pairs of different components whose overlap may suffice; same(components) tells those joined meanwhile."""
        todo = [(self.root, self.root)]
        while todo:
            i, j = todo.pop()
            (ca, ea, la, ma, oa, pa, na), (cb, eb, lb, mb, ob, pb, nb) = self.boxes[i], self.boxes[j]
            if oa is not None and ob is not None and (oa == ob or same(oa) == same(ob)) or 100 * ma < percent * lb or 100 * mb < percent * la:
                continue
            if (100 + percent) * (int(np.minimum(ca, cb).sum(dtype=np.int64)) + max(ea, eb)) < percent * (la + lb):
                continue
            if na is None and nb is None:
                x, y = np.repeat(pa, len(pb)), np.tile(pb, len(pa))
                tops = {c: same(c) for c in {*self.comp[pa].tolist(), *self.comp[pb].tolist()}}
                tx, ty = self.size[x], self.size[y]
                ok = (100 * np.minimum(tx, ty) >= percent * np.maximum(tx, ty)) & ((x < y) if i == j else True)
                ok &= np.array([tops[c] for c in self.comp[x].tolist()]) != np.array([tops[c] for c in self.comp[y].tolist()])
                x, y = x[ok], y[ok]
                if len(x):
                    most = np.minimum(self.points[x], self.points[y]).sum(1, dtype=np.int64) + np.maximum(self.excess[x], self.excess[y])
                    ok = (100 + percent) * most >= percent * (self.size[x] + self.size[y])
                    if ok.any():
                        yield x[ok], y[ok]
            elif i == j:
                a, b = na
                todo += [(a, a), (b, b), (a, b)]
            elif nb is None or na is not None and ma - la >= mb - lb:
                todo += [(k, j) for k in na]
            else:
                todo += [(i, k) for k in nb]


def tree_pairs(node: np.ndarray, comp: np.ndarray, size: np.ndarray, at: np.ndarray, percent: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that survive; with ``forest``, only those that join components that earlier pairs haven't joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in Tree(at, size, comp).joined(percent, top):
        if forest:
            kept = []
            for k, (p, q) in enumerate(zip(comp[x].tolist(), comp[y].tolist(), strict=True)):
                if (p := top(p)) != (q := top(q)):
                    up[p] = q
                    kept.append(k)
            x, y = x[kept], y[kept]
        yield node[x], node[y]


def bounded(node, size, packed, x: np.ndarray, y: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs of places (x, y), those of like sizes that the points allow to link: nodes, nodes, the most overlap in thousandths.

    A pair is looked at under the level of the smaller set; the other's is the same or the next finer one.
    """
    ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
    x, y = x[ok], y[ok]
    own = level(np.minimum(size[x], size[y]))
    for lv in np.unique(own).tolist():
        at, groups = np.flatnonzero(own == lv), 1 << lv
        for k in range(0, len(at), step := max(64, (1 << 20) // groups)):
            p, q = x[at[k : k + step]], y[at[k : k + step]]
            u, v = points([packed[r] for r in p.tolist()], groups), points([packed[r] for r in q.tolist()], groups)
            most = np.minimum(u, v).sum(1, dtype=np.int64) + np.maximum(size[p] - u.sum(1, dtype=np.int64), size[q] - v.sum(1, dtype=np.int64))
            most, both = np.minimum(most, np.minimum(size[p], size[q])), size[p] + size[q]
            keep = (100 + percent) * most >= percent * both
            yield node[p[keep]], node[q[keep]], (1000 * most[keep] // (both[keep] - most[keep])).astype(np.int32)


def block_pairs(rows: DataFrame, percent: int, mode: str, turn: int = 0) -> DataFrame:
    """a < b and the most overlap in thousandths, from cells: rows of nodes (kind 0: node, n, comp, point) and of blocks (kind 1: key, nodes).

    A cell without rows of blocks is one block.  mode: 'leaders' (each node and its block's least one), 'forest' (of blocks above a leaf, only pairs that join
    components that earlier pairs haven't joined) or 'all'.
    """

    def pairs_of(at: np.ndarray, key: int, node, comp, size, packed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # in another order for each block, so that forests differ
        at = at[np.argsort(mixed(node[at].view(np.uint64) ^ np.uint64((key + turn) & (1 << 64) - 1)))]
        levels = level(size[at])
        for lv in np.unique(levels).tolist():
            most = size[at[levels == lv]].max()
            part = at[(levels == lv) | (levels == lv + 1) & (percent * size[at] <= 100 * most)]
            if (comp[part] != comp[part[0]]).any():
                yield from tree_pairs(node[part], comp[part], size[part], points([packed[r] for r in part.tolist()], 1 << lv), percent, mode == "forest")

    def of_cells(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids = frame[["cell", "i", "j"]].to_numpy()
        cell = np.cumsum(np.append(False, (ids[1:] != ids[:-1]).any(1)))
        is_node = frame["kind"].to_numpy() == 0
        own, lists = frame[is_node], frame[~is_node]
        node, comp, size = (own[c].to_numpy(np.int64) for c in ("node", "comp", "n"))
        packed, of = own["point"].to_numpy(), cell[is_node]
        names, rank = np.unique(node, return_inverse=True)
        place = of * len(names) + rank  # rows come in order of cell and node
        pairs, large = [], []
        if len(lists):
            members, many = np.concatenate(lists["nodes"].tolist()), np.array([len(x) for x in lists["nodes"]])
            at = np.searchsorted(place, np.repeat(cell[~is_node], many) * len(names) + np.searchsorted(names, members))
            starts = np.append(0, np.cumsum(many))
            if mode == "leaders":
                first = np.minimum.reduceat(at, starts[:-1])  # the least node comes first in its cell
                pairs.append((np.repeat(first, many), at))
            else:
                for m in np.unique(many[many <= LEAF]).tolist():
                    i, j = np.triu_indices(m, 1)
                    of_size = starts[:-1][many == m, None]
                    pairs.append((at[(of_size + i).ravel()], at[(of_size + j).ravel()]))
                large += [(at[starts[k] : starts[k + 1]], int(lists["key"].iloc[k])) for k in np.flatnonzero(many > LEAF).tolist()]
        whole = np.setdiff1d(of, cell[~is_node])
        if len(whole):
            edges = np.searchsorted(of, [whole, whole + 1])
            large += [(np.arange(s, e), int(frame["cell"].iloc[int(np.searchsorted(cell, c))])) for s, e, c in zip(*edges.tolist(), whole.tolist(), strict=True)]
        if pairs:
            # each pair of nodes once, whichever cells it is in
            _, here = np.unique(rank, return_index=True)
            x, y = (rank[np.concatenate(part)].astype(np.int64) for part in zip(*pairs, strict=True))
            both = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y))
            x, y = here[both // len(names)], here[both % len(names)]
            apart = (comp[x] != comp[y]) & (x != y)
            yield from bounded(node, size, packed, x[apart], y[apart], percent)
        for at, key in large:
            for x, y in pairs_of(at, key, node, comp, size, packed):
                yield x, y, np.zeros(len(x), np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        told: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            found = list(of_cells(frame))
            if found:
                a, b, most = map(np.concatenate, zip(*found, strict=True))
                told.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "most": most}).drop_duplicates(["a", "b"]))
            if sum(map(len, told)) > 500_000:  # blocks of one group of copies give many pairs again
                told[:] = [pd.concat(told).drop_duplicates(["a", "b"])]
                if len(told[0]) > 250_000:
                    yield told.pop()

        for b in batches:
            frame = b if held is None else pd.concat([held, b])
            ids = frame[["cell", "i", "j"]].to_numpy()
            # the last cell waits for the rest of it
            last = (ids == ids[-1]).all(1) if len(ids) else np.zeros(0, bool)
            yield from flush(frame[~last]) if not last.all() else ()
            held = frame[last]
        if held is not None and len(held):
            yield from flush(held)
        if told:
            yield pd.concat(told).drop_duplicates(["a", "b"])
        give_back()

    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind", "node").mapInPandas(run, "a long, b long, most int")


def large_cells(between: DataFrame, mode: str, turn: int) -> DataFrame:
    """cell, i, j, node, comp of blocks above a chunk, from rows (key, m, node, comp).

    Such blocks with one most frequent component are made one, unless they have so little in common that this takes more rows.  For forests
    a block's nodes are dealt to chunks by ``turn``, and each chunk is a cell.  For all pairs a component of half a chunk or more has chunks of
    its own, the others share chunks, and two chunks are a cell unless they are of one component.
    """
    chunks = lambda n: F.ceil(F.col(n) / CHUNK)
    chief = between.groupBy("key", "m", "comp").agg(F.count("*").alias("n")).groupBy("key", "m").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("chief"))
    between = between.drop("m").join(F.broadcast(chief), "key")
    alone = chief.groupBy("chief").agg(F.sum(F.col("m") * chunks("m")).alias("alone"))
    merged = between.select("chief", "node").distinct().groupBy("chief").agg(F.count("*").alias("u")).join(alone, "chief").select("chief", "u", (F.col("u") * chunks("u") <= F.col("alone")).alias("one"))
    of = lambda one, else_: F.when(F.col("one"), F.col(one)).otherwise(F.col(else_))
    own = between.join(F.broadcast(merged), "chief").select(of("chief", "key").alias("cell"), of("u", "m").alias("m"), "node", "comp").distinct()
    if mode == "forest":
        c = F.pmod(F.xxhash64("node", F.lit(turn)), chunks("m")).cast("int")
        return own.select("cell", c.alias("i"), c.alias("j"), "node", "comp")
    each = own.groupBy("cell", "comp").agg(F.count("*").alias("n"))
    held = each.groupBy("cell", F.when(2 * F.col("n") >= CHUNK, F.col("comp")).alias("only")).agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("k"))
    of_cell = Window.partitionBy("cell")
    held = held.select("cell", "only", "k", (F.sum("k").over(of_cell.orderBy("only")) - F.col("k")).cast("int").alias("s"), F.sum("k").over(of_cell).cast("int").alias("every"))
    mixed_ = held.where("only is null").select("cell", "k", "s", "every", F.lit(False).alias("pure"))
    pure = held.where("only is not null").select("cell", F.col("only").alias("comp"), "k", "s", "every", F.lit(True).alias("pure"))
    dealt = own.select("cell", "node", "comp").join(F.broadcast(pure), ["cell", "comp"], "left")
    rest = dealt.where("pure is null").select("cell", "node", "comp").join(F.broadcast(mixed_), "cell")
    dealt = dealt.where("pure").unionByName(rest).withColumn("c", (F.col("s") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int"))
    # the pairs within a shared chunk are those of any cell it is in
    met = F.filter(F.sequence(F.lit(0), F.col("every") - 1), lambda o: F.when(F.col("pure"), (o < F.col("s")) | (o >= F.col("s") + F.col("k"))).otherwise((o != F.col("c")) | (F.col("every") == 1)))
    return dealt.withColumn("o", F.explode(met)).select("cell", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "comp")


def cells_of(blocks: DataFrame, labelled: DataFrame, known: DataFrame, large: str | None = None, turn: int = 0) -> DataFrame:
    """Rows of cells for block_pairs, from rows (key, lo, m, g, node, comp) and points (node, n, point); of blocks between components only.

    A block of a chunk at most is in the cell of its least node; larger ones are cut as ``large_cells`` does for the mode ``large``, or left out.
    """
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    labelled = labelled.withColumn("c", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    apart = labelled.groupBy("key", "m").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    # by chunks, so that a large block isn't one task's
    apart = apart.select("key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"))
    between = labelled.join(apart, ["key", "c"], "left_semi")
    own = between.where(F.col("m") <= CHUNK).select(F.col("lo").alias("cell"), (-1 - F.col("g")).alias("i"), F.lit(0).alias("j"), "node", "comp").distinct()
    lists = blocks.where(F.col("m") <= CHUNK).join(apart.select("key").distinct(), "key", "left_semi").select(F.col("lo").alias("cell"), (-1 - F.col("g")).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("kind"), "key", "nodes")
    if large:
        own = own.unionByName(large_cells(between.where(F.col("m") > CHUNK).select("key", "m", "node", "comp"), large, turn))
    # zeros for what a kind has not: pandas has no null integers
    zero = F.lit(0).cast("long")
    lists = lists.withColumns({"node": zero, "comp": zero, "n": zero})
    return own.join(known, "node").withColumns({"kind": F.lit(0), "key": zero}).unionByName(lists, allowMissingColumns=True)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, cell: int = 256) -> DataFrame:
    """The pairs (a, b) that are links, stored.  A text is sent once for each cell it is in: a leader ``a`` and up to about ``cell`` others."""
    spark = docs.sparkSession
    pairs_path, wanted_path = scratch_dir(spark), scratch_dir(spark)
    pairs = stored(pairs, pairs_path)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / cell).alias("cells"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int")).select("a", "b", "salt")
    members = dealt.select(F.col("a").alias("cell"), "salt", F.col("b").alias("node")).unionByName(dealt.select(F.col("a").alias("cell"), "salt", F.col("a").alias("node")).distinct())
    wanted = stored(members.join(nodes.select("node", F.col("doc_id").alias("__id"), F.col("alt").alias("__alt")), "node"), wanted_path)
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = keyed(docs).join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("alt").eqNullSafe(F.col("__alt"))).select("cell", "salt", "node", "text", (F.col("cell") != F.col("node")).cast("int").alias("other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leader = None, None
        for b in batches:
            found: tuple[list, list] = ([], [])
            for c, salt, node, text in zip(b["cell"], b["salt"], b["node"], b["text"], strict=True):
                s = shingles(text)
                if not len(s) or node_of(s) != node:  # another row of the same doc_id
                    continue
                if c == node:
                    at, leader = (c, salt), s
                elif at == (c, salt):
                    both = len(np.intersect1d(leader, s, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(s) - both):
                        found[0].append(c)
                        found[1].append(node)
            yield pd.DataFrame({"a": np.array(found[0], np.int64), "b": np.array(found[1], np.int64)})
        give_back()

    links = stored(texts.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "other").mapInPandas(run, "a long, b long").distinct())
    discard(spark, pairs_path)
    discard(spark, wanted_path)
    release(spark)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    spark = docs.sparkSession
    with batches_of(spark, BATCH), temporary(spark):
        return stored(_near_duplicates(docs, percent), outlive=True)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    told = stored(described(docs, percent))
    rows = told.where("n is not null").select("doc_id", "n", "node", "point", "alt")
    total = rows.agg(F.sum("n")).head()[0] or 0
    seen = stored(told.where("n is null").groupBy("node").agg(F.sum("seen").alias("seen")))
    turns = [COMMON_LEAST << k for k in range(40)]
    often = next(c for c, n in zip(turns, seen.agg(*(F.count_if(F.col("seen") >= c) for c in turns)).head(), strict=True) if n <= COMMON_MOST)
    top = seen.where(F.col("seen") >= often).toPandas()
    order = np.argsort(top["node"].to_numpy(np.int64).view(np.uint64))
    common = top["node"].to_numpy(np.int64).view(np.uint64)[order]
    posted = max(1, int(total * (100 - percent) / 100))
    in_range = min(max(posted // 1000, RANGE[0]), RANGE[1])
    ranges = -(-posted // in_range)
    shares = np.minimum(1 + top["seen"].to_numpy(np.int64)[order] // 8192, ranges)
    # so many bits that one key in a few thousand is shared by chance
    bits = min(63, posted.bit_length() + 12)
    nodes = stored(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("alt").alias("alt")).withColumn("alt", F.when(F.col("doc_id").isNull(), F.col("alt"))))
    release(spark)
    parts_path, blocks_path, known_path = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    parts = stored(block_parts(postings(docs, common, shares, ranges, bits, percent), percent), parts_path)
    release(spark)
    blocks = stored(blocks_of(parts), blocks_path)
    discard(spark, parts_path)
    rows_of = blocks.select("key", "lo", "m", "g", F.explode("nodes").alias("node"))
    in_blocks = rows_of.select("node").distinct()
    side = F.broadcast(in_blocks) if (many := in_blocks.count()) <= BROADCAST_ROWS else in_blocks
    known = stored(rows.join(side, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point")), known_path)
    release(spark)

    # round 1: each node and the likeliest leader of its blocks (of blocks above a chunk, the least)
    first = block_pairs(cells_of(blocks, rows_of.withColumn("comp", F.col("node")), known), percent, "leaders")
    far = rows_of.where(F.col("m") > CHUNK).where("node <> lo").groupBy(F.col("node").alias("b")).agg(F.min("lo").alias("a")).select("a", "b", F.lit(0).alias("most"))
    first = first.unionByName(far).groupBy("b").agg(F.min_by("a", F.struct(-F.col("most"), F.col("a"))).alias("a"))
    links = verified(docs, nodes, first, percent)
    found = components(links)
    release(spark)

    left_over = None
    any_large = not blocks.where(F.col("m") > CHUNK).isEmpty()
    last = False
    for turn in range(MORE_FORESTS + 1):
        mode = "all" if last else "forest"
        # small blocks give all their pairs in the first turn
        mine, rows_now = (x if not turn else x.where(F.col("m") > LEAF) for x in (blocks, rows_of))
        labelled_path, pairs_path = scratch_dir(spark), scratch_dir(spark)
        labelled = stored(rows_now.join(found, "node", "left").select("key", "lo", "m", "g", "node", F.coalesce("comp", "node").alias("comp")), labelled_path)
        held = stored(block_pairs(cells_of(mine, labelled, known, mode if any_large else None, turn), percent, mode, turn).select("a", "b").distinct(), pairs_path)
        discard(spark, labelled_path)
        release(spark)
        if last:
            ca, cb = (found.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
            open_ = left_over.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            pairs = held.unionByName(open_.select("a", "b")).distinct()
        else:
            # a few partners of each node, one of each class of a hash
            pairs = held.groupBy("b", F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(TRIES)).alias("t")).agg(F.min("a").alias("a")).select("a", "b")
            if not turn:
                left_over = held.join(pairs, ["a", "b"], "left_anti")
        more = verified(docs, nodes, pairs, percent)
        if turn:
            discard(spark, pairs_path)
        if joined := more.count():
            # components are contracted to stars, so only they and the new links are walked
            found = components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
        release(spark)
        if last:
            break
        last = turn + 1 >= FORESTS and (joined <= max(FEW, many // 1000) or turn + 1 == MORE_FORESTS)
    for path in (blocks_path, known_path):
        discard(spark, path)

    named = nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(names, "comp").select("node", "component_id")
    return rows.select("doc_id", "n", "node").join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those whose class has a smaller doc_id; rows of no class, and of null ids, stay.

    Of repeated rows of one doc_id, all stay: they are one document.
    """
    gone = stored(near_duplicates(docs, percent).where("component_id <> doc_id").select("doc_id").distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, "doc_id", "left_anti")
