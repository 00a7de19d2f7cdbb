"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's ids are cut only if they are more than ``capacity``; then its first piece takes the
remainder and all others are full, so they need no partner.  Every other piece goes to an open sequence
or a new one, such that the sum over gaps of (number of open sequences with that gap) squared becomes
smallest.  The rule keeps gaps of all sizes in stock; a task that saw its last piece has no use for
the stock, so pieces come longest first, and once there are as many sequences as the tokens fill at least,
a new one is made only where none has room.

Pieces are packed in cells of about ``cell_pieces`` by a hash of their document, each in one task that
holds only lengths.  A cell leaves a few sequences open, whatever the size of the input.

Cases: a null or empty text is one piece, the end id alone; repeated and null doc_ids are packed as
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, stored

CAPACITY, END_ID = 1024, 2
#: texts are handed to Python in batches of so many bytes
BATCH = "8m"
PIECES = "row long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to those of the tokenizer file.

    The same vocabulary as ranks is several times faster.  Texts that name a special token go through
    the tokenizer file itself, which is only read when one comes.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, special: list[str] | None = None):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.slow = vocabulary, None
        self.special = re.compile("|".join(map(re.escape, special_tokens(vocabulary) if special is None else special)) or r"(?!)").search

    def __call__(self, text: str) -> bytes:
        if self.special(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def special_tokens(vocabulary: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(vocabulary).get_added_tokens_decoder().values()]


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, by the sum-of-squares rule, longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stock = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, least, never = 0, -(-int(lengths.sum()) // capacity), np.iinfo(np.int64).max
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        # a sequence with gap g gets gap g - size: -2 n(g) + 1, and 2 n(g - size) + 1 unless it is full
        after = 2 * stock[: capacity - size + 1] + 1
        after[0] = 0
        change = np.where(stock[size:] > 0, after - 2 * stock[size:] + 1, never)
        if made < least:
            change[-1] = after[-1]  # a new one adds a gap and takes none away
        best = int(np.argmin(change))
        gap = best + size if change[best] < never else capacity
        if gap < capacity:
            at = opened[gap].pop()
            stock[gap] -= 1
        else:
            at, made = made, made + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > size:
            stock[gap - size] += 1
            opened[gap - size].append(at)
    return sequence, offset


def tokenized(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds its ids."""
    files, id_type = files or default_files(), docs.schema["doc_id"].dataType.simpleString()
    special = special_tokens(files[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(*files, special)
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + np.array([END_ID], "<u4").tobytes()
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((row, doc_id, piece, start, length, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            frame["doc_id"] = frame["doc_id"].astype(batch["doc_id"].dtype)
            yield frame
        del encode
        give_back()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    return rows.mapInPandas(run, PIECES.format(id=id_type) + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, cell_pieces: int = 16_384, files: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row a piece."""
    with batches_of(docs.sparkSession, BATCH):
        pieces = stored(tokenized(docs, capacity, files, with_ids))
    cells = max(1, round(pieces.where(F.col("length") < capacity).count() / cell_pieces))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    extra = ["ids"] * with_ids

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece"], kind="stable")
        sequence, offset = pack_lengths(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["cell"].to_numpy() << 32) + sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra]]

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    short = pieces.where(F.col("length") < capacity).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long"))
    full = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *extra)
    return short.groupBy("cell").applyInPandas(run, schema).unionByName(full)
