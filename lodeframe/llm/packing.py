"""Packing documents into sequences of a fixed number of tokens, by exact complements, then best fit.

Documents become pieces of at most ``capacity`` tokens. What can be packed with what depends
on lengths alone, and there are at most ``capacity`` of them, so the plan is made from the count
of pieces of each length: a table that is bounded whatever the number of documents. The plan
(``plan``) says which lengths share a sequence and how many sequences are filled alike; the pieces
then find their places by their rank among the pieces of their length.

The plan looks up what fills the gap beside a length exactly: one length, a pair, or a triple,
by an index of the sums of one and of two lengths in stock (a triple is a length beside a pair).
A combination is used as often as the stock of its lengths allows. What has no exact complement is
packed by best fit: the longest piece that fits, until an exact complement of the gap is in stock.

Null texts count as empty; an empty document is its closing token alone. Repeated rows are packed each
on its own, also those with null or equal ids. An empty table gives no rows. Columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import checkpoint
from lodeframe.llm.tokens import public_vocabulary, word_encoder

#: Tokens of a sequence, and the id that closes a document.
CAPACITY, CLOSING = 4096, 1
#: Pieces of one length are ranked in so many parts.
PARTS = 64

Pattern = tuple[int, list[tuple[int, int]]]


class Stock:
    """How many pieces of each length are left, with an index of the sums of two lengths in stock."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n
        here = (self.n > 0).astype(np.int64)
        # Ways to make each sum of two lengths, whichever comes first; a length meets itself as well.
        self.ways = np.rint(np.convolve(here, here)[: capacity + 1]).astype(np.int64)

    def take(self, pattern: dict[int, int], times: int) -> None:
        for length, copies in pattern.items():
            self.n[length] -= copies * times
            if not self.n[length]:
                others = np.flatnonzero(self.n > 0)
                others = others[others + length < len(self.ways)]
                self.ways[others + length] -= 2
                if 2 * length < len(self.ways):
                    self.ways[2 * length] -= 1

    def has(self, *lengths: int) -> bool:
        return all(self.n[x] >= k for x, k in Counter(lengths).items())

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths in stock with this sum, the longest of them as long as can be."""
        if total < 2 or not self.ways[total]:
            return None
        short = np.arange(1, total // 2 + 1)
        for x in short[(self.n[short] > 0) & (self.n[total - short] > 0)]:
            if self.has(int(x), total - int(x)):
                return total - int(x), int(x)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One to three lengths in stock whose sum is the gap, as few as can be."""
        if gap < 1:
            return None
        if self.n[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        third = np.arange(gap - 2, 0, -1)
        for z in third[(self.n[third] > 0) & (self.ways[gap - third] > 0)]:
            z = int(z)
            self.n[z] -= 1
            two = self.pair(gap - z)
            self.n[z] += 1
            if two:
                return z, *two
        return None

    def longest(self, most: int) -> int:
        """The longest length in stock up to ``most``; 0 if there is none."""
        found = np.flatnonzero(self.n[: most + 1] > 0)
        return int(found[-1]) if len(found) else 0

    def times(self, pattern: dict[int, int]) -> int:
        return int(min(self.n[x] // k for x, k in pattern.items()))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (number of sequences, [(length, copies)]) that use every piece of ``counts`` (length: number) once.

    Every step uses up a length, or leaves less of it than the pattern needs, so there are a
    few times ``capacity`` patterns at most.
    """
    stock, out = Stock(counts, capacity), []

    def use(pattern: Counter) -> None:
        n = stock.times(pattern)
        stock.take(pattern, n)
        out.append((n, sorted(pattern.items(), reverse=True)))

    for length in range(capacity, 0, -1):
        while stock.n[length]:
            stock.n[length] -= 1
            rest = () if length == capacity else stock.complement(capacity - length)
            stock.n[length] += 1
            if rest is None:
                break
            use(Counter((length, *rest)))
    while length := stock.longest(capacity):
        pattern, gap = Counter(), capacity
        before = stock.n.copy()
        while length:
            pattern[length] += 1
            stock.n[length] -= 1
            gap -= length
            if rest := stock.complement(gap):
                pattern.update(rest)
                break
            length = stock.longest(gap)
        stock.n = before
        use(pattern)
    return out


def places(patterns: list[Pattern]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """length, first, n, sequences, sequence_id, offset: where the n pieces of a length from rank ``first`` on go.

    Piece first + j is in sequence sequence_id + j % sequences, j // sequences pieces of its length after the offset.
    """
    used: Counter[int] = Counter()
    base = 0
    for sequences, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            yield length, used[length], sequences * copies, sequences, base, offset
            used[length] += sequences * copies
            offset += length * copies
        base += sequences


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and token_ids if asked for.

    One narrow pass. Only documents of more than ``capacity`` tokens are cut; the last piece may be shorter.
    """
    path = path or public_vocabulary("word_bpe_49k.json")
    end, most = np.array([closing], "<u4"), capacity
    fields = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"token_ids": pa.list_(pa.int64())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        for batch in batches:
            rows, made = [], {f: [] for f in fields}
            for at, text in enumerate(batch["text"]):
                ids = np.concatenate([own.encode(text.as_py() or ""), end])
                for k in range(0, len(ids), most):
                    piece = ids[k : k + most].astype("<u4")
                    rows.append(at)
                    made["piece"].append(k // most)
                    made["start"].append(k)
                    made["length"].append(len(piece))
                    made["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        made["token_ids"].append(piece.astype("int64"))
            out = {"doc_id": batch["doc_id"].take(pa.array(rows, pa.int64()))} | {f: pa.array(made[f], kind) for f, kind in fields.items()}
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", token_ids array<long>" * with_ids)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` (with ``length``) and sequence_id, offset.

    The counts of lengths, at most ``capacity`` rows, go to the driver, which plans; the plan has at most
    some hundred thousand rows for 4096 tokens, by the lengths alone, and is sent to the workers. Pieces of a length
    are ranked in parts that a hash deals them to; equal rows are counted first, so that they burden no part.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places_ = spark.createDataFrame(list(places(plan(counts, capacity))), "__length long, __first long, __n long, __sequences long, __base long, __from long")
    columns = pieces.columns
    rows = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__part", F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int"))
    # At most PARTS rows for each length.
    sums = rows.groupBy("length", "__part").agg(F.sum("__copies").alias("__sum"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("length", "__part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("__inside", F.coalesce(F.sum("__copies").over(inside), F.lit(0))).join(F.broadcast(starts), ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.explode(F.expr("sequence(__start + __inside, __start + __inside + __copies - 1)")))
    found = ranked.join(F.broadcast(places_), F.expr("length = __length and __rank >= __first and __rank < __first + __n"))
    return found.withColumn("__j", F.expr("__rank - __first")).select(
        *columns,
        F.expr("__base + __j % __sequences").alias("sequence_id"),
        F.expr("__from + (__j div __sequences) * length").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, closing: int = CLOSING) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    # The pieces are read for their lengths and again for their places; without their ids they are narrow.
    return assign(checkpoint(cut(docs, capacity, path, closing)), capacity)
