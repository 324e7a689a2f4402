"""Alignment of two tokenizers over a corpus: groups of tokens with common ends, and links with their counts.

Tokenising gives each document two arrays of ids and two of byte offsets at which tokens end. The offsets where tokens
of both end cut the tokens into groups, and the two tokens that end at such an offset are linked; this is found for
the documents of a batch at once, on flat arrays. Tokens have at least one byte, so each offset has one link.

How often two ids are linked is counted over the corpus. Linked tokens end together, so the shorter one's bytes end the longer
one's: two vocabularies have at most as many such pairs as their entries have bytes (``most_pairs``), whatever the corpus. Counts
are therefore sent to the workers, and links never leave the task that made them but as counts.

Documents whose text is null or empty, or whose tokens do not spell it, have no tokens. Repeated rows, also with null or equal ids, are
counted and returned each. An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.bpe import groups
from lodeframe.llm.common import written
from lodeframe.llm.tokens import byte_encoder, piece_encoder, public_pattern, public_vocabulary

#: Characters of the texts whose arrays are held at once.
TOGETHER = 1_000_000
#: A pair of ids as one number: the first times this, and the second.
PAIR = 1 << 20

TOKENS = "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
ALIGNED = "doc_id long, n_a int, n_b int, n_groups int, groups string, links array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(values))


def _encoders(a_path: str | None, b_path: str | None, pattern: str | None) -> tuple[str, str, str]:
    return a_path or public_vocabulary("byte_bpe_50k.json"), b_path or public_vocabulary("piece_bpe_32k.model"), pattern or public_pattern()


def _encode(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of ``TOKENS`` for batches of doc_id and text."""
    a, b = byte_encoder(a_path, pattern), piece_encoder(b_path)
    nothing = np.array([], np.int32)
    for batch in batches:
        at = 0
        # A text's four arrays are many times its size, so few texts are held at once.
        for texts in groups((t.as_py() or "" for t in batch["text"]), TOGETHER):
            made = []
            for text in texts:
                row = [nothing] * 4
                if text:
                    data = b" " + text.encode()
                    a_ids, b_ids = a.encode(" " + text), b.encode(text)
                    a_ends, b_ends = a.ends(a_ids, data), b.ends(b_ids, data)
                    if a_ends is not None and b_ends is not None:
                        row = [a_ids, a_ends, b_ids, b_ends]
                made.append(row)
            lists = {name: _lists(np.concatenate([row[k] for row in made]).astype(np.int32), [len(row[k]) for row in made]) for k, name in enumerate(("a_ids", "a_ends", "b_ids", "b_ends"))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(at, len(texts)), **lists})
            at += len(texts)


@lru_cache(maxsize=4)
def _said(size: int, marks: tuple[str, ...]) -> np.ndarray:
    """Every id below ``size`` as decimal text, followed by each of the marks."""
    return np.array([f"{i}{m}" for i in range(size) for m in marks], object)


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``ALIGNED`` for batches of ``TOKENS``, all rows of a batch at once."""
    for batch in batches:
        n_a, n_b = (batch[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a_ids", "b_ids"))
        a_ids, a_ends, b_ids, b_ends = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a_ids", "a_ends", "b_ids", "b_ends"))
        a_row, b_row = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        # Ends of later rows are made larger, so that all are in one order.
        width = max(a_ends.max(initial=0), b_ends.max(initial=0)) + 1
        a_at, b_at = a_ends + a_row * width, b_ends + b_row * width
        a_last, b_last = np.isin(a_at, b_at, assume_unique=True), np.isin(b_at, a_at, assume_unique=True)
        n_groups = np.bincount(a_row[a_last], minlength=len(n_a))
        upto = np.cumsum(n_groups)
        links = _lists(a_ids[a_last] * PAIR + b_ids[b_last], n_groups)
        # The number of a token's group; what comes after a row's last common end is in none.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_in, b_in = a_group < upto[a_row], b_group < upto[b_row]
        a_ids, a_last, a_group = a_ids[a_in], a_last[a_in], a_group[a_in]
        b_ids, b_last, b_group = b_ids[b_in], b_last[b_in], b_group[b_in]
        a_stop, b_stop = np.concatenate([[0], np.flatnonzero(a_last) + 1]), np.concatenate([[0], np.flatnonzero(b_last) + 1])
        # A group's tokens of the first vocabulary stand before those of the second, each with the mark that follows it.
        final = np.isin(b_group, upto - 1) & b_last
        words = np.empty(len(a_ids) + len(b_ids), object)
        words[np.arange(len(a_ids)) + b_stop[a_group]] = _said(_round(a_ids), (",", "|"))[a_ids * 2 + a_last]
        words[np.arange(len(b_ids)) + a_stop[b_group + 1]] = _said(_round(b_ids), (",", ";", ""))[b_ids * 3 + b_last + final]
        stops = (a_stop + b_stop)[np.concatenate([[0], upto])].tolist()
        texts = ["".join(words[i:j].tolist()) for i, j in zip(stops, stops[1:])]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_a": pa.array(n_a, pa.int32()), "n_b": pa.array(n_b, pa.int32()), "n_groups": pa.array(n_groups, pa.int32()), "groups": pa.array(texts, pa.string()), "links": links})


def _round(ids: np.ndarray) -> int:
    """A power of two above the ids, so that few tables are made."""
    return 1 << max(16, int(ids.max(initial=0)).bit_length())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, a_ids, a_ends, b_ids, b_ends of every document; the arrays are empty where the tokens do not spell its text."""
    chosen = _encoders(a_path, b_path, pattern)
    return _texts(docs).mapInArrow(lambda batches: _encode(batches, *chosen), TOKENS)


def aligned(encoded: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links of rows of ``tokens``.

    ``groups`` is text, `a1,a2|b1;a3|b2,b3`; ``links`` has a number for each link, the pair of ids in terms of PAIR.
    """
    return encoded.mapInArrow(_align, ALIGNED)


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As ``aligned`` of ``tokens``, in one pass: the arrays do not leave the task."""
    chosen = _encoders(a_path, b_path, pattern)
    return _texts(docs).mapInArrow(lambda batches: _align(_encode(batches, *chosen)), ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, links, best of rows of ``aligned``: how many links of the corpus hold the pair, and whether none holds more with the same second id."""
    counted = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy(F.col("pair") % PAIR)
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(most)).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = aligned_documents(docs, a_path, b_path, pattern).withColumn("groups_sha256", digest).drop("groups")
    kept = written(found.withColumn("row", F.monotonically_increasing_id()))
    # As many rows at most as the vocabularies' entries have bytes.
    counts = F.broadcast(pair_counts(kept))
    summed = kept.select("row", F.explode("links").alias("pair")).join(counts, "pair").groupBy("row").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = kept.drop("links").join(summed.hint("shuffle_merge"), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")], *zero, "groups_sha256")
