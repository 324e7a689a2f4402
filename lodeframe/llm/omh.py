"""Near-duplicate groups by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with how many equal ones
came before. A sketch takes the ``PER_SKETCH`` least of them under one of ``SKETCHES``
hash functions and keeps them in text order, so that texts agree on it with a probability
that follows their edit similarity. Texts that agree on a sketch are candidates. They are
aligned: two texts are near duplicates if the longest common subsequence of their words
has at least 0.8 of the words of the longer one. The band is as wide as an alignment that
good can need, so the result is exact. Groups are the connected components.

All texts have sketches of shorter k-mers as well, of two words up to ``SHORT`` words and
of three beyond, since one edit spoils up to five runs of five.

How work stays bounded. Texts with equal words are one node from the start. A bucket of
up to ``SMALL`` nodes has all its pairs verified. In a larger one every node is first paired with
a leader. What the links found so far leave in different classes is then compared in full. A bucket
of up to ``BLOCK`` nodes is one cell: a pair is aligned unless its texts are
connected already, met under an earlier sketch or have too few words in common. Nodes of larger buckets
are not dealt to cells by twos of blocks, of which there are as many as the square of the bucket: they meet, all such buckets together,
where they share one of their rarest words (``crowd_pairs``), as texts that are near must, whichever the words
in between. A node has as many rows there as a fifth of its words. So every
pair that shares a bucket is either tried or in one class. Candidates of which the longer
one is too long are dropped, as no alignment could link them. Texts are read for their words once, for all
nodes that may be compared, and left out of all other shuffles but those of pairs. The driver gets tables of fixed size only.

Null text, and one without words, is near to nothing but an equal non-null text. Rows
whose doc_id is null get an id by their text and may be in groups. The class of
a group is its least id. Rows are told apart by id and text: repeats of both are copies, and
of different texts under one id each has a class of its own, named by a hash of id and words (below zero)
unless it is alone in having the id, and keeps its row if it is not near another. Extra
columns, whatever their names, are kept as they are. Empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import byte_words, checkpoint, columns_of, lookup_join, unused, weighed_join, written
from lodeframe.operators import graph
from lodeframe.plans.skew import HOT_SHARE, salted_join
from lodeframe.session import spread

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PER_SKETCH, SHORT, SHORT_WORDS, LONG_WORDS = 28, 2, 64, 2, 3
SMALL, BLOCK = 12, 512
#: Counters by which words are put in order, and those of a text that tell texts apart; words before a place that are kept to see whether two texts met there; holders of one word in a task.
SLOTS, COUNTERS, BEFORE, HOLDERS = 4096, 1024, 4, 4096
#: k-mers times sketches whose hashes are held at once.
CELLS = 2_000_000

_MIX1, _MIX2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, in place."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words and its number among equal ones; a shorter text is one run."""
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix((h + words[i : i + n]) * _ODD)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    label = np.empty(n, np.uint64)
    label[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return _mix(h + label * _ODD)


def sketches(kmers: np.ndarray, salt: int) -> np.ndarray:
    """One key for each hash function: the least k-mers under it, in text order."""
    n, m = len(kmers), min(PER_SKETCH, len(kmers))
    seeds = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD + np.uint64(salt))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, CELLS // n)
    for s in range(0, SKETCHES, step):
        own = seeds[s : s + step]
        x = _mix(kmers[None, :] ^ own[:, None])
        least = np.tile(np.arange(m), (len(own), 1))
        if m < n:
            for j in range(m):
                least[:, j] = x.argmin(axis=1)
                x[np.arange(len(own)), least[:, j]] = np.uint64(2**64 - 1)
            least.sort(axis=1)
        key = own.copy()
        for j in range(m):
            key = _mix((key + kmers[least[:, j]]) * _ODD)
        out[s : s + step] = key
    return out.view(np.int64)


def text_sketches(hashes: np.ndarray) -> np.ndarray:
    """The sketches of a text of these words: of five-word k-mers and of shorter ones.

    Texts of lengths about ``SHORT`` have both kinds of shorter ones, so that those which an
    alignment could link have one in common.
    """
    n = len(hashes)
    sizes = [WORDS] + [SHORT_WORDS] * (n <= SHORT) + [LONG_WORDS] * (n > SIMILARITY * SHORT)
    return np.concatenate([sketches(labelled_kmers(hashes, k), k) for k in sizes])


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, h, text in zip(batch["key"], batch["h"], batch["text"]):
            words = byte_words(text)
            if words:
                content = b" ".join(words)
                hashes = word_hashes(words)
                sk = text_sketches(hashes)
            else:
                # No words: equal texts are copies, null ones are not.
                content = b"\0" + (text.encode("utf-8", "surrogatepass") if text is not None else b"\0" + str(key).encode())
                sk = np.zeros(0, np.int64)
            full = xxhash.xxh3_128(content).intdigest()
            out.append((key, h, (full >> 64) - (1 << 63), (full & ((1 << 64) - 1)) - (1 << 63), len(words), sk))
        yield pd.DataFrame(out, columns=["rid", "h", "k1", "k2", "n", "sk"])


def row_id(docs: DataFrame) -> Column:
    """The id of a row; where it is null, one made of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.col("text").cast("string")))


def text_id(docs: DataFrame) -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def digests(docs: DataFrame) -> DataFrame:
    """rid, h (of the text), k1, k2 (128 bits of the words), n (words), sk (sketches) of every row."""
    rows = docs.select(row_id(docs).alias("key"), text_id(docs).alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_digest, "rid long, h long, k1 long, k2 long, n int, sk array<long>")


def buckets(nodes: DataFrame, total: int) -> DataFrame:
    """rid, n, key, members (of the bucket) for every node (rid, n, sk) and each of its buckets that has others."""
    # A text has two or three times SKETCHES rows here, of a few bytes each.
    rows = nodes.select("rid", "n", F.explode("sk").alias("key"))
    # Most keys are one node's alone: they are counted, and nothing else, before rows go by them.
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return lookup_join(rows, found.withColumn("weight", F.col("members")), ["key"], "weight", total, "inner").select("rid", "n", "key", "members")


def candidate_pairs(found: DataFrame, total: int, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs a < b: all of small buckets, and those with the leader of larger ones."""
    return _within_small(found, similarity).unionByName(_with_leader(found.filter(F.col("members") > SMALL), total, similarity)).distinct()


def _with_leader(rows: DataFrame, total: int, similarity: float) -> DataFrame:
    """Each row with the leader of its bucket.

    The leader is the member whose id has the least hash, so that the buckets that one
    group of near copies has under all sketches mostly agree on it, and pairs with it repeat.
    """
    leaders = rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct(F.xxhash64(F.lit(1), "rid").alias("h"), "rid", "n")).alias("leader"))
    rows = lookup_join(rows.select("rid", "n", "key"), leaders, ["key"], "weight", total, "inner")
    return _pair("rid", "n", "lr", "ln", similarity, rows.select("rid", "n", F.col("leader.rid").alias("lr"), F.col("leader.n").alias("ln")))


def _pair(a: str, na: str, b: str, nb: str, similarity: float, df: DataFrame) -> DataFrame:
    close = F.least(na, nb) >= F.greatest(na, nb) * F.lit(similarity)
    return df.filter(close & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _within_small(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs of buckets of SMALL members at most."""
    lists = rows.filter(F.col("members") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rid", "n"))).alias("m"))
    pairs = lists.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    return _pair("xr", "xn", "yr", "yn", similarity, pairs.select(F.col("x.rid").alias("xr"), F.col("x.n").alias("xn"), F.col("y.rid").alias("yr"), F.col("y.n").alias("yn")))


def in_large(found: DataFrame, label: DataFrame) -> DataFrame:
    """rid, class, key: the large buckets of each node. A node's class is looked up once, not for each of its buckets."""
    nodes = found.filter(F.col("members") > SMALL).groupBy("rid").agg(F.collect_list("key").alias("keys"))
    known = nodes.join(label.withColumnRenamed("node", "rid").hint("shuffle_merge"), "rid", "left")
    return known.select("rid", F.coalesce("class", "rid").alias("class"), F.explode("keys").alias("key"))


def rest_of_large(found: DataFrame, label: DataFrame, nodes: DataFrame, words: DataFrame, total: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of one large bucket that ``label`` (node, class) has in different classes. ``words`` (rid, w) has the nodes of all large buckets."""
    large = in_large(found, label)
    large = written(large)
    state = large.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("low"), F.max("class").alias("high"))
    state = state.withColumn("weight", F.col("members")).withColumn("open", F.col("low") != F.col("high")).drop("low", "high")
    left = written(lookup_join(large, state, ["key"], "weight", total).filter("open").select("rid", "class", "key", "members"))
    cells = left.filter(F.col("members") <= BLOCK).drop("members")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_cell(pdf, similarity), columns=["a", "b"], dtype="int64")

    within = salted_join(cells, words.join(nodes.select("rid", "sk").hint("shuffle_merge"), "rid"), "rid", cells.count()).groupBy("key").applyInPandas(compare, "a long, b long")
    crowd = left.filter(F.col("members") > BLOCK).select("rid", "class").distinct()
    crowd = words.join(crowd.hint("shuffle_merge"), "rid")
    return within.unionByName(verified(checkpoint(crowd_pairs(crowd, similarity)), words, similarity))


def crowd_pairs(crowd: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Different pairs a < b of the nodes (rid, w, class) of different classes that may be near; none that is near is missing.

    Equal words of a text are numbered, so that a text is a set of words. All sets are put in one order, words that
    are rare in ``crowd`` first. Two texts of which the longer one has 0.8 of its words in common with the other share one of
    the first fifth of the words of each, and meet there. A word that more than ``HOLDERS`` texts have there is
    dealt to tasks; those of its commonest class are not compared with one another, so that blocks of that class are not paired.
    """
    crowd = checkpoint(spread(crowd))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for w in batch["w"]:
                n += np.bincount((_set_of(w) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        yield pd.DataFrame({"slot": np.flatnonzero(n), "n": n[n > 0]})

    common = np.zeros(SLOTS, np.int64)
    for row in crowd.select("w").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        common[row.slot] = row.n

    def rare(w: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = _set_of(w)
        first = words[np.lexsort((words, common[(words % np.uint64(SLOTS)).astype(np.int64)]))]
        return words, first[: len(words) - int(np.ceil(similarity * len(words) - 1e-9)) + 1]

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [rare(w)[1].view(np.int64) for w in batch["w"]]
            yield pd.DataFrame({"word": np.concatenate([*found, np.zeros(0, np.int64)]), "class": np.repeat(batch["class"].to_numpy(), [len(f) for f in found])})

    held = crowd.select("class", "w").mapInPandas(holders, "word long, class long").groupBy("word", "class").agg(F.count(F.lit(1)).alias("n"))
    held = checkpoint(held.groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most")))
    bound = max(HOLDERS, -(-(held.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_SHARE))
    # As many words as HOT_SHARE at most. Where all are of one class there is nothing to compare.
    hot = {r.word: (r.most["class"], -(-r.most["n"] // bound), -(-(r.n - r.most["n"]) // bound)) for r in held.filter(F.col("n") > bound).collect()}

    def cells(word: int, rid: int, own: int) -> Iterator[tuple[int, int, int]]:
        """The block of a node among the holders of a word, and the cells (two blocks) that it goes to."""
        most, blocks, others = hot.get(word, (None, 0, 1))
        at = xxhash.xxh3_64_intdigest(str(rid))
        if own == most:
            for o in range(blocks, blocks + others):
                yield at % blocks, at % blocks, o
        else:
            mine = blocks + at % others
            for o in range(blocks + others):
                yield mine, min(mine, o), max(mine, o)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["word", "lo", "hi", "own", "rid", "class", "n", "before", "counts"], []
        for batch in batches:
            for rid, c, w in zip(batch["rid"], batch["class"], batch["w"]):
                words, first = rare(w)
                counts = np.minimum(np.bincount((words % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS), 15).astype(np.uint8)
                # Packed once for all rows of the text.
                counts = zlib.compress((counts[::2] << 4 | counts[1::2]).tobytes(), 1)
                for i, word in enumerate(first.view(np.int64).tolist()):
                    before = np.zeros(BEFORE, np.uint64)
                    before[: min(i, BEFORE)] = first[max(0, i - BEFORE) : i]
                    before = before.tobytes()
                    out += [(word, lo, hi, own, rid, c, len(words), before, counts) for own, lo, hi in cells(word, rid, c)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    dealt = crowd.mapInPandas(deal, "word long, lo int, hi int, own int, rid long, class long, n int, before binary, counts binary")
    parts = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, "word", "lo", "hi").sortWithinPartitions("word", "lo", "hi")
    return met.mapInPandas(lambda batches: _meet(batches, similarity), "a long, b long").distinct()


def _set_of(w: bytes) -> np.ndarray:
    """The words of a text, equal ones told apart by number."""
    return labelled_kmers(np.frombuffer(w, np.uint32).astype(np.uint64), 1)


def _meet(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs of each cell of rows that come in order of their cells."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        cell, top = rows[["word", "lo", "hi"]].to_numpy(), rows["class"].to_numpy()
        starts = np.concatenate([[0], 1 + np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))])
        # The last cell may go on in the next batch.
        held = rows.iloc[starts[-1] :]
        mixed = np.minimum.reduceat(top, starts) != np.maximum.reduceat(top, starts)
        for at in np.flatnonzero(mixed[:-1]).tolist():
            yield from _cell_pairs(rows.iloc[starts[at] : starts[at + 1]], similarity)
    if held is not None:
        yield from _cell_pairs(held, similarity)


def _cell_pairs(rows: pd.DataFrame, similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs of one cell that may be near and share no word before this one."""
    top, size, own, rids = (rows[c].to_numpy() for c in ("class", "n", "own", "rid"))
    across, m = rows["lo"].iloc[0] != rows["hi"].iloc[0], len(rows)
    packed = np.frombuffer(b"".join(map(zlib.decompress, rows["counts"])), np.uint8).reshape(m, COUNTERS // 2)
    counts = np.concatenate([packed >> 4, packed & 15], axis=1).astype(np.int8)
    # Sums of four, for a first look.
    folded = counts.reshape(m, 4, COUNTERS // 4).sum(axis=1, dtype=np.int16)
    before = np.frombuffer(b"".join(rows["before"]), np.uint64).reshape(m, BEFORE)
    step = max(1, 20_000 // m)
    for s in range(0, m, step):
        at = np.arange(s, min(s + step, m))
        ok = (top[at, None] != top) & (at[:, None] < np.arange(m))
        ok &= np.minimum(size[at, None], size) >= similarity * np.maximum(size[at, None], size) - 1e-9
        if across:
            ok &= own[at, None] != own
        i, j = np.nonzero(ok)
        i = at[i]
        # What differs in counters differs in words.
        for held in (folded, counts):
            near = np.abs(held[i] - held[j]).sum(axis=1) <= size[i] + size[j] - 2 * similarity * np.maximum(size[i], size[j]) + 1e-9
            i, j = i[near], j[near]
        met = ((before[i][:, :, None] == before[j][:, None, :]) & (before[i] != 0)[:, :, None]).any(axis=(1, 2))
        i, j = i[~met], j[~met]
        if len(i):
            yield pd.DataFrame({"a": np.minimum(rids[i], rids[j]), "b": np.maximum(rids[i], rids[j])})


def _cell(pdf: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links of one bucket that connect classes."""
    pdf = pdf.sort_values("rid")
    rids, key = pdf["rid"].tolist(), int(pdf["key"].iloc[0])
    words = [np.frombuffer(w, np.uint32) for w in pdf["w"]]
    # What a text has before this key, by place; places where a text has nothing or another kind of sketch never agree.
    before = [list(s)[: list(s).index(key)] for s in pdf["sk"]]
    at = max(map(len, before))
    sk = np.array([b + [i] * (at - len(b)) for i, b in enumerate(before)], np.int64)
    size = np.array([len(w) for w in words])
    # Equal words are numbered, so that texts have as many of these in common as words.
    labelled = [labelled_kmers(w.astype(np.uint64), 1) for w in words]
    codes = np.unique(np.concatenate(labelled), return_inverse=True)[1]
    codes = np.split(codes, np.cumsum(size)[:-1])
    marks = np.zeros(max(int(c.max()) for c in codes) + 1, np.int32)
    top = np.unique(pdf["class"].to_numpy(), return_inverse=True)[1]
    out = []
    for i in range(len(rids) - 1):
        # What costs least goes first: words are counted for those that are left.
        later = np.arange(i + 1, len(rids))
        later = later[top[later] != top[i]]
        later = later[np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i]) - 1e-9]
        if at:
            later = later[~(sk[later, :at] == sk[i, :at]).any(axis=1)]
        if not len(later):
            continue
        marks[codes[i]] = 1
        starts = np.concatenate([[0], np.cumsum(size[later])[:-1]])
        shared = np.add.reduceat(marks[np.concatenate([codes[j] for j in later.tolist()])], starts)
        marks[codes[i]] = 0
        later = later[shared >= similarity * np.maximum(size[later], size[i]) - 1e-9]
        for j in later.tolist():
            if top[i] != top[j] and similar(words[i], words[j], similarity):
                out.append((rids[i], rids[j]))
                top[top == top[j]] = top[i]
    return out


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence among alignments that stay within ``band`` of the diagonal.

    A row of the table is a number with a bit for each column of the band: 0 where the
    length grows. One addition finds the next row.
    """
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(differ[0]) if len(differ) else same
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    at: dict[int, int] = {}
    shared = np.isin(a, b)
    for i in np.flatnonzero(shared).tolist():
        at[int(a[i])] = at.get(int(a[i]), 0) | 1 << i
    n, grown = len(a), 0
    full = row = (1 << min(n, 2 * band + 1)) - 1
    low = 0
    for j, t in enumerate(b.tolist()):
        if j > band and low < n:
            # The band moves on by one column: what leaves it is settled.
            grown += 1 - (row & 1)
            row = row >> 1 | 1 << 2 * band if low + 2 * band + 1 < n else row >> 1
            low += 1
            full = (1 << max(0, min(2 * band + 1, n - low))) - 1
            row &= full
        hit = at.get(t)
        if hit is not None:
            hit = hit >> low & row
            if hit:
                row = ((row + hit) | (row - hit)) & full
    return head + tail + grown + full.bit_length() - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment keeps ``similarity`` of the words of the longer text."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    least = similarity * longer - 1e-9
    if shorter < least:
        return False
    # An alignment that good leaves out so many words of one text at most, and leaves the diagonal no further.
    return common(a, b, int(longer - least) + 1) >= least


def _words(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """rid, w: the texts of the nodes ``needed`` (rid; own and h, the row that stands for it), as numbers of their words."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rid": batch["rid"], "w": [np.array([xxhash.xxh32_intdigest(w) for w in byte_words(t)], np.uint32).tobytes() for t in batch["text"]]})

    texts = docs.select(row_id(docs).alias("own"), text_id(docs).alias("h"), F.col("text").cast("string").alias("text"))
    # Repeats of a row have equal texts: one is taken, where the join has put them.
    texts = texts.join(needed.select("rid", "own", "h"), ["own", "h"]).groupBy("own", "h", "rid").agg(F.min("text").alias("text"))
    return texts.select("rid", "text").mapInPandas(read, "rid long, w binary")


def verified(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose texts, by their ``words`` (rid, w), are near duplicates."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(batch["wa"], batch["wb"])]
            yield batch.loc[ok, ["a", "b"]]

    size = pairs.count()
    one = salted_join(pairs, words.withColumnRenamed("rid", "b").withColumnRenamed("w", "wb"), "b", size)
    # The hash that deals the rows of a hot leader must not read the texts.
    both = salted_join(one.select("a", F.struct("b", "wb").alias("y")), words.withColumnRenamed("rid", "a").withColumnRenamed("w", "wa"), "a", size)
    return both.select("a", "y.b", "wa", "y.wb").mapInPandas(align, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, class for each node of the links (a, b): the least node that it is connected to."""
    return graph.components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """rid, h, class, kept (whether the row or a repeat of it stands for its class) of every row; rows of one class are near duplicates of each other, by links."""
    rows = written(digests(docs))
    total = rows.count()
    groups = rows.groupBy("k1", "k2").agg(F.min(F.struct("rid", "h")).alias("x"), F.count(F.lit(1)).alias("weight")).select("k1", "k2", F.col("x.rid").alias("own"), F.col("x.h").alias("h"), "weight")
    # A group is known by its least id, or, if another group has that too, by a hash.
    groups = checkpoint(groups)
    twice = groups.groupBy("own").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    named = F.when(F.col("groups").isNull(), F.col("own")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("own", "k1", "k2"), 2))
    groups = checkpoint(lookup_join(groups, twice.withColumn("rows", F.col("groups")), ["own"], "rows", total).withColumn("node", named).drop("groups"))
    nodes = written(rows.select(F.col("rid").alias("own"), "h", "n", "sk").join(groups.select("own", "h", F.col("node").alias("rid")), ["own", "h"]).groupBy("rid").agg(F.min("own").alias("own"), F.min("h").alias("h"), F.min("n").alias("n"), F.min("sk").alias("sk")))
    found = written(buckets(nodes, total))
    pairs = checkpoint(candidate_pairs(found, total, similarity))
    compared = pairs.select(F.explode(F.array("a", "b")).alias("rid")).union(found.filter(F.col("members") > SMALL).select("rid")).distinct()
    words = written(_words(docs, nodes.join(compared, "rid", "left_semi")))
    near = checkpoint(verified(pairs, words, similarity))
    label = components(near)
    rest = checkpoint(rest_of_large(found, label, nodes, words, total, similarity))
    # What the rest links are classes by now: only their ends need connecting again.
    ends = rest
    for end in ("a", "b"):
        ends = weighed_join(ends, label.select(F.col("node").alias(end), F.col("class").alias(f"{end}_")), [end], total).withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
    joined = components(ends).select(F.col("node").alias("class"), F.col("class").alias("last"))
    known = groups.join(label.hint("shuffle_merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = weighed_join(known, joined, ["class"], total).withColumn("class", F.coalesce("last", "class"))
    classes = known.select("k1", "k2", "weight", "class", F.when(F.col("class") == F.col("node"), F.struct("own", "h")).alias("first"))
    out = lookup_join(rows.select("rid", "h", "k1", "k2"), classes, ["k1", "k2"], "weight", total)
    kept = F.coalesce((F.col("rid") == F.col("first.own")) & F.col("h").eqNullSafe(F.col("first.h")), F.lit(False))
    return out.select("rid", "h", "class", kept.alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept (the representative) of every row."""
    found = near_duplicates(docs, similarity)
    return found.select(F.col("rid").alias("doc_id"), F.col("class").alias("class_id"), "kept")


def remove_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, that of the least id, with all columns of ``docs``; of repeats of that row one."""
    rid, h, many = unused("rid", docs), unused("h", docs), unused("rows", docs)
    kept = near_duplicates(docs, similarity).filter("kept").groupBy("rid", "h").agg(F.count(F.lit(1)).alias(many))
    kept = kept.withColumnRenamed("rid", rid).withColumnRenamed("h", h)
    rows = docs.withColumn(rid, row_id(docs)).withColumn(h, text_id(docs)).join(kept, [rid, h])
    once, repeated = rows.filter(F.col(many) == 1), rows.filter(F.col(many) > 1)
    return once.select(*columns_of(docs)).union(repeated.dropDuplicates([rid, h]).select(*columns_of(docs)))
