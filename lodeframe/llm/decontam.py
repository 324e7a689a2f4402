"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 10 consecutive words of the benchmark items; an item of
fewer words is one window. Patterns of one length form a set. A block is two words (one
word in sets of length 1). The shift table says how far the search may move on when a
block ends at the current word; blocks that end a pattern have shift 0 and lead to a
bucket of patterns by suffix and prefix, which are compared with the text word by word. Words
inside any occurrence are hit.

A null text, and one without words, has no words and no hits. An empty benchmark, and
items without words, give no patterns. Repeated items count by their item_id; null ids
are left out. Extra columns, whatever their names, are kept as they are by the filter. Long texts are
searched whole, repeated rows each by itself, and an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import byte_words, checkpoint, columns_of, unused

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text whose tables are sent to the workers at once; a larger benchmark takes more passes.
MOST_BYTES = 8_000_000


class Searcher:
    """Tables for one set of items: (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        ids: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                ids.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.sets = []
        for n in sorted({len(p) for p in ids}):
            own = {p: tuple(sorted(of)) for p, of in ids.items() if len(p) == n}
            block = min(2, n)
            shift: dict = {}
            bucket: dict = {}
            for p, of in own.items():
                for end in range(block, n + 1):
                    key = p[end - block : end] if block == 2 else p[0]
                    shift[key] = min(shift.get(key, n), n - end)
                # Many patterns may have one suffix, so those of a bucket are told apart by their first words as well.
                bucket.setdefault(p[n - block :] if block == 2 else p[0], {}).setdefault(p[:block], []).append((list(p), of))
            self.sets.append((n, block, shift, bucket))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, number of words, items) of every occurrence."""
        for n, block, shift, bucket in self.sets:
            get, i, end = shift.get, n - 1, len(words)
            if block == 1:
                for i in range(end):
                    for _, of in bucket.get(words[i], {}).get((words[i],), ()):
                        yield i, 1, of
                continue
            far = n - 1
            while i < end:
                key = (words[i - 1], words[i])
                step = get(key, far)
                if step:
                    i += step
                    continue
                start = i - n + 1
                for pattern, of in bucket[key].get((words[start], words[start + 1]), ()):
                    if words[start : i + 1] == pattern:
                        yield start, n, of
                i += 1


def _chunks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in as many bounded parts as they need; each part is fetched by itself."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most)
    for k in range(parts):
        yield [(r.item, byte_words(r.text)) for r in (items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, found: str, text: str = "text", window: int = WINDOW, most: int = MOST_BYTES, only_clean: bool = False) -> DataFrame:
    """The rows of ``docs`` and a struct ``found`` of n_words, hits (runs of hit words as start, end, start, end ...) and items.

    One narrow pass over the documents for each part of the benchmark, as a rule one. With
    ``only_clean`` rows with hits are dropped as soon as they are known.
    """
    out = docs.withColumn(found, F.expr("named_struct('n_words', 0L, 'hits', cast(array() as array<int>), 'items', cast(array() as array<string>))"))
    searched = False
    for items in _chunks(benchmark, most):
        if searched:
            out = checkpoint(out)
        searched = True
        out = _pass(out, items, found, text, window)
        if only_clean:
            out = out.filter(F.size(f"{found}.hits") == 0)
    return out if searched else _pass(out, [], found, text, window)


def _pass(docs: DataFrame, items: list[tuple[str, list[bytes]]], found: str, text: str, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("n_words long, hits array<int>, items array<string>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(sent.value, window)
        for texts, hits, ids in batches:
            n, runs, names = [], [], []
            for t, old, before in zip(texts, hits, ids):
                words = byte_words(t)
                spans = [(s, s + m, of) for s, m, of in searcher.search(words)]
                n.append(len(words))
                if not spans:
                    runs.append(old)
                    names.append(before)
                    continue
                merged: list[list[int]] = []
                for s, e in sorted([(s, e) for s, e, _ in spans] + list(zip(old[::2], old[1::2]))):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], int(e))
                    else:
                        merged.append([int(s), int(e)])
                runs.append([x for run in merged for x in run])
                names.append(sorted(set(before).union(*(of for _, _, of in spans))))
            yield pd.DataFrame({"n_words": n, "hits": runs, "items": names})

    return docs.withColumn(found, search(F.col(text).cast("string"), f"{found}.hits", f"{found}.items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, "found", "text", window, most)
    rows = rows.select("doc_id", "found.n_words", "found.hits", "found.items")
    n_hit = F.expr("aggregate(sequence(0, size(hits) div 2 - 1), 0L, (n, i) -> n + hits[2 * i + 1] - hits[2 * i])")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of the benchmark."""
    found = unused("found", docs)
    return scan(docs, benchmark, found, "text", window, most, only_clean=True).filter(F.size(f"{found}.hits") == 0).select(*columns_of(docs))


ORACLE = r"""
with iw as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
windows as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from iw where len(w) > 0)),
dw as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
lens as (select distinct n from windows),
grams as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hits as (select rid, i, g.n, item from grams g join windows v on g.n = v.n and g.win = v.win),
covered as (select rid, count(distinct i + k) as n_hit from (select distinct rid, i, n from hits), range(0, 10) t(k) where k < n group by rid),
items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from dw left join covered using (rid) left join items using (rid)
"""
