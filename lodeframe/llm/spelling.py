"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

A word of ``m`` characters is cut into grams of three at fixed places. One edit reaches into one of them only, so
two words that are one edit apart, the longer of ``m`` characters, share all grams but one: those before it at the
same place, those after it at a place that differs by the difference of lengths. The index is dealt out by these:
for each word, for each gram that may differ, the rest of the word is the key under which it is posted (in the class of its own
length, and in the class of the next length, where it is the shorter one). What meets under a key has the length and the places of
all but three characters in common, so that a list holds what three characters can spell and no more, whatever
the corpus. Within a list the words' own positional q-grams are indexed, each word merges the postings of its grams
through a heap under the limits of length and place, and the pairs that share as many grams as one edit
leaves are verified. A pair is taken from the key of its first difference alone, so it comes once.

A word's form is its near word of largest count, if that outnumbers it enough; roots follow forms to the last.

Null texts have no words; a null doc_id counts as an empty one. Rows count as often as they are there. Ties of counts go to the least word
in code-point order. Tables without words give no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import ascii_lower, checkpoint
from lodeframe.session import settle

#: Runs of these are words; at least so many characters and occurrences; a form has so many times the count; every so manyth run loses a character.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = "[A-Za-z\\u00C0-\\u00FF]+", 7, 2, 10, 31
#: Characters of the gram that may differ, and of the grams that are counted.
CUT, Q = 3, 2


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n: the runs of letters of ``docs`` (doc_id, text), A-Z lower-cased, with their counts over all documents.

    Where the checksum of document and run is divisible by ``damaged``, the run loses the character that the checksum names.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.filter(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % damaged == 0, shorter).otherwise(F.col("run"))
    found = long.select(word.alias("word")).filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def postings(found: DataFrame) -> DataFrame:
    """key, cut, longest, word, n: a row for each gram of each word (word, n) that may differ, in both classes of length."""
    size = F.length("word")
    spread = found.select("word", "n", F.explode(F.array(size, size + 1)).alias("longest"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("longest") - 1) / CUT).cast("int"))).alias("cut"))
    before = F.col("word").substr(F.lit(1), F.col("cut") * CUT)
    # The grams that follow are as far from the end in the shorter word as in the longer one.
    rest = F.greatest(F.col("longest") - (F.col("cut") + 1) * CUT, F.lit(0))
    after = F.col("word").substr(size - rest + 1, rest)
    return spread.select(F.xxhash64("longest", "cut", before, F.lit("\0"), after).alias("key"), "cut", "longest", "word", "n")


def _grams(word: str, cut: int, longest: int) -> list[tuple[str, int]]:
    """The positional q-grams that reach into the gram that may differ; the others are in all words of the list. Both ends count as characters."""
    rest = max(longest - (cut + 1) * CUT, 0)
    padded = f"\0{word}\1"
    return [(padded[i : i + Q], i) for i in range(cut * CUT, len(word) - rest + 1)]


def first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = first_difference(a, b)
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in_list(listed: list[str], cut: int, longest: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in the list whose words are one edit apart, one of them ``longest`` characters long."""
    index: defaultdict[tuple[str, int], list[int]] = defaultdict(list)
    # Of the longer word's grams around the difference, one edit destroys Q.
    needed = min(CUT, longest - cut * CUT) + 1 - Q
    for k, word in enumerate(listed):
        grams = _grams(word, cut, longest)
        # Earlier words with a gram at this place or beside it; postings are in order, so a heap merges them.
        met = groupby(heapq.merge(*[index[g, i + d] for g, i in grams for d in (-1, 0, 1) if (g, i + d) in index]))
        for other in (o for o, same in met if sum(1 for _ in same) >= needed) if needed > 0 else range(k):
            if max(len(word), len(listed[other])) == longest and one_edit(word, listed[other]):
                yield other, k
        for gram in grams:
            index[gram].append(k)


def links(found: DataFrame) -> DataFrame:
    """word, near, near_n for each word (word, n) and each of its near words; every link is there in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the last key, which the next batch may go on with

        def done(rows: list[tuple], out: list[tuple]) -> None:
            for (key, cut, longest), same in groupby(rows, key=lambda r: r[:3]):
                same = list(same)
                if len(same) > 1:
                    for a, b in near_in_list([r[3] for r in same], cut, longest):
                        (x, m), (y, n) = same[a][3:], same[b][3:]
                        if first_difference(x, y) // CUT == cut:
                            out += [(x, y, n), (y, x, m)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate((("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())))})

        for batch in batches:
            out: list[tuple] = []
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns)))
            last = next((i for i in range(len(rows) - 1, 0, -1) if rows[i - 1][0] != rows[-1][0]), 0)
            held = rows[last:]
            done(rows[:last], out)
            yield batch_of(out)
        out = []
        done(held, out)
        yield batch_of(out)

    # The words of a list are what three characters can spell, so a key is one task's work; words that are alone stay behind.
    listed = Window.partitionBy("key", "cut", "longest")
    shared = postings(found).withColumn("many", F.count(F.lit(1)).over(listed)).filter("many > 1").drop("many")
    return shared.sortWithinPartitions("key", "cut", "longest").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word (word, form) along the forms to the last.

    Counts grow along a chain by a factor at least, so it is as long as the digits of the largest count; each round follows twice as far.
    """
    reached = settle(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = settle(reached.join(on.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return reached


def variants(found: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n)."""
    # The least word of the largest count: numbers of opposite sign come first.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    summed = links(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = found.join(summed.hint("shuffle_merge"), "word", "left")
    fits = -F.col("best.minus") >= times * F.col("n")
    known = checkpoint(known.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    out = known.join(roots(known).hint("shuffle_merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    return variants(checkpoint(words(docs)))


#: Independent of the index: words that are equal once each has lost a character at one place, or one of them has.
ORACLE = f"""
with recursive table_(i, v, step) as (
  select i, i, 0 from range(256) t(i)
  union all
  select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, step + 1 from table_ where step < 8),
crc_table as (select list(v order by i) as c from table_ where step = 8),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents),
counted as (select id, run, count(*) as n, encode(id || ':' || run) as data from runs where length(run) >= {LEAST_LENGTH} group by id, run),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(data) + 1), lambda i: ('0x' || substr(hex(data), 2 * i - 1, 2))::bigint)), lambda h, x: xor(h // 256, c[xor(h % 256, x) + 1]))) as h
  from counted, crc_table),
words as (
  select case when h % {DAMAGED} = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, sum(n)::bigint as n
  from hashed group by 1 having length(word) >= {LEAST_LENGTH} and sum(n) >= {LEAST_COUNT}),
cuts as (select word, n, unnest(range(1, length(word) + 1)) as pos from words),
less as (select word, n, pos, word[:pos - 1] || word[pos + 1:] as rest from cuts),
near as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.pos = b.pos and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(near_n) as most from near group by word),
forms as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when most >= {TIMES} * words.n then most end as form_n,
    case when most >= {TIMES} * words.n then (select min(near) from near where near.word = words.word and near.near_n = best.most) end as form
  from words left join best using (word)),
followed(word, reached, step) as (
  select word, word, 0 from forms
  union all select f.word, g.form, step + 1 from followed f join forms g on f.reached = g.word where g.form is not null),
ends as (select word, arg_max(reached, step) as root from followed group by word)
select word, form, root, n, n_near::bigint as n_near, form_n from forms join ends using (word)
"""
