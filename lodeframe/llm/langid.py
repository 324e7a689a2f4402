"""Language identification by words first, backing off to shorter and shorter n-grams.

A known word scores by the log frequency that it has in each language. A word not known
is read left to right: at each letter the longest known character n-gram (five letters
down to one, with marks for the ends of the word) that starts there scores instead. The
scores of all words of a text add up, and the best language's share of the summed
probabilities is the score.

The model is fitted on a bounded sample of labelled rows: about ``sample`` for each
language, drawn by a hash of the id, whole texts. All words and n-grams that a language has at least twice are kept.

Null text and text without a letter: ``und``, score 0; the same if nothing was learned.
Ties between languages go to the first by name. Null ids are neither learned from nor held
out. Repeated rows get equal results, extra columns are not looked at, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 3000
#: Numbers that a worker remembers besides those learned, as scores of words.
MOST_KEPT = 1_200_000
#: n-grams weigh less than words, as those of one word overlap.
GRAM, GRAM_WEIGHT = 5, 0.3

LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of a text that are looked at together; cuts are made between words.
SLAB = 1 << 20


def slabs(text: str) -> Iterator[str]:
    """The text in runs of about SLAB characters; no word is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLAB)
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end


def words_of(text: str) -> Counter:
    found: Counter = Counter()
    for slab in slabs(text):
        found.update(LETTERS.findall(slab.lower()))
    return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words (kind 0) and n-grams (kind 1) of each batch with their counts, by language."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter = Counter()
            for t in texts:
                words.update(words_of(t))
            grams: Counter = Counter()
            for w, n in words.items():
                marked = f"<{w}>"
                for size in range(1, GRAM + 1):
                    for i in range(len(marked) - size + 1):
                        grams[marked[i : i + size]] += n
            for kind, found in ((0, words), (1, grams)):
                if found:
                    yield pd.DataFrame({"lang": lang, "kind": kind, "unit": list(found), "n": list(found.values())})


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from the columns id, text and lang."""
    rows = labelled.filter("text is not null and lang is not null and id is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in counts]
    model = {"langs": langs, "words": [], "grams": [], "word_scores": np.zeros((0, len(langs)), np.float32), "gram_scores": np.zeros((0, len(langs)), np.float32)}
    if not langs:
        return model
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])[F.col("lang")]
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) < part * (1 << 30))
    units = drawn.select("lang", "text").mapInPandas(_count, "lang string, kind int, unit string, n long").groupBy("kind", "lang", "unit").agg(F.sum("n").alias("n")).filter("n > 1")
    # One count for both kinds; it is as large as the vocabulary of the bounded sample.
    seen = units.orderBy("kind", "unit", "lang").toArrow().to_pandas(categories=["lang"])
    place = {x: i for i, x in enumerate(langs)}
    for kind, name in ((0, "word"), (1, "gram")):
        own = seen[seen["kind"] == kind]
        known, row = np.unique(own["unit"].to_numpy(str), return_inverse=True) if len(own) else (np.zeros(0, str), np.zeros(0, int))
        table = np.zeros((len(known), len(langs)))
        table[row, [place[x] for x in own["lang"]]] = own["n"]
        total = table.sum(axis=0) + 0.5 * max(1, len(known))
        model[f"{name}s"], model[f"{name}_scores"] = known.tolist(), np.log((table + 0.5) / total).astype(np.float32)
    return model


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.model = model["langs"], model
        self.grams = {g: i for i, g in enumerate(model["grams"])}
        self.gram_scores = model["gram_scores"].astype(float)
        self.unknown = np.full(len(self.langs), math.log(1e-6))
        self.forget()

    def forget(self) -> None:
        self.rows = {w: i for i, w in enumerate(self.model["words"])}
        self.scores = np.zeros((len(self.rows) + max(1, MOST_KEPT // max(1, len(self.langs))), len(self.langs)))
        self.scores[: len(self.rows)] = self.model["word_scores"]

    def backed_off(self, word: str) -> np.ndarray:
        marked, total = f"<{word}>", np.zeros(len(self.langs))
        for i in range(len(marked) - 1):
            for size in range(GRAM, 0, -1):
                found = self.grams.get(marked[i : i + size])
                if found is not None:
                    total += self.gram_scores[found]
                    break
            else:
                total += self.unknown
        return total * GRAM_WEIGHT

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        words = words_of(text)
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        rows, counts = [], []
        for w, n in words.items():
            row = self.rows.get(w)
            if row is None:
                if len(self.rows) >= len(self.scores):
                    total += np.array(counts, float) @ self.scores[rows] if rows else 0
                    rows, counts = [], []
                    self.forget()
                row = len(self.rows)
                self.scores[row] = self.backed_off(w)
                self.rows[w] = row
            rows.append(row)
            counts.append(n)
        if rows:
            total += np.array(counts, float) @ self.scores[rows]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the text is all that a prediction looks at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            found = [scorer.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": pd.Series([x for x, _ in found], dtype=object), "score": pd.Series([x for _, x in found], dtype=float)})

    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train_and_identify(docs: DataFrame, **bounds) -> DataFrame:
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("id")))
    return identify(docs, train(labelled, **bounds))
