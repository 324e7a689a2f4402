"""Toxicity by a chain of linear classifiers.

Each category has a logistic model over the words of a text and their first letters
(four to six), present or not. The categories are predicted in order, and the model of a
category also sees the probabilities of all categories before it. When it is trained,
those are out-of-fold: each row's come from models that have not seen the row.

The models are fitted on a bounded sample of labelled rows: at most about ``sample``,
drawn by a hash of the id, whole texts. The features are hashed, and those that tell a
category apart (chi-square of ``SIGNIFICANT`` or more) are kept; a longer tail of common words would
outweigh the few that matter. A model that predicts a fold has features that were chosen without it. All rows are scored,
whole texts. A category is found from the probability on that has the best F0.5 over the
out-of-fold predictions, as to drop a clean document costs more than to keep a toxic one.

Null and empty texts have no features: their probability is the models' prior one, and they
are never found. If no row is labelled, or all labels of a category are alike, the
category's probability is 0 or 1 throughout, and no text is found. Repeated labels of an id count once, as the greatest. Repeated rows get equal results,
extra columns are kept by the filter, and an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import checkpoint
from lodeframe.llm.langid import LETTERS, slabs

SAMPLE, BITS, FOLDS = 12_000, 20, 3
#: Words whose features a worker remembers.
MOST_KEPT = 300_000
#: Rounds of the fit, weight of the penalty.
ROUNDS, PENALTY = 150, 1.0
#: The least chi-square of a feature that is kept: one in a thousand gets there by chance.
SIGNIFICANT = 10.83
#: Weight of what is missed against what is rejected wrongly, squared, as in F0.5.
MISSED = 0.25


def hashed(word: str) -> tuple[int, ...]:
    """The features of one word: itself, and its first four, five and six letters."""
    data, mask = word.encode("utf-8", "surrogatepass"), (1 << BITS) - 1
    return (zlib.crc32(b"=" + data) & mask, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), 7) & mask for n in (4, 5, 6) if len(word) >= n))


class Features:
    """The features of texts; with ``kept`` (sorted hashes) their places in it, else the hashes."""

    def __init__(self, kept: np.ndarray | None = None):
        self.place = None if kept is None else {int(h): i for i, h in enumerate(kept)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known, place = self.known, self.place
        for slab in slabs(text or ""):
            for w in set(LETTERS.findall(slab.lower())):
                f = known.get(w)
                if f is None:
                    f = hashed(w)
                    if place is not None:
                        f = tuple(place[h] for h in f if h in place)
                    if len(known) >= MOST_KEPT:
                        known.clear()
                    known[w] = f
                if f:
                    out.update(f)
        return out


def _fit(start: np.ndarray, cols: np.ndarray, more: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Weights of a logistic model with a penalty: features, then those of ``more``, then the constant.

    ``cols[start[i]:start[i + 1]]`` are the features that row i has.
    """
    n, m = len(y), more.shape[1]
    w = np.zeros(width + m + 1)
    if y.all() or not y.any():
        w[-1] = 50.0 if y.all() and n else -50.0
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    rows = np.repeat(np.arange(n), np.diff(start))
    # A step of each weight by the curvature it can have at most, times what rows share; momentum with restarts.
    shared = max(1.0, float(np.mean(np.diff(start))) ** 0.5)
    curve = np.concatenate([np.bincount(cols, minlength=width) * y.mean() * (1 - y.mean()) * shared, (more**2).sum(axis=0) * 0.25, [n * 0.25]]) + PENALTY
    ahead, old, t = w.copy(), w.copy(), 1.0
    lowest = np.inf
    for _ in range(ROUNDS):
        z = np.bincount(rows, ahead[cols], minlength=n) + more @ ahead[width:-1] + ahead[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z).sum() - z[y].sum() + 0.5 * PENALTY * (ahead[:-1] ** 2).sum()
        g = np.concatenate([np.bincount(cols, (p - y)[rows], minlength=width), more.T @ (p - y), [(p - y).sum()]])
        g[:-1] += PENALTY * ahead[:-1]
        if loss > lowest:
            t, curve = 1.0, curve * 1.3
            ahead = old.copy()
            lowest = np.inf
            continue
        lowest = loss
        new = ahead - g / curve
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, old, t = new + (t - 1) / after * (new - old), new, after
    return old


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold_of(row_id: int) -> int:
    return zlib.crc32(str(row_id).encode()) % FOLDS


def _chain(rows: pd.DataFrame, names: list[str], chosen: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Weights and cut of each category, from rows of id, features (places in ``chosen``) and 0 or 1 for each name.

    ``chosen[f, k]`` says whether feature f was chosen without fold k, in the last column whether it was by all rows.
    """
    width = len(chosen)
    rows = rows.assign(f=[np.asarray(f, np.int32) for f in rows["f"]])
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i, ids=rows["id"].to_numpy(), fs=rows["f"].to_numpy(): (ids[i], fs[i].tobytes()))]
    lists = [np.asarray(f, np.int64) for f in rows["f"]]
    fold = np.array([fold_of(i) for i in rows["id"]], int)

    def packed(which: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        own = [lists[i][chosen[lists[i], by]] for i in which]
        return np.concatenate([[0], np.cumsum([len(f) for f in own])]).astype(np.int64), np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)

    def predict(w: np.ndarray, which: np.ndarray, more: np.ndarray, by: int) -> np.ndarray:
        start, cols = packed(which, by)
        return _sigmoid(np.bincount(np.repeat(np.arange(len(which)), np.diff(start)), w[cols], minlength=len(which)) + more @ w[width:-1] + w[-1])

    everything, earlier = np.arange(len(rows)), np.zeros((len(rows), 0))
    weights: list[np.ndarray] = []
    cuts: list[float] = []
    prior: list[float] = []
    for name in names:
        y = rows[name].to_numpy(float) > 0
        weights.append(_fit(*packed(everything, FOLDS), earlier, y, width))
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            seen, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(rest):
                out[rest] = predict(_fit(*packed(seen, k), earlier[seen], y[seen], width), rest, earlier[rest], k)
        # A text of which the models know nothing stays below the cut.
        prior.append(float(_sigmoid(np.dot(weights[-1][width:-1], prior) + weights[-1][-1])))
        order = np.argsort(-out, kind="stable")
        hits = np.cumsum(y[order])
        measure = hits / (MISSED * max(1, y.sum()) + np.arange(1, len(y) + 1))
        cut = out[order][int(measure.argmax())] if y.any() else 0.5
        cuts.append(float(max(cut, prior[-1] + 1e-6)))
        earlier = np.column_stack([earlier, out])
    return weights, cuts


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> dict:
    """A chain for the ``categories``, columns of ``labels`` that hold 0 or 1; both tables have doc_id."""
    names = [f"y{i}" for i in range(len(categories))]
    marked = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), *[F.col(c).cast("int").alias(y) for c, y in zip(categories, names)]).dropna()
    n = marked.count()
    marked = marked.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))).groupBy("id").agg(*[F.max(y).alias(y) for y in names])
    # The drawn labels are at most about ``sample`` rows, so they are sent to the documents.
    rows = checkpoint(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(marked), "id"))

    folds = range(FOLDS)
    sums = [f"{x}_{k}" for k in folds for x in ("n", *names)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, wide = Features(), len(names) + 1
        table = np.zeros((1 << BITS, len(sums)), np.int32)
        for batch in batches:
            for row, text, *y in batch[["id", "text", *names]].itertuples(index=False):
                at = fold_of(row) * wide
                table[list(features.of(text)), at : at + wide] += np.array([1, *y], np.int32)
        (seen,) = np.nonzero(table.any(axis=1))
        yield pd.DataFrame({"h": seen} | {x: table[seen, i] for i, x in enumerate(sums)})

    # Counts of each fold apart: what is chosen for a fold's predictions must not have seen it.
    found = rows.mapInPandas(count, "h int" + "".join(f", {x} int" for x in sums)).groupBy("h").agg(*[F.sum(x).alias(x) for x in sums])
    sizes = rows.select((F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).alias("fold"), *names).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in names]).collect()
    size = {(x, r["fold"]): r[x] for r in sizes for x in ("n", *names)}
    picks = []
    for without in [*folds, None]:
        used = [k for k in folds if k != without]
        n, gains = sum((F.col(f"n_{k}") for k in used), F.lit(0)), []
        for y in names:
            share = sum(size.get((y, k), 0) for k in used) / max(1, sum(size.get(("n", k), 0) for k in used))
            gains.append((sum((F.col(f"{y}_{k}") for k in used), F.lit(0)) - n * share) ** 2 / F.greatest(n * share * (1 - share), F.lit(1e-9)))
        picks.append((n > 2) & (F.array_max(F.array(*gains)) >= SIGNIFICANT))
    # Hashes are 1 << BITS at most, so what comes to the driver is bounded.
    best = found.select("h", *[p.cast("boolean").alias(f"p{i}") for i, p in enumerate(picks)]).filter(" or ".join(f"p{i}" for i in range(FOLDS + 1))).orderBy("h").toArrow()
    kept = best["h"].to_numpy().astype(np.int64)
    chosen = np.column_stack([best[f"p{i}"].to_numpy().astype(bool) for i in range(FOLDS + 1)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(kept)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "f": [sorted(features.of(t)) for t in batch["text"]]} | {y: batch[y] for y in names})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if any(len(x) for x in own):
            yield pd.DataFrame({"chain": [pickle.dumps(_chain(pd.concat(own, ignore_index=True), names, chosen))]})

    # One task fits the chain: what it reads is the bounded sample, and a lost executor costs a retry, not the job.
    got = rows.mapInPandas(place, "id long, f array<int>" + "".join(f", {y} int" for y in names)).repartition(1).mapInPandas(fit, "chain binary").first()
    weights, cuts = pickle.loads(got["chain"]) if got else _chain(pd.DataFrame({x: [] for x in ("id", "f", *names)}), names, chosen)
    return {"categories": categories, "kept": kept, "weights": weights, "cuts": cuts}


def probabilities(text: Column, model: dict, spark) -> Column:
    """An array with the probability of each category."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = sent.value
        features, width = Features(chain["kept"]), len(chain["kept"])
        for texts in batches:
            out = []
            for text in texts:
                f = list(features.of(text))
                p: list[float] = []
                for w in chain["weights"]:
                    z = w[f].sum() + sum(a * b for a, b in zip(w[width:-1], p)) + w[-1]
                    p.append(float(_sigmoid(z)))
                out.append(p)
            yield pd.Series(out)

    return score(text.cast("string"))


def prepared(labels: DataFrame) -> DataFrame:
    """The categories that the table of labels gives: low quality, and toxic."""
    return labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (the verdict) of every row."""
    model = train(docs, prepared(labels), CATEGORIES, **bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), probabilities(F.col("text"), model, docs.sparkSession).alias("p"))
    return rows.select("doc_id", *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)], (F.col("p")[1] >= model["cuts"][1]).alias("toxic"))


def remove_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the chain does not find toxic."""
    model = train(docs, prepared(labels), CATEGORIES, **bounds)
    return docs.filter(probabilities(F.col("text"), model, docs.sparkSession)[1] < model["cuts"][1])
