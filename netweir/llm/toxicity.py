"""Toxicity by a classifier chain: linear models in order, each fed the probabilities of those before it.

Null and empty texts have no features and get the chain's bare probabilities. A label row with a null id or null category is not trained on.
Rows that repeat an id are judged one by one; where a labelled id repeats, each of its rows may train. Other columns are ignored. With no usable
labelled rows, or one class only, a category predicts its share of positives (0 without rows). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t

PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Link:
    """One model of the chain: features (sorted fingerprints) with weights, weights of earlier log odds, bias."""

    category: str
    features: np.ndarray
    weights: np.ndarray
    before: np.ndarray
    bias: float


def features(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """32-bit fingerprints of each lower-cased word and of its leading 4 to 8 bytes, as parallel arrays; and the rows' first words."""
    low = t.LOWER[buf]
    starts, ends, first = t.spans(low, off, t.ALNUM_WORD)
    sums = t.prefix(low)
    out = [t.span_hash(sums, starts, ends), *(t.span_hash(sums, starts, np.minimum(starts + n, ends)) ^ t.U64(n) for n in PREFIXES)]
    return [x.astype(np.uint32) for x in out], first


def _distinct(batches):
    for batch in t.blocks(batches, "text"):
        parts, first = features(*t.utf8(batch.column("text")))
        row = t.row_of(first)
        lists = [np.unique(np.concatenate([p[a:b] for p in parts])) for a, b in zip(first[:-1], first[1:])] if len(row) else [np.zeros(0, np.uint32)] * batch.num_rows
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x.tobytes() for x in lists], pa.binary())], names=[*keep, "features"])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _columns(vocabulary: np.ndarray, chosen: np.ndarray, at: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    slot = np.full(len(vocabulary), -1)
    slot[chosen] = np.arange(len(chosen))
    col = slot[at]
    x = np.zeros((rows, len(chosen)))
    x[doc[col >= 0], col[col >= 0]] = 1
    return x


def fit(sample: pa.Table, categories: list[str], folds: int = 3, n_features: int = 400, min_df: int = 5, ridge: float = 1.0) -> list[Link]:
    """Fits the chain. A model's view of earlier categories is out of fold: each document's probability comes from models that never saw it."""
    rows = sample.num_rows
    data, off = t.utf8(sample.column("features"))
    features = data.view(np.uint32)
    # only what stands in min_df texts or more can be chosen
    ordered = np.sort(features)
    runs = np.append(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))), len(ordered)) if rows else np.zeros(1, np.int64)
    vocabulary = ordered[runs[:-1][np.diff(runs) >= min_df]] if len(ordered) else ordered
    del ordered
    at = np.searchsorted(vocabulary, features).astype(np.int32)
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == features if len(vocabulary) else np.zeros(len(features), bool)
    doc, at = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off) // 4)[known], at[known]
    fold = sample.column("fold").to_numpy() % folds
    earlier, chain = np.zeros((rows, 0)), []

    def one(y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features that tell the classes apart best, by chi-square over the rows in use, and the model over them."""
        live = use[doc]
        n, pos = int(use.sum()), float(y[use].sum())
        if not 0 < pos < n:
            bias = _log_odds(np.array([pos / n if n else 0.0]))
            return np.zeros(0, np.int64), np.concatenate((np.zeros(earlier.shape[1]), bias))
        df = np.bincount(at[live], minlength=len(vocabulary))
        hit = np.bincount(at[live], weights=y[doc[live]], minlength=len(vocabulary))
        expect = df * pos / n
        score = np.where((df >= min_df) & (df < n), (hit - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - df / n), 1e-9), 0)
        chosen = np.sort(np.lexsort((vocabulary, -score))[:n_features])
        chosen = chosen[score[chosen] > 0]
        x = np.hstack((_columns(vocabulary, chosen, at, doc, rows), earlier, np.ones((rows, 1))))
        return chosen, _logistic(x[use], y[use], ridge)

    for category in categories:
        y = sample.column(category).to_numpy().astype(float)
        outside = np.zeros(rows)
        for f in range(folds):
            chosen, w = one(y, fold != f)
            held = fold == f
            x = np.hstack((_columns(vocabulary, chosen, at, doc, rows), earlier, np.ones((rows, 1))))
            outside[held] = 1 / (1 + np.exp(-np.clip(x[held] @ w, -30, 30)))
        chosen, w = one(y, np.ones(rows, bool))
        k = len(chosen)
        chain.append(Link(category, vocabulary[chosen], w[:k], w[k:-1], float(w[-1])))
        earlier = np.hstack((earlier, _log_odds(outside)[:, None]))
    return chain


def probabilities(chain: list[Link], column: pa.Array) -> list[np.ndarray]:
    """Of each text, category by category."""
    parts, first = features(*t.utf8(column))
    row, rows = t.row_of(first), len(column)
    earlier, out = np.zeros((rows, 0)), []
    for link in chain:
        seen = np.zeros((rows, len(link.features) + 1), bool)
        if len(link.features):
            for p in parts:
                slot = np.minimum(np.searchsorted(link.features, p), len(link.features) - 1)
                hit = link.features[slot] == p
                seen[row[hit], slot[hit]] = True
        p = 1 / (1 + np.exp(-np.clip(seen[:, :-1] @ link.weights + earlier @ link.before + link.bias, -30, 30)))
        out.append(p)
        earlier = np.hstack((earlier, _log_odds(p)[:, None]))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> list[Link]:
    """Fits on a bounded sample: at most ``sample`` labelled rows, those of the smallest id hashes, with their whole texts."""
    usable = labels.select(F.col(id_col).cast("long").alias("label_id"), *(F.col(c).cast("int").alias(c) for c in categories)).dropna()
    usable = usable.withColumn("h", F.xxhash64("label_id")).orderBy("h", *categories).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = texts.join(F.broadcast(usable), F.col("id") == F.col("label_id"))  # at most ``sample`` rows of a few numbers
    named = named.select("id", F.pmod("h", F.lit(1 << 20)).alias("fold"), *categories, "text").limit(2 * sample)
    kinds = ", ".join(f"{c} int" for c in categories)
    table = named.mapInArrow(_distinct, f"id long, fold long, {kinds}, features binary").toArrow()
    return fit(table.sort_by([("id", "ascending"), *((c, "ascending") for c in categories)]), categories)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, sample: int = 4000) -> DataFrame:
    """One row per document: a probability per category, and whether the last category reaches ``cut``.

    ``categories`` are 0/1 columns of ``labels`` in chain order, the decisive one last. Scoring is one pass over the texts without a shuffle.
    """
    chain = train(docs, labels, categories, id_col, text_col, sample)

    def run(batches):
        for batch in t.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, probabilities(chain, batch.column("text")))], names=["id", *(f"p_{c}" for c in categories)])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(run, "id long, " + ", ".join(f"p_{c} double" for c in categories))
    return out.select(F.col("id").alias(id_col), *(f"p_{c}" for c in categories), (F.col(f"p_{categories[-1]}") >= cut).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, sample: int = 4000) -> DataFrame:
    """The documents that ``toxicity`` does not reject, all columns as they are, without a shuffle."""
    chain = train(docs, labels, categories, id_col, text_col, sample)

    def run(batches):
        for batch in t.blocks(batches, text_col):
            yield batch.filter(pa.array(probabilities(chain, batch.column(text_col))[-1] < cut))

    return docs.mapInArrow(run, docs.schema)
