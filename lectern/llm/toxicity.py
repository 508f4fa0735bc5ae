"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters. Each feature is scaled by its
log-count ratio between the classes, and a logistic regression on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.store import cut

#: Lengths of the n-grams, and bits of a feature's number.
ORDERS = (3, 4, 5)
BITS = 20
#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 8_000
#: Features that the regression sees, a parameter of the model as its orders are: those with the strongest class contrast,
#: so that long texts gather no noise. All n-grams of all fitted rows are counted to choose them.
FEATURES = 1_024
SMOOTH = 1.0
THRESHOLD = 0.3
_STEP = 1 << 20  # characters that are hashed at once; n-grams across steps are kept by an overlap
_MUL, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _ngrams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, in pieces, with repeats."""
    text = text.lower()
    for at in range(0, max(len(text), 1), _STEP):
        piece = text[max(0, at - max(ORDERS) + 1) if at else 0 : at + _STEP]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = codes + np.uint64(1)
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * _MUL + (codes[n - 1 :] + np.uint64(1))
            if n in ORDERS:
                yield ((h ^ (h >> np.uint64(29))) * _END) >> np.uint64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text, ascending; none for null or very short texts."""
    parts = [np.unique(x) for x in _ngrams(text or "")]
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    """Chosen features, ascending, with their weights (log-count ratio times regression weight), and the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def finder(self):
        """Function from a text to the chosen features that it has, ascending."""
        mark = np.zeros(1 << BITS, np.bool_)
        mark[self.chosen] = True

        def find(text: str | None) -> np.ndarray:
            hits = [x[mark[x]] for x in _ngrams(text or "")]
            return np.unique(np.concatenate(hits)).astype(np.int64) if hits else np.empty(0, np.int64)

        return find

    def scorer(self):
        find = self.finder()

        def score(text: str | None) -> float:
            z = self.bias + float(self.weights[np.searchsorted(self.chosen, find(text))].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _regress(rows: list[np.ndarray], labels: np.ndarray, width: int, ratios: np.ndarray, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled binary features by accelerated gradient steps; rows hold column numbers."""
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if lengths.sum() else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(rows)), lengths)
    values = ratios[cols]
    w, bias = np.zeros(width), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    norm = np.bincount(at, values**2, minlength=len(rows)).max(initial=1.0)
    step = 1 / (0.25 * (norm + 1) * len(rows) / 40 + l2)
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, values * v[cols], minlength=len(rows)) + vb, -30, 30)))
        g = p - labels
        w2 = v - step * (np.bincount(cols, values * g[at], minlength=width) + l2 * v)
        b2 = vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return w, bias


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, width: int = FEATURES) -> Model:
    """Model fitted on at most `fit_rows` labelled rows that are not held out.

    Null labels don't count, nor do labels of ids without a document; an id with several labels is toxic if one says
    so, and one with several texts gives the least of them. Class counts of the n-grams are summed by Spark; the driver
    gets `width` features and the columns of `fit_rows` rows at most. Without labels, or with one class only, the model
    has no features and scores every text by the smoothed share of toxic rows.
    """
    chosen = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .join(docs.select(F.col(id_col).alias("i")), "i", "left_semi")
        .filter(F.col("y").isin(0, 1) & F.col("i").isNotNull())
        .withColumn("out", held_out("i"))
        .filter("not out")
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(fit_rows)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = features(text)
                all_[found] += 1
                toxic[found] += y
        f = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(toxic[f]), pa.array(all_[f])], ["f", "pos", "n"])

    # at most fit_rows ids and labels: a bounded side
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    rows = cut(texts.groupBy("i", "y").agg(F.min("t").alias("t")).select("y", "t"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = (toxic + SMOOTH) / (total + 2 * SMOOTH) if total else 0.0
    if not toxic or toxic == total:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(base / (1 - base))) if 0 < base < 1 else -30.0)
    share = toxic / total
    counts = rows.mapInArrow(count, "f int, pos int, n int").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    expected = F.col("n") * share
    spread = F.sqrt(F.greatest(expected * (1 - share) * (1 - F.col("n") / total), F.lit(1.0)))
    best = counts.orderBy(F.abs((F.col("pos") - expected) / spread).desc(), "f").limit(width).toPandas().sort_values("f")
    ids, pos, n = best["f"].to_numpy(np.int64), best["pos"].to_numpy(float), best["n"].to_numpy(float)
    ratios = np.log((pos + SMOOTH) / (toxic + 2 * SMOOTH)) - np.log((n - pos + SMOOTH) / (total - toxic + 2 * SMOOTH))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Model(ids, ratios, 0.0).finder()
        for batch in batches:
            found = [np.searchsorted(ids, find(t)).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "c"])

    fit = rows.mapInArrow(pick, "y int, c binary").toPandas()
    matrix = [np.frombuffer(c, np.int32).astype(np.int64) for c in fit["c"]]
    order = sorted(range(len(matrix)), key=lambda k: (fit["y"][k], matrix[k].tobytes()))  # sums must not depend on the order of rows
    w, bias = _regress([matrix[k] for k in order], fit["y"].to_numpy(float)[order], len(ids), ratios)
    return Model(ids, w * ratios, bias)


def score(model: Model, text: F.Column) -> F.Column:
    """Score of each whole text, 0 to 1; null counts as an empty text."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = train(docs, labels, id_col, text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(model, F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are scored below the threshold, with all their columns."""
    return docs.filter(score(train(docs, labels), F.col("text")) < threshold)
