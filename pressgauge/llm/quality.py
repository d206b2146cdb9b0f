"""Operator 3: text quality by Bradley-Terry ranking.

Each text becomes a vector: how often its bytes, classes of neighbouring bytes and word shapes occur,
and how much it repeats words and lines. The model is one weight vector; the chance that text a is
better than text b is the logistic function of the difference of their ranks, weights times vector.
Weights are learnt from preference pairs, one text of label 1 and one of label 0, by logistic loss on
the differences of their vectors.

The cut is a quantile of the ranks of the labelled texts: the share of label 0 among them. A score is
the rank put through a logistic curve that has the value KEEP at the cut, so ``score >= KEEP`` keeps
what lies above the quantile. Whole texts are read; no other column is an input.

Null and empty texts have the zero vector and a score like any other. Labels are joined on the id;
of several for an id the lower counts, null labels and ids are ignored. Where labels don't show both
values, nothing can be preferred, and every text scores KEEP. Repeated rows are scored each; columns
named like the output are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import giving_back, prepared, text_buffers

#: A score of this or more keeps a text.
KEEP = 0.7
#: Labelled texts that are learnt from, about; twice as many at most. Those with a small hash of the id.
TEXTS = 6000
PAIRS, STEPS, RATE = 2048, 300, 0.05

#: Class of each byte: control, line end, space, digits, lower, upper, other letters, then each sign.
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASS = np.zeros(256, np.uint8)
CLASS[[10, 13]], CLASS[[9, 11, 12, 32]] = 1, 2
CLASS[48:58], CLASS[97:123], CLASS[65:91], CLASS[128:] = 3, 4, 5, 6
CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
CLASSES = 7 + len(_SIGNS)
#: Pairs of neighbours are told apart by a coarser class: all signs are one.
COARSE = np.minimum(CLASS, 7)
WIDTH = CLASSES + 64 + 8 + 4


def features(data: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    n = len(data)
    if not n:
        return out
    coarse = COARSE[data]
    out[:CLASSES] = np.sqrt(np.bincount(CLASS[data], minlength=CLASSES) / n)
    pairs = np.bincount(coarse[:-1].astype(np.int64) * 8 + coarse[1:], minlength=64)
    out[CLASSES : CLASSES + 64] = np.sqrt(pairs / n)
    raw = data.tobytes()
    words, lines = raw.split(), raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[CLASSES + 64 : CLASSES + 72] = np.bincount(np.minimum(sizes // 4, 7), minlength=8) / max(1, len(words))
    distinct = len(set(words)) / max(1, len(words))
    again = np.count_nonzero(np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), bool, max(0, len(words) - 1)))
    out[-4:] = distinct, len(set(lines)) / len(lines), again / max(1, len(words)), min(1.0, n / len(lines) / 1000)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    offsets, data = text_buffers(column)
    return np.stack([features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]) if len(column) else np.zeros((0, WIDTH), np.float32)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> dict:
    """Weights by Adam on pairs drawn anew each step, then the cut and slope of the score."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return {"weights": np.zeros(x.shape[1]), "cut": 0.0, "slope": 1.0}
    draw = np.random.default_rng(seed)
    scale = x.std(axis=0) + 0.01
    weights, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, STEPS + 1):
        gap = (good[draw.integers(0, len(good), PAIRS)] - bad[draw.integers(0, len(bad), PAIRS)]) / scale
        doubt = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
        slope = -(gap * doubt[:, None]).mean(axis=0) + 1e-4 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        rate = RATE * (1 - step / (STEPS + 1))
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights /= scale
    rank = np.sort(x @ weights)
    below = len(bad)  # so many of the labelled texts lie under the cut
    cut = (rank[below - 1] + rank[below]) / 2
    return {"weights": weights, "cut": float(cut), "slope": 1.0}


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Learn from the texts of ``df`` that ``labels`` (doc_id, label) has: TEXTS of them, about."""
    spark = prepared(df.sparkSession)
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    part = int((1 << 30) * min(1.0, TEXTS / max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TEXTS).collect()
    sent = F.broadcast(spark.createDataFrame(chosen, "__known bigint, label int"))  # 2 * TEXTS rows at most

    @F.arrow_udf("binary")
    @giving_back
    def vector(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([row.tobytes() for row in _matrix(column)], pa.binary())

    rows = (
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(sent, F.col("doc_id") == F.col("__known")).dropDuplicates(["doc_id", "text"])
        .select("doc_id", vector("text").alias("x"), "label").collect()  # the vectors of these
    )
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return fit(x, np.array([r.label for r in rows], np.int64))


def scored(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1, double) of ``text``."""
    prepared(df.sparkSession)
    weights, cut, slope = model["weights"], model["cut"], model["slope"]

    @F.arrow_udf("double")
    @giving_back
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        base = np.log(KEEP / (1 - KEEP))
        for column in columns:
            rank = slope * (_matrix(column) @ weights - cut)
            value = 1 / (1 + np.exp(-np.clip(rank + base, -500, 500)))
            yield pa.array(np.where(rank >= 0, np.maximum(value, KEEP), np.minimum(value, np.nextafter(KEEP, 0))))

    return df.withColumn(out, score(F.col(text)))
