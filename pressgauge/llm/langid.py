"""Operator 7: language of a text by a convolutional network over its bytes.

A text is cut into windows of WINDOW bytes that follow each other to its end (the last one is padded
with zero bytes). In each window, filters of several widths run over embedded bytes; the largest
value of each filter goes through a softmax layer. The text's probabilities are the mean over its
windows, weighted by their bytes.

Training is plain numpy on the driver, on windows of a bounded number of texts for each language.
For use the filters become tables over bytes and byte pairs, so that a window costs a few look-ups.

A null text, and one without a letter, is ``und`` with score 0. Rows with a null language aren't
learnt from. If nothing can be learnt every text is ``und``. Repeated rows are predicted each; extra
columns are kept, those named like the outputs replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import giving_back, prepared, spans, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 12
#: Texts for each language, and windows of each, that are learnt from at most.
TEXTS, WINDOWS = 400, 4
STEPS, BATCH, RATE = 240, 64, 0.01
UNKNOWN = "und"


def windows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each window of each text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[text] + spans(np.zeros(len(sizes), np.int64), counts) * WINDOW
    return start, np.minimum(WINDOW, offsets[text + 1] - start), text


def padded(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), WINDOW), np.uint8)
    out[np.arange(WINDOW) < length[:, None]] = data[spans(start, length)]
    return out


class Network:
    """Weights: embedding of bytes, filters by width, output layer."""

    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed).normal
        self.weights = {"embed": draw(0, 1, (256, EMBED))}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = draw(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
            self.weights[f"bias{w}"] = np.zeros(FILTERS)
        self.weights["out"] = draw(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.weights["shift"] = np.zeros(classes)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; only a filter's best place in a window has a share in it."""
        p, rows = self.weights, np.arange(len(x))[:, None]
        embedded = p["embed"][x]
        pooled, best = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            value = sum(embedded[:, k : k + n] @ p[f"filter{w}"][k] for k in range(w))
            place = value.argmax(axis=1)
            best.append(place)
            pooled.append(np.take_along_axis(value, place[:, None], 1)[:, 0] + p[f"bias{w}"])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        logits = active @ p["out"] + p["shift"]
        logits -= logits.max(axis=1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=1, keepdims=True)
        share[np.arange(len(y)), y] -= 1
        share /= len(y)
        grad = {"out": active.T @ share, "shift": share.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (share @ p["out"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"bias{w}"] = d.sum(axis=0)
            grad[f"filter{w}"] = np.empty_like(p[f"filter{w}"])
            for k in range(w):
                seen = x[rows, best[i] + k]  # texts x filters
                grad[f"filter{w}"][k] = np.einsum("tfe,tf->ef", p["embed"][seen], d)
                np.add.at(grad["embed"], seen, d[:, :, None] * p[f"filter{w}"][k].T)
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        """Adam on mini-batches with as many windows of each language."""
        draw = np.random.default_rng(seed)
        of = [np.flatnonzero(y == c) for c in np.unique(y)]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            pick = np.concatenate([draw.choice(c, max(1, BATCH // len(of))) for c in of])
            rate = RATE * (1 - step / (STEPS + 1))
            for k, g in self.gradients(x[pick], y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict:
        """For each width: the filters' values for its byte pairs, then for a single byte left over."""
        p, out = self.weights, {"out": self.weights["out"], "shift": self.weights["shift"]}
        for w in WIDTHS:
            taps = [p["embed"] @ p[f"filter{w}"][k] for k in range(w)]
            pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            out[w] = pairs + ([taps[w - 1]] if w % 2 else []), p[f"bias{w}"]
        return out


def probabilities(tables: dict, x: np.ndarray) -> np.ndarray:
    """Of each language, for each row of window bytes."""
    pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
    pooled = []
    for w in WIDTHS:
        n = WINDOW - w + 1
        parts, bias = tables[w]
        value = np.take(parts[0], pair[:, :n], axis=0)
        for k, part in enumerate(parts[1:], 1):
            index = pair[:, 2 * k : 2 * k + n] if len(part) == 65536 else x[:, 2 * k : 2 * k + n]
            value += np.take(part, index, axis=0)
        pooled.append(np.maximum(value.max(axis=1) + bias, 0))
    logits = np.concatenate(pooled, axis=1) @ tables["out"] + tables["shift"]
    share = np.exp(logits - logits.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def _samples(df: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their languages' numbers: TEXTS different texts of each, by a hash of the text."""
    known = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        f"lang is not null and lang <> '{UNKNOWN}' and text rlike '\\\\p{{L}}'"
    )
    # A hash leaves about twice TEXTS of each language, so that few rows meet to be ordered.
    different = known.select("lang", F.xxhash64("text").alias("hash")).distinct()
    counts = different.groupBy("lang").count().collect()  # a row for each language
    parts = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, int((1 << 30) * min(1.0, 2 * TEXTS / r["count"])))))
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = (
        known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(parts, F.col("lang")))
        .distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= TEXTS)
        .select("lang", F.encode("text", "utf-8").alias("data"))
        .withColumn("n", F.ceil(F.length("data") / WINDOW))
        .withColumn("k", F.expr(f"explode(transform(sequence(0L, least({WINDOWS}, n) - 1), i -> (i * n) div least({WINDOWS}, n)))"))
        .select("lang", F.expr(f"substring(data, cast(k * {WINDOW} + 1 as int), {WINDOW})").alias("data"))
        .collect()  # TEXTS * WINDOWS * WINDOW bytes a language at most
    )
    rows.sort(key=lambda r: (r.lang, bytes(r.data)))
    langs = sorted({r.lang for r in rows})
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r.data)] = np.frombuffer(bytes(r.data), np.uint8)
    return langs, x, np.array([langs.index(r.lang) for r in rows], np.int64)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], dict | None]:
    """Languages and look-up tables."""
    langs, x, y = _samples(df, text, lang)
    return langs, Network(len(langs)).fit(x, y).tables() if langs else None


def predict(df: DataFrame, model: tuple[list[str], dict | None], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (string) and ``score`` (double)."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(model)  # a fixed size

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @giving_back
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, tables = shared.value
        for column in columns:
            offsets, data = text_buffers(column)
            start, length, of = windows(offsets, data)
            sums = np.zeros((len(column), max(1, len(langs))))
            for at in range(0, len(start) if langs else 0, 256):
                part = slice(at, at + 256)
                share = probabilities(tables, padded(data, start[part], length[part]))
                np.add.at(sums, of[part], share * length[part, None])
            sums /= np.maximum(np.diff(offsets), 1)[:, None]
            best = sums.argmax(axis=1)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([langs[i] if langs else UNKNOWN for i in best], pa.string()),
                    pa.array(np.clip(sums[np.arange(len(best)), best], 0, 1)),
                ],
                ["lang_pred", "score"],
            )

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    got = df.withColumn("__predicted", predicted(F.col(text)))
    return got.withColumns(
        {
            "lang_pred": F.when(letters, F.col("__predicted.lang_pred")).otherwise(UNKNOWN),
            "score": F.when(letters, F.col("__predicted.score")).otherwise(0.0),
        }
    ).drop("__predicted")
