"""Operator 1: language-model scores from a subword lattice.

A word's segmentations into pieces of an existing vocabulary form a lattice. Pieces that begin a word
and pieces within one have weights of their own, normalised apart; a stop ends the word. The word's
lattice probability is the sum over all segmentations, by a forward recursion in log space. Weights
start from the vocabulary's own scores and are learnt by expectation over the training tokens. Every
byte has a piece, so every word has a probability.

No piece reaches over a word's end, so a text's probability, summed over all of its segmentations, is
the product of its words' sums. With ``e`` ends among N training tokens and p = (e + 1/2) / (N + 1),

    P(text) = p * product over words of (1 - p) * P_lattice(word)

which sums to at most one over all texts. A text's score is its log10.

With ``whole_words`` a word seen ``c`` times has one more arc, itself, and the lattice, in which each
distinct word counts once, describes those that weren't seen:

    P(word) = max(c - d, 0) / N + d * V / N * P_lattice(word)

with V distinct tokens and the discount d from how many tokens occur once and twice.

How it runs: words are counted in tasks and summed by one shuffle. Lattices are walked once for each
distinct word. The most frequent words, FREQUENT of them at most, go to all tasks; they are most of
a text's words. The other (text, word) pairs join the word table. Words of one length are walked
together, byte by byte; a word over ALONE bytes is walked by itself, arc by arc, with two numbers a byte
and the arcs of a BLOCK of bytes in memory.

Null and empty texts have only their end. Repeated rows are scored each. Rows with a null id are
training rows. Without training rows N is 0: the lattice keeps its first weights, and a word or end
has half the mass. Other columns are dropped.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import UPPER, batches, giving_back, prepared, texts_of, words_of, written

#: Words that are sent to all tasks at most, and the longest of them in characters.
FREQUENT, LONGEST = 150_000, 64
#: Counted words that a task holds before it hands them on, and bytes of text that it reads for them.
HELD, HELD_BYTES = 400_000, 256 << 20
ROUNDS = 2
CHUNK = 4096  # words of one length that are walked together
ALONE, BLOCK = 1024, 1 << 15
MARK = "▁"

def load_pieces(path: str, ranks: bool = True) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """(first, inner): weights of pieces by their bytes, from a vocabulary's scores.

    ``ranks``: the scores are negative merge ranks, as in BPE vocabularies, and a weight is the
    reciprocal of the rank; else they are log probabilities. ``first`` are the pieces that begin a
    word; the empty one is the bare word mark. All single bytes are in ``inner``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first: dict[bytes, float] = {}
    inner: dict[bytes, float] = {}
    lowest = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    floor = 1 / (2 - lowest) if ranks else float(np.exp(lowest))
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or score <= -1e8:
            continue
        weight = 1 / (2 - score) if ranks else float(np.exp(score))
        kind, piece = (first, piece[1:]) if piece.startswith(MARK) else (inner, piece)
        if MARK not in piece and not set(piece) & set(UPPER):
            kind[piece.encode()] = kind.get(piece.encode(), 0) + weight
    for b in range(256):
        inner[bytes([b])] = inner.get(bytes([b]), 0) + floor
    first.setdefault(b"", floor)
    return first, inner


class Lattice:
    """Pieces as a trie in sorted arrays; weights as logarithms by piece number.

    Piece 0 is the bare word mark and the last one the stop. ``first`` pieces come before ``inner``.
    """

    def __init__(self, first: list[bytes], inner: list[bytes]):
        self.first, self.inner = [b"", *(p for p in first if p)], inner
        self.size = len(self.first) + len(inner) + 1
        self.stop = self.size - 1
        self.tries = [self._trie(self.first, 0), self._trie(inner, len(self.first))]

    @staticmethod
    def _trie(pieces: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edge, node it leads to, piece of each node or -1); an edge is 256 * node + byte."""
        edges: dict[int, int] = {}
        piece_of = [-1]
        for number, piece in enumerate(pieces, start):
            node = 0
            for byte in piece:
                edge = node * 256 + byte
                if edge not in edges:
                    edges[edge] = len(piece_of)
                    piece_of.append(-1)
                node = edges[edge]
            if piece:
                piece_of[node] = number
        keys = np.array(sorted(edges), np.int64)
        return keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(piece_of, np.int64)

    def normal(self, weights: np.ndarray) -> np.ndarray:
        """Logarithms, with both kinds of pieces summing to one; the stop is an inner piece."""
        n = len(self.first)
        out = np.log(weights)
        out[:n] -= np.log(weights[:n].sum())
        out[n:] -= np.log(weights[n:].sum())
        return out

    def _arcs(self, words: np.ndarray, trie: tuple, starts: int) -> list[np.ndarray]:
        """For lengths 1, 2, ..: the piece (or -1) that covers so many bytes from each of ``starts``."""
        keys, nodes, piece_of = trie
        rows, n = words.shape
        row = np.repeat(np.arange(rows), starts)
        at = np.tile(np.arange(starts), rows)
        node = np.zeros(len(row), np.int64)
        out = []
        for length in range(1, n + 1):
            inside = at + length <= n
            row, at, node = row[inside], at[inside], node[inside]
            edge = node * 256 + words[row, at + length - 1]
            place = np.minimum(np.searchsorted(keys, edge), len(keys) - 1)
            found = keys[place] == edge
            row, at, node = row[found], at[found], nodes[place[found]]
            if not len(row):
                break
            pieces = np.full((rows, starts), -1, np.int64)
            pieces[row, at] = piece_of[node]
            out.append(pieces)
        return out

    def _forward(self, words: np.ndarray, logs: np.ndarray) -> tuple:
        rows, n = words.shape
        begin = self._arcs(words, self.tries[0], 1)
        inside = self._arcs(words, self.tries[1], n)
        padded = np.append(logs, -np.inf)  # piece -1
        values = [padded[p] for p in inside]
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = logs[0]
        for j in range(1, n + 1):
            into = [alpha[j - k] + values[k - 1][:, j - k] for k in range(1, min(j, len(values)) + 1)]
            if j <= len(begin):
                into.append(padded[begin[j - 1][:, 0]])
            alpha[j] = _log_sum(np.stack(into))
        return begin, inside, values, padded, alpha

    def log_probability(self, words: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Natural logarithms for words of one length (rows of bytes)."""
        if words.shape[1] > ALONE:
            return np.array([self._forward_alone(word, logs)[-1] for word in words]) + logs[self.stop]
        return self._forward(words, logs)[-1][-1] + logs[self.stop]

    def expected(self, words: np.ndarray, logs: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """How often each piece is used in the words, over all segmentations; a word counts ``times`` times."""
        rows, n = words.shape
        times = np.ones(rows) if times is None else times.astype(np.float64)
        if n > ALONE:
            return sum(self._expected_alone(word, logs) * t for word, t in zip(words, times))
        begin, inside, values, padded, alpha = self._forward(words, logs)
        beta = np.full((n + 1, rows), -np.inf)
        beta[n] = 0.0
        for j in range(n - 1, -1, -1):
            beta[j] = _log_sum(np.stack([values[k - 1][:, j] + beta[j + k] for k in range(1, min(n - j, len(values)) + 1)]))
        whole = alpha[n]
        counts = np.zeros(self.size + 1)
        counts[self.stop] = times.sum()
        counts[0] = (np.exp(logs[0] + beta[0] - whole) * times).sum()
        for k, pieces in enumerate(inside, 1):
            share = np.exp(alpha[: n + 1 - k].T + values[k - 1][:, : n + 1 - k] + beta[k:].T - whole[:, None]) * times[:, None]
            counts += np.bincount(pieces[:, : n + 1 - k].ravel() % (self.size + 1), share.ravel(), self.size + 1)
        for k, pieces in enumerate(begin, 1):
            share = np.exp(padded[pieces[:, 0]] + beta[k] - whole) * times
            counts += np.bincount(pieces[:, 0] % (self.size + 1), share, self.size + 1)
        return counts[:-1]

    def _arcs_alone(self, word: np.ndarray, trie: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the arcs of one word that start in lo .. hi - 1, in order of their starts."""
        keys, nodes, piece_of = trie
        at, node, length = np.arange(lo, hi), np.zeros(hi - lo, np.int64), 0
        starts, ends, pieces = [], [], []
        while len(keys) and len(at):
            length += 1
            inside = at + length <= len(word)
            at, node = at[inside], node[inside]
            edge = node * 256 + word[at + length - 1]
            place = np.minimum(np.searchsorted(keys, edge), len(keys) - 1)
            found = keys[place] == edge
            at, node = at[found], nodes[place[found]]
            is_piece = piece_of[node] >= 0
            starts.append(at[is_piece])
            ends.append(at[is_piece] + length)
            pieces.append(piece_of[node[is_piece]])
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order]

    def _forward_alone(self, word: np.ndarray, logs: np.ndarray) -> array:
        n = len(word)
        alpha = array("d", [-math.inf]) * (n + 1)
        alpha[0] = float(logs[0])
        _, ends, pieces = self._arcs_alone(word, self.tries[0], 0, 1)
        for end, value in zip(ends.tolist(), logs[pieces].tolist()):
            alpha[end] = value
        for lo in range(0, n, BLOCK):
            starts, ends, pieces = self._arcs_alone(word, self.tries[1], lo, min(n, lo + BLOCK))
            _flow(alpha, zip(starts.tolist(), ends.tolist(), logs[pieces].tolist()))
        return alpha

    def _expected_alone(self, word: np.ndarray, logs: np.ndarray) -> np.ndarray:
        n = len(word)
        alpha = np.frombuffer(self._forward_alone(word, logs))
        beta = array("d", [-math.inf]) * (n + 1)
        beta[n] = 0.0
        after = np.frombuffer(beta)
        counts = np.zeros(self.size)
        for lo in reversed(range(0, n, BLOCK)):
            starts, ends, pieces = self._arcs_alone(word, self.tries[1], lo, min(n, lo + BLOCK))
            _flow(beta, zip(ends[::-1].tolist(), starts[::-1].tolist(), logs[pieces[::-1]].tolist()))
            share = np.exp(alpha[starts] + logs[pieces] + after[ends] - alpha[n])
            counts += np.bincount(pieces, share, self.size)
        _, ends, pieces = self._arcs_alone(word, self.tries[0], 0, 1)
        counts += np.bincount(pieces, np.exp(logs[pieces] + after[ends] - alpha[n]), self.size)
        counts[0] += np.exp(logs[0] + after[0] - alpha[n])
        counts[self.stop] += 1
        return counts

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the list, bytes) of words of one length, CHUNK at a time; long ones fewer."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            step = max(1, min(CHUNK, (1 << 17) // max(1, int(sizes[group[0]])))) if len(group) else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                n = int(sizes[part[0]])
                yield part, np.frombuffer(b"".join(data[i] for i in part), np.uint8).reshape(len(part), n)


def _blocks(rows: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches put together: words are short, and array operations want many of them."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _flow(logs: array, arcs: Iterator[tuple[int, int, float]]) -> None:
    """Add to each arc's target what comes from its source; all arcs into a source come before those out of it."""
    exp, log1p = math.exp, math.log1p
    for source, target, value in arcs:
        value += logs[source]
        there = logs[target]
        if value > there:
            logs[target] = value + log1p(exp(there - value))
        elif value > -math.inf:
            logs[target] = there + log1p(exp(value - there))


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(values - safe).sum(axis=0))


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of (text, learn) with how often the rows to learn from have them; 0 for the others."""
    learnt: Counter = Counter()
    other: set[bytes] = set()
    read = 0

    def out() -> pa.RecordBatch:
        rest = [w for w in other if w not in learnt]
        words = [*learnt, *rest]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([*learnt.values(), *[0] * len(rest)], pa.int64())], ["word", "c"]
        )
        learnt.clear()
        other.clear()
        return batch

    for batch in batches(rows):
        for text, learn in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            (learnt if learn else other).update(words_of(text))
            read += len(text)
        if len(learnt) + len(other) > HELD or read > HELD_BYTES:
            yield out()
            read = 0
    if learnt or other:
        yield out()


def train(docs: DataFrame, learn: str, vocabulary: str, text: str = "text", ranks: bool = True, whole_words: bool = False) -> dict:
    """Word counts and lattice weights from the rows of which column ``learn`` is true.

    Returns ``words`` (word, c, logp: a table of all distinct words), the totals, and the frequent
    words (at most FREQUENT, so they fit everywhere).
    """
    spark = prepared(docs.sparkSession)
    ends, = docs.where(F.col(learn)).agg(F.count("*")).first()
    counts = written(
        docs.select(F.col(text), F.col(learn)).mapInArrow(_counted, "word string, c bigint")
        .groupBy("word").agg(F.sum("c").alias("c")),
        "words",
    )
    total, kinds, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.expr("count_if(c > 0)"), F.expr("count_if(c = 1)"), F.expr("count_if(c = 2)")
    ).first()
    first, inner = load_pieces(vocabulary, ranks)
    pieces = list(first), list(inner)
    lattice = Lattice(*pieces)
    prior = np.array([*(first[p] for p in lattice.first), *(inner[p] for p in lattice.inner), max(inner.values())])
    prior /= prior.sum()
    logs = lattice.normal(prior)
    seen = kinds if whole_words else total
    for _ in range(ROUNDS):
        logs_now = logs

        def expect(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = Lattice(*pieces)
            found = np.zeros(net.size)
            for block in _blocks(rows):
                c = block.column("c").to_numpy()
                for place, words in net.by_length(block.column("word").to_pylist()):
                    found += net.expected(words, logs_now, None if whole_words else c[place])
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["piece", "n"])

        used = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece bigint, n double")
        weights = prior * max(1.0, 0.01 * seen)
        for row in used.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # the pieces of the vocabulary
            weights[row.piece] += row.n
        logs = lattice.normal(weights)

    def log_probability(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Lattice(*pieces)
        for block in _blocks(rows):
            out = np.zeros(block.num_rows)
            for place, words in net.by_length(block.column("word").to_pylist()):
                out[place] = net.log_probability(words, logs)
            for part in block.append_column("logp", pa.array(out / np.log(10))).to_batches(max_chunksize=8192):
                yield part

    words = written(counts.mapInArrow(log_probability, "word string, c bigint, logp double"), "word-scores")
    n, v = total + ends, kinds + (ends > 0)
    # the end is a token that occurs ``ends`` times
    discount = min(0.95, max(0.05, (once + (ends == 1)) / max(1, once + 2 * twice))) if n else 0.0
    sizes = words.where("c > 0").groupBy(F.floor(F.log2("c") * 16).cast("int").alias("bin")).count().collect()  # under 1,024
    kept, least = 0, None
    for row in sorted(sizes, key=lambda r: -r.bin):
        if (kept := kept + row["count"]) > FREQUENT:
            break
        least = row.bin
    frequent = [] if least is None else words.where(
        (F.col("c") > 0) & (F.floor(F.log2("c") * 16).cast("int") >= least) & (F.char_length("word") <= LONGEST)
    ).collect()  # FREQUENT rows of LONGEST characters at most
    return {"words": words, "n": n, "v": v, "ends": ends, "discount": discount, "whole_words": whole_words,
            "frequent": [(r.word, r.c, r.logp) for r in frequent]}


def _end(model: dict) -> float:
    """How likely a token is an end."""
    return (model["ends"] + 0.5) / (model["n"] + 1)


def logs10(c, logp, model: dict) -> tuple:
    """(base, score) of a word as expressions or arrays: log10 of its probabilities."""
    n, v, d = model["n"], model["v"], model["discount"]
    base = f"log10(({c} + 0.1D) / {n + 0.1 * (v + 1)!r}D)"
    if not (n and model["whole_words"]):
        return base, f"({logp} + {math.log10(1 - _end(model))!r}D)"
    # log10(a + b) where b may be far below the least double
    rest = f"({logp} + {float(np.log10(d * v / n))!r}D)"
    return base, f"CASE WHEN {c} > {d!r}D THEN log10(({c} - {d!r}D) / {n}D + pow(10D, {rest})) ELSE {rest} END"


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = prepared(docs.sparkSession)
    words, frequent = model["words"], model["frequent"]
    n, v, d, ends = model["n"], model["v"], model["discount"], model["ends"]
    c = np.array([x[1] for x in frequent], np.float64)
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    whole = n and model["whole_words"]
    own = np.array([x[2] for x in frequent], np.float64)
    own = np.log10((c - d) / n + 10 ** (own + np.log10(d * v / n))) if whole else own + math.log10(1 - _end(model))
    shared = spark.sparkContext.broadcast(({x[0].encode(): i for i, x in enumerate(frequent)}, base, own))
    end_base = float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))
    end_own = math.log10((ends - d) / n if whole else _end(model))

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base: double, own: double, words: array<string>, times: array<int>>")
    @giving_back
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, base, own = shared.value
        base, own = np.append(base, 0.0), np.append(own, 0.0)
        for column in columns:
            tokens, known, bases, owns, rest, times, ends_at = [], [], [], [], [], [], [0]
            for one in texts_of(column):
                found = Counter(words_of(one))
                number = np.fromiter(found.values(), np.int64, len(found))
                place = np.fromiter(map(places.get, found, repeat(-1)), np.int64, len(found))
                tokens.append(int(number.sum()) + 1)
                known.append(int(number[place >= 0].sum()) + (ends > 0))
                bases.append(float(base[place] @ number) + end_base)
                owns.append(float(own[place] @ number) + end_own)
                rare = place < 0
                rest += compress(found, rare.tolist())
                times.append(number[rare])
                ends_at.append(len(rest))
            at = pa.array(ends_at, pa.int32())
            flat = np.concatenate(times).astype(np.int32) if times else np.zeros(0, np.int32)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(bases), pa.array(owns),
                    pa.ListArray.from_arrays(at, pa.array(rest, pa.string())), pa.ListArray.from_arrays(at, pa.array(flat)),
                ],
                ["n_tokens", "n_known", "base", "own", "words", "times"],
            )

    texts = docs.select(F.col(doc_id).alias("doc_id"), read(F.col(text)).alias("r"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "r.*"), "read-texts")
    pairs = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", "p.words", "p.times")
    base_log, own_log = logs10("c", "logp", model)
    found = (
        pairs.join(words.withColumnRenamed("word", "words"), "words")
        .select("row", F.expr(f"times * {base_log}").alias("base"), F.expr(f"times * ({own_log})").alias("own"),
                F.expr("CASE WHEN c > 0 THEN times ELSE 0 END").alias("known"))
        .groupBy("row").agg(F.sum("base").alias("b"), F.sum("own").alias("o"), F.sum("known").alias("k"))
    )
    zero = F.lit(0)
    return texts.drop("words", "times").join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("own") + F.coalesce("o", zero)).alias("score"),
    )
