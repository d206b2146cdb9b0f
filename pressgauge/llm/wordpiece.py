"""Operator 8: how many word pieces greedy longest-match cuts a text into, without building them.

The vocabulary is a trie over word symbols: the bytes of a word, the last of them marked as the end.
Each node has a failure link, and the number of pieces that are complete when it is followed. A word
is read once, symbol by symbol; where the trie ends, the node's count is added and its link taken.

Null and empty texts have no words and no pieces. Repeated rows count each on its own. Columns named
like the outputs are replaced, all others kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import Memo, giving_back, prepared

#: The vocabulary's own rule for words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = 256  # added to a word's last byte


def symbols(word: str) -> list[int]:
    out = list(word.encode())
    if out:
        out[-1] += END
    return out


class Automaton:
    """``pieces`` are symbol lists. Symbols that no piece covers count as a piece each."""

    def __init__(self, pieces: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.last: list[bool] = [False]
        alone = [[s] for s in range(2 * END)]  # so every word can be cut
        for piece in alone + pieces:
            node = 0
            for s in piece:
                node = self.next[node].setdefault(s, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.last.append(False)
            self.last[node] = True
        self.fail = [0] * len(self.next)
        self.done = [0] * len(self.next)
        todo = deque((0, s, n) for s, n in self.next[0].items())
        while todo:
            parent, s, node = todo.popleft()
            todo.extend((node, t, n) for t, n in self.next[node].items())
            if self.last[node]:  # the whole of it is a piece
                self.fail[node], self.done[node] = 0, 1
                continue
            at, count = self.fail[parent], self.done[parent]
            while s not in self.next[at]:
                count += self.done[at]
                at = self.fail[at]
            self.fail[node], self.done[node] = self.next[at][s], count

    def count(self, word: list[int]) -> int:
        node = count = 0
        for s in word:
            while s not in self.next[node]:
                count += self.done[node]
                node = self.fail[node]
            node = self.next[node][s]
        while node:
            count += self.done[node]
            node = self.fail[node]
        return count


def load_pieces(path: str) -> list[list[int]]:
    """Pieces of a byte-letter vocabulary file whose word ends are written ``</w>``."""
    from pressgauge.llm.bpe import byte_letters

    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    added = {t["content"] for t in told["added_tokens"]}
    out = []
    for piece in told["model"]["vocab"]:
        if piece in added:
            continue
        stem = piece.removesuffix("</w>")
        one = [letters[c] for c in stem]
        if one and stem != piece:
            one[-1] += END
        out.append(one)
    return [p for p in out if p]


class Counter:
    def __init__(self, pieces: list[list[int]]):
        self.automaton = Automaton(pieces)
        self.pattern = regex.compile(WORDS)
        self.known = Memo(lambda word: self.automaton.count(symbols(word)))

    def count(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of a text, normalised as the vocabulary wants it."""
        if not text:
            return 0, 0
        words = self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        return len(words), sum(map(self.known.__getitem__, words))


def token_counts(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_pieces`` (long) of column ``text``."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(load_pieces(vocabulary))  # size of the file

    @F.arrow_udf("struct<n_words: bigint, n_pieces: bigint>")
    @giving_back
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for column in columns:
            both = np.array([counter.count(t) for t in column.to_pylist()], np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["n_words", "n_pieces"])

    got = df.withColumn("__counted", counted(F.col(text)))
    return got.withColumns({"n_words": F.col("__counted.n_words"), "n_pieces": F.col("__counted.n_pieces")}).drop("__counted")
