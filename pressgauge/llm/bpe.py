"""Operator 2: byte-level BPE by backtracking over longest matches, and decoding by offsets.

A text is cut into pre-tokens by the vocabulary's pattern. In a pre-token an Aho-Corasick automaton
gives the longest token at each place. The encoder walks on with longest tokens, each checked
against its left neighbour: two tokens may stand side by side only if no merge would have joined
parts of them earlier. Where no token fits, it takes the next shorter one, then steps back; places
from which the rest can't be encoded are marked, so each is tried once and time is linear. The
result is exactly what applying the merges in order gives.

Decoding gathers bytes from one blob of all tokens by a table of offsets.

Null and empty texts have no ids; null ids decode to an empty text. Repeated rows and texts of any
length are encoded each on its own. An input column named like the output is replaced, all other
columns are kept.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import Memo, giving_back, prepared, spans

#: Unicode's white space, as a character class (fixed value).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Characters whose class is the same in all recent Unicode versions. A text with others is cut by
#: the tokenizer library's own splitter, which may know another version than the regex module.
SETTLED = r"[\x00-\u052f\u2010-\u205f\u20a0-\u9fff\uac00-\ud7a3]*"


def settled_pattern() -> re.Pattern:
    r"""The vocabulary family's pre-token pattern, with its classes written out for settled characters.

    Fixed value: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
    """

    def letters(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(1 << 16) if unicodedata.category(chr(c))[0] == kind)

    word, number = letters("L"), letters("N")
    return re.compile(
        rf" ?[{word}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{SPACE}{word}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes are numbered from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens in order of birth: the single bytes, then the result of each merge."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        self.added = added
        self.text: list[bytes] = []
        self.ids: list[int] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = []
        place: dict[bytes, int] = {}
        by_bytes = {bytes(letters[c] for c in t): i for t, i in tokens.items() if t not in added}
        for b in range(256):
            place[bytes([b])] = b
            self._grow(bytes([b]), by_bytes[bytes([b])], None)
        for left, right in merges:
            pair = tuple(place[bytes(letters[c] for c in part)] for part in (left, right))
            whole = self.text[pair[0]] + self.text[pair[1]]
            if whole in place:
                raise ValueError(f"two merges make the same token: {whole!r}")
            place[whole] = self.merged[pair] = len(self.text)
            self._grow(whole, by_bytes[whole], pair)

    def _grow(self, text: bytes, token_id: int, parts: tuple[int, int] | None) -> None:
        self.text.append(text)
        self.ids.append(token_id)
        self.parts.append(parts)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(blob, offsets): token i is blob[offsets[i]:offsets[i + 1]]; unknown ids are empty."""
        by_id = dict(zip(self.ids, self.text)) | {i: t.encode() for t, i in self.added.items()}
        pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), offsets


def load(path: str) -> tuple:
    """The arguments of Vocabulary, from a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
    return told["model"]["vocab"], merges, {t["content"]: t["id"] for t in told["added_tokens"]}


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.size = [len(t) for t in vocabulary.text]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary.text):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in vocabulary.text]
        self.fits = Memo(self._fits)
        self.pieces = Memo(self._piece)
        self.pattern = settled_pattern()
        self.settled = re.compile(SETTLED)
        self.added = (
            re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))))
            if vocabulary.added else None
        )

    def _shorter(self, text: bytes) -> int:
        """The longest token that begins ``text`` and isn't all of it, -1 for a single byte."""
        get = self.automaton.get
        whole = text.decode("latin-1")
        for n in range(len(whole) - 1, 0, -1):
            if (found := get(whole[:n], -1)) >= 0:
                return found
        return -1

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at one edge, finest first, each with the birth of what absorbs it."""
        out, end = [], 1 << 60
        while True:
            out.append((token, end))
            if (parts := self.v.parts[token]) is None:
                return out[::-1]
            end, token = token, parts[side]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the border between two tokens alone.

        Parts on both sides of the border are walked through in time. At each moment one part ends
        at the border and one begins there; if a merge joins these two before either is absorbed on
        its own side, the border would not be there. Of equal merges the left one goes first.
        """
        left, right = self._edge(pair[0], 1), self._edge(pair[1], 0)
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = left[i], right[j]
            joined = self.v.merged.get((a, b))
            if joined is not None and joined < a_end and joined <= b_end:
                return False
            if a_end == b_end == 1 << 60:
                return True
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def _piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode()
        n = len(text)
        longest = [0] * n
        size = self.size
        for end, token in self.automaton.iter(text.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # a later end is a longer token
        hopeless = bytearray(n + 1)
        chosen: list[int] = []
        at, token, fits = 0, longest[0], self.fits
        while True:
            end = at + size[token]
            if not hopeless[end] and (not chosen or fits[chosen[-1], token]):
                chosen.append(token)
                at = end
                if at == n:
                    return tuple(self.v.ids[t] for t in chosen)
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                hopeless[at] = 1
                last = chosen.pop()
                at -= size[last]
                token = self.shorter[last]

    def _split(self, text: str) -> list[str]:
        if self.settled.fullmatch(text):
            return self.pattern.findall(text)
        from tokenizers import pre_tokenizers

        cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        at = 0
        for hit in self.added.finditer(text) if self.added else ():
            out += self._plain(text[at : hit.start()])
            out.append(self.v.added[hit.group()])
            at = hit.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self._split(text))))


def decode_all(ids: pa.Array, blob: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of a batch of id lists; an id outside the table gives nothing."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = (flat >= 0) & (flat < len(offsets) - 1)
    flat = np.where(known, flat, 0)
    lengths = np.where(known, offsets[flat + 1] - offsets[flat], 0)
    data = blob[spans(offsets[flat], lengths)].tobytes()
    token_ends = np.concatenate([[0], np.cumsum(lengths)])
    ends = token_ends[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of ``text`` (array<int>) in column ``out``."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(load(vocabulary))  # size of the file

    @F.arrow_udf("array<int>")
    @giving_back
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(*shared.value))
        for column in columns:
            lists = [encoder.encode(t) for t in column.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return df.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids in column ``out``; special tokens are written out."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(Vocabulary(*load(vocabulary)).table())

    @F.arrow_udf("string")
    @giving_back
    def text_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield decode_all(column, *shared.value)

    return df.withColumn(out, text_of(F.col(ids)))
