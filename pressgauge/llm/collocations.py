"""Phrase collocations: frequent phrases of few words that hold together better than chance.

* Texts are lowered (A-Z), cut into pieces at PIECE_ENDS and into words at blanks and tabs, all on bytes.
* A word's fingerprint is a difference of prefix sums of byte x base^place (mod 2^64); an n-gram's one is the
  same over its words' fingerprints. numpy works out all of a block's at once.
* Length by length, tasks count fingerprints, a shuffle sums them up, and those of LEAST or more are marked
  in a bit table of a fixed size that goes to all tasks. An n-gram is counted only if both n-1-grams in it are
  marked: others can't be frequent. The table only spares work: a bit set by chance lets more through.
* In a last pass, marked n-grams are read from the text at an occurrence (a place in the block). All other
  occurrences of that fingerprint in the block are compared with it; one that differs is a collision and
  goes out as a text of its own. Texts of frequent phrases only are made, summed up by text: so counts are
  exact, whatever fingerprints collide.

Scores are whole numbers, worked out in 38 digits (exact up to counts of 10^15).

Counts are by ``lang`` (null: ``und``). A null or empty text has no words. Repeated rows and rows with a null
id count each. An empty table gives no rows, nor does a lang without a phrase that is frequent enough. Other
columns are not looked at. Very long texts are read in parts cut at piece ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import LOWER, UPPER, batches, giving_back, prepared, spans, texts_of, written

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LEAST, MOST_WORDS, KEEP = 10, 3, 2000
#: A phrase goes if a longer one around it has INSIDE hundredths of its occurrences.
INSIDE = 50
#: Bits of the table of frequent fingerprints (8 MB).
BITS = 26
#: Bytes that are looked at together; fingerprints that a task holds before it hands them on.
BLOCK, HELD = 2_000_000, 1_000_000
#: Words over so many bytes get their fingerprint one by one.
LONG = 4096
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[list(b" \t")] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Powers:
    """base^i and base^-i (mod 2^64), as far as they were needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


def settled(x: np.ndarray) -> np.ndarray:
    """Stir the bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(symbols: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.of(len(symbols))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)], dtype=np.uint64)])


class Words:
    """The words of a block of texts in one lang: where they are, in which piece, and fingerprints of all n-grams."""

    bytes_powers, word_powers = Powers(_BASE), Powers(_WORD_BASE)

    def __init__(self, block: bytes, lang: str, mask: int = 2**64 - 1) -> None:
        self.block, self.mask = block, np.uint64(mask)
        self.data = np.frombuffer(block, np.uint8)
        kind = _KIND[self.data]
        edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 12))
        self.symbols = self._symbols()
        self.sums = prefix_sums(self.symbols, self.word_powers)

    def __len__(self) -> int:
        return len(self.starts)

    def _symbols(self) -> np.ndarray:
        out, sizes = np.zeros(len(self), np.uint64), self.ends - self.starts
        sums = prefix_sums(self.data.astype(np.uint64) + np.uint64(1), self.bytes_powers) if len(self) else None
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            _, down = self.bytes_powers.of(len(self.data))
            a, b = self.starts[short], self.ends[short]
            out[short] = settled((sums[b] - sums[a]) * down[a] + sizes[short].astype(np.uint64))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.block[self.starts[i] : self.ends[i]], 7)
        return out & self.mask

    def prints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints of the n words from each word on, whether these lie in one piece)."""
        count = max(0, len(self) - n + 1)
        _, down = self.word_powers.of(len(self))
        raw = (self.sums[n : n + count] - self.sums[:count]) * down[:count]
        return settled(raw ^ self.seed ^ np.uint64(n)) & self.mask, self.piece[:count] == self.piece[n - 1 : n - 1 + count]

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.block[a:b] for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist()))

    def odd_words(self) -> np.ndarray:
        """Which words' bytes differ from those of the first word of the same fingerprint."""
        _, first, which = np.unique(self.symbols, return_index=True, return_inverse=True)
        like = first[which]
        sizes = self.ends - self.starts
        odd = sizes != sizes[like]
        same = np.flatnonzero(~odd)
        for part in np.array_split(same, max(1, len(same) // 200_000)):
            mine, theirs = spans(self.starts[part], sizes[part]), spans(self.starts[like[part]], sizes[part])
            differ = np.concatenate([[0], np.cumsum(self.data[mine] != self.data[theirs])])
            ends = np.cumsum(sizes[part])
            odd[part] = differ[ends] != differ[ends - sizes[part]]
        return odd


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text of about ``most`` bytes, cut at ends of pieces only."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(bytes([c]), at, at + most) for c in PIECE_ENDS)
        if end < 0:
            later = [x for c in PIECE_ENDS if (x := text.find(bytes([c]), at + most)) >= 0]
            if not later:
                break
            end = min(later)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def blocks(rows: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[str, bytes]]:
    """(lang, lowered texts) with an end of a piece between texts; a block for each lang and BLOCK bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches(rows):
        for lang, text in zip(batch["lang"].to_pylist(), texts_of(batch["text"])):
            for part in cut(text, most):
                held.setdefault(lang, []).append(part.translate(_LOW))
                size += len(part)
                if size >= most:
                    yield from ((of, b"\n".join(parts)) for of, parts in held.items())
                    held, size = {}, 0
    yield from ((of, b"\n".join(parts)) for of, parts in held.items())


class Marks:
    """A table of bits: which fingerprints may be frequent."""

    def __init__(self, bits: int, places: np.ndarray, words: np.ndarray) -> None:
        self.bits = bits
        self.words = np.zeros(1 << max(0, bits - 6), np.uint64)
        self.words[places] = words

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _marks(counts: DataFrame, bits: int) -> Marks:
    """The bit table of ``counts``' fingerprints: 2^(bits - 6) numbers at most, whatever their number."""
    place = f"shiftrightunsigned(print, {64 - bits})"
    words = counts.selectExpr(f"shiftright({place}, 6) AS place", f"shiftleft(1L, cast({place} & 63 AS int)) AS bit")
    got = words.groupBy("place").agg(F.bit_or("bit").alias("word")).toArrow()
    return Marks(bits, got["place"].to_numpy(), got["word"].to_numpy().view(np.uint64))


def possible(words: Words, n: int, marks: list[Marks]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, which of them may be frequent): in one piece, and all shorter n-grams in them are marked."""
    kept = None
    for k in range(1, n + 1):
        prints, fit = words.prints(k)
        if kept is not None:
            fit = fit & kept[: len(prints)] & kept[1 : 1 + len(prints)]
        if k < n:
            kept = fit & marks[k - 1].has(prints)
    return prints, fit


def _counted(n: int, shared, mask: int):
    """Counts of fingerprints of n words; of single words also the number of words by lang."""
    schema = pa.schema([("lang", pa.string()), ("print", pa.int64()), ("count", pa.int64())])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        prints, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return prints, np.bincount(place, np.concatenate([c for _, c in held]), len(prints)).astype(np.int64)

    def out(prints: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(prints), 200_000):
            part = prints[a : a + 200_000]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(counts[a : a + 200_000])], schema=schema
            )

    @giving_back
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, totals = shared.value if shared else [], Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for lang, block in blocks(rows):
            words = Words(block, lang, mask)
            totals[lang] += len(words)
            prints, fit = possible(words, n, marks)
            found = np.unique(prints[fit], return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > 2 * HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*merged(held))
        if n == 1 and totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], schema=schema)

    return run


class Read:
    """Phrases that a task has read, by fingerprint. Each word's fingerprint stands for one text; whatever
    else has it is odd and kept by text."""

    def __init__(self) -> None:
        self.names: dict[int, bytes] = {}
        self.held: dict[tuple[str, int], list] = {}
        self.odd: Counter = Counter()

    def size(self) -> int:
        return sum(len(part[0]) for parts in self.held.values() for part in parts) + len(self.odd) + len(self.names)

    def odd_words(self, words: Words, marked: np.ndarray) -> np.ndarray:
        """Which of the marked words have a fingerprint that stands for another text."""
        at = np.flatnonzero(marked)
        symbols, first, which = np.unique(words.symbols[at], return_index=True, return_inverse=True)
        texts = [words.block[a:b] for a, b in zip(words.starts[at[first]].tolist(), words.ends[at[first]].tolist())]
        clash = [self.names.setdefault(s, text) != text for s, text in zip(symbols.tolist(), texts)]
        odd = words.odd_words()
        odd[at] |= np.array(clash, bool)[which]
        return odd

    def add(self, lang: str, n: int, words: Words, odd_word: np.ndarray, prints: np.ndarray, at: np.ndarray) -> None:
        """The n-grams that begin at the words ``at``."""
        odd = np.zeros(len(at), bool)
        for k in range(n):
            odd |= odd_word[at + k]
        for i in at[odd].tolist():
            self.odd[lang, words.text(i, n)] += 1
        at = at[~odd]
        symbols = np.stack([words.symbols[at + k] for k in range(n)], axis=1)
        self.merge(lang, n, prints[at], symbols, np.ones(len(at), np.int64))

    def merge(self, lang: str, n: int, prints: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> None:
        """Compare all n-grams of a fingerprint with the first one of it; count what is equal together."""
        parts = self.held.setdefault((lang, n), [])
        distinct, first, which = np.unique(prints, return_index=True, return_inverse=True)
        differ = (symbols != symbols[first][which]).any(axis=1)
        for i in np.flatnonzero(differ).tolist():
            self.odd[lang, self.text(symbols[i])] += int(counts[i])
        parts.append((distinct, symbols[first], np.bincount(which[~differ], counts[~differ], len(distinct)).astype(np.int64)))
        if len(parts) > 8:
            together = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            self.merge(lang, n, *together)

    def text(self, symbols: np.ndarray) -> bytes:
        return b" ".join([self.names[s] for s in symbols.tolist()])

    def out(self) -> Iterator[tuple[list, list, list]]:
        """Columns of (lang, phrase, count); empties all."""
        for (lang, n), parts in list(self.held.items()):
            if len(parts) > 1:
                together = [np.concatenate(x) for x in zip(*parts)]
                parts.clear()
                self.merge(lang, n, *together)
            for _, symbols, counts in parts:
                for a in range(0, len(counts), 20_000):
                    texts = [b" ".join([self.names[s] for s in row]) for row in symbols[a : a + 20_000].tolist()]
                    yield [lang] * len(texts), texts, counts[a : a + 20_000]
        if self.odd:
            yield [k[0] for k in self.odd], [k[1] for k in self.odd], np.array(list(self.odd.values()))
        self.__init__()


def _read(shared, mask: int):
    """(lang, phrase, count) of the n-grams that are marked, by their text."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("count", pa.int64())])

    @giving_back
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, read = shared.value, Read()

        def out() -> Iterator[pa.RecordBatch]:
            for langs, texts, counts in read.out():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())], schema=schema
                )

        for lang, block in blocks(rows):
            words = Words(block, lang, mask)
            odd_word = read.odd_words(words, marks[0].has(words.prints(1)[0]))
            for n in range(1, len(marks) + 1):
                prints, fit = possible(words, n, marks)
                read.add(lang, n, words, odd_word, prints, np.flatnonzero(fit & marks[n - 1].has(prints)))
            if read.size() > HELD:
                yield from out()
        yield from out()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, bits: int = BITS, mask: int = 2**64 - 1) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, count) of all phrases of 1 to ``most_words`` words that occur ``least`` times or
    more, (lang, n): words in all) of docs (lang, text)."""
    spark = prepared(docs.sparkSession)
    marks: list[Marks] = []
    totals = None
    for n in range(1, most_words + 1):
        shared = spark.sparkContext.broadcast(list(marks)) if marks else None  # tables of a fixed size
        counts = docs.mapInArrow(_counted(n, shared, mask), "lang string, print bigint, count bigint").groupBy("lang", "print").agg(F.sum("count").alias("count"))
        counts = written(counts.where(F.col("print").isNull() | (F.col("count") >= least)), f"counted-{n}")
        if n == 1:
            totals = counts.where("print is null").select("lang", F.col("count").alias("n"))
        marks.append(_marks(counts.where("print is not null"), bits))
    shared = spark.sparkContext.broadcast(marks)
    read = docs.mapInArrow(_read(shared, mask), "lang string, phrase binary, count bigint")
    sums = read.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    text = F.col("phrase").cast("string")
    counted = sums.select("lang", text.alias("phrase"), F.size(F.split(text, " ")).alias("words"), "count")
    return written(counted, "phrases"), totals


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more: the cut with the lowest score."""
    parts = lambda first, last: F.array_join(F.slice("list", first, last), " ")
    phrases = counted.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"), F.split("phrase", " ").alias("list"))
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", parts(F.lit(1), F.col("k")).alias("left"), parts(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, name: counted.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast((cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')}) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def inside(counted: DataFrame) -> DataFrame:
    """(lang, phrase, around): how often the most frequent longer phrase around a phrase of two words or more occurs."""
    longer = counted.where("words > 2").select("lang", "words", "count", F.split("phrase", " ").alias("list"))
    sizes = longer.withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    cut = sizes.withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
    part = F.array_join(F.slice("list", F.col("at"), F.col("size")), " ")
    return cut.groupBy("lang", part.alias("phrase")).agg(F.max("count").alias("around"))


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, keep: int | None = KEEP,
    share: int = INSIDE, bits: int = BITS, mask: int = 2**64 - 1,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``keep`` phrases, or all."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted, totals = phrase_counts(docs, least, most_words, bits, mask)
    left = scored(counted).join(inside(counted), ["lang", "phrase"], "left").where(F.expr(f"around IS NULL OR 100 * around < {share} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
