"""Operator 5: removal of byte strings that an earlier document has, by suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller
id. Strings lie within one document; overlapping ones count; all are judged on the input.

1. Candidates. Each string of LENGTH bytes is named by the least hash among its runs of RUN bytes, so
   equal strings have equal names, wherever they are. Neighbouring strings mostly share the name and
   make one segment, of STRINGS strings at most. Names that only one document has are left: a string
   with such a name is in one document. Each task hands on a name once, so a passage that most
   documents share is no burden to the task that gathers it.
2. Equal segments become one, with the least id that has it. In all other documents such a segment is
   removed as a whole. A name with more than CROWD segments is dealt string by string, each under
   its own hash, so that no name's segments must meet in one place.
3. Suffix sorting. Segments are dealt out by name. Those without a string whose hash another one has
   are left. Each task joins the others into texts (SHARD bytes or one name's segments) and sorts all
   suffixes with common prefixes (``induced``). Neighbours with a common prefix of LENGTH bytes are
   equal strings; the least id among them decides for each.
4. The removed starts go back to their documents by the segment, and documents drop the bytes.

Names of candidates go to all tasks as a bit table of 64 MB at most; a name that is there by chance costs a
little work. More than SENT names are dealt with in several rounds, each with a table of its own: what lies
on disk then is a round's share. No segment is shuffled before the table has told that it is wanted.

A null text is empty. Rows that repeat an id don't remove from each other, and each is cleared by
smaller ids. Rows with a null id neither remove nor lose anything. An empty table gives none.
Other columns are kept; those named like the outputs are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import batches, giving_back, only_result, prepared, released, spans, text_buffers, written
from pressgauge.llm.induced import CAP, Sorter
from pressgauge.session import dealt

LENGTH, RUN = 50, 16
#: Strings in a segment at most: the starts that are removed are the bits of one number.
STRINGS = 32
CROWD = 200_000
#: Names of a round, sent to all tasks as a table of BITS (a power of two) at most. Each round reads the texts
#: again, so beyond ROUNDS (a power of two) tables are fuller instead: they prune less and stay exact.
SENT, BITS, ROUNDS = 1 << 27, 29, 8
#: Bits of the table that a task makes at once (a power of two).
SLICE = 20
#: Bytes that are dealt with together; names that a task holds before it hands them on.
SHARD, HELD = 4 << 20, 1 << 21

_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Of all runs of ``width`` bytes, put together from runs of powers of two."""
    part, size, factor = _ODD[data], 1, int(_MIX[0])
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(factor) + part[done : done + n]
            done += size
        if 2 * size > width:
            break
        part = part[:-size] * np.uint64(factor) + part[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    out = out ^ (out >> np.uint64(29))
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return out


def _bits(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each value in a table of 1 << size."""
    values = values.view(np.uint64)
    return tuple(((values * factor) >> np.uint64(64 - size)).astype(np.int64) for factor in _MIX)


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """A table with two bits for each long in the column. Tasks make it slice by slice."""
    size = min(BITS, max(10, (values.count() * 32).bit_length()))

    def dealt_out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            place = np.unique(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], np.diff(place >> SLICE) != 0]))
            inside = (place & ((1 << SLICE) - 1)).astype(np.int32)
            parts = [part.tobytes() for part in np.split(inside, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array((place[first] >> SLICE).astype(np.int32)), pa.array(parts, pa.binary())], ["slice", "places"])

        for batch in batches(rows):
            held.extend(_bits(batch.column(0).to_numpy(), size))
            if sum(map(len, held)) >= HELD:
                yield out()
                held = []
        if held:
            yield out()

    def filled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches(rows):
            for at, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = slices.setdefault(at, np.zeros(1 << min(SLICE, size), bool))
                marks[np.frombuffer(places, np.int32)] = True
        for at, marks in slices.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"]
            )

    made = values.select(column).mapInArrow(lambda r: released(dealt_out(r)), "slice int, places binary")
    made = made.repartition("slice").mapInArrow(lambda r: released(filled(r)), "slice int, bits binary")
    table = np.zeros((1 << size) // 8, np.uint8)
    for row in made.toLocalIterator():  # 1 << BITS bits at most
        part = np.frombuffer(row.bits, np.uint8)
        table[row.slice * len(part) : (row.slice + 1) * len(part)] = part
    return table


def _marked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have both of their bits."""
    first, second = _bits(values, (len(table) * 8).bit_length() - 1)
    out = (table[first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(out)
    second = second[some]
    out[some] = (table[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1
    return out


def segments(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in data, strings, name) of each segment of each text, in order."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    hashed = hashes(data, RUN)
    many, step = length - RUN + 1, 1
    least = hashed
    while 2 * step <= many:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: n], least[many - step :][:n])
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    at = spans(offsets[:-1], counts)
    name = least[at]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(at)))
    most = min(STRINGS, length)  # so that the first and the last string of a segment cover it
    pieces = -(-runs // most)
    first = np.repeat(starts, pieces) + spans(np.zeros(len(runs), np.int64), pieces) * most
    strings = np.diff(np.append(first, len(at)))
    return text[first], at[first], strings, name[first]


def _names(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(name, doc_id, times) for the documents of a task: each name once, doc_id null if several have it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        name, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        end = np.append(start[1:], len(name))
        several = doc[start] != doc[end - 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(name[start].view(np.int64)), pa.array(doc[start], mask=several), pa.array(end - start)], ["name", "doc_id", "times"]
        )

    for batch in batches(rows):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text, _, _, name = segments(*text_buffers(batch.column(1)), length)
        held.append((name, ids[text].astype(np.int64)))
        size += len(name)
        if size >= HELD:
            yield from _cut(out())
            held, size = [], 0
    if size:
        yield from _cut(out())


def _cut(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, times) of the names that several documents have; all rows of a name are in the partition."""
    table = pa.Table.from_batches(list(rows), schema=pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("times", pa.int64())]))
    if not table.num_rows:
        return
    name = table.column("name").to_numpy()
    known = table.column("doc_id").combine_chunks()
    several = known.is_null().to_numpy(zero_copy_only=False)
    doc = known.fill_null(0).to_numpy()
    order = np.argsort(name, kind="stable")
    name, doc, several, times = name[order], doc[order], several[order], table.column("times").to_numpy()[order]
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    wanted = np.logical_or.reduceat(several, start) | (np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start))
    found = pa.RecordBatch.from_arrays([pa.array(name[start][wanted]), pa.array(np.add.reduceat(times, start)[wanted])], ["name", "times"])
    yield from _cut(found)


_SEGMENT = "doc_id bigint, tie bigint, start int, strings int, name bigint, hash bigint"


def segment_hashes(data: np.ndarray, at: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """A hash of each segment from those of its first and its last string, which cover it if it has ``length``
    strings at most."""
    string = hashes(data, length)
    out = (string[at] * _ODD[0]) ^ (string[at + strings - 1] * _ODD[1] + strings.astype(np.uint64) * _ODD[2])
    out ^= out >> np.uint64(31)
    return out * _MIX[1]


class Wanted(NamedTuple):
    """Names of a round, of ``rounds``: their bit table, and those (sorted) whose segments are dealt string by string."""

    table: np.ndarray
    crowd: np.ndarray
    rounds: int
    turn: int


def _segments_of(rows: Iterator[pa.RecordBatch], wanted: Wanted, length: int, cut: bool = False) -> Iterator[pa.RecordBatch]:
    """Segments of (doc_id, tie, text) with a wanted name, if ``cut`` with their bytes."""
    for batch in batches(rows):
        offsets, data = text_buffers(batch.column(2))
        text, at, strings, name = segments(offsets, data, length)
        keep = _marked(wanted.table, name)
        if wanted.rounds > 1:
            keep &= (name & np.uint64(wanted.rounds - 1)) == wanted.turn
        if not keep.any():
            continue
        text, at, strings, name = text[keep], at[keep], strings[keep], name[keep]
        single = 0
        if len(wanted.crowd):
            many = wanted.crowd[np.minimum(np.searchsorted(wanted.crowd, name), len(wanted.crowd) - 1)] == name
            each = strings[many]
            single = int(each.sum())
            text = np.concatenate([text[~many], np.repeat(text[many], each)])
            at = np.concatenate([at[~many], spans(at[many], each)])
            strings = np.concatenate([strings[~many], np.ones(single, np.int64)])
            name = name[~many]
        hashed = segment_hashes(data, at, strings, length)
        if single:  # strings are named by their own hash
            name = np.concatenate([name, hashed[len(name) :]])
        ids, ties = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[text] for i in (0, 1))
        columns = [
            pa.array(ids), pa.array(ties), pa.array((at - offsets[text]).astype(np.int32)), pa.array(strings.astype(np.int32)),
            pa.array(name.view(np.int64)), pa.array(hashed.view(np.int64)),
        ]
        names = ["doc_id", "tie", "start", "strings", "name", "hash"]
        if cut:
            columns, names = [columns[0], columns[4]], ["doc_id", "name"]
            sizes = strings + length - 1
            for a in range(0, len(sizes), 1 << 16):  # a string may be cut once for each of its bytes
                b = a + (1 << 16)
                ends = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32)
                bytes_of = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[spans(at[a:b], sizes[a:b])])])
                yield from _cut(pa.RecordBatch.from_arrays([*(c[a:b] for c in columns), bytes_of], [*names, "segment"]), 8192)
        else:
            yield from _cut(pa.RecordBatch.from_arrays(columns, names), 8192)


def _candidates(rows: DataFrame, wanted: Wanted, length: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, start, strings, name, hash) of the segments with one of the names, and (name, segment, least,
    most): their bytes, each segment once for some of a task's bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)  # 1 << BITS bits at most and few names
    places = rows.mapInArrow(lambda r: released(_segments_of(r, sent.value, length)), _SEGMENT)
    distinct = rows.mapInArrow(
        lambda r: released(_distinct(_segments_of(r, sent.value, length, True))), "name bigint, segment binary, least bigint, most bigint"
    )
    return places, distinct


def _distinct(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, segment, least, most id) of (name, segment, doc_id): each segment once for some SHARD
    bytes of a task, so one that most documents share is few rows."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["name", "segment"], use_threads=False).aggregate([("doc_id", "min"), ("doc_id", "max")])
        table = table.select(["name", "segment", "doc_id_min", "doc_id_max"]).rename_columns(["name", "segment", "least", "most"])
        yield from table.combine_chunks().to_batches(max_chunksize=8192)

    for batch in batches(rows):
        held.append(batch.select(["name", "segment", "doc_id"]))
        size += held[-1].nbytes
        if size >= 4 * SHARD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def earlier(parts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each part the bits of its starts whose string a part with a smaller owner has too."""
    if length > CAP:
        raise ValueError(f"common prefixes are counted to {CAP}")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator follows each part
    text = np.ones(int(starts[-1]) + 1, np.uint16)
    text[-1] = 0
    text[spans(starts[:-1], sizes)] = data.astype(np.uint16) + 2
    out = np.zeros(len(parts), np.int64)
    sorter = Sorter(text)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def decide(places: np.ndarray, new: np.ndarray) -> None:
        """Whole groups of equal strings; new: where one begins."""
        part = np.searchsorted(starts, places, "right") - 1
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[part], first)
        later = owner[part] > np.repeat(least, np.diff(np.append(first, len(places))))
        np.bitwise_or.at(out, part[later], np.int64(1) << (places - starts[part])[later])

    for places, common in sorter.suffixes():
        part = np.minimum(np.searchsorted(starts, places, "right") - 1, len(parts) - 1)
        inside = places + length <= starts[part] + sizes[part]
        new = common < length
        # of a group of equal strings all are inside or none is; groups may go over blocks
        held.append((places[inside], new[inside]))
        last = np.flatnonzero(held[-1][1])
        if len(last) and sum(len(h[0]) for h in held) > 1 << 20:
            cut = int(last[-1])
            whole = [*held[:-1], (held[-1][0][:cut], held[-1][1][:cut])]
            held = [(held[-1][0][cut:], held[-1][1][cut:])]
            if sum(len(w[0]) for w in whole):
                decide(*(np.concatenate([w[i] for w in whole]) for i in (0, 1)))
    if sum(len(h[0]) for h in held):
        decide(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
    return out


def _met(parts: pa.ChunkedArray, length: int) -> np.ndarray:
    """The parts that have a string whose hash another part has too."""
    offsets, data = text_buffers(parts.combine_chunks())
    counts = np.diff(offsets) - length + 1
    part = np.repeat(np.arange(len(counts)), counts)
    string = hashes(data, length)[spans(offsets[:-1], counts)]
    order = np.argsort(string, kind="stable")  # the parts of equal hashes stay in order
    string, part = string[order], part[order]
    start = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
    end = np.append(start[1:], len(string))
    several = np.repeat(part[start] != part[end - 1], end - start)
    return np.unique(part[several])


def _sorted_shards(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(name, segment's hash, least id, bits) from (name, segment, least, most), rows ordered by
    name: of the segments that remove anything."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.group_by(["name", "segment"], use_threads=False).aggregate([("least", "min"), ("most", "max")])
        table = table.rename_columns([c.removesuffix("_min").removesuffix("_max") for c in table.column_names])
        least = table.column("least").to_numpy()
        bits = np.zeros(len(least), np.int64)
        wanted = _met(table.column("segment"), length)
        if len(wanted):
            bits[wanted] = earlier(table.column("segment").take(wanted).to_pylist(), least[wanted], length)
        some = (bits != 0) | (table.column("most").to_numpy() > least)  # the others remove nothing
        found = table.append_column("bits", pa.array(bits)).filter(pa.array(some))
        if not found.num_rows:
            return
        offsets, data = text_buffers(found.column("segment").combine_chunks())
        hashed = segment_hashes(data, offsets[:-1], np.diff(offsets) - length + 1, length)
        found = found.append_column("hash", pa.array(hashed.view(np.int64))).select(["name", "hash", "least", "bits"])
        yield from (b for part in found.to_batches() for b in _cut(part))

    for batch in batches(rows):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= SHARD:
            table = pa.Table.from_batches(held)
            name = table.column("name").to_numpy()
            change = np.flatnonzero(name[1:] != name[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield from out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.column(1).nbytes for b in held)
    if held:
        yield from out(pa.Table.from_batches(held))


def removed_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tie, starts: array of (start, bits)) of the rows of docs (doc_id, tie, text) that lose
    anything: bit i stands for the string that starts at byte start + i."""
    spark = prepared(docs.sparkSession)
    rows = docs.where("doc_id is not null")
    names = written(
        rows.select("doc_id", "text").mapInArrow(lambda r: released(_names(r, length)), "name bigint, doc_id bigint, times bigint")
        .repartition("name").mapInArrow(lambda r: released(_shared(r)), "name bigint, times bigint"),
        "shared-names",
    )
    count, segments_in_all = names.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    rounds = 1
    while rounds < ROUNDS and count > rounds * SENT:
        rounds *= 2
    crowd = [row.name for row in names.where(f"times > {CROWD}").select("name").toLocalIterator()]  # of all segments one in CROWD at most
    crowd = np.sort(np.array(crowd, np.int64).view(np.uint64))
    marks = []
    for turn in range(rounds):
        own = names.where(F.col("name").bitwiseAND(F.lit(rounds - 1)) == turn)
        places, distinct = _candidates(rows, Wanted(bit_table(own, "name"), crowd, rounds, turn), length)
        judged = distinct.repartition("name").sortWithinPartitions("name").mapInArrow(
            lambda r: released(_sorted_shards(r, length)), "name bigint, hash bigint, least bigint, bits bigint"
        )
        with dealt(spark, segments_in_all // (4 * rounds)):  # these rows are small: four times as many a task as of records
            judged = written(judged, "judged-segments")
            found = places.join(judged, ["name", "hash"]).withColumn(
                "bits", F.expr("CASE WHEN doc_id > least THEN shiftleft(1L, strings) - 1 ELSE bits END")
            ).where("bits <> 0").select("doc_id", "tie", "start", "bits")
            marks.append(written(found, "marks"))  # the shuffled places of all segments go before the marks are gathered
    every = functools.reduce(DataFrame.unionByName, marks)
    return every.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "bits")).alias("starts"))  # a document's own


def covered(size: int, starts: np.ndarray, bits: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a document the strings at the marked starts cover."""
    at, bit = np.nonzero((bits[:, None] >> np.arange(STRINGS)) & 1)
    change = np.zeros(size + 1, np.int64)
    begin = starts[at] + bit
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length, -1)
    return np.cumsum(change[:-1]) > 0


def as_text(kept: Column) -> Column:
    """Kept bytes as text; what is left of a character that was cut in part goes too."""

    @F.arrow_udf("string")
    @giving_back
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if x is None else x.decode("utf-8", "ignore") for x in column.to_pylist()], pa.string())

    return decoded(kept)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Add ``kept`` (binary: the remaining bytes), ``removed`` (array of (start, end) in bytes),
    ``n_bytes`` and ``n_removed`` (long)."""
    spark = prepared(df.sparkSession)
    rows = df.withColumns({"__text": F.coalesce(F.col(text), F.lit("")), "__id": F.col(doc_id)})
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    keyed = rows.select(F.col("__id").alias("doc_id"), F.col("__tie").alias("tie"), F.col("__text").alias("text"))
    # rows that are equal in id and text lose the same; they are looked through once
    marks = only_result(spark, "removed-starts", lambda: removed_starts(keyed, length)).select(
        F.col("doc_id").alias("__mark_id"), F.col("tie").alias("__mark_tie"),
        F.col("starts.start").alias("__starts"), F.col("starts.bits").alias("__bits"),
    )

    @F.arrow_udf("struct<kept: binary, removed: array<struct<start: bigint, end: bigint>>, n_bytes: bigint, n_removed: bigint>")
    @giving_back
    def cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, bits in columns:
            offsets, data = text_buffers(texts)
            kept, removed, lost = [], [], []
            for i in range(len(texts)):
                own = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(own), bool)
                if starts[i].is_valid:
                    gone = covered(len(own), starts[i].values.to_numpy().astype(np.int64), bits[i].values.to_numpy(), length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                removed.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(own[~gone].tobytes())
                lost.append(int(gone.sum()))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(kept, pa.binary()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(np.diff(offsets)), pa.array(lost, pa.int64()),
                ],
                ["kept", "removed", "n_bytes", "n_removed"],
            )

    got = rows.join(marks, (F.col("__id") == F.col("__mark_id")) & (F.col("__tie") == F.col("__mark_tie")), "left").withColumn(
        "__cut", cut("__text", "__starts", "__bits")
    )
    outputs = ["kept", "removed", "n_bytes", "n_removed"]
    return got.select(*(c for c in df.columns if c not in outputs), *(F.col(f"__cut.{c}").alias(c) for c in outputs))
