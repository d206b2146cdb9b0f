"""Operator 10: SimHash fingerprints and a self-join of binary tries within an error budget.

Fingerprint: a bit is 1 if it is set in more than half of the XXH64 hashes of a text's shingles,
repeats included. A text with fewer words than a shingle is one shingle of all its words; one
without words (null and empty texts too) has fingerprint zero and links like any other.

Join: equal fingerprints become one first. Fingerprints within 3 bits agree on one quarter of their
bits at least, so each is dealt to four groups, by the value of each quarter. In a group the rest of
the bits form a binary trie. Pairs of nodes are walked together from the root pair down; each step
adds the differing bit, and a pair of nodes beyond the budget is dropped with all below it. Large
groups are themselves dealt by node pairs: their fingerprints are split by more leading bits, and
only node pairs within the budget are made, so no group meets whole in one task.

All links count, but only a spanning set of them leaves a task. Components come from an iterative
join on that set. No link is lost, and no pair of equal texts is written out.

Repeated rows are linked (difference zero). Rows with a null id belong to the component of their
fingerprint; a component that has only null ids has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import giving_back, only_result, prepared, released, texts_of, words_of, written
from pressgauge.llm.components import components

QUARTER, QUARTERS = 16, 4
#: A group of more fingerprints than this is dealt by node pairs of its trie.
GROUP = 4096
#: Node pairs that are walked at a time, and rows of whole groups that are.
WIDTH, BLOCK = 1 << 17, 1 << 16

def fingerprint(words: list[bytes], size: int) -> int:
    """As a signed 64-bit number."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(b" ".join(s), 42) for s in shingles), np.uint64, n))


def majority(found: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, as a signed 64-bit number; zero if there are none."""
    n, ones = len(found), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded for very long texts
        part = found[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", size: int = 3, out: str = "fingerprint") -> DataFrame:
    """Add the SimHash of ``text`` as a long in column ``out``."""
    prepared(df.sparkSession)

    @F.arrow_udf("bigint")
    @giving_back
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([fingerprint(words_of(t), size) for t in texts_of(column)], pa.int64())

    return df.withColumn(out, of(F.col(text)))


def _rotated(prints: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """With the quarter's bits first."""
    shift = (QUARTER * quarter).astype(np.uint64)
    return np.where(shift == 0, prints, (prints << shift) | (prints >> ((np.uint64(64) - shift) & np.uint64(63))))


def walk(keys: np.ndarray, pairs: list[np.ndarray], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted, distinct ``keys`` that differ in ``budget`` bits at most.

    ``pairs`` are node pairs (lo, hi, lo2, hi2, errors) at ``depth``: a node is the range of keys
    that share its bits. At most WIDTH node pairs are opened at a time, depth first.
    """
    todo = [(depth, np.stack(pairs))] if len(pairs[0]) else []
    while todo:
        depth, nodes = todo.pop()
        if nodes.shape[1] > WIDTH:
            half = nodes.shape[1] // 2
            todo += [(depth, nodes[:, half:]), (depth, nodes[:, :half])]
            continue
        lo, hi, lo2, hi2, errors = nodes
        single = (hi - lo == 1) & (hi2 - lo2 == 1)
        if single.any():
            i, j = lo[single], lo2[single]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            nodes = nodes[:, ~single]
            lo, hi, lo2, hi2, errors = nodes
        if depth == 64 or not nodes.shape[1]:
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        cut, cut2 = _middle(keys, lo, hi, bit), _middle(keys, lo2, hi2, bit)
        same = (lo == lo2) & (hi == hi2)
        opened = np.concatenate(
            [
                np.stack([lo, cut, lo2, cut2, errors]),
                np.stack([cut, hi, cut2, hi2, errors]),
                np.stack([lo, cut, cut2, hi2, errors + 1]),
                np.stack([cut, hi, lo2, cut2, errors + 1])[:, ~same],  # the mirror of the one before
            ],
            axis=1,
        )
        alive = (opened[1] > opened[0]) & (opened[3] > opened[2]) & (opened[4] <= budget)
        alive &= (opened[0] != opened[2]) | (opened[1] - opened[0] > 1)  # a key with itself
        if alive.any():
            todo.append((depth + 1, opened[:, alive]))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first key of each range that has ``bit``: all ranges are halved at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


class Forest:
    """Union by least index; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.int64())])


def _joined(block: np.ndarray, budget: int) -> pa.RecordBatch:
    """Links within the groups of a block, and for each fingerprint the rows that it is linked to.

    Rows of block: quarter, group, print, weight, side. All pairs of a group are wanted where side
    is 0, else those of side 1 with side 2.
    """
    quarter, group, prints, weights, side = block
    prints = prints.view(np.uint64)
    keys = _rotated(prints, quarter)
    order = np.lexsort((keys, side, group, quarter))
    keys, prints, weights, side = keys[order], prints[order], weights[order], side[order]
    quarter, group = quarter[order], group[order]
    lo = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (quarter[1:] != quarter[:-1])])
    hi = np.r_[lo[1:], len(keys)]
    first_side = np.r_[0, np.cumsum(side == 1)]
    cut = lo + first_side[hi] - first_side[lo]
    whole = (side[lo] == 0) & (hi - lo > 1)
    across = (cut > lo) & (cut < hi)
    pairs = [
        np.concatenate([x[whole], y[across]])
        for x, y in ((lo, lo), (hi, cut), (lo, cut), (hi, hi), (np.zeros_like(lo), np.zeros_like(lo)))
    ]
    forest, near = Forest(len(keys)), np.zeros(len(keys), np.int64)
    for i, j in walk(keys, pairs, QUARTER, budget):
        forest.join(i, j)
        change, first = prints[i] ^ prints[j], np.ones(len(i), bool)
        for q in range(QUARTERS - 1):  # a pair counts in the first quarter in which it agrees
            mask = np.uint64(0xFFFF << (64 - QUARTER * (q + 1)))
            first &= (quarter[i] <= q) | ((change & mask) != 0)
        np.add.at(near, i[first], weights[j[first]])
        np.add.at(near, j[first], weights[i[first]])
    signed = prints.view(np.int64)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    some = near > 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([signed[links[:, 0]], signed[some]])),
            pa.array(np.concatenate([signed[links[:, 1]], signed[some]])),
            pa.array(np.concatenate([np.zeros(len(links), np.int64), near[some]])),
        ],
        schema=_OUT,
    )


def _groups(rows: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Walk the groups of a partition that is sorted by group; whole groups, BLOCK rows at a time."""
    held: list[np.ndarray] = []
    size, wanted = 0, BLOCK
    for batch in rows:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
        size += batch.num_rows
        if size < wanted:
            continue
        block = np.concatenate(held, axis=1)
        change = np.flatnonzero((block[:2, 1:] != block[:2, :-1]).any(axis=0))
        end = int(change[-1]) + 1 if len(change) else 0
        if end:
            yield _joined(block[:, :end], budget)
        held = [block[:, end:]]
        size = block.shape[1] - end
        wanted = max(BLOCK, 2 * size)  # a group over several blocks is put together a few times, not once a batch
    if size:
        yield _joined(np.concatenate(held, axis=1), budget)


def _dealt(distinct: DataFrame, budget: int) -> DataFrame:
    """(quarter, group, print, weight, side): what meets in one walk.

    A group of at most GROUP fingerprints is one walk. A larger one is cut by as many of its next
    bits as are needed (6 at most); a pair of its nodes is a walk of its own if the bits of the two
    differ in ``budget`` places at most.
    """
    key = "__print"
    at = lambda q: f"shiftrightunsigned({key}, {64 - QUARTER * (q + 1)}) & 65535"
    rest = lambda q: f"shiftrightunsigned(shiftleft({key}, {QUARTER * (q + 1) % 64}), 58)"
    quarters = distinct.withColumn("q", F.explode(F.array(*[
        F.struct(F.lit(q).cast("long").alias("q"), F.expr(at(q)).alias("v"), F.expr(rest(q)).alias("next")) for q in range(QUARTERS)
    ]))).select("__print", "__weight", "q.q", "q.v", "q.next")
    sizes = quarters.groupBy("q", "v").count().where(F.col("count") > GROUP).select(
        "q", "v", F.least(F.lit(6), F.ceil(F.log2(F.col("count") / GROUP))).cast("int").alias("bits")
    )
    cut = quarters.join(sizes, ["q", "v"], "left").withColumn("node", F.expr("shiftright(next, 6 - bits)"))
    other = F.expr(
        f"filter(transform(sequence(0L, shiftleft(1L, bits) - 1), m -> m ^ node), o -> bit_count(o ^ node) <= {budget})"
    )
    small = cut.where("bits is null").select(
        F.col("q"), F.col("v").alias("group"), "__print", "__weight", F.lit(0).cast("long").alias("side")
    )
    large = cut.where("bits is not null").withColumn("other", F.explode(other)).select(
        "q",
        F.expr("(1 + v) * 65536L + least(node, other) * 64 + greatest(node, other)").alias("group"),
        "__print", "__weight",
        F.expr("CASE WHEN node = other THEN 0L WHEN node < other THEN 1L ELSE 2L END").alias("side"),
    )
    return small.union(large)


def near_links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Rows (a, b, near) for distinct fingerprints (__print, __weight).

    near = 0: a link, of a set that connects what all links connect. Else a = b, and near is a part
    of the weights that a is linked to.
    """
    if budget >= QUARTERS:
        raise ValueError("the budget must be less than the number of quarters")
    dealt = _dealt(distinct, budget).repartition("q", "group").sortWithinPartitions("q", "group")
    return dealt.mapInArrow(lambda rows: released(_groups(rows, budget)), "a bigint, b bigint, near bigint")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, tie, fingerprint, component_id, n_links, component: all long) of every row.

    tie: a hash of the text; component: a number that all rows of a component have, null ids or not;
    n_links: other rows whose fingerprint differs in ``budget`` bits at most.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    prints = written(
        fingerprints(rows, "__text", size).select("doc_id", F.xxhash64("__text").alias("tie"), "fingerprint"), "fingerprints"
    )
    distinct = written(
        prints.groupBy(F.col("fingerprint").alias("__print")).agg(F.count("*").alias("__weight"), F.min("doc_id").alias("least")),
        "distinct-fingerprints",
    )
    links = written(near_links(distinct.select("__print", "__weight"), budget), "near-links")
    near = links.where("near > 0").groupBy(F.col("a").alias("__print")).agg(F.sum("near").alias("near"))
    roots = components(links.where("near = 0").select("a", "b")).withColumnRenamed("node", "__print")
    known = distinct.join(roots, "__print", "left").withColumn("root", F.coalesce("root", "__print"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").join(near, "__print", "left").select(
        F.col("__print").alias("fingerprint"), "component_id",
        (F.coalesce("near", F.lit(0)) + F.col("__weight") - 1).alias("n_links"), F.col("root").alias("component"),
    )
    return prints.join(named, "fingerprint").select("doc_id", "tie", "fingerprint", "component_id", "n_links", "component")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 3) -> DataFrame:
    """One row of each component: that with the least id, of equal ids that with the least text hash.

    A row that is repeated in id and text stays once, with the least values in its other columns.
    """
    found = only_result(df.sparkSession, "simhash-components", lambda: near_duplicates(df, doc_id, text, size, budget))
    return first_of_each(df, found, doc_id, text)


def first_of_each(df: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``df`` for each component of ``found`` (doc_id, tie, component)."""
    # ranked by component, cut to one row in each task before the shuffle
    order = Window.partitionBy("component").orderBy(F.asc_nulls_last("doc_id"), "tie")
    kept = found.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(
        F.col("doc_id").alias("__kept_id"), F.col("tie").alias("__kept_tie")
    )
    rows = df.withColumns({"__id": F.col(doc_id), "__tie": F.xxhash64(F.col(text))})
    same = Window.partitionBy("__id", "__tie").orderBy(*(F.col(c) for c in df.columns))
    return (
        rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__tie") == F.col("__kept_tie")), "left_semi")
        .withColumn("__place", F.row_number().over(same)).where("__place = 1").select(*df.columns)
    )
