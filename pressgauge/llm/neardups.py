"""The pipeline's near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity of
NEAR or more, and what such links connect.

Texts with one set of shingles are one node. Candidates come from the SimHash join of operator 10 on
fingerprints of these shingles, and, as 64 bits at a budget of 3 see few moderate edits, from shared
shingles: two sets that are NEAR have a common shingle among the first n - ceil(NEAR n) + 1 of each,
in any order that holds for all sets. Shingles that are frequent in a sample of the texts come last in
that order, so that common lines and passages gather few texts; which ones they are changes the work,
not the result. Every candidate is decided by its two whole sets (of 64-bit hashes), so no pair is lost
and none is linked that isn't NEAR; but first by small pictures of the sets, which show of most pairs that
they can't be.

Only a first part of the candidates is made at once: each text of a shingle with the one before it, and with the one
that shares most with others.
What these connect needs no more links, so after that only pairs of different components are made. A
shingle's largest component meets the other ones but not itself. Small pictures of the sets meet in that join, so
that of a group of texts that share shingles without being NEAR hardly a pair leaves it; all of its pairs in
different components are compared there, 64 bytes with 64 bytes.

A text with fewer words than a shingle has one shingle of all its words; texts without words (null and
empty ones) are equal to each other. Rows with a null id belong to the component of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import dropped, giving_back, only_result, prepared, texts_of, words_of, written
from pressgauge.llm.components import components
from pressgauge.llm.simhash import first_of_each, majority, near_links

SIZE = 5
#: NEAR as a fraction of whole numbers: shared / all >= 4 / 5.
PART, WHOLE = 4, 5
#: Bits of the picture of a set that its elements are drawn into, by which most pairs are told apart.
BITS = 2048
#: Bits of the small picture that goes with each shingle of a text into the join that makes the last pairs.
SMALL = 512
#: Of one in SAMPLE texts, the COMMON most frequent shingles that OFTEN or more of them have come last.
SAMPLE, OFTEN, COMMON = 16, 4, 50_000


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of all shingles in order, repeats included."""
    if len(words) < SIZE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    hashed = xxhash.xxh64_intdigest
    each = np.fromiter((hashed(w, 42) for w in words), np.uint64, len(words))
    n = len(words) - SIZE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SIZE):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def drawn(distinct: np.ndarray) -> np.ndarray:
    """A set's picture: the bits that its elements point to."""
    at = (distinct & np.uint64(BITS - 1)).astype(np.int64)
    out = np.zeros(BITS // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def leading(distinct: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, of which a set that is NEAR has one at least among its own first."""
    n = len(distinct)
    place = np.searchsorted(common, distinct)
    late = common[np.minimum(place, len(common) - 1)] == distinct if len(common) else np.zeros(n, bool)
    ordered = np.concatenate([distinct[~late], distinct[late]])
    return ordered[: n - (PART * n + WHOLE - 1) // WHOLE + 1] if n else ordered


def _sets(df: DataFrame, text: str) -> DataFrame:
    """(tie, set) of the distinct texts: shingles without repeats."""

    @F.arrow_udf("array<bigint>")
    @giving_back
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([np.unique(shingles(words_of(t))).view(np.int64) for t in texts_of(column)], pa.list_(pa.int64()))

    return df.dropDuplicates(["tie"]).select("tie", of(F.col(text)).alias("set"))


def _common(rows: DataFrame) -> np.ndarray:
    """Sorted; COMMON at most."""
    sample = _sets(rows.where(F.pmod(F.xxhash64("tie"), F.lit(SAMPLE)) == 0), "__text")
    counts = sample.select(F.explode("set").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= OFTEN)
    most = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    return np.sort(np.array([r.shingle for r in most], np.int64).view(np.uint64))


def _signed(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, tie, node, n, fingerprint, drawn, leading) of every row; node: a hash of the set."""
    shared = prepared(rows.sparkSession).sparkContext.broadcast(common)  # a bounded size

    @F.arrow_udf("struct<node: bigint, n: bigint, fingerprint: bigint, drawn: array<bigint>, leading: array<bigint>>")
    @giving_back
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        late = shared.value
        for column in columns:
            node, n, prints, pictures, first = [], [], [], [], []
            for t in texts_of(column):
                found = shingles(words_of(t))
                distinct = np.unique(found)
                node.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                n.append(len(distinct))
                prints.append(majority(found))
                pictures.append(drawn(distinct))
                first.append(leading(distinct, late).view(np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(pictures, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                ["node", "n", "fingerprint", "drawn", "leading"],
            )

    return rows.select("doc_id", "tie", of(F.col("__text")).alias("s")).select("doc_id", "tie", "s.*")


def _folded() -> Column:
    """A set's picture laid on itself to SMALL bits, as a struct of longs."""
    step = SMALL // 64
    return F.struct(*(F.expr(" | ".join(f"drawn[{i}]" for i in range(k, BITS // 64, step))).alias(f"p{k}") for k in range(step)))


def _told_apart(x: str, y: str) -> str:
    """Whether the small pictures show that two sets aren't NEAR, as SQL without lambdas: it is asked of every pair."""
    lacks = lambda a, b: " + ".join(f"bit_count({a}.small.p{k} & ~{b}.small.p{k})" for k in range(SMALL // 64))
    most = f"least({x}.n - ({lacks(x, y)}), {y}.n - ({lacks(y, x)}))"
    return f"{PART + WHOLE} * {most} < {PART} * ({x}.n + {y}.n)"


def _missing(x: str, y: str) -> str:
    """So many elements of x's set, at least, that are not in y's: bits of its picture that y's has not, as SQL."""
    return f"aggregate(zip_with(drawn_{x}, drawn_{y}, (p, q) -> bit_count(p & ~q)), 0, (s, p) -> s + p)"


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the node pairs (a, b) that are NEAR. Most others are told by the sets' pictures, which bound what two
    sets share; the rest is decided by the whole sets."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pictures = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("drawn").alias(f"drawn_{x}"))
    most = F.expr(f"least(n_a - {_missing('a', 'b')}, n_b - {_missing('b', 'a')})")
    bounded = pairs.join(pictures("a"), "a").join(pictures("b"), "b").withColumn("most", most)
    pairs = written(bounded.where(f"{WHOLE} * most >= {PART} * (n_a + n_b - most)").select("a", "b"), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ties = nodes.join(wanted, "node").select("node", "tie", "n")
    sets = written(_sets(rows.join(ties, "tie", "left_semi"), "__text").join(ties, "tie").select("node", "n", "set"), "near-sets")
    of = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("same", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(f"{WHOLE} * same >= {PART} * (n_a + n_b - same)").select("a", "b")


def _possible(x: str, y: str) -> str:
    """Whether two sets may be NEAR by their sizes and by where they have their first common shingle, as SQL."""
    sizes = f"{WHOLE} * least({x}.n, {y}.n) >= {PART} * greatest({x}.n, {y}.n)"
    return f"{sizes} AND {PART + WHOLE} * least({x}.n - {x}.place, {y}.n - {y}.place) >= {PART} * ({x}.n + {y}.n)"


def near_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tie, component) of every row; tie: a hash of the text; component: a number that all rows
    of a component have."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), F.xxhash64(text).alias("tie"))
    signed = written(_signed(rows, _common(rows)), "signed")
    nodes = written(signed.select("node", "tie", "n", "fingerprint", "drawn", "leading").dropDuplicates(["node"]), "nodes")
    node_of = written(signed.select("doc_id", "tie", "node"), "row-nodes")
    dropped(signed)

    # by fingerprint: equal ones with the least node of them, and the least nodes of near ones
    prints = nodes.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("__weight"))
    prints = written(prints, "node-fingerprints")
    links = near_links(prints.select(F.col("fingerprint").alias("__print"), "__weight")).where("near = 0")
    of = lambda x: prints.select(F.col("fingerprint").alias(x), F.col("first").alias(f"first_{x}"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = nodes.select("node", "fingerprint").join(prints, "fingerprint").select(F.col("node").alias("a"), F.col("first").alias("b"))

    # by shared shingles: each text with the one before it
    of_shingle = Window.partitionBy("shingle")
    postings = nodes.select("node", "n", F.posexplode("leading").alias("place", "shingle"))
    before = F.lag(F.struct("node", "n", "place")).over(of_shingle.orderBy("n", "node"))
    shared = written(
        postings.withColumn("before", before).withColumn("gathered", F.count("*").over(of_shingle)).where("gathered > 1"),
        "shared-shingles",
    )
    row = shared.select(F.struct("node", "n", "place").alias("x"), F.col("before").alias("y")).where("y is not null")
    next_to = row.where(_possible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # and with the most central text of each shingle: what many texts are edits of has most in common with all
    central = shared.groupBy("node").agg(F.sum("gathered").alias("central"))
    hubs = shared.join(central, "node").groupBy("shingle").agg(F.max_by(F.struct("node", "n", "place"), F.struct("central", "node")).alias("y"))
    spokes = shared.select("shingle", F.struct("node", "n", "place").alias("x")).join(hubs, "shingle").where(_possible("x", "y"))
    to_hub = spokes.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    spark = df.sparkSession
    first = only_result(spark, "near-first", lambda: _verified(near.union(equal).union(next_to).union(to_hub), nodes, rows))

    # then all pairs of different components
    roots = only_result(spark, "near-roots", lambda: components(first))
    told = nodes.select("node", _folded().alias("small")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = shared.select("shingle", "node", "n", "place").join(told, "node")
    sizes = named.groupBy("shingle", "root").count()
    largest = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("roots"))
    open_ = written(named.join(largest.where("roots > 1"), "shingle").drop("roots"), "open-shingles")
    dropped(shared)
    others = open_.where("root <> largest").alias("x").join(
        open_.alias("y"), F.expr(f"x.shingle = y.shingle AND x.root <> y.root AND (y.root = y.largest OR x.node < y.node) AND {_possible('x', 'y')} AND NOT ({_told_apart('x', 'y')})")
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest = only_result(spark, "near-rest", lambda: _verified(others, nodes, rows))
    roots = components(first.union(rest))
    return node_of.join(roots, "node", "left").select(
        "doc_id", "tie", F.coalesce("root", "node").alias("component")
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, as ``simhash.one_of_each``."""
    found = only_result(df.sparkSession, "near-sets", lambda: near_sets(df, doc_id, text))
    return first_of_each(df, found, doc_id, text)
