"""Operator 4: benchmark passages in documents, by spaced seeds, in Spark expressions only.

Words are runs of letters and digits, lower-cased. A seed covers SPAN words and hashes those that its
mask keeps; the others may have been substituted. Seeds of every place of a benchmark item are joined
with seeds of every STRIDE-th place of a document. The two masks together are such that any passage
of WINDOW words shared with at most two substitutions, at whatever place, has a common seed (a test
goes through all cases).

Each hit is verified: document and item are laid side by side at the hit, and some WINDOW words
around it must be equal in a share of SHARE at least. An item with fewer words than WINDOW must be
there whole, with that share of equal words; such items have masks of their own, by their number of
words, that are joined at all places of a document and meet any substitutions which that share allows
(only numbers of words that the benchmark has are looked for). An item of fewer than SEEDED words must
be there word for word; one of fewer than ``least`` words is taken for no evidence (with ``least`` = 1 all are
looked for).

The benchmark's distinct seeds are sent to all tasks if there are at most SENT of them; if more, the
join shuffles. Either way only rows with hits go on, so the documents' words are read again just for
those. Items that share the words around a seed are verified once and reported each.

Null and empty texts match nothing. Rows that repeat an id are one document: a passage in any of them
is a passage of that id. A null id is an id like any other. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import only_result, written

MASKS = ((0, 1, 2, 6, 7), (0, 1, 3, 6, 7))
SPAN, STRIDE, WINDOW, SHARE, LEAST = 8, 2, 13, 0.8, 5
#: An item of fewer words must be there word for word.
SEEDED = SPAN + STRIDE - 1
#: Masks for items of fewer words than WINDOW: at all places of item and document, they meet all substitutions.
DENSE = {
    9: ((0, 1, 2, 4, 5),),
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    11: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
    12: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
}
#: Distinct benchmark seeds, or ids of documents that were hit, that are broadcast at most: 8 bytes each, some
#: 20 MB as a hash table. If there are more, they join.
SENT = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(column: str, places: str) -> str:
    """All seeds at the given places (an array of ints) as an array of structs, as SQL."""
    return "concat(" + ", ".join(
        f"transform({places}, i -> struct(i AS at, xxhash64({m}, {', '.join(f'{column}[i + {o}]' for o in mask)}) AS seed))"
        for m, mask in enumerate(MASKS)
    ) + ")"


def _runs(column: str, n: int, places: str) -> str:
    """All runs of n words, as SQL."""
    parts = ", ".join(f"{column}[i + {o}]" for o in range(n))
    return f"transform({places}, i -> struct(i AS at, xxhash64({-n}, {parts}) AS seed))"


def _dense(column: str, mask: tuple[int, ...]) -> str:
    """The seeds of one mask of DENSE at all places, as SQL."""
    places = f"CASE WHEN size({column}) <= {mask[-1]} THEN cast(array() as array<int>) ELSE sequence(0, size({column}) - {mask[-1] + 1}) END"
    parts = ", ".join(f"{column}[i + {o}]" for o in mask)
    return f"transform({places}, i -> struct(i AS at, xxhash64('{mask}', {parts}) AS seed))"


def _document_seeds(docs: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, at, seed): masks at every STRIDE-th place from the first, and what items of ``short`` words need."""
    last = f"(size(words) - {SPAN})"
    strided = f"CASE WHEN {last} < 0 THEN cast(array() as array<int>) ELSE sequence(0, {last}, {STRIDE}) END"
    every = [
        _runs("words", n, f"CASE WHEN size(words) < {n} THEN cast(array() as array<int>) ELSE sequence(0, size(words) - {n}) END")
        for n in short if n < SEEDED
    ] + [_dense("words", mask) for mask in sorted({mask for n in short for mask in DENSE.get(n, ())})]
    all_seeds = ", ".join([_seeds("words", "places"), *every])
    return (
        docs.select("doc_id", "words", F.expr(strided).alias("places"))
        .select("doc_id", F.expr(f"explode(concat({all_seeds}))").alias("s")).select("doc_id", "s.at", "s.seed")
    )


def _benchmark_seeds(items: DataFrame, least: int) -> DataFrame:
    """(seed, at, before, around, need, item_id): around are the item's words near the seed, of which
    ``before`` come before it; need words in a window of ``wide`` must be equal."""
    margin = WINDOW - SPAN
    strided = items.where(f"n >= {WINDOW}").withColumn("places", F.expr(f"sequence(0, n - {SPAN})")).select(
        "item_id", "words", "n", F.expr(f"explode({_seeds('words', 'places')})").alias("s")
    )
    for n, masks in DENSE.items():
        all_seeds = ", ".join(_dense("words", mask) for mask in masks)
        strided = strided.union(items.where(f"n = {n}").select("item_id", "words", "n", F.expr(f"explode(concat({all_seeds}))").alias("s")))
    long = strided.select(
        "item_id", "s.seed",
        F.expr(f"CASE WHEN n <= {WINDOW} THEN s.at ELSE least(s.at, {margin}) END").alias("before"),
        F.expr(f"CASE WHEN n <= {WINDOW} THEN words ELSE slice(words, greatest(s.at - {margin}, 0) + 1, {SPAN + margin} + least(s.at, {margin})) END").alias("around"),
        F.expr(f"least(n, {WINDOW})").alias("wide"),
    ).withColumn("need", F.ceil(F.col("wide") * SHARE).cast("int"))
    short = items.where(f"n between {least} and {SEEDED - 1}")
    runs = [
        short.where(f"n = {n}").select(
            "item_id", F.expr(f"{_runs('words', n, 'array(0)')}[0].seed").alias("seed"), F.lit(0).alias("before"),
            F.col("words").alias("around"), F.lit(n).alias("wide"), F.lit(n).alias("need"),
        )
        for n in range(max(1, least), SEEDED)
    ]
    for one in runs:
        long = long.unionByName(one)
    return long


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """(doc_id, item_id, n_equal, at) of every document and benchmark item that share a passage.

    n_equal: the most equal words in a window of the shared passage; at: where the first verified
    passage starts, counted in words.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).withColumn("n", F.size("words"))
    worded = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    short = [r.n for r in items.where(f"n between {max(1, least)} and {WINDOW - 1}").select("n").distinct().collect()]  # WINDOW at most
    seeds = _benchmark_seeds(items, least)
    # items that have the same words around a seed are verified once
    contexts = seeds.select("seed", "before", "around", "wide", "need").distinct()
    distinct = seeds.select("seed").distinct()
    if distinct.count() <= SENT:
        distinct = F.broadcast(distinct)
    hits = _document_seeds(worded, sorted(short)).join(distinct, "seed", "left_semi")
    found = hits.join(contexts, "seed").select("doc_id", "at", "before", "around", "wide", "need")
    # one row for each place where the two lie side by side
    found = written(found.select("doc_id", (F.col("at") - F.col("before")).alias("start"), "around", "wide", "need").distinct(), "side-by-side")
    equal = F.expr(
        "transform(sequence(0, size(around) - 1), j -> CASE WHEN start + j >= 0 AND get(words, start + j) = around[j] THEN 1 ELSE 0 END)"
    )
    best = F.expr(
        "array_max(transform(sequence(0, size(around) - wide), j -> aggregate(slice(equal, j + 1, wide), 0, (a, x) -> a + x)))"
    )
    # only what was hit is split into words again
    ids = found.select(F.col("doc_id").alias("id")).distinct()
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    hit = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    again = hit.select("doc_id", words(F.col("text")).alias("words"))
    held = (
        found.withColumnRenamed("doc_id", "id").join(again, F.col("id").eqNullSafe(F.col("doc_id")))
        .select("doc_id", "start", "around", "wide", "need", equal.alias("equal"))
        .withColumn("n_equal", best).where("n_equal >= need").select("doc_id", "start", "around", "n_equal")
    )
    names = seeds.select("item_id", "around").distinct()
    return (
        held.join(names, "around").groupBy("doc_id", "item_id")
        .agg(F.max("n_equal").cast("long").alias("n_equal"), F.min(F.greatest("start", F.lit(0))).cast("long").alias("at"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """The documents that share no passage with the benchmark, all columns kept."""
    found = only_result(docs.sparkSession, "leaking", lambda: matches(docs, benchmark, doc_id, **names).select("doc_id").distinct())
    leaking = found.select(F.col("doc_id").alias("__leaking"))
    return docs.join(leaking, F.col(doc_id).eqNullSafe(F.col("__leaking")), "left_anti")
