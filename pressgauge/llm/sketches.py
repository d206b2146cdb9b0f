"""Operator 6: bottom-k sketches of documents, in Spark expressions only.

A sketch is the sorted array of the K least distinct hashes of a text's shingles of SIZE words. A text
with fewer words than that has one shingle of all its words; a text without words (null, empty) has
an empty sketch. A sketch with fewer than K hashes holds them all, and what is estimated from such
sketches is exact. Sketches of parts merge into the sketch of the whole, pairwise (``merged``) or by
groups (``merge_groups``), so they can be kept and added to.

Two empty sketches resemble each other fully, an empty and another one not at all. Equal texts have
equal sketches.

``with_next`` puts the text that follows in the order of ids beside each. Rows with a null id come
first; rows with equal ids are ordered by their texts. The last row is followed by the first one, a
single row by itself. An empty table has no rows. No task orders all rows: ids are cut at quantiles,
each range is ordered for itself, and each range's first row is fetched by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import lower_ascii

K, SIZE = 128, 5
#: Rows in a range of ids that is ordered at a time, and ranges at most.
RANGE, RANGES = 2000, 10_000
#: 2 to the 64th: hashes are spread over so many numbers.
_ALL = "18446744073709551616D"


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lowered; a null text has none."""
    blank = "\t\n\x0b\f\r "
    bare = F.trim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(blank))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SIZE) -> DataFrame:
    """Add the sketch of ``text`` (array<bigint>, least first) as column ``out``."""
    parts = ", ".join(f"__words[i + {j}]" for j in range(size))
    sketch = F.expr(
        f"""CASE WHEN size(__words) = 0 THEN cast(array() as array<bigint>)
                 WHEN size(__words) < {size} THEN array(xxhash64(concat_ws(' ', __words)))
                 ELSE slice(sort_array(array_distinct(
                     transform(sequence(0, size(__words) - {size}), i -> xxhash64({parts})))), 1, {k}) END"""
    )
    return df.withColumn("__words", words(F.col(text))).withColumn(out, sketch).drop("__words")


def merged(a: str, b: str, k: int = K) -> str:
    """The sketch of two texts together, as SQL."""
    return f"slice(sort_array(array_union({a}, {b})), 1, {k})"


def resemblance(a: str, b: str, k: int = K) -> str:
    """Shared shingles among all shingles of two texts, as SQL."""
    whole = merged(a, b, k)
    return (
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE "
        f"size(array_intersect(array_intersect({whole}, {a}), {b})) / cast(size({whole}) as double) END"
    )


def distinct_shingles(a: str, k: int = K) -> str:
    """How many distinct shingles a text has, as SQL."""
    return (
        f"CASE WHEN size({a}) < {k} THEN cast(size({a}) as double) "
        f"ELSE {k - 1} / ((cast(element_at({a}, {k}) as double) + 9223372036854775808D) / {_ALL}) END"
    )


def containment(a: str, b: str, k: int = K) -> str:
    """The part of a's shingles that b has too, as SQL; 1 if a has none."""
    both = resemblance(a, b, k)
    sizes = f"(({distinct_shingles(a, k)}) + ({distinct_shingles(b, k)}))"
    return (
        f"CASE WHEN size({a}) = 0 THEN 1.0D ELSE "
        f"least(1.0D, ({both}) / (1 + ({both})) * {sizes} / ({distinct_shingles(a, k)})) END"
    )


def merge_groups(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group of rows: its K least hashes.

    Each task keeps the K least of a group before the shuffle, so a group may hold most rows.
    """
    hashes = df.select(*by, F.explode(sketch).alias("__hash")).distinct()
    place = Window.partitionBy(*by).orderBy("__hash")
    least = hashes.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))  # k values a group


def fingerprint(sketch: str) -> str:
    """A sketch as text, as SQL."""
    return f"array_join(transform({sketch}, h -> hex(h)), ',')"


def with_next(df: DataFrame, doc_id: str, text: str, carried: list[str], derived=lambda rows: rows) -> DataFrame:
    """Add ``next_<column>`` for ``text`` and each of ``carried``: the values of the row that follows.

    ``derived`` adds the columns to carry; it is applied once to all rows, and to a first row of each range."""
    columns = [text, *carried]
    rows = derived(df).withColumn("__tie", F.xxhash64(text))
    count = df.count()
    if not count:
        return rows.select(*derived(df).columns, *(F.col(c).alias(f"next_{c}") for c in columns))
    ranges = max(1, min(RANGES, count // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(doc_id, shares, 100 * ranges).alias("c")).first().c if shares else None
    bounds = sorted(set(cuts or []))  # RANGES at most
    at = _range_of(F.col(doc_id), bounds) if bounds else F.lit(0)
    rows = rows.withColumn("__range", F.when(F.col(doc_id).isNull(), 0).otherwise(at))
    order = [F.asc_nulls_first(doc_id), F.col("__tie"), F.col(text)]
    starts = (
        df.select(doc_id, F.xxhash64(text).alias("__tie")).withColumn("__range", F.when(F.col(doc_id).isNull(), 0).otherwise(at))
        .groupBy("__range").agg(F.min(F.struct(F.col(doc_id).isNotNull().alias("known"), F.col(doc_id).alias("id"), F.col("__tie").alias("tie"))).alias("first"))
        .orderBy("__range").collect()  # a row for each range
    )
    spark = df.sparkSession
    follows = [(s["__range"], t["first"]["id"], t["first"]["tie"]) for s, t in zip(starts, starts[1:] + starts[:1])]
    wanted = spark.createDataFrame(follows, "__range int, __id bigint, __first bigint")
    first = derived(
        df.withColumn("__tie", F.xxhash64(text)).join(F.broadcast(wanted.select("__id", "__first").distinct()),  # a row for each range
                  F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__first")))
        .groupBy("__id", "__first").agg(F.first(text).alias(text))
    ).select("__id", "__first", *(F.col(c).alias(f"__first_{c}") for c in columns))
    heads = (
        wanted.alias("w").join(first.alias("f"), F.expr("w.__id <=> f.__id AND w.__first = f.__first"))
        .select("w.__range", *(f"f.__first_{c}" for c in columns))
    )
    window = Window.partitionBy("__range").orderBy(*order)
    led = rows.withColumn("__next", F.lead(F.struct(*columns)).over(window))
    got = led.join(heads, "__range", "left")
    return got.select(
        *derived(df).columns,
        *(F.when(F.col("__next").isNotNull(), F.col(f"__next.{c}")).otherwise(F.col(f"__first_{c}")).alias(f"next_{c}") for c in columns),
    )


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below the value, looked up in two steps."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda listed: F.size(F.filter(listed, lambda b: b <= value))
    group = below(F.array(*(F.lit(g[0]) for g in groups)))
    within = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(within))
