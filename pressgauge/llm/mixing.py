"""Mixing sources to target weights: fixed-length blocks drawn by shard.

* A source's texts, in a pseudorandom order, are one line of words, cut into blocks of ``BLOCK`` words.
* The sources' targets share ``SHARE`` times all words by weight. A target stops at ``REPEATS`` times its
  source; what is over goes to the others by weight, until none is above.
* The mix is a line of slots, a shard for each ``SLOTS`` of them. Every slot draws its source, so a shard's
  counts by source are multinomial, with the targets as probabilities. Draws beyond a source's target go
  to the sources that were drawn too seldom.
* A source's slots are numbered over all shards. Each round through the source maps its numbers to blocks
  by another pseudorandom permutation (swap-or-not, ``ROUNDS`` rounds), so no block comes a second time
  before all have come once, and none more than ``REPEATS`` times. The last slot of a source takes only the
  words that are left to its target.
* Slots and pieces of texts meet in an equi-join by source and block.

Only DataFrame functions are used. Draws are hashes of numbers, so reruns agree.

A word is a run of characters other than ASCII white space. A null or empty text has no words and takes no
part (its row has 0 words taken). Null is a source, the last one. Rows with a null id, repeated rows and
repeated ids are texts of their own. A table without words has targets of 0 and an empty mix; an empty one
has no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import written
from pressgauge.llm.ranks import numbered, sum_before

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
BLOCK, SLOTS, ROUNDS = 256, 4096, 24
#: About so many words of a source are put in order together.
CHUNK = 65_536
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``texts``: (doc_id, size, tie, source_no, start) of every row; start: its place in the source's line,
    null for a text without words. ``sources``: (source, source_no, source_size, target, ...).
    ``slots``: (shard, slot, source_no, block, take) of the mix."""

    texts: DataFrame
    sources: DataFrame
    slots: DataFrame


def _level(sources: DataFrame, total: float) -> float:
    """Words a unit of weight, once nothing is above its limit."""
    weights = sources.agg(F.sum("weight")).first()[0]
    if not weights or not total:
        return 0.0
    level, capped = total / weights, 0
    while True:
        above = F.col("limit") < F.lit(level) * F.col("weight")
        got = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if got.capped == capped or not got.open:
            return level
        capped = got.capped
        level = (total - capped) / got.open


def permuted(number: Column, size: Column, keys: list[Column], inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0 .. size-1 that ``keys`` name puts ``number``; or, inverse, what
    it puts there. In each round a number and its mirror image by a random point change places or not, by a
    hash of the larger of them: so a round is its own inverse."""

    def swapped(x: Column, turn: Column) -> Column:
        point = F.pmod(F.xxhash64(*keys, turn), size)
        other = F.pmod(point - x, size)
        swap = F.xxhash64(*keys, turn, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    first, last = (rounds - 1, 0) if inverse else (0, rounds - 1)
    turns = F.sequence(F.lit(first), F.lit(last))
    return F.aggregate(turns, number.cast("long"), swapped)


def _sources(sized: DataFrame, weights: tuple, share: float, repeats: int, block: int, seed: int) -> DataFrame:
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = written(numbered(sums, [F.asc_nulls_last("source")], "source_no"), "sources")
    listed = F.array(*(F.lit(w) for w in weights))
    weighed = ordered.withColumn("weight", F.element_at(listed, (F.col("source_no") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * repeats)
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    target = F.least(F.col("limit").cast("double"), F.lit(_level(weighed, total)) * F.col("weight"))
    # blocks: of a source; turns: whole rounds through it; rest: words that are left to take after these
    placed = (
        weighed.withColumn("target", target)
        .withColumn("wanted", F.floor(F.col("target") + 0.5))
        .withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
        .withColumn("turns", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(0))
        .withColumn("rest", F.col("wanted") - F.col("turns") * F.col("source_size"))
        .withColumn("key", F.xxhash64(F.lit(seed), "source"))
    )
    at = permuted(F.col("blocks") - 1, F.col("blocks"), [F.col("key"), F.col("turns")], inverse=True)
    # the short block's place in the last round decides whether one more slot is needed
    placed = placed.withColumn("short_at", F.when(F.col("blocks") > 0, at)).withColumn("full", F.expr(f"(rest + {block - 1}) div {block}"))
    reached = F.col("full") * block - F.when(F.col("short_at") < F.col("full"), block - F.col("short")).otherwise(0)
    more = F.when(reached < F.col("rest"), 1).otherwise(0)
    return placed.withColumn("slots", F.when(F.col("blocks") > 0, F.col("turns") * F.col("blocks") + F.col("full") + more).otherwise(0))


def _texts(sized: DataFrame, sources: DataFrame, chunk: int) -> DataFrame:
    """Each text's place in its source's line of words."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    chunks = max(1, -(-total // chunk))
    known = sized.join(sources.select(F.col("source").alias("__source"), "source_no"), F.col("source").eqNullSafe(F.col("__source")))
    known = known.select("doc_id", "size", "tie", "source_no", F.xxhash64("doc_id", "tie").alias("deal"))
    full = known.where("size > 0").withColumn("chunk", F.pmod("deal", F.lit(chunks)))
    sums = written(full.groupBy("source_no", "chunk").agg(F.sum("size").alias("words")), "chunks")
    before = sum_before(sums, ["source_no"], "chunk", "words", "before").select("source_no", "chunk", "before")
    own = Window.partitionBy("source_no", "chunk").orderBy("deal", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, ["source_no", "chunk"])
    columns = ["doc_id", "size", "tie", "source_no"]
    return placed.select(*columns, (F.col("before") + F.col("within")).alias("start")).unionByName(
        known.where("size = 0").select(*columns, F.lit(None).cast("long").alias("start"))
    )


def _drawn(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source_no, number) of all slots: number counts the source's slots, from 0."""
    spark = sources.sparkSession
    chosen = sources.where("slots > 0").select("source_no", "slots")
    total, count = chosen.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    bounds = written(sum_before(chosen, [], "source_no", "slots", "low"), "source-bounds")
    if not total:
        empty = bounds.where("false")
        return empty.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), "source_no", F.lit(0).cast("long").alias("number"))
    # a draw is a number under total; equal cells of these numbers list the sources that own a part of them
    width = max(1, -(-total // (4 * count)))
    cells = bounds.select(
        "source_no", "low", (F.col("low") + F.col("slots")).alias("high"),
        F.explode(F.expr(f"sequence(low div {width}, (low + slots - 1) div {width})")).alias("cell"),
    )
    slots = spark.range(total).select(
        F.col("id").alias("slot"), F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "id"), F.lit(total)).alias("draw")
    ).withColumn("cell", F.expr(f"draw div {width}"))
    draws = slots.join(cells, "cell").where("draw >= low AND draw < high").select("shard", "slot", "source_no")
    draws = written(draws, "draws")

    # the multinomial counts of each shard, and what the shards before it have drawn
    counts = written(draws.groupBy("shard", "source_no").agg(F.count("*").alias("drawn")), "shard-counts")
    earlier = sum_before(counts, ["source_no"], "shard", "drawn", "earlier").select("shard", "source_no", "earlier")
    own = Window.partitionBy("shard", "source_no").orderBy("slot")
    told = draws.withColumn("place", F.row_number().over(own) - 1).join(earlier, ["shard", "source_no"])
    told = told.select("shard", "slot", "source_no", (F.col("earlier") + F.col("place")).alias("number"))
    told = written(told.join(bounds.select("source_no", "slots"), "source_no"), "numbered-draws")

    kept = told.where("number < slots").select("shard", "slot", "source_no", "number")
    # draws over a source's slots, in order, fill the slots of those that were drawn too seldom
    over = told.where("number >= slots").select("shard", "slot")
    sizes = written(over.groupBy("shard").agg(F.count("*").alias("over")), "shard-overs")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1
    before = sum_before(sizes, [], "shard", "over", "before").select("shard", "before")
    over = over.withColumn("place", place).join(before, "shard").select("shard", "slot", (F.col("before") + F.col("place")).alias("turn"))
    got = counts.groupBy("source_no").agg(F.sum("drawn").alias("drawn"))
    missing = bounds.join(got, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < slots")
    missing = written(missing.select("source_no", "drawn", (F.col("slots") - F.col("drawn")).alias("open")), "missing")
    fill = sum_before(missing, [], "source_no", "open", "first").select(
        "source_no", "drawn", "first", F.explode(F.expr("sequence(0L, open - 1)")).alias("i")
    ).select("source_no", (F.col("drawn") + F.col("i")).alias("number"), (F.col("first") + F.col("i")).alias("turn"))
    return kept.unionByName(over.join(fill, "turn").select("shard", "slot", "source_no", "number"))


def mix(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE,
    repeats: int = REPEATS, block: int = BLOCK, slots: int = SLOTS, chunk: int = CHUNK, seed: int = 11,
) -> Mix:
    """Plan the mix; ``spans`` says what each slot takes, ``mixed_texts`` writes it out."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"))
    sized = written(sized, "sized")
    sources = written(_sources(sized, weights, share, repeats, block, seed), "weighed")
    texts = written(_texts(sized, sources, chunk), "lined-texts")
    about = sources.select("source_no", "blocks", "short", "turns", "rest", "short_at", "key")
    told = _drawn(sources, slots, seed).join(about, "source_no").withColumn("turn", F.expr("number div blocks")).withColumn("at", F.expr("number % blocks"))
    put = permuted(F.col("at"), F.col("blocks"), [F.col("key"), F.col("turn")])
    done = F.col("at") * block - F.when(F.col("short_at") < F.col("at"), block - F.col("short")).otherwise(0)
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(block)
    take = F.when(F.col("turn") < F.col("turns"), whole).otherwise(F.least(whole, F.col("rest") - done))
    return Mix(texts, sources, told.withColumn("block", put).select("shard", "slot", "source_no", "block", take.cast("long").alias("take")))


def spans(mixed: Mix, block: int = BLOCK) -> DataFrame:
    """(shard, slot, place, source_no, start, doc_id, tie, first, words): which words of which text a slot takes,
    from the ``first``, and at which ``place`` of the slot they stand."""
    pieces = mixed.texts.where("size > 0").select(
        "doc_id", "tie", "source_no", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    return pieces.join(mixed.slots, ["source_no", "block"]).select(
        "shard", "slot", (low - F.col("block") * block).alias("place"), "source_no", "start", "doc_id", "tie",
        (low - F.col("start")).alias("first"), (high - low).alias("words"),
    ).where("words > 0")


def taken(mixed: Mix, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    words = spans(mixed, block).groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    full = mixed.texts.where("size > 0").join(words, ["source_no", "start"], "left")
    rows = full.select("doc_id", "size", "source_no", F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(
        mixed.texts.where("size = 0").select("doc_id", "size", "source_no", F.lit(0).cast("long").alias("taken"))
    )
    return rows.join(mixed.sources.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_texts(df: DataFrame, mixed: Mix, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(shard, slot, source_no, text): the words of every slot of the mix, blanks between them."""
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__tie"))
    each = rows.where("__text is not null").dropDuplicates(["__id", "__tie"])
    parts = spans(mixed, block).join(each, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    words = F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    put = F.sort_array(F.collect_list(F.struct("place", cut.alias("cut"))))  # at most ``block`` pieces
    return parts.groupBy("shard", "slot", "source_no").agg(put.alias("put")).select(
        "shard", "slot", "source_no", F.array_join("put.cut", " ").alias("text")
    )
