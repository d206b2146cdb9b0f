"""Hard negatives: for each anchor and each of its positives, rows of other labels that score almost as high.

Exact search by length buckets and coordinate pruning:

* Rows are numbered by falling length and cut into buckets of ``BUCKET`` rows; anchors into blocks of
  ``BLOCK``. A pair of them is looked at only if the longest row of the bucket can reach what an anchor of
  the block still needs.
* In a bucket each coordinate of the unit vectors has a sorted list. An anchor of direction q needs a cosine
  of t or more; with q's coordinate f the cosine of an angle A, a row's coordinate must lie between the
  cosines of A + arccos t and A - arccos t. These ranges of the FOCUS largest coordinates of q, found in the
  lists, are intersected; what is left is scored exactly.
* What an anchor needs at least comes from a first look at ``SAMPLE`` rows, whose best scores are lower
  bounds. The sample changes the work, not the result.

First the positives are searched so, then, within the range of scores that they set, the negatives.

Components are floor(256 x); a score is their inner product, exact: in doubles while no sum can pass 2^53,
in integers of any size beyond that (and then cut to the range of a long). Rows with a null label, a null
vector, or a null or non-finite component take no part. Missing components of a shorter vector are 0. A
vector without components, or of zeros only, scores 0 with all. Rows with a null id are no anchors, come
last among equal scores and can be positives and negatives. An anchor's other rows are all rows but
itself: repeated rows and rows of the same id count each, and repeated anchors are anchors of their own.
Anchors without other rows of their label, and positives without a row in their range, give no rows; nor
does an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import batches, prepared, written
from pressgauge.llm.ranks import numbered

BUCKET, BLOCK, SAMPLE, FOCUS = 4096, 256, 2048, 4
#: Blocks of anchors that meet a bucket in one task, at most.
TOGETHER = 64
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Slack of a comparison of rounded cosines.
SLACK = 1e-9
_LONG = 2**63 - 1
_ROWS = "no bigint, vec_id bigint, label bigint, vector array<double>"


def usable(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, vector, length) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
    # rint keeps doubles: floor would make longs and cut what is beyond them
    scaled = F.transform("x", lambda v: F.rint(v * SCALE) - F.when(F.rint(v * SCALE) > v * SCALE, 1.0).otherwise(0.0))
    rows = rows.select("vec_id", "label", scaled.alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("length", length)


def _packed(rows: DataFrame, by: str, extra: str = "") -> DataFrame:
    """One row for each ``by``: its rows (a bounded number) as arrays side by side, in the order of no."""
    names = [part.split()[0] for part in f"{_ROWS}{extra}".split(", ")]
    put = F.sort_array(F.collect_list(F.struct(*names)))
    return rows.groupBy(by).agg(put.alias("rows"), F.max("length").alias("longest"), F.min("length").alias("shortest"))


class Side:
    """Rows of a bucket, or anchors of a block, as arrays."""

    def __init__(self, rows: pa.StructScalar) -> None:
        rows = rows.values
        field = lambda name: rows.field(name)
        self.no = field("no").to_numpy(zero_copy_only=False)
        self.ids = field("vec_id")
        self.known = ~np.asarray(self.ids.is_null())
        self.order = self.ids.fill_null(_LONG).to_numpy(zero_copy_only=False)
        self.label = field("label").to_numpy(zero_copy_only=False)
        vectors = field("vector")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        self.vectors = np.zeros((len(sizes), int(sizes.max(initial=0))))
        self.vectors[np.arange(self.vectors.shape[1]) < sizes[:, None]] = flat
        self.length = np.sqrt((self.vectors**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unit = np.where(self.length[:, None] > 0, self.vectors / self.length[:, None], 0.0)
        self.most = np.abs(self.vectors).max(initial=0.0)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def listed(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """A coordinate's sorted list: which rows, and their values."""
        if f not in self._lists:
            rows = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = rows, self.unit[rows, f]
        return self._lists[f]


def feasible(q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value that a unit vector's coordinate can have if its cosine with a unit vector
    whose coordinate is q is t or more."""
    if t <= -1:
        return np.full(len(q), -1.0), np.full(len(q), 1.0)
    spread, angle = np.arccos(min(t, 1.0)), np.arccos(np.clip(q, -1, 1))
    return np.cos(np.minimum(np.pi, angle + spread)), np.cos(np.maximum(0.0, angle - spread))


def candidates(anchors: Side, i: int, bucket: Side, least: float, focus: int = FOCUS) -> np.ndarray:
    """Rows of the bucket that may score ``least`` or more with anchor i: none that does is left out."""
    q, size = anchors.length[i], min(anchors.unit.shape[1], bucket.unit.shape[1])
    far = bucket.length.max(initial=0.0) if least > 0 else bucket.length.min(initial=np.inf)
    if not q or not far or not size or not np.isfinite(least):
        return np.arange(len(bucket.no)) if least <= 0 else np.zeros(0, np.int64)
    t = least / (q * far)
    if t > 1 + SLACK:
        return np.zeros(0, np.int64)
    t -= SLACK
    if t <= -1:
        return np.arange(len(bucket.no))
    own = anchors.unit[i, :size]
    chosen = np.argsort(-np.abs(own), kind="stable")[:focus]
    low, high = feasible(own[chosen], t)
    low, high = low - SLACK, high + SLACK
    ranges = []
    for k, f in enumerate(chosen.tolist()):
        rows, values = bucket.listed(f)
        ranges.append((np.searchsorted(values, low[k]), np.searchsorted(values, high[k], side="right"), k, f, rows))
    a, b, first, _, rows = min(ranges, key=lambda r: r[1] - r[0])
    left = rows[a:b]
    for _, _, k, f, _ in ranges:
        if k != first:
            values = bucket.unit[left, f]
            left = left[(values >= low[k]) & (values <= high[k])]
    return left


def scores(anchors: Side, i: int, bucket: Side, rows: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    size = min(anchors.vectors.shape[1], bucket.vectors.shape[1])
    if anchors.most * bucket.most * max(size, 1) < 2**53:
        return (bucket.vectors[rows, :size] @ anchors.vectors[i, :size]).astype(np.int64)
    q = [int(x) for x in anchors.vectors[i, :size].tolist()]
    exact = [sum(a * int(b) for a, b in zip(q, p)) for p in bucket.vectors[rows, :size].tolist()]
    return np.array([max(-_LONG, min(_LONG, s)) for s in exact], np.int64)


def _best(found: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: higher scores first, then smaller ids."""
    return np.lexsort((order, -found))[:n] if len(found) else np.zeros(0, np.int64)


class _Last:
    """The side that was unpacked last; pairs come sorted by bucket."""

    def __init__(self) -> None:
        self.key, self.side = None, None

    def get(self, key: int, rows) -> Side:
        if key != self.key:
            self.key, self.side = key, Side(rows)
        return self.side


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_POSITIVE = pa.schema([(n, pa.int64()) for n in ("anchor_no", "other_no", "vec_id", "score")])
_NEGATIVE = pa.schema([(n, pa.int64()) for n in ("anchor_no", "positive", "other_no", "vec_id", "score")])


def _ids(side: Side, rows: np.ndarray) -> list:
    return [int(side.order[r]) if side.known[r] else None for r in rows.tolist()]


def _search_positives(count: int):
    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _Last()
        for batch in batches(pairs):
            for row in range(batch.num_rows):
                bucket = last.get(batch["bucket"][row].as_py(), batch["bucket_rows"][row])
                anchors = Side(batch["rows"][row])
                needed = batch["rows"][row].values.field("needed").to_numpy(zero_copy_only=False)
                out: dict[str, list] = {n: [] for n in _POSITIVE.names}
                for i in range(len(anchors.no)):
                    rows = candidates(anchors, i, bucket, float(needed[i]))
                    rows = rows[(bucket.label[rows] == anchors.label[i]) & (bucket.no[rows] != anchors.no[i])]
                    found = scores(anchors, i, bucket, rows)
                    best = _best(found, bucket.order[rows], count)
                    best = best[found[best] >= needed[i]]
                    out["anchor_no"] += [int(anchors.no[i])] * len(best)
                    out["other_no"] += bucket.no[rows[best]].tolist()
                    out["vec_id"] += _ids(bucket, rows[best])
                    out["score"] += found[best].tolist()
                yield _batch(out, _POSITIVE)

    return run


def _search_negatives(count: int):
    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _Last()
        for batch in batches(pairs):
            for row in range(batch.num_rows):
                bucket = last.get(batch["bucket"][row].as_py(), batch["bucket_rows"][row])
                anchors = Side(batch["rows"][row])
                listed = batch["rows"][row].values.field("ranges")
                out: dict[str, list] = {n: [] for n in _NEGATIVE.names}
                for i in range(len(anchors.no)):
                    ranges = listed[i].as_py()
                    rows = candidates(anchors, i, bucket, float(min(r["low"] for r in ranges)))
                    rows = rows[bucket.label[rows] != anchors.label[i]]
                    found = scores(anchors, i, bucket, rows)
                    for r in ranges:
                        fit = np.flatnonzero((found >= r["low"]) & (found <= r["high"]))
                        best = fit[_best(found[fit], bucket.order[rows[fit]], count)]
                        out["anchor_no"] += [int(anchors.no[i])] * len(best)
                        out["positive"] += [r["place"]] * len(best)
                        out["other_no"] += bucket.no[rows[best]].tolist()
                        out["vec_id"] += _ids(bucket, rows[best])
                        out["score"] += found[best].tolist()
                yield _batch(out, _NEGATIVE)

    return run


def _search(blocks: DataFrame, buckets: DataFrame, run, schema: pa.Schema) -> DataFrame:
    """Blocks (block, least, rows) against the buckets that are long enough to matter to an anchor of theirs.
    A task has one bucket and TOGETHER blocks at most."""
    numbers = buckets.agg(F.min("bucket"), F.max("bucket")).first()
    if numbers[0] is None:
        return blocks.sparkSession.createDataFrame([], ", ".join(f"{n} bigint" for n in schema.names))
    each = F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[1]))).alias("bucket")
    turns = max(1, -(-blocks.count() // TOGETHER))
    pairs = blocks.select("block", "least", each).join(buckets.select("bucket", "longest"), "bucket")
    pairs = pairs.where("longest * (1 + 1e-9) >= least").select("block", "bucket", F.pmod("block", F.lit(turns)).alias("turn"))
    sent = pairs.join(blocks.select("block", "rows"), "block")
    dealt = buckets.select("bucket", F.col("rows").alias("bucket_rows"), F.explode(F.expr(f"sequence(0L, {turns - 1}L)")).alias("turn"))
    both = sent.join(dealt, ["bucket", "turn"]).select("bucket", "bucket_rows", "rows")
    return both.sortWithinPartitions("bucket").mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names))


def _top(found: DataFrame, keys: list[str], count: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other_no")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= count)


def hard_negatives(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor: str | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchor``: a condition on
    vec_id and label, as SQL."""
    prepared(df.sparkSession)
    rows = usable(df, vec_id, vector, F.col(label) if isinstance(label, str) else label)
    rows = numbered(rows, [F.desc("length"), F.asc_nulls_last("vec_id"), F.col("label"), F.col("vector")], "no")
    rows = written(rows.withColumn("bucket", F.expr(f"no div {bucket}")), "vectors")
    buckets = written(_packed(rows, "bucket"), "buckets")
    anchors = numbered(rows.where(anchor or "vec_id % 50 = 0").drop("bucket"), [F.col("no")], "place")
    anchors = written(anchors.withColumn("block", F.expr(f"place div {block}")).drop("place"), "anchors")

    # a first look at a few rows: what an anchor needs at least
    sample = rows.orderBy(F.xxhash64("no"), "no").limit(SAMPLE).withColumn("bucket", F.lit(-1).cast("long"))
    sample = written(_packed(sample, "bucket"), "sample")
    everything = lambda blocks: blocks.withColumn("least", F.lit(float("-inf")))
    free = F.lit(-_LONG).cast("long")
    blocks = written(everything(_packed(anchors.withColumn("needed", free), "block", ", needed bigint")), "anchor-blocks")
    first = _search(blocks, sample, _search_positives(positives), _POSITIVE)
    seen = _top(first, ["anchor_no"], positives, "place").groupBy("anchor_no").agg(F.min("score").alias("needed"), F.count("*").alias("got"))
    seen = seen.where(F.col("got") == positives).select(F.col("anchor_no").alias("no"), "needed")
    known = written(anchors.join(seen, "no", "left").withColumn("needed", F.coalesce("needed", free)), "anchors-known")

    # an anchor needs rows of this length at least; one that needs no positive score needs none
    reach = lambda needed: F.when(needed > 0, needed / F.col("length")).otherwise(F.lit(float("-inf")))
    least = known.groupBy("block").agg(F.min(reach(F.col("needed"))).alias("least"))
    blocks = written(_packed(known, "block", ", needed bigint").join(least, "block"), "anchor-blocks")
    found = written(_search(blocks, buckets, _search_positives(positives), _POSITIVE), "near-same")
    best = written(_top(found, ["anchor_no"], positives, "place").select(
        "anchor_no", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ), "positives")

    # scores of negatives: whole numbers from ceil(low p / 100) to floor(high p / 100)
    wide = F.col("positive_score").cast("decimal(25,0)")
    part = lambda hundredths, up: ((wide * hundredths + (99 if up else 0) - F.pmod(wide * hundredths + (99 if up else 0), F.lit(100))) / 100).cast("long")
    ranged = best.withColumns({"low": part(low, True), "high": part(high, False)}).where("low <= high")
    limits = ranged.groupBy("anchor_no").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("ranges"))
    asking = written(anchors.join(limits.withColumnRenamed("anchor_no", "no"), "no"), "asking")
    kept = ", ranges array<struct>"
    blocks = written(everything(_packed(asking, "block", kept)), "asking-blocks")
    first = _search(blocks, sample, _search_negatives(negatives), _NEGATIVE)
    seen = _top(first, ["anchor_no", "positive"], negatives, "rank").groupBy("anchor_no", F.col("positive").alias("place")).agg(
        F.min("score").alias("third"), F.count("*").alias("got")
    ).where(F.col("got") == negatives).drop("got")
    raised = ranged.join(seen, ["anchor_no", "place"], "left").withColumn("low", F.greatest("low", F.coalesce("third", "low")))
    limits = raised.groupBy("anchor_no").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("ranges"))
    asking = written(anchors.join(limits.withColumnRenamed("anchor_no", "no"), "no"), "asking-raised")
    least = asking.groupBy("block").agg(F.min(reach(F.array_min(F.transform("ranges", lambda r: r["low"])))).alias("least"))
    blocks = written(_packed(asking, "block", kept).join(least, "block"), "asking-blocks")
    hard = _top(_search(blocks, buckets, _search_negatives(negatives), _NEGATIVE), ["anchor_no", "positive"], negatives, "rank")
    named = best.withColumnRenamed("place", "positive").join(anchors.select(F.col("no").alias("anchor_no"), F.col("vec_id").alias("anchor_id")), "anchor_no")
    return hard.join(named, ["anchor_no", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
