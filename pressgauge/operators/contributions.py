"""Which sources made a share: the decomposition of a published value.

The parts come from the same terms the share was summed from, and add up to it exactly on the
ten-thousandth grid: each source gets the floor of its part, and the units left over go one
each to the sources with the largest remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import numeric
from pressgauge.operators import shares
from pressgauge.operators.picks import BUCKET_KEYS


def apportion(terms: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    """Largest-remainder split of each subject's units over its sources; ties by source id.

    One subject's window holds one pre-aggregated row per source, never article rows.
    """
    value = [*keys, "subject"]
    scaled = F.col("term") * numeric.GRID
    parts = terms.join(folded.select(*value, "raw_count", "units"), value).select(
        *value,
        "source_id",
        "n",
        "raw_count",
        "units",
        F.expr(f"(term * {numeric.GRID}) div den").alias("floor_units"),
        (scaled % F.col("den")).alias("remainder"),
    )
    whole = W.partitionBy(*value)
    turn = F.row_number().over(whole.orderBy(F.col("remainder").desc(), F.col("source_id")))
    left = F.col("units") - F.sum("floor_units").over(whole)
    return parts.withColumn("left", left).withColumn("turn", turn).select(
        *value,
        "source_id",
        "n",
        "raw_count",
        (F.col("floor_units") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).alias(
            "part_units"
        ),
    )


def from_terms(terms: DataFrame, folded: DataFrame) -> DataFrame:
    parts = apportion(terms, folded, BUCKET_KEYS)
    return parts.withColumn("ratio", F.col("n") / F.col("raw_count")).select(
        "subject",
        *BUCKET_KEYS,
        "source_id",
        F.col("n").alias("raw_count"),
        numeric.round4(F.col("ratio")).alias("raw_share"),
        numeric.from_units(F.col("part_units")).alias("normalized_contribution"),
    )


def source_contributions(picks: DataFrame) -> DataFrame:
    terms = shares.share_terms(shares.mentions(picks, BUCKET_KEYS), BUCKET_KEYS)
    return from_terms(terms, shares.fold_terms(terms, BUCKET_KEYS))
