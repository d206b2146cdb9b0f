"""Row numbers and running sums that no single task works out over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import written

#: Places that are summed together before sums of them are added up.
STEP = 1024


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's number in ``order``, from 0. Rows are dealt out by ranges of the order and
    numbered within; one row a range is added up. Written once, so that a lost task finds the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = sizes.select("__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn(
        name, F.col("__before") + F.col("__place") - 1
    ).drop("__range", "__place", "__before")


def sum_before(df: DataFrame, keys: list[str], place: str, value: str, name: str, step: int = STEP) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same keys at a smaller ``place`` (no two rows
    of the same keys have one place). Sums run over ``step`` places, and over the sums of such steps."""
    stepped = df.withColumn("__step", F.expr(f"{place} div {step}"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = stepped.groupBy(*keys, "__step").agg(F.sum(value).alias("__sum"))
    before = sums.select(*keys, "__step", F.coalesce(F.sum("__sum").over(earlier(keys, "__step")), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(value).over(earlier([*keys, "__step"], place)), F.lit(0))
    return stepped.withColumn("__within", within).join(before, [*keys, "__step"]).withColumn(
        name, F.col("__before") + F.col("__within")
    ).drop("__step", "__within", "__before")
