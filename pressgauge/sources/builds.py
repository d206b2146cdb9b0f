"""Datasets of a layer that readers see change together, partition by partition.

Rows of a commit lie in a folder of their own, ``<layer>/<dataset>/build=<stamp>/bucket_unit=../week=..``.
What readers see is the pointer: a small record dataset that names, for every partition of every dataset, the
build it is in. A commit writes the new partitions first and then a new pointer, so readers see all datasets
before it or all after it, and partitions that did not change stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import buckets
from pressgauge.schemas import DATASETS
from pressgauge.session import remove
from pressgauge.sources.lake import KEPT, Lake

PARTS = ("bucket_unit", "week")
#: The partition of rows that belong to no bucket.
WHOLE = ("window", "all")


def week_of(unit: Column, bucket: Column) -> Column:
    """The ISO week that a bucket lies in."""
    of_day = buckets.week_label(F.substring(bucket, 1, 10).try_cast("date"))
    return F.coalesce(F.when(unit == "week", bucket).otherwise(of_day), F.lit("none"))


def with_week(rows: DataFrame) -> DataFrame:
    if "bucket_unit" not in rows.columns:
        return rows.withColumns({"bucket_unit": F.lit(WHOLE[0]), "week": F.lit(WHOLE[1])})
    return rows.withColumn("week", week_of(F.col("bucket_unit"), F.col("time_bucket")))


class Builds:
    def __init__(self, lake: Lake, layer: str) -> None:
        self.lake, self.layer = lake, layer

    def pointer(self) -> list[tuple[str, str, str, str]]:
        """(dataset, bucket_unit, week, build) of every partition that readers see: a row for each."""
        return [tuple(r) for r in self.lake.read_records(self.layer, "pointer").collect()]

    def weeks(self, dataset: str) -> list[str]:
        return sorted({week for name, _, week, _ in self.pointer() if name == dataset})

    def read(self, dataset: str, weeks: list[str] | None = None, unit: str | None = None) -> DataFrame:
        """The dataset's rows with their ``week``; of some weeks or one unit only, if asked. Folders of other
        partitions are not even listed."""
        schema = DATASETS[self.layer, dataset]
        own = schema if "bucket_unit" in schema else f"{schema}, bucket_unit string"
        base = self.lake.folder(self.layer, dataset)
        wanted = [
            f"{base}/build={build}/bucket_unit={u}/week={week}"
            for name, u, week, build in self.pointer()
            if name == dataset and (weeks is None or week in weeks) and unit in (None, u)
        ]
        if not wanted:
            return self.lake.spark.createDataFrame([], f"{own}, week string")
        reader = self.lake.spark.read.schema(f"{own}, build string, week string").option("basePath", base)
        return reader.format(self.lake.fmt).load(wanted).drop("build")

    def rows(self, dataset: str) -> DataFrame:
        """What readers see: the dataset's own columns."""
        names = self.lake.spark.createDataFrame([], DATASETS[self.layer, dataset]).columns
        return self.read(dataset).select(*names)

    def commit(self, replaced: dict[str, tuple[DataFrame, list[str] | None]]) -> None:
        """For each dataset: rows (with ``week``) and the weeks that they replace, None for all."""
        stamp, kept = self.lake._stamp(), self.pointer()
        for dataset, (rows, weeks) in replaced.items():
            folder = f"{self.lake.folder(self.layer, dataset)}/build={stamp}"
            rows.hint("rebalance", *PARTS).write.format(self.lake.fmt).partitionBy(*PARTS).save(folder)
            kept = [r for r in kept if r[0] != dataset or (weeks is not None and r[2] not in weeks)]
            for unit in self._values(folder, "bucket_unit"):
                for week in self._values(f"{folder}/bucket_unit={unit}", "week"):
                    kept.append((dataset, unit, week, stamp))
        spark = self.lake.spark
        names = "dataset string, bucket_unit string, week string, build string"
        self.lake.write_records(self.layer, "pointer", spark.createDataFrame(sorted(kept), names).coalesce(1))
        self._clear({dataset for dataset, *_ in kept} | set(replaced))

    def _values(self, folder: str, name: str) -> list[str]:
        return [c.split("=", 1)[1] for c in self.lake._children(folder) if c.startswith(f"{name}=")]

    def _clear(self, datasets: set[str]) -> None:
        """Remove builds that none of the last KEPT pointers names."""
        base = self.lake.folder(self.layer, "pointer")
        stamps = sorted(n for n in self.lake._children(base) if n.startswith("snapshot="))[-KEPT:]
        schema = DATASETS[self.layer, "pointer"]
        named = {(r.dataset, r.build) for s in stamps for r in self.lake._read(f"{base}/{s}", schema).collect()}
        oldest = stamps[0].split("=", 1)[1] if len(stamps) == KEPT else ""
        for dataset in datasets:
            folder = self.lake.folder(self.layer, dataset)
            for build in self._values(folder, "build"):
                # a younger one may belong to a commit that goes on
                if (dataset, build) not in named and build < oldest:
                    remove(self.lake.spark, f"{folder}/build={build}")
