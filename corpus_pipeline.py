"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents. Columns beyond these pass through all but the last. Rows with null
ids or texts, repeated rows and empty tables go through every stage; what becomes of them is said at
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import common, decontaminate, neardups, quality, queries, repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under ``quality.KEEP``. Labels of a quarter of the ids are held out."""
    held = common.is_remainder(F.col("doc_id"), 4, 2)
    model = quality.train(docs.where(~held), common.table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, out="__score")
    return scored.where(F.col("__score") >= quality.KEEP).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component of near-duplicates: texts whose five-word
    shingles have a similarity of 0.8 or more."""
    return neardups.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that an earlier document has; n_chars follows. A text that loses nothing stays
    as it is, null too. Bytes of a character that was cut in part go with it. No row is dropped."""
    cut = repeats.remove_repeats(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}), "__in_doc_id", "__in_text")

    text = F.when(F.col("n_removed") == 0, F.col("__in_text")).otherwise(repeats.as_text(F.col("kept")))
    out = cut.withColumn("__text", text)
    n_chars = F.when(F.col("n_removed") == 0, F.col("__in_n_chars")).otherwise(F.char_length("__text"))
    new = {"text": F.col("__text"), "n_chars": n_chars.cast("bigint")}
    return out.select(*(new.get(c, F.col(f"__in_{c}")).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document, ids decoded again."""
    return queries.encoded(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: A learnt classifier, a checksum graph and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, written. Tables that stages wrote on their way go as soon as they are read."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, read = common.only_result(spark, name, lambda: stage(spark, docs, sf_dir)), before
        before = docs
        if read is not None:
            common.dropped(read)
    return docs
