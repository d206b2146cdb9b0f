"""One registered query for each operator of this package, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import (
    bpe, collocations, common, decontaminate, langid, lattice, mixing, negatives, quality, repeats, simhash, sketches, warc, wordpiece,
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = ~common.is_remainder(F.col("doc_id"), 10, 0)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", learn.alias("learn"))
    model = lattice.train(docs, "learn", vocabulary("piece_bpe_32k.model"))
    return lattice.score(docs, model).select(
        "doc_id", common.is_remainder(F.col("doc_id"), 10, 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def encoded(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    coded = bpe.encode(docs.select("doc_id", "text"), path).drop("text")
    return bpe.decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.is_remainder(F.col("doc_id"), 4, 2)
    model = quality.train(docs.where(~held), common.table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted")
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = sketches.with_next(docs, "doc_id", "text", ["sketch"], lambda rows: sketches.with_sketch(rows, "text", "sketch"))
    quarter = "cast(n_chars div 4 as int)"
    edited = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {quarter}), substring(next_text, 1, {quarter}))")
    )
    return sketches.with_sketch(edited, "edited", "edited_sketch").selectExpr(
        "doc_id", "n_chars", "sha2(edited, 256) AS edited_sha256",
        f"{sketches.fingerprint('sketch')} AS fingerprint", f"{sketches.fingerprint('edited_sketch')} AS edited_fingerprint",
        f"{sketches.resemblance('sketch', 'edited_sketch')} AS near_edited", f"{sketches.resemblance('sketch', 'next_sketch')} AS near_next",
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.is_remainder(F.col("doc_id"), 5, 0)
    model = langid.train(docs.where(~held))
    return langid.predict(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, vocabulary("word_bpe_49k.json")).drop("text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.decided(common.table(spark, sf_dir, "pages"))
    return warc.read_packages(warc.write_packages(records, warc.packages_folder(spark)))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(common.table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(common.table(spark, sf_dir, "embeddings"), label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_lattice": op1_lattice,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_repeats": op5_repeats,
    "op6_sketches": op6_sketches,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_mixing": op11_mixing,
    "op12_collocations": op12_collocations,
    "op13_negatives": op13_negatives,
    "pipeline": pipeline,
}

_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op12_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w
            FROM (SELECT lang, unnest(string_split_regex({_LOWER_AZ}, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
        grams AS (
            SELECT lang, list_slice(w, i, i + m - 1) AS g FROM places, (VALUES (1), (2), (3)) AS s(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, g, count(*) AS c FROM grams GROUP BY lang, g HAVING count(*) >= 10),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
        cuts AS (SELECT lang, g, c AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
        scored AS (
            SELECT u.*, x.c AS l, y.c AS r, CAST(1000000::HUGEINT * a * a // (x.c::HUGEINT * y.c) AS BIGINT) AS score
            FROM cuts u JOIN f x ON x.lang = u.lang AND x.g = list_slice(u.g, 1, k)
            JOIN f y ON y.lang = u.lang AND y.g = list_slice(u.g, k + 1, len(u.g))),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        around AS (
            SELECT lang, g, max(c) AS around
            FROM (SELECT lang, c, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) AS g FROM f WHERE len(g) = 3) GROUP BY lang, g),
        kept AS (
            SELECT l.*, array_to_string(l.g, ' ') AS phrase FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.g = l.g
            WHERE around IS NULL OR 100 * around < 50 * a)
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
               a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest)
                      ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
}
