"""The registered queries on the given tables against brute force, the pipeline on planted rows, and
the independence of the rest of the library."""

import glob
import hashlib
import importlib
import os
import random
import re
import sys

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import check_components, jaccard, prose, shingles, without_repeats

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402

from pressgauge import session  # noqa: E402
from pressgauge.llm import common, queries, quality  # noqa: E402


@pytest.fixture(scope="module")
def given(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_one_query_for_each_operator():
    numbers = [int(m[1]) for n in contract.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in contract.queries()


def test_nothing_else_imports_this_package():
    for path in glob.glob(f"{ROOT}/pressgauge/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "pressgauge.llm" not in open(path, encoding="utf-8").read(), path


def test_warc_query_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(check_oracle, "registry", contract)
    assert check_oracle.compare(spark, check_oracle.duck(SF), "op9_warc", SF) == ""


def test_sketch_query(spark, given):
    got = {r.doc_id: r for r in queries.op6_sketches(spark, SF).collect()}
    assert len(got) == len(given)
    errors = []
    for i, (doc_id, text) in enumerate(given):
        after = given[(i + 1) % len(given)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r.near_edited - jaccard(shingles(text), shingles(edited))), abs(r.near_next - jaccard(shingles(text), shingles(after)))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.02


def test_repeats_query(spark, given):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_repeats(spark, SF).collect())
    assert got == [(i, n, k, s, hashlib.sha256(b).hexdigest()) for i, n, k, s, b in without_repeats(given)]


def test_simhash_query(spark):
    check_components([(r.doc_id, int(r.fingerprint, 16), r.component_id, r.n_links) for r in queries.op10_simhash(spark, SF).collect()])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    langs = queries.op7_language(spark, SF).where("held_out").join(docs, "doc_id")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    kept = queries.op3_quality(spark, SF).where("held_out").join(labels, "doc_id")
    assert kept.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(21)
    good = [prose(rnd, 120) for _ in range(60)]
    junk = [" ".join(w + "$$$" for w in prose(rnd, 80).split()) for _ in range(15)]
    passage, item = prose(rnd, 70), prose(rnd, 30)
    rows = {i: t for i, t in enumerate(good)} | {100 + i: t for i, t in enumerate(junk)}
    rows |= {200: good[3], 201: good[4] + " end", 202: f"{prose(rnd, 60)} {passage} {prose(rnd, 60)}", 203: f"{prose(rnd, 60)} {passage}",
             204: f"{prose(rnd, 50)} {item.upper()} {prose(rnd, 50)}", 205: None, 206: "", 207: good[5] * 40}
    documents = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows.items()] + [(None, prose(rnd, 90), None, None, None, None)] * 2
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def test_pipeline_decides_as_planted(spark, planted):
    folder, rows, passage = planted
    docs = common.table(spark, folder, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        kept.append({(r.doc_id, getattr(r, "text", None)) for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [{i for i, _ in k} for k in kept]
    assert not ids[0] & set(range(100, 115)) and ids[0] >= set(range(60)) | {200, 201, 202, 203, 204, None}
    assert ids[0] - ids[1] >= {200, 201} and ids[1] >= set(range(60)) | {202, 203, 204, None}
    assert ids[2] == ids[1]
    texts = dict(kept[2])
    assert passage in texts[202] and passage[60:-60] not in texts[203] and texts[3] == rows[3]
    assert ids[2] - ids[3] == {204} and ids[4] == ids[3]
    assert spark.createDataFrame([(r.doc_id,) for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()], "d bigint").count() == len(kept[3])


def test_near_copies_with_moderate_edits_are_dropped(spark, planted):
    rnd = random.Random(23)
    rows = [(i, prose(rnd, 400)) for i in range(12)]
    for i, text in rows[:12]:
        words = text.split()
        for k in rnd.sample(range(400), 8):  # two per cent of the words
            words[k] = "changed"
        rows.append((100 + i, " ".join(words)))
    near = {100 + i for i in range(12) if jaccard(shingles(rows[i][1]), shingles(rows[12 + i][1])) >= 0.8}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, planted[0]).collect()}
    assert len(near) >= 8 and kept == {i for i, _ in rows} - near


def test_every_stage_takes_no_rows(spark, planted):
    none = common.table(spark, planted[0], "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, planted[0]).count() == 0


def test_rows_survive_a_lost_label_table(spark, planted, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = common.table(spark, planted[0], "documents")
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert kept.count() == docs.count() and quality.KEEP == 0.7


def test_the_rest_works_without_this_package(monkeypatch):
    monkeypatch.setattr("importlib.util.find_spec", lambda name, *a: None)
    rest = importlib.reload(contract)
    try:
        assert not any(n.startswith("op") for n in rest.queries()) and len(rest.queries()) > 100
    finally:
        monkeypatch.undo()
        importlib.reload(contract)


def test_pipeline_leaves_only_its_result(spark):
    root = os.path.dirname(session.scratch_path(spark, "probe")).removeprefix("file://")
    listed = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = listed()
    out = corpus_pipeline.run(spark, SF)
    assert [name.rsplit("-", 1)[0] for name in listed() - before] == ["bpe_encoding"] and out.count() > 0
