"""Mixing, collocations and hard negatives on small tables with nulls, empty and long texts, ties, repeated
rows, clashing columns and no rows, each against a brute-force version."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import SCHEMA, prose, texts

from pressgauge.llm import collocations, mixing, negatives, queries, ranks

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    sources = ["b", "a", None, "c", "\U0001f600", "￿", "tiny", "hollow"]
    made = []
    for i, t in enumerate(texts() + [prose(rnd, 40) for _ in range(60)]):
        source = sources[i % 6] if i % 3 else "b"
        made.append((i if i % 9 else None, t, ["en", "de", None, "und"][i % 4], source, 1, "x", "y", "z", 5))
    made.append((900, "one two three", "en", "tiny", 1, "x", "y", "z", 5))
    made += [(901, "", "en", "hollow", 1, "x", "y", "z", 5), (902, None, "en", "hollow", 1, "x", "y", "z", 5)]
    return made + made[20:24] + [made[30]] * 3


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_numbers_and_sums_before(spark):
    rnd = random.Random(2)
    values = [(rnd.randrange(30), rnd.randrange(5)) for _ in range(500)]
    got = ranks.numbered(spark.createDataFrame(values, "a int, b int"), [F.col("a"), F.col("b")], "no").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.no)] == sorted(values)
    assert sorted(r.no for r in got) == list(range(500))
    placed = [(i % 3, i // 3, rnd.randrange(9)) for i in range(300)]
    summed = ranks.sum_before(spark.createDataFrame(placed, "k int, at int, v int"), ["k"], "at", "v", "before", step=7)
    for r in summed.collect():
        assert r.before == sum(v for k, at, v in placed if k == r.k and at < r["at"])


def targets(rows, share=1.5):
    """Shares of 150 % of all words by weight, cut at twice a source, the rest dealt again."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in target]
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]] if total else []
        if not above:
            return sizes, target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in above}
        left = share * sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_takes_each_target(docs, rows, block):
    mixed = mixing.mix(docs, block=block, slots=16, chunk=50)
    got = mixing.taken(mixed, block).collect()
    sizes, target = targets(rows)
    want = Counter((r[0], len(words(r[1])), sizes[r[3]]) for r in rows)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == want
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_source = {r.source: r for r in mixed.sources.collect()}
    taken = {r.source_no: r.taken for r in mixing.spans(mixed, block).groupBy("source_no").agg(F.sum("words").alias("taken")).collect()}
    assert set(by_source) == set(target)
    for source, r in by_source.items():
        assert r.target == pytest.approx(target[source])
        assert taken.get(r.source_no, 0) == math.floor(target[source] + 0.5)
    again = mixing.taken(mixing.mix(docs.repartition(5), block=block, slots=16, chunk=50), block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_uses_each_block_once_a_round(docs):
    mixed = mixing.mix(docs, block=5, slots=16, chunk=50)
    slots = [r.asDict() for r in mixed.slots.collect()]
    assert sorted(s["slot"] for s in slots) == list(range(len(slots)))
    assert all(s["shard"] == s["slot"] // 16 and s["take"] > 0 for s in slots)
    sources = {r.source_no: r for r in mixed.sources.collect()}
    uses = Counter((s["source_no"], s["block"]) for s in slots)
    for (source, block), n in uses.items():
        about = sources[source]
        assert 0 <= block < about.blocks and about.turns <= n <= min(2, about.turns + 1)
    assert all(uses[s.source_no, b] >= s.turns for s in sources.values() for b in range(s.blocks))
    # shards differ in their counts: they are drawn, not dealt evenly
    assert len(set(Counter((s["shard"], s["source_no"]) for s in slots).values())) > 2


def test_mixed_texts_are_words_of_their_source(docs, rows):
    mixed = mixing.mix(docs, block=8, slots=16, chunk=50)
    names = {r.source_no: r.source for r in mixed.sources.collect()}
    take = {r.slot: r["take"] for r in mixed.slots.collect()}
    out = mixing.mixed_texts(docs, mixed, block=8).collect()
    known = defaultdict(set)
    for r in rows:
        known[r[3]].update(words(r[1]))
    assert {r.slot: len(words(r.text)) for r in out} == take
    assert all(set(words(r.text)) <= known[names[r.source_no]] for r in out)


def test_permutations(spark):
    for size in (1, 2, 3, 10, 257):
        df = spark.range(size).select("id", mixing.permuted(F.col("id"), F.lit(size), [F.lit(size)]).alias("to"))
        back = df.withColumn("back", mixing.permuted(F.col("to"), F.lit(size), [F.lit(size)], inverse=True)).collect()
        assert sorted(r.to for r in back) == list(range(size)) and all(r.back == r.id for r in back)
    assert [r.to for r in sorted(back, key=lambda r: r.id)] != list(range(257))


def test_mix_of_nothing(spark, nothing):
    assert mixing.taken(mixing.mix(nothing)).collect() == []
    empty = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id bigint, text string, source string")
    got = mixing.taken(mixing.mix(empty)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixed_texts(empty, mixing.mix(empty)).count() == 0


def phrases(rows, least=10, most=3):
    """Brute force over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, most + 1):
                f.update((lang, tuple(own[i : i + k])) for i in range(len(own) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    out = defaultdict(list)
    around = defaultdict(int)
    for (lang, g), c in f.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                around[lang, g[i : i + size]] = max(around[lang, g[i : i + size]], c)
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * around[lang, g] < 50 * a:
            cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return {
        (lang, i + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(all_))
    }


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    names = ["New York", "new\tYORK", "machine learning", "é ß", "a a", "x\x1cy z", "日本 語"]
    rows = []
    for i in range(400):
        body = " ".join(rnd.choice(names) if rnd.random() < 0.4 else rnd.choice("the of and in to".split()) for _ in range(rnd.randrange(12)))
        rows.append((rnd.choice(["en", "de", None, "und"]), body + rnd.choice([".", " !", "\n", "", ",,x"]) + body[:20], i, "c", "d"))
    rows += [(None, None, 1, "", ""), ("en", "", 2, "", ""), ("en", "w" * 9000 + " " + "w" * 9000, 3, "", ""), ("fr", "only once", 4, "", "")]
    return rows + [("en", ("v" * 5000 + " tail ") * 12 + ("very long text, " * 30_000), 5, "", "")] + rows[:40]


PHRASES = "lang string, text string, n bigint, phrase string, `count` string"


@pytest.mark.parametrize("mask", [2**64 - 1, 0x7])
@pytest.mark.parametrize("most", [3, 4])
def test_phrases_equal_brute_force(spark, corpus, mask, most):
    """Also with fingerprints of three bits, where nearly all collide."""
    docs = spark.createDataFrame(corpus, PHRASES).repartition(3)
    got = collocations.collocations(docs, most_words=most, keep=None, bits=16, mask=mask).collect()
    want = phrases([r[:2] for r in corpus], most=most)
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want and len(got) > 20


def test_phrases_kept_and_none(spark, corpus):
    docs = spark.createDataFrame(corpus, PHRASES)
    first = collocations.collocations(docs, keep=3)
    assert max(Counter(r.lang for r in first.collect()).values()) == 3
    assert collocations.collocations(docs.where("false")).collect() == []
    assert collocations.collocations(docs.where("lang = 'fr'")).collect() == []


def test_parts_of_a_long_text_keep_its_pieces():
    text = b"a b c, " * 50 + b"x " * 100 + b". end"
    parts = list(collocations.cut(text, 40))
    assert b"".join(parts) == text and all(p[-1:] in collocations.PIECE_ENDS for p in [bytes(p) for p in parts[:-1]])
    assert list(collocations.cut(b"", 5)) == [b""] and list(collocations.cut(b"abc" * 9, 5)) == [b"abc" * 9]


def test_scores_beyond_64_bits(spark):
    big = 10**12
    counted = spark.createDataFrame(
        [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7)], "lang string, phrase string, words int, `count` bigint"
    )
    r = collocations.scored(counted).first()
    assert r.score == 10**6 * (big - 1) ** 2 // (big * (big + 7))


VECTORS = "vec_id bigint, embedding array<float>, label int, score bigint, no string, rows string"


def brute(rows, anchor, low=50, high=95, positives=5, negatives=3):
    """Rows (id, vector, label)."""
    known = [
        (i, v, label, [math.floor(256 * x) for x in vec]) for i, (v, vec, label) in enumerate(rows)
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)
    ]
    out = Counter()
    last = float("inf")
    for i, a, label, q in known:
        if not anchor(a):
            continue
        every = sorted(
            (-sum(x * y for x, y in zip(q, p)), last if v is None else v, j, other) for j, v, other, p in known if j != i
        )
        for ps, positive, _, _ in [e for e in every if e[3] == label][:positives]:
            fit = [e for e in every if e[3] != label and -low * ps <= -100 * e[0] <= -high * ps][:negatives]
            for n, (ns, negative, _, _) in enumerate(fit):
                out[a, None if positive == last else positive, n + 1, None if negative == last else negative, -ps, -ns] += 1
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    made = [(i, [c + rnd.gauss(0, 0.25) for c in centres[i % 4]], rnd.choice([i % 4, 1])) for i in range(300)]
    made += [(1000 + i, [x * 9 for x in made[i][1]], i % 3) for i in range(20)]  # long ones
    made += [(2000, [0.0] * 6, 1), (2005, [0.0] * 6, 2), (2010, [], 1), (2015, [0.5, 0.5], 1), (2020, [0.5] * 9, 2)]
    made += [(None, made[3][1], 1), (None, made[5][1], 2), *made[10:13], (15, made[40][1], 0)]
    made += [(3000, None, 1), (3005, made[0][1], None), (3010, [float("nan")] * 6, 1), (3015, [float("inf"), 0.0], 1), (3020, [None, 1.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in made], VECTORS)
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    return df.repartition(4), exact


@pytest.mark.parametrize("focus", [1, 4])
def test_hard_negatives_equal_brute_force(spark, vectors, focus, monkeypatch):
    df, rows = vectors
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    got = negatives.hard_negatives(df, anchor="vec_id % 5 = 0", bucket=32, block=9)
    want = brute(rows, lambda a: a is not None and a % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(want.values()) > 300


def test_hard_negatives_of_wide_numbers(spark):
    """Products beyond 53 bits stay exact."""
    rnd = random.Random(6)
    rows = [(i, [float(rnd.randrange(1, 2**19)) * 4 for _ in range(3)], i % 2) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    got = negatives.hard_negatives(df, anchor="vec_id % 5 = 0")
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, lambda a: a % 5 == 0)


def test_hard_negatives_of_nothing(spark, vectors):
    df, _ = vectors
    assert negatives.hard_negatives(df.where("false")).collect() == []
    assert negatives.hard_negatives(df.where("label = 1")).collect() == []  # no other label
    assert negatives.hard_negatives(df, anchor="false").collect() == []


def test_candidates_hold_all_that_score_enough():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    put = lambda m: pa.scalar(
        [{"no": i, "vec_id": i, "label": 0, "vector": v.tolist()} for i, v in enumerate(m)],
        pa.list_(pa.struct([("no", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64()))])),
    )
    bucket = negatives.Side(put(np.round(rnd.normal(size=(200, 8)) * 50)))
    anchors = negatives.Side(put(np.round(rnd.normal(size=(10, 8)) * 50)))
    every = bucket.vectors @ anchors.vectors.T
    left = []
    for i in range(10):
        for least in (-4000.0, 0.0, 5000.0, 15000.0, 30000.0):
            found = set(negatives.candidates(anchors, i, bucket, least).tolist())
            assert set(np.flatnonzero(every[:, i] >= least).tolist()) <= found
            left.append(len(found) if least > 10000 else 0)
    assert 0 < sum(left) < 0.6 * 10 * 2 * 200  # the ranges do prune


def test_queries_keep_their_contracts(spark):
    got = queries.op11_mixing(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    found = queries.op12_collocations(spark, SF).collect()
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: v for k, v in phrases(rows).items() if k[1] <= 2000}
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found} == want
    given = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    hard = queries.op13_negatives(spark, SF).collect()
    assert Counter(tuple(r) for r in hard) == brute(given, lambda a: a % 50 == 0)
