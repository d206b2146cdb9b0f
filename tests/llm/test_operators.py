"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing
columns and no rows, each against a brute-force version."""

import hashlib
import itertools
import math
import random
import re
import time
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgauge.llm import bpe, decontaminate, induced, langid, lattice, neardups, quality, repeats, simhash, sketches, warc, wordpiece

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, kept string, start int"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(rnd, n):
    parts = ["the", "of", "tion", "er", "ing", "é", "ß", "and", "wh", "ble", "st", "42", "re"]
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(n))


def texts():
    rnd = random.Random(11)
    base = [prose(rnd, n) for n in (1, 2, 3, 5, 12, 30, 60, 200)]
    shared = prose(rnd, 25)
    out = [None, "", "   ", "\n\t", "...", "日本語 텍스트 <|endoftext|> x", "a" * 3000, "ab " * 2000, *base, *base[4:]]
    out += [f"{prose(rnd, 9)} {shared} {prose(rnd, 7)}" for _ in range(5)] + [shared, shared.upper()]
    return out + [" ".join(prose(rnd, 300).split() + ["tail"] * k) for k in range(3)]


@pytest.fixture(scope="module")
def rows():
    made = [(i * 3 if i % 7 else i, t, "en", "s", 1, "x", "y", "z", 5) for i, t in enumerate(texts())]
    return made + [made[9], (None, made[12][1], None, None, None, None, None, None, None), (made[13][0], "other text", *made[13][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_bpe_equals_the_tokenizer_library(docs, nothing, rows):
    theirs = Tokenizer.from_file(BYTES)
    got = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == theirs.decode(want, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(nothing, BYTES).count() == 0
    rnd, mine = random.Random(1), bpe.Encoder(bpe.Vocabulary(*bpe.load(BYTES)))
    letters = [*"aab bthehe  \n'sd1é", "<|endoftext|>", " ", "՘", "\x1c"]
    for _ in range(1500):
        text = "".join(rnd.choices(letters, k=rnd.randrange(60)))
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_bpe_splits_settled_characters_as_the_library_does():
    cutter = Tokenizer.from_file(BYTES).pre_tokenizer
    settled, pattern = re.compile(bpe.SETTLED), bpe.settled_pattern()
    for code in itertools.chain(range(0x600), range(0x2000, 0x2100), range(0x3000, 0x3100), range(0xAC00, 0xAC20)):
        c = chr(code)
        if settled.fullmatch(c):
            text = f"a{c}1 {c}! {c}{c} "
            assert [s for _, s in cutter.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)], hex(code)


def test_ids_outside_the_table_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, [15496, -4, 99_999_999, None]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, BYTES).orderBy("k").collect()] == ["Hello", "", ""]


def test_piece_counts_equal_greedy_longest_match(docs, nothing):
    pieces = {tuple(p) for p in wordpiece.load_pieces(WORDS)}
    longest = max(map(len, pieces))
    import unicodedata

    import regex

    def count(word):
        s, n = wordpiece.symbols(word), 0
        while s:
            k = next((k for k in range(min(longest, len(s)), 0, -1) if tuple(s[:k]) in pieces), 1)
            s, n = s[k:], n + 1
        return n

    for r in wordpiece.token_counts(docs, WORDS).collect():
        words = regex.findall(wordpiece.WORDS, unicodedata.normalize("NFC", r.text or "").lower())
        assert (r.n_words, r.n_pieces) == (len(words), sum(map(count, words)))
    assert wordpiece.token_counts(nothing, WORDS).count() == 0


def test_automaton_on_random_vocabularies():
    rnd = random.Random(5)
    for _ in range(60):
        pieces = [[97 + rnd.randrange(3) for _ in range(rnd.randint(2, 5))] for _ in range(12)]
        pieces = [p[:-1] + [p[-1] + wordpiece.END] if rnd.random() < 0.3 else p for p in pieces]
        known, machine = {tuple(p) for p in pieces}, wordpiece.Automaton(pieces)
        for _ in range(40):
            word = wordpiece.symbols("".join(rnd.choices("abc", k=rnd.randint(1, 14))))
            rest, n = word, 0
            while rest:
                k = next(k for k in range(len(rest), 0, -1) if k == 1 or tuple(rest[:k]) in known)
                rest, n = rest[k:], n + 1
            assert machine.count(word) == n


def every_cut(word, first, inner, logs, net):
    """Probability of a word as the plain sum over all segmentations."""
    p_first = {p: math.exp(logs[i]) for i, p in enumerate(net.first)}
    p_inner = {p: math.exp(logs[len(net.first) + i]) for i, p in enumerate(net.inner)}

    def inside(rest):
        return 1.0 if not rest else sum(p_inner[rest[:k]] * inside(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in p_inner)

    total = p_first[b""] * inside(word)
    total += sum(p_first[word[:k]] * inside(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p_first)
    return total * math.exp(logs[net.stop])


def test_lattice_sums_all_segmentations():
    first, inner = {b"": 0.1, b"th": 0.5, b"the": 0.9}, {bytes([b]): 0.01 for b in range(256)} | {b"he": 0.4, b"in": 0.3, b"ing": 0.8}
    net = lattice.Lattice(list(first), list(inner))
    weights = np.array([*(first[p] for p in net.first), *(inner[p] for p in net.inner), 0.5])
    logs = net.normal(weights)
    words = ["the", "thing", "heing", "x", "inthe", "ththth", "éa"]
    found = np.zeros(len(words))
    counts = np.zeros(net.size)
    for place, rows_ in net.by_length(words):
        found[place] = net.log_probability(rows_, logs)
        counts += net.expected(rows_, logs)
    for w, got in zip(words, found):
        alone = np.frombuffer(w.encode(), np.uint8)
        assert math.isclose(net._forward_alone(alone, logs)[-1] + logs[net.stop], got, rel_tol=1e-12)
        assert np.allclose(net._expected_alone(alone, logs), net.expected(alone[None], logs), rtol=1e-9, atol=1e-12)
        assert math.isclose(math.exp(got), every_cut(w.encode(), first, inner, logs, net), rel_tol=1e-9)
    again = sum(net.expected(r, logs, np.full(len(r), 3)) for _, r in net.by_length(words))
    assert np.allclose(again, 3 * counts)
    # expectations are the derivatives of the log likelihood by the log weights
    for piece in (0, 1, len(net.first) + 256, net.stop):
        moved = logs.copy()
        moved[piece] += 1e-5
        change = sum((net.log_probability(r, moved) - net.log_probability(r, logs)).sum() for _, r in net.by_length(words))
        assert math.isclose(change / 1e-5, counts[piece], rel_tol=1e-3, abs_tol=1e-6)


def test_long_words_are_walked_in_blocks(monkeypatch):
    first, inner = lattice.load_pieces(PIECES)
    net = lattice.Lattice(list(first), list(inner))
    logs = net.normal(np.array([*(first[p] for p in net.first), *(inner[p] for p in net.inner), 0.5]))
    word = "".join(random.Random(5).choice(["there", "é", "日本", "x", "in"]) for _ in range(400)).encode()
    rows_ = np.frombuffer(word, np.uint8)[None]
    want = net.log_probability(rows_, logs), net.expected(rows_, logs, np.array([2]))
    monkeypatch.setattr(lattice, "ALONE", 10)
    monkeypatch.setattr(lattice, "BLOCK", 7)
    assert np.allclose(net.log_probability(rows_, logs), want[0], rtol=1e-12)
    assert np.allclose(net.expected(rows_, logs, np.array([2])), want[1], rtol=1e-8, atol=1e-12)


def test_a_word_of_a_million_bytes(spark):
    word = "".join(random.Random(6).choices("abcdefghij", k=1_000_000))
    df = spark.createDataFrame([(1, word, True), (2, "some words", True)], "doc_id int, text string, learn boolean")
    began = time.monotonic()
    got = {r.doc_id: r for r in lattice.score(df, lattice.train(df, "learn", PIECES)).collect()}
    assert got[1].n_tokens == 2 and math.isfinite(got[1].score) and got[1].score < 1000 * got[2].score
    assert wordpiece.token_counts(df, WORDS).where("n_pieces > 100000").count() == 1
    assert bpe.decode(bpe.encode(df, BYTES), BYTES).where("decoded <> text").count() == 0
    assert time.monotonic() - began < 180


@pytest.mark.parametrize("frequent", [150_000, 3])
@pytest.mark.parametrize("whole_words", [True, False])
def test_language_model_scores(docs, monkeypatch, frequent, whole_words):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    marked = docs.withColumn("learn", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    model = lattice.train(marked, "learn", PIECES, whole_words=whole_words)
    assert len(model["frequent"]) <= frequent
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(t for r in rows if r.doc_id is None or r.doc_id % 2 == 0 for t in [*tokens(r.text), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (r.doc_id or -1, len(tokens(r.text)) + 1, sum(counts[t] > 0 for t in [*tokens(r.text), None]), n,
         round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in [*tokens(r.text), None]), 5))
        for r in rows
    )
    got = lattice.score(docs, model).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    d, logp = model["discount"], {r.word: r.logp for r in model["words"].collect()}
    own = lambda t: math.log10((max(counts[t] - d, 0) + d * v * 10 ** logp[t]) / n) if counts[t] else logp[t] + math.log10(d * v / n)
    end = (counts[None] - d) / n if whole_words else (counts[None] + 0.5) / (n + 1)
    if not whole_words:
        own = lambda t: logp[t] + math.log10(1 - end)
    by_id = {(r.doc_id, r.n_tokens): r.score for r in got}
    for r in rows:
        want_score = sum(map(own, tokens(r.text))) + math.log10(end)
        assert math.isclose(by_id[r.doc_id, len(tokens(r.text)) + 1], want_score, rel_tol=1e-9)


def test_language_model_without_training_rows(docs, nothing):
    for df in (docs, nothing):
        model = lattice.train(df.withColumn("learn", F.lit(False)), "learn", PIECES)
        got = lattice.score(df, model).collect()
        assert len(got) == df.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in got)


def test_pieces_come_from_the_vocabulary():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first, inner = lattice.load_pieces(PIECES)
    named = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    assert all("▁" + p.decode() in named for p in list(first)[:500] if p)
    assert all(p.decode("utf-8", "ignore") in named for p in list(inner)[:500] if len(p) > 1)


def test_quality_ranks_and_cuts_at_a_quantile(spark, docs, nothing):
    rnd = random.Random(4)
    good = [(i, prose(rnd, 50)) for i in range(60)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(rnd, 50).split())) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    told = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (3, 1), (9999, 0), (4, 7)]
    model = quality.train(df, spark.createDataFrame(told, "doc_id bigint, quality int"))
    got = {r.doc_id: r.score for r in quality.scored(df, model).collect()}
    assert all(got[i] >= quality.KEEP for i, _ in good) and all(got[i] < quality.KEEP for i, _ in bad)
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).collect())
    nobody = quality.train(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in quality.scored(docs, nobody).select("score").collect()} == {quality.KEEP}
    assert quality.scored(nothing, model).count() == 0


def test_network_gradients_are_derivatives():
    net, rnd = langid.Network(3), np.random.default_rng(2)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rnd.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(langid.probabilities(net.tables(), x)[np.arange(4), y]).mean()

    grads = net.gradients(x, y)
    for name in ("out", "shift", "filter3", "bias2", "embed"):
        flat = net.weights[name].reshape(-1)
        at = int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-6
        up = loss()
        flat[at] = old - 1e-6
        assert math.isclose((up - loss()) / 2e-6, grads[name].reshape(-1)[at], rel_tol=1e-3, abs_tol=1e-6)
        flat[at] = old


def test_short_items_are_found_with_all_substitutions_that_the_share_allows(spark):
    said, docs, bench = iter(f"w{i}" for i in itertools.count()), [], []
    for n in range(decontaminate.SEEDED, decontaminate.WINDOW):
        item = [next(said) for _ in range(n)]
        bench.append((n, " ".join(item)))
        wrong = n - math.ceil(n * decontaminate.SHARE)
        for k in (0, wrong, wrong + 1):  # one more is not found
            for lead, changed in itertools.product((4, 5), itertools.combinations(range(n), k)):
                words = [next(said) for _ in range(lead)] + [f"x{w}" if i in changed else w for i, w in enumerate(item)] + [next(said)]
                docs.append((1000 * len(docs) + 10 * n + (k <= wrong), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == {(d, d % 1000 // 10) for d, _ in docs if d % 10}


def test_many_copies_of_one_text_count_once_in_training(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 20)
    made = [(f"{lang} text number {i}", lang) for lang in ("aa", "bb") for i in range(20)]
    copies = [(f"{lang} text number {i}", lang) for lang in ("aa", "bb") for i in range(3) for _ in range(300)]
    df = spark.createDataFrame(made + copies, "text string, lang string").repartition(3)
    langs, x, y = langid._samples(df, "text", "lang")
    assert langs == ["aa", "bb"] and len(x) == 40
    assert {bytes(row).rstrip(b"\0").decode() for row in x} == {t for t, _ in made}


def test_language_is_learnt_and_edge_cases_hold(spark, docs, nothing):
    rnd = random.Random(6)
    say = lambda parts, n: " ".join("".join(rnd.choices(parts, k=3)) for _ in range(n))
    kinds = {"aa": ["zu", "ich", "ung", "ß"], "bb": ["eau", "que", "oi", "é"]}
    made = [(i, say(kinds[k], rnd.randint(3, 200)), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, "zzz", None), (901, None, "aa")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    model = langid.train(df.where("doc_id % 5 <> 0"))
    got = langid.predict(df.where("doc_id % 5 = 0 and doc_id < 900"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    for r in langid.predict(docs, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("aa", "bb")) if letters else (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.predict(docs, langid.train(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def leaks(docs_rows, items):
    say = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for doc_id, text in docs_rows:
        d = say(text)
        for item_id, item in items:
            b = say(item)
            m = min(decontaminate.WINDOW, len(b))
            short = len(b) < decontaminate.SEEDED
            need = m if short else math.ceil(m * decontaminate.SHARE)
            if len(b) < decontaminate.LEAST:
                continue
            for start in range(-len(b) + 1, len(d)):
                eq = [0 <= start + j < len(d) and d[start + j] == b[j] for j in range(len(b))]
                if any(sum(eq[k : k + m]) >= need for k in range(len(b) - m + 1)):
                    out.add((doc_id, item_id))
                    break
    return out


def test_benchmark_passages_are_found(spark, docs, nothing, rows):
    rnd = random.Random(8)
    all_texts = [t for t in texts() if t and len(t.split()) > 20]
    words = all_texts[-1].split()
    changed = words[10:40]
    for k in range(0, 30, 7):
        changed[k] = "other"
    items = [(1, " ".join(changed)), (2, " ".join(words[50:57])), (3, "the of"), (4, None), (5, ""), (6, prose(rnd, 40)),
             (7, " ".join(words[60:73]).upper()), (8, " ".join(words[80:90])), (8, " ".join(words[80:90])), (None, " ".join(words[100:120]))]
    bench = spark.createDataFrame([(*i, "t") for i in items], "item_id bigint, text string, source string")
    want = leaks([(r[0], r[1]) for r in rows], items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and len(want) >= 5
    kept = decontaminate.clean(docs, bench)
    gone = {d for d, _ in want}
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows if r[0] not in gone)
    assert decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_more_seeds_than_may_be_sent_join_all_the_same(spark, docs, monkeypatch):
    bench = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), "text")
    want = sorted(map(tuple, decontaminate.matches(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "SENT", 0)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect()), key=str) == want and want


def test_masks_meet_every_two_substitutions():
    window, span = decontaminate.WINDOW, decontaminate.SPAN
    for first in range(decontaminate.STRIDE):
        seeds = [{i + o for o in m} for m in decontaminate.MASKS for i in range(first, window - span + 1, decontaminate.STRIDE)]
        for changed in itertools.combinations(range(window), 2):
            assert any(not seed & set(changed) for seed in seeds)


def test_suffixes_are_sorted_with_their_common_prefixes(monkeypatch):
    rnd = random.Random(3)
    for block, held in ((1 << 20, 1 << 23), (3, 10)):
        monkeypatch.setattr(induced, "BLOCK", block)
        monkeypatch.setattr(induced, "HELD", held)
        for _ in range(120):
            letters = rnd.choice([[2], [2, 3], [2, 3, 4, 5], list(range(1, 40))])
            t = rnd.choices(letters, k=rnd.randrange(50)) * rnd.choice([1, 1, 4]) + [0]
            parts = list(induced.Sorter(np.array(t, np.uint16)).suffixes())
            order, common = (np.concatenate([p[i] for p in parts]).tolist() for i in (0, 1))
            assert order == sorted(range(len(t)), key=lambda i: t[i:])
            for k in range(1, len(t)):
                a, b = t[order[k - 1] :], t[order[k] :]
                assert common[k] == min(255, next(i for i, (x, y) in enumerate(zip(a, b)) if x != y))


def without_repeats(rows, length=50):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            if doc_id is not None:
                s = data[i : i + length]
                first[s] = min(doc_id, first.get(s, doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if doc_id is not None and first[data[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        out.append((doc_id or -1, len(data), sum(gone), ("\0" + gone.decode()).count("\0\1"), bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("crowd, sent, shard", [(200_000, 4_000_000, 4 << 20), (1, 0, 300)])
def test_repeated_bytes_are_removed(docs, nothing, rows, monkeypatch, crowd, sent, shard):
    for name, value in (("CROWD", crowd), ("SENT", sent), ("SHARD", shard)):
        monkeypatch.setattr(repeats, name, value)
    got = repeats.remove_repeats(docs)
    assert set(docs.columns) <= set(got.columns)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got.collect()) == without_repeats([(r[0], r[1]) for r in rows])
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("sent, bits", [(1 << 27, 29), (0, 15)])
def test_any_number_of_names_makes_a_table(spark, monkeypatch, sent, bits):
    """Without one, all segments of all texts were shuffled."""
    monkeypatch.setattr(repeats, "SENT", sent)
    monkeypatch.setattr(repeats, "BITS", bits)
    values = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 8000)
    table = repeats.bit_table(spark.createDataFrame([(int(v),) for v in values[:4000]], "name bigint"), "name")
    assert len(table) * 8 <= 1 << bits
    marked = repeats._marked(table, values.view(np.uint64))
    assert marked[:4000].all() and marked[4000:].mean() < (0.01 if bits > 15 else 0.1)


def shingles(text, n=5):
    w = tokens(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_estimate_and_merge(spark, docs, nothing):
    rnd = random.Random(9)
    a, b = prose(rnd, 2500), prose(rnd, 2500)
    half = " ".join(a.split()[:1250] + b.split()[:1250])
    df = spark.createDataFrame([(a, half, "", "x y")], "a string, b string, e string, s string")
    for c in "abes":
        df = sketches.with_sketch(df, c, f"k{c}")
    r = df.selectExpr(
        f"{sketches.resemblance('ka', 'kb')} near", f"{sketches.containment('ka', 'kb')} part", f"{sketches.distinct_shingles('ka')} n",
        f"{sketches.resemblance('ke', 'ke')} empty", f"{sketches.resemblance('ke', 'ks')} other", f"{sketches.containment('ke', 'ka')} none",
    ).first()
    sa, sb = shingles(a), shingles(half)
    assert abs(r.near - jaccard(sa, sb)) < 0.15 and abs(r.part - len(sa & sb) / len(sa)) < 0.2
    assert abs(r.n / len(sa) - 1) < 0.3 and (r.empty, r.other, r.none) == (1.0, 0.0, 1.0)
    parts = spark.createDataFrame([("g", a), ("g", b), ("g", a)], "g string, text string")
    merged = sketches.merge_groups(sketches.with_sketch(parts, "text", "k"), ["g"], "k").first().k
    two = df.select("ka").first().ka
    other = sketches.with_sketch(parts.where(F.col("text") == b), "text", "k").first().k
    assert merged == sorted(set(two) | set(other))[: sketches.K]
    assert sketches.with_sketch(nothing, "text", "k").count() == 0


@pytest.mark.parametrize("size", [2000, 2])
def test_each_row_gets_the_text_that_follows(spark, docs, nothing, rows, monkeypatch, size):
    monkeypatch.setattr(sketches, "RANGE", size)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = sketches.with_next(df, "doc_id", "text", []).collect()
    assert len(got) == len(rows)
    order = sorted([(r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ (1 << 63), r[1] or "") for r in rows])
    want = sorted((str(a[1] if a[0] else None), a[3], b[3]) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == want
    one = sketches.with_next(df.where("doc_id = 3"), "doc_id", "text", []).collect()
    assert [(r.text, r.next_text) for r in one] == [(one[0].text, one[0].text)] or len(one) > 1
    assert sketches.with_next(nothing.select("doc_id", "text"), "doc_id", "text", []).count() == 0


@pytest.mark.parametrize("group", [4096, 2])
def test_fingerprints_and_components(spark, docs, nothing, rows, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)

    def plain(text):
        w = tokens(text)
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.fingerprint % (1 << 64)) for r in got) == sorted((r[0] or -1, plain(r[1])) for r in rows)
    check_components([(r.doc_id, r.fingerprint % (1 << 64), r.component_id, r.n_links) for r in got])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in {(r.component_id, r.component) for r in got})
    assert kept[0].__fields__ == docs.columns


def check_components(found, budget=3):
    near = lambda a, b: bin(a ^ b).count("1") <= budget
    left = set(range(len(found)))
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            i = todo.pop()
            more = {j for j in left if near(found[i][1], found[j][1])}
            left -= more
            part |= more
            todo += more
        ids = [found[i][0] for i in part if found[i][0] is not None]
        assert {found[i][2] for i in part} == {min(ids) if ids else None}
        for i in part:
            assert found[i][3] == sum(near(found[i][1], found[j][1]) for j in part) - 1


@pytest.mark.parametrize("group, width, block", [(4096, 1 << 17, 1 << 16), (8, 16, 64)])
def test_trie_join_finds_all_links_in_dense_balls(spark, monkeypatch, group, width, block):
    for name, value in (("GROUP", group), ("WIDTH", width), ("BLOCK", block)):
        monkeypatch.setattr(simhash, name, value)
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for c in centres for _ in range(80)} | {0, 1, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, 1 + i % 3) for i, p in enumerate(signed)], "__print bigint, __weight bigint")
    rows = simhash.near_links(df).collect()
    weight = {p: 1 + i % 3 for i, p in enumerate(signed)}
    near = Counter()
    for r in rows:
        near[r.a] += r.near
    for p in signed:
        assert near[p] == sum(weight[q] for q in signed if q != p and bin((p ^ q) & ((1 << 64) - 1)).count("1") <= 3)


def test_components_of_chains_and_stars(spark):
    from pressgauge.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE", 400)
    long, short = "<p>é" + "x" * 400, "short"
    pages = [(5, long), (3, long), (3, long), (9, long), (None, long), (7, short), (8, short), (1, None), (2, ""), (4, "y" * 99), (6, "y" * 99),
             (10, "z" * 100), (11, "z" * 100), (None, "w" * 200), (12, "big" * 50_000), (13, "a\r\n\r\nb" * 40)]
    df = spark.createDataFrame([(i, f"http://a/{i}\n", h, "x", "y") for i, h in pages], "page_id bigint, url string, html string, payload string, first string")
    packages = warc.write_packages(warc.decided(df), str(tmp_path / "p"))
    assert packages.count() > 2
    got = warc.read_packages(packages, payload=True).collect()
    want = []
    for i, h in pages:
        data = (h or "").encode()
        same = [j for j, k in pages if (k or "") == (h or "") and j is not None]
        to = min(same) if len(data) >= 100 and same and min(same) != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", str(to), b"" if to is not None else data))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), bytes(r.payload)) for r in got) == sorted(want)
    for p in packages.collect():
        with zipfile.ZipFile(p.path) as archive:
            assert archive.testzip() is None and archive.namelist() == [warc.RECORDS, warc.INDEX]
    with open(packages.first().path, "rb+") as file:  # a damaged payload is not passed on
        file.seek(300)
        file.write(b"\0" * 50)
    with pytest.raises(Exception):
        warc.read_packages(packages).collect()
    none = warc.write_packages(warc.decided(df.limit(0)), str(tmp_path / "q"))
    assert warc.read_packages(none).count() == 0


@pytest.mark.parametrize("sample", [1, 16])
def test_all_pairs_of_near_shingle_sets_are_linked(spark, docs, rows, nothing, monkeypatch, sample):
    monkeypatch.setattr(neardups, "SAMPLE", sample)
    rnd = random.Random(31)
    made, line = [(r[0], r[1]) for r in rows], prose(rnd, 12)
    for k in range(12):  # copies with more and more changed words, appended and cut ones, all with one line
        words = f"{line} {prose(rnd, 150)}".split()
        made += [(1000 + 20 * k, " ".join(words)), (1001 + 20 * k, " ".join(words[: 120 + 4 * k])), (1002 + 20 * k, " ".join([*words, *prose(rnd, 20 + 4 * k).split()]))]
        for j in range(1, 7):
            made.append((1002 + 20 * k + j, " ".join("new" if i in rnd.sample(range(162), j) else w for i, w in enumerate(words))))
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := tokens(t)) else set() for _, t in made]
    up, lost = list(range(len(made))), 0
    for i, j in itertools.combinations(range(len(made)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            lost += (simhash.fingerprint([w.encode() for w in tokens(made[i][1])], 3) ^ simhash.fingerprint([w.encode() for w in tokens(made[j][1])], 3)).bit_count() > 3
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    assert lost > 50  # what three bits do not see
    least = {}
    for (d, _), root in zip(made, up):
        least.setdefault(root, []).append(d)
    want = sorted(min((d for d in ids if d is not None), default=-1) for ids in least.values())
    assert sorted(r.doc_id for r in neardups.one_of_each(df).collect()) == want and len(want) < len(made) - 40
    assert neardups.one_of_each(nothing).count() == 0


def test_pictures_never_hide_a_near_pair():
    rnd = np.random.default_rng(8)
    for n in (1, 5, 60, 900, 6000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rnd.integers(0, 1 << 63, len(a) - int(share * len(a)), dtype=np.uint64)]))
            x, y = neardups.drawn(a).view(np.uint64), neardups.drawn(b).view(np.uint64)
            same = len(np.intersect1d(a, b))
            assert int(np.bitwise_count(x & ~y).sum()) <= len(a) - same and int(np.bitwise_count(y & ~x).sum()) <= len(b) - same


def test_small_pictures_never_hide_a_near_pair(spark):
    rnd, rows = np.random.default_rng(6), []
    for size in (1, 5, 40, 300, 2000):
        a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
        for changed in (0.0, 0.05, 0.1, 0.3, 0.9):
            b = np.unique(np.where(rnd.random(len(a)) < changed, rnd.integers(0, 1 << 63, len(a)).astype(np.uint64), a))
            same = len(np.intersect1d(a, b))
            near = neardups.WHOLE * same >= neardups.PART * (len(a) + len(b) - same)
            rows.append((len(rows), near, len(a), neardups.drawn(a).tolist(), len(b), neardups.drawn(b).tolist()))
    df = spark.createDataFrame(rows, "id int, near boolean, n_a int, d_a array<bigint>, n_b int, d_b array<bigint>")
    side = lambda s: df.select("id", "near", F.col(f"n_{s}").alias("n"), F.col(f"d_{s}").alias("drawn")).withColumn("small", neardups._folded())
    both = side("a").alias("x").join(side("b").alias("y"), F.expr("x.id = y.id")).selectExpr("x.near AS near", f"{neardups._told_apart('x', 'y')} AS told")
    got = [(r.near, r.told) for r in both.collect()]
    assert (True, True) not in got and got.count((False, True)) >= 4 and got.count((True, False)) >= 5
