"""ROUGE, BLEU and embedding matching against plain definitions."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loometric.operators import textmetrics as tm

TEXTS = st.lists(st.sampled_from(["the", "cat", "sat", "on", "a", "mat", "É", "şu", "the,"]), max_size=14).map(" ".join)


def grams(words, n):
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def f_measure(overlap, c, r):
    if not overlap:
        return 0.0
    p, q = overlap / c, overlap / r
    return 2 * p * q / (p + q)


def subsequence(a, b):
    """The usual table, row by row."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def plain_rouge(candidate, reference):
    c, r = ([w for w in re.split("[^a-z0-9]+", t.lower()) if w] for t in (candidate, reference))
    by_n = [f_measure(sum((grams(c, n) & grams(r, n)).values()), max(len(c) - n + 1, 0), max(len(r) - n + 1, 0)) for n in (1, 2)]
    return (*by_n, f_measure(subsequence(c, r), len(c), len(r)))


def plain_bleu(pairs):
    split = [(c.split(), r.split()) for c, r in pairs]
    matches = [sum(sum((grams(c, n) & grams(r, n)).values()) for c, r in split) for n in range(1, 5)]
    totals = [sum(max(len(c) - n + 1, 1) for c, _ in split) for n in range(1, 5)]
    c_len, r_len = sum(len(c) for c, _ in split), sum(len(r) for _, r in split)
    if matches[0] == 0:
        return 0.0
    brevity = 1.0 if c_len > r_len else math.exp(1 - r_len / c_len)
    return brevity * math.exp(sum(math.log(m / t if m else 2.2250738585072014e-308) for m, t in zip(matches, totals)) / 4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=6))
def test_any_pairs(spark, pairs):
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)], "id int, c string, r string").repartition(3, "id")
    scored = tm.rouge_l_pairs(tm.rouge_n_pairs(df, "c", "r"), "c", "r").orderBy("id").collect()
    for row, (c, r) in zip(scored, pairs):
        assert (row["rouge1"], row["rouge2"], row["rougeL"]) == pytest.approx(plain_rouge(c, r))
    assert tm.corpus_bleu(df, "c", "r").first()["bleu"] == pytest.approx(plain_bleu(pairs))


def test_same_text_scores_one(spark):
    df = spark.createDataFrame([(1, "one two three four five")], "id int, t string")
    row = tm.rouge_l_pairs(tm.rouge_n_pairs(df, "t", "t"), "t", "t").first()
    assert (row["rouge1"], row["rouge2"], row["rougeL"]) == (1.0, 1.0, 1.0)
    assert tm.corpus_bleu(df, "t", "t").first()["bleu"] == pytest.approx(1.0)


def test_default_words_are_ascii(spark):
    df = spark.createDataFrame([("kırmızı elma",)], "t string")
    assert df.select(tm.rouge_words(df.t)).first()[0] == ["k", "rm", "z", "elma"]
    assert df.select(tm.rouge_words(df.t, unicode=True)).first()[0] == ["kırmızı", "elma"]


def test_long_texts_are_scored_whole(spark):
    rng = np.random.default_rng(7)
    a, b = ([f"w{i}" for i in rng.integers(0, 40, 1500)] for _ in range(2))
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "c string, r string")
    row = tm.rouge_l_pairs(tm.rouge_n_pairs(df, "c", "r"), "c", "r").first()
    assert (row["rouge1"], row["rouge2"], row["rougeL"]) == pytest.approx(plain_rouge(" ".join(a), " ".join(b)))


def test_rouge_l_on_the_given_documents(spark):
    """The subsequence length on whole given texts against the usual table."""
    from conftest import DATA_DIR

    from loometric.queries import views

    df = views.fx_pairs(spark, DATA_DIR).orderBy("pair_id").limit(12)
    for row in tm.rouge_l_pairs(df, "generated", "expected").collect():
        assert row["rougeL"] == pytest.approx(plain_rouge(row["generated"], row["expected"])[2])


def test_embedding_match_in_blocks(spark):
    """Blocks far smaller than a side give what one matrix gives."""
    rng = np.random.default_rng(3)
    sides = {"candidate": rng.normal(size=(23, 8)), "reference": rng.normal(size=(17, 8))}
    sides["candidate"][4] = 0.0
    rows = [(1, s, i, v.tolist()) for s, m in sides.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "pair_id int, side string, pos int, vec array<double>").repartition(4)
    norm = {s: np.linalg.norm(m, axis=1, keepdims=True) for s, m in sides.items()}
    unit = {s: np.divide(m, norm[s], out=np.zeros_like(m), where=norm[s] > 0) for s, m in sides.items()}
    cos = unit["candidate"] @ unit["reference"].T
    p, r = cos.max(axis=1).mean(), cos.max(axis=0).mean()
    row = tm.embedding_match_pairs(df, block=5).first()
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((p, r, 2 * p * r / (p + r)))


def test_blocks_and_tiles_equal_the_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 40))] for _ in "ab")
        assert all(tm._closed(tm.subsequence_bits(a, b, block=n)[0], len(a)) == subsequence(a, b) for n in (1, 3, 64))
        states, carries, grown = {}, {}, 0
        for i in range(0, len(a), 5):
            for j in range(0, len(b), 4):
                states[i], carries[j] = tm.subsequence_bits(a[i:i + 5], b[j:j + 4], states.get(i), carries.get(j), block=2)
            grown += tm._closed(states[i], len(a[i:i + 5])) if b else 0
        assert grown == subsequence(a, b)


def test_long_pairs_take_linear_memory():
    rng = random.Random(8)
    a, b = ([f"w{rng.randrange(40_000)}" for _ in range(n)] for n in (20_000, 100_000))
    tracemalloc.start()
    state, carries = tm.subsequence_bits(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000 and len(state) == 2500 and len(carries) == len(b)
    same = [f"w{i % 30_000}" for i in range(100_000)]
    assert tm._closed(tm.subsequence_bits(same, same[1:])[0], len(same)) == len(same) - 1


def test_tiled_pairs_equal_pairs_in_a_row(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 90))), " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 60))), "x")
             for i in range(40)] + [(100, None, "a b", "x"), (101, "", "a " * 50, "x"), (102, "a " * 50, None, None), (103, "a b " * 40, "", "x")]
    df = spark.createDataFrame(texts, "key int, c string, r string, words string")
    plain = {r["key"]: r["rougeL"] for r in tm.rouge_l_pairs(df, "c", "r").collect()}
    for tile in (7, 30, 1000):
        tiled = tm.rouge_l_pairs(df, "c", "r", key_col="key", tile_words=tile)
        assert tiled.columns == ["key", "c", "r", "words", "rougeL"]
        assert {r["key"]: r["rougeL"] for r in tiled.collect()} == plain and tiled.count() == len(texts)
    assert tm.rouge_l_pairs(df.where("key < 0"), "c", "r", key_col="key", tile_words=2).count() == 0


def test_clipped_matches_by_ranks(spark, monkeypatch):
    monkeypatch.setattr(tm, "SLICE_WORDS", 50)
    rng = random.Random(10)
    pairs = [tuple(" ".join(rng.choices("abcd", k=rng.randrange(0, 60))) for _ in "cr") for _ in range(60)]
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)] + [(60, None, "a b c"), (61, "a", None)], "id int, c string, r string")
    words = [tm.split_words(F.col(side)) for side in "cr"]
    found = {r["id"]: r for r in tm._with_overlaps(df, *words, range(1, 5)).collect()}
    for i, (c, r) in enumerate(pairs):
        for n in range(1, 5):
            grams = [Counter(zip(*[t.split()[k:] for k in range(n)])) for t in (c, r)]
            assert (found[i][f"_c{n}"], found[i][f"_r{n}"], found[i][f"_o{n}"]) == (
                grams[0].total(), grams[1].total(), (grams[0] & grams[1]).total())
    assert found[60]["_c1"] == 0 and found[60]["_r1"] == 3 and found[60]["_o1"] is None and found[61]["_o2"] is None
    plan = tm.corpus_bleu(df, "c", "r")._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "zip_with" not in plan


def test_tiles_pass_numbers_of_shared_words(spark, monkeypatch):
    """Between rounds there are numbers of words that both texts have, and no text is written twice."""
    written = {}

    def folder(session, purpose):
        path = shared_folder(session, purpose)
        written.setdefault(purpose, []).append(path)
        return path

    shared_folder = tm.shared_folder
    monkeypatch.setattr(tm, "shared_folder", folder)
    r = [f"w{i % 7}" if i % 2 else f"only{i}" for i in range(60)]
    c = r[1::2] + ["other"] * 9
    df = spark.createDataFrame([(1, " ".join(c), " ".join(r)), (2, "x " * 30, "y " * 30), (3, "x", None)], "key int, c string, r string")
    found = {row["key"]: row["rougeL"] for row in tm.rouge_l_pairs(df, "c", "r", key_col="key", tile_words=10).collect()}
    assert found[1] == pytest.approx(f_measure(30, len(c), len(r))) and found[2] == 0.0
    parts = spark.read.parquet(*written["lcs-parts"])
    assert parts.schema["words"].dataType.simpleString() == "array<int>" and parts.agg(F.sum(F.size("words"))).first()[0] == 60
    assert spark.read.parquet(*written["lcs-diagonal"]).count() == 9 and len(written["lcs-diagonal"]) == 5
    assert spark.read.parquet(*written["long-pairs"]).columns == ["key", "c", "r", "_cn", "_rn"]


def test_subsequences_of_null_empty_and_unlike_texts(spark):
    rng = random.Random(5)
    pairs = [(["a"], None), (None, ["a"]), ([], ["a"]), (["a", None, "b"], ["b", None]), (["a"], ["b"])]
    pairs += [([rng.choice("abcde") for _ in range(rng.randrange(40))], [rng.choice("abcxy") for _ in range(rng.randrange(40))]) for _ in range(30)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").coalesce(1)
    found = [r[0] for r in df.select(tm.common_subsequence("a", "b").alias("n"), "i").orderBy("i").collect()]
    assert found[:5] == [None, None, 0, 1, 0]
    assert found[5:] == [subsequence(a, b) for a, b in pairs[5:]]
