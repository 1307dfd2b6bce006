"""Spans, matching, sheets and subwords against independent plain versions."""

import itertools
import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loometric.operators import relate, spans

TAG = st.sampled_from(["O", "B-LOC", "I-LOC", "B-PER", "I-PER"])


def plain_spans(tags):
    """Spans by grouping: each B opens a number, an I keeps it only after its own kind."""
    numbers, opened = [], 0
    for before, tag in zip(["O", *tags], tags):
        if tag.startswith("B-"):
            opened += 1
            numbers.append(opened)
        else:
            goes_on = tag.startswith("I-") and before[1:] == tag[1:] and numbers[-1:] != [0] and bool(numbers)
            numbers.append(numbers[-1] if goes_on else 0)
    return [(" ".join(f"w{i}" for i, _ in group), tags[group[0][0]][2:])
            for n, group in ((n, list(g)) for n, g in itertools.groupby(enumerate(numbers), key=lambda x: x[1])) if n]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(TAG, max_size=12), min_size=1, max_size=12))
def test_any_tags(spark, rows):
    df = spark.createDataFrame([(i, [f"w{k}" for k in range(len(t))], t) for i, t in enumerate(rows)],
                               "id int, tokens array<string>, tags array<string>")
    found = df.select("id", spans.decode_bio(df.tokens, df.tags).alias("s")).orderBy("id").collect()
    assert [[tuple(s) for s in r["s"]] for r in found] == [plain_spans(t) for t in rows]


def test_orphans_and_names(spark):
    df = spark.createDataFrame([(list("abcdef"), ["I-LOC", "B-LOC", "I-LOC", "I-PER", "B-X", "I-X"])],
                               "tokens array<string>, tags array<string>")
    row = df.select(spans.decode_bio(df.tokens, df.tags, {"LOC": "Location"}).alias("s")).first()["s"]
    assert [tuple(s) for s in row] == [("b c", "Location"), ("e f", "X")]


def plain_matches(true, pred):
    free, pairs = dict(enumerate(true)), []
    for text, label in pred:
        fit = [i for i, (t, other) in free.items() if other == label and set(t.lower().split()) & set(text.lower().split())]
        pairs.append((label if fit else "None", label))
        if fit:
            del free[min(fit)]
    return pairs + [(label, "None") for _, label in free.values()]


SPAN = st.tuples(st.lists(st.sampled_from("abcA"), max_size=3).map(" ".join), st.sampled_from(["X", "Y"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.tuples(st.lists(SPAN, max_size=6), st.lists(SPAN, max_size=6)), min_size=1, max_size=8))
def test_any_spans_match_greedily(spark, docs):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(docs)],
                               f"id int, true {spans.SPANS_TYPE}, pred {spans.SPANS_TYPE}")
    found = spans.match_entities(df).orderBy("id").collect()
    assert [[tuple(m) for m in r["matches"]] for r in found] == [plain_matches(t, p) for t, p in docs]


def test_none_lowers_the_macro_average(spark):
    df = spark.createDataFrame([([("Ankara", "LOC"), ("Ali", "PER")], [("ankara city", "LOC")])],
                               f"true {spans.SPANS_TYPE}, pred {spans.SPANS_TYPE}")
    row = spans.entity_overlap_scores(df).first()
    assert (row["precision"], row["recall"], row["support"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 2)


SHEET = [
    (0, None, "Cevap: before any question"), (1, 7.0, "Soru: first\nline Soru:"), (2, None, "plain"),
    (3, None, " Cevap: one"), (4, None, "Cevap: two "), (5, None, "İlgili Yasa: law 5"), (6, None, "x Soru: second Cevap: no"),
    (7, None, None), (8, 9.0, "Soru: third"),
]
ITEMS = [
    (0, None, None, "before any question", None), (1, 7, "first line", "two", "law 5"),
    (2, None, "x  second Cevap: no", None, None), (3, 9, "third", None, None),
]


@pytest.mark.parametrize("chunk", [1, 2, 3, 50_000])
def test_sheet_in_any_chunks(spark, chunk):
    rows = [(source, *row) for source in ("a", "b") for row in SHEET]
    df = spark.createDataFrame(rows, "source string, row_no int, col_b double, text string").repartition(5)
    found = spans.extract_qa(df, chunk=chunk).orderBy("source", "item").collect()
    assert [tuple(r)[1:] for r in found if r["source"] == "a"] == ITEMS
    assert len(found) == 2 * len(ITEMS)


def test_subwords_merge(spark):
    pieces = [("<s>", 0, 0, 5), ("Is", 0, 2, 1), ("tan", 2, 5, 2), ("Ġ", 5, 6, 6), ("ĠAli", 6, 9, 3), ("Ġpad", 0, 0, 4)]
    df = spark.createDataFrame([([p[0] for p in pieces], [p[1:3] for p in pieces], [p[3] for p in pieces])],
                               "sub array<string>, off array<struct<start:int,end:int>>, pred array<int>")
    names = relate.label_map({i: f"L{i}" for i in range(7)})
    row = df.select(spans.merge_subwords(df.sub, df.off, df.pred, names).alias("m"),
                    spans.merge_subwords(df.sub, df.off, df.pred, names, max_length=2).alias("cut")).first()
    assert [tuple(m) for m in row["m"]] == [("Is", "L1"), ("", "L6"), ("Ali", "L3")]
    assert [tuple(m) for m in row["cut"]] == [("Is", "L1")]


def test_entity_threshold(spark):
    df = spark.createDataFrame([([("a", "X", 0.5), ("b", "X", 0.49), ("c", "Y", 0.9)],)],
                               "e array<struct<text:string,label:string,score:double>>")
    row = df.select(spans.filter_entities(F.col("e"), 0.5, ["X"]).alias("k")).first()["k"]
    assert [r["text"] for r in row] == ["a"]


def test_many_spans_are_matched_in_linear_time(spark):
    def many(n):
        return [{"text": f"common w{i}", "label": "L"} for i in range(n)]

    kind = "array<struct<text:string,label:string>>"
    df = spark.createDataFrame([(many(4000), many(4000))], f"true {kind}, pred {kind}")
    found = spans.match_entities(df).select(F.size("matches").alias("n"), F.size(F.filter("matches", lambda m: m["truth"] == m["predicted"])).alias("k")).first()
    assert tuple(found) == (4000, 4000)


@pytest.mark.parametrize("chunk", [2, 3, 7])
def test_long_form_equals_the_array_form(spark, chunk):
    rng = random.Random(chunk)
    tags = ["O", "B-LOC", "I-LOC", "I-LOC", "B-PER", "I-PER", None]
    docs = [(d, [f"t{i}" for i in range(n)], [rng.choice(tags) for _ in range(n)]) for d, n in enumerate([0, 1, 2, 6, 7, 40, 200])]
    docs += [(50, [f"t{i}" for i in range(30)], ["B-LOC"] + ["I-LOC"] * 29), (51, ["a", "b", "c"], ["I-LOC"] * 3), (None, ["x", "y"], ["B-PER", "I-PER"])]
    df = spark.createDataFrame(docs, "doc int, tokens array<string>, tags array<string>")
    names = {"LOC": "Location", "PER": "Person"}
    array_form = df.select("doc", F.inline(spans.decode_bio(F.col("tokens"), F.col("tags"), names))).where("doc IS NOT NULL")
    rows = df.select("doc", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "t")).select("doc", (F.col("pos") * 2).alias("pos"), "t.tokens", "t.tags")
    found = spans.decode_bio_long(rows.repartition(3), "doc", "pos", "tokens", "tags", names, chunk=chunk).where("doc IS NOT NULL")
    assert sorted(map(tuple, found.select("doc", "text", "label").collect())) == sorted(map(tuple, array_form.collect()))
    whole = found.where("doc = 50").first()
    assert (whole["start"], whole["stop"]) == (0, 58)


def test_subwords_in_long_form(spark):
    rows = [(1, [("x", 0, 0, 0), ("ab", 0, 2, 1), ("c", 2, 3, 2), ("\u0120d", 4, 5, 0), ("\u0120e", 0, 0, 1), ("\u0120f", 6, 7, 2)])]
    df = spark.createDataFrame(rows, "doc int, s array<struct<subword:string,start:int,end:int,pred:int>>")
    long = df.select("doc", F.posexplode("s").alias("pos", "s")).select("doc", "pos", "s.*")
    for limit in (None, 5):
        found = spans.merge_subwords_long(long, {0: "A", 1: "B", 2: "C"}, limit, doc_col="doc").orderBy("pos").collect()
        whole = df.select(F.inline(spans.merge_subwords(F.transform("s", lambda x: x["subword"]), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))),
                                                     F.transform("s", lambda x: x["pred"]), relate.label_map({0: "A", 1: "B", 2: "C"}), limit))).collect()
        assert [(r["word"], r["label"]) for r in found] == [(r["word"], r["label"]) for r in whole] and found


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (1, 3), (5, 10_000)])
def test_long_form_settles_neighbours_before_the_shuffle(spark, parts, batch):
    rng = random.Random(parts + batch)
    tags = ["O", "O", "O", "B-LOC", "I-LOC", "I-LOC", "B-PER", "I-PER", None]
    docs = [(d, [f"t{i}" for i in range(n)], [rng.choice(tags) for _ in range(n)]) for d, n in enumerate([0, 1, 2, 9, 60, 200])]
    docs += [(50, [f"t{i}" for i in range(30)], ["B-LOC"] + ["I-LOC"] * 29), (51, [f"t{i}" for i in range(2000)], ["O"] * 1999 + ["B-PER"])]
    df = spark.createDataFrame(docs, "doc int, tokens array<string>, tags array<string>")
    array_form = df.select("doc", F.inline(spans.decode_bio(F.col("tokens"), F.col("tags"))))
    rows = df.select("doc", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "t")).select("doc", "pos", "t.tokens", "t.tags")
    rows = rows.coalesce(1) if parts == 1 else rows.repartition(parts)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = spans.decode_bio_long(rows, "doc", "pos", "tokens", "tags", chunk=7)
        assert sorted(map(tuple, found.select("doc", "text", "label").collect())) == sorted(map(tuple, array_form.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_tokens_outside_spans_are_not_shuffled():
    n = 1000
    tags = ["O"] * n
    tags[500], tags[501] = "B-X", "I-X"
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * n), pa.array(range(n), pa.int32()), pa.array(["w"] * n), pa.array(tags)],
                                       names=["doc", "part", "pos", "token", "tag"])
    left = pa.Table.from_batches(spans._neighbours(iter([batch]))).to_pylist()
    assert [(r["pos"], r["known"], r["before"], r["piece"]["token"]) for r in left] == [(500, True, "O", "w"), (501, True, "B-X", "w"), (999, True, "O", None)]
