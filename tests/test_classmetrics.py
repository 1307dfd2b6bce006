"""Published matrices give the published averages; properties hold on any labels."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loometric.operators import classmetrics as cm
from loometric.plans import evaluation

TAGS = ["B-LOC", "B-ORG", "B-PER", "I-LOC", "I-ORG", "I-PER", "O"]

# Published confusion matrices with their published scores (fixed values).
PROMPTED = """
 232    9    2  160    3    0    3
 241   14    1  227    8    1    3
 320   36    0  137    9    4    2
 151   12    0  168   10    0    1
 374   77   15  440   52    7   13
 172   26    5  399   38    1    4
1778  229   86 1562  159   97  486
"""
TRAINED = """
593 52 71 2 2 1 179
82 450 64 0 7 1 227
45 44 915 0 3 11 295
5 0 0 61 22 8 10
4 1 0 16 447 9 108
1 0 2 4 13 630 12
98 92 146 12 127 29 37158
"""
PUBLISHED = [
    (PROMPTED, "weighted", 0.5694, 0.1226, 0.1355, 0.1226),
    (PROMPTED, "macro", 0.1864, 0.1789, 0.0769, 0.1226),
    (TRAINED, "weighted", 0.9550, 0.9571, 0.9557, 0.9571),
    (TRAINED, "macro", 0.7769, 0.7393, 0.7558, 0.9571),
]


def counts_of(spark, matrix):
    rows = [list(map(int, line.split())) for line in matrix.strip().splitlines()]
    return spark.createDataFrame(
        [(t, p, n) for t, row in zip(TAGS, rows) for p, n in zip(TAGS, row) if n], "truth string, predicted string, n bigint")


@pytest.mark.parametrize("matrix,average,precision,recall,f1,accuracy", PUBLISHED)
def test_published_scores(spark, matrix, average, precision, recall, f1, accuracy):
    row = cm.all_scores(cm.per_class_from_counts(counts_of(spark, matrix)), average).first()
    assert row["precision"] == pytest.approx(precision, abs=1e-4)
    assert row["recall"] == pytest.approx(recall, abs=1e-4)
    assert row["f1"] == pytest.approx(f1, abs=1e-4)
    assert row["accuracy"] == pytest.approx(accuracy, abs=1e-4)


def test_published_matrix_from_rows(spark):
    """The rows behind a matrix give the matrix back, cell by cell and as a report."""
    counts = counts_of(spark, PROMPTED)
    rows = counts.select("truth", "predicted", F.explode(F.sequence(F.lit(1), F.col("n"))))
    dense = cm.confusion_matrix(rows, "truth", "predicted", TAGS)
    assert dense.count() == 49 and dense.agg(F.sum("n")).first()[0] == 7774
    lines = [r["line"] for r in evaluation.matrix_report(rows, "truth", "predicted", TAGS).collect()]
    assert lines[0] == "|  | B-LOC | B-ORG | B-PER | I-LOC | I-ORG | I-PER | O |"
    assert lines[2] == "| B-LOC | 232 | 9 | 2 | 160 | 3 | 0 | 3 |"
    assert len(lines) == 9


def test_fixed_labels_leave_others_out(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "x"), ("b", "a")], "t string, p string")
    cells = {(r["truth"], r["predicted"]): r["n"] for r in cm.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells["a", "a"] == 1 and cells["b", "a"] == 1 and cells["c", "c"] == 0
    seen = {(r["truth"], r["predicted"]): r["n"] for r in cm.confusion_matrix(df, "t", "p").collect()}
    assert seen == {("a", "a"): 1, ("a", "x"): 1, ("b", "a"): 1}


def test_binary_scores_positive_class_only(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "t int, p int")
    row = cm.precision_recall_f1(df, "t", "p", "binary").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)
    none = cm.precision_recall_f1(df.filter("t = 0 AND p = 0"), "t", "p", "binary").first()
    assert none["f1"] == 0.0


def test_label_distribution_reports_unknown_tags(spark):
    df = spark.createDataFrame([(["O", "B-X", "O"],), (["Z"],)], "tags array<string>")
    rows = [(r["label"], r["id"], r["n"]) for r in cm.label_distribution(df, "tags", {"B-X": 0, "I-X": 1, "O": 2}).collect()]
    assert rows == [("B-X", 0, 1), ("I-X", 1, 0), ("O", 2, 2), ("Z", None, 1)]
    with pytest.raises(Exception, match="unknown tag: Z"):
        cm.label_distribution(df, "tags", {"B-X": 0, "I-X": 1, "O": 2}, strict=True).collect()


def plain_scores(pairs):
    classes = sorted({x for pair in pairs for x in pair})
    out = []
    for c in classes:
        hits = sum(t == p == c for t, p in pairs)
        guesses, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        p, r = hits / guesses if guesses else 0.0, hits / support if support else 0.0
        out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, support))
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=30))
def test_any_labels(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, p string").repartition(3)
    plain = plain_scores(pairs)
    weighted = cm.all_scores(cm.per_class(df, "t", "p"), "weighted").first()
    macro = cm.precision_recall_f1(df, "t", "p", "macro").first()
    total = len(pairs)
    assert weighted["recall"] == pytest.approx(weighted["accuracy"])
    assert weighted["f1"] == pytest.approx(sum(f * s for *_, f, s in plain) / total)
    assert macro["precision"] == pytest.approx(sum(p for p, *_ in plain) / len(plain))
    assert macro["f1"] == pytest.approx(sum(f for _, _, f, _ in plain) / len(plain))
    assert cm.confusion_matrix(df, "t", "p").agg(F.sum("n")).first()[0] == total
