"""What the physical plans must keep: pruning, pushdown, no needless shuffle, costly columns once."""

import re

import pytest
from conftest import DATA_DIR
from pyspark.sql import functions as F

from loometric.functions import computed, split_words
from loometric.operators import classmetrics as cm
from loometric.operators import prep, relate, sampling
from loometric.operators import textmetrics as tm
from loometric.plans import evaluation
from loometric.queries import catalog, views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return views.table(spark, DATA_DIR, "documents")


def test_length_filter_reads_two_columns(docs):
    plan = plan_of(prep.filter_max_tokens(docs, "text", 100).select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_filters_reach_the_scan_past_computed_columns(docs):
    df = computed(docs, words=split_words(F.col("text"))).filter("lang = 'en' AND size(words) > 3")
    plan = plan_of(df)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)", plan)
    assert plan.count("split(text") == 1


def test_sampling_needs_no_shuffle(docs):
    assert "Exchange" not in plan_of(sampling.sample_fraction(docs, "doc_id", 0.2, 1))
    exact = plan_of(sampling.sample_exact(docs, "doc_id", 0.2, 1))
    # whole rows are read once; only hashes of the key are counted and ranked
    assert exact.count("ReadSchema: struct<doc_id:bigint,text") == 1


def test_text_scores_shuffle_only_counts(docs):
    pairs = docs.select("doc_id", F.col("text").alias("c"), F.col("text").alias("r"))
    assert "Exchange" not in plan_of(tm.rouge_l_pairs(tm.rouge_n_pairs(pairs, "c", "r"), "c", "r"))
    bleu = plan_of(tm.corpus_bleu(pairs, "c", "r"))
    assert bleu.count("Exchange") == 1 and "partial_sum" in bleu


def test_counts_are_made_before_the_shuffle(spark, docs):
    plan = plan_of(cm.confusion_matrix(docs, "lang", "source", ["en", "fr"]))
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")


def test_pending_shuffles_digests_of_done_texts(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        items = docs.select("doc_id", F.col("text").alias("input"))
        plan = plan_of(relate.pending(items, items, order_key="doc_id", duplicates="once"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # texts travel once, with the final fetch by unique key
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert len(wide) == 2 and "_key" in plan
    assert "Exchange hashpartitioning(input" not in plan


def test_results_do_not_depend_on_partitions(spark):
    pred = views.fx_pred(spark, DATA_DIR).cache()
    try:
        several = [sorted(cm.per_class(pred.repartition(n), "t", "p").collect()) for n in (1, 3, 7)]
    finally:
        pred.unpersist()
    assert several[0] == several[1] == several[2]


def test_one_class_may_hold_most_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 100 == 0, "B").otherwise("O").alias("t"), F.lit("O").alias("p"))
    rows = {r["label"]: (r["support"], r["guesses"], r["hits"]) for r in cm.per_class(df, "t", "p").collect()}
    assert rows == {"O": (19800, 20000, 19800), "B": (200, 0, 0)}
    names = spark.createDataFrame([("O", "other")], "id string, name string")
    decoded = relate.decode_labels(df, names, "t", "v").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in decoded} == {"other": 19800, "B": 200}


def test_equal_rows_reach_more_than_one_salt(spark):
    df = spark.range(0, 1000, 1, 8).select(F.lit("same").alias("input"))
    assert df.select(relate._row_salt(df, 16).alias("s")).distinct().count() > 1


def test_long_pairs_meet_by_block_numbers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(tm.embedding_match_pairs(views.fx_vectors(spark, DATA_DIR)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(pair_id#\d+L?, _candidate_block#\d+, _reference_block#\d+", plan)


def test_repeated_label_keys_multiply_no_rows(spark):
    names = spark.createDataFrame([("O", "b"), ("O", "a")], "id string, name string")
    df = spark.createDataFrame([("O",), ("X",)], "t string")
    assert sorted(r["v"] for r in relate.decode_labels(df, names, "t", "v").collect()) == ["X", "a"]


def test_intersection_is_one_scan(spark):
    runs = views.fx_runs(spark, DATA_DIR)
    assert plan_of(relate.intersect_runs(runs, n_runs=5)).count("FileScan") == 1


def test_registry():
    assert len(catalog.QUERIES) >= 95 and len(catalog.CHECKS) >= 90
    assert not [n for n in catalog.QUERIES if re.match(r"op\d|.*pipeline", n)]


def test_prompted_report_of_one_pass(spark):
    rows = [(["A", "B"], ["A", "A"], None), (["A"], None, "bad_json"), (["B"], None, "bad_json"), (["B", "B"], ["B", "C"], None), (["A"], None, "no_response")]
    parsed = spark.createDataFrame(rows, "tags array<string>, pred_tags array<string>, broken_reason string")
    report = evaluation.prompted_ner_report(parsed, at=F.lit("2024-05-06 07:08:09").cast("timestamp")).orderBy("ord").collect()
    found = {(r["section"], r["metric"]): (r["value"], r["kind"]) for r in report}
    assert found["Dataset Information", "total_samples"] == (5, "count") and found["Dataset Information", "broken_percent"] == (60.0, "percent")
    assert found["Broken Responses", "bad_json"][0] == 2 and found["Performance Metrics", "accuracy"][0] == 0.5
    assert found["Macro Metrics", "f1"][0] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert [r["metric"] for r in report if r["section"] == "Confusion Matrix"] == ["A > A", "B > A", "B > B", "B > C"]
    assert {r["made"] for r in report} == {"2024-05-06 07:08:09"}
    nothing = evaluation.prompted_ner_report(parsed.where("false"))
    assert nothing.where("section = 'Confusion Matrix'").count() == 0


def test_reports_name_their_parts(spark):
    pairs = spark.createDataFrame([("a b c", "a b c"), ("x", "y")], "c string, r string")
    messages = spark.createDataFrame([("train", [("system", "s"), ("user", "one two")]), ("test", [("system", "s"), ("user", "one")])],
                                     "split string, messages array<struct<role:string,content:string>>")
    report = evaluation.summarization_report(pairs, "c", "r", messages).orderBy("ord").collect()
    assert [(r["metric"], r["value"]) for r in report[:4]] == [("test instances", 1.0), ("test avg_word_count", 1.0), ("train instances", 1.0),
                                                              ("train avg_word_count", 2.0)]
    assert [(r["metric"], r["value"]) for r in report[4:7]] == [("rouge1", 0.5), ("rouge2", 0.5), ("rougeL", 0.5)] and report[7]["metric"] == "bleu"
    labels = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "t int, p int")
    report = evaluation.sequence_classification_report(labels, "t", "p", messages).orderBy("ord").collect()
    assert [(r["metric"], r["value"]) for r in report[:3]] == [("test", 1.0), ("train", 1.0), ("accuracy", pytest.approx(2 / 3))]


def test_prompted_report_parses_answers_once(spark):
    """All parts of the report read one grouped count: the parsed rows are evaluated by one exchange."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed_reason(i):
        seen.add(1)
        return "bad_json" if i % 5 == 0 else None

    rows = spark.range(40).select("id", parsed_reason(F.col("id")).alias("broken_reason"), F.array(F.lit("O"), F.lit("B-PER")).alias("tags"),
                                  F.array(F.lit("O"), F.lit("O")).alias("pred_tags"))
    report = {r["metric"]: r["value"] for r in evaluation.prompted_ner_report(rows).collect()}
    assert report["broken_responses"] == 8 and report["bad_json"] == 8 and report["accuracy"] == 0.5 and report["B-PER > O"] == 32
    assert seen.value == 40
