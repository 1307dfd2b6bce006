"""Text functions, chat rendering, label alignment, masking, responses and samples."""

import pytest
from pyspark.sql import functions as F

from loometric import functions as fn
from loometric.fixed import WHITESPACE_CHARS
from loometric.operators import prep, relate, responses, sampling
from loometric.plans import evaluation

MESSAGES = prep.MESSAGES_TYPE


def one(spark, column, **values):
    schema = {str: "string", int: "int", float: "double"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {schema[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_white_space_is_pythons(spark):
    text = "".join(f"{c}w{i}" for i, c in enumerate(WHITESPACE_CHARS)) + "　"
    assert one(spark, fn.split_words(F.col("t")), t=text) == text.split()
    assert one(spark, fn.strip(F.col("t")), t="\x1c  a b 　\t") == "a b"
    assert one(spark, fn.word_count(F.col("t")), t=" \n ") == 0


def test_prompt_keeps_percent_signs_and_gaps(spark):
    assert one(spark, fn.fill_prompt("50% of {}: {}!", F.col("a"), F.col("b")), a="{}", b="%s") == "50% of {}: %s!"
    with pytest.raises(ValueError):
        fn.fill_prompt("{}", F.lit("a"), F.lit("b"))


def test_names(spark):
    assert one(spark, fn.run_name(F.col("p")), p="org/model-1b") == "model-1b"
    assert one(spark, fn.safe_name(F.col("p")), p="/media/x") == "_media_x"
    assert one(spark, fn.strip_suffix(F.col("p")), p="m_filtered") == "m"
    assert one(spark, fn.entity_type(F.col("p")), p="B-LOC") == "LOC"
    assert one(spark, fn.entity_type(F.col("p")), p="O") is None
    assert one(spark, fn.format_metric(F.col("p"), 2, True), p=12.345678) == "12.35%"


def test_user_tokenizer_counts(spark):
    count = fn.token_counter(lambda: list)
    assert one(spark, count(F.col("t")), t="abcd") == 4


def chat(spark, messages, **options):
    df = spark.createDataFrame([(messages,)], f"m {MESSAGES}")
    return df.select(prep.render_chat(F.col("m"), **options).alias("x")).first()["x"]


def test_chat_turns(spark):
    messages = [("system", "Be brief."), ("user", " hi "), ("assistant", "hello")]
    assert chat(spark, messages) == ("<bos><start_of_turn>user\nBe brief.\n\nhi<end_of_turn>\n"
                                     "<start_of_turn>model\nhello<end_of_turn>\n")
    assert chat(spark, messages[1:2], add_generation_prompt=True) == (
        "<bos><start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\n")
    plain = prep.ChatTemplate(bos="", turn_start="[", turn_end="]", role_names={}, fold_system=False)
    assert chat(spark, messages, template=plain) == "[system\nBe brief.][user\nhi][assistant\nhello]"
    assert chat(spark, []) == "<bos>"


def test_stored_messages_to_training_text(spark):
    df = spark.createDataFrame([(1, '[{"role":"user","content":"a b c"}]'), (2, '[{"role":"user","content":"a"}]')],
                               "id int, messages string")
    kept = evaluation.training_text(df, 7).collect()
    assert [r["id"] for r in kept] == [2]  # strictly fewer than max - 3


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>")
    rows = df.select(prep.pad_truncate(df.a, 2, F.lit(0)).alias("p"), prep.attention_mask(df.a, 2).alias("m")).collect()
    assert [tuple(r) for r in rows] == [([1, 2], [1, 1]), ([1, 0], [1, 0]), ([0, 0], [0, 0])]


def test_alignment(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None, 1, 0], ["A", "B"])], "w array<int>, t array<string>")
    ids = relate.label_map({"A": 3, "B": 4})
    assert df.select(prep.align_labels(df.w, df.t, ids).alias("x")).first()["x"] == [-100, 3, -100, 4, -100, 4, 3]
    short = relate.label_map({"A": 3})
    assert df.select(prep.align_labels(df.w, df.t, short, strict=False).alias("x")).first()["x"][3] == -100
    with pytest.raises(Exception, match="unknown tag: B"):
        df.select(prep.align_labels(df.w, df.t, short)).collect()


@pytest.mark.parametrize("ids,labels", [
    ([9, -1, 5, -2, -3, 6, 7, -1, 8, -2, -3, 4], [-100] * 5 + [6, 7] + [-100] * 4 + [4]),
    ([-2, -3, 5, -2, -3, 6], [-100, -100, 5, -2, -3, 6]),  # a second answer mark is part of the answer
    ([1, 2, -2, 3], [-100] * 4),  # half a mark is none
    ([-1, 1, -2, -3], [-100] * 4),
    ([], []),
])
def test_masking(spark, ids, labels):
    df = spark.createDataFrame([(ids,)], "a array<int>")
    assert df.select(prep.mask_prompt(df.a, [-1], [-2, -3]).alias("x")).first()["x"] == labels


def test_response_spans(spark):
    text = "<start_of_turn>user\nq<start_of_turn>model\na\nb<start_of_turn>user\nr<start_of_turn>model\nc"
    assert one(spark, prep.response_spans(F.col("t")), t=text) == ["a\nb", "c"]


@pytest.mark.parametrize("raw,last,first,between,word", [
    ("user\nq\nmodel\n a \nmodel\nb ", "b ", "a \nmodel\nb", " a \n", "a \nmodel\nb"),
    ("only model text ", "only model text ", "only model text", None, "text"),
    (" plain ", " plain ", "plain", None, "plain"),
])
def test_extraction(spark, raw, last, first, between, word):
    got = [one(spark, responses.extract_response(F.col("r"), m), r=raw) for m in ("last", "first", "word")]
    assert got == [last, first, word]
    if between is None:
        with pytest.raises(Exception, match="no response mark"):
            one(spark, responses.extract_response(F.col("r"), "between"), r=raw)
    else:
        assert one(spark, responses.extract_response(F.col("r"), "between"), r=raw) == between


@pytest.mark.parametrize("raw,score", [("5", 5), (" +4\n", 4), ("-1", -1), ("1_0", 10), ("4.0", None), ("", None),
                                       ("iyi", None), ("7", 7), ("5 5", None)])
def test_scores(spark, raw, score):
    assert one(spark, responses.parse_score(F.col("r")), r=raw) == score
    if score is not None:
        inside = one(spark, responses.parse_score(F.col("r"), valid_range=(1, 5)), r=raw)
        assert inside == (score if 1 <= score <= 5 else None)


@pytest.mark.parametrize("response,reason", [
    ('{"entities":[{"kelime":"a","etiket":"O"},{"kelime":"b","etiket":"NEW"}]}', None),
    (None, "no_response"), ("{", "bad_json"), ("[1,2]", "bad_shape"), ('"ab"', "bad_shape"),
    ('{"entities":"ab"}', "bad_shape"), ('{"entities":null}', "bad_shape"), ("{}", "length_mismatch"),
    ('{"entities":[{"etiket":"O"}]}', "length_mismatch"), ('{"entities":[{"etiket":"O"},{"kelime":"b"}]}', "missing_label"),
    ('{"entities":["x","y"]}', "missing_label"),
])
def test_structured_answers(spark, response, reason):
    df = spark.createDataFrame([(["a", "b"], response)], "tokens array<string>, response string")
    row = responses.parse_structured_response(df).first()
    assert row["broken_reason"] == reason
    assert row["pred_tags"] == (["O", "NEW"] if reason is None else None)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for sample in (lambda d: sampling.shuffle_rows(d, "k", 5), lambda d: sampling.sample_fraction(d, "k", 0.2, 5),
                   lambda d: sampling.sample_exact(d, "k", 0.2, 5)):
        first, second = sample(df.repartition(3)).collect(), sample(df.repartition(7)).collect()
        assert sorted(first) == sorted(second)
    order = [r["k"] for r in sampling.shuffle_rows(df.repartition(3), "k", 5).collect()]
    assert order == [r["k"] for r in sampling.shuffle_rows(df.repartition(7), "k", 5).collect()] and order != sorted(order)
    assert order != [r["k"] for r in sampling.shuffle_rows(df, "k", 6).collect()]
    for share in (0.0, 0.001, 0.2, 0.9999, 1.0):
        kept = [r["k"] for r in sampling.sample_exact(df, "k", share, 5).collect()]
        assert sorted(kept) == sorted(order[:int(1000 * share)])


def test_best_run(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", None)], "run string, m double")
    assert sampling.best_run(df, "m").first()["run"] == "a"
    assert sampling.best_run(df.filter("m IS NOT NULL").union(spark.createDataFrame([("z", 0.1)], df.schema)), "m",
                             greater_is_better=False).first()["run"] == "z"
