"""Pending rows, shared prompts and lookups, with one key holding much of the table."""

import pytest
from pyspark.sql import functions as F

from loometric.operators import profile, relate


@pytest.fixture(scope="module")
def hot(spark):
    """Six hundred rows; one text holds half of them and a missing text some."""
    return spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 0, None).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("input"))


def test_pending_policies(spark, hot):
    done = spark.createDataFrame([("t1",), ("t1",), (None,)], "input string")
    rows = hot.collect()
    left = [r for r in rows if r["input"] not in ("t1", None)]
    assert sorted(relate.pending(hot, done).collect()) == sorted(left)
    first = {}
    for r in sorted(left):
        first.setdefault(r["input"], r["id"])
    once = relate.pending(hot.repartition(5), done, order_key="id", duplicates="once").collect()
    assert {r["input"]: r["id"] for r in once} == first and len(once) == len(first)
    assert relate.pending(hot, hot).count() == 0
    with pytest.raises(ValueError):
        relate.pending(hot, done, duplicates="once")


def test_hot_key_is_spread(spark, hot):
    """With salts, rows of one text reach many join partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = spark.createDataFrame([("none",)], "input string")
        df = relate.pending(hot, done).filter("input = 'hot'")
        parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_common_prompts_keep_copies(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "p", 2), ("b", "p", 3), ("a", "q", 4), ("c", "p", 5), ("c", "q", 6)],
                               "run string, prompt string, n int")
    assert sorted(r["n"] for r in relate.common_prompts(df).collect()) == [1, 2, 3, 5]


def test_lookup(spark):
    df = spark.createDataFrame([("A",), ("Z",)], "k string")
    names = spark.createDataFrame([("A", "Alpha")], "id string, name string")
    assert [r["v"] for r in relate.decode_labels(df, names, "k", "v").collect()] == ["Alpha", "Z"]
    assert [r["v"] for r in relate.encode_labels(df.limit(1), {"A": 4}, "k", "v").collect()] == [4]
    with pytest.raises(Exception, match="unknown label: Z"):
        relate.encode_labels(df, {"A": 4}, "k", "v").collect()


def test_zip_stops_at_the_shorter(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a"])], "l array<int>, r array<string>")
    assert [tuple(p) for p in df.select(relate.zip_arrays(df.l, df.r).alias("z")).first()["z"]] == [(1, "a")]


def test_leaderboard_edges(spark):
    rows = [("b", 4), ("b", 5), ("a", 4), ("a", 5), ("single", 3), ("none", None), ("big", 2**31), ("big", 2**31 + 1)]
    df = spark.createDataFrame(rows, "run string, score bigint")
    board = {r["run"]: r for r in profile.leaderboard(df.repartition(3)).collect()}
    assert list(board) == ["big", "a", "b", "single"]
    assert board["a"]["median_score"] == 4.5 and board["a"]["std_dev"] == pytest.approx(0.5 ** 0.5)
    assert board["single"]["std_dev"] == 0.0 and board["big"]["std_dev"] == pytest.approx(0.5 ** 0.5)


def test_coverage_counts_distinct_inputs(spark):
    runs = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "x"), ("s", None), ("s", "y")], "run string, input string")
    expected = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "input string")
    found = {r["run"]: (r["covered"], r["expected"]) for r in profile.coverage(runs, expected).collect()}
    assert found == {"r": (1, 3), "s": (0, 3)}


def test_failures(spark):
    df = spark.createDataFrame([(None,), ("x",), ("x",), ("y",)], "broken_reason string")
    row = profile.failure_accounting(df).first()
    assert (row["total"], row["broken"], row["valid"], row["broken_pct"], row["valid_pct"]) == (4, 3, 1, 75.0, 25.0)
    assert profile.failure_accounting(df.limit(0)).first()["broken_pct"] is None


def test_split_profile(spark):
    df = spark.range(103).select(F.lit("train").alias("split"))
    row = profile.split_profile(df, 2, 4).first()
    assert (row["rows"], row["steps_per_epoch"], row["eval_steps"]) == (103, 12, 2)
