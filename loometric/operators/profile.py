"""Dataset profiles, judge leaderboards, coverage and failure accounting."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loometric.functions.text import word_count
from loometric.operators.prep import message_at
from loometric.operators.relate import digest


def split_profile(df: DataFrame, batch_size: int, accumulation: int = 1, evals_per_epoch: int = 5,
                  split_col: str = "split") -> DataFrame:
    """Rows, optimizer steps per epoch and evaluation interval of each split."""
    steps = F.expr(f"rows div {batch_size * accumulation}")
    return (df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("steps_per_epoch", steps)
            .withColumn("eval_steps", F.expr(f"steps_per_epoch div {evals_per_epoch}")))


def sequence_length_stats(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    return df.agg(F.avg(F.size(tokens_col)).alias("avg_length"))


def word_count_stats(df: DataFrame, messages_col: str = "messages", split_col: str = "split",
                     index: int = 1) -> DataFrame:
    """Rows and mean word count of the n-th message (1 = user) per split."""
    counted = df.select(split_col, word_count(message_at(F.col(messages_col), index)).alias("_words"))
    return counted.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("instances"), F.avg("_words").alias("avg_word_count"))


def leaderboard(scores: DataFrame, run_col: str = "run", score_col: str = "score") -> DataFrame:
    """Mean, median and sample deviation of whole-number scores per run, best mean first.

    Scores with a fraction are no judge's scores and are left out, as nulls are. Rows shrink to one per (run, score) before anything is ordered, and the sums are
    exact, so the result does not depend on partitioning. Runs without a score vanish.
    """
    wide = "decimal(38,0)"
    levels = (scores.filter(F.col(score_col).isNotNull() & (F.col(score_col).cast("bigint") == F.col(score_col)))
              .groupBy(F.col(run_col).alias("run"), F.col(score_col).cast("bigint").alias("score"))
              .agg(F.count(F.lit(1)).alias("n")))
    by_score = W.partitionBy("run").orderBy("score")
    placed = levels.withColumns({
        "upto": F.sum("n").over(by_score),
        "total": F.sum("n").over(W.partitionBy("run")),
    })

    def holds(rank):  # this score level covers the given rank
        return (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)

    lower = F.expr("(total + 1) div 2")
    upper = F.expr("total div 2 + 1")
    score, n = F.col("score").cast(wide), F.col("n").cast(wide)
    grouped = placed.groupBy("run").agg(
        F.sum("n").alias("scored"),
        F.sum(score * n).alias("_s1"),
        F.sum(score * score * n).alias("_s2"),
        ((F.max(F.when(holds(lower), F.col("score"))) + F.max(F.when(holds(upper), F.col("score")))) / 2.0)
        .alias("median_score"),
    )
    count, s1, s2 = F.col("scored").cast("double"), F.col("_s1").cast(wide), F.col("_s2").cast(wide)
    spread = (F.col("scored").cast(wide) * s2 - s1 * s1).cast("double")
    return grouped.select(
        "run", "scored",
        (F.col("_s1").cast("double") / count).alias("avg_score"),
        "median_score",
        F.when(count > 1, F.sqrt(spread / (count * (count - 1)))).otherwise(0.0).alias("std_dev"),
    ).orderBy(F.desc("avg_score"), "run")


def coverage(runs: DataFrame, expected: DataFrame, on: str = "input", run_col: str = "run") -> DataFrame:
    """Share of the distinct expected inputs found in each run."""
    wanted = expected.select(digest(F.col(on)).alias("_key")).filter(F.col(on).isNotNull()).distinct()
    found = runs.select(run_col, F.when(F.col(on).isNotNull(), digest(F.col(on))).alias("_key")).distinct()
    total = wanted.select(F.count(F.lit(1))).scalar()
    return (found.join(wanted.withColumn("_hit", F.lit(1)), "_key", "left")
            .groupBy(run_col).agg(F.count("_hit").alias("covered"))
            .withColumn("expected", total)
            .withColumn("coverage", F.col("covered") / F.col("expected") * 100))


def failure_accounting(df: DataFrame, reason_col: str = "broken_reason") -> DataFrame:
    """Total, broken and valid rows with their percentages."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count(reason_col).alias("broken"))
    return counts.select(
        "total", "broken", (F.col("total") - F.col("broken")).alias("valid"),
        (F.col("broken") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("broken_pct"),
        ((F.col("total") - F.col("broken")) * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("valid_pct"),
    )


def failures_by_reason(df: DataFrame, reason_col: str = "broken_reason") -> DataFrame:
    return df.filter(F.col(reason_col).isNotNull()).groupBy(reason_col).agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Throughput:
    rows: int
    seconds: float

    @property
    def seconds_per_row(self) -> float:
        return self.seconds / self.rows if self.rows else 0.0


def scoring_throughput(scored: DataFrame, write: Callable[[DataFrame], None]) -> Throughput:
    """Run ``write`` once and report rows and wall time without a second pass."""
    seen = Observation()
    watched = scored.observe(seen, F.count(F.lit(1)).alias("rows"))
    begin = time.perf_counter()
    write(watched)
    return Throughput(seen.get["rows"], time.perf_counter() - begin)
