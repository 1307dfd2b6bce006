"""Whole evaluation jobs put together from operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loometric.functions.stage import computed
from loometric.functions.text import fill_prompt
from loometric.operators import classmetrics as cm
from loometric.operators import profile, prep
from loometric.operators import textmetrics as tm
from loometric.operators.responses import parse_score
from loometric.sources import io
from loometric.streaming.score import score_batches


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Scores per class, then the macro and the weighted average, in one pass.

    Each class goes into its own line and, with its weight, into both averages.
    """
    def entry(line: int, label: Column, weight: Column) -> Column:
        return F.struct(F.lit(line).alias("line"), label.cast("string").alias("label"),
                        weight.cast("bigint").alias("weight"), "support", *cm.SCORES)

    lines = F.array(entry(0, F.col("label"), F.lit(1)), entry(1, F.lit("macro avg"), F.lit(1)),
                    entry(2, F.lit("weighted avg"), F.col("support")))
    weight = F.sum("weight")
    return (cm.per_class(df, truth, predicted).select(F.inline(lines)).groupBy("line", "label").agg(
        F.sum("support").alias("support"),
        *[F.when(weight > 0, F.sum(F.col(s) * F.col("weight")) / weight).otherwise(0.0).alias(s) for s in cm.SCORES])
        .drop("line"))


def ner_report(predictions: DataFrame, labels_col: str, predictions_col: str, train: DataFrame,
               tags_col: str, labels: dict[str, int], average: str = "weighted") -> DataFrame:
    """Metrics of stored token predictions and the profile of the training split."""
    flat = cm.flatten_valid(predictions, labels_col, predictions_col)
    counts = cm.pair_counts(flat, "truth", "predicted")
    classes = cm.per_class_from_counts(counts)
    scores = cm.all_scores(classes, average)
    lengths = profile.sequence_length_stats(train, tags_col)
    tags = cm.label_distribution(train, tags_col, labels)
    return (io.report_rows(scores, "Evaluation Metrics", 0)
            .unionByName(io.report_rows(lengths, "Dataset Summary", 100))
            .unionByName(tags.select(
                F.lit("Label Distribution").alias("section"), (F.lit(200) + F.col("id")).cast("bigint").alias("ord"),
                F.col("label").alias("metric"), F.col("n").cast("double").alias("value"), F.lit("count").alias("kind"))))


def _entries(section: str, first: int, values: dict[str, tuple[Column, str]]) -> Column:
    return F.array(*[F.struct(F.lit(section).alias("section"), F.lit(first + i).cast("bigint").alias("ord"), F.lit(name).alias("metric"),
                              value.cast("double").alias("value"), F.lit(kind).alias("kind")) for i, (name, (value, kind)) in enumerate(values.items())])


def _stamped(report: DataFrame, at: Column | None) -> DataFrame:
    """The report with the time it was made, the same in all its rows."""
    return report.withColumn("made", F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss"))


def _averages(cells: DataFrame, first: int) -> DataFrame:
    """Accuracy, and the weighted and the macro scores, of counted (truth, predicted) cells."""
    classes = cm.per_class_from_counts(cells)
    sums = classes.agg((F.sum("hits") / F.sum("support")).alias("accuracy"),
                       *[c.alias(f"weighted_{s}") for s, c in zip(cm.SCORES, cm.average_columns("weighted"))],
                       *[c.alias(f"macro_{s}") for s, c in zip(cm.SCORES, cm.average_columns("macro"))])
    rows = F.concat(_entries("Performance Metrics", first, {"accuracy": (F.col("accuracy"), "score")}),
                    *[_entries(f"{average.capitalize()} Metrics", first + 10 * k, {s: (F.col(f"{average}_{s}"), "score") for s in cm.SCORES})
                      for k, average in enumerate(("weighted", "macro"), 1)])
    return sums.select(F.inline(rows))


def _matrix_rows(cells: DataFrame, first: int) -> DataFrame:
    """The cells of a matrix in label order, one row for each that occurs."""
    order = F.row_number().over(Window.orderBy("truth", "predicted"))  # one row a cell: as many as pairs of labels
    return cells.select(F.lit("Confusion Matrix").alias("section"), (first + order - 1).cast("bigint").alias("ord"),
                        F.concat_ws(" > ", F.col("truth").cast("string"), F.col("predicted").cast("string")).alias("metric"),
                        F.col("n").cast("double").alias("value"), F.lit("count").alias("kind"))


def prompted_ner_report(parsed: DataFrame, tags_col: str = "tags", predicted_col: str = "pred_tags", reason_col: str = "broken_reason",
                        at: Column | None = None) -> DataFrame:
    """The whole report of a prompted tagging job: samples, broken ones by reason, scores of the valid ones, and their matrix.

    One grouped count over rows and token pairs serves everything. Columns: section, ord, metric, value, kind, made.
    """
    none = F.lit(None).cast("string")
    row = F.array(F.struct(F.lit("row").alias("what"), F.col(reason_col).alias("truth"), none.alias("predicted")))
    pairs = F.when(F.col(reason_col).isNull(), F.transform(F.arrays_zip(F.col(tags_col).alias("t"), F.col(predicted_col).alias("p")), lambda x: F.struct(
        F.lit("token").alias("what"), x["t"].alias("truth"), x["p"].alias("predicted"))))
    # what the parts of the report filter by are aggregates as well: a filter on a key would go down to the scan and each part parse all rows anew
    counts = (parsed.select(F.inline(F.concat(row, F.coalesce(pairs, F.slice(row, 1, 0))))).groupBy("what", "truth", "predicted")
              .agg(F.min("what").alias("_what"), F.min("truth").alias("_truth"), F.count(F.lit(1)).alias("n"))
              .select(F.col("_what").alias("what"), F.col("_truth").alias("truth"), "predicted", "n"))
    samples = counts.filter("what = 'row'")
    cells = counts.filter("what = 'token'").drop("what")
    broken = F.coalesce(F.sum(F.when(F.col("truth").isNotNull(), F.col("n"))), F.lit(0))
    total = samples.agg(F.sum("n").alias("total"), broken.alias("broken"))
    valid = F.col("total") - F.col("broken")
    sizes = total.select(F.inline(_entries("Dataset Information", 0, {
        "total_samples": (F.col("total"), "count"), "broken_responses": (F.col("broken"), "count"), "valid_samples": (valid, "count"),
        "broken_percent": (F.col("broken") * 100.0 / F.col("total"), "percent"), "valid_percent": (valid * 100.0 / F.col("total"), "percent")})))
    reasons = samples.filter("truth IS NOT NULL").select(
        F.lit("Broken Responses").alias("section"), (100 + F.row_number().over(Window.orderBy("truth"))).cast("bigint").alias("ord"),
        F.col("truth").alias("metric"), F.col("n").cast("double").alias("value"), F.lit("count").alias("kind"))
    return _stamped(sizes.unionByName(reasons).unionByName(_averages(cells, 200)).unionByName(_matrix_rows(cells, 1000)), at)


def sequence_classification_report(predictions: DataFrame, truth: str, predicted: str, splits: DataFrame, split_col: str = "split",
                                   at: Column | None = None) -> DataFrame:
    """The whole report of a classifier: rows of each split, scores, and the matrix of the labels that occur."""
    cells = cm.pair_counts(predictions, truth, predicted)
    sizes = splits.groupBy(split_col).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("Dataset Information").alias("section"), F.row_number().over(Window.orderBy(split_col)).cast("bigint").alias("ord"),
        F.col(split_col).cast("string").alias("metric"), F.col("n").cast("double").alias("value"), F.lit("count").alias("kind"))
    return _stamped(sizes.unionByName(_averages(cells, 200)).unionByName(_matrix_rows(cells, 1000)), at)


def summarization_report(pairs: DataFrame, candidate_col: str, reference_col: str, messages: DataFrame, messages_col: str = "messages",
                         split_col: str = "split", at: Column | None = None) -> DataFrame:
    """The whole report of a summarization job: rows and mean words of each split, ROUGE-1, ROUGE-2 and ROUGE-L means, and corpus BLEU."""
    lengths = profile.word_count_stats(messages, messages_col)
    names = [c for c in lengths.columns if c != split_col]
    place = F.row_number().over(Window.orderBy(split_col)) - 1
    parts = lengths.withColumn("_at", place).select(F.inline(F.array(*[F.struct(
        F.lit("Dataset Information").alias("section"), (10 * F.col("_at") + i).cast("bigint").alias("ord"),
        F.concat_ws(" ", split_col, F.lit(name)).alias("metric"), F.col(name).cast("double").alias("value"),
        F.lit("count" if isinstance(lengths.schema[name].dataType, IntegralType) else "score").alias("kind")) for i, name in enumerate(names)])))
    scored = tm.rouge_l_pairs(tm.rouge_n_pairs(pairs, candidate_col, reference_col), candidate_col, reference_col)
    rouge = tm.mean_scores(scored, "rouge1", "rouge2", "rougeL").select(F.inline(_entries(
        "ROUGE", 1000, {n: (F.col(n), "score") for n in ("rouge1", "rouge2", "rougeL")})))
    bleu = tm.corpus_bleu(pairs, candidate_col, reference_col).select(F.inline(_entries("BLEU", 2000, {"bleu": (F.col("bleu"), "score")})))
    return _stamped(parts.unionByName(rouge).unionByName(bleu), at)


def training_text(messages: DataFrame, max_tokens: int, messages_col: str = "messages",
                  template: prep.ChatTemplate | None = None, counter=None) -> DataFrame:
    """Messages, plain or stored as JSON, to rendered text within the token limit."""
    stored = messages.schema[messages_col].dataType.simpleString() == "string"
    parsed = messages.withColumn(
        messages_col, prep.parse_messages(F.col(messages_col))) if stored else messages
    text = computed(parsed, text=prep.render_chat(F.col(messages_col), template)).drop(messages_col)
    if counter is None:
        return prep.filter_max_tokens(text, "text", max_tokens)
    return prep.filter_max_tokens(text, "text", max_tokens, counter)


def judge_runs(runs: DataFrame, judge: Callable[[], Callable], template: str, prompt_cols: Sequence[str], results: str,
               run_col: str = "run") -> DataFrame:
    """The whole judge job: fill the prompt, ask the judge's model, parse its scores, keep them, rank the runs.

    Every row is kept in ``results`` once, with a null score where the judge failed or gave no
    whole number; the leaderboard is made from that table and counts these rows as ``unscored``.
    """
    asked = runs.withColumn("prompt", fill_prompt(template, *[F.col(c) for c in prompt_cols]))
    scored = score_batches(asked, judge, "prompt").withColumn("score", parse_score(F.col("response")))
    scored.drop("prompt", "error").write.mode("append").parquet(results)
    kept = runs.sparkSession.read.parquet(results)
    unscored = kept.groupBy(F.col(run_col).alias("run")).agg(F.count_if(F.col("score").isNull()).alias("unscored"))
    return unscored.join(profile.leaderboard(kept, run_col), "run", "left")


def leaderboard_lines(board: DataFrame) -> DataFrame:
    """Leaderboard rows as Markdown lines, best run first."""
    def metric(name: str, column: str, pattern: str):
        return F.format_string(f"- **{name}**: {pattern}", F.col(column))

    lines = F.concat_ws("\n", F.concat(F.lit("## "), "run"), metric("Average Score", "avg_score", "%.2f"),
                        metric("Median Score", "median_score", "%.1f"),
                        metric("Standard Deviation", "std_dev", "%.2f"))
    return board.orderBy(F.desc("avg_score"), "run").select("run", lines.alias("line"))


def matrix_report(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """A confusion matrix over fixed labels as Markdown table lines."""
    matrix = cm.confusion_matrix(df, truth, predicted, labels)
    return io.matrix_lines(cm.confusion_wide(matrix, labels), list(labels))
