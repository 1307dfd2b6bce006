"""Classification metrics from grouped (truth, predicted) counts.

Rows are counted map-side first, so only label pairs are shuffled and a frequent
label (such as ``O``) costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.fixed import IGNORE_ID

AVERAGES = ("weighted", "macro", "binary")


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Number of rows per (truth, predicted)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def flatten_valid(df: DataFrame, labels_col: str, predictions_col: str, *keep: str,
                  ignore: int = IGNORE_ID) -> DataFrame:
    """Per-token labels and predictions as rows (``truth``, ``predicted``), ignored ones dropped."""
    pairs = F.arrays_zip(F.col(labels_col).alias("truth"), F.col(predictions_col).alias("predicted"))
    return (df.select(*keep, F.posexplode(pairs).alias("pos", "_pair"))
            .select(*keep, "pos", "_pair.truth", "_pair.predicted")
            .filter(F.col("truth") != ignore))


def _dense(counts: DataFrame, zeros: DataFrame) -> DataFrame:
    # zero rows enter the same aggregation, so that no join is needed to fill gaps
    return counts.unionByName(zeros).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Counts per cell.

    With ``labels`` the matrix covers exactly these, zeros filled in. Otherwise it has the
    cells that occur, for any number of labels; ``seen_labels`` of it lists them.
    """
    counts = pair_counts(df, truth, predicted)
    if labels is None:
        return counts
    wanted = F.array(*[F.lit(x) for x in labels])
    zeros = (df.sparkSession.range(1).select(F.explode(wanted).alias("truth"))
             .select("truth", F.explode(wanted).alias("predicted"))
             .withColumn("n", F.lit(0).cast("bigint")))
    counts = counts.filter(F.col("truth").isin(*labels) & F.col("predicted").isin(*labels))
    return _dense(counts, zeros)


def seen_labels(counts: DataFrame) -> DataFrame:
    """Labels that occur as truth or as prediction."""
    return counts.select(F.explode(F.array("truth", "predicted")).alias("label")).distinct()


def confusion_wide(matrix: DataFrame, labels: Sequence) -> DataFrame:
    """One row per true label with one count column per predicted label."""
    return matrix.groupBy("truth").pivot("predicted", list(labels)).agg(F.first("n"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_class_from_counts(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; an undefined ratio is 0."""
    hit = F.col("truth") == F.col("predicted")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), none.alias("guesses"),
                 F.when(hit, F.col("n")).otherwise(none).alias("hits")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"), F.col("n").alias("guesses"),
                 none.alias("hits")),
    )
    totals = counts.select(F.inline(sides)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("guesses").alias("guesses"), F.sum("hits").alias("hits"))
    return totals.select(
        "label", "support", "guesses", "hits",
        _ratio(F.col("hits"), F.col("guesses")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("guesses")).alias("f1"),
    )


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class_from_counts(pair_counts(df, truth, predicted))


SCORES = ("precision", "recall", "f1")


def average_columns(average: str = "weighted", positive=1) -> list[Column]:
    """Aggregates of precision, recall and F1 over a table of classes."""
    if average == "weighted":
        return [(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in SCORES]
    if average == "macro":
        return [F.avg(s).alias(s) for s in SCORES]
    if average == "binary":
        return [F.coalesce(F.max(F.when(F.col("label") == positive, F.col(s))), F.lit(0.0)).alias(s) for s in SCORES]
    raise ValueError(f"average must be one of {AVERAGES}")


def average_scores(classes: DataFrame, average: str = "weighted", positive=1) -> DataFrame:
    """One row with precision, recall and F1 over classes."""
    return classes.agg(*average_columns(average, positive))


def all_scores(classes: DataFrame, average: str = "weighted", positive=1) -> DataFrame:
    """One row with averages and accuracy, all from the same pass over the classes."""
    return classes.agg(*average_columns(average, positive),
                       (F.sum("hits") / F.sum("support")).alias("accuracy"))


def precision_recall_f1(df: DataFrame, truth: str, predicted: str, average: str = "weighted",
                        positive=1) -> DataFrame:
    return average_scores(per_class(df, truth, predicted), average, positive)


def label_distribution(df: DataFrame, tags_col: str, labels: dict[str, int], strict: bool = False) -> DataFrame:
    """Tag counts in label-id order with every known label listed.

    A tag outside ``labels`` is listed last without an id, or raises when ``strict``.
    """
    tags = df.select(F.explode(tags_col).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    known = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(i) for i in labels.values()]))
    zeros = df.sparkSession.range(1).select(
        F.explode(F.map_keys(known)).alias("label"), F.lit(0).cast("bigint").alias("n"))
    label_id = F.try_element_at(known, F.col("label"))
    if strict:
        label_id = F.coalesce(label_id, F.raise_error(F.concat(F.lit("unknown tag: "), F.col("label"))))
    return (tags.unionByName(zeros).groupBy("label").agg(F.sum("n").alias("n"))
            .withColumn("id", label_id).orderBy(F.col("id").asc_nulls_last(), "label"))
