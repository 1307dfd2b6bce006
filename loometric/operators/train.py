"""Text classification trained on Spark: all candidates are fitted in the same passes and compared on a validation part."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from loometric.functions.numeric import argmax_label
from loometric.operators.classmetrics import all_scores, per_class, per_class_from_counts
from loometric.operators.sampling import best_run
from loometric.session import shared_folder


def text_classifier(regularization: float, features: int = 1 << 16, iterations: int = 20,
                    text_col: str = "text", label_col: str = "label") -> Pipeline:
    """A single classifier as a pipeline of Spark ML."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label_col, regParam=regularization,
                           maxIter=iterations, rawPredictionCol="raw", probabilityCol="shares"),
    ])


# --- features -------------------------------------------------------------------------


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), "")


def _row_counts(words: pa.ListArray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word counts of each row: offsets into feature numbers and counts."""
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    hashes = np.fromiter((zlib.crc32(w.as_py().encode()) % features for w in coded.dictionary), np.int64, len(coded.dictionary))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cells, counts = np.unique(rows * features + hashes[coded.indices.to_numpy()], return_counts=True)
    return np.searchsorted(cells // features, np.arange(len(sizes) + 1)), cells % features, counts


def hashed_counts(text_col: str, features: int) -> Column:
    """The words of a text as (indices, counts) of hashed features."""
    @F.arrow_udf(StructType([StructField("indices", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))]))
    def counted(words: pa.Array) -> pa.Array:
        offsets, indices, counts = _row_counts(words, features)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (indices, counts)]
        return pa.StructArray.from_arrays(lists, ["indices", "counts"])

    return counted(_words(text_col))


# --- fitting --------------------------------------------------------------------------


def minimizer(start: np.ndarray, iterations: int, tolerance: float = 1e-6, memory: int = 10
              ) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps: yields points, is sent their values and gradients, returns the last good point.

    So that the points of many problems can be evaluated together.
    """
    x, pairs = start, []
    value, gradient = yield x
    for _ in range(iterations):
        if np.abs(gradient).max(initial=0.0) <= tolerance:
            break
        direction, kept = -gradient, []
        for s, y, rho in reversed(pairs):
            share = rho * (s @ direction)
            direction = direction - share * y
            kept.append(share)
        if pairs:
            s, y, _ = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y, rho), share in zip(pairs, reversed(kept)):
            direction = direction + (share - rho * (y @ direction)) * s
        slope, step = gradient @ direction, 1.0 if pairs else min(1.0, 1.0 / np.abs(gradient).sum())
        for _ in range(20):
            other = x + step * direction
            other_value, other_gradient = yield other
            if other_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break  # no step goes down any more
        s, y = other - x, other_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory:], (s, y, 1.0 / (s @ y))]
        small = abs(value - other_value) <= tolerance * max(abs(value), abs(other_value), 1.0)
        x, value, gradient = other, other_value, other_gradient
        if small:
            break
    return x


def _losses(margins: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed log loss of rows (outputs x rows), and its derivatives; one output stands for two classes."""
    if len(margins) == 1:
        z = margins[0]
        loss = np.logaddexp(0.0, z).sum() - z[labels == 1].sum()
        return float(loss), (1.0 / (1.0 + np.exp(-z)) - labels)[None]
    top = margins.max(axis=0)
    shares = np.exp(margins - top)
    total = shares.sum(axis=0)
    rows = np.arange(margins.shape[1])
    loss = (np.log(total) + top - margins[labels, rows]).sum()
    shares /= total
    shares[labels, rows] -= 1.0
    return float(loss), shares


def _margins(weights: np.ndarray, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Outputs x rows, from weights (outputs x features, the intercept last)."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.stack([np.bincount(rows, weights=w[indices] * values, minlength=len(offsets) - 1) + w[-1] for w in weights])


def gradient_sums(rows: DataFrame, points: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses (candidates) and gradients (like ``points``: candidates x outputs x features + 1) over all rows, in one pass.

    ``rows`` has label, indices and counts. Each task adds up its rows; its sums are added up by groups of tasks before the driver sees them.
    """
    candidates, outputs, width = points.shape
    shipped = rows.sparkSession.sparkContext.broadcast((points, scale))
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, factor = shipped.value
        losses, gradients = np.zeros(candidates), np.zeros((candidates, outputs, width))
        for batch in batches:
            lists, labels = batch.column("indices"), batch.column("label").to_numpy()
            offsets = lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            indices = lists.flatten().to_numpy()
            values = batch.column("counts").flatten().to_numpy() * factor[indices]
            owners = np.repeat(np.arange(len(labels)), np.diff(offsets))
            for c in range(candidates):
                loss, slopes = _losses(_margins(weights[c], offsets, indices, values), labels)
                losses[c] += loss
                for k in range(outputs):
                    gradients[c, k, :-1] += np.bincount(indices, weights=values * slopes[k][owners], minlength=width - 1)
                    gradients[c, k, -1] += slopes[k].sum()
        payload = np.concatenate([losses, gradients.ravel()]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups]), pa.array([payload], pa.binary())], names=["grp", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("label", "indices", "counts").mapInArrow(sums, "grp bigint, sums binary").groupBy("grp").applyInArrow(added, "sums binary")
    total = sum((np.frombuffer(r["sums"]) for r in parts.toLocalIterator()), np.zeros(candidates * (1 + outputs * width)))
    return total[:candidates], total[candidates:].reshape(points.shape)


def fit_candidates(rows: DataFrame, strengths: list[float], classes: int, features: int, iterations: int = 20) -> list[np.ndarray]:
    """Weights (outputs x features + 1, the intercept last) of one logistic regression for each strength of the penalty.

    Counts are divided by their spread, as the penalty is on equal terms then; a factor for each feature, such as an inverse document
    frequency, would cancel out. Each pass over the rows serves the next points of all candidates that have not settled.
    """
    moments = rows.select(F.explode(F.arrays_zip("indices", "counts")).alias("e")).groupBy("e.indices").agg(
        F.sum("e.counts").alias("s"), F.sum(F.col("e.counts").cast("double") ** 2).alias("q"))  # at most one row a feature
    n = rows.count()
    spread = np.zeros(features)
    for r in moments.toLocalIterator():
        spread[r["indices"]] = math.sqrt(max(r["q"] - r["s"] ** 2 / n, 0.0) / max(n - 1, 1))
    scale = np.divide(1.0, spread, out=np.zeros(features), where=spread > 0)
    outputs = 1 if classes <= 2 else classes
    shape = outputs, features + 1
    runs = {c: minimizer(np.zeros(outputs * (features + 1)), iterations) for c in range(len(strengths))}
    points, found = {c: next(run) for c, run in runs.items()}, {}
    while points:
        order = sorted(points)
        losses, gradients = gradient_sums(rows, np.stack([points[c].reshape(shape) for c in order]), scale)
        for c, loss, gradient in zip(order, losses, gradients):
            weights = points.pop(c).reshape(shape).copy()
            weights[:, -1] = 0.0  # the intercept is free
            value = loss / max(n, 1) + strengths[c] / 2 * (weights ** 2).sum()
            try:
                points[c] = runs[c].send((value, (gradient / max(n, 1) + strengths[c] * weights).ravel()))
            except StopIteration as ended:
                found[c] = ended.value.reshape(shape) * np.append(scale, 1.0)
    return [found[c] for c in range(len(strengths))]


@dataclass(frozen=True)
class TextClassifier:
    """Logistic regression over hashed word counts."""

    classes: int
    weights: np.ndarray
    text_col: str = "text"

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities``, one for each class."""
        return df.withColumn("probabilities", candidate_shares(df.sparkSession, [self])[0])

    def save(self, spark: SparkSession, path: str, run: str) -> None:
        rows = [(run, self.classes, self.text_col, k, w.tolist()) for k, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "run string, classes int, text_col string, output int, weights array<double>").write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, run: str) -> TextClassifier:
        rows = spark.read.parquet(path).where(F.col("run") == run).orderBy("output").collect()  # one row for each class
        return cls(rows[0]["classes"], np.array([r["weights"] for r in rows]), rows[0]["text_col"])


def candidate_shares(spark: SparkSession, models: list[TextClassifier]) -> Column:
    """For each model the probabilities of the classes; words are hashed once for all of them."""
    features = models[0].weights.shape[1] - 1
    shipped = spark.sparkContext.broadcast([m.weights for m in models])

    @F.arrow_udf(ArrayType(ArrayType(DoubleType())))
    def shares(words: pa.Array) -> pa.Array:
        offsets, indices, counts = _row_counts(words, features)
        found = []
        for weights in shipped.value:
            z = _margins(weights, offsets, indices, counts)
            z = np.concatenate((np.zeros_like(z), z)) if len(z) == 1 else z
            z = np.exp(z - z.max(axis=0))
            found.append((z / z.sum(axis=0)).T)
        values = np.stack(found, axis=1)  # rows x models x classes
        n, models_, classes = values.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * models_ * classes + 1, classes), pa.int32()), pa.array(values.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * models_ + 1, models_), pa.int32()), inner)

    return shares(_words(models[0].text_col))


def predict_classes(model: TextClassifier | PipelineModel, df: DataFrame) -> DataFrame:
    """Adds class probabilities (``probabilities``) and the top class (``predicted``)."""
    scored = model.transform(df)
    if isinstance(model, PipelineModel):
        scored = scored.withColumn("probabilities", vector_to_array("shares")).drop("_words", "_counts", "features", "raw", "shares", "prediction")
    return scored.withColumn("predicted", argmax_label(F.col("probabilities")))


def validation_scores(scored: DataFrame, label_col: str = "label", average: str = "macro") -> DataFrame:
    """Accuracy, precision, recall and F1 from one pass of grouped counts."""
    return all_scores(per_class(scored, label_col, "predicted"), average)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def train_text_classifier(train: DataFrame, validation: DataFrame, regularizations: Iterable[float] = (0.001, 0.01, 0.1),
                          metric: str = "accuracy", average: str = "macro", text_col: str = "text",
                          label_col: str = "label", features: int = 1 << 16, iterations: int = 20,
                          folder: str | None = None, test: DataFrame | None = None,
                          featurized: Callable[[DataFrame], DataFrame] | None = None) -> tuple[TextClassifier, DataFrame]:
    """Fit all candidates in the same passes over features computed once, and keep the one that validates best.

    Labels are whole numbers from 0 on; rows without one are left out. Candidates are written to ``folder`` and used from there. Returns the
    kept model and a table of scores: one row of ``part`` "validation" for each candidate, and, with a ``test`` part that no
    choice has looked at, one of "test" for the kept one. ``featurized`` replaces the hashed words: it adds ``indices`` and ``counts``.
    """
    spark = train.sparkSession
    folder = folder or shared_folder(spark, "models")
    strengths = list(regularizations)
    labelled = train.where(F.col(label_col).isNotNull())
    label = F.col(label_col).cast("int").alias("label")
    counted = featurized(labelled) if featurized else labelled.withColumn("_f", hashed_counts(text_col, features)).select("*", "_f.*")
    rows = _stored(counted.select(label.cast(LongType()), "indices", "counts"), folder, "features")
    classes = (rows.agg(F.max("label")).first()[0] or 0) + 1
    names = [f"reg={strength:g}" for strength in strengths]
    for name, weights in zip(names, fit_candidates(rows, strengths, max(classes, 2), features, iterations)):
        TextClassifier(max(classes, 2), weights, text_col).save(spark, f"{folder}/candidates", name)
    models = [TextClassifier.load(spark, f"{folder}/candidates", name) for name in names]

    def compared(part: DataFrame, name: str, some: list[TextClassifier], runs: list[str]) -> DataFrame:
        shares = part.where(F.col(label_col).isNotNull()).select(label, candidate_shares(spark, some).alias("shares"))
        guesses = shares.select("label", F.transform("shares", argmax_label).alias("guesses"))
        kept = _stored(guesses.groupBy("label", "guesses").agg(F.count(F.lit(1)).alias("n")), folder, name)
        scores = None
        for k, run in enumerate(runs):
            counts = kept.select(F.col("label").alias("truth"), F.get("guesses", F.lit(k)).alias("predicted"), "n")
            found = all_scores(per_class_from_counts(counts), average).withColumns({"run": F.lit(run), "part": F.lit(name)})
            scores = found if scores is None else scores.unionByName(found)
        return spark.createDataFrame(scores.collect(), scores.schema)  # one row for each candidate

    table = compared(validation, "validation", models, names)
    best = best_run(table, metric).first()["run"]
    kept = models[names.index(best)]
    return kept, table if test is None else table.unionByName(compared(test, "test", [kept], [best]))
