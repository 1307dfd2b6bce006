"""Losses over prediction tables and pooling of token vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loometric.fixed import IGNORE_ID
from loometric.functions.numeric import bce_with_logits, cross_entropy

LOSSES = ("cross_entropy", "squared_error", "binary_cross_entropy")


def eval_loss(df: DataFrame, prediction_col: str, label_col: str, kind: str = "cross_entropy",
              ignore: int = IGNORE_ID) -> DataFrame:
    """Mean loss of a prediction table.

    ``cross_entropy``         logit array against a class id, ignored ids left out; any other id
                              outside the logits raises
    ``squared_error``         number against number, or array against an array of the same length
    ``binary_cross_entropy``  logit array against a 0/1 array
    """
    prediction, label = F.col(prediction_col), F.col(label_col)
    if kind == "cross_entropy":
        known = (label >= 0) & (label < F.size(prediction))
        loss = F.when(known, cross_entropy(prediction, label)).otherwise(F.raise_error(
            F.concat(F.lit("label outside the logits: "), label.cast("string"))))
        return df.filter(label != ignore).agg(F.avg(loss).alias("loss"))
    if kind == "squared_error":
        if isinstance(df.schema[label_col].dataType, ArrayType):
            # the mean runs over all numbers of all vectors
            same = F.when(F.size(prediction) == F.size(label), F.zip_with(prediction, label, lambda p, y: (p - y) * (p - y)))
            squares = F.coalesce(same, F.raise_error(F.lit("vectors of different lengths")))
            part = df.select(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b.cast("double")).alias("_sum"), F.size(label).alias("_n"))
            return part.agg((F.sum("_sum") / F.sum("_n")).alias("loss"))
        error = prediction.cast("double") - label.cast("double")
        return df.agg(F.avg(error * error).alias("loss"))
    if kind == "binary_cross_entropy":
        return df.agg(F.avg(bce_with_logits(prediction, label)).alias("loss"))
    raise ValueError(f"kind must be one of {LOSSES}")


# Exponents of one step: e to this power, and sums of it over any table, stay well inside a double.
STEP = 512


def long_cross_entropy(logits: DataFrame, *keys: str, label_col: str = "label", logit_col: str = "logit", truth_col: str = "truth") -> DataFrame:
    """(keys, truth, loss) from one row for each logit: so a vocabulary of any size spreads over tasks.

    The sum of exponentials is kept as steps of ``STEP``: for each step of the logits the sum of what is above it. Such sums are plain
    aggregates that combine before the shuffle. Of the steps only the highest and the one below it can count, and these two are the
    highest even and the highest odd one, which maxima find. ``truth_col`` repeats in each row of a position; a truth without a logit raises.
    """
    x = F.col(logit_col).cast("double")
    step = F.floor(x / STEP)
    hit = F.when(F.col(label_col) == F.col(truth_col), x)
    sums = logits.groupBy(*keys, F.col(truth_col).alias("truth"), step.alias("_step")).agg(
        F.sum(F.exp(x - step * STEP)).alias("_sum"), F.max(hit).alias("_hit"))

    def highest(odd: int) -> Column:
        return F.max(F.when(F.pmod("_step", F.lit(2)) == odd, F.struct("_step", "_sum")))

    found = sums.groupBy(*keys, "truth").agg(highest(0).alias("_even"), highest(1).alias("_odd"), F.max("_hit").alias("_hit"))
    top = F.greatest("_even._step", "_odd._step")

    def part(side: str) -> Column:
        return F.coalesce(F.col(f"{side}._sum") * F.exp((F.col(f"{side}._step") - top) * STEP), F.lit(0.0))

    known = F.coalesce("_hit", F.raise_error(F.concat(F.lit("label outside the logits: "), F.col("truth").cast("string"))).cast("double"))
    return found.select(*keys, "truth", (top * STEP + F.ln(part("_even") + part("_odd")) - known).alias("loss"))


def long_eval_loss(logits: DataFrame, *keys: str, label_col: str = "label", logit_col: str = "logit", truth_col: str = "truth",
                   kind: str = "cross_entropy", ignore: int = IGNORE_ID) -> DataFrame:
    """``eval_loss`` over one row for each number: ``keys`` name a position, ``label_col`` the number's place in it.

    ``cross_entropy`` takes the class id in ``truth_col``, repeated in each row of its position, and leaves out ignored ones;
    ``squared_error`` and ``binary_cross_entropy`` the target of each number.
    """
    x, y = F.col(logit_col).cast("double"), F.col(truth_col)
    if kind == "cross_entropy":
        kept = logits.filter(y != ignore)
        return long_cross_entropy(kept, *keys, label_col=label_col, logit_col=logit_col, truth_col=truth_col).agg(F.avg("loss").alias("loss"))
    if kind == "squared_error":
        return logits.agg(F.avg((x - y) * (x - y)).alias("loss"))
    if kind == "binary_cross_entropy":
        # the mean runs over positions first, as in the array form
        losses = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        return logits.groupBy(*keys).agg(F.avg(losses).alias("loss")).agg(F.avg("loss").alias("loss"))
    raise ValueError(f"kind must be one of {LOSSES}")


def pool_vectors(tokens: DataFrame, how: str = "mean", doc_col: str = "doc_id", pos_col: str = "pos",
                 vec_col: str = "vec", pad_col: str | None = None, mask: bool = False) -> DataFrame:
    """One vector per document from its token vectors.

    ``last`` takes the position before the first pad, or the final position without
    one. ``max`` and ``mean`` run over all positions, pads included, unless ``mask``.
    Vectors are summed map-side, so a long document is no burden for one task.
    """
    if how == "last":
        pad = F.col(pad_col) if pad_col else F.lit(False)
        first_pad = tokens.groupBy(doc_col).agg(
            F.min(F.when(pad, F.col(pos_col))).alias("_first_pad"), F.max(pos_col).alias("_end"))
        # a pad in front wraps around to the final position
        ends = first_pad.select(doc_col, F.when(F.col("_first_pad") > 0, F.col("_first_pad") - 1)
                                .otherwise(F.col("_end")).alias(pos_col))
        return tokens.join(ends, [doc_col, pos_col]).select(
            doc_col, F.col(vec_col).cast("array<double>").alias("pooled"))
    if how not in ("max", "mean"):
        raise ValueError("how is 'last', 'max' or 'mean'")
    if mask and pad_col:
        tokens = tokens.filter(~F.col(pad_col))
    summary = Summarizer.metrics(how).summary(array_to_vector(F.col(vec_col)))
    return (tokens.groupBy(doc_col).agg(summary.alias("_summary"))
            .select(doc_col, vector_to_array(F.col(f"_summary.{how}")).alias("pooled")))
