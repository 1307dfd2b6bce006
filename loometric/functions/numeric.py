"""Column functions over logit arrays and metric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loometric.functions.text import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def argmax_label(logits: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by the maximum so that exp stays finite."""
    shifted = let(
        F.array_max(logits).cast("double"),
        lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)),
    )
    return let(shifted, lambda e: let(_total(e), lambda s: F.transform(e, lambda x: x / s)))


def percent(share: Column) -> Column:
    return share * 100


def cross_entropy(logits: Column, label: Column) -> Column:
    """Log-sum-exp of the logits minus the logit of the true label."""
    top = F.array_max(logits).cast("double")
    log_sum = let(top, lambda m: m + F.ln(_total(F.transform(logits, lambda x: F.exp(x.cast("double") - m)))))
    return log_sum - F.get(logits, label).cast("double")


def bce_with_logits(logits: Column, targets: Column) -> Column:
    """Mean binary cross-entropy of a logit array against a 0/1 array."""
    terms = F.zip_with(
        logits.cast("array<double>"),
        targets.cast("array<double>"),
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return _total(terms) / F.size(logits)


def format_metric(value: Column, digits: int = 4, percent_sign: bool = False) -> Column:
    return F.format_string(f"%.{digits}f" + ("%%" if percent_sign else ""), value.cast("double"))
