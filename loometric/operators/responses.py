"""Take answers, scores and structured results out of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.fixed import RESPONSE_MARK
from loometric.functions.stage import computed
from loometric.functions.text import strip

EXTRACT_MODES = ("last", "first", "between", "word")


def extract_response(raw: Column, mode: str = "last") -> Column:
    """The answer inside raw model output.

    ``last``     text after the last mark, whole text without one, not stripped
    ``first``    stripped text after the first mark, stripped whole text without one
    ``between``  text between the first and the second mark; an error without one
    ``word``     like ``first`` with the bare word of the mark
    """
    mark = RESPONSE_MARK
    if mode == "last":
        return F.substring_index(raw, mark, -1)
    if mode == "between":
        rest = F.when(F.contains(raw, F.lit(mark)), _after_first(raw, mark)).otherwise(
            F.raise_error(F.lit("no response mark")))
        return F.when(raw.isNotNull(), F.substring_index(rest, mark, 1))
    if mode in ("first", "word"):
        return strip(_after_first(raw, mark if mode == "first" else mark.strip()))
    raise ValueError(f"mode must be one of {EXTRACT_MODES}")


def _after_first(raw: Column, mark: str) -> Column:
    at = F.locate(mark, raw)
    return F.when(at > 0, F.substr(raw, at + len(mark))).otherwise(raw)


def parse_score(raw: Column, valid_range: tuple[int, int] | None = None) -> Column:
    """Judge text as a whole number, null when it is anything else."""
    text = strip(raw)
    whole = F.when(F.rlike(text, F.lit(r"^[+-]?\d+(_\d+)*$")), F.replace(text, F.lit("_"), F.lit("")))
    score = whole.try_cast("bigint")
    if valid_range is None:
        return score
    return F.when(score.between(*valid_range), score)


def parse_structured_response(df: DataFrame, response_col: str = "response", tokens_col: str = "tokens",
                              list_key: str = "entities", label_key: str = "etiket") -> DataFrame:
    """Labels of a JSON answer, one per token, or the reason why the row is broken.

    Adds ``pred_tags`` (null on a broken row) and ``broken_reason`` (null on a good row):
    ``no_response``, ``bad_json``, ``bad_shape``, ``length_mismatch``, ``missing_label``.
    """
    staged = computed(df, _json=F.try_parse_json(F.col(response_col)))
    is_object = F.try_variant_get("_json", "$", "map<string,variant>").isNotNull()
    staged = computed(staged, _object=is_object,
                      _items=F.when(is_object, F.try_variant_get("_json", f"$.{list_key}", "variant")))
    staged = computed(staged, _list=F.when(F.col("_items").isNotNull(), F.try_variant_get("_items", "$", "array<variant>")).when(
        F.col("_object") & F.col("_items").isNull(), F.array().cast("array<variant>")))
    staged = computed(staged, _tags=F.transform("_list", lambda v: F.try_variant_get(v, f"$.{label_key}", "string")))
    reason = (
        F.when(F.col(response_col).isNull(), "no_response")
        .when(F.col("_json").isNull(), "bad_json")
        .when(F.col("_list").isNull(), "bad_shape")
        .when(F.size("_list") != F.size(tokens_col), "length_mismatch")
        .when(F.exists("_tags", lambda t: t.isNull()), "missing_label")
    )
    return computed(staged, broken_reason=reason).withColumn(
        "pred_tags", F.when(F.col("broken_reason").isNull(), F.col("_tags"))
    ).drop("_json", "_object", "_items", "_list", "_tags")
