"""Text column functions. All are Catalyst expressions except a user's own tokenizer."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loometric.fixed import WHITESPACE_CHARS

# the same characters as WHITESPACE_CHARS: Unicode white space and the four ASCII separators
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def split_words(text: Column) -> Column:
    """Words between runs of Unicode white space; an empty text has none."""
    return F.array_remove(F.split(text, _SPACE_RUN), "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def token_counter(encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Turn a user's tokenizer into a token-count column function.

    ``encoder`` is called once per Python task and returns a function text -> tokens.
    """

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            yield texts.map(lambda text: None if text is None else len(encode(text))).astype("Int32")

    return lambda text: count(text)


def normalize_text(text: Column) -> Column:
    return strip(F.lower(text))


def clean_cell(cell: Column) -> Column:
    """Stripped cell with newlines as spaces; a missing cell is the empty text."""
    return F.coalesce(F.replace(strip(cell), F.lit("\n"), F.lit(" ")), F.lit(""))


def join_tokens(tokens: Column, separator: str = " ") -> Column:
    return F.array_join(tokens, separator)


def entity_type(label: Column) -> Column:
    """Type part of a ``B-``/``I-`` label; null for a label without one."""
    return F.get(F.split(label, "-"), F.lit(1))


def run_name(path: Column) -> Column:
    """Last part of a path or model name."""
    return F.element_at(F.split(path, "/"), -1)


def safe_name(path: Column) -> Column:
    """A path as one file-name-safe word."""
    return F.replace(path, F.lit("/"), F.lit("_"))


def strip_suffix(name: Column, suffix: str = "_filtered") -> Column:
    return F.replace(name, F.lit(suffix), F.lit(""))


def fill_prompt(template: str, *values: Column) -> Column:
    """Fill each ``{}`` of a template with a column; values may hold any character."""
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError(f"template has {len(parts) - 1} gaps but {len(values)} columns were given")
    pieces = [F.lit(parts[0])]
    for value, literal in zip(values, parts[1:]):
        pieces += [value, F.lit(literal)]
    return F.concat(*pieces)
