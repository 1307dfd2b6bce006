"""Reshape rows into chat messages and training text, filter by length, align labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.fixed import BOS, IGNORE_ID, INSTRUCTION_PART, RESPONSE_PART, TURN_END, TURN_START
from loometric.functions.text import let, strip, word_count

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ChatTemplate:
    """How messages become one string.

    ``role_names`` maps a role to the name printed after the turn mark. With
    ``fold_system`` a leading system message becomes a prefix of the next turn.
    """

    bos: str = BOS
    turn_start: str = TURN_START
    turn_end: str = TURN_END
    role_names: Mapping[str, str] = field(default_factory=lambda: {"assistant": "model"})
    fold_system: bool = True
    system_joint: str = "\n\n"
    generation_role: str = "assistant"

    def name_of(self, role: str) -> str:
        return self.role_names.get(role, role)


def to_messages(df: DataFrame, system_prompt: str, input_col: str = "input",
                output_col: str = "output", into: str = "messages") -> DataFrame:
    """An (input, output) pair becomes system, user and assistant messages."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))

    return df.withColumn(into, F.array(
        turn("system", F.lit(system_prompt)),
        turn("user", F.col(input_col)),
        turn("assistant", F.col(output_col)),
    ))


def message_at(messages: Column, index: int) -> Column:
    """Content of the n-th message, null when there are fewer."""
    return F.get(messages, F.lit(index))["content"]


def parse_messages(messages: Column) -> Column:
    """Messages stored as a JSON string become an array of structs."""
    return F.from_json(messages, MESSAGES_TYPE)


def to_parts(messages: Column) -> Column:
    """Plain contents become lists of typed content parts."""
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content"),
    ))


def flatten_parts(messages: Column) -> Column:
    """Typed content parts become one plain content, text parts only."""
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"),
        F.array_join(F.transform(F.filter(m["content"], lambda p: p["type"] == "text"),
                                 lambda p: p["text"]), "").alias("content"),
    ))


def request_messages(df: DataFrame, system_col: str, user_col: str, into: str = "messages") -> DataFrame:
    """Messages of a scoring request; an empty or missing system prompt adds no message."""
    system = F.when(F.length(F.col(system_col)) > 0,
                    F.array(F.struct(F.lit("system").alias("role"), F.col(system_col).alias("content"))))
    user = F.array(F.struct(F.lit("user").alias("role"), F.col(user_col).alias("content")))
    return df.withColumn(into, F.concat(
        F.coalesce(system, F.array().cast(MESSAGES_TYPE)), user))


def render_chat(messages: Column, template: ChatTemplate | None = None,
                add_generation_prompt: bool = False) -> Column:
    """Messages as one string with turn marks."""
    t = template or ChatTemplate()

    def role_name(role: Column) -> Column:
        name = role
        for given, printed in t.role_names.items():
            name = F.when(role == given, F.lit(printed)).otherwise(name)
        return name

    def turn(message: Column, prefix: Column) -> Column:
        return F.concat(F.lit(t.turn_start), role_name(message["role"]), F.lit("\n"), prefix,
                        strip(F.coalesce(message["content"], F.lit(""))), F.lit(t.turn_end))

    if t.fold_system:
        leads = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
        prefix = F.when(leads, F.concat(F.coalesce(message_at(messages, 0), F.lit("")), F.lit(t.system_joint))
                        ).otherwise("")
        rest = F.slice(messages, F.when(leads, 2).otherwise(1), F.size(messages))
        turns = let(prefix, lambda lead: F.transform(
            rest, lambda m, i: turn(m, F.when(i == 0, lead).otherwise(""))))
    else:
        turns = F.transform(messages, lambda m: turn(m, F.lit("")))
    text = F.concat(F.lit(t.bos), F.array_join(turns, ""))
    if add_generation_prompt:
        text = F.concat(text, F.lit(f"{t.turn_start}{t.name_of(t.generation_role)}\n"))
    return text


def filter_max_tokens(df: DataFrame, text_col: str, max_tokens: int,
                      counter: Callable[[Column], Column] = word_count, margin: int = 3) -> DataFrame:
    """Keep rows with fewer tokens than ``max_tokens - margin``."""
    return df.filter(counter(F.col(text_col)) < max_tokens - margin)


def append_eos(df: DataFrame, text_col: str, eos: str) -> DataFrame:
    return df.withColumn(text_col, F.concat(F.col(text_col), F.lit(eos)))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def pad_truncate(ids: Column, length: int, pad: Column) -> Column:
    """Exactly ``length`` items: cut the rest, fill the end with ``pad``."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(F.slice(ids, 1, length), F.array_repeat(pad, missing))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each kept item, 0 for each filled position."""
    kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def align_labels(word_ids: Column, tags: Column, label_ids: Column, strict: bool = True,
                 ignore: int = IGNORE_ID) -> Column:
    """Label id at the first subword of each word, ``ignore`` everywhere else.

    ``label_ids`` is a map column name -> id. An unknown tag raises, or is ignored
    when ``strict`` is off.
    """
    def label_of(word: Column) -> Column:
        tag = F.get(tags, word)
        found = F.try_element_at(label_ids, tag)
        if strict:
            error = F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce(tag, F.lit("null"))))
            return F.coalesce(found, error)
        return F.coalesce(found, F.lit(ignore))

    def label_at(word: Column, i: Column) -> Column:
        before = F.get(word_ids, i - 1)
        starts = word.isNotNull() & ~word.eqNullSafe(before)
        return F.when(starts, label_of(word)).otherwise(F.lit(ignore))

    return F.transform(word_ids, label_at)


def response_spans(text: Column, instruction_part: str = INSTRUCTION_PART,
                   response_part: str = RESPONSE_PART) -> Column:
    """Parts of a rendered text that a model answers: the only parts left unmasked."""
    pattern = f"(?s){re.escape(response_part)}(.*?)(?={re.escape(instruction_part)}|\\z)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def mask_prompt(ids: Column, instruction_marker: list[int], response_marker: list[int],
                ignore: int = IGNORE_ID) -> Column:
    """Token labels with everything outside model answers set to ``ignore``.

    An answer runs from the end of a response marker to the next instruction marker.
    The array is rebuilt from whole segments, so the work grows with its length.
    """
    def starts_of(marker: list[int]) -> Column:
        # the first item is compared before the slice is taken
        whole = F.array(*[F.lit(m) for m in marker])
        positions = F.sequence(F.lit(0), F.size(ids) - 1)
        return F.filter(positions, lambda i: (F.get(ids, i) == marker[0])
                        & (F.slice(ids, i + 1, len(marker)) == whole))

    def marks(starts: Column, is_response: bool) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(is_response).alias("response")))

    def segments(marked: Column) -> Column:
        # a mark counts only where it changes the state: prompt -> response -> prompt
        changes = F.filter(marked, lambda m, i: m["response"]
                           != F.coalesce(F.get(marked, i - 1)["response"], F.lit(False)))
        return let(changes, lambda c: F.flatten(F.concat(
            F.array(F.array_repeat(F.lit(ignore), F.coalesce(F.get(c, F.lit(0))["pos"], F.size(ids)))),
            F.transform(c, lambda m, i: let(
                F.coalesce(F.get(c, i + 1)["pos"], F.size(ids)) - m["pos"],
                lambda length: F.when(m["response"], F.concat(
                    F.array_repeat(F.lit(ignore), len(response_marker)),
                    F.slice(ids, m["pos"] + 1 + len(response_marker),
                            F.greatest(length - len(response_marker), F.lit(0))),
                )).otherwise(F.array_repeat(F.lit(ignore), length)))),
        )))

    both = F.array_sort(F.concat(marks(starts_of(instruction_marker), False),
                                 marks(starts_of(response_marker), True)))
    return F.when(F.size(ids) == 0, ids).otherwise(let(both, segments))
