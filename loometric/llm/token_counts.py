"""Token counts without encoding most words.

Where a vocabulary proves that no token crosses from one word into the next, a text's count is the sum
of its words' counts. Which pieces are one token when they stand alone is proved once, on the driver, by
encoding every piece; these words count one. Only the other words are merged, each distinct one once in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import id_and_text
from loometric.llm.spmodel import NORMAL, SPACE_MARK, USER_DEFINED, model_bytes, parse, splits_at_spaces

LIMIT = 4096
# Distinct merged words that a task remembers; only saves work.
REMEMBERED = 300_000

_RUNS = re.compile(" *[^ ]+| +$")


def whole_tokens(data: bytes) -> list[str]:
    """Words, without their one leading space, that the library encodes as one token.

    Empty where words may not be counted apart.
    """
    model = parse(data)
    if not splits_at_spaces(model):
        return []
    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    words = [text[1:] for text, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED) and text[:1] == SPACE_MARK and len(text) > 1]
    words = [w.replace(SPACE_MARK, " ") for w in words]
    return [w for w, ids in zip(words, processor.encode(words)) if len(ids) == 1]


class WordCounts(dict):
    """Counts of words; one that is missing is merged by the library."""

    def __init__(self, data: bytes, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self[""] = 1  # a lone space
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.whole, self.merged = whole, 0

    def __missing__(self, word: str) -> int:
        count = len(self.processor.encode(word))
        if self.merged >= REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            self[""], self.merged = 1, 0
        self.merged += 1
        self[word] = count
        return count

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.whole:
            return len(self.processor.encode(text))
        text = text.replace(SPACE_MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in _RUNS.findall(" " + text)]
        else:
            words = text.split(" ")
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the library counts the whole text.

    Strings of control pieces inside a text are ordinary text. Null and empty texts have no bytes
    and no tokens. Repeated rows are counted each; an empty table gives an empty result.
    """
    data = model_bytes(model_path)
    rows = id_and_text(docs, id_column, text_column)
    shipped = rows.sparkSession.sparkContext.broadcast((data, whole_tokens(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(*shipped.value)
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((counts.of(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "n_tokens"]).append_column(
                "n_bytes", pc.binary_length(texts).cast(pa.int64()))

    schema = f"id {docs.schema[id_column].dataType.simpleString()}, n_tokens bigint, n_bytes bigint"
    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
