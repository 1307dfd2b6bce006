"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed here and rebuilt as a tokenizers pipeline: the normaliser (character map,
extra spaces, leading space, space mark), the pieces with their scores (unigram scores as they are, or merges
ranked by score), and byte fallback. Where the vocabulary proves that no token crosses from
one word into the next, texts are cut there, and each distinct word is encoded once in a batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import decoders, models, normalizers, pre_tokenizers

from loometric.llm.common import id_and_text, returned_memory, text_chunks
from loometric.llm.spmodel import (BPE, BYTE, NORMAL, SPACE_MARK, UNKNOWN, USER_DEFINED, Model, model_bytes, parse,
                                   splits_at_spaces)

# Distinct words that a task remembers; only saves work.
REMEMBERED = 150_000
# New words that are encoded as one text.
JOINED = 64
# Texts are read and handed to the library in groups of about so many bytes.
GROUP_CHARS = 1 << 19


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Every cut of a piece into two pieces, best score first: what may be joined, in this order."""
    usable = {text: score for text, score, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for i, (text, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER_DEFINED):
            found += [(-score, i, k, text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in usable and text[k:] in usable]
    return [(a, b) for _, _, _, a, b in sorted(found)]


def tokenizer_of(model: Model) -> tokenizers.Tokenizer:
    """The model as a tokenizers pipeline with the same ids."""
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.model_type == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges_of(model), fuse_unk=True, byte_fallback=model.byte_fallback,
                          unk_token=model.pieces[unknown][0] if unknown is not None else None)
    else:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], unknown, model.byte_fallback)
    tokenizer = tokenizers.Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(tokenizers.Regex(" {2,}"), " ")]
    mark = SPACE_MARK if model.escape_spaces else " "
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE_MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_spaces(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(tokenizers.Regex(f"{mark}+[^{mark}]*|[^{mark}]+"), "isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(mark, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class Coder:
    """Texts to ids and back. The ids of words that have been met stand in one flat array."""

    def __init__(self, data: bytes):
        self.model = parse(data)
        self.tokenizer = tokenizer_of(self.model)
        self.by_word = splits_at_spaces(self.model)
        spelling = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE_MARK, " ").encode()
                    for text, _, kind in self.model.pieces]
        self.spelled = np.frombuffer(b"".join(spelling), dtype=np.uint8)
        self.spelled_ends = np.cumsum([len(b) for b in spelling])
        self.starts_word = np.array([text.startswith(SPACE_MARK) for text, _, _ in self.model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Plain ones are encoded many to a text: each begins at a token with a space mark."""
        alone = [w for w in words if not w or " " in w]
        plain_ones = [w for w in words if w and " " not in w]
        found, sizes = [self.ids], [np.diff(self.ends, prepend=0)]
        joined = [" ".join(plain_ones[i:i + JOINED]) for i in range(0, len(plain_ones), JOINED)]
        if joined:
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.int32)
            at = np.flatnonzero(self.starts_word[ids])
            if len(at) != len(plain_ones):
                raise ValueError("a token crosses from one word into the next")
            found.append(ids)
            sizes.append(np.diff(at, append=len(ids)))
        for word in alone:
            # the leading space mark of a word is the one that the normaliser puts before it
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids if word else [self.tokenizer.token_to_id(SPACE_MARK)]
            found.append(np.array(ids, np.int32))
            sizes.append(np.array([len(ids)]))
        first = len(self.rows)
        self.rows.update(zip(chain(plain_ones, alone), range(first, first + len(words))))
        self.ids, self.ends = np.concatenate(found), np.cumsum(np.concatenate(sizes))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes
        if len(self.rows) > REMEMBERED:
            self._forget()
        words = [_words(text) for text in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = int(counts.sum())
        numbers = np.fromiter(map(self.rows.get, chain.from_iterable(words), repeat(-1)), np.int64, total)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            flat = list(chain.from_iterable(words))
            fresh = [flat[i] for i in missing]
            self._learn(list(dict.fromkeys(fresh)))
            numbers[missing] = np.fromiter(map(self.rows.__getitem__, fresh), np.int64, len(fresh))
        ids, sizes = _gathered(self.ids, self.ends, numbers)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode_flat(texts)
        return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the pieces spell, in a row, and how many each id has."""
        return _gathered(self.spelled, self.spelled_ends, ids)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of one text, without the leading space that encoding adds."""
        out = self.decode_flat(np.array(ids, np.int64))[0].tobytes()
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out


def _gathered(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows one after another, and the size of each row; row i ends at ends[i]."""
    if not len(rows):
        return values[:0], np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)[rows]
    shift = (ends[rows] - np.cumsum(sizes)).astype(np.int32)
    return values[np.repeat(shift, sizes) + np.arange(int(sizes.sum()), dtype=np.int32)], sizes


_RUNS = re.compile(" *[^ ]+| +$")


def _words(text: str) -> list[str]:
    """Words without the one space before each: where all spaces are single, plain pieces between them."""
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _RUNS.findall(" " + text)]
    return text.split(" ")


ENCODED = "ids array<int>, n_tokens bigint, same boolean"


def encoded(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, n_tokens, same) of every row: token ids of the whole text, and whether decoding gives it back.

    ``same`` compares with the text as the normaliser leaves it, space marks as spaces. Null and empty
    texts have no tokens. A repeated row is encoded for itself; an empty table gives an empty result.
    """
    rows = id_and_text(docs, id_column, text_column)
    shipped = rows.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has few cores; each thread of the library keeps memory of its own
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        coder = Coder(shipped.value)
        for batch in batches:
            for first, end, _, _ in text_chunks(batch.column("text"), GROUP_CHARS):
                texts = batch.column("text").slice(first, end - first).to_pylist()
                ids, sizes = coder.encode_flat(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), lists, pa.array(sizes), pa.array(_same(coder, ids, sizes, texts))],
                    names=["id", "ids", "n_tokens", "same"])
        del coder
        returned_memory()

    schema = f"id {docs.schema[id_column].dataType.simpleString()}, {ENCODED}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _same(coder: Coder, ids: np.ndarray, sizes: np.ndarray, texts: list[str]) -> list[bool]:
    """For each text whether its ids spell it."""
    spelled, lengths = coder.decode_flat(ids)
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
    data = spelled.tobytes()
    return [data[a:b] == plain(coder, text) for a, b, text in zip(ends, ends[1:], texts)]


def plain(coder: Coder, text: str) -> bytes:
    """What the ids of a text should spell, the leading space included."""
    if not text:
        return b""
    if not coder.by_word and coder.tokenizer.normalizer is not None:
        return coder.tokenizer.normalizer.normalize_str(text).replace(SPACE_MARK, " ").encode()
    return f" {text}".replace(SPACE_MARK, " ").encode()


def decoded(tokens: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of rows of token ids. Null ids give a null text; bytes that are no UTF-8 give the replacement sign."""
    rows = tokens.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    shipped = rows.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shipped.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    schema = f"id {tokens.schema[id_column].dataType.simpleString()}, text string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
