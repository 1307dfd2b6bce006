"""Reading a SentencePiece model file: a protocol buffer of pieces and settings."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Kinds of pieces, model types and field numbers of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK = 3, 35
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPED_SPACES = 2, 3, 4, 5

SPACE_MARK = "▁"
# A model travels to every task, so its size is checked.
MAX_BYTES = 64 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message: numbers as they are, anything with a length as bytes."""
    place = 0

    def varint() -> int:
        nonlocal place
        value = shift = 0
        while True:
            byte = data[place]
            place += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while place < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[place:place + size]
            place += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == PIECES:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == TRAINER:
            for n, v in fields(value):
                if n == MODEL_TYPE:
                    model.model_type = v
                elif n == BYTE_FALLBACK:
                    model.byte_fallback = bool(v)
        elif number == NORMALIZER:
            for n, v in fields(value):
                if n == CHARSMAP:
                    model.charsmap = v
                elif n == DUMMY_PREFIX:
                    model.dummy_prefix = bool(v)
                elif n == EXTRA_SPACES:
                    model.remove_extra_spaces = bool(v)
                elif n == ESCAPED_SPACES:
                    model.escape_spaces = bool(v)
    return model


def model_bytes(path: str) -> bytes:
    """The file, read on the driver; tasks get its bytes, since executors may not see the path."""
    size = os.path.getsize(path)
    if size > MAX_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_BYTES} are sent to the tasks")
    with open(path, "rb") as file:
        return file.read()


def splits_at_spaces(model: Model) -> bool:
    """Whether no piece goes on after a space mark that follows another character.

    Then no token crosses from one word into the next, and words may be encoded apart.
    """
    return (model.escape_spaces and not model.charsmap and not model.remove_extra_spaces and model.dummy_prefix
            and not any(SPACE_MARK in text.lstrip(SPACE_MARK) for text, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)))
