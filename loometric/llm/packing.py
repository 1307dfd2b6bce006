"""Best-fit packing of token sequences by minimum bin slack.

1. Every document becomes token ids and one end id, cut only where it is longer than a sequence. Words (between
   spaces) are encoded once in a task and looked up again.
2. Only the lengths of the pieces decide how they are packed, and there are at most as many lengths as a sequence has
   places: their counts are all that the driver sees, at any size of the corpus.
3. The plan: a bin takes the largest length that is left and, by a bitset of reachable sums over all available
   lengths, the fullest combination with it. The combination is removed as often as the counts allow, which is what filling
   one bin after the other would do, since the fullest combination stays the fullest while fewer pieces are left.
4. Pieces of a length are numbered by counts of lengths by partition, and a piece's number says its bin and its place there.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loometric.llm.common import id_and_text, returned_memory, stored

LENGTH = 2048
END_ID = 0
# Words that a task remembers, and the longest one; bounds its memory, not the result.
REMEMBERED = 600_000
LONGEST_WORD = 200

# Words of ASCII and Latin-1 letters, for which the parts and the lower case are surely the tokenizer's own.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# How the tokenizer parts a lower-case word: a fixed value of its file, for these characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_MARKS = b",.;:!?"
# What a file must say for that.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_marks() -> dict[int, str]:
    """Each Latin-1 character as the marks of its UTF-8 bytes: a byte that prints stands for itself, the others follow from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in prints]
    marks = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(marks[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_MARKS = _byte_marks()


# --- the plan ---------------------------------------------------------------------


class ReachableSums:
    """Sums of pieces of the lengths available, at most ``room``: bit s of ``upto[i]`` says that the first i lengths reach s."""

    def __init__(self, lengths: list[int], room: int):
        self.lengths, self.room, self.full = lengths, room, (1 << room + 1) - 1
        self.usable = [0] * len(lengths)
        self.upto = [1] * (len(lengths) + 1)

    def update(self, counts: list[int]) -> None:
        """Take new counts; only sums from the first length whose usable number has changed are reached anew."""
        at = 0
        usable = [min(n, self.room // length) for n, length in zip(counts, self.lengths)]
        while at < len(usable) and usable[at] == self.usable[at]:
            at += 1
        self.usable = usable
        for i in range(at, len(usable)):
            sums, left, step = self.upto[i], usable[i], 1
            while left > 0:  # powers of two and a rest give every number of copies
                copies = min(step, left)
                sums |= (sums << copies * self.lengths[i]) & self.full
                left -= copies
                step *= 2
            self.upto[i + 1] = sums

    def fullest(self, room: int) -> list[tuple[int, int]]:
        """(index of a length, copies) of a combination with the largest sum that fits; large lengths are preferred."""
        sums = self.upto[-1] & ((1 << room + 1) - 1)
        left, found = sums.bit_length() - 1, []
        for i in range(len(self.lengths) - 1, -1, -1):
            if not left:
                break
            length, copies = self.lengths[i], 0
            for copies in range(min(self.usable[i], left // length), -1, -1):
                if self.upto[i] >> left - copies * length & 1:
                    break
            if copies:
                found.append((i, copies))
                left -= copies * length
        return found


def bin_patterns(counts: dict[int, int], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length of pieces, copies)]): bins that take all pieces; ``counts`` has the number of pieces of each length."""
    lengths = sorted(size for size, n in counts.items() if n)
    left = [counts[size] for size in lengths]
    sums = ReachableSums(lengths, length)
    largest = len(lengths) - 1
    while largest >= 0:
        if not left[largest]:
            largest -= 1
            continue
        left[largest] -= 1
        sums.update(left)
        chosen = dict(sums.fullest(length - lengths[largest]))
        left[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[i] // copies for i, copies in chosen.items())
        for i, copies in chosen.items():
            left[i] -= times * copies
        yield times, [(lengths[i], copies) for i, copies in sorted(chosen.items(), reverse=True)]


@dataclass(frozen=True)
class Plan:
    """Where the pieces go, by (length, number among the pieces of that length) counted through all lengths.

    ``base[l]`` pieces are shorter than l. Entry k covers pieces from ``start[k]`` on: ``copies`` of them go to each
    bin from ``first[k]`` on, at ``offset[k]`` and behind each other.
    """

    base: np.ndarray
    start: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    bins: int

    @classmethod
    def of(cls, counts: dict[int, int], length: int = LENGTH) -> Plan:
        base = np.zeros(length + 2, dtype=np.int64)
        for size, n in counts.items():
            base[size + 1] = n
        base = np.cumsum(base)
        taken, entries, bins = dict.fromkeys(counts, 0), [], 0
        for times, chosen in bin_patterns(counts, length):
            offset = 0
            for size, copies in chosen:
                entries.append((int(base[size]) + taken[size], copies, bins, offset))
                taken[size] += times * copies
                offset += size * copies
            bins += times
        entries.sort()
        start, copies, first, offset = np.array(entries, dtype=np.int64).reshape(-1, 4).T
        return cls(base, start, copies, first, offset, bins)

    def places(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these lengths and numbers."""
        at = self.base[sizes] + numbers
        k = np.searchsorted(self.start, at, side="right") - 1
        inside = at - self.start[k]
        return self.first[k] + inside // self.copies[k], self.offset[k] + inside % self.copies[k] * sizes


# --- token ids --------------------------------------------------------------------


class WordIds(dict):
    """Ids of words between spaces, as bytes of 32-bit numbers.

    The tokenizer drops white space and looks at no word's neighbours, so a text's ids are those of its words;
    ``parts_at_spaces`` proves it for a file. A new word of plain characters is parted as the tokenizer parts it, and
    only parts not met before are merged by its model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.merged = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one part
            ids = self._part(word.lower().decode())
        elif word[:-1].isalpha() and word[-1] in _MARKS:
            ids = self._part(word[:-1].lower().decode()) + self._part(chr(word[-1]))
        else:
            text = word.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join([self._part(part) for part in _PARTS.findall(text.lower())])
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = b"".join([self.id_bytes[t.id] for t in self.merged(part if part.isascii() else part.translate(_BYTE_MARKS))])
            if len(part) <= LONGEST_WORD:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a text."""
        return b"".join(map(self.__getitem__, text.encode().split()))


def parts_at_spaces(path: str) -> None:
    """Raises unless the tokenizer of the file drops white space before it looks for words, and parts words as ``_PARTS`` does.

    Then ids of words follow each other: the normaliser works on single characters and marks behind them, spaces are in no word,
    and added tokens hold no space and take none with them.
    """
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    normal, parts = made["normalizer"], made["pre_tokenizer"]
    kinds = [n["type"] for n in normal["normalizers"]] if normal and normal["type"] == "Sequence" else [normal and normal["type"]]
    first = parts["pretokenizers"][0] if parts and parts["type"] == "Sequence" else parts
    drops = first and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"] == {"Regex": PATTERN}
    quiet = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
    if not (drops and quiet and set(kinds) <= {"NFC", "Replace", "Lowercase"}):
        raise ValueError(f"the tokenizer of {path} may look across spaces")


def token_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
                 end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, number): pieces of the documents, numbered by length within their partition."""
    parts_at_spaces(path)
    rows = id_and_text(docs, id_column, text_column)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a task has few cores; each thread of the library keeps memory of its own
        words, part = WordIds(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                row, piece, size, sums = [], [], [], []
                for k, text in enumerate(some.column("text").to_pylist()):
                    ids = words.of(text) + end
                    for i, begin in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[begin:begin + 4 * length]
                        row.append(k)
                        piece.append(i)
                        size.append(len(cut) // 4)
                        sums.append(zlib.crc32(cut))
                sizes = np.array(size, dtype=np.int64)
                order = np.argsort(sizes, kind="stable")
                ordered = sizes[order]
                firsts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                runs = np.diff(np.append(firsts, len(ordered)))
                numbers = np.empty_like(sizes)
                numbers[order] = np.arange(len(ordered)) - np.repeat(firsts, runs) + seen[ordered]
                seen[ordered[firsts]] += runs
                places = np.array(piece, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(row, pa.int32())), pa.array(places, pa.int32()), *map(pa.array, (places * length, sizes)),
                     pa.array(sums, pa.int64()), pa.array(np.full(len(sizes), part), pa.int64()), pa.array(numbers)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "number"])
        words.clear()
        words.parts.clear()
        returned_memory()

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, number bigint")


def packed(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
           end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Pieces of a sequence stand behind each other from offset 0 on. A null or empty text has the end id alone. A null id stays null;
    repeated rows are documents of their own; an empty table gives an empty result. Other columns are not looked at.
    """
    pieces = stored(token_pieces(docs, path, id_column, text_column, length, end_id), "token-pieces")
    parts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # one row a length
    plan = Plan.of(counts, length)
    shipped = pieces.sparkSession.sparkContext.broadcast((plan.base, plan.start, plan.copies, plan.first, plan.offset, plan.bins))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(*shipped.value)
        for batch in batches:
            bins, offsets = plan.places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(firsts, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32",
                                                              (F.col("first") + F.col("number")).alias("number"))
    kind = docs.schema[id_column].dataType.simpleString()
    found = numbered.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return found.withColumnRenamed("id", id_column)
