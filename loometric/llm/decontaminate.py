"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words with single spaces. An item of n
characters may differ by ``budget`` = n * percent // 100 edits. Cut into budget + 1 pieces, any
place within that budget holds at least one piece unchanged; an Aho-Corasick automaton over
all pieces finds these in one sweep of a text, and Myers' bit-parallel distance verifies the window around each.

Short pieces are hit by chance, so a hit is verified from the piece outwards. The same rule holds for
any run of m pieces with m - 1 edits: halving the item again and again, some unchanged piece has
only such runs above it. Most chance hits fail with the piece next to theirs.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import id_and_text, returned_memory

PERCENT = 10
# Characters of test items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 1_000_000
# Parts of an item with up to so many pieces are verified on their own before the whole item is.
SMALL_PART = 8

_WORDS = re.compile(r"[^\W_]+")
_GAPS = re.compile(r"[\W_]+")

MATCHES = "id bigint, item_id bigint, distance int, budget int, start int, end int"


def plain(text: str) -> str:
    """Lower-case words with single spaces."""
    return _GAPS.sub(" ", text.lower()).strip(" ")


def pieces(item: str, percent: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    parts = len(item) * percent // 100 + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def closest(masks: dict[str, int], length: int, window: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern in ``window``, the earliest of equals; None beyond the budget.

    Myers' algorithm: one column of the edit table is two bit vectors, for steps up and down.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    up, down, score = full, 0, length
    best = (budget + 1, -1)
    get = masks.get
    for i, c in enumerate(window):
        equal = get(c, 0)
        x = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best[0]:
                best = (score, i + 1)
        plus <<= 1  # a place may begin anywhere: the first row stays zero
        minus <<= 1
        up = (minus | ~(x | plus)) & full
        down = plus & x & full
    return best if best[0] <= budget else None


def ends_within(masks: dict[str, int], length: int, window: str, budget: int, offset: int = 0) -> Iterator[tuple[int, int]]:
    """(offset + end, distance) of every place of the pattern within the budget, of all starts the nearest one."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    up, down, score = full, 0, length
    get = masks.get
    for i, c in enumerate(window, offset + 1):
        equal = get(c, 0)
        x = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score <= budget:
            yield i, score
        plus <<= 1
        minus <<= 1
        up = (minus | ~(x | plus)) & full
        down = plus & x & full


class Part:
    """A run of pieces of an item: ``edits`` is one less than their number."""

    __slots__ = ("begin", "end", "edits", "masks")

    def __init__(self, pattern: str, begin: int, end: int, edits: int):
        self.begin, self.end, self.edits = begin, end, edits
        self.masks = letter_masks(pattern[begin:end])


class Leaf:
    """A piece of an item, what must stand beside it, and the parts around it from small to large."""

    __slots__ = ("number", "offset", "beside", "slack", "parts")

    def __init__(self, number: int, offset: int, beside: list[tuple[int, str]], slack: int, parts: list[Part]):
        self.number, self.offset, self.beside, self.slack, self.parts = number, offset, beside, slack, parts


def leaves(number: int, pattern: str, percent: int) -> list[tuple[str, Leaf]]:
    """Every piece of an item with its leaf."""
    cut = pieces(pattern, percent)
    found: list[tuple[str, Leaf]] = []

    def halved(low: int, high: int, above: list[Part], beside: range) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            begin, end = cut[low][0], cut[high - 1][0] + len(cut[high - 1][1])
            parts = [Part(pattern, begin, end, high - low - 1), *above] if high - low <= SMALL_PART and (low, high) != (0, len(cut)) else above
            halved(low, middle, parts, range(middle, high))
            halved(middle, high, parts, range(low, middle))
            return
        # m pieces with m - 1 edits, one unchanged: of the halves of the others at least one is unchanged too
        halves = []
        for i in beside:
            offset, piece = cut[i]
            half = len(piece) // 2
            halves += [(offset, piece[:half]), (offset + half, piece[half:])]
        found.append((cut[low][1], Leaf(number, cut[low][0], halves, len(beside), above)))

    halved(0, len(cut), [], range(0))
    return found


class Searcher:
    """Test items as an automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items = []
        found: dict[str, list[Leaf]] = {}
        for item_id, text in items:
            pattern = plain(text)
            if not pattern:
                continue
            for piece, leaf in leaves(len(self.items), pattern, percent):
                found.setdefault(piece, []).append(leaf)
            budget = len(pattern) * percent // 100
            self.items.append((item_id, len(pattern), budget, letter_masks(pattern), letter_masks(pattern[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item number, distance, budget, start, end) in the plain text; places of one item don't overlap."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for leaf in where:
                base = last + 1 - size - leaf.offset
                _, length, budget, _, _ = self.items[leaf.number]
                begin, end = max(0, base - budget), base + length + budget
                spans = windows.get(leaf.number)
                if spans and spans[-1][0] <= begin and end <= spans[-1][1]:
                    continue
                if self._holds_around(leaf, base, text):
                    windows.setdefault(leaf.number, []).append([begin, end])
        found = []
        for number, spans in windows.items():
            for begin, end in joined(spans):
                found.extend(self._verified(number, text, begin, min(end, len(text))))
        return found

    @staticmethod
    def _holds_around(leaf: Leaf, base: int, text: str) -> bool:
        slack = leaf.slack
        if leaf.beside:
            for offset, half in leaf.beside:
                at = base + offset
                if at + len(half) + slack > 0 and text.find(half, max(0, at - slack), at + len(half) + slack) >= 0:
                    break
            else:
                return False
        for part in leaf.parts:
            window = text[max(0, base + part.begin - part.edits):max(0, base + part.end + part.edits)]
            if closest(part.masks, part.end - part.begin, window, part.edits) is None:
                return False
        return True

    def _verified(self, number: int, text: str, begin: int, end: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Places within ``begin`` to ``end`` that don't overlap, the best first.

        One sweep gives all ends within the budget. A place that is taken changes only the ends that a place may reach from
        behind it: these are swept again, from its end on.
        """
        _, length, budget, masks, back = self.items[number]
        reach = length + budget
        near = dict(ends_within(masks, length, text[begin:end], budget, begin))
        queue = [(distance, stop) for stop, distance in near.items()]
        heapq.heapify(queue)
        starts: list[int] = []  # of the places taken, and their ends
        taken: list[int] = []
        while queue:
            distance, stop = heapq.heappop(queue)
            if near.get(stop) != distance:
                continue
            k = bisect.bisect_right(taken, stop)
            edge = max(begin, stop - reach, taken[k - 1] if k else 0)
            start = stop - anchored(back, length, text[edge:stop][::-1], distance)
            yield number, distance, budget, start, stop
            limit = min(end, stop + reach, starts[k] if k < len(starts) else end)
            taken.insert(k, stop)
            starts.insert(k, start)
            for i in range(start + 1, stop + 1):
                near.pop(i, None)
            behind = dict(ends_within(masks, length, text[stop:limit], budget, stop))
            for i in range(stop + 1, limit + 1):
                if i in near and behind.get(i) != near[i]:
                    if i in behind:
                        near[i] = behind[i]
                        heapq.heappush(queue, (behind[i], i))
                    else:
                        del near[i]


def joined(spans: list[list[int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def anchored(masks: dict[str, int], length: int, window: str, distance: int) -> int:
    """The shortest beginning of ``window`` that is ``distance`` from the pattern."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    up, down, score = full, 0, length
    if score == distance:
        return 0
    for i, c in enumerate(window):
        equal = masks.get(c, 0)
        x = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score == distance:
            return i + 1
        plus = plus << 1 | 1  # the beginning is fixed: the first row counts up
        minus <<= 1
        up = (minus | ~(x | plus)) & full
        down = plus & x & full
    return len(window)


class Origin:
    """Where the words of a plain text stand in the given text."""

    def __init__(self, text: str):
        lowered = text.lower()
        self.size, place = len(text), 0
        self.places, self.afters, self.spans = [], [], []
        for word in _WORDS.finditer(text if len(lowered) == len(text) else lowered):
            self.places.append(place)
            self.afters.append(place + len(word[0]))
            self.spans.append(word.span())
            place = self.afters[-1] + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Code points that the plain text's span comes from, to whole words."""
        first, last = bisect.bisect_right(self.afters, start), bisect.bisect_left(self.places, end) - 1
        if first > last:
            return 0, 0
        return self.spans[first][0], min(self.spans[last][1], self.size)


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that the plain text's span comes from, to whole words."""
    return Origin(text).span(start, end)


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of test items, each of about ``block_chars`` characters: what is sent to the tasks at once."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).sort("i", "t")
        yield [(r["i"], r["t"]) for r in part.collect()]


def _matching(items: list[tuple[int, str]], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, percent)
        for batch in batches:
            rows = []
            for row_id, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = value.as_py()
                places = searcher.places(plain(text))
                origin = Origin(text) if places else None
                for number, distance, budget, start, end in places:
                    first, last = origin.span(start, end)
                    rows.append((row_id, searcher.items[number][0], distance, budget, first, last))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["id", "item_id", "distance", "budget", "start", "end"])

    return run


def benchmark_matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, budget, start, end): every place of a test item in a document.

    Places of one item in one row don't overlap; the best is taken first, the earliest of equals.
    ``start`` and ``end`` are code points of the given text, at word edges. Null and empty texts, and
    null items or items without a letter or digit, match nothing. Repeated rows give their places
    again; repeated items count once. Without documents or items the result is empty.
    """
    texts = id_and_text(docs, id_column, text_column)
    found = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        part = texts.mapInArrow(_matching(block, percent), MATCHES)
        found = part if found is None else found.union(part)
    if found is None:
        found = texts.sparkSession.createDataFrame([], MATCHES)
    return found.withColumnRenamed("id", id_column)


def decontaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
                   item_text: str = "text", percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item. Texts pass no shuffle."""
    def keep(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block, percent)
            for batch in batches:
                clean = [not (text.as_py() and searcher.places(plain(text.as_py()))) for text in batch.column(text_column)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            returned_memory()

        return run

    for block in item_blocks(items, item_id, item_text, block_chars):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
