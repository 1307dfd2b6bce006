"""Groups of spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted in each task before anything is shuffled; frequent ones make the vocabulary.
2. The gram dictionary: a gram is extended by one more code point as long as it stands in the vocabulary more
   often than a limit. Only the frequent grams have to be known for that, and the limit grows with the vocabulary,
   so there are at most ``FREQUENT`` of each length at any size: they are sent to the tasks.
3. A word (between two marks) is decomposed: at each place the shortest gram that is rare, or as long as grams get;
   grams inside an earlier one are dropped.
4. One edit can affect only so many grams of a word: those that hold the edited place, and those that a changed gram
   may come to cover. A near word has all the others, at the same place or, behind an edit that changes the
   length, one place on. So of the word's lists the longest may be left out of the merge, all but one more than can be affected:
   a near word is on one of the shortest, and the distance settles the rest. Where all grams of a word can be affected, it is
   listed by its shortest grams as well, of which one edit affects two.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import id_and_text, returned_memory, stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
# A word's form is at least so many times as frequent.
RATIO = 2
# Of the pairs (document, run) whose checksum this divides, the run loses one code point.
DELETED = 97
SHORTEST, LONGEST = 2, 4
# Frequent grams of one length, at most.
FREQUENT = 20_000
# Distinct words that a task counts before it hands them on; bounds its memory, not the result.
REMEMBERED = 400_000
SALTS = 8
BEGIN, END = "^", "$"

# latin-1 bytes: letters stay, A-Z become a-z, all else parts words; code points beyond latin-1 become "?"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of letters of a text with A-Z lower-cased, one byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def altered(run: bytes, start: int) -> bytes:
    """The run, without one code point where the checksum says so; ``start`` is the checksum of what goes before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word of at least so many code points and occurrences in all whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for found, n in Counter(runs_of(text.as_py())).items():
                    word = altered(found, start)
                    if len(word) >= least_length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= REMEMBERED:
                    yield counted()
        if counts:
            yield counted()
        returned_memory()

    partial = id_and_text(docs, id_column, text_column).mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the gram dictionary ----------------------------------------------------------


def frequent_grams(words: DataFrame, longest: int = LONGEST, most: int = FREQUENT) -> dict[str, int]:
    """How often each frequent gram stands in the vocabulary: at most ``most`` grams of each length."""
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    total = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    limit = total // most + 1  # the grams of one length have fewer than ``total`` places
    grams = None
    for n in range(SHORTEST, longest + 1):
        places = F.when(F.length("w") >= n, F.sequence(F.lit(1), F.length("w") - (n - 1)))
        found = marked.select(F.explode(places).alias("at"), "w").select(F.substr("w", F.col("at"), F.lit(n)).alias("gram"))
        grams = found if grams is None else grams.union(found)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return {r["gram"]: r["n"] for r in often.toLocalIterator()}


class GramIndex:
    """Decomposes words by a dictionary of frequent grams, and knows what one edit can do to a decomposition."""

    def __init__(self, frequent: dict[str, int], longest: int = LONGEST):
        self.frequent, self.longest = frequent, longest
        self.tails = {g[1:] for g in frequent}

    def grams(self, marked: str) -> list[tuple[int, int]]:
        """(first, last place) of the grams of a word between its marks; both rise from gram to gram."""
        frequent, longest, size, found, reached = self.frequent, self.longest, len(marked), [], -1
        for p in range(size - SHORTEST + 1):
            end = p + SHORTEST
            while end - p < longest and end < size and marked[p:end] in frequent:
                end += 1
            if end - 1 > reached:
                reached = end - 1
                found.append((p, reached))
        return found

    def affected(self, marked: str, grams: list[tuple[int, int]]) -> int:
        """A bound on how many of the grams one inserted, deleted or replaced code point can affect.

        An edit at a place, or just behind it, changes the grams that hold the place. A changed gram may also grow over a gram behind
        the place, but only as far as grams get, and only if the part in between is the end of a frequent gram.
        """
        counts = [0] * len(marked)
        for first, last in grams:
            for i in range(first, last + 1):
                counts[i] += 1
            for i in range(max(0, last - self.longest + 1), first):
                if marked[i + 1:last] in self.tails:
                    counts[i] += 1
        return max(counts[:-1])  # nothing comes behind the end mark

    def lists(self, word: str) -> list[tuple[str, int]]:
        """(gram, place) of the lists that a word is on: every near word is on one of them, but for the place behind the edit."""
        marked = BEGIN + word + END
        found = self.grams(marked)
        affected = self.affected(marked, found)
        chosen = [("v" + g, p) for g, p in self._rarest(marked, found, affected + 1)]
        if affected >= len(found):
            pairs = [(p, p + SHORTEST - 1) for p in range(len(marked) - SHORTEST + 1)]
            chosen += [("s" + g, p) for g, p in self._rarest(marked, pairs, SHORTEST + 1)]
        return chosen

    def _rarest(self, marked: str, places: list[tuple[int, int]], n: int) -> list[tuple[str, int]]:
        grams = [(marked[first:last + 1], first) for first, last in places]
        grams.sort(key=lambda g: (self.frequent.get(g[0], 0), g))
        return grams[:n]


def near_pairs(words: DataFrame, longest: int = LONGEST, most: int = FREQUENT) -> DataFrame:
    """(a, b, a_n, b_n): each two words that differ by one inserted, deleted or replaced code point, once.

    ``words`` has word and n.
    """
    shipped = words.sparkSession.sparkContext.broadcast(frequent_grams(words, longest, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GramIndex(shipped.value, longest)
        for batch in batches:
            keys, probes, rows = [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                size = len(word)
                for gram, p in index.lists(word):
                    own = f"{size}:{p}{gram}"
                    keys.append(own)
                    # words as long, and shorter ones: a gram behind the deleted code point stands one place before
                    probes.append([own, f"{size - 1}:{p}{gram}", f"{size - 1}:{p - 1}{gram}"])
                    rows.append(row)
            listed = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*listed.columns, pa.array(keys, pa.string()), pa.array(probes, pa.list_(pa.string()))],
                                             names=["word", "n", "key", "probes"])
        returned_memory()

    listed = stored(words.select("word", "n").mapInArrow(run, "word string, n bigint, key string, probes array<string>"), "gram-lists")
    left = listed.select(F.explode("probes").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = listed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "key").where((F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


# --- forms and their roots --------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form): where following forms ends.

    Pointers are doubled in each round. A form is at least ``RATIO`` times as frequent as its word, so a path has fewer than 64 steps.
    """
    to = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(6):
        # many words may lead to one form: its one row is salted
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = to.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(ahead, ["root", "salt"], "left")
        to = stored(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if to.where("moved").isEmpty():
            break
    return to.select("word", "root")


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST,
                    most: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least 5 code points that occurs at least 3 times.

    ``form`` is the near word (one edit apart) that occurs most often, of equally frequent ones the first in code-point order,
    if it occurs at least twice as often as the word; ``root`` is where following forms ends. A null text is empty, and texts
    without letters add nothing; a null id counts as an empty one in the checksum. Repeated rows count each. An empty table, or one
    without frequent words, gives an empty result. Other columns are not looked at.
    """
    words = stored(word_counts(docs, id_column, text_column), "words")
    pairs = stored(near_pairs(words, longest, most), "near-words")
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
                               for x, y in ("ab", "ba")])).alias("e")
    best = (pairs.select(ends).select("e.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")))
    joined = words.join(best, "word", "left")
    often = -F.col("best.less") >= RATIO * F.col("n")
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                 F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "word-forms")
    ends_at = roots(found.where("form IS NOT NULL"))
    return (found.join(ends_at, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
