"""N-gram Jaccard join over word shingles: exact links, through tries of globally ordered sets.

Shingles stand as 64-bit hashes; their numeric order is the one global order of all sets.

1. One pass gives each text its set's size and a 128-bit digest. Equal sets are one node from here on.
2. Candidates by the pigeonhole rule: two linked sets differ in at most H shingles, so of more than H
   parts of the hash space at least one holds the same shingles in both. Each set gives a key for
   each part that is not empty, the hash of the part's whole content. A frequent shingle alone makes no key common.
   Keys of the same sets count once. Candidates of one key are met by a bitmap filter: bit i of a set's bitmap is the parity of its shingles that
   fall on i, and two bitmaps differ in no more bits than the sets differ in shingles. Bitmaps grow with the sets, so
   the filter passes few pairs that are not linked, at any size, and clusters stay close to what is linked.
3. Connected sets of candidates are small clusters. Each cluster, or for a cluster of very many
   sets each bounded block of it, is joined in one task through a trie: sets that begin alike
   share a path, so their overlap with a query is counted once; a subtree is left as soon as the
   overlap so far plus what can remain is short of what a link needs, or if all of it is linked with the query already.
4. Blocks of a large cluster that are not linked through yet meet block by block.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loometric.llm.common import (id_and_text, lower_ascii, mixed, over_batches, returned_memory, run_hashes, spaced_words,
                                  stored, text_chunks)
from loometric.llm.components import components

WORDS = 4
# A link: 100 * intersection >= 85 * union.
PERCENT = 85
# Shingles of the sets that one task joins: bounds its memory, not the result.
BLOCK_SHINGLES = 1 << 19
# Digests that a task remembers, so that copies in it give their keys once; only saves work.
REMEMBERED = 100_000
SALTS = 8

# Least bits of a set's bitmap, and how many sets of one list, and MB of their bitmaps, are met by it at once; a
# longer list is cut into blocks of that size, of which each two meet: bounds a task's memory, not the result.
BITS = 512
GROUP = 1 << 15
GROUP_MB = 16
# Sets of one key whose list is looked at as a whole: bounds a task's memory, not the result.
HELD = 1 << 16

_ONE, _TWO = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, all its words."""
    starts, ends, firsts = spaced_words(data, offsets)
    hashes = run_hashes(lower_ascii(data), starts, ends)
    padded = np.concatenate((hashes, np.zeros(words, dtype=np.uint64)))
    grams = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        grams = (grams + padded[k:k + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    grams = mixed(grams)
    for begin, end in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        n = end - begin
        if n >= words:
            yield np.unique(grams[begin:end - words + 1])
        elif n:
            total = np.uint64(n)
            for h in hashes[begin:end]:
                total = np.uint64((int(total) * 0xD6E8FEB86659FD93 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([total]))
        else:
            yield grams[:0]


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    n = np.uint64(len(shingles))
    sums = [np.add.reduce(mixed(shingles ^ salt), dtype=np.uint64) for salt in (_ONE, _TWO)]
    return tuple(mixed(np.array(sums, dtype=np.uint64) + n).view(np.int64).tolist())


class SizeClasses:
    """Classes of set sizes: (end, most differences of two linked sets, parts) of each.

    Parts are more than the differences, by about as many as may be empty.
    """

    def __init__(self, percent: int, upto: int = 1 << 40):
        self.percent, self.classes, low = percent, [], 1
        while low < upto:
            end = max(low + 1, (low * 7 + 4) // 5)
            differences = (100 - percent) * 2 * (end - 1) // (100 + percent)
            parts = differences + 1
            for _ in range(4):
                empty = parts * np.exp(-low / parts)
                parts = differences + 2 + int(empty + 4 * np.sqrt(empty))
            self.classes.append((end, differences, parts))
            low = end
        self.ends = np.array([end for end, _, _ in self.classes])

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of a set: two linked sets that differ have one in common."""
        n = len(shingles)
        content = mixed(shingles ^ np.uint64(0x8EBC6AF09C88C6E3))
        keys = []
        first = int(np.searchsorted(self.ends, n, side="right"))
        last = int(np.searchsorted(self.ends, 100 * n // self.percent, side="right"))
        for c in range(first, last + 1):
            _, differences, parts = self.classes[c]
            if not differences:
                continue
            part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(content, at)
            keys.append(mixed(sums + mixed(np.uint64(c << 40) + part[at] + np.uint64(1))))
            if parts - len(at) >= parts - differences:  # so many empty parts that they may be all that agrees
                missing = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[at])
                keys.append(mixed(mixed(np.uint64(c << 40) + missing + np.uint64(1))))
        return np.concatenate(keys) if keys else shingles[:0]


def bits_for(n: int) -> int:
    """At least twice as many bits as shingles, so that bitmaps tell sets of any size apart; a power of two."""
    return max(BITS, 1 << max(2 * n - 1, 0).bit_length())


def bitmap(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """Parities of the shingles that fall on each bit."""
    place = (shingles ^ (shingles >> np.uint64(17))) & np.uint64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).tobytes()


def same_bits(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of sets of unlike sizes as rows of the least of their widths: the halves of a wider one are added up."""
    width, rows = min(map(len, bitmaps)), []
    for bits in bitmaps:
        row = np.frombuffer(bits, dtype=np.uint64)
        while 8 * len(row) > width:
            row = row[:len(row) // 2] ^ row[len(row) // 2:]
        rows.append(row)
    return np.stack(rows)


def set_digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, d1, d2, bits) of every row: size, digest and bitmap of its set."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ones, twos, bits = [], [], [], []
        for _, _, data, offsets in text_chunks(batch.column("text")):
            for shingles in shingle_sets(data, offsets, words):
                one, two = digest(shingles)
                sizes.append(len(shingles))
                ones.append(one)
                twos.append(two)
                bits.append(bitmap(shingles, bits_for(len(shingles))))
        return pa.RecordBatch.from_arrays(
            [batch.column("id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (sizes, ones, twos)], pa.array(bits, pa.binary())],
            names=["id", "n", "d1", "d2", "bits"])

    return over_batches(docs, run, "id bigint, n bigint, d1 bigint, d2 bigint, bits binary")


def candidate_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(d1, key): the keys of every set, once for each task that meets it.

    Half a digest names a set here. Of a key 48 bits are shuffled: two keys that agree in them make candidates, and lose none.
    """
    classes = SizeClasses(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                keys, ones = [], []
                for shingles in shingle_sets(data, offsets, words):
                    if not len(shingles):
                        continue
                    one, two = digest(shingles)
                    if (one, two) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((one, two))
                    found = classes.keys(shingles)
                    keys.append((found >> np.uint64(16)).view(np.int64))
                    ones.append(np.full(len(found), one))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ones, keys)], names=["d1", "key"])
        seen.clear()
        returned_memory()

    return docs.select("text").mapInArrow(run, "d1 bigint, key bigint")


def shared_keys(keys: DataFrame, held_rows: int = HELD) -> DataFrame:
    """(key, d1): the distinct lists of sets that share a key, under a name for each list.

    Two near copies share nearly all their keys: their list comes once, not once for each key. The keys are sorted by Spark and read
    in one sweep that holds at most ``held_rows`` rows of a key and a batch; a key of more sets is a list by itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2), dtype=np.int64)  # rows of the last key, which may go on
        long = None  # a key of which rows were given under its own name already
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in ("key", "d1")], axis=1)))
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[fresh]
            cut = int(np.argmax(rows[:, 0] == rows[-1, 0]))
            whole, held = rows[:cut], rows[cut:]
            found = [key_lists(whole, long)] if cut else []
            if len(held) > held_rows:
                long = int(held[0, 0])
                found.append(held[:-1])
                held = held[-1:]
            for lists in found:
                if len(lists):
                    yield _columns(lists, ["key", "d1"])
        if len(held):
            lists = key_lists(held, long)
            if len(lists):
                yield _columns(lists, ["key", "d1"])
        returned_memory()

    ordered = keys.repartition("key").sortWithinPartitions("key", "d1")
    return ordered.mapInArrow(run, "key bigint, d1 bigint").distinct()


def key_lists(rows: np.ndarray, long: int | None = None) -> np.ndarray:
    """(list, set) of sorted distinct (key, set) rows, for each list of at least two sets once; the key ``long`` stays a list of its own."""
    at = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
    sizes = np.diff(np.append(at, len(rows)))
    own = rows[at, 0] == long if long is not None else np.zeros(len(at), dtype=bool)
    sums = np.add.reduceat(mixed(np.ascontiguousarray(rows[:, 1]).view(np.uint64) ^ _ONE), at)
    names = np.where(own, rows[at, 0], mixed(sums + sizes.astype(np.uint64)).view(np.int64))
    wanted = np.flatnonzero((sizes > 1) | own)
    _, first = np.unique(names[wanted], return_index=True)
    keep = np.zeros(len(at), dtype=bool)
    keep[wanted[first]] = True
    of_rows = np.repeat(keep, sizes)
    return np.stack((np.repeat(names, sizes)[of_rows], rows[of_rows, 1]), axis=1)


def _columns(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)


def alike_groups(sizes: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows which size and bitmap allow to be linked.

    Rows are looked at by size, so a row meets only those whose size allows a link.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, words = sizes[order].astype(np.int64), np.ascontiguousarray(bits[order].T)
    short = words  # folded twice: unrelated sets of any size still differ in more of these bits than linked ones may
    while len(short) > max(2, len(words) // 4):
        short = short[:len(short) // 2] ^ short[len(short) // 2:]
    # rows of no group yet, and some of those that found theirs of late
    left, left_sizes, left_short = np.arange(len(order)), sizes, short
    free, n_free = np.ones(len(order), dtype=bool), len(order)
    found, todo, first = [], [], 0
    while n_free:
        if todo:
            i = todo.pop()
        else:
            while not free[left[first]]:
                first += 1
            i = left[first]
            free[i], n_free = False, n_free - 1
        n = sizes[i]
        begin, end = np.searchsorted(left_sizes, -(-percent * n // 100)), np.searchsorted(left_sizes, 100 * n // percent, side="right")
        apart = np.bitwise_count(left_short[:, begin:end] ^ short[:, i, None]).sum(axis=0, dtype=np.int64)
        rows = left[begin:end][apart * (100 + percent) <= (100 - percent) * (n + left_sizes[begin:end])]
        rows = rows[free[rows]]
        if len(rows):
            apart = np.bitwise_count(words[:, rows] ^ words[:, i, None]).sum(axis=0, dtype=np.int64)
            rows = rows[apart * (100 + percent) <= (100 - percent) * (n + sizes[rows])]
        if len(rows):
            found += [(int(order[j]), int(order[i])) for j in rows]
            todo += rows.tolist()
            free[rows], n_free = False, n_free - len(rows)
        if 4 * n_free < 3 * len(left):
            left = left[free[left]]
            left_sizes, left_short, first = sizes[left], short[:, left], 0
    return found


def dealt_lists(shared: DataFrame, sets: DataFrame, group: int = GROUP, group_mb: float = GROUP_MB) -> DataFrame:
    """``shared``, in which the rows of a list that is too long for one task stand under a new name for each two blocks of the list.

    A set's block is a hash of it. Each two sets of a list are in one of the new lists at least.
    """
    long = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group // 16).select("key")
    widths = shared.join(long, "key").join(sets.select("d1", F.octet_length("bits").alias("width")), "d1")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / group, F.sum("width") / (group_mb * 1e6))).cast("int")
    cut = stored(widths.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1"), "long-lists")
    own = F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int")
    others = F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))
    placed = shared.join(cut, "key", "left").withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)))
    name = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return placed.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(name).alias("key"), "d1")


def candidate_links(shared: DataFrame, sets: DataFrame, percent: int = PERCENT, group: int = GROUP, group_mb: float = GROUP_MB) -> DataFrame:
    """(a, b): names of sets that are in one list of ``shared`` and may be linked; connected sets may have fewer pairs.

    ``sets`` has d1, d2, n and bits of each set. Sets that only share a list, however long, are no candidates.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out = []

        def flush() -> None:
            if len(held) > 1:
                sizes = np.array([r[3] for r in held])
                out.extend((held[i], held[j]) for i, j in alike_groups(sizes, same_bits([r[4] for r in held]), percent))
            held.clear()

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if held and held[-1][0] != row[0]:
                    flush()
                held.append(row)
            if out:
                pairs = np.array([(*a[1:3], *b[1:3]) for a, b in out], dtype=np.int64)
                out.clear()
                yield _columns(pairs, ["a1", "a2", "b1", "b2"])
        flush()
        if out:
            yield _columns(np.array([(*a[1:3], *b[1:3]) for a, b in out], dtype=np.int64), ["a1", "a2", "b1", "b2"])
        returned_memory()

    rows = dealt_lists(shared, sets, group, group_mb).join(sets, "d1").select("key", "d1", "d2", "n", "bits")
    ordered = rows.repartition("key").sortWithinPartitions("key", "n", "d1", "d2")
    pairs = ordered.mapInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct()
    return pairs.select(_name("a1", "a2").alias("a"), _name("b1", "b2").alias("b"))


# --- the trie ---------------------------------------------------------------------


class _Node:
    """A run of shingles that all sets below share, and how long these sets are."""

    __slots__ = ("shingles", "children", "ends", "least", "most", "one", "alike")

    def __init__(self, shingles: np.ndarray, n: int, one: int):
        self.shingles, self.children, self.ends = shingles, {}, []
        self.least = self.most = n
        self.one, self.alike = one, True


class SetTrie:
    """Sets in a prefix tree; ``add`` links a set with the sets that are in the tree already.

    Of the links between sets that are connected through other links only some are found:
    the groups are right, and ``links`` is a forest that spans them.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.root = _Node(np.empty(0, dtype=np.uint64), 1 << 60, -1)
        self.root.least, self.root.most = 1 << 60, 0
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def number(self, group: int | None = None) -> int:
        """A new set's number; ``group`` is the number of a set that it is known to be connected with."""
        self.parent.append(len(self.parent) if group is None else self.find(group))
        return len(self.parent) - 1

    def add(self, shingles: np.ndarray, number: int) -> None:
        self._search(shingles, number)
        self._insert(shingles, number)

    def _search(self, query: np.ndarray, number: int) -> None:
        n, percent = len(query), self.percent
        stack = [(self.root, 0, 0, 0)]  # node, its depth, place in the query, overlap above the node
        while stack:
            node, depth, place, overlap = stack.pop()
            if node.most * 100 < percent * n or n * 100 < percent * node.least:
                continue
            if node.alike and node.one >= 0 and self.find(node.one) == self.find(number):
                continue
            need = -(-percent * (n + max(node.least, -(-percent * n // 100))) // (100 + percent))
            if overlap + min(n - place, node.most - depth) < need:
                continue
            if len(node.shingles):
                at = place + np.searchsorted(query[place:], node.shingles)
                inside = at < n
                overlap += int(np.count_nonzero(query[at[inside]] == node.shingles[inside]))
                place = int(at[-1])
                if place < n and query[place] == node.shingles[-1]:
                    place += 1
                depth += len(node.shingles)
                if overlap + min(n - place, node.most - depth) < need:
                    continue
            if node.ends and overlap * (100 + percent) >= percent * (n + depth):
                for other in node.ends:
                    a, b = self.find(number), self.find(other)
                    if a != b:
                        self.parent[a] = b
                        self.links.append((number, other))
            stack.extend((child, depth, place, overlap) for child in node.children.values())

    def _insert(self, shingles: np.ndarray, number: int) -> None:
        node, place, n = self.root, 0, len(shingles)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one < 0:
                node.one = number
            elif node.alike and self.find(node.one) != self.find(number):
                node.alike = False
            if place == n:
                node.ends.append(number)
                return
            child = node.children.get(int(shingles[place]))
            if child is None:
                leaf = _Node(shingles[place:], n, number)
                leaf.ends.append(number)
                node.children[int(shingles[place])] = leaf
                return
            both = min(len(child.shingles), n - place)
            differs = child.shingles[:both] != shingles[place:place + both]
            same = int(np.argmax(differs)) if differs.any() else both
            if same < len(child.shingles):
                upper = _Node(child.shingles[:same], child.least, child.one)
                upper.most, upper.alike = child.most, child.alike
                child.shingles = child.shingles[same:]
                upper.children[int(child.shingles[0])] = child
                node.children[int(shingles[place])] = upper
                child = upper
            node, place = child, place + same


def _block_join(percent: int, words: int):
    """Groups within one block: rows (cluster, block, node, known, packed text) to (a, b), a node and its group's smallest.

    ``known`` names nodes that are connected already.
    """
    def run(table: pa.Table) -> pa.Table:
        nodes, known = table.column("node").to_pylist(), table.column("known").to_pylist()
        sets: list[np.ndarray] = []
        for packed in table.column("packed").to_pylist():
            sets.extend(s.copy() for s in _unpacked(packed, words))
        trie, groups, found = SetTrie(percent), {}, {}
        for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i])):
            if nodes[i] in found:  # a repeated row
                continue
            number = trie.number(groups.get(known[i]))
            found[nodes[i]] = number
            groups.setdefault(known[i], number)
            trie.add(sets[i], number)
        # a star for each group: its sets with the smallest name
        least: dict[int, str] = {}
        for name, number in found.items():
            root = trie.find(number)
            least[root] = min(name, least.get(root, name))
        pairs = [(name, least[trie.find(number)]) for name, number in found.items()]
        pairs = [(a, b) for a, b in pairs if a != b]
        del sets, trie
        returned_memory()
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})

    return run


def _name(*columns: str):
    return F.concat_ws(":", *[F.hex(c) for c in columns])


def near_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id among the rows whose text is reachable by links between
    texts. A null text is empty; a text without words has no set, no link, and its own id.
    Rows with a null id take part like others but are never a component's name while another id
    is there. A repeated id is a document for each of its rows. An empty table gives an empty result.
    """
    sets, linked = _linked_sets(id_and_text(docs, id_column, text_column), words, percent, block_shingles)
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("rows"))
    classes = linked.select("node", "root").join(least.where("rows > 1"), "root").select("node", "component_id")
    return (_with_classes(sets, classes)
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))


def _with_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``sets`` with what ``classes`` says of their node, or nulls."""
    # a class of copies may be a third of all rows: its few rows are salted, not the documents collected
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sets.select("id", "n", "d1", "d2", _name("d1", "d2").alias("node"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(salted, ["node", "salt"], "left")


def _linked_sets(texts: DataFrame, words: int, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, d1, d2, bits) of every row, and (node, rep, rows, n, root) of every set: its smallest id, its rows, its component's root."""
    sets = stored(set_digests(texts, words), "set-digests")
    node = _name("d1", "d2").alias("node")
    reps = sets.where("n > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    shared = stored(shared_keys(candidate_keys(texts, words, percent)), "shared-keys")
    clusters = components(candidate_links(shared, reps.select("d1", "d2", "n", "bits"), percent))
    named = reps.select(node, "rep", "rows", "n")
    members = stored(clusters.join(named, "node").withColumnRenamed("root", "cluster"), "cluster-members")
    # blocks of bounded size; the first set of a cluster is in each of its blocks
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    placed = (members.join(blocks, "cluster")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    spread = placed.withColumn("block", F.explode(
        F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    schema = "a string, b string"
    join = _block_join(percent, words)
    # the text of a set: that of its smallest id; the digest tells rows of a repeated id apart
    bodies = stored(_texts_of(texts, members, words), "cluster-texts")
    first = (spread.join(bodies, "node").withColumn("known", F.col("node"))
             .select("cluster", "block", "node", "known", "packed").groupBy("cluster", "block").applyInArrow(join, schema))
    found = stored(first, "near-links")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        roots = components(found)
        state = stored(large.join(roots, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root"), "cluster-state")
        sizes = state.groupBy("cluster", "known").agg(F.sum("n").alias("weight"))
        main = sizes.groupBy("cluster").agg(F.max_by("known", F.struct("weight", "known")).alias("main"), F.count(F.lit(1)).alias("groups"))
        open_ones = state.join(main.where("groups > 1"), "cluster")
        meet = F.sequence(F.lit(0), F.col("blocks") - 1)
        # group (i, j): block i with those sets of block j that are outside the main group
        own = open_ones.withColumn("i", F.col("block")).withColumn("j", F.explode(meet))
        outside = open_ones.where("known <> main").withColumn("j", F.col("block")).withColumn("i", F.explode(meet)).where("i <> j")
        columns = ("cluster", "i", "j", "node", "known")
        pairs = own.select(*columns).union(outside.select(*columns)).join(bodies, "node")
        found = found.union(stored(pairs.groupBy("cluster", "i", "j").applyInArrow(join, schema), "near-links"))
    roots = components(found)
    return sets, named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unpacked(packed: bytes, words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), words)


def _texts_of(texts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, packed) of the sets in ``members``: the compressed text of one row with that set.

    Texts are compressed before they are shuffled.
    """
    wanted = members.select(F.col("rep").alias("wanted"), "node")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(t.as_py().encode(), 1) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(packed, pa.binary())], names=["id", "packed"])

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = [any(_hex_name(s) == node for s in _unpacked(packed, words))
                for node, packed in zip(batch.column("node").to_pylist(), batch.column("packed").to_pylist())]
        return batch.filter(pa.array(same, pa.bool_()))

    rows = over_batches(texts, pack, "id bigint, packed binary")
    # the same plan at every size: both sides are shuffled and merged
    found = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("wanted"))).select("node", "packed")
    return over_batches(found, keep, "node string, packed binary")


def _hex_name(shingles: np.ndarray) -> str:
    return ":".join(f"{x & 0xFFFFFFFFFFFFFFFF:X}" for x in digest(shingles))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each component keeps the one with the smallest id.

    Rows are told apart by id and set, so of a repeated id only the rows of the component go; of sets with the same id the first by
    name stays, and of rows that repeat both id and set one. A text without words is linked with nothing; of such rows that repeat
    both id and text one stays. Rows with a null id stay unless their text is there again with the same (null) id.
    """
    sets, linked = _linked_sets(id_and_text(docs, id_column, text_column), words, percent, BLOCK_SHINGLES)
    heads = linked.groupBy("root").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "node"))).alias("head"), F.sum("rows").alias("rows"))
    classes = linked.select("node", "root").join(heads.where("rows > 1"), "root").select("node", "head")
    met = _with_classes(sets, classes).where("NOT (id = head.rep AND node = head.node)")
    mark = uuid.uuid4().hex
    one, two = f"one_{mark}", f"two_{mark}"
    gone = met.select(F.col("id").alias(f"id_{mark}"), F.col("d1").alias(f"d1_{mark}"), F.col("d2").alias(f"d2_{mark}")).distinct()
    marked = _marked(docs, id_column, text_column, words, one, two)
    same = (F.col(id_column) == F.col(f"id_{mark}")) & (F.col(one) == F.col(f"d1_{mark}")) & (F.col(two) == F.col(f"d2_{mark}"))
    left = marked.join(gone.hint("merge"), same, "left_anti")
    return left.dropDuplicates([id_column, one, two]).drop(one, two)


def _marked(docs: DataFrame, id_column: str, text_column: str, words: int, one: str, two: str) -> DataFrame:
    """``docs`` with the digest of each row's set as two more columns; texts without words and rows without an id have that of the characters."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(text_column).cast(pa.string()), "")
        ids = batch.column(id_column)
        ones, twos = [], []
        for row, _, data, offsets in text_chunks(texts):
            for k, shingles in enumerate(shingle_sets(data, offsets, words)):
                if len(shingles) and ids[row + k].is_valid:
                    first, second = digest(shingles)
                else:
                    characters = hashlib.blake2b(texts[row + k].as_py().encode(), digest_size=16).digest()
                    first, second = np.frombuffer(characters, dtype=np.int64).tolist()
                ones.append(first)
                twos.append(second)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ones, pa.int64()), pa.array(twos, pa.int64())],
                                          names=[*batch.schema.names, one, two])

    schema = StructType([*docs.schema.fields, StructField(one, LongType()), StructField(two, LongType())])
    return over_batches(docs, run, schema)
