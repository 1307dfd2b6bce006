"""Merkle manifest of a dataset: a digest of every row, trees of digests, and each row's proof up to the root.

1. A leaf is the digest of a row's fields. Leaves are ordered within their group (a language) by a range partitioning;
   a group's first place in a partition comes from counts of groups by partition, so a large group is dealt over many tasks.
2. ``LEVELS`` levels of all trees are built by one shuffle: the children under one node so many levels above stand in one row.
   The groups' roots are the leaves of one more tree.
3. Proofs by pointer jumping: every node starts with its sibling as a segment and a pointer to its parent. A self-join
   replaces the pointer by the pointer's own and appends its segment, so each round doubles the distance, until
   every leaf has reached the root. After r rounds only nodes of heights divisible by 2 ** r are still met.
4. A proof is folded from the leaf upwards; the bits of the leaf's place say on which side a sibling stands.

Digests are SHA-256; they are hashed as lower-case hex and kept as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loometric.llm.common import returned_memory, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of the trees that one shuffle builds: 2 ** LEVELS digests meet in a row.
LEVELS = 8
# A side of at most so many bytes is sent to all tasks; a larger one has many keys and is shuffled.
SENT_BYTES = 32 << 20
# The tree over the groups' roots.
TOP = -1
# Rows whose id's checksum this divides are tampered with.
TAMPERED = 7


def hashed(*parts: Column) -> Column:
    """The digest (hex) of texts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that no two lists of values give the same text; null is a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", changed: str = "n_chars") -> DataFrame:
    """(doc_id, grp, leaf, tampered) of every row; ``tampered`` is the digest with one added to ``changed``, where a row is to be tampered with."""
    chosen = F.crc32(F.col(order).cast("string").cast("binary")) % TAMPERED == 0
    values = {name: field(F.col(name)) for name in fields}
    other = values | {changed: field(F.try_add(F.col(changed), F.lit(1)))}
    return docs.select(F.col(order).alias("doc_id"), F.col(group).cast("string").alias("grp"), F.unhex(hashed(*values.values())).alias("leaf"),
                       F.when(chosen & F.col(changed).isNotNull(), F.unhex(hashed(*other.values()))).alias("tampered"))


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` ordered by group and keys, with ``part`` (their partition) and ``at`` (their place among the partition's rows of the group)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column("grp").dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            first = (groups.dictionary[int(codes[0])].as_py(),)
            if last == first:  # the group goes on from the batch before
                head = starts[1] if len(starts) > 1 else n
                at[:head] += seen
            last, seen = (groups.dictionary[int(codes[-1])].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(at, pa.int64())],
                                             names=[*batch.schema.names, "part", "at"])
        returned_memory()

    # of equal rows any order is right; the number only parts them
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    sort = [F.col(k).asc_nulls_first() for k in ("grp", *keys, "_copy")]
    ordered = numbered.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_copy")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInArrow(run, f"{fields}, part bigint, at bigint")


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` to be sent to all tasks if it is proved small."""
    return F.broadcast(df) if rows * row_bytes <= SENT_BYTES else df


def placed_leaves(docs: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``tree`` (number of their group), ``pos`` (place in it) and ``size``; and one row of each tree."""
    ordered = stored(_in_order(leaves(docs, **columns), ["doc_id", "leaf"]), "leaves")
    parts = stored(ordered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")), "leaf-parts")
    # groups in order, null first; there may be many of them, so they are numbered by partition as well
    sizes = _in_order(parts.groupBy("grp").agg(F.sum("n").alias("size")).withColumn("name", F.col("grp")).withColumn("grp", F.lit("")), ["name"])
    named = stored(sizes.drop("grp"), "trees")
    before = named.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    firsts = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    trees = stored(named.join(firsts, "part").select(F.col("name").alias("grp"), "size", (F.col("first") + F.col("at")).alias("tree")), "trees")
    upto = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    same = F.col("grp").eqNullSafe(F.col("g"))
    offsets = stored(offsets.withColumnRenamed("grp", "g").join(trees, same).select("g", F.col("part").alias("p"), "first", "tree", "size"), "leaf-offsets")
    joined = ordered.join(_small(offsets, offsets.count(), 100), same & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "leaf", "tampered", "tree", (F.col("first") + F.col("at")).alias("pos"), "size"), trees


# --- trees ------------------------------------------------------------------------


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves: the bits of the last leaf's place."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def _levels(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes of the ``LEVELS`` levels above ``height``, with the sibling of each node of the levels below them.

    ``nodes`` has tree, pos, digest and size (leaves of the tree) of all nodes at ``height``. Returned are the digests by levels,
    one row for each node ``LEVELS`` levels above.
    """
    rows = nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("block"), "size").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("c"))
    rows = rows.withColumn("d0", F.col("c.digest")).drop("c")
    for k in range(LEVELS):
        below = F.col(f"d{k}")
        rows = rows.withColumn(f"d{k + 1}", F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), lambda i: F.unhex(hashed(
            _hex(F.get(below, i * 2)), F.coalesce(_hex(F.get(below, i * 2 + 1)), F.lit(""))))))
    return rows.withColumn("level", F.explode(F.array(*[F.struct(
        F.lit(height + k).alias("height"), F.shiftleft(F.col("block"), LEVELS - k).alias("start"), F.col(f"d{k}").alias("digests"))
        for k in range(LEVELS + 1)]))).select("tree", "size", "level.*")


def _spread(levels: DataFrame) -> DataFrame:
    """(tree, size, height, pos, digest, sibling) of every node in rows of ``_levels``; the sibling is null where there is none."""
    nodes = F.transform("digests", lambda digest, k: F.struct(
        (F.col("start") + k).alias("pos"), digest.alias("digest"), F.get("digests", k.bitwiseXOR(F.lit(1))).alias("sibling")))
    return levels.select("tree", "size", "height", F.inline(nodes))


def tree_nodes(nodes: DataFrame, highest: int) -> DataFrame:
    """All nodes of all trees from their leaves (tree, pos, digest, size), each up to its tree's own height."""
    found, height = None, 0
    while True:
        rows = stored(_spread(_levels(nodes, height)).where(F.col("height") <= _height(F.col("size"))), "tree-nodes")
        # the highest of these levels comes again, with siblings, as the lowest of the next ones
        last = height + LEVELS >= highest
        mine = rows if last else rows.where(F.col("height") < height + LEVELS)
        found = mine if found is None else found.union(mine)
        if last:
            return found
        height += LEVELS
        nodes = rows.where(F.col("height") == height).select("tree", "pos", "digest", "size")


# --- proofs -----------------------------------------------------------------------


def _pointer(tree: Column, height: Column, pos: Column, size: Column, groups: Column) -> Column:
    """A node as (tree, height, pos); a group's root is a leaf of the top tree, and the root of all is null."""
    top = (tree == TOP) | (height == _height(size))
    inside = tree != TOP
    leaf_of_top = F.struct(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("height"), tree.alias("pos"))
    own = F.struct(tree.alias("tree"), height.alias("height"), pos.alias("pos"))
    at_root = F.when(inside, groups <= 1).otherwise(height == _height(size))
    return F.when(top & at_root, None).when(inside & top, leaf_of_top).otherwise(own)


def _segment(sibling: Column) -> Column:
    return F.array(F.coalesce(sibling, F.unhex(F.lit(""))))


def _doubled(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the segments of the nodes they point to appended, and these nodes' pointers."""
    ahead = nodes.select(F.struct("tree", "height", "pos").alias("up"), F.col("up").alias("next"), F.col("segment").alias("more"))
    met = rows.where("up IS NOT NULL").join(ahead, "up").withColumn("segment", F.concat("segment", "more")).withColumn("up", F.col("next"))
    return met.select(*rows.columns).union(rows.where("up IS NULL"))


def proofs(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, leaf, tampered, tree, pos, size, subroot, root, segment): every row with its siblings from the leaf up to the root.

    ``segment`` has one entry for each level, empty where there is no sibling.
    """
    placed, trees = placed_leaves(docs, **columns)
    placed = stored(placed, "placed-leaves")
    facts = trees.agg(F.max("size"), F.count(F.lit(1)), *[F.sum(F.ceil(F.col("size") / (1 << 2 ** r))) for r in range(6)]).first()
    largest, groups, upper = facts[0] or 1, facts[1], facts[2:]
    high, top_high = (largest - 1).bit_length(), max(groups - 1, 0).bit_length()
    nodes = tree_nodes(placed.select("tree", "pos", F.col("leaf").alias("digest"), "size"), high)
    subroots = stored(nodes.where(F.col("height") == _height(F.col("size"))).select("tree", F.col("digest").alias("subroot")), "subroots")
    above = tree_nodes(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"),
                                       F.lit(groups).cast("bigint").alias("size")), top_high)
    root = above.where(F.col("height") == top_high).select(_hex(F.col("digest"))).first()
    every = F.lit(groups)
    size, tree, height, pos = F.col("size"), F.col("tree"), F.col("height"), F.col("pos")
    parent = _pointer(tree, height + 1, F.shiftright(pos, 1), size, every)
    # a group's root goes on as a leaf of the top tree, and the root of all has nowhere to go
    inner = nodes.union(above).where(height < _height(size)).select("tree", "height", "pos", _segment(F.col("sibling")).alias("segment"), parent.alias("up"))
    first = inner.where((tree != TOP) & (height == 0)).select("tree", "pos", "segment", "up")
    rows = placed.join(first, ["tree", "pos"], "left")
    rows = rows.withColumn("up", F.when(size == 1, _pointer(tree, F.lit(0), pos, size, every)).otherwise(F.col("up"))).withColumn(
        "segment", F.coalesce("segment", F.array().cast("array<binary>")))
    rows, jumps = stored(rows, "proofs"), stored(inner.where((tree == TOP) | (height > 0)), "jumps")
    distance, r = 1, 0
    while distance < high + top_high:
        kept = (tree == TOP) | (height % (2 * distance) == 0)
        # nodes of the trees at multiples of this height, and the nodes of the top tree
        count = 2 * upper[r] + 64 * groups
        met = _small(jumps, count, 40 * distance + 60)
        rows = stored(_doubled(rows, met), "proofs")
        distance, r = 2 * distance, r + 1
        if distance < high + top_high:
            jumps = stored(_doubled(jumps.where(kept), met), "jumps")
    return rows.drop("up").join(_small(subroots, groups, 100), "tree").withColumn("root", F.unhex(F.lit(root[0] if root else None)))


def _folded(leaf: Column, segment: Column, size: Column, pos: Column, tree: Column) -> Column:
    """The root (hex) that a leaf and its siblings give."""
    high = _height(size)

    def up(digest: Column, k: Column) -> Column:
        bit = F.when(k < high, F.getbit(pos, F.least(k, F.lit(62)))).otherwise(F.getbit(tree, F.greatest(k - high, F.lit(0))))
        sibling = _hex(F.get(segment, k))
        return F.when(bit == 1, F.concat(sibling, digest)).otherwise(F.concat(digest, sibling))

    steps = F.when(F.size(segment) > 0, F.sequence(F.lit(0), F.size(segment) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, _hex(leaf), lambda digest, k: F.sha2(up(digest, k).cast("binary"), 256))


def verified_manifest(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` folds the row's proof from its leaf, or from the leaf of the tampered row where a checksum of the id chooses
    it. Leaves of a group stand by id, null ids first, rows of one id by digest; equal rows are leaves of their own, in any order.
    A null group is a group, the first. A null value is a field of its own kind and is never tampered with; a row without an id isn't either.
    Texts of any length are hashed whole. An empty table gives an empty result. Other columns are not looked at.
    """
    found = proofs(docs, **columns)
    start = F.coalesce("tampered", "leaf")
    siblings = F.array_join(F.transform("segment", _hex), "")
    found = found.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
                         hashed(siblings).alias("proof_sha256"),
                         _folded(start, F.col("segment"), F.col("size"), F.col("pos"), F.col("tree")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
