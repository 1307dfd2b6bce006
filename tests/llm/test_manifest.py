"""Merkle manifests against trees built by hand."""

import hashlib
import random
import zlib

import pytest

from loometric.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, pos string, size int, grp string, part int, leaf int"
EXTRA = (1, "x", 2, "x", 3, 4)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves):
    """The root, and for each leaf the siblings on its way: (digest, whether it stands left)."""
    ways, level, below = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, owners = [], []
        for i in range(0, len(level), 2):
            run = level[i:i + 2]
            if len(run) == 2:
                for k in below[i]:
                    ways[k].append((run[1], False))
                for k in below[i + 1]:
                    ways[k].append((run[0], True))
            else:
                for k in below[i]:
                    ways[k].append(("", False))
            above.append(digest(*run))
            owners.append(sum(below[i:i + 2], []))
        level, below = above, owners
    return level[0], ways


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r[:5]))) for g in names}
    trees = {g: plain_tree([plain_leaf(*r[:5]) for r in ordered[g]]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    found = []
    for g, top in zip(names, tops):
        for row, way in zip(ordered[g], trees[g][1]):
            leaf = node = plain_leaf(*row[:5])
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = plain_leaf(*row[:3], row[3] + 1, row[4])
            for sibling, left in way + top:
                node = digest(sibling, node) if left else digest(node, sibling)
            found.append((row[0], leaf, trees[g][0], root, digest(*[s for s, _ in way + top]), node, node == root))
    return found


def rows_with(*sizes):
    rng = random.Random(sum(sizes))
    names = ["en", None, "é", "", "Z", "en2"]
    rows = [(rng.randrange(10 ** 12), rng.choice(["a", None]), name, rng.choice([None, 7, 12]), rng.choice([None, "", "text é"]))
            for name, size in zip(names, sizes) for _ in range(size)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (5, 3, 1), (16, 17, 1, 2, 255), (700, 257, 1, 1, 1, 1)])
def test_against_trees_by_hand(spark, sizes):
    rows = rows_with(*sizes)
    got = manifest.verified_manifest(spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_joins_that_are_shuffled_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SENT_BYTES", -1)
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = rows_with(90, 33, 1)
    got = manifest.verified_manifest(spark.createDataFrame([r + EXTRA for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_many_groups_nulls_ties_and_long_texts(spark):
    rows = [(i, "s", f"g{i}", 1, "t") for i in range(300)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "s", "en", 2, "x")] * 4 + [(5, "s", "en", 3, "y"), (6, "s", "en", 3, "z" * 2_000_000)]
    got = manifest.verified_manifest(spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)


def test_only_tampered_rows_fail(spark):
    rows = [(i, "s", "en", i, "t") for i in range(100)]
    got = manifest.verified_manifest(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_nothing(spark):
    assert manifest.verified_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
