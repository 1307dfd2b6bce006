"""Spelling variants: the gram index and whole groups against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from loometric.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, key string, form string, root string, salt int, gram string"


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_groups(counts):
    found = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        form = best if best and counts[best] >= 2 * n else None
        found[w] = (form, n, len(others), counts[form] if form else None)
    rows = {}
    for w, (form, n, others, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows[w] = (form, root, n, others, form_n)
    return rows


def edited(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abné")
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:], word + c])


@pytest.mark.parametrize("limit, longest", [(1, 4), (3, 5), (10, 3), (1000, 4)])
def test_near_words_are_on_a_common_list(limit, longest):
    """For each two words one edit apart a list has both, at the same place or one place on in the longer word."""
    rng = random.Random(limit)
    words = ["".join(rng.choice("abné") for _ in range(rng.randrange(5, 11))) for _ in range(1500)]
    words += [edited(rng, rng.choice(words)) for _ in range(1500)]
    words = [w for w in dict.fromkeys(words) if len(w) >= 5]
    grams = Counter(m[i:i + n] for m in (f"^{w}$" for w in words) for n in range(2, longest + 1) for i in range(len(m) - n + 1))
    index = spelling.GramIndex({g: n for g, n in grams.items() if n > limit}, longest)
    lists = {w: set(index.lists(w)) for w in words}
    pairs = 0
    for _ in range(3000):
        a = rng.choice(words)
        b = edited(rng, a)
        if b == a or b not in lists:
            continue
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        apart = len(a) - len(b)
        assert any((g, p) in lists[b] or apart and (g, p - 1) in lists[b] for g, p in lists[a]), (a, b)
        pairs += 1
    assert pairs > 100


def test_affected_grams_are_never_more_than_the_bound():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 30))) for _ in range(400)]
    grams = Counter(m[i:i + n] for m in (f"^{w}$" for w in words) for n in (2, 3, 4) for i in range(len(m) - n + 1))
    index = spelling.GramIndex({g: n for g, n in grams.items() if n > 30}, 4)
    for _ in range(8000):
        a = rng.choice(words)
        b = edited(rng, a)
        if a == b or not near(a, b):
            continue
        parts = [[(m[f:e + 1], f) for f, e in index.grams(m)] for m in (f"^{a}$", f"^{b}$")]
        shift = len(b) - len(a)
        kept = sum((g, p) in parts[1] or (g, p + shift) in parts[1] for g, p in parts[0])
        marked = f"^{a}$"
        assert len(parts[0]) - kept <= index.affected(marked, index.grams(marked))


def test_frequent_grams_are_bounded(spark):
    words = spark.createDataFrame([(f"same{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x", 3) for i in range(600)], "word string, n bigint")
    found = spelling.frequent_grams(words, 4, 50)
    assert found["same"] == 600 and all(sum(len(g) == n for g in found) <= 50 for n in (2, 3, 4))


@pytest.mark.parametrize("most", [20_000, 5])
def test_groups_against_brute_force(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice(["er", "th", "en", "é", "i", "st"]) for _ in range(4)) for _ in range(40)] + ["ÉTATS×", "abcde"]
    rows = []
    for i in range(300):
        some = [w for w in rng.choices(base, k=12)]
        some = [edited(rng, w) if rng.random() < 0.3 else w for w in some]
        rows.append((None if i == 7 else i % 290, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in some)))
    rows += [(900, None), (901, ""), (902, "12 一 _ Āa"), rows[0], rows[0], (903, "q" * 100_000 + " " + "long " * 50_000)]
    rows += [(910 + i, "q" * 100_000 + "ß") for i in range(3)] + [(920 + i, "q" * 100_000) for i in range(3)]
    extra = ("x", 1, "x", "x", "x", 1, "x")
    df = spark.createDataFrame([r + extra for r in rows], SCHEMA)
    want = plain_groups({w: n for w, n in plain_counts(rows).items()})
    got = spelling.spelling_groups(df, most=most).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(form and root != form for form, root, *_ in want.values()) and sum(w.startswith("qqq") for w in want) == 2


def test_ties_take_the_first_word(spark):
    df = spark.createDataFrame([(1, "stalk " * 3 + "stall " * 9 + "stale " * 9)], "doc_id bigint, text string")
    found = {r["word"]: r for r in spelling.spelling_groups(df).collect()}
    assert found["stalk"]["form"] == "stale" and found["stall"]["form"] is None and found["stalk"]["n_near"] == 2


def test_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, "a bb rare")], "doc_id bigint, text string")).count() == 0
