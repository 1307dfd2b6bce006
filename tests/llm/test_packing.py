"""Packing: the plan against exhaustive search, ids against the library, bins without gaps."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loometric.llm import packing

FILE = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, id string, piece string, start string, length string, part string, number string, n string"
EXTRA = ("x",) * 7


def fullest_by_search(sizes, room):
    return max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room)


def test_fullest_combination_against_search():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts = Counter(sizes)
        lengths = sorted(counts)
        sums = packing.ReachableSums(lengths, 40)
        sums.update([counts[size] for size in lengths])
        for room in (0, 7, 25, 40):
            found = sums.fullest(room)
            assert sum(lengths[i] * n for i, n in found) == fullest_by_search(sizes, room)
            assert all(n <= counts[lengths[i]] for i, n in found)


def test_sums_are_brought_up_to_date():
    rng = random.Random(2)
    lengths = [2, 3, 7, 8, 20]
    sums = packing.ReachableSums(lengths, 50)
    for _ in range(50):
        counts = [rng.randrange(0, 5) for _ in lengths]
        sums.update(counts)
        fresh = packing.ReachableSums(lengths, 50)
        fresh.update(counts)
        assert sums.upto == fresh.upto


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_without_gaps(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65 if seed % 2 else 40, 3000)
    counts = {int(size): int(n) for size, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.Plan.of(counts, 64)
    bins = defaultdict(list)
    for size, n in counts.items():
        where, offset = plan.places(np.full(n, size), np.arange(n))
        for b, o in zip(where.tolist(), offset.tolist()):
            bins[b].append((o, size))
    assert sorted(bins) == list(range(plan.bins))
    for some in bins.values():
        ends = np.cumsum([size for _, size in sorted(some)]).tolist()
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert plan.bins <= -(-int(sizes.sum()) // 64) + (0 if seed % 2 == 0 else 40)


def test_equal_bins_are_filled_by_the_same_plan():
    assert list(packing.bin_patterns({1025: 1000})) == [(1000, [(1025, 1)])]
    assert list(packing.bin_patterns({1024: 10 ** 12, 512: 2})) == [(5 * 10 ** 11, [(1024, 2)]), (1, [(512, 2)])]


def test_ids_of_words_are_those_of_the_library():
    tokenizer, words = Tokenizer.from_file(FILE), packing.WordIds(FILE)
    rng = random.Random(4)
    parts = ["don't", "Ç'Re", "ß%%", "ÿ9µ", "ª", "×", "'ll'S", "<|x", "\x7f", "l'été", "<|endoftext|>", "İstanbul", "é", "́a", "1234", "a\x1cb", "\x85", " ", "ﬁne", "한국어", "!!!", "x" * 500, "\x00", "ΑΣ"]
    texts = ["", " ", "\n\t a  b\r\n", *["".join(rng.choice(parts) + rng.choice([" ", "", "\n", " ", "\x0b"]) for _ in range(30)) for _ in range(200)]]
    found = [np.frombuffer(words.of(text), dtype="<u4").tolist() for text in texts]
    assert found == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not any(len(w) > packing.LONGEST_WORD for w in words)


def test_a_tokenizer_that_looks_across_spaces_is_refused():
    with pytest.raises(ValueError):
        packing.parts_at_spaces(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.mark.parametrize("length", [2048, 7])
def test_pieces_and_sequences(spark, length):
    long = " ".join(f"word{i} and" for i in range(6000))
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma's", "5"], k=rng.randrange(0, 60)))) for i in range(200)]
    rows += [(300, None), (None, "no id"), (301, ""), (302, long), rows[0], rows[0]]
    df = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(4)
    got = packing.packed(df, FILE, length=length)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    tokenizer, want = Tokenizer.from_file(FILE), Counter()
    for key, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.update((key, at // length, at, len(ids[at:at + length]), zlib.crc32(ids[at:at + length].tobytes())) for at in range(0, len(ids), length))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        ends = np.cumsum([n for _, n in sorted(some)]).tolist()
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= length
    assert len(bins) <= -(-sum(r["length"] for r in got) // length) + (0 if length == 2048 else 5)


def test_nothing(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), FILE).count() == 0
