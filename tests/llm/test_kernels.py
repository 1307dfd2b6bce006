"""The local parts of the operators against brute force."""

import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from loometric.llm import decontaminate, encode, licenses, near, pages, pii, spmodel, token_counts, toxicity

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


# --- personal data ------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base_spans(text):
    found = {}
    for kind, pattern in BASE.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append(m.span())
        found[kind] = spans
    return found


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    for alphabet, length in (("a1.@-+ (9é0", 40), ("0123456789 -.4", 60)):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, length)))
            assert pii.base_spans(text) == plain_base_spans(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 500_000, "a" * 500_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


# --- test items -----------------------------------------------------------------------

def edit_row(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))
        best = decontaminate.closest(decontaminate.letter_masks(pattern), len(pattern), text, len(pattern))
        wanted = edit_row(pattern, text)
        assert best == wanted or best is None and wanted[0] >= len(pattern)


@pytest.mark.parametrize("percent", [10, 15, 20])
def test_every_near_place_is_found(percent):
    rng = random.Random(percent)

    def words(n):
        return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(n))

    for _ in range(120):
        items = [(i, words(rng.randint(1, 25))) for i in range(3)]
        planted = list(decontaminate.plain(rng.choice(items)[1]))
        for _ in range(rng.randint(0, max(1, len(planted) // 8))):
            at = rng.randrange(len(planted) + 1)
            planted[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a", " "])
        text = decontaminate.plain(f"{words(20)} {''.join(planted)} {words(20)}")
        found = {}
        for number, distance, *_ in decontaminate.Searcher(items, percent).places(text):
            found[number] = min(distance, found.get(number, 99))
        wanted = {}
        for number, (_, item) in enumerate(items):
            pattern = decontaminate.plain(item)
            distance, _ = edit_row(pattern, text)
            if distance <= len(pattern) * percent // 100:
                wanted[number] = distance
        assert found == wanted


# --- near-duplicates --------------------------------------------------------------------

def sets_of_copies(rng):
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 63, rng.integers(1, 120), dtype=np.uint64) * np.uint64(2)
        for _ in range(rng.integers(1, 8)):
            s, k = base.copy(), rng.integers(0, max(1, len(base) // 10) + 1)
            s[rng.integers(0, len(s), k)] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
            s = np.unique(s[rng.random(len(s)) > rng.choice([0, 0.05])])
            if len(s):
                sets.append(s)
    return sorted(sets, key=len)


def test_trie_keys_and_bitmaps_lose_no_link():
    rng, classes = np.random.default_rng(1), near.SizeClasses(85)
    for _ in range(60):
        sets = sets_of_copies(rng)
        trie = near.SetTrie(85)
        for s in sets:
            trie.add(s, trie.number())
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        bits = np.frombuffer(b"".join(map(near.bitmap, sets)), dtype=np.uint64).reshape(len(sets), -1)
        groups = list(range(len(sets)))
        for i, j in near.alike_groups(np.array([len(s) for s in sets]), bits, 85):
            groups = [groups[j] if g == groups[i] else g for g in groups]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                union = len(sets[i]) + len(sets[j]) - both
                if 100 * both >= 85 * union:
                    parent[find(i)] = find(j)
                    assert groups[i] == groups[j]
                    assert both == union or set(classes.keys(sets[i]).tolist()) & set(classes.keys(sets[j]).tolist())
        found, wanted = [trie.find(i) for i in range(len(sets))], [find(i) for i in range(len(sets))]
        assert len(set(zip(found, wanted))) == len(set(found)) == len(set(wanted))


def test_wide_bitmaps_are_folded_and_reject_unrelated_sets_of_any_size():
    rng = np.random.default_rng(6)
    for n in (100, 1600, 6000):
        base = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        common = base[:n // 20]
        sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 62, n - len(common) + extra, dtype=np.uint64)))) for extra in (0, n // 5, n // 7)]
        sets += [base, np.unique(np.concatenate((base[n // 12:], rng.integers(0, 1 << 62, n // 12, dtype=np.uint64)))), base[n // 5:]]
        bits = near.same_bits([near.bitmap(s, near.bits_for(len(s))) for s in sets])
        assert bits.shape == (len(sets), near.bits_for(min(map(len, sets))) // 64)
        for i in range(len(sets)):  # two folded bitmaps differ in no more bits than the sets differ in shingles
            for j in range(i):
                assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
        linked = near.alike_groups(np.array([len(s) for s in sets]), bits, 80)
        assert {i for pair in linked for i in pair} == {3, 4, 5}


# --- tokens -----------------------------------------------------------------------------

def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ▁a\n\té<s></s>日本\x00{}()\r😀") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return texts + ["", " ", "  ", "a ", " a", "▁", "<unk>", "<0x0A>", "</s> x", "x" * 5000, unicodedata.normalize("NFD", "éà")]


def test_encoding_is_that_of_the_library_and_decodes_back():
    coder = encode.Coder(spmodel.model_bytes(MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    ids = coder.encode(texts)
    assert ids == library.encode(texts)
    assert [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] == ids
    assert all(coder.decode(i) == t.replace("▁", " ").encode() for i, t in zip(ids, texts))


def test_counts_are_those_of_the_library():
    data = spmodel.model_bytes(MODEL)
    whole = token_counts.whole_tokens(data)
    counts = token_counts.WordCounts(data, whole)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    assert len(whole) > 10_000 and [counts.of(t) for t in texts] == [len(i) for i in library.encode(texts)]


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, spmodel.UNKNOWN), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1)]
    model = spmodel.Model(pieces, spmodel.UNIGRAM, False, b"", True, True, True)
    assert encode.tokenizer_of(model).encode(" ab  ab", add_special_tokens=False).tokens == ["▁ab", "▁ab"]


# --- licenses ---------------------------------------------------------------------------

def test_base_places_and_suppression():
    scanner = licenses.Scanner(licenses.rules())
    assert len(scanner.rules) >= 200
    n_words, n_base, first, last, base, labels, score, found = licenses.scan_text(
        scanner, "A GNU Lesser General  Public-License v3, then the MIT License; mit license")
    assert (n_words, n_base, first, last, base) == (13, 3, 3, 11, "gpl,mit") and labels == "gpl,lgpl,mit" and 0 < score <= 1
    # the wider detection stays, what lies within it goes
    assert [d["label"] for d in found if d["first_word"] < 7] == ["lgpl"] and {d["label"] for d in found} == {"lgpl", "mit"}
    assert licenses.scan_text(scanner, "") == (0, 0, None, None, "", "", 0.0, [])
    assert licenses.scan_text(scanner, "SPDX-License-Identifier: BSD-3-Clause")[5] == "bsd"


def test_word_places_equal_a_plain_search():
    scanner, rng = licenses.Scanner(licenses.rules()), random.Random(5)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for _ in range(500):
        text = " ".join(rng.choice(["MIT", "license", "Apache", "General", "public-License", "é", "x,", "mit."]) for _ in range(rng.randint(0, 15)))
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        starts = [i for phrase, _ in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        got = licenses.scan_text(scanner, text)
        assert got[:4] == (len(words), len(starts), min(starts, default=None), max(starts, default=None))


# --- pages ------------------------------------------------------------------------------

PAGES = [
    ("<body><header>H</header><nav><ul><li>m</ul></nav><article><h1>T &amp; t</h1><p><b>One<br>two <p>Th<i>re</i>e&nbsp; x"
     "<ul><li>a<li>b</ul><div class=ad>AD</div><section class='comments'><p>c</p></section><script>var t=\"</p>\";</script> tail < 3"
     "</article><aside>s</aside><footer>f</footer><p cl", "T & t\nOne two\nThree x\na\nb\ntail < 3"),
    ("plain &lt;b&gt; <b>x</b>", "plain <b> x"),
    ("<p>a<p>b<!-- x", "a\nb"),
    ("<body><article><p>A</p><div id='comments'><article><p>c</p></article></div></article>", "A"),
    ("<div class='main-content sidebar'><article><p>A</p></article></div><form>f</form>", "A"),
    ("<div class='cookie-notice'>n</div><p>A</p>", "A"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("", ""),
]


@pytest.mark.parametrize("page,wanted", PAGES)
def test_main_text(page, wanted):
    assert pages.main_text(page) == wanted


def test_odd_pages_stay_linear():
    for page in ('<a "' * 20_000, "<div>" * 20_000 + "x", "<" * 100_000, "<!--" * 20_000, "<script>" * 20_000, "<p>" * 20_000):
        pages.main_text(page)
        pages.style_nodes(page)


def test_attributes_of_any_length():
    long = "x" * 10_000
    page = (f"<body><div data-props='{long} > y'><article title=\"{long}\"><p>A</article></div><aside class=\"{long}\">s</aside>"
            f"<script src=\"{long}\">var t;</script>")
    assert pages.main_text(page) == "A"
    assert pages.main_text(f"<p>A</p><script src='{long}'>var t;</script><aside style=\"{long}\">s</aside>") == "A"
    # a quote that opens no value, and a value that is never closed
    assert pages.main_text("<p title=it's>one</p><p class=\"a\"\">two</p>") == "one\ntwo"
    assert pages.main_text("<p>one<b title=\"x>two") == "onetwo"


def test_unclosed_values_stay_linear():
    for page in ('<a b=">x" c=' * 30_001, '<a b=">' * 30_001, "<a b='\">" * 30_000, "<a " * 60_000, "<a b = " * 30_000):
        pages.main_text(page)


def test_paths_below_the_depth_are_kept():
    def page(i):
        return f"<body>{'<div>' * 60}<div class=menu1>same</div><div class=text1>text {i}</div>{'</div>' * 60}"

    nodes = [pages.style_nodes(page(i)) for i in range(2)]
    assert len(nodes[0]) == 63 and nodes[0].keys() == nodes[1].keys()
    same = [name for name in nodes[0] if nodes[0][name][:2] == nodes[1][name][:2]]
    assert len(same) == 1 and pages.main_text(page(7), frozenset(same)) == "text 7"


# --- the network ------------------------------------------------------------------------

def test_gradients_agree_with_differences(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_parameters(3).items()}
    vocabulary, ids = toxicity.Vocabulary(), np.zeros((3, 6), np.int32)
    for i, text in enumerate(("a bad word here", "the x y z w q", "one")):
        numbers = vocabulary.numbers(text.split())
        ids[i, :len(numbers)] = numbers
    ids[0, 1] = 0  # a word that is left out
    hashes, y, w = vocabulary.new_hashes(), np.array([1.0, 0, 1]), np.array([1.0, 1, 2])
    _, g = toxicity.gradients(p, hashes, ids, y, w)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, e = p[k][at], 1e-5
        p[k][at] = old + e
        more = toxicity.gradients(p, hashes, ids, y, w)[0]
        p[k][at] = old - e
        less = toxicity.gradients(p, hashes, ids, y, w)[0]
        p[k][at] = old
        assert abs((more - less) / (2 * e) - g[k][at]) < 1e-7, k


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        windows = toxicity.windows_of(np.arange(1, n + 1, dtype=np.int32))
        assert set(windows.ravel().tolist()) - {0} == set(range(1, n + 1))


def test_network_learns_rare_words():
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(760):
        words = rng.choices(plain, k=rng.randint(30, 150))
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(["vileness", "vilest", "grubby"])
        texts.append(" ".join(words))
        labels.append(i % 2)
    p = toxicity.calibrated(toxicity.train(texts[:600], labels[:600]), texts[600:660], labels[600:660])
    scores = toxicity.Scorer(p).scores(texts[660:])
    assert np.mean((scores >= 0.5) == np.array(labels[660:])) >= 0.9


# --- very long texts ----------------------------------------------------------------------

def places_by_halving(searcher, number, text, begin, end):
    """The best place first, then both sides of it."""
    _, length, budget, masks, back = searcher.items[number]
    best = decontaminate.closest(masks, length, text[begin:end], budget)
    if best is None:
        return []
    stop = begin + best[1]
    start = stop - decontaminate.anchored(back, length, text[max(begin, stop - length - budget):stop][::-1], best[0])
    return [(number, best[0], budget, start, stop), *places_by_halving(searcher, number, text, begin, start),
            *places_by_halving(searcher, number, text, stop, end)]


def test_places_of_one_sweep_are_those_of_halving():
    rng = random.Random(21)
    for _ in range(400):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(10, 24))).strip() or "ab"
        searcher = decontaminate.Searcher([(1, item)], 20)
        if not searcher.items:
            continue
        body = decontaminate.plain(item)
        parts = []
        for _ in range(rng.randrange(1, 7)):
            copy = list(body)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(0, 2)] = rng.choice("abc")
            parts.append("".join(copy) + "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 8))))
        text = "".join(parts)
        found = list(searcher._verified(0, text, 0, len(text)))
        assert sorted(found) == sorted(places_by_halving(searcher, 0, text, 0, len(text)))


def test_words_of_spans():
    text = "Ab, cd!! İx  ef.gh"
    plain, origin = decontaminate.plain(text), decontaminate.Origin(text)
    for start in range(len(plain)):
        for end in range(start + 1, len(plain) + 1):
            place, first, last = 0, None, 0
            for word in decontaminate._WORDS.finditer(text if len(text.lower()) == len(text) else text.lower()):
                after = place + len(word[0])
                if after > start and place < end:
                    first, last = word.start() if first is None else first, word.end()
                place = after + 1
            assert origin.span(start, end) == ((first or 0), min(last, len(text)))


def test_two_megabytes_of_repeats_take_seconds():
    item = "what is the seventh planet counted from the sun outwards"
    text = decontaminate.plain((item + ". ") * 36_000)
    searcher, begin = decontaminate.Searcher([(1, item)], 10), time.process_time()
    places = searcher.places(text)
    origin = decontaminate.Origin(text)
    spans = {origin.span(p[3], p[4]) for p in places}
    assert len(places) == len(spans) == 36_000 and {p[1] for p in places} == {0}
    assert time.process_time() - begin < 60
    scanner, begin = licenses.Scanner(licenses.rules()), time.process_time()
    row = licenses.scan_text(scanner, "mit license " * 170_000)
    assert row[:4] == (340_000, 170_000, 0, 339_998) and time.process_time() - begin < 60
