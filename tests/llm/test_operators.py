"""The operators on Spark: nulls, empty and repeated rows, ties, clashing names, empty tables, and brute force."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loometric.llm import (common, components, cotraining, decontaminate, encode, licenses, near, pages, pii, quality, token_counts,
                           toxicity)

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
# names that the operators use themselves
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row string, t string, w string, words string, "
          "n_words bigint, id string, node string, item_id string, start string, kept string, salt int, key string, spans string")
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
GOOD = " ".join(f"Word{i} said{i} that{i} and{i} more{i}." for i in range(40))
ITEM = "Word3 said3 that3 and3 more3"


def rows_of(*texts, first=0):
    extra = ("x",) * 4 + (1, "x", "x", "x", "x", "x", 1, "x", "x")
    return [(first + i if i != 3 else None, text, None if i % 2 else "en", "s", None) + extra for i, text in enumerate(texts)]


TEXTS = (None, "", "   \n\t ", GOOD, GOOD, LONG, "short text", "1.2.3.4 a@b.com +1 (555) 123-4567, mit license")


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(*TEXTS)
    return spark.createDataFrame(rows + [rows[4]], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None),
                                  (3, ""), (4, "##")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 5 else (i + 1) % 2) for i in range(8)] + [(None, 1, 1), (2, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")


def test_quality_rules(docs, nothing):
    found = {(r["doc_id"], r["n_words"]): r for r in quality.quality_rules(docs).collect()}
    assert found[0, 0]["base_failed"] and not found[1, 0]["kept"] and found[4, 200]["kept"] and found[6, 2]["base_failed"]
    assert quality.quality_rules(docs).count() == len(TEXTS) + 1
    assert quality.quality_rules(nothing).count() == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 2


def test_junk_of_one_sort_is_rejected(spark):
    good = [(i, " ".join(f"Word{i * k % 7919} goes{i + k} on{k}." for k in range(1, 60))) for i in range(1, 300)]
    bad = [(1000 + i, " ".join(f"w{i * k % 7919}%%% b{k}###" for k in range(1, 60))) for i in range(1, 30)]
    found = quality.quality_rules(spark.createDataFrame(good + bad, "doc_id bigint, text string"))
    assert {r[0] for r in found.where("kept").select("doc_id").collect()} == {i for i, _ in good}


@pytest.mark.parametrize("share", [0.6, 0.9])
def test_a_rule_that_misfires_is_outvoted(spark, share):
    """Most clean documents break the rule on symbols: they are kept, and junk that breaks another rule is not."""
    def good(i, k):
        return f"Word{i * k % 7919} goes{i + k}" + (" #" if i % 100 < 100 * share and k % 2 == 0 else "") + f" on{k}."

    clean = [(i, " ".join(good(i, k) for k in range(1, 60))) for i in range(1, 400)]
    junk = [(1000 + i, " ".join(f"W{i * k % 7919}XY BIG{i + k}" + (" #" if k % 2 == 0 else "") for k in range(1, 60)) + ".") for i in range(1, 20)]
    measures = quality.with_votes(quality.measured(spark.createDataFrame(clean, "doc_id bigint, text string")))
    assert measures.where("vote_symbols = -1").count() >= (share - 0.02) * len(clean)
    found = quality.quality_rules(spark.createDataFrame(clean + junk, "doc_id bigint, text string"))
    assert {r[0] for r in found.where("kept").select("doc_id").collect()} == {i for i, _ in clean}


def test_licenses(docs, nothing):
    found = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert found[7]["base_labels"] == "mit" and found[7]["n_base"] == 1 and found[0]["n_words"] == 0 and found[0]["first_word"] is None
    assert licenses.license_scan(nothing).count() == 0


def test_personal_data(docs, nothing):
    found = {r["doc_id"]: r for r in pii.pii_spans(docs).collect()}
    assert [s["kind"] for s in found[7]["base"]] == ["email", "ip", "phone"] and found[0]["base"] == [] and found[5]["found"] == []
    assert pii.pii_spans(nothing).count() == 0 and pii.redacted(nothing).count() == 0
    clean = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert clean[7]["text"] == "[IP] [EMAIL] [PHONE], mit license" and clean[0]["text"] is None and clean[7]["n_chars"] == len(clean[7]["text"])


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please write to mail user{i}@site{i}.com today") for i in range(6)]
    seeds += [(10 + i, f"her badge is 10.{i}.3.4 as known") for i in range(6)]
    unseen = [(20, "her badge is ZX-44871-Q as known"), (21, "the year is 2024444 as of now"), (22, "mail zebra4411@intranet today")]
    df = spark.createDataFrame(seeds + unseen, "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in pii.pii_spans(df).collect()}
    assert found[20] == [(13, 23)] and found[22] == [(5, 23)] and found[0] == []
    by_blocks = pii.with_spans(df, pii.bootstrap(df), block_patterns=1)
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in by_blocks.collect()} == found


def test_secrets_are_found_by_their_key(spark):
    """Long random strings are seeds; what stands behind the same key is found too, and strings elsewhere are not."""
    rng = random.Random(41)

    def hexed(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n - 4)) + "1a2b"

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(300)]
    rows = [(i, f"{rng.choice(words)} {rng.choice(words)} token = \"{hexed(40)}\" {rng.choice(words)}") for i in range(30)]
    rows += [(100 + i, f"{rng.choice(words)} of 4{rng.randrange(10 ** 14)} {rng.choice(words)} . {rng.randrange(10 ** 15)}") for i in range(200)]
    rows += [(500, 'last token = "ab12cd34ef567890ab" end'), (501, "see ab12cd34ef567890ab there"), (502, "| 123456789 | 22222222 |")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in pii.pii_spans(df).collect()}
    texts = dict(rows)
    assert all(len(found[i]) == 1 and texts[i][found[i][0][0]:found[i][0][1]].endswith("1a2b") for i in range(30))
    assert found[500] == [(14, 32)] and not any(found[i] for i in found if i >= 100 and i != 500)
    assert all(any(c.isalpha() for c in r["pattern"].rstrip("axmd")) for r in pii.bootstrap(df).collect())


def test_two_rounds_of_scores_by_hand(spark):
    rng = random.Random(42)
    edges = {(f"p{rng.randrange(12)}", rng.randrange(40)) for _ in range(120)}
    known = {i: i % 3 == 0 for i in range(40)}
    sureness = {i: float(known[i]) for i in known}
    graph = spark.createDataFrame([(p, i, known[i], sureness[i]) for p, i in edges], "pattern string, instance bigint, known boolean, sureness double")

    def by_hand(sure):
        scores = {}
        for p in {p for p, _ in edges}:
            mine = [sure[i] for q, i in edges if q == p]
            if sum(mine) > 0:
                scores[p] = sum(mine) / (len(mine) + 1) * (1 - 1 / (1 + np.log2(1 + sum(mine))))
        return scores

    first = by_hand(sureness)
    assert {r["pattern"]: r["score"] for r in pii.pattern_scores(graph).collect()} == pytest.approx(first)
    believed = {i: 1 - np.prod([1 - pii.DAMPING * first[p] for p, j in edges if j == i and p in first]) for i in known if not known[i]}
    unsure = pii.instance_scores(graph.where("NOT known"), pii.pattern_scores(graph))
    assert {r["instance"]: r["believed"] for r in unsure.collect()} == pytest.approx({i: b for i, b in believed.items() if any(j == i for _, j in edges)})
    second = by_hand({i: 1.0 if known[i] else believed[i] for i in known})
    again = graph.join(unsure, "instance", "left").withColumn("sureness", F.coalesce("believed", "sureness"))
    assert {r["pattern"]: r["score"] for r in pii.pattern_scores(again).collect()} == pytest.approx(second)


def test_rounds_of_scores_send_nothing_to_the_driver(spark, monkeypatch):
    """No broadcast and no copies of what the rounds join, whatever its size; a pattern and an instance of very many rows count whole."""
    plans, stored = [], pii.stored

    def noted(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, purpose)

    monkeypatch.setattr(pii, "stored", noted)
    many = [(f"key word{chr(97 + k % 26)}{chr(97 + k // 26)} MX-440{k % 2} end",) for k in range(300)] + [(f"mail now a{k}@site.org",) for k in range(20)]
    df = spark.createDataFrame(many + [(f"mail now ZQ-{k + 5000}",) for k in range(8)], "text string").repartition(3)
    found = {r["pattern"]: r["score"] for r in pii.bootstrap(df).collect()}
    assert set(found) == {"mail now *"}
    assert len(plans) == 6 and not any(x in plan for plan in plans for x in ("Broadcast", "Generate"))
    assert sum("SortMergeJoin" in plan for plan in plans) == 4


def test_redaction_does_not_depend_on_blocks(spark):
    """Contexts of identifiers beside redacted spans, each in a block of its own."""
    ends = ("org", "com", "net", "edu", "info", "museum")
    seeds = [(f"mail a{i}@site.{end} 10.0.{i}.{k} now{i}",) for k, end in enumerate(ends) for i in range(4)]
    unseen = [(f"mail b@other.{end} ZX-4487{k}-Q done",) for k, end in enumerate(ends)]
    df = spark.createDataFrame(seeds + unseen, "text string").coalesce(2)
    whole = sorted(r[0] for r in pii.redacted(df).collect())
    assert whole.count("mail [EMAIL] [ID] done") == len(ends)
    assert sorted(r[0] for r in pii.redacted(df, block_patterns=1).collect()) == whole


def test_decontamination(docs, nothing, items):
    found = decontaminate.benchmark_matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} >= {(4, 1, 0)} and len([r for r in found if r["doc_id"] == 4 and r["distance"] == 0]) == 2
    exact = next(r for r in found if r["doc_id"] == 4 and r["distance"] == 0)
    assert GOOD[exact["start"]:exact["end"]] == ITEM
    in_blocks = decontaminate.benchmark_matches(docs, items, block_chars=5).collect()
    assert sorted(map(repr, in_blocks)) == sorted(map(repr, found))
    assert decontaminate.benchmark_matches(nothing, items).count() == 0
    assert decontaminate.benchmark_matches(docs, items.where("false")).count() == 0
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns and left.where("doc_id = 4 OR doc_id IS NULL").count() == 0 and left.count() == 6
    assert decontaminate.decontaminated(docs, items.where("false")).count() == docs.count()


def test_tokens(docs, nothing):
    found = {r["doc_id"]: r for r in encode.encoded(docs, MODEL).collect()}
    assert found[0]["ids"] == [] and found[5]["same"] and found[2]["n_tokens"] > 0
    back = {r["doc_id"]: r["text"] for r in encode.decoded(encode.encoded(docs, MODEL), MODEL).collect()}
    assert back[7] == TEXTS[7] and back[0] == "" and back[5] == LONG
    counts = {r["doc_id"]: r for r in token_counts.token_counts(docs, MODEL).collect()}
    assert all(counts[i]["n_tokens"] == found[i]["n_tokens"] for i in counts) and counts[5]["over_limit"] and not counts[0]["over_limit"]
    assert counts[5]["n_bytes"] == len(LONG) and encode.encoded(nothing, MODEL).count() == 0 and token_counts.token_counts(nothing, MODEL).count() == 0


def brute_components(texts, percent=85):
    sets = {}
    for i, text in texts:
        words = (text or "").lower().split()
        grams = [tuple(words[k:k + 4]) for k in range(len(words) - 3)] or ([tuple(words)] if words else [])
        sets[i] = set(grams)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(rng):
    texts = []
    for g in range(8):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(words)))
    return texts + [(len(texts), None), (len(texts) + 1, " "), (len(texts) + 2, "one two"), (len(texts) + 3, "ONE two")]


@pytest.mark.parametrize("block,group", [(1 << 19, 2048), (900, 3)])
def test_near_components(spark, monkeypatch, block, group):
    """Also with clusters cut into blocks and keys cut into groups."""
    import random

    candidates = near.candidate_links
    monkeypatch.setattr(near, "candidate_links", lambda shared, sets, percent: candidates(shared, sets, percent, group))
    texts = copies(random.Random(7))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_components(df, block_shingles=block).collect()}
    assert found == brute_components(texts)


def test_long_unrelated_texts_are_no_candidates(spark):
    """300 texts of 2,000 shingles, of which they share frequent passages, and one pair that is linked."""
    rng = random.Random(12)
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(8)]

    def text(k):
        own = [f"t{k}x{rng.randrange(10 ** 9)}" for _ in range(1800)]
        for passage in rng.sample(passages, 4):
            at = rng.randrange(len(own))
            own[at:at] = passage.split()
        return own

    texts = [text(k) for k in range(300)]
    texts.append([w if i % 70 else "other" for i, w in enumerate(texts[0])])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, text string")
    sets = near.set_digests(df, 5)
    shared = near.shared_keys(near.candidate_keys(df, 5, 80))
    links = near.candidate_links(shared, sets.select("d1", "d2", "n", "bits"), 80)
    found = near.near_components(df, "id", "text", 5, 80)
    assert {r["component_id"] for r in found.where("id = 300").collect()} == {0} and found.select("component_id").distinct().count() == 300
    assert links.count() <= 3


def test_long_lists_make_no_candidates_by_themselves(spark, tmp_path):
    """Sets that share a key and nothing else, and a few that are linked, in lists cut into blocks by number or by size of the bitmaps."""
    rng = np.random.default_rng(8)
    sets, linked = [], set()
    for k in range(60):
        shingles = np.unique(rng.integers(0, 1 << 62, 80 + k % 5, dtype=np.uint64))
        if k % 15 == 7:  # a near copy of the set before, which a hash may put into another block
            shingles = np.unique(np.concatenate((sets[-1][3:], shingles[:2])))
            linked.add(frozenset((k - 1, k)))
        sets.append(shingles)
    rows = [(k, -k, len(s), bytearray(near.bitmap(s))) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "d1 bigint, d2 bigint, n bigint, bits binary")
    # one list of all sets, a short one, and one with a set that another has too
    shared = spark.createDataFrame([(1, k) for k in range(60)] + [(2, 3), (2, 4)] + [(3, k) for k in range(40)], "key bigint, d1 bigint")
    number = {row[0]: k for k, row in enumerate(table.select(near._name("d1", "d2")).collect())}
    for group, mb in ((4, near.GROUP_MB), (near.GROUP, 1.0), (16, 64 * 5 / 1e6), (near.GROUP, near.GROUP_MB)):
        found = {frozenset((number[r["a"]], number[r["b"]])) for r in near.candidate_links(shared, table, 80, group, mb).collect()}
        assert found == linked, (group, mb)
        lists = {}
        for r in near.dealt_lists(shared, table, group, mb).collect():
            lists.setdefault(r["key"], set()).add(r["d1"])
        met = {frozenset((a, b)) for x in lists.values() for a in x for b in x if a != b}
        assert len(met) == 60 * 59 // 2
        assert group < 17 or len(lists) == 3


def test_groups_by_folded_bitmaps_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    for n, copies in ((60, 30), (300, 12), (4000, 5)):
        bases = [np.unique(rng.integers(0, 1 << 62, n + int(extra), dtype=np.uint64)) for extra in rng.integers(0, n // 2, 9)]
        sets = [np.unique(np.concatenate((base[int(cut):], rng.integers(0, 1 << 62, int(cut) // 2, dtype=np.uint64))))
                for base in bases for cut in rng.integers(0, n // 4, copies)]
        sets = [sets[i] for i in rng.permutation(len(sets))]
        sizes, bits = np.array([len(s) for s in sets]), near.same_bits([near.bitmap(s, near.bits_for(len(s))) for s in sets])

        def groups(pairs):
            root = list(range(len(sets)))
            for i, j in pairs:
                root = [root[j] if r == root[i] else r for r in root]
            return {frozenset(k for k in range(len(sets)) if root[k] == r) for r in root}

        apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
        near_ones = (apart * 180 <= 20 * (sizes[:, None] + sizes)) & (100 * np.minimum(sizes[:, None], sizes) >= 80 * np.maximum(sizes[:, None], sizes))
        assert groups(near.alike_groups(sizes, bits, 80)) == groups(np.argwhere(np.triu(near_ones, 1)).tolist())


def test_keys_of_the_same_sets_count_once(spark):
    """A pair of near copies shares over a hundred keys, ten copies of another text as many: their lists come once."""
    pair = [f"a{k}" for k in range(400)]
    many = [" ".join([f"b{k}" for k in range(400)] + [f"c{i}"]) for i in range(10)]
    df = spark.createDataFrame([(0, " ".join(pair)), (1, " ".join(pair[:-1]))] + [(2 + i, t) for i, t in enumerate(many)], "id bigint, text string").repartition(3)
    keys = near.candidate_keys(df, 5, 80)
    for held in (near.HELD, 4):  # also with keys that are too long to be held
        lists = near.shared_keys(keys, held)
        names = {r["d1"] for r in lists.collect()}
        links = near.candidate_links(lists, near.set_digests(df, 5).select("d1", "d2", "n", "bits"), 80)
        found = sorted(r["n"] for r in components.components(links).groupBy("root").agg(F.count("*").alias("n")).collect())
        assert len(names) == 12 and found == [2, 10]
    assert near.shared_keys(keys).count() * 10 < keys.distinct().count()


def test_key_lists_in_any_batches(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(12), rng.randrange(9)) for _ in range(70)} | {(20, 1)} | {(30, k) for k in range(40)})
    wanted = {tuple(sorted(d for k, d in rows if k == key)) for key in {k for k, _ in rows}}
    wanted = {x for x in wanted if len(x) > 1}
    df = spark.createDataFrame([(d, k) for k, d in rows + rows[::3]], "d1 bigint, key bigint")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, held in ((1, 65536), (3, 5), (7, 1), (10000, 65536)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            lists = {}
            for r in near.shared_keys(df, held).collect():
                lists.setdefault(r["key"], []).append(r["d1"])
            assert {tuple(sorted(x)) for x in lists.values()} == wanted
            assert held < 65536 or len(lists) == len(wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name.rsplit("/", 1)[-1] for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}

    before, setting = files(), spark.conf.get(common.SHUFFLE_CLEANUP, None)
    df = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    kept = common.stored(df, "test")
    deadline = time.monotonic() + 20
    while files() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.SHUFFLE_CLEANUP, None) == setting
    assert kept.count() == 10 == df.count()


def test_near_edges(docs, nothing):
    found = near.near_components(docs)
    assert found.count() == docs.count() and near.near_components(nothing).count() == 0
    by_id = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert by_id[4] == 4 and by_id[None] == 4 and by_id[0] == 0 and by_id[1] == 1
    left = near.one_of_each(docs)
    assert left.columns == docs.columns and left.where("doc_id = 4").count() == 1 and left.count() == docs.count() - 1


def brute_kept(texts, words, percent):
    """The smallest id of each component, by comparing all pairs."""
    sets, root = {}, {i: i for i, _ in texts}
    for i, text in texts:
        w = text.split()
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                a_root, b_root = find(a), find(b)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {find(i) for i in sets}


def test_near_stage_takes_five_words_and_80_percent(spark):
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        # one changed run of 2 to 13 words
        texts += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:40] + [f"new{g}x{k}" for k in range(g + 2)] + base[42 + g:]))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()}
    assert found == brute_kept(texts, 5, 80) != brute_kept(texts, 4, 85)
    assert {r["doc_id"] for r in near.one_of_each(df).collect()} == brute_kept(texts, 4, 85)


def test_one_row_of_each_component_with_repeated_ids(spark):
    def text(g, changed=()):
        return " ".join(f"new{g}x{k}" if k in changed else f"g{g}w{k}" for k in range(80))

    rows = [
        (1, text(0)), (2, text(0, (5,))), (2, text(1)),  # id 2: a copy of 1, and a text of its own
        (3, text(2)), (3, text(2, (9,))), (3, text(2).upper()), (3, text(2)),  # near copies under one id
        (None, text(3)), (None, text(3)), (None, text(3, (8,))),  # without an id
        (4, ""), (4, " "), (4, ""), (5, ""), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    left = [(r["doc_id"], (r["text"] or "").lower()) for r in near.one_of_each(df).collect()]
    groups = sorted((t.split()[3].split("w")[0] if "w" in t else "", -1 if i is None else i) for i, t in left)
    assert groups == [("", -1), ("", 4), ("", 4), ("", 5), ("g0", 1), ("g1", 2), ("g2", 3), ("g3", -1), ("g3", -1)]


def test_long_chains_and_hot_nodes_are_joined(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)] + [("h", f"s{i:03d}") for i in range(300)] + [("z", "z")]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {found[f"{i:03d}"] for i in range(71)} == {"000"} and {found[f"s{i:03d}"] for i in range(300)} == {"h"} and "z" not in found


def test_pages(spark):
    good = [(i, "http://h.com/a", f"<body><div class=x1>Always the same words</div><div class=y2><p>Text {i} of its own</p></div>") for i in range(12)]
    odd = [(50, None, None), (51, "http://h.com/b", ""), (52, "no url", "<p>x"), (52, "no url", "<p>x")]
    df = spark.createDataFrame(good + odd, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("drop", F.lit(1))
    found = pages.main_texts(df).collect()
    by_id = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 16 and by_id[50] == "" and by_id[51] == "" and by_id[52] == "x"
    assert all(by_id[i] == f"Text {i} of its own" for i in range(12))
    assert pages.main_texts(df.where("false")).count() == 0
    # a site that is one article over and over keeps it
    same = spark.createDataFrame([(i, "http://s.com/", "<article><p>One text</p></article>") for i in range(9)], "page_id bigint, url string, html string")
    assert {r["text"] for r in pages.main_texts(same).collect()} == {"One text"}


def test_classifiers(docs, nothing, labels):
    scored = toxicity.toxicity(docs, labels, rounds=1).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert toxicity.toxicity(nothing, labels, rounds=1).count() == 0 and toxicity.toxicity(docs, labels.where("false")).count() == docs.count()
    judged = cotraining.quality_scores(docs, labels, rounds=1).collect()
    assert len(judged) == docs.count() and all(0 <= r["score"] <= 1 for r in judged)
    assert cotraining.quality_scores(nothing, labels).count() == 0
    assert cotraining.quality_scores(docs, labels.where("false"), rounds=1).count() == docs.count()


def test_cotraining_tells_junk(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(f"w{i * k % 997}%%%" if bad else f"Word{i * k % 997}" for k in range(1, 60))
        rows.append((i, text, "en", "src1" if bad else "src2", len(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)], "doc_id bigint, quality int")
    found = cotraining.quality_scores(docs, labels, exchanged=20).where("held_out").collect()
    assert sum(r["keep"] == (r["doc_id"] % 4 != 0) for r in found) >= 0.95 * len(found)


def test_exchange_never_makes_it_worse_and_an_empty_view_gives_nothing(spark):
    """Metadata that says nothing gives no labels, and the scores are those without an exchange; so it is with a text that says nothing."""
    rng = random.Random(31)
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(900)}" + ("%%" if bad and rng.random() < 0.4 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "src", 300))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 1500, 2)], "doc_id bigint, quality int")

    def right(docs, **options):
        found = cotraining.quality_scores(docs, labels, **options).where("held_out").collect()
        return sum(r["keep"] == (r["doc_id"] % 5 != 0) for r in found) / len(found), {r["meta_score"] for r in found}

    docs = spark.createDataFrame(rows, schema)
    with_exchange, meta = right(docs)
    assert with_exchange >= right(docs, rounds=0)[0] and with_exchange > 0.95 and len(meta) == 1
    silent = spark.createDataFrame([(i, "same words for all of them", "en", "bad" if i % 5 == 0 else "good", 26) for i in range(1500)], schema)
    assert right(silent)[0] == 1.0


def test_trust_is_measured():
    logits = np.array([5.0, 4, 3, 2, 1, 0, -1, -2, -3, -4] * 40)
    told = (logits > 0).astype(float)
    assert cotraining.trusted_beyond(logits, told, 1.0) <= 1 and cotraining.trusted_beyond(logits, told, 0.0) >= 0
    blind = np.tile([1.0, 1, 1, 0], 100)  # no rows beyond any logit are better than the share
    assert cotraining.trusted_beyond(np.zeros(400), blind, 1.0) is None and cotraining.trusted_beyond(np.zeros(400), blind, 0.0) is None
    assert cotraining.trusted_beyond(np.zeros(0), np.zeros(0), 1.0) is None
    few = np.array([9.0, -1, -2])  # three right ones are too few to be sure
    assert cotraining.trusted_beyond(few, np.array([1.0, 0, 0]), 1.0) is None


def test_pipeline(spark, tmp_path):
    """Each stage keeps what it should of the stage before, and its decisions take effect."""
    leak = "This very item of the benchmark must not stay in any text"
    texts = [GOOD, GOOD.replace("said39", "saidX"), " ".join(f"Other{i} things{i} are{i} told{i}." for i in range(60)) + " write to a@b.com",
             " ".join(f"More{i} of{i} it{i} goes{i} on{i}." for i in range(60)) + f" {leak}", "too short"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {0, 2} and all(r["same"] for r in found.values())
    back = encode.decoded(spark.createDataFrame(list(found.values())), MODEL).where("doc_id = 2").first()["text"]
    assert back.endswith("write to [EMAIL]")


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
