"""User functions, models, resumed jobs and streams; losses, pooling and training."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loometric import functions as fn
from loometric.operators import profile, train, vectors
from loometric.sources import io
from loometric.streaming import score

# the test module is not importable on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shouting_model():
    def answer(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [None if p == "silent" else p.upper() for p in prompts]

    return answer


@pytest.fixture(scope="module")
def items(spark):
    texts = ["a", "b", "bad one", "a", "silent", "c"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, input string").repartition(2)


def test_scores_and_errors(spark, items):
    rows = {r["id"]: (r["response"], r["error"]) for r in score.score_batches(items, shouting_model, "input", 4).collect()}
    assert rows == {0: ("A", None), 1: ("B", None), 2: (None, "RuntimeError: no"), 3: ("A", None),
                    4: (None, "no response"), 5: ("C", None)}
    letters = score.dead_letters(score.score_batches(items, shouting_model, "input"), "input", "sys").collect()
    assert sorted((r["system_prompt"], r["user_prompt"]) for r in letters) == [("sys", "bad one"), ("sys", "silent")]


@pytest.mark.parametrize("duplicates,save_failures,expected", [
    ("each", False, [0, 1, 3, 5]), ("once", False, [0, 1, 5]), ("once", True, [0, 1, 2, 4, 5])])
def test_second_run_adds_nothing(spark, items, tmp_path, duplicates, save_failures, expected):
    paths = str(tmp_path / "results"), str(tmp_path / "failures")
    for runs in (1, 2):
        score.resume_scoring(items, shouting_model, *paths, order_key="id", duplicates=duplicates, save_failures=save_failures)
        assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == expected
        # failures that are not saved are tried again
        assert spark.read.parquet(paths[1]).count() == (2 if save_failures else 2 * runs)


def test_stream_resumes(spark, items, tmp_path):
    source, results, failures, checkpoint = (str(tmp_path / n) for n in ("in", "out", "failed", "checkpoint"))

    def run(where=checkpoint):
        score.score_stream(spark, source, "id int, input string", shouting_model, results, failures, where,
                           order_key="id", duplicates="once")
        return sorted(r["id"] for r in spark.read.parquet(results).collect())

    io.append_results(items.filter("id < 2"), source)
    assert run() == [0, 1]
    assert run() == [0, 1]
    io.append_results(items.filter("id >= 2"), source)
    assert run() == [0, 1, 5]
    # a lost checkpoint reads every file again and still adds nothing
    assert run(str(tmp_path / "new")) == [0, 1, 5]


def recovering_model(switch):
    """Fails on "bad" until the switch file is there."""
    import os

    def load():
        def answer(prompts):
            if any("bad" in p for p in prompts) and not os.path.exists(switch):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return answer

    return load


def test_failed_rows_are_tried_again(spark, items, tmp_path):
    source, results, failures, checkpoint = (str(tmp_path / n) for n in ("in", "out", "failed", "checkpoint"))
    model = recovering_model(str(tmp_path / "switch"))

    def run():
        score.score_stream(spark, source, "id int, input string", model, results, failures, checkpoint, order_key="id", duplicates="once")
        return sorted(r["id"] for r in spark.read.parquet(results).collect())

    io.append_results(items.filter("id <= 2"), source)
    assert run() == [0, 1]
    assert run() == [0, 1] and spark.read.parquet(failures).count() == 2
    (tmp_path / "switch").touch()
    # no new file has come, and the row that failed is scored now
    assert run() == [0, 1, 2]
    io.append_results(items.filter("id > 2"), source)
    assert run() == [0, 1, 2, 4, 5] and spark.read.parquet(failures).count() == 2


def test_stopped_run_appends_what_is_missing(spark, items, tmp_path, monkeypatch):
    paths = str(tmp_path / "results"), str(tmp_path / "failures")
    asked = str(tmp_path / "asked")

    def counting():
        def answer(prompts):
            with open(asked, "a") as file:
                file.write("x" * len(prompts))
            return shouting_model()(prompts)

        return answer

    logged = score._log

    def stop(spark, paths, run_id, batch, state):
        logged(spark, paths, run_id, batch, state)
        if state == "scored":
            raise KeyboardInterrupt

    monkeypatch.setattr(score, "_log", stop)
    with pytest.raises(KeyboardInterrupt):
        score.resume_scoring(items, counting, *paths, order_key="id", duplicates="once", save_failures=True)
    monkeypatch.setattr(score, "_log", logged)
    # another run does not touch the batch, and writes its own
    assert score._unfinished(spark, score._Paths(*paths), "other") == []
    before = len(open(asked).read())
    score.resume_scoring(items, counting, *paths, order_key="id", duplicates="once", save_failures=True)
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [0, 1, 2, 4, 5]
    assert spark.read.parquet(paths[1]).count() == 2 and len(open(asked).read()) == before


def counting_model(folder):
    """Notes each prompt it meets in a file of its own."""
    import os
    import uuid

    def load():
        def answer(prompts):
            for p in prompts:
                open(os.path.join(folder, f"{p.replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
            return shouting_model()(prompts)

        return answer

    return load


def test_a_failing_text_is_tried_a_bounded_number_of_times(spark, items, tmp_path, monkeypatch):
    monkeypatch.setattr(score, "LEDGER_BATCHES", 4)
    paths = str(tmp_path / "results"), str(tmp_path / "failures")
    asked = tmp_path / "asked"
    asked.mkdir()
    single = items.where("id = 2").coalesce(1)
    for batch in range(1, 21):
        # the text comes again with some batches, and other rows with others
        new = single if batch % 3 == 1 else items.where("id < 0") if batch % 3 == 2 else spark.createDataFrame([(100 + batch, f"new {batch}")], items.schema)
        score.resume_scoring(new, counting_model(str(asked)), *paths, order_key="id", max_tries=4)
        tries = {1: 1, 2: 2, 3: 3, 4: 3}.get(batch, 4)
        assert score.attempts(spark, *paths).where("tries > 0").first()["tries"] == tries, batch
    met = [p for p in asked.iterdir() if p.name.startswith("bad")]
    letters = spark.read.parquet(paths[1])
    assert len(met) == 4 == letters.count() and {r["error"] for r in letters.collect()} == {"RuntimeError: no"}
    assert spark.read.parquet(f"{paths[1]}_items").count() == 1  # kept once, however often it came
    row = score.quarantined(spark, *paths, max_tries=4).first()
    assert row["tries"] == 4 and row["error"] == "RuntimeError: no" and score.quarantined(spark, *paths, max_tries=5).count() == 0
    assert score._summed_up_to(spark, score._Paths(*paths)) == 20
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [100 + b for b in range(3, 21, 3)]


def test_gaps_grow(spark):
    df = spark.range(1, 9).select(score.retry_gap(F.col("id")))
    assert [r[0] for r in df.collect()] == [1, 1, 2, 4, 8, 16, 32, 64]


def test_copies_of_a_failing_text_are_all_scored_later(spark, tmp_path):
    paths = str(tmp_path / "results"), str(tmp_path / "failures")
    model = recovering_model(str(tmp_path / "switch"))
    rows = [(1, "bad one"), (2, "bad one"), (2, "bad one")]
    score.resume_scoring(spark.createDataFrame(rows[:1], "id int, input string"), model, *paths)
    score.resume_scoring(spark.createDataFrame(rows[1:], "id int, input string"), model, *paths)
    assert spark.read.parquet(f"{paths[1]}_items").count() == 3
    (tmp_path / "switch").touch()
    score.resume_scoring(spark.createDataFrame([], "id int, input string"), model, *paths)
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [1, 2, 2]


def test_compacted_results_are_the_same(spark, items, tmp_path, monkeypatch):
    paths = str(tmp_path / "results"), str(tmp_path / "failures")
    for i in (0, 1, 3, 5):
        score.resume_scoring(items.where(f"id <= {i}"), shouting_model, *paths, order_key="id")
    before = sorted(map(tuple, spark.read.parquet(paths[0]).drop(score.BATCH).collect()))
    schema = spark.read.parquet(paths[0]).drop(score.BATCH).schema
    file_system = score._file_system

    class Stopping:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise KeyboardInterrupt
            return getattr(self.fs, name)

    def stopping(spark, path):
        fs, folder = file_system(spark, path)
        return Stopping(fs), folder

    monkeypatch.setattr(score, "_file_system", stopping)
    with pytest.raises(KeyboardInterrupt):
        score.compact_results(spark, *paths, schema)
    monkeypatch.setattr(score, "_file_system", file_system)
    for _ in range(2):
        score.compact_results(spark, *paths, schema)
        assert len([p for p in (tmp_path / "results").iterdir() if p.name.startswith("batch=")]) == 1
        assert sorted(map(tuple, spark.read.parquet(paths[0]).drop(score.BATCH).collect())) == before
    score.resume_scoring(items, shouting_model, *paths, order_key="id")
    assert sorted(map(tuple, spark.read.parquet(paths[0]).drop(score.BATCH).collect())) == before


def test_failing_batch_is_halved(spark):
    calls = []

    def model():
        def answer(prompts):
            calls.append(len(prompts))
            if "bad" in prompts:
                raise RuntimeError("no")
            return prompts

        return answer

    df = spark.createDataFrame([(i, "bad" if i == 5 else "x") for i in range(64)], "id int, input string").coalesce(1)
    assert score.score_batches(df, model, "input").where("error IS NOT NULL").count() == 1


def test_users_meet_pieces_of_bounded_size(spark):
    """One Arrow batch of many rows, or of long texts, reaches a user's function and model piece by piece, whole and in order."""
    df = spark.range(3000).select("id", F.when(F.col("id") < 8, F.repeat(F.lit("x "), 250_000)).otherwise("y").alias("input")).coalesce(1)

    def count(batch):
        return batch.assign(n=len(batch), chars=int(batch["input"].str.len().sum()))[["id", "n", "chars"]]

    rows = score.map_batches(df, count, "id bigint, n bigint, chars bigint").collect()
    assert [r["id"] for r in rows] == list(range(3000))
    assert max(r["n"] for r in rows) <= score.PIECE_ROWS and max(r["chars"] for r in rows) <= score.PIECE_CHARS

    def model():
        return lambda prompts: [str(len(prompts)) for _ in prompts]

    scored = score.score_batches(df, model, "input", batch_rows=1 << 20).collect()
    assert [r["id"] for r in scored] == list(range(3000))
    assert max(int(r["response"]) for r in scored) <= score.PIECE_ROWS and {r["response"] for r in scored[:6]} == {"2"}
    logits = score.classify(df, lambda: lambda texts: [[len(texts)] for _ in texts], "input").collect()
    assert [r["id"] for r in logits] == list(range(3000)) and max(r["logits"][0] for r in logits) <= score.PIECE_ROWS


def test_user_functions(spark, items):
    assert sorted(r["n"] for r in score.map_rows(items, lambda r: {"n": len(r["input"])}, "n int").collect()) == [1, 1, 1, 1, 6, 7]
    kept = score.map_batches(items, lambda b: b[b["input"].str.len() == 1], "id int, input string")
    assert kept.count() == 4
    assert score.filter_rows(items, "input", lambda t: t == "a").count() == 2


def test_throughput(spark, items, tmp_path):
    scored = score.score_batches(items, shouting_model, "input")
    took = profile.scoring_throughput(scored, lambda df: df.write.parquet(str(tmp_path / "timed")))
    assert took.rows == 6 and took.seconds > 0 and took.seconds_per_row == took.seconds / 6


def test_losses(spark):
    df = spark.createDataFrame([([2.0, 0.5, -1.0], 0, [1, 0, 1]), ([1000.0, 0.0, 0.0], 1, [1, 0, 0]), ([0.0, 0.0, 0.0], -100, [0, 0, 0])],
                               "x array<double>, y int, z array<int>")
    def ce(x, y):
        return max(x) + math.log(sum(math.exp(v - max(x)) for v in x)) - x[y]
    rows = df.collect()
    assert vectors.eval_loss(df, "x", "y").first()[0] == pytest.approx((ce(rows[0].x, 0) + ce(rows[1].x, 1)) / 2)
    sure = df.limit(1)
    plain = -sum(math.log(p if t else 1 - p) for p, t in zip((1 / (1 + math.exp(-v)) for v in rows[0].x), rows[0].z)) / 3
    assert vectors.eval_loss(sure, "x", "z", "binary_cross_entropy").first()[0] == pytest.approx(plain)
    assert math.isfinite(vectors.eval_loss(df, "x", "z", "binary_cross_entropy").first()[0])


def test_losses_of_vectors_and_odd_labels(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0]), ([1.0], [3.0])], "x array<double>, y array<double>")
    assert vectors.eval_loss(df, "x", "y", "squared_error").first()[0] == pytest.approx((1 + 4 + 4) / 3)
    odd = spark.createDataFrame([([1.0, 2.0], 2)], "x array<double>, y int")
    with pytest.raises(Exception, match="label outside the logits"):
        vectors.eval_loss(odd, "x", "y").collect()


def test_long_form_equals_the_array_form(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=9) * s).tolist(), int(rng.integers(0, 9))) for i, s in enumerate([1, 3, 300, 1e4, 1e4] * 40)]
    rows += [(900, [1e4] * 9, 2), (901, [-1e4] * 9, 8), (902, [-1e4, 1e4, *[0.0] * 7], 0), (903, [511.999, 512.0, 1024.5, *[-700.0] * 6], 1), (904, [0.0] * 9, -100)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y int").repartition(5)
    long = df.select("id", F.col("y").alias("truth"), F.posexplode("x").alias("label", "logit")).repartition(7)
    kept = df.where("y <> -100")
    array_form = {r["id"]: r["loss"] for r in kept.select("id", fn.cross_entropy(F.col("x"), F.col("y")).alias("loss")).collect()}
    found = vectors.long_cross_entropy(long.where("truth <> -100"), "id")
    assert {r["id"]: r["loss"] for r in found.collect()} == pytest.approx(array_form, rel=1e-12, abs=1e-12)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert vectors.long_eval_loss(long, "id").first()[0] == pytest.approx(vectors.eval_loss(df, "x", "y").first()[0], rel=1e-12)
    with pytest.raises(Exception, match="label outside the logits"):
        vectors.long_eval_loss(long.withColumn("truth", F.lit(9)), "id").collect()
    marked = df.withColumn("z", F.transform("x", lambda v: (v > 0).cast("int")))
    long = marked.select("id", F.posexplode(F.arrays_zip("x", "z")).alias("label", "p")).select("id", "label", "p.x", "p.z")
    assert vectors.long_eval_loss(long, "id", logit_col="x", truth_col="z", kind="binary_cross_entropy").first()[0] == pytest.approx(
        vectors.eval_loss(marked, "x", "z", "binary_cross_entropy").first()[0])
    assert vectors.long_eval_loss(long, "id", logit_col="x", truth_col="z", kind="squared_error").first()[0] == pytest.approx(
        vectors.eval_loss(marked, "x", "z", "squared_error").first()[0])


def test_pooling(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(1, i, m[i].tolist(), i >= 30) for i in range(40)] + [(2, 0, [1.0, 2.0, 3.0], True), (2, 1, [0.0] * 3, False)],
                               "doc_id int, pos int, vec array<double>, pad boolean").repartition(6)

    def pooled(how, **options):
        return {r["doc_id"]: r["pooled"] for r in vectors.pool_vectors(df, how, **options).collect()}

    assert pooled("mean")[1] == pytest.approx(m.mean(axis=0)) and pooled("max")[1] == pytest.approx(m.max(axis=0))
    assert pooled("mean", pad_col="pad", mask=True)[1] == pytest.approx(m[:30].mean(axis=0))
    last = pooled("last", pad_col="pad")
    assert last[1] == pytest.approx(m[29]) and last[2] == [0.0] * 3  # a pad in front wraps to the end
    assert pooled("last")[1] == pytest.approx(m[39])


def test_training_learns_and_keeps_the_best(spark):
    df = spark.range(120).select(F.when(F.col("id") % 2 == 0, "good fine text").otherwise("awful rude text").alias("text"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    model, table = train.train_text_classifier(df, df, regularizations=(0.01, 10.0), features=256, iterations=5)
    assert table.count() == 2 and table.agg(F.max("accuracy")).first()[0] == 1.0
    scored = train.predict_classes(model, df)
    assert scored.filter("predicted <> label").count() == 0
    assert scored.select(F.size("probabilities")).first()[0] == 2


def test_candidates_share_every_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(" ".join(rng.choice(words[:40] if y else words[20:], 30)), int(y)) for y in rng.integers(0, 2, 400)]
    df = spark.createDataFrame(texts + [(None, 1), ("", 0), ("w1", None)], "text string, label int").repartition(5)
    passes, jobs = [], []
    plain_sums, plain_counts = train.gradient_sums, train.hashed_counts
    monkeypatch.setattr(train, "gradient_sums", lambda rows, points, scale: (passes.append(len(points)), plain_sums(rows, points, scale))[1])
    monkeypatch.setattr(train, "hashed_counts", lambda *a: (jobs.append(a), plain_counts(*a))[1])
    options = {"features": 512, "iterations": 12}
    strengths = (0.3, 0.001, 10.0)
    folder = {}

    def weights(*chosen):
        path = train.shared_folder(spark, "models")
        train.train_text_classifier(df, df, chosen, folder=path, **options)
        return {f"reg={c:g}": train.TextClassifier.load(spark, f"{path}/candidates", f"reg={c:g}").weights for c in chosen}

    together = weights(*strengths)
    count, features_read = len(passes), len(jobs)
    assert features_read == 1 and max(passes) == 3
    alone = {}
    for c in strengths:
        passes.clear()
        alone |= weights(c)
        folder[c] = len(passes)
    assert count == max(folder.values()) < sum(folder.values())
    for name, w in together.items():
        assert np.abs(w - alone[name]).max() < 1e-6
    assert np.abs(together["reg=10"]).max() < np.abs(together["reg=0.001"]).max()


def test_fit_equals_the_library(spark):
    """Without collisions of hashed words the shares are those of a fit by Spark ML."""
    rng = np.random.default_rng(4)
    texts = [(" ".join(rng.choice(["a", "bb", "ccc", "d", "e"], 12, p=[.3, .3, .2, .1, .1] if y else [.2, .2, .2, .2, .2])), int(y))
             for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(texts, "text string, label int").coalesce(2)
    model, _ = train.train_text_classifier(df, df, (0.05,), iterations=200)
    library = train.text_classifier(0.05, iterations=200).fit(df)
    ours, theirs = (sorted((r["text"], r["probabilities"][1]) for r in train.predict_classes(m, df).collect()) for m in (model, library))
    assert [t for t, _ in ours] == [t for t, _ in theirs]
    assert max(abs(p - q) for (_, p), (_, q) in zip(ours, theirs)) < 1e-3


def test_many_classes_and_a_test_part(spark):
    rows = [(f"{word} {word} and {i}", k) for i in range(40) for k, word in enumerate(["red", "green", "blue"])]
    df = spark.createDataFrame(rows, "text string, label bigint")
    model, table = train.train_text_classifier(df, df, (0.01, 0.1), features=4096, iterations=15, test=df)
    found = {(r["part"], r["run"]): r["accuracy"] for r in table.collect()}
    assert len(found) == 3 and found["test", "reg=0.01"] == 1.0 and model.classes == 3
    scored = train.predict_classes(model, df.union(spark.createDataFrame([(None, 0)], df.schema))).collect()
    assert all(r["predicted"] == r["label"] for r in scored if r["text"]) and all(sum(r["probabilities"]) == pytest.approx(1) for r in scored)


def test_gradients_are_the_slopes_of_the_losses():
    rng = np.random.default_rng(5)
    for outputs, classes in ((1, 2), (4, 4)):
        z, y = rng.normal(size=(outputs, 7)), rng.integers(0, classes, 7)
        _, slopes = train._losses(z, y)
        for k in range(outputs):
            for i in range(7):
                up, down = z.copy(), z.copy()
                up[k, i] += 1e-6
                down[k, i] -= 1e-6
                assert slopes[k, i] == pytest.approx((train._losses(up, y)[0] - train._losses(down, y)[0]) / 2e-6, abs=1e-6)
