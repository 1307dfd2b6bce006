"""Queries: run files, user functions and models, resumable scoring, streams, training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loometric import functions as fn
from loometric.operators import profile, relate, train
from loometric.plans import evaluation
from loometric.queries import views as v
from loometric.queries.prepare import rounded
from loometric.queries.registry import query
from loometric.session import shared_folder
from loometric.sources import io
from loometric.streaming import score

RUN_SCHEMA = "id bigint, input string, response string, score bigint"
FILE_ROWS = 50_000


def length_model():
    """A stand-in model: answers with the prompt's length and fails on multiples of seven."""
    def answer(prompts):
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("length is a multiple of seven")
        return [f"model\n{len(p)} characters" for p in prompts]

    return answer


def vowel_model():
    """A stand-in classifier: its logits are the shares of three vowels."""
    return lambda texts: [[t.count(c) / max(len(t), 1) for c in "aeo"] for t in texts]


def judge_model():
    """A stand-in judge: scores from 1 to 5 by the prompt's length, and no score on multiples of seven."""
    return lambda prompts: ["no score" if len(p) % 7 == 0 else str(1 + len(p) % 5) for p in prompts]


def prompts(spark, sf_dir):
    return v.documents(spark, sf_dir, "text").withColumnRenamed("text", "input")


# --- run files ------------------------------------------------------------------------

@query("read_runs", "SELECT run, id, input, response, score FROM fx_runs", ("fx_runs",))
def read_runs(spark, sf_dir):
    """Runs as JSON arrays of a bounded number of rows, one folder of part files per run."""
    path = shared_folder(spark, "runs")
    io.write_runs(v.fx_runs(spark, sf_dir), path, "id", ("id", "input", "response", "score"), rows=FILE_ROWS)
    runs = io.read_runs(spark, path, RUN_SCHEMA, run_from="folder", arrays_span_lines=False, pattern="*")
    good, _ = io.split_corrupt(runs)
    return good.select("run", "id", "input", "response", "score")


@query("filtered_runs", """
    SELECT run, id, input, response, score FROM fx_runs
    WHERE input IN (SELECT input FROM fx_runs GROUP BY input HAVING count(DISTINCT run) = 5)
""", ("fx_runs",))
def filtered_runs(spark, sf_dir):
    """Runs reduced to the prompts that all of them have, written as run files and read again."""
    path = shared_folder(spark, "filtered-runs")
    shared = relate.common_prompts(v.fx_runs(spark, sf_dir), "input")
    io.write_runs(shared, path, "id", ("id", "input", "response", "score"), rows=FILE_ROWS)
    runs = io.read_runs(spark, path, RUN_SCHEMA, run_from="folder", arrays_span_lines=False, pattern="*")
    return io.split_corrupt(runs)[0].select("run", "id", "input", "response", "score")


@query("split_corrupt", """
    SELECT run, count(score) AS good, count(*) - count(score) AS bad FROM fx_runs GROUP BY run
""", ("fx_runs",))
def split_corrupt(spark, sf_dir):
    """Rows without a score are stored as broken JSON."""
    path = shared_folder(spark, "broken-runs")
    line = F.to_json(F.struct("id", "input", "response", "score"))
    lines = v.fx_runs(spark, sf_dir).select(
        "run", F.when(F.col("score").isNull(), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))
    lines.write.partitionBy("run").format("text").save(path)
    runs = io.read_runs(spark, path, RUN_SCHEMA, run_from="folder", arrays_span_lines=False, pattern="*")
    good, bad = io.split_corrupt(runs)
    counted = good.select("run", F.lit(1).alias("good"), F.lit(0).alias("bad"), "id").unionByName(
        bad.select("run", F.lit(0).alias("good"), F.lit(1).alias("bad"), F.length("content").cast("bigint").alias("id")))
    return counted.groupBy("run").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


TEE_ROWS = 500
TEE_FOLDER = 16


@query("tee_corrupt", f"""
    WITH files AS (SELECT run, id // {TEE_ROWS} AS part, count(*) AS n FROM fx_runs GROUP BY ALL)
    SELECT run, coalesce(sum(n) FILTER (part % 3 <> 1), 0)::BIGINT AS good, count(*) FILTER (part % 3 = 1) AS bad FROM files GROUP BY run
""", ("fx_runs",))
def tee_corrupt(spark, sf_dir):
    """Whole files, each one array over several lines, of which every third is broken: they are read once, and the others survive."""
    path = shared_folder(spark, "tee-runs")
    rows = v.fx_runs(spark, sf_dir).withColumn("part", F.floor(F.col("id") / TEE_ROWS))
    packed = rows.groupBy("run", "part").agg(F.to_json(F.collect_list(F.struct("id", "input", "response", "score"))).alias("value"))
    spread = F.replace("value", F.lit('},{"id"'), F.lit('},\n{"id"'))
    broken = F.when(F.col("part") % 3 == 1, F.concat(F.lit("@"), spread)).otherwise(spread)
    # a file for each row, and a folder for many files: each folder is written by one task, and as many tasks write as there are folders or cores
    lines = packed.select("run", F.floor(F.col("part") / TEE_FOLDER).alias("folder"), broken.alias("value")).repartition(
        2 * spark.sparkContext.defaultParallelism, "run", "folder")
    lines.write.partitionBy("run", "folder").option("maxRecordsPerFile", 1).format("text").save(path)
    runs = io.read_runs(spark, path, RUN_SCHEMA, run_from="parent", pattern="*")
    runs = runs.withColumn("run", F.regexp_extract("file_path", "/run=([^/]*)/", 1))
    good, bad = io.tee_corrupt(runs, shared_folder(spark, "teed"))
    counted = good.groupBy("run").agg(F.count(F.lit(1)).alias("good"), F.lit(0).cast("bigint").alias("bad")).unionByName(
        bad.groupBy("run").agg(F.lit(0).cast("bigint").alias("good"), F.count(F.lit(1)).alias("bad")))
    return counted.groupBy("run").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("one_run", "SELECT run, count(*) AS rows, count(score) AS scored FROM fx_runs WHERE run = 'click' GROUP BY run", ("fx_runs",))
def one_run(spark, sf_dir):
    """One of many runs: the folders of the others are not listed."""
    path = shared_folder(spark, "many-runs")
    io.write_runs(v.fx_runs(spark, sf_dir), path, "id", ("id", "input", "response", "score"), rows=FILE_ROWS)
    runs = io.read_runs(spark, path, RUN_SCHEMA, run_from="folder", arrays_span_lines=False, pattern="*").where("run = 'click'")
    return io.split_corrupt(runs)[0].groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count("score").alias("scored"))


# --- user functions and models ------------------------------------------------------------

def upper_initial(text: str) -> str:
    """The first code point in upper case, as one code point: ``str.upper`` spells some out, as SS for ß."""
    first = text[:1]
    for upper in (first.upper(), first.title(), "\u1e9e" if first == "\u00df" else first):
        if len(upper) == len(first):
            return upper


@query("map_rows", """
    SELECT doc_id, length(text) AS n, upper(substr(text, 1, 1)) AS initial FROM documents
""")
def map_rows(spark, sf_dir):
    def describe(row):
        return {"doc_id": row["doc_id"], "n": len(row["text"]), "initial": upper_initial(row["text"])}

    return score.map_rows(v.documents(spark, sf_dir, "text"), describe, "doc_id bigint, n bigint, initial string")


@query("map_batches", f"""
    SELECT doc_id, text || '<eos>' AS text FROM documents WHERE len({v.sql_words('text')}) < 509
""")
def map_batches(spark, sf_dir):
    """The length filter as a user function: a batch may shrink."""
    def finish(batch):
        kept = batch[batch["text"].str.split().str.len() < 509]
        return kept.assign(text=kept["text"] + "<eos>")

    return score.map_batches(v.documents(spark, sf_dir, "text"), finish, "doc_id bigint, text string")


@query("filter_rows", f"SELECT doc_id FROM documents WHERE len({v.sql_words('text')}) % 2 = 0")
def filter_rows(spark, sf_dir):
    df = v.documents(spark, sf_dir, "text")
    return score.filter_rows(df, "text", lambda text: len(text.split()) % 2 == 0).select("doc_id")


@query("score_batches", """
    SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN 'model' || chr(10) || length(text) || ' characters' END AS response,
           CASE WHEN length(text) % 7 = 0 THEN 'ValueError: length is a multiple of seven' END AS error
    FROM documents
""")
def score_batches(spark, sf_dir):
    return score.score_batches(prompts(spark, sf_dir), length_model, "input").drop("input")


@query("dead_letters", """
    SELECT '' AS system_prompt, text AS user_prompt, 'ValueError: length is a multiple of seven' AS error
    FROM documents WHERE length(text) % 7 = 0
""")
def dead_letters(spark, sf_dir):
    scored = score.score_batches(prompts(spark, sf_dir), length_model, "input")
    return score.dead_letters(scored, "input").drop("timestamp")


SQL_SCORED_ONCE = """
    SELECT coalesce(min(CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END), min(d.doc_id)) AS doc_id, text AS input,
           'model' || chr(10) || length(text) || ' characters' AS response
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE length(text) % 7 <> 0 GROUP BY text
"""


def labelled(spark, sf_dir, items):
    return items.join(v.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("append_results", SQL_SCORED_ONCE)
def append_results(spark, sf_dir):
    """Scoring stopped after the labelled documents and started again over all of them."""
    folder = shared_folder(spark, "scoring")
    items = prompts(spark, sf_dir)
    for part in (labelled(spark, sf_dir, items), items):
        score.resume_scoring(part, length_model, f"{folder}/results", f"{folder}/failures",
                             order_key="doc_id", duplicates="once")
    return spark.read.parquet(f"{folder}/results").drop(score.BATCH, score.DIGEST)


@query("score_stream", SQL_SCORED_ONCE)
def score_stream(spark, sf_dir):
    """Files arrive in two lots; the stream is started anew for each."""
    folder = shared_folder(spark, "stream")
    items = prompts(spark, sf_dir)
    for part in (labelled(spark, sf_dir, items), items):
        io.append_results(part, f"{folder}/incoming")
        score.score_stream(spark, f"{folder}/incoming", "doc_id bigint, input string", length_model,
                           f"{folder}/results", f"{folder}/failures", f"{folder}/checkpoint",
                           order_key="doc_id", duplicates="once")
    return spark.read.parquet(f"{folder}/results").drop(score.BATCH, score.DIGEST)


@query("attempt_ledger", """
    SELECT min(d.doc_id) AS doc_id, 2 + max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS tries,
           max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS quarantined, 'ValueError: length is a multiple of seven' AS error,
           2 + max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS letters
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE length(text) % 7 = 0 GROUP BY text
""")
def attempt_ledger(spark, sf_dir):
    """The labelled documents are scored, then all, and then all again: three tries at most for a text, one letter for each."""
    folder = shared_folder(spark, "attempts")
    paths = f"{folder}/results", f"{folder}/failures"
    items = prompts(spark, sf_dir)
    for part in (labelled(spark, sf_dir, items), items, items):
        score.resume_scoring(part, length_model, *paths, order_key="doc_id", duplicates="once", max_tries=3)
    firsts = items.groupBy(relate.digest(F.col("input")).alias(score.DIGEST)).agg(F.min("doc_id").alias("doc_id"))
    letters = spark.read.parquet(paths[1]).groupBy(relate.digest(F.col("user_prompt")).alias(score.DIGEST)).agg(F.count(F.lit(1)).alias("letters"))
    kept = score.quarantined(spark, *paths, max_tries=3).select(score.DIGEST, F.lit(True).alias("quarantined"))
    found = score.attempts(spark, *paths).join(firsts, score.DIGEST).join(letters, score.DIGEST).join(kept, score.DIGEST, "left")
    return found.select("doc_id", F.col("tries").cast("int").alias("tries"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"), "error",
                        F.col("letters").cast("int").alias("letters"))


JUDGE_TEMPLATE = "Text: {}\nScore 1-5:"


@query("judge_job", f"""
    WITH asked AS (SELECT source AS run, length(text) + {len(JUDGE_TEMPLATE) - 2} AS n FROM documents),
    scored AS (SELECT run, CASE WHEN n % 7 <> 0 THEN 1 + n % 5 END AS score FROM asked)
    SELECT run, count(*) - count(score) AS unscored, nullif(count(score), 0) AS scored, round(avg(score), 6) AS avg_score,
           round(median(score)::DOUBLE, 6) AS median_score,
           CASE WHEN count(score) > 0 THEN round(coalesce(stddev_samp(score), 0), 6) END AS std_dev
    FROM scored GROUP BY run
""")
def judge_job(spark, sf_dir):
    """Prompt, judge, parsed score, kept nulls and leaderboard in one job."""
    docs = v.documents(spark, sf_dir, "source", "text").select(F.col("source").alias("run"), "doc_id", "text")
    board = evaluation.judge_runs(docs, judge_model, JUDGE_TEMPLATE, ["text"], shared_folder(spark, "judged"))
    return rounded(board, "avg_score", "median_score", "std_dev")


@query("scoring_throughput", "SELECT count(*) AS rows, count(*) AS counted, count(*) FILTER (length(text) % 7 = 0) AS failed FROM documents")
def scoring_throughput(spark, sf_dir):
    """What a timed job wrote, and what was counted while it ran."""
    scored = score.score_batches(prompts(spark, sf_dir), length_model, "input")
    path = shared_folder(spark, "timed")
    took = profile.scoring_throughput(scored, lambda df: df.write.parquet(path))
    if took.seconds <= 0 or took.seconds_per_row * took.rows != took.seconds and abs(took.seconds_per_row * took.rows / took.seconds - 1) > 1e-9:
        raise ValueError("a job has a duration, and a row its share of it")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(took.rows).cast("bigint").alias("counted"),
                                        F.count("error").alias("failed"))


@query("classify", """
    WITH shares AS (SELECT doc_id, list_transform(['a', 'e', 'o'],
        lambda c: (length(text) - length(replace(text, c, ''))) / greatest(length(text), 1)) AS s FROM documents)
    SELECT doc_id, (list_position(s, list_max(s)) - 1)::BIGINT AS label,
           round(list_max(list_transform(s, lambda x: exp(x))) / list_sum(list_transform(s, lambda x: exp(x))), 6) AS top_share
    FROM shares
""")
def classify(spark, sf_dir):
    scored = score.classify(v.documents(spark, sf_dir, "text"), vowel_model)
    return rounded(scored.select(
        "doc_id", fn.argmax_label(F.col("logits")).cast("bigint").alias("label"),
        F.array_max(fn.softmax(F.col("logits"))).alias("top_share")), "top_share")


def part_of(text: str):
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % 5


SQL_PART = "('0x' || substr(md5(text), 1, 8))::BIGINT % 5"


def trained(spark, sf_dir, **options):
    """The whole labelled table in three parts that a stable hash of the text decides."""
    df = v.fx_text(spark, sf_dir).withColumn("_part", part_of("text"))
    fit, check, test = (df.filter(f"_part {c}").drop("_part") for c in ("> 1", "= 0", "= 1"))
    model, table = train.train_text_classifier(fit, check, regularizations=(0.01, 0.1), features=1 << 14, iterations=10, test=test, **options)
    return model, table, check, test


@query("train_text_classifier", f"""
    WITH parts AS (SELECT {SQL_PART} AS k, quality AS label FROM documents JOIN labels USING (doc_id)),
    sizes AS (SELECT CASE WHEN k = 0 THEN 'validation' ELSE 'test' END AS part, count(*) AS rows,
              greatest(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS most FROM parts WHERE k < 2 GROUP BY ALL)
    SELECT part, rows, most, CASE WHEN part = 'test' THEN 1 ELSE 2 END::BIGINT AS candidates, true AS at_least_the_majority FROM sizes
""")
def train_text_classifier(spark, sf_dir):
    """Both parts that are scored; the best candidate is right at least as often as naming the commonest class would be."""
    _, table, check, test = trained(spark, sf_dir)
    sizes = check.withColumn("part", F.lit("validation")).union(test.withColumn("part", F.lit("test"))).groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    best = table.groupBy("part").agg(F.max("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("candidates"))
    return sizes.join(best, "part").select("part", "rows", "most", "candidates",
                                           (F.round(F.col("accuracy") * F.col("rows")) >= F.col("most")).alias("at_least_the_majority"))


# the kept candidate is the one with the best validation score, and its shares are those of its stored weights
@query("predict_classes", "SELECT doc_id, true AS known_class, 1.0::DOUBLE AS total FROM documents")
def predict_classes(spark, sf_dir):
    """All documents, labelled or not; SQL can state that each has a class and shares that sum to one."""
    model, *_ = trained(spark, sf_dir)
    scored = train.predict_classes(model, v.documents(spark, sf_dir, "text"))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    return scored.select("doc_id", F.col("predicted").isin(0, 1).alias("known_class"), F.round(total, 6).alias("total"))


@query("predict_with_weights", f"""
    WITH z AS (SELECT doc_id, 0.02 * len({v.sql_words('lower(text)')}) - 4 AS z FROM documents)
    SELECT doc_id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS predicted, round(1 / (1 + exp(-z)), 6) AS share FROM z
""")
def predict_with_weights(spark, sf_dir):
    """A classifier with one feature, which all words fall on, so that SQL can compute its shares."""
    folder = shared_folder(spark, "given")
    train.TextClassifier(2, np.array([[0.02, -4.0]])).save(spark, folder, "given")
    scored = train.predict_classes(train.TextClassifier.load(spark, folder, "given"), v.documents(spark, sf_dir, "text"))
    return rounded(scored.select("doc_id", F.col("predicted").cast("int").alias("predicted"), F.get("probabilities", F.lit(1)).alias("share")), "share")
