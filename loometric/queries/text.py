"""Queries: overlap scores between generated and expected texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometric.functions import computed, split_words
from loometric.operators import prep
from loometric.operators import textmetrics as tm
from loometric.plans import evaluation
from loometric.queries import views as v
from loometric.queries.prepare import rounded
from loometric.queries.registry import query

SQL_ROUGE_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def sql_grams(max_n: int) -> str:
    """Tables ``grams(pair_id, n, side, g)`` from ``words(pair_id, c, r)``."""
    leads = ", ".join(f"lead(w, {k}) OVER s AS w{k}" for k in range(1, max_n))
    parts = [f"SELECT pair_id, {n} AS n, side, " + " || ' ' || ".join(["w"] + [f"w{k}" for k in range(1, n)])
             + " AS g FROM runs" + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, max_n + 1)]
    return f"""sides AS (SELECT pair_id, 'c' AS side, unnest(range(len(c))) AS pos, unnest(c) AS w FROM words
              UNION ALL SELECT pair_id, 'r', unnest(range(len(r))), unnest(r) FROM words),
    runs AS (SELECT pair_id, side, w, {leads} FROM sides WINDOW s AS (PARTITION BY pair_id, side ORDER BY pos)),
    grams AS ({" UNION ALL ".join(parts)})"""


# n-grams as rows, counted per pair and side, then matched by a full join
SQL_ROUGE_PAIRS = f"""
    words AS (SELECT pair_id, {SQL_ROUGE_WORDS.format('generated')} AS c, {SQL_ROUGE_WORDS.format('expected')} AS r FROM fx_pairs),
    {sql_grams(2)},
    counted AS (SELECT pair_id, n, g, count(*) FILTER (side = 'c') AS cc, count(*) FILTER (side = 'r') AS rc FROM grams GROUP BY ALL),
    scored AS (SELECT pair_id, n, sum(least(cc, rc)) AS o, sum(cc) AS c, sum(rc) AS r FROM counted GROUP BY ALL),
    f AS (SELECT pair_id, n, CASE WHEN o > 0 THEN 2 * (o / c) * (o / r) / (o / c + o / r) ELSE 0 END AS f FROM scored),
    rouge AS (SELECT w.pair_id, coalesce(max(CASE WHEN n = 1 THEN f END), 0) AS rouge1,
                     coalesce(max(CASE WHEN n = 2 THEN f END), 0) AS rouge2
              FROM words w LEFT JOIN f ON f.pair_id = w.pair_id GROUP BY w.pair_id)"""


@query("rouge_n_pairs", f"""
    WITH {SQL_ROUGE_PAIRS} SELECT pair_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge
""", ("fx_pairs",))
def rouge_n_pairs(spark, sf_dir):
    scored = tm.rouge_n_pairs(v.fx_pairs(spark, sf_dir), "generated", "expected")
    return rounded(scored.select("pair_id", "rouge1", "rouge2"), "rouge1", "rouge2")


@query("rouge_n", f"""
    WITH {SQL_ROUGE_PAIRS} SELECT round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2 FROM rouge
""", ("fx_pairs",))
def rouge_n(spark, sf_dir):
    scored = tm.rouge_n_pairs(v.fx_pairs(spark, sf_dir), "generated", "expected")
    return rounded(tm.mean_scores(scored, "rouge1", "rouge2"), "rouge1", "rouge2")


@query("rouge_l_pairs")
def rouge_l_pairs(spark, sf_dir):
    scored = tm.rouge_l_pairs(v.fx_pairs(spark, sf_dir), "generated", "expected")
    return rounded(scored.select("pair_id", "rougeL"), "rougeL")


@query("rouge_l")
def rouge_l(spark, sf_dir):
    scored = tm.rouge_l_pairs(v.fx_pairs(spark, sf_dir), "generated", "expected")
    return rounded(tm.mean_scores(scored, "rougeL"), "rougeL")


# a text that lost words is a subsequence of the whole text, so every word it kept counts
@query("rouge_l_kept_words", f"""
    WITH words AS (SELECT doc_id, len({SQL_ROUGE_WORDS.format('output')}) AS c, len({SQL_ROUGE_WORDS.format('input')}) AS r FROM fx_io)
    SELECT doc_id, CASE WHEN c > 0 THEN round(2 * c / (c + r), 6) ELSE 0 END AS "rougeL" FROM words
""", ("fx_io",))
def rouge_l_kept_words(spark, sf_dir):
    """Whole texts against every third word of them; pairs with long texts are spread over tasks as tiles."""
    pairs = v.fx_io(spark, sf_dir).select("doc_id", "input", "output")
    scored = tm.rouge_l_pairs(pairs, "output", "input", key_col="doc_id", tile_words=2048)
    return rounded(scored.select("doc_id", "rougeL"), "rougeL")


# most: the words that both texts have; least: the kept words of the part that was not moved
@query("rouge_l_bounds", f"""
    WITH words AS (SELECT pair_id, {SQL_ROUGE_WORDS.format('generated')} AS c, {SQL_ROUGE_WORDS.format('expected')} AS r FROM fx_pairs),
    {sql_grams(1)},
    counted AS (SELECT pair_id, g, count(*) FILTER (side = 'c') AS cc, count(*) FILTER (side = 'r') AS rc FROM grams GROUP BY ALL),
    most AS (SELECT pair_id, sum(least(cc, rc)) AS n FROM counted GROUP BY ALL),
    tails AS (SELECT doc_id, array_to_string(list_filter(tokens[len(tokens) // 3 + 1:], lambda w, i: (i - 1) % 5 <> 4), ' ') AS kept FROM fx_words)
    SELECT doc_id AS pair_id, coalesce(n, 0)::BIGINT AS most, len({SQL_ROUGE_WORDS.format('kept')})::BIGINT AS least, true AS within
    FROM tails LEFT JOIN most ON doc_id = pair_id
""", ("fx_pairs",))
def rouge_l_bounds(spark, sf_dir):
    """Longest common subsequences lie between two numbers that SQL can count."""
    pairs = v.fx_pairs(spark, sf_dir)
    words = computed(pairs, c=tm.rouge_words(F.col("generated")), r=tm.rouge_words(F.col("expected")), w=split_words(F.col("expected")))
    tail = F.slice("w", F.expr("size(w) div 3") + 1, F.size("w"))
    kept = F.array_join(F.filter(tail, lambda w, i: i % 5 != 4), " ")
    found = words.withColumn("lcs", tm.common_subsequence("c", "r")).withColumn("o", tm.common_words("c", "r"))
    least = F.size(tm.rouge_words(kept)).cast("bigint")
    return found.select("pair_id", F.col("o").alias("most"), least.alias("least"), F.col("lcs").between(least, F.col("o")).alias("within"))


@query("corpus_bleu", f"""
    WITH words AS (SELECT pair_id, {v.sql_words('generated')} AS c, {v.sql_words('expected')} AS r FROM fx_pairs),
    orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
    {sql_grams(4)},
    counted AS (SELECT pair_id, n, g, count(*) FILTER (side = 'c') AS cc, count(*) FILTER (side = 'r') AS rc FROM grams GROUP BY ALL),
    matched AS (SELECT n, sum(least(cc, rc)) AS m FROM counted GROUP BY n),
    totals AS (SELECT n, sum(greatest(len(c) - n + 1, 1)) AS t FROM words, orders GROUP BY n),
    lengths AS (SELECT sum(len(c)) AS c, sum(len(r)) AS r FROM words)
    SELECT round(CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp(avg(ln(m / t))), 6) AS bleu,
           {", ".join(f"max(CASE WHEN n = {n} THEN m END)::BIGINT AS matches{n}" for n in range(1, 5))},
           {", ".join(f"max(CASE WHEN n = {n} THEN t END)::BIGINT AS total{n}" for n in range(1, 5))},
           c::BIGINT AS candidate_words, r::BIGINT AS reference_words
    FROM matched JOIN totals USING (n), lengths GROUP BY c, r
""", ("fx_pairs",))
def corpus_bleu(spark, sf_dir):
    return rounded(tm.corpus_bleu(v.fx_pairs(spark, sf_dir), "generated", "expected"), "bleu")


SQL_MATCH = """
    cosines AS (SELECT c.pair_id, c.pos AS cp, r.pos AS rp, list_cosine_similarity(c.vec, r.vec) AS cos
                FROM fx_vectors c JOIN fx_vectors r ON c.pair_id = r.pair_id AND c.side = 'candidate' AND r.side = 'reference'),
    p AS (SELECT pair_id, avg(b) AS precision FROM (SELECT pair_id, cp, max(cos) AS b FROM cosines GROUP BY ALL) GROUP BY pair_id),
    r AS (SELECT pair_id, avg(b) AS recall FROM (SELECT pair_id, rp, max(cos) AS b FROM cosines GROUP BY ALL) GROUP BY pair_id),
    scores AS (SELECT pair_id, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM p JOIN r USING (pair_id))"""


@query("embedding_match_pairs", f"""
    WITH {SQL_MATCH} SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores
""", ("fx_vectors",))
def embedding_match_pairs(spark, sf_dir):
    return rounded(tm.embedding_match_pairs(v.fx_vectors(spark, sf_dir)), "precision", "recall", "f1")


@query("embedding_match", f"""
    WITH {SQL_MATCH} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM scores
""", ("fx_vectors",))
def embedding_match(spark, sf_dir):
    scored = tm.embedding_match_pairs(v.fx_vectors(spark, sf_dir))
    return rounded(tm.mean_scores(scored, "precision", "recall", "f1"), "precision", "recall", "f1")


# the answers are every third word of the texts: what ROUGE-1 and ROUGE-L count is every word of the answer
@query("summarization_report", f"""
    WITH words AS (SELECT doc_id AS pair_id, {SQL_ROUGE_WORDS.format('output')} AS c, {SQL_ROUGE_WORDS.format('input')} AS r FROM fx_io),
    {sql_grams(2)},
    counted AS (SELECT pair_id, g, count(*) FILTER (side = 'c') AS cc, count(*) FILTER (side = 'r') AS rc FROM grams WHERE n = 2 GROUP BY ALL),
    pairs2 AS (SELECT pair_id, 2 * sum(least(cc, rc)) / sum(cc + rc) AS f FROM counted GROUP BY ALL),
    scores AS (SELECT avg(CASE WHEN len(c) > 0 THEN 2 * len(c) / (len(c) + len(r)) ELSE 0 END) AS one, avg(coalesce(f, 0)) AS two
               FROM words LEFT JOIN pairs2 USING (pair_id)),
    sizes AS (SELECT split, count(*) AS n, avg(len({v.sql_words('input')})) AS w FROM fx_io GROUP BY split)
    SELECT 'Dataset Information' AS section, split || ' instances' AS metric, n::DOUBLE AS value FROM sizes
    UNION ALL SELECT 'Dataset Information', split || ' avg_word_count', round(w, 6) FROM sizes
    UNION ALL SELECT 'ROUGE', 'rouge1', round(one, 6) FROM scores UNION ALL SELECT 'ROUGE', 'rougeL', round(one, 6) FROM scores
    UNION ALL SELECT 'ROUGE', 'rouge2', round(two, 6) FROM scores
""", ("fx_io",))
def summarization_report(spark, sf_dir):
    """All rows of the report but BLEU, which has a check of its own."""
    rows = v.fx_io(spark, sf_dir)
    report = evaluation.summarization_report(rows, "output", "input", prep.to_messages(rows, v.SYSTEM_PROMPT))
    return rounded(report.where("section <> 'BLEU'").select("section", "metric", "value"), "value")
