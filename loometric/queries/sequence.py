"""Queries: entity spans, span matching, question sheets, subword merging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loometric.operators import relate, spans
from loometric.queries import views as v
from loometric.queries.prepare import rounded
from loometric.queries.registry import query

PRED_NAMES = {i: f"P{i}" for i in range(7)}


@query("decode_bio", "SELECT doc_id, k, text, label FROM fx_true_spans", ("fx_true_spans",))
def decode_bio(spark, sf_dir):
    df = v.fx_tagged(spark, sf_dir)
    found = df.select("doc_id", F.posexplode(
        spans.decode_bio(F.col("tokens"), F.col("tags"), v.READABLE)).alias("k", "span"))
    return found.select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), "span.text", "span.label")


@query("decode_bio_long", "SELECT doc_id, k, text, label FROM fx_true_spans", ("fx_true_spans",))
def decode_bio_long(spark, sf_dir):
    """The same spans from one row for each token, numbered by their start."""
    df = v.fx_tagged(spark, sf_dir)
    rows = df.select("doc_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "t")).select("doc_id", "pos", "t.tokens", "t.tags")
    found = spans.decode_bio_long(rows, "doc_id", "pos", "tokens", "tags", v.READABLE, chunk=256)
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("start"))
    return found.select("doc_id", k.cast("bigint").alias("k"), "text", "label")


@query("filter_entities", """
    SELECT doc_id, k, text, label, round(score, 6) AS score FROM fx_pred_spans
    WHERE score >= 0.5 AND label IN ('Location', 'Organization', 'Person')
""", ("fx_pred_spans",))
def filter_entities(spark, sf_dir):
    kept = spans.filter_entities(F.col("pred"), 0.5, ["Location", "Organization", "Person"])
    df = v.fx_spans(spark, sf_dir).select("doc_id", F.inline(kept))
    return rounded(df.withColumn("k", F.col("k").cast("bigint")), "score")


# the matching by steps: one prediction of every document per step
SQL_MATCHES = f"""
    truths AS (SELECT doc_id, list({{'label': label, 'words': {v.sql_words(v.sql_strip('lower(text)'))}}} ORDER BY k) AS t
               FROM fx_true_spans GROUP BY doc_id),
    guesses AS (SELECT doc_id, list({{'label': label, 'words': {v.sql_words(v.sql_strip('lower(text)'))}}} ORDER BY k) AS p
                FROM fx_pred_spans GROUP BY doc_id),
    docs AS (SELECT doc_id, t, coalesce(p, []) AS p FROM truths LEFT JOIN guesses USING (doc_id)),
    steps(doc_id, i, taken, hit) AS (
        SELECT doc_id, 0, []::BIGINT[], NULL::BIGINT FROM docs
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN h IS NULL THEN taken ELSE list_append(taken, h) END, h
        FROM (SELECT s.doc_id, s.i, s.taken, list_filter(range(1, len(d.t) + 1), lambda j: d.t[j].label = d.p[s.i + 1].label
                     AND list_has_any(d.t[j].words, d.p[s.i + 1].words) AND NOT list_contains(s.taken, j))[1] AS h
              FROM steps s JOIN docs d USING (doc_id) WHERE s.i < len(d.p))),
    pairs AS (
        SELECT doc_id, CASE WHEN hit IS NULL THEN 'None' ELSE p[i].label END AS truth, p[i].label AS predicted
        FROM steps JOIN docs USING (doc_id) WHERE i > 0
        UNION ALL
        SELECT doc_id, t[j].label, 'None' FROM (SELECT s.doc_id, d.t, s.taken, unnest(range(1, len(d.t) + 1)) AS j
            FROM steps s JOIN docs d USING (doc_id) WHERE s.i = len(d.p)) WHERE NOT list_contains(taken, j))"""


@query("match_entities", f"""
    WITH {SQL_MATCHES} SELECT doc_id, truth, predicted, count(*) AS n FROM pairs GROUP BY ALL
""", ("fx_true_spans", "fx_pred_spans"), recursive=True)
def match_entities(spark, sf_dir):
    matched = spans.match_entities(v.fx_spans(spark, sf_dir)).select("doc_id", F.inline("matches"))
    return matched.groupBy("doc_id", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("entity_overlap_scores", f"""
    WITH {SQL_MATCHES},
    classes AS (SELECT x, sum(s) AS s, sum(g) AS g, sum(h) AS h FROM (
        SELECT truth AS x, 1 AS s, 0 AS g, (truth = predicted)::INT AS h FROM pairs
        UNION ALL SELECT predicted, 0, 1, 0 FROM pairs) GROUP BY x)
    SELECT round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 6) AS precision,
           round(avg(CASE WHEN s > 0 THEN h / s ELSE 0 END), 6) AS recall,
           round(avg(2 * h / (s + g)), 6) AS f1, sum(s)::BIGINT AS support FROM classes
""", ("fx_true_spans", "fx_pred_spans"), recursive=True)
def entity_overlap_scores(spark, sf_dir):
    return rounded(spans.entity_overlap_scores(v.fx_spans(spark, sf_dir)), "precision", "recall", "f1")


@query("extract_qa", f"""
    WITH marked AS (SELECT *, sum(CASE WHEN contains(cell, 'Soru:') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY row_no) AS item
        FROM (SELECT source, row_no, col_b, replace({v.sql_strip('text')}, chr(10), ' ') AS cell FROM fx_sheet)
        WHERE contains(cell, 'Soru:') OR contains(cell, 'Cevap:') OR contains(cell, 'İlgili Yasa:'))
    SELECT source, item::BIGINT AS item, max(CASE WHEN contains(cell, 'Soru:') THEN col_b END) AS id,
           {v.sql_strip("replace(arg_max(cell, row_no) FILTER (contains(cell, 'Soru:')), 'Soru:', '')")} AS question,
           {v.sql_strip("replace(arg_max(cell, row_no) FILTER (contains(cell, 'Cevap:') AND NOT contains(cell, 'Soru:')), 'Cevap:', '')")} AS answer,
           {v.sql_strip("replace(arg_max(cell, row_no) FILTER (contains(cell, 'İlgili Yasa:') AND NOT contains(cell, 'Soru:') AND NOT contains(cell, 'Cevap:')), 'İlgili Yasa:', '')")} AS law
    FROM marked GROUP BY source, item
""", ("fx_sheet",))
def extract_qa(spark, sf_dir):
    return spans.extract_qa(v.fx_sheet(spark, sf_dir))


@query("merge_subwords", """
    SELECT doc_id, string_agg(CASE WHEN pos = 0 AND k = 0 THEN piece ELSE substr(piece, 2) END || '/P' || ((place + doc_id) % 7), ' '
                              ORDER BY pos) AS words
    FROM fx_pieces WHERE k = 0 GROUP BY doc_id
""", ("fx_pieces",))
def merge_subwords(spark, sf_dir):
    """Whole texts: no subword is cut off."""
    df = v.fx_subwords(spark, sf_dir).withColumn("_names", relate.label_map(PRED_NAMES))
    merged = spans.merge_subwords(F.col("subwords"), F.col("offsets"), F.col("preds"), F.col("_names"), max_length=None)
    return df.select("doc_id", F.array_join(
        F.transform(merged, lambda m: F.concat(m["word"], F.lit("/"), m["label"])), " ").alias("words"))


@query("merge_subwords_long", """
    SELECT doc_id, place AS pos, CASE WHEN pos = 0 AND k = 0 THEN piece ELSE substr(piece, 2) END AS word, 'P' || ((place + doc_id) % 7) AS label
    FROM fx_pieces WHERE k = 0
""", ("fx_pieces",))
def merge_subwords_long(spark, sf_dir):
    """One row for each subword, and one for each word that counts."""
    df = v.fx_subwords(spark, sf_dir)
    zipped = F.arrays_zip(F.col("subwords").alias("subword"), F.col("offsets").alias("offset"), F.col("preds").alias("pred"))
    rows = df.select("doc_id", F.posexplode(zipped).alias("pos", "s")).select("doc_id", "pos", "s.subword", "s.offset.start", "s.offset.end", "s.pred")
    return spans.merge_subwords_long(rows, PRED_NAMES).withColumn("pos", F.col("pos").cast("bigint"))
