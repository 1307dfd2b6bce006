"""Stand-in inputs over the given tables, once for Spark and once as SQL for the check.

Each view covers its whole table and whole texts. The ``% n`` rules give every row one
of several forms; none leaves rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loometric.fixed import WHITESPACE_CHARS, WORD_START
from loometric.functions import argmax_label, computed, let, split_words
from loometric.operators.spans import decode_bio

LABELS = {f"L{i}": i for i in range(11)}
TAGS = {f"{prefix}-{kind}": 4 * p + k for p, prefix in enumerate("BI")
        for k, kind in enumerate(("LOC", "MISC", "ORG", "PER"))} | {"O": 8}
READABLE = {"LOC": "Location", "ORG": "Organization", "PER": "Person"}
ROTATED = {"Location": "Organization", "Organization": "Person", "Person": "MISC", "MISC": "Location"}
SYSTEM_PROMPT = "Summarize the text."
RUNS = ("click", "error", "purchase", "signup", "view")
FIRST_PAD = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as they are scanned, whatever their number; split sizes are settings of the session."""
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


# --- SQL pieces -------------------------------------------------------------------

SQL_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE_CHARS) + "]+"
SQL_TRIM = " || ".join(["''"] + [f"chr({ord(c)})" for c in WHITESPACE_CHARS])


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SQL_SPACE}'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_TRIM})"


def sql_map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in pairs.items()) + "}"


SPLIT_RULE = ("CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END")
KIND_RULE = ("CASE lang WHEN 'en' THEN 'PER' WHEN 'fr' THEN 'LOC' WHEN 'de' THEN 'ORG' ELSE 'MISC' END")


# --- Spark views ------------------------------------------------------------------

def fx_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten class scores per vector: each sums every tenth dimension."""
    def score(k: int) -> Column:
        return F.aggregate(F.filter("embedding", lambda x, i: i % 10 == k), F.lit(0.0), lambda a, x: a + x)

    df = computed(table(spark, sf_dir, "embeddings"), logits=F.array(*[score(k) for k in range(10)]))
    return computed(df, p=argmax_label(F.col("logits"))).select(
        F.col("vec_id").alias("id"), F.col("label").alias("t"), "logits", "p")


def fx_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.col("quality").alias("t"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("p"))


def fx_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tags: capital words open or continue an entity, every 17th word is plain."""
    df = computed(documents(spark, sf_dir, "lang", "text").select(
        "doc_id", F.expr(SPLIT_RULE).alias("split"), F.expr(KIND_RULE).alias("kind"), "text",
    ), tokens=split_words(F.col("text")))
    capital = "^[A-Z]"
    tag = (lambda w, i: F.when(i % 17 == 0, "O")
           .when(~F.rlike(w, F.lit(capital)), "O")
           .when(F.rlike(F.get("tokens", i - 1), F.lit(capital)), F.concat(F.lit("I-"), F.col("kind")))
           .otherwise(F.concat(F.lit("B-"), F.col("kind"))))
    return computed(df, tags=F.transform("tokens", tag)).select("doc_id", "split", "tokens", "tags")


def fx_wordids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-character pieces of the words, with the word index of each piece."""
    ids = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / 4).cast("int"))))
    null = F.array(F.lit(None).cast("int"))
    return fx_tagged(spark, sf_dir).select("doc_id", "tags", F.concat(null, ids, null).alias("word_ids"))


def _pieces(words: Column, width: int = 4) -> Column:
    """Pieces of all words in order, with a word-start mark before each word but the first: one pass over the joined words."""
    mark = f"(?<= ){WORD_START}"
    return F.regexp_extract_all(F.array_join(words, f" {WORD_START}"), F.lit(f"{mark}[^ ]{{1,{width}}}|[^ ]{{1,{width}}}"), F.lit(0))


def _piece_spans(words: Column, width: int = 4, listed: int = 32) -> Column:
    """(start, end) in its word of each piece; those of words of up to ``listed`` characters are looked up by the length."""
    def spans(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1, F.lit(width)), lambda s: F.struct(
            s.alias("start"), F.least(s + width, n).alias("end")))

    short = F.array(*[F.array(*[F.struct(F.lit(s).alias("start"), F.lit(min(s + width, n)).alias("end")) for s in range(0, n, width)])
                      for n in range(1, listed + 1)])
    return F.flatten(F.transform(words, lambda w: F.coalesce(F.get(short, F.length(w) - 1), let(F.length(w), spans))))


def fx_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with a word-start mark, offsets inside the word, and a prediction each."""
    edge = F.array(F.lit("<s>"))
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    df = computed(documents(spark, sf_dir, "text"), _words=split_words(F.col("text"))).drop("text")
    df = computed(df, subwords=F.concat(edge, _pieces(F.col("_words")), edge))
    return df.select(
        "doc_id", "subwords", F.concat(none, _piece_spans(F.col("_words")), none).alias("offsets"),
        F.transform("subwords", lambda p, i: ((i + F.col("doc_id")) % 7).cast("int")).alias("preds"))


def fx_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True spans, and predicted ones with lost words, other labels and gaps."""
    df = computed(fx_tagged(spark, sf_dir), true=decode_bio(F.col("tokens"), F.col("tags"), READABLE))
    rotated = F.create_map(*[F.lit(x) for pair in ROTATED.items() for x in pair])
    numbered = F.transform("true", lambda s, i: F.struct(
        (i + 1).alias("k"),
        F.when((i + 1) % 3 == 0, F.when(F.contains(s["text"], F.lit(" ")), F.regexp_replace(s["text"], "^[^ ]+ ", ""))
               .otherwise("")).otherwise(s["text"]).alias("text"),
        F.when((i + 1) % 5 == 0, F.element_at(rotated, s["label"])).otherwise(s["label"]).alias("label"),
        (((i + 1) % 10) / 10).alias("score")))
    return computed(df, pred=F.filter(numbered, lambda s: s["k"] % 7 != 0)).select("doc_id", "true", "pred")


def fx_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows: the whole text, and every third word of it as the answer."""
    df = documents(spark, sf_dir, "text").select(
        "doc_id", F.expr(SPLIT_RULE).alias("split"), F.lit(SYSTEM_PROMPT).alias("instruction"),
        F.col("text").alias("input"))
    return computed(df, output=F.array_join(F.filter(split_words(F.col("input")), lambda w, i: i % 3 == 0), " "))


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected texts, and generated ones: a third moved to the end, every fifth word lost."""
    df = computed(documents(spark, sf_dir, "text").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("expected")), _words=split_words(F.col("expected")))
    third = F.expr("size(_words) div 3")
    moved = F.concat(F.slice("_words", third + 1, F.size("_words")), F.slice("_words", F.lit(1), third))
    generated = F.array_join(F.filter(moved, lambda w, i: i % 5 != 4), " ")
    return computed(df, generated=generated).select("pair_id", "expected", "generated")


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("vec_id") % 10
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("pair_id"),
        F.when(pos < 5, "candidate").otherwise("reference").alias("side"),
        pos.alias("pos"), (pos >= FIRST_PAD).alias("is_pad"), F.col("embedding").alias("vec"))


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("run"),
        F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 8).cast("string")).alias("input"),
        F.col("props").alias("response"),
        F.when(F.col("event_id") % 11 != 0, 1 + F.col("event_id") % 5).alias("score"))


def fx_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents that have labels already."""
    return (table(spark, sf_dir, "documents")
            .join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
            .select(F.col("text").alias("input")))


def fx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as union-typed JSON: a string, a question, a prompt, or something else."""
    text = F.col("text")
    whole = F.to_json(F.array(text))
    form = F.col("doc_id") % 4
    return documents(spark, sf_dir, "source", "text").select("doc_id", F.when(
        form == 0, F.substr(whole, F.lit(2), F.length(whole) - 2)).when(
        form == 1, F.to_json(F.struct(text.alias("question"), F.col("source").alias("answer")))).when(
        form == 2, F.to_json(F.struct(text.alias("prompt")))).otherwise(
        F.to_json(F.struct(text.alias("other")))).alias("item_json"))


def fx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output: prompt, mark and answer; some without a mark, some with two."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("u"))
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("a"))
    form = (F.col("conv_id") + F.col("turn")) % 4
    mark = F.when(form == 1, "\n").when(form == 2, "\nmodel\nmodel\n").otherwise("\nmodel\n")
    return said.join(asked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", form.alias("form"), F.concat(F.lit("user\n"), F.coalesce("u", F.lit("")), mark, "a").alias("raw"))


def fx_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("doc_id") % 6
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("run"),
        F.when(form == 0, "5").when(form == 1, " 4 ").when(form == 2, "3.0").when(form == 3, "")
        .when(form == 5, "iyi").alias("raw"))


def fx_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers: right, one entity short, not JSON, missing, without a label, or no object."""
    form = F.col("doc_id") % 6
    entities = F.zip_with("tokens", "tags", lambda w, t: F.struct(w.alias("kelime"), t.alias("etiket")))
    bare = F.transform("tokens", lambda w: F.struct(w.alias("kelime")))
    return computed(fx_tagged(spark, sf_dir), response=F.when(form == 0, F.to_json(F.struct(entities.alias("entities"))))
        .when(form == 1, F.to_json(F.struct(F.slice(entities, 2, F.size("tokens")).alias("entities"))))
        .when(form == 2, F.concat(F.lit("the labels are "), F.array_join("tags", ", ")))
        .when(form == 4, F.to_json(F.struct(bare.alias("entities"))))
        .when(form == 5, F.to_json("tags"))).drop("split")


def fx_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = (F.when(F.col("role") == "user", "Soru: ").when(F.col("role") == "assistant", "Cevap: ")
            .otherwise("İlgili Yasa: "))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source"), F.col("turn").alias("row_no"),
        F.when(F.col("turn") % 4 != 0, F.col("turn")).alias("col_b"), F.concat(mark, "text").alias("text"))


def fx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("int").alias("label"))


# --- the same views for the check: name -> (views it reads, SQL) ---------------------

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_logits": ((), """
        SELECT vec_id AS id, label AS t, list_transform(range(10), lambda k:
               coalesce(list_sum(list_filter(embedding, lambda x, i: (i - 1) % 10 = k)::DOUBLE[]), 0)) AS logits
        FROM embeddings"""),
    "fx_pred": (("fx_logits",), """
        SELECT id, t, logits, (list_position(logits, list_max(logits)) - 1)::BIGINT AS p FROM fx_logits"""),
    "fx_binary": ((), """
        SELECT l.doc_id, l.quality AS t, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS p
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
    "fx_words": ((), f"""
        SELECT doc_id, lang, source, text, {SPLIT_RULE} AS split, {KIND_RULE} AS kind,
               {sql_words('text')} AS tokens FROM documents"""),
    "fx_tagged": (("fx_words",), """
        SELECT doc_id, split, tokens, list_transform(tokens, lambda w, i: CASE
               WHEN (i - 1) % 17 = 0 OR NOT regexp_matches(w, '^[A-Z]') THEN 'O'
               WHEN regexp_matches(tokens[i - 1], '^[A-Z]') THEN 'I-' || kind
               ELSE 'B-' || kind END) AS tags
        FROM fx_words"""),
    "fx_tags": (("fx_tagged",), """
        SELECT doc_id, split, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token, unnest(tags) AS tag
        FROM fx_tagged"""),
    "fx_wordids": (("fx_tagged",), """
        SELECT doc_id, tags, list_concat([NULL::BIGINT], flatten(list_transform(tokens, lambda w, i:
               list_transform(range(ceil(length(w) / 4)::BIGINT), lambda c: (i - 1)::BIGINT))), [NULL::BIGINT]) AS word_ids
        FROM fx_tagged"""),
    "fx_pieces": (("fx_tagged",), f"""
        SELECT doc_id, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS place, pos, k, piece, start, stop
        FROM (SELECT doc_id, pos, k,
                     CASE WHEN pos > 0 AND k = 0 THEN '{WORD_START}' ELSE '' END || substr(word, 4 * k + 1, 4) AS piece,
                     4 * k AS start, 4 * k + length(substr(word, 4 * k + 1, 4)) AS stop
              FROM (SELECT doc_id, pos, word, unnest(range(ceil(length(word) / 4)::BIGINT)) AS k
                    FROM (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM fx_tagged)))"""),
    # spans by the textbook way: a running count of run starts numbers the runs
    "fx_true_spans": (("fx_tags",), """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k, text,
               CASE kind WHEN 'LOC' THEN 'Location' WHEN 'ORG' THEN 'Organization' WHEN 'PER' THEN 'Person'
                    ELSE kind END AS label
        FROM (SELECT doc_id, run, min(pos) AS start, string_agg(token, ' ' ORDER BY pos) AS text,
                     arg_min(tag, pos) AS first_tag, substr(arg_min(tag, pos), 3) AS kind
              FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS run
                    FROM (SELECT *, CASE WHEN tag LIKE 'I-%' AND
                                 coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY pos), 'O')
                                     IN ('B-' || substr(tag, 3), tag) THEN 0 ELSE 1 END AS starts FROM fx_tags))
              GROUP BY doc_id, run)
        WHERE first_tag LIKE 'B-%'"""),
    "fx_pred_spans": (("fx_true_spans",), """
        SELECT doc_id, k,
               CASE WHEN k % 3 = 0 THEN CASE WHEN contains(text, ' ') THEN regexp_replace(text, '^[^ ]+ ', '') ELSE '' END
                    ELSE text END AS text,
               CASE WHEN k % 5 <> 0 THEN label WHEN label = 'Location' THEN 'Organization'
                    WHEN label = 'Organization' THEN 'Person' WHEN label = 'Person' THEN 'MISC' ELSE 'Location' END AS label,
               (k % 10) / 10.0::DOUBLE AS score
        FROM fx_true_spans WHERE k % 7 <> 0"""),
    "fx_io": (("fx_words",), f"""
        SELECT doc_id, split, '{SYSTEM_PROMPT}' AS instruction, text AS input,
               array_to_string(list_filter(tokens, lambda w, i: (i - 1) % 3 = 0), ' ') AS output
        FROM fx_words"""),
    "fx_pairs": (("fx_words",), """
        SELECT doc_id AS pair_id, text AS expected,
               array_to_string(list_filter(list_concat(tokens[len(tokens) // 3 + 1:], tokens[1:len(tokens) // 3]),
                                           lambda w, i: (i - 1) % 5 <> 4), ' ') AS generated
        FROM fx_words"""),
    "fx_vectors": ((), """
        SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id % 10 < 5 THEN 'candidate' ELSE 'reference' END AS side,
               vec_id % 10 AS pos, vec_id % 10 >= 8 AS is_pad, embedding::DOUBLE[] AS vec
        FROM embeddings"""),
    "fx_runs": ((), """
        SELECT event_id AS id, event_type AS run, user_id || ':' || (event_id % 8) AS input, props AS response,
               CASE WHEN event_id % 11 <> 0 THEN 1 + event_id % 5 END AS score
        FROM events"""),
    "fx_done": ((), """
        SELECT text AS input FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""),
    "fx_items": ((), """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN to_json(text)
               WHEN 1 THEN to_json({'question': text, 'answer': source})
               WHEN 2 THEN to_json({'prompt': text}) ELSE to_json({'other': text}) END AS item
        FROM documents"""),
    "fx_raw": ((), """
        SELECT a.conv_id, a.turn, (a.conv_id + a.turn) % 4 AS form,
               'user' || chr(10) || coalesce(u.text, '') || CASE (a.conv_id + a.turn) % 4 WHEN 1 THEN chr(10)
               WHEN 2 THEN chr(10) || 'model' || chr(10) || 'model' || chr(10)
               ELSE chr(10) || 'model' || chr(10) END || a.text AS raw
        FROM conversations a LEFT JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user'
        WHERE a.role = 'assistant'"""),
    "fx_judge": ((), """
        SELECT doc_id, source AS run, CASE doc_id % 6 WHEN 0 THEN '5' WHEN 1 THEN ' 4 ' WHEN 2 THEN '3.0'
               WHEN 3 THEN '' WHEN 5 THEN 'iyi' END AS raw
        FROM documents"""),
    "fx_structured": (("fx_tagged",), """
        SELECT doc_id, tokens, tags, CASE doc_id % 6
               WHEN 0 THEN to_json({'entities': list_transform(tokens, lambda w, i: {'kelime': w, 'etiket': tags[i]})})::VARCHAR
               WHEN 1 THEN to_json({'entities': list_transform(tokens, lambda w, i: {'kelime': w, 'etiket': tags[i]})[2:]})::VARCHAR
               WHEN 2 THEN 'the labels are ' || array_to_string(tags, ', ')
               WHEN 4 THEN to_json({'entities': list_transform(tokens, lambda w: {'kelime': w})})::VARCHAR
               WHEN 5 THEN to_json(tags)::VARCHAR END AS response
        FROM fx_tagged"""),
    "fx_parsed": (("fx_structured",), """
        SELECT *, CASE WHEN broken_reason IS NULL THEN found END AS pred_tags
        FROM (SELECT *, CASE WHEN response IS NULL THEN 'no_response' WHEN NOT json_valid(response) THEN 'bad_json'
                     WHEN json_type(response) <> 'OBJECT' THEN 'bad_shape' WHEN size <> len(tokens) THEN 'length_mismatch'
                     WHEN len(list_filter(found, lambda x: x IS NULL)) > 0 THEN 'missing_label' END AS broken_reason
              FROM (SELECT *, coalesce(TRY(json_array_length(response, '$.entities')), 0) AS size,
                           CASE WHEN json_valid(response) THEN list_transform(
                               json_extract(response, '$.entities[*]'), lambda e: json_extract_string(e, '$.etiket')) END AS found
                    FROM fx_structured))"""),
    "fx_sheet": ((), """
        SELECT conv_id AS source, turn AS row_no, CASE WHEN turn % 4 <> 0 THEN turn END AS col_b,
               CASE role WHEN 'user' THEN 'Soru: ' WHEN 'assistant' THEN 'Cevap: ' ELSE 'İlgili Yasa: ' END || text AS text
        FROM conversations"""),
    "fx_text": ((), """
        SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    # per-class scores of the prediction table
    "fx_counts": (("fx_pred",), """
        SELECT t AS truth, p AS predicted, count(*) AS n FROM fx_pred GROUP BY ALL"""),
    "fx_classes": (("fx_counts",), """
        SELECT label, sum(s)::BIGINT AS support, sum(g)::BIGINT AS guesses, sum(h)::BIGINT AS hits,
               CASE WHEN sum(g) > 0 THEN sum(h) / sum(g) ELSE 0 END AS precision,
               CASE WHEN sum(s) > 0 THEN sum(h) / sum(s) ELSE 0 END AS recall,
               CASE WHEN sum(h) > 0 THEN 2 * (sum(h) / sum(g)) * (sum(h) / sum(s)) / (sum(h) / sum(g) + sum(h) / sum(s))
                    ELSE 0 END AS f1
        FROM (SELECT truth AS label, n AS s, 0 AS g, CASE WHEN truth = predicted THEN n ELSE 0 END AS h FROM fx_counts
              UNION ALL SELECT predicted, 0, n, 0 FROM fx_counts)
        GROUP BY label"""),
}
