"""Queries: splits, messages, rendered text, filters, label alignment, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometric import functions as fn
from loometric.fixed import IGNORE_ID
from loometric.operators import prep, profile, relate, sampling
from loometric.plans import evaluation
from loometric.queries import views as v
from loometric.queries.registry import query
from loometric.session import shared_folder
from loometric.sources import io

EOS = "<eos>"
MAX_TOKENS = 512
SEED = 2523


def rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


@query("read_splits", """
    SELECT split, count(*) AS n, sum(len(tokens))::BIGINT AS words FROM fx_tagged GROUP BY split
""", ("fx_tagged",))
def read_splits(spark, sf_dir):
    path = shared_folder(spark, "splits")
    io.write_splits(v.fx_tagged(spark, sf_dir), path)
    return io.read_splits(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("words"))


@query("write_splits", """
    SELECT doc_id, split, text FROM fx_words
""", ("fx_words",))
def write_splits(spark, sf_dir):
    df = v.fx_io(spark, sf_dir).select("doc_id", "split", F.col("input").alias("text"))
    path = shared_folder(spark, "dataset")
    io.write_splits(df, path)
    return io.read_splits(spark, path).select("doc_id", F.col("split").cast("string").alias("split"), "text")


@query("normalize_prompts", """
    SELECT doc_id,
           CASE doc_id % 4 WHEN 0 THEN json_extract_string(item, '$')
                WHEN 1 THEN json_extract_string(item, '$.question') ELSE json_extract_string(item, '$.prompt') END AS input,
           CASE doc_id % 4 WHEN 1 THEN json_extract_string(item, '$.answer') END AS reference_response
    FROM fx_items WHERE json_type(item) = 'VARCHAR' OR json_type(item, '$.question') IS NOT NULL
         OR json_type(item, '$.prompt') IS NOT NULL
""", ("fx_items",))
def normalize_prompts(spark, sf_dir):
    return io.normalize_prompts(v.fx_items(spark, sf_dir), "item_json", "doc_id")


@query("to_messages", """
    SELECT doc_id, split, 'system|user|assistant' AS roles, instruction AS system_text, input AS user_text,
           output AS assistant_text
    FROM fx_io
""", ("fx_io",))
def to_messages(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    return df.select(
        "doc_id", "split", F.array_join("messages.role", "|").alias("roles"),
        *[prep.message_at(F.col("messages"), i).alias(n)
          for i, n in enumerate(("system_text", "user_text", "assistant_text"))])


@query("message_at", """
    SELECT doc_id, input AS user_text, output AS assistant_text, NULL::VARCHAR AS fourth FROM fx_io
""", ("fx_io",))
def message_at(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    return df.select("doc_id", prep.message_at(F.col("messages"), 1).alias("user_text"),
                     prep.message_at(F.col("messages"), 2).alias("assistant_text"),
                     prep.message_at(F.col("messages"), 3).alias("fourth"))


@query("parse_messages", """
    SELECT doc_id, 3::BIGINT AS messages, input AS user_text FROM fx_io
""", ("fx_io",))
def parse_messages(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    stored = df.select("doc_id", F.to_json("messages").alias("messages"))
    return stored.withColumn("_parsed", prep.parse_messages(F.col("messages"))).select(
        "doc_id", F.size("_parsed").cast("bigint").alias("messages"),
        prep.message_at(F.col("_parsed"), 1).alias("user_text"))


SQL_RENDERED = f"""
    '<bos><start_of_turn>user' || chr(10) || instruction || chr(10) || chr(10) || {v.sql_strip('input')}
    || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || {v.sql_strip('output')}
    || '<end_of_turn>' || chr(10)"""


def rendered(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    return df.select("doc_id", "split", prep.render_chat(F.col("messages")).alias("text"))


@query("render_chat", f"SELECT doc_id, split, {SQL_RENDERED} AS text FROM fx_io", ("fx_io",))
def render_chat(spark, sf_dir):
    return rendered(spark, sf_dir)


@query("render_request", f"""
    SELECT doc_id, '<bos><start_of_turn>user' || chr(10) || CASE WHEN split = 'train' THEN instruction || chr(10) || chr(10)
           ELSE '' END || {v.sql_strip('input')} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS text
    FROM fx_io
""", ("fx_io",))
def render_request(spark, sf_dir):
    df = v.fx_io(spark, sf_dir).withColumn("system", F.when(F.col("split") == "train", F.col("instruction")).otherwise(""))
    df = prep.request_messages(df, "system", "input")
    return df.select("doc_id", prep.render_chat(F.col("messages"), add_generation_prompt=True).alias("text"))


@query("typed_parts", f"""
    SELECT doc_id, 3::BIGINT AS parts, 'text' AS kind, {SQL_RENDERED} AS text FROM fx_io
""", ("fx_io",))
def typed_parts(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    df = df.select("doc_id", prep.to_parts(F.col("messages")).alias("typed"))
    return df.withColumn("flat", prep.flatten_parts(F.col("typed"))).select(
        "doc_id", F.size("typed").cast("bigint").alias("parts"),
        F.get(F.get("typed", F.lit(1))["content"], F.lit(0))["type"].alias("kind"),
        prep.render_chat(F.col("flat")).alias("text"))


@query("fill_prompt", """
    SELECT doc_id, 'Text: ' || input || chr(10) || 'Summary: ' || output || chr(10) || 'Score 1-5, 100%:' AS prompt FROM fx_io
""", ("fx_io",))
def fill_prompt(spark, sf_dir):
    template = "Text: {}\nSummary: {}\nScore 1-5, 100%:"
    return v.fx_io(spark, sf_dir).select("doc_id", fn.fill_prompt(template, F.col("input"), F.col("output")).alias("prompt"))


@query("filter_max_tokens", f"""
    SELECT doc_id, split, len({v.sql_words('input')})::BIGINT AS tokens
    FROM fx_io WHERE len({v.sql_words('input')}) < {MAX_TOKENS} - 3
""", ("fx_io",))
def filter_max_tokens(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select("doc_id", F.expr(v.SPLIT_RULE).alias("split"), "text")
    kept = prep.filter_max_tokens(df, "text", MAX_TOKENS)
    return kept.select("doc_id", "split", fn.word_count(F.col("text")).cast("bigint").alias("tokens"))


@query("append_eos", f"""
    SELECT doc_id, text || '{EOS}' AS text FROM documents WHERE len({v.sql_words('text')}) < {MAX_TOKENS} - 3
""")
def append_eos(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return prep.append_eos(prep.filter_max_tokens(df, "text", MAX_TOKENS), "text", EOS)


@query("drop_columns", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_columns(spark, sf_dir):
    return prep.drop_columns(v.table(spark, sf_dir, "documents"), "text")


@query("pad_truncate", """
    SELECT doc_id, array_to_string(list_resize(ids, 128, -1), ',') AS input_ids, least(len(ids), 128)::BIGINT AS attended
    FROM (SELECT doc_id, list_transform(word_ids, lambda w: coalesce(w, 0)) AS ids FROM fx_wordids)
""", ("fx_wordids",))
def pad_truncate(spark, sf_dir):
    ids = F.transform("word_ids", lambda w: F.coalesce(w, F.lit(0)))
    df = v.fx_wordids(spark, sf_dir).select("doc_id", ids.alias("ids"))
    return df.select(
        "doc_id", F.array_join(prep.pad_truncate(F.col("ids"), 128, F.lit(-1)), ",").alias("input_ids"),
        F.aggregate(prep.attention_mask(F.col("ids"), 128), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attended"))


def aligned(spark, sf_dir):
    """Subword labels over whole texts, the label dictionary joined as one map value."""
    df = v.fx_wordids(spark, sf_dir).withColumn("_ids", relate.label_map(v.TAGS))
    return df.withColumn("labels", prep.align_labels(F.col("word_ids"), F.col("tags"), F.col("_ids"))).drop("_ids")


@query("align_labels", f"""
    SELECT doc_id, array_to_string(list_transform(word_ids, lambda w, i: CASE
           WHEN w IS NULL OR w IS NOT DISTINCT FROM word_ids[i - 1] THEN {IGNORE_ID}
           ELSE {v.sql_map(v.TAGS)}[tags[w + 1]] END), ',') AS labels
    FROM fx_wordids
""", ("fx_wordids",))
def align_labels(spark, sf_dir):
    return aligned(spark, sf_dir).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("response_spans", f"""
    SELECT doc_id, 1::BIGINT AS spans, {v.sql_strip('output')} || '<end_of_turn>' || chr(10) AS response FROM fx_io
""", ("fx_io",))
def response_spans(spark, sf_dir):
    df = rendered(spark, sf_dir).withColumn("_spans", prep.response_spans(F.col("text")))
    return df.select("doc_id", F.size("_spans").cast("bigint").alias("spans"), F.get("_spans", F.lit(0)).alias("response"))


@query("mask_prompt", """
    SELECT doc_id, array_to_string(list_concat(
        list_transform(range(len(p) + 4), lambda i: -100), list_transform(o, lambda w: length(w)),
        list_transform(range(len(p) + 3), lambda i: -100), list_transform(o, lambda w: length(w))), ',') AS labels
    FROM (SELECT w.doc_id, tokens AS p, list_filter(tokens, lambda t, i: (i - 1) % 3 = 0) AS o FROM fx_words w)
""", ("fx_words",))
def mask_prompt(spark, sf_dir):
    """Two turns per text: (user, text, model, answer) twice; token ids are word lengths."""
    p = F.transform("tokens", lambda w: F.length(w))
    df = v.fx_tagged(spark, sf_dir).select(
        "doc_id", p.alias("p"), F.filter(p, lambda n, i: i % 3 == 0).alias("o"))

    def mark(*ids):
        return F.array(*[F.lit(i) for i in ids])

    ids = F.concat(mark(-7), mark(-1), "p", mark(-2, -3), "o", mark(-1), "p", mark(-2, -3), "o")
    df = df.select("doc_id", ids.alias("ids"))
    # the second instruction mark closes the first answer
    labels = prep.mask_prompt(F.col("ids"), [-1], [-2, -3])
    return df.select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("head", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def head(spark, sf_dir):
    return sampling.head(v.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 100)


@query("shuffle_rows", f"""
    SELECT *, md5(doc_id || ':{SEED}') AS place FROM documents ORDER BY place
""")
def shuffle_rows(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents")
    return sampling.shuffle_rows(df, "doc_id", SEED).withColumn("place", sampling.seeded_hash(F.col("doc_id"), SEED))


@query("sample_fraction", f"""
    SELECT doc_id, text FROM documents
    WHERE ('0x' || substr(md5(doc_id || ':{SEED}'), 1, 8))::BIGINT < {int(0.2 * (1 << 32))}
""")
def sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(v.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 0.2, SEED)


@query("sample_exact", f"""
    SELECT doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':{SEED}')) AS r, count(*) OVER () AS n
                              FROM documents) WHERE r <= floor(n * 0.2)
""")
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(v.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 0.2, SEED)


@query("split_profile", """
    SELECT split, count(*) AS rows, count(*) // 32 AS steps_per_epoch, count(*) // 32 // 5 AS eval_steps
    FROM fx_words GROUP BY split
""", ("fx_words",))
def split_profile(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select(F.expr(v.SPLIT_RULE).alias("split"))
    return profile.split_profile(df, 16, 2)


@query("sequence_length_stats", "SELECT round(avg(len(tokens)), 6) AS avg_length FROM fx_tagged", ("fx_tagged",))
def sequence_length_stats(spark, sf_dir):
    return rounded(profile.sequence_length_stats(v.fx_tagged(spark, sf_dir)), "avg_length")


@query("word_count_stats", f"""
    SELECT split, count(*) AS instances, round(avg(len({v.sql_words('input')})), 6) AS avg_word_count FROM fx_io GROUP BY split
""", ("fx_io",))
def word_count_stats(spark, sf_dir):
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    return rounded(profile.word_count_stats(df), "avg_word_count")


@query("word_count", f"SELECT doc_id, len({v.sql_words('text')})::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", fn.word_count(F.col("text")).cast("bigint").alias("words"))


@query("normalize_text", f"""
    SELECT conv_id, turn, {v.sql_strip('lower(text)')} AS normalized,
           replace({v.sql_strip('text')}, chr(10), ' ') AS cleaned,
           coalesce(replace({v.sql_strip("CASE WHEN turn % 4 <> 0 THEN text END")}, chr(10), ' '), '') AS sparse
    FROM conversations
""")
def normalize_text(spark, sf_dir):
    sparse = F.when(F.col("turn") % 4 != 0, F.col("text"))
    return v.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", fn.normalize_text(F.col("text")).alias("normalized"),
        fn.clean_cell(F.col("text")).alias("cleaned"), fn.clean_cell(sparse).alias("sparse"))


@query("join_tokens", f"SELECT doc_id, array_to_string({v.sql_words('text')}, ' ') AS joined FROM documents")
def join_tokens(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(
        "doc_id", fn.join_tokens(fn.split_words(F.col("text"))).alias("joined"))


@query("entity_types", """
    SELECT DISTINCT substr(tag, 3) AS entity_type FROM fx_tags WHERE tag <> 'O' ORDER BY 1
""", ("fx_tags",))
def entity_types(spark, sf_dir):
    tags = v.fx_tagged(spark, sf_dir).select(F.explode(F.array_distinct("tags")).alias("tag"))
    return (tags.select(fn.entity_type(F.col("tag")).alias("entity_type")).filter("entity_type IS NOT NULL")
            .distinct().orderBy("entity_type"))


@query("run_names", """
    SELECT page_id, list_last(string_split(url, '/')) AS run, replace(url, '/', '_') AS safe,
           replace(list_last(string_split(url || '_filtered', '/')), '_filtered', '') AS plain
    FROM pages
""")
def run_names(spark, sf_dir):
    url = F.col("url")
    return v.table(spark, sf_dir, "pages").select(
        "page_id", fn.run_name(url).alias("run"), fn.safe_name(url).alias("safe"),
        fn.strip_suffix(fn.run_name(F.concat(url, F.lit("_filtered")))).alias("plain"))


@query("format_metric", """
    SELECT event_id, printf('%.4f', round(value, 6)) AS four, printf('%.2f', round(value, 6)) || '%' AS share FROM events
""")
def format_metric(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(
        "event_id", fn.format_metric(F.round("value", 6)).alias("four"),
        fn.format_metric(F.round("value", 6), 2, percent_sign=True).alias("share"))


@query("training_text", f"""
    SELECT doc_id, split, text, md5(doc_id || ':{SEED}') AS place
    FROM (SELECT doc_id, split, {SQL_RENDERED} AS text FROM fx_io)
    WHERE len({v.sql_words('text')}) < {MAX_TOKENS} - 3 ORDER BY place
""", ("fx_io",))
def training_text(spark, sf_dir):
    """Stored messages to shuffled training text, with the length filter before the shuffle."""
    df = prep.to_messages(v.fx_io(spark, sf_dir), v.SYSTEM_PROMPT)
    stored = df.select("doc_id", "split", F.to_json("messages").alias("messages"))
    kept = evaluation.training_text(stored, MAX_TOKENS)
    return sampling.shuffle_rows(kept, "doc_id", SEED).withColumn("place", sampling.seeded_hash(F.col("doc_id"), SEED))
