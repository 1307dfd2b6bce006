"""One query for each operator, over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loometric.llm import (cotraining, decontaminate, encode, licenses, manifest, near, packing, pages, pii, quality, spelling, token_counts,
                           toxicity)

# The model file of two tokenizer queries, and the file of the packing query.
MODEL = "piece_bpe_32k.model"
PACKED_WITH = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_quality_rules", f"WITH {quality.sql_steps()}\nSELECT {', '.join(_QUALITY_COLUMNS)} FROM judged")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(*_QUALITY_COLUMNS)


_LINKED_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4
    THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles,
    least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = sets.doc_id), doc_id)) AS component_id FROM sets
"""


@query("op9_ngram_jaccard_join", _LINKED_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item: document, item, edits, the edits allowed, and the span."""
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == kind), False)).cast("bigint").alias(f"n_{kind}")
              for kind in pii.KINDS]
    return found.withColumn("spans", F.concat("base", "found")).select(
        "doc_id", *counts, F.sha2(pii.joined_spans("base").cast("binary"), 256).alias("base_sha256"),
        pii.joined_spans("spans").alias("spans"), F.size("found").cast("bigint").alias("n_found"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether decoding them gives the text back."""
    return encode.encoded(table(spark, sf_dir, "documents"), model_path())


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model_path())


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op3_site_style_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op4_cotraining_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The checksum of a text, byte by byte: ``sums`` is its table.
_SUMS_SQL = """sums AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""


def _checksum_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_transform(range(len({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT), "
            "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)")


_SPELLING_SQL = rf"""
WITH RECURSIVE {_SUMS_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY ALL),
summed AS (SELECT r, n, {_checksum_sql("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM counted, sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END
    AS word FROM summed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT l.word AS a, w.word AS b FROM less l JOIN words w ON l.v = w.word),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
ranked AS (SELECT near.a AS word, near.b AS other, w.n AS other_n, row_number() OVER (PARTITION BY near.a ORDER BY w.n DESC, near.b) AS k,
    count(*) OVER (PARTITION BY near.a) AS n_near FROM near JOIN words w ON near.b = w.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND k = 1),
led(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON led.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n FROM formed f JOIN led ON f.word = led.word JOIN formed last ON led.root = last.word
WHERE last.form IS NULL
"""


@query("op11_spelling_variants", _SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def _leaf_sql(n_chars: str) -> str:
    texts = [f"{x}::VARCHAR" for x in ("doc_id", "source", "lang", n_chars, "text")]
    parts = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in texts]
    return f"sha256({' || '.join(parts)})"


def _levels_sql(name: str, first: str) -> str:
    """A table of all nodes above the first level."""
    return f"""{name}(tree, height, pos, digest, n) AS ({first}
    UNION ALL SELECT tree, height + 1, pos // 2, sha256(digest || coalesce(other, '')), (n + 1) // 2
    FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY pos) AS other FROM {name}) WHERE n > 1 AND pos % 2 = 0)"""


def _walk_sql(name: str, nodes: str, first: str) -> str:
    """Paths from ``first`` up to the roots of ``nodes``: the siblings so far, and the digest that they give."""
    return f"""{name}(tree, leaf_pos, inside_of, height, pos, digest, proof) AS ({first}
    UNION ALL SELECT w.tree, w.leaf_pos, w.inside_of, w.height + 1, w.pos // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.digest || w.digest
        ELSE w.digest || coalesce(s.digest, '') END), w.proof || coalesce(s.digest, '')
    FROM {name} w JOIN {nodes} own ON own.tree = w.inside_of AND own.height = w.height AND own.pos = w.pos AND own.n > 1
    LEFT JOIN {nodes} s ON s.tree = w.inside_of AND s.height = w.height AND s.pos = xor(w.pos, 1))"""


_MANIFEST_SQL = f"""
WITH RECURSIVE {_SUMS_SQL},
leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_checksum_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL
    THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents, sums),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1
    AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_levels_sql("nodes", "SELECT tree, 0, pos, leaf, n FROM placed")},
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
{_levels_sql("tops", "SELECT 0::BIGINT, 0, tree, digest, count(*) OVER () FROM subroots")},
{_walk_sql("inside", "nodes", "SELECT tree, pos, tree, 0, pos, coalesce(tampered, leaf), '' FROM placed")},
{_walk_sql("above", "tops", '''SELECT i.tree, i.leaf_pos, 0::BIGINT, 0, i.tree, i.digest, i.proof FROM inside i
    JOIN nodes r ON r.tree = i.tree AND r.n = 1 AND i.height = r.height''')},
root AS (SELECT height, digest FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(a.proof) AS proof_sha256, a.digest AS folded_root, a.digest = r.digest AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree JOIN above a ON a.tree = p.tree AND a.leaf_pos = p.pos JOIN root r ON a.height = r.height
"""


@query("op12_merkle_manifest", _MANIFEST_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_manifest(table(spark, sf_dir, "documents"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), model_path(PACKED_WITH))
