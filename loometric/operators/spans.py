"""Entity spans, question sheets and subword merging."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from loometric.fixed import ANSWER_MARK, LAW_MARK, QUESTION_MARK, WORD_START
from loometric.functions.stage import computed, row_slices
from loometric.functions.text import clean_cell, let, normalize_text, split_words, strip
from loometric.operators.classmetrics import per_class
from loometric.operators.relate import label_map, lookup

SPANS_TYPE = "array<struct<text:string,label:string>>"


def decode_bio(tokens: Column, tags: Column, names: Mapping[str, str] | None = None) -> Column:
    """Token and tag arrays as entity spans ``(text, label)``.

    A sequence is cut into runs: a new run starts wherever a tag does not continue the
    one before it. Runs that open with ``B-`` are spans; the others, orphan ``I-``
    tags among them, are dropped. Everything happens inside the row.
    """
    def continues(i: Column) -> Column:
        tag, before = F.get(tags, i), F.get(tags, i - 1)
        kind = F.substr(tag, F.lit(3))
        return F.coalesce(tag.startswith("I-") & ((before == F.concat(F.lit("B-"), kind)) | (before == tag)),
                          F.lit(False))

    heads = F.filter(F.transform(tags, lambda t, i: i), lambda i: ~continues(i))

    def spans(runs: Column) -> Column:
        bounded = F.transform(runs, lambda s, k: F.struct(
            s.alias("start"), F.coalesce(F.get(runs, k + 1), F.size(tags)).alias("stop")))
        opened = F.filter(bounded, lambda r: F.get(tags, r["start"]).startswith("B-"))
        table = label_map(names) if names else None

        def label(kind: Column) -> Column:
            return lookup(table, kind) if names else kind

        return F.transform(opened, lambda r: F.struct(
            F.array_join(F.slice(tokens, r["start"] + 1, r["stop"] - r["start"]), " ").alias("text"),
            label(F.substr(F.get(tags, r["start"]), F.lit(3))).alias("label")))

    return let(heads, spans)


CHUNK = 4096


def _continues(tag: Column, before: Column) -> Column:
    return F.coalesce(tag.startswith("I-") & ((before == F.concat(F.lit("B-"), F.substr(tag, F.lit(3)))) | (before == tag)), F.lit(False))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, part, pos, known, before, piece) of the tokens that their batch can't settle: see ``decode_bio_long``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, part, pos, token, tag = batch.columns
        follows = np.zeros(len(tag) + 1, dtype=bool)
        if pa.types.is_integer(pos.type):
            after = pc.and_(pc.equal(doc[1:], doc[:-1]), pc.equal(pc.subtract(pos[1:], pos[:-1]), 1))
            follows[1:-1] = pc.fill_null(after, False).to_numpy(zero_copy_only=False)
        inside = pc.fill_null(pc.or_(pc.starts_with(tag, "B-"), pc.starts_with(tag, "I-")), False)
        keep = pa.array(inside.to_numpy(zero_copy_only=False) | ~follows[1:])
        before = pa.concat_arrays([pa.nulls(1, tag.type), tag[:-1]])
        piece = pa.StructArray.from_arrays([tag, pc.if_else(inside, token, pa.scalar(None, token.type))], ["tag", "token"])
        yield pa.RecordBatch.from_arrays([doc, part, pos, pa.array(follows[:-1]), before, piece],
                                         names=["doc", "part", "pos", "known", "before", "piece"]).filter(keep)


def decode_bio_long(tokens: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos", token_col: str = "token", tag_col: str = "tag",
                    names: Mapping[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc, start, stop, text, label) of the spans of ``decode_bio`` from one row for each token.

    A segmented scan: positions are cut into chunks, so one huge document is worked on by many tasks. A chunk is summed up by its
    first and last tag, its first position and the last place behind that where a run starts; on these few rows the state at
    each chunk's border follows (the tag before it, the place where the run open there has started), and only this state is carried
    into the chunk. ``start`` and ``stop`` (inclusive) are positions, which rise in a document and may leave gaps.

    Where the tokens at whole positions p - 1 and p come one after the other, the tag before p is known at once; a token outside all
    spans whose follower knows it is needed no more, so of text in order little more than the spans' tokens is shuffled.
    """
    rows = tokens.select(F.col(doc_col).alias("doc"), F.floor(F.col(pos_col) / chunk).alias("part"), F.col(pos_col).alias("pos"),
                         F.col(token_col).alias("token"), F.col(tag_col).alias("tag"))
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(name, types[name]) for name in ("doc", "part", "pos")] + [
        StructField("known", BooleanType()), StructField("before", types["tag"]),
        StructField("piece", StructType([StructField(name, types[name]) for name in ("tag", "token")]))])
    # said here, the condition of the join below is the same on both its ways
    rows = rows.mapInArrow(_neighbours, schema).where(F.col("doc").isNotNull() & F.col("part").isNotNull())
    inside = W.partitionBy("doc", "part").orderBy("pos")
    # whole pieces on both ways, so that one shuffle serves them
    above = F.lag("piece").over(inside)
    marked = rows.withColumn("above_it", above).withColumn("open_it", ~F.col("known") & (F.row_number().over(inside) == 1))
    marked = marked.select("doc", "part", "pos", "piece", F.col("piece.tag").alias("tag"), F.col("open_it").alias("first"),
                           F.when(F.col("known"), F.col("before")).otherwise(F.col("above_it.tag")).alias("before"))
    begins = F.when(~F.col("first") & ~_continues(F.col("tag"), F.col("before")), F.col("pos"))
    borders = marked.groupBy("doc", "part").agg(F.min_by("piece", "pos").alias("head"), F.max_by("piece", "pos").alias("tail"),
                                                F.min("pos").alias("pos"), F.max(begins).alias("start"))
    borders = borders.withColumn("head", F.col("head.tag")).withColumn("tail", F.col("tail.tag"))
    earlier = W.partitionBy("doc").orderBy("part")
    borders = borders.withColumn("above", F.lag("tail").over(earlier))
    # the last start at or before a chunk's end: in it, or at its head, or carried on
    borders = borders.withColumn("start", F.coalesce("start", F.when(~_continues(F.col("head"), F.col("above")), F.col("pos"))))
    carried = borders.select("doc", "part", "above", F.last("start", ignorenulls=True).over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("open"))
    met = marked.join(carried, ["doc", "part"])
    met = met.withColumn("before", F.when(F.col("first"), F.col("above")).otherwise(F.col("before")))
    met = met.withColumn("own", F.when(~_continues(F.col("tag"), F.col("before")), F.col("pos")))
    running = F.last("own", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = met.withColumn("start", F.coalesce(running, "open")).where(F.col("tag").startswith("B-") | F.col("tag").startswith("I-"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col("piece.token").alias("token"))))
    found = runs.groupBy("doc", "start").agg(F.max("pos").alias("stop"), F.min_by("tag", "pos").alias("tag"), ordered.alias("tokens"))
    kind = F.substr("tag", F.lit(3))
    label = lookup(label_map(names), kind) if names else kind
    return found.where(F.col("tag").startswith("B-")).select(
        F.col("doc").alias(doc_col), "start", "stop", F.array_join(F.transform("tokens", lambda t: t["token"]), " ").alias("text"), label.alias("label"))


def merge_subwords_long(subwords: DataFrame, labels: Mapping[int, str], max_length: int | None = None, word_start: str = WORD_START,
                        doc_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """(doc, pos, word, label) of the words of ``merge_subwords`` from one row for each subword: subword, start, end and pred.

    A subword counts by itself, so nothing is carried from row to row and nothing is shuffled.
    """
    pos, empty = F.col(pos_col), (F.col("start") == 0) & (F.col("end") == 0)
    kept = subwords.where(~empty & ((pos == 1) | F.col("subword").startswith(word_start)))
    if max_length is not None:
        kept = kept.where(pos < max_length)
    return kept.select(doc_col, pos_col, F.ltrim("subword", F.lit(word_start)).alias("word"), lookup(label_map(labels), F.col("pred")).alias("label"))


def filter_entities(entities: Column, threshold: float = 0.5, labels: list[str] | None = None) -> Column:
    """Predicted entities at or above a score, with an allowed label."""
    def keep(e: Column) -> Column:
        ok = e["score"] >= threshold
        return ok & e["label"].isin(*labels) if labels is not None else ok

    return F.filter(entities, keep)


def match_entities(df: DataFrame, true_col: str = "true", pred_col: str = "pred", into: str = "matches") -> DataFrame:
    """Greedy one-to-one matching of predicted to true spans.

    Predictions are taken in order; each takes the first free true span with the same
    label and a shared word. ``into`` lists (truth, predicted) pairs with ``None`` for
    a missing side.
    """
    def worded(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["label"].alias("label"), split_words(normalize_text(s["text"])).alias("words")))

    df = computed(df, _t=worded(F.col(true_col)), _p=worded(F.col(pred_col)))
    # the taken index of each prediction, -1 without one
    df = df.withColumn("_taken", _taken("_t.label", "_t.words", "_p.label", "_p.words"))

    def pair(truth: Column, predicted: Column) -> Column:
        return F.struct(truth.alias("truth"), predicted.alias("predicted"))

    none = F.lit("None")
    hits = F.transform("_p", lambda p, i: pair(
        F.when(F.get("_taken", i) >= 0, p["label"]).otherwise(none), p["label"]))
    missed = F.transform(F.array_except(F.transform("_t", lambda t, j: j), F.col("_taken")),
                         lambda j: pair(F.get("_t", j)["label"], none))
    return computed(df, **{into: F.concat(hits, missed)}).drop("_t", "_p", "_taken")


# Spans of a slice of rows that are matched at once: a bound of memory.
SLICE_SPANS = 1 << 14


@F.arrow_udf(ArrayType(IntegerType()))
def _taken(true_labels: pa.Array, true_words: pa.Array, labels: pa.Array, words: pa.Array) -> pa.Array:
    """For each prediction in order the first free true span of its label with a shared word, else -1.

    True spans are listed by label and word, and a taken one leaves its lists when it comes up: the work
    grows with the number of words, not with pairs of spans.
    """
    def match(true_labels, true_words, labels, words):
        if true_labels is None or labels is None:
            return None
        places: dict[tuple, deque] = {}
        for j, (label, own) in enumerate(zip(true_labels, true_words)):
            for word in set(own) if label is not None and own is not None else ():
                places.setdefault((label, word), deque()).append(j)
        used, found = set(), []
        for label, own in zip(labels, words):
            first = -1
            for word in set(own) if label is not None and own is not None else ():
                free = places.get((label, word))
                while free and free[0] in used:
                    free.popleft()
                if free and (first < 0 or free[0] < first):
                    first = free[0]
            used.add(first)
            found.append(first)
        return found

    sides = true_labels, true_words, labels, words
    spans = sum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (true_labels, labels))
    parts = [pa.array([match(*row) for row in zip(*(side.slice(row, end - row).to_pylist() for side in sides))], pa.list_(pa.int32()))
             for row, end in row_slices(spans, SLICE_SPANS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def entity_overlap_scores(df: DataFrame, true_col: str = "true", pred_col: str = "pred") -> DataFrame:
    """Macro precision, recall and F1 over matched pairs, ``None`` counted as a class."""
    pairs = match_entities(df.select(true_col, pred_col), true_col, pred_col).select(F.inline("matches"))
    classes = per_class(pairs, "truth", "predicted")
    return classes.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"))


def extract_qa(sheet: DataFrame, source_col: str = "source", row_col: str = "row_no", id_col: str = "col_b",
               text_col: str = "text", chunk: int = 50_000) -> DataFrame:
    """Question, answer and law of ordered sheet rows, one output row per question.

    Question numbers are a running count per source. The count is taken inside chunks
    of ``chunk`` row numbers and shifted by the questions in earlier chunks, so one
    huge source is spread over many tasks.
    """
    text = clean_cell(F.col(text_col))
    rows = sheet.select(
        F.col(source_col).alias("source"), F.col(row_col).alias("row_no"), F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.floor(F.col(row_col) / chunk).alias("_chunk"))
    kind = (F.when(F.contains("_text", F.lit(QUESTION_MARK)), "q")
            .when(F.contains("_text", F.lit(ANSWER_MARK)), "a")
            .when(F.contains("_text", F.lit(LAW_MARK)), "l"))
    rows = rows.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    asks = (F.col("_kind") == "q").cast("bigint")
    earlier = (rows.groupBy("source", "_chunk").agg(F.sum(asks).alias("_asked"))
               .select("source", "_chunk", F.coalesce(F.sum("_asked").over(
                   W.partitionBy("source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before")))
    inside = rows.withColumn("_seen", F.sum(asks).over(
        W.partitionBy("source", "_chunk").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)))
    numbered = inside.join(earlier, ["source", "_chunk"]).withColumn("item", F.col("_before") + F.col("_seen"))

    def last(kind_name: str, mark: str) -> Column:
        value = strip(F.replace(F.col("_text"), F.lit(mark), F.lit("")))
        return F.max_by(value, F.when(F.col("_kind") == kind_name, F.col("row_no")))

    return numbered.groupBy("source", "item").agg(
        F.max_by("_id", F.when(F.col("_kind") == "q", F.col("row_no"))).cast("bigint").alias("id"),
        last("q", QUESTION_MARK).alias("question"),
        last("a", ANSWER_MARK).alias("answer"),
        last("l", LAW_MARK).alias("law"))


def merge_subwords(subwords: Column, offsets: Column, predictions: Column, labels: Column,
                   max_length: int | None = None, word_start: str = WORD_START) -> Column:
    """One label per word: position 1 and marked subwords count, empty offsets do not.

    ``max_length``, when given, cuts the sequence as a model's input limit does.
    """
    zipped = F.arrays_zip(subwords.alias("subword"), offsets.alias("offset"), predictions.alias("pred"))
    if max_length is not None:
        zipped = F.slice(zipped, 1, max_length)
    kept = F.filter(zipped, lambda s, i: ~((s["offset"]["start"] == 0) & (s["offset"]["end"] == 0))
                    & ((i == 1) | s["subword"].startswith(word_start)))
    return F.transform(kept, lambda s: F.struct(
        F.ltrim(s["subword"], F.lit(word_start)).alias("word"),
        lookup(labels, s["pred"]).alias("label")))
