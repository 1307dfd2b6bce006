"""Personal data: exact base patterns, and bootstrapped contexts that find further identifiers.

Base matches are the seeds, and so are long random hexadecimal strings. Every token that looks like an identifier and the words around it
make a graph of patterns (contexts) and instances (identifiers). Spark scores the graph in rounds, both ways and by degrees:
a pattern is as sure as the mean sureness of its distinct instances in the whole corpus, less the fewer they are; an instance is
as sure as all its patterns together make it, each of them damped. After the last round the patterns that are sure
enough are applied to all texts, so identifiers that no base pattern knows are found by their context.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loometric.llm.common import id_and_text, over_batches, stored

KINDS = ("email", "ip", "card", "phone")
# The kind of spans that contexts alone have found.
FOUND = "id"

ROUNDS = 3
# A pattern is applied from this score on, if its instances add up to so many sure ones. A pattern's word on an instance counts by the damping.
TRUST, LEAST_INSTANCES, DAMPING = 0.5, 3, 0.85
# Hexadecimal strings of so many characters, letters and digits among them, are seeds.
SECRET_LENGTH = 32
# What one task receives at most of the trusted patterns; more patterns take more passes over the texts.
BLOCK_PATTERNS = 200_000
# Instances of one pattern are counted in so many parts first.
SALTS = 32

# The base patterns (fixed values). Possessive repeats and the look-behind only keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Identifier-like tokens: of the characters of identifiers, with a digit or an at-sign; see `shaped`.
_TOKEN = re.compile(r"[A-Za-z0-9@._%+:/-]+")
_WORD = re.compile(r"\w+|[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]{3}")
# A key before a value: a word, and marks of which one names, assigns or quotes.
_KEY = re.compile(r"([^\W\d_]{3,})\W{0,3}([=:#\"'(<])\W{0,3}$")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SIDE_CHARS = 40


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an at-sign with a local part before it and a domain behind it."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        size = len(head) - len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        if domain:
            found.append((at - size, domain.end()))
        # no local part holds an at-sign
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base matches of each kind, leftmost and non-overlapping; matches that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text) is None:
        return found
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def shaped(token: str) -> bool:
    """Whether a token may be an identifier: six characters or more, four of them digits, or an at-sign inside."""
    return len(token) >= 6 and (sum("0" <= c <= "9" for c in token) >= 4 or "@" in token[1:-1])


def secret_like(token: str) -> bool:
    """Whether a token is a long random string, a seed beside the base matches."""
    return len(token) >= SECRET_LENGTH and _HEX.fullmatch(token) is not None and not token.isdigit() and not token.isalpha()


def shape(token: str) -> str:
    """The kind of a token's characters."""
    if "@" in token:
        return "a"
    if len(token) >= 16 and _HEX.fullmatch(token) and not token.isdigit():
        return "x"
    return "m" if any(c.isalpha() for c in token) else "d"


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns around a place: two words before it; one word before and one behind it; a key before it, with the kind of the token.

    Words are lower-cased and digits in them are one sign, so a pattern is no identifier itself. A pattern has a word of three letters
    or more: marks and short words alone say nothing.
    """
    head = text[max(0, start - _SIDE_CHARS):start]
    before = [_generic(w) for w in _WORD.findall(head)[-2:]]
    after = [_generic(w) for w in _WORD.findall(text[end:end + _SIDE_CHARS])[:1]]
    found = []
    if len(before) == 2 and _LETTERS.search(f"{before[0]} {before[1]}"):
        found.append(f"{before[0]} {before[1]} *")
    if before and after and _LETTERS.search(f"{before[-1]} {after[0]}"):
        found.append(f"{before[-1]} * {after[0]}")
    key = _KEY.search(head)
    if key:
        found.append(f"{key[1].lower()} {key[2]} *{shape(text[start:end])}")
    return found


def _generic(word: str) -> str:
    return re.sub(r"\d+", "0", word.lower())


def places(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, known) of every identifier-like token, and of every base match as known."""
    if _DIGIT.search(text) is None and "@" not in text:
        return
    taken = sorted(span for spans in base_spans(text).values() for span in spans)
    for start, end in taken:
        yield start, end, True
    i = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".:/%+-":
            end -= 1
        if not shaped(text[start:end]):
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        yield start, end, False


def sightings(texts: DataFrame) -> DataFrame:
    """(pattern, instance, known): every context of every identifier-like token. An instance is a hash of the token."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns, instances, known = [], [], []
        for text in batch.column("text").to_pylist():
            for start, end, sure in places(text):
                instance = int.from_bytes(hashlib.blake2b(text[start:end].encode(), digest_size=8).digest(), "big", signed=True)
                seed = secret_like(text[start:end])
                for pattern in contexts(text, start, end):
                    patterns.append(pattern)
                    instances.append(instance)
                    known.append(sure or seed)
        return pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array(instances, pa.int64()), pa.array(known, pa.bool_())],
                                          names=["pattern", "instance", "known"])

    return over_batches(texts.select("text"), run, "pattern string, instance bigint, known boolean")


def pattern_scores(graph: DataFrame) -> DataFrame:
    """(pattern, sure, score) from (pattern, instance, sureness). A pattern of very many instances is summed in parts.

    The mean sureness, with one unknown instance more, times a factor that rises with the number of sure ones.
    """
    parts = graph.groupBy("pattern", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sureness").alias("s"))
    totals = parts.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    score = F.col("s") / (F.col("n") + 1) * (1 - 1 / (1 + F.log2(1 + F.col("s"))))
    return totals.where("s > 0").select("pattern", F.col("s").alias("sure"), score.alias("score"))


def _meeting(graph: DataFrame, scored: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``graph`` with the one row of each key in ``scored``.

    Both sides are shuffled at every size, without copies of ``scored``: it grows with the corpus, so the driver never collects it
    for a broadcast. The side of a key of very many rows is the graph's, which adaptive execution splits.
    """
    return graph.join(scored.hint("merge"), key, how)


def instance_scores(graph: DataFrame, scores: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(instance, believed): an instance is not one only if all its patterns are wrong about it."""
    rows = _meeting(graph, scores.select("pattern", "score"), "pattern")
    return rows.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-damping * F.col("score"))))).alias("believed"))


def bootstrap(docs: DataFrame, text_column: str = "text", seeds: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score): the contexts that are sure enough after the last round.

    Only contexts of identifier-like tokens travel, never texts. The seeds are the base matches and long random strings. Seeds stay sure.
    Without any there are no patterns.
    """
    texts = id_and_text(docs, text_column, text_column).select("text")
    graph = stored(sightings(texts).groupBy("pattern", "instance").agg(F.max("known").alias("known")), "pii-graph")
    if seeds is not None:
        graph = graph.withColumn("known", F.col("known") | seeds)
    scores = stored(pattern_scores(graph.withColumn("sureness", F.col("known").cast("double"))), "pii-patterns")
    for _ in range(rounds - 1):
        # written, so that the join below shuffles both of its sides itself and can split an instance of very many contexts
        believed = stored(instance_scores(graph.where("NOT known"), scores), "pii-instances")
        sureness = F.when(F.col("known"), 1.0).otherwise(F.coalesce("believed", F.lit(0.0)))
        rows = _meeting(graph, believed, "instance", "left").select("pattern", "instance", sureness.alias("sureness"))
        scores = stored(pattern_scores(rows), "pii-patterns")
    return scores.where((F.col("sure") >= LEAST_INSTANCES) & (F.col("score") >= TRUST)).select("pattern", "score")


def _blocks(patterns: DataFrame, block: int) -> Iterator[frozenset[str]]:
    """The trusted patterns in blocks of checked size."""
    total = patterns.count()
    n = max(1, -(-total // block))
    for i in range(n):
        yield frozenset(r[0] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).select("pattern").collect()) if total else frozenset()


def found_spans(text: str, patterns: frozenset[str]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside base matches that a trusted pattern surrounds."""
    if not patterns:
        return []
    return [(a, b) for a, b, known in places(text) if not known and not patterns.isdisjoint(contexts(text, a, b))]


def all_spans(text: str, patterns: frozenset[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end): base spans by kind as listed and start, then those found by context."""
    base = base_spans(text)
    return [(k, a, b) for k in KINDS for a, b in base[k]] + [(FOUND, a, b) for a, b in found_spans(text, patterns)]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, patterns: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """(id, base, found) of every row: base spans by kind and start, and the spans that contexts found.

    A null or empty text has no spans. Rows are read one by one: repeated rows give equal rows, and an
    empty table an empty result. Start and end are code points, the end exclusive.
    """
    rows = id_and_text(docs, id_column, text_column)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(block: frozenset[str]):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, found = [], []
            for text in batch.column("text").to_pylist():
                spans = all_spans(text, block)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans if k != FOUND])
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans if k == FOUND])
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(base, kinds), pa.array(found, kinds)],
                                              names=["id", "text", "base", "more"])

        return run

    schema = f"id {docs.schema[id_column].dataType.simpleString()}, text string, base {SPANS}, more {SPANS}"
    result = None
    for block in _blocks(patterns, block_patterns):
        if result is None:
            result = over_batches(rows, scan(block), schema)
        else:  # further blocks of patterns add to what earlier ones have found
            rows = result.withColumnRenamed("more", "earlier").withColumnRenamed("base", "base_before")
            again = over_batches(rows, _adding(block, kinds), schema)
            result = again
    return result.select(F.col("id").alias(id_column), "base", F.col("more").alias("found"))


def _adding(block: frozenset[str], kinds: pa.DataType):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        more = []
        for text, earlier in zip(batch.column("text").to_pylist(), batch.column("earlier").to_pylist()):
            spans = {(s["start"], s["end"]) for s in earlier} | set(found_spans(text, block))
            more.append([{"kind": FOUND, "start": a, "end": b} for a, b in sorted(spans)])
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), batch.column("base_before"), pa.array(more, kinds)],
                                          names=["id", "text", "base", "more"])

    return run


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``with_spans`` by the patterns that the same documents give."""
    return with_spans(docs, bootstrap(docs, text_column), id_column, text_column)


def redacted_text(text: str, found: list[tuple[int, int]]) -> str:
    """The text with each base or found span, or run of overlapping spans, replaced by the kind of its first in square brackets."""
    base = base_spans(text)
    spans = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, FOUND) for a, b in found])
    out, place = [], 0
    for start, end, kind in spans:
        if start >= place:
            out += [text[place:start], f"[{kind.upper()}]"]
        place = max(place, end)
    return "".join(out) + text[place:]


def redacted(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars",
             block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in their texts; null texts stay null. Texts pass no shuffle.

    Every block of patterns reads the given text; what all of them find is replaced at once by the last.
    """
    mark = f"found_{uuid.uuid4().hex}"
    pairs = pa.list_(pa.list_(pa.int32()))
    wider = StructType([*docs.schema.fields, StructField(mark, ArrayType(ArrayType(IntegerType())))])

    def scan(block: frozenset[str], earlier: bool, last: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.get_field_index(text_column)
            texts = batch.column(i).to_pylist()
            before = batch.column(mark).to_pylist() if earlier else [()] * len(texts)
            found = [sorted({(a, b) for a, b in spans} | set(found_spans(t or "", block))) for t, spans in zip(texts, before)]
            if earlier:
                batch = batch.drop_columns([mark])
            if not last:
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pairs)], names=[*batch.schema.names, mark])
            clean = [None if t is None else redacted_text(t, spans) for t, spans in zip(texts, found)]
            return batch.set_column(i, batch.schema.field(i), pa.array(clean, batch.schema.field(i).type))

        return run

    given, earlier = docs.schema, False
    blocks = _blocks(bootstrap(docs, text_column), block_patterns)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        docs = over_batches(docs, scan(block, earlier, following is None), given if following is None else wider)
        block, earlier = following, True
    if length_column in docs.columns:
        docs = docs.withColumn(length_column, F.length(text_column).cast(docs.schema[length_column].dataType))
    return docs


def joined_spans(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
