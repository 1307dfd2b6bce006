"""Quality by co-training of two views of a document: its text, and what is known about it besides.

Each view has its own logistic classifier. In each round both score all unlabelled documents, and the surest
of one become pseudo-labelled examples of the other, if documents that neither has learned from show that its surest ones are
right more often than naming the class blindly would be; a view keeps what it was given only if that makes it
better on these documents. Copies are given once. At the end each view is calibrated on labelled documents that neither
has learned from, and the calibrated views together score every document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import lower_ascii, mixed, over_batches, run_hashes, spaced_words, stored, text_chunks, word_ranges

# Labelled documents that are learned from, at most, of each class: the documented bound of the sample.
SAMPLE = 5000
# Pseudo-labels that each view gives the other in a round, of each class. Their number belongs to the method.
ROUNDS, EXCHANGED = 3, 500
WORD_BUCKETS, NAME_BUCKETS = 48, 32
STATS, SIZES = 12, 24
TEXT_DIM, META_DIM = STATS + WORD_BUCKETS, 2 + SIZES + 3 * NAME_BUCKETS
# What a view must show on documents that neither has learned from before it may give labels of a class: so many more of
# its surest ones are right than the share of the class, as a part of what is missing, even at the lower end of what the count allows.
GAIN, SURENESS = 0.5, 1.64

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>{}[]\\^~=_"]] = 1
_CLASSES = {
    "symbol": _SYMBOLS, "upper": np.array([65 <= b <= 90 for b in range(256)], dtype=np.int64),
    "digit": np.array([48 <= b <= 57 for b in range(256)], dtype=np.int64),
    "mark": np.array([chr(b) in "!?" for b in range(256)], dtype=np.int64),
    "stop": np.array([chr(b) in ".,;:" for b in range(256)], dtype=np.int64),
    "space": np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)], dtype=np.int64),
    "lead": np.array([b & 0xC0 != 0x80 for b in range(256)], dtype=np.int64),
}


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TEXT_DIM numbers for each text: shares of kinds of characters, repetition, and hashed words."""
    rows = len(offsets) - 1
    sums = {name: np.concatenate(([0], np.cumsum(table[data]))) for name, table in _CLASSES.items()}
    count = {name: (s[offsets[1:]] - s[offsets[:-1]]).astype(np.float64) for name, s in sums.items()}
    starts, ends, firsts = spaced_words(data, offsets)
    words = run_hashes(lower_ascii(data), starts, ends)
    lines_starts, lines_ends, lines_firsts = _lines(data, offsets)
    lines = run_hashes(data, lines_starts, lines_ends)
    out = np.zeros((rows, TEXT_DIM))
    n_words = (firsts[1:] - firsts[:-1]).astype(np.float64)
    chars = np.maximum(count["lead"] - count["space"], 1)
    some = np.maximum(n_words, 1)
    for i, name in enumerate(("symbol", "upper", "digit", "mark", "stop")):
        out[:, i] = count[name] / chars
    out[:, 5] = np.log1p(n_words) / 10
    out[:, 6] = chars / some / 10
    out[:, 7] = count["mark"] / some
    bucket = (words % np.uint64(WORD_BUCKETS)).astype(np.int64)
    for r in range(rows):
        own = words[firsts[r]:firsts[r + 1]]
        if not len(own):
            continue
        out[r, 8] = len(np.unique(own)) / len(own)
        pairs = mixed(own[:-1] + mixed(own[1:]))
        out[r, 9] = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0
        whole = lines[lines_firsts[r]:lines_firsts[r + 1]]
        out[r, 10] = 1 - len(np.unique(whole)) / len(whole) if len(whole) else 0
        out[r, 11] = float(len(own) < 50)
        out[r, STATS:] = np.bincount(bucket[firsts[r]:firsts[r + 1]], minlength=WORD_BUCKETS) / len(own)
    return out.astype(np.float32)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_ranges(data != 10, offsets)


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """A row of META_DIM numbers for each document: its length and the class of the length, and hashed names of language, source and both."""
    out = np.zeros((len(langs), META_DIM), np.float32)
    out[:, 0] = [np.log1p(max(0, n or 0)) / 10 for n in sizes]
    out[:, 1] = [n is None for n in sizes]
    rows = np.arange(len(langs))
    out[rows, 2 + np.array([min(max(0, n or 0).bit_length(), SIZES - 1) for n in sizes], dtype=int)] = 1
    both = [f"{lang}\x1f{source}" for lang, source in zip(langs, sources)]
    for column, names in enumerate((langs, sources, both)):
        codes = {name: int.from_bytes(_digest(str(name)), "big") % NAME_BUCKETS for name in set(names)}
        out[rows, 2 + SIZES + column * NAME_BUCKETS + np.array([codes[name] for name in names], dtype=int)] = 1
    return out


def _digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest()


FEATURES = "id bigint, text_view binary, meta_view binary"


def views(docs: DataFrame, id_column: str, text_column: str, lang: str, source: str, size: str) -> DataFrame:
    """(id, text_view, meta_view): both feature rows of every document, as packed floats."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
                       F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(size).cast("bigint").alias("size"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed: list[bytes] = []
        for _, _, data, offsets in text_chunks(batch.column("text")):
            packed += [row.tobytes() for row in text_features(data, offsets)]
        meta = meta_features(*[batch.column(c).to_pylist() for c in ("lang", "source", "size")])
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())],
                                          names=["id", "text_view", "meta_view"])

    return over_batches(rows, run, FEATURES)


@dataclass(frozen=True)
class Linear:
    """A logistic classifier on standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.mean) / self.scale) @ self.weights + self.bias) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a logistic regression with a penalty; the last one is the bias."""
    wide = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(wide.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        gradient = wide.T @ (p - y) + ridge * w
        hessian = (wide * (p * (1 - p))[:, None]).T @ wide + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_linear(x: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic classifier; without examples of both classes it knows their share only."""
    dims = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Linear(np.zeros(dims), np.ones(dims), np.zeros(dims), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    w = _newton((x - mean) / scale, y, 1.0)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def calibrated(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """The model with slope and shift fitted on documents it has not learned from."""
    if not len(y) or y.min() == y.max():
        return model
    w = _newton(model.logits(x)[:, None], y, 1e-3)
    return Linear(model.mean, model.scale, model.weights, model.bias, max(float(w[0]), 1e-3), float(w[1]))


def _unpacked(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    values = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), dims).astype(np.float64)


def trusted_beyond(logits: np.ndarray, y: np.ndarray, label: float, gain: float = GAIN, sureness: float = SURENESS) -> float | None:
    """The logit from which on a view may name documents ``label`` (for the other class: up to which); None if it may not at all.

    Measured on documents that no view has learned from: of those beyond it the lower bound of the share that has the label
    (by the count, after Wilson) must lie above the label's share among all. So a view that tells nothing gives nothing.
    """
    hit = y == label
    share = hit.mean() if len(hit) else 1.0
    order = np.argsort(-logits if label else logits, kind="stable")
    n = np.arange(1, len(order) + 1)
    right = np.cumsum(hit[order]) / n
    z = sureness ** 2 / n
    low = (right + z / 2 - np.sqrt(z * (right * (1 - right) + z / 4))) / (1 + z)
    ends = np.append(logits[order][1:] != logits[order][:-1], True)[:len(order)]  # equal logits come together
    good = np.flatnonzero((low >= share + gain * (1 - share)) & ends)
    return float(logits[order][good[-1]]) if len(good) else None


def _scored(features: DataFrame, text: Linear, meta: Linear) -> DataFrame:
    """(id, text_logit, meta_logit, content) of every row; ``content`` stands for both of its views."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                logits = [pa.array(m.logits(_unpacked(batch, name, dims))) for m, name, dims in
                          ((text, "text_view", TEXT_DIM), (meta, "meta_view", META_DIM))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *logits, batch.column("content")],
                                                 names=["id", "text_logit", "meta_logit", "content"])

    with_content = features.select("id", "text_view", "meta_view", F.xxhash64("text_view", "meta_view").alias("content"))
    return with_content.mapInArrow(run, "id bigint, text_logit double, meta_logit double, content bigint")


def _surest(scored: DataFrame, features: DataFrame, giver: str, taker: str, label: float, beyond: float, exchanged: int,
            given: set[int]) -> list[tuple[int, bytes]]:
    """(content, the taker's view) of the documents beyond a logit, the surest first; each content once, and none that was given before."""
    logit = F.col(f"{giver}_logit")
    sure = scored.where((logit >= max(beyond, 0.0) if label else logit <= min(beyond, 0.0)) & ~F.col("content").isin(list(given)))
    once = sure.groupBy("content").agg(F.min("id").alias("id"), (F.max(logit) if label else F.min(logit)).alias("logit"))
    chosen = once.orderBy(F.desc("logit") if label else F.asc("logit"), "content").limit(exchanged)
    rows = features.join(F.broadcast(chosen), "id").groupBy("content").agg(F.first(f"{taker}_view").alias("view")).sort("content").collect()
    return [(r["content"], r["view"]) for r in rows]


def fold(id_column: str) -> Column:
    """Fold 0 to 4 of an id; 0 is never learned from, 1 calibrates."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def _matrix(rows: list, name: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype=np.float32).reshape(len(rows), dims).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                   source_column: str = "source", size_column: str = "n_chars", label_column: str = "quality", sample: int = SAMPLE,
                   rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> DataFrame:
    """(id, held_out, text_score, meta_score, score, keep) of every row of ``docs``.

    Null texts and null metadata are values of their own. An id with several labels counts as good if one says so; rows
    with a null id are scored but never learned from; other ids are whole numbers. Repeated rows are scored each; equal logits get equal scores,
    and of equally sure documents the one whose content has the smaller hash is given first. Without labels of both classes every
    document gets the same score; an empty table gives an empty result.
    """
    features = stored(views(docs, id_column, text_column, lang_column, source_column, size_column), "quality-views")
    known = (labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).cast("bigint").alias("id")).agg(F.max(label_column).cast("int").alias("y")).withColumn("fold", fold("id")))
    picked = None
    for y in (0, 1):
        part = known.where((F.col("y") == y) & (F.col("fold") != 0)).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    # at most twice ``sample`` ids with a label: small by its bound
    examples = features.join(F.broadcast(picked), "id").dropDuplicates(["id"]).sort("id").collect()
    y = np.array([r["y"] for r in examples], dtype=np.float64)
    learn = np.array([r["fold"] != 1 for r in examples], dtype=bool)
    x = {"text": _matrix(examples, "text_view", TEXT_DIM), "meta": _matrix(examples, "meta_view", META_DIM)}
    more: dict[str, list[tuple[np.ndarray, float]]] = {"text": [], "meta": []}

    aside = ~learn

    def fitted(view: str, extra: list[tuple[np.ndarray, float]]) -> Linear:
        own = x[view][learn], y[learn]
        if extra:
            own = np.concatenate([own[0], np.array([m for m, _ in extra])]), np.concatenate([own[1], np.array([v for _, v in extra])])
        return fit_linear(*own)

    def loss_aside(view: str, model: Linear) -> float:
        z = calibrated(model, x[view][aside], y[aside]).logits(x[view][aside])
        return float(np.logaddexp(0.0, np.where(y[aside] == 1, -z, z)).mean()) if aside.any() else 0.0

    given: set[int] = set()
    unlabelled = features.where("id IS NOT NULL").join(known.select("id"), "id", "left_anti")
    for _ in range(rounds):
        models = {view: fitted(view, more[view]) for view in ("text", "meta")}
        offers = []
        for giver, taker in (("text", "meta"), ("meta", "text")):
            for label in (1.0, 0.0):
                beyond = trusted_beyond(models[giver].logits(x[giver][aside]), y[aside], label)
                if beyond is not None:
                    offers.append((giver, taker, label, beyond))
        if not offers:
            break  # neither view knows anything for the other
        scored = stored(_scored(unlabelled, models["text"], models["meta"]), "quality-round")
        fresh: dict[str, list[tuple[np.ndarray, float]]] = {"text": [], "meta": []}
        for giver, taker, label, beyond in offers:
            rows = _surest(scored, features, giver, taker, label, beyond, exchanged, given)
            fresh[taker] += [(np.frombuffer(view, dtype=np.float32).astype(np.float64), label) for _, view in rows]
            given.update(content for content, _ in rows)
        helped = False
        for taker, rows in fresh.items():  # what makes a view worse on documents it has not learned from is given back
            if rows and loss_aside(taker, fitted(taker, more[taker] + rows)) < loss_aside(taker, models[taker]):
                more[taker] += rows
                helped = True
        if not helped:
            break
    text, meta = (calibrated(fitted(v, more[v]), x[v][aside], y[aside]) for v in ("text", "meta"))
    share = (y[aside].sum() + 1) / (aside.sum() + 2)
    prior = float(np.log(share / (1 - share)))
    both = F.col("text_logit") + F.col("meta_logit") - prior

    def probability(logit: Column) -> Column:
        return 1 / (1 + F.exp(-logit))

    return _scored(features, text, meta).select(
        F.col("id").alias(id_column), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), probability(F.col("text_logit")).alias("text_score"),
        probability(F.col("meta_logit")).alias("meta_score"), probability(both).alias("score"), (both >= 0).alias("keep"))
