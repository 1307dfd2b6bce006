"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of two hashed word vectors and the mean of its hashed character n-gram vectors, so
that words never met still speak through their letters. Two gated recurrent passes over a
window of words, an attention over their states, and one unit give the window's score. A document's score is the
highest of all its overlapping windows. Labels belong to documents, not windows: training
alternates between picking the window that speaks loudest in each labelled document and learning on these windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import id_and_text, run_hashes

# Labelled documents of each class that the network is fitted on, at most: the documented bound of the sample.
SAMPLE = 1500
WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 8, 12, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 13
ROUNDS, BATCH, RATE = 5, 128, 0.01
# Steps of each round, at least.
LEAST_STEPS = 30
# Share of words that a training step leaves out, and the pull of word inputs towards zero.
DROPPED, DECAY = 0.2, 0.02
# Windows that are scored together, and words whose inputs a task remembers; both only bound memory.
BLOCK_WINDOWS = 1024
REMEMBERED = 150_000

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Hashes:
    """Two word buckets of each word, and the buckets of its character n-grams, those of a word side by side."""

    def __init__(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        self.one, self.two, self.sizes, self.grams = one, two, sizes, grams

    def take(self, rows: np.ndarray) -> Hashes:
        ends = np.cumsum(self.sizes)
        sizes = self.sizes[rows]
        first = np.repeat(ends[rows] - sizes - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return Hashes(self.one[rows], self.two[rows], sizes, self.grams[first + np.arange(len(first))])


def hash_words(words: list[str]) -> Hashes:
    """Buckets of words; the n-grams are runs of three and four bytes of the word in angle brackets."""
    if not words:
        none = np.zeros(0, np.int64)
        return Hashes(none, none, none, none)
    data = np.frombuffer(f"<{'><'.join(words)}>".encode(), dtype=np.uint8)
    starts, ends = np.flatnonzero(data == 60), np.flatnonzero(data == 62)  # angle brackets are in no word
    whole = run_hashes(data, starts + 1, ends)
    word = np.repeat(np.arange(len(words)), ends - starts + 1)
    code = data.astype(np.uint64)
    grams, owner = [], []
    for n in (3, 4):
        inside = np.flatnonzero(word[:-(n - 1)] == word[n - 1:])
        value = sum(code[inside + k] << np.uint64(8 * k) for k in range(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((value >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS)
        owner.append(word[inside])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    return Hashes((whole % np.uint64(WORD_BUCKETS)).astype(np.int64), ((whole >> np.uint64(32)) % np.uint64(WORD_BUCKETS)).astype(np.int64),
                  np.bincount(owner, minlength=len(words)), grams[np.argsort(owner, kind="stable")])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    e, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return {
        "word": normal(WORD_BUCKETS, WORD_DIM, scale=0.01), "char": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.02),
        "in_f": normal(e, 3 * h, scale=0.3), "in_b": normal(e, 3 * h, scale=0.3), "bias_f": np.zeros(3 * h, np.float32),
        "bias_b": np.zeros(3 * h, np.float32), "rec_f": normal(h, 3 * h, scale=0.2), "rec_b": normal(h, 3 * h, scale=0.2),
        "att": normal(2 * h, ATTENTION, scale=0.3), "att_v": normal(ATTENTION, scale=0.3), "out": normal(2 * h, scale=0.3),
        "out_bias": np.array([-1.0], np.float32),
    }


class Vocabulary:
    """Words as row numbers; row 0 is padding."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.fresh: list[str] = [""]

    def numbers(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        for word in set(words).difference(rows):
            rows[word] = len(rows)
            self.fresh.append(word)
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def new_hashes(self) -> Hashes:
        """Hashes of the words that came since the last call."""
        found, self.fresh = hash_words(self.fresh), []
        return found


def inputs(p: dict[str, np.ndarray], hashes: Hashes) -> np.ndarray:
    """Input vectors of words."""
    chars = np.zeros((len(hashes.sizes), CHAR_DIM), p["char"].dtype)
    full = hashes.sizes > 0
    if len(hashes.grams):
        starts = np.concatenate(([0], np.cumsum(hashes.sizes)[:-1]))
        chars[full] = np.add.reduceat(p["char"][hashes.grams], starts[full], axis=0) / hashes.sizes[full, None].astype(np.float32)
    return np.concatenate((p["word"][hashes.one] + p["word"][hashes.two], chars), axis=1)


def recurrent(x: np.ndarray, u: np.ndarray, mask: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, hidden) of one gated pass over projected inputs (steps, rows, 3 * hidden)."""
    steps, rows, h3 = x.shape
    n = h3 // 3
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a = h @ u
        gates = sigmoid(x[t, :, :2 * n] + a[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[t, :, 2 * n:] + r * a[:, 2 * n:])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, new, a[:, 2 * n:], m))
        h = h + m * (1 - z) * (new - h)  # a masked step changes nothing
        out[t] = h
    return out


def recurrent_gradient(dout: np.ndarray, u: np.ndarray, kept: list, dx: np.ndarray, du: np.ndarray) -> None:
    """Gradient of ``recurrent``: adds to dx and du."""
    n = u.shape[0]
    carry = np.zeros_like(dout[0])
    for t, h, z, r, new, an, m in reversed(kept):
        d = dout[t] + carry
        seen = d * m
        dnew = seen * (1 - z) * (1 - new * new)
        dz = seen * (h - new) * z * (1 - z)
        dr = dnew * an * r * (1 - r)
        dx[t, :, :n], dx[t, :, n:2 * n], dx[t, :, 2 * n:] = dz, dr, dnew
        da = np.concatenate((dz, dr, dnew * r), axis=1)
        du += h.T @ da
        carry = d - seen * (1 - z) + da @ u.T


def window_logits(p: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows ``ids`` (rows, steps) of numbers of projected words; 0 is padding."""
    turned = np.ascontiguousarray(ids.T)
    mask = (turned > 0).astype(np.float32)
    kf, kb = ([], []) if keep is not None else (None, None)
    f = recurrent(tables[0][turned], p["rec_f"], mask, False, kf)
    b = recurrent(tables[1][turned], p["rec_b"], mask, True, kb)
    states = np.concatenate((f, b), axis=2)
    hidden = np.tanh(states @ p["att"])
    scores = hidden @ p["att_v"] + (mask - 1) * 1e9
    scores -= scores.max(axis=0)
    weights = np.exp(scores) * mask
    weights /= np.maximum(weights.sum(axis=0), 1e-9)
    context = (weights[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep.update(turned=turned, kf=kf, kb=kb, states=states, hidden=hidden, weights=weights, context=context)
    return context @ p["out"] + p["out_bias"][0]


def project(p: dict[str, np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vectors @ p["in_f"] + p["bias_f"], vectors @ p["in_b"] + p["bias_b"]


def gradients(p: dict[str, np.ndarray], hashes: Hashes, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted logistic loss of windows, and its gradient by each parameter."""
    vectors = inputs(p, hashes)
    kept: dict = {}
    logits = window_logits(p, project(p, vectors), ids, kept)
    prob = sigmoid(logits)
    loss = float(np.mean(weight * (np.logaddexp(0, logits) - target * logits)))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dlogit = (weight * (prob - target) / len(target)).astype(np.float32)
    g["out_bias"][0] = dlogit.sum()
    g["out"] = kept["context"].T @ dlogit
    dcontext = dlogit[:, None] * p["out"]
    states, weights, hidden = kept["states"], kept["weights"], kept["hidden"]
    dstates = weights[:, :, None] * dcontext
    dweights = (states * dcontext).sum(axis=2)
    dscores = weights * (dweights - (weights * dweights).sum(axis=0))
    g["att_v"] = np.tensordot(dscores, hidden, axes=([0, 1], [0, 1]))
    dhidden = dscores[:, :, None] * p["att_v"] * (1 - hidden * hidden)
    g["att"] = np.tensordot(states, dhidden, axes=([0, 1], [0, 1]))
    dstates += dhidden @ p["att"].T
    n = HIDDEN
    dvectors = np.zeros_like(vectors)
    flat = kept["turned"].ravel()
    order = np.argsort(flat, kind="stable")
    rows, starts = np.unique(flat[order], return_index=True)
    for side, keep_side, part in (("f", "kf", slice(0, n)), ("b", "kb", slice(n, 2 * n))):
        dx = np.zeros((*kept["turned"].shape, 3 * n), np.float32)
        recurrent_gradient(np.ascontiguousarray(dstates[:, :, part]), p[f"rec_{side}"], kept[keep_side], dx, g[f"rec_{side}"])
        dtable = np.zeros((len(vectors), 3 * n), np.float32)
        dtable[rows] = np.add.reduceat(dx.reshape(-1, 3 * n)[order], starts, axis=0)
        g[f"bias_{side}"] = dtable.sum(axis=0)
        g[f"in_{side}"] = vectors.T @ dtable
        dvectors += dtable @ p[f"in_{side}"].T
    np.add.at(g["word"], hashes.one, dvectors[:, :WORD_DIM])
    np.add.at(g["word"], hashes.two, dvectors[:, :WORD_DIM])
    each = dvectors[:, WORD_DIM:] / np.maximum(hashes.sizes, 1).astype(np.float32)[:, None]
    np.add.at(g["char"], hashes.grams, np.repeat(each, hashes.sizes, axis=0))
    return loss, g


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """All overlapping windows of a document's words, the last one padded; none without words."""
    n = len(numbers)
    if not n:
        return np.zeros((0, WINDOW), np.int32)
    count = 1 + max(0, -(-(n - WINDOW) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
    padded[:n] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network on labelled documents."""
    p = start_parameters(seed)
    vocabulary = Vocabulary()
    windows, owners = [], []
    for i, text in enumerate(texts):
        found = windows_of(vocabulary.numbers(words_of(text)))
        windows.append(found)
        owners.append(np.full(len(found), i))
    ids, owner = np.concatenate(windows or [np.zeros((0, WINDOW), np.int32)]), np.concatenate(owners or [np.zeros(0, int)])
    hashes = vocabulary.new_hashes()
    target = np.array(labels, np.float32)
    if not len(ids) or target.min() == target.max():  # nothing to tell apart
        return p
    heavier = np.float32(np.clip((target == 0).sum() / target.sum(), 1, 3))  # the rarer class speaks up
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    negative = np.flatnonzero(target[owner] == 0)
    loud = _word_odds(ids, owner, target, len(vocabulary.rows))[ids].max(axis=1)
    for turn in range(rounds):
        logits = score_ids(p, project(p, inputs(p, hashes)), ids) if turn else loud
        best = np.lexsort((-logits, owner))
        best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
        # every window of a clean document is clean; toxic documents are sure of one window only
        room = max(len(best), LEAST_STEPS * BATCH - 2 * len(best))
        chosen = np.concatenate((best, best, rng.permutation(negative)[:room]))
        shuffled = rng.permutation(chosen)
        for at in range(0, len(shuffled), BATCH):
            part = shuffled[at:at + BATCH]
            thinned = np.where(rng.random((len(part), WINDOW)) < DROPPED, 0, ids[part])
            used, local = np.unique(np.concatenate(([0], thinned.ravel())), return_inverse=True)
            y = target[owner[part]]
            _, g = gradients(p, hashes.take(used), local[1:].reshape(thinned.shape), y, np.where(y > 0, heavier, np.float32(1)))
            step += 1
            for k, v in p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= (RATE * m / (1 - 0.9 ** step) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                if k in ("word", "char"):
                    v *= 1 - RATE * DECAY
    return p


def _word_odds(ids: np.ndarray, owner: np.ndarray, target: np.ndarray, rows: int) -> np.ndarray:
    """Log odds of words between toxic and clean documents, by how many of each hold them: a first guess at loud windows."""
    pairs = np.unique(np.stack((np.repeat(owner, ids.shape[1]), ids.ravel())), axis=1)
    toxic = np.bincount(pairs[1], weights=target[pairs[0]], minlength=rows)
    clean = np.bincount(pairs[1], minlength=rows) - toxic
    odds = np.log((toxic + 0.5) / (target.sum() + 1)) - np.log((clean + 0.5) / ((target == 0).sum() + 1))
    odds[0] = -1e9  # padding
    return odds


def score_ids(p: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, np.float32)
    return np.concatenate([window_logits(p, tables, ids[i:i + BLOCK_WINDOWS]) for i in range(0, len(ids), BLOCK_WINDOWS)])


def calibrated(p: dict[str, np.ndarray], texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    """The network with the line that turns document logits into log odds, fitted on documents it has not learned from."""
    y = np.array(labels, np.float64)
    line = np.array([1.0, 0.0])
    if len(y) and 0 < y.sum() < len(y):
        x = np.stack((np.array(Scorer(p).logits(texts)), np.ones(len(y))), axis=1)
        for _ in range(30):
            q = sigmoid(np.clip(x @ line, -30, 30))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0.5, 0.05]), x.T @ (q - y) + [0.5 * (line[0] - 1), 0.05 * line[1]])
            line = line - np.clip(step, -1, 1)
        line[0] = max(line[0], 0.05)
    return p | {"line": line}


class Scorer:
    """Scores documents; remembers the projected inputs of the words it has met."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self._fresh()

    def _fresh(self) -> None:
        self.vocabulary = Vocabulary()
        self.done = 0
        self.tables = tuple(np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in range(2))

    def _project_new(self) -> None:
        n = len(self.vocabulary.rows)
        if n > len(self.tables[0]):
            self.tables = tuple(np.concatenate((t, np.zeros((max(n, 2 * len(t)) - len(t), t.shape[1]), np.float32))) for t in self.tables)
        hashes = self.vocabulary.new_hashes()
        for at in range(0, n - self.done, 1 << 14):
            rows = np.arange(at, min(n - self.done, at + (1 << 14)))
            for table, found in zip(self.tables, project(self.p, inputs(self.p, hashes.take(rows)))):
                table[self.done + rows] = found
        self.done = n

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that each document is toxic."""
        slope, shift = self.p.get("line", (1.0, 0.0))
        return sigmoid(np.clip(slope * self.logits(texts) + shift, -50, 50))

    def logits(self, texts: list[str]) -> np.ndarray:
        """Logit of each document's most toxic window; without words the network's bare bias."""
        if len(self.vocabulary.rows) > REMEMBERED:
            self._fresh()
        out = np.full(len(texts), float(self.p["out_bias"][0]))
        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                self._project_new()
                ids, owner = np.concatenate(waiting), np.concatenate(owners)
                logits = score_ids(self.p, self.tables, ids)
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[owner[first]] = np.maximum.reduceat(logits, first)
                waiting.clear()
                owners.clear()
                size = 0

        for i, text in enumerate(texts):
            found = windows_of(self.vocabulary.numbers(words_of(text)))
            if len(found):
                waiting.append(found)
                owners.append(np.full(len(found), i))
                size += len(found)
            if size >= 4 * BLOCK_WINDOWS:
                flush()
        flush()
        return out


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str,
                    sample: int) -> list[tuple[str, int, bool]]:
    """(text, label, set aside) of at most ``sample`` documents of each class, first by a hash of the id.

    Held-out rows are left out; the next fifth of the ids is set aside for calibration. An id with
    several labels counts as toxic if one of them is.
    """
    known = (labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
             .groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("y")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    # at most twice ``sample`` rows of an id and a label: small by its bound
    rows = id_and_text(docs, id_column, text_column).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max("text").alias("text")).sort("id")
    found = rows.select("text", "y", (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1).alias("aside")).collect()
    return [(r["text"], r["y"], r["aside"]) for r in found]


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
             sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Only the text goes into a score. Null and empty texts get the score of no words. Without labels
    of both classes the network stays as it starts. Repeated rows are scored each; an empty table gives an empty result.
    """
    rows = labelled_sample(docs, labels, id_column, text_column, label_column, sample)
    learned, aside = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    p = train([r[0] for r in learned], [r[1] for r in learned], rounds=rounds)
    p = calibrated(p, [r[0] for r in aside], [r[1] for r in aside])
    rows = id_and_text(docs, id_column, text_column)
    shipped = rows.sparkSession.sparkContext.broadcast(p)  # a fixed size, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = rows.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_column), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
