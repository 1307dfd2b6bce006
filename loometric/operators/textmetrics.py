"""Overlap scores between generated and expected texts.

A pair of texts is one row, so n-gram overlaps and longest common subsequences are
found inside the row: nothing but per-pair counts is ever shuffled. Only the subsequences of very
long pairs are spread over tasks, as tiles that exchange their borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from loometric.fixed import SMALLEST_NORMAL
from loometric.functions.stage import computed, row_slices
from loometric.functions.text import split_words
from loometric.session import shared_folder

# Words of a slice of pairs that are matched at once, of the rows of one block, and of a side of a tile: bounds of memory.
SLICE_WORDS = 1 << 19
BLOCK_BITS = 4096
TILE_WORDS = 1 << 16

VECTOR_BLOCK = 512
BLOCK_SALTS = 16


def rouge_words(text: Column, unicode: bool = False) -> Column:
    """Lower-case words of letters and digits: ASCII ones, or any script when ``unicode``."""
    inner = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.array_remove(F.split(F.lower(text), inner), "")


def clipped_matches(words: np.ndarray, texts: np.ndarray, pairs: int, orders: range) -> dict[int, np.ndarray]:
    """For each order the number of n-grams that both texts of a pair have, each counted as often as in the text with fewer.

    ``words`` are numbers, ``texts`` says of each word whose it is: text t < ``pairs`` is the candidate of pair t,
    text ``pairs`` + t its reference. A run of n + 1 words is the rank of its first n and the rank of its last word, so no
    run is ever spelled out; runs whose beginning is not in both texts can't match and are left out.
    """
    found, at = {}, np.arange(len(words))
    single = np.unique((texts % max(pairs, 1)) * (int(words.max(initial=0)) + 1) + words, return_inverse=True)[1]
    many, ranks = int(single.max(initial=0)) + 1, single
    for n in orders:
        if n > 1:  # ranks holds, for the places ``at``, the rank of the run of n - 1 words
            inside = at + n - 1 < len(words)
            at, ranks = at[inside], ranks[inside]
            inside = texts[at] == texts[at + n - 1]
            at, ranks = at[inside], ranks[inside]
            ranks = np.unique(ranks * many + single[at + n - 1], return_inverse=True)[1]
        kinds, owners = int(ranks.max(initial=-1)) + 1, texts[at]
        in_candidate = owners < pairs
        both = np.minimum(np.bincount(ranks[in_candidate], minlength=kinds), np.bincount(ranks[~in_candidate], minlength=kinds))
        pair_of = np.zeros(kinds, dtype=np.int64)
        pair_of[ranks] = owners % max(pairs, 1)
        found[n] = np.bincount(pair_of, weights=both, minlength=pairs).astype(np.int64)
        matched = both[ranks] > 0
        at, ranks = at[matched], ranks[matched]
    return found


def _lengths(words: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _overlaps(orders: range):
    """An Arrow function of two word arrays: the clipped matches of each order, null where a text is."""
    @F.arrow_udf(StructType([StructField(f"o{n}", LongType()) for n in orders]))
    def overlaps(candidate: pa.Array, reference: pa.Array) -> pa.Array:
        parts = {n: [np.empty(0, dtype=np.int64)] for n in orders}
        for row, end in row_slices(_lengths(candidate) + _lengths(reference), SLICE_WORDS):
            sides = [side.slice(row, end - row) for side in (candidate, reference)]
            texts = np.repeat(np.arange(2 * (end - row)), np.concatenate([_lengths(side) for side in sides]))
            words = pa.concat_arrays([side.flatten() for side in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
            for n, counts in clipped_matches(words, texts, end - row, orders).items():
                parts[n].append(counts)
        missing = pc.or_(pc.is_null(candidate), pc.is_null(reference))
        return pa.StructArray.from_arrays([pc.if_else(missing, None, pa.array(np.concatenate(parts[n]))) for n in orders], [f"o{n}" for n in orders])

    return overlaps


def _with_overlaps(pairs: DataFrame, candidate: Column, reference: Column, orders: range) -> DataFrame:
    """Adds ``_c{n}``, ``_r{n}`` (numbers of n-grams) and ``_o{n}`` (clipped matches)."""
    df = computed(pairs, _cw=candidate, _rw=reference).withColumn("_o", _overlaps(orders)("_cw", "_rw"))
    return df.select(*pairs.columns, *[F.greatest(F.size(f"_{side}w") - (n - 1), F.lit(0)).alias(f"_{side}{n}") for n in orders for side in "cr"],
                     *[F.col(f"_o.o{n}").alias(f"_o{n}") for n in orders])


def common_words(candidate: Column | str, reference: Column | str) -> Column:
    """How many words two word arrays share, each counted as often as in the array with fewer."""
    return _overlaps(range(1, 2))(candidate, reference)["o1"]


def _f_measure(overlap: Column, candidate: Column, reference: Column) -> Column:
    # 2PR / (P + R) with P = o/c and R = o/r
    return F.when(overlap > 0, 2.0 * overlap / (candidate + reference)).otherwise(F.lit(0.0))


def rouge_n_pairs(pairs: DataFrame, candidate_col: str, reference_col: str, unicode: bool = False) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F per pair (``rouge1``, ``rouge2``)."""
    df = _with_overlaps(pairs, rouge_words(F.col(candidate_col), unicode),
                        rouge_words(F.col(reference_col), unicode), range(1, 3))
    return df.withColumns({f"rouge{n}": _f_measure(F.col(f"_o{n}"), F.col(f"_c{n}"), F.col(f"_r{n}"))
                           for n in (1, 2)}).drop("_c1", "_r1", "_o1", "_c2", "_r2", "_o2")


def subsequence_bits(rows: list, columns: list, state: bytes | None = None, carries: bytes | None = None,
                     block: int = BLOCK_BITS) -> tuple[bytes, bytes]:
    """One tile of the table of longest common subsequences, as its border.

    Bit i of the state is 0 where the table grows from row i to the next in the column reached so far; the carries say for each
    column what the addition of the rows above hands down. Rows are worked off in blocks of fixed size, each over all columns, and only the
    carries pass from block to block, so the memory is linear in both texts. Without borders the tile lies at the edge.
    """
    size, carries = len(rows), bytearray(carries if carries is not None else len(columns))
    given = int.from_bytes(state, "little") if state is not None else (1 << size) - 1
    done = 0
    for at in range(0, size, block):
        part = rows[at:at + block]
        places: dict = {}
        for i, word in enumerate(part):
            places[word] = places.get(word, 0) | 1 << i
        width = len(part)
        full = (1 << width) - 1
        bits, seen = given >> at & full, places.get
        for j, word in enumerate(columns):
            here = seen(word)
            if here is None:
                if carries[j]:
                    total = bits + 1
                    carries[j] = total >> width
                    bits |= total & full
                continue
            hits = bits & here
            total = bits + hits + carries[j]
            carries[j] = total >> width
            bits = (total & full) | (bits ^ hits)
        done |= bits << at
    return done.to_bytes((size + 7) // 8, "little"), bytes(carries)


def _closed(state: bytes, size: int) -> int:
    """How often the table grows along a tile's last column."""
    return size - int.from_bytes(state, "little").bit_count()


def _shared_numbers(left: pa.Array, right: pa.Array) -> Iterator[tuple[list, list] | None]:
    """Of each pair of word arrays the words that both have, as numbers; what only one has is in no common subsequence."""
    missing = pc.or_(pc.is_null(left), pc.is_null(right)).to_pylist()
    for row, end in row_slices(_lengths(left) + _lengths(right), SLICE_WORDS):
        sides = [side.slice(row, end - row) for side in (left, right)]
        lengths = [_lengths(side) for side in sides]
        encoded = pa.concat_arrays([side.flatten() for side in sides]).dictionary_encode(null_encoding="encode")
        words, kinds = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
        cut = int(lengths[0].sum())
        owners = [np.repeat(np.arange(end - row), n) for n in lengths]
        marks = [owner * kinds + part for owner, part in zip(owners, (words[:cut], words[cut:]))]
        kept = [np.isin(mine, other) for mine, other in (marks, marks[::-1])]
        parts = [(part[keep].tolist(), np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=end - row))]).tolist())
                 for part, owner, keep in zip((words[:cut], words[cut:]), owners, kept)]
        for k in range(end - row):
            yield None if missing[row + k] else tuple(part[at[k]:at[k + 1]] for part, at in parts)


def _subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) > BLOCK_BITS:
        return _closed(subsequence_bits(a, b)[0], len(a))
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    bits = full = (1 << len(a)) - 1
    for here in map(places.get, b):
        if here is not None:
            hits = bits & here
            bits = (bits + hits & full) | (bits ^ hits)
    return len(a) - bits.bit_count()


@F.arrow_udf(IntegerType())
def common_subsequence(left: pa.Array, right: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two word arrays; null where one is."""
    return pa.array([None if pair is None else _subsequence(*pair) for pair in _shared_numbers(left, right)], pa.int32())


@F.arrow_udf(StructType([StructField(name, ArrayType(IntegerType())) for name in ("rows", "columns")]))
def _numbered(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = [([], []) if pair is None else pair for pair in _shared_numbers(left, right)]
    return pa.StructArray.from_arrays([pa.array([pair[k] for pair in pairs], pa.list_(pa.int32())) for k in range(2)], ["rows", "columns"])


def tiled_subsequences(pairs: DataFrame, key_col: str, left_col: str, right_col: str, tile_words: int = TILE_WORDS) -> DataFrame:
    """(key, lcs): the longest common subsequences of pairs of word arrays that are too long for one task.

    The table of a pair is cut into tiles. Tiles of one diagonal don't need each other, so each round of the loop works on a diagonal of
    all pairs, with the borders of the one before: a bit for each row, a byte for each column. Words that only one text has are left out, the others
    are numbers, and a part of a text is shuffled only in rounds in which it has a tile, once for each. ``key_col`` is unique.
    """
    spark = pairs.sparkSession
    numbered = computed(pairs.select(F.col(key_col).alias("key"), F.col(left_col).alias("left"), F.col(right_col).alias("right")),
                        n=_numbered("left", "right")).select("key", "n.rows", "n.columns")

    def cut(side: str, other: str) -> Column:
        def count(name: str) -> Column:
            return F.ceil(F.size(name) / tile_words).cast("int")

        starts = F.when(F.size(side) > 0, F.sequence(F.lit(0), count(side) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(
            F.lit(side).alias("side"), k.alias("part"), count(other).alias("others"),
            F.slice(side, k * tile_words + 1, F.lit(tile_words)).alias("words")))

    path = shared_folder(spark, "lcs-parts")
    numbered.select("key", F.inline(F.concat(cut("rows", "columns"), cut("columns", "rows")))).write.parquet(path)
    parts = spark.read.parquet(path)
    rounds = parts.where("side = 'rows'").agg(F.max(F.col("part") + F.col("others"))).first()[0] or 0

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.slice(k, 1)
                a, b = (tile.column(name).flatten().to_pylist() for name in ("row_words", "column_words"))
                state, carries = subsequence_bits(a, b, tile.column("state")[0].as_py(), tile.column("carries")[0].as_py())
                i, diagonal, others = (tile.column(name)[0].as_py() for name in ("i", "diagonal", "others"))
                ended = _closed(state, len(a)) if diagonal - i == others - 1 else None
                yield pa.RecordBatch.from_arrays(
                    [tile.column("key"), tile.column("i"), pa.array([state], pa.binary()), pa.array([carries], pa.binary()),
                     pa.array([ended], pa.int64())], names=["key", "i", "state", "carries", "closed"])

    schema = StructType([StructField("key", pairs.schema[key_col].dataType), StructField("i", IntegerType()),
                         StructField("state", BinaryType()), StructField("carries", BinaryType()), StructField("closed", LongType())])
    before, paths = spark.createDataFrame([], schema), []
    for diagonal in range(rounds):
        # a pair has one tile in a row of tiles on a diagonal, so all that a tile needs meets by pair and row
        here = parts.where((F.col("part") <= diagonal) & (F.col("part") + F.col("others") > diagonal))
        rows = here.where("side = 'rows'").select("key", F.col("part").alias("i"), "others", F.col("words").alias("row_words"))
        columns = here.where("side = 'columns'").select("key", (F.lit(diagonal) - F.col("part")).alias("i"), F.col("words").alias("column_words"))
        met = (rows.join(columns, ["key", "i"]).join(before.select("key", "i", "state"), ["key", "i"], "left")
               .join(before.select("key", (F.col("i") + 1).alias("i"), "carries"), ["key", "i"], "left"))
        paths.append(shared_folder(spark, "lcs-diagonal"))
        met.select("key", "i", F.lit(diagonal).alias("diagonal"), "others", "row_words", "column_words", "state", "carries").mapInArrow(
            tiles, schema).write.parquet(paths[-1])
        before = spark.read.schema(schema).parquet(paths[-1])
    done = spark.read.schema(schema).parquet(*paths) if paths else before
    ended = done.groupBy("key").agg(F.sum("closed").alias("lcs"))
    keys = pairs.select(F.col(key_col).alias("key")).join(ended, "key", "left")
    return keys.select(F.col("key").alias(key_col), F.coalesce("lcs", F.lit(0)).cast("int").alias("lcs"))


def rouge_l_pairs(pairs: DataFrame, candidate_col: str, reference_col: str, unicode: bool = False, key_col: str | None = None,
                  tile_words: int = TILE_WORDS) -> DataFrame:
    """ROUGE-L F per pair (``rougeL``).

    A pair is worked on in its row. With a unique ``key_col``, pairs with a text of more than ``tile_words`` words are spread over tasks as tiles.
    """
    def worded(rows: DataFrame) -> DataFrame:
        return computed(rows, _cw=rouge_words(F.col(candidate_col), unicode), _rw=rouge_words(F.col(reference_col), unicode))

    def scored(lengths: DataFrame) -> DataFrame:
        return computed(lengths, rougeL=_f_measure(F.col("_lcs"), F.col("_cn"), F.col("_rn"))).drop("_cn", "_rn", "_lcs")

    df = worded(pairs).withColumns({"_cn": F.size("_cw"), "_rn": F.size("_rw")})
    if key_col is None:
        return scored(df.withColumn("_lcs", common_subsequence("_cw", "_rw")).drop("_cw", "_rw"))
    longer = F.coalesce(F.greatest("_cn", "_rn") > tile_words, F.lit(False))
    path = shared_folder(pairs.sparkSession, "long-pairs")
    df.where(longer).drop("_cw", "_rw").write.parquet(path)
    far = pairs.sparkSession.read.parquet(path)
    words = worded(far.select(key_col, *dict.fromkeys(c for c in (candidate_col, reference_col) if c != key_col)))
    lengths = tiled_subsequences(words, key_col, "_cw", "_rw", tile_words).withColumnRenamed("lcs", "_lcs")
    near = df.where(~longer).withColumn("_lcs", common_subsequence("_cw", "_rw")).drop("_cw", "_rw")
    return scored(near).unionByName(scored(far.join(lengths, key_col)))


def mean_scores(scored: DataFrame, *names: str) -> DataFrame:
    return scored.agg(*[F.avg(n).alias(n) for n in names])


def corpus_bleu(pairs: DataFrame, candidate_col: str, reference_col: str, max_n: int = 4) -> DataFrame:
    """BLEU with matches and totals pooled over the corpus before dividing."""
    orders = range(1, max_n + 1)
    df = _with_overlaps(pairs, split_words(F.col(candidate_col)), split_words(F.col(reference_col)), orders)
    totals = df.agg(
        F.sum("_c1").alias("_cand"), F.sum("_r1").alias("_ref"),
        *[F.sum(f"_o{n}").alias(f"_m{n}") for n in orders],
        # a sentence too short for an n-gram still counts one in the denominator
        *[F.sum(F.greatest(F.col(f"_c{n}"), F.lit(1))).alias(f"_t{n}") for n in orders],
    )
    logs = [F.ln(F.when(F.col(f"_m{n}") > 0, F.col(f"_m{n}") / F.col(f"_t{n}")).otherwise(SMALLEST_NORMAL))
            for n in orders]
    cand, ref = F.col("_cand"), F.col("_ref")
    brevity = F.when(cand > ref, 1.0).when(cand == 0, 0.0).otherwise(F.exp(1 - ref / cand))
    score = brevity * F.exp(sum(logs[1:], logs[0]) / max_n)
    return totals.select(
        F.when(F.coalesce(F.col("_m1"), F.lit(0)) == 0, 0.0).otherwise(score).alias("bleu"),
        *[F.col(f"_m{n}").alias(f"matches{n}") for n in orders],
        *[F.col(f"_t{n}").alias(f"total{n}") for n in orders],
        cand.alias("candidate_words"), ref.alias("reference_words"),
    )


def embedding_match_pairs(vectors: DataFrame, pair_col: str = "pair_id", side_col: str = "side",
                          pos_col: str = "pos", vec_col: str = "vec", block: int = VECTOR_BLOCK) -> DataFrame:
    """Greedy-matching precision, recall and F1 per pair from token vectors.

    Tokens are packed into blocks of at most ``block`` positions. Blocks of one pair
    meet by both block numbers, so a very long pair is spread over many tasks; each
    meeting gives one best value per token, so token pairs are never rows.
    """
    place = F.floor(F.col(pos_col) / block).cast("int")
    packed = (vectors.groupBy(pair_col, side_col, place.alias("_block"))
              .agg(F.collect_list(F.struct(F.col(pos_col).alias("pos"), F.col(vec_col).cast("array<double>")
                                           .alias("vec"))).alias("_items")))
    # the last block of each side: one narrow row per pair, salted since a pair may have very many blocks
    ends = vectors.groupBy(pair_col).agg(*[F.max(F.when(F.col(side_col) == name, place)).alias(f"_{name}_end")
                                           for name in ("candidate", "reference")])
    salted = ends.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_SALTS - 1))))
    placed = packed.withColumn("_salt", F.pmod("_block", F.lit(BLOCK_SALTS))).join(salted, [pair_col, "_salt"])

    def side(name: str, other: str) -> DataFrame:
        return placed.filter(F.col(side_col) == name).select(
            pair_col, F.col("_items.pos").alias(f"_{name}_pos"), F.col("_items.vec").alias(f"_{name}_vec"),
            F.col("_block").alias(f"_{name}_block"), F.explode(F.sequence(F.lit(0), f"_{other}_end")).alias(f"_{other}_block"))

    def marked(name: str) -> Column:
        return F.zip_with(F.col(f"_{name}_pos"), F.col("_best")[name], lambda pos, best: F.struct(
            F.lit(name).alias("side"), pos.alias("pos"), best.alias("best")))

    met = side("candidate", "reference").join(
        side("reference", "candidate"), [pair_col, "_candidate_block", "_reference_block"]).withColumn(
        "_best", _best_matches("_candidate_vec", "_reference_vec"))
    best = met.select(pair_col, F.inline(F.concat(marked("candidate"), marked("reference"))))
    tokens = best.groupBy(pair_col, "side", "pos").agg(F.max("best").alias("best"))
    return (tokens.groupBy(pair_col).agg(
        F.avg(F.when(F.col("side") == "candidate", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == "reference", F.col("best"))).alias("recall"))
        .withColumn("f1", F.when(F.col("precision") + F.col("recall") != 0,
                                 2 * F.col("precision") * F.col("recall")
                                 / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


@F.pandas_udf(StructType().add("candidate", ArrayType(DoubleType())).add("reference", ArrayType(DoubleType())))
def _best_matches(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Best cosine of each vector of a block with the vectors of the other block."""
    def unit(vectors) -> np.ndarray:
        m = np.stack(vectors)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    cosines = [unit(c) @ unit(r).T for c, r in zip(candidate, reference)]
    return pd.DataFrame({"candidate": [m.max(axis=1) for m in cosines], "reference": [m.max(axis=0) for m in cosines]})
