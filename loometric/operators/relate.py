"""Joins and set operations: pending rows, shared prompts, positional pairs, label lookup."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

SALTS = 16


def digest(*columns: Column) -> Column:
    """A short join key for long texts, so that texts themselves stay out of the shuffle.

    Declared non-null: a nullable key would be hashed once more for a null check.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _row_salt(df: DataFrame, salts: int, row_key: str | None = None) -> Column:
    """A salt that copies of a row do not share where they lie in different partitions, or have different row keys.

    It depends on the row and its partition alone, so it is the same when a lost task is run again.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)] if row_key is None else [row_key]
    return F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(salts)).cast("int")


def _keep_or_drop(df: DataFrame, keys: DataFrame, key: Column, how: str, salts: int) -> DataFrame:
    """Semi or anti join of ``df`` with a set of digests (column ``_key``, distinct).

    Rows of one hot key are spread over ``salts`` tasks; the narrow digest side is
    repeated once per salt.
    """
    left = df.withColumn("_key", key)
    if salts > 1:
        left = left.withColumn("_salt", _row_salt(df, salts))
        keys = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return left.join(keys, ["_key", "_salt"], how).drop("_key", "_salt")
    return left.join(keys, "_key", how).drop("_key")


def pending(items: DataFrame, done: DataFrame, on: str = "input", order_key: str | None = None,
            duplicates: str = "each", salts: int = SALTS, done_digest: str | None = None) -> DataFrame:
    """Rows of ``items`` whose text is not yet in ``done``.

    ``done_digest`` names a column of ``done`` with the digests of its texts, which then need not be read.

    ``duplicates="each"`` keeps every copy of a text. ``"once"`` keeps the copy with
    the smallest ``order_key``, which must be unique: the copies are decided on
    (digest, key) pairs and only then are whole rows fetched by key.
    """
    known = digest(F.col(on)) if done_digest is None else F.coalesce(done_digest, F.lit(""))
    seen = done.select(known.alias("_key")).distinct()
    if duplicates == "each":
        return _keep_or_drop(items, seen, digest(F.col(on)), "left_anti", salts)
    if duplicates != "once" or order_key is None:
        raise ValueError("duplicates is 'each', or 'once' with an order_key")
    firsts = (items.groupBy(digest(F.col(on)).alias("_key")).agg(F.min(order_key).alias(order_key))
              .join(seen, "_key", "left_anti").select(order_key))
    return items.join(firsts, order_key, "left_semi")


def common_prompts(runs: DataFrame, prompt_col: str = "prompt", run_col: str = "run",
                   salts: int = SALTS) -> DataFrame:
    """Rows whose prompt occurs in every run; copies inside a run survive."""
    pairs = runs.select(digest(F.col(prompt_col)).alias("_key"), run_col).distinct()
    n_runs = runs.select(F.count_distinct(run_col)).scalar()
    shared = pairs.groupBy("_key").count().filter(F.col("count") == n_runs).select("_key")
    return _keep_or_drop(runs, shared, digest(F.col(prompt_col)), "left_semi", salts)


def zip_arrays(left: Column, right: Column, left_name: str = "left", right_name: str = "right") -> Column:
    """Pair two arrays by position and stop at the shorter one."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n),
                      lambda a, b: F.struct(a.alias(left_name), b.alias(right_name)))


def zip_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pair the rows of two tables by a row key that is unique in each."""
    return left.join(right, key, "inner")


def label_map(labels: Mapping) -> Column:
    """A label dictionary as a literal map; a table of labels is joined by ``encode_labels`` and ``decode_labels``."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def lookup(labels: Column, key: Column, strict: bool = False) -> Column:
    """Value of a key; an unknown key passes through, or raises when ``strict``."""
    found = F.try_element_at(labels, key)
    if strict:
        return F.coalesce(found, F.raise_error(
            F.concat(F.lit("unknown label: "), F.coalesce(key.cast("string"), F.lit("null")))))
    return F.coalesce(found.cast("string"), key.cast("string"))


def encode_labels(df: DataFrame, labels: Mapping | DataFrame, label_col: str, into: str) -> DataFrame:
    """Label names as ids; an unknown name raises."""
    if isinstance(labels, Mapping):
        return df.withColumn(into, lookup(label_map(labels), F.col(label_col), strict=True))
    return _joined_lookup(df, labels, label_col, "name", "id", into, strict=True)


def decode_labels(df: DataFrame, labels: Mapping | DataFrame, id_col: str, into: str) -> DataFrame:
    """Label ids as names; an unknown id passes through as text."""
    if isinstance(labels, Mapping):
        return df.withColumn(into, lookup(label_map(labels), F.col(id_col)))
    return _joined_lookup(df, labels, id_col, "id", "name", into, strict=False)


def _joined_lookup(df: DataFrame, labels: DataFrame, column: str, key: str, value: str, into: str,
                   strict: bool) -> DataFrame:
    """Lookup in a label table of any size.

    Spark broadcasts the table when it measures it as small. Otherwise rows of a
    frequent label are spread over salts, with the label table repeated once per salt.
    A key that is there more than once has its smallest value, so rows are never multiplied.
    """
    table = labels.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_value")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumns({"_key": F.col(column), "_salt": _row_salt(df, SALTS)})
    joined = left.join(table, ["_key", "_salt"], "left")
    if strict:
        found = F.coalesce("_value", F.raise_error(
            F.concat(F.lit("unknown label: "), F.coalesce(F.col("_key").cast("string"), F.lit("null")))))
    else:
        found = F.coalesce(F.col("_value").cast("string"), F.col("_key").cast("string"))
    return joined.withColumn(into, found).drop("_key", "_salt", "_value")


def intersect_inputs(first: DataFrame, *others: DataFrame, on: str = "input") -> DataFrame:
    """Distinct inputs found in all tables, by one grouping of their union."""
    tagged = None
    for i, df in enumerate((first, *others)):
        part = df.select(on, F.lit(i).alias("_table"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return intersect_runs(tagged, "_table", on, 1 + len(others))


def intersect_runs(runs: DataFrame, run_col: str = "run", on: str = "input", n_runs: int | None = None) -> DataFrame:
    """Distinct inputs found in every run of one table; ``n_runs`` if their number is known.

    (input, run) pairs are reduced before the shuffle, and the runs of one input are counted in one scan.
    """
    pairs = runs.select(on, run_col).distinct()
    wanted = F.lit(n_runs) if n_runs is not None else runs.select(F.count_distinct(run_col)).scalar()
    return pairs.groupBy(on).agg(F.count(F.lit(1)).alias("_runs")).filter(F.col("_runs") == wanted).select(on)


def union_labels(*columns: tuple[DataFrame, str], into: str = "label") -> DataFrame:
    """Distinct labels over several columns."""
    frames = [df.select(F.col(c).alias(into)) for df, c in columns]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.distinct()


def distinct_inputs(df: DataFrame, on: str = "input") -> DataFrame:
    return df.select(on).distinct()
