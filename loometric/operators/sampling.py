"""First rows, reproducible permutations and samples, best candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def head(df: DataFrame, order_key: str, n: int) -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(order_key).limit(n)


def seeded_hash(key: Column, seed: int) -> Column:
    """A 128-bit hash as hex text: depends on key and seed only, not on partitioning."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def _leading_bits(hashed: Column, hex_digits: int) -> Column:
    return F.conv(F.substr(hashed, F.lit(1), F.lit(hex_digits)), 16, 10).cast("bigint")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation of the rows that the key and the seed decide."""
    return df.orderBy(seeded_hash(F.col(key), seed), key)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose hash falls into the given share; needs no shuffle."""
    return df.filter(_leading_bits(seeded_hash(F.col(key), seed), 8) < int(fraction * (1 << 32)))


def sample_exact(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly ``floor(rows * fraction)`` rows, those with the smallest hashes of a unique key.

    A histogram over leading hash digits finds the one bucket that the cut falls into, and a
    second one over further digits a bucket of that bucket. Only its keys, one in four
    billion, are ranked; all others are dropped before any exchange. Whole rows are
    read once, for a plain comparison with the cut.
    """
    hashed = seeded_hash(F.col(key), seed)
    keys = df.select(hashed.alias("_hash")).withColumn("_bucket", _leading_bits(F.col("_hash"), 4))

    def edge_of(sizes: DataFrame, wanted: Column) -> Column:
        """The bucket of the cut and the rows still wanted in it; at most 65,536 rows are ordered in one pass."""
        placed = sizes.select("_bucket", F.sum("_n").over(W.orderBy("_bucket")).alias("_upto"), "_n",
                              F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
        found = placed.select("_bucket", "_upto", "_n", wanted.alias("_want")).filter(
            (F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        return found.select(F.struct("_bucket", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))).scalar()

    count = F.count(F.lit(1)).alias("_n")
    first = edge_of(keys.groupBy("_bucket").agg(count), F.floor(F.col("_all") * F.lit(fraction)))
    finer = (keys.filter(F.col("_bucket") == first["_bucket"])
             .withColumn("_bucket", F.conv(F.substr("_hash", F.lit(5), F.lit(4)), 16, 10).cast("bigint")))
    second = edge_of(finer.groupBy("_bucket").agg(count), first["_left"])
    ranked = finer.filter(F.col("_bucket") == second["_bucket"]).select(
        "_hash", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_hash")).alias("_rank"))
    cut = ranked.filter(F.col("_rank") <= second["_left"]).select(F.max("_hash")).scalar()
    return df.filter(hashed <= cut)


def best_run(candidates: DataFrame, metric: str, run_col: str = "run", greater_is_better: bool = True) -> DataFrame:
    """The candidate with the best metric, the first run name on ties."""
    order = F.desc_nulls_last(metric) if greater_is_better else F.asc_nulls_last(metric)
    return candidates.orderBy(order, run_col).limit(1)
