"""What several operators share: written intermediates, Arrow passes, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which names storage that the driver and all executors share.

    Where that is unset, a session on one machine uses its warehouse; a cluster's session raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Without this setting the shuffle files of a finished write stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files when it has finished; the session's own setting comes back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder: a cut in the lineage that survives lost executors.

    What the write has shuffled is removed with it, so the disk holds one step's shuffles, not all.
    """
    path = shared_path(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Two columns, id and text; a null text is empty. Other columns, whatever their names, stay out."""
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def returned_memory() -> None:
    """Give memory that is free back to the system: an idle worker keeps its process, and Spark runs other work beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = function(batch)
                if found is not None and found.num_rows:
                    yield found
        returned_memory()

    return df.mapInArrow(run, schema)


# --- word hashes ------------------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: equal bytes give equal hashes wherever they stand.

    A polynomial over the bytes from prefix sums; dividing by the power at the start takes
    the position out. The length goes in as well.
    """
    n = len(data)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    terms = _BYTE_VALUES[data]
    terms *= powers(_MULTIPLIER, n)
    np.cumsum(terms, out=sums[1:])
    body = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mixed(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# --- texts of a batch as bytes ----------------------------------------------------

CHUNK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes: (first row, end row, their bytes, offsets in these bytes).

    A longer text comes whole, alone. The texts must not be null.
    """
    wide = texts.cast(pa.large_string())
    _, ends, data = wide.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(wide):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_ranges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each text, the number of words before it; words are runs of ``inside`` within one text."""
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[firsts] = False
    after[lasts] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_ranges`` of the words ``[^\\x20\\x09-\\x0D]+``."""
    return word_ranges(~_IS_SPACE[data], offsets)
