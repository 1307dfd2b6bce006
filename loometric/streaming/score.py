"""Apply a user's own function or model to tables and to files as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

from loometric.functions.stage import row_slices
from loometric.operators.relate import digest, pending
from loometric.sources.io import append_results, read_results

Model = Callable[[list[str]], Iterable[str | None]]

# Rows and characters (or items of lists) of a piece of a batch that meets a user's function at once.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in pieces of bounded size, so that what a user's function makes of one at a time is bounded as well."""
    for batch in batches:
        sizes = np.zeros(len(batch), dtype=np.int64)
        for column in batch.select_dtypes(object):
            sizes += batch[column].map(lambda value: len(value) if hasattr(value, "__len__") else 1).to_numpy(np.int64)
        for row, end in row_slices(sizes, PIECE_CHARS, PIECE_ROWS):
            yield batch.iloc[row:end].reset_index(drop=True)


def _arrow_pieces(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of bounded size; the other columns stay as they are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end in row_slices(sizes, PIECE_CHARS, PIECE_ROWS):
            yield batch.slice(row, end - row)


def _with_columns(piece: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*piece.columns, *columns.values()], names=[*piece.schema.names, *columns])


def map_rows(df: DataFrame, function: Callable[[dict], dict], schema: StructType | str) -> DataFrame:
    """A user function over single rows, each given and returned as a dict."""
    names = [f.name for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            rows = [function(row) for row in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A user function over pieces of Arrow batches; a piece may shrink."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            yield function(batch)

    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[object], bool]) -> DataFrame:
    """Rows for which a user function of one column holds."""
    @F.pandas_udf(BooleanType())
    def holds(values: pd.Series) -> pd.Series:
        return values.map(keep).astype(bool)

    return df.filter(holds(F.col(column)))


def score_batches(df: DataFrame, model: Callable[[], Model], prompt_col: str, batch_rows: int = 64) -> DataFrame:
    """Adds ``response`` and ``error`` from a user's model.

    ``model`` is called once per task and returns a function from a list of prompts to
    responses. A batch that fails is tried again in halves, down to single rows, so that
    only the bad ones carry an error and the good ones meet the model a few times at most.
    """
    schema = StructType(list(df.schema.fields)).add("response", "string").add("error", "string")

    def attempt(answer: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            responses = list(answer(prompts))
            if len(responses) != len(prompts):
                raise ValueError(f"{len(responses)} responses to {len(prompts)} prompts")
            return [(r, None if r is not None else "no response") for r in responses]
        except Exception as problem:  # a user's model may raise anything
            if len(prompts) == 1:
                return [(None, f"{type(problem).__name__}: {problem}")]
            half = len(prompts) // 2
            return attempt(answer, prompts[:half]) + attempt(answer, prompts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = model()
        for piece in _arrow_pieces(batches, prompt_col):
            prompts = piece.column(prompt_col).to_pylist()
            pairs = [p for at in range(0, len(prompts), batch_rows)
                     for p in attempt(answer, prompts[at:at + batch_rows])]
            yield _with_columns(piece, response=pa.array([r for r, _ in pairs], pa.string()), error=pa.array([e for _, e in pairs], pa.string()))

    return df.mapInArrow(run, schema)


def scored_rows(scored: DataFrame, save_failures: bool = False) -> DataFrame:
    """Rows for the result table: failures are left out so that they are tried again,
    or kept with a null response."""
    kept = scored if save_failures else scored.filter(F.col("error").isNull())
    return kept.drop("error")


def dead_letters(scored: DataFrame, user_col: str, system_prompt: str = "") -> DataFrame:
    """Failed rows as ``(timestamp, system_prompt, user_prompt, error)``."""
    return scored.filter(F.col("error").isNotNull()).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(system_prompt).alias("system_prompt"), F.col(user_col).alias("user_prompt"), "error")


def classify(df: DataFrame, model: Callable[[], Callable[[list[str]], Iterable[list[float]]]],
             text_col: str = "text") -> DataFrame:
    """Adds ``logits`` from a user's classifier, loaded once per task."""
    schema = StructType(list(df.schema.fields)).add("logits", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model()
        for piece in _arrow_pieces(batches, text_col):
            logits = [list(map(float, row)) for row in predict(piece.column(text_col).to_pylist())]
            yield _with_columns(piece, logits=pa.array(logits, pa.list_(pa.float64())))

    return df.mapInArrow(run, schema)


BATCH, DIGEST, ROW, SEQ = "batch", "input_digest", "row_digest", "seq"
# How often a failing text meets the model, at most.
MAX_TRIES = 5
# Batches of attempts that are read one by one before their sums are written as one table.
LEDGER_BATCHES = 16


def retry_gap(tries: Column) -> Column:
    """Batches to wait after so many tries: 1, 1, 2, 4, 8 and so on."""
    return F.pow(F.lit(2.0), F.least(F.greatest(tries - 2, F.lit(0)), F.lit(20))).cast("bigint")


def resume_scoring(items: DataFrame, model: Callable[[], Model], results_path: str, failures_path: str,
                   prompt_col: str = "input", order_key: str | None = None, duplicates: str = "each",
                   save_failures: bool = False, run_id: str = "default", max_tries: int = MAX_TRIES) -> None:
    """Score the items whose text is not in the result table, and append them to it.

    Items that failed before and have no result yet are tried again along with the new ones, unless
    ``save_failures`` counts a failure as a result. A ledger of attempts by digest decides which: after each try a text waits
    longer, and after ``max_tries`` it is quarantined and never sent again, however often it comes. Each scored batch has its own
    folder and name, and is logged before it is appended; a run that was stopped in between, with the same ``run_id``,
    first appends what is missing, without asking the model again. Results carry a digest of their
    text: what is done already is read from this column alone.
    """
    spark = items.sparkSession
    paths = _Paths(results_path, failures_path)
    for batch, _ in _unfinished(spark, paths, run_id):
        _finish(spark, paths, run_id, batch, items.schema, prompt_col, save_failures)
    seq = _batches_so_far(spark, paths) + 1
    done = read_results(spark, results_path, StructType().add(DIGEST, "string")).select(DIGEST)
    todo = items
    if not save_failures:
        ledger = attempts(spark, results_path, failures_path)
        due = (F.col("tries") < max_tries) & (F.col("last") + retry_gap(F.col("tries")) <= seq)
        failed_schema = StructType(list(items.schema.fields)).add(DIGEST, "string").add(ROW, "string")
        failed = (read_results(spark, paths.failed_items, failed_schema).select(*failed_schema.names)
                  .join(ledger.where(due).select(DIGEST), DIGEST, "left_semi")
                  .join(items.select(_row_digest(items).alias(ROW)), ROW, "left_anti"))
        todo = items.unionByName(failed.select(*items.columns))
        done = done.unionByName(ledger.where(~due).select(DIGEST))  # these wait, or are quarantined
    scored = score_batches(pending(todo, done, prompt_col, order_key, duplicates, done_digest=DIGEST), model, prompt_col)
    batch = f"b{seq:08d}-{uuid.uuid4().hex}"
    scored.write.parquet(paths.batch(batch))
    _log(spark, paths, run_id, batch, "scored")
    _finish(spark, paths, run_id, batch, items.schema, prompt_col, save_failures)
    if not save_failures:
        _sum_up(spark, paths, run_id, seq)


def attempts(spark: SparkSession, results_path: str, failures_path: str) -> DataFrame:
    """The ledger, (digest, tries, last, error): one row for each text that has failed, done since then or not."""
    paths = _Paths(results_path, failures_path)
    summed = _summed_up_to(spark, paths)
    single = read_results(spark, paths.ledger, LEDGER_SCHEMA).where(F.col(SEQ) > summed).select(
        DIGEST, F.lit(1).cast("bigint").alias("tries"), F.col(SEQ).alias("last"), "error")
    if summed:
        single = single.unionByName(read_results(spark, paths.ledger_sums(summed), SUMS_SCHEMA))
    return single.groupBy(DIGEST).agg(F.sum("tries").alias("tries"), F.max_by("error", "last").alias("error"), F.max("last").alias("last"))


def quarantined(spark: SparkSession, results_path: str, failures_path: str, max_tries: int = MAX_TRIES) -> DataFrame:
    """The ledger's rows of texts that are not tried again and have no result."""
    done = read_results(spark, results_path, StructType().add(DIGEST, "string")).select(DIGEST)
    return attempts(spark, results_path, failures_path).where(F.col("tries") >= max_tries).join(done, DIGEST, "left_anti")


@dataclass(frozen=True)
class _Paths:
    results: str
    failures: str

    @property
    def log(self) -> str:
        return f"{self.results.rstrip('/')}_log"

    @property
    def failed_items(self) -> str:
        return f"{self.failures.rstrip('/')}_items"

    @property
    def ledger(self) -> str:
        return f"{self.failures.rstrip('/')}_ledger"

    def ledger_sums(self, seq: int) -> str:
        return f"{self.failures.rstrip('/')}_ledger_sums/{seq}"

    def batch(self, name: str) -> str:
        return f"{self.results.rstrip('/')}_batches/{name}"


LOG_SCHEMA = "run_id string, batch string, state string"
LEDGER_SCHEMA = f"{DIGEST} string, error string, {SEQ} bigint, {BATCH} string"
SUMS_SCHEMA = f"{DIGEST} string, tries bigint, last bigint, error string"


def _row_digest(df: DataFrame) -> Column:
    """Tells rows apart, whatever the types of their columns."""
    return F.sha2(F.to_json(F.struct(*df.columns)), 256)


def _log(spark: SparkSession, paths: _Paths, run_id: str, batch: str, state: str) -> None:
    append_results(spark.createDataFrame([(run_id, batch, state)], LOG_SCHEMA), paths.log)


def _unfinished(spark: SparkSession, paths: _Paths, run_id: str) -> list[tuple[str, int]]:
    """Batches of this run that were scored and not appended in full: one at most after each stop."""
    log = read_results(spark, paths.log, LOG_SCHEMA).filter((F.col("run_id") == run_id) & (F.col("state") != "summed"))
    states = log.groupBy("batch").agg(F.count_distinct("state").alias("states"))
    return [(r["batch"], r["states"]) for r in states.filter("states < 2").collect()]


def _batches_so_far(spark: SparkSession, paths: _Paths) -> int:
    return read_results(spark, paths.log, LOG_SCHEMA).filter("state = 'scored'").count()


def _seq(batch: str) -> int:
    return int(batch[1:9])


def _summed_up_to(spark: SparkSession, paths: _Paths) -> int:
    """The last batch whose attempts are in a table of sums; 0 without one."""
    log = read_results(spark, paths.log, LOG_SCHEMA).filter("state = 'summed'")
    return log.agg(F.max(F.col("batch").cast("bigint"))).first()[0] or 0


def _sum_up(spark: SparkSession, paths: _Paths, run_id: str, seq: int) -> None:
    """Write the ledger's sums once enough batches have come: later ones read them and the batches since.

    A run that is stopped meanwhile leaves a folder without an entry in the log; it is written anew.
    """
    if seq - _summed_up_to(spark, paths) >= LEDGER_BATCHES:
        attempts(spark, paths.results, paths.failures).select("input_digest", "tries", "last", "error").write.mode("overwrite").parquet(
            paths.ledger_sums(seq))
        _log(spark, paths, run_id, str(seq), "summed")


def _finish(spark: SparkSession, paths: _Paths, run_id: str, batch: str, schema: StructType, prompt_col: str,
            save_failures: bool) -> None:
    """Append a scored batch to each table that does not have it yet."""
    stored = StructType(list(schema.fields)).add("response", "string").add("error", "string")
    written = spark.read.schema(stored).parquet(paths.batch(batch)).withColumn(DIGEST, digest(F.col(prompt_col)))
    items = written.drop("response", "error", DIGEST)
    bad = written.filter(F.col("error").isNotNull())
    # of a row that fails again its first copy is kept
    known = read_results(spark, paths.failed_items, StructType().add(ROW, "string").add(BATCH, "string")).filter(F.col(BATCH) != batch)
    failed = bad.withColumn(ROW, _row_digest(items)).drop("response", "error").join(known.select(ROW), ROW, "left_anti")
    tried = bad.groupBy(DIGEST).agg(F.max("error").alias("error")).withColumn(SEQ, F.lit(_seq(batch)).cast("bigint"))
    tables = [(dead_letters(written, prompt_col), paths.failures), (scored_rows(written, save_failures), paths.results)]
    if not save_failures:
        tables[1:1] = [(failed, paths.failed_items), (tried, paths.ledger)]
    for rows, path in tables:
        had = read_results(spark, path, StructType().add(BATCH, "string"))
        if had.filter(F.col(BATCH) == batch).isEmpty():
            rows.withColumn(BATCH, F.lit(batch)).write.mode("append").partitionBy(BATCH).parquet(path)
    _log(spark, paths, run_id, batch, "appended")


def compact_results(spark: SparkSession, results_path: str, failures_path: str, schema: StructType | str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite the result table, one folder for each batch, as one folder of large files under the name of the last batch.

    For a quiet time: nobody may score or read meanwhile. The new folder is complete before the old ones go; a run that was
    stopped in between is finished by the next call. ``schema`` is that of the results without ``batch``.
    """
    paths = _Paths(results_path, failures_path)
    fs, folder = _file_system(spark, results_path)
    name = spark._jvm.org.apache.hadoop.fs.Path
    fresh = name(f"{results_path.rstrip('/')}_compacted")
    done = name(fresh, "_SUCCESS")
    if not fs.exists(done):
        table = read_results(spark, results_path, schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
        table.drop(BATCH).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(fresh.toString())
    last = f"b{_batches_so_far(spark, paths):08d}-compacted"
    for entry in list(fs.listStatus(folder)):
        if entry.getPath().getName().startswith(f"{BATCH}=") and entry.getPath().getName() != f"{BATCH}={last}":
            fs.delete(entry.getPath(), True)
    target = name(folder, f"{BATCH}={last}")
    fs.delete(target, True)
    fs.rename(fresh, target)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def score_stream(spark: SparkSession, source: str, schema: StructType | str, model: Callable[[], Model],
                 results_path: str, failures_path: str, checkpoint: str, prompt_col: str = "input",
                 order_key: str | None = None, duplicates: str = "each", save_failures: bool = False,
                 source_format: str = "parquet", max_tries: int = MAX_TRIES) -> None:
    """Score files that arrived since the last run, once, across restarts.

    Repeats are recognised by the result table itself rather than by stream state, so
    a batch that is run again after a failure adds nothing twice. Rows that failed are
    tried again with later batches, and when no new file has come, ``max_tries`` times at most.
    """
    batches = []

    def each_batch(batch: DataFrame, number: int) -> None:
        batches.append(number)
        resume_scoring(batch, model, results_path, failures_path, prompt_col, order_key, duplicates, save_failures, checkpoint,
                       max_tries)

    query = (spark.readStream.schema(schema).format(source_format).load(source).writeStream
             .foreachBatch(each_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if not batches and not save_failures:
        nothing = spark.createDataFrame([], schema)
        resume_scoring(nothing, model, results_path, failures_path, prompt_col, order_key, duplicates, save_failures, checkpoint,
                       max_tries)
