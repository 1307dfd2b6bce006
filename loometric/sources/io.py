"""Split datasets, run files, result tables and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructType

from loometric.functions.stage import computed

# Other names under which a split is stored (fixed values).
SPLIT_ALIASES = {"valid": "validation", "eval": "validation", "dev": "validation"}

CORRUPT = "_corrupt_record"


def read_splits(spark: SparkSession, name: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """A dataset with its ``split`` column: a path when it starts with . or /, else a table."""
    is_path = name.startswith((".", "/")) or "://" in name
    df = spark.read.parquet(name) if is_path else spark.table(name)
    return canonical_splits(df, aliases) if aliases else df


def canonical_splits(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Split names brought to one spelling."""
    name = F.col("split")
    for given, wanted in (SPLIT_ALIASES if aliases is None else aliases).items():
        name = F.when(F.col("split") == given, F.lit(wanted)).otherwise(name)
    return df.withColumn("split", name)


def write_splits(splits: Mapping[str, DataFrame] | DataFrame, path: str) -> None:
    """All splits of a dataset in one folder, one partition per split."""
    if isinstance(splits, DataFrame):
        df = splits
    else:
        df = None
        for name, part in splits.items():
            tagged = part.withColumn("split", F.lit(name))
            df = tagged if df is None else df.unionByName(tagged)
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def run_catalogue(spark: SparkSession, path: str, suffix: str = "_filtered", pattern: str = "*.json*") -> DataFrame:
    """(run, path, length, modified) of the run files below a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(_stem(F.col("path"), suffix).alias("run"), "path", "length", F.col("modificationTime").alias("modified"))


def _stem(path: Column, suffix: str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl?(\.gz)?$", "")
    return F.replace(stem, F.lit(suffix), F.lit(""))


def read_runs(spark: SparkSession, path: str, schema: StructType | str, run_from: str = "file",
              arrays_span_lines: bool = True, suffix: str = "_filtered", pattern: str = "*.json*",
              catalogue: DataFrame | None = None) -> DataFrame:
    """Result files of many runs with a ``run`` column and a corrupt-record column.

    A run is named by its file (``run_from="file"``), by its folder ``run=name`` when it is stored as many part files ("folder"), or by
    any parent folder ("parent"). Folders ``run=name`` are partitions: a filter on ``run`` lists and reads no other. Of files, only those
    of a ``catalogue`` are read if one is given: ``run_catalogue``, filtered as wanted, one row for each run file.
    A file holds one JSON array over any number of lines; with ``arrays_span_lines``
    off each line is a JSON array or object, so that big files can be read in pieces.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = StructType(list(wanted.fields)).add(CORRUPT, StringType())
    names = wanted.names
    folders = run_from == "folder"
    if folders:
        wanted = wanted.add("run", StringType())
    reader = (spark.read.schema(wanted).option("multiLine", arrays_span_lines).option("pathGlobFilter", pattern)
              .option("columnNameOfCorruptRecord", CORRUPT))
    if catalogue is not None:
        paths = [r["path"] for r in catalogue.select("path").toLocalIterator()]
        if not paths:
            empty = StructType(list(wanted.fields)).add("file_path", StringType())
            return spark.createDataFrame([], empty if folders else empty.add("run", StringType()))
        df = reader.json(paths)
    else:
        df = (reader if folders else reader.option("recursiveFileLookup", True)).json(path)
    df = df.select(*names, *(["run"] if folders else []), "_metadata.file_path")
    # Spark refuses to read the corrupt column alone, so an empty piece of a data column goes with it
    nothing = F.substr(F.coalesce(F.col(names[0]).cast("string"), F.lit("")), F.lit(1), F.lit(0))
    df = df.withColumn(CORRUPT, F.concat(F.col(CORRUPT), nothing))
    if folders:
        return df
    parent = F.replace(F.element_at(F.split("file_path", "/"), -2), F.lit(suffix), F.lit(""))
    return df.withColumn("run", _stem(F.col("file_path"), suffix) if run_from == "file" else parent)


def write_runs(runs: DataFrame, path: str, order_key: str, columns: Sequence[str], run_col: str = "run", rows: int = 50_000) -> None:
    """Result files of many runs: a folder for each run, whose files hold lines, each a JSON array of rows.

    An array holds the rows of one range of ``rows`` values of a whole-number key, so its size is bounded however
    large the run is. ``read_runs`` with ``run_from="folder"`` and ``arrays_span_lines=False`` reads them.
    """
    packed = (runs.groupBy(F.col(run_col).alias("run"), F.floor(F.col(order_key) / rows).alias("_part"))
              .agg(F.to_json(F.sort_array(F.collect_list(F.struct(order_key, *[c for c in columns if c != order_key])))).alias("value")))
    packed.select("run", "value").write.mode("overwrite").partitionBy("run").text(path)


def split_corrupt(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a dead-letter table of what could not be read."""
    good = runs.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "file_path")
    bad = runs.filter(F.col(CORRUPT).isNotNull())
    return good, bad.select("run", "file_path", F.col(CORRUPT).alias("content"))


def tee_corrupt(runs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """``split_corrupt`` of runs that are parsed once: one pass writes good and corrupt rows side by side below ``path``, then each is read."""
    runs.withColumn("readable", F.col(CORRUPT).isNull()).write.mode("overwrite").partitionBy("readable").parquet(path)
    schema = StructType(list(runs.schema.fields)).add("readable", BooleanType())
    both = runs.sparkSession.read.schema(schema).parquet(path)
    bad = both.filter(~F.col("readable")).select("run", "file_path", F.col(CORRUPT).alias("content"))
    return both.filter("readable").drop(CORRUPT, "file_path", "readable"), bad


def normalize_prompts(df: DataFrame, item_col: str, *keep: str) -> DataFrame:
    """Union-typed JSON items as ``(input, reference_response)``.

    An object with a question comes first, then one with a prompt, then a plain
    string. Any other item is left out.
    """
    item = F.col("_item")
    staged = computed(df.select(*keep, item_col), _item=F.try_parse_json(F.col(item_col)))
    staged = computed(staged, _kind=F.schema_of_variant(item))

    def text_of(path: str) -> Column:
        return F.try_variant_get(item, path, "string")

    def has(key: str) -> Column:
        return F.col("_kind").startswith("OBJECT") & F.try_variant_get(item, f"$.{key}", "variant").isNotNull()

    rule = F.when(has("question"), 1).when(has("prompt"), 2).when(F.col("_kind") == "STRING", 3)
    return (computed(staged, _rule=rule).filter(F.col("_rule").isNotNull())
            .select(*keep,
                    F.when(F.col("_rule") == 1, text_of("$.question")).when(F.col("_rule") == 2, text_of("$.prompt"))
                    .otherwise(text_of("$")).alias("input"),
                    F.when(F.col("_rule") == 1, text_of("$.answer")).alias("reference_response")))


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a result table; what is there already stays untouched."""
    results.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A result table, empty before the first append."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def report_rows(df: DataFrame, section: str, first: int = 0, *metrics: str) -> DataFrame:
    """One row of metrics as a long table ``(section, ord, metric, value, kind)``.

    Whole-number columns are counts, others are scores.
    """
    names = metrics or tuple(df.columns)
    entries = [F.struct(F.lit(section).alias("section"), F.lit(first + i).cast("bigint").alias("ord"),
                        F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
                        F.lit("count" if isinstance(df.schema[name].dataType, IntegralType) else "score").alias("kind"))
               for i, name in enumerate(names)]
    return df.select(F.inline(F.array(*entries)))


def report_lines(report: DataFrame, digits: int = 4) -> DataFrame:
    """Markdown lines of a long metric table, a heading before each section.

    Counts print without decimals, scores always with them.
    """
    value = F.when(F.col("kind") == "count", F.format_string("%d", F.col("value").cast("bigint"))).otherwise(
        F.format_string(f"%.{digits}f", F.col("value")))
    lines = report.select("section", "ord", F.concat(F.lit("- **"), F.col("metric"), F.lit(":** "), value).alias("line"))
    headings = report.groupBy("section").agg((F.min("ord") - 0.5).alias("ord")).select(
        "section", "ord", F.concat(F.lit("\n## "), F.col("section"), F.lit("\n")).alias("line"))
    return lines.unionByName(headings).orderBy("ord")


def matrix_lines(wide: DataFrame, labels: list[str]) -> DataFrame:
    """A wide confusion matrix as Markdown table lines, in label order."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("truth"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "truth", *[F.col(f"`{x}`").cast("string") for x in labels]),
                     F.lit(" |"))
    body = wide.select((order + 1).cast("bigint").alias("ord"), cells.alias("line"))
    top = wide.sparkSession.range(1).select(F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit("|  | " + " | ".join(labels) + " |").alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("ord"),
                 F.lit("| " + " | ".join(["---"] * (len(labels) + 1)) + " |").alias("line")))))
    return top.unionByName(body).orderBy("ord")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as one text file; a report has a few lines per class."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
