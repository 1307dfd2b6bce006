"""Every registered query against its SQL check, and the rules all plans keep."""

import math

import duckdb
import pytest
from conftest import DATA_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
CHECKS = entry_points.oracle_sql()


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


def plan_without_all_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA_DIR)
    assert plan_without_all_pairs(df)
    found = ordered([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert found == ordered(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs_without_check(spark, name):
    df = QUERIES[name](spark, DATA_DIR)
    assert plan_without_all_pairs(df) and df.count() > 0


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cursor = con.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    return ordered([tuple(r) for r in df.collect()], df.columns), ordered(cursor.fetchall(), columns)


def test_initials_that_upper_case_spells_out(spark, tmp_path):
    texts = ["ßa", "ŉb", "ǰc", "ᾀd", "ﬁe", "ǆf", "éa", "", "1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found, expected = against_sql(spark, "map_rows", tmp_path)
    assert found == expected and len(found) == len(texts)


@pytest.mark.parametrize("rows", [20, 26, 28, 29])
def test_last_vectors_of_a_table_that_ends_inside_a_sequence(spark, tmp_path, rows):
    df = spark.range(rows).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found, expected = against_sql(spark, "pool_last", tmp_path)
    assert found == expected and len(found) == (6 if rows > 27 else 4)


def test_tee_writes_many_files_into_a_folder(spark, tmp_path, monkeypatch):
    """Listing and committing cost time for each folder, so there are far fewer of them than files."""
    from loometric.queries import apply

    monkeypatch.setattr(apply, "shared_folder", lambda session, purpose: str(tmp_path / purpose))
    rows = spark.range(16_000).select(F.col("id").alias("event_id"), F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") % 2 + 1).cast("int"))
                                      .alias("event_type"), F.lit(1).alias("user_id"), F.lit("{}").alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found, expected = against_sql(spark, "tee_corrupt", tmp_path)
    assert found == expected
    files = [f for f in (tmp_path / "tee-runs").rglob("*") if f.is_file() and f.name.startswith("part-")]
    assert len(files) == 64 and len({f.parent for f in files}) == 4


def test_subword_view_of_odd_words(spark, tmp_path):
    """Pieces come from one pass over a text: no tags are made for them, and a word's pieces cost time in proportion to its length."""
    from loometric.queries import views

    texts = [None, "", " \u2003\n", "a", "\u0120", "\u0120ab \u0120\u0120cdefg\x1c\x85x", "abcd abcde abcdefgh", "\U0001F600" * 9 + " \U0001F600b", "w" * 32 + " " + "v" * 33,
             "ab " + "é" * 200_001 + "\u3000b"]
    rows = [(5 - i, "en", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = views.fx_subwords(spark, str(tmp_path))
    assert "RLIKE" not in df._jdf.queryExecution().executedPlan().toString()
    found = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert found.pop(5) == (None, None, None) and len(found) == len(texts) - 1
    for key, _, text in rows[1:]:
        pieces = [("<s>", 0, 0)]
        for i, word in enumerate(text.split()):
            pieces += [("\u0120" * (i > 0 and s == 0) + word[s:s + 4], s, min(s + 4, len(word))) for s in range(0, len(word), 4)]
        pieces.append(("<s>", 0, 0))
        subwords, offsets, preds = found[key]
        assert [(w, *o) for w, o in zip(subwords, offsets, strict=True)] == pieces
        assert preds == [int(math.fmod(i + key, 7)) for i in range(len(pieces))]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {"macro avg", "weighted avg"} <= {r["label"] for r in rows}
