"""Run files, splits, prompts and reports."""

import json

from loometric.plans import evaluation
from loometric.sources import io

SCHEMA = "input string, output string, score bigint"


def write(folder, name, value):
    text = value if isinstance(value, str) else json.dumps(value, indent=4, ensure_ascii=False)
    (folder / name).write_text(text, encoding="utf-8")


def test_runs_with_a_malformed_file(spark, tmp_path):
    write(tmp_path, "first_filtered.json", [{"input": "ü", "score": 5}, {"output": "no input", "score": None}])
    write(tmp_path, "second.json", [{"input": "a\nb", "output": "c"}])
    write(tmp_path, "empty.json", [])
    write(tmp_path, "broken.json", "@not json at all")
    write(tmp_path, "notes.txt", "ignored")
    good, bad = io.split_corrupt(io.read_runs(spark, str(tmp_path), SCHEMA))
    rows = sorted((r["run"], r["input"], r["output"], r["score"]) for r in good.fillna("-").collect())
    assert rows == [("first", "-", "no input", None), ("first", "ü", "-", 5), ("second", "a\nb", "c", None)]
    letters = bad.collect()
    assert [r["run"] for r in letters] == ["broken"] and "not json" in letters[0]["content"]
    assert bad.count() == 1 and good.count() == 3


def test_runs_as_folders_of_parts(spark, tmp_path):
    for run, items in (("a", [1, 2]), ("b", [3])):
        folder = tmp_path / f"run={run}"
        folder.mkdir()
        for i in items:
            write(folder, f"part-{i}.json", json.dumps([{"input": f"i{i}", "score": i}]) + "\n")
    runs = io.read_runs(spark, str(tmp_path), SCHEMA, run_from="folder", arrays_span_lines=False)
    good, _ = io.split_corrupt(runs)
    assert sorted((r["run"], r["score"]) for r in good.collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_only_the_wanted_run_is_listed(spark, tmp_path):
    for run in ("a", "b_filtered", "007"):
        (tmp_path / f"run={run}").mkdir()
        write(tmp_path / f"run={run}", "part-0.json", json.dumps([{"input": run, "score": 1}]) + "\n")
    runs = io.read_runs(spark, str(tmp_path), SCHEMA, run_from="folder", arrays_span_lines=False)
    assert {r["run"] for r in runs.collect()} == {"a", "b_filtered", "007"}
    one = runs.where("run = '007'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "run=a" not in plan
    assert [r["input"] for r in one.collect()] == ["007"] and len(one.inputFiles()) >= 1
    flat = tmp_path / "flat"
    flat.mkdir()
    write(flat, "x_filtered.json", [{"input": "x"}])
    write(flat, "y.jsonl", json.dumps({"input": "y"}) + "\n" + json.dumps([{"input": "z"}]) + "\n")
    catalogue = io.run_catalogue(spark, str(flat))
    assert {r["run"] for r in catalogue.collect()} == {"x", "y"}
    wanted = io.read_runs(spark, str(flat), SCHEMA, catalogue=catalogue.where("run = 'x'"))
    assert len(wanted.inputFiles()) == 1 and [(r["run"], r["input"]) for r in wanted.collect()] == [("x", "x")]
    lines = io.read_runs(spark, str(flat), SCHEMA, arrays_span_lines=False, catalogue=catalogue.where("run = 'y'"))
    assert [r["input"] for r in lines.collect()] == ["y", "z"]
    nothing = io.read_runs(spark, str(flat), SCHEMA, catalogue=catalogue.where("run = 'no'"))
    assert nothing.count() == 0 and set(nothing.columns) == set(wanted.columns)
    parents = io.read_runs(spark, str(tmp_path), SCHEMA, run_from="parent", arrays_span_lines=False, pattern="part-*")
    assert {r["run"] for r in parents.collect()} == {"run=a", "run=b", "run=007"}


def test_good_and_corrupt_rows_from_one_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "first.json", [{"input": "a"}, {"input": "b", "score": 2}])
    write(tmp_path / "in", "broken.json", "@not json\nat all")
    runs = io.read_runs(spark, str(tmp_path / "in"), SCHEMA)
    good, bad = io.tee_corrupt(runs, str(tmp_path / "out"))
    plain_good, plain_bad = io.split_corrupt(runs)
    assert good.columns == plain_good.columns and sorted(map(str, good.collect())) == sorted(map(str, plain_good.collect()))
    assert [tuple(r) for r in bad.collect()] == [tuple(r) for r in plain_bad.collect()]
    for side in (good, bad):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "FileScan json" not in plan and plan.count("FileScan parquet") == plan.count("PartitionFilters: [isnotnull(readable") > 0


def test_splits(spark, tmp_path):
    path = str(tmp_path / "ds")
    parts = {n: spark.createDataFrame([(n,)], "text string") for n in ("train", "valid", "eval", "test")}
    io.write_splits(parts, path)
    assert {r["split"] for r in io.read_splits(spark, path).collect()} == set(parts)
    names = sorted(r["split"] for r in io.read_splits(spark, path, io.SPLIT_ALIASES).collect())
    assert names == ["test", "train", "validation", "validation"]
    io.read_splits(spark, path).createOrReplaceTempView("stored_splits")
    assert io.read_splits(spark, "stored_splits").count() == 4
    plan = io.read_splits(spark, path).filter("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_union_typed_items(spark):
    items = ['"plain"', '{"question":"q","answer":"a","prompt":"p"}', '{"question":"q"}', '{"prompt":"p","answer":"x"}',
             '{"other":1}', "5", "null", "not json", '["list"]']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id int, item string")
    rows = io.normalize_prompts(df, "item", "id").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "plain", None), (1, "q", "a"), (2, "q", None), (3, "p", None)]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 12)], "precision double, support bigint")
    report = io.report_rows(df, "Scores").unionByName(io.report_rows(df.select("precision"), "More", 10))
    lines = [r["line"] for r in io.report_lines(report).collect()]
    assert lines == ["\n## Scores\n", "- **precision:** 1.0000", "- **support:** 12", "\n## More\n", "- **precision:** 1.0000"]
    io.write_report(io.report_lines(report), str(tmp_path / "report"))
    assert "- **support:** 12" in [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]


def test_leaderboard_text(spark):
    board = spark.createDataFrame([("m", 2, 4.0, 4.0, 1.054)], "run string, scored bigint, avg_score double, "
                                  "median_score double, std_dev double")
    assert evaluation.leaderboard_lines(board).first()["line"] == (
        "## m\n- **Average Score**: 4.00\n- **Median Score**: 4.0\n- **Standard Deviation**: 1.05")
