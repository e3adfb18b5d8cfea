from __future__ import annotations

import json

from pyspark.sql import functions as F

from stepweave.operators import pairs, reports
from stepweave.sources import readers
from stepweave.streaming import windows


def test_load_by_name(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in [{"idx": 1, "question": "q", "answer": "why\n#### 3"}, {"idx": 2, "question": "r", "answer": "4"}, {"idx": 3, "question": " ", "answer": "x"}]))
    got = readers.load(spark, "gsm8k", str(tmp_path / "a.jsonl"), "json").collect()
    assert [(r.id, r.answer, r.cot) for r in sorted(got)] == [("gsm8k:1", "3", "why"), ("gsm8k:2", "4", None)]
    try:
        readers.load(spark, "unknown", "x")
        raise AssertionError
    except KeyError:
        pass


def test_other_readers(spark):
    yes = spark.createDataFrame([("a", "q?", "True", ["one", " two "]), ("b", "r?", "no", [])], "qid string, question string, answer string, decomposition array<string>")
    assert [(r.answer, r.cot) for r in readers.yes_no_questions(yes).orderBy("id").collect()] == [("yes", "- one\n- two"), ("no", None)]
    choice = spark.createDataFrame([(1, "c", "q", ["x", "y"], 1)], "idx int, context string, query string, options array<string>, correct_option int")
    assert readers.multiple_choice(choice).first().answer == "y"
    drop = spark.createDataFrame([("1", "p", None, ["s"]), ("2", "p", "q", ["t", "u"])], "query_id string, passage string, question string, spans array<string>")
    assert [r.question for r in readers.passages(drop).orderBy("id").collect()] == ["Passage: p", "Passage: p\nQuestion: q"]
    lines = spark.createDataFrame([(i, "" if i % 3 == 0 else f"v{i}") for i in range(24)], "line_no int, value string")
    assert [(r.idx, r.context, r.options[0], r.correct_option) for r in readers.eight_line_records(lines, 5).orderBy("idx").collect()] == [(0, "v4.", "v7", -1), (1, "v16.", "v19", -1)]
    raw = ["", "b.", "It isn\\'t  so", "Is it?", "A. x", "B. y", "z", "D. w"]
    one = readers.eight_line_records(spark.createDataFrame(list(enumerate(["q", *raw[1:], "left over"])), "line_no int, value string")).first()
    assert (one.context, one.query, one.options, one.correct_option) == ("It isn't so.", "Is it?", ["x", "y", "z", "w"], 1)


def test_artifacts(spark, tmp_path):
    rows = spark.range(3)
    path = readers.write_artifact(rows, str(tmp_path), {"b": 1, "a": 2})
    assert path == readers.write_artifact(rows.limit(1), str(tmp_path), {"a": 2, "b": 1}) and spark.read.parquet(path).count() == 3
    readers.write_artifact(rows.limit(1), str(tmp_path), {"a": 2, "b": 1}, overwrite=True)
    assert spark.read.parquet(path).count() == 1


def test_pair_converters(spark):
    rows = spark.createDataFrame([(1, list("++--")), (2, list("-+")), (3, list("+++")), (4, ["+"])], "key int, signs array<string>")
    assert [tuple(r)[:3] for r in pairs.first_bad_edge(rows).collect()] == [(1, 1, 2)]
    assert {(r.key, r.good, r.bad) for r in pairs.terminal_anchors(rows).collect()} == {(3, 2, 1), (3, 2, 0)}
    grid = {(r.good, r.bad): round(r.confidence, 2) for r in pairs.all_good_vs_all_bad(rows).collect()}
    assert grid == {(1, 2): 0.74, (0, 2): 0.70, (1, 3): 0.71, (0, 3): 0.67}
    rated = spark.createDataFrame([(1, [[("g", 1), ("b", -1)], [("z", 0), ("w", -1)], [("x", 1), ("y", 0)]])], "key int, completions array<array<struct<text:string,rating:int>>>")
    assert [(r.step, r.chosen, r.rejected, r.confidence) for r in pairs.rated_pairs(rated).orderBy("step").collect()] == [(0, "g", "b", 0.78), (1, "z", "w", 0.70)]
    errors = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "y"], [2, 9])], "key int, original array<string>, modified array<string>, error_steps array<int>")
    got = pairs.error_step_pairs(errors, one_based=True).collect()
    assert [(r.at, r.chosen, r.rejected) for r in got] == [(1, "a\nb\n", "a\nx\n")]
    assert pairs.index_base(errors).first().base == "one"


def test_streams(spark, tmp_path):
    scores = [(1, 0, 0.9), (1, 1, 0.2), (1, 2, 0.1), (2, 0, 0.8), (2, 1, 0.75), (3, 0, 0.5)]
    spark.createDataFrame(scores, "example_id long, step int, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("example_id long, step int, score double").parquet(str(tmp_path / "in"))
    q = windows.stop_stream(stream).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.example_id, r.stop) for r in spark.table("stops").collect()} == {(1, 1), (2, 0), (3, 0)}


def test_distance_of_distributions(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    d = reports.distribution(a, "k", ["x", "y", "z"])
    assert {r.key: round(r.share, 3) for r in d.collect()} == {"x": 0.667, "y": 0.333, "z": 0.0}
    assert round(reports.l1_distance(d, d.withColumn("share", F.lit(0.0))).first().l1, 6) == 1.0
