"""Literal cases of text functions, statistics and hashes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stepweave.functions import hashing, stats, text
from stepweave.operators import curation, metrics, prompts, traces


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("kind", "before", "after"),
    [
        ("operator_flip", "so 3 + 4 is 7", "so 3 - 4 is 7"), ("negation_flip", "it is red", "it is not red"), ("negation_flip", "it Was  not red", "it Was red"), ("condition_reversal", "if wet", "if not wet"),
        ("condition_reversal", "If not wet, if x", "If wet, if x"), ("comparator_swap", "At least 3", "At most 3"), ("numeric_perturb", "x 2.5 y 3", "x 3.5 y 3"), ("numeric_perturb", "x -3", "x -2"), ("binary_flip", "YES, no", "NO, no"), ("binary_flip", "maybe", None),
    ],
)
def test_mutations(spark, kind, before, after):
    assert value(spark, text.MUTATIONS[kind](F.lit(before))) == after


def test_answers(spark):
    assert tuple(value(spark, text.extract_yes_no(F.lit("noHuman: yes")))) == ("no", "strategyqa_yes_no", False)
    assert tuple(value(spark, text.extract_yes_no(F.lit("Answer: yes. Final answer - NO")))) == ("no", "strategyqa_final_answer_tag", False)
    assert tuple(value(spark, text.extract_math(F.lit("Final answer is: $1,250 apples\nfoo")))) == ("1250", "final_answer_tag", False)
    assert tuple(value(spark, text.extract_math(F.lit(r"x \boxed{a{b}c} y \boxed{z")))) == ("a{b}c", "boxed", False)
    assert value(spark, text.canonical_number(F.lit("`1/3`"))) == "0.3333333333333333333333333333"
    assert value(spark, text.canonical_number(F.lit("1/0"))) is None
    assert value(spark, text.relaxed_number(F.lit("75% of"))) == "75"
    assert value(spark, text.equivalent(F.lit("10 meters"), F.lit("10.0"), "math"))
    assert value(spark, text.equivalent(F.lit("TRUE."), F.lit("yes"), "binary"))


def test_steps(spark):
    assert value(spark, text.split_steps(F.lit("One. Two! three"))) == ["One.", "Two!", "three"]
    assert value(spark, text.split_steps(F.lit("- One\r\n2) two\n\n(c) Step 3: three"))) == ["One", "two", "Step 3: three"]
    assert value(spark, text.split_steps(F.lit("One.\nTwo is. Three"), "sentence")) == ["One.", "Two is.", "Three"]
    assert [tuple(x) for x in value(spark, text.step_labels(F.lit("Q\nStep 1: a +\nStep 2: b -")))] == [("Step 1: a", "+"), ("Step 2: b", "-")]
    assert value(spark, text.problem_prefix(F.lit("Do  it. STEP 1: x step 2: y"))) == "Do it."


def test_hash_numbers(spark):
    got = [round(value(spark, hashing.unit_hash(F.lit(f"42:{k}"))), 6) for k in "abc"]
    assert got == [0.590138, 0.772025, 0.430086]


def test_beta_rate(spark):
    b = value(spark, stats.beta_rate(F.lit(3), F.lit(4)))
    assert [round(x, 6) for x in b] == [0.666667, 0.178174, 0.317445, 1.0, 0.682555, 0.317445]
    assert value(spark, stats.beta_rate(F.lit(0), F.lit(0))).q == 0
    clean, bad = stats.beta_rate(F.lit(3), F.lit(4)), stats.beta_rate(F.lit(0), F.lit(4))
    q = value(spark, metrics.pair_quality(clean["q"], clean["se"], clean["weight"], bad["q"], bad["se"], bad["weight"]))
    assert (round(q.delta_q, 6), round(q.se_delta, 6), round(q.z_delta, 4)) == (0.5, 0.227128, 2.2014)


T = [(0, 1, [0.9, 0.2, 0.1]), (1, -1, [0.8, 0.7]), (2, 2, [0.9, 0.8, 0.3, 0.85]), (3, 0, [0.4, 0.6])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(e, i, s, lab) for e, lab, ss in T for i, s in enumerate(ss)], "example_id int, step int, score double, label int")


def test_traces(rows):
    p = traces.pair_counts(rows).agg(F.sum("pairs"), F.sum("right")).first()
    assert tuple(p) == (6, 5)
    assert traces.edges(rows).where("safe > bad").count() == 2
    assert round(traces.auc(traces.with_goodness(rows), F.col("is_good")).first().auc, 9) == 0.9
    grid = traces.observed_grid(rows, 5)
    f1 = {round(r.threshold, 3): round(r.f1, 6) for r in traces.f1_by_threshold(rows, grid.select("threshold")).collect()}
    assert f1[0.5] == 1.0 and f1[0.3] == 0.8
    stops = {r.example_id: (r.stop, r.right) for r in traces.judged(traces.stops(rows, (F.col("score") < 0.35) | (F.col("drop") > 0.15))).collect()}
    assert stops == {0: (1, True), 1: (0, False), 2: (2, True), 3: (0, True)}


@pytest.mark.parametrize(("scores", "want"), [([(0.8, 1), (0.7, 1), (0.6, 1), (0.2, 0), (0.3, 0), (0.4, 0)], 1.0), ([(0.5, 1), (0.5, 0), (0.9, 1), (0.5, 0)], 0.75), ([(0.5, 1), (0.7, 1)], 0.5)])
def test_auc(spark, scores, want):
    df = spark.createDataFrame(scores, "score double, y int")
    assert traces.auc(df, F.col("y") == 1).first().auc == want


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.9, 1.0), (0.8, 1.0), (0.2, 0.0)], "p double, y double")
    r = metrics.calibration(df, "p", "y").first()
    assert round(r.brier, 9) == 0.025 and round(r.ece, 9) == 0.15
    flat = spark.createDataFrame([(0.5, 1.0), (0.5, 1.0)], "p double, y double")
    assert metrics.calibration(flat, "p", "y").first().pearson == 0


def test_isotonic(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0), (0.5, 1.0)], "x double, y double")
    got = {r.right_edge: r.value for r in metrics.isotonic_blocks(df, "x", "y").collect()}
    assert got == {0.1: 0.0, 0.3: 0.5, 0.5: 1.0}
    fitted = metrics.apply_isotonic(df, "x", [0.1, 0.3, 0.5], [0.0, 0.5, 1.0]).orderBy("x").collect()
    assert [r.fitted for r in fitted] == [0.5, 0.5, 1.0, 1.0, 1.0]


def test_quotas(spark):
    shares = spark.createDataFrame([("a", 0.45), ("b", 0.35), ("c", 0.2)], "k string, s double")
    assert {r.k: r.quota for r in curation.largest_remainder(shares, "k", "s", 10).collect()} == {"a": 5, "b": 3, "c": 2}
    assert value(spark, curation.spread_places(4, F.lit(10))) == [1, 4, 7, 10]
    assert value(spark, curation.spread_places(5, F.lit(11))) == [1, 3, 6, 9, 11]
    rows = spark.createDataFrame([(f"l{i}", "L") for i in range(6)] + [(f"t{i}", "T") for i in range(2)], "id string, b string")
    assert {r.b: r.n for r in curation.round_robin_cap(rows, "b", "id", 4).groupBy("b").agg(F.count("*").alias("n")).collect()} == {"L": 2, "T": 2}


def test_group_split_never_leaves_a_side_empty(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "u string")
    for share in (0.0, 1.0):
        got = {r.split for r in curation.group_split(rows, "u", validation=share).collect()}
        assert got == {"train", "validation"}


def test_prompts(spark):
    x = value(spark, prompts.split_target(F.lit("think\nmore\nAnswer: yes"), ["Answer:"]))
    assert tuple(x) == ("think\nmore", "yes", True)
    assert tuple(value(spark, prompts.split_target(F.lit("so Answer: 3 and on\nend"), ["Answer:"])))[1:] == ("3 and on\nend", True)
    assert value(spark, prompts.last_lines(F.lit("a\n\nb\nc"), 2)) == "b\nc"
    assert value(spark, prompts.target_text("cot_then_answer", F.lit(" "), F.lit("7"), "A: ")) == "A: 7"


def test_strict_and_checked(spark):
    rows = spark.createDataFrame([(1,), (-1,)], "v int")
    good, bad = curation.checked(rows, [("positive", F.col("v") > 0)])
    assert good.count() == 1 and bad.first().reason == "positive"
    with pytest.raises(Exception, match="broken rule: positive"):
        curation.strict(rows, [("positive", F.col("v") > 0)]).collect()
