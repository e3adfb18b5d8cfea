"""Literal cases of converters, choices, weights, gates, parsers and artifact folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stepweave.functions import text as tx
from stepweave.operators import corruptions as co
from stepweave.operators import curation as cu
from stepweave.operators import pairs as pr
from stepweave.operators import recipes as rc
from stepweave.operators import reports as rp
from stepweave.operators import traces as tr
from stepweave.sources import artifacts as ar
from stepweave.sources import readers as rd


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "most", "want"), [(3, 5, [1, 2, 3]), (10, 1, [1]), (10, 2, [1, 10]), (10, 3, [1, 2, 10]), (10, 4, [1, 2, 6, 10]), (7, 5, [1, 2, 4, 5, 7]), (4, 3, [1, 2, 4])])
def test_diverse_places(spark, n, most, want):
    assert value(spark, cu.diverse_places(most, F.lit(n))) == want


def test_modes_of_one_trace(spark):
    rows = spark.createDataFrame([(1, list("++-+-"), [f"step number {i} of it" for i in range(5)]), (2, list("+++"), [f"a good step {i} is here" for i in range(3)])], "key int, signs array<string>, steps array<string>")
    places = lambda mode, most=3: [(p.good, p.bad, round(p.confidence, 2)) for p in rows.select(F.explode(pr.step_places(mode, F.col("signs"), most)).alias("p")).select("p.*").collect()]
    assert places("first_bad_edge_strict") == [(1, 2, 0.74)]
    assert places("first_bad_fanout") == [(1, 2, 0.74), (0, 2, 0.70)]
    assert places("all_good_vs_all_bad") == [(1, 2, 0.74), (0, 2, 0.70), (0, 4, 0.64)]
    assert places("legacy_nearest") == [(0, 2, 0.62), (1, 2, 0.62), (3, 2, 0.62)]
    both = pr.convert_steps(rows, "first_bad_edge_strict", F.lit("src"), F.lit("dom"), F.lit("Q"), anchors=True, places={"source_line": F.col("key")}).collect()
    assert {(r.key, r.good, r.bad, r.pair_semantics, r.split_group_id) for r in both} == {(1, 1, 2, "local_first_bad_edge", "src|source_line=1"), (2, 2, 1, "terminal_completion_anchor", "src|source_line=2"), (2, 2, 0, "terminal_completion_anchor", "src|source_line=2")}
    assert all(len(r.pair_id) == 20 and r.chosen.endswith("\n") for r in both)
    with pytest.raises(ValueError):
        pr.step_places("other", F.col("signs"), 1)


def test_history_follows_the_annotator(spark):
    kind = "key int, steps array<struct<completions:array<struct<text:string,rating:int>>,chosen_completion:int>>"
    steps = [([("first good way", 1), ("first bad way", -1)], None), ([("second plain way", 0), ("second good way", 1), ("second bad way", -1)], 0), ([("third bad way", -1)], 0), ([("fourth fine way", 0), ("fourth bad way", -1)], 7)]
    rows = spark.createDataFrame([(1, steps)], kind)
    got = pr.completion_pairs(rows, F.lit("s"), F.lit("d"), F.lit("Q"), most=5).orderBy("step").collect()
    assert [(r.step, r.chosen, r.rejected, r.confidence) for r in got] == [
        (0, "first good way\n", "first bad way\n", 0.78),
        (1, "first good way\nsecond good way\n", "first good way\nsecond bad way\n", 0.78),
        (3, "first good way\nsecond plain way\nthird bad way\nfourth fine way\n", "first good way\nsecond plain way\nthird bad way\nfourth bad way\n", 0.70),
    ]
    assert len(pr.completion_pairs(rows, F.lit("s"), F.lit("d"), F.lit("Q"), most=2).collect()) == 2
    policy = {r.policy: (r.pairs, r.zero_as_good) for r in pr.rating_policies(rows).collect()}
    assert policy == {"nonnegative": (3, 1), "strictly_positive": (2, 0)}


def test_mixed_index_bases_fail(spark):
    kind = "key int, original array<string>, modified array<string>, error_steps array<int>"
    ok = spark.createDataFrame([(1, ["aa", "b"], ["aa", "x"], [1, 2])], kind)
    assert [r.at for r in pr.with_index_base(ok).orderBy("at").collect()] == [0, 1]
    for bad in ([0, 2], [1]):
        with pytest.raises(Exception, match="mixed|ambiguous"):
            pr.with_index_base(spark.createDataFrame([(1, ["a", "b"], ["a", "x"], bad)], kind)).collect()


def test_weights_must_be_positive(spark):
    kind = "pair_id string, source_tag string, pair_confidence double, source_weight double, semantic_weight double, chosen_verdict string, mix_label string, pair_semantics string"
    rows = spark.createDataFrame([("a", "s", 0.5, 2.0, None, "yes", None, "k1"), ("b", "s", 1.0, None, 3.0, "no", "m", "k1"), ("c", "s", 1.0, None, None, "no", " ", "k1")], kind)
    weight = lambda mode: {r.pair_id: round(r.weight, 6) for r in rc.pair_weights(rows, mode).collect()}
    assert weight("confidence_semantic") == {"a": 1.0, "b": 3.0, "c": 1.0}
    assert weight("verdict_balance") == {"a": 3.0, "b": 0.75, "c": 0.75} and weight("group_balance") == {"a": 1.5, "b": 1.5, "c": 0.75}
    with pytest.raises(Exception, match="non-positive"):
        rc.pair_weights(rows.withColumn("source_weight", F.lit(0.0)), "none").collect()
    with pytest.raises(ValueError):
        rc.pair_weights(rows, "other")


def test_policy_families_have_their_sizes():
    sizes = {}
    for p in tr.policy_grid():
        sizes[p["family"]] = sizes.get(p["family"], 0) + 1
    assert sizes == {"baseline_immediate": 12, "threshold_only": 7, "delayed_drop": 36, "drop_needs_low": 48, "guarded_drop": 108, "two_strike": 36}


@pytest.mark.parametrize(("good", "bad", "most", "want"), [(10, 90, 10, (1, 9)), (50, 50, 4, (2, 2)), (99, 1, 10, (10, 1)), (0, 20, 5, (0, 5)), (3, 4, 9, (3, 4))])
def test_stratified_sizes(spark, good, bad, most, want):
    rows = spark.range(good + bad).select((F.col("id") >= good).alias("wrong"))
    assert tuple(cu.stratified_sizes(rows, F.col("wrong"), most).first()) == want


def test_strict_joins_and_risk(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert cu.joined(a, b, "k", skip_missing=True).count() == 1
    for rows in (cu.joined(a, b, "k"), cu.once(a.unionAll(a), "k")):
        with pytest.raises(Exception, match="no row|repeated"):
            rows.collect()
    risky = rc.recipe_risk(spark.createDataFrame([(2, 0.1, 0.0, 0.5, "logit", "semantic", "ranking_score")], "num_kinds int, terminal double, wide double, near double, space string, weights string, metric string"))
    assert [f.code for f in risky.first().findings] == ["ANTI_PATTERN_G_FULL", "LOGIT_MIXED_TERMINAL", "RANKING_SCORE_MIXED", "SEMANTIC_WEIGHT_MIXED_TERMINAL"]
    assert rc.enforce_risk(risky, "warn").first().max_severity == "critical"
    with pytest.raises(Exception, match="recipe risk"):
        rc.enforce_risk(risky, "error").collect()


def test_corruptions(spark):
    rows = spark.createDataFrame([(["All is well.", "Anna has 3 + 4 apples, yes"],), (["She is at least 5"],)], "lines array<string>").withColumn("q", F.lit("Where did Paul go?"))
    legacy = co.corrupted(rows, "lines", "legacy", 9).collect()
    assert [(r.kind, r.corrupted_step) for r in legacy] == [("binary_flip", "Anna has 3 + 4 apples, no"), ("operator_flip", "Anna has 3 - 4 apples, yes"), ("numeric_perturb", "Anna has 4 + 4 apples, yes"), ("step_drop", ""), ("numeric_perturb", "She is at least 6")]
    picked = co.corrupted(rows, "lines", "cqr_balanced", 3, 1, 1, "q").collect()
    assert [r.kind for r in picked] == ["negation_flip", "entity_substitution", "step_drop", "negation_flip", "comparator_flip", "entity_substitution"]
    assert picked[1].text == "All is well.\nWhere has 3 + 4 apples, yes" and picked[2].text == "All is well."


def test_json_lines_must_be_objects(spark):
    files = spark.createDataFrame([("a.jsonl", '{"x": 1}\n[2]')], "path string, content string")
    with pytest.raises(Exception, match="no object"):
        rd.json_objects(files).select(F.to_json("value")).collect()


def test_numbers_and_boxes(spark):
    cases = {"1/3": "0.3333333333333333333333333333", "2/3": "0.6666666666666666666666666667", "-10/4": "-2.5", "1e3": "1000", "12.3400": "12.34", "-0.0": "-0", "1e-2": "0.01", "nan": "NaN", "1__0": None, "": None, "7/0": None, "99999999999999999999999999995": "100000000000000000000000000000"}
    from decimal import Context, Decimal

    for text, want in cases.items():
        assert tx._as_number(text) == want, text
    for text in ("123.456", "0.000123", "9" * 40, "1" + "0" * 30 + "5", "55555555555555555555555555555", "5.5e-7", "314159265358979323846264338327950288e-20"):
        plain = format(Context(prec=28).create_decimal(Decimal(text)).normalize(Context(prec=28)), "f")
        assert tx._as_number(text) == (plain.rstrip("0").rstrip(".") if "." in plain else plain), text
    assert tx._boxed("a \\boxed{x{y}} \\boxed{}") == "" and tx._boxed("a \\boxed{x{y}} \\boxed{}", filled=True) == "x{y}"


def test_caches_and_checkpoints(spark, tmp_path):
    root, made = str(tmp_path), []

    def make():
        made.append(1)
        return spark.range(len(made))

    count = lambda mode: ar.cached(spark, make, root, "feat", {"b": 1, "a": [2]}, mode).count()
    assert [count("off"), count("read"), count("read_write"), count("read"), count("write"), count("read_write")] == [1, 2, 3, 3, 4, 4]
    assert ar.cache_key("n", {"a": 1, "b": 2}) == ar.cache_key("n", {"b": 2, "a": 1}) and ar.purge(spark, root, "feat") == 1
    with pytest.raises(ValueError):
        count("other")
    (tmp_path / "final.pt").write_text("x")
    manifest = {"output_files": {"best_value_head": f"{root}/best.pt", "final_value_head": f"{root}/final.pt"}}
    assert ar.resolve_checkpoint(spark, manifest, missing_policy="fallback_final")["fallback"] and ar.resolve_checkpoint(spark, manifest, "final")["resolved"] == "final"
    with pytest.raises(FileNotFoundError):
        ar.resolve_checkpoint(spark, manifest)
    with pytest.raises(FileNotFoundError):
        ar.required_files(spark, root, "*.parquet")
    assert [p.rpartition("/")[2] for p in ar.required_files(spark, root, "*.pt")] == ["final.pt"]
    assert ar.first_existing(spark, [(f"{root}/no", "a"), (root, "b")], ("x", "y")) == (root, "b")
    assert [(r.path.rpartition("/")[2], r.bytes) for r in ar.file_signatures(spark, root, "*.pt").collect()] == [("final.pt", 1)]


def test_recovery_and_stitching(spark):
    assert value(spark, rp.stitch(F.lit("a \n"), F.lit("  b"))) == "a\nb" and value(spark, rp.stitch(F.lit(" "), F.lit(" b"))) == "b"
    assert value(spark, rp.needs_recovery(F.lit("so we add"), "math", F.lit(True), F.lit(True))) and not value(spark, rp.needs_recovery(F.lit("so 4"), "math", F.lit(True), F.lit(True)))
