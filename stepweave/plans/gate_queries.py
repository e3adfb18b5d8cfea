"""Judges, gates, trust, weights, probes and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..operators import curation as cu
from ..operators import metrics as me
from ..operators import recipes as rc
from ..operators import reports as rp
from ..operators import traces as tr
from .curation_queries import KINDS_SQL, kinds
from .registry import d_pairs, d_rollouts, d_steps, d_traces, query, t
from .trace_queries import BUCKETS_SQL, rounded

TOKENS_SQL = "tk AS (SELECT source_tag, string_split(chosen_text, ' ') AS a, string_split(rejected_text, ' ') AS b FROM d_pairs), df AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]), true) - 1, len(a)) AS first FROM tk)"


@query("a28_f12_truncation", f"""WITH {TOKENS_SQL}, s AS (SELECT CASE WHEN grouping(source_tag) = 1 THEN '*' ELSE source_tag END AS source_tag, count(*) AS num_pairs, count(*) FILTER (len(a) > 12 OR len(b) > 12) AS over_limit, count(*) FILTER (a <> b AND first >= 12) AS identical_after_cut, count(*) FILTER (first >= 12) AS first_diff_after_cut, count(*) FILTER (a = b) AS originally_identical FROM df GROUP BY GROUPING SETS ((source_tag), ()))
SELECT *, array_to_string(list_filter([CASE WHEN over_limit > 0 THEN 'has_any_over_limit_pairs' END, CASE WHEN over_limit / num_pairs >= 0.10 THEN 'high_over_limit_fraction' END, CASE WHEN identical_after_cut > 0 THEN 'has_any_pairs_collapsing_after_truncation' END, CASE WHEN identical_after_cut / num_pairs >= 0.05 THEN 'high_pairs_collapsing_after_truncation_fraction' END, CASE WHEN first_diff_after_cut > 0 THEN 'has_any_first_diff_after_cutoff' END, CASE WHEN first_diff_after_cut / num_pairs >= 0.05 THEN 'high_first_diff_after_cutoff_fraction' END], lambda x: x IS NOT NULL), ',') AS flags,
  array_to_string(list_filter([CASE WHEN over_limit / num_pairs > 0.02 THEN format('over_limit_fraction={{:.4f}} exceeds 0.0200', over_limit / num_pairs) END, CASE WHEN identical_after_cut / num_pairs > 0.02 THEN format('collapse_after_cut_fraction={{:.4f}} exceeds 0.0200', identical_after_cut / num_pairs) END, CASE WHEN first_diff_after_cut / num_pairs > 0.02 THEN format('hidden_diff_after_cut_fraction={{:.4f}} exceeds 0.0200', first_diff_after_cut / num_pairs) END], lambda x: x IS NOT NULL), ', ') AS failures FROM s""")
def a28(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("source_tag", F.split("chosen_text", " ", -1).alias("chosen"), F.split("rejected_text", " ", -1).alias("rejected"))
    out = rc.truncation_failures(rc.truncation(p, 12, "source_tag"), 0.02)
    return out.withColumns({"flags": F.array_join("flags", ","), "failures": F.array_join("failures", ", ")})


@query("a28_lengths_by_source", f"""WITH {TOKENS_SQL}, v AS (SELECT source_tag, 'chosen' AS what, len(a) AS v FROM df UNION ALL SELECT source_tag, 'rejected', len(b) FROM df UNION ALL SELECT source_tag, 'first_diff', first FROM df), o AS (SELECT *, row_number() OVER (PARTITION BY source_tag, what ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY source_tag, what) AS n FROM v)
SELECT source_tag, what, count(*) AS count, round(avg(v), 9) AS mean, min(v) AS min, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) THEN v END) AS p90, max(CASE WHEN i = round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) THEN v END) AS p95, max(v) AS max FROM o GROUP BY source_tag, what""")
def a28_lengths(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("source_tag", F.split("chosen_text", " ", -1).alias("a"), F.split("rejected_text", " ", -1).alias("b"))
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("long")
    first = F.when(differs > 0, differs - 1).otherwise(F.size("a").cast("long"))
    long = p.select("source_tag", F.explode(F.array(*(F.struct(F.lit(n).alias("what"), c.cast("long").alias("v")) for n, c in (("chosen", F.size("a")), ("rejected", F.size("b")), ("first_diff", first))))).alias("x")).select("source_tag", "x.*")
    return rounded(rp.series_summary(long, "v", ["source_tag", "what"]))


JUDGED = """j AS (SELECT example_id, max(label) AS label, count(*) AS n, example_id % 7 <> 3 AS parsed, CASE WHEN min(CASE WHEN score < 0.3 THEN step END) IS NULL THEN 'correct' ELSE 'incorrect' END AS overall, min(CASE WHEN score < 0.3 THEN step END) + 1 AS fb FROM d_traces GROUP BY example_id)"""


@query("a29_judge_metrics", f"""WITH {JUDGED}, s AS (SELECT j.example_id, avg(CASE WHEN parsed AND ((fb IS NULL OR step + 1 < fb) = (d.label < 0 OR step < d.label)) THEN 1.0 ELSE 0 END) AS acc FROM j JOIN d_traces d ON d.example_id = j.example_id GROUP BY j.example_id)
SELECT count(*) AS n, round(avg(CASE WHEN parsed THEN 1.0 ELSE 0 END), 9) AS parse_ok_rate, round(avg(CASE WHEN parsed AND overall = CASE WHEN label < 0 THEN 'correct' ELSE 'incorrect' END THEN 1.0 ELSE 0 END), 9) AS overall_acc, round(avg(CASE WHEN parsed AND fb IS NOT DISTINCT FROM label + 1 THEN 1.0 ELSE 0 END) FILTER (label >= 0), 9) AS first_bad_exact,
  round(avg(CASE WHEN parsed AND coalesce(abs(fb - label - 1) <= 1, false) THEN 1.0 ELSE 0 END) FILTER (label >= 0), 9) AS first_bad_near, round(avg(acc), 9) AS mean_step_acc FROM j JOIN s ON s.example_id = j.example_id""")
def a29(spark, sf_dir):
    low = F.min(F.when(F.col("score") < 0.3, F.col("step")))
    j = d_traces(spark, sf_dir).groupBy("example_id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n_steps"), F.when(low.isNull(), "correct").otherwise("incorrect").alias("overall"), (low + 1).alias("first_bad"))
    return rounded(me.judge_report(j.withColumn("parsed", F.col("example_id") % 7 != 3)))


GATE_SQL = """s AS (SELECT *, lead(score, 1, 0.5) OVER (PARTITION BY example_id ORDER BY step) AS strong FROM d_traces),
m AS (SELECT CAST(tau AS DOUBLE) AS tau, example_id, step, label, CASE WHEN abs(score - 0.5) < tau THEN strong ELSE score END AS score, CASE WHEN abs(score - 0.5) < tau THEN 1.0 ELSE 0 END AS used FROM s, (VALUES (0.0), (0.1), (0.2), (0.3)) v(tau)),
k AS (SELECT *, label < 0 OR step < label AS good, rank() OVER (PARTITION BY tau ORDER BY score) + (count(*) OVER (PARTITION BY tau, score) - 1) / 2.0 AS r, lag(score) OVER (PARTITION BY tau, example_id ORDER BY step) AS prev FROM m),
a AS (SELECT tau, avg(used) AS usage, (sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)) AS auc, avg(CASE WHEN prev > score THEN 1.0 ELSE 0 END) FILTER (label > 0 AND step = label) AS edge FROM k GROUP BY tau)"""


@query("a31_weak_strong_gate", f"WITH {GATE_SQL} SELECT tau, round(usage, 9) AS usage_rate, round(auc, 9) AS auc, round(edge, 9) AS edge_accuracy, row_number() OVER (ORDER BY round(auc, 12) DESC, round(edge, 12) DESC, usage) = 1 AS best FROM a")
def a31(spark, sf_dir):
    s = d_traces(spark, sf_dir).withColumn("strong", F.lead("score", 1, 0.5).over(W.partitionBy("example_id").orderBy("step")))
    # a copy of the rows for each threshold, of which there are few: ranks differ between them
    m = s.withColumn("tau", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3)))))
    near = F.abs(F.col("score") - 0.5) < F.col("tau")
    m = m.select("tau", "example_id", "step", "label", F.when(near, F.col("strong")).otherwise(F.col("score")).alias("score"), near.cast("double").alias("used"))
    prev = F.lag("score").over(W.partitionBy("tau", "example_id").orderBy("step"))
    edge = F.avg(F.when((F.col("label") > 0) & (F.col("step") == F.col("label")), (F.col("prev") > F.col("score")).cast("double")))
    sums = m.withColumn("prev", prev).groupBy("tau").agg(F.avg("used").alias("usage_rate"), edge.alias("edge_accuracy"))
    auc = tr.auc(tr.with_goodness(m), F.col("is_good"), by=["tau"]).select("tau", "auc")
    out = sums.join(auc, "tau")
    order = W.orderBy(F.round("auc", 12).desc(), F.round("edge_accuracy", 12).desc(), "usage_rate")  # a row for each threshold
    return rounded(out.withColumn("best", F.row_number().over(order) == 1))


SEEDS_SQL = """sd AS (SELECT o_orderpriority AS grp, o_orderstatus AS seed, avg(o_totalprice) / 200000 AS pair_acc, avg(o_custkey % 1000) / 600 AS auc, count(*) / 10000.0 AS ranking, avg(o_orderkey % 100) / 80 AS gsm_pair_acc, avg(o_orderkey % 50) / 40 AS gsm_auc, CASE WHEN o_orderpriority[1] = '1' AND o_orderstatus = 'P' THEN NULL ELSE avg(o_custkey % 10) / 8 END AS math_pair_acc, avg(o_custkey % 9) / 7 AS math_auc FROM orders GROUP BY 1, 2),
sg AS (SELECT grp, count(*) AS n, avg(pair_acc) AS mp, avg(auc) AS ma, avg(ranking) AS mr, CASE WHEN count(*) > 1 THEN stddev_pop(pair_acc) END AS sp, CASE WHEN count(*) > 1 THEN stddev_pop(auc) END AS sa, min(pair_acc) AS wp, min(auc) AS wa, bool_and(gsm_pair_acc IS NOT NULL AND gsm_auc IS NOT NULL) AS hg, bool_and(math_pair_acc IS NOT NULL AND math_auc IS NOT NULL) AS hm, avg(gsm_pair_acc) AS gp, avg(gsm_auc) AS ga, avg(math_pair_acc) AS tp, avg(math_auc) AS ta, arg_min(seed, struct_pack(s := -SCORE, k := seed)) AS best FROM sd GROUP BY grp)"""
NOTES = """list_filter([CASE WHEN NOT hg THEN 'Missing required benchmark metrics: gsm' END, CASE WHEN NOT hm THEN 'Missing required benchmark metrics: math' END, CASE WHEN mp < 0.7 THEN 'mean held-out pair_acc below threshold' END, CASE WHEN ma < 0.7 THEN 'mean held-out auc below threshold' END, CASE WHEN wp < 0.6 THEN 'worst-seed held-out pair_acc below threshold' END, CASE WHEN wa < 0.6 THEN 'worst-seed held-out auc below threshold' END, CASE WHEN sp > 0.05 THEN 'held-out pair_acc seed std above threshold' END, CASE WHEN sa > 0.05 THEN 'held-out auc seed std above threshold' END,
 CASE WHEN hg AND gp < 0.5 THEN 'gsm mean pair_acc below threshold' END, CASE WHEN hg AND ga < 0.5 THEN 'gsm mean auc below threshold' END, CASE WHEN hm AND tp < 0.5 THEN 'math mean pair_acc below threshold' END, CASE WHEN hm AND ta < 0.5 THEN 'math mean auc below threshold' END], lambda x: x IS NOT NULL)"""
STEADY = "0.0{w} * (1 - least(coalesce(sp, 0), 1)) + 0.0{w} * (1 - least(coalesce(sa, 0), 1))"


def trust_sql(policy: str) -> str:
    score = "(0.40 * ranking + 0.25 * auc + 0.15 * (coalesce(gsm_pair_acc, 0) + coalesce(math_pair_acc, 0)) / 2 + 0.20 * (coalesce(gsm_auc, 0) + coalesce(math_auc, 0)) / 2)" if policy == "hybrid" else "(0.45 * pair_acc + 0.30 * auc + 0.25 * ranking)"
    trust = f"0.30 * mr + 0.20 * ma + 0.20 * (gp + tp) / 2 + 0.20 * (ga + ta) / 2 + {STEADY.format(w=5)}" if policy == "hybrid" else f"0.35 * mp + 0.30 * ma + 0.20 * mr + {STEADY.format(w=75)}"
    return f"""WITH {SEEDS_SQL.replace('SCORE', score)} SELECT grp, n AS num_seeds, round(mp, 9) AS mean_pair_acc, round(ma, 9) AS mean_auc, round(mr, 9) AS mean_ranking, round(sp, 9) AS std_pair_acc, round(sa, 9) AS std_auc, round(wp, 9) AS worst_pair_acc, round(wa, 9) AS worst_auc, hg AND hm AS eligible, hg AND hm AND len({NOTES}) = 0 AS gate_pass, round(CASE WHEN hg AND hm THEN {trust} END, 9) AS trust_score, CASE WHEN hg AND hm THEN best END AS best_seed, array_to_string({NOTES}, '; ') AS notes FROM sg"""


def seeds(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g = o.groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("seed")).agg((F.avg("o_totalprice") / 200000).alias("pair_acc"), (F.avg(c % 1000) / 600).alias("auc"), (F.count(F.lit(1)) / 10000.0).alias("ranking"), (F.avg(k % 100) / 80).alias("gsm_pair_acc"), (F.avg(k % 50) / 40).alias("gsm_auc"), (F.avg(c % 10) / 8).alias("math_pair_acc"), (F.avg(c % 9) / 7).alias("math_auc"))
    return g.withColumn("math_pair_acc", F.when(~(F.col("grp").startswith("1") & (F.col("seed") == "P")), F.col("math_pair_acc")))


@query("a36_seed_groups_hybrid", trust_sql("hybrid"))
def a36(spark, sf_dir):
    return rounded(rc.seed_groups(seeds(spark, sf_dir), ["gsm", "math"]).withColumn("notes", F.array_join("notes", "; ")))


@query("a36_seed_groups_heldout_only", trust_sql("heldout_only"))
def a36_heldout(spark, sf_dir):
    return rounded(rc.seed_groups(seeds(spark, sf_dir), ["gsm", "math"], "heldout_only").withColumn("notes", F.array_join("notes", "; ")))


UPLIFT_SQL = """c AS (SELECT n_regionkey, count(*) > 0 AS there, avg(c_acctbal) / 8000 AS pair_acc, avg(c_custkey % 100) / 90 AS auc, avg(c_acctbal) / 20000 AS brier FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 24 GROUP BY 1),
s AS (SELECT n_nationkey, n_regionkey, avg(s_acctbal) / 8000 AS pair_acc, CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE avg(s_suppkey % 100) / 90 END AS auc, avg(s_acctbal) / 19000 AS brier, CASE WHEN n_nationkey % 3 = 0 THEN avg(s_acctbal) / 9000 - 0.5 END AS gain FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
j AS (SELECT s.n_nationkey, s.n_nationkey % 9 <> 1 AS ct, s.n_nationkey % 11 <> 2 AS gt, c.pair_acc AS cp, c.auc AS ca, c.brier AS cb, s.pair_acc AS gp, s.auc AS ga, s.brier AS gb, s.gain FROM s JOIN c ON c.n_regionkey = s.n_regionkey)"""


@query("a38_uplift_gate", f"""WITH {UPLIFT_SQL}, r AS (SELECT n_nationkey, CASE WHEN NOT ct OR NOT gt THEN list_filter([CASE WHEN NOT ct THEN 'missing_d6_control_group' END, CASE WHEN NOT gt THEN 'missing_d6_gated_group' END], lambda x: x IS NOT NULL)
  WHEN cp IS NULL OR gp IS NULL OR ca IS NULL OR ga IS NULL THEN ['missing_d6_pair_metrics']
  ELSE list_filter([CASE WHEN NOT gp > cp THEN 'd6_no_pair_uplift' END, CASE WHEN NOT ga > ca THEN 'd6_no_auc_uplift' END, CASE WHEN gp < 0.55 THEN 'd6_pair_acc_below_threshold' END, CASE WHEN ga < 0.55 THEN 'd6_auc_below_threshold' END, CASE WHEN gain IS NOT NULL AND NOT gain > 0 THEN 'd6_calibration_not_beating_baseline' END, CASE WHEN gain IS NULL AND NOT coalesce(gb <= 0.25, false) THEN 'd6_calibration_not_beating_trivial_brier' END, CASE WHEN gb - cb > 0.02 THEN 'd6_brier_regression_too_large' END], lambda x: x IS NOT NULL) END AS reasons FROM j)
SELECT n_nationkey, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM r""")
def a38(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = t(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey <> 24").groupBy("n_regionkey").agg((F.avg("c_acctbal") / 8000).alias("c_pair_acc"), (F.avg(F.col("c_custkey") % 100) / 90).alias("c_auc"), (F.avg("c_acctbal") / 20000).alias("c_brier"))
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.avg("s_acctbal") / 8000).alias("g_pair_acc"), (F.avg(F.col("s_suppkey") % 100) / 90).alias("g_auc"), (F.avg("s_acctbal") / 19000).alias("g_brier"), (F.avg("s_acctbal") / 9000 - 0.5).alias("g_gain"))
    k = F.col("n_nationkey")
    j = n.join(s, "n_nationkey", "left").join(c, "n_regionkey").withColumns({"g_auc": F.when(k % 8 != 3, F.col("g_auc")), "g_gain": F.when(k % 3 == 0, F.col("g_gain")), "c_there": k % 9 != 1, "g_there": k % 11 != 2})
    return rc.uplift_gate(j).select("n_nationkey", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("a38_seed_gate", """WITH d AS (SELECT o_orderpriority AS grp, o_orderstatus AS seed, avg(o_totalprice) / 200000 AS p, avg(o_custkey % 1000) / 600 AS a FROM orders GROUP BY 1, 2),
g AS (SELECT grp, count(*) AS n, avg(p) AS mp, avg(a) AS ma, stddev_pop(p) AS sp, stddev_pop(a) AS sa FROM d WHERE NOT (grp[1] = '2' AND seed = 'P') GROUP BY grp),
w AS (SELECT x.grp, g.* EXCLUDE (grp) FROM (SELECT DISTINCT grp FROM d UNION ALL SELECT 'none at all') x LEFT JOIN g ON g.grp = x.grp),
r AS (SELECT grp, CASE WHEN n IS NULL THEN ['missing_d6t_group:' || grp] ELSE list_filter([CASE WHEN n < 3 THEN 'd6t_seed_count_low:' || grp END, CASE WHEN NOT coalesce(mp >= 0.6, false) THEN 'd6t_mean_pair_fail:' || grp END, CASE WHEN NOT coalesce(ma >= 0.6, false) THEN 'd6t_mean_auc_fail:' || grp END, CASE WHEN NOT coalesce(sp <= 0.05, false) THEN 'd6t_std_pair_fail:' || grp END, CASE WHEN NOT coalesce(sa <= 0.05, false) THEN 'd6t_std_auc_fail:' || grp END], lambda x: x IS NOT NULL) END AS reasons FROM w)
SELECT grp, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM r""")
def a38_seeds(spark, sf_dir):
    s = seeds(spark, sf_dir)
    g = s.where("not (grp like '2%' and seed = 'P')").groupBy("grp").agg(F.count(F.lit(1)).alias("seed_count"), F.avg("pair_acc").alias("mean_pair_acc"), F.avg("auc").alias("mean_auc"), F.stddev_pop("pair_acc").alias("std_pair_acc"), F.stddev_pop("auc").alias("std_auc"))
    asked = s.select("grp").distinct().unionAll(spark.range(1).select(F.lit("none at all").alias("grp")))
    return rc.seed_gate(asked.join(g, "grp", "left")).select("grp", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("a42_pool_findings", f"""WITH p AS (SELECT source_tag, pair_confidence, {KINDS_SQL} AS kind FROM d_pairs WHERE source_tag <> 'src0' OR semantics = 'terminal'),
s AS (SELECT source_tag, count(*) AS num_pairs, avg(pair_confidence) AS mc, count(DISTINCT kind) AS num_kinds, avg(CASE WHEN kind = 'terminal_completion_anchor' THEN 1.0 ELSE 0 END) AS tf, bool_or(kind = 'local_first_bad_edge') AS l, bool_or(kind = 'sibling_branch') AS sb FROM p GROUP BY source_tag)
SELECT source_tag, num_pairs, round(mc, 9) AS mean_confidence, num_kinds, round(tf, 9) AS terminal_fraction, array_to_string(list_filter([CASE WHEN NOT l THEN 'missing_local_first_bad_edge' END, CASE WHEN NOT sb THEN 'missing_sibling_branch' END, CASE WHEN tf > 0.2 THEN format('terminal_fraction_high:{{:.3f}}', tf) END, CASE WHEN num_kinds <= 1 THEN 'single_semantics_pool' END], lambda x: x IS NOT NULL), ',') AS findings FROM s""")
def a42(spark, sf_dir):
    p = kinds(d_pairs(spark, sf_dir).where((F.col("source_tag") != "src0") | F.coalesce(F.col("semantics") == "terminal", F.lit(False))))
    return rounded(rc.pool_findings(p, "source_tag").withColumn("findings", F.array_join("findings", ",")))


@query("a43_teacher_score_summary", "SELECT generator, round(avg(m), 9) AS mean_score, round(min(m), 9) AS min_score, round(max(m), 9) AS max_score, round(avg(n), 9) AS mean_num_steps FROM (SELECT generator, example_id, avg(score) AS m, count(*) AS n FROM d_traces GROUP BY 1, 2) GROUP BY generator")
def a43(spark, sf_dir):
    e = d_traces(spark, sf_dir).groupBy("generator", "example_id").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    return rounded(rc.score_summary(e, "generator", "m", "n"))


@query("a43_consensus_ratios", "SELECT count(*) AS num_pairs, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS teacher_pair_available_ratio, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END), 9) AS pair_consensus_pass_ratio, round(avg(CASE WHEN d.n_chars > 500 THEN 1.0 ELSE 0 END), 9) AS pair_pass_gate_ratio FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a43_consensus(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    flags = d.select(F.col("quality").isNotNull().alias("teacher_pair_available"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("pair_consensus_pass"), (F.col("n_chars") > 500).alias("pair_pass_gate"))
    return rounded(rc.consensus_ratios(flags, flags.columns))


@query("a44_frontier_rows", """WITH r AS (SELECT n_nationkey AS k, n_name AS label, n_regionkey AS rg FROM nation), u AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT s_nationkey AS k, avg(s_acctbal) / 6000 AS f FROM supplier WHERE s_nationkey % 5 > 0 GROUP BY 1),
h AS (SELECT k, 0.5 + k / 100.0 AS acc FROM r WHERE k % 4 > 1), cv AS (SELECT c_nationkey AS k, arg_min((c_custkey % 100) / 100.0, struct_pack(s := -c_acctbal, e := c_custkey)) AS acc FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1),
x AS (SELECT r.*, u.n, p.f, h.acc AS ha, cv.acc AS ca, CASE WHEN r.k % 3 > 0 THEN r.k / 25.0 END AS g, CASE WHEN r.k % 6 > 0 THEN 0.6 + r.k / 200.0 END AS m FROM r LEFT JOIN u ON u.k = r.k LEFT JOIN p ON p.k = r.k LEFT JOIN h ON h.k = r.k LEFT JOIN cv ON cv.k = r.k)
SELECT label, n AS train_pairs, round(coalesce(ha, ca), 9) AS heldout_pair_acc, round(f, 9) AS samefamily_first_bad, round(g, 9) AS gsm_auc, round(g / 2, 9) AS gsm_f1, round(m / 2, 9) AS math_auc, round(m, 9) AS math_f1, array_to_string(list_filter([CASE WHEN m < 0.67 THEN format('math_f1_low:{:.3f}', CAST(m AS DOUBLE)) END, CASE WHEN f IS NULL THEN 'samefamily_missing' END, CASE WHEN f < 0.85 THEN format('samefamily_first_bad_low:{:.3f}', f) END, CASE WHEN g IS NULL THEN 'gsm_benchmark_missing' END, CASE WHEN m IS NULL THEN 'math_benchmark_missing' END, CASE WHEN n IS NOT NULL AND k % 2 = 0 THEN 'no_local_first_bad_training_semantics' END, CASE WHEN ha IS NULL THEN 'heldout_source:' || CASE WHEN ca IS NULL THEN 'missing' ELSE 'train_curve_best_eval' END END], lambda z: z IS NOT NULL), ',') AS findings FROM x""")
def a44(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    of = lambda table, key: t(spark, sf_dir, table).join(F.broadcast(n), F.col(key) == F.col("k"))
    c = of("customer", "c_nationkey")
    recipe = c.groupBy("label").agg(F.count(F.lit(1)).alias("num_pairs"), (F.max("k") % 2 != 0).alias("has_local"))
    same = of("supplier", "s_nationkey").where("k % 5 > 0").groupBy("label").agg((F.avg("s_acctbal") / 6000).alias("first_bad"))
    gsm = n.where("k % 3 > 0").select("label", (F.col("k") / 25.0).alias("auc"), (F.col("k") / 25.0 / 2).alias("f1"))
    math = n.where("k % 6 > 0").select("label", ((0.6 + F.col("k") / 200.0) / 2).alias("auc"), (0.6 + F.col("k") / 200.0).alias("f1"))
    held = n.where("k % 4 > 1").select("label", (0.5 + F.col("k") / 100.0).alias("pair_acc"))
    curve = c.where("k % 4 > 0").select("label", F.col("c_custkey").alias("epoch"), (F.col("c_custkey") % 100 / 100.0).alias("pair_acc"), F.col("c_acctbal").alias("selection_value"))
    return rounded(rc.frontier(n.select("label"), recipe, same, gsm, math, held, curve).withColumn("findings", F.array_join("findings", ",")))


ATTACK_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in rc.ATTACKS.items())


@query("a45_attack_report", f"""WITH ak AS (SELECT * FROM (VALUES {ATTACK_VALUES}) v(attack, tail)), tx AS (SELECT d.doc_id, d.source, t.label, d.step, d.line FROM d_steps d JOIN d_traces t ON t.example_id = d.doc_id AND t.step = d.step),
pr AS (SELECT a.source, 'first_bad' AS probe_group, a.line AS text, b.line AS safe FROM tx a JOIN tx b ON a.doc_id = b.doc_id AND a.label > 0 AND a.step = a.label AND b.step = a.label - 1 UNION ALL SELECT source, 'all_correct_final', line, NULL FROM tx WHERE label < 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1),
sc AS (SELECT source, probe_group, attack, ('0x' || substr(sha256(text), 1, 8))::BIGINT / 4294967296.0 AS base, ('0x' || substr(sha256(text || tail), 1, 8))::BIGINT / 4294967296.0 AS att, ('0x' || substr(sha256(safe), 1, 8))::BIGINT / 4294967296.0 AS safe FROM pr, ak),
s AS (SELECT source, probe_group, attack, count(*) AS count, avg(att - base) AS md, quantile_cont(att - base, 0.5) AS me, quantile_cont(att - base, 0.9) AS p9, avg(CASE WHEN base < 0.5 AND att >= 0.5 THEN 1.0 ELSE 0 END) AS fl, avg(CASE WHEN safe IS NULL THEN NULL WHEN att >= safe THEN 1.0 ELSE 0 END) AS ou FROM sc GROUP BY 1, 2, 3)
SELECT source, probe_group, attack, count, round(md, 9) AS mean_delta, round(me, 9) AS median_delta, round(p9, 9) AS p90_delta, round(fl, 9) AS flip_rate, round(ou, 9) AS outrank_rate, CASE WHEN probe_group = 'first_bad' AND (fl >= 0.10 OR ou >= 0.10) THEN 'high' WHEN probe_group = 'first_bad' AND (md >= 0.03 OR fl >= 0.03) THEN 'medium' WHEN probe_group <> 'first_bad' AND md >= 0.08 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def a45(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    labels = d_traces(spark, sf_dir).where("step = 0").select(F.col("example_id").alias("doc_id"), "label")
    k = F.col("label")
    one = docs.select("doc_id", "source", kept.alias("l")).join(labels, "doc_id").where("label <> 0")
    probes = one.select("source", F.when(k > 0, "first_bad").otherwise("all_correct_final").alias("probe_group"), F.when(k > 0, F.get("l", k)).otherwise(F.try_element_at("l", F.lit(-1))).alias("text"), F.when(k > 0, F.get("l", k - 1)).alias("safe_text"))
    scored = rc.attacked(probes).select("source", "probe_group", "attack", unit_hash(F.col("text"), 8).alias("base"), unit_hash(F.col("attacked_text"), 8).alias("attacked_score"), unit_hash(F.col("safe_text"), 8).alias("safe"))
    return rounded(rc.attack_report(scored, ["source"]))


@query("a46_best_of_n", """WITH e AS (SELECT example_id // 4 AS question, example_id AS sample, avg(score) AS score, max(label) < 0 AS ok FROM d_traces GROUP BY example_id),
q AS (SELECT question, arg_min(ok, sample) AS g, arg_min(ok, sha256('random:' || question || ':' || sample)) AS r, arg_min(ok, struct_pack(s := -score, k := sample)) AS p, bool_or(ok) AS o FROM e GROUP BY question)
SELECT count(*) AS n, round(avg(CASE WHEN g THEN 1.0 ELSE 0 END), 9) AS greedy, round(avg(CASE WHEN r THEN 1.0 ELSE 0 END), 9) AS random, round(avg(CASE WHEN p THEN 1.0 ELSE 0 END), 9) AS reranked, round(avg(CASE WHEN o THEN 1.0 ELSE 0 END), 9) AS oracle FROM q""")
def a46(spark, sf_dir):
    e = d_traces(spark, sf_dir).groupBy(F.col("example_id").alias("sample")).agg(F.avg("score").alias("score"), (F.max("label") < 0).alias("ok")).withColumn("question", F.floor(F.col("sample") / 4))
    return rounded(me.best_of_n(e, "question", "sample", "score", "ok"))


@query("a47_training_health", """WITH e AS (SELECT user_id % 200 AS run, event_id AS epoch, value / 400 AS loss, (event_id % 97) / 150.0 + 0.2 AS acc, (event_id % 89) / 120.0 AS auc FROM events),
h AS (SELECT run, count(*) AS epochs, max(loss) - min(loss) AS lr, stddev_pop(loss) AS ls, arg_max(loss, epoch) - arg_min(loss, epoch) AS ld, arg_max(acc, epoch) - arg_min(acc, epoch) AS ad, arg_max(auc, epoch) - arg_min(auc, epoch) AS ud, max(acc) AS acc, arg_max(auc, struct_pack(a := acc, e := epoch)) AS auc FROM e WHERE run % 7 > 0 GROUP BY run),
x AS (SELECT *, (run % 13) / 500.0 AS mm, (run % 5) / 10.0 AS mc, (run % 3) / 10.0 AS mj FROM h),
f AS (SELECT *, epochs >= 2 AND abs(ld) <= 0.03 AND lr <= 0.05 AS flat, abs(mm) <= 0.01 AS tiny, mc <= mj AS turned, abs(acc - 0.5) <= 0.03 AND abs(auc - 0.5) <= 0.03 AS rnd, acc < 0.47 OR auc < 0.47 AS inv, ad <= 0.01 AND ud <= 0.01 AS still FROM x)
SELECT run, round(lr, 9) AS loss_range, round(ls, 9) AS loss_std, round(ld, 9) AS loss_delta, array_to_string(list_filter([CASE WHEN flat THEN 'flat_loss' END, CASE WHEN tiny THEN 'tiny_margin' END, CASE WHEN turned THEN 'score_inversion' END, CASE WHEN rnd THEN 'near_random_pair_metrics' END, CASE WHEN inv THEN 'pair_metric_inversion' END, CASE WHEN still THEN 'no_eval_improvement' END], lambda z: z IS NOT NULL), ',') AS flags, CASE WHEN (flat AND tiny) OR (turned AND inv) OR (flat AND rnd) THEN 'collapse_detected' WHEN inv OR turned THEN 'unstable_or_inverted' WHEN rnd THEN 'weak_signal' ELSE 'healthy_or_undetermined' END AS diagnosis FROM f""")
def a47(spark, sf_dir):
    e = F.col("event_id")
    curve = t(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("run"), e.alias("epoch"), (F.col("value") / 400).alias("loss"), (e % 97 / 150.0 + 0.2).alias("pair_acc"), (e % 89 / 120.0).alias("auc")).where("run % 7 > 0")
    best = curve.groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.max("pair_acc").alias("pair_acc"), F.max_by("auc", F.struct("pair_acc", "epoch")).alias("auc"))
    r = F.col("run")
    x = rc.training_health(curve).join(best, "run").withColumns({"mean_margin": r % 13 / 500.0, "mean_chosen": r % 5 / 10.0, "mean_rejected": r % 3 / 10.0})
    return rounded(rc.diagnosis(x).select("run", "loss_range", "loss_std", "loss_delta", F.array_join("flags", ",").alias("flags"), "diagnosis"))


COMMANDS = """cm AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'RUN_PREFIX=p' || event_id || ' CUDA_VISIBLE_DEVICES=' || event_id % 4 || '  python run.py --run-name r' || event_id || ' --kind ' || event_type || ' --seed ' || user_id WHEN 1 THEN 'python eval.py --out 20260313T' || lpad(CAST(event_id % 240000 AS VARCHAR), 6, '0') || 'Z --kind ' || event_type ELSE 'ls ' || event_type END AS command, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'killed' ELSE 'success' END AS status, ts FROM events)"""


@query("a48_command_families", COMMANDS.replace("cm AS", "WITH cm AS") + r""", f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(command, '\bRUN_PREFIX=\S+', 'RUN_PREFIX=<RUN_PREFIX>', 'g'), '\bCUDA_VISIBLE_DEVICES=\S+', 'CUDA_VISIBLE_DEVICES=<GPU_SET>', 'g'), '(--run-name\s+)\S+', '\1<RUN_NAME>', 'g'), '(--seed\s+)\S+', '\1<SEED>', 'g'), '\b\d{8}T\d{6}Z\b', '<TS>', 'g'), '\s+', ' ', 'g')) AS family FROM cm)
SELECT family, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status <> 'success') AS failures, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_run FROM f GROUP BY family""")
def a48(spark, sf_dir):
    i, e = F.col("event_id"), F.col("event_type")
    s = lambda c: c.cast("string")
    a = F.concat(F.lit("RUN_PREFIX=p"), s(i), F.lit(" CUDA_VISIBLE_DEVICES="), s(i % 4), F.lit("  python run.py --run-name r"), s(i), F.lit(" --kind "), e, F.lit(" --seed "), s(F.col("user_id")))
    b = F.concat(F.lit("python eval.py --out 20260313T"), F.lpad(s(i % 240000), 6, "0"), F.lit("Z --kind "), e)
    rows = t(spark, sf_dir, "events").select("event_id", "ts", F.when(i % 3 == 0, a).when(i % 3 == 1, b).otherwise(F.concat(F.lit("ls "), e)).alias("command"), F.when(i % 4 == 0, "failed").when(i % 4 == 1, "killed").otherwise("success").alias("status"))
    return rp.command_families(rows, "command", "event_id", "ts")


WEIGHED = f"""w AS (SELECT pair_id, source_tag, pair_confidence AS c, {KINDS_SQL} AS kind, CASE step % 3 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 2.0 END AS sw, CASE WHEN semantics = 'terminal' THEN 0.5 END AS kw, CASE step % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN '' END AS verdict, CASE WHEN step % 5 = 0 THEN 'mix' || step % 2 END AS mix FROM d_pairs),
v AS (SELECT *, lower(trim(coalesce(verdict, ''))) AS vd, coalesce(nullif(trim(mix), ''), kind, source_tag) AS gr FROM w),
u AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY vd) AS cv, (SELECT count(DISTINCT vd) FROM v WHERE vd <> '') AS kv, count(*) OVER (PARTITION BY gr) AS cg, (SELECT count(DISTINCT gr) FROM v) AS kg FROM v)"""
FACTORS = {"confidence": "c", "semantic": "coalesce(kw, 1.0)", "verdict_balance": "CASE WHEN vd = '' THEN 1.0 ELSE n / (kv * cv) END", "group_balance": "n / (kg * cg)"}


def weights_sql(mode: str) -> str:
    parts = [FACTORS[k] for k in FACTORS if (k == "confidence" and mode.startswith(k)) or (k != "confidence" and mode.endswith(k))]
    return f"WITH {WEIGHED} SELECT pair_id, round({' * '.join([*parts, 'coalesce(sw, 1.0)'])}, 9) AS weight FROM u"


def weighed(spark, sf_dir):
    s = F.col("step")
    p = kinds(d_pairs(spark, sf_dir))
    return p.select("pair_id", "source_tag", "pair_confidence", "pair_semantics", F.when(s % 3 == 0, 0.5).when(s % 3 == 2, 2.0).alias("source_weight"), F.when(F.col("semantics") == "terminal", 0.5).alias("semantic_weight"), F.when(s % 4 == 0, " Yes").when(s % 4 == 1, "no").when(s % 4 == 2, "").alias("chosen_verdict"), F.when(s % 5 == 0, F.concat(F.lit("mix"), (s % 2).cast("string"))).alias("mix_label"))


for _mode in rc.PAIR_WEIGHT_MODES:

    @query(f"g26_weights_{_mode}", weights_sql(_mode))
    def g26_mode(spark, sf_dir, mode=_mode):
        return rounded(rc.pair_weights(weighed(spark, sf_dir), mode).select("pair_id", "weight"))


@query("g27_route_weights", f"""SELECT pair_id, CAST(CASE WHEN r = 'local' THEN 1 WHEN r = 'terminal' THEN 0 WHEN r = 'both' THEN 0.5 WHEN k = 'terminal_completion_anchor' THEN 0 WHEN k = 'good_bad_prefix_grid' THEN 0.5 ELSE 1 END AS DOUBLE) AS local, CAST(CASE WHEN r = 'local' THEN 0 WHEN r = 'terminal' THEN 1 WHEN r = 'both' THEN 0.5 WHEN k = 'terminal_completion_anchor' THEN 1 WHEN k = 'good_bad_prefix_grid' THEN 0.5 ELSE 0 END AS DOUBLE) AS terminal FROM (SELECT pair_id, {KINDS_SQL} AS k, CASE step % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'terminal' WHEN 2 THEN 'both' WHEN 3 THEN 'odd' END AS r FROM d_pairs)""")
def g27(spark, sf_dir):
    s = F.col("step") % 6
    p = kinds(d_pairs(spark, sf_dir)).withColumn("route", F.when(s == 0, " LOCAL").when(s == 1, "terminal").when(s == 2, "Both ").when(s == 3, "odd"))
    return p.select("pair_id", rc.route_weights(F.col("route"), F.col("pair_semantics")).alias("w")).select("pair_id", "w.*")


HARD_SQL = f"""h AS (SELECT example_id, max(label) AS label, max(n) AS n, max(CASE WHEN step = label - 1 THEN score END) AS safe, max(CASE WHEN step = label THEN score END) AS bad, max(CASE WHEN step > label THEN score END) AS later, arg_max(step, struct_pack(s := score, k := -step)) FILTER (step > label) AS later_step FROM (SELECT *, count(*) OVER (PARTITION BY example_id) AS n FROM d_traces) WHERE label > 0 GROUP BY example_id),
z AS (SELECT *, CASE WHEN (label + 1) / n <= 1 / 3.0 THEN 'early' WHEN (label + 1) / n <= 2 / 3.0 THEN 'mid' ELSE 'late' END AS bucket FROM h),
c AS (SELECT 'edge_fail' AS kind, example_id, bucket, label - 1 AS good, label AS bad, safe - bad AS gap FROM z WHERE safe <= bad UNION ALL SELECT 'laterbad_fail', example_id, bucket, label - 1, later_step, safe - later FROM z WHERE safe <= later)"""


@query("g23_hard_slices", f"WITH {HARD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY example_id) AS i FROM c) SELECT example_id || '::' || kind AS pair_id, bucket AS error_bucket, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, round(gap, 9) AS score_gap FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY i, bucket) <= 60")
def g23(spark, sf_dir):
    return rounded(tr.hard_slices(d_traces(spark, sf_dir), 60))


@query("j5_j6_joined_scores", "SELECT d.example_id, d.step, round(d.score, 9) AS score, l.quality FROM d_traces d JOIN labels l ON l.doc_id = d.example_id WHERE d.step < 5")
def j5(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), "quality")
    return rounded(cu.joined(d_traces(spark, sf_dir).where("step < 5").select("example_id", "step", "score"), lab, "example_id", skip_missing=True))


@query("j9_changed_predictions", """WITH a AS (SELECT user_id AS id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS said FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS said FROM events WHERE event_id % 2 = 1 AND user_id % 5 > 0 GROUP BY 1)
SELECT count(*) AS shared, count(*) FILTER (a.said <> b.said) AS changed FROM a JOIN b ON a.id = b.id""")
def j9(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    last = lambda rows: rows.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("said"))
    return cu.changed(last(e.where("event_id % 2 = 0")), last(e.where("event_id % 2 = 1 and user_id % 5 > 0")), "id", "said")


TARGETS_SQL = """g AS (SELECT prefix_id, count(*) AS k, count(*) FILTER (is_correct) AS c FROM d_rollouts GROUP BY prefix_id), b AS (SELECT *, (c + 1.0) / (k + 2.0) AS q FROM g), e AS (SELECT *, sqrt(q * (1 - q) / (k + 3.0)) AS se FROM b),
i AS (SELECT *, greatest(0.0, least(1.0, q - 1.96 * se)) AS lo, greatest(0.0, least(1.0, q + 1.96 * se)) AS hi FROM e)"""


@query("j4_clean_against_corrupt", f"""WITH {TARGETS_SQL}, r AS (SELECT split_part(prefix_id, ':', 1) AS u, split_part(prefix_id, ':', 2) AS e, q, se, greatest(1 - least(hi - lo, 1.0), 0) AS w FROM i),
m AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, event_type AS corrupt FROM events WHERE event_type <> 'view'), tc AS (SELECT doc_id, CAST(quality AS DOUBLE) AS q FROM labels),
p AS (SELECT m.u, m.corrupt, a.q - b.q AS d, sqrt(a.se * a.se + b.se * b.se) AS s, a.w AS w1, b.w AS w2, x.q AS qt, CASE WHEN y.q IS NOT NULL THEN y.q * 0.5 END AS qc FROM m JOIN r a ON a.u = m.u AND a.e = 'view' JOIN r b ON b.u = m.u AND b.e = m.corrupt LEFT JOIN tc x ON x.doc_id = CAST(m.u AS BIGINT) LEFT JOIN tc y ON y.doc_id = CAST(m.u AS BIGINT) + 1),
z AS (SELECT *, d / greatest(s, 1e-8) AS z, qt IS NOT NULL AND qc IS NOT NULL AS av FROM p), k AS (SELECT *, d >= 0.02 AND z >= 0.2 AS mc FROM z)
SELECT u AS user_id, corrupt, round(d, 9) AS delta_q, round(z, 9) AS z_delta, av AS teacher_available, mc AS gate_mc, CASE WHEN av THEN mc AND qt - qc >= 0.1 AND (d >= 0) = (qt - qc >= 0) ELSE mc END AS gate FROM k""")
def j4(spark, sf_dir):
    r = me.rollout_targets(d_rollouts(spark, sf_dir)).select(F.substring_index("prefix_id", ":", 1).alias("u"), F.substring_index("prefix_id", ":", -1).alias("e"), "q", "se", "weight")
    corrupt = t(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("corrupt")).distinct()
    teacher = t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("u"), F.col("quality").cast("double").alias("tq"))
    out = me.consensus_pairs(corrupt, r.where("e = 'view'").drop("e"), r.withColumnRenamed("e", "corrupt"), teacher, teacher.select((F.col("u").cast("long") - 1).cast("string").alias("u"), (F.col("tq") * 0.5).alias("tc")))
    return rounded(out.select(F.col("u").alias("user_id"), "corrupt", "delta_q", "z_delta", "teacher_available", "gate_mc", "gate"))


@query("a7_j3_teacher_join_report", f"""WITH {TARGETS_SQL}, x AS (SELECT CAST(split_part(prefix_id, ':', 1) AS BIGINT) AS u, min(q) AS q FROM i GROUP BY 1), j AS (SELECT x.q, CAST(l.quality AS DOUBLE) AS t FROM x LEFT JOIN labels l ON l.doc_id = x.u)
SELECT count(*) AS num_targets, count(t) AS num_joined, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT u FROM x)) AS num_extra, round(count(t) / count(*), 9) AS coverage, round(count(*) FILTER (abs(q - t) >= 0.3) / nullif(count(t), 0), 9) AS disagree_ratio, round(avg(q), 9) AS mean_q_mc, round(avg(t), 9) AS mean_q_teacher, round(avg(0.5 * q + 0.5 * t), 9) AS mean_q_fused FROM j""")
def a7_report(spark, sf_dir):
    x = me.rollout_targets(d_rollouts(spark, sf_dir)).groupBy(F.substring_index("prefix_id", ":", 1).cast("long").alias("id")).agg(F.min("q").alias("q"))
    return rounded(me.teacher_join_report(x, t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("teacher"))))


@query("f8_f9_contrastive_filters", f"""WITH {TARGETS_SQL}, x AS (SELECT prefix_id, hi - lo AS width, q, k, c FROM i), y AS (SELECT prefix_id, greatest(0, 1 - width) AS conf, c / k AS parse, q - 0.4 AS dq, (q - 0.4) * 10 AS z, q AS w, c > 2 AS gate FROM x)
SELECT prefix_id, conf >= 0.4 AS by_confidence, parse >= 0.5 AS by_parseable, conf >= 0.4 AND parse >= 0.5 AS by_both, dq >= 0.1 AND z >= 0.5 AND w >= 0.3 AND gate AS by_label, conf >= 0.4 AND parse >= 0.5 AND dq >= 0.1 AND z >= 0.5 AND w >= 0.3 AND gate AS by_all, dq BETWEEN -0.1 AND 0.3 AS in_band FROM y""")
def f8(spark, sf_dir):
    r = me.rollout_targets(d_rollouts(spark, sf_dir))
    q = F.col("q")
    y = r.select("prefix_id", F.greatest(F.lit(0.0), 1 - F.col("ci_width")).alias("confidence"), F.col("success_rate").alias("parseable"), (q - 0.4).alias("delta_q"), ((q - 0.4) * 10).alias("z_delta"), q.alias("weight"), (F.col("n_correct") > 2).alias("gate"))
    rule = lambda mode: cu.contrastive(mode, confidence_min=0.4, parseable_min=0.5, delta_min=0.1, z_min=0.5, weight_min=0.3, need_gate=True)
    return y.select("prefix_id", rule("confidence").alias("by_confidence"), rule("parseable").alias("by_parseable"), rule("confidence_parseable").alias("by_both"), rule("label_quality").alias("by_label"), rule("confidence_parseable_label").alias("by_all"), cu.in_band(F.col("delta_q"), -0.1, 0.3).alias("in_band"))


@query("f15_compact_results", r"""WITH l AS (SELECT doc_id, step, CASE step % 4 WHEN 0 THEN 'accuracy   : ' || step WHEN 1 THEN 'Loading checkpoint shards: ' || step || '%' WHEN 2 THEN line ELSE 'run name : r' || doc_id END AS line FROM d_steps WHERE step < 8)
SELECT doc_id, max(CASE WHEN step = 4 THEN '4' WHEN step = 0 THEN '0' END) AS accuracy, max(CASE WHEN step % 4 = 3 THEN 'r' || doc_id END) AS run_name FROM l GROUP BY doc_id""")
def f15(spark, sf_dir):
    s = F.col("step")
    line = F.when(s % 4 == 0, F.concat(F.lit("accuracy   : "), s.cast("string"))).when(s % 4 == 1, F.concat(F.lit("Loading checkpoint shards: "), s.cast("string"), F.lit("%"))).when(s % 4 == 2, F.concat(F.lit("progress 3it/s "), F.col("line"))).otherwise(F.concat(F.lit("run name : r"), F.col("doc_id").cast("string")))
    kept = rp.compact_results(d_steps(spark, sf_dir).where("step < 8").withColumn("line", line), "doc_id", "step", "line")
    return kept.groupBy("doc_id").agg(F.max(F.when(F.col("key") == "accuracy", F.col("value"))).alias("accuracy"), F.max(F.when(F.col("key") == "run name", F.col("value"))).alias("run_name"))
