"""Accuracy, calibration, rollout targets, trust curves, gates and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import metrics as me
from .registry import d_pairs, d_predictions, d_rollouts, d_traces, query, t
from .trace_queries import rounded


@query("a1_accuracy_report", """
WITH p AS (SELECT dataset, quality = 1 AND predicted OR quality = 0 AND NOT predicted AS ok, parse_error AS bad FROM d_predictions),
g AS (SELECT CASE WHEN grouping(dataset) = 1 THEN '*' ELSE dataset END AS dataset, count(*) AS n_total, count(*) FILTER (ok) AS n_correct, count(*) FILTER (bad) AS n_parse_error, count(*) FILTER (ok AND NOT bad) AS okp FROM p GROUP BY GROUPING SETS ((dataset), ()))
SELECT dataset, n_total, n_correct, n_parse_error, n_total - n_parse_error AS n_parseable, round(n_correct / n_total, 9) AS accuracy, round(n_parse_error / n_total, 9) AS parse_error_rate, round(coalesce(okp / nullif(n_total - n_parse_error, 0), 0), 9) AS accuracy_parseable FROM g""")
def a1(spark, sf_dir):
    p = d_predictions(spark, sf_dir)
    return rounded(me.accuracy_report(p, (F.col("quality") == 1) == F.col("predicted"), F.col("parse_error"), "dataset"))


@query("a2_a42_counts_by", """SELECT 'source_tag' AS dimension, source_tag AS value, count(*) AS n FROM d_pairs GROUP BY source_tag UNION ALL SELECT 'domain_tag', domain_tag, count(*) FROM d_pairs GROUP BY domain_tag UNION ALL SELECT 'semantics', coalesce(semantics, 'unspecified'), count(*) FROM d_pairs GROUP BY coalesce(semantics, 'unspecified')""")
def a2(spark, sf_dir):
    return me.counts_by(d_pairs(spark, sf_dir), ["source_tag", "domain_tag", "semantics"])


TARGETS_SQL = """g AS (SELECT prefix_id, count(*) AS k, count(*) FILTER (is_correct) AS c, count(*) FILTER (parse_error) AS pe, avg(chars) AS mc FROM d_rollouts GROUP BY prefix_id),
b AS (SELECT *, (c + 1.0) / (k + 2.0) AS q FROM g),
e AS (SELECT *, sqrt(q * (1 - q) / (k + 3.0)) AS se FROM b),
i AS (SELECT *, greatest(0.0, least(1.0, q - 1.96 * se)) AS lo, greatest(0.0, least(1.0, q + 1.96 * se)) AS hi FROM e)"""


@query("a3_a4_rollout_targets", f"WITH {TARGETS_SQL} SELECT prefix_id, k AS k_rollouts, c AS n_correct, pe AS n_parse_error, round(mc, 9) AS mean_chars, round(c / k, 9) AS success_rate, round(1 - pe / k, 9) AS parseable_rate, round(q, 9) AS q, round(se, 9) AS se, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(hi - lo, 9) AS ci_width, round(greatest(1 - least(hi - lo, 1.0), 0), 9) AS weight FROM i")
def a3(spark, sf_dir):
    return rounded(me.rollout_targets(d_rollouts(spark, sf_dir)))


@query("a6_pair_quality", f"""WITH {TARGETS_SQL}, r AS (SELECT split_part(prefix_id, ':', 1) AS u, split_part(prefix_id, ':', 2) AS e, q, se, greatest(1 - least(hi - lo, 1.0), 0) AS w FROM i),
p AS (SELECT a.u, a.q - b.q AS d, sqrt(a.se * a.se + b.se * b.se) AS s, a.w AS w1, b.w AS w2 FROM r a JOIN r b ON a.u = b.u AND a.e = 'purchase' AND b.e = 'view'),
z AS (SELECT *, d / greatest(s, 1e-8) AS z FROM p)
SELECT u AS user_id, round(d, 9) AS delta_q, round(s, 9) AS se_delta, round(z, 9) AS z_delta, d >= 0.1 AND z >= 1.0 AS gate, round(greatest(0, least(1, (0.5 * greatest(0, least(1, d)) + 0.5 * greatest(0, least(1, z / 5))) * sqrt(w1 * w2) * CASE WHEN d >= 0.1 AND z >= 1.0 THEN 1.0 ELSE 0.5 END)), 9) AS weight FROM z""")
def a6(spark, sf_dir):
    # both sides of a pair have the same user: one aggregate by user and type, then conditional picks instead of a self-join
    r = me.rollout_targets(d_rollouts(spark, sf_dir)).withColumn("u", F.substring_index("prefix_id", ":", 1)).withColumn("e", F.substring_index("prefix_id", ":", -1))
    pick = lambda e, c: F.max(F.when(F.col("e") == e, F.col(c)))
    p = r.groupBy("u").agg(*(pick(e, c).alias(f"{c}{n}") for n, e in ((1, "purchase"), (2, "view")) for c in ("q", "se", "weight"))).where("q1 is not null and q2 is not null")
    x = me.pair_quality(*(F.col(c) for c in ("q1", "se1", "weight1", "q2", "se2", "weight2")))
    return rounded(p.select(F.col("u").alias("user_id"), x.alias("x")).select("user_id", "x.*"))


@query("a7_j3_teacher_fusion", f"""WITH {TARGETS_SQL}, u AS (SELECT CAST(split_part(prefix_id, ':', 1) AS BIGINT) AS user_id, prefix_id, q, hi - lo AS width FROM i)
SELECT u.prefix_id, l.quality IS NOT NULL AS has_teacher, round(CASE WHEN l.quality IS NULL THEN q ELSE greatest(0, least(1, 1 - width / 0.6)) * q + (1 - greatest(0, least(1, 1 - width / 0.6))) * l.quality END, 9) AS q_fused, coalesce(abs(q - l.quality) >= 0.3, false) AS disagree FROM u LEFT JOIN labels l ON u.user_id = l.doc_id""")
def a7(spark, sf_dir):
    u = me.rollout_targets(d_rollouts(spark, sf_dir)).withColumn("doc_id", F.substring_index("prefix_id", ":", 1).cast("long"))
    j = u.join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("teacher")), "doc_id", "left")
    return rounded(j.select("prefix_id", F.col("teacher").isNotNull().alias("has_teacher"), me.fuse(F.col("q"), F.col("teacher"), F.col("ci_width"), 0.6).alias("q_fused"), F.coalesce(F.abs(F.col("q") - F.col("teacher")) >= 0.3, F.lit(False)).alias("disagree")))


@query("a9_calibration", """
WITH p AS (SELECT generator, score AS p, CASE WHEN label < 0 OR step < label THEN 1.0 ELSE 0.0 END AS y FROM d_traces),
e AS (SELECT generator, sum(g) AS gap FROM (SELECT generator, abs(sum(p) - sum(y)) AS g FROM p GROUP BY generator, least(CAST(floor(p * 10) AS INTEGER), 9)) GROUP BY generator),
s AS (SELECT generator, count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(abs(p - y)) AS mae, var_pop(y) AS base, CASE WHEN var_pop(y) > 1e-15 AND var_pop(p) > 1e-15 THEN corr(p, y) ELSE 0 END AS pearson FROM p GROUP BY generator)
SELECT s.generator, n, round(brier, 9) AS brier, round(sqrt(brier), 9) AS rmse, round(mae, 9) AS mae, round(pearson, 9) AS pearson, round(gap / n, 9) AS ece, round(base, 9) AS base_brier, round(base - brier, 9) AS brier_gain FROM s JOIN e ON s.generator = e.generator""")
def a9(spark, sf_dir):
    y = F.when((F.col("label") < 0) | (F.col("step") < F.col("label")), 1.0).otherwise(0.0)
    return rounded(me.calibration(d_traces(spark, sf_dir).withColumn("y", y), "score", "y", by=["generator"]))


@query("a10_margin_summary", """WITH m AS (SELECT generator, step, score - lead(score) OVER (PARTITION BY example_id ORDER BY step) AS margin FROM d_traces)
SELECT generator, count(*) AS n, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0 END), 9) AS pair_accuracy, round(avg(CASE WHEN margin >= 0 THEN 1.0 ELSE 0 END), 9) AS with_ties, round(avg(margin), 9) AS mean_margin, round(quantile_cont(margin, 0.5), 9) AS median_margin FROM m WHERE margin IS NOT NULL GROUP BY generator""")
def a10(spark, sf_dir):
    m = d_traces(spark, sf_dir).withColumn("margin", F.col("score") - F.lead("score").over(W.partitionBy("example_id").orderBy("step"))).where("margin is not null")
    return rounded(me.margin_summary(m, "margin", ["generator"]))


@query("a22_utility", """WITH e AS (SELECT doc_id || ':' || step AS c, doc_id || ':' || (step + 1) AS r, pair_confidence AS w FROM d_pairs),
s AS (SELECT c AS candidate, w AS won, w FROM e UNION ALL SELECT r, 0, w FROM e) SELECT candidate, round(sum(won) / sum(w), 9) AS utility, count(*) AS degree FROM s GROUP BY candidate""")
def a22(spark, sf_dir):
    d, s = F.col("doc_id").cast("string"), F.col("step")
    e = d_pairs(spark, sf_dir).select(F.concat_ws(":", d, s.cast("string")).alias("chosen"), F.concat_ws(":", d, (s + 1).cast("string")).alias("rejected"), "pair_confidence")
    return rounded(me.utility(e, F.col("pair_confidence")))


POOL_SQL = """k AS (SELECT example_id, step, score, step % 5 AS gold, lead(score) OVER w AS nxt, row_number() OVER w AS n, max(step % 5) OVER (PARTITION BY example_id) AS best, count(*) OVER (PARTITION BY example_id) AS c FROM d_traces WINDOW w AS (PARTITION BY example_id ORDER BY score DESC, step DESC)),
pools AS (SELECT example_id, step, c AS n, gold = best AS top1, best - gold AS regret, coalesce(score - nxt, 0) AS gap FROM k WHERE n = 1 AND c > 1)"""


@query("a23_w9_pool_top1", f"WITH {POOL_SQL} SELECT example_id, step, n, top1, regret, round(gap, 9) AS gap FROM pools")
def a23(spark, sf_dir):
    return rounded(me.top_by_pool(d_traces(spark, sf_dir).withColumn("gold", F.col("step") % 5), "example_id", "score", "gold", "step"))


@query("a24_coverage_curve", f"""WITH {POOL_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY gap DESC, example_id DESC) AS i, count(*) OVER () AS al FROM pools)
SELECT CAST(coverage AS DOUBLE) AS coverage, count(*) AS n, round(count(*) / max(al), 9) AS actual_coverage, round(min(gap), 9) AS threshold, round(avg(CASE WHEN top1 THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(regret), 9) AS mean_regret FROM r, (VALUES (1.0), (0.8), (0.6), (0.4), (0.2)) v(coverage) WHERE i <= greatest(1, round_even(CAST(coverage AS DOUBLE) * al, 0)) GROUP BY coverage""")
def a24(spark, sf_dir):
    pools = me.top_by_pool(d_traces(spark, sf_dir).withColumn("gold", F.col("step") % 5), "example_id", "score", "gold", "step")
    return rounded(me.coverage_curve(pools, "example_id", [1.0, 0.8, 0.6, 0.4, 0.2]))


@query("a25_pressure_curve", """WITH h AS (SELECT example_id, rep, score, step, (step % 5) / 4.0 AS gold, row_number() OVER (PARTITION BY example_id, rep ORDER BY sha256(rep || ':' || step)) AS n, count(*) OVER (PARTITION BY example_id, rep) AS c FROM d_traces, range(0, 4) r(rep)),
s AS (SELECT size, example_id, rep, arg_max(gold, struct_pack(a := score, b := step)) AS picked, max(gold) AS best FROM h, (VALUES (2), (3), (4), (6), (8)) v(size) WHERE n <= size AND c >= size GROUP BY size, example_id, rep)
SELECT size, count(*) AS n, round(avg(CASE WHEN abs(best - picked) <= 1e-9 THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(best - picked), 9) AS mean_regret FROM s GROUP BY size""")
def a25(spark, sf_dir):
    rows = d_traces(spark, sf_dir).withColumn("gold", (F.col("step") % 5) / 4.0)
    return rounded(me.pressure_curve(rows, "example_id", "step", "score", "gold", [2, 3, 4, 6, 8]))


@query("a23_j13_local_trust", """WITH g AS (SELECT example_id, step, score, label, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, step DESC) AS i FROM d_traces WHERE label > 0),
p AS (SELECT a.example_id, count(*) AS pairs, count(*) FILTER (a.score > b.score) AS ok FROM g a JOIN g b ON a.example_id = b.example_id AND a.step < a.label AND b.step >= b.label GROUP BY a.example_id),
e AS (SELECT a.example_id, count(*) FILTER (a.score > b.score) AS ok FROM g a JOIN g b ON a.example_id = b.example_id AND a.step = a.label - 1 AND b.step = b.label GROUP BY a.example_id)
SELECT g.example_id, label AS first_bad, step = label - 1 AS last_safe_on_top, CAST(1 AS BIGINT) AS edges, e.ok AS edges_right, p.pairs, p.ok AS pairs_right FROM g JOIN p ON p.example_id = g.example_id JOIN e ON e.example_id = g.example_id WHERE i = 1""")
def a23_local(spark, sf_dir):
    good = F.col("step") < F.col("label")
    nodes = d_traces(spark, sf_dir).where("label >= 0").select("example_id", F.col("step").alias("id"), "score", F.when(good, F.col("step")).alias("max_safe"), F.when(~good, F.col("step")).alias("min_bad"))
    return me.local_trust(nodes, "example_id")


@query("a30_majority_vote", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN greatest(a, b, s) = 0 THEN 'parse_error' WHEN (a = greatest(a, b, s))::INT + (b = greatest(a, b, s))::INT + (s = greatest(a, b, s))::INT > 1 THEN 'tie' WHEN a = greatest(a, b, s) THEN 'click' WHEN b = greatest(a, b, s) THEN 'view' ELSE 'signup' END AS verdict, greatest(a, b, s) AS voices FROM c""")
def a30(spark, sf_dir):
    return me.majority(t(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "signup"])


@query("a37_a39_sum_then_divide", "SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, count(*) AS n_total, round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 9) AS accuracy FROM lineitem GROUP BY l_returnflag")
def a37(spark, sf_dir):
    ok = F.col("l_discount") > 0.05
    return rounded(t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(ok).alias("n_correct"), F.count(F.lit(1)).alias("n_total"), (F.count_if(ok) / F.count(F.lit(1))).alias("accuracy")))


@query("a40_j17_delta_to_baseline", """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'C2' WHEN 1 THEN 'D_teacher' WHEN 2 THEN 'D_run' ELSE 'C1' END AS kind, o_orderpriority AS dataset, CASE o_custkey % 5 WHEN 0 THEN 'C2_STRATEGYQA_CQR_FULL' WHEN 1 THEN 'C2_STRATEGYQA_QUALITY_FIRST_FULL' WHEN 2 THEN 'C2_STRATEGYQA_CQR_SMOKE' ELSE 'other' END AS group_id,
  epoch_us(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS ts, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / 524288 END AS pb, o_totalprice / 262144 AS br, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice / 1048576 END AS acc, o_custkey % 100 / 128.0 AS auc FROM orders),
b AS (SELECT dataset, pb, acc, auc FROM r WHERE kind = 'C2' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY CASE group_id WHEN 'C2_STRATEGYQA_CQR_FULL' THEN 0 WHEN 'C2_STRATEGYQA_QUALITY_FIRST_FULL' THEN 1 WHEN 'C2_STRATEGYQA_CQR_SMOKE' THEN 2 ELSE 3 END, ts DESC) = 1)
SELECT r.id, r.kind, round(CASE WHEN r.kind[1] = 'D' THEN coalesce(r.pb, r.br) - b.pb END, 9) AS delta_posthoc_brier, round(CASE WHEN r.kind[1] = 'D' THEN r.acc - b.acc END, 9) AS delta_pair_acc, round(CASE WHEN r.kind[1] = 'D' THEN r.auc - b.auc END, 9) AS delta_auc FROM r LEFT JOIN b ON r.dataset = b.dataset""")
def a40(spark, sf_dir):
    from ..operators.recipes import baseline_deltas

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "C2").when(k % 4 == 1, "D_teacher").when(k % 4 == 2, "D_run").otherwise("C1")
    group = F.when(c % 5 == 0, "C2_STRATEGYQA_CQR_FULL").when(c % 5 == 1, "C2_STRATEGYQA_QUALITY_FIRST_FULL").when(c % 5 == 2, "C2_STRATEGYQA_CQR_SMOKE").otherwise("other")
    at = F.date_format(F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    p = F.col("o_totalprice")
    rows = t(spark, sf_dir, "orders").select(k.alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("dataset"), group.alias("group_id"), at.alias("generated_at"), F.when(c % 3 > 0, p / 524288).alias("posthoc_brier"), (p / 262144).alias("brier"), F.when(c % 7 > 0, p / 1048576).alias("corr_pair_acc"), (c % 100 / 128.0).alias("corr_auc"))
    out = baseline_deltas(rows)
    return out.select("id", "kind", *(F.round(x, 9).alias(x) for x in ("delta_posthoc_brier", "delta_pair_acc", "delta_auc")))


@query("w10_w11_primary_candidate", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_discount DESC, l_extendedprice DESC, l_partkey, l_linenumber) AS n FROM lineitem) WHERE n <= 2")
def w10(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") == "R").desc(), F.desc("l_discount"), F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return t(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 2").select("l_orderkey", "l_partkey", "l_linenumber")


@query("w17_isotonic_fit", """WITH p AS (SELECT CAST(round(score * 40) AS INTEGER) AS x, count(*) AS w, sum(CASE WHEN label < 0 OR step < label THEN 1.0 ELSE 0 END) AS s FROM d_traces GROUP BY 1),
c AS (SELECT x, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM p),
a AS (SELECT i.x AS lo, j.x AS hi, (j.cs - i.cs + i.s) / (j.cw - i.cw + i.w) AS m FROM c i JOIN c j ON i.x <= j.x),
r AS (SELECT k.x, max(mn) AS v FROM p k JOIN (SELECT k.x AS kx, a.lo, min(a.m) AS mn FROM p k JOIN a ON a.lo <= k.x AND a.hi >= k.x GROUP BY k.x, a.lo) q ON q.kx = k.x GROUP BY k.x)
SELECT CAST(max(x) AS DOUBLE) AS right_edge, round(v, 9) AS value FROM (SELECT x, round(v, 12) AS v FROM r) GROUP BY v""")
def w17(spark, sf_dir):
    y = F.when((F.col("label") < 0) | (F.col("step") < F.col("label")), 1.0).otherwise(0.0)
    rows = d_traces(spark, sf_dir).select(F.round(F.col("score") * 40).alias("x"), y.alias("y"))
    return rounded(me.isotonic_blocks(rows, "x", "y").select("right_edge", "value"))


@query("w18_isotonic_apply", "SELECT example_id, step, CAST(CASE WHEN score < 0.25 THEN 0.1 WHEN score < 0.5 THEN 0.4 ELSE 0.8 END AS DOUBLE) AS fitted FROM d_traces")
def w18(spark, sf_dir):
    return me.apply_isotonic(d_traces(spark, sf_dir), "score", [0.25, 0.5, 1.0], [0.1, 0.4, 0.8]).select("example_id", "step", "fitted")


@query("losses_value_rows", """SELECT generator, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 9) AS bce, round(avg((score - y) * (score - y)), 9) AS mse, round(avg(greatest(0.2 - score + nxt, 0)) FILTER (nxt IS NOT NULL), 9) AS margin FROM (
  SELECT generator, score, ln(greatest(1e-6, least(1 - 1e-6, score)) / (1 - greatest(1e-6, least(1 - 1e-6, score)))) AS x, CASE WHEN label < 0 OR step < label THEN 1.0 ELSE 0 END AS y, lead(score) OVER (PARTITION BY example_id ORDER BY step) AS nxt FROM d_traces) GROUP BY generator""")
def losses(spark, sf_dir):
    y = F.when((F.col("label") < 0) | (F.col("step") < F.col("label")), 1.0).otherwise(0.0)
    r = d_traces(spark, sf_dir).withColumns({"y": y, "nxt": F.lead("score").over(W.partitionBy("example_id").orderBy("step"))})
    return rounded(r.groupBy("generator").agg(F.avg(st.bce_with_logits(st.logit(F.col("score")), F.col("y"))).alias("bce"), F.avg(st.squared_error(F.col("score"), F.col("y"))).alias("mse"), F.avg(F.when(F.col("nxt").isNotNull(), st.margin_loss(F.col("score"), F.col("nxt"), 0.2))).alias("margin")))


@query("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    from ..streaming.windows import event_windows

    return event_windows(t(spark, sf_dir, "events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("v", 6).alias("v"))
