"""Trace metrics, sweeps and controllers over hash-scored lines of documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import traces as tr
from .registry import d_traces, query

R = 9


def rounded(df, *keep):
    """df with its doubles rounded."""
    return df.select(*(F.round(c, R).alias(c) if kind == "double" and c not in keep else c for c, kind in df.dtypes))


@query("a11_auc", """
SELECT count(*) FILTER (good) AS n_pos, count(*) FILTER (NOT good) AS n_neg,
  round((sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 9) AS auc
FROM (SELECT good, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
      FROM (SELECT score, label < 0 OR step < label AS good FROM d_traces))""")
def a11(spark, sf_dir):
    return rounded(tr.auc(tr.with_goodness(d_traces(spark, sf_dir)), F.col("is_good")))


@query("a11_auc_by_generator", """
SELECT generator, count(*) FILTER (good) AS n_pos, count(*) FILTER (NOT good) AS n_neg,
  round(CASE WHEN count(*) FILTER (good) * count(*) FILTER (NOT good) = 0 THEN 0.5 ELSE (sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)) END, 9) AS auc
FROM (SELECT generator, good, rank() OVER (PARTITION BY generator ORDER BY score) + (count(*) OVER (PARTITION BY generator, score) - 1) / 2.0 AS r
      FROM (SELECT generator, score, label < 0 OR step < label AS good FROM d_traces)) GROUP BY generator""")
def a11_by(spark, sf_dir):
    return rounded(tr.auc(tr.with_goodness(d_traces(spark, sf_dir)), F.col("is_good"), by=["generator"]))


@query("a13_good_bad_pairs_j10", """
SELECT g.example_id, count(*) AS pairs, CAST(sum(CASE WHEN g.score > b.score THEN 1 ELSE 0 END) AS BIGINT) AS "right"
FROM d_traces g JOIN d_traces b ON g.example_id = b.example_id AND g.label >= 0 AND g.step < g.label AND b.step >= b.label GROUP BY g.example_id""")
def a13_pairs(spark, sf_dir):
    return tr.pair_counts(d_traces(spark, sf_dir)).where("pairs > 0")


@query("a13_trace_summary", """
WITH p AS (SELECT count(*) AS pairs, sum(CASE WHEN g.score > b.score THEN 1 ELSE 0 END) AS ok FROM d_traces g JOIN d_traces b ON g.example_id = b.example_id AND g.label >= 0 AND g.step < g.label AND b.step >= b.label),
e AS (SELECT count(*) AS n, sum(CASE WHEN s.score > b.score THEN 1 ELSE 0 END) AS ok FROM d_traces s JOIN d_traces b ON s.example_id = b.example_id AND b.label > 0 AND b.step = b.label AND s.step = b.label - 1),
m AS (SELECT avg(score) FILTER (label < 0 OR step < label) AS good, avg(score) FILTER (label >= 0 AND step >= label) AS bad FROM d_traces),
l AS (SELECT avg(score) AS last FROM (SELECT score FROM d_traces WHERE label < 0 QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY step DESC) = 1))
SELECT CAST(p.pairs AS BIGINT) AS n_pairs, round(p.ok / p.pairs, 9) AS pair_accuracy, e.n AS n_edges, round(e.ok / e.n, 9) AS edge_accuracy, round(m.good, 9) AS mean_good, round(m.bad, 9) AS mean_bad, round(l.last, 9) AS mean_all_good_last FROM p, e, m, l""")
def a13(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    p = tr.pair_counts(rows).agg(F.sum("pairs").alias("n_pairs"), F.coalesce(F.try_divide(F.sum("right"), F.sum("pairs")), F.lit(0.5)).alias("pair_accuracy"))
    e = tr.edges(rows).agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.avg((F.col("safe") > F.col("bad")).cast("double")), F.lit(0.5)).alias("edge_accuracy"))
    g = tr.with_goodness(rows)
    m = g.agg(F.avg(F.when(F.col("is_good"), F.col("score"))).alias("mean_good"), F.avg(F.when(~F.col("is_good"), F.col("score"))).alias("mean_bad"))
    last = rows.where("label < 0").groupBy("example_id").agg(F.max_by("score", "step").alias("s")).agg(F.avg("s").alias("mean_all_good_last"))
    return rounded(p.crossJoin(e).crossJoin(m).crossJoin(last))


GRID_SQL = """g AS (SELECT CAST(lo + (hi - lo) * i / 8.0 AS DOUBLE) AS threshold FROM (SELECT min(score) AS lo, max(score) AS hi FROM d_traces), generate_series(0, 8) AS s(i)),
f AS (SELECT threshold, example_id, max(label) AS label, coalesce(min(CASE WHEN score < threshold THEN step END), -1) AS predicted FROM d_traces, g GROUP BY threshold, example_id),
c AS (SELECT threshold, count(*) FILTER (label >= 0) AS n_err, count(*) FILTER (label < 0) AS n_cor, count(*) FILTER (label >= 0 AND predicted = label) AS he, count(*) FILTER (label < 0 AND predicted = label) AS hc FROM f GROUP BY threshold),
r AS (SELECT threshold, n_err, n_cor, he / n_err AS acc_err, hc / n_cor AS acc_cor FROM c),
x AS (SELECT threshold, n_err, n_cor, acc_err, acc_cor, CASE WHEN acc_err + acc_cor = 0 THEN 0 ELSE 2 * acc_err * acc_cor / (acc_err + acc_cor) END AS f1 FROM r)"""


@query("a14_f1_sweep_j14", f"WITH {GRID_SQL} SELECT round(threshold, 9) AS threshold, n_err, n_cor, round(acc_err, 9) AS acc_err, round(acc_cor, 9) AS acc_cor, round(f1, 9) AS f1 FROM x")
def a14(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    return rounded(tr.f1_by_threshold(rows, tr.observed_grid(rows, 9).select("threshold")))


@query("a14_best_threshold_k14", f"WITH {GRID_SQL} SELECT round(threshold, 9) AS threshold, n_err, n_cor, round(acc_err, 9) AS acc_err, round(acc_cor, 9) AS acc_cor, round(f1, 9) AS f1 FROM x ORDER BY x.f1 DESC, x.threshold LIMIT 1")
def a14_best(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    sweep = tr.f1_by_threshold(rows, tr.observed_grid(rows, 9).select("threshold"))
    return rounded(tr.best(sweep, "f1", F.col("threshold")))


def f1_sql(grid: str, tables: str = "d_traces", by: str = "") -> str:
    """x(by, threshold, n_err, n_cor, ae, ac, f1) of a grid g(threshold)."""
    keys = f"{by}, " if by else ""
    return f"""{grid},
fx AS (SELECT {keys}threshold, example_id, max(label) AS label, coalesce(min(CASE WHEN score < threshold THEN step END), -1) AS predicted FROM {tables}, g GROUP BY {keys}threshold, example_id),
cx AS (SELECT {keys}threshold, count(*) FILTER (label >= 0) AS n_err, count(*) FILTER (label < 0) AS n_cor, count(*) FILTER (label >= 0 AND predicted = label) AS he, count(*) FILTER (label < 0 AND predicted = label) AS hc FROM fx GROUP BY {keys}threshold),
x AS (SELECT *, coalesce(he / nullif(n_err, 0), 0) AS ae, coalesce(hc / nullif(n_cor, 0), 0) AS ac, CASE WHEN coalesce(he / nullif(n_err, 0), 0) + coalesce(hc / nullif(n_cor, 0), 0) = 0 THEN 0 ELSE 2 * coalesce(he / nullif(n_err, 0), 0) * coalesce(hc / nullif(n_cor, 0), 0) / (coalesce(he / nullif(n_err, 0), 0) + coalesce(hc / nullif(n_cor, 0), 0)) END AS f1 FROM cx)"""


FIXED_SQL = "g AS (SELECT CAST(0.05 + i * 0.05 AS DOUBLE) AS threshold FROM generate_series(0, 18) AS s(i))"


@query("a33_threshold_shift", f"""WITH {f1_sql(FIXED_SQL)}, b AS (SELECT * FROM x ORDER BY f1 DESC, abs(threshold - 0.5) LIMIT 1),
w AS (SELECT min(x.threshold) AS lo, max(x.threshold) AS hi FROM x, b WHERE x.f1 >= b.f1 * 0.95), f AS (SELECT f1 FROM x WHERE abs(threshold - 0.5) < 1e-9)
SELECT round(b.threshold, 9) AS best_threshold, round(b.f1, 9) AS best_f1, round(b.ac, 9) AS best_acc_correct, round(b.ae, 9) AS best_acc_erroneous, round(f.f1, 9) AS fixed_f1, round(lo, 9) AS window_min, round(hi, 9) AS window_max, round(hi - lo, 9) AS window_width FROM b, w, f""")
def a33_window(spark, sf_dir):
    return rounded(tr.threshold_shift(d_traces(spark, sf_dir), tr.fixed_grid(spark, 0.05, 0.95, 0.05), 0.5))


OWN_SQL = """o AS (SELECT generator AS gen, CAST(lo + (hi - lo) * i / 6.0 AS DOUBLE) AS threshold FROM (SELECT generator, min(score) AS lo, max(score) AS hi FROM d_traces GROUP BY generator), generate_series(0, 6) AS s(i)),
l AS (SELECT a.gen, CAST(min(b.lo) + (max(b.hi) - min(b.lo)) * i / 6.0 AS DOUBLE) AS threshold FROM (SELECT generator AS gen FROM d_traces GROUP BY generator) a JOIN (SELECT generator AS gen, min(score) AS lo, max(score) AS hi FROM d_traces GROUP BY generator) b ON a.gen <> b.gen, generate_series(0, 6) AS s(i) GROUP BY a.gen, i),
g AS (SELECT 'own' AS kind, gen AS held, threshold FROM o UNION ALL SELECT 'fixed', gen, 0.5 FROM (SELECT DISTINCT gen FROM o) UNION ALL SELECT 'logo', gen, threshold FROM l),
fx AS (SELECT kind, held, threshold, generator = held AS mine, example_id, max(label) AS label, coalesce(min(CASE WHEN score < threshold THEN step END), -1) AS predicted FROM d_traces, g WHERE kind = 'logo' OR generator = held GROUP BY ALL),
cx AS (SELECT kind, held, threshold, mine, count(*) AS n, coalesce(count(*) FILTER (label >= 0 AND predicted = label) / nullif(count(*) FILTER (label >= 0), 0), 0) AS ae, coalesce(count(*) FILTER (label < 0 AND predicted = label) / nullif(count(*) FILTER (label < 0), 0), 0) AS ac FROM fx GROUP BY ALL),
x AS (SELECT *, CASE WHEN ae + ac = 0 THEN 0 ELSE 2 * ae * ac / (ae + ac) END AS f1 FROM cx),
own AS (SELECT held, n, threshold, f1 FROM x WHERE kind = 'own' QUALIFY row_number() OVER (PARTITION BY held ORDER BY f1 DESC, threshold) = 1),
pick AS (SELECT held, threshold FROM x WHERE kind = 'logo' AND NOT mine QUALIFY row_number() OVER (PARTITION BY held ORDER BY f1 DESC, threshold) = 1),
gr AS (SELECT own.held AS generator, own.n AS n_examples, own.threshold AS best_threshold, own.f1 AS best_f1, f.f1 AS fixed_f1, pick.threshold AS logo_threshold, x.f1 AS logo_f1 FROM own JOIN x f ON f.kind = 'fixed' AND f.held = own.held JOIN pick ON pick.held = own.held JOIN x ON x.kind = 'logo' AND x.mine AND x.held = own.held AND x.threshold = pick.threshold)"""


@query("a33_leave_one_generator_out_j16", f"WITH {OWN_SQL} SELECT generator, n_examples, round(best_threshold, 9) AS best_threshold, round(best_f1, 9) AS best_f1, round(fixed_f1, 9) AS fixed_f1, round(logo_threshold, 9) AS logo_threshold, round(logo_f1, 9) AS logo_f1 FROM gr")
def a33_logo(spark, sf_dir):
    return rounded(tr.group_thresholds(d_traces(spark, sf_dir), "generator", 7, 0.5))


@query("a33_generator_gaps", f"WITH {OWN_SQL} SELECT count(*) AS generators, round(stddev_pop(best_threshold), 9) AS best_threshold_std, round(min(fixed_f1), 9) AS worst_fixed_f1, round(min(logo_f1), 9) AS worst_logo_f1, round(avg(best_f1 - logo_f1), 9) AS mean_logo_gap, round(avg(best_f1 - fixed_f1), 9) AS mean_fixed_gap FROM gr")
def a33_gaps(spark, sf_dir):
    g = tr.group_thresholds(d_traces(spark, sf_dir), "generator", 7, 0.5)
    return rounded(g.agg(F.count(F.lit(1)).alias("generators"), F.stddev_pop("best_threshold").alias("best_threshold_std"), F.min("fixed_f1").alias("worst_fixed_f1"), F.min("logo_f1").alias("worst_logo_f1"), F.avg(F.col("best_f1") - F.col("logo_f1")).alias("mean_logo_gap"), F.avg(F.col("best_f1") - F.col("fixed_f1")).alias("mean_fixed_gap")))


ABR_SQL = """
WITH t AS (SELECT *, score < 0.35 OR coalesce(lag(score) OVER (PARTITION BY example_id ORDER BY step), 1.0) - score > 0.15 AS hit FROM d_traces),
s AS (SELECT example_id, any_value(generator) AS generator, count(*) AS n_steps, max(label) AS label, coalesce(min(CASE WHEN hit THEN step END), -1) AS stop FROM t GROUP BY example_id),
j AS (SELECT *, CASE WHEN label < 0 THEN stop < 0 ELSE stop >= 0 AND stop <= label END AS rgt, CASE WHEN stop < 0 THEN n_steps ELSE stop + 1 END AS used FROM s)"""


@query("b1_stop_rule_w3_w4", ABR_SQL + ' SELECT example_id, n_steps, label, stop, rgt AS "right", CAST(used AS BIGINT) AS used FROM j')
def b1(spark, sf_dir):
    return tr.judged(tr.stops(d_traces(spark, sf_dir), (F.col("score") < 0.35) | (F.col("drop") > 0.15))).withColumn("used", F.col("used").cast("long"))


CONFUSION_SQL = """, c AS (SELECT KEYS count(*) FILTER (label >= 0 AND rgt) AS tp, count(*) FILTER (label < 0 AND rgt) AS tn, count(*) FILTER (label < 0 AND stop >= 0) AS fp, count(*) FILTER (label >= 0 AND NOT rgt) AS fn,
  avg(used / n_steps) AS mean_used, quantile_cont(used / n_steps, 0.5) AS median_used, avg(CASE WHEN stop >= 0 AND used < n_steps THEN 1.0 ELSE 0 END) AS early_rate FROM j GROUP_BY),
r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS acc_err, coalesce(tn / nullif(tn + fp, 0), 0) AS acc_cor, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy FROM c)
SELECT KEYS tp, tn, fp, fn, round(mean_used, 9) AS mean_used, round(median_used, 9) AS median_used, round(early_rate, 9) AS early_rate, round(acc_err, 9) AS acc_err, round(acc_cor, 9) AS acc_cor, round(precision, 9) AS precision, round(accuracy, 9) AS accuracy,
  round(CASE WHEN acc_err + acc_cor = 0 THEN 0 ELSE 2 * acc_err * acc_cor / (acc_err + acc_cor) END, 9) AS balanced_f1, round(CASE WHEN precision + acc_err = 0 THEN 0 ELSE 2 * precision * acc_err / (precision + acc_err) END, 9) AS positive_f1 FROM r"""


@query("a34_controller_confusion", ABR_SQL + CONFUSION_SQL.replace("KEYS", "").replace("GROUP_BY", ""))
def a34(spark, sf_dir):
    return rounded(tr.confusion(tr.judged(tr.stops(d_traces(spark, sf_dir), (F.col("score") < 0.35) | (F.col("drop") > 0.15)))))


@query("b5_generator_robustness", ABR_SQL + CONFUSION_SQL.replace("KEYS", "generator,").replace("GROUP_BY", "GROUP BY generator"))
def b5(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    j = tr.judged(tr.stops(rows, (F.col("score") < 0.35) | (F.col("drop") > 0.15)))
    of = rows.where("step = 0").select("example_id", "generator")
    return rounded(tr.confusion(j.join(of, "example_id"), by=["generator"]))


@query("b2_fixed_schedule", """SELECT example_id, n_steps, label, CASE WHEN n_steps > 3 THEN 3 ELSE -1 END AS stop, CAST(least(n_steps, 4) AS BIGINT) AS used FROM (SELECT example_id, count(*) AS n_steps, max(label) AS label FROM d_traces GROUP BY example_id)""")
def b2(spark, sf_dir):
    n = d_traces(spark, sf_dir).groupBy("example_id").agg(F.count(F.lit(1)).alias("n_steps"), F.max("label").alias("label"))
    return n.select("example_id", "n_steps", "label", F.when(F.col("n_steps") > 3, 3).otherwise(-1).alias("stop"), F.least("n_steps", F.lit(4)).cast("long").alias("used"))


def sweep_sql() -> str:
    values = ", ".join(f"({p['policy']}, '{p['family']}', {p['tau']}, {p['delta']}, {p['min_step']}, {p['cap']}, {p['strikes']})" for p in tr.policy_grid())
    n = len(tr.policy_grid())
    return f"""pl AS (SELECT * FROM (VALUES {values}) v(policy, family, tau, delta, min_step, cap, strikes)),
tt AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY example_id ORDER BY step), 1.0) - score AS dr FROM d_traces),
bb AS (SELECT policy, family, strikes, example_id, step, label, score < tau OR (step >= min_step AND dr > delta AND score < cap) AS bad FROM tt, pl),
hh AS (SELECT *, bad AND (strikes = 1 OR coalesce(lag(bad) OVER (PARTITION BY policy, example_id ORDER BY step), false)) AS hit FROM bb),
st AS (SELECT policy, family, example_id, max(label) AS label, count(*) AS n, coalesce(min(CASE WHEN hit THEN step END), -1) AS stop FROM hh GROUP BY policy, family, example_id),
al AS (SELECT policy, family, label, n, stop, CASE WHEN stop < 0 THEN n ELSE stop + 1 END AS used FROM st
  UNION ALL SELECT {n - 1} + k, 'fixed_schedule', label, n, CASE WHEN n > k THEN k ELSE -1 END, least(n, k + 1) FROM (SELECT example_id, max(label) AS label, count(*) AS n FROM d_traces GROUP BY example_id), generate_series(1, 6) s(k)),
rr AS (SELECT *, CASE WHEN label < 0 THEN stop < 0 ELSE stop >= 0 AND stop <= label END AS ok FROM al),
sm AS (SELECT policy, family, count(*) FILTER (label >= 0 AND ok) AS tp, count(*) FILTER (label < 0 AND ok) AS tn, count(*) FILTER (label < 0 AND NOT ok) AS fp, count(*) FILTER (label >= 0 AND NOT ok) AS fn, avg(used / n) AS mean_used FROM rr GROUP BY policy, family),
pf AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS ae, coalesce(tn / nullif(tn + fp, 0), 0) AS ac FROM sm),
pw AS (SELECT CAST(policy AS INTEGER) AS policy, family, tp, tn, fp, fn, round(CASE WHEN ae + ac = 0 THEN 0 ELSE 2 * ae * ac / (ae + ac) END, 9) AS balanced_f1, round(mean_used, 9) AS mean_used FROM pf)"""


@query("b3_policy_grid_j15", f"WITH {sweep_sql()} SELECT * FROM pw")
def b3(spark, sf_dir):
    return rounded(tr.policy_sweep(d_traces(spark, sf_dir)))


@query("b3_k14_best_of_each_family", f"WITH {sweep_sql()} SELECT family, policy, balanced_f1, mean_used FROM pw QUALIFY row_number() OVER (PARTITION BY family ORDER BY balanced_f1 DESC, policy) = 1")
def b3_best(spark, sf_dir):
    return tr.best(rounded(tr.policy_sweep(d_traces(spark, sf_dir))), "balanced_f1", F.col("policy"), by=["family"]).select("family", "policy", "balanced_f1", "mean_used")


@query("b4_two_strike_w5", """
WITH t AS (SELECT *, score < 0.42 OR (step >= 2 AND coalesce(lag(score) OVER (PARTITION BY example_id ORDER BY step), 1.0) - score > 0.2) AS bad FROM d_traces),
u AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY example_id ORDER BY step) AS run FROM t),
v AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY example_id, run ORDER BY step) AS streak FROM u)
SELECT example_id, count(*) AS n_steps, max(label) AS label, coalesce(min(CASE WHEN streak >= 2 THEN step END), -1) AS stop FROM v GROUP BY example_id""")
def b4(spark, sf_dir):
    return tr.two_strikes(d_traces(spark, sf_dir), (F.col("score") < 0.42) | ((F.col("step") >= 2) & (F.col("drop") > 0.2)))


@query("b6_teacher_actions", """
WITH t AS (SELECT *, score < 0.35 OR coalesce(lag(score) OVER (PARTITION BY example_id ORDER BY step), 1.0) - score > 0.15 AS hit FROM d_traces),
s AS (SELECT *, min(CASE WHEN hit THEN step END) OVER (PARTITION BY example_id) AS stop FROM t)
SELECT example_id, step, round(score, 9) AS score, CASE WHEN step = stop THEN 1 ELSE 0 END AS action FROM s WHERE stop IS NULL OR step <= stop""")
def b6(spark, sf_dir):
    return rounded(tr.teacher_labels(d_traces(spark, sf_dir), (F.col("score") < 0.35) | (F.col("drop") > 0.15)))


@query("w7_history_features", """
SELECT example_id, step, round(score, 9) AS score_0, round(s1, 9) AS score_1, round(s2, 9) AS score_2, round(score - s1, 9) AS diff_0, round(s1 - s2, 9) AS diff_1, round(m, 9) AS mean_so_far, round(lo, 9) AS min_so_far, round(hi, 9) AS max_so_far, round(ls, 9) AS low_share, round(ss, 9) AS step_share
FROM (SELECT *, lag(score, 1, 1.0) OVER w AS s1, lag(score, 2, 1.0) OVER w AS s2, avg(score) OVER w AS m, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0 END) OVER w AS ls,
  row_number() OVER w / count(*) OVER (PARTITION BY example_id) AS ss FROM d_traces WINDOW w AS (PARTITION BY example_id ORDER BY step))""")
def w7(spark, sf_dir):
    h = tr.history(d_traces(spark, sf_dir), 3)
    return rounded(h.select("example_id", "step", "score_0", "score_1", "score_2", "diff_0", "diff_1", "mean_so_far", "min_so_far", "max_so_far", "low_share", "step_share"))


@query("w6_terminal_vs_previous_max", """
WITH m AS (SELECT example_id, step, score, max(score) OVER (PARTITION BY example_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(step) OVER (PARTITION BY example_id) AS last FROM d_traces WHERE label < 0)
SELECT example_id, score >= before AS on_top, round(score - before, 9) AS gap FROM m WHERE step = last AND before IS NOT NULL""")
def w6(spark, sf_dir):
    w = W.partitionBy("example_id")
    good = d_traces(spark, sf_dir).where("label < 0")
    out = good.withColumns({"before": F.max("score").over(w.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), "last": F.max("step").over(w)}).where("step = last and before is not null")
    return rounded(out.select("example_id", (F.col("score") >= F.col("before")).alias("on_top"), (F.col("score") - F.col("before")).alias("gap")))


BUCKETS_SQL = """e AS (SELECT *, count(*) OVER (PARTITION BY example_id) AS n, max(step) OVER (PARTITION BY example_id) AS last, max(score) OVER (PARTITION BY example_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(score) OVER (PARTITION BY example_id ORDER BY step) AS prev FROM d_traces),
b AS (SELECT *, CASE WHEN label < 0 THEN 'all_correct' WHEN label = 0 THEN 'error_at_step0' WHEN n <= 1 THEN 'early_error' WHEN label / greatest(n - 1, 1) <= 1 / 3.0 THEN 'early_error' WHEN label / greatest(n - 1, 1) >= 2 / 3.0 THEN 'late_error' ELSE 'mid_error' END AS bucket,
  CASE WHEN label < 0 THEN CASE WHEN step = n - 1 THEN 'all_correct_terminal' ELSE 'all_correct_nonterminal' END WHEN step = label THEN 'first_bad_prefix' WHEN step < label THEN 'safe_prefix' ELSE 'later_bad_prefix' END AS prefix FROM e)"""


@query("a20_failure_buckets", f"""WITH {BUCKETS_SQL}, p AS (SELECT g.bucket, count(*) AS pairs, avg(CASE WHEN g.score > w.score THEN 1.0 ELSE 0 END) AS acc FROM b g JOIN b w ON g.example_id = w.example_id AND g.label > 0 AND g.step < g.label AND w.step >= w.label GROUP BY g.bucket),
s AS (SELECT bucket, count(DISTINCT example_id) AS num_examples, avg(score) AS mean_score, count(*) FILTER (label > 0 AND step = label) AS edges, avg(CASE WHEN prev > score THEN 1.0 ELSE 0 END) FILTER (label > 0 AND step = label) AS edge_acc,
  avg(CASE WHEN score >= coalesce(before, score) THEN 1.0 ELSE 0 END) FILTER (label < 0 AND step = last) AS top1, avg(score - coalesce(before, score)) FILTER (label < 0 AND step = last) AS gap FROM b GROUP BY bucket)
SELECT s.bucket, num_examples, coalesce(pairs, 0) AS num_pairs, round(acc, 9) AS pair_accuracy, edges AS num_edges, round(edge_acc, 9) AS edge_accuracy, round(top1, 9) AS terminal_top1, round(gap, 9) AS terminal_gap, round(mean_score, 9) AS mean_score FROM s LEFT JOIN p ON s.bucket = p.bucket""")
def a20(spark, sf_dir):
    return rounded(tr.example_buckets(d_traces(spark, sf_dir)))


@query("a20_prefix_buckets", f"""WITH {BUCKETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY prefix) AS k FROM b)
SELECT prefix AS bucket, count(*) AS num_prefixes, round(avg(score), 9) AS mean_score, round(max(CASE WHEN i = round_even((k - 1) * CAST(0.1 AS DOUBLE), 0) THEN score END), 9) AS p10_score, round(max(CASE WHEN i = round_even((k - 1) * CAST(0.9 AS DOUBLE), 0) THEN score END), 9) AS p90_score, round(avg(step), 9) AS mean_step, min(label) AS label_min, max(label) AS label_max FROM o GROUP BY prefix""")
def a20_prefix(spark, sf_dir):
    return rounded(tr.prefix_buckets(d_traces(spark, sf_dir)))


@query("a21_transfer_means", f"""WITH {BUCKETS_SQL} SELECT round(coalesce(avg(score) FILTER (prefix = 'safe_prefix'), 0), 9) AS safe_prefix, round(coalesce(avg(score) FILTER (prefix = 'first_bad_prefix'), 0), 9) AS first_bad_prefix, round(coalesce(avg(score) FILTER (prefix = 'later_bad_prefix'), 0), 9) AS later_bad_prefix,
  round(coalesce(avg(score) FILTER (prefix = 'all_correct_nonterminal'), 0), 9) AS all_correct_nonterminal, round(coalesce(avg(score) FILTER (prefix = 'all_correct_terminal'), 0), 9) AS all_correct_terminal, round(avg(CASE WHEN score >= coalesce(before, score) THEN 1.0 ELSE 0 END) FILTER (label < 0 AND step = last), 9) AS terminal_top1, round(avg(score - coalesce(before, score)) FILTER (label < 0 AND step = last), 9) AS terminal_gap FROM b""")
def a21(spark, sf_dir):
    return rounded(tr.transfer_means(d_traces(spark, sf_dir)))


GROUPS_SQL = """gp AS (SELECT score, CASE WHEN label < 0 THEN 'all_correct' WHEN step < label THEN 'erroneous_good' ELSE 'erroneous_bad' END AS grp FROM d_traces)"""


@query("a35_reward_distribution", f"""WITH {GROUPS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM gp)
SELECT grp, count(*) AS n, round(avg(score), 9) AS mean, round(coalesce(stddev_samp(score), 0), 9) AS std, round(max(CASE WHEN i = n // 10 THEN score END), 9) AS p10, round(max(CASE WHEN i = n // 2 THEN score END), 9) AS p50, round(max(CASE WHEN i = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN score END), 9) AS p90,
  round(avg(CASE WHEN score > 0.8 THEN 1.0 ELSE 0 END), 9) AS above_08, round(avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0 END), 9) AS below_05 FROM o GROUP BY grp""")
def a35(spark, sf_dir):
    from ..operators.curation import range_slot, ranked

    rows = d_traces(spark, sf_dir)
    grp = F.when(F.col("label") < 0, "all_correct").when(F.col("step") < F.col("label"), "erroneous_good").otherwise("erroneous_bad")
    r = ranked(rows.select("score", grp.alias("grp")), "grp", ["score"], range_slot(F.col("score"), 0.0, 1.0))
    at = lambda place: F.max(F.when(F.col("_n") - 1 == place, F.col("score")))
    n = F.col("_all")
    return rounded(r.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), at(F.floor(n / 10)).alias("p10"), at(F.floor(n / 2)).alias("p50"), at(F.floor(n * F.lit(0.9))).alias("p90"), F.avg((F.col("score") > 0.8).cast("double")).alias("above_08"), F.avg((F.col("score") < 0.5).cast("double")).alias("below_05")))


@query("a35_separation_and_noise", """WITH e AS (SELECT example_id, max(label) AS label, count(*) AS n, var_samp(score) AS v, arg_max(score, step) AS last FROM d_traces GROUP BY example_id),
m AS (SELECT avg(score) FILTER (label < 0) - avg(score) FILTER (label >= 0 AND step >= label) AS separation FROM d_traces),
s AS (SELECT avg(last) AS mean_reward, stddev_samp(last) AS std_reward, avg(n) AS mean_steps, avg(v) FILTER (n > 1) AS within FROM e)
SELECT CAST(beta AS DOUBLE) AS beta, round(beta * 0.05 * mean_steps, 9) AS kl_term, round(std_reward, 9) AS signal_std, round(std_reward / (beta * 0.05 * mean_steps + 1e-8), 3) AS snr, std_reward / (beta * 0.05 * mean_steps + 1e-8) > 2 AS snr_ok, round(within, 9) AS within_variance, round(separation, 9) AS separation FROM s, m, (VALUES (0.0), (0.01), (0.02), (0.05), (0.1), (0.2), (0.5)) b(beta)""")
def a35_noise(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    e = rows.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"), F.var_samp("score").alias("v"), F.max_by("score", "step").alias("last"))
    s = e.agg(F.avg("last").alias("mean_reward"), F.stddev_samp("last").alias("std"), F.avg("n").alias("steps"), F.avg(F.when(F.col("n") > 1, F.col("v"))).alias("within_variance"))
    m = rows.agg((F.avg(F.when(F.col("label") < 0, F.col("score"))) - F.avg(F.when((F.col("label") >= 0) & (F.col("step") >= F.col("label")), F.col("score")))).alias("separation"))
    each = s.crossJoin(m).withColumn("beta", F.explode(F.array(*map(F.lit, (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)))))
    kl = F.col("beta") * 0.05 * F.col("steps")
    snr = F.col("std") / (kl + 1e-8)
    return each.select("beta", F.round(kl, 9).alias("kl_term"), F.round("std", 9).alias("signal_std"), F.round(snr, 3).alias("snr"), (snr > 2).alias("snr_ok"), F.round("within_variance", 9).alias("within_variance"), F.round("separation", 9).alias("separation"))


@query("j19_stepwise_separation", """
WITH e AS (SELECT * FROM d_traces),
p AS (SELECT c.step, count(*) AS pairs, sum(CASE WHEN c.score > w.score THEN 1 ELSE 0 END) AS won FROM e c JOIN e w ON c.step = w.step AND c.label < 0 AND w.label >= 0 GROUP BY c.step),
n AS (SELECT step, count(*) FILTER (label < 0) AS n_correct, count(*) FILTER (label >= 0) AS n_error FROM e GROUP BY step)
SELECT n.step, n_correct, n_error, round(won / pairs, 9) AS p_above FROM n JOIN p ON n.step = p.step WHERE n_correct >= 5 AND n_error >= 5""")
def j19(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    v = rows.groupBy("step", "score").agg(F.count_if(F.col("label") < 0).alias("c"), F.count_if(F.col("label") >= 0).alias("w"))
    below = F.coalesce(F.sum("w").over(W.partitionBy("step").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = v.withColumn("won", F.col("c") * below).groupBy("step").agg(F.sum("c").alias("n_correct"), F.sum("w").alias("n_error"), F.sum("won").alias("won"))
    return rounded(out.where("n_correct >= 5 and n_error >= 5").select("step", "n_correct", "n_error", (F.col("won") / (F.col("n_correct") * F.col("n_error"))).alias("p_above")))
