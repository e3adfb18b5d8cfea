"""Series summaries, distributions, pair errors, verdicts and joins that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import reports as rp
from ..operators import traces as tr
from .registry import d_pairs, d_rollouts, d_traces, query, t
from .trace_queries import rounded

MARGIN = "SELECT *, score - lead(score) OVER (PARTITION BY example_id ORDER BY step) AS m FROM d_traces"


def with_margin(spark, sf_dir):
    return d_traces(spark, sf_dir).withColumn("m", F.col("score") - F.lead("score").over(W.partitionBy("example_id").orderBy("step"))).where("m is not null")


@query("a12_pair_ranking", f"""WITH p AS (SELECT generator, m FROM ({MARGIN}) WHERE m IS NOT NULL),
s AS (SELECT generator, score, label < 0 OR step < label AS g FROM d_traces),
r AS (SELECT generator, g, rank() OVER (PARTITION BY generator ORDER BY score) + (count(*) OVER (PARTITION BY generator, score) - 1) / 2.0 AS k FROM s),
a AS (SELECT generator, (sum(k) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0) / (count(*) FILTER (g) * count(*) FILTER (NOT g)) AS auc FROM r GROUP BY generator),
c AS (SELECT generator, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS acc FROM p GROUP BY generator)
SELECT a.generator, round(acc, 9) AS pair_accuracy, round(auc, 9) AS auc, round((acc + auc) / 2, 9) AS ranking_score FROM a JOIN c ON a.generator = c.generator""")
def a12(spark, sf_dir):
    acc = with_margin(spark, sf_dir).groupBy("generator").agg(F.avg((F.col("m") > 0).cast("double")).alias("pair_accuracy"))
    auc = tr.auc(tr.with_goodness(d_traces(spark, sf_dir)), F.col("is_good"), by=["generator"]).select("generator", "auc")
    return rounded(acc.join(auc, "generator").withColumn("ranking_score", (F.col("pair_accuracy") + F.col("auc")) / 2))


STEP_BUCKETS = ([1, 2, 3, 5], ["<=1", "<=2", "<=3", "<=5", ">5"])
COUNT_BUCKETS = ([2, 3, 5, 8], ["<=2", "<=3", "<=5", "<=8", ">8"])


def bucket_sql(x: str, edges: list[int], labels: list[str]) -> str:
    return f"CASE WHEN {x} IS NULL THEN '<missing>' " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(edges, labels, strict=False)) + f" ELSE '{labels[-1]}' END"


@query("a15_pair_errors_by_dimension", f"""WITH n AS (SELECT example_id, count(*) AS k FROM d_traces GROUP BY 1), p AS (SELECT a.*, n.k, CASE WHEN label >= 0 THEN label END AS bad FROM ({MARGIN}) a JOIN n ON n.example_id = a.example_id WHERE m IS NOT NULL),
d AS (SELECT 'generator' AS dimension, generator AS value, m FROM p UNION ALL SELECT 'lang', lang, m FROM p UNION ALL SELECT 'first_negative', {bucket_sql('bad', *STEP_BUCKETS)}, m FROM p UNION ALL SELECT 'num_steps', {bucket_sql('k', *COUNT_BUCKETS)}, m FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY dimension, value) AS n FROM d)
SELECT dimension, value, count(*) AS n, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END), 9) AS tie_accuracy, round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END), 9) AS wrong_rate, round(avg(m), 9) AS mean_margin, round(quantile_cont(m, 0.5), 9) AS median_margin, round(max(CASE WHEN i = round_even((n - 1) * CAST(0.1 AS DOUBLE), 0) THEN m END), 9) AS p10_margin FROM o GROUP BY 1, 2""")
def a15(spark, sf_dir):
    rows = with_margin(spark, sf_dir)
    n = d_traces(spark, sf_dir).groupBy("example_id").agg(F.count(F.lit(1)).alias("k"))
    p = rows.join(n, "example_id")
    dims = {"generator": F.col("generator"), "lang": F.col("lang"), "first_negative": rp.number_bucket(F.when(F.col("label") >= 0, F.col("label")), *STEP_BUCKETS), "num_steps": rp.number_bucket(F.col("k"), *COUNT_BUCKETS)}
    return rounded(rp.by_dimensions(p, dims, F.col("m")))


@query("a16_w19_series_summary", """WITH o AS (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, count(*) AS count, round(avg(v), 9) AS mean, min(v) AS min, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) THEN v END) AS p90, max(CASE WHEN i = round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) THEN v END) AS p95, max(v) AS max FROM o GROUP BY source""")
def a16(spark, sf_dir):
    return rounded(rp.series_summary(t(spark, sf_dir, "documents"), "n_chars", ["source"]))


GEOMETRY = """pr AS (SELECT g.example_id, g.generator, g.step AS good, b.step AS bad, g.score > b.score AS ok, CASE WHEN b.step = b.label AND g.step = b.label - 1 THEN 'lastsafe_vs_firstbad' WHEN b.step = b.label THEN 'earlygood_vs_firstbad' WHEN g.step = b.label - 1 THEN 'lastsafe_vs_laterbad' ELSE 'earlygood_vs_laterbad' END AS pair_type,
  CASE WHEN b.step - g.step <= 1 THEN 'gap1' WHEN b.step - g.step = 2 THEN 'gap2' WHEN b.step - g.step <= 4 THEN 'gap3_4' ELSE 'gap5p' END AS gap FROM d_traces g JOIN d_traces b ON g.example_id = b.example_id AND g.label > 0 AND g.step < g.label AND b.step >= b.label)"""
TYPE_KEYS = "(VALUES ('lastsafe_vs_firstbad'), ('earlygood_vs_firstbad'), ('lastsafe_vs_laterbad'), ('earlygood_vs_laterbad')) v(key)"
GAP_KEYS = "(VALUES ('gap1'), ('gap2'), ('gap3_4'), ('gap5p')) v(key)"


@query("a17_pair_type_distribution", f"WITH {GEOMETRY} SELECT key, count(p.good) AS n, round(count(p.good) / (SELECT count(*) FROM pr), 9) AS share FROM {TYPE_KEYS} LEFT JOIN pr p ON p.pair_type = key GROUP BY key")
def a17(spark, sf_dir):
    return rounded(rp.geometry_distribution(d_traces(spark, sf_dir), "pair_type"))


@query("a17_gap_distribution", f"WITH {GEOMETRY} SELECT key, count(p.good) AS n, round(count(p.good) / (SELECT count(*) FROM pr), 9) AS share FROM {GAP_KEYS} LEFT JOIN pr p ON p.gap = key GROUP BY key")
def a17_gap(spark, sf_dir):
    return rounded(rp.geometry_distribution(d_traces(spark, sf_dir), "gap"))


@query("a17_pair_geometry_of_records", """WITH p AS (SELECT chosen_text AS c, rejected_text AS r, step % 6 AS good, step % 6 + step % 4 + 1 AS bad, CASE WHEN step % 5 > 0 THEN step % 6 + 1 END AS k FROM d_pairs)
SELECT count(*) AS num_pairs, count(k) AS with_steps, round(avg(CASE WHEN starts_with(r, c) THEN 1.0 ELSE 0 END), 9) AS prefix_relation_rate, round(avg(greatest(length(c), length(r)) / greatest(least(length(c), length(r)), 1)), 9) AS mean_length_ratio, count(*) FILTER (k IS NOT NULL AND bad = k AND good = k - 1) AS lastsafe_vs_firstbad, count(*) FILTER (k IS NOT NULL AND bad <> k AND good = k - 1) AS lastsafe_vs_laterbad, count(*) FILTER (k IS NOT NULL AND bad - good <= 1) AS gap1, count(*) FILTER (k IS NOT NULL AND bad - good BETWEEN 3 AND 4) AS gap3_4 FROM p""")
def a17_records(spark, sf_dir):
    s = F.col("step")
    p = d_pairs(spark, sf_dir).select("chosen_text", "rejected_text", (s % 6).alias("good"), (s % 6 + s % 4 + 1).alias("bad"), F.when(s % 5 > 0, s % 6 + 1).alias("first_bad"))
    g = rp.record_geometry(p)
    return rounded(g.select("num_pairs", "with_steps", "prefix_relation_rate", "mean_length_ratio", "lastsafe_vs_firstbad", "lastsafe_vs_laterbad", "gap1", "gap3_4"))


@query("a18_l1_distance", f"""WITH {GEOMETRY}, t AS (SELECT pair_type AS k, count(*) FILTER (generator = 'src0') / (SELECT count(*) FROM pr WHERE generator = 'src0') AS x, count(*) FILTER (generator = 'src1') / (SELECT count(*) FROM pr WHERE generator = 'src1') AS y FROM pr GROUP BY 1), g AS (SELECT gap AS k, count(*) FILTER (generator = 'src0') / (SELECT count(*) FROM pr WHERE generator = 'src0') AS x, count(*) FILTER (generator = 'src1') / (SELECT count(*) FROM pr WHERE generator = 'src1') AS y FROM pr GROUP BY 1)
SELECT round((SELECT sum(abs(x - y)) FROM t), 9) AS pair_type_l1, round((SELECT sum(abs(x - y)) FROM g), 9) AS gap_l1""")
def a18(spark, sf_dir):
    rows = d_traces(spark, sf_dir)
    one = lambda source, kind: rp.geometry_distribution(rows.where(F.col("generator") == source), kind)
    both = lambda kind, name: rp.l1_distance(one("src0", kind), one("src1", kind)).withColumnRenamed("l1", name)
    return rounded(both("pair_type", "pair_type_l1").crossJoin(both("gap", "gap_l1")))


@query("a19_alignment_slices", f"""WITH {GEOMETRY}, s AS (SELECT 'gap' AS dimension, gap AS value, ok FROM pr UNION ALL SELECT 'pair_type', pair_type, ok FROM pr UNION ALL SELECT 'aggregate', CASE WHEN pair_type LIKE '%firstbad' THEN 'anygood_vs_firstbad' ELSE 'good_vs_laterbad' END, ok FROM pr UNION ALL SELECT 'all', 'good_vs_bad', ok FROM pr)
SELECT dimension, value, count(*) AS count, count(*) FILTER (ok) AS positive, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS accuracy FROM s GROUP BY 1, 2""")
def a19(spark, sf_dir):
    return rounded(rp.alignment_slices(d_traces(spark, sf_dir)))


SUMMARY = """g AS (SELECT prefix_id, split_part(prefix_id, ':', 2) AS kind, count(*) AS k, count(*) FILTER (is_correct) AS c, count(*) FILTER (parse_error) AS pe, avg(chars) AS mc FROM d_rollouts GROUP BY prefix_id), b AS (SELECT *, (c + 1.0) / (k + 2.0) AS q FROM g), e AS (SELECT *, sqrt(q * (1 - q) / (k + 3.0)) AS se FROM b), i AS (SELECT *, greatest(0.0, least(1.0, q + 1.96 * se)) - greatest(0.0, least(1.0, q - 1.96 * se)) AS wd FROM e)"""


@query("a41_target_summary", f"WITH {SUMMARY} SELECT kind, count(*) AS num_targets, round(avg(c / k), 9) AS mean_success_rate, round(avg(1 - pe / k), 9) AS mean_parseable_rate, round(avg(greatest(1 - least(wd, 1.0), 0)), 9) AS mean_weight, round(avg(wd), 9) AS mean_ci_width, round(avg(mc), 9) AS mean_chars FROM i GROUP BY kind")
def a41(spark, sf_dir):
    targets = me.rollout_targets(d_rollouts(spark, sf_dir)).withColumn("kind", F.substring_index("prefix_id", ":", -1))
    return rounded(me.target_summary(targets, "kind"))


@query("a41_prefix_summary", "SELECT lang AS dataset, count(*) + count(DISTINCT doc_id) AS num_prefixes, count(DISTINCT doc_id) AS question_only, max(step) + 1 AS max_steps_seen FROM d_steps GROUP BY lang")
def a41_prefixes(spark, sf_dir):
    return rp.prefix_summary(prefixes(spark, sf_dir), "lang").withColumnRenamed("lang", "dataset")


def prefixes(spark, sf_dir):
    from ..functions.text import prefix_artifacts

    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", kept.alias("k")).where(F.size("k") > 0)
    return docs.select("doc_id", "lang", F.explode(prefix_artifacts(F.col("doc_id").cast("string"), F.col("k"))).alias("p")).select("doc_id", "lang", "p.*")


@query("g3_prefix_artifacts", "WITH s AS (SELECT doc_id, step, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY step) AS txt FROM d_steps), p AS (SELECT doc_id, 0 AS seen, '' AS txt FROM d_steps GROUP BY doc_id UNION ALL SELECT doc_id, step + 1, txt FROM s) SELECT doc_id, CAST(seen AS INTEGER) AS steps_seen, CASE WHEN seen = 0 THEN 'question_only' ELSE 'reasoning_prefix' END AS kind, substr(sha256(doc_id || '||' || seen || '||' || txt), 1, 24) AS prefix_id FROM p")
def g3(spark, sf_dir):
    return prefixes(spark, sf_dir).select("doc_id", "steps_seen", "kind", "prefix_id")


@query("a37_before_after", """WITH x AS (SELECT l_returnflag AS label, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS bc, count(*) FILTER (l_tax > 0.03) AS ac, count(*) FILTER (l_quantity < 3) AS bp, count(*) FILTER (l_quantity < 2) AS ap, count(*) FILTER (l_discount > 0.05 AND l_quantity >= 3) AS bcp, count(*) FILTER (l_tax > 0.03 AND l_quantity >= 2) AS acp FROM lineitem GROUP BY 1),
s AS (SELECT sum(n) AS n, sum(bc) AS bc, sum(ac) AS ac, sum(bp) AS bp, sum(ap) AS ap, sum(bcp) AS bcp, sum(acp) AS acp FROM x)
SELECT CAST(n AS BIGINT) AS n_total, CAST(ac - bc AS BIGINT) AS delta_n_correct, round(bc / n, 9) AS before_accuracy, round(ac / n, 9) AS after_accuracy, round((ac - bc) / n, 9) AS delta_accuracy, round((ap - bp) / n, 9) AS delta_parse_error_rate, round(acp / (n - ap) - bcp / (n - bp), 9) AS delta_accuracy_parseable FROM s""")
def a37_before_after(spark, sf_dir):
    r = t(spark, sf_dir, "lineitem")
    side = lambda ok, bad: r.groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_correct"), F.count_if(bad).alias("n_parse_error"), F.count_if(ok & ~bad).alias("n_correct_parseable"))
    return rounded(me.before_after(side(F.col("l_discount") > 0.05, F.col("l_quantity") < 3), side(F.col("l_tax") > 0.03, F.col("l_quantity") < 2), "label"))


@query("temperature_fit", """WITH r AS (SELECT greatest(1e-6, least(1 - 1e-6, score)) AS p, CASE WHEN label < 0 OR step < label THEN 1.0 ELSE 0.0 END AS y FROM d_traces), z AS (SELECT ln(p / (1 - p)) AS z, y FROM r),
g AS (SELECT CAST(0.25 + i * 0.25 AS DOUBLE) AS t FROM range(0, 20) s(i)), l AS (SELECT t, avg(greatest(z / t, 0) - z / t * y + ln(1 + exp(-abs(z / t)))) AS loss FROM z, g GROUP BY t) SELECT t AS temperature, round(loss, 9) AS loss FROM l ORDER BY round(loss, 12), t LIMIT 1""")
def temperature(spark, sf_dir):
    from ..functions import stats as st

    y = F.when((F.col("label") < 0) | (F.col("step") < F.col("label")), 1.0).otherwise(0.0)
    rows = d_traces(spark, sf_dir).select(st.logit(F.col("score")).alias("z"), y.alias("y"))
    return rounded(me.fit_temperature(rows, "z", "y", 0.25, 5.0, 20))


#: Replies by hand, with what is read from them.
REPLIES = [
    ('I think {"overall_verdict": " Correct", "confidence": 1.5}', "correct", None, 1.0, None),
    ('x {1}\n```json\n{"overall_verdict": "incorrect", "first_incorrect_step": "3", "confidence": 0.25}\n``` y}', "incorrect", 3, 0.25, None),
    ('{"overall_verdict": "maybe"}', "parse_failed", None, None, "invalid_overall_verdict"),
    ("no object", "parse_failed", None, None, "no_json_object_found"),
    ('{broken} then {"a": {"b": "}{"}, "overall_verdict": "correct", "first_incorrect_step": null}', "parse_failed", None, None, "json_parse_failed"),
    ('then {"a": {"b": "}"}, "overall_verdict": "correct"}', "parse_failed", None, None, "invalid_overall_verdict"),
    ('then {"overall_verdict": "correct", "first_incorrect_step": null, "a": {"b": "}{"}}', "correct", None, None, None),
    ('{"note": "x", {"first_incorrect_step": 2, "overall_verdict": "incorrect"} tail', "incorrect", 2, None, None),
    ('{"overall_verdict": "correct", "confidence": "high"}', "correct", None, None, "invalid_confidence"),
    ("{unclosed", "parse_failed", None, None, "no_json_object_found"),
    ("{'a': 1}", "parse_failed", None, None, "json_parse_failed"),
]


def sql_text(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(x, str) else repr(x)


def one_of(values: list[str]):
    """The reply of an event, by its number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


REPLY_SQL = ", ".join(f"({k}, {sql_text(v)}, CAST({sql_text(s)} AS INTEGER), CAST({sql_text(c)} AS DOUBLE), {sql_text(e)})" for k, (_, v, s, c, e) in enumerate(REPLIES))


@query("c20_json_verdict", f"SELECT event_id, v AS overall_verdict, s AS first_incorrect_step, c AS confidence, e AS parse_error FROM events JOIN (VALUES {REPLY_SQL}) r(k, v, s, c, e) ON event_id % {len(REPLIES)} = k")
def c20(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", rp.json_verdict(one_of([r[0] for r in REPLIES])).alias("x")).select("event_id", "x.*")


@query("f5_judge_filter", f"""WITH r AS (SELECT * FROM (VALUES {REPLY_SQL}) r(k, v, s, c, e))
SELECT event_id, CASE WHEN a.e IS NOT NULL OR b.e IS NOT NULL THEN 'parse_failed' WHEN a.c < 0.5 THEN 'chosen_low_confidence' WHEN b.c < 0.5 THEN 'rejected_low_confidence' WHEN a.v <> 'correct' THEN 'chosen_not_correct' WHEN b.v <> 'incorrect' THEN 'rejected_not_incorrect' ELSE 'judge_agree' END AS reason FROM events JOIN r a ON event_id % {len(REPLIES)} = a.k JOIN r b ON user_id % {len(REPLIES)} = b.k""")
def f5(spark, sf_dir):
    texts = [r[0] for r in REPLIES]
    other = F.element_at(F.array(*map(F.lit, texts)), (F.col("user_id") % len(texts) + 1).cast("int"))
    x = t(spark, sf_dir, "events").select("event_id", rp.json_verdict(one_of(texts)).alias("a"), rp.json_verdict(other).alias("b"))
    return x.select("event_id", rp.keep_judged(F.col("a"), F.col("b"), 0.5).alias("reason"))


BLOCKS = [
    ("so\n[FINAL]\noverall = Incorrect\nstep_3=incorrect\nSTEP_2 = Incorrect\nstep_1=correct\n[/FINAL] overall=correct", "incorrect", 2, 3, None),
    ("[final]\nOVERALL=correct\nFIRST_BAD=none", "correct", None, 0, None),
    ("[ final]\nover all=incorrect\nfirst bad = 4\n[/ final ] rest", "incorrect", 4, 0, None),
    ("[FINAL]OVERALL=correct[/FINAL]", None, None, None, "first_bad_missing"),
    ("[FINAL]\nSTEP_1=correct\n[/FINAL]", None, None, None, "overall_missing"),
    ("[FINAL]\nOVERALL=incorrect\nFIRST_BAD=two\n[/FINAL]", None, None, None, "invalid_first_bad: two"),
    ("[FINAL]\nOVERALL=incorrect\nSTEP_X=correct\n[/FINAL]", None, None, None, "invalid_step_key: STEP_X"),
    ("overall=correct", None, None, None, "final_block_missing"),
    ("[FINAL]\nOVERALL=correct\nSTEP_1=correct\n[/FINAL]", "correct", None, 1, None),
]
BLOCK_SQL = ", ".join(f"({k}, {sql_text(o)}, CAST({sql_text(f)} AS INTEGER), CAST({sql_text(n)} AS INTEGER), {sql_text(e)})" for k, (_, o, f, n, e) in enumerate(BLOCKS))


@query("c20_block_verdict", f"SELECT event_id, o AS overall, f AS first_bad, n AS n_steps, e AS parse_error FROM events JOIN (VALUES {BLOCK_SQL}) r(k, o, f, n, e) ON event_id % {len(BLOCKS)} = k")
def c20_block(spark, sf_dir):
    x = t(spark, sf_dir, "events").select("event_id", rp.block_verdict(one_of([b[0] for b in BLOCKS])).alias("x"))
    return x.select("event_id", "x.overall", "x.first_bad", F.when(F.col("x.step_verdicts").isNotNull(), F.size("x.step_verdicts")).alias("n_steps"), "x.parse_error")


CHOICES = [
    ("[FINAL]\nPREFERRED = b\nCONFIDENCE=1.7\nREASON=x\n[/FINAL]", "B", 1.0, None), ("[FINAL]\nPREFERRED=C\n[/FINAL]", "PARSE_ERROR", None, "invalid_preferred: C"), ("[FINAL]\nCONFIDENCE=sure\nPREFERRED=A\n[/FINAL]", "PARSE_ERROR", None, "invalid_confidence: sure"),
    ("[FINAL]\nREASON=none\n[/FINAL]", "PARSE_ERROR", None, "preferred_missing"), ("so \\boxed{ tie }", "TIE", None, None), ("My choice: a, confidence = 0.75", "A", 0.75, None), (" B it is. Confidence: 1", "B", 1.0, None),
    ("In the end candidate B is clearly better", "B", None, None), ("both are equally flawed", "TIE", None, None), ("no idea", "PARSE_ERROR", None, "final_block_missing"),
]
CHOICE_SQL = ", ".join(f"({k}, {sql_text(p)}, CAST({sql_text(c)} AS DOUBLE), {sql_text(e)})" for k, (_, p, c, e) in enumerate(CHOICES))


@query("c20_a30_pair_choice", f"""SELECT event_id, p AS preferred, c AS confidence, e AS parse_error, CASE WHEN p = 'TIE' THEN 'tie' WHEN p NOT IN ('A', 'B') THEN 'parse_error' WHEN (p = 'A') = (user_id % 2 = 0) THEN 'chosen' ELSE 'rejected' END AS decision FROM events JOIN (VALUES {CHOICE_SQL}) r(k, p, c, e) ON event_id % {len(CHOICES)} = k""")
def c20_choice(spark, sf_dir):
    x = t(spark, sf_dir, "events").select("event_id", "user_id", rp.pair_choice(one_of([c[0] for c in CHOICES])).alias("x")).select("event_id", "user_id", "x.*")
    return x.select("event_id", "preferred", "confidence", "parse_error", rp.debiased(F.col("preferred"), F.col("user_id") % 2 == 1).alias("decision"))


@query("c21_stitch", r"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || role END AS stitched FROM conversations")
def c21(spark, sf_dir):
    first = F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.concat("text", F.lit("  \n")))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", rp.stitch(first, F.concat(F.lit(" \t"), F.col("role"))).alias("stitched"))


SIGNALS = [("So the final answer: 4", True, False), ("we get 3 apples", False, False), ("thus #### 5", True, False), ("it is \\boxed{2}", True, False), ("the sum is -3/4 ", True, False), ("Answer - YES", False, True), (" no ", False, True), ("", False, False), ("verdict: false, so", False, True)]
SIGNAL_SQL = ", ".join(f"({k}, {m}, {b}, {len(x) > 0})" for k, (x, m, b) in enumerate(SIGNALS))


@query("c21_recovery", f"SELECT event_id, m AS math, b AS binary, o AS other, NOT m AND event_id % 2 = 0 AND user_id % 3 > 0 AS recover FROM events JOIN (VALUES {SIGNAL_SQL}) r(k, m, b, o) ON event_id % {len(SIGNALS)} = k")
def c21_recovery(spark, sf_dir):
    said = one_of([s[0] for s in SIGNALS])
    need = rp.needs_recovery(said, "math", F.col("event_id") % 2 == 0, F.col("user_id") % 3 > 0)
    return t(spark, sf_dir, "events").select("event_id", *(rp.answer_signal(said, k).alias(k) for k in ("math", "binary", "other")), need.alias("recover"))


@query("j12_graph_incidence", """WITH e AS (SELECT pair_id, source_tag, domain_tag, chosen_text AS t, pair_confidence AS w, step AS safe, NULL AS bad FROM d_pairs UNION ALL SELECT pair_id, source_tag, domain_tag, rejected_text, pair_confidence, NULL, step + 1 FROM d_pairs),
n AS (SELECT *, substr(sha256(source_tag || chr(10) || '<SEP>' || chr(10) || domain_tag), 1, 16) AS pool, substr(sha256(source_tag || chr(10) || '<SEP>' || chr(10) || domain_tag || chr(10) || '<SEP>' || chr(10) || t), 1, 20) AS candidate FROM e)
SELECT pool, candidate, count(*) AS degree, round(sum(w), 6) AS weight, max(safe) AS max_safe, min(bad) AS min_bad, round(sum(CASE WHEN safe IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS utility FROM n GROUP BY 1, 2""")
def j12(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("source_tag", F.col("domain_tag").alias("prompt_text"), "chosen_text", "rejected_text", "pair_confidence", F.col("step").alias("positive_step"), (F.col("step") + 1).alias("negative_step"))
    g = rp.candidate_graph(p)
    return g.select("pool", "candidate", "degree", F.round("weight", 6).alias("weight"), "max_safe", "min_bad", F.round("utility", 6).alias("utility"))


@query("j18_before_after", """SELECT a.n_regionkey, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta FROM (SELECT n_regionkey, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a JOIN (SELECT n_regionkey, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b ON a.n_regionkey = b.n_regionkey""")
def j18(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    side = lambda name, c, v: t(spark, sf_dir, name).join(n, F.col(c) == n["n_nationkey"]).groupBy("n_regionkey").agg(F.avg(v).alias(name))
    j = side("customer", "c_nationkey", "c_acctbal").join(side("supplier", "s_nationkey", "s_acctbal"), "n_regionkey")
    return j.select("n_regionkey", F.round("customer", 6).alias("before"), F.round("supplier", 6).alias("after"), F.round(F.col("supplier") - F.col("customer"), 6).alias("delta"))
