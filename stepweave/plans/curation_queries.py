"""Filters, dedup, splits, caps and orders over pairs of neighbouring lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import common_prefix
from ..operators import curation as cu
from .pair_queries import SIGN_SQL, signed
from .registry import d_pairs, d_predictions, d_steps, d_traces, query, t
from .trace_queries import rounded

FLAGS_SQL = r"""f AS (SELECT pair_id, source_tag, domain_tag, semantics, pair_confidence, length(c) AS nc, length(r) AS nr, greatest(length(c), length(r)) / greatest(least(length(c), length(r)), 1) AS ratio,
  c <> r AS differ, list_filter(list_distinct(string_split(c, ' ')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split(r, ' ')), lambda x: x <> '') AS b
  FROM (SELECT *, trim(regexp_replace(chosen_text, '\s+', ' ', 'g')) AS c, trim(regexp_replace(rejected_text, '\s+', ' ', 'g')) AS r FROM d_pairs)),
g AS (SELECT *, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap FROM f)"""


@query("f1_quality_flags", f"WITH {FLAGS_SQL} SELECT pair_id, CAST(nc AS INTEGER) AS chosen_chars, CAST(nr AS INTEGER) AS rejected_chars, round(ratio, 9) AS length_ratio, round(overlap, 9) AS token_overlap_ratio, nc > 0 AND nr > 0 AS non_empty, differ AS distinct_pair FROM g")
def f1(spark, sf_dir):
    return rounded(cu.quality_flags(d_pairs(spark, sf_dir).select("pair_id", "chosen_text", "rejected_text")).select("pair_id", "q.*").drop("prompt_chars"))


@query("f2_quality_filter", f"WITH {FLAGS_SQL} SELECT pair_id FROM g WHERE differ AND nc >= 12 AND nr >= 12 AND ratio <= 4.0 AND overlap <= 0.995")
def f2(spark, sf_dir):
    return cu.quality_flags(d_pairs(spark, sf_dir).select("pair_id", "chosen_text", "rejected_text")).where(cu.passes_quality(F.col("q"))).select("pair_id")


@query("f3_s12_confidence_head", "SELECT pair_id, source_tag, domain_tag, round(pair_confidence, 9) AS pair_confidence FROM d_pairs WHERE pair_confidence >= 0.55 AND source_tag IN ('src0', 'src1', 'src2', 'src3') AND domain_tag IN ('en', 'fr') ORDER BY pair_id LIMIT 300")
def f3(spark, sf_dir):
    from ..sources.readers import canonical_pairs

    p = canonical_pairs(d_pairs(spark, sf_dir).select("pair_id", "source_tag", "domain_tag", "pair_confidence"), 0.55, ["src0", "src1", "src2", "src3"], 300, domains=["en", "fr"])
    return rounded(p)


@query("f4_oracle_filter_reasons", """
WITH o AS (SELECT coalesce(p.semantics, 'unspecified') AS semantics, CASE WHEN p.step % 11 = 0 THEN NULL ELSE a.score END AS cs, b.score AS rs FROM d_pairs p JOIN d_traces a ON a.example_id = p.doc_id AND a.step = p.step JOIN d_traces b ON b.example_id = p.doc_id AND b.step = p.step + 1),
r AS (SELECT semantics, CASE WHEN cs IS NULL OR rs IS NULL THEN 'missing_step_scores' WHEN cs < 0.5 THEN 'chosen_low' WHEN rs > 0.6 THEN 'rejected_high' WHEN cs - rs < 0.1 THEN 'margin_low' ELSE 'kept' END AS reason FROM o)
SELECT semantics, reason, count(*) AS n, sum(CAST(count(*) FILTER (reason = 'kept') AS BIGINT)) OVER (PARTITION BY semantics)::BIGINT AS kept, sum(count(*)) OVER (PARTITION BY semantics)::BIGINT AS total FROM r GROUP BY semantics, reason""")
def f4(spark, sf_dir):
    # the teacher's scores of a pair's two sides are neighbours in its trace: one window, no join
    tr = d_traces(spark, sf_dir)
    own = tr.withColumn("rs", F.lead("score").over(W.partitionBy("example_id").orderBy("step"))).select(F.col("example_id").alias("doc_id"), "step", F.when(F.col("step") % 11 != 0, F.col("score")).alias("cs"), "rs")
    p = d_pairs(spark, sf_dir).select("doc_id", "step", F.coalesce("semantics", F.lit("unspecified")).alias("semantics")).join(own, ["doc_id", "step"])
    reason = cu.first_reason([("missing_step_scores", F.col("cs").isNotNull() & F.col("rs").isNotNull()), ("chosen_low", F.col("cs") >= 0.5), ("rejected_high", F.col("rs") <= 0.6), ("margin_low", F.col("cs") - F.col("rs") >= 0.1)])
    n = p.groupBy("semantics", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("semantics")  # a row for each reason
    return n.withColumns({"kept": F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("n"))).over(w), F.lit(0)), "total": F.sum("n").over(w)})


@query("f6_semantic_allow_list", "SELECT pair_id, semantics FROM d_pairs WHERE coalesce(semantics, 'unspecified') IN ('local', 'terminal', 'unspecified')")
def f6(spark, sf_dir):
    return d_pairs(spark, sf_dir).where(F.coalesce("semantics", F.lit("unspecified")).isin("local", "terminal", "unspecified")).select("pair_id", "semantics")


@query("f11_uncertain_selection", "SELECT example_id, step FROM d_traces WHERE abs(score - 0.5) < 0.1")
def f11(spark, sf_dir):
    return d_traces(spark, sf_dir).where(F.abs(F.col("score") - 0.5) < 0.1).select("example_id", "step")


@query("f13_finite_vectors", "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)")
def f13(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.where(F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))).select("vec_id", F.size("embedding").cast("long").alias("width"))


#: Kinds of pairs by the names that the recipe rules know.
KINDS_SQL = "CASE coalesce(semantics, '') WHEN 'local' THEN 'local_first_bad_edge' WHEN 'sibling' THEN 'sibling_branch' WHEN 'terminal' THEN 'terminal_completion_anchor' ELSE 'good_bad_prefix_grid' END"


def kinds(p):
    k = F.coalesce("semantics", F.lit(""))
    return p.withColumn("pair_semantics", F.when(k == "local", "local_first_bad_edge").when(k == "sibling", "sibling_branch").when(k == "terminal", "terminal_completion_anchor").otherwise("good_bad_prefix_grid"))


RECIPES = [("logit", "semantic", "ranking_score"), ("score", "none", "pair_acc"), ("logit", "confidence", "pair_acc"), ("score", "group_balance", "ranking_score")]
RECIPE_SQL = f"""rc AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RECIPES)}) v(space, weights, metric)),
pk AS (SELECT source_tag, {KINDS_SQL} AS kind FROM d_pairs WHERE CASE source_tag WHEN 'src0' THEN semantics = 'local' WHEN 'src1' THEN semantics IN ('local', 'sibling') ELSE true END),
fr AS (SELECT source_tag, count(*) AS n, count(DISTINCT kind) AS kinds, avg(CASE WHEN kind = 'terminal_completion_anchor' THEN 1.0 ELSE 0 END) AS terminal, avg(CASE WHEN kind = 'good_bad_prefix_grid' THEN 1.0 ELSE 0 END) AS grid, avg(CASE WHEN kind IN ('local_first_bad_edge', 'sibling_branch') THEN 1.0 ELSE 0 END) AS near FROM pk GROUP BY source_tag),
ru AS (SELECT fr.*, rc.*, weights IN ('semantic', 'confidence_semantic', 'group_balance', 'confidence_group_balance') AS semantic, kinds > 1 AS mixed FROM fr, rc)"""


@query("f14_recipe_risk", f"""WITH {RECIPE_SQL}, f AS (SELECT *, list_filter([
  CASE WHEN space = 'logit' AND semantic AND metric = 'ranking_score' AND mixed THEN 'ANTI_PATTERN_G_FULL' END, CASE WHEN space = 'logit' AND mixed AND terminal > 0 THEN 'LOGIT_MIXED_TERMINAL' END,
  CASE WHEN metric = 'ranking_score' AND mixed THEN 'RANKING_SCORE_MIXED' END, CASE WHEN semantic AND mixed AND terminal >= 0.05 THEN 'SEMANTIC_WEIGHT_MIXED_TERMINAL' END,
  CASE WHEN mixed AND grid >= 0.25 AND space = 'logit' THEN 'LOGIT_WIDE_GEOMETRY' END, CASE WHEN near >= 0.8 AND NOT terminal > 0 AND NOT semantic THEN 'LOCAL_SIGNAL_CLEAN' END], lambda x: x IS NOT NULL) AS codes FROM ru)
SELECT source_tag, space, weights, metric, array_to_string(codes, ',') AS codes, CASE WHEN list_contains(codes, 'ANTI_PATTERN_G_FULL') THEN 'critical' WHEN list_has_any(codes, ['LOGIT_MIXED_TERMINAL', 'RANKING_SCORE_MIXED', 'SEMANTIC_WEIGHT_MIXED_TERMINAL']) THEN 'high' WHEN list_contains(codes, 'LOGIT_WIDE_GEOMETRY') THEN 'medium' ELSE 'info' END AS max_severity, round(terminal, 9) AS terminal_fraction FROM f""")
def f14(spark, sf_dir):
    from ..operators.recipes import pair_shares, recipe_risk

    s = F.col("source_tag")
    p = kinds(d_pairs(spark, sf_dir).where(F.when(s == "src0", F.coalesce(F.col("semantics") == "local", F.lit(False))).when(s == "src1", F.coalesce(F.col("semantics").isin("local", "sibling"), F.lit(False))).otherwise(True)))
    recipes = F.explode(F.array(*(F.struct(F.lit(a).alias("space"), F.lit(b).alias("weights"), F.lit(c).alias("metric")) for a, b, c in RECIPES)))
    rows = pair_shares(p, ["source_tag"]).select("*", recipes.alias("r")).select("*", "r.*")
    out = recipe_risk(rows)
    return rounded(out.select("source_tag", "space", "weights", "metric", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"), "max_severity", F.col("terminal").alias("terminal_fraction")))


@query("f10_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def f10(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id", "left_semi")


@query("d1_first_wins", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def d1(spark, sf_dir):
    # by digest, so that the shuffle carries no text
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("d2_d3_union_relabelled", "SELECT 'a::' || pair_id AS pair_id, 'a' AS mix, round(pair_confidence * 0.5, 9) AS weight FROM d_pairs WHERE semantics = 'local' UNION ALL SELECT 'b::' || pair_id, 'b', round(pair_confidence * 2.0, 9) FROM d_pairs WHERE semantics = 'sibling'")
def d2(spark, sf_dir):
    p = d_pairs(spark, sf_dir)
    parts = [p.where(F.col("semantics") == s).select(F.concat(F.lit(f"{m}::"), "pair_id").alias("pair_id"), F.lit(m).alias("mix"), (F.col("pair_confidence") * w).alias("weight")) for s, m, w in (("local", "a", 0.5), ("sibling", "b", 2.0))]
    return rounded(parts[0].unionByName(parts[1]))


@query("d4_intersect", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def d4(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("d5_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d5(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("d6_repeated_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def d6(spark, sf_dir):
    return cu.repeated_keys(t(spark, sf_dir, "orders"), "o_custkey")


UNIT_SQL = "(CAST(('0x' || substr(sha256({k}), 1, 16))::UBIGINT AS DOUBLE) / {d})"


@query("d7_three_way_split", f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {UNIT_SQL.format(k=chr(39) + '42:' + chr(39) + ' || doc_id', d='18446744073709551616.0')} AS u FROM documents)")
def d7(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", cu.three_way_split(F.col("doc_id")).alias("split"))


@query("d8_group_split", f"SELECT doc_id, source, CASE WHEN {UNIT_SQL.format(k=chr(39) + '42:' + chr(39) + ' || source', d='18446744073709551615.0')} < 0.3 THEN 'validation' ELSE 'train' END AS split FROM documents")
def d8(spark, sf_dir):
    return cu.group_split(t(spark, sf_dir, "documents").select("doc_id", "source"), "source", validation=0.3)


@query("d9_split_group", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'g' || user_id END, CASE WHEN event_id % 3 = 1 THEN event_type || ':' || user_id END, substr(sha256(props), 1, 12)) AS split_group FROM events")
def d9(spark, sf_dir):
    n = F.col("event_id") % 3
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(n == 0, F.concat(F.lit("g"), F.col("user_id").cast("string"))), F.when(n == 1, F.concat_ws(":", "event_type", F.col("user_id").cast("string"))), F.substring(F.sha2("props", 256), 1, 12)).alias("split_group"))


@query("d10_stratified_split", """
WITH r AS (SELECT example_id, row_number() OVER (PARTITION BY generator, label < 0 ORDER BY sha256('42:' || example_id)) AS n, count(*) OVER (PARTITION BY generator, label < 0) AS k FROM d_traces WHERE step = 0),
s AS (SELECT *, greatest(1, round_even(k * 0.15, 0)) AS d FROM r), z AS (SELECT example_id, n, CASE WHEN k >= 6 THEN CASE WHEN 2 * d >= k THEN greatest(1, k // 4) ELSE d END WHEN k >= 3 THEN 1 ELSE 0 END AS nd, CASE WHEN k >= 6 THEN CASE WHEN 2 * d >= k THEN greatest(1, k // 4) ELSE d END WHEN k >= 4 THEN 1 ELSE 0 END AS nt FROM s)
SELECT example_id, CASE WHEN n <= nd THEN 'validation' WHEN n <= nd + nt THEN 'test' ELSE 'train' END AS split FROM z""")
def d10(spark, sf_dir):
    r = d_traces(spark, sf_dir).where("step = 0").select("example_id", F.concat_ws("|", "generator", (F.col("label") < 0).cast("string")).alias("stratum"))
    return cu.stratified_split(r, "stratum", "example_id").select("example_id", "split")


@query("k7_sample_in_input_order", "SELECT doc_id, step FROM (SELECT doc_id, step, row_number() OVER (ORDER BY sha256('42|mix|' || pair_id), pair_id) AS n FROM d_pairs) WHERE n <= 120")
def k7(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("doc_id", "step", "pair_id")
    return cu.hash_sample(p, "pair_id", 120, "42|mix").orderBy("doc_id", "step").select("doc_id", "step")


@query("d11_split_alias_s11", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'validation' WHEN event_type = 'click' THEN 'train' END AS split FROM events")
def d11(spark, sf_dir):
    e = F.col("event_type")
    return t(spark, sf_dir, "events").select("event_id", cu.split_alias(F.when(e == "view", " Dev").when(e == "click", "TRAIN").otherwise("odd")).alias("split"))


@query("k1_head_by_id", "SELECT pair_id, source_tag FROM d_pairs ORDER BY pair_id LIMIT 500")
def k1(spark, sf_dir):
    return d_pairs(spark, sf_dir).select("pair_id", "source_tag").orderBy("pair_id").limit(500)


@query("k2_w12_round_robin_cap", "SELECT pair_id, source_tag FROM (SELECT pair_id, source_tag, row_number() OVER (PARTITION BY source_tag ORDER BY pair_id) AS n FROM d_pairs) ORDER BY n, source_tag LIMIT 333")
def k2(spark, sf_dir):
    return cu.round_robin_cap(d_pairs(spark, sf_dir).select("pair_id", "source_tag"), "source_tag", "pair_id", 333)


@query("k3_quota_by_semantics", "SELECT pair_id, semantics FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(semantics, 'u') ORDER BY doc_id, step) AS n FROM d_pairs) WHERE n <= CASE WHEN semantics = 'terminal' THEN 30 WHEN semantics = 'local' THEN 170 ELSE 0 END")
def k3(spark, sf_dir):
    quotas = cu.semantic_quotas(200, "local", "terminal", 0.15)
    p = d_pairs(spark, sf_dir).where(F.col("semantics").isin(*quotas))
    quota = F.when(F.col("semantics") == "terminal", quotas["terminal"]).otherwise(quotas["local"])
    return cu.first_by_key(p, "semantics", ["doc_id", "step"], quota, max(quotas.values())).select("pair_id", "semantics")


@query("k4_even_quotas", "WITH k AS (SELECT DISTINCT source FROM documents) SELECT source, CAST(floor(333 / (SELECT count(*) FROM k)) + CASE WHEN row_number() OVER (ORDER BY source) <= 333 % (SELECT count(*) FROM k) THEN 1 ELSE 0 END AS INTEGER) AS quota FROM k")
def k4(spark, sf_dir):
    return cu.even_quotas(t(spark, sf_dir, "documents"), "source", 333)


@query("k5_largest_remainder", """
WITH s AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang),
b AS (SELECT lang, floor(share * 777 + 1e-9) AS f, share * 777 - floor(share * 777 + 1e-9) AS r FROM s)
SELECT lang, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(r, 9) DESC, lang) <= 777 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END AS INTEGER) AS quota FROM b""")
def k5(spark, sf_dir):
    n = t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return cu.largest_remainder(n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())), "lang", "share", 777)


@query("k6_k13_hash_sample", "SELECT pair_id FROM d_pairs ORDER BY sha256('mix|' || pair_id), pair_id LIMIT 200")
def k6(spark, sf_dir):
    return cu.hash_sample(d_pairs(spark, sf_dir).select("pair_id"), "pair_id", 200, "mix")


@query("k8_keep_ratio", "SELECT pair_id, semantics FROM (SELECT pair_id, semantics, row_number() OVER (PARTITION BY semantics ORDER BY pair_confidence DESC, pair_id) AS n, count(*) OVER (PARTITION BY semantics) AS k FROM d_pairs WHERE semantics IS NOT NULL) WHERE n <= greatest(1, ceil(k * CASE semantics WHEN 'local' THEN 0.7 WHEN 'sibling' THEN 0.65 ELSE 0.35 END))")
def k8(spark, sf_dir):
    p = d_pairs(spark, sf_dir).where("semantics is not null").select("pair_id", "semantics", "pair_confidence")
    ratio = F.when(F.col("semantics") == "local", 0.7).when(F.col("semantics") == "sibling", 0.65).otherwise(0.35)
    slot = cu.range_slot(F.col("pair_confidence"), 0.0, 1.0, falling=True)
    return cu.quota_by_key(p, "semantics", [F.desc("pair_confidence"), "pair_id"], F.greatest(F.lit(1), F.ceil(F.col("_all") * ratio)), slot).select("pair_id", "semantics")


@query("k9_terminal_cap", """
WITH c AS (SELECT greatest(1, floor(count(*) FILTER (coalesce(semantics, '') <> 'terminal') * 0.12 / 0.88)) AS cap FROM d_pairs)
SELECT pair_id FROM (SELECT pair_id, coalesce(semantics, '') = 'terminal' AS term, row_number() OVER (PARTITION BY coalesce(semantics, '') = 'terminal' ORDER BY pair_confidence DESC, pair_id) AS n FROM d_pairs), c WHERE NOT term OR n <= cap""")
def k9(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("pair_id", "pair_confidence", (F.coalesce("semantics", F.lit("")) == "terminal").alias("term"))
    cap = p.agg(cu.terminal_cap(F.count_if(~F.col("term")), 0.12).alias("cap"))
    slot = cu.range_slot(F.col("pair_confidence"), 0.0, 1.0, falling=True)
    kept = cu.ranked(p.where("term"), "term", [F.desc("pair_confidence"), "pair_id"], slot).crossJoin(F.broadcast(cap)).where("_n <= cap").select("pair_id")
    return p.where("not term").select("pair_id").unionByName(kept)


@query("k10_margin_slice", """
WITH m AS (SELECT example_id, step, score - lead(score) OVER (PARTITION BY example_id ORDER BY step) AS margin FROM d_traces)
SELECT example_id, step, round(margin, 9) AS margin, CAST(row_number() OVER (ORDER BY abs(margin), margin, example_id, step) AS INTEGER) AS rank FROM m WHERE margin IS NOT NULL ORDER BY abs(margin), margin, example_id, step LIMIT 250""")
def k10(spark, sf_dir):
    m = d_traces(spark, sf_dir).withColumn("margin", F.col("score") - F.lead("score").over(W.partitionBy("example_id").orderBy("step"))).where("margin is not null")
    top = m.orderBy(F.abs("margin"), "margin", "example_id", "step").limit(250)
    return rounded(top.select("example_id", "step", "margin", F.row_number().over(W.orderBy(F.abs("margin"), "margin", "example_id", "step")).alias("rank")))


@query("k11_top_errors", "SELECT example_id, step, round(margin, 9) AS margin FROM (SELECT example_id, step, score, score - lead(score) OVER (PARTITION BY example_id ORDER BY step) AS margin FROM d_traces) WHERE margin <= 0 ORDER BY margin, score, example_id LIMIT 50")
def k11(spark, sf_dir):
    m = d_traces(spark, sf_dir).withColumn("margin", F.col("score") - F.lead("score").over(W.partitionBy("example_id").orderBy("step")))
    return m.where("margin <= 0").orderBy("margin", "score", "example_id").limit(50).select("example_id", "step", F.round("margin", 9).alias("margin"))


def spread_sql(n: str) -> str:
    return f"(CASE WHEN k <= {n} THEN true WHEN {n} <= 1 THEN i = 1 ELSE i IN (SELECT round_even(j * (k - 1) / ({n} - 1.0), 0) + 1 FROM range(0, CAST({n} AS BIGINT)) x(j)) END)"


@query("k12_w15_stratified_spread", f"""
WITH r AS (SELECT example_id, label < 0 AS good, row_number() OVER (PARTITION BY label < 0 ORDER BY example_id) AS i, count(*) OVER (PARTITION BY label < 0) AS k FROM d_traces WHERE step = 0),
c AS (SELECT count(*) FILTER (good) AS ng, count(*) FILTER (NOT good) AS nb FROM r), g AS (SELECT *, least(ng, greatest(1, round_even(90.0 * ng / (ng + nb), 0))) AS g FROM c), b AS (SELECT *, least(nb, greatest(1, 90 - g)) AS b FROM g),
z AS (SELECT CASE WHEN nb - b >= ng - g THEN g ELSE least(ng, g + greatest(90 - g - b, 0)) END AS wg, CASE WHEN nb - b >= ng - g THEN least(nb, b + greatest(90 - g - b, 0)) ELSE b END AS wb FROM b)
SELECT example_id, good FROM r, z WHERE (good AND {spread_sql('wg')}) OR (NOT good AND {spread_sql('wb')})""")
def k12(spark, sf_dir):
    r = d_traces(spark, sf_dir).where("step = 0").select("example_id", "label")
    top = r.agg(F.max("example_id").alias("top"))
    slot = cu.range_slot(F.col("example_id"), 0.0, F.col("top") + 1)
    out = cu.stratified_spread(r.crossJoin(F.broadcast(top)), F.col("label") >= 0, "example_id", 90, slot)
    return out.select("example_id", (F.col("label") < 0).alias("good"))


@query("k15_best_epoch", "SELECT l_suppkey, max_by(l_orderkey, l_extendedprice) AS best, min_by(l_orderkey, l_extendedprice) AS worst FROM lineitem GROUP BY l_suppkey")
def k15(spark, sf_dir):
    # of equal prices the first row of the files counts, and rows without an order don't
    price = F.when(F.col("l_orderkey").isNotNull(), F.col("l_extendedprice"))
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", price.alias("p"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    ends = rows.groupBy("l_suppkey").agg(F.max("p").alias("high"), F.min("p").alias("low"))
    met = rows.join(ends.withColumnRenamed("l_suppkey", "_k"), F.col("l_suppkey").eqNullSafe(F.col("_k")) & ((F.col("p") == F.col("high")) | (F.col("p") == F.col("low")) | F.col("high").isNull()))
    first = lambda end: F.min(F.when(F.col("p") == F.col(end), F.struct("file", "row", "l_orderkey")))["l_orderkey"]
    return met.groupBy("l_suppkey").agg(first("high").alias("best"), first("low").alias("worst"))


@query("k16_latest_run", "SELECT user_id, max_by(event_id, ts) AS latest, max(ts) AS ts FROM events GROUP BY user_id")
def k16(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"), F.max("ts").alias("ts"))


@query("w14_source_interleave", "SELECT pair_id, source_tag, CAST(turn AS INTEGER) AS turn, row_number() OVER (ORDER BY turn, source_tag) - 1 AS position FROM (SELECT pair_id, source_tag, row_number() OVER (PARTITION BY source_tag ORDER BY sha256('epoch|' || pair_id)) AS turn FROM d_pairs)")
def w14(spark, sf_dir):
    return cu.interleave(d_pairs(spark, sf_dir).select("pair_id", "source_tag"), "source_tag", cu.hash_order("epoch", F.col("pair_id")))


@query("w1_g3_prefixes", "SELECT doc_id, step, sha256(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY step)) AS prefix_sha, CAST(length(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY step)) AS INTEGER) AS prefix_chars FROM d_steps")
def w1(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    rows = docs.select("doc_id", kept.alias("k")).where(F.size("k") > 0).select("doc_id", "k", F.explode(F.sequence(F.lit(0), F.size("k") - 1)).alias("step"))
    prefix = F.array_join(F.slice("k", F.lit(1), F.col("step") + 1), "\n")
    return rows.select("doc_id", "step", F.sha2(prefix, 256).alias("prefix_sha"), F.length(prefix).alias("prefix_chars"))


@query("w20_first_difference", """WITH p AS (SELECT a.doc_id, a.step, a.line AS x, b.line AS y, least(length(a.line), length(b.line)) AS n FROM d_steps a JOIN d_steps b ON a.doc_id = b.doc_id AND b.step = a.step + 1)
SELECT doc_id, step, CAST(CASE WHEN x = y THEN NULL ELSE coalesce(list_position(list_transform(range(1, n + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1)), true), n + 1) END AS INTEGER) AS first_difference FROM p""")
def w20(spark, sf_dir):
    p = d_pairs(spark, sf_dir)
    a, b = F.col("chosen_text"), F.col("rejected_text")
    return p.select("doc_id", "step", F.when(a != b, common_prefix(a, b) + 1).alias("first_difference"))


@query("p1_p2_prompts", r"""SELECT doc_id, step, '[SYSTEM]' || chr(10) || 'Be exact.' || chr(10) || chr(10) || '[USER]' || chr(10) || 'Q: ' || line || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) AS prompt_text, CASE WHEN step % 2 = 0 THEN line || chr(10) || 'Answer: yes' ELSE 'Answer: yes' END AS target_text FROM d_steps""")
def p1(spark, sf_dir):
    from ..operators.prompts import compose_prompt, target_text

    s = d_steps(spark, sf_dir)
    cot = F.when(F.col("step") % 2 == 0, F.col("line")).otherwise("  ")
    return s.select("doc_id", "step", compose_prompt(F.lit("Be exact."), F.lit("Q: {question}"), F.col("line")).alias("prompt_text"), target_text("cot_then_answer", cot, F.lit("yes"), "Answer: ").alias("target_text"))


@query("p3_p4_target_split", """WITH s AS (SELECT doc_id, list(line ORDER BY step) AS l FROM d_steps GROUP BY doc_id) SELECT doc_id, array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), chr(10)) AS reasoning, 'yes' AS answer FROM s""")
def p3(spark, sf_dir):
    from ..operators.prompts import last_lines, split_target

    docs = t(spark, sf_dir, "documents")
    x = split_target(F.concat(F.col("text"), F.lit("\nAnswer: yes")), ["Answer:"])
    return docs.select("doc_id", x.alias("x")).select("doc_id", last_lines(F.col("x.reasoning"), 2).alias("reasoning"), F.col("x.answer").alias("answer"))


@query("j1_joins_inner_left_coalesce", """SELECT d.doc_id, l.quality, coalesce(l.quality, s.mean_quality, 0.5) AS fused FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT d.source, round(avg(l.quality), 9) AS mean_quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source) s ON s.source = d.source""")
def j1(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels").select("doc_id", "quality")
    means = d.join(lab, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 9).alias("m"))
    return d.join(lab, "doc_id", "left").join(means, "source", "left").select("doc_id", "quality", F.coalesce(F.col("quality").cast("double"), "m", F.lit(0.5)).alias("fused"))


@query("j7_combined_scores", "SELECT a.vec_id, round((CAST(a.embedding[1] AS DOUBLE) * 0.7 + b.s * 0.3), 6) AS mixed, round(least(CAST(a.embedding[1] AS DOUBLE), b.s), 6) AS low, round(greatest(CAST(a.embedding[1] AS DOUBLE), b.s), 6) AS high FROM embeddings a JOIN (SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS s FROM embeddings WHERE label < 5) b ON a.vec_id = b.vec_id")
def j7(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding")[0].cast("double").alias("x")), e.where("label < 5").select("vec_id", F.col("embedding")[1].cast("double").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(F.col("x") * 0.7 + F.col("y") * 0.3, 6).alias("mixed"), F.round(F.least("x", "y"), 6).alias("low"), F.round(F.greatest("x", "y"), 6).alias("high"))


@query("j8_a27_flips", """WITH a AS (SELECT doc_id, quality = 1 AS said FROM labels), b AS (SELECT doc_id, predicted AS said FROM d_predictions)
SELECT count(*) AS n, count(*) FILTER (a.said AND NOT b.said) AS yes_to_no, count(*) FILTER (NOT a.said AND b.said) AS no_to_yes, round(count(*) FILTER (a.said <> b.said) / count(*), 9) AS flip_rate FROM a JOIN b ON a.doc_id = b.doc_id""")
def j8(spark, sf_dir):
    a = t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("x"))
    b = d_predictions(spark, sf_dir).select("doc_id", F.col("predicted").alias("y"))
    x, y = F.col("x"), F.col("y")
    return rounded(a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(x & ~y).alias("yes_to_no"), F.count_if(~x & y).alias("no_to_yes"), (F.count_if(x != y) / F.count(F.lit(1))).alias("flip_rate")))


@query("g9_nearest_negative", f"""WITH {SIGN_SQL} SELECT p.key AS doc_id, p.step AS positive, arg_min(n.step, struct_pack(d := abs(n.step - p.step), s := n.step)) AS negative FROM s p JOIN s n ON p.key = n.key AND p.sign = '+' AND n.sign = '-' GROUP BY p.key, p.step""")
def g9(spark, sf_dir):
    from ..operators.pairs import step_places

    found = signed(spark, sf_dir).select("key", F.explode(step_places("legacy_nearest", F.col("signs"), 0)).alias("p"))
    return found.select(F.col("key").alias("doc_id"), F.col("p.good").alias("positive"), F.col("p.bad").alias("negative"))


@query("g18_turn_pairs", """SELECT conv_id, turn, role, next_role, sha256(text || '||' || next_text) AS pair_id FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def g18(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user' and next_role = 'assistant'")
    return c.select("conv_id", "turn", "role", "next_role", F.sha2(F.concat_ws("||", "text", "next_text"), 256).alias("pair_id"))


@query("g26_pair_weights", """SELECT pair_id, round(pair_confidence * (CASE coalesce(semantics, 'u') WHEN 'terminal' THEN 0.5 ELSE 1.0 END) * (count(*) OVER () / ((SELECT count(DISTINCT coalesce(semantics, 'u')) FROM d_pairs) * count(*) OVER (PARTITION BY coalesce(semantics, 'u')))), 9) AS weight FROM d_pairs""")
def g26(spark, sf_dir):
    p = d_pairs(spark, sf_dir).withColumn("u", F.coalesce("semantics", F.lit("u")))
    counts = p.groupBy("u").agg(F.count(F.lit(1)).alias("k")).withColumns({"n": F.sum("k").over(W.partitionBy()), "g": F.count(F.lit(1)).over(W.partitionBy())})
    scale = F.when(F.col("u") == "terminal", 0.5).otherwise(1.0)
    return rounded(p.join(F.broadcast(counts), "u").select("pair_id", (F.col("pair_confidence") * scale * (F.col("n") / (F.col("g") * F.col("k")))).alias("weight")))


@query("g29_rollout_jobs", "SELECT doc_id, CAST(k AS INTEGER) AS rollout_index FROM labels, generate_series(0, 3) AS s(k)")
def g29(spark, sf_dir):
    return t(spark, sf_dir, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rollout_index"))
