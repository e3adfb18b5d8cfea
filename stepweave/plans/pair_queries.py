"""Pair converters over lines with hash signs, and readers over driver tables in their raw forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from ..operators import pairs as pr
from ..sources import readers as rd
from .registry import query, t
from .trace_queries import rounded

SIGN_SQL = """s AS (SELECT doc_id AS key, step, CASE WHEN ('0x' || substr(sha256('bad:' || doc_id || ':' || step), 1, 8))::BIGINT % 7 = 0 THEN '-' ELSE '+' END AS sign FROM d_steps),
k AS (SELECT key, count(*) AS n, min(CASE WHEN sign = '-' THEN step END) AS k FROM s GROUP BY key)"""


def signed(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    signs = F.transform(F.col("steps"), lambda _, i: F.when(hash_bucket(F.concat(F.lit("bad:"), F.col("key").cast("string"), F.lit(":"), i.cast("string")), 7) == 0, "-").otherwise("+"))
    return docs.select(F.col("doc_id").alias("key"), kept.alias("steps")).where(F.size("steps") > 0).withColumn("signs", signs)


@query("g6_w2_first_bad_edge", f"WITH {SIGN_SQL} SELECT key, k - 1 AS good, k AS bad, CAST(0.74 AS DOUBLE) AS confidence FROM k WHERE k > 0")
def g6(spark, sf_dir):
    return pr.first_bad_edge(signed(spark, sf_dir))


@query("g17_rated_pairs", """WITH c AS (SELECT user_id AS key, CASE WHEN value > 14 THEN 1 WHEN value > 6 THEN 0 ELSE -1 END AS rating FROM events),
b AS (SELECT key, max(rating) FILTER (rating >= 0) AS br, min(rating) FILTER (rating < 0) AS wr FROM c GROUP BY key)
SELECT key, 0 AS step, CAST(CASE WHEN br - wr >= 2 THEN 0.78 WHEN br - wr >= 1 THEN 0.70 ELSE 0.62 END AS DOUBLE) AS confidence FROM b WHERE br IS NOT NULL AND wr IS NOT NULL""")
def g17(spark, sf_dir):
    rating = F.when(F.col("value") > 14, 1).when(F.col("value") > 6, 0).otherwise(-1)
    c = t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct(rating.alias("rating"), F.col("event_id").cast("string").alias("text")).alias("c"))
    # a user's best and worst stand for all completions, which a group need not hold
    ends = c.groupBy("key").agg(F.max(F.when(F.col("c.rating") >= 0, F.col("c"))).alias("best"), F.min(F.when(F.col("c.rating") < 0, F.col("c"))).alias("worst"))
    rows = ends.select("key", F.array(F.array_compact(F.array("best", "worst"))).alias("completions"))
    return pr.rated_pairs(rows).select("key", "step", "confidence")


@query("g28_geometry_class", f"""WITH {SIGN_SQL} SELECT a.key, a.step AS good, b.step AS bad, CASE WHEN b.step = k.k AND a.step = k.k - 1 THEN 'lastsafe_vs_firstbad' WHEN b.step = k.k THEN 'earlygood_vs_firstbad' WHEN a.step = k.k - 1 THEN 'lastsafe_vs_laterbad' ELSE 'earlygood_vs_laterbad' END AS pair_type,
CASE WHEN b.step - a.step <= 1 THEN 'gap1' WHEN b.step - a.step = 2 THEN 'gap2' WHEN b.step - a.step <= 4 THEN 'gap3_4' ELSE 'gap5p' END AS gap FROM k JOIN s a ON a.key = k.key AND a.step < k.k JOIN s b ON b.key = k.key AND b.step >= k.k""")
def g28(spark, sf_dir):
    k = signed(spark, sf_dir).select("key", F.size("signs").alias("n"), pr.first_negative(F.col("signs")).cast("int").alias("k")).where("k > 0")
    each = k.select("key", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("good")).select("key", "k", "good", F.explode(F.sequence(F.col("k"), F.col("n") - 1)).alias("bad"))
    return each.select("key", "good", "bad", pr.pair_type(F.col("good"), F.col("bad"), F.col("k")).alias("pair_type"), pr.gap_bucket(F.col("bad") - F.col("good")).alias("gap"))


@query("s2_hash_marked", "SELECT 'gsm8k:' || item_id AS id, 'gsm8k' AS dataset, trim(text) AS question, CAST(item_id * 3 AS VARCHAR) AS answer, trim('think #### twice about ' || item_id) AS cot FROM benchmark")
def s2(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    raw = b.select(i.alias("idx"), F.col("text").alias("question"), F.concat(F.lit("think #### twice about "), i.cast("string"), F.lit("\n#### "), (i * 3).cast("string")).alias("answer"))
    return rd.hash_marked(raw).withColumn("cot", F.regexp_replace("cot", r"\n$", ""))


@query("s7_worked_solutions", "SELECT 'math:' || item_id AS id, CASE item_id % 3 WHEN 0 THEN CAST(item_id AS VARCHAR) WHEN 1 THEN 'x = ' || item_id ELSE 'no line' END AS answer FROM benchmark")
def s7(spark, sf_dir):
    i = F.col("item_id").cast("string")
    n = F.col("item_id") % 3
    solution = F.when(n == 0, F.concat(F.lit("a\nso \\boxed{"), i, F.lit("} end"))).when(n == 1, F.concat(F.lit("a\nTherefore, $x = "), i, F.lit("$\n"))).otherwise("no line")
    return rd.worked_solutions(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("problem"), solution.alias("solution"))).select("id", "answer")


@query("s15_g21_traces", "SELECT doc_id AS example_id, step, doc_id % 4 = 0 OR step < doc_id % 4 AS is_good FROM d_steps")
def s15(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    label = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 4).cast("int"))
    raw = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("generator"), F.col("lang").alias("problem"), kept.alias("steps"), label.alias("label"))
    return rd.traces(raw).select("example_id", "step", "is_good")


@query("s19_completeness", "SELECT 'gsm8k' AS dataset, count(*) AS n, count(*) AS with_question, count(*) AS with_answer, count(*) FILTER (item_id % 2 = 0) AS with_cot FROM benchmark")
def s19(spark, sf_dir):
    i = F.col("item_id").cast("string")
    raw = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("why #### "), i)).otherwise(i).alias("answer"))
    return rd.completeness(rd.hash_marked(raw))
