"""Converters end to end: labelled steps, rated completions, verifier replies and forks to pair records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curation as cu
from ..operators import pairs as pr
from .pair_queries import SIGN_SQL, signed
from .registry import d_pairs, query, t
from .trace_queries import rounded


def diverse(n: str, m: int) -> str:
    """SQL list of the places (from 0) that a choice of m out of n candidates takes."""
    if m == 2:
        return f"CASE WHEN {n} <= 2 THEN range(0, {n}) ELSE [0, {n} - 1] END"
    return f"CASE WHEN {n} <= {m} THEN range(0, {n}) ELSE list_concat([0], list_transform(range(0, {m - 1}), lambda i: CAST(1 + round_even(i * ({n} - 2) / {m - 2}.0, 0) AS BIGINT))) END"


def places_sql(mode: str, m: int) -> str:
    """p(key, good, bad, confidence, meaning) of a mode over SIGN_SQL's s and k."""
    confidence = "greatest(0.74 - 0.04 * least(greatest(k - 1 - good, 0), 4) - 0.03 * least(greatest(bad - k, 0), 4), 0.55)"
    return {
        "edge": "p AS (SELECT key, k - 1 AS good, k AS bad, 0.74 AS confidence, 'local_first_bad_edge' AS meaning FROM k WHERE k > 0)",
        "fanout": f"c AS (SELECT key, k, k - 1 - unnest({diverse('k', m)}) AS good, k AS bad FROM k WHERE k > 0), p AS (SELECT key, good, bad, {confidence} AS confidence, 'first_bad_fanout_prefix_ranking' AS meaning FROM c)",
        "grid": f"""c AS (SELECT k.key, k.k, k.n, a.step AS good, b.step AS bad, row_number() OVER (PARTITION BY k.key ORDER BY CASE WHEN a.step = k.k - 1 AND b.step = k.k THEN 0 WHEN b.step = k.k THEN 1 WHEN a.step = k.k - 1 THEN 2 ELSE 3 END, b.step, a.step DESC) - 1 AS i
            FROM k JOIN s a ON a.key = k.key AND a.step < k.k JOIN s b ON b.key = k.key AND b.step >= k.k WHERE k.k > 0),
          p AS (SELECT key, good, bad, {confidence} AS confidence, 'good_bad_prefix_grid' AS meaning FROM c WHERE list_contains({diverse('k * (n - k)', m)}, i))""",
        "nearest": """c AS (SELECT a.key, a.step AS good, arg_min(b.step, struct_pack(d := abs(a.step - b.step), s := b.step)) AS bad FROM s a JOIN s b ON a.key = b.key AND a.sign = '+' AND b.sign = '-' GROUP BY a.key, a.step),
          p AS (SELECT key, good, bad, CASE WHEN abs(good - bad) <= 2 THEN 0.62 ELSE 0.55 END AS confidence, 'same_trajectory_depth_mixed' AS meaning FROM c)""",
        "anchors": f"c AS (SELECT key, n, unnest({diverse('(n - 1)', m)}) AS i FROM k WHERE k IS NULL AND n >= 2), p AS (SELECT key, n - 1 AS good, n - 2 - i AS bad, CASE WHEN i = 0 THEN 0.70 ELSE 0.66 END AS confidence, 'terminal_completion_anchor' AS meaning FROM c)",
    }[mode]


@query("g7_first_bad_fanout", f"WITH {SIGN_SQL}, {places_sql('fanout', 2)} SELECT key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, CAST(confidence AS DOUBLE) AS confidence FROM p")
def g7(spark, sf_dir):
    return rounded(pr.first_bad_fanout(signed(spark, sf_dir)))


@query("g7_w16_fanout_of_five", f"WITH {SIGN_SQL}, {places_sql('fanout', 5)} SELECT key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, CAST(confidence AS DOUBLE) AS confidence FROM p")
def g7_five(spark, sf_dir):
    return rounded(pr.first_bad_fanout(signed(spark, sf_dir), 5))


@query("g8_g11_good_bad_grid", f"WITH {SIGN_SQL}, {places_sql('grid', 6)} SELECT key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, round(CAST(confidence AS DOUBLE), 9) AS confidence FROM p")
def g8(spark, sf_dir):
    return rounded(pr.all_good_vs_all_bad(signed(spark, sf_dir)))


@query("g10_terminal_anchors", f"WITH {SIGN_SQL}, {places_sql('anchors', 3)} SELECT key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, CAST(confidence AS DOUBLE) AS confidence FROM p")
def g10(spark, sf_dir):
    return pr.terminal_anchors(signed(spark, sf_dir), 3)


def flagged_sql(rows: str, prompt: str, source: str, domain: str) -> str:
    """rows (chosen, rejected) with flags that pass the filter, and ids; as r."""
    squash = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"""sq AS (SELECT *, {squash('chosen')} AS c, {squash('rejected')} AS d, {squash(prompt)} AS q FROM {rows}),
fl AS (SELECT *, length(c) AS nc, length(d) AS nd, list_distinct(list_filter(string_split(c, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(d, ' '), lambda x: x <> '')) AS b FROM sq),
fm AS (SELECT *, len(list_intersect(a, b)) AS bo FROM fl),
r AS (SELECT *, substr(sha256({source} || chr(0) || {domain} || chr(0) || q || chr(0) || c || chr(0) || d || chr(0)), 1, 20) AS pair_id, bo / greatest(len(a) + len(b) - bo, 1) AS overlap
  FROM fm WHERE c <> d AND nc >= 12 AND nd >= 12 AND greatest(nc, nd) / greatest(least(nc, nd), 1) <= 4.0 AND bo / greatest(len(a) + len(b) - bo, 1) <= 0.995)"""


LISTS = "l AS (SELECT doc_id AS key, list(line ORDER BY step) AS l FROM d_steps GROUP BY doc_id)"
TEXTS = "tx AS (SELECT p.*, array_to_string(list_slice(l, 1, good + 1), chr(10)) || chr(10) AS chosen, array_to_string(list_slice(l, 1, bad + 1), chr(10)) || chr(10) AS rejected FROM p JOIN l ON l.key = p.key)"


def records_sql(parts: list[str], m: int, cap: int | None = None) -> str:
    """Records of one mode, and of anchors behind it; cap: of the rows of a key that pass, the first by good step."""
    base = places_sql(parts[0], m)
    more = ""
    if len(parts) > 1:
        base = base.replace("p AS (", "p1 AS (").replace("c AS (", "c1 AS (").replace("FROM c)", "FROM c1)").replace("FROM c WHERE", "FROM c1 WHERE")
        ends = places_sql("anchors", m).replace("p AS (", "p2 AS (").replace("c AS (", "c2 AS (").replace("FROM c)", "FROM c2)")
        more = f", {ends}, p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"
    keep = f" QUALIFY meaning = 'terminal_completion_anchor' OR row_number() OVER (PARTITION BY key, meaning ORDER BY good) <= {cap}" if cap else ""
    return f"""WITH {SIGN_SQL}, {base}{more}, {LISTS}, {TEXTS}, {flagged_sql('tx', "('Q' || key || chr(10) || chr(10))", "'docs'", "'text'")}
SELECT key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad, pair_id, 'docs|source_row_index=' || key AS split_group_id, meaning AS pair_semantics, round(CAST(confidence AS DOUBLE), 9) AS confidence, round(overlap, 9) AS overlap FROM r{keep}"""


def converted(spark, sf_dir, mode, most, anchors=True):
    rows = signed(spark, sf_dir)
    out = pr.convert_steps(rows, mode, F.lit("docs"), F.lit("text"), F.concat(F.lit("Q"), F.col("key").cast("string"), F.lit("\n\n")), most, anchors, places={"source_row_index": F.col("key")})
    return rounded(out.select("key", "good", "bad", "pair_id", "split_group_id", "pair_semantics", "confidence", F.col("q.token_overlap_ratio").alias("overlap")))


@query("g5_g6_g12_records_edge", records_sql(["edge", "anchors"], 2))
def records_edge(spark, sf_dir):
    return converted(spark, sf_dir, "first_bad_edge_strict", 2)


@query("g5_g7_g12_records_fanout", records_sql(["fanout", "anchors"], 4))
def records_fanout(spark, sf_dir):
    return converted(spark, sf_dir, "first_bad_fanout", 4)


@query("g5_g8_g12_records_grid", records_sql(["grid"], 5))
def records_grid(spark, sf_dir):
    return converted(spark, sf_dir, "all_good_vs_all_bad", 5, anchors=False)


@query("g5_g9_g12_records_nearest", records_sql(["nearest", "anchors"], 3, cap=3))
def records_nearest(spark, sf_dir):
    return converted(spark, sf_dir, "legacy_nearest", 3)


# steps of orders with three rated completions each
RATED = """i AS (SELECT l_orderkey AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS step, l_partkey AS p, l_suppkey AS s FROM lineitem),
cs AS (SELECT key, step, j, 'part ' || (p + j * 13) || ' fits this order well' AS text, CASE (p + j * 5) % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN -1 WHEN 5 THEN -1 END AS rating, CASE WHEN s % 3 = 0 THEN s % 4 END AS told FROM i, range(0, 3) x(j))"""


def best_sql(good: str, bad: str) -> str:
    return f"""b AS (SELECT key, step, arg_min(text, struct_pack(r := -rating, j := j)) FILTER (rating {good}) AS good, max(rating) FILTER (rating {good}) AS gr, arg_min(text, struct_pack(r := rating, j := j)) FILTER (rating {bad}) AS bad, min(rating) FILTER (rating {bad}) AS br, max(CASE WHEN j = told THEN text END) AS told FROM cs GROUP BY key, step)"""


def rated_steps(spark, sf_dir):
    p = F.col("l_partkey")
    rating = lambda j: F.element_at(F.array(*(F.lit(x).cast("int") for x in (1, 1, 0, 0, -1, -1, None))), ((p + j * 5) % 7 + 1).cast("int"))
    completions = F.array(*(F.struct(F.concat(F.lit("part "), (p + j * 13).cast("string"), F.lit(" fits this order well")).alias("text"), rating(j).alias("rating")) for j in range(3)))
    told = F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 4).cast("int"))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(completions.alias("completions"), told.alias("chosen_completion")).alias("s"))
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select("key", F.transform("x", lambda x: x["s"]).alias("steps"))


@query("g17_completion_records", f"""WITH {RATED}, {best_sql('>= 0', '< 0')}, h AS (SELECT *, string_agg(coalesce(told, good) || chr(10), '') OVER (PARTITION BY key ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM b),
tx AS (SELECT key, step, coalesce(hist, '') || good || chr(10) AS chosen, coalesce(hist, '') || bad || chr(10) AS rejected, CASE WHEN gr - br >= 2 THEN 0.78 ELSE 0.70 END AS confidence FROM h WHERE good IS NOT NULL AND bad IS NOT NULL), {flagged_sql('tx', "('order ' || key)", "'prm800k'", "'general_math'")}
SELECT key, step, pair_id, sha256(chosen) AS chosen_sha, CAST(confidence AS DOUBLE) AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY step) <= 2""")
def g17_records(spark, sf_dir):
    out = pr.completion_pairs(rated_steps(spark, sf_dir), F.lit("prm800k"), F.lit("general_math"), F.concat(F.lit("order "), F.col("key").cast("string")), 2)
    return out.select("key", "step", "pair_id", F.sha2("chosen", 256).alias("chosen_sha"), "confidence")


@query("g20_rating_policies", f"""WITH {RATED}, {best_sql('>= 0', '< 0')}, {best_sql('> 0', '<= 0').replace('b AS', 'b2 AS', 1)},
x AS (SELECT 'nonnegative' AS policy, * FROM b WHERE good IS NOT NULL AND bad IS NOT NULL UNION ALL SELECT 'strictly_positive', * FROM b2 WHERE good IS NOT NULL AND bad IS NOT NULL)
SELECT policy, count(*) AS pairs, count(DISTINCT key) AS rows_with_pairs, count(*) FILTER (gr = 0) AS zero_as_good, count(*) FILTER (br = 0) AS zero_as_bad FROM x GROUP BY policy""")
def g20(spark, sf_dir):
    return pr.rating_policies(rated_steps(spark, sf_dir))


CONV = """cv AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Assistant ' ELSE upper(role) END AS role, CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 5 WHEN 0 THEN ' - ' WHEN 1 THEN text ELSE '+' END ELSE text END AS content FROM conversations)"""


@query("g18_conversation_signs", f"""WITH {CONV}, n AS (SELECT *, lead(role) OVER w AS r2, lead(content) OVER w AS c2 FROM cv WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, turn, trim(content, ' ' || chr(10) || chr(9) || chr(13)) AS step, trim(c2) AS sign FROM n WHERE role = 'USER' AND trim(r2) = 'Assistant' AND trim(c2) IN ('+', '-') AND length(trim(content, ' ' || chr(10) || chr(9) || chr(13))) > 0)
SELECT conv_id, string_agg(sign, '' ORDER BY turn) AS signs, sha256(string_agg(step, '|' ORDER BY turn)) AS steps_sha FROM g GROUP BY conv_id""")
def g18_signs(spark, sf_dir):
    return conversation_steps(spark, sf_dir).where(F.size("steps") > 0).select(F.col("key").alias("conv_id"), F.array_join("signs", "").alias("signs"), F.sha2(F.array_join("steps", "|"), 256).alias("steps_sha"))


def conversation_steps(spark, sf_dir):
    n = (F.col("conv_id") + F.col("turn")) % 5
    content = F.when(F.col("role") == "assistant", F.when(n == 0, " - ").when(n == 1, F.col("text")).otherwise("+")).otherwise(F.col("text"))
    role = F.when(F.col("role") == "assistant", "Assistant ").otherwise(F.upper("role"))
    turns = t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), content.alias("content")))).alias("turns"))
    return turns.withColumn("x", pr.conversation_signs(F.col("turns"))).select("key", F.transform("x", lambda x: x["text"]).alias("steps"), F.transform("x", lambda x: x["sign"]).alias("signs"), F.get("turns", F.lit(0))["content"].alias("opening"))


@query("g18_conversation_records", f"""WITH {CONV}, n AS (SELECT *, lead(role) OVER w AS r2, lead(content) OVER w AS c2 FROM cv WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step, trim(content, ' ' || chr(10) || chr(9) || chr(13)) AS line, trim(c2) AS sign FROM n WHERE role = 'USER' AND trim(r2) = 'Assistant' AND trim(c2) IN ('+', '-') AND length(trim(content, ' ' || chr(10) || chr(9) || chr(13))) > 0),
k AS (SELECT key, count(*) AS n, min(CASE WHEN sign = '-' THEN step END) AS k FROM g GROUP BY key), {places_sql('edge', 2)}, o AS (SELECT conv_id, content FROM cv QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
l AS (SELECT key, list(line ORDER BY step) AS l FROM g GROUP BY key), tx AS (SELECT p.*, substr(trim(regexp_replace(o.content, '\\s+', ' ', 'g')), 1, 512) AS opening, array_to_string(list_slice(l, 1, good + 1), chr(10)) || chr(10) AS chosen, array_to_string(list_slice(l, 1, bad + 1), chr(10)) || chr(10) AS rejected FROM p JOIN l ON l.key = p.key JOIN o ON o.conv_id = p.key), {flagged_sql('tx', "(opening || chr(10) || chr(10))", "'rlhflow_mistral'", "'general_math'")}
SELECT key, CAST(good AS INTEGER) AS good, pair_id, sha256(chosen) AS chosen_sha FROM r""")
def g18_records(spark, sf_dir):
    rows = conversation_steps(spark, sf_dir)
    out = pr.convert_steps(rows, "first_bad_edge_strict", F.lit("rlhflow_mistral"), F.lit("general_math"), F.concat(tx.problem_prefix(F.col("opening")), F.lit("\n\n")))
    return out.select("key", "good", "pair_id", F.sha2("chosen", 256).alias("chosen_sha"))


CASES = """v AS (SELECT doc_id, lang, source, doc_id % 6 AS m FROM documents),
w AS (SELECT doc_id, m, 'Question: what is ' || doc_id || chr(10) || chr(10) || 'Previous Steps:' || chr(10) || 'from ' || source || chr(10) || chr(10) || 'Now Step:' || chr(10) || 'say ' || lang || chr(10) || chr(10) || 'Task: Decide whether the Now Step is correct.' || chr(10) || 'Verification: ' AS prompt FROM v)"""


def verifier_rows(spark, sf_dir):
    d, m = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    line = lambda x: F.concat(F.lit("so\nVerification: Is the step correct (Yes/No)? "), x, F.lit(" then"))
    before = F.when(m == 2, " ").otherwise(F.concat(F.lit("from "), F.col("source")))
    case = F.concat(F.lit("A long rubric.\nQuestion: what is "), d, F.lit("\nPrevious Steps: "), before, F.lit("\nNow Step: say "), F.col("lang"), F.lit("\nPlease carefully analyze the correctness of the Now Step. Reply: "))
    chosen = F.when(m == 3, "no verdict at all here").otherwise(F.concat(line(F.lit("No")), line(F.when(m == 0, "no").otherwise("YES"))))
    rejected = F.when(m == 4, line(F.lit("Yes"))).otherwise(line(F.when(m == 0, "Yes").otherwise("No")))
    return t(spark, sf_dir, "documents").select("doc_id", case.alias("instruction"), chosen.alias("chosen"), rejected.alias("rejected"))


@query("g13_c17_compact_verdicts", f"""WITH {CASES}, tx AS (SELECT doc_id, prompt, CASE WHEN m = 0 THEN 'The Now Step is incorrect. Final answer: No.' ELSE 'The Now Step is correct. Final answer: Yes.' END || chr(10) AS chosen, CASE WHEN m = 0 THEN 'The Now Step is correct. Final answer: Yes.' ELSE 'The Now Step is incorrect. Final answer: No.' END || chr(10) AS rejected FROM w WHERE m IN (0, 1, 5)),
{flagged_sql('tx', 'prompt', "'r_prm'", "'general_math'")} SELECT doc_id, pair_id, chosen AS chosen_text, sha256(prompt) AS prompt_sha, CAST(0.86 AS DOUBLE) AS confidence FROM r""")
def g13(spark, sf_dir):
    out = pr.verifier_pairs(verifier_rows(spark, sf_dir))
    return out.select("doc_id", "pair_id", F.col("chosen").alias("chosen_text"), F.sha2("prompt_text", 256).alias("prompt_sha"), "confidence")


@query("g13_compact_correctness", f"""WITH {CASES}, tx AS (SELECT doc_id, prompt, CASE WHEN m = 0 THEN 'The Now Step is incorrect.' ELSE 'The Now Step is correct.' END || chr(10) AS chosen, CASE WHEN m = 0 THEN 'The Now Step is correct.' ELSE 'The Now Step is incorrect.' END || chr(10) AS rejected FROM w WHERE m IN (0, 1, 5)),
{flagged_sql('tx', 'prompt', "'r_prm'", "'general_math'")} SELECT doc_id, pair_id, CAST(0.86 AS DOUBLE) AS confidence FROM r""")
def g13_correctness(spark, sf_dir):
    return pr.verifier_pairs(verifier_rows(spark, sf_dir), "compact_correctness").select("doc_id", "pair_id", "confidence")


@query("g13_direct_pairs", f"""WITH p AS (SELECT doc_id, step, domain_tag, chosen_text AS chosen, rejected_text AS rejected FROM d_pairs), {flagged_sql('p', "('ask ' || doc_id)", "'r_prm'", "'general_math'")} SELECT doc_id, step, pair_id, CAST(0.78 AS DOUBLE) AS confidence FROM r""")
def g13_direct(spark, sf_dir):
    rows = d_pairs(spark, sf_dir).select("doc_id", "step", F.concat(F.lit("ask "), F.col("doc_id").cast("string")).alias("instruction"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"))
    return pr.verifier_pairs(rows, "direct_pair_legacy").select("doc_id", "step", "pair_id", "confidence")


MARKED = "e AS (SELECT doc_id AS key, unnest([doc_id % 5, doc_id % 9]) AS e FROM documents WHERE doc_id % 10 <> 7)"


def marked_processes(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").where("doc_id % 10 <> 7")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    other = F.transform("original", lambda x: F.concat(x, F.lit(", or not")))
    rows = docs.select(F.col("doc_id").alias("key"), kept.alias("original"), F.array((F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 9).cast("int")).alias("error_steps"))
    return rows.where(F.size("original") > 0).withColumn("modified", other)


@query("g14_error_step_pairs", f"""WITH {MARKED}, {LISTS} SELECT e.key, CAST(e AS INTEGER) AS at, sha256(array_to_string(list_slice(l, 1, e + 1), chr(10)) || chr(10)) AS chosen_sha, sha256(array_to_string(list_transform(list_slice(l, 1, e + 1), lambda x: x || ', or not'), chr(10)) || chr(10)) AS rejected_sha FROM e JOIN l ON l.key = e.key WHERE e < len(l)""")
def g14(spark, sf_dir):
    out = pr.error_step_pairs(marked_processes(spark, sf_dir), one_based=False)
    return out.select("key", "at", F.sha2("chosen", 256).alias("chosen_sha"), F.sha2("rejected", 256).alias("rejected_sha"))


@query("g15_s16_index_base", f"""WITH {MARKED}, {LISTS}, x AS (SELECT doc_id % 3 AS part, e.e, len(l) AS n FROM e JOIN l ON l.key = e.key JOIN documents d ON d.doc_id = e.key)
SELECT part, CASE WHEN bool_or(v = 0) AND bool_or(v >= n) THEN 'mixed' WHEN bool_or(v = 0) THEN 'zero' WHEN bool_or(v >= n) THEN 'one' ELSE 'ambiguous' END AS base FROM (SELECT part, n, CASE part WHEN 0 THEN e WHEN 1 THEN least(e, n - 1) ELSE least(e + 1, n) END AS v FROM x) GROUP BY part""")
def g15(spark, sf_dir):
    out = None
    for part in range(3):
        n = F.size("original")
        made = {0: lambda e: e, 1: lambda e: F.least(e, n - 1), 2: lambda e: F.least(e + 1, n)}[part]
        rows = marked_processes(spark, sf_dir).where(F.col("key") % 3 == part).withColumn("error_steps", F.transform("error_steps", made))
        one = pr.index_base(rows).select(F.lit(part).cast("long").alias("part"), "base")
        out = one if out is None else out.unionByName(one)
    return out


@query("g19_fork_pairs", f"""WITH p AS (SELECT doc_id * 1000 + step AS "row", CASE WHEN step % 3 = 0 THEN '' ELSE 'Q' || doc_id END AS prompt, chosen_text || chr(10) AS prefix, CASE WHEN step % 5 = 4 THEN ' ' ELSE 'so it is' END AS good, 'so ' || rejected_text AS bad FROM d_pairs),
tx AS (SELECT *, prefix || good AS chosen, prefix || bad AS rejected FROM p WHERE trim(good) <> ''), {flagged_sql('tx', 'prompt', "''", "''")}
SELECT "row", sha256('math_step_dpo' || chr(0) || "row" || chr(0) || prompt || chr(0) || good || chr(0) || bad || chr(0)) AS pair_id, sha256('math_step_dpo' || chr(0) || prompt || chr(0) || prefix || chr(0)) AS split_group_id, CASE WHEN prompt <> '' THEN prompt || chr(10) || chr(10) ELSE '' END AS prompt_text, CAST(0.8 AS DOUBLE) AS confidence FROM r""")
def g19(spark, sf_dir):
    p = d_pairs(spark, sf_dir)
    prompt = F.when(F.col("step") % 3 == 0, None).otherwise(F.concat(F.lit("Q"), F.col("doc_id").cast("string")))
    good = F.when(F.col("step") % 5 == 4, " ").otherwise("so it is")
    rows = p.select((F.col("doc_id") * 1000 + F.col("step")).alias("row"), prompt.alias("prompt"), F.concat("chosen_text", F.lit("\n")).alias("prefix"), good.alias("chosen"), F.concat(F.lit("so "), F.col("rejected_text")).alias("rejected"))
    return pr.fork_pairs(rows).select("row", "pair_id", "split_group_id", "prompt_text", "confidence")


QUOTAS = cu.semantic_quotas(200, "local_first_bad_edge", "terminal_completion_anchor", 0.15)


@query("g16_k3_labelled_text", f"""WITH {SIGN_SQL}, {places_sql('edge', 2).replace('p AS', 'p1 AS')}, {places_sql('anchors', 2).replace('p AS', 'p2 AS')}, p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
l AS (SELECT doc_id AS key, list('Step ' || (step + 1) || ': ' || line ORDER BY step) AS l, any_value(lang) AS lang FROM d_steps GROUP BY doc_id), tx AS (SELECT p.*, CASE WHEN l.lang = 'en' THEN 'gsm8k_math' ELSE 'general_math' END AS domain, array_to_string(list_slice(l, 1, good + 1), chr(10)) || chr(10) AS chosen, array_to_string(list_slice(l, 1, bad + 1), chr(10)) || chr(10) AS rejected FROM p JOIN l ON l.key = p.key),
{flagged_sql('tx', "('Task ' || key || ' now')", "'math_shepherd'", 'domain')}
SELECT key, CAST(bad AS INTEGER) AS bad, pair_id, meaning AS pair_semantics, domain AS domain_tag FROM r QUALIFY row_number() OVER (PARTITION BY meaning ORDER BY key, bad DESC) <= CASE meaning WHEN 'local_first_bad_edge' THEN {QUOTAS['local_first_bad_edge']} ELSE {QUOTAS['terminal_completion_anchor']} END""")
def g16(spark, sf_dir):
    rows = signed(spark, sf_dir)
    label = F.concat(F.lit("Task "), F.col("key").cast("string"), F.lit(" now\n"), F.array_join(F.transform(F.arrays_zip("steps", "signs"), lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x["steps"], F.lit(" "), x["signs"])), "\n"))
    task = F.when(F.col("lang") == "en", " GSM8K ").otherwise("math")
    lang = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang")
    read = rows.select("key", label.alias("label")).join(lang, "key").select("key", task.alias("task"), tx.problem_prefix(F.col("label")).alias("problem"), tx.step_labels(F.col("label")).alias("x"))
    steps = read.select("key", "task", "problem", F.transform("x", lambda x: x["text"]).alias("steps"), F.transform("x", lambda x: x["sign"]).alias("signs"))
    domain = F.when(F.lower(F.trim(F.col("task"))) == "gsm8k", "gsm8k_math").otherwise("general_math")
    out = pr.convert_steps(steps, "first_bad_edge_strict", F.lit("math_shepherd"), domain, F.concat("problem", F.lit("\n\n")), anchors=True)
    quota = F.when(F.col("pair_semantics") == "local_first_bad_edge", QUOTAS["local_first_bad_edge"]).otherwise(QUOTAS["terminal_completion_anchor"])
    kept = cu.first_by_key(out, "pair_semantics", ["key", F.desc("bad")], quota, max(QUOTAS.values()))
    return kept.select("key", "bad", "pair_id", "pair_semantics", "domain_tag")
