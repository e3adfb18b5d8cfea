"""Readers, step sequences, corruption choices, anchors, profiles and the joins of the value data, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import stable_id
from ..operators import corruptions as co
from ..operators import curation as cu
from ..operators import metrics as me
from ..operators import pairs as pr
from ..operators import traces as tr
from ..sources import artifacts as ar
from ..sources import readers as rd
from .curation_queries import kinds
from .pair_queries import SIGN_SQL, signed
from .record_queries import LISTS, TEXTS, flagged_sql, places_sql
from .registry import d_lines, d_pairs, d_rollouts, d_steps, d_traces, query, t
from .report_queries import sql_text
from .trace_queries import rounded


@query("s1_s9_load_limit", "SELECT 'gsm8k:' || item_id AS id, 'gsm8k' AS dataset, trim(text) AS question, CAST(item_id AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS cot FROM benchmark ORDER BY id LIMIT 25")
def s1(spark, sf_dir):
    i = F.col("item_id")
    return rd.load(spark, "gsm8k", f"{sf_dir}/benchmark.parquet", limit=25, prepare=lambda b: b.select(i.alias("idx"), F.col("text").alias("question"), i.cast("string").alias("answer")))


@query("s3_yes_no_questions", r"""SELECT 'strategyqa:' || event_id AS id, event_type || '?' AS question, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'yes' ELSE 'no' END AS answer, '- ' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || '- user ' || user_id ELSE '' END AS cot FROM events""")
def s3(spark, sf_dir):
    n, e = F.col("event_id"), F.col("event_type")
    answer = F.element_at(F.array(*map(F.lit, ("True", " yes ", "1", "false", "maybe"))), (n % 5 + 1).cast("int"))
    facts = F.array(F.concat(F.lit(" "), e), F.when(n % 2 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string"))).otherwise(" "))
    return rd.yes_no_questions(t(spark, sf_dir, "events").select(n.alias("qid"), F.concat(e, F.lit("?")).alias("question"), answer.alias("answer"), facts.alias("decomposition"))).drop("dataset")


@query("s4_passages", """SELECT 'drop:' || page_id AS id, CASE page_id % 3 WHEN 0 THEN 'Passage: ' || url || chr(10) || 'Question: q' || page_id WHEN 1 THEN 'q' || page_id ELSE 'Passage: ' || url END AS question, 'first ' || page_id AS answer FROM pages WHERE page_id % 7 > 0""")
def s4(spark, sf_dir):
    p, n = F.col("page_id"), F.col("page_id") % 3
    spans = F.when(p % 7 > 0, F.array(F.concat(F.lit(" first "), p.cast("string")), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    raw = t(spark, sf_dir, "pages").select(p.alias("query_id"), F.when(n != 1, F.col("url")).alias("passage"), F.when(n != 2, F.concat(F.lit("q"), p.cast("string"))).otherwise(" ").alias("question"), spans.alias("spans"))
    return rd.passages(raw).select("id", "question", "answer")


@query("s5_premises", "SELECT 'proofwriter:' || item_id AS id, 'Theory: all is ' || item_id || chr(10) || 'Question: is it?' AS question, CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END AS answer, CASE WHEN item_id % 3 > 0 THEN 'proof ' || item_id END AS cot FROM benchmark")
def s5(spark, sf_dir):
    i = F.col("item_id")
    raw = t(spark, sf_dir, "benchmark").select(i.alias("id"), F.concat(F.lit("all is "), i.cast("string")).alias("theory"), F.lit("is it?").alias("question"), (i % 2 == 0).alias("answer"), F.when(i % 3 > 0, F.concat(F.lit("proof "), i.cast("string"))).otherwise("").alias("allProofs"))
    return rd.premises(raw).drop("dataset")


@query("s6_task_rows", "SELECT 'bbh:dyck:test:' || item_id AS id, 'bigbench_hard' AS dataset, trim(text) AS question, 'a' || item_id AS answer FROM benchmark")
def s6(spark, sf_dir):
    i = F.col("item_id")
    raw = t(spark, sf_dir, "benchmark").select(i.alias("idx"), F.col("text").alias("input"), F.concat(F.lit(" a"), i.cast("string")).alias("target"))
    return rd.task_rows(raw, "dyck").select("id", "dataset", "question", "answer")


@query("s8_eight_line_records", """WITH l AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS n, CASE (doc_id + pos) % 3 WHEN 0 THEN 'B. ' ELSE '' END || line AS raw FROM d_lines),
v AS (SELECT n // 8 AS idx, n % 8 AS k, CASE WHEN n % 8 = 1 THEN chr(97 + CAST((n // 8) % 5 AS INTEGER)) ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END AS v FROM l),
r AS (SELECT idx, max(CASE WHEN k = 1 THEN v END) AS letter, max(CASE WHEN k = 2 THEN v END) AS c, max(CASE WHEN k = 3 THEN v END) AS q, list(CASE WHEN v[1:3] IN ('A. ', 'B. ', 'C. ', 'D. ') THEN trim(v[4:]) ELSE v END ORDER BY k) FILTER (k > 3) AS o, count(*) AS n FROM v GROUP BY idx),
s AS (SELECT idx, letter, o, replace(replace(replace(CASE WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END, '?.', '?'), '!.', '!'), '..', '.') AS c, replace(replace(replace(CASE WHEN regexp_matches(q, '[.!?]$') THEN q ELSE q || '.' END, '?.', '?'), '!.', '!'), '..', '.') AS q FROM r WHERE n = 8)
SELECT 'logiqa:' || idx AS id, sha256('Context: ' || c || chr(10) || 'Question: ' || q || chr(10) || 'Options:' || chr(10) || 'A. ' || o[1] || chr(10) || 'B. ' || o[2] || chr(10) || 'C. ' || o[3] || chr(10) || 'D. ' || o[4]) AS question_sha, CASE WHEN letter IN ('a', 'b', 'c', 'd') THEN o[ascii(letter) - 96] ELSE '-1' END AS answer FROM s""")
def s8(spark, sf_dir):
    lines = d_lines(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("pos")).alias("line_no"), F.concat(F.when((F.col("doc_id") + F.col("pos") + 1) % 3 == 0, "B. ").otherwise(""), F.col("line")).alias("value"))
    marked = rd.eight_line_records(lines, 10_000_000)
    letter = (F.col("idx") % 5).cast("int")
    rows = marked.withColumn("correct_option", F.when(letter < 4, letter).otherwise(-1))  # the lines hold no letters
    return rd.multiple_choice(rows).select("id", F.sha2("question", 256).alias("question_sha"), "answer")


FILES = [('a.jsonl', '{"question": " q1 ", "steps": [{"text": "s1", "label": 1}, {"content": " ", "step": "s2", "rating": -1}, {"text": "s3", "correct": "yes"}, "text"]}\n\n{"problem": {"text": "p2"}, "label": {"steps": [{"output": "x", "is_correct": false}]}}'), ("b.json", '[{"input": "i3", "process": [{"completion": "c", "value": true}]}, 5, "x"]'), ("c.json", '{"records": [{"query": "q4"}, 7], "data": 3}'), ("d.json", '{"prompt": {"question": " p5"}, "label": {"process": [{"step": "z", "label": "maybe"}, {"step": "y", "label": null, "rating": 0}]}}')]
READ = [("a.jsonl", "q1", "s1+|s2-|s3+"), ("a.jsonl", "p2", "x-"), ("b.json", "i3", "c+"), ("c.json", "q4", ""), ("d.json", "p5", "")]


@query("s13_json_objects", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(sql_text(x) for x in r) + ')' for r in READ)}) v(path, prompt, steps)")
def s13(spark, sf_dir):
    files = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("path"), F.lit(b).alias("content")) for a, b in FILES))).alias("f")).select("f.*")
    v = F.col("value")
    steps = F.array_join(F.transform(rd.step_candidates(v), lambda x: F.concat(x["text"], x["sign"])), "|")
    return rd.json_objects(files).select("path", rd.prompt_of(v).alias("prompt"), steps.alias("steps"))


@query("s17_prepared_rows", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'malformed' WHEN event_id % 4 = 1 THEN 'blank_prompt' WHEN event_id % 4 = 2 THEN 'blank_target' ELSE 'ok' END AS state FROM events""")
def s17(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "{broken").when(i % 4 == 1, F.concat(F.lit('{"sample_id": "'), i.cast("string"), F.lit('", "prompt_text": " ", "target_text": "t"}'))).when(i % 4 == 2, F.concat(F.lit('{"sample_id": "'), i.cast("string"), F.lit('", "prompt_text": "p"}'))).otherwise(F.concat(F.lit('{"sample_id": "'), i.cast("string"), F.lit('", "prompt_text": "p", "target_text": "t"}')))
    rows = t(spark, sf_dir, "events").select(i, F.from_json(text, "sample_id string, prompt_text string, target_text string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("event_id", "r.*")
    some = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    reason = cu.first_reason([("malformed", F.col("_bad").isNull()), ("blank_prompt", some("prompt_text")), ("blank_target", some("target_text"))])
    return cu.once(rows, "event_id").select("event_id", F.coalesce(reason, F.lit("ok")).alias("state"))


@query("s18_sample_checks", "SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS checked, count(*) FILTER (contains(text, chr(10))) AS with_mark, count(*) FILTER (lang IS NULL OR trim(lang) = '' OR trim(text) = '') AS with_empty, 'answer' AS missing FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100)")
def s18(spark, sf_dir):
    return rd.sample_checks(t(spark, sf_dir, "documents"), ["text", "lang", "answer"], "doc_id", "text", "\n")


REPORT = ["# Run", "", "- group: `D6 x`", "- pair acc :  0.5 ", "-no: 1", "", "| Group | acc | note |", "|---|:---:|---|", "| a | `0.7` | x |", "| b | 0.6 |", "| c | 0.5 | |", "", "| Group | acc | note |", "| z | 1 | 2 |"]


@query("s20_report_tables", "SELECT doc_id, 'group=D6 x' || doc_id || ';pair acc=0.5' AS bullets, 'a:0.7:x|c:0.5:' AS cells FROM documents")
def s20(spark, sf_dir):
    text = F.concat(*(F.concat(F.lit(line.replace("D6 x`", "D6 x")), F.when(F.lit("D6" in line), F.concat(F.col("doc_id").cast("string"), F.lit("`"))).otherwise(""), F.lit("\n")) for line in REPORT))
    b = F.array_join(F.transform(rd.bullets(text), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    c = F.array_join(F.transform(rd.pipe_table(text, "| group"), lambda r: F.concat_ws(":", r["Group"], r["acc"], r["note"])), "|")
    return t(spark, sf_dir, "documents").select("doc_id", b.alias("bullets"), c.alias("cells"))


@query("s21_incomplete_runs", "SELECT o_orderkey AS run, array_to_string(list_filter(['AIR', 'RAIL', 'SHIP'], lambda x: NOT coalesce(list_contains(h, x), false)), ',') AS missing FROM orders LEFT JOIN (SELECT l_orderkey, list(l_returnflag) AS f, list(CASE l_linenumber % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'SHIP' ELSE 'MAIL' END) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE len(list_filter(['AIR', 'RAIL', 'SHIP'], lambda x: NOT coalesce(list_contains(h, x), false))) > 0")
def s21(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    listing = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(n == 0, "AIR").when(n == 1, "RAIL").when(n == 2, "SHIP").otherwise("MAIL").alias("name"))
    out = ar.incomplete_runs(listing, t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run")), ["AIR", "RAIL", "SHIP"])
    return out.select("run", F.array_join("missing", ",").alias("missing"))


@query("p5_p6_tagged_inputs", "SELECT 'mix::' || pair_id AS pair_id, 'mix' AS source_label, sha256(domain_tag || chr(10) || chosen_text) AS chosen_sha, sha256(domain_tag || chr(10) || rejected_text) AS rejected_sha, round(CASE WHEN step % 2 = 0 THEN 2.0 ELSE 1.0 END * 0.3, 9) AS source_weight FROM d_pairs")
def p5(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("pair_id", F.concat("domain_tag", F.lit("\n")).alias("prompt_text"), "chosen_text", "rejected_text", F.when(F.col("step") % 2 == 0, 2.0).alias("source_weight"))
    out = cu.tagged(cu.with_inputs(p), "mix", 0.3)
    return rounded(out.select("pair_id", "source_label", F.sha2("chosen_input", 256).alias("chosen_sha"), F.sha2("rejected_input", 256).alias("rejected_sha"), "source_weight"))


@query("p8_variant_names", "SELECT DISTINCT source, CASE source WHEN 'src0' THEN 'config-main' WHEN 'src1' THEN 'task-src1' WHEN 'src2' THEN 'subset-unknown' ELSE 'default' END AS variant FROM documents")
def p8(spark, sf_dir):
    s = F.col("source")
    data = F.when(s == "src0", "GSM8K").when(s == "src1", "bbh").when(s == "src2", "hendrycks_math").otherwise(s)
    return t(spark, sf_dir, "documents").select("source").distinct().select("source", cu.variant_name(data, F.lit(None).cast("string"), F.when(s == "src1", s), F.lit(None).cast("string")).alias("variant"))


SEQ_SQL = r"""dt AS (SELECT doc_id, lang, source, CASE WHEN text IS NULL OR trim(text, ' ' || chr(10) || chr(13) || chr(9)) = '' THEN [] WHEN contains(trim(text, ' ' || chr(10) || chr(13) || chr(9)), chr(10)) THEN string_split(text, chr(10)) ELSE string_split(regexp_replace(trim(replace(text, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS parts FROM documents),
fr AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(parts[i], '\s+', ' ', 'g')), '^[-*]\s+', ''), '^\d+[\.)]\s+', ''), '^\([a-zA-Z]\)\s+', '')) AS f FROM dt, range(1, len(parts) + 1) r(i)),
rs AS (SELECT doc_id, 'reasoning' AS role, f AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS step FROM fr WHERE length(f) > 0),
sq AS (SELECT doc_id, 'question' AS role, 'From ' || source AS text, 0 AS step FROM documents UNION ALL SELECT doc_id, role, text, step FROM rs UNION ALL SELECT d.doc_id, 'answer', d.lang, coalesce(max(rs.step), 0) + 1 FROM documents d LEFT JOIN rs ON rs.doc_id = d.doc_id WHERE d.lang IS NOT NULL GROUP BY 1, 2, 3)"""


@query("g1_step_sequences", f"WITH {SEQ_SQL} SELECT doc_id || '::step::' || lpad(CAST(step AS VARCHAR), 4, '0') || '::' || role AS step_id, doc_id, CAST(step AS INTEGER) AS step, role, sha256(text) AS text_sha FROM sq")
def g1(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    steps = tx.step_sequence(F.concat(F.lit(" From  "), F.col("source")), F.col("text"), F.col("lang"))
    out = d.select("doc_id", F.posexplode(steps).alias("step", "s")).select("doc_id", "step", "s.role", "s.text")
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit("::step::"), F.lpad(F.col("step").cast("string"), 4, "0"), F.lit("::"), F.col("role")).alias("step_id"), "doc_id", "step", "role", F.sha2("text", 256).alias("text_sha"))


@query("g2_rows_to_sequences", """WITH l AS (SELECT doc_id, list(line ORDER BY step) AS l FROM d_steps GROUP BY doc_id) SELECT d.doc_id, d.doc_id % 3 = 0 AS question_fallback, d.doc_id % 4 > 0 AS answer_found, CAST(CASE WHEN d.doc_id % 4 > 0 THEN len(l) ELSE 0 END AS INTEGER) AS n_reasoning, CASE WHEN d.doc_id % 4 > 0 THEN 'it is ' || d.lang ELSE array_to_string(l, chr(10)) END AS answer FROM documents d JOIN l ON l.doc_id = d.doc_id WHERE len(l) > 1 OR d.doc_id % 4 = 0""")
def g2(spark, sf_dir):
    i = F.col("doc_id")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", kept.alias("k")).where((F.size("k") > 1) | ((i % 4 == 0) & (F.size("k") > 0)))
    target = F.when(i % 4 > 0, F.concat(F.array_join("k", "\n"), F.lit("\nAnswer: it is "), F.col("lang"))).otherwise(F.array_join("k", "\n"))
    x = tx.target_sequence(F.when(i % 3 > 0, "What?").otherwise(" "), F.lit("the prompt"), target, F.lit("gold"), ["Answer:"])
    return d.select("doc_id", x.alias("x")).select("doc_id", "x.question_fallback", "x.answer_found", F.size(F.filter("x.steps", lambda s: s["role"] == "reasoning")).alias("n_reasoning"), F.col("x.answer").alias("answer"))


CHOICES = """cd AS (SELECT doc_id, step, k.* FROM d_steps, (VALUES ('negation_flip', 10, 2), ('comparator_flip', 11, 3), ('condition_reversal', 12, 5), ('entity_substitution', 13, 7), ('binary_flip', 20, 11), ('operator_flip', 21, 4), ('numeric_perturb', 22, 6), ('step_drop', 99, 1)) k(kind, priority, m) WHERE (doc_id + step) % k.m = 0 AND (kind <> 'step_drop' OR step > 0)),
nn AS (SELECT doc_id, step, count(*) FILTER (kind <> 'step_drop') AS n, count(*) FILTER (kind = 'step_drop') AS d FROM cd GROUP BY 1, 2),
zz AS (SELECT *, least(2, n, 3) AS mn FROM nn), yy AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(n, mn + greatest(3 - mn - least(1, d, 3 - mn), 0)) END AS ns FROM zz), xx AS (SELECT *, least(1, d, 3 - ns) AS ds FROM yy),
rk AS (SELECT cd.*, row_number() OVER (PARTITION BY doc_id, step, kind = 'step_drop' ORDER BY priority) AS i FROM cd)"""


@query("w13_balanced_corruptions", f"WITH {CHOICES} SELECT rk.doc_id, rk.step, string_agg(rk.kind, ',' ORDER BY rk.priority) AS kinds FROM rk JOIN xx ON xx.doc_id = rk.doc_id AND xx.step = rk.step WHERE (rk.kind = 'step_drop' AND rk.i <= ds) OR (rk.kind <> 'step_drop' AND rk.i <= ns) GROUP BY 1, 2")
def w13(spark, sf_dir):
    at = F.col("doc_id") + F.col("step")
    every = [("negation_flip", 10, 2), ("comparator_flip", 11, 3), ("condition_reversal", 12, 5), ("entity_substitution", 13, 7), ("binary_flip", 20, 11), ("operator_flip", 21, 4), ("numeric_perturb", 22, 6), ("step_drop", 99, 1)]
    some = F.array_compact(F.array(*(F.when((at % m == 0) & (F.lit(k != "step_drop") | (F.col("step") > 0)), F.struct(F.lit(p).alias("priority"), F.lit(k).alias("kind"), F.lit(k).alias("text"))) for k, p, m in every)))
    out = d_steps(spark, sf_dir).select("doc_id", "step", co.balanced(some, 3, 2, 1).alias("c")).where(F.size("c") > 0)
    return out.select("doc_id", "step", F.array_join(F.transform("c", lambda x: x["kind"]), ",").alias("kinds"))


@query("g4_corrupted_prefixes", r"""WITH s AS (SELECT doc_id, step, line || CASE step % 3 WHEN 0 THEN ' 12 + 30 is at least that' ELSE '' END AS line FROM d_steps WHERE lang = 'en' AND step < 6 AND NOT regexp_matches(line, '[0-9]|(?i)\b(yes|no|true|false)\b')),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
c AS (SELECT doc_id, step, before, 'operator_flip' AS kind, 21 AS p, left(line, length(line) - 25) || ' 12 - 30 is at least that' AS last FROM w WHERE step % 3 = 0 UNION ALL SELECT doc_id, step, before, 'numeric_perturb', 22, left(line, length(line) - 25) || ' 13 + 30 is at least that' FROM w WHERE step % 3 = 0 UNION ALL SELECT doc_id, step, before, 'step_drop', 99, NULL FROM w WHERE before IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, step ORDER BY p) AS i FROM c)
SELECT doc_id, step, kind, sha256(CASE WHEN kind = 'step_drop' THEN before ELSE coalesce(before || chr(10), '') || last END) AS text_sha FROM r WHERE i <= 2""")
def g4(spark, sf_dir):
    s = d_steps(spark, sf_dir).where("lang = 'en' and step < 6").where(~F.col("line").rlike(r"[0-9]|(?i)\b(yes|no|true|false)\b"))
    s = s.withColumn("line", F.concat("line", F.when(F.col("step") % 3 == 0, " 12 + 30 is at least that").otherwise("")))
    # a document's steps are one array; a prefix is a slice of it
    docs = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", "line"))).alias("s"))
    each = docs.select("doc_id", "s", F.posexplode("s").alias("i", "x")).select("doc_id", F.col("x.step").alias("step"), F.transform(F.slice("s", F.lit(1), F.col("i") + 1), lambda x: x["line"]).alias("lines"))
    made = co.corrupted(each, "lines", policy="legacy", most=2)
    return made.select("doc_id", "step", "kind", F.sha2("text", 256).alias("text_sha"))


@query("g22_anchor_places", f"""WITH {SIGN_SQL}, a AS (SELECT key, n, n - 2 AS penultimate, least(n - 2, greatest(0, round_even(n * 0.75, 0) - 1)) AS late75 FROM k WHERE k IS NULL AND n >= 2) SELECT key, CAST(n - 1 AS INTEGER) AS terminal, CAST(penultimate AS INTEGER) AS penultimate, CAST(late75 AS INTEGER) AS late75 FROM a""")
def g22(spark, sf_dir):
    n = F.size("signs")
    rows = signed(spark, sf_dir).where(F.forall("signs", lambda x: x == "+") & (n >= 2))
    return rows.select("key", (n - 1).alias("terminal"), pr.anchor_place(n, "penultimate").alias("penultimate"), pr.anchor_place(n, "late75").alias("late75"))


COMPONENTS = [("near_local", ["local_first_bad_edge"], 0.4, 1.0), ("branches", ["sibling_branch"], 0.35, 0.8), ("terminal_few", ["terminal_completion_anchor"], 0.1, 0.5), ("grid", ["good_bad_prefix_grid"], 0.15, 1.2)]


@query("g24_k5_curated_profile", "WITH p AS (SELECT pair_id, coalesce(semantics, 'grid') AS s FROM d_pairs), c AS (SELECT * FROM (VALUES ('near_local', 'local', 111, 1.0), ('branches', 'sibling', 97, 0.8), ('terminal_few', 'terminal', 28, 0.5), ('grid', 'grid', 41, 1.2)) v(component, s, quota, w)) SELECT 'transfer::' || pair_id AS pair_id, component, CAST(w AS DOUBLE) AS semantic_weight FROM p JOIN c ON c.s = p.s QUALIFY row_number() OVER (PARTITION BY component ORDER BY sha256(component || '|' || pair_id), pair_id) <= quota")
def g24(spark, sf_dir):
    p = kinds(d_pairs(spark, sf_dir)).select("pair_id", "pair_semantics")
    return cu.curated(p, COMPONENTS, 277, "transfer").select("pair_id", "component", "semantic_weight")


@query("g25_relabelled", "SELECT pair_id, true AS judge_selected, true AS judge_kept FROM d_pairs WHERE semantics = 'local' AND pair_confidence >= 0.5 UNION ALL SELECT pair_id, false, false FROM d_pairs WHERE semantics = 'sibling'")
def g25(spark, sf_dir):
    p = d_pairs(spark, sf_dir).select("pair_id", "semantics", "pair_confidence")
    return cu.relabelled(p.where("semantics = 'sibling'"), p.where("semantics = 'local' and pair_confidence >= 0.5"), "pair_id").select("pair_id", "judge_selected", "judge_kept")


@query("g30_p7_teacher_inputs", """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'What is ' || lang || '?' END AS q, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE list(line ORDER BY step) END AS s FROM d_steps GROUP BY doc_id, lang)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_question' WHEN doc_id % 7 = 3 THEN 'missing_steps' END AS error, doc_id % 5 = 1 AND doc_id % 7 <> 3 AS question_fallback, CASE WHEN doc_id % 5 > 0 AND doc_id % 7 <> 3 THEN sha256('sys' || chr(10) || CASE WHEN doc_id % 5 = 1 THEN 'the prompt' ELSE q END || chr(10) || array_to_string(s, '<sep>') || '<sep>') END AS input_sha FROM d""")
def g30(spark, sf_dir):
    i = F.col("doc_id")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", kept.alias("k")).where(F.size("k") > 0)
    rows = d.select("doc_id", F.when(i % 5 == 0, None).when(i % 5 == 1, " ").otherwise(F.concat(F.lit("What is "), F.col("lang"), F.lit("?"))).alias("question"), F.when(i % 5 > 0, "the prompt").alias("prompt_text"), F.when(i % 7 != 3, F.col("k")).alias("steps"))
    out = cu.teacher_inputs(rows, "sys", "<sep>")
    return out.select("doc_id", "error", "question_fallback", F.sha2("input_text", 256).alias("input_sha"))


@query("f7_geometry_filter", f"WITH {SIGN_SQL}, {places_sql('grid', 6)}, {LISTS}, {TEXTS}, {flagged_sql('tx', chr(39) + 'Q' + chr(39) + ' || key', chr(39) + 'docs' + chr(39), chr(39) + 'text' + chr(39))} SELECT r.key, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad FROM r JOIN k ON k.key = r.key WHERE (bad = k.k AND good = k.k - 1) OR (bad <> k.k AND good = k.k - 1)")
def f7(spark, sf_dir):
    out = pr.convert_steps(signed(spark, sf_dir), "all_good_vs_all_bad", F.lit("docs"), F.lit("text"), F.concat(F.lit("Q"), F.col("key").cast("string")), 6)
    kind = pr.pair_type(F.col("good"), F.col("bad"), F.col("first_negative_index"))
    return out.where(kind.isin("lastsafe_vs_firstbad", "lastsafe_vs_laterbad")).select("key", "good", "bad")


@query("j2_corruptions_of_prefixes", "SELECT d.pair_id AS corruption_id, d.doc_id AS clean_prefix_id, l.quality FROM d_pairs d JOIN labels l ON l.doc_id = d.doc_id ORDER BY corruption_id LIMIT 90")
def j2(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("clean_prefix_id"), "quality")
    c = d_pairs(spark, sf_dir).select(F.col("pair_id").alias("corruption_id"), F.col("doc_id").alias("clean_prefix_id"))
    known = c.join(lab.select("clean_prefix_id"), "clean_prefix_id", "left_semi")
    return cu.joined(known, lab, "clean_prefix_id").select("corruption_id", "clean_prefix_id", "quality").orderBy("corruption_id").limit(90)


@query("j11_first_bad_edges", "SELECT b.example_id, round(s.score, 9) AS safe, round(b.score, 9) AS bad FROM d_traces b JOIN d_traces s ON s.example_id = b.example_id AND b.label > 0 AND b.step = b.label AND s.step = b.label - 1")
def j11(spark, sf_dir):
    return rounded(tr.edges(d_traces(spark, sf_dir)))


@query("a5_a8_targets_by_grain", """WITH r AS (SELECT 'c' || event_id % 40 AS k, is_correct, parse_error, chars, event_id FROM d_rollouts UNION ALL SELECT 'q' || user_id, is_correct, parse_error, chars, event_id FROM d_rollouts), g AS (SELECT k, count(*) AS n, count(*) FILTER (is_correct) AS c FROM r GROUP BY k) SELECT k AS target_id, n AS k_rollouts, c AS n_correct, round((c + 1.0) / (n + 2.0), 9) AS q FROM g""")
def a5(spark, sf_dir):
    r = d_rollouts(spark, sf_dir)
    of = lambda prefix, c: me.rollout_targets(r.withColumn("target_id", F.concat(F.lit(prefix), c.cast("string"))), "target_id").select("target_id", "k_rollouts", "n_correct", "q")
    return rounded(of("c", F.col("event_id") % 40).unionByName(of("q", F.col("user_id"))))


METHODS = """e AS (SELECT *, lead(score, 1, 0.5) OVER (PARTITION BY example_id ORDER BY step) AS other FROM d_traces),
m AS (SELECT method, example_id, step, label, CASE method WHEN 'mean' THEN 0.7 * score + 0.3 * other WHEN 'min' THEN least(score, other) ELSE greatest(score, other) END AS score FROM e, (VALUES ('mean'), ('min'), ('max')) v(method)),
k AS (SELECT *, label < 0 OR step < label AS good, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS r, lag(score) OVER (PARTITION BY method, example_id ORDER BY step) AS prev FROM m)"""


@query("a32_ensemble_eval", f"WITH {METHODS} SELECT method, round((sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 9) AS auc, round(avg(CASE WHEN prev > score THEN 1.0 ELSE 0 END) FILTER (label > 0 AND step = label), 9) AS edge_accuracy FROM k GROUP BY method")
def a32(spark, sf_dir):
    return rounded(tr.ensemble(d_traces(spark, sf_dir), 0.7))


@query("w8_average_ranks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem")
def w8(spark, sf_dir):
    return tr.average_ranks(t(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("rank").alias("r"))


@query("a49_split_counts", "SELECT source, CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT source, CAST(('0x' || substr(sha256('42:' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS s FROM documents) GROUP BY 1, 2")
def a49(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("source", cu.three_way_split(F.col("doc_id")).alias("split")).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("e8_e11_stable_ids", "SELECT doc_id, step, substr(sha256('phase_c' || '||' || doc_id || '||' || step || '||' || line), 1, 24) AS prefix_id FROM d_steps")
def e8(spark, sf_dir):
    return d_steps(spark, sf_dir).select("doc_id", "step", stable_id(F.lit("phase_c"), "doc_id", "step", "line").alias("prefix_id"))
