"""Series summaries, distributions over fixed keys, pair errors and parsed verdicts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import LINE_BREAK, squash, strip
from .curation import range_slot, ranked


def series_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, min, p50, p90, p95, max by group; quantiles at sorted place round((n - 1) q), half to even.

    Counts by value come first, so a group's sort holds its distinct values, and places are found in running counts.
    """
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by)
    up = counts.withColumns({"_to": F.sum("_c").over(w.orderBy("_v")), "_n": F.sum("_c").over(w)})

    def at(q: float) -> Column:
        place = F.bround((F.col("_n") - 1) * q)
        return F.min(F.when(F.col("_to") > place, F.col("_v")))

    return up.groupBy(*by).agg(F.max("_n").alias("count"), (F.sum(F.col("_v") * F.col("_c")) / F.max("_n")).alias("mean"), F.min("_v").alias("min"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), F.max("_v").alias("max"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], low: float, high: float) -> DataFrame:
    """by and the interpolated quantiles of each group, from ranks in ranges of the value (from low to high): no group's values are held together."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    r = ranked(rows.select(*by, F.col(value).alias("_v"), key.alias("_key")), "_key", ["_v"], range_slot(F.col("_v"), low, high))
    place = F.col("_n") - 1

    def picked(q: float) -> Column:
        exact = F.lit(q) * (F.col("_all") - 1)
        lower, upper = F.max(F.when(place == F.floor(exact), F.col("_v"))), F.max(F.when(place == F.ceil(exact), F.col("_v")))
        return lower + (upper - lower) * F.max(exact - F.floor(exact))

    return r.groupBy(*by).agg(*(picked(q).alias(name) for name, q in at.items()))


def distribution(rows: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Share of each of a fixed set of keys; 0 for those without a row."""
    sums = rows.agg(*(F.count_if(F.col(key) == k).alias(f"_{i}") for i, k in enumerate(keys)), F.count_if(F.col(key).isin(*keys)).alias("_all"))
    share = lambda i: F.when(F.col("_all") > 0, F.col(f"_{i}") / F.greatest(F.col("_all"), F.lit(1))).otherwise(0.0)
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"_{i}").alias("n"), share(i).alias("share")) for i, k in enumerate(keys)))).alias("x")).select("x.*")


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of absolute differences of two distributions (key, share); a missing key counts as 0."""
    both = a.select("key", F.col("share").alias("x"), F.lit(0.0).alias("y")).unionByName(b.select("key", F.lit(0.0).alias("x"), F.col("share").alias("y")))
    return both.groupBy("key").agg((F.sum("x") - F.sum("y")).alias("d")).agg(F.sum(F.abs("d")).alias("l1"))


def number_bucket(value: Column, edges: list[int], labels: list[str]) -> Column:
    """The label of the first edge that a number does not exceed, the last one beyond; <missing> for null."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= edge, label).otherwise(out)
    return F.when(value.isNull(), "<missing>").otherwise(out)


def by_dimensions(rows: DataFrame, dims: dict[str, Column], margin: Column) -> DataFrame:
    """dimension, value: n, accuracy, tie_accuracy, wrong_rate, mean, median and p10 of margins (from -1 to 1); all dimensions in one shuffle.

    p10 stands at sorted place round((n - 1) / 10), half to even.
    """
    long = rows.select(margin.alias("m"), F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("value")) for k, v in dims.items()))).alias("d")).select("m", "d.*")
    r = ranked(long.withColumn("_key", F.concat_ws("|", "dimension", "value")), "_key", ["m"], range_slot(F.col("m"), -1.0, 1.0))
    rate = lambda c: F.avg(c.cast("double"))
    place, half = F.col("_n") - 1, (F.col("_all") - 1) / 2
    median = (F.max(F.when(place == F.floor(half), F.col("m"))) + F.max(F.when(place == F.ceil(half), F.col("m")))) / 2
    return r.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), rate(F.col("m") > 0).alias("accuracy"), rate(F.col("m") >= 0).alias("tie_accuracy"), rate(F.col("m") <= 0).alias("wrong_rate"), F.avg("m").alias("mean_margin"), median.alias("median_margin"), F.max(F.when(place == F.bround((F.col("_all") - 1) * 0.1), F.col("m"))).alias("p10_margin"))


def prefix_summary(prefixes: DataFrame, by: str) -> DataFrame:
    """Per by: prefixes (steps_seen), those with the question only, and the most steps seen."""
    return prefixes.groupBy(by).agg(F.count(F.lit(1)).alias("num_prefixes"), F.count_if(F.col("steps_seen") == 0).alias("question_only"), F.max("steps_seen").alias("max_steps_seen"))


_VERDICT = StructType([StructField("overall_verdict", StringType()), StructField("first_incorrect_step", IntegerType()), StructField("confidence", DoubleType()), StructField("parse_error", StringType())])


@F.pandas_udf(_VERDICT)
def _judged(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_judge(t) for t in texts], columns=["overall_verdict", "first_incorrect_step", "confidence", "parse_error"], dtype=object)


_token = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.DOTALL)


def _object(text: str, begin: int) -> str | None:
    """The balanced object whose first brace stands at or behind begin; strings are stepped over whole."""
    at, depth = None, 0
    for m in _token.finditer(text, begin):
        if m[0] == "{":
            at, depth = (m.start() if at is None else at), depth + 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                return text[at : m.end()]
    return None


def _objects(text: str) -> Iterator[str]:
    """Fenced objects; then those that hold a key of a verdict, from the brace before it; then the first of all."""
    yield from re.findall(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    places = [text.rfind("{", 0, at) for key in ("overall_verdict", "first_incorrect_step", "confidence") if (at := text.find(f'"{key}"')) >= 0]
    for place in [*places, text.find("{")]:
        if place >= 0 and (found := _object(text, place)) is not None:
            yield found


def _judge(text: str | None) -> tuple:
    """Verdict, first incorrect step, confidence and error of the first object that can be read."""
    tried, value = 0, None
    for one in dict.fromkeys(_objects((text or "").strip())):
        tried += 1
        try:
            value = json.loads(one)
        except ValueError:
            continue
        if isinstance(value, dict):
            break
        value = None
    if value is None:
        return "parse_failed", None, None, "json_parse_failed" if tried else "no_json_object_found"
    error = None
    verdict = str(value.get("overall_verdict", "")).strip().lower()
    if verdict not in ("correct", "incorrect"):
        verdict, error = "parse_failed", "invalid_overall_verdict"

    def number(key: str, kind: type) -> tuple:
        if (raw := value.get(key)) is None:
            return None, None
        try:
            return kind(raw), None
        except (TypeError, ValueError, OverflowError):
            return None, f"invalid_{key}"

    first, bad_first = number("first_incorrect_step", int)
    confidence, bad_confidence = number("confidence", float)
    if confidence is not None:
        confidence = min(1.0, max(0.0, confidence))
    return verdict, first, confidence, error or bad_first or bad_confidence


def json_verdict(text: Column) -> Column:
    """struct<overall_verdict, first_incorrect_step, confidence, parse_error> of a reply with a JSON object. Only replies with a brace go to Python."""
    some = F.contains(text, F.lit("{"))
    none = F.struct(F.lit("parse_failed").alias("overall_verdict"), F.lit(None).cast("int").alias("first_incorrect_step"), F.lit(None).cast("double").alias("confidence"), F.lit("no_json_object_found").alias("parse_error"))
    return F.when(some, _judged(F.when(some, text))).otherwise(none)


def keep_judged(chosen: Column, rejected: Column, min_confidence: float) -> Column:
    """Why a pair whose two sides were judged (structs of json_verdict) is kept, judge_agree, or the first reason why not."""
    low = lambda x: F.coalesce(x["confidence"] < min_confidence, F.lit(False))
    return F.when(chosen["parse_error"].isNotNull() | rejected["parse_error"].isNotNull(), "parse_failed").when(low(chosen), "chosen_low_confidence").when(low(rejected), "rejected_low_confidence").when(chosen["overall_verdict"] != "correct", "chosen_not_correct").when(rejected["overall_verdict"] != "incorrect", "rejected_not_incorrect").otherwise("judge_agree")


def final_body(text: Column) -> Column:
    """What stands in the first [FINAL] block; with a loose opening mark, up to the closing one or the end; null or blank without."""
    whole = F.regexp_extract(text, r"(?is)\[FINAL\](.*?)\[/FINAL\]", 1)
    loose = F.regexp_extract(text, r"(?is)\[\(?\s*final\s*\](.*?)(?:\[/\s*final\s*\]|\z)", 1)
    return F.when(text.rlike(r"(?is)\[FINAL\].*?\[/FINAL\]"), strip(whole)).when(text.rlike(r"(?i)\[\(?\s*final\s*\]"), strip(loose))


def _fields(body: Column) -> Column:
    """array<struct<k, v>> of KEY=value lines; keys in capitals, other signs than letters, digits and underscores left out."""
    lines = F.filter(F.transform(F.split(body, LINE_BREAK, -1), strip), lambda x: F.contains(x, F.lit("=")))
    key = lambda x: F.regexp_replace(F.replace(F.upper(strip(F.substring_index(x, "=", 1))), F.lit(" "), F.lit("_")), "[^A-Z0-9_]", "")
    return F.transform(lines, lambda x: F.struct(key(x).alias("k"), strip(F.regexp_replace(x, "(?s)^[^=]*=", "")).alias("v")))


def _last(pairs: Column, *keys: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["k"].isin(*keys)), F.lit(-1))["v"]


def block_verdict(text: Column) -> Column:
    """struct<overall, first_bad, step_verdicts, parse_error> of a reply's final block.

    Steps are STEP_1=..., STEP_2=...; a missing first_bad is the smallest step called incorrect, none if steps are named.
    """
    body = final_body(text)
    pairs = F.transform(_fields(body), lambda p: F.struct(p["k"].alias("k"), F.lower(p["v"]).alias("v")))

    def of(p: Column) -> Column:
        steps = F.filter(p, lambda x: x["k"].startswith("STEP_"))
        number = lambda x: F.substring(x["k"], 6, 10).try_cast("int")
        overall, said = _last(p, "OVERALL", "OVERALLVERDICT", "OVER_ALL"), F.filter(p, lambda x: x["k"].isin("FIRST_BAD", "FIRSTBAD"))
        wrong = F.array_min(F.transform(F.filter(steps, lambda x: x["v"] == "incorrect"), number))
        odd = F.get(F.filter(said, lambda x: (x["v"] != "none") & x["v"].try_cast("int").isNull()), F.lit(0))["v"]
        odd_step = F.get(F.filter(steps, lambda x: number(x).isNull()), F.lit(0))["k"]
        first = F.when(F.size(said) > 0, F.try_element_at(said, F.lit(-1))["v"].try_cast("int")).otherwise(wrong)
        error = F.when(F.coalesce(body, F.lit("")) == "", "final_block_missing").when(odd.isNotNull(), F.concat(F.lit("invalid_first_bad: "), odd)).when(odd_step.isNotNull(), F.concat(F.lit("invalid_step_key: "), odd_step)).when(overall.isNull(), "overall_missing").when((F.size(said) == 0) & (F.size(steps) == 0), "first_bad_missing")
        ok = error.isNull()
        return F.struct(F.when(ok, overall).alias("overall"), F.when(ok, first).alias("first_bad"), F.when(ok, F.transform(steps, lambda x: F.struct(number(x).alias("step"), x["v"].alias("verdict")))).alias("step_verdicts"), error.alias("parse_error"))

    return F.get(F.transform(F.array(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>"))), of), F.lit(0))


def pair_choice(text: Column) -> Column:
    """struct<preferred, confidence, parse_error> of a pairwise reply: its final block, else a boxed choice, a phrase, the first word, or what its last 300 characters say."""
    t = strip(text)
    body, tail = final_body(t), F.lower(F.substring(t, F.greatest(F.length(t) - 299, F.lit(1)), F.lit(300)))
    pairs = _fields(body)
    found = lambda pattern: F.nullif(F.upper(F.regexp_extract(t, pattern, 1)), F.lit(""))
    boxed, phrase, lead = found(r"(?i)\\?boxed\s*\{\s*(A|B|TIE)\s*\}"), found(r"(?i)(?:preferred|prefer|choice|answer)\s*[:=]?\s*(A|B|TIE)\b"), found(r"(?i)^\s*(A|B|TIE)\b")
    better = lambda x: tail.rlike(rf"(candidate\s+{x}|option\s+{x}|prefix\s+{x}).{{0,40}}(better|more correct|prefer)")
    said = F.when(better("a"), "A").when(better("b"), "B").when(tail.rlike("tie|equally valid|equally flawed"), "TIE")
    told = F.regexp_extract(t, r"(?i)confidence\s*[:=]\s*([01](?:\.\d+)?)", 1).try_cast("double")
    in_block = F.coalesce(body, F.lit("")) != ""
    wanted, sure = F.upper(_last(pairs, "PREFERRED")), _last(pairs, "CONFIDENCE")
    odd = F.get(F.filter(pairs, lambda p: (p["k"] == "PREFERRED") & ~F.upper(p["v"]).isin("A", "B", "TIE")), F.lit(0))["v"]
    odd_sure = F.get(F.filter(pairs, lambda p: (p["k"] == "CONFIDENCE") & p["v"].try_cast("double").isNull()), F.lit(0))["v"]
    error = F.when(in_block, F.when(odd.isNotNull(), F.concat(F.lit("invalid_preferred: "), odd)).when(odd_sure.isNotNull(), F.concat(F.lit("invalid_confidence: "), odd_sure)).when(wanted.isNull(), "preferred_missing")).when(F.coalesce(boxed, phrase, lead, said).isNull(), "final_block_missing")
    clip01 = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    confidence = F.when(in_block, clip01(sure.try_cast("double"))).when(boxed.isNull() & F.coalesce(phrase, lead).isNotNull(), clip01(told))
    return F.struct(F.when(error.isNotNull(), "PARSE_ERROR").when(in_block, wanted).otherwise(F.coalesce(boxed, phrase, lead, said)).alias("preferred"), F.when(error.isNull(), confidence).alias("confidence"), error.alias("parse_error"))


def debiased(preferred: Column, swapped: Column) -> Column:
    """chosen, rejected, tie or parse_error of an A or B whose sides may have been swapped."""
    return F.when(preferred == "TIE", "tie").when(~preferred.isin("A", "B") | preferred.isNull(), "parse_error").when((preferred == "A") != swapped, "chosen").otherwise("rejected")


def stitch(first: Column, rest: Column) -> Column:
    """The two parts of an answer that was cut, a line feed between them; the other one where one is blank."""
    a, b = F.regexp_replace(first, r"(?U)\s+$", ""), F.regexp_replace(rest, r"(?U)^\s+", "")
    return F.when(a == "", b).when(b == "", a).otherwise(strip(F.concat(a, F.lit("\n"), b)))


def answer_signal(text: Column, kind: str) -> Column:
    """Whether a reply shows its final answer, by kind of data set: math, binary or other (always)."""
    v = strip(text)
    low = F.lower(v)
    if kind == "math":
        return (v != "") & (low.rlike(r"final\s*answer(?:\s*is)?\s*:") | F.contains(v, F.lit("####")) | F.contains(v, F.lit("\\boxed")) | v.rlike(r"[-+]?\d*\.?\d+(?:/\d+)?\s*$"))
    if kind == "binary":
        return low.rlike(r"(?:final\s*answer|answer|verdict)\s*[:\-]\s*(yes|no|true|false)\b") | low.rlike(r"^\s*(yes|no|true|false)\s*$")
    return v != ""


def needs_recovery(text: Column, kind: str, hit_limit: Column, listed: Column, enabled: bool = True, need_signal: bool = True) -> Column:
    """Whether a reply that hit the token limit is to be continued."""
    return F.lit(enabled) & listed & hit_limit & (~answer_signal(text, kind) if need_signal else F.lit(True))


# Masks of what differs between runs of one command.
COMMAND_MASKS = ((r"\bRUN_PREFIX=\S+", "RUN_PREFIX=<RUN_PREFIX>"), (r"\bCUDA_VISIBLE_DEVICES=\S+", "CUDA_VISIBLE_DEVICES=<GPU_SET>"), (r"(--run-name\s+)\S+", "$1<RUN_NAME>"), (r"(--seed\s+)\S+", "$1<SEED>"), (r"\b\d{8}T\d{6}Z\b", "<TS>"))


def command_families(rows: DataFrame, command: str, key: str, at: str) -> DataFrame:
    """Per masked command: runs, successes, failures (any other status), first and last time, and the last run."""
    family = F.col(command)
    for pattern, mask in COMMAND_MASKS:
        family = F.regexp_replace(family, pattern, mask)
    ok = F.col("status") == "success"
    return rows.groupBy(squash(family).alias("family")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(key, F.struct(at, key)).alias("last_run"))


#: Lines of a log that tell of progress only.
NOISE = r"(?i)loading checkpoint shards|\d+it/s|\d+%\|"


def compact_results(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """key, name and value of "name : value" lines that are no noise; the last one of each name."""
    pattern = r"^([A-Za-z][A-Za-z0-9_ ]*?)\s*:\s*(.+)$"
    kept = lines.where(~F.col(line).rlike(NOISE) & ~F.contains(F.col(line), F.lit("\r")) & F.col(line).rlike(pattern))
    named = kept.select(key, order, F.regexp_extract(line, pattern, 1).alias("name"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value"))
    return named.groupBy(key, "name").agg(F.max_by("value", order).alias("value")).withColumnRenamed("name", "key")


def geometry_counts(rows: DataFrame) -> DataFrame:
    """pair_type, gap, n, right of all good x bad pairs of traces. Pairs with one good step and one kind of bad ones are counted, not written out.

    Per example the bad scores stand in an array that each good step reads; an array holds one example's steps.
    """
    from .pairs import gap_bucket, pair_type

    bad = F.col("step") >= F.col("label")
    ex = rows.where("label > 0").groupBy("example_id").agg(F.max("label").alias("k"), F.collect_list(F.when(~bad, F.struct("step", "score"))).alias("good"), F.collect_list(F.when(bad, F.struct("step", "score"))).alias("bad"))
    one = ex.select("k", F.explode("good").alias("g"), "bad")
    kinds = F.transform("bad", lambda b: F.struct(pair_type(F.col("g.step"), b["step"], F.col("k")).alias("pair_type"), gap_bucket(b["step"] - F.col("g.step")).alias("gap"), (F.col("g.score") > b["score"]).alias("ok")))
    # a good step meets at most 2 x 4 kinds: sums per kind before anything is exploded
    cells = [(t, g) for t in ("lastsafe_vs_firstbad", "earlygood_vs_firstbad", "lastsafe_vs_laterbad", "earlygood_vs_laterbad") for g in ("gap1", "gap2", "gap3_4", "gap5p")]
    held = one.select(kinds.alias("x"))
    of = lambda t, g, right: F.size(F.filter("x", lambda y: (y["pair_type"] == t) & (y["gap"] == g) & (y["ok"] if right else F.lit(True))))
    sums = held.agg(*(F.sum(of(t, g, r)).alias(f"{t}|{g}|{int(r)}") for t, g in cells for r in (False, True)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("pair_type"), F.lit(g).alias("gap"), F.coalesce(F.col(f"{t}|{g}|0"), F.lit(0)).alias("n"), F.coalesce(F.col(f"{t}|{g}|1"), F.lit(0)).alias("right")) for t, g in cells))).alias("c")).select("c.*")


def geometry_distribution(rows: DataFrame, kind: str) -> DataFrame:
    """key, n and share of good x bad pairs over the fixed keys of kind: pair_type or gap; 0 for those without a pair."""
    s = geometry_counts(rows).groupBy(F.col(kind).alias("key")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # four rows
    return s.select("key", "n", F.when(total > 0, F.col("n") / F.greatest(total, F.lit(1))).otherwise(0.0).alias("share"))


def alignment_slices(rows: DataFrame) -> DataFrame:
    """dimension, value: count, positive and accuracy of good x bad pairs by gap, by pair type, by whether the bad step is the first, and of all; empty ones are left out."""
    c = geometry_counts(rows)
    first = F.when(F.col("pair_type").endswith("firstbad"), "anygood_vs_firstbad").otherwise("good_vs_laterbad")
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("gap", F.col("gap")), ("pair_type", F.col("pair_type")), ("aggregate", first), ("all", F.lit("good_vs_bad"))))))
    s = c.select(dims.alias("d"), "n", "right").groupBy("d.dimension", "d.value").agg(F.sum("n").alias("count"), F.sum("right").alias("positive")).where(F.col("count") > 0)
    return s.withColumn("accuracy", F.col("positive") / F.col("count"))


def record_geometry(pairs: DataFrame) -> DataFrame:
    """One row: pairs, those with step places (good, bad, first_bad), share whose rejected text goes on from the chosen one, mean length ratio, counts by pair type and gap."""
    from .pairs import GAPS, PAIR_TYPES, gap_bucket, pair_type

    c, r = F.length("chosen_text"), F.length("rejected_text")
    p = pairs.withColumns({"_t": pair_type(F.col("good"), F.col("bad"), F.col("first_bad")), "_g": F.when(F.col("first_bad").isNotNull(), gap_bucket(F.col("bad") - F.col("good")))})
    goes_on = (c > 0) & F.col("rejected_text").startswith(F.col("chosen_text"))
    return p.agg(F.count(F.lit(1)).alias("num_pairs"), F.count("_t").alias("with_steps"), F.avg(goes_on.cast("double")).alias("prefix_relation_rate"), F.avg(F.greatest(c, r) / F.greatest(F.least(c, r), F.lit(1))).alias("mean_length_ratio"), *(F.count_if(F.col("_t") == t).alias(t) for t in PAIR_TYPES), *(F.count_if(F.col("_g") == g).alias(g) for g in GAPS))


def candidate_graph(pairs: DataFrame) -> DataFrame:
    """Nodes of the preference graph: pool (source and prompt), candidate (and text), degree, weight, last step at which it is the better side, first at which the worse, utility."""
    glue = F.lit("\n<SEP>\n")
    pool = F.substring(F.sha2(F.concat("source_tag", glue, "prompt_text"), 256), 1, 16)
    own = lambda text: F.substring(F.sha2(F.concat("source_tag", glue, "prompt_text", glue, F.col(text)), 256), 1, 20)
    none = F.lit(None).cast("int")
    sides = F.array(F.struct(own("chosen_text").alias("candidate"), F.col("positive_step").cast("int").alias("safe"), none.alias("bad"), F.col("pair_confidence").alias("won")), F.struct(own("rejected_text").alias("candidate"), none.alias("safe"), F.col("negative_step").cast("int").alias("bad"), F.lit(0.0).alias("won")))
    e = pairs.select(pool.alias("pool"), "pair_confidence", F.explode(sides).alias("s")).select("pool", "pair_confidence", "s.*")
    return e.groupBy("pool", "candidate").agg(F.count(F.lit(1)).alias("degree"), F.sum("pair_confidence").alias("weight"), F.max("safe").alias("max_safe"), F.min("bad").alias("min_bad"), F.coalesce(F.try_divide(F.sum("won"), F.sum("pair_confidence")), F.lit(0.5)).alias("utility"))
