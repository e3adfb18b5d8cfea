"""Readers of question, trace and pair files into one canonical form, by name; writers and artifact folders.

Every reader is a function of a raw frame, so files in any form that Spark reads (Parquet, JSON, JSON lines, text) go
through the same code; ``load`` opens the files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, last_boxed, sign_of, sign_of_number, squash, strip, unwrap
from ..operators.curation import ranked, split_alias

CANONICAL = ["id", "dataset", "question", "answer", "cot"]


def _sample(rows: DataFrame, dataset: str, key: Column, question: Column, answer: Column, cot: Column) -> DataFrame:
    out = rows.select(F.concat(F.lit(f"{dataset}:"), key.cast("string")).alias("id"), F.lit(dataset).alias("dataset"), strip(question).alias("question"), strip(answer).alias("answer"), F.nullif(strip(cot), F.lit("")).alias("cot"))
    return out.where((F.length("question") > 0) & (F.length("answer") > 0))


def hash_marked(rows: DataFrame, dataset: str = "gsm8k") -> DataFrame:
    """question, answer with reasoning before the last ####; key: idx."""
    final = F.trim(F.substring_index("answer", "####", -1))
    marked = F.contains(F.col("answer"), F.lit("####")) & (final != "")
    cot = F.regexp_extract("answer", r"(?s)^(.*)####", 1)
    return _sample(rows, dataset, F.col("idx"), F.col("question"), F.when(marked, final).otherwise(F.col("answer")), F.when(marked, cot))


def yes_no_questions(rows: DataFrame, dataset: str = "strategyqa") -> DataFrame:
    """qid, question, answer (boolean or text), decomposition (array)."""
    v = F.lower(F.trim(F.col("answer").cast("string")))
    bullets = F.array_join(F.transform(F.filter("decomposition", lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(x))), "\n")
    return _sample(rows, dataset, F.col("qid"), F.col("question"), F.when(v.isin("true", "1", "yes"), "yes").otherwise("no"), bullets)


def passages(rows: DataFrame, dataset: str = "drop") -> DataFrame:
    """query_id, passage, question, spans (array): the first span is the answer."""
    p, q = F.trim(F.coalesce("passage", F.lit(""))), F.trim(F.coalesce("question", F.lit("")))
    asked = F.when(p == "", q).when(q == "", F.concat(F.lit("Passage: "), p)).otherwise(F.concat(F.lit("Passage: "), p, F.lit("\nQuestion: "), q))
    return _sample(rows, dataset, F.col("query_id"), asked, F.get("spans", F.lit(0)), F.lit(None).cast("string"))


def premises(rows: DataFrame, dataset: str = "proofwriter") -> DataFrame:
    """id, theory, question, answer, allProofs."""
    return _sample(rows, dataset, F.col("id"), F.concat(F.lit("Theory: "), F.col("theory"), F.lit("\nQuestion: "), F.col("question")), F.col("answer").cast("string"), F.col("allProofs"))


def worked_solutions(rows: DataFrame, dataset: str = "math") -> DataFrame:
    """problem, solution: the last box, else the last line without an opening word and dollar signs, else the whole."""
    lines = F.filter(F.transform(F.split("solution", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    tail = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), r"^(?i)(?:therefore|thus|so)\s*,?\s*", "")
    return _sample(rows, dataset, F.col("idx"), F.col("problem"), F.coalesce(last_boxed(F.col("solution"), filled=True), F.nullif(unwrap(tail), F.lit("")), F.col("solution")), F.col("solution"))


def multiple_choice(rows: DataFrame, dataset: str = "logiqa") -> DataFrame:
    """context, query, options (array), correct_option (from 0; another number is the answer itself)."""
    letter = lambda i: F.coalesce(F.get(F.array(*map(F.lit, "ABCD")), i), (i + 1).cast("string"))
    named = F.transform("options", lambda o, i: F.concat(letter(i), F.lit(". "), strip(o)))
    asked = F.concat(F.lit("Context: "), strip(F.col("context")), F.lit("\nQuestion: "), strip(F.col("query")), F.lit("\nOptions:\n"), F.array_join(named, "\n"))
    right = F.coalesce(F.get("options", F.when(F.col("correct_option") >= 0, F.col("correct_option"))), F.col("correct_option").cast("string"))
    return _sample(rows, dataset, F.col("idx"), asked, right, F.lit(None).cast("string"))


def task_rows(rows: DataFrame, task: str = "boolean_expressions", split: str = "test") -> DataFrame:
    """input, target of one task's file; key: idx."""
    key = F.concat(F.lit(f"{task}:{split}:"), F.col("idx").cast("string"))
    return _sample(rows, "bbh", key, F.col("input"), F.col("target"), F.lit(None).cast("string")).withColumn("dataset", F.lit("bigbench_hard"))


def eight_line_records(lines: DataFrame, per_bucket: int = 65_536) -> DataFrame:
    """Rows for multiple_choice from line_no and value: of each eight non-blank lines the second is the letter, then context, query and four options.

    Lines are numbered in ranges of their place, and a range adds the counts of those before it: no window over all lines.
    """
    kept = lines.withColumn("value", strip(F.col("value"))).where(F.length("value") > 0).withColumn("_one", F.lit(0))
    n = F.col("_n") - 1
    numbered = ranked(kept, "_one", ["line_no"], F.floor(F.col("line_no") / per_bucket).cast("int"))
    records = numbered.groupBy(F.floor(n / 8).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("_n"), "value"))).alias("l")).where(F.size("l") == 8)
    line = lambda k: F.get("l", F.lit(k))["value"]

    def sentence(text: Column) -> Column:
        v = strip(F.regexp_replace(F.replace(text, F.lit("\\'"), F.lit("'")), r"(?U)\s+", " "))
        v = F.when((v != "") & ~v.rlike(r"[.!?]$"), F.concat(v, F.lit("."))).otherwise(v)
        return F.replace(F.replace(F.replace(v, F.lit("?."), F.lit("?")), F.lit("!."), F.lit("!")), F.lit(".."), F.lit("."))

    option = lambda k: strip(F.regexp_replace(line(k), r"^[ABCD]\. ", ""))
    letter = F.lower(strip(F.replace(line(1), F.lit("."), F.lit(""))))
    right = F.when(letter.isin(*"abcd"), F.instr(F.lit("abcd"), letter) - 1).otherwise(-1)
    return records.select("idx", sentence(line(2)).alias("context"), sentence(line(3)).alias("query"), F.array(*(option(k) for k in range(4, 8))).alias("options"), right.cast("int").alias("correct_option"))


def json_objects(files: DataFrame) -> DataFrame:
    """path and value (variant) of the objects in files (path, content), by suffix and form.

    A .jsonl file: every line that is not blank must be an object. Another one: a list gives its objects; an object gives
    those of the first list under data, records, examples or rows, or else is the one row itself.
    """
    by_line = F.endswith(F.lower("path"), F.lit(".jsonl"))
    lines = F.filter(F.transform(F.split("content", "\n", -1), strip), lambda x: F.length(x) > 0)
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    row = files.where(by_line).select("path", F.explode(lines).alias("line")).withColumn("value", F.try_parse_json("line"))
    strict = F.when(F.coalesce(is_object(F.col("value")), F.lit(False)), F.col("value")).otherwise(F.raise_error(F.concat("path", F.lit(" holds a line that is no object"))).cast("variant"))
    whole = files.where(~by_line).select("path", F.parse_json("content").alias("v"))
    inner = [F.try_variant_get("v", at, "array<variant>") for at in ("$", "$.data", "$.records", "$.examples", "$.rows")]
    listed = F.coalesce(*inner, F.array("v"))
    objects = whole.select("path", F.explode(listed).alias("value")).where(is_object(F.col("value")))
    return row.select("path", strict.alias("value")).unionByName(objects)


def step_candidates(value: Column) -> Column:
    """array<struct<text, sign>> of a record's labelled steps (variant): steps, label.steps, label.process and process, with the first text and label that a step has."""
    some = [F.coalesce(F.try_variant_get(value, at, "array<variant>"), F.array().cast("array<variant>")) for at in ("$.steps", "$.label.steps", "$.label.process", "$.process")]

    def one(step: Column) -> Column:
        text = F.coalesce(*(F.nullif(strip(F.try_variant_get(step, f"$.{k}", "string")), F.lit("")) for k in ("text", "content", "step", "completion", "output")))
        first = None
        for k in reversed(("label", "rating", "is_correct", "correct", "value")):
            raw = F.try_variant_get(step, f"$.{k}", "variant")
            kind = F.schema_of_variant(raw)
            told = F.try_variant_get(step, f"$.{k}", "string")
            flag = F.when(kind == "BOOLEAN", F.when(told == "true", "+").otherwise("-")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), sign_of_number(told.try_cast("double"))).otherwise(sign_of(told))
            first = flag if first is None else F.when(raw.isNotNull(), flag).otherwise(first)
        return F.struct(text.alias("text"), first.alias("sign"))

    return F.filter(F.transform(F.concat(*some), one), lambda x: x["text"].isNotNull() & x["sign"].isNotNull())


def prompt_of(value: Column, most: int = 1024) -> Column:
    """The first question that a record (variant) holds, under one of five names, as text or as an object's text; at most ``most`` characters."""
    told = []
    for k in ("question", "problem", "prompt", "input", "query"):
        inner = [F.nullif(strip(F.try_variant_get(value, f"$.{k}.{n}", "string")), F.lit("")) for n in ("problem", "question", "prompt", "text", "input")]
        plain = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")), F.lit("STRING")), strip(F.try_variant_get(value, f"$.{k}", "string")))
        told += [F.nullif(plain, F.lit("")), *inner]
    return F.substring(F.coalesce(*told, F.lit("")), 1, most)


def _plain_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), "(?s)^`(.*)`$", "$1"), r"(?U)^\s+|\s+$", "")


def bullets(text: Column) -> Column:
    """array<struct<key, value>> of "- key: value" lines."""
    pattern = r"^- ([^:]+):\s*(.+)$"
    lines = F.filter(F.split(text, LINE_BREAK, -1), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("key"), _plain_cell(F.regexp_extract(x, pattern, 2)).alias("value")))


def pipe_table(text: Column, header: str) -> Column:
    """array<map<string,string>> of the rows below the first line that begins with header, up to the first line that is no row; rows of another width are left out."""
    lines = F.transform(F.split(text, LINE_BREAK, -1), strip)
    bare = lambda x: F.btrim(x, F.lit("|"))
    cells = lambda x: F.transform(F.split(bare(x), r"\|", -1), strip)
    at = F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(x), F.lit(header.lower()))), F.lit(True))

    def below(every: Column, n: Column) -> Column:
        rest = F.slice(every, n.cast("int") + 1, F.size(every))
        end = F.array_position(F.transform(rest, lambda x: ~F.startswith(x, F.lit("|"))), F.lit(True))
        body = F.when(end > 0, F.slice(rest, F.lit(1), end.cast("int") - 1)).otherwise(rest)
        names = cells(F.get(every, n.cast("int") - 1))
        rows = F.filter(body, lambda x: ~F.replace(bare(x), F.lit(" "), F.lit("")).rlike(r"^[-:|]+$") & (F.size(cells(x)) == F.size(names)))
        return F.transform(rows, lambda x: F.map_from_arrays(names, F.transform(cells(x), _plain_cell)))

    found = F.get(F.transform(F.array(lines), lambda every: below(every, at)), F.lit(0))
    return F.when(at > 0, found).otherwise(F.array().cast("array<map<string,string>>"))


def sample_checks(rows: DataFrame, required: list[str], order: str, text: str, mark: str, first: int = 100) -> DataFrame:
    """One row: rows there are, columns that are missing, and of the first rows by order those that hold mark and those with an empty required field."""
    missing = [c for c in required if c not in rows.columns]
    head = rows.orderBy(order).limit(first)
    empty = [F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0 for c in required if c in rows.columns]
    bad = empty[0] if empty else F.lit(False)
    for e in empty[1:]:
        bad = bad | e
    seen = head.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.contains(F.col(text), F.lit(mark))).alias("with_mark"), F.count_if(bad).alias("with_empty"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(seen).withColumn("missing", F.lit(",".join(missing)))


def traces(rows: DataFrame) -> DataFrame:
    """id, generator, problem, steps, label: rows with steps only, one for each step."""
    kept = rows.where(F.size("steps") > 0)
    label = F.coalesce("label", F.lit(-1))
    return kept.select(F.col("id").alias("example_id"), "generator", "problem", label.alias("label"), F.posexplode("steps").alias("step", "text")).withColumn("is_good", (F.col("label") < 0) | (F.col("step") < F.col("label")))


def canonical_pairs(rows: DataFrame, min_confidence: float = 0.0, sources: list[str] | None = None, most: int | None = None, domains: list[str] | None = None) -> DataFrame:
    """Filters by confidence, source and domain, then the first ``most`` by id."""
    out = rows.where(F.col("pair_confidence") >= min_confidence)
    out = out.where(F.col("source_tag").isin(*sources)) if sources else out
    out = out.where(F.col("domain_tag").isin(*domains)) if domains else out
    return out.orderBy("pair_id").limit(most) if most else out


def first_text(*names: str) -> Column:
    """The first of several columns that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"bbh": task_rows, "bigbench_hard": task_rows, "gsm8k": hash_marked, "strategyqa": yes_no_questions, "drop": passages, "proofwriter": premises, "math": worked_solutions, "hendrycks_math": worked_solutions, "logiqa": multiple_choice}


def load(spark: SparkSession, name: str, path: str | list[str], form: str = "parquet", limit: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Rows of a named data set in canonical form; KeyError for an unknown name. prepare renames raw columns; limit takes the first rows by id."""
    read = READERS[name]
    raw = spark.read.format(form).options(**options).load(path)
    raw = prepare(raw) if prepare else raw
    if "idx" not in raw.columns:
        raw = raw.withColumn("idx", F.monotonically_increasing_id())
    out = read(raw)
    return out.orderBy("id").limit(limit) if limit else out


def completeness(samples: DataFrame) -> DataFrame:
    """Counts of rows and of non-empty questions, answers and reasonings by data set."""
    some = {c: F.count_if(F.coalesce(F.length(squash(F.col(c))), F.lit(0)) > 0).alias(f"with_{c}") for c in ("question", "answer", "cot")}
    return samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *some.values())


def fingerprint(config: dict, digits: int = 12) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]


def write_artifact(rows: DataFrame, root: str, config: dict, form: str = "parquet", partition_by: list[str] | None = None, overwrite: bool = False) -> str:
    """Writes rows under a folder named by the config's fingerprint, unless a complete one is there; returns its path."""
    spark, path = rows.sparkSession, f"{root.rstrip('/')}/{fingerprint(config)}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
    if overwrite or not done:
        w = rows.write.mode("overwrite").format(form)
        (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


__all__ = ["CANONICAL", "READERS", "canonical_pairs", "completeness", "eight_line_records", "fingerprint", "first_text", "hash_marked", "load", "multiple_choice", "passages", "premises", "split_alias", "traces", "worked_solutions", "write_artifact", "yes_no_questions"]
