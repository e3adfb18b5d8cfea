"""Queries over the driver's tables: each a function (spark, sf_dir) and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, unit_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql may name the derived tables of DERIVED in its FROM clauses."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_derived(sql)
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_derived(sql: str) -> str:
    """sql behind a WITH of the derived tables that it names, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in DERIVED.items():
            if name in text and name not in need:
                visit(body)
                need.append(name)

    visit(sql)
    order = [n for n in DERIVED if n in need]
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({DERIVED[n]})" for n in order)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


#: Derived tables in DuckDB SQL; the functions of the same name below are their Spark forms. Later ones may use earlier ones.
DERIVED = {
    "d_lines": """SELECT doc_id, source, lang, trim(line, ' ') AS line, pos FROM (
        SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE length(trim(line, ' ')) > 0""",
    "d_steps": "SELECT doc_id, source, lang, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS step FROM d_lines",
    "d_hashed": """SELECT doc_id AS example_id, source AS generator, lang, step,
        ('0x' || substr(sha256(doc_id || ':' || step), 1, 8))::BIGINT / 4294967296.0 AS score,
        ('0x' || substr(sha256('bad:' || doc_id || ':' || step), 1, 8))::BIGINT % 7 AS luck FROM d_steps""",
    "d_traces": """SELECT example_id, generator, lang, step, CAST(score AS DOUBLE) AS score,
        CAST(coalesce(min(CASE WHEN luck = 0 THEN step END) OVER (PARTITION BY example_id), -1) AS INTEGER) AS label FROM d_hashed""",
    "d_pairs": """SELECT sha256(a.doc_id || '||' || a.step) AS pair_id, a.source AS source_tag, a.lang AS domain_tag, a.line AS chosen_text, b.line AS rejected_text, a.doc_id, a.step,
        CAST(('0x' || substr(sha256('conf:' || a.doc_id || ':' || a.step), 1, 8))::BIGINT / 4294967296.0 AS DOUBLE) AS pair_confidence,
        CASE ('0x' || substr(sha256('sem:' || a.doc_id || ':' || a.step), 1, 8))::BIGINT % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'sibling' WHEN 2 THEN 'terminal' ELSE NULL END AS semantics
        FROM d_steps a JOIN d_steps b ON a.doc_id = b.doc_id AND b.step = a.step + 1""",
    "d_rollouts": """SELECT user_id || ':' || event_type AS prefix_id, event_id, value > 12 AS is_correct, value < 1 AS parse_error, CAST(round(value) AS BIGINT) AS chars, event_type, user_id FROM events""",
    "d_predictions": """SELECT l.doc_id, d.lang AS dataset, d.source, l.quality, length(d.text) > 700 AS predicted, length(d.text) < 120 AS parse_error FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}


def d_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents with their place."""
    docs = t(spark, sf_dir, "documents")
    out = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return out.withColumn("line", F.trim("line")).where(F.length("line") > 0)


def d_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps numbered from 0: no shuffle, a document's lines are counted where they are exploded."""
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return docs.select("doc_id", "source", "lang", F.posexplode(kept).alias("step", "line"))


def d_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash score for each step and a hash label for each document."""
    docs = t(spark, sf_dir, "documents")
    kept = F.size(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0))
    ids = docs.select(F.col("doc_id").alias("example_id"), F.col("source").alias("generator"), "lang", kept.alias("n")).where("n > 0")
    name = F.concat_ws(":", F.col("example_id").cast("string"), F.col("step").cast("string"))
    luck = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: hash_bucket(F.concat(F.lit("bad:"), F.col("example_id").cast("string"), F.lit(":"), i.cast("string")), 7))
    label = F.coalesce(F.nullif(F.array_position(luck, F.lit(0).cast("long")), F.lit(0).cast("long")) - 1, F.lit(-1)).cast("int")
    rows = ids.withColumn("label", label).select("example_id", "generator", "lang", "label", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    return rows.select("example_id", "generator", "lang", "step", unit_hash(name, 8).alias("score"), "label")


def d_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines as preference pairs, with a hash confidence and a hash kind."""
    docs = t(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    two = F.arrays_zip(F.slice("k", 1, F.size("k") - 1).alias("chosen_text"), F.slice("k", 2, F.size("k") - 1).alias("rejected_text"))
    rows = docs.select("doc_id", "source", "lang", kept.alias("k")).where(F.size("k") > 1).select("doc_id", "source", "lang", F.posexplode(two).alias("step", "p"))
    own = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("step").cast("string"))
    kind = F.element_at(F.array(F.lit("local"), F.lit("sibling"), F.lit("terminal"), F.lit(None).cast("string")), hash_bucket(F.concat(F.lit("sem:"), own), 4).cast("int") + 1)
    return rows.select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("||"), F.col("step").cast("string")), 256).alias("pair_id"), F.col("source").alias("source_tag"), F.col("lang").alias("domain_tag"), "p.chosen_text", "p.rejected_text", "doc_id", "step", unit_hash(F.concat(F.lit("conf:"), own), 8).alias("pair_confidence"), kind.alias("semantics"))


def d_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("prefix_id"), "event_id", (F.col("value") > 12).alias("is_correct"), (F.col("value") < 1).alias("parse_error"), F.round("value").cast("long").alias("chars"), "event_type", "user_id")


def d_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("n"))
    return t(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("lang").alias("dataset"), "source", "quality", (F.col("n") > 700).alias("predicted"), (F.col("n") < 120).alias("parse_error"))
