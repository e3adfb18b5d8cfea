"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. All of them take empty tables, nulls in any column, repeated rows, and more
columns, which stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import language, lines, minhash, mixing, packing
from stepweave.llm.queries import BYTE_TOKENIZER, END_ID, MOST_REPEATS, held_out, table, tokenizer
from stepweave.llm.shared import settled

#: A document of which no language is at least this likely is rejected, and so is one without a letter.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: without a letter (null and empty texts among them), or with no likely language. Repeated rows stay."""
    model = language.fit(docs.where(~held_out()))
    judged = language.predict(docs, model, lang_out="_lang", score_out="_score")
    return judged.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; n_chars follows the text. A document that loses all its lines goes; null and empty texts, which have none to lose, stay."""
    return lines.dedup_lines(docs, exact_short=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (null last), of several texts under it one.

    A document is a doc_id with a text; rows that agree in both are one, of which one stays. Documents without a word (null,
    empty, signs only) are like no other, so they stay.
    """
    own = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    known = docs.withColumn("_own", own)
    kept = minhash.near_duplicates(known.select("_own", "text"), key="_own").where(F.col("_own") == F.col("class_id"))
    kept = settled(kept.groupBy(F.col("_own").alias("_k")).agg(F.count(F.lit(1)).alias("_rows")), "kept")
    out = known.join(kept, F.col("_own") == F.col("_k"))
    if kept.where("_rows > 1").isEmpty():
        return out.select(*docs.columns)
    once = out.where("_rows > 1").dropDuplicates(["_own"])  # repeated rows
    return out.where("_rows = 1").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, towards even shares; every document stays at least once. A null source is a source, a null text one token."""
    return mixing.mixed_documents(docs, most_repeats=MOST_REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: where its ids stand in which sequence. A null text is a piece of the end id alone."""
    return packing.pack_documents(docs, tokenizer(BYTE_TOKENIZER), END_ID)


STAGES = [("language", identify_language), ("lines", dedup_lines), ("near_duplicates", dedup_documents), ("mixing", mix_sources), ("packing", pack)]
#: Learned scores, edit distances and token ids have no SQL; tests/llm/test_pipeline.py holds run() against plain versions of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
