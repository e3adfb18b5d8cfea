"""Artifact folders: caches by signature, required files, checkpoints, and listings as tables. All paths go through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("off", "read", "write", "read_write")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def cache_key(namespace: str, signature: dict) -> str:
    """namespace and 24 hex digits of the signature's canonical JSON."""
    text = json.dumps(signature, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return f"{namespace}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def cached(spark: SparkSession, make: Callable[[], DataFrame], root: str, namespace: str, signature: dict, mode: str = "read_write") -> DataFrame:
    """The table of a signature: read from the cache where mode allows it and it is complete, else made, and written where mode allows it.

    A table is written under a name of its own and then renamed, so that readers see all of it or nothing; who comes second
    drops their own.
    """
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown cache mode {mode}")
    path = f"{root.rstrip('/')}/{cache_key(namespace, signature)}"
    if mode.startswith("read") and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    rows = make()
    if not mode.endswith("write"):
        return rows
    part = f"{path}.part-{uuid.uuid4().hex}"
    rows.write.parquet(part)
    fs, source = _fs(spark, part)
    _, target = _fs(spark, path)
    if mode == "write" and fs.exists(target):
        fs.delete(target, True)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    return spark.read.schema(rows.schema).parquet(path)


def purge(spark: SparkSession, root: str, namespace: str) -> int:
    """Deletes a namespace's tables, unfinished ones too; returns how many."""
    fs, at = _fs(spark, root)
    found = [s.getPath() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"{namespace}_*")) or []]
    for path in found:
        fs.delete(path, True)
    return len(found)


def required_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files under root that match, sorted; an error if there are none."""
    fs, at = _fs(spark, root)
    found = sorted(s.getPath().toString() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, pattern)) or [])
    if not found:
        raise FileNotFoundError(f"no {pattern} under {root}")
    return found


def first_existing(spark: SparkSession, candidates: list[tuple[str, str]], default: tuple[str, str]) -> tuple[str, str]:
    """The first (folder, variant) that is there, else the default."""
    return next((c for c in candidates if exists(spark, c[0])), default)


def file_signatures(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, bytes and modified of the files under root; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def incomplete_runs(listing: DataFrame, runs: DataFrame, required: list[str], run: str = "run", name: str = "name") -> DataFrame:
    """run and missing (array) of the runs that lack a required file. listing: run, name."""
    wanted = F.array(*(F.lit(r) for r in required))
    have = listing.where(F.col(name).isin(*required)).groupBy(run).agg(F.collect_set(name).alias("_have"))
    lacks = F.array_except(wanted, F.coalesce("_have", F.array().cast("array<string>")))
    return runs.select(run).join(have, run, "left").select(run, lacks.alias("missing")).where(F.size("missing") > 0)


def resolve_checkpoint(spark: SparkSession, manifest: dict, name: str = "best", missing_policy: str = "fail") -> dict:
    """Path and name of the checkpoint that a run's manifest names; with fallback_final the final one for a best one that is not there."""
    if name not in ("best", "final"):
        raise ValueError(f"unknown checkpoint {name}")
    files = manifest.get("output_files", {})
    paths = {k: (files.get(f"{k}_value_head") or "").strip() for k in ("best", "final")}
    there = {k: bool(p) and exists(spark, p) for k, p in paths.items()}
    found = name if there[name] else "final" if name == "best" and missing_policy == "fallback_final" and there["final"] else None
    if found is None:
        raise FileNotFoundError(f"checkpoint {name} is not there")
    return {"requested": name, "resolved": found, "path": paths[found], "fallback": found != name}
