"""What several of the operators need: the shared folder, durable intermediate tables, bounded Arrow batches, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Of a local master without spark.checkpoint.dir: driver and executors are one process there.
_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master without that setting gets a temporary folder; the session's settings stay."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="stepweave-"))
    return _local_dir[0]


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, with its scheme; it goes with the scratch() it was made in, else when the driver's Python ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stepweave/{what}-{uuid.uuid4().hex}")
    path = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(since: int = 0) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder belongs to whoever set it
            return


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Drops, at its end, the intermediate tables that were written within: for long sessions, around the use of a result."""
    since = len(_written)
    try:
        yield
    finally:
        _forget(since)


def settled(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, is computed once.

    instead_of: a settled table that nothing else reads; it is dropped when df is written.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    if instead_of is not None and (old := getattr(instead_of, "_settled_at", None)):
        _written.remove((df.sparkSession, old))
        _delete(df.sparkSession, old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def workers_find_package(spark: SparkSession) -> None:
    """Python workers get the folder of this package on their path, wherever the driver was started (a cluster has it installed); the setting stays."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


#: Most bytes of an Arrow batch: a task holds some such batches on either side of the pipe to its Python.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, after the session's Arrow batches have been bounded by bytes (a smaller bound that is set stays).

    Spark reads that bound when the result is computed, so it can't be set back here: it stays for the session.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    workers_find_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, from file sizes where it reads files; at most 1 EB."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 10**18)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20, most_rows: int = 1 << 15):
    """Cuts an Arrow batch so that each part holds about most_bytes of a string column, and most_rows rows, at most (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    width = 8 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else 4
    if col.buffers()[1] is None:
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)
        return
    import numpy as np

    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if width == 8 else np.int32)[col.offset : col.offset + batch.num_rows + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1), at + most_rows)
        yield batch.slice(at, to - at)
        at = to


def components(edges: DataFrame, what: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), both long: (node, component), component the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each two joins and a distinct; every round is a
    table in the shared folder. Nodes without an edge are absent.
    """
    now = settled(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    for _ in range(most_rounds):
        # done when every node is either a head or has one edge, to a head
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")), F.struct(F.col("b").alias("node"), F.lit(0).alias("child")))).alias("e")).select("e.*")
        roles = ends.groupBy("node").agg(F.sum("child").alias("up"), F.min("child").alias("head"))
        if roles.where("up > 1 or (up = 1 and head = 0)").isEmpty():
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = settled(small, what, instead_of=now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(heads)


def linked_components(rows: DataFrame, verify, across, what: str) -> DataFrame:
    """Components (node, component) of rows (bucket, node, ...): nodes that meet in a bucket and pass a test.

    rows: a settled table of buckets with two nodes or more. verify(pairs) keeps the true pairs of (a, b). First each
    bucket's nodes meet its smallest. Then across(apart, others, on) links what is still in different components: apart
    are the rows outside of their bucket's first component, others all rows but the smallest nodes; on says which of
    their rows f and o have to meet. It may leave out links between nodes that its other links connect.
    """
    heads = settled(rows.groupBy("bucket").agg(F.min("node").alias("head")), f"{what}-heads")
    met = rows.select("bucket", "node").join(heads, "bucket")
    first = settled(verify(met.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()), f"{what}-links")
    part = components(first, what)
    own = part.select("node", F.col("component").alias("c"))
    head_own = part.select(F.col("node").alias("head"), F.col("component").alias("hc"))
    placed = rows.join(heads, "bucket").join(own, "node", "left").join(head_own, "head", "left")
    placed = placed.withColumns({"c": F.coalesce("c", "node"), "hc": F.coalesce("hc", "head")})
    # pairs with the head are done, so a bucket of two is
    open_buckets = placed.groupBy("bucket").agg(F.count_if(F.col("c") != F.col("hc")).alias("_out"), F.count(F.lit(1)).alias("_all")).where("_out > 0 and _all > 2").select("bucket")
    open_buckets = settled(open_buckets, f"{what}-buckets")  # a table of its own, so that a large bucket can be split where it is joined
    others = settled(placed.where("node <> head").join(open_buckets, "bucket", "left_semi"), f"{what}-open")
    apart = others.where("c <> hc")
    if apart.isEmpty():
        return part
    on = (F.col("f.bucket") == F.col("o.bucket")) & (F.col("f.c") != F.col("o.c")) & ((F.col("o.c") == F.col("o.hc")) | (F.col("f.node") < F.col("o.node")))
    second = settled(across(apart, others, on), f"{what}-links")
    if second.isEmpty():
        return part
    return components(first.unionByName(second), what)
