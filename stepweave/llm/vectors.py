"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact re-ranking.

fit() learns, on a bounded sample, the principal axes and by iterative quantisation (Gong & Lazebnik 2011) a rotation of
them whose signs make balanced binary codes, for each of the MODELS most frequent widths; vectors of other widths, and of
those whose near pairs a learned rotation would part, get the signs of a seeded random projection. So every vector gets a
code of BITS bits, cut into TABLES keys. Two vectors meet if,
in some table, their keys differ in at most REACH bits (both are entered under their key and all keys one bit away) and
their whole codes in at most RADIUS; a pair counts in the first such table alone. What meets is compared by cosine in
double precision.

Vectors of equal label and components are one node, so copies are never paired among themselves; links and classes
are weighted with their number.

Defined results. Vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label,
link with nothing; vectors of different width never link with each other. Repeated rows count as vectors each. Null keys
are kept. A component has the smallest key in it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, map_batches, settled

THRESHOLD = 0.93
#: Rows, and bytes of their components, at most, on which a rotation is learned (those with the smallest hash); widths that get one.
SAMPLE, SAMPLE_BYTES, MODELS = 20_000, 32 << 20, 4
#: Widths beyond it are not learned: the axes take a width's square of memory; nor are those with fewer than LEAST_ROWS vectors, or LEAST_FOLD an axis.
MOST_WIDTH, LEAST_ROWS, LEAST_FOLD = 4096, 100, 4
#: Vectors of the sample whose near pairs show whether a learned projection finds them.
PROBES = 2_000
ROUNDS = 30
BITS, TABLES, REACH = 64, 4, 2
#: At cosine 0.93 codes of 64 bits differ in 7.7 on average; 11 are within the reach of every pair that shares no nearer key.
RADIUS = 18


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (width x bits) of unit vectors; more bits than axes: several rotations side by side."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        axes = vectors[:, ::-1][:, : min(bits, x.shape[1])]
        v = centred @ axes
        r = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(rows: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> mean and projection. rows: v (array<double>), usable."""
    widths = rows.groupBy(F.size("v").alias("w")).count().where(f"count >= {LEAST_ROWS} and count >= {LEAST_FOLD} * w and w <= {MOST_WIDTH}").orderBy(F.desc("count"), "w").limit(MODELS).collect()
    models = {}
    for width in (r.w for r in widths):
        most = max(2, min(sample, SAMPLE_BYTES // (8 * width)))
        some = rows.where(F.size("v") == width).select("v").orderBy(F.xxhash64("v")).limit(most).toArrow()
        x = some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        x = unit(x)
        learned = learn_rotation(x, bits)
        # vectors in a narrow cone are nearer to each other than to their mean, where a rotation about the mean parts them
        if found(x[:PROBES], learned) >= found(x[:PROBES], unlearned(width, bits)) - 0.005:
            models[width] = learned
    return models


def found(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> float:
    """Share of the pairs of unit vectors at the threshold or above whose codes meet; 1 if there are none."""
    bits = (x - model[0]) @ model[1] >= 0
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    if not len(a):
        return 1.0
    apart = (bits[a] != bits[b]).reshape(len(a), TABLES, -1).sum(axis=2)
    return float(((apart.min(axis=1) <= REACH) & (apart.sum(axis=1) <= RADIUS)).mean())


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unlearned(width: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The model of a width that has none: a projection that depends on the width alone."""
    return np.zeros(width), np.random.default_rng(width).standard_normal((width, bits))


def codes(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]], bits: int = BITS) -> DataFrame:
    """rows (node, label, v, ...) with width, code (long) and unit (float64 bytes of the unit vector)."""
    sent = rows.sparkSession.sparkContext.broadcast(models)  # MODELS x (width + 1) x bits x 8 bytes

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2)], dtype=np.int64)
            for width in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                mean, projection = sent.value.get(width) or unlearned(width, bits)
                x = unit(np.array(part.column(2).to_pylist(), dtype=np.float64))
                code = np.packbits((x - mean) @ projection >= 0, axis=1, bitorder="little").view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(x), width, np.int32)), pa.array(code), pa.array([u.tobytes() for u in x], pa.binary())], ["node", "label", "width", "code", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    return map_batches(rows.select("node", "label", "v"), coded, f"node long, label {kind}, width int, code long, unit binary")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _key(code: Column, table: int, tables: int = TABLES, bits: int = BITS) -> Column:
    size = bits // tables
    return F.shiftrightunsigned(code, table * size).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def meet(coded: DataFrame, radius: int = RADIUS, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """Pairs a < b of nodes of one label and width whose codes meet, each once.

    Both sides are entered under their key and all keys one bit away; they find each other up to two bits apart. Of the
    ways to meet only one counts: the lower differing bit is flipped on side a, the higher on side b.
    """
    size = bits // tables
    flips = [0, *(1 << k for k in range(size))]

    def entered(side: str) -> DataFrame:
        places = [F.struct(F.lit(t).alias("t"), F.lit(f).alias("f"), _key(F.col("code"), t, tables, bits).bitwiseXOR(F.lit(f)).alias("k")) for t in range(tables) for f in flips]
        return coded.select("node", "label", "width", "code", F.explode(F.array(*places)).alias("e")).select("node", "label", "width", "code", "e.t", "e.f", "e.k").alias(side)

    ca, cb = F.col("a.code"), F.col("b.code")
    first = F.lit(tables)
    for t in reversed(range(tables)):
        first = F.when(_apart(_key(ca, t, tables, bits), _key(cb, t, tables, bits)) <= REACH, t).otherwise(first)
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k"))
    once = (F.col("a.node") < F.col("b.node")) & ((F.col("b.f") == 0) | ((F.col("a.f") != 0) & (F.col("a.f") < F.col("b.f")))) & (F.col("a.t") == first)
    return entered("a").join(entered("b"), same & once & (_apart(ca, cb) <= radius)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def rerank(pairs: DataFrame, coded: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) with a cosine of threshold or more."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes, near = np.array([len(x) for x in left]), np.zeros(batch.num_rows, bool)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join([side[k] for k in at]), np.float64).reshape(len(at), -1) for side in (left, right))
                near[at] = np.einsum("ij,ij->i", x, y) >= threshold
            ok = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    left = pairs.join(coded.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a")
    both = left.join(coded.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")
    return map_batches(both.select("a", "b", "x", "y"), hold, "a long, b long")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Every row: key, n_links (other rows linked directly), component_id, kept."""
    slim = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    slim = settled(slim.withColumn("good", good).withColumn("node", F.when(F.col("good"), F.xxhash64("label", "v"))).drop("good"), "vectors")
    nodes = settled(slim.where("node is not null").groupBy("node", "label", "v").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), "vector-nodes")
    coded = settled(codes(nodes, fit(nodes)), "codes")
    links = settled(rerank(meet(coded), coded, threshold), "vector-links")
    n = nodes.select("node", "n")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(n.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    part = components(links, "vector-cc")
    own = nodes.select("node", "n", "first").join(degree, "node", "left").join(part, "node", "left").withColumn("c", F.coalesce("component", "node"))
    own = settled(own, "vector-classes")
    least = own.groupBy("c").agg(F.min("first").alias("component_id"))
    by_node = own.join(least, "c").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    out = slim.select("key", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
