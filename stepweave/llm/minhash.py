"""Near-duplicate documents by BagMinHash signatures of word shingles.

A document is the multiset of its runs of five words (lower case; fewer words: one run of all). A shingle of count w
stands for the weight range [0, w), discretised into [0, 1), [1, 2), [2, 4), [4, 8) ...: each range is a Poisson process
of its own, keyed by shingle and range, whose points fall on random registers; inside a range that w covers in part,
each point carries its place and counts only below w. A register holds the earliest point, so two registers agree with
the probability of the weighted Jaccard similarity, without bias. Only points up to a bound that fills nearly all
registers are made; a document with an empty register left gets a larger bound, so that the result is that of the whole
processes. 32 bands of 4 registers give candidates (a pair of similarity 0.8 is missed with probability 5e-8).

Documents with equal shingles are one node. In each band bucket every node meets the smallest node; what the exact
weighted Jaccard similarity of the shingle multisets confirms is linked. Then, in buckets that still hold several
components, nodes of different components are compared block by block: first by signature (pairs are ruled out 4.5
standard deviations below the threshold), then exactly, unless other links of the block already connect them. A block
gives back the links that connect its components, so no group is ever expanded into pairs.

Defined results. A document without a word (null, empty, signs only) is a class of its own. Repeated rows and null keys
are kept; a class has the smallest key in it (null if it has none but null). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import linked_components, map_batches, settled, slices, workers_find_package

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Most of 128 one-bit registers that may differ: at similarity 0.8 they do with a mean of 12.8 and a deviation of 3.4.
MOST_APART = 30
#: Least share of 128 registers that agree: 0.8 less 4.5 deviations.
LEAST_AGREEING = 0.64
#: Nodes, and bytes of signatures and bags, on one side of a block.
BLOCK_NODES, BLOCK_BYTES = 1024, 8 << 20
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_in_word = np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_byte_value = mix(np.arange(256, dtype=np.uint64) * _P + U(0x1234567))


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        _powers[name] = np.cumprod(np.concatenate(([U(1)], np.full(max(n, 1 << 16), base))), dtype=np.uint64)
    return _powers[name][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words begin (one more)."""
    raw = "\n".join([(t or "").lower() for t in texts]).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len((t or "").lower().encode("utf-8", "surrogatepass")) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    inside = np.concatenate(([False], _in_word[data], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = change[::2], change[1::2]
    total = np.concatenate(([U(0)], np.cumsum(_byte_value[data] * _power(len(data), _P, "p"), dtype=np.uint64)))
    words = mix((total[end] - total[begin]) * _power(len(data) + 1, _P_INV, "i")[begin] + (end - begin).astype(np.uint64))
    return words, np.concatenate(([0], np.searchsorted(begin, ends)))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text: the text, hash (48 bits) and count of each distinct shingle; and where each text's begin (one more)."""
    words, starts = word_hashes(texts)
    n = np.diff(starts)
    runs = np.maximum(n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), runs)
    first = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(runs)))[:-1], runs) + np.arange(len(text))
    last = starts[1:][text]
    h = np.zeros(len(text), np.uint64)
    for k in range(size):
        at = first + k
        ok = at < last
        h = h * U(0xD6E8FEB86659FD93) + np.where(ok, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else U(0), U(0))
    h = mix(h) >> U(16)
    if len(texts) >= 1 << 16:  # slices() gives half as many at most
        raise ValueError("at most 65535 texts at once")
    both = np.sort((text.astype(np.uint64) << U(48)) | h)
    new = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    own, counts = both[at], np.diff(np.concatenate((at, [len(both)])))
    text = (own >> U(48)).astype(np.int64)
    return text, own & U((1 << 48) - 1), counts, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(text: np.ndarray, h: np.ndarray, counts: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """Bits of the earliest point of each register: (n_texts, m) uint64; all ones where a text has no shingle."""
    levels = [(text, h, np.zeros(len(text), np.int64), np.ones(len(text)), np.ones(len(text), np.int64))]
    many = np.flatnonzero(counts > 1)
    j = 1
    while len(many):  # ranges [2^(j-1), 2^j) of shingles with a count above 2^(j-1)
        low = 1 << (j - 1)
        levels.append((text[many], h[many], np.full(len(many), j), np.full(len(many), float(low)), np.minimum(counts[many], 2 * low) - low))
        many = many[counts[many] > 2 * low]
        j += 1
    text_, h_, level, width, covered = (np.concatenate(x) for x in zip(*levels, strict=True))
    weight = np.bincount(text, weights=counts, minlength=n_texts)
    seed = mix(h_ * _P + level.astype(np.uint64) * U(0xA0761D6478BD642F))
    registers = np.full((n_texts, m), np.inf)
    todo, slack = weight > 0, 2.0
    while todo.any():
        bound = np.where(todo, (np.log(m) + slack) / np.maximum(weight, 1), 0.0)
        at = np.flatnonzero(todo[text_])
        x = np.zeros(len(at))
        step = 0
        while len(at):
            step += 1
            r = mix(seed[at] + U(step * int(_P) & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[at])
            keep = x <= bound[text_[at]]
            at, x, r = at[keep], x[keep], r[keep]
            s = mix(r ^ U(0xE7037ED1A0B428DB))
            place = (s >> U(32)).astype(np.float64) * 2.0**-32 * width[at]
            good = place < covered[at]
            np.minimum.at(registers.reshape(-1), text_[at[good]] * m + (s[good] % U(m)).astype(np.int64), x[good])
        todo = todo & np.isinf(registers).any(axis=1)
        slack += 4.0
    return registers.view(np.uint64)


def _content(text: np.ndarray, h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each multiset; 0 for the empty one."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, text, mix(h * _P + counts.astype(np.uint64)))
    return np.where(np.bincount(text, minlength=n) > 0, mix(out) | U(1), U(0))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node (hash of the shingle multiset, null without a word), bands, s1, s2 (128 one-bit registers)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                t, h, c, _ = shingles(part.column(1).to_pylist())
                n = part.num_rows
                node = _content(t, h, c, n)
                sig = mix(signatures(t, h, c, n))
                band = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band * _P + sig[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                bits = np.packbits((sig >> U(63)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64), mask=node == 0), lists, pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], [key, "node", "bands", "s1", "s2"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), signed, f"`{key}` {kind}, node long, bands array<long>, s1 long, s2 long")


def _bags(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node, bag (distinct shingles and counts) and marks (16 bits of each register) of the wanted nodes; nodes: node, one of its keys."""

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                t, h, c, starts = shingles(part.column(0).to_pylist())
                node = _content(t, h, c, part.num_rows)
                bags = [h[a:b].tobytes() + c[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                marks = (mix(signatures(t, h, c, part.num_rows)) & U(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(bags, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], ["node", "bag", "marks"])

    wanted = nodes.select(F.col("key").alias("_k")).distinct()
    some = docs.select(key, text).join(wanted, F.col(key).eqNullSafe(F.col("_k")), "left_semi").select(text)
    made = map_batches(some, bagged, "node long, bag binary, marks binary").dropDuplicates(["node"])
    return made.join(nodes.select("node"), "node", "left_semi")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    na, nb = len(a) // 12, len(b) // 12
    ha, hb = np.frombuffer(a, np.uint64, na), np.frombuffer(b, np.uint64, nb)
    ca, cb = np.frombuffer(a, np.int32, na, 8 * na), np.frombuffer(b, np.int32, nb, 8 * nb)
    at = np.minimum(np.searchsorted(hb, ha), nb - 1)
    same = hb[at] == ha
    both = int(np.minimum(ca[same], cb[at[same]]).sum())
    return both / max(1, int(ca.sum()) + int(cb.sum()) - both)


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose bags reach the threshold."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([similarity(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    left = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    both = left.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    return map_batches(both.select("a", "b", "bag_a", "bag_b"), hold, "a long, b long")


def connect(node: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, marks: np.ndarray, band: int, bags: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect all parts which true pairs between the rows left and right connect.

    A pair that agrees in an earlier band as well is that band's.
    """
    root = part.copy()
    least = int(np.ceil(LEAST_AGREEING * marks.shape[1]))
    links = []
    for i in left.tolist():
        some = right[root[right] != root[i]]
        same = marks[some] == marks[i]
        close = np.count_nonzero(same, axis=1) >= least
        if not close.any():
            continue
        some, same = some[close], same[close]
        own = same.reshape(len(some), marks.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
        for j in some[own].tolist():
            if root[i] != root[j] and similarity(bags[i], bags[j]) >= threshold:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                links.append((int(node[i]), int(node[j])))
    return links


def across_components(apart: DataFrame, others: DataFrame, on: Column, bags: DataFrame, threshold: float) -> DataFrame:
    """Links between components inside buckets, by blocks."""
    differ = F.bit_count(F.col("f.s1").bitwiseXOR(F.col("o.s1"))) + F.bit_count(F.col("f.s2").bitwiseXOR(F.col("o.s2"))) <= MOST_APART
    # semi-joins: a row of either side stays if the other has any that it might be linked with
    f = apart.alias("f").join(others.alias("o"), on & differ, "left_semi")
    o = others.alias("o").join(apart.alias("f"), on & differ, "left_semi")
    met = settled(f.unionByName(o).select("bucket", "band", "node", "c").distinct(), "near-met")
    full = met.join(bags, "node")
    size = F.octet_length("bag") + F.octet_length("marks")
    blocks = full.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("_blocks"))
    dealt = full.join(blocks, "bucket").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        marks = np.frombuffer(b"".join(rows["marks"]), "<u2").reshape(len(rows), -1)
        own, place = rows["_own"].to_numpy(), np.arange(len(rows))
        i, j = int(rows["_i"][0]), int(rows["_j"][0])
        left, right = place[own == i], place[own == j]
        found = connect(rows["node"].to_numpy(), rows["c"].to_numpy(), left, right, marks, int(rows["band"][0]), rows["bag"].tolist(), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    workers_find_package(full.sparkSession)
    return dealt.select("bucket", "band", "_i", "_j", "_own", "node", "c", "marks", "bag").groupBy("bucket", "_i", "_j").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, node, class_id (the smallest key of its class) and class_size; rows without a word: node null, a class of their own."""
    made = settled(sketch(docs, key, text), "sketch")
    nodes = settled(made.where("node is not null").groupBy("node").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("n")), "nodes")
    # every row of a node has the same bands; those of its smallest key stand for it
    alone = made.where("node is not null").join(nodes.select("node", "key"), "node").where(F.col(key).eqNullSafe(F.col("key"))).dropDuplicates(["node"])
    banded = alone.select("node", "s1", "s2", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    rows = settled(banded.join(shared, "bucket"), "bands")
    bags = settled(_bags(docs, rows.select("node").distinct().join(nodes, "node"), key, text), "bags")
    part = linked_components(rows, lambda pairs: verified(pairs, bags, threshold), lambda f, o, on: across_components(f, o, on, bags, threshold), "near")
    of_node = settled(nodes.join(part.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node")), "classes")
    classes = of_node.groupBy("c").agg(F.min("key").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = of_node.select("node", "c").join(classes, "c").select("node", "class_id", "class_size")
    out = made.select(key, "node").join(by_node, "node", "left")
    return out.select(key, "node", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
