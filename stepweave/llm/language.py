"""Language identification: multinomial naive Bayes over hashed character n-grams.

fit() counts hashed 1- to 3-grams of a bounded, documented sample of labelled rows, whole texts, and returns a matrix of
log probabilities (buckets x languages). predict() broadcasts that matrix (buckets x languages x 4 bytes, MOST_LANGUAGES
at most) and scores Arrow batches with numpy, whole texts, sparse: one gather and one segmented sum per n-gram order.

The sample: of each label about TRAIN_ROWS rows at most, those whose hash of text and label is below that label's share;
rows that agree in both count once, so a group of copies, however large, weighs as much as one row.

Defined results. Null text or a text without a letter: language ``und``, score 0. Empty training table: every row is
``und``. Ties go to the language that sorts first. Null labels and null texts are no training rows. Repeated rows and null
keys get a row each. Any extra columns stay; the two added ones are dropped from the input first if they clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches, slices

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Labelled rows of each language that fit() learns from, about, at most: the bound of the sample.
TRAIN_ROWS = 4_000
#: A model of more languages (128 KB each) is refused.
MOST_LANGUAGES = 500
SMOOTHING = 0.5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # float32, buckets x languages
    log_prior: np.ndarray
    bits: int = BUCKET_BITS
    orders: tuple[int, ...] = ORDERS


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each run of other characters than letters as one 32, and where each text begins (one more)."""
    lowered = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in lowered], out=begins[1:])
    return points, begins


def _letters() -> np.ndarray:
    """True for each code point of the basic plane that is a letter; beyond it, CJK and most scripts in use count as letters."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
    return _is_letter


_is_letter: np.ndarray | None = None


def _is_alpha(points: np.ndarray) -> np.ndarray:
    table = _letters()
    low = table[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        low[high] = [chr(c).isalpha() for c in points[high]]
    return low


def _grams(points: np.ndarray, begins: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that begins at each kept place, and where each text's places begin."""
    alpha = _is_alpha(points)
    blank = ~alpha
    kept = alpha.copy()
    kept[1:] |= blank[1:] & alpha[:-1]  # one blank after each word
    kept[begins[:-1]] = True  # and one before each text
    places = np.concatenate(([0], np.cumsum(kept)))
    own = np.where(blank[kept], np.uint32(32), points[kept]).astype(np.uint64)
    starts = places[begins]
    for n in orders:
        if len(own) < n:
            yield np.zeros(len(own), dtype=np.int32), starts
            continue
        h = own[: len(own) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        # An n-gram that runs into the next text only adds blanks and its first letters; it is masked by the caller.
        yield (h >> np.uint64(64 - bits)).astype(np.int32), starts


def count_grams(texts: list[str], bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    total = np.zeros(1 << bits, dtype=np.int64)
    points, begins = _codes(texts)
    for n, (buckets, starts) in zip(orders, _grams(points, begins, bits, orders), strict=True):
        inside = np.ones(len(buckets), dtype=bool)
        for k in range(1, n):
            last = starts[1:] - k
            inside[last[(last >= 0) & (last < len(inside))]] = False
        total += np.bincount(buckets[inside], minlength=1 << bits)
    return total


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS, bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING) -> Model:
    """Learns from about ``rows`` labelled rows of each label at most, by a hash of text and label.

    The share is taken where the rows are read, so a large table sends no more to the counting tasks than a small one.
    """
    named = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    found = named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not found:
        return Model((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits, orders)
    share = F.element_at(F.create_map(*(F.lit(x) for r in found for x in (r.l, min(1.0, rows / r.n)))), F.col("l"))
    kept = named.where(F.xxhash64("t", "l") / 2.0**64 + 0.5 <= share).distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                texts, labels = np.array(part.column(0).to_pylist(), dtype=object), np.array(part.column(1).to_pylist(), dtype=object)
                for lang in sorted(set(labels.tolist())):
                    own = texts[labels == lang].tolist()
                    sums[lang] = sums.get(lang, 0) + count_grams(own, bits, orders)
                    docs[lang] = docs.get(lang, 0) + len(own)
        for lang in sums:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([docs[lang]], pa.int64()), pa.array([sums[lang].astype("<i8").tobytes()], pa.binary())], ["l", "docs", "counts"])

    found = map_batches(kept.repartition(4), counted, "l string, docs long, counts binary").collect()  # a row for each language of the four tasks
    languages = tuple(sorted({r.l for r in found}))
    if not languages:
        return Model((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits, orders)
    counts = np.zeros((1 << bits, len(languages)))
    docs = np.zeros(len(languages))
    for r in found:
        k = languages.index(r.l)
        counts[:, k] += np.frombuffer(r.counts, "<i8")
        docs[k] += r.docs
    smooth = counts + smoothing
    return Model(languages, (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32), np.log(docs / docs.sum()), bits, orders)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text (-1: no letter, or no model) and its posterior probability."""
    n, langs = len(texts), len(model.languages)
    points, begins = _codes(texts)
    has = np.add.reduceat(_is_alpha(points).astype(np.int64), begins[:-1]) > 0 if n else np.zeros(0, bool)
    if not langs or not n:
        return np.full(n, -1), np.zeros(n)
    total = np.tile(model.log_prior, (n, 1))
    for order, (buckets, starts) in zip(model.orders, _grams(points, begins, model.bits, model.orders), strict=True):
        inside = np.ones(len(buckets), dtype=bool)
        for k in range(1, order):
            last = starts[1:] - k
            inside[last[(last >= 0) & (last < len(inside))]] = False
        begin = np.minimum(starts[:-1], max(len(buckets) - 1, 0))
        for k in range(langs):
            if len(buckets):
                got = model.log_probability[:, k].take(buckets) * inside
                total[:, k] += np.add.reduceat(got, begin, dtype=np.float64)
    best = total.argmax(axis=1)
    with np.errstate(over="ignore"):
        posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(has, best, -1), np.where(has, posterior, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the two added columns."""
    docs = docs.drop(lang_out, score_out)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = ["" if t is None else t for t in part.column(at).to_pylist()]
                best, p = score(texts, sent.value)
                names = pa.array([sent.value.languages[k] if k >= 0 else "und" for k in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(p, pa.float64())], names=[*part.schema.names, lang_out, score_out])

    return map_batches(docs, scored, schema)
