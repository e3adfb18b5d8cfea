"""Mixing sources to target weights by temperature.

weigh() turns the sources' token counts into weights: shares to the power of an exponent, normalised; the exponent is
bisected between 1 (natural shares) and 0 (even shares) to the flattest mix that keeps a target entropy, or that repeats
no source more often than a limit (the stricter of the two if both are given). The token budget defaults to the least
one for which every source is used whole at least once. Sources are rows of a table throughout: a round of the bisection
sums GRID exponents over them, and only these sums come to the driver, so their number has no bound.

plan() realises the weights: source s gets budget x weight tokens, as whole passes over its documents and a part of one
more. Each pass goes in an order of its own by hash; a document is in the last pass if fewer tokens than are left stand
before it. mix() deals the passes into blocks of BLOCK_TOKENS budgeted tokens so that every block holds each source in
its weight, and permutes each block by hash. Passes are made where documents are read, one row for each that is drawn.

Token totals in hash order come from sums over ranges of the hash, so no source, however large, is ever in one task.

Defined results. Tokens are words between white space, of whole texts. A null source is a source of its own. Null or empty
text counts as one token, so every document can be placed. Null keys are kept. Repeated rows are documents each; rows that
agree in key, tokens and text have one place in each pass: all or none of them pass a limit. An empty table gives no rows.
mix() reads key, source and text only; mixed_documents() keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settled

BLOCK_TOKENS = 1 << 18
#: Documents in a range of the hash, about, at least (the square root of their number if that is more).
RANGE_ROWS = 1_000
#: Exponents that a round of the bisection tries, and rounds.
GRID, ROUNDS = 256, 4


@dataclass(frozen=True)
class Weights:
    exponent: float
    budget: float
    #: source, have (tokens there are), weight, want (budgeted tokens)
    sources: DataFrame


def words(text: Column) -> Column:
    """White-space-separated tokens; one if there is none."""
    return F.size(F.split(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")).cast("long")


def fits(exponent: float, total: float, slope: float, largest: float, log_least: float, target_entropy: float | None, most_repeats: float | None, budget: float | None) -> bool:
    """Whether the mix at an exponent keeps the limits.

    total, slope: the sums of (n / largest) ^ exponent over all sources, and of these times their logarithms at exponent 1;
    log_least: that of the smallest source.
    """
    entropy = math.log(total) - exponent * slope / total
    size = largest * total if budget is None else budget  # the largest source has the most tokens to a weight
    repeats = size / (largest * total) * math.exp(min(700.0, log_least * (exponent - 1)))
    return (target_entropy is None or entropy <= target_entropy + 1e-12) and (most_repeats is None or repeats <= most_repeats + 1e-9)


def weigh(slim: DataFrame, target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None) -> Weights:
    """slim: source, n_tokens."""
    sources = settled(slim.groupBy("source").agg(F.sum("n_tokens").alias("have")), "mix-sources")
    span = sources.agg(F.max("have").alias("most"), F.min("have").alias("least")).first()
    if span.most is None:
        return Weights(1.0, 0.0, sources.withColumns({"weight": F.lit(1.0), "want": F.lit(0.0)}))
    largest, log_least = float(span.most), math.log(span.least / span.most)
    log = F.log(F.col("have") / largest)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(exponents))))
        rows = sources.select(log.alias("a"), tried.alias("t")).select("a", "t.*").withColumn("p", F.exp(F.col("x") * F.col("a")))
        return [(r.total, r.slope) for r in rows.groupBy("k").agg(F.sum("p").alias("total"), F.sum(F.col("p") * F.col("a")).alias("slope")).orderBy("k").collect()]

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):  # each cuts the interval to a GRID-th
        tried = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        good = [k for k, (x, s) in enumerate(zip(tried, sums(tried), strict=True)) if fits(x, *s, largest, log_least, target_entropy, most_repeats, budget)]
        first = min(good, default=GRID)
        if first == 0:
            high = tried[0]
            break
        low, high = tried[first - 1], tried[first]
    ((total, _),) = sums([high])
    size = largest * total if budget is None else budget
    weight = F.exp(log * high) / total
    return Weights(high, size, settled(sources.withColumns({"weight": weight, "want": weight * size}), "mix-weights"))


def plan(slim: DataFrame, weights: Weights, seed: int = 42) -> DataFrame:
    """The drawn rows of slim (doc, source, n_tokens, text_hash; a settled table): with pass, place (tokens of its source before it, over all passes) and want."""
    rows = slim.count()
    ranges = max(1, int(rows / max(RANGE_ROWS, math.isqrt(rows))))
    whole = F.floor(F.col("want") / F.col("have") + 1e-9)
    rest = F.col("want") - whole * F.col("have")
    sources = weights.sources.select(F.col("source").alias("_s"), "have", "want", whole.alias("whole"), rest.alias("rest"), (whole + (rest > 0.5).cast("int")).alias("passes"))
    drawn = slim.join(sources.where("passes > 0"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "pass", "doc", "n_tokens", "text_hash"))
    drawn = drawn.withColumn("range", F.floor((F.col("h") / 2.0**64 + 0.5) * ranges).cast("int"))
    sums = settled(drawn.groupBy("source", "pass", "range").agg(F.sum("n_tokens").alias("n")), "mix-ranges")
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source", "pass").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("range").alias("_r"), "before")
    placed = drawn.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("range") == F.col("_r"))).drop("_s", "_p", "_r")
    inside = F.sum("n_tokens").over(W.partitionBy("source", "pass", "range").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n_tokens").over(W.partitionBy("source", "pass", "range", "h"))
    placed = placed.withColumn("at", F.col("before") + inside)
    return placed.where((F.col("pass") < F.col("whole")) | (F.col("at") < F.col("rest"))).select("doc", "source", "n_tokens", "text_hash", "pass", (F.col("pass") * F.col("have") + F.col("at")).alias("place"), "want")


def drawn_rows(docs: DataFrame, key: str, source: str, tokens: Column | None, text: str, target_entropy: float | None, most_repeats: float | None, budget: float | None, block_tokens: int, seed: int) -> DataFrame:
    """doc, source, n_tokens, text_hash, pass, block."""
    count = words(F.col(text)) if tokens is None else tokens
    slim = settled(docs.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), count.alias("n_tokens"), F.xxhash64(F.col(text)).alias("text_hash")), "mix")
    weights = weigh(slim, target_entropy, most_repeats, budget)
    blocks = max(1, math.ceil(weights.budget / block_tokens))
    return plan(slim, weights, seed).withColumn("block", F.least(F.floor(F.col("place") / F.col("want") * blocks), F.lit(blocks - 1)).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", tokens: Column | None = None, text: str = "text", target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42) -> DataFrame:
    """One row for each drawn document and pass: key, source, n_tokens, pass, block, position (in the block)."""
    drawn = drawn_rows(docs, key, source, tokens, text, target_entropy, most_repeats, budget, block_tokens, seed)
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "doc", "pass", "text_hash"), "doc", "pass", "n_tokens", "text_hash")
    return drawn.select(F.col("doc").alias(key), "source", "n_tokens", "pass", "block", (F.row_number().over(order) - 1).cast("long").alias("position"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None, seed: int = 42) -> DataFrame:
    """docs, each row as often as it is drawn."""
    drawn = drawn_rows(docs, key, source, None, text, target_entropy, most_repeats, budget, BLOCK_TOKENS, seed)
    times = drawn.groupBy("doc", "source", "n_tokens", "text_hash").agg(F.count_distinct("pass").alias("times"))
    d, t = docs.alias("d"), times.alias("t")
    own = [F.col(f"d.`{c}`") for c in (key, source, text)]
    same = own[0].eqNullSafe(F.col("t.doc")) & own[1].cast("string").eqNullSafe(F.col("t.source")) & (F.xxhash64(own[2]) == F.col("t.text_hash")) & (words(own[2]) == F.col("t.n_tokens"))
    out = d.join(t, same).select("d.*", F.array_repeat(F.lit(0), F.col("t.times").cast("int")).alias("_copies"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode("_copies").alias("_copy")).drop("_copy")
