"""Filters, dedup, splits, caps, quotas and orders over rows with a text id.

Ranks are by stated orders, never by the order of rows in files. A cap by rank within a key shuffles by that key; Spark
filters ranks below a limit in the map tasks already where the limit is a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..functions.text import squash


def quality_flags(rows: DataFrame, chosen: str = "chosen_text", rejected: str = "rejected_text", prompt: str | None = None) -> DataFrame:
    """rows with q, a struct of the sizes, length ratio, token overlap (Jaccard; 1 for two empty texts), non_empty, distinct_pair.

    Texts are squashed once and cut into words once: each step is a projection that the next one reads.
    """
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, " ")))
    cut = rows.withColumns({"_c": squash(F.col(chosen)), "_r": squash(F.col(rejected)), "_p": F.length(squash(F.col(prompt))) if prompt else F.lit(0)})
    cut = cut.withColumns({"_a": words("_c"), "_b": words("_r")}).withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    nc, nr = F.length("_c"), F.length("_r")
    union = F.size("_a") + F.size("_b") - F.col("_both")
    overlap = F.when(union == 0, 1.0).otherwise(F.col("_both") / F.greatest(union, F.lit(1)))
    q = F.struct(nc.alias("chosen_chars"), nr.alias("rejected_chars"), (F.greatest(nc, nr) / F.greatest(F.least(nc, nr), F.lit(1))).alias("length_ratio"), overlap.alias("token_overlap_ratio"), ((nc > 0) & (nr > 0)).alias("non_empty"), (F.col("_c") != F.col("_r")).alias("distinct_pair"), F.col("_p").alias("prompt_chars"))
    return cut.withColumn("q", q).drop("_c", "_r", "_p", "_a", "_b", "_both")


def passes_quality(flags: Column, min_chars: int = 12, max_ratio: float = 4.0, max_overlap: float = 0.995) -> Column:
    return flags["non_empty"] & flags["distinct_pair"] & (flags["chosen_chars"] >= min_chars) & (flags["rejected_chars"] >= min_chars) & (flags["length_ratio"] <= max_ratio) & (flags["token_overlap_ratio"] <= max_overlap)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is not true; null if all are."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def first_wins(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key, the first by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def three_way_split(key: Column, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> Column:
    u = unit_hash(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def group_split(rows: DataFrame, unit: str, seed: int = 42, validation: float = 0.1) -> DataFrame:
    """split train or validation by a hash of the unit; if a side stays empty, the last unit in order goes there."""
    u = unit_hash(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 16, float(0xFFFFFFFFFFFFFFFF))
    marked = rows.withColumn("_v", u < validation)
    state = marked.agg(F.max(unit).alias("_last"), F.bool_or("_v").alias("_any"), F.bool_and("_v").alias("_all"), F.countDistinct(unit).alias("_units"))
    side = F.when((F.col("_units") > 1) & (F.col(unit) == F.col("_last")) & ~F.col("_any"), True).when((F.col("_units") > 1) & (F.col(unit) == F.col("_last")) & F.col("_all"), False).otherwise(F.col("_v"))
    return marked.crossJoin(F.broadcast(state)).withColumn("split", F.when(side, "validation").otherwise("train")).drop("_v", "_last", "_any", "_all", "_units")


def split_alias(name: Column) -> Column:
    v = F.lower(F.trim(name))
    return F.when(v.isin("val", "valid", "dev", "validation"), "validation").when(v.isin("train", "test"), v)


def round_robin_cap(rows: DataFrame, bucket: str, order: str, cap: int) -> DataFrame:
    """cap rows, taken in turn from each bucket (buckets in their order), each bucket by order."""
    top = rows.withColumn("_turn", F.row_number().over(W.partitionBy(bucket).orderBy(order))).where(F.col("_turn") <= cap)
    return top.orderBy("_turn", bucket).limit(cap).drop("_turn")


def ranked(rows: DataFrame, key: str, order: list[Column | str], bucket: Column) -> DataFrame:
    """rows with _n (rank within the key by order, from 1) and _all (rows of the key), without a window over a whole key.

    bucket: a number that never falls along the order, with some thousand values at most; ranks are taken inside it and
    added to the counts of those before, which are broadcast (keys are few here).
    """
    marked = rows.withColumn("_b", bucket)
    sizes = marked.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(key)
    before = sizes.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_all"))
    placed = marked.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_bb")))
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order))
    return placed.withColumn("_n", F.col("_before") + inside).drop("_k", "_b", "_bb", "_before")


def quota_by_key(rows: DataFrame, key: str, order: list[Column | str], quota: Column, bucket: Column) -> DataFrame:
    """The first quota rows of each key; quota may read the key and its count (_all)."""
    return ranked(rows, key, order, bucket).where(F.col("_n") <= quota).drop("_n", "_all")


def first_by_key(rows: DataFrame, key: str, order: list[Column | str], quota: Column, most: int) -> DataFrame:
    """The first quota rows of each key where no quota is above ``most``, a number: Spark ranks and cuts in the map tasks already."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", rank).where((F.col("_n") <= most) & (F.col("_n") <= quota)).drop("_n")


def hash_slot(digest: Column, slots: int = 4096) -> Column:
    """A bucket for ranked() of an order by hexadecimal digest."""
    return F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") * slots / 65_536).cast("int")


def range_slot(value: Column, low: float, high: float, slots: int = 4096, falling: bool = False) -> Column:
    """A bucket for ranked() of an order by a number from low to high."""
    at = F.least(F.greatest(F.floor((value - low) / (high - low) * slots), F.lit(0)), F.lit(slots - 1)).cast("int")
    return slots - 1 - at if falling else at


def semantic_quotas(most: int, primary: str, terminal: str, fraction: float) -> dict[str, int]:
    """Rows of a source by meaning: terminal ones get their (half-even rounded) share, one at least and all but one at most."""
    budget = min(max(1, round(most * fraction)), most - 1)
    return {primary: most - budget, terminal: budget}


def even_quotas(keys: DataFrame, key: str, total: int) -> DataFrame:
    """total split evenly over the keys; the first ones in order get one more."""
    n = keys.select(key).distinct()
    return n.select(key, (F.floor(F.lit(total) / F.count(F.lit(1)).over(W.partitionBy())) + (F.row_number().over(W.orderBy(key)) <= F.pmod(F.lit(total), F.count(F.lit(1)).over(W.partitionBy()))).cast("int")).cast("int").alias("quota"))


def largest_remainder(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """Integer quotas of total: floors, then one more by remainder (largest first, then key)."""
    exact = F.col(share) * total
    base = shares.withColumns({"_floor": F.floor(exact + 1e-9), "_rest": exact - F.floor(exact + 1e-9)})
    left = F.lit(total) - F.sum("_floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.round("_rest", 9).desc(), key))
    return base.select(key, (F.col("_floor") + (rank <= left).cast("int")).cast("int").alias("quota"))


def hash_order(namespace: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}|"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, namespace: str) -> DataFrame:
    """n rows by a stable hash order."""
    return rows.orderBy(hash_order(namespace, F.col(key)), key).limit(n)


def spread_places(n: int, count: Column) -> Column:
    """array of the 1-based places of n rows spread evenly over count (half-even rounding), fewer if there are fewer."""
    many = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (count - 1) / F.lit(max(n - 1, 1))).cast("int") + 1)
    return F.when(count <= n, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array_distinct(many))


def diverse_places(n: int, count: Column) -> Column:
    """array of the 1-based places of n of count candidates: the first; with n = 2 the last; else the rest spread evenly behind the first (half-even rounding)."""
    if n <= 2:
        few = F.array(F.lit(1).cast("long"), *([count.cast("long")] if n == 2 else []))
        return F.when(count <= n, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(few)
    rest = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.bround(i * (count - 2) / F.lit(n - 2)).cast("long") + 2)
    # more than n - 1 candidates over n - 1 places: no two places fall together
    return F.when(count <= n, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(F.concat(F.array(F.lit(1).cast("long")), rest))


def spread_select(rows: DataFrame, key: str, order: str, n: Column | int, bucket: Column) -> DataFrame:
    """n rows of each key (an expression of the key), evenly spread in order: place round(i (all - 1) / (n - 1)), half to even."""
    n = n if isinstance(n, Column) else F.lit(n)
    r = ranked(rows, key, [order], bucket)
    # place p is chosen if some slot rounds to it: only the two slots next to its exact one can
    steps, last = F.greatest(n - 1, F.lit(1)), F.greatest(F.col("_all") - 1, F.lit(1))
    at = F.col("_n") - 1
    near = F.floor(at * steps / last)
    hits = F.exists(F.array(near - 1, near, near + 1, near + 2), lambda i: (i >= 0) & (i <= n - 1) & (F.bround(i * (F.col("_all") - 1) / steps).cast("long") == at))
    return r.where((F.col("_all") <= n) | F.when(n <= 1, at == 0).otherwise(hits)).drop("_n", "_all")


def stratified_sizes(rows: DataFrame, wrong: Column, most: int) -> DataFrame:
    """One row: n_good and n_bad, how many all-good and erroneous examples a sample of ``most`` takes.

    Proportional (rounded half to even), one of each at least; what one side lacks the side with more left over gives.
    """
    c = rows.agg(F.count_if(~wrong).alias("good"), F.count_if(wrong).alias("bad"))
    g = c.withColumn("g", F.least(F.col("good"), F.greatest(F.lit(1), F.bround(F.lit(most) * F.col("good") / (F.col("good") + F.col("bad"))).cast("long"))))
    g = g.withColumn("b", F.least(F.col("bad"), F.greatest(F.lit(1), most - F.col("g")))).withColumn("left", F.greatest(most - F.col("g") - F.col("b"), F.lit(0)))
    to_bad = F.col("bad") - F.col("b") >= F.col("good") - F.col("g")
    some = g.select("good", "bad", F.when(to_bad, F.col("g")).otherwise(F.least("good", F.col("g") + F.col("left"))).alias("n_good"), F.when(to_bad, F.least("bad", F.col("b") + F.col("left"))).otherwise(F.col("b")).alias("n_bad"))
    small = F.col("good") + F.col("bad") <= most
    return some.select(*(F.when(small, F.col(a)).when(F.col(o) == 0, F.least(F.col(a), F.lit(most))).otherwise(F.when(F.col(a) == 0, 0).otherwise(F.col(k))).cast("long").alias(k) for a, o, k in (("good", "bad", "n_good"), ("bad", "good", "n_bad"))))


def stratified_spread(rows: DataFrame, wrong: Column, order: str, most: int, bucket: Column) -> DataFrame:
    """A spread of all-good and one of erroneous examples, sized by stratified_sizes; of one too many (each side has one at least) the last by order goes."""
    marked = rows.withColumn("_wrong", wrong)
    sizes = stratified_sizes(rows, wrong, most)
    sized = marked.crossJoin(F.broadcast(sizes)).withColumn("_want", F.when(F.col("_wrong"), F.col("n_bad")).otherwise(F.col("n_good")))
    return spread_select(sized, "_wrong", order, F.col("_want"), bucket).where("_want > 0").drop("_wrong", "_want", "n_good", "n_bad").orderBy(order).limit(most)


def interleave(rows: DataFrame, source: str, order: Column, buckets: int = 256) -> DataFrame:
    """turn (within the source) and position (from 0) of every row when sources take turns, each in its own order; a source that has run out is passed over.

    Turns come from ranges of the order's hash with their counts; a position is a sum over sources of what they have up to
    that turn, and sources are few: no window holds a source or the whole.
    """
    slot = F.pmod(F.conv(F.substring(order, 1, 4), 16, 10).cast("int"), F.lit(65_536))
    marked = rows.withColumn("_o", order).withColumn("_b", F.floor(slot * buckets / 65_536).cast("int"))
    sizes = marked.groupBy(source, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(source).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    turned = marked.join(F.broadcast(before), [source, "_b"]).withColumn("turn", (F.col("_before") + F.row_number().over(W.partitionBy(source, "_b").orderBy("_o"))).cast("int"))
    totals = sizes.groupBy(source).agg(F.sum("_n").alias("n")).agg(F.collect_list(F.struct(F.col(source).alias("s"), "n")).alias("_all"))
    ahead = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], F.col("turn") - 1 + (x["s"] < F.col(source)).cast("int")))
    return turned.crossJoin(F.broadcast(totals)).withColumn("position", ahead).drop("_o", "_b", "_before", "_all")


def terminal_cap(n_other: Column, share: float) -> Column:
    """Most terminal rows so that they are at most share of all; at least one."""
    return F.greatest(F.floor(n_other * share / (1 - share)), F.lit(1))


def checked(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the first broken one as reason."""
    marked = rows.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def strict(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows, whose reading fails at the first row that breaks a rule."""
    return rows.where(F.coalesce(F.assert_true(first_reason(rules).isNull(), F.concat(F.lit("broken rule: "), first_reason(rules))).isNull(), F.lit(True)))


def joined(left: DataFrame, right: DataFrame, key: str, skip_missing: bool = False) -> DataFrame:
    """left with right's columns by key; a row of left without one fails the reading, or is left out with skip_missing."""
    if skip_missing:
        return left.join(right, key)
    out = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return out.withColumn(key, F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_there")


def once(rows: DataFrame, key: str) -> DataFrame:
    """rows, whose reading fails at a key that stands twice."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return rows.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit(f"repeated {key} "), F.col(key).cast("string")))).otherwise(F.col(key)))


def changed(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """shared: keys that both have; changed: those of them with another value."""
    both = now.select(key, F.col(value).alias("_a")).join(before.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def contrastive(mode: str, confidence_min: float = 0.0, parseable_min: float = 0.0, delta_min: float = 0.0, z_min: float = 0.0, weight_min: float = 0.0, need_gate: bool = False) -> Column:
    """Whether a row (confidence, parseable, delta_q, z_delta, weight, gate) is let through, by mode."""
    label = (F.col("delta_q") >= delta_min) & (F.col("z_delta") >= z_min) & (F.col("weight") >= weight_min)
    label = label & F.col("gate") if need_gate else label
    sure, parsed = F.col("confidence") >= confidence_min, F.col("parseable") >= parseable_min
    rules = {"none": F.lit(True), "confidence": sure, "parseable": parsed, "confidence_parseable": sure & parsed, "label_quality": label, "confidence_parseable_label": sure & parsed & label}
    if mode not in rules:
        raise ValueError(f"unknown filter {mode}")
    return rules[mode]


def in_band(gap: Column, low: float, high: float) -> Column:
    """Whether a score gap is in the band, ends included; a band from -1 to 1 lets all pass."""
    return F.lit(True) if low <= -1.0 and high >= 1.0 else gap.between(low, high)


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """split of each stratum in a hash order of the key: validation, test, train.

    Strata of six or more give the rounded (half to even) shares, one row each at least, or a quarter each where these
    would leave nothing; of three to five one to validation, of four or more one to test; smaller ones are for training.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    r = ranked(rows, stratum, [order], hash_slot(order))
    k = F.col("_all")
    part = lambda x: F.greatest(F.lit(1), F.bround(k * x))
    all_gone = part(validation) + part(test) >= k
    quarter = F.greatest(F.lit(1), F.floor(k / 4))
    n_val = F.when(k >= 6, F.when(all_gone, quarter).otherwise(part(validation))).when(k >= 3, 1).otherwise(0)
    n_test = F.when(k >= 6, F.when(all_gone, quarter).otherwise(part(test))).when(k >= 4, 1).otherwise(0)
    return r.withColumn("split", F.when(F.col("_n") <= n_val, "validation").when(F.col("_n") <= n_val + n_test, "test").otherwise("train")).drop("_n", "_all")


def with_inputs(pairs: DataFrame) -> DataFrame:
    """pairs with the whole texts that a model sees: prompt and answer."""
    return pairs.withColumns({"chosen_input": F.concat("prompt_text", "chosen_text"), "rejected_input": F.concat("prompt_text", "rejected_text")})


def tagged(pairs: DataFrame, label: str, weight: float) -> DataFrame:
    """pairs of one artifact of a mix: ids behind the label, source_label, and source_weight (1 if there is none) times the mix's weight."""
    return pairs.withColumns({"pair_id": F.concat(F.lit(f"{label}::"), F.col("pair_id")), "source_label": F.lit(label), "source_weight": F.coalesce("source_weight", F.lit(1.0)) * weight})


def variant_name(dataset: Column, config: Column, task: Column, subset: Column) -> Column:
    d = F.lower(dataset)
    named = lambda kind, c, default: F.concat(F.lit(f"{kind}-"), F.coalesce(c, F.lit(default)))
    return F.when(d == "gsm8k", named("config", config, "main")).when(d.isin("bbh", "bigbench_hard"), named("task", task, "unknown")).when(d == "hendrycks_math", named("subset", subset, "unknown")).otherwise("default")


def curated(pairs: DataFrame, components: list[tuple[str, list[str], float, float]], total: int, profile: str) -> DataFrame:
    """A profile's rows: of each component (name, kinds, fraction of total, weight) the first by hash, as many as largest remainders give it; tagged with profile, component and weight."""
    exact = {name: total * share for name, _, share, _ in components}
    quotas = {name: math.floor(x + 1e-9) for name, x in exact.items()}
    by_rest = sorted(exact, key=lambda name: (-round(exact[name] - quotas[name], 9), name))
    for name in by_rest[: total - sum(quotas.values())]:
        quotas[name] += 1
    out = None
    for name, kinds, _, weight in components:
        if quotas[name] <= 0:
            continue
        one = hash_sample(pairs.where(F.col("pair_semantics").isin(*kinds)), "pair_id", quotas[name], name)
        one = one.withColumns({"pair_id": F.concat(F.lit(f"{profile}::"), F.col("pair_id")), "profile": F.lit(profile), "component": F.lit(name), "semantic_weight": F.lit(float(weight))})
        out = one if out is None else out.unionByName(one)
    return out


def relabelled(retained: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Rows that were not given to the judge and those that it kept, marked; a key in both fails the reading."""
    mark = lambda rows, kept: rows.withColumns({"judge_selected": F.lit(kept), "judge_kept": F.lit(kept)})
    return once(mark(retained, False).unionByName(mark(judged, True)), key)


def teacher_inputs(rows: DataFrame, system: str, separator: str) -> DataFrame:
    """rows (question, prompt_text, steps) with input_text, or the error that keeps a row out; a blank question falls back to the prompt."""
    blank = F.length(F.trim(F.coalesce("question", F.lit("")))) == 0
    question = F.when(blank, F.nullif(F.trim("prompt_text"), F.lit(""))).otherwise(F.trim("question"))
    error = first_reason([("missing_question", F.col("_q").isNotNull()), ("missing_steps", F.coalesce(F.size("steps") > 0, F.lit(False)))])
    asked = rows.withColumn("_q", question)
    text = F.concat(F.lit(f"{system}\n"), F.col("_q"), F.lit("\n"), F.array_join(F.transform("steps", lambda s: F.concat(s, F.lit(separator))), ""))
    return asked.withColumn("error", error).withColumns({"input_text": F.when(F.col("error").isNull(), text), "question_fallback": F.col("error").isNull() & blank}).drop("_q")


def finite_rows(rows: DataFrame, vectors: list[str], policy: str = "drop") -> DataFrame:
    """Rows whose vectors are all finite; with error the reading fails at the first other row."""
    ok = F.lit(True)
    for v in vectors:
        ok = ok & F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    if policy == "drop":
        return rows.where(ok)
    if policy != "error":
        raise ValueError(f"unknown policy {policy}")
    first = rows.columns[0]
    return rows.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.concat(F.lit("non-finite vectors of "), F.col(first).cast("string")))))
