"""Accuracy, calibration, rollout, trust-curve and gate aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bce_with_logits, beta_rate, clip, share
from .curation import range_slot, ranked
from .reports import quantiles


def accuracy_report(rows: DataFrame, correct: Column, failed: Column, by: str) -> DataFrame:
    """Counts and rates by group and over all (group null), in one pass of grouping sets."""
    base = rows.select(F.col(by).alias("grp"), correct.alias("ok"), failed.alias("bad"))
    sums = base.rollup("grp").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("ok")).alias("n_correct"), F.count_if(F.col("bad")).alias("n_parse_error"), F.count_if(F.col("ok") & ~F.col("bad")).alias("_ok_parsed"), F.grouping_id().alias("_all"))
    parsed = F.col("n_total") - F.col("n_parse_error")
    return sums.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("grp")).alias(by), "n_total", "n_correct", "n_parse_error", parsed.alias("n_parseable"), share(F.col("n_correct"), F.col("n_total")).alias("accuracy"), share(F.col("n_parse_error"), F.col("n_total")).alias("parse_error_rate"), share(F.col("_ok_parsed"), parsed).alias("accuracy_parseable"))


def counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """dimension, value, n of each key's values (null: unspecified), by grouping sets: one shuffle for all keys."""
    named = rows.select(*(F.coalesce(F.col(k).cast("string"), F.lit("unspecified")).alias(k) for k in keys))
    long = named.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in keys))).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def rollout_targets(rollouts: DataFrame, key: str = "prefix_id") -> DataFrame:
    sums = rollouts.groupBy(key).agg(F.count(F.lit(1)).alias("k_rollouts"), F.count_if("is_correct").alias("n_correct"), F.count_if("parse_error").alias("n_parse_error"), F.avg("chars").alias("mean_chars"))
    b = beta_rate(F.col("n_correct"), F.col("k_rollouts"))
    rates = sums.withColumns({"success_rate": share(F.col("n_correct"), F.col("k_rollouts")), "parseable_rate": 1 - share(F.col("n_parse_error"), F.col("k_rollouts")), "b": b})
    return rates.select(key, "k_rollouts", "n_correct", "n_parse_error", "mean_chars", "success_rate", "parseable_rate", F.col("b.q").alias("q"), F.col("b.se").alias("se"), F.col("b.low").alias("ci_low"), F.col("b.high").alias("ci_high"), F.col("b.width").alias("ci_width"), F.col("b.weight").alias("weight"))


def pair_quality(q1: Column, se1: Column, w1: Column, q2: Column, se2: Column, w2: Column, min_delta: float = 0.1, min_z: float = 1.0, boost: float = 1.0, fail: float = 0.5) -> Column:
    """struct<delta_q, se_delta, z_delta, gate, weight> of a clean and a corrupted prefix."""
    delta, se = q1 - q2, F.sqrt(se1 * se1 + se2 * se2)
    z = delta / F.greatest(se, F.lit(1e-8))
    gate = (delta >= min_delta) & (z >= min_z)
    weight = clip((0.5 * clip(delta) + 0.5 * clip(z / 5)) * F.sqrt(w1 * w2) * F.when(gate, boost).otherwise(fail))
    return F.struct(delta.alias("delta_q"), se.alias("se_delta"), z.alias("z_delta"), gate.alias("gate"), weight.alias("weight"))


def fuse(mc: Column, teacher: Column, ci_width: Column, ci_reference: float | None = None, lam: float = 0.5) -> Column:
    """Mix of rollout and teacher value: a fixed share, or one by confidence; the rollout value alone without a teacher."""
    x = clip(1 - ci_width / ci_reference) if ci_reference else F.lit(lam)
    return F.when(teacher.isNull(), mc).otherwise(x * mc + (1 - x) * teacher)


def calibration(rows: DataFrame, p: str, y: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Brier, RMSE, MAE, Pearson (0 if degenerate), expected calibration error, and the Brier score of the mean."""
    by = by or []
    b = rows.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    d = F.col(p) - F.col(y)
    part = b.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(d * d).alias("sq"), F.sum(F.abs(d)).alias("sa"), F.sum(F.col(p) * F.col(p)).alias("spp"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(p) * F.col(y)).alias("spy"))
    s = part.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "sp", "sy", "sq", "sa", "spp", "syy", "spy")), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    n = F.col("n")
    cov, vp, vy = (F.col(c) / n - F.col(a) * F.col(b2) / n / n for c, a, b2 in (("spy", "sp", "sy"), ("spp", "sp", "sp"), ("syy", "sy", "sy")))
    base = F.greatest(vy, F.lit(0.0))
    corr = F.when((vp > 1e-15) & (vy > 1e-15), cov / F.sqrt(vp * vy)).otherwise(0.0)
    brier = F.col("sq") / n
    return s.select(*by, "n", brier.alias("brier"), F.sqrt(brier).alias("rmse"), (F.col("sa") / n).alias("mae"), corr.alias("pearson"), (F.col("gap") / n).alias("ece"), base.alias("base_brier"), (base - brier).alias("brier_gain"))


def margin_summary(rows: DataFrame, margin: str, by: list[str]) -> DataFrame:
    """Per group of margins (from -1 to 1): count, share above 0, share at 0 or above, mean and median."""
    m = F.col(margin)
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((m > 0).cast("double")).alias("pair_accuracy"), F.avg((m >= 0).cast("double")).alias("with_ties"), F.avg(m).alias("mean_margin"))
    return s.join(quantiles(rows, by, margin, {"median_margin": 0.5}, -1.0, 1.0), by)


def isotonic_blocks(rows: DataFrame, score: str, target: str, weight: str | None = None) -> DataFrame:
    """Pool-adjacent-violators fit: right edge and value of each block, in order.

    Counts by distinct score are sorted and pooled in ranges of the score first (a pooled block never needs to be split
    again, so pooling pooled ranges is exact), then over all ranges; only blocks reach the last task.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    points = rows.groupBy(F.col(score).alias("x")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).alias("s"))
    schema = "x double, w double, s double"

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list[float]] = []
        for pdf in batches:
            for x, wt, s in pdf[["x", "w", "s"]].itertuples(index=False):
                stack.append([x, wt, s])
                while len(stack) > 1 and stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]:
                    x2, w2, s2 = stack.pop()
                    stack[-1] = [x2, stack[-1][1] + w2, stack[-1][2] + s2]
        yield pd.DataFrame(stack, columns=["x", "w", "s"])

    ranges = points.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(pool, schema)
    blocks = ranges.repartition(1).sortWithinPartitions("x").mapInPandas(pool, schema)
    return blocks.select(F.col("x").alias("right_edge"), clip(F.col("s") / F.col("w")).alias("value"), "w")


def apply_isotonic(rows: DataFrame, score: str, edges: list[float], values: list[float]) -> DataFrame:
    """fitted: the value of the first block whose right edge is above the score (an edge belongs to the next block), the last one beyond."""
    e, v = F.array(*map(F.lit, edges)), F.array(*map(F.lit, values))
    place = F.least(F.size(F.filter(e, lambda x: x <= F.col(score))), F.lit(len(values) - 1))
    return rows.withColumn("fitted", F.get(v, place))


def utility(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per candidate: weighted wins over the weight of all its comparisons. edges: chosen, rejected."""
    w = weight if weight is not None else F.lit(1.0)
    sides = edges.select(F.explode(F.array(F.struct(F.col("chosen").alias("candidate"), w.alias("won"), w.alias("all")), F.struct(F.col("rejected").alias("candidate"), F.lit(0.0).alias("won"), w.alias("all")))).alias("x")).select("x.*")
    return sides.groupBy("candidate").agg(share(F.sum("won"), F.sum("all"), 0.5).alias("utility"), F.count(F.lit(1)).alias("degree"))


def top_by_pool(rows: DataFrame, pool: str, score: str, gold: str, key: str) -> DataFrame:
    """Per pool of two candidates or more the chosen one (score, then id, descending), its regret and the gap to the second."""
    w = W.partitionBy(pool).orderBy(F.desc(score), F.desc(key))
    r = rows.withColumns({"_n": F.row_number().over(w), "_next": F.lead(score).over(w), "_best": F.max(gold).over(W.partitionBy(pool)), "n": F.count(F.lit(1)).over(W.partitionBy(pool))})
    return r.where("_n = 1 and n > 1").select(pool, key, "n", (F.col(gold) == F.col("_best")).alias("top1"), (F.col("_best") - F.col(gold)).alias("regret"), F.coalesce(F.col(score) - F.col("_next"), F.lit(0.0)).alias("gap"))


def coverage_curve(pools: DataFrame, key: str, coverages: list[float], most_gap: float = 1.0) -> DataFrame:
    """Accuracy and regret of the pools with the largest gaps (then keys), max(1, round(coverage x all)) of them at each coverage. Gaps are from 0 to most_gap."""
    r = ranked(pools.withColumn("_one", F.lit(0)), "_one", [F.desc("gap"), F.desc(key)], range_slot(F.col("gap"), 0.0, most_gap, falling=True))
    at = F.explode(F.array(*(F.lit(c) for c in coverages)))
    kept = r.withColumn("coverage", at).where(F.col("_n") <= F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("_all"))))
    return kept.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max("_all")).alias("actual_coverage"), F.min("gap").alias("threshold"), F.avg(F.col("top1").cast("double")).alias("accuracy"), F.avg("regret").alias("mean_regret"))


def pressure_curve(rows: DataFrame, pool: str, key: str, score: str, gold: str, sizes: list[int], repeats: int = 4) -> DataFrame:
    """Per subset size: subsets (one of each pool that is large enough, for each repeat, by hash of repeat and key), hit rate and mean regret of the top score."""
    each = rows.select(pool, F.col(key).alias("_k"), F.col(score).alias("_s"), F.col(gold).alias("_g"), F.count(F.lit(1)).over(W.partitionBy(pool)).alias("_c"))
    each = each.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.sha2(F.concat(F.col("_r").cast("string"), F.lit(":"), F.col("_k").cast("string")), 256)
    n = F.row_number().over(W.partitionBy(pool, "_r").orderBy(order))
    top = each.withColumn("_n", n).where(F.col("_n") <= max(sizes))
    inside = lambda s: F.col("_n") <= s
    one = top.groupBy(pool, "_r").agg(F.max("_c").alias("_c"), *(F.max_by("_g", F.when(inside(s), F.struct("_s", "_k"))).alias(f"p{s}") for s in sizes), *(F.max(F.when(inside(s), F.col("_g"))).alias(f"b{s}") for s in sizes))
    long = one.select("_c", F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"p{s}").alias("p"), F.col(f"b{s}").alias("b")) for s in sizes))).alias("x")).select("_c", "x.*").where("_c >= size")
    regret = F.col("b") - F.col("p")
    return long.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(regret) <= 1e-9).cast("double")).alias("accuracy"), F.avg(regret).alias("mean_regret"))


def local_trust(nodes: DataFrame, pool: str) -> DataFrame:
    """Per pool with a bad candidate: the first bad step, and how the scores of its safe and bad candidates stand.

    nodes: pool, id, score, max_safe and min_bad (steps at which a candidate is the better or the worse side of pairs, null
    if never). Safe ones are safe before the first bad step only. Pairs of safe and bad ones are counted in score order.
    """
    w = W.partitionBy(pool)
    first = nodes.withColumn("first_bad", F.min("min_bad").over(w)).where("first_bad is not null")
    safe, bad = F.col("max_safe") < F.col("first_bad"), F.col("min_bad") >= F.col("first_bad")
    m = first.withColumns({"_safe": F.coalesce(safe, F.lit(False)), "_bad": F.coalesce(bad, F.lit(False))})
    m = m.withColumn("_edge", F.max(F.when(F.col("_safe"), F.col("max_safe"))).over(w)).where("_edge is not null")
    m = m.withColumns({"_last": F.col("_safe") & (F.col("max_safe") == F.col("_edge")), "_at": F.coalesce(F.col("min_bad") == F.col("first_bad"), F.lit(False))})
    up = w.orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    above = lambda c: F.sum(F.col(c).cast("long")).over(up) - F.sum(F.col(c).cast("long")).over(W.partitionBy(pool, "score"))
    m = m.withColumns({"_above": above("_safe"), "_above_last": above("_last")})
    n = lambda c: F.sum(F.col(c).cast("long"))
    return m.groupBy(pool).agg(F.max("first_bad").alias("first_bad"), F.max_by("_last", F.struct("score", "id")).alias("last_safe_on_top"), (n("_last") * n("_at")).alias("edges"), F.sum(F.when(F.col("_at"), F.col("_above_last")).otherwise(0)).alias("edges_right"), (n("_safe") * n("_bad")).alias("pairs"), F.sum(F.when(F.col("_bad"), F.col("_above")).otherwise(0)).alias("pairs_right"))


def judge_report(rows: DataFrame) -> DataFrame:
    """One row from rows (label, n_steps, parsed, overall, first_bad from 1, null: none): parse rate, accuracies and mean step accuracy.

    A judge that names no steps calls all before its first bad one correct and the others not.
    """
    err = F.col("label") >= 0
    want = F.when(err, F.col("label") + 1)
    ok = F.coalesce(F.col("parsed"), F.lit(False))
    exact = ok & F.col("first_bad").eqNullSafe(want)
    near = ok & F.coalesce(F.abs(F.col("first_bad") - want) <= 1, F.lit(False))
    beyond = F.col("n_steps") + 1
    said, true = F.when(F.col("first_bad").isNull(), beyond).otherwise(F.least(F.greatest(F.col("first_bad"), F.lit(1)), beyond)), F.coalesce(want, beyond)
    steps = F.when(ok, (F.col("n_steps") - F.abs(said - true)) / F.greatest(F.col("n_steps"), F.lit(1))).otherwise(0.0)
    rate = lambda c: F.avg(c.cast("double"))
    among = lambda c: share(F.count_if(c & err), F.greatest(F.count_if(err), F.lit(1)))
    return rows.agg(F.count(F.lit(1)).alias("n"), rate(ok).alias("parse_ok_rate"), rate(ok & F.coalesce(F.col("overall") == F.when(err, "incorrect").otherwise("correct"), F.lit(False))).alias("overall_acc"), among(exact).alias("first_bad_exact"), among(near).alias("first_bad_near"), F.avg(steps).alias("mean_step_acc"))


def best_of_n(rows: DataFrame, question: str, sample: str, score: str, correct: str) -> DataFrame:
    """One row: accuracy of the first sample, of one by hash, of the best scored (the first of equals) and of any."""
    ok = F.col(correct).cast("int")
    random = F.sha2(F.concat(F.lit("random:"), F.col(question).cast("string"), F.lit(":"), F.col(sample).cast("string")), 256)
    q = rows.groupBy(question).agg(F.min_by(ok, sample).alias("g"), F.min_by(ok, random).alias("r"), F.min_by(ok, F.struct(-F.col(score), F.col(sample))).alias("p"), F.max(ok).alias("o"))
    return q.agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("greedy"), F.avg("r").alias("random"), F.avg("p").alias("reranked"), F.avg("o").alias("oracle"))


def majority(votes: DataFrame, by: str, vote: str, valid: list[str]) -> DataFrame:
    """The vote with the most valid voices; tie if several have them, parse_error without a valid one."""
    c = votes.groupBy(by).agg(*(F.count_if(F.col(vote) == v).alias(f"_{v}") for v in valid))
    most = F.greatest(*(F.col(f"_{v}") for v in valid)) if len(valid) > 1 else F.col(f"_{valid[0]}")
    winners = F.filter(F.array(*(F.when(F.col(f"_{v}") == most, v) for v in valid)), lambda x: x.isNotNull())
    return c.select(by, F.when(most == 0, "parse_error").when(F.size(winners) > 1, "tie").otherwise(F.get(winners, F.lit(0))).alias("verdict"), most.alias("voices"))


def gate(row: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reasons: names of the failed checks in order; passed: there are none."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks)))
    return row.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0)


def consensus_pairs(mapping: DataFrame, clean: DataFrame, corrupt: DataFrame, teacher_clean: DataFrame, teacher_corrupt: DataFrame, min_delta: float = 0.02, min_z: float = 0.2, teacher_margin: float = 0.1, need_teacher: bool = False) -> DataFrame:
    """mapping (u, corrupt) with the differences of its two sides, and the gate with the teacher's consent where it knows both.

    Pairs without either side are left out. clean: u, q, se, weight; corrupt: also corrupt; teacher tables: u, tq or tc.
    """
    side = lambda df, n: df.select(*(F.col(c).alias(f"{c}{n}") if c in ("q", "se", "weight") else F.col(c) for c in df.columns))
    p = mapping.join(side(clean, 1), "u").join(side(corrupt, 2), ["u", "corrupt"]).join(teacher_clean, "u", "left").join(teacher_corrupt, "u", "left")
    delta, z = F.col("q1") - F.col("q2"), (F.col("q1") - F.col("q2")) / F.greatest(F.sqrt(F.col("se1") * F.col("se1") + F.col("se2") * F.col("se2")), F.lit(1e-8))
    p = p.withColumns({"delta_q": delta, "z_delta": z, "teacher_available": F.col("tq").isNotNull() & F.col("tc").isNotNull(), "_d": F.col("tq") - F.col("tc")})
    p = p.withColumn("gate_mc", (F.col("delta_q") >= min_delta) & (F.col("z_delta") >= min_z))
    agreed = F.col("gate_mc") & (F.col("_d") >= teacher_margin) & ((F.col("delta_q") >= 0) == (F.col("_d") >= 0))
    return p.withColumn("gate", F.when(F.col("teacher_available"), agreed).otherwise(F.lit(False) if need_teacher else F.col("gate_mc")))


def teacher_join_report(targets: DataFrame, teacher: DataFrame, lam: float = 0.5, disagree: float = 0.3) -> DataFrame:
    """One row: how many targets (id, q) have a teacher (id, teacher), how many teachers have no target, coverage, disagreement and means."""
    j = targets.join(teacher.withColumn("teacher", clip(F.col("teacher"))), "id", "left")
    extra = teacher.join(targets, "id", "left_anti").agg(F.count(F.lit(1)).alias("num_extra"))
    n = F.count("teacher")
    s = j.agg(F.count(F.lit(1)).alias("num_targets"), n.alias("num_joined"), share(n, F.count(F.lit(1))).alias("coverage"), share(F.count_if(F.abs(F.col("q") - F.col("teacher")) >= disagree), n).alias("disagree_ratio"), F.avg("q").alias("mean_q_mc"), F.avg("teacher").alias("mean_q_teacher"), F.avg(lam * F.col("q") + (1 - lam) * F.col("teacher")).alias("mean_q_fused"))
    return s.crossJoin(extra)


def instability(rows: DataFrame, by: str) -> DataFrame:
    """Per group of replies (tags: array of yes and no, is_correct, parse_error): counts and rates of answers that change within a reply."""
    n = F.size("tags")
    switches = F.size(F.filter(F.transform("tags", lambda x, i: (i > 0) & ~x.eqNullSafe(F.get(F.col("tags"), i - 1))), lambda x: x))
    apart = (n > 1) & (F.get("tags", F.lit(0)) != F.try_element_at("tags", F.lit(-1)))
    x = rows.select(by, n.alias("n"), switches.alias("s"), F.coalesce(apart, F.lit(False)).alias("d"), "is_correct", "parse_error")
    total, tagged = F.count(F.lit(1)), F.greatest(F.count_if(F.col("n") > 0), F.lit(1))
    counts = {"n_correct": F.col("is_correct"), "n_parse_error": F.col("parse_error"), "n_with_final_tag": F.col("n") > 0, "n_multi_final_tag": F.col("n") > 1, "n_first_last_disagree": F.col("d"), "n_with_tag_switch": F.col("s") > 0}
    rates = {"accuracy": "n_correct", "parse_error_rate": "n_parse_error", "with_final_tag_rate": "n_with_final_tag", "multi_final_tag_rate": "n_multi_final_tag", "first_last_disagree_rate": "n_first_last_disagree", "tag_switch_rate": "n_with_tag_switch"}
    return x.groupBy(by).agg(total.alias("n_total"), *(F.count_if(c).alias(k) for k, c in counts.items()), *(share(F.count_if(counts[c]), total).alias(k) for k, c in rates.items()), F.avg("n").alias("mean_tags_all"), (F.sum("n") / tagged).alias("mean_tags_tagged"), (F.sum("s") / tagged).alias("mean_switches_tagged"))


def target_summary(targets: DataFrame, by: str) -> DataFrame:
    """Per by: number of rollout targets and means of their rates, weights, interval widths and lengths."""
    return targets.groupBy(by).agg(F.count(F.lit(1)).alias("num_targets"), F.avg("success_rate").alias("mean_success_rate"), F.avg("parseable_rate").alias("mean_parseable_rate"), F.avg("weight").alias("mean_weight"), F.avg("ci_width").alias("mean_ci_width"), F.avg("mean_chars").alias("mean_chars"))


def before_after(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """One row over all labels that both have: counts summed first, then rates and their differences. A label of two totals fails the reading."""
    names = ["n_total", "n_correct", "n_parse_error", "n_correct_parseable"]
    side = lambda df, s: df.select(label, *(F.col(n).alias(f"{s}_{n}") for n in names))
    both = side(before, "b").join(side(after, "a"), label)
    total = F.when(F.col("b_n_total") == F.col("a_n_total"), F.col("b_n_total")).otherwise(F.raise_error(F.concat(F.lit("mismatched totals of "), F.col(label))).cast("long"))
    s = both.agg(F.sum(total).alias("n_total"), *(F.sum(f"{x}_{n}").alias(f"{x}_{n}") for x in "ba" for n in names[1:]))
    n = F.col("n_total")
    parsed = lambda x: share(F.col(f"{x}_n_correct_parseable"), n - F.col(f"{x}_n_parse_error"))
    return s.select("n_total", (F.col("a_n_correct") - F.col("b_n_correct")).alias("delta_n_correct"), share(F.col("b_n_correct"), n).alias("before_accuracy"), share(F.col("a_n_correct"), n).alias("after_accuracy"), share(F.col("a_n_correct") - F.col("b_n_correct"), n).alias("delta_accuracy"), share(F.col("a_n_parse_error") - F.col("b_n_parse_error"), n).alias("delta_parse_error_rate"), (parsed("a") - parsed("b")).alias("delta_accuracy_parseable"))


def fit_temperature(rows: DataFrame, logit: str, target: str, low: float, high: float, points: int) -> DataFrame:
    """One row: the temperature of an even grid whose mean cross-entropy of logit / temperature is smallest (the lowest of equals), and that loss. All points are sums of one pass."""
    grid = [low + (high - low) * k / (points - 1) for k in range(points)]
    losses = rows.agg(*(F.avg(bce_with_logits(F.col(logit) / t, F.col(target))).alias(f"l{k}") for k, t in enumerate(grid)))
    best = F.array_min(F.array(*(F.struct(F.round(F.col(f"l{k}"), 12).alias("r"), F.lit(t).alias("temperature"), F.col(f"l{k}").alias("loss")) for k, t in enumerate(grid))))
    return losses.select(best.alias("b")).select("b.temperature", "b.loss")
