"""Score traces: rows (example, step, score) with an example's label (first bad step, -1 if all are good).

Every operator is a window or aggregate by example, so its only shuffle is by example. Pair counts come from running
counts in score order, never from pairs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import harmonic, share

EX, STEP, SCORE, LABEL = "example_id", "step", "score", "label"


def with_goodness(rows: DataFrame) -> DataFrame:
    """is_good: before the first bad step; is_first_bad."""
    return rows.withColumns({"is_good": (F.col(LABEL) < 0) | (F.col(STEP) < F.col(LABEL)), "is_first_bad": F.col(STEP) == F.col(LABEL)})


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per example: good x bad pairs and those with the good score strictly above."""
    g = with_goodness(rows)
    by_score = W.partitionBy(EX).orderBy(F.col(SCORE).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    good = F.col("is_good").cast("long")
    counted = g.withColumn("above", F.sum(good).over(by_score) - F.sum(good).over(W.partitionBy(EX, SCORE)))
    bad = ~F.col("is_good")
    return counted.groupBy(EX).agg((F.sum(good) * F.sum(bad.cast("long"))).alias("pairs"), F.sum(F.when(bad, F.col("above")).otherwise(0)).alias("right"))


def edges(rows: DataFrame) -> DataFrame:
    """One row for each example with label > 0: its last good and first bad score."""
    before = F.lag(SCORE).over(W.partitionBy(EX).orderBy(STEP))
    return rows.withColumn("safe", before).where((F.col(STEP) == F.col(LABEL)) & (F.col(LABEL) > 0) & F.col("safe").isNotNull()).select(EX, "safe", F.col(SCORE).alias("bad"))


def auc(rows: DataFrame, positive: Column, score: str = SCORE, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """Area under the curve by tie-averaged ranks; 0.5 with one class only. Columns: by, n_pos, n_neg, auc.

    Counts are compressed by distinct score, then summed in two levels (ranges of the score, and inside a range), so a
    single group is not one task.
    """
    by = by or []
    flat = rows.select(*by, F.col(score).alias("_s"), positive.cast("long").alias("_y"))
    by_value = flat.groupBy(*by, "_s").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    span = flat.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    placed = by_value.crossJoin(F.broadcast(span)).withColumn("_b", F.when(wide > 0, F.least(F.floor((F.col("_s") - F.col("_lo")) / wide * buckets), F.lit(buckets - 1))).otherwise(0).cast("int"))
    sums = placed.groupBy(*by, "_b").agg(F.sum("neg").alias("n"))
    below = sums.withColumn("_below", F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("neg").over(W.partitionBy(*by, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = placed.join(below, [*by, "_b"]).withColumn("_won", F.col("pos") * (F.col("_below") + inside + F.col("neg") / 2))
    out = won.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("_won").alias("_won"))
    return out.select(*by, "n_pos", "n_neg", share(F.col("_won"), F.col("n_pos") * F.col("n_neg"), 0.5).alias("auc"))


def hit_bounds(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each example: it is judged right by every threshold above ``low`` (null: by all) and up to ``high`` (null: by all).

    The first step below a threshold is the label exactly if the label's score is below it and all before are not; an
    all-good example is right if none is below.
    """
    early = (F.col(LABEL) < 0) | (F.col(STEP) < F.col(LABEL))
    return rows.groupBy(*(by or []), EX).agg(F.max(LABEL).alias(LABEL), F.min(F.when(F.col(STEP) == F.col(LABEL), F.col(SCORE))).alias("low"), F.min(F.when(early, F.col(SCORE))).alias("high"))


def f1_of_bounds(bounds: DataFrame, thresholds: DataFrame, by: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Per threshold (and group): accuracy on erroneous and on all-good examples and their harmonic mean. thresholds: a grid (threshold), of each ``on`` if given."""
    by = by or []
    each = bounds.join(F.broadcast(thresholds), on) if on else bounds.crossJoin(F.broadcast(thresholds))
    wrong = F.col(LABEL) >= 0
    hit = F.coalesce(F.col("threshold") <= F.col("high"), F.lit(True)) & (~wrong | F.coalesce(F.col("low") < F.col("threshold"), F.lit(False)))
    sums = each.groupBy(*by, "threshold").agg(F.count_if(wrong).alias("n_err"), F.count_if(~wrong).alias("n_cor"), F.count_if(wrong & hit).alias("hit_err"), F.count_if(~wrong & hit).alias("hit_cor"))
    return sums.withColumns({"acc_err": share(F.col("hit_err"), F.col("n_err")), "acc_cor": share(F.col("hit_cor"), F.col("n_cor"))}).withColumn("f1", harmonic(F.col("acc_err"), F.col("acc_cor"))).select(*by, "threshold", "n_err", "n_cor", "acc_err", "acc_cor", "f1")


def f1_by_threshold(rows: DataFrame, thresholds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """f1_of_bounds of scored rows: a row for each example, not for each step, meets the grid."""
    return f1_of_bounds(hit_bounds(rows, by), thresholds, by)


def fixed_grid(spark, low: float, high: float, step: float) -> DataFrame:
    """Thresholds from low to high, both included."""
    n = int(round((high - low) / step))
    return spark.range(n + 1).select((F.lit(low) + F.col("id") * step).alias("threshold"))


def threshold_shift(rows: DataFrame, grid: DataFrame, fixed: float, ratio: float = 0.95) -> DataFrame:
    """One row: the best threshold (ties: nearest to the fixed one) and its f1, the fixed one's f1, and the window of thresholds whose f1 is at least ratio x best."""
    bounds = hit_bounds(rows)
    sweep = f1_of_bounds(bounds, grid)
    top = best(sweep, "f1", F.abs(F.col("threshold") - fixed)).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"), F.col("acc_cor").alias("best_acc_correct"), F.col("acc_err").alias("best_acc_erroneous"))
    own = f1_of_bounds(bounds, rows.sparkSession.range(1).select(F.lit(float(fixed)).alias("threshold"))).select(F.col("f1").alias("fixed_f1"))
    near = sweep.crossJoin(F.broadcast(top)).where(F.col("f1") >= F.col("best_f1") * ratio).agg(F.min("threshold").alias("window_min"), F.max("threshold").alias("window_max"))
    return top.crossJoin(own).crossJoin(near).withColumn("window_width", F.col("window_max") - F.col("window_min"))


def group_thresholds(rows: DataFrame, by: str, points: int, fixed: float, least: int = 1) -> DataFrame:
    """Per group of ``least`` examples or more: its own best threshold and f1 on its observed grid, the fixed one's f1, and the f1 by the best threshold of all other groups."""
    spark = rows.sparkSession
    bounds = hit_bounds(rows, [by])
    own = best(f1_of_bounds(bounds, observed_grid(rows, points, [by]).drop("i"), [by], [by]), "f1", F.col("threshold"), by=[by]).select(by, (F.col("n_err") + F.col("n_cor")).alias("n_examples"), F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    at_fixed = f1_of_bounds(bounds, spark.range(1).select(F.lit(float(fixed)).alias("threshold")), [by]).select(by, F.col("f1").alias("fixed_f1"))
    span = rows.groupBy(by).agg(F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi"))
    # a row for each pair of groups: groups are few
    others = span.alias("a").join(span.alias("b"), F.col(f"a.{by}") != F.col(f"b.{by}")).groupBy(F.col(f"a.{by}").alias("held")).agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    others = others.withColumns({"lo": F.when(flat, 0.0).otherwise(F.col("lo")), "hi": F.when(flat, 1.0).otherwise(F.col("hi"))})
    grid = others.select("held", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select("held", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("threshold"))
    split = bounds.join(F.broadcast(grid), F.lit(True)).withColumn("own", F.col("held") == F.col(by))
    wrong = F.col(LABEL) >= 0
    hit = F.coalesce(F.col("threshold") <= F.col("high"), F.lit(True)) & (~wrong | F.coalesce(F.col("low") < F.col("threshold"), F.lit(False)))
    sums = split.groupBy("held", "threshold", "own").agg(F.count_if(wrong).alias("ne"), F.count_if(~wrong).alias("nc"), F.count_if(wrong & hit).alias("he"), F.count_if(~wrong & hit).alias("hc"))
    f1 = sums.withColumn("f1", harmonic(share(F.col("he"), F.col("ne")), share(F.col("hc"), F.col("nc")))).select("held", "threshold", "own", "f1")
    picked = best(f1.where("not own"), "f1", F.col("threshold"), by=["held"]).select("held", F.col("threshold").alias("logo_threshold"))
    logo = picked.join(f1.where("own"), (f1["held"] == picked["held"]) & (f1["threshold"] == picked["logo_threshold"])).select(picked["held"].alias(by), "logo_threshold", F.col("f1").alias("logo_f1"))
    return own.where(F.col("n_examples") >= least).join(at_fixed, by).join(logo, by)


def observed_grid(rows: DataFrame, points: int, by: list[str] | None = None) -> DataFrame:
    """points evenly spaced thresholds over the observed scores (over [0, 1] if all are equal)."""
    by = by or []
    span = rows.groupBy(*by).agg(F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.withColumns({"lo": F.when(flat, 0.0).otherwise(F.col("lo")), "hi": F.when(flat, 1.0).otherwise(F.col("hi"))})
    return span.select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("threshold"))


def best(table: DataFrame, metric: str, order: Column, by: list[str] | None = None) -> DataFrame:
    """The row with the largest metric; the first by order among equals."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(metric).desc(), order)
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stops(rows: DataFrame, trigger: Column) -> DataFrame:
    """Per example: n_steps, label and the first step whose trigger holds (-1: none). trigger may read score, drop, step, prev."""
    w = W.partitionBy(EX).orderBy(STEP)
    prev = F.lag(SCORE, 1, 1.0).over(w)
    t = rows.withColumn("prev", prev).withColumn("drop", F.col("prev") - F.col(SCORE))
    return t.groupBy(EX).agg(F.count(F.lit(1)).alias("n_steps"), F.max(LABEL).alias(LABEL), F.coalesce(F.min(F.when(trigger, F.col(STEP))), F.lit(-1)).alias("stop"))


def judged(stopped: DataFrame) -> DataFrame:
    """stopped with right (all good and no stop, or a stop no later than the label) and used (steps that were looked at)."""
    right = F.when(F.col(LABEL) < 0, F.col("stop") < 0).otherwise((F.col("stop") >= 0) & (F.col("stop") <= F.col(LABEL)))
    return stopped.withColumns({"right": right, "used": F.when(F.col("stop") < 0, F.col("n_steps")).otherwise(F.col("stop") + 1)})


def two_strikes(rows: DataFrame, bad: Column, strikes: int = 2) -> DataFrame:
    """Per example the step at which ``strikes`` bad steps in a row are first complete (-1: never)."""
    w = W.partitionBy(EX).orderBy(STEP)
    prev = F.lag(SCORE, 1, 1.0).over(w)
    t = rows.withColumn("prev", prev).withColumn("drop", F.col("prev") - F.col(SCORE)).withColumn("bad", bad)
    t = t.withColumn("run", F.sum((~F.col("bad")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    t = t.withColumn("streak", F.sum(F.col("bad").cast("int")).over(W.partitionBy(EX, "run").orderBy(STEP).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return t.groupBy(EX).agg(F.count(F.lit(1)).alias("n_steps"), F.max(LABEL).alias(LABEL), F.coalesce(F.min(F.when(F.col("streak") >= strikes, F.col(STEP))), F.lit(-1)).alias("stop"))


def confusion(j: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of judged examples: a positive is an example with an error, found if the stop is in time."""
    pos, stop, right = F.col(LABEL) >= 0, F.col("stop") >= 0, F.col("right")
    sums = j.groupBy(*(by or [])).agg(
        F.count_if(pos & right).alias("tp"), F.count_if(~pos & right).alias("tn"), F.count_if(~pos & stop).alias("fp"), F.count_if(pos & ~right).alias("fn"),
        F.avg(F.col("used") / F.col("n_steps")).alias("mean_used"), F.expr("percentile(used / n_steps, 0.5)").alias("median_used"), F.avg((stop & (F.col("used") < F.col("n_steps"))).cast("double")).alias("early_rate"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = sums.withColumns({"acc_err": share(tp, tp + fn), "acc_cor": share(tn, tn + fp), "precision": share(tp, tp + fp), "accuracy": share(tp + tn, tp + tn + fp + fn)})
    return out.withColumns({"balanced_f1": harmonic(F.col("acc_err"), F.col("acc_cor")), "positive_f1": harmonic(F.col("precision"), F.col("acc_err"))})


def history(rows: DataFrame, k: int = 4) -> DataFrame:
    """Features at each step: the last k scores (1.0 before the first), their differences, running mean, min, max, share of steps, share below 0.5."""
    w = W.partitionBy(EX).orderBy(STEP)
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    lags = {f"score_{i}": F.col(SCORE) if i == 0 else F.lag(SCORE, i, 1.0).over(w) for i in range(k)}
    out = rows.withColumns(lags | {"mean_so_far": F.avg(SCORE).over(run), "min_so_far": F.min(SCORE).over(run), "max_so_far": F.max(SCORE).over(run), "low_share": F.avg((F.col(SCORE) < 0.5).cast("double")).over(run), "step_share": F.row_number().over(w) / F.count(F.lit(1)).over(W.partitionBy(EX))})
    return out.withColumns({f"diff_{i}": F.col(f"score_{i}") - F.col(f"score_{i + 1}") for i in range(k - 1)})


def teacher_labels(rows: DataFrame, trigger: Column) -> DataFrame:
    """One row for each step up to and including the stop; action 1 at the stop only."""
    w = W.partitionBy(EX).orderBy(STEP)
    t = rows.withColumn("prev", F.lag(SCORE, 1, 1.0).over(w)).withColumn("drop", F.col("prev") - F.col(SCORE)).withColumn("hit", trigger)
    first = F.min(F.when(F.col("hit"), F.col(STEP))).over(W.partitionBy(EX))
    t = t.withColumn("stop", first).where(F.col("stop").isNull() | (F.col(STEP) <= F.col("stop")))
    return t.select(EX, STEP, SCORE, F.coalesce((F.col(STEP) == F.col("stop")).cast("int"), F.lit(0)).alias("action"))


#: Policy families: a step triggers if its score is below tau, or from min_step on has dropped by more than delta and is below cap; strikes in a row stop.
def policy_grid() -> list[dict]:
    one = lambda family, tau, delta=9.0, min_step=0, cap=9.0, strikes=1: {"family": family, "tau": tau, "delta": delta, "min_step": min_step, "cap": cap, "strikes": strikes}
    taus, deltas = (0.32, 0.35, 0.38, 0.42), (0.15, 0.20, 0.25)
    grid = [one("baseline_immediate", a, d) for a in taus for d in (0.12, 0.15, 0.20)]
    grid += [one("threshold_only", a) for a in (0.28, 0.32, 0.35, 0.38, 0.42, 0.46, 0.50)]
    grid += [one("delayed_drop", a, d, m) for a in taus for d in deltas for m in (2, 3, 4)]
    grid += [one("drop_needs_low", a, d, 0, c) for a in taus for d in deltas for c in (0.45, 0.50, 0.55, 0.60)]
    grid += [one("guarded_drop", a, d, m, c) for a in (0.20, 0.25, 0.30, 0.35) for d in deltas for c in (0.45, 0.50, 0.55) for m in (2, 3, 4)]
    grid += [one("two_strike", a, d, m, strikes=2) for a in (0.35, 0.38, 0.42, 0.46) for d in deltas for m in (1, 2, 3)]
    return [{"policy": k, **p} for k, p in enumerate(grid)]


def policy_sweep(rows: DataFrame, grid: list[dict] | None = None, longest_schedule: int = 6) -> DataFrame:
    """Per policy of the grid, and per fixed schedule (stop behind k steps): confusion counts, balanced f1 and mean share of steps looked at.

    An example's steps are gathered once; every policy reads that array, so the sweep is one shuffle by example and one
    aggregate by policy, not a copy of the rows for each policy.
    """
    grid = grid or policy_grid()
    traces = rows.groupBy(EX).agg(F.max(LABEL).alias(LABEL), F.array_sort(F.collect_list(F.struct(F.col(STEP).cast("int").alias("step"), F.col(SCORE).alias("score")))).alias("t"))
    before = F.transform("t", lambda x, i: F.struct(x["step"].alias("step"), x["score"].alias("score"), (F.when(i == 0, F.lit(1.0)).otherwise(F.get(F.col("t"), i - 1)["score"]) - x["score"]).alias("drop")))
    traces = traces.withColumn("t", before)
    kind = "array<struct<policy:int,tau:double,delta:double,min_step:int,cap:double,strikes:int>>"
    policies = F.from_json(F.lit(json.dumps([{k: p[k] for k in ("policy", "tau", "delta", "min_step", "cap", "strikes")} for p in grid])), kind)

    def stop(p: Column) -> Column:
        bad = F.transform("t", lambda x: (x["score"] < p["tau"]) | ((x["step"] >= p["min_step"]) & (x["drop"] > p["delta"]) & (x["score"] < p["cap"])))
        twice = F.get(F.transform(F.array(bad), lambda b: F.transform(b, lambda x, i: x & ((p["strikes"] == 1) | F.coalesce(F.get(b, i - 1), F.lit(False))))), F.lit(0))
        return F.array_position(twice, F.lit(True)).cast("int") - 1  # -1: none

    n = F.size("t")
    swept = traces.select(LABEL, n.alias("n"), F.posexplode(F.transform(policies, stop)).alias("policy", "stop")).withColumn("used", F.when(F.col("stop") < 0, F.col("n")).otherwise(F.col("stop") + 1))
    k = F.explode(F.sequence(F.lit(1), F.lit(longest_schedule)))
    fixed = traces.select(LABEL, n.alias("n"), k.alias("k")).select(LABEL, "n", (F.lit(len(grid) - 1) + F.col("k")).alias("policy"), F.when(F.col("n") > F.col("k"), F.col("k")).otherwise(-1).alias("stop"), F.least("n", F.col("k") + 1).alias("used"))
    every = swept.unionByName(fixed)
    right = F.when(F.col(LABEL) < 0, F.col("stop") < 0).otherwise((F.col("stop") >= 0) & (F.col("stop") <= F.col(LABEL)))
    pos = F.col(LABEL) >= 0
    sums = every.groupBy("policy").agg(F.count_if(pos & right).alias("tp"), F.count_if(~pos & right).alias("tn"), F.count_if(~pos & ~right).alias("fp"), F.count_if(pos & ~right).alias("fn"), F.avg(F.col("used") / F.col("n")).alias("mean_used"))
    f1 = harmonic(share(F.col("tp"), F.col("tp") + F.col("fn")), share(F.col("tn"), F.col("tn") + F.col("fp")))
    of = F.element_at(F.array(*(F.lit(p["family"]) for p in grid), *[F.lit("fixed_schedule")] * longest_schedule), F.col("policy") + 1)
    return sums.select("policy", of.alias("family"), "tp", "tn", "fp", "fn", f1.alias("balanced_f1"), "mean_used")


def bucketed(rows: DataFrame) -> DataFrame:
    """rows with last, before (largest score so far, null at the first step), prev, bucket of the example and prefix, the step's kind."""
    w = W.partitionBy(EX)
    up = w.orderBy(STEP)
    e = rows.withColumns({"n": F.count(F.lit(1)).over(w), "last": F.max(STEP).over(w), "before": F.max(SCORE).over(up.rowsBetween(W.unboundedPreceding, -1)), "prev": F.lag(SCORE).over(up)})
    at = F.col(LABEL) / F.greatest(F.col("n") - 1, F.lit(1))
    bucket = F.when(F.col(LABEL) < 0, "all_correct").when(F.col(LABEL) == 0, "error_at_step0").when((F.col("n") <= 1) | (at <= 1 / 3.0), "early_error").when(at >= 2 / 3.0, "late_error").otherwise("mid_error")
    good = F.when(F.col(STEP) == F.col("n") - 1, "all_correct_terminal").otherwise("all_correct_nonterminal")
    prefix = F.when(F.col(LABEL) < 0, good).when(F.col(STEP) == F.col(LABEL), "first_bad_prefix").when(F.col(STEP) < F.col(LABEL), "safe_prefix").otherwise("later_bad_prefix")
    return e.withColumns({"bucket": bucket, "prefix": prefix})


def _ends() -> tuple[Column, Column]:
    """Of an all-good example's last step: whether it is at the top, and how far above what came before."""
    end = (F.col(LABEL) < 0) & (F.col(STEP) == F.col("last"))
    before = F.coalesce("before", F.col(SCORE))
    return F.when(end, (F.col(SCORE) >= before).cast("double")), F.when(end, F.col(SCORE) - before)


def example_buckets(rows: DataFrame) -> DataFrame:
    """Per bucket of examples by where the error is: pair and edge accuracy (null without any), terminal top-1 and gap, mean score."""
    b = bucketed(rows)
    edge = (F.col(LABEL) > 0) & (F.col(STEP) == F.col(LABEL))
    top, gap = _ends()
    of = b.groupBy(EX).agg(F.max("bucket").alias("bucket"), F.sum(SCORE).alias("_s"), F.count(F.lit(1)).alias("_n"), F.count_if(edge).alias("_e"), F.count_if(edge & (F.col("prev") > F.col(SCORE))).alias("_ok"), F.max(top).alias("_top"), F.max(gap).alias("_gap"))
    x = of.join(pair_counts(rows), EX)
    s = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("num_examples"), F.sum("pairs").alias("num_pairs"), F.sum("right").alias("_right"), F.sum("_e").alias("num_edges"), F.sum("_ok").alias("_ok"), F.avg("_top").alias("terminal_top1"), F.avg("_gap").alias("terminal_gap"), (F.sum("_s") / F.sum("_n")).alias("mean_score"))
    return s.select("bucket", "num_examples", "num_pairs", F.try_divide("_right", "num_pairs").alias("pair_accuracy"), "num_edges", F.try_divide("_ok", "num_edges").alias("edge_accuracy"), "terminal_top1", "terminal_gap", "mean_score")


def prefix_buckets(rows: DataFrame, slots: int = 4096) -> DataFrame:
    """Per kind of step: count, mean score, p10 and p90 by sorted place round((n - 1) q), half to even, mean step and range of labels. Scores are in [0, 1]."""
    from .curation import range_slot, ranked

    b = bucketed(rows).select("prefix", SCORE, STEP, LABEL)
    r = ranked(b, "prefix", [SCORE], range_slot(F.col(SCORE), 0.0, 1.0, slots))
    at = lambda q: F.max(F.when(F.col("_n") - 1 == F.bround((F.col("_all") - 1) * q), F.col(SCORE)))
    return r.groupBy(F.col("prefix").alias("bucket")).agg(F.count(F.lit(1)).alias("num_prefixes"), F.avg(SCORE).alias("mean_score"), at(0.1).alias("p10_score"), at(0.9).alias("p90_score"), F.avg(STEP).alias("mean_step"), F.min(LABEL).alias("label_min"), F.max(LABEL).alias("label_max"))


def transfer_means(rows: DataFrame) -> DataFrame:
    """One row: mean score of each kind of step (0 without any), and terminal top-1 and gap of all-good examples."""
    b = bucketed(rows)
    top, gap = _ends()
    kinds = ("safe_prefix", "first_bad_prefix", "later_bad_prefix", "all_correct_nonterminal", "all_correct_terminal")
    return b.agg(*(F.coalesce(F.avg(F.when(F.col("prefix") == k, F.col(SCORE))), F.lit(0.0)).alias(k) for k in kinds), F.avg(top).alias("terminal_top1"), F.avg(gap).alias("terminal_gap"))


def hard_slices(rows: DataFrame, most: int) -> DataFrame:
    """Of each erroneous example with a safe step: the last safe step against the first bad one, and against the best scored later one, where the model got it wrong.

    ``most`` of each kind, taken in turn from early, mid and late errors ((label + 1) / n at 1/3 and 2/3), by example.
    """
    at = lambda c: F.max(F.when(c, F.col(SCORE)))
    late = F.col(STEP) > F.col(LABEL)
    h = rows.groupBy(EX).agg(F.max(LABEL).alias(LABEL), F.count(F.lit(1)).alias("n"), at(F.col(STEP) == F.col(LABEL) - 1).alias("safe"), at(F.col(STEP) == F.col(LABEL)).alias("first"), F.max(F.when(late, F.struct(F.col(SCORE).alias("score"), (-F.col(STEP)).alias("step")))).alias("later")).where(F.col(LABEL) > 0)
    place = (F.col(LABEL) + 1) / F.col("n")
    bucket = F.when(place <= 1 / 3.0, "early").when(place <= 2 / 3.0, "mid").otherwise("late")
    sides = F.explode(F.array(F.struct(F.lit("edge_fail").alias("kind"), F.col(LABEL).alias("bad"), F.col("first").alias("score")), F.struct(F.lit("laterbad_fail").alias("kind"), (-F.col("later.step")).alias("bad"), F.col("later.score").alias("score"))))
    c = h.select(EX, bucket.alias("error_bucket"), (F.col(LABEL) - 1).alias("good"), "safe", sides.alias("s")).select(EX, "error_bucket", "good", "safe", "s.*").where("safe <= score")
    turn = F.row_number().over(W.partitionBy("kind", "error_bucket").orderBy(EX))
    first = c.withColumn("_turn", turn).where(F.col("_turn") <= most)
    kept = first.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("_turn", "error_bucket"))).where(F.col("_n") <= most)
    return kept.select(F.concat_ws("::", F.col(EX).cast("string"), "kind").alias("pair_id"), "error_bucket", F.col("good").cast("int").alias("good"), F.col("bad").cast("int").alias("bad"), (F.col("safe") - F.col("score")).alias("score_gap"))


def ensemble(rows: DataFrame, weight: float, other: Column | None = None) -> DataFrame:
    """Per way of joining two scores (weighted mean, min, max): global AUC and first-edge accuracy. other: the second score; without it the next step's stands in."""
    second = other if other is not None else F.lead(SCORE, 1, 0.5).over(W.partitionBy(EX).orderBy(STEP))
    both = rows.withColumn("_o", second)
    ways = {"mean": weight * F.col(SCORE) + (1 - weight) * F.col("_o"), "min": F.least(SCORE, "_o"), "max": F.greatest(SCORE, "_o")}
    m = both.select(EX, STEP, LABEL, F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.alias(SCORE)) for k, v in ways.items()))).alias("w")).select(EX, STEP, LABEL, "w.*")
    prev = F.lag(SCORE).over(W.partitionBy("method", EX).orderBy(STEP))
    edge = F.avg(F.when((F.col(LABEL) > 0) & (F.col(STEP) == F.col(LABEL)), (F.col("prev") > F.col(SCORE)).cast("double")))
    return m.withColumn("prev", prev).groupBy("method").agg(edge.alias("edge_accuracy")).join(auc(with_goodness(m), F.col("is_good"), by=["method"]).select("method", "auc"), "method")


def average_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with rank: the mean rank of equal values, from 1. Counts by value come first; only they are sorted, and join back by value."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    below = F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.select(*by, value, (F.coalesce(below, F.lit(0)) + (F.col("_c") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*by, value])
