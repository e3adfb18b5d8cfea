"""From labelled step sequences and rated completions to preference pairs: one row to none or several.

A mode is an expression that gives an array of places (good, bad, confidence) of one row's signs; records() writes the two
prefixes of each, flags and filters them and gives them their ids. So a conversion is one pass over the rows that hold the
steps. The cap of the nearest mode counts what passes the filter: sizes of all prefixes tell that, so that only the texts of
pairs below the cap are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import joined_id
from ..functions.text import _let, squash, strip
from .curation import diverse_places, passes_quality, quality_flags

PLACES = "array<struct<good:int,bad:int,confidence:double>>"

# Names of builds and meanings that other tools read.
BUILDS = {
    "first_bad_edge_strict": ("step_label_first_bad_edge_strict", "local_first_bad_edge"),
    "first_bad_fanout": ("step_label_first_bad_fanout", "first_bad_fanout_prefix_ranking"),
    "all_good_vs_all_bad": ("step_label_all_good_vs_all_bad", "good_bad_prefix_grid"),
    "legacy_nearest": ("step_label_legacy_nearest_boundary", "same_trajectory_depth_mixed"),
}
ANCHORS = ("step_label_all_positive_terminal_anchor", "terminal_completion_anchor")


def prefix_at(steps: Column, i: Column, joint: str = "\n") -> Column:
    return F.array_join(F.slice(steps, F.lit(1), i + 1), joint)


def prefix_text(steps: Column, i: Column) -> Column:
    """Steps up to place i, blank ones left out, each with a line feed behind it."""
    kept = F.filter(F.transform(F.slice(steps, F.lit(1), i + 1), strip), lambda s: F.length(s) > 0)
    return F.array_join(F.transform(kept, lambda s: F.concat(s, F.lit("\n"))), "")


def first_negative(signs: Column) -> Column:
    """Place (from 0) of the first "-"; null if there is none."""
    return F.nullif(F.array_position(signs, F.lit("-")), F.lit(0).cast("long")) - 1


def prefix_sizes(steps: Column) -> Column:
    """For each place, of the squashed prefix_text() up to it: its characters and its different words.

    A word counts at the first step that has it: words and steps are sorted, and a mark of each step among the sorted first
    steps of words has so many words before it. So the work follows the text, not the text of all its prefixes.
    """

    def running(cut: Column) -> Column:
        def add(s: Column, c: Column) -> Column:
            more = F.when(c == "", F.lit(0)).otherwise(F.length(c) + F.when(s["last"] > 0, 1).otherwise(0))
            return _let(s["last"] + more, lambda v: F.struct(F.concat(s["all"], F.array(v)).alias("all"), v.alias("last")))

        return F.aggregate(cut, F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("last")), add)["all"]

    def distinct(cut: Column) -> Column:
        words = F.flatten(F.transform(cut, lambda c, i: F.when(c == "", F.array().cast("array<struct<w:string,i:int>>")).otherwise(F.transform(F.split(c, " "), lambda w: F.struct(w.alias("w"), i.alias("i"))))))
        firsts = _let(F.sort_array(words), lambda a: F.filter(a, lambda x, j: (j == 0) | (F.get(a, j - 1)["w"] != x["w"])))
        marks = F.transform(cut, lambda c, i: F.struct(i.alias("i"), F.lit(1).alias("mark")))
        marked = F.sort_array(F.concat(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), F.lit(0).alias("mark"))), marks))
        ends = F.filter(F.transform(marked, lambda x, j: F.struct(x["mark"].alias("mark"), j.alias("j"))), lambda x: x["mark"] == 1)
        return F.transform(ends, lambda x, i: x["j"] - i)

    return _let(F.transform(steps, squash), lambda cut: F.arrays_zip(running(cut).alias("chars"), distinct(cut).alias("words")))


def _prefix_passes(sizes: Column, p: Column, **quality) -> Column:
    """passes_quality() of the texts of a place, of which one begins with the other."""
    pair = F.struct(F.get(sizes, p["good"]).alias("c"), F.get(sizes, p["bad"]).alias("r"))

    def flags(x: Column) -> Column:
        nc, nr, a, b = x["c"]["chars"], x["r"]["chars"], x["c"]["words"], x["r"]["words"]
        ratio = F.greatest(nc, nr) / F.greatest(F.least(nc, nr), F.lit(1))
        overlap = F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))
        return F.struct(nc.alias("chosen_chars"), nr.alias("rejected_chars"), ratio.alias("length_ratio"), overlap.alias("token_overlap_ratio"), ((nc > 0) & (nr > 0)).alias("non_empty"), (nc != nr).alias("distinct_pair"))

    return _let(pair, lambda x: _let(flags(x), lambda q: passes_quality(q, **quality)))


def grid_confidence(good: Column, bad: Column, k: Column) -> Column:
    """.74, less .04 for each step that the good one is before the edge (4 at most) and .03 for each the bad one is behind; .55 at least."""
    dg, db = F.greatest(k - 1 - good, F.lit(0)), F.greatest(bad - k, F.lit(0))
    return F.greatest(F.lit(0.74) - 0.04 * F.least(dg, F.lit(4)) - 0.03 * F.least(db, F.lit(4)), F.lit(0.55))


def _place(good: Column, bad: Column, confidence: Column) -> Column:
    return F.struct(good.cast("int").alias("good"), bad.cast("int").alias("bad"), confidence.cast("double").alias("confidence"))


def _none() -> Column:
    return F.array().cast(PLACES)


def grid_pair(place: Column, k: Column, n: Column) -> Column:
    """struct (good, bad) at a 1-based place of the grid of k good and n - k bad steps, which is not written out.

    The order: the edge; earlier good ones with the first bad; the last good one with later bad ones; then by later bad one
    all earlier good ones, the latest first.
    """
    rest = place - n  # from 0, behind the edge, k - 1 early and n - k - 1 later ones
    early = F.greatest(k - 1, F.lit(1))
    good = F.when(place <= k, k - place).when(place <= n - 1, k - 1).otherwise(k - 2 - F.pmod(rest, early))
    bad = F.when(place <= k, k).when(place <= n - 1, place).otherwise(k + 1 + F.floor(rest / early))
    return F.struct(good.cast("int").alias("good"), bad.cast("int").alias("bad"))


def step_places(mode: str, signs: Column, most: int) -> Column:
    """The pairs of a row by mode, as PLACES: at most ``most``, but for legacy_nearest, whose cap counts what passes the filter."""
    k, n = first_negative(signs).cast("int"), F.size(signs)
    has = F.coalesce(k > 0, F.lit(False))
    if mode == "first_bad_edge_strict":
        return F.when(has, F.array(_place(k - 1, k, F.lit(0.74)))).otherwise(_none())
    if mode == "first_bad_fanout":
        chosen = F.transform(diverse_places(most, k), lambda p: _place(k - p, k, grid_confidence(k - p, k, k)))
        return F.when(has, chosen).otherwise(_none())
    if mode == "all_good_vs_all_bad":
        long_k, long_n = k.cast("long"), n.cast("long")

        def cell(p: Column) -> Column:
            g = grid_pair(p, long_k, long_n)
            return _place(g["good"], g["bad"], grid_confidence(g["good"], g["bad"], k))

        return F.when(has, F.transform(diverse_places(most, long_k * (long_n - long_k)), cell)).otherwise(_none())
    if mode == "legacy_nearest":
        at = F.sequence(F.lit(0), n - 1)

        def nearest(p: Column, negatives: Column) -> Column:
            bad = F.array_min(F.transform(negatives, lambda b: F.struct(F.abs(b - p).alias("d"), b.alias("b"))))
            return _let(bad, lambda x: _place(p, x["b"], F.when(x["d"] <= 2, 0.62).otherwise(0.55)))

        sides = F.struct(F.filter(at, lambda i: F.get(signs, i) == "+").alias("good"), F.filter(at, lambda i: F.get(signs, i) == "-").alias("bad"))
        return F.when((n > 0) & k.isNotNull(), _let(sides, lambda x: F.transform(x["good"], lambda p: nearest(p, x["bad"])))).otherwise(_none())
    raise ValueError(f"unknown mode {mode}")


def anchor_places(signs: Column, most: int) -> Column:
    """Of rows with good steps only (two at least): the whole against earlier prefixes."""
    n = F.size(signs)
    chosen = F.transform(diverse_places(most, n - 1), lambda p: _place(n - 1, n - 1 - p, F.when(p <= 1, 0.70).otherwise(0.66)))
    return F.when((n >= 2) & F.forall(signs, lambda s: s == "+"), chosen).otherwise(_none())


def _exploded(rows: DataFrame, places: Column) -> DataFrame:
    return rows.select("key", F.explode(places).alias("p")).select("key", "p.good", "p.bad", "p.confidence")


def first_bad_edge(rows: DataFrame) -> DataFrame:
    """key, steps, signs: the prefixes before and at the first bad step, where there is a good one before."""
    return _exploded(rows, step_places("first_bad_edge_strict", F.col("signs"), 1))


def first_bad_fanout(rows: DataFrame, most: int = 2) -> DataFrame:
    """Several good prefixes, the last one and a spread of those before it, against the first bad one."""
    return _exploded(rows, step_places("first_bad_fanout", F.col("signs"), most))


def all_good_vs_all_bad(rows: DataFrame, most: int = 6) -> DataFrame:
    """A diverse choice of (edge; earlier good with first bad; last good with later bad; the rest), ``most`` pairs at most of a row."""
    return _exploded(rows, step_places("all_good_vs_all_bad", F.col("signs"), most))


def terminal_anchors(rows: DataFrame, most: int = 2) -> DataFrame:
    return _exploded(rows, anchor_places(F.col("signs"), most))


def split_group(source: Column, prompt: Column, explicit: Column | None = None, parts: dict[str, Column] | None = None, places: dict[str, Column] | None = None) -> Column:
    """The group that a split keeps together: an explicit one, else the source's parts with the first place that is there, else with a hash of the prompt."""
    named = lambda d: [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}="), F.trim(v.cast("string")))) for k, v in (d or {}).items()]
    first = F.coalesce(*named(places), F.concat(F.lit("prompt="), joined_id(F.trim(source), squash(prompt), length=16)))
    made = F.concat_ws("|", F.trim(source), *named(parts), first)
    return made if explicit is None else F.coalesce(F.nullif(F.trim(explicit), F.lit("")), made)


def records(rows: DataFrame, source: Column, domain: Column, prompt: Column, min_chars: int = 12, max_ratio: float = 4.0, max_overlap: float = 0.995, parts: dict[str, Column] | None = None, places: dict[str, Column] | None = None) -> DataFrame:
    """rows (chosen, rejected, confidence, ...) that pass the quality filter, with pair_id, flags (q) and split_group_id; confidence clipped to [0, 1]."""
    flagged = rows.withColumns({"source_tag": F.trim(source), "domain_tag": F.trim(domain), "prompt_text": prompt})
    flagged = quality_flags(flagged, "chosen", "rejected", "prompt_text")
    # a filter by what a generator makes stays behind it: moved before the flags it would squash and cut both texts for each of its conditions
    flagged = flagged.withColumn("q", F.explode_outer(F.array("q")))
    kept = flagged.where(passes_quality(F.col("q"), min_chars, max_ratio, max_overlap))
    own = joined_id(source, domain, squash(F.col("prompt_text")), squash(F.col("chosen")), squash(F.col("rejected")), length=20)
    return kept.withColumns({"pair_id": own, "split_group_id": split_group(F.col("source_tag"), F.col("prompt_text"), None, parts, places), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))})


def convert_steps(rows: DataFrame, mode: str, source: Column, domain: Column, prompt: Column, most: int = 2, anchors: bool = False, places: dict[str, Column] | None = None, **quality) -> DataFrame:
    """Records of rows (key, steps, signs, ...) by mode, and of rows with good steps only their anchors if asked for."""
    build, meaning = BUILDS[mode]
    found = step_places(mode, F.col("signs"), most)
    if mode == "legacy_nearest":
        passing = lambda found: _let(prefix_sizes(F.col("steps")), lambda sizes: F.filter(found, lambda p: _prefix_passes(sizes, p, **quality)))
        found = _let(found, lambda f: F.when(F.size(f) > 0, F.slice(passing(f), 1, most)).otherwise(f))
    named = F.transform(found, lambda p: F.struct(p["good"].alias("good"), p["bad"].alias("bad"), p["confidence"].alias("confidence"), F.lit(build).alias("pair_build_mode"), F.lit(meaning).alias("pair_semantics")))
    if anchors:
        ends = F.transform(anchor_places(F.col("signs"), most), lambda p: F.struct(p["good"].alias("good"), p["bad"].alias("bad"), p["confidence"].alias("confidence"), F.lit(ANCHORS[0]).alias("pair_build_mode"), F.lit(ANCHORS[1]).alias("pair_semantics")))
        named = F.concat(named, ends)
    # outer: for a plain explode Spark puts a filter by the array's size before it, which makes the array twice
    each = rows.withColumn("_p", F.explode_outer(named)).where("_p is not null").select("*", "_p.*").drop("_p")
    first = first_negative(F.col("signs")).cast("int")
    each = each.withColumns({"chosen": prefix_text(F.col("steps"), F.col("good")), "rejected": prefix_text(F.col("steps"), F.col("bad")), "step_gap": F.col("bad") - F.col("good"), "first_negative_index": first, "num_step_labels": F.size("signs")})
    return records(each.drop("steps", "signs"), source, domain, prompt, places=places, **quality)


def _best(step: Column, good, better) -> Column:
    """The first best rated of a step's completions that good() accepts, as struct<r, n, t>."""
    rated = F.transform(step["completions"], lambda c, i: F.struct(better(c["rating"]).alias("r"), i.alias("n"), strip(c["text"]).alias("t"), c["rating"].alias("rating")))
    return F.array_min(F.filter(rated, lambda c: F.coalesce((F.length(c["t"]) > 0) & good(c["rating"]), F.lit(False))))


def completion_places(steps: Column, zero_is_good: bool = True) -> Column:
    """Per step, from an array of struct<completions: array<struct<text, rating>>, chosen_completion>: step, good and bad text, ratings and the steps before it.

    The history goes on with the completion that the annotator chose, else with the best one; steps with neither leave it.
    """

    def sides(step: Column) -> Column:
        good = _best(step, (lambda r: r >= 0) if zero_is_good else (lambda r: r > 0), lambda r: -r)
        bad = _best(step, (lambda r: r < 0) if zero_is_good else (lambda r: r <= 0), lambda r: r)
        told = F.nullif(strip(F.get(step["completions"], F.when(step["chosen_completion"] >= 0, step["chosen_completion"]))["text"]), F.lit(""))
        return F.struct(good.alias("good"), bad.alias("bad"), F.coalesce(told, good["t"]).alias("next"))

    each = F.transform(steps, sides)

    def pair(x: Column, i: Column, all_: Column) -> Column:
        before = F.filter(F.transform(F.slice(all_, F.lit(1), i), lambda y: y["next"]), lambda t: t.isNotNull())
        return F.struct(i.alias("step"), x["good"]["t"].alias("good"), x["bad"]["t"].alias("bad"), x["good"]["rating"].alias("good_rating"), x["bad"]["rating"].alias("bad_rating"), before.alias("history"))

    found = F.get(F.transform(F.array(each), lambda all_: F.transform(all_, lambda x, i: pair(x, i, all_))), F.lit(0))
    return F.filter(found, lambda p: p["good"].isNotNull() & p["bad"].isNotNull())


def completion_pairs(rows: DataFrame, source: Column, domain: Column, prompt: Column, most: int = 2, places: dict[str, Column] | None = None, **quality) -> DataFrame:
    """Records of rows (key, steps): a step's best rated completion (0 or more) against its worst (below 0), each behind the steps chosen before; the first ``most`` of a row that pass the filter."""
    each = rows.select("key", *(c for c in rows.columns if c not in ("key", "steps")), F.explode(completion_places(F.col("steps"))).alias("p"))
    gap = F.col("p.good_rating") - F.col("p.bad_rating")
    both = {side: F.array_join(F.transform(F.concat("p.history", F.array(f"p.{at}")), lambda s: F.concat(s, F.lit("\n"))), "") for side, at in (("chosen", "good"), ("rejected", "bad"))}
    each = each.withColumns(both | {"step": F.col("p.step"), "confidence": F.when(gap >= 2, 0.78).when(gap >= 1, 0.70).otherwise(0.62)}).drop("p")
    out = records(each, source, domain, prompt, places=places, **quality)
    return out.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("step"))).where(F.col("_n") <= most).drop("_n")


def rating_policies(rows: DataFrame) -> DataFrame:
    """One row for each reading of rating 0 (good or bad): steps with pairs, rows with pairs, and how often a 0 stands on either side. rows: key, steps."""
    out = None
    for name, zero in (("nonnegative", True), ("strictly_positive", False)):
        p = rows.select("key", completion_places(F.col("steps"), zero).alias("p"))
        zeros = lambda side: F.size(F.filter("p", lambda x: x[side] == 0))
        one = p.agg(F.sum(F.size("p")).alias("pairs"), F.count_if(F.size("p") > 0).alias("rows_with_pairs"), F.sum(zeros("good_rating")).alias("zero_as_good"), F.sum(zeros("bad_rating")).alias("zero_as_bad")).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def rated_pairs(rows: DataFrame) -> DataFrame:
    """key, completions (array by step of arrays of text, rating): per step its best rated (0 or more) against its worst (below 0)."""
    step = rows.select("key", F.posexplode("completions").alias("step", "c"))
    best = F.array_max(F.transform(F.filter("c", lambda x: x["rating"] >= 0), lambda x: F.struct(x["rating"].alias("r"), x["text"].alias("t"))))
    worst = F.array_min(F.transform(F.filter("c", lambda x: x["rating"] < 0), lambda x: F.struct(x["rating"].alias("r"), x["text"].alias("t"))))
    r = step.select("key", "step", best.alias("b"), worst.alias("w")).where("b is not null and w is not null")
    gap = F.col("b.r") - F.col("w.r")
    return r.select("key", "step", F.col("b.t").alias("chosen"), F.col("w.t").alias("rejected"), F.when(gap >= 2, 0.78).when(gap >= 1, 0.70).otherwise(0.62).alias("confidence"))


def conversation_signs(turns: Column) -> Column:
    """array<struct<text, sign>> of an ordered array of turns (role, content): a user's turn that an assistant's "+" or "-" follows."""
    last = F.size(turns) - 1

    def one(i: Column) -> Column:
        left, right = F.get(turns, i), F.get(turns, i + 1)
        sign, step = strip(right["content"]), strip(left["content"])
        ok = (F.lower(F.trim(left["role"])) == "user") & (F.lower(F.trim(right["role"])) == "assistant") & sign.isin("+", "-") & (F.length(step) > 0)
        return F.when(ok, F.struct(step.alias("text"), sign.alias("sign")))

    found = F.filter(F.transform(F.sequence(F.lit(0), last - 1), one), lambda x: x.isNotNull())
    return F.when(last >= 1, found).otherwise(F.array().cast("array<struct<text:string,sign:string>>"))


def error_step_pairs(rows: DataFrame, one_based: bool) -> DataFrame:
    """key, original, modified (arrays of steps), error_steps: a pair at each error step that both have."""
    at = F.col("e") - (1 if one_based else 0)
    r = rows.select("key", "original", "modified", F.explode("error_steps").alias("e")).withColumn("at", at)
    return r.where((F.col("at") >= 0) & (F.col("at") < F.least(F.size("original"), F.size("modified")))).select("key", "at", prefix_text(F.col("original"), F.col("at")).alias("chosen"), prefix_text(F.col("modified"), F.col("at")).alias("rejected"), F.lit(0.86).alias("confidence"))


def index_base(rows: DataFrame) -> DataFrame:
    """One row, base: "zero", "one", "mixed" or "ambiguous", by whether any error step is 0 or reaches the length of either side."""
    e = rows.select(F.explode("error_steps").alias("e"), F.least(F.size("original"), F.size("modified")).alias("n"))
    s = e.agg(F.coalesce(F.bool_or(F.col("e") == 0), F.lit(False)).alias("zero"), F.coalesce(F.bool_or(F.col("e") >= F.col("n")), F.lit(False)).alias("one"))
    return s.select(F.when(F.col("zero") & F.col("one"), "mixed").when(F.col("zero"), "zero").when(F.col("one"), "one").otherwise("ambiguous").alias("base"))


def with_index_base(rows: DataFrame) -> DataFrame:
    """error_step_pairs by the base that the rows show: the base is one broadcast row; reading fails where it is mixed or ambiguous."""
    base = index_base(rows)
    known = base.select(F.when(F.col("base").isin("zero", "one"), F.col("base")).otherwise(F.raise_error(F.concat(F.lit("error step indices are "), F.col("base")))).alias("base"))
    shifted = rows.crossJoin(F.broadcast(known)).withColumn("error_steps", F.transform("error_steps", lambda e: e - F.when(F.col("base") == "one", 1).otherwise(0)))
    return error_step_pairs(shifted, one_based=False)


def fork_pairs(rows: DataFrame, source: str = "math_step_dpo", **quality) -> DataFrame:
    """Records of rows (row, prompt, prefix, chosen, rejected): two ways on from one prefix, confidence .80, full-length ids."""
    some = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0
    prompt = F.coalesce("prompt", F.lit(""))
    kept = rows.where(some("prefix") & some("chosen") & some("rejected")).withColumn("prompt", prompt)
    made = kept.select("row", "prompt", "prefix", F.col("chosen").alias("way"), F.col("rejected").alias("other_way"), F.concat("prefix", "chosen").alias("chosen"), F.concat("prefix", "rejected").alias("rejected"))
    good = quality_flags(made, "chosen", "rejected", "prompt").where(passes_quality(F.col("q"), **quality))
    ids = joined_id(F.lit(source), F.col("row"), F.col("prompt"), F.col("way"), F.col("other_way"), length=None)
    group = joined_id(F.lit(source), F.col("prompt"), F.col("prefix"), length=None)
    return good.select("row", ids.alias("pair_id"), group.alias("split_group_id"), F.when(F.col("prompt") != "", F.concat("prompt", F.lit("\n\n"))).otherwise("").alias("prompt_text"), "chosen", "rejected", F.lit(0.80).alias("confidence"))


# The verifier's verdict line and case, and the texts of a compact pair.
VERDICT = r"(?i)Verification:\s*Is the step correct \(Yes/No\)\?\s*(Yes|No)"
CASE = r"(?s)Question:\s*(.*?)\nPrevious Steps:\s*(.*?)\nNow Step:\s*(.*?)\nPlease carefully analyze the correctness of the Now Step\.\s*Reply:\s*$"
VERDICT_TEXTS = {"yes": "The Now Step is correct. Final answer: Yes.\n", "no": "The Now Step is incorrect. Final answer: No.\n"}
CORRECTNESS_TEXTS = {"yes": "The Now Step is correct.\n", "no": "The Now Step is incorrect.\n"}


def last_verdict(text: Column) -> Column:
    """yes or no of the last verdict line; null without one."""
    return F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(VERDICT), F.lit(1)), F.lit(-1)))


def compact_case(instruction: Column) -> Column:
    """A verifier's long instruction cut down to its case; null if it is none, or a part is blank."""
    text = strip(F.replace(instruction, F.lit("\r"), F.lit("\n")))
    q, before, now = (strip(F.regexp_extract(text, CASE, k)) for k in (1, 2, 3))
    whole = F.concat(F.lit("Question: "), q, F.lit("\n\nPrevious Steps:\n"), before, F.lit("\n\nNow Step:\n"), now, F.lit("\n\nTask: Decide whether the Now Step is correct.\nVerification: "))
    return F.when((q != "") & (before != "") & (now != ""), whole)


def verifier_pairs(rows: DataFrame, mode: str = "compact_verdict", **quality) -> DataFrame:
    """Records of rows (instruction, chosen, rejected, ...): as they are (direct_pair_legacy, .78), or compact pairs of opposite verdicts (.86)."""
    if mode == "direct_pair_legacy":
        return records(rows.withColumn("confidence", F.lit(0.78)), F.lit("r_prm"), F.lit("general_math"), F.coalesce("instruction", F.lit("")), **quality)
    texts = {"compact_verdict": VERDICT_TEXTS, "compact_correctness": CORRECTNESS_TEXTS}[mode]
    said = rows.withColumns({"_c": last_verdict(F.col("chosen")), "_r": last_verdict(F.col("rejected")), "_p": compact_case(F.col("instruction"))}).where("_p is not null and _c <> _r")
    told = lambda c: F.when(F.col(c) == "yes", texts["yes"]).otherwise(texts["no"])
    made = said.withColumns({"chosen": told("_c"), "rejected": told("_r"), "confidence": F.lit(0.86)}).drop("_c", "_r")
    return records(made, F.lit("r_prm"), F.lit("general_math"), F.col("_p"), **quality).drop("_p")


def pair_type(good: Column, bad: Column, first_bad: Column) -> Column:
    """Kind of a good and a bad step by whether they stand at the edge; null without a first bad step."""
    last_safe = good == first_bad - 1
    at_first = F.when(last_safe, "lastsafe_vs_firstbad").otherwise("earlygood_vs_firstbad")
    return F.when(first_bad.isNull(), None).when(bad == first_bad, at_first).when(last_safe, "lastsafe_vs_laterbad").otherwise("earlygood_vs_laterbad")


PAIR_TYPES = ["lastsafe_vs_firstbad", "earlygood_vs_firstbad", "lastsafe_vs_laterbad", "earlygood_vs_laterbad"]
GAPS = ["gap1", "gap2", "gap3_4", "gap5p"]


def gap_bucket(gap: Column) -> Column:
    return F.when(gap <= 1, "gap1").when(gap == 2, "gap2").when(gap <= 4, "gap3_4").otherwise("gap5p")


def anchor_place(n: Column, mode: str) -> Column:
    """Place of the prefix that a whole of n steps is held against: penultimate, or late75, three quarters through (rounded half to even)."""
    if mode == "penultimate":
        return n - 2
    if mode == "late75":
        return F.least(n - 2, F.greatest(F.lit(0), F.bround(n * 0.75).cast("int") - 1))
    raise ValueError(f"unknown mode {mode}")
