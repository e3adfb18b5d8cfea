"""Corrupted prefixes: mutations of a prefix's last line, chosen by policy. Each kind gives one candidate at most, so choices are slices of a sorted array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Kinds and priorities by policy.
LEGACY = (("binary_flip", 20), ("operator_flip", 21), ("numeric_perturb", 22), ("step_drop", 99))
BALANCED = (("negation_flip", 10), ("comparator_flip", 11), ("condition_reversal", 12), ("entity_substitution", 13), *LEGACY)
_MADE = {"binary_flip": tx.flip_binary, "operator_flip": tx.flip_operator, "numeric_perturb": tx.bump_number, "negation_flip": tx.toggle_negation, "comparator_flip": tx.swap_comparator, "condition_reversal": tx.toggle_condition}


def candidates(line: Column, n_lines: Column, policy: str, question: Column | None = None, prefix: Column | None = None) -> Column:
    """array<struct<priority, kind, text>> of what can be made of a line; text is blank for step_drop, which needs a line before."""
    kinds = {"legacy": LEGACY, "cqr_balanced": BALANCED}[policy]
    out = []
    for kind, priority in kinds:
        if kind == "step_drop":
            made = F.when(n_lines > 1, "")
        elif kind == "entity_substitution":
            if question is None or prefix is None:
                continue
            made = tx.swap_entity(line, F.array_distinct(F.concat(tx.entities(question), tx.entities(prefix))))
        else:
            made = _MADE[kind](line)
        out.append(F.when(made.isNotNull(), F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), made.alias("text"))))
    return F.array_compact(F.array(*out))


def balanced(some: Column, most: int, least_other: int, most_drop: int) -> Column:
    """The choice of candidates in order of priority: ``least_other`` that drop no step first, places kept for up to ``most_drop`` that do, then more others."""

    def chosen(c: Column) -> Column:
        other, drop = F.filter(c, lambda x: x["kind"] != "step_drop"), F.filter(c, lambda x: x["kind"] == "step_drop")
        n, d = F.size(other), F.size(drop)
        first = F.least(F.lit(max(least_other, 1)), n, F.lit(most))
        kept = F.least(F.lit(most_drop), d, F.greatest(most - first, F.lit(0)))
        n_other = F.least(n, first + F.greatest(most - first - kept, F.lit(0)))
        n_drop = F.least(F.lit(most_drop), d, most - n_other)
        return F.concat(F.slice(other, F.lit(1), n_other), F.slice(drop, F.lit(1), n_drop))

    return F.get(F.transform(F.array(F.array_sort(some)), chosen), F.lit(0))


def corrupted(rows: DataFrame, lines: str, policy: str = "cqr_balanced", most: int = 4, least_other: int = 1, most_drop: int = 1, question: str | None = None) -> DataFrame:
    """rows (lines: a prefix's lines that are not blank), once for each corrupted prefix: kind, text, original_step, corrupted_step; blank and unchanged ones are left out, and repeats of a kind and text."""
    n = F.size(lines)
    last = F.trim(F.element_at(lines, F.lit(-1)))
    whole = F.array_join(lines, "\n")
    some = candidates(last, n, policy, F.col(question) if question else None, whole)
    picked = balanced(some, most, least_other, most_drop) if policy == "cqr_balanced" else some
    before = F.slice(lines, F.lit(1), n - 1)

    def text(c: Column) -> Column:
        kept = F.when(c["kind"] == "step_drop", before).otherwise(F.concat(before, F.array(c["text"])))
        return F.struct(c["kind"].alias("kind"), tx.strip(F.array_join(kept, "\n")).alias("text"), c["text"].alias("step"))

    made = F.filter(F.transform(picked, text), lambda x: (x["text"] != "") & (x["text"] != tx.strip(whole)))
    each = rows.where(n > 0).withColumn("_c", F.slice(made, 1, most))
    out = each.withColumn("_c", F.explode("_c"))
    return out.select(*rows.columns, F.col("_c.kind").alias("kind"), F.col("_c.text").alias("text"), last.alias("original_step"), F.col("_c.step").alias("corrupted_step"))
