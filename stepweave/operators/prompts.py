"""Prompts, targets and their inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose_prompt(system: Column, user_template: Column, question: Column) -> Column:
    user = F.replace(user_template, F.lit("{question}"), question)
    return F.concat(F.lit("[SYSTEM]\n"), system, F.lit("\n\n[USER]\n"), user, F.lit("\n\n[ASSISTANT]\n"))


def target_text(style: str, cot: Column, answer: Column, prefix: str) -> Column:
    """style: answer_only, or cot_then_answer, which falls back to the answer where the reasoning is blank."""
    final = F.concat(F.lit(prefix), answer)
    if style == "answer_only":
        return final
    if style != "cot_then_answer":
        raise ValueError(f"unknown style {style}")
    return F.when(F.coalesce(F.trim(cot), F.lit("")) == "", final).otherwise(F.concat_ws("\n", F.trim(cot), final))


def split_target(text: Column, prefixes: list[str]) -> Column:
    """struct<reasoning, answer, found>: at the last non-blank line if it begins with a prefix, else at the last prefix anywhere."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    last = F.try_element_at(lines, F.lit(-1))
    out = F.struct(F.lit("").alias("reasoning"), F.trim(text).alias("answer"), F.lit(False).alias("found"))
    for p in reversed(prefixes):
        behind = F.substring_index(text, p, -1)
        at = F.struct(F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(behind) - len(p))).alias("reasoning"), F.trim(behind).alias("answer"), F.lit(True).alias("found"))
        out = F.when(F.contains(text, F.lit(p)), at).otherwise(out)
    for p in reversed(prefixes):
        whole = F.struct(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("reasoning"), F.trim(F.substring(last, F.lit(len(p) + 1), F.length(last))).alias("answer"), F.lit(True).alias("found"))
        out = F.when(last.startswith(p), whole).otherwise(out)
    return out


def last_lines(text: Column, n: int) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.array_join(F.when(F.size(lines) > n, F.slice(lines, F.lit(-n), F.lit(n))).otherwise(lines), "\n")
