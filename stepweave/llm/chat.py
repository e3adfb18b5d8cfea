r"""Chat formatting: a declarative template, a finite-state machine over roles, segments with loss flags. Native expressions only.

format_conversations() gathers the rows of a conversation by turn and emits ``segments`` (text, loss), ``formatted`` (their
texts joined), ``state`` (the machine's last state) and ``valid``. Texts are escaped so that no control string of the
template stands in them: ``\`` becomes ``\\`` and the first character of a control string ``\l`` (for <) or ``\b`` (for [).
read_back() parses ``formatted`` alone and undoes the escape.

Defined results. Null text is empty, null role the empty role. Roles that the template does not name are written with its
general markers, so nothing is lost, and make the conversation invalid. Rows of one turn are ordered by role, then text;
repeated rows stay. Null turns come first, rows with a null conversation key form one conversation. An empty table gives no
rows. Other columns are not read. A conversation is one output record, so it is held whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    #: role -> opening and closing marker
    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    #: markers of any other role: before the role, between role and text, after the text
    general: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing leads to the state "invalid"
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("asked", "answered")

    def controls(self) -> list[str]:
        return [self.begin, *(m for pair in self.markers.values() for m in pair), *self.general]


def _quoted(strings: list[str]) -> str:
    return "|".join(re.sub(r"([\[\](){}.*+?^$|\\])", r"\\\1", s) for s in strings)


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, mark in (("<", "l"), ("[", "b")):
        rest = [c[1:] for c in t.controls() if c[0] == first]
        out = F.regexp_replace(out, f"{_quoted([first])}(?={_quoted(rest)})", r"\\" + mark)
    return out


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def format_conversations(rows: DataFrame, template: Template | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    t = template or Template()
    if any(c[0] not in "<[" for c in t.controls()):
        raise ValueError("control strings begin with < or [")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def segment(value: Column | str, loss: bool) -> Column:
        return F.struct((F.lit(value) if isinstance(value, str) else value).alias("text"), F.lit(loss).alias("loss"))

    def written(x: Column) -> Column:
        body = escape(x["text"], t)
        out = F.array(segment(t.general[0], False), segment(escape(x["role"], t), False), segment(t.general[1], False), segment(body, False), segment(t.general[2], False))
        for name, (before, after) in t.markers.items():
            out = F.when(x["role"] == name, F.array(segment(before, False), segment(body, name in t.loss_roles), segment(after, False))).otherwise(out)
        return out

    steps = F.create_map(*(F.lit(x) for s, to in t.machine.items() for r, n in to.items() for x in (f"{s} {r}", n)))
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(" "), x["role"])), F.lit("invalid")))
    out = turns.select(key, F.concat(F.array(segment(t.begin, False)), F.flatten(F.transform("turns", written))).alias("segments"), state.alias("state"))
    return out.withColumns({"formatted": F.array_join(F.transform("segments", lambda s: s["text"]), ""), "valid": F.col("state").isin(*t.final)})


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with ``turns`` (role, text), parsed from the formatted text, and ``loss_text``, the unescaped text under the loss flags."""
    t = template or Template()
    control = _quoted(sorted(t.controls(), key=len, reverse=True))
    names = F.create_map(*(F.lit(x) for r, (m, _) in t.markers.items() for x in (m, r)), F.lit(t.general[0]), F.lit(""))
    cut = formatted.withColumns({"_mark": F.regexp_extract_all("formatted", F.lit(f"({control})"), F.lit(1)), "_piece": F.split("formatted", control, -1)})

    def turn(mark: Column, i: Column) -> Column:
        def piece(n: int) -> Column:
            return unescape(F.get(F.col("_piece"), i + n))

        general = mark == t.general[0]
        role = F.when(general, piece(1)).otherwise(F.try_element_at(names, mark))
        return F.struct(role.alias("role"), F.when(general, piece(2)).otherwise(piece(1)).alias("text"), F.coalesce(F.array_contains(F.map_keys(names), mark), F.lit(False)).alias("opens"))

    turns = F.filter(F.transform("_mark", turn), lambda x: x["opens"])
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return cut.withColumns({"turns": F.transform(turns, lambda x: F.struct(x["role"], x["text"])), "loss_text": loss}).drop("_mark", "_piece")
