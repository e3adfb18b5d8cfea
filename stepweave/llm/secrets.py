r"""Secret scans with multipart credential linking. Native expressions and joins only.

Three base kinds are always reported: assign, access and hex. Three weak kinds (user, blob, endpoint) are parts of a
credential at most: an account name, a long mixed-case or base64 run, an address with a scheme. A weak part is reported
only if its complement stands within SCOPE code points of it: an account name or blob needs its counterpart (a secret, an
identifier), an address needs both. Parts meet in an interval join over cells of that size, so no part is compared with
another beyond the two neighbouring cells.

The work grows in line with a text: places come from prefix sums in levels of LEVEL, and parts are only compared within
cells. A text is one record and its spans are held together.

Defined results. Null text is empty; a row without a match gets empty spans, an empty table no rows. Repeated rows get the
same result each, null keys are kept, other columns are not read (so none can clash). Spans are code points, end exclusive.
Weak parts that overlap a base span are dropped, and are nobody's complement. Letters of key words match in either case as
ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

#: Fixed values of the contract: pattern, least code points of the whole match or of group 2.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "user", "blob", "endpoint")
USER = r"""(?i:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[^\s"'<>]+"""
#: Most code points between two parts of one credential.
SCOPE = 400
#: Numbers that are summed in one go.
LEVEL = 64


def _let(value: Column, f) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(numbers: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.aggregate(F.slice(numbers, start + 1, length), F.lit(0), lambda a, x: a + x)


def _sums(numbers: Column) -> Column:
    """Sums of each LEVEL numbers."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / LEVEL).cast("int")), lambda c: _total(numbers, c * LEVEL, LEVEL))


def before_each(numbers: Column, f) -> Column:
    """array of f(i, sum of the numbers before place i) of an array that is not empty: sums of sums, LEVEL at each of three levels (slices of the last one grow with its length, a LEVEL ** 2-th)."""

    def at(one: Column, two: Column, two_before: Column) -> Column:
        def place(i: Column) -> Column:
            c, d = F.floor(i / LEVEL).cast("int"), F.floor(i / (LEVEL * LEVEL)).cast("int")
            return F.get(two_before, d) + _total(one, d * LEVEL, c - d * LEVEL) + _total(numbers, c * LEVEL, i - c * LEVEL)

        return F.transform(numbers, lambda _, i: f(i, place(i)))

    def second(one: Column, two: Column) -> Column:
        before = F.transform(two, lambda _, d: _total(two, 0, d))
        return _let(before, lambda b: at(one, two, b))

    return _let(_sums(numbers), lambda one: _let(_sums(one), lambda two: second(one, two)))


def spans(text: Column, pattern: str, guard: str, kind: int, keep=None) -> Column:
    """array<struct<start, end, kind>> of the leftmost non-overlapping matches that keep(match) accepts; guard: a pattern found wherever one of those is."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def of(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))

        def span(i: Column, before: Column) -> Column:
            m, start = F.get(x["found"], i), before + F.length(F.get(x["gaps"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), (keep(m) if keep else F.lit(True)).alias("keep"))

        made = _let(sizes, lambda s: before_each(s, span))
        kept = F.transform(F.filter(made, lambda s: s["keep"]), lambda s: F.struct(s["start"], s["end"], s["kind"]))
        return F.when(F.size(x["found"]) > 0, kept).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(guard), _let(both, of)).otherwise(none)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, text_hash, base and weak (arrays of start, end, kind as a place in KINDS)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = [
        spans(t, ASSIGN, ASSIGN[:-2] + "{6,})", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        spans(t, ACCESS, ACCESS[:-1] + "{16,}", 1, lambda m: F.length(m) >= 20),
        spans(t, "[0-9a-f]{24,}", "[0-9a-f]{24}", 2),  # greedy runs of one class: the same matches as of HEX with 24 code points or more
    ]
    weak = [
        spans(t, USER, USER, 3),
        spans(t, BLOB, "[A-Za-z0-9+/]{32}", 4, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
        spans(t, ENDPOINT, "(?i:s|p|b|l|c|3)://", 5),
    ]
    return docs.select(key, F.xxhash64(t).alias("text_hash"), F.array_sort(F.concat(*base)).alias("base"), F.concat(*weak).alias("weak"))


def link(scanned: DataFrame, key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """scanned (a table that is cheap to read twice) with linked: the weak parts whose complements are within scope."""
    some = scanned.where(F.size("weak") > 0).select(F.col(key).alias("k"), "text_hash", "base", "weak").distinct()
    parts = some.select("k", "text_hash", F.explode(F.concat("base", "weak")).alias("p")).select("k", "text_hash", "p.*")

    def cells(before: int, after: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col("start") - before) / scope), F.floor((F.col("end") + after) / scope))).alias("cell")

    def meet(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
        """a joined to the parts of b that begin at most reach behind it and end at most reach before it; a reaches over its cells."""
        a = a.select("k", "text_hash", "start", "end", "kind", cells(reach, reach)).alias("a")
        b = b.select("k", "text_hash", "start", "end", "kind", cells(0, 0)).alias("b")
        near = (F.col("b.start") - reach < F.col("a.end") + (1 if reach else 0)) & (F.col("b.end") + reach > F.col("a.start") - (1 if reach else 0))
        on = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.cell") == F.col("b.cell")) & near
        return a.join(b, on)

    # user and access are identifiers, assign, hex and blob secrets
    sort = F.when(F.col("kind").isin(1, 3), "i").when(F.col("kind").isin(0, 2, 4), "s").otherwise("e")
    own = ["k", "text_hash", "start", "end", "kind"]
    weak, base = parts.where("kind >= 3"), parts.where("kind < 3")
    hidden = meet(weak, base, 0).select(*(F.col(f"a.{c}").alias(f"_{c}") for c in own)).distinct()
    clear = settled(weak.join(hidden, F.col("k").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("start") == F.col("_start")) & (F.col("kind") == F.col("_kind")), "left_anti"), "secret-parts")
    pairs = meet(clear, base.unionByName(clear), scope).select(*(F.col(f"a.{c}") for c in own), F.col("b.kind").alias("other")).withColumnRenamed("kind", "w_kind").withColumn("kind", F.col("other"))
    has = pairs.groupBy("k", "text_hash", "start", "end", "w_kind").agg(*(F.max(F.when(sort == s, 1).otherwise(0)).alias(s) for s in "is"))
    good = has.where(((F.col("w_kind") == 3) & (F.col("s") == 1)) | ((F.col("w_kind") == 4) & (F.col("i") == 1)) | ((F.col("w_kind") == 5) & (F.col("i") == 1) & (F.col("s") == 1)))
    linked = good.groupBy("k", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("w_kind").alias("kind")))).alias("linked"))
    r = linked.select(F.col("k").alias("_k"), F.col("text_hash").alias("_h"), "linked")
    return scanned.drop("weak").join(r, F.col(key).eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left").drop("_k", "_h")


def as_text(spans_: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, base and spans (arrays of start, end, kind); base spans are always among spans."""
    found = link(settled(scan(docs, key, text), "secrets"), key)
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return found.select(key, "base", F.concat("base", F.coalesce("linked", none)).alias("spans"))


def count_kind(spans_: Column, kind: int) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")


