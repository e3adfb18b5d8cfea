"""Line dedup by a segment-partition edit join. Native expressions and joins only.

Two lines of at least MIN_CHARS code points within EDITS edits are alike. Each line is cut into EDITS + 1 even segments;
of two alike lines, the longer one holds a segment of the shorter one unchanged, at a place that the edits before and
behind it bound. So a line is put under its own segments (its length, the segment's number and text) and, for each length
up to EDITS less, under the substrings of its own that could be such a segment. Entries with one line only, most of them,
go first: each task counts what it has read, so an entry that many lines share costs no task more than others. Lines that
share an entry are compared by a banded bit-parallel edit distance, in blocks of bounded size: a pair counts under the
first segment of the shorter line (of equal ones, that with the smaller hash) that the other holds, so it is compared
once. A block gives back, for each of its lines, the number of links, and the links that connect its components; pairs are
never rows. A line's links are the other lines that it is alike with, each copy counted. A class is a connected
component; its first line, by key and then place, stays, the others are repeats.

Defined results. Null text is one empty line; an empty table gives no rows. Shorter lines have no edit join: two edits
would make most words alike. With exact_short a shorter line that is not empty is in a class with its equals, without it
none is a repeat; empty lines never are. Blanks at a line's ends don't count. A line is compared whole, however long. Rows
with one key and one text are one document: each gets the same result; texts of one key (or of none) are different
documents, in the order of their hashes. Null keys come first. dedup_lines keeps all columns, judge_lines reads none but
key and text (its own columns can't clash with theirs: they aren't there). Lines, and texts of one key, are known by a
64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_prefix
from .shared import components, settled

EDITS = 2
MIN_CHARS = 24
#: Bits of the filters that keep most entries and lines out of shuffles: 4 MB, whatever the input (a full one lets all through).
FILTER_BITS = 1 << 25
#: Lines, and bytes of lines, on one side of a block.
BLOCK_NODES, BLOCK_BYTES = 128, 2 << 20
#: Letters whose counts rule pairs out: an edit changes the sum of their differences by two at most.
LETTERS = ("eE", "aA", "nN", "iI", "tT", "oO", "rR", "sS", "hH", "lL", "dD", "uU")


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc (hash of the text), line_no (from 0), line."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _shifts(edits: int, less: int, part: int) -> range:
    """Where segment ``part`` of a line that is ``less`` shorter can stand, from its own place: the edits before a segment shift it, and so do those behind it."""
    return range(max(-part, less - (edits - part)), min(part, less + (edits - part)) + 1)


def _segment(length: Column, part: Column | int, edits: int) -> tuple[Column, Column]:
    """Place (from 0) and size of a segment; they are even, the last ones one longer if they don't come out even."""
    parts = edits + 1
    part = part if isinstance(part, Column) else F.lit(part)
    longer, short = length % parts, F.floor(length / parts).cast("int")
    return short * part + F.greatest(F.lit(0), longer - (parts - part)), short + F.when(longer >= parts - part, 1).otherwise(0)


def entries(lines: DataFrame, edits: int) -> DataFrame:
    """node, bucket, part, rest, own for each thing that a line (node, line, n: its length) is put under.

    part and rest: number of the segment and length of the line that it would be one of; own: it is one of its own.
    """
    probes = [(less, part, shift) for less in range(edits + 1) for part in range(edits + 1) for shift in _shifts(edits, less, part)]
    # a row for each, computed in generated code: written out side by side, they would outgrow what the JVM compiles
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("less"), F.lit(b).alias("part"), F.lit(c).alias("shift")) for a, b, c in probes)))
    rows = lines.select("node", "line", "n", each.alias("e")).select("node", "line", "n", "e.less", "e.part", "e.shift", (F.col("n") - F.col("e.less")).alias("rest"))
    place, size = _segment(F.col("rest"), F.col("part"), edits)
    rows = rows.withColumns({"at": place + F.col("shift"), "size": size})
    inside = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    return inside.select("node", F.xxhash64("part", "rest", F.expr("substring(line, at + 1, size)")).alias("bucket"), "part", "rest", ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of arrays of characters if it is at most ``most``, else a number above it.

    Bit-parallel along the diagonals (Hyyrö 2003): bit k of each word stands for row j - most + k of column j. The score
    follows the lowest diagonal; the vertical differences of the last column lead from there to the last row.
    """
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def column(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        same = F.lit(0).cast("long")
        for k in range(width):
            same = same.bitwiseOR(F.when(F.get(a, j - most + k - 1) == c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), same.alias("same"))

    def diagonal(s: Column) -> Column:
        vp, vn, same = s["vp"], s["vn"], s["same"]
        zero = ((same.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(same).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["score"].alias("score"), zero.alias("zero"))

    def flat(s: Column) -> Column:
        up = s["vn"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["vp"])))
        score = s["score"] + F.when(s["zero"].bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
        return F.struct(up.alias("up"), s["zero"].bitwiseAND(s["vp"]).alias("down"), F.shiftright(s["zero"], 1).alias("zero"), score.alias("score"))

    def upright(s: Column) -> Column:
        vp = s["down"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["up"]))).bitwiseAND(F.lit(full))
        return F.struct(vp.alias("vp"), s["up"].bitwiseAND(s["zero"]).bitwiseAND(F.lit(full)).alias("vn"), s["score"].alias("score"))

    def let(value: Column, f) -> Column:
        """f of value, which is evaluated once."""
        return F.get(F.transform(F.array(value), f), 0)

    n, m = F.size(b), F.size(a)

    def step(s: Column, j: Column) -> Column:
        # the score never falls along the diagonal, and by n + most - m at most on the way to the last row
        return F.when(s["score"] > most + (n + most - m), s).otherwise(let(let(let(column(s, j), diagonal), flat), upright))

    start = F.struct(F.lit(full & ~((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).alias("score"))
    state = F.aggregate(F.sequence(F.lit(1), n), start, step)
    below = F.get(F.array(*(F.lit((top - 1) >> k << k).cast("long") for k in range(width))), m - n + most)
    exact = let(state, lambda s: (s["score"] - F.bit_count(s["vp"].bitwiseAND(below)) + F.bit_count(s["vn"].bitwiseAND(below))).cast("int"))
    return F.when(F.abs(m - n) > most, most + 1).when(n == 0, m).otherwise(exact)


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)(.)"), F.lit(1))


def possibly(rows: DataFrame, wanted: DataFrame, column: str = "node", bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose column (a hash) may be among wanted's: a bitmap of a fixed size, which every task gets, lets through a few more."""
    slot = F.pmod(F.col(column), F.lit(bits))
    page = 32_768  # bits of a bitmap_construct_agg
    bits_of = wanted.select((slot / page).cast("int").alias("_page"), (slot % page).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    # as 64-bit words, first byte first, so that a test is a shift
    words = F.transform(F.sequence(F.lit(0), F.lit(page // 64 - 1)), lambda i: F.conv(F.hex(F.substring("_map", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    empty = F.array_repeat(F.lit(0).cast("long"), page // 64)
    # one row with all of it, bits / page pieces of 4 KB: a row's test is a look into an array, where a page looked up by a join took longer than the entries themselves
    every = wanted.sparkSession.range(bits // page).select(F.col("id").cast("int").alias("_page")).join(bits_of, "_page", "left")
    pieces = F.array_sort(F.collect_list(F.struct("_page", F.when(F.col("_map").isNull(), empty).otherwise(words).alias("w"))))
    whole = every.agg(F.flatten(F.transform(pieces, lambda x: x["w"])).alias("_words"))
    at = slot.cast("int")
    inside = F.lit(56) - F.shiftright(at % 64, 3) * 8 + at % 8
    hit = F.call_function("shiftright", F.get("_words", F.shiftright(at, 6)), inside).bitwiseAND(F.lit(1).cast("long")) != 0
    return rows.crossJoin(F.broadcast(whole)).where(hit).drop("_words")


def _let(value: Column, f) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within that many edits; what they begin and end with alike is left out."""

    def ends(r: Column) -> Column:
        k = common_prefix(F.reverse(r["a"]), F.reverse(r["b"]))
        return F.struct(F.substring(r["a"], F.lit(1), F.length(r["a"]) - k).alias("a"), F.substring(r["b"], F.lit(1), F.length(r["b"]) - k).alias("b"))

    rest = _let(common_prefix(a, b), lambda p: F.struct(F.substring(a, p + 1, F.length(a)).alias("a"), F.substring(b, p + 1, F.length(b)).alias("b")))
    cut = _let(rest, lambda r: _let(ends(r), lambda x: F.struct(characters(x["a"]).alias("a"), characters(x["b"]).alias("b"))))
    return _let(cut, lambda x: edit_distance(x["a"], x["b"], edits)) <= edits


def blocks(rows: DataFrame, block: int = BLOCK_NODES, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (bucket, node, line, ...) as often as their part of a bucket meets another: with _blocks (parts of the bucket), _own (the row's part), _i and _j (what meets)."""
    sizes = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("line")) / most_bytes)).cast("int").alias("_blocks"))
    sizes = settled(sizes, "line-blocks")  # a table of its own, so that a large bucket can be split where it is joined
    dealt = rows.join(sizes, "bucket").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    return dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")}).drop("_with")


def linked(rows: DataFrame, edits: int, block: int = BLOCK_NODES) -> DataFrame:
    """Blocks (m: array of node and copies; adj: for each of m, the places behind it in m of the lines that it links with).

    rows: bucket, part, rest, own, node, line, n, copies and LETTERS' counts. m is in order of length, then hash.
    """
    counts = [f"n{i}" for i in range(len(LETTERS))]
    member = F.struct("n", "node", "own", "_own", "copies", "line", *counts)
    held = blocks(rows, block).groupBy("bucket", "part", "rest", "_i", "_j").agg(F.array_sort(F.collect_list(member)).alias("m")).where(F.size("m") > 1)

    def first(a: Column, b: Column) -> Column:
        """Whether b, the longer, holds none of a's segments before this one where an edit join looks for it."""
        out = F.lit(True)
        for part in range(edits):
            at, size = _segment(a["n"], part, edits)
            own = F.substring(a["line"], at + 1, size)
            has = F.lit(False)
            for less in range(edits + 1):
                for shift in _shifts(edits, less, part):
                    has = has | ((b["n"] - a["n"] == less) & (F.substring(b["line"], at + (1 + shift), size) == own))
            out = out & ((F.col("part") <= part) | ~has)
        return out

    def link(a: Column, b: Column) -> Column:
        apart = sum((F.abs(a[c] - b[c]) for c in counts), F.lit(0))
        meets = (F.col("_i") == F.col("_j")) | (a["_own"] != b["_own"])
        return meets & (b["n"] - a["n"] <= edits) & (apart <= 2 * edits) & first(a, b) & alike(a["line"], b["line"], edits)

    def of(i: Column, a: Column) -> Column:
        behind = F.sequence(i + 1, F.size("m") - 1)
        found = F.filter(behind, lambda j: _let(F.get("m", j), lambda b: link(a, b)))
        # only one with that segment of its own is the shorter one of a pair here
        return F.when(a["own"] & (a["n"] == F.col("rest")), found).otherwise(F.array().cast("array<int>"))

    adj = F.transform(F.sequence(F.lit(0), F.size("m") - 2), lambda i: _let(F.get("m", i), lambda a: of(i, a)))
    return held.select(F.transform("m", lambda x: F.struct(x["node"], x["copies"])).alias("lines"), adj.alias("adj")).withColumnRenamed("lines", "m")


def link_counts(adjacent: DataFrame) -> DataFrame:
    """node, others (lines that it links with, copies counted) of linked()'s blocks."""
    zipped = F.transform("adj", lambda js, i: F.struct(js.alias("js"), F.get("m", i)["copies"].alias("copies")))

    def of(x: Column, j: Column, z: Column) -> Column:
        ahead = F.aggregate(F.coalesce(F.get("adj", j), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda s, k: s + F.get("m", k)["copies"])
        back = F.aggregate(z, F.lit(0).cast("long"), lambda s, y: s + F.when(F.array_contains(y["js"], j), y["copies"]).otherwise(F.lit(0).cast("long")))
        return F.struct(x["node"].alias("node"), (ahead + back).alias("others"))

    each = F.explode(F.filter(_let(zipped, lambda z: F.transform("m", lambda x, j: of(x, j, z))), lambda x: x["others"] > 0))
    return adjacent.where(F.exists("adj", lambda js: F.size(js) > 0)).select(each.alias("x")).select("x.*").groupBy("node").agg(F.sum("others").alias("others"))


def link_edges(adjacent: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the links of each block connect: a star for each of its components."""
    groups = F.transform("adj", lambda js, i: F.when(F.size(js) > 0, F.concat(F.array(i), js)).otherwise(js))

    def joined(label: Column, group: Column) -> Column:
        own = F.array_distinct(F.transform(group, lambda k: F.get(label, k)))
        merged = _let(own, lambda s: F.when(F.size(s) < 2, label).otherwise(_let(F.array_min(s), lambda low: F.transform(label, lambda x: F.when(F.array_contains(s, x), low).otherwise(x)))))
        return F.when(F.size(group) < 2, label).otherwise(merged)

    label = F.aggregate(groups, F.sequence(F.lit(0), F.size("m") - 1), joined)
    pairs = F.explode(F.filter(F.transform(label, lambda x, j: F.struct(F.get("m", j)["node"].alias("a"), F.get("m", x)["node"].alias("b"))), lambda x: x["a"] != x["b"]))
    return adjacent.where(F.exists("adj", lambda js: F.size(js) > 0)).select(pairs.alias("x")).select("x.*").distinct()


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """node (hash of a line), component (the smallest node of its class), n_links; lines that are like no other text are absent."""
    if min_chars <= edits:
        raise ValueError("lines must be longer than the number of edits")
    lines = split_lines(docs, key, text).where(F.length("line") >= min_chars).select(F.xxhash64("line").alias("node"), "line", F.length("line").alias("n"))
    put = entries(lines, edits)
    busy = put.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("own").alias("own")).where("low < high and own").select("bucket")
    busy = settled(busy, "line-buckets")
    held = possibly(put, busy, "bucket").groupBy("bucket", "part", "rest", "node").agg(F.max("own").alias("own"))
    rows = settled(held.join(busy, "bucket"), "line-entries")
    wanted = rows.select("node").distinct()
    counts = [(F.length("line") - F.length(F.translate("line", pair, ""))).alias(f"n{i}") for i, pair in enumerate(LETTERS)]
    # no semi-join: that would be moved below the filter
    texts = possibly(lines, wanted).groupBy("node", "line", "n").agg(F.count(F.lit(1)).alias("copies")).join(wanted, "node")
    texts = settled(texts.select("node", "line", "n", "copies", *counts), "line-texts")
    adjacent = settled(linked(rows.join(texts, "node"), edits), "line-links")
    part = components(link_edges(adjacent), "lines")
    own = link_counts(adjacent).join(texts.select("node", "copies"), "node")
    return settled(part.join(own, "node").select("node", "component", (F.col("others") + F.col("copies") - 1).alias("n_links")), "line-classes")


def judged(docs: DataFrame, key: str, text: str, edits: int, min_chars: int, exact_short: bool) -> DataFrame:
    """Every line of docs: key, doc (hash of its text), line_no, class_id, class_lines, n_links, kept."""
    classes = line_classes(docs, key, text, edits, min_chars)
    least = 1 if exact_short else min_chars
    lines = split_lines(docs, key, text).select("key", "doc", "line_no", F.length("line").alias("n"), F.xxhash64("line").alias("node"))
    alone = lines.where(F.col("n") < least).select("key", "doc", "line_no", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_lines"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    short = lines.where(F.col("n").between(least, min_chars - 1)).select("key", "doc", "line_no", F.col("node").alias("class_id"), F.lit(None).cast("long").alias("n_links"))
    long = lines.where(F.col("n") >= max(min_chars, least)).join(classes, "node", "left").select("key", "doc", "line_no", F.coalesce("component", "node").alias("class_id"), "n_links")
    placed = settled(short.unionAll(long), "lines")
    firsts = placed.groupBy("class_id").agg(F.min(F.struct("key", "doc", "line_no")).alias("first"), F.count(F.lit(1)).alias("class_lines"))
    firsts = settled(firsts.where("class_lines > 1"), "line-firsts")  # a table of its own, so that a large class can be split where it is joined
    out = placed.join(firsts, "class_id", "left")
    kept = F.col("class_lines").isNull() | (F.col("first.key").eqNullSafe(F.col("key")) & (F.col("first.doc") == F.col("doc")) & (F.col("first.line_no") == F.col("line_no")))
    links = F.coalesce("n_links", F.col("class_lines") - 1, F.lit(0)).cast("long")  # a line that is like no other text has its copies
    out = out.select("key", "doc", "line_no", "class_id", F.coalesce("class_lines", F.lit(1)).cast("long").alias("class_lines"), links.alias("n_links"), kept.alias("kept"))
    return out.unionAll(alone)


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """Every line of docs: key, line_no, class_id (hash of a line of the class; null for one in no class), class_lines (lines of that class), n_links (other lines that it is alike with, copies counted), kept."""
    return judged(docs, key, text, edits, min_chars, exact_short).drop("doc").withColumnRenamed("key", key)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """docs without repeated lines; a document of which nothing is left goes, one that had no line to lose stays."""
    repeats = judged(docs, key, text, edits, min_chars, exact_short).where("not kept").groupBy(F.col("key").alias("_k"), F.col("doc").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = docs.join(repeats, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(F.col(text)) == F.col("_doc")), "left").withColumn(text, new)
    return out.where(F.col("_gone").isNull() | (F.length(text) > 0)).select(*docs.columns)
