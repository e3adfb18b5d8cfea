from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from stepweave.llm import lines as L

from brute import distance, find


def edited(text, n, letters):
    out = list(text)
    for _ in range(n):
        at, kind = random.randrange(len(out) + 1), random.random()
        if kind < 0.4 and out:
            out[min(at, len(out) - 1)] = random.choice(letters)
        elif kind < 0.7:
            out.insert(at, random.choice(letters))
        elif out:
            out.pop(min(at, len(out) - 1))
    return "".join(out)


def test_banded_distance(spark):
    random.seed(3)
    pairs = []
    for _ in range(800):
        a = "".join(random.choice("abcé😀") for _ in range(random.randint(0, 14)))
        pairs.append((a, edited(a, random.randint(0, 4), "abc😀"), ))
    pairs = [(a, b, distance(a, b)) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for most in (1, 2, 3):
        got = df.select("d", L.edit_distance(L.characters(F.col("a")), L.characters(F.col("b")), most).alias("x"))
        assert got.where(f"(x <= {most}) <> (d <= {most}) or (d <= {most} and x <> d)").count() == 0


def classes_of(texts):
    parent = {u: u for u in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if abs(len(a) - len(b)) <= L.EDITS and distance(a, b) <= L.EDITS:
            parent[find(a)] = find(b)
    return {u: find(u) for u in parent}


def test_classes_match_brute_force(spark):
    random.seed(4)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(26, 44))).strip() + "q" * 8 for _ in range(30)]
    hot = "the same line that many documents repeat, but for a letter"
    made = [edited(b, random.randint(0, 3), "yz") for b in base for _ in range(4)] + [edited(hot, random.randint(0, 5), "yzxw") for _ in range(50)]
    random.shuffle(made)
    docs = [(i, "\n".join(made[i::30])) for i in range(30)] + [(100, None), (101, ""), (102, "short\nshort"), (None, made[0]), (5, "\n".join(made[5::30]))]
    got = L.judge_lines(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as line", "2 as node")).collect()
    lines = {(i, n): line.strip(" ") for i, t in docs for n, line in enumerate((t or "").split("\n"))}
    want = classes_of({x for x in lines.values() if len(x) >= L.MIN_CHARS})
    seen = {}
    for r in got:
        line = lines[r.doc_id, r.line_no]
        if len(line) < L.MIN_CHARS:
            assert r.class_id is None and r.kept
        else:
            assert seen.setdefault(want[line], r.class_id) == r.class_id
    assert len(set(seen.values())) == len(seen)
    firsts = {}
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.line_no)):
        if r.class_id is not None and r.kept:
            firsts.setdefault(r.class_id, (r.doc_id, r.line_no))
            assert firsts[r.class_id] == (r.doc_id, r.line_no)
    assert set(firsts) == set(seen.values())


def test_dedup_keeps_columns_and_clean_documents(spark):
    long_a, long_b = "this line is long enough to be a repeat", "and this one is quite another long line"
    rows = [(1, f"{long_a}\nx\n{long_b}", "s"), (2, f"y\n{long_a}!", "s"), (3, long_b, "t"), (4, None, None), (5, "", "u"), (6, "ok\nok", "u")]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line string")).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "y" and 3 not in out
    assert out[4].text is None and out[5].text == "" and out[6].text == "ok\nok" and out[1].line == "s"
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_and_stage_class_short_lines(spark, tmp_path):
    import corpus_pipeline as P
    from stepweave.llm.queries import op5_lines

    rows = [(1, "Les.\n\n all rights \nok"), (2, "Les.\n\nall rights\nno"), (3, "Les."), (4, "ok\nok")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r for r in op5_lines(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if not r.kept} == {(2, 0), (2, 2), (3, 0), (4, 0), (4, 1)}
    assert got[1, 0].class_id == got[2, 0].class_id == got[3, 0].class_id and got[1, 0].class_lines == 3 == got[4, 1].class_lines
    assert got[1, 1].class_id is None and got[2, 1].kept and len({r.class_id for r in got.values()}) == 5
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    assert {(r.doc_id, r.text, r.n_chars) for r in P.dedup_lines(spark, docs, "").collect()} == {(1, rows[0][1], 21), (2, "\nno", 3)}


def test_links_of_every_line(spark, tmp_path):
    from stepweave.llm.queries import op5_lines

    random.seed(6)
    hot = "the same line that many documents repeat, but for a letter"
    made = [edited(hot, random.randint(0, 3), "yzxw") for _ in range(60)] + ["".join(random.choice("abc ") for _ in range(24)) + "!" for _ in range(20)] + [hot] * 5 + ["short"] * 3 + [""]
    random.shuffle(made)
    docs = [(i, "\n".join(made[i::9])) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {(i, n): line.strip(" ") for i, t in docs for n, line in enumerate(t.split("\n"))}

    def linked(a, b):
        return a == b != "" if min(len(a), len(b)) < L.MIN_CHARS else abs(len(a) - len(b)) <= L.EDITS and distance(a, b) <= L.EDITS

    texts = sorted(set(lines.values()))
    of = {t: {u for u in texts if linked(t, u)} for t in texts}
    want = {k: sum(x in of[t] for x in lines.values()) - (t != "") for k, t in lines.items()}
    assert {(r.doc_id, r.line_no): r.n_links for r in op5_lines(spark, str(tmp_path)).collect()} == want


def test_blocks_count_each_link_once(spark):
    random.seed(9)
    hot = "a line that stands in very many texts with a change or two"
    texts = sorted({edited(hot, random.randint(0, 3), "yzxw ") for _ in range(70)} | {edited(hot, 1, "é") + "!" for _ in range(10)})
    lines = spark.createDataFrame([(t,) for t in texts], "line string").selectExpr("xxhash64(line) as node", "line", "length(line) as n")
    rows = L.entries(lines, L.EDITS).groupBy("bucket", "part", "rest", "node").agg(F.max("own").alias("own"))
    counts = [(F.length("line") - F.length(F.translate("line", pair, ""))).alias(f"n{i}") for i, pair in enumerate(L.LETTERS)]
    full = rows.join(lines.select("node", "line", "n", F.lit(1).cast("long").alias("copies"), *counts), "node")
    node = {r.line: r.node for r in lines.collect()}
    want = {node[t]: sum(u != t and abs(len(t) - len(u)) <= 2 and distance(t, u) <= 2 for u in texts) for t in texts}
    for block in (7, 1000):
        adjacent = L.linked(full, L.EDITS, block).cache()
        assert {r.node: r.others for r in L.link_counts(adjacent).collect()} == {k: n for k, n in want.items() if n}
        parent = {n: n for n in want}
        for r in L.link_edges(adjacent).collect():
            a, b = (find(parent, x) for x in (r.a, r.b))
            parent[max(a, b)] = min(a, b)
        plain = classes_of(set(texts))
        groups = {}
        for t in texts:
            assert groups.setdefault(plain[t], find(parent, node[t])) == find(parent, node[t])
        assert len(set(groups.values())) == len(groups)


def test_very_long_lines_and_clashing_columns(spark):
    random.seed(10)
    long = "".join(random.choice("abcdefgh ") for _ in range(30_000)) + "."
    near = long[:100] + "X" + long[100:20_000] + long[20_001:]
    far = long[:100] + "X" + long[100:20_000] + "YY" + long[20_000:]
    rows = [(1, long, 7, 0), (2, near, 8, 0), (3, far, 9, 0), (4, "x\n" + long, 5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id long, key long")
    got = {(r.doc_id, r.line_no): r for r in L.judge_lines(df).collect()}
    assert [got[k].n_links for k in ((1, 0), (2, 0), (3, 0), (4, 1))] == [2, 2, 0, 2] and got[4, 0].class_id is None and not got[4, 1].kept
    out = L.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text[:1], r.class_id, r.key) for r in out] == [(1, long[0], 7, 0), (3, far[0], 9, 0), (4, "x", 5, 0)]


def test_filter_by_one_bitmap(spark):
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("node"))
    bits = 1 << 20
    for wanted in (rows.where("node % 7 = 0"), rows.where("false"), rows.where("node % 500 = 3")):
        slots = {r.node % bits for r in wanted.collect()}
        q = L.possibly(rows, wanted, bits=bits)
        assert {r.node for r in q.collect()} == {r.node for r in rows.collect() if r.node % bits in slots}
    # a row meets the whole bitmap: looked up by page in a join, it took longer than the rows themselves
    plan = q._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert plan[1].startswith("+- BroadcastNestedLoopJoin")
