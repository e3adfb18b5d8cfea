"""Queries over whole tables: by brute force, as their registered SQL leaves rows out."""

from __future__ import annotations

import hashlib

import duckdb
from pyspark.sql import functions as F

from stepweave.operators import pairs
from stepweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def steps_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return {d.doc_id: [x for x in (y.strip(" ") for y in (d.text or "").split("\n")) if x] for d in docs}


def grid(n, k, most):
    """Candidates in order and their choice, as the reference has them."""
    all_pairs = [(k - 1, k), *((g, k) for g in range(k - 2, -1, -1)), *((k - 1, b) for b in range(k + 1, n)), *((g, b) for b in range(k + 1, n) for g in range(k - 2, -1, -1))]
    if len(all_pairs) <= most:
        return all_pairs
    rest = all_pairs[1:]
    return [all_pairs[0], *(rest[round(i * (len(rest) - 1) / (most - 2))] for i in range(most - 1))]


def test_g8_grids_of_any_size(spark):
    shapes = [(n, k) for n in range(2, 13) for k in range(1, n)] + [(300, 120), (1000, 1), (1000, 999)]
    rows = [(i, ["+"] * k + ["-"] * (n - k)) for i, (n, k) in enumerate(shapes)]
    got = {}
    for r in pairs.all_good_vs_all_bad(spark.createDataFrame(rows, "key long, signs array<string>")).collect():
        got.setdefault(r.key, []).append((r.good, r.bad))
    assert got == {i: grid(n, k, 6) for i, (n, k) in enumerate(shapes)}


def test_g8_leaves_no_document_out(spark):
    want = {}
    for key, steps in steps_of(spark).items():
        signs = [int(hashlib.sha256(f"bad:{key}:{i}".encode()).hexdigest()[:8], 16) % 7 == 0 for i in range(len(steps))]
        if True in signs[1:] and not signs[0]:
            want[key] = grid(len(signs), signs.index(True), 6)
    got = {}
    for r in QUERIES["g8_g11_good_bad_grid"](spark, SF).collect():
        k = want[r.key][0][1]
        assert abs(r.confidence - max(0.74 - 0.04 * min(k - 1 - r.good, 4) - 0.03 * min(r.bad - k, 4), 0.55)) < 1e-9
        got.setdefault(r.key, []).append((r.good, r.bad))
    assert got == want and any(len(p) == 6 for p in got.values())


def test_g17_rates_every_event(spark, tmp_path):
    values = {1: [20.0, 1.0], 2: [8.0, 0.5], 3: [20.0, 16.0], 4: [1.0], 5: [15.0, *([7.0] * 150), 2.0]}
    rows = [(i, u, v) for i, (u, v) in enumerate(((u, v) for u, own in values.items() for v in own), 7)]
    sf = written(spark, tmp_path, "events", rows, "event_id long, user_id long, value double")
    got = {(r.key, r.step, r.confidence) for r in QUERIES["g17_rated_pairs"](spark, sf).collect()}
    assert got == {(1, 0, 0.78), (2, 0, 0.70), (5, 0, 0.78)}


def test_g17_matches_brute_force(spark):
    own = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "value").collect():
        own.setdefault(e.user_id, []).append(1 if e.value > 14 else 0 if e.value > 6 else -1)
    want = {u: 0.78 if max(r) == 1 else 0.70 for u, r in own.items() if max(r) >= 0 and min(r) < 0}
    assert {r.key: r.confidence for r in QUERIES["g17_rated_pairs"](spark, SF).collect()} == want


def test_w1_prefixes_of_all_steps(spark):
    want = {(d, i): "\n".join(s[: i + 1]) for d, s in steps_of(spark).items() for i in range(len(s))}
    got = {(r.doc_id, r.step): (r.prefix_sha, r.prefix_chars) for r in QUERIES["w1_g3_prefixes"](spark, SF).collect()}
    assert got == {k: (hashlib.sha256(x.encode()).hexdigest(), len(x)) for k, x in want.items()} and max(i for _, i in got) >= 12


def test_w20_compares_whole_lines(spark, tmp_path):
    own = ["the same beginning, then one", "the same beginning, then two", "the same beginning, then two", "the same beginning, then two and more", "😀" * 40 + "a", "😀" * 40 + "b", "x" * 5000 + "y", "x" * 5000]
    sf = written(spark, tmp_path, "documents", [(1, "\n".join(own), "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.step: r.first_difference for r in QUERIES["w20_first_difference"](spark, sf).collect()}
    assert got == {0: 26, 1: None, 2: 29, 3: 1, 4: 41, 5: 1, 6: 5001}


def test_w20_matches_brute_force(spark):
    def first(a, b):
        return None if a == b else next((i for i, (x, y) in enumerate(zip(a, b, strict=False), 1) if x != y), min(len(a), len(b)) + 1)

    want = {(d, i): first(a, b) for d, s in steps_of(spark).items() for i, (a, b) in enumerate(zip(s, s[1:], strict=False))}
    assert {(r.doc_id, r.step): r.first_difference for r in QUERIES["w20_first_difference"](spark, SF).collect()} == want


def test_g9_has_all_steps(spark):
    want = {}
    for d, s in steps_of(spark).items():
        bad = [i for i in range(len(s)) if int(hashlib.sha256(f"bad:{d}:{i}".encode()).hexdigest()[:8], 16) % 7 == 0]
        want |= {(d, i): min(bad, key=lambda n: (abs(n - i), n)) for i in range(len(s)) if i not in bad and bad}
    got = {(r.doc_id, r.positive): r.negative for r in QUERIES["g9_nearest_negative"](spark, SF).collect()}
    assert got == want and max(i for _, i in got) > 40


def test_j19_has_all_steps(spark, tmp_path):
    number = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    good = [i for i in range(5000) if all(number(f"bad:{i}:{k}") % 7 for k in range(30))]  # few traces of that length are
    docs = [(i, "\n".join(["line"] * 30)) for i in [*range(30), *good[:9]]]
    docs = list(dict(docs).items())
    sf = written(spark, tmp_path, "documents", [(*d, "en", "s") for d in docs], "doc_id long, text string, lang string, source string")
    at = {}
    for i, text in docs:
        n = text.count("\n") + 1
        wrong = any(number(f"bad:{i}:{k}") % 7 == 0 for k in range(n))
        for k in range(n):
            at.setdefault(k, ([], []))[wrong].append(number(f"{i}:{k}"))
    want = {k: (len(c), len(w), sum(x > y for x in c for y in w) / len(c) / len(w)) for k, (c, w) in at.items() if min(len(c), len(w)) >= 5}
    assert max(want) == 29
    got = {r.step: (r.n_correct, r.n_error, r.p_above) for r in QUERIES["j19_stepwise_separation"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-8 for k in want)


def test_c19_words_end_as_in_sql(spark, tmp_path):
    lines = ["est bo ci\u00f3n\u00f1do ares is", "que\u017f wa\u017f it", "Is  NOT \u00e9", "plain is", "\u00e9is\x0bnot so", "nothing"]
    sf = written(spark, tmp_path, "documents", [(i, "\n".join([x]), "en", "s") for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.mutated for r in QUERIES["c19_negation"](spark, sf).collect()}
    assert got == {0: "est bo ci\u00f3n\u00f1do not ares is", 2: "Is \u00e9", 3: "plain is not", 4: "\u00e9is not\x0bnot so"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    assert got == {r[0]: r[2] for r in con.execute(ORACLES["c19_negation"]).fetchall()}


def test_k15_first_of_equal_prices(spark, tmp_path):
    rows = [(1, 10, 5.0), (1, 11, 9.0), (1, 3, 9.0), (1, 12, 5.0), (2, 20, None), (None, 30, 1.0), (None, 31, 1.0), (3, None, 7.0), (3, 40, 2.0), (3, 41, float("nan")), (3, 42, float("nan"))]
    frame = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_extendedprice double").coalesce(1)
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: (r.best, r.worst) for r in QUERIES["k15_best_epoch"](spark, str(tmp_path)).collect()}
    assert got == {1: (11, 10), 2: (None, None), None: (30, 30), 3: (41, 40)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == {r[0]: r[1:] for r in con.execute(ORACLES["k15_best_epoch"]).fetchall()}


def test_g9_caps_by_sizes_of_prefixes(spark):
    texts = {0: ["x"] * 40, 1: ["a long first step of words"] * 300, 2: ["\x1c", "ab  c\td", "\u3000", "ab c d e f g h", "more words come", "\x85 more words come"] * 3, 3: ["w" * 5, "w" * 200, "only", "a b c d e f g"]}
    signs = {k: ["-" if i % 3 == 2 else "+" for i in range(len(v))] for k, v in texts.items()}
    rows = spark.createDataFrame([(k, v, signs[k]) for k, v in texts.items()], "key long, steps array<string>, signs array<string>")
    got = {}
    for r in pairs.convert_steps(rows, "legacy_nearest", F.lit("s"), F.lit("d"), F.lit("q"), 3).collect():
        got.setdefault(r.key, []).append((r.good, r.bad, r.q.chosen_chars, r.q.rejected_chars, round(r.q.token_overlap_ratio, 9)))
    want = {}
    for k, steps in texts.items():
        for g in (i for i, s in enumerate(signs[k]) if s == "+"):
            b = min((abs(i - g), i) for i, s in enumerate(signs[k]) if s == "-")[1]
            c, r = (" ".join(" ".join(steps[: i + 1]).split()) for i in (g, b))
            both, either = len(set(c.split()) & set(r.split())), len(set(c.split()) | set(r.split()))
            if c != r and min(len(c), len(r)) >= 12 and max(len(c), len(r)) <= 4 * min(len(c), len(r)) and both / max(either, 1) <= 0.995 and len(want.get(k, [])) < 3:
                want.setdefault(k, []).append((g, b, len(c), len(r), round(both / either, 9)))
    assert {k: sorted(v) for k, v in got.items()} == want and want
    sizes = spark.createDataFrame([(texts[2],)], "steps array<string>").select(pairs.prefix_sizes(F.col("steps")).alias("s")).first().s
    assert [(x.chars, x.words) for x in sizes] == [(len(p), len(set(p.split()))) for p in (" ".join(" ".join(texts[2][: i + 1]).split()) for i in range(len(texts[2])))]
    # the plan squashes each text once for its flags and once for its id, not once for each condition of the filter
    plan = pairs.convert_steps(rows, "legacy_nearest", F.lit("s"), F.lit("d"), F.lit("q"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20
