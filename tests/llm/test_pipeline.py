from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

import brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark, tmp_path):
    """run() on a small table, stage by stage by the plain versions; lines, copies, sources and junk all change its rows."""
    random.seed(12)
    words = {"en": "the quick brown fox jumps over lazy dogs while sun shines".split(), "de": "der schnelle braune fuchs springt über faule hunde während sonne scheint".split()}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        body = [" ".join(random.choice(words[lang]) + random.choice(["", f"{random.randint(0, 99)}"]) for _ in range(random.randint(6, 14))) for _ in range(random.randint(1, 8))]
        if i % 4 == 0:
            body.insert(random.randint(0, len(body)), "All rights are reserved by the authors" + random.choice(["", "!", "."]))
        rows.append((i, "\n".join(body), lang if i % 5 else None, "src" + "abbbbb"[i % 6]))
    rows += [(200 + i, rows[3 * i][1] + random.choice(["", " and more"]), "en", "srca") for i in range(12)]
    rows += [(300, None, None, "srca"), (301, "12 !? 3", "en", "srcb"), (302, "", None, None), (303, rows[1][1], "en", None)]
    long = [random.choice(words["en"]) + str(k) for k in range(150)]  # one line, so that only whole documents are near each other
    rows += [(400 + k, " ".join([*long[: 20 * k], f"elsewhere{k}", *long[20 * k + 1 :]]), "en", "srcb") for k in range(5)]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    model = brute.Bayes([(t, k) for i, t, k, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    said = {i: model.predict(t) for i, t, _, _ in rows}
    texts = {i: t for i, t, _, _ in rows if said[i][0] != "und" and said[i][1] >= P.LEAST_SCORE}
    assert len(rows) - len(texts) >= 3
    left = brute.without_repeated_lines(texts)
    assert len(left) < len(texts) and any(left[i] != texts[i] for i in left)
    heads = brute.near_duplicate_heads(left)
    kept = {i: t for i, t in left.items() if heads[i] == i}
    assert len(kept) < len(left)
    source = {i: s for i, _, _, s in rows}
    known = [(i, source[i], max(1, len(t.split())), t) for i, t in kept.items()]
    ids = spark.createDataFrame([(i, n, t, p) for i, _, n, t in known for p in range(5)], "doc long, n_tokens long, text string, pass int")
    order = {(r.doc, r[1]): r.h for r in ids.select("doc", "pass", F.xxhash64(F.lit(42), "pass", "doc", "n_tokens", F.xxhash64("text")).alias("h")).collect()}
    drawn, _ = brute.draws(known, lambda r, p: order[r[0], p], most_repeats=P.MOST_REPEATS)
    assert len(drawn) > len(kept)
    lib = Tokenizer.from_file(P.tokenizer(P.BYTE_TOKENIZER))
    want = []
    for r, *_ in drawn:
        own = [*lib.encode(r[3], add_special_tokens=False).ids, P.END_ID]
        first = len(own) % 1024 or 1024
        cuts = [0, *range(first, len(own) + 1, 1024)]
        want += [(r[0], n, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= math.ceil(sum(r.length for r in got) / 1024) * 1.1 + 1


def test_stages_take_nulls_repeats_empty_tables_and_more_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, sequence_id int, node long, pass int"
    text = "some words of a document that has a few lines\nand this is the second one of them"
    rows = [(None, None, None, None, None, None, None, None, None), (1, text, "en", "s", 80, "k", 1, 2, 3), (1, text, "en", "s", 80, "k", 1, 2, 3), (None, "other words that stand alone here", "en", None, 3, None, 4, 5, 6), (2, "", "en", "s", 0, "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, kind)
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0 and (name == "packing" or out.columns == docs.columns)
        texts = [r.text for r in out.collect()] if name != "packing" else None
        if name == "language":
            assert sorted(t for t in texts if t) == sorted([text, text, rows[3][1]]) and None not in texts and "" not in texts
        if name in ("lines", "near_duplicates"):
            assert texts.count(None) == 1 and rows[3][1] in texts and text in texts
        if name == "near_duplicates":
            assert texts.count(text) == 1
        if name == "mixing":
            assert set(texts) == {r[1] for r in rows} and texts.count(text) % 2 == 0
        if name == "packing":
            assert out.count() == 5


def test_texts_of_one_key_are_documents_of_their_own(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = "this line is long enough to be a repeat", "quite another line that only one text has", "and a third one, of the last text with a key"
    rows = [(None, f"{a}\nzz", "en", "s", 0), (None, f"{b}\n{a}", "en", "s", 0), (7, f"{a}\n{c}", "en", "s", 0), (7, "only here, under a key that is used twice", "en", "s", 0)]
    out = [r.text for r in P.dedup_lines(spark, spark.createDataFrame(rows, kind), "").collect()]
    held = "\n".join(out).split("\n")
    assert sorted(held) == sorted([a, "zz", b, c, rows[3][1]])  # each once, and the unique ones all there

    words = [f"w{i}" for i in range(120)]
    near = " ".join(words)
    other = " ".join(reversed(words))
    alone = " ".join(f"v{i}" for i in range(60))
    rows = [(None, near), (None, f"{near} x"), (None, f"{near} y"), (None, alone), (None, alone), (3, f"{other} x"), (3, f"{other} y"), (3, f"{other} y"), (3, "another text under key three"), (4, other), (None, f"{other} z")]
    out = P.dedup_documents(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in rows], kind), "")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text[:7]) for r in out.collect())
    assert got == [(False, 3, "another"), (False, 3, other[:7]), (True, 0, "v0 v1 v"), (True, 0, "w0 w1 w")]
