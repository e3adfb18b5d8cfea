from __future__ import annotations

import random

import numpy as np

from stepweave.llm import minhash as M


def bags_of(texts):
    t, h, c, starts = M.shingles(texts)
    return [h[a:b].tobytes() + c[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:], strict=False)]


def brute_classes(keys, texts):
    bags = bags_of(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i]) and len(bags[j]) and M.similarity(bags[i], bags[j]) >= M.THRESHOLD:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(keys[i])
    return {k: min(g) for g in groups.values() for k in g}


def test_signature_is_unbiased_for_multisets():
    rng = np.random.default_rng(5)
    errors = []
    for trial in range(40):
        words = [f"{trial}w{i}" for i in rng.integers(0, 60, 150)]
        other = [w if rng.random() > 0.02 else "x%d" % rng.integers(50) for w in words] + words[:20]
        texts = [" ".join(words), " ".join(other)]
        t, h, c, _ = M.shingles(texts)
        s = M.signatures(t, h, c, 2)
        a, b = bags_of(texts)
        errors.append(float((s[0] == s[1]).mean()) - M.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.07


def test_weights_count():
    a, b = bags_of(["a b c d e " * 4, "a b c d e " * 4 + "a b c d e"])
    assert M.similarity(a, b) == 16 / 21


def test_classes_match_brute_force_in_a_hot_group(spark):
    random.seed(2)
    words = [f"word{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(160)]
    rows = []
    for k in range(140):  # near copies of one text, from nearly equal to far below the threshold
        copy = list(base)
        for at in random.sample(range(len(copy)), random.choice([0, 1, 2, 3, 4, 6, 9])):
            copy[at] = f"new{k}-{at}"
        rows.append((1000 + k, " ".join(copy)))
    for k in range(60):
        own = " ".join(random.choice(words) for _ in range(60))
        rows.append((k, own))
        if k % 7 == 0:
            rows.append((500 + k, own.upper()))
    rows += [(9001, None), (9002, ""), (9003, "--- ***"), (9004, "one two"), (9005, "one  two"), (9006, "x " * 30_000)]
    got = {r.doc_id: r for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes([k for k, _ in rows], [t or "" for _, t in rows])
    assert {k: r.class_id for k, r in got.items()} == want
    assert got[9001].class_size == 1 and got[9005].class_id == 9004


def test_blocks_connect_what_they_should(monkeypatch, spark):
    monkeypatch.setattr(M, "BLOCK_NODES", 16)
    test_classes_match_brute_force_in_a_hot_group(spark)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "h i j k l m n")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as class_id")).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(None, 4, 4), (4, 4, 4), (5, 5, 1)}
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
