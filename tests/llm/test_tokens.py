from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave.llm import idfile, packing
from stepweave.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer
from stepweave.llm.tokens import Encoder

ENCODERS = {n: Encoder(tokenizer(n), memo=500) for n in (WORD_TOKENIZER, BYTE_TOKENIZER)}
TEXT = st.lists(st.sampled_from([*"abzAZ'.,!?-_*#19 \n\t\r", "  ", "'s", "'re", "é", "É", "ß", "ſ", "K", "日", "́", "\xa0", "\x1c", " ", "…", "<|endoftext|>", "word", "Word's", "don't"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
@pytest.mark.parametrize("name", list(ENCODERS))
def test_pieces_give_the_library_s_ids(name, text):
    e = ENCODERS[name]
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000)).view(np.uint64)
    p = idfile.PerfectHash.build(keys)
    assert sorted(p.slots(keys).tolist()) == list(range(len(keys)))


def test_shard_answers_by_key():
    keys = np.array([-5, 3, 3, 9], dtype=np.int64)
    parts = [np.arange(n, dtype="<u2").tobytes() for n in (2, 3, 0, 4)]
    raw, before = idfile.pack_shard(keys, parts, np.dtype("<u2"))
    for whole in (False, True):  # by ranged reads, and with the index at once
        s = idfile.Shard(io.BytesIO(raw))
        if whole:
            s.load(zlib.crc32(raw[:before]))
        first, times = s.find(np.array([3, 9, -5, 4, 10**12]))
        assert first.tolist()[:3] == [1, 3, 0] and times.tolist()[:3] == [2, 1, 1]
        assert [(a, x.tolist()) for a, x in s.get(1, 2)] == [(2, [0, 1, 2]), (5, [])] and [x.tolist() for _, x in s.get(3)] == [[0, 1, 2, 3]]
        assert (s.find(np.arange(1000, 3000))[0] >= 0).sum() == 0
    damaged = bytearray(raw)
    damaged[-1] ^= 1
    with pytest.raises(OSError):
        list(idfile.Shard(io.BytesIO(bytes(damaged))).get(3))


def test_one_key_is_found_by_few_reads():
    class Counted(io.BytesIO):
        reads = taken = 0

        def read(self, n=-1):
            got = super().read(n)
            self.reads, self.taken = self.reads + 1, self.taken + len(got)
            return got

    keys = np.arange(0, 60_000, 3, dtype=np.int64)
    raw, _ = idfile.pack_shard(keys, [np.full(50, k % 1000, "<u2").tobytes() for k in keys], np.dtype("<u2"))
    source = Counted(raw)
    s = idfile.Shard(source)
    source.reads = source.taken = 0
    asked = keys[::400]
    for k in asked:
        first, times = s.find(np.array([k]))
        assert [x.tolist() for _, x in s.get(int(first[0]), int(times[0]))] == [[k % 1000] * 50]
    assert source.reads < 8 * len(asked) and source.taken < 400 * len(asked) < len(raw)


ROWS = [(7, "Hello there, world."), (3, None), (None, "no key"), (9, "x " * 5000), (3, "again"), (1, ""), (7, "Hello there, world.")]


def test_ids_round_trip(spark):
    path = tokenizer(WORD_TOKENIZER)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "0 as start", "1 as shard")
    manifest = idfile.write_ids(docs, path, 2, shards=3)
    got = idfile.look_up(manifest, docs, with_ids=True).collect()
    lib = ENCODERS[WORD_TOKENIZER].tokenizer
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for key, text in order:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) == at
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [k for k, _ in order]
    assert idfile.look_up(manifest, spark.createDataFrame([(4,)], "doc_id long")).count() == 0
    empty = idfile.write_ids(docs.limit(0), path, 2)
    assert idfile.look_up(empty, docs).count() == 0


def test_a_key_of_many_rows_fills_many_shards(spark):
    path = tokenizer(WORD_TOKENIZER)
    rows = [(None, f"some words and number {i % 40}") for i in range(400)] + [(1, "one"), (-7, "minus seven"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = idfile.write_ids(docs, path, 2, shards=4, shard_bytes=400)
    shards = manifest.orderBy("shard").collect()
    assert sum(r.n_docs for r in shards) == len(rows) and sum(r.first_key == idfile.NULL_KEY for r in shards) > 8
    assert [(r.first_key, r.last_key) for r in shards] == sorted((r.first_key, r.last_key) for r in shards)
    got = idfile.look_up(manifest, docs).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == [None] * 400 + [-7, 1, 2]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_sum_of_squares_against_a_plain_version():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 300))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 64)
    counts, used = {}, {}
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        room = 64 - used.get(s, 0)
        assert used.get(s, 0) == o and room >= n
        costs = {}
        for gap in [g for g, c in counts.items() if c and g >= n]:
            after = dict(counts)
            after[gap] -= 1
            if gap > n:
                after[gap - n] = after.get(gap - n, 0) + 1
            costs[gap] = sum(c * c for c in after.values())
        if costs:
            assert room == min(costs, key=lambda g: (costs[g], g))
            counts[room] -= 1
        else:
            assert o == 0
        if room > n:
            counts[room - n] = counts.get(room - n, 0) + 1
        used[s] = used.get(s, 0) + n


def test_packing(spark):
    path = tokenizer(BYTE_TOKENIZER)
    rows = [(i, "some words here " * (i % 90)) for i in range(200)] + [(None, None), (5, ""), (5, ""), (900, "y " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as sequence_id")
    got = packing.pack_documents(docs, path, 2, capacity=256, with_ids=True).collect()
    lib = ENCODERS[BYTE_TOKENIZER].tokenizer
    want = {k: lib.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, pieces in by_doc.items():
        if key == 5:
            continue
        pieces.sort(key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == want[key] and [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 256 for r in pieces[1:]) and pieces[0].start == 0
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    assert len(by_doc[5]) == 2 + 1
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False)) and s[-1].offset + s[-1].length <= 256
    least = -(-sum(r.length for r in got) // 256)
    assert len(by_sequence) <= least * 1.02 + 2
    assert packing.pack_documents(docs.limit(0), path, 2).count() == 0


def test_equal_rows_are_dealt_over_all_blocks(spark):
    docs = spark.createDataFrame([(None, "the same few words")] * 400, "doc_id long, text string")
    pieces = packing.token_pieces(docs, tokenizer(BYTE_TOKENIZER), 2, capacity=64).selectExpr("*", "monotonically_increasing_id() as row")
    got = packing.pack(pieces, 64, block=50).collect()
    assert len(got) == 400 and len({r.sequence_id >> 32 for r in got}) >= 6
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
