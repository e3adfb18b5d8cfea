"""Token-id shards with a minimal perfect hash index, and keyed access to them.

File format, all little-endian: magic ``SWIDS2``, width (bytes of an id, u16), then u64 counts of entries, ids, levels
and key slots; u64 words of each level of the index; per level its bits (64-bit words, a multiple of RANK_WORDS) and a rank
for each RANK_WORDS of them (u64: set bits before them, on all levels); slot table in hash order (fingerprint u32, first
entry u64, entries u32); entry table (first id u64, number of ids u64, crc32 of the ids' bytes u32) in ascending key order;
raw ids. The index is a cascade of bit arrays (Limasset et al. 2017): on each level a key that alone falls on a bit owns
it, the others go on; a key's slot is the rank of its bit. All of it is read by ranges: a look-up of one key reads some
1.6 blocks of bits with their rank, one slot, its entries and their ids, however many keys there are; a look-up of many
keys reads index and tables once and ids in runs. A stored 32-bit fingerprint turns away keys that are not there.

Shards hold ascending ranges of keys, one or more for each range partition, of SHARD_BYTES at most (or one text). Rows of
one key are in the order of their text's hash and may fill many shards, so a key that a third of all rows have is many
tasks. A task writes its shards under names of its own and returns them in the manifest, which Spark then commits; a lost
or repeated task leaves files that no manifest names.

Defined results. Null text counts as empty: its end id alone. Rows of one key stand together, copies as often as they are
there. A null key is kept as the smallest long. An empty table gives an empty manifest. A text is encoded whole; one text
is one record and is held in memory with its ids. Columns beyond key and text are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import map_batches, planned_bytes, settled, shared_path, slices
from .tokens import encoder

MAGIC = b"SWIDS2"
NULL_KEY = -(1 << 63)
#: shard: a number that ascends with the keys; meta_bytes and meta_crc32: of all that stands before the ids.
MANIFEST = "shard long, path string, first_key long, last_key long, n_docs long, n_ids long, bytes long, meta_bytes long, meta_crc32 long"
MOST_SHARDS = 4_000_000
#: Text of a range partition, before compression, about; and most bytes of ids of a shard.
SHARD_BYTES = 64 << 20
#: Words of index bits that one rank stands before, and one read takes.
RANK_WORDS = 8
#: A look-up of more than one in so many of a shard's keys reads its index at once, and ids in runs of so many bytes at most.
FEW, RUN_BYTES = 64, 8 << 20
_HEAD = "<HQQQQ"
_SLOT = np.dtype([("mark", "<u4"), ("first", "<u8"), ("times", "<u4")])
_ENTRY = np.dtype([("start", "<u8"), ("n", "<u8"), ("crc", "<u4")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser of key and seed."""
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1, one to one."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, before = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.concatenate(([0], np.cumsum(ones)))[:-1])
            before += int(ones.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            words = -(-max(1, int(gamma * len(left))) // (64 * RANK_WORDS)) * RANK_WORDS
            at = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit (then it is certainly not there)."""
        keys, found = keys.astype(np.uint64), np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for k, words in enumerate(self.levels):
            if not len(todo):
                break
            at = _mix(keys[todo], k) % np.uint64(len(words) * 64)
            w, b = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            has = ((words[w] >> b) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[w[has]] & ((np.uint64(1) << b[has]) - np.uint64(1))).astype(np.int64)
            found[todo[has]] = self.ranks[k][w[has]] + below
            todo = todo[~has]
        return found


def _mark(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: np.ndarray, payloads: list[bytes], dtype: np.dtype) -> tuple[bytes, int]:
    """The bytes of a shard, and how many stand before the ids; keys ascending, repeats allowed."""
    distinct, first, times = np.unique(keys, return_index=True, return_counts=True)
    own = distinct.view(np.uint64)
    index = PerfectHash.build(own)
    slot = index.slots(own)
    table = np.zeros(len(distinct), dtype=_SLOT)
    table["mark"][slot], table["first"][slot], table["times"][slot] = _mark(own), first, times
    sizes = np.array([len(p) for p in payloads], dtype=np.int64) // dtype.itemsize
    entries = np.zeros(len(keys), dtype=_ENTRY)
    entries["n"], entries["start"], entries["crc"] = sizes, np.cumsum(sizes) - sizes, [zlib.crc32(p) for p in payloads]
    out = io.BytesIO()
    out.write(MAGIC + struct.pack(_HEAD, dtype.itemsize, len(keys), int(sizes.sum()), len(index.levels), len(distinct)))
    out.write(np.array([len(w) for w in index.levels], "<u8").tobytes())
    for words, ranks in zip(index.levels, index.ranks, strict=True):
        out.write(words.tobytes() + ranks[::RANK_WORDS].astype("<u8").tobytes())
    out.write(table.tobytes() + entries.tobytes())
    before = out.tell()
    out.writelines(payloads)
    return out.getvalue(), before


class Shard:
    """A shard in a file (or any seekable source) that is read by ranges."""

    def __init__(self, source) -> None:
        self.source = source
        head = self._read(0, len(MAGIC) + struct.calcsize(_HEAD))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, self.n, self.n_ids, levels, self.n_slots = struct.unpack_from(_HEAD, head, len(MAGIC))
        self.dtype, at = np.dtype(f"<u{width}"), len(head)
        self.words = np.frombuffer(self._read(at, 8 * levels), "<u8").astype(np.int64).tolist()
        at += 8 * levels
        self.level_at = []
        for size in self.words:
            self.level_at.append(at)
            at += 8 * size + 8 * (size // RANK_WORDS)
        self.slots_at = at
        self.entries_at = at + _SLOT.itemsize * self.n_slots
        self.ids_at = self.entries_at + _ENTRY.itemsize * self.n
        self.index: PerfectHash | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(size)
        if len(got) != size:
            raise OSError("a shard ends early")
        return got

    def load(self, crc: int | None = None) -> None:
        """Reads index and tables at once, for look-ups of many keys."""
        raw = self._read(0, self.ids_at)
        if crc is not None and zlib.crc32(raw) != crc:
            raise OSError("a shard's index is damaged")
        self.index = PerfectHash([np.frombuffer(raw, "<u8", n, at) for n, at in zip(self.words, self.level_at, strict=True)])
        self.table = np.frombuffer(raw, _SLOT, self.n_slots, self.slots_at)
        self.entries = np.frombuffer(raw, _ENTRY, self.n, self.entries_at)

    def _slot(self, key: np.ndarray) -> int:
        """The slot of one key by ranged reads, -1 if no level has its bit."""
        for level, (size, at) in enumerate(zip(self.words, self.level_at, strict=True)):
            bit = int(_mix(key, level)[0] % np.uint64(64 * size))
            block, inside = divmod(bit, 64 * RANK_WORDS)
            bits = int.from_bytes(self._read(at + 8 * RANK_WORDS * block, 8 * RANK_WORDS), "little")
            if bits >> inside & 1:
                (rank,) = struct.unpack("<Q", self._read(at + 8 * size + 8 * block, 8))
                return rank + (bits & ((1 << inside) - 1)).bit_count()
        return -1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry (-1: not there) and number of entries of each key."""
        u = keys.astype(np.int64).view(np.uint64)
        first, times = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        slot = self.index.slots(u) if self.index else np.array([self._slot(u[k : k + 1]) for k in range(len(u))], np.int64)
        there = np.flatnonzero(slot >= 0)
        if not len(there):
            return first, times
        rows = self.table[slot[there]] if self.index else np.concatenate([np.frombuffer(self._read(self.slots_at + _SLOT.itemsize * int(s), _SLOT.itemsize), _SLOT) for s in slot[there]])
        same = rows["mark"] == _mark(u[there])
        first[there[same]], times[there[same]] = rows["first"][same], rows["times"][same]
        return first, times

    def _entries(self, first: int, to: int) -> np.ndarray:
        return self.entries[first:to] if self.index else np.frombuffer(self._read(self.entries_at + _ENTRY.itemsize * first, _ENTRY.itemsize * (to - first)), _ENTRY)

    def get(self, first: int, times: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """Start (ids of the shard before it) and ids of entries that stand together, read in runs."""
        at, size = first, self.dtype.itemsize
        while at < first + times:
            own = self._entries(at, min(at + 4096, first + times))
            fit = max(1, int(np.searchsorted(own["start"] + own["n"] - own["start"][0], RUN_BYTES // size, side="right")))
            own = own[:fit]
            begin, ids = int(own["start"][0]), int(own["n"].sum())
            raw = memoryview(self._read(self.ids_at + begin * size, ids * size))
            for start, n, crc in own.tolist():
                part = raw[(start - begin) * size : (start - begin + n) * size]
                if zlib.crc32(part) != crc:
                    raise OSError("a shard's ids are damaged")
                yield start, np.frombuffer(part, self.dtype)
            at += fit


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes and writes all documents in ascending key order; returns the committed manifest, one row per shard."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "ids")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"), F.col(text).alias("t"))
    # rows of one key are dealt by their text, and equal ones by their place
    rows = rows.withColumns({"h": F.xxhash64("t"), "i": F.monotonically_increasing_id()})
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or (n if (n := planned_bytes(rows) // SHARD_BYTES) > least else None)  # None: adaptive execution merges small ones
    rows = (rows.repartitionByRange(shards, "k", "h", "i") if shards else rows.repartitionByRange("k", "h", "i")).sortWithinPartitions("k", "h").select("k", "t")
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.dtype.type(end_id).tobytes()
        keys: list[int] = []
        payloads: list[bytes] = []
        held, part = 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            k = np.array(keys, dtype=np.int64)
            raw, before = pack_shard(k, payloads, enc.dtype)
            path = f"{folder}/shard-{uuid.uuid4().hex}.ids"
            store, name = fs.FileSystem.from_uri(path)
            store.create_dir(name.rpartition("/")[0], recursive=True)
            with store.open_output_stream(name) as out:
                out.write(raw)
            values = [part, path, int(k[0]), int(k[-1]), len(k), held // enc.dtype.itemsize, len(raw), before, zlib.crc32(raw[:before])]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names)

        for batch in batches:
            for piece in slices(batch, "t"):
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = enc.encode(t) + end
                    if payloads and held + len(ids) > shard_bytes:
                        yield flush()
                        keys, payloads, held, part = [], [], 0, part + 1
                    keys.append(k)
                    payloads.append(ids)
                    held += len(ids)
        if payloads:
            yield flush()

    return settled(map_batches(rows, write, MANIFEST), "manifest")


def look_up(manifest: DataFrame, keys: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """For each distinct key that is there: key, start (ids of all documents before it), n_tokens and ids_crc32 of each of its documents, through the index of its shards.

    The first and last keys of the shards (24 bytes for each shard of a partition's size, at most MOST_SHARDS) go to the
    tasks, which find a key's shards by bisection; keys then meet at their shard, some shards a task.
    """
    spark = manifest.sparkSession
    ordered = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.select("shard", "path", "meta_crc32", F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)).alias("base"))
    known = manifest.select("shard", "first_key", "last_key", "bytes").orderBy("shard").limit(MOST_SHARDS + 1).toPandas()
    if len(known) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards; write larger ones")
    ranges = spark.sparkContext.broadcast(tuple(known[c].to_numpy(np.int64) for c in ("shard", "first_key", "last_key")))
    tasks = max(1, min(len(known), max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(known["bytes"].sum()) // SHARD_BYTES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, last = ranges.value
        for batch in batches:
            k = batch.column(0).to_numpy()
            low, high = np.searchsorted(last, k, side="left"), np.searchsorted(first, k, side="right")
            times = np.maximum(high - low, 0)
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            for a in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, times)[a : a + (1 << 16)]), pa.array(shard[at[a : a + (1 << 16)]])], ["k", "shard"])

    asked = map_batches(keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k")).distinct(), send, "k long, shard long")
    hit = asked.join(placed, "shard").select("k", "shard", "path", "meta_crc32", "base")
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, file = None, None, None
        for batch in batches:  # sorted by shard and key
            ks, numbers, crcs, bases = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
            for number in dict.fromkeys(numbers.tolist()):
                own = np.flatnonzero(numbers == number)
                if number != at:
                    if file is not None:
                        file.close()
                    store, name = fs.FileSystem.from_uri(batch.column(2)[int(own[0])].as_py())
                    file = store.open_input_file(name)
                    at, shard = number, Shard(file)
                if shard.index is None and len(own) * FEW > shard.n_slots:
                    shard.load(int(crcs[own[0]]))
                yield from answers(shard, ks[own], int(bases[own[0]]))
        if file is not None:
            file.close()

    def answers(shard: Shard, ks: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
        first, times = shard.find(ks)
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        if not len(at):
            return
        first, times, ks = first[at], times[at], ks[at]
        breaks = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1] + times[:-1])))
        rows: list[tuple] = []
        for a, b in zip(breaks, [*breaks[1:], len(at)], strict=True):
            back = np.repeat(ks[a:b], times[a:b]).tolist()
            for k, (start, ids) in zip(back, shard.get(int(first[a]), len(back)), strict=True):
                rows.append((k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                if len(rows) == 4096 or with_ids and len(ids) * 4 > RUN_BYTES:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        k, start, n, crc, ids = zip(*rows, strict=True)
        k = np.array(k, np.int64)
        cols = [pa.array(k, pa.int64(), mask=k == NULL_KEY), *(pa.array(c, pa.int64()) for c in (start, n, crc))]
        if with_ids:
            cols.append(pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(hit.repartition(tasks, "shard").sortWithinPartitions("shard", "k"), found, schema)
