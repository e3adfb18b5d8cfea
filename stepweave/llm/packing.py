"""Sum-of-squares packing of token sequences.

Each document becomes pieces of at most ``capacity`` ids: full ones, and, first, the rest. A full piece is a sequence of
its own. The rests are dealt by a hash of their keys and place into blocks of about ``BLOCK`` and packed block by block: longest
first, each into an open sequence with room so that the sum over residual gaps of the squared count of open sequences
with that gap becomes smallest (ties: the tightest gap); a new sequence opens only if none has room. A block's state is
one counter and one stack for each gap, so memory is bounded by the block; more documents make more blocks.

Defined results. Null text counts as empty: one piece with the end id alone. A repeated row is packed again; however often
one is there, its rests are dealt over all blocks. Null keys are kept. Columns of documents beyond key and text are not
read, those of pieces stay (sequence_id, offset and row are replaced). An empty table gives no rows. Among pieces of one
length in a block the smaller (key, piece) comes first. A text is encoded whole: one text is one record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches, settled, slices, workers_find_package
from .tokens import encoder

#: Rests packed together: large enough that open sequences at a block's end are few against its sequences.
BLOCK = 32_768


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, the ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, text):
                keys, texts = part.column(0), part.column(1)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k in range(part.num_rows):
                    own = np.append(np.frombuffer(enc.encode(texts[k].as_py()), enc.dtype), enc.dtype.type(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    at = 0
                    for n, to in enumerate(range(first, len(own) + 1, capacity)):
                        row.append(k)
                        piece.append(n)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(own[at:to].tobytes()))
                        if with_ids:
                            ids.append(own[at:to].astype("<i4"))
                        at = to
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return map_batches(docs.select(key, text), cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the order given; each at least 1 and at most capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    never = np.int64(1 << 62)
    for i, n in enumerate(lengths.tolist()):
        gaps = count[n:capacity]  # of gaps n .. capacity - 1
        k = -1
        if len(gaps):
            # (count[gap - n] + 1)^2 + (count[gap] - 1)^2 less what they are now; an exact fill leaves no gap behind
            change = 2 * (count[: capacity - n] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = never
            k = int(change.argmin())
            if change[k] == never:
                k = -1
        if k >= 0:
            gap = n + k
            s = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, s = capacity, opened
            opened += 1
        sequence[i], offset[i] = s, capacity - gap
        if gap > n:
            count[gap - n] += 1
            stacks[gap - n].append(s)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 1024, block: int = BLOCK, key: str = "doc_id") -> DataFrame:
    """pieces (a table that is cheap to read twice) with sequence_id and offset; a column row, if there, tells equal pieces apart."""
    pieces = pieces.drop("sequence_id", "offset")
    row = "row" if "row" in pieces.columns else None
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    schema = T.StructType([*(f for f in rest.schema if f.name != row), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    by = [c for c in ("length", key, "piece") if c in pieces.columns]

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["_block", *[row] * bool(row)]).sort_values(by, ascending=[False, *[True] * (len(by) - 1)], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(group[0]) << 32) + sequence, offset=offset)

    workers_find_package(pieces.sparkSession)
    dealt = rest.withColumn("_block", F.pmod(F.xxhash64(*by, *[row] * bool(row)), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(place, schema).unionByName(full.drop("row"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    pieces = token_pieces(docs, tokenizer, end_id, capacity, key, text, with_ids).withColumn("row", F.monotonically_increasing_id())
    return pack(settled(pieces, "pieces"), capacity, key=key)
