"""Media columns: binary Netpbm (P5, P6) and 24-bit or 8-bit BMP, decoded to numpy, area-resized, tiled, hashed.

store() keeps bytes losslessly as the samples of an image; decode() reads any image of these forms; resize() averages
over exact source areas by an integral image; npy() writes tiles; dhash() is the 64-bit difference hash.

Defined results. Null text is empty: a payload of 192 blanks. Null or malformed media gives null features (read_media) and
no failure. Widths are fixed, so a very long text makes a tall image; one text is one record and is held whole. Samples of a
Netpbm image with a maximum below 255 count as shares of it in features and tiles (its payload stays as stored). Repeated
rows and null keys get a row each, an empty table no rows. All other columns stay; those that have the names of added ones
are replaced, and so is the text by the image and the image by its features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_batches, slices

#: A payload is padded with blanks to a positive multiple of this: rows of 64 pixels of three samples.
UNIT = 192


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded UTF-8 bytes and their number before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode_pnm(pixels: np.ndarray) -> bytes:
    """P5 of (h, w), P6 of (h, w, 3)."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of (h, w, 3) RGB, rows bottom-up and padded to four bytes."""
    h, w, _ = pixels.shape
    row = -(-3 * w // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode(raw: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) samples from 0 to 255; ValueError if it is none of the forms above."""
    pixels, most = samples(raw)
    return pixels if most == 255 else np.rint(np.minimum(pixels, most) * (255.0 / most)).astype(np.uint8)


def samples(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples as they are stored, and the largest that there can be."""
    try:
        return (_decode_bmp(raw), 255) if raw[:2] == b"BM" else _decode_pnm(raw)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("malformed image") from e


def _decode_pnm(raw: bytes) -> tuple[np.ndarray, int]:
    if raw[:2] not in (b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    at, numbers = 2, []
    while len(numbers) < 3:
        if raw[at : at + 1].isspace():
            at += 1
        elif raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
        else:
            to = at
            while raw[to : to + 1].isdigit():
                to += 1
            numbers.append(int(raw[at:to] or b"x"))
            at = to
    w, h, most = numbers
    if not raw[at : at + 1].isspace() or not 0 < most < 256 or not w or not h:
        raise ValueError("unsupported Netpbm header")
    shape = (h, w, 3) if raw[:2] == b"P6" else (h, w)
    size = int(np.prod(shape))
    if len(raw) < at + 1 + size:
        raise ValueError("image ends early")
    return np.frombuffer(raw, np.uint8, size, at + 1).reshape(shape), most


def _decode_bmp(raw: bytes) -> np.ndarray:
    (begin,) = struct.unpack_from("<I", raw, 10)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP")
    step, rows = bits // 8 * w, abs(h)
    stride = -(-step // 4) * 4
    if len(raw) < begin + stride * rows:
        raise ValueError("image ends early")
    body = np.frombuffer(raw, np.uint8, stride * rows, begin).reshape(rows, stride)[:, :step]
    body = body if h < 0 else body[::-1]
    if bits == 24:
        return body.reshape(rows, w, 3)[:, :, ::-1]
    colours = np.frombuffer(raw, np.uint8, begin - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
    rgb = colours[body]
    return rgb[:, :, 0] if (colours == colours[:, :1]).all() else rgb


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def integral(pixels: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each corner: (h + 1, w + 1)."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    np.cumsum(pixels, axis=0, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    return total


def area_means(total: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact (fractional) source area, from the integral image."""
    h, w = total.shape[0] - 1, total.shape[1] - 1

    def along(table: np.ndarray, n: int, size: int) -> np.ndarray:
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    cut = along(along(total, height, h).T, width, w).T
    return np.diff(np.diff(cut, axis=0), axis=1) / ((h / height) * (w / width))


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_means(integral(pixels), height, width)


def dhash(cells: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour; cells: 8 x 9."""
    bits = cells[:, 1:] > cells[:, :-1] + 1e-9
    return np.packbits(bits.ravel()).tobytes().hex()


def npy(cells: np.ndarray) -> bytes:
    """Cells of samples as the bytes of an NPY tile."""
    out = io.BytesIO()
    np.save(out, np.rint(np.clip(cells, 0, 255)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


#: Height and width of a tile.
TILE = 16


def store_text(docs: DataFrame, text: str = "text", form: str = "ppm", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """docs without text, with the stored image and the text's bytes before padding (in place of columns of these names)."""
    out = docs.drop(media, n_bytes)
    at = out.columns.index(text)
    schema = T.StructType([*(f for f in out.schema if f.name != text), T.StructField(media, T.BinaryType()), T.StructField(n_bytes, T.LongType())])
    write = {"ppm": lambda b: encode_pnm(b.reshape(-1, UNIT // 3, 3)), "pgm": lambda b: encode_pnm(b.reshape(-1, UNIT)), "bmp": lambda b: encode_bmp(b.reshape(-1, UNIT // 3, 3))}[form]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                kept = [payload(t) for t in part.column(at).to_pylist()]
                images = [write(np.frombuffer(b, np.uint8)) for b, _ in kept]
                others = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*others, pa.array(images, pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=schema.names)

    return map_batches(out, put, schema)


def read_media(images: DataFrame, media: str = "media", tiles: bool = True) -> DataFrame:
    """images with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference hash) and, if asked for, the NPY tile, in place of media."""
    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), *[("tile_npy", T.BinaryType())] * tiles]
    images = images.drop(*(n for n, _ in added))
    at = images.columns.index(media)
    schema = T.StructType([*(f for f in images.schema if f.name != media), *(T.StructField(n, t) for n, t in added)])

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(added)
        own = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            pixels, most = samples(raw)
        except ValueError:
            return (None, None, None, *own, None, *[None] * tiles)
        back = pixels.tobytes()
        total = integral(grey(pixels if most == 255 else decode(raw)))
        return (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *own, dhash(area_means(total, 8, 9)), *[npy(area_means(total, TILE, TILE))] * tiles)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                rows = [one(x.as_py()) for x in part.column(at)]
                others = [c for k, c in enumerate(part.columns) if k != at]
                kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
                yield pa.RecordBatch.from_arrays([*others, *(pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(added))], names=schema.names)

    return map_batches(images, get, schema)
