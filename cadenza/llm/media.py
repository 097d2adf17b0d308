"""Media columns: Netpbm and BMP images decoded to arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Decoded forms: Netpbm P1 to P6, scaled to the whole range of one or two bytes a sample, and uncompressed BMP of 1, 4, 8, 16, 24 and 32
bits, with or without masks, in either row order, with any header.
A difference hash has one bit for each horizontal pair of a 9 x 8 area-resized grey image: is the left one brighter.

The query stores a text's padded UTF-8 bytes as a grey image 64 samples wide: BMP where its height is even, else PGM. It decodes the
stored bytes again and takes everything it reports from the decoded array.

Edge cases: null texts and images count as empty; an empty text is one row of zeros; an image that can't be decoded, or has no samples, gives nulls; rows
that repeat give equal rows; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

WIDTH = 64
TILE = 256
#: Samples of an integral image that are summed at once.
BAND = 1 << 20

_NETPBM = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def to_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def to_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, bottom row first."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels); ValueError where that can't be."""
    try:
        return _decode_bmp(data) if data[:2] == b"BM" else _decode_netpbm(data)
    except (struct.error, OverflowError, IndexError, TypeError) as wrong:
        raise ValueError(f"no image: {wrong}") from wrong


def _sized(width: int, height: int, most: int) -> None:
    """Images without samples, or with more than their bytes can hold, are none."""
    if width < 1 or height < 1 or width * height > most:
        raise ValueError("an image without samples, or with too many")


def _decode_netpbm(data: bytes) -> np.ndarray:
    head = _NETPBM.match(data)
    if not head:
        raise ValueError("neither Netpbm nor BMP")
    kind, width, height = int(head[1]), int(head[2]), int(head[3])
    _sized(width, height, 8 * len(data))
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    at, most = (head.end(3), 1) if bitmap else (head.end(4), int(head[4]))
    if not 1 <= most <= 65535:
        raise ValueError("no such greatest value")
    n = width * height * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        values = np.array(list(re.sub(rb"\s", b"", body)[:n]), np.int64) - 48 if kind == 1 else np.array(body.split()[:n], np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        values = bits[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(values) and (values.min() < 0 or values.max() > most):
        raise ValueError("a value over the greatest")
    full = 255 if most < 256 else 65535
    if bitmap:  # 1 is black
        values = (1 - values.astype(np.int64)) * 255
    elif most != full:
        values = (values.astype(np.int64) * full + most // 2) // most
    return values.astype(np.uint8 if full == 255 else np.uint16, copy=False).reshape(height, width, channels)


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """What a mask takes from 32-bit values, on the scale of a byte."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    return (((values & mask) >> shift) * 255 + most // 2) // most


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<II", data, 10)
    if size == 12:  # the oldest header
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        compression, colours, entry = 0, 0, 3
    else:
        width, height, _, bits, compression, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
        entry = 4
    if compression not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or compression == 3 and bits not in (16, 32):
        raise ValueError("compressed BMP")
    _sized(width, abs(height), 8 * len(data))
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits == 16 or compression == 3:
        masks = struct.unpack_from("<III", data, 54) if compression == 3 else (0x7C00, 0x3E0, 0x1F)
        values = np.ascontiguousarray(raw[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        return np.stack([_channel(values, m) for m in masks], 2).astype(np.uint8)
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    known = min(colours or 1 << bits, 1 << bits)
    palette = np.frombuffer(data, np.uint8, entry * known, 14 + size).reshape(-1, entry)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        index = index[:, :width]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index][:, :, None]
    return palette[index]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, exact also where their edges cut samples: integral images, interpolated at the edges."""
    rows, cols, channels = image.shape
    ys, xs = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    wanted = np.unique(np.concatenate([y0, np.minimum(y0 + 1, rows)]))
    kept = np.zeros((len(wanted), cols, channels))
    carry, step = np.zeros((cols, channels)), max(1, BAND // max(1, cols * channels))
    for at in range(0, rows, step):  # sums of whole columns down to the wanted rows
        sums = image[at : at + step].cumsum(0, dtype=np.float64) + carry
        here = (wanted > at) & (wanted <= at + len(sums))
        kept[here] = sums[wanted[here] - at - 1]
        carry = sums[-1]
    whole = np.concatenate([np.zeros((len(wanted), 1, channels)), kept.cumsum(1)], 1)
    upper, lower = np.searchsorted(wanted, y0), np.searchsorted(wanted, np.minimum(y0 + 1, rows))
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    lines = whole[upper] * (1 - fy) + whole[lower] * fy
    corners = lines[:, x0] * (1 - fx) + lines[:, np.minimum(x0 + 1, cols)] * fx
    return np.diff(np.diff(corners, axis=0), axis=1) / ((rows / height) * (cols / width))


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(image, 8, 9).mean(2)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of each tile."""
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            np.save(file := io.BytesIO(), np.ascontiguousarray(image[y : y + tile, x : x + tile]))
            yield y // tile, x // tile, file.getvalue()


def tiles(images: DataFrame, id_col: str, content_col: str, height: int | None = None, width: int | None = None, tile: int = TILE) -> DataFrame:
    """NPY tiles of every image, resized first where a size is given: id, image_height, image_width, tile_row, tile_col, npy, hash."""
    chosen = images.select(F.col(id_col), F.col(content_col).alias("content"))
    kind = chosen.schema[0].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                try:
                    image = decode(content.as_py() or b"")
                    shown = difference_hash(image)
                    if height and width:
                        image = np.rint(area_resize(image, height, width)).astype(image.dtype)
                    rows = [(*image.shape[:2], y, x, npy, shown) for y, x, npy in npy_tiles(image, tile)]
                except ValueError:
                    rows = [(None,) * 6]
                cols = [pa.array([key.as_py()] * len(rows), batch.schema[0].type), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 4 + [pa.binary(), pa.string()], strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "image_height", "image_width", "tile_row", "tile_col", "npy", "hash"])

    return chosen.mapInArrow(cut, f"`{id_col}` {kind}, image_height int, image_width int, tile_row int, tile_col int, npy binary, hash string")


def store(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return to_pgm(samples) if len(samples) % 2 else to_bmp(samples)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Texts stored as images and read back; ``media`` has the stored bytes if asked for."""
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    fields = f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, {fields}" + ", media binary" * with_media

    def read_back(batches):
        for batch in batches:
            rows = []
            for body in batch.column(1):
                body = body.as_py()
                media = store(body + bytes(-len(body) % WIDTH or (0 if body else WIDTH)))
                image = decode(media)
                payload = image.tobytes()
                small = np.rint(area_resize(image, 32, 32)).astype(np.uint8)
                tile = next(npy_tiles(small))[2]
                rows.append((len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(tile).hexdigest(), media))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: 8 + with_media]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], t) for t in kinds]
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "media"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names[: 1 + len(cols)])

    return chosen.mapInArrow(read_back, fields)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
