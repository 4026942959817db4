"""Media columns (operator 6): Netpbm and BMP rasters, integral-image area resize, NPY tiles, difference hashes.

Rasters are decoded to numpy arrays of 8-bit samples, resized by exact area averages (fractional box edges are
read from the integral image by linear interpolation), written as NPY tiles and hashed by the signs of
horizontal differences. All work is row by row inside Arrow batches: nothing is shuffled or collected.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Payload bytes come in multiples of this, as rows of WIDTH samples.
UNIT, WIDTH, PAD = 576, 24, 255
HASH_ROWS, HASH_COLUMNS = 8, 9


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey raster (rows, columns) of 8-bit samples as binary Netpbm."""
    rows, columns = samples.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """A colour raster (rows, columns, 3) of 8-bit samples as binary Netpbm."""
    rows, columns, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (columns, rows) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey (rows, columns) or colour (rows, columns, 3) raster as uncompressed BMP, 8 or 24 bits a pixel."""
    rows, columns = samples.shape[:2]
    grey = samples.ndim == 2
    line = samples if grey else samples[:, :, ::-1]
    line = np.ascontiguousarray(line, np.uint8).reshape(rows, -1)
    line = np.pad(line, ((0, 0), (0, -line.shape[1] % 4)))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + line.size, 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 8 if grey else 24, 0, line.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + line.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = int(data[1:2]), 2, []
    token = re.compile(rb"(?:\s|#[^\n]*\n?)*(\d+)")
    for _ in range(2 if kind in (1, 4) else 3):
        found = token.match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    columns, rows = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    planes = 3 if kind in (3, 6) else 1
    count = rows * columns * planes
    if kind == 1:
        samples = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[:count] - ord("0")
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count], np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, rows * -(-columns // 8), at + 1)
        samples = np.unpackbits(packed.reshape(rows, -1), axis=1)[:, :columns].ravel()
    elif kind in (5, 6):
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    else:
        raise ValueError(f"unknown Netpbm kind P{kind}")
    if len(samples) != count:
        raise ValueError("Netpbm raster is cut short")
    if kind in (1, 4):
        samples = (1 - samples.astype(np.int64)) * 255
    elif top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    samples = samples.astype(np.uint8)
    return samples.reshape((rows, columns, 3) if planes == 3 else (rows, columns))


def _bmp(data: bytes) -> np.ndarray:
    start, size, columns, rows, _, depth, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packing or depth not in (8, 24, 32):
        raise ValueError("only uncompressed BMP with 8, 24 or 32 bits a pixel")
    upward, rows = rows > 0, abs(rows)
    line = (columns * depth // 8 + 3) // 4 * 4
    raster = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)[:, : columns * depth // 8]
    raster = raster[::-1] if upward else raster
    if depth != 8:
        return raster.reshape(rows, columns, depth // 8)[:, :, 2::-1].copy()
    entries = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, entries * 4, 14 + size).reshape(-1, 4)
    if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
        return palette[raster, 0]
    return palette[raster][:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or BMP file: (rows, columns) or (rows, columns, 3), 8 bits each."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2].isdigit():
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


#: Rows are summed so many samples at a time, as numpy makes wide numbers of what it sums.
SUM_SAMPLES = 1 << 22


def _strip_sums(samples: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the rows between the places in at, which begin with 0; exact, as sums of bytes are whole numbers."""
    if samples.size <= SUM_SAMPLES:
        return np.add.reduceat(samples, at[:-1], axis=0, dtype=np.float64)
    step = max(1, SUM_SAMPLES // (samples.size // len(samples)))
    return np.stack([sum(samples[k : min(k + step, b)].sum(axis=0, dtype=np.float64) for k in range(a, b, step)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def area_resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of samples over a rows x columns grid of boxes with fractional edges, from the integral image.

    Of the integral image only the lines at box edges are made, by summing the strips between them, so that
    memory goes by the width of the raster and not by its height.
    """
    high, wide = samples.shape[:2]

    def between(size: int, parts: int):
        edge = np.arange(parts + 1) * size / parts
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    y, fy = between(high, rows)
    x, fx = between(wide, columns)
    at = np.unique(np.concatenate([y, y + 1]))
    strips = _strip_sums(samples, at)
    strips = strips if samples.ndim == 2 else strips.mean(axis=2)
    down = np.cumsum(strips, axis=0)
    total = np.zeros((len(at), wide + 1))
    np.cumsum(down, axis=1, out=total[len(at) - len(down) :, 1:])
    place = np.searchsorted(at, y)
    lines = total[place] * (1 - fy)[:, None] + total[np.searchsorted(at, y + 1)] * fy[:, None]
    corners = lines[:, x] * (1 - fx) + lines[:, x + 1] * fx
    return np.diff(np.diff(corners, axis=0), axis=1) * (rows * columns / (high * wide))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits, one for each pair of horizontal neighbours of the 8 x 9 area means; 16 hexadecimal digits."""
    means = np.round(area_resize(samples, HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, rows: int = 16, columns: int = 16) -> bytes:
    """The area-resized raster as an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, rows, columns)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of UNIT, and the length without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, bytes([PAD])), len(raw)


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bmp: bool = False) -> DataFrame:
    """Texts stored as media: doc_id, n_bytes, payload (read back from the stored form), media, tile, feature.

    The stored form is a grey raster of WIDTH columns, binary Netpbm or BMP. Null and empty texts are one unit of
    padding. Equal texts give equal rows; every input row gives one row; other columns are not read.
    """
    encode = encode_bmp if bmp else encode_pgm

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                raw, n = text_payload(text)
                media = encode(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH))
                samples = decode(media)
                for column, value in zip(out, (n, samples.tobytes(), media, npy_tile(samples), difference_hash(samples)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:4]), pa.array(out[4], pa.string())], ["doc_id", "n_bytes", "payload", "media", "tile", "feature"])

    ids = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {ids}, n_bytes long, payload binary, media binary, tile binary, feature string")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bmp: bool = False) -> DataFrame:
    """Digests of media_rows, made in the same Python pass so that the bytes need not leave it."""
    encode = encode_bmp if bmp else encode_pgm

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                raw, n = text_payload(text)
                media = encode(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH))
                samples = decode(media)
                back, tile = samples.tobytes(), npy_tile(samples)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples), hashlib.sha256(tile).hexdigest())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], DIGEST)

    ids = docs.select(id_col).schema[0].dataType.simpleString()
    kinds = "long long string long long string string string".split()
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(DIGEST, [ids, *kinds], strict=True)))


DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
