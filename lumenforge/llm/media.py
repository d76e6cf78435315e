"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
WIDTH = 24
TILE = 16


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """8-bit PGM (height x width) or PPM (height x width x 3), binary form."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain (P1-P3) or binary (P4-P6), of at most 8 bits; PBM's 1 (black) becomes 0, its 0 becomes 255."""
    kind, at, header = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    while len(header) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        header.append(int(data[at:end]))
        at = end
    width, height = header[:2]
    if len(header) > 2 and not 0 < header[2] < 256:
        raise ValueError("only 8-bit samples")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, n, at + 1)
    else:
        body = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = list(body.replace(b" ", b"")) if kind == b"P1" else body.split()
        flat = np.array([255 * (v == 48) for v in values[:n]] if kind == b"P1" else [int(v) for v in values[:n]], np.uint8)
        if len(flat) < n:
            raise ValueError("too few samples")
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first; grey images get equal channels."""
    rgb = np.repeat(pixels[:, :, None], 3, 2) if pixels.ndim == 2 else pixels
    height, width = rgb.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to height x width x 3."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only plain BMP of 8, 24 or 32 bits")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        out = palette[rows][:, :, 2::-1]
    else:
        out = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cumulative(rows: np.ndarray, cells: int) -> np.ndarray:
    """Integrals of each row of a piecewise constant signal up to ``cells + 1`` even bounds."""
    n = rows.shape[-1]
    total = np.zeros((*rows.shape[:-1], n + 1))
    np.cumsum(rows, axis=-1, dtype=np.float64, out=total[..., 1:])
    at = np.arange(cells + 1) * (n / cells)
    low = np.minimum(at.astype(np.int64), n - 1)
    return total[..., low] + (at - low) * (total[..., low + 1] - total[..., low])


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's area, from the integral image at the cells' (fractional) corners.

    The integral of a pixel grid is bilinear between its grid points, so interpolating it is exact.
    """
    across = np.concatenate([_cumulative(grey[i : i + 4096], width) for i in range(0, grey.shape[0], 4096)])
    corners = _cumulative(np.diff(across, axis=1).T, height).T  # (height + 1) x width
    return np.diff(corners, axis=0) * (height * width / (grey.shape[0] * grey.shape[1]))


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 resize is darker than its right neighbour."""
    small = area_resize(grey, 8, 9)
    # sums in floating point: differences below a millionth of a grey level are ties
    return np.packbits(np.diff(small, axis=1) > 1e-6).tobytes().hex()


def npy_tile(grey: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an 8-bit PGM image, read it back and compute features from the pixels.

    Payload: the UTF-8 bytes, then bytes 255 up to a positive multiple of 576; rows of 24 pixels.
    ``feature`` is the difference hash, ``tile`` a 16 x 16 NPY array. Null text counts as empty: 576
    bytes of 255. Ids pass through, null or repeated; equal texts give equal values; other columns
    are not read; an empty table gives no rows. One map without shuffle; memory is that of a batch
    of texts and a small multiple of the longest.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = [types[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                payload = raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))
                stored = encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
                pixels = decode(stored)
                back = pixels.tobytes()
                g = grey(pixels)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(g), npy_tile(g)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, schema)]], [id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {SCHEMA}")
