"""Images: reading, decoding, preparing for a second reading.

Decoding needs code that the engine's functions lack: lenient base64, PNG and other formats. It runs
in Arrow batches; with Pillow installed all its formats decode, without it PNG, PPM and BMP.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions.arrow import arrow
from ..operators.chartvis import chart_visual, resize


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def from_base64(value: str | None) -> bytes:
    """Bytes of a base64 text, perhaps a data URL; foreign characters are skipped; empty if it can't be read."""
    t = (value or "").strip()
    if t.startswith("data:"):
        t = t.partition(",")[2]
    try:
        return base64.b64decode(t, validate=False)
    except ValueError:
        return b""


@arrow("binary")
def base64_bytes(value: pa.Array) -> pa.Array:
    return pa.array(map(from_base64, value.to_pylist()), pa.binary())


# decoding


def _unfilter(raw: bytes, rows: int, stride: int, unit: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    data = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = data[y, 0], data[y, 1:]
        if kind == 0:
            row = line.copy()
        elif kind == 1:
            row = np.cumsum(line.reshape(-1, unit), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            left, up, cur = bytearray(stride), above.tolist(), line.tolist()
            for x in range(stride):
                a = left[x - unit] if x >= unit else 0
                b = up[x]
                if kind == 3:
                    left[x] = (cur[x] + (a + b) // 2) & 255
                else:
                    c = up[x - unit] if x >= unit else 0
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    left[x] = (cur[x] + (a if p <= q and p <= r else b if q <= r else c)) & 255
            row = np.frombuffer(bytes(left), np.uint8)
        else:
            raise ValueError("PNG filter")
        out[y] = above = row
    return out


def _png(raw: bytes) -> np.ndarray:
    at, parts, palette = 8, [], None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if interlace or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise ValueError("PNG kind")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = (w * channels * depth + 7) // 8
    a = _unfilter(zlib.decompress(b"".join(parts)), h, stride, max(1, channels * depth // 8))
    if depth == 16:
        a = a[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(a, axis=1).reshape(h, -1, depth)
        a = np.packbits(bits, axis=2)[:, :, 0] >> (8 - depth)
        a = a[:, : w * channels]
        a = a if colour == 3 else a * (255 // ((1 << depth) - 1))
    a = a.reshape(h, w, channels)
    if colour == 3:
        return palette[a[:, :, 0]]
    return np.repeat(a[:, :, :1], 3, axis=2) if channels < 3 else a[:, :, :3]


def _ppm(raw: bytes) -> np.ndarray:
    fields: list[bytes] = raw[:200].split(maxsplit=4)
    w, h, top = (int(x) for x in fields[1:4])
    n = 3 if fields[0] == b"P6" else 1
    at = raw.index(fields[3], raw.index(fields[2], raw.index(fields[1], 2) + len(fields[1])) + len(fields[2])) + len(fields[3]) + 1
    a = np.frombuffer(raw, np.uint8, w * h * n, at).reshape(h, w, n)
    return np.repeat(a, 3, axis=2) if n == 1 and top == 255 else a


def _bmp(raw: bytes) -> np.ndarray:
    at, _, w, h, _, bits, packed = struct.unpack("<IIiiHHI", raw[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("BMP kind")
    stride = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(raw, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (a[::-1] if h > 0 else a)[:, :, 2::-1]


@functools.lru_cache(1)
def _pillow():
    if importlib.util.find_spec("PIL") is None:
        return None
    from PIL import Image

    return Image


def decode(raw: bytes | None) -> np.ndarray | None:
    """RGB pixels (height x width x 3), or None if the bytes are no image that can be decoded."""
    if not raw:
        return None
    try:
        if _pillow() is not None:
            return np.asarray(_pillow().open(io.BytesIO(raw)).convert("RGB"))
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _ppm(raw)
        return _bmp(raw) if raw[:2] == b"BM" else None
    except (ValueError, KeyError, IndexError, TypeError, OSError, UnboundLocalError, struct.error, zlib.error):
        return None


def encode_png(a: np.ndarray) -> bytes:
    """RGB or grey pixels as a PNG."""
    h, w = a.shape[:2]
    rows = np.ascontiguousarray(a, np.uint8).reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


@arrow(schemas.IMAGE)
def inspect(content: pa.Array) -> pa.Array:
    """ok, size and chart of each image; pixels don't leave the worker."""
    rows = []
    for raw in content.to_pylist():
        a = decode(raw)
        rows.append({"ok": False, "width": 0, "height": 0, "chart_visual": None} if a is None else {"ok": True, "width": a.shape[1], "height": a.shape[0], "chart_visual": chart_visual(a)})
    return pa.array(rows, INSPECTED)


_BOX = pa.struct([("width", pa.int32()), ("height", pa.int32())])
INSPECTED = pa.struct([("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("chart_visual", pa.struct([("chart_like", pa.bool_()), ("kind", pa.string()), ("trend", pa.string()), ("series_count", pa.int32()), ("bbox", _BOX)]))])


# a second reading


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def retry_size(width: int, height: int) -> tuple[int, int]:
    s = min(2.0, 2560 / max(width, 1), 1920 / max(height, 1))
    return (max(1, round(width * s)), max(1, round(height * s))) if s > 1.05 else (width, height)


def retry_image(rgb: np.ndarray) -> np.ndarray:
    """Grey, full contrast, enlarged at most twofold, sharpened; RGB again."""
    grey = (rgb[:, :, 0].astype(np.uint32) * 19595 + rgb[:, :, 1].astype(np.uint32) * 38470 + rgb[:, :, 2].astype(np.uint32) * 7471 + 0x8000) >> 16
    low, high = int(grey.min()), int(grey.max())
    a = np.clip((grey - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8) if high > low else grey.astype(np.uint8)
    w, h = retry_size(rgb.shape[1], rgb.shape[0])
    if (w, h) != (rgb.shape[1], rgb.shape[0]):
        a = resize(a, w, h, _lanczos, 3.0)
    x = a.astype(np.int32)
    if min(x.shape) > 2:
        around = sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - x[1:-1, 1:-1]
        x = x.copy()
        x[1:-1, 1:-1] = np.clip(np.floor((32 * a[1:-1, 1:-1].astype(np.int32) - 2 * around) / 16 + 0.5), 0, 255)
    return np.repeat(x.astype(np.uint8)[:, :, None], 3, axis=2)


@arrow("binary")
def retry_png(content: pa.Array) -> pa.Array:
    """The image prepared for a second reading, as a PNG; null if it can't be decoded."""
    images = (decode(raw) for raw in content.to_pylist())
    return pa.array([None if a is None else encode_png(retry_image(a)) for a in images], pa.binary())
