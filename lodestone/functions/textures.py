"""Texture payloads to RGBA8 and PNG as Arrow UDFs over whole batches of blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a block (or pixel) and pixels on its side.
FORMATS = {"BC1": (8, 4), "BC2": (16, 4), "BC3": (16, 4), "BC4": (8, 4), "BC5": (16, 4), "B8G8R8A8": (4, 1), "G8": (1, 1), "G16": (2, 1), "FloatRGB": (4, 1), "FloatRGBA": (8, 1)}


def encoded_length(fmt: str, width: int, height: int) -> int:
    size, side = FORMATS[fmt]
    return size * -(-width // side) * -(-height // side)


def _bits(words: np.ndarray, n: int, each: int) -> np.ndarray:
    """n values of `each` bits, lowest first."""
    return (words[:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(each))) & np.uint64((1 << each) - 1)


def _colours(b: np.ndarray, four: bool) -> np.ndarray:
    """Blocks of 8 bytes to (n, 16, 4): two RGB565 ends and 2-bit places between them."""
    ends = np.ascontiguousarray(b[:, :4]).view("<u2").astype(np.int64)
    rgb = np.stack([(ends >> 11) * 527 + 23 >> 6, (ends >> 5 & 63) * 259 + 33 >> 6, (ends & 31) * 527 + 23 >> 6], axis=-1)
    p, q = rgb[:, 0], rgb[:, 1]
    wide = (ends[:, 0] > ends[:, 1])[:, None] | four
    table = np.stack([p, q, np.where(wide, (2 * p + q + 1) // 3, (p + q + 1) // 2), np.where(wide, (p + 2 * q + 1) // 3, 0)], axis=1)
    alpha = np.full((len(b), 4), 255)
    alpha[~wide[:, 0], 3] = 0
    at = _bits(np.ascontiguousarray(b[:, 4:8]).view("<u4").astype(np.uint64)[:, 0], 16, 2).astype(np.int64)
    rows = np.arange(len(b))[:, None]
    return np.concatenate([table[rows, at], alpha[rows, at][..., None]], axis=-1).astype(np.uint8)


def _ramp(b: np.ndarray) -> np.ndarray:
    """Blocks of 8 bytes to (n, 16): two ends and 3-bit places between them."""
    p, q = b[:, 0].astype(np.int64), b[:, 1].astype(np.int64)
    wide = p > q
    steps = [p, q] + [np.where(wide, ((7 - k) * p + k * q) // 7, ((5 - k) * p + k * q) // 5 if k < 5 else (0 if k == 5 else 255)) for k in range(1, 7)]
    raw = np.zeros((len(b), 8), np.uint8)
    raw[:, :6] = b[:, 2:]
    at = _bits(raw.view("<u8")[:, 0].astype(np.uint64), 16, 3).astype(np.int64)
    return np.stack(steps, axis=1)[np.arange(len(b))[:, None], at].astype(np.uint8)


def _filmic(x: np.ndarray) -> np.ndarray:
    x = np.clip(np.nan_to_num(x.astype(np.float32), nan=0.0, posinf=65504.0, neginf=0.0), 0, 65504)
    c = np.clip(x * (2.51 * x + 0.03) / (x * (2.43 * x + 0.59) + 0.14), 0, 1)
    return _bytes(np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.power(c, 1 / 2.4) - 0.055))


def _bytes(c: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.nan_to_num(c), 0, 1) * 255 + 0.5).astype(np.uint8)


def _small_float(x: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned floats of a 5-bit exponent and `bits` of mantissa."""
    e, m = (x >> bits).astype(int), (x & ((1 << bits) - 1)).astype(np.float64) / (1 << bits)
    return np.where(e == 31, np.where(m > 0, np.nan, np.inf), np.where(e == 0, m * 2.0**-14, (1 + m) * np.exp2(e - 15.0)))


def decode(fmt: str, data: bytes, width: int, height: int) -> bytes:
    """RGBA8 of one image; ValueError for another length or format."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not supported")
    if len(data) != encoded_length(fmt, width, height):
        raise ValueError(f"{len(data)} bytes of {encoded_length(fmt, width, height)}")
    size, side = FORMATS[fmt]
    b = np.frombuffer(data, np.uint8).reshape(-1, size)
    grey = lambda g: np.stack([g, g, g, np.full_like(g, 255)], axis=-1)
    if fmt == "BC1":
        px = _colours(b, False)
    elif fmt in ("BC2", "BC3"):
        px = _colours(b[:, 8:], True)
        px[..., 3] = _ramp(b[:, :8]) if fmt == "BC3" else (_bits(np.ascontiguousarray(b[:, :8]).view("<u8")[:, 0], 16, 4) * np.uint64(17)).astype(np.uint8)
    elif fmt == "BC4":
        px = grey(_ramp(b))
    elif fmt == "BC5":
        r, g = _ramp(b[:, :8]), _ramp(b[:, 8:])
        x, y = (c.astype(np.float32) / np.float32(127.5) - 1 for c in (r, g))
        z = np.minimum(np.sqrt(np.maximum(1 - x * x - y * y, 0)), 1)
        px = np.stack([r, g, (z * 127 + 128).astype(np.uint8), np.full_like(r, 255)], axis=-1)
    elif fmt == "B8G8R8A8":
        px = b[:, [2, 1, 0, 3]]
    elif fmt == "G8":
        px = grey(b[:, 0])
    elif fmt == "G16":
        px = grey(b[:, 1])
    elif fmt == "FloatRGBA":
        h = b.view("<f2")
        px = np.concatenate([_filmic(h[:, :3]), _bytes(h[:, 3:].astype(np.float32))], axis=1)
    else:
        w = b.view("<u4")[:, 0]
        px = np.concatenate([_filmic(np.stack([_small_float(w & 0x7FF, 6), _small_float(w >> 11 & 0x7FF, 6), _small_float(w >> 22, 5)], axis=-1)), np.full((len(w), 1), 255, np.uint8)], axis=1)
    if side == 1:
        return px.astype(np.uint8).tobytes()
    across, down = -(-width // side), -(-height // side)
    image = px.reshape(down, across, side, side, 4).transpose(0, 2, 1, 3, 4).reshape(down * side, across * side, 4)
    return image[:height, :width].tobytes()


def decode_slab(fmt: str, data: bytes, width: int, height: int, slices: int) -> bytes:
    """RGBA8 of slices that follow each other, one below the other."""
    each = encoded_length(fmt, width, height)
    if slices < 1 or len(data) != each * slices:
        raise ValueError(f"{len(data)} bytes of {each * slices}")
    return b"".join(decode(fmt, data[i * each : (i + 1) * each], width, height) for i in range(slices))


def stitched(tiles: list[bytes | tuple[int, int, int, int]], across: int, tile: int, border: int, width: int, height: int) -> bytes:
    """RGBA8 of width x height from tiles in rows of `across`: bytes of a tile with a border on each side, or one colour; what reaches past the picture is cut."""
    out, whole = np.zeros((height, width, 4), np.uint8), tile + 2 * border
    for i, t in enumerate(tiles):
        y, x = i // across * tile, i % across * tile
        place = out[y : y + tile, x : x + tile]
        if isinstance(t, tuple):
            place[:] = t
        else:
            if len(t) != whole * whole * 4:
                raise ValueError(f"{len(t)} bytes of a tile of {whole * whole * 4}")
            inner = np.frombuffer(t, np.uint8).reshape(whole, whole, 4)[border : border + tile, border : border + tile]
            place[:] = inner[: place.shape[0], : place.shape[1]]
    return out.tobytes()


def png(rgba: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGBA PNG in sRGB."""
    part = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    lines = np.zeros((height, 1 + 4 * width), np.uint8)
    lines[:, 1:] = np.frombuffer(rgba, np.uint8).reshape(height, 4 * width)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"sRGB", b"\0") + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


@F.pandas_udf(T.StructType([T.StructField("png", T.BinaryType()), T.StructField("error", T.StringType())]))
def _to_png(fmt: pd.Series, data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    out = []
    for f, d, w, h in zip(fmt, data, width, height, strict=True):
        try:
            out.append((png(decode(f, d, int(w), int(h)), int(w), int(h)), None))
        except (ValueError, TypeError) as x:
            out.append((None, str(x)))
    return pd.DataFrame(out, columns=["png", "error"])


def to_png(fmt: Column, data: Column, width: Column, height: Column) -> Column:
    """struct(png, error) of encoded images."""
    return _to_png(fmt, data, width, height)
