"""Framed zlib chunks of bulk records, as an Arrow UDF."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the mark at the head of a chunked payload.
CHUNK_MARK = 0x9E2A83C1


def inflate_chunks(data: bytes, size: int) -> bytes:
    """The payload behind mark, block size, both total sizes and each chunk's sizes (64 bits each); ValueError if anything disagrees with that or with size."""
    if len(data) < 32:
        raise ValueError(f"{len(data)} bytes hold no header")
    mark, block, packed, whole = struct.unpack_from("<4q", data)
    if mark != CHUNK_MARK:
        raise ValueError(f"mark {mark:#x}")
    if whole != size or block <= 0:
        raise ValueError(f"{whole} bytes in blocks of {block}, not {size}")
    n = -(-whole // block)
    at = 32 + 16 * n
    if at + packed > len(data) or packed < 0:
        raise ValueError("past the end")
    out = []
    for i in range(n):
        small, large = struct.unpack_from("<2q", data, 32 + 16 * i)
        want = min(block, whole - i * block)
        if large != want or not 0 <= small <= len(data) - at:
            raise ValueError(f"chunk {i} of {small} and {large} bytes")
        part = zlib.decompressobj().decompress(data[at : at + small], want + 1)
        if len(part) != want:
            raise ValueError(f"chunk {i} has {len(part)} bytes of {want}")
        out.append(part)
        at += small
    if at != 32 + 16 * n + packed:
        raise ValueError(f"chunks of {at - 32 - 16 * n} bytes, not {packed}")
    return b"".join(out)


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]))
def _inflated(data: pd.Series, size: pd.Series) -> pd.DataFrame:
    out = []
    for d, n in zip(data, size, strict=True):
        try:
            out.append((None, "null") if d is None or pd.isna(n) else (inflate_chunks(d, int(n)), None))
        except (ValueError, zlib.error, OverflowError) as x:
            out.append((None, str(x)))
    return pd.DataFrame(out, columns=["data", "error"])


def inflated(data: Column, size: Column) -> Column:
    """struct(data, error) of chunked payloads of a declared size."""
    return _inflated(data, size)
