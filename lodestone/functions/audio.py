"""PCM in RIFF containers as Column expressions, and blocks of ADPCM as numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import IMA_INDEX, IMA_STEPS

#: MS ADPCM adaptation by code, and coefficients by predictor.
MS_ADAPT = (230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230)
MS_COEFFICIENTS = ((256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232))


def little(n: Column, size: int) -> Column:
    """An integer as `size` little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)]))


def unsigned(data: Column, at: int, size: int) -> Column:
    """The little-endian integer of `size` bytes at `at`; null past the end."""
    digits = F.concat(*[F.hex(F.substring(data, at + 1 + i, 1)) for i in reversed(range(size))])
    return F.when(F.length(data) >= at + size, F.conv(digits, 16, 10).cast("long"))


def pcm_wav(data: Column, channels: Column, rate: Column, bits: int = 16) -> Column:
    """A WAV file of PCM samples: the 44 bytes of header, then data."""
    n, frame = F.length(data), channels * (bits // 8)
    text = lambda s: F.lit(bytearray(s))
    return F.concat(text(b"RIFF"), little(n + 36, 4), text(b"WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * frame, 4), little(frame, 2), little(F.lit(bits), 2), text(b"data"), little(n, 4), data)


def wav_info(data: Column) -> Column:
    """struct(channels, rate, bits, frames) of a plain PCM WAV; null for anything else."""
    plain = (F.substring(data, 1, 4) == F.lit(bytearray(b"RIFF"))) & (F.substring(data, 9, 8) == F.lit(bytearray(b"WAVEfmt "))) & (unsigned(data, 20, 2) == 1) & (F.substring(data, 37, 4) == F.lit(bytearray(b"data")))
    frame = unsigned(data, 32, 2)
    return F.when(plain & (frame > 0), F.struct(unsigned(data, 22, 2).alias("channels"), unsigned(data, 24, 4).alias("rate"), unsigned(data, 34, 2).alias("bits"), F.floor(unsigned(data, 40, 4) / frame).alias("frames")))


def _samples(blocks: pd.Series, channels: pd.Series, head: int, decode) -> pd.Series:
    """decode over all blocks of one length and number of channels at once; null for blocks that are none."""
    out = [None] * len(blocks)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (b, c) in enumerate(zip(blocks, channels, strict=True)):
        if b is not None and c in (1, 2) and len(b) >= head * c:
            shapes.setdefault((len(b), int(c)), []).append(i)
    for (_, c), rows in shapes.items():
        got, ok = decode(np.stack([np.frombuffer(blocks.iloc[i], np.uint8) for i in rows]), c)
        for i, x, good in zip(rows, got, ok, strict=True):
            out[i] = x.tolist() if good else None
    return pd.Series(out)


def ima_run(codes: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Samples of rows of 4-bit codes from each row's predictor and step: a step of the loop takes all rows."""
    steps, moves, out = np.array(IMA_STEPS), np.array(IMA_INDEX), np.empty(codes.shape, np.int32)
    for i in range(codes.shape[1]):
        code, size = codes[:, i], steps[at]
        diff = (size >> 3) + (code & 1) * (size >> 2) + (code >> 1 & 1) * (size >> 1) + (code >> 2 & 1) * size
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        at = np.clip(at + moves[code & 7], 0, len(steps) - 1)
        out[:, i] = value
    return out


def _ima(block: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    n, words = len(block), (block.shape[1] - 4 * channels) // (4 * channels)
    heads = block[:, : 4 * channels].reshape(n, channels, 4)
    value, at = np.ascontiguousarray(heads[:, :, :2]).view("<i2")[..., 0].astype(np.int32), heads[:, :, 2].astype(np.int64)
    data = block[:, 4 * channels : 4 * channels * (1 + words)].reshape(n, words, channels, 4)
    codes = np.stack([data & 15, data >> 4], axis=-1).transpose(0, 2, 1, 3, 4).reshape(n * channels, words * 8).astype(np.int64)
    run = ima_run(codes, value.ravel(), np.minimum(at, len(IMA_STEPS) - 1).ravel()).reshape(n, channels, -1)
    both = np.concatenate([value[:, :, None], run], axis=2)
    return both.transpose(0, 2, 1).reshape(n, -1), (at < len(IMA_STEPS)).all(axis=1) & ((block.shape[1] - 4 * channels) % (4 * channels) == 0)


def _ms(block: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    n, which = len(block), block[:, :channels].astype(int)
    heads = np.ascontiguousarray(block[:, channels : 7 * channels]).view("<i2").reshape(n, 3, channels).astype(np.int64)
    delta, one, two = heads[:, 0], heads[:, 1], heads[:, 2]
    c1, c2 = (np.array([c[k] for c in MS_COEFFICIENTS])[np.minimum(which, len(MS_COEFFICIENTS) - 1)] for k in (0, 1))
    data = block[:, 7 * channels :]
    codes = np.stack([data >> 4, data & 15], axis=-1).reshape(n, -1).astype(np.int64)
    codes = codes.reshape(n, -1, channels)
    adapt, out = np.array(MS_ADAPT), [two, one]
    toward_zero = lambda x: np.where(x < 0, -(-x // 256), x // 256)
    for i in range(codes.shape[1]):
        code = codes[:, i]
        sample = np.clip(toward_zero(one * c1 + two * c2) + (code - 16 * (code >> 3)) * delta, -32768, 32767)
        two, one = one, sample
        delta = np.maximum(np.minimum(adapt[code] * delta, 2**31 - 1) // 256, 16)  # a delta stays within 32 bits
        out.append(sample)
    return np.stack(out, axis=1).reshape(n, -1), (which < len(MS_COEFFICIENTS)).all(axis=1)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ima_samples(block: pd.Series, channels: pd.Series) -> pd.Series:
    """Interleaved samples of one block of IMA ADPCM: per channel four bytes of header, then words of eight codes in turn; null if it is none."""
    return _samples(block, channels, 4, _ima)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ms_samples(block: pd.Series, channels: pd.Series) -> pd.Series:
    """Interleaved samples of one block of MS ADPCM: seven bytes of header per channel, then codes in turn; null if it is none."""
    return _samples(block, channels, 7, _ms)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ima_fold(codes: pd.Series) -> pd.Series:
    """Samples of 4-bit IMA codes without a header, from predictor 0 and step 0."""
    out: list = [None] * len(codes)
    by_size: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        if c is not None:
            by_size.setdefault(len(c), []).append(i)
    for rows in by_size.values():
        zeros = np.zeros(len(rows), np.int64)
        for i, x in zip(rows, ima_run(np.stack([np.asarray(codes.iloc[i], np.int64) for i in rows]), zeros, zeros), strict=True):
            out[i] = x.tolist()
    return pd.Series(out)
