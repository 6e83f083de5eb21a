"""Packed numbers, hashes, colours, vectors and weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: IMA ADPCM step sizes and index steps.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
    13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
_LOW = 0xFFFFFFFF


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals as SQL engines in C round it: x * 10**digits to a whole number, halves away from zero, a zero with its sign; x if the product is not finite.

    F.round takes the decimal text of x instead, which is now and then on the other side of a half, and has no -0.0.
    """
    y = x * float(10**digits)
    return F.when(F.abs(y) < 0.5, x * 0.0).when(F.abs(y) < float("inf"), F.round(y) / float(10**digits)).otherwise(x)


def spread_bits(x: Column) -> Column:
    """The low 16 bits at the even places."""
    x = x.bitwiseAND(0xFFFF)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseXOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def morton(x: Column, y: Column) -> Column:
    """Z-order address of (x, y), 16 bits each."""
    return spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(spread_bits(y.cast("long")), 1))


def path_hash(path: Column, seed: int = 0) -> Column:
    """FNV-1a over the UTF-16LE bytes of path with A-Z lower-cased, as 16 hex digits.

    The state is two 32-bit halves in longs, as 64-bit products would overflow: the prime is
    2**40 + 435, so the product is a shift and a small product.
    """
    start = (FNV_BASIS + seed) % (1 << 64)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    data = F.hex(F.encode(F.translate(path, upper, upper.lower()), "UTF-16LE"))
    n = (F.length(data) / 2).cast("int")
    octets = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        wide = lo * (FNV_PRIME & 0xFFFF)
        hi = (h["hi"] * (FNV_PRIME & 0xFFFF) + F.shiftright(wide, 32) + F.shiftleft(lo, 8)).bitwiseAND(_LOW)
        return F.struct(hi.alias("hi"), wide.bitwiseAND(_LOW).alias("lo"))

    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    first = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & _LOW).cast("long").alias("lo"))
    return F.aggregate(octets, first, step, lambda h: F.concat(digits(h["hi"]), digits(h["lo"])))


#: Coefficients of the filmic curve and of sRGB, in tone_map and srgb.


def tone_map(x: Column) -> Column:
    """Filmic curve of a linear value: 0 for NaN and below, at most 1."""
    x = F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(65504.0)))
    y = x * (x * 2.51 + 0.03) / (x * (x * 2.43 + 0.59) + 0.14)
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))


def srgb(c: Column) -> Column:
    """Linear to sRGB."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1.0 / 2.4)) * 1.055 - 0.055)


def byte(c: Column) -> Column:
    """[0, 1] to 0..255, to the nearest."""
    return F.least(F.greatest(F.floor(c * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")


def packed_normal(raw: Column, flipped: bool = True) -> Column:
    """Four components in [-1, 1] of a 32-bit word, lowest byte first; flipped: high bits of the bytes inverted."""
    word = raw.cast("long").bitwiseAND(_LOW)
    word = word.bitwiseXOR(0x80808080) if flipped else word
    return F.array(*[F.shiftright(word, 8 * i).bitwiseAND(0xFF) / 127.5 - 1.0 for i in range(4)])


def unit_vector(v: Column) -> Column:
    """v over its length; as it is if that is zero or not finite."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ok = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def renormalized(w: Column, target: int = 255) -> Column:
    """Non-negative integer weights scaled to sum to target: rounded half up, the rest to the largest, the last of equals; all zero gives the first everything."""
    total = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)
    scaled = F.transform(w, lambda x: F.floor((x * target + F.floor(total / 2)) / total).cast("long"))
    pairs = F.transform(scaled, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    top = F.array_max(pairs)["i"]
    rest = F.lit(target) - F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x)
    fixed = F.transform(scaled, lambda x, i: F.when(i == top, F.greatest(F.least(x + rest, F.lit(target).cast("long")), F.lit(0).cast("long"))).otherwise(x))
    nothing = F.transform(w, lambda x, i: F.when(i == 0, F.lit(target).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(total == 0, nothing).otherwise(fixed)
