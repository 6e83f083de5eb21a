"""Positions, directions, index buffers, matrices and flags as Column expressions; skeletons as grouped numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centimetres to metres, and the basis (x, y, z) -> (x, z, y) in metres.
SCALE = 0.01
BASIS = np.array([[SCALE, 0, 0, 0], [0, 0, SCALE, 0], [0, SCALE, 0, 0], [0, 0, 0, 1.0]])
#: Bits of a bulk record's flags.
BULK_BITS = {
    "end_of_file": 0x1, "zlib": 0x2, "single_element": 0x4, "single_use": 0x8, "lzo": 0x10, "unused": 0x20, "force_inline": 0x40, "force_stream": 0x80, "separate_file": 0x100, "bitwindow": 0x200, "not_inline": 0x400,
    "optional": 0x800, "memory_mapped": 0x1000, "size_64": 0x2000, "duplicate": 0x4000, "bad_version": 0x8000, "no_fixup": 0x10000, "workspace": 0x20000, "lazy": 0x40000, "discard": 0x10000000, "pending": 0x20000000, "mapped_data": 0x40000000,
}
#: Strip flags of the global byte.
EDITOR_STRIPPED, AV_STRIPPED = 1, 2


def position(v: Column) -> Column:
    """Centimetres, z up, to metres, y up."""
    return F.array(*[v[i] * SCALE for i in (0, 2, 1)])


def direction(v: Column) -> Column:
    """Swapped as a position and of length one; as it is if its length is zero or not finite."""
    w = F.array(v[0], v[2], v[1])
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.when((n > 0) & (n < float("inf")), F.transform(w, lambda x: x / n)).otherwise(w)


def tangent(v: Column) -> Column:
    return F.concat(direction(v), F.array(-v[3]))


def packed_rgba16(words: Column, flipped: bool = True) -> Column:
    """Four 16-bit words to [-1, 1]; flipped: their high bits inverted."""
    return F.transform(words, lambda s: ((s.cast("long").bitwiseXOR(0x8000) if flipped else s.cast("long")).bitwiseAND(0xFFFF) - 32767.5) / 32767.5)


def mip_size(base: Column, level: Column) -> Column:
    """base halved level times, at least 1; 0 stays 0."""
    return F.when(base == 0, 0).when(level >= 32, 1).otherwise(F.greatest(F.floor(base / F.pow(F.lit(2.0), level)), F.lit(1))).cast("long")


def slice_count(kind: Column, packed: Column, depth: Column) -> Column:
    """Slices of a texture's kind; null where they are not valid: a cube has six, arrays and volumes at least one."""
    cube = packed.bitwiseAND((1 << 30) - 1)
    return F.when(kind == "2d", 1).when((kind == "cube") & (cube == 6), 6).when(kind.isin("array", "volume") & (depth >= 1), depth).cast("long")


def section_span(first: Column, triangles: Column, n: Column) -> Column:
    """struct(first, length): the indices of a section, inside the buffer, in whole triangles."""
    at = F.greatest(first.cast("long"), F.lit(0))
    room = F.greatest(F.least(at + F.greatest(triangles.cast("long"), F.lit(0)) * 3, n.cast("long")) - at, F.lit(0))
    return F.struct(at.alias("first"), (room - room % 3).alias("length"))


def within(indices: Column, n: Column) -> Column:
    return F.forall(indices, lambda i: i < n)


def reverse_winding(indices: Column) -> Column:
    """The second and third index of each whole triangle exchanged."""
    whole = F.size(indices) - F.size(indices) % 3
    return F.transform(indices, lambda x, i: F.when(i >= whole, x).when(i % 3 == 1, F.get(indices, i + 1)).when(i % 3 == 2, F.get(indices, i - 1)).otherwise(x))


def reverse_winding_within(indices: Column, n: Column) -> Column:
    """As reverse_winding; null if an index is not below n."""
    return F.when(within(indices, n), reverse_winding(indices))


def finite(matrix: Column) -> Column:
    return F.forall(matrix, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def stripped(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def bulk_flags(flags: Column) -> Column:
    """struct of the flags' bits by name, and known: no bit without a name is set."""
    return F.struct(*[stripped(flags, b).alias(k) for k, b in BULK_BITS.items()], (flags.bitwiseAND(~sum(BULK_BITS.values()) & 0xFFFFFFFF) == 0).alias("known"))


def bulk_tier(flags: Column, offset: Column, header_size: Column, shift: Column) -> Column:
    """struct(tier, at, fault): where a bulk record's bytes lie (inline, uexp, ubulk or uptnl), and from which byte."""
    f = bulk_flags(flags)
    at = F.when(f["no_fixup"], offset).otherwise(offset + shift)
    fault = F.when(~f["known"], "unknown flags").when(f["lzo"], "lzo").when(f["bitwindow"], "bitwindow").when(at < 0, "offset").when(f["separate_file"] & f["end_of_file"], "conflicting tiers").when(~f["separate_file"] & ~f["end_of_file"], "no tier")
    tier = F.when(f["separate_file"], F.when(f["optional"], "uptnl").otherwise("ubulk")).otherwise(F.when(at < header_size, "inline").otherwise("uexp"))
    return F.struct(F.when(fault.isNull(), tier).alias("tier"), F.when(fault.isNull(), at).alias("at"), fault.alias("fault"))


def block_budget(remaining: Column, block: Column, last: Column) -> Column:
    """Bytes that a compressed block may hold: all that remain in the last one."""
    return F.when(last, remaining).otherwise(F.least(remaining, block))


def masked_pixel(px: Column, channels: str) -> Column:
    """An RGBA pixel (array of four) with the given channels: alone as grey, else the others 0 and alpha full."""
    if len(channels) == 1:
        one = px["rgba".index(channels)]
        return F.array(one, one, one, F.lit(255))
    return F.array(*[px[i] if c in channels else F.lit(0 if c != "a" else 255) for i, c in enumerate("rgba")])


def projected_bytes(vertices: Column, uv_sets: Column, coloured: Column, indices: Column) -> Column:
    """Bytes of a skinned mesh's attributes: positions, normals, tangents, skin, texture coordinates, colours and indices."""
    return vertices * (12 + 12 + 16 + 32) + vertices * uv_sets * 8 + F.when(coloured, vertices * 4).otherwise(0) + indices * 4


def local_matrix(rotation: np.ndarray, translation: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """4 x 4 of translation * rotation * scale; rotation: quaternion (x, y, z, w) of any length."""
    x, y, z, w = rotation / np.linalg.norm(rotation)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = turn * scale, translation
    return out


def inverse_binds(bones: DataFrame, skeleton: str) -> DataFrame:
    """(skeleton, bone, matrix) of bones (skeleton, bone, parent, rotation, translation, scale): the inverse of each bone's global transform in the target basis, 16 numbers by column.

    Parents come before their children; a parent that does not is none. matrix is null if it is not finite. A skeleton is one group: it has hundreds of bones.
    """
    back = np.linalg.inv(BASIS)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, out, place = t.sort_values("bone"), [], {}
        with np.errstate(all="ignore"):
            for r in t.itertuples(index=False):
                local = local_matrix(*(np.array(x, float) for x in (r.rotation, r.translation, r.scale)))
                place[r.bone] = place[r.parent] @ local if r.parent in place else local
                try:
                    inverse = np.linalg.inv(BASIS @ place[r.bone] @ back)
                except np.linalg.LinAlgError:
                    inverse = np.full((4, 4), np.nan)
                out.append(inverse.T.ravel().tolist() if np.isfinite(inverse).all() else None)
        return pd.DataFrame({skeleton: t[skeleton], "bone": t["bone"], "matrix": out})

    kind = bones.schema[skeleton].dataType.simpleString()
    return bones.select(skeleton, "bone", "parent", "rotation", "translation", "scale").groupBy(skeleton).applyInPandas(run, f"{skeleton} {kind}, bone {bones.schema['bone'].dataType.simpleString()}, matrix array<double>")
