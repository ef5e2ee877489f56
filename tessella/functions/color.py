"""Per-pixel transforms as Column expressions, for tables with one row per sample or per pixel.

They stay inside whole-stage codegen.  The tile kernels in ``pixelops`` give the same results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import constants as K
from tessella.functions.pixelops import light_vector


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def normalize(v: Column, lo: Column, hi: Column, floating: bool = False) -> Column:
    span = hi - lo
    inverse = F.when(F.abs(span) > 1e-30, 1.0 / span).otherwise(1e30)
    out = (v - lo) * inverse
    if floating:
        bad = F.isnan(v) | (F.abs(v) == float("inf"))
        out = F.when((lo == 0) & (hi == 1), v).when(bad, 0.0).otherwise(out)
    return out


def gamma(v: Column, g: float) -> Column:
    return v if g == 1.0 else F.pow(F.greatest(v, F.lit(0.0)), F.lit(g))


def log_transform(v: Column) -> Column:
    return F.ln(1.0 + 255.0 * v) / F.ln(F.lit(256.0))


def invert(v: Column) -> Column:
    return 1.0 - v


def contrast(v: Column, c: float) -> Column:
    return F.floor(clip(v * (255.0 * c), 0.0, 255.0)).cast("int")


def scale_to_8bit(v: Column, bpc: int) -> Column:
    if bpc <= 8:
        return v.cast("int")
    return (F.shiftright(v.cast("long"), 16 if bpc == 32 else 8) % 256).cast("int")


def greyscale(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * K.LUMA_R + g * K.LUMA_G + b * K.LUMA_B, K.LUMA_SHIFT).cast("int")


def binary(v: Column, threshold: Column) -> Column:
    return F.when(v < threshold, 0).otherwise(255)


def colormap(v: Column, name: str) -> list[Column]:
    """Three output channels."""
    zero = F.lit(0.0)
    if name in ("RED", "GREEN", "BLUE"):
        return [v if n == name else zero for n in ("RED", "GREEN", "BLUE")]
    if name in ("HOT", "COLD"):
        ramps = [clip(3.0 * v - float(k), 0.0, 1.0) for k in range(3)]
        return ramps if name == "HOT" else ramps[::-1]
    ends = (0.5, 0.0, 0.0)
    tents = [clip(1.5 - F.abs(4.0 * v - float(k)), 0.0, 1.0) for k in (3, 2, 1)]
    return [F.when(v < 0, 0.0).when(v >= 1, end).otherwise(tent) for tent, end in zip(tents, ends)]


def hillshade(x: Column, y: Column, z: Column, h_angle: int, v_angle: int) -> Column:
    lx, ly, lz = light_vector(h_angle, v_angle)
    facing = (1.0 - 2.0 * x) * lx + (1.0 - 2.0 * y) * ly + (1.0 - 2.0 * z) * lz
    return F.when((x == 0) & (y == 0) & (z == 0), 0.0).otherwise(clip(0.5 * facing, 0.0, 1.0))


def twist(channels: list[Column], matrix: list[list[float]]) -> list[Column]:
    """One sum per matrix row; zero coefficients and those beyond the channels vanish from the plan."""
    rows = []
    for row in matrix:
        terms = [c * float(m) for c, m in zip(channels, row) if m]
        rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return rows


def lab_unpack(light: Column, a: Column, b: Column, bpc: int, floating: bool = False) -> list[Column]:
    if floating:
        return [light, a, b]
    if bpc == 8:
        return [light / 2.55, *[(v - F.when(v > 127, 256).otherwise(0)).cast("double") for v in (a, b)]]
    high = [F.floor(v / 256) for v in (a, b)]
    return [F.floor(light / 2) / 327.67, *[(v - F.when(v > 127, 256).otherwise(0)).cast("double") for v in high]]


def lab_to_srgb(light: Column, a: Column, b: Column) -> list[Column]:
    dark = light < 8.0
    fy = F.when(dark, 7.787 * (light / 903.3) + 16.0 / 116.0).otherwise((light + 16.0) / 116.0)
    y = F.when(dark, light * K.D65_Y / 903.3).otherwise(K.D65_Y * F.pow(fy, F.lit(3.0))) / 100.0

    def cube(t: Column) -> Column:
        return F.when(t < 0.2069, (t - 0.13793) / 7.787).otherwise(F.pow(t, F.lit(3.0)))

    x = K.D65_X * cube(a / 500.0 + fy) / 100.0
    z = K.D65_Z * cube(fy - b / 200.0) / 100.0
    out = []
    for mx, my, mz in K.XYZ_TO_RGB:
        v = F.greatest(x * mx + y * my + z * mz, F.lit(0.0))
        curved = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)
        out.append(F.least(curved, F.lit(1.0)))
    return out


def srgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    linear = [F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))) for v in (r, g, b)]
    roots = []
    for row, white in zip(K.RGB_TO_XYZ, (K.D65_X, K.D65_Y, K.D65_Z)):
        t = 100.0 * sum((c * m for c, m in zip(linear[1:], row[1:])), linear[0] * row[0]) / white
        roots.append(F.when(t > K.LAB_EDGE, F.pow(t, F.lit(1.0 / 3.0))).otherwise(K.LAB_SLOPE * t + K.LAB_OFFSET))
    x, y, z = roots
    return [116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)]


def unpack_sample(v: Column, bits: int, min_is_white: bool = False) -> Column:
    """Widen one packed sample value: 1, 2, 4, 6 bit to 8 and 10, 12, 14 bit to 16."""
    top = 255 if bits < 8 else 65535
    if bits == 1:
        wide = v * 255
    elif bits == 2:
        wide = v * 85
    else:
        room = (8 if bits < 8 else 16) - bits
        wide = F.shiftleft(v, room).bitwiseOR(F.shiftright(v, bits - room))
    return (top - wide if min_is_white else wide).cast("int")
