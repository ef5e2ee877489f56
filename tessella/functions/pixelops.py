"""Per-pixel NumPy kernels for one tile block (height, width, channels).

Each function is one vectorised formula; partitioning, joins and statistics stay with Spark.
"""

from __future__ import annotations

import math

import numpy as np

from tessella.functions import constants as K


def normalize(block: np.ndarray, lo, hi) -> np.ndarray:
    """Map each channel's range to 0..1; float channels already in 0..1 stay, bad floats become 0."""
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    span = hi - lo
    inverse = np.where(np.abs(span) > 1e-30, 1.0 / np.where(span == 0, 1.0, span), 1e30)
    out = (block.astype(float) - lo) * inverse
    if block.dtype.kind == "f":
        out = np.where(np.isfinite(block), out, 0.0)
        out = np.where((lo == 0.0) & (hi == 1.0), block, out)
    return out


def gamma(block: np.ndarray, g: float) -> np.ndarray:
    return block if g == 1.0 else np.power(np.maximum(block, 0.0), g)


def log_transform(block: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.log(1.0 + 255.0 * block) / math.log(256.0)


def invert(block: np.ndarray) -> np.ndarray:
    return 1.0 - block


def contrast(block: np.ndarray, c: float) -> np.ndarray:
    scaled = block * (255.0 * c)
    return np.where(scaled < 255.0, np.maximum(scaled, 0.0), 255.0).astype(np.uint8)


def scale_to_8bit(block: np.ndarray) -> np.ndarray:
    shift = {"u2": 8, "u4": 16}.get(block.dtype.str[1:])
    return block if shift is None else ((block >> shift) & 255).astype(np.uint8)


def light_vector(h_angle: int, v_angle: int) -> tuple[float, float, float]:
    """Unit vector towards the light; horizontal angle from 12 o'clock, vertical one downwards."""
    y = math.cos(math.radians(h_angle))
    x = math.copysign(math.sqrt(max(0.0, 1.0 - y * y)), -1.0 if h_angle > 180 else 1.0)
    z = -math.sin(math.radians(v_angle))
    n = math.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def hillshade(block: np.ndarray, h_angle: int, v_angle: int) -> np.ndarray:
    normals = block[..., :3]
    facing = (1.0 - 2.0 * normals) @ np.array(light_vector(h_angle, v_angle))
    lit = np.where((normals == 0).all(axis=-1), 0.0, 0.5 * facing)
    return np.clip(lit, 0.0, 1.0)[..., None]


def twist(block: np.ndarray, matrix) -> np.ndarray:
    """Each matrix row makes one output channel; coefficients beyond the channels are ignored."""
    rows = np.zeros((len(matrix), block.shape[2]))
    for k, row in enumerate(matrix):
        used = row[: block.shape[2]]
        rows[k, : len(used)] = used
    return block @ rows.T


def colormap(block: np.ndarray, name: str) -> np.ndarray:
    """First channel to three channels; piecewise linear."""
    v = block[..., 0]
    if name in ("RED", "GREEN", "BLUE"):
        out = np.zeros((*v.shape, 3))
        out[..., ("RED", "GREEN", "BLUE").index(name)] = v
        return out
    if name in ("HOT", "COLD"):
        ramps = [np.clip(3.0 * v - k, 0.0, 1.0) for k in range(3)]
        return np.stack(ramps if name == "HOT" else ramps[::-1], axis=-1)
    # JET: three trapezoids, black below 0, half red from 1 on.
    tent = [np.clip(1.5 - np.abs(4.0 * v - k), 0.0, 1.0) for k in (3, 2, 1)]
    out = np.stack(tent, axis=-1)
    out[v < 0] = 0.0
    out[v >= 1] = (0.5, 0.0, 0.0)
    return out


def lab_unpack(block: np.ndarray) -> np.ndarray:
    if block.dtype == np.uint8:
        return np.concatenate([block[..., :1] / 2.55, block[..., 1:3].view(np.int8).astype(float)], axis=-1)
    if block.dtype == np.uint16:
        signed = np.ascontiguousarray(block[..., 1:3]).view(np.int16) >> 8
        return np.concatenate([(block[..., :1] >> 1) / 327.67, signed.astype(float)], axis=-1)
    return block[..., :3].astype(float)


def lab_to_srgb(lab: np.ndarray) -> np.ndarray:
    light, a, b = lab[..., 0], lab[..., 1], lab[..., 2]
    dark = light < 8.0
    fy = np.where(dark, 7.787 * (light / 903.3) + 16.0 / 116.0, (light + 16.0) / 116.0)
    y = np.where(dark, light * K.D65_Y / 903.3, K.D65_Y * fy**3)
    fx, fz = a / 500.0 + fy, fy - b / 200.0

    def cube(t: np.ndarray) -> np.ndarray:
        return np.where(t < 0.2069, (t - 0.13793) / 7.787, t**3)

    xyz = np.stack([K.D65_X * cube(fx), y, K.D65_Z * cube(fz)], axis=-1) / 100.0
    rgb = np.maximum(xyz @ np.array(K.XYZ_TO_RGB).T, 0.0)
    curved = np.where(rgb <= 0.0031308, rgb * 12.92, 1.055 * np.power(rgb, 1.0 / 2.4) - 0.055)
    return np.minimum(curved, 1.0)


def srgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    rgb = rgb[..., :3]
    linear = np.where(rgb <= 0.04045, rgb / 12.92, np.power((rgb + 0.055) / 1.055, 2.4))
    xyz = 100.0 * (linear @ np.array(K.RGB_TO_XYZ).T) / np.array([K.D65_X, K.D65_Y, K.D65_Z])
    root = np.where(xyz > K.LAB_EDGE, np.power(xyz, 1.0 / 3.0), K.LAB_SLOPE * xyz + K.LAB_OFFSET)
    x, y, z = root[..., 0], root[..., 1], root[..., 2]
    return np.stack([116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)], axis=-1)


def greyscale(block: np.ndarray) -> np.ndarray:
    """8-bit colour to grey in fixed point; other blocks stay."""
    if block.dtype != np.uint8 or block.shape[2] != 3:
        return block
    weighted = block.astype(np.uint32) @ np.array([K.LUMA_R, K.LUMA_G, K.LUMA_B], np.uint32)
    return (weighted >> K.LUMA_SHIFT).astype(np.uint8)[..., None]


def flatten(block: np.ndarray, bands: int) -> np.ndarray:
    return block[..., :bands]


def output_bands(channels: int, fmt: str) -> int:
    """Bands an output format keeps."""
    if fmt == "JPEG" and channels == 2:
        return 1
    limit = {"JPEG": 3, "PNG": 4, "WEBP": 4, "AVIF": 4}.get(fmt)
    return channels if limit is None or channels <= limit else 3


def binary(block: np.ndarray, threshold: int) -> np.ndarray:
    if block.dtype != np.uint8:
        return block
    grey = greyscale(block)
    return np.where(grey < threshold, 0, 255).astype(np.uint8)


def lookup(block: np.ndarray, table) -> np.ndarray:
    """Map 8-bit values through a 256-entry table."""
    return np.asarray(table, np.uint8)[block]


def triplicate(block: np.ndarray) -> np.ndarray:
    return np.repeat(block, 3, axis=2) if block.shape[2] == 1 else block


def unpack_bits(data: bytes, height: int, width: int, channels: int, bits: int, min_is_white: bool = False) -> np.ndarray:
    """Widen packed samples (rows start on a byte): 1, 2, 4, 6 bit to 8, and 10, 12, 14 bit to 16."""
    per_row = width * channels
    row_bytes = -(-per_row * bits // 8)
    raw = np.frombuffer(data, np.uint8)[: height * row_bytes].reshape(height, row_bytes)
    flags = np.unpackbits(raw, axis=1)[:, : per_row * bits].reshape(height, per_row, bits)
    value = flags.astype(np.uint32) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint32))
    return widen(value, bits, min_is_white).reshape(height, width, channels)


def widen(value: np.ndarray, bits: int, min_is_white: bool = False) -> np.ndarray:
    if bits == 1:
        wide = value * 255
    elif bits == 2:
        wide = value * 85
    else:
        room = (8 if bits < 8 else 16) - bits
        wide = (value << room) | (value >> (bits - room))
    kind = np.uint8 if bits < 8 else np.uint16
    wide = wide.astype(kind)
    return ~wide if min_is_white else wide


def equalize_lookup(hist, pixels: int) -> np.ndarray:
    """256-entry equalisation map of a histogram for an output of ``pixels`` pixels."""
    counts = np.asarray(hist, float)
    used = np.flatnonzero(counts)
    if not len(used):
        return np.arange(256, dtype=np.uint8)
    running = np.cumsum(counts)
    mapped = np.floor(255.0 / running[-1] * (running - counts[used[0]] / pixels) + 0.5)
    return (mapped.astype(np.int64) % 256).astype(np.uint8)


def turn(block: np.ndarray, flip: int, rot: int) -> np.ndarray:
    """Flip (1 left to right, 2 upside down), then turn clockwise."""
    if flip:
        block = block[::-1] if flip == 2 else block[:, ::-1]
    return np.rot90(block, -(rot % 360) // 90) if rot % 90 == 0 else block
