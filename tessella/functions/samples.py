"""Between the ``data`` column of a tile and a NumPy block of shape (height, width, channels)."""

from __future__ import annotations

import numpy as np

_DTYPES = {
    (8, "FIXEDPOINT"): "u1",
    (16, "FIXEDPOINT"): "<u2",
    (32, "FIXEDPOINT"): "<u4",
    (32, "FLOATINGPOINT"): "<f4",
    (64, "FLOATINGPOINT"): "<f8",
}


def dtype_of(bpc: int, sample_type: str) -> np.dtype:
    return np.dtype(_DTYPES[(bpc, sample_type)])


def type_of(block: np.ndarray) -> tuple[int, str]:
    kind = "FLOATINGPOINT" if block.dtype.kind == "f" else "FIXEDPOINT"
    return block.dtype.itemsize * 8, kind


def to_block(data: bytes, height: int, width: int, channels: int, bpc: int, sample_type: str) -> np.ndarray:
    return np.frombuffer(data, dtype_of(bpc, sample_type)).reshape(height, width, channels)


def to_bytes(block: np.ndarray) -> bytes:
    return np.ascontiguousarray(block).tobytes()
