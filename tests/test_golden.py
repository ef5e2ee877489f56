"""Numbers worked out by hand from the formulae."""

import numpy as np
import pytest

from tessella.functions import pixelops as P
from tessella.functions.kernels import kernel


def one(*values, kind=float):
    return np.array(values, kind).reshape(1, 1, -1)


def test_lab_white_black_grey():
    assert np.allclose(P.lab_to_srgb(one(100, 0, 0)), 1.0, atol=2e-3)
    assert np.allclose(P.lab_to_srgb(one(0, 0, 0)), 0.0, atol=1e-3)
    back = P.srgb_to_lab(P.lab_to_srgb(one(53.0, 20.0, -30.0)))
    assert np.allclose(back, one(53.0, 20.0, -30.0), atol=0.05)


def test_lab_unpack_signed():
    assert np.allclose(P.lab_unpack(one(255, 128, 127, kind=np.uint8)), one(100, -128, 127))
    assert np.allclose(P.lab_unpack(one(65535, 0x8000, 0x7F00, kind=np.uint16)), one(32767 / 327.67, -128, 127))


@pytest.mark.parametrize(
    "name,v,want",
    [
        ("HOT", 0.0, (0, 0, 0)), ("HOT", 0.5, (1, 0.5, 0)), ("HOT", 1.5, (1, 1, 1)), ("COLD", 0.5, (0, 0.5, 1)),
        ("JET", -0.1, (0, 0, 0)), ("JET", 0.0, (0, 0, 0.5)), ("JET", 0.5, (0.5, 1, 0.5)), ("JET", 1.0, (0.5, 0, 0)), ("GREEN", 0.3, (0, 0.3, 0)),
    ],
)
def test_colormaps(name, v, want):
    assert np.allclose(P.colormap(one(v), name)[0, 0], want)


def test_range_steps():
    assert np.allclose(P.normalize(one(5, 300, kind=np.uint16), [0, 100], [10, 300]), one(0.5, 1.0))
    assert P.normalize(one(np.nan, 3.0), [0, 0], [2, 2]).tolist() == [[[0.0, 1.5]]]
    assert P.contrast(one(-1, 0.5, 2, np.nan), 1.0).tolist() == [[[0, 127, 255, 255]]]
    assert P.scale_to_8bit(one(0x1234, kind=np.uint16)).tolist() == [[[0x12]]]
    assert P.scale_to_8bit(one(0x12345678, kind=np.uint32)).tolist() == [[[0x34]]]
    assert P.greyscale(one(255, 255, 255, kind=np.uint8)).tolist() == [[[255]]]


def test_light_and_bands():
    assert np.allclose(P.light_vector(0, 0), (0, 1, 0), atol=1e-12)
    assert P.light_vector(270, 10)[0] < 0 < P.light_vector(90, 10)[0]
    assert [P.output_bands(n, "JPEG") for n in (1, 2, 3, 4, 7)] == [1, 1, 3, 3, 3]
    assert [P.output_bands(n, "PNG") for n in (2, 4, 5)] == [2, 4, 3]


def test_kernel_rules():
    assert kernel("Sobel") == [-1, 0, 1, -2, 0, 2, -1, 0, 1]
    assert kernel([1.0] * 4) is None and kernel([1.0] * 49) is None and kernel("none") is None


@pytest.mark.parametrize("bits,value,want", [(1, 1, 255), (2, 2, 170), (4, 9, 0x99), (6, 33, 134), (10, 1023, 65535), (12, 0xABC, 0xABCA), (14, 1, 4)])
def test_widening(bits, value, want):
    assert int(P.widen(np.array([value], np.uint32), bits)[0]) == want
    white = P.widen(np.array([value], np.uint32), bits, True)[0]
    assert int(white) == (255 if bits < 8 else 65535) - want
