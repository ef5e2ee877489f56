"""Fixed values that results depend on."""

# D65 white point (CIE 1931, 2 degree observer), Y = 100.
D65_X, D65_Y, D65_Z = 95.0470, 100.0, 108.8827

# XYZ to linear sRGB, rows R, G, B.
XYZ_TO_RGB = [
    [3.2406255, -1.537208, -0.4986286],
    [-0.9689307, 1.8757561, 0.0415175],
    [0.0557101, -0.2040211, 1.0569959],
]

# Linear sRGB to XYZ, rows X, Y, Z.
RGB_TO_XYZ = [
    [0.4124564, 0.3575761, 0.1804375],
    [0.2126729, 0.7151522, 0.0721750],
    [0.0193339, 0.1191920, 0.9503041],
]

# XYZ to CIELAB, linear part below the edge.
LAB_EDGE, LAB_SLOPE, LAB_OFFSET = 0.008856452, 7.787037037, 0.137931034

# Luminance weights in 22-bit fixed point.
LUMA_R, LUMA_G, LUMA_B, LUMA_SHIFT = 1254097, 2462056, 478151, 22

# Named 3x3 kernels, row by row.
KERNELS = {
    "sobel": [-1, 0, 1, -2, 0, 2, -1, 0, 1],
    "prewitt": [1, 0, -1, 1, 0, -1, 1, 0, -1],
    "scharr": [-3, 0, 3, -10, 0, 10, -3, 0, 3],
    "laplace": [-1, -1, -1, -1, 8, -1, -1, -1, -1],
    "gaussian": [1, 2, 1, 2, 4, 2, 1, 2, 1],
    "sharpen": [0, -1, 0, -1, 5, -1, 0, -1, 0],
    "emboss": [-2, -1, 0, -1, 1, 1, 0, 1, 2],
}
MAX_KERNEL = 25

# File signatures of the known formats (hexadecimal).
SIGNATURES = [
    ("JPEG2000", "0000000C6A5020200D0A"),
    ("JPEG", "FFD8FF"),
    ("TIFF", "492049"),
    ("TIFF", "49492A00"),
    ("TIFF", "4D4D002A"),
    ("TIFF", "49492B00"),
    ("TIFF", "4D4D002B"),
]

# Command names of the request protocol.
COMMANDS = [
    "obj", "fif", "qlt", "sds", "minmax", "cnt", "gam", "wid", "hei", "rgn", "rot", "til", "ptl", "wtl", "atl",
    "jtl", "ttl", "jtls", "icc", "cvt", "shd", "cmp", "inv", "zoomify", "spectra", "pfl", "lyr", "deepzoom",
    "ctw", "col", "cnv", "iiif",
]

MAX_SIZE = 5000
COLORMAPS = ["HOT", "COLD", "JET", "RED", "GREEN", "BLUE"]
