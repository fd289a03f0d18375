"""Colour science as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions.scalars import clamp

# Public sRGB / Bradford / CIE constants.
SRGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
XYZ_TO_SRGB = (
    (3.2404542, -1.5371385, -0.4985314),
    (-0.9692660, 1.8760108, 0.0415560),
    (0.0556434, -0.2040259, 1.0572252),
)
BRADFORD = (
    (0.8951, 0.2664, -0.1614),
    (-0.7502, 1.7135, 0.0367),
    (0.0389, -0.0685, 1.0296),
)
BRIGHTNESS_WEIGHTS = (0.299, 0.587, 0.114)
ILLUMINANTS = {
    "D65": (0.95047, 1.0, 1.08883),
    "D50": (0.96422, 1.0, 0.82521),
    "A": (1.09850, 1.0, 0.35585),
    "D55": (0.95682, 1.0, 0.92149),
    "D75": (0.94972, 1.0, 1.22638),
    "E": (1.0, 1.0, 1.0),
    "F2": (0.99187, 1.0, 0.67395),
    "F7": (0.95044, 1.0, 1.08755),
    "F11": (1.00966, 1.0, 0.64370),
}
LAB_EPSILON = 216.0 / 24389.0
LAB_KAPPA = 24389.0 / 27.0


def _inverse3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


BRADFORD_INVERSE = _inverse3(BRADFORD)


def mat_vec(m, v: Sequence) -> list:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m]


def mat_mul(a, b) -> list:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def illuminant_dim(spark: SparkSession) -> DataFrame:
    """Nine selectable reference whites."""
    rows = [(name, *xyz) for name, xyz in ILLUMINANTS.items()]
    return spark.createDataFrame(rows, "illuminant string, x double, y double, z double")


def illuminant_case(name: Column) -> list[Column]:
    """X, Y, Z of a reference white named by a column; unknown names are NULL."""
    table = F.create_map(
        *[
            part
            for n, xyz in ILLUMINANTS.items()
            for part in (F.lit(n), F.array(*[F.lit(v) for v in xyz]))
        ],
    )
    return [table[name][i] for i in range(3)]


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(
        F.pow(v, F.lit(1.0 / 2.4)) * 1.055 - 0.055
    )


def brightness(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = BRIGHTNESS_WEIGHTS
    return r * wr + g * wg + b * wb


def bradford_scale(src: Sequence[Column], ref: Sequence[Column]) -> list[Column]:
    """Cone-space gain per axis; a source response near zero keeps gain 1."""
    s, t = mat_vec(BRADFORD, src), mat_vec(BRADFORD, ref)
    return [
        F.when(F.abs(sv) > 1e-10, tv / sv).otherwise(F.lit(1.0))
        for sv, tv in zip(s, t, strict=True)
    ]


def bradford_matrix(src: Sequence[Column], ref: Sequence[Column]) -> list[list[Column]]:
    """Nine expressions of the adaptation matrix in XYZ."""
    gain = bradford_scale(src, ref)
    return [
        [sum(BRADFORD_INVERSE[i][k] * gain[k] * BRADFORD[k][j] for k in range(3)) for j in range(3)]
        for i in range(3)
    ]


def adapt_colour(xyz: Sequence[Column], src: Sequence[Column], ref: Sequence[Column]) -> list:
    """One XYZ colour moved from the source white to the reference white."""
    gain = bradford_scale(src, ref)
    cone = mat_vec(BRADFORD, xyz)
    return mat_vec(BRADFORD_INVERSE, [c * k for c, k in zip(cone, gain, strict=True)])


# Linear RGB to cone space and back, folded once.
_TO_CONE = mat_mul(BRADFORD, SRGB_TO_XYZ)
_FROM_CONE = mat_mul(XYZ_TO_SRGB, BRADFORD_INVERSE)


def rgb_gain_matrix(gain: Sequence[Column]) -> list[list[Column]]:
    """Linear-RGB to linear-RGB matrix of three cone gains; all else is constant."""
    return [
        [
            sum((_FROM_CONE[i][k] * _TO_CONE[k][j]) * gain[k] for k in range(3))
            for j in range(3)
        ]
        for i in range(3)
    ]


def white_balance_rgb(rgb: Sequence[Column], matrix) -> list[Column]:
    """Exact black stays; others are linearised, adapted, re-encoded, clamped."""
    r, g, b = rgb
    black = (r == 0) & (g == 0) & (b == 0)
    linear = [srgb_to_linear(v) for v in rgb]
    out = []
    for row in matrix:
        value = row[0] * linear[0] + row[1] * linear[1] + row[2] * linear[2]
        encoded = linear_to_srgb(F.greatest(value, F.lit(0.0)))
        out.append(F.when(black, F.lit(0.0)).otherwise(clamp(encoded, 0.0, 1.0)))
    return out


def normalise_white(x: Column, y: Column, z: Column) -> list[Column]:
    """Scale to Y = 1; a non-positive Y is left as it is."""
    ok = y > 0
    return [F.when(ok, v / y).otherwise(v) for v in (x, y, z)]


def lighting_type(x: Column, y: Column, z: Column) -> Column:
    def distance(name):
        wx, wy, wz = ILLUMINANTS[name]
        return F.sqrt(F.pow(x - wx, 2) + F.pow(y - wy, 2) + F.pow(z - wz, 2))

    d65 = distance("D65")
    return (
        F.when(d65 < 0.1, F.lit("balanced"))
        .when(distance("A") < d65, F.lit("warm"))
        .otherwise(F.lit("non-standard"))
    )


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue as a fraction of a turn, saturation, value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    hue = (
        F.when(spread == 0, F.lit(0.0))
        .when(top == r, (g - b) / spread)
        .when(top == g, (b - r) / spread + 2.0)
        .otherwise((r - g) / spread + 4.0)
    )
    hue = F.when(hue < 0, hue + 6.0).otherwise(hue) / 6.0
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(spread / top)
    return [hue, saturation, top]


def _lab_f(t: Column) -> Column:
    return F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise((t * LAB_KAPPA + 16.0) / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    white = ILLUMINANTS["D65"]
    xyz = mat_vec(SRGB_TO_XYZ, [srgb_to_linear(v) for v in (r, g, b)])
    fx, fy, fz = (_lab_f(v / w) for v, w in zip(xyz, white, strict=True))
    return [fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0]


def lab_to_lch(light: Column, a: Column, b: Column) -> list[Column]:
    hue = F.degrees(F.atan2(b, a))
    return [light, F.sqrt(a * a + b * b), F.when(hue < 0, hue + 360.0).otherwise(hue)]


def rgb_to_lch(r: Column, g: Column, b: Column) -> list[Column]:
    return lab_to_lch(*rgb_to_lab(r, g, b))
