"""Pixel expressions: pure Columns, so that whole-stage code generation fuses them into one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
#: Published colour matrices (D65) and luma weights.
SRGB_TO_XYZ = (0.4124564, 0.3575761, 0.1804375, 0.2126729, 0.7151522, 0.0721750, 0.0193339, 0.1191920, 0.9503041)
XYZ_TO_SRGB = (3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252)
REC709_TO_REC2020 = (0.6274, 0.3293, 0.0433, 0.0691, 0.9195, 0.0114, 0.0164, 0.0880, 0.8956)
REC2020_TO_REC709 = (1.66022677, -0.58754761, -0.07283825, -0.12455334, 1.13292605, -0.00834963, -0.01815514, -0.10060303, 1.11899817)
REC2020_TO_XYZ = (0.636958048301291, 0.144616903586208, 0.168880975164172, 0.262700212011267, 0.677998071518871, 0.059301716469862, 0.0, 0.028072693049087, 1.060985057710791)
XYZ_TO_REC2020 = (1.71665119, -0.35567078, -0.25336628, -0.66668435, 1.61648124, 0.01576855, 0.01763986, -0.04277061, 0.94210312)
LUMA = (0.2126, 0.7152, 0.0722)
WHITE = (0.95047, 1.0, 1.08883)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def mix(matrix, px: Triple) -> Triple:
    """A row-major 3 x 3 matrix times a pixel."""
    return tuple(matrix[3 * k] * px[0] + matrix[3 * k + 1] * px[1] + matrix[3 * k + 2] * px[2] for k in range(3))


def dot(weights, px: Triple) -> Column:
    return weights[0] * px[0] + weights[1] * px[1] + weights[2] * px[2]


def normalise(s: Column, black: Column, white: Column) -> Column:
    """Sample to 0..65535 between the levels; the divisor is 1 at least."""
    return F.round(clamp((s - black) / F.greatest(white - black, F.lit(1.0)), 0.0, 1.0) * 65535)


def develop(px: Triple, black: float, scale: float, matrix, gain: Triple | None = None) -> Triple:
    """Scale, optional gain, camera matrix, and desaturation of what nears clipping."""
    n = tuple((c - black) * scale for c in px)
    top = F.greatest(*n)
    v = tuple(F.greatest(c * g if gain else c, F.lit(0.0)) for c, g in zip(n, gain or n))
    rgb = mix(matrix, v)
    t, peak = clamp((top - 0.88) / 0.12, 0.0, 1.0), F.greatest(*rgb)
    return tuple(c + t * (peak - c) for c in rgb)


def srgb_encode(v: Column) -> Column:
    """Linear light to 8 bits."""
    c = clamp(v, 0.0, 1.0)
    return F.round(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055) * 255)


def hdr_extend(px: Triple, stops: float) -> Triple:
    """Highlights get up to 2^stops, by a smooth step over the root of luma; no change for stops <= 0."""
    if stops <= 0:
        return px
    u = clamp((F.sqrt(clamp(dot(LUMA, px), 0.0, 1.0)) - 0.5) / 0.5, 0.0, 1.0)
    gain = F.pow(F.lit(2.0), stops * u * u * (3 - 2 * u))
    return tuple(c * gain for c in px)


def sdr_clamp(px: Triple) -> Triple:
    return tuple(clamp(c, -0.6, 1.0) for c in px)


def lab(px: Triple) -> Triple:
    """Linear sRGB to CIE L*a*b*."""
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in (c / w for c, w in zip(mix(SRGB_TO_XYZ, px), WHITE))]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def piecewise(v: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, held at both ends."""
    out = F.when(v <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(v <= x1, y0 + (v - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


#: The five points of the film toe.
TOE = [(0.0, 0.0), (0.13, 0.016), (0.33, 0.25), (0.66, 0.73), (1.0, 0.99)]


def sanitise(v: Column) -> Column:
    """NaN to 0, infinities and the rest into +-16384."""
    return F.when(F.isnan(v), F.lit(0.0)).otherwise(clamp(v, -16384.0, 16384.0))


def garrote(d: Column, t: Column) -> Column:
    return d * F.greatest(1 - t * t / F.greatest(d * d, F.lit(1e-20)), F.lit(0.0))


def noise_sigma(x: Column, a: float, b: float) -> Column:
    return F.sqrt(F.greatest(a + b * F.greatest(x, F.lit(0.0)), F.lit(1e-12)))


def contrast(x: Column) -> Column:
    """A sigmoid around one half."""
    return 0.5 + 0.5 * x * F.pow(1 + F.pow(F.abs(x), F.lit(4.5)), F.lit(-2 / 9))


def contrast_slope(x: Column) -> Column:
    """Derivative of :func:`contrast`."""
    return 0.5 * F.pow(1 + F.pow(F.abs(x), F.lit(4.5)), F.lit(-11 / 9))


def inverse3(m: list[Column]) -> list[Column]:
    """Inverse of a row-major 3 x 3 matrix; a zero determinant counts as 1."""
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    det = F.when(det == 0, F.lit(1.0)).otherwise(det)
    minor = lambda a, b, c, d: (m[a] * m[b] - m[c] * m[d]) / det
    return [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]


def delta_e2000(pairs: DataFrame) -> DataFrame:
    """Adds ``de``, the CIEDE2000 difference of the columns l1 a1 b1 and l2 a2 b2. Steps are columns of their own:
    as one expression the shared terms would be written out again and again."""
    c, rad = F.col, F.radians
    seven = lambda v: F.sqrt(F.pow(v, F.lit(7.0)) / (F.pow(v, F.lit(7.0)) + 25.0**7))
    hue = lambda p, b: F.when((c(p) == 0) & (c(b) == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, p)) + 360, F.lit(360.0)))
    gap, both = c("_h2") - c("_h1"), c("_h1") + c("_h2")
    steps = [
        {"_g": 0.5 * (1 - seven((F.sqrt(c("a1") * c("a1") + c("b1") * c("b1")) + F.sqrt(c("a2") * c("a2") + c("b2") * c("b2"))) / 2))},
        {f"_p{k}": c(f"a{k}") * (1 + c("_g")) for k in (1, 2)},
        {f"_c{k}": F.sqrt(c(f"_p{k}") * c(f"_p{k}") + c(f"b{k}") * c(f"b{k}")) for k in (1, 2)} | {f"_h{k}": hue(f"_p{k}", f"b{k}") for k in (1, 2)},
        {
            "_none": c("_c1") * c("_c2") == 0,
            "_l": (c("l1") + c("l2")) / 2,
            "_c": (c("_c1") + c("_c2")) / 2,
            "_dh": F.when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360),
            "_hm": F.when(F.abs(gap) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2),
        },
        {"_h": F.when(c("_none"), both).otherwise(c("_hm")), "_bh": F.when(c("_none"), 0.0).otherwise(2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(rad("_dh") / 2)), "_q": (c("_l") - 50) * (c("_l") - 50)},
        {
            "_t": 1 - 0.17 * F.cos(rad(c("_h") - 30)) + 0.24 * F.cos(rad(2 * c("_h"))) + 0.32 * F.cos(rad(3 * c("_h") + 6)) - 0.20 * F.cos(rad(4 * c("_h") - 63)),
            "_turn": 60 * F.exp(-F.pow((c("_h") - 275) / 25, F.lit(2.0))),
        },
        {
            "_u": (c("l2") - c("l1")) / (1 + 0.015 * c("_q") / F.sqrt(20 + c("_q"))),
            "_v": (c("_c2") - c("_c1")) / (1 + 0.045 * c("_c")),
            "_w": c("_bh") / (1 + 0.015 * c("_c") * c("_t")),
            "_rt": -2 * seven(c("_c")) * F.sin(rad("_turn")),
        },
        {"de": F.sqrt(F.greatest(c("_u") * c("_u") + c("_v") * c("_v") + c("_w") * c("_w") + c("_rt") * c("_v") * c("_w"), F.lit(0.0)))},
    ]
    out = pairs
    for step in steps:
        out = out.withColumns(step)
    return out.drop(*{k for s in steps for k in s if k != "de"})
