"""Scalar functions and colours as column expressions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the largest opacity that an optical depth is taken of.
MAX_OPACITY = 1 - 1 / 512


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothstep(low: Column | float, high: Column | float, x: Column) -> Column:
    """The Hermite step 3t^2 - 2t^3 between two edges; at equal edges a plain step."""
    low, high = F.lit(low), F.lit(high)
    t = clamp((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0)
    return F.when(low == high, (x >= high).cast("double")).otherwise(t * t * (3 - 2 * t))


def soft_pass(scale: Column, highpass: float | None = None, lowpass: float | None = None, width: float = 1.0) -> Column:
    """Multiplier of an amplitude by its size: a smooth step in log2 around each cut, ``width`` octaves wide."""
    factor: Column = F.lit(1.0)
    for cut, rising in ((highpass, True), (lowpass, False)):
        if cut is not None:
            t = clamp((F.log2(scale) - F.log2(F.lit(float(cut)))) / width + 0.5, 0.0, 1.0)
            step = t * t * (3 - 2 * t)
            factor = factor * (step if rising else 1 - step)
    return factor


def optical_depth(opacity: Column) -> Column:
    """-ln(1 - a), with a clamped below one."""
    return -F.log1p(-F.least(opacity, F.lit(MAX_OPACITY)))


def opacity(depth: Column) -> Column:
    return -F.expm1(-depth)


def brightness_compensation(energy: Column, floor: float = 0.05) -> Column:
    """One over the share of energy that has arrived, the share never below ``floor``."""
    return 1 / F.greatest(energy, F.lit(floor))


def effective_amplitude(amplitude: Column, color: Column) -> Column:
    """Amplitude times alpha where the colour has four channels."""
    return F.when(F.size(color) == 4, amplitude * F.element_at(color, 4)).otherwise(amplitude)


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def hex_to_rgb(text: Column) -> Column:
    """``#RRGGBB`` to an array of three floats in 0..1."""
    return F.array(*[F.conv(F.substring(text, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6)])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """Linear channels to sRGB ``#RRGGBB``, clamped to 0..1."""
    return F.format_string("#%02X%02X%02X", *[F.floor(linear_to_srgb(clamp(c, 0.0, 1.0)) * 255 + 0.5).cast("int") for c in (r, g, b)])


def lut_index(x: Column, low: Column | float, high: Column | float, size: int = 256) -> Column:
    """Nearest entry (from 0, halves to even) of a palette for a value in low..high; 0 for degenerate ranges and non-finite values."""
    low, high = F.lit(low), F.lit(high)
    t = clamp((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0)
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when((high > low) & finite, F.bround(t * (size - 1)).cast("int")).otherwise(0)


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matrix_to_quaternion(m: Sequence[Sequence[Column]]) -> Column:
    """A struct (w, x, y, z) with w >= 0 where the trace is positive; else the largest diagonal element decides."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def named(w: Column, x: Column, y: Column, z: Column) -> Column:
        return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))

    s0 = F.sqrt(F.greatest(trace + 1, F.lit(1e-300))) * 2
    s1 = F.sqrt(F.greatest(1 + m[0][0] - m[1][1] - m[2][2], F.lit(1e-300))) * 2
    s2 = F.sqrt(F.greatest(1 + m[1][1] - m[0][0] - m[2][2], F.lit(1e-300))) * 2
    s3 = F.sqrt(F.greatest(1 + m[2][2] - m[0][0] - m[1][1], F.lit(1e-300))) * 2
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    xy, xz, yz = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    return (
        F.when(trace > 0, named(s0 / 4, a / s0, b / s0, c / s0))
        .when((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), named(a / s1, s1 / 4, xy / s1, xz / s1))
        .when(m[1][1] >= m[2][2], named(b / s2, xy / s2, s2 / 4, yz / s2))
        .otherwise(named(c / s3, xz / s3, yz / s3, s3 / 4))
    )


#: Fixed: accepted spellings of units.
UNITS = {
    "meter": "m", "metre": "m", "meters": "m", "metres": "m",
    "centimeter": "cm", "centimetre": "cm", "centimeters": "cm", "centimetres": "cm",
    "kilometer": "km", "kilometre": "km", "kilometers": "km", "kilometres": "km",
    "millimeter": "mm", "millimetre": "mm", "millimeters": "mm", "millimetres": "mm",
    "micrometer": "um", "micrometre": "um", "micrometers": "um", "micrometres": "um", "micron": "um", "microns": "um", "µm": "um", "μm": "um",
    "nanometer": "nm", "nanometre": "nm", "nanometers": "nm", "nanometres": "nm",
    "pixel": "px", "pixels": "px",
    "second": "s", "seconds": "s", "sec": "s", "millisecond": "ms", "milliseconds": "ms",
    "minute": "min", "minutes": "min", "hour": "h", "hours": "h",
}


def canonical_unit(unit: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(unit))), F.trim(unit))


def bandwidth_mbps(text: Column) -> Column:
    """Megabits a second of strings such as ``10 Mbps`` or ``1.5 Gbit/s``; null for others."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmg])b(?:ps|it/s)?\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmg])b(?:ps|it/s)?\s*$", 2))
    factor = F.when(unit == "k", 0.001).when(unit == "m", 1.0).when(unit == "g", 1000.0)
    return F.when(number != "", number.try_cast("double") * factor)


def palette_color(index: Column, palette: Sequence[str]) -> Column:
    """Colour of a category, the palette repeated."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(index, F.lit(len(palette))) + 1).cast("int"))
