"""Color spaces of ISO 32000-1, 8.6, as columns between 0 and 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import cmyk_to_rgb, rgb_to_cmyk, rgb_to_gray

# XYZ to linear sRGB, its white (D65), the Bradford cone matrix, and from adapted cones back to XYZ of D65.
XYZ_RGB = ((3.240449, -1.537136, -0.498531), (-0.969265, 1.876011, 0.041556), (0.055643, -0.204026, 1.057229))
D65 = (0.9505, 1.0, 1.0890)
CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
CONES_D65 = ((0.92918329, -0.15299782, 0.17428453), (0.40698452, 0.53931108, 0.05370440), (-0.00802913, 0.04166125, 1.05519788))
# Slope and end of the straight part of the sRGB curve.
SLOPE, STRAIGHT = 12.92321, 0.03928


def unit(x: Column) -> Column:
    """Held between 0 and 1; null stays null."""
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def _times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [sum((F.lit(a) * x for a, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in matrix]


def _gamma(x: Column) -> Column:
    return F.when(x <= STRAIGHT / SLOPE, x * SLOPE).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def xyz_to_rgb(xyz: list[Column], white: tuple[float, float, float] = D65) -> list[Column]:
    """sRGB of a color under a white point, adapted to D65 by cones."""
    if white != D65:
        whites = [sum(a * w for a, w in zip(row, white, strict=True)) for row in CONES]
        xyz = _times(CONES_D65, [c / w for c, w in zip(_times(CONES, xyz), whites, strict=True)])
    return [_gamma(unit(x)) for x in _times(XYZ_RGB, xyz)]


def gray_to_rgb(gray: Column) -> list[Column]:
    return [unit(gray)] * 3


def gray_to_cmyk(gray: Column) -> list[Column]:
    return [F.lit(0.0)] * 3 + [unit(1 - gray)]


def cmyk_to_gray(c: Column, m: Column, y: Column, k: Column) -> Column:
    return unit(1 - k - 0.3 * c - 0.59 * m - 0.11 * y)


def cal_gray_to_rgb(a: Column, gamma: float, white: tuple[float, float, float] = D65) -> list[Column]:
    level = F.pow(a, F.lit(float(gamma)))
    return xyz_to_rgb([F.lit(w) * level for w in white], white)


def cal_rgb_to_rgb(rgb: list[Column], gamma: tuple[float, float, float], matrix: tuple[float, ...], white: tuple[float, float, float] = D65) -> list[Column]:
    """``matrix`` is column by column: the XYZ of red, of green, of blue."""
    levels = [F.pow(x, F.lit(float(g))) for x, g in zip(rgb, gamma, strict=True)]
    return xyz_to_rgb(_times(tuple(tuple(matrix[i + 3 * k] for k in range(3)) for i in range(3)), levels), white)


def lab_to_rgb(l: Column, a: Column, b: Column, white: tuple[float, float, float] = D65) -> list[Column]:  # noqa: E741
    def stretched(t: Column) -> Column:
        return F.when(t >= 6 / 29, t * t * t).otherwise((108 / 841) * (t - 4 / 29))

    m = (l + 16) / 116
    return xyz_to_rgb([stretched(m + a / 500), stretched(m), stretched(m - b / 200)], white)


def tinted(tints: list[Column], transform: Callable[..., list[Column]], alternate: Callable[..., list[Column]]) -> list[Column]:
    """Separation and DeviceN: the tint function's values, as a color of the alternate space."""
    return alternate(*transform(*tints))


def rgb_of(space: str) -> Callable[..., list[Column]]:
    """From a device space to red, green and blue."""
    return {"DeviceGray": gray_to_rgb, "DeviceRGB": lambda *c: [unit(x) for x in c], "DeviceCMYK": cmyk_to_rgb}[space]


def gray_of(space: str) -> Callable[..., Column]:
    return {"DeviceGray": unit, "DeviceRGB": rgb_to_gray, "DeviceCMYK": cmyk_to_gray}[space]


def cmyk_of(space: str) -> Callable[..., list[Column]]:
    return {"DeviceGray": gray_to_cmyk, "DeviceRGB": rgb_to_cmyk, "DeviceCMYK": lambda *c: [unit(x) for x in c]}[space]
