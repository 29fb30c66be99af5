"""Blend modes of ISO 32000-1, 11.3.5, on columns between 0 and 1; s is the backdrop, t the source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def color_dodge(s: Column, t: Column) -> Column:
    return F.when(t >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), s / F.nullif(1 - t, F.lit(0.0))))


def color_burn(s: Column, t: Column) -> Column:
    return F.when(t <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), (1 - s) / F.nullif(t, F.lit(0.0))))


def soft_light(s: Column, t: Column) -> Column:
    d = F.when(s <= 0.25, ((16 * s - 12) * s + 4) * s).otherwise(F.sqrt(s))
    return F.when(t < 0.5, s - (1 - 2 * t) * s * (1 - s)).otherwise(s + (2 * t - 1) * (d - s))


def _bound(f: Callable[[Column], Column], **parts: Column) -> Column:
    """``f`` of a struct of the parts, each evaluated once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in parts.items()))), f)[0]


def luminosity_of(c: Column) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def saturation_of(c: Column) -> Column:
    return F.array_max(c) - F.array_min(c)


def with_luminosity(c: Column, lum: Column) -> Column:
    """The color moved to a luminosity, and drawn towards gray where it would leave 0 to 1."""

    def drawn(v: Column) -> Column:
        lum, low, high = v["lum"], F.array_min(v["moved"]), F.array_max(v["moved"])

        def one(x: Column) -> Column:
            x = F.when(low < 0, lum + (x - lum) * lum / F.nullif(lum - low, F.lit(0.0))).otherwise(x)
            return F.when(high > 1, lum + (x - lum) * (1 - lum) / F.nullif(high - lum, F.lit(0.0))).otherwise(x)

        return F.transform(v["moved"], one)

    return _bound(lambda v: _bound(drawn, lum=v["lum"], moved=F.transform(v["c"], lambda x: x + v["lum"] - luminosity_of(v["c"]))), c=c, lum=lum)


def with_saturation(c: Column, sat: Column) -> Column:
    """The color stretched to a saturation; gray stays without one."""
    return F.transform(c, lambda x: F.coalesce((x - F.array_min(c)) * sat / F.nullif(saturation_of(c), F.lit(0.0)), F.lit(0.0)))


# Of colors as arrays of red, green and blue.
def hue(s: Column, t: Column) -> Column:
    return with_luminosity(with_saturation(t, saturation_of(s)), luminosity_of(s))


def saturation(s: Column, t: Column) -> Column:
    return with_luminosity(with_saturation(s, saturation_of(t)), luminosity_of(s))


def color(s: Column, t: Column) -> Column:
    return with_luminosity(t, luminosity_of(s))


def luminosity(s: Column, t: Column) -> Column:
    return with_luminosity(s, luminosity_of(t))
