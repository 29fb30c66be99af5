"""Scalar functions on pages, labels, dates, colors and matrices, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The roman numerals of units, tens and hundreds.
UNITS = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]


def _pick(table: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), (at + 1).cast("int"))


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; empty beyond."""
    digits = F.concat(F.repeat(F.lit("m"), (n / 1000).cast("int")), _pick(HUNDREDS, F.floor(n / 100) % 10), _pick(TENS, F.floor(n / 10) % 10), _pick(UNITS, n % 10))
    return F.when((n > 0) & (n < 4000), digits).otherwise("")


def from_roman(s: Column) -> Column:
    """Number of a roman numeral of either case, read leniently; -1 for other letters."""
    low = F.lower(s)
    value = lambda c: F.element_at(F.create_map(*(F.lit(x) for p in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in p)), c)
    letters = F.split(low, "")
    seen = F.aggregate(F.reverse(letters), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, c: F.struct((a["sum"] + F.when(value(c) < a["last"], -value(c)).otherwise(value(c))).alias("sum"), value(c).alias("last")), lambda a: a["sum"])
    return F.when(low.rlike("^[ivxlcdm]+$"), seen).otherwise(-1)


def to_latin(n: Column) -> Column:
    """a to z, aa to zz, and so on: one letter, repeated."""
    return F.when(n > 0, F.repeat(F.char((F.lit(97) + (n - 1) % 26).cast("long")), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")


def from_latin(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.rlike(r"^([a-z])\1*$"), F.ascii(low) - 96 + 26 * (F.length(low) - 1)).otherwise(-1)


def format_date(t: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(t, "yyyyMMddHHmmss"), F.lit("+00'00'"))


def parse_date(s: Column) -> Column:
    """The instant of a date string, of which only the year is needed; null if it is none."""
    got = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(s, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Z+\-])(\d{2})?'?(\d{2})?'?)?.*$", i), F.lit("")), F.lit(default))
    local = F.try_to_timestamp(F.concat_ws("-", *(got(i + 1, d) for i, d in enumerate(("", "01", "01", "00", "00", "00")))), F.lit("yyyy-MM-dd-HH-mm-ss"))
    away = (got(8, "0").cast("int") * 3600 + got(9, "0").cast("int") * 60) * F.when(got(7, "Z") == "-", -1).otherwise(1)
    return F.when(s.rlike(r"^(D:)?\d{4}"), F.timestamp_seconds(F.unix_micros(local) / 1000000 - away))


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * r + 0.59 * g + 0.11 * b))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> list[Column]:
    c, m, y = 1 - r, 1 - g, 1 - b
    k = F.least(c, m, y)
    return [c - k, m - k, y - k, k]


def transform(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverse(m: list[Column]) -> list[Column]:
    """The inverse of an affine matrix; nulls where it has none."""
    det = F.nullif(m[0] * m[3] - m[1] * m[2], F.lit(0.0))
    return [m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det]


def translated(m: list[Column], x: Column, y: Column) -> list[Column]:
    """The matrix after a shift: points are shifted first."""
    e, f = transform(m, x, y)
    return [*m[:4], e, f]


def scaled(m: list[Column], x: Column, y: Column) -> list[Column]:
    """The matrix after a scaling: points are scaled first."""
    return [m[0] * x, m[1] * x, m[2] * y, m[3] * y, *m[4:]]


def norm(m: list[Column]) -> Column:
    """The greatest length that a point of the unit circle gets."""
    i, j, h = m[0] * m[0] + m[1] * m[1], m[2] * m[2] + m[3] * m[3], m[0] * m[2] + m[1] * m[3]
    return F.sqrt(0.5 * (i + j) + F.hypot(0.5 * (i - j), h))


def page_matrix(box: list[Column], rotate: Column, dpi: float, upside_down: bool = True) -> list[Column]:
    """From a page's box to pixels at a resolution, turned by a multiple of 90 degrees; rows run down if ``upside_down``."""
    k, zero = dpi / 72, F.lit(0.0)
    x0, y0, x1, y1 = (v * k for v in box)
    one = F.lit(float(k))
    if upside_down:
        turned = {0: (one, zero, zero, -one, -x0, y1), 90: (zero, one, one, zero, -y0, -x0), 180: (-one, zero, zero, one, x1, -y0), 270: (zero, -one, -one, zero, y1, x1)}
    else:
        turned = {0: (one, zero, zero, one, -x0, -y0), 90: (zero, -one, one, zero, -y0, x1), 180: (-one, zero, zero, -one, x1, y1), 270: (zero, one, -one, zero, y1, -x0)}
    at = F.pmod(rotate.cast("int"), F.lit(360))
    return [F.when(at == 90, turned[90][i]).when(at == 180, turned[180][i]).when(at == 270, turned[270][i]).otherwise(turned[0][i]) for i in range(6)]


def contains(box: list[Column], x: Column, y: Column) -> Column:
    """Closed on all sides, for corners in any order."""
    return x.between(F.least(box[0], box[2]), F.greatest(box[0], box[2])) & y.between(F.least(box[1], box[3]), F.greatest(box[1], box[3]))


# Red, green and blue of each corner of the CMYK cube (cyan, magenta, yellow, black).
CMYK_CORNERS = {
    (0, 0, 0, 0): (1.0, 1.0, 1.0),
    (0, 0, 0, 1): (0.1373, 0.1216, 0.1255),
    (0, 0, 1, 0): (1.0, 0.9490, 0.0),
    (0, 0, 1, 1): (0.1098, 0.1020, 0.0),
    (0, 1, 0, 0): (0.9255, 0.0, 0.5490),
    (0, 1, 0, 1): (0.1412, 0.0, 0.0),
    (0, 1, 1, 0): (0.9294, 0.1098, 0.1412),
    (0, 1, 1, 1): (0.1333, 0.0, 0.0),
    (1, 0, 0, 0): (0.0, 0.6784, 0.9373),
    (1, 0, 0, 1): (0.0, 0.0588, 0.1412),
    (1, 0, 1, 0): (0.0, 0.6510, 0.3137),
    (1, 0, 1, 1): (0.0, 0.0745, 0.0),
    (1, 1, 0, 0): (0.1804, 0.1922, 0.5725),
    (1, 1, 0, 1): (0.0, 0.0, 0.0078),
    (1, 1, 1, 0): (0.2118, 0.2119, 0.2235),
}


def cmyk_to_rgb(*cmyk: Column) -> list[Column]:
    """Interpolated between the corners of the cube, and held between 0 and 1."""
    out = [F.lit(0.0)] * 3
    for corner, color in CMYK_CORNERS.items():
        weight = F.lit(1.0)
        for part, at in zip(cmyk, corner, strict=True):
            weight = weight * (part if at else 1 - part)
        out = [x + weight * v if v else x for x, v in zip(out, color, strict=True)]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in out]


def indexed(at: Column, table: list[tuple[float, ...]]) -> list[Column]:
    """Components of an indexed color; an index beyond the table is its nearest end."""
    held = F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), at.cast("int")))
    return [F.element_at(F.array(*(F.lit(float(row[k])) for row in table)), held + 1) for k in range(len(table[0]))]


def clip(box: list[Column], to: list[Column]) -> list[Column]:
    """``box`` held within ``to``; both (left, bottom, right, top)."""
    within = lambda v, k: F.greatest(to[k], F.least(to[k + 2], v))
    return [within(box[0], 0), within(box[1], 1), within(box[2], 0), within(box[3], 1)]


# The bit of each permission (ISO 32000-1, table 22).
PERMISSIONS = {"print": 3, "change": 4, "copy": 5, "annotate": 6, "fill": 9, "access": 10, "assemble": 11, "print_high": 12}


def permissions(p: Column) -> dict[str, Column]:
    return {k: F.getbit(p, F.lit(bit - 1)) == 1 for k, bit in PERMISSIONS.items()}


def layer_visible(policy: Column, states: Column) -> Column:
    """Whether content that belongs to layers in these states is shown; without layers it is."""
    on, off = (lambda s: s), (lambda s: ~s)
    shown = F.when(policy == "AllOn", F.forall(states, on)).when(policy == "AnyOff", F.exists(states, off)).when(policy == "AllOff", F.forall(states, off)).otherwise(F.exists(states, on))
    return F.when(F.size(states) == 0, True).otherwise(shown)
