"""Queries of values: color spaces, texts and their encodings, geometry, and every calculator operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import blending
from paperloom.functions import calculators as C
from paperloom.functions import colors as K
from paperloom.functions import scalars as S
from paperloom.functions import texts as T

from .queries import _RGB, _rgb
from .registry import ORACLES, QUERIES, query, table

_KEYS = ("l_orderkey", "l_linenumber")


def _values(name: str, found: Callable[[Column, Column, Column], dict[str, Column]], sql: str, digits: int = 6) -> None:
    """A query of columns of r, g and b, and its SQL: a list of expressions, or a whole statement on ``c``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rgb(spark, sf_dir).select(*_KEYS, *((F.round(c, digits) + F.lit(0.0)).alias(k) for k, c in found(*map(F.col, "rgb")).items()))

    QUERIES[name] = run
    ORACLES[name] = _RGB + (sql if sql.startswith(",") else f"SELECT l_orderkey, l_linenumber, {sql} FROM c")


_NAMES = ("red", "green", "blue")


def _colors(values: list[Column]) -> dict[str, Column]:
    return dict(zip(_NAMES, values, strict=True))


# From X, Y, Z to sRGB, as steps on a relation ``x`` of x, y, z.
_UNIT = "greatest(0.0, least(1.0, {}))"


def _srgb(white: tuple[float, float, float] | None) -> str:
    out = ""
    if white:
        w = [sum(a * v for a, v in zip(row, white, strict=True)) for row in K.CONES]
        cones = ", ".join(f"({row[0]!r} * x + {row[1]!r} * y + {row[2]!r} * z) / {v!r} AS {n}" for n, row, v in zip(("p", "q", "s"), K.CONES, w, strict=True))
        back = ", ".join(f"{row[0]!r} * p + {row[1]!r} * q + {row[2]!r} * s AS {n}" for n, row in zip("xyz", K.CONES_D65, strict=True))
        out = f", w AS (SELECT l_orderkey, l_linenumber, {cones} FROM x), x2 AS (SELECT l_orderkey, l_linenumber, {back} FROM w)"
    linear = ", ".join(f"{_UNIT.format(f'{row[0]!r}::DOUBLE * x + {row[1]!r}::DOUBLE * y + {row[2]!r}::DOUBLE * z')} AS {n}" for n, row in zip(_NAMES, K.XYZ_RGB, strict=True))
    curved = ", ".join(f"round(CASE WHEN {n} <= 0.03928 / 12.92321 THEN {n} * 12.92321 ELSE 1.055 * pow({n}, 1 / 2.4) - 0.055 END, 5) AS {n}" for n in _NAMES)
    return out + f", l AS (SELECT l_orderkey, l_linenumber, {linear} FROM {'x2' if white else 'x'}) SELECT l_orderkey, l_linenumber, {curved} FROM l"


D50 = (0.9642, 1.0, 0.8249)
_values("gray_to_rgb", lambda R, G, B: _colors(K.gray_to_rgb(G)), "round(g, 6) AS red, round(g, 6) AS green, round(g, 6) AS blue")
_values("gray_to_cmyk", lambda R, G, B: dict(zip(("cyan", "magenta", "yellow", "black"), K.gray_to_cmyk(B), strict=True)), "0.0::DOUBLE AS cyan, 0.0::DOUBLE AS magenta, 0.0::DOUBLE AS yellow, round(1 - b, 6) AS black")
_values("cmyk_to_gray", lambda R, G, B: {"gray": K.cmyk_to_gray(R, G, B, R * B)}, "round(greatest(0.0, least(1.0, 1 - r * b - 0.3 * r - 0.59 * g - 0.11 * b)), 6) AS gray")
_values("cal_gray", lambda R, G, B: _colors(K.cal_gray_to_rgb(B, 2.2, D50)), f", x AS (SELECT l_orderkey, l_linenumber, {D50[0]} * pow(b, 2.2) AS x, pow(b, 2.2) AS y, {D50[2]} * pow(b, 2.2) AS z FROM c)" + _srgb(D50), 5)
_CAL = (0.4361, 0.2225, 0.0139, 0.3851, 0.7169, 0.0971, 0.1431, 0.0606, 0.7141)
_values("cal_rgb", lambda R, G, B: _colors(K.cal_rgb_to_rgb([R, G, B], (1.8, 2.0, 2.2), _CAL, D50)), ", p AS (SELECT l_orderkey, l_linenumber, pow(r, 1.8) AS r, pow(g, 2.0) AS g, pow(b, 2.2) AS b FROM c), x AS (SELECT l_orderkey, l_linenumber, 0.4361 * r + 0.3851 * g + 0.1431 * b AS x, 0.2225 * r + 0.7169 * g + 0.0606 * b AS y, 0.0139 * r + 0.0971 * g + 0.7141 * b AS z FROM p)" + _srgb(D50), 5)
_values("lab_to_rgb", lambda R, G, B: _colors(K.lab_to_rgb(B * 100, R * 100 - 50, G * 100 - 40)), ", t AS (SELECT l_orderkey, l_linenumber, (b * 100 + 16) / 116 AS m, (b * 100 + 16) / 116 + (r * 100 - 50) / 500 AS u, (b * 100 + 16) / 116 - (g * 100 - 40) / 200 AS v FROM c), x AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN {t} >= 6.0 / 29 THEN {t} * {t} * {t} ELSE 108.0 / 841 * ({t} - 4.0 / 29) END AS {n}" for t, n in (("u", "x"), ("m", "y"), ("v", "z"))) + " FROM t)" + _srgb(None), 5)
_values("separation", lambda R, G, B: _colors(K.tinted([B], lambda t: C.exponential(t, [0, 0, 0, 0], [0.25, 0.75, 0.5, 0.125], 1), lambda *c: [K.unit(1 - F.least(F.lit(1.0), x + c[3])) for x in c[:3]])), "round(1 - least(1, 0.375 * b), 6) AS red, round(1 - least(1, 0.875 * b), 6) AS green, round(1 - least(1, 0.625 * b), 6) AS blue")
_values("device_n", lambda R, G, B: _colors(K.tinted([R, G], lambda a, b: C.postscript("{ 2 copy mul 3 1 roll }", [a, b], [(0, 1)] * 3), K.rgb_of("DeviceRGB"))), "round(r * g, 6) AS red, round(r, 6) AS green, round(g, 6) AS blue")

# Functions: two inputs on a grid with Encode and two outputs; a domain and a range that cut.
_GRID = [[0.0, 1.0], [0.5, 0.25], [1.0, 0.0], [0.75, 0.5], [0.25, 0.125], [0.0, 1.0]]  # three by two
_SQL_GRID = ", ".join(f"[{', '.join(str(p[k]) for p in _GRID)}] :: DOUBLE[] AS t{k}" for k in (0, 1))
_values(
    "fn_sampled_two_inputs",
    lambda R, G, B: dict(zip(("y0", "y1"), C.sampled_many([R, G], [3, 2], _GRID, [(0, 1), (0, 0.8)], [(0, 2), (1, 0)], [(0, 1), (-1, 1)], [(0, 1), (-0.5, 1)]), strict=True)),
    f", a AS (SELECT l_orderkey, l_linenumber, r * 2 AS u, 1 - g / 0.8 AS v, {_SQL_GRID} FROM c), f AS (SELECT *, least(floor(u), 1)::INTEGER AS i FROM a), y AS (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"(1 - v) * ((1 - (u - i)) * t{k}[i + 1] + (u - i) * t{k}[i + 2]) + v * ((1 - (u - i)) * t{k}[i + 4] + (u - i) * t{k}[i + 5]) AS y{k}" for k in (0, 1))
    + " FROM f) SELECT l_orderkey, l_linenumber, round(y0, 6) AS y0, round(greatest(-0.5, y1 * 2 - 1), 6) AS y1 FROM y",
)
_values("fn_exponential_clamped", lambda R, G, B: {"y": C.exponential(R * 2, [0.0], [4.0], 2, (0, 1), [(0, 3)])[0]}, "round(least(3.0, 4 * pow(least(1.0, r * 2), 2)), 6) AS y")
_values("fn_identity", lambda R, G, B: {"y": C.identity(B)[0]}, "round(b, 6) AS y")

# A program for each calculator operator, on r, g and b, and the SQL of its value.
_EACH = {
    "abs": ("{ sub abs exch pop }", "abs(g - b)"),
    "add": ("{ add add }", "r + g + b"),
    "and": ("{ 0.5 lt exch 0.3 gt and { pop 1 } { } ifelse }", "CASE WHEN b < 0.5 AND g > 0.3 THEN 1 ELSE r END"),
    "atan": ("{ exch 0.25 add exch 0.5 add atan 90 div exch pop }", "degrees(atan2(g + 0.25, b + 0.5)) / 90"),
    "bitshift": ("{ 50 mul cvi 3 bitshift 100 div exch pop exch pop }", "(trunc(b * 50)::BIGINT << 3) / 100.0"),
    "ceiling": ("{ 7 mul ceiling 10 div exch pop exch pop }", "ceil(b * 7) / 10"),
    "copy": ("{ 2 copy add sub add add }", "r + g + (b - (g + b))"),
    "cos": ("{ 180 mul cos exch pop exch pop }", "cos(radians(b * 180))"),
    "cvi": ("{ 9 mul cvi 10 div exch pop exch pop }", "trunc(b * 9) / 10"),
    "cvr": ("{ 9 mul cvi cvr 2 div exch pop exch pop }", "trunc(b * 9) / 2"),
    "div": ("{ 1 add div exch pop }", "g / (b + 1)"),
    "dup": ("{ dup mul exch pop exch pop }", "b * b"),
    "eq": ("{ pop eq { 1 } { 0 } ifelse }", "CASE WHEN r = g THEN 1 ELSE 0 END"),
    "exch": ("{ exch sub exch pop }", "b - g"),
    "exp": ("{ exch 1 add exch exp exch pop }", "pow(g + 1, b)"),
    "false": ("{ 0.5 lt false or { 1 } { 2 } ifelse exch pop exch pop }", "CASE WHEN b < 0.5 THEN 1 ELSE 2 END"),
    "floor": ("{ 7 mul floor 10 div exch pop exch pop }", "floor(b * 7) / 10"),
    "ge": ("{ ge { 1 } { 0 } ifelse exch pop }", "CASE WHEN g >= b THEN 1 ELSE 0 END"),
    "gt": ("{ gt { 1 } { 0 } ifelse exch pop }", "CASE WHEN g > b THEN 1 ELSE 0 END"),
    "idiv": ("{ 50 mul cvi 7 idiv exch pop exch pop 4 div 7 3 0 idiv pop }", "(trunc(b * 50)::BIGINT // 7) / 4.0"),
    "index": ("{ 1 1 add index exch pop exch pop exch pop }", "r"),
    "le": ("{ le { 1 } { 0 } ifelse exch pop }", "CASE WHEN g <= b THEN 1 ELSE 0 END"),
    "ln": ("{ 0.5 add ln exch pop exch pop }", "ln(b + 0.5)"),
    "log": ("{ 0.5 add log exch pop exch pop }", "log10(b + 0.5)"),
    "lt": ("{ lt { 1 } { 0 } ifelse exch pop }", "CASE WHEN g < b THEN 1 ELSE 0 END"),
    "mod": ("{ 50 mul cvi 7 mod 4 div exch pop exch pop }", "(trunc(b * 50)::BIGINT % 7) / 4.0"),
    "mul": ("{ mul mul }", "r * g * b"),
    "ne": ("{ pop ne { 1 } { 0 } ifelse }", "CASE WHEN r <> g THEN 1 ELSE 0 END"),
    "neg": ("{ neg exch pop exch pop }", "-b"),
    "not": ("{ 0.5 lt not { 1 } { 2 } ifelse exch pop exch pop }", "CASE WHEN b < 0.5 THEN 2 ELSE 1 END"),
    "or": ("{ 0.5 lt exch 0.3 gt or { pop 1 } { } ifelse }", "CASE WHEN b < 0.5 OR g > 0.3 THEN 1 ELSE r END"),
    "pop": ("{ pop pop }", "r"),
    "roll": ("{ 3 2 1 sub roll sub sub }", "b - (r - g)"),
    "round": ("{ 7 mul 0.25 add round 10 div exch pop exch pop }", "floor(b * 7 + 0.25 + 0.5) / 10"),
    "sin": ("{ 180 mul sin exch pop exch pop }", "sin(radians(b * 180))"),
    "sqrt": ("{ sqrt exch pop exch pop }", "sqrt(b)"),
    "sub": ("{ sub sub }", "r - (g - b)"),
    "true": ("{ 0.5 lt true and { 1 } { 2 } ifelse exch pop exch pop }", "CASE WHEN b < 0.5 THEN 1 ELSE 2 END"),
    "truncate": ("{ 7 mul neg truncate 2 div exch pop exch pop }", "trunc(-b * 7) / 2"),
    "xor": ("{ 0.5 lt exch 0.3 gt xor { pop 1 } { } ifelse }", "CASE WHEN (b < 0.5) <> (g > 0.3) THEN 1 ELSE r END"),
    "if": ("{ 0.5 lt { add } if add 2 div exch pop }", None),
    "ifelse": ("{ 0.5 lt { add } { sub } ifelse }", "CASE WHEN b < 0.5 THEN r + g ELSE r - g END"),
}
for _name, (_code, _sql) in _EACH.items():
    if _sql:
        _values(f"ps_{_name}", lambda R, G, B, code=_code: {"y": C.postscript(code, [R, G, B], [(-4, 4)])[0]}, f"round(greatest(-4.0, least(4.0, ({_sql})::DOUBLE)), 6) AS y")
_values("ps_if", lambda R, G, B: {"y": C.postscript("{ 0.5 lt { 2 mul } if add }", [R, G, B], [(-4, 4)])[0]}, "round(r + CASE WHEN b < 0.5 THEN g * 2 ELSE g END, 6) AS y")


# Blend modes of whole colors: backdrop (r, g, b), source (b, r, g), in steps.
def _whole(name: str, start: str, lum: str) -> None:
    steps = f", k AS (SELECT *, b AS tr, r AS tg, g AS tb FROM c), a AS (SELECT l_orderkey, l_linenumber, {lum} AS lum, {start} FROM k), m AS (SELECT l_orderkey, l_linenumber, lum, " + ", ".join(f"{x} + lum - (0.3 * x0 + 0.59 * x1 + 0.11 * x2) AS {x}" for x in ("x0", "x1", "x2"))
    steps += " FROM a), n AS (SELECT *, least(x0, x1, x2) AS low, greatest(x0, x1, x2) AS high FROM m), o AS (SELECT l_orderkey, l_linenumber, lum, high, " + ", ".join(f"CASE WHEN low < 0 THEN lum + ({x} - lum) * lum / (lum - low) ELSE {x} END AS {x}" for x in ("x0", "x1", "x2"))
    steps += " FROM n) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN high > 1 THEN lum + ({x} - lum) * (1 - lum) / (high - lum) ELSE {x} END, 6) AS {n}" for x, n in zip(("x0", "x1", "x2"), _NAMES, strict=True)) + " FROM o"
    ORACLES[f"blend_{name}"] = _RGB + steps


_LUM_S, _LUM_T = "0.3 * r + 0.59 * g + 0.11 * b", "0.3 * tr + 0.59 * tg + 0.11 * tb"


def _stretched(of: str, sat: str) -> str:
    low, high = f"least({of})", f"greatest({of})"
    return ", ".join(f"CASE WHEN {high} > {low} THEN ({x.strip()} - {low}) * {sat} / ({high} - {low}) ELSE 0 END AS x{i}" for i, x in enumerate(of.split(",")))


_whole("hue", _stretched("tr, tg, tb", "(greatest(r, g, b) - least(r, g, b))"), _LUM_S)
_whole("saturation", _stretched("r, g, b", "(greatest(tr, tg, tb) - least(tr, tg, tb))"), _LUM_S)
_whole("color", "tr AS x0, tg AS x1, tb AS x2", _LUM_S)
_whole("luminosity", "r AS x0, g AS x1, b AS x2", _LUM_T)
assert all(hasattr(blending, n) for n in ("hue", "saturation", "color", "luminosity"))

# Geometry.
_values("matrix_norm", lambda R, G, B: {"norm": S.norm([1 + R, G, -B, 2 + G])}, "round(sqrt(0.5 * ((1 + r) * (1 + r) + g * g + b * b + (2 + g) * (2 + g)) + sqrt(pow(0.5 * ((1 + r) * (1 + r) + g * g - b * b - (2 + g) * (2 + g)), 2) + pow(-(1 + r) * b + g * (2 + g), 2))), 6) AS norm")


def _matrix(r: Column, g: Column, b: Column) -> list[Column]:
    return [1 + r, g, -b, 2 + g, F.lit(3.0), F.lit(5.0)]


_values("matrix_translate", lambda R, G, B: dict(zip("ef", S.translated(_matrix(R, G, B), R * 10, B * 10)[4:], strict=True)), "round(r * 10 * (1 + r) - b * 10 * b + 3, 6) AS e, round(r * 10 * g + b * 10 * (2 + g) + 5, 6) AS f")
_values("matrix_scale", lambda R, G, B: dict(zip("abcd", S.scaled(_matrix(R, G, B), R * 10, B * 10)[:4], strict=True)), "round(r * 10 * (1 + r), 6) AS a, round(r * 10 * g, 6) AS b, round(b * 10 * -b, 6) AS c, round(b * 10 * (2 + g), 6) AS d")


@query("SELECT p_partkey, p_size % 4 * 90 AS rotate, " + ", ".join(f"CASE p_size % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END::DOUBLE AS {n}" for n, (a, b, c, d) in {"a": (2, 0, -2, 0), "b": (0, 2, 0, -2), "c": (0, 2, 0, -2), "d": (-2, 0, 2, 0), "e": (-20, -40, "2 * (10 + p_size)", "2 * (20 + p_partkey)"), "f": ("2 * (20 + p_partkey)", -20, -40, "2 * (10 + p_size)")}.items()) + " FROM part")
def page_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default matrices of boxes from (10, 20), at 144 dots an inch, for the four rotations."""
    box = [F.lit(10.0), F.lit(20.0), 10 + F.col("p_size").cast("double"), 20 + F.col("p_partkey").cast("double")]
    turned = F.col("p_size") % 4 * 90
    return table(spark, sf_dir, "part").select("p_partkey", turned.alias("rotate"), *(c.alias(n) for n, c in zip("abcdef", S.page_matrix(box, turned, 144.0), strict=True)))


# Texts.
_DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _texts(name: str, sql: str):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            return docs.select("doc_id", *(c.alias(k) for k, c in f(F.col("text")).items()))

        QUERIES[name], ORACLES[name] = run, f"SELECT doc_id, {sql} FROM {_DOCS}"
        return f

    return put


@_texts("utf16", "length(text) AS units, 2 * length(text) + 2 AS n_bytes, md5(text) AS back, octet_length(encode(text)) AS utf8_bytes")
def _utf16(t: Column) -> dict[str, Column]:
    return {"units": T.utf16_units(t).cast("long"), "n_bytes": F.octet_length(T.utf16(t, mark=True)).cast("long"), "back": F.md5(T.text_string(T.utf16(t, mark=True)).cast("binary")), "utf8_bytes": F.octet_length(T.from_utf16(T.utf16(t))).cast("long")}


@_texts("code_points", "length(text) AS n, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END)), 0)::BIGINT AS total")
def _code_points(t: Column) -> dict[str, Column]:
    points = T.code_points(t)
    return {"n": F.size(points).cast("long"), "total": F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x)}


@_texts("char_classes", ", ".join(f"coalesce(len(regexp_extract_all(text, '{p}')), 0)::BIGINT AS {n}" for n, p in (("spaces", r"[\t\n\x0B\f\r \x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"), ("letters", r"[\p{L}]"), ("numbers", r"[\p{Nd}]"), ("rights", r"[\x{0590}-\x{08FF}]"), ("forms", r"[\x{FB00}-\x{FB4F}]"))))
def _classes(t: Column) -> dict[str, Column]:
    chars = F.split(t, "")
    tests = {"spaces": T.is_space, "letters": T.is_letter, "numbers": T.is_number, "rights": T.is_right_to_left, "forms": T.is_presentation_form}

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(chars, lambda c: (c != "") & test(c))).cast("long")

    return {n: count(f) for n, f in tests.items()}


@_texts("html_text", "md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0a-\\x1f]', '', 'g'), chr(9), ' '), '&', '&amp;'), '\"', '&#34;'), '<', '&lt;'), '>', '&gt;'), '^ ', '&#160;'), '  ', ' &#160;', 'g'), ' $', '&#160;')) AS html")
def _html(t: Column) -> dict[str, Column]:
    return {"html": F.md5(T.html_text(t).cast("binary"))}


@_texts("lower_ascii", "md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower")
def _lower(t: Column) -> dict[str, Column]:
    return {"lower": F.md5(T.lower_ascii(t).cast("binary"))}


@_texts("base64_text", "md5(base64(encode(text))) AS coded")
def _base64(t: Column) -> dict[str, Column]:
    return {"coded": F.md5(F.regexp_replace(F.base64(t.cast("binary")), r"\s", "").cast("binary"))}


@query("SELECT o_orderkey, o_orderstatus || ' (' || o_orderpriority || ')' AS name, replace(replace(replace(o_orderstatus || ' (' || o_orderpriority || ')', ' ', '#20'), '(', '#28'), ')', '#29') AS written FROM orders")
def sanitized_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("o_orderstatus", F.lit(" ("), "o_orderpriority", F.lit(")"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), T.name_bytes(name).alias("written"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey::INTEGER END AS label, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS said FROM orders")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""), F.col("o_orderkey").cast("string"))
    price = T.decimal(F.concat(F.lit("  "), F.col("o_totalprice").cast("string"), F.lit(" EUR")))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), T.from_decimal(label).alias("label"), T.format_time(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy HH:mm").alias("said"))
