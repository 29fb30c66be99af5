"""Queries on document tables, and the SQL that gives the same rows from the texts alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import calculators as C
from paperloom.functions import scalars as S
from paperloom.kernel import filters
from paperloom.sources import pages, pdf

from .registry import ORACLES, QUERIES, WORDS, pdfs, query, table


@query(WORDS + "SELECT lang, count(*) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_letters FROM placed GROUP BY lang")
def text_words_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = pdf.word_table(pdf.synthesized(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("s"))
    return words.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum("s").alias("n_letters"))


@query(WORDS + "SELECT doc_id, page_num, line, text, CAST(round(x_min, 2) AS DOUBLE) AS x_min, CAST(round(x_max, 2) AS DOUBLE) AS x_max, CAST(base - 8 AS DOUBLE) AS y_min, CAST(base + 2 AS DOUBLE) AS y_max FROM placed")
def word_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pdf.word_table(pdfs(spark, sf_dir))
    return words.select("doc_id", "page_num", "line", "text", *(F.round(c, 2).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))


@query(WORDS + "SELECT doc_id, page_num, line, string_agg(text, ' ' ORDER BY w) AS text, CAST(round(min(x_min), 2) AS DOUBLE) AS x_min, CAST(round(max(x_max), 2) AS DOUBLE) AS x_max FROM placed GROUP BY doc_id, page_num, line")
def line_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.layout import lines

    found = lines(pdf.word_table(pdfs(spark, sf_dir)))
    return found.select("doc_id", "page_num", "line", "text", F.round("x_min", 2).alias("x_min"), F.round("x_max", 2).alias("x_max"))


@query(WORDS + "SELECT doc_id, page_num, CAST(round(min(x_min), 2) AS DOUBLE) AS x_min, CAST(round(max(x_max), 2) AS DOUBLE) AS x_max, CAST(min(base) - 8 AS DOUBLE) AS y_min, CAST(max(base) + 2 AS DOUBLE) AS y_max FROM placed GROUP BY doc_id, page_num")
def page_ink_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pdf.word_table(pdfs(spark, sf_dir)).groupBy("doc_id", "page_num")
    return words.agg(*(F.round(f(c), 2).alias(c) for c, f in (("x_min", F.min), ("x_max", F.max), ("y_min", F.min), ("y_max", F.max))))


@query(WORDS + "SELECT doc_id, page_num, string_agg(text, CASE WHEN w % 8 = 0 THEN chr(10) ELSE ' ' END ORDER BY w) AS text FROM placed GROUP BY doc_id, page_num".replace("string_agg(text, CASE WHEN w % 8 = 0 THEN chr(10) ELSE ' ' END ORDER BY w)", "ltrim(string_agg(CASE WHEN w % 8 = 0 THEN chr(10) ELSE ' ' END || text, '' ORDER BY w), chr(10))"))
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.text_table(pdfs(spark, sf_dir))


@query(WORDS + "SELECT d.doc_id, greatest(1, coalesce(max(page_num) + 1, 1)) AS n_pages FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.info_table(pdfs(spark, sf_dir)).select("doc_id", "n_pages")


@query("SELECT doc_id, 'doc-' || doc_id AS title, lang AS subject, source AS author, 1 AS version_major, 7 AS version_minor FROM documents")
def info_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.info_table(pdfs(spark, sf_dir)).select("doc_id", F.col("info.Title").alias("title"), F.col("info.Subject").alias("subject"), F.col("info.Author").alias("author"), "version_major", "version_minor")


@query(WORDS + ", n AS (SELECT d.doc_id, greatest(1, coalesce(max(page_num) + 1, 1)) AS n FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id), i AS (SELECT doc_id, unnest(range(n)) AS k FROM n) SELECT doc_id, CAST(k AS INTEGER) AS node_id, 0 AS depth, CAST(k AS INTEGER) AS ord, 'Page ' || (k + 1) AS title FROM i")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.outline_table(pdfs(spark, sf_dir)).select("doc_id", "node_id", "depth", "ord", "title")


@query(WORDS + ", n AS (SELECT d.doc_id, greatest(1, coalesce(max(page_num) + 1, 1)) AS n FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id), i AS (SELECT doc_id, unnest(range(n)) AS k FROM n) SELECT doc_id, CAST(k AS INTEGER) AS page_num, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotate FROM i")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.col("media_box")
    return pdf.page_table(pdfs(spark, sf_dir)).select("doc_id", "page_num", (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"), "rotate")


@query(WORDS + ", n AS (SELECT d.doc_id, greatest(1, coalesce(max(page_num) + 1, 1)) AS n FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id), s AS (SELECT count(*) AS d, sum(n) AS n FROM n) SELECT type, CAST(n AS BIGINT) AS n_objects FROM (SELECT 'Catalog' AS type, d AS n FROM s UNION ALL SELECT 'Pages', d FROM s UNION ALL SELECT 'Font', d FROM s UNION ALL SELECT 'Page', n FROM s UNION ALL SELECT 'Outlines', d FROM s UNION ALL SELECT '(none)', 2 * n + d FROM s)")
def object_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.object_table(pdfs(spark, sf_dir))
    return found.groupBy(F.coalesce("type", F.lit("(none)")).alias("type")).agg(F.count(F.lit(1)).alias("n_objects"))


@query(WORDS + "SELECT doc_id, page_num, count(*) AS n_words, min_by(text, w) AS first_word FROM placed GROUP BY doc_id, page_num")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pages.part_table(pdf.split_pages(pdfs(spark, sf_dir)))
    return parts.groupBy("doc_id", "page_num").agg(F.sum("n_words").alias("n_words"), F.first("first_word").alias("first_word"))


NEEDLES = ["the", "Ing", "über", "éa", "ñ"]
_NEEDLE_SQL = "(SELECT unnest(['the', 'Ing', 'über', 'éa', 'ñ']) AS needle)"


def _search(name: str, sql: str, ignore_case: bool, whole: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from paperloom.operators.search import search

        held = pages.found_words(pdfs(spark, sf_dir), str.lower, [n.lower() for n in NEEDLES])
        hits = search(held, NEEDLES, ignore_case=ignore_case, whole_words=whole)
        return hits.groupBy("needle").agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("doc_id").alias("n_docs"))

    QUERIES[name], ORACLES[name] = run, WORDS + f"SELECT needle, count(*) AS n_words, count(DISTINCT doc_id) AS n_docs FROM placed, {_NEEDLE_SQL} WHERE {sql} GROUP BY needle"


_search("search_cs", "contains(text, needle)", False, False)
_search("search_ci", "contains(lower(text), lower(needle))", True, False)
_search("search_whole_word", "", True, True)
ORACLES["search_whole_word"] = WORDS + " UNION ALL ".join(f"SELECT '{n}' AS needle, count(*) AS n_words, count(DISTINCT doc_id) AS n_docs FROM placed WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{Nd}}]){n.lower()}($|[^\\p{{L}}\\p{{Nd}}])') HAVING count(*) > 0" for n in NEEDLES)


@query("SELECT p_partkey, p_size, CASE WHEN p_size > 0 THEN repeat('m', p_size // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][p_size // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_size // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] ELSE '' END AS label, p_size AS back FROM part")
def page_label_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = S.to_roman(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", label.alias("label"), S.from_roman(label).alias("back"))


@query("SELECT p_partkey, p_size, repeat(chr(97 + (p_size - 1) % 26), (p_size - 1) // 26 + 1) AS label, p_size AS back FROM part")
def page_label_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = S.to_latin(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", label.alias("label"), S.from_latin(label).alias("back"))


@query("SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+00''00''' AS pdf_date, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS back FROM orders")
def pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    said = S.format_date(F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", said.alias("pdf_date"), S.parse_date(said).cast("timestamp_ntz").alias("back"))


def _rounded(columns: dict[str, Column]) -> list[Column]:
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


_RGB = "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS r, l_tax * 10 AS g, l_quantity / 50 AS b FROM lineitem) "


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") / 50).alias("b"))


@query(_RGB + "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.3 * r + 0.59 * g + 0.11 * b)), 6) AS gray FROM c")
def rgb_to_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"gray": S.rgb_to_gray(*map(F.col, "rgb"))}))


@query(_RGB + ", k AS (SELECT *, least(1 - r, 1 - g, 1 - b) AS k FROM c) SELECT l_orderkey, l_linenumber, round(1 - r - k, 6) AS cyan, round(1 - g - k, 6) AS magenta, round(1 - b - k, 6) AS yellow, round(k, 6) AS black FROM k")
def rgb_to_cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded(dict(zip(("cyan", "magenta", "yellow", "black"), S.rgb_to_cmyk(*map(F.col, "rgb")), strict=True))))


@query(_RGB + "SELECT l_orderkey, l_linenumber, round(2 * r - 0.5 * g + 10, 6) AS x, round(0.25 * r + 3 * g - 4, 6) AS y, round(r, 6) AS back_x, round(g, 6) AS back_y FROM c")
def matrix_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.lit(v) for v in (2.0, 0.25, -0.5, 3.0, 10.0, -4.0)]
    x, y = S.transform(m, F.col("r"), F.col("g"))
    a, b = S.transform(S.inverse(m), x, y)
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"x": x, "y": y, "back_x": a, "back_y": b}))


@query(_RGB + "SELECT l_orderkey, l_linenumber, (r BETWEEN 0.2 AND 0.7 AND b BETWEEN 0.1 AND 0.9) AS inside FROM c")
def rect_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", S.contains([F.lit(v) for v in (0.7, 0.1, 0.2, 0.9)], F.col("r"), F.col("b")).alias("inside"))


@query(_RGB + "SELECT l_orderkey, l_linenumber, round(0.1 + pow(b, 2.2) * 0.8, 6) AS y0, round(1 - pow(b, 2.2), 6) AS y1 FROM c")
def fn_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = C.exponential(F.col("b"), [0.1, 1.0], [0.9, 0.0], 2.2)
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"y0": y[0], "y1": y[1]}))


@query(_RGB + "SELECT l_orderkey, l_linenumber, round(CASE WHEN b < 0.3 THEN b / 0.3 WHEN b < 0.75 THEN 1 - pow((b - 0.3) / 0.45, 2) ELSE 0.5 * (1 - (b - 0.75) / 0.25) END, 6) AS y FROM c")
def fn_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = [lambda x: x, lambda x: 1 - F.pow(x, F.lit(2.0)), lambda x: 0.5 * x]
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"y": C.stitched(F.col("b"), pieces, [0.3, 0.75], [(0, 1), (0, 1), (1, 0)])}))


@query(_RGB + ", a AS (SELECT *, greatest(0, least(1, b)) * 4 AS t FROM c), f AS (SELECT *, CAST(least(floor(t), 3) AS INTEGER) AS i, [0.0, 0.5, 0.25, 1.0, 0.75] AS s FROM a) SELECT l_orderkey, l_linenumber, round(CAST(s[i + 1] AS DOUBLE) + (t - i) * (CAST(s[i + 2] AS DOUBLE) - CAST(s[i + 1] AS DOUBLE)), 6) AS y FROM f")
def fn_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"y": C.sampled(F.col("b"), [0.0, 0.5, 0.25, 1.0, 0.75])}))


# Programs on r, g and b, and the SQL of their values.
PROGRAMS = {
    "add_sub_mul": ("{ 3 1 roll add 2 mul exch sub }", "(r + g) * 2 - b"),
    "div_abs_neg": ("{ pop pop 2 div neg abs 0.25 add }", "r / 2 + 0.25"),
    "sqrt_exp": ("{ exch pop exch pop sqrt 3 exp }", "pow(sqrt(b), 3)"),
    "sin_cos": ("{ 90 mul sin exch 90 mul cos add exch pop }", "sin(radians(b * 90)) + cos(radians(g * 90))"),
    "atan": ("{ 1 add exch 1 add exch atan 360 div exch pop }", "degrees(atan2(g + 1, b + 1)) / 360"),
    "ln_log": ("{ 1 add ln exch 1 add log add exch pop }", "ln(b + 1) + log10(g + 1)"),
    "rounding": ("{ 10 mul round exch 10 mul floor add exch 10 mul ceiling add 30 div }", "(round(b * 10) + floor(g * 10) + ceil(r * 10)) / 30"),
    "truncate_cvi": ("{ 50 mul cvi 7 mod exch 50 mul truncate add exch pop 100 div }", "(trunc(b * 50)::BIGINT % 7 + trunc(g * 50)) / 100"),
    "idiv_bits": ("{ 50 mul cvi dup 3 idiv exch 12 and or 5 xor 2 bitshift -1 bitshift 200 div exch pop exch pop }", "((xor((trunc(b * 50)::BIGINT // 3) | (trunc(b * 50)::BIGINT & 12), 5) << 2) >> 1) / 200.0"),
    "compare_ifelse": ("{ 2 copy gt { pop } { exch pop } ifelse 2 copy ge { exch } if pop }", "least(r, greatest(g, b))"),
    "logic": ("{ 0.5 lt exch 0.5 le and exch 0.5 ne or not { 0.25 } { 0.75 } ifelse }", "CASE WHEN (b < 0.5 AND g <= 0.5) OR r <> 0.5 THEN 0.75 ELSE 0.25 END"),
    "stack": ("{ 3 copy pop pop 3 index eq { dup } { 1 index } ifelse add 3 div exch pop exch pop }", "(b + b) / 3"),
}


def _program(name: str, code: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        y = C.postscript(code, [F.col(c) for c in "rgb"], [(-4, 4)])[0]
        return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"y": y}))

    QUERIES[f"fn_ps_{name}"], ORACLES[f"fn_ps_{name}"] = run, _RGB + f"SELECT l_orderkey, l_linenumber, round(greatest(-4.0, least(4.0, {sql}))::DOUBLE, 6) AS y FROM c"


for _name, (_code, _sql) in PROGRAMS.items():
    _program(_name, _code, _sql)

# Blend modes of ISO 32000-1, 11.3.5: of backdrop g and source b.
BLENDS = {
    "multiply": (lambda s, t: s * t, "g * b"),
    "screen": (lambda s, t: s + t - s * t, "g + b - g * b"),
    "darken": (lambda s, t: F.least(s, t), "least(g, b)"),
    "lighten": (lambda s, t: F.greatest(s, t), "greatest(g, b)"),
    "difference": (lambda s, t: F.abs(s - t), "abs(g - b)"),
    "exclusion": (lambda s, t: s + t - 2 * s * t, "g + b - 2 * g * b"),
    "hard_light": (lambda s, t: F.when(t < 0.5, 2 * s * t).otherwise(1 - 2 * (1 - s) * (1 - t)), "CASE WHEN b < 0.5 THEN 2 * g * b ELSE 1 - 2 * (1 - g) * (1 - b) END"),
    "overlay": (lambda s, t: F.when(s < 0.5, 2 * s * t).otherwise(1 - 2 * (1 - s) * (1 - t)), "CASE WHEN g < 0.5 THEN 2 * g * b ELSE 1 - 2 * (1 - g) * (1 - b) END"),
}


def _blend(name: str, f: Callable, sql: str) -> None:
    QUERIES[f"blend_{name}"] = lambda spark, sf_dir: _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *_rounded({"y": f(F.col("g"), F.col("b"))}))
    ORACLES[f"blend_{name}"] = _RGB + f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS y FROM c"


for _name, (_f, _sql) in BLENDS.items():
    _blend(_name, _f, _sql)


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def _round_trip(name: str, short: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import pyarrow as pa

        def both(batches):
            for b in batches:
                raw = [filters.decode(filters.ENCODERS[name](x or b""), [name], [{}]) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
        return docs.mapInArrow(both, "doc_id long, raw binary").select("doc_id", F.md5("raw").alias("md5"))

    QUERIES[f"{short}_roundtrip"], ORACLES[f"{short}_roundtrip"] = run, "SELECT doc_id, md5(text) AS md5 FROM documents"


for _name, _short in (("ASCIIHexDecode", "hex"), ("ASCII85Decode", "ascii85"), ("RunLengthDecode", "runlength"), ("LZWDecode", "lzw"), ("FlateDecode", "flate")):
    _round_trip(_name, _short)
