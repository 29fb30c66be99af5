"""Queries on what documents hold besides text, on rewriting and encryption, and on layout and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.kernel import pages as page
from paperloom.operators import labels, layout, search
from paperloom.sources import catalog, pages, pdf

from .registry import ORACLES, QUERIES, WORDS, pdfs, query, table

# The documents with their page counts (n), and their pages (i).
PAGES = WORDS + """, n AS (SELECT d.doc_id, d.lang, d.source, coalesce(d.text, '') AS text, count(p.w) AS n_words, greatest(1, coalesce(max(page_num) + 1, 1)) AS n FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY ALL),
i AS (SELECT doc_id, lang, n, CAST(unnest(range(n)) AS INTEGER) AS k FROM n) """


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.decorated(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, 0 AS page_num, 'Courier' AS name, 'Type 1' AS type, 'WinAnsiEncoding' AS encoding, false AS embedded, false AS subset, 3 AS object FROM documents")
def font_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.font_table(_rich(spark, sf_dir)).drop("to_unicode")


@query(PAGES + "SELECT doc_id, k AS page_num, 0 AS num, 'image' AS type, 2 AS width, 2 AS height, 'rgb' AS color, 3 AS comp, 8 AS bpc, 'image' AS enc, 1.44 :: DOUBLE AS x_ppi, 2.88 :: DOUBLE AS y_ppi, 12 AS size FROM i")
def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.image_table(_rich(spark, sf_dir)).drop("interp", "object", "ratio").withColumns({"x_ppi": F.round("x_ppi", 6), "y_ppi": F.round("y_ppi", 6)})


@query(PAGES + "SELECT doc_id, k AS page_num, 'https://example.org/' || coalesce(lang, '') || '/' || doc_id || '#' || (k + 1) AS uri FROM i")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.annotation_table(_rich(spark, sf_dir)).where("action = 'URI'").select("doc_id", "page_num", "uri")


@query(PAGES + "SELECT doc_id, k AS page_num, CAST(n - 1 AS INTEGER) AS dest_page, 'XYZ' AS dest_kind, 72.0 :: DOUBLE AS x_min, 60.0 :: DOUBLE AS y_min, 172.0 :: DOUBLE AS x_max, 72.0 :: DOUBLE AS y_max FROM i")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.annotation_table(_rich(spark, sf_dir)).where("action = 'GoTo'")
    return found.select("doc_id", "page_num", "dest_page", "dest_kind", *(F.col("rect")[k].alias(c) for k, c in enumerate(("x_min", "y_min", "x_max", "y_max"))))


@query(PAGES + "SELECT doc_id, printf('page-%04d', k + 1) AS name, k AS page, 'XYZ' AS kind, 72.0 :: DOUBLE AS left_, 720.0 :: DOUBLE AS top_ FROM i")
def named_dests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.destination_table(_rich(spark, sf_dir)).select("doc_id", "name", "page", "kind", F.col("left").alias("left_"), F.col("top").alias("top_"))


@query("SELECT doc_id, 'source.txt' AS name, 'The text' AS description, 'text/plain' AS mime, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS checksum, true AS intact, sha256(coalesce(text, '')) AS sha256 FROM documents")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.attachment_table(_rich(spark, sf_dir)).select("doc_id", "name", "description", "mime", "size", "checksum", "intact", F.sha2("data", 256).alias("sha256"))


@query("SELECT doc_id, 'doc.lang' AS field, 'text' AS type, coalesce(lang, '') AS value FROM documents UNION ALL SELECT doc_id, 'doc.source', 'text', coalesce(source, '') FROM documents UNION ALL SELECT doc_id, 'agree', 'checkbox', CASE WHEN doc_id % 2 = 1 THEN 'Off' ELSE 'Yes' END FROM documents")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.field_table(_rich(spark, sf_dir)).select("doc_id", "field", "type", F.col("value")[0].alias("value"))


@query("SELECT doc_id, 0 AS layer, 'Text' AS name, true AS visible FROM documents UNION ALL SELECT doc_id, 1, 'Notes', doc_id % 3 <> 0 FROM documents")
def layer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.layer_table(_rich(spark, sf_dir)).drop("object")


@query(PAGES + "SELECT doc_id, 0 AS base, CAST(least(n, 2) AS INTEGER) AS length, 'r' AS style, '' AS prefix, 1 AS first FROM n UNION ALL SELECT doc_id, 2, CAST(n - 2 AS INTEGER), 'D', 'A-', 5 FROM n WHERE n > 2")
def label_interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.label_table(_rich(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.spelt(catalog.page_range_table(_rich(spark, sf_dir)))


@query(PAGES + "SELECT doc_id, k AS page_num, CASE k WHEN 0 THEN 'i' WHEN 1 THEN 'ii' ELSE 'A-' || (k + 3) END AS label FROM i")
def index_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(PAGES + "SELECT doc_id, k AS page_num FROM i WHERE k = 2")
def label_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.index_of(_labelled(spark, sf_dir), "A-5")


@query(PAGES + "SELECT doc_id, 0 AS node_id, -1 AS parent_id, 0 AS depth, 'Document' AS type, '' AS alt FROM n UNION ALL SELECT doc_id, k + 1, 0, 1, 'Sect', 'Page ' || (k + 1) FROM i")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.structure_table(_rich(spark, sf_dir)).select("doc_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth", "type", F.coalesce("alt", F.lit("")).alias("alt"))


@query("SELECT doc_id, 'name' AS place, 'var doc = ' || doc_id || ';' AS code FROM documents UNION ALL SELECT doc_id, 'open', 'open();' FROM documents")
def javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.script_table(_rich(spark, sf_dir)).select("doc_id", "place", "code")


@query("SELECT doc_id, 'UseOutlines' AS page_mode, 'OneColumn' AS page_layout, 'AcroForm' AS form, true AS tagged, coalesce(lang, '') AS lang, '<title>doc-' || doc_id || '</title>' AS xmp, md5(coalesce(text, '')) AS permanent_id, false AS linearized FROM documents")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fact_table(_rich(spark, sf_dir)).drop("update_id", "viewer")


@query(PAGES + ", l AS (SELECT n, greatest(1, (n_words + 7) // 8) AS l FROM n), s AS (SELECT CAST(sum(n) AS BIGINT) AS p, CAST(sum(l) AS BIGINT) AS l FROM l) SELECT operator, n FROM (SELECT unnest(['BT', 'ET', 'Tf', 'TL', 'Td']) AS operator, p AS n FROM s UNION ALL SELECT 'Tj', l FROM s UNION ALL SELECT 'T*', l - p FROM s)")
def content_op_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.operation_table(pdfs(spark, sf_dir)).groupBy("operator").agg(F.sum("n").alias("n"))


@query(PAGES + "SELECT doc_id // 2 AS key, CAST(sum(n) AS BIGINT) AS n_pages, CAST(sum(n_words) AS BIGINT) AS n_words FROM n GROUP BY 1")
def merge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pdf.merge_docs(pdfs(spark, sf_dir).withColumn("key", F.floor(F.col("doc_id") / 2)), "key", "doc_id").withColumnRenamed("key", "doc_id")
    return pdf.count_table(merged).select(F.col("doc_id").alias("key"), "n_pages", "n_words")


@query("SELECT doc_id, 'new-' || doc_id AS title, coalesce(lang, '') AS keywords, coalesce(source, '') AS author, true AS removed, false AS rebuilt FROM documents")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    entries = docs.select("doc_id", F.create_map(F.lit("Title"), F.concat(F.lit("new-"), "doc_id"), F.lit("Keywords"), F.coalesce("lang", F.lit("")), F.lit("Subject"), F.lit(None).cast("string")).alias("info"))
    found = pdf.info_table(pdf.set_info(pdf.synthesized(docs), entries))
    return found.select("doc_id", *(F.col("info")[k].alias(k.lower()) for k in ("Title", "Keywords", "Author")), F.col("info.Subject").isNull().alias("removed"), "rebuilt")


def _encrypted(name: str, method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").withColumn("password", F.lit(b"reader"))
        found = pdf.count_table(pdf.protected(docs, method, b"reader", b"owner", "password"))
        return found.select("doc_id", "encrypted", "title", *(F.when(F.col("doc_id").isNull(), 0).otherwise(F.col(c)).alias(c) for c in ("n_words", "n_letters")))

    QUERIES[name] = run
    ORACLES[name] = WORDS + "SELECT d.doc_id, true AS encrypted, 'doc-' || d.doc_id AS title, count(p.w) AS n_words, CAST(coalesce(sum(length(p.text)), 0) AS BIGINT) AS n_letters FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id"


_encrypted("encrypted_rc4", "RC4-128")
_encrypted("encrypted_aes", "AES-128")


@query("SELECT o_orderkey, (o_orderkey >> 2) & 1 = 1 AS print, (o_orderkey >> 3) & 1 = 1 AS change, (o_orderkey >> 4) & 1 = 1 AS copy, (o_orderkey >> 5) & 1 = 1 AS annotate, (o_orderkey >> 8) & 1 = 1 AS fill, (o_orderkey >> 9) & 1 = 1 AS access, (o_orderkey >> 10) & 1 = 1 AS assemble, (o_orderkey >> 11) & 1 = 1 AS print_high FROM orders")
def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(k) for k, c in S.permissions(F.col("o_orderkey")).items()))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN a AND b AND c WHEN 1 THEN a OR b OR c WHEN 2 THEN NOT (a AND b AND c) ELSE NOT (a OR b OR c) END AS visible FROM (SELECT *, l_returnflag = 'A' AS a, l_linestatus = 'O' AS b, l_quantity > 25 AS c FROM lineitem)")
def oc_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = F.element_at(F.array(*map(F.lit, ("AllOn", "AnyOn", "AnyOff", "AllOff"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    states = F.array(F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", F.col("l_quantity") > 25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.layer_visible(policy, states).alias("visible"))


_PARTS = "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS c, l_tax * 10 AS m, l_quantity / 50 AS y, (l_linenumber - 1) / 10.0 :: DOUBLE AS k FROM lineitem) "


def _corners(channel: int) -> str:
    return " + ".join(" * ".join([str(v[channel]), *(p if at else f"(1 - {p})" for p, at in zip("cmyk", corner, strict=True))]) for corner, v in S.CMYK_CORNERS.items() if v[channel])


@query(_PARTS + f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(greatest(0, least(1, {_corners(n)})), 10) AS {c}' for n, c in enumerate(('red', 'green', 'blue')))} FROM c")
def cmyk_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, (F.col("l_linenumber") - 1) / F.lit(10.0)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 10).alias(n) for n, c in zip(("red", "green", "blue"), S.cmyk_to_rgb(*parts), strict=True)))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 0.0 WHEN l_linenumber = 2 THEN 0.5 ELSE 1.0 END :: DOUBLE AS red, CASE WHEN l_linenumber <= 1 THEN 1.0 WHEN l_linenumber = 2 THEN 0.25 ELSE 0.75 END :: DOUBLE AS green FROM lineitem")
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green = S.indexed(F.col("l_linenumber") - 1, [(0, 1), (0.5, 0.25), (1, 0.75)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", red.alias("red"), green.alias("green"))


@query("SELECT l_orderkey, l_linenumber, greatest(10, least(40, l_quantity)) AS x_min, greatest(0, least(20, l_linenumber * 5.0 - 10)) :: DOUBLE AS y_min, greatest(10, least(40, l_quantity + 7)) AS x_max, greatest(0, least(20, l_linenumber * 5.0)) :: DOUBLE AS y_max FROM lineitem")
def rect_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    box = S.clip([x, y - 10, x + 7, y], [F.lit(v) for v in (10.0, 0.0, 40.0, 20.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in zip(("x_min", "y_min", "x_max", "y_max"), box, strict=True)))


NEEDLES = ["informacion", "uber", "ano", "the", "ñ"]


@query(WORDS + " UNION ALL ".join(f"SELECT '{n}' AS needle, count(*) AS n_words, count(DISTINCT doc_id) AS n_docs FROM placed WHERE contains({'strip_accents(lower(text))' if n.isascii() else 'lower(text)'}, '{n}') HAVING count(*) > 0" for n in NEEDLES))
def search_ignore_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages.found_words(pdfs(spark, sf_dir), search.folded, [search.folded(n) for n in NEEDLES], search.bare)
    hits = search.search(held, NEEDLES, ignore_case=True, ignore_diacritics=True)
    return hits.groupBy("needle").agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("doc_id").alias("n_docs"))


@query(WORDS + "SELECT doc_id, page_num, needle, min_by(text, w) AS text, min(w) % 432 AS word_num FROM placed, (SELECT unnest(['er', 'la']) AS needle) WHERE contains(lower(text), needle) GROUP BY doc_id, page_num, needle")
def search_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(pdf.word_table(pdfs(spark, sf_dir)), ["er", "la"], ignore_case=True)
    return search.first_matches(hits).select("doc_id", "page_num", "needle", "text", F.col("word_num").cast("long").alias("word_num"))


PASSAGES = ["of the", "in the", "de la", "und die", "er-"]
_TEXTS = WORDS + r", pages_ AS (SELECT doc_id, page_num, ltrim(string_agg(CASE WHEN w % 8 = 0 THEN chr(10) ELSE ' ' END || text, '' ORDER BY w), chr(10)) AS text FROM placed GROUP BY doc_id, page_num) "


@query(_TEXTS + ", h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS needle, doc_id, len(regexp_extract_all(lower(text), '{search.across_lines(n)}')) AS hits FROM pages_" for n in PASSAGES) + ") SELECT needle, CAST(sum(hits) AS BIGINT) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM h WHERE hits > 0 GROUP BY needle")
def search_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages.text_table(pdfs(spark, sf_dir))
    return search.search_pages(texts, PASSAGES, ignore_case=True).groupBy("needle").agg(F.sum("hits").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query(WORDS + "SELECT doc_id, page_num, line, string_agg(text, ' ' ORDER BY w) AS text FROM placed WHERE (x_min + x_max) / 2 BETWEEN 100.5 AND 300.5 AND base - 3 BETWEEN 100 AND 400 GROUP BY doc_id, page_num, line")
def select_area_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = layout.select_area(pdf.word_table(pdfs(spark, sf_dir)), (100.5, 100.0, 300.5, 400.0))
    return layout.lines(area).select("doc_id", "page_num", "line", "text")


@query(_TEXTS + "SELECT doc_id, page_num, md5(replace(text, '-' || chr(10), '')) AS joined FROM pages_")
def dehyphenate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages.text_table(pdfs(spark, sf_dir))
    return texts.select("doc_id", "page_num", F.md5(layout.dehyphenated(F.col("text"), "all").cast("binary")).alias("joined"))


@query(WORDS + "SELECT doc_id, page_num, count(*) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_letters FROM placed GROUP BY doc_id, page_num")
def dup_text_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pdf.word_table(pdfs(spark, sf_dir))
    again = words.withColumns({"word_num": F.col("word_num") + 1_000_000, "x_min": F.col("x_min") + 0.4, "base": F.col("base") + 0.3})
    return layout.without_doubles(words.unionByName(again)).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_letters"))


@query(PAGES + r""", e AS (SELECT doc_id, page_num, w, x_min, x_max, base, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS text FROM placed),
x AS (SELECT doc_id, page_num, string_agg(printf('    <word xMin="%.6f" yMin="%.6f" xMax="%.6f" yMax="%.6f">%s</word>', x_min :: DOUBLE, base - 8.0 :: DOUBLE, x_max :: DOUBLE, base + 2.0 :: DOUBLE, text) || chr(10), '' ORDER BY w) AS body FROM e GROUP BY doc_id, page_num)
SELECT i.doc_id, i.k AS page_num, md5('  <page width="612.000000" height="792.000000">' || chr(10) || coalesce(body, '') || '  </page>' || chr(10)) AS xhtml FROM i LEFT JOIN x ON i.doc_id = x.doc_id AND i.k = x.page_num""")
def bbox_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.markup_table(pdfs(spark, sf_dir), page.bbox_page).select("doc_id", "page_num", F.md5(F.col("xhtml").cast("binary")).alias("xhtml"))
