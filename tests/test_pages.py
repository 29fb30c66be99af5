import pytest
from pyspark.sql import functions as F

from paperloom.kernel import pages as page
from paperloom.kernel import variants
from paperloom.kernel.content import Interpreter, placed_words, words
from paperloom.kernel.document import Document
from paperloom.operators import layout, reading, sinks
from paperloom.sources import pages, pdf

TEXT = " ".join(f"w{i}é <&'\">"[: 3 + i % 7] for i in range(900))
ROWS = [(1, TEXT), (2, "a few words"), (3, ""), (4, None), (5, "żółw 東京 x"), (6, TEXT[:3000])]


@pytest.fixture(scope="module")
def corpora(spark):
    docs = spark.createDataFrame([(k, t, "en", "web") for k, t in ROWS], "doc_id long, text string, lang string, source string")
    kinds = {"plain": pdf.synthesized(docs), "marked": pdf.made(docs, lambda r: variants.marked(r["text"], r["doc_id"])), "wide": pdf.made(docs, lambda r: variants.coded(r["text"], "Differences"))}
    return {k: (v, spark.createDataFrame(v.collect(), v.schema)) for k, v in kinds.items()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["plain", "marked", "wide"])
def test_pages_are_those_of_word_tables(corpora, kind):
    """Made where they are read, or read from bytes and put together from rows of words."""
    made, held = corpora[kind]
    table, leaves = pdf.word_table(held), pdf.page_table(held)
    assert rows(pdf.word_table(made)) == rows(table)
    assert rows(pages.text_table(made)) == rows(layout.page_texts(layout.lines(table)).select("doc_id", "page_num", "text"))
    for text, operator in ((page.raw_text, reading.raw_texts), (page.physical_text, reading.physical_texts), (page.reading_text, lambda w: reading.reading_texts(reading.in_reading_order(w)))):
        assert rows(pages.text_table(made, text)) == rows(operator(table).select("doc_id", "page_num", "text"))
    assert rows(pages.line_table(made)) == rows(layout.lines(table))
    assert rows(pages.markup_table(made, page.bbox_page)) == rows(layout.bbox_pages(table, leaves))
    assert rows(pages.markup_table(made, page.layout_page)) == rows(sinks.layout_pages(reading.in_reading_order(table), leaves))
    assert rows(pages.xml_table(made)) == rows(sinks.xml_pages(table, leaves))
    assert rows(pages.report_table(made)) == rows(reading.word_report(reading.in_reading_order(table), leaves))
    assert rows(pages.text_table(made.limit(0))) == []


def test_columns_are_read_one_by_one():
    def w(line, x, base, text):
        return line, text, x, base - 8.0, x + 6.0 * len(text), base + 2.0, base, 10.0, "Courier", 0

    two = [w(0, 72.0, 100.0, "one"), w(0, 300.0, 100.0, "three"), w(1, 72.0, 112.0, "two"), w(1, 300.0, 112.0, "four")]
    assert page.reading_text(two) == "one\ntwo\n\nthree\nfour"
    assert page.physical_text(two) == "one" + " " * 35 + "three\ntwo" + " " * 35 + "four"
    assert page.raw_text([]) == page.physical_text([]) == page.reading_text([]) == page.page_text([]) == ""


@pytest.mark.parametrize("body", [b"(one two) Tj", b"[(wo) 0 (rd ) (x)] TJ", b"[(wo) -900 (rd)] TJ", b"(a) Tj 3 Tc (bc d) Tj 0 Tc (e) Tj", b"( ) Tj (x) Tj", b"0 1 -1 0 9 9 Tm (up there) Tj (on) Tj", b"1 .3 0 1 9 9 Tm (skew ed) Tj", b"-50 Tz (back wards) Tj", b"(a b) Tj /G 9 Tf (c) Tj T* (d)'"])
def test_whole_strings_give_the_words_of_their_glyphs(body):
    from test_content import document
    from paperloom.kernel.syntax import Name

    doc = document(b"BT /F 10 Tf 12 TL 1 0 0 1 72 700 Tm " + body + b" ET", {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, {"Font": {"F": {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, "G": {"Subtype": Name("TrueType")}}})
    (_, leaf), run = next(doc.pages()), Interpreter(doc)
    assert placed_words(run.spans(leaf)) == [tuple(w) for w in words(run.glyphs(leaf))]


def test_two_decimals_are_those_of_the_columns(spark):
    numbers = [0.125, 1.005, 2.675, -0.125, 72.345, 0.0, -0.0, 1e-9, 100.004999, 655.555]
    rounded = [r.y for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(F.round("x", 2).alias("y")).collect()]
    assert [page.HUNDREDTHS[x] for x in numbers] == rounded
