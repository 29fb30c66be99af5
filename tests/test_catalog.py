import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.kernel import catalog, security
from paperloom.kernel.document import Document
from paperloom.kernel.syntax import Name, Ref
from paperloom.kernel.writer import decorate, file_of, synthesize, synthesize_protected, update
from paperloom.operators import labels, layout, search
from paperloom.sources import catalog as tables
from paperloom.sources import pdf

TEXT = " ".join(f"w{i}é" for i in range(1400))


def test_ciphers():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert security.aes_encrypt(bytes(range(16)), bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert security.aes_encrypt(bytes(range(32)), bytes(16), block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert security.aes_decrypt(bytes(range(32)), bytes(16), security.aes_encrypt(bytes(range(32)), bytes(16), block * 5)) == block * 5
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 160, 400])
def test_ciphers_of_the_library_are_those_written_here(size):
    key, data = bytes(range(16)), bytes(i * 7 & 255 for i in range(size))
    whole = data[: size // 16 * 16]
    assert security.rc4(key, data) == security.plain_rc4(key, data)
    for k in (key, key * 2):
        sealed = security.aes_encrypt(k, key, whole)
        assert sealed == security.plain_encrypt(k, key, whole)
        assert security.aes_decrypt(k, key, sealed + b"x") == security.plain_decrypt(k, key, sealed + b"x") == whole


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AES-128", "AES-256"])
def test_encryption(method):
    raw = synthesize_protected("a few words", {"Title": "tü"}, method, b"reader", b"owner")
    assert b"few" not in raw
    for word, opens, owner in ((b"reader", True, False), (b"owner", True, True), (b"", False, None)):
        doc = Document(raw, word)
        assert doc.ok == opens and (not opens or doc.info() == {"Title": "tü"} and doc.crypt.owner == owner)
        if not opens:
            assert doc.locked and not list(doc.objects()) and not list(doc.pages())
    damaged = Document(raw.replace(b"startxref", b"startxxxx"), b"reader")
    assert damaged.rebuilt and damaged.info() == {"Title": "tü"}


def test_catalog():
    doc = Document(decorate(TEXT, {"Title": "t", "Subject": "en", "Author": "s"}, 6))
    assert [f["name"] for f in catalog.fonts(doc)] == ["Courier"]
    assert [(a["action"], a["dest_page"]) for a in catalog.annotations(doc)][:2] == [("URI", None), ("GoTo", 3)]
    assert [(d["page"], d["name"]) for d in catalog.destinations(doc)] == [(i, f"page-{i + 1:04d}") for i in range(4)]
    (held,) = catalog.attachments(doc)
    assert held["data"].decode() == TEXT and held["intact"]
    assert [(f["field"], f["value"]) for f in catalog.fields(doc)] == [("doc.lang", ["en"]), ("doc.source", ["s"]), ("agree", ["Yes"])]
    assert [x["visible"] for x in catalog.layers(doc)] == [True, False]
    assert [(x["base"], x["length"]) for x in catalog.labels(doc)] == [(0, 2), (2, 2)]
    assert [x["type"] for x in catalog.structure(doc)] == ["Document"] + ["Sect"] * 4
    assert [x["code"] for x in catalog.scripts(doc)] == ["var doc = 6;", "open();"]
    assert catalog.facts(doc)["xmp"] == "<title>t</title>"


def test_cycles_and_damage_end():
    root = {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Names": {"Dests": Ref(4, 0), "EmbeddedFiles": Ref(4, 0)}, "AcroForm": {"Fields": [Ref(5, 0)]}, "StructTreeRoot": {"K": Ref(6, 0)}, "PageLabels": 7, "OCProperties": [1]}
    page = {"Type": Name("Page"), "Parent": Ref(2, 0), "Annots": [Ref(3, 0), 5, {"Rect": [1]}], "Resources": {"XObject": {"X": Ref(3, 0)}}}
    loop = {4: {"Kids": [Ref(4, 0)], "Names": [b"odd"]}, 5: {"T": b"x", "Kids": [Ref(5, 0)]}, 6: {"S": Name("P"), "K": [Ref(6, 0)]}}
    doc = Document(file_of({1: root, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: page, **loop}, 1))
    for f in (catalog.fonts, catalog.images, catalog.annotations, catalog.destinations, catalog.attachments, catalog.fields, catalog.layers, catalog.labels, catalog.structure, catalog.scripts):
        list(f(doc))
    assert catalog.facts(doc)["page_mode"] == "UseNone"


def test_update_keeps_the_rest():
    raw = synthesize(TEXT, {"Title": "x"})
    doc = Document(update(update(raw, {4: {"Title": b"y"}}), {4: {"Title": b"z"}}))
    assert not doc.rebuilt and doc.info() == {"Title": "z"} and len(list(doc.pages())) == 4


def test_tables_of_nulls_and_empties(spark):
    rows = spark.createDataFrame([(1, None), (None, bytearray(b"")), (2, bytearray(b"no document"))], "doc_id long, bytes binary")
    for f in (tables.font_table, tables.image_table, tables.annotation_table, tables.destination_table, tables.attachment_table, tables.field_table, tables.layer_table, tables.label_table, tables.structure_table, tables.script_table, tables.fact_table, tables.operation_table, pdf.word_table, pdf.page_table):
        assert f(rows).count() == 0
        assert f(rows.limit(0)).count() == 0


def test_labels(spark):
    pages = spark.createDataFrame([(1, i) for i in range(5)], "doc_id long, page_num int")
    ranges = spark.createDataFrame([(1, 1, 2, "R", "p", 4), (1, 3, 2, None, "end", 1)], "doc_id long, base int, length int, style string, prefix string, first int")
    found = labels.page_labels(pages, ranges)
    assert [r.label for r in found.orderBy("page_num").collect()] == ["1", "pIV", "pV", "end", "end"]
    assert [r.page_num for r in labels.index_of(found, "end").collect()] == [3]


WORD = "doc_id long, page_num int, word_num int, line int, text string, x_min double, y_min double, x_max double, y_max double, base double, size double"


def test_search_flags(spark):
    words = spark.createDataFrame([(1, 0, i, 0, t, 10.0 * i, 0.0, 10.0 * i + 8, 10.0, 8.0, 10.0) for i, t in enumerate(["cigüeña", "Brown,", "brown"])], WORD)

    def n(needle, **how):
        return search.search(words, [needle], **how).count()

    assert [n("ciguena"), n("ciguena", ignore_diacritics=True), n("Ciguena", ignore_diacritics=True), n("cigüena", ignore_diacritics=True), n("cigüeña", ignore_diacritics=True)] == [0, 1, 0, 0, 1]
    assert [n("brown"), n("brown", ignore_case=True), n("own", whole_words=True), n("")] == [1, 2, 0, 0]
    strange = "Éclair ÅNGSTRÖM ǆ e\u0301 straße \u1e9b\u0323 plain"
    assert search.bare(strange) == words.limit(1).select(search.without_diacritics(F.lit(strange))).first()[0]
    stripped = words.withColumn("bare", F.lit("ciguena"))
    assert search.search(stripped, ["ciguena"], ignore_diacritics=True).count() == 3
    first = search.first_matches(search.search(words, ["brown"], ignore_case=True)).collect()
    assert [r.word_num for r in first] == [1]


def test_search_over_lines(spark):
    texts = spark.createDataFrame([(1, 0, "el recono-\ncimiento de\nla paz")], "doc_id long, page_num int, text string")
    found = search.search_pages(texts, ["reconocimiento", "de la", "La Paz", "nada"]).collect()
    assert sorted((r.needle, r.hits) for r in found) == [("de la", 1), ("reconocimiento", 1)]


def test_doubles_area_and_hyphens(spark):
    rows = [(1, 0, 0, 0, "a", 10.0, 0.0, 18.0, 10.0, 8.0, 10.0), (1, 0, 1, 0, "a", 10.5, 0.0, 18.5, 10.0, 8.1, 10.0), (1, 0, 2, 0, "a", 12.0, 0.0, 20.0, 10.0, 8.0, 10.0), (1, 0, 3, 0, "b", 10.5, 0.0, 18.5, 10.0, 8.0, 10.0)]
    words = spark.createDataFrame(rows, WORD)
    assert sorted(r.word_num for r in layout.without_doubles(words).collect()) == [0, 2, 3]
    assert sorted(r.word_num for r in layout.select_area(words, (14.2, 0, 15, 10)).collect()) == [1, 3]
    text = spark.range(1).select(*(layout.dehyphenated(F.lit("a-\nb­\nc"), how).alias(how) for how in ("none", "soft", "all"))).first()
    assert tuple(text) == ("a-\nb­\nc", "a-\nbc", "abc")


def test_visibility_and_permissions(spark):
    states = F.array(F.lit(True), F.lit(False))
    empty = F.array().cast("array<boolean>")
    row = spark.range(1).select(*(S.layer_visible(F.lit(p), states).alias(p) for p in ("AllOn", "AnyOn", "AnyOff", "AllOff")), S.layer_visible(F.lit("AllOn"), empty).alias("none"), *(c.alias(k) for k, c in S.permissions(F.lit(-4)).items())).first()
    assert tuple(row)[:5] == (False, True, True, False, True) and all(tuple(row)[5:])
