from paperloom.kernel import fonts, matching, variants
from paperloom.kernel.content import Interpreter, words
from paperloom.kernel.document import Document
from paperloom.kernel.graphics import painted
from paperloom.kernel.layers import Layers
from paperloom.kernel.syntax import Name, Ref, Stream
from paperloom.kernel.writer import file_of, synthesize


def document(body: bytes, font: dict | None = None, resources: dict | None = None, catalog: dict | None = None, more: dict | None = None) -> Document:
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (catalog or {}), 2: {"Type": Name("Pages"), "Count": 1, "Kids": [Ref(3, 0)]}, 3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "MediaBox": [0, 0, 600, 800], "Resources": {"Font": {"F": font or {}}} | (resources or {})}, 4: Stream({}, body)}
    return Document(file_of(objects | (more or {}), 1))


def read(doc: Document) -> list:
    return list(words(Interpreter(doc).glyphs(next(doc.pages())[1])))


def test_encodings_and_differences():
    mac = {"Subtype": Name("Type1"), "Encoding": Name("MacRomanEncoding")}
    assert read(document(b"BT /F 10 Tf (caf\x8e) Tj ET", mac))[0].text == "café"
    own = {"Subtype": Name("Type1"), "Encoding": {"Differences": [1, Name("fi"), Name("Aacute"), 65, Name("uni20AC"), Name("f_l"), Name("unheard")]}}
    assert read(document(b"BT /F 10 Tf (\x01\x02ABCD) Tj ET", own))[0].text == "ﬁÁ€fl�D"
    assert read(document(b"BT /F 10 Tf ('\xe1) Tj ET", {"Subtype": Name("Type1")}))[0].text == "’Æ"
    assert read(document(b"BT /F 10 Tf ('\xe1) Tj ET", {"Subtype": Name("TrueType")}))[0].text == "'á"


def test_standard_and_missing_widths():
    wide = read(document(b"BT /F 10 Tf (wide) Tj ET", {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}))[0]
    assert round(wide.x_max - wide.x_min, 2) == 20.56
    bold = read(document(b"BT /F 10 Tf (\xe9) Tj ET", {"Subtype": Name("TrueType"), "BaseFont": Name("ABCDEF+TimesNewRoman,Bold")}))[0]
    assert bold.text == "é" and round(bold.x_max - bold.x_min, 2) == 4.44
    some = {"Subtype": Name("Type1"), "FirstChar": 65, "Widths": [500], "FontDescriptor": {"MissingWidth": 250}}
    assert round(read(document(b"BT /F 10 Tf (AB) Tj ET", some))[0].x_max, 2) == 7.5
    assert fonts.face("Courier") is None


def test_composite_fonts():
    cmap = Stream({}, b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> <00660069> endbfrange 1 beginbfrange <0003> <0004> [<0078> <d83dde00>] endbfrange")
    inner = {"Subtype": Name("CIDFontType2"), "DW": 500, "W": [1, [250, 750], 3, 4, 1000]}
    font = {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(5, 0), "DescendantFonts": [inner]}
    found = read(document(b"BT /F 10 Tf <00010002000300040005> Tj ET", font, more={5: cmap}))[0]
    assert found.text == "fifjx😀�" and round(found.x_max, 2) == 35.0
    codes = fonts.Codes(b"2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 begincidrange <20> <7e> 1 endcidrange 1 begincidchar <8001> 200 endcidchar")
    assert [codes.number(c) for c in codes.cut(b"\x21\x80\x01\x20")] == [2, 200, 1]


def test_texts_beyond_winansi_survive_the_writer():
    assert [w.text for w in read(Document(synthesize("żółw 東京 😀 \ud800", {})))][:3] == ["żółw", "東京", "😀"]


def test_turned_lines_are_words():
    for quarter, first in enumerate([(72, 64), (718, 72), (690, 718), (64, 690)]):
        found = read(Document(variants.turned("words that turn", quarter)))
        assert [(w.text, w.turn) for w in found] == [("words", quarter), ("that", quarter), ("turn", quarter)]
        assert (round(found[0].x_min), round(found[0].y_min)) == first


def test_marks_and_layers():
    text = " ".join(f"w{i}" for i in range(24))
    assert [w.text for w in read(Document(variants.marked(text, 1)))] == [*(f"w{i}" for i in range(8)), "line1"]
    assert len(read(Document(variants.marked(text, 0)))) == 17
    groups = {10: {"Type": Name("OCG")}, 11: {"Type": Name("OCG")}}
    doc = document(b"", catalog={"OCProperties": {"OCGs": [Ref(10, 0), Ref(11, 0)], "D": {"OFF": [Ref(11, 0)]}}}, more=groups)
    layers, both = Layers(doc), [Ref(10, 0), Ref(11, 0)]
    said = {p: layers.shown({"Type": Name("OCMD"), "OCGs": both, "P": Name(p)}) for p in ("AnyOn", "AllOn", "AnyOff", "AllOff")}
    assert said == {"AnyOn": True, "AllOn": False, "AnyOff": True, "AllOff": False}
    assert layers.shown({"Type": Name("OCMD"), "VE": [Name("And"), both[0], [Name("Not"), both[1]]]})
    assert layers.shown(None) and layers.shown({"Type": Name("OCMD"), "OCGs": []})


def test_paths_states_and_damage():
    rows = list(painted(doc := document(b"q 2 w 10 10 5 5 re S Q 0 0 m 10 20 l S /G gs 1 1 1 1 re f (x) w 0 0 9 9 re f"), next(doc.pages())[1]))
    assert [(r["op"], r["line_width"], r["box"]) for r in rows] == [("S", 2.0, [10, 785, 15, 790]), ("S", 1.0, [0, 780, 10, 800]), ("f", 1.0, [1, 798, 2, 799])]
    assert list(painted(doc := document(b"Q Q EMC h S n 1 re"), next(doc.pages())[1])) == []
    doc = Document(variants.drawn(1))
    ops = [r["op"] for r in painted(doc, next(doc.pages())[1])]
    assert ops == "S B b f* B* b* n f F s n sh DP MP ? Do ID f".split()


def test_matches_go_on_in_the_next_line():
    doc = Document(synthesize("a b c d e f g wonder- ful Éclair", {}))
    found = list(matching.matches(doc, matching.patterns(["wonderful", "eclair", "", "b c"], True, True, True), True, True))
    assert [(r["needle"], r["hit"], r["part"], r["text"]) for r in found] == [("wonderful", 0, 0, "wonder-"), ("wonderful", 0, 1, "ful"), ("eclair", 0, 0, "Éclair"), ("b c", 0, 0, "b c")]
    assert found[1]["x_min"] == 72 and found[1]["y_min"] == 76


def test_markup_of_pages(spark):
    from paperloom.operators import layout, reading, sinks
    from paperloom.sources import content, pdf

    docs = spark.createDataFrame([(1, "a <b> & 'c' \"d\"", "en", None), (2, "", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    made = pdf.synthesized(docs)
    words, pages = pdf.word_table(made), pdf.page_table(made)
    xml = {r["doc_id"]: r["xml"] for r in sinks.xml_pages(words, pages).collect()}
    assert xml[1].split("\n")[1:3] == ['\t<fontspec id="0" size="15" family="Courier" color="#000000"/>', '<text top="96" left="108" width="135" height="15" font="0">a &lt;b&gt; &amp; \'c\' &#34;d&#34;</text>']
    assert xml[2].count("\n") == 2
    boxes = {r["doc_id"]: r["xhtml"] for r in sinks.layout_pages(reading.in_reading_order(words), pages).collect()}
    assert "&apos;c&apos;</word>" in boxes[1] and boxes[1].count("<flow>") == 1 and "<flow>" not in boxes[2]
    assert "&apos;c&apos;" in next(r["xhtml"] for r in layout.bbox_pages(words, pages).collect() if r["doc_id"] == 1)
    assert content.paint_table(made).collect() == []
    assert [r["hit"] for r in content.match_table(made, ["a <b>", "", "zzz"]).collect()] == [0]
    assert content.match_table(made.limit(0), ["a"]).collect() == []
