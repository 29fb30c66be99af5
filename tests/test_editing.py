from paperloom.kernel import catalog
from paperloom.kernel.document import Document
from paperloom.kernel.editing import Editor, closure
from paperloom.kernel.syntax import Ref
from paperloom.kernel.writer import decorate, synthesize, synthesize_protected
from paperloom.sources import editing, pdf

INFO = {"Title": "t", "Subject": "en", "Author": "web"}


def edited(data: bytes, change) -> Document:
    edit = Editor(Document(data))
    change(edit)
    return Document(edit.bytes())


def files(doc: Document) -> dict:
    return {f["name"]: f["data"] for f in catalog.attachments(doc)}


def test_files_are_added_replaced_and_taken_away():
    def change(edit):
        edit.attach("a.txt", b"one")
        edit.attach("a.txt", b"two")
        edit.attach("ü.txt", b"")
        edit.detach("source.txt")
        edit.detach("unheard")

    doc = edited(decorate("some words", INFO, 1), change)
    assert files(doc) == {"a.txt": b"two", "ü.txt": b""} and not doc.rebuilt
    assert all(f["intact"] for f in catalog.attachments(doc))
    assert files(edited(synthesize("no files before", {}), lambda e: e.attach("b", b"x"))) == {"b": b"x"}
    assert list(catalog.destinations(doc))[0]["name"] == "page-0001"


def test_fields_are_filled_and_reset():
    doc = edited(decorate("some words", INFO, 1), lambda e: e.fill({"doc.lang": "żółw", "agree": "Yes", "unheard": "x"}))
    assert {f["field"]: f["value"] for f in catalog.fields(doc)} == {"doc.lang": ["żółw"], "doc.source": ["web"], "agree": ["Yes"]}
    again = edited(doc.data, lambda e: e.reset(["doc.lang", "agree"]))
    assert {f["field"]: (f["value"] or [""])[0] for f in catalog.fields(again)} == {"doc.lang": "", "doc.source": "web", "agree": "Off"}
    assert edited(synthesize("x", {}), lambda e: e.fill({"a": "b"})).data == synthesize("x", {})


def test_outlines_are_replaced():
    entries = [(3, "first", 0), (1, "below", None), (9, "deep", 99), (0, "last", 0)]
    doc = edited(synthesize("x", {}), lambda e: e.outline(entries))
    assert [(depth, title) for _, _, depth, _, title in doc.outline()] == [(0, "first"), (1, "below"), (2, "deep"), (0, "last")]
    assert list(edited(synthesize("x", {}), lambda e: e.outline([])).outline()) == []


def test_annotations_come_and_go():
    def change(edit):
        edit.annotate(0, "Text", [1, 2, 3, 4], "a note")
        edit.annotate(7, "Text", [1, 2, 3, 4], "no such page")
        edit.remove_annotations("Link")

    assert [a["subtype"] for a in catalog.annotations(edited(decorate("x", INFO, 1), change))] == ["Text"]
    assert list(catalog.annotations(edited(decorate("x", INFO, 1), lambda e: e.remove_annotations()))) == []


def test_what_cannot_be_edited_stays():
    for data in (b"", b"%PDF-1.7 nothing", synthesize_protected("x", {}, "AES-128", b"", b"o")):
        assert not Editor(Document(data)).open
    assert closure(Document(synthesize("x", {})), [Ref(6, 0), Ref(99, 0)]) == {6, 7}


def test_edits_of_tables(spark):
    made = spark.createDataFrame([(1, bytearray(decorate("x", INFO, 1))), (2, bytearray(b"broken")), (3, None)], "doc_id long, bytes binary")
    files_ = spark.createDataFrame([(1, "a", bytearray(b"1"), None, None), (1, "b", None, "text/plain", "d"), (9, "c", None, None, None)], "doc_id long, name string, data binary, mime string, description string")
    changed = editing.attach_files(made, files_)
    rows = {r["doc_id"]: r["bytes"] for r in changed.collect()}
    assert set(files(Document(bytes(rows[1])))) == {"a", "b", "source.txt"} and bytes(rows[2]) == b"broken"
    assert editing.closure_table(changed.limit(0)).collect() == []
    assert pdf.outline_table(editing.set_outline(made, spark.createDataFrame([(1, None)], "doc_id long, entries array<struct<depth int, title string, page int>>"))).count() == 1
