"""Tables of what a corpus's documents hold besides text; one task parses a document once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from paperloom.kernel import catalog
from paperloom.kernel.content import operations
from paperloom.kernel.document import Document

from .pdf import opened, rows_of


def _table(pdfs: DataFrame, schema: str, found: Callable[[Document], Iterable[dict]], keep: int = 4_096) -> DataFrame:
    """Rows of every document that opens; others have none."""

    def kernel(r: dict):
        doc = opened(r)
        if doc.ok:
            yield from ({"doc_id": r["doc_id"], **x} for x in found(doc))

    return rows_of(pdfs, f"doc_id long, {schema}", kernel, "doc_id", "bytes", keep=keep)


def font_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "page_num int, name string, type string, encoding string, embedded boolean, subset boolean, to_unicode boolean, object int", catalog.fonts)


def image_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "page_num int, num int, type string, width int, height int, color string, comp int, bpc int, enc string, interp boolean, object int, x_ppi double, y_ppi double, size long, ratio double", catalog.images)


def annotation_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "page_num int, annot int, subtype string, rect array<double>, contents string, flags int, action string, uri string, dest_page int, dest_kind string", catalog.annotations)


def destination_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "name string, page int, kind string, left double, top double, zoom double", catalog.destinations)


def attachment_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "file int, key string, name string, description string, mime string, size long, created string, modified string, checksum string, intact boolean, data binary", catalog.attachments, keep=16)


def field_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "field string, type string, flags int, value array<string>, widgets int", catalog.fields)


def layer_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "layer int, name string, visible boolean, object int", catalog.layers)


def label_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "base int, length int, style string, prefix string, first int", catalog.labels)


def page_range_table(pdfs: DataFrame) -> DataFrame:
    """Every page with the range of labels that holds it, or nulls."""

    def found(doc: Document):
        ranges = list(catalog.labels(doc))
        for i, _ in enumerate(doc.pages()):
            yield from ({"page_num": i, **x} for x in [x for x in ranges if x["base"] <= i < x["base"] + x["length"]] or [{}])

    return _table(pdfs, "page_num int, base int, length int, style string, prefix string, first int", found)


def structure_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "node_id int, parent_id int, depth int, type string, title string, lang string, alt string, actual_text string", catalog.structure)


def script_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "place string, name string, page_num int, code string", catalog.scripts)


def fact_table(pdfs: DataFrame) -> DataFrame:
    return _table(pdfs, "page_mode string, page_layout string, form string, tagged boolean, lang string, xmp string, permanent_id string, update_id string, linearized boolean, viewer map<string,string>", lambda doc: [catalog.facts(doc)])


def operation_table(pdfs: DataFrame) -> DataFrame:
    """How often each page's content uses each operator."""

    def found(doc: Document):
        for i, (_, page) in enumerate(doc.pages()):
            seen: dict[str, int] = {}
            for op, _ in operations(doc.contents(page)):
                seen[op] = seen.get(op, 0) + 1
            yield from ({"page_num": i, "operator": op, "n": n} for op, n in seen.items())

    return _table(pdfs, "page_num int, operator string, n long", found)
