"""Edits of many documents; each is an incremental update made in the task that holds the document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.kernel.editing import Editor, closure

from .pdf import Making, making, opened, rows_of


def _edited(pdfs: DataFrame, change: Callable[[Editor, dict], None], *columns: str) -> DataFrame:
    """(doc_id, bytes); damaged and encrypted documents stay as they are."""
    before: Making | None = pdfs.__dict__.get("_making")
    earlier = before and before.make

    def make(r: dict) -> bytes:
        edit = Editor(opened(r | {"bytes": earlier(r)} if earlier else r))
        if edit.open:
            change(edit, r)
        return edit.bytes()

    secret = ["password"] if "password" in pdfs.columns and "password" not in columns else []
    return making(before.source if before else pdfs.select("doc_id", "bytes", *columns, *secret), make)


def _with(pdfs: DataFrame, values: DataFrame | None) -> DataFrame:
    """With the columns of ``values`` by doc_id; null where ``pdfs`` carries them itself."""
    return pdfs if values is None else pdfs.join(values, "doc_id", "left")


def attach_files(pdfs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``files`` (doc_id, name, data, mime, description) to their documents, in the order of names.

    Without them ``pdfs`` carries them as files array<struct<name string, data binary, mime string, description string>>.
    """
    of_doc = None if files is None else files.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "data", "mime", "description"))).alias("files"))

    def change(edit: Editor, r: dict) -> None:
        for f in r["files"] or []:
            edit.attach(f["name"] or "", f["data"] or b"", f["mime"] or "application/octet-stream", f["description"] or "")

    return _edited(_with(pdfs, of_doc), change, "files")


def detach_files(pdfs: DataFrame, names: list[str]) -> DataFrame:
    def change(edit: Editor, r: dict) -> None:
        for name in names:
            edit.detach(name)

    return _edited(pdfs, change)


def fill_fields(pdfs: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Sets the fields of ``values`` (doc_id, fields map<string,string>), or of the column that ``pdfs`` carries."""
    return _edited(_with(pdfs, values), lambda edit, r: edit.fill({k: v for k, v in dict(r["fields"] or {}).items() if v is not None}), "fields")


def reset_fields(pdfs: DataFrame, names: list[str] | None = None, exclude: bool = False) -> DataFrame:
    return _edited(pdfs, lambda edit, r: edit.reset(names, exclude))


def set_outline(pdfs: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """Replaces outlines by those of ``outlines`` (doc_id, entries array<struct<depth int, title string, page int>>), or of the column that ``pdfs`` carries; others stay."""

    def change(edit: Editor, r: dict) -> None:
        if r["entries"] is not None:
            edit.outline((x["depth"] or 0, x["title"] or "", x["page"]) for x in r["entries"])

    return _edited(_with(pdfs, outlines), change, "entries")


def replace_annotations(pdfs: DataFrame, removed: str | None, notes: DataFrame | None = None) -> DataFrame:
    """Without the annotations of a kind (null: all but widgets), and with ``notes`` (doc_id, notes array<struct<page int, subtype string, rect array<double>, contents string>>), or those of the column that ``pdfs`` carries."""

    def change(edit: Editor, r: dict) -> None:
        edit.remove_annotations(removed)
        for n in r["notes"] or []:
            edit.annotate(n["page"], n["subtype"], n["rect"], n["contents"] or "")

    return _edited(_with(pdfs, notes), change, "notes")


def closure_table(pdfs: DataFrame) -> DataFrame:
    """(doc_id, page_num, num): the objects that each page needs, with what it inherits."""

    def kernel(r: dict) -> Iterator[dict]:
        doc = opened(r)
        for i, (ref, page) in enumerate(doc.pages()):
            for num in sorted(closure(doc, [ref, *(v for k, v in page.items() if k not in ("Parent", "P"))])):
                yield {"doc_id": r["doc_id"], "page_num": i, "num": num}

    return rows_of(pdfs, "doc_id long, page_num int, num int", kernel, "doc_id", "bytes")
