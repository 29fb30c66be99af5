"""Tables of pages and lines, made in the task that reads a document, so that its words are never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from paperloom.kernel import pages

from .pdf import opened, rows_of

#: Rows of texts, and of markup, that leave a task together.
TEXTS, MARKUP = 512, 64


def text_table(pdfs: DataFrame, text: Callable[[pages.Words], str] = pages.page_text) -> DataFrame:
    """(doc_id, page_num, text) of pages with words: by lines, or as ``raw_text``, ``physical_text`` or ``reading_text`` of ``kernel.pages`` puts them."""

    def kernel(r: dict) -> Iterator[tuple]:
        for page_num, _, words in pages.pages_of(opened(r)):
            if words:
                yield r["doc_id"], page_num, text(words)

    return rows_of(pdfs, "doc_id long, page_num int, text string", kernel, "doc_id", "bytes", keep=TEXTS)


def line_table(pdfs: DataFrame) -> DataFrame:
    """(doc_id, page_num, line, text, box): words of one baseline, in the order in which the line runs."""

    def kernel(r: dict) -> Iterator[tuple]:
        for page_num, _, words in pages.pages_of(opened(r)):
            for line, held in pages.lines(words):
                yield r["doc_id"], page_num, line, pages.said(held), *pages.box_of_words(held)

    return rows_of(pdfs, "doc_id long, page_num int, line int, text string, x_min double, y_min double, x_max double, y_max double", kernel, "doc_id", "bytes")


def markup_table(pdfs: DataFrame, made: Callable[[pages.Words, list[float]], str]) -> DataFrame:
    """(doc_id, page_num, xhtml) of all pages, by ``bbox_page`` or ``layout_page`` of ``kernel.pages``; documents without an id have empty ones."""

    def kernel(r: dict) -> Iterator[tuple]:
        doc = opened(r)
        for page_num, page, words in pages.pages_of(doc):
            yield r["doc_id"], page_num, made(words if r["doc_id"] is not None else [], pages.media_box(doc, page))

    return rows_of(pdfs, "doc_id long, page_num int, xhtml string", kernel, "doc_id", "bytes", keep=MARKUP)


def xml_table(pdfs: DataFrame, zoom: float = 1.5) -> DataFrame:
    """(doc_id, page_num, xml) of all pages; see ``kernel.pages.xml_pages``.  Documents without an id have empty ones."""

    def kernel(r: dict) -> Iterator[tuple]:
        doc = opened(r)
        held = [(n, words if r["doc_id"] is not None else [], pages.media_box(doc, page)) for n, page, words in pages.pages_of(doc)]
        for page_num, xml in pages.xml_pages(held, zoom):
            yield r["doc_id"], page_num, xml

    return rows_of(pdfs, "doc_id long, page_num int, xml string", kernel, "doc_id", "bytes", keep=MARKUP)


def report_table(pdfs: DataFrame) -> DataFrame:
    """A row for each page (level 1), block (3), line (4) and word (5), with boxes as left, top, width and height.

    Pages count from 1, blocks and lines from 0; confidence is 100 for words, -1 for the rest.  Numbers have two decimals.
    """
    near = pages.HUNDREDTHS

    def row(doc_id: int | None, level: int, page: int, block: int, line: int, word: int, box: tuple, text: str) -> tuple:
        left, top, right, bottom = box
        return doc_id, level, page + 1, block, line, word, near[left], near[top], near[right - left], near[bottom - top], -1, text

    def kernel(r: dict) -> Iterator[tuple]:
        doc, doc_id = opened(r), r["doc_id"]
        for n, page, words in pages.pages_of(doc):
            box = pages.media_box(doc, page)
            yield row(doc_id, 1, n, 0, 0, 0, (0.0, 0.0, box[2] - box[0], box[3] - box[1]), "###PAGE###")
            for block, of_block in pages.reading_order(words):
                yield row(doc_id, 3, n, block, 0, 0, pages.box_of_words([w for _, held in of_block for w in held]), "###FLOW###")
                for line, held in of_block:
                    yield row(doc_id, 4, n, block, line, 0, pages.box_of_words(held), "###LINE###")
                    for k, (_, text, x0, y0, x1, y1, *_) in enumerate(held):
                        yield doc_id, 5, n + 1, block, line, k, near[x0], near[y0], near[x1 - x0], near[y1 - y0], 100, text

    return rows_of(pdfs, "doc_id long, level int, page_num int, block_num int, line_num int, word_num int, left double, top double, width double, height double, conf int, text string", kernel, "doc_id", "bytes", keep=8_192)


def area_table(pdfs: DataFrame, inside: Callable[[tuple], bool]) -> DataFrame:
    """(doc_id, page_num, text): the words of a page that are ``inside``, in drawing order; pages without one have no row."""

    def kernel(r: dict) -> Iterator[tuple]:
        for page_num, _, words in pages.pages_of(opened(r)):
            if held := [w for w in words if inside(w)]:
                yield r["doc_id"], page_num, pages.said(held)

    return rows_of(pdfs, "doc_id long, page_num int, text string", kernel, "doc_id", "bytes", keep=TEXTS)


def document_table(pdfs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, width): a document's words in order and how wide they are together; those without words have no row."""

    def kernel(r: dict) -> Iterator[tuple]:
        words = [w for _, _, held in pages.pages_of(opened(r)) for w in held]
        if words:
            yield r["doc_id"], pages.said(words), len(words), sum([w[pages.X_MAX] - w[pages.X_MIN] for w in words])

    return rows_of(pdfs, "doc_id long, text string, n_words long, width double", kernel, "doc_id", "bytes", keep=TEXTS)


def part_table(parts: DataFrame) -> DataFrame:
    """(doc_id, page_num, n_words, first_word) of documents of one page each, named by the page they were; those without words have no row."""

    def kernel(r: dict) -> Iterator[tuple]:
        words = [w for _, _, held in pages.pages_of(opened(r)) for w in held]
        if words:
            yield r["doc_id"], r["page_num"], len(words), words[0][pages.TEXT]

    return rows_of(parts, "doc_id long, page_num int, n_words long, first_word string", kernel, "doc_id", "page_num", "bytes")


def found_words(pdfs: DataFrame, fold: Callable[[str], str], folded: list[str], bare: Callable[[str], str] = str) -> DataFrame:
    """(doc_id, page_num, word_num, text, bare) of the words that hold any of the needles when both are folded."""

    def kernel(r: dict) -> Iterator[tuple]:
        for page_num, _, words in pages.pages_of(opened(r)):
            every = fold("\n".join([w[pages.TEXT] for w in words]))
            if here := [n for n in folded if n in every]:
                each = every.split("\n")
                each = each if len(each) == len(words) else [fold(w[pages.TEXT]) for w in words]
                for i in sorted({i for n in here for i, text in enumerate(each) if n in text}):
                    yield r["doc_id"], page_num, i, words[i][pages.TEXT], bare(words[i][pages.TEXT])

    return rows_of(pdfs, "doc_id long, page_num int, word_num int, text string, bare string", kernel, "doc_id", "bytes")
