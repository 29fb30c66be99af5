"""A page's words as lines, texts and markup, in the task that read the page.

Words are the tuples of ``content.placed_words``; what is done here for one page is what
``operators`` do for tables of words of any origin.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby, pairwise
from operator import itemgetter, lt

import numpy as np

from .content import Interpreter, placed_words
from .document import Document

# Parts of the font size.
#: A baseline this far off begins a line; a gap this wide is a space.
LINE_STEP, WORD_GAP = 0.5, 0.2
#: White space this wide parts columns; this high, blocks of one column.
COLUMN_GAP, BLOCK_GAP = 0.7, 1.5
#: Most ends of line between two rows of a page.
MOST_ENDS = 5
#: Points by which a word may stick out of its link.
LINK_SLACK = 2.0
#: Entities of the layout boxes, and those of positioned lines.
XHTML = (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))
XML = (("&", "&amp;"), ('"', "&#34;"), ("<", "&lt;"), (">", "&gt;"))

LINE, TEXT, X_MIN, Y_MIN, X_MAX, Y_MAX, BASE, SIZE, FONT, TURN = range(10)
Words = list[tuple]


def pages_of(doc: Document) -> Iterator[tuple[int, dict, Words]]:
    """(number, page, words) of every page."""
    run = Interpreter(doc)
    for i, (_, page) in enumerate(doc.pages()):
        yield i, page, list(placed_words(run.spans(page)))


def media_box(doc: Document, page: dict) -> list[float]:
    return [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]


def box_of_words(words: Words) -> tuple[float, float, float, float]:
    _, _, left, top, right, bottom, *_ = zip(*words, strict=True)
    return min(left), min(top), max(right), max(bottom)


def _along(w: tuple) -> float:
    turn = w[TURN]
    return w[X_MIN] if not turn else w[Y_MIN] if turn == 1 else -w[X_MAX] if turn == 2 else -w[Y_MAX]


def lines(words: Words) -> Iterator[tuple[int, Words]]:
    """(line, words): those of one baseline, in the order in which the line runs."""
    for line, held in groupby(words, itemgetter(LINE)):
        yield line, sorted(held, key=_along)


def said(words: Words) -> str:
    return " ".join([w[TEXT] for w in words])


def page_text(words: Words) -> str:
    return "\n".join([said(held) for _, held in lines(words)])


def raw_text(words: Words) -> str:
    """As the page draws them: a new line where the baseline moves, a space where there is a gap."""
    out, base, end, size = [], None, 0.0, 0.0
    for w in words:
        if base is not None:
            if abs(w[BASE] - base) >= LINE_STEP * size:
                out.append("\n")
            elif w[X_MIN] - end > WORD_GAP * size:
                out.append(" ")
        out.append(w[TEXT])
        base, end, size = w[BASE], w[X_MAX], w[SIZE]
    return "".join(out)


def _whole(x: float) -> int:
    """The nearest whole number; halves away from zero."""
    low = math.floor(abs(x))
    return int(math.copysign(low + (abs(x) - low >= 0.5), x))


def physical_text(words: Words) -> str:
    """At the columns of characters that words have on the page; rows further apart have more ends of line between them."""
    letters = sum([len(w[TEXT]) for w in words])
    width = sum([w[X_MAX] - w[X_MIN] for w in words]) / letters if letters else 0.0
    left = min([w[X_MIN] for w in words], default=0.0)
    out, row, before = [], [], None

    def close() -> None:
        nonlocal before
        base, size = min([w[BASE] for w in row]), max([w[SIZE] for w in row])
        if before is not None:
            out.append("\n" * max(1, min(MOST_ENDS, math.floor((base - before) / size) if size else 1)))
        before, length, end, parts = base, 0, 1e9, []
        columns = [int(v) + (v - int(v) >= 0.5) for v in [(w[X_MIN] - left) / width for w in row]] if width > 0 else [_whole((w[X_MIN] - left) / width) if width else 0 for w in row]
        for k in sorted(range(len(row)), key=lambda k: (columns[k], row[k][X_MIN], row[k][-1])):
            w = row[k]
            blanks = max(columns[k] - length, 1 if w[X_MIN] - end > WORD_GAP * w[SIZE] else 0)
            parts.append(" " * blanks + w[TEXT])
            length, end = length + len(parts[-1]), w[X_MAX]
        out.append("".join(parts))

    above, down = None, range(len(words))
    bases = [w[BASE] for w in words]
    for k in down if all(a <= b for a, b in zip(bases, bases[1:], strict=False)) else sorted(down, key=bases.__getitem__):
        w = words[k]
        if above is not None and w[BASE] - above >= LINE_STEP * w[SIZE]:
            close()
            row = []
        row.append((*w, k))
        above = w[BASE]
    if row:
        close()
    return "".join(out)


def in_link(w: tuple, box: tuple[float, float, float, float]) -> bool:
    """Whether a word lies in a box from the top left, out of which it may stick a little."""
    return box[0] < w[X_MIN] + LINK_SLACK and w[X_MAX] - LINK_SLACK < box[2] and box[1] < w[Y_MIN] + LINK_SLACK and w[Y_MAX] - LINK_SLACK < box[3]


def _parts(low: np.ndarray, high: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions parted where no interval reaches over more than ``gap``, in order."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    return np.split(order, np.flatnonzero(low[order][1:] - reach[:-1] > gap) + 1)


def blocks(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Blocks of a page in reading order, by cutting at white space: across where columns lie side by side, else down."""
    found, left = [], [np.arange(len(x0))]
    while left:
        at = left.pop()
        font = float(np.median(size[at])) if len(at) else 1.0
        parts = _parts(x0[at], x1[at], COLUMN_GAP * font)
        if len(parts) > 1 and len(_parts(y0[at], y1[at], 0.0)) == 1 and len(np.unique(np.round(y1[at], 1))) == 1:
            parts = [np.arange(len(at))]  # words of one line are no columns
        if len(parts) == 1:
            parts = _parts(y0[at], y1[at], BLOCK_GAP * font)
        if len(parts) == 1:
            found.append(at)
        else:
            left.extend(at[p] for p in reversed(parts))
    return found


def in_blocks(base: np.ndarray, size: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, line in the block, place on the page) of the words of a page."""
    block, line, place = (np.zeros(len(base), np.int32) for _ in range(3))
    n = 0
    for k, part in enumerate(blocks(x0, x1, y0, y1, size)):
        down = part[np.argsort(base[part], kind="stable")]
        rows = np.concatenate([[0], np.cumsum(np.diff(base[down]) >= LINE_STEP * size[down][1:])])
        order = np.lexsort((x0[down], rows))
        block[down], line[down], place[down[order]] = k, rows, n + np.arange(len(down))
        n += len(down)
    return block, line, place


def _one_block(words: Words) -> list[Words] | None:
    """The lines of a page that is sure to be one block with its lines in order, as most are; null where it takes a closer look."""
    held = [list(w) for _, w in groupby(words, itemgetter(LINE))]
    size = words[0][SIZE]
    before, bottom, left, last, widest = -math.inf, math.inf, math.inf, -math.inf, held[0]
    for of_line in held:
        _, _, x0, y0, x1, y1, base, sizes, _, turns = zip(*of_line, strict=True)
        if any(turns) or base.count(base[0]) < len(base) or sizes.count(size) < len(sizes) or not all(map(lt, x0, x0[1:])):
            return None
        if not base[0] - before >= LINE_STEP * size or y0[0] - bottom > BLOCK_GAP * size:
            return None
        before, bottom, left, last = base[0], y1[0], min(left, x0[0]), max(last, x0[-1])
        if x1[-1] > widest[-1][X_MAX]:
            widest = of_line
    if widest[0][X_MIN] > left or last - widest[-1][X_MAX] > COLUMN_GAP * size or any(b[X_MIN] - a[X_MAX] > COLUMN_GAP * size for a, b in pairwise(widest)):
        return None
    return held


def reading_order(words: Words) -> list[tuple[int, list[tuple[int, Words]]]]:
    """Blocks of a page in reading order, each with its lines, each with its words."""
    if not words:
        return []
    if (plain := _one_block(words)) is not None:
        return [(0, list(enumerate(plain)))]
    _, _, x0, y0, x1, y1, base, size, _, _ = zip(*words, strict=True)
    block, line, place = in_blocks(*map(np.array, (base, size, x0, x1, y0, y1)))
    order = np.argsort(place)
    keyed = zip(block[order].tolist(), line[order].tolist(), order.tolist(), strict=True)
    return [(b, [(k, [words[x[2]] for x in held]) for k, held in groupby(of_block, itemgetter(1))]) for b, of_block in groupby(keyed, itemgetter(0))]


def reading_text(words: Words) -> str:
    """A line for each line of a block, an empty one between blocks."""
    return "\n\n".join(["\n".join([said(held) for _, held in of_block]) for _, of_block in reading_order(words)])


_special = re.compile("[&'\"<>]").search


def escaped(text: str, entities: tuple[tuple[str, str], ...] = XHTML) -> str:
    for raw, entity in entities:
        if raw in text:
            text = text.replace(raw, entity)
    return text


class _Known(dict):
    """What is made of a number; those of a page's grid come again and again."""

    def __init__(self, make: Callable[[float], str | float]):
        super().__init__()
        self.make = make

    def __missing__(self, x: float) -> str | float:
        if len(self) > 50_000:
            self.clear()
        found = self[x] = self.make(x)
        return found


def _hundredths(x: float) -> float:
    if not abs(x) < 1e12:
        return x
    low = math.floor(abs(x) * 100)
    rest = abs(x) * 100 - low
    if abs(rest - 0.5) < 1e-3:
        return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)) or 0.0
    return math.copysign((low + (rest > 0.5)) / 100, x) or 0.0


#: Six decimals of a number; two decimals, halves of the number as it is written away from zero.
SPELLED, HUNDREDTHS = _Known(lambda x: "%.6f" % x), _Known(_hundredths)


def _box(words: Words) -> str:
    return 'xMin="%s" yMin="%s" xMax="%s" yMax="%s"' % tuple([SPELLED[v] for v in box_of_words(words)])


def _escaped_words(words: Words) -> list[str]:
    """The words' texts with entities, looked through together."""
    texts = [w[TEXT] for w in words]
    return [escaped(t) for t in texts] if _special("\n".join(texts)) else texts


def _page_element(box: list[float], body: str) -> str:
    return f'  <page width="{SPELLED[box[2] - box[0]]}" height="{SPELLED[box[3] - box[1]]}">\n{body}  </page>\n'


def _word_elements(words: Words, indent: str) -> str:
    s = SPELLED
    return "".join([f'{indent}<word xMin="{s[w[2]]}" yMin="{s[w[3]]}" xMax="{s[w[4]]}" yMax="{s[w[5]]}">{t}</word>\n' for w, t in zip(words, _escaped_words(words), strict=True)])


def bbox_page(words: Words, box: list[float]) -> str:
    """A page element with an element for each word."""
    return _page_element(box, _word_elements(words, "    "))


def layout_page(words: Words, box: list[float]) -> str:
    """A page of flows, blocks, lines and words, each with its box; every block is a flow of its own."""
    out = []
    for _, of_block in reading_order(words):
        out.append(f"    <flow>\n      <block {_box([w for _, held in of_block for w in held])}>\n")
        for _, held in of_block:
            out.append(f"        <line {_box(held)}>\n{_word_elements(held, ' ' * 10)}        </line>\n")
        out.append("      </block>\n    </flow>\n")
    return _page_element(box, "".join(out))


def xml_pages(pages: list[tuple[int, Words, list[float]]], zoom: float) -> Iterator[tuple[int, str]]:
    """(page, xml) of a document's pages: fonts where they are first used, then each line with its box in whole points times ``zoom``."""
    first: dict[tuple[str, float], tuple[int, int]] = {}
    for number, words, _ in pages:
        for k, w in enumerate(words):
            first.setdefault((w[FONT], w[SIZE]), (number, k))
    ids = {f: i for i, f in enumerate(sorted(first, key=lambda f: (first[f], *f)))}
    whole = lambda x: math.floor(x + 0.5)
    for number, words, box in pages:
        out = [f'<page number="{number + 1}" position="absolute" top="0" left="0" height="{int((box[3] - box[1]) * zoom)}" width="{int((box[2] - box[0]) * zoom)}">\n']
        for (font, size), i in ids.items():
            if first[font, size][0] == number:
                family = "Times" if font == "" else re.sub("^[A-Z]{6}\\+", "", font)
                out.append(f'\t<fontspec id="{i}" size="{whole(size * zoom)}" family="{escaped(family, XML)}" color="#000000"/>\n')
        found = []
        for line, held in groupby(words, itemgetter(LINE)):
            held = list(held)
            edges = box_of_words(held)
            left, top, right, bottom = (v * zoom for v in edges)
            text = escaped(said(sorted(held, key=itemgetter(X_MIN))), XML)
            found.append((edges[1], edges[0], line, f'<text top="{whole(top)}" left="{whole(left)}" width="{whole(right - left)}" height="{whole(bottom - top)}" font="{ids[held[0][FONT], held[0][SIZE]]}">{text}</text>\n'))
        found.sort(key=itemgetter(0, 1, 2))
        out += [x[3] for x in found]
        yield number, "".join(out) + "</page>\n"
