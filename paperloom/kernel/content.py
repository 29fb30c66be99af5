"""Text of a page: content-stream operators to glyphs, glyphs to words (ISO 32000-1, 9)."""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import Any, NamedTuple

from .document import Document
from .document import text as text_string
from .fonts import Font
from .layers import Layers
from .syntax import BLANK, Command, End, Parser, Stream

#: Heights of text above and below the baseline, in ems, where a font gives none; gap that ends a word.
ASCENT, DESCENT, GAP = 0.8, -0.2, 0.1
MAX_FORMS = 20


#: A plain string that is shown, on the next line or not.
_shown = re.compile(BLANK + rb"(T\*(?=[\0\t\n\f\r (%])" + BLANK + rb")?\(([^()\\\r]*+)\)" + BLANK + rb"Tj(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)").match


class Glyph(NamedTuple):
    """Placed as if its line ran to the right: ``turn`` quarter turns (clockwise) bring it to where it is."""

    text: str
    x: float
    y: float
    width: float
    size: float
    font: str
    turn: int = 0


class Span(NamedTuple):
    """Glyphs of one shown string: a character each, one after another along a baseline without anything between them.

    ``steps`` are the advances from the first glyph to each and to the end, or the one advance of all glyphs,
    in units of ``unit`` points; ``widths`` their widths in points, likewise.
    """

    text: str
    x: float
    y: float
    unit: float
    steps: list[float] | float
    widths: list[float] | float
    size: float
    font: str
    turn: int

    def edge(self, k: int) -> float:
        """Where the glyph with number ``k`` begins."""
        return self.x + (self.steps[k] if isinstance(self.steps, list) else k * self.steps) * self.unit

    def width(self, k: int) -> float:
        return self.widths[k] if isinstance(self.widths, list) else self.widths

    def glyph(self, k: int) -> Glyph:
        return Glyph(self.text[k], self.edge(k), self.y, self.width(k), self.size, self.font, self.turn)


class Word(NamedTuple):
    line: int
    text: str
    x_min: float
    y_min: float
    x_max: float
    y_max: float
    base: float
    size: float
    font: str
    turn: int = 0


class Mark:
    """An open marked-content sequence: hidden by a layer, or with a text that stands for its glyphs."""

    def __init__(self, hidden: bool, actual: str | None):
        self.hidden, self.actual, self.held = hidden, actual, []


def turned(x: float, y: float, turn: int) -> tuple[float, float]:
    """A point of the page, in axes turned so that lines of that turn run to the right and follow downwards."""
    return ((x, y), (y, -x), (-x, -y), (-y, x))[turn]


def box_of(left: float, top: float, right: float, bottom: float, turn: int) -> tuple[float, float, float, float]:
    """A box in turned axes, on the page."""
    return ((left, top, right, bottom), (-bottom, left, -top, right), (-right, -bottom, -left, -top), (top, -right, bottom, -left))[turn]


def multiply(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) of a content stream; inline images are passed over."""
    p, held = Parser(data), []
    while True:
        while not held and (m := _shown(data, p.lexer.at)):  # most of a page's text
            p.lexer.at = m.end()
            if m[1]:
                yield "T*", []
            yield "Tj", [m[2]]
        try:
            x = p.object()
        except End:
            return
        if not isinstance(x, Command):
            held.append(x)
        else:
            if x == "ID":
                end = re.compile(rb"\sEI(?=\s|$)").search(data, p.lexer.at)
                p.lexer.at = end.end() if end else len(data)
            yield str(x), held
            held = []


#: Operators after which shown text may look otherwise.
UNSTYLED = frozenset(("q", "Q", "cm", "BT", "Tf", "Tc", "Tw", "Ts", "Tr", "Tz", "Tm", '"'))


class Interpreter:
    """Runs the operators that place text; others pass."""

    def __init__(self, doc: Document):
        self.doc, self.fonts, self.layers = doc, {}, Layers(doc)

    def glyphs(self, page: dict) -> Iterator[Glyph]:
        """In device space: points from the top left of the page's media box."""
        for x in self.spans(page):
            if isinstance(x, Span):
                yield from map(x.glyph, range(len(x.text)))
            else:
                yield x

    def spans(self, page: dict) -> Iterator[Glyph | Span]:
        """The same, where plain strings stay whole."""
        box = [float(v) for v in (self.doc.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        yield from self._run(self.doc.contents(page), self.doc.get(page.get("Resources")) or {}, (1.0, 0.0, 0.0, -1.0, -box[0], box[3]), 0)

    def _font(self, resources: dict, name: Any) -> Font:
        ref = (self.doc.get(resources.get("Font")) or {}).get(name)
        key = ref if isinstance(ref, tuple) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, self.doc.get(ref))
        return self.fonts[key]

    def _mark(self, op: str, a: list, resources: dict) -> Mark:
        about = a[-1] if op == "BDC" and a else None
        if isinstance(about, str):
            about = (self.doc.get(resources.get("Properties")) or {}).get(about)
        hidden = op == "BDC" and len(a) > 1 and a[-2] == "OC" and not self.layers.shown(about)
        about = self.doc.get(about)
        said = self.doc.get(about.get("ActualText")) if isinstance(about, dict) else None
        return Mark(hidden, text_string(said) if isinstance(said, bytes) else None)

    def _run(self, data: bytes, resources: dict, ctm: tuple, depth: int) -> Iterator[Glyph | Span]:
        one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        state = {"ctm": ctm, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
        stack, matrix, line = [], one, one
        marks: list[Mark] = []

        def placed(glyphs: Iterator[Glyph | Span]) -> Iterator[Glyph | Span]:
            """Glyphs that no layer hides; those that a text stands for wait for the end of their mark."""
            for g in glyphs:
                if not any(m.hidden for m in marks):
                    if outer := next((m for m in marks if m.actual is not None), None):
                        outer.held.append(g)
                    else:
                        yield g

        style: tuple | None = None  # of the font and the matrices less where they begin

        def styled() -> tuple:
            font, size, scale = state["font"], state["size"], state["scale"]
            m = multiply(matrix, state["ctm"])
            turn = (0 if m[0] >= 0 else 2) if abs(m[0]) >= abs(m[1]) else 1 if m[1] > 0 else 3
            em, height = size * scale * abs(m[turn % 2]), size * (abs(m[2]) if turn % 2 else abs(m[3]) or abs(m[1]))
            char, word = state["char"] * scale, state["word"] * scale
            dx, dy = turned(m[0], m[1], turn)
            plain = None
            if not (font.wide or char or word or dy) and size * scale > 0 and dx == abs(m[turn % 2]) and height > 0.01 and (table := font.plain())[4]:
                step = None if table[3] is None else table[3] * size * scale
                plain = (*table[:2], ([w * size * scale for w in table[2]], [w * em for w in table[2]]), step if step is not None and step.is_integer() and step < 1 << 20 else None, table[3] is not None and table[3] * em)
            return font, turn, em, height, char, word, dx, dy, state["rise"] * m[2], state["rise"] * m[3], plain

        def show(raw: Any) -> Iterable[Glyph | Span]:
            nonlocal matrix, style
            if not isinstance(raw, bytes) or state["font"] is None:
                return ()
            if style is None:
                style = styled()
            font, turn, em, height, _, _, dx, _, up_x, up_y, plain = style
            ctm, (m0, m1, m2, m3, m4, m5) = state["ctm"], matrix
            x, y = m4 * ctm[0] + m5 * ctm[2] + ctm[4] + up_x, m4 * ctm[1] + m5 * ctm[3] + ctm[5] + up_y
            if turn:
                x, y = turned(x, y, turn)
            if plain and raw:
                table, single, widths, step, one = plain
                if not raw.translate(None, single):
                    if step is not None:  # sums of whole numbers are exact
                        steps, each, along = step, one, len(raw) * step
                    else:
                        steps = list(accumulate(map(widths[0].__getitem__, raw), initial=0.0))
                        each, along = list(map(widths[1].__getitem__, raw)), steps[-1]
                    matrix = (m0, m1, m2, m3, along * m0 + m4, along * m1 + m5)
                    return (Span(charmap_decode(raw, "strict", table)[0], x, y, dx, steps, each, height, font.name, turn),)
            return one_by_one(raw, x, y)

        def one_by_one(raw: bytes, x: float, y: float) -> Iterator[Glyph]:
            nonlocal matrix
            font, turn, em, height, char, word, dx, dy, _, _, _ = style
            size, scale, name, along = state["size"], state["scale"], font.name, 0.0
            for code, said, width in font.codes(raw):
                yield Glyph(said, x + along * dx, y + along * dy, width * em, height, name, turn)
                along += width * size * scale + char
                if code == 32:
                    along += word
            matrix = multiply((1, 0, 0, 1, along, 0), matrix)

        def move(x: float, y: float) -> None:
            nonlocal matrix, line
            a, b, c, d, e, f = line
            line = matrix = (a, b, c, d, x * a + y * c + e, x * b + y * d + f)

        for op, a in operations(data):
            try:
                if op == "Tj":
                    yield from placed(show(a[-1])) if marks else show(a[-1])
                    continue
                if op == "T*":
                    move(0, -state["lead"])
                    continue
                if op in UNSTYLED:
                    style = None
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q" and stack:
                    state = stack.pop()
                elif op == "cm":
                    state["ctm"] = multiply(tuple(map(float, a[-6:])), state["ctm"])
                elif op == "BT":
                    matrix = line = one
                elif op == "Tf":
                    state["font"], state["size"] = self._font(resources, a[-2]), float(a[-1])
                elif op in ("Tc", "Tw", "TL", "Ts", "Tr", "Tz"):
                    state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tr": "mode", "Tz": "scale"}[op]] = a[-1] / (100 if op == "Tz" else 1)
                elif op == "Td":
                    move(*map(float, a[-2:]))
                elif op == "TD":
                    state["lead"] = -float(a[-1])
                    move(*map(float, a[-2:]))
                elif op == "Tm":
                    line = matrix = tuple(map(float, a[-6:]))
                elif op in ("'", '"'):
                    if op == '"':
                        state["word"], state["char"] = float(a[-3]), float(a[-2])
                    move(0, -state["lead"])
                    yield from placed(show(a[-1])) if marks else show(a[-1])
                elif op == "TJ":
                    for x in a[-1]:
                        if isinstance(x, (int, float)):
                            matrix = multiply((1, 0, 0, 1, -x / 1000 * state["size"] * state["scale"], 0), matrix)
                        else:
                            yield from placed(show(x)) if marks else show(x)
                elif op in ("BMC", "BDC"):
                    marks.append(self._mark(op, a, resources))
                elif op == "EMC" and marks:
                    last = marks.pop()
                    if last.held:
                        yield from spread_over(last.actual, last.held)
                elif op == "Do" and depth < MAX_FORMS:
                    form = self.doc.get((self.doc.get(resources.get("XObject")) or {}).get(a[-1]))
                    if isinstance(form, Stream) and form.dict.get("Subtype") == "Form" and self.layers.shown(form.dict.get("OC")):
                        inner = tuple(float(v) for v in self.doc.get(form.dict.get("Matrix")) or one)
                        yield from placed(self._run(self.doc.decoded(form) or b"", self.doc.get(form.dict.get("Resources")) or resources, multiply(inner, state["ctm"]), depth + 1))
            except (IndexError, TypeError, ValueError):
                return  # too few or wrong operands end the stream


def spread_over(said: str, held: list[Glyph | Span]) -> Iterator[Glyph]:
    """The text in place of the glyphs, its characters spread evenly over their box."""
    held = [g for x in held for g in ((x.glyph(0), x.glyph(len(x.text) - 1)) if isinstance(x, Span) else (x,))]
    first, last = held[0], held[-1]
    each = (max(g.x + g.width for g in held) - first.x) / max(len(said), 1) if last.y == first.y else first.width
    for i, c in enumerate(said):
        yield first._replace(text=c, x=first.x + i * each, width=each)


def runs(glyphs: Iterator[Glyph]) -> Iterator[tuple[int, list[Glyph]]]:
    """(line, glyphs): glyphs on one baseline without white space or a gap, in content order."""
    held: list[Glyph] = []
    line, base, end, turn = -1, None, None, 0
    for g in glyphs:
        if base is None or g.turn != turn or abs(g.y - base) > 0.5 * max(g.size, 0.1):
            if held:
                yield line, held
            line, base, end, turn, held = line + 1, g.y, None, g.turn, []
        if g.text.isspace():
            if held:
                yield line, held
            held = []
        else:
            if held and (abs(g.x - end) > GAP * g.size or g.font != held[-1].font or g.size != held[-1].size):
                yield line, held
                held = []
            held.append(g)
        end = g.x + g.width
    if held:
        yield line, held


def words(glyphs: Iterator[Glyph | Span]) -> Iterator[Word]:
    """The runs as words, with their boxes on the page; ``base`` is where the baseline crosses the page's other axis."""
    return map(Word._make, placed_words(glyphs))


def placed_words(glyphs: Iterable[Glyph | Span]) -> list[tuple]:
    """The same as plain tuples.  Strings that are whole are cut at their white space, without a look at each glyph."""
    out: list[tuple] = []
    put = out.append
    texts: list[str] = []  # the word at hand: its parts, first glyph, and the end, font and size of its last glyph
    whole: tuple | None = None  # that word, as long as it has one part that came at once
    a: tuple = ()
    z, last_font, last_size = 0.0, "", 0.0
    line, base, end, turn = -1, None, 0.0, 0

    def made() -> tuple:
        if whole:
            return whole
        x, y, size, font, way = a
        return (line, "".join(texts), *box_of(x, y - ASCENT * size, z, y - DESCENT * size, way), -y if way in (1, 2) else y, size, font, way)

    for g in glyphs:
        if type(g) is not Span:
            text, x, y, width, size, font, way = g
            if base is None or way != turn or abs(y - base) > 0.5 * max(size, 0.1):
                if texts:
                    put(made())
                line, base, turn, texts = line + 1, y, way, []
            if text.isspace():
                if texts:
                    put(made())
                texts = []
            else:
                if texts and (abs(x - end) > GAP * size or font != last_font or size != last_size):
                    put(made())
                    texts = []
                if not texts:
                    a = (x, y, size, font, way)
                texts.append(text)
                z, last_font, last_size, whole = x + width, font, size, None
            end = x + width
            continue
        text, x, y, unit, steps, widths, size, font, way = g
        if base is None or way != turn or abs(y - base) > 0.5 * max(size, 0.1):
            if texts:
                put(whole or made())
                texts = []
            line, base, turn = line + 1, y, way
        parts, n = text.split(), len(text)
        constant = type(steps) is not list
        if texts and (not parts or text[0].isspace() or abs(x - end) > GAP * size or font != last_font or size != last_size):
            put(made())
            texts = []
        end = x + (n - 1) * steps * unit + widths if constant else x + steps[n - 1] * unit + widths[-1]
        if not parts:
            continue
        at = 0
        if texts:  # the first part goes on with the word at hand
            part = parts.pop(0)
            at = len(part)
            texts.append(part)
            z, whole = x + ((at - 1) * steps if constant else steps[at - 1]) * unit + (widths if constant else widths[at - 1]), None
            if at == n:
                continue
            put(made())
            texts = []
        top, bottom, crossing = y - ASCENT * size, y - DESCENT * size, -y if way in (1, 2) else y
        if constant and not way:
            for part in parts:
                at = text.find(part, at)
                left = x + at * steps * unit
                at += len(part)
                put((line, part, left, top, x + (at - 1) * steps * unit + widths, bottom, crossing, size, font, 0))
        elif not way:
            for part in parts:
                at = text.find(part, at)
                left = x + steps[at] * unit
                at += len(part)
                put((line, part, left, top, x + steps[at - 1] * unit + widths[at - 1], bottom, crossing, size, font, 0))
        else:
            for part in parts:
                at = text.find(part, at)
                left = x + (at * steps if constant else steps[at]) * unit
                at += len(part)
                put((line, part, *box_of(left, top, x + ((at - 1) * steps if constant else steps[at - 1]) * unit + (widths if constant else widths[at - 1]), bottom, way), crossing, size, font, way))
        if parts and at == n:  # the last part may go on
            whole, texts, a = out.pop(), [part], (left, y, size, font, way)
            z, last_font, last_size = end, font, size
    if texts:
        put(made())
    return out
