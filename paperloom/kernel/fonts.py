"""Codes of a font to text and widths: encodings, glyph names, standard widths, composite fonts (ISO 32000-1, 9.6 to 9.10)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import Any

from .document import Document
from .syntax import Stream

#: Fixed value: width of every Courier glyph, in ems.
COURIER = 0.6

#: The marks that a glyph name can add to a letter's name.
MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "commaaccent": "̧", "ogonek": "̨"}
#: Glyph names that are neither a letter, a letter with a mark, nor made of hexadecimal digits.
NAMES = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", strict=True))
NAMES |= dict(zip("exclamdown cent sterling fraction yen florin section currency quotedblleft guillemotleft guilsinglleft guilsinglright fi fl ff ffi ffl endash emdash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron AE ae OE oe Oslash oslash Lslash lslash ordfeminine ordmasculine germandbls dotlessi quoteleft quoteright Eth eth Thorn thorn copyright registered trademark degree plusminus mu multiply divide brokenbar logicalnot onesuperior twosuperior threesuperior onequarter onehalf threequarters Euro minus nbspace softhyphen".split(), "¡¢£⁄¥ƒ§¤“«‹›ﬁﬂﬀﬃﬄ–—†‡·¶•‚„”»…‰¿´ˆ˜¯˘˙¨˚¸˝˛ˇÆæŒœØøŁłªºßı‘’ÐðÞþ©®™°±µ×÷¦¬¹²³¼½¾€− ­", strict=True))
#: StandardEncoding above ASCII, as runs from a code.
STANDARD_RUNS = {0xA1: "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 0xB1: "–†‡·", 0xB6: "¶•‚„”»…‰", 0xBF: "¿", 0xC1: "`´ˆ˜¯˘˙¨", 0xCA: "˚¸", 0xCD: "˝˛ˇ—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "ŁØŒº", 0xF1: "æ", 0xF5: "ı", 0xF8: "łøœß"}

#: Widths of the characters 32 to 126 of the standard faces, in thousandths.
HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
HELVETICA_BOLD = "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
TIMES_BOLD = "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
#: Widths of other characters in the upright, regular sans-serif and serif face.
OTHERS = {"–": (556, 500), "—": (1000, 1000), "…": (1000, 1000), "•": (350, 350), "‘": (222, 333), "’": (222, 333), "“": (333, 444), "”": (333, 444), "Æ": (1000, 889), "æ": (889, 667), "Œ": (1000, 889), "œ": (944, 722), "Ø": (778, 722), "ø": (611, 500), "ß": (611, 500), "«": (556, 500), "»": (556, 500), "§": (556, 500), "©": (737, 760), "®": (737, 760), "°": (400, 400), "€": (556, 500), "¡": (333, 333), "¿": (611, 444), "ﬁ": (500, 556), "ﬂ": (500, 556)}


@lru_cache(16_384)
def named(name: str) -> str | None:
    """The text of a glyph name: known names, uniXXXX and uXXXXXX, letters with marks, parts joined by underscores."""
    stem = name.partition(".")[0]
    if "_" in stem.strip("_"):
        parts = [named(p) for p in stem.split("_")]
        return "".join(parts) if all(parts) else None
    if stem in NAMES or len(stem) == 1:
        return NAMES.get(stem, stem)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", stem):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", stem)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if stem[1:] in MARKS and stem[0].isalpha():
        letter = unicodedata.normalize("NFC", stem[0] + MARKS[stem[1:]])
        return letter if len(letter) == 1 else None
    return None


@cache
def encoding(name: str | None) -> tuple[str, ...]:
    """Text of each of the 256 codes of a named encoding; an empty text where a code has none."""
    if name == "MacRomanEncoding":
        table = list(bytes(range(256)).decode("mac_roman"))
        table[0xDB], table[0xCA] = "¤", " "
    elif name == "WinAnsiEncoding":
        table = [bytes([c]).decode("cp1252", "ignore") or "•" for c in range(256)]
    else:
        table = [chr(c) if c < 127 else "" for c in range(256)]
        table[0x27], table[0x60] = "’", "‘"
        for first, run in STANDARD_RUNS.items():
            table[first : first + len(run)] = run
    return tuple(table)


@cache
def face(name: str) -> dict[str, float] | None:
    """Widths in ems of a standard face or one named like it; null for fixed pitch and for unknown names."""
    low = name.rpartition("+")[2].lower()
    serif = "times" in low
    if not serif and not any(k in low for k in ("helvetica", "arial")):
        return None
    bold = "bold" in low
    said = (TIMES_BOLD if bold else TIMES) if serif else HELVETICA_BOLD if bold else HELVETICA
    return {chr(32 + i): int(w) / 1000 for i, w in enumerate(said.split())} | {c: w[serif] / 1000 for c, w in OTHERS.items()}


def width_of(widths: dict[str, float], text: str) -> float:
    """A letter with marks is as wide as the letter; others that are not known, as a figure."""
    found = widths.get(text)
    return found if found is not None else widths.get(unicodedata.normalize("NFD", text)[:1], widths["0"])


def _utf16(digits: str) -> str:
    return bytes.fromhex(digits if len(digits) % 4 == 0 else digits.zfill(4)).decode("utf-16-be", "replace")


def unicode_map(cmap: bytes | None) -> dict[int, str]:
    """Code to text of a ToUnicode stream; ranges go on in the last UTF-16 unit, or give a text for each code."""
    out, body = {}, (cmap or b"").decode("latin-1")
    for part in re.findall(r"beginbfchar(.*?)endbfchar", body, re.S):
        for code, to in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(code, 16)] = _utf16(to)
    for part in re.findall(r"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, to, each in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            first, last = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if to:
                head, unit = to[:-4], int(to[-4:], 16)
                for i in range(last - first + 1):
                    out[first + i] = _utf16(f"{head}{(unit + i) & 0xFFFF:04x}")
            else:
                for i, one in zip(range(last - first + 1), re.findall(r"<([0-9A-Fa-f]+)>", each)):
                    out[first + i] = _utf16(one)
    return out


class Codes:
    """How bytes are cut into codes, and the glyph number of each: an embedded CMap, or two bytes that are the number."""

    def __init__(self, cmap: bytes | None):
        body = (cmap or b"").decode("latin-1")
        spans = [(len(a) // 2, int(a, 16), int(b, 16)) for part in re.findall(r"begincodespacerange(.*?)endcodespacerange", body, re.S) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]
        self.spans = spans or [(2, 0, 0xFFFF)]
        self.single = {int(a, 16): int(n) for part in re.findall(r"begincidchar(.*?)endcidchar", body, re.S) for a, n in re.findall(r"<([0-9A-Fa-f]+)>\s*(\d+)", part)}
        self.ranges = [(int(a, 16), int(b, 16), int(n)) for part in re.findall(r"begincidrange(.*?)endcidrange", body, re.S) for a, b, n in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(\d+)", part)]
        self.identity = not self.single and not self.ranges

    def cut(self, raw: bytes) -> Iterator[int]:
        at, sizes = 0, sorted({n for n, _, _ in self.spans})
        while at < len(raw):
            for size in sizes:
                code = int.from_bytes(raw[at : at + size], "big")
                if any(n == size and a <= code <= b for n, a, b in self.spans):
                    break
            at += size
            yield code

    def number(self, code: int) -> int:
        return code if self.identity else self.single.get(code, next((n + code - a for a, b, n in self.ranges if a <= code <= b), 0))


@lru_cache(16_384)
def _face_width(name: str, text: str) -> float:
    return width_of(face(name), text)


@lru_cache(256)
def _plain_of(said: tuple[str, ...], widths: tuple[float, ...]) -> tuple[str, bytes, list[float], float | None, bool]:
    return "".join(x if len(x) == 1 else " " for x in said), bytes(c for c in range(256) if len(said[c]) == 1), list(widths), widths[0] if len(set(widths)) == 1 else None, min(widths) >= 0


class Font:
    """Name, text and width of a font's codes.

    Text comes from ToUnicode, then from Differences, then from the named encoding
    (TrueType without one: WinAnsi; others: Standard).  Programs inside a font are not read.
    """

    def __init__(self, doc: Document, raw: Any):
        d = raw if isinstance(raw, dict) else {}
        self.name = str(doc.get(d.get("BaseFont")) or "")
        self.wide = doc.get(d.get("Subtype")) == "Type0"
        self.map = unicode_map(doc.decoded(x)) if isinstance(x := doc.get(d.get("ToUnicode")), Stream) else {}
        self.known: dict[int, tuple[int, str, float]] = {}
        self._plain: tuple | None = None
        said = doc.get(d.get("Encoding"))
        if self.wide:
            self._composite(doc, d, said)
        else:
            self._simple(doc, d, said)

    def _simple(self, doc: Document, d: dict, said: Any) -> None:
        base = said if isinstance(said, str) else doc.get(said.get("BaseEncoding")) if isinstance(said, dict) else None
        if base is None:
            base = "WinAnsiEncoding" if not d or doc.get(d.get("Subtype")) == "TrueType" else "StandardEncoding"
        table, code = list(encoding(str(base))), 0
        for x in (doc.get(said.get("Differences")) or []) if isinstance(said, dict) else []:
            x = doc.get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, str) and 0 <= code < 256:
                table[code], code = named(str(x)) or "�", code + 1
        self.table = table
        self.first = doc.get(d.get("FirstChar")) or 0
        self.widths = [doc.get(w) for w in doc.get(d.get("Widths")) or []]
        about = doc.get(d.get("FontDescriptor"))
        missing = doc.get(about.get("MissingWidth")) if isinstance(about, dict) else None
        self.missing = missing / 1000 if isinstance(missing, (int, float)) else 0.0 if self.widths else COURIER
        self.face = None if self.widths else face(self.name)
        matrix = doc.get(d.get("FontMatrix")) if doc.get(d.get("Subtype")) == "Type3" else None
        self.unit = float(matrix[0]) if isinstance(matrix, list) and matrix and isinstance(matrix[0], (int, float)) else 0.001

    def _composite(self, doc: Document, d: dict, said: Any) -> None:
        inner = doc.get((doc.get(d.get("DescendantFonts")) or [None])[0])
        inner = inner if isinstance(inner, dict) else {}
        self.codes_of = Codes(doc.decoded(said) if isinstance(said, Stream) else None)
        self.spelled = isinstance(said, str) and bool(re.search(r"UCS2|UTF16", said))
        default = doc.get(inner.get("DW"))
        self.missing = (default if isinstance(default, (int, float)) else 1000) / 1000
        self.numbers: dict[int, float] = {}
        self.spans: list[tuple[int, int, float]] = []
        todo = [doc.get(x) for x in doc.get(inner.get("W")) or []]
        at = 0
        while at + 1 < len(todo):
            if isinstance(todo[at + 1], list):
                self.numbers |= {todo[at] + k: doc.get(w) / 1000 for k, w in enumerate(todo[at + 1])}
                at += 2
            elif at + 2 < len(todo):
                self.spans.append((todo[at], todo[at + 1], todo[at + 2] / 1000))
                at += 3
            else:
                break

    def _glyph(self, code: int) -> tuple[int, str, float]:
        if self.wide:
            number = self.codes_of.number(code)
            width = self.numbers.get(number)
            if width is None:
                width = next((w for a, b, w in self.spans if a <= number <= b), self.missing)
            said = self.map.get(code) or (code.to_bytes(2, "big").decode("utf-16-be", "replace") if self.spelled and code < 65536 else "�")
            return code, said, width
        said = self.map.get(code) or self.table[code]
        at = code - self.first
        if 0 <= at < len(self.widths) and isinstance(self.widths[at], (int, float)):
            width = self.widths[at] * self.unit
        else:
            width = width_of(self.face, self.table[code] or " ") if self.face else self.missing
        return code, said, width

    def plain(self) -> tuple[str, bytes, list[float], float | None, bool]:
        """Of a font of single bytes: a character for each code, the codes that have just one, all widths, the one width if there is but one, and whether none is negative."""
        if self._plain is None:
            if self.widths or self.map:
                every = [self._glyph(c) for c in range(256)]
                self._plain = _plain_of(tuple(x[1] for x in every), tuple(x[2] for x in every))
            else:
                self._plain = _plain_of(tuple(self.table), tuple(_face_width(self.name, t or " ") for t in self.table) if self.face else (self.missing,) * 256)
        return self._plain

    def codes(self, raw: bytes) -> Iterator[tuple[int, str, float]]:
        known = self.known
        for c in self.codes_of.cut(raw) if self.wide else raw:
            if (found := known.get(c)) is None:
                found = known[c] = self._glyph(c)
            yield found
