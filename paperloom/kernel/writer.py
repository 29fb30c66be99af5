"""Writing documents: whole files of objects, synthesis from text, page selection, merging."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable
from itertools import count
from typing import Any

from . import security
from .document import Document
from .syntax import Name, Ref, Stream, write

#: Geometry of synthesised pages, in points; words a line and lines a page.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, LEADING, FONT_SIZE = 612, 792, 72, 12, 10
WORDS_A_LINE, LINES_A_PAGE = 8, 54


def file_of(objects: dict[int, Any], root: int, info: int | None = None, version: str = "1.7", more: dict[str, Any] | None = None) -> bytes:
    out, places = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {}
    for num in sorted(objects):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + write(objects[num]) + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n" % size
    out += b"".join([b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 65535 f \n" for num in range(size)])
    trailer = {"Size": size, "Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {}) | (more or {})
    return bytes(out + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def synthesize(text: str | None, info: dict[str, str], compress: bool = True) -> bytes:
    """Courier pages of the text's words, in lines of eight, with an outline entry for each page."""
    return file_of(_pages(text, info, compress), 1, 4)


#: The font of synthesised pages.
COURIER = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}


def composite(text: str, width: int = 600) -> tuple[dict[str, Any], dict[str, bytes], Stream]:
    """A composite font for any text: its dictionary less ToUnicode, the code of each character, and the ToUnicode stream."""
    codes = {c: (i + 1).to_bytes(2, "big") for i, c in enumerate(sorted(set(text) | {" "}))}
    pairs = [f"<{code.hex()}> <{c.encode('utf-16-be').hex()}>" for c, code in codes.items()]
    body = "".join(f"{len(part)} beginbfchar\n" + "\n".join(part) + "\nendbfchar\n" for i in range(0, len(pairs), 100) if (part := pairs[i : i + 100]))
    inner = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Courier"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "DW": width}
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Courier"), "Encoding": Name("Identity-H"), "DescendantFonts": [inner]}
    return font, codes, Stream({}, f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{body}".encode())


def _pages(text: str | None, info: dict[str, str], compress: bool = True, font: dict[str, Any] | None = None, encode: Callable[[str], bytes] | None = None, place: bytes = b"%d %d Td" % (MARGIN, PAGE_HEIGHT - MARGIN), show: Callable[[bytes, int], bytes] = lambda said, _: said + b" Tj") -> dict[int, Any]:
    """Objects of a document; the font, how it codes lines, where text begins and how a line is shown can be given.

    Texts beyond WinAnsi get a composite font, where no other is given.
    """
    to_unicode = None
    if encode is None:
        try:
            (text or "").encode("cp1252")
            font, encode = font or COURIER, lambda line: line.encode("cp1252")
        except UnicodeEncodeError:
            font, codes, to_unicode = composite((text or "").encode("utf-16", "replace").decode("utf-16"))
            encode = lambda line: b"".join(codes.get(c, codes[" "]) for c in line)
    tokens = (text or "").split()
    lines = [" ".join(tokens[i : i + WORDS_A_LINE]) for i in range(0, len(tokens), WORDS_A_LINE)] or [""]
    pages = [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)]
    objects: dict[int, Any] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(5, 0)}, 3: font, 4: {k: b"\xfe\xff" + v.encode("utf-16-be") for k, v in info.items()}}
    first = 6
    for i, page in enumerate(pages):
        body = [b"BT /F1 %d Tf %d TL %s" % (FONT_SIZE, LEADING, place)]
        for n, line in enumerate(page):
            body.append((b"T* " if n else b"") + show(write(encode(line)), n))
        raw = b"\n".join([*body, b"ET"])
        num = first + 3 * i
        objects[num] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(num + 1, 0)}
        objects[num + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(raw)) if compress else Stream({}, raw)
        item = {"Title": b"Page %d" % (i + 1), "Parent": Ref(5, 0), "Dest": [Ref(num, 0), Name("Fit")]}
        objects[num + 2] = item | ({"Next": Ref(num + 5, 0)} if i + 1 < len(pages) else {}) | ({"Prev": Ref(num - 1, 0)} if i else {})
    objects[2] = {"Type": Name("Pages"), "Count": len(pages), "Kids": [Ref(first + 3 * i, 0) for i in range(len(pages))], "MediaBox": [0, 0, PAGE_WIDTH, PAGE_HEIGHT], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    objects[5] = {"Type": Name("Outlines"), "First": Ref(first + 2, 0), "Last": Ref(first + 3 * len(pages) - 1, 0), "Count": len(pages)}
    if to_unicode is not None:
        number = first + 3 * len(pages)
        objects[3], objects[number] = font | {"ToUnicode": Ref(number, 0)}, to_unicode
    return objects


def _utf16(s: str) -> bytes:
    return b"\xfe\xff" + s.encode("utf-16-be")


def decorate(text: str | None, info: dict[str, str], key: int) -> bytes:
    """The same pages with an image, two links and a label each, and with named destinations, an
    attached file, form fields, layers, scripts, a structure tree and document properties."""
    objects, raw = _pages(text, info), (text or "").encode()
    pages = [n for n, x in objects.items() if isinstance(x, dict) and x.get("Type") == "Page"]
    free = count(max(objects) + 1)

    def put(x: Any) -> Ref:
        objects[num := next(free)] = x
        return Ref(num, 0)

    image = put(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}, bytes(range(12))))
    draw = put(Stream({}, b"q 100 0 0 50 72 20 cm /Im1 Do Q"))
    objects[2]["Resources"]["XObject"] = {"Im1": image}
    sections = []
    for i, num in enumerate(pages):
        objects[num]["Contents"] = [objects[num]["Contents"], draw]
        web = {"S": Name("URI"), "URI": f"https://example.org/{info['Subject']}/{key}#{i + 1}".encode()}
        objects[num]["Annots"] = [put({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [172, 712, 72, 700], "A": web}), put({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [72, 60, 172, 72], "A": {"S": Name("GoTo"), "D": b"page-%04d" % len(pages)}})]
        sections.append(put({"Type": Name("StructElem"), "S": Name("Chapter"), "Alt": b"Page %d" % (i + 1)}))
    names = [x for i, num in enumerate(pages) for x in (b"page-%04d" % (i + 1), [Ref(num, 0), Name("XYZ"), 72, 720, 0])]
    body = put(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name("text/plain"), "Filter": Name("FlateDecode"), "Params": {"Size": len(raw), "CheckSum": hashlib.md5(raw).digest()}}, zlib.compress(raw)))
    spec = put({"Type": Name("Filespec"), "F": b"source.txt", "UF": _utf16("source.txt"), "Desc": b"The text", "EF": {"F": body}})
    group = put({"T": b"doc", "FT": Name("Tx")})
    objects[group.num]["Kids"] = [put({"T": b"lang", "Parent": group, "V": _utf16(info["Subject"])}), put({"T": b"source", "Parent": group, "V": _utf16(info["Author"])})]
    agree = put({"T": b"agree", "FT": Name("Btn"), "V": Name("Off" if key % 2 else "Yes")})
    shown, hidden = put({"Type": Name("OCG"), "Name": b"Text"}), put({"Type": Name("OCG"), "Name": b"Notes"})
    tree = put({"Type": Name("StructTreeRoot"), "RoleMap": {"Chapter": Name("Sect")}, "K": put({"Type": Name("StructElem"), "S": Name("Document"), "Lang": info["Subject"].encode(), "K": sections})})
    objects[1] |= {
        "Names": {"Dests": {"Names": names}, "EmbeddedFiles": {"Names": [b"source.txt", spec]}, "JavaScript": {"Names": [b"init", {"S": Name("JavaScript"), "JS": b"var doc = %d;" % key}]}},
        "AcroForm": {"Fields": [group, agree]},
        "OCProperties": {"OCGs": [shown, hidden], "D": {"OFF": [] if key % 3 else [hidden]}},
        "PageLabels": {"Nums": [0, {"S": Name("r")}, 2, {"S": Name("D"), "P": b"A-", "St": 5}]},
        "OpenAction": {"S": Name("JavaScript"), "JS": b"open();"},
        "StructTreeRoot": tree,
        "MarkInfo": {"Marked": True},
        "Lang": info["Subject"].encode(),
        "Metadata": put(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, f"<title>{info['Title']}</title>".encode())),
        "PageMode": Name("UseOutlines"),
        "PageLayout": Name("OneColumn"),
        "ViewerPreferences": {"HideToolbar": True},
    }
    return file_of(objects, 1, 4, more={"ID": [hashlib.md5(raw).digest()] * 2})


def protect(objects: dict[int, Any], method: str, user: bytes, owner: bytes, first_id: bytes, info: int | None = 4) -> bytes:
    """A file of ``objects`` (the catalog is number 1), encrypted; see ``security.lock``."""
    d, crypt = security.lock(method, user, owner, first_id)
    return file_of({n: crypt.apply(x, n, 0, seal=True) for n, x in objects.items()}, 1, info, more={"Encrypt": d, "ID": [first_id] * 2})


def synthesize_protected(text: str | None, info: dict[str, str], method: str, user: bytes, owner: bytes) -> bytes:
    return protect(_pages(text, info), method, user, owner, hashlib.md5((text or "").encode()).digest())


def update(data: bytes, changed: dict[int, Any], doc: Document | None = None) -> bytes:
    """``data`` and, after it, new values of some objects with a cross-reference section of their own; ``doc`` is ``data`` opened."""
    doc = doc or Document(data)
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for num in sorted(changed):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + write(changed[num]) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n"
    for num in sorted(places):
        out += b"%d 1\n%010d 00000 n \n" % (num, places[num])
    before = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    kept = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID")}
    trailer = kept | {"Size": max([*doc.entries, *places]) + 1, "Prev": before}
    return bytes(out + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def assemble(parts: Iterable[tuple[Document, Iterable[int]]]) -> bytes:
    """A new document of the given pages (from 0) of the given documents, with what they refer to."""
    objects: dict[int, Any] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    kids: list[Ref] = []
    free = count(3)
    for doc, wanted in parts:
        known: dict[int, int] = {}

        def moved(x: Any) -> Any:
            if isinstance(x, Ref):
                if x.num not in known:
                    known[x.num] = next(free)
                    objects[known[x.num]] = moved_object(x)
                return Ref(known[x.num], 0)
            if isinstance(x, list):
                return [moved(v) for v in x]
            if isinstance(x, dict):
                return {k: moved(v) for k, v in x.items() if k not in ("Parent", "P")}
            return x

        def moved_object(ref: Ref) -> Any:
            x = doc.get(ref)
            return Stream(moved({k: v for k, v in x.dict.items() if k != "Length"}), x.raw) if isinstance(x, Stream) else moved(x)

        every = list(doc.pages())
        for i in wanted:
            if 0 <= i < len(every):
                page = moved(every[i][1])
                num = next(free)
                objects[num] = page | {"Type": Name("Page"), "Parent": Ref(2, 0)}
                kids.append(Ref(num, 0))
    objects[2] = {"Type": Name("Pages"), "Count": len(kids), "Kids": kids}
    return file_of(objects, 1)
