"""What hangs on a document's catalog: fonts, images, annotations, destinations, files, fields, layers, labels, structure."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

from .content import MAX_FORMS, multiply, operations
from .document import Document, text
from .syntax import Name, Ref, Stream

MAX_TREE = 100
#: The actions, page modes and page layouts that the format names (ISO 32000-1, 12.6.4 and table 28).
ACTIONS = ("GoTo", "GoToR", "Launch", "URI", "Named", "Movie", "Rendition", "Sound", "JavaScript", "SetOCGState", "Hide", "ResetForm", "SubmitForm")
MODES = ("UseNone", "UseOutlines", "UseThumbs", "FullScreen", "UseOC", "UseAttachments")
LAYOUTS = ("SinglePage", "OneColumn", "TwoColumnLeft", "TwoColumnRight", "TwoPageLeft", "TwoPageRight")
#: Names of a font's kind by its Subtype and the key of its program.
PROGRAMS = {("Type1", None): "Type 1", ("Type1", "FontFile"): "Type 1", ("Type1", "FontFile3"): "Type 1C", ("MMType1", None): "Type 1", ("Type3", None): "Type 3", ("TrueType", None): "TrueType", ("TrueType", "FontFile2"): "TrueType", ("CIDFontType0", None): "CID Type 0", ("CIDFontType0", "FontFile3"): "CID Type 0C", ("CIDFontType2", None): "CID TrueType", ("CIDFontType2", "FontFile2"): "CID TrueType"}


def dict_of(doc: Document, x: Any) -> dict:
    x = doc.get(x)
    return x if isinstance(x, dict) else x.dict if isinstance(x, Stream) else {}


def list_of(doc: Document, x: Any) -> list:
    x = doc.get(x)
    return x if isinstance(x, list) else []


def said(doc: Document, x: Any) -> str | None:
    x = doc.get(x)
    return text(x) if isinstance(x, bytes) else str(x) if isinstance(x, str) else None


def number(doc: Document, x: Any) -> float | None:
    x = doc.get(x)
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def tree(doc: Document, root: Any, key: str) -> Iterator[tuple[Any, Any]]:
    """(key, value) of a name tree (Names) or a number tree (Nums), in its order; cycles are cut."""
    todo, seen = [(root, 0)], set()
    while todo:
        ref, depth = todo.pop()
        if depth > MAX_TREE or isinstance(ref, Ref) and ref in seen:
            continue
        seen.add(ref) if isinstance(ref, Ref) else None
        node = dict_of(doc, ref)
        flat = list_of(doc, node.get(key))
        yield from ((doc.get(k), v) for k, v in zip(flat[::2], flat[1::2], strict=False))
        todo += [(k, depth + 1) for k in reversed(list_of(doc, node.get("Kids")))]


def page_places(doc: Document) -> dict[Ref, int]:
    return {ref: i for i, (ref, _) in enumerate(doc.pages()) if ref}


def named(doc: Document) -> dict[bytes, Any]:
    """Destinations by name: those of the name tree before those of the old dictionary."""
    found: dict[bytes, Any] = {}
    for k, v in tree(doc, dict_of(doc, doc.catalog.get("Names")).get("Dests"), "Names"):
        if isinstance(k, bytes):
            found.setdefault(k, v)
    for k, v in dict_of(doc, doc.catalog.get("Dests")).items():
        found.setdefault(k.encode("latin-1"), v)
    return found


def destination(doc: Document, x: Any, names: dict[bytes, Any], places: dict[Ref, int]) -> dict | None:
    """(page, kind, left, top, zoom) of a destination; null where it names no page of this document."""
    x = doc.get(x)
    if isinstance(x, (bytes, Name)):
        x = doc.get(names.get(x if isinstance(x, bytes) else x.encode("latin-1")))
    x = doc.get(x.get("D")) if isinstance(x, dict) else x
    if not isinstance(x, list) or len(x) < 2:
        return None
    page = places.get(x[0]) if isinstance(x[0], Ref) else x[0] if isinstance(x[0], int) else None
    kind = said(doc, x[1]) or ""
    at = [number(doc, v) for v in x[2:]] + [None] * 4
    left, top = {"XYZ": (at[0], at[1]), "FitH": (None, at[0]), "FitBH": (None, at[0]), "FitV": (at[0], None), "FitBV": (at[0], None), "FitR": (at[0], at[3])}.get(kind, (None, None))
    return None if page is None else {"page": page, "kind": kind, "left": left, "top": top, "zoom": at[2] if kind == "XYZ" else None}


def destinations(doc: Document) -> Iterator[dict]:
    """Named destinations in byte order of their names."""
    names, places = named(doc), page_places(doc)
    for k in sorted(names):
        if found := destination(doc, names[k], names, places):
            yield {"name": text(k), **found}


def annotations(doc: Document) -> Iterator[dict]:
    """Annotations of every page, with what their action or destination does."""
    names, places = named(doc), page_places(doc)
    for i, (_, page) in enumerate(doc.pages()):
        for n, ref in enumerate(list_of(doc, page.get("Annots"))):
            d = dict_of(doc, ref)
            if not d:
                continue
            act = dict_of(doc, d.get("A"))
            kind = said(doc, act.get("S"))
            to = destination(doc, d["Dest"] if "Dest" in d else act.get("D"), names, places) if "Dest" in d or kind == "GoTo" else None
            box = [number(doc, v) or 0.0 for v in list_of(doc, d.get("Rect"))]
            yield {"page_num": i, "annot": n, "subtype": said(doc, d.get("Subtype")), "rect": [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])] if len(box) == 4 else None, "contents": said(doc, d.get("Contents")), "flags": int(number(doc, d.get("F")) or 0), "action": "GoTo" if "Dest" in d else kind if kind in ACTIONS else "Unknown" if kind else None, "uri": said(doc, act.get("URI")), "dest_page": to and to["page"], "dest_kind": to and to["kind"]}


def _resources(doc: Document, root: Any) -> Iterator[dict]:
    """A resource dictionary and those of the forms and patterns in it, each once."""
    todo, seen = [(root, 0)], set()
    while todo:
        ref, depth = todo.pop()
        if depth > MAX_TREE or isinstance(ref, Ref) and ref in seen:
            continue
        seen.add(ref) if isinstance(ref, Ref) else None
        own = dict_of(doc, ref)
        yield own
        for kind in ("XObject", "Pattern"):
            for x in dict_of(doc, own.get(kind)).values():
                if isinstance(x, Ref) and x not in seen:
                    seen.add(x)
                    if "Resources" in (inner := dict_of(doc, x)):
                        todo.append((inner["Resources"], depth + 1))


def fonts(doc: Document) -> Iterator[dict]:
    """Fonts of the pages and their annotations' appearances, each object number once."""
    seen = set()
    for i, (_, page) in enumerate(doc.pages()):
        looks = [x for a in list_of(doc, page.get("Annots")) for x in dict_of(doc, dict_of(doc, a).get("AP")).values()]
        for own in (r for root in [page.get("Resources"), *(dict_of(doc, x).get("Resources") for x in looks)] for r in _resources(doc, root)):
            for ref in dict_of(doc, own.get("Font")).values():
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        continue
                    seen.add(ref.num)
                d = dict_of(doc, ref)
                below = list_of(doc, d.get("DescendantFonts"))
                real = dict_of(doc, below[0]) if below else d
                held = dict_of(doc, real.get("FontDescriptor"))
                program = next((k for k in ("FontFile", "FontFile2", "FontFile3") if k in held), None)
                name, sub = said(doc, d.get("BaseFont")), said(doc, real.get("Subtype"))
                coding = doc.get(d.get("Encoding"))
                kind = PROGRAMS.get((sub, program)) or PROGRAMS.get((sub, None), "unknown")
                if program == "FontFile3" and said(doc, dict_of(doc, held[program]).get("Subtype")) == "OpenType":
                    kind += " (OT)"
                yield {"page_num": i, "name": name, "type": kind, "encoding": str(coding) if isinstance(coding, str) else "Custom" if coding else "Builtin", "embedded": program is not None or sub == "Type3", "subset": bool(re.match(r"[A-Z]{6}\+", name or "")), "to_unicode": "ToUnicode" in d, "object": ref.num if isinstance(ref, Ref) else None}


#: An image's encoding by its last filter.
ENCODINGS = {"DCTDecode": "jpeg", "JPXDecode": "jpx", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "ccitt"}
COLORS = {"DeviceGray": ("gray", 1), "CalGray": ("gray", 1), "DeviceRGB": ("rgb", 3), "CalRGB": ("rgb", 3), "DeviceCMYK": ("cmyk", 4), "Lab": ("lab", 3), "ICCBased": ("icc", 0), "Indexed": ("index", 1), "Separation": ("sep", 1), "DeviceN": ("devn", 0)}


def images(doc: Document) -> Iterator[dict]:
    """Images as pages draw them, with the resolution that the transformation gives them."""
    for i, (_, page) in enumerate(doc.pages()):
        yield from ({"page_num": i, "num": n, **x} for n, x in enumerate(_drawn(doc, doc.contents(page), dict_of(doc, page.get("Resources")), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0)))


def _drawn(doc: Document, data: bytes, resources: dict, ctm: tuple, depth: int) -> Iterator[dict]:
    stack: list[tuple] = []
    for op, a in operations(data):
        if op == "q":
            stack.append(ctm)
        elif op == "Q" and stack:
            ctm = stack.pop()
        elif op == "cm" and len(a) >= 6 and all(isinstance(v, (int, float)) for v in a[-6:]):
            ctm = multiply(tuple(map(float, a[-6:])), ctm)
        elif op == "Do" and a and isinstance(a[-1], str) and depth < MAX_FORMS:
            ref = dict_of(doc, resources.get("XObject")).get(a[-1])
            x = doc.get(ref)
            if isinstance(x, Stream) and x.dict.get("Subtype") == "Form":
                m = [number(doc, v) or 0.0 for v in list_of(doc, x.dict.get("Matrix"))]
                yield from _drawn(doc, doc.decoded(x) or b"", dict_of(doc, x.dict.get("Resources")) or resources, multiply(tuple(m), ctm) if len(m) == 6 else ctm, depth + 1)
            elif isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                yield _image(doc, x, "stencil" if doc.get(x.dict.get("ImageMask")) else "image", ref, ctm)
                for key in ("SMask", "Mask"):
                    if isinstance(mask := doc.get(x.dict.get(key)), Stream):
                        yield _image(doc, mask, key.lower(), x.dict[key], ctm)


def _image(doc: Document, x: Stream, kind: str, ref: Any, ctm: tuple) -> dict:
    d = x.dict
    width, height = int(number(doc, d.get("Width")) or 0), int(number(doc, d.get("Height")) or 0)
    space = doc.get(d.get("ColorSpace"))
    name = said(doc, space[0]) if isinstance(space, list) and space else said(doc, space)
    color, parts = ("gray", 1) if kind == "stencil" else COLORS.get(name or "", ("-", 1))
    if isinstance(space, list) and name == "ICCBased":
        parts = int(number(doc, dict_of(doc, space[1]).get("N")) or 0)
    if isinstance(space, list) and name == "DeviceN":
        parts = len(list_of(doc, space[1]))
    names = doc.get(d.get("Filter"))
    last = said(doc, names[-1] if isinstance(names, list) and names else names if not isinstance(names, list) else None)
    bits = 1 if kind == "stencil" else int(number(doc, d.get("BitsPerComponent")) or 8)
    across, down = (ctm[0] ** 2 + ctm[1] ** 2) ** 0.5, (ctm[2] ** 2 + ctm[3] ** 2) ** 0.5
    full = height * ((width * parts * bits + 7) // 8)
    return {"type": kind, "width": width, "height": height, "color": color, "comp": parts, "bpc": bits, "enc": ENCODINGS.get(last or "", "image"), "interp": bool(doc.get(d.get("Interpolate"))), "object": ref.num if isinstance(ref, Ref) else None, "x_ppi": width * 72 / across if across else None, "y_ppi": height * 72 / down if down else None, "size": len(x.raw), "ratio": 100 * len(x.raw) / full if full else None}


def attachments(doc: Document) -> Iterator[dict]:
    """Embedded files in the order of their name tree."""
    for n, (key, ref) in enumerate(tree(doc, dict_of(doc, doc.catalog.get("Names")).get("EmbeddedFiles"), "Names")):
        spec = dict_of(doc, ref)
        held = dict_of(doc, spec.get("EF"))
        body = doc.get(next((held[k] for k in ("UF", "F", "Unix", "DOS", "Mac") if k in held), None))
        if isinstance(body, Stream):
            facts, data = dict_of(doc, body.dict.get("Params")), doc.decoded(body)
            sum_ = doc.get(facts.get("CheckSum"))
            yield {"file": n, "key": text(key) if isinstance(key, bytes) else None, "name": next((v for k in ("UF", "F", "Unix", "DOS", "Mac") if (v := said(doc, spec.get(k)))), None), "description": said(doc, spec.get("Desc")), "mime": said(doc, body.dict.get("Subtype")), "size": int(number(doc, facts.get("Size")) or 0), "created": said(doc, facts.get("CreationDate")), "modified": said(doc, facts.get("ModDate")), "checksum": sum_.hex() if isinstance(sum_, bytes) else None, "intact": None if data is None or not isinstance(sum_, bytes) else hashlib.md5(data).digest() == sum_, "data": data}


def fields(doc: Document) -> Iterator[dict]:
    """Terminal form fields: names joined by points, type, flags and value inherited."""
    todo, seen = [(k, "", {}) for k in reversed(list_of(doc, dict_of(doc, doc.catalog.get("AcroForm")).get("Fields")))], set()
    while todo:
        ref, above, had = todo.pop()
        if isinstance(ref, Ref):
            if ref in seen:
                continue
            seen.add(ref)
        d = dict_of(doc, ref)
        own = had | {k: d[k] for k in ("FT", "Ff", "V", "DV") if k in d}
        name = ".".join(x for x in (above, said(doc, d.get("T"))) if x)
        kids = list_of(doc, d.get("Kids"))
        if any("T" in dict_of(doc, k) for k in kids):
            todo += [(k, name, own) for k in reversed(kids)]
            continue
        flags, kind = int(number(doc, own.get("Ff")) or 0), said(doc, own.get("FT"))
        value = doc.get(own.get("V"))
        button = "push" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"
        yield {"field": name, "type": {"Tx": "text", "Btn": button, "Ch": "combo" if flags & 1 << 17 else "list", "Sig": "signature"}.get(kind or "", "unknown"), "flags": flags, "value": [v for x in value if (v := said(doc, x)) is not None] if isinstance(value, list) else None if said(doc, value) is None else [said(doc, value)], "widgets": max(1, len(kids))}


def layers(doc: Document) -> Iterator[dict]:
    """Optional content groups and whether the default configuration shows them."""
    props = dict_of(doc, doc.catalog.get("OCProperties"))
    usual = dict_of(doc, props.get("D"))
    off, on = set(map(str, list_of(doc, usual.get("OFF")))), set(map(str, list_of(doc, usual.get("ON"))))
    base = said(doc, usual.get("BaseState")) != "OFF"
    for n, ref in enumerate(list_of(doc, props.get("OCGs"))):
        yield {"layer": n, "name": said(doc, dict_of(doc, ref).get("Name")), "visible": False if str(ref) in off else True if str(ref) in on else base, "object": ref.num if isinstance(ref, Ref) else None}


def labels(doc: Document) -> Iterator[dict]:
    """Ranges of page labels: first page, style, prefix, first number, and how many pages they reach."""
    n = sum(1 for _ in doc.pages())
    found = sorted(((int(k), dict_of(doc, v)) for k, v in tree(doc, doc.catalog.get("PageLabels"), "Nums") if isinstance(k, int) and 0 <= k < n), key=lambda x: x[0])
    for i, (base, d) in enumerate(found):
        yield {"base": base, "length": (found[i + 1][0] if i + 1 < len(found) else n) - base, "style": said(doc, d.get("S")), "prefix": said(doc, d.get("P")) or "", "first": int(number(doc, d.get("St")) or 1)}


def structure(doc: Document) -> Iterator[dict]:
    """Elements of the structure tree in order; types by the role map."""
    root = dict_of(doc, doc.catalog.get("StructTreeRoot"))
    roles = {k: said(doc, v) for k, v in dict_of(doc, root.get("RoleMap")).items()}
    kids = doc.get(root.get("K"))
    todo, seen, node = [(k, None, 0) for k in reversed(kids if isinstance(kids, list) else [root.get("K")])], set(), 0
    while todo:
        ref, parent, depth = todo.pop()
        d = doc.get(ref)
        if not isinstance(d, dict) or "S" not in d or depth > MAX_TREE or isinstance(ref, Ref) and ref in seen:
            continue
        seen.add(ref) if isinstance(ref, Ref) else None
        kind, tried = said(doc, d["S"]) or "", set()
        while kind in roles and kind not in tried:
            tried.add(kind)
            kind = roles[kind] or kind
        yield {"node_id": node, "parent_id": parent, "depth": depth, "type": kind, "title": said(doc, d.get("T")), "lang": said(doc, d.get("Lang")), "alt": said(doc, d.get("Alt")), "actual_text": said(doc, d.get("ActualText"))}
        kids = doc.get(d.get("K"))
        todo += [(k, node, depth + 1) for k in reversed(kids if isinstance(kids, list) else [d.get("K")]) if k is not None]
        node += 1


def _code(doc: Document, action: Any) -> Iterator[str]:
    """Scripts of an action and of those that follow it."""
    todo, n = [action], 0
    while todo and n < MAX_TREE:
        d, n = dict_of(doc, todo.pop()), n + 1
        if said(doc, d.get("S")) == "JavaScript":
            x = doc.get(d.get("JS"))
            yield text(doc.decoded(x) or b"") if isinstance(x, Stream) else said(doc, x) or ""
        following = doc.get(d.get("Next"))
        todo += following[::-1] if isinstance(following, list) else [following] if following else []


def scripts(doc: Document) -> Iterator[dict]:
    """JavaScript of the document, its names, pages, annotations and fields."""
    for key, action in tree(doc, dict_of(doc, doc.catalog.get("Names")).get("JavaScript"), "Names"):
        yield from ({"place": "name", "name": text(key) if isinstance(key, bytes) else None, "page_num": None, "code": c} for c in _code(doc, action))
    yield from ({"place": "open", "name": None, "page_num": None, "code": c} for c in _code(doc, doc.catalog.get("OpenAction")))
    yield from ({"place": "document", "name": k, "page_num": None, "code": c} for k, a in dict_of(doc, doc.catalog.get("AA")).items() for c in _code(doc, a))
    for i, (_, page) in enumerate(doc.pages()):
        yield from ({"place": "page", "name": k, "page_num": i, "code": c} for k, a in dict_of(doc, page.get("AA")).items() for c in _code(doc, a))
        for d in (dict_of(doc, a) for a in list_of(doc, page.get("Annots"))):
            every = [("A", d.get("A")), *dict_of(doc, d.get("AA")).items()]
            yield from ({"place": "annotation", "name": k, "page_num": i, "code": c} for k, a in every for c in _code(doc, a))


def facts(doc: Document) -> dict:
    """Properties of the whole document."""
    c = doc.catalog if isinstance(doc.catalog, dict) else {}
    form = dict_of(doc, c.get("AcroForm"))
    xmp = doc.get(c.get("Metadata"))
    ids = [x.hex() if isinstance(x, bytes) else None for x in list_of(doc, doc.trailer.get("ID"))]
    mode, layout = said(doc, c.get("PageMode")), said(doc, c.get("PageLayout"))
    first = re.search(rb"\bobj\s*<<(.{0,400}?)>>", doc.data[:2048], re.S)
    prefs = {k: str(v).lower() if isinstance(v := doc.get(x), bool) else str(v) for k, x in dict_of(doc, c.get("ViewerPreferences")).items()}
    return {"page_mode": mode if mode in MODES else MODES[0], "page_layout": layout if layout in LAYOUTS else None, "form": "XFA" if "XFA" in form else "AcroForm" if form else "none", "tagged": doc.get(dict_of(doc, c.get("MarkInfo")).get("Marked")) is True, "lang": said(doc, c.get("Lang")), "xmp": (doc.decoded(xmp) or b"").decode("utf-8", "replace") if isinstance(xmp, Stream) else None, "permanent_id": ids[0] if ids else None, "update_id": ids[1] if len(ids) > 1 else None, "linearized": bool(first and b"/Linearized" in first[1]), "viewer": list(prefs.items())}
