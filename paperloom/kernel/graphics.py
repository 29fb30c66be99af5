"""What a page paints besides text: paths, clips, shadings, images and marked points, with the state in force (ISO 32000-1, 8.4 to 8.9)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from .content import MAX_FORMS, multiply, operations
from .document import Document
from .layers import Layers
from .syntax import Stream

#: Painting operators as (closes, fills, strokes, by the even-odd rule).
PAINTS = {"S": (0, 0, 1, 0), "s": (1, 0, 1, 0), "f": (0, 1, 0, 0), "F": (0, 1, 0, 0), "f*": (0, 1, 0, 1), "B": (0, 1, 1, 0), "B*": (0, 1, 1, 1), "b": (1, 1, 1, 0), "b*": (1, 1, 1, 1), "n": (0, 0, 0, 0)}
#: Operators that set one number of the state, the entries of ExtGState that do, and the values at the start.
NUMBERS = {"w": "line_width", "J": "cap", "j": "join", "M": "miter", "i": "flatness"}
ENTRIES = {"LW": "line_width", "LC": "cap", "LJ": "join", "ML": "miter", "FL": "flatness", "ca": "fill_alpha", "CA": "stroke_alpha"}
START = {"line_width": 1.0, "cap": 0.0, "join": 0.0, "miter": 10.0, "flatness": 0.0, "fill_alpha": 1.0, "stroke_alpha": 1.0, "dash": [], "phase": 0.0, "intent": "RelativeColorimetric", "blend": "Normal", "fill_space": "DeviceGray", "fill": [0.0], "fill_pattern": None, "stroke_space": "DeviceGray", "stroke": [0.0], "stroke_pattern": None}
#: Operators that set a device color, and the first colors of the spaces that have one.
DEVICE = {"g": ("fill", "DeviceGray", 1), "rg": ("fill", "DeviceRGB", 3), "k": ("fill", "DeviceCMYK", 4), "G": ("stroke", "DeviceGray", 1), "RG": ("stroke", "DeviceRGB", 3), "K": ("stroke", "DeviceCMYK", 4)}
FIRST = {"DeviceGray": [0.0], "CalGray": [0.0], "DeviceRGB": [0.0] * 3, "CalRGB": [0.0] * 3, "Lab": [0.0] * 3, "DeviceCMYK": [0.0, 0.0, 0.0, 1.0], "Indexed": [0.0], "Separation": [1.0], "Pattern": []}
#: Operators that this module passes over, as they only place text or frame something.
PASSED = frozenset("BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj TJ ' \" BI EI".split())


def painted(doc: Document, page: dict) -> Iterator[dict]:
    """Rows in painting order, boxes in points from the top left of the media box.

    A box holds every point that was given, the control points of curves included.  A row is a painting
    operator (``n`` only where it clips), ``sh``, ``Do`` of an image, ``ID`` of an inline image, ``MP``
    or ``DP``, ``d0`` or ``d1``, or ``?`` for an operator unknown outside a compatibility section.
    ``clip`` is the box of the clip in force, null where there is none.  A wrong operand ends the stream.
    """
    box = [float(v) for v in (doc.get(page.get("MediaBox")) or [0, 0, 612, 792])]
    seq, layers = 0, Layers(doc)
    for row in _run(doc, layers, doc.contents(page), doc.get(page.get("Resources")) or {}, START | {"ctm": (1.0, 0.0, 0.0, -1.0, -box[0], box[3]), "clip": None}, 0, True, []):
        yield {"seq": seq, **row}
        seq += 1


def around(points: list[tuple[float, float]]) -> list[float] | None:
    return [f(p[k] for p in points) for f in (min, max) for k in (0, 1)] if points else None


def common(a: list[float] | None, b: list[float] | None) -> list[float] | None:
    """The part that two boxes share; an empty part has no width or height."""
    if a is None or b is None:
        return a or b
    left, top = max(a[0], b[0]), max(a[1], b[1])
    return [left, top, max(left, min(a[2], b[2])), max(top, min(a[3], b[3]))]


def _space(doc: Document, resources: dict, name: Any) -> tuple[str, list[float]]:
    """A color space's family and first color."""
    listed = doc.get(resources.get("ColorSpace")) or {}
    said = doc.get(listed.get(name, name)) if isinstance(listed, dict) else name
    family = str(doc.get(said[0]) if isinstance(said, list) and said else said)
    if family == "ICCBased" and isinstance(profile := doc.get(said[1]), Stream):
        n = doc.get(profile.dict.get("N"))
        return family, [0.0] * (n if n in (1, 3, 4) else 3)
    if family == "DeviceN":
        return family, [1.0] * len(doc.get(said[1]) or [])
    return family, list(FIRST.get(family, [0.0]))


def _run(doc: Document, layers: Layers, data: bytes, resources: dict, state: dict, depth: int, shown: bool, marks: list) -> Iterator[dict]:
    state, stack, marks = dict(state), [], list(marks)
    outer, points, segments, here, start, pending, lenient = len(marks), [], 0, (0.0, 0.0), (0.0, 0.0), None, 0

    def at(x: float, y: float) -> tuple[float, float]:
        m = state["ctm"]
        return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]

    def row(op: str, box: list[float] | None, **more: Any) -> dict:
        tag, mcid = next(((t, m) for t, m, _ in reversed(marks) if m is not None), (marks[-1][0], None) if marks else (None, None))
        rule = PAINTS.get(op, (0, 0, 0, 0))
        kept = {k: v for k, v in state.items() if k != "ctm"}
        return {"op": op, "box": box, "segments": 0, "fills": bool(rule[1]), "strokes": bool(rule[2]), "even_odd": bool(rule[3]), "shown": shown and all(v for _, _, v in marks), "tag": tag, "mcid": mcid, "name": None} | kept | more

    def unit() -> list[float] | None:
        return around([at(0, 0), at(1, 0), at(0, 1), at(1, 1)])

    for op, a in operations(data):
        try:
            if op == "q":
                stack.append(dict(state))
            elif op == "Q":
                if stack:
                    state = stack.pop()
            elif op == "cm":
                state["ctm"] = multiply(tuple(map(float, a[-6:])), state["ctm"])
            elif op == "m":
                here = start = float(a[-2]), float(a[-1])
                points.append(at(*here))
            elif op == "l":
                here, segments = (float(a[-2]), float(a[-1])), segments + 1
                points.append(at(*here))
            elif op in ("c", "v", "y"):
                given = list(map(float, a[-6 if op == "c" else -4 :]))
                points += [at(*given[k : k + 2]) for k in range(0, len(given), 2)]
                here, segments = (given[-2], given[-1]), segments + 1
            elif op == "h":
                here, segments = start, segments + (here != start)
            elif op == "re":
                x, y, w, h = map(float, a[-4:])
                points += [at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)]
                here, start, segments = (x, y), (x, y), segments + 4
            elif op in ("W", "W*"):
                pending = op
            elif op in PAINTS:
                if PAINTS[op][0] and here != start:
                    segments += 1
                box = around(points)
                if points and (op != "n" or pending):
                    yield row(op, box, segments=segments, name=pending)
                if pending and points:
                    state["clip"] = common(state["clip"], box)
                points, segments, pending, here, start = [], 0, None, (0.0, 0.0), (0.0, 0.0)
            elif op in NUMBERS:
                state[NUMBERS[op]] = float(a[-1])
            elif op == "d":
                state["dash"], state["phase"] = [float(v) for v in a[-2]], float(a[-1])
            elif op == "ri":
                state["intent"] = str(a[-1])
            elif op == "gs":
                _apply(doc, doc.get((doc.get(resources.get("ExtGState")) or {}).get(a[-1])), state)
            elif op in DEVICE:
                side, space, n = DEVICE[op]
                values = [float(v) for v in a[-n:]]
                if len(values) < n:
                    raise ValueError(op)
                state |= {side: values, f"{side}_space": space, f"{side}_pattern": None}
            elif op in ("cs", "CS"):
                side = "fill" if op == "cs" else "stroke"
                state[f"{side}_space"], state[side] = _space(doc, resources, a[-1])
                state[f"{side}_pattern"] = None
            elif op in ("sc", "scn", "SC", "SCN"):
                side = "fill" if op.islower() else "stroke"
                state[f"{side}_pattern"] = str(a[-1]) if a and isinstance(a[-1], str) else None
                state[side] = [float(v) for v in a if isinstance(v, (int, float))]
            elif op == "sh":
                yield row(op, state["clip"], name=str(a[-1]))
            elif op in ("BMC", "BDC"):
                about = a[-1] if op == "BDC" else None
                ref = (doc.get(resources.get("Properties")) or {}).get(about) if isinstance(about, str) else about
                tag, d = str(a[-2 if op == "BDC" else -1]), doc.get(ref)
                marks.append((tag, doc.get(d.get("MCID")) if isinstance(d, dict) else None, tag != "OC" or op == "BMC" or layers.shown(ref)))
            elif op == "EMC":
                if len(marks) > outer:
                    marks.pop()
            elif op in ("MP", "DP"):
                yield row(op, None, name=str(a[0]))
            elif op in ("d0", "d1"):
                values = list(map(float, a))
                yield row(op, values[2:6] or None, name=str(values[0]))
            elif op == "ID":
                yield row(op, unit())
            elif op == "Do":
                x = doc.get((doc.get(resources.get("XObject")) or {}).get(a[-1]))
                if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                    yield row(op, unit(), name=str(a[-1]))
                elif isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and depth < MAX_FORMS:
                    inner = dict(state)
                    if isinstance(m := doc.get(x.dict.get("Matrix")), list):
                        inner["ctm"] = multiply(tuple(float(doc.get(v)) for v in m), state["ctm"])
                    if isinstance(b := doc.get(x.dict.get("BBox")), list):
                        outside, state = state, inner
                        x0, y0, x1, y1 = (float(doc.get(v)) for v in b)
                        inner["clip"] = common(inner["clip"], around([at(x0, y0), at(x1, y0), at(x0, y1), at(x1, y1)]))
                        state = outside
                    yield from _run(doc, layers, doc.decoded(x) or b"", doc.get(x.dict.get("Resources")) or resources, inner, depth + 1, shown and layers.shown(x.dict.get("OC")), marks)
            elif op in ("BX", "EX"):
                lenient = max(0, lenient + (1 if op == "BX" else -1))
            elif op not in PASSED and not lenient:
                yield row("?", None, name=op)
        except (IndexError, TypeError, ValueError):
            return


def _apply(doc: Document, d: Any, state: dict) -> None:
    """The entries of a graphics state dictionary that concern paths."""
    for key, x in d.items() if isinstance(d, dict) else ():
        x = doc.get(x)
        if key in ENTRIES and isinstance(x, (int, float)):
            state[ENTRIES[key]] = float(x)
        elif key == "D" and isinstance(x, list) and len(x) == 2:
            state["dash"], state["phase"] = [float(v) for v in doc.get(x[0])], float(doc.get(x[1]))
        elif key == "RI":
            state["intent"] = str(x)
        elif key == "BM":
            state["blend"] = str(doc.get(x[0]) if isinstance(x, list) and x else x)
