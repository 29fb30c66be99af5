"""Changes to a document, written behind it as an incremental update: files, fields, outline, annotations; and what objects refer to."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import count
from typing import Any

from .catalog import dict_of, list_of, said, tree
from .document import Document
from .syntax import Name, Ref, Stream
from .writer import update


def utf16(s: str) -> bytes:
    return b"\xfe\xff" + s.encode("utf-16-be", "replace")


class Editor:
    """Collects new values of objects; the document as it was is not touched.

    Damaged and encrypted documents can't be edited (``open`` is false) and come back as they are.
    """

    def __init__(self, doc: Document):
        self.doc, self.changed = doc, {}
        self.root = doc.trailer.get("Root")
        self.open = doc.ok and not doc.rebuilt and not doc.crypt and isinstance(self.root, Ref)
        self.free = count(max([0, *doc.entries, *([n] if isinstance(n := doc.trailer.get("Size"), int) else [])]) + 1)

    def get(self, x: Any) -> Any:
        return self.changed[x.num] if isinstance(x, Ref) and x.num in self.changed else self.doc.get(x)

    def put(self, x: Any) -> Ref:
        self.changed[num := next(self.free)] = x
        return Ref(num, 0)

    def set(self, ref: Ref, **more: Any) -> None:
        """Entries of a dictionary; null removes one."""
        old = self.get(ref)
        self.changed[ref.num] = {k: v for k, v in ((old if isinstance(old, dict) else {}) | more).items() if v is not None}

    def bytes(self) -> bytes:
        return update(self.doc.data, self.changed, self.doc) if self.changed else self.doc.data

    # files

    def _files(self, change: Callable[[dict], dict]) -> None:
        names = dict(self.get(self.get(self.root).get("Names")) or {})
        held = names.get("EmbeddedFiles")
        if isinstance(held, Ref) and held.num in self.changed:
            flat = self.changed[held.num]["Names"]
            pairs = dict(zip(flat[::2], flat[1::2], strict=True))
        else:
            pairs = {k: v for k, v in tree(self.doc, held, "Names") if isinstance(k, bytes)}
        pairs = change(pairs)
        names["EmbeddedFiles"] = self.put({"Names": [x for k in sorted(pairs) for x in (k, pairs[k])]})
        self.set(self.root, Names=self.put(names))

    def attach(self, name: str, data: bytes, mime: str = "application/octet-stream", description: str = "") -> None:
        """A file; one of the same name is replaced."""
        body = self.put(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name(mime), "Filter": Name("FlateDecode"), "Params": {"Size": len(data), "CheckSum": hashlib.md5(data).digest()}}, zlib.compress(data)))
        spec = self.put({"Type": Name("Filespec"), "F": name.encode("latin-1", "replace"), "UF": utf16(name), "Desc": utf16(description), "EF": {"F": body}})
        self._files(lambda had: had | {utf16(name) if not name.isascii() else name.encode(): spec})

    def detach(self, name: str) -> None:
        keys = {name.encode("latin-1", "replace"), utf16(name)}
        self._files(lambda had: {k: v for k, v in had.items() if k not in keys})

    # forms

    def _fields(self) -> Iterator[tuple[str, Ref, dict]]:
        """(full name, reference, entries with those inherited) of the terminal fields that are objects of their own."""
        todo, seen = [(k, "", {}) for k in reversed(list_of(self.doc, dict_of(self.doc, self.doc.catalog.get("AcroForm")).get("Fields")))], set()
        while todo:
            ref, above, had = todo.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            d = dict_of(self.doc, ref)
            own = had | {k: d[k] for k in ("FT", "Ff", "V", "DV") if k in d}
            name = ".".join(x for x in (above, said(self.doc, d.get("T"))) if x)
            kids = list_of(self.doc, d.get("Kids"))
            if any("T" in dict_of(self.doc, k) for k in kids):
                todo += [(k, name, own) for k in reversed(kids)]
            else:
                yield name, ref, own | {"Kids": kids}

    def fill(self, values: dict[str, str]) -> None:
        """Values by full field names; buttons take the name of a state.  Read-only and unknown fields stay."""
        done = False
        for name, ref, own in list(self._fields()):
            flags = self.doc.get(own.get("Ff")) or 0
            if (value := values.get(name)) is None or (isinstance(flags, int) and flags & 1):
                continue
            done = True
            if self.doc.get(own.get("FT")) == "Btn":
                self.set(ref, V=Name(value), AS=None if own["Kids"] else Name(value))
                for kid in own["Kids"]:
                    if isinstance(kid, Ref):
                        states = dict_of(self.doc, dict_of(self.doc, dict_of(self.doc, kid).get("AP")).get("N"))
                        self.set(kid, AS=Name(value if value in states else "Off"))
            else:
                self.set(ref, V=utf16(value))
        self._refresh(done)

    def reset(self, names: Iterable[str] | None = None, exclude: bool = False) -> None:
        """Default values for the fields named (or for all others, or for all); without a default the value goes."""
        wanted, done = None if names is None else set(names), False
        for name, ref, own in list(self._fields()):
            if wanted is None or (name in wanted) != exclude:
                done = True
                value = own.get("DV")
                self.set(ref, V=value if value is not None else Name("Off") if self.doc.get(own.get("FT")) == "Btn" else b"")
        self._refresh(done)

    def _refresh(self, done: bool) -> None:
        form = self.doc.catalog.get("AcroForm")
        if done and isinstance(form, Ref):
            self.set(form, NeedAppearances=True)
        elif done:
            self.set(self.root, AcroForm=dict_of(self.doc, form) | {"NeedAppearances": True})

    # outline

    def outline(self, entries: Iterable[tuple[int, str, int | None]]) -> None:
        """A new outline of (depth, title, page from 0) in order; a depth is cut to one below the entry before, and pages that are not there give no target."""
        pages = [ref for ref, _ in self.doc.pages()]
        root, trail = self.put({"Type": Name("Outlines")}), []
        kids: dict[int, list[Ref]] = {root.num: []}
        for depth, title, page in entries:
            depth = max(0, min(depth, len(trail)))
            parent = trail[depth - 1] if depth else root
            item = self.put({"Title": utf16(title or ""), "Parent": parent} | ({"Dest": [pages[page], Name("Fit")]} if page is not None and 0 <= page < len(pages) and pages[page] else {}))
            kids[parent.num].append(item)
            kids[item.num] = []
            trail = [*trail[:depth], item]
        for num in sorted(kids, reverse=True):
            own = kids[num]
            if own:
                self.set(Ref(num, 0), First=own[0], Last=own[-1], Count=len(own))
            for a, b in zip(own, own[1:], strict=False):
                self.set(a, Next=b)
                self.set(b, Prev=a)
        self.set(self.root, Outlines=root)

    # annotations

    def annotate(self, page: int, subtype: str, rect: Iterable[float], contents: str) -> None:
        pages = list(self.doc.pages())
        if 0 <= page < len(pages) and (ref := pages[page][0]):
            mark = self.put({"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": [float(v) for v in rect], "Contents": utf16(contents), "P": ref})
            listed = self.get(self.get(ref).get("Annots"))
            self.set(ref, Annots=[*(listed if isinstance(listed, list) else []), mark])

    def remove_annotations(self, subtype: str | None = None) -> None:
        """All annotations of a kind, or all but form fields' widgets."""
        for ref, _ in self.doc.pages():
            listed = self.get(self.get(ref).get("Annots")) if ref else None
            if isinstance(listed, list):
                kind = [str(dict_of(self.doc, x).get("Subtype") if not isinstance(x, Ref) or x.num not in self.changed else self.changed[x.num].get("Subtype")) for x in listed]
                kept = [x for x, k in zip(listed, kind, strict=True) if (k != subtype if subtype else k == "Widget")]
                if len(kept) < len(listed):
                    self.set(ref, Annots=kept or None)


def closure(doc: Document, start: Any) -> set[int]:
    """Numbers of all objects that a value refers to, directly or not; the way up to a parent is not followed."""
    found, todo = set(), [start]
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            if x.num in found or (value := doc.get(x)) is None:
                continue
            found.add(x.num)
            x = value
        if isinstance(x, Stream):
            x = x.dict
        if isinstance(x, dict):
            todo += [v for k, v in x.items() if k not in ("Parent", "P")]
        elif isinstance(x, list):
            todo += x
    return found
