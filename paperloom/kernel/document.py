"""Opening a document: header, cross-references, objects, page tree (ISO 32000-1, 7.5 and 7.7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from . import filters, security
from .syntax import BLANK, Command, End, Name, Parser, Ref, Stream

#: A run of cross-reference entries as they are usually written, 20 bytes each; the head of an object; the keyword before a stream's bytes.
_ENTRIES = re.compile(BLANK + rb"((?:[0-9]{10} [0-9]{5} [nf](?: [\r\n]|\r\n))*+)").match
_HEAD = re.compile(BLANK + rb"([0-9]{1,18})(?=[\0\t\n\f\r %])" + BLANK + rb"[0-9]{1,18}(?=[\0\t\n\f\r %])" + BLANK + rb"obj(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)").match
_STREAM = re.compile(BLANK + rb"stream(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)").match

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class Document:
    """Random access to one document's objects.

    ``ok`` is false, and everything empty, where no catalog can be found even by
    scanning for objects, or where the password does not open the document.
    """

    def __init__(self, data: bytes, password: bytes = b""):
        self.data, self.cache, self.containers, self.open_ = data, {}, {}, set()
        self.password, self.crypt, self.locked = password, None, False
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        head = re.search(rb"%PDF-(\d+)\.(\d+)", data[:1024])
        self.version = (int(head[1]), int(head[2])) if head else None
        self.rebuilt = False
        start = data.rfind(b"startxref")
        try:
            if start >= 0:
                self._read(int(re.match(rb"startxref\s*(\d+)", data[start:])[1]))
        except (End, TypeError, ValueError, KeyError, IndexError, AttributeError):
            self.entries = {}
        self._unlock()
        if not self.locked and (not isinstance(self.catalog, dict) or not isinstance(self.get(self.catalog.get("Pages")), dict)):
            self._rebuild()
        self.ok = isinstance(self.catalog, dict) and isinstance(self.get(self.catalog.get("Pages")), dict)

    @property
    def catalog(self) -> Any:
        return self.get(self.trailer.get("Root"))

    def _unlock(self) -> None:
        """Find the key of an encrypted document; without it, nothing in it is read."""
        if self.crypt is None and isinstance(d := security.resolved(self.get, self.trailer.get("Encrypt")), dict):
            ids = self.get(self.trailer.get("ID"))
            first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
            self.crypt = security.unlock(d, first if isinstance(first, bytes) else b"", self.password)
            self.cache, self.containers = {}, {}
            if self.crypt is None:
                self.locked, self.entries = True, {}

    def _read(self, at: int) -> None:
        """The newest cross-reference section, and those before it; the first entry of a number counts."""
        done = set()
        while at is not None and at not in done:
            done.add(at)
            p = Parser(self.data, at)
            if self.data[at : at + 4].strip() == b"xref" or self.data[at:].lstrip()[:4] == b"xref":
                p.lexer.token()
                while isinstance(first := p.object(), int):
                    n = p.object()
                    whole = _ENTRIES(self.data, p.lexer.at)
                    plain = min(n, len(whole[1]) // 20)
                    if plain > 0:
                        said = self.data[whole.start(1) : whole.start(1) + 20 * plain].split()
                        found = [("n", int(a), int(g)) if kind == b"n" else ("f",) for a, g, kind in zip(said[::3], said[1::3], said[2::3], strict=True)]
                        for num, entry in enumerate(found, first):
                            self.entries.setdefault(num, entry)
                        p.lexer.at = whole.start(1) + 20 * plain
                    for i in range(max(plain, 0), n):
                        offset, gen, kind = p.lexer.token(), p.lexer.token(), p.lexer.token()
                        self.entries.setdefault(first + i, ("n", offset, gen) if kind == "n" else ("f",))
                trailer = p.object()
                if isinstance(extra := trailer.get("XRefStm"), int):
                    self._section(extra)
            else:
                trailer = self._section(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            at = trailer.get("Prev")

    def _section(self, at: int) -> dict:
        stream = self._indirect(at)[1]
        d, data = stream.dict, self.decoded(stream)
        sizes = d["W"]
        index = d.get("Index", [0, d["Size"]])
        width = sum(sizes)
        row = 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for i in range(n):
                raw, fields = data[row * width : (row + 1) * width], []
                row += 1
                for size in sizes:
                    fields.append(int.from_bytes(raw[:size], "big"))
                    raw = raw[size:]
                kind = fields[0] if sizes[0] else 1
                self.entries.setdefault(first + i, ("n", fields[1], fields[2]) if kind == 1 else ("c", fields[1], fields[2]) if kind == 2 else ("f",))
        return d

    def _rebuild(self) -> None:
        """Find objects and trailers by their keywords; later ones count."""
        self.rebuilt, self.cache, self.containers, self.entries, self.trailer = True, {}, {}, {}, {}
        for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b", self.data):
            self.entries[int(m[1])] = ("n", m.start(1), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                if isinstance(d := Parser(self.data, m.end()).object(), dict):
                    self.trailer |= d
            except End:
                pass
        self._unlock()
        for num in list(self.entries):
            x = self.get(Ref(num, 0))
            if isinstance(x, Stream) and x.dict.get("Type") == "ObjStm":
                for k, n in enumerate(self._numbers(x)):
                    self.entries.setdefault(n, ("c", num, k))
            elif isinstance(x, Stream) and x.dict.get("Type") == "XRef":
                self.trailer = x.dict | self.trailer
                self._unlock()
        if not isinstance(self.catalog, dict):
            for num in self.entries:
                x = self.get(Ref(num, 0))
                if isinstance(x, dict) and x.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)

    def _indirect(self, at: int) -> tuple[int, Any]:
        p = Parser(self.data, at)
        if head := _HEAD(self.data, at):
            num, p.lexer.at = int(head[1]), head.end()
        else:
            num, _, word = p.lexer.token(), p.lexer.token(), p.lexer.token()
            if word != "obj" or not isinstance(num, int):
                raise ValueError("no object here")
        x = p.object()
        if isinstance(x, Command):
            return num, None
        if isinstance(x, dict):
            if follows := _STREAM(self.data, p.lexer.at):
                here = follows.end()
                here += 2 if self.data[here : here + 2] == b"\r\n" else 1
                length = self.get(x.get("Length"))
                end = here + length if isinstance(length, int) else -1
                if end < here or not self.data[end : end + 20].lstrip().startswith(b"endstream"):
                    end = self.data.find(b"endstream", here)
                    end = len(self.data) if end < 0 else end
                    end -= self.data[here:end].endswith(b"\n")
                    end -= self.data[here:end].endswith(b"\r")
                return num, Stream(x, self.data[here:end])
        return num, x

    def _container(self, num: int) -> tuple[bytes, list[int]]:
        """An object stream's bytes and where each object starts in them; decoded once."""
        if num not in self.containers:
            holder = self.get(Ref(num, 0))
            body = self.decoded(holder) or b""
            p, first = Parser(body), self.get(holder.dict["First"])
            self.containers[num] = body, [first + (p.lexer.token(), p.lexer.token())[1] for _ in range(self.get(holder.dict["N"]))]
        return self.containers[num]

    def _numbers(self, stream: Stream) -> list[int]:
        p = Parser(self.decoded(stream) or b"")
        try:
            return [(p.lexer.token(), p.lexer.token())[0] for _ in range(self.get(stream.dict.get("N")) or 0)]
        except End:
            return []

    def get(self, x: Any) -> Any:
        """The object behind a reference; null where there is none, or in a cycle."""
        while isinstance(x, Ref):
            if x.num in self.cache:
                return self.cache[x.num]
            entry = self.entries.get(x.num)
            if entry is None or entry[0] == "f" or x.num in self.open_:
                return None
            self.open_.add(x.num)
            try:
                if entry[0] == "n":
                    num, value = self._indirect(entry[1])
                    if num != x.num:
                        value = None
                    if self.crypt and x != self.trailer.get("Encrypt"):
                        value = self.crypt.apply(value, num, entry[2])
                else:
                    body, places = self._container(entry[1])
                    value = Parser(body, places[entry[2]]).object()
            except (End, ValueError, KeyError, IndexError, AttributeError, TypeError):
                value = None
            finally:
                self.open_.discard(x.num)
            self.cache[x.num] = value
            x = value
        return x

    def decoded(self, stream: Stream) -> bytes | None:
        names = self.get(stream.dict.get("Filter", stream.dict.get("F")))
        params = self.get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        names = [] if names is None else names if isinstance(names, list) else [names]
        params = params if isinstance(params, list) else [params] * len(names)
        read = [{k: self.get(v) for k, v in (self.get(p) or {}).items()} for p in params] + [{}] * len(names)
        return filters.decode(stream.raw, [str(self.get(n)) for n in names], read[: len(names)])

    def pages(self) -> Iterator[tuple[Ref | None, dict]]:
        """Pages in order, with the attributes that they inherit."""
        if not self.ok:
            return
        todo, seen = [(self.catalog.get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            own = above | {k: self.get(node[k]) for k in INHERITED if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                todo += [(k, own) for k in reversed(kids)]
            else:
                yield ref if isinstance(ref, Ref) else None, own | {k: v for k, v in node.items() if k not in INHERITED}

    def contents(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        streams = [self.get(x) for x in parts] if isinstance(parts, list) else [parts]
        return b"\n".join(self.decoded(s) or b"" for s in streams if isinstance(s, Stream))

    def info(self) -> dict[str, str]:
        found = self.get(self.trailer.get("Info"))
        return {k: text(v) for k, x in found.items() if isinstance(v := self.get(x), bytes)} if isinstance(found, dict) else {}

    def objects(self) -> Iterator[tuple[int, Any]]:
        for num in sorted(self.entries):
            if self.entries[num][0] != "f":
                yield num, self.get(Ref(num, 0))

    def outline(self) -> Iterator[tuple[int, int | None, int, int, str]]:
        """(node, parent, depth, position, title) of the outline tree, in order."""
        root = self.get((self.catalog or {}).get("Outlines"))
        if not isinstance(root, dict):
            return
        todo, seen, node = [(root.get("First"), None, 0, 0)], set(), 0
        while todo:
            ref, parent, depth, position = todo.pop()
            item = self.get(ref)
            if not isinstance(item, dict) or ref in seen:
                continue
            seen.add(ref)
            yield node, parent, depth, position, text(self.get(item.get("Title")) or b"")
            todo.append((item.get("Next"), parent, depth, position + 1))
            todo.append((item.get("First"), node, depth + 1, 0))
            node += 1


def text(raw: bytes) -> str:
    """A text string: UTF-16 with a mark, or else one byte a character (Latin-1 where it agrees)."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    return raw.decode("latin-1")


def name_of(x: Any) -> str | None:
    return str(x) if isinstance(x, Name) else None
