"""Tokens and objects of the PDF syntax (ISO 32000-1, 7.2 and 7.3)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

WHITE = frozenset(b"\0\t\n\f\r ")
DELIMITERS = frozenset(b"()<>[]{}/%")
MAX_DEPTH = 500


class Name(str):
    """A name object."""


class Command(str):
    """A keyword: an operator of a content stream, or obj, stream, R and so on."""


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes = field(repr=False)


class End(Exception):
    """No token is left."""


#: White space and comments; what may follow a token that is read at once.
BLANK = rb"[\0\t\n\f\r ]*+(?:%[^\r\n]*+[\0\t\n\f\r ]*+)*+"
_END = rb"(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)"
#: Plain tokens: 1 whole number, 2 name, 3 string, 4 bracket, 5 keyword, 6 real number; others are read byte by byte.
_WHOLE = rb"([0-9]{1,18})" + _END
_PLAIN = rb"|/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)(?!#)|\(([^()\\\r]*+)\)|(<<|>>|[\[\]{}])|([^\0\t\n\f\r ()<>\[\]{}/%+\-.0-9][^\0\t\n\f\r ()<>\[\]{}/%]*+)|([+-]?(?:[0-9]{1,18}\.[0-9]{0,18}|\.[0-9]{1,18}))" + _END
_skip = re.compile(BLANK).match
_token = re.compile(BLANK + rb"(?:" + _WHOLE + _PLAIN + rb")?").match
#: The same, where a number that is not followed by half a reference can only be a number; then 7 and 8, a reference.
_object = re.compile(BLANK + rb"(?:" + _WHOLE + rb"(?=" + BLANK + rb"(?:[^+\-.0-9)>]|>>|\Z|[0-9]{1,18}" + _END + BLANK + rb"(?:[^R)>]|>>|\Z|R[^\0\t\n\f\r ()<>\[\]{}/%])))" + _PLAIN + rb"|([0-9]{1,18})" + _END + BLANK + rb"([0-9]{1,18})" + _END + BLANK + rb"R" + _END + rb")?").match
_CONSTANTS = {"true": True, "false": False, "null": None}


@lru_cache(4_096)
def _name_of(raw: bytes) -> Name:
    return Name(raw.decode("latin-1"))


@lru_cache(4_096)
def _key_of(raw: bytes) -> str:
    return raw.decode("latin-1")


@lru_cache(1_024)
def _command_of(raw: bytes) -> Command:
    return Command(raw.decode("latin-1"))


#: Values that are one token, by their place in the patterns above.
_AT_ONCE = {1: lambda m: int(m[1]), 2: lambda m: _name_of(m[2]), 3: lambda m: m[3], 6: lambda m: float(m[6]), 8: lambda m: Ref(int(m[7]), int(m[8]))}
#: A string whose escapes stand for one character each.
_escaped = re.compile(rb"\(((?:[^()\\\r]|\\[^0-7\r\n])*+)\)").match
_escape = re.compile(rb"\\(.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Lexer:
    """Reads tokens; malformed ones become what is left of them, never an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _skip(self.data, self.at).end()

    def token(self) -> Any:
        m = _token(self.data, self.at)
        kind = m.lastindex
        if kind is None:
            return self._slow()
        self.at = m.end()
        raw = m[kind]
        return int(raw) if kind == 1 else _name_of(raw) if kind == 2 else raw if kind == 3 else float(raw) if kind == 6 else _command_of(raw)

    def _slow(self) -> Any:
        self.skip()
        d, at, n = self.data, self.at, len(self.data)
        if at >= n:
            raise End
        c = d[at]
        if c in b"[]{}":
            self.at = at + 1
            return Command(chr(c))
        if c == 0x28:
            return self._string()
        if c == 0x2F:
            return self._name()
        if c in b"<>":
            if d[at + 1 : at + 2] == bytes([c]):
                self.at = at + 2
                return Command(chr(c) * 2)
            if c == 0x3C:
                return self._hex()
            self.at = at + 1
            return self.token()
        if c == 0x29:
            self.at = at + 1
            return self.token()
        end = at
        while end < n and d[end] not in WHITE and d[end] not in DELIMITERS:
            end += 1
        self.at = end
        word = d[at:end]
        return self._number(word) if c in b"+-.0123456789" else Command(word.decode("latin-1"))

    @staticmethod
    def _number(word: bytes) -> int | float | Command:
        try:
            if b"." not in word:
                value = int(word)
                return value if abs(value) < 1 << 63 else float(value)
            return float(word)
        except ValueError:
            digits = bytearray()
            for i, c in enumerate(word):  # as much as reads as a number
                if c in b"0123456789" or c == 0x2E and 0x2E not in digits or c in b"+-" and not i:
                    digits.append(c)
                elif c not in b"+-":
                    break
            try:
                return float(digits) if b"." in digits else int(digits)
            except ValueError:
                return 0 if digits else Command(word.decode("latin-1"))

    def _string(self) -> bytes:
        d, at, n, depth, out = self.data, self.at + 1, len(self.data), 1, bytearray()
        end = d.find(b")", at)
        if end >= 0 and not any(x in d[at:end] for x in (b"\\", b"(", b"\r")):  # the common case, at once
            self.at = end + 1
            return d[at:end]
        if m := _escaped(d, self.at):
            self.at = m.end()
            return _escape.sub(lambda x: _ESCAPES.get(x[1], x[1]), m[1])
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while at < n:
            c = d[at]
            at += 1
            if c == 0x5C:
                if at >= n:
                    break
                c = d[at]
                at += 1
                if c in b"01234567":
                    value, k = c - 48, 1
                    while k < 3 and at < n and d[at] in b"01234567":
                        value, at, k = value * 8 + d[at] - 48, at + 1, k + 1
                    out.append(value & 255)
                elif c == 13:
                    at += d[at : at + 1] == b"\n"
                elif c != 10:
                    out.append(plain.get(c, c))
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 13:
                at += d[at : at + 1] == b"\n"
                c = 10
            out.append(c)
        self.at = at
        return bytes(out)

    def _name(self) -> Name:
        d, at = self.data, self.at + 1
        end = at
        while end < len(d) and d[end] not in WHITE and d[end] not in DELIMITERS:
            end += 1
        self.at, raw, out, i = end, d[at:end], bytearray(), 0
        while i < len(raw):
            try:
                if raw[i] == 0x23:
                    out.append(int(raw[i + 1 : i + 3].decode(), 16) if len(raw) >= i + 3 else 0x23)
                    i += 3 if len(raw) >= i + 3 else 1
                    continue
            except ValueError:
                pass
            out.append(raw[i])
            i += 1
        return Name(out.decode("latin-1"))

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = bytes(c for c in self.data[self.at + 1 : end] if c in b"0123456789abcdefABCDEF")
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Parser:
    """Objects from tokens, with one token of look-ahead for references."""

    def __init__(self, data: bytes, at: int = 0):
        self.lexer = Lexer(data, at)

    def object(self, depth: int = 0) -> Any:
        lexer = self.lexer
        m = _object(lexer.data, lexer.at)
        kind = m.lastindex
        if kind is None:
            token = lexer.token()
            if not isinstance(token, Command):
                return self._maybe_ref(token) if isinstance(token, int) and token >= 0 else token
        else:
            lexer.at = m.end()
            if kind == 8:
                return Ref(int(m[7]), int(m[8]))
            raw = m[kind]
            if kind < 4:
                return int(raw) if kind == 1 else _name_of(raw) if kind == 2 else raw
            if kind == 6:
                return float(raw)
            token = _command_of(raw)
        if depth > MAX_DEPTH:
            return None
        if token == "[":
            out = []
            try:
                while (kind := (m := _object(lexer.data, lexer.at)).lastindex) in _AT_ONCE:
                    lexer.at = m.end()
                    out.append(_AT_ONCE[kind](m))
                while (x := self.object(depth + 1)) != "]" or not isinstance(x, Command):
                    if not isinstance(x, Command):
                        out.append(x)
                    elif x in (">>", "endobj"):
                        break
            except End:
                pass
            return out
        if token == "<<":
            out = {}
            try:
                while True:
                    m = _token(lexer.data, lexer.at)
                    if m.lastindex == 2:  # a name and a plain value
                        lexer.at = m.end()
                        key = _key_of(m[2])
                        m = _object(lexer.data, lexer.at)
                        if (kind := m.lastindex) in _AT_ONCE:
                            lexer.at = m.end()
                            out[key] = _AT_ONCE[kind](m)
                            continue
                        key = Name(key)
                    else:
                        key = lexer.token()
                    if isinstance(key, Command) and key in (">>", "endobj", "stream"):
                        break
                    if isinstance(key, Name):
                        value = self.object(depth + 1)
                        if isinstance(value, Command):
                            if value == ">>":
                                break
                            value = None
                        out[str(key)] = value
            except End:
                pass
            return out
        return _CONSTANTS.get(token, token)

    def _maybe_ref(self, num: int) -> int | Ref:
        at = self.lexer.at
        try:
            gen = self.lexer.token()
            if isinstance(gen, int) and not isinstance(gen, bool) and self.lexer.token() == Command("R") and self.lexer.data[self.lexer.at - 1 : self.lexer.at] == b"R":
                return Ref(num, gen)
        except End:
            pass
        self.lexer.at = at
        return num


_DELIMITED = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%#]|[^!-~]")


@lru_cache(4_096)
def _written_name(x: str) -> bytes:
    return b"/" + _DELIMITED.sub(lambda m: b"#%02X" % m[0][0], x.encode("latin-1", "replace"))


def _written_bytes(x: bytes) -> bytes:
    return b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def _written_dict(x: dict) -> bytes:
    return b"<<" + b" ".join([_written_name(k) + b" " + (_WRITTEN.get(type(v)) or write)(v) for k, v in x.items()]) + b">>"


def _written_list(x: list) -> bytes:
    return b"[" + b" ".join([(_WRITTEN.get(type(v)) or write)(v) for v in x]) + b"]"


#: How values of these very types are written; those of types made from them take the long way.
_WRITTEN = {
    type(None): lambda x: b"null",
    bool: lambda x: b"true" if x else b"false",
    Ref: lambda x: b"%d %d R" % x,
    int: lambda x: b"%d" % x,
    Name: _written_name,
    str: _written_name,
    bytes: _written_bytes,
    dict: _written_dict,
    list: _written_list,
    tuple: _written_list,
    Stream: lambda x: _written_dict({**x.dict, "Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream",
}


def write(x: Any) -> bytes:
    """The syntax of an object; a stream is its dictionary and bytes."""
    if known := _WRITTEN.get(type(x)):
        return known(x)
    if isinstance(x, float):
        return (b"%.6f" % x).rstrip(b"0").rstrip(b".") or b"0"
    if isinstance(x, Command):
        return x.encode("latin-1", "replace")
    if isinstance(x, str):
        return _written_name(str(x))
    if isinstance(x, bytearray):
        return _written_bytes(bytes(x))
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, (list, tuple)):
        return _written_list(list(x))
    if isinstance(x, Stream):
        return _WRITTEN[Stream](x)
    return _written_dict(x)
