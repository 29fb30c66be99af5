"""Stream filters (ISO 32000-1, 7.4): decoders that keep what they can read, and encoders."""

from __future__ import annotations

import base64
import zlib

import numpy as np


def hex_decode(data: bytes) -> bytes:
    digits = bytes(c for c in data.partition(b">")[0] if c in b"0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def hex_encode(data: bytes) -> bytes:
    return data.hex().encode() + b">"


def ascii85_decode(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (_base85(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        out += (_base85(group + [84] * (5 - len(group))) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = value * 85 + d
    return value


def ascii85_encode(data: bytes) -> bytes:
    return base64.a85encode(data) + b"~>"


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out) + b"\x80"


def _lzw_widths(first: int) -> np.ndarray:
    """Bits of the codes since the table was cleared: it grows by one with each, so that their place gives their width."""
    sizes = first + np.arange(4_096)
    return 9 + sum((sizes >= x).astype(np.int64) for x in (512, 1024, 2048))


#: Widths that an encoder has before each code, and a decoder by EarlyChange; at the start, a decoder's table lags by one.
_WRITTEN = _lzw_widths(258)
_READ = {early: np.concatenate([[9], _lzw_widths(258 + early)[:-1]]) for early in (0, 1)}


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """The codes up to the next clearing are cut out together."""
    out: list[bytes] = []
    raw, total, at = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(data), 0
    table, before, known = [bytes([i]) for i in range(256)] + [b"", b""], b"", _READ[early] if early in _READ else np.concatenate([[9], _lzw_widths(258 + early)[:-1]])
    widths = known
    while True:
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, "right"))
        if not n:
            break
        starts, size = ends[:n] - widths[:n], widths[:n]
        place = starts >> 3
        codes = ((raw[place] << 16 | raw[place + 1] << 8 | raw[place + 2]) >> 24 - size - (starts & 7)) & (1 << size) - 1
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else None
        length = len(table)
        for code in codes[:stop].tolist():
            if code < length:
                entry = table[code]
            elif code == length and before:
                entry = before + before[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if before and length < 4_096:
                table.append(before + entry[:1])
                length += 1
            before = entry
        if stop is None and n < len(widths) or stop is not None and codes[stop] == 257:
            break
        at = int(ends[n - 1 if stop is None else stop])
        if stop is None:
            widths = np.full(4_096, 12)
        else:
            del table[258:]
            before, widths = b"", known
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Strings are known by the code of all but their last byte, and that byte; the bits are put together at the end."""
    codes, widths = [256], [np.array([9])]
    put, table, size, code = codes.append, {}, 258, -1
    for c in data:
        if code < 0:
            code = c
            continue
        key = code << 8 | c
        if key in table:
            code = table[key]
            continue
        put(code)
        table[key] = size
        size += 1
        code = c
        if size >= 4_095:
            put(256)
            widths += [_WRITTEN[: size - 258], [12]]
            table, size = {}, 258
    if code >= 0:
        put(code)
        widths += [_WRITTEN[: size - 257], [9 + sum(size + 1 >= x for x in (512, 1024, 2048))]]
    else:
        widths.append([9])
    put(257)
    every, sizes = np.array(codes), np.concatenate(widths)
    bits = (every[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - sizes[:, None]].astype(np.uint8)).tobytes()


def flate_decode(data: bytes) -> bytes:
    """Inflate; of damaged data, what comes before the damage."""
    for window in (15, -15):
        worker, out = zlib.decompressobj(window), bytearray()
        try:
            return worker.decompress(data)
        except zlib.error:
            worker = zlib.decompressobj(window)
            for i in range(0, len(data), 64):
                try:
                    out += worker.decompress(data[i : i + 64])
                except zlib.error:
                    break
            if out:
                return bytes(out)
    return b""


def unpredict(data: bytes, predictor: int, colors: int = 1, depth: int = 8, columns: int = 1) -> bytes:
    """Undo PNG (10 and more) and TIFF (2) prediction."""
    if predictor < 2:
        return data
    step, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out, before = bytearray(), bytearray(width)
    if predictor == 2:
        for at in range(0, len(data), width):
            row = bytearray(data[at : at + width])
            if depth == 8:
                for i in range(step, len(row)):
                    row[i] = row[i] + row[i - step] & 255
            out += row
        return bytes(out)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            a, b, c = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if kind == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            row[i] = row[i] + guess & 255
        out += row
        before = row
    return bytes(out)


DECODERS = {"ASCIIHexDecode": hex_decode, "AHx": hex_decode, "ASCII85Decode": ascii85_decode, "A85": ascii85_decode, "RunLengthDecode": run_length_decode, "RL": run_length_decode, "FlateDecode": flate_decode, "Fl": flate_decode, "LZWDecode": lzw_decode, "LZW": lzw_decode}
ENCODERS = {"ASCIIHexDecode": hex_encode, "ASCII85Decode": ascii85_encode, "RunLengthDecode": run_length_encode, "LZWDecode": lzw_encode, "FlateDecode": zlib.compress}


def decode(raw: bytes, filters: list[str], params: list[dict]) -> bytes | None:
    """The decoded bytes, or None where a filter isn't supported."""
    for name, p in zip(filters, params, strict=True):
        if name not in DECODERS:
            return None
        raw = lzw_decode(raw, p.get("EarlyChange", 1)) if name in ("LZWDecode", "LZW") else DECODERS[name](raw)
        if p.get("Predictor", 1) > 1:
            raw = unpredict(raw, p["Predictor"], p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
    return raw
