"""The standard security handler, revisions 2 to 6 (ISO 32000-2, 7.6): RC4, and AES with keys of 128 and 256 bits.

The ciphers are those of the library that Python's own hashes come from, where it has them.
Without it, decryption by AES runs over all blocks at once with numpy, and encryption chains
block by block, as does the hash of revision 6, which takes about a second for each password.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np

from .syntax import Name, Ref, Stream

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class Native:
    """RC4 and AES of the library that Python's own hashes come from; ``known`` only where it has them and they give what they should."""

    def __init__(self):
        self.known = False
        try:
            import _hashlib

            own = ctypes.CDLL(_hashlib.__file__)
            self._rc4_key, self._rc4, self._to, self._fro, self._cbc = own.RC4_set_key, own.RC4, own.AES_set_encrypt_key, own.AES_set_decrypt_key, own.AES_cbc_encrypt
            p, n = ctypes.c_char_p, ctypes.c_size_t
            self._rc4_key.argtypes, self._rc4_key.restype = (p, ctypes.c_int, p), None
            self._rc4.argtypes, self._rc4.restype = (p, n, p, p), None
            self._to.argtypes = self._fro.argtypes = (p, ctypes.c_int, p)
            self._cbc.argtypes, self._cbc.restype = (p, p, n, p, p, ctypes.c_int), None
            block = bytes.fromhex("00112233445566778899aabbccddeeff")
            sealed = bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
            self.known = self.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and self.cbc(bytes(range(16)), bytes(16), block, True) == sealed and self.cbc(bytes(range(16)), bytes(16), sealed, False) == block
        except (ImportError, OSError, AttributeError):
            pass

    def rc4(self, key: bytes, data: bytes) -> bytes:
        state, out = ctypes.create_string_buffer(4_096), ctypes.create_string_buffer(len(data) or 1)
        self._rc4_key(state, len(key), key)
        self._rc4(state, len(data), data, out)
        return out.raw[: len(data)]

    def cbc(self, key: bytes, iv: bytes, data: bytes, seal: bool) -> bytes:
        state, out, chain = ctypes.create_string_buffer(1_024), ctypes.create_string_buffer(len(data) or 1), ctypes.create_string_buffer(iv, 16)
        (self._to if seal else self._fro)(key, 8 * len(key), state)
        self._cbc(data, out, len(data), state, chain, int(seal))
        return out.raw[: len(data)]


NATIVE = Native()


def rc4(key: bytes, data: bytes) -> bytes:
    return NATIVE.rc4(key, data) if NATIVE.known and key else plain_rc4(key, data)


def plain_rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = (j + a + k) & 255
        s[i] = s[j]
        s[j] = a
    j, n = 0, len(data)
    out = bytearray()
    put = out.append
    for first in range(0, n, 256):
        for i in range(1, min(257, n - first + 1)):
            a = s[i & 255]
            j = (j + a) & 255
            b = s[i & 255] = s[j]
            s[j] = a
            put(s[(a + b) & 255])
    return (int.from_bytes(out, "big") ^ int.from_bytes(data, "big")).to_bytes(n, "big")


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    power = [1]
    for _ in range(254):
        power.append(_times(power[-1], 3))
    inverse = [0] * 256
    for i, x in enumerate(power):
        inverse[x] = power[-i % 255]
    turned = lambda x, k: (x << k | x >> 8 - k) & 255
    box = [x ^ turned(x, 1) ^ turned(x, 2) ^ turned(x, 3) ^ turned(x, 4) ^ 0x63 for x in inverse]
    back = [0] * 256
    for i, x in enumerate(box):
        back[x] = i
    return box, back


BOX, BACK = _boxes()
_UNBOX = np.array(BACK, np.uint8)
_UNMIX = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
_UNSHIFT = np.array([4 * ((c - r) % 4) + r for c in range(4) for r in range(4)])
#: For each row of a column, what a byte there adds to the mixed column, as a 32-bit word.
_MIX = [[int.from_bytes(bytes(_times(BOX[x], (2, 1, 1, 3)[(k - r) % 4]) for k in range(4)), "big") for x in range(256)] for r in range(4)]


@lru_cache(256)
def _schedule(key: bytes) -> tuple[int, ...]:
    """Round keys, as 32-bit words."""
    n = len(key) // 4
    w, turn = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)], 1
    sub = lambda x: BOX[x >> 24] << 24 | BOX[x >> 16 & 255] << 16 | BOX[x >> 8 & 255] << 8 | BOX[x & 255]
    for i in range(n, 4 * (n + 7)):
        x = w[-1]
        if i % n == 0:
            x, turn = sub((x << 8 | x >> 24) & 0xFFFFFFFF) ^ turn << 24, _times(turn, 2)
        elif n > 6 and i % n == 4:
            x = sub(x)
        w.append(w[i - n] ^ x)
    return tuple(w)


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Chained encryption of whole blocks."""
    known = NATIVE.known and len(key) in (16, 32) and len(iv) == 16 and len(data) % 16 == 0
    return NATIVE.cbc(key, iv, data, True) if known else plain_encrypt(key, iv, data)


def plain_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    w, out = _schedule(key), bytearray()
    m0, m1, m2, m3 = _MIX
    box, last = BOX, len(w) - 4
    p = int.from_bytes(iv, "big")
    for at in range(0, len(data), 16):
        p ^= int.from_bytes(data[at : at + 16], "big")
        a, b, c, d = (p >> 96) ^ w[0], (p >> 64 & 0xFFFFFFFF) ^ w[1], (p >> 32 & 0xFFFFFFFF) ^ w[2], (p & 0xFFFFFFFF) ^ w[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                m0[a >> 24] ^ m1[b >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[d & 255] ^ w[k],
                m0[b >> 24] ^ m1[c >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[a & 255] ^ w[k + 1],
                m0[c >> 24] ^ m1[d >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[b & 255] ^ w[k + 2],
                m0[d >> 24] ^ m1[a >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[c & 255] ^ w[k + 3],
            )
        p = 0
        for k, (e, f, g, h) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
            p = p << 32 | ((box[e >> 24] << 24 | box[f >> 16 & 255] << 16 | box[g >> 8 & 255] << 8 | box[h & 255]) ^ w[last + k])
        out += p.to_bytes(16, "big")
    return bytes(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Chained decryption of whole blocks; a broken last one is left out."""
    known = NATIVE.known and len(key) in (16, 32) and len(iv) == 16
    return NATIVE.cbc(key, iv, data[: len(data) // 16 * 16], False) if known else plain_decrypt(key, iv, data)


def plain_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    n = len(data) // 16
    if n < FEW:
        return _decrypt_few(key, iv, data[: 16 * n])
    keys = np.frombuffer(b"".join(x.to_bytes(4, "big") for x in _schedule(key)), np.uint8).reshape(-1, 16)
    blocks = np.frombuffer(data[: 16 * n], np.uint8).reshape(n, 16)
    s = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        s = _UNBOX[s[:, _UNSHIFT]] ^ keys[k]
        if k:
            a = s.reshape(n, 4, 4)
            s = np.stack([_UNMIX[14][a[:, :, r]] ^ _UNMIX[11][a[:, :, (r + 1) % 4]] ^ _UNMIX[13][a[:, :, (r + 2) % 4]] ^ _UNMIX[9][a[:, :, (r + 3) % 4]] for r in range(4)], axis=2).reshape(n, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], blocks[:-1]])
    return (s ^ before).tobytes()


#: Fewer blocks than this are decrypted one by one.
FEW = 12
#: As _MIX, of the inverse: what a byte adds to the column before mixing.
_REMIX = [[int.from_bytes(bytes(_times(x, (14, 9, 13, 11)[(k - r) % 4]) for k in range(4)), "big") for x in range(256)] for r in range(4)]
_UNDO = [[m[BACK[x]] for x in range(256)] for m in _REMIX]


@lru_cache(256)
def _back_schedule(key: bytes) -> tuple[int, ...]:
    """Round keys in the order of decryption, those between the first and the last unmixed."""
    w = _schedule(key)
    a, b, c, d = _REMIX
    turned = [w[k : k + 4] for k in range(len(w) - 4, -1, -4)]
    return tuple(x if i in (0, len(turned) - 1) else a[x >> 24] ^ b[x >> 16 & 255] ^ c[x >> 8 & 255] ^ d[x & 255] for i, four in enumerate(turned) for x in four)


def _decrypt_few(key: bytes, iv: bytes, data: bytes) -> bytes:
    w, out, before = _back_schedule(key), bytearray(), int.from_bytes(iv, "big")
    m0, m1, m2, m3 = _UNDO
    last = len(w) - 4
    for at in range(0, len(data), 16):
        block = int.from_bytes(data[at : at + 16], "big")
        a, b, c, d = (block >> 96) ^ w[0], (block >> 64 & 0xFFFFFFFF) ^ w[1], (block >> 32 & 0xFFFFFFFF) ^ w[2], (block & 0xFFFFFFFF) ^ w[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                m0[a >> 24] ^ m1[d >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[b & 255] ^ w[k],
                m0[b >> 24] ^ m1[a >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[c & 255] ^ w[k + 1],
                m0[c >> 24] ^ m1[b >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[d & 255] ^ w[k + 2],
                m0[d >> 24] ^ m1[c >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[a & 255] ^ w[k + 3],
            )
        p = 0
        for k, (e, f, g, h) in enumerate(((a, d, c, b), (b, a, d, c), (c, b, a, d), (d, c, b, a))):
            p = p << 32 | ((BACK[e >> 24] << 24 | BACK[f >> 16 & 255] << 16 | BACK[g >> 8 & 255] << 8 | BACK[h & 255]) ^ w[last + k])
        out += (p ^ before).to_bytes(16, "big")
        before = block
    return bytes(out)


def padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


def hardened(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """The hash of revisions 5 and 6 (algorithm 2.B)."""
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while revision > 5:
        n += 1
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        if n >= 64 and e[-1] <= n - 32:
            break
    return k[:32]


class Crypt:
    """A document's file key, and how its strings and streams are encrypted."""

    def __init__(self, key: bytes, strings: str, streams: str, metadata: bool = True, permissions: int = -1, owner: bool = False):
        self.key, self.strings, self.streams, self.metadata, self.permissions, self.owner = key, strings, streams, metadata, permissions, owner

    def _key(self, method: str, num: int, gen: int) -> bytes:
        if method == "AESV3":
            return self.key
        salt = b"sAlT" if method == "AESV2" else b""
        return hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + salt).digest()[: min(len(self.key) + 5, 16)]

    def _one(self, data: bytes, method: str, num: int, gen: int, seal: bool) -> bytes:
        if method == "Identity":
            return data
        key = self._key(method, num, gen)
        if method == "V2":
            return rc4(key, data)
        if seal:
            iv = os.urandom(16)
            return iv + aes_encrypt(key, iv, padded(data))
        return unpadded(aes_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""

    def apply(self, x: Any, num: int, gen: int, seal: bool = False) -> Any:
        """An indirect object with all its strings and its stream decrypted, or with ``seal`` encrypted."""
        if isinstance(x, bytes):
            return self._one(x, self.strings, num, gen, seal)
        if isinstance(x, list):
            return [self.apply(v, num, gen, seal) for v in x]
        if isinstance(x, dict):
            return {k: self.apply(v, num, gen, seal) for k, v in x.items()}
        if isinstance(x, Stream):
            kind, names = x.dict.get("Type"), x.dict.get("Filter")
            plain = kind == "XRef" or kind == "Metadata" and not self.metadata or "Crypt" in (names if isinstance(names, list) else [names])
            return Stream(x.dict if kind == "XRef" else self.apply(x.dict, num, gen, seal), x.raw if plain else self._one(x.raw, self.streams, num, gen, seal))
        return x


def _padded_password(password: bytes) -> bytes:
    return (password + PAD)[:32]


@lru_cache(64)
def _owner_key(password: bytes, revision: int, size: int) -> bytes:
    k = hashlib.md5(_padded_password(password)).digest()
    for _ in range(50 if revision > 2 else 0):
        k = hashlib.md5(k).digest()
    return k[:size]


@lru_cache(64)
def _owner_turns(key: bytes, data: bytes, down: bool) -> bytes:
    """The owner's entry of a password, or back; the same for all documents of the same passwords."""
    return _turns(key, data, range(19, -1, -1) if down else range(20))


def _turns(key: bytes, data: bytes, order: range) -> bytes:
    for i in order:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


def _old_key(password: bytes, d: dict, first_id: bytes, size: int) -> bytes:
    revision = d["R"]
    k = hashlib.md5(_padded_password(password) + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"\xff" * 4 if revision > 3 and d.get("EncryptMetadata") is False else b"")).digest()
    for _ in range(50 if revision > 2 else 0):
        k = hashlib.md5(k[:size]).digest()
    return k[:size]


def _old_user(key: bytes, revision: int, first_id: bytes) -> bytes:
    return rc4(key, PAD) if revision < 3 else _turns(key, hashlib.md5(PAD + first_id).digest(), range(20))


def unlock(d: dict, first_id: bytes, password: bytes) -> Crypt | None:
    """By the owner's password or else by the user's; null where neither fits or the handler is not known."""
    try:
        version, revision = d.get("V", 0), d["R"]
        if d.get("Filter") != "Standard" or version not in (1, 2, 4, 5) or revision not in range(2, 7):
            return None
        strings = streams = "V2"
        size = 5 if version == 1 else (d.get("Length") or 40) // 8
        if version > 3:
            ways = {k: (v.get("CFM") or "Identity").replace("None", "Identity") for k, v in (d.get("CF") or {}).items()}
            streams, strings = (ways.get(d.get(k) or "Identity", "Identity") for k in ("StmF", "StrF"))
            size = 16
        more = {"strings": strings, "streams": streams, "metadata": d.get("EncryptMetadata") is not False, "permissions": d["P"]}
        if version == 5:
            password, user, owner = password[:127], d["U"][:48], d["O"][:48]
            for said, extra, sealed, by_owner in ((owner, user, d["OE"], True), (user, b"", d["UE"], False)):
                if hardened(password, said[32:40], extra, revision) == said[:32]:
                    return Crypt(aes_decrypt(hardened(password, said[40:48], extra, revision), bytes(16), sealed[:32]), owner=by_owner, **more)
            return None
        k = _owner_key(password, revision, size)
        as_owner = rc4(k, d["O"][:32]) if revision < 3 else _owner_turns(k, d["O"][:32], True)
        n = 32 if revision < 3 else 16
        own, key = (_old_key(tried, d, first_id, size) for tried in (as_owner, password))
        fits = lambda k: _old_user(k, revision, first_id)[:n] == d["U"][:n]
        if fits(key):
            return Crypt(key, owner=own == key, **more)
        if fits(own):
            return Crypt(own, owner=True, **more)
    except (KeyError, TypeError, ValueError, IndexError, AttributeError):
        pass
    return None


def lock(method: str, user: bytes, owner: bytes, first_id: bytes, permissions: int = -4) -> tuple[dict, Crypt]:
    """The Encrypt dictionary and key of a new document: method RC4-40, RC4-128, AES-128 or AES-256."""
    version, revision, size, way = {"RC4-40": (1, 2, 5, "V2"), "RC4-128": (2, 3, 16, "V2"), "AES-128": (4, 4, 16, "AESV2"), "AES-256": (5, 6, 32, "AESV3")}[method]
    d: dict[str, Any] = {"Filter": Name("Standard"), "V": version, "R": revision, "Length": 8 * size, "P": permissions}
    if version > 3:
        d |= {"CF": {"StdCF": {"CFM": Name(way), "AuthEvent": Name("DocOpen"), "Length": size}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    if version == 5:
        key, extra = os.urandom(32), b""
        for who, password in (("U", user), ("O", owner)):
            salts = os.urandom(16)
            d[who] = hardened(password, salts[:8], extra, revision) + salts
            d[who + "E"] = aes_encrypt(hardened(password, salts[8:], extra, revision), bytes(16), key)
            extra = d["U"]
        said = (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + os.urandom(4)
        d["Perms"] = aes_encrypt(key, bytes(16), said)
    else:
        k = _owner_key(owner or user, revision, size)
        d["O"] = rc4(k, _padded_password(user)) if revision < 3 else _owner_turns(k, _padded_password(user), False)
        key = _old_key(user, d, first_id, size)
        d["U"] = _old_user(key, revision, first_id).ljust(32, b"\0")
    return d, Crypt(key, way, way, permissions=permissions)


def resolved(get: Callable[[Any], Any], x: Any, depth: int = 0) -> Any:
    """A dictionary with the references in it followed."""
    x = get(x) if isinstance(x, Ref) else x
    return {k: resolved(get, v, depth + 1) for k, v in x.items()} if isinstance(x, dict) and depth < 5 else x
