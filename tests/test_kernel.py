import random
import time

import pytest

from paperloom.kernel import filters
from paperloom.kernel.content import Interpreter, words
from paperloom.kernel.document import Document
from paperloom.kernel.syntax import Lexer, Parser, write
from paperloom.kernel.writer import assemble, synthesize


@pytest.mark.parametrize("said,value", [("0", 0), ("-1", -1), ("2147483648", 2147483648), ("9223372036854775807", 2**63 - 1), ("18446744073709551616", 18446744073709551616.0), ("-2147483647.1", -2147483647.1), ("0.1", 0.1)])
def test_numbers(said, value):
    found = Lexer(said.encode()).token()
    assert found == value and type(found) is type(value)


def test_objects_survive_writing():
    x = {"A": [1, -2.5, b"a(b)\\c\r\n", None, True], "B b#": {"C": b""}}
    assert Parser(write(x)).object() == x


@pytest.mark.parametrize("name", filters.ENCODERS)
def test_filters(name):
    random.seed(5)
    for n in (0, 1, 4, 500, 9000):
        raw = bytes(random.choices(range(random.choice([2, 256])), k=n))
        assert filters.decode(filters.ENCODERS[name](raw), [name], [{}]) == raw


def _text(doc):
    run = Interpreter(doc)
    return [" ".join(w.text for w in words(run.glyphs(page))) for _, page in doc.pages()]


def test_synthesis_damage_and_pages():
    text = " ".join(f"w{i}é" for i in range(1000))
    raw = synthesize(text, {"Title": "x"})
    for damaged in (raw, raw[:-200], raw.replace(b"startxref", b"startxxxx")):
        assert " ".join(_text(Document(damaged))) == text
    doc = Document(raw)
    assert doc.info() == {"Title": "x"} and len(list(doc.outline())) == 3
    parts = _text(doc)
    assert _text(Document(assemble([(doc, [1]), (doc, [0])]))) == [parts[1], parts[0]]
    assert not Document(b"no document").ok


def test_lzw_takes_little_more_than_a_look_at_each_byte():
    raw = " ".join(f"word{i * i}" for i in range(40_000)).encode()

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    plain = min(took(lambda: [c + 1 for c in raw]) for _ in range(3))
    assert min(took(lambda: filters.lzw_decode(filters.lzw_encode(raw))) for _ in range(3)) < 30 * plain
