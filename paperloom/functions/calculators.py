"""PDF functions (ISO 32000-1, 7.10) of types 0, 2, 3 and 4, compiled to Spark columns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """Held between the two; null and NaN stay."""
    return F.when(x < low, F.lit(float(low))).when((x > high) & ~F.isnan(x.cast("double")), F.lit(float(high))).otherwise(x)


def identity(*inputs: Column) -> list[Column]:
    return list(inputs)


def sampled(x: Column, samples: list[float], domain=(0.0, 1.0), decode=None) -> Column:
    """Type 0 of one input and one output: samples in 0..1 over the domain, between them a line."""
    return sampled_many([x], [len(samples)], [[s] for s in samples], [domain], decode=[decode or (0.0, 1.0)])[0]


def sampled_many(inputs: list[Column], sizes: list[int], samples: list[list[float]], domain, encode=None, decode=None, ranges=None) -> list[Column]:
    """Type 0: ``samples`` hold the outputs of each point of the grid, the first input's points running fastest.

    Between points values are linear in each input; NaN counts as the first point.
    """
    encode = encode or [(0, n - 1) for n in sizes]
    low, part = [], []
    for x, n, (d0, d1), (e0, e1) in zip(inputs, sizes, domain, encode, strict=True):
        at = (clamp(x.cast("double"), d0, d1) - d0) * ((e1 - e0) / (d1 - d0)) + e0
        at = clamp(F.when(F.isnan(at), F.lit(0.0)).otherwise(at), 0, n - 1)
        first = F.least(F.floor(at), F.lit(max(0, n - 2))).cast("int")
        low.append(first)
        part.append(at - first)
    out = []
    for k in range(len(samples[0])):
        table, y = F.array(*(F.lit(float(s[k])) for s in samples)), F.lit(0.0)
        for corner in range(1 << len(inputs)):
            place, weight, step = F.lit(1), F.lit(1.0), 1
            for i, n in enumerate(sizes):
                up = corner >> i & 1
                place = place + F.least(low[i] + up, F.lit(n - 1)) * step
                weight = weight * (part[i] if up else 1 - part[i])
                step *= n
            y = y + weight * F.element_at(table, place.cast("int"))
        if decode:
            y = decode[k][0] + y * (decode[k][1] - decode[k][0])
        out.append(clamp(y, *ranges[k]) if ranges else y)
    return out


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain=None, ranges=None) -> list[Column]:
    """Type 2, held in its domain and ranges where it has any."""
    x = clamp(x, *domain) if domain else x
    p = x if n == 1 else F.pow(x, F.lit(float(n)))
    out = [F.lit(float(a)) + p * float(b - a) for a, b in zip(c0, c1, strict=True)]
    return [clamp(y, *r) for y, r in zip(out, ranges, strict=True)] if ranges else out


def stitched(x: Column, pieces: list, bounds: list[float], encode: list[tuple[float, float]], domain=(0.0, 1.0)) -> Column:
    """Type 3: the first piece whose upper bound is above x; the last holds the end of the domain."""
    x, edges, out = clamp(x, *domain), [domain[0], *bounds, domain[1]], None
    for i in reversed(range(len(pieces))):
        a, b = edges[i], edges[i + 1]
        inner = F.lit(float(encode[i][0])) if a == b else encode[i][0] + (x - a) * ((encode[i][1] - encode[i][0]) / (b - a))
        y = pieces[i](inner)
        out = y if out is None else F.when(x < b, y).otherwise(out)
    return out


class Slot(NamedTuple):
    kind: str  # int, real or bool
    value: Column
    constant: int | None = None  # of whole numbers that are known when compiling


def _program(code: str) -> list:
    tokens = iter(re.findall(r"[{}]|[^\s{}]+", code))

    def block() -> list:
        out = []
        for t in tokens:
            if t == "}":
                break
            out.append(block() if t == "{" else t)
        return out

    next(tokens)
    return block()


def _number(word: str) -> Slot | None:
    try:
        return _whole(int(word))
    except ValueError:
        try:
            return Slot("real", F.lit(float(word)))
        except ValueError:
            return None


def _whole(n: int) -> Slot:
    return Slot("int", F.lit(n).cast("long"), n)


def _real(s: Slot) -> Column:
    return s.value.cast("double")


def postscript(code: str, inputs: list[Column], ranges: list[tuple[float, float]]) -> list[Column]:
    """Type 4, run on columns instead of numbers: the stack's depth and kinds are known when compiling."""
    stack = _run(_program(code), [Slot("real", x.cast("double")) for x in inputs])
    top = stack[-len(ranges) :]
    return [clamp(_real(s), *r) for s, r in zip(top, ranges, strict=True)]


def _run(program: list, stack: list[Slot]) -> list[Slot]:
    stack = list(stack)
    at = 0
    while at < len(program):
        word = program[at]
        at += 1
        if isinstance(word, list):
            other = program[at] if at < len(program) and isinstance(program[at], list) else None
            at += 2 if other is not None else 1
            asked = stack.pop().value
            yes, no = _run(word, stack), _run(other, stack) if other is not None else stack
            if len(yes) != len(no):
                raise ValueError("branches of different depth")
            stack = [y if y is n else Slot(y.kind if y.kind == n.kind else "real", F.when(asked, y.value if y.kind == n.kind else _real(y)).otherwise(n.value if y.kind == n.kind else _real(n))) for y, n in zip(yes, no, strict=True)]
            continue
        if (number := _number(word)) is not None:
            stack.append(number)
        elif word in ("true", "false"):
            stack.append(Slot("bool", F.lit(word == "true")))
        elif word in _STACK:
            _STACK[word](stack)
        elif word in _UNARY:
            a = stack.pop()
            stack.append(_whole(_KNOWN[word](a.constant)) if a.constant is not None and word in _KNOWN else _UNARY[word](a))
        elif word in _BINARY:
            b, a = stack.pop(), stack.pop()
            if word in ("idiv", "mod") and b.constant == 0:
                continue  # leaves nothing
            known = a.constant is not None and b.constant is not None and word in _KNOWN
            stack.append(_whole(_KNOWN[word](a.constant, b.constant)) if known else _BINARY[word](a, b))
        else:
            raise ValueError(f"no operator {word}")
    return stack


def _literal(stack: list[Slot]) -> int:
    if (n := stack.pop().constant) is None:
        raise ValueError("the operand of copy, index and roll must be known when compiling")
    return n


def _copy(stack: list[Slot]) -> None:
    if n := _literal(stack):
        stack.extend(stack[-n:])


def _index(stack: list[Slot]) -> None:
    n = _literal(stack)
    stack.append(stack[-1 - n])


def _roll(stack: list[Slot]) -> None:
    by, n = _literal(stack), _literal(stack)
    if n:
        part, by = stack[-n:], by % n
        stack[-n:] = part[-by:] + part[:-by] if by else part


def _exch(stack: list[Slot]) -> None:
    stack[-2:] = stack[:-3:-1]


_STACK = {"pop": lambda s: s.pop(), "dup": lambda s: s.append(s[-1]), "exch": _exch, "copy": _copy, "index": _index, "roll": _roll}


def _arithmetic(f):
    return lambda a, b: Slot("int", f(a.value, b.value)) if a.kind == b.kind == "int" else Slot("real", f(_real(a), _real(b)))


def _compared(f):
    return lambda a, b: Slot("bool", f(a.value, b.value) if a.kind == b.kind == "bool" else f(_real(a), _real(b)))


def _logical(on_int, on_bool):
    return lambda a, b: Slot("bool", on_bool(a.value, b.value)) if a.kind == "bool" else Slot("int", on_int(a.value, b.value))


def _kept(f):
    """On reals; whole numbers stay as they are."""
    return lambda a: a if a.kind == "int" else Slot("real", f(a.value).cast("double"))


def _divided(a: Slot, b: Slot) -> Slot:
    x, y = _real(a), _real(b)
    endless = F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return Slot("real", F.when(y == 0, endless).otherwise(F.try_divide(x, y)))


def _shifted(a: Slot, b: Slot) -> Slot:
    n, x = b.value.cast("int"), a.value.cast("int")
    return Slot("int", F.when(n >= 0, F.call_function("shiftleft", x, n)).otherwise(F.call_function("shiftrightunsigned", x, -n)).cast("long"))


def _quotient(a: int, b: int) -> int:
    """Rounded towards zero."""
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


#: On whole numbers that are known.
_KNOWN = {"add": int.__add__, "sub": int.__sub__, "mul": int.__mul__, "idiv": _quotient, "mod": lambda a, b: a - b * _quotient(a, b), "neg": int.__neg__, "abs": int.__abs__, "cvi": int, "ceiling": int, "floor": int, "round": int, "truncate": int, "and": int.__and__, "or": int.__or__, "xor": int.__xor__, "not": int.__invert__}
_UNARY = {
    "abs": lambda a: Slot(a.kind, F.abs(a.value)),
    "neg": lambda a: Slot(a.kind, -a.value),
    "ceiling": _kept(F.ceil),
    "floor": _kept(F.floor),
    "round": _kept(F.round),
    "truncate": _kept(lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))),
    "sqrt": lambda a: Slot("real", F.sqrt(_real(a))),
    "sin": lambda a: Slot("real", F.sin(F.radians(_real(a)))),
    "cos": lambda a: Slot("real", F.cos(F.radians(_real(a)))),
    "ln": lambda a: Slot("real", F.when(_real(a) == 0, F.lit(float("-inf"))).otherwise(F.ln(_real(a)))),
    "log": lambda a: Slot("real", F.when(_real(a) == 0, F.lit(float("-inf"))).otherwise(F.log10(_real(a)))),
    "cvi": lambda a: a if a.kind == "int" else Slot("int", F.when(a.value >= 0, F.floor(a.value)).otherwise(F.ceil(a.value)).cast("long")),
    "cvr": lambda a: Slot("real", _real(a)),
    "not": lambda a: Slot("bool", ~a.value) if a.kind == "bool" else Slot("int", F.bitwise_not(a.value)),
}
_BINARY = {
    "add": _arithmetic(lambda a, b: a + b),
    "sub": _arithmetic(lambda a, b: a - b),
    "mul": _arithmetic(lambda a, b: a * b),
    "div": _divided,
    "idiv": lambda a, b: Slot("int", F.call_function("try_divide", a.value - F.try_mod(a.value, b.value), b.value).cast("long")),
    "mod": lambda a, b: Slot("int", F.try_mod(a.value, b.value)),
    "exp": lambda a, b: Slot("real", F.pow(_real(a), _real(b))),
    "atan": lambda a, b: Slot("real", F.pmod(F.degrees(F.atan2(_real(a), _real(b))), F.lit(360.0))),
    "bitshift": _shifted,
    "eq": _compared(lambda a, b: a == b),
    "ne": _compared(lambda a, b: a != b),
    "lt": _compared(lambda a, b: a < b),
    "le": _compared(lambda a, b: a <= b),
    "gt": _compared(lambda a, b: a > b),
    "ge": _compared(lambda a, b: a >= b),
    "and": _logical(lambda a, b: a.bitwiseAND(b), lambda a, b: a & b),
    "or": _logical(lambda a, b: a.bitwiseOR(b), lambda a, b: a | b),
    "xor": _logical(lambda a, b: a.bitwiseXOR(b), lambda a, b: a != b),
}
