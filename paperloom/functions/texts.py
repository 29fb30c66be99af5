"""Encodings, classes of characters, numbers and names in text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes that a name can't hold as they are.
NAME_MARKS = "()<>[]{}/%#"


def utf16(s: Column, mark: bool = False) -> Column:
    """Big-endian bytes, with a byte order mark in front if asked for."""
    body = F.encode(s, "UTF-16BE")
    return F.concat(F.unhex(F.lit("FEFF")), body) if mark else body


def utf16_units(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def from_utf16(raw: Column) -> Column:
    return F.decode(raw, "UTF-16BE")


def text_string(raw: Column) -> Column:
    """A text string's characters: UTF-16 of either order by its mark, UTF-8 by its mark, else one byte a character."""
    head, body = F.hex(F.substring(raw, 1, 2)), F.substring(raw, 3, 1 << 30)
    return F.when(head == "FEFF", F.decode(body, "UTF-16BE")).when(head == "FFFE", F.decode(body, "UTF-16LE")).when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.make_valid_utf8(F.substring(raw, 4, 1 << 30).cast("string"))).otherwise(F.decode(raw, "ISO-8859-1"))


def code_points(s: Column) -> Column:
    """The code point of each character; bytes that are no UTF-8 are U+FFFD."""
    return F.transform(F.filter(F.split(F.make_valid_utf8(s), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def is_space(c: Column) -> Column:
    return F.instr(F.lit("".join(map(chr, SPACES))), c) > 0


def is_letter(c: Column) -> Column:
    """A letter of a left-to-right script, by ranges of the right-to-left ones."""
    return c.rlike(r"^\p{L}$") & ~is_right_to_left(c)


def is_right_to_left(c: Column) -> Column:
    return c.rlike(r"^[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}&&\p{L}]$")


def is_number(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}$")


def is_presentation_form(c: Column) -> Column:
    return c.rlike(r"^[\x{FB00}-\x{FB4F}]$")


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decimal(s: Column) -> Column:
    """The number that a text starts with, as atof reads it; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def from_decimal(s: Column) -> Column:
    """A label of digits only as a number, else null."""
    return F.when(s.rlike(r"^\d+$"), s.try_cast("int"))


def format_time(t: Column, pattern: str) -> Column:
    return F.date_format(t, pattern)


def name_bytes(s: Column) -> Column:
    """A name with white space, delimiters and bytes beyond ASCII as #xx."""
    each = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.lower(F.hex(F.substring(F.encode(s, "UTF-8"), i, 1))))
    plain = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in NAME_MARKS)
    shown = lambda h: F.when(F.instr(F.lit(plain), F.decode(F.unhex(h), "ISO-8859-1")) > 0, F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("#"), h))
    return F.when(F.length(s) == 0, "").otherwise(F.array_join(F.transform(each, shown), ""))


def html_text(s: Column, xml: bool = False) -> Column:
    """Without control characters, with entities; spaces that HTML would drop are hard ones."""
    s = F.replace(F.regexp_replace(s, r"[\x00-\x08\x0a-\x1f]", ""), F.lit("\t"), F.lit(" "))
    for mark, entity in (("&", "&amp;"), ('"', "&#34;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(mark), F.lit(entity))
    if xml:
        return s
    # of a run of spaces every second one, the first of a text and the last
    s = F.regexp_replace(s, "^ ", "&#160;")
    s = F.regexp_replace(s, "  ", " &#160;")
    return F.regexp_replace(s, " $", "&#160;")
