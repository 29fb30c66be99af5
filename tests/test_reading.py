import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import blending
from paperloom.operators import reading

WORDS = "doc_id long, page_num int, word_num int, line int, text string, x_min double, y_min double, x_max double, y_max double, base double, size double, font string"


def placed(spark, said):
    """Words of (x, baseline, text), six points a letter, drawn in the given order."""
    return spark.createDataFrame([(1, 0, i, 0, t, x, y - 8.0, x + 6.0 * len(t), y + 2.0, y, 10.0, "Courier") for i, (x, y, t) in enumerate(said)], WORDS)


# a title and an end that reach over both columns
TITLE, END = "title".ljust(40, "-"), "end".ljust(40, "-")
COLUMNS = [(300.0, 100.0, "three"), (72.0, 100.0, "one"), (300.0, 112.0, "four"), (72.0, 112.0, "two"), (96.0, 112.0, "too"), (72.0, 60.0, "A"), (84.0, 60.0, TITLE), (72.0, 160.0, END)]


def text(df):
    return [r.text for r in df.collect()]


def test_raw_order(spark):
    assert text(reading.raw_texts(placed(spark, COLUMNS))) == [f"threeone\nfourtwo too\nA {TITLE}\n{END}"]


def test_physical_layout_keeps_columns_and_gaps(spark):
    assert text(reading.physical_texts(placed(spark, COLUMNS))) == [f"A {TITLE}\n\n\n\none" + " " * 35 + "three\ntwo too" + " " * 31 + f"four\n\n\n\n{END}"]


def test_reading_order_takes_columns_one_by_one(spark):
    ordered = reading.in_reading_order(placed(spark, COLUMNS))
    assert text(reading.reading_texts(ordered)) == [f"A {TITLE}\n\none\ntwo too\n\nthree\nfour\n\n{END}"]
    pages = spark.createDataFrame([(1, 0, [0.0, 0.0, 612.0, 792.0])], "doc_id long, page_num int, media_box array<double>")
    report = reading.word_report(ordered, pages).collect()
    assert [sum(r.level == k for r in report) for k in (1, 3, 4, 5)] == [1, 4, 6, 8]
    assert {(r.block_num, r.line_num, r.word_num) for r in report if r.text == "too"} == {(1, 1, 1)}


def test_linked_words(spark):
    links = spark.createDataFrame([(1, 0, "u", [71.0, 90.0, 120.0, 116.0])], "doc_id long, page_num int, uri string, rect array<double>")
    assert sorted(text(reading.linked_words(placed(spark, COLUMNS), links))) == ["one", "too", "two"]


def test_empty_pages(spark):
    none = placed(spark, COLUMNS).limit(0)
    assert text(reading.raw_texts(none)) == text(reading.physical_texts(none)) == text(reading.reading_texts(reading.in_reading_order(none))) == []


def lum(c):
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def set_lum(c, to):
    c = [x + to - lum(c) for x in c]
    low, high = min(c), max(c)
    if low < 0:
        c = [to + (x - to) * to / (to - low) for x in c]
    if high > 1:
        c = [to + (x - to) * (1 - to) / (high - to) for x in c]
    return c


def set_sat(c, to):
    low, high = min(c), max(c)
    return [(x - low) * to / (high - low) for x in c] if high > low else [0.0] * 3


def sat(c):
    return max(c) - min(c)


@pytest.mark.parametrize("name, want", [("hue", lambda s, t: set_lum(set_sat(t, sat(s)), lum(s))), ("saturation", lambda s, t: set_lum(set_sat(s, sat(t)), lum(s))), ("color", lambda s, t: set_lum(t, lum(s))), ("luminosity", lambda s, t: set_lum(s, lum(t)))])
def test_color_blends(spark, name, want):
    rng = random.Random(3)
    rows = [([rng.random() for _ in range(3)], [rng.random() for _ in range(3)]) for _ in range(200)] + [([0.5] * 3, [0.0, 1.0, 0.0]), ([1.0] * 3, [0.0] * 3), ([0.0, 0.0, 1.0], [0.2] * 3)]
    found = spark.createDataFrame(rows, "s array<double>, t array<double>").select(getattr(blending, name)(F.col("s"), F.col("t")).alias("c"), "s", "t").collect()
    for r in found:
        assert r.c == pytest.approx(want(r.s, r.t), abs=1e-9)
