import pytest

from pyspark.sql import functions as F

from paperloom.functions import calculators as C
from paperloom.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_labels(spark):
    assert one(spark, S.to_roman(F.lit(177))) == "clxxvii"
    assert one(spark, S.from_roman(F.lit("clxxvii"))) == 177
    assert one(spark, S.to_roman(F.lit(4000))) == ""
    assert one(spark, S.to_latin(F.lit(54))) == "bbb"
    assert one(spark, S.from_latin(F.lit("ddd"))) == 56


def test_dates(spark):
    def seconds(said):
        return one(spark, F.unix_timestamp(S.parse_date(F.lit(said))) - F.unix_timestamp(F.lit("2003-01-31 00:00:00").cast("timestamp")))

    assert seconds("D:20030131115258-04'00'") == 15 * 3600 + 52 * 60 + 58
    assert seconds("D:20030131115258+08'30'") == 3 * 3600 + 22 * 60 + 58
    assert one(spark, S.parse_date(F.lit("D:2006")).isNotNull())
    for bad in (None, "", "D", "D:", "D:IAmNotAValidDate"):
        assert one(spark, S.parse_date(F.lit(bad).cast("string"))) is None


def test_calculators(spark):
    assert one(spark, C.postscript("{ 3 cvi 2 bitshift }", [], [(0, 100)])[0]) == 12
    assert one(spark, C.postscript("{ 0 div }", [F.lit(1.0)], [(-5, 5)])[0]) == 5
    assert one(spark, C.stitched(F.lit(1.0), [lambda x: x, lambda x: 1 - x], [0.5], [(0, 1), (0, 1)])) == 0
    assert one(spark, C.sampled(F.lit(0.125), [0.0, 1.0, 0.0, 1.0, 0.0])) == 0.5


def test_constants_on_the_calculator_stack(spark):
    from paperloom.functions import calculators as C

    one = spark.range(1)

    def y(code, ranges=((-99, 99),)):
        return one.select(*(c.alias(f"y{i}") for i, c in enumerate(C.postscript(code, [], list(ranges))))).first()[0]

    assert y("{ 10 20 30 1 1 add index }") == 10
    assert y("{ 7 3 0 idiv }") == 7 and y("{ 2 7 0 mod 5 add }") == 7
    assert y("{ -7 2 idiv }") == -3 and y("{ -7 2 mod }") == -1
    assert y("{ 1 2 3 3 4 3 sub roll pop pop }") == 3
    with pytest.raises(ValueError):
        C.postscript("{ 1 2 3.5 index }", [], [(0, 1)])


def test_functions_are_held_in_domain_and_range(spark):
    from pyspark.sql import functions as F

    from paperloom.functions import calculators as C

    row = spark.range(1).select(C.exponential(F.lit(2.0), [0], [1], 2, (0, 1))[0].alias("a"), C.exponential(F.lit(2.0), [0], [1], 2, None, [(0, 3)])[0].alias("b"), C.clamp(F.lit(None).cast("double"), 0, 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (1.0, 3.0, None)


def test_texts(spark):
    from pyspark.sql import functions as F

    from paperloom.functions import texts as T

    rows = [("  a  b<&\t", "12", "3.5e2x"), ("", "x1", "none"), ("ü\U0001f600", "007", "-.5")]
    table = spark.createDataFrame(rows, "s string, d string, n string")
    found = table.select(T.html_text(F.col("s")).alias("h"), T.from_decimal(F.col("d")).alias("d"), T.decimal(F.col("n")).alias("n"), T.utf16_units(F.col("s")).alias("u"), T.code_points(F.col("s")).alias("p"), T.name_bytes(F.col("s")).alias("q"), T.text_string(T.utf16(F.col("s"), True)).alias("t")).collect()
    assert [(r.h, r.d, r.n, r.u, r.t) for r in found] == [("&#160; a &#160;b&lt;&amp;&#160;", 12, 350.0, 9, rows[0][0]), ("", None, 0.0, 0, ""), ("ü\U0001f600", 7, -0.5, 3, rows[2][0])]
    assert [r.p for r in found] == [[ord(c) for c in s] for s, _, _ in rows]
    assert found[2].q == "#c3#bc#f0#9f#98#80" and found[0].q == "#20#20a#20#20b#3c&#09"
