"""Pages as markup: layout boxes as XHTML, positioned lines as XML.

Words are dealt by document once; all that follows is grouped within documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_num")
BOX = ("x_min", "y_min", "x_max", "y_max")
#: Entities of the layout boxes, and those of positioned lines.
XHTML = (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))
XML = (("&", "&amp;"), ('"', "&#34;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(text: Column, entities: tuple[tuple[str, str], ...] = XHTML) -> Column:
    for raw, entity in entities:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _inside(column: str, order: str) -> Column:
    """Strings of a group one after another."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), "")


def _boxed(indent: int, tag: str, inner: Column) -> Column:
    return F.concat(F.format_string(" " * indent + f'<{tag} xMin="%.6f" yMin="%.6f" xMax="%.6f" yMax="%.6f">', *BOX), inner, F.lit(f"</{tag}>\n"))


def layout_pages(ordered: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, xhtml) of words in reading order: a page of flows, blocks, lines and words, each with its box.

    Every block is a flow of its own; a page without words is an empty element.
    """
    box = [f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)]
    words = ordered.repartition("doc_id").select(*PAGE, "block", "block_line", "place", *BOX, _boxed(10, "word", escaped(F.col("text"))).alias("said"))
    lines = words.groupBy(*PAGE, "block", "block_line").agg(*box, _inside("said", "place").alias("said"))
    lines = lines.select(*PAGE, "block", "block_line", *BOX, _boxed(8, "line", F.concat(F.lit("\n"), "said", F.lit(" " * 8))).alias("said"))
    parts = lines.groupBy(*PAGE, "block").agg(*box, _inside("said", "block_line").alias("said"))
    parts = parts.select(*PAGE, "block", F.concat(F.lit("    <flow>\n"), _boxed(6, "block", F.concat(F.lit("\n"), "said", F.lit(" " * 6))), F.lit("    </flow>\n")).alias("said"))
    held = parts.groupBy(*PAGE).agg(_inside("said", "block").alias("said"))
    media = F.col("media_box")
    head = F.format_string('  <page width="%.6f" height="%.6f">\n', media[2] - media[0], media[3] - media[1])
    return pages.join(held, list(PAGE), "left").select(*PAGE, F.concat(head, F.coalesce("said", F.lit("")), F.lit("  </page>\n")).alias("xhtml"))


def xml_pages(words: DataFrame, pages: DataFrame, zoom: float = 1.5) -> DataFrame:
    """(doc_id, page_num, xml): fonts where a document first uses them, then each line with its box in whole points times ``zoom``.

    Fonts are numbered from 0 in each document; a line has the font of its first word.
    """
    dealt = words.repartition("doc_id")
    font = ["doc_id", "font", "size"]
    first = dealt.groupBy(*font).agg(F.min(F.struct("page_num", "word_num")).alias("first"))
    fonts = first.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "font", "size")) - 1)
    family = F.when(F.col("font") == "", "Times").otherwise(F.regexp_replace("font", "^[A-Z]{6}\\+", ""))
    spec = F.format_string('\t<fontspec id="%d" size="%d" family="%s" color="#000000"/>\n', "id", F.floor(F.col("size") * zoom + 0.5).cast("long"), escaped(family, XML))
    specs = fonts.groupBy("doc_id", F.col("first.page_num").alias("page_num")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", spec.alias("spec")))), lambda x: x["spec"]), "").alias("specs"))
    ordered = F.array_sort(F.collect_list(F.struct("x_min", "word_num", "text")))
    lines = dealt.groupBy(*PAGE, "line").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), *(f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)), F.min_by("font", "word_num").alias("font"), F.min_by("size", "word_num").alias("size"))
    left, top, right, bottom = (F.col(c) * zoom for c in BOX)
    whole = [F.floor(v + 0.5).cast("long") for v in (top, left, right - left, bottom - top)]
    one = F.format_string('<text top="%d" left="%d" width="%d" height="%d" font="%d">%s</text>\n', *whole, "id", escaped(F.col("text"), XML))
    same = [lines[c].eqNullSafe(fonts[c]) for c in font]
    placed = lines.join(fonts, same[0] & same[1] & same[2]).select(lines["doc_id"], "page_num", F.struct("y_min", "x_min", "line").alias("at"), one.alias("said"))
    held = placed.groupBy(*PAGE).agg(_inside("said", "at").alias("said"))
    media = F.col("media_box")
    head = F.format_string('<page number="%d" position="absolute" top="0" left="0" height="%d" width="%d">\n', F.col("page_num") + 1, ((media[3] - media[1]) * zoom).cast("int"), ((media[2] - media[0]) * zoom).cast("int"))
    made = pages.join(specs, list(PAGE), "left").join(held, list(PAGE), "left")
    return made.select(*PAGE, F.concat(head, F.coalesce("specs", F.lit("")), F.coalesce("said", F.lit("")), F.lit("</page>\n")).alias("xml"))
