"""From words to lines and page texts, by aggregation on (doc_id, page_num)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import escaped


def lines(words: DataFrame) -> DataFrame:
    """Words of one baseline, in the order in which the line runs; a group is one line of a page."""
    if "turn" not in words.columns:
        words = words.withColumn("turn", F.lit(0))
    along = F.element_at(F.array("x_min", "y_min", -F.col("x_max"), -F.col("y_max")), F.col("turn") + 1)
    of_line = words.withColumn("along", along).groupBy("doc_id", "page_num", "line")
    ordered = F.array_sort(F.collect_list(F.struct("along", "word_num", "text")))
    return of_line.agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def page_texts(found: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return found.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def select_area(words: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Words whose middle lies in a rectangle of the page (left, top, right, bottom)."""
    x, y = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    return words.where(x.between(box[0], box[2]) & y.between(box[1], box[3]))


#: Parts of the font size within which a second, equal word is the first one drawn again.
SAME_ALONG, SAME_ACROSS = 0.1, 0.2


def without_doubles(words: DataFrame) -> DataFrame:
    """Words less those that a page draws again in nearly the same place, as for a false bold."""
    near = Window.partitionBy("doc_id", "page_num", "text").orderBy((F.col("x_min") * 1000).cast("long")).rangeBetween(-20_000, 20_000)
    others = F.collect_list(F.struct("word_num", "x_min", "base")).over(near)
    again = F.exists(others, lambda o: (o["word_num"] < F.col("word_num")) & (F.abs(o["x_min"] - F.col("x_min")) < SAME_ALONG * F.col("size")) & (F.abs(o["base"] - F.col("base")) < SAME_ACROSS * F.col("size")))
    return words.where(F.col("size") <= 200.0).withColumn("_again", again).where(~F.col("_again")).drop("_again").unionByName(words.where("size > 200.0 or size is null"))


def dehyphenated(text: Column, how: str = "soft") -> Column:
    """Page text with the hyphens at ends of lines kept ('none'), or joined where soft ('soft') or of any kind ('all')."""
    return {"none": text, "soft": F.regexp_replace(text, "­\n", ""), "all": F.regexp_replace(text, "[­-]\n", "")}[how]


def bbox_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, xhtml): a page element with an element for each word."""
    said = escaped(F.col("text"))
    one = F.format_string('    <word xMin="%.6f" yMin="%.6f" xMax="%.6f" yMax="%.6f">%s</word>\n', "x_min", "y_min", "x_max", "y_max", said)
    held = words.select("doc_id", "page_num", F.struct("word_num", one.alias("one")).alias("w")).groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    box = F.col("media_box")
    head = F.format_string('  <page width="%.6f" height="%.6f">\n', box[2] - box[0], box[3] - box[1])
    body = F.coalesce(F.array_join(F.transform("ws", lambda w: w["one"]), ""), F.lit(""))
    return pages.join(held, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.concat(head, body, F.lit("  </page>\n")).alias("xhtml"))
