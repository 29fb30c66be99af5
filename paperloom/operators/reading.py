"""Page texts in raw, physical and reading order, the word table report, and words under links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from paperloom.kernel.pages import LINE_STEP, LINK_SLACK, MOST_ENDS, WORD_GAP, blocks, in_blocks  # noqa: F401

PAGE = ("doc_id", "page_num")


def _joined(words: DataFrame, order: str, separator: Column) -> DataFrame:
    """(doc_id, page_num, text): words of a page in order, each after its separator; a group is one page."""
    pieces = words.select(*PAGE, F.struct(order, F.concat(separator, F.col("text")).alias("piece")).alias("p"))
    return pieces.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))


def raw_texts(words: DataFrame) -> DataFrame:
    """Words as the page draws them: a new line where the baseline moves, a space where there is a gap."""
    before = Window.partitionBy(*PAGE).orderBy("word_num")
    size = F.lag("size").over(before)
    moved = F.abs(F.col("base") - F.lag("base").over(before)) >= LINE_STEP * size
    gap = (F.col("x_min") - F.lag("x_max").over(before)) > WORD_GAP * size
    marked = words.withColumn("_sep", F.when(moved, "\n").when(gap, " ").otherwise(""))
    return _joined(marked, "word_num", F.col("_sep"))


def rows_of_pages(words: DataFrame) -> DataFrame:
    """``words`` and ``row``: which row of the page, from the top, a baseline belongs to, whatever the drawing order."""
    down = Window.partitionBy(*PAGE).orderBy("base", "word_num")
    begins = F.when(F.col("base") - F.lag("base").over(down) >= LINE_STEP * F.col("size"), 1).otherwise(0)
    return words.withColumn("_begins", begins).withColumn("row", F.sum("_begins").over(down).cast("int")).drop("_begins")


def physical_texts(words: DataFrame) -> DataFrame:
    """Words at the columns of characters that they have on the page; rows further apart have more ends of line between them."""
    of_page = Window.partitionBy(*PAGE)
    width = F.sum(F.col("x_max") - F.col("x_min")).over(of_page) / F.sum(F.length("text")).over(of_page)
    column = F.round((F.col("x_min") - F.min("x_min").over(of_page)) / F.nullif(width, F.lit(0.0)))
    placed = rows_of_pages(words).withColumn("_column", F.coalesce(column, F.lit(0.0)).cast("int"))
    held = placed.groupBy(*PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("_column", "x_min", "word_num", "x_max", "size", "text"))).alias("ws"), F.min("base").alias("base"), F.max("size").alias("size"))

    def put(line: Column, w: Column) -> Column:
        gap = F.when(w["x_min"] - line["end"] > WORD_GAP * w["size"], 1).otherwise(0)
        blanks = F.greatest(w["_column"] - F.length(line["text"]), gap)
        return F.struct(F.concat(line["text"], F.repeat(F.lit(" "), blanks), w["text"]).alias("text"), w["x_max"].alias("end"))

    start = F.struct(F.lit("").alias("text"), F.lit(1e9).alias("end"))
    lines = held.select(*PAGE, "row", "base", "size", F.aggregate("ws", start, put)["text"].alias("text"))
    down = Window.partitionBy(*PAGE).orderBy("row")
    ends = F.greatest(F.lit(1), F.least(F.lit(MOST_ENDS), F.floor((F.col("base") - F.lag("base").over(down)) / F.col("size")).cast("int")))
    return _joined(lines.withColumn("_ends", F.when(F.col("row") > 0, F.repeat(F.lit("\n"), ends)).otherwise("")), "row", F.col("_ends"))


def in_reading_order(words: DataFrame) -> DataFrame:
    """``words`` and ``block`` (from 0 on each page), ``block_line`` (from 0 in each block) and ``place`` (from 0 on each page).

    A document's words are one group, as they came from one row.
    """
    schema = StructType([*words.schema.fields, *(StructField(c, IntegerType()) for c in ("block", "block_line", "place"))])

    def kernel(table: pa.Table) -> pa.Table:
        page, base, size, *box = (table.column(c).to_numpy() for c in ("page_num", "base", "size", "x_min", "x_max", "y_min", "y_max"))
        block, line, place = (np.zeros(len(page), np.int32) for _ in range(3))
        for number in np.unique(page):
            on = np.flatnonzero(page == number)
            block[on], line[on], place[on] = in_blocks(base[on], size[on], *(b[on] for b in box))
        for name, column in (("block", block), ("block_line", line), ("place", place)):
            table = table.append_column(name, pa.array(column))
        return table

    return words.groupBy("doc_id").applyInArrow(kernel, schema)


def reading_texts(ordered: DataFrame) -> DataFrame:
    """Page texts of :func:`in_reading_order`: a line for each line of a block, an empty one between blocks."""
    before = Window.partitionBy(*PAGE).orderBy("place")
    new_block, new_line = (F.col(c) != F.lag(c).over(before) for c in ("block", "block_line"))
    return _joined(ordered.withColumn("_sep", F.when(new_block, "\n\n").when(new_line, "\n").when(F.col("place") > 0, " ").otherwise("")), "place", F.col("_sep"))


def word_report(ordered: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each page (level 1), block (3), line (4) and word (5), with boxes as left, top, width and height.

    Pages count from 1, blocks and lines from 0; confidence is 100 for words, -1 for the rest.
    """
    box = [F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")]
    lines = ordered.groupBy(*PAGE, "block", "block_line").agg(*box)
    of_blocks = lines.groupBy(*PAGE, "block").agg(*box)
    zero = F.lit(0)

    def rows(df: DataFrame, level: int, block: Column, line: Column, word: Column, left: Column, top: Column, right: Column, bottom: Column, text: Column) -> DataFrame:
        return df.select("doc_id", F.lit(level).alias("level"), (F.col("page_num") + 1).alias("page_num"), block.alias("block_num"), line.alias("line_num"), word.alias("word_num"), *(F.round(c, 2).alias(n) for n, c in (("left", left), ("top", top), ("width", right - left), ("height", bottom - top))), F.lit(100 if level == 5 else -1).alias("conf"), text.alias("text"))

    edges = [F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    media = F.col("media_box")
    page = rows(pages, 1, zero, zero, zero, F.lit(0.0), F.lit(0.0), media[2] - media[0], media[3] - media[1], F.lit("###PAGE###"))
    block = rows(of_blocks, 3, F.col("block"), zero, zero, *edges, F.lit("###FLOW###"))
    line = rows(lines, 4, F.col("block"), F.col("block_line"), zero, *edges, F.lit("###LINE###"))
    in_line = F.row_number().over(Window.partitionBy(*PAGE, "block", "block_line").orderBy("place")) - 1
    return page.union(block).union(line).union(rows(ordered.withColumn("_word", in_line), 5, F.col("block"), F.col("block_line"), F.col("_word"), *edges, F.col("text")))


def linked_words(words: DataFrame, links: DataFrame) -> DataFrame:
    """Words inside a link of their page: ``links`` has doc_id, page_num, uri and a box from the top left as rect."""
    own = links.select(F.col("doc_id").alias("_doc"), F.col("page_num").alias("_page"), "uri", "rect")
    r = F.col("rect")
    inside = (r[0] < F.col("x_min") + LINK_SLACK) & (F.col("x_max") - LINK_SLACK < r[2]) & (r[1] < F.col("y_min") + LINK_SLACK) & (F.col("y_max") - LINK_SLACK < r[3])
    return words.join(own, (F.col("doc_id") == F.col("_doc")) & (F.col("page_num") == F.col("_page")) & inside).drop("_doc", "_page", "rect")
