"""Words and passages that hold a needle; needles are few, so a scan of the words answers all of them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter with marks, that letter for each, and the marks, which go."""
    pairs = [(c, base[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (base := unicodedata.normalize("NFKD", c)) != c and base[0].isascii() and all(map(unicodedata.combining, base[1:]))]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


FOLDS = _folds()
_FOLDED = {ord(a): FOLDS[1][i] if i < len(FOLDS[1]) else None for i, a in reversed(list(enumerate(FOLDS[0])))}


def without_diacritics(text: Column) -> Column:
    return F.translate(text, *FOLDS)


def bare(text: str) -> str:
    """The same of a string."""
    return text.translate(_FOLDED)


def folded(text: str) -> str:
    return bare(text).lower()


def search(words: DataFrame, needles: list[str], ignore_case: bool = False, whole_words: bool = False, ignore_diacritics: bool = False) -> DataFrame:
    """A row for each word and needle in it; a whole word has no letter or digit beside it.

    Diacritics are ignored for needles that are plain ASCII only; a column ``bare`` has the texts without them
    (Spark's translate makes its table anew for each row).
    """
    stripped = F.col("bare") if "bare" in words.columns else without_diacritics(F.col("text"))

    def hit(needle: str) -> Column:
        text = stripped if ignore_diacritics and needle.isascii() else F.col("text")
        text, wanted = (F.lower(text), needle.lower()) if ignore_case else (text, needle)
        return text.rlike(rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(wanted)}(?![\p{{L}}\p{{Nd}}])") if whole_words else text.contains(wanted)

    found = F.array_compact(F.array(*(F.when(hit(n), F.lit(n)) for n in needles if n)))
    return words.select("*", F.explode(found).alias("needle"))


def first_matches(hits: DataFrame) -> DataFrame:
    """Of each page and needle, the hit that comes first from the top and then from the left."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page_num", "needle").orderBy(F.round("y_min", 2), "x_min", "word_num"))
    return hits.withColumn("_first", first).where("_first = 1").drop("_first")


def with_next(hits: DataFrame, backward: bool = False) -> DataFrame:
    """Each first part of a hit with the page and number of the next hit of its needle in the document (or of the one before); null at the end."""
    order = [F.desc("page_num"), F.desc("hit")] if backward else ["page_num", "hit"]
    along = Window.partitionBy("doc_id", "needle").orderBy(*order)
    return hits.where("part = 0").withColumns({"next_page": F.lead("page_num").over(along), "next_hit": F.lead("hit").over(along)})


def across_lines(needle: str) -> str:
    """A pattern for page texts: a line may end between words of the needle, or in one, after a hyphen."""
    return r"[ \n]".join(r"(?:-\n)?".join(map(re.escape, word)) for word in needle.split())


def search_pages(texts: DataFrame, needles: list[str], ignore_case: bool = False) -> DataFrame:
    """(doc_id, page_num, needle, hits) of page texts, over the ends of lines."""
    text = F.lower("text") if ignore_case else F.col("text")
    each = F.array(*(F.struct(F.lit(n).alias("needle"), F.regexp_count(text, F.lit(across_lines(n.lower() if ignore_case else n))).alias("hits")) for n in needles if n.strip()))
    return texts.select("doc_id", "page_num", F.inline(each)).where("hits > 0")
