"""Word boxes of rendered pages, from the HTML that layout tools write: one <page> with many <word> elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(files: DataFrame, path="path", html="html") -> DataFrame:
    """(path, page_no, word_no, text, box, page size, start, end): words in order, with places in their page's text without blanks.

    Pages and words are found by built-in pattern functions; the offsets are a running sum.
    """
    number = lambda c, name: F.regexp_extract(c, f'{name}="([-0-9.]+)"', 1).try_cast("double")
    pages = files.select(path, F.posexplode(F.regexp_extract_all(html, F.lit("(?s)(<page .*?</page>)"))).alias("p", "page"))
    found = pages.select(path, (F.col("p") + 1).alias("page_no"), number(F.col("page"), "width").alias("page_width"), number(F.col("page"), "height").alias("page_height"), F.posexplode(F.regexp_extract_all("page", F.lit("(?s)(<word .*?</word>)"))).alias("word_no", "word"))
    text = F.regexp_extract("word", "(?s)>(.*?)</word>", 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    out = found.select(path, "page_no", "word_no", F.regexp_replace(text, r"(?U)\s+", "").alias("text"), *[number(F.col("word"), a).alias(b) for a, b in (("xMin", "x_min"), ("yMin", "y_min"), ("xMax", "x_max"), ("yMax", "y_max"))], "page_width", "page_height")
    w = Window.partitionBy(path, "page_no").orderBy("word_no")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def page_texts(word_boxes: DataFrame, path="path") -> DataFrame:
    """The text of every page without blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return word_boxes.groupBy(path, "page_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def boxes_of_ranges(ranges: DataFrame, word_boxes: DataFrame, key, path="path") -> DataFrame:
    """The box around the words that each range (path, page_no, start, end) of a page's text touches, and how near the top it begins."""
    w = word_boxes.select(path, "page_no", F.col("start").alias("_ws"), F.col("end").alias("_we"), "x_min", "y_min", "x_max", "y_max", "page_height")
    hit = ranges.join(w, [path, "page_no"]).filter((F.col("_ws") < F.col("end")) & (F.col("_we") > F.col("start")))
    out = hit.groupBy(path, "page_no", *key).agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"), F.first("page_height").alias("page_height"))
    return out.withColumn("top_ratio", F.when(F.col("page_height") > 0, F.col("y_min") / F.col("page_height")))
