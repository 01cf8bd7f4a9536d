"""Alignment of rows with pages, and of expected units with rows.

Finding the page of a row depends on the page of the row before, and a unit's
row on the rows taken before it: both are folds over one document, run by
`applyInPandas` for many documents at once.  The inferences after them are
windows and joins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import intervals, sequence

#: Lengths to which a text is cut when the whole is not found.
CUTS = (40, 24)


def monotone_pages(rows: DataFrame, pages: DataFrame, doc="doc_id", seq="source_seq") -> DataFrame:
    """Binds each row's text to a page not before that of the rows above: (doc, seq, page_no, status).

    ``rows`` holds (doc, seq, text, keep_next), ``pages`` (doc, page_no, text) without
    blanks.  The whole text is looked for, then its beginning.  Where several
    pages have it the first is taken, or none for a row that keeps with the next.
    Status: exact, prefix, ambiguous or empty_text.
    """
    schema = T.StructType([rows.schema[doc], rows.schema[seq]]).add("page_no", "long").add("status", "string")

    def fold(own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(zip(theirs["page_no"], theirs["text"]))
        lowest, out = 1, []
        for r in own.sort_values(seq).itertuples():
            text = re.sub(r"\s+", "", r.text or "")
            page, status = None, "ambiguous" if text else "empty_text"
            for n in (len(text), *CUTS):
                if status != "ambiguous" or n > len(text) or n < 2 or (n in CUTS and n == len(text)):
                    continue
                hits = [p for p, t in texts if p >= lowest and text[:n] in (t or "")]
                if len(hits) > 1 and r.keep_next:
                    break
                if hits:
                    page, status = hits[0], "exact" if n == len(text) else "prefix"
            lowest = max(lowest, page or lowest)
            out.append((getattr(r, doc), getattr(r, seq), page, status))
        return pd.DataFrame(out, columns=schema.names).astype({"page_no": "Int64"})

    return rows.select(doc, seq, "text", "keep_next").groupBy(doc).cogroup(pages.select(doc, "page_no", "text").groupBy(doc)).applyInPandas(fold, schema)


def anchored_pages(rows: DataFrame, pages: DataFrame, by, seq, anchors, page="page_no") -> DataFrame:
    """Binds rows without a page by their stable anchors: (by, seq, page_no).

    The first page between the nearest known pages on both sides counts that holds
    an anchor of five characters, or two of four.
    """
    bounds = rows.withColumn("_low", F.coalesce(sequence.last_known(page, by, [seq], False), F.lit(1))).withColumn("_high", sequence.next_known(page, by, [seq], False)).filter(F.col(page).isNull())
    spread = bounds.select(*by, seq, "_low", "_high", F.explode(anchors).alias("_anchor"))
    theirs = pages.select(*by, F.col("page_no").alias("_page"), F.col("text").alias("_text"))
    hits = spread.join(theirs, by).filter((F.col("_page") >= F.col("_low")) & (F.col("_page") <= F.coalesce("_high", F.col("_page"))) & F.col("_text").contains(F.col("_anchor")))
    found = hits.groupBy(*by, seq, "_page").agg(F.max(F.length("_anchor")).alias("_longest"), F.count_if(F.length("_anchor") >= 4).alias("_n"))
    return found.filter("_longest >= 5 OR _n >= 2").groupBy(*by, seq).agg(F.min("_page").alias("page_no"))


def boundary_side_fill(rows: DataFrame, boundaries: DataFrame, by, seq, paragraph, page, name="filled") -> DataFrame:
    """Fills a page between two known, rising pages with exactly one boundary in between, by the side that the row is on.

    ``rows`` holds (by, seq, paragraph, page), ``boundaries`` (by, paragraph): a
    boundary closes its paragraph.
    """
    known = F.when(F.col(page).isNotNull(), F.struct(F.col(page).alias("page"), F.col(paragraph).alias("par")))
    x = rows.withColumn("_b", sequence.last_known(known, by, [seq], False)).withColumn("_a", sequence.next_known(known, by, [seq], False))
    open_rows = x.filter(F.col(page).isNull() & (F.col("_b.page") < F.col("_a.page"))).select(*by, seq, F.col(paragraph).alias("_own"), (F.col("_b.par") - 1).alias("_low"), (F.col("_a.par") - 1).alias("_high"), F.col("_b.page").alias("_before"), F.col("_a.page").alias("_after"))
    edge = boundaries.select(*by, F.col(paragraph).alias("_edge")).distinct()
    counted = intervals.boundaries_between(open_rows, edge, by, "_low", "_high", "_edge").filter("n_between = 1").drop("n_between")
    own = counted.join(edge, by).filter((F.col("_edge") > F.col("_low")) & (F.col("_edge") <= F.col("_high")))
    chosen = own.select(*by, seq, F.when(F.col("_own") <= F.col("_edge"), F.col("_before")).otherwise(F.col("_after")).alias("_side"))
    return rows.join(chosen, [*by, seq], "left").withColumn(name, F.coalesce(page, "_side")).drop("_side")


def keep_next_fill(rows: DataFrame, boundaries: DataFrame, by, seq, paragraph, page, keep_next, name="filled") -> DataFrame:
    """Fills a row that keeps with the next by the page of the following known row, unless a boundary stands between."""
    known = F.when(F.col(page).isNotNull(), F.struct(F.col(page).alias("page"), F.col(paragraph).alias("par")))
    x = rows.withColumn("_a", sequence.next_known(known, by, [seq], False))
    asking = x.filter(F.col(page).isNull() & F.col(keep_next) & F.col("_a").isNotNull()).select(*by, seq, (F.col(paragraph) - 1).alias("_low"), (F.col("_a.par") - 1).alias("_high"), F.col("_a.page").alias("_next"))
    edge = boundaries.select(*by, F.col(paragraph).alias("_edge")).distinct()
    free = intervals.boundaries_between(asking, edge, by, "_low", "_high", "_edge").filter("n_between = 0").select(*by, seq, "_next")
    return rows.join(free, [*by, seq], "left").withColumn(name, F.coalesce(page, "_next")).drop("_next")


def greedy_locations(candidates: DataFrame, units: DataFrame, doc="doc_id") -> DataFrame:
    """Places expected units one after another: (doc, unit_id, anchor_order, end_order).

    ``units`` holds (doc, unit_id, place, out_of_order), ``candidates`` (doc, unit_id, order,
    score).  A unit takes its best-scored free row after the last one taken, the
    earliest among equals; one marked out_of_order may look at all rows.  Ranges end before the next
    anchor.  Units that are not found have nulls.
    """
    schema = T.StructType([units.schema[doc], units.schema["unit_id"]]).add("anchor_order", "long").add("end_order", "long")

    def fold(own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        by_unit = {k: sorted(zip(-g["score"], g["order"])) for k, g in theirs[theirs["score"] > 0].groupby("unit_id")}
        cursor, used, places = 0, set(), []
        for u in own.sort_values("place").itertuples():
            options = [o for _, o in by_unit.get(u.unit_id, ()) if o not in used]
            ahead = [o for o in options if o > cursor]
            best = next(iter(ahead or (options if u.out_of_order else ())), None)
            if best is not None:
                cursor = max(cursor, best)
                used.add(best)
            places.append((getattr(u, doc), u.unit_id, best))
        taken = sorted((o, k) for _, k, o in places if o is not None)
        ends = {k: taken[i + 1][0] - 1 for i, (_, k) in enumerate(taken[:-1])}
        return pd.DataFrame([(d, k, o, ends.get(k)) for d, k, o in places], columns=schema.names).astype({"anchor_order": "Int64", "end_order": "Int64"})

    return units.groupBy(doc).cogroup(candidates.groupBy(doc)).applyInPandas(fold, schema)


def page_tiers(rows: DataFrame, by, page, order) -> DataFrame:
    """The place of each row on its page, and whether it is the first."""
    w = Window.partitionBy(*by, page).orderBy(*order)
    return rows.withColumn("tier", F.row_number().over(w)).withColumn("first_on_page", F.col("tier") == 1)
