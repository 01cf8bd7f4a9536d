"""Spans of template elements: notes on format, sample values, spacers, and the labels that are left."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a note on format (blanks left out, lower case), and what makes a group a choice of samples.
NOTE_WORDS = ["号", "黑体", "宋体", "楷体", "华文", "times", "newroman", "加粗", "居中", "大写", "小写", "行距", "页边距", "空一行", "空二行", "空三行", "字空", "用全称"]
CHOICE, CHOICE_MARKS = "或", ["×", "□"]
# Patterns of bracketed groups, sample marks, dots that stand for a text, and what such dots may follow.
GROUP, SPACERS = r"[（(][^（）()]{1,80}[）)]", "□+"
SAMPLE_MARK, DOTS, NUMBERED = "[□×]|…{2,}", "…{2,}$", r"[一二三四五六七八九十\d]+[\.、)]?[^…]{0,12}$"
# What a span's kind makes of it.
POLICIES = {"inline_instruction": "remove_instruction", "sample_value": "fill", "layout_spacer": "remove_instruction", "label": "fixed"}

_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _is_note(group: str) -> bool:
    bare = "".join(group.split()).lower()
    choice = CHOICE in bare and any(m in bare for m in CHOICE_MARKS)
    return not choice and any(w in bare for w in NOTE_WORDS)


def _trimmed(text: str, a: int, b: int, also: str = "") -> tuple[int, int]:
    """The range without blanks at its ends, nor characters of ``also`` at its start."""
    part = text[a:b].rstrip()
    skipped = len(part) - len(part.lstrip() if not also else re.sub(rf"^[\s{also}]+", "", part))
    return a + min(skipped, len(part)), a + len(part)


def _sample(text: str, notes: list[tuple[int, int]], fill: bool) -> list[tuple[int, int]]:
    """The one range of a text that holds a sample value, if there is one: after its colon, its closing dots, or all before the first note."""
    upto = lambda a, b: min([b, *[n for n, _ in notes if n >= a][:1]])
    colon = re.search("[：:]", text)
    if colon:
        a, b = _trimmed(text, colon.end(), upto(colon.end(), len(text)))
        if re.search(SAMPLE_MARK, text[a:b]):
            return [(a, b)]
    a, b = _trimmed(text, 0, len(text))
    a, b = _trimmed(text, a, upto(a, b))
    inner, _ = _trimmed(text, a, b, "□")
    dots = re.search(DOTS, text[inner:b])
    if dots and (dots.start() == 0 or re.search(NUMBERED, text[inner : inner + dots.start()])):
        return [(inner + dots.start(), b)]
    whole = text[a:b]
    if "×" in whole or whole == "..." or (whole and not whole.strip("…")):
        return [(a, b)]
    if not fill or inner >= b:
        return []
    colon = re.search("[：:]", text[inner:b])
    a, b = _trimmed(text, inner + colon.end(), b) if colon else (inner, b)
    return [(a, b)] if a < b else []


def _classified(text: str, fill: bool, ends: list[int]) -> list[tuple[str, int, int]]:
    notes = [m.span() for m in re.finditer(GROUP, text) if _is_note(m.group())]
    sample = _sample(text, notes, fill)
    taken = np.zeros(len(text), bool)
    for a, b in [*notes, *sample]:
        taken[a:b] = True
    runs = list(zip([0, *ends[:-1]], ends))
    spacers = [(a + m.start(), a + m.end()) for a, b in runs for m in re.finditer(SPACERS, text[a:b]) if not taken[a + m.start() : a + m.end()].any()]
    for a, b in spacers:
        taken[a:b] = True
    # labels: what is free, cut where a run begins
    edge = np.zeros(len(text) + 1, bool)
    edge[[0, *ends]] = True
    edge[1:-1] |= taken[1:] != taken[:-1]
    cuts = np.flatnonzero(edge)
    labels = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if not taken[a] and text[a:b].strip()]
    return [(kind, a, b) for kind, ranges in zip(POLICIES, (notes, sample, spacers, labels)) for a, b in ranges]


@F.pandas_udf(_SPAN)
def classified(texts: pd.Series, fill: pd.Series, ends: pd.Series) -> pd.Series:
    """Spans (kind, start, end) of a text whose runs end at ``ends``: notes, the sample, spacers, labels, each kind in order.

    Spacers and labels are cut at runs, notes and the sample are not.  SQL has no places of all matches, hence Python.
    """
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in _classified(t or "", bool(f), [int(x) for x in e])] for t, f, e in zip(texts, fill, ends)])


def element_spans(runs: DataFrame, by, order, run="raw_run_id", text="text", policy="policy") -> DataFrame:
    """(by, span_no, kind, policy, text, char_ranges): the spans of each element over all its runs, with their places in every run they touch.

    Elements are gathered, so their runs may be as many as a paragraph has; null
    texts are empty, and an element without text has no spans.  An element with any run of policy `fill` is to be filled.
    """
    part = F.struct(F.col(order).alias("_order"), F.col(run).cast("string").alias("run"), F.coalesce(text, F.lit("")).alias("text"))
    whole = runs.groupBy(*by).agg(F.array_sort(F.collect_list(part)).alias("_runs"), F.coalesce(F.bool_or(F.col(policy) == "fill"), F.lit(False)).alias("_fill"))
    step = lambda acc, r: F.array_append(acc, F.coalesce(F.element_at(acc, -1), F.lit(0)) + F.length(r["text"]))
    ends = F.aggregate("_runs", F.array(F.lit(0)), step)
    whole = whole.select(*by, "_runs", "_fill", F.array_join(F.transform("_runs", lambda r: r["text"]), "").alias("_text"), F.slice(ends, F.lit(2), F.size("_runs")).alias("_ends"))
    cut = whole.withColumn("_spans", classified("_text", "_fill", "_ends")).select(*by, "_runs", "_text", "_ends", F.posexplode("_spans").alias("_i", "_s"))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))
    a, b = F.col("_s.start"), F.col("_s.end")
    pieces = F.transform("_runs", lambda r, i: F.struct(r["run"].alias("run"), (F.greatest(a, begin(i)) - begin(i)).alias("start"), (F.least(b, F.get("_ends", i)) - begin(i)).alias("end")))
    names = F.create_map(*[F.lit(x) for pair in POLICIES.items() for x in pair])
    return cut.select(
        *by, (F.col("_i") + 1).alias("span_no"), F.col("_s.kind").alias("kind"), names[F.col("_s.kind")].alias("policy"), F.substring("_text", a + 1, b - a).alias("text"),
        F.filter(pieces, lambda p: p["start"] < p["end"]).alias("char_ranges"),
    )
