"""Text functions as Column expressions: normal forms, markers, facts, labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a note on format in brackets.
FORMAT_MARKERS = ["号", "黑体", "宋体", "楷体", "仿宋", "Times", "居中", "加粗", "行距", "字号", "字体", "页边距", "厘米", "空格", "格式", "pt", "表示"]
# Words that mark an instruction to the writer.
ANCHOR_INSTRUCTIONS = ["如果", "点击", "建议", "选择", "插入", "模板", "说明", "格式", "更新", "使用", "可以", "不建议"]
# Words of a description, and descriptions that stand alone.
DESCRIPTORS = ["当前阶段", "目标输出", "系统生成", "××", "模板", "正文", "标题", "内容流"]
DESCRIPTOR_WORDS = ["固定", "填充", "生成", "手工", "学生"]

_SPACE = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(x) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), _SPACE, " "), "^ | $", "")


def folded(x) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(_c(x), _SPACE, ""))


def contains_any(x, markers) -> Column:
    """Whether any of the literal markers stands in the text."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(x).contains(m), F.lit(False)) for m in markers])


def without_format_notes(x) -> Column:
    """Without bracketed groups that hold a format marker; other groups stay."""
    words = "|".join(FORMAT_MARKERS)
    x = F.regexp_replace(_c(x), f"（[^（）]*(?:{words})[^（）]*）", "")
    return F.regexp_replace(x, rf"\([^()]*(?:{words})[^()]*\)", "")


# What a matching form leaves out, in this order: placeholders, leaders, blanks and punctuation.
PLACEHOLDERS = "[□×Xx_＿]+"
LEADERS = "[…·•.。．]{2,}"
PUNCTUATION = "(?U)[\\s:：;；,，.。!！?？、（）()《》<>“”\"'‘’\\[\\]【】]"


def match_key(x, squeeze: bool = True) -> Column:
    """The form in which texts are matched: no format notes, placeholders, leaders, blanks or punctuation, lower case."""
    bare = without_format_notes(squeezed(x) if squeeze else F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.lower(reduce(lambda text, pattern: F.regexp_replace(text, pattern, ""), [PLACEHOLDERS, LEADERS, PUNCTUATION], bare))


def is_descriptor(x) -> Column:
    """Whether a text describes a field rather than being its content."""
    return _c(x).isin(*DESCRIPTOR_WORDS) | (contains_any(x, DESCRIPTORS) & ~_c(x).contains("："))


def match_tokens(x) -> Column:
    """Distinct matching forms, two characters or more, of what stands between punctuation."""
    raw = F.split(without_format_notes(squeezed(x)), "(?U)[:：;；,，.。、\\s/]+")
    keys = F.transform(raw, lambda t: match_key(t))
    return F.array_distinct(F.filter(keys, lambda t: (F.length(t) >= 2) & ~is_descriptor(t)))


def stable_anchors(x) -> Column:
    """Distinct runs of four or more Latin letters or Chinese characters."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit("([A-Za-z\\x{3400}-\\x{9fff}]{4,})")))


def preview(x, limit: int = 320) -> Column:
    """The squeezed text, cut with three dots at ``limit`` characters."""
    s = squeezed(x)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


def safe_identifier(x) -> Column:
    """Letters, digits, `_` and `-`; everything else becomes `_`; `unnamed` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(_c(x)), "[^0-9A-Za-z_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def _found(x, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is no match."""
    return F.when(F.regexp_like(_c(x), F.lit(pattern)), F.regexp_extract(_c(x), pattern, group))


def trailing_token(x) -> Column:
    """The last run of visible characters, null if there is none."""
    return _found(x, "(?U)(\\S+)\\s*$")


def leader_run(x) -> Column:
    """The dots before the last token, null if there are none."""
    return _found(x, "(?U)([…\\.．·•]{2,})\\s*\\S+\\s*$")


def bracketed(x) -> Column:
    """What stands in round brackets, Chinese or Latin."""
    groups = F.regexp_extract_all(_c(x), F.lit("（([^）]*)）|\\(([^)]*)\\)"), F.lit(0))
    return F.transform(groups, lambda g: F.substring(g, F.lit(2), F.length(g) - 2))


def text_facts(x) -> Column:
    """Length, tab and line-break flags, bracketed parts, last token and leader dots of a text."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.struct(
        F.length(t).alias("char_count"), t.contains("\t").alias("has_tab"), t.contains("\n").alias("has_line_break"), bracketed(t).alias("bracketed"),
        trailing_token(t).alias("trailing_token"), leader_run(t).alias("leader_run"), squeezed(t).alias("normalized"),
    )


def partial_match(needle, text) -> Column:
    """Whether a matching form stands in another: needles of two characters or fewer at its start alone."""
    n, t = _c(needle), _c(text)
    return F.when(F.length(n) <= 2, t.startswith(n)).otherwise(t.contains(n))


# Points of a needle that is the entry, or stands in it; of tokens; and what an entry's features add or take away.
WHOLE_NEEDLE, PART_NEEDLE, TOKENS, EACH_TOKEN = 120, 70, 35, 8
FEATURES = [
    ("length", "<=", 24, 30),
    ("length", ">", 80, -35),
    ("length", ">", 140, -45),
    ("size", ">=", 15, 15),
    ("alignment", "is", ["center"], 20),
    ("style", "has", ["heading", "标题"], 20),
    ("style", "has", ["正文前标题", "正文尾标题"], 25),
    ("text", "has", ANCHOR_INSTRUCTIONS, -90),
    ("text", "has", ["\t"], -20),
]


def _feature_points(values: dict[str, Column]) -> Column:
    """The points of all features that hold, summed over the table above; a null holds nothing."""
    tests = {"<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "is": lambda c, v: c.isin(*v), "has": contains_any}
    points = [F.when(F.coalesce(tests[kind](values[of], against), F.lit(False)), worth).otherwise(0) for of, kind, against, worth in FEATURES]
    return reduce(lambda a, b: a + b, points)


def anchor_score(text, style, alignment, font_pt, full, tokens, least_tokens) -> Column:
    """How well an entry stands for the heading that full needles and tokens describe; 0 for no match.

    ``text``, ``style``, ``alignment`` and ``font_pt`` describe the entry, ``full``
    and ``tokens`` are arrays of matching forms.
    """
    raw, key = F.trim(F.coalesce(_c(text), F.lit(""))), match_key(text)
    worth = F.transform(F.filter(_c(full), lambda n: n != ""), lambda n: F.when(n == key, WHOLE_NEEDLE).when(partial_match(n, key), PART_NEEDLE).otherwise(0))
    hits = F.size(F.filter(_c(tokens), lambda n: (n != "") & ((n == key) | partial_match(n, key))))
    enough = (hits > 0) & (hits >= F.coalesce(_c(least_tokens), F.lit(1)))
    base = F.greatest(F.coalesce(F.array_max(worth), F.lit(0)), F.when(enough, TOKENS + EACH_TOKEN * hits).otherwise(0))
    features = {"length": F.length(raw), "size": _c(font_pt), "alignment": _c(alignment), "style": F.lower(F.coalesce(_c(style), F.lit(""))), "text": raw}
    return F.when(base > 0, base + _feature_points(features)).otherwise(0)


def policy_of(status, kind, fill) -> Column:
    """fixed, generated, fill or template_default_optional, by the first rule of this order that holds."""
    s, k, f = (F.coalesce(_c(x), F.lit("")) for x in (status, kind, fill))
    every = F.concat_ws(" ", s, k, f)
    return (
        F.when(contains_any(every, ["fixed", "手工", "手填"]), "fixed")
        .when(contains_any(every, ["生成"]), "generated")
        .when(k.contains("填充") | ((f != "") & ~f.contains("否")), "fill")
        .when(every.contains("optional"), "template_default_optional")
        .otherwise("fixed")
    )


def field_value(x, field: str) -> Column:
    """The value of `field=value` up to a Chinese semicolon or the end of the line, empty if there is none."""
    return F.trim(F.regexp_extract(_c(x), f"\\Q{field}\\E=([^；\\n]+)", 1))


def is_toc_entry(x) -> Column:
    """A line with a tab, or with leader dots before a page number."""
    t = F.coalesce(_c(x), F.lit(""))
    return t.contains("\t") | F.regexp_like(t, F.lit("(?U)[…\\.．·•]{2,}\\s*(\\d+|[ivxlcIVXLC]+)\\s*$"))


def is_format_instruction(x) -> Column:
    """A bracketed note on font or spacing, whatever its case."""
    return F.regexp_like(F.coalesce(_c(x), F.lit("")), F.lit("(?i)[（(].*(宋体|黑体|楷体|居中|行距|字号|号字|pt).*[）)]"))


def replaced_ranges(x, ranges) -> Column:
    """The text with each range (start, end, replacement), from 0, replaced from right to left."""
    backward = F.reverse(F.array_sort(_c(ranges)))
    return F.aggregate(backward, _c(x), lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["replacement"], F.substring(t, r["end"] + 1, F.length(t))))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def atomic_spans(texts: pd.Series) -> pd.Series:
    """A text cut at bracketed groups, placeholder runs and after colons: ordered, complete, not overlapping.

    An empty text has the one span (0, 0).  SQL has no places of all matches, hence Python.
    """
    import re

    # fixed values: what bounds a visible span
    patterns = [re.compile(p) for p in (r"[（(][^（）()]{1,160}[）)]", r"□+", r"×+", r"…{2,}", r"\.{3,}", r"_{2,}")]
    colon = re.compile("[：:]")

    def cut(text):
        size = len(text or "")
        bounds = np.zeros(size + 1, bool)
        for p in patterns if size else ():
            bounds[[place for m in p.finditer(text) for place in m.span()]] = True
        bounds[[m.end() for m in colon.finditer(text or "")]] = True
        bounds[0] = False
        starts = [0, *np.flatnonzero(bounds[:size]).tolist()]
        return [{"start": a, "end": b, "text": (text or "")[a:b]} for a, b in zip(starts, [*starts[1:], size])]

    return texts.map(cut, na_action=None)
