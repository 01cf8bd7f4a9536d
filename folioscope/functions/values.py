"""Numbers, units, ranges and hashes as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lenient_long(x) -> Column:
    """A whole number from text or number, cut off towards zero; null where there is none."""
    text = F.trim(_c(x).cast("string"))
    truth = F.when(F.lower(text) == "true", 1).when(F.lower(text) == "false", 0)
    return F.coalesce(truth, text.try_cast("double").cast("long"))


def points_to_mm(x) -> Column:
    """Points as millimetres to two places."""
    return F.round(_c(x) * 25.4 / 72, 2)


def twips_to_points(x) -> Column:
    """Twentieths of a point as points; half points are ``x / 2``."""
    return _c(x) / 20


def shortest(x) -> Column:
    """A number as `%g` writes it, for numbers that need no exponent and six digits at most."""
    text = F.format_string("%.6f", _c(x).cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def line_spacing(line, rule) -> Column:
    """single, 1.5, double, multiple:n, exact:npt or atleast:npt from twentieths of a point (240 to a line) and a rule."""
    n, r = _c(line).cast("double"), F.lower(F.coalesce(_c(rule), F.lit("auto")))
    auto = F.when(n == 240, "single").when(n == 360, "1.5").when(n == 480, "double").otherwise(F.concat(F.lit("multiple:"), shortest(n / 240)))
    fixed = F.concat(F.when(r == "exact", "exact:").otherwise("atleast:"), shortest(n / 20), F.lit("pt"))
    return F.when(n.isNull(), None).when(r == "auto", auto).otherwise(fixed)


def line_spacing_matches(expected, actual) -> Column:
    """Equal, or of one kind and within 0.05 lines, or 0.25 points."""
    def part(x):
        x = _c(x)
        kind = F.when(x.isin("single", "1.5", "double") | x.startswith("multiple:"), "multiple").when(x.startswith("exact:"), "exact").otherwise(x)
        named = F.when(x == "single", 1.0).when(x == "1.5", 1.5).when(x == "double", 2.0)
        return kind, F.coalesce(named, F.regexp_extract(x, "^(?:exact|multiple):(.*?)(?:pt)?$", 1).try_cast("double"))

    (ek, ev), (ak, av) = part(expected), part(actual)
    near = F.abs(ev - av) <= F.when(ek == "multiple", 0.05).otherwise(0.25)
    return F.coalesce((_c(expected) == _c(actual)) | ((ek == ak) & near), F.lit(False))


def close(a, b, tolerance: float) -> Column:
    """Whether two numbers are within the tolerance; null on either side is not."""
    return F.coalesce(F.abs(_c(a) - _c(b)) <= tolerance, F.lit(False))


def margins_mm(x) -> Column:
    """Margins in mm from a text such as `上=25mm，下=25mm`, or one `页边距=20mm` for all four; nulls where not said."""
    number = "[=＝：: ]*(\\d+(?:\\.\\d+)?) *mm"
    side = lambda s: F.regexp_extract(_c(x), s + number, 1).try_cast("double")
    every = side("页边距")
    # fixed values: the words for the four sides
    return F.struct(*[F.coalesce(side(word), every).alias(name) for name, word in (("top", "上"), ("bottom", "下"), ("left", "左"), ("right", "右"))])


def is_a4(width_mm, height_mm, tolerance: float = 0.6) -> Column:
    """A4 either way up."""
    w, h = _c(width_mm), _c(height_mm)
    return (close(w, F.lit(210.0), tolerance) & close(h, F.lit(297.0), tolerance)) | (close(w, F.lit(297.0), tolerance) & close(h, F.lit(210.0), tolerance))


# The words and patterns by which a text asks for fonts, sizes, weight, alignment and line spacing.
FONT_PATTERN = "((?:[\\x{4e00}-\\x{9fff}A-Za-z ]{1,30}(?:黑体|宋体|楷体|仿宋|行楷))|Times New Roman)"
SIZE_PATTERN = "(\\d+(?:\\.\\d+)?)\\s*pt"
EXACT_PATTERN = "固定(?:值|行距约)?\\s*(\\d+(?:\\.\\d+)?)\\s*pt"
MULTIPLE_PATTERN = "多倍行距[；;，, ]*设置值[=＝]?\\s*(\\d+(?:\\.\\d+)?)"
WEIGHTS = [("不加粗", False), ("加粗", True)]
ALIGNMENTS = [("居中", "center"), ("两端对齐", "both"), ("左对齐", "left")]
SPACINGS = [("单倍行距", "single"), ("1.5 倍行距", "1.5"), ("1.5倍行距", "1.5")]


def _first_word(t: Column, table) -> Column:
    """The value of the first word of a table that stands in the text."""
    return F.coalesce(*[F.when(t.contains(word), F.lit(value)) for word, value in table])


def style_requirements(x) -> Column:
    """Fonts, size, weight, alignment and line spacing that a text asks for; nulls for what it does not say."""
    t = _c(x)
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("double")
    exact, multiple = number(EXACT_PATTERN), number(MULTIPLE_PATTERN)
    spacing = F.coalesce(
        F.when(exact.isNotNull(), F.concat(F.lit("exact:"), shortest(exact), F.lit("pt"))), F.when(multiple.isNotNull(), F.concat(F.lit("multiple:"), shortest(multiple))), _first_word(t, SPACINGS)
    )
    return F.struct(
        F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(FONT_PATTERN)), lambda f: F.trim(f))).alias("fonts"), number(SIZE_PATTERN).alias("font_size_pt"),
        _first_word(t, WEIGHTS).alias("bold"), _first_word(t, ALIGNMENTS).alias("alignment"), spacing.alias("line_spacing"),
    )


def truthy(*values) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*[F.nullif(_c(v), F.lit(0)) for v in values])


def field_type(instruction) -> Column:
    """The first word of a field instruction in capitals."""
    return F.upper(F.regexp_extract(F.trim(_c(instruction)), "^(\\S+)", 1))


def toc_range(x) -> Column:
    """The level range of a table of contents as `1-3`, null if none is said."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(x), "([1-9]\\s*[-–—~至]\\s*[1-9])", 1), "\\s*[-–—~至]\\s*", "-"), F.lit(""))


def union_box(*columns) -> list[Column]:
    """Aggregates: the box around all boxes (x_min, y_min, x_max, y_max); null if any of them is not whole."""
    bad = F.bool_or(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1)
    return [F.when(~bad, f(c)).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), columns)]


def sha256_text(x) -> Column:
    """sha256:<hex> of a text or of bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(x).cast("binary"), 256))


@F.pandas_udf(T.StringType())
def sha256_json(documents: pd.Series) -> pd.Series:
    """sha256:<hex> of the canonical form of JSON texts: sorted keys, no blanks, non-ASCII as it is, nulls kept; null if it is no JSON."""
    import hashlib
    import json

    def digest(text):
        try:
            data = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None
        return "sha256:" + hashlib.sha256(data.encode()).hexdigest()

    return documents.map(digest)
