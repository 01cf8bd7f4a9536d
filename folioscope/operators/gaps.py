"""Ladders of a gap report: what is said of elements, styles, fields, headers, page numbers and page rules.

Each function takes columns of facts and gives the struct (status, outcome).
The facts come from the matching, interval and alignment operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.rules import Rung, decided
from folioscope.operators.status import FAIL, PASS, UNKNOWN, verdict


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def element_presence(marker, structured, located, text, spread, policy, searchable) -> Column:
    """Whether an element is there: by its mark, its structure, its text, its text over several places, or else by what its policy lets one say.

    ``structured`` is the status that a structural rule gives, null where none applies; the others but ``policy`` are booleans.
    """
    fixed, generated, s = _c(policy) == "fixed", _c(policy) == "generated", _c(structured)
    return decided(
        [
            Rung(_c(marker), PASS, "marked"),
            *(Rung(s == status, status, "structured") for status in (PASS, FAIL, UNKNOWN)),
            Rung(~F.coalesce(_c(located), F.lit(False)), UNKNOWN, "unit_unlocated"),
            Rung(_c(text), PASS, "found"),
            Rung(_c(spread), PASS, "found_across_sources"),
            Rung(fixed & ~F.coalesce(_c(searchable), F.lit(False)), UNKNOWN, "uncheckable"),
            Rung(fixed, FAIL, "missing"),
            Rung(generated, UNKNOWN, "generated_source_unknown"),
        ],
        UNKNOWN,
        "source_unknown",
    )


def style_ladder(expected, same_name, n_mismatched, n_matched, n_unknown) -> Column:
    """Whether a style is as declared: a name that agrees outweighs properties that do not."""
    wrong, right, open_ = (F.coalesce(_c(x), F.lit(0)) for x in (n_mismatched, n_matched, n_unknown))
    return decided(
        [
            Rung(F.coalesce(_c(expected), F.lit("")) == "", PASS, "not_required"),
            Rung(_c(same_name), PASS, "match"),
            Rung(wrong > 0, FAIL, "mismatch"),
            Rung((right > 0) & (open_ == 0), PASS, "match"),
        ],
        UNKNOWN,
        "unverified",
    )


def field_ladder(bound, n_in_unit, n_of_kind, mismatched, equivalent) -> Column:
    """Whether a unit has the field it needs: in its range and with its parameters, elsewhere, in another form, or not at all."""
    inside, any_ = F.coalesce(_c(n_in_unit), F.lit(0)) > 0, F.coalesce(_c(n_of_kind), F.lit(0)) > 0
    wrong, other = (F.coalesce(_c(x), F.lit(False)) for x in (mismatched, equivalent))
    return decided(
        [
            Rung(~F.coalesce(_c(bound), F.lit(False)), UNKNOWN, "unverified"),
            Rung(inside & wrong & other, UNKNOWN, "unverified"),
            Rung(inside & wrong, FAIL, "mismatch"),
            Rung(inside, PASS, "match"),
            Rung(any_, FAIL, "out_of_unit"),
            Rung(other, UNKNOWN, "unverified"),
        ],
        FAIL,
        "missing",
    )


# Words by which a rule says that there is nothing, no page number, or which numbers.
NONE_RULES, NONE_WORDS = ["无", "默认无"], ["默认无", "源模板无"]
NO_NUMBER, NO_FIELD, ROMAN, ARABIC = "不显示页码", "无页码字段", "前置页页码规则", "阿拉伯数字页码规则"
# Words of page rules.
START_OF_DOCUMENT, YES, NO = "文档首页", "是", "否"
NOT_REQUIRED = ["否/未要求", "不要求", "随正文首页"]


def means_none(rule) -> Column:
    """Whether a rule asks for nothing."""
    return _c(rule).isin(*NONE_RULES) | F.contains(_c(rule), F.lit(NONE_WORDS[0])) | F.contains(_c(rule), F.lit(NONE_WORDS[1]))


def header_ladder(bound, rule, text) -> Column:
    """Whether a section's header says what its rule asks for, or nothing where that asks for nothing."""
    said = F.coalesce(_c(text), F.lit(""))
    fits = F.when(means_none(rule), said == "").otherwise(said.contains(_c(rule)))
    return decided([Rung(~F.coalesce(_c(bound), F.lit(False)), UNKNOWN, "unverified"), Rung(fits, PASS, "match")], FAIL, "mismatch")


def page_number_ladder(bound, rule, has_number, number_format) -> Column:
    """Whether a section's page numbers are as its rule says: none, Roman, Arabic, or no field."""
    r, there, form = _c(rule), F.coalesce(_c(has_number), F.lit(False)), F.lower(F.coalesce(_c(number_format), F.lit("")))
    none, roman, arabic = (r == NONE_RULES[0]) | r.contains(NO_NUMBER), r.contains(ROMAN), r.contains(ARABIC)
    return decided(
        [
            Rung(~F.coalesce(_c(bound), F.lit(False)), UNKNOWN, "unverified"),
            Rung(none & ~there, PASS, "match"),
            Rung(none, FAIL, "mismatch"),
            Rung(roman & there & form.endswith("roman"), PASS, "match"),
            Rung(roman, FAIL, "mismatch"),
            Rung(arabic & there & form.isin("decimal", ""), PASS, "match"),
            Rung(arabic, FAIL, "mismatch"),
            Rung(r.contains(NO_FIELD) & ~there, PASS, "match"),
        ],
        UNKNOWN,
        "unverified",
    )


def page_ladder(bound, field, rule, first, at_start, n_breaks, n_sections, n_kept, n_tables) -> Column:
    """Whether a unit begins, is set apart and is kept together as its page rule of kind ``field`` says."""
    f, r = _c(field), F.trim(_c(rule))
    breaks, sections, kept = (F.coalesce(_c(x), F.lit(0)) > 0 for x in (n_breaks, n_sections, n_kept))
    start, apart, together = f == "page_break", f == "section_isolation", f == "keep_together"
    opens, yes = _c(rule).contains(START_OF_DOCUMENT), (r == YES) | r.startswith(YES + "；")
    no = (r == NO) | r.contains(NOT_REQUIRED[0]) | r.contains(NOT_REQUIRED[1]) | r.contains(NOT_REQUIRED[2])
    broken = F.coalesce(_c(at_start), F.lit(False)) | breaks | sections
    return decided(
        [
            Rung(~F.coalesce(_c(bound), F.lit(False)), UNKNOWN, "unverified"),
            Rung(start & opens & (_c(first) <= 5), PASS, "match"),
            Rung(start & opens, FAIL, "mismatch"),
            Rung(start & yes & broken, PASS, "match"),
            Rung(start & yes, FAIL, "mismatch"),
            Rung(start & no & breaks, FAIL, "mismatch"),
            Rung(start & no, PASS, "match"),
            Rung(apart & yes & sections, PASS, "match"),
            Rung(apart & yes, FAIL, "mismatch"),
            Rung(together & kept, PASS, "match"),
        ],
        UNKNOWN,
        "unverified",
    )


def first_portrait(sections: DataFrame, by, order, landscape, values) -> DataFrame:
    """The figures of the first section of each document that stands upright, or of its first where none does."""
    place = F.struct(F.coalesce(F.col(landscape), F.lit(False)), F.col(order))
    return sections.groupBy(*by).agg(*[F.min_by(v, place).alias(v) for v in values])


#: Millimetres by which a distance may differ.
NEAR_MM = 0.35


def distances(actual_points: dict, expected_mm: dict, absent_is_zero=()) -> Column:
    """Whether distances in points agree with those expected in millimetres: {name: column} twice.

    A name with no figure fails, or counts as 0 if it is in ``absent_is_zero``
    (the gutter); without any figure at all nothing can be said.
    """
    tests = []
    for name, want in expected_mm.items():
        got = F.round(_c(actual_points[name]) * F.lit(25.4 / 72), 2)
        got = F.coalesce(got, F.lit(0.0)) if name in absent_is_zero else got
        tests.append(F.when(_c(want).isNull(), True).otherwise(F.coalesce(F.abs(got - _c(want)) <= NEAR_MM, F.lit(False))))
    known = F.coalesce(*[_c(x).cast("double") for x in actual_points.values()]).isNotNull()
    fits = tests[0]
    for t in tests[1:]:
        fits = fits & t
    return decided([Rung(~known, UNKNOWN, "unknown"), Rung(fits, PASS, "match")], FAIL, "mismatch")


def unit_results(checks: DataFrame, by, dimension, status) -> DataFrame:
    """One row a unit: the status counts of each dimension (presence, element, style, page, header_footer, fields, numbering) and of all, with the verdict."""
    names = ["presence", "element", "style", "page", "header_footer", "fields", "numbering"]
    count = lambda where: F.struct(*[F.count_if(where & (F.col(status) == s)).alias(n) for s, n in ((PASS, "passed"), (FAIL, "failed"), (UNKNOWN, "unknown"))])
    counted = checks.groupBy(*by).agg(*[count(F.col(dimension) == d).alias(d) for d in names], count(F.col(dimension).isin(*names)).alias("counts"))
    return counted.withColumn("verdict", verdict(F.col("counts.passed"), F.col("counts.failed"), F.col("counts.unknown")))


def check_path(category, affected, kind) -> Column:
    """Where in a report a check belongs, from its category and the dotted id that it is about; null: about nothing in particular."""
    c, a = _c(category), _c(affected)
    parts = F.split(a, r"\.")
    unit, last, rest = parts[0], F.element_at(parts, -1), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    path = lambda *x: F.array(*[F.lit(i) if isinstance(i, str) else i for i in x])
    tail = lambda name: F.when(rest == "", name).otherwise(rest)
    return (
        F.when(c == "actual_tree", path("unmodeled_objects", F.coalesce(a, _c(kind))))
        .when(a.isNull(), path("global", c, _c(kind)))
        .when((c == "unit") & _c(kind).contains("order"), path("global", "unit_order"))
        .when(c == "unit", path("units", unit, "presence"))
        .when((c == "element") & (F.size(parts) > 1), path("units", unit, "elements", parts[1], "presence"))
        .when((c == "style") & (F.size(parts) > 1), path("units", unit, "elements", parts[1], "style"))
        .when(c == "page_rule", path("units", unit, "dimensions", "page", last))
        .when(c == "header_footer", path("units", unit, "dimensions", "header_footer", last))
        .when(c == "field", path("units", unit, "dimensions", "fields", tail("field")))
        .when(c == "numbering", path("units", unit, "dimensions", "numbering", tail("numbering")))
        .otherwise(path("global", c, a))
    )


def narrowed(candidates: DataFrame, key, fits) -> DataFrame:
    """The candidates of each key that fit, or all of them where none does."""
    any_ = F.bool_or(F.coalesce(_c(fits), F.lit(False))).over(Window.partitionBy(*key))
    return candidates.withColumn("_any", any_).filter(~F.col("_any") | F.coalesce(_c(fits), F.lit(False))).drop("_any")
