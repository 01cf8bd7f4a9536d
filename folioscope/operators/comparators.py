"""Comparison of expected with actual values by mode, from canonical JSON values.

Both sides are JSON text, null where the path could not be read; a value that
is there and null is the text `null`.  Modes are one CASE over built-in
functions; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import squeezed

# The comparison modes, with the finding that each makes.
MISMATCH = {
    "exact": "exact_mismatch",
    "relationship": "relationship_mismatch",
    "normalized_text": "normalized_text_mismatch",
    "ordered_sequence": "ordered_sequence_mismatch",
    "set": "set_mismatch",
    "set_equality": "set_mismatch",
    "subset": "subset_missing",
    "numeric_tolerance": "numeric_tolerance_mismatch",
    "style_profile": "style_profile_mismatch",
    "oracle_required": "oracle_failed",
}


def _scalar(value: Column) -> Column:
    """A scalar's text; numbers and booleans as numbers, so that 1, 1.0 and true are equal."""
    number = F.try_variant_get(F.try_parse_json(value), "$", "double")
    truth = F.when(value == "true", 1.0).when(value == "false", 0.0)
    return F.coalesce(F.coalesce(truth, F.when(~value.startswith('"'), number)).cast("string"), value)


def _items(value: Column) -> Column:
    """An array's items as text; null if the value is no array."""
    return F.transform(F.from_json(F.when(value.startswith("["), value), "array<variant>"), lambda x: F.to_json(F.struct(x.alias("v"))))


def _entries(value: Column) -> Column:
    """An object's entries as texts key:value; null if the value is no object."""
    return F.transform(F.map_entries(F.from_json(F.when(value.startswith("{"), value), "map<string,variant>")), lambda e: F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v"))))


def compared(dimensions: DataFrame, expected="expected", actual="actual", mode="comparator_mode") -> DataFrame:
    """Adds status and finding type to dimensions (expected, actual, comparator_mode, required, tolerance, tolerance_abs, tolerance_percent).

    Dimensions with ``required`` false are left out; null counts as required.
    Unknown modes, unreadable sides, a percentage of 0 and values of the wrong
    kind are UNKNOWN.
    """
    e, a, m = F.col(expected), F.col(actual), F.col(mode)
    number = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "double")
    text = lambda c: squeezed(F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "string"), c))
    ei, ai, ee, ae = _items(e), _items(a), _entries(e), _entries(a)
    limit = F.coalesce("tolerance", "tolerance_abs", F.abs(number(e)) * F.col("tolerance_percent") / 100, F.lit(0.0))
    of_percent = F.col("tolerance").isNull() & F.col("tolerance_abs").isNull() & F.col("tolerance_percent").isNotNull()
    # true: equal, false: different, null: cannot be told
    equal = (
        F.when(m.isin("exact", "relationship"), _scalar(e) == _scalar(a))
        .when(m == "normalized_text", text(e) == text(a))
        .when(m == "ordered_sequence", ei == ai)
        .when(m.isin("set", "set_equality"), F.array_sort(F.array_distinct(ei)) == F.array_sort(F.array_distinct(ai)))
        .when(m == "subset", F.size(F.array_except(ei, ai)) == 0)
        .when(m == "numeric_tolerance", F.when(of_percent & (F.coalesce(number(e), F.lit(0.0)) == 0), None).otherwise(F.abs(number(e) - number(a)) <= limit))
        .when(m == "style_profile", F.size(F.array_except(ee, ae)) == 0)
        .when(m == "oracle_required", F.when(a.isin("true", '"PASS"'), True).when(a.isin("false", '"FAIL"'), False))
    )
    unread = e.isNull() | a.isNull()
    known = m.isin(*MISMATCH)
    names = F.create_map(*[F.lit(x) for pair in MISMATCH.items() for x in pair])
    finding = F.when(~F.coalesce(known, F.lit(False)), "unsupported_comparator_mode").when(unread, "dimension_unreadable").when(equal.isNull(), "not_comparable").when(~equal, names[m])
    status = F.when(finding.isNull(), "PASS").when(finding.isin(*set(MISMATCH.values())), "FAIL").otherwise("UNKNOWN")
    return dimensions.filter(F.coalesce(F.col("required"), F.lit(True))).withColumns({"finding": finding, "status": status})


def at_path(document: Column, path: str) -> Column:
    """The JSON text at a dotted path such as `a.b[0]`; null if there is none, `null` if it is there and null."""
    found = F.try_variant_get(F.try_parse_json(document), f"$.{path}", "variant")
    return F.when(F.is_variant_null(found), "null").otherwise(F.to_json(found))
