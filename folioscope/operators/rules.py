"""Rules as data: ladders, of which the first rule that holds decides, and sets, of which each broken rule is a finding.

A ladder is one CASE over a row of facts and a set is one pass over the rows it
judges.  Facts that need other rows (counts, partners, neighbours) are joined
or windowed first; the rules themselves never shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.status import FAIL, PASS, UNKNOWN


@dataclass(frozen=True)
class Rung:
    """What a row is called where ``when`` holds."""

    when: Column
    status: str
    outcome: str


def decided(rungs: list[Rung], status: str, outcome: str) -> Column:
    """The struct (status, outcome) of the first rung that holds, or else of the last two arguments; a null condition does not hold."""
    as_struct = lambda s, o: F.struct(F.lit(s).alias("status"), F.lit(o).alias("outcome"))
    return reduce(lambda rest, r: F.when(F.coalesce(r.when, F.lit(False)), as_struct(r.status, r.outcome)).otherwise(rest), reversed(rungs), as_struct(status, outcome))


@dataclass(frozen=True)
class Check:
    """A rule that rows must keep: where ``broken`` holds (null: not) it is a finding."""

    name: str
    broken: Column
    status: str = FAIL


def findings(df: DataFrame, key, checks: list[Check]) -> DataFrame:
    """(key, check_no, check, status): a row for each rule that a row breaks, in the order of the rules."""
    found = F.array(*[F.when(F.coalesce(c.broken, F.lit(False)), F.struct(F.lit(i).alias("check_no"), F.lit(c.name).alias("check"), F.lit(c.status).alias("status"))) for i, c in enumerate(checks, 1)])
    return df.select(*key, F.explode(F.array_compact(found)).alias("_f")).select(*key, "_f.*")


def gate(found: DataFrame, subjects: DataFrame, by) -> DataFrame:
    """PASS, FAIL or UNKNOWN for each subject by its findings; no finding is PASS."""
    worst = found.groupBy(*by).agg(F.count_if(F.col("status") == FAIL).alias("n_fail"), F.count_if(F.col("status") == UNKNOWN).alias("n_unknown"))
    out = subjects.select(*by).distinct().join(worst, by, "left").fillna(0, ["n_fail", "n_unknown"])
    return out.withColumn("verdict", F.when(F.col("n_fail") > 0, FAIL).when(F.col("n_unknown") > 0, UNKNOWN).otherwise(PASS))


# -- stages ---------------------------------------------------------------------

# Policies that an element may have.
POLICIES = ["fixed", "template_default", "fill", "generated", "instruction_remove"]


def unit_facts(units: DataFrame, by, unit="unit_id", order="place", start="start_page", end="end_page", pages="page_count") -> DataFrame:
    """Units with what the others of their document tell: how often their id stands, and the page at which they should begin.

    A unit whose pages are at fault does not move the page expected of the next.
    ``expected_end`` is what the whole list leaves, on the last unit alone.  The
    list of one document's units is folded as an array, so it takes one shuffle.
    """
    rest = [c for c in units.columns if c not in by]
    listed = units.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*rest).alias("_row")))).alias("_units"))
    first = F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<bigint>").alias("seen"))

    def step(acc, u):
        s, e, n = (u["_row"][c].cast("long") for c in (start, end, pages))
        whole = F.coalesce((n > 0) & (s == acc["next"]) & (s <= e) & (e <= n), F.lit(False))
        return F.struct(F.when(whole, e + 1).otherwise(acc["next"]).alias("next"), F.array_append(acc["seen"], acc["next"]).alias("seen"))

    folded = listed.withColumn("_f", F.aggregate("_units", first, step))
    out = folded.select(*by, "_f", F.size("_units").alias("_n"), F.posexplode("_units").alias("_i", "_u"))
    out = out.select(*by, "_u._row.*", F.get("_f.seen", F.col("_i")).alias("expected_start"), F.when(F.col("_i") == F.col("_n") - 1, F.col("_f.next")).alias("expected_end"))
    return out.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(*by, unit)))


def unit_checks(start="start_page", end="end_page", pages="page_count", policy_errors="policy_errors") -> list[Check]:
    """Units cover the pages once, in order, to the last one, under unique ids and with a page policy in due form."""
    s, e, n = F.col(start), F.col(end), F.col(pages)
    whole = s.isNotNull() & e.isNotNull() & (n > 0) & (s == F.col("expected_start")) & (s <= e) & (e <= n)
    return [
        Check("unit_id_duplicate", F.col("n_same") > 1),
        Check("page_boundary_invalid", ~F.coalesce(whole, F.lit(False))),
        Check("page_policy_invalid", F.col(policy_errors) > 0),
        Check("page_coverage_incomplete", F.col("expected_end") != n + 1),
    ]


def element_checks(policy="policy", source="fill_source", field="field_type") -> list[Check]:
    """Elements have a known policy, and what it asks for."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        Check("policy_invalid", ~F.coalesce(F.col(policy).isin(*POLICIES), F.lit(False))),
        Check("fill_source_missing", (F.col(policy) == "fill") & empty(source)),
        Check("generated_field_type_missing", (F.col(policy) == "generated") & empty(field)),
    ]


def policy_conflicts(elements: DataFrame, groups: DataFrame, unit="unit_id", policy="policy") -> DataFrame:
    """Elements whose policy their unit's group does not allow, with what was expected.

    ``groups`` is (unit_id, unit_group), one row a unit and group: generated, fixed, or
    fixed_allows_fill.  A unit in the generated group has generated, fixed and
    removed elements alone; a fixed one has none to fill, unless that is allowed.
    """
    has = lambda g: F.coalesce(F.bool_or(F.col("unit_group") == g), F.lit(False))
    per = groups.groupBy(F.col("unit_id").alias("_u")).agg(has("generated").alias("_generated"), has("fixed").alias("_fixed"), has("fixed_allows_fill").alias("_fill"))
    p = F.coalesce(F.col(policy), F.lit(""))
    expected = F.when(F.col("_generated") & ~p.isin("generated", "fixed", "instruction_remove"), "generated").when(F.col("_fixed") & ~F.col("_fill") & (p == "fill"), "fixed")
    out = elements.join(per, F.col(unit) == F.col("_u")).withColumn("expected", expected).filter(F.col("expected").isNotNull())
    return out.drop("_u", "_generated", "_fixed", "_fill")


def required_gaps(elements: DataFrame, required: dict[str, list[str]], policy="policy") -> DataFrame:
    """Elements that lack fields that their policy requires, with the ``missing`` ones; ``required`` is {policy: fields}."""
    lacks = lambda f: F.when(F.coalesce(F.col(f).cast("string"), F.lit("")).isin("", "[]"), F.lit(f))
    missing = reduce(lambda rest, p: F.when(F.col(policy) == p, F.array_compact(F.array(*map(lacks, required[p])))).otherwise(rest), required, F.array().cast("array<string>"))
    return elements.withColumn("missing", missing).filter(F.size("missing") > 0)


# -- decisions -------------------------------------------------------------------

# What a decision may settle, by the kind of node.
TERMINAL = {
    "unit": ["keep"], "table": ["keep"], "row": ["keep", "fill"], "cell": ["keep", "fill"], "paragraph": ["keep", "fill"], "run": ["keep", "fill", "delete"],
    "span": ["keep", "fill", "delete"], "field": ["keep", "fill"], "content_control": ["keep", "fill"], "text_box": ["keep"], "image": ["keep"], "footnote": ["keep"],
}
RESULTS, CONFIDENCES = ["keep", "fill", "delete", "split"], ["low", "medium", "high"]


def decision_checks() -> list[Check]:
    """What a decision on a tree node must keep.

    Rows have node, source_kind, child_refs, children_complete, content_complete,
    truncated, and of the decision target_ref, result, confidence,
    inspect_child_refs, child_refs_decided, child_splits, default_child_result,
    fill_source and delete_reason.
    """
    result, kind = F.lower(F.coalesce("result", F.lit(""))), F.coalesce("source_kind", F.lit("source_object"))
    none = F.array().cast("array<string>")
    children, inspected, inline = (F.coalesce(c, none) for c in ("child_refs", "inspect_child_refs", "child_refs_decided"))
    allowed = reduce(lambda rest, k: F.when(kind == k, result.isin(*TERMINAL[k])).otherwise(rest), TERMINAL, result == "keep")
    split, terminal = result == "split", result.isin("keep", "fill", "delete")
    children_whole, content_whole = (F.coalesce(c, F.lit(False)) for c in ("children_complete", "content_complete"))
    whole = content_whole & ~F.coalesce("truncated", F.lit(False)) & ((F.size(children) == 0) | children_whole)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    confidence = F.lower(F.coalesce("confidence", F.lit("low")))
    return [
        Check("target_ref", ~F.col("node").eqNullSafe(F.col("target_ref"))),
        Check("result_unknown", ~result.isin(*RESULTS)),
        Check("confidence_unknown", ~confidence.isin(*CONFIDENCES)),
        Check("inspects_no_child", F.size(F.array_except(inspected, children)) > 0),
        Check("inspects_twice", F.size(inspected) > F.size(F.array_distinct(inspected))),
        Check("decides_no_child", F.size(F.array_except(inline, children)) > 0),
        Check("decides_twice", F.size(inline) > F.size(F.array_distinct(inline))),
        Check("decides_unseen", F.size(F.array_except(inline, inspected)) > 0),
        Check("child_splits", F.coalesce("child_splits", F.lit(0)) > 0),
        Check("leaf_splits", split & (F.size(children) == 0)),
        Check("split_sees_nothing", split & (F.size(inspected) == 0)),
        Check("split_default", split & (F.coalesce("default_child_result", F.lit("keep")) != "keep")),
        Check("split_incomplete", split & ~children_whole),
        Check("not_allowed", ~split & ~allowed),
        Check("terminal_with_children", ~split & (F.size(inline) > 0)),
        Check("terminal_incomplete", terminal & ~whole),
        Check("fill_without_source", (result == "fill") & blank("fill_source")),
        Check("delete_of_container", (result == "delete") & ~kind.isin("run", "span")),
        Check("delete_unsure", (result == "delete") & (confidence != "high")),
        Check("delete_without_reason", (result == "delete") & blank("delete_reason")),
    ]


def settled_decisions(decisions: DataFrame, key) -> DataFrame:
    """``decisions`` with decision_status, result and confidence as they count: one that breaks a rule keeps, for review."""
    bad = findings(decisions, key, decision_checks()).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("check_no", "check"))).alias("_bad"))
    out = decisions.join(bad, key, "left").withColumn("errors", F.coalesce(F.transform("_bad", lambda x: x["check"]), F.array().cast("array<string>")))
    ok = F.size("errors") == 0
    return out.withColumns({
        "decision_status": F.when(ok, "accepted").otherwise("manual_review"), "result": F.when(ok, F.lower("result")).otherwise("keep"),
        "confidence": F.when(ok, F.lower(F.coalesce("confidence", F.lit("low")))).otherwise("low"),
    }).drop("_bad")


# -- judgement -------------------------------------------------------------------


def stage_judgement(stages: DataFrame) -> DataFrame:
    """Stages with the findings that their evidence gives and the verdict over them and their audit.

    Rows have has_standard, quality, has_artifact, bundle, has_ledger and audit
    (a status each, or a boolean).  Without a standard, or without an artifact, no later evidence is looked at.
    """
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    present = F.coalesce(F.col("has_standard"), F.lit(False))
    bound = present & F.coalesce(F.col("has_artifact"), F.lit(False))
    names = [
        F.when(lacks("has_standard"), "standard_missing"), F.when(present & ~F.col("quality").eqNullSafe(F.lit(PASS)), "standard_invalid"), F.when(present & lacks("has_artifact"), "run_bundle_missing"),
        F.when(bound & ~F.col("bundle").eqNullSafe(F.lit(PASS)), "run_bundle_invalid"), F.when(bound & lacks("has_ledger"), "check_ledger_missing"),
    ]
    found = F.array_compact(F.array(*names))
    verdict = F.when(bound & (F.col("audit") == FAIL), FAIL).when(F.size(found) > 0, UNKNOWN).when(F.col("audit").eqNullSafe(F.lit(UNKNOWN)) | F.col("audit").isNull(), UNKNOWN).otherwise(PASS)
    return stages.withColumns({"buckets": found, "verdict": verdict})


def top_causes(causes: DataFrame, by, n: int = 20) -> DataFrame:
    """The first ``n`` causes of each group: failed before unknown before passed, then by stage, type and id."""
    rank = F.when(F.col("status") == FAIL, 0).when(F.col("status") == UNKNOWN, 1).when(F.col("status") == PASS, 2).otherwise(9)
    w = Window.partitionBy(*by).orderBy(rank, "stage", "type", "id")
    return causes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def with_layers(mismatches: DataFrame, causes: DataFrame, owners: DataFrame, fixes: DataFrame) -> DataFrame:
    """Mismatches with their cause (by id), the cause's owner (by category) and its fix (by category and stage); each at most one row, so none is multiplied."""
    out = mismatches.join(causes, "mismatch_id", "left").join(F.broadcast(owners), "category", "left")
    return out.join(F.broadcast(fixes), ["category", "stage"], "left")
