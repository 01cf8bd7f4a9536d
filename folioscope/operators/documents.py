"""Rules of document templates as columns and small plans: policies, roles, pagination, gold ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import contains_any, folded

# Policies of the judging stage and what they become for execution.
EXECUTED = {"fixed": "fixed", "fill": "fill", "generated": "generated", "remove_instruction": "instruction_remove", "template_default": "template_default", "unknown": "fixed"}
# Roles by hint, and by policy where there is no hint.
ROLES_BY_HINT = {"instruction_candidate": "template_instruction", "student_field_candidate": "student_content", "generated_field_candidate": "generated_field", "fixed_text_candidate": "template_fixed", "copy_region_candidate": "template_fixed"}
ROLES_BY_POLICY = {"fill": "student_content", "generated": "generated_field", "fixed": "template_fixed", "instruction_remove": "template_instruction"}
# Values of a page policy.
PAGE_STARTS, PAGE_SCOPES = ("document_start", "new_page"), ("page_range_exclusive",)
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mapped(x, table: dict, default) -> Column:
    names = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(names[_c(x)], default if isinstance(default, Column) else F.lit(default))


def stable_ids(ref) -> Column:
    """Paragraph, table and cell ids that a source reference holds; nulls for those it has not."""
    number = lambda tag: F.regexp_extract(_c(ref), tag + r"\[(\d+)\]", 1).try_cast("int")
    p, t, r, c = number(r"\bp"), number("tbl"), number("tr"), number("tc")
    table = F.format_string("tbl_%04d", t)
    cell = F.format_string("tbl_%04d.r_%03d.c_%03d", t, r, c)
    return F.struct(F.when(p.isNotNull(), F.format_string("p_%04d", p)).alias("paragraph_id"), F.when(t.isNotNull(), table).alias("table_id"), F.when(t.isNotNull() & r.isNotNull() & c.isNotNull(), cell).alias("cell_id"))


def executed_policy(policy) -> Column:
    """The policy as it is carried out; what is not known is kept."""
    return _mapped(policy, EXECUTED, "fixed")


def role_of(hint, policy) -> Column:
    """The role by the hint, else by the policy."""
    return _mapped(hint, ROLES_BY_HINT, _mapped(policy, ROLES_BY_POLICY, "template_fixed"))


def fill_source(policy) -> Column:
    """Where content comes from; null for what is not filled."""
    return F.when(_c(policy) == "fill", "student_content").when(_c(policy) == "generated", "generated_field")


def confidence_of(policy, content, hint, markers, labels) -> Column:
    """high, medium or low: how sure the evidence makes an element's policy."""
    p, text = _c(policy), F.coalesce(_c(content), F.lit(""))
    kept = p.isin("fixed", "template_default")
    return (
        F.when(kept & F.coalesce(_c(hint).isin("student_field_candidate", "generated_field_candidate"), F.lit(False)), "medium")
        .when(p.isin("instruction_remove", "generated"), "high")
        .when(p == "fill", F.when(contains_any(text, markers) & contains_any(text, labels), "high").otherwise("medium"))
        .when(folded(text) == "", "low")
        .otherwise("high")
    )


def confidence_rank(confidence) -> Column:
    """3, 2, 1 for high, medium, low; 0 for anything else."""
    return _mapped(F.lower(_c(confidence)), CONFIDENCE, 0)


def slot_kind(unit, name) -> Column:
    """table, image, heading or body_content by words of unit and name."""
    text = F.concat_ws(" ", _c(unit), F.coalesce(_c(name), F.lit("")))
    low = F.lower(text)
    return F.when(contains_any(text, ["表"]) | low.contains("table"), "table").when(contains_any(text, ["图"]) | low.contains("image") | low.contains("figure"), "image").when(contains_any(text, ["标题", "题名"]) | low.contains("heading"), "heading").otherwise("body_content")


def accepted_kinds(kind) -> Column:
    """Kinds of content that a slot takes."""
    lists = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(_c(kind).isin("table", "image"), F.array(_c(kind))).when(_c(kind) == "heading", lists("heading", "paragraph")).otherwise(lists("heading", "paragraph", "table", "image"))


def page_policy(start, scope, first) -> Column:
    """A valid pair as it is, else the default of the unit's place."""
    ok = F.coalesce(_c(start).isin(*PAGE_STARTS) & _c(scope).isin(*PAGE_SCOPES), F.lit(False))
    default = F.when(_c(first), "document_start").otherwise("new_page")
    return F.struct(F.when(ok, _c(start)).otherwise(default).alias("start"), F.when(ok, _c(scope)).otherwise(PAGE_SCOPES[0]).alias("scope"))


def element_needles(content, name) -> Column:
    """Texts to look for: an element's content, its first 80 characters where it is longer, and its label."""
    text, label = F.trim(F.coalesce(_c(content), F.lit(""))), F.trim(F.regexp_replace(F.coalesce(_c(name), F.lit("")), "(标签|内容|正文|结果|机制)$", ""))
    parts = F.array(text, F.when(F.length(text) > 80, F.substring(text, 1, 80)), F.when(F.length(label) >= 2, label))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != "")))


def in_order_range(order, start, end) -> Column:
    """Inclusive, and open where an end is null."""
    return (_c(start).isNull() | (_c(order) >= _c(start))) & (_c(end).isNull() | (_c(order) <= _c(end)))


def has_layout_evidence(refs) -> Column:
    """Whether any evidence has a page and a render target."""
    return F.coalesce(F.exists(_c(refs), lambda r: r["page_no"].isNotNull() & (r["render_target_id"] != "")), F.lit(False))


def accepted(status, eligible) -> Column:
    """Accepted decisions; not said to be ineligible counts as eligible."""
    return (_c(status) == "accepted") & F.coalesce(_c(eligible), F.lit(True))


def pagination_plan(units: DataFrame, doc="doc_id", place="place") -> DataFrame:
    """What each unit needs to begin on a page of its own: status, and the id of the break that is planned.

    ``units`` holds (doc, place, unit_id, source_ref, start_page, start, scope); one break is
    planned for a reference, by the first unit that needs it.
    """
    by = Window.partitionBy(doc).orderBy(place)
    first = F.row_number().over(by) == 1
    x = units.withColumn("_first", first).withColumn("page_policy", page_policy("start", "scope", F.col("_first")))
    new = F.col("page_policy.start") == "new_page"
    blank = F.coalesce("source_ref", F.lit("")) == ""
    seen = F.coalesce(F.col("start_page") > 1, F.lit(False))
    x = x.withColumn("_wants", new & ~seen & ~blank & ~F.col("_first"))
    again = F.row_number().over(Window.partitionBy(doc, "source_ref", "_wants").orderBy(place)) > 1
    x = x.withColumn("_plans", F.col("_wants") & ~again)
    number = F.sum(F.col("_plans").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("action_id", F.when(F.col("_plans"), F.format_string("a_%03d", number)))
    status = F.when(F.col("_plans"), "action_planned").when(new & seen, "already_satisfied").when(new & blank, "manual_review").otherwise("no_action_required")
    return x.withColumn("status", status).drop("_first", "_wants", "_plans")


def missing_titles(units: DataFrame, doc="doc_id", place="place") -> DataFrame:
    """Contents units whose place is not between their neighbours': a title goes before the next unit that has a place.

    ``units`` holds (doc, place, unit_id, is_contents, title, paragraph); titles over 12 characters are none.
    """
    by = Window.partitionBy(doc).orderBy(place)
    before = F.last("paragraph", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("paragraph", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    x = units.withColumns({"_before": before, "insert_before": after})
    fits = F.coalesce((F.col("_before").isNull() | (F.col("paragraph") > F.col("_before"))) & (F.col("paragraph") < F.col("insert_before")), F.lit(False))
    wanted = F.col("is_contents") & F.col("insert_before").isNotNull() & (F.length("title").between(1, 12)) & ~fits
    return x.filter(wanted).drop("_before")


def span_ledger_faults(items: DataFrame, runs: DataFrame, doc="doc_id") -> DataFrame:
    """Gold of a run must be one item with its exact text, or two spans or more that cover it end to end.

    ``items`` holds (doc, raw_run_id, target_kind, start, end, text), ``runs`` (doc, raw_run_id, run_text); one row for each faulty run.
    """
    w = Window.partitionBy(doc, "raw_run_id").orderBy("start", "end")
    x = items.join(runs, [doc, "raw_run_id"], "full_outer")
    ahead = F.coalesce(F.lag("end").over(w), F.lit(0))
    exact = F.col("text") == F.substring("run_text", F.col("start") + 1, F.col("end") - F.col("start"))
    off = (F.col("target_kind") == "span") & ~F.coalesce((F.col("start") == ahead) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("run_text")) & exact, F.lit(False))
    x = x.withColumn("_off", off)
    n = lambda kind: F.count_if(F.col("target_kind") == kind)
    out = x.groupBy(doc, "raw_run_id").agg(
        n("run").alias("_runs"), n("span").alias("_spans"), F.count("target_kind").alias("_all"), F.max("run_text").alias("_text"),
        F.count_if((F.col("target_kind") == "run") & ~F.col("text").eqNullSafe(F.col("run_text"))).alias("_wrong"), F.count_if("_off").alias("_offs"), F.max("end").alias("_end"),
    )
    fault = (
        F.when(F.col("_all") == 0, "not_covered")
        .when(F.col("_text").isNull(), "unknown_run")
        .when((F.col("_runs") + F.col("_spans") != F.col("_all")) | ((F.col("_runs") > 0) & (F.col("_spans") > 0)), "mixed_shapes")
        .when(F.col("_runs") > 0, F.when((F.col("_runs") > 1) | (F.col("_wrong") > 0), "run_not_exact"))
        .when(F.col("_spans") < 2, "single_span")
        .when(F.col("_offs") > 0, "spans_not_contiguous")
        .when(F.col("_end") != F.length("_text"), "spans_incomplete")
    )
    return out.withColumn("fault", fault).filter("fault IS NOT NULL").select(doc, "raw_run_id", "fault")


def json_object_in(text) -> Column:
    """The first {...} of a text from a model as JSON, null if it is none."""
    return F.to_json(F.try_parse_json(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)))


def table_ranges(facts: DataFrame) -> DataFrame:
    """First and last paragraph, and number of cells, of every table and row of Word facts."""
    cells = facts.filter("kind = 'cell'").select("path", "part", F.col("parent_ref").alias("table_ref"), F.col("attrs")["row"].cast("int").alias("row"), F.col("source_ref").alias("cell_ref"))
    inside = facts.filter("kind = 'cell_paragraph'").select("path", F.col("parent_ref").alias("cell_ref"), "place")
    return cells.join(inside, ["path", "cell_ref"], "left").groupBy("path", "table_ref", "row").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.countDistinct("cell_ref").alias("n_cells"))
