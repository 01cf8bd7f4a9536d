"""Audits of what the stages of a run leave behind: traces, sections, bindings, builds, standards and sign-off.

Each audit is a plan that joins the facts a rule set needs onto the rows it
judges, and the rule set (:func:`folioscope.operators.rules.findings` applies
it).  Facts come by one aggregation on the key that the rows already have, so a
rule set costs the shuffles of its facts and no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import contains_any
from folioscope.operators.intervals import overlaps_closed
from folioscope.operators.matching import one_each
from folioscope.operators.rules import Check, findings
from folioscope.operators.status import FAIL, PASS, UNKNOWN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def _n(x) -> Column:
    """Size of an array, 0 for null."""
    return F.when(_c(x).isNull(), 0).otherwise(F.size(_c(x)))


def counted(df: DataFrame, by, key, name: str = "n_same") -> DataFrame:
    """Rows with how often their key stands in their group; a null or empty key counts as 1, as it names nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, key))
    return df.withColumn(name, F.when(_text(F.col(key).cast("string")) == "", 1).otherwise(n))


# -- traces of facts -------------------------------------------------------------

# Names of fields that judge, which facts must not have.
JUDGING_PREFIXES, JUDGING_NAMES = ["is_", "looks_like_", "likely_"], ["large_font", "short_text", "policy", "confidence", "unit_id", "structural_signals"]
# What every run must say of itself.
RUN_FIELDS = ["raw_run_id", "logical_run_id", "merged_from", "kind", "effective_style", "style_provenance"]


def judging_fields(names) -> Column:
    """Those of an array of field names that judge rather than state, in order of name."""
    own = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in JUDGING_PREFIXES]) | x.isin(*JUDGING_NAMES)
    return F.array_sort(F.array_distinct(F.filter(_c(names), own)))


def trace_checks() -> list[Check]:
    """Facts of a document's body lead back to where they were read, and judge nothing.

    Rows have n_same (:func:`counted`), kind, visible (null: yes), text, paragraph_id, raw_run_ids, cell_refs,
    part_refs and field_names (arrays), and source_text, the text at the place that they name (null: no such place).
    """
    shown = F.coalesce(F.col("visible"), F.lit(True)) & (F.trim(_text("text")) != "")
    runs, kind, paragraph = _n("raw_run_ids"), _text("kind"), _text("paragraph_id")
    first_of = F.element_at(F.split(F.get("raw_run_ids", F.lit(0)), r"\."), 1)
    return [
        Check("id_duplicate", F.col("n_same") > 1),
        Check("paragraph_trace_mismatch", (kind == "paragraph") & (paragraph != "") & (runs > 0) & (first_of != paragraph), UNKNOWN),
        Check("paragraph_trace_missing", shown & (kind == "paragraph") & (runs == 0), UNKNOWN),
        Check("cell_trace_missing", shown & (kind == "table_cell") & (runs + _n("cell_refs") == 0), UNKNOWN),
        Check("part_trace_missing", shown & kind.isin("header", "footer") & (runs + _n("part_refs") == 0), UNKNOWN),
        Check("judging_field", _n(judging_fields("field_names")) > 0),
        Check("source_text_mismatch", F.col("source_text").isNotNull() & (F.trim(_text("text")) != "") & (F.col("source_text") != F.trim(_text("text"))), UNKNOWN),
    ]


def missing_fields(fields=RUN_FIELDS) -> Column:
    """Those of the fields that are null, empty or an empty list, in their order."""
    lacks = lambda f: F.when(_text(F.col(f).cast("string")).isin("", "[]"), F.lit(f))
    return F.array_compact(F.array(*map(lacks, fields)))


# -- sections --------------------------------------------------------------------


def section_facts(profiles: DataFrame, parts: DataFrame, by, profile="section_profile_id", refs="part_refs", part="part_name") -> DataFrame:
    """Section profiles with how often their id stands and how many of their references (array ``refs``) name no part of the document."""
    keyed = counted(profiles, by, profile)
    known = parts.select(*by, F.col(part).alias("_part")).distinct()
    named = profiles.select(*by, F.col(profile).alias("_profile"), F.explode(refs).alias("_part")).filter(_text("_part") != "")
    lost = named.join(known, [*by, "_part"], "left_anti").groupBy(*[F.col(b).alias(f"_{b}") for b in by], "_profile").agg(F.count(F.lit(1)).alias("n_lost_parts"))
    on = reduce(lambda a, b: a & b, [*[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.col(profile).eqNullSafe(F.col("_profile"))])
    return keyed.join(lost, on, "left").select(*keyed.columns, F.coalesce("n_lost_parts", F.lit(0)).alias("n_lost_parts"))


def section_checks(profile="section_profile_id") -> list[Check]:
    """Sections have a boundary and a source, say how they number their pages, and point to parts that exist.

    Rows have n_same and n_lost_parts (:func:`section_facts`), boundary (a status, null: none), source_ref,
    numbering (the display's status), n_page_fields and n_checked (how many scopes were searched for a page field).
    """
    shown, some = _text("numbering"), lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return [
        Check("section_id_duplicate", F.col("n_same") > 1),
        Check("boundary_missing", _text("boundary") == "", UNKNOWN),
        Check("boundary_unknown", F.col("boundary") == UNKNOWN, UNKNOWN),
        Check("source_ref_missing", (_text(profile) != "section_unknown") & (_text("source_ref") == ""), UNKNOWN),
        Check("numbering_status_missing", shown == "", UNKNOWN),
        Check("numbering_without_field", (shown == "detected") & ~some("n_page_fields")),
        Check("no_field_unsearched", (shown == "no_page_field") & ~some("n_checked"), UNKNOWN),
        Check("part_missing", F.col("n_lost_parts") > 0, UNKNOWN),
    ]


# -- units and their sections ------------------------------------------------------


def binding_findings(units: DataFrame, refs: DataFrame, profiles: DataFrame, by, unit="unit_id", profile="section_profile_id") -> DataFrame:
    """(by, unit, check, status): faults of units and of the section profiles that they are bound to.

    ``units`` has start, end (null: nowhere) and policy_errors; ``refs`` has unit,
    profile, start and end of their common range.  Units called `other` may repeat, but then want review.
    """
    rows = counted(units, by, unit)
    n_refs = refs.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("_n_refs"))
    other = F.col(unit) == "other"
    of_units = findings(
        rows.join(n_refs, [*by, unit], "left"), [*by, unit],
        [
            Check("unit_id_duplicate", (F.col("n_same") > 1) & ~other),
            Check("other_unit_duplicate", (F.col("n_same") > 1) & other, UNKNOWN),
            Check("page_policy_invalid", F.col("policy_errors") > 0),
            Check("section_refs_missing", F.col("_n_refs").isNull(), UNKNOWN),
        ],
    )
    known = profiles.select(*by, profile).distinct().withColumn("_known", F.lit(True))
    # one range a unit: of units that share an id the one that begins first
    ranges = one_each(units.filter(F.col("start").isNotNull()).select(*by, unit, F.col("start").alias("_start"), F.col("end").alias("_end")), [*by, unit], ["_start"], last=False)
    meets = F.coalesce(overlaps_closed("_start", "_end", "start", "end"), F.lit(False))
    bound = refs.join(known, [*by, profile], "left").join(ranges, [*by, unit], "left")
    of_refs = findings(
        bound, [*by, unit],
        [
            Check("section_ref_unknown", F.col("_known").isNull()),
            Check("section_range_mismatch", F.col("_known") & F.col("_start").isNotNull() & ~meets),
        ],
    )
    return of_units.unionByName(of_refs).drop("check_no")


# -- builds ------------------------------------------------------------------------

# States of a page policy that need nothing more.
FINAL_STATES = ["executed", "no_action_required", "already_satisfied"]
# Which count of a finished document shows an action.
EFFECTS = {"insert_page_break_before_unit": "page_breaks", "insert_section_break_before_unit": "section_breaks", "set_keep_together_unit": "kept"}


def policy_result_facts(units: DataFrame, results: DataFrame, executed: DataFrame, by, order, unit="unit_id", action="action_id") -> DataFrame:
    """Units with the last result reported of their page policy, and how many of the actions that it names were executed.

    ``results`` has unit, status, action_ids (array) and the columns of ``order``; ``executed`` has action ids.
    """
    last = one_each(results, [*by, unit], order).select(*by, unit, F.col("status").alias("result"), "action_ids")
    done = executed.select(*by, F.col(action).alias("_action")).distinct()
    named = last.select(*by, unit, F.explode(F.filter("action_ids", lambda x: _text(x) != "")).alias("_action"))
    tally = named.join(done.withColumn("_done", F.lit(True)), [*by, "_action"], "left").groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n_named"), F.count("_done").alias("n_executed"))
    out = units.join(last.drop("action_ids").withColumn("reported", F.lit(True)), [*by, unit], "left").join(tally, [*by, unit], "left")
    return out.withColumn("reported", F.coalesce("reported", F.lit(False))).fillna(0, ["n_named", "n_executed"])


def policy_result_checks() -> list[Check]:
    """Every page policy has a result in a final state, and what was executed names executed actions.

    Rows are of :func:`policy_result_facts`; ``open_policy`` says that the policy itself is unknown, which makes a review no failure.
    """
    result, open_ = _text("result"), F.coalesce(F.col("open_policy"), F.lit(False))
    review = F.col("reported") & (result == "manual_review")
    return [
        Check("result_missing", ~F.col("reported")),
        Check("needs_review", review & ~open_),
        Check("needs_review", review & open_, UNKNOWN),
        Check("result_not_final", F.col("reported") & ~result.isin(*FINAL_STATES, "manual_review"), UNKNOWN),
        Check("evidence_missing", (result == "executed") & ((F.col("n_named") == 0) | (F.col("n_executed") < F.col("n_named")))),
    ]


def effect_gaps(actions: DataFrame, observed: DataFrame, by, kind="action_type") -> DataFrame:
    """(by, action_type, expected, observed): kinds of action of which fewer effects are seen than were carried out.

    ``observed`` has a row for each document that could be read again, with the counts of ``EFFECTS``; one that
    could not has the gap `all`.
    """
    done = actions.filter(F.col(kind).isin(*EFFECTS)).groupBy(*by, kind).agg(F.count(F.lit(1)).alias("expected"))
    seen = observed.select(*by, F.lit(True).alias("_read"), F.create_map(*[x for k, c in EFFECTS.items() for x in (F.lit(k), _c(c).cast("long"))]).alias("_seen"))
    rows = done.join(seen, by, "left").withColumn("observed", F.coalesce(F.col("_seen")[F.col(kind)], F.lit(0)))
    read = rows.filter("_read AND observed < expected").select(*by, F.col(kind).alias("action_type"), "expected", "observed")
    unread = rows.filter("_read IS NULL").groupBy(*by).agg(F.lit("all").alias("action_type"), F.sum("expected").alias("expected"), F.lit(0).cast("long").alias("observed"))
    return read.unionByName(unread)


# -- standards ---------------------------------------------------------------------


def standard_checks() -> list[Check]:
    """A stage's standard is registered in its folder, names its stage and artifact, and says what it expects of which source.

    Rows have registered_path, has_standard, stage_id, due_stage_id, artifact, due_artifact,
    verifier_state, has_gate, has_expected, source_hash and due_source_hash (null: none is bound).
    """
    path, there, due = _text("registered_path"), F.coalesce(F.col("has_standard"), F.lit(False)), _text("due_source_hash")
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    differs = lambda a, b: there & ~F.col(a).eqNullSafe(F.col(b))
    return [
        Check("not_registered", path == "", UNKNOWN),
        Check("registered_elsewhere", (path != "") & ~path.startswith("template_generation/"), UNKNOWN),
        Check("standard_missing", ~there, UNKNOWN),
        Check("stage_id_mismatch", differs("stage_id", "due_stage_id"), UNKNOWN),
        Check("artifact_mismatch", differs("artifact", "due_artifact"), UNKNOWN),
        Check("verifier_state_missing", there & (_text("verifier_state") == ""), UNKNOWN),
        Check("gate_missing", there & lacks("has_gate"), UNKNOWN),
        Check("expected_missing", there & lacks("has_expected"), UNKNOWN),
        Check("source_hash_mismatch", there & (due != "") & (_text("source_hash") != "") & (F.col("source_hash") != due), UNKNOWN),
        Check("source_hash_missing", there & (due != "") & (_text("source_hash") == ""), UNKNOWN),
    ]


def order_conflicts(orders: DataFrame, by, stage="stage", place="place", unit="unit_id") -> DataFrame:
    """(by, stage, reference, n_places): stages whose list of units is not that of the group's first stage, and in how many places.

    ``orders`` has a row for each unit in a stage's list, with its place.  Lists are
    compared place by place, in a join, so a list of any length is no single row.
    """
    named = orders.select(*by, F.col(stage).alias("_stage"), F.col(place).alias("_place"), F.col(unit).alias("_unit"))
    first = named.groupBy(*by).agg(F.min("_stage").alias("reference"))
    known = named.join(first, by)
    base = known.filter("_stage = reference").select(*by, "_place", F.col("_unit").alias("_base"), F.lit(True).alias("_is"))
    stages = known.select(*by, "_stage", "reference").distinct().filter("_stage <> reference")
    # what the reference has, and what each stage has, at every place of either
    want = stages.join(base, by).select(*by, "_stage", "reference", "_place", F.col("_base").alias("_want"), F.lit(None).cast("string").alias("_got"), F.lit(1).alias("_w"), F.lit(0).alias("_g"))
    got = known.filter("_stage <> reference").select(*by, "_stage", "reference", "_place", F.lit(None).cast("string").alias("_want"), F.col("_unit").alias("_got"), F.lit(0).alias("_w"), F.lit(1).alias("_g"))
    both = want.unionByName(got).groupBy(*by, "_stage", "reference", "_place").agg(F.max("_want").alias("_want"), F.max("_got").alias("_got"), F.sum("_w").alias("_w"), F.sum("_g").alias("_g"))
    wrong = (F.col("_w") != F.col("_g")) | ~F.col("_want").eqNullSafe(F.col("_got"))
    return both.groupBy(*by, F.col("_stage").alias(stage), "reference").agg(F.count_if(wrong).alias("n_places")).filter("n_places > 0")


# -- sign-off ----------------------------------------------------------------------


def signoff_blockers(reports: DataFrame, stages: DataFrame, by, stage="stage") -> DataFrame:
    """(by, blocker): what keeps a report from being signed off, each once.

    ``reports`` has acceptance, quality, bundle (statuses) and n_failed_diffs; ``stages`` has verifier_state and gate_enabled.
    """
    said = lambda name, c: F.when(~F.col(c).eqNullSafe(F.lit(PASS)), F.concat(F.lit(name + "="), F.coalesce(c, F.lit(UNKNOWN))))
    of_report = F.array(
        said("standard_acceptance_status", "acceptance"), said("standard_quality", "quality"), said("run_bundle", "bundle"),
        F.when(F.col("n_failed_diffs") > 0, F.lit("stage_standard_diffs contain FAIL")),
    )
    of_stage = F.array(
        F.when(_text("verifier_state") != "configured", F.concat(F.col(stage), F.lit(".verifier_state="), _text("verifier_state"))),
        F.when(~F.coalesce(F.col("gate_enabled"), F.lit(False)), F.concat(F.col(stage), F.lit(".gate_enabled=false"))),
    )
    named = lambda df, x: df.select(*by, F.explode(F.array_compact(x)).alias("blocker"))
    return named(reports, of_report).unionByName(named(stages, of_stage)).distinct()


# States of a rendering that show that none was made.
NOT_RENDERED = ["", "not_available", "projection_fallback"]


def route_checks() -> list[Check]:
    """The input contract is there, rests on a real rendering, binds its objects, and its bundles are valid; without it nothing else is asked.

    Rows have available, render_status, n_unbound and n_invalid_stages.
    """
    there = F.coalesce(F.col("available"), F.lit(False))
    return [
        Check("not_available", ~there),
        Check("render_not_real", there & _text("render_status").isin(*NOT_RENDERED)),
        Check("objects_unbound", there & (F.col("n_unbound") > 0)),
        Check("bundle_invalid", there & (F.col("n_invalid_stages") > 0)),
    ]


# Notes on format in brackets, placeholders, and policies of what is an instruction.
NOTE_WORDS = "号|宋体|黑体|楷体|仿宋|华文|Times|Arial|加粗|居中|空[一二三四五六七八九十0-9]*行|小四|小三|三号|四号|一号|二号|行距|磅"
FORMAT_NOTE = f"[（(][^（）()]{{0,80}}(?:{NOTE_WORDS})[^（）()]{{0,80}}[）)]"
PLACEHOLDER = r"(?:□+|×{2,}|20×+|…{2,}|\.{6,}|_{4,})"
INSTRUCTION_POLICIES = ["instruction_remove", "remove_instruction"]


def residues(texts: DataFrame, by, text, policy=None) -> DataFrame:
    """(by, notes, placeholders, status): how many texts still hold a note on format or a placeholder; any of them fails.

    Texts whose policy takes them out are not asked.
    """
    left = F.lit(True) if policy is None else ~_text(policy).isin(*INSTRUCTION_POLICIES)
    has = lambda p: F.count_if(left & F.regexp_like(_text(text), F.lit(p)))
    out = texts.groupBy(*by).agg(has(FORMAT_NOTE).alias("notes"), has(PLACEHOLDER).alias("placeholders"))
    return out.withColumn("status", F.when(F.col("notes") + F.col("placeholders") > 0, FAIL).otherwise(PASS))


# -- reports of a run ----------------------------------------------------------------


def first_blockers(cards: DataFrame, by, order, n: int = 10, status="status", reason="reason") -> DataFrame:
    """The first ``n`` cards of each group that did not pass, with their reason or a default one: a report of so many."""
    w = Window.partitionBy(*by).orderBy(order)
    said = F.coalesce(F.nullif(reason, F.lit("")), F.lit("stage quality check is not PASS"))
    return cards.filter(~F.col(status).eqNullSafe(F.lit(PASS))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn(reason, said)


def call_summary(calls: DataFrame, by) -> DataFrame:
    """Requests by group: how many there were, were answered from a cache, were left out, failed, and how many calls were made.

    ``calls`` has from_cache, skipped, error and fallback_from.
    """
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    out = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), yes("from_cache").alias("cache_hits"), yes("skipped").alias("skipped"), F.count_if(_text("error") != "").alias("failures"),
        (F.count_if(_text("fallback_from") != "") > 0).alias("fallback_used"),
    )
    return out.withColumn("api_calls", F.col("requests") - F.col("cache_hits") - F.col("skipped"))


def histogram(df: DataFrame, by, value) -> DataFrame:
    """How often each value stands, by group: pages, styles."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def mean_of_known(value) -> Column:
    """Aggregate: the mean of the numbers that are there, to four places; null where there are none."""
    return F.round(F.avg(_c(value)), 4)


# -- requirements that texts state -----------------------------------------------------

# Words by which a text asks for numbered captions, in the order in which they count.
CAPTIONS = [("公式", ["生成公式编号", "公式编号", "公式序号"]), ("表", ["生成表编号", "表号", "表名", "表题"]), ("图", ["生成图编号", "图号", "图名", "图题"])]
GENERATED_CAPTIONS, FIELD_WORDS = ["生成图编号", "生成表编号", "生成公式编号"], ["域代码", "更新域", "Word 字段", "字段"]
CONTENTS_WORDS, UNIT_CONTENTS = ["自动目录字段", "目录生成机制"], ["Word 自动目录", "Word 目录字段", "Word 图目录", "Word 表目录"]
RESULT_WORDS, EQUIVALENTS, STRICT_FIELDS = ["生成结果", "结果条目", "Word 更新域后生成"], ["等价", "可使用", "可用"], ["域代码", "更新域", "Word 字段", "SEQ"]
PAGE_WORD = r"\b(NUM)?PAGES?\b"
# Words by which a text asks for Word's own numbering, and words that mean another.
OTHER_NUMBERING = ["脚注", "图编号", "表编号", "公式编号", "图号", "表号", "题注", "域代码", "目录条目", "点引导线"]
WORD_NUMBERING = ["Word 列表编号", "由 Word 列表编号生成", "模板编号规则生成", "编号由模板生成", "章号由模板生成", "Word 自动编号", "自动编号"]


def caption_label(x) -> Column:
    """Which caption a text speaks of: a formula's, a table's or a figure's; null: none."""
    return reduce(lambda rest, c: F.when(contains_any(x, c[1]), c[0]).otherwise(rest), reversed(CAPTIONS), F.lit(None).cast("string"))


def _page_field(x) -> Column:
    return contains_any(x, ["页码字段"]) | F.regexp_like(F.upper(_c(x)), F.lit(PAGE_WORD))


def element_field(x) -> Column:
    """The field that an element's text asks for: SEQ, TOC or PAGE; null: none."""
    t, big = _text(x), F.upper(_text(x))
    seq = caption_label(t).isNotNull() & ~t.contains("目录") & (big.contains("SEQ") | contains_any(t, FIELD_WORDS) | contains_any(t, GENERATED_CAPTIONS))
    toc = (big.contains("TOC") & contains_any(t, ["字段", "目录生成机制", "自动目录"])) | contains_any(t, CONTENTS_WORDS)
    return F.when(seq, "SEQ").when(toc, "TOC").when(_page_field(t), "PAGE")


def unit_field(x) -> Column:
    """The field that a unit's text asks for where none of its elements does: TOC or PAGE; null: none."""
    t = _text(x)
    toc = (F.upper(t).contains("TOC") & contains_any(t, ["字段", "自动目录"])) | contains_any(t, UNIT_CONTENTS)
    return F.when(toc, "TOC").when(_page_field(t), "PAGE")


def equivalent_allowed(kind, x) -> Column:
    """Whether a text lets another form stand for the field."""
    t = _text(x)
    loose = (_c(kind) == "SEQ") & ~contains_any(t, STRICT_FIELDS) & t.contains("生成") & t.contains("编号")
    return contains_any(t, EQUIVALENTS) | F.coalesce(loose, F.lit(False))


def field_requirements(elements: DataFrame, units: DataFrame, by, unit="unit_id", element="element_id", text="text", policy="policy") -> DataFrame:
    """(by, unit, affected, kind, label, equivalent): fields that texts ask for; a unit's own text counts only where no element of it asks.

    An element asks for contents or page numbers only if it is generated, and is not itself the result.
    """
    kind = element_field(text)
    asks = kind.isNotNull() & ((kind == "SEQ") | ((_text(policy) == "generated") & ~contains_any(text, RESULT_WORDS)))
    put = lambda df, k, affected: df.select(*by, unit, affected.alias("affected"), k.alias("kind"), caption_label(text).alias("label"), equivalent_allowed(k, text).alias("equivalent"))
    own = put(elements.filter(asks), kind, F.concat_ws(".", unit, element, F.lit("field")))
    rest = units.filter(unit_field(text).isNotNull()).join(own.select(*by, unit).distinct(), [*by, unit], "left_anti")
    return own.unionByName(put(rest, unit_field(text), F.concat_ws(".", unit, F.lit("field"))))


def asks_for_numbering(x) -> Column:
    """Whether a text asks for Word's own numbering."""
    t = _text(x)
    return t.contains("编号") & ~contains_any(t, OTHER_NUMBERING) & (contains_any(t, WORD_NUMBERING) | (t.contains("编号生成") & (t.contains("标题") | t.contains("章"))))


def numbering_formats(x) -> Column:
    """The number formats that a text states as `格式=...`, each once and in order; a half-width blank after them belongs to them."""
    stated = F.regexp_extract_all(_text(x), F.lit("格式[=＝]\\s*([^；。\\n]+)"), F.lit(1))

    def bare(v):
        v = F.replace(F.trim(v), F.lit("％"), F.lit("%"))
        cut = F.concat(F.trim(F.substring_index(v, "+", 1)), F.when(v.contains("半角空格"), " ").otherwise(""))
        return F.when(v.contains("+"), cut).otherwise(v)

    return F.array_distinct(F.filter(F.transform(stated, bare), lambda v: v != ""))


# -- findings and decisions ------------------------------------------------------------


def affected_id(path) -> Column:
    """The dotted id that a check's path (an array of texts) is about; null where it is about nothing in particular."""
    p, n = _c(path), F.size(_c(path))
    at = lambda i: F.get(p, F.lit(i))
    in_unit, dotted = (at(0) == "units") & (n >= 3), lambda *x: F.concat_ws(".", *x)
    return (
        F.when(at(0) == "unmodeled_objects", at(1))
        .when(at(0) == "global", F.element_at(p, -1))
        .when(in_unit & (at(2) == "presence"), at(1))
        .when(in_unit & (n >= 5) & (at(2) == "elements") & (at(4) == "presence"), dotted(at(1), at(3)))
        .when(in_unit & (n >= 5) & (at(2) == "elements"), dotted(at(1), at(3), at(4)))
        .when(in_unit & (n >= 5) & (at(2) == "dimensions"), dotted(at(1), at(3), at(4)))
    )


def as_findings(checks: DataFrame, by, order, status="status", path="path") -> DataFrame:
    """Checks that did not pass as findings, numbered by group in order, with what they are about."""
    w = Window.partitionBy(*by).orderBy(order)
    return checks.filter(F.col(status) != PASS).withColumn("finding_no", F.row_number().over(w)).withColumn("affected", affected_id(path))


# Decisions by the policy of an element and by the type of a span.
ELEMENT_DECISIONS = {"instruction_remove": "remove_instruction_text", "remove_instruction": "remove_instruction_text", "fill": "create_fillable_slot", "generated": "create_generated_field_placeholder"}
SPAN_DECISIONS = {"sample_value": "replace_span_with_slot", "layout_spacer": "remove_instruction_text", "inline_instruction": "remove_instruction_text"}
SLOT_POLICIES = ["fill", "generated", "template_default_optional"]


def _case(x, table: dict) -> Column:
    return reduce(lambda rest, k: F.when(_c(x) == k, table[k]).otherwise(rest), table, F.lit(None).cast("string"))


def decisions(elements: DataFrame, spans: DataFrame, by, element="element_id", span="span_id") -> DataFrame:
    """(by, element, span, decision): what is to be done with spans and elements; a fixed element without a source is inserted if ``synthesized`` says so.

    ``elements`` has policy, source_ref and synthesized; ``spans`` has span_type.
    """
    inserted = (F.col("policy") == "fixed") & (_text("source_ref") == "") & F.coalesce("synthesized", F.lit(False))
    of_element = F.coalesce(_case("policy", ELEMENT_DECISIONS), F.when(inserted, "insert_fixed_text"))
    own = elements.select(*by, element, F.lit(None).cast("string").alias(span), of_element.alias("decision"))
    parts = spans.select(*by, element, F.col(span).cast("string").alias(span), _case("span_type", SPAN_DECISIONS).alias("decision"))
    return own.unionByName(parts).filter(F.col("decision").isNotNull())


def slots(elements: DataFrame, known: DataFrame, by, unit="unit_id", element="element_id", policy="policy") -> DataFrame:
    """New slots of units: one for each element to fill or generate whose id is not among the ``known`` slots (by, slot_id)."""
    put = elements.filter(F.col(policy).isin(*SLOT_POLICIES)).withColumn("slot_id", F.concat_ws(".", unit, element))
    new = put.join(known.select(*by, "slot_id"), [*by, "slot_id"], "left_anti")
    return new.dropDuplicates([*by, "slot_id"]).withColumn("writable", F.col(policy) != "generated")


def stamped(paragraphs: DataFrame, instructions: DataFrame, by, index, order) -> DataFrame:
    """Paragraphs with the policy, disposition and reason of the last instruction at their index, in the order of the columns ``order``."""
    last = one_each(instructions, [*by, index], order).select(*by, index, "policy", "disposition", "reason")
    return paragraphs.join(last, [*by, index], "left")
