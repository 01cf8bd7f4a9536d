"""Signed baselines: nested dimensions laid flat, what makes a baseline invalid, and comparison of the valid ones.

A baseline is a JSON text.  Its dimensions may hold dimensions to any depth.
Plain documents are walked where they are; of odd ones a frontier is opened
level by level as variants, each with a place key of its ancestors' ordinals,
whose order is that of a walk depth first.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import comparators
from folioscope.sources.shared import written

# The lists of a baseline and of a dimension, what review metadata must hold, and the fields of a tolerance.
TOP, NESTED = ("dimensions", "required_dimensions"), ("dimensions", "children")
METADATA = ("auto_update_allowed", "change_reason", "review_source", "reviewed_by", "source_docx_sha256")
TOLERANCES = ("tolerance", "tolerance_abs", "tolerance_percent")
#: What is told of a dimension, besides its position and depth.
FACTS = ("dimension_id", "comparator_mode", "required", "path", *TOLERANCES, "dimension")
#: Digits of an ordinal.
_WIDTH = 9
#: Levels of brackets in a document that is walked at once, and documents whose dimensions are made into one batch.
_DEEPEST, _DOCUMENTS = 400, 2000


def _at(document: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.try_parse_json(document), f"$.{path}", kind)


def _nothing(value: Column) -> Column:
    """Whether a variant is missing or empty: null, false, 0, an empty text, list or object."""
    return F.coalesce(F.to_json(value).isin("null", "false", "0", '""', "[]", "{}"), F.lit(True))


def _of(node: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def _own(node: Column) -> Column:
    """The list that a dimension has below it: its ``dimensions``, or where those are nothing its ``children``."""
    first, second = (_of(node, name, "array<variant>") for name in NESTED)
    return F.when(F.size(first) > 0, first).when(_nothing(_of(node, NESTED[0])), second)


def _facts(node: Column, wanted) -> list[Column]:
    """The columns of a dimension, a variant."""
    def text(name):
        value = _of(node, name)
        return F.when(~_nothing(value), F.coalesce(_of(node, name, "string"), F.to_json(value)))

    facts = {
        "dimension_id": lambda: F.coalesce(text("dimension_id"), text("id"), F.lit("unknown")), "comparator_mode": lambda: text("comparator_mode"),
        "required": lambda: ~F.coalesce(F.to_json(_of(node, "required")) == "false", F.lit(False)), "path": lambda: text("path"),
        **{t: lambda t=t: _of(node, t, "double") for t in TOLERANCES}, "dimension": lambda: F.to_json(node),
    }
    return [facts[f]().alias(f) for f in wanted]


class _Odd(Exception):
    """A document that is left to the walk by levels."""


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Odd
    return out


def _no_constant(_):
    raise _Odd


def _plain(value) -> bool:
    """Whether a value is nothing, as in :func:`_nothing`; one whose text may be written in several ways is odd."""
    if isinstance(value, float):
        raise _Odd
    return value is None or value is False or value in (0, "", [], {})


def _word(node: dict, name: str) -> str | None:
    value = node.get(name)
    if _plain(value):
        return None
    if not isinstance(value, str):
        raise _Odd
    return value


def _number(node: dict, name: str) -> float | None:
    value = node.get(name)
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not abs(value) < 1 << 53):
        raise _Odd
    return None if value is None else float(value)


#: Facts of a dimension that is plain JSON.
_MADE = {
    "dimension_id": lambda x: _word(x, "dimension_id") or _word(x, "id") or "unknown", "comparator_mode": lambda x: _word(x, "comparator_mode"), "required": lambda x: x.get("required") is not False,
    "path": lambda x: _word(x, "path"), **{t: lambda x, t=t: _number(x, t) for t in TOLERANCES},
}


def _walk(text: str | None, makers: list) -> list[tuple]:
    """(depth, facts) of a document's dimensions, depth first; odd where Spark's own JSON functions might see it otherwise."""
    if not text:
        return []
    if len(text) > 1 << 23 or "\\ud" in text or "\\uD" in text or _nesting(text) > _DEEPEST:
        raise _Odd
    try:
        document = json.loads(text, object_pairs_hook=_object, parse_constant=_no_constant)
    except (ValueError, RecursionError) as error:
        raise _Odd from error
    rows, left = [], []
    for name in reversed(TOP if isinstance(document, dict) else ()):
        left += [(1, x) for x in reversed(document[name])] if isinstance(document.get(name), list) else []
    while left:
        depth, x = left.pop()
        if isinstance(x, dict):
            rows.append((depth, *[make(x) for make in makers]))
            items = x.get(NESTED[0])
            items = x.get(NESTED[1]) if _plain(items) else items
            left += [(depth + 1, y) for y in reversed(items)] if isinstance(items, list) else []
    return rows


def _nesting(text: str) -> int:
    """Levels of brackets, at most."""
    if text.count("[") + text.count("{") <= _DEEPEST:
        return 0
    depth = most = 0
    for c in re.findall(r"[\[\]{}]", text):
        depth += 1 if c in "[{" else -1
        most = max(most, depth)
    return most


def _walks(batches, wanted, fields: list[pa.Field]):
    """Rows (id, no, position, depth, facts, document) of documents (id, no, document); an odd one is one row with its text."""
    makers = [_MADE[f] for f in wanted]
    for batch in (b.slice(i, _DOCUMENTS) for b in batches for i in range(0, b.num_rows, _DOCUMENTS)):
        owner, rows, odd = [], [], []
        for i, text in enumerate(batch.column("document").to_pylist()):
            try:
                found = [(n, *row, None) for n, row in enumerate(_walk(text, makers), 1)]
            except _Odd:
                found = [(None,) * (len(makers) + 2) + (text,)]
            rows += found
            owner += [i] * len(found)
        keys = batch.select(["id", "no"]).take(pa.array(owner, pa.int32()))
        columns = zip(*rows) if rows else [()] * len(fields)
        yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array(c, f.type) for c, f in zip(columns, fields)]], schema=pa.schema([*keys.schema, *fields]))


def _by_levels(documents: DataFrame, wanted) -> DataFrame:
    """(id, position, depth, facts) of documents (id, no, document) of any depth, opened level by level."""
    v = F.col("v")

    def opened(rows, items, prefix):
        some = rows.select("id", "no", "place", F.posexplode(items).alias("n", "item")).filter(F.try_variant_get("item", "$", "map<string,variant>").isNotNull())
        return some.select("id", "no", F.concat(prefix, F.lpad(F.col("n").cast("string"), _WIDTH, "0")).alias("place"), F.to_json("item").alias("node"))

    parsed = lambda df: df.withColumn("v", F.try_parse_json("node"))
    tops = parsed(documents.select("id", "no", F.lit("").alias("place"), F.col("document").alias("node")))
    frontier = written(reduce(DataFrame.unionByName, [opened(tops, _of(v, name, "array<variant>"), F.lit(str(i))) for i, name in enumerate(TOP)]))
    levels = []
    while frontier.count():
        levels.append(frontier)
        frontier = written(opened(parsed(frontier), _own(v), F.col("place")))
    rows = parsed(reduce(DataFrame.unionByName, levels or [frontier])).select("id", "no", "place", *_facts(v, wanted))
    position = F.row_number().over(Window.partitionBy("id", "no").orderBy("place"))
    return rows.select("id", position.alias("position"), F.floor((F.length("place") - 1) / _WIDTH).cast("int").alias("depth"), *wanted)


def flat_dimensions(baselines: DataFrame, key, document: str, facts=FACTS) -> DataFrame:
    """(key, position, depth, facts) of all dimensions, depth first; ``facts`` are some of or all FACTS, and no others are made.

    The list ``dimensions`` goes before ``required_dimensions``; a dimension's
    own are its ``dimensions``, or where that is empty its ``children``.  What
    is not an object, and lists that are none, are passed over; so are texts
    that cannot be parsed.  ``required`` is false only where it says so.  Rows
    that repeat a key are numbered each by itself.

    A document is parsed once and walked by the task that holds it, so its
    dimensions have their order without a sort.  Odd ones (such as with numbers
    for texts, keys that repeat, or a great depth) are opened level by level by
    Spark's JSON functions, and so are all where ``dimension`` is asked for,
    each dimension's own JSON.
    """
    ids = baselines.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).alias("id"), F.monotonically_increasing_id().alias("no"), F.col(document).alias("document"))
    if "dimension" in facts:
        rows = _by_levels(written(ids), facts)
    else:
        kinds = {"required": T.BooleanType(), **dict.fromkeys(TOLERANCES, T.DoubleType())}
        fields = [T.StructField("position", T.IntegerType()), T.StructField("depth", T.IntegerType()), *[T.StructField(f, kinds.get(f, T.StringType())) for f in facts], T.StructField("document", T.StringType())]
        schema, odd, wanted = T.StructType([*ids.schema.fields[:2], *fields]), Observation(), list(facts)
        columns = [pa.field(f.name, {T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}.get(f.dataType, pa.string())) for f in fields]
        walked = written(ids.mapInArrow(lambda batches: _walks(batches, wanted, columns), schema).observe(odd, F.count("document").alias("n")))
        rows = walked.filter("document IS NULL")
        if odd.get["n"]:
            rows = rows.select("id", "position", "depth", *facts).unionByName(_by_levels(walked.filter("document IS NOT NULL").select("id", "no", "document"), facts))
    return rows.select(*[F.col(f"id.k{i}").alias(k) for i, k in enumerate(key)], "position", "depth", *facts)


def baseline_faults(baselines: DataFrame, key, document: str) -> DataFrame:
    """(key, finding, dimension_id, detail) of what makes a baseline invalid; all are UNKNOWN.

    A baseline needs whole review metadata that forbids updates and binds its
    source by a sha256 digest, and dimensions; each required one needs a known
    mode, and a number's a tolerance.
    """
    d = F.col(document)
    meta = _at(d, "review_metadata")
    given = F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    lacks = F.array_compact(F.array(*[F.when(~given | _at(d, f"review_metadata.{m}").isNull(), m) for m in METADATA]))
    forbids = F.coalesce(given & (F.to_json(_at(d, "review_metadata.auto_update_allowed")) == "false"), F.lit(False))
    source = F.when(given, _at(d, "review_metadata.source_docx_sha256", "string"))
    one = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("finding"), F.lit(None).cast("string").alias("dimension_id"), detail.alias("detail")))
    faults = F.array_compact(F.array(
        one(~given, "missing_review_metadata", F.lit("missing")), one(F.size(lacks) > 0, "missing_review_metadata_field", F.array_join(lacks, ", ")),
        one(~forbids, "baseline_auto_update_not_allowed", F.when(given, F.to_json(_at(d, "review_metadata.auto_update_allowed")))), one(~F.coalesce(source.startswith("sha256:"), F.lit(True)), "invalid_source_hash", source),
    ))
    whole = baselines.select(*key, F.explode(faults).alias("x")).select(*key, "x.*")
    flat = flat_dimensions(baselines, key, document)
    none = baselines.select(*key).join(flat.select(*key).distinct(), key, "left_anti").select(*key, F.lit("missing_baseline_dimensions").alias("finding"), F.lit(None).cast("string").alias("dimension_id"), F.lit("none").alias("detail"))
    mode = F.col("comparator_mode")
    no_number = reduce(lambda a, b: a & b, [_at(F.col("dimension"), t).isNull() for t in TOLERANCES])
    finding = F.when(mode.isNull(), "missing_comparator_mode").when(~mode.isin(*comparators.MISMATCH), "unsupported_comparator_mode").when((mode == "numeric_tolerance") & no_number, "missing_numeric_tolerance")
    own = flat.filter("required").select(*key, finding.alias("finding"), "dimension_id", F.coalesce(F.when(finding == "unsupported_comparator_mode", mode), F.lit("missing")).alias("detail")).filter(F.col("finding").isNotNull())
    return whole.unionByName(none).unionByName(own)


def compared_baselines(baselines: DataFrame, key, document: str, actual: str, expected_key: str = "expected") -> DataFrame:
    """(key, position, dimension_id, finding, status) of the dimensions of valid baselines, and the faults of the others.

    An invalid baseline is not compared at all.  ``actual`` is the JSON of what
    was made; a dimension compares what stands at its path on both sides.
    Faults have no position.  Rows without a key are left out.
    """
    known = baselines.dropna(subset=list(key))
    faults = written(baseline_faults(known, key, document))
    sound = known.join(faults.select(*key).distinct(), key, "left_anti")
    there = F.coalesce(F.schema_of_variant(_at(F.col(document), expected_key)).startswith("OBJECT"), F.lit(False))
    lost = sound.filter(~there).select(*key, F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("dimension_id"), F.lit("missing_expected_artifact").alias("finding"), F.lit("UNKNOWN").alias("status"))
    ready = sound.filter(there)
    sides = ready.select(*key, F.to_json(_at(F.col(document), expected_key)).alias("left_side"), F.col(actual).alias("right_side"))
    dims = flat_dimensions(ready, key, document).join(sides, key)

    def side(name):
        found = F.try_variant_get(F.try_parse_json(F.col(name)), F.concat(F.lit("$."), F.col("path")), "variant")
        return F.when(F.is_variant_null(found), "null").otherwise(F.to_json(found))

    made = comparators.compared(dims.withColumns({"expected_value": side("left_side"), "actual_value": side("right_side")}), "expected_value", "actual_value")
    bad = faults.select(*key, F.lit(None).cast("int").alias("position"), "dimension_id", "finding", F.lit("UNKNOWN").alias("status"))
    return made.select(*key, "position", "dimension_id", "finding", "status").unionByName(lost).unionByName(bad)
