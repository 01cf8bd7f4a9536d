"""Documents put together from tables: elements into units, units and what is bound to them into documents.

Children of several kinds are put under their parents by one tagged union: all
rows of a key meet in one partition and one sort, the parent first, then each
kind in its own order.  They are cut into nested rows as Arrow arrays while they
stream by, one key's rows at a time, so neither a shuffle nor a list a kind is
needed, and of a partition no more is held than one key and a batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import documents, intervals

# Names of a unit of contents, and words of an element that tell its field.
CONTENTS_UNITS = ("目录", "tableofcontents")
FIELD_WORDS = (("SEQ", ("seq", "编号")), ("PAGE", ("页码", "page")), ("TOC", ("目录", "toc")))


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Which rows begin a key."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_valid(a), pc.is_valid(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def _cut(table: pa.Table, keys: list[str], kinds: int) -> pa.Table:
    """Nested rows of whole keys: the parent's columns, and an array of each kind's payload.

    A key's children go to its first parent; children without one go nowhere.
    """
    tags, new = table["tag"].to_numpy(), _starts(table, keys)
    group = np.cumsum(new) - 1
    parents = np.flatnonzero(tags == 0)
    first = np.full(int(group[-1]) + 1 if len(group) else 0, -1)
    first[group[parents][::-1]] = np.arange(len(parents))[::-1]
    columns = {"parent": table["p0"].take(pa.array(parents)).combine_chunks()}
    for kind in range(1, kinds + 1):
        rows = np.flatnonzero(tags == kind)
        owner = first[group[rows]]
        rows, owner = rows[owner >= 0], owner[owner >= 0]
        offsets = np.searchsorted(owner, np.arange(len(parents) + 1)).astype(np.int32)
        columns[f"c{kind}"] = pa.ListArray.from_arrays(pa.array(offsets), table[f"p{kind}"].take(pa.array(rows)).combine_chunks())
    return pa.table(columns)


def _gathered(table: pa.Table, keys: list[str], name: str) -> pa.Table:
    """One row for each of whole keys: the key, and an array of its rows' payload."""
    starts = np.flatnonzero(_starts(table, keys))
    columns = {k: table[k].take(pa.array(starts)).combine_chunks() for k in keys}
    columns[name] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(table)).astype(np.int32)), table["row"].take(pa.array(np.arange(len(table)))).combine_chunks())
    return pa.table(columns)


def _nested(batches, keys: list[str], cut):
    """``cut`` of the rows of whole keys, some keys at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        new = _starts(pa.Table.from_batches([*last, batch]), keys)[len(last) :]
        if not last:
            new[0] = False  # goes on with nothing
        cuts = np.flatnonzero(new)
        if len(cuts):
            whole = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            yield from cut(whole.combine_chunks(), keys).to_batches()
            held, batch = [], batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks(), keys).to_batches()


def nest(parents: DataFrame, children: dict[str, tuple], key: list[str], unseen=(), spread: list[str] | None = None) -> DataFrame:
    """``parents`` with an array column of structs for each kind of child, in its order.

    ``children`` gives by name a frame with the columns of ``key`` and those
    that order it; the structs have all of its columns but the key and those in
    ``unseen``, ties stand in any order, nulls first.  A third item may be a
    function of such a frame that makes the structs' columns out of the
    frame's, row by row: it is called for the rows where they have met, so that
    what it adds is not moved.  Parents without children get empty arrays.  Children
    without a parent are left out; of parents that repeat a key one gets the
    children.  Null keys are keys like others.  Rows meet by ``spread``, some of
    the key, or else by all of it; see :func:`gathered`.
    """
    keys = [f"k{i}" for i in range(len(key))]
    makers = {j: rest[0] for j, (_, _, *rest) in enumerate(children.values(), 1) if rest}
    frames = [parents, *[df for df, *_ in children.values()]]
    payload = [F.struct(*[F.col(c) for c in parents.columns]), *[F.struct(*[F.col(c) for c in df.columns if c not in key and c not in unseen]) for df in frames[1:]]]
    orders = [[], *[list(o) for _, o, *_ in children.values()]]
    kinds = [df.select(p.alias("x")).schema["x"].dataType for df, p in zip(frames, payload)]
    sorts = [df.select(F.struct(*o).alias("x")).schema["x"].dataType if o else None for df, o in zip(frames, orders)]
    rows = []
    for i, (df, own, order) in enumerate(zip(frames, payload, orders)):
        cells = [(own if i == j else F.lit(None).cast(kind)).alias(f"p{j}") for j, kind in enumerate(kinds)]
        ranks = [(F.struct(*order) if i == j and order else F.lit(None).cast(sort)).alias(f"o{j}") for j, sort in enumerate(sorts) if sort is not None]
        rows.append(df.select(*[F.col(k).alias(n) for k, n in zip(key, keys)], F.lit(i).alias("tag"), *ranks, *cells))
    union = reduce(DataFrame.unionByName, rows)
    ranks = [c for c in union.columns if c.startswith("o")]
    meet = [n for k, n in zip(key, keys) if spread is None or k in spread]
    ordered = union.repartition(*meet).sortWithinPartitions(*keys, "tag", *ranks).select(*keys, "tag", *[f"p{j}" for j in range(len(kinds))])
    for j, make in makers.items():
        flat = make(ordered.select(F.struct("*").alias("_moved"), *[F.col(n).alias(k) for k, n in zip(key, keys)], *[F.col(f"p{j}")[f].alias(f) for f in kinds[j].names]))
        own = F.struct(*[F.col(c) for c in flat.columns if c not in key and c not in unseen and c != "_moved"])
        kinds[j] = flat.select(own.alias("x")).schema["x"].dataType
        ordered = flat.select(*[(F.when(F.col("_moved.tag") == j, own) if c == f"p{j}" else F.col("_moved")[c]).alias(c) for c in ordered.columns])
    schema = T.StructType([T.StructField("parent", kinds[0]), *[T.StructField(f"c{j}", T.ArrayType(kind)) for j, kind in enumerate(kinds) if j]])
    n_kinds = len(kinds) - 1
    made = ordered.mapInArrow(lambda batches: _nested(batches, keys, lambda table, own: _cut(table, own, n_kinds)), schema)
    return made.select(*[F.col("parent")[c].alias(c) for c in parents.columns], *[F.col(f"c{j}").alias(name) for j, name in enumerate(children, 1)])


def gathered(nested: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """(by, name): the other columns of each key's rows as an array of structs, in order.

    ``nested`` is what :func:`nest` gave with ``by`` for its ``spread``, so the
    rows of a key lie in one partition, and are not moved again.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = nested.sortWithinPartitions(*by, *order).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.struct(*[c for c in nested.columns if c not in by]).alias("row"))
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("c", T.ArrayType(rows.schema["row"].dataType))])
    made = rows.mapInArrow(lambda batches: _nested(batches, keys, lambda table, own: _gathered(table, own, "c")), schema)
    return made.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("c").alias(name))


def field_type(text, unit_name=None) -> Column:
    """The field that a generated element asks for by its words, in their order, or by its unit's name; else FIELD_PLACEHOLDER."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    rules = [(kind, reduce(lambda a, b: a | b, [low.contains(w) for w in words])) for kind, words in FIELD_WORDS]
    if unit_name is not None:
        bare = F.regexp_replace(F.lower(F.coalesce(F.col(unit_name) if isinstance(unit_name, str) else unit_name, F.lit(""))), r"\s+", "")
        rules = [(kind, rule | bare.isin(*CONTENTS_UNITS) if kind == "TOC" else rule) for kind, rule in rules]
    return reduce(lambda out, rule: F.when(rule[1], rule[0]).otherwise(out), reversed(rules), F.lit("FIELD_PLACEHOLDER"))


def element_spec(elements: DataFrame, markers, labels) -> DataFrame:
    """Elements as they are carried out: adds stable_id, executed, role, fill_source, field_type, confidence and flags.

    ``elements`` holds (unit_id, element_id, policy, role_hint, content) and may
    hold unit_name.  An
    element that is not surely graded has the flag
    ``element_confidence_needs_review``.  A null policy is fixed, a null content
    empty; without unit and element id the stable id is the element's own.
    """
    x = elements.withColumn("executed", documents.executed_policy(F.coalesce("policy", F.lit("fixed"))))
    named = (F.coalesce("unit_id", F.lit("")) != "") & (F.coalesce("element_id", F.lit("")) != "")
    x = x.withColumns({
        "stable_id": F.when(named, F.concat_ws(".", "unit_id", "element_id")).otherwise(F.coalesce("element_id", F.lit(""))), "role": documents.role_of("role_hint", "executed"), "fill_source": documents.fill_source("executed"),
        "field_type": F.when(F.col("executed") == "generated", field_type("content", "unit_name" if "unit_name" in x.columns else None)), "confidence": documents.confidence_of("executed", "content", "role_hint", markers, labels),
    })
    return x.withColumn("flags", F.when(F.col("confidence") != "high", F.array(F.lit("element_confidence_needs_review"))).otherwise(F.array().cast("array<string>")))


def section_bindings(units: DataFrame, sections: DataFrame, by, width: int = 64) -> DataFrame:
    """(by, place, section_id, s_order, from, to) of the sections whose range a unit's overlaps, ends included.

    ``units`` holds (by, place, u_start, u_end, p_start, p_end), ``sections``
    (by, section_id, s_order, s_start, s_end, sp_start, sp_end): places in the
    source and, for units that no section holds by those, paragraphs.
    """
    def pairs(left, right, l, r):
        return intervals.overlap_join(left.dropna(subset=list(l)), right.dropna(subset=list(r)), by, width, l, r).select(
            *by, "place", "section_id", "s_order", F.greatest(l[0], r[0]).alias("from"), F.least(l[1], r[1]).alias("to"))

    own = units.select(*by, "place", "u_start", "u_end", "p_start", "p_end")
    direct = pairs(own, sections, ("u_start", "u_end"), ("s_start", "s_end"))
    rest = own.join(direct.select(*by, "place").distinct(), [*by, "place"], "left_anti")
    return direct.unionByName(pairs(rest, sections, ("p_start", "p_end"), ("sp_start", "sp_end")))


def template_spec(units: DataFrame, elements: DataFrame, sections: DataFrame, by, made=None) -> DataFrame:
    """One row a document: (by, units), an array of units with their page policy, sections and elements.

    ``units`` holds (by, place, unit_id, section, start, scope, u_start, u_end,
    p_start, p_end), ``elements`` the rows of :func:`element_spec` with (by,
    unit_id, e_order) and ``sections`` those of :func:`section_bindings`.  A unit
    takes the section of the longest overlap, the first of equals, else its own,
    else ``section_unknown``; none or several are flagged.  Elements stand in
    their order, a null order before 1; ``elements`` may have e_place, which
    settles equal orders and is not in the result.  With ``made``, a function
    of a frame that makes such rows one by one, ``elements`` holds what it makes
    them of, besides the columns named.  Every document has its units in order of
    place, which is one unit's own; rows without a document are left out.
    """
    units = units.dropna(subset=list(by))
    bound = section_bindings(units, sections, by)
    inside = nest(units, {"section_refs": (bound, ["s_order"])}, [*by, "place"])
    long = lambda r: r["to"] - r["from"]
    best = F.aggregate("section_refs", F.lit(None).cast(inside.schema["section_refs"].dataType.elementType), lambda a, r: F.when(a.isNull() | (long(r) > long(a)), r).otherwise(a))
    count = F.size("section_refs")
    flag = F.when(count == 0, "unit_section_profile_unmapped").when(count > 1, "unit_crosses_section_profiles")
    first = units.groupBy(*by).agg(F.min("place").alias("first_place"))
    ready = inside.join(first, by).withColumns({
        "page_policy": documents.page_policy("start", "scope", F.col("place") == F.col("first_place")), "section_profile": F.coalesce(best["section_id"], F.col("section"), F.lit("section_unknown")),
        "flags": F.array_compact(F.array(flag)),
    })
    ready = ready.select(*by, "place", "unit_id", "page_policy", "section_profile", "section_refs", "flags")
    elements = elements.withColumn("e_order", F.coalesce("e_order", F.lit(0)))
    order = ["e_order", *[c for c in ("e_place",) if c in elements.columns]]
    kind = (elements, order) if made is None else (elements, order, made)
    whole = nest(ready, {"elements": kind}, [*by, "unit_id"], unseen=("e_place",), spread=list(by))
    return gathered(whole, list(by), "units", ["place"])
