"""Audit of the units found in documents against those that a signed standard expects.

What is asked of a document's places, its titles and the places that its units
own, is read in one pass: all of it meets in one partition, titles and units
first, then places in order, and a row a unit comes out.  So a place moves once
as a text and once as one that is owned, and no row is made for a pair.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import is_toc_entry, match_key
from folioscope.operators.matching import one_each
from folioscope.operators.status import FAIL, UNKNOWN

# How a unit may begin and what it may span, the beginning of ids outside the standard, a short title that others may follow.
STARTS, SCOPES = ["document_start", "new_page"], ["page_range_exclusive"]
CUSTOM = "custom:"
SHORT_TITLE = "附录"

#: Titles of this many characters or more may be followed by other text; so many matches, the first ones, are looked at.
LEAST_PREFIX, LOOKED_AT = 3, 3

_TITLE, _UNIT, _PLACE, _ENTRY = range(4)
#: Rows of a batch that comes out of the pass.
_ROWS = 10_000


class _Document:
    """What one document's rows have told so far; see :func:`_unit_facts`."""

    def __init__(self, key, ranked: bool, catalog: frozenset):
        self.key, self.catalog, self.ranks = key, catalog, {} if ranked else None
        self.titles, self.whole, self.lengths, self.found, self.owned = {}, {}, (), {}, {}
        self.seq, self.owners, self.rank, self.n_units = (), set(), -1, 0

    def title(self, unit, tier, key: bytes, exact: bool):
        slot = self.found.setdefault((unit, tier), [unit, (), 0, False])  # the unit, the last place, how many, whether one is its own
        (self.whole if exact else self.titles).setdefault(key, []).append(slot)
        if not exact and len(key) not in self.lengths:
            self.lengths = (*self.lengths, len(key))

    def unit(self, unit):
        self.n_units += 1
        self.ranks[unit] = self.n_units

    def at(self, seq):
        if self.seq == () or seq != self.seq:
            self.seq, self.owners, self.rank = seq, set(), -1

    def place(self, unit, seq):
        self.at(seq)
        own = self.owned.get(unit)
        if own is None:
            self.owned[unit] = [1, 1, seq, seq]
        else:
            own[0] += 1
            own[1] += seq != own[3]
            own[3] = seq
        if self.ranks is None:
            self.owners.add(unit)
        elif self.ranks.get(unit, -1) > self.rank:
            self.rank, self.owners = self.ranks[unit], {unit}

    def entry(self, seq, text: bytes, toc: bool):
        self.at(seq)
        for titles, key in [(self.whole, text), *((self.titles, text[:n]) for n in self.lengths if n <= len(text))]:
            slots = titles.get(key)
            if not slots:
                continue
            for slot in slots:
                if slot[1] != seq or slot[2] == 0:
                    if not toc or slot[0] in self.catalog:
                        slot[1:] = seq, slot[2] + 1, slot[3] or slot[0] in self.owners
            if any(slot[2] >= LOOKED_AT for slot in slots):
                titles[key] = [slot for slot in slots if slot[2] < LOOKED_AT]

    def rows(self):
        best = {}
        for (unit, tier), (_, _, n, own) in self.found.items():
            before = best.setdefault(unit, (None, 0, False))
            if n and tier is not None and (before[0] is None or tier < before[0]):
                best[unit] = tier, n, own
        for unit in {**self.owned, **best}:
            yield (*self.key, unit, *self.owned.get(unit, (None,) * 4), *best.get(unit, (None,) * 3)[1:])


def _documents(batches, n_by: int, ranked: bool, catalog: frozenset, schema: pa.Schema):
    """Rows of whole documents in order to a row a unit."""
    document, out = None, []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)

    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_by])))
        for key, tag, unit, tier, seq, text, flag in zip(keys, *(batch.column(c).to_pylist() for c in ("tag", "unit_id", "tier", "seq", "key", "flag"))):
            if document is None or key != document.key:
                if document is not None:
                    out.extend(document.rows())
                if len(out) >= _ROWS:
                    yield made()
                    out = []
                document = _Document(key, ranked, catalog)
            if tag == _ENTRY:
                document.entry(seq, text, flag)
            elif tag == _PLACE:
                document.place(unit, seq)
            elif tag == _TITLE:
                document.title(unit, tier, text, flag)
            else:
                document.unit(unit)
    if document is not None:
        out.extend(document.rows())
    yield made()


def _unit_facts(by: list[str], places: DataFrame, units: DataFrame | None = None, entries: DataFrame | None = None, terms: DataFrame | None = None, catalog=()) -> DataFrame:
    """(by, unit_id, n_refs, n_distinct, low, high, n_matched, owned) of the units that own places or have titles; see :func:`anchored` and :func:`audit`.

    The first four are null for units without places, the last two for those
    without titles.  ``units`` (by, unit_id, place) tells which of several units
    owns a place: the last one; without it all do.  Rows without a document and
    places without unit or number are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    frames = [places.dropna(subset=[*by, "unit_id", "seq"]).select(*by, F.lit(_PLACE).alias("tag"), "unit_id", "seq")]
    if units is not None:
        frames.append(units.dropna(subset=[*by, "unit_id"]).select(*by, F.lit(_UNIT).alias("tag"), "unit_id", "place"))
    if entries is not None and terms is not None:
        short = (F.length("key") < LEAST_PREFIX) & (F.col("key") != SHORT_TITLE)
        named = terms.dropna(subset=list(by)).withColumn("key", match_key("term")).filter("key <> ''")
        frames.append(named.select(*by, F.lit(_TITLE).alias("tag"), "unit_id", "tier", F.col("key").cast("binary").alias("key"), short.alias("flag")))
        held = entries.dropna(subset=list(by)).withColumns({"key": match_key("text"), "flag": F.coalesce(is_toc_entry("text"), F.lit(False))}).filter("key <> ''")
        frames.append(held.select(*by, F.lit(_ENTRY).alias("tag"), "seq", F.col("key").cast("binary").alias("key"), "flag"))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for name, kind in (("place", "int"), ("tier", "int"), ("key", "binary"), ("flag", "boolean")):
        union = union if name in union.columns else union.withColumn(name, F.lit(None).cast(kind))
    keys = [f"k{i}" for i in range(len(by))]
    rows = union.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("tag").cast("byte").alias("tag"), "unit_id", "tier", "seq", "place", "key", "flag")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.least("tag", F.lit(_PLACE)), "place", "seq", "tag", "unit_id").drop("place")
    seq = rows.schema["seq"].dataType
    schema = T.StructType([*rows.schema.fields[: len(by)], rows.schema["unit_id"]])
    for name, kind in (("n_refs", T.LongType()), ("n_distinct", T.LongType()), ("low", seq), ("high", seq), ("n_matched", T.LongType()), ("owned", T.BooleanType())):
        schema = schema.add(name, kind)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    n_by, ranked, chosen, columns = len(by), units is not None, frozenset(catalog), to_arrow_schema(schema)
    made = ordered.mapInArrow(lambda batches: _documents(batches, n_by, ranked, chosen, columns), schema)
    return made.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *schema.names[n_by:])


def anchored(entries: DataFrame, terms: DataFrame, owners: DataFrame, by: list[str], catalog: list[str] = ()) -> DataFrame:
    """(by, unit_id, n_matched, owned): whether a unit owns one of the first places where its title stands.

    ``entries`` (by, seq, text) are a document's places, ``terms`` (by, unit_id,
    tier, term) titles, of which those of the lowest tier that is found count,
    and ``owners`` (by, seq, unit_id) says whose a place is.  A title is found in
    a text that equals it or, if it has three characters, begins with it, by
    their match keys; lines of a table of contents are passed over unless the
    unit is one of ``catalog``.  Null and empty titles and texts match nothing.
    Titles without a document are left out.
    """
    facts = _unit_facts(by, owners, entries=entries, terms=terms, catalog=catalog)
    return facts.filter("owned IS NOT NULL").select(*by, "unit_id", "n_matched", "owned")


def audit(expected: DataFrame, actual: DataFrame, places: DataFrame, by: list[str], entries: DataFrame | None = None, terms: DataFrame | None = None, catalog: list[str] = ()) -> DataFrame:
    """(by, finding, status, affected_id): what is wrong with the units of each document.

    ``expected`` (by, unit_id, place, seq_start, seq_end, page_start,
    page_scope) is the standard, ``actual`` (by, unit_id, place, page_start,
    page_scope) what was found, ``places`` (by, unit_id, seq) the places that
    its units own, ``entries`` and ``terms`` as :func:`anchored` takes them.

    * ``standard_invalid`` (UNKNOWN, and then nothing else of that document):
      it has no units, a unit without id, or a page policy outside its values;
    * ``unit_order_mismatch``: the two lists of ids differ, repeats included;
    * ``unit_missing``, ``unit_unexpected``, ``custom_unit``, one a unit;
    * ``source_range_mismatch``: a unit that is missing, or owns other places
      than each of its range once; without an expected range nothing is asked;
    * ``page_policy_mismatch``: missing, or other values than expected;
    * ``anchor_owner_mismatch``: none of the first places of a unit's title is its own.

    Null ids of found units are none.  Of found units with one id the last
    counts, and of owners of one place the last.  Documents are those of either side.
    """
    key = [*by, "unit_id"]
    actual = actual.filter("unit_id IS NOT NULL")
    outside = ~F.coalesce(F.col("page_start").isin(*STARTS) & F.col("page_scope").isin(*SCOPES), F.lit(False))
    has_policy = F.col("page_start").isNotNull() | F.col("page_scope").isNotNull()
    documents = expected.select(*by).unionByName(actual.select(*by)).distinct()
    sound = expected.groupBy(*by).agg(F.count_if(F.col("unit_id").isNull() | (has_policy & outside)).alias("n_bad")).filter("n_bad = 0").select(*by)
    said = lambda df, finding, affected=None, status=FAIL: df.select(*by, F.lit(finding).alias("finding"), F.lit(status).alias("status"), (F.lit(None).cast("string") if affected is None else affected).alias("affected_id"))
    out = [said(documents.join(sound, by, "left_anti"), "standard_invalid", status=UNKNOWN)]
    expected, actual = expected.join(sound, by, "left_semi"), actual.join(sound, by, "left_semi")
    # order: the two lists side by side
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("place", "unit_id"))
    sides = [df.select(*by, nth.alias("nth"), F.col("unit_id").alias(name)) for df, name in ((expected, "want"), (actual, "got"))]
    apart = sides[0].join(sides[1], [*by, "nth"], "full_outer").filter(~F.col("want").eqNullSafe(F.col("got")))
    out.append(said(apart.select(*by).distinct(), "unit_order_mismatch"))
    # one row an id with what is expected of it and what was found
    found = one_each(actual, key, ["place", "page_start", "page_scope"]).select(*key, F.struct("page_start", "page_scope").alias("got"), F.lit(True).alias("is_found"))
    want = one_each(expected, key, ["place"]).select(*key, "seq_start", "seq_end", F.struct("page_start", "page_scope").alias("want"), F.lit(True).alias("is_expected"))
    if terms is not None:
        terms = terms.join(expected.select(*key).distinct(), key, "left_semi")
    facts = _unit_facts(by, places, actual.select(*key, "place"), entries, terms, catalog)
    units = want.join(found, key, "full_outer").join(facts, key, "left")
    lost, extra = F.col("is_found").isNull(), F.col("is_expected").isNull()
    custom = F.startswith(F.col("unit_id"), F.lit(CUSTOM))
    size = F.col("seq_end") - F.col("seq_start") + 1
    exact = (F.col("low") == F.col("seq_start")) & (F.col("high") == F.col("seq_end")) & (F.col("n_distinct") == size) & (F.col("n_refs") == size)
    ranged = ~extra & F.col("seq_start").isNotNull() & F.col("seq_end").isNotNull()
    paged = ~extra & (F.col("want.page_start").isNotNull() | F.col("want.page_scope").isNotNull())
    tests = [
        (lost, "unit_missing", F.col("unit_id")),
        (extra & ~custom, "unit_unexpected", F.col("unit_id")),
        (~lost & custom, "custom_unit", F.col("unit_id")),
        (ranged & (lost | ~F.coalesce(exact, F.lit(False))), "source_range_mismatch", F.concat("unit_id", F.lit(".boundary"))),
        (paged & (lost | ~F.col("want").eqNullSafe(F.col("got"))), "page_policy_mismatch", F.concat("unit_id", F.lit(".page_policy"))),
        (~F.col("owned"), "anchor_owner_mismatch", F.col("unit_id")),
    ]
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("finding"), F.lit(FAIL).alias("status"), a.alias("affected_id"))) for c, n, a in tests]))
    out.append(units.select(*by, F.explode(rows).alias("f")).select(*by, "f.*"))
    found_all = out[0]
    for df in out[1:]:
        found_all = found_all.unionByName(df)
    return found_all
