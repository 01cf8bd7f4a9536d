"""The tree of a document unit: tables, rows, cells, paragraphs, runs and spans as nodes.

Levels are built side by side by grouping rows, and no level waits for another:
a node's place is a key made of its ancestors' and its own ordinal, in digits of
one width.  A node's subtree are the keys that begin with its own, document order
is the order of the keys, and both are range predicates.
"""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import atomic_spans
from folioscope.sources.shared import written

#: Digits of an ordinal in a key.
WIDTH = 12
#: Rows of a table without a number come after all others.
UNNUMBERED = 1_000_000
_UNBOUND = ("unbound", "missing")


def _part(x) -> Column:
    return F.lpad((F.col(x) if isinstance(x, str) else x).cast("string"), WIDTH, "0")


def _names(x) -> Column:
    text = (F.col(x) if isinstance(x, str) else x).cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def table_cells(rows: DataFrame, by) -> DataFrame:
    """Cells of each table: (by, unit_id, table_id, row_at, cell_at, first_seq, column, cell, text, n_runs, alias_of, unbound, key).

    Rows of a cell share ``cell_id``, or without one their column; a row with
    neither is a cell of its own.  Cells stand in the order of their first row.
    A cell whose set of run ids, if it has any, is that of an earlier cell of
    the table is that one's ``alias_of``: a merged cell seen twice.  Sets are
    compared by size and 128 bits of an exclusive or, so a cell's runs are never
    gathered.
    """
    return _cells(numbered_rows(rows, by), by)


def _cells(placed: DataFrame, by) -> DataFrame:
    place = [*by, "unit_id", "table_id", "row_at", "cell_key"]
    inside = placed.filter(F.col("table_id").isNotNull())
    cells = inside.groupBy(*place).agg(
        F.min("source_seq").alias("first_seq"), F.min_by("column_no", F.when(F.col("column_no").isNotNull(), F.col("source_seq"))).alias("column"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"),
        F.count_if(F.col("binding").isin(*_UNBOUND)).alias("unbound"), F.count(F.lit(1)).alias("n_paragraphs"),
    )
    order = Window.partitionBy(*by, "unit_id", "table_id", "row_at").orderBy("first_seq")
    cells = cells.withColumn("cell_at", F.row_number().over(order)).withColumn("cell", F.concat(F.lit("table:"), "table_id", F.lit("/row:"), _names("row_at"), F.lit("/cell:"), _names(F.coalesce("column", "cell_at"))))
    ids = inside.select(*place, F.explode(_clean("raw_run_ids")).alias("run")).distinct().groupBy(*place)
    ids = ids.agg(F.count(F.lit(1)).alias("n_runs"), F.bit_xor(F.xxhash64("run")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "run")).alias("h2"))
    known = cells.join(ids, place, "left")
    owner = known.filter(F.col("n_runs").isNotNull()).groupBy(*by, "unit_id", "table_id", "n_runs", "h1", "h2").agg(F.min(F.struct("row_at", "cell_at", "cell")).alias("owner"))
    known = known.join(owner, [*by, "unit_id", "table_id", "n_runs", "h1", "h2"], "left")
    alias = F.when((F.col("owner.row_at") != F.col("row_at")) | (F.col("owner.cell_at") != F.col("cell_at")), F.col("owner.cell"))
    return known.select(*place, "cell_at", "first_seq", "column", "cell", "text", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), alias.alias("alias_of"), "unbound", "n_paragraphs")


def _clean(ids) -> Column:
    return F.filter(F.coalesce(F.col(ids), F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def numbered_rows(rows: DataFrame, by) -> DataFrame:
    """Rows that belong to a document and a unit and have a place, with row_at (the number of a table's row, or a later one) and cell_key."""
    rows = rows.dropna(subset=[*by, "unit_id", "source_seq"])
    lost = Window.partitionBy(*by, "unit_id", "table_id").orderBy("source_seq")
    tables, odd = F.col("table_id").isNotNull(), F.col("row_no").isNull()
    unnumbered = rows.filter(tables & odd).withColumn("row_at", F.row_number().over(lost).cast("long") + UNNUMBERED)
    rest = rows.filter(~tables | ~odd).withColumn("row_at", F.col("row_no").cast("long"))
    key = F.coalesce("cell_id", F.concat(F.lit("column:"), F.col("column_no").cast("string")), F.concat(F.lit("seq:"), F.col("source_seq").cast("string")))
    return rest.unionByName(unnumbered).withColumn("cell_key", key)


def _facts_of(runs: DataFrame, by) -> DataFrame:
    """(by, source_seq, facts): the run facts of each paragraph as one row, so that a paragraph meets them once."""
    fact = F.struct(F.col("position"), F.col("raw_run_id"), F.col("text"))
    return runs.groupBy(*by, "source_seq").agg(F.collect_list(fact).alias("facts"))


def _bound(paragraphs: DataFrame, itself: bool = False) -> DataFrame:
    """Each run id of paragraphs that have their facts; see :func:`bound_runs`.  With ``itself`` a paragraph is a row too, with order -1 and no id."""
    asked = paragraphs.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), _clean("raw_run_ids")) if itself else _clean("raw_run_ids")).alias("run_order", "run_id"))
    asked = asked.withColumn("run_order", F.col("run_order") - 1) if itself else asked
    facts = F.coalesce("facts", F.array().cast(paragraphs.schema["facts"].dataType))
    own = F.array_max(F.transform(F.filter(facts, lambda x: x["raw_run_id"] == F.col("run_id")), lambda x: F.struct(x["position"].alias("position"), x["text"].alias("text"))))
    there = F.array_max(F.transform(F.filter(facts, lambda x: x["position"].cast("int") == F.col("run_order")), lambda x: F.struct(x["text"].alias("text"))))
    both = asked.withColumns({"own": own, "there": there})
    text = F.when(F.col("own").isNotNull(), F.col("own.text")).otherwise(F.col("there.text"))
    return both.withColumns({"fact_text": F.coalesce(text, F.lit("")), "found": F.col("own").isNotNull() | F.col("there").isNotNull()}).drop("own", "there", "facts")


def bound_runs(paragraphs: DataFrame, runs: DataFrame, by) -> DataFrame:
    """Each run id of a paragraph with its fact: that of the same id (the last of several), else the one at the same position, else none.

    Adds run_order, run_id, fact_text and found.  A paragraph's facts are laid
    beside its list of ids, and are looked up there.
    """
    return _bound(paragraphs.join(_facts_of(runs, by), [*by, "source_seq"], "left"))


def document_nodes(rows: DataFrame, runs: DataFrame, by, spans: bool = True) -> DataFrame:
    """The nodes of all units: (by, unit_id, node, parent, kind, key, text, alias_of, children_complete, content_complete, unbound, omitted).

    ``rows`` holds (by, unit_id, source_seq, table_id, row_no, column_no,
    cell_id, paragraph_id, text, raw_run_ids, binding), ``runs`` (by,
    source_seq, position, raw_run_id, text).  A unit has its paragraphs and
    tables in order, a table at its first row; an aliased cell is a leaf that is
    not complete; a run without a fact is not complete unless its paragraph is
    empty.  What is incomplete or unbound below a row, a table or a unit counts
    in it.  ``omitted`` are rows of a table that other units hold.  Rows without
    document, unit or place are left out; ``source_seq`` is one row's own in a document.
    """
    unit = [*by, "unit_id"]
    columns = [*unit, "node", "parent", "kind", "key", "text", "alias_of", "children_complete", "content_complete", "unbound", "omitted"]
    yes, none, zero = F.lit(True), F.lit(None).cast("string"), F.lit(0).cast("long")

    def level(df, node, parent, kind, key, text, alias_of=none, children=yes, content=yes, unbound=zero, omitted=zero):
        cells = dict(node=node, parent=parent, kind=F.lit(kind) if isinstance(kind, str) else kind, key=key, text=text, alias_of=alias_of, children_complete=children, content_complete=content, unbound=unbound.cast("long"), omitted=omitted.cast("long"))
        return df.select(*unit, *[c.alias(n) for n, c in cells.items()])

    # what several levels are made of is written once: rows of tables, but not the paragraphs, which are all the text
    placed = written(numbered_rows(rows.filter(F.col("table_id").isNotNull()), by))
    cells = _cells(placed, by)
    firsts = placed.filter(F.col("table_id").isNotNull()).groupBy(*unit, "table_id").agg(
        F.min("source_seq").alias("table_at"), F.count(F.lit(1)).alias("held"), F.count_if(F.col("row_no").isNull()).alias("lost"))
    everywhere = rows.filter(F.col("table_id").isNotNull() & F.col("source_seq").isNotNull()).groupBy(*by, "table_id").agg(F.countDistinct("source_seq").alias("whole"))
    firsts = firsts.join(everywhere, [*by, "table_id"]).withColumn("omitted", F.col("whole") - F.col("held"))
    cells = cells.join(firsts.select(*unit, "table_id", "table_at"), [*unit, "table_id"])
    cells = cells.withColumns({"row": F.concat(F.lit("table:"), "table_id", F.lit("/row:"), _names("row_at")), "row_key": F.concat(_part("table_at"), _part("row_at"))}).withColumn("cell_place", F.concat("row_key", _part("cell_at")))
    cells = written(cells)
    own = F.col("alias_of").isNull()
    cell_nodes = level(cells, F.col("cell"), F.col("row"), "cell", F.col("cell_place"), F.col("text"), F.col("alias_of"), own, own, F.when(own, F.col("unbound")).otherwise(F.col("n_runs")))
    # rows sum up their cells, tables their rows
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_at", "text"))), lambda x: x["text"]), " | ")
    by_row = cells.groupBy(*unit, "table_id", "table_at", "row_at", "row", "row_key").agg(
        F.bool_and(own).alias("content"), (F.sum("unbound") + F.sum(F.when(own, F.col("unbound")).otherwise(F.col("n_runs")))).alias("unbound"), texts.alias("text"))
    by_row = written(by_row)
    row_nodes = level(by_row, F.col("row"), F.concat(F.lit("table:"), "table_id"), "row", F.col("row_key"), F.col("text"), content=F.col("content"), unbound=F.col("unbound"))
    by_table = by_row.groupBy(*unit, "table_id").agg(F.bool_and("content").alias("content"), F.sum("unbound").alias("unbound")).join(firsts, [*unit, "table_id"])
    whole = F.col("omitted") == 0
    table_nodes = level(by_table, F.concat(F.lit("table:"), "table_id"), F.concat(F.lit("unit:"), "unit_id"), "table", _part("table_at"), none, none, whole & (F.col("lost") == 0), whole & F.col("content"), F.col("unbound") + F.col("lost"), F.col("omitted"))
    # paragraphs under the unit or under a cell of their own
    where = cells.filter(own).select(*unit, "table_id", "row_at", "cell_key", F.col("cell").alias("parent"), F.col("cell_place").alias("above"))
    loose = rows.dropna(subset=[*unit, "source_seq"]).filter(F.col("table_id").isNull()).withColumns({"parent": F.concat(F.lit("unit:"), "unit_id"), "above": F.lit("")})
    held = [*unit, "source_seq", "parent", "above", "paragraph_id", "text", "raw_run_ids", "binding"]
    paragraphs = placed.join(where, [*unit, "table_id", "row_at", "cell_key"]).select(*held).unionByName(loose.select(*held))
    paragraphs = paragraphs.join(_facts_of(runs, by), [*by, "source_seq"], "left")
    asked = F.size(_clean("raw_run_ids"))
    paragraphs = paragraphs.select(
        *unit, "parent", "text", "raw_run_ids", "binding", "facts", F.concat("parent", F.lit("/paragraph:"), F.coalesce("paragraph_id", F.col("source_seq").cast("string"))).alias("paragraph"),
        F.concat("above", _part("source_seq")).alias("place"), asked.alias("asked"), F.size("facts").alias("n_facts"))
    paragraphs = written(paragraphs) if spans else paragraphs
    complete = F.when(F.col("asked") > 0, F.coalesce("n_facts", F.lit(0)) >= F.col("asked")).otherwise(True)
    loosely = F.coalesce(F.col("binding").isin(*_UNBOUND).cast("long"), zero)
    # paragraphs and their runs come out of one pass
    known = F.col("found") | (F.coalesce("text", F.lit("")) == "")
    itself = F.col("run_order") < 0
    either = lambda a, b: F.when(itself, a).otherwise(b)
    named = {"run": F.concat(F.lit("run:"), "run_id"), "run_place": F.concat("place", _part("run_order"))}
    both = _bound(paragraphs, itself=True).withColumns(named)
    paragraph_nodes = level(
        both, either(F.col("paragraph"), F.col("run")), either(F.col("parent"), F.col("paragraph")), either(F.lit("paragraph"), F.lit("run")), either(F.col("place"), F.col("run_place")), either(F.col("text"), F.col("fact_text")),
        content=either(complete, known), unbound=either(loosely, (~F.col("found")).cast("long")))
    levels = [cell_nodes, row_nodes, table_nodes, paragraph_nodes]
    if spans:
        cut = _bound(paragraphs).withColumns(named).withColumn("span", F.explode(atomic_spans("fact_text")))
        name = F.concat(F.lit("span:"), "run_id", F.lit("@"), F.lpad(F.col("span.start").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("span.end").cast("string"), 6, "0"))
        levels.append(level(cut, name, F.col("run"), "span", F.concat("run_place", _part("span.start")), F.col("span.text"), content=known, unbound=(~F.col("found")).cast("long")))
    table_nodes = written(table_nodes)
    levels[2] = table_nodes
    # a unit's own paragraphs are counted by themselves, without their texts
    n_facts = runs.groupBy(*by, "source_seq").agg(F.count(F.lit(1)).alias("n_facts"))
    own = loose.select(*unit, "source_seq", asked.alias("asked"), loosely.alias("unbound")).join(n_facts, [*by, "source_seq"], "left")
    sums = [*unit, "content_complete", "unbound", "omitted"]
    own = own.select(*unit, complete.alias("content_complete"), "unbound", zero.alias("omitted"))
    top = table_nodes.select(*sums).unionByName(own).groupBy(*unit).agg(F.bool_and("content_complete").alias("content"), F.sum("unbound").alias("unbound"), F.sum("omitted").alias("omitted"))
    levels.append(level(top, F.concat(F.lit("unit:"), "unit_id"), none, "unit", F.lit(""), none, content=F.col("content"), unbound=F.col("unbound"), omitted=F.col("omitted")))
    return reduce(DataFrame.unionByName, levels).select(*columns)


def nested_sets(nodes: DataFrame, by) -> DataFrame:
    """Adds first, last and n_leaves: a node's place in document order, the last place below it, and the leaves at or under it.

    ``by`` names the tree; nodes have keys as in :func:`document_nodes`.  Nodes
    move once, to meet the others of their tree; they are numbered in order of
    their keys and then read backwards, where all that is below a node has just
    been seen, so no more is held than a count for each level.  Nodes of one
    key share their counts and have places of their own, in order of ``node``;
    without anything below them they have no leaves, and are left out.  So are
    nodes without tree or key, though those without key take the first places.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    met = nodes.dropna(subset=list(by)).repartition(*by)
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, "key"))
    numbered = met.withColumn("first", F.row_number().over(Window.partitionBy(*by).orderBy("key", "node")).cast("long")).withColumn("_same", same)
    backwards = numbered.sortWithinPartitions(*by, F.desc("first"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in backwards.schema.fields[:-1]]).add("last", "long").add("n_leaves", "long")
    columns = to_arrow_schema(schema)
    return backwards.mapInArrow(lambda batches: _counted(batches, columns), schema).filter("n_leaves IS NOT NULL")


def _counted(batches, columns: pa.Schema):
    """Nodes of whole trees, the last first, with the last place and the leaves below each."""
    key, path, size, leaves = None, "", 0, 0
    held, held_leaves = [0], [0]  # by the number of its ordinals: nodes and leaves below each node of the path
    for batch in batches:
        lasts, counts = [], []
        firsts = batch.column("first").to_pylist()
        for k, first, same in zip(batch.column("key").to_pylist(), firsts, batch.column("_same").to_pylist()):
            if k is not None and k != key:
                depth, common = len(k) // WIDTH, len(os.path.commonprefix([k, path])) // WIDTH
                del held[common + 1 :], held_leaves[common + 1 :]
                held += [0] * (depth + 1 - len(held))
                held_leaves += [0] * (depth + 1 - len(held_leaves))
                size = same + held[depth]
                leaves = 1 if size == 1 else held_leaves[depth]
                for level in range(depth):
                    held[level] += same
                    held_leaves[level] += size == 1
                key = path = k
            lasts.append(first + size - 1)
            counts.append(leaves or None if k is not None else None)
            if first == 1:  # the next row is another tree's
                key, path, held, held_leaves = None, "", [0], [0]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lasts, pa.int64()), pa.array(counts, pa.int64())], schema=columns)
