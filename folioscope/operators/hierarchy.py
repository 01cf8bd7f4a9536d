"""Trees and inheritance as adjacency tables (node, parent), of any depth.

What a node takes from above is found by climbing: every node knows a stretch of
its path, and a join with the stretch that begins where its own ends doubles
it, so a path of n takes log2(n) joins and nodes that have reached the top rest.
What a node sums up from below is found by contraction: leaves are added to
their parents, and where few are left, chains of only children are folded into
one edge; both at least halve the tree in a few rounds, and the folded nodes get
their sums afterwards.  Neither holds a row for each node and ancestor.  Each
round is written as a table in the shared folder, and only counts come to the driver.
Before the rounds, rows are sorted by node and what lies within a slice of them
is folded there (:mod:`slices`), so that the rounds see what crosses slices alone.

Columns keep their names at the edges; within, a node is the struct of ``by``
and its own id, so that no column of the input can clash with a helper.  Rows
without a node are no nodes.  Rows that repeat a node are one node, whose parent
is none if a row says so, or else the smallest.  Parents that are not nodes end
a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import slices
from folioscope.operators.sequence import ranged_sequence
from folioscope.sources.shared import written

_AGGREGATES = {"sum": F.sum, "all": F.bool_and, "min": F.min, "max": F.max, "xor": F.bit_xor}
#: Chains are folded when a round takes off fewer than one in so many nodes.
_FEW = 4


def _both(kind: str, a: Column, b: Column) -> Column:
    """Two values as one, where a null is nothing."""
    both = {"sum": lambda: a + b, "all": lambda: a & b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b), "xor": lambda: a.bitwiseXOR(b)}[kind]()
    return F.coalesce(both, a, b)


def _key_of(by):
    return lambda c: F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], F.col(c).alias("n"))


def _forest(nodes: DataFrame, by, node: str, parent: str, values: dict[str, Column] | None = None) -> DataFrame:
    """(id, up, lost, *values): one row a node; ``up`` is null at the top, ``lost`` where the parent is not a node.

    ``values`` are aggregates over the rows of a node.
    """
    key = _key_of(by)
    rows = nodes.filter(F.col(node).isNotNull())
    grouped = rows.groupBy(key(node).alias("id")).agg(
        F.when(F.count_if(F.col(parent).isNull()) == 0, F.min(F.when(F.col(parent).isNotNull(), key(parent)))).alias("up"), *[c.alias(f"v{i}") for i, c in enumerate((values or {}).values())]
    )
    known = rows.select(key(node).alias("up"), F.lit(True).alias("known")).distinct()
    out = grouped.join(known, "up", "left").withColumn("lost", F.col("up").isNotNull() & F.col("known").isNull())
    return out.select("id", F.when(~F.col("lost"), F.col("up")).alias("up"), "lost", *[f"v{i}" for i in range(len(values or {}))])


def _named(df: DataFrame, by, columns) -> DataFrame:
    """A frame by id with the names of ``by`` and of its node put back."""
    return df.select(*[F.col(f"id.b{i}").alias(b) for i, b in enumerate(by)], F.col("id.n").alias("node"), *columns)


def _climb(forest: DataFrame, carried: dict[str, str], sliced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (id, up, *carried) of nodes that reach a top, ``up`` null, and of those that run into a ring, ``up`` on the ring.

    ``carried`` names columns of ``forest`` and says how that of a stretch
    follows from its lower and upper part: ``nearest`` and ``topmost`` take the
    first that is not null from below or above, ``last`` the upper one, and
    others as in :func:`_both`.  Paths are first climbed within slices; the
    rounds are for the nodes alone that paths from other slices enter by.  Not
    ``sliced``, each node of a ring is the ``up`` of one.
    """
    rules = {"nearest": F.coalesce, "topmost": lambda a, b: F.coalesce(b, a), "last": lambda a, b: b}
    joined = {name: rules[kind] if kind in rules else (lambda a, b, k=kind: _both(k, a, b)) for name, kind in carried.items()}
    above = lambda rows: rows.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in carried])
    both = lambda rows, upper: rows.join(above(upper), F.col("up") == F.col("u_id")).select("id", F.col("u_up").alias("up"), *[joined[c](F.col(c), F.col(f"u_{c}")).alias(c) for c in carried])
    if sliced and all(k in rules or _plain(k, forest.schema[c].dataType) for c, k in carried.items()):
        rows, size = forest.select("id", "up", *carried), slices.ROWS
        near = _in_slices(written(rows), lambda batches: slices.climbed(batches, carried, size), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
        far = near.filter(F.col("up").isNotNull())
        entered = near.join(far.select(F.col("up").alias("id")).distinct(), "id", "left_semi")
        at_top, in_rings = _climb(entered, carried, sliced=False)
        return near.filter(F.col("up").isNull()).unionByName(both(far, at_top)), both(far, in_rings)
    parts, moving = [], written(forest.select("id", "up", *carried))
    steps, before, n = 1, -1, -1
    while True:
        parts.append(moving.filter(F.col("up").isNull()))
        moving = moving.filter(F.col("up").isNotNull())
        before, n = n, moving.count()
        # each round brings nodes to the top while any can get there; what stays runs into rings, and is walked once around
        if not n or n == before and steps >= n:
            break
        moving = written(both(moving, reduce(DataFrame.unionByName, [*parts, moving])))
        steps *= 2
    return reduce(DataFrame.unionByName, parts), moving


def _folded(alive: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds chains of only children: what is left of ``alive``, the chains' nodes (id, below, *sums) and the nodes of bare rings (id)."""
    vs, es = [f"v{i}" for i in range(len(kinds))], [f"e{i}" for i in range(len(kinds))]
    single = alive.filter("kids = 1")
    names = single.select(F.col("id").alias("below"), F.lit(True).alias("open"))
    child = alive.filter(F.col("up").isNotNull()).select(F.col("up").alias("id"), F.col("id").alias("below"), *[F.col(e).alias(f"k{e}") for e in es])
    seg = single.join(child, "id").join(names, "below", "left")
    seg = written(seg.select("id", "below", "up", *es, *[_both(k, F.col(v), F.col(f"k{e}")).alias(v) for k, v, e in zip(kinds, vs, es)], F.coalesce("open", F.lit(False)).alias("open")))
    before, n = -1, seg.filter("open").count()
    while n and n != before:
        known = seg.select(F.col("id").alias("u_id"), F.col("below").alias("u_below"), *[F.col(v).alias(f"u_{v}") for v in vs], F.col("open").alias("u_open"))
        step = seg.filter("open").join(known, F.col("below") == F.col("u_id"))
        step = step.select("id", F.col("u_below").alias("below"), "up", *es, *[_both(k, F.col(v), F.col(f"u_{v}")).alias(v) for k, v in zip(kinds, vs)], F.col("u_open").alias("open"))
        seg = written(seg.filter("NOT open").unionByName(step))
        before, n = n, seg.filter("open").count()
    ring, chains = seg.filter("open").select("id"), seg.filter("NOT open")
    tops = chains.join(chains.select(F.col("id").alias("up"), F.lit(True).alias("inside")), "up", "left").filter(F.col("inside").isNull())
    moved = tops.select(F.col("below").alias("id"), F.col("up").alias("new_up"), *[_both(k, F.col(e), F.col(v)).alias(f"new_{e}") for k, v, e in zip(kinds, vs, es)], F.lit(True).alias("moved"))
    rest = alive.filter("kids <> 1").join(moved, "id", "left")
    pick = lambda c: F.when(F.col("moved"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return written(rest.select("id", pick("up"), *vs, *[pick(e) for e in es], "kids")), chains.select("id", "below", *vs), ring


def _in_slices(rows: DataFrame, told, schema: T.StructType) -> DataFrame:
    """``told`` over the rows of a written table, sorted by id."""
    return written(rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(told, schema))


def _plain(kind: str, of: T.DataType) -> bool:
    """Whether Python combines values of a type as Spark does."""
    return isinstance(of, (T.IntegralType, T.BooleanType)) or kind in ("min", "max") and isinstance(of, (T.StringType, T.DateType)) and of in (T.StringType(), T.DateType())


def _totals(forest: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, known, *v): each v over the node and all below it; a node on a ring has none and is not ``known``."""
    vs, es = [f"v{i}" for i in range(len(kinds))], [f"e{i}" for i in range(len(kinds))]
    kids = forest.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    nothing = {f"e{i}": F.lit(None).cast(forest.schema[v].dataType) for i, v in enumerate(vs)}
    rows = written(forest.select("id", "up", *vs).join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))))
    summed = lambda both: both.groupBy("id").agg(F.max("up").alias("up"), *[_AGGREGATES[k](v).alias(v) for k, v in zip(kinds, vs)], *[F.max(e).alias(e) for e in es], F.sum("kids").alias("kids"))
    settled = []
    if all(_plain(k, forest.schema[v].dataType) for k, v in zip(kinds, vs)):
        of = [T.StructField(c, forest.schema[v].dataType) for c, v in [*zip(vs, vs), *zip(es, vs)]]
        schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("id", forest.schema["id"].dataType), T.StructField("up", forest.schema["up"].dataType), T.StructField("kids", T.LongType()), *of])
        size = slices.ROWS
        near = _in_slices(rows, lambda batches: slices.folded(batches, kinds, size), schema)
        settled = [near.filter("part = 'done'").select("id", F.lit(True).alias("known"), *vs)]
        inside = near.filter("part = 'chain'").select("id", F.col("up").alias("below"), *vs)
        alive = written(summed(near.filter("part IN ('alive', 'told')")).select("id", "up", *vs, *es, "kids"))
    else:
        inside, alive = None, rows.select("id", "up", *vs, *[nothing[e].alias(e) for e in es], "kids")
    done, chains, n = [], [], alive.count()
    if inside is not None and n:
        chains.append(inside)
    while n:
        leaves = alive.filter("kids = 0")
        done.append(leaves.select("id", F.lit(True).alias("known"), *vs))
        told = leaves.filter(F.col("up").isNotNull()).select(F.col("up").alias("id"), F.lit(None).cast(alive.schema["up"].dataType).alias("up"),
            *[_both(k, F.col(v), F.col(e)).alias(v) for k, v, e in zip(kinds, vs, es)], *[nothing[e].alias(e) for e in es], F.lit(-1).cast("long").alias("kids"))
        alive = written(summed(alive.filter("kids > 0").unionByName(told)))
        m = alive.count()
        if m and (n - m) * _FEW < n:
            alive, chain, ring = _folded(alive, kinds)
            chains.append(chain)
            done.append(ring.select("id", F.lit(False).alias("known"), *[F.lit(None).cast(forest.schema[v].dataType).alias(v) for v in vs]))
            m = alive.count()
        n = m
    for chain in reversed(chains):
        below = reduce(DataFrame.unionByName, done).select(F.col("id").alias("below"), "known", *[F.col(v).alias(f"u_{v}") for v in vs])
        sums = [F.when(F.col("known"), _both(k, F.col(v), F.col(f"u_{v}"))).alias(v) for k, v in zip(kinds, vs)]
        done.append(written(chain.join(below, "below").select("id", "known", *sums)))
    if not [*settled, *done]:
        return forest.select("id", F.lit(True).alias("known"), *vs)
    return reduce(DataFrame.unionByName, [*settled, *done])


def ancestors(nodes: DataFrame, by, node="node", parent="parent") -> DataFrame:
    """All (node, ancestor, distance) with distance 0 to itself, the smallest.

    The result has a row for each node and ancestor; the other operators here
    do without it.  Nodes that stand twice with different parents keep all of
    them.  Of a cycle each node has every other as an ancestor once.
    """
    key = _key_of(by)
    rows = nodes.filter(F.col(node).isNotNull())
    selves = rows.select(key(node).alias("id")).distinct()
    step = rows.filter(F.col(parent).isNotNull()).select(key(node).alias("id"), key(parent).alias("a"), F.lit(1).alias("d")).distinct()
    parts, at, new = [], 1, written(step.join(selves.withColumnRenamed("id", "a"), "a", "left_semi").select("id", "a", "d"))
    # where each node has one parent, a pair is found once, unless on a ring: nodes there come to stand above themselves
    again = bool(new.groupBy("id").count().filter("count > 1").limit(1).count())
    while new.limit(1).count():
        parts.append(new)
        known = reduce(DataFrame.unionByName, parts)
        tips = new.filter(F.col("d") == at).select("id", F.col("a").alias("t"))
        far = known.select(F.col("id").alias("t"), F.col("a"), (F.col("d") + at).alias("d"))
        new, at = tips.join(far, "t").select("id", "a", "d"), at * 2
        new = written(new.groupBy("id", "a").agg(F.min("d").alias("d")).join(known.select("id", "a"), ["id", "a"], "left_anti") if again else new)
        if not again and new.filter("id = a").limit(1).count():
            again = True
            new = written(new.groupBy("id", "a").agg(F.min("d").alias("d")).join(known.select("id", "a"), ["id", "a"], "left_anti"))
    known = reduce(DataFrame.unionByName, parts or [new])
    known = known.filter("id <> a").unionByName(selves.select("id", F.col("id").alias("a"), F.lit(0).alias("d")))
    return _named(known, by, [F.col("a.n").alias("ancestor"), F.col("d").alias("distance")])


def resolve_inherited(nodes: DataFrame, by, values, node="node", parent="parent") -> DataFrame:
    """Each node's values, where null those of the nearest ancestor that has one, and its depth.

    Of rows that repeat a node the smallest value counts.  A node that runs
    into a ring takes what it meets on its way; its depth is null.
    """
    forest = _forest(nodes, by, node, parent, {v: F.min(v) for v in values}).withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0))
    names = [f"v{i}" for i in range(len(values))]
    at_top, in_rings = _climb(forest, dict.fromkeys(names, "nearest") | {"depth": "sum"})
    both = at_top.unionByName(in_rings.withColumn("depth", F.lit(None).cast("int")))
    return _named(both, by, [*[F.col(x).alias(v) for x, v in zip(names, values)], "depth"])


def _of_leaves(forest: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``forest`` with values that leaves have, null elsewhere."""
    inner = forest.filter(F.col("up").isNotNull()).select(F.col("up").alias("id"), F.lit(True).alias("inner")).distinct()
    return forest.join(inner, "id", "left").select(*forest.columns, *[F.when(F.col("inner").isNull(), c).alias(name) for name, c in values.items()])


def roll_up(nodes: DataFrame, by, sums=(), alls=(), mins=(), xors=(), node="node", parent="parent", leaves: bool = False) -> DataFrame:
    """Sums, conjunctions, minima and exclusive ors over each node and its descendants, and how many nodes those are.

    Nulls count for nothing; of rows that repeat a node all count, but it is
    one node.  A node on a ring has no end below it: its values are null.
    ``leaves`` adds n_leaves and first_leaf, as in :func:`leaf_sets`.
    """
    kinds = {c: "sum" for c in sums} | {c: "all" for c in alls} | {c: "min" for c in mins} | {c: "xor" for c in xors}
    forest = _forest(nodes, by, node, parent, {**{c: _AGGREGATES[k](c) for c, k in kinds.items()}, "": F.lit(1).cast("long")})
    names, kinds = [*kinds, "n_nodes"], [*kinds.values(), "sum"]
    if leaves:
        forest = _of_leaves(forest, {f"v{len(names)}": F.lit(1).cast("long"), f"v{len(names) + 1}": F.col("id.n")})
        names, kinds = [*names, "n_leaves", "first_leaf"], [*kinds, "sum", "min"]
    return _named(_totals(forest, kinds), by, [F.col(f"v{i}").alias(c) for i, c in enumerate(names)])


def leaf_members(nodes: DataFrame, by, node="node", parent="parent") -> DataFrame:
    """(node, leaf) for every leaf at or under every node: as many rows as :func:`ancestors` has for leaves."""
    parents = nodes.select(*by, F.col(parent).alias(node)).filter(F.col(node).isNotNull()).distinct()
    leaves = nodes.select(*by, node).join(parents, [*by, node], "left_anti").withColumnRenamed(node, "node")
    return ancestors(nodes, by, node, parent).join(leaves, [*by, "node"], "left_semi").select(*by, F.col("ancestor").alias("node"), F.col("node").alias("leaf"))


def leaf_sets(nodes: DataFrame, by, node="node", parent="parent") -> DataFrame:
    """(node, n_leaves, first_leaf, print_1, print_2): a fingerprint of the set of leaves at or under every node.

    The prints are exclusive ors of two 64-bit hashes of each leaf, so they
    need no order and no list, and two sets of the same size with the same
    prints are taken for equal.
    """
    leaf = F.col("id.n")
    rows = _of_leaves(_forest(nodes, by, node, parent).select("id", "up"), {"v0": F.lit(1).cast("long"), "v1": leaf, "v2": F.xxhash64(leaf), "v3": F.xxhash64(F.lit(1), leaf)})
    total = _totals(rows, ["sum", "min", "xor", "xor"])
    return _named(total, by, [F.col("v0").alias("n_leaves"), F.col("v1").alias("first_leaf"), F.col("v2").alias("print_1"), F.col("v3").alias("print_2")])


def leaf_set_faults(nodes: DataFrame, members: DataFrame, by, node="node", parent="parent", leaf="leaf") -> DataFrame:
    """What is wrong with declared leaves (by, node, leaf) of a tree.

    ``not_the_union``: a node's leaves are not the union of those that its
    children declare; ``no_identity``: a node without children declares none;
    ``not_derived``: a node's leaves are not those that the tree has under it.
    Repeated declarations count once; those of unknown nodes are left out, as
    are nodes on a ring from the last check.
    """
    key = _key_of(by)
    declared = members.filter(F.col(node).isNotNull() & F.col(leaf).isNotNull()).select(key(node).alias("id"), F.col(leaf).alias("leaf")).distinct()
    prints = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("leaf")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "leaf")).alias("h2")]
    own = declared.groupBy("id").agg(*prints)
    forest = written(_forest(nodes, by, node, parent))
    edges = forest.filter(F.col("up").isNotNull()).select("id", "up")
    union = declared.join(edges, "id").select(F.col("up").alias("id"), "leaf").distinct().groupBy("id").agg(*prints)
    inner = edges.select(F.col("up").alias("id"), F.lit(True).alias("inner")).distinct()
    derived = leaf_sets(nodes, by, node, parent)
    derived = derived.select(key("node").alias("id"), F.col("n_leaves").alias("d_n"), F.col("print_1").alias("d_h1"), F.col("print_2").alias("d_h2"))
    wide = forest.select("id").join(inner, "id", "left").join(own, "id", "left").join(union.select("id", *[F.col(c).alias(f"u_{c}") for c in ("n", "h1", "h2")]), "id", "left").join(derived, "id", "left")
    differs = lambda side: reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"{side}_{c}")) for c in ("n", "h1", "h2")])
    faults = F.array(
        F.when(F.col("inner").isNotNull() & differs("u"), "not_the_union"), F.when(F.col("inner").isNull() & F.col("n").isNull(), "no_identity"), F.when(F.col("d_n").isNotNull() & differs("d"), "not_derived")
    )
    return _named(wide.withColumn("fault", F.explode(F.array_compact(faults))), by, ["fault"])


def tree_errors(nodes: DataFrame, by, node="node", parent="parent") -> DataFrame:
    """What is wrong with a tree: repeated nodes, unknown parents, several parents, cycles and nodes that no root reaches.

    A node with several parents follows one of them, as everywhere here.
    """
    rows = nodes.filter(F.col(node).isNotNull())
    per = rows.groupBy(*by, F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(parent).alias("p"), F.count_if(F.col(parent).isNull()).alias("r"))
    out = per.filter(F.col("n") > 1).select(*by, "node", F.when(F.col("p") + F.least("r", F.lit(1)) > 1, "several_parents").otherwise("repeated").alias("error"))
    key = _key_of(by)
    edges = rows.filter(F.col(parent).isNotNull()).select(key(node).alias("id"), key(parent).alias("up"))
    lost = _named(edges.join(rows.select(key(node).alias("up")).distinct(), "up", "left_anti"), by, [F.lit("unknown_parent").alias("error")])
    forest = _forest(nodes, by, node, parent).withColumn("rooted", F.col("up").isNull() & ~F.col("lost"))
    at_top, in_rings = _climb(forest, {"rooted": "last"}, sliced=False)
    adrift = at_top.filter("NOT rooted").select("id").unionByName(in_rings.select("id"))
    ring = in_rings.select(F.col("up").alias("id")).distinct()
    return reduce(DataFrame.unionByName, [out, lost, _named(ring, by, [F.lit("cycle").alias("error")]), _named(adrift, by, [F.lit("unreachable").alias("error")])]).distinct()


def preorder(nodes: DataFrame, by, order, node="node", parent="parent") -> DataFrame:
    """(node, depth, first, last): places 1, 2, ... of a walk depth first, and the last place below each node.

    A node is under another if its place lies in the other's range.  Roots
    and siblings go by ``order`` (a column, smallest first, nulls before all)
    and then by node.  Nodes that no top reaches are left out.
    """
    kin = _forest(nodes, by, node, parent, {"": F.lit(1).cast("long"), "order": F.min(order)})
    kin = written(kin.select("id", F.struct(*[F.col(f"id.b{i}").alias(f"b{i}") for i in range(len(by))], F.coalesce("up.n", F.lit(None)).alias("n")).alias("under"), "up", "v0", "v1"))
    size = _totals(kin.select("id", "up", "v0"), ["sum"]).filter("known").select("id", F.col("v0").alias("size"))
    # running sums among siblings, by ranges, as a node may have a great part of all nodes as children
    lined = ranged_sequence(kin.join(size, "id"), ["under"], ["v1", "id"], "place").withColumn("range", F.floor((F.col("place") - 1) / _SIBLINGS))
    whole = lined.groupBy("under", "range").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("under").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).select("under", "range", "before")
    inside = Window.partitionBy("under", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    lined = lined.join(whole, ["under", "range"]).withColumn("step", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + 1)
    at_top, _ = _climb(lined.select("id", "up", "step", "size", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth")), {"step": "sum", "depth": "sum"})
    out = at_top.join(size, "id")
    return _named(out, by, ["depth", F.col("step").alias("first"), (F.col("step") + F.col("size") - 1).alias("last")])


#: Siblings that one task sums up.
_SIBLINGS = 1 << 20


def sparse_decisions(nodes: DataFrame, decisions: DataFrame, by, default: str = "keep", node="node", parent="parent", most_depth: int | None = 7) -> DataFrame:
    """The result of each leaf when a tree is walked from its roots down.

    ``decisions`` holds (by, node, result, descend).  A decision without
    ``descend`` settles everything below it; one with it hands on to the
    children; a node without a decision stops with ``default``, and so does
    one deeper than ``most_depth``.  The settling node of a leaf is its highest
    ancestor that does not descend.  Leaves that no top reaches are left out.
    """
    key = _key_of(by)(node)
    forest = written(_forest(nodes, by, node, parent).withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)))
    told = decisions.groupBy(key.alias("id")).agg(F.min_by(F.struct("result", F.coalesce("descend", F.lit(False)).alias("descend")), F.col("result")).alias("told"))
    inner = forest.filter(F.col("up").isNotNull()).select(F.col("up").alias("id"), F.lit(True).alias("inner")).distinct()
    deep, _ = _climb(forest, {"depth": "sum"})
    rows = forest.select("id", "up").join(deep.select("id", "depth"), "id").join(told, "id", "left").join(inner, "id", "left")
    too_deep = F.lit(False) if most_depth is None else F.col("depth") > most_depth
    stops = too_deep | ~F.coalesce("told.descend", F.lit(False)) | F.col("inner").isNull()
    stop = F.when(stops, F.struct(F.col("id.n").alias("at"), F.when(too_deep, F.lit(default)).otherwise(F.coalesce("told.result", F.lit(default))).alias("result")))
    walked, _ = _climb(rows.select("id", "up", stop.alias("stop")), {"stop": "topmost"})
    leaves = walked.join(inner, "id", "left_anti")
    return _named(leaves, by, [F.col("stop.at").alias("settled_at"), F.col("stop.result").alias("result")]).withColumnRenamed("node", "leaf")


def budgeted_walk(nodes: DataFrame, decisions: DataFrame, by, order, max_depth: int = 7, max_calls: int = 512, node="node", parent="parent") -> DataFrame:
    """One row a leaf: what a walk depth first settles it with when each node costs a call and calls are few.

    ``decisions`` holds (by, node, result, status, error, inspect, inline):
    checked decisions, ``result`` one of keep, fill, delete and split,
    ``status`` accepted or another, ``error`` set where the call failed,
    ``inspect`` the children to visit, ``inline`` an array of (node, result,
    status) for children settled at once.  A node without one is under manual
    review and kept.

    Roots are visited, then the children that a split inspects, in ``order``.
    A visit deeper than ``max_depth`` or beyond ``max_calls`` in its ``by``, or
    whose call fails, keeps all below it as a fallback.  Children that a split
    neither settles nor inspects are kept under it.  Rows (by, leaf, action,
    resolution, status, reason, settled_at, inherited_from).  Leaves that no
    top reaches are left out; a repeated decision counts once, by the smallest
    result.
    """
    placed = preorder(nodes, by, order, node, parent)
    key = _key_of(by)
    told = decisions.groupBy(key(node).alias("id")).agg(F.min_by(F.struct("result", "status", "error", "inspect", "inline"), F.struct("result", "status", "error")).alias("told"))
    forest = _forest(nodes, by, node, parent)
    rows = written(forest.select("id", "up").join(placed.select(key("node").alias("id"), "depth", "first"), "id").join(told, "id", "left"))
    # what the parent says of each node
    splits = (F.col("told.result") == "split") & (F.col("told.status") == "accepted") & F.col("told.error").isNull()
    says = rows.filter(splits).select(F.col("id").alias("up"), F.col("told.inspect").alias("inspect"), F.col("told.inline").alias("inline"))
    inner = rows.filter(F.col("up").isNotNull()).select(F.col("up").alias("id"), F.lit(True).alias("inner")).distinct()
    rows = rows.join(says, "up", "left").join(inner, "id", "left")
    inline = F.get(F.filter("inline", lambda x: x["node"] == F.col("id.n")), F.lit(0))
    rows = rows.withColumns({"here": inline, "asked": F.coalesce(F.array_contains("inspect", F.col("id.n")), F.lit(False)), "splits": F.coalesce(splits, F.lit(False))})
    rows = written(rows.withColumn("visit", F.col("up").isNull() | (F.col("here").isNull() & F.col("asked"))).drop("inspect", "inline"))
    # visits that are made if calls are free, and the first of them in order
    wanted, _ = _climb(rows, {"visit": "all"})
    wanted = wanted.filter("visit").join(rows.select("id", "depth", "first"), "id")
    groups = [F.col(f"id.b{i}") for i in range(len(by))]
    called = wanted.filter(F.col("depth") <= max_depth).withColumn("call", F.row_number().over(Window.partitionBy(*groups).orderBy("first"))).filter(F.col("call") <= max_calls)
    called = written(called.select("id", "call"))
    rows = rows.join(called, "id", "left").join(called.select(F.col("id").alias("up"), F.lit(True).alias("above")), "up", "left")
    leaf, at, told_ok = F.col("inner").isNull(), F.col("id.n"), F.col("told.status") == "accepted"
    outcome = lambda action, resolution, status, reason, origin: F.struct(
        action.alias("action"), resolution.alias("resolution"), status.alias("status"), reason.alias("reason"), at.alias("settled_at"), origin.alias("inherited_from"))
    none, kept = F.lit(None).cast("string"), F.lit("keep")
    nobody = F.lit(None).cast(nodes.schema[node].dataType)
    settled = lambda accepted, result, status: outcome(
        F.when(accepted, result).otherwise("keep"), F.when(~accepted, "fallback").when(leaf, "direct").otherwise("inherited"), F.coalesce(status, F.lit("manual_review")), none, F.when(accepted & ~leaf, at))
    refused = F.when(F.col("depth") > max_depth, F.lit(f"maximum traversal depth {max_depth} reached")).otherwise(F.lit(f"maximum decision call budget {max_calls} reached"))
    stop = (
        F.when(F.col("up").isNotNull() & F.col("above").isNull(), None)
        .when(F.col("here").isNotNull(), settled(F.coalesce(F.col("here.status") == "accepted", F.lit(False)), F.col("here.result"), F.col("here.status")))
        .when(F.col("visit") & F.col("call").isNull(), outcome(kept, F.lit("fallback"), F.lit("fallback"), refused, nobody))
        .when(F.col("visit") & F.col("told.error").isNotNull(), outcome(kept, F.lit("fallback"), F.lit("failed"), F.col("told.error"), nobody))
        .when(F.col("visit") & F.col("splits") & ~leaf, None)
        .when(F.col("visit"), settled(F.coalesce(told_ok & (F.col("told.result") != "split"), F.lit(False)), F.col("told.result"), F.when(F.col("told.result") == "split", "manual_review").otherwise(F.col("told.status"))))
        .otherwise(outcome(kept, F.lit("inherited"), F.lit("accepted"), none, F.col("up.n")))
    )
    walked, _ = _climb(rows.select("id", "up", stop.alias("stop")), {"stop": "topmost"})
    return _named(walked.join(inner, "id", "left_anti"), by, ["stop.*"]).withColumnRenamed("node", "leaf")


def siblings(nodes: DataFrame, by, order, node="node", parent="parent") -> DataFrame:
    """Each node with the one before and after it under the same parent."""
    w = Window.partitionBy(*by, parent).orderBy(*order)
    return nodes.withColumns({"previous": F.lag(node).over(w), "following": F.lead(node).over(w)})
