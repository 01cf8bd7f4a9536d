"""Approximate nearest neighbours by balanced posting lists.

Inner products are brought to distances by one more component: a vector x is
held as (x / M, sqrt(1 - |x|^2 / M^2)), M the largest norm, and a query as
(q / |q|, 0), so that all are unit vectors and the largest inner product is the
smallest distance.  Centroids are fitted to a bounded sample: it is halved again
and again into equal parts, and the centres then move a few times while long
lists are held back.  Every vector is put into its nearest list and, at a
boundary, into the others that are about as near.  Centroids are found by a walk
over a graph of near centroids in memory.  A query takes the lists within a
ratio of the nearest one's distance, and all of their vectors are compared
exactly.

Lists that follow one another in the tree of halvings share a cell of bounded
size; a longer list has several cells, and a cell with many queries several
rows of them, so no task holds more than a block of either.  Vectors that are
equal are one vector with its smallest ids, of which no answer needs more than
one more than it lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import scratch_path

NEAREST = 20
#: Vectors of the sample that centroids are fitted to, at most (about; they are chosen by hash), and of it a list.
FIT_ROWS = 1 << 18
LIST_ROWS = 256
FEW_ROWS = 128
MOST_LISTS = 1 << 15
#: Lists that a vector stands in, at most, and how much farther than the nearest they may be.
COPIES = 4
COPY_RATIO = 1.05
#: A query takes the lists that are so many times as far as the nearest.
PROBE_RATIO = 1.3
#: Neighbours of a centroid in the graph, places where a walk begins, and how far beyond the nearest it goes on at least.
DEGREE = 24
ENTRIES = 16
WALK_RATIO = 1.15
#: Vectors and queries of a cell.
CELL_ROWS = 8_192
CELL_QUERIES = 16_384
_BATCH = 256
#: Place of the number of a cell's row of queries in its key.
_ROW_SHIFT = 43


# -- the lists -----------------------------------------------------------------


def unit(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, all of length one; ``most`` is the largest norm."""
    x = vectors.astype(np.float64) / most
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]).astype(np.float32)


def unit_queries(vectors: np.ndarray) -> np.ndarray:
    """Queries of length one with nothing in the last component."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.column_stack([x, np.zeros(len(x))]).astype(np.float32)


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def halved(x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Rows of ``x`` in ``lists`` parts of about the same size, neighbours of the tree side by side."""
    out, stack = [], [(np.arange(len(x)), lists)]
    while stack:
        rows, n = stack.pop()
        if n == 1:
            out.append(rows)
            continue
        own, cut = x[rows], len(rows) * (n // 2) // n
        spread = own - own.mean(axis=0)
        across = spread[np.argmax((spread * spread).sum(axis=1))]
        for _ in range(6):  # the direction in which the two halves are farthest apart
            order = np.argsort(own @ across, kind="stable")
            across = own[order[cut:]].mean(axis=0) - own[order[:cut]].mean(axis=0)
        order = np.argsort(own @ across, kind="stable")
        stack += [(rows[order[cut:]], n - n // 2), (rows[order[:cut]], n // 2)]
    return out


def fit_lists(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of the lists of a sample of unit vectors, in the order of the tree."""
    centres = _normed(np.array([x[rows].mean(axis=0) for rows in halved(x, lists)], np.float32))
    held, share = np.zeros(lists, np.float32), len(x) / lists
    for _ in range(rounds if lists > 1 else 0):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - held, axis=1) for i in range(0, len(x), 4096)])
        held += 0.02 * np.clip(np.bincount(own, minlength=lists) / share - 1, -1, 2).astype(np.float32)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 0
        centres[full] = _normed(sums[full])
    return centres


def graph_of(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each centroid, by row: near ones not hidden behind a nearer one, and the next in the tree."""
    n = len(centres)
    wide = min(2 * degree, n - 1)
    out = np.empty((n, degree + 2), np.int32)
    out[:, 0], out[:, 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n
    for i in range(n):
        near = centres @ centres[i]
        near[i] = -2
        order = np.argpartition(-near, wide - 1)[:wide] if wide else np.array([i])
        order = order[np.argsort(-near[order], kind="stable")]
        between = centres[order] @ centres[order].T
        kept: list[int] = []
        for k in range(len(order)):
            if len(kept) == degree:
                break
            if all(between[k, j] <= near[order[k]] for j in kept):
                kept.append(k)
        rest = [k for k in range(len(order)) if k not in set(kept)]
        chosen = order[(kept + rest)[:degree]]
        out[i, 2:] = np.resize(chosen, degree)
    return out


class Lists:
    """Centroids and their graph; both are bounded by MOST_LISTS."""

    def __init__(self, centres: np.ndarray, most: float):
        self.centres, self.most, self.graph = centres, most, graph_of(centres)

    def near(self, x: np.ndarray, ratio: float, copies: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists within ``ratio`` of the nearest one's distance, the ``copies`` nearest of a row at most."""
        found = [self._walk(x[i : i + _BATCH], ratio, copies) for i in range(0, len(x), _BATCH)]
        rows = [r + i * _BATCH for i, (r, _) in enumerate(found)]
        return (np.concatenate(rows), np.concatenate([c for _, c in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _walk(self, x: np.ndarray, ratio: float, copies: int | None) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(x), len(self.centres)
        far = np.full((b, n), np.inf, np.float32)
        done = np.zeros((b, n), bool)
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
        far[:, entries] = np.sqrt(np.maximum(0, 2 - 2 * (x @ self.centres[entries].T)))
        slack = max(ratio, WALK_RATIO)
        while True:
            best = far.min(axis=1, keepdims=True)
            row, node = np.nonzero((far <= np.maximum(slack * best, best + 1e-6)) & ~done)
            if not len(row):
                break
            done[row, node] = True
            flat = np.unique((row[:, None] * n + self.graph[node]).ravel())
            flat = flat[np.isinf(far.ravel()[flat])]
            row, node = flat // n, flat % n
            for i in range(0, len(flat), 1 << 15):
                r, c = row[i : i + (1 << 15)], node[i : i + (1 << 15)]
                far[r, c] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[r], self.centres[c])))
        best = far.min(axis=1, keepdims=True)
        row, node = np.nonzero(far <= np.maximum(ratio * best, best + 1e-6))
        if copies is not None:
            order = np.lexsort((node, far[row, node], row))
            row, node = row[order], node[order]
            place = _places(row)
            row, node = row[place < copies], node[place < copies]
        return row, node

    def enough(self, x: np.ndarray, ratio: float, least: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`near`; rows whose lists hold fewer than ``least`` of the ``held`` vectors take the nearest lists that do."""
        row, node = self.near(x, ratio)
        short = np.flatnonzero(np.bincount(row, held[node], len(x)) < min(least, held.sum()))
        more = [np.zeros((2, 0), np.int64)]
        for i in short.tolist():
            order = np.argsort(-(self.centres @ x[i]), kind="stable")
            order = order[: int(np.searchsorted(np.cumsum(held[order]), min(least, held.sum()))) + 1]
            more.append(np.array([np.full(len(order), i), order]))
        more = np.concatenate(more, axis=1)
        row, node = np.append(row, more[0]), np.append(node, more[1])
        both = np.unique(row.astype(np.int64) * len(self.centres) + node)
        return both // len(self.centres), both % len(self.centres)


# -- rows ------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _listed(batches, lists, columns: list[str], held: np.ndarray | None, least: int):
    """Rows with the array of their lists, the nearest first; with ``held`` they are queries."""
    own = lists.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vec"))
        row, node = own.near(unit(x, own.most), COPY_RATIO, COPIES) if held is None else own.enough(unit_queries(x), PROBE_RATIO, least, held)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), pa.array(node.astype(np.int32)))], [*columns, "lists"])


def _places(group: np.ndarray) -> np.ndarray:
    """Each row's place in its group; rows of a group stand together."""
    new = np.append(True, group[1:] != group[:-1])[: len(group)]
    starts = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _compared(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """A cell's best ``k`` ids of each query among the lists that it asks for.

    Vectors and queries are compared a block at a time; what could be among the
    best is then summed again in one order, so that a score does not depend on
    the cell.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(vectors) and len(queries):
        ids, asked = vectors["ids"].combine_chunks(), queries["lists"].combine_chunks()
        id_sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        id_starts, ids = np.cumsum(id_sizes) - id_sizes, ids.flatten().to_numpy()
        # a vector may stand in several lists of the cell; its first id is its own
        _, one, vector = np.unique(ids[id_starts], return_index=True, return_inverse=True)
        names, own = np.unique(vectors["list"].to_numpy(), return_inverse=True)
        stands = np.zeros((len(names), len(one)), np.float32)
        stands[own, vector] = 1
        id_sizes, id_starts = id_sizes[one], id_starts[one]
        v, q = (_matrix(x.combine_chunks()).astype(np.float64) for x in (vectors["vec"].take(pa.array(one)), queries["vec"]))
        # which of the cell's lists each query asks for
        wants = np.zeros((len(q), len(names)), np.float32)
        asker, wanted = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy(zero_copy_only=False)), asked.flatten().to_numpy()
        there = np.isin(wanted, names)
        wants[asker[there], np.searchsorted(names, wanted[there])] = 1
        order = np.lexsort(wants.T)  # alike ones side by side
        for i in range(0, len(order), _BATCH):
            some = order[i : i + _BATCH]
            asks = wants[some] @ stands > 0
            rows = np.flatnonzero(asks.any(axis=0))
            if not len(rows):
                continue
            scores = q[some] @ v[rows].T
            scores[~asks[:, rows]] = -np.inf
            keep = min(k, len(rows))
            least = np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep]
            least = least - 1e-9 * np.where(np.isinf(scores), 0, np.abs(scores)).max(axis=1)
            ask, at = np.nonzero((scores >= least[:, None]) & ~np.isinf(scores))
            exact = np.concatenate([np.zeros(0), *((v[rows[at[j : j + 65_536]]] * q[some[ask[j : j + 65_536]]]).sum(axis=1) for j in range(0, len(at), 65_536))])
            sizes = id_sizes[rows[at]]
            ask, exact, every = np.repeat(some[ask], sizes), np.repeat(exact, sizes), ids[_ranges(id_starts[rows[at]], sizes)]
            best = np.lexsort((every, -exact, ask))
            ask, exact, every = ask[best], exact[best], every[best]
            top = _places(ask) < k
            found.append((ask[top], every[top], exact[top]))
    ask, every, exact = (np.concatenate(x) for x in zip(*found))
    edges = np.flatnonzero(np.append(True, ask[1:] != ask[:-1])) if len(ask) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(edges, len(ask)).astype(np.int32))
    keys = queries.select(["h1", "h2"]).take(pa.array(ask[edges]))
    return pa.table({"h1": keys["h1"], "h2": keys["h2"], "ids": pa.ListArray.from_arrays(offsets, pa.array(every)), "scores": pa.ListArray.from_arrays(offsets, pa.array(exact))})


def valid(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, one an id; components stay floats or become doubles."""
    kind = vectors.schema[vec].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("vec"))
    sound = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = NEAREST, vec_id="vec_id", vec="embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest that were found for each query, nearest first, ties to the smaller id.

    ``queries`` is an SQL condition on vec_id.  Nearness is the inner product, summed
    in double precision over the original components.  Rows whose id is null,
    or whose vector is null, empty, zero or holds null or non-finite
    components, take no part; nor do vectors of another length than most have
    (of lengths equally common the longest).  Of rows that repeat an id, that
    with the smallest vector counts, so repeated rows count once.  Fewer than
    ``k`` candidates are all returned; where the lists within the ratio hold too few, a
    query is given more lists until they hold enough.  An empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "nearest")
    valid(vectors, vec_id, vec).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("vec") == lengths[0]["n"]).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    # of equal vectors one, with the ids that an answer can need
    near = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    few.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")).write.parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    count, most = held.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    share = min(1.0, FIT_ROWS / count)
    sample = held.filter(F.lit(share >= 1) | (F.pmod("h1", F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy("h1", "h2").select("vec").toArrow()
    x = unit(_matrix(sample["vec"].combine_chunks()), most)
    lists = Lists(fit_lists(x, max(1, min(MOST_LISTS, len(x) // (LIST_ROWS if len(x) > 64 * LIST_ROWS else FEW_ROWS)))), most)
    index = spark.sparkContext.broadcast(lists)

    def listed(df: DataFrame, columns: list[str], held: np.ndarray | None = None) -> DataFrame:
        schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("lists", T.ArrayType(T.IntegerType()))])
        return df.select(*columns).mapInArrow(lambda batches: _listed(batches, index, columns, held, k + 1), schema)

    def counted(df: DataFrame, name: Column) -> np.ndarray:  # one row a list, MOST_LISTS at most
        out = np.zeros(len(lists.centres), np.int64)
        for r in df.select(name.alias("list")).groupBy("list").count().collect():
            out[r["list"]] = r["count"]
        return out

    listed(held, ["h1", "h2", "vec", "ids"]).write.parquet(f"{path}/listed")
    held = spark.read.parquet(f"{path}/listed")
    asked = rows.filter(queries).groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    listed(asked, ["h1", "h2", "vec"], counted(held, F.col("lists")[0])).write.parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")

    # cells: lists side by side up to CELL_ROWS, or parts of one long list
    n, long, many = len(lists.centres), counted(held, F.explode("lists")), counted(asked, F.explode("lists"))
    first, parts, width, at, filled = [], [], {}, -1, CELL_ROWS
    for c in range(n):
        if filled + long[c] > CELL_ROWS:
            at, filled = (at + parts[-1] if parts else 0), 0
        first.append(at)
        parts.append(max(1, -(-int(long[c]) // CELL_ROWS)))
        filled += int(long[c]) if parts[-1] == 1 else CELL_ROWS
        width[at] = width.get(at, 0) + int(many[c])
    rows_of = [max(1, -(-width[a] // CELL_QUERIES)) for a in first]
    places = spark.createDataFrame(pa.table({"list": np.arange(n, dtype=np.int32), "first": np.array(first, np.int64), "parts": np.array(parts, np.int64), "many": np.array(rows_of, np.int64)}))
    cell = (F.col("first") + F.col("part") + F.col("row") * F.lit(1 << _ROW_SHIFT)).alias("cell")
    dealt = held.withColumn("list", F.explode("lists")).join(F.broadcast(places), "list").withColumn("part", F.pmod("h2", "parts"))
    dealt = dealt.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).select(cell, "list", "vec", "ids")
    taken = asked.withColumn("list", F.explode("lists")).join(F.broadcast(places), "list").withColumn("row", F.pmod("h2", "many"))
    taken = taken.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(cell, "h1", "h2", "vec", "list")
    taken = taken.groupBy("cell", "h1", "h2").agg(F.first("vec").alias("vec"), F.collect_set("list").alias("lists"))
    best = dealt.groupBy("cell").cogroup(taken.groupBy("cell")).applyInArrow(lambda v, q: _compared(v, q, k + 1), "h1 long, h2 long, ids array<long>, scores array<double>")
    best = best.select("h1", "h2", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("h1", "h2", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    # a vector comes from each of its lists with one score, so its rows have one rank
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1)
    top = top.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("n", "vec_id", "score"))).alias("top"))
    asking = rows.filter(queries).select("vec_id", "h1", "h2").withColumnRenamed("vec_id", "query_id")
    found = asking.join(top, ["h1", "h2"]).select("query_id", F.posexplode(F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "t"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20; see :func:`search`."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
