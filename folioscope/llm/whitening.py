"""Whitening of embeddings with MLlib's distributed block matrices.

Rows get a dense index and are centred; an ``IndexedRowMatrix`` of them becomes
a ``BlockMatrix``.  Its transpose times itself is the scatter matrix, which is
as wide as a vector and is solved on the driver; the block matrix times the
whitening matrix are the projections.  Vectors go between data frames and
matrices as MLlib vectors inside the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import scratch_path

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Scaled entries are held within this, where doubles are whole numbers.
LARGEST = 1 << 53
#: Rows of a block: so many that there are about BLOCKS of them, within these bounds and BLOCK_BYTES.
LEAST_ROWS, BLOCKS = 1024, 50_000
BLOCK_BYTES = 32 << 20
#: Eigenvalues below this share of the largest, a component, are none.
NOTHING = 1e-13


def _integers(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(vec_id, x) of the vectors that are whole and finite."""
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & (F.size(vec) > 0)
    scaled = F.transform(vec, lambda c: (F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT).cast("long"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("vec_id"), scaled.alias("x"))


def _indexed(rows: DataFrame, path: str) -> DataFrame:
    """Rows with a dense ``i`` from 0.  Place and part are written down, so the numbers are the same however often they are read."""
    spark = rows.sparkSession
    placed = rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    counts = sorted(placed.groupBy("part").agg((F.max("place") + 1).alias("n")).collect())  # one a part
    starts = np.cumsum([0, *(r["n"] for r in counts)]).tolist()
    begun = spark.createDataFrame([(r["part"], start) for r, start in zip(counts, starts)], "part int, start long")
    return placed.join(begun, "part").select((F.col("start") + F.col("place")).alias("i"), *rows.columns)


def block_matrix(rows: DataFrame, index: str, values: str, height: int, width: int) -> BlockMatrix:
    """The block matrix of rows (index, array of doubles), in blocks of ``height`` rows."""
    vectors = rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(height, width)


def rows_of(matrix: BlockMatrix, index: str, values: str) -> DataFrame:
    """Rows (index, array of doubles) of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias(index), vector_to_array(F.col("vector")).alias(values))


def scatter_of(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose times the matrix, as a local array; blocks are dealt to ``splits`` sums before the last one."""
    wrapper = matrix.transpose()._java_matrix_wrapper
    product = BlockMatrix(wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def whiten(vectors: DataFrame, vec_id="vec_id", vec="embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact).

    An entry c counts as x = floor(1024 c) + 100000.  Components are the unit
    eigenvectors of x's covariance (divisor n) from the largest eigenvalue
    down, each turned so that its largest entry by size is positive.

    Rows whose vector is null, empty or holds null or non-finite entries are
    dropped, and those of another length than most rows have (of lengths
    equally common the longest).  Repeated rows, repeated ids and null ids are
    rows like others, so ties need no rule.  Vectors shorter than
    ``components`` have as many components as entries.  A component without
    variance has whitened and explained 0 and is left out of
    ``identity_error``.  1024 c is held within 2^53 either way.  ``deviation``
    is null where it does not fit a long; ``deviation_exact`` holds it up to 38
    digits.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    whole = _integers(vectors, vec_id, vec)
    rows = _indexed(whole, f"{path}/rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).collect()  # one a length
    out = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    if not lengths:
        kind = whole.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    if len(lengths) > 1:
        rows = _indexed(rows.filter(F.size("x") == lengths[0]["d"]).select("vec_id", "x"), f"{path}/even")
    d, n = lengths[0]["d"], lengths[0]["n"]
    sums = {r["pos"]: int(r["s"]) for r in rows.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect()}  # one a dimension
    total = F.array(*(F.lit(sums[i]).cast("decimal(38,0)") for i in range(d)))
    # n x - S is a whole number, so that a centred entry is rounded once, by the division
    apart = F.zip_with("x", total, lambda c, s: c.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s)
    height = max(LEAST_ROWS, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * d)))
    blocks = -(-n // height)
    centred = rows.select("i", F.transform(apart, lambda c: c.cast("double") / float(n)).alias("z"))
    matrix = block_matrix(centred, "i", "z", height, d)
    matrix.cache()  # read by the scatter and by the projection; what is lost is made anew from the written rows
    covariance = scatter_of(matrix, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    has = values[order] > NOTHING * max(float(values.max()), 0) if values.max() > 0 else np.zeros(len(order), bool)
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    whitening = np.where(has, axes / np.sqrt(np.where(has, values[order], 1)), 0)
    k = len(order)
    projector = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, whitening.ravel(order="F")))], 1), d, k)
    rows_of(matrix.multiply(projector), "i", "w").write.parquet(f"{path}/whitened")
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    projected = spark.read.parquet(f"{path}/whitened")
    error = 0.0
    if has.any():
        live = np.flatnonzero(has).tolist()
        means = projected.agg(*(F.avg(F.col("w")[j]) for j in live)).first()
        away = [F.col("w")[j] - float(m) for j, m in zip(live, means)]
        pairs = [(a, b) for a in range(len(live)) for b in range(a + 1)]
        products = projected.agg(*(F.sum(away[a] * away[b]) for a, b in pairs)).first()
        error = max(abs(p / n - (a == b)) for (a, b), p in zip(pairs, products))
    squared = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda s, c: F.try_add(s, F.try_multiply(c.cast("decimal(19,0)"), c.cast("decimal(19,0)"))).cast("decimal(38,0)"))
    shares = F.array(*(F.lit(float(v / trace) if h else 0.0) for v, h in zip(values[order], has)))
    wide = rows.select("i", "vec_id", squared.alias("deviation_exact")).join(projected, "i")
    long = wide.select("vec_id", "deviation_exact", F.posexplode("w").alias("pos", "whitened"))
    return long.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened", shares[F.col("pos")].alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact",
    ).select(*out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every embedding; see :func:`whiten`."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
