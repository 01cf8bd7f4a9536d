"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) is a logistic function of threshold_j - w.x; the thresholds are
ordered and share the weights w.  The features of a text are the logarithms of
the counts of its words and beginnings of words, of all that stand in
LEAST_TEXTS sample texts; the ridge penalty shrinks those that say little.
What comes out is the expected grade (severity) and the probability of any
grade above 0.

Labels say toxic or not.  Severity is graded within the toxic ones by how many
of the words that go with that label they hold, in thirds: grades 0 to 3.  Which
words do is told by a likelihood ratio test on the other half of the sample, so
that no text is graded by what its own label says.  Grades given as such are
taken as they are.  The model is fitted on a bounded sample of labelled rows,
SAMPLE at most, half of them toxic where there are so many; weights bring the
sample back to the labels' proportions.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import byte_rows, free_name, scratch_path, slices
from folioscope.llm.licenses import words_of

SAMPLE = 20_000
#: Bytes of the sample's texts, about: of longer ones fewer rows are taken, by hash.
SAMPLE_BYTES = 64 << 20
#: Characters of the beginnings of longer words that can be features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Texts that hold a word or beginning that is a feature, at least.
LEAST_TEXTS = 5
#: How far from chance (signed root of the likelihood ratio) a feature of one half is that grades the toxic texts of the other.
LEAST_Z = 4.0
#: Entries that are added up at once, so that they stay in the cache, and threads that do so.
RUN = 1 << 18
THREADS = 4
STEPS = 200
#: What a step must still gain, as a share of the loss.
LEAST_GAIN = 1e-6
#: Words whose features a worker remembers, and counts that a task gathers before it sends them on.
MEMORY = 500_000
RIDGE = 2e-5
FLAG = 0.5


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features_of(word: bytes) -> list[str]:
    """A word, and its beginnings, marked by a hyphen."""
    text = word.decode(errors="replace")
    return [text, *(text[:n] + "-" for n in BEGINNINGS if len(text) > n)]


class Model:
    """Features with weights, and ordered thresholds."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self.memory: dict[bytes, list[int]] = {}

    def bag(self, text: bytes) -> tuple[list[int], list[int]]:
        """Features and counts of a text."""
        memory, counts = self.memory, defaultdict(int)
        if len(memory) > MEMORY:
            memory.clear()
        for word, n in Counter(words_of(text)).items():
            own = memory.get(word)
            if own is None:
                own = memory[word] = [self.features[f] for f in features_of(word) if f in self.features]
            for f in own:
                counts[f] += n
        return list(counts), list(counts.values())

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of the grades by score w.x."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(below, axis=1, prepend=0.0, append=1.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            features, counts = self.bag(text)
            if features:
                out[i] = self.weights[features] @ np.log1p(counts)
        return out


def _adder(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int, pool: ThreadPoolExecutor):
    """x to the sums of x[of] * values by ``to``, one for each of ``size`` places."""
    to, of, values = to.astype(np.int32, copy=False), of.astype(np.int32, copy=False), values.astype(np.float32, copy=False)
    cuts = range(0, len(to), RUN)
    ends = np.cumsum(sum((np.bincount(to[a : a + RUN], minlength=size) for a in cuts), np.zeros(size, np.int64)))
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    if np.any(to[1:] < to[:-1]):
        # dealt out run by run, so that no sort of all entries is held
        by, amounts, free = np.empty_like(of), np.empty_like(values), begins.copy()
        for a in cuts:
            order = np.argsort(to[a : a + RUN], kind="stable")
            own = to[a : a + RUN][order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sizes = np.diff(starts, append=len(own))
            at = free[own] + np.arange(len(own)) - np.repeat(starts, sizes)
            by[at], amounts[at] = of[a : a + RUN][order], values[a : a + RUN][order]
            free[own[starts]] += sizes
        of, values = by, amounts
    runs = []
    for a in cuts:
        places = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(begins, min(a + RUN, len(to))))
        places = places[ends[places] > begins[places]]
        runs.append((of[a : a + RUN], values[a : a + RUN], np.maximum(begins[places] - a, 0), places))

    def add(x):
        out = np.zeros(size)
        for run, sums in zip(runs, pool.map(lambda r: np.add.reduceat(x[r[0]] * r[1], r[2]), runs)):
            out[run[3]] += sums
        return out

    return add


def likelihood_root(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Signed roots of the likelihood ratios for counts of texts by label, above 0 where the toxic hold a feature more often."""
    share = (toxic + clean) / max(n_toxic + n_clean, 1)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = sum(part(c, n * share) + part(n - c, n * (1 - share)) for c, n in ((toxic, n_toxic), (clean, n_clean)))
    return np.sign(toxic * n_clean - clean * n_toxic) * np.sqrt(np.maximum(2 * ratio, 0))


def minimised(f, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """The least of a smooth function that gives value and gradient, by limited-memory quasi-Newton steps."""
    value, gradient = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, parts = gradient.copy(), []
        for s, y, r in reversed(past):
            parts.append(r * (s @ way))
            way -= parts[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.abs(gradient).max(), 1e-12)
        for (s, y, r), part in zip(past, reversed(parts)):
            way += s * (part - r * (y @ way))
        slope, step = gradient @ way, 1.0
        while True:
            there = x - step * way
            low, steep = f(there)
            if low <= value - 1e-4 * step * slope or step < 1e-9:
                break
            step /= 2
        gain = value - low
        if gain <= 0:
            break
        s, y = there - x, steep - gradient
        if s @ y > 1e-14:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, gradient = there, low, steep
        if gain < LEAST_GAIN * abs(value):
            break
    return x


def ordinal_loss(rows, features, values, grades, sample_weight, width: int, pool: ThreadPoolExecutor):
    """The function to be least: minus the mean log likelihood plus the ridge, with its gradient.

    Its argument holds the weights, the first threshold, and the logarithms of the gaps between thresholds.
    """
    top, scale = int(grades.max(initial=0)), sample_weight / sample_weight.sum()
    scores, slopes = _adder(rows, features, values, len(grades), pool), _adder(features, rows, values, width, pool)

    def loss(theta):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = scores(w)
        full = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = _sigmoid(full[grades + 1] - z), _sigmoid(full[grades] - z)
        p = np.maximum(high - low, 1e-12)
        up, down = scale * high * (1 - high) / p, scale * low * (1 - low) / p
        dcut = np.bincount(grades, -up, top + 1)[:top] + np.bincount(grades, down, top + 1)[1:]
        tail = np.cumsum(dcut[::-1])[::-1]
        return -scale @ np.log(p) + RIDGE / 2 * (w @ w), np.concatenate([slopes(up - down) + RIDGE * w, tail[:1], tail[1:] * gaps])

    return loss


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, sample_weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, from entries (row, feature, value)."""
    top = int(grades.max(initial=0))
    if not top:
        return np.zeros(width), np.zeros(0)
    share = np.array([sample_weight[grades <= j].sum() for j in range(top)]) / max(sample_weight.sum(), 1e-9)
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    theta = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    with ThreadPoolExecutor(THREADS) as pool:
        theta = minimised(ordinal_loss(rows, features, values, grades, sample_weight, width, pool), theta, STEPS)
    return theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1 :]))])


#: Columns of the texts that hold a feature, by half of the sample and label.
_HELD = ("clean_0", "toxic_0", "clean_1", "toxic_1")


def _word_counts(batches):
    """(grade, half, text) to a feature's clean and toxic texts in both halves, of some texts of a task at a time."""
    held = [Counter() for _ in _HELD]

    def flush():
        names = list(set().union(*held))
        columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in held)]
        for c in held:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", *_HELD])

    for batch in batches:
        for part in slices(batch, "text"):
            for grade, half, text in zip(part.column("grade").to_pylist(), part.column("half").to_pylist(), byte_rows(part.column("text"))):
                held[2 * half + (grade > 0)].update({f for word in set(words_of(text)) for f in features_of(word)})
                if sum(map(len, held)) > MEMORY:
                    yield flush()
    yield flush()


def _pack(features: list[int], counts: list[int]) -> bytes:
    """A bag as bytes: gaps between features in order, then their counts, the first bytes of all together."""
    bag = np.array([features, counts], "<i4")
    bag = np.ascontiguousarray(bag[:, np.argsort(bag[0])])
    bag[0] = np.diff(bag[0], prepend=0)
    return zlib.compress(np.ascontiguousarray(bag.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and counts from bytes of :func:`_pack`."""
    bag = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").reshape(2, -1)
    return np.cumsum(bag[0], dtype=np.int32), bag[1]


def _bags(batches, shared):
    for batch in batches:
        for part in slices(batch, "text"):
            bags = [shared.value.bag(x) for x in byte_rows(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("half"), pa.array([len(f) for f, _ in bags], pa.int32()), pa.array([_pack(*b) for b in bags], pa.binary())], ["grade", "half", "n", "bag"])


def labelled_sample(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", grade="toxic", sample: int = SAMPLE) -> tuple[DataFrame, dict[bool, float]]:
    """(grade, half, text) of ``sample`` distinct rows and about SAMPLE_BYTES at most, kept in the shared folder, and what a clean and a toxic row weigh.

    Labels that are the same in id and grade count once, and so do documents that
    are the same in id and text; a document with two grades counts with both.
    Null labels, and labels of documents that are not there, are left out.  To
    the driver come ids and hashes of the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("label_id"), F.col(grade).cast("int").alias("grade")).filter("grade IS NOT NULL AND label_id IS NOT NULL").distinct()
    bad = F.col("grade") > 0
    sizes = {r["bad"]: r["n"] for r in known.groupBy(bad.alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    take = {b: min(n, max(sample // 2, sample - sizes.get(not b, 0))) for b, n in sizes.items()}
    picks = [known.filter(bad == F.lit(b)).orderBy(F.xxhash64(F.lit(23), "label_id"), "label_id", "grade").limit(n) for b, n in sorted(take.items())]
    chosen = spark.createDataFrame([tuple(r) for p in picks for r in p.collect()], known.schema)
    rows = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "label_id")
    rows = rows.withColumn("h", F.xxhash64(F.lit(29), "label_id", "grade", "text")).dropDuplicates(["label_id", "grade", "h"])
    path = scratch_path(spark, "toxicity-sample")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    held = rows.groupBy(bad.alias("bad")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.min("h").alias("first")).collect()
    n, size = {r["bad"]: r["n"] for r in held}, sum(r["bytes"] for r in held)
    if size > SAMPLE_BYTES:  # long texts: fewer of them, but one of each at least
        last = int(SAMPLE_BYTES / size * 2.0**64) - (1 << 63)
        rows = rows.filter((F.col("h") <= last) | F.col("h").isin([r["first"] for r in held]))
        n = {r["bad"]: r["n"] for r in rows.groupBy(bad.alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for b in n:
        if n[b] > take[b]:  # ids that stand with several texts
            last = rows.filter(bad == F.lit(b)).select("h").orderBy("h").limit(take[b]).agg(F.max("h")).first()[0]
            rows, n[b] = rows.filter((bad != F.lit(b)) | (F.col("h") <= last)), take[b]
    return rows.select("grade", F.expr("CAST(h & 1 AS INT)").alias("half"), "text"), {b: sizes[b] / n[b] for b in n}


def fit(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", grade="toxic", sample: int = SAMPLE) -> Model:
    """A model of the labelled documents.

    ``grade`` is 0 for clean; if no grade is above 1, the toxic are graded by
    their words.  See :func:`labelled_sample` for the rows that count.  To the driver come
    the sample's features and their counts, packed.
    """
    spark = docs.sparkSession
    rows, weigh = labelled_sample(docs, labels, text, doc_id, grade, sample)
    if not weigh:
        return Model({}, np.zeros(0), np.zeros(0))
    counts = rows.mapInArrow(_word_counts, "feature string, " + ", ".join(f"{c} long" for c in _HELD)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in _HELD])
    best = counts.filter(sum(F.col(c) for c in _HELD) >= LEAST_TEXTS).toArrow().sort_by("feature")
    model = Model({f: i for i, f in enumerate(best.column("feature").to_pylist())}, np.zeros(best.num_rows), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)
    bags = rows.mapInArrow(lambda batches: _bags(batches, shared), "grade int, half int, n int, bag binary").toArrow()
    bags = sorted(zip(*(bags.column(c).to_pylist() for c in ("grade", "bag", "half", "n"))))
    grades, halves, sizes_of = (np.array([b[i] for b in bags], np.int64) for i in (0, 2, 3))
    row = np.repeat(np.arange(len(bags), dtype=np.int32), sizes_of)
    feature, value, hits = np.empty(len(row), np.int32), np.empty(len(row), np.float32), np.zeros(len(bags))
    held = [best.column(c).to_numpy().astype(float) for c in _HELD]
    texts = [float(((halves == i // 2) & ((grades > 0) == bool(i % 2))).sum()) for i in range(4)]
    # what tells in one half grades the other
    telling = [likelihood_root(held[2 * (1 - half) + 1], held[2 * (1 - half)], texts[2 * (1 - half) + 1], texts[2 * (1 - half)]) >= LEAST_Z for half in (0, 1)]
    for i, (end, (_, bag, half, k)) in enumerate(zip(np.cumsum(sizes_of), bags)):
        own, times = _unpack(bag)
        feature[end - k : end], value[end - k : end], hits[i] = own, np.log1p(times), times[telling[half][own]].sum()
    del bags
    weight = np.where(grades > 0, weigh.get(True, 1.0), weigh.get(False, 1.0))
    if grades.max(initial=0) == 1:
        cuts = np.quantile(hits[grades == 1], [1 / 3, 2 / 3])
        grades = np.where(grades == 1, 1 + (hits[:, None] > np.unique(cuts)[None, :]).sum(axis=1), 0)
        grades = np.unique(grades, return_inverse=True)[1] if (grades == 0).any() else grades
    model.weights, model.thresholds = fit_ordinal(row, feature, value, grades, weight, best.num_rows)
    return model


def _graded(batches, shared, text, names):
    for batch in batches:
        for part in slices(batch, text):
            p = shared.value.grades(shared.value.score(byte_rows(part.column(text))))
            severity, toxic = p @ np.arange(p.shape[1]), 1 - p[:, 0]
            extra = [pa.array(severity), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= FLAG)]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, *names])


def grade_toxicity(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` with severity, grade, p_toxic and toxic; leading underscores where ``docs`` has such names.

    Null and empty texts have no features and get the prior; a model without
    labels gives grade 0 to all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(docs, n) for n in ("severity", "grade", "p_toxic", "toxic")]
    schema = T.StructType(list(docs.schema.fields)).add(names[0], "double").add(names[1], "integer").add(names[2], "double").add(names[3], "boolean")
    return docs.mapInArrow(lambda batches: _graded(batches, shared, text, names), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, likeliest grade and toxicity of all documents; null and empty texts get the prior."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_toxicity(docs, model).drop("text")
