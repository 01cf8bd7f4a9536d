"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords, the character 2-, 3- and
4-grams of its words with a mark at either end, hashed into buckets.  A softmax
over linear scores of that mean gives the languages.  Embeddings and weights
are trained together by stochastic gradient descent in numpy.  On rows kept
apart from training a temperature is fitted, so that confidences are the shares
of right predictions; texts with a confidence little above chance are rejected.

A confidence cannot tell a language that was not learnt, as it only weighs the
learnt ones against each other.  So the mean log-likelihood of a text's subwords,
each in the learnt language that it is likeliest in, is compared with that of the
rows kept apart: a text that falls too far below theirs, in deviations of a text
of its length, is in no learnt language.  A text that mixes learnt languages is
not far from them.

The model is fitted on a bounded sample: at most SAMPLE texts, an equal share
for each language, taken by hash.  Its size does not depend on the corpus
(BUCKETS x DIMENSIONS and one column per language), so it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import crc_mod, free_name, mix64, release_memory, scratch_path, slices

SAMPLE = 4000
BUCKETS = 1 << 14
DIMENSIONS = 16
ORDERS = (2, 3, 4)
EPOCHS = 5
BATCH = 32
RATE = 0.5
#: Every so many-th sampled text calibrates and does not train.
CALIBRATE = 5
#: A text is rejected where its calibrated confidence is less than this part of the way from chance to certainty:
#: its subwords then say next to nothing, and the best language is a guess.
REJECT = 0.15
#: A text is also rejected where its subwords are less likely than those of the rows kept apart by so many deviations:
#: the farthest of SAFE of those rows by FACTOR, or LEAST_FAR.
SAFE, FACTOR, LEAST_FAR = 0.995, 1.5, 4.0
#: What is added to a bucket's count in a language.
PRIOR = 0.1
UNKNOWN = "und"
#: Bytes of text whose subwords are held at once, some hundred bytes for each.
SLICE_BYTES = 256 << 10

_letters: np.ndarray | None = None
_MARK = np.uint32(0x20)


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all texts, and the end of each text's run of them."""
    lower = [" " + x.lower() for x in texts]
    codes = np.frombuffer(("".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    text_ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))
    letter = _is_letter()[codes]
    # of other characters the one before a word is kept, as the mark at its start and at the end of the word before
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[-1] = True
    place = np.flatnonzero(keep)
    x = np.where(letter[place], codes[place], _MARK).astype(np.uint64)
    blank = ~letter[place]
    ends = np.searchsorted(place, text_ends)
    grams, starts = [], []
    code = x.copy()
    inner = np.zeros(len(x), bool)  # a blank strictly inside the gram
    for n in range(2, max(ORDERS) + 1):
        count = max(len(x) - n + 1, 0)
        code = code[:count] * np.uint64(0x9E3779B1) + x[n - 1 :]
        inner = inner[:count] | (blank[n - 2 : n - 2 + count] if n > 2 else False)
        if n in ORDERS:
            # not the mark alone, and nothing across the end of a text
            real = ~inner & ~(blank[:count] & blank[n - 1 :]) if n == 2 else ~inner
            at = np.flatnonzero(real)
            grams.append((mix64(code[at] + np.uint64(n << 56)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            starts.append(at)
    at, bucket = np.concatenate(starts), np.concatenate(grams)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], ends)


def _bags(batches):
    """(lang, text) to (lang, buckets, counts): what training sees of a text."""
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            bucket, ends = subwords([t or "" for t in rows.column("text").to_pylist()])
            parts = [np.unique(p, return_counts=True) for p in np.split(bucket, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang"), pa.array([b.astype("<i4").tobytes() for b, _ in parts], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in parts], pa.binary())],
                ["lang", "buckets", "counts"],
            )
    release_memory()


class Model:
    """Languages, and per bucket the scores that embedding and softmax weights give together.

    ``logs`` are log-likelihoods of the buckets in their likeliest language;
    ``mean``, ``spread`` and ``drift`` have by language what they come to in a
    text: over n subwords about ``mean``, with the variance drift + spread / n.
    """

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, logs=None, mean=None, spread=None, drift=None, far: float = np.inf):
        self.langs, self.scores, self.bias, self.temperature = langs, scores, bias, temperature
        self.logs, self.mean, self.spread, self.drift, self.far = logs, mean, spread, drift, far
        chance = 1 / max(len(langs), 1)
        #: The confidence under which a text is rejected; all are where nothing was learnt.
        self.least = chance + REJECT * (1 - chance)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language and the calibrated confidence of each text, and whether it is rejected; `und`, 0 and true without a letter."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bucket, ends = subwords(texts)
        counts = np.diff(ends, prepend=0)
        sums, logs = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        full = np.flatnonzero(counts)
        if len(full):
            begins = (ends - counts)[full]
            for k in range(len(self.langs)):
                sums[full, k] = np.add.reduceat(self.scores[k][bucket], begins, dtype=np.float64)
            if self.logs is not None:
                logs[full] = np.add.reduceat(self.logs[bucket], begins, dtype=np.float64)
        p = _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        rows = np.arange(len(texts))
        score = np.where(counts > 0, p[rows, best], 0.0)
        strange = self.distance(logs, counts, best) > self.far if self.logs is not None else np.zeros(len(texts), bool)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, counts)], score, (score < self.least) | strange

    def distance(self, logs: np.ndarray, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Deviations by which the summed log-likelihoods of texts fall below those of their languages."""
        n = np.maximum(counts, 1)
        return (self.mean[lang] - logs / n) / np.sqrt(self.drift[lang] + self.spread[lang] / n)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fits embeddings, softmax and temperature to (language, buckets, counts)."""
    bags = [b for b in bags if len(b[1])]
    langs = sorted({b[0] for b in bags})
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0)
    index = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    rng.shuffle(bags)
    apart = bags[::CALIBRATE] if len(bags) >= 10 * CALIBRATE else bags
    rest = [b for i, b in enumerate(bags) if i % CALIBRATE] if apart is not bags else bags
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = EPOCHS * -(-len(rest) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rest))
        for at in range(0, len(rest), BATCH):
            chosen = [rest[i] for i in order[at : at + BATCH]]
            # the buckets of the batch alone
            used, where = np.unique(np.concatenate([b[1] for b in chosen]), return_inverse=True)
            x = np.zeros((len(chosen), len(used)), np.float32)
            row = np.repeat(np.arange(len(chosen)), [len(b[1]) for b in chosen])
            x[row, where] = np.concatenate([b[2] / b[2].sum() for b in chosen])
            hidden = x @ embed[used]
            p = _softmax(hidden @ weight + bias)
            p[np.arange(len(chosen)), [index[b[0]] for b in chosen]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ weight.T
            weight -= rate * hidden.T @ p
            bias -= rate / len(chosen) * p.sum(axis=0)
            embed[used] -= rate * BUCKETS ** 0.5 / 8 * (x.T @ back)
            done += 1
    scores = np.ascontiguousarray((embed @ weight).T)
    raw = np.stack([(scores[:, b[1]] * b[2]).sum(axis=1) / b[2].sum() for b in apart]) + bias
    truth = np.array([index[b[0]] for b in apart])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model = Model(langs, scores, bias.astype(np.float64), float(grid[int(np.argmin(loss))]))
    _learn_distance(model, rest, apart, index)
    return model


def _learn_distance(model: Model, rest, apart, index: dict[str, int]) -> None:
    """Log-likelihoods of buckets from the training rows, and from the rows kept apart what is usual in a text."""
    k = len(index)
    seen = np.full((k, BUCKETS), PRIOR)
    for lang, bucket, count in rest:
        seen[index[lang], bucket] += count
    model.logs = np.log((seen / seen.sum(axis=1, keepdims=True)).max(axis=0)).astype(np.float32)
    lang = np.array([index[b[0]] for b in apart])
    n = np.array([b[2].sum() for b in apart], np.float64)
    sums = np.array([(model.logs[b[1]] * b[2]).sum(dtype=np.float64) for b in apart])
    squares = np.array([(model.logs[b[1]].astype(np.float64) ** 2 * b[2]).sum() for b in apart])
    model.mean, model.spread, model.drift = np.zeros(k), np.ones(k), np.ones(k)
    for i in range(k):
        own = lang == i
        if not own.any():  # nothing kept apart: as in the others together
            own = np.ones(len(lang), bool)
        model.mean[i] = np.median(sums[own] / n[own])
        model.spread[i] = max(squares[own].sum() / n[own].sum() - (sums[own].sum() / n[own].sum()) ** 2, 1e-6)
        away = (sums[own] / n[own] - model.mean[i]) ** 2 - model.spread[i] / n[own]
        # neighbouring subwords overlap, so that a text of n has fewer than n of its own
        long = n[own] >= np.median(n[own])
        model.spread[i] *= max(ORDERS)
        model.drift[i] = max(np.median(away[long]) * 2.2, 1e-3)  # the median of squares is 1 / 2.2 of their mean in normal rows
    model.far = max(LEAST_FAR, FACTOR * float(np.quantile(model.distance(sums, n, lang), SAFE)))


def sampled(labelled: DataFrame, text="text", lang="lang", doc_id="doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, h, text) of ``sample`` distinct rows at most, kept in the shared folder.

    Each language gives an equal share at most, the rows with the smallest
    hashes h of id and text; rows that are the same in id, text and language
    count once.  Of more than ``sample`` languages those with most distinct rows
    (to one in a hundred) give one row each.  A language's share is first cut off
    its hashes by the count of its distinct rows, with some room, so that what is ranked and written stays bounded
    however large or hot a language is.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(17), F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    share = max(1, sample // max(len(counts), 1))
    room = share + 4 * share**0.5 + 8
    cuts = [(r["lang"], min((1 << 63) - 1, int(room / r["n"] * 2.0**64) - (1 << 63))) for r in counts]
    limits = spark.createDataFrame(cuts, T.StructType([rows.schema["lang"], T.StructField("cut", T.LongType())]))
    path = scratch_path(spark, "lang-sample")
    rows.join(F.broadcast(limits), "lang").filter("h <= cut").dropDuplicates(["lang", "h"]).drop("cut").write.parquet(path)
    near = spark.read.parquet(path)
    first = near.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= share)
    return near.join(F.broadcast(first.drop("n")), ["lang", "h"])


def fit(labelled: DataFrame, text="text", lang="lang", doc_id="doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows given: those with a language, ``sample`` at most.

    The sample's bags of subwords come to the driver; see :func:`sampled`.  Null
    texts teach nothing, and an empty table gives a model that knows no language.
    """
    bags = sampled(labelled, text, lang, doc_id, sample).select("lang", "text").mapInArrow(_bags, "lang string, buckets binary, counts binary").collect()
    unpacked = [(r[0], np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in bags]
    return train(sorted(unpacked, key=lambda b: (b[0], b[1].tobytes(), b[2].tobytes())))


def _predicted(batches, shared, text, names):
    for batch in batches:
        for rows in slices(batch, text, SLICE_BYTES):
            langs, score, drop = shared.value.predict([t or "" for t in rows.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(drop)], [*rows.schema.names, *names])
    release_memory()


def identify(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; leading underscores where ``docs`` has such names.

    Null texts and texts without a letter are `und`, score 0 and rejected, as is
    everything if no labelled row was there to learn from.  Whole texts are read,
    in slices of rows; repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]
    schema = docs.schema
    schema = type(schema)(list(schema.fields)).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return docs.mapInArrow(lambda batches: _predicted(batches, shared, text, names), schema)


def _kept(batches, shared, text):
    for batch in batches:
        for rows in slices(batch, text, SLICE_BYTES):
            _, _, drop = shared.value.predict([t or "" for t in rows.column(text).to_pylist()])
            yield rows.filter(pa.array(~drop))
    release_memory()


def accepted(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _kept(batches, shared, text), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that are not held out; `und` without a letter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", crc_mod("doc_id") == 0)
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
