"""Language-model scores from a hierarchical Pitman-Yor model.

Every context has a restaurant whose customers are the words that follow it;
the context is the class of the word before, by hash, and there are the more
classes the more documents there are (:func:`context_bits`).  All context
restaurants share one parent, the restaurant of words at large, whose base is
uniform over the words known and one unknown word.

Counts are gathered from all training documents.  Blocks of documents send
their distinct (context, word) pairs to reducers dealt out by word, and a
reducer has all contexts of its words.  The seating is sampled by Gibbs: a
pair's number of tables given its customers, all other tables and the parent,
with the places at the tables summed out by generalised Stirling numbers, then
the words' tables in the parent.  A sweep is one job over the gathered counts;
all reducers see the same totals of the sweep before it, those of the whole
corpus, and the strengths are then drawn given the new totals.  Discounts are
fitted to the training counts of counts.  Random numbers go by (sweep, word,
context), so results depend on the table's rows alone, not on how they are
dealt out, and a reducer can seat its words again from the totals whenever it
is asked.  With the totals of each retained sample the predictive
probabilities are averaged and go back to the blocks that asked.
Probabilities sum to one over the known words and the unknown one.  What is
sent are packed arrays, a few bytes a pair.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import SPACE, arrow_rows, byte_rows, crc_mod, hashed_words, mix64, release_memory, scratch_path

#: Bits of a context's class, at least and at most.
LEAST_BITS, MOST_BITS = 12, 20
#: Sweeps before the first sample, and samples that are averaged.
BURN_IN, SAMPLES = 2, 2
#: Customers up to which the Stirling numbers are tabled; beyond, their limit for many customers is used.
TABLED = 128
#: Bytes of text of a block of documents.
BLOCK_BYTES = 8 << 20
#: Strengths that are weighed against one another.
GRID = np.geomspace(0.1, 10_000, 41)
_WORD = np.uint64(32)
_CONTEXT = np.uint64(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
END_WORD, NO_WORD = mix64(np.array([0x656E64, 0x6E6F6E65], np.uint64))


def context_bits(documents: int) -> int:
    """Bits of a context's class: a class for every four documents or so."""
    return min(MOST_BITS, max(LEAST_BITS, documents.bit_length() - 2))


# -- pairs of a block --------------------------------------------------------


def tokens_of(rows: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, the classes of the words before, and the tokens of each text."""
    words, counts = hashed_words(rows, SPACE)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + len(rows), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = words, END_WORD
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends + 1 - sizes] = NO_WORD
    return tokens, (before >> np.uint64(64 - bits)).astype(np.uint32), sizes


@dataclass
class Pairs:
    """Distinct pairs in order of (word, context): sorted words, the place of each pair's word among them, contexts."""

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, contexts: np.ndarray) -> tuple[Pairs, np.ndarray]:
        """The pairs, and the place among them of each token."""
        words, w = np.unique(tokens, return_inverse=True)
        keys, at = np.unique(w.astype(np.uint64) << _WORD | contexts.astype(np.uint64), return_inverse=True)
        return Pairs(words, (keys >> _WORD).astype(np.int64), (keys & _CONTEXT).astype(np.uint32)), at

    def part(self, chosen: np.ndarray) -> Pairs:
        """Some of the pairs, given in order, with their words alone."""
        used, word = np.unique(self.word[chosen], return_inverse=True)
        return Pairs(self.words[used], word, self.context[chosen])


def _planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers with their first bytes together, then the second: small numbers pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind), at + n * width


def pack(pairs: Pairs, counts: np.ndarray) -> bytes:
    """Pairs and their counts as bytes: gaps between words, contexts a word, contexts, counts."""
    gaps = np.diff(pairs.words, prepend=np.uint64(0))
    spread = np.bincount(pairs.word, minlength=len(pairs.words))
    head = struct.pack("<ii", len(pairs.word), len(pairs.words))
    return head + _planes(gaps.astype("<u8")) + _planes(spread.astype("<u4")) + _planes(pairs.context.astype("<u4")) + _planes(counts.astype("<u4"))


def unpack(data: bytes) -> tuple[Pairs, np.ndarray]:
    """Pairs and counts from bytes of :func:`pack`."""
    n, words = struct.unpack_from("<ii", data)
    gaps, at = _unplanes(data, "<u8", words, 8)
    spread, at = _unplanes(data, "<u4", words, at)
    context, at = _unplanes(data, "<u4", n, at)
    counts, _ = _unplanes(data, "<u4", n, at)
    return Pairs(np.cumsum(gaps, dtype=np.uint64), np.repeat(np.arange(words), spread), context), counts


def _dealt(pairs: Pairs, reducers: int) -> tuple[np.ndarray, np.ndarray]:
    """The reducer of each pair, and the order that sorts by (reducer, word, context)."""
    r = (pairs.words % np.uint64(reducers)).astype(np.int64)[pairs.word]
    return r, np.argsort(r, kind="stable")


def _sent(pairs: Pairs, counts: np.ndarray, reducers: int):
    """(reducer, bytes) of pairs."""
    r, order = _dealt(pairs, reducers)
    r = r[order]
    cuts = np.flatnonzero(np.diff(r, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(r[a]), pack(pairs.part(order[a:b]), counts[order[a:b]])


def joined(blocks: list[tuple[Pairs, np.ndarray]]) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """The pairs of several blocks as one, their counts added, and the place of each block's pairs, one block after another."""
    words = np.unique(np.concatenate([p.words for p, _ in blocks]))
    keys = np.concatenate([np.searchsorted(words, p.words)[p.word].astype(np.uint64) << _WORD | p.context.astype(np.uint64) for p, _ in blocks])
    unique, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, np.concatenate([c for _, c in blocks]), len(unique)).astype(np.int64)
    return Pairs(words, (unique >> _WORD).astype(np.int64), (unique & _CONTEXT).astype(np.uint32)), sums, at


# -- seating -----------------------------------------------------------------

_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), t - 1 in the second place, c up to TABLED."""
    if discount not in _stirling:
        _stirling.clear() if len(_stirling) > 8 else None
        out = np.full((TABLED + 1, TABLED), -np.inf)
        out[1, 0] = 0.0
        for c in range(1, TABLED):
            stay = np.log(np.maximum(c - discount * np.arange(1, TABLED + 1), 1e-300)) + out[c]
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
        _stirling[discount] = out
    return _stirling[discount]


def limit_mean(customers: np.ndarray, discount: float, weight: np.ndarray) -> np.ndarray:
    """The mean of the further tables of many customers, at chances ``weight`` of a new one.

    In the limit a pair has one table that grows with it, and a Poisson number
    of others, of sizes in proportion to (1 - d)(2 - d).../n! * x^n with the x
    at which all customers are expected.
    """
    low = np.minimum((np.log(weight) - np.log(customers)) / (1 - discount), 0.0) - 3.0 / (1 - discount)
    high = np.full(len(customers), -1e-15)
    for _ in range(60):  # bisection on the logarithm of v = 1 - x
        y = (low + high) / 2
        above = np.log(weight) + np.log1p(-np.exp(y)) + (discount - 1) * y > np.log(customers)
        low, high = np.where(above, y, low), np.where(above, high, y)
    return weight * -np.expm1(discount * (low + high) / 2) / discount


def draw_tables(customers: np.ndarray, discount: float, chance, seeds: np.ndarray) -> np.ndarray:
    """Numbers of tables t with probability in proportion to S(c, t) times the chances of the further tables.

    ``chance(own, k)`` weighs a new table of pairs ``own`` that have k;
    ``seeds`` are 64 random bits a pair.
    """
    tables = np.ones(len(customers), np.int64)
    logs = log_stirling(discount)
    many = np.flatnonzero(customers > 1)
    many = many[np.argsort(customers[many], kind="stable")]
    uniform = (seeds >> np.uint64(11)) * 2.0**-53
    cuts = np.searchsorted(customers[many], np.arange(2, TABLED + 2))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 2):
        k, step = np.arange(1, c), max(1, 500_000 // c)
        for i in range(a, b, step):
            own = many[i : min(b, i + step)]
            p = np.zeros((len(own), c))
            np.cumsum(np.log(chance(own[:, None], k)), axis=1, out=p[:, 1:])
            p += logs[c, :c]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (p < (uniform[own] * p[:, -1])[:, None]).sum(axis=1)
    own = many[cuts[-1] :]
    if len(own):
        mean = np.zeros(len(own))
        for _ in range(12):  # the chance depends on the tables there are, weakly
            mean = limit_mean(customers[own], discount, chance(own, 1 + mean))
        drawn = [np.random.Generator(np.random.Philox(key=int(s))).poisson(m) for s, m in zip(seeds[own], mean)]
        tables[own] = np.minimum(1 + np.array(drawn, np.int64), customers[own])
    return tables


@dataclass
class Totals:
    """Sums over the whole corpus after a sweep, and the strengths drawn given them."""

    words: int
    tokens: int
    customers: np.ndarray
    tables: np.ndarray
    root: int
    discount: float
    root_discount: float
    strength: float = 1.0
    root_strength: float = 1.0

    def draw_strengths(self, sweep: int) -> Totals:
        """Draws both strengths from the grid given the tables."""
        rng = np.random.default_rng(sweep)
        seated = self.customers > 0
        self.strength = _strength(self.tables[seated], self.customers[seated], self.discount, rng)
        self.root_strength = _strength(np.array([self.root]), np.array([self.tables.sum()]), self.root_discount, rng)
        return self


def _log_gamma(x: np.ndarray) -> np.ndarray:
    near = sum(np.log(x + i) for i in range(8))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - near


def _strength(tables: np.ndarray, customers: np.ndarray, discount: float, rng) -> float:
    """A strength from GRID by its posterior, with all equally likely before."""
    (tables, customers), n = np.unique(np.stack([tables, customers]), axis=1, return_counts=True)
    if not customers.sum():
        return 1.0
    t, c = tables.astype(float), customers.astype(float)
    fits = [n @ (_log_gamma(s / discount + t) - _log_gamma(s + c)) + n.sum() * float(_log_gamma(np.array(s + 1.0)) - _log_gamma(np.array(s / discount + 1))) for s in GRID]
    p = np.cumsum(np.exp(np.array(fits) - max(fits)))
    return float(GRID[np.searchsorted(p, rng.random() * p[-1])])


def fitted_discount(once: int, twice: int) -> float:
    """The discount that counts of ones and twos ask for."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


class Seating:
    """The training pairs of one reducer, and samples of their tables."""

    def __init__(self, pairs: Pairs, counts: np.ndarray):
        chosen = np.flatnonzero(counts > 0)
        self.pairs, self.counts = pairs.part(chosen), counts[chosen].astype(np.int64)
        self.starts = np.searchsorted(self.pairs.word, np.arange(len(self.pairs.words)))
        self.seeds = mix64(self.pairs.words)[self.pairs.word] + self.pairs.context.astype(np.uint64) * _ODD

    def served(self, tables: np.ndarray) -> np.ndarray:
        """Tables by word: the customers of the parent."""
        return np.add.reduceat(tables, self.starts) if len(self.counts) else np.zeros(0, np.int64)

    def samples(self, history: list[Totals]):
        """(tables of the pairs, tables of the words in the parent) after each sweep, given the totals before each."""
        tables, root = np.ones(len(self.counts), np.int64), np.ones(len(self.pairs.words), np.int64)
        for sweep, totals in enumerate(history):
            tables, root = self._sweep(tables, root, totals, np.uint64(sweep + 1))
            yield tables, root

    def _sweep(self, tables, root, totals: Totals, sweep: np.uint64):
        if not len(self.counts):
            return tables, root
        d, d0, base = totals.discount, totals.root_discount, 1 / (totals.words + 1)
        here = totals.strength + d * (totals.tables[self.pairs.context] - tables)
        others, roots = (self.served(tables)[self.pairs.word] - tables), root[self.pairs.word]
        fresh, all_served = (totals.root_strength + d0 * totals.root) * base, totals.root_strength + totals.tables.sum()

        def new_table(own, k):
            sat = others[own] + k
            return (here[own] + d * k) * (np.maximum(sat - d0 * np.minimum(roots[own], sat), 0.0) + fresh) / all_served

        tables = draw_tables(self.counts, d, new_table, mix64(self.seeds ^ mix64(sweep)))
        top = totals.root_strength + d0 * (totals.root - root)
        root = draw_tables(self.served(tables), d0, lambda own, k: (top[own] + d0 * k) * base, mix64(self.pairs.words ^ mix64(sweep + _ODD)))
        return tables, root


def predictive(seating: Seating, history: list[Totals], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of pairs, averaged over the samples after BURN_IN, and training counts of their words."""
    own, totals = seating.pairs, history[0]
    word = np.searchsorted(own.words, pairs.words)
    known = np.zeros(len(pairs.words), bool)
    known[word < len(own.words)] = own.words[word[word < len(own.words)]] == pairs.words[word < len(own.words)]
    word = np.where(known, word, 0)
    key = np.where(known, word, len(own.words)).astype(np.uint64)[pairs.word] << _WORD | pairs.context.astype(np.uint64)
    theirs = own.word.astype(np.uint64) << _WORD | own.context.astype(np.uint64)
    pair = np.searchsorted(theirs, key)
    seen = pair < len(theirs)
    seen[seen] = theirs[pair[seen]] == key[seen]
    pair = np.where(seen, pair, 0)
    mean = np.zeros(len(key))
    for s, (tables, root) in enumerate(seating.samples(history[:-1]), 1):
        if s <= BURN_IN:
            continue
        after = history[s]
        parent = np.full(len(pairs.words), (after.root_strength + after.root_discount * after.root) / (after.words + 1))
        if len(theirs):
            parent += np.where(known, (seating.served(tables) - after.root_discount * root)[word], 0.0)
        parent /= after.root_strength + after.tables.sum()
        kept = np.where(seen, (seating.counts - after.discount * tables)[pair], 0.0) if len(theirs) else 0.0
        mean += (kept + (after.strength + after.discount * after.tables[pairs.context]) * parent[pairs.word]) / (after.strength + after.customers[pairs.context])
    counts = np.where(known, seating.served(seating.counts)[word], 0) if len(theirs) else np.zeros(len(pairs.words), np.int64)
    return np.log10(mean / (len(history) - 1 - BURN_IN)), counts


# -- jobs --------------------------------------------------------------------


def _binary(rows, names):
    kinds = {"p": pa.int32(), "r": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, list(zip(*rows)) or [()] * len(names))], names)


def _training_pairs(batches, reducers: int, bits: int):
    """Training documents of a task to (r, pairs), about BLOCK_BYTES of text at a time."""

    def flush(rows):
        tokens, contexts, _ = tokens_of(rows, bits)
        pairs, at = Pairs.of(tokens, contexts)
        return _binary(list(_sent(pairs, np.bincount(at, minlength=len(pairs.word)), reducers)), ["r", "pairs"])

    held, size = [], 0
    for batch in batches:
        chosen = batch.filter(batch.column("train"))
        for row in byte_rows(chosen.column("text")):
            held.append(row)
            size += len(row) + 1
            if size >= BLOCK_BYTES:
                yield flush(held)
                held, size = [], 0
                release_memory()
    if held:
        yield flush(held)
    release_memory()


def _merged(table: pa.Table) -> pa.Table:
    """All blocks' pairs of a reducer as one."""
    pairs, counts, _ = joined([unpack(x.as_py()) for x in table.column("pairs")])
    out = pa.Table.from_batches([_binary([(table.column("r")[0].as_py(), pack(pairs, counts))], ["r", "pairs"])])
    release_memory()
    return out


#: Slots of the sums that are not a context's.
_SIZES, _ROOT, _ONES, _SPREAD = -1, -2, -3, -4


def _sums(batches, shared, bits: int):
    """Gathered pairs of a task to (slot, customers, tables) after the sweeps that ``shared`` has totals for."""
    history = shared.value
    customers, tables = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    other = {slot: np.zeros(2, np.int64) for slot in (_SIZES, _ROOT, _ONES, _SPREAD)}
    for batch in batches:
        for data in batch.column("pairs"):
            seating = Seating(*unpack(data.as_py()))
            context, words = seating.pairs.context, len(seating.pairs.words)
            own, root = np.ones(len(context), np.int64), np.ones(words, np.int64)
            for own, root in seating.samples(history):
                pass
            tables += np.bincount(context, own, 1 << bits).astype(np.int64)
            other[_ROOT][0] += root.sum()
            if not history:
                customers += np.bincount(context, seating.counts, 1 << bits).astype(np.int64)
                spread = np.bincount(seating.pairs.word, minlength=words)
                other[_SIZES] += seating.counts.sum(), words
                other[_ONES] += (seating.counts == 1).sum(), (seating.counts == 2).sum()
                other[_SPREAD] += (spread == 1).sum(), (spread == 2).sum()
        release_memory()
    slots, rest = np.flatnonzero(tables), np.array(list(other.values()))
    columns = [np.concatenate([list(other), slots]).astype(np.int32), np.concatenate([rest[:, 0], customers[slots]]), np.concatenate([rest[:, 1], tables[slots]])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "customers", "tables"])


def _totals(gathered: DataFrame, history: list[Totals], bits: int) -> Totals:
    """The corpus's totals after one sweep more than ``history`` has: a job that writes one row a context, which the driver reads.

    The gathered pairs go to Python one row a batch, but the sums must not come
    to the driver so: a batch of its own for each context takes a hundred times
    what the context's row does.
    """
    spark, path = gathered.sparkSession, scratch_path(gathered.sparkSession, "lm-totals")
    shared = spark.sparkContext.broadcast(history)
    with arrow_rows(spark, 1):
        rows = gathered.mapInArrow(lambda batches: _sums(batches, shared, bits), "slot int, customers long, tables long")
        rows.groupBy("slot").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).write.option("compression", "zstd").parquet(path)
    shared.destroy()  # unpersist would leave the driver's own copy
    sums = spark.read.schema("slot int, customers long, tables long").parquet(path).toArrow()
    slot, a, b = (sums.column(c).to_numpy() for c in ("slot", "customers", "tables"))
    other = {int(s): (int(x), int(y)) for s, x, y in zip(slot[slot < 0], a[slot < 0], b[slot < 0])}
    customers, tables = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    customers[slot[slot >= 0]], tables[slot[slot >= 0]] = a[slot >= 0], b[slot >= 0]
    root = other.get(_ROOT, (0, 0))[0]
    if history:
        first = history[0]
        out = Totals(first.words, first.tokens, first.customers, tables, root, first.discount, first.root_discount)
    else:
        tokens, words = other.get(_SIZES, (0, 0))
        out = Totals(words, tokens, customers, tables, root, fitted_discount(*other.get(_ONES, (0, 0))), fitted_discount(*other.get(_SPREAD, (0, 0))))
    return out.draw_strengths(len(history))


def _block_pairs(table: pa.Table, reducers: int, bits: int) -> pa.Table:
    """All documents of a block to (p, r, pairs): all their pairs, with training counts."""
    table = table.combine_chunks()
    tokens, contexts, sizes = tokens_of(byte_rows(table.column("text").combine_chunks()), bits)
    pairs, at = Pairs.of(tokens, contexts)
    train = np.bincount(at, np.repeat(table.column("train").to_numpy(), sizes), len(pairs.word))
    p = table.column("p")[0].as_py()
    del tokens, contexts, at
    out = pa.Table.from_batches([_binary([(p, r, x) for r, x in _sent(pairs, train, reducers)], ["p", "r", "pairs"])])
    release_memory()
    return out


#: Logarithms are sent as whole multiples of 2^-19, three bytes each.
_SCALE = 1 << 19


def _answers(table: pa.Table, shared) -> pa.Table:
    """(p, r, pairs) of a reducer to (p, r, answer): counts of the block's words, then log10 probabilities of its pairs."""
    blocks = [unpack(x.as_py()) for x in table.column("pairs")]
    pairs, counts, at = joined(blocks)
    logs, known = predictive(Seating(pairs, counts), shared.value, pairs)
    logs = np.clip(np.rint(-logs * _SCALE), 0, (1 << 24) - 1).astype("<u4")
    rows, start = [], 0
    for p, r, (own, _) in zip(table.column("p").to_pylist(), table.column("r").to_pylist(), blocks):
        n = len(own.word)
        planes = np.ascontiguousarray(logs[at[start : start + n]].view(np.uint8).reshape(n, 4)[:, :3].T).tobytes()
        rows.append((p, r, struct.pack("<ii", n, len(own.words)) + _planes(known[np.searchsorted(pairs.words, own.words)].astype("<u4")) + planes))
        start += n
    del blocks, pairs, counts, at
    release_memory()
    return pa.Table.from_batches([_binary(rows, ["p", "r", "answer"])])


def _scored(docs: pa.Table, answers: pa.Table, reducers: int, bits: int, shared, names) -> pa.Table:
    """Scores of a block's documents from the answers to its pairs."""
    if not docs.num_rows:
        return pa.Table.from_arrays([pa.array([], f.type) for f in names], schema=names)
    tokens, contexts, sizes = tokens_of(byte_rows(docs.column("text").combine_chunks()), bits)
    pairs, at = Pairs.of(tokens, contexts)
    del tokens, contexts
    _, order = _dealt(pairs, reducers)
    counts, logs = [], []
    for answer in answers.sort_by("r").column("answer"):
        data = answer.as_py()
        n, words = struct.unpack_from("<ii", data)
        own, offset = _unplanes(data, "<u4", words, 8)
        counts.append(own)
        low, mid, high = np.frombuffer(data, np.uint8, 3 * n, offset).reshape(3, n).astype(np.int64)
        logs.append((low | mid << 8 | high << 16) / -_SCALE)
    sent = pairs.word[order]
    index = np.cumsum(np.diff(sent, prepend=-1) != 0) - 1
    log, count = np.empty(len(order)), np.empty(len(order), np.int64)
    log[order], count[order] = np.concatenate(logs), np.concatenate(counts)[index]
    totals = shared.value[0]
    base = np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
    starts = np.cumsum(sizes) - sizes
    sums = [np.add.reduceat(x[at], starts) for x in ((count > 0).astype(np.int64), base, log)]
    release_memory()
    columns = [docs.column("doc_id"), pa.array(~docs.column("train").to_numpy()), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), totals.tokens)), pa.array(sums[1]), pa.array(sums[2])]
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=names)


def score_documents(docs: DataFrame, train: Column, text="text", doc_id="doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows.

    The model learns from the rows for which ``train`` holds (null: not).  A
    null text is empty and has the end as its one token; repeated rows count as
    often as they stand and score alike; null ids are kept.  Without training rows every word is
    the unknown one; an empty table gives no rows.  Other columns are not read.
    ``block_bytes`` of text make a block; it bounds memory and does not change scores.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    rows, size = chosen.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks, bits = max(2, -(-(size or 0) // block_bytes)), context_bits(rows)
    path = scratch_path(spark, "lm-counts")
    pairs = chosen.select("train", "text").mapInArrow(lambda batches: _training_pairs(batches, blocks, bits), "r int, pairs binary")
    pairs.groupBy("r").applyInArrow(_merged, "r int, pairs binary").write.option("compression", "zstd").parquet(path)
    gathered, history = spark.read.schema("r int, pairs binary").parquet(path), []
    for _ in range(1 + BURN_IN + SAMPLES):
        history.append(_totals(gathered, history, bits))
    shared = spark.sparkContext.broadcast(history)

    salt = F.xxhash64(F.lit(29), "doc_id", F.length("text"), F.substring("text", 1, 64))
    by_block = chosen.withColumn("p", F.pmod(salt, F.lit(blocks)).cast("int")).repartition(blocks, "p")
    asked = by_block.groupBy("p").applyInArrow(lambda t: _block_pairs(t, blocks, bits), "p int, r int, pairs binary")
    answers = asked.groupBy("r").applyInArrow(lambda t: _answers(t, shared), "p int, r int, answer binary")
    schema = T.StructType([chosen.schema["doc_id"]]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    names = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    return by_block.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(lambda a, b: _scored(a, b, blocks, bits, shared, names), schema)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of all documents, learnt from those that are not held out; null texts have the end alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, crc_mod("doc_id") != 1)
