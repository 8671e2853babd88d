"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model's symbols are the most frequent words, buckets of all other words by their last letters, and the end of a
text. The symbols before a position, each scaled for its distance, add up to a predicted vector. Its products with
class vectors and with the vectors of a class's symbols give the next symbol; both levels are trained by telling data
from noise and normalised over their whole range, in batched matrix products. A bucket's word follows by its smoothed
share of the bucket, so every text has a proper probability. Groups of pieces of documents learn side by side, and their
parameters are averaged after each of a few rounds. The rounds share out all pieces of all training documents, so the
model learns from every symbol, `PASSES` times at every size of corpus.

Counts cover all training texts. Words of the `HEAD` largest counts are looked up in every task, a table of bounded
size; all others meet their counts in a join, however many there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.bpe import Cache
from inkstone.llm.common import Kept, crc_mod, parts_for, widen

FOLDS = 10
HEAD = 131_072
#: Words that are symbols of their own: those of so many occurrences or more, at most WORDS. BUCKETS share the others.
WORDS, LEAST_SEEN, BUCKETS = 4095, 10, 512
SIZE, BACK = 24, 3
#: Symbols of a group that learns on its own, about, and of a piece of a text; all symbols of all groups are learned from.
TRAIN_SYMBOLS, PIECE = 2_400_000, 65_536
#: Groups that a task takes one after the other where there are very many: it sends the sum of what they learned.
TOGETHER = 8
#: Numbers of a vector that travel as one value.
CHUNK = 16_384
#: A pass over the training texts has so many rounds, each over texts of its own, after which groups are averaged.
ROUNDS, NOISE = 3, 10
#: How often a group goes over its pieces of a round.
PASSES = 1
#: Rows and columns of the counts that symbols are put into classes by: preceding symbols are taken modulo this.
SKETCH = 256
ALPHA = 0.1
END = " "  # no word
#: Bytes of texts that are cut into words at once, about.
TOGETHER_BYTES = 8_000_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, with A-Z in lower case, and where each text's words begin (one more: where the last ends)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    some = pc.greater(pc.binary_length(found), 0)  # white space at either end of a text leaves an empty word there
    if pc.all(some).as_py() is not False:
        return found, starts
    return found.filter(some), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[starts]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold TOGETHER_BYTES at most, or one row: the first row and the one after the last."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES, "right")))
        yield at, end
        at = end


def bucket(word: bytes) -> int:
    """By the last two letters."""
    last = word[-2:]
    return zlib.crc32(last if last.isascii() else word.decode("utf-8", "replace")[-2:].encode()) % BUCKETS


def bucket_of(word: str) -> F.Column:
    """The same of a column; -1 for the end."""
    return F.when(F.col(word) == END, -1).otherwise(F.crc32(F.expr(f"right(`{word}`, 2)").cast("binary")) % BUCKETS).cast("int")


def token_counts(docs: DataFrame) -> DataFrame:
    """word, bucket, c: counts over the rows of docs (text); the end counts once for each row. Tasks sum up first."""

    def run(batches):
        for b in batches:
            texts = b.column(0)
            for at, end in slices(texts):
                counts = words(texts.slice(at, end - at))[0].value_counts()
                of, n = counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([of, pa.array([END])]), pa.concat_arrays([n, pa.array([end - at], pa.int64())])], names=["word", "c"])

    summed = docs.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return summed.select("word", bucket_of("word").alias("bucket"), "c")


@dataclass
class Model:
    """Symbols: 0 to w-1 words, w to w+BUCKETS-1 buckets, then the end; the start of a text is one more row of `back`."""

    symbols: int
    cls: np.ndarray  # class of each symbol
    place: np.ndarray  # its place within the class
    members: list[np.ndarray]
    back: np.ndarray  # BACK x (symbols + 1) x SIZE: scaled context vectors
    class_vectors: np.ndarray  # classes x SIZE
    class_bias: np.ndarray
    vectors: list[np.ndarray]  # of each class's members
    bias: list[np.ndarray]

    @cached_property
    def with_bias(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """back, class_vectors and vectors with one more column: one in all for a context, the bias for what may follow."""
        one = np.zeros((*self.back.shape[:2], 1), np.float32)
        one[0] = 1
        wider = lambda v, b: np.column_stack([v, b]).astype(np.float32)
        return np.concatenate([self.back, one], 2), wider(self.class_vectors, self.class_bias), [wider(v, b) for v, b in zip(self.vectors, self.bias, strict=True)]

    def log10(self, ids: np.ndarray, context: np.ndarray, together: int = 16_384) -> np.ndarray:
        """log10 probability of each symbol after the BACK symbols before it (rows of context, nearest first)."""
        out = np.empty(len(ids))
        small = self.cls.astype(np.int16)
        back, class_vectors, vectors = self.with_bias
        # what no score can exceed, but for a context's length
        longest = [float(np.sqrt((v * v).sum(1).max())) for v in (class_vectors, *vectors)]
        for at in range(0, len(ids), together):
            y, x = ids[at : at + together], context[at : at + together]
            order = np.argsort(small[y], kind="stable")  # class by class
            y = y[order]
            c, place = small[y], self.place[y]
            q = back[0].take(x[:, 0][order], 0)
            for i in range(1, BACK):
                q += back[i].take(x[:, i][order], 0)
            length = float(np.sqrt(np.einsum("ij,ij->i", q, q).max()))
            lp = _log_softmax_at(q @ class_vectors.T, c, length * longest[0])
            bounds = np.searchsorted(c, np.arange(len(self.members) + 1)).tolist()
            for k, (i, j) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
                if i < j:
                    lp[i:j] += _log_softmax_at(q[i:j] @ vectors[k].T, place[i:j], length * longest[k + 1])
            out[at + order] = lp
        return out / math.log(10)


def _log_softmax_at(scores: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """Log of the softmax of each row's scores at one place; overwrites scores. bound: none is further from zero."""
    if not bound < 80 and (scores.max(initial=0) > 80 or scores.min(initial=0) < -80):  # else no power of e leaves the range of numbers
        scores -= scores.max(1, keepdims=True)
    own = scores[np.arange(len(at)), at]
    return own - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))


def contexts(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The BACK symbols before each position, nearest first; `start` before a text's beginning. first: where texts begin."""
    n = len(ids)
    out = np.empty((BACK, n), np.int64)
    for i in range(BACK):
        out[i, i + 1 :] = ids[: max(n - i - 1, 0)]
        for j in range(i + 1):  # a shorter text's next one begins there, with even fewer before it
            at = first + j
            out[i, at[at < n]] = start
    return out.T


def pairs(ids: np.ndarray, context: np.ndarray, m: int) -> np.ndarray:
    """How often each symbol stands after symbols of each remainder modulo SKETCH, at any of the BACK distances (m x SKETCH, flat)."""
    rows = ids * SKETCH
    return sum(np.bincount(rows + context[:, i] % SKETCH, minlength=m * SKETCH) for i in range(BACK))


def classes(seen: np.ndarray) -> np.ndarray:
    """Halves symbols along the main direction of what stands before them until there are about as many classes as members of each.

    seen: for each symbol, counts of the symbols before it.
    """
    m = len(seen)
    levels = max(1, round(math.log2(m) / 2))
    seen = np.sqrt(seen / np.maximum(seen.sum(1, keepdims=True), 1)).astype(np.float32)
    groups = [np.arange(m)]
    for _ in range(levels):
        halves = []
        for g in groups:
            x = seen[g] - seen[g].mean(0)
            v = x.sum(0) + 1e-3
            for _ in range(8):
                v = x.T @ (x @ v)
                v = v / (np.linalg.norm(v) + 1e-12)
            g = g[np.lexsort((g, x @ v))]
            halves += [g[: len(g) // 2], g[len(g) // 2 :]]
        groups = [g for g in halves if len(g)]
    out = np.empty(m, np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad; parameters are one flat vector, so that those of several tasks can be averaged.

    Noise stands for its expectation: classes by their share and a class's symbols by theirs, NOISE of each to a position.
    Vectors of symbols stand class by class; the last column of vectors of classes and symbols is their bias.
    """

    def __init__(self, counts: np.ndarray, seen: np.ndarray):
        m = self.m = len(counts)
        self.cls = classes(seen)
        k = self.k = int(self.cls.max()) + 1
        self.members = [np.flatnonzero(self.cls == c) for c in range(k)]
        self.low = np.concatenate([[0], np.cumsum([len(g) for g in self.members])])
        self.place = np.empty(m, np.int64)
        for g in self.members:
            self.place[g] = np.arange(len(g))
        p = counts + 0.5
        of_class = np.bincount(self.cls, p, k)
        share = of_class / of_class.sum()
        self.log_class, self.noise_class = np.log(share).astype(np.float32), (NOISE * share).astype(np.float32)
        own = (p / of_class[self.cls])[np.concatenate(self.members)]  # class by class
        self.noise_own, self.log_own = (NOISE * own).astype(np.float32), np.log(own).astype(np.float32)
        self.shapes = {"r": (m + 1, SIZE), "c": (BACK, SIZE), "qc": (k, SIZE + 1), "qw": (m, SIZE + 1)}
        self.size = sum(map(math.prod, self.shapes.values()))

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n, shape in self.shapes.items():
            out[n] = flat[at : (at := at + math.prod(shape))].reshape(shape)
        return out

    def start(self, seed: int = 13) -> np.ndarray:
        """Parameters, and then the sums of their squared gradients."""
        state = np.zeros(2 * self.size, np.float32)
        w = self.views(state)
        w["r"][:] = np.random.default_rng(seed).normal(0, 0.1, w["r"].shape)
        w["c"][:] = 1 / np.arange(1, BACK + 1)[:, None]
        w["qc"][:, SIZE], w["qw"][:, SIZE] = self.log_class, self.log_own
        state[self.size :] = 1e-2
        return state

    def learn(self, state: np.ndarray, ids: np.ndarray, context: np.ndarray, seed: object, rate: float = 0.15) -> None:
        """One pass over the symbols ids, in random order and about a hundred steps; changes state."""
        batch = min(8192, max(256, len(ids) // 100))
        w, g2 = self.views(state), self.views(state[self.size :])
        cls16, f, log_noise = self.cls.astype(np.int16), np.float32, np.float32(math.log(NOISE))
        flat = self.shapes["r"][0] * SIZE
        cells = np.arange(flat).reshape(-1, SIZE)
        one = np.zeros((BACK, len(cells), 1), f)
        one[0] = 1
        shift_c, shift_w = self.log_class + log_noise, self.log_own + log_noise

        def step(name: str, grad: np.ndarray, rate: float = rate) -> None:
            """Overwrites grad."""
            g2[name] += grad * grad
            grad *= f(rate)
            grad /= np.sqrt(g2[name])
            w[name] += grad

        def told_apart(minus: np.ndarray, noise: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Gradients of data (at) and noise (everywhere) from scores with their signs turned; overwrites them."""
            with np.errstate(over="ignore"):
                d = np.divide(-noise, np.add(np.exp(minus, out=minus), f(1), out=minus), out=minus)
            own = np.arange(0, d.size, d.shape[1]) + at
            true = d.ravel()[own]
            d.ravel()[own] = true + 1 + true / noise[at]
            return d

        order = np.random.default_rng(seed).permutation(len(ids))
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            some = some[np.argsort(cls16[ids[some]], kind="stable")]
            y, x = ids[some], [context[:, i][some] for i in range(BACK)]
            c, place = self.cls[y], self.place[y]
            back = np.concatenate([w["r"] * w["c"][:, None, :], one], 2)  # every context ends with a one
            q = back[0].take(x[0], 0)
            for i in range(1, BACK):
                q += back[i].take(x[i], 0)
            minus = -q
            v = w["qc"].copy()
            v[:, SIZE] -= shift_c
            d = told_apart(minus @ v.T, self.noise_class, c)
            d_q = d @ v[:, :SIZE]
            grad_c = d.T @ q
            grad, v = np.zeros_like(w["qw"]), w["qw"].copy()
            v[:, SIZE] -= shift_w
            bounds = np.searchsorted(c, np.arange(self.k + 1)).tolist()
            for k in range(self.k):
                i, j, lo, hi = bounds[k], bounds[k + 1], self.low[k], self.low[k + 1]
                if i < j:
                    e = told_apart(minus[i:j] @ v[lo:hi].T, self.noise_own[lo:hi], place[i:j])
                    d_q[i:j] += e @ v[lo:hi, :SIZE]
                    np.matmul(e.T, q[i:j], out=grad[lo:hi])
            grad_r, d_c = np.zeros_like(w["r"]), np.zeros_like(w["c"])
            wide = d_q.astype(np.float64).ravel()
            for i in range(BACK):
                sums = np.bincount(cells.take(x[i], 0).ravel(), wide, flat).astype(f).reshape(-1, SIZE)
                d_c[i] = np.einsum("ij,ij->j", sums, w["r"])
                sums *= w["c"][i]
                grad_r += sums
            for name, value in (("qc", grad_c), ("qw", grad), ("r", grad_r)):
                step(name, value)
            step("c", d_c, rate * 0.1)

    def model(self, state: np.ndarray) -> Model:
        w, low = self.views(state), self.low
        own = lambda x: [x[a:b].copy() for a, b in zip(low[:-1], low[1:], strict=True)]
        return Model(self.m, self.cls, self.place, self.members, w["c"][:, None, :] * w["r"][None], w["qc"][:, :SIZE].copy(), w["qc"][:, SIZE].copy(), own(w["qw"][:, :SIZE]), own(w["qw"][:, SIZE]))


def train(counts: np.ndarray, ids: np.ndarray, first: np.ndarray, epochs: int = 3, seed: int = 13) -> Model:
    """Learns from the symbols ids of texts that begin at `first`, in one process; counts: of all symbols in all training texts."""
    m = len(counts)
    context = contexts(ids, first, m)
    trainer = Trainer(counts, pairs(ids, context, m).reshape(m, SKETCH))
    state = trainer.start(seed)
    for epoch in range(epochs):
        trainer.learn(state, ids, context, (seed, epoch, 0))
    return trainer.model(state)


@dataclass
class Known:
    """What every task knows: head words with counts, symbols, and totals."""

    head: dict[bytes, tuple[int, int]]  # word -> (symbol or -1, count)
    n_words: int
    bucket_log: np.ndarray  # log10 of each bucket's smoothed total
    total: int
    log_total: float
    ends: int

    def records(self):
        """From distinct words to their symbols and log10 of their smoothed counts, not a number where only the join knows it."""
        names = pa.array(list(self.head), pa.binary()).cast(pa.string())
        symbols = np.array([*(symbol for symbol, _ in self.head.values()), -1], np.int64)
        logs = np.log10(np.array([*(c for _, c in self.head.values()), math.nan]) + ALPHA)

        def of(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            at = pc.fill_null(pc.index_in(found, value_set=names), -1).to_numpy()
            ids = symbols[at]
            rest = np.flatnonzero(ids < 0)
            last = pc.utf8_slice_codeunits(found.take(pa.array(rest)), -2).dictionary_encode()  # of a bucket: few
            buckets = np.array([bucket(w) for w in last.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            ids[rest] = self.n_words + buckets[last.indices.to_numpy()]
            return ids, logs[at]

        return of


def know(counts: DataFrame, head: int = HEAD, n_words: int = WORDS, least: int = LEAST_SEEN) -> tuple[Known, np.ndarray]:
    """Head words and totals from counts (word, bucket, c); symbols' counts.

    Head words are those of the largest counts, at most `head`, down to a step of a fine logarithmic scale.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    own = counts.where(F.col("word") != END)
    edge, room = None, head
    for r in sorted(own.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 64 * 16 rows
        room -= r["count"]
        if room < 0:
            break
        edge = r["level"]
    rows = own.where(level >= edge).select("word", "c").collect() if edge is not None else []  # at most `head`
    rows.sort(key=lambda r: (-r["c"], r["word"]))
    often = [r for r in rows[:n_words] if r["c"] >= least]
    names = [r["word"].encode() for r in often]
    of = {w: i for i, w in enumerate(names)}
    table = {r["word"].encode(): (of.get(r["word"].encode(), -1), r["c"]) for r in rows}
    sums = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # a row for each bucket
    n_b, v_b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    total = distinct = ends = 0
    for r in sums:
        total, distinct = total + r["n"], distinct + r["v"]
        if r["bucket"] < 0:
            ends = r["n"]
        else:
            n_b[r["bucket"]], v_b[r["bucket"]] = r["n"], r["v"]
    for r in often:
        b = bucket(r["word"].encode())
        n_b[b] -= r["c"]
        v_b[b] -= 1
    symbols = np.concatenate([[r["c"] for r in often], n_b, [ends]])
    return Known(table, len(names), np.log10(n_b + ALPHA * (v_b + 1)), total, math.log10(total + ALPHA * (distinct + 1)), ends), symbols


def coded(docs: DataFrame, known: Known) -> DataFrame:
    """docs (key, text, held_out) as symbols: one row for each row, and what is known of its base score without a join.

    row: a number of its own; pieces: the symbols in order, PIECE to a piece, each after the first led by the BACK
    symbols before it; base, n_known: of head words and the end; inner: log10 of head words' shares of their buckets;
    words, times: words that only the join knows, which add to base and inner alike.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(known)
    end = known.n_words + BUCKETS
    kind = docs.schema["key"].dataType.simpleString()
    types = StructType.fromDDL(f"row bigint, key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, inner double, pieces array<binary>, words array<string>, times array<bigint>")
    schema = to_arrow_schema(types)

    def run(batches):
        known = shared.value
        records = known.records()
        Cache.only()
        row = TaskContext.get().partitionId() << 40
        log_end = math.log10(known.ends + ALPHA)

        def out(key: pa.Array, text: pa.Array, held: pa.Array) -> pa.RecordBatch:
            nonlocal row
            found, starts = words(text)
            found = found.dictionary_encode()
            names, rows = found.dictionary.cast(pa.string()), len(starts) - 1
            # of each distinct word, and then of the end
            ids, logs = (np.append(a, b) for a, b in zip(records(names), (end, log_end), strict=True))
            missing = np.isnan(logs)
            logs[missing] = 0
            other = (ids >= known.n_words) & (ids < end)
            inner = np.zeros(len(ids))
            inner[other] = logs[other] - known.bucket_log[ids[other] - known.n_words]
            # each text's words and its end
            n = np.diff(starts) + 1
            first = starts[:-1] + np.arange(rows)
            codes = np.full(int(n.sum()), len(names))
            ends = np.zeros(len(codes), bool)
            ends[first + n - 1] = True
            codes[~ends] = found.indices.to_numpy()
            sums = lambda of: np.add.reduceat(of[codes], first)
            own = ids.astype("<u2")[codes]
            pieces = [[own[a + max(p - BACK, 0) : a + min(p + PIECE, k)].tobytes() for p in range(0, k, PIECE)] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            at = np.flatnonzero(missing[codes])
            tail, times = np.unique(np.repeat(np.arange(rows), n)[at] * len(ids) + codes[at], return_counts=True)
            bounds = pa.array(np.searchsorted(tail, np.arange(rows + 1) * len(ids)), pa.int32())
            n_known = n - 1 - sums(missing.astype(np.int64)) + (known.ends > 0)
            numbers = np.arange(row + 1, row + 1 + rows)
            row += rows
            lists = [pa.ListArray.from_arrays(bounds, v) for v in (names.take(pa.array(tail % len(ids))), pa.array(times, pa.int64()))]
            columns = [numbers, key, held, n, n_known, sums(logs) - n * known.log_total, sums(inner), pieces, *lists]
            return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for at, to in slices(b.column(1)):
                yield out(*(b.column(i).slice(at, to - at) for i in range(3)))

    return docs.select("key", "text", "held_out").mapInArrow(run, types)


def joined(pieces: list[tuple[int, bytes]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of pieces (lead, ids) and the symbols before each; the first `lead` of a piece only come before."""
    sizes = np.array([len(d) // 2 for _, d in pieces])
    first = np.cumsum(sizes) - sizes
    ids = np.frombuffer(b"".join([d for _, d in pieces]), "<u2").astype(np.int64)
    own = np.ones(len(ids), bool)
    for at, (lead, _) in zip(first.tolist(), pieces, strict=True):
        if lead:
            own[at : at + lead] = False
    before = contexts(ids, first, m)
    return (ids, before) if own.all() else (ids[own], before[own])


def blocks(batches, most: int):
    """(g, pieces) of rows (g, lead, ids, times) that come in order of g: a group's pieces, some `most` symbols at a time."""
    g, pieces, n = None, [], 0
    for b in batches:
        for group, lead, data, times in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            for _ in range(times):
                if pieces and (group != g or n >= most):
                    yield g, pieces
                    pieces, n = [], 0
                g = group
                pieces.append((lead, data))
                n += len(data) // 2
    if pieces:
        yield g, pieces


def deal(texts: DataFrame, rounds: int, groups: int) -> DataFrame:
    """round, g, h, lead, ids, times: the pieces of texts (pieces: as `coded` has them), dealt to rounds and groups.

    Cells follow from a piece's symbols and its number among equal ones, so they are a function of the table, and equal
    pieces spread over cells. More copies of a piece than there are cells go to all cells evenly, `times` to a cell.
    """
    cells = rounds * groups
    own = texts.select(F.posexplode("pieces").alias("piece", "ids")).select(F.when(F.col("piece") > 0, BACK).otherwise(0).alias("lead"), "ids").groupBy("lead", "ids").agg(F.count("*").alias("n"))
    each = own.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n"), F.lit(cells)) - 1)))
    many = F.col("n") > cells
    h = F.xxhash64("ids", "lead", "copy")
    cell = F.when(many, F.col("copy")).otherwise(F.pmod(h, F.lit(cells)))
    times = F.when(many, F.floor((F.col("n") - F.col("copy") - 1) / cells) + 1).otherwise(1)
    return each.select((cell % rounds).cast("int").alias("round"), F.floor(cell / rounds).cast("int").alias("g"), h.alias("h"), "lead", "ids", times.cast("bigint").alias("times"))


def fit(texts: DataFrame, known: Known, symbols: np.ndarray, kept: Kept, rounds: int = ROUNDS, passes: int = PASSES, seed: int = 13) -> Model:
    """Learns the neural part from all symbols of texts (pieces: as `coded` has them), each of its `rounds` from a share of them.

    A group has about TRAIN_SYMBOLS symbols in all. In a round every group goes on from the same parameters over its
    pieces, `passes` times; the mean of what the groups end with, by their symbols, begins the next round. Groups and
    the order of their pieces follow from the pieces alone, so partitions change nothing but roundings of sums.
    """
    m, n_groups, most = len(symbols), parts_for(known.total, TRAIN_SYMBOLS), TRAIN_SYMBOLS // 2
    if not known.total:
        return train(symbols, np.array([m - 1]), np.array([0]), 1, seed)
    tasks = max(min(n_groups, 4 * texts.sparkSession.sparkContext.defaultParallelism), parts_for(n_groups, TOGETHER))
    dealt = kept.keep(deal(texts, rounds, n_groups), "round")

    def sums(values: np.ndarray):
        """A task's vector in chunks; those of zeros stay out."""
        parts = [(i, values[at : at + CHUNK]) for i, at in enumerate(range(0, len(values), CHUNK))]
        parts = [(i, v.astype("<f8").tobytes()) for i, v in parts if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.binary())], names=["i", "v"])

    def added(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, "<f8") for v in t.column("v").to_pylist()], 0)
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    def total(rows: DataFrame, run, n: int) -> np.ndarray:
        """Sums over all tasks of a vector of fixed size: a chunk of it is a task's work, with a row of each task that learned."""
        found = rows.select("g", "lead", "ids", "times").mapInArrow(run, "i int, v binary").groupBy("i").applyInArrow(added, "i int, v binary").toArrow()
        out = np.zeros(n)
        for i, v in zip(found.column("i").to_pylist(), found.column("v").to_pylist(), strict=True):
            out[i * CHUNK : i * CHUNK + len(v) // 8] = np.frombuffer(v, "<f8")
        return out

    def count(batches):
        seen = np.zeros(m * SKETCH)
        for _, pieces in blocks(batches, most):
            seen += pairs(*joined(pieces, m), m)
        yield from sums(seen)

    trainer = Trainer(symbols, total(dealt.withColumn("g", F.lit(0)), count, m * SKETCH).reshape(m, SKETCH))
    state = trainer.start(seed)
    for r in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((trainer, state))

        def learn(batches, r: int = r, shared=shared):
            trainer, begin = shared.value
            out, group, own, n, k = np.zeros(len(begin) + 1), None, begin, 0, 0
            for g, pieces in blocks(batches, most):
                if g != group:
                    out += n * np.append(own, 1.0)
                    group, own, n, k = g, begin.copy(), 0, 0
                ids, context = joined(pieces, m)
                for again in range(passes):
                    trainer.learn(own, ids, context, (seed, r, g, k, again))
                n, k = n + len(ids), k + 1
            out += n * np.append(own, 1.0)
            if out[-1]:
                yield from sums(out)

        # dealt anew for each round: a group is one task's work however the stored files are split
        rows = dealt.where(F.col("round") == r).repartition(tasks, "g").sortWithinPartitions("g", "h", "lead", "ids")
        mean = total(rows, learn, len(state) + 1)
        if mean[-1]:
            state = (mean[:-1] / mean[-1]).astype(np.float32)
        shared.unpersist()
    kept.drop(dealt)
    return trainer.model(state)


def log_probabilities(texts: DataFrame, model: Model) -> DataFrame:
    """texts (as `coded` has them) with neural: log10 probability of each text's symbols; words, times and pieces fall out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = texts.sparkSession.sparkContext.broadcast(model)
    own = texts.select("row", "key", "held_out", "n_tokens", "n_known", "base", "inner", "pieces")
    types = own.drop("pieces").schema.add("neural", "double")
    schema = to_arrow_schema(types)

    def run(batches):
        model = shared.value
        for b in batches:
            found: list[float] = []
            for at in range(0, b.num_rows, 128):
                texts = b.column(b.num_columns - 1).slice(at, 128).to_pylist()
                pieces = [(BACK if i else 0, p) for t in texts for i, p in enumerate(t)]
                ids, context = joined(pieces, model.symbols)
                sizes = np.array([sum(len(p) // 2 for p in t) - BACK * (len(t) - 1) for t in texts])
                found += np.add.reduceat(model.log10(ids, context), np.cumsum(sizes) - sizes).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], schema=schema)

    return own.mapInArrow(run, types)


def score(docs: DataFrame, folds: int = FOLDS, head: int = HEAD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    A null text counts as the empty one, whose only token is the end; repeated rows are counted and scored each for
    itself. Without training documents all counts are zero. A null key counts as the empty text when folds are dealt
    (and so is held out). Other columns aren't read. Scores are a function of the table's rows, whatever partitions they
    come in; only roundings of sums differ in the last digits.
    """
    kept = Kept(docs.sparkSession)
    own = widen(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).withColumn("held_out", crc_mod("key", folds) == 0)
    counts = kept.keep(token_counts(own.where("NOT held_out").select("text")))
    known, symbols = know(counts, head)
    texts = kept.keep(coded(own, known))
    model = fit(texts.where("NOT held_out"), known, symbols, kept)
    scored = kept.keep(log_probabilities(texts, model))
    # words outside the head meet their counts; the end and head words have met theirs
    tail = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    tail = tail.join(counts.select(F.col("word").alias("word_"), "c"), F.col("word") == F.col("word_"), "left")
    c = F.coalesce("c", F.lit(0))
    more = kept.keep(tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + ALPHA)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known")))
    kept.only(scored, more)
    out = scored.join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(known.total).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("neural") + F.col("inner") + more).alias("score"))
