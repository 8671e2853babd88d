"""Compression of vectors to codes: product quantisation by Lloyd's rounds over weighted distinct parts, in whole numbers.

A vector's components become integers, and the vector is cut into equal parts. Equal parts of one position are one
weighted row, however many vectors have them; each round assigns these rows to the nearest entries of the codebooks, which
are small and go to every task, and moves each entry to the mean of its rows. Tasks sum up weighted rows themselves,
so that a round brings one row for each entry to the driver. At last codes and errors are joined back to the vectors: parts
that very many vectors have (at most `HOT` at a position) are broadcast, the rest are joined by shuffle.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, widen

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers lie within this: squared distances and their sums over a vector then fit in 64 bits for up to 2**11 components.
LARGEST = 1 << 24
#: A value is hot where more than one of so many rows has it; there can't be more hot values than that.
HOT = 1000


def to_parts(vectors: list[list | None], dim: int, parts: int, scale: int) -> list[list[bytes]]:
    """The parts of each vector as bytes of 32-bit integers; vectors are padded with zeros to a multiple of `parts`."""
    wide = -(-dim // parts) * parts
    x = np.floor(np.array(vectors, np.float64).reshape(len(vectors), dim) * scale)
    if (np.abs(x) > LARGEST).any():
        raise ValueError(f"components beyond {LARGEST // scale} are too large for exact sums")
    x = np.pad(x, ((0, 0), (0, wide - dim))).astype("<i4")
    size = wide // parts * 4
    return [[row[i : i + size] for i in range(0, len(row), size)] for row in map(np.ndarray.tobytes, x)]


def nearest(x: np.ndarray, book: np.ndarray, together: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equally near ones, and its squared distance."""
    at, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(0, len(x), together):
        some = slice(i, i + together)
        d = np.stack([((x[some] - entry) ** 2).sum(1) for entry in book], 1)
        at[some] = d.argmin(1)
        error[some] = d[np.arange(len(d)), at[some]]
    return at, error


def matrix(column: pa.Array) -> np.ndarray:
    """Parts of one position as rows of integers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


def positions(batch: pa.RecordBatch):
    """(position, rows of the batch at it)."""
    at = batch.column(0).to_numpy()
    for p in np.unique(at):
        yield int(p), np.flatnonzero(at == p)


def moved(books: list[np.ndarray], distinct: DataFrame) -> list[np.ndarray]:
    """The codebooks after one round over distinct parts (position, part, weight): means rounded down, unused entries stay."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        books = shared.value
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]  # the last column: weights
        for batch in batches:
            for p, rows in positions(batch):
                x, w = matrix(batch.column(1).take(pa.array(rows))), batch.column(2).to_numpy()[rows]
                at, _ = nearest(x, books[p])
                np.add.at(total[p], at, np.column_stack([x * w[:, None], w]))
        found = [(p, e, row.tolist()) for p, t in enumerate(total) for e, row in enumerate(t) if row[-1]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["position", "entry", "sums"])

    rows = distinct.select("position", "part", "weight").mapInArrow(sums, "position int, entry int, sums array<bigint>")
    # component by component, in decimals: sums over very many rows stay exact
    each = rows.select("position", "entry", F.posexplode("sums").alias("i", "v")).groupBy("position", "entry", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    new = [b.copy() for b in books]
    found: dict = {}
    for r in each.collect():  # entries times components
        found.setdefault((r["position"], r["entry"]), {})[r["i"]] = int(r["v"])
    for (p, e), total in found.items():
        n = total.pop(books[p].shape[1])
        new[p][e] = [total[i] // n for i in range(books[p].shape[1])]
    shared.unpersist()
    return new


def assigned(books: list[np.ndarray], distinct: DataFrame) -> DataFrame:
    """distinct with entry and error of each part."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, rows in positions(batch):
                entry[rows], error[rows] = nearest(matrix(batch.column(1).take(pa.array(rows))), shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry, pa.int32()), pa.array(error)], names=["position", "part", "weight", "entry", "error"])

    return distinct.select("position", "part", "weight").mapInArrow(run, "position int, part binary, weight bigint, entry int, error bigint")


def join_back(rows: DataFrame, values: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with values, one row for each value of `on` (nulls equal): hot ones are broadcast, the rest shuffled.

    weight: how many of `total` rows have a value. Hot values are more than one HOT-th of them each, so there are fewer than HOT.
    """
    rest = [c for c in values.columns if c not in on]
    named = values.select(*(F.col(c).alias(f"{c}_of_value") for c in on), *rest)
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_value")) for c in on]
    hot = F.col(weight) * HOT > total
    met = rows.join(F.broadcast(named.where(hot)), same, "left")
    # a value's weight is never null
    far = met.where(F.col(weight).isNull()).select(*rows.columns).join(named.where(~hot), same)
    return met.where(F.col(weight).isNotNull()).select(*rows.columns, *rest).unionByName(far.select(*rows.columns, *rest))


def books_digest(books: list[np.ndarray]) -> str:
    """Hex hash of all components in decimals, by part, entry and place, with commas between."""
    return sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def fit(vectors: DataFrame, distinct: DataFrame, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks after `rounds` rounds, from the parts of the vectors of the smallest keys (those without a key last)."""
    first = vectors.orderBy(F.col("key").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = [np.stack([np.frombuffer(r["parts"][p], "<i4") for r in first]).astype(np.int64) for p in range(len(first[0]["parts"]))] if first else []
    for _ in range(rounds if books else 0):
        books = moved(books, distinct)
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: one row for each row whose vector is whole.

    A vector that is null, empty or holds null or non-finite components is dropped, and so is one of another length than that of
    the smallest key's. Components x become floor(scale * x), which may not pass LARGEST (an error otherwise); lengths that
    `parts` doesn't divide are padded with zeros. Codebooks begin with the `entries` smallest keys' parts (rows of one
    key by their parts, rows without one last), fewer where there are fewer rows. Equally near entries give the lowest.
    code: the entries' numbers in two hex digits each. label_error: errors summed over equal labels, null ones together.
    Repeated rows are rows of their own and count each. Other columns aren't read. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    kept = Kept(spark)
    v = F.col("v")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    kinds = {n: df.schema[c].dataType.simpleString() for n, c in (("key", key), ("label", label))}
    own = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).where(good)
    lowest = own.orderBy(F.col("key").asc_nulls_last(), F.size(v)).select(F.size(v).alias("n")).head()
    dim = lowest["n"] if lowest else 0

    def cut(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to_parts(b.column(2).to_pylist(), dim, parts, scale), pa.list_(pa.binary()))], names=["key", "label", "parts"])

    whole = widen(own.where(F.size(v) == dim)).mapInArrow(cut, f"key {kinds['key']}, label {kinds['label']}, parts array<binary>")
    whole = kept.keep(whole.withColumn("row", F.monotonically_increasing_id()))
    total = whole.count()
    distinct = kept.keep(whole.select(F.posexplode("parts").alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("weight")))
    books = fit(whole, distinct, entries, rounds)
    coded = kept.keep(assigned(books, distinct))
    each = join_back(whole.select("row", F.posexplode("parts").alias("position", "part")), coded, ["position", "part"], "weight", total)
    codes = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("entries"), F.sum("error").alias("error"))
    text = F.lower(F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e["entry"]), 2, "0")), ""))
    rows = kept.keep(whole.select("row", "key", "label").join(codes.select("row", text.alias("code"), "error"), "row").drop("row"))
    labels = kept.keep(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    kept.only(rows, labels)
    out = join_back(rows, labels, ["label"], "n", total)
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
