"""Embedding near-dedup by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard transform and takes the nearest corner of the
cross-polytope: the coordinate of largest magnitude and its sign. `width` hashes make a bucket of a table; each vector
stands in its home bucket and, by multiprobe, in the buckets that the next-best corners give. Pairs within a bucket are
candidates; each is verified by its cosine in double precision, in tiles of bounded size.

Equal vectors are one node from the start. Ids and codes find the buckets that two vectors or more share; only for those
do vectors travel. A verified pair counts in the smallest bucket that its vectors share, so that links are counted once
without a list of pairs: buckets give sums for each vector and a spanning forest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, widen
from inkstone.llm.components import components
from inkstone.llm.tiles import forest, map_units, units

COSINE = 0.9
#: Share of pairs at the very limit that must meet in a bucket, and numbers of further buckets that a table may probe.
RECALL, PROBES, SEED = 0.998, (4, 8, 16, 32), 7
TILE = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose size is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def width_for(n: int, size: int) -> int:
    """Hashes of a bucket, so that a bucket holds a few of n vectors that aren't alike."""
    return max(1, math.ceil(math.log(max(1.25 * n, 2)) / math.log(2 * size)))


def pairs_at(cosine: float, dim: int, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors of a given cosine."""
    rng = np.random.default_rng(seed)
    a = unit_rows(rng.normal(size=(n, dim)))
    g = rng.normal(size=(n, dim))
    g -= (g * a).sum(1, keepdims=True) * a
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * unit_rows(g)


@functools.cache
def reach(width: int, dim: int, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> tuple[int, int, int]:
    """(width, tables, probes) that bring `recall` of pairs at the very limit `cosine` together, by simulation, at the fewest rows.

    Tables and probes follow the width, so links don't get lost in large inputs. Where few dimensions don't allow the
    width, it is made smaller, and tiles take the larger buckets.
    """
    if dim == 1:  # equal signs are all that counts
        return 1, 1, 0
    a, b = pairs_at(cosine, dim, 500)
    for w in range(width, 0, -1):
        for tables in (16, 48):
            ca, cb = (buckets(x, w, tables, PROBES[-1], seed).reshape(len(x), tables, -1) for x in (a, b))
            best = None
            for probes in PROBES:
                x, y = ca[:, :, : 1 + probes], cb[:, :, : 1 + probes]
                met = np.stack([(x[:, t, :, None] == y[:, t, None, :]).any((1, 2)) for t in range(tables)], 1)
                found = np.flatnonzero(np.maximum.accumulate(met, 1).mean(0) >= recall)
                if len(found) and (best is None or (found[0] + 1) * (1 + probes) < best[0]):
                    best = ((found[0] + 1) * (1 + probes), int(found[0]) + 1, probes)
            if best:
                return w, best[1], best[2]
    raise ValueError(f"no buckets bring pairs of {dim} dimensions at cosine {cosine} together")


def buckets(x: np.ndarray, width: int, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket codes (rows, tables * (1 + probes)); the table stands in the upper bits, so smaller means an earlier table.

    Codes depend on the vector alone: every task computes the same ones. A table's first code is its home bucket; where
    there are fewer buckets than probes, all are taken.
    """
    dim = x.shape[1]
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    choices = min(3, size)
    combos = np.stack(np.meshgrid(*[np.arange(choices)] * width, indexing="ij"), -1).reshape(-1, width)
    take = min(1 + probes, len(combos))
    out = np.empty((len(x), tables * take), np.int64)
    for t in range(tables):
        corner, gap = [], []
        for _ in range(width):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / math.sqrt(size)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :choices]
            value = np.take_along_axis(y, best, 1)
            corner.append(2 * best + (value < 0))
            gap.append(np.abs(value[:, :1]) - np.abs(value))
        cost = sum(gap[i][:, combos[:, i]] ** 2 for i in range(width))
        picked = np.argsort(cost, axis=1, kind="stable")[:, :take]  # the home bucket costs nothing and comes first
        code = np.zeros(picked.shape, np.int64)
        for i in range(width):
            code = code * (2 * size) + np.take_along_axis(corner[i], combos[picked, i], 1)
        mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8) if (2 * size) ** width >= 1 << 56 else code.astype(np.uint64)
        out[:, t * take : (t + 1) * take] = (np.int64(t) << np.int64(56)) | mixed.astype(np.int64)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Entries of a comparison of codes at once, and the largest unit that is compared as a list of pairs.
AT_ONCE, SMALL = 4_000_000, 64


def share_earlier(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of codes (padded with -1) have a code in common, for each pair."""
    out = np.zeros(len(a), bool)
    step = max(1, AT_ONCE // max(1, codes.shape[1] ** 2))
    for at in range(0, len(a), step):
        x, y = codes[a[at : at + step]], codes[b[at : at + step]]
        out[at : at + step] = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2))
    return out


def small_links(x: np.ndarray, codes: np.ndarray, side: np.ndarray, tiled: np.ndarray, bounds: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, new) of the links within small units, all units at once; new: those that no earlier bucket has counted.

    Of a unit of two tiles (tiled) only pairs between them count.
    """
    end = np.repeat(bounds[1:], np.diff(bounds))
    n = end - np.arange(len(x)) - 1
    a = np.repeat(np.arange(len(x)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
    counts = ~tiled[a] | (side[a] != side[b])
    a, b = a[counts], b[counts]
    near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]]) >= cosine for i in range(0, len(a), 50_000))])
    a, b = a[near], b[near]
    return a, b, ~share_earlier(codes, a, b)


def large_links(x: np.ndarray, codes: np.ndarray, side: np.ndarray | None, cosine: float, columns: int = 2048) -> tuple[np.ndarray, np.ndarray] | None:
    """(linked, new): matrices of the links within one unit, and of those that no earlier bucket has counted."""
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    values, place = np.unique(codes, return_inverse=True)
    place = place.reshape(codes.shape)
    often = np.flatnonzero((np.bincount(place.ravel(), minlength=len(values)) > 1) & (values >= 0))
    new = linked.copy()
    for at in range(0, len(often), columns):
        column = np.full(len(values), -1)
        column[often[at : at + columns]] = np.arange(len(often[at : at + columns]))
        where = column[place]
        member = np.zeros((len(x), columns), np.float32)
        rows, cols = np.nonzero(where >= 0)
        member[rows, where[rows, cols]] = 1
        new &= ~(member @ member.T > 0)
    return linked, new


def near_duplicates(df: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED, tile: int = TILE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, n_links, component_id, kept: one row for each row of df.

    A vector that is null, empty, zero or holds null or non-finite components has no links. Vectors of different lengths
    aren't linked. Rows that repeat a key or a vector count as vectors of their own; a null key's component is the
    smallest key of its component, null if there is none. Other columns aren't read. `recall` of the pairs at the very
    limit meet in a bucket, and more of those above it; with 1 no pair is left out: all are compared, quadratic work.
    """
    spark = df.sparkSession
    kept = Kept(spark)
    v = F.col("v")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    # single precision is kept where the table has it, and widened by each task
    item = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{item}>").alias("v"))
    # zeros of either sign are equal; the text of a vector is a short key for grouping equal ones
    rows = rows.select("key", F.when(good, F.transform(v, lambda c: c + F.lit(0.0).cast(item))).alias("v")).withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256)))
    rows = kept.keep(rows)
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.first("v").alias("v"), F.min("key").cast("bigint").alias("rep"), F.count("*").alias("n"))
    classes = kept.keep(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vector
    plans = {d: reach(width_for(n, 1 << max(1, (d - 1).bit_length())), d, cosine, recall, seed) for d, n in sizes.items()} if recall < 1 else {}

    def hashed(parts):
        for pdf in parts:
            codes: list = [None] * len(pdf)
            for d, at in pdf.groupby("dim").indices.items():
                x = unit_rows(np.array([pdf["v"].iloc[j] for j in at], float))
                for i, c in zip(at, buckets(x, *plans[d], seed), strict=True):
                    codes[i] = c
            yield pd.DataFrame({"id": pdf["id"], "band": pdf["dim"], "codes": codes})

    if recall >= 1:  # all pairs of vectors of one length, tile by tile
        placed = kept.keep(classes.select("id", F.col("dim").alias("band"), F.lit(0).cast("bigint").alias("bucket")))
    else:
        placed = widen(classes.select("id", "dim", "v")).mapInPandas(hashed, "id bigint, band int, codes array<bigint>")
        placed = kept.keep(placed.select("id", "band", F.explode("codes").alias("bucket")))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    placed = kept.keep(placed.join(shared, "bucket", "left_semi"))
    # each row carries the shared codes before its own
    own = placed.groupBy("id", "band").agg(F.array_sort(F.collect_list("bucket")).alias("codes")).join(classes.select("id", "n", "v"), "id")
    own = own.select("id", "band", "n", "v", "codes", F.posexplode("codes").alias("at", "bucket"))
    # lengths of vectors are bands of a bucket; only those of one length are compared
    dealt = units(own.select("id", "band", "n", "v", "bucket", F.slice("codes", F.lit(1), F.col("at")).alias("codes")), placed, kept, tile, 0, "id")

    def run(t: pa.Table, bounds: np.ndarray) -> dict | None:
        ids, n, side, band = (t.column(c).to_numpy() for c in ("id", "n", "side", "band"))
        lists = t.column("codes").combine_chunks()
        flat, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
        codes = np.full((len(ids), max(1, int(size.max(initial=0)))), -1, np.int64)
        codes[np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        lists = t.column("v").combine_chunks()
        flat, start = np.asarray(lists.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        links, pairs = np.zeros(len(ids), np.int64), []
        vectors = lambda at: unit_rows(flat[start[at][:, None] + np.arange(start[at[0] + 1] - start[at[0]])])
        small = np.diff(bounds) <= SMALL
        tiled = t.column("tile_a").to_numpy() != t.column("tile_b").to_numpy()
        for d in np.unique(band):
            at = np.flatnonzero((band == d) & np.repeat(small, np.diff(bounds)))
            if len(at) > 1:
                unit = np.searchsorted(bounds, at, "right")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(at)]])
                a, b, new = small_links(vectors(at), codes[at], side[at], tiled[at], edges, cosine)
                np.add.at(links, at[a[new]], n[at[b[new]]])
                np.add.at(links, at[b[new]], n[at[a[new]]])
                pairs.append((at[a], at[b]))
        for lo, hi in zip(bounds[:-1][~small], bounds[1:][~small], strict=True):
            for d in np.unique(band[lo:hi]):
                at = lo + np.flatnonzero(band[lo:hi] == d)
                if len(at) > 1 and (found := large_links(vectors(at), codes[at], side[at] if tiled[at[0]] else None, cosine)):
                    linked, new = found
                    links[at] += new @ n[at]
                    label = forest(len(at), *np.nonzero(np.triu(linked)))
                    pairs.append((at, at[label]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        if not len(a):
            return None
        label = forest(len(ids), a, b)
        touched = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return {"id": ids[touched], "links": links[touched], "root": ids[label[touched]]}

    found = kept.keep(map_units(dealt, "id bigint, links bigint, root bigint", run, ["id", "n", "band", "v", "codes"]))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), kept)
    named = classes.select("id", "digest", "rep", "n").join(sums, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = kept.keep(named.select("digest", "rep", "n", "links", F.coalesce("component", "id").alias("component")))
    kept.only(rows, named)
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    classed = named.join(smallest, "component").select(F.col("digest").alias("digest_"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "smallest")
    own = F.col("key").cast("bigint")
    out = rows.select("key", "digest").join(classed, F.col("digest") == F.col("digest_"), "left")
    component = F.coalesce("smallest", own)
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == own, F.lit(False)).alias("kept"))
