"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits.

Fingerprints that differ in at most two bits agree in two of four 16-bit blocks, so each fingerprint goes into a bucket
for every pair of blocks. Within a bucket all pairs are compared exactly, tile by tile, with numpy's exclusive-or and bit
counts, in the order of population counts: tile pairs whose counts differ by more than the radius are skipped. A bucket
gives a spanning forest of its links, never all pairs of a group; equal fingerprints are one node from the start.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, map_arrow, widen
from inkstone.llm.components import components
from inkstone.llm.tiles import forest, map_units, units

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Rows of a tile, and of the blocks of a comparison within it.
TILE, BLOCK = 4096, 512


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Shingles of the ASCII-lower-cased words; fewer words than `size` are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(s, seed) for s in shingles(text, size)], "<u8")
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, size: int = SHINGLE, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (bigint, the same 64 bits) for each row."""

    def run(c: dict) -> dict:
        return {"key": c["key"], "fp": np.array([fingerprint(t, size, seed) for t in c["text"]], np.uint64).view(np.int64)}

    schema = f"key {df.schema[key].dataType.simpleString()}, fp bigint"
    return map_arrow(widen(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")), schema, run).withColumnRenamed("key", key)


def near_pairs(x: np.ndarray, radius: int = RADIUS, side: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a, b of fingerprints (uint64) at most `radius` bits apart, found tile by tile.

    side: only pairs with one of side 0 and one of side 1 count, if both occur.
    """
    count = np.bitwise_count(x).astype(np.int64)
    order = np.argsort(count, kind="stable")
    x, count = x[order], count[order]
    out_a, out_b = [], []
    for i in range(0, len(x), block):
        for j in range(i, len(x), block):
            if count[j] - count[min(i + block, len(x)) - 1] > radius:
                break  # tiles further on lie further off
            a, b = np.nonzero(np.bitwise_count(x[i : i + block, None] ^ x[None, j : j + block]) <= radius)
            a, b = order[a + i], order[b + j]
            keep = a < b if i == j else np.ones(len(a), bool)
            if side is not None:
                keep &= side[a] != side[b]
            out_a.append(a[keep])
            out_b.append(b[keep])
    return np.concatenate(out_a), np.concatenate(out_b)


def links(fps: DataFrame, kept: Kept, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between representatives of fingerprints; fps: fp and rep (bigint), one row each.

    They connect exactly the fingerprints that links of at most `radius` differing bits connect.
    """
    if radius not in (0, 1, 2):
        raise ValueError("blocks are laid out for at most two differing bits")
    block = lambda i: F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.lit(c << 32).cast("bigint") + block(i) * 65536 + block(j) for c, (i, j) in enumerate(itertools.combinations(range(4), 2))]
    rows = fps.select("fp", "rep", F.bit_count("fp").alias("band"), F.explode(F.array(*keys)).alias("bucket"))
    dealt = units(rows, rows, kept, tile, radius, "fp")

    def run(t: pa.Table, bounds: np.ndarray) -> dict | None:
        every, sides, rep = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy(), t.column("rep").to_numpy()
        out: list = []
        for lo, hi in zip(bounds, bounds[1:]):  # noqa: B905
            if hi - lo > 1:
                x, side = every[lo:hi], sides[lo:hi]
                a, b = near_pairs(x, radius, side if side.any() else None)
                if len(a):
                    label = forest(len(x), a, b)
                    joined = np.flatnonzero(label != np.arange(len(x)))
                    out.append((rep[lo + joined], rep[lo + label[joined]]))
        return dict(zip("ab", map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else None

    return map_units(dealt, "a bigint, b bigint", run, ["fp", "rep"])


def near_duplicates(df: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, tile: int = TILE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (hex), component_id: one row for each row of df.

    component_id is the smallest key reachable over links, a row's own included; keys must be integers. Null and empty
    texts have the fingerprint zero and are linked like any others. Rows that repeat a key stay rows of their own in one
    component. A null key is no one's smallest; its component is that of its fingerprint, null if no row of it has a key.
    Other columns aren't read.
    """
    kept = Kept(df.sparkSession)
    docs = kept.keep(fingerprints(df, size, seed, text, key).withColumnRenamed(key, "key"))
    fps = kept.keep(docs.groupBy("fp").agg(F.min("key").cast("bigint").alias("rep")))
    found = components(links(fps.where("rep IS NOT NULL"), kept, radius, tile), kept)
    kept.only(docs, fps, found)
    of_fp = fps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    out = docs.join(of_fp, F.col("fp") == F.col("fp_")).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return kept.read_by(out)
