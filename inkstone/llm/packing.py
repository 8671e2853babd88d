"""Vector best-fit packing of token sequences.

A bin has several capacities: tokens, documents and attention cost (the sum of squared lengths, what block-diagonal
attention costs). Each piece goes into the open bin that fits it under every capacity and scores best, either by the
weighted norm of what would be left ("norm": smallest) or by the weighted dot product of the piece with what is left
("dot": largest); a new bin is opened if none fits. Pieces are taken in decreasing length.

Groups of pieces are packed apart from each other; a group leaves at most a few bins part-filled, so groups of some ten
thousand pieces cost well under a thousandth of the bins. A group's size doesn't grow with the data; their number does.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import bpe
from inkstone.llm.common import Kept, map_arrow, parts_for, widen

LENGTH = 2048
#: Pieces of a packing group, about.
GROUP = 16_000
WEIGHTS = (1.0, 1e-4, 1e-2)


def best_fit(lengths: np.ndarray, length: int = LENGTH, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must be positive, in decreasing order and at most `length`.

    max_docs and max_cost default to what tokens alone imply (`length` pieces, `length` squared). A piece that by itself
    exceeds max_cost gets a bin of its own. Ties go to the bin opened first.
    """
    max_docs = length if max_docs is None else max_docs
    max_cost = float(length) ** 2 if max_cost is None else float(max_cost)
    capacity = np.array([length, max_docs, max_cost], float)
    weight = np.array(weights, float)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    smallest = float(lengths[-1]) if n else 0.0
    left = np.empty((3, 1024))  # residuals of open bins, as shares of the capacities
    ids = np.empty(1024, np.int64)
    filled: list[int] = []
    m = 0
    for i, size in enumerate(np.asarray(lengths, float)):
        item = np.array([size, 1.0, size * size]) / capacity
        best = -1
        if m:
            rest = left[:, :m] - item[:, None]
            fits = (rest >= -1e-12).all(0)
            if fits.any():
                score = weight @ (rest * rest) if rule == "norm" else -((weight * item) @ left[:, :m])
                best = int(np.where(fits, score, np.inf).argmin())
        if best < 0:
            if m == len(ids):
                left, ids = np.hstack([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            best, m = m, m + 1
            left[:, best], ids[best] = 1.0, len(filled)
            filled.append(0)
        left[:, best] -= item
        bins[i], offsets[i] = ids[best], filled[ids[best]]
        filled[ids[best]] += int(size)
        after = left[:, best] - np.array([smallest, 1.0, smallest * smallest]) / capacity
        if (after < -1e-12).any():  # nothing fits any more: order is kept, so that ties stay as stated
            left[:, best : m - 1], ids[best : m - 1] = left[:, best + 1 : m].copy(), ids[best + 1 : m].copy()
            m -= 1
    return bins, offsets


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % length or length if n > length else n
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(df: DataFrame, path: str = bpe.DEFAULT, end_id: int = 0, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece: a text's ids and then end_id, cut where longer than `length`."""

    def run(c: dict) -> dict:
        codec = bpe.merging(path)
        out: dict = {k: [] for k in ("key", "piece", "start", "length", "ids_crc32")}
        for key, t in zip(c["key"], c["text"], strict=True):
            ids = codec.encode_bytes(t) + end_id.to_bytes(4, "little")
            for p, (s, n) in enumerate(cut(len(ids) // 4, length)):
                for k, v in zip(out, (key, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])), strict=True):
                    out[k].append(v)
        return out

    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_arrow(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), schema, run).withColumnRenamed("key", key)


def pack(rows: DataFrame, groups: int, length: int = LENGTH, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows of pieces (key, piece, start, length, ids_crc32), read from a stored table.

    `groups` groups are dealt by the rows' places in the table, so that none is large whatever keys or rows repeat.
    Rows that repeat are pieces of their own. Keys may be null; they are carried as they are. An empty table gives an
    empty one.
    """
    fields = [key, "piece", "start", "length", "ids_crc32"]

    def one(group: tuple, t: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in (key, "piece", "ids_crc32"))]
        t = t.select(fields).take(pc.sort_indices(t, sort_keys=order, null_placement="at_end"))
        bins, offsets = best_fit(t.column("length").to_numpy(), length, max_docs, max_cost, rule, weights)
        return t.append_column("sequence_id", pa.array((group[0].as_py() << 32) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    dealt = rows.select(*fields, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("packing_group"))
    return dealt.groupBy("packing_group").applyInArrow(one, schema)


def pack_documents(df: DataFrame, path: str = bpe.DEFAULT, end_id: int = 0, length: int = LENGTH, group: int = GROUP, text: str = "text", key: str = "doc_id", **rules) -> DataFrame:
    """Encodes and packs all rows of df: one row for each piece.

    Null and empty texts are the single token end_id. Repeated rows are packed once each. Only `key` and `text` are read.
    Pieces are written down first: their number says how many groups there are, and texts are encoded once.
    """
    placed = Kept(df.sparkSession).keep(pieces(widen(df.select(key, text)), path, end_id, length, text, key))
    return pack(placed, parts_for(placed.count(), group), length, key=key, **rules)
