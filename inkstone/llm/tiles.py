"""Work on buckets of rows by tiles of bounded size.

A bucket of at most `limit` rows is one unit of work. A larger one is split into tiles of about that size (within bands,
if there are any), and each pair of tiles whose bands are at most `radius` apart is a unit: all pairs of rows are still
met, by many tasks, none of which holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept


def units(rows: DataFrame, counted: DataFrame, kept: Kept, limit: int, radius: int = 0, salt: str = "id") -> DataFrame:
    """rows with the unit they belong to: tile_a, tile_b (bigint, -1 for a whole bucket), side (0: tile_a, 1: tile_b).

    rows: bucket (bigint), band (int) and others; counted: the same buckets and bands, to be counted by. Rows of a large
    bucket come once for each unit of their tile; rows that repeat are rows of their own. Only the number of large
    buckets' bands reaches the driver.
    """
    per_band = counted.groupBy("bucket", "band").agg(F.count("*").alias("n"))
    large = per_band.groupBy("bucket").agg(F.sum("n").alias("total"), F.collect_list(F.struct("band", "n")).alias("bands")).where(F.col("total") > limit)
    tiles = kept.keep(large.select("bucket", F.explode("bands").alias("x")).select("bucket", "x.band", F.ceil(F.col("x.n") / limit).cast("int").alias("tiles")))
    if tiles.isEmpty():
        return rows.withColumns({"tile_a": F.lit(-1).cast("bigint"), "tile_b": F.lit(-1).cast("bigint"), "side": F.lit(0)})
    code = lambda band, tile: F.col(band).cast("bigint") * (1 << 32) + F.col(tile)
    end = lambda x: tiles.select("bucket", F.col("band").alias(f"band_{x}"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(x))
    near = (F.col("band_b") - F.col("band_a")).between(0, radius) & ((F.col("band_b") > F.col("band_a")) | (F.col("b") >= F.col("a")))
    pairs = end("a").join(end("b"), "bucket").where(near).select("bucket", code("band_a", "a").alias("tile_a"), code("band_b", "b").alias("tile_b"))
    second = pairs.where("tile_a <> tile_b").select("bucket", F.col("tile_b").alias("tile"), "tile_a", "tile_b", F.lit(1).alias("side"))
    ends = pairs.select("bucket", F.col("tile_a").alias("tile"), "tile_a", "tile_b", F.lit(0).alias("side")).unionByName(second)
    of_tile = ends.groupBy("bucket", "tile").agg(F.collect_list(F.struct("tile_a", "tile_b", "side")).alias("units"))
    tiled = rows.join(tiles, ["bucket", "band"], "left").withColumn("tile", F.col("band").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(F.col(salt), F.lit(7)), F.col("tiles")))
    whole = F.expr("array(struct(-1L AS tile_a, -1L AS tile_b, 0 AS side))")
    out = tiled.join(of_tile, ["bucket", "tile"], "left").withColumn("unit", F.explode(F.coalesce("units", whole)))
    return out.select(*rows.columns, "unit.tile_a", "unit.tile_b", "unit.side")


def map_units(dealt: DataFrame, schema: str, fn: Callable[[pa.Table, np.ndarray], dict | None], columns: list[str], together: int = 16_384) -> DataFrame:
    """Calls fn with rows of whole units that have two rows or more, sorted by unit, and where units begin and end.

    A call gets units of some `together` rows, or one larger unit; fn returns columns or None. Rows that repeat are rows
    of their own; without rows fn isn't called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)
    keys = ["bucket", "tile_a", "tile_b"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        rows, last, ends = 0, None, []  # ends: where units end, but for the last one, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in keys])
            new = np.flatnonzero(np.any(k[:, 1:] != k[:, :-1], axis=0)) + 1
            if last is not None and (k[:, 0] != last).any():
                new = np.concatenate([[0], new])
            last = k[:, -1]
            ends += (new + rows).tolist()
            held.append(b)
            rows += b.num_rows
            if ends and ends[-1] >= together:
                t = pa.Table.from_batches(held)
                yield from cut(t, ends)
                rest = t.slice(ends[-1])
                held, rows, ends = rest.combine_chunks().to_batches(), rest.num_rows, []
        if held:
            yield from cut(pa.Table.from_batches(held), [*ends, rows])

    def cut(t: pa.Table, ends: list[int]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        bounds = np.array([0, *ends])
        first = 0
        for i in range(1, len(bounds)):
            if i == len(bounds) - 1 or bounds[i + 1] - bounds[first] > together:
                if (np.diff(bounds[first : i + 1]) > 1).any():
                    yield t.slice(bounds[first], bounds[i] - bounds[first]).combine_chunks(), bounds[first : i + 1] - bounds[first]
                first = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches):
            if out := fn(t, bounds):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(out[f.name]), f.type) for f in arrow], schema=arrow)

    return dealt.select(*keys, "side", *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, types)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
