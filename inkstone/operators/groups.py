"""Sequential work on very many small groups: rows are dealt and sorted by key in Spark, and Python gets plain arrays.

A group costs some microseconds instead of a table of its own. A task holds one group and one batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(rows: DataFrame, keys: list[str], order: list, schema: str, fn: Callable[[dict[str, np.ndarray]], list[tuple]]) -> DataFrame:
    """fn gets a group's columns as arrays, in the order given, and returns its result rows. Keys must not be null."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the last group, which are put together once it ends
        for batch in batches:
            if not len(batch):
                continue
            same = bool(held) and all(batch[k].iloc[0] == held[-1][k].iloc[0] and batch[k].iloc[-1] == held[-1][k].iloc[0] for k in keys)
            held.append(batch)
            if same:
                continue
            batch = pd.concat(held, ignore_index=True)
            columns = {n: batch[n].to_numpy() for n in names}
            new = np.zeros(len(batch), bool)
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            out = [r for a, b in zip(starts[:-1], starts[1:], strict=True) for r in fn({n: c[a:b] for n, c in columns.items()})]
            if out:
                yield pd.DataFrame(out, columns=fields)
            held = [batch.iloc[starts[-1] :]]
        rest = pd.concat(held, ignore_index=True) if held else None
        if rest is not None and (out := fn({n: rest[n].to_numpy() for n in names})):
            yield pd.DataFrame(out, columns=fields)

    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    fields = types.names
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, types)
