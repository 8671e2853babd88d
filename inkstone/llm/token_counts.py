"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined by a separator and encoded once, as a whole. Tokens become spans of the joined text;
sections (lines, or the fields themselves) are spans as well, and tile it. An interval join of the two, a binary search
in the sorted section ends, gives each token's sections. A token that crosses a boundary goes by an explicit rule:

* ``start``: to the section of its first byte;
* ``majority``: to the section that holds most of its bytes, the earlier one if two hold as many;
* ``split``: to every section by its share of the token's bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from inkstone.llm import bpe
from inkstone.llm.common import map_arrow, widen

RULES = ("start", "majority", "split")


def token_spans(codec: bpe.Bpe, data: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in bytes."""
    ends = np.cumsum(codec.length[np.frombuffer(ids, "<u4")])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def character_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans as spans of code points; a token that holds part of a character covers the character."""
    lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return lead[starts] - 1, lead[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Tokens of each section; bounds: the sections' ends in bytes, increasing, the last one the text's."""
    first, last = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends - 1, "right")
    if rule == "start":
        return np.bincount(first, minlength=len(bounds)).astype(float)
    out = np.bincount(first[first == last], minlength=len(bounds)).astype(float)
    crossing = np.flatnonzero(first != last)
    if not len(crossing):
        return out
    # one row for each section that a crossing token has bytes of, token by token
    n = last[crossing] - first[crossing] + 1
    begin = np.cumsum(n) - n
    token = np.repeat(crossing, n)
    inner = first[token] + np.arange(len(token)) - np.repeat(begin, n)
    share = np.minimum(bounds[inner], ends[token]) - np.maximum(np.where(inner > 0, bounds[inner - 1], 0), starts[token])
    if rule == "split":
        np.add.at(out, inner, share / (ends - starts)[token])
        return out
    # the first section that holds most of a token: its place among the rows, where shares reach the token's largest
    most = share == np.repeat(np.maximum.reduceat(share, begin), n)
    place = np.minimum.reduceat(np.where(most, np.arange(len(token)), len(token)), begin)
    np.add.at(out, inner[place], 1)
    return out


def section_bounds(parts: list[bytes], separator: bytes, sections: str) -> tuple[list[int], list[int]]:
    """Field number and end in bytes of each section; separators and line ends belong to what stands before them."""
    fields, bounds, at = [], [], 0
    for f, p in enumerate(parts):
        data = p + (separator if f < len(parts) - 1 else b"")
        if sections == "line":
            ends = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()
            if not ends or ends[-1] < len(data):
                ends.append(len(data))
        else:
            ends = [len(data)]
        fields += [f] * len(ends)
        bounds += [at + e for e in ends]
        at += len(data)
    return fields, bounds


def token_counts(df: DataFrame, fields: tuple[str, ...] = ("text",), sections: str = "line", rule: str = "majority", separator: str = "\n", path: str = bpe.DEFAULT, key: str = "doc_id") -> DataFrame:
    """One row for each section: key, field, section (from 0 in the document), start, end (code points), n_bytes, n_tokens.

    sections: "line" or "field". Counts over a document's sections add up to the tokens of the whole. A null field
    counts as the empty text; an empty one has one section of 0 tokens. Repeated rows give repeated results; columns
    besides key and fields aren't read, so their names don't matter.
    """
    if rule not in RULES or sections not in ("line", "field"):
        raise ValueError(f"unknown rule or sections: {rule}, {sections}")
    between = separator.encode()

    def run(c: dict) -> dict:
        codec = bpe.merging(path)
        out: dict = {k: [] for k in ("key", "field", "section", "start", "end", "n_bytes", "n_tokens")}
        for row in zip(c["key"], *(c[f"f{i}"] for i in range(len(fields))), strict=True):
            parts = [(p or "").encode() for p in row[1:]]
            data = between.join(parts)
            of, bounds = section_bounds(parts, between, sections)
            tokens = attribute(*token_spans(codec, data, codec.encode_bytes(data.decode())), np.array(bounds), rule) if data else np.zeros(len(bounds))
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            chars = lead[bounds].tolist()
            n = len(bounds)
            out["key"] += [row[0]] * n
            out["field"] += [fields[f] for f in of]
            out["section"] += range(n)
            out["start"] += [0, *chars[:-1]]
            out["end"] += chars
            out["n_bytes"] += [b - a for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]
            out["n_tokens"] += tokens.tolist()
        return out

    schema = f"key {df.schema[key].dataType.simpleString()}, field string, section int, start bigint, end bigint, n_bytes bigint, n_tokens double"
    narrow = df.selectExpr(f"`{key}` AS key", *(f"`{f}` AS f{i}" for i, f in enumerate(fields)))
    return map_arrow(widen(narrow), schema, run).withColumnRenamed("key", key)
