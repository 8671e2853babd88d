"""Personal data: exact base spans, and more from a skip-chain conditional random field.

Tokens that hold a digit or an at-sign are the field's variables; all others are fixed to "none". Neighbouring tokens
share transition potentials; tokens of one document that repeat or resemble each other (same digits, same last digits,
same name before an at-sign) share skip potentials that favour one label. Loopy message passing runs over all documents
of a batch at once. The field learns from base spans and from copies of them with parts left out or written otherwise,
so it also finds forms that the base patterns miss and carries a label to distant mentions. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, among_lowest, map_arrow, widen
from inkstone.llm.labelled import within

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents of the training sample, at most: those of the smallest hashes among documents with digits or at-signs; and their bytes.
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
SLOTS = 1 << 13
ROUNDS = 12
SURE = 0.8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
EDGES = "([{<\"'.,;:!?)]}>=|*$%&#"
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each at-sign with the name before and the host after it; linear, where a search from every letter isn't."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def addresses(text: str) -> list[Span]:
    """Four runs of digits with single dots between, leftmost first; those with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at, starts = m[0].split("."), m.start(), []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            if all(four := parts[i : i + 4]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((starts[i], starts[i + 3] + len(four[3])))
                i += 4
            else:
                i += 1
    return out


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() <= 40 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """Spans of each kind, in code points."""
    text = text or ""
    digits = DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": addresses(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits and "+" in text else []}


@dataclass
class Tokens:
    """Variables of one document: trimmed tokens with a digit or an at-sign."""

    spans: list[Span]
    words: list[str]
    joined: np.ndarray  # whether the variable before is the word before
    features: list[np.ndarray]
    skips: list[tuple[int, int]]


def _features(word: str, before: str, after: str) -> np.ndarray:
    digits = [c for c in word if "0" <= c <= "9"]
    n = len(digits)
    shape = re.sub("(.)\\1+", "\\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", word))))
    groups = re.findall("[0-9]+", word)
    found = [
        f"shape {shape}", f"digits {min(n, 20)}", f"signs {''.join(sorted(set(c for c in word if not c.isalnum())))}", f"groups {','.join(str(min(len(g), 6)) for g in groups)}",
        f"at {word.count('@')}", f"letters {min(sum(c.isalpha() for c in word) // 3, 5)}", f"start {word[:1]}", f"dots {min(word.count('.'), 5)}", f"before {before}", f"after {after}", "any",
    ]
    if 13 <= n <= 19 and n >= len(word) - word.count("-") - word.count(" "):
        found.append(f"luhn {luhn(''.join(digits))} {n >= 16}")
    if word.count(".") == 3 and len(groups) == 4:
        found.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return np.array([zlib.crc32(f.encode()) % SLOTS for f in found])


def _keys(word: str) -> list[str]:
    """What similar tokens have in common."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    keys = []
    if len(digits) >= 7:
        keys += [f"d{digits}", f"e{digits[-7:]}"]
    name = word.partition("@")[0].strip(EDGES).lower()
    if len(name) >= 4 and any(c.isalpha() for c in name):
        keys.append(f"n{name}")
    return keys



def tokens(text: str) -> Tokens:
    out = Tokens([], [], np.zeros(0, bool), [], [])
    joined, last, seen = [], -2, {}
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in EDGES and not (text[a] == "(" and b - a > 1 and text[a + 1].isdigit()):
            a += 1
        while b > a and text[b - 1] in EDGES and not (text[b - 1] == ")" and "(" in text[a : b - 1]):
            b -= 1
        if a == b:
            continue
        word = text[a:b]
        i = len(out.words)
        joined.append(i > 0 and a == last + 1 and text[last] == " ")
        before = text[max(0, m.start() - 24) : m.start()].split()
        after = text[m.end() : m.end() + 24].split()
        out.spans.append((a, b))
        out.words.append(word)
        near = lambda w: ("9" if DIGIT.search(w) else w.strip(EDGES).lower()[:12]) if w else ""
        out.features.append(_features(word, near(before[-1] if before else ""), near(after[0] if after else "")))
        last = b
        keys = _keys(word)
        out.skips += sorted({(seen[k], i) for k in keys if k in seen})  # a chain through all tokens of a key
        seen |= dict.fromkeys(keys, i)
    out.joined = np.array(joined, bool)
    return out


@dataclass
class Field:
    unary: np.ndarray  # SLOTS x labels
    chain: np.ndarray  # labels x labels
    skip: float


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Graph:
    """Variables of many documents: features in rows, chain and skip edges, and which ends meet a fixed "none"."""

    slots: np.ndarray
    rows: np.ndarray
    n: int
    chain: np.ndarray
    skip: np.ndarray
    open_left: np.ndarray
    open_right: np.ndarray


def graph(docs: list[Tokens]) -> Graph:
    slots, rows, chain, skip, left, right, at = [], [], [], [], [], [], 0
    for d in docs:
        for i, f in enumerate(d.features):
            slots.append(f)
            rows.append(np.full(len(f), at + i))
        j = np.flatnonzero(d.joined)
        chain.append(np.stack([at + j - 1, at + j], 1))
        if d.skips:
            skip.append(np.array(d.skips) + at)
        left.append(~d.joined)
        right.append(~np.append(d.joined[1:], False) if len(d.joined) else np.zeros(0, bool))
        at += len(d.features)
    cat = lambda x, empty: np.concatenate(x) if x else empty
    none = np.zeros(0, np.int64)
    return Graph(cat(slots, none), cat(rows, none), at, cat(chain, np.zeros((0, 2), np.int64)), cat(skip, np.zeros((0, 2), np.int64)), cat(left, none.astype(bool)), cat(right, none.astype(bool)))


def marginals(f: Field, g: Graph, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loopy sum-product: log-marginals of variables, and marginals of chain and of skip edges."""
    k = len(LABELS)
    own = np.zeros((g.n, k))
    np.add.at(own, g.rows, f.unary[g.slots])
    own[g.open_left] += f.chain[0]
    own[g.open_right] += f.chain[:, 0]
    ends = np.concatenate([g.chain, g.skip])
    m = len(g.chain)
    pot = np.concatenate([np.broadcast_to(f.chain, (m, k, k)), np.broadcast_to(f.skip * np.eye(k), (len(g.skip), k, k))])
    to_b, to_a = np.zeros((len(ends), k)), np.zeros((len(ends), k))
    belief = own.copy()
    for _ in range(rounds if len(ends) else 0):
        out_b = _logsumexp((belief[ends[:, 0]] - to_a)[:, :, None] + pot, 1)
        out_a = _logsumexp((belief[ends[:, 1]] - to_b)[:, None, :] + pot, 2)
        new_b, new_a = out_b - _logsumexp(out_b, 1)[:, None], out_a - _logsumexp(out_a, 1)[:, None]
        # half steps keep loops from swinging
        done = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max()) < 1e-4
        to_b, to_a = 0.5 * (to_b + new_b), 0.5 * (to_a + new_a)
        belief = own.copy()
        np.add.at(belief, ends[:, 1], to_b)
        np.add.at(belief, ends[:, 0], to_a)
        if done:
            break
    node = belief - _logsumexp(belief, 1)[:, None] if g.n else belief
    pair = (belief[ends[:, 0]] - to_a)[:, :, None] + (belief[ends[:, 1]] - to_b)[:, None, :] + pot
    pair = np.exp(pair - pair.max((1, 2), keepdims=True)) if len(ends) else pair
    pair = pair / pair.sum((1, 2), keepdims=True) if len(ends) else pair
    return node, pair[:m], pair[m:]


def gold(t: Tokens, base: dict[str, list[Span]]) -> np.ndarray:
    """A token's label: the first kind in the order listed of which a span overlaps it."""
    out = np.zeros(len(t.spans), np.int64)
    for k in reversed(range(len(KINDS))):
        spans = sorted(base[KINDS[k]])
        starts = np.array([s for s, _ in spans])
        for i, (a, b) in enumerate(t.spans):
            j = int(np.searchsorted(starts, b)) - 1
            if j >= 0 and spans[j][1] > a:
                out[i] = k + 1
    return out


def rewritten(text: str, base: dict[str, list[Span]], rng: np.random.Generator) -> tuple[str, dict[str, list[Span]]]:
    """The text with some base spans written in a way that the patterns miss, and where all spans stand now."""
    spans = sorted((a, b, k) for k in KINDS for a, b in base[k])
    out, at, now = [], 0, {k: [] for k in KINDS}
    size = 0
    for a, b, k in spans:
        if a < at:
            continue
        word = text[a:b]
        if k == "phone" and rng.random() < 0.5:
            word = word.lstrip("+") if rng.random() < 0.5 else re.sub(r"^\+[0-9]+[ -]?", "", word)
        elif k == "card" and rng.random() < 0.5:
            word = ".".join(word[i : i + 4] for i in range(0, len(word), 4))
        elif k == "email" and rng.random() < 0.3:
            word = word.replace(".", "-") if rng.random() < 0.5 else word.partition("@")[0] + "@localhost"
        elif k == "ip" and rng.random() < 0.3:
            word = word.replace(".", ",")
        out += [text[at:a], word]
        size += a - at
        now[k].append((size, size + len(word)))
        size += len(word)
        at = b
    return "".join([*out, text[at:]]), now


def train(texts: list[str], steps: int = 60, rate: float = 0.5, l2: float = 1e-3, seed: int = 11) -> Field:
    """Adagrad on the likelihood, its expectations from loopy message passing."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for text in texts:
        base = base_spans(text)
        versions = [(text, base)]
        if any(base.values()):
            versions.append(rewritten(text, base, rng))
        for words, spans in versions:
            t = tokens(words)
            if t.words:
                docs.append(t)
                labels.append(gold(t, spans))
    k = len(LABELS)
    f = Field(np.zeros((SLOTS, k)), np.zeros((k, k)), 0.5)
    if not docs:
        f.unary[:, 0] = 1.0
        return f
    g, y = graph(docs), np.concatenate(labels)
    true = np.eye(k)[y]
    s_unary, s_chain, s_skip = np.full_like(f.unary, 1e-8), np.full_like(f.chain, 1e-8), 1e-8
    for _ in range(steps):
        node, pair, skip = marginals(f, g, 4)
        rest = true - np.exp(node)
        d_unary = -l2 * f.unary * g.n / 100
        np.add.at(d_unary, g.slots, rest[g.rows])
        d_chain = -l2 * f.chain * g.n / 100 - pair.sum(0)
        np.add.at(d_chain, (y[g.chain[:, 0]], y[g.chain[:, 1]]), 1)
        d_chain[0] += rest[g.open_left].sum(0)
        d_chain[:, 0] += rest[g.open_right].sum(0)
        d_skip = float((y[g.skip[:, 0]] == y[g.skip[:, 1]]).sum() - np.trace(skip.sum(0))) - l2 * f.skip * g.n / 100 if len(g.skip) else 0.0
        s_unary, s_chain, s_skip = s_unary + d_unary**2, s_chain + d_chain**2, s_skip + d_skip**2
        f.unary, f.chain = f.unary + rate * d_unary / np.sqrt(s_unary), f.chain + rate * d_chain / np.sqrt(s_chain)
        f.skip = max(0.5, f.skip + rate * d_skip / s_skip**0.5)  # alike tokens never repel each other
    return f


def all_spans(f: Field, texts: list[str | None], sure: float = SURE) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(base spans, added spans) of each text. An added span overlaps no base span; neighbouring tokens of one number are one."""
    base = [base_spans(t) for t in texts]
    with_tokens = [(i, t) for i, text in enumerate(texts) if text and ("@" in text or DIGIT.search(text)) and (t := tokens(text)).words]
    out: list = [(b, {k: [] for k in KINDS}) for b in base]
    if not with_tokens:
        return out
    node, _, _ = marginals(f, graph([t for _, t in with_tokens]))
    at = 0
    for i, t in with_tokens:
        p = np.exp(node[at : at + len(t.words)])
        at += len(t.words)
        label = np.where(p.max(1) >= sure, p.argmax(1), 0)
        taken = sorted(s for k in KINDS for s in base[i][k])
        starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate(np.array([b for _, b in taken])) if taken else None
        last = -1
        for j in np.flatnonzero(label):
            a, b = t.spans[j]
            before = int(np.searchsorted(starts, b)) - 1
            if before >= 0 and ends[before] > a:
                continue
            kind, own = KINDS[label[j] - 1], out[i][1][KINDS[label[j] - 1]]
            if kind in ("card", "phone") and t.joined[j] and last == j - 1 and label[j - 1] == label[j] and own:
                own[-1] = (own[-1][0], b)
            else:
                own.append((a, b))
            last = j
        for kind in ("card", "phone"):  # a single group of few digits is no number
            own = out[i][1][kind]
            own[:] = [(a, b) for a, b in own if sum(c.isdigit() for c in texts[i][a:b]) >= 7]
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Field:
    """Learns from at most `sample` of the documents with digits or at-signs, those of the lowest hashes of key and text.

    Rows of one key and text count once; the sample has at most SAMPLE_BYTES of text (one document at least). The labels
    are the base spans themselves, so the sample bounds what forms the field has seen, never which base spans are found.
    """
    may = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").rlike("[0-9@]"))
    hashed = F.xxhash64("key", "text")
    kept = Kept(docs.sparkSession)
    drawn = kept.keep(may.where(among_lowest(hashed, sample, may.count())).groupBy(hashed.alias("h")).agg(F.min("text").alias("text"), F.lit(0).alias("label")))
    sizes = sorted(drawn.select("label", "h", F.octet_length("text").alias("n")).collect(), key=lambda r: r["h"])[:sample]  # bounded by the sample
    texts = [r["text"] for r in drawn.where(within(sizes, SAMPLE_BYTES)).collect()]  # bounded in rows and bytes
    kept.only()
    return train(sorted(texts))


def personal_data(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts of base spans, base_sha256, spans (base and added): one row for each row of docs.

    Null and empty texts have no spans; repeated rows give repeated results; other columns aren't read.
    """
    field = fit(docs, sample, text, key)

    def run(c: dict) -> dict:
        found = all_spans(field, c["text"])
        out = {"key": c["key"]} | {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [joined({k: b[k] + more[k] for k in KINDS}) for b, more in found]
        return out

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"key {docs.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string"
    return map_arrow(widen(docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")), schema, run).withColumnRenamed("key", key)


def redact(text: str | None, spans: dict[str, list[Span]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first kind names the whole."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted((a, b, KINDS.index(k)) for k in KINDS for a, b in spans[k]):
        if a < at:  # overlaps what has been replaced
            at = max(at, b)
            continue
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(field: Field, text: str = "text") -> Column:
    """A column of texts without their personal data; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = [t if isinstance(t, str) else None for t in texts]
        return pd.Series([redact(t, {k: b[k] + more[k] for k in KINDS}) for t, (b, more) in zip(own, all_spans(field, own), strict=True)], dtype=object)

    return run(text)
