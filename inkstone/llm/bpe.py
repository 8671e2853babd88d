"""Byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that its encoding ends with: among the vocabulary's
tokens that are suffixes of the prefix, the one that is compatible with the last token of what stands before it. Two
tokens are compatible if no merge ever crosses the boundary between them. An automaton over the vocabulary reports the
suffixes, the last tokens are stored for all prefixes, and the ids follow from the back-pointers. No merge loop runs.

Texts are cut into chunks (a run without white space and the space before it, or a run of white space), which bounds
every lookup of the pre-tokenizer; ids of chunks and pieces seen before come from bounded caches.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import unicodedata
import weakref

import ahocorasick
import numpy as np
import regex

# The pre-tokenizer's white space and pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Where only ASCII white space occurs, narrower classes find the same chunks faster.
EXOTIC = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
PLAIN_CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

DEFAULT = "byte_bpe_50k.json"
CACHE = 300_000


def resolve(path: str) -> str:
    """A file's own path, or the place of a public tokenizer of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Cache(dict):
    """key -> value by `make`; two generations of at most `size` keys bound it, and keys in use survive."""

    #: All caches of this worker: an operator empties those of others, which a reused worker would else hold on to.
    live: list[weakref.ref] = []

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}
        Cache.live.append(weakref.ref(self))

    @staticmethod
    def only(*wanted: Cache) -> None:
        Cache.live[:] = [r for r in Cache.live if r() is not None]
        for r in Cache.live:
            c = r()
            if c is not None and not any(c is w for w in wanted) and (c or c.old):
                c.clear()
                c.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder for one vocabulary file with byte-level BPE and no normaliser."""

    def __init__(self, path: str):
        spec = json.load(open(resolve(path), encoding="utf-8"))
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        unletter = lambda s: bytes(map(to_byte.__getitem__, s))
        vocab = {unletter(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for b, i in vocab.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.length = np.array([len(b) for b in self.token], np.int64)
        self._rules(vocab, model["merges"])
        self.vocab = vocab
        self.chunk = re.compile(CHUNK)
        self.piece = regex.compile(PIECE)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.chunks, self.pieces = Cache(self._chunk), Cache(self._piece)

    def _rules(self, vocab: dict[bytes, int], merges: list) -> None:
        """Ranks of merges, and each token's outer pieces: (piece, rank that forms it, rank that takes it up)."""
        never = len(merges)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            left, right = (vocab[bytes(map(to_byte.__getitem__, x))] for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank.setdefault((left, right), r)
            made.setdefault(vocab[self.token[left] + self.token[right]], (r, left, right))
        born = [made[t][0] if t in made else -1 for t in range(len(self.token))]

        def outer(t: int, side: int) -> list[tuple[int, int, int]]:
            out = [(t, born[t], never)]
            while t in made:
                taken, t = made[t][0], made[t][side]
                out.append((t, born[t], taken))
            return out

        self.left = [outer(t, 1) for t in range(len(self.token))]
        self.right = [outer(t, 2) for t in range(len(self.token))]
        # a token is reached only if its two parts meet unbroken
        self.whole = [len(b) == 1 or (t in made and self._crossing(*made[t][1:]) == born[t]) for t, b in enumerate(self.token)]

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the tokens that are suffixes of each prefix, longest first."""
        out = ahocorasick.Automaton()
        for b, i in self.vocab.items():
            if self.whole[i]:
                out.add_word(b.decode("latin-1"), (i, len(b)))
        out.make_automaton()
        return out

    def _crossing(self, a: int, b: int) -> int | None:
        """Rank of the first merge that crosses the boundary between a and b, None if none does.

        A piece exists from the merge that forms it until the one that takes it up. Of two merges of one rank the left
        one goes first: on the side of a one of equal rank forestalls the crossing, on the side of b it doesn't.
        """
        first, ranks = None, self.rank.get
        for x, born_x, taken_x in self.right[a]:
            for y, born_y, taken_y in self.left[b]:
                if born_x < taken_y and born_y < taken_x:  # they exist together
                    r = ranks((x, y))
                    if r is not None and born_x < r < taken_x and born_y < r <= taken_y and (first is None or r < first):
                        first = r
        return first

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self._crossing(a, b) is None
        return ok

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix, -1 for the empty one."""
        last = [-1] * (len(data) + 1)
        known, compatible = self.pairs.get, self.compatible
        done = -1
        for end, (t, n) in self.automaton.iter(data.decode("latin-1")):
            if end != done:  # else the prefix has its token
                if n <= end:
                    before = last[end + 1 - n]
                    ok = known(before << 20 | t)
                    if not (compatible(before, t) if ok is None else ok):
                        continue
                last[end + 1] = t
                done = end
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenized piece, from the back-pointers."""
        last, at, out, token = self.last_tokens(data), len(data), [], self.token
        while at:
            out.append(t := last[at])
            at -= len(token[t])
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        t = self.vocab.get(data)
        ids = [t] if t is not None and self.whole[t] else self.encode_piece(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, chunk: str) -> list[str]:
        """The pre-tokenizer's pieces."""
        if chunk.isascii() or all(unicodedata.category(c) != "Cn" for c in chunk):
            return self.piece.findall(chunk)
        # Characters newer than the character tables here: each by one of its class, as the installed pre-tokenizer has it.
        same = "".join(c if unicodedata.category(c) != "Cn" else proxy(c) for c in chunk)
        return [chunk[m.start() : m.end()] for m in self.piece.finditer(same)]

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > 256:  # long runs don't belong into a cache of pieces
            return b"".join(self._piece(p) if len(p) > 64 else self.pieces[p] for p in self.cut(chunk))
        return b"".join(map(self.pieces.__getitem__, self.cut(chunk)))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as the empty text."""
        if not text:
            return b""
        if self.specials and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._run(p) for i, p in enumerate(parts))
        return self._run(text)

    def _run(self, text: str) -> bytes:
        found = (self.chunk if EXOTIC.search(text) else PLAIN_CHUNK).findall(text)
        if len(found) * 64 < len(text):
            return b"".join(self._chunk(c) if len(c) > 256 else self.chunks[c] for c in found)
        return b"".join(map(self.chunks.__getitem__, found))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class Merging(Bpe):
    """The same ids; pieces of which the caches have none are merged by the tiktoken library.

    For operators that need ids and not this module's method. It takes the vocabulary's ids as ranks, so they must be in
    the order of the merges; other vocabularies go the usual way.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.core = None
        first = len(self.vocab) - len(self.rank)
        if all(self.vocab.get(self.token[a] + self.token[b]) == r + first for (a, b), r in self.rank.items()):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.core = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=self.vocab, special_tokens={})._core_bpe

    def encode_piece(self, data: bytes) -> list[int]:
        return self.core.encode_single_piece(data) if self.core else super().encode_piece(data)

    def _chunk(self, chunk: str) -> bytes:
        # the libraries' character tables are of one mind on Latin letters; other chunks are cut here
        if self.core and len(chunk) <= 256 and (chunk.isascii() or max(chunk) < "\u0250"):
            ids = self.core.encode_ordinary(chunk)
            return struct.pack(f"<{len(ids)}I", *ids)
        return super()._chunk(chunk)


@functools.cache
def proxy(c: str) -> str:
    """A letter, digit or sign of the class that the installed pre-tokenizer sees in c."""
    from tokenizers import pre_tokenizers

    cuts = [b for _, b in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(f"a{c}1{c}!")]
    return "a" if cuts[0][1] == 2 else "1" if (1, 4) in cuts else "!"


def codec(path: str = DEFAULT) -> Bpe:
    """One encoder for each Python worker and vocabulary."""
    return _sole(_codec(path))


@functools.cache
def _codec(path: str) -> Bpe:
    return Bpe(path)


def _sole(bpe: Bpe) -> Bpe:
    Cache.only(bpe.chunks, bpe.pieces)
    return bpe


def merging(path: str = DEFAULT) -> Merging:
    return _sole(_merging(path))


@functools.cache
def _merging(path: str) -> Merging:
    return Merging(path)


def encode_decode(df, path: str = DEFAULT, text: str = "text", key: str = "doc_id"):
    """One row for each row of df: key, ids (array<int>), decoded (string).

    Null and empty texts give no ids and the empty text; repeated rows give repeated results; other columns are not read.
    """
    from inkstone.llm.common import map_arrow

    def run(c: dict) -> dict:
        bpe = codec(path)
        ids = [bpe.encode_bytes(t) for t in c["text"]]
        return {"key": c["key"], "ids": [np.frombuffer(x, "<i4") for x in ids], "decoded": [bpe.decode_bytes(x).decode("utf-8", "replace") for x in ids]}

    return map_arrow(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), f"key {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string", run).withColumnRenamed("key", key)


def digests(df, path: str = DEFAULT, text: str = "text", key: str = "doc_id"):
    """key, n_tokens, ids_sha256, decoded_sha256 for each row, without sending ids and texts back to the JVM."""
    from inkstone.llm.common import map_arrow

    def run(c: dict) -> dict:
        bpe = codec(path)
        out = {"key": c["key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in c["text"]:
            ids = bpe.encode_bytes(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
        return out

    schema = f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_arrow(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), schema, run).withColumnRenamed("key", key)
