"""URL filters by host and path prefix: a sort-merge range join.

A host's labels in reverse order, each with a dot behind it, are its canonical key (``www.example.com`` becomes
``com.example.www.``). The keys of a host and all its subdomains are those that begin with the host's key, an interval of
the sorted keys; such intervals nest or lie apart. Keys are cut into ranges by a bounded sample of the rows, so that a
host or url of very many rows spans several of them; a url goes to its range, a rule to all ranges that its interval
meets. Each task sweeps its range in sorted order with a stack of the rules whose intervals are open, and takes the longest one
whose path the url's path begins with.

What the driver and tasks hold besides a range: its boundaries (`RANGES` at most, of `CUT` characters a part) and the
open rules. A rule is copied only to ranges that its own hosts' keys fill.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import LOWER, among_lowest, parts_for, widen

#: Ranges at most, urls of a range about, sampled rows for a boundary, and characters of a boundary's key and path.
RANGES, EACH, SAMPLED, CUT = 4096, 100_000, 12, 200
#: Host: from the first :// up to a slash, question mark, number sign or the end; path: from there up to the latter two.
URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
VERDICTS = ("block", "allow")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty where there is no ``://``."""
    found = URL.match(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def key_of(host: str) -> str:
    """The canonical key. The empty host's is empty as a rule, and then every key begins with it."""
    return "".join(x + "." for x in reversed(host.split(".")))


def rule_key(host: str | None) -> str:
    return key_of(host.translate(LOWER)) if host else ""


def place(bounds: list[tuple], key: str, path: str, salt: int) -> int:
    """Number of the range that a url belongs to; grows with (key, path, salt)."""
    return bisect_right(bounds, (key[:CUT], path[:CUT], salt))


def places(bounds: list[tuple], key: str) -> range:
    """Ranges that may hold urls whose keys begin with key."""
    low = bisect_left(bounds, (key[:CUT],))
    if not key:
        return range(len(bounds) + 1)
    after = key[:-1] + "/"  # the character behind the dot: the first text behind all that begin with key
    return range(low, bisect_left(bounds, (after[:CUT] + "\0",)) + 1)


class Open:
    """The rules of one host whose interval is open: paths in order, each with the longest other one that it begins with."""

    def __init__(self, key: str):
        self.key = key
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []
        self.up: list[int] = []
        self.size = max(len(key) - 1, 0)  # of the host

    def add(self, host: str, path: str, verdict: str) -> None:
        """Rules come in order of their paths; of a rule that comes with both verdicts, block holds."""
        if self.paths and self.paths[-1] == path:
            if verdict == VERDICTS[0]:
                self.rules[-1] = (host + path, verdict)
            return
        i = len(self.paths) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        self.paths.append(path)
        self.rules.append((host + path, verdict))
        self.up.append(i)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        return i


def sweep(rows: Iterator[tuple]) -> Iterator[tuple[str, str] | None]:
    """For rows (part, key, path, host, verdict) in order of part, key, rules first, path: each url's rule and verdict.

    Rules have a verdict, urls have none. Yields for urls only; None where no rule fits.
    """
    part, stack, last, found = None, [], None, None
    for p, key, path, host, verdict in rows:
        if p != part:
            part, stack, last = p, [], None
        if (key, path) != last or verdict is not None:
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
        if verdict is not None:
            if not stack or stack[-1].key != key:
                stack.append(Open(key))
            stack[-1].add(host, path, verdict)
            last = None
            continue
        if (key, path) != last:
            best, found, last = (-1, -1), None, (key, path)
            for o in stack:
                i = o.longest(path)
                if i >= 0 and (size := (o.size + len(o.paths[i]), o.size)) > best:
                    best, found = size, o.rules[i]
        yield found


def boundaries(urls: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 boundaries (key, path, salt) from a sample of rows of bounded size; some may be equal but for the salt."""
    wanted = ranges * SAMPLED
    rows = urls.where(among_lowest(F.xxhash64("salt", F.lit(5)), wanted, urls.count())).select(F.substring("url", 1, 4 * CUT).alias("url"), "salt").collect()
    keys = sorted((key_of(h)[:CUT], p[:CUT], r["salt"]) for r in rows for h, p in [split_url(r["url"])])
    step = max(1, -(-len(keys) // ranges))
    return keys[step::step]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict: one row for each row of pages.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains where the url's path begins with its
    path; an empty or null host fits all hosts, a null path all paths. Of several the one with most characters in host
    and path holds, of equal ones that of the longer host, of the same one with both verdicts block. `rule` is its host
    and path as one text, null where none fits; then the verdict is `default`. A null url or one without ``://`` has an
    empty host and path. Keys may be null or repeat, each row is judged; urls of any length are read whole. Other columns
    aren't read. An empty table of pages or of rules is no error.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    urls = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    if ranges is None:
        ranges = min(RANGES, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(urls.count(), EACH)))
    shared = spark.sparkContext.broadcast(boundaries(urls, ranges))
    schema = f"part int, key string, path string, host string, verdict string, id {kind}"

    def of_urls(batches):
        for b in batches:
            found = [split_url(u) for u in b.column(1).to_pylist()]
            keys = [key_of(h) for h, _ in found]
            at = [place(shared.value, k, p, s) for k, (_, p), s in zip(keys, found, b.column(2).to_pylist(), strict=True)]
            columns = [pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array([p for _, p in found], pa.string()), pa.array([h for h, _ in found], pa.string()), pa.nulls(len(keys), pa.string()), b.column(0)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "path", "host", "verdict", "id"])

    def of_rules(batches):
        for b in batches:
            for host, path, verdict in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                k = rule_key(host)
                at = list(places(shared.value, k))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([x] * n, pa.string()) for x in (k, path or "", (host or "").translate(LOWER), verdict))], names=["part", "key", "path", "host", "verdict"])

    def swept(batches):
        def rows() -> Iterator[tuple]:
            for b in batches:
                held.append(b)
                yield from zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)

        held: list[pa.RecordBatch] = []
        found: list = []
        for result in sweep(rows()):
            found.append(result)
            if len(held) > 1:  # a row of the next batch has been read: all before it are known
                yield from out(held[:-1], found[:-1])
                held[:], found[:] = held[-1:], found[-1:]
        yield from out(held, found)

    def out(batches: list[pa.RecordBatch], found: list):
        at = 0
        for b in batches:
            b = b.filter(pc.is_null(b.column(4)))
            own = found[at : at + b.num_rows]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(5), b.column(3), b.column(2), pa.array([f[0] if f else None for f in own], pa.string()), pa.array([f[1] if f else default for f in own], pa.string())], names=["id", "host", "path", "rule", "verdict"]
            )

    own = rules.where(F.col("verdict").isin(*VERDICTS)).select("host", "path", "verdict").mapInArrow(of_rules, "part int, key string, path string, host string, verdict string")
    dealt = widen(urls).mapInArrow(of_urls, schema).unionByName(own.withColumn("id", F.lit(None).cast(kind)))
    order = ["part", "key", F.col("verdict").isNull(), "path"]
    ranged = dealt.repartition("part").sortWithinPartitions(*order)
    return ranged.mapInArrow(swept, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", key)
