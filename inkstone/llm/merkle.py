"""A Merkle manifest of a dataset: supersteps of messages along the edges of hash trees, in RDDs.

Rows are leaves. The leaves of a group are one tree, whose root (the subroot) is a leaf of the top tree over all groups.
Upward, every node sends its hash to its parent; a parent that has heard from all its children hashes them and sends on
in the next superstep. Downward, every node sends each child the child's siblings ahead of its own siblings' path, until
the leaves have their whole proof and can be verified. A node has `FANOUT` children at most, so no group of messages is large;
a superstep's rows are a sixteenth of the one below it. Leaves get their place in a tree from a range-partitioned sort
and the sizes of its parts: a group of a third of all rows is many tasks' work.

Every superstep's nodes and messages are written to the shared folder, so a lost executor costs one superstep at most.
A digest is hashed as hex text and stored as 32 bytes. A proof is, level by level, the node's place among its siblings (a
byte), their number (a byte) and their digests in order.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, crc_mod, parts_for

FANOUT, DIGEST = 16, 32
#: Nodes a task of a superstep gets, about.
EACH = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "tree bigint, pos bigint, n bigint, hash binary, children binary"
PATHS = "tree bigint, pos bigint, subroot binary, path binary"


def digests(data: bytes) -> list[bytes]:
    return [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)]


def combine(children: bytes) -> bytes:
    """The hash of a node from its children's digests in order."""
    return sha256(children.hex().encode()).digest()


def step(children: bytes, slot: int) -> bytes:
    """One level of a proof: the child at slot, and its siblings."""
    at = slot * DIGEST
    return bytes((slot, len(children) // DIGEST - 1)) + children[:at] + children[at + DIGEST :]


def levels_of(path: bytes) -> list[tuple[int, bytes]]:
    """(slot, siblings) of each level of a proof, the lowest first."""
    out, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        out.append((slot, path[at + 2 : (at := at + 2 + n * DIGEST)]))
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    for slot, siblings in levels_of(path):
        at = slot * DIGEST
        digest = combine(siblings[:at] + digest + siblings[at:])
    return digest


def proof_digest(path: bytes) -> str:
    """Hex hash of all siblings of a proof, level by level, left to right."""
    return sha256(b"".join(s for _, s in levels_of(path)).hex().encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hex hash of a row: of each field its UTF-8 byte count, a colon and its text, or - if it is null."""
    own = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in own)), 256)


def numbered(rows: DataFrame, group: str, order: list[str], kept: Kept) -> tuple[DataFrame, DataFrame]:
    """rows with pos (from 0 in each group, by order, nulls first); and a table of group and n, the group's rows.

    Rows are sorted by ranges, equal ones in any order; a group's place in a range follows from its rows in the ranges
    before it. A window runs over the ranges of a group, never over its rows.
    """
    salted = rows.withColumn("salt_", F.xxhash64(F.monotonically_increasing_id()))
    keys = [group, *order, "salt_"]
    ranged = kept.keep(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt_").withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    parts = ranged.groupBy(group, "part_").agg(F.count("*").alias("n"), F.min("at_").alias("low_"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept.keep(parts.withColumn("before_", before))
    own = parts.select(F.col(group).alias("group_"), F.col("part_").alias("part__"), (F.col("before_") - F.col("low_")).alias("shift_"))
    out = ranged.join(own, F.col(group).eqNullSafe(F.col("group_")) & (F.col("part_") == F.col("part__")))
    return out.withColumn("pos", F.col("at_") + F.col("shift_")).select(*rows.columns, "pos"), parts.groupBy(group).agg(F.sum("n").alias("n"))


def tasks(rdd: RDD, rows: int) -> int:
    return max(min(rdd.context.defaultParallelism, rows), parts_for(rows, EACH))


def climb(nodes: DataFrame, kept: Kept) -> tuple[list[DataFrame], DataFrame]:
    """Upward supersteps over trees of any heights at once, from leaves (tree, pos, n: the tree's leaves, hash).

    Gives the inner nodes of each level, the lowest first (NODES: n nodes of the tree stand on the level, children are
    digests in order), and each tree's root: tree, height, hash. A tree of one leaf is its own root.
    """
    spark = nodes.sparkSession
    levels, now = [], nodes.select("tree", "pos", "n", "hash")
    roots = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "hash")

    def send(r) -> tuple:
        return (r[0], r[1] // FANOUT), (r[1] % FANOUT, r[2], bytes(r[3]))

    def hear(message: tuple) -> tuple:
        (tree, pos), heard = message
        heard = sorted(heard)
        n = heard[0][1]
        if [slot for slot, _, _ in heard] != list(range(min(FANOUT, n - pos * FANOUT))):
            raise ValueError(f"node {pos} of tree {tree} hasn't heard from each child once")
        children = b"".join(h for _, _, h in heard)
        return tree, pos, -(-n // FANOUT), combine(children), children

    while True:
        rest = now.where("n > 1")
        if not (count := rest.count()):
            return levels, roots
        rdd = rest.rdd.map(send)
        level = kept.keep(spark.createDataFrame(rdd.groupByKey(tasks(rdd, count)).map(hear), NODES, verifySchema=False))
        levels.append(level)
        now = level.select("tree", "pos", "n", "hash")
        roots = roots.unionByName(level.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "hash"))


def sent_down(heard: DataFrame, nodes: DataFrame, children: int, kept: Kept) -> DataFrame:
    """One downward superstep: PATHS of the children of all nodes, which hear their own PATHS; children: how many there are."""

    def send(messages: tuple) -> list[tuple]:
        (tree, pos), met = messages
        (path, subroot), (own, _) = sorted(met, key=lambda m: m[1] is None)
        return [(tree, pos * FANOUT + slot, subroot, step(own, slot) + path) for slot in range(len(own) // DIGEST)]

    # both kinds of message in one table, so that one Python worker at a time deals them out
    none = F.lit(None).cast("binary")
    met = heard.select("tree", "pos", F.col("path").alias("data"), "subroot").unionByName(nodes.select("tree", "pos", F.col("children").alias("data"), none.alias("subroot")))
    rdd = met.rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), None if r[3] is None else bytes(r[3]))))
    return kept.keep(heard.sparkSession.createDataFrame(rdd.groupByKey(tasks(rdd, children)).flatMap(send), PATHS, verifySchema=False))


def descend(levels: list[DataFrame], starts: DataFrame, kept: Kept) -> DataFrame:
    """Downward supersteps from the trees' roots (tree, height, subroot, path: of the root) to the nodes over leaves.

    Gives PATHS of the lowest inner nodes, and of the only leaf of trees of height 0.
    """
    own = lambda height: starts.where(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("pos"), "subroot", "path")
    here = own(len(levels))
    for height in range(len(levels), 1, -1):
        here = sent_down(here, levels[height - 1], levels[height - 2].count(), kept).unionByName(own(height - 1))
    return here.unionByName(own(0)) if levels else here


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", every: int = 5, proofs: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified (and proof, binary, if asked for): a row for each row.

    A leaf hashes the row's fields. Leaves of a group ascend by key, null first, rows of one key by their hash; groups
    ascend bytewise, null first. Rows whose key's crc32 `every` divides are tampered with: A-Z of their text become lower
    case. folded_root is recomputed from the tampered (or else the original) leaf and the original siblings; verified says
    whether it is the root. Repeated rows are leaves of their own. A null key counts as the empty text when rows
    to tamper with are picked. Texts may be empty, null or of any length. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    lowered = [F.translate(F.col(f), UPPER, LOWER) if f == text else F.col(f) for f in fields]
    tampered = F.when(crc_mod(key, every) == 0, F.unhex(leaf(lowered)))
    rows = kept.keep(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), F.unhex(leaf([F.col(f) for f in fields])).alias("hash"), tampered.alias("tampered")))
    placed, sizes = numbered(rows, "group", ["key", "hash"], kept)
    trees, _ = numbered(sizes.withColumn("all", F.lit(0)), "all", ["group"], kept)
    trees = kept.keep(trees.select(F.col("group").alias("group_"), "n", F.col("pos").alias("tree")))
    leaves = kept.keep(placed.join(trees, F.col("group").eqNullSafe(F.col("group_"))).select("tree", "pos", "n", "hash", "key", "tampered"))
    kind = f"key {docs.schema[key].dataType.simpleString()}"
    out = f"{kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"
    if not (count := leaves.count()):
        return spark.createDataFrame([], out).withColumnRenamed("key", key).select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * proofs)
    levels, subroots = climb(leaves, kept)
    subroots = kept.keep(subroots)
    top = subroots.select(F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).cast("bigint").alias("n"), "hash")
    top_levels, tops = climb(top, kept)
    root = bytes(tops.first()["hash"])  # one row
    start = spark.createDataFrame([(-1, len(top_levels), b"", b"")], "tree bigint, height int, subroot binary, path binary")
    to_groups = descend(top_levels, start, kept)
    if top_levels:  # the nodes over the top tree's leaves send to these
        to_groups = sent_down(to_groups, top_levels[0], trees.count(), kept)
    to_groups = to_groups.select(F.col("pos").alias("tree"), "path")
    starts = kept.keep(subroots.withColumnRenamed("hash", "subroot").join(to_groups, "tree"))
    paths = descend(levels, starts, kept)

    def verify(messages: tuple) -> list[tuple]:
        """The leaves under one node, or a tree's only leaf, with the path that they hear."""
        _, met = messages
        *own, (_, path, subroot, _, _) = sorted(met, key=lambda m: FANOUT if m[0] is None else m[0])
        children, lone = b"".join(m[1] for m in own), own[0][4] == 1
        node = combine(children)
        usual = None if lone else fold(node, path)
        found = []
        for slot, digest, changed, key, _ in own:
            proof = path if lone else step(children, slot) + path
            if lone:
                up = fold(changed or digest, path)
            else:
                at = slot * DIGEST
                above = combine(children[:at] + (changed or digest) + children[at + DIGEST :])
                up = usual if above == node else fold(above, path)
            found.append((key, digest.hex(), subroot.hex(), root.hex(), proof_digest(proof), up.hex(), up == root, proof if proofs else None))
        return found

    own = leaves.select("tree", F.floor(F.col("pos") / FANOUT).alias("pos"), (F.col("pos") % FANOUT).alias("slot"), "hash", "tampered", "key", "n")
    heard = paths.select("tree", "pos", F.lit(None).cast("bigint").alias("slot"), F.col("path").alias("hash"), F.col("subroot").alias("tampered"), F.lit(None).cast(kind.split(" ", 1)[1]).alias("key"), F.lit(0).cast("bigint").alias("n"))
    rdd = own.unionByName(heard).rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), None if r[4] is None else bytes(r[4]), r[5], r[6])))
    found = kept.keep(spark.createDataFrame(rdd.groupByKey(tasks(rdd, count)).flatMap(verify), out, verifySchema=False))
    kept.only(found)
    return found.withColumnRenamed("key", key).select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * proofs)
