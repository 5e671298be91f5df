"""A Merkle manifest of a table: leaves, group roots, one root, and a proof for each row.

Each row is a leaf, the digest of its fields. Within a group leaves are ordered by a key; every eight consecutive nodes (the last run may
have fewer, even one) become the digest of their digests, until one node remains, the group's root. The groups' roots, in order of
the group, give the table's root the same way.

A level is one window by group and parent index over the nodes of the level below: its ordered full-frame list is at once the parent's
preimage and each member's siblings. One row of each run goes on as the parent, so a level has an eighth of the rows. A row's path
is put together from the top down over the inner nodes only, an eighth of the rows again, and leaves meet it by the join that
their own window is already partitioned for. No task sees more than a run of eight rows of a group at once.

Places within a group come from a sort by range over (group, key, leaf): a group that holds a third of the rows spreads over many
ranges, and its rows are numbered by the ranges' counts.

Defined results: a null field is `-`; null groups are a group of their own, the first; equal or null keys are ordered by leaf, null keys
first, so repeated rows take neighbouring places and each has its own row; an empty table gives no rows; other columns are ignored; very
long texts are hashed whole by the digest function of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import crc_mod, materialize

#: Nodes that become one parent.
FANOUT = 8


def field(value: Column) -> Column:
    """A field as the manifest hashes it: its bytes' count, a colon and the value in text; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (with `grp` and the order's columns) with `at`, the place within the group, and `size`, the group's rows.

    Sorted by range, so that no task holds a group; a range's rows are consecutive, which gives places from one count per range and group.
    """
    lot = F.monotonically_increasing_id()  # parts wholly equal rows, so that no range has to hold them all
    ranged = nodes.withColumn("lot", lot).repartitionByRange("grp", *order, "lot").sortWithinPartitions("grp", *order, "lot").drop("lot")
    ranged = materialize(ranged.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "merkle-sorted")
    ranges = ranged.groupBy("grp", "part").agg(F.min("seq").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")
    ranges = ranges.select(F.col("grp").alias("g"), F.col("part").alias("p"), shift.alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    ranges = materialize(ranges, "merkle-ranges")
    placed = ranged.join(ranges, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return placed.withColumn("at", F.col("seq") + F.col("shift")).drop("seq", "part", "g", "p", "shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """nodes (grp, at, node, …) with `run`, the digests of their run in order, and `up`, the parent's place."""
    nodes = nodes.withColumn("up", F.shiftright("at", FANOUT.bit_length() - 1))
    frame = Window.partitionBy("grp", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("node").over(frame))


def _stepped(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with `path`, whose first step is their own run and whose others are their parent's, and its `subroot`."""
    own = F.pmod("at", F.lit(FANOUT)).cast("int")
    left, right = F.array_join(F.slice("run", F.lit(1), own), ""), F.array_join(F.slice("run", own + 2, F.lit(FANOUT)), "")
    steps = _runs(nodes).withColumn("step", F.struct(left.alias("left"), right.alias("right"))).drop("run")
    above = paths.select(F.col("grp").alias("g"), F.col("at").alias("u"), F.col("path").alias("upper"), "subroot")
    met = steps.join(above, (F.col("up") == F.col("u")) & F.col("grp").eqNullSafe(F.col("g")))
    return met.withColumn("path", F.concat(F.array("step"), F.col("upper"))).drop("up", "step", "g", "u", "upper")


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The levels above leaves (grp, at, size, node), each with the same columns; a level has only groups with more than one node below.

    The number of levels is that of the largest group; size is the group's nodes on the level, so 1 marks its root.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, below = [], leaves
    while largest > 1:
        runs = _runs(below.filter("size > 1")).filter(F.pmod("at", F.lit(FANOUT)) == 0)
        size = F.ceil(F.col("size") / FANOUT).cast("long").alias("size")
        below = materialize(runs.select("grp", F.col("up").alias("at"), size, F.sha2(F.array_join("run", ""), 256).alias("node")), "merkle-level")
        levels.append(below)
        largest = -(-largest // FANOUT)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp and node of each group's root."""
    found = leaves.filter("size = 1").select("grp", "node")
    for level in levels:
        found = found.unionByName(level.filter("size = 1").select("grp", "node"))
    return found


def descend(leaves: DataFrame, levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """leaves with the path to their group's root and on, and with `subroot`, by seeds (grp, path from the root on, subroot)."""
    seeds = seeds.select(F.col("grp").alias("g"), "path", "subroot")

    def top(nodes: DataFrame) -> DataFrame:
        return nodes.filter("size = 1").join(seeds, F.col("grp").eqNullSafe(F.col("g"))).drop("g")

    paths = None
    for level in reversed(levels):
        rows = top(level)
        if paths is not None:
            rows = rows.unionByName(_stepped(level.filter("size > 1"), paths))
        paths = materialize(rows.select("grp", "at", "path", "subroot"), "merkle-paths")
    return top(leaves) if paths is None else top(leaves).unionByName(_stepped(leaves.filter("size > 1"), paths))


def siblings(path: Column) -> Column:
    """All siblings on the path, level by level, each level's from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(node: Column, path: Column) -> Column:
    """The root that a node gives with the siblings on its path."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(rows: DataFrame, group: str, key: str, leaf: str) -> DataFrame:
    """rows with subroot, root and path (from the leaf to the root: what stands on either side in each preimage).

    group and key are the columns to group and order by, leaf holds the rows' digests. A row of any other columns is carried along.
    """
    spark = rows.sparkSession
    own = materialize(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("node"), F.struct(*rows.columns).alias("own")), "merkle-leaves")
    placed = numbered(own, ["key", "node"])
    levels = climb(placed)
    subroots = materialize(roots(placed, levels), "merkle-subroots")
    tops = numbered(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "node"), ["key"])
    above = climb(tops)
    root = roots(tops, above).first()
    none = spark.range(1).select(F.lit(0).alias("grp"), F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.lit("").alias("subroot"))
    seeds = descend(tops, above, none).select(F.col("key").alias("grp"), "path", F.col("node").alias("subroot"))
    below = descend(placed, levels, materialize(seeds, "merkle-seeds"))
    return below.select("own.*", F.col("subroot"), F.lit(root["node"] if root else None).cast("string").alias("root"), "path")


def manifest_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, grouped by lang, and each one's check against its proof after a third of the texts was tampered with.

    Where 3 divides the crc32 of the id (a null id: the empty text's), the text's A-Z are lower-cased; its leaf is folded with the siblings of the
    true tree. Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    tampered = F.when(crc_mod(F.col("doc_id"), 3) == 0, leaf_of(*fields, F.translate(text, upper, upper.lower())))
    rows = docs.select("doc_id", "lang", leaf_of(*fields, text).alias("leaf"), tampered.alias("tampered"))
    found = manifest(rows, "lang", "doc_id", "leaf")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
