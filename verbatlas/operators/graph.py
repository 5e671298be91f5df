"""Typed relations between meanings: neighbourhoods, two hops, and changes. Edges are (source, target, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.operators import dealing
from verbatlas.sources import tables


def normalized(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """Distinct edges without self-loops; those of symmetric types run from the smaller to the larger end."""
    both = F.col("type").isin(*symmetric)
    ends = edges.filter("source <> target").select(
        F.when(both, F.least("source", "target")).otherwise(F.col("source")).alias("source"),
        F.when(both, F.greatest("source", "target")).otherwise(F.col("target")).alias("target"),
        "type",
    )
    return dealing.distinct(ends, edges.count())


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, type) from both ends; a self-loop once. Two equi-joins' worth of rows instead of a join on OR."""
    forth = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type")
    back = edges.filter("source <> target").select(F.col("target").alias("node"), F.col("source").alias("other"), "type")
    return forth.unionByName(back)


def directed(edges: DataFrame) -> DataFrame:
    """(node, other, type, direction): out from the source, in at the target."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", F.lit("out").alias("direction"))
    in_ = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionByName(in_)


def two_hops(edges: DataFrame, roots: DataFrame, fan_out: int = 4, look: int = 16) -> DataFrame:
    """(root, parent, child): at most fan_out children per parent, none that is the root, a first-level node, or a child of an earlier parent.

    A child belongs to its smallest parent; parents and children count in the order of their ids.

    In rounds: of a root, the children up to a bound are met under all its parents, so who owns them is final. The bound is the `look`-th child of the
    parent that needs most; roots with a parent that lacks children and has more go on beyond it, with eight times `look`. A child is met
    once at most, so that all rounds together never exceed the whole second level.
    """
    near = tables.kept(_near(edges), "near").select("node", "other", "place", "last")
    n = dealing.parts(near.sparkSession, near.count() // 2)
    ends = near.filter("last").select(F.col("node").alias("parent"), F.col("other").alias("end"))
    first = roots.distinct().join(near, roots["root"] == near["node"]).select("root", F.col("other").alias("parent"))
    # lower: what was met of the root; lacking: the parent may have more children
    blank = F.lit(None).cast(near.schema["other"].dataType).alias("lower")
    state = tables.kept(first.join(ends, "parent").select("root", "parent", "end", blank, F.lit(0).alias("got"), F.lit(True).alias("lacking")), "pairs")
    met = near.select("node", F.col("other").alias("child")).repartition(n, "node")
    rounds = []
    while True:
        marks = near.filter(F.col("place") == look).select(F.col("node").alias("parent"), F.col("other").alias("mark"))
        needs = state.filter("lacking").join(marks, "parent", "left").groupBy("root").agg(F.max(F.coalesce("mark", "end")).alias("upper"))
        asked = state.join(needs, "root")
        within = (met["node"] == asked["parent"]) & (met["child"] <= asked["upper"]) & (asked["lower"].isNull() | (met["child"] > asked["lower"]))
        second = tables.kept(met.join(asked, within).filter("child <> root").select("root", "child", "parent"), "second")
        seen = asked.select("root", F.col("parent").alias("child"), F.lit(None).cast(second.schema["parent"].dataType).alias("parent"))
        both = second.withColumn("known", F.lit(0)).unionByName(seen.withColumn("known", F.lit(1)))
        owned = dealing.dealt(both, second.count() + state.count(), "root", "child").groupBy("root", "child").agg(F.min("parent").alias("parent"), F.max("known").alias("known"))
        order = Window.partitionBy("root", "parent").orderBy("child")
        least = owned.filter("known = 0").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= fan_out)
        found = least.join(asked.select("root", "parent", "got"), ["root", "parent"]).filter(F.col("nth") + F.col("got") <= fan_out)
        rounds.append(tables.kept(found.select("root", "parent", "child"), "children"))
        new = rounds[-1].groupBy("root", "parent").agg(F.count("*").cast("int").alias("new"))
        got = F.col("got") + F.coalesce("new", F.lit(0))
        lacking = F.col("lacking") & (got < fan_out) & (F.col("end") > F.col("upper"))
        after = asked.join(new, ["root", "parent"], "left").select("root", "parent", "end", F.col("upper").alias("lower"), got.alias("got"), lacking.alias("lacking"))
        state, look = tables.kept(after, "pairs"), 8 * look
        if state.filter("lacking").isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _near(edges: DataFrame) -> DataFrame:
    """(node, other, place, last): distinct neighbours other than the node, by their order, with their place and whether it is the last one.

    Sorted once by node; repeats stand side by side there, so nothing is hashed.
    """
    ends = undirected(edges).select("node", "other").filter("node <> other")
    order = Window.partitionBy("node").orderBy("other")
    sides = dealing.dealt(ends, edges.count(), "node").select(
        "node", "other", F.dense_rank().over(order).alias("place"), F.lead("other").over(order).alias("next")
    )
    return sides.filter("next IS NULL OR next <> other").select("node", "other", "place", F.col("next").isNull().alias("last"))


def changes(existing: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """What has to be added and removed to get from existing to wanted: the columns in `on`, and action. One grouping of both; nulls are equal."""
    sides = existing.select(*on, F.lit(True).alias("there")).unionByName(wanted.select(*on, F.lit(False).alias("there")))
    dealt = dealing.dealt(sides, existing.count() + wanted.count(), *on)
    found = dealt.groupBy(*on).agg(F.min("there").alias("always"), F.max("there").alias("ever")).filter("always = ever")
    return found.select(*on, F.when(F.col("ever"), "remove").otherwise("add").alias("action"))


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after nodes were merged by (old, new): re-pointed, without self-loops and repeats; edges may hold repeats."""
    m = mapping.select("old", "new")
    moved = edges.join(m, edges["source"] == m["old"], "left").select(F.coalesce("new", "source").alias("source"), "target", "type")
    moved = moved.join(m, moved["target"] == m["old"], "left").select("source", F.coalesce("new", "target").alias("target"), "type")
    return dealing.distinct(moved.filter("source <> target"), edges.count())
