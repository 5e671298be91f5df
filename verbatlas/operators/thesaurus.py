"""Thesauri: nested entries as edges, ancestors by levels, and definitions made from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.sources import tables

#: A word's senses, each with its synset and what lies above it.
ENTRIES = "word string, senses array<struct<synset: long, hypernyms: array<struct<synset: long>>>>"


def senses(entries: DataFrame) -> DataFrame:
    """(word, synset) of every sense of nested entries; words without senses have none."""
    return entries.select("word", F.explode("senses").alias("s")).select("word", "s.synset").filter("synset IS NOT NULL").distinct()


def hypernyms(entries: DataFrame) -> DataFrame:
    """(child, parent): distinct edges between synsets, from the senses' own lists."""
    rows = entries.select(F.explode("senses").alias("s")).select(F.col("s.synset").alias("child"), F.explode("s.hypernyms").alias("h"))
    return rows.select("child", F.col("h.synset").alias("parent")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct()


def ancestors(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance) of all nodes that lie up to `depth` edges above those of starts (start, node), at their least distance.

    One level at a time: what the last level reached first meets the edges, and what was seen before falls out, so a cycle ends by itself. Each level is a
    table of its own; the plan of a level doesn't hold those before. Starts are at distance 0.
    """
    front = tables.kept(starts.select("start", "node").distinct().withColumn("distance", F.lit(0)), "level")
    seen, up = [front], edges.select(F.col("child").alias("node"), "parent").distinct()
    for distance in range(1, depth + 1):
        reached = front.join(up, "node").select("start", F.col("parent").alias("node")).distinct()
        for level in seen:
            reached = reached.join(level.select("start", "node"), ["start", "node"], "left_anti")
        front = tables.kept(reached.withColumn("distance", F.lit(distance)), "level")
        seen.append(front)
    out = seen[0]
    for level in seen[1:]:
        out = out.unionByName(level)
    return out


def defined(words: DataFrame, rules: DataFrame, templates: DataFrame) -> DataFrame:
    """word, rule, root, definition from rules (suffix, least, rule) and templates (rule, nth, template).

    A word's endings meet the suffixes in one equi-join; the longest decides whose word has `least` letters, and leaves two before it. The empty suffix fits all words.
    Of a rule's templates the word's length chooses one in turn; WORD and ROOT in it stand for the word with a capital and for what stands before the suffix.
    """
    lower = F.lower("word")
    endings = F.explode(F.transform(F.sequence(F.lit(0), F.length(lower)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.substring(lower, F.length(lower) - n + 1, n)))).alias("suffix")
    met = words.select("word", endings).distinct().join(rules, "suffix").filter((F.length("word") >= F.col("least")) & (F.length("suffix") <= F.length("word") - 2) | (F.col("suffix") == ""))
    chosen = met.groupBy("word").agg(F.max_by(F.struct("suffix", "rule"), F.length("suffix")).alias("c"))
    counts = templates.groupBy("rule").agg(F.count("*").alias("templates"))
    root = F.substring(lower, F.lit(1), F.length(lower) - F.length("c.suffix"))
    rows = chosen.select("word", F.col("c.rule").alias("rule"), root.alias("root")).join(counts, "rule").withColumn("nth", F.length("word") % F.col("templates"))
    capital = F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))
    text = F.replace(F.replace("template", F.lit("WORD"), capital), F.lit("ROOT"), F.col("root"))
    return rows.join(templates, ["rule", "nth"]).select("word", "rule", "root", text.alias("definition"))
