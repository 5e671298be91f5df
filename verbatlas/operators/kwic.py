"""Keyword-in-context lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.sources import tables

from . import cql

#: What joins the token before it without a space.
GLUED = r'^[.,!?;:»" ]+$'


def joined(surfaces: Column) -> Column:
    """Tokens with spaces between them, punctuation close to the token before."""
    return F.array_join(F.transform(surfaces, lambda t, i: F.when((i == 0) | t.rlike(GLUED), t).otherwise(F.concat(F.lit(" "), t))), "")


def span_lines(docs: DataFrame, pattern: cql.Pattern) -> DataFrame:
    """match_id, doc_id, sentence_no, left_context, keyword, right_context of every match.

    Tokens stay in their document's row, so lines are cut without a join.
    """
    n = len(pattern)

    def sentence(tokens: Column, i: Column) -> Column:
        first = F.get(tokens, i)
        return F.struct(F.slice(tokens, i - first["place"] + 1, first["size"])["surface"].alias("s"), first["place"].alias("at"))

    hits = cql.in_documents(docs, pattern, payload=sentence).select("doc_id", "sentence_no", "match_start", "payload.*")
    return hits.select(
        F.concat_ws("_", "doc_id", "sentence_no", "match_start").alias("match_id"),
        "doc_id",
        "sentence_no",
        joined(F.slice("s", F.lit(1), F.col("at"))).alias("left_context"),
        joined(F.slice("s", F.col("at") + 1, F.lit(n))).alias("keyword"),
        joined(F.slice("s", F.col("at") + n + 1, F.greatest(F.size("s") - F.col("at") - n, F.lit(0)))).alias("right_context"),
    )


def around_first(sentence: Column, surface: Column) -> tuple[Column, Column]:
    """The text before and after the first place where the surface stands; all before if it does not."""
    at = F.instr(sentence, surface)
    left = F.when(at > 0, F.substring(sentence, F.lit(1), at - 1)).otherwise(sentence)
    right = F.when(at > 0, F.substring(sentence, at + F.length(surface), F.length(sentence))).otherwise(F.lit(""))
    return F.regexp_replace(left, r"\s+$", ""), F.regexp_replace(right, r"^\s+", "")


def lemma_lines(docs: DataFrame, lemma: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of lines for all tokens with the lemma, with the total and the number of pages.

    Contexts are cut around the first occurrence of the surface in the sentence, also for a later one.
    """
    number, size = max(1, number), min(100, max(1, size))
    matches = lambda surface: X.may_have_lemma(surface, lemma) & (F.lower(X.lemma_of(surface)) == lemma.lower())
    # a sentence is cut for its tokens only, and the rows keep their number
    found = F.flatten(F.transform(X.sentences(F.col("text")), lambda s: F.filter(X.surfaces(s["sentence"]), matches)))
    # the corpus is cut once, for a number per document; the page's lines stand in its first documents that have any
    counted = tables.kept(docs.select("doc_id", F.size(found).alias("hits")).filter("hits > 0"), "hits")
    total = counted.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("total"))
    first = counted.select("doc_id").orderBy("doc_id").limit(number * size).distinct().withColumnRenamed("doc_id", "wanted")
    some = docs.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    rows = some.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "s"))
    rows = rows.select("doc_id", "sentence_no", F.col("s.sentence").alias("sentence"))
    hits = rows.select("doc_id", "sentence_no", "sentence", F.posexplode(X.surfaces(F.col("sentence"))).alias("place", "surface")).filter(matches(F.col("surface")))
    shown = hits.orderBy("doc_id", "sentence_no", "place").offset((number - 1) * size).limit(size)
    left, right = around_first(F.col("sentence"), F.col("surface"))
    lines = shown.select("doc_id", "sentence_no", "place", left.alias("left_context"), F.col("surface").alias("keyword"), right.alias("right_context"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return lines.join(F.broadcast(total)).withColumn("pages", pages)


def page_count(total: int, size: int) -> int:
    return math.ceil(total / min(100, max(1, size)))
