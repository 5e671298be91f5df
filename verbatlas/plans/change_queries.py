"""Queries on stored structures that follow changes: a text index and a token table."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.operators import text_index, token_store
from verbatlas.sources import tables

from .corpus_queries import TOK, _docs
from .registry import query

_SEARCHES = ["tionth", "Revised Text", "on the", "withdrawn", "ing"]
_NEW_TEXT = """CASE WHEN doc_id % 50 = 3 THEN NULL WHEN doc_id % 50 = 7 THEN 'Revised text: ' || text WHEN doc_id % 50 = 11 THEN reverse(text) ELSE text END"""
_CHANGED = f"""changed AS (SELECT doc_id, {_NEW_TEXT} AS text FROM documents UNION ALL SELECT doc_id + 1000000000, 'Not withdrawn. ' || text FROM documents WHERE doc_id % 50 = 7
  UNION ALL SELECT doc_id + 2000000000, text FROM documents WHERE doc_id % 50 = 3)"""


@query(
    f"""WITH {_CHANGED}, searches AS (SELECT unnest({_SEARCHES}) AS search), found AS (SELECT search, doc_id,
      (len(string_split(lower(text), lower(search))) - 1)::BIGINT AS matches FROM changed, searches WHERE contains(lower(text), lower(search)))
    SELECT phase, search, doc_id, matches FROM found, (SELECT unnest(['merged', 'compacted']) AS phase)"""
)
def index_search(spark, d):
    """Searches in a stored index of all documents after two sets of changes, and again after they were merged into a new base; no text is read."""
    docs, path = _docs(spark, d), tables.scratch(spark, "index")
    text_index.build(docs, "doc_id", "text", path)
    text = F.col("text")
    turn = F.col("doc_id") % 50
    moved = docs.filter(turn.isin(3, 7, 11)).select("doc_id", text.alias("old"), F.when(turn == 7, F.concat(F.lit("Revised text: "), text)).when(turn == 11, F.reverse(text)).alias("new"))
    none = F.lit(None).cast("string")
    added = docs.filter(turn.isin(3, 7)).select(
        (F.col("doc_id") + F.when(turn == 7, 1_000_000_000).otherwise(2_000_000_000)).alias("doc_id"), none.alias("old"), F.when(turn == 7, F.concat(F.lit("Not yet: "), text)).otherwise(text).alias("new")
    )
    text_index.change(moved.unionByName(added), "doc_id", "old", "new", path, 1)
    # the second change rewrites rows that the first one added
    again = added.filter(F.col("doc_id") < 2_000_000_000).select("doc_id", F.col("new").alias("old"), F.concat(F.lit("Not withdrawn. "), F.expr("substring(new, 10)")).alias("new"))
    text_index.change(again, "doc_id", "old", "new", path, 2)
    before = tables.kept(text_index.search(spark, path, _SEARCHES).withColumn("phase", F.lit("merged")), "found")
    text_index.compact(spark, path)
    after = text_index.search(spark, path, _SEARCHES).withColumn("phase", F.lit("compacted"))
    return before.unionByName(after).select("phase", "search", F.col("key").alias("doc_id"), "matches")


_REPLACED = TOK.replace(
    "FROM documents", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 100 = 7 THEN 'Rewritten now. ' || text WHEN doc_id % 100 = 8 THEN '' ELSE text END AS text FROM documents)"
)


@query(f"WITH {_REPLACED} SELECT doc_id, token_index, segment, sentence_no, surface FROM tok")
def replaced_tokens(spark, d):
    """The stored tokens after two batches replaced one document in a hundred each (one of them leaves none), the first batch twice."""
    docs, path = _docs(spark, d), tables.scratch(spark, "tokens")
    token_store.create(docs, path, 64)
    turn = F.col("doc_id") % 100
    revised = docs.filter(turn == 7).withColumn("text", F.concat(F.lit("Rewritten now. "), "text"))
    token_store.replace(revised, path, 64, "revised")
    token_store.replace(docs.filter(turn == 8).withColumn("text", F.lit("")), path, 64, "emptied")
    token_store.replace(revised, path, 64, "revised-again")
    return token_store.read(spark, path).select("doc_id", "token_index", "segment", "sentence_no", "surface")
