"""Tokens cut in slices of Arrow batches are those of the column functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import arrow_tokens, corpus

ODD = [
    "Hi. there!  You\n\nNew seg?  x\n \ny.\nz",
    None,
    "",
    "  \n\n ",
    "ſof ŽČ иᲀа İx !! . ?a b c 😀😀 a😀b",
    "\n\n.a .b . c",
    "x y",
    "a.\x1cb. \x0bc\x85d e",
    "...\n\n...!\tq",
    "word",
    None,
    " ",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 6 else i, t, str(i)) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_classes_are_those_of_the_pattern(spark):
    points = spark.range(0x110000).filter("id < 55296 or id > 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    for pattern, kind in ((rf"(?iu)[{X.WORD_CLASS}]", arrow_tokens.WORD), (r"\s", arrow_tokens.WHITE)):
        assert [r["id"] for r in points.filter(F.col("c").rlike(pattern)).orderBy("id").collect()] == np.flatnonzero(arrow_tokens.classes() == kind).tolist()


def test_positions_without_arrays_of_tokens(spark, odd):
    assert same(arrow_tokens.positions(odd), corpus.positions(odd)) and same(arrow_tokens.positions(odd, "source"), corpus.positions(odd, "source"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert same(arrow_tokens.positions(docs), corpus.positions(docs)) and arrow_tokens.positions(docs.limit(0)).isEmpty()


def test_queries_make_no_array_of_tokens(spark):
    from verbatlas.plans import catalog

    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("tokenize_positions", "reanalysis"):
        # the column form numbers words by filters of arrays of structs in the document's row
        assert "filter(" not in plan(name)


def test_sentences_without_a_shuffle_of_tokens(spark, odd):
    from verbatlas.functions import strings as S
    from verbatlas.operators import maintenance

    known = spark.createDataFrame([("a",), ("seg",), ("иваiх",), ("x",)], "slug string")
    own = odd.withColumns({"title": F.concat(F.lit("& "), "source"), "author": F.when(F.col("source") != "8", "<q>")})
    lines = maintenance.tei_lines(own, own, known, "title", "author")
    got = lines.select("doc_id", F.posexplode("lines").alias("sentence_no", "s")).select("doc_id", "sentence_no", "s.segment", F.col("s.xml").alias("xml"))
    s, a = F.col("surface"), X.analysis(F.col("surface"))
    tokens = corpus.positions(odd).join(known, F.lower(s) == F.col("slug"), "left")
    tokens = tokens.withColumn("x", S.tei_token(s, a["lemma"], a["pos"], a["feats"], a["pos"] != "PUNCT", F.col("slug").isNotNull()))
    per = tokens.groupBy("doc_id", "sentence_no", "segment").agg(F.array_sort(F.collect_list(F.struct("token_index", "x"))).alias("t"))
    want = per.select("doc_id", "sentence_no", "segment", F.concat(F.lit('<s n="'), F.col("sentence_no") + 1, F.lit('">'), F.array_join("t.x", " "), F.lit("</s>")).alias("xml"))
    assert same(got, want) and 'cert="low"' in str(want.collect()) and not want.filter("doc_id is null").isEmpty()
    whole = maintenance.tei_texts(lines).filter("doc_id is not null")
    assert same(whole, maintenance.tei_documents(want.filter("doc_id is not null"), own.select("doc_id", "title", "author")))
    from verbatlas.plans import catalog

    # nothing is dealt by sentence
    for name in ("tei_sentence", "tei_document"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "sentence_no" in x]


def test_neighbours_and_vocabulary(spark, odd):
    tokens = corpus.positions(odd).filter("doc_id is not null")
    pair = F.struct(F.col("token_index") + 1, "sentence_no", "doc_id")
    next_ = tokens.select(F.struct("token_index", "sentence_no", "doc_id").alias("k"), F.col("surface").alias("next"))
    want = tokens.join(next_, F.col("k") == pair).select("doc_id", "token_index", "surface", "next")
    assert same(arrow_tokens.followed(odd.filter("doc_id is not null")), want) and want.count() > 10
    counts = corpus.positions(odd).groupBy("surface").agg(F.count("*").alias("n"), F.max(F.col("word_index") >= 0).alias("word")).select("surface", "word", "n")
    for docs in (odd, odd.repartition(3)):
        assert same(arrow_tokens.vocabulary(docs).groupBy("surface", "word").agg(F.sum("n").alias("n")), counts)
    pairs = corpus.positions(odd).filter("word_index >= 0").groupBy("doc_id", "surface").agg(F.count("*").alias("n"))
    assert same(arrow_tokens.words(odd), pairs)


def test_enclitics_make_no_array_of_tokens(spark):
    from verbatlas.plans import catalog

    plan = catalog.QUERIES["enclitics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the distinct surfaces of a slice are tagged, not every token
    assert "regexp_extract_all(text#" not in plan


def test_words_of_the_corpus_come_from_slices(spark):
    from verbatlas.plans import catalog

    plan = catalog.QUERIES["dict_analyze"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    cuts = [x for x in plan.splitlines() if "Generate" in x and "regexp_extract_all" in x]
    # only the lexicon's texts are cut by generated rows of tokens: once for forms, once for prefixes
    assert len(cuts) == 2 and plan.count("MapInArrow") == 3


def test_metrics_of_distinct_words(spark, odd):
    from verbatlas.plans import catalog

    known = spark.createDataFrame([("word",), ("c",)], "slug string")
    docs = odd.filter("doc_id is not null").unionByName(spark.createDataFrame([(50, "Byl byl byl c C dom... (x) y!", "z")], odd.schema))
    assert same(corpus.metrics_by_forms(arrow_tokens.counts(docs), known), corpus.document_metrics(docs, known))
    plan = catalog.QUERIES["doc_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and "MapInArrow" in plan
