"""Shortcuts that leave work out give what the whole work gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import disambiguation
from verbatlas.sources import tables

WORDS = ["Of", "of", "oft", "ofom", "o-f", "f", "!!", "fo", "OFLA", "ſof", "на", "Наом", "", None]


def test_no_lemma_is_missed(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for lemma in ("of", "OF", "на", "!!", "o"):
        own = F.lower(X.lemma_of(F.col("w"))) == lemma.lower()
        assert rows.filter(own & ~X.may_have_lemma(F.col("w"), lemma)).count() == 0
    assert rows.filter(X.may_have_lemma(F.col("w"), "of")).count() < len(WORDS)


def test_pairs_after_given_words(spark):
    docs = spark.createDataFrame([(1, "V lese. na! NA dom v v kromě. Dom"), (2, None), (3, " "), (4, "dom"), (5, "v.\n\nlese v")], "doc_id long, text string")
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    every = disambiguation.neighbours(docs)
    assert rows(disambiguation.neighbours(docs, ["v", "na"])) == rows(every.filter("left_word in ('v', 'na')"))
    assert {r["form"]: r["n"] for r in every.filter("left_word is null").collect()} == {"v": 2, "na": 2, "dom": 2, "lese": 1}


def test_slices_of_texts_cover_all_rows(spark):
    import pyarrow as pa

    texts = pa.array(["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 8])
    assert tables.slices(texts, 10) == [(0, 2), (2, 1), (3, 2), (5, 1)] and tables.slices(texts.slice(0, 0)) == []
    rows = [(i, t) for i, t in enumerate(["x" * (1 << 20), None, "", "y" * 700_000, "z" * 700_000])]
    df = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    again = tables.decompressed(tables.packed(df, "text", "body").select("i", "body"), "body", "again")
    assert sorted((r["i"], r["again"]) for r in again.collect()) == rows


def test_prepositions_before_nouns(spark):
    from verbatlas.functions import accents

    docs = spark.createDataFrame([(1, "Na dom. na\n\ndom v Dom na"), (2, None), (3, " "), (4, "na"), (5, "na! na dom")], "doc_id long, text string")
    nouns = spark.createDataFrame([("dom", "dom", "A", "singular", "nominative")], "form string, toned string, paradigm string, number string, case string")
    found = accents.drawn_to_prepositions(docs, nouns, ["na", "v"]).select("doc_id", "token_index", "preposition", "form").collect()
    assert sorted(map(tuple, found)) == [(1, 0, "Na", "dom"), (1, 5, "v", "Dom"), (5, 2, "na", "dom")]
