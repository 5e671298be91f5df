"""Hand-computed fixtures for tokens, tags, queries, concordances, statistics and disambiguation."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import corpus, cql, disambiguation, kwic

TEXT = "Drugi dom byl veliky. Profesori rabotajut tam medlenno!"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT, "a"), (2, "dom i dom.\n \n  Second part? ", "b"), (3, "", "b"), (4, None, "b")], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def tokens(docs):
    return corpus.tagged(corpus.token_table(docs)).cache()


def test_positions(docs):
    rows = corpus.positions(docs).filter("doc_id = 1").orderBy("token_index").collect()
    assert [r["token_index"] for r in rows] == list(range(10))
    assert [r["word_index"] for r in rows] == [0, 1, 2, 3, -1, 4, 5, 6, 7, -1]
    assert [r["sentence_no"] for r in rows] == [0] * 5 + [1] * 5
    assert {r["segment"] for r in corpus.segment_table(docs).filter("doc_id = 2").collect()} == {0, 1}
    assert [r["sentence"] for r in corpus.sentence_table(docs).filter("doc_id = 2").orderBy("sentence_no").collect()] == ["dom i dom.", "Second part?"]


def test_tags(tokens):
    rows = {r["surface"]: (r["pos"], r["lemma"]) for r in tokens.filter("doc_id = 1").collect()}
    assert rows["Drugi"] == ("ADJ", "drugi") and rows["dom"] == ("NOUN", "d") and rows["byl"] == ("X", "byl")
    assert rows["veliky"] == ("ADJ", "veliky") and rows["Profesori"] == ("ADJ", "profesori") and rows["rabotajut"] == ("X", "rabotajut")
    assert rows["tam"] == ("VERB", "ta") and rows["medlenno"] == ("ADV", "medlenno") and rows["."] == ("PUNCT", ".")


@pytest.mark.parametrize("word, pos, lemma", [("om", "NOUN", "om"), ("bylla", "VERB", "byll"), ("la", "NOUN", "l"), ("am", "X", "am"), ("a", "X", "a"), ("du", "X", "du"), ("domu", "NOUN", "dom"), ("123", "X", "123"), ("жена", "X", "жена")])
def test_tag_rules(spark, word, pos, lemma):
    row = spark.range(1).select(X.pos_of(F.lit(word)).alias("p"), X.lemma_of(F.lit(word)).alias("l")).first()
    assert (row["p"], row["l"]) == (pos, lemma)


T = cql.token
PATTERNS = [
    [T(pos="ADJ"), T(lemma="d")],
    [T(pos="ADV"), T(pos="PUNCT")],
    [T(surface="veliky"), T(surface="Profesori")],
    [T(surface="DOM")],
    [T().but(pos="X")],
    [T(number="sg", pos="NOUN")],
    [T().but(case="dat"), T(pos="X")],
    [T(), T(pos="PUNCT")],
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_plans_agree(docs, tokens, pattern):
    feats = F.to_json(F.str_to_map("feats", F.lit("\\|"), F.lit("=")))
    table = tokens.withColumn("feats", F.when(F.col("feats") == "", "{}").otherwise(feats))
    lead = {tuple(r) for r in cql.by_lead(table, pattern, ["doc_id", "sentence_no"]).collect()}
    join = {tuple(r) for r in cql.by_join(table, pattern, ["doc_id", "sentence_no"]).collect()}
    array = {tuple(r) for r in cql.in_documents(docs, pattern).collect()}
    assert lead == join == array


def test_matches(docs):
    found = lambda q: {tuple(r)[2:] for r in cql.in_documents(docs, q).filter("doc_id = 1").collect()}
    assert found(PATTERNS[0]) == {(0, 1)} and found(PATTERNS[1]) == {(8, 9)} and found(PATTERNS[2]) == set() and found(PATTERNS[3]) == {(1, 1)}
    with pytest.raises(ValueError):
        cql.in_documents(docs, [])


def test_sentences_are_cut_into_tokens_once(docs):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert plan(corpus.token_table(docs)) == plan(corpus.positions(docs)) == 1
    assert [plan(cql.in_documents(docs, p)) for p in PATTERNS] == [1] * len(PATTERNS)
    assert plan(kwic.span_lines(docs, PATTERNS[0])) == 1
    assert plan(corpus.document_metrics(docs, docs.sparkSession.createDataFrame([("tam",)], "slug string"))) == 1


def test_ranges_hold_the_letters_of_both_cases(spark):
    rows = spark.createDataFrame(pd.DataFrame({"t": [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]}))
    folded = rf"(?iu)[{X.WORD_CLASS}]"
    assert rows.filter(F.col("t").rlike(folded) != X.is_word(F.col("t"))).count() == 0
    letters = r"(?iu)[^a-zа-яёѕєіјљњћџѫѭѣžčšě]"
    assert rows.filter(F.regexp_replace(F.lower("t"), letters, "") != X.clean(F.col("t"))).count() == 0


def test_pages(docs):
    matches = cql.in_documents(docs, [T().but(pos="NONE")])
    first = cql.page(matches, ["doc_id", "match_start"], 1, 4).collect()
    assert len(first) == 4 and all(r["has_more"] for r in first)
    last = cql.page(matches, ["doc_id", "match_start"], 5, 4).collect()
    assert len(last) == 1 and not last[0]["has_more"]
    assert kwic.page_count(17, 4) == 5


def test_lines(docs):
    line = kwic.span_lines(docs, PATTERNS[0]).first()
    assert (line["left_context"], line["keyword"], line["right_context"], line["match_id"]) == ("", "Drugi dom", "byl veliky.", "1_0_0")
    lines = [r for r in kwic.lemma_lines(docs, "d").collect() if r["doc_id"] == 2]
    assert [(r["left_context"], r["right_context"]) for r in lines] == [("", "i dom."), ("", "i dom.")] and lines[0]["total"] == 3


def test_frequencies(spark):
    docs = spark.createDataFrame([(1, "a a a b c d", "x")], "doc_id long, text string, source string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "slug string")
    rows = [tuple(r) for r in corpus.frequencies(docs, known).orderBy("freq_rank").collect()]
    assert rows == [("a", 3, 600000.0, 1, False), ("b", 1, 200000.0, 2, True), ("c", 1, 200000.0, 3, True)]
    back = {r["slug"]: (r["freq"], r["freq_rank"]) for r in corpus.write_back(known, corpus.frequencies(docs, known)).collect()}
    assert back == {"a": (3, 1), "b": (1, 2), "c": (1, 3), "z": (0, None)}


def test_ranks_are_a_permutation(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("freq"), F.concat(F.lit("w"), F.col("id")).alias("slug"))
    got = corpus.ranked(rows).collect()
    want = sorted(got, key=lambda r: (-r["freq"], r["slug"]))
    assert [r["freq_rank"] for r in want] == list(range(1, 501))


def test_zipf(spark):
    ranks = spark.createDataFrame([(1, 100), (2, 48), (3, 30), (4, 22), (5, 1)], "freq_rank long, freq long")
    assert corpus.zipf_alpha(ranks).first()["alpha"] == pytest.approx(1.095509)
    assert corpus.zipf_alpha(ranks.filter("freq_rank > 3")).first()["alpha"] is None


def test_dispersion(spark):
    rows = [("w", "fiction", 6), ("w", "news", 3), ("v", "third", 2)]
    d = {r["slug"]: r["d"] for r in corpus.dispersion(spark.createDataFrame(rows, "slug string, genre string, freq long")).collect()}
    assert d["w"] == 0.5
    single = corpus.dispersion(spark.createDataFrame(rows[:1], "slug string, genre string, freq long")).first()
    assert single["d"] == 0.01


@pytest.mark.parametrize("marks, value", [("ru+ uk+ pl~ xx+", 1.2), (None, 1.3), ("xx+", 1.3), ("ru-", 1.0)])
def test_k_slav(spark, marks, value):
    assert spark.createDataFrame([(marks,)], "m string").select(corpus.k_slav(F.col("m"))).first()[0] == pytest.approx(value)


def test_tiers(spark):
    rows = spark.range(11501).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("slug"), F.lit("g").alias("genre"), (F.lit(20000) - F.col("id")).alias("freq"))
    marks = spark.createDataFrame([], "slug string, intelligibility string")
    got = {r["slug"]: r["cefr_level"] for r in corpus.usage_levels(rows, marks).collect()}
    level = lambda i: got[f"w{i:06d}"]
    assert [level(i) for i in (499, 500, 1499, 1500, 3499, 3500, 6499, 6500, 11499, 11500)] == ["A1", "A2", "A2", "B1", "B1", "B2", "B2", "C1", "C1", "C2"]


def test_metrics(docs, spark):
    known = spark.createDataFrame([("tam",)], "slug string")
    rows = {r["doc_id"]: r for r in corpus.document_metrics(docs, known).collect()}
    assert (rows[1]["tokens"], rows[1]["words"], rows[1]["sentences"], rows[1]["oov_rate"], rows[1]["punct_density"], rows[1]["space_words"]) == (10, 8, 2, 25, 20, 8)
    assert rows[3]["tokens"] == 0 and rows[3]["oov_rate"] == 0


def test_government(spark):
    options = [("f", "x", "nom", 9), ("f", "x", "acc", 5), ("f", "x", "loc", 1)]
    contexts = spark.createDataFrame([("v", "f"), ("dom", "f"), (None, "f"), ("v", "none")], "left_word string, form string")
    out = disambiguation.disambiguated(contexts, spark.createDataFrame(options, "form string, slug string, `case` string, freq long"), disambiguation.government(spark))
    got = {(r["left_word"], r["form"]): r["case"] for r in out.collect()}
    assert got == {("v", "f"): "loc", ("dom", "f"): "nom", (None, "f"): "nom", ("v", "none"): None} or got[(None, "f")] is None and got[("v", "f")] == "loc"


def test_hot_update(spark):
    kind = "form string, slug string, `case` string, freq long"
    stored = spark.createDataFrame([("f", "d", "loc", 50), ("f", "d", "nom", 400), ("g", "e", None, 5)], kind)
    out = disambiguation.hot_update(stored, spark.createDataFrame([("f", "d", "nom", 7)], kind)).orderBy("form", "place")
    assert [(r["form"], r["case"], r["freq"]) for r in out.collect()] == [("f", "nom", 7), ("f", "loc", 1), ("g", None, 5)]
