"""Spellings, accents, thesauri and definitions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import accents, spellings
from verbatlas.operators import thesaurus

ACUTE, SHORT, FALLING, SHORT_FALLING = "́", "̀", "̂", "̑"


def values(spark, function, words: list) -> list:
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r["v"] for r in df.select("i", function(F.col("w")).alias("v")).orderBy("i").collect()]


def test_etymologized(spark):
    words = {"новый": "novy", "НОВЫЙ дом": "NOVY dom", "иям": "iam", "ья": "ja", "объявъя": "objavja", "Ёлка": "Jolka", "иЯ": "iA", "ѣѧѫ": "ěęų", "Ҏ҂ҏ": "Rҏ", "Щука": "Štuka", "новыйся": "novyjsja", "": "", None: None}
    assert values(spark, spellings.etymologized, list(words)) == list(words.values())


def test_glagolitic_and_back(spark):
    words = {"dzvon": "ⰷⰲⱁⱀ", "Džep": "ⰄⰆⰵⱂ", "ja jemu": "ⰻⰰ ⱔⰿⱆ", "Štuka": "Ⱋⱆⰽⰰ", "Yj": "ⰟⰉⰻ", "xq-1": "xq-1", None: None}
    assert values(spark, spellings.glagolitic, list(words)) == list(words.values())
    assert values(spark, spellings.from_glagolitic, list(words.values())) == list(words)
    assert values(spark, spellings.from_glagolitic, ["ⱘⰉⰀ"]) == ["ųIA"]  # ǫ and a capital ja have no signs of their own


def test_simple_cyrillic(spark):
    words = {"dobrij dom": "добри дом", "ijas": "иас", "kraj": "краі", "zemja": "земіа", "Ksen": "Ќен", "pęť": "пeть", "maťe": "мате", "Ě": "Е", None: None}
    assert values(spark, spellings.simple_cyrillic, list(words)) == list(words.values())
    assert values(spark, spellings.single_j, ["mojji JJ"]) == ["moji J"]


def test_verb_accents(spark):
    cells = [
        ("A", "present", "1sg", "znajų", f"zna{ACUTE}jų"),
        ("B", "present", "1sg", "nosjų", f"nosjų{SHORT}"),
        ("B", "present", "2sg", "nosiš", f"no{ACUTE}siš"),
        ("C", "present", "3pl", "povedųt", f"po{SHORT}vedųt"),
        ("C", "aorist", "2sg", "spase", f"spase{SHORT}"),
        ("A", "aorist", "1sg", "dělah", f"dě{ACUTE}lah"),
        ("B", "imperfect", "1sg", "nesěah", f"nesě{FALLING}ah"),
        ("C", "l_participle", "fem_sg", "nesla", f"nesla{SHORT}"),
        ("C", "l_participle", "neut_sg", "neslo", f"ne{SHORT}slo"),
        ("B", "imperative", "2pl", "nosite", f"nosi{ACUTE}te"),
        ("B", "infinitive", "-", "nositi", "nositi"),
        ("A", "present", "3sg", "ft", "ft"),
    ]
    df = spark.createDataFrame(cells, "p string, t string, c string, f string, want string")
    for r in df.withColumn("got", accents.verb_tone(F.col("f"), F.col("p"), F.col("t"), F.col("c"))).collect():
        assert r["got"] == r["want"], r


def test_closed_class_accents(spark):
    df = spark.createDataFrame([("B", "genitive", "kogo"), ("B", "nominative", "kto"), ("C", "nominative", "ja"), ("C", "genitive", "mene")], "p string, c string, f string")
    got = [r["v"] for r in df.select(accents.pronoun_tone(F.col("f"), F.col("p"), F.col("c")).alias("v")).collect()]
    assert got == [f"kogo{SHORT}", f"kto{SHORT}", f"ja{FALLING}", f"mene{SHORT}"]
    df = spark.createDataFrame([("B", "nominative", "tri", "i"), ("C", "nominative", "pętь", "ь"), ("C", "genitive", "pęti", "i")], "p string, c string, f string, e string")
    got = [r["v"] for r in df.select(accents.numeral_tone(F.col("f"), F.col("e"), F.col("p"), F.col("c")).alias("v")).collect()]
    assert got == [f"tri{SHORT}", f"pę{FALLING}tь", f"pęti{ACUTE}"]
    df = spark.createDataFrame([("B", "dvojih", "dvoj"), ("A", "četvero", "četver")], "p string, f string, b string")
    assert [r["v"] for r in df.select(accents.collective_tone(F.col("f"), F.col("b"), F.col("p")).alias("v")).collect()] == [f"dvo{SHORT}jih", f"četve{SHORT}ro"]


def test_stress_by_morphemes(spark):
    kind = "form string, parts array<struct<value: string, position: int>>"
    rows = [("prěkrasny", [("prě", 0), ("kras", 0), ("ny", None)]), ("abab", [("ab", 1), ("ab", 0)]), ("dom", [("zz", 0), ("dom", None)]), ("dom", [])]
    got = [r["v"] for r in spark.createDataFrame(rows, kind).select(accents.stress_position(F.col("form"), F.col("parts")).alias("v")).collect()]
    assert got == [1, 0, None, None]
    assert values(spark, accents.normal_form, ["pęťi mojji"]) == ["pęti moji"]


def test_accents_move_between_tokens(spark):
    docs = spark.createDataFrame([(1, "Na ruku, v ruku. Na  ruku"), (2, "na\n\nruku"), (3, None)], "doc_id long, text string")
    nouns = spark.createDataFrame([("ruku", f"ru{FALLING}ku", "C", "singular", "accusative")], "form string, toned string, paradigm string, number string, case string")
    got = {(r["doc_id"], r["token_index"]): r["accented"] for r in accents.drawn_to_prepositions(docs, nouns, ["na", "v"]).collect()}
    assert got == {(1, 0): f"na{SHORT} ruku", (1, 3): f"v ru{FALLING}ku", (1, 6): f"na{SHORT} ruku"}


def test_ancestors_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5)], "child long, parent long")
    starts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), ("c", 3)], "start string, node long")
    got = {(r["start"], r["node"], r["distance"]) for r in thesaurus.ancestors(starts, edges, 3).collect()}
    assert got == {("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 9, 0), ("c", 3, 0), ("c", 1, 1), ("c", 4, 1), ("c", 2, 2), ("c", 5, 2)}


def test_nested_entries(spark):
    rows = [("w", [(1, [(2,), (None,)]), (1, [(2,)])]), ("x", None), ("y", [(None, [(3,)])])]
    entries = spark.createDataFrame(rows, thesaurus.ENTRIES)
    assert {tuple(r) for r in thesaurus.senses(entries).collect()} == {("w", 1)} and {tuple(r) for r in thesaurus.hypernyms(entries).collect()} == {(1, 2)}


def test_the_longest_ending_defines(spark):
    rules = spark.createDataFrame([("a", 3, "short"), ("ina", 5, "long"), ("", 0, "none")], "suffix string, least int, rule string")
    templates = spark.createDataFrame([("short", 0, "ROOT!"), ("long", 0, "WORD of ROOT"), ("long", 1, "ROOT again"), ("none", 0, "WORD")], "rule string, nth int, template string")
    words = spark.createDataFrame([("malina",), ("dolina x",), ("ina",), ("gruda",), ("b",), ("dolinaina",)], "word string")
    got = {r["word"]: r["definition"] for r in thesaurus.defined(words, rules, templates).collect()}
    assert got == {"malina": "Malina of mal", "dolina x": "Dolina x", "ina": "in!", "gruda": "grud!", "b": "B", "dolinaina": "dolina again"}


@pytest.mark.parametrize("text", ["", "a", "aě" * 3])
def test_nuclei(spark, text):
    assert len(values(spark, accents.nuclei, [text])[0]) == sum(c in "aě" for c in text)
