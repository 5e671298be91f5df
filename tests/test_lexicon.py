"""Relations, duplicates, search, string kernels, paradigms, sources and the stream, by hand-computed fixtures."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import stems, strings, verbs
from verbatlas.operators import dedup, graph, lexicon, maintenance
from verbatlas.sources import tables
from verbatlas.streaming import ingest

EDGE = "source long, target long, type string"


def composed(text):
    return unicodedata.normalize("NFC", text)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_neighbours(spark):
    edges = spark.createDataFrame([(1, 2, "s"), (3, 1, "s"), (1, 1, "s")], EDGE)
    assert sorted(r["other"] for r in graph.undirected(edges).filter("node = 1").collect()) == [1, 2, 3]
    assert graph.directed(edges).filter("node = 1 and direction = 'in'").count() == 2
    assert {tuple(r) for r in graph.normalized(edges, ["s"]).collect()} == {(1, 2, "s"), (1, 3, "s")}


def test_two_hops(spark):
    edges = spark.createDataFrame([(1, 2, "s"), (1, 3, "s"), (2, 3, "s"), (3, 9, "s"), (2, 9, "s")] + [(2, 10 + i, "s") for i in range(6)], EDGE)
    roots = spark.createDataFrame([(1,)], "root long")
    assert sorted(tuple(r) for r in graph.two_hops(edges, roots).collect()) == [(1, 2, 9), (1, 2, 10), (1, 2, 11), (1, 2, 12)]


def test_changes_and_merges(spark):
    ids = lambda *x: spark.createDataFrame([(1, i) for i in x], "source long, target long")
    wanted = ids(1, 3, 4).filter("source <> target")
    assert {tuple(r) for r in graph.changes(ids(2, 3), wanted, ["source", "target"]).collect()} == {(1, 4, "add"), (1, 2, "remove")}
    edges = spark.createDataFrame([(1, 2, "s"), (5, 1, "s"), (5, 2, "s")], EDGE)
    mapping = spark.createDataFrame([(5, 2)], "old long, new long")
    assert {tuple(r) for r in graph.remapped(edges, mapping).collect()} == {(1, 2, "s"), (2, 1, "s")}


def test_duplicate_rows(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (3, None, "a"), (4, None, "a"), (5, 10, None), (6, 10, None)], "id long, parent long, value string")
    assert dedup.surplus(rows, "parent", "value").first()[0] == 4
    kept = {r["id"] for r in dedup.deduplicated(rows.filter("value = 'a'"), "parent", "value", "id").collect()}
    assert kept == {1, 3, 4}


def test_entities(spark):
    kind = "name string, kind string, id long"
    left = spark.createDataFrame([("a", "n", 1), ("b", "n", 2), ("c", "n", 3), ("c", "n", 4), ("d", "n", 5)], kind)
    right = spark.createDataFrame([("a", "n", 11), ("b", "v", 12), ("c", "n", 13), ("e", "n", 14)], kind)
    out = {r["name"]: r["outcome"] for r in dedup.matched(left, right, "name", "kind", "id").collect()}
    assert out == {"a": "merge", "b": "pos_mismatch", "c": "ambiguous"}


def test_lexicon_reports(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id long, v string")
    out = {r["id"]: (r["dup_count"], r["any_flag"]) for r in lexicon.duplicates(rows, "v", F.col("id") == 2).collect()}
    assert out == {1: (2, True), 2: (2, True), 3: (1, False), 4: (1, False)}
    assert {tuple(r) for r in lexicon.duplicate_members(rows, "v", "id").collect()} == {("x", 1), ("x", 2)}
    slugs = dedup.unique_slugs(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id long, base string"), "base", "id")
    assert {r["id"]: r["slug"] for r in slugs.collect()} == {1: "a", 2: "a-2", 3: "b", 4: "a-3"}
    new = spark.createDataFrame([(1, None), (9, "z")], "id long, v string")
    assert {tuple(r) for r in lexicon.upsert(rows.filter("id < 3"), new, "id").collect()} == {(1, "x"), (2, "x"), (9, "z")}
    assert lexicon.insert_ignore(rows, new, "id").count() == 5


def test_trigram_index_agrees_with_a_scan(spark):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["voda", "Podvoda", "vod", "ovd", None, "50%_x", "vo"])], "id long, v string")
    index = lexicon.trigram_index(rows, "id", "v")
    for text in ("vod", "VODA", "%_x", "vo", "zzz"):
        want = {r["id"] for r in rows.filter(lexicon.has(F.col("v"), text)).collect()}
        assert {r["id"] for r in lexicon.search_index(rows, index, "id", "v", text).collect()} == want


@pytest.mark.parametrize("number, text", [(999.9, "999"), (1234.0, "1.23K"), (5_550_000.0, "5.55M"), (7.891e9, "7.89B")])
def test_compact(spark, number, text):
    assert spark.createDataFrame([(number,)], "v double").select(lexicon.compact(F.col("v"))).first()[0] == text


CASES = [
    (strings.TO_LATIN, "дъно щука", "dъno štuka"),
    (strings.SIMPLE_LATIN, "  Žena  Straße ", "zena strasse"),
    (strings.NORMAL_FORM, "čěšъ", "ces"),
    (strings.TO_CYRILLIC, "štedrosť koľo ľes Ljudi", "щедрость кольо лес Люди".replace("Люди", "Ліуди")),
    (strings.CYRILLIC_TO_HUB, "змія земя щука", "zmja zemja štuka"),
    (strings.SIMPLE, "dobryj zemja mųž pęť ijaj", "dobry zemia muž pet iaj"),
    (strings.IPA, "zemja jama mųž", "zɛmʲa jama mɔ̃ʒ"),
    (strings.WEST, "ěęųǫ", "eeoo"),
    (strings.EAST, "ręd", "рядь".replace("ь", "")),
    (strings.SOUTH, "mųž", "маж"),
    (strings.FROM_PROTO, "gordъ", "grad"),
    (strings.FROM_PROTO, "bergъ", "brěg"),
    (strings.NEW_TO_STANDARD, "добрый моя", "dobry moja"),
    (strings.CLEAN_MATCH, "Mų́ž 1", "mųž"),
    (strings.GLAGOLITIC, "jama", "ⰻⰰⰿⰰ"),
]


@pytest.mark.parametrize("chain, text, want", CASES)
def test_chains(spark, chain, text, want):
    assert one(spark, text, lambda v: strings.applied(chain, v)) == want


@pytest.mark.parametrize("text, name", [("voda", "std_lat"), ("zemja", "std_lat"), ("zemia", "simple_lat"), ("ręka", "etym_lat"), ("вода", "std_cyr"), ("земiа", "simple_cyr"), ("земиа", "std_cyr"), ("рѧка", "etym_cyr"), ("", None)])
def test_scripts(spark, text, name):
    assert one(spark, text, strings.script) == name


def test_similarities(spark):
    row = spark.createDataFrame([("voda", "вода", "woda", "vita", "река")], "w string, ru string, pl string, cs string, bg string")
    marks = strings.intelligibility(F.col("w"), {k: F.col(k) for k in ("ru", "pl", "cs", "bg")})
    assert row.select(marks).first()[0] == "ru+ pl+ cs~ bg-"
    for words, value in ((["voda", "woda", "vita"], 1 / 3), (["a", "a"], 1.0), (["a"], 0.0)):
        assert spark.createDataFrame([(words,)], "w array<string>").select(strings.pairwise_similarity(F.col("w"))).first()[0] == pytest.approx(value)
    parts = spark.createDataFrame([([" вода , ,tri", None, ""],)], "w array<string>").select(strings.split_translations(F.col("w"))).first()[0]
    assert parts == ["voda", "tri"]


@pytest.mark.parametrize("word, pos, stem", [("pekti", "VERB", "pek"), ("peči", "VERB", "pk"), ("myti sę", "VERB", "my"), ("imę", "NOUN", "imen"), ("voda", "NOUN", "vod"), ("dobry", "ADJ", "dobr"), ("dobro", "ADV", "dobr"), ("x", "X", "x")])
def test_stems(spark, word, pos, stem):
    assert one(spark, word, lambda v: stems.heuristic_stem(v, pos)) == stem


def test_stem_shapes(spark):
    assert set(one(spark, "otec", lambda v: stems.stem_candidates(v))) == {"otec", "otc", "oteč"}
    assert set(one(spark, "rok", lambda v: stems.stem_candidates(v))) == {"rok", "roč"}
    assert one(spark, "most", stems.iotated) == "mošč" and one(spark, "lub", stems.iotated) == "lublj"
    assert one(spark, "voda", lambda v: stems.hypothetical_bases(v, ["a", "da"])) == ["voda", "vod", "vo"]
    assert one(spark, "bez", lambda v: stems.morpheme_candidates(v, F.lit(True)))[-1] == "bes"


def test_roots(spark):
    words = spark.createDataFrame([(1, "voda"), (1, "vodny"), (1, "podvoda"), (2, "ab")], "g long, w string")
    rows = [tuple(r) for r in stems.root_candidates(words, "g", "w").collect()]
    assert rows == [(1, 3, "vod", 1.0)]


def test_lemmas(spark):
    words = spark.createDataFrame([("rabotaješ",), ("voda",), ("zzz",), ("dobrogo",)], "word string")
    known = spark.createDataFrame([("rabotati",), ("voda",), ("dobry",)], "slug string")
    assert {r["word"]: r["lemma"] for r in stems.lemmatized(words, known).collect()} == {"rabotaješ": "rabotati", "voda": "voda", "dobrogo": "dobry"}


def test_segments(spark):
    words = spark.createDataFrame([("podvodny",), ("xxx",), ("vodavod",)], "word string")
    roots = spark.createDataFrame([("vod",), ("od",)], "root string")
    got = {r["word"]: [(p["kind"], p["text"]) for p in r["parts"]] for r in stems.segmented(words, roots).collect()}
    assert got["podvodny"] == [("prefix", "p"), ("root", "od"), ("root", "vod"), ("suffix", "ny")]
    assert got["vodavod"] == [("root", "vod"), ("unknown", "a"), ("root", "vod")] and "xxx" not in got


def test_noun_forms(spark):
    nouns = spark.createDataFrame([("bob", "o_hard", "C"), ("bob", "o_hard", "B"), ("ž", "o_hard", "A")], "slug string, stem_type string, paradigm string")
    rows = stems.noun_forms(nouns, stems.endings(spark)).collect()
    assert len(rows) == 63
    got = {(r["slug"], r["paradigm"], r["number"], r["case"]): composed(r["toned"]) for r in rows}
    assert got["bob", "C", "singular", "nominative"] == composed("bȏb") and got["bob", "C", "singular", "genitive"] == composed("bobá")
    assert got["bob", "B", "singular", "nominative"] == composed("bòb") and got["bob", "B", "plural", "locative"] == composed("bobě́h")
    assert got["ž", "A", "singular", "nominative"] == "ž" and one(spark, unicodedata.normalize("NFD", "bobá"), stems.without_tones) == "boba"


def test_adjectives_and_adverbs(spark):
    rows = stems.adjective_forms(spark.createDataFrame([("dobry", "hard", "B")], "slug string, kind string, paradigm string"), stems.adjective_endings(spark)).collect()
    assert len(rows) == 63
    got = {(r["number"], r["gender"], r["case"]): (r["form"], composed(r["toned"])) for r in rows}
    assert got["singular", "MASC", "genitive"] == ("dobrogo", composed("dobrògo")) and got["plural", "FEM", "instrumental"] == ("dobrymi", composed("dobrými"))
    adverbs = stems.adverb_forms(spark.createDataFrame([("dobro",), ("tu",)], "slug string")).collect()
    assert {(r["slug"], r["degree"]): r["form"] for r in adverbs} == {("dobro", "pos"): "dobro", ("dobro", "cmp"): "dobrěje", ("dobro", "sup"): "najdobrěje", ("tu", "pos"): "tu"}


def test_verbs(spark):
    rows = verbs.verb_forms(spark.createDataFrame([("prositi",), ("pekti",), ("rabotati",), ("dvignųti",), ("kupovati",)], "slug string"))
    got = {(r["slug"], r["tense"], r["person"]): r["form"] for r in rows.collect()}
    assert len(got) == 5 * 52
    assert got["prositi", "present", "1sg"] == "prošų" and got["prositi", "present", "3pl"] == "prosęt" and got["prositi", "past_passive", "masc"] == "prosenyj"
    assert got["pekti", "present", "2sg"] == "pečeš" and got["pekti", "aorist", "2sg"] == "peke" and got["pekti", "imperfect", "1sg"] == "pekěah"
    assert got["rabotati", "imperative", "2pl"] == "rabotajte" and got["rabotati", "l_participle", "fem_sg"] == "rabotala" and got["rabotati", "passive_participle", "fem"] == "rabotajema"
    assert got["dvignųti", "present", "3sg"] == "dvigne" and got["kupovati", "present", "1pl"] == "kupujemo"
    perfect = {r["person"]: r["form"] for r in verbs.compound(rows.filter("slug = 'rabotati'"), "perfect", "present").collect()}
    assert perfect["3sg"] == "jest rabotal"


def test_ending_fallback(spark):
    overrides = spark.createDataFrame([("o_hard", "singular", "accusative", "MASC", "ANIM", "a"), ("o_hard", "singular", "locative", None, None, "u")], "stem_type string, number string, `case` string, gender string, animacy string, value string")
    asked = spark.createDataFrame([("o_hard", "singular", "accusative", "MASC", "ANIM"), ("o_hard", "singular", "accusative", "MASC", None), ("o_hard", "singular", "locative", "FEM", None), ("none", "singular", "locative", None, None)], "stem_type string, number string, `case` string, gender string, animacy string")
    got = {(r["stem_type"], r["case"], r["animacy"]): r["ending"] for r in stems.ending_with_fallback(asked, overrides, stems.endings(spark)).collect()}
    assert got == {("o_hard", "accusative", "ANIM"): "a", ("o_hard", "accusative", None): "", ("o_hard", "locative", None): "u", ("none", "locative", None): ""}


def test_dictionary_analysis(spark):
    lexemes = spark.createDataFrame([("voda", "vod", "a_hard"), ("vodnik", "vodnik", "o_hard")], "slug string, stem string, stem_type string")
    words = spark.createDataFrame([("vodom",), ("vodnikX",), ("zzz",), ("vody",)], "word string")
    got = {r["word"]: (r["lemma"], r["match_count"], r["partial"]) for r in stems.analysed(words, lexemes, stems.endings(spark)).collect()}
    assert got["vodom"] == ("voda", 2, False) and got["vodnikX"] == ("vodnik", 1, True) and got["zzz"] == (None, 0, True) and got["vody"] == ("voda", 1, False)


def test_exports(spark):
    assert one(spark, "intro\n## One\nbody\n## Two", strings.chapters) == [("", "intro"), ("One", "body"), ("Two", "")]
    assert one(spark, "plain", strings.chapters) == [("", "plain")]
    assert one(spark, "intro\n## One\nbody", lambda v: strings.joined_chapters(strings.chapters(v))) == "intro\n\n## One\n\nbody"
    assert one(spark, "<p>a</p>\n <b>b&amp;</b> ", strings.without_tags) == "a b&amp;"
    token = one(spark, "<a>", lambda v: strings.tei_token(v, v, F.lit("NOUN"), F.lit("case=ins|number=sg"), F.lit(True), F.lit(False)))
    assert token == '<w lemma="&lt;a&gt;" pos="n" ana="case=ins; number=sg" cert="low">&lt;a&gt;</w>'
    assert one(spark, "ёж", strings.yo_variants) == ["ёж", "еж"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;meaning\n1;"two\nlines; ""quoted"""\n')
    row = tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, meaning string", ";").first()
    assert row["meaning"] == 'two\nlines; "quoted"'
    (tmp_path / "a.json").write_text('[{"id": 1, "w": ["a"]},\n {"id": 2, "w": []}]')
    assert tables.read_json_array(spark, str(tmp_path / "a.json"), "id long, w array<string>").count() == 2
    ids = spark.createDataFrame([("a", "[1, 2]"), ("b", '[{"id": 3, "flavor": "EAST"}]'), ("c", '[{"id": 4, "flavors": ["CORE", "WEST"]}]')], "base string, word_ids string")
    assert {tuple(r) for r in tables.inverted_bases(ids).collect()} == {("a", 1, "CORE"), ("a", 2, "CORE"), ("b", 3, "EAST"), ("c", 4, "CORE"), ("c", 4, "WEST")}
    packed = spark.createDataFrame([(1, tables.compressed("čau")), (2, "plain text!"), (3, None)], "id long, body string")
    assert [r["open"] for r in tables.decompressed(packed, "body", "open").orderBy("id").collect()] == ["čau", "plain text!", None]
    lines = spark.createDataFrame([(1, "voda a"), (2, "noise"), (3, "voda (d)"), (4, "ruka c")], "n long, line string")
    assert {tuple(r) for r in tables.accents(lines).collect()} == {("voda", "C"), ("ruka", "C")}
    tables.write_csv(packed.select("id"), str(tmp_path / "out"), ["id"])
    assert tables.read_csv(spark, str(tmp_path / "out"), "id long").count() == 3
    urls = spark.createDataFrame([("PL", "żółw a"), ("xx", "a")], "l string, w string")
    assert [r[0] for r in urls.select(tables.dictionary_url(F.col("l"), F.col("w"), {"pl": "https://d.example/{{word}}"})).collect()] == ["https://d.example/%C5%BC%C3%B3%C5%82w+a", None]
    stored = spark.createDataFrame([("f", '[{"slug": "d", "pos": "NOUN", "case": "nom", "freq": 3}, {"pos": "X", "freq": 1}]'), ("g", "bad")], "surface_form string, distributions string")
    assert [(r["form"], r["slug"], r["freq"]) for r in tables.priorities(stored).collect()] == [("f", "d", 3.0)]


def test_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "counts")
    for i, text in enumerate(["a b a", "b c"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        ingest.counting(stream, target, str(tmp_path / "state")).awaitTermination()
    assert {r["slug"]: r["freq"] for r in ingest.counted(spark, target).collect()} == {"a": 2, "b": 2, "c": 1}


def test_prepositions_and_notes(spark):
    rows = [("na", "ru\u0302ka", "C", "singular", "accusative"), ("v", "ru\u0302ka", "C", "singular", "accusative"), ("na", "ruka\u0301", "C", "singular", "genitive"), ("na", "ru\u0302ka", "A", "singular", "accusative")]
    df = spark.createDataFrame(rows, "p string, f string, a string, n string, c string")
    got = [r[0] for r in df.select(stems.with_preposition(*[F.col(x) for x in "pfanc"])).collect()]
    assert got == ["na\u0300 ruka", "v ru\u0302ka", "na ruka\u0301", "na ru\u0302ka"]
    notes = [("#", "NOUN"), ("(+3)", "ADJ"), ("(-ogo)", "ADJ"), ("(a, b) (+2)", "NOUN"), ("(piše)", "VERB"), ("(ide, idut; šel / šla)", "VERB"), (None, "VERB")]
    out = [r[0] for r in spark.createDataFrame(notes, "n string, p string").select(stems.addition(F.col("n"), F.col("p"))).collect()]
    assert out[0]["omitted"] and out[1]["governs"] == 3 and out[1]["forms"] == []
    assert [f["form"] for f in out[2]["forms"]] == ["-ogo"] and [f["form"] for f in out[3]["forms"]] == ["a", "b"] and out[3]["governs"] == 2
    assert out[4]["secondary_stem"] == "piše" and out[4]["forms"] == []
    assert [(f["form"], f["section"]) for f in out[5]["forms"]] == [("ide", "PRES"), ("idut", "PRES"), ("šel", "L_PART"), ("šla", "L_PART")] and out[5]["secondary_stem"] == "ide" and out[5]["tertiary_stem"] == "š"


def test_maintenance(spark):
    kind = "surface string, lemma string, pos string, word_slug string, feats string, match_count int, word_index int, token_index int, sentence_no int"
    tokens = spark.createDataFrame([("a", "x", "X", None, "", 0, 0, 0, 0), ("b", "x", "N", "s", "f", 3, 1, 1, 0), (".", "q", "X", "s", "f", 2, -1, 2, 0)], kind)
    analyses = spark.createDataFrame([("a", "al", "NOUN", "al", "n=1", 2)], "surface string, lemma string, pos string, word_slug string, feats string, match_count int")
    got = {r["surface"]: (r["lemma"], r["pos"], r["word_slug"], r["match_count"]) for r in maintenance.reanalysed(tokens, analyses).collect()}
    assert got == {"a": ("al", "NOUN", "al", 2), "b": ("b", "X", None, 3), ".": (".", "PUNCT", None, 2)}
    assert maintenance.inspected(tokens).filter("recognised").count() == 2
    entries = spark.createDataFrame([(5, ["w1", "w5", "none"], ["w2"], ["w3"])], "meaning_id long, synonyms array<string>, hypernyms array<string>, hyponyms array<string>")
    words = spark.createDataFrame([("w1", 1), ("w2", 2), ("w3", 9), ("w5", 5)], "value string, meaning_id long")
    assert {tuple(r) for r in maintenance.relations_of(entries, words).collect()} == {(1, 5, "synonym"), (5, 2, "hypernymy"), (9, 5, "hypernymy")}
    stored = spark.createDataFrame([(1, "own"), (2, "auto"), (3, None)], "id long, origin string")
    assert {r["id"] for r in maintenance.replaced(stored, spark.createDataFrame([(7,)], "id long"), "auto").collect()} == {1, 3, 7}
    sentences = spark.createDataFrame([(1, 0, 1, "<s>b</s>"), (1, 0, 0, "<s>a</s>"), (1, 1, 2, "<s>c</s>")], "doc_id long, segment int, sentence_no int, xml string")
    xml = maintenance.tei_documents(sentences, spark.createDataFrame([(1, "T & U", None)], "doc_id long, title string, author string")).first()["xml"]
    import xml.dom.minidom as dom

    parsed = dom.parseString(xml.encode())
    assert [s.firstChild.data for s in parsed.getElementsByTagName("s")] == ["a", "b", "c"] and "T &amp; U" in xml


def test_closed_classes(spark):
    from verbatlas.functions import closed_classes as K

    got = {(r["lemma"], r["number"], r["gender"], r["case"]): (r["form"], r["short"]) for r in K.pronouns(spark).collect()}
    assert got["ja", "singular", None, "dative"] == ("meně", "mi") and got["ty", "plural", None, "locative"] == ("vasъ", None)
    assert got["kto", None, None, "instrumental"] == ("kěmь", None)
    assert got["on", "singular", "NEUT", "accusative"] == ("ono", None) and got["on", "singular", "MASC", "genitive"] == ("jego", None)
    small = {(r["lemma"], r["gender"], r["case"]): r["form"] for r in K.small_numerals(spark).collect()}
    assert small["dva", "FEM", "nominative"] == "dvě" and small["tri", "MASC", "accusative"] == "tri" and small["četyri", "MASC", "dative"] == "četyrem"
    five = {r["case"]: r["form"] for r in K.five_to_ten(spark.createDataFrame([("pęť",)], "slug string")).collect()}
    assert five["nominative"] == "pęť" and five["genitive"] == "pęti" and five["instrumental"] == "pętejų"
    many = {r["case"]: r["form"] for r in K.collectives(spark.createDataFrame([("dvoje",)], "slug string"), "oje").collect()}
    assert many["nominative"] == "dvoje" and many["genitive"] == "dvojih"
