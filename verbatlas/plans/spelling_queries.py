"""Queries on spellings, accents and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.functions import accents as A
from verbatlas.functions import closed_classes as K
from verbatlas.functions import spellings as P
from verbatlas.functions import stems as M
from verbatlas.functions import strings as S
from verbatlas.functions import text as X
from verbatlas.functions import verbs as V
from verbatlas.operators import arrow_tokens

from .corpus_queries import LEX, TAG, _docs, _lexicon
from .registry import query
from .text_queries import _text, _verb_sql, duck

_WORDS = f"WITH {LEX}"
_RECURSIVE = f"WITH RECURSIVE {LEX}"


def _pairs(table: dict[str, str]) -> str:
    return ", ".join(f"({_text(k)}, {_text(v)})" for k, v in table.items())


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in table.items()) + "}"


# spellings

_NEW = duck(S.TO_CYRILLIC_NEW, "slug")


@query(
    f"""{_RECURSIVE}, plain(letter, said) AS (VALUES {_pairs(P.new_letters())}), soft(letter, vowel) AS (VALUES {_pairs(P.SOFT_VOWELS | {k.upper(): v.upper() for k, v in P.SOFT_VOWELS.items()})}),
    n AS (SELECT slug, {_NEW} AS new FROM lex),
    w AS (SELECT slug, CASE length(slug) % 5 WHEN 0 THEN new || 'ый' WHEN 1 THEN upper(new) WHEN 2 THEN replace(new, 'а', 'ъя') WHEN 3 THEN replace(replace(new, 'і', 'јё'), 'о', 'ю') ELSE 'Объ' || new || 'ия ' || new || 'ий' END AS word FROM n),
    t AS (SELECT slug, word, regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, 'ый([^\\pL▲]|$)', 'y\\1', 'g'), 'ий([^\\pL▲]|$)', 'i\\1', 'g'), 'ЫЙ([^\\pL▲]|$)', 'Y\\1', 'g'), 'ИЙ([^\\pL▲]|$)', 'I\\1', 'g') AS text FROM w),
    f AS (SELECT slug, word, text, 0 AS i, '' AS out, '' AS last FROM t UNION ALL
      SELECT slug, word, text, i + 1, out || said, CASE WHEN said = '' THEN last ELSE right(said, 1) END FROM (
        SELECT f.*, CASE WHEN vowel IS NULL THEN coalesce(said, substr(text, i + 1, 1)) WHEN lower(last) IN ('i', 'j') THEN vowel WHEN vowel = upper(vowel) THEN 'J' || lower(vowel) ELSE 'j' || vowel END AS said
        FROM f LEFT JOIN plain ON plain.letter = substr(text, i + 1, 1) LEFT JOIN soft ON soft.letter = substr(text, i + 1, 1) WHERE i < length(text)))
    SELECT slug, word, out AS etymologized FROM f WHERE i = length(text)"""
)
def etymologized(spark, d):
    """Words in new Cyrillic letters, some with hard signs, full endings and soft vowels, in etymological Latin ones."""
    slug = F.col("slug")
    new, turn = S.applied(S.TO_CYRILLIC_NEW, slug), F.length(slug) % 5
    word = (
        F.when(turn == 0, F.concat(new, F.lit("ый")))
        .when(turn == 1, F.upper(new))
        .when(turn == 2, F.replace(new, F.lit("а"), F.lit("ъя")))
        .when(turn == 3, F.replace(F.replace(new, F.lit("і"), F.lit("јё")), F.lit("о"), F.lit("ю")))
        .otherwise(F.concat(F.lit("Объ"), new, F.lit("ия "), new, F.lit("ий")))
    )
    return _lexicon(spark, d).withColumn("word", word).withColumn("etymologized", P.etymologized(F.col("word")))


_GROUPS = "|".join(P.GLAGOLITIC_GROUPS)
_SMALL = P.GLAGOLITIC_GROUPS | P.GLAGOLITIC_LETTERS


@query(
    f"""{_WORDS}, w AS (SELECT slug, CASE length(slug) % 4 WHEN 0 THEN upper(left(slug, 1)) || substr(slug, 2) WHEN 1 THEN 'Ja ' || slug || 'ij' WHEN 2 THEN upper(slug) || 'yj' ELSE 'št' || slug || 'ijajju' END AS word FROM lex),
    g AS (SELECT *, array_to_string(list_transform(regexp_extract_all(word, '(?i){_GROUPS}|.'), lambda x: CASE WHEN {_map(_SMALL)}[lower(x)] IS NULL THEN x WHEN left(x, 1) = lower(left(x, 1)) THEN {_map(_SMALL)}[lower(x)]
      WHEN lower(x) = 'ja' THEN '{P.CAPITAL_JA}' ELSE upper({_map(_SMALL)}[lower(x)]) END), '') AS glagolitic FROM w)
    SELECT slug, word, glagolitic, array_to_string(list_transform(regexp_extract_all(word, '(?i){_GROUPS}|.'), lambda x: CASE WHEN {_map(_SMALL)}[lower(x)] IS NULL THEN x WHEN x = lower(x) THEN replace(x, 'ǫ', 'ų') WHEN lower(x) = 'ja' THEN 'IA'
      ELSE upper(replace(left(x, 1), 'Ǫ', 'Ų')) || lower(substr(x, 2)) END), '') AS back, {duck(S.SIMPLE, 'word')} AS simple, {duck(S.STANDARD, 'word')} AS standard, replace(replace(word, 'jj', 'j'), 'JJ', 'J') AS single_j FROM g"""
)
def spellings(spark, d):
    """Words in Glagolitic letters and back (a capital group comes back with a capital first letter), in simple and in standard spelling."""
    slug, turn = F.col("slug"), F.length("slug") % 4
    first = F.concat(F.upper(F.substring(slug, 1, 1)), F.expr("substring(slug, 2)"))
    word = F.when(turn == 0, first).when(turn == 1, F.concat(F.lit("Ja "), slug, F.lit("ij"))).when(turn == 2, F.concat(F.upper(slug), F.lit("yj"))).otherwise(F.concat(F.lit("št"), slug, F.lit("ijajju")))
    rows = _lexicon(spark, d).withColumn("word", word).withColumn("glagolitic", P.glagolitic(F.col("word")))
    w = F.col("word")
    return rows.select("slug", "word", "glagolitic", P.from_glagolitic(F.col("glagolitic")).alias("back"), S.applied(S.SIMPLE, w).alias("simple"), S.applied(S.STANDARD, w).alias("standard"), P.single_j(w).alias("single_j"))


#: The same in SQL: endings and groups, then letters, then j by its neighbours and the soft consonants that are left.
_CYR = [("sub", f"{a}([^\\pL▲]|$)", b + "\\1") for a, b in (("yj", "ы"), ("ij", "и"), ("YJ", "Ы"), ("IJ", "И"))]
_CYR += [("sub", g, v) for k, c in P.SIMPLE_GROUPS.items() for g, v in ((k[0].upper() + k[1:], c.upper()), (k, c))]
_CYR_SOFT = [("sub", "([иИ])[jJ]([ауеоАУЕО])", "\\1\\2"), ("map", "jJ", "іІ")] + [x for k, v in P.SIMPLE_SOFT.items() for x in (("sub", k.upper(), v.upper()), ("sub", k, v))]


@query(
    f"""{_WORDS}, w AS (SELECT slug, CASE length(slug) % 3 WHEN 0 THEN upper(left(slug, 1)) || substr(slug, 2) || 'ij' WHEN 1 THEN slug || 'ksija maťe' ELSE 'Št' || upper(slug) || 'ju ' || slug || 'yj' END AS word FROM lex),
    c AS (SELECT slug, word, translate({duck(S.SOFT, 'word')}, '{P.LATIN_E}', chr(2) || chr(2)) AS t FROM w), m AS (SELECT slug, word, {duck(_CYR, 't')} AS t FROM c),
    l AS (SELECT slug, word, translate(t, '{P.SIMPLE_LATIN_LETTERS + P.SIMPLE_LATIN_LETTERS.upper()}' || chr(2), '{P.SIMPLE_CYRILLIC + P.SIMPLE_CYRILLIC.upper()}' || 'e') AS t FROM m)
    SELECT slug, word, {duck(_CYR_SOFT, 't')} AS simple_cyrillic FROM l"""
)
def simple_cyrillic(spark, d):
    """Words in simple Cyrillic spelling."""
    slug, turn = F.col("slug"), F.length("slug") % 3
    first = F.concat(F.upper(F.substring(slug, 1, 1)), F.expr("substring(slug, 2)"), F.lit("ij"))
    word = F.when(turn == 0, first).when(turn == 1, F.concat(slug, F.lit("ksija maťe"))).otherwise(F.concat(F.lit("Št"), F.upper(slug), F.lit("ju "), slug, F.lit("yj")))
    return _lexicon(spark, d).withColumn("word", word).withColumn("simple_cyrillic", P.simple_cyrillic(F.col("word")))


# accents

_V = M.VOWELS


def _vowels(form: str) -> str:
    return f"list_filter(range(1, length({form}) + 1), lambda i: contains('{_V}', lower(substr({form}, i, 1))))"


def _marked(form: str, place: str, mark: str) -> str:
    """A mark after the vowel that stands `place` from the end, or the first."""
    at = f"v[greatest(len(v) - ({place}), 1)]"
    return f"CASE WHEN len(v) = 0 THEN {form} ELSE substr({form}, 1, {at}) || ({mark}) || substr({form}, {at} + 1) END"


def _tone(form: str, place: str, rising: str) -> str:
    short = f"lower(substr({form}, v[greatest(len(v) - ({place}), 1)], 1)) IN ('o', 'e')"
    return _marked(form, place, f"CASE WHEN {rising} THEN CASE WHEN {short} THEN chr(768) ELSE chr(769) END WHEN {short} THEN chr(785) ELSE chr(770) END")


_FINITE = "('present', 'aorist', 'imperfect', 'imperative', 'l_participle')"
_OWN = "(tense = 'present' AND person = '1sg' AND p IN ('B', 'C')) OR (tense = 'aorist' AND p = 'C' AND person IN ('2sg', '3sg')) OR (tense = 'l_participle' AND p = 'C' AND person = 'fem_sg')"
_VERB_TONE = f"""CASE WHEN tense NOT IN {_FINITE} THEN form WHEN tense = 'imperfect' THEN {_marked('form', '1', 'chr(770)')} WHEN {_OWN} THEN {_marked('form', '0', 'chr(768)')}
  WHEN p = 'A' THEN {_marked('form', 'len(v) - 1', 'chr(769)')} WHEN tense = 'imperative' OR (tense = 'present' AND p = 'B') THEN {_marked('form', '1', 'chr(769)')} ELSE {_marked('form', 'len(v) - 1', 'chr(768)')} END"""
_BARE = "regexp_replace({}, '[' || chr(768) || chr(769) || chr(770) || chr(785) || ']', '', 'g')"


def _normal(form: str) -> str:
    return f"replace(replace({duck(S.SOFT, form)}, 'jj', 'j'), 'JJ', 'J')"


@query(
    f"""{_WORDS}, v AS (SELECT slug || 'ti' AS slug FROM lex), {_verb_sql()}, r AS (SELECT slug, f.tense AS tense, f.person AS person, f.form AS form, p, {_vowels('f.form')} AS v FROM f, (SELECT unnest(['A', 'B', 'C']) AS p)),
    t AS (SELECT slug, p AS paradigm, tense, person, form, {_VERB_TONE} AS toned FROM r)
    SELECT *, {_normal(_BARE.format('toned'))} AS surface FROM t"""
)
def toned_verbs(spark, d):
    """All verb forms of made-up infinitives with their accents in each paradigm, and as they are written without."""
    verbs = V.verb_forms(_lexicon(spark, d).select(F.concat("slug", F.lit("ti")).alias("slug")))
    rows = verbs.select("slug", F.explode(F.array(*map(F.lit, "ABC"))).alias("paradigm"), "tense", "person", "form")
    toned = A.verb_tone(F.col("form"), F.col("paradigm"), F.col("tense"), F.col("person"))
    return rows.withColumn("toned", toned).withColumn("surface", A.normal_form(A.plain(F.col("toned"))))


_ENDS = lambda table: ", ".join(f"({_text(c)}, {_text('' if e == '-' else e)})" for c, e in table.items())
_PRON = ", ".join("(" + ", ".join("NULL" if x is None else _text(x) for x in r[:5]) + ")" for r in K.pronoun_rows())
_SMALL_NUM = ", ".join(f"({_text(n)}, {_text(g)}, {_text(c)}, {_text(f)}, {_text(f.removeprefix(K.SMALL_NUMBERS[n][0]))})" for n, g, c, f in K.numeral_rows())
_I_STEM = dict(zip(M.CASES, M.NOUN_ENDINGS["i_basis"][0].split()))
_COLL = {kind: dict(zip(M.CASES, line.split())) for kind, line in K.COLLECTIVE.items()}
_CLOSED = f"""pron(slug, number, gender, "case", form) AS (VALUES {_PRON}), small(slug, gender, "case", form, ending) AS (VALUES {_SMALL_NUM}), i_stem("case", ending) AS (VALUES {_ENDS(_I_STEM)}),
    oje("case", ending) AS (VALUES {_ENDS(_COLL['oje'])}), ero("case", ending) AS (VALUES {_ENDS(_COLL['ero'])}),
    closed AS (SELECT 'PRON' AS kind, slug, concat_ws(' ', number, gender, "case") AS feats, "case", form, '' AS ending, '' AS base FROM pron
      UNION ALL SELECT 'NUM', slug, gender || ' ' || "case", "case", form, ending, '' FROM small
      UNION ALL SELECT 'NUM', slug || 'ь', "case", "case", replace({duck(S.SOFT, 'slug || ending')}, 'jj', 'j'), ending, '' FROM lex, i_stem WHERE length(slug) = 4
      UNION ALL SELECT 'COLL', slug || 'oje', "case", "case", slug || 'oj' || ending, ending, slug || 'oj' FROM lex, oje WHERE length(slug) = 5
      UNION ALL SELECT 'COLL', slug || 'ero', "case", "case", slug || 'er' || ending, ending, slug || 'er' FROM lex, ero WHERE length(slug) = 5),
    r AS (SELECT *, {_vowels('form')} AS v, p AS paradigm FROM closed, (SELECT unnest(['A', 'B', 'C']) AS p))"""


def _paradigm(drawn: str, direct: str) -> tuple[str, str]:
    """Place and direction of the tone."""
    return f"CASE WHEN p = 'A' THEN 1 WHEN p = 'B' THEN CASE WHEN {drawn} THEN 1 ELSE 0 END WHEN \"case\" IN {direct} THEN 1 ELSE 0 END", f"p <> 'C' OR \"case\" NOT IN {direct}"


_PRON_TONE = _tone("form", *_paradigm("right(form, 1) IN ('ъ', 'ь') OR length(form) <= 3", "('nominative', 'vocative')"))
_NUM_TONE = _tone("form", *_paradigm("ending IN ('', 'ъ', 'ь')", "('nominative', 'accusative')"))
_COLL_TONE = _tone("form", f"CASE WHEN p = 'A' THEN 1 ELSE len(v) - len({_vowels('base')}) END", "true")


@query(
    f"""{_WORDS}, {_CLOSED} SELECT kind, slug, paradigm, feats, form, CASE WHEN kind = 'PRON' THEN {_PRON_TONE} WHEN kind = 'COLL' THEN {_COLL_TONE} WHEN p = 'B' AND len(v) <= 1 THEN {_marked('form', '0', 'chr(768)')} ELSE {_NUM_TONE} END AS toned FROM r"""
)
def toned_closed(spark, d):
    """Forms of pronouns, of the numerals two to four, and of made-up numerals in ь and collectives from the lexicon, with their accents in each paradigm."""
    word, none, case = _lexicon(spark, d), F.lit(""), F.col("case")

    def row(df, kind, feats, ending, base):
        return df.select(F.lit(kind).alias("kind"), "slug", feats.alias("feats"), "case", "form", ending.alias("ending"), base.alias("base"))

    stem = F.create_map(*[F.lit(x) for k, (base, _) in K.SMALL_NUMBERS.items() for x in (k, base)])
    ends = F.create_map(*[F.lit(x) for c, e in _I_STEM.items() for x in (c, "" if e == "-" else e)])
    small = K.small_numerals(spark).withColumnRenamed("lemma", "slug").withColumn("stem", stem[F.col("slug")])
    soft = K.five_to_ten(word.filter("length(slug) = 4").select(F.concat("slug", F.lit("ь")).alias("slug")))
    rows = row(K.pronouns(spark).withColumnRenamed("lemma", "slug"), "PRON", F.concat_ws(" ", "number", "gender", "case"), none, none)
    rows = rows.unionByName(row(small, "NUM", F.concat_ws(" ", "gender", "case"), F.expr("substring(form, length(stem) + 1)"), none)).unionByName(row(soft, "NUM", case, ends[case], none))
    for kind, cut in (("oje", "concat(substring(slug, 1, length(slug) - 2), 'j')"), ("ero", "substring(slug, 1, length(slug) - 1)")):
        made = K.collectives(word.filter("length(slug) = 5").select(F.concat("slug", F.lit(kind)).alias("slug")), kind)
        rows = rows.unionByName(row(made, "COLL", case, none, F.expr(cut)))
    rows = rows.withColumn("paradigm", F.explode(F.array(*map(F.lit, "ABC"))))
    form, p, kind = F.col("form"), F.col("paradigm"), F.col("kind")
    other = F.when(kind == "COLL", A.collective_tone(form, F.col("base"), p)).otherwise(A.numeral_tone(form, F.col("ending"), p, case))
    return rows.select("kind", "slug", "paradigm", "feats", "form", F.when(kind == "PRON", A.pronoun_tone(form, p, case)).otherwise(other).alias("toned"))


@query(
    f"""{_WORDS}, w AS (SELECT slug, [{{'value': left(slug, 2), 'position': CASE WHEN length(slug) % 3 = 0 THEN NULL ELSE 0 END}}, {{'value': substr(slug, 3), 'position': CASE length(slug) % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END}},
      {{'value': 'zz', 'position': 5}}] AS m FROM lex),
    f AS (SELECT slug, list_filter(list_transform(m, lambda x, i: {{'start': instr(slug, x['value']) - 1, 'nth': i, 'position': x['position']}}), lambda x: x['position'] IS NOT NULL AND x['start'] >= 0) AS found FROM w)
    SELECT slug, len({_vowels('slug')})::INT AS syllables, (len(list_filter({_vowels('slug')}, lambda i: i <= list_max(found)['start'])) + list_max(found)['position'])::INT AS stressed FROM f"""
)
def stress_positions(spark, d):
    """The number of syllables and the stressed one, from the stress of a word's parts."""
    slug, n = F.col("slug"), F.length("slug")
    part = lambda value, position: F.struct(value.alias("value"), position.cast("int").alias("position"))
    parts = F.array(part(F.substring(slug, 1, 2), F.when(n % 3 != 0, 0)), part(F.expr("substring(slug, 3)"), F.when(n % 4 == 1, 1).when(n % 4 != 0, 0)), part(F.lit("zz"), F.lit(5)))
    return _lexicon(spark, d).select("slug", S.syllables(slug).alias("syllables"), A.stress_position(slug, parts).alias("stressed"))


_PREPOSITIONS = ["in", "de", "la", "on", "an", "en", "to", "v", "les", "der", "el"]
_NOUNS = f"""nouns AS (SELECT word, CASE WHEN length(word) % 2 = 0 THEN 'C' ELSE 'A' END AS p, CASE WHEN contains(feats, 'case=ins') THEN 'instrumental' WHEN contains(feats, 'case=dat') THEN 'dative' ELSE 'nominative' END AS kase, {_vowels('word')} AS v
    FROM (SELECT DISTINCT surface AS word, feats FROM tag WHERE pos = 'NOUN' AND surface = lower(surface)))"""


@query(
    f"""WITH {TAG}, {_NOUNS}, toned AS (SELECT word, p, kase, {_tone('word', '1', "p <> 'C'")} AS toned FROM nouns),
    pairs AS (SELECT doc_id, token_index, surface AS preposition, lead(surface) OVER (PARTITION BY doc_id, sentence_no ORDER BY token_index) AS form FROM tok)
    SELECT doc_id, token_index, preposition, form, CASE WHEN p = 'C' AND kase = 'nominative' AND regexp_matches(toned, '[' || chr(770) || chr(785) || ']') AND regexp_matches(lower(preposition), '[{_V}]')
      THEN regexp_replace(lower(preposition), '^([^{_V}]*[{_V}])', '\\1' || chr(768)) || ' ' || {_BARE.format('toned')} ELSE preposition || ' ' || toned END AS accented
    FROM pairs JOIN toned ON lower(form) = word WHERE lower(preposition) IN {tuple(_PREPOSITIONS)}"""
)
def enclitics(spark, d):
    """Prepositions before nouns in the documents, both with their accents: half of the nouns, tagged by their endings, have a movable one."""
    docs = _docs(spark, d)
    # tags are looked for after a slice's tokens became its distinct ones, else the optimizer tags every token
    words = arrow_tokens.vocabulary(docs).filter("surface = lower(surface)").select("surface").distinct()
    tag = words.select(F.col("surface").alias("form"), X.analysis(F.col("surface")).alias("a")).filter("a.pos = 'NOUN'")
    feats, form = F.col("a.feats"), F.col("form")
    case = F.when(F.contains(feats, F.lit("case=ins")), "instrumental").when(F.contains(feats, F.lit("case=dat")), "dative").otherwise("nominative")
    movable = F.length(form) % 2 == 0
    nouns = tag.select("form", M.marked(form, F.lit(1), ~movable).alias("toned"), F.when(movable, "C").otherwise("A").alias("paradigm"), F.lit("singular").alias("number"), case.alias("case"))
    return A.drawn_to_prepositions(docs, nouns, _PREPOSITIONS)


_COMPOUND = {"perfect": "present", "pluperfect": "imperfect", "conditional": "conditional"}
_AUX = ", ".join(f"('{tense}', '{p}', '{a}')" for tense, aux in _COMPOUND.items() for p, a in zip(V.PERSONS, V.AUXILIARIES[aux].split()))


@query(
    f"""{_WORDS}, v AS (SELECT slug || 'ti' AS slug FROM lex), {_verb_sql()}, aux(tense, person, word) AS (VALUES {_AUX})
    SELECT slug, f.person AS gender, aux.tense AS tense, aux.person AS person, aux.word || ' ' || f.form AS form FROM f, aux WHERE f.tense = 'l_participle' AND f.person IN ('masc_sg', 'fem_sg')"""
)
def compound_tenses(spark, d):
    """Perfect, pluperfect and conditional of made-up infinitives, by gender."""
    forms = V.verb_forms(_lexicon(spark, d).select(F.concat("slug", F.lit("ti")).alias("slug")))
    out = None
    for tense, auxiliary in _COMPOUND.items():
        for gender in ("masc_sg", "fem_sg"):
            rows = V.compound(forms, tense, auxiliary, gender).withColumn("gender", F.lit(gender))
            out = rows if out is None else out.unionByName(rows)
    return out.select("slug", "gender", "tense", "person", "form")
