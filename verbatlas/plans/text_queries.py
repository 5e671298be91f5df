"""Queries with string kernels over words and pages; the words are those of the benchmark texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatlas.functions import closed_classes as K
from verbatlas.functions import paradigms as P
from verbatlas.functions import stems as M
from verbatlas.functions import strings as S
from verbatlas.functions import text as X
from verbatlas.functions import verbs as V
from verbatlas.operators import arrow_tokens, maintenance
from verbatlas.operators import corpus as C

from .corpus_queries import LEX, SENT, TAG, _docs, _lexicon
from .registry import query, table


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def duck(chain: S.Chain, value: str) -> str:
    """A chain of replacements as SQL."""
    for s in chain:
        if s[0] == "lower":
            value = f"lower({value})"
        elif s[0] == "map":
            value = f"translate({value}, {_text(s[1])}, {_text(s[2])})"
        else:
            value = f"regexp_replace({value}, {_text(s[1])}, {_text(s[2])}, 'g')"
    return value


_WORDS = f"WITH {LEX}"


def _chain(name: str, chain: S.Chain, source: S.Chain | None = None):
    """SQL that applies a chain to every word, or to what another chain makes of it."""
    base = duck(source, "slug") if source else "slug"
    return f"{_WORDS}, w AS (SELECT slug, {base} AS word FROM lex) SELECT slug, word, {duck(chain, 'word')} AS {name} FROM w"


def _words(spark, d, source: S.Chain | None = None):
    rows = _lexicon(spark, d)
    return rows.withColumn("word", S.applied(source, F.col("slug")) if source else F.col("slug"))


#: Words of both alphabets: those of even length in Cyrillic letters.
_MIXED = f"CASE WHEN length(slug) % 2 = 0 THEN {duck(S.TO_CYRILLIC, 'slug')} ELSE slug END"
_TRIPLE = f"""SELECT word AS a, lead(word) OVER g AS b, lead(word, 2) OVER g AS c FROM (SELECT slug, {_MIXED} AS word FROM lex)
  WINDOW g AS (PARTITION BY left(slug, 2), length(slug) // 3 ORDER BY slug)"""
#: DuckDB's distance counts bytes: letters get one byte each, all different, before they are compared.
_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяёѕєіјљњћџѫѭѣѧěčšž"
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+-./:;<=>?@[]^{|}~()"[: len(_LETTERS)]


def _distance(a: str, b: str) -> str:
    flat = lambda v: f"translate({v}, '{_LETTERS}', '{_SIGNS}')"
    return f"levenshtein({flat(a)}, {flat(b)})"


def _triples(spark, d):
    """Each word with the two that follow it among those that begin like it and are about as long: (a, b, c)."""
    from pyspark.sql import Window

    slug = F.col("slug")
    group = Window.partitionBy(F.substring(slug, 1, 2), F.floor(F.length(slug) / 3)).orderBy("slug")
    word = F.when(F.length(slug) % 2 == 0, S.applied(S.TO_CYRILLIC, slug)).otherwise(slug)
    rows = _lexicon(spark, d).withColumn("word", word)
    return rows.select(F.col("word").alias("a"), F.lead("word").over(group).alias("b"), F.lead("word", 2).over(group).alias("c"))


@query(f"{_WORDS} SELECT a, b, {_distance('a', 'b')}::INT AS distance FROM ({_TRIPLE}) WHERE b IS NOT NULL")
def lev(spark, d):
    return _triples(spark, d).filter("b IS NOT NULL").select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query(_chain("latin", S.SIMPLE_LATIN, S.TO_CYRILLIC))
def translit(spark, d):
    """From Cyrillic letters into bare Latin ones."""
    return _words(spark, d, S.TO_CYRILLIC).withColumn("latin", S.applied(S.SIMPLE_LATIN, F.col("word")))


@query(_chain("bare", S.STRIP))
def strip_diacritics(spark, d):
    return _words(spark, d).withColumn("bare", S.applied(S.STRIP, F.col("word")))


_PARTS = f"list_filter(list_transform(string_split(text, ','), lambda p: {duck(S.TO_LATIN + S.SPACES, 'p')}), lambda p: p <> '')"


@query(f"SELECT doc_id, len({_PARTS}) AS parts, md5(array_to_string({_PARTS}, '|')) AS digest FROM documents")
def split_translations(spark, d):
    parts = S.split_translations(F.array("text"))
    rows = _docs(spark, d).select("doc_id", parts.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("parts"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


def _sql_mark(a: str, b: str) -> str:
    x, y = duck(S.SIMPLE_LATIN, a), duck(S.SIMPLE_LATIN, b)
    s = f"(1 - {_distance(x, y)} / greatest(length({x}), length({y})))"
    return f"CASE WHEN {s} >= 0.6 THEN '+' WHEN {s} >= 0.35 THEN '~' ELSE '-' END"


@query(f"{_WORDS} SELECT a, concat_ws(' ', 'ru' || CASE WHEN b IS NULL THEN NULL ELSE {_sql_mark('a', 'b')} END, 'pl' || CASE WHEN c IS NULL THEN NULL ELSE {_sql_mark('a', 'c')} END) AS marks FROM ({_TRIPLE})")
def intelligibility(spark, d):
    rows = _triples(spark, d)
    return rows.select("a", S.intelligibility(F.col("a"), {"pl": F.col("c"), "ru": F.col("b")}).alias("marks"))


@query(f"{_WORDS} SELECT a, floor(greatest(0.0, least(1.0, 1 - ({_distance('a', 'b')} + {_distance('a', 'c')}) / 2 / greatest(length(a), length(b), length(c)))) * 1e6 + 0.5) / 1e6 AS similarity FROM ({_TRIPLE}) WHERE c IS NOT NULL")
def target_similarity(spark, d):
    rows = _triples(spark, d).filter("c IS NOT NULL")
    return rows.select("a", X.rounded(S.target_similarity(F.col("a"), F.array("b", "c")), 6).alias("similarity"))


@query(
    f"""{_WORDS} SELECT a, CASE WHEN greatest(x, y, z) = 0 THEN 1.0 ELSE floor((1 - (x + y + z) / 3 / greatest(x, y, z)) * 1e6 + 0.5) / 1e6 END AS similarity
    FROM (SELECT a, {_distance('a', 'b')} AS x, {_distance('a', 'c')} AS y, {_distance('b', 'c')} AS z FROM ({_TRIPLE}) WHERE c IS NOT NULL)"""
)
def pairwise_similarity(spark, d):
    rows = _triples(spark, d).filter("c IS NOT NULL")
    return rows.select("a", X.rounded(S.pairwise_similarity(F.array("a", "b", "c")), 6).alias("similarity"))


@query(_chain("normal", S.NORMAL_FORM))
def normalize_form(spark, d):
    return _words(spark, d).withColumn("normal", S.applied(S.NORMAL_FORM, F.col("word")))


def _script_sql(v: str) -> str:
    h, c = f"(regexp_matches({v}, '(?i)[ěęǫų]') OR regexp_matches({v}, '[ѢѣѦѧѪѫ]'))", f"regexp_matches({v}, '(?i)[а-яѢѣѦѧѪѫћЋ]')"
    j, i = f"regexp_matches({v}, '(?i)j[aeou]')", f"regexp_matches({v}, '(?i)i[aeouаеоу]')"
    return (
        f"CASE WHEN {c} THEN CASE WHEN {h} THEN 'etym_cyr' WHEN {i} AND NOT {j} THEN 'simple_cyr' ELSE 'std_cyr' END "
        f"WHEN {h} THEN 'etym_lat' WHEN {j} THEN 'std_lat' WHEN {i} THEN 'simple_lat' ELSE 'std_lat' END"
    )


@query(f"{_WORDS}, w AS (SELECT slug, slug AS word FROM lex UNION ALL SELECT slug, {duck(S.TO_CYRILLIC, 'slug')} FROM lex) SELECT slug, word, {_script_sql('word')} AS script FROM w")
def detect_script(spark, d):
    rows = _words(spark, d).unionByName(_words(spark, d, S.TO_CYRILLIC))
    return rows.withColumn("script", S.script(F.col("word")))


@query(f"{_WORDS} SELECT slug, len(regexp_extract_all(slug, '(?i)[aeiouyěęǫọų]'))::INT AS syllables FROM lex")
def syllables(spark, d):
    return _lexicon(spark, d).withColumn("syllables", S.syllables(F.col("slug")))


_GENDER = """CASE WHEN right(slug, 1) IN ('a', 'å') THEN 'FEM' WHEN right(slug, 1) IN ('o', 'e', 'ę') THEN 'NEUT' WHEN right(slug, 1) = 'j' THEN 'FEM'
 WHEN right(slug, 1) = 'u' THEN 'MASC' WHEN regexp_matches(right(slug, 1), '[bcdfghklmnprstvwxyzžščńćđňľ]') THEN 'MASC' END"""


@query(f"{_WORDS} SELECT slug, {_GENDER} AS gender FROM lex")
def infer_gender(spark, d):
    return _lexicon(spark, d).withColumn("gender", S.inferred_gender(F.col("slug")))


def _stem_sql(word: str, pos: str) -> str:
    parts = f"WHEN ends_with({word}, 'ę') THEN left({word}, length({word}) - 1) || 'en' " if pos == "NOUN" else ""
    for e in M.STEM_ENDINGS[pos]:
        answer = f"left({word}, length({word}) - {len(e)})"
        if e == "či":
            answer = f"left({word}, greatest(length({word}) - 3, 0)) || 'k'"
        parts += f"WHEN ends_with({word}, '{e}') THEN {answer} "
    return f"CASE {parts}ELSE {word} END"


@query(f"{_WORDS} SELECT slug, {', '.join(f'{_stem_sql(chr(115) + chr(108) + chr(117) + chr(103), p)} AS {p.lower()}_stem' for p in ('VERB', 'NOUN', 'ADJ', 'ADV'))} FROM lex")
def heuristic_stem(spark, d):
    return _lexicon(spark, d).select("slug", *[M.heuristic_stem(F.col("slug"), p).alias(f"{p.lower()}_stem") for p in ("VERB", "NOUN", "ADJ", "ADV")])


def _change_sql(v: str, changes: dict[str, str], more: str = "") -> str:
    return "".join(f"WHEN ends_with({v}, '{a}') THEN left({v}, length({v}) - {len(a)}) || '{b}' " for a, b in changes.items()) + more


_PAL = lambda v: f"CASE {_change_sql(v, M.PALATAL)}ELSE {v} END"
_IOT = lambda v: f"CASE {_change_sql(v, M.IOTATED_PAIRS)}WHEN right({v}, 1) IN ('p','b','m','v','f') THEN {v} || 'lj' {_change_sql(v, M.IOTATED)}ELSE {v} END"
_FLEET = "CASE WHEN regexp_matches(slug, '[eьъ][a-zčšžćđńljǯ]$') AND NOT regexp_matches(slug, '[aeiouyěęǫųåȯ]$') THEN left(slug, length(slug) - 2) || right(slug, 1) END"


@query(
    f"""{_WORDS}, s AS (SELECT slug, {_FLEET} AS short FROM lex), c AS (SELECT slug, unnest([slug, short, {_PAL('slug')}, {_IOT('slug')}, CASE WHEN short IS NULL THEN NULL ELSE {_PAL('short')} END]) AS stem FROM s)
    SELECT slug, string_agg(DISTINCT stem, '|' ORDER BY stem) AS stems FROM c WHERE stem IS NOT NULL GROUP BY slug"""
)
def stem_candidates(spark, d):
    return _lexicon(spark, d).select("slug", F.array_join(F.array_sort(M.stem_candidates(F.col("slug"))), "|").alias("stems"))


_ENDINGS = sorted({e for lines in M.NOUN_ENDINGS.values() for line in lines for e in line.split() if e != "-"})
_DOC_WORDS = rf"dw AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '(?i)[{X.WORD_CLASS}]+')) AS w FROM documents))"


def _doc_words(spark, d):
    return arrow_tokens.vocabulary(_docs(spark, d)).filter("word").select(F.lower("surface").alias("word")).distinct()


@query(
    f"""{_WORDS}, {_DOC_WORDS}, bases AS (SELECT {_stem_sql('slug', 'NOUN')} AS base, count(*) AS lexemes FROM lex GROUP BY 1),
    probe AS (SELECT DISTINCT word, left(word, length(word) - n) AS base FROM (SELECT word, unnest(range(0, 5)) AS n FROM dw)
      WHERE length(word) - n >= 1 AND (n = 0 OR (length(word) - n >= 2 AND right(word, n::INT) IN ({', '.join(map(_text, _ENDINGS))}))))
    SELECT word, base, lexemes FROM probe JOIN bases USING (base)"""
)
def stem_probe(spark, d):
    """Words of the corpus whose possible bases are bases of the lexicon."""
    bases = _lexicon(spark, d).groupBy(M.heuristic_stem(F.col("slug"), "NOUN").alias("base")).agg(F.count("*").alias("lexemes"))
    probe = _doc_words(spark, d).select("word", F.explode(M.hypothetical_bases(F.col("word"), _ENDINGS)).alias("base"))
    return probe.join(bases, "base").select("word", "base", "lexemes")


@query(
    f"""{_WORDS}, st AS (SELECT slug, {_stem_sql('slug', 'NOUN')} AS stem FROM lex), c AS (SELECT w.slug AS word, st.slug, st.stem FROM lex w JOIN st ON st.stem <> '' AND starts_with(w.slug, st.stem))
    SELECT word, slug, stem FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY stem = word, length(stem) DESC, slug) AS rn FROM c) WHERE rn = 1"""
)
def stem_prefix(spark, d):
    """The longest stem that begins a word, a stem that is the word last: an equi-join on all prefixes."""
    stems = _lexicon(spark, d).select("slug", M.heuristic_stem(F.col("slug"), "NOUN").alias("stem")).filter("stem <> ''")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("stem")
    words = _lexicon(spark, d).select(F.col("slug").alias("word")).select("word", prefixes)
    order = F.struct((F.col("stem") == F.col("word")).alias("whole"), (-F.length("stem")).alias("n"), "slug")
    best = words.join(stems, "stem").groupBy("word").agg(F.min_by(F.struct("slug", "stem"), order).alias("b"))
    return best.select("word", "b.slug", "b.stem")


_RULES = ", ".join(f"({a}, '{b}', {c}, '{e}', {f})" for a, b, c, e, f in M.lemma_rules())


@query(
    f"""{_WORDS}, {_DOC_WORDS}, rules(ord, ending, more, add_, least) AS (VALUES {_RULES}),
    c AS (SELECT word, -1 AS ord, word AS lemma FROM dw UNION ALL SELECT word, ord, left(word, length(word) - length(ending)) || add_ FROM dw JOIN rules
      ON ends_with(word, ending) AND length(word) >= length(ending) + more AND length(word) - length(ending) >= least)
    SELECT word, lemma FROM (SELECT word, lemma, row_number() OVER (PARTITION BY word ORDER BY ord) AS rn FROM c WHERE lemma IN (SELECT slug FROM lex)) WHERE rn = 1"""
)
def lemma_candidates(spark, d):
    return M.lemmatized(_doc_words(spark, d), _lexicon(spark, d))


@query(
    f"""{_WORDS}, g AS (SELECT left(slug, 2) AS root_group, slug FROM lex WHERE length(slug) >= 3), n AS (SELECT root_group, count(*) AS words FROM g GROUP BY 1),
    parts AS (SELECT DISTINCT root_group, slug, substr(slug, i, k) AS part FROM (SELECT root_group, slug, i, unnest(range(3, length(slug) - i + 2)) AS k FROM (SELECT root_group, slug, unnest(range(1, length(slug) - 1)) AS i FROM g))),
    c AS (SELECT root_group, part, count(*) AS hits FROM parts GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY root_group ORDER BY hits DESC, length(part) DESC, part) AS rn FROM c)
    SELECT root_group, words, part AS root, hits / words AS ratio FROM best JOIN n USING (root_group) WHERE rn = 1"""
)
def root_candidates(spark, d):
    words = _lexicon(spark, d).select(F.substring("slug", 1, 2).alias("root_group"), "slug")
    return M.root_candidates(words, "root_group", "slug")


#: Word-class codes of import files: code, part of speech, gender, aspect, transitivity, degree or type.
GRAMMAR_CODES = [
    ("n", "NOUN", "", "", "", ""),
    ("nn", "NOUN", "", "", "", ""),
    ("v", "VERB", "", "", "", ""),
    ("adj", "ADJ", "", "", "", ""),
    ("adk", "ADJ", "", "", "", ""),
    ("adv", "ADV", "", "", "", ""),
    ("g", "X", "", "", "", ""),
    ("pron", "PRON", "", "", "", ""),
    ("num", "NUM", "", "", "", ""),
    ("prep", "ADP", "", "", "", ""),
    ("phr", "X", "", "", "", ""),
    ("part", "PART", "", "", "", ""),
    ("int", "INTJ", "", "", "", ""),
    ("conj", "CCONJ", "", "", "", ""),
    ("prop", "PROPN", "", "", "", ""),
    ("f.", "NOUN", "FEM", "", "", ""),
    ("m.", "NOUN", "MASC", "", "", ""),
    ("m.anim.", "NOUN", "MASC", "", "", ""),
    ("n.", "NOUN", "NEUT", "", "", ""),
    ("f.pl.", "NOUN", "FEM", "", "", ""),
    ("m.pl.", "NOUN", "MASC", "", "", ""),
    ("n.pl.", "NOUN", "NEUT", "", "", ""),
    ("m./f.", "NOUN", "", "", "", ""),
    ("v.tr. ipf.", "VERB", "", "IPF", "TR", ""),
    ("v.tr. pf.", "VERB", "", "PF", "TR", ""),
    ("v.intr. ipf.", "VERB", "", "IPF", "INTR", ""),
    ("v.intr. pf.", "VERB", "", "PF", "INTR", ""),
    ("v.refl. ipf.", "VERB", "", "IPF", "REFL", ""),
    ("v.refl. pf.", "VERB", "", "PF", "REFL", ""),
    ("v.tr. ipf./pf.", "VERB", "", "BI", "TR", ""),
    ("v.ipf.", "VERB", "", "IPF", "", ""),
    ("v.pf.", "VERB", "", "PF", "", ""),
    ("v.aux. ipf.", "AUX", "", "IPF", "", ""),
    ("v.aux. pf.", "AUX", "", "PF", "", ""),
    ("adj.", "ADJ", "", "", "", "POS"),
    ("adj.sup.", "ADJ", "", "", "", "SUP"),
    ("adj.comp.", "ADJ", "", "", "", "CMP"),
    ("adv.", "ADV", "", "", "", ""),
    ("prep.", "ADP", "", "", "", ""),
    ("conj.", "CCONJ", "", "", "", ""),
    ("intj.", "INTJ", "", "", "", ""),
    ("particle", "PART", "", "", "", ""),
    ("phrase", "X", "", "", "", ""),
    ("prefix", "X", "", "", "", ""),
    ("suffix", "X", "", "", "", ""),
    ("pron.pers.", "PRON", "", "", "", "pers"),
    ("pron.poss.", "PRON", "", "", "", "poss"),
    ("num.card.", "NUM", "", "", "", "card"),
    ("num.ord.", "NUM", "", "", "", "ord"),
]
_CODE_COLUMNS = "code string, pos string, gender string, aspect string, transitivity string, kind string"


@query(
    f"""WITH codes(code, pos, gender, aspect, transitivity, kind) AS (VALUES {', '.join(str(c) for c in GRAMMAR_CODES)}), n AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS i FROM codes),
    p AS (SELECT p_partkey, p_size, (p_size * 3 + p_partkey) % (SELECT count(*) + 3 FROM codes) AS i FROM part)
    SELECT p_partkey, pos, gender, aspect, transitivity, kind FROM p LEFT JOIN n USING (i)"""
)
def grammar_map(spark, d):
    """Word-class codes of parts, with their meaning; unknown codes have none."""
    codes = sorted(GRAMMAR_CODES, key=lambda c: c[0].encode())
    numbered = spark.createDataFrame([(*c, i) for i, c in enumerate(codes)], _CODE_COLUMNS + ", i long")
    part = table(spark, d, "part").select("p_partkey", ((F.col("p_size") * 3 + F.col("p_partkey")) % (len(codes) + 3)).cast("long").alias("i"))
    return part.join(F.broadcast(numbered), "i", "left").select("p_partkey", "pos", "gender", "aspect", "transitivity", "kind")


@query(
    """WITH g AS (SELECT p_partkey, 'Case=' || ['Nom','Acc','Gen','Dat','Ins','Loc','Voc'][(p_partkey % 7 + 1)::INT] || '|Number=' || ['Sing','Plur','Dual'][(p_partkey % 3 + 1)::INT] || CASE WHEN p_size > 25 THEN '|Gender=Masc' ELSE '' END AS grammeme FROM part)
    SELECT p_partkey, grammeme, regexp_extract(grammeme, 'Case=([^|]*)', 1) AS kase, regexp_extract(grammeme, 'Number=([^|]*)', 1) AS number, nullif(regexp_extract(grammeme, 'Gender=([^|]*)', 1), '') AS gender FROM g"""
)
def grammeme_parse(spark, d):
    """Built and read again: Case=..|Number=..|Gender=.."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    grammeme = F.concat(
        F.lit("Case="),
        pick(["Nom", "Acc", "Gen", "Dat", "Ins", "Loc", "Voc"], F.col("p_partkey") % 7),
        F.lit("|Number="),
        pick(["Sing", "Plur", "Dual"], F.col("p_partkey") % 3),
        F.when(F.col("p_size") > 25, "|Gender=Masc").otherwise(""),
    )
    rows = table(spark, d, "part").select("p_partkey", grammeme.alias("grammeme")).withColumn("m", F.str_to_map("grammeme", F.lit("\\|"), F.lit("=")))
    return rows.select("p_partkey", "grammeme", F.col("m")["Case"].alias("kase"), F.col("m")["Number"].alias("number"), F.col("m")["Gender"].alias("gender"))


@query(
    f"{_WORDS}, w AS (SELECT slug, {duck(S.TO_CYRILLIC, 'slug')} AS cyr FROM lex) SELECT slug, cyr, {duck(S.CYRILLIC_TO_HUB, 'cyr')} AS back, {duck(S.CYRILLIC_TO_HUB + S.SIMPLE, 'cyr')} AS simple, {duck(S.FROM_HUB['std_cyr'], 'slug')} AS std_cyr FROM w"
)
def translit_hub(spark, d):
    """Words in Cyrillic letters, back again, and in simple spelling."""
    rows = _lexicon(spark, d).withColumn("cyr", S.converted(F.col("slug"), "etym_lat", "etym_cyr"))
    return rows.select(
        "slug",
        "cyr",
        S.converted(F.col("cyr"), "etym_cyr", "etym_lat").alias("back"),
        S.converted(F.col("cyr"), "etym_cyr", "simple_lat").alias("simple"),
        S.converted(F.col("slug"), "std_lat", "std_cyr").alias("std_cyr"),
    )


@query(f"{_WORDS} SELECT slug, '[' || {duck(S.IPA, 'slug')} || ']' AS ipa, {duck(S.GLAGOLITIC, 'slug')} AS glagolitic FROM lex")
def ipa(spark, d):
    return _lexicon(spark, d).select("slug", F.concat(F.lit("["), S.applied(S.IPA, F.col("slug")), F.lit("]")).alias("ipa"), S.applied(S.GLAGOLITIC, F.col("slug")).alias("glagolitic"))


@query(f"{_WORDS} SELECT slug, {duck(S.EAST, 'slug')} AS east, {duck(S.WEST, 'slug')} AS west, {duck(S.SOUTH, 'slug')} AS south FROM lex")
def flavors(spark, d):
    return _lexicon(spark, d).select("slug", *[S.applied(c, F.col("slug")).alias(n) for n, c in (("east", S.EAST), ("west", S.WEST), ("south", S.SOUTH))])


@query(_chain("modern", S.FROM_PROTO))
def proto_convert(spark, d):
    return _words(spark, d).withColumn("modern", S.applied(S.FROM_PROTO, F.col("word")))


_END_VALUES = ", ".join(
    f"('{s}', '{n}', '{c}', '{'' if e == '-' else e}')" for s, lines in M.NOUN_ENDINGS.items() for n, line in zip(M.NUMBERS, lines) for c, e in zip(M.CASES, line.split())
)
_END_TABLE = f"ends(stem_type, number, \"case\", ending) AS (VALUES {_END_VALUES})"


def _nouns(spark, d):
    paradigm = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.length("slug") % 3 + 1).cast("int"))
    return _lexicon(spark, d).select("slug", M.default_stem_type(F.col("slug")).alias("stem_type"), paradigm.alias("paradigm"))


def _tone_sql() -> str:
    v = M.VOWELS
    last, before = f"(?i)^(.*)([{v}])([^{v}]*)$", f"(?i)^(.*)([{v}])([^{v}]*[{v}][^{v}]*)$"

    def put(p: str) -> str:
        short = f"lower(regexp_extract(form, '{p}', 2)) IN ('o', 'e')"
        sign = f"CASE WHEN rising THEN CASE WHEN {short} THEN chr(768) ELSE chr(769) END ELSE CASE WHEN {short} THEN chr(785) ELSE chr(770) END END"
        return f"regexp_extract(form, '{p}', 1) || regexp_extract(form, '{p}', 2) || {sign} || regexp_extract(form, '{p}', 3)"

    return f"CASE WHEN place = 1 AND regexp_matches(form, '{before}') THEN {put(before)} WHEN regexp_matches(form, '{last}') THEN {put(last)} ELSE form END"


_NOUNS = f"nouns AS (SELECT slug, CASE WHEN ({_GENDER}) IN ('FEM', 'NEUT') THEN 'a_hard' ELSE 'o_hard' END AS stem_type, ['A', 'B', 'C'][(length(slug) % 3 + 1)::INT] AS paradigm FROM lex)"


@query(
    f"""{_WORDS}, {_NOUNS}, {_END_TABLE}, f AS (SELECT *, slug || ending AS form, CASE WHEN stem_type = 'a_hard' THEN number = 'singular' AND "case" IN ('nominative', 'accusative')
      ELSE (number = 'singular' AND "case" IN ('nominative', 'accusative')) OR (number = 'plural' AND "case" = 'accusative') END AS falling FROM nouns JOIN ends USING (stem_type)),
    p AS (SELECT *, CASE paradigm WHEN 'A' THEN 1 WHEN 'B' THEN CASE WHEN ending IN ('', 'ъ', 'ь') THEN 1 ELSE 0 END ELSE CASE WHEN falling THEN 1 ELSE 0 END END AS place, paradigm <> 'C' OR NOT falling AS rising FROM f)
    SELECT slug, stem_type, paradigm, number, "case", ending, form, {_tone_sql()} AS toned FROM p"""
)
def paradigm_noun(spark, d):
    return M.noun_forms(_nouns(spark, d), M.endings(spark))


#: Endings of another origin than the table's, for some genders and animacies.
_OVERRIDES = [
    ("o_hard", "singular", "accusative", "MASC", "ANIM", "a"),
    ("o_hard", "plural", "nominative", "MASC", None, "ove"),
    ("o_hard", "singular", "locative", None, None, "u"),
    ("a_hard", "plural", "dative", None, None, "am"),
]


@query(
    f"""WITH {_END_TABLE}, o(stem_type, number, "case", gender, animacy, value) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else _text(x) for x in r) + ')' for r in _OVERRIDES)}),
    q AS (SELECT stem_type, number, "case", gender, animacy FROM ends, (VALUES ('MASC', 'ANIM'), ('MASC', NULL), ('FEM', NULL), (NULL, NULL)) g(gender, animacy))
    SELECT q.*, coalesce((SELECT value FROM o WHERE o.stem_type = q.stem_type AND o.number = q.number AND o."case" = q."case" AND o.gender = q.gender AND o.animacy = q.animacy),
      (SELECT value FROM o WHERE o.stem_type = q.stem_type AND o.number = q.number AND o."case" = q."case" AND o.gender = q.gender AND o.animacy IS NULL),
      (SELECT value FROM o WHERE o.stem_type = q.stem_type AND o.number = q.number AND o."case" = q."case" AND o.gender IS NULL AND o.animacy IS NULL), ending, '') AS ending
    FROM q JOIN ends USING (stem_type, number, "case")"""
)
def ending_fallback(spark, d):
    columns = "stem_type string, number string, `case` string, gender string, animacy string, value string"
    kinds = spark.createDataFrame([("MASC", "ANIM"), ("MASC", None), ("FEM", None), (None, None)], "gender string, animacy string")
    requests = M.endings(spark).select("stem_type", "number", "case").join(F.broadcast(kinds))
    return M.ending_with_fallback(requests, spark.createDataFrame(_OVERRIDES, columns), M.endings(spark))


@query(
    f"""{_WORDS}, {_DOC_WORDS}, lx AS (SELECT slug, {_stem_sql('slug', 'NOUN')} AS stem, CASE WHEN ({_GENDER}) IN ('FEM', 'NEUT') THEN 'a_hard' ELSE 'o_hard' END AS stem_type FROM lex), {_END_TABLE},
    forms AS (SELECT slug, {duck(S.NORMAL_FORM, 'lower(stem || ending)')} AS key FROM lx JOIN ends USING (stem_type)),
    ex AS (SELECT word, min(slug) AS lemma, count(*) AS match_count FROM dw JOIN forms ON {duck(S.NORMAL_FORM, 'lower(word)')} = key GROUP BY 1),
    px AS (SELECT word, slug AS prefix_lemma FROM (SELECT word, slug, row_number() OVER (PARTITION BY word ORDER BY stem = word, length(stem) DESC, slug) AS rn FROM
      (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM dw) JOIN lx ON stem <> '' AND stem = left(word, n)) WHERE rn = 1)
    SELECT word, coalesce(lemma, prefix_lemma) AS lemma, coalesce(match_count, CASE WHEN prefix_lemma IS NULL THEN 0 ELSE 1 END) AS match_count, lemma IS NULL AS partial
    FROM dw LEFT JOIN ex USING (word) LEFT JOIN px USING (word)"""
)
def dict_analyze(spark, d):
    """Words of the corpus looked up in the forms of the lexicon's nouns."""
    slug = F.col("slug")
    lexemes = _lexicon(spark, d).select("slug", M.heuristic_stem(slug, "NOUN").alias("stem"), M.default_stem_type(slug).alias("stem_type"))
    return M.analysed(_doc_words(spark, d), lexemes, M.endings(spark))


# pages, chapters, exports

_TRIM = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, substr({_TRIM(chr(114) + 'egexp_replace(regexp_replace(html, ' + _text('<[^>]+>') + ', ' + _text('') + ', ' + _text('g') + '), ' + _text(chr(92) + 's+') + ', ' + _text(' ') + ', ' + _text('g') + ')')}, 1, 200) AS preview FROM pages")
def html_preview(spark, d):
    return table(spark, d, "pages").select("page_id", S.without_tags(F.col("html")).alias("preview"))


@query(
    f"""WITH b AS (SELECT doc_id, string_split(regexp_replace(text, '\\n', chr(10) || '## ', 'g'), chr(10) || '## ') AS parts FROM documents),
    p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i, len(parts) AS n FROM b),
    c AS (SELECT doc_id, i, n, CASE WHEN i = 0 THEN '' ELSE {_TRIM('part')} END AS heading, CASE WHEN i = 0 THEN CASE WHEN n = 1 THEN part ELSE {_TRIM('part')} END ELSE '' END AS content FROM p)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chapter, heading, content FROM c WHERE n = 1 OR heading <> '' OR content <> ''"""
)
def chapter_split(spark, d):
    """Documents whose lines are made headings, as chapters."""
    body = F.regexp_replace("text", "\n", "\n## ")
    rows = _docs(spark, d).select("doc_id", F.posexplode(S.chapters(body)).alias("chapter", "c"))
    return rows.select("doc_id", "chapter", "c.heading", "c.content")


@query(
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\*[^\s.,;()]+)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
    m AS (SELECT doc_id, unnest(parts[:-2]) AS before, unnest(parts[2:]) AS part, unnest(range(len(parts) - 1))::INT AS hit FROM p)
    SELECT doc_id, hit, regexp_extract(part, '\*([^\s.,;()]+)', 1) AS word, right(before, 10) || left(part, 290) AS context FROM m"""
)
def regex_context(spark, d):
    """Every starred form in running text, with the text before and after it, up to the next one on either side."""
    star = r"\*([^\s.,;()]+)"
    rows = _docs(spark, d).filter(F.contains("text", F.lit("*"))).select("doc_id", F.split(F.regexp_replace("text", star, "\u0001*$1"), "\u0001").alias("parts"))
    parts = F.col("parts")
    hit = lambda p, i: F.struct(F.get(parts, i).alias("before"), p.alias("part"))
    found = rows.select("doc_id", F.posexplode(F.transform(F.slice(parts, F.lit(2), F.size(parts)), hit)).alias("hit", "m"))
    context = F.concat(F.right("m.before", F.lit(10)), F.left("m.part", F.lit(290)))
    return found.select("doc_id", "hit", F.regexp_extract("m.part", star, 1).alias("word"), context.alias("context"))


_TEI_TAG = "CASE pos " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TEI_TAGS.items()) + " ELSE lower(pos) END"
_ANA = "CASE WHEN feats = '' THEN '' ELSE ' ana=\"' || " + duck(S.XML, "replace(feats, '|', '; ')") + " || '\"' END"


@query(
    f"""WITH {TAG}, {LEX}, x AS (SELECT doc_id, segment, sentence_no, token_index, CASE WHEN is_word THEN '<w lemma="' || {duck(S.XML, 'lemma')} || '" pos="' || {_TEI_TAG} || '"' || {_ANA}
      || CASE WHEN lex.slug IS NULL THEN ' cert="low"' ELSE '' END || '>' || {duck(S.XML, 'surface')} || '</w>' ELSE '<pc>' || {duck(S.XML, 'surface')} || '</pc>' END AS t
      FROM tag LEFT JOIN lex ON lower(surface) = lex.slug)
    SELECT doc_id, sentence_no, '<s n="' || (sentence_no + 1) || '">' || string_agg(t, ' ' ORDER BY token_index) || '</s>' AS xml FROM x GROUP BY doc_id, sentence_no"""
)
def tei_sentence(spark, d):
    """Sentences as TEI XML. Known forms come from a small lexicon by a join; a sentence is put together in its document's row."""
    lines = maintenance.tei_lines(table(spark, d, "documents"), _docs(spark, d), _lexicon(spark, d))
    # no document is without lines; outer, as the plain form is made to test their number first, which makes the lines twice
    return lines.select("doc_id", F.posexplode_outer("lines").alias("sentence_no", "s")).select("doc_id", "sentence_no", "s.xml")


_ADJ_VALUES = ", ".join(f"('{k}', '{n}', '{g}', '{c}', '{e}')" for (k, n, g), line in M.ADJECTIVE_TABLE.items() for c, e in zip(M.CASES, line.split()))


@query(
    f"""{_WORDS}, ends(kind, number, gender, "case", ending) AS (VALUES {_ADJ_VALUES})
    SELECT slug, kind, number, gender, "case", left(slug, length(slug) - 1) || ending AS form FROM (SELECT slug, CASE WHEN ends_with(slug, 'i') THEN 'soft' ELSE 'hard' END AS kind FROM lex WHERE right(slug, 1) IN ('y', 'i')) JOIN ends USING (kind)"""
)
def paradigm_adjective(spark, d):
    slug = F.col("slug")
    words = _lexicon(spark, d).filter(F.substring("slug", -1, 1).isin("y", "i"))
    rows = words.select("slug", F.when(F.endswith(slug, F.lit("i")), "soft").otherwise("hard").alias("kind"), F.lit("A").alias("paradigm"))
    return M.adjective_forms(rows, M.adjective_endings(spark)).select("slug", "kind", "number", "gender", "case", "form")


def _verb_sql() -> str:
    """CTEs from v (slug) to f (slug, verb_class, f): stems by the infinitive's ending, then one struct for each form."""
    cut = lambda v, n: f"left({v}, length({v}) - {n})"
    plus = lambda stem, line: [f"{stem} || '{'' if e == '-' else e}'" for e in line.split()]
    either = lambda condition, x, y: [f"CASE WHEN {condition} THEN {p} ELSE {q} END" for p, q in zip(x, y, strict=True)]
    four = "verb_class = 'IV'"
    present = plus("pres", V.PRESENT)
    present[0] = f"CASE WHEN {four} THEN {_IOT(cut('pres', 1))} || 'ų' ELSE base || 'ų' END"
    present[8] = f"CASE WHEN {four} THEN {cut('pres', 1)} || 'ęt' ELSE base || 'ųt' END"
    passive = either("ends_with(base, 'j')", plus("base", V.PASSIVE["j"]), plus("base", V.PASSIVE[""]))
    tenses = [
        ("infinitive", ["-"], ["slug"]),
        ("present", V.PERSONS, present),
        ("aorist", V.PERSONS, either("vowel", plus("inf", V.AORIST_VOWEL), plus("inf", V.AORIST_CONSONANT))),
        ("imperfect", V.PERSONS, plus("(CASE WHEN vowel THEN inf ELSE inf || 'ě' END)", V.IMPERFECT)),
        ("imperative", list(V.IMPERATIVE), [f"command || '{e}'" for e in V.IMPERATIVE.values()]),
        ("l_participle", list(V.L_PARTICIPLE), [f"inf || '{e}'" for e in V.L_PARTICIPLE.values()]),
        ("active_participle", V.GENDERS, either(four, plus("(" + _IOT(cut("pres", 1)) + ")", V.ACTIVE["IV"]), plus("base", V.ACTIVE[""]))),
        ("passive_participle", V.GENDERS, either(four, plus(cut("pres", 1), V.PASSIVE["IV"]), passive)),
        ("past_passive", V.GENDERS, plus("past", V.PAST_PASSIVE)),
    ]
    rows = ", ".join(f"{{'tense': '{t}', 'person': '{p}', 'form': {f}}}" for t, persons, forms in tenses for p, f in zip(persons, forms, strict=True))
    return f"""c AS (SELECT slug, CASE WHEN ends_with(slug, 'iti') AND length(slug) > 5 THEN 'IV' WHEN ends_with(slug, 'ovati') OR ends_with(slug, 'ati') THEN 'III' WHEN ends_with(slug, 'nuti') THEN 'II' ELSE 'I' END AS verb_class FROM v),
    s AS (SELECT slug, verb_class, {cut('slug', 2)} AS inf,
      CASE WHEN {four} THEN {cut('slug', 2)} WHEN ends_with(slug, 'ovati') THEN {cut('slug', 5)} || 'uje' WHEN verb_class = 'III' THEN {cut('slug', 3)} || 'aje' WHEN verb_class = 'II' THEN {cut('slug', 4)} || 'ne'
      ELSE ({_PAL(cut('slug', 2))}) || 'e' END AS pres FROM c),
    b AS (SELECT *, CASE WHEN ends_with(pres, 'e') THEN {cut('pres', 1)} ELSE pres END AS base, verb_class IN ('III', 'IV') OR right(inf, 1) IN ('a', 'i') AS vowel FROM s),
    m AS (SELECT *, CASE WHEN {four} THEN pres WHEN ends_with(base, 'j') THEN base ELSE base || 'j' END AS command,
      CASE WHEN {four} THEN ({_PAL(cut('inf', 1))}) || 'en' WHEN verb_class = 'III' THEN inf || 'n' WHEN verb_class = 'II' THEN {cut('inf', 1)} || 'en'
      WHEN regexp_matches(right(inf, 1), '[aeiouyěęǫ]') THEN inf || 't' ELSE ({_PAL('inf')}) || 'en' END AS past FROM b),
    f AS (SELECT slug, verb_class, unnest([{rows}]) AS f FROM m)"""


@query(f"{_WORDS}, v AS (SELECT slug || 'ti' AS slug FROM lex), {_verb_sql()} SELECT slug, verb_class, f.tense AS tense, f.person AS person, f.form AS form FROM f")
def paradigm_verb(spark, d):
    """Forms of made-up infinitives from the lexicon's words."""
    return V.verb_forms(_lexicon(spark, d).select(F.concat("slug", F.lit("ti")).alias("slug")))


@query(f"{_WORDS} SELECT slug, {duck(S.NEW_TO_STANDARD, duck(S.TO_CYRILLIC_NEW, 'slug'))} AS standard, {duck(S.CLEAN_MATCH, 'slug')} AS clean FROM lex")
def new_spelling(spark, d):
    """Words in the new Cyrillic spelling, read as standard Latin, and bare for matching."""
    slug = F.col("slug")
    return _lexicon(spark, d).select("slug", S.applied(S.TO_CYRILLIC_NEW + S.NEW_TO_STANDARD, slug).alias("standard"), S.applied(S.CLEAN_MATCH, slug).alias("clean"))


@query(
    f"""WITH RECURSIVE {LEX}, {_DOC_WORDS}, g AS (SELECT left(slug, 2) AS root_group, slug FROM lex WHERE length(slug) >= 3),
    parts AS (SELECT DISTINCT root_group, slug, substr(slug, i, k) AS part FROM (SELECT root_group, slug, i, unnest(range(3, length(slug) - i + 2)) AS k FROM (SELECT root_group, slug, unnest(range(1, length(slug) - 1)) AS i FROM g))),
    c AS (SELECT root_group, part, count(*) AS hits FROM parts GROUP BY 1, 2),
    roots AS (SELECT DISTINCT part AS root FROM (SELECT *, row_number() OVER (PARTITION BY root_group ORDER BY hits DESC, length(part) DESC, part) AS rn FROM c) WHERE rn = 1),
    spans AS (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM dw)),
    h AS (SELECT word, i, max(n) AS n FROM spans JOIN roots ON substr(word, i, n) = root GROUP BY 1, 2),
    nxt AS MATERIALIZED (SELECT h.word, h.i, h.n, min(j.i) AS nx FROM h LEFT JOIN h j ON j.word = h.word AND j.i >= h.i + h.n GROUP BY 1, 2, 3),
    r AS (SELECT word, i, n, nx, CASE WHEN i > 1 THEN 'prefix:' || left(word, i - 1) || '|' ELSE '' END || 'root:' || substr(word, i, n) AS parts
        FROM nxt JOIN (SELECT word, min(i) AS i FROM h GROUP BY 1) USING (word, i)
      UNION ALL SELECT r.word, nxt.i, nxt.n, nxt.nx, r.parts || CASE WHEN nxt.i > r.i + r.n THEN '|unknown:' || substr(r.word, r.i + r.n, nxt.i - r.i - r.n) ELSE '' END || '|root:' || substr(r.word, nxt.i, nxt.n)
        FROM r JOIN nxt ON nxt.word = r.word AND nxt.i = r.nx)
    SELECT word, parts || CASE WHEN i + n <= length(word) THEN '|suffix:' || substr(word, i + n) ELSE '' END AS parts FROM r WHERE nx IS NULL"""
)
def morpheme_segments(spark, d):
    """Words of the corpus cut at roots: the roots mined from the lexicon."""
    words = _lexicon(spark, d).select(F.substring("slug", 1, 2).alias("g"), "slug")
    roots = M.root_candidates(words, "g", "slug").select("root")
    return M.segmented(_doc_words(spark, d), roots).withColumn("parts", F.expr("array_join(transform(parts, p -> p.kind || ':' || p.text), '|')"))


# all parts of speech

_POS = """CASE WHEN right(slug, 1) IN ('y', 'i') AND NOT ends_with(slug, 'ti') THEN 'ADJ' WHEN ends_with(slug, 'ti') THEN 'VERB' WHEN ends_with(slug, 'o') THEN 'ADV' WHEN length(slug) < 3 THEN 'ADP' ELSE 'NOUN' END"""
_PRONOUNS = ", ".join("(" + ", ".join("NULL" if v is None else _text(v) for v in r) + ")" for r in K.pronoun_rows())
_NUMERALS = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in K.numeral_rows())
_GRADED = "length(slug) > 2 AND right(slug, 1) IN ('o', 'e', 'ě')"
_ALL_FORMS = f"""lp AS (SELECT slug, {_POS} AS pos FROM lex), {_END_TABLE}, adj(kind, number, gender, "case", ending) AS (VALUES {_ADJ_VALUES}),
    pron(slug, number, gender, "case", form, short) AS (VALUES {_PRONOUNS}), nums(slug, gender, "case", form) AS (VALUES {_NUMERALS}), v AS (SELECT slug FROM lp WHERE pos = 'VERB'), {_verb_sql()},
    forms AS (SELECT slug, 'NOUN' AS pos, number || ' ' || "case" AS feats, slug || ending AS form FROM (SELECT slug, CASE WHEN ({_GENDER}) IN ('FEM', 'NEUT') THEN 'a_hard' ELSE 'o_hard' END AS stem_type FROM lp WHERE pos = 'NOUN') JOIN ends USING (stem_type)
      UNION ALL SELECT slug, 'ADJ', number || ' ' || gender || ' ' || "case", left(slug, length(slug) - 1) || ending FROM lp JOIN adj ON kind = CASE WHEN ends_with(slug, 'i') THEN 'soft' ELSE 'hard' END WHERE pos = 'ADJ'
      UNION ALL SELECT slug, 'VERB', f.tense || ' ' || f.person, f.form FROM f
      UNION ALL SELECT slug, 'ADV', 'pos', slug FROM lp WHERE pos = 'ADV'
      UNION ALL SELECT slug, 'ADV', d, CASE d WHEN 'cmp' THEN '' ELSE 'naj' END || left(slug, length(slug) - 1) || 'ěje' FROM lp, (SELECT unnest(['cmp', 'sup']) AS d) WHERE pos = 'ADV' AND {_GRADED}
      UNION ALL SELECT slug, 'ADP', '', slug FROM lp WHERE pos = 'ADP'
      UNION ALL SELECT slug, 'PRON', concat_ws(' ', number, gender, "case"), form FROM pron UNION ALL SELECT slug, 'NUM', gender || ' ' || "case", form FROM nums)"""


def _all_forms(spark, d):
    slug = F.col("slug")
    pos = (
        F.when(F.substring(slug, -1, 1).isin("y", "i") & ~F.endswith(slug, F.lit("ti")), "ADJ")
        .when(F.endswith(slug, F.lit("ti")), "VERB")
        .when(F.endswith(slug, F.lit("o")), "ADV")
        .when(F.length(slug) < 3, "ADP")
        .otherwise("NOUN")
    )
    closed = [(w, "PRON") for w in sorted({r[0] for r in K.pronoun_rows()})] + [(w, "NUM") for w in sorted({r[0] for r in K.numeral_rows()})]
    lexemes = _lexicon(spark, d).select("slug", pos.alias("pos")).unionByName(spark.createDataFrame(closed, "slug string, pos string"))
    return P.forms_of(lexemes)


@query(f"{_WORDS}, {_ALL_FORMS} SELECT slug, pos, feats, form FROM forms")
def paradigm_dispatch(spark, d):
    """All forms of the lexicon's words, which their endings make nouns, adjectives, verbs or adverbs, and of pronouns and numerals."""
    return _all_forms(spark, d)


@query(
    f"""{_WORDS}, {_DOC_WORDS}, {_ALL_FORMS}, k AS (SELECT slug, pos, {duck(S.NORMAL_FORM, 'lower(form)')} AS key FROM forms)
    SELECT word, pos, min(slug) AS lemma, count(*) AS match_count FROM dw JOIN k ON {duck(S.NORMAL_FORM, 'lower(word)')} = key GROUP BY word, pos"""
)
def dict_analyze_all(spark, d):
    """Words of the corpus looked up in the forms of all parts of speech."""
    return P.analyses(_doc_words(spark, d), _all_forms(spark, d))
