"""Where the accent stands and which mark it is, for all parts of speech, as a rule of paradigm, cell and vowels; and accents in running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators import arrow_tokens

from .spellings import single_j
from .stems import VOWELS, accented, marked, with_preposition, without_tones
from .strings import SOFT, applied

#: The marks of verbs.
ACUTE, SHORT, CIRCUMFLEX = "́", "̀", "̂"


def nuclei(word: Column) -> Column:
    """array<struct<place, vowel>>: the word's vowels, which make its syllables, and where they stand, from 0."""
    letters = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    placed = F.transform(letters, lambda x, i: F.struct(i.alias("place"), x.alias("vowel")))
    return F.filter(placed, lambda x: F.contains(F.lit(VOWELS), F.lower(x["vowel"])))


def syllables_before(word: Column, place: Column) -> Column:
    """How many syllables begin before a place in the word."""
    return F.size(F.filter(nuclei(word), lambda x: x["place"] < place))


def stress_position(form: Column, morphemes: Column) -> Column:
    """The stressed syllable, from 0, by the form's morphemes: array<struct<value, position>>, position within the morpheme or null.

    Of the stressed morphemes that the form has, the rightmost decides (the later one of two at one place); null without any.
    """
    found = F.transform(morphemes, lambda m, i: F.struct((F.instr(form, m["value"]) - 1).alias("start"), i.alias("nth"), m["position"].alias("position")))
    last = F.array_max(F.filter(found, lambda m: m["position"].isNotNull() & (m["start"] >= 0)))
    return syllables_before(form, last["start"]) + last["position"]


def normal_form(form: Column) -> Column:
    """A form as it is written: soft consonants hard before front vowels, one j for two."""
    return single_j(applied(SOFT, form))


def _placed(form: Column, from_end: Column | int, mark: str) -> Column:
    return F.when(form.rlike(f"(?i)[{VOWELS}]"), accented(form, F.lit(from_end) if isinstance(from_end, int) else from_end, F.lit(mark))).otherwise(form)


def verb_tone(form: Column, paradigm: Column, tense: Column, person: Column) -> Column:
    """A verb form with its accent; infinitives and participles but the l-participle have none.

    A: on the first syllable, acute. Present: in B on the one before the last, in C on the first, but for 1sg, whose ending is accented. Aorist and l-participle: on the first,
    but in C on the ending in 2sg, 3sg and the feminine. Imperfect: before the last, falling. Imperative: before the last.
    """
    a, b, c = (paradigm == p for p in "ABC")
    first = F.regexp_count(form, F.lit(f"(?i)[{VOWELS}]")) - 1
    own = (tense == "present") & (person == "1sg") & (b | c) | (tense == "aorist") & c & person.isin("2sg", "3sg") | (tense == "l_participle") & c & (person == "fem_sg")
    return (
        F.when(~tense.isin("present", "aorist", "imperfect", "imperative", "l_participle") | ~paradigm.isin("A", "B", "C"), form)
        .when(tense == "imperfect", _placed(form, 1, CIRCUMFLEX))
        .when(own, _placed(form, 0, SHORT))
        .when(a, _placed(form, first, ACUTE))
        .when((tense == "imperative") | (tense == "present") & b, _placed(form, 1, ACUTE))
        .otherwise(_placed(form, first, SHORT))
    )


def pronoun_tone(form: Column, paradigm: Column, case: Column) -> Column:
    """A: rising before the last syllable. B: rising on the last, in short forms before it. C: falling in the nominative and vocative, else rising on the last."""
    drawn = F.endswith(form, F.lit("ъ")) | F.endswith(form, F.lit("ь")) | (F.length(form) <= 3)
    direct = case.isin("nominative", "vocative")
    place = F.when(paradigm == "A", 1).when(paradigm == "B", F.when(drawn, 1).otherwise(0)).otherwise(F.when(direct, 1).otherwise(0))
    return marked(form, place, (paradigm != "C") | ~direct)


def numeral_tone(form: Column, ending: Column, paradigm: Column, case: Column) -> Column:
    """Like pronouns, but in B a form of one syllable is short, endings without a vowel draw the accent back, and C's direct cases are nominative and accusative."""
    direct = case.isin("nominative", "accusative")
    place = F.when(paradigm == "A", 1).when(paradigm == "B", F.when(ending.isin("", "ъ", "ь"), 1).otherwise(0)).otherwise(F.when(direct, 1).otherwise(0))
    single = (paradigm == "B") & (F.regexp_count(form, F.lit(f"(?i)[{VOWELS}]")) <= 1)
    return F.when(single, _placed(form, 0, SHORT)).otherwise(marked(form, place, (paradigm != "C") | ~direct))


def collective_tone(form: Column, base: Column, paradigm: Column) -> Column:
    """A: rising before the last syllable; else as many syllables from the end as the ending has."""
    vowels = lambda v: F.regexp_count(v, F.lit(f"(?i)[{VOWELS}]"))
    return marked(form, F.when(paradigm == "A", 1).otherwise(vowels(form) - vowels(base)), F.lit(True))


def drawn_to_prepositions(docs: DataFrame, nouns: DataFrame, prepositions: list[str]) -> DataFrame:
    """doc_id, token_index, preposition, form, accented: every preposition before a known noun form in running text, and both with their accent.

    nouns: form (lower case, one row for each), toned, paradigm, number, case. Pairs are found in slices of texts, without a shuffle; they meet the
    nouns by an equi-join on the form, and the accent moves to the preposition where `with_preposition` says so.
    """
    rows = arrow_tokens.followed(docs).filter(F.lower("surface").isin(*prepositions))
    rows = rows.select("doc_id", "token_index", F.col("surface").alias("preposition"), F.col("next").alias("form"))
    found = rows.join(nouns.withColumnRenamed("form", "known"), F.lower("form") == F.col("known"))
    said = with_preposition(F.col("preposition"), F.col("toned"), F.col("paradigm"), F.col("number"), F.col("case"))
    return found.select("doc_id", "token_index", "preposition", "form", said.alias("accented"))


def plain(form: Column) -> Column:
    """Without accents."""
    return without_tones(form)
