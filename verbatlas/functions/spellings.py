"""Spellings that need more than replacements: letters of several characters, and rules that look at what was written before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import SOFT, applied
from .text import named

#: Letters of the new orthography that have one Latin letter, in etymological spelling. Capitals follow.
NEW_LETTERS = "бвгґджзпфхктчшсцјлмнрйўáэыӯóаеиуôоіьѣѧѫѳ"
ETYMOLOGICAL = "bvggdžzpfhktčšscjlmnrjvaeyvoaeiuooijěęųt"
#: Letters that have several, or none; ҏ has a capital only.
NEW_GROUPS = {"џ": "dž", "ѕ": "dz", "ї": "ji", "į": "in", "щ": "št", "ќ": "ks", "ѱ": "ps", "ъ": ""}
NEW_CAPITALS = {"Ҏ": "R", "҂": ""}
#: Vowels that begin with j, except after a written i or j.
SOFT_VOWELS = {"я": "a", "ю": "u", "є": "e", "ё": "o"}
#: What an adjective's full ending is cut to, where no letter follows.
FULL_ENDINGS = {"ый": "y", "ий": "i", "ЫЙ": "Y", "ИЙ": "I"}

#: The Glagolitic alphabet: small letters, digraphs first; the capital of ja is irregular.
GLAGOLITIC_GROUPS = {"dž": "ⰴⰶ", "št": "ⱋ", "dz": "ⰷ", "ju": "ⱓ", "jo": "ⱖ", "je": "ⱔ", "ja": "ⰻⰰ"}
GLAGOLITIC_LETTERS = {"y": "ⱏⰹ"} | dict(zip("abvgdežzijklmnoprstufhcěęǫų", "ⰰⰱⰲⰳⰴⰵⰶⰸⰹⰻⰽⰾⰿⱀⱁⱂⱃⱄⱅⱆⱇⱈⱌⱑⱗⱘⱘ"))
CAPITAL_JA = "ⰉⰀ"
#: Simple Cyrillic: letters of one character, digraphs, soft consonants that are left.
SIMPLE_LATIN_LETTERS = "bvgdžzpfhktčšsclmnraeiouyěęǫų"
SIMPLE_CYRILLIC = "бвгджзпфхктчшсцлмнраеиоуыееуу"
SIMPLE_GROUPS = {"dž": "џ", "št": "щ", "ks": "ќ", "ps": "ѱ"}
SIMPLE_SOFT = {"ľ": "ль", "ť": "ть", "ď": "дь", "ň": "нь", "ś": "сь", "ź": "зь", "ć": "ч", "đ": "д"}
#: Fixed value: the small ě and ę become a Latin e, as they always were.
LATIN_E = "ěę"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _capitals(pairs: dict[str, str]) -> dict[str, str]:
    """With capitals: of the key, and of the value's first letter."""
    return pairs | {k.upper(): v[:1].upper() + v[1:] for k, v in pairs.items()}


def new_letters() -> dict[str, str]:
    """What each letter of the new orthography is in etymological spelling."""
    return _capitals(dict(zip(NEW_LETTERS, ETYMOLOGICAL)) | NEW_GROUPS) | NEW_CAPITALS


def etymologized(text: Column) -> Column:
    """New orthography in etymological Latin letters: a fold over the characters that carries what was written last.

    A vowel that begins with j loses it after a written i or j; letters without a counterpart write nothing, so what came before them counts.
    """
    for full, short in FULL_ENDINGS.items():
        text = F.regexp_replace(text, f"{full}(?![▲\\p{{L}}])", short)
    plain, soft = _map(new_letters()), _map(SOFT_VOWELS | {k.upper(): v.upper() for k, v in SOFT_VOWELS.items()})
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))

    def step(state: Column, letter: Column) -> Column:
        vowel = F.try_element_at(soft, letter)
        j = F.when(F.lower(state["last"]).isin("i", "j"), F.lit("")).when(vowel == F.upper(vowel), F.concat(F.lit("J"), F.lower(vowel))).otherwise(F.concat(F.lit("j"), vowel))
        said = F.when(vowel.isNotNull(), F.when(j == "", vowel).otherwise(j)).otherwise(F.coalesce(F.try_element_at(plain, letter), letter))
        return F.struct(F.concat(state["out"], said).alias("out"), F.when(said == "", state["last"]).otherwise(F.substring(said, -1, 1)).alias("last"))

    return F.aggregate(characters(text), start, step, lambda s: s["out"])


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def letters(text: Column, groups: list[str]) -> Column:
    """The text's letters in order, the longest first: groups of characters in either case, else single characters."""
    longest = sorted(groups, key=len, reverse=True)
    return F.regexp_extract_all(text, F.lit(f"(?isu){'|'.join(longest)}|."), F.lit(0))


def glagolitic(text: Column) -> Column:
    """In Glagolitic letters; a group of letters is a capital if its first letter is one. Letters that have none stay."""
    small = _map(GLAGOLITIC_GROUPS | GLAGOLITIC_LETTERS)

    def write(letter: Column) -> Column:
        first = F.substring(letter, 1, 1)
        found = F.try_element_at(small, F.lower(letter))
        large = F.when(F.lower(letter) == "ja", CAPITAL_JA).otherwise(F.upper(found))
        return F.when(found.isNull(), letter).when(first == F.lower(first), found).otherwise(large)

    return F.array_join(F.transform(letters(text, list(GLAGOLITIC_GROUPS)), write), "")


def from_glagolitic(text: Column) -> Column:
    """Back to Latin letters: a capital group has a capital first letter; ǫ and ų had one sign and come back as ų, a capital ja had that of I and A."""
    small = {v: k for k, v in (GLAGOLITIC_LETTERS | GLAGOLITIC_GROUPS).items()}
    known, groups = _map(small), [x for x in small if len(x) > 1]

    def read(letter: Column) -> Column:
        found = F.try_element_at(known, F.lower(letter))
        return F.when(found.isNull(), letter).when(letter == F.lower(letter), found).otherwise(F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 9)))

    return F.array_join(F.transform(letters(text, groups), read), "")


def simple_cyrillic(text: Column) -> Column:
    """Standard Latin spelling in simple Cyrillic: short adjective endings, no nasal vowels, j as і, which an и before it swallows before a vowel."""
    text = applied(SOFT, text)
    for full, short in (("yj", "ы"), ("ij", "и"), ("YJ", "Ы"), ("IJ", "И")):
        text = F.regexp_replace(text, f"{full}(?![▲\\p{{L}}])", short)
    single = dict(zip(SIMPLE_LATIN_LETTERS, SIMPLE_CYRILLIC))
    table = {k.upper(): v.upper() for k, v in single.items()} | single | {k: "e" for k in LATIN_E}
    groups = SIMPLE_GROUPS | {k[0].upper() + k[1:]: v.upper() for k, v in SIMPLE_GROUPS.items()}
    found = _map(table | groups | SIMPLE_SOFT | {k.upper(): v.upper() for k, v in SIMPLE_SOFT.items()} | {"j": "і", "J": "І"})

    def write(parts: Column) -> Column:
        said = F.transform(parts, lambda x: F.coalesce(F.try_element_at(found, x), x))

        def swallowed(said: Column) -> Column:
            before, after = lambda i: F.lower(F.get(said, i - 1)), lambda i: F.lower(F.get(said, i + 1))
            return F.transform(said, lambda x, i: F.when((F.lower(x) == "і") & (F.lower(F.get(parts, i)) == "j") & (before(i) == "и") & after(i).isin("а", "у", "е", "о"), F.lit("")).otherwise(x))

        return F.array_join(named(said, swallowed), "")

    return named(F.regexp_extract_all(text, F.lit(f"(?s){'|'.join(groups)}|."), F.lit(0)), write)


def single_j(text: Column) -> Column:
    """One j for two."""
    return F.replace(F.replace(text, F.lit("jj"), F.lit("j")), F.lit("JJ"), F.lit("J"))
