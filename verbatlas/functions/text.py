"""Column functions for segments, sentences, tokens and the suffix tagger.

All of them are built-in expressions on one row, so a document becomes tokens without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a word beside ASCII letters, digits and underscore.
LETTERS = "а-яёѕєіјљњћџѫѭѣžčšěŽČŠĚ"
WORD_CLASS = r"\w" + LETTERS
TOKEN = rf"(?iu)[{WORD_CLASS}]+|[^\s{WORD_CLASS}]+"
SEGMENT_BREAK = r"\n\s*\n"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once: inside body it is a variable, which the optimizer never writes out again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def segments(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, SEGMENT_BREAK), trimmed), lambda s: s != "")


def sentences(text: Column) -> Column:
    """array<struct<segment, sentence>>: sentences of all segments in order."""

    def of(segment: Column, number: Column) -> Column:
        parts = F.filter(F.transform(F.split(segment, SENTENCE_BREAK), trimmed), lambda s: s != "")
        return F.transform(parts, lambda s: F.struct(number.alias("segment"), s.alias("sentence")))

    return F.flatten(F.transform(segments(text), of))


def surfaces(sentence: Column) -> Column:
    """The tokens of a sentence: runs of word characters, or of other characters that are no white space."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """array<struct<segment, sentence_no, place, size, surface>>: a token's place in the array is its index in the document.

    place is its index in the sentence, size the sentence's number of tokens. A sentence is cut into tokens once.
    """

    def of(sentence: Column, number: Column) -> Column:
        def rows(parts: Column) -> Column:
            return F.transform(
                parts,
                lambda t, i: F.struct(sentence["segment"].alias("segment"), number.alias("sentence_no"), i.alias("place"), F.size(parts).alias("size"), t.alias("surface")),
            )

        return named(surfaces(sentence["sentence"]), rows)

    return F.flatten(F.transform(sentences(text), of))


def is_word(surface: Column) -> Column:
    """Whether there is a word character."""
    return surface.rlike(rf"(?iu)[{WORD_CLASS}]")


def clean(surface: Column) -> Column:
    """Lower case, without what is no letter of the tagger's alphabet (digits go, too)."""
    return F.regexp_replace(F.lower(surface), r"[^a-zčěšžıſа-яёѕєіјљњћџѫѭѣ\x{1C80}-\x{1C87}]", "")


#: Fixed values, first fit wins: ending, least length, part of speech, letters cut for the lemma, features.
SUFFIX_RULES = [
    ("om", 0, "NOUN", 2, "case=ins|number=sg"),
    ("em", 0, "NOUN", 2, "case=ins|number=sg"),
    ("la", 4, "VERB", 1, "tense=past|gender=fem|number=sg|verbForm=part"),
    ("m", 3, "VERB", 1, "person=1|number=sg|tense=pres|verbForm=fin"),
    ("a", 2, "NOUN", 1, "gender=fem|number=sg"),
    ("u", 3, "NOUN", 1, "case=dat|number=sg"),
    ("y", 0, "ADJ", 0, "gender=masc|number=sg"),
    ("i", 0, "ADJ", 0, "gender=masc|number=sg"),
    ("o", 0, "ADV", 0, "degree=pos"),
    ("e", 0, "ADV", 0, "degree=pos"),
]


def analysis(surface: Column) -> Column:
    """struct<lemma, pos, feats> by ordered suffix rules: a lemma is the word without a few letters, if any are left."""

    def row(lemma: Column, pos: str, feats: str) -> Column:
        return F.struct(lemma.alias("lemma"), F.lit(pos).alias("pos"), F.lit(feats).alias("feats"))

    def of(word: Column) -> Column:
        chain = F.when(word == "", row(surface, "X", ""))
        for ending, least, pos, cut, feats in SUFFIX_RULES:
            lemma = F.when(F.length(word) > cut, F.substring(word, F.lit(1), F.length(word) - cut)).otherwise(word) if cut else word
            chain = chain.when(F.endswith(word, F.lit(ending)) & (F.length(word) >= least), row(lemma, pos, feats))
        return chain.otherwise(row(word, "X", ""))

    return F.when(is_word(surface), named(clean(surface), of)).otherwise(row(surface, "PUNCT", ""))


def pos_of(surface: Column) -> Column:
    return analysis(surface)["pos"]


def lemma_of(surface: Column) -> Column:
    return analysis(surface)["lemma"]


def may_have_lemma(surface: Column, lemma: str) -> Column:
    """A cheap test that every surface with the lemma passes: a lemma is the surface or the start of its letters in lower case, so it holds no other ones."""
    low = F.lower(surface)
    return reduce(lambda x, y: x & y, (F.contains(low, F.lit(c)) for c in sorted(set(lemma.lower()))), F.lit(True))


def feats_of(surface: Column) -> Column:
    """The features as key=value joined by a bar."""
    return analysis(surface)["feats"]


def rounded(value: Column, places: int) -> Column:
    """Half up, by floor, which says the same in every engine."""
    return F.floor(value * 10**places + 0.5) / 10**places
