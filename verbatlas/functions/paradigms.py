"""All forms of all parts of speech, and the analysis of words by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import closed_classes, stems, verbs
from .strings import NORMAL_FORM, applied


def forms_of(lexemes: DataFrame) -> DataFrame:
    """slug, pos, feats, form of every lexeme (slug, pos), by its part of speech.

    Nouns, adjectives, verbs and adverbs are inflected by rule, pronouns and the numerals two to four by their tables, numerals in ь as i-stems;
    any other lexeme has its slug as its only form. feats names the cell: its values, joined by spaces.
    """
    spark, slug = lexemes.sparkSession, F.col("slug")
    of = lambda *pos: lexemes.filter(F.col("pos").isin(*pos)).select("slug")
    row = lambda df, pos, *feats: df.select("slug", F.lit(pos).alias("pos"), F.concat_ws(" ", *feats).alias("feats"), "form")
    nouns = of("NOUN", "PROPN").select("slug", stems.default_stem_type(slug).alias("stem_type"), F.lit("A").alias("paradigm"))
    soft = F.when(F.endswith(slug, F.lit("i")), "soft").otherwise("hard")
    adjectives = of("ADJ", "DET").select("slug", soft.alias("kind"), F.lit("A").alias("paradigm"))
    closed = lambda table: table.withColumnRenamed("lemma", "slug")
    small = closed(closed_classes.small_numerals(spark)).join(of("NUM"), "slug", "left_semi")
    return (
        row(stems.noun_forms(nouns, stems.endings(spark)), "NOUN", "number", "case")
        .unionByName(row(stems.adjective_forms(adjectives, stems.adjective_endings(spark)), "ADJ", "number", "gender", "case"))
        .unionByName(row(verbs.verb_forms(of("VERB", "AUX")), "VERB", "tense", "person"))
        .unionByName(row(stems.adverb_forms(of("ADV")), "ADV", "degree"))
        .unionByName(row(closed(closed_classes.pronouns(spark)).join(of("PRON"), "slug", "left_semi"), "PRON", "number", "gender", "case"))
        .unionByName(row(small, "NUM", "gender", "case"))
        .unionByName(row(closed_classes.five_to_ten(of("NUM").filter(F.endswith(slug, F.lit("ь")))), "NUM", "case"))
        .unionByName(
            lexemes.filter(~F.coalesce(F.col("pos"), F.lit("")).isin("NOUN", "PROPN", "ADJ", "DET", "VERB", "AUX", "ADV", "PRON", "NUM"))
            .select("slug", F.coalesce("pos", F.lit("X")).alias("pos"), F.lit("").alias("feats"), slug.alias("form"))
        )
    )


def analyses(words: DataFrame, forms: DataFrame) -> DataFrame:
    """word, pos, lemma, match_count: for each part of speech whose forms have the word, the smallest lexeme and the number of cells.

    An equi-join on the normalised form: forms are made once for the lexicon, and words are a vocabulary.
    """
    key = lambda c: applied(NORMAL_FORM, F.lower(c))
    known = forms.select("slug", "pos", key(F.col("form")).alias("key"))
    return (
        words.select("word", key(F.col("word")).alias("key"))
        .join(known, "key")
        .groupBy("word", "pos")
        .agg(F.min("slug").alias("lemma"), F.count("*").alias("match_count"))
    )
