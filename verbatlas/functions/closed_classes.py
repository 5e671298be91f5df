"""Pronouns and numerals: small closed classes as literal tables, and i-stem numerals by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stems import ADJECTIVE_TABLE, CASES, NOUN_ENDINGS, NUMBERS
from .strings import SOFT, applied

#: Personal pronouns by number in the order of CASES; a short form stands after a slash.
PERSONAL = {
    "ja": ["ja mene/mę mene/mę meně/mi mьnojǫ mьně ja", "my nasъ/ny nasъ namъ nami nasъ my", "vě na naju nama nama naju vě"],
    "ty": ["ty tebe/tę tebe/tę tobě/ti tobojǫ tobě ty", "vy vasъ/vy vasъ vamъ vami vasъ vy", "va va vaju vama vama vaju va"],
}
#: Interrogative pronouns in the order of CASES.
INTERROGATIVE = {"kto": "kto kogo kogo komu kěmь komь kto", "čto": "čto čto česo čemu čimь čemь čto"}
#: Endings of the numerals two to four and of collectives in the order of CASES.
SMALL_NUMBERS = {"dva": ("dv", "a a oju yma yma oju a"), "tri": ("tr", "e i ej em emi eh e"), "četyri": ("četyr", "e i ej em emi eh e")}
COLLECTIVE = {"oje": "e e ih im imi ih e", "ero": "o o yh ym ymi yh o"}
GENDERS = ["MASC", "FEM", "NEUT"]


def pronoun_rows() -> list[tuple]:
    """(lemma, number, gender, case, form, short) of all forms of ja, ty, kto, čto, on; gender only where it matters."""
    rows = []
    for lemma, lines in PERSONAL.items():
        for number, line in zip(NUMBERS, lines):
            for case, cell in zip(CASES, line.split()):
                full, _, short = cell.partition("/")
                rows.append((lemma, number, None, case, full, short or None))
    rows += [(lemma, None, None, c, f, None) for lemma, line in INTERROGATIVE.items() for c, f in zip(CASES, line.split())]
    direct = {"MASC": "on", "FEM": "ona", "NEUT": "ono"}
    for (kind, number, gender), line in ADJECTIVE_TABLE.items():
        if kind == "soft":
            for case, ending in zip(CASES, line.split()):
                own = case == "nominative" or (case == "accusative" and gender == "NEUT")
                rows.append(("on", number, gender, case, direct[gender] if own else "j" + ending, None))
    return rows


def pronouns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pronoun_rows(), "lemma string, number string, gender string, `case` string, form string, short string")


def numeral_rows() -> list[tuple]:
    """(lemma, gender, case, form) of two, three and four; two has ě for a in the feminine and neuter."""
    rows = []
    for lemma, (base, line) in SMALL_NUMBERS.items():
        for gender in GENDERS:
            for case, ending in zip(CASES, line.split()):
                soft = lemma == "dva" and ending == "a" and gender != "MASC"
                rows.append((lemma, gender, case, base + ("ě" if soft else ending)))
    return rows


def small_numerals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(numeral_rows(), "lemma string, gender string, `case` string, form string")


def _declined(rows: DataFrame, base, line: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("case"), F.lit(e).alias("ending")) for c, e in zip(CASES, line.split())])
    forms = rows.select("slug", base.alias("base"), F.explode(cells).alias("c"))
    return forms.select("slug", F.col("c.case").alias("case"), F.concat("base", "c.ending").alias("form"))


def five_to_ten(numerals: DataFrame) -> DataFrame:
    """slug, case, form: numerals decline like i-stems in the singular, without doubled softness."""
    out = _declined(numerals, F.regexp_replace(F.lower("slug"), "[ьъ]$", ""), NOUN_ENDINGS["i_basis"][0])
    return out.withColumn("form", F.replace(applied(SOFT, F.col("form")), F.lit("jj"), F.lit("j")))


def collectives(numerals: DataFrame, kind: str) -> DataFrame:
    """slug, case, form of collective numerals in -oje or -ero."""
    lower = F.lower("slug")
    base = F.concat(F.substring(lower, F.lit(1), F.length(lower) - 2), F.lit("j")) if kind == "oje" else F.substring(lower, F.lit(1), F.length(lower) - 1)
    return _declined(numerals, base, COLLECTIVE[kind])
