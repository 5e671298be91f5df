"""Verb forms: stems by the infinitive's ending, and tables of endings added to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stems import cut, iotated, palatalized

PERSONS = ["1sg", "2sg", "3sg", "1du", "2du", "3du", "1pl", "2pl", "3pl"]
#: Endings in the order of PERSONS; - is none. First and last of the present go to other stems.
PRESENT = "ų š - vě ta ta mo te ųt"
AORIST_VOWEL = "h - - hvě sta sta hmo ste šę"
AORIST_CONSONANT = "h e e hvě sta sta hmo ste šę"
IMPERFECT = "ah aše aše ahvě ašeta ašeta ahmo ašete ahu"
IMPERATIVE = {"2sg": "", "1du": "vě", "2du": "ta", "1pl": "mo", "2pl": "te"}
L_PARTICIPLE = {"masc_sg": "l", "fem_sg": "la", "neut_sg": "lo", "masc_du": "la", "fem_du": "lě", "masc_pl": "li", "fem_pl": "le"}
ACTIVE = {"IV": "ęťi ęťa ęťe ęťi", "": "ųšti ųťa ųťe ųťi"}
PASSIVE = {"IV": "imyj ima imo ime", "j": "emyj ema emo eme", "": "omyj oma omo ome"}
PAST_PASSIVE = "yj a o e"
GENDERS = ["masc", "fem", "neut", "pl"]
#: Auxiliary verbs in the order of PERSONS.
AUXILIARIES = {
    "present": "jesm jesi jest jesvě jesta jesta jesmo jeste sųt",
    "imperfect": "běh běše běše běhvě běšeta běšeta běhmo běšete běhų",
    "future": "bųdų bųdeš bųde bųdevě bųdeta bųdeta bųdemo bųdete bųdųt",
    "conditional": "bim biš bi bivě bita bita bimo bite bišę",
}


def stems(infinitive: Column) -> Column:
    """struct<verb_class, inf_stem, present_stem>: IV for longer iti, III for ovati and ati, II for nųti and nuti, else I."""
    word = F.lower(F.trim(infinitive))
    ends = lambda e: F.endswith(word, F.lit(e))
    row = lambda name, inf, pres: F.struct(F.lit(name).alias("verb_class"), inf.alias("inf_stem"), pres.alias("present_stem"))
    with_ = lambda n, e: F.concat(cut(word, n), F.lit(e))
    return (
        F.when(ends("iti") & (F.length(word) > 5), row("IV", with_(3, "i"), with_(3, "i")))
        .when(ends("ovati"), row("III", with_(5, "ova"), with_(5, "uje")))
        .when(ends("ati"), row("III", with_(3, "a"), with_(3, "aje")))
        .when(ends("nųti"), row("II", with_(4, "nų"), with_(4, "ne")))
        .when(ends("nuti"), row("II", with_(4, "nu"), with_(4, "ne")))
        .otherwise(row("I", cut(word, 2), F.concat(palatalized(cut(word, 2)), F.lit("e"))))
    )


def _rows(tense: str, labels: list[str], texts: list[Column]) -> list[Column]:
    return [F.struct(F.lit(tense).alias("tense"), F.lit(p).alias("person"), t.alias("form")) for p, t in zip(labels, texts, strict=True)]


def verb_forms(verbs: DataFrame, present: str | None = None, l_stem: str | None = None) -> DataFrame:
    """slug, verb_class, tense, person, form: 52 rows for each verb (slug), its plain forms.

    present and l_stem name columns with a stem of their own, null for none.
    """
    s = verbs.withColumn("stem", stems(F.col("slug"))).select(*verbs.columns, "stem.*")
    if present:
        s = s.withColumn("present_stem", F.coalesce(present, "present_stem"))
    s = s.withColumn("part_stem", F.coalesce(l_stem, "inf_stem") if l_stem else F.col("inf_stem"))
    four, inf, pres = F.col("verb_class") == "IV", F.col("inf_stem"), F.col("present_stem")
    base = F.when(F.endswith(pres, F.lit("e")), cut(pres, 1)).otherwise(pres)
    plus = lambda stem, line: [F.concat(stem, F.lit("" if e == "-" else e)) for e in line.split()]
    now = plus(pres, PRESENT)
    now[0] = F.when(four, F.concat(iotated(cut(pres, 1)), F.lit("ų"))).otherwise(F.concat(base, F.lit("ų")))
    now[8] = F.when(four, F.concat(cut(pres, 1), F.lit("ęt"))).otherwise(F.concat(base, F.lit("ųt")))
    vowel = F.col("verb_class").isin("III", "IV") | F.substring(inf, -1, 1).isin("a", "i")
    aorist = [F.when(vowel, a).otherwise(b) for a, b in zip(plus(inf, AORIST_VOWEL), plus(inf, AORIST_CONSONANT))]
    imperfect = plus(F.when(vowel, inf).otherwise(F.concat(inf, F.lit("ě"))), IMPERFECT)
    command = F.when(four, pres).when(F.endswith(base, F.lit("j")), base).otherwise(F.concat(base, F.lit("j")))
    active = [F.when(four, a).otherwise(b) for a, b in zip(plus(iotated(cut(pres, 1)), ACTIVE["IV"]), plus(base, ACTIVE[""]))]
    j = F.endswith(base, F.lit("j"))
    passive = [F.when(four, a).when(j, b).otherwise(c) for a, b, c in zip(plus(cut(pres, 1), PASSIVE["IV"]), plus(base, PASSIVE["j"]), plus(base, PASSIVE[""]))]
    past = (
        F.when(four, F.concat(palatalized(cut(inf, 1)), F.lit("en")))
        .when(F.col("verb_class") == "III", F.concat(inf, F.lit("n")))
        .when(F.col("verb_class") == "II", F.concat(cut(inf, 1), F.lit("en")))
        .when(F.substring(inf, -1, 1).rlike("[aeiouyěęǫ]"), F.concat(inf, F.lit("t")))
        .otherwise(F.concat(palatalized(inf), F.lit("en")))
    )
    rows = _rows("infinitive", ["-"], [F.lower("slug")]) + _rows("present", PERSONS, now) + _rows("aorist", PERSONS, aorist) + _rows("imperfect", PERSONS, imperfect)
    rows += _rows("imperative", list(IMPERATIVE), [F.concat(command, F.lit(e)) for e in IMPERATIVE.values()])
    rows += _rows("l_participle", list(L_PARTICIPLE), [F.concat("part_stem", F.lit(e)) for e in L_PARTICIPLE.values()])
    rows += _rows("active_participle", GENDERS, active) + _rows("passive_participle", GENDERS, passive) + _rows("past_passive", GENDERS, plus(past, PAST_PASSIVE))
    return s.select("slug", "verb_class", F.explode(F.array(*rows)).alias("f")).select("slug", "verb_class", "f.*")


def compound(forms: DataFrame, tense: str, auxiliary: str, person: str = "masc_sg") -> DataFrame:
    """slug, tense, person, form: auxiliary forms with the l-participle, as in the perfect and the conditional."""
    part = forms.filter((F.col("tense") == "l_participle") & (F.col("person") == person)).select("slug", F.col("form").alias("part"))
    rows = [F.struct(F.lit(p).alias("person"), F.concat(F.lit(a + " "), "part").alias("form")) for p, a in zip(PERSONS, AUXILIARIES[auxiliary].split())]
    return part.select("slug", F.lit(tense).alias("tense"), F.explode(F.array(*rows)).alias("f")).select("slug", "tense", "f.*")
