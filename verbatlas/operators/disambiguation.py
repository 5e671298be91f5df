"""Choosing one analysis of a word form: case government of the word before it, else the most frequent one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as X

#: Cases that a preposition governs, the first that is available wins.
GOVERNMENT = {
    "v": ["loc", "acc"],
    "vo": ["loc", "acc"],
    "na": ["loc", "acc"],
    "o": ["loc", "acc"],
    "ob": ["loc", "acc"],
    "k": ["dat"],
    "ko": ["dat"],
    "bez": ["gen"],
    "iz": ["gen"],
    "do": ["gen"],
    "ot": ["gen"],
    "u": ["gen"],
    "s": ["ins", "gen"],
    "so": ["ins", "gen"],
    "za": ["ins", "acc"],
    "nad": ["ins"],
    "pod": ["ins", "acc"],
    "pred": ["ins", "acc"],
    "medzu": ["ins", "acc"],
    "po": ["loc", "dat", "acc"],
    "pro": ["acc"],
    "pri": ["loc"],
    "mimo": ["gen"],
    "protiv": ["gen"],
    "kromě": ["gen"],
    "radi": ["gen"],
    "dlja": ["gen"],
}
#: Prior weights of cases; other cases weigh 0.1, a form without a case 1.
WEIGHTS = {"nom": 0.35, "acc": 0.35, "gen": 0.15, "dat": 0.05, "loc": 0.05, "ins": 0.05, "voc": 0.01}


def government(spark: SparkSession) -> DataFrame:
    """left_word, case, preference: one row for each governed case."""
    rows = [(w, c, i) for w, cases in GOVERNMENT.items() for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "left_word string, case string, preference int")


def prior(case):
    """1000 times the weight of a case, rounded."""
    chain = F.when(case.isNull(), F.lit(1000))
    for name, weight in WEIGHTS.items():
        chain = chain.when(case == name, F.lit(int(1000 * weight + 0.5)))
    return chain.otherwise(100)


def disambiguated(contexts: DataFrame, options: DataFrame, rules: DataFrame) -> DataFrame:
    """contexts (left_word, form, any others) with slug and case of the chosen option; null without one.

    options: (form, slug, case, freq). Governed cases come first in the preposition's order, then the rest by
    falling freq, ties by case and slug. Options are looked up once per distinct pair of words.
    """
    pairs = contexts.select("left_word", "form").distinct()
    rated = pairs.join(options, "form").join(rules, ["left_word", "case"], "left")
    best = rated.groupBy("left_word", "form").agg(
        F.min(F.struct(F.coalesce("preference", F.lit(99)).alias("p"), (-F.col("freq")).alias("f"), "case", "slug")).alias("o")
    )
    chosen = best.select(F.col("left_word").alias("l"), F.col("form").alias("f"), "o.slug", "o.case")
    return contexts.join(chosen, contexts["left_word"].eqNullSafe(chosen["l"]) & (contexts["form"] == chosen["f"]), "left").drop("l", "f")


def neighbours(docs: DataFrame, left_words: list[str] | None = None) -> DataFrame:
    """left_word, form, n: how often a lower-case word follows another token in its sentence; only after the given words, if there are any.

    Words that do not follow one of the given words are left out in their sentence's array, before any pair is made.
    """
    sentences = F.transform(X.sentences(F.col("text")), lambda s: X.surfaces(s["sentence"]))
    if left_words is None:
        pair = lambda s: F.transform(s, lambda t, i: F.struct(F.when(i > 0, F.get(s, i - 1)).alias("left_word"), t.alias("form")))
    else:

        def pair(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.lower(F.get(s, i)).isin(*left_words) & (i < F.size(s) - 1))
            return F.transform(at, lambda i: F.struct(F.get(s, i).alias("left_word"), F.get(s, i + 1).alias("form")))

    # a sentence is cut into its tokens once: the pairs are made of a variable
    rows = docs.select(F.explode(F.flatten(F.transform(sentences, pair))).alias("p")).select(F.lower("p.left_word").alias("left_word"), F.lower("p.form").alias("form"))
    return rows.filter(X.is_word(F.col("form"))).groupBy("left_word", "form").agg(F.count("*").alias("n"))


def cold_start(forms: DataFrame) -> DataFrame:
    """Options with prior counts from (form, slug, case)."""
    return forms.select("form", "slug", "case", prior(F.col("case")).alias("freq"))


def hot_update(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """Stored options (form, slug, case, freq) with the counts of the corpus in their place.

    A form that the corpus has keeps its uncounted options with freq 1; a form that it doesn't have stays
    as it is; options that only the corpus knows are added.
    """
    seen = counted.select("form").distinct().withColumn("seen", F.lit(True))
    s, c = stored.alias("s"), counted.alias("c")
    same = (F.col("s.form") == F.col("c.form")) & (F.col("s.slug") == F.col("c.slug")) & F.col("s.case").eqNullSafe(F.col("c.case"))
    merged = s.join(c, same, "full_outer").select(
        F.coalesce("s.form", "c.form").alias("form"),
        F.coalesce("s.slug", "c.slug").alias("slug"),
        F.coalesce("s.case", "c.case").alias("case"),
        F.col("s.freq").alias("old"),
        F.col("c.freq").alias("new"),
    )
    out = merged.join(seen, "form", "left")
    freq = F.when(F.col("seen"), F.coalesce("new", F.lit(1))).otherwise(F.col("old"))
    place = Window.partitionBy("form").orderBy(F.desc("freq"), F.col("case").asc_nulls_first(), "slug")
    return out.select("form", "slug", "case", freq.cast("long").alias("freq")).withColumn("place", F.row_number().over(place))
