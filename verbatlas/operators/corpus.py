"""Token tables and corpus statistics over a DataFrame of documents (doc_id, text, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions import text as X

from .ordering import falling, numbered, rising


def segment_table(docs: DataFrame) -> DataFrame:
    """doc_id, segment, body."""
    return docs.select("doc_id", F.posexplode(X.segments(F.col("text"))).alias("segment", "body"))


def sentence_table(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_no, segment, sentence."""
    rows = docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "s"))
    return rows.select("doc_id", "sentence_no", "s.segment", "s.sentence")


def token_table(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, any columns to keep, token_index, segment, sentence_no, surface; a narrow stage, nothing is shuffled."""
    rows = docs.select("doc_id", *keep, F.posexplode(X.tokens(F.col("text"))).alias("token_index", "t"))
    return rows.select("doc_id", *keep, "token_index", "t.segment", "t.sentence_no", "t.surface")


def positions(docs: DataFrame, *keep: str) -> DataFrame:
    """The token table with word_index: the number of words before in the document, -1 for punctuation.

    Words and the rest are numbered as two arrays in the document's row, so nothing is shuffled or sorted.
    """

    def numbered(tokens: Column) -> Column:
        placed = F.transform(tokens, lambda t, i: F.struct(i.alias("token_index"), t["segment"], t["sentence_no"], t["surface"], X.is_word(t["surface"]).alias("word")))

        def both(p: Column) -> Column:
            words = F.transform(F.filter(p, lambda t: t["word"]), lambda t, i: F.struct(t.alias("t"), i.alias("word_index")))
            others = F.transform(F.filter(p, lambda t: ~t["word"]), lambda t: F.struct(t.alias("t"), F.lit(-1).alias("word_index")))
            return F.concat(words, others)

        return X.named(placed, both)

    rows = docs.select("doc_id", *keep, F.explode(X.named(X.tokens(F.col("text")), numbered)).alias("n"))
    return rows.select("doc_id", *keep, "n.t.token_index", "n.t.segment", "n.t.sentence_no", "n.t.surface", "n.word_index")


def tagged(tokens: DataFrame) -> DataFrame:
    """Add lemma, pos, feats by suffix."""
    return tokens.withColumn("analysis", X.analysis(F.col("surface"))).select(*tokens.columns, "analysis.*")


def lexicon(texts: DataFrame) -> DataFrame:
    """Known words: the distinct lower-case words of a text column."""
    words = texts.select(F.explode(X.surfaces(F.col("text"))).alias("w")).filter(X.is_word(F.col("w")))
    return words.select(F.lower("w").alias("slug")).distinct()


def word_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Counts of lower-case words, by other columns if given: a partial aggregate on the map side, then one shuffle."""
    tokens = docs.select(*by, F.explode(X.surfaces(F.col("text"))).alias("surface"))
    words = tokens.filter(X.is_word(F.col("surface"))).select(*by, F.lower("surface").alias("slug"))
    return words.groupBy("slug", *by).agg(F.count("*").alias("freq"))


def ranked(counts: DataFrame, amount: str = "freq", key: str = "slug", name: str = "freq_rank") -> DataFrame:
    """Add the 1-based position by falling amount, ties by key; null amounts, then null keys come last."""
    return numbered(counts, [falling(amount), rising(key)], name)


def frequencies(docs: DataFrame, known: DataFrame) -> DataFrame:
    """slug, freq, per_million, freq_rank, hapax of the known words that occur.

    Words are counted before they meet the lexicon, so what is joined is a vocabulary, not a corpus; the counts are made once and written
    with their ranks.
    """
    out = ranked(word_counts(docs).join(known, "slug", "left_semi"))
    total = out.agg(F.sum("freq").alias("total"))
    out = out.join(F.broadcast(total))
    return out.select(
        "slug", "freq", X.rounded(F.col("freq") / F.col("total") * 1e6, 4).alias("per_million"), "freq_rank", (F.col("freq") == 1).alias("hapax")
    )


def zipf_alpha(ranks: DataFrame) -> DataFrame:
    """Minus the slope of ln freq over ln rank, over words that occur twice or more; null under two points."""
    points = ranks.filter("freq >= 2")
    slope = -F.regr_slope(F.log("freq"), F.log("freq_rank"))
    enough = F.when((F.count("*") >= 2) & (F.min("freq_rank") < F.max("freq_rank")), slope)
    return points.agg(F.round(enough, 6).alias("alpha"), F.count("*").alias("points"))


def dispersion(by_genre: DataFrame) -> DataFrame:
    """slug, freq, genres, d: Juilland's D over (slug, genre, freq).

    Deviations are summed over the genres in which a word occurs only, while the mean and the degrees
    of freedom take all genres; D lies between 0.01 and 1 and has two decimals.
    """
    k = by_genre.agg(F.countDistinct("genre").alias("k"))
    per = by_genre.groupBy("slug").agg(F.sum("freq").alias("freq"), F.sum(F.col("freq") * F.col("freq")).alias("squares"), F.count("*").alias("genres"))
    per = per.join(F.broadcast(k))
    mean = F.col("freq") / F.col("k")
    deviation = F.col("squares") - 2 * mean * F.col("freq") + F.col("genres") * mean * mean
    spread = F.sqrt(F.greatest(deviation, F.lit(0.0)) / (F.col("k") - 1)) / mean
    d = F.greatest(F.lit(0.01), F.least(F.lit(1.0), 1 - spread / F.sqrt(F.col("k") - 1)))
    value = F.when((F.col("k") <= 1) | (F.col("freq") == 0), F.lit(0.01)).otherwise(X.rounded(d, 2))
    return per.select("slug", "freq", "genres", value.alias("d"))


#: Languages that count for intelligibility, and rank bounds of the tiers.
SLAVIC = ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "mk", "bg"]
TIERS = [(500, "A1"), (1500, "A2"), (3500, "B1"), (6500, "B2"), (11500, "C1")]


def k_slav(marks):
    """1 + 0.3 * the share of + among marks like `ru+ pl~` of Slavic languages; 1.3 where there are none."""
    listed = F.filter(F.split(marks, " "), lambda p: F.substring(p, 1, 2).isin(SLAVIC))
    plus = F.size(F.filter(listed, lambda p: F.substring(p, F.lit(3), F.length(p)) == "+"))
    return F.when(marks.isNull() | (F.size(listed) == 0), F.lit(1.3)).otherwise(1.0 + 0.3 * (plus / F.size(listed)))


def usage_levels(by_genre: DataFrame, marks: DataFrame) -> DataFrame:
    """slug, ipm, d, usage_score, cefr_level; marks: (slug, intelligibility)."""
    spread = dispersion(by_genre)
    total = by_genre.agg(F.sum("freq").alias("total"))
    scored = spread.join(marks, "slug", "left").join(F.broadcast(total))
    ipm = F.col("freq") / F.col("total") * 1e6
    score = X.rounded(ipm * F.col("d") * k_slav(F.col("intelligibility")), 2)
    order = ranked(scored.select("slug", X.rounded(ipm, 2).alias("ipm"), "d", score.alias("usage_score")), "usage_score", "slug", "place")
    tier = F.lit("C2")
    for bound, name in reversed(TIERS):
        tier = F.when(F.col("place") <= bound, F.lit(name)).otherwise(tier)
    return order.select("slug", "ipm", "d", "usage_score", F.when(F.col("usage_score") == 0, "C2").otherwise(tier).alias("cefr_level"))


def document_metrics(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, tokens, words, sentences, oov_rate, punct_density, space_words.

    A word is out of vocabulary if the tagger says X and it is not known. A document is read once: its counts are made in
    its row, and only the words tagged X become rows, of which the first carries the counts. Rows of one doc_id are one document.
    """
    words = lambda t: F.filter(t, lambda x: X.is_word(x))
    tokens = F.transform(X.tokens(F.col("text")), lambda t: F.struct(t["surface"].alias("surface"), t["sentence_no"].alias("sentence_no")))

    def counted(t: Column) -> Column:
        def of(w: Column) -> Column:
            unsure = F.transform(F.filter(w, lambda x: X.pos_of(x) == "X"), lambda x: F.lower(x))
            last = F.coalesce(F.get(t, F.size(t) - 1)["sentence_no"] + 1, F.lit(0))
            return F.struct(F.size(t).alias("tokens"), F.size(w).alias("words"), last.alias("sentences"), unsure.alias("unsure"))

        return X.named(words(t["surface"]), of)

    spaced = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = docs.select("doc_id", X.named(tokens, counted).alias("c"), spaced.alias("space_words"))
    rows = rows.select("doc_id", "c.tokens", "c.words", "c.sentences", "space_words", F.posexplode_outer("c.unsure").alias("at", "slug"))
    return _rates(rows.withColumn("n", F.lit(1)), known)


def metrics_by_forms(counted: DataFrame, known: DataFrame) -> DataFrame:
    """The same from `arrow_tokens.counts`: a document's distinct words are tagged, and become rows with how often they stand there."""
    unsure = F.filter("forms", lambda f: X.pos_of(f["surface"]) == "X")
    rows = counted.select("doc_id", "tokens", "words", "sentences", "space_words", F.posexplode_outer(unsure).alias("at", "f"))
    return _rates(rows.select("*", F.lower("f.surface").alias("slug"), "f.n"), known)


def _rates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Metrics from rows (doc_id, its counts, at, slug, n), one for each word tagged X, or one without a slug; only those with at 0 or null add counts."""
    flagged = known.withColumn("known", F.lit(True))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    once = lambda c: F.coalesce(F.sum(F.when(first, F.greatest(F.col(c), F.lit(0)))), F.lit(0)).cast("long").alias(c)
    oov = F.coalesce(F.sum(F.when(F.col("slug").isNotNull() & F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("oov")
    out = rows.join(flagged, "slug", "left").groupBy("doc_id").agg(*map(once, ("tokens", "words", "sentences", "space_words")), oov)
    percent = lambda a, b: F.when(b > 0, F.floor(100 * a / b + 0.5)).otherwise(0)
    words_, all_ = F.col("words"), F.col("tokens")
    return out.select(
        "doc_id", "tokens", "words", "sentences", percent(F.col("oov"), words_).alias("oov_rate"), percent(all_ - words_, all_).alias("punct_density"), "space_words"
    )


def coverage(counts: DataFrame, known: DataFrame) -> DataFrame:
    """One row: words, matched words, coverage in percent, distinct words, from (slug, freq)."""
    flagged = counts.join(known.withColumn("known", F.lit(True)), "slug", "left")
    matched = F.sum(F.when(F.col("known"), F.col("freq")).otherwise(0))
    total = F.coalesce(F.sum("freq"), F.lit(0))
    share = F.when(total > 0, X.rounded(matched / total * 100, 2)).otherwise(0.0)
    return flagged.agg(total.alias("words"), F.coalesce(matched, F.lit(0)).alias("matched"), share.alias("coverage"), F.count("*").alias("types"))


def write_back(lexemes: DataFrame, stats: DataFrame) -> DataFrame:
    """lexemes (slug) with freq, per_million, freq_rank, hapax; 0, 0, null and false where a lexeme does not occur."""
    joined = lexemes.join(stats, "slug", "left")
    return joined.select(
        "slug",
        F.coalesce("freq", F.lit(0)).alias("freq"),
        F.coalesce("per_million", F.lit(0.0)).alias("per_million"),
        "freq_rank",
        F.coalesce("hapax", F.lit(False)).alias("hapax"),
    )
