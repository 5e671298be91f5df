"""Keeping stored tables up to date: re-analysis of tokens, imports of relation lists, scoped replacement, TEI documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions import strings as S
from verbatlas.functions import text as X

from . import arrow_tokens


def reanalysed(tokens: DataFrame, analyses: DataFrame) -> DataFrame:
    """tokens with lemma, pos, word_slug, feats, match_count from new analyses (surface, lemma, pos, word_slug, feats, match_count).

    Punctuation (word_index -1) is PUNCT and its own lemma; a word without an analysis is X and its own lemma. Both lose
    slug and features but keep their old match_count. Analyses are one per surface, so the join is on a vocabulary.
    """
    new = analyses.select(F.col("surface").alias("k"), *[F.col(c).alias(f"new_{c}") for c in ("lemma", "pos", "word_slug", "feats", "match_count")])
    rows = tokens.join(new, tokens["surface"] == new["k"], "left").drop("k")
    word, found = F.col("word_index") != -1, F.col("new_lemma").isNotNull()
    ok = word & found
    changed = {
        "lemma": F.when(ok, F.col("new_lemma")).otherwise(F.col("surface")),
        "pos": F.when(~word, "PUNCT").when(found, F.col("new_pos")).otherwise("X"),
        "word_slug": F.when(ok, F.col("new_word_slug")),
        "feats": F.when(ok, F.col("new_feats")).otherwise(""),
        "match_count": F.when(ok, F.coalesce("new_match_count", F.lit(0))).otherwise(F.col("match_count")),
    }
    return rows.withColumns(changed).select(*tokens.columns)


def inspected(tokens: DataFrame) -> DataFrame:
    """A stored segment as it is shown: surface, lemma, pos, whether it is punctuation, and whether its word is known."""
    return tokens.select("sentence_no", "token_index", "surface", "lemma", "pos", (F.col("word_index") == -1).alias("is_punctuation"), F.col("word_slug").isNotNull().alias("recognised"))


#: Lists of an import file: name, relation, and which way it runs (both, from the entry, to the entry).
RELATION_LISTS = [
    ("synonyms", "synonym", "both"),
    ("antonyms", "antonym", "both"),
    ("hypernyms", "hypernymy", "from"),
    ("hyponyms", "hypernymy", "to"),
    ("meronyms", "meronymy", "to"),
    ("holonyms", "meronymy", "from"),
    ("related", "related", "both"),
    ("posSynonyms", "pos_synonym", "both"),
    ("instanceOfClasses", "instance_of", "from"),
    ("hasInstances", "instance_of", "to"),
    ("derivationTargets", "derivation", "from"),
    ("derivationSources", "derivation", "to"),
    ("premises", "entailment", "to"),
    ("conclusions", "entailment", "from"),
    ("causes", "causation", "to"),
    ("effects", "causation", "from"),
]


def relations_of(entries: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct edges (source, target, type) from entries (meaning_id, and any of the lists as array<string>).

    words: (value, meaning_id), the last id of a value counts. Unknown words and self-loops are left out; edges both ways run from
    the smaller id. All lists become rows of one table and meet the words in one join.
    """
    present = [r for r in RELATION_LISTS if r[0] in entries.columns]
    item = lambda name, kind, way: F.transform(
        F.coalesce(name, F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(kind).alias("type"), F.lit(way).alias("way"))
    )
    rows = entries.select("meaning_id", F.explode(reduce(F.concat, [item(*r) for r in present])).alias("r")).select("meaning_id", "r.*")
    ids = words.groupBy(F.col("value").alias("word")).agg(F.max("meaning_id").alias("other"))
    met = rows.join(ids, "word").filter("meaning_id <> other")
    a, b, way = F.col("meaning_id"), F.col("other"), F.col("way")
    source = F.when(way == "both", F.least(a, b)).when(way == "from", a).otherwise(b)
    target = F.when(way == "both", F.greatest(a, b)).when(way == "from", b).otherwise(a)
    return met.select(source.alias("source"), target.alias("target"), "type").distinct()


def replaced(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Stored rows of other origins, and all new rows under this one."""
    others = stored.filter(~F.col("origin").eqNullSafe(F.lit(source)))
    return others.unionByName(new.withColumn("origin", F.lit(source)))


#: The parts of a TEI document around its title, its author and its body.
TEI_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0">\n  <teiHeader>\n    <fileDesc>\n      <titleStmt>\n        <title>',
    "</title>\n",
    "      </titleStmt>\n    </fileDesc>\n  </teiHeader>\n  <text>\n    <body>\n",
)
TEI_AUTHOR = ("        <author>", "</author>\n")
TEI_END = "\n    </body>\n  </text>\n</TEI>\n"


def tei_documents(sentences: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, xml: whole TEI documents from sentences (doc_id, segment, sentence_no, xml) and titles (doc_id, title, author).

    Sentences are put in order inside their segment, segments inside their document.
    """
    line = lambda part, body: F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s[body]), "\n")
    per = sentences.groupBy("doc_id", "segment").agg(line(F.struct("sentence_no", F.concat(F.lit("        "), F.col("xml")).alias("xml")), "xml").alias("body"))
    block = F.concat(F.lit('      <div type="segment" n="'), (F.col("segment") + 1).cast("string"), F.lit('">\n'), F.col("body"), F.lit("\n      </div>"))
    bodies = per.groupBy("doc_id").agg(line(F.struct("segment", block.alias("xml")), "xml").alias("body"))
    return titles.join(bodies, "doc_id").select("doc_id", _whole(F.col("body")).alias("xml"))


def _whole(body: Column) -> Column:
    """A TEI document of its body and the columns title and author."""
    text = lambda c: S.applied(S.XML, F.coalesce(F.col(c), F.lit("")))
    author = F.when(F.col("author").isNotNull(), F.concat(F.lit(TEI_AUTHOR[0]), text("author"), F.lit(TEI_AUTHOR[1]))).otherwise("")
    head = F.concat(F.lit(TEI_HEAD[0]), text("title"), F.lit(TEI_HEAD[1]), author, F.lit(TEI_HEAD[2]))
    return F.concat(head, body, F.lit(TEI_END))


def tei_lines(docs: DataFrame, spread: DataFrame, known: DataFrame, *keep: str) -> DataFrame:
    """doc_id, any columns to keep, lines: array<struct<segment, xml>>, the TEI sentences of each document in order, for documents with a token.

    docs and spread: the same documents (doc_id, text), the latter over all cores; known: slug. The distinct words of each document meet the known ones,
    and those found meet the texts by doc_id, so a text is shuffled once and no token is. An element is made once for each surface of a document.
    """
    slugs = known.select(F.col("slug").alias("k"))
    # documents without an id are a document like others; a number of parts that is given keeps the costly work on all cores
    found = arrow_tokens.words(spread).join(slugs, F.lower("surface") == F.col("k"))
    sure = found.groupBy(F.struct("doc_id").alias("own")).agg(F.collect_list("surface").alias("sure"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.struct("doc_id").alias("own"), "doc_id", "text", *keep).repartition(parts, "own").join(sure, "own", "left")
    rows = arrow_tokens.indexed(own, "sure", *keep).filter(F.size("sentences") > 0)

    def element(f: Column) -> Column:
        surface = f["surface"]
        tag = lambda a: S.tei_token(surface, a["lemma"], a["pos"], a["feats"], a["pos"] != "PUNCT", f["known"])
        return X.named(X.analysis(surface), tag)

    def lines(elements: Column) -> Column:
        body = lambda s: F.array_join(F.transform(s["tokens"], lambda i: F.get(elements, i)), " ")
        line = lambda s, n: F.concat(F.lit('<s n="'), (n + 1).cast("string"), F.lit('">'), body(s), F.lit("</s>"))
        return F.transform("sentences", lambda s, n: F.struct(s["segment"].alias("segment"), line(s, n).alias("xml")))

    return rows.select("doc_id", *keep, X.named(F.transform("forms", element), lines).alias("lines"))


def tei_texts(lines: DataFrame) -> DataFrame:
    """doc_id, xml: whole TEI documents from rows (doc_id, title, author, lines), each put together in its row."""
    open_ = lambda s: F.concat(F.lit('      <div type="segment" n="'), (s["segment"] + 1).cast("string"), F.lit('">\n'))
    close = "\n      </div>"

    def body(all_: Column) -> Column:
        before = lambda s, i: F.when(i == 0, open_(s)).when(F.get(all_, i - 1)["segment"] != s["segment"], F.concat(F.lit(close + "\n"), open_(s))).otherwise("\n")
        return F.array_join(F.transform(all_, lambda s, i: F.concat(before(s, i), F.lit("        "), s["xml"])), "")

    return lines.select("doc_id", _whole(F.concat(X.named(F.col("lines"), body), F.lit(close))).alias("xml"))
