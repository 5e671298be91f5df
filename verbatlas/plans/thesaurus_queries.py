"""Queries on thesauri, notes and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.functions import stems as M
from verbatlas.operators import thesaurus
from verbatlas.sources import tables

from .corpus_queries import LEX, _lexicon
from .registry import query, table
from .text_queries import _stem_sql, _text


@query(
    """WITH RECURSIVE s AS (SELECT 'w' || p_partkey AS word, p_partkey AS synset, [p_partkey // 2, (p_partkey * 7 + 1) % 50] AS above FROM part
      UNION ALL SELECT 'w' || p_partkey, p_partkey + 1, [p_partkey // 3] FROM part WHERE p_size % 2 = 1),
    edges AS (SELECT DISTINCT synset AS child, unnest(above) AS parent FROM s),
    walk AS (SELECT DISTINCT word, synset AS node, 0 AS distance FROM s UNION SELECT word, parent, distance + 1 FROM walk JOIN edges ON child = node WHERE distance < 4)
    SELECT word, node AS ancestor, min(distance) AS distance FROM walk GROUP BY word, node"""
)
def hypernym_levels(spark, d):
    """Nested thesaurus entries, written as JSON and read again, and all synsets up to four levels above each word's; there are cycles among them."""
    part, path = table(spark, d, "part"), tables.scratch(spark, "thesaurus")
    key = F.col("p_partkey")
    above = lambda *ids: F.array(*[F.struct(i.cast("long").alias("synset")) for i in ids])
    sense = lambda synset, up: F.struct(synset.cast("long").alias("synset"), up.alias("hypernyms"))
    first, second = sense(key, above(F.expr("p_partkey div 2"), (key * 7 + 1) % 50)), sense(key + 1, above(F.expr("p_partkey div 3")))
    nested = part.select(F.concat(F.lit("w"), key).alias("word"), F.when(F.col("p_size") % 2 == 1, F.array(first, second)).otherwise(F.array(first)).alias("senses"))
    tables.write_json(nested, path)
    entries = tables.read_json_lines(spark, path, thesaurus.ENTRIES)
    starts = thesaurus.senses(entries).select(F.col("word").alias("start"), F.col("synset").alias("node"))
    return thesaurus.ancestors(starts, thesaurus.hypernyms(entries), 4).select(F.col("start").alias("word"), F.col("node").alias("ancestor"), "distance")


_NOTE = """CASE p_partkey % 12 WHEN 0 THEN '#' WHEN 1 THEN '(+' || p_size % 10 || ')' WHEN 2 THEN '(-' || left(p_name, 3) || 'ogo) (+2)' WHEN 3 THEN ' (' || left(p_name, 4) || ', ' || left(p_brand, 3) || ' ,) '
  WHEN 4 THEN '(' || left(p_name, 5) || 'eš)' WHEN 5 THEN '(' || left(p_name, 4) || 'eš, x / y; ' || left(p_name, 3) || 'el/šla; bųde; q)' WHEN 6 THEN '(+' WHEN 7 THEN '(a, b' WHEN 8 THEN '()' WHEN 9 THEN 'plain text' WHEN 10 THEN '(;' || p_size || ')' ELSE '(+2) (-a)' END"""
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_LIST = lambda c, by: f"list_filter(list_transform(regexp_split_to_array({c}, '{by}'), lambda f: {_TRIM('f')}), lambda f: f <> '')"
_FORM = lambda form, section: f"{{'form': {form}, 'section': {section}}}"


@query(
    f"""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'VERB' ELSE 'NOUN' END AS pos, {_NOTE} AS note FROM part),
    t AS (SELECT *, {_TRIM('note')} AS text FROM n), m AS (SELECT *, regexp_extract(text, '\\(\\+(\\d)\\)$', 1) AS gov, regexp_replace(regexp_replace(text, '\\(\\+\\d\\)$', ''), '\\s+$', '') AS main FROM t),
    i AS (SELECT *, CASE WHEN regexp_full_match(main, '\\(.*\\)') THEN regexp_extract(main, '^\\((.*)\\)$', 1) END AS inner_ FROM m),
    s AS (SELECT *, pos = 'VERB' AS verb, contains(inner_, ';') AS many, NOT contains(inner_, ';') AND NOT contains(inner_, ',') AS single, list_transform(string_split(inner_, ';'), lambda x: {_TRIM('x')}) AS sections FROM i),
    h AS (SELECT *, {_LIST('sections[1]', '[,/]')}[1] AS first_head, {_LIST('sections[2]', '[,/]')}[1] AS past, {_TRIM('inner_')} AS whole FROM s)
    SELECT p_partkey, pos, note, text = '#' AS omitted, CASE WHEN gov <> '' THEN gov::INT END AS governs,
      coalesce(array_to_string(list_transform(CASE WHEN inner_ IS NULL OR starts_with(inner_, '+') THEN [] WHEN starts_with(inner_, '-') THEN [{_FORM('inner_', "'FORM'")}]
        WHEN many THEN flatten(list_transform(sections, lambda x, k: list_transform({_LIST('x', '[,/]')}, lambda f: {_FORM('f', "CASE WHEN verb AND k <= 3 THEN ['PRES', 'L_PART', 'FUT'][k] ELSE 'FORM' END")})))
        WHEN single AND verb THEN [] ELSE list_transform({_LIST('inner_', ',')}, lambda f: {_FORM('f', "'FORM'")}) END, lambda f: f['section'] || ':' || f['form']), '|'), '') AS forms,
      CASE WHEN verb AND many THEN {_stem_sql('first_head', 'VERB')} WHEN verb AND single AND NOT regexp_matches(inner_, '^[+-]') THEN {_stem_sql('whole', 'VERB')} END AS secondary_stem,
      CASE WHEN verb AND many AND past IS NOT NULL THEN CASE WHEN ends_with(past, 'l') THEN regexp_replace(left(past, length(past) - 1), '[ěėeьъ]$', '') ELSE past END END AS tertiary_stem FROM h"""
)
def note_additions(spark, d):
    """Dictionary notes of twelve shapes, malformed ones among them, taken apart."""
    part = table(spark, d, "part")
    p, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    left = lambda c, n: F.substring(c, 1, n)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    shapes = [
        text("#"), text("(+", size % 10, ")"), text("(-", left(name, 3), "ogo) (+2)"), text(" (", left(name, 4), ", ", left(F.col("p_brand"), 3), " ,) "),
        text("(", left(name, 5), "eš)"), text("(", left(name, 4), "eš, x / y; ", left(name, 3), "el/šla; bųde; q)"),
        text("(+"), text("(a, b"), text("()"), text("plain text"), text("(;", size, ")"), text("(+2) (-a)"),
    ]
    rows = part.select("p_partkey", F.when(size % 3 == 0, "VERB").otherwise("NOUN").alias("pos"), F.get(F.array(*shapes), (p % 12).cast("int")).alias("note"))
    rows = rows.withColumn("a", M.addition(F.col("note"), F.col("pos")))
    forms = F.array_join(F.transform("a.forms", lambda f: F.concat(f["section"], F.lit(":"), f["form"])), "|")
    return rows.select("p_partkey", "pos", "note", "a.omitted", "a.governs", forms.alias("forms"), "a.secondary_stem", "a.tertiary_stem")


#: Endings that the lexicon's words have, the least length of a word, and the rule; two or three texts for each rule.
_RULES = [("tion", 6, "event"), ("ation", 7, "process"), ("ung", 5, "event"), ("heit", 6, "state"), ("ment", 6, "result"), ("er", 4, "agent"), ("ing", 5, "process"), ("eau", 5, "thing"), ("s", 4, "many"), ("", 0, "plain")]
_TEMPLATES = {
    "event": ["WORD: what happens with ROOT", "the event of ROOT", "WORD, from ROOT"],
    "process": ["a process of ROOT", "WORD: to go on with ROOT"],
    "state": ["the state of being ROOT"],
    "result": ["what comes of ROOT", "WORD is made by ROOT"],
    "agent": ["WORD: who does ROOT", "one who has to do with ROOT"],
    "thing": ["a thing called WORD"],
    "many": ["more than one ROOT", "WORD: many of ROOT", "several of ROOT"],
    "plain": ["WORD"],
}
_TEMPLATE_ROWS = [(rule, n, t) for rule, texts in _TEMPLATES.items() for n, t in enumerate(texts)]


@query(
    f"""WITH {LEX}, rules(suffix, least, rule) AS (VALUES {', '.join(f'({_text(s)}, {n}, {_text(r)})' for s, n, r in _RULES)}), templates(rule, nth, template) AS (VALUES {', '.join(f'({_text(r)}, {n}, {_text(t)})' for r, n, t in _TEMPLATE_ROWS)}),
    met AS (SELECT slug AS word, suffix, rule, row_number() OVER (PARTITION BY slug ORDER BY length(suffix) DESC) AS rn FROM lex JOIN rules ON ends_with(slug, suffix) AND (suffix = '' OR (length(slug) >= least AND length(suffix) <= length(slug) - 2))),
    c AS (SELECT word, rule, left(word, length(word) - length(suffix)) AS root FROM met WHERE rn = 1)
    SELECT word, c.rule, root, replace(replace(template, 'WORD', upper(left(word, 1)) || substr(word, 2)), 'ROOT', root) AS definition
    FROM c JOIN templates t ON c.rule = t.rule AND t.nth = length(word) % (SELECT count(*) FROM templates x WHERE x.rule = c.rule)"""
)
def definitions(spark, d):
    """Definitions of the lexicon's words by their longest known ending, from texts with slots."""
    words = _lexicon(spark, d).select(F.col("slug").alias("word"))
    return thesaurus.defined(words, spark.createDataFrame(_RULES, "suffix string, least int, rule string"), spark.createDataFrame(_TEMPLATE_ROWS, "rule string, nth int, template string"))
