"""Token sequences, concordances, and disambiguation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import cql, disambiguation, kwic
from verbatlas.sources import tables

from .corpus_queries import SENT, TAG, _docs
from .registry import query, table

THE = cql.token(surface="the")
BIGRAM = [THE, cql.token(pos="ADJ")]
TRIGRAM = [cql.token(pos="ADJ"), cql.token(surface="of"), cql.token(pos="NOUN")]
NEGATED = [cql.token(lemma="of").but(pos="PUNCT"), cql.token().but(pos="NOUN")]
LEMMA = "tion"


def _match(*conditions: str) -> str:
    """Matches in SQL: tokens with those that follow them in their sentence, by lead."""
    ahead = "".join(
        f", lead({c}, {k}) OVER s AS {c}{k}" for k in range(1, len(conditions)) for c in ("surface", "lemma", "pos")
    )
    window = " WINDOW s AS (PARTITION BY doc_id, sentence_no ORDER BY token_index)" if ahead else ""
    last = f" AND pos{len(conditions) - 1} IS NOT NULL" if ahead else ""
    where = " AND ".join(c.replace("#", str(k) if k else "") for k, c in enumerate(conditions)) + last
    return (
        f"SELECT doc_id, sentence_no, token_index AS match_start, token_index + {len(conditions) - 1} AS match_end"
        f" FROM (SELECT doc_id, sentence_no, token_index, surface, lemma, pos{ahead} FROM tag{window}) WHERE {where}"
    )


_BIGRAM = _match("lower(surface#) = 'the'", "pos# = 'ADJ'")


@query(f"WITH {TAG} {_match('lower(surface#) = ' + chr(39) + 'the' + chr(39))}")
def cql_single(spark, d):
    return cql.in_documents(_docs(spark, d), [THE])


@query(f"WITH {TAG} {_BIGRAM}")
def cql_bigram(spark, d):
    return cql.in_documents(_docs(spark, d), BIGRAM)


@query(f"""WITH {TAG} {_match("pos# = 'ADJ'", "lower(surface#) = 'of'", "pos# = 'NOUN'")}""")
def cql_trigram(spark, d):
    return cql.in_documents(_docs(spark, d), TRIGRAM)


@query(f"""WITH {TAG} {_match("pos# <> 'PUNCT' AND lower(lemma#) = 'of'", "pos# <> 'NOUN'")}""")
def cql_neg(spark, d):
    return cql.in_documents(_docs(spark, d), NEGATED)


@query(
    """WITH t AS (SELECT user_id, event_type AS lemma, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS token_index FROM events)
    SELECT a.user_id, a.token_index AS match_start, a.token_index + 1 AS match_end FROM t a JOIN t b ON a.user_id = b.user_id AND b.token_index = a.token_index + 1
    WHERE lower(a.lemma) = 'view' AND b.k <> '1' AND a.k = '2'"""
)
def cql_json_feat(spark, d):
    """A user's events as a sentence: a view with k = 2, then anything whose k is not 1."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    tokens = table(spark, d, "events").select(
        "user_id", (F.row_number().over(order) - 1).cast("long").alias("token_index"), F.col("event_type").alias("lemma"), F.col("props").alias("feats")
    )
    return cql.by_lead(tokens, [cql.token(lemma="view", k="2"), cql.token().but(k="1")], ["user_id"])


@query(
    f"""WITH {TAG}, m AS ({_BIGRAM}), p AS (SELECT * FROM m ORDER BY doc_id, match_start LIMIT 21 OFFSET 20)
    SELECT * FROM (SELECT *, (SELECT count(*) FROM p) > 20 AS has_more FROM p ORDER BY doc_id, match_start LIMIT 20)"""
)
def cql_page(spark, d):
    return cql.page(cql.in_documents(_docs(spark, d), BIGRAM), ["doc_id", "match_start"], 2, 20)


def _glue(part: str) -> str:
    return f"""coalesce(array_to_string(list_transform({part}, lambda x, i: CASE WHEN i = 1 OR regexp_full_match(x, '[.,!?;:»" ]+') THEN x ELSE ' ' || x END), ''), '')"""


def _side(condition: str) -> str:
    return f"list(t.surface ORDER BY t.token_index) FILTER ({condition})"


@query(
    f"""WITH {TAG}, m AS ({_BIGRAM}) SELECT m.doc_id || '_' || m.sentence_no || '_' || m.match_start AS match_id, m.doc_id, m.sentence_no,
    {_glue(_side('t.token_index < m.match_start'))} AS left_context, {_glue(_side('t.token_index BETWEEN m.match_start AND m.match_end'))} AS keyword,
    {_glue(_side('t.token_index > m.match_end'))} AS right_context
    FROM m JOIN tag t ON t.doc_id = m.doc_id AND t.sentence_no = m.sentence_no GROUP BY m.doc_id, m.sentence_no, m.match_start"""
)
def kwic_span(spark, d):
    return kwic.span_lines(_docs(spark, d), BIGRAM)


@query(
    f"""WITH {TAG}, hits AS (SELECT t.doc_id, t.sentence_no, t.surface, s.sentence, t.token_index - min(t.token_index) OVER (PARTITION BY t.doc_id, t.sentence_no) AS place, t.lemma
      FROM tag t JOIN sent s USING (doc_id, sentence_no)), h AS (SELECT * FROM hits WHERE lower(lemma) = '{LEMMA}')
    SELECT doc_id, sentence_no, place, regexp_replace(substr(sentence, 1, strpos(sentence, surface) - 1), '\\s+$', '') AS left_context, surface AS keyword,
      regexp_replace(substr(sentence, strpos(sentence, surface) + length(surface)), '^\\s+', '') AS right_context,
      (SELECT count(*) FROM h) AS total, ceil((SELECT count(*) FROM h) / 20)::BIGINT AS pages
    FROM (SELECT * FROM h ORDER BY doc_id, sentence_no, place LIMIT 20 OFFSET 20)"""
)
def kwic_lemma(spark, d):
    return kwic.lemma_lines(_docs(spark, d), LEMMA, 2, 20)


_RULES = ", ".join(f"('{w}', '{c}', {i})" for w, cases in disambiguation.GOVERNMENT.items() for i, c in enumerate(cases))
_PRIOR = "CASE kase " + " ".join(f"WHEN '{k}' THEN {int(1000 * v + 0.5)}" for k, v in disambiguation.WEIGHTS.items()) + " END"


@query(
    f"""WITH {TAG}, rules(left_word, "case", preference) AS (VALUES {_RULES}),
    pairs AS (SELECT lower(b.surface) AS form, lower(a.surface) AS left_word, count(*) AS n FROM tag b
      LEFT JOIN tag a ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND a.token_index = b.token_index - 1 WHERE b.is_word GROUP BY 1, 2),
    options AS (SELECT DISTINCT lower(surface) AS form, lemma AS slug, kase AS "case", {_PRIOR} AS freq FROM tag, (SELECT unnest(['nom','acc','gen','dat','loc','ins','voc']) AS kase) WHERE pos = 'NOUN'),
    rated AS (SELECT p.left_word, p.form, p.n, o.slug, o."case", row_number() OVER (PARTITION BY p.left_word, p.form ORDER BY coalesce(r.preference, 99), -o.freq, o."case", o.slug) AS rn
      FROM pairs p LEFT JOIN options o ON o.form = p.form LEFT JOIN rules r ON r.left_word = p.left_word AND r."case" = o."case")
    SELECT left_word, form, n, slug, "case" FROM rated WHERE rn = 1 AND left_word IN (SELECT left_word FROM rules)"""
)
def case_government(spark, d):
    """Nouns after a preposition, with the case that it governs; every noun form may be any case."""
    docs = _docs(spark, d)
    governed = tables.kept(disambiguation.neighbours(docs, list(disambiguation.GOVERNMENT)), "governed")
    words = governed.select("form").distinct()
    nouns = words.filter(X.pos_of(F.col("form")) == "NOUN").select("form", X.lemma_of(F.col("form")).alias("slug"))
    cases = F.explode(F.array(*[F.lit(c) for c in disambiguation.WEIGHTS])).alias("case")
    options = disambiguation.cold_start(nouns.select("form", "slug", cases))
    rules = disambiguation.government(spark)
    return disambiguation.disambiguated(governed, options, rules).select("left_word", "form", "n", "slug", "case")


@query(
    f"""WITH {TAG}, counted AS (SELECT lower(surface) AS form, lemma AS slug, nullif(regexp_extract(feats, 'case=([a-z]+)', 1), '') AS "case", count(*) AS freq FROM tag WHERE is_word GROUP BY 1, 2, 3),
    lexf AS (SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark)),
    stored AS (SELECT form, form AS slug, kase AS "case", {_PRIOR} AS freq FROM lexf, (SELECT unnest(['nom', 'gen']) AS kase) UNION ALL SELECT form, form, NULL, 1000 FROM lexf),
    merged AS (SELECT coalesce(s.form, c.form) AS form, coalesce(s.slug, c.slug) AS slug, coalesce(s."case", c."case") AS "case", s.freq AS old, c.freq AS new
      FROM stored s FULL JOIN counted c ON s.form = c.form AND s.slug = c.slug AND s."case" IS NOT DISTINCT FROM c."case"),
    out AS (SELECT form, slug, "case", CASE WHEN form IN (SELECT form FROM counted) THEN coalesce(new, 1) ELSE old END::BIGINT AS freq FROM merged)
    SELECT form, slug, "case", freq, row_number() OVER (PARTITION BY form ORDER BY freq DESC, "case" NULLS FIRST, slug)::INT AS place FROM out"""
)
def form_priorities(spark, d):
    """Stored options of the lexicon's forms, updated by the corpus."""
    words = _docs(spark, d).select(F.explode(X.surfaces(F.col("text"))).alias("surface")).filter(X.is_word(F.col("surface")))
    per = words.groupBy("surface").agg(F.count("*").alias("n"))
    s = F.col("surface")
    case = F.nullif(F.regexp_extract(X.feats_of(s), "case=([a-z]+)", 1), F.lit(""))
    counted = per.groupBy(F.lower(s).alias("form"), X.lemma_of(s).alias("slug"), case.alias("case")).agg(F.sum("n").alias("freq"))
    forms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("form")).distinct()
    cases = F.explode(F.array(F.lit("nom"), F.lit("gen"), F.lit(None).cast("string"))).alias("case")
    stored = disambiguation.cold_start(forms.select("form", F.col("form").alias("slug"), cases))
    return disambiguation.hot_update(stored, counted)
