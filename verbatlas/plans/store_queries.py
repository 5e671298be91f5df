"""Queries on stored tables: re-analysis, imports, exports and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.functions import stems as M
from verbatlas.functions import strings as S
from verbatlas.functions import text as X
from verbatlas.operators import arrow_tokens, corpus, dedup, disambiguation, lexicon, maintenance
from verbatlas.sources import tables

from .corpus_queries import LEX, TAG, _docs, _lexicon
from .registry import query, table
from .text_queries import _ANA, _TEI_TAG, _text, duck

_WORDS = f"WITH {LEX}"


# stored tokens


def _stored(spark, d):
    """Tokens as they were stored once: words are their own lemma, without an analysis."""
    rows = arrow_tokens.positions(_docs(spark, d))
    word = F.col("word_index") != -1
    return rows.select(
        "doc_id",
        "sentence_no",
        "token_index",
        "word_index",
        "surface",
        F.col("surface").alias("lemma"),
        F.when(word, "X").otherwise("PUNCT").alias("pos"),
        F.lit(None).cast("string").alias("word_slug"),
        F.lit("").alias("feats"),
        F.when(word, 3).otherwise(1).alias("match_count"),
    )


def _analyses(spark, d):
    """New analyses of the lexicon's words of four letters or more."""
    known = _lexicon(spark, d).filter(F.length("slug") >= 4).select(F.col("slug").alias("surface"))
    a = X.analysis(F.col("surface"))
    return known.select("surface", a["lemma"].alias("lemma"), a["pos"].alias("pos"), F.col("surface").alias("word_slug"), a["feats"].alias("feats"), F.length("surface").alias("match_count"))


_NEW = f"""{TAG}, {LEX}, known AS (SELECT slug FROM lex WHERE length(slug) >= 4)"""


@query(
    f"""WITH {_NEW} SELECT doc_id, token_index, surface, CASE WHEN is_word AND k.slug IS NOT NULL THEN tag.lemma ELSE surface END AS lemma,
    CASE WHEN NOT is_word THEN 'PUNCT' WHEN k.slug IS NOT NULL THEN tag.pos ELSE 'X' END AS pos, CASE WHEN is_word THEN k.slug END AS word_slug,
    CASE WHEN is_word AND k.slug IS NOT NULL THEN tag.feats ELSE '' END AS feats,
    CASE WHEN is_word AND k.slug IS NOT NULL THEN length(surface) WHEN is_word THEN 3 ELSE 1 END::INT AS match_count FROM tag LEFT JOIN known k ON surface = k.slug"""
)
def reanalysis(spark, d):
    """Stored tokens with new analyses of known words."""
    return maintenance.reanalysed(_stored(spark, d), _analyses(spark, d)).select("doc_id", "token_index", "surface", "lemma", "pos", "word_slug", "feats", "match_count")


@query(
    f"""WITH {_NEW} SELECT sentence_no, token_index, surface, CASE WHEN is_word AND k.slug IS NOT NULL THEN tag.lemma ELSE surface END AS lemma,
    CASE WHEN NOT is_word THEN 'PUNCT' WHEN k.slug IS NOT NULL THEN tag.pos ELSE 'X' END AS pos, NOT is_word AS is_punctuation, is_word AND k.slug IS NOT NULL AS recognised
    FROM tag LEFT JOIN known k ON surface = k.slug WHERE doc_id = 7"""
)
def inspect_document(spark, d):
    """The stored tokens of one document as they are shown."""
    stored = _stored(spark, d).filter("doc_id = 7")
    return maintenance.inspected(maintenance.reanalysed(stored, _analyses(spark, d)))


_TITLE = "lang || ' & <' || coalesce(source, '') || '>'"


@query(
    f"""WITH {TAG}, {LEX}, x AS (SELECT doc_id, segment, sentence_no, token_index, CASE WHEN is_word THEN '<w lemma="' || {duck(S.XML, 'lemma')} || '" pos="' || {_TEI_TAG} || '"' || {_ANA}
      || CASE WHEN lex.slug IS NULL THEN ' cert="low"' ELSE '' END || '>' || {duck(S.XML, 'surface')} || '</w>' ELSE '<pc>' || {duck(S.XML, 'surface')} || '</pc>' END AS t
      FROM tag LEFT JOIN lex ON lower(surface) = lex.slug),
    s AS (SELECT doc_id, segment, sentence_no, '        <s n="' || (sentence_no + 1) || '">' || string_agg(t, ' ' ORDER BY token_index) || '</s>' AS line FROM x GROUP BY doc_id, segment, sentence_no),
    g AS (SELECT doc_id, segment, '      <div type="segment" n="' || (segment + 1) || '">' || chr(10) || string_agg(line, chr(10) ORDER BY sentence_no) || chr(10) || '      </div>' AS block FROM s GROUP BY doc_id, segment),
    b AS (SELECT doc_id, string_agg(block, chr(10) ORDER BY segment) AS body FROM g GROUP BY doc_id)
    SELECT doc_id, md5({_text(maintenance.TEI_HEAD[0])} || {duck(S.XML, "coalesce(" + _TITLE + ", '')")} || {_text(maintenance.TEI_HEAD[1])}
      || CASE WHEN source IS NULL THEN '' ELSE {_text(maintenance.TEI_AUTHOR[0])} || {duck(S.XML, 'source')} || {_text(maintenance.TEI_AUTHOR[1])} END
      || {_text(maintenance.TEI_HEAD[2])} || body || {_text(maintenance.TEI_END)}) AS digest FROM b JOIN documents USING (doc_id)"""
)
def tei_document(spark, d):
    """Whole documents as TEI XML, by their digests."""
    title = F.concat(F.col("lang"), F.lit(" & <"), F.coalesce("source", F.lit("")), F.lit(">"))
    docs = table(spark, d, "documents").withColumns({"title": title, "author": F.col("source")})
    out = maintenance.tei_texts(maintenance.tei_lines(docs, _docs(spark, d), _lexicon(spark, d), "title", "author"))
    return out.select("doc_id", F.md5(F.col("xml").cast("binary")).alias("digest"))


# options of word forms

_PRIOR = "CASE kase " + " ".join(f"WHEN '{k}' THEN {int(1000 * v + 0.5)}" for k, v in disambiguation.WEIGHTS.items()) + " ELSE 1000 END"


@query(f"""{_WORDS} SELECT slug AS form, slug, kase AS "case", ({_PRIOR})::BIGINT AS freq FROM lex, (SELECT unnest([{', '.join(_text(k) for k in disambiguation.WEIGHTS)}, NULL]) AS kase)""")
def cold_start(spark, d):
    """Options of the lexicon's words in every case, with counts to begin with."""
    cases = F.explode(F.array(*[F.lit(c) for c in disambiguation.WEIGHTS], F.lit(None).cast("string"))).alias("case")
    out = disambiguation.cold_start(_lexicon(spark, d).select(F.col("slug").alias("form"), "slug", cases))
    return out.withColumn("freq", F.col("freq").cast("long"))


@query(
    f"""{_WORDS}, w AS (SELECT slug, length(slug) AS n FROM lex WHERE length(slug) % 4 <> 3)
    SELECT slug AS form, slug, 'NOUN' AS pos, CASE WHEN n % 2 = 0 THEN 'nom' END AS "case", 'sg' AS number, n + 0.5::DOUBLE AS freq FROM w WHERE n % 4 <> 1
    UNION ALL SELECT slug, slug, 'VERB', NULL, NULL, 2.0 FROM w"""
)
def load_priorities(spark, d):
    """Distributions stored as JSON; entries without a slug, and texts that are no JSON, are left out."""
    slug, n = F.col("slug"), F.length("slug")
    case = F.when(n % 2 == 0, F.lit(',"case":"nom"')).otherwise("")
    first = F.concat(F.lit('{"slug":'), F.when(n % 4 == 1, F.lit("null")).otherwise(F.concat(F.lit('"'), slug, F.lit('"'))), F.lit(',"pos":"NOUN"'), case, F.lit(',"number":"sg","freq":'), (n + 0.5).cast("string"), F.lit("}"))
    second = F.concat(F.lit('{"slug":"'), slug, F.lit('","pos":"VERB","freq":2.0}'))
    stored = F.when(n % 4 == 3, F.lit("[broken")).otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    return tables.priorities(_lexicon(spark, d).select(slug.alias("surface_form"), stored.alias("distributions")))


# relations and lexemes

_W = lambda n: f"'w' || ({n})"


@query(
    f"""WITH words AS (SELECT {_W('p_partkey % 5000')} AS word, max(p_partkey) AS other FROM part GROUP BY 1),
    r AS (SELECT p_partkey AS m, unnest([{_W('p_partkey * 7 % 6000')}, {_W('p_partkey % 5000')}]) AS word, 'synonym' AS type, 'both' AS way FROM part
      UNION ALL SELECT p_partkey, {_W('p_size')}, 'hypernymy', 'from' FROM part UNION ALL SELECT p_partkey, {_W('p_partkey * 3 % 5000')}, 'hypernymy', 'to' FROM part
      UNION ALL SELECT p_partkey, {_W('p_size * 11')}, 'causation', 'to' FROM part WHERE p_size % 2 = 0),
    met AS (SELECT * FROM r JOIN words USING (word) WHERE m <> other)
    SELECT DISTINCT CASE way WHEN 'both' THEN least(m, other) WHEN 'from' THEN m ELSE other END AS source,
      CASE way WHEN 'both' THEN greatest(m, other) WHEN 'from' THEN other ELSE m END AS target, type FROM met"""
)
def relation_import(spark, d):
    """Lists of related words of an import file as typed edges."""
    part, w = table(spark, d, "part"), lambda n: F.concat(F.lit("w"), n.cast("string"))
    key, size = F.col("p_partkey"), F.col("p_size")
    entries = part.select(
        key.alias("meaning_id"),
        F.array(w(key * 7 % 6000), w(key % 5000)).alias("synonyms"),
        F.array(w(size)).alias("hypernyms"),
        F.array(w(key * 3 % 5000)).alias("hyponyms"),
        F.when(size % 2 == 0, F.array(w(size * 11))).alias("causes"),
    )
    return maintenance.relations_of(entries, part.select(w(key % 5000).alias("value"), key.alias("meaning_id")))


@query(
    """WITH stored AS (SELECT l_partkey AS source, l_suppkey AS target, CASE l_returnflag WHEN 'A' THEN 'own' WHEN 'N' THEN 'other' END AS origin FROM lineitem)
    SELECT source, target, origin FROM stored WHERE origin IS DISTINCT FROM 'own' UNION ALL SELECT p_partkey, p_size, 'own' FROM part"""
)
def scoped_replace(spark, d):
    """All relations of one origin replaced by new ones; those of others, or of none, stay."""
    origin = F.when(F.col("l_returnflag") == "A", "own").when(F.col("l_returnflag") == "N", "other")
    stored = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), origin.alias("origin"))
    new = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast(stored.schema["target"].dataType).alias("target"))
    return maintenance.replaced(stored, new, "own")


_MERGE = """t AS (SELECT p_partkey AS id, p_brand AS a, CASE WHEN p_size % 3 <> 0 THEN p_type END AS b FROM part WHERE p_partkey % 10 = 0),
    u AS (SELECT p_partkey - 1 AS id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS a, p_type AS b FROM part WHERE p_partkey % 10 = 1)"""


def _merge(spark, d):
    """Lexemes that stay, and fields of those that are merged into them."""
    part, id_ = table(spark, d, "part"), F.col("p_partkey")
    targets = part.filter("p_partkey % 10 = 0").select(id_.alias("id"), F.col("p_brand").alias("a"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("b"))
    updates = part.filter("p_partkey % 10 = 1").select((id_ - 1).alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("a"), F.col("p_type").alias("b"))
    return targets, updates


@query(f"WITH {_MERGE} SELECT t.id, coalesce(u.a, t.a) AS a, coalesce(u.b, t.b) AS b FROM t LEFT JOIN u ON t.id = u.id")
def merge_fields(spark, d):
    """Fields of merged lexemes: those given, else the kept lexeme's own."""
    return dedup.merged(*_merge(spark, d), "id", ["a", "b"])


@query(
    f"""WITH {_MERGE}, m AS (SELECT t.id, t.a, t.b, coalesce(u.a, t.a) AS na, coalesce(u.b, t.b) AS nb FROM t LEFT JOIN u ON t.id = u.id)
    SELECT id, 'a' AS field, a AS old_value, na AS new_value FROM m WHERE a IS DISTINCT FROM na UNION ALL SELECT id, 'b', b, nb FROM m WHERE b IS DISTINCT FROM nb
    UNION ALL SELECT id, 'mergedFrom', NULL, (id + 1)::VARCHAR FROM u"""
)
def merge_audit(spark, d):
    """What a merge changed, and where it came from."""
    targets, updates = _merge(spark, d)
    sources = updates.select("id", (F.col("id") + 1).alias("source"))
    return dedup.merge_audit(targets, dedup.merged(targets, updates, "id", ["a", "b"]), sources, "id", ["a", "b"])


@query(
    """WITH u AS (SELECT s_suppkey AS base, unnest([s_suppkey * 10, s_suppkey * 10 + 3, s_suppkey, 5]) AS id, unnest(range(4)) AS i FROM supplier),
    f AS (SELECT * FROM u WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0))
    SELECT base::BIGINT AS base, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM f GROUP BY base"""
)
def merge_id_lists(spark, d):
    """Lists of lexeme ids without those that a merge removed."""
    gone = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"))
    base = F.col("s_suppkey").cast("long")
    lists = table(spark, d, "supplier").select(base.alias("base"), F.array(base * 10, base * 10 + 3, base, F.lit(5).cast("long")).alias("ids"))
    return dedup.without_ids(lists, gone, "base", "ids").select("base", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    f"""{_WORDS}, g AS (SELECT left(slug, 2) AS root_group, slug FROM lex WHERE length(slug) >= 3),
    parts AS (SELECT DISTINCT root_group, slug, substr(slug, i, k) AS part FROM (SELECT root_group, slug, i, unnest(range(3, length(slug) - i + 2)) AS k FROM (SELECT root_group, slug, unnest(range(1, length(slug) - 1)) AS i FROM g))),
    c AS (SELECT root_group, part, count(*) AS hits FROM parts GROUP BY 1, 2),
    best AS (SELECT root_group, part FROM (SELECT *, row_number() OVER (PARTITION BY root_group ORDER BY hits DESC, length(part) DESC, part) AS rn FROM c) WHERE rn = 1)
    SELECT slug, CASE WHEN length(slug) % 5 = 0 THEN 'own' WHEN contains(slug, part) THEN part END AS root FROM lex LEFT JOIN best ON root_group = left(slug, 2)"""
)
def apply_roots(spark, d):
    """Lexemes take the root mined for their group where they hold it and have none of their own."""
    slug = F.col("slug")
    lexemes = _lexicon(spark, d).select("slug", F.when(F.length(slug) % 5 == 0, "own").alias("root"))
    mined = M.root_candidates(_lexicon(spark, d).select(F.substring(slug, 1, 2).alias("g"), "slug"), "g", "slug").select("g", F.col("root").alias("mined"))
    own = lexemes.join(mined, F.substring(slug, 1, 2) == F.col("g"), "left").filter(F.col("root").isNull() & F.contains(slug, F.col("mined")))
    return lexicon.upsert(lexemes, own.select("slug", F.col("mined").alias("root")), "slug")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_change(spark, d):
    """The last event of each user."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return rows.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"), "event_type")


# files and exports

_LETTER = "substr('abcde', (length(slug) % 5 + 1)::INT, 1)"


@query(
    f"""{_WORDS}, l AS (SELECT slug AS word, 1 AS n, {_LETTER} AS p FROM lex UNION ALL SELECT slug, 2, 'd' FROM lex WHERE length(slug) % 3 = 0),
    ok AS (SELECT * FROM l WHERE p IN ('a', 'b', 'c', 'd') AND regexp_full_match(word, '\\p{{L}}+'))
    SELECT word, CASE arg_max(p, n) WHEN 'd' THEN 'C' ELSE upper(arg_max(p, n)) END AS paradigm FROM ok GROUP BY word"""
)
def accent_list(spark, d):
    """Accent paradigms from lines of a word and a letter; the last line of a word counts, other lines are skipped."""
    slug, n = F.col("slug"), F.length("slug")
    letter = F.substring(F.lit("abcde"), (n % 5 + 1).cast("int"), F.lit(1))
    first = _lexicon(spark, d).select(F.lit(1).alias("n"), F.concat(F.lit(" "), slug, F.lit("  ("), letter, F.lit(") ")).alias("line"))
    second = _lexicon(spark, d).filter(n % 3 == 0).select(F.lit(2).alias("n"), F.concat(slug, F.lit(" d")).alias("line"))
    return tables.accents(first.unionByName(second))


@query(
    """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem)
    SELECT p_partkey AS lexeme_id, p_name AS headword, m.id AS meaning_id, t.l_returnflag AS language, trim(t.l_linestatus || ' ' || t.l_suppkey) AS value
    FROM l m JOIN l t USING (id) JOIN part ON m.l_partkey = p_partkey WHERE t.l_suppkey % 4 <> 0"""
)
def flat_export(spark, d):
    """Lexemes, meanings and their translations as one flat table, without blank translations."""
    lines = table(spark, d, "lineitem")
    meaning = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    value = F.when(F.col("l_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("l_linestatus"), F.lit(" "), F.col("l_suppkey").cast("string")))
    translations = lines.select(meaning.alias("meaning_id"), F.col("l_returnflag").alias("language"), value.alias("value"))
    lexemes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return tables.flattened(lexemes, lines.select(meaning, F.col("l_partkey").alias("lexeme_id")), translations)


_REPORT = """SELECT c_custkey, c_name || ', "' || c_mktsegment || '";' || chr(10) || 'x' AS note, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS amount FROM customer"""


def _report(spark, d):
    note = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('";\nx'))
    return table(spark, d, "customer").select("c_custkey", note.alias("note"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("amount"))


@query(_REPORT)
def csv_report(spark, d):
    """A report written as quoted CSV and read again: quotes, separators, line breaks and nulls come back."""
    rows, path = _report(spark, d), tables.scratch(spark, "report-csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, "c_custkey long, note string, amount double")


@query(_REPORT)
def csv_semicolons(spark, d):
    """The same with semicolons."""
    rows, path = _report(spark, d), tables.scratch(spark, "report-semicolons")
    tables.write_csv(rows, path, separator=";")
    return tables.read_csv(spark, path, "c_custkey long, note string, amount double", ";")


@query(_REPORT)
def json_report(spark, d):
    """The same as JSON lines."""
    rows, path = _report(spark, d), tables.scratch(spark, "report-json")
    tables.write_json(rows, path)
    return tables.read_json_lines(spark, path, "c_custkey long, note string, amount double")


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def append_lines(spark, d):
    """Lines appended to a CSV that has some already."""
    path = tables.scratch(spark, "lines-csv")
    tables.append_csv(table(spark, d, "region").select(F.col("r_name").alias("name")), path)
    tables.append_csv(table(spark, d, "nation").select(F.col("n_name").alias("name")), path)
    return tables.read_csv(spark, path, "name string")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def body_codec(spark, d):
    """Bodies packed as gzip in base64 and opened again."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    opened = tables.decompressed(tables.packed(rows, "text", "body").select("doc_id", "body"), "body", "again")
    return opened.select("doc_id", F.md5(F.col("again").cast("binary")).alias("digest"))


@query(f"""{_WORDS} SELECT slug, lang, CASE lang WHEN 'pl' THEN 'https://a.example/' || url_encode(slug) || '?l=1' WHEN 'cs' THEN 'https://b.example/q/' || url_encode(slug) END AS url FROM lex, (SELECT unnest(['PL', 'cs', 'xx']) AS code, unnest(['pl', 'cs', 'xx']) AS lang)""")
def dictionary_links(spark, d):
    """The address of each word in the dictionaries of some languages."""
    templates = {"pl": "https://a.example/{{word}}?l=1", "cs": "https://b.example/q/{{word}}"}
    rows = _lexicon(spark, d).select("slug", F.explode(F.array(F.lit("PL"), F.lit("cs"), F.lit("xx"))).alias("code"))
    return rows.select("slug", F.lower("code").alias("lang"), tables.dictionary_url(F.col("code"), F.col("slug"), templates).alias("url"))


@query(
    f"""{_WORDS}, w AS (SELECT slug, replace({duck(S.TO_CYRILLIC, 'slug')}, 'јо', 'ё') AS word FROM lex)
    SELECT slug, list_distinct([word, replace(word, 'ё', 'е'), replace(word, 'е', 'ё')]).list_sort().array_to_string('|') AS variants FROM w"""
)
def spelling_variants(spark, d):
    """Words with е and ё for each other."""
    word = F.replace(S.applied(S.TO_CYRILLIC, F.col("slug")), F.lit("јо"), F.lit("ё"))
    return _lexicon(spark, d).select("slug", F.array_join(F.array_sort(S.yo_variants(word)), "|").alias("variants"))


_V = M.VOWELS


@query(
    f"""{_WORDS}, w AS (SELECT slug, n, list_filter(range(1, length(slug) + 1), lambda i: contains('{_V}', lower(substr(slug, i, 1)))) AS v FROM lex, (SELECT unnest(range(4)) AS n))
    SELECT slug, n::INT AS n, CASE WHEN len(v) = 0 THEN slug ELSE substr(slug, 1, v[greatest(len(v) - n, 1)]) || chr(769) || substr(slug, v[greatest(len(v) - n, 1)] + 1) END AS form FROM w"""
)
def accent_places(spark, d):
    """Every word with an accent on its last vowel, the one before, and so on."""
    rows = _lexicon(spark, d).select("slug", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    return rows.select("slug", "n", M.accented(F.col("slug"), F.col("n"), F.lit("\u0301")).alias("form"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000.5 AND c_mktsegment = 'BUILDING' AND c_name <> 'x'' OR 1 = 1'")
def parametrised_sql(spark, d):
    """Rows of a SQL text with named parameters; a value that looks like SQL stays a value."""
    sql = f"SELECT c_custkey, c_name FROM parquet.`{d}/customer.parquet` WHERE c_acctbal >= :least AND c_mktsegment = :segment AND c_name <> :name"
    return tables.sql_rows(spark, sql, {"least": 5000.5, "segment": "BUILDING", "name": "x' OR 1 = 1"})
