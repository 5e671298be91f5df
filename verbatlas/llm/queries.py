"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatlas.plans.registry import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix over 150 % of all words takes of each document; of equal rows at a budget's end each takes an equal whole part."""
    from .mixing import plan_mix

    return plan_mix(_docs(spark, sf_dir)).drop("source")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts differ by one at most."""
    from pyspark.sql import functions as F

    from .sharding import shard_documents

    placed = shard_documents(_docs(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after private data is cut out of them."""
    from .token_counts import count_edited, redactions
    from .tokens import word_bpe_path

    return count_edited(redactions(_docs(spark, sf_dir)), word_bpe_path())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    from .packing import pack_documents
    from .tokens import word_bpe_path

    return pack_documents(_docs(spark, sf_dir), word_bpe_path(), 4096, 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    from .langid import identify

    return identify(_docs(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict on all documents."""
    from .quality import verdicts

    return verdicts(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as progressive JPEGs, written to the shared folder and read back."""
    from ._tables import materialize
    from .media import read_back, stored

    return read_back(materialize(stored(_docs(spark, sf_dir)), "media", "zstd"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, over two-word shingles."""
    from .neardup import classes

    return classes(_docs(spark, sf_dir), 2, 80)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all pages' URLs, with every address of the unwanted sites and of pages that repeat another one's paragraph listed."""
    from .urlfilter import RULES, SITES, judge_contents

    return judge_contents(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, SITES)


def op9_site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all pages' URLs, with the unwanted sites blocked on all domains that pages has."""
    from .urlfilter import RULES, SITES, judge_sites

    return judge_sites(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, SITES)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    from .lm import score_documents

    return score_documents(_docs(spark, sf_dir))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's token ids stand in files of equal-length sequences, and their checksum, read back from the files."""
    from pyspark.sql import functions as F

    from .token_files import byte_bpe_path, documents_of, write_files

    files = write_files(_docs(spark, sf_dir), byte_bpe_path())
    return documents_of(files).select("doc_id", (F.col("file_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, a tenth of the documents with a tail made to repeat."""
    from .periodic import digests, looped_tenth, periodic_runs

    return digests(periodic_runs(_docs(spark, sf_dir), looped_tenth()))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof in the Merkle manifest by language, and its check after tampering."""
    from .merkle import manifest_documents

    return manifest_documents(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents to packed sequences, through all stages."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op9_site_filter": op9_site_filter,
    "op10_lm_scores": op10_lm_scores,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle": op12_merkle,
    "op13_token_files": op13_token_files,
}
#: The mix in SQL: the same targets by water level, the same keys, a plain sort of each source.
OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '') AS body,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || left(md5(body), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) / ((size + 1) / (size + 1 + symbols)) AS draw_key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM sources),
rising AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () - sum(weight) OVER o AS free_weight, sum(cap) OVER o AS upto
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
filled AS (SELECT *, upto + ratio * free_weight <= budget AS is_full FROM rising),
levels AS (
  SELECT *, (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) AS level FROM filled),
goals AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE level * weight END AS target FROM levels),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
summed AS (
  SELECT k.*, g.source_size, g.target, g.epochs, floor(g.target + 0.5)::BIGINT - g.epochs * g.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY draw_key, k.doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM keyed k JOIN plans g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM summed
"""

#: Hosts, paths, rules and the block list in SQL.
OP9_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fitted AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed),
addresses AS (SELECT page_id, host, path, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM parsed WHERE host <> ''),
paragraphs AS (SELECT DISTINCT page_id, p FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<p>([^<]*)</p>', 1)) AS p FROM pages) WHERE len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) >= 20),
copied AS (SELECT DISTINCT page_id FROM (SELECT page_id, min(page_id) OVER (PARTITION BY p) AS first FROM paragraphs) WHERE page_id > first),
entries AS (SELECT DISTINCT concat_ws('/', host, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '/') END) AS entry FROM addresses
  WHERE list_has_any(labels, ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) OR page_id IN (SELECT page_id FROM copied)),
probes AS (SELECT host, path, h || unnest(list_prepend('', list_transform(range(1, len(parts) + 1), lambda i: '/' || array_to_string(parts[1:i], '/')))) AS entry FROM (
  SELECT DISTINCT host, path, parts, unnest(list_transform(range(len(labels)), lambda i: array_to_string(labels[i + 1:], '.'))) AS h FROM addresses)),
listed AS (SELECT DISTINCT host, path FROM probes JOIN entries USING (entry))
SELECT page_id, f.host, f.path, rule, CASE WHEN rule IN ('org/', 'example.org/en/1', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM fitted f LEFT JOIN listed l ON f.host = l.host AND f.path = l.path
"""

#: The same rules, and sites by a label of the host.
OP9_SITES_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fitted AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'example.org/en/1', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END AS verdict FROM fitted
"""

#: The tree level by level, then every leaf's path, folded upwards.
OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)),
      lambda v, c: list_reduce(list_prepend(xor(v, c), range(8)), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc FROM documents)),
heads AS (
  SELECT doc_id, lang, text, other, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM texts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM (
    SELECT doc_id, lang, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf, sha256(concat(head, coalesce(strlen(other) || ':' || other, '-'))) AS other FROM heads)),
lower_levels AS (
  SELECT 0 AS k, lang, pos, size, leaf AS node FROM placed UNION ALL
  SELECT k + 1, lang, pos // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_levels WHERE size > 1 GROUP BY k, lang, pos // 8, (size + 7) // 8),
tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM lower_levels WHERE size = 1),
upper_levels AS (
  SELECT 0 AS k, pos, size, node FROM tops UNION ALL
  SELECT k + 1, pos // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_levels WHERE size > 1 GROUP BY k, pos // 8, (size + 7) // 8),
lower_steps AS (
  SELECT k, lang, pos, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM lower_levels WHERE size > 1
  WINDOW r AS (PARTITION BY k, lang, pos // 8 ORDER BY pos)),
upper_steps AS (
  SELECT k, pos, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM upper_levels WHERE size > 1
  WINDOW r AS (PARTITION BY k, pos // 8 ORDER BY pos)),
lower_folds AS (
  SELECT doc_id, lang, leaf, 0 AS k, pos, size, other AS h, '' AS proof FROM placed UNION ALL
  SELECT doc_id, f.lang, leaf, f.k + 1, f.pos // 8, (size + 7) // 8, sha256(concat(before, h, after)), concat(proof, before, after)
  FROM lower_folds f JOIN lower_steps s ON f.k = s.k AND f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos WHERE size > 1),
upper_folds AS (
  SELECT doc_id, leaf, node AS subroot, 0 AS k, t.pos, t.size, h, proof FROM lower_folds f JOIN tops t ON f.lang IS NOT DISTINCT FROM t.lang WHERE f.size = 1 UNION ALL
  SELECT doc_id, leaf, subroot, f.k + 1, f.pos // 8, (size + 7) // 8, sha256(concat(before, h, after)), concat(proof, before, after)
  FROM upper_folds f JOIN upper_steps s ON f.k = s.k AND f.pos = s.pos WHERE size > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM upper_folds, (SELECT node AS root FROM upper_levels WHERE size = 1) WHERE size = 1
"""

ORACLES: dict[str, str] = {"op12_merkle": OP12_SQL, "op1_mixing": OP1_SQL, "op9_url_filter": OP9_SQL, "op9_site_filter": OP9_SITES_SQL}
