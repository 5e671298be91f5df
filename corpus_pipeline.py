"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import langid, mixing, neardup, packing, quality
from verbatlas.llm._tables import materialize
from verbatlas.llm.tokens import word_bpe_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay.

    Null, empty and blank texts and texts without a letter go; rows with a null id or lang, repeated rows and very long texts are judged like any other; nothing
    is learned from rows with a null lang. An empty table stays empty, and all columns are kept, whatever their names.
    """
    return langid.accepted(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the quality model stay.

    Without labels of both kinds the base rule decides alone. Null and empty texts fail it, very long ones are read whole; repeated rows get equal verdicts, rows with a null id
    are judged; an empty table stays empty, and all columns are kept.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    Texts without words, and rows with a null id, are linked with nothing and stay. Rows that share one id stay or go together. An empty table stays empty.
    """
    return neardup.deduplicated(docs, 5, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 5:2:1 over sources, 150 % of all words, 2 epochs at most.

    A null source is a source of its own, the last. A null text has no words. Repeated rows are taken like different ones; ties are broken by the
    documents' digests, so reruns agree. An empty table stays empty.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in as few sequences as can be.

    A null or empty text is one piece with the end id; very long ones are many pieces; repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    return packing.pack_documents(docs, word_bpe_path(), 4096, 1)


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: The stages hold fitted models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
