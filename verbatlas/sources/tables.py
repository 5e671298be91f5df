"""Reading and writing lexicon and corpus files, with declared schemas."""

from __future__ import annotations

import atexit
import gzip
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the analytic entities, as DDL.
SCHEMAS = {
    "documents": "slug string, title string, author string, raw_text string, language string, genre string, created_at timestamp",
    "tokens": "id long, document_slug string, sentence_id string, token_index int, word_index int, surface_form string, lemma string, pos string, feats string, word_slug string, match_count int",
    "lexemes": "id long, slug string, external_id string, value string, pos string, gender string, aspect string, intelligibility string, stem string, secondary_stem string, tertiary_stem string",
    "meanings": "id long, lexeme_id long, meaning string, examples string",
    "translations": "id long, language string, value string, verified int, lexeme_id long, meaning_id long",
    "relations": "source_id long, target_id long, relation_type string, proximity double, source string",
    "base_homonyms": "base string, word_ids string",
    "priorities": "surface_form string, distributions string",
}
#: The parts of speech and cases that are allowed.
POS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
CASES = ["nom", "acc", "gen", "dat", "loc", "ins", "voc"]
#: The folder of this process, where the session names none.
_OWN: list[str] = []


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Quoted CSV; a quote is doubled inside quotes, and fields may hold line breaks."""
    reader = spark.read.schema(schema).option("sep", separator).option("header", header)
    return reader.option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array, a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files with a JSON object in each line."""
    return spark.read.schema(schema).json(path)


def word_ids(column: Column) -> Column:
    """array<struct<id, flavor>> from any of the three ways in which lists of ids were stored.

    [1, 2]; [{"id": 1, "flavor": "CORE"}]; [{"id": 1, "flavors": ["CORE", "EAST"]}]. Without a flavor it is CORE.
    """
    plain = F.from_json(column, "array<long>")
    rich = F.from_json(column, "array<struct<id: long, flavor: string, flavors: array<string>>>")
    of_plain = F.transform(plain, lambda i: F.struct(i.alias("id"), F.lit("CORE").alias("flavor")))
    flavors = lambda r: F.coalesce(r["flavors"], F.array(F.coalesce(r["flavor"], F.lit("CORE"))))
    of_rich = F.flatten(F.transform(rich, lambda r: F.transform(flavors(r), lambda f: F.struct(r["id"].alias("id"), f.alias("flavor")))))
    return F.when(F.trim(column).rlike(r"^\[\s*\{"), of_rich).otherwise(of_plain)


def inverted_bases(homonyms: DataFrame) -> DataFrame:
    """(base, lexeme_id, flavor): the index of bases, one row for each lexeme."""
    return homonyms.select("base", F.explode(word_ids(F.col("word_ids"))).alias("w")).select("base", F.col("w.id").alias("lexeme_id"), "w.flavor")


def priorities(stored: DataFrame) -> DataFrame:
    """(form, slug, pos, case, number, freq) of well-formed stored distributions; others are left out."""
    items = F.from_json("distributions", "array<struct<slug: string, pos: string, `case`: string, number: string, freq: double>>")
    rows = stored.select(F.col("surface_form").alias("form"), F.explode(items).alias("o")).select("form", "o.*")
    return rows.filter(F.col("slug").isNotNull() & F.col("pos").isNotNull() & F.col("freq").isNotNull())


def unioned(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of translations from one per language."""
    frames = [df.withColumn("language", F.lit(code)) for code, df in tables.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def accents(lines: DataFrame) -> DataFrame:
    """(word, paradigm) from lines `word  (a|b|c|d)`, the last line of a word wins, d counts as C; lines: (n, line)."""
    pattern = r"^\s*(\p{L}+)\s+\(?([abcd])\)?\s*$"
    found = lines.filter(F.col("line").rlike(pattern)).select("n", F.regexp_extract("line", pattern, 1).alias("word"), F.upper(F.regexp_extract("line", pattern, 2)).alias("p"))
    last = found.groupBy("word").agg(F.max_by("p", "n").alias("p"))
    return last.select("word", F.when(F.col("p") == "D", "C").otherwise(F.col("p")).alias("paradigm"))


def flattened(lexemes: DataFrame, meanings: DataFrame, translations: DataFrame) -> DataFrame:
    """(lexeme_id, meaning_id, language, value) of non-blank translations, a word of its own where a lexeme has no value."""
    m = meanings.select(F.col("id").alias("meaning_id"), "lexeme_id")
    t = translations.select("meaning_id", "language", F.trim("value").alias("value")).filter("value <> ''")
    head = lexemes.select(F.col("id").alias("lexeme_id"), F.coalesce("value", F.lit("")).alias("headword"))
    return m.join(t, "meaning_id").join(head, "lexeme_id").select("lexeme_id", "headword", "meaning_id", "language", "value")


def compressed(body: str) -> str:
    """A text as gzip in base64: for fixtures and small writes."""
    import base64

    return base64.b64encode(gzip.compress(body.encode(), mtime=0)).decode()


def decompressed(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the text of a gzip+base64 column, in slices of Arrow batches; null stays null, plain text stays as it is."""
    row = df.select(F.struct(*df.columns).alias("row"), F.try_to_binary(column, F.lit("base64")).alias("packed"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column(0).field(column)
            for first, n in slices(plain):
                texts = []
                for body, packed in zip(plain.slice(first, n), batch.column(1).slice(first, n)):
                    raw = packed.as_py()
                    texts.append(gzip.decompress(raw).decode() if raw and raw[:2] == b"\x1f\x8b" else body.as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(texts, pa.string())], ["row", into])

    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(opened, f"row {kind}, {into} string").select("row.*", into)


def packed(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the gzip+base64 form of a text column, in slices of Arrow batches; null stays null."""
    row = df.select(F.struct(*df.columns).alias("row"))

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(0).field(column)
            for first, n in slices(bodies):
                texts = [None if t is None else compressed(t) for t in bodies.slice(first, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(texts, pa.string())], ["row", into])

    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(closed, f"row {kind}, {into} string").select("row.*", into)


def slices(texts: pa.Array, most: int = 1 << 20) -> list[tuple[int, int]]:
    """(first, rows) of slices of about `most` bytes of text each, so that Python holds few copies of a batch; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, first, size = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > most:
            out.append((first, i - first))
            first, size = i, 0
        size += n
    return [*out, (first, len(sizes) - first)] if sizes else out


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, separator: str = ",") -> None:
    """A quoted CSV report with a header."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", separator).csv(path)


def write_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A JSON report, an object in each line; null fields are left out."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a CSV report, as files beside those that are there: whatever they end in, no line runs into another."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the session's spark.checkpoint.dir, in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="verbatlas-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = f"file://{_OWN[0]}"
    return f"{folder.rstrip('/')}/verbatlas-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: made once, however often it is used. It goes when the application ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Tokens clustered by document, so that later reads of a document touch few files; ranges split large corpora evenly."""
    spread = tokens.repartitionByRange("document_slug", "token_index").sortWithinPartitions("document_slug", "token_index")
    spread.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table in buckets of a key: joins and groupings on it need no shuffle afterwards."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def dictionary_url(language: Column, word: Column, templates: dict[str, str]) -> Column:
    """The address of a word in a language's dictionary; null for other languages. Templates hold {{word}}."""
    known = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    template = F.try_element_at(known, F.lower(language))
    return F.when((word != "") & template.isNotNull(), F.replace(template, F.lit("{{word}}"), F.url_encode(word)))


def sql_rows(spark: SparkSession, sql: str, args: dict[str, object]) -> DataFrame:
    """A parametrised SQL query; values never become part of the text."""
    if re.search(r";\s*\S", sql):
        raise ValueError("one statement only")
    return spark.sql(sql, args=args)
