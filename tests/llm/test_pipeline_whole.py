"""The whole pipeline: against plain versions stage by stage, and on empty and odd tables."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, SEP, prose, slow_classes, water_fill
from tokenizers import Tokenizer

from verbatlas.llm import langid, quality
from verbatlas.llm.tokens import word_bpe_path

NAMES = ("row", "key", "size", "copy", "bin", "cell", "lot", "id", "n", "at", "grp", "component")


def make_rows(n: int = 130) -> list[tuple]:
    rng, rows = random.Random(21), []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        text = prose(rng, lang, rng.randint(30, 220))
        if i % 4 == 1:  # a near copy: one word in thirty is another
            w = rows[rng.randrange(len(rows))][1].split()
            text = " ".join(rng.choice("xyz") if k % 60 == 59 else x for k, x in enumerate(w))
        rows.append((i, text, lang, rng.choice(["a", "b", None]), len(text)))
    return rows + [(n, None, "en", "a", 0), (n + 1, "", "de", "b", 0), (n + 2, "?! 12", "fr", None, 4), (n + 3, "z z z " * 40, "en", "a", 9)]


def run(spark, folder, rows, labels):
    import corpus_pipeline

    frame = spark.createDataFrame(rows, DOCS)
    for name in NAMES:
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = make_rows()
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    out = run(spark, tmp_path, rows, labels).collect()
    # the fitted models judge texts one by one; everything else is done again in Python
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = {r["doc_id"] for r in langid.accepted(docs).select("doc_id").collect()}
    second = docs.filter(F.col("doc_id").isin(*known))
    good = {r["doc_id"] for r in quality.accepted(second, spark.read.parquet(f"{tmp_path}/labels.parquet")).select("doc_id").collect()}
    kept = [r for r in rows if r[0] in good]
    classes = slow_classes(kept, 5, 80)
    kept = [r for r in kept if classes[r[0]][1] == r[0]]
    assert 10 < len(kept) < len(good)
    sizes = collections.Counter()
    for r in kept:
        sizes[r[3]] += len(SEP.findall(r[1]))
    target = water_fill(sizes)
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) <= {r[0] for r in kept}
    tokenizer = Tokenizer.from_file(word_bpe_path())
    taken, longest = collections.Counter(), collections.Counter()
    for doc_id, text, _, source, _ in kept:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = pieces[doc_id]
        assert len(own) <= 2 and all((p["piece"], p["start"], p["length"], p["ids_crc32"]) == (0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for p in own)
        taken[source] += len(own) * len(SEP.findall(text))
        longest[source] = max(longest[source], len(SEP.findall(text)))
    for source, words in target.items():
        assert abs(taken[source] - words) <= longest[source]
    rooms = collections.defaultdict(list)
    for r in out:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rooms) <= sum(r["length"] for r in out) / 4096 * 1.5 + 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(None, "some words here", None, None, 1), (5, " \n", "en", "a", 2), (5, " \n", "en", "a", 2)]], ids=["empty", "odd"])
def test_pipeline_of_empty_and_odd_tables(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows, []).count() >= 0
