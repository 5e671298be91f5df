"""Stored structures under change: the text index, the token table, and places with nulls."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import corpus, ordering, text_index, token_store

ROWS = "key long, old string, new string"


def slow_search(texts: dict, searches: list[str]) -> set[tuple]:
    out = set()
    for s in searches:
        for key, text in texts.items():
            low = (text or "").lower()
            n = sum(low.startswith(s.lower(), i) for i in range(len(low)))
            if n:
                out.add((s, key, n))
    return out


def test_index_follows_changes(spark, tmp_path):
    rng, path = random.Random(8), str(tmp_path / "index")
    word = lambda: "".join(rng.choice("abA é😀") for _ in range(rng.randint(0, 14)))
    texts = {i: rng.choice([None, "", "ab", word() + word()]) for i in range(60)}
    text_index.build(spark.createDataFrame(list(texts.items()), "key long, text string"), "key", "text", path)
    searches = ["aab", "aaaa", "b é", "😀ab", "ababab"]
    check = lambda: {tuple(r) for r in text_index.search(spark, path, searches).collect()}
    assert check() == slow_search(texts, searches)
    for number in (1, 2, 3):
        batch = []
        for key in rng.sample(range(70), 20):
            new = rng.choice([None, word() + "aab" + word(), word()])
            batch.append((key, texts.get(key), new))
            texts[key] = new
        for _ in range(2 if number == 2 else 1):  # a change applied again under its number
            text_index.change(spark.createDataFrame(batch, ROWS), "key", "old", "new", path, number)
        assert check() == slow_search(texts, searches)
        if number == 2:
            assert text_index.compact(spark, path) == 2
            assert check() == slow_search(texts, searches)
    # writers that failed left folders without a mark of success
    shutil.copytree(f"{path}/delta-3", f"{path}/delta-9")
    shutil.copytree(f"{path}/delta-3", f"{path}/base-9")
    (tmp_path / "index/delta-9/_SUCCESS").unlink()
    (tmp_path / "index/base-9/_SUCCESS").unlink()
    assert check() == slow_search(texts, searches)
    with pytest.raises(ValueError):
        text_index.search(spark, path, ["ab"])


def test_index_of_an_empty_table(spark, tmp_path):
    text_index.build(spark.createDataFrame([], "key long, text string"), "key", "text", f"{tmp_path}/index")
    assert text_index.search(spark, f"{tmp_path}/index", ["abc"]).count() == 0


def test_probe_filters_reach_the_files(spark, tmp_path):
    text_index.build(spark.createDataFrame([(1, "some text")], "key long, text string"), "key", "text", f"{tmp_path}/index")
    plan = text_index.merged(spark, f"{tmp_path}/index", ["ext"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(trigram,ext)" in plan.replace("In(trigram, [ext])", "EqualTo(trigram,ext)")


DOCS = "doc_id long, text string"


def stored(spark, path) -> dict:
    rows = token_store.read(spark, path).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_index", "surface"))).alias("t"))
    return {r["doc_id"]: " ".join(x["surface"] for x in r["t"]) for r in rows.collect()}


def test_documents_are_replaced(spark, tmp_path):
    path, texts = f"{tmp_path}/tokens", {i: f"text number {i}" for i in range(30)}
    token_store.create(spark.createDataFrame(list(texts.items()), DOCS), path, 8)
    assert stored(spark, path) == texts
    batch = spark.createDataFrame([(3, "new words"), (4, ""), (99, "a new one")], DOCS)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tokens").iterdir() if p.name.startswith("bucket=")}
    for _ in range(2):
        token_store.replace(batch, path, 8, "first")
        texts = {**texts, 3: "new words", 99: "a new one"}
        texts.pop(4, None)
        assert stored(spark, path) == texts
    touched = {f"bucket={r[0]}" for r in batch.select(token_store.bucket(F.col("doc_id"), 8)).collect()}
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tokens").iterdir() if p.name.startswith("bucket=")}
    assert {b for b in before if before[b] != after.get(b)} <= touched
    # a failure that lost buckets half-way: the batch is finished from what was written aside
    for b in touched:
        shutil.rmtree(tmp_path / "tokens" / b, ignore_errors=True)
    token_store.replace(batch, path, 8, "first")
    assert stored(spark, path) == texts


def test_a_bucket_loses_its_last_document(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    token_store.create(spark.createDataFrame([(1, "one"), (2, "two")], DOCS), path, 1)
    token_store.replace(spark.createDataFrame([(1, None), (2, " ")], DOCS), path, 1, "gone")
    assert not (tmp_path / "tokens/bucket=0").exists()


def test_places_keep_rows_with_nulls(spark):
    rows = [("a", 3), ("b", None), (None, 3), (None, None), ("c", 7), ("c", 7)]
    frame = spark.createDataFrame(rows, "slug string, freq long").repartition(3)
    got = sorted((tuple(r) for r in corpus.ranked(frame).collect()), key=lambda r: r[2])
    assert got == [("c", 7, 1), ("c", 7, 2), ("a", 3, 3), (None, 3, 4), ("b", None, 5), (None, None, 6)]
    assert corpus.ranked(frame.limit(0)).count() == 0


def test_places_over_many_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.lit("x").alias("place_of")).repartition(7)
    got = ordering.numbered(rows, [ordering.rising("v")]).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["v"] for r in got)
    assert sorted(r["place"] for r in got) == list(range(1, 3001))


def test_blocks_hold_many_keys(spark, tmp_path):
    """A slice's postings of a trigram are one stored row: rows don't grow with the documents' trigrams."""
    rows = spark.createDataFrame([(i, "same words here") for i in range(500)], "key long, text string").repartition(1)
    text_index.build(rows, "key", "text", f"{tmp_path}/index")
    kept = spark.read.parquet(f"{tmp_path}/index/base-0")
    assert kept.count() == kept.select("trigram").distinct().count() == 13
    assert text_index.merged(spark, f"{tmp_path}/index").count() == 500 * 13


def test_a_slice_ends_and_keys_may_be_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SLICE", 40)
    rows = spark.createDataFrame([(f"k{i}", "abcabc" * (1 + i % 9)) for i in range(30)], "key string, text string").repartition(1)
    found = text_index.blocks(rows, "key", "text").select("trigram", F.explode("postings").alias("p")).select("trigram", "p.*").collect()
    assert len(found) == 90 and len({(r["trigram"], r["key"]) for r in found}) == 90
    assert all(r["positions"] == [p for p in range({"abc": 0, "bca": 1, "cab": 2}[r["trigram"]], 6 * (1 + int(r["key"][1:]) % 9) - 2, 3)] for r in found)


def test_a_document_is_one_stored_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two. three") for i in range(20)] + [(20, " \n "), (21, None)], DOCS)
    token_store.create(docs, f"{tmp_path}/tokens", 4)
    assert spark.read.parquet(f"{tmp_path}/tokens").count() == 20
    assert token_store.read(spark, f"{tmp_path}/tokens").count() == 80


def test_a_base_is_stored_once(spark, tmp_path, monkeypatch):
    """Places are stored in less than two bytes, and a compaction frees each piece as soon as the new one is there; one that failed is finished by the next."""
    path, size = tmp_path / "index", lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(4)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    text_index.build(docs, "doc_id", "text", str(path))
    base = size(path / "base-0")
    assert base < 2 * sum(map(len, texts.values()))
    changed = docs.filter("doc_id % 5 < 2").select("doc_id", F.col("text").alias("old"), F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).alias("new"))
    text_index.change(changed, "doc_id", "old", "new", str(path), 1)
    texts = {k: t if k % 5 > 1 else t[::-1] if k % 5 == 0 else None for k, t in texts.items()}
    searches = ["ing", "on the", "gnu"]
    check = lambda: {tuple(r) for r in text_index.search(spark, str(path), searches).collect()} == slow_search(texts, searches)
    assert check()
    write, most = text_index._write, []

    def writes(df, to, *by):
        if len(most) == 2:
            raise OSError("no space")
        write(df, to, *by)
        most.append(sum(size(p) for p in path.glob("base-*")))

    monkeypatch.setattr(text_index, "_write", writes)
    with pytest.raises(OSError):
        text_index.compact(spark, str(path))
    assert check() and not (path / "base-1/_SUCCESS").exists() and not (path / "base-0/piece=0-0").exists()
    monkeypatch.setattr(text_index, "_write", write)
    # a change that comes meanwhile voids what is in pieces of either base
    more = docs.filter("doc_id % 5 = 2").select("doc_id", F.col("text").alias("old"), F.concat(F.lit("gnu "), "text").alias("new"))
    text_index.change(more, "doc_id", "old", "new", str(path), 2)
    texts = {k: f"gnu {t}" if k % 5 == 2 else t for k, t in texts.items()}
    assert check() and text_index.compact(spark, str(path)) == 2 and check()
    assert max(most) < 1.6 * base and sorted(p.name for p in path.iterdir()) == ["base-2", "schema"]
    assert text_index.compact(spark, str(path)) == 2 and check()
