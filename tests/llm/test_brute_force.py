"""Language identification, quality verdicts and sharding against plain Python, and very long texts in all operators."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verbatlas.llm import langid, lm, media, mixing, neardup, packing, quality, sharding, token_counts
from verbatlas.llm.text import LOWER, words
from verbatlas.llm.tokens import PieceEncoder, word_bpe_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABETS = {"en": "the ing er of and th".split(), "de": "sch ung ein ü ä ß lich".split(), "fr": "eau é è que les ê".split()}
MASK = (1 << 32) - 1


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def slow_ngrams(body: bytes, table: np.ndarray, dim: int) -> list[int]:
    """Counts of hashed n-grams of one to three bytes, one after the other."""
    a, counts = [int(table[b]) for b in body], [0] * dim
    for i in range(len(a)):
        h = a[i] * 0x9E3779B1 & MASK
        for n in range(1, 4):
            if i + n > len(a):
                break
            if n > 1:
                h = (h ^ a[i + n - 1]) * 0x85EBCA6B & MASK
                h ^= h >> 15
            counts[((h * 0xC2B2AE35 & MASK) >> 8) % dim] += 1
    return counts


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang, "a", 0) for i in range(300) for lang in [list(ALPHABETS)[i % 3]]]
    rows += [(1000, None, None, "a", 0), (1001, "12 34 --", "en", "a", 0), (1002, "Ünd THE sch eau", None, None, 0)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_by_plain_decoding(docs):
    model = langid.train(docs, F.lit(True))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = langid.predict(docs, model).select("row.c0", "lang_pred", "score", "ambiguous").collect()
    for r in out:
        text = texts[r["c0"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == (langid.UND, 0)
            continue
        counts = slow_ngrams(text.encode(), langid.FOLD, langid.DIM)
        x = [math.sqrt(c / sum(counts)) for c in counts]
        margins = [sum(a * float(w) for a, w in zip(x, model.weights[:, k]) if a) + float(model.bias[k]) for k in range(model.code.shape[1])]
        loss = [sum(float(s) * math.log1p(math.exp(-f * float(c))) for f, c, s in zip(margins, word, model.scale)) for word in model.code]
        share = sorted((math.exp(min(loss) - v) for v in loss), reverse=True)
        assert r["lang_pred"] == model.langs[loss.index(min(loss))]
        assert r["score"] == pytest.approx(share[0] / sum(share), abs=1e-4)
        assert r["ambiguous"] == ((share[0] - share[1]) / sum(share) < model.margin) or abs((share[0] - share[1]) / sum(share) - model.margin) < 1e-3


def test_quality_by_plain_sums(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x", 5.0) for i in range(250)], "doc_id long, quality int, text string, row double")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = quality.judge(docs, model).select("row.c0", "probability", "base_failed", "kept").collect()
    assert len(out) == len(texts)
    for r in out:
        body = texts[r["c0"]].encode()
        chars = slow_ngrams(body, LOWER, quality.CHAR_DIM)
        hashes, own = [int(h) for h in words(body)[0]], [0] * quality.WORD_DIM
        for h in hashes:
            own[h % quality.WORD_DIM] += 1
        for a, b in zip(hashes, hashes[1:]):
            own[(((a * 31 & (1 << 64) - 1) ^ b) >> 20) % quality.WORD_DIM] += 1
        x = [math.sqrt(c / max(1, sum(part))) for part in (chars, own) for c in part]
        score = sum(a * float(w) for a, w in zip(x, model.weights) if a) + model.bias
        p = 1 / (1 + math.exp(-max(-30, min(30, model.slope * score + model.shift))))
        assert r["probability"] == pytest.approx(p, abs=1e-4)
        assert r["kept"] == (not r["base_failed"] and p >= model.threshold) or abs(p - model.threshold) < 1e-3


def spark_hash(*values: int) -> int:
    """Spark's 64-bit hash of ints (below 2^31) and a last long."""
    seed = 42
    for v in values[:-1]:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v), seed)
    return xxhash.xxh64_intdigest(struct.pack("<q", values[-1]), seed)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def test_shards_by_a_plain_permutation(spark, docs):
    """Ranks in a block, running sums of the matrix, cells end to end: all by lists."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("digest"))
    rows = [(r["doc_id"], r["digest"]) for r in keyed.collect()]
    blocks, n_shards = 8, 5
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(keyed, n_shards, min_blocks=blocks, seed=3).collect()}
    sizes = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    per_block = collections.Counter(d % blocks for _, d in rows)
    counted = spark.createDataFrame(sorted(per_block.items()), "block long, n long")
    matrix = {r["block"]: r["counts"] for r in sharding.communication_matrix(counted, sizes, blocks, 3).collect()}
    cells, placed = max(4, 4 * blocks // n_shards), collections.defaultdict(list)
    for b in range(blocks):
        inside = sorted((x for x in rows if x[1] % blocks == b), key=lambda x: signed(spark_hash(3, 1, x[1])))
        shards = [s for s, n in enumerate(matrix[b]) for _ in range(n)]
        for (doc_id, digest), shard in zip(inside, shards, strict=True):
            placed[shard].append((signed(spark_hash(3, 2, digest)) % cells, signed(spark_hash(3, 3, digest)), doc_id))
    want = {doc_id: (shard, slot) for shard, members in placed.items() for slot, (_, _, doc_id) in enumerate(sorted(members))}
    assert got == want and collections.Counter(s for s, _ in got.values()) == dict(enumerate(sizes))


def test_very_long_texts(spark):
    """20 MB in one row and a word of 10 MB, beside short texts."""
    rng = random.Random(5)
    part = prose(rng, "en", 20_000)
    long = (part + "\n") * (20_000_000 // len(part) + 1)
    rows = [(1, long, "en", "a", 0), (2, "ab" * 5_000_000, "de", "b", 0), (3, prose(rng, "de", 50), "de", "b", 0), (4, prose(rng, "fr", 50), "fr", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    n = {i: len(t.split()) for i, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in mixing.plan_mix(docs).collect()} == n
    out = {r["doc_id"]: r for r in quality.verdicts(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert {i: r["n_words"] for i, r in out.items()} == n and out[1]["base_failed"] and out[2]["base_failed"] and out[1]["n_repeat_words"] == n[1]
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(out) == 4 and all(r["lang_pred"] in ("en", "de", "fr") for r in out.values())
    out = {r["doc_id"]: r for r in neardup.classes(docs, 2, 80).collect()}
    assert out[2]["n_shingles"] == 1 and all(r["kept"] for r in out.values())
    w = (part + "\n" + part).lower().split()
    assert out[1]["n_shingles"] == len(set(zip(w, w[1:])))
    assert sum(r["size"] for r in sharding.shard_documents(docs, 2).collect()) == sum(len(t.encode()) + 1 for _, t, *_ in rows)
    out = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert {i: r["n_tokens"] for i, r in out.items()} == {i: k + 1 for i, k in n.items()} and all(math.isfinite(r["score"]) for r in out.values())
    own = PieceEncoder(word_bpe_path())
    ids = own.ids(part.encode())
    pieces = packing.pack_documents(docs.filter("doc_id <> 2"), word_bpe_path()).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == len(ids) // 4 * (len(long) // (len(part) + 1)) + 1
    edits = docs.filter("doc_id <> 2").withColumn("edits", F.expr("array(named_struct('start', 5000000L, 'end', 5000007L, 'new', 'x'))"))
    out = {r["doc_id"]: r for r in token_counts.count_edited(edits, word_bpe_path()).collect()}
    assert out[1]["n_tokens"] == len(ids) // 4 * (len(long) // (len(part) + 1)) and out[1]["encoded_chars"] < 10_000
    shown = {r["doc_id"]: r for r in media.read_back(media.stored(docs.filter("doc_id = 1"))).collect()}
    padded = long.encode() + bytes(-len(long.encode()) % 64)
    assert shown[1]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
