"""Periodic runs, Merkle manifests and token files against brute force, with odd rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbatlas.llm import merkle, periodic, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SEP = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def make_rows() -> list[tuple]:
    rng, rows = random.Random(11), []
    for i in range(150):
        words = [rng.choice(["aa", "b", "Ce", "dé", "ß?", "x\x1fy", "one's", "  two", "\n"]) for _ in range(rng.randint(0, 160))]
        if i % 5 == 0 and words:
            words = words[: rng.randint(1, 9)] * rng.randint(3, 12) + words
        lang = rng.choice(["en", "en", "en", "de", "é", "Z", None])
        text = " ".join(words)
        rows.append((i, text, lang, rng.choice(["a", None, "b"]), len(text)))
    rows += [(200, None, "en", None, None), (201, "", "lonely", "a", 0), (202, " \n\t\x0b ", None, "a", 5), (203, "<|endoftext|> as text", "en", "a", 21)]
    rows += [(204, "y" * 300_000, "en", "a", 1), (205, "again and Again " * 20_000, "de", "b", 2), (206, "日本語 　 text", "en", "a", 9)]
    return rows + [rows[5], rows[5], rows[6], (None, "No id", "en", "a", 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("grp", "key", "at", "part", "node", "run", "own", "size", "loop", "root", "path", "first", "name", "leaf", "tampered", "lot"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# periodic runs


def slow_runs(w: list, least: int = 24, times: int = 3) -> list[tuple]:
    found: dict = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, times * p):
                found.setdefault((start, length), p)
            i += i == start
    return sorted((s, n, p) for (s, n), p in found.items())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slow_digests(doc_id, text) -> tuple:
    w = SEP.findall(text or "")
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = slow_runs(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    rest = " ".join(x for i, x in enumerate(w) if i not in dropped)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(rest))


def test_runs_equal_brute_force(docs, rows):
    got = periodic.digests(periodic.periodic_runs(docs, periodic.looped_tenth())).collect()
    want = [slow_digests(*r[:2]) for r in rows if r[0] != 205]
    assert collections.Counter(tuple(r) for r in got if r[0] != 205) == collections.Counter(want)
    assert sum(r[1] for r in want) > 30


def test_a_long_text_is_one_run(docs):
    r = periodic.periodic_runs(docs.filter("doc_id = 205")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 60_000, 3)] and r["collapsed"] == "again and Again" and r["n_words"] == 60_000


@pytest.mark.parametrize("pairs", [5, 1 << 19])
def test_runs_of_small_alphabets(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "_PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(25):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.choice([0, 1, 23, 24, 90, 200]))]
            for _ in range(2 if w else 0):
                a, p = rng.randrange(len(w)), rng.randint(1, 25)
                loop = w[a : a + p]
                w[a : a + 90] = [loop[i % len(loop)] for i in range(len(w[a : a + 90]))]
            texts.append(w)
        got = periodic.runs_of(np.array(sum(texts, []), np.int32), np.array([len(t) for t in texts], np.int64))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in slow_runs(t)]


def test_hashes_that_agree_by_accident_change_nothing(monkeypatch):
    true = periodic.Extensions.equal
    monkeypatch.setattr(periodic.Extensions, "equal", lambda self, at, p, n: true(self, at, p, n) | ((at * 7 + p * 3 + n) % 5 == 0))
    rng = random.Random(2)
    for _ in range(30):
        w = [rng.randrange(2) for _ in range(60)] + [0, 1, 1] * rng.randint(5, 30) + [rng.randrange(2) for _ in range(60)]
        got = periodic.runs_of(np.array(w, np.int32), np.array([len(w)], np.int64))
        assert [tuple(r)[1:] for r in got.tolist()] == slow_runs(w)
    # words of two letters for which polynomial hashes modulo 2^64 do agree
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    monkeypatch.undo()
    got = periodic.runs_of(np.array(odd * 3 + odd[:1024] + [2], np.int32), np.array([7169], np.int64))
    assert [tuple(r)[1:] for r in got.tolist()] == [(0, 7168, 2048)]


# manifests


def slow_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths: list[list] = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 8, len(nodes))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        below = [[leaf for i in run for leaf in below[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def slow_leaf(doc_id, text, lang, source, n_chars) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def slow_manifest(rows) -> list[tuple]:
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(*r)))
    built = {g: slow_tree([slow_leaf(*r) for r in groups[g]]) for g in order}
    root, tops = slow_tree([built[g][0] for g in order])
    out = []
    for g, above in zip(order, tops):
        subroot, paths = built[g]
        for r, path in zip(groups[g], paths):
            path, h = path + above, slow_leaf(*r)
            if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 == 0:
                h = slow_leaf(r[0], r[1] and r[1].translate(ASCII_LOWER), *r[2:])
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], slow_leaf(*r), subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def test_manifest_equals_a_plain_tree(docs, rows):
    got = merkle.manifest_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = slow_manifest(rows)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"Text {i}", "en", "a", 1) for i in range(n)]
    got = merkle.manifest_documents(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(slow_manifest(rows))


def test_equal_rows_over_many_ranges(spark):
    """A row that is the whole table takes all places once."""
    placed = merkle.numbered(spark.range(300).select(F.lit("g").alias("grp"), F.lit(1).alias("key")).repartition(4), ["key"])
    assert sorted(r["at"] for r in placed.collect()) == list(range(300)) and {r["size"] for r in placed.collect()} == {300}


# token files


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(token_files.byte_bpe_path())


def slow_ids(plain, rows) -> list[tuple[object, list[int]]]:
    return [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]


def test_files_hold_what_the_tokenizer_gives(docs, rows, plain):
    files = token_files.write_files(docs, token_files.byte_bpe_path(), length=16, per_batch=4, file_ids=5000)
    found = sorted(token_files.documents_of(files).collect(), key=lambda r: r["file_start"] + r["first"])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found)
    assert got == collections.Counter((d, len(ids), crc(ids)) for d, ids in slow_ids(plain, rows))
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    upto = 0
    for r in found:
        assert r["file_start"] + r["first"] == upto
        upto += r["n_tokens"]
    assert files.count() > 5


def test_sequences_are_equal_and_point_into_the_file(spark, plain, tmp_path):
    rows = [(i, f"text number {i} " * i, None, None, None) for i in range(40)]
    files = token_files.write_files(spark.createDataFrame(rows, DOCS).coalesce(1), token_files.byte_bpe_path(), f"file://{tmp_path}", length=32, per_batch=3)
    stream = [i for _, ids in slow_ids(plain, rows) for i in ids]
    got: list[int] = []
    for row in sorted(files.collect(), key=lambda r: r["file_start"]):
        reader = token_files.SequenceReader(row["folder"], row["name"])
        for k in range(-(-row["n_ids"] // 32)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 32 and ids.dtype == np.uint16 and not ids[~mask].any()
            got += ids[mask].tolist()
        batch = reader.file.get_batch(0)
        assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 32)
        view = next(reader.ids(5, 7))
        assert view.tolist() == stream[row["file_start"] + 5 : row["file_start"] + 12] and not view.flags.owndata
    assert got == stream


def test_files_of_a_failed_attempt_are_never_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    files = token_files.write_files(docs, token_files.byte_bpe_path(), f"file://{tmp_path}")
    before = token_files.documents_of(files).collect()
    (tmp_path / "part-000000-00000-left-over.arrow").write_bytes(b"half a file")
    assert token_files.documents_of(files).collect() == before


def test_blocks_and_odd_characters_equal_the_tokenizer(plain):
    encode, rng = token_files.ByteEncoder(token_files.byte_bpe_path()), random.Random(4)
    letters = "ab AB'sstréveıßªº²١½ⅫŒ\n\t\r\x0b\x1c\x1f\x85\xa0 　日本!?--_12 ɐʰ˥́😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|> x"]) for _ in range(3000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [b"".join(parts) for parts in encode.ids(texts, at_once=50)] == want
    assert [b"".join(encode.blocks(list(token_files.text_blocks(t, 5)))) for t in texts] == want


def test_empty_tables(spark, empty):
    assert merkle.manifest_documents(empty).count() == 0
    assert periodic.digests(periodic.periodic_runs(empty, periodic.looped_tenth())).count() == 0
    assert token_files.documents_of(token_files.write_files(empty, token_files.byte_bpe_path())).count() == 0
