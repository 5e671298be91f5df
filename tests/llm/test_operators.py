"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import bilinear, jpeg, langid, lm, media, mixing, neardup, packing, quality, sharding, token_counts, urlfilter
from verbatlas.llm.text import words
from verbatlas.llm.tokens import PieceEncoder, word_bpe_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SEP = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {
    "en": "the ing tion er on at is of and th".split(),
    "de": "sch ung keit ein der ü ä ß lich zu".split(),
    "fr": "eau tion é è que les oux ment la ê".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n: int = 240, seed: int = 3) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(1, 160))
        if i % 7 == 1 and rows:
            text, lang = rows[rng.randrange(len(rows))][1:3]
        if i % 7 == 2 and rows:  # a near copy of an earlier text
            text, lang = rows[rng.randrange(len(rows))][1:3]
            w = text.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice("abc")
            text = " ".join(w)
        rows.append((i, text, lang, rng.choice(["a", "b", "ä", "c", None]), len(text)))
    rows += [(n, None, "en", "a", 0), (n + 1, "", None, "b", 0), (n + 2, " \n\t ", "de", "c", 3), (n + 3, "word", "en", "b", 4)]
    rows += [(n + 4, "!? 12", "en", "b", 5), (n + 5, "x" * 5000, "en", "a", 5000), (n + 6, "long text here " * 3000, "en", "c", 45000)]
    return rows + rows[-5:-3] + [(None, "no id here at all", "en", "a", 5)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, DOCS)
    # columns that clash with names used inside
    return extra.withColumn("size", F.lit("x")).withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).withColumn("shard", F.lit(3)).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def n_words(text):
    return len(SEP.findall(text or ""))


# mixing


def water_fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, budget = {}, set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets_and_words(docs, rows):
    out = [r.asDict() for r in mixing.plan_mix(docs).collect()]
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    want = water_fill(dict(sizes))
    taken = collections.Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3  # rows that are equal share what is left in whole parts
    again = mixing.plan_mix(docs.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.plan_mix(docs).collect()))


def test_mixing_matches_sorted_keys(docs, rows):
    """The cut found by bins is the one that sorting a whole source finds."""
    out = collections.defaultdict(list)
    for r in mixing._keyed(docs).collect():
        out[r["source"]].append((r["draw_key"], r["doc_id"], r["size"]))
    got = {(r["source"], r["doc_id"], r["size"]): r for r in mixing.plan_mix(docs).collect()}
    for source, items in out.items():
        size = sum(i[2] for i in items)
        target = next(r for k, r in got.items() if k[0] == source)["target"]
        goal = int(target + 0.5)
        epochs, rest = divmod(goal, size)
        for _, doc, n in sorted(items, key=lambda i: i[0]):
            part = min(n, rest)
            rest -= part
            assert abs(got[source, doc, n]["taken"] - epochs * n - part) <= 2


def test_mixed_documents_are_whole(docs, rows):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = {(r[0], r[1]) for r in rows}
    times = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(times) <= texts
    repeats = collections.Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * repeats[k] for k, n in times.items())
    words_out = sum(n_words(k[1]) * n for k, n in times.items())
    assert words_out == pytest.approx(1.5 * sum(n_words(r[1]) for r in rows), rel=0.5)


def test_weighted_draws_prefer_quality(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("word ### " * 20), "en", "s", 0) for i in range(2000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, DOCS), share=0.4)
    got = {r["doc_id"] % 2: r["n"] for r in plan.filter("taken > 0").groupBy("doc_id").count().select("doc_id", F.col("count").alias("n")).collect()}
    clean = plan.filter("taken > 0 and doc_id % 2 = 1").count()
    noisy = plan.filter("taken > 0 and doc_id % 2 = 0").count()
    assert got and clean > 1.2 * noisy


# token counts


def test_piece_encoder_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(word_bpe_path()), PieceEncoder(word_bpe_path(), most_bytes=9000)
    hard = ["It's John'S I'LL 12a_b__ ### naïve Ĳ ﬁ é\u0301 a\u00a0b\u2003c 日本語 🙂x", "<|endoftext|> a <|startoftext|>b", "a\x1cb\x00c", "'s't're", "İstanbul ǅ", "J\u030c E\u0301 ÀÉſ'S ΑΣ", "x" * 70_000 + "é " * 9 + "日" * 50_000]
    rng = random.Random(4)
    hard += ["".join(rng.choice("ab's'tré/1ß€Äſİµ÷Σ \u030cJ\t\x1c日S'LL|") for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts = [r[1] or "" for r in rows] + hard
    for text, ids in zip(texts, own.ids_of([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]
    assert own.left < 500 and sum(map(len, own.known)) < 9000


def test_counts_follow_the_tokenizer_at_unusual_white_space():
    own, rng = PieceEncoder(word_bpe_path()), random.Random(8)
    count = lambda texts: [len(own.ids(s.encode())) // 4 for s in texts]
    for _ in range(600):
        text = "".join(rng.choice("ab'sé日ß \x1c\x1f\x85\xa0\u2003\n.,") for _ in range(rng.randint(0, 30)))
        tree = token_counts.CountTree(text, count, width=1)
        assert tree.total() == count([text])[0]
        at = rng.randint(0, len(text))
        tree.edit(at, at + 2, "'s \x1c")
        text = text[:at] + "'s \x1c" + text[at + 2 :]
        assert tree.text() == text and tree.total() == count([text])[0]


def test_count_tree_follows_any_edit():
    count, rng = (lambda texts: [len(SEP.findall(s)) for s in texts]), random.Random(5)
    for _ in range(150):
        text = prose(rng, "en", rng.randint(0, 60))
        tree = token_counts.CountTree(text, count, width=rng.choice([1, 3, 8]))
        for _ in range(8):
            a, b = sorted(rng.randint(0, len(text) + 3) for _ in range(2))
            new = rng.choice(["", " ", "x", "one two", "\n\n y "])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total() == count([text])[0] and tree.chars[1] == len(text)


def test_edits_are_counted_as_if_encoded_again(spark, rows):
    own = PieceEncoder(word_bpe_path())
    mails = [(90_000 + i, "word " * i + "write to a.b@c.org or 0123456789abcdef0123456789abcdef now " * 2, "en", "a", 0) for i in range(0, 4000, 400)]
    docs = spark.createDataFrame(rows + mails, DOCS)
    out = token_counts.count_edited(token_counts.redactions(docs), word_bpe_path()).collect()
    texts = collections.defaultdict(set)
    for r in rows + mails:
        texts[r[0]].add(r[1] or "")
    assert len(out) == len(rows) + len(mails) and sum(r["n_edits"] for r in out) >= 40
    for r in out:
        options = []
        for t in texts[r["doc_id"]]:
            cut = re.sub(token_counts.PRIVATE, "[removed]", t, flags=re.ASCII)
            options.append((len(own.ids(t.encode())) // 4, len(own.ids(cut.encode())) // 4))
        assert (r["n_tokens"], r["edited_tokens"]) in options
    far = max(out, key=lambda r: r["n_chars"] if r["n_edits"] else 0)
    assert 0 < far["encoded_chars"] < far["n_chars"]


# packing


def test_packing_is_gapless_and_tight(docs, rows):
    cap = 64
    out = packing.pack_documents(docs, word_bpe_path(), cap, 1).collect()
    own = PieceEncoder(word_bpe_path())
    want = collections.Counter()
    for r in rows:
        ids = own.ids((r[1] or "").encode()) + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 4 * cap):
            want[r[0], k // (4 * cap), k // 4, len(ids[k : k + 4 * cap]) // 4, zlib.crc32(ids[k : k + 4 * cap])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap
    assert len(sequences) <= sum(r["length"] for r in out) / cap * 1.1 + 1


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.randint(5, 60)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(1, 200))]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, gap in enumerate(bins) if gap >= n]
            i = min(fit, key=lambda i: bins[i]) if fit else len(bins)
            bins[i:i + 1] = [(bins[i] if fit else cap) - n]
        plan = packing.plan_slots(dict(collections.Counter(lengths)), cap)
        ids = set()
        for k, (length, rank, first, each, offset) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else collections.Counter(lengths)[length]
            ids |= {first + j // each for j in range(end - rank)}
        assert len(ids) == len(bins)


# media


def test_media_round_trip(docs, rows):
    out = media.read_back(media.stored(docs), tensors=True).collect()
    want = collections.Counter()
    for r in rows:
        body = (r[1] or "").encode()
        p = media.padded(body)
        want[r[0], len(body), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in out)


def slow_pixels(image) -> np.ndarray:
    """RGB by the defining sums."""
    planes = []
    for p in image.parts.values():
        plane = np.zeros((8 * p.high, 8 * p.wide))
        for b, c in enumerate(p.coefficients):
            f = np.zeros(64)
            f[jpeg.ZIGZAG] = c * image.quantizers[p.table]
            f = f.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
                    plane[8 * (b // p.wide) + y, 8 * (b % p.wide) + x] = min(255, max(0, np.floor(s + 128.5)))
        planes.append(plane)
    y, cb, cr = planes[0], planes[1].repeat(2, 0).repeat(2, 1) - 128, planes[2].repeat(2, 0).repeat(2, 1) - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.floor(rgb + 0.5), 0, 255)


def test_inverse_transform_and_chroma():
    image = jpeg.decode(jpeg.encode_bytes(bytes(range(256)) * 2))
    fast = np.concatenate(list(jpeg.strips(image, 1)))
    assert np.abs(fast - slow_pixels(image)).max() <= 2


class Writer:
    """Bits of a hand-made scan."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self) -> bytes:
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def test_general_scans_with_runs_and_refinement():
    """A grey image with sparse coefficients: zero runs, end-of-band runs, new and corrected values, restarts."""
    rng = random.Random(4)
    blocks = np.zeros((6, 64), int)  # 24 x 16 samples
    for b in (0, 1, 4):
        for _ in range(9):
            blocks[b, rng.randint(1, 63)] = rng.choice([-5, -3, -2, -1, 1, 2, 3, 6])
    blocks[1, 40], blocks[1, 1:40] = 3, 0
    blocks[:, 0] = [4, -3, 10, 0, 7, -20]
    symbols = sorted({0x00, 0x10, 0xF0} | {16 * r + s for r in range(16) for s in (1, 2, 3)})
    ac = jpeg._table(1, [0] * 5 + [len(symbols)] + [0] * 10, symbols)
    code = {s: i for i, s in enumerate(symbols)}
    dc = jpeg._table(0, [0, 0, 0, 7] + [0] * 12, list(range(7)))
    frame = jpeg._segment(0xC2, b"\x08\x00\x10\x00\x18\x01\x01\x11\x00")
    w, pred = Writer(), 0
    for v in blocks[:, 0]:
        d, pred = v - pred, v
        s = int(abs(d)).bit_length()
        w.put(s, 4)
        w.put(d if d > 0 else d + (1 << s) - 1, s)
    scans = [dc, jpeg._scan([1], 0, 0, 0, 0, w.done()), ac]

    def shifted(v: int) -> int:
        return (abs(v) >> 1) * (1 if v > 0 else -1)

    w, run = Writer(), 0

    def flush():
        nonlocal run
        while run:
            if run >= 2:
                w.put(code[0x10], 6), w.put(min(run, 3) - 2, 1)
                run -= min(run, 3)
            else:
                w.put(code[0x00], 6)
                run -= 1

    for b in blocks:
        k = last = 0
        for k in range(1, 64):
            v = shifted(b[k])
            if v:
                flush()
                zeros = k - last - 1
                while zeros > 15:
                    w.put(code[0xF0], 6)
                    zeros -= 16
                s = int(abs(v)).bit_length()
                w.put(code[16 * zeros + s], 6)
                w.put(v if v > 0 else v + (1 << s) - 1, s)
                last = k
        if last < 63:
            run += 1
    flush()
    scans.append(jpeg._scan([1], 1, 63, 0, 1, w.done()))
    w = Writer()
    for b in blocks:
        zeros, fixes, last_new = 0, [], max([k for k in range(1, 64) if abs(b[k]) == 1], default=0)
        for k in range(1, 64):
            if abs(b[k]) > 1:
                fixes.append(abs(b[k]) & 1)
            elif b[k]:
                w.put(code[16 * zeros + 1], 6), w.put(int(b[k] > 0), 1)
                for f in fixes:
                    w.put(f, 1)
                zeros, fixes = 0, []
            else:
                zeros += 1
                if zeros == 16 and k < last_new:
                    w.put(code[0xF0], 6)
                    for f in fixes:
                        w.put(f, 1)
                    zeros, fixes = 0, []
        if last_new < 63:
            w.put(code[0x00], 6)
            for f in fixes:
                w.put(f, 1)
    scans.append(jpeg._scan([1], 1, 63, 1, 0, w.done()))
    image = jpeg.decode(b"\xff\xd8" + jpeg._FLAT + frame + b"".join(scans) + b"\xff\xd9")
    assert (image.parts[1].coefficients == blocks).all()
    assert next(jpeg.strips(image)).shape == (16, 24, 3)


# language identification


def test_language_id_held_out(docs, rows):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    lang = {r[0]: (r[2], r[1]) for r in rows}
    tried = right = 0
    for r in out:
        own, text = lang[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif r["held_out"] and len(text) > 200 and r["doc_id"] is not None and r["doc_id"] % 7 not in (1, 2) and r["doc_id"] < 240:
            tried += 1
            right += r["lang_pred"] == own
    assert tried > 15 and right >= 0.95 * tried


def test_language_id_edges(spark, empty):
    assert langid.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None, "a", 1)], DOCS)
    assert langid.identify(nothing).first()["lang_pred"] == "und"
    single = spark.createDataFrame([(i, "some text", "en", "a", 1) for i in range(9)], DOCS)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(single).collect()} == {("en", 1.0)}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= {2: 1, 3: 2, 4: 4, 5: 8}.get(n, 8)


# quality


def slow_base(text: str) -> tuple:
    w = SEP.findall(text)
    lines = [x for x in text.split("\n") if SEP.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality_counts_and_verdicts(spark, docs, rows):
    rng = random.Random(8)
    more = [(1000 + i, prose(rng, "en", 60) if i % 2 else " | ".join(prose(rng, "en", 60).split()) + " ###", "en", "a", 0) for i in range(200)]
    more += [(2000, "one two three four five six seven eight nine ten\n" * 3 + "\n \n", "en", "a", 0), (2001, "é\u00a0ü x\x1cy", "en", "a", 0)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(r[0], r[1]) for r in more], "doc_id long, text string"))
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(150)] + [(None, 1, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.verdicts(table, labels).collect()
    texts = collections.defaultdict(set)
    for r in rows + more:
        texts[r[0]].add(slow_base(r[1] or ""))
    assert len(out) == len(rows) + len(more)
    for r in out:
        base = tuple(r)[1:6]
        assert base in texts[r["doc_id"]]
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] and 1150 <= r["doc_id"] < 1200:
            assert r["kept"] == bool(r["doc_id"] % 2)


def test_quality_edges(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(empty, none) is None and quality.judge(empty, None).count() == 0


# near-duplicates


def slow_classes(rows, k: int, percent: int) -> dict:
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        if r[0] is None:
            continue
        w = SEP.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        n = min(k, len(w))
        sets[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        parent[r[0]] = r[0]
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, k):
    out = neardup.classes(docs, k, 80).collect()
    want = slow_classes(rows, k, 80)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({r["component_id"] for r in out}) < len(want) - 20


def test_chains_and_thresholds(spark):
    """Each text is near the next only; ends are far apart. And pairs right at the threshold."""
    base = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(base[20 * i : 20 * i + 200]), "en", "a", 0) for i in range(10)]
    exact = [(100, " ".join(f"a{i}" for i in range(91)), "en", "a", 0), (101, " ".join(f"a{i}" for i in range(10, 101)), "en", "a", 0)]
    exact += [(102, " ".join(f"b{i}" for i in range(90)), "en", "a", 0), (103, " ".join(f"b{i}" for i in range(10, 100)), "en", "a", 0)]
    rows = chain + exact
    out = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark.createDataFrame(rows, DOCS), 2, 80).collect()}
    assert out == {k: v[1] for k, v in slow_classes(rows, 2, 80).items()}
    assert out[9] == 0 and out[101] == 100


def test_deduplicated_keeps_one_of_each(docs, rows, empty):
    kept = neardup.deduplicated(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in slow_classes(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} - {None} == want
    assert neardup.classes(empty).count() == 0


def test_many_look_alikes_that_are_not_linked(spark, monkeypatch):
    """Texts that share half of their words lie in common buckets; a few are linked. The grid has many cells here."""
    monkeypatch.setattr(neardup, "CELL", 7)
    rng, words_ = random.Random(6), [f"w{i}" for i in range(3000)]
    stem = words_[:120]
    rows = []
    for i in range(150):
        own = list(stem)
        for at in rng.sample(range(120), 28):
            own[at] = rng.choice(words_)
        rows.append((i, " ".join(own), "en", "a", 0))
    rows += [(200 + i, rows[i][1] + " end", "en", "a", 0) for i in range(0, 60, 3)]
    out = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark.createDataFrame(rows, DOCS), 2, 80).collect()}
    want = {k: v[1] for k, v in slow_classes(rows, 2, 80).items()}
    assert out == want and len(set(want.values())) == 150


def test_text_ids_keep_their_type(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([("b", text), ("a", text), ("c", "other words here"), ("d", None)], "doc_id string, text string")
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.classes(docs, 2, 80).collect()}
    assert out == {"a": ("a", True), "b": ("a", False), "c": ("c", True), "d": ("d", True)}
    assert {r["doc_id"] for r in neardup.deduplicated(docs, 2, 80).collect()} == {"a", "c", "d"}


def test_long_words_of_two_letters_are_told_apart():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    assert words(a.encode())[0] != words(b.encode())[0]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (55, 60), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 55: 50, 60: 50}


# sharding


def test_shards_are_exact_and_whole(docs, rows, empty):
    out = sharding.shard_documents(docs, 16).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter(tuple(r)[:3] for r in out) == want
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert sorted(shards) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_documents(empty, 16).count() == 0


def test_hypergeometric_law(spark):
    cases = [(300, 1000, 400), (800, 1000, 15), (700, 1000, 800), (5, 40, 25), (60_000_000, 1_000_000_000, 5_000_000)]
    columns = [F.expr(sharding.hypergeometric(f"{g}L", f"{t}L", f"{n}L", f"id, {i}")).alias(f"c{i}") for i, (g, t, n) in enumerate(cases)]
    draws = spark.range(8000).select(*columns).toPandas()
    for i, (g, t, n) in enumerate(cases):
        x, p = draws[f"c{i}"], g / t
        var = n * p * (1 - p) * (t - n) / (t - 1)
        assert abs(x.mean() - n * p) < 5 * (var / 8000) ** 0.5
        assert x.var() == pytest.approx(var, rel=0.1)
        assert x.min() >= max(0, n + g - t) and x.max() <= min(n, g)


def test_matrix_sums(spark):
    sizes = spark.createDataFrame([(b, 50 * b) for b in range(8)], "block long, n long")
    out = {r["block"]: r["counts"] for r in sharding.communication_matrix(sizes, [350] * 4, 8).collect()}
    assert [sum(out[b]) for b in range(8)] == [50 * b for b in range(8)]
    assert np.array(list(out.values())).sum(0).tolist() == [350] * 4 and min(map(min, out.values())) >= 0


# URL filter


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules_and_list(spark):
    urls = ["http://A.Example.ORG/es/x", "http://example.org/en/1?x", "https://example.org/en/2", "http://x.org", "ftp://y.com/fr/?q#z", "http://y.com/de/1"]
    urls += ["http://y.com/dex", None, "no scheme", "", "x://", "http://bad.net/a/b/c", "http://sub.bad.net", "http://notbad.net/", "http://part.net/p/q", "http://part.net/pq"]
    urls += ["http://u@h:80/a\nb?c", "a://b://c/d", "http://Ünder.ORG/é", "http://bad.net/a/b/c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    entries = ["bad.net", "part.net/p", "x.org"]
    out = {r["page_id"]: r for r in urlfilter.judge(pages, urlfilter.RULES, entries).collect()}
    # a list above the bound is joined, with equal results
    assert out == {r["page_id"]: r for r in urlfilter.judge(pages, urlfilter.RULES, entries, most=1).collect()}
    for i, url in enumerate(urls):
        host, path = slow_url(url)
        fits = [(len(r), r, v) for v, r in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        listed = host == "bad.net" or host.endswith(".bad.net") or host == "x.org" or (host == "part.net" and (path + "/").startswith("/p/"))
        assert tuple(out[i]) == (i, host, path, rule, verdict or ("block" if listed else "allow")), url


def test_digest_index_confirms_strings(tmp_path, spark):
    entries = [f"host{i}.net/é{i}" for i in range(5000)]
    paths = urlfilter.write_index(entries + entries[:7], str(tmp_path), "i")
    keys = np.load(paths[0])
    assert (np.diff(keys.astype(object)) > 0).all() and len(keys) == 5000
    np.save(paths[0], np.full(5000, keys[0]))  # all keys collide: only the strings decide
    index = urlfilter.DigestIndex(*paths)
    index.keys = np.sort(keys)
    assert index.contains([e.encode() for e in entries]).all() and not index.contains([b"other", b""]).any()
    none = urlfilter.DigestIndex(*urlfilter.write_index([], str(tmp_path), "n"))
    assert not none.contains([b"x"]).any()
    pages = spark.createDataFrame([(1, "host1.net", "/é1/z"), (2, "host1.net", "/q")], "page_id long, host string, path string")
    for host, path in (("a.b.c", "/x//y/"), ("a", ""), ("", "/q"), ("é.net", "/ü")):
        row = spark.createDataFrame([(host, path)], "h string, p string")
        assert sorted(row.select(urlfilter.candidate_entries(F.col("h"), F.col("p"), 9, 9)).first()[0]) == sorted(urlfilter.candidates(host, path))
    assert urlfilter.extent(["a.b/c/d", "net", "x.y.z"]) == (3, 2) and urlfilter.extent([]) == (0, 0)
    assert urlfilter.candidates("a.b.c.d", "/x/y/z", 2, 1) == ["c.d", "d", "c.d/x", "d/x"]
    assert len(urlfilter.candidates("a." * 5000 + "net", "/b" * 5000, 3, 2)) == 9
    row = spark.createDataFrame([("a.b.c.d", "/x/y/z"), ("a." * 5000 + "net", "/b" * 5000)], "h string, p string")
    cut = [sorted(r[0]) for r in row.select(urlfilter.candidate_entries(F.col("h"), F.col("p"), 2, 1)).collect()]
    assert cut == [sorted(urlfilter.candidates("a.b.c.d", "/x/y/z", 2, 1)), sorted(urlfilter.candidates("a." * 5000 + "net", "/b" * 5000, 2, 1))]
    assert urlfilter.measured(spark.createDataFrame([("a.b/c/d",), ("net",), ("x.y.z",)], "entry string")) == (3, 2)
    joined = urlfilter.blocked_by_join(pages, spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert {r["page_id"]: r["listed"] for r in joined.collect()} == {1: True, 2: False}


# language model


def test_base_scores_and_counts(docs, rows):
    lower = lambda t: SEP.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*lower(r[1]), None])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for r in rows:
        w = [*lower(r[1]), None]
        base = sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want[r[0]].append((len(w), sum(counts[x] > 0 for x in w), base))
    full = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    tail = lm.score(docs, ~F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 1"), head=400).collect()
    assert len(tail) == len(rows)
    for r in tail:
        assert r["train_tokens"] == total
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2]) for x in want[r["doc_id"]])
        assert r["score"] == pytest.approx(full[r["doc_id"]]["score"], rel=1e-4)  # what is joined equals what is broadcast
        assert full[r["doc_id"]]["held_out"] == held(r["doc_id"])
    own = [full[r[0]] for r in rows[:240] if held(r[0])]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_model_is_normalised():
    rng = np.random.default_rng(1)
    starts = np.array([0, 5, 9, 10, 17, 18])
    share = rng.random(18)
    model = bilinear.start(share / share.sum(), starts)
    trainer = bilinear.Trainer(model, 1)
    trainer.learn(*rng.integers(0, 18, (3, 5000)))
    for net in (model, trainer.model):
        one, two = np.repeat(rng.integers(0, 18, (2, 30)), 18, axis=1)
        p = 10.0 ** net.log10(one, two, np.tile(np.arange(18), 30))
        assert np.allclose(p.reshape(30, 18).sum(1), 1, atol=1e-5)
    first = 10.0 ** model.log10(np.zeros(18, int), np.zeros(18, int), np.arange(18))
    assert np.allclose(first, share / share.sum(), rtol=0.6)


def test_model_learns_context():
    """b follows a, c follows d; the model has to say so, although they are in one cluster."""
    rng = np.random.default_rng(2)
    model = bilinear.start(np.full(6, 1 / 6), np.array([0, 3, 5, 6]))
    trainer = bilinear.Trainer(model, 3)
    for _ in range(150):
        one = rng.integers(3, 5, 1000)
        trainer.learn(one, rng.integers(0, 6, 1000), np.where(one == 3, 1, 2))
    p = 10.0 ** trainer.model.log10(np.array([3, 4, 3]), np.array([0, 5, 2]), np.array([1, 2, 2]))
    assert p[0] > 0.8 and p[1] > 0.8 and p[2] < 0.1


def test_units_and_scores_grow_with_the_corpus(spark):
    """More text, more units of its own; words in context score better than alone on texts the model has not seen."""
    rng, rows = random.Random(9), []
    following = {f"w{i}": [f"w{(i * 7 + j) % 300}" for j in range(3)] for i in range(300)}
    for i in range(900):
        word, text = f"w{rng.randrange(300)}", []
        for _ in range(120):
            text.append(word)
            word = rng.choice(following[word])
        rows.append((i, " ".join(text), "en", "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    sizes = [lm.vocabulary(lm.word_counts(docs.filter(f"doc_id < {n}"))).own for n in (20, 100)]
    assert sizes == [min(300, lm.units_for(121 * n)) for n in (20, 100)] and sizes[0] < sizes[1]
    out = lm.score(docs, F.col("doc_id") % 5 != 1).filter("doc_id % 5 = 1").collect()
    assert sum(r["score"] for r in out) > 0.7 * sum(r["base_score"] for r in out)


def test_scores_equal_a_plain_softmax(docs, rows):
    """Over all units at once, in double precision, text by text; the units' probabilities sum up to 1."""
    learned = lm.train(docs.filter("doc_id < 150"), head=300)
    vocab, net = learned.vocab, learned.model
    counts = {r["key"]: r["n"] for r in learned.counts.collect()}
    wide = lambda name: getattr(net, name).astype(np.float64)
    first, second, cluster, unit = map(wide, bilinear.Bilinear.PARTS)
    owner = np.repeat(np.arange(len(net.starts) - 1), np.diff(net.starts))

    def chances(one, two):
        h = first[one] + second[two]
        c = np.exp(cluster[:, :-1] @ h + cluster[:, -1])
        u = np.exp(unit[:, :-1] @ h + unit[:, -1])
        p = (c / c.sum())[owner] * u / np.bincount(owner, u)[owner]
        assert p.sum() == pytest.approx(1)
        return p

    got = collections.defaultdict(list)
    for r in lm.apply(docs, learned).collect():
        got[r["doc_id"]].append(r["score"])
    for doc_id, text, *_ in rows[:60] + rows[240:246]:
        keys, tails = lm.tokens((text or "").encode())
        units = [vocab.end, vocab.end, *vocab.classify(keys, tails), vocab.end]
        total = sum(np.log10(chances(units[i - 1], units[i - 2])[units[i]]) for i in range(2, len(units)))
        for key, u in zip(keys.view(np.int64).tolist(), units[2:]):
            if u >= vocab.own:  # one of several words of its unit
                total += np.log10((counts.get(key, 0) + 0.5) / (vocab.mass[u] + 0.5 * (vocab.types[u] + 1)))
        assert any(s == pytest.approx(total, rel=1e-4, abs=1e-3) for s in got[doc_id])


def test_copies_are_averaged_by_what_they_saw(docs):
    """Two copies, one of which never met a word, give that word the other's row."""
    texts = docs.select(F.lit(1).alias("doc_id"), F.lit("a b a b").alias("text")).limit(20)
    vocab = lm.vocabulary(lm.word_counts(texts))
    one, two = (lm.fit(texts.repartition(n), vocab, 1, n) for n in (1, 2))
    assert all(np.isfinite(getattr(x, p)).all() for x in (one, two) for p in bilinear.Bilinear.PARTS)
    assert (lm.copies_for(10**5), lm.copies_for(10**9)) == (1, 100)


def test_most_frequent_words_without_a_sort(spark):
    rng = random.Random(5)
    n = {k: rng.choice([1, 1, 1, 2, 3, 50, 5000 + k % 7]) for k in (rng.getrandbits(63) for _ in range(900))}
    counts = spark.createDataFrame([(k, 0, v) for k, v in n.items()], "key long, ending int, n long")
    for head in (0, 1, 130, 400, 900, 1000):
        got = {r["key"] for r in lm.most_frequent(counts, head).collect()}
        assert min(head, 900) - 5 <= len(got) <= head
        rest = [v for k, v in n.items() if k not in got]
        if got and rest and min(n[k] for k in got) < 1024:
            assert min(n[k] for k in got) >= max(rest)


def test_lm_edges(spark, empty):
    assert lm.score_documents(empty).count() == 0
    unseen = spark.createDataFrame([(1, "a b", "en", "a", 0)], DOCS)
    out = lm.score(unseen, F.lit(False)).first()
    assert (out["n_tokens"], out["n_known"], out["train_tokens"], out["score"]) == (3, 0, 0, 0.0)
    assert out["base_score"] == pytest.approx(0)


def test_word_hashes_tell_words_apart(rows):
    seen = {}
    for r in rows:
        body = (r[1] or "").encode()
        hashes, tails = words(body)
        assert len(hashes) == len(body.split())
        for w, h, t in zip(body.split(), hashes.tolist(), tails.tolist()):
            assert seen.setdefault(w, h) == h and t % 256 == w[-1]
    assert len(set(seen.values())) == len(seen)
    import verbatlas.llm.text as text

    body, block = b" ".join(b"w%d" % i for i in range(3000)) + b" " + b"z" * 900, text.BLOCK
    whole = words(body)[0]
    try:
        text.BLOCK = 200
        assert (words(body)[0][:-1] == whole[:-1]).all()
    finally:
        text.BLOCK = block


def test_empty_tables(spark, empty):
    assert packing.pack_documents(empty, word_bpe_path()).count() == 0
    assert media.read_back(media.stored(empty)).count() == 0
    assert mixing.plan_mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert token_counts.count_edited(token_counts.redactions(empty), word_bpe_path()).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.RULES, []).count() == 0
    assert neardup.deduplicated(empty).count() == 0


def test_texts_without_words(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["", None, " ", "", "\n"])]
    blank = spark.createDataFrame(rows, DOCS)
    assert [r["taken"] for r in mixing.plan_mix(blank).collect()] == [0] * 5
    assert {(r["n_shingles"], r["component_id"] == r["doc_id"], r["kept"]) for r in neardup.classes(blank).collect()} == {(0, True, True)}
    assert {r["length"] for r in packing.pack_documents(blank, word_bpe_path()).collect()} == {1}
    assert not quality.judge(blank, None).filter("kept").count()


def test_pipeline_runs_all_stages(spark, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert kept.exceptAll(before).count() == 0
        before = kept
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    sizes = {r["doc_id"]: r["n"] for r in out.filter("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {r["doc_id"]: r["n"] for r in before.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
