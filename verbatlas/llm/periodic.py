"""Periodic runs of words, found on a harmonic grid by prefix hashes.

A run is a maximal stretch of words with smallest period q, at least max(24, 3 q) words long. For every period p the grid holds the
multiples of p, n / p points of a text of n words, so all periods together have about n ln n. A run of period p contains a grid point
among its first p words from which it goes on, p words apart, for more than p words: one probe of the prefix hashes tests that
for all (period, grid point) pairs at once. Of consecutive points that pass only the first is kept, as they lie in one run. For all kept
pairs together, binary searches over the prefix hashes give the longest common extension to the right and to the left, hence a
candidate run; among candidates that cover the same words the smallest period stays. Then the words are compared: hashes that agree
by accident can only make a candidate too long, and such a period is done again word by word.

Words are numbered exactly (by a dictionary, not by hashes) and several texts are worked on side by side, with a boundary that
equals nothing between them. Pairs are made in chunks, so memory grows with the words of one text, not with its pairs. Nothing is shuffled.

Defined results: null and blank texts have no words, no runs and an empty rest; very long texts are searched whole, their words taken block by
block; a single very long word is one word; repeated rows get equal results; an empty table gives no rows; other columns are ignored, whatever their names;
a null id counts as the empty text where ids choose (`looped_tenth`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import crc_mod

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Pairs made at once, and words joined at once.
_PAIRS, _JOINED = 1 << 19, 1 << 16
_BASE = 0x9E3779B97F4A7C55


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Extensions:
    """Longest common extensions of texts of word numbers that stand side by side, by prefix hashes modulo 2^64."""

    def __init__(self, words: np.ndarray):
        from .text import mix

        self.power = np.full(len(words) + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.upto = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * self.power[: len(words)], out=self.upto[1:])

    def equal(self, at: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from `at` on, and those p further, have equal hashes over the length."""
        there = at + p
        return (self.upto[at + length] - self.upto[at]) * self.power[p] == self.upto[there + length] - self.upto[there]

    def right(self, at: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For all pairs at once, the longest length up to `most` that is equal to the right."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(at, p, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def left(self, at: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same to the left of `at`."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(at - middle, p, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by keys, those that differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _candidates(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (begin, end, period, text) of candidate runs, each at least as long as a true one."""
    found = [np.empty((0, 4), np.int64)]
    hashes = Extensions(words)
    most = sizes // times * (sizes >= least)
    text = np.repeat(np.arange(len(sizes)), most)
    period = _ranges(most) + 1
    probe = np.maximum(least + 1 - 2 * period, (times - 2) * period + 1)
    # grid points of the text from which the probe still fits
    points = np.maximum((sizes[text] - period - probe) // period + 1, 0)
    upto = np.cumsum(points)
    at = 0
    while at < len(points):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        # a period with very many points goes alone, in parts that overlap by one point
        for low in range(0, max(int(points[at]), 1) if end == at + 1 else 1, _PAIRS):
            count = np.minimum(points[at:end] - low, _PAIRS + 1) if end == at + 1 else points[at:end]
            p, of = np.repeat(period[at:end], count), np.repeat(text[at:end], count)
            k = _ranges(count) + low
            j = begins[of] + k * p
            near = np.flatnonzero(words[j] == words[j + p])
            p, of, k, j = p[near], of[near], k[near], j[near]
            length = np.maximum(least + 1 - 2 * p, (times - 2) * p + 1)
            near = np.flatnonzero(hashes.equal(j, p, length))
            p, of, k, j = p[near], of[near], k[near], j[near]
            if not len(p):
                continue
            first = np.ones(len(p), bool)
            first[1:] = (p[1:] != p[:-1]) | (of[1:] != of[:-1]) | (k[1:] != k[:-1] + 1)
            p, of, j = p[first], of[first], j[first]
            right = hashes.right(j, p, begins[of] + sizes[of] - j - p)
            left = hashes.left(j, p, j - begins[of])
            rows = np.stack([j - left, j + p + right, p, of], 1)
            found.append(rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, times * p)])
        at = end
    return np.concatenate(found)


def _word_by_word(words: np.ndarray, begin: int, size: int, p: int, least: int, times: int) -> np.ndarray:
    """(begin, end) of all maximal stretches of period p in one text, by comparing the words."""
    text = words[begin : begin + size]
    same = np.zeros(size - p + 2, np.int8)
    same[1:-1] = text[p:] == text[: size - p]
    edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] + p >= max(least, times * p)]
    return np.stack([begin + edges[:, 0], begin + edges[:, 1] + p], 1)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in order, of texts of word numbers one after the other.

    sizes are the texts' words; starts count within the text.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    rest = _candidates(words, begins, sizes, least, times)
    rest = np.unique(rest, axis=0)  # by begin, end, period
    good = [np.empty((0, 4), np.int64)]
    while len(rest):
        heads = _first_of_groups(rest[:, 0], rest[:, 1])
        failed = []
        for i in heads.tolist():
            begin, end, p, text = rest[i].tolist()
            if np.array_equal(words[begin : end - p], words[begin + p : end]):
                good.append(rest[i : i + 1])
            else:
                failed.append(i)
                exact = _word_by_word(words, int(begins[text]), int(sizes[text]), p, least, times)
                good.append(np.column_stack([exact, np.full((len(exact), 2), (p, text))]))
        again = np.zeros(len(rest), bool)
        for i in failed:  # the next period of a candidate that was too long has its turn
            begin, end = rest[i, 0], rest[i, 1]
            again |= (rest[:, 0] == begin) & (rest[:, 1] == end)
            again[i] = False
        rest = rest[again]
    rows = np.unique(np.concatenate(good), axis=0)
    rows = rows[_first_of_groups(rows[:, 0], rows[:, 1])]
    return np.column_stack([rows[:, 3], rows[:, 0] - begins[rows[:, 3]], rows[:, 1] - rows[:, 0], rows[:, 2]])


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that are left when each run (start, length, period) keeps its first period only."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def _numbered(body: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text by number; new words get the next ones."""
    from .text import blocks

    parts = [np.empty(0, np.int32)]
    for block, _ in blocks(body):
        parts.append(np.array([known.setdefault(w, len(known)) for w in block.split()], np.int32))
    return np.concatenate(parts)


def periodic_runs(docs: DataFrame, loop: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed (the words left, joined by a blank).

    Where loop (a number for each row) is given and not null, the text's tail is first replaced by a loop of its own words: with n words,
    a = loop % n and p = 1 + (n - a) // (3 + loop % 8), each word i from a on becomes word a + (i - a) % p.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import bodies, slices

        for batch in (x for whole in batches for x in slices(whole, 1)):
            known: dict[bytes, int] = {}
            texts = [_numbered(body or b"", known) for body in bodies(batch.column(1))]
            for ids, loop in zip(texts, batch.column(2).to_pylist(), strict=True):
                if loop is not None and len(ids):
                    a = loop % len(ids)
                    p = 1 + (len(ids) - a) // (3 + loop % 8)
                    ids[a:] = ids[a + np.arange(len(ids) - a) % p]
            sizes = np.array([len(ids) for ids in texts], np.int64)
            rows = runs_of(np.concatenate([np.empty(0, np.int32), *texts]), sizes, least, times)
            vocabulary = list(known)
            cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
            rests = []
            for k, ids in enumerate(texts):
                own = rows[cuts[k] : cuts[k + 1], 1:]
                left = ids[kept_words(len(ids), own)] if len(own) else ids
                parts = (b" ".join(map(vocabulary.__getitem__, left[i : i + _JOINED].tolist())) for i in range(0, len(left), _JOINED))
                rests.append(b" ".join(parts))
            one = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), one)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), runs, pa.array(rests, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string"), (F.lit(None) if loop is None else loop).cast("long").alias("loop")).mapInArrow(found, spec)


def looped_tenth() -> Column:
    """Of a tenth of the documents, by the crc32 of their ids, the number that makes a loop with known runs of their tail."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.when(crc_mod(F.col("doc_id"), 10) == 0, F.floor(h / 10))


def digests(found: DataFrame) -> DataFrame:
    """Of a table of runs: their number, the one that repeats most often, and digests of all runs and of the collapsed text.

    Repeats are compared as exact fractions; of equal ones the first run stays, which has the smallest start and then period.
    """
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(more(b, r), r).otherwise(b))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", line), ""))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
