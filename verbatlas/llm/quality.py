"""Quality rules: plain counts, then a logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of the documents that `labels` rates (`most` of them at most, those with the smallest hashes of
the id, each once however often it is repeated), calibrated by a sigmoid on rows of the sample that the fit did not see, and applied to every
whole text, a few MB of an Arrow batch after another, against a fixed threshold of probability.

Defined results: null and empty text have counts of 0, fail the base rule and are not kept; without
labels, or with labels of one kind only, the base rule alone decides; a document with several labels
counts as good if one of them says so; repeated rows get equal results; an empty table gives no rows; a very long text is read in
blocks, to its end; other columns, also of labels, are ignored or carried along as they are, whatever their names.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import carried, give_back, restored
from .langid import fitted, matrix
from .text import IS_WHITE, LOWER, WHITE, bodies, ngram_counts, slices, words

CHAR_DIM = WORD_DIM = 2048
WINDOW = 8
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside runs of `width` words that occur twice or more in the text, first ones included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    # names of runs of 1, 2, 4, 8 words: equal runs get equal numbers, without hash collisions
    names, length = np.unique(hashes, return_inverse=True)[1].astype(np.int64), 1
    while length < width:
        step = min(length, width - length)
        pairs = names[:-step] * np.int64(len(hashes) + 1) + names[step:]
        names, length = np.unique(pairs, return_inverse=True)[1].astype(np.int64), length + step
    twice = np.bincount(names) > 1
    at = np.flatnonzero(twice[names])
    if not len(at):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(body: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """The five counts of BASE for one text."""
    a = np.frombuffer(body, np.uint8)
    chars = int((((a & 0xC0) != 0x80) & ~IS_WHITE[a]).sum())
    lines = [x for x in body.split(b"\n") if x.strip(WHITE)]
    return len(hashes), chars, int(IS_SYMBOL[a].sum()), len(lines) - len(set(lines)), repeated_words(hashes)


def features(body: bytes, hashes: np.ndarray) -> np.ndarray:
    """Square roots of shares of hashed characters' and words' n-grams, side by side."""
    chars = ngram_counts(body, LOWER, CHAR_DIM)
    of_words = np.bincount((hashes % np.uint64(WORD_DIM)).astype(np.int64), minlength=WORD_DIM)
    if len(hashes) > 1:
        pairs = (hashes[:-1] * np.uint64(31) ^ hashes[1:]) >> np.uint64(20)
        of_words += np.bincount((pairs % np.uint64(WORD_DIM)).astype(np.int64), minlength=WORD_DIM)
    both = [np.sqrt(c / max(1, c.sum())) for c in (chars, of_words)]
    return np.concatenate(both).astype(np.float32)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -30, 30)))


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over scores f for labels y in {0, 1}, by Newton steps on smoothed labels."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, z.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, most: int = 2500, steps: int = 150, threshold: float = 0.5) -> QualityModel | None:
    """Fit on `most` labelled documents at most; None if there are not both kinds.

    The sample has a fixed number of ids, so broadcasting them is bounded; a document with many texts is in it with one of them.
    """
    rated = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rated = rated.groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = rated.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())
    sample = sample.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sample.select("good", F.xxhash64("doc_id", "text").alias("key"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 2)):
            x = [features(b, words(b)[0]).astype(np.float16).tobytes() for b in bodies(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(x, pa.binary())], ["good", "key", "x"])

    rows = sample.mapInArrow(vectors, "good int, key long, x binary").toArrow()
    if not rows.num_rows:
        return None
    at, x = matrix(rows, "key", "x")
    y = rows["good"].to_numpy().astype(np.float32)[at]
    del rows
    if y.min() == y.max():
        return None
    sign = (2 * y - 1)[:, None]
    fold = np.arange(len(y)) % 4 == 3
    slope, shift = 1.0, 0.0
    if len({*y[~fold]}) == 2 and len({*y[fold]}) == 2:
        w, b = fitted(x, sign, steps, 1e-5, ~fold)
        slope, shift = _calibrate((x[fold] @ w + b)[:, 0], y[fold])
    w, b = fitted(x, sign, steps, 1e-5)
    return QualityModel(w[:, 0], float(b[0]), slope, shift, threshold)


def judge(docs: DataFrame, model: QualityModel | None, keep: list[str] | None = None) -> DataFrame:
    """row and, if kept, text (see `restored`), the counts of BASE, base_failed, probability, kept, for every row of docs."""
    keep = ["doc_id"] if keep is None else keep
    shared, with_text = docs.sparkSession.sparkContext.broadcast(model), "text" in keep
    row = carried(docs, keep)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch in (x for whole in batches for x in slices(whole, 1)):
            counts, x = [], []
            for body in bodies(batch.column(1)):
                hashes = words(body or b"")[0]
                counts.append(base_counts(body or b"", hashes))
                if fit:
                    x.append(features(body or b"", hashes))
            p = fit.probability(np.stack(x)) if x else np.ones(batch.num_rows)
            table = np.array(counts, np.int64).reshape(-1, len(BASE))
            failed = (table[:, 0] < 20) | (100 * table[:, 4] > 30 * table[:, 0])
            kept = ~failed & (p >= (fit.threshold if fit else 0))
            columns = [batch.column(0), *(pa.array(table[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(p.astype(float)), pa.array(kept)]
            names = ["row", *BASE, "base_failed", "probability", "kept"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * with_text, names + ["text"] * with_text)

    kind = row.schema["row"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in BASE)
    return row.mapInArrow(judged, f"row {kind}, {counts}, base_failed boolean, probability double, kept boolean" + ", text string" * with_text)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, probability, kept, for every row of docs."""
    model = train(docs, labels)
    give_back()
    return judge(docs, model).select(*restored(["doc_id"]), *BASE, "base_failed", "probability", "kept")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    model = train(docs, labels)
    give_back()
    return judge(docs, model, docs.columns).filter("kept").select(*restored(docs.columns))
