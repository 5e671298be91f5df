"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a binary codeword. For every bit, a logistic classifier over n-gram frequencies says
which side of the code a text is on. A text's language is the one whose codeword costs least: the sum
over bits of the logistic loss at the predicted margin, each bit weighted by its accuracy on held-back
sample rows. Where the two best codewords cost nearly the same, the text is flagged as ambiguous.

Languages and their counts are taken over all labelled rows; the classifiers are fitted on a
bounded sample: about `per_lang` documents of each language, chosen by a hash of the id, each once however often it is repeated.
Prediction reads whole texts, a few MB of an Arrow batch after another, and shuffles nothing.

Defined results: null text, or text without any letter, is `und` with score 0; with no labelled row at
all everything is `und`; with one language every text with a letter gets it, with score 1; repeated rows
get equal results; an empty table gives no rows; a very long text is counted in blocks, to its end; other columns are ignored
or carried along as they are, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import carried, crc_mod, give_back, restored
from .text import bodies, ngram_counts, slices

DIM = 4096
UND = "und"

#: ASCII letters in lower case; all other ASCII is one separator; bytes of other characters stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def features(body: bytes) -> np.ndarray:
    """Square roots of n-gram shares: a unit vector."""
    counts = ngram_counts(body, FOLD, DIM)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1, one row each: all splits of up to 5 languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.float32).T
    rng, bits = np.random.default_rng(seed), 10 * max(1, (n - 1).bit_length())
    best, far = None, -1
    for _ in range(60):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]
        agree = code @ code.T
        apart = ((code.shape[1] - agree) / 2 + np.eye(n) * bits).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class LanguageModel:
    """Fitted classifiers: everything a task needs, of a size set by DIM and the languages."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    margin: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of features: the language's number, its share among all, and whether it is ambiguous."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        f = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.scale).sum(2)
        order = np.sort(loss, axis=1)
        share = np.exp(-(loss - order[:, :1]))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.take_along_axis(share, best[:, None], 1)[:, 0]
        second = np.partition(share, -2, axis=1)[:, -2]
        return best, top, top - second < self.margin


def fitted(x: np.ndarray, y: np.ndarray, steps: int, penalty: float, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases for each column of y in {-1, 1}, by Adam on the mean logistic loss of the rows in `use`.

    Rows are left out by a weight of 0, so that the matrix is not copied.
    """
    weight = np.ones(len(x), np.float32) if use is None else use.astype(np.float32)
    weight = (weight / max(1, weight.sum()))[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = (-y * weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32)
        for p, d, first, second in ((w, x.T @ g + np.float32(penalty) * w, m, v), (b, g.sum(0), mb, vb)):
            first *= 0.9
            first += 0.1 * d
            second *= 0.99
            second += 0.01 * d * d
            p -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
    return w, b


def matrix(rows: pa.Table, order: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by a key, and their float16 vectors as one float32 matrix in that order."""
    at = np.argsort(rows[order].to_numpy(), kind="stable")
    binary = rows[vectors].combine_chunks()
    binary = binary.chunk(0) if isinstance(binary, pa.ChunkedArray) else binary
    flat = np.frombuffer(binary.buffers()[2], np.float16)[binary.offset :]
    return at, flat.reshape(len(at), -1)[at].astype(np.float32)


def train(docs: DataFrame, learn: Column, per_lang: int = 500, steps: int = 100, margin: float = 0.2) -> LanguageModel | None:
    """Fit on a sample of the rows of docs for which `learn` holds and lang is not null; None without such rows.

    A document with many texts is in the sample with one of them, so a repeated id can't make the sample grow.
    """
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "doc_id"), 11) + 0.5) / F.lit(float(1 << 53))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, per_lang / counts[k]))) for k in langs))
    sample = labelled.filter(draw < share[F.col("lang")]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sample.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 2)):
            x = [features(body).astype(np.float16).tobytes() for body in bodies(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "key", "x"])

    rows = sample.mapInArrow(vectors, "lang string, key long, x binary").toArrow()
    if not rows.num_rows:
        return LanguageModel(langs[:1], codewords(1), np.zeros((DIM, 0)), np.zeros(0), np.zeros(0), margin)
    # put in order by a key, so that the fit does not depend on which task ends first
    at, x = matrix(rows, "key", "x")
    labels = np.array(rows["lang"].to_pylist(), object)[at]
    del rows
    number = {k: i for i, k in enumerate(langs)}
    own = np.array([number[k] for k in labels])
    code = codewords(len(langs))
    held = np.arange(len(x)) % 5 == 4
    scale = np.ones(code.shape[1], np.float32)
    if code.shape[1] and held.any() and not held.all():
        w, b = fitted(x, code[own], steps // 2, 1e-5, ~held)
        right = (np.sign(x[held] @ w + b) == code[own[held]]).mean(0)
        scale = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
    w, b = fitted(x, code[own], steps, 1e-5)
    return LanguageModel(langs, code, w, b, scale, margin)


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """row and, if kept, text (see `restored`), lang_pred, score, ambiguous for every row; `keep` names the columns to carry along."""
    keep = ["doc_id"] if keep is None else keep
    shared, with_text = docs.sparkSession.sparkContext.broadcast(model), "text" in keep
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    row = carried(docs, keep).withColumn("letter", has_letter if model else F.lit(False))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        for batch in (x for whole in batches for x in slices(whole, 1)):
            letter = np.array(batch.column(2).to_pylist(), bool)
            langs, score, unsure = np.full(len(letter), UND, object), np.zeros(len(letter)), np.zeros(len(letter), bool)
            at = np.flatnonzero(letter)
            if len(at):
                texts = bodies(batch.column(1))
                best, top, close = model_.decode(np.stack([features(texts[i]) for i in at]))
                langs[at], score[at], unsure[at] = np.array(model_.langs, object)[best], top, close
            columns = [batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(unsure)]
            names = ["row", "lang_pred", "score", "ambiguous"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * with_text, names + ["text"] * with_text)

    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(scored, f"row {kind}, lang_pred string, score double, ambiguous boolean" + ", text string" * with_text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; fitted on the ids whose crc32 modulo 4 is not 2."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs, ~held)
    give_back()
    out = predict(docs, model)
    out = out.select(*restored(["doc_id"]), "lang_pred", "score", "ambiguous")
    return out.select("doc_id", held_of("doc_id"), "lang_pred", "score", "ambiguous")


def held_of(name: str) -> Column:
    return (crc_mod(F.col(name), 4) == 2).alias("held_out")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs with a recognised language, unchanged: `und` texts go.

    A flagged text also goes if it is so short of evidence that no language has half of the score.
    """
    model = train(docs, F.lit(True))
    give_back()
    out = predict(docs, model, docs.columns)
    return out.filter((F.col("lang_pred") != UND) & ~(F.col("ambiguous") & (F.col("score") < 0.5))).select(*restored(docs.columns))
