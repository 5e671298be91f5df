"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Words are counted over all training texts. The model works on units: each of the most frequent words is a unit of its own, six times
the 0.4th power of the training tokens many, so that they grow with the corpus without a limit; all others fall into a few units by their
last two letters, and the end of a text is a unit. The two units before predict the next (see `bilinear`). A word's probability is that of its
unit, times its smoothed share of the unit where others are in it, so all words, an unknown one for each such unit included, share 1.

Training takes every token of all training texts once. It's spread over copies of the model: in each of a few rounds, every copy is trained on its
part of a share of the documents, and the copies' parameters are averaged by Spark, weighed by how often each row was trained. There are as many copies as the
0.6th power of the tokens allows, so that what they ship, copies times parameters, is in proportion to the corpus. Scoring: batched
matrix products inside the tasks give normalised log-probabilities. A copy's noise is drawn by a seed from its first text; which texts a copy gets follows from how
the table is split, so a table that is split otherwise gives a slightly different model; counts and base scores don't depend on it.

Counts of rarer words don't fit a task: the most frequent words' counts are broadcast (`head` of them, or all units if these are more), and the
counts of the others are joined, one row per document and rare word. Words are keyed by a
64-bit hash; that two of a billion words share one has a chance of 3 %.

Defined results: null or empty text is one `end` token; without training texts all counts are 0 and both scores are
those of a certain event, 0; a very long text is cut into words in blocks and scored whole; an empty table gives no rows; repeated
rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import crc_mod, materialize
from .bilinear import DIM, Bilinear, Trainer, start
from .text import bodies, mix, slices, words

#: Units of rarer words, by their ending; the end of a text has the number after them.
ENDINGS = 64
#: Training rounds.
ROUNDS = 3
#: Words whose counts travel to every worker, or as many as there are units.
HEAD = 1 << 18
#: Rows of parameters that travel together.
BLOCK = 64
#: The key of the end token; a word has it with a chance of 1 in 2^64.
END_KEY = 0


def ending(tails: np.ndarray) -> np.ndarray:
    """The unit of a rarer word among those of rarer words, from its last two bytes."""
    return (mix(tails.astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)


def tokens(body: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and endings of a text's words in order, without the end token."""
    return words((body or b"").lower())


def _counts(keys: np.ndarray, kinds: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(sums)], ["key", "ending", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, ending, n) over all rows of docs, the end tokens included.

    A task sums up each slice of texts, merges the sums when it holds a million, and passes them on when half a million distinct keys are left, so
    its memory is bounded.
    """

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every, of, weight = (np.concatenate(x) for x in zip(*parts))
        keys, at, group = np.unique(every, return_index=True, return_inverse=True)
        return keys, of[at], np.bincount(group, weights=weight).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in (x for whole in batches for x in slices(whole, 0)):
            texts = bodies(batch.column(0))
            parts = [tokens(b) for b in texts]
            every, tails = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            keys, at, n = np.unique(every, return_index=True, return_counts=True)
            held += [(keys, ending(tails[at]), n), (np.array([END_KEY], np.uint64), np.array([ENDINGS]), np.array([len(texts)]))]
            size += len(keys)
            if size > 1_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield _counts(*held[0])
                    held, size = [], 0
        if held:
            yield _counts(*merged(held))

    partial = docs.select("text").mapInArrow(counted, "key long, ending int, n long")
    return partial.groupBy("key", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words, by rising key, and the sums over all words.

    Units 0 to own - 1 are words, the next ENDINGS are those of rarer words by ending, the last is the end.
    """

    keys: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    own: int
    total: int
    distinct: int
    mass: np.ndarray  # of each unit: the training tokens
    types: np.ndarray  # of each unit: the distinct words

    @property
    def end(self) -> int:
        return self.own + ENDINGS

    @cached_property
    def _begins(self) -> tuple[np.uint64, np.ndarray, int]:
        """Keys are hashes, so their first bits make small buckets: how many bits are cut off, where each bucket begins, and the largest one's size."""
        bits = max(1, len(self.keys).bit_length() + 1)
        cut = np.uint64(64 - bits)
        begins = np.zeros((1 << bits) + 1, np.int32)
        begins[1:] = np.cumsum(np.bincount((self.keys >> cut).astype(np.int64), minlength=1 << bits))
        return cut, begins, int(np.diff(begins).max())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and whether the keys are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        cut, begins, most = self._begins
        at = begins[(keys >> cut).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        for _ in range(most):  # a few steps, each for the keys that are still before their place
            before = np.flatnonzero(self.keys[np.minimum(at, last)] < keys)
            before = before[at[before] < last]
            if not len(before):
                break
            at[before] += 1
        at = np.minimum(at, last)
        return at, self.keys[at] == keys

    def classify(self, keys: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at, there = self.find(keys)
        return np.where(there, self.units[at] if len(self.units) else 0, self.own + ending(tails))

    def starts(self) -> np.ndarray:
        """Where clusters of units begin: runs of words that end alike, the units of rarer words, the end."""
        width = max(1, round(self.own**0.5))
        return np.array([*range(0, self.own, width), self.own, self.end, self.end + 1])


def units_for(total: int) -> int:
    """How many words are units of their own, for so many training tokens."""
    return max(64, int(6 * total**0.4))


def copies_for(total: int) -> int:
    """How many copies are trained side by side: with the units, in proportion to the tokens."""
    return max(1, int(total**0.6 / 2500))


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """The rows of the most frequent words, at most `head`, without a sort: a threshold from a histogram of counts.

    A bin has counts with the same leading ten bits. The bin at the border is divided by the words' hashes, whose first 16 bits make bins, too;
    the words of a bin are taken together, so a few less than head may be found.
    """
    counts = counts.withColumn("lead", F.expr("shiftright(n, greatest(length(bin(n)) - 10, 0)) + 1024 * length(bin(n))"))
    left, low, border = head, None, None
    for r in sorted(counts.groupBy("lead").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["lead"]):
        if r["words"] > left:
            border = r["lead"]
            break
        left, low = left - r["words"], r["lead"]
    if border is None:
        return counts.drop("lead")
    slot = F.shiftrightunsigned("key", 48)
    upto = 0
    for r in sorted(counts.filter(F.col("lead") == border).groupBy(slot.alias("slot")).agg(F.count("*").alias("words")).collect(), key=lambda r: r["slot"]):
        if r["words"] > left:
            break
        left, upto = left - r["words"], r["slot"] + 1
    more = (F.col("lead") == border) & (slot < upto)
    return counts.filter(more if low is None else more | (F.col("lead") >= low)).drop("lead")


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From the table of word counts. The driver gets `head` rows or as many as there are units, and one row per ending."""
    per = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    total, distinct = sum(r["n"] for r in per), sum(r["types"] for r in per)
    top = most_frequent(counts.filter(F.col("key") != END_KEY), max(head, units_for(total))).toArrow()
    n, keys = np.array(top["n"], np.int64), np.array(top["key"], np.int64).view(np.uint64)
    falling = np.lexsort((keys, -n))
    n, keys, kinds = n[falling], keys[falling], np.array(top["ending"], np.int64)[falling]
    own = min(len(keys), units_for(total))
    mass, types = np.zeros(own + ENDINGS + 1, np.int64), np.zeros(own + ENDINGS + 1, np.int64)
    for r in per:
        mass[own + r["ending"]], types[own + r["ending"]] = r["n"], r["types"]
    # words that end alike lie side by side, so that clusters are runs
    alike = np.lexsort((keys[:own], kinds[:own]))
    units = own + kinds
    units[alike] = np.arange(own)
    np.subtract.at(mass, own + kinds[:own], n[:own])
    np.subtract.at(types, own + kinds[:own], 1)
    mass[units[:own]], types[units[:own]] = n[:own], 1
    order = np.argsort(keys)
    return Vocabulary(keys[order], n[order], units[order], own, total, distinct, mass, types)


def _sequences(units: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' units side by side, two ends before and one after each, and the places of what is to be told: all but the two that begin a text."""
    out = np.full(len(units) + 3 * len(lengths), end, np.int32)
    out[np.arange(len(units)) + 3 * np.repeat(np.arange(len(lengths)), lengths) + 2] = units
    told = np.ones(len(out), bool)
    begin = np.cumsum(lengths + 3) - (lengths + 3)
    told[begin] = told[begin + 1] = False
    return out, np.flatnonzero(told)


def _round(docs: DataFrame, shared_vocab, shared_model, number: int) -> DataFrame:
    """(part, block, weights, values): blocks of rows, averaged over the models that the tasks train on docs."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, trainer = shared_vocab.value, None
        for batch in (x for whole in batches for x in slices(whole, 0)):
            texts = bodies(batch.column(0))
            if trainer is None:
                trainer = Trainer(shared_model.value, xxhash.xxh64_intdigest(texts[0] or b"", number))
            parts = [tokens(body) for body in texts]
            units = vocab.classify(*(np.concatenate(x) for x in zip(*parts)))
            units, at = _sequences(units, np.array([len(keys) for keys, _ in parts]), vocab.end)
            trainer.learn(units[at - 1], units[at - 2], units[at])
        if trainer is not None:
            task = TaskContext.get().partitionId()
            for k, block, weights, values in trainer.blocks(BLOCK):
                columns = [pa.array([x], t) for x, t in ((k, pa.int32()), (block, pa.int64()), (task, pa.int32()), (weights.tobytes(), pa.binary()), (values.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "task", "weights", "values"])

    def averaged(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        weights = np.stack([np.frombuffer(x, np.float32) for x in group["weights"].to_pylist()]).astype(np.float64)
        values = np.stack([np.frombuffer(x, np.float32).reshape(weights.shape[1], -1) for x in group["values"].to_pylist()])
        total = weights.sum(0)
        mean = np.einsum("cr,crd->rd", weights, values) / np.maximum(total, 1e-9)[:, None]
        keys = [group.column(c).slice(0, 1).combine_chunks() for c in ("part", "block")]
        blobs = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (total, mean)]
        return pa.table([*keys, *blobs], ["part", "block", "weights", "values"])

    spec = "part int, block long, weights binary, values binary"
    rows = docs.select("text").mapInArrow(trained, spec.replace(", weights", ", task int, weights"))
    return rows.groupBy("part", "block").applyInArrow(averaged, spec)


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, copies: int | None = None) -> Bilinear:
    """A model trained on docs: `rounds` times, copies are trained on a share of the documents and averaged.

    The driver gets the averaged rows only, as many as there are units.
    """
    sc = docs.sparkSession.sparkContext
    share = (vocab.mass + 0.5) / (vocab.total + 0.5 * len(vocab.mass))
    model, shared_vocab = start(share, vocab.starts()), sc.broadcast(vocab)
    docs = docs.coalesce(copies or copies_for(vocab.total))
    for number in range(rounds):
        shared = sc.broadcast(model)
        turn = F.pmod(F.xxhash64(F.lit("round"), "text"), F.lit(rounds)) == number
        for r in _round(docs.filter(turn), shared_vocab, shared, number).toArrow().to_pylist():
            table = getattr(model, Bilinear.PARTS[r["part"]])
            weights = np.frombuffer(r["weights"], np.float32)
            values = np.frombuffer(r["values"], np.float32).reshape(len(weights), -1)
            met = np.flatnonzero(weights)
            table[r["block"] * BLOCK + met] = values[met]
        shared.destroy()
    shared_vocab.destroy()
    return model


@dataclass
class Learned:
    """What training gives: the table of all words' counts, the frequent words, and the model (none without training texts)."""

    counts: DataFrame
    vocab: Vocabulary
    model: Bilinear | None


def train(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> Learned:
    """Counts and a model of all rows of docs."""
    counts = materialize(word_counts(docs), "lm-words")
    vocab = vocabulary(counts, head)
    return Learned(counts, vocab, fit(docs, vocab, rounds) if vocab.total else None)


def _partial_scores(docs: DataFrame, shared_vocab, shared_model) -> DataFrame:
    """Rows (row_id, key, doc_id, repeats, ...): one of each text with what its worker can tell, one for each rare word.

    The text's own row has a key of its own (its row id), so that the join spreads it like any other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = shared_vocab.value, shared_model.value
        total, size = vocab.total, vocab.distinct
        own_share = np.log10(vocab.mass + 0.5 * (vocab.types + 1))
        head_log = np.log10(vocab.counts + 0.5)
        row_id = TaskContext.get().partitionId() << 34
        for batch in (x for whole in batches for x in slices(whole, 1)):
            texts = [tokens(body) for body in bodies(batch.column(1))]
            length = np.array([len(keys) for keys, _ in texts])
            found = [np.unique(keys, return_index=True, return_inverse=True, return_counts=True) for keys, _ in texts]
            # the texts' distinct words, side by side
            of = np.repeat(np.arange(len(texts)), [len(x[0]) for x in found])
            distinct, tails, repeats = (np.concatenate(x) for x in ([x[0] for x in found], [t[x[1]] for (_, t), x in zip(texts, found)], [x[3] for x in found]))
            place, there = vocab.find(distinct)
            kinds = np.where(there, vocab.units[place] if len(vocab.units) else 0, vocab.own + ending(tails))
            summed = lambda weights, where: np.bincount(of[where], weights=weights[where], minlength=len(texts))
            log_n = np.zeros(len(distinct))
            log_n[there] = repeats[there] * head_log[place[there]]
            ends = vocab.mass[vocab.end]
            base = summed(log_n, there) + np.log10(ends + 0.5) - (length + 1) * np.log10(total + 0.5 * (size + 1))
            model = np.zeros(len(texts))
            if net is not None:
                shared = kinds >= vocab.own
                model += summed(log_n, there & shared) - summed(repeats * own_share[kinds], shared)
                begin = np.searchsorted(of, np.arange(len(texts))).tolist()
                units = np.concatenate([kinds[b : b + len(x[0])][x[2]] for b, x in zip(begin, found)])
                units, at = _sequences(units, length, vocab.end)
                model += np.add.reduceat(net.log10(units[at - 1], units[at - 2], units[at]), np.cumsum(length + 1) - (length + 1))
            rare = np.flatnonzero(~there)
            ids = row_id + 1 + np.arange(len(texts))
            row_id += len(texts)
            own = (ids, ids, np.zeros(len(texts), np.int64), length + 1, summed(repeats, there).astype(np.int64) + int(ends > 0), base, model)
            none = np.zeros(len(rare))
            rest = (ids[of[rare]], distinct[rare].view(np.int64), repeats[rare], none.astype(np.int64), none.astype(np.int64), none, none)
            where = np.concatenate([np.arange(len(texts)), of[rare]])
            columns = [pa.array(np.concatenate(x)) for x in zip(own, rest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *columns], ["doc_id", "row_id", "key", "repeats", "n_tokens", "n_known", "base", "model"])

    return docs.select("doc_id", "text").mapInArrow(
        scored, f"doc_id {kind}, row_id long, key long, repeats long, n_tokens long, n_known long, base double, model double"
    )


def apply(docs: DataFrame, learned: Learned) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    sc, vocab, model = docs.sparkSession.sparkContext, learned.vocab, learned.model
    parts = _partial_scores(docs, sc.broadcast(vocab), sc.broadcast(model))
    rare = learned.counts.select(F.col("key").alias("word"), F.col("n").alias("c"))
    joined = parts.join(rare, (F.col("key") == F.col("word")) & (F.col("repeats") > 0), "left")
    log_c = F.col("repeats") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    known = F.when(F.col("c").isNotNull(), F.col("repeats")).otherwise(0)
    summed = joined.groupBy("row_id", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(known)).alias("n_known"),
        (F.sum("base") + F.sum(log_c)).alias("base_score"),
        (F.sum("model") + (F.sum(log_c) if model is not None else F.lit(0.0))).alias("score"),
    )
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, learn: Column, head: int = HEAD) -> DataFrame:
    """Scores of every row, trained where `learn` holds."""
    return apply(docs, train(docs.filter(learn), head))


def score_documents(docs: DataFrame) -> DataFrame:
    """With held_out; trained on the ids whose crc32 modulo 5 is not 1."""
    held = lambda c: crc_mod(F.col(c), 5) == 1
    out = score(docs, ~held("doc_id"))
    return out.select("doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
