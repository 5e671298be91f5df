"""A log-bilinear model of units in two steps, in numpy: the cluster of the next unit, then the unit inside its cluster.

The two units before give a vector, the sum of one vector for each place. Its products with the clusters' vectors, plus biases,
are the scores of the clusters; its products with the vectors of a cluster's units, plus biases, those of the units in it.
A softmax over the clusters and one over the cluster's units make a distribution over all units, at a cost that grows
with the root of their number.

Training is noise-contrastive estimation of both steps: noise clusters come from the cluster distribution, noise units from that of the token's own
cluster; the score minus log(draws * q) is the logit that one is data, not noise. The noise term is not drawn but taken as its exact expectation over
the clusters, and over the units of the cluster, so that it is one matrix product for the batch, and one for each cluster in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Numbers of a vector, noise clusters and units for each token, tokens of a batch for each cluster and at least, and the rate of steps.
DIM, NOISE, INNER, BATCH, LEAST, RATE = 24, 64, 12, 128, 1024, 0.1
#: Rows whose scores are worked on at once, so that they stay in a core's cache.
CACHED = 512


@dataclass
class Bilinear:
    """Parameters, the last column of `cluster` and `unit` is the bias. Units of cluster c are starts[c] to starts[c + 1] - 1."""

    first: np.ndarray
    second: np.ndarray
    cluster: np.ndarray
    unit: np.ndarray
    starts: np.ndarray
    share: np.ndarray  # of each unit: its share of all training tokens, smoothed

    PARTS = ("first", "second", "cluster", "unit")

    @property
    def owner(self) -> np.ndarray:
        """The cluster of each unit."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    @property
    def masses(self) -> np.ndarray:
        """The share of each cluster."""
        return np.add.reduceat(self.share, self.starts[:-1])

    def log10(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Log10 probabilities of units after the units two and one places before, by matrix products over batches.

        Tokens are taken in the order of their units, so that those of a cluster lie side by side, and a few at a time, whose scores stay in a core's cache.
        """
        out, order = np.empty(len(unit)), _ordered(unit, len(self.unit))
        bounds = np.searchsorted(unit[order], self.starts).tolist()
        for c in range(len(self.starts) - 1):
            low, high = int(self.starts[c]), int(self.starts[c + 1])
            for at in range(bounds[c], bounds[c + 1], CACHED):
                rows = order[at : min(at + CACHED, bounds[c + 1])]
                wide = np.ones((len(rows), DIM + 1), np.float32)
                np.add(self.first[one[rows]], self.second[two[rows]], out=wide[:, :-1])
                logs = _log_softmax(wide, self.cluster, c)
                if high - low > 1:
                    logs += _log_softmax(wide, self.unit[low:high], unit[rows] - low)
                out[rows] = logs
        return out / np.log(10)


def _log_softmax(wide: np.ndarray, table: np.ndarray, chosen: np.ndarray | int) -> np.ndarray:
    """Of rows that end in 1, the log of the chosen entry's share."""
    size = len(wide) * len(table)
    if len(_scratch[0]) < size:
        _scratch[0] = np.empty(size, np.float32)
    scores = np.matmul(wide, table.T, out=_scratch[0][:size].reshape(len(wide), len(table)))
    if scores.max() > 60:  # far from what single precision holds
        scores -= scores.max(1, keepdims=True)
    picked = scores[np.arange(len(wide)), chosen].astype(np.float64)
    return picked - np.log(np.exp(scores, out=scores) @ np.ones(len(table), np.float32), dtype=np.float64)


#: Scores are worked on in one place of a worker's memory, which is cheaper than new pages for each product.
_scratch = [np.empty(0, np.float32)]


def _ordered(numbers: np.ndarray, upto: int) -> np.ndarray:
    """The order of numbers below a bound; 16 bits, where they are enough, are sorted digit by digit."""
    return np.argsort(numbers.astype(np.uint16) if upto <= 1 << 16 else numbers, kind="stable")


def start(share: np.ndarray, starts: np.ndarray, seed: int = 1) -> Bilinear:
    """A model whose biases are the logs of the shares, so that it begins as a unigram model."""
    rng, n = np.random.default_rng(seed), len(share)
    draw = lambda rows, width: rng.normal(0, 0.1, (rows, width)).astype(np.float32)
    model = Bilinear(draw(n, DIM), draw(n, DIM), draw(len(starts) - 1, DIM + 1), draw(n, DIM + 1), starts, share)
    masses = model.masses
    model.cluster[:, -1] = np.log(masses)
    model.unit[:, -1] = np.log(share / masses[model.owner])
    return model


class Trainer:
    """Trains a copy of a model on triples of units, in batches, by steps that adapt to each parameter."""

    def __init__(self, model: Bilinear, seed: int):
        self.model = Bilinear(*(getattr(model, p).copy() for p in Bilinear.PARTS), model.starts, model.share)
        self.rng = np.random.default_rng(seed)
        self.squares = {p: np.full(len(getattr(model, p)), 1e-3, np.float32) for p in Bilinear.PARTS}
        self.seen = {p: np.zeros(len(getattr(model, p)), np.float32) for p in Bilinear.PARTS}
        masses = model.masses / model.masses.sum()
        self.owner = model.owner
        self.masses, self.unit_share = masses, (model.share / model.masses[self.owner]).astype(np.float32)
        self.scratch = np.empty(0, np.float32)
        self.cluster_rest, self.unit_rest = (1 / (NOISE * masses)).astype(np.float32), 1 / (INNER * self.unit_share)

    def learn(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> None:
        order, size = self.rng.permutation(len(unit)), max(LEAST, BATCH * len(self.masses))
        for at in range(0, len(unit), size):
            rows = order[at : at + size]
            self._step(one[rows], two[rows], unit[rows])

    def _step(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> None:
        m, b = self.model, len(unit)
        order = _ordered(unit, len(m.unit))  # units of a cluster lie side by side
        one, two, unit = one[order], two[order], unit[order]
        own = self.owner[unit]
        wide = np.ones((b, DIM + 1), np.float32)
        np.add(m.first[one], m.second[two], out=wide[:, :-1])
        back, total = np.empty_like(wide), np.zeros_like(m.cluster)
        for part in (slice(at, at + CACHED) for at in range(0, b, CACHED)):
            total += self._contrast(wide[part], m.cluster, self.cluster_rest, own[part], back[part])
        clusters = np.bincount(own, minlength=len(m.cluster))
        self._update("cluster", slice(None), total, clusters + b * self.masses)
        total, at, more = np.zeros_like(m.unit), 0, np.zeros_like(wide)
        for c in np.flatnonzero(clusters).tolist():
            end, low, high = at + int(clusters[c]), int(m.starts[c]), int(m.starts[c + 1])
            if high - low > 1:  # the only unit of its cluster is certain
                total[low:high] = self._contrast(wide[at:end], m.unit[low:high], self.unit_rest[low:high], unit[at:end] - low, more[at:end])
            at = end
        back += more
        met = np.bincount(unit, minlength=len(m.unit)) + self.unit_share * clusters[self.owner]
        touched = np.flatnonzero(met)
        self._update("unit", touched, total[touched], met[touched])
        back = np.ascontiguousarray(back[:, :-1])
        self._scatter("first", one, back)
        self._scatter("second", two, back)

    def _contrast(self, rows: np.ndarray, table: np.ndarray, rest: np.ndarray, true: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The gradient for the table's entries, from rows whose true entries are data; the gradient for the rows goes to back.

        rest: of each entry 1 / (draws * q). What a logit is off is draws * q * logistic(score - log(draws * q)) for noise, and logistic(…) - 1 for data.
        logistic(x) is (1 + tanh(x / 2)) / 2, so that one function is applied in place, and its constants go to the small matrices.
        """
        size = len(rows) * len(table)
        if len(self.scratch) < size:
            self.scratch = np.empty(size, np.float32)
        out = self.scratch[:size].reshape(len(rows), len(table))
        half = table * np.float32(0.5)
        half[:, -1] += 0.5 * np.log(rest)
        np.tanh(np.matmul(rows, half.T, out=out), out=out)
        at = np.arange(len(rows))
        said = out[at, true]
        out[at, true] = said + (said - 1) * rest[true]
        weight = (0.5 / rest)[:, None]
        half = table * weight
        np.matmul(out, half, out=back)
        back += half.sum(0)
        return weight * (out.T @ rows + rows.sum(0))

    def _scatter(self, part: str, rows: np.ndarray, grads: np.ndarray) -> None:
        order = _ordered(rows, len(getattr(self.model, part)))
        at = rows[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self._update(part, at[first], np.add.reduceat(grads[order], first, axis=0), np.diff(np.append(first, len(at))))

    def _update(self, part: str, rows: np.ndarray | slice, total: np.ndarray, hits: np.ndarray) -> None:
        """Step against the summed gradients of rows, each scaled by the mean square of all gradients its row had."""
        squares = self.squares[part]
        squares[rows] += np.einsum("rd,rd->r", total, total) / total.shape[1]
        getattr(self.model, part)[rows] -= RATE * total / np.sqrt(squares[rows])[:, None]
        self.seen[part][rows] += hits

    def blocks(self, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of each block of rows that was trained: its part, its number, how often each row was trained, and the rows' values."""
        for k, part in enumerate(Bilinear.PARTS):
            seen, table = self.seen[part], getattr(self.model, part)
            for block in np.unique(np.flatnonzero(seen) // size).tolist():
                rows = slice(block * size, (block + 1) * size)
                yield k, block, seen[rows], table[rows]
