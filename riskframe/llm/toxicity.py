"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first four and five letters
(so that inflected forms of a stem share a term), hashed into ``SLOTS`` slots.
The model is fitted on at most ``fit_rows`` labelled documents (a random draw among the rows of
the join of labels and documents, so that repeated ids count as often as they stand; the
documented bound of this operator):

1. Spark counts in how many sample texts each slot occurs and keeps the slots of at
   least ``LEAST_TEXTS``, however telling they are on their own: terms may matter
   only together.  Terms that tell little alone learn slower, none is left out.
2. A factorization machine, logit = b + sum w_i + sum_{i<j} <v_i, v_j>, is trained
   with Adam on the presence of those slots; the factors learn which terms matter
   together, such as an insult beside the mention of a group, where a sum of
   weights could not.  The bounded sample is trained on in one Spark task, as flat 32-bit
   arrays; the driver only gets the fitted parameters.

Scoring reads whole texts, row by row, and only needs the small fitted model.

Null and empty texts score as a text without any telling term.  Without rows of
both classes to learn from, the score is the share of toxic rows (0 if none).
Labels other than 0 and 1 and null labels or ids train nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, labelled_sample, lowest, share, slices

SLOTS = 1 << 20
#: sample texts that a term must occur in
LEAST_TEXTS = 3
#: two-proportion z from which a term learns at full pace
TELLING_Z = 4.5
FACTORS = 8
EPOCHS = 24
RATE = 0.1
#: factors learn more slowly and decay more than weights, so that they explain only what weights cannot
FACTOR_RATE, FACTOR_DECAY, WEIGHT_DECAY = 0.2, 3e-3, 1e-5
#: toxic rows are few; each counts so many times
TOXIC_WEIGHT = 3.0
#: words whose features a worker remembers
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W_]+")


def word_slots(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself and its stems of four and five letters."""
    terms = {"=" + word, *(f"{n}" + word[:n] for n in (4, 5) if len(word) >= n)}
    return tuple(zlib.crc32(t.encode()) % SLOTS for t in sorted(terms))


class Terms:
    """Distinct features of a text; remembers the words it has seen."""

    def __init__(self, number: dict[int, int] | None = None):
        self.number, self.known = number, {}

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            got = self.known.get(word)
            if got is None:
                got = word_slots(word)
                if self.number is not None:
                    got = tuple(self.number[s] for s in got if s in self.number)
                if len(self.known) < REMEMBERED:
                    self.known[word] = got
            if got:
                out.update(got)
        return sorted(out)


@dataclass
class ToxicityModel:
    bias: float = -np.inf
    slots: list[int] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        flat, owner = _flat(rows)
        first = np.bincount(owner, self.weight[flat], len(rows))
        total = np.stack([np.bincount(owner, self.factor[flat, k], len(rows)) for k in range(FACTORS)], 1)
        square = np.bincount(owner, (self.factor[flat] ** 2).sum(1), len(rows))
        return self.bias + first + 0.5 * ((total ** 2).sum(1) - square)

    def column(self, text: Column) -> Column:
        """Score between 0 and 1 of a text column."""
        shared = share(SparkSession.active(), self)

        @F.arrow_udf("double")
        def toxicity(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared()
            terms = Terms({s: i for i, s in enumerate(model.slots)})
            for column in columns:
                out = []
                for p in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                    out.append(_sigmoid(model.logits([terms.of(t) for t in p.column("text").to_pylist()])))
                yield pa.array(np.concatenate(out) if out else np.zeros(0))

        return toxicity(text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """All entries end to end, and the row of each."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for b in slices(batches, "text"):
        slots = [terms.of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(slots, pa.list_(pa.int32())), b.column("draw")],
                                         ["id", "toxic", "slots", "draw"])


def fit_machine(flat: np.ndarray, owner: np.ndarray, label: np.ndarray, n_features: int, seed: int = 11,
                pace: np.ndarray | None = None) -> tuple:
    """Rows as flat entries and their owners (see ``_flat``).  Adam on the logistic loss of a factorization machine over present features; a step
    changes the features of its rows.  ``pace``: learning rate of each feature (1 by default)."""
    pace = np.ones(n_features) if pace is None else pace
    rng = np.random.default_rng(seed)
    base = label.mean()
    bias = float(np.log(base / (1 - base)))
    # a row a feature: its weight and its factors; 32 bits halve what a step moves
    wv = np.concatenate([np.zeros((n_features, 1)), rng.normal(0, 0.01, (n_features, FACTORS))], 1).astype(np.float32)
    first, second = np.zeros_like(wv), np.zeros_like(wv)
    rates = (pace[:, None] * np.r_[1.0, np.full(FACTORS, FACTOR_RATE)]).astype(np.float32)
    decay = np.r_[WEIGHT_DECAY, np.full(FACTORS, FACTOR_DECAY)].astype(np.float32)
    sizes = np.bincount(owner, minlength=len(label))
    starts = np.cumsum(sizes) - sizes
    size, step, bias_moments = 256, 0, np.zeros(2)
    steps_least = 400  # small samples make more passes
    epochs = max(EPOCHS, -(-steps_least * size // max(len(label), 1)))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        order = rng.permutation(len(label))
        for at in range(0, len(order), size):
            pick = order[at:at + size]
            long, some = sizes[pick], np.flatnonzero(sizes[pick])
            ends = np.cumsum(long)
            idx = flat[np.repeat(starts[pick] - (ends - long), long) + np.arange(ends[-1])]
            own = np.repeat(np.arange(len(pick)), long)
            sums, square = np.zeros((len(pick), FACTORS + 1), np.float32), np.zeros(len(pick), np.float32)
            if len(some):
                rows = wv[idx]
                cut = (ends - long)[some]
                sums[some] = np.add.reduceat(rows, cut, axis=0)
                square[some] = np.add.reduceat(np.einsum("ij,ij->i", rows[:, 1:], rows[:, 1:]), cut)
            logit = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - square)
            error = ((_sigmoid(logit) - label[pick]) * np.where(label[pick] == 1, TOXIC_WEIGHT, 1.0) / len(pick)).astype(np.float32)
            step += 1
            fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
            bias_moments = np.array([0.9, 0.999]) * bias_moments + np.array([0.1, 0.001]) * np.array([error.sum(), error.sum() ** 2])
            bias -= rate * bias_moments[0] / fix1 / (np.sqrt(bias_moments[1] / fix2) + 1e-8)
            if not len(some):
                continue
            # gradients: entries of one feature end to end
            by_feature = np.argsort(idx, kind="stable")
            sorted_idx = idx[by_feature]
            cut = np.flatnonzero(np.r_[True, sorted_idx[1:] != sorted_idx[:-1]])
            here = sorted_idx[cut]
            pull = error[:, None] * np.concatenate([np.ones((len(pick), 1), np.float32), sums[:, 1:]], 1)
            grad = np.add.reduceat(pull[own[by_feature]], cut, axis=0)
            now = wv[here]
            grad[:, 1:] -= grad[:, :1] * now[:, 1:]
            grad += decay * now
            m = first[here] = 0.9 * first[here] + np.float32(0.1) * grad
            q = second[here] = np.float32(0.999) * second[here] + np.float32(0.001) * grad * grad
            wv[here] = now - rates[here] * np.float32(rate / fix1) * m / (np.sqrt(q / np.float32(fix2)) + np.float32(1e-8))
    return bias, wv[:, 0].astype(float), wv[:, 1:].astype(float)


def _paces(flat: np.ndarray, owner: np.ndarray, label: np.ndarray, n_features: int) -> np.ndarray:
    """Terms that tell nothing alone are many in each text: they learn slower by their number in a text."""
    a, both = np.bincount(flat, label[owner], n_features), np.bincount(flat, minlength=n_features)
    n1, n = label.sum(), len(label)
    p = both / n
    z = np.abs((a / n1 - (both - a) / (n - n1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1))))
    return np.where(z >= TELLING_Z, 1.0, 1 / max(1.0, len(flat) / n))


def _machine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the sample to the parameters: slot -1 is the bias, then (slot, weight, factors)."""
    parts, sizes, labels = [], [], []
    for b in batches:
        lists = b.column("slots")
        parts.append(lists.flatten().to_numpy())
        sizes.append(pc.list_value_length(lists).to_numpy())
        labels.append(b.column("toxic").to_numpy().astype(float))
    label, flat = np.concatenate(labels), np.concatenate(parts).astype(np.int32)
    owner = np.repeat(np.arange(len(label), dtype=np.int32), np.concatenate(sizes))
    del parts
    texts = np.bincount(flat, minlength=SLOTS)
    slots = np.flatnonzero((texts >= LEAST_TEXTS) & (texts < len(label)))
    place = np.full(SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    flat = place[flat]
    flat, owner = flat[flat >= 0], owner[flat >= 0]
    bias, w, v = fit_machine(flat, owner, label, len(slots), pace=_paces(flat, owner, label, len(slots)))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, slots], pa.int32()), pa.array(np.r_[bias, w]),
                                      pa.array([[], *v.tolist()], pa.list_(pa.float64()))], ["slot", "weight", "factor"])


def train(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
          fit_rows: int = 30_000) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled rows, joined to their texts by id."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, id_col, text_col, labels, label_id, label_col, fit_rows)
    rows = scratch.keep(lowest(sample.select("id", F.col("label").alias("toxic"), "text", "draw")
                               .mapInArrow(_term_rows, "id string, toxic int, slots array<int>, draw double"), fit_rows), "terms")
    seen = {r.toxic for r in rows.select("toxic").distinct().collect()}
    if len(seen) < 2:
        scratch.drop(rows)
        return ToxicityModel(bias=500.0 if seen == {1} else -500.0)
    fitted = (rows.coalesce(1).sortWithinPartitions("id", "toxic", "slots")
              .mapInArrow(_machine_rows, "slot int, weight double, factor array<double>").toArrow().combine_chunks())
    scratch.drop(rows)
    slot, weight = fitted["slot"].to_numpy(), fitted["weight"].to_numpy()
    factor = fitted["factor"].combine_chunks().flatten().to_numpy().reshape(-1, FACTORS)
    return ToxicityModel(float(weight[0]), slot[1:].tolist(), weight[1:], factor)


def score(df: DataFrame, id_col: str, text_col: str, model: ToxicityModel) -> DataFrame:
    """(id, score) per input row."""
    return df.select(F.col(id_col).alias("id"), model.column(F.col(text_col)).alias("score"))
