"""Document quality by Bradley-Terry pairwise ranking.

*Features* of a whole text are shares of its bytes, words, lines and windows of
``WINDOW_WORDS`` words (capitals, digits, marks, symbols, short and symbol-only words, distinct
words, distinct lines, and the worst window of each kind), found with numpy over Arrow batches.

*Preferences.*  Each labelled document of the fit sample (at most ``fit_rows`` rows, the
documented bound, drawn after the join with the texts) meets ``PAIRS`` documents of the other
label; the one of label 1 is preferred.  P(i before j) = sigmoid(s_i - s_j) with
s = w . x: logistic loss on feature differences, without an intercept, fitted by Spark ML.

*Threshold.*  It lies midway between two score quantiles over all labelled training rows: that
which ``TAIL`` of the rows of label 1 stay below and that which ``TAIL`` of the rows of label 0
exceed.  A document's ``score`` is sigmoid(s - threshold + logit(cut)), at least ``cut`` from the
threshold on.

Result cases: a null text counts as empty and an empty text has zero features, scored like any
other; repeated rows, ties and null ids keep a row each; labels other than 0 and 1, null
labels and null ids train nothing; labels of one kind only give every document the share
of label 1 (no labels: 0); empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_draw, slices

WINDOW_WORDS = 64
PAIRS = 6
#: share of each label's rows that may lie beyond its quantile
TAIL = 0.005
FEATURES = ["capitals", "digits", "symbols", "marks", "shouts", "bare_words", "shout_words", "symbol_words", "capital_words",
            "short_words", "word_bytes", "distinct_words", "distinct_lines", "line_words", "words",
            "worst_symbol_words", "worst_bare_words", "worst_shout_words", "worst_capital_words", "worst_short_words",
            "worst_distinct_words"]
# byte classes
_SPACE, _UPPER, _LETTER, _DIGIT, _MARK, _SHOUT, _SYMBOL = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[list(b".,;:?'\"()-")] = _MARK
_CLASS[list(b"!")] = _SHOUT
#: an odd multiplier: word hashes are differences of prefix sums modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: bytes hashed at once
_SEGMENT = 1 << 20


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """base ** i modulo 2^64 for i below _SEGMENT."""
    return np.cumprod(np.r_[np.uint64(1), np.full(_SEGMENT - 1, base, np.uint64)], dtype=np.uint64)


def _power_at(base: int, places: np.ndarray) -> np.ndarray:
    """base ** place modulo 2^64."""
    rounds = places // _SEGMENT
    far = np.array([pow(base, _SEGMENT * int(i), 1 << 64) for i in range(int(rounds.max(initial=0)) + 1)], np.uint64)
    return _powers(base)[places % _SEGMENT] * far[rounds]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes (ascending, disjoint), however long: differences of prefix sums,
    of which only those at the ends of ranges are kept."""
    at_start, at_end, carry = np.zeros(len(start), np.uint64), np.zeros(len(end), np.uint64), np.uint64(0)
    for low in range(0, len(data), _SEGMENT):
        part = data[low:low + _SEGMENT].astype(np.uint64) + np.uint64(1)
        weight = _powers(_BASE)[:len(part)] * np.uint64(pow(_BASE, low, 1 << 64))
        prefix = np.cumsum(np.r_[carry, part * weight], dtype=np.uint64)
        carry = prefix[-1]
        for places, out in ((start, at_start), (end, at_end)):
            i, j = np.searchsorted(places, [low, low + len(part)], "left")
            j = len(places) if low + len(part) == len(data) else j
            out[i:j] = prefix[places[i:j] - low]
    return (at_end - at_start) * _power_at(_INVERSE, start)


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values; a run ends where ``first`` is set."""
    before = np.r_[False, inside[:-1]] & ~first
    after = np.r_[inside[1:] & ~first[1:], False]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Distinct values of each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
    return np.bincount(g[new], minlength=groups)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = len(data)
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    first = first[:-1]
    kind = _CLASS[data]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    start, end = _runs(kind != _SPACE, first)
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    # white space has no class of its own: what lies up to the next word counts for the word
    count = {k: np.add.reduceat(kind == k, start, dtype=np.int64) if len(start) else start
             for k in (_UPPER, _LETTER, _DIGIT, _MARK, _SHOUT, _SYMBOL)}
    flags = {"symbol_words": count[_SYMBOL] > 0, "bare_words": count[_UPPER] + count[_LETTER] == 0, "shout_words": count[_SHOUT] > 0,
             "capital_words": (count[_UPPER] > 1) & (count[_LETTER] <= count[_UPPER]), "short_words": end - start <= 3}
    h = _hashes(data, start, end)
    index = np.arange(len(start)) - np.repeat(np.cumsum(words) - words, words)
    windows = np.maximum(words // WINDOW_WORDS, 1)
    base = np.cumsum(windows) - windows
    window = base[doc] + np.minimum(index // WINDOW_WORDS, windows[doc] - 1) if len(doc) else doc
    total = int(windows.sum())
    in_window = np.bincount(window, minlength=total)
    out = {name: share(np.bincount(doc, flag, n), words) for name, flag in flags.items()}
    if n:
        for name, flag in flags.items():
            rate = share(np.bincount(window, flag, total), in_window)
            out["worst_" + name] = (np.minimum if name == "short_words" else np.maximum).reduceat(rate, base)
        rate = share(_distinct(window, h, total), in_window)
        out["worst_distinct_words"] = np.minimum.reduceat(rate, base)
        out["distinct_words"] = np.add.reduceat(rate, base) / windows
    l_start, l_end = _runs(data != 10, first)
    l_doc = np.searchsorted(offsets, l_start, "right") - 1
    lines = np.bincount(l_doc, minlength=n)
    out["distinct_lines"] = share(_distinct(l_doc, _hashes(data, l_start, l_end), n), lines)
    out["line_words"] = np.log1p(share(words, lines))
    total_of = {k: np.bincount(doc, c, n) for k, c in count.items()}
    size_of = np.diff(offsets)
    out |= {"capitals": share(total_of[_UPPER], total_of[_UPPER] + total_of[_LETTER]),
            "digits": np.sqrt(share(total_of[_DIGIT], size_of)), "symbols": np.sqrt(share(total_of[_SYMBOL], size_of)),
            "marks": share(total_of[_MARK], words), "shouts": share(total_of[_SHOUT], words),
            "word_bytes": np.log1p(share(np.bincount(doc, end - start, n), words)), "words": np.log1p(words)}
    empty = np.zeros(n)
    return np.stack([out.get(name, empty) for name in FEATURES], 1) if n else np.zeros((0, len(FEATURES)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        x = text_features(b.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("id"), flat], ["id", "x"])


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) per input row."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        _feature_rows, f"id {kind}, x array<double>")


@dataclass
class RankingModel:
    """Score = sigmoid(w . x - threshold + logit(cut)); without weights: ``constant``."""
    weight: list[float] = field(default_factory=list)
    threshold: float = 0.0
    cut: float = 0.3
    constant: float = 0.0

    def raw(self, x):
        """w . x as a native expression."""
        terms = F.zip_with(x, F.array(*[F.lit(w) for w in self.weight]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    def score(self, x):
        if not self.weight:
            return F.lit(self.constant)
        logit = self.raw(x) - F.lit(self.threshold) + F.lit(math.log(self.cut / (1 - self.cut)))
        # exp keeps a logit of exactly that of the cut at the cut
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def preference_pairs(sample: DataFrame, n0: int, n1: int, pairs: int = PAIRS) -> DataFrame:
    """(d, first): differences of the features of documents of label 1 and label 0 in random order; every
    document meets ``pairs`` others.  ``sample``: (label, nr, x), numbered from 0 within each label."""
    most = max(n0, n1)
    turns = sample.select("label", "nr", "x", F.explode(F.sequence(F.lit(0), F.lit(pairs * most - 1), F.when(
        F.col("label") == 1, F.lit(n1)).otherwise(F.lit(n0)))).alias("step")).select(
        "label", "x", (F.col("nr") + F.col("step")).alias("turn")).where(F.col("turn") < pairs * most)
    # turn t: documents t mod n1 and (t + t div most) mod n0, shifted a place in each round
    good = turns.where("label = 1").select("turn", F.col("x").alias("good"))
    bad = sample.where("label = 0").select(F.col("nr").alias("bad_nr"), F.col("x").alias("bad"))
    met = (good.withColumn("bad_nr", ((F.col("turn") + F.expr(f"turn div {most}")) % F.lit(n0)).cast("long")).join(bad, "bad_nr"))
    sign = F.when(F.xxhash64("turn") % 2 == 0, 1.0).otherwise(-1.0)
    return met.select(F.transform(F.zip_with("good", "bad", lambda a, b: a - b), lambda v: v * sign).alias("d"),
                      (sign > 0).cast("double").alias("first"))


def train(found: DataFrame, labels: DataFrame, label_id: str, label_col: str, cut: float = 0.3, fit_rows: int = 20_000) -> RankingModel:
    """Fit on the features of documents (``features``, written: it is read several times) and labels."""
    scratch = Scratch(found.sparkSession, "ranking")
    marked = (labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)"))
    rows = scratch.keep(found.join(marked, "id").select("label", "x"), "labelled")
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(count.values())
    if len(count) < 2:
        scratch.drop(rows)
        return RankingModel(cut=cut, constant=count.get(1, 0) / max(n, 1))
    sample = scratch.keep(bounded_draw(rows, fit_rows, n), "sample")
    by_label = Window.partitionBy("label").orderBy(F.xxhash64("x"))  # a bounded number of rows
    sample = scratch.keep(sample.withColumn("nr", F.row_number().over(by_label) - 1), "numbered")
    part = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(part) < 2:
        return RankingModel(cut=cut, constant=count.get(1, 0) / n)
    pairs = scratch.keep(preference_pairs(sample, part[0], part[1]), "pairs")
    fitted = LogisticRegression(featuresCol="d", labelCol="first", fitIntercept=False, regParam=1e-4, maxIter=60).fit(
        pairs.select(array_to_vector("d").alias("d"), "first"))
    model = RankingModel([float(w) for w in fitted.coefficients], 0.0, cut)
    model.threshold = _threshold(rows, model)
    scratch.drop(rows, sample, pairs)
    return model


def _threshold(rows: DataFrame, model: RankingModel) -> float:
    """Midway between the lowest ``TAIL`` of label 1 and the highest of label 0, over all labelled rows."""
    raw = rows.select("label", model.raw(F.col("x")).alias("raw")).groupBy("label").agg(
        F.percentile_approx("raw", F.array(F.lit(TAIL), F.lit(1 - TAIL)), 10_000).alias("q"))
    q = {r.label: r.q for r in raw.collect()}
    return (q[1][0] + q[0][1]) / 2


def rank_documents(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
                   cut: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """(id, score) per input row, learned from the labelled ones."""
    found = Scratch(df.sparkSession, "ranking").keep(features(df, id_col, text_col), "features")
    model = train(found, labels, label_id, label_col, cut, fit_rows)
    return found.select("id", model.score(F.col("x")).alias("score"))
