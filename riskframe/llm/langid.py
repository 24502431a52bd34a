"""Language identification with interpolated Kneser-Ney character models.

*Counting.*  Every training text is lower-cased, runs of non-letters become one
space, and character n-grams of order ``ORDER`` are counted per language: each
task merges equal n-grams of a batch before anything is shuffled, Spark sums the
rest, so the counts cover all training rows.  Lower orders hold continuation
counts (in how many contexts an n-gram ends), each derived from the order above.

*Model.*  Per language and order a sorted array of n-gram keys with their
interpolated probabilities, and one of contexts with their back-off weights.
Symbols have 12 bits (code points below 4096 as they are, others hashed).  All
n-grams are kept, so the model grows with the distinct n-grams of the input.  A task
per language builds its arrays and writes them to the shared folder; scoring tasks
load them there (about 16 bytes an n-gram and as many a context in each Python worker), the
driver only sees one row per language.
A caller may ask for at most ``max_grams`` per language and order (the most
frequent); contexts then give the mass of dropped n-grams to the back-off, so that
they still sum to one.

*Prediction.*  Binary search in the sorted arrays, once per distinct n-gram of a
batch; the language with the lowest cross-entropy per symbol wins (ties: the
first in alphabetical order).  ``score`` is the softmax of the negative
cross-entropies at ``SHARPNESS``.

*Rejection* (``identify`` with a model that ``train`` calibrated, or ``learn_and_identify``, which
scores every text once) is calibrated per language on all training rows that are recognised as
it: a text is rejected if its cross-entropy exceeds the median by
``REJECT_FACTOR`` times the distance from the median to the 95th percentile, and is
also worse than a uniform guess over the language's own symbols (the only bound of
a language of which no training row is recognised).

Null text or text without a letter: ``und``, score 0, rejected.  No training rows
at all: every text is ``und``.  Rows with null language train nothing.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, file_system, scratch_path, share, slices

ORDER = 5
SYMBOL_BITS = 12
SHARPNESS = 8.0
REJECT_FACTOR = 8.0
#: characters handled at once
AT_ONCE = 1 << 20

_table = [np.zeros(0, np.int64)]


def _symbols(limit: int) -> np.ndarray:
    """Symbol of every code point below ``limit`` at least: 0 for non-letters."""
    if len(_table[0]) < limit:
        code = np.arange(min(0x110000, max(2 * limit, 1 << 13)), dtype=np.int64)
        letter = np.fromiter((chr(c).isalpha() for c in code.tolist()), bool, len(code))
        size = 1 << SYMBOL_BITS
        _table[0] = np.where(letter, np.where(code < size, code, 1 + code * 2654435761 % (size - 1)), 0)
    return _table[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): n-gram keys of all texts end to end, and how many each text
    has.  A text starts with ORDER - 1 blanks as context; its last blank counts."""
    joined = [(" " * (ORDER - 1) + t.lower() + " ") if t else "" for t in texts]
    sizes = np.array([len(j) for j in joined], np.int64)
    code = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32)
    sym = _symbols(int(code.max(initial=0)) + 1)[code]
    start = np.cumsum(sizes) - sizes
    lead = np.zeros(len(sym), bool)
    for i in range(ORDER - 1):  # the leading blanks stay, further runs of blanks become one
        lead[(start + i)[sizes > 0]] = True
    use = (sym != 0) | lead
    use[1:] |= sym[:-1] != 0
    doc = np.repeat(np.arange(len(texts)), sizes)[use]
    sym, lead = sym[use], lead[use]
    key = np.zeros(len(sym), np.int64)
    for i in range(ORDER):
        key[i:] |= sym[:len(sym) - i] << (SYMBOL_BITS * i)
    scored = ~lead
    counts = np.bincount(doc[scored], minlength=len(texts))
    return key[scored], counts


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", AT_ONCE):
        lang = np.array(b.column("lang").to_pylist(), object)
        text = b.column("text").to_pylist()
        for one in sorted(set(lang)):
            key, _ = grams([t for t, x in zip(text, lang, strict=True) if x == one])
            k, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(k), pa.string()), pa.array(k), pa.array(n)],
                                             ["lang", "gram", "n"])


@dataclass
class Order:
    keys: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@lru_cache(maxsize=64)
def _load(path: str) -> list[Order]:
    fs, name = file_system(path)
    with fs.open_input_stream(name) as f:
        arrays = np.load(io.BytesIO(f.read()))
    return [Order(*[arrays[f"{part}{n}"] for part in ("keys", "prob", "contexts", "weight")]) for n in range(1, ORDER + 1)]


def _store(orders: list[Order], folder: str, spot: str) -> str:
    """Write a language's arrays under a name of this attempt alone."""
    data = io.BytesIO()
    np.savez(data, **{f"{part}{n}": getattr(o, part) for n, o in enumerate(orders, 1) for part in ("keys", "prob", "contexts", "weight")})
    path = f"{folder}/{spot}-{uuid.uuid4().hex}.npz"
    fs, name = file_system(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(data.getvalue())
    return path


@dataclass
class LanguageModel:
    """``paths``: the file of each language's arrays in the shared folder."""
    langs: list[str] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    uniform: dict[str, float] = field(default_factory=dict)
    limits: dict[str, float] = field(default_factory=dict)

    @property
    def orders(self) -> dict[str, list[Order]]:
        return {x: _load(p) for x, p in self.paths.items()}

    def log_probs(self, lang: str, key: np.ndarray) -> np.ndarray:
        return _log_probs(_load(self.paths[lang]), key)

    def predict(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        """Per text: language, score, cross-entropy of that language, rejected."""
        key, counts = grams(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        letters = np.bincount(owner[(key & ((1 << SYMBOL_BITS) - 1)) != 0], minlength=len(texts))
        some = (letters > 0) & bool(self.langs)
        lang = np.full(len(texts), "und", object)
        score, entropy = np.zeros(len(texts)), np.full(len(texts), np.nan)
        rejected = np.ones(len(texts), bool)
        if some.any():
            unique, back = np.unique(key, return_inverse=True)
            cross = np.stack([-np.bincount(owner, self.log_probs(x, unique)[back], len(texts))
                              for x in self.langs]) / np.maximum(counts, 1)
            best = cross.argmin(0)
            least = cross.min(0)
            total = np.exp(-SHARPNESS * (cross - least)).sum(0)
            lang[some] = np.array(self.langs, object)[best[some]]
            score[some], entropy[some] = (1 / total)[some], least[some]
            limit = np.array([self.limits.get(x, np.inf) for x in self.langs])
            rejected[some] = (least > limit[best])[some]
        return lang.tolist(), score.tolist(), [None if np.isnan(e) else e for e in entropy], rejected.tolist()

    def column(self, text: Column) -> Column:
        """struct(lang, score, entropy, rejected) of a text column."""
        shared = share(SparkSession.active(), self)

        @F.arrow_udf("struct<lang:string,score:double,entropy:double,rejected:boolean>")
        def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared()
            for column in columns:
                parts = [model.predict(p.column("text").to_pylist()) for p in
                         slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", AT_ONCE)]
                lang, score, entropy, rejected = ([x for p in parts for x in p[i]] for i in range(4))
                yield pa.StructArray.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["lang", "score", "entropy", "rejected"])

        return identify(text)


def _log_probs(orders: list[Order], key: np.ndarray) -> np.ndarray:
    """Back-off from the given orders, the shortest first."""
    p = np.full(len(key), 1.0 / (1 << SYMBOL_BITS))
    for n, o in enumerate(orders, 1):
        gram = key & ((1 << SYMBOL_BITS * n) - 1)
        if len(o.contexts):
            at, found = _find(o.contexts, gram >> SYMBOL_BITS)
            p[found] *= o.weight[at[found]]
        if len(o.keys):
            at, found = _find(o.keys, gram)
            p[found] = o.prob[at[found]]
    return np.log(p)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _order_rows(counts: DataFrame, max_grams: int | None) -> tuple[DataFrame, dict]:
    """n-grams of one order that enter the model, with the total of their context;
    the discount of each language."""
    ones = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    discount = {r.lang: r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5 for r in ones.collect()}
    context = F.shiftright("gram", SYMBOL_BITS)
    totals = counts.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
    if max_grams is not None:
        levels = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams"))
        above = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")))
        least = (levels.withColumn("above", above).where(F.col("above") <= max_grams)
                 .groupBy("lang").agg(F.min("n").alias("least")))
        counts = counts.join(least, "lang").where("n >= least")
    return counts.withColumn("context", context).join(totals, ["lang", "context"]), discount


def _build_language(folder: str, discounts: dict):
    """One language's n-grams of all orders (with the totals of their contexts) to its arrays."""
    def build(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        orders: list[Order] = []
        for n in range(1, ORDER + 1):
            t = rows.filter(pc.equal(rows["level"], n)).sort_by("gram")
            key, c, total = (t[x].to_numpy() for x in ("gram", "n", "total"))
            d = discounts[n].get(lang, 0.5)
            lower = np.exp(_log_probs(orders, key & ((1 << SYMBOL_BITS * (n - 1)) - 1)))
            contexts, first, back, types = np.unique(key >> SYMBOL_BITS, True, True, True)
            kept = np.bincount(back, c, len(contexts))  # less than the total where n-grams were dropped
            weight = (total[first] - kept + d * types) / total[first]
            orders.append(Order(key, np.maximum(c - d, 0) / total + weight[back] * lower, contexts, weight))
        uniform = float(np.log(max(len(orders[0].keys), 2)))
        return pa.table({"lang": [lang], "path": [_store(orders, folder, "language")], "uniform": [uniform]})
    return build


def train(df: DataFrame, text_col: str, lang_col: str, max_grams: int | None = None, calibrate: bool = True) -> LanguageModel:
    """Fit on every row of ``df`` with a non-null language."""
    spark = df.sparkSession
    scratch = Scratch(spark, "langid")
    rows = (df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .where("lang is not null and text is not null"))
    counts = scratch.keep(rows.mapInArrow(_count_rows, "lang string, gram long, n long")
                          .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    levels, all_rows, discounts = [counts], None, {}
    for n in range(ORDER, 0, -1):
        top, discounts[n] = _order_rows(counts, max_grams)
        top = top.select("lang", F.lit(n).alias("level"), "gram", "n", "total")
        all_rows = top if all_rows is None else all_rows.unionAll(top)
        if n > 1:  # continuation counts of the next lower order
            lower = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * (n - 1)) - 1))
            counts = scratch.keep(counts.groupBy("lang", lower.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lower")
            levels.append(counts)
    folder = scratch_path(spark, "langid-model")
    built = all_rows.groupBy("lang").applyInArrow(_build_language(folder, discounts), "lang string, path string, uniform double")
    found = {r.lang: r for r in built.collect()}  # a row a language
    scratch.drop(*levels)
    model = LanguageModel(sorted(found), {x: r.path for x, r in found.items()}, {x: r.uniform for x, r in found.items()})
    model.limits = dict(model.uniform)
    if calibrate and model.langs:
        scored = rows.select("lang", model.column(F.col("text")).alias("p"))
        for r in _limits(scored, model).collect():
            model.limits[r.lang] = r.limit
    return model


def _limits(scored: DataFrame, model: LanguageModel) -> DataFrame:
    """(lang, limit) from the texts, (lang, p), that are recognised as their language."""
    uniform = F.create_map(*[F.lit(v) for x in model.langs for v in (x, model.uniform[x])])
    q = F.percentile_approx("p.entropy", F.array(F.lit(0.5), F.lit(0.95)), 1000)
    return (scored.where("p.lang = lang").groupBy("lang").agg(q.alias("q"))
            .select("lang", F.greatest(uniform[F.col("lang")], F.col("q")[0] + REJECT_FACTOR * (F.col("q")[1] - F.col("q")[0])).alias("limit")))


def identify(df: DataFrame, id_col: str, text_col: str, model: LanguageModel) -> DataFrame:
    """(id, lang, score, entropy, rejected) per input row."""
    return (df.select(F.col(id_col).alias("id"), model.column(F.col(text_col)).alias("p"))
            .select("id", "p.lang", "p.score", "p.entropy", "p.rejected"))


def learn_and_identify(df: DataFrame, text_col: str, lang_col: str, learn: Column, keep: Column) -> DataFrame:
    """(kept, lang, score, entropy, rejected) per input row, learned from the rows of ``df`` with
    ``learn``; ``kept`` is what ``keep`` selects of a row.  Every text is scored once: the written
    verdicts give the rejection limits and are then held against them."""
    scratch = Scratch(df.sparkSession, "langid")
    model = train(df.where(learn), text_col, lang_col, calibrate=False)
    truth = F.when(learn & F.col(text_col).isNotNull(), F.col(lang_col).cast("string"))
    scored = scratch.keep(df.select(keep.alias("kept"), truth.alias("lang"), model.column(F.col(text_col)).alias("p")), "scored")
    if not model.langs:
        return scored.select("kept", "p.lang", "p.score", "p.entropy", "p.rejected")
    limits = scratch.keep(_limits(scored, model).select(F.col("lang").alias("l"), "limit"), "limits")  # a row a language
    uniform = F.create_map(*[F.lit(v) for x in model.langs for v in (x, model.uniform[x])])
    limit = F.coalesce("limit", uniform[F.col("p.lang")])
    return scored.join(limits, F.col("p.lang") == F.col("l"), "left").select(
        "kept", "p.lang", "p.score", "p.entropy", F.coalesce(F.col("p.entropy") > limit, F.lit(True)).alias("rejected"))
