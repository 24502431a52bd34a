"""Exact substring de-duplication by window minimizers and window hashes, in
place of a relative Lempel-Ziv parse: there are no greedy factors.

Every word that lies in a window of ``window`` consecutive words which also
starts anywhere else (in the same document too) is removed.  The corpus is its
own reference:

1. *Index.*  Of each window the smallest of its hashed word grams is
   its anchor (leftmost on ties), so equal windows have equal anchors at equal
   offsets.  The phrase of an anchor is the text that all windows round it span.
   An anchor that occurs once marks no duplicate and leaves the index.
2. *Whole phrases.*  Each anchor is judged on its own: where its phrase occurs
   again, all windows round it are duplicates.
3. *Parts of phrases.*  Elsewhere each window of the phrase is looked up by its
   own hash among the other phrases with that anchor, so a duplicate that starts
   or ends inside a phrase is found as well.
4. Words of duplicate windows become spans and are dropped.

A mask of 64 bits names the windows round an anchor, so ``window`` is at most
``GRAM`` + 63 words; larger ones raise ValueError.

Equality is decided on the pair (anchor hash, window hash), 128 bits.  Only
anchors (2 words in 25) are shuffled, not windows.  Copies of a passage are
counted with partial aggregation before the shuffle; joins on an anchor that a
third of all rows share are equi-joins that AQE may split; no pairs of documents
are ever made.  Texts are keyed by (xxhash64, length), copies share their spans.

Null text: no words.  Texts shorter than a window keep all words.  Repeated rows
each get a result (and count as occurrences elsewhere).  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, as_bytes, slices

#: words in a gram that can be an anchor
GRAM = 12
#: phrases of an anchor that a task compares on its own (16 MB of hashes)
MANY = 1 << 16
#: odd multiplier of the polynomial hashes (mod 2^64) and its inverse
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Parse:
    """Anchors of a list of documents (as arrays of word hashes), laid end to end."""

    def __init__(self, docs: list[np.ndarray], window: int):
        self.window, self.spread = window, window - GRAM
        sizes = np.array([len(d) for d in docs], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        h = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        n = len(h)
        self.at = np.zeros(0, np.int64)
        if n >= window and sizes.max() >= window:
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(h * _powers(BASE, n), out=self.prefix[1:])
            self.inverse = _powers(_INVERSE, n)
            self.at = self._anchors(n, sizes)
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def _anchors(self, n: int, sizes: np.ndarray) -> np.ndarray:
        first = np.arange(n - GRAM + 1)
        least, where = self.hash(first, first + GRAM), first
        span, most = 1, self.spread + 1

        def merge(by, least, where):
            right = least[by:] < least[:-by]
            return np.where(right, least[by:], least[:-by]), np.where(right, where[by:], where[:-by])

        while 2 * span <= most:
            least, where = merge(span, least, where)
            span *= 2
        if span < most:
            least, where = merge(most - span, least, where)
        whole = sizes >= self.window
        step = np.zeros(n + 1, np.int8)  # a document's first window may be another's first bad one
        step[self.starts[whole]] += 1
        np.subtract.at(step, self.ends[whole] - self.window + 1, 1)
        chosen = where[np.flatnonzero(np.cumsum(step, dtype=np.int8)[:len(where)])]
        return chosen[np.r_[True, chosen[1:] != chosen[:-1]]]

    def anchor_hashes(self) -> np.ndarray:
        return self.hash(self.at, self.at + GRAM)

    def phrase_hashes(self) -> np.ndarray:
        low = np.maximum(self.starts[self.doc], self.at - self.spread)
        high = np.minimum(self.ends[self.doc], self.at + GRAM + self.spread)
        return _mix(self.hash(low, high) + (self.at - low).astype(np.uint64))

    def positions(self) -> np.ndarray:
        return self.at - self.starts[self.doc]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(window: int, located: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = Parse([word_hashes(t) for t in as_bytes(b.column("text"))], window)
            if not len(p.at):
                continue
            columns = {"anchor": _longs(p.anchor_hashes()), "phrase": _longs(p.phrase_hashes())}
            if located:
                row = pa.array(p.doc)
                columns |= {"key": b.column("key").take(row), "size": b.column("size").take(row),
                            "pos": pa.array(p.positions(), pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)
    return run


def _boundary_rows(window: int):
    """Of each phrase named in ``found``: the hashes of the windows that hold its anchor
    (``hashes[b]`` of the one that starts b words before it, if bit b of ``have`` is set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # copies of a text stand together and name the same phrases: once is enough
        for b in slices(batches, "text"):
            where = list(zip(b.column("key").to_pylist(), b.column("size").to_pylist(), strict=True))
            new, before, seen = [], seen, set()
            for i, w in enumerate(where):
                if w not in seen and w not in before:
                    new.append(i)
                seen.add(w)
            b = b.take(pa.array(new, pa.int64()))
            p = Parse([word_hashes(t) for t in as_bytes(b.column("text"))], window)
            found = b.column("found").to_pylist()
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [f for one in found for f in one]
            if not len(p.at) or not flat:
                continue
            pick = lambda name: np.array([f[name] for f in flat], np.int64)  # noqa: E731, B023
            back = np.arange(p.spread + 1)
            start = (pick("pos") + p.starts[doc])[:, None] - back
            ok = (start >= p.starts[doc][:, None]) & (start + window <= p.ends[doc][:, None])
            hashes = np.zeros(start.shape, np.int64)
            hashes[ok] = p.hash(start[ok], start[ok] + window).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, len(back), dtype=np.int32), hashes.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pick("anchor")), pa.array(pick("phrase")), pa.array(pick("n")),
                 pa.array([f["many"] for f in flat]), pa.array((ok << back).sum(1)), lists],
                ["anchor", "phrase", "n", "many", "have", "hashes"])
    return run


def _match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> (anchor, phrase, mask) of single phrases: which of their
    windows another phrase of the anchor holds as well."""

    def match(anchor, phrase, n, have, hashes) -> pa.RecordBatch:
        back = np.arange(hashes.shape[1])
        number = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
        row, col = np.nonzero(have[:, None] >> back & 1)
        place, h = number[row] * len(back) + col, hashes[row, col]
        order = np.lexsort((h, place))
        row, col, place, h = row[order], col[order], place[order], h[order]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (h[1:] != h[:-1])][:len(row)])
        times = np.add.reduceat(n[row], first) if len(row) else np.zeros(0, np.int64)
        again = np.repeat(times > 1, np.diff(np.r_[first, len(row)]))
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, row[again], np.int64(1) << col[again])
        out = (n == 1) & (mask != 0)
        return pa.RecordBatch.from_arrays([pa.array(anchor[out]), pa.array(phrase[out]), pa.array(mask[out])],
                                          ["anchor", "phrase", "mask"])

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(c)) for c in ("anchor", "phrase", "n", "have")]
        cols.append(np.asarray(b.column("hashes").flatten()).reshape(b.num_rows, -1))
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if (cols[0] != cols[0][-1]).any() else 0
        rest = [c[last:] for c in cols]  # the last anchor may go on in the next batch
        if last:
            yield match(*[c[:last] for c in cols])
    if rest is not None:
        yield match(*rest)


def covered(n_words: int, found: list, window: int) -> np.ndarray:
    """Which words lie in a duplicate window.  found: (pos, mask); bit b of the
    mask marks the window that starts b words before the anchor."""
    step = np.zeros(n_words + 1, np.int64)
    if found and n_words >= window:
        pos = np.array([f["pos"] for f in found], np.int64)
        mask = np.array([f["mask"] for f in found], np.int64)
        back = np.arange(window - GRAM + 1)
        start = pos[:, None] - back
        ok = (mask[:, None] >> back & 1).astype(bool) & (start >= 0) & (start + window <= n_words)
        first = start[ok]
        np.add.at(step, first, 1)
        np.add.at(step, first + window, -1)
    return np.cumsum(step)[:-1] > 0


def _spans(cover: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
    return [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _cut_rows(window: int, respace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, found in zip(as_bytes(b.column("text")), b.column("found").to_pylist(), strict=True):
                words = (text or b"").split()
                cover = covered(len(words), found or [], window)
                n_words.append(len(words))
                n_removed.append(int(cover.sum()))
                kept.append(b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c)
                            if n_removed[-1] else b" ".join(words) if respace else text)
                spans.append(_spans(cover) if n_removed[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                ["id", "n_words", "n_removed", "kept", "spans"])
    return run


def _masks(phrases: DataFrame, docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(anchor, phrase, mask) of the phrases (anchor, phrase, n, place) of anchors with several
    phrases: one that occurs again is matched whole, of the others each window is looked up
    among all phrases of the anchor."""
    per = phrases.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    open_ = per.where("least = 1").select("anchor", (F.col("k") > MANY).alias("many"))
    named = (phrases.join(open_, "anchor")
             .select("place.key", "place.size", F.struct("place.pos", "anchor", "phrase", "n", "many").alias("f"))
             .groupBy("key", "size").agg(F.collect_list("f").alias("found")))
    looked = scratch.keep(docs.select("key", "size", "text").join(named, ["key", "size"])
                          .mapInArrow(_boundary_rows(window), "anchor long, phrase long, n long, many boolean, "
                                                              "have long, hashes array<long>"), "boundaries")
    scratch.release()
    few = (looked.where("not many").drop("many").repartition("anchor").sortWithinPartitions("anchor")
           .mapInArrow(_match_rows, "anchor long, phrase long, mask long"))
    # an anchor with very many phrases is matched window by window, with partial aggregation
    windows = (looked.where("many").select("anchor", "phrase", "n", "have", F.posexplode("hashes").alias("back", "hash"))
               .where("shiftright(have, back) & 1 = 1"))
    again = (windows.groupBy("anchor", "back", "hash")
             .agg(F.max("n").alias("most"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
             .where("most > 1 or low <> high").select("anchor", "back", "hash"))
    many = (windows.where("n = 1").join(again, ["anchor", "back", "hash"])
            .groupBy("anchor", "phrase").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask")))
    whole = phrases.where("n > 1").select("anchor", "phrase", F.lit(-1).cast("long").alias("mask"))
    return few.unionByName(many).unionByName(whole)


def duplicate_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(key, size, found): per text with a duplicate window its anchors and masks."""
    index = (docs.select("text").mapInArrow(_anchor_rows(window, False), "anchor long, phrase long")
             .groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("low"),
                                    F.max("phrase").alias("high"))
             .where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("whole")))
    places = docs.select("key", "size", "text").mapInArrow(
        _anchor_rows(window, True), "anchor long, phrase long, key long, size int, pos int")
    hits = scratch.keep(places.join(index, "anchor"), "hits")
    scratch.release()
    phrases = scratch.keep(hits.where("not whole").groupBy("anchor", "phrase").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "size", "pos")).alias("place")), "phrases")
    masks = _masks(phrases, docs, window, scratch)
    marked = (hits.where("whole").select("key", "size", "pos", F.lit(-1).cast("long").alias("mask"))
              .unionByName(hits.where("not whole").join(masks, ["anchor", "phrase"])
                           .select("key", "size", "pos", "mask")))
    found = scratch.keep(marked.groupBy("key", "size", "pos").agg(F.bit_or("mask").alias("mask"))
                         .groupBy("key", "size").agg(F.collect_list(F.struct("pos", "mask")).alias("found")), "found")
    scratch.drop(hits, phrases)
    scratch.release()
    return found


def remove_repeats(df: DataFrame, id_col: str | Column, text_col: str, window: int = 35,
                   respace: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) per input row: the words left, joined by
    one space (without ``respace`` a text that loses nothing stays as it is), and the
    removed spans (start word, length)."""
    if window <= GRAM:
        raise ValueError(f"window must exceed {GRAM} words")
    if window > GRAM + 63:
        raise ValueError(f"window must not exceed {GRAM + 63} words: masks have 64 bits")
    scratch = Scratch(df.sparkSession, "substring")
    docs = (df.select(F.col(id_col).alias("id") if isinstance(id_col, str) else id_col.alias("id"), F.col(text_col).alias("text"))
            .withColumn("key", F.xxhash64("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))))
    found = duplicate_windows(docs, window, scratch)
    more = T.StructType.fromDDL("n_words long, n_removed long, kept string, spans array<struct<start:int,length:int>>")
    return (docs.join(found, ["key", "size"], "left").select("id", "text", "found")
            .mapInArrow(_cut_rows(window, respace), T.StructType([docs.schema["id"], *more.fields])))
