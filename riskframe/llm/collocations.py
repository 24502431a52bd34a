"""Phrase collocations mined with SETM (set-oriented mining over persisted relations).

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and into words at
spaces and tabs.  The relation R_k holds one entry per occurrence of a frequent phrase of
k words, sorted by piece and position, and is persisted before it is extended:

1. R_k is merge-joined with itself on piece and adjacent position: phrases at p and p + 1
   that overlap in k - 1 words give the occurrences of phrases of k + 1 words.
2. Those are group-counted.
3. The occurrences are semi-joined with the groups of at least ``least`` occurrences, which
   gives R_{k+1}.

Occurrences are stored in blocks of about ``BLOCK_WORDS`` words, one row a block: sorted
positions (a piece's end takes a position of its own, so neighbours are always of one
piece), the block's own number of the phrase at each, and the words of those phrases as
31-bit word numbers, so that counts are exact; a hash only deals them out.  The merge join runs
inside a block; what is shuffled is one entry per distinct phrase of a block, so that a phrase
that holds a third of all words is as many entries as there are blocks.  Entries travel
packed, one row per block and hash bucket; there are as many buckets as keep one at about
``BUCKET_WORDS`` entries, and a task counts the phrases of one bucket at a time.

*Score* of a phrase cut after its first j words: floor(1000 a n / (l r)) with a, l, r the
occurrences of the phrase and its two parts and n the words of the language, in
decimals of 38 digits; the lowest cut counts (ties: smallest j).  A phrase is dropped if a longer
frequent phrase around it has at least ``share`` percent of its occurrences; looking at
phrases one word longer suffices, since they occur at least as often as what contains them.

Result cases: null text is empty, null language ``und``; repeated rows count as often as they
stand; texts without words and empty tables give no phrases; long texts are encoded in
slices, cut between words.  Further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, slices

BLOCK_WORDS = 1 << 22
#: bytes of a text encoded at once
SLICE = 1 << 20
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _ENDS, _LOWER + b" " + b"\n" * len(_ENDS))
_RELATION = "block long, steps binary, ids binary, groups binary"
#: entries of a hash bucket, at most about
BUCKET_WORDS = 1 << 22


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes, all lowest bytes first."""
    raw = np.ascontiguousarray(numbers, np.int32).ravel().view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()


class _Encoder:
    """Word numbers of one language in one block; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        self.number = defaultdict(int, {b"": 0, b"\n": 1})
        self.number.default_factory = self.number.__len__
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        text, at = text.translate(_PLAIN), 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # up to the next end of a word
                ends = [e for e in (text.find(b" ", end), text.find(b"\n", end)) if e >= 0]
                end = min(ends, default=len(text))
            words = text[at:end].replace(b"\n", b" \n ").split(b" ")
            code = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            self.parts.append(code[code > 0])
            self.size += len(self.parts[-1])
            at = end
        self.parts.append(np.ones(1, np.int32))

    def row(self) -> tuple[list, np.ndarray, np.ndarray]:
        code = np.concatenate(self.parts) - 2
        words = list(self.number)[2:]
        return words, np.bincount(code[code >= 0], minlength=len(words)), code


def _block_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    coders: dict[str, _Encoder] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq
        for lang in sorted(coders):
            words, counts, code = coders[lang].row()
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + seq]), pa.array([lang]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                     pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(code)])],
                    ["block", "lang", "words", "counts", "codes"])
                seq += 1
        coders.clear()

    for b in slices(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text")), strict=True):
            coders.setdefault(lang, _Encoder()).add(text)
            if sum(c.size for c in coders.values()) >= most:
                yield from flush()
    yield from flush()


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by ``column`` to (its value, the rows)."""
    now, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for at, end in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            if key[at] != now:
                if parts:
                    yield now, parts
                now, parts = key[at], []
            parts.append(b.slice(int(at), int(end - at)))
    if parts:
        yield now, parts


def _with_own(parts: list[pa.RecordBatch]) -> tuple[list[np.ndarray] | None, list[pa.RecordBatch]]:
    """The block's own arrays, if its row is there (it comes first), and the other rows."""
    first = parts[0]
    if not first.column("left")[0].is_valid:
        return None, parts
    own = [_unpack(x) for x in (first.column(c)[0].as_py() for c in ("left", "right", "groups")) if x is not None]
    return own, [p for p in (first.slice(1), *parts[1:]) if p.num_rows]


def _relation_batch(block: int, pos: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([_pack(x)]) for x in (np.diff(pos, prepend=0), ids, groups)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *packed], ["block", "steps", "ids", "groups"])


def _first_relation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """R_1: positions of frequent words; rows (word of the block, its number)."""
    for block, parts in _runs(batches, "block"):
        own, rows = _with_own(parts)
        if own is None or not rows:
            continue
        place, number = (np.concatenate([p.column(c).to_numpy() for p in rows]) for c in ("place", "number"))
        code, = own
        ids = np.full(int(code.max()) + 2, -1, np.int64)  # the last entry is that of code -1
        ids[place] = np.arange(len(place))
        at = ids[code]
        pos = np.flatnonzero(at >= 0)
        yield _relation_batch(block, pos, at[pos], number)


def _adjacent(k: int, steps: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> tuple:
    """Merge join of phrases of k words on piece and adjacent position: positions, the number
    of the joined phrase at each, and the words and occurrences of those phrases."""
    groups = groups.reshape(-1, k)
    pos, number = np.cumsum(steps), ids.astype(np.int64)
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    pair, which, n = np.unique(number[at] << 32 | number[at + 1], return_inverse=True, return_counts=True)
    words = np.concatenate([groups[pair >> 32], groups[pair & 0xFFFFFFFF][:, -1:]], 1).astype(np.int64)
    return pos[at], which, words, n


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Hash bucket of each phrase."""
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def _candidate_rows(k: int, buckets: int):
    """Distinct joined phrases of each block with their occurrences, packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *own in zip(*[b.column(c).to_pylist() for c in ("block", "steps", "ids", "groups")], strict=True):
                _, _, words, n = _adjacent(k, *[_unpack(x) for x in own])
                if not len(n):
                    continue
                bucket = _bucket(words, buckets)
                order = np.argsort(bucket, kind="stable")
                words, n, bucket = words[order], n[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                spans = list(zip(cuts, np.r_[cuts[1:], len(n)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts], pa.int32()), pa.array(np.full(len(cuts), block)),
                     pa.array([_pack(words[i:j].T) for i, j in spans]), pa.array([_pack(n[i:j]) for i, j in spans])],
                    ["bucket", "block", "words", "n"])
    return run


def _same(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each phrase, one row of each group)."""
    order = np.lexsort(words.T[::-1])
    new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(1)]
    group = np.empty(len(words), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _count_rows(k: int, least: int):
    """Group-count of the phrases (k words) of each bucket: the frequent ones of every block that has
    some, and all of the bucket with their occurrences as block -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, "bucket"):
            blocks = np.concatenate([p.column("block").to_numpy() for p in parts])
            n = [_unpack(x) for p in parts for x in p.column("n").to_pylist()]
            words = np.concatenate([_unpack(x).reshape(k, -1).T for p in parts for x in p.column("words").to_pylist()])
            sizes = [len(x) for x in n]
            group, one = _same(words)
            total = np.bincount(group, np.concatenate(n).astype(float)).astype(np.int64)  # exact below 2^53
            frequent = total >= least
            if not frequent.any():
                continue
            stay = frequent[group]
            out = [(-1, _pack(words[one[frequent]].T), total[frequent].tolist())]
            for block, i, j in zip(blocks.tolist(), np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes), strict=True):
                if stay[i:j].any():
                    out.append((block, _pack(words[i:j][stay[i:j]].T), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["block", "words", "a"])
    return run


def _phrase_rows(k: int):
    """The frequent phrases of a bucket as rows (words, a)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, a in zip(b.column("words").to_pylist(), b.column("a"), strict=True):
                rows = np.ascontiguousarray(_unpack(words).reshape(k, -1).T, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([lists, a.values], ["words", "a"])
    return run


def _next_relation(k: int):
    """R_{k+1}: adjacent phrases of k words, semi-joined with the frequent ones of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _runs(batches, "block"):
            own, rows = _with_own(parts)
            if own is None or not rows:
                continue
            frequent = np.concatenate([_unpack(x).reshape(k + 1, -1).T for p in rows for x in p.column("words").to_pylist()])
            pos, which, words, _ = _adjacent(k, *own)
            group, _ = _same(np.concatenate([frequent.astype(np.int64), words]))
            hit = np.isin(group[len(frequent):], group[:len(frequent)])
            number = np.cumsum(hit) - 1
            stay = hit[which]
            yield _relation_batch(block, pos[stay], number[which[stay]], words[hit])
    return run


def _stream(own: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Blocks (block, left, right, groups) and their rows (block, ``names``), together by block."""
    parts = own.select("block", "left", "right", "groups", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names])
    none = [F.lit(None).cast("binary").alias(c) for c in ("left", "right", "groups")]
    return (parts.unionAll(rows.select("block", *none, *names))
            .repartition("block").sortWithinPartitions("block", F.col("left").isNull()))


def _words(blocks: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(block, place, number, lang, word, a): frequent words of each block, ``place`` their number in the
    block, ``number`` that in all: the rank inside a hash bucket times the number of buckets plus the bucket."""
    buckets = 8 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        F.pmod(F.xxhash64("lang", "w.words"), F.lit(buckets)).cast("int").alias("bucket"), "lang",
        F.col("w.words").alias("word"), "block", F.col("place").cast("long").alias("place"), F.col("w.counts").alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket", "lang", "word"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    kept = scratch.keep(rows.repartition("bucket").withColumn("a", total).where(F.col("a") >= least)
                        .select("block", "place", ((rank.cast("long") - 1) * buckets + F.col("bucket")).alias("number"), "lang", "word", "a"),
                        "f1-rows")
    top = kept.agg(F.max("number")).first()[0] or 0
    if top >= 1 << 31:
        raise ValueError(f"word number {top}; word numbers have 31 bits")
    return kept


def frequent_phrases(df: DataFrame, text: str, lang: str, least: int, longest: int, scratch: Scratch,
                     block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(words per language (lang, n), frequent words (id, lang, word), [frequent phrases of 1 word, of 2
    words, ...] as (words: array of word numbers, a))."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = scratch.keep(rows.mapInArrow(lambda b: _block_rows(b, block_words),
                                          "block long, lang string, words array<string>, counts array<long>, codes binary"),
                          "blocks", "zstd")
    sizes = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    sizes = scratch.keep(sizes, "sizes")
    kept = _words(blocks, least, scratch)
    words = scratch.keep(kept.groupBy(F.col("number").cast("int").alias("id")).agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"), F.min("a").alias("a")), "words")
    none = F.lit(None).cast("binary")
    own = blocks.select("block", F.col("codes").alias("left"), none.alias("right"), none.alias("groups"))
    relation = scratch.keep(_stream(own, kept, ["place", "number"]).mapInArrow(_first_relation, _RELATION), "r1")
    scratch.drop(blocks, kept)
    phrases = [words.select(F.array("id").alias("words"), "a")]
    n = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = min(-(-n // BUCKET_WORDS) or 1, (1 << 31) - 1)
    for k in range(1, longest):
        dealt = (relation.mapInArrow(_candidate_rows(k, buckets), "bucket int, block long, words binary, n binary")
                 .repartition("bucket").sortWithinPartitions("bucket"))
        counted = scratch.keep(dealt.mapInArrow(_count_rows(k + 1, least), "block long, words binary, a array<long>"), f"f{k + 1}")
        found = counted.where("block = -1").select("words", "a").mapInArrow(_phrase_rows(k + 1), "words array<int>, a long")
        phrases.append(scratch.keep(found, f"p{k + 1}"))
        if k + 1 < longest:
            own = relation.select("block", F.col("steps").alias("left"), F.col("ids").alias("right"), "groups")
            new = scratch.keep(_stream(own, counted.where("block >= 0"), ["words"]).mapInArrow(_next_relation(k), _RELATION), f"r{k + 1}")
            scratch.drop(relation)
            relation = new
        scratch.drop(counted)
    scratch.drop(relation)
    return sizes, words, phrases


def collocations(df: DataFrame, text: str, lang: str, least: int = 100, longest: int = 5, share: int = 100,
                 top: int | None = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases (all with ``top=None``)."""
    spark = df.sparkSession
    # a written step needs its shuffle files no longer; Spark then removes them itself
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        scratch = Scratch(spark, "collocations")
        scored = _scored(*frequent_phrases(df, text, lang, least, longest, scratch, block_words), share, scratch)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(sizes: DataFrame, words: DataFrame, phrases: list[DataFrame], share: int, scratch: Scratch) -> DataFrame:
    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    counts = scratch.keep(union(phrases[:-1]), "counts")
    found = union(phrases[1:])
    # what phrases one word longer leave; array positions from the end: all but the last, all but the first
    around = union([p.select(part.alias("words"), F.col("a").alias("most")) for p in phrases[2:]
                    for part in (F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")))] or
                   [found.select("words", F.col("a").alias("most")).where(F.lit(False))])
    around = scratch.keep(around.groupBy("words").agg(F.max("most").alias("most")), "around")
    kept = found.join(around, "words", "left").where(f"most is null or 100 * most < {int(share)} * a").select("words", "a")
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("j")).select(
        "words", "a", "j", F.slice("words", F.lit(1), F.col("j")).alias("first"),
        F.slice("words", F.col("j") + 1, F.size("words")).alias("rest"))
    part = [counts.select(F.col("words").alias(c), F.col("a").alias(f)) for c, f in (("first", "l"), ("rest", "r"))]
    texts = scratch.keep(kept.select(F.col("words").alias("phrase_words"), F.posexplode("words").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
                         .groupBy(F.col("phrase_words").alias("words"))
                         .agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
                         .select("words", "lang", F.array_join("w.word", " ").alias("phrase")), "texts")
    lowest = (cuts.join(part[0], "first").join(part[1], "rest").join(texts, "words").join(sizes, "lang")
              .groupBy("lang", "phrase").agg(F.min(F.struct(_score().alias("score"), "j", "l", "r", "a", "n")).alias("c")))
    return scratch.keep(lowest.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score"), "scored")


def _score():
    big = "decimal(18,0)"
    return F.expr(f"(1000 * (cast(a as {big}) * cast(n as {big}))) div (cast(l as {big}) * cast(r as {big}))")
