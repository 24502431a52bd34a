"""Byte-pair encoding and decoding with a public tokenizer file.

Reads a ``tokenizers`` JSON file of the word kind: NFC, lower case, a split into
words, byte-level symbols, merges with an end-of-word suffix, special tokens taken
literally from the raw text.  The file's path is a parameter; its vocabulary is
small and fixed and goes to the tasks as a broadcast value.

*Merging* works on many words at once: the symbols of all new words of a batch
lie in one flat numpy array.  In each round all adjacent pairs get their rank by
binary search over the sorted pair keys, each word's lowest rank is found with a
segmented minimum, and all its occurrences are merged, left to right; words without
a known pair leave the array.  (A pair made by a merge always ranks below it, so
merging all occurrences at once equals merging one at a time.)  Words already encoded
are remembered, up to about ``REMEMBERED`` a task; beyond, the half that was met least is forgotten.

*Decoding* joins the tokens of the ids by one space (Arrow ``take`` and ``binary_join``), special
tokens included, as the library does for a file without a decoder.

Null text: no tokens, and the empty text when decoded.  Null ids: the empty text.
An id outside the vocabulary is skipped when decoding.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import share, slices

REMEMBERED = 200_000
#: characters that the word pattern calls white space
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Memory:
    """Words that have been encoded: their ids end to end, and how often each was met."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = self.starts = self.sizes = self.met = np.zeros(0, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def take(self, which: np.ndarray) -> np.ndarray:
        """Ids of the given words end to end."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def shrink(self, most: int) -> None:
        """Forget all but the ``most`` words met most often."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[:most])
        words = list(self.number)
        ids, sizes, met = self.take(keep), self.sizes[keep], self.met[keep]
        self.__init__()
        self.add([words[i] for i in keep.tolist()], ids, sizes)
        self.met = met // 2


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # of two special tokens that start alike the longer one counts
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
                                     if special else r"(?!)")
        self.special_id = special
        self.words = regex.compile(self._pattern(spec).replace(r"[^\s", f"[^{SPACE}"))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([self._key(vocab[a], vocab[b]) for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.pair_id = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())

    @staticmethod
    def _check(spec: dict) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("not a word-level BPE file with an end-of-word suffix")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"unknown normalizer {kinds}")

    @staticmethod
    def _pattern(spec: dict) -> str:
        return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @staticmethod
    def _key(a, b):
        return (a << 32) | b

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): token ids of all words end to end, and how many each word has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        sym[np.cumsum(sizes) - 1] = self.final[np.frombuffer(b"".join(r[-1:] for r in raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        ids, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(sym):
            key = self._key(sym[:-1], sym[1:])
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            known = (self.pair_key[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.pair_rank[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = np.repeat(least == NO_RANK, sizes)
            ids.append(sym[done])
            owner.append(word[done])
            hit = self._apart((rank == np.repeat(least, sizes)) & ~done)
            sym[:-1][hit[:-1]] = self.pair_id[at[hit[:-1]]]
            stay = ~done
            stay[1:] &= ~hit[:-1]
            sym, word = sym[stay], word[stay]
        whose = np.concatenate(owner)
        order = np.argsort(whose, kind="stable")
        return np.concatenate(ids)[order], np.bincount(whose, minlength=len(words))

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of pairs that overlap (a run of hits) every other one, from the left."""
        if not (hit[1:] & hit[:-1]).any():
            return hit
        index = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
        return hit & ((index - begin) % 2 == 0)

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order.  (No word looks like a special token:
        the pattern parts letters from other characters.)"""
        found = self.special.search(text)
        if not found:
            return self._plain(text)
        out: list = []
        at = 0
        for m in self.special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # lower-casing looks at one character at a time: a final capital sigma is like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode(self, texts: list[str | None], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): token ids of all texts end to end, and how many each text has."""
        memory = memory if memory is not None else Memory()
        if len(memory.number) > REMEMBERED:
            memory.shrink(REMEMBERED // 2)
        parts = [self.split(t) if t else [] for t in texts]
        words = list(chain.from_iterable(parts))
        new = set(words) - memory.number.keys()
        special = sorted(new & self.special_id.keys())
        if special:
            memory.add(special, np.array([self.special_id[s] for s in special], np.int64), np.ones(len(special), np.int64))
        new = sorted(new - self.special_id.keys())
        if new:
            memory.add(new, *self.merge(new))
        which = np.fromiter(map(memory.number.__getitem__, words), np.int64, len(words))
        memory.met += np.bincount(which, minlength=len(memory.met))
        total = np.r_[0, np.cumsum(memory.sizes[which])]
        return memory.take(which), np.diff(total[np.cumsum([0, *map(len, parts)])])

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: the token names are taken and joined by Arrow."""
        ids = ids.fill_null([]) if ids.null_count else ids
        flat, sizes = ids.flatten(), pc.list_value_length(ids).to_numpy()
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names))), False)
        if not pc.all(known, min_count=0).as_py():
            owner = np.repeat(np.arange(len(sizes)), sizes)[known.to_numpy(zero_copy_only=False)]
            flat, sizes = flat.filter(known), np.bincount(owner, minlength=len(sizes))
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), self.names.take(flat))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def encode(df: DataFrame, id_col, text_col, path: str) -> DataFrame:
    """(id, ids) per input row: the token ids of the whole text."""
    shared = share(df.sparkSession, WordBpe(path))
    rows = df.select(_col(id_col).alias("id"), _col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = shared(), Memory()
        for b in slices(batches, "text", 2 << 20):
            ids, counts = bpe.encode(b.column("text").to_pylist(), memory)
            ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "ids"])

    return rows.mapInArrow(run, _schema(rows, "ids array<int>"))


def decode(df: DataFrame, id_col, ids_col, path: str) -> DataFrame:
    """(id, text) per input row: the text of the token ids."""
    shared = share(df.sparkSession, WordBpe(path))
    rows = df.select(_col(id_col).alias("id"), _col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared()
        for b in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column("id"), bpe.decode(b.column("ids"))], ["id", "text"])

    return rows.mapInArrow(run, _schema(rows, "text string"))


def _schema(rows: DataFrame, more: str):
    return T.StructType([rows.schema["id"], *T.StructType.fromDDL(more).fields])
