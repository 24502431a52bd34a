"""Key membership and merge (JOIN1, JOIN2, SET1).  A null key is a key like any other:
once it is in the reference it is known, so a merge can be repeated without change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .keys import join_on


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: bits of a key filter, at most (8 MB), and per reference key
FILTER_BITS, BITS_PER_KEY = 1 << 26, 16


def _bit(k: list[str], bits: int):
    """The bit of a row's key, numbered from 1 as the bitmap functions do."""
    return F.pmod(F.xxhash64(*k, F.lit(17)), F.lit(bits)) + 1


def key_filter(known: DataFrame, k: list[str], n: int) -> tuple[DataFrame, int]:
    """(bucket, bitmap): a Bloom filter of one hash over ``n`` keys as rows of 4 KB bitmaps, built with partial
    aggregation, and its number of bits.  It never has more than FILTER_BITS, whatever the table's
    size: a full filter lets every key pass."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    bit = _bit(k, bits)
    return known.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap")), bits


def maybe_known(new: DataFrame, known: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """``new`` with ``_maybe``: false only for rows whose key is certainly not among the ``n`` keys of ``known``."""
    k = _keys(key)
    found, bits = key_filter(known, k, n)
    bit = _bit(k, bits)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1") == 1
    # at most FILTER_BITS / 32768 bitmaps: a broadcast of bounded size
    return (new.withColumn("_at", F.bitmap_bucket_number(bit)).withColumn("_place", place)
            .join(F.broadcast(keep(found, "key-filter")), F.col("_at") == F.col("_bucket"), "left")
            .withColumn("_byte", byte).withColumn("_maybe", F.coalesce(set_, F.lit(False)))
            .drop("_at", "_place", "_bucket", "_bitmap", "_byte"))


def _known_keys_of(reference: DataFrame, k: list[str]) -> DataFrame:
    """The reference's keys, each once, written: so Spark sees the other side of a join with them as
    one that it may split where a key is hot."""
    return keep(reference.select(*k).distinct(), "known-keys")


def rows_to_insert(new: DataFrame, reference: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """JOIN1: rows of ``new`` whose key is not in ``reference`` (empty frame when all known).

    The reference keys are de-duplicated with partial aggregation and written once.  Rows that a Bloom
    filter of them rules out are new and skip the join's shuffle; only the others are anti-joined,
    and a key that many of them share is split by Spark.  (A stream meets the written keys directly.)
    """
    k = _keys(key)
    known = _known_keys_of(reference, k)
    if new.isStreaming:
        return join_on(new, known, k, "left_anti")
    marked = maybe_known(new, known, k, known.count())
    return marked.where("NOT _maybe").drop("_maybe").unionAll(join_on(marked.where("_maybe").drop("_maybe"), known, k, "left_anti"))


def known_keys(new: DataFrame, reference: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """JOIN2: rows of ``new`` whose key already exists in ``reference``."""
    k = _keys(key)
    known = _known_keys_of(reference, k)
    if not new.isStreaming:
        new = maybe_known(new, known, k, known.count()).where("_maybe").drop("_maybe")
    return join_on(new, known, k, "left_semi")


def known_key_count(new: DataFrame, reference: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """JOIN2: one row with the number of new rows whose key is known."""
    return known_keys(new, reference, key).agg(F.count(F.lit(1)).alias("known"))


def insert_if_new(reference: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """SET1: reference plus the new rows with unseen keys (by column name)."""
    return reference.unionByName(rows_to_insert(new, reference, key))
