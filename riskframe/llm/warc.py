"""Deterministic sharded WARC writer and reader.

Writing, as Spark jobs:

1. *Range sort.*  Records are ordered by key.  Range limits come from a sample that a
   hash of the records picks (the same rows on every run, ``SAMPLE`` a range in expectation),
   so the shards of a table never depend on timing.  A key held by more rows than a
   range takes is spread over several shards by a hash of the content.
2. *Duplicates.*  Of records with equal payloads of at least ``least_bytes`` bytes the
   one with the largest key is the response, the others revisit it.  The largest key
   per payload is found with partial aggregation, so a payload that a third of all
   records share costs one row per task.
3. *Writing.*  Each task writes its sorted records as one gzip member each, regenerates
   all headers and digests from the payload and rolls to a new file at
   ``roll_bytes`` compressed bytes.  Dates and record ids are derived from parameters
   and keys, so equal input gives equal bytes.
4. *Commit.*  Files are written under temporary names that are new for every attempt;
   tasks return one manifest row per finished file, and that manifest is itself
   written by Spark, so of repeated or speculative attempts exactly one counts.  A
   second job renames what the manifest lists to the final names (repeatable: a file
   already in place is left), and ``_MANIFEST`` is written last; readers only trust
   files it lists.

Reading streams the files of the manifest in parallel, checks sizes and digests of
the records and returns one row per record.

A null payload is empty; a null key sorts first and is written without a key header;
a null url is written as an empty target.  Equal payloads under the same largest key
(repeated rows): every row with that key is a response.  An empty table gives a
manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import count_below
from .common import Scratch, file_system

#: sampled keys per range
SAMPLE = 32
RECORDS_PER_RANGE = 2_000
#: most ranges, beyond which they hold more records; as many limits stand in the plan
MAX_RANGES = 8_192
EPOCH = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
MANIFEST = "_MANIFEST"
FILES, TEMPORARY = "files", "_temporary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"


def record_bytes(key, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record with regenerated headers; a revisit carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"),
            ("WARC-Record-ID", record_id(key)), ("WARC-Date", date),
            ("WARC-Target-URI", " ".join((url or "").split())),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)),
            ("X-Payload-Length", len(payload))]
    if key is not None:
        head.append(("X-Record-Key", key))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                 ("X-Refers-To-Key", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes records to temporary files and rolls them by compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = file_system(folder)
        self.roll_bytes, self.attempt = roll_bytes, uuid.uuid4().hex
        self.out = None

    def open(self, shard: int, number: int) -> None:
        self.shard, self.number, self.size, self.records = shard, number, 0, 0
        self.name = f"part-{shard:06d}-{number:05d}.warc.gz"
        self.temporary = f"{TEMPORARY}-{self.attempt}-{self.name}"
        self.sum = hashlib.sha256()
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.open(shard, 0)
        elif shard != self.shard:
            yield self.close()
            self.open(shard, 0)
        elif self.size and self.size + len(data) > self.roll_bytes:
            yield self.close()
            self.open(shard, self.number + 1)
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        return self.temporary, self.name, self.size, self.records, self.sum.hexdigest()


def _write_rows(folder: str, roll_bytes: int, date: str):
    schema = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()),
                        ("records", pa.int64()), ("sha256", pa.string())])

    def batch(files: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in files], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, roll_bytes)
        for b in batches:
            for i in range(b.num_rows):
                shard, key, url, payload, refers_to = (b.column(c)[i].as_py() for c in
                                                       ("shard", "key", "url", "payload", "refers_to"))
                data = gzip_member(record_bytes(key, url, (payload or "").encode(), refers_to, date))
                done = list(roller.add(shard, data))
                if done:
                    yield batch(done)
        if roller.out is not None:
            yield batch([roller.close()])

    return run


def _publish(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for temporary, name in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist(), strict=True):
                if fs.get_file_info(f"{path}/{temporary}").type == pa.fs.FileType.File:
                    fs.move(f"{path}/{temporary}", f"{path}/{name}")
                if fs.get_file_info(f"{path}/{name}").type != pa.fs.FileType.File:
                    raise FileNotFoundError(name)
            yield b.select(["name", "bytes", "records", "sha256"])
    return run


def _ranges(records: DataFrame) -> tuple[int, list]:
    """Number of shards for null keys, and the ascending limits of the key ranges from a hash-picked
    sample of SAMPLE keys a range (a key that fills several ranges is there several times)."""
    n = records.agg(F.count(F.lit(1)).alias("all"), F.count("key").alias("keys")).first()
    ranges = min(MAX_RANGES, max(1, n["keys"] // RECORDS_PER_RANGE))
    share = min(1.0, SAMPLE * ranges / max(n["keys"], 1))
    picked = (records.where("key is not null")
              .where(F.pmod(F.xxhash64("key", "url", "sha"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
              .select("key").orderBy("key").toArrow()["key"].to_numpy())  # about SAMPLE x ranges longs
    limits = [int(picked[len(picked) * i // ranges]) for i in range(1, ranges)] if len(picked) else []
    return min(MAX_RANGES, -(-(n["all"] - n["keys"]) // RECORDS_PER_RANGE)), limits


def with_shards(records: DataFrame, keyed: DataFrame) -> tuple[DataFrame, int]:
    """``records`` (key, url, sha, ...) with the number of the shard each falls in, and how many there are.  Shards
    follow key order; rows of one key (or of none) beyond a range are spread by content.
    ``keyed``: the key, url and sha of all records."""
    for_null, limits = _ranges(keyed)
    spread = F.xxhash64("sha", "url")
    shard = F.lit(0)
    if limits:
        table = F.array(*[F.lit(x) for x in limits])  # fewer than MAX_RANGES
        low, high = (count_below(table, len(limits), F.col("key"), equal) for equal in (False, True))
        shard = F.when(high - low > 1, low + 1 + F.pmod(spread, high - low).cast("int")).otherwise(high)
    out = records.withColumn("shard", F.when(F.col("key").isNull(), F.pmod(spread, F.lit(max(for_null, 1))).cast("int"))
                              .otherwise(shard + for_null).cast("int"))
    return out, for_null + len(limits) + 1


def write_warc(df: DataFrame, key_col: str, url_col: str, payload_col: str, folder: str,
               least_bytes: int = 0, roll_bytes: int = 16 << 20, date: str = EPOCH) -> DataFrame:
    """Write every row as a record below ``folder``; returns the published manifest
    (name, bytes, records, sha256)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "warc")
    records = df.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    same = [F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")]
    last = scratch.keep(records.select("key", *same).groupBy("sha", "size")
                        .agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
                        .where(f"n > 1 and size >= {int(least_bytes)}").drop("n"), "copies")
    marked = (records.select("*", *same).join(last, ["sha", "size"], "left")
              .withColumn("refers_to", F.when(F.col("last") > F.coalesce("key", F.col("last") - 1), F.col("last"))))
    shards, n_shards = with_shards(marked.select("key", "url", "payload", "refers_to", "sha"),
                         records.select("key", "url", same[0]))
    return _commit(spark, shards, n_shards, folder, roll_bytes, date, scratch)


def _commit(spark: SparkSession, records: DataFrame, n_shards: int, folder: str, roll_bytes: int, date: str,
            scratch: Scratch) -> DataFrame:
    """Write, publish and list the files; the list lies in the archive's own folder, and the manifest
    names it in one last rename.  What failed attempts left behind goes."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    laid = (records.repartition(n_shards, "shard")
            .sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "url", "sha")
            .select("shard", "key", "url", "payload", "refers_to"))
    written = scratch.keep(laid.mapInArrow(_write_rows(folder, roll_bytes, date),
                                           "temporary string, name string, bytes long, records long, sha256 string"),
                           "written")
    schema = "name string, bytes long, records long, sha256 string"
    files = f"{FILES}-{uuid.uuid4().hex}"
    written.mapInArrow(_publish(folder), schema).write.parquet(f"{folder}/{files}")
    manifest = spark.read.schema(schema).parquet(f"{folder}/{files}")
    totals = manifest.agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"),
                          F.sum("bytes").alias("bytes")).first().asDict()
    with fs.open_output_stream(f"{path}/{MANIFEST}-new") as out:
        out.write(json.dumps({"table": files, "date": date, **totals}, sort_keys=True).encode())
    fs.move(f"{path}/{MANIFEST}-new", f"{path}/{MANIFEST}")
    for f in fs.get_file_info(pa.fs.FileSelector(path)):
        if f.base_name.startswith(TEMPORARY):
            fs.delete_file(f.path)
    scratch.drop(written)
    return manifest


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a gzip stream of one member a record."""
    z, member, inside = zlib.decompressobj(31), [], False
    for piece in data:
        while piece:
            inside = True
            member.append(z.decompress(piece))
            if not z.eof:
                break
            piece = z.unused_data
            z = zlib.decompressobj(31)
            whole = b"".join(member)
            member, inside = [], False
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[:int(fields["Content-Length"])]
    if inside:
        raise ValueError("the archive ends inside a record")


def _read_rows(folder: str):
    names = ["key", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def row(fields: dict, block: bytes) -> tuple:
        if fields["WARC-Block-Digest"] != "sha1:" + digest(block):
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or digest(payload) != found):
            raise ValueError(f"payload of {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if k in fields else None
        return (number("X-Record-Key"), kind, size, found, number("X-Refers-To-Key"), fields["WARC-Target-URI"],
                payload.decode() if kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for name, count in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for fields, block in parse_records(iter(lambda: f.read(1 << 20), b"")):  # noqa: B023
                        rows.append(row(fields, block))
                        seen, size = seen + 1, size + len(block)
                        if size > 4 << 20:
                            yield _batch(rows, names, types)
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{name} holds {seen} records, the manifest says {count}")
                if rows:
                    yield _batch(rows, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to, url, payload): one
    row per record of the files in the folder's manifest; a revisit's payload is null."""
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        manifest = spark.read.schema("name string, bytes long, records long, sha256 string").parquet(
            f"{folder}/{json.loads(f.read())['table']}")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("name", "records").repartition(parts).mapInArrow(
        _read_rows(folder), "key long, record_type string, payload_bytes long, payload_digest string, "
                            "refers_to long, url string, payload string")
