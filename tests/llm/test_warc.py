"""Web archives: exact round trip, duplicates, rolling, deterministic bytes."""

import base64
import gzip
import hashlib
import json
import os
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.llm import queries, warc
from riskframe.llm.warc import read_warc, write_warc
from riskframe.session import clear_scratch


def brute(pages, least=0):
    last = {}
    for i, html in pages:
        last[html] = max(last.get(html, i), i)
    out = []
    for i, html in pages:
        data = html.encode()
        dup = len(data) >= least and last[html] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if dup else "response", last[html] if dup else None))
    return sorted(out)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    t = pd.read_parquet(f"{sf}/pages.parquet")
    got = queries.QUERIES["op9_warc"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == brute([(i, h or "") for i, h in zip(t.page_id, t.html, strict=True)])


@pytest.fixture
def pages(rows):
    data = [(i, f"http://h/{i}", f"<p>{i % 7} ü</p>" * (i % 50)) for i in range(500)] + [(1000, None, None), (1001, "u v\r\nX: y", "")]
    return rows("page_id long, url string, html string, refers_to int, shard string", *[(*d, 1, "x") for d in data]), data


def test_rolls_files_and_round_trips(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_RANGE", 120)
    df, data = pages
    folders = [str(tmp_path / n) for n in "ab"]
    for folder, parts in zip(folders, (3, 11), strict=True):
        manifest = write_warc(df.repartition(parts), "page_id", "url", "html", folder, least_bytes=10, roll_bytes=4000).collect()
        assert len(manifest) > 4 and sum(r.records for r in manifest) == 502
        names = {r.name for r in manifest}
        assert {n for n in os.listdir(folder) if not n.startswith("files-")} == names | {"_MANIFEST"}
        for r in manifest:
            with open(f"{folder}/{r.name}", "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == r.sha256
        with open(f"{folder}/_MANIFEST") as f:
            assert json.load(f)["records"] == 502
        back = read_warc(spark, folder).collect()
        assert sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == \
            brute([(d[0], d[2] or "") for d in data], 10)
        assert {r.key: r.payload for r in back if r.record_type == "response"}.items() <= {d[0]: d[2] or "" for d in data}.items()
    read = lambda folder: {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.endswith(".gz")}
    assert read(folders[0]) == read(folders[1])  # the layout of the input does not change a byte
    keys = []
    for n in sorted(read(folders[0])):  # files in name order are in key order, each record is a member
        text = gzip.decompress(read(folders[0])[n])
        keys += [int(x.split(b"\r\n")[0]) for x in text.split(b"X-Record-Key: ")[1:]]
    assert keys == sorted(keys)


def test_hot_key_null_keys_and_empty(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_RANGE", 20)
    data = [(5, f"u{i}", f"h{i}") for i in range(100)] + [(None, f"n{i}", "same") for i in range(50)] + [(5, "u0", "h0")] * 3
    df = rows("page_id long, url string, html string", *data)
    manifest = write_warc(df, "page_id", "url", "html", str(tmp_path / "x")).collect()
    assert len(manifest) > 4
    back = read_warc(spark, str(tmp_path / "x")).collect()
    assert sorted(str(r.key) for r in back) == sorted(str(d[0]) for d in data)
    assert {r.record_type for r in back} == {"response"}
    write_warc(df.limit(0), "page_id", "url", "html", str(tmp_path / "y"))
    assert read_warc(spark, str(tmp_path / "y")).count() == 0


def test_truncated_archive_is_refused():
    data = warc.gzip_member(warc.record_bytes(1, "u", b"payload", None, warc.EPOCH))
    assert [f["X-Record-Key"] for f, _ in warc.parse_records(iter([data, data[:9], data[9:]]))] == ["1", "1"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse_records(iter([data + data[:40]])))


def test_archive_outlives_its_scratch_tables_and_failed_attempts(spark, rows, tmp_path):
    """Also with a payload of several MB."""
    folder = str(tmp_path / "x")
    os.makedirs(folder)
    open(f"{folder}/_temporary-dead-0001.warc.gz", "wb").close()  # what a lost executor had begun
    long = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    write_warc(rows("k long, u string, h string", (1, "a", long), (2, "b", "x"), (3, "c", long)), "k", "u", "h", folder)
    assert not any(n.startswith("_temporary") for n in os.listdir(folder))
    clear_scratch(spark)
    back = {r.key: (r.record_type, r.payload) for r in read_warc(spark, folder).collect()}
    assert back == {1: ("revisit", None), 2: ("response", "x"), 3: ("response", long)}


def test_limits_are_few_and_distinct_for_many_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_RANGE", 10)
    monkeypatch.setattr(warc, "MAX_RANGES", 300)
    keys = spark.range(1_000_000).select(F.col("id").alias("key"), F.lit("u").alias("url"), F.lit("s").alias("sha"))
    for_null, limits = warc._ranges(keys)
    assert for_null == 0 and len(limits) == len(set(limits)) == 299
    sizes = [r["count"] for r in warc.with_shards(keys, keys)[0].groupBy("shard").count().collect()]
    assert len(sizes) == 300 and max(sizes) < 4 * 1_000_000 / 300
