import gzip
import hashlib
import io
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc

ROWS = [(1, "u\nv", None), (2, None, "a" * 2000), (3, None, "a" * 2000), (None, "é", "a" * 2000), (3, None, "a" * 2000),
        (4, "z", "é漢" * 600), (5, "z", "é漢" * 600), (6, "q", "s"), (7, "q", "s"), (8, "x", "\r\n\r\nWARC/1.1\r\n" * 90),
        (9, "big", "<p>x</p>" * 300000)]


def expected(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(body) >= 1000 and len(ids) > 1 and first is not None and i != first
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.withColumn("id", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("payload", F.lit("y"))


def test_pages_round_trip(spark, workdir):
    path = f"{workdir}/warc"
    warc.archive_pages(pages(spark).repartition(3), path)
    got = warc.read_pages(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_filters_are_pushed_and_payloads_skipped(spark, workdir):
    path = f"{workdir}/warc"
    warc.archive_pages(pages(spark), path)
    q = warc.read_warc(spark, path, "warc_type = 'revisit' and content_length < 5000 and target_uri is not null")
    assert "Filter (" not in q._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.target_uri for r in q.collect()) == ["z", "é"]
    assert warc.read_warc(spark, path, "target_uri = 'q' or warc_type = 'x'").count() == 2
    assert warc.read_warc(spark, path, "payload is not null", payload="false").count() == 0


def test_foreign_archives(spark, workdir):
    """Plain files, and gzip members without a skip length."""
    path = f"{workdir}/warc"
    warc.archive_pages(pages(spark).coalesce(1), path)
    name = next(f for f in os.listdir(path) if f.endswith(".gz"))
    raw = gzip.open(f"{path}/{name}").read()
    for sub, body in (("plain", raw), ("gz", None)):
        os.makedirs(f"{workdir}/{sub}")
        if body is None:
            recs = [warc.record_bytes({"warc_type": "response" if i % 2 else "request", "record_id": f"urn:{i}"}, b"p" * i * 5000)
                    for i in range(6)]
            with open(f"{workdir}/{sub}/a.warc.gz", "wb") as f:
                f.write(b"".join(map(gzip.compress, recs)))
        else:
            with open(f"{workdir}/{sub}/a.warc", "wb") as f:
                f.write(body)
    plain = spark.read.format("warc").load(f"{workdir}/plain")
    whole = spark.read.format("warc").load(path)
    cols = ["record_id", "warc_type", "refers_to", "content_length", "payload"]
    assert sorted(plain.select(cols).collect(), key=str) == sorted(whole.select(cols).collect(), key=str)
    assert [(r.record_id, len(r.payload)) for r in warc.read_warc(spark, f"{workdir}/gz", "warc_type = 'response'").orderBy("record_id").collect()] == [
        ("urn:1", 5000), ("urn:3", 15000), ("urn:5", 25000)]


def test_rolled_files_empty_table_and_overwrite(spark, workdir):
    path = f"{workdir}/warc"
    warc.archive_pages(pages(spark).limit(0), path)
    assert warc.read_pages(spark, path).collect() == []
    rows = spark.range(50).select(F.lit("resource").alias("warc_type"), F.col("id").cast("string").alias("record_id"),
                                  F.lit("text/plain").alias("content_type"), F.expr("cast(repeat('x', 300) as binary)").alias("payload"))
    warc.register(spark)
    rows.coalesce(1).write.format("warc").option("file_bytes", "500").mode("overwrite").save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".gz")]) > 5
    assert spark.read.format("warc").option("partition_bytes", "800").load(path).where("length(payload) = 300").count() == 50
    rows.write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 50


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_members_with_several_records():
    recs = [warc.record_bytes({"warc_type": "response" if i % 2 else "request", "record_id": f"urn:{i}"}, b"\r\n" + b"p" * i * 5000)
            for i in range(40)]
    whole = b"".join(recs)
    cuts = [0, 1, 700, 9000, 400000, len(whole)]
    files = [gzip.compress(whole), b"".join(map(gzip.compress, recs)), gzip.compress(whole[:len(whole) // 2]) + gzip.compress(whole[len(whole) // 2:]),
             b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:]))]
    for data in files:
        got = [(r["record_id"], len(r["payload"])) for r in warc.read_gzip(Bytes(data), lambda row: True, True)]
        assert got == [(f"urn:{i}", 2 + i * 5000) for i in range(40)]
        some = [(r["record_id"], r["payload"]) for r in warc.read_gzip(Bytes(data), lambda row: row["warc_type"] == "response", False)]
        assert some == [(f"urn:{i}", None) for i in range(1, 40, 2)]
    with pytest.raises(EOFError):
        list(warc.read_gzip(Bytes(files[0][:-2000]), lambda row: True, True))


def test_a_block_shorter_than_stated_is_an_error():
    whole = warc.record_bytes({"warc_type": "response", "record_id": "urn:1"}, b"p" * 5000)
    after = warc.record_bytes({"warc_type": "response", "record_id": "urn:2"}, b"q" * 10)
    short = whole[:-1000]
    for read, data in ((warc.read_plain, short), (warc.read_gzip, gzip.compress(short)), (warc.read_gzip, gzip.compress(short) + gzip.compress(after))):
        with pytest.raises(EOFError, match="urn:1 states"):
            list(read(Bytes(data), lambda row: True, True))
