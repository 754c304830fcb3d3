"""The file data source that reads by bytes."""
import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quarry.sources.files import load_documents, make_docx
from quarry.sources.ranges import FileReader, border, decode, load_ranges, scan_ranges


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def joined(docs):
    got = {}
    for r in docs.orderBy("filename", "part").collect():
        got.setdefault(r.filename, []).append(r)
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r \u00e9\u2028\U0001f600", max_size=200), st.integers(4, 50))
def test_borders_cut_between_lines_or_characters(text, span):
    data = text.encode()
    n = max(1, -(-len(data) // span))
    at = [border(io.BytesIO(data), len(data), k * span, span) for k in range(n)] + [len(data)]
    parts = [data[a:b] for a, b in zip(at, at[1:])]
    assert b"".join(parts) == data and at == sorted(at)
    assert all(0 < len(p) < 2 * span for p in parts[:-1]) and len(parts[-1]) < 2 * span
    for p, nominal in zip(parts[:-1], range(span, len(data), span)):
        p.decode()
        if b"\n" in data[nominal - 1:nominal - 1 + span]:
            assert p.endswith(b"\n")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_invalid_bytes_are_counted(data):
    text, bad, at = decode(data)
    kept = data.decode("utf-8", "ignore")
    assert bad == len(data) - len(kept.encode())
    assert (text is None) == (bad > 0) == (at is not None)
    if at is not None:
        data[:at].decode()
        with pytest.raises(UnicodeDecodeError):
            data[at:].decode()


def test_ranges_of_files_equal_the_files(spark, workdir):
    long = "\n".join(f"line {i} with ünïcode 😀" for i in range(3000))
    files = {"long.txt": long, "one_line.txt": "é" * 5000, "empty.txt": "", "small.TXT": "  padded \n", "cr.txt": "a\r\nb\r" * 900,
             "newlines.txt": "\n" * 4096}
    for name, text in files.items():
        write(f"{workdir}/in/deep/{name}", text.encode())
    write(f"{workdir}/in/data.csv", b"no")
    write(f"{workdir}/in/_hidden/x.txt", b"no")
    write(f"{workdir}/in/.x.txt", b"no")
    write(f"{workdir}/in/a b%20ü.docx", make_docx(["one", "two"]))
    docs, bad = load_ranges(spark, f"{workdir}/in", rangebytes=1024, partitionbytes=8192, openbytes=100)
    got = joined(docs)
    assert {n: "".join(r.text for r in rs) for n, rs in got.items()} == {**files, "a b%20ü.docx": "one\n\ntwo"}
    assert bad.collect() == []
    for name, rs in got.items():
        assert [r.part for r in rs] == list(range(rs[0].n_parts)) and {r.format for r in rs} <= {".txt", ".docx"}
        size = rs[0].size_bytes
        assert rs[0].n_parts == (max(1, -(-size // 1024)) if rs[0].format == ".txt" else 1)
        if rs[0].format == ".txt":
            ends = [r.start + len(r.text.encode()) for r in rs]
            assert [0] + ends == [r.start for r in rs] + [size]
    # the same documents as the scan of whole files, which knows no empty ones
    whole = {r.filename: r.text for r in load_documents(spark, f"{workdir}/in/deep")[0].collect()}
    assert whole == {n: t.strip() for n, t in files.items() if t}


def test_one_large_file_is_read_by_several_tasks(spark, workdir):
    line = b"some words of a line of text, all alike\n"
    write(f"{workdir}/big/big.txt", line * 400_000)            # 16 MB
    df = scan_ranges(spark, f"{workdir}/big", rangebytes=1 << 20, partitionbytes=2 << 20, openbytes=0)
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(per) == 8 and sum(r.n for r in per) == len(line) * 400_000 and max(r.n for r in per) < 4 << 20
    assert df.where(~F.col("text").endswith("alike\n")).count() == 0


def test_small_files_share_partitions(spark, workdir):
    for i in range(60):
        write(f"{workdir}/many/{i:03}.txt", b"x" * 100)
    df = scan_ranges(spark, f"{workdir}/many", partitionbytes=2000, openbytes=100)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 60


def test_listed_columns_are_pushed_down(spark, workdir):
    write(f"{workdir}/p/a.txt", b"abc")
    write(f"{workdir}/p/b.txt", b"abcdef" * 100)
    write(f"{workdir}/p/c.docx", make_docx(["x"]))
    write(f"{workdir}/p/d.pdf", b"%PDF")
    names = lambda *c: sorted(r.filename for r in scan_ranges(spark, f"{workdir}/p", *c).collect())
    assert names() == ["a.txt", "b.txt", "c.docx", "d.pdf"]
    assert names("format = '.txt'") == ["a.txt", "b.txt"]
    assert names("format IN ('.docx', '.pdf')") == ["c.docx", "d.pdf"]
    assert names("size_bytes > 100 AND format = '.txt'") == ["b.txt"]
    assert names("filename LIKE '%.docx'") == ["c.docx"] and names("filepath LIKE '%/a.%'") == ["a.txt"]
    assert names("format = '.txt' AND text LIKE 'abcd%'") == ["b.txt"] and names("format IS NULL") == []
    assert sorted(r.filename for r in scan_ranges(spark, f"{workdir}/p", formats=".pdf, .TXT").collect()) == ["a.txt", "b.txt", "d.pdf"]
    # files that fail are not even planned
    r = FileReader({"path": f"{workdir}/p"})
    assert list(r.pushFilters([ds.EqualTo(("format",), ".txt"), ds.EqualTo(("text",), "abc"), ds.GreaterThan(("size_bytes",), 5)])) == [
        ds.EqualTo(("text",), "abc")]
    assert [x.path.rsplit("/", 1)[-1] for b in r.partitions() for x in b.ranges] == ["b.txt"]


def test_bad_files_are_quarantined_whole(spark, workdir):
    good = "line of good text\n" * 400
    spoilt = (good.encode()[:3000] + b"\xff\xfe" + good.encode()[3000:6000] + b"\xc3" + good.encode()[6000:])
    write(f"{workdir}/q/good.txt", good.encode())
    write(f"{workdir}/q/spoilt.txt", spoilt)
    write(f"{workdir}/q/latin.txt", b"caf\xe9")
    write(f"{workdir}/q/broken.docx", b"not a zip")
    write(f"{workdir}/q/scan.pdf", b"%PDF")
    docs, bad = load_ranges(spark, f"{workdir}/q", rangebytes=512)
    assert "".join(r.text for r in docs.orderBy("part").collect()) == good
    got = {r.filename: (r.error, r.bad_bytes, r.bad_at) for r in bad.collect()}
    assert got.pop("broken.docx")[0].startswith("BadZipFile")
    assert got == {"spoilt.txt": ("invalid UTF-8", 3, 3000), "latin.txt": ("invalid UTF-8", 1, 3),
                   "scan.pdf": ("no extractor for .pdf", 0, None)}
    docs, bad = load_ranges(spark, f"{workdir}/q", "format = '.pdf'", extractors={".pdf": lambda b: b.decode()})
    assert [(r.filename, r.text) for r in docs.collect()] == [("scan.pdf", "%PDF")] and bad.count() == 0


def test_files_that_change_after_planning_fail_no_job(workdir):
    write(f"{workdir}/v/gone.txt", b"abc")
    write(f"{workdir}/v/short.txt", b"abcdef")
    r = FileReader({"path": f"{workdir}/v"})
    parts = r.partitions()
    os.remove(f"{workdir}/v/gone.txt")
    write(f"{workdir}/v/short.txt", b"ab")
    rows = {x["filename"]: x for p in parts for b in r.read(p) for x in b.to_pylist()}
    assert rows["gone.txt"]["error"].startswith("FileNotFoundError") and rows["gone.txt"]["text"] is None
    assert rows["short.txt"]["error"] == "file ends 4 bytes early" and rows["short.txt"]["text"] is None


def test_folders_empty_missing_or_a_file(spark, workdir):
    os.makedirs(f"{workdir}/none")
    docs, bad = load_ranges(spark, f"{workdir}/none")
    assert docs.count() == bad.count() == 0
    with pytest.raises(Exception, match="source directory not found"):
        scan_ranges(spark, f"{workdir}/missing").count()
    write(f"{workdir}/one/x.txt", b"just one")
    for root in (f"{workdir}/one/x.txt", f"file://{workdir}/one"):
        assert [(r.filename, r.text, r.filepath) for r in scan_ranges(spark, root).collect()] == [
            ("x.txt", "just one", root if root.endswith("txt") else root + "/x.txt")]
    with pytest.raises(Exception, match="rangebytes"):
        scan_ranges(spark, f"{workdir}/one", rangebytes=2).count()
