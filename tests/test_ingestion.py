"""Loader, chunker and cleaner: the reference's assertions plus the
semantic rules S1-S9."""
import math
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators.chunk import chunk_documents, register_chunker_udtf
from quarry.operators.clean import clean_documents
from quarry.sources.files import load_documents, make_docx


def _write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


# --- loader (SRC1-SRC6) -----------------------------------------------------

def test_load_txt_with_metadata(spark, workdir):
    _write(f"{workdir}/test.txt", "This is a test document with some content for loading.")
    docs, bad = load_documents(spark, workdir)
    rows = docs.collect()
    assert len(rows) == 1 and bad.count() == 0
    r = rows[0]
    assert r.filename == "test.txt" and r.format == ".txt"
    assert r.text == "This is a test document with some content for loading."
    assert r.size_bytes == len("This is a test document with some content for loading.")


def test_empty_directory_gives_no_rows(spark, workdir):
    os.makedirs(f"{workdir}/empty")
    docs, _ = load_documents(spark, f"{workdir}/empty")
    assert docs.count() == 0


def test_missing_directory_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_documents(spark, "/nonexistent/path")


def test_csv_is_ignored_and_suffix_is_case_insensitive(spark, workdir):
    _write(f"{workdir}/data.csv", "col1,col2\nval1,val2")
    _write(f"{workdir}/nested/deeper/UPPER.TXT", "  upper case suffix  \n")
    docs, _ = load_documents(spark, workdir)
    rows = docs.collect()
    assert [r.filename for r in rows] == ["UPPER.TXT"]
    assert rows[0].format == ".txt" and rows[0].text == "upper case suffix"


def test_bad_file_is_quarantined_not_fatal(spark, workdir):
    _write(f"{workdir}/good.txt", "fine")
    _write(f"{workdir}/bad.txt", b"caf\xe9 latin-1", mode="wb")
    _write(f"{workdir}/broken.docx", b"not a zip", mode="wb")
    _write(f"{workdir}/scan.pdf", b"%PDF-1.4", mode="wb")
    docs, bad = load_documents(spark, workdir)
    assert [r.filename for r in docs.collect()] == ["good.txt"]
    errs = {r.filename: r.error for r in bad.collect()}
    assert errs["bad.txt"] == "invalid UTF-8"
    assert errs["broken.docx"].startswith("BadZipFile")
    assert errs["scan.pdf"] == "no extractor for .pdf"


def test_docx_paragraphs_joined_by_blank_line(spark, workdir):
    _write(f"{workdir}/d.docx", make_docx(["First para.", "   ", "Second para."]), mode="wb")
    docs, _ = load_documents(spark, workdir)
    assert docs.first().text == "First para.\n\nSecond para."


# --- chunker (F1, F2, W3, U1, S5, S6) -----------------------------------------

def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, filename string, format string")


def test_chunk_creates_multiple_chunks(spark):
    # 16 words, windows of 20 with overlap 5: ceil(16/15) = 2, the tail inside the first
    text = "This is a test sentence that should be split into multiple chunks for the unit test."
    assert len(text.split()) == 16
    ch = chunk_documents(_docs(spark, [("a", text, "a.txt", ".txt")]), 20, 5) \
        .orderBy("chunk_index").collect()
    assert len(ch) == 2 and ch[0].token_count == 16 and ch[1].token_count == 1


def test_chunk_preserves_metadata(spark):
    ch = chunk_documents(_docs(spark, [("r", "Short document.", "report.pdf", ".pdf")]), 50, 10).collect()
    assert ch[0].filename == "report.pdf" and ch[0].format == ".pdf" and ch[0].chunk_index == 0


def test_chunk_overlap_and_batch(spark):
    ch = chunk_documents(_docs(spark, [("w", "Word " * 50, "w.txt", ".txt")]), 10, 3).collect()
    assert len(ch) > 1
    both = chunk_documents(_docs(spark, [("a", "Alpha beta gamma.", "a.txt", ".txt"),
                                         ("b", "Delta epsilon.", "b.txt", ".txt")]), 20, 5)
    assert {r.filename for r in both.collect()} == {"a.txt", "b.txt"}


def test_empty_text_gives_no_chunks(spark):
    assert chunk_documents(_docs(spark, [("e", "", "e.txt", ".txt")]), 10, 2).count() == 0


def test_overlap_not_below_size_is_rejected(spark):
    with pytest.raises(ValueError):
        chunk_documents(_docs(spark, [("x", "a b", "x", ".txt")]), 10, 10)


@pytest.mark.parametrize("size,overlap", [(5, 0), (7, 3), (16, 15), (64, 10)])
def test_chunk_count_and_rejoin_property(spark, size, overlap):
    import random
    rnd = random.Random(size * 100 + overlap)
    texts = [" ".join(rnd.choice(["ab", "c", "déf", "gh.", "i\nj"]) for _ in range(rnd.randint(0, 120)))
             for _ in range(12)]
    df = _docs(spark, [(str(i), t, f"{i}.txt", ".txt") for i, t in enumerate(texts)])
    rows = chunk_documents(df, size, overlap).collect()
    step = size - overlap
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == str(i)), key=lambda r: r.chunk_index)
        import re
        pieces = re.findall(r"\s*\S+", t)
        assert len(mine) == math.ceil(len(pieces) / step)
        # windows with their overlaps removed re-join to the source text
        rebuilt = "".join(pieces[j * step:j * step + step] and "".join(pieces[j * step:min(j * step + step, len(pieces))])
                          for j in range(len(mine)))
        assert rebuilt == "".join(pieces) == t.rstrip()
        for j, r in enumerate(mine):
            assert r.chunk_text == "".join(pieces[j * step:j * step + size])


def test_sql_chunker_function_matches_dataframe_chunker(spark):
    register_chunker_udtf(spark, 8, 2, "chunk_text_t")
    df = _docs(spark, [("a", "one two three four five six seven eight nine ten eleven", "a", ".txt")])
    df.createOrReplaceTempView("docs_t")
    sql = spark.sql("SELECT pos AS chunk_index, col.chunk_text AS t FROM "
                    "(SELECT chunk_text_t(text) AS ws FROM docs_t) "
                    "LATERAL VIEW posexplode(ws) w AS pos, col ORDER BY pos").collect()
    api = chunk_documents(df, 8, 2).orderBy("chunk_index").collect()
    assert [r.t for r in sql] == [r.chunk_text for r in api]


# --- cleaner (PF1-PF5, S1-S4) ---------------------------------------------------

def _clean(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(TX.clean_text("t").alias("c")).first().c


def test_clean_whitespace(spark):
    out = _clean(spark, "Hello    world\n\n\n\nNew paragraph")
    assert "    " not in out and "\n\n\n\n" not in out and out == "Hello world\n\nNew paragraph"


def test_clean_page_numbers(spark):
    out = _clean(spark, "Some content\nPage 5\nMore content\n3 of 10\nEnd")
    assert "Page 5" not in out and "3 of 10" not in out
    assert out == "Some content\nMore content\nEnd"


def test_clean_typographic_characters(spark):
    out = _clean(spark, "“hello” it’s ‘x’ wait… a–b c—d e f")
    assert out == "\"hello\" it's 'x' wait... a-b c--d e f"


def test_batch_clean(spark):
    df = spark.createDataFrame([("  a’  ",), ("b\n\n\n\nc",)], "text string")
    assert [r.text for r in clean_documents(df).collect()] == ["a'", "b\n\nc"]


def test_clean_order_is_not_idempotent(spark):
    # NBSP becomes a space only after space runs were collapsed
    once = _clean(spark, "a\u00a0 \u00a0b")
    assert once == "a   b"
    assert _clean(spark, once) == "a b"


def test_lines_tested_stripped_but_kept_unstripped(spark):
    # Stripped page line dropped; mixed separator dropped; kept line keeps its indent
    out = _clean(spark, "x\n   page 12  \n  keep me\n-=_-=\n=====  \n====\nlast")
    assert out == "x\n keep me\n====\nlast"  # 5+ separator chars drop, 4 stay


def test_unicode_strip(spark):
    # Strip removes Unicode whitespace, not only ASCII spaces
    assert _clean(spark, " \u3000text\u2003") == "text"


def test_extractors_and_tokenizers_hand_on_bounded_parts(spark, monkeypatch):
    """A batch's texts leave the worker part by part, each file is extracted
    once, and rows keep their order."""
    from quarry.operators import chunk
    from quarry.sources import files as S

    def once(data):
        if data[:1] == b"!":
            raise ValueError("bad")
        return data.decode() * 2

    rows = [(f"f{i}.x" if i % 5 else f"f{i}.y", ".x" if i % 5 else ".y", None if i % 7 == 0 else ((b"!" if i % 3 == 0 else b"") + b"t%d" % i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "filepath string, format string, content binary").coalesce(1).selectExpr(
        "filepath", "filepath AS filename", "format", "length(content) AS size_bytes", "content")
    monkeypatch.setattr(S, "EXTRACT_CHARS", 3000)
    docs, bad = S.split_documents(df, {".x": once})
    good = {r.doc_id: r.text for r in docs.collect()}
    want = {p: None if c is None else c.decode() * 2 for p, f, c in rows if c is None or (f == ".x" and c[:1] != b"!")}
    assert good == want
    assert {r.doc_id: r.error for r in bad.collect()} == {
        p: "ValueError: bad" if f == ".x" else "no extractor for .y" for p, f, c in rows if p not in want}
    plan = docs.select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    udf = chunk.python_pieces(lambda texts: [list(t) for t in texts]).func
    parts = list(udf(iter([pa.array(["ab" * 1000, None, ""] * 2000)])))
    assert len(parts) > 5 and sum(map(len, parts)) == 6000
    assert max(sum(map(len, p.to_pylist())) for p in parts) <= chunk.PIECES_CHARS + 2000
    sizes = [len(x) for p in parts for x in p.to_pylist()]
    assert sizes == [2000, 0, 0] * 2000
