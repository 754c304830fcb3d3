"""Long documents in parallel, the chunking table function, running totals
with hot hours and rows without a time."""
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_documents, chunk_long_documents, register_chunk_table


def rows(df):
    return sorted(map(str, df.select("doc_id", "lang", "chunk_index", "token_count", "chunk_text").collect()))


@pytest.mark.parametrize("size,overlap,segment", [(7, 2, 10), (7, 0, 25), (3, 2, 1), (40, 10, 60), (1, 0, 33)])
def test_segments_give_the_same_windows(spark, size, overlap, segment):
    words = " ".join(f"w{i}{'é' * (i % 3)}" + ("\n\n" if i % 5 == 0 else "") for i in range(200))
    docs = spark.createDataFrame([(1, words, "en"), (1, words, "en"), (2, None, "x"), (3, "", "x"), (4, " \n\t" * 30, "x"), (5, "x" * 300, "x"),
                                  (None, "  lead " + words + "  \n ", None), (6, "short", "x"), (7, "😀 " * 90, "x")], "doc_id long, text string, lang string")
    assert rows(chunk_long_documents(docs, size, overlap, segment_chars=segment)) == rows(chunk_documents(docs, size, overlap))
    assert chunk_long_documents(docs.limit(0), size, overlap).collect() == []


def test_a_long_document_spreads_over_tasks(spark):
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(2_000_000)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"), F.lit("en").alias("lang"))
    docs = docs.checkpoint()
    assert docs.select(F.length("text")).first()[0] > 20_000_000
    got = chunk_long_documents(docs, 256, 30, segment_chars=1 << 20)
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4
    want = chunk_documents(docs, 256, 30)
    digest = lambda df: df.agg(F.count("*"), F.sum("token_count"), F.sum(F.xxhash64("chunk_index", "token_count", "chunk_text").cast("decimal(38,0)"))).first()
    assert digest(got) == digest(want)


def test_table_function(spark):
    register_chunk_table(spark, "chunk_table_t")
    docs = spark.createDataFrame([("a", "one two  three\nfour", "x"), ("b", None, "y"), ("c", "five six", "z")], "key string, body string, more string")
    docs.createOrReplaceTempView("chunk_table_t_docs")
    ask = "SELECT * FROM chunk_table_t(TABLE(SELECT * FROM chunk_table_t_docs) PARTITION BY (key), {}) ORDER BY key, chunk_index"
    got = spark.sql(ask.format("2, 1"))
    assert got.columns == ["key", "chunk_index", "token_count", "chunk_text"]
    assert [tuple(r) for r in got.collect()] == [("a", 0, 2, "one two"), ("a", 1, 2, " two  three"), ("a", 2, 2, "  three\nfour"),
                                                 ("a", 3, 1, "\nfour"), ("c", 0, 1, "five six")]
    plain = chunk_documents(docs.withColumnRenamed("body", "text"), 2, 1).select("key", "chunk_index", "token_count", "chunk_text")
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    with pytest.raises(AnalysisException):
        spark.sql(ask.format("2, 2")).collect()


def test_running_totals_keep_all_rows_and_split_hot_hours(spark):
    from quarry.sources.logs import running_total
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5), (2, None, 7), (3, "2024-01-01 09:00:00", 1), (4, None, None), (5, "2024-01-01 10:00:00", 2)],
                              "event_id long, at string, value long").withColumn("ts", F.col("at").cast("timestamp"))
    got = {r.event_id: r.total for r in running_total(e, F.col("value"), "ts", "event_id").collect()}
    assert got == {3: 1, 1: 6, 5: 8, 2: 15, 4: 15}
    assert running_total(e.limit(0), F.col("value"), "ts", "event_id").collect() == []
    hot = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), F.lit(1).alias("value"))
    out = running_total(hot, F.col("value"), "ts", "event_id")
    assert out.where("total <> event_id + 1").count() == 0
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.count() == 20_000 and max(sizes) < 20_000


def test_python_tokenizer_joins_to_the_text(spark):
    from quarry.operators.chunk import chunk_documents, python_pieces
    from quarry.plans.catalog import CharRuns
    text = "Ärger 12ab,\n\n x" * 40
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = chunk_documents(docs, 7, 2, tokenizer=python_pieces(CharRuns())).collect()
    pieces = CharRuns()([text])[0]
    assert "".join(pieces) == text and {r.doc_id for r in got} == {1}
    assert [r.chunk_text for r in sorted(got, key=lambda r: r.chunk_index)] == [
        "".join(pieces[a:a + 7]) for a in range(0, len(pieces), 5)]


def test_plugged_model_on_odd_texts(spark):
    from quarry.operators.embed import ModelEmbedder
    from quarry.plans.catalog import LetterModel
    rows = [(1, "aab 7"), (2, ""), (3, None), (4, "ÄÖ!"), (5, "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.i: r.v for r in ModelEmbedder(LetterModel, 36, batch_size=2).embed(df, "t", "v").collect()}
    assert [round(x, 4) for x in (got[1][0], got[1][1], got[1][33])] == [0.8165, 0.4082, 0.4082]
    assert not any(got[2]) and not any(got[3]) and not any(got[4]) and got[5][25] == 1.0
