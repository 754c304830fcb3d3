import random

import brute
import corpus_pipeline
import pytest

from quarry.llm.mixing import mixed
from quarry.llm.quality import NGRAM_LIMITS

tokenizers = pytest.importorskip("tokenizers")


def corpus(rnd):
    vocab = [f"w{i}" for i in range(3000)]
    passage = "\n".join(" ".join(rnd.choice(vocab) for _ in range(20)) for _ in range(4))
    rows = []
    for i in range(120):
        lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 8))]
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), passage)
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 30, 3)]                         # exact copies
    rows += [(2000 + i, rows[i][1].replace("\n", " ") + ".") for i in range(1, 60, 3)]     # near copies
    rows += [(3000, "spam " * 100), (3001, "too short"), (3002, None), (3003, ""), (3004, "a%% b## " * 50)]
    return [(i, t, f"s{rnd.randint(0, 4)}") for i, t in rows]


def test_run_matches_brute_force(spark, workdir):
    rows = corpus(random.Random(12))
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(5).write.parquet(f"{workdir}/documents.parquet")
    want = brute.pipeline(rows, NGRAM_LIMITS)
    library = tokenizers.Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    ids = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in want)
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, workdir).collect())
    assert got == ids
    assert {i for i, _ in want} < {i for i, _, _ in rows}


def test_output_order_is_that_of_the_plan(spark, workdir):
    rows = corpus(random.Random(13))
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    want = [r.doc_id for r in mixed(df).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix(spark, df.repartition(7), workdir).write.option("maxRecordsPerFile", 9).parquet(f"{workdir}/mix")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spark.read.parquet(f"{workdir}/mix").inputFiles()) > 8
    got = corpus_pipeline.tokens(spark, spark.read.parquet(f"{workdir}/mix"), workdir)
    assert [r.doc_id for r in got.orderBy("run_position").select("doc_id").collect()] == want
    assert sorted(r.run_position for r in got.select("run_position").collect()) == list(range(len(want)))
    assert corpus_pipeline.tokens(spark, df, workdir).where("run_position is not null").count() == 0


def test_very_long_and_repeated_documents(spark, workdir):
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long, "a", 1), (1, long, "a", 1), (2, long + " end", None, 2), (None, "x y " * 9, "a", 3)],
                                 "doc_id long, text string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, workdir).checkpoint()
    # one copy of the long text stays; its source's target is half as much again, so it is read once and a half
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {1}


def test_stages_keep_the_columns_and_take_empty_tables(spark, workdir):
    schema = "doc_id long, text string, lang string, source string, n_chars int, extra string"
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "en", "s", 23, "x"), (2, None, None, None, None, None)], schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, workdir)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= 2 * table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, workdir).count() == table.count()
