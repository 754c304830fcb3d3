"""what an update reads and moves, and the windows it cuts."""
import random

from pyspark.sql import functions as F

from quarry.config import demo
from quarry.functions import text as TX
from quarry.operators.chunk import chunk_documents
from quarry.operators.index import compact, load_index
from quarry.plans import rag

CFG = demo().with_(chunk_size=8, chunk_overlap=3, embedding_dim=16)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((r.doc_id, r.chunk_index, r.token_count, r.chunk_text, tuple(r.embedding)) for r in df.collect())


def test_texts_and_vectors_are_not_shuffled_to_meet_few_changes(spark, workdir, monkeypatch):
    cut = []
    monkeypatch.setattr(rag, "chunk_documents", lambda docs, *a: cut.append(_plan(docs)) or chunk_documents(docs, *a))
    was = [(i, " ".join(f"w{i}x{j}" for j in range(i % 30))) for i in range(200)] + [(None, "no id"), (300, None), (301, "goes")]
    now = [(i, t + " new" if i == 20 else t) for i, t in was if i != 301] + [(302, "comes")]
    docs = [spark.createDataFrame(x, "doc_id long, text string") for x in (was, now)]
    seen = [rag.update_index(spark, d, f"{workdir}/ix", CFG) for d in docs]
    assert "Join" not in cut[0] and "Exchange" not in cut[0]
    assert "BroadcastHashJoin" in cut[1] and "SortMergeJoin" not in cut[1]
    assert (seen[0]["new"], seen[1]["changed"], seen[1]["deleted"]) == (203, 1, 2)      # an id that is null meets none
    want = _rows(rag.prepare_chunks(docs[1].where("doc_id IS NOT NULL"), CFG))
    assert _rows(load_index(spark, f"{workdir}/ix")[0]) == want
    compact(spark, f"{workdir}/ix", ["documents"])
    assert _rows(load_index(spark, f"{workdir}/ix")[0]) == want
    # changes beyond the limit meet the documents in a shuffle, with the same rows
    little = CFG.with_(broadcast_limit_bytes=1)
    for d in docs:
        rag.update_index(spark, d, f"{workdir}/iy", little)
    assert "BroadcastHashJoin" not in cut[3]
    assert _rows(load_index(spark, f"{workdir}/iy")[0]) == want


def test_each_text_is_embedded_once_and_only_shared_ones_are_shuffled(spark, workdir, monkeypatch):
    asked = []

    class Counted(rag.HashedEmbedder):
        def embed(self, df, text_col="text", out_col="embedding"):
            asked.append((_plan(df), df.count()))
            return super().embed(df, text_col, out_col)

    was = [(i, f"alone {i}") for i in range(50)] + [(100 + i, "the same") for i in range(30)]
    now = was + [(200, "alone 3"), (201, "the same"), (202, "first"), (203, "twice new"), (204, "twice new")]
    docs = [spark.createDataFrame(x, "doc_id long, text string") for x in (was, now)]
    for cfg, parts in ((CFG, [1, 50, 1, 1]), (CFG.with_(broadcast_limit_bytes=1), [51, 2])):
        path, asked[:] = f"{workdir}/i{len(parts)}", []
        seen = [rag.update_index(spark, d, path, cfg, Counted(16)) for d in docs]
        assert [s["chunks_embedded"] for s in seen] == [51, 2] and [n for _, n in asked] == parts
        if len(parts) == 4:
            assert "hashpartitioning" not in asked[1][0] and "SortMergeJoin" not in asked[1][0]
        assert _rows(load_index(spark, path)[0]) == _rows(rag.prepare_chunks(docs[1], CFG))


def test_windows_of_runs_equal_those_of_pieces(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "one", "  lead and tail \n", "é 𝒳 y z w"]
    texts += ["".join(rnd.choice(["a", "bc ", " ", "\n", "d\te", " ", "𝒳 "]) for _ in range(rnd.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    space = " \t\n\x0b\f\r"

    def pieces(t):
        out, word = [""], False
        for c in t or "":
            if c in space and word:
                out.append("")
            word = c not in space
            out[-1] += c
        return out if word else out[:-1]

    for size, overlap in ((1, 0), (2, 1), (7, 0), (7, 3), (8, 4), (5, 4), (256, 30)):
        want = []
        for i, t in enumerate(texts):
            p = pieces(t)
            want += [(i, k, len(p[a:a + size]), "".join(p[a:a + size])) for k, a in enumerate(range(0, len(p), size - overlap))]
        got = chunk_documents(docs, size, overlap).orderBy("doc_id", "chunk_index").collect()
        assert [tuple(r) for r in got] == want


def test_long_runs_take_no_stack(spark):
    docs = spark.createDataFrame([(1, "ab " * 200_000)], "doc_id int, text string")
    got = chunk_documents(docs, 150_000, 1000).orderBy("chunk_index").collect()
    assert [r.token_count for r in got] == [150_000, 51_000]
    assert got[1].chunk_text == (" ab" * 51_000)


def test_untouched_texts_and_each_character_are_cleaned_alike(spark):
    texts = [None, "", "plain", "é ü", "a\n\nb", "a\n\n\nb", "a  b", "a\tb", "a \t\n\n\n\n  b"] + [f"x{c}y {c}{c}" for c in TX.CHAR_MAP]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", TX.normalize_whitespace("t").alias("n"), TX.fix_encoding_artifacts("t").alias("f")).collect()
    import re
    for r in got:
        if r.t is None:
            assert r.n is None and r.f is None
            continue
        assert r.n == re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", r.t))
        assert r.f == "".join(TX.CHAR_MAP.get(c, c) for c in r.t)
