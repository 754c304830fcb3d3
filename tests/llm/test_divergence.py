import random

import brute
import numpy as np
import pytest
from quarry.llm import divergence as dv


def docs(rnd, n):
    vocab = [f"t{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Été", "漢字", "x1y"]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["web", "web", "news", "", None, "c"])
        some = rnd.sample(vocab, 30)
        rows.append((i, " ".join(rnd.choice(some).upper() if rnd.random() < .2 else rnd.choice(some) for _ in range(rnd.randint(0, 60))), lang, source))
    rows += [(9000, None, "fr", "web"), (9001, "", "fr", "c"), (9002, "... 12", "fr", None), (9003, "only here", "es", "solo"),
             (9004, None, "en", "mute"), (9005, "ta " * 50_000, "en", "long")]
    return rows + [(7, "tak tbk", "en", "web")] * 40


def seen(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_query_matches_brute_force(spark, monkeypatch):
    rows = docs(random.Random(3), 400)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n int")
    want = sorted(brute.divergence(rows))
    assert seen(dv.audit(df)) == want
    monkeypatch.setattr(dv, "SEGMENT", 8)
    monkeypatch.setattr(dv, "GROUP_BLOCK", 2)
    monkeypatch.setattr(dv, "FLUSH", 50)
    assert seen(dv.audit(df.repartition(3))) == want


def test_ties_empty_tables_and_no_terms(spark):
    kind = "doc_id long, text string, lang string, source string"
    assert dv.audit(spark.createDataFrame([], kind)).collect() == []
    rows = [(i, "same words here", "en", s) for i, s in enumerate("abc")]
    assert seen(dv.audit(spark.createDataFrame(rows, kind))) == sorted(brute.divergence(rows))
    conf = dv.Audit(least_docs=1, top=2)
    assert seen(dv.audit(spark.createDataFrame(rows, kind), conf)) == sorted(brute.divergence(rows, least=1, top=2))


@pytest.mark.parametrize("width", [1, 2, 16])
def test_trees_share_equal_subtrees_and_price_all_leaves(width):
    rnd = np.random.default_rng(width)
    leaves = rnd.integers(0, 3, (5, width)) * (rnd.random((5, width)) < 0.4)
    nodes, kids = dv.hash_consed(leaves)
    for level in range(1, len(kids)):
        assert len({tuple(k) for k in kids[level]}) == len(kids[level])       # equal subtrees are one node
    pairs = np.array([(i, j) for i in range(5) for j in range(5)])
    got = dv.priced(nodes, kids, pairs, lambda r, c: 10 * (r + 1) + 7 * c ** 2)
    value = lambda r, c: 10 * (r + 1) + 7 * int(c) ** 2
    assert got == [sum(abs(value(i, a) - value(j, b)) for a, b in zip(leaves[i], leaves[j])) for i, j in pairs]


def test_shares_of_any_size():
    conf = dv.Audit()
    big = np.array([10 ** 15], object)
    assert dv.share(big, 10 ** 16, 7, conf)[0] == 1 + 10 ** 9 * (10 ** 15 + 5) // (10 ** 16 + 35)
