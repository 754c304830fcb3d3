import hashlib
import random

from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp
from quarry.llm._bits import signed


def test_edited_and_next_texts(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("é漢abc ABC deux trois".split()) for _ in range(rnd.randint(0, 300))), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "one", "x"), (1003, "word " * 50000, "x"), (1004, "Same Text here", "x"), (1005, "same text HERE", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(7)
    got = {r.doc_id: r for r in fp.against_next(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)]
        half = len(t) // 2
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - half] + (nxt[1] or "")[:half]).encode()).hexdigest()
        assert r.near_next == 1 - ((r.fp ^ got[nxt[0]].fp) & (1 << 64) - 1).bit_count() / 64
        assert r.near_edited == 1 - ((r.fp ^ r.edited_fp) & (1 << 64) - 1).bit_count() / 64
    assert got[1000].fp == got[1001].fp == 0 and got[1004].fp == got[1005].fp != 0
    longer = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in longer) > sum(r.near_next for r in longer)


def test_repeated_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "x y"), (5, "p q r s"), (5, "p q r s"), (5, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in fp.against_next(df).collect())
    order = [(5, "a b"), (5, "p q r s"), (5, "p q r s"), (-1, "a b c d"), (-1, "x y")]
    want = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % 5][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert got == sorted(want)
    assert fp.against_next(df.limit(0)).collect() == []
    assert fp.against_next(df.limit(1)).count() == 1


def test_tables_find_every_neighbour(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints, asks = sorted(prints), base[:20] + [rnd.getrandbits(64)]
    p = spark.createDataFrame([(signed(x),) for x in prints] * 2, "fp long")
    q = spark.createDataFrame([(signed(x),) for x in asks], "fp long")
    for radius, blocks in ((3, 5), (2, 4), (3, 6)):
        got = sorted(map(tuple, fp.neighbours(q, p, radius, blocks).collect()))
        want = sorted((signed(a), signed(x), (a ^ x).bit_count()) for a in asks for x in prints if (a ^ x).bit_count() <= radius)
        assert got == want
    assert fp.neighbours(q, p.where(F.lit(False))).collect() == []
