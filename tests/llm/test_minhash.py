import random

import brute
import numpy as np
import pytest
from quarry.llm import minhash as mh


def docs(rnd):
    vocab = [f"w{i}" for i in range(500)] + ["Été", "漢字"]
    rows = []
    for i in range(40):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 300))]
        rows.append((i, " ".join(w)))
        for j in range(rnd.randint(0, 5)):
            x = list(w)
            for _ in range(rnd.randint(0, 1 + len(x) // 20)):
                if x:
                    x[rnd.randrange(len(x))] = rnd.choice(["changed", "CHANGED", "other"])
            rows.append((1000 + 10 * i + j, "  ".join(x).upper() if j == 2 else "\n".join(x)))
    long = " ".join(f"x{i}" for i in range(60_000))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One"), (5005, "one two"), (5006, "two one"),
             (None, "one"), (None, rows[0][1]), (None, None), (6000, long), (6001, long + " more"), (6002, "a a a a a"), (6003, "A a a")]
    return rows + [(7000, "row given twice " * 5)] * 2


def check(got, rows):
    want = brute.jaccard_components(rows)
    assert len(got) == len(rows)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def test_query_matches_brute_force(spark):
    rows = docs(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, fid string")
    check(mh.near_duplicates(df).collect(), rows)


def near_copies(rnd, n):
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        x = list(base)
        for _ in range(rnd.randint(0, 4)):
            x[rnd.randrange(len(x))] = f"e{rnd.randrange(400)}"
        rows.append((i, " ".join(x)))
    return rows


def test_crowded_groups_lose_no_link(spark):
    rows = near_copies(random.Random(8), 220)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(mh.near_duplicates(df, mh.MinHash(part_rows=16, part_bytes=1 << 30)).collect(), rows)
    check(mh.near_duplicates(df, mh.MinHash(part_rows=1000, part_bytes=20_000)).collect(), rows)


def test_empty_table(spark):
    assert mh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_local_components_are_those_of_the_links():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 30):
        adj = np.triu(rnd.random((n, n)) < 0.06, 1)
        adj |= adj.T
        known = rnd.integers(0, n, n)
        root = list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    if adj[a, b] or known[a] == known[b]:
                        root[a] = root[b] = min(root[a], root[b])
        assert mh.local_components(n, known, lambda i: adj[i]).tolist() == root


def test_minima_estimate_the_similarity():
    conf = mh.MinHash(bands=100)
    buf = (" ".join(f"a{i}" for i in range(300)) + "|" + " ".join(f"a{i}" for i in range(100, 400))).encode()
    cut = buf.index(b"|")
    raw = np.frombuffer(buf.replace(b"|", b" "), np.uint8)
    h, n = mh.shingle_sets(raw, np.array([0, cut + 1, len(raw)]), 3)
    assert n.tolist() == [298, 298]
    sig = mh.signatures(h, n, conf)[1]
    assert np.mean(sig[0] == sig[1]) == pytest.approx(198 / 398, abs=0.08)
    # bands agree as often as the theory says, within wide limits
    assert mh.MinHash().least_matches == 101
