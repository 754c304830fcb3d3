import random

import brute
from quarry.llm import neardup as nd
from quarry.llm._bits import signed
from quarry.llm._graph import components


def docs(rnd):
    vocab = [f"w{i}" for i in range(400)] + ["Été", "漢字"]
    rows = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 400))]
        rows.append((i, " ".join(w)))
        for j in range(rnd.randint(0, 3)):
            x = list(w)
            if x and j:
                x[rnd.randrange(len(x))] = "changed"
            rows.append((1000 + 10 * i + j, "  ".join(x).upper() if j == 2 else "\n".join(x)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One two"), (None, "one"), (None, rows[0][1])]


def test_query_matches_brute_force(spark):
    rows = docs(random.Random(2))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    want = brute.components([i for i, _ in rows], [brute.simhash(t) for _, t in rows])
    got = nd.near_duplicates(df, 2, 3).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.fp % (1 << 64)): r.component_id for r in got}
    assert by == want


def test_one_of_each_group_stays(spark):
    rows = docs(random.Random(9))
    rows += [(77777, "repeated row " * 30)] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, root int")
    kept = nd.keep_one(df).collect()
    prints = {t: brute.simhash(t) for _, t in rows}
    want = brute.components([i for i, _ in rows], [prints[t] for _, t in rows])
    groups = {}
    for (i, p), c in want.items():
        groups.setdefault((c, p) if c is None else c, set()).add(i)
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(named) == sorted(c for c in {v for v in want.values()} if c is not None)
    assert set(kept[0].asDict()) == {"doc_id", "text", "root"}
    assert nd.keep_one(df.limit(0)).collect() == []


def test_links_are_complete_also_for_crowded_keys(spark):
    rnd = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        b = rnd.getrandbits(64)
        for _ in range(40):
            x = b
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    for limit in (2048, 3):
        for radius in (1, 2, 3):
            root = {r.node: r.root for r in components(nd.links(df, radius, 5, limit)).collect()}
            got, want = {}, {}
            for (f, _), c in brute.components(prints, prints, radius).items():
                want.setdefault(c, set()).add(f)
                got.setdefault(root.get(signed(f), signed(f)), set()).add(f)
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.range(n - 1).selectExpr("id as u", "id + 1 as v").unionAll(spark.range(5).selectExpr("id + 900 as u", "id + 900 as v"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)}
    assert components(edges.limit(0)).collect() == []
