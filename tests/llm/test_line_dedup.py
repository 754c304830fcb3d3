import random

import brute
from quarry.llm.linededup import dedup_lines, maximal_runs


def docs(rnd):
    pool = ["a b c", "d e", "f", "", "g h i j k l", "m n o p", " ", "q"]
    out = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    block = [rnd.choice(pool) for _ in range(9)]
    for i in range(60, 90):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 5))]
        k = rnd.randint(0, len(lines))
        out.append((i, "\n".join(lines[:k] + block[rnd.randint(0, 3):] + lines[k:])))
    return out + [(90, None), (91, ""), (92, out[60][1]), (93, out[60][1]), (94, "z y x w v u t s r\n" * 40)]


def test_matches_brute_force(spark):
    rows = docs(random.Random(3))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_lines string, k1 int")
    for least in (1, 6, 9):
        got = {r.doc_id: r for r in dedup_lines(df, least).collect()}
        assert len(got) == len(rows)
        for (i, t), want in zip(rows, brute.line_dedup(rows, least)):
            assert got[i].text == want, (least, i)
            n = 0 if t is None else t.count("\n") + 1
            assert got[i].n_lines == n and 0 <= got[i].n_removed <= n


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (7, long), (7, long), (7, "head\n" + long), (8, "short"), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text, r.n_removed) for r in dedup_lines(df, 50).collect())
    assert got == sorted([(-1, long, 0), (7, "", 1), (7, "", 1), (7, "head", 1), (8, "short", 0), (9, "short", 0)])
    assert dedup_lines(df.limit(0), 50).collect() == []


def test_very_long_text(spark):
    lines = [f"line {i} of a very long text" for i in range(20000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x"] + lines[5000:15000] + ["y"])), (3, "\n".join(lines[:4] + ["y"]))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text, got[3].n_removed) == (0, 10000, "x\ny", 0)


def test_maximal_runs_match_brute_force(spark):
    rows = docs(random.Random(5))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "name long, body string, n_lines string, k1 int")
    for least in (6, 9):
        got = [tuple(r) for r in maximal_runs(df, least, "name", "body").collect()]
        assert len(got) == len(set(got)) and set(got) == brute.maximal_runs(rows, least)


def test_maximal_runs_of_long_copies_and_odd_rows(spark):
    lines = [f"line {i} of a very long text" for i in range(5000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x"] + lines[1000:4000] + ["y"])), (None, "\n".join(lines[10:40])), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in maximal_runs(df, 50).collect()}
    # the row without an id comes first
    assert got == {(1, 10, 30, None, 0), (2, 1, 3000, 1, 1000)}
    assert maximal_runs(df.where("doc_id = 4"), 50).collect() == []
    assert maximal_runs(df.limit(0), 50).collect() == []
