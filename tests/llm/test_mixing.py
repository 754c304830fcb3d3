import random
from collections import Counter, defaultdict

import brute
from quarry.llm.mixing import Mix, mixed, plan
from quarry.llm.queries import op4_mix_sources


def docs(rnd):
    rows = []
    for i in range(150):
        s = rnd.choice(["a", "b", "é", "hot", "hot", "hot", None, "tiny"])
        rows.append((i, "  ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 3 if s == "tiny" else 60))), s))
    return rows + [(900, None, "a"), (901, "", "void"), (902, "one " * 5000, "big")]


def test_taken_words_and_targets(spark):
    rows = docs(random.Random(6))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    got = {r.doc_id: r for r in plan(df).collect()}
    goal, taken = brute.mix(rows)
    total = defaultdict(int)
    for (i, t, s), k in zip(rows, taken):
        r = got[i]
        assert (r.size, r.taken) == (len(brute.words(t)), k)
        assert abs(r.target - float(goal[s])) < 1e-6
        assert r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        total[s] += r.taken
    most = {s: max(len(brute.words(t)) for _, t, x in rows if x == s) for s in total}
    assert all(abs(total[s] - float(goal[s])) <= max(0.5, most[s] / 2 + 0.5) for s in total)


def test_run_has_the_words_taken_in_curriculum_order(spark):
    rows = docs(random.Random(7))
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, copies int")
    run = mixed(df).collect()
    taken = Counter()
    for r in run:
        taken[r.doc_id] += len(brute.words(r.text))
    want = {r.doc_id: r.taken for r in plan(df).collect() if r.taken}
    assert dict(taken) == want
    whole = {i: t for i, t, _ in rows}
    assert {r.source for r in run if r.text != whole[r.doc_id]} <= {"big"}      # the source of one document
    assert all(whole[r.doc_id].startswith(r.text) for r in run)
    assert [tuple(r) for r in mixed(df).collect()] == [tuple(r) for r in run]
    # rates go 3 -> 1 for the first source by rank: it comes early
    at = [k for k, r in enumerate(run) if r.source == "a"]
    assert sum(at) / len(at) < 0.5 * len(run)


def test_odd_tables(spark):
    rows = [(1, None, None), (1, "", None), (None, "a b c", "s"), (2, "a b c", "s"), (2, "a b c", "s"), (3, "x " * 50, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = plan(df).collect()
    goal, taken = brute.mix(rows)
    assert sorted(r.taken for r in got) == sorted(taken)
    assert plan(df.limit(0)).collect() == [] and mixed(df.limit(0)).collect() == []
    empty = plan(df.where("source is null")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    assert plan(df, Mix(weights=(1,), schedules=((0.0, 1.0),))).where("copies > 0 and position is null").count() == 0


def test_registered_query_comes_in_the_order_of_the_run(spark, workdir):
    df = spark.createDataFrame(docs(random.Random(8)), "doc_id long, text string, source string")
    df.repartition(5).write.parquet(f"{workdir}/documents.parquet")
    got = [(r.position is None, r.position or 0.0, r.doc_id) for r in op4_mix_sources(spark, workdir).collect()]
    assert got == sorted(got) and len(got) == 153 and any(late for late, _, _ in got)
