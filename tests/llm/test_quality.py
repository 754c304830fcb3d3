import random

import brute
from quarry.llm.quality import COUNTS, NGRAM_LIMITS, QualityRules, quality_rules


def docs(rnd):
    pool = ["la", "le", "été", "#x", "漢字", "b|c", "d%"]
    out = [(None, 1), ("", 2), (" \n\t\r\n", 3), ("word", 4), ("a\n\na\nb\na \n a\na", 5), ("x " * 30000, 6),
           ("\x85 　 x\x1cy", 7), ("one two three four five six seven eight nine ten", 8),
           ("one two three four five six seven eight nine ten", 8)]
    for i in range(200):
        sep = [" ", "\n", "  ", " \n"]
        out.append(("".join(rnd.choice(pool) + rnd.choice(sep) for _ in range(rnd.randint(0, 60))), 100 + i))
    for i in range(50):
        out.append((" ".join(f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(5, 400))), 400 + i))
    return out


def test_counts_match_brute_force(spark):
    rows = docs(random.Random(1))
    df = spark.createDataFrame([(i, t, "x", 1) for t, i in rows], "doc_id long, text string, kept string, size int")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute.quality_base(t) for t, i in rows}
    for r in got:
        w = want[r.doc_id, r.text]
        assert {k: r[k] for k in w} == w, r.text
        assert not (r.kept and r.base_failed)
        assert r.size == 1


def test_verdict_is_that_of_repetition_alone(spark):
    rows = docs(random.Random(4))
    df = spark.createDataFrame([(i, t) for t, i in rows], "doc_id long, text string")
    assert {(r.doc_id, r.text): r.kept for r in quality_rules(df).collect()} == {(i, t): brute.quality_kept(t, NGRAM_LIMITS) for t, i in rows}


def test_clean_text_stays_and_repetition_goes(spark):
    rnd = random.Random(2)
    clean = " ".join(f"w{i}x{rnd.randint(0, 9)}" for i in range(300))
    rows = [("clean", clean), ("loop", "buy it now cheap " * 40), ("lines", (clean + "\n") * 3),
            ("symbols", " ".join(f"w{i}%%%" for i in range(300))), ("short", "only four words here")]
    got = {r.k: r.kept for r in quality_rules(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert got == {"clean": True, "loop": False, "lines": False, "symbols": True, "short": False}


def test_long_ngram_limits_use_shorter_ones_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = quality_rules(df, QualityRules(ngram_limits={2: 0.5, 9: 0.1}))
    assert out.collect() == [] and {"dup_2gram_chars", "dup_9gram_chars", *COUNTS} <= set(out.columns)


def test_symbols_are_counted_and_decide_nothing(spark):
    words = [f"w{i}x{i * i}" for i in range(300)]
    rows = [("table", "\n".join(" | ".join(words[i:i + 5]) for i in range(0, 300, 5))),
            ("markdown", "\n".join(f"# {a}\n* **{b}** {c}" for a, b, c in zip(words[::3], words[1::3], words[2::3]))),
            ("code", "\n".join(f"if (a_{w} && b<{w}> | ${w}) {{" for w in words)), ("rules", "\n".join(f"{w} ### *** $$$$" for w in words[:60])),
            ("junk", " ".join(w + "$$$" if i % 2 else w for i, w in enumerate(words))), ("few", " ".join(words) + " a$$$ %%%b c###d")]
    got = {r.k: r for r in quality_rules(spark.createDataFrame(rows, "k string, text string").coalesce(1)).collect()}
    assert {k: r.n_glued_words for k, r in got.items()} == {"table": 0, "markdown": 0, "code": 0, "rules": 0, "junk": 150, "few": 3}
    assert {k for k, r in got.items() if r.kept} == set(got) - {"rules"}       # which repeats itself


def test_glued_runs_end_at_words_and_texts(spark):
    texts = ["a$$", "$b", "$$$", "x##\n#y", "é%%%", "", "|", "||", "a|||"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    assert [r.n_glued_words for r in quality_rules(df).orderBy("id").collect()] == [0, 0, 0, 0, 1, 0, 0, 0, 1]
