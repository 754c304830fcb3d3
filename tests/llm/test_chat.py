import hashlib
import random
from collections import defaultdict

import brute
from quarry.llm import chat

ROLES = ["user", "assistant", "system", "tool <x>", None, "a\\>b"]


def conversations(rnd):
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok", 1), (-7, 1, "assistant", "\\### Assistant: </turn> ok", 1),
            (None, 0, "assistant", "x", 1), (3, 0, "assistant", None, 1), (4, None, "assistant", "", 1), (4, 1, "user", "<turn user>", 1)]
    bits = ["a", "b c ", "\\", "<", ">", "</turn>\n", "<turn user>", "\\l", "é漢 ", "\n"]
    for c in range(10, 40):
        for t in range(rnd.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rnd.choice(ROLES)
            rows.append((c, t if c < 35 else t * 1500, role, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))), 1))
    rows += [(9, 1, "assistant", "same", 1)] * 3
    rnd.shuffle(rows)
    return rows


def expected(rows):
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_match_the_turns(spark):
    rows = conversations(random.Random(4))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    for budget, history in ((1024, 256), (60, 20), (5, 0)):
        wins = chat.windows(df, budget, history).cache()
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(wins).collect()}
        assert got == expected(rows)
        chars = {r.conv_id: r.formatted_chars for r in chat.digests(wins).collect()}
        total = defaultdict(int)
        for w in wins.collect():
            total[w.conv_id] += len(w.text)
        assert chars == dict(total)
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_windows_keep_the_budget_the_system_turn_and_history(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"w{i} " * (5 + i % 7)) for i in range(1, 60)]
    turns += [(1, 60, "user", "long " * 300), (1, 61, "assistant", "end")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    wins = chat.windows(df, budget=100, history=30).orderBy("block", "window").collect()
    assert len(wins) > 5
    for i, w in enumerate(wins):
        said = chat.parse(w.text)
        assert said[0] == ("system", "be kind")
        tokens = [len(brute.words(t)) + chat.MARKS for _, t in said]
        assert sum(tokens) == w.n_tokens and len(said) == w.n_repeated + w.n_new
        assert w.n_tokens <= 100 or w.n_new == 1
        if i:
            past = [t for x in wins[:i] for t in chat.parse(x.text)[x.n_repeated:]]
            again = said[1:w.n_repeated]
            assert again == past[len(past) - len(again):] and sum(tokens[1:w.n_repeated]) <= 30
    assert any(w.n_repeated > 1 for w in wins)


def test_long_conversation_spreads_over_blocks(spark):
    n = 3 * chat.BLOCK
    rows = [(1, i, "system" if i == 0 else "assistant", str(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat.windows(df, 200, 50).cache()
    assert wins.select("block").distinct().count() == 3
    assert all(chat.parse(w.text)[0] == ("system", "0") for w in wins.collect())
    r = chat.digests(wins).first()
    loss = "".join(str(i) for i in range(1, n))
    assert (r.n_turns, r.loss_sha256) == (n, hashlib.sha256(loss.encode()).hexdigest())
