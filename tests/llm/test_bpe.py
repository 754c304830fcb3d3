import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aab  \n\t'ssteéß漢字1२!?… 　\x1c\x85é́😀vrlmdAZ<|>"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def encoded(texts):
    out = []
    for ids, count in bpe.Encoder(bpe.vocabulary(PATH)).encode(pa.array(texts, pa.string())):
        cut = np.concatenate(([0], np.cumsum(count)))
        out += [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]
    return out


def test_matches_the_library_on_random_text(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 80))) for _ in range(5000)]
    texts += ["", "a" * 5000, "aaaa aaaa" * 50, "\n" * 99 + "x", " " * 999, "it's we'll we've 're'd 's's ''s !'s",
              "<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|", "<|endo", "ftext|> x"]
    assert encoded(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_piece_classes_match_on_samples_of_every_category(library):
    seen, texts = {}, []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        k = (unicodedata.category(chr(c)), c >> 10)
        if seen.setdefault(k, 0) < 3:
            seen[k] += 1
            texts.append("a" + chr(c) + "a1" + chr(c) + "1! " + chr(c) + " ")
    for a, b in bpe.LETTERS_16 + bpe.NUMBERS_16:
        texts.append("a" + chr(a) + "1" + chr(b) + "!")
    assert encoded(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_query_columns_and_odd_rows(spark, library):
    rows = [(1, None, 7), (2, "", 7), (None, "Hi there", 7), (2, "Hi there", 7), (3, "wörd " * 40000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def test_columns_round_trip(spark):
    df = spark.createDataFrame([("a b  c'll",), (None,), ("漢字\n<|endoftext|>",)], "text string")
    got = df.select("text", bpe.decode(bpe.encode(df.text, PATH), PATH).alias("back")).collect()
    assert [r.back for r in got] == [r.text or "" for r in got]
    assert bpe.decode_ids(bpe.vocabulary(PATH), np.array([], np.int32), np.array([0])) == [b""]


def test_table_of_ids(spark, library):
    rows = [(i, "x" * (i % 7) + " wörd " * (i % 50), i) for i in range(3000)] + [(None, None, 1), (1, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode_table(df, PATH).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "n_tokens", "ids"}
    want = sorted((i or -1, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_table(df.limit(0), PATH).collect() == []
