"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's texts arrive as Arrow batches. Array passes over the UTF-8 bytes
cut them into pieces (the pattern that byte-level BPE uses before merging); the
distinct pieces that a batch adds are laid out as one array of symbols, and an
index maps every mergeable adjacent pair to all its positions in that array.
Ranks are applied in ascending order: all live positions of the pair merge at
once, and only the lists of the pairs that this makes are extended. A merge
makes a symbol that only later ranks use, so one pass over the active ranks is
complete.

Pieces already encoded are kept per worker, by a 64-bit hash of their bytes, as
rows of one flat token array (dropped when it outgrows ``KEEP_BYTES``); each
text is then a gather of its pieces' rows.

Memory follows the Arrow batch and the longest text, not the table. No
shuffle. The vocabulary file is read once per worker from the path given,
which every node must have.

Defined results: a null text is encoded as the empty text (no ids); decoding
null gives the empty text. Bytes that are not UTF-8 after decoding become
U+FFFD, as in the public library. The special tokens' strings in a text become
their ids. Rows and other columns pass through; columns named like an output
column are replaced; empty tables give empty results.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _text as tx

#: code points with Unicode's White_Space property
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: after an apostrophe that begins a piece, these end it
SHORT, LONG = "stmd", ("re", "ve", "ll")
KEEP_BYTES = 24 << 20
BLOCK_BYTES = 1 << 20

OTHER, LETTER, NUMBER, SPACE = range(4)

#: fixed values: letters and numbers that Unicode 16 added, which the public
#: library knows and Python's own table (15.1) does not
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, space or other, by code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                      np.uint8, sys.maxunicode + 1)
    for ranges, value in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a:b + 1] = value
    out[WHITE] = SPACE
    return out


def decode_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and value of each code point of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    cp = lead.astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        hit = np.flatnonzero((lead >= low) & (lead < high))
        if len(hit):
            v = cp[hit] & mask
            for j in range(1, more + 1):
                v = (v << 6) | (buf[at[hit] + j] & 0x3F)
            cp[hit] = v
    return at, cp


def cut_pieces(buf: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces begin. ``borders``: byte offsets that no
    piece crosses and past which no rule looks."""
    if not len(buf):
        return np.zeros(0, np.int64)
    at, cp = decode_points(buf)
    n = len(at)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[np.searchsorted(at, borders)] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = run.copy()
    # one plain space before a run of letters, numbers or others belongs to it
    joined = run[1:] & ~edge[1:n] & (cp[:-1] == 0x20)
    start[1:] &= ~joined
    # of white space before such a run, the last character stands apart
    follow = np.zeros(n, bool)
    follow[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= follow
    # contractions
    i = np.flatnonzero((cp == 0x27) & run & start)
    i = i[~edge[i + 1]]
    first = cp[i + 1]
    short = i[np.isin(first, [ord(c) for c in SHORT])]
    start[short + 1] = False
    rest = short + 2
    start[rest[rest < n]] = True
    i = i[i + 2 < n]
    i = i[~edge[i + 2]]
    for x in LONG:
        j = i[(cp[i + 1] == ord(x[0])) & (cp[i + 2] == ord(x[1]))]
        start[j + 1] = False
        rest = j + 3
        start[rest[rest < n]] = True
    return at[start]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    itself where printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Ids, merges by rank and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([ids[c] for c in letters], np.int32)
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.shift = size.bit_length()
        token = [b""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            token[i] = bytes(back[c] for c in t)
        self.token = np.frombuffer(b"".join(token), np.uint8)
        self.token_len = np.fromiter(map(len, token), np.int64, size)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        a = np.array([ids[x] for x, _ in pairs], np.int64)
        b = np.array([ids[y] for _, y in pairs], np.int64)
        self.left, self.right = a, b
        self.made = np.array([ids[x + y] for x, y in pairs], np.int64)
        key = (a << self.shift) | b
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        want = (a.astype(np.int64) << self.shift) | b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], -1)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces (their bytes in a row, and the size of each),
        flat, and how many each has."""
        sym = self.byte_id[raw]
        n = len(sym)
        # a stop symbol beyond both ends; neighbours across pieces are stops
        kind = np.int32 if n < 1 << 30 else np.int64
        nxt, prv = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        end = np.cumsum(size)
        begin = end - size
        nxt[end[size > 0] - 1] = n
        prv[begin[size > 0]] = n
        sym = np.append(sym, np.int32(-1))
        nxt, prv = np.append(nxt, kind(n)), np.append(prv, kind(n))
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray, above: int) -> None:
            """Adds positions to the lists of the pairs that begin there."""
            at = at[nxt[at] < n]
            r = self.ranks(sym[at], sym[nxt[at]])
            ok = r > above
            at, r = at[ok], r[ok]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, part in zip(r[np.concatenate(([0], cut))].tolist() if len(r) else [], np.split(at, cut)):
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(queue, x)

        note(np.arange(n, dtype=kind), -1)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)     # repeats do no harm
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if not len(at):
                continue
            if a == b:                       # in a run of equal symbols every other one starts a pair
                at = np.unique(at)
                chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            sym[gone] = -2
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            note(np.concatenate((at, before[before < n])), r)
        live = sym[:n] >= 0
        total = np.concatenate(([0], np.cumsum(live)))
        return sym[:n][live], total[end] - total[begin]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, .. (size[0] of them), begin[1], .. and so on."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


class Encoder:
    """Encodes batches of texts; keeps the pieces met so far."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces; the first rows are the special tokens."""
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids = np.fromiter(self.vocab.special.values(), np.int32)
        self.count = np.ones(len(self.ids), np.int64)
        self.rows = len(self.ids)
        self.bytes = 0

    def _special(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, row) of the special tokens' strings, left to right."""
        raw, found = buf.tobytes(), []
        names = [(t.encode(), i) for i, t in enumerate(self.vocab.special)]
        for name, i in names:
            at = raw.find(name)
            while at >= 0:
                if np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(name) - 1, "right"):
                    found.append((at, at + len(name), i))
                at = raw.find(name, at + 1)
        out, end = [], 0
        for x in sorted(found, key=lambda x: (x[0], -x[1])):
            if x[0] >= end:
                out.append(x)
                end = x[1]
        return out

    def _rows(self, buf: np.ndarray, off: np.ndarray, fresh: list) -> tuple[np.ndarray, np.ndarray]:
        """Row of each piece of a block, and how many pieces each text has. New
        pieces get rows at once; their bytes are added to ``fresh``."""
        special = self._special(buf, off)
        cut = np.array([x for a, b, _ in special for x in (a, b)], np.int64)
        begin = cut_pieces(buf, np.concatenate((off, cut)))
        inside = np.zeros(len(begin), bool)
        for a, b, _ in special:                     # one piece each
            inside |= (begin > a) & (begin < b)
        begin = begin[~inside]
        end = np.append(begin[1:], len(buf)) if len(begin) else begin
        h = tx.span_hash(tx.rolling(buf), begin, end)
        known, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, known)
        have = at < len(self.hash)
        have[have] = self.hash[at[have]] == known[have]
        row = np.empty(len(known), np.int32)
        row[have] = self.row[at[have]]
        new = np.flatnonzero(~have)
        row[new] = self.rows + np.arange(len(new))
        self.rows += len(new)
        self.hash = np.insert(self.hash, at[new], known[new])
        self.row = np.insert(self.row, at[new], row[new])
        size = (end - begin)[first[new]]
        fresh.append((buf[_gather(begin[first[new]], size)], size))
        rows = row[back]
        for a, _, i in special:
            rows[np.searchsorted(begin, a)] = i
        return rows, np.bincount(tx.doc_of(off, begin), minlength=len(off) - 1)

    def encode(self, texts: pa.Array):
        """Blocks of consecutive texts: token ids, flat, and how many each has."""
        if self.bytes > KEEP_BYTES:
            self.clear()
        fresh: list = []
        blocks = [self._rows(buf, off, fresh) for _, buf, off in tx.blocks(texts, BLOCK_BYTES)]
        if fresh:
            raw, size = (np.concatenate(x) for x in zip(*fresh))
            ids, count = self.vocab.merge(raw, size)
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.count = np.concatenate((self.count, count))
            self.bytes += len(raw) + 24 * len(size)
        begin = np.cumsum(self.count) - self.count
        for rows, pieces in blocks:
            n = self.count[rows]
            total = np.concatenate(([0], np.cumsum(n)))
            border = np.concatenate(([0], np.cumsum(pieces)))
            yield self.ids[_gather(begin[rows], n)], np.diff(total[border])


def decode_ids(vocab: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Bytes of each text, from all ids in a row and how many each text has."""
    size = vocab.token_len[ids]
    raw = vocab.token[_gather(vocab.token_at[ids], size)].tobytes()
    total = np.concatenate(([0], np.cumsum(size)))
    cut = total[np.concatenate(([0], np.cumsum(count)))].tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    return _encoders[path]


def encode(text: Column, path: str) -> Column:
    """array<int> of token ids, without special tokens added."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        out, size = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for got, count in _encoder(path).encode(texts):
            out.append(got)
            size.append(count)
        ends = np.cumsum(np.concatenate(size))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.int32()))

    return ids(text.cast("string"))


def encode_table(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` without the text, with ``ids`` (token ids) and ``n_tokens``. Rows
    leave in batches of one block of text, so a worker never holds the ids of a
    whole input batch."""
    made = ["n_tokens", "ids"]
    rest = [c for c in df.columns if c not in (text_col, *made)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()),
                                                          T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            at = 0
            for ids, count in _encoder(path).encode(batch.column(len(rest))):
                n = len(count)
                ends = np.concatenate(([0], np.cumsum(count)))
                cols = [batch.column(i).slice(at, n) for i in range(len(rest))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), lists], names=[*rest, *made])
                at += n

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of token ids; special tokens are kept."""
    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        out: list[str] = []
        for a in range(0, len(lists), 256):
            part = lists.slice(a, 256)
            count = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = part.flatten().to_numpy(zero_copy_only=False)
            out += [x.decode("utf-8", "replace") for x in decode_ids(vocabulary(path), ids, count)]
        return pa.array(out, pa.string())

    return text(ids)


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` (UTF-8 of the decoded ids), by encoding
    and decoding every text in one pass that keeps the ids in Python."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        enc, n, a, b = _encoder(path), [], [], []
        for ids, count in enc.encode(texts):
            n += count.tolist()
            raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            a += [hashlib.sha256(raw[x - 4 * k:x]).hexdigest() for x, k in zip(end, count.tolist())]
            b += [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest()
                  for x in decode_ids(enc.vocab, ids, count)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], made)

    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    got = df.select(*rest, digests(F.col(f"`{text_col}`").cast("string")).alias("__bpe"))
    return got.select(*rest, "__bpe.*")
