"""Document fingerprints: SimHash of weighted terms, and search by block tables.

Terms are the two-word shingles of the lower-cased text, weighted by
1 + floor(log2(count)). Each term's 64-bit hash votes with its weight for or
against every bit; a bit is set where the votes for it win. The likeness of
two fingerprints is the share of equal bits.

Search within a Hamming radius r: the 64 bits are cut into ``blocks`` blocks,
and for every choice of r blocks there is a table keyed by the bits outside
them (as if permuted to the front). Two fingerprints within the radius agree on
some table's key, so looking up a query in every table finds all of them; a
pair is reported by the first table only that has it. Tables hold distinct
fingerprints, so copies of a text cost one row.

Defined results: null is the empty text; a text without words has fingerprint
zero, a single word is its own term. Equal texts have equal fingerprints.
Repeated rows each get their own. Empty tables give empty results.
"""
from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._bits import majority, ring_mask, signed, word_cuts
from quarry.session import checkpoint_dir


def term_votes(buf: np.ndarray, off: np.ndarray, shingle: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes, each as often as its weight, and their number per text."""
    low = tx.LOWER[buf]
    start, end = tx.spans(low, ~tx.SEP[low], off)
    words = tx.span_hash(tx.rolling(low), start, end)
    doc = tx.doc_of(off, start)
    n = len(off) - 1
    per_doc = np.bincount(doc, minlength=n)
    h = tx.ngram_hash(words, shingle)
    at = np.flatnonzero(doc[:len(h)] == doc[shingle - 1:])
    few = np.flatnonzero((per_doc > 0) & (per_doc < shingle))        # too short: the first word
    first = np.cumsum(per_doc) - per_doc
    terms = tx.mix(np.concatenate((h[at], words[first[few]])))
    doc = np.concatenate((doc[at], few))
    order = np.argsort(doc, kind="stable")
    terms, doc = terms[order], doc[order]
    # weights: one for most terms; those met again are counted
    weight = np.ones(len(terms), np.int64)
    key = tx.mix(terms ^ tx.mix(doc.astype(np.uint64) + np.uint64(1)))
    again = np.flatnonzero(tx.duplicated(key))
    if len(again):
        _, lead, back, count = np.unique(key[again], return_index=True, return_inverse=True, return_counts=True)
        weight[again] = 0
        weight[again[lead]] = 1 + np.floor(np.log2(count)).astype(np.int64)
    return np.repeat(terms, weight), np.bincount(doc, weight, minlength=n).astype(np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text of an Arrow array (unsigned 64-bit)."""
    parts = [majority(*term_votes(buf, off)) for _, buf, off in tx.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprint(text: Column) -> Column:
    """Column of fingerprints (as a signed long) of a text column."""
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts).view(np.int64), pa.int64())

    return of(text.cast("string"))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def tables(radius: int, blocks: int) -> list[int]:
    """Key mask of each table: every choice of the blocks that may differ."""
    cuts = word_cuts(blocks)
    return [ring_mask([c for i, c in enumerate(cuts) if i not in out]) for out in combinations(range(blocks), radius)]


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, fp, distance) for every query and every fingerprint within the
    radius, itself included if it occurs. Both inputs have a column ``fp``;
    repeated fingerprints count once."""
    masks = tables(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(F.array(*[
            F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"))
            for i, m in enumerate(masks)])).alias("x")).select(name, "x.t", "x.k")

    q, p = keyed(queries, "query").alias("q"), keyed(prints, "fp").alias("p")
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.col("q.t") == F.least(*[
        F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, i).otherwise(len(masks)) for i, m in enumerate(masks)])
    near = F.bit_count(differ) <= radius
    got = q.join(p, (F.col("q.t") == F.col("p.t")) & (F.col("q.k") == F.col("p.k")) & near & first)
    return got.select("query", "fp", F.bit_count(differ).alias("distance"))


# each document against its edited text and the next document

_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, near_edited double, near_next double"


def _edit(text: str, following: str) -> str:
    """The text with its second half replaced by the next text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], following: list[str]) -> dict:
    """Result columns of documents and the texts that follow them."""
    edited = [_edit(a, b) for a, b in zip(texts, following)]
    own, changed, nxt = (fingerprints(pa.array(x, pa.string())) for x in (texts, edited, following))
    return {"doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fp": own.view(np.int64), "edited_fp": changed.view(np.int64),
            "near_edited": likeness(own, changed), "near_next": likeness(own, nxt)}


def against_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text and against the next document in
    descending id (nulls last, ties by text; the last one's next is the first).

    One range shuffle puts neighbours into one partition, in order; each
    partition is read as a stream. Where two partitions meet, the last row of
    one and the first row of the next (one of each per partition) are put
    together in a second step."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = F.col("id").desc_nulls_last()
    dealt = slim.repartitionByRange(n, order).sortWithinPartitions(order, "text").withColumn("part", F.spark_partition_id())

    def stream(batches):
        held, part = None, None             # the row before the next one
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()),
                            ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                            ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])

        def edge(row, kind):
            return pa.RecordBatch.from_pylist([{"doc_id": row[0], "text": row[1], "part": part, "edge": kind}], schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                piece = batch.slice(a, 512)
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                if held is None:
                    part = piece.column(2)[0].as_py()
                    yield edge((ids[0], texts[0]), 0)
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(ids) > 1:
                    got = _compare(ids[:-1], texts[:-1], texts[1:])
                    none = [None] * (len(ids) - 1)
                    yield pa.RecordBatch.from_pydict({**got, "part": none, "edge": none, "text": none}, schema)
        if held is not None:
            yield edge(held, 1)

    got = dealt.mapInArrow(stream, _OUT + ", part int, edge int, text string").checkpoint()
    rows = got.where("edge is null").drop("part", "edge", "text")
    ends, begins = got.where("edge = 1"), got.where("edge = 0")
    # one row a partition: which partition follows
    turn = begins.select("part").withColumn("i", F.lead("part").over(Window.orderBy("part")))
    turn = turn.select("part", F.coalesce("i", F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = ends.select("part", "doc_id", "text").join(turn, "part").join(
        begins.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def close(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                x = batch.slice(a, 64).to_pydict()
                if x["doc_id"]:
                    got = _compare(x["doc_id"], x["text"], x["following"])
                    yield pa.RecordBatch.from_pydict(got, pa.schema([
                        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()),
                        ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return rows.unionAll(pairs.select("doc_id", "text", "following").mapInArrow(close, _OUT))
