"""Text -> unit vector (F5, UD1).

Two embedders share one interface, ``embed(df, text_col, out_col)``:

* ``HashedEmbedder`` - the built-in, deterministic default. Terms are
  lower-cased letter/digit runs; each term falls in an MD5 bucket; the count
  vector is L2-normalised and stored as ``array<float>``. Term extraction is
  a JVM expression; a batch is taken in slices of bounded terms and numbers, each
  distinct term is hashed once while it is remembered, and a slice's count
  vectors are assembled by one NumPy ``bincount`` (no per-row Python).
* ``ModelEmbedder`` - any user model ``encode(list[str]) -> ndarray`` run in an
  iterator pandas UDF, loaded once per Python worker and fed in batches.
"""
from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import embed_terms

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
_TERMS = "__q_terms"
#: numbers (of vectors, or terms) that a slice of an Arrow batch holds at a time
SLICE_NUMBERS = 1 << 17
#: terms whose bucket a task remembers
KNOWN_TERMS = 1 << 15


def _slices(lengths: np.ndarray, dim: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``SLICE_NUMBERS`` terms and vector numbers; a longer
    row is a range of its own."""
    ends = np.cumsum(np.maximum(lengths, dim))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_NUMBERS, "right")))
        yield a, b
        a = b


def _terms_to_vectors(dim: int, term_col: str, out_col: str):
    """Term lists to unit count vectors. Terms are dictionary-encoded per
    slice, so each distinct term is hashed once."""
    known: dict[bytes, int] = {}

    def buckets(terms: list[bytes]) -> np.ndarray:
        got = list(map(known.get, terms))
        new = [t for t, g in zip(terms, got) if g is None]
        if new:
            # the first four bytes of each digest, as one array
            heads = np.frombuffer(b"".join([hashlib.md5(t).digest()[:4] for t in new]), ">u4") % dim
            if len(known) + len(new) > KNOWN_TERMS:
                known.clear()
            known.update(zip(new[:KNOWN_TERMS], heads[:KNOWN_TERMS].tolist()))
            if len(new) == len(terms):
                return heads.astype(np.int64)
            it = iter(heads.tolist())
            got = [next(it) if g is None else g for g in got]
        return np.array(got, np.int64)

    def vectors(col: pa.Array, lengths: np.ndarray) -> pa.Array:
        n = len(col)
        terms = pc.list_flatten(col).dictionary_encode()
        of = buckets(terms.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        values = of[terms.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
        counts = np.bincount(rows * dim + values, minlength=n * dim) \
            .astype(np.float64).reshape(n, dim)
        norms = np.sqrt((counts * counts).sum(axis=1))
        safe = np.where(norms > 0, norms, 1.0)
        vec = (counts / safe[:, None]).astype(np.float32)
        offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(vec.ravel()), mask=col.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at = rb.schema.get_field_index(term_col)
            keep = [i for i in range(rb.num_columns) if i != at]
            names = [rb.schema.field(i).name for i in keep] + [out_col]
            lengths = pc.fill_null(pc.list_value_length(rb.column(at)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths, dim):
                part = rb.slice(a, b - a)
                cols = [part.column(i) for i in keep] + [vectors(part.column(at), lengths[a:b])]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            if not rb.num_rows:
                yield pa.RecordBatch.from_arrays([rb.column(i) for i in keep] + [vectors(rb.column(at), lengths)], names=names)
            rb = part = cols = None         # the next batch is read without this one
    return run


class HashedEmbedder:
    """Deterministic bag-of-terms embedder (the default)."""

    def __init__(self, dim: int = 256):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim = dim

    @property
    def embedding_dim(self) -> int:
        return self.dim

    def embed(self, df: DataFrame, text_col: str = "text",
              out_col: str = "embedding") -> DataFrame:
        staged = df.withColumn(_TERMS, embed_terms(F.col(text_col)))
        fields = [f for f in staged.schema.fields if f.name != _TERMS]
        fields.append(T.StructField(out_col, VECTOR, True))
        return staged.mapInArrow(_terms_to_vectors(self.dim, _TERMS, out_col), T.StructType(fields))


class ModelEmbedder:
    """Pluggable model (UD1). ``loader()`` returns an object with
    ``encode(list[str]) -> ndarray (n, dim)``; it runs once per Python worker,
    and texts arrive in Arrow batches of ``batch_size``."""

    def __init__(self, loader: Callable[[], object], dim: int, batch_size: int = 64,
                 normalize: bool = True):
        self.loader = loader
        self.dim = dim
        self.batch_size = batch_size
        self.normalize = normalize

    @property
    def embedding_dim(self) -> int:
        return self.dim

    def embed(self, df: DataFrame, text_col: str = "text",
              out_col: str = "embedding") -> DataFrame:
        loader, bs, norm, dim = self.loader, self.batch_size, self.normalize, self.dim

        @F.pandas_udf(VECTOR)
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loader()
            for s in texts:
                out = []
                vals = s.fillna("").tolist()
                for i in range(0, len(vals), bs):
                    m = np.asarray(model.encode(vals[i:i + bs]), dtype=np.float64)
                    if m.shape[1] != dim:
                        raise ValueError(f"model returned width {m.shape[1]}, expected {dim}")
                    if norm:
                        n = np.linalg.norm(m, axis=1, keepdims=True)
                        m = m / np.where(n > 0, n, 1.0)
                    out.extend(m.astype(np.float32))
                yield pd.Series(out)

        # or else a filter that Spark infers from an explode runs the model a second time
        return df.withColumn(out_col, encode.asNondeterministic()(F.col(text_col)))
