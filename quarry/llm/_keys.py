"""A join key for documents that tolerates null and repeated ids."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """(k1, k2), never null: the id with nulls replaced, and a hash of id and
    text. Rows share both only if they are equal in id and text."""
    kind = df.schema[id_col].dataType.simpleString()
    low = F.lit("" if kind == "string" else 0).cast(kind)
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.coalesce(i, low), F.xxhash64(i.isNull(), i, t.isNull(), t)
