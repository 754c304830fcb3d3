"""Late materialisation (J5): the vector pass reads keys and vectors only, and
texts are fetched for the hits.

The payload lives in a store of its own, Parquet in ``slices`` hash slices of the
first key (a partition column), sorted by key inside each. ``fetch`` joins the hits
with the store on slice and keys: where the hits are few, Spark's dynamic partition
pruning reads only the slices that hold some, where they are many, it is a plain
equi-join that can be split. Nothing goes through the driver.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 64


def _slice(keys: Sequence[str], slices: int) -> Column:
    return F.pmod(F.xxhash64(F.col(keys[0])), F.lit(slices)).cast("int")


def save_store(df: DataFrame, path: str, keys: Sequence[str] = ("doc_id", "chunk_index"), slices: int = SLICES,
               max_records_per_file: int = 200_000) -> str:
    """Writes ``df`` by slice and key; a big slice is several files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.withColumn("slice", _slice(keys, slices)).repartitionByRange(n, "slice", *keys).sortWithinPartitions("slice", *keys)
     .write.option("maxRecordsPerFile", max_records_per_file).partitionBy("slice").parquet(path))
    return path


def fetch(hits: DataFrame, store_path: str, payload: Sequence[str], keys: Sequence[str] = ("doc_id", "chunk_index"),
          slices: int = SLICES) -> DataFrame:
    """``hits`` with the ``payload`` columns of their keys (null where the
    store has no such key). A key stands in the store once."""
    store = hits.sparkSession.read.parquet(store_path).select("slice", *keys, *payload)
    return hits.withColumn("slice", _slice(keys, slices)).join(store, ["slice", *keys], "left").drop("slice")
