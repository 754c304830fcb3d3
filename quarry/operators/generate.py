"""Batch text generation (UD2, UD3, F18).

``generate_with(df, generator)`` runs a generator over a table of message
arrays in Arrow batches (``mapInPandas``). A generator is a function
``fn(messages) -> dict(answer, usage, model)``, or a ``BatchGenerator`` whose
loader runs once per Python worker and whose model answers a list of message
arrays at a time. A failure becomes a value (``"Error: ..."`` answer, empty
usage) plus an ``error`` column, so reports can leave such rows out.

``extractive_answer`` is the built-in deterministic generator: a pure Column
expression over all sections in the context. It keeps tests, the oracle and
the bench free of any model.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_sentences
from ..functions.tokens import embed_terms

EXTRACTIVE_MODEL = "extractive"

_OUT = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("usage", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("model", T.StringType()),
    T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class BatchGenerator:
    """``loader()`` returns a function ``list[messages] -> list[dict]``."""
    loader: Callable[[], Callable[[list], list]]
    batch_size: int = 16


def extractive_answer(texts: Column, question: Column) -> Column:
    """The sentences (F6 rules) of all ``texts``, in order and each once, that
    share at least half as many distinct terms with the question as the best
    sentence does; "" if no sentence shares any."""
    asked = F.array_distinct(embed_terms(question))
    sentences = F.array_distinct(F.flatten(F.transform(texts, split_sentences)))

    def pick(scored: Column) -> Column:
        best = F.array_max(F.transform(scored, lambda s: s["n"]))
        good = F.filter(scored, lambda s: (s["n"] > 0) & (s["n"] * 2 >= best))
        return F.array_join(F.transform(good, lambda s: s["s"]), " ")

    scored = F.transform(F.array(asked), lambda q: F.transform(sentences, lambda s: F.struct(
        s.alias("s"), F.size(F.array_intersect(q, embed_terms(s))).alias("n"))))
    return F.coalesce(F.get(F.transform(scored, pick), F.lit(0)), F.lit(""))


def generate_with(df: DataFrame, generator, messages_col: str = "messages", model_name: str = "custom") -> DataFrame:
    """UD2 for any Python generator; keeps every input column."""
    in_schema = df.schema
    out_schema = T.StructType(list(in_schema.fields) + [
        f for f in _OUT.fields if f.name not in in_schema.names])

    def one(result) -> tuple:
        return (result.get("answer", ""), {k: int(v) for k, v in (result.get("usage") or {}).items()},
                result.get("model", model_name), None)

    def failed(e: Exception) -> tuple:
        return f"Error: {e}", {}, model_name, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batched = isinstance(generator, BatchGenerator)
        model = generator.loader() if batched else None
        for pdf in frames:
            asked = [[dict(x) for x in m] if m is not None else [] for m in pdf[messages_col]]
            out = []
            if batched:
                for a in range(0, len(asked), generator.batch_size):
                    part = asked[a:a + generator.batch_size]
                    try:
                        got = [one(r) for r in model(part)]
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} answers to {len(part)} questions")
                    except Exception as e:  # noqa: BLE001 - failures become values
                        got = [failed(e)] * len(part)
                    out += got
            else:
                for m in asked:
                    try:
                        out.append(one(generator(m)))
                    except Exception as e:  # noqa: BLE001 - failures become values
                        out.append(failed(e))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pdf.assign(answer=list(cols[0]), usage=list(cols[1]), model=list(cols[2]), error=list(cols[3]))

    return df.mapInPandas(run, out_schema)


def repeat_runs(prompts: DataFrame, generator, runs: int, key: str = "query_id") -> DataFrame:
    """UD3: the callable under test asked ``runs`` times about each prompt
    (``query_id, messages``) -> ``query_id, run, answer``. Every run is a row
    of its own, so repeats spread over the cluster; failed calls are left out."""
    asked = prompts.select(key, "messages", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return generate_with(asked, generator).where(F.col("error").isNull()).select(key, "run", "answer")
