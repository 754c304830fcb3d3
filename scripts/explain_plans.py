"""Write PLANS.md: the physical operators of the key plans (formatted
explain, trimmed to operator lines and scan details)."""
from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from quarry.config import demo  # noqa: E402
from quarry.operators.cells import _cells_of, cell_bounds, score_cells  # noqa: E402
from quarry.operators.chunk import chunk_long_documents  # noqa: E402
from quarry.operators.index import append_delta, assign_cells, load_index, save_index, train_cells  # noqa: E402
from quarry.operators.store import fetch, save_store  # noqa: E402
from quarry.operators.search import knn  # noqa: E402
from quarry.plans import catalog as C  # noqa: E402
from quarry.plans.rag import prepare_chunks, summarize_hits  # noqa: E402
from quarry.session import get_spark, scratch_path  # noqa: E402
from quarry.sources.tables import documents_from_table, read_table  # noqa: E402

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
KEEP = re.compile(r"^(\s*[+:-].*|[A-Z][\w ]* \(\d+\)$|\(\d+\) .*|PartitionFilters.*|PushedFilters.*|ReadSchema.*|Arguments: .{0,160})")


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    lines = [ln[:220] for ln in buf.getvalue().splitlines() if KEEP.match(ln)]
    return "\n".join(lines)


def main():
    spark = get_spark(cpus=8)
    cfg = demo()
    out = ["# Physical plans of the key operators", "",
           f"Generated by `scripts/explain_plans.py` on `{SF}` (local[8]). Trimmed to operators and scan details.", ""]

    docs = documents_from_table(read_table(spark, SF, "documents"))
    out += ["## C1: clean -> chunk -> embed (one narrow stage; the exchange is the local scan setting)", "```",
            plan(prepare_chunks(docs, cfg)), "```", ""]

    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = C.label_centroids(e)
    out += ["## J1/T1: broadcast Arrow scorer, partial + final WindowGroupLimit (corpus never shuffled)", "```",
            plan(knn(q, e, 5, corpus_keys=("vec_id",), materialize=False)), "```", ""]

    cents = train_cells(e, 20, seed=1)
    path = save_index(assign_cells(e, cents), scratch_path(spark, "ix"), cents)
    idx, c = load_index(spark, path)
    out += ["## J4: probed search over the cell-partitioned index (PartitionFilters = probed cells)", "```",
            plan(knn(q, idx, 5, corpus_keys=("vec_id",), cell_col="cell", centroids=c, nprobe=3, materialize=False)),
            "```", ""]

    hits = C._hits(spark, SF)
    out += ["## C2: per-question window + aggregate share one exchange", "```",
            plan(summarize_hits(hits, cfg)), "```", ""]

    bounds = cell_bounds(idx, c).checkpoint()
    asks = e.select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v"), F.lit(5).cast("long").alias("k"))
    pairs = _cells_of(asks, bounds, 1, 1 << 26).checkpoint()
    out += ["## J1/J4: questions joined with the index by cell (only cells that are asked are read; hot cells in parts)", "```",
            plan(score_cells(pairs, idx, bounds, ["vec_id"], "embedding")), "```", ""]

    texts = save_store(prepare_chunks(docs, cfg).select("doc_id", "chunk_index", "filename", "chunk_text"), scratch_path(spark, "texts"))
    out += ["## J5: texts fetched for the hits (dynamic pruning of the store's slices; the vector pass above reads no text)", "```",
            plan(fetch(hits.where("rank = 1").select("query_id", "doc_id", "chunk_index").limit(3), texts, ["chunk_text"])), "```", ""]

    append_delta(spark, path, e.where("vec_id % 50 = 0").withColumn("vec_id", -F.col("vec_id") - 1))
    out += ["## SRC7: an index of a base and a delta (no voided documents here, so a plain union; else an anti-join by document)", "```",
            plan(load_index(spark, path)[0]), "```", ""]

    out += ["## F1: long documents (segments dealt to all tasks, prefix sum of piece counts, border windows joined)", "```",
            plan(chunk_long_documents(docs, cfg.chunk_size, cfg.chunk_overlap, segment_chars=2000)), "```", ""]

    out += ["## W5: prefix sum over balanced ranges of (time, key)", "```",
            plan(C.event_running_total(spark, SF)), "```", ""]

    out += ["## T2: single question as a literal vector, TakeOrderedAndProject", "```",
            plan(C.knn_single(spark, SF)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
