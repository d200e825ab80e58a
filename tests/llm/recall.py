"""Recall of the nearest neighbours against brute force: python tests/llm/recall.py FOLDER..."""

import os
import sys
import tempfile
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def measure(spark, folder: str, top_k: int = 20) -> dict:
    from pyspark.sql import functions as F

    from lexiquarry.llm import neighbours

    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    began = time.time()
    got: dict[int, dict[int, float]] = {}
    scored: dict[int, int] = {}
    for r in neighbours.nearest(table, F.pmod("id", F.lit(20)) == 0, with_scored=True).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
        scored[r.query_id] = r.scored
    seconds = time.time() - began
    rows = {r.id: r.v for r in neighbours.usable(table, "vec_id", "embedding").select("id", "v").collect()}
    ids, x = np.array(sorted(rows)), np.array([rows[k] for k in sorted(rows)])
    hit = all_ = 0
    for q in ids[ids % 20 == 0]:
        s = x @ np.array(rows[q])
        s[ids == q] = -np.inf
        least = np.sort(s)[-top_k]  # any of those that tie with the last is right
        all_ += top_k
        hit += sum(s[np.searchsorted(ids, k)] >= least - 1e-12 for k in got.get(int(q), {}))
    return {"vectors": len(ids), "queries": len(got), "recall": round(hit / all_, 4), "scored_a_query": round(float(np.mean(list(scored.values())))), "share_of_table": round(float(np.mean(list(scored.values()))) / len(ids), 4), "seconds": round(seconds, 1)}


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        print(folder, measure(session, folder), flush=True)
