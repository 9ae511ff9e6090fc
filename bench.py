"""Benchmark of the headline queries.

Runs each query over the tables in ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]``: one warm-up pass over all queries, then the median of
``$BENCH_RUNS`` (default 3) timed runs each. A run executes the whole plan
into the ``noop`` sink (nothing is collected to the driver). Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quire.plans import catalog  # noqa: E402
from quire.session import build_session  # noqa: E402

HEADLINE = [
    "flagship",  # documents -> vocabulary -> encode -> pack -> blocks per genre
    "g_loader",  # mix -> buffered shuffle -> shards -> encode -> pack -> batches (the loader chain)
    "c_all",  # weighted mix, all exhausted (oversampling)
    "d_shuffle",  # mix + seeded global shuffle
    "f_encode",  # word encode with byte fallback
    "g_pack",  # packed training blocks
    "g_batches",  # batches of packed blocks
    "h_logppl",  # bigram fit + token-weighted log-perplexity
    "i_topp",  # penalty -> temperature -> top-k -> top-p -> softmax
    "f_chat",  # chat rendering + encode
    "b_sentences",  # corpus lines
    "e_words",  # word vocabulary
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    for n in names:  # warm-up: JIT, file listing, Python workers
        run(spark, n, sf_dir)
    times = {n: round(statistics.median(run(spark, n, sf_dir) for _ in range(runs)), 3) for n in names}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out = {
        "metric": "headline_total_median",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "documents": docs,
        "docs_per_sec_pack": round(docs / times["g_pack"], 1) if "g_pack" in times and times["g_pack"] > 0 else None,
        "cpus": int(cpus),
        "runs": runs,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
