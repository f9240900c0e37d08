"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is executed to completion with the ``noop`` sink (all rows produced,
nothing collected).  ``full_matrix`` is the flagship: all 146 metrics of both
families for every document, from one persisted token table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402

from proselens.operators import annotate as A  # noqa: E402
from proselens.plans import jobs, registry  # noqa: E402
from proselens.session import get_session  # noqa: E402
from proselens.sources import corpus as CO  # noqa: E402

HEADLINE = ["c_descriptive", "m_lexical_diversity", "c_referential_cohesion", "m_word_frequency",
            "m_syntax", "c_connectives", "tokenize", "macro_f1", "zscore_scale"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    qs = registry.queries()
    times: dict[str, float] = {}

    # warm-up on a tiny query (JVM start, code generation caches)
    run(qs["project_label"](spark, sf_dir))

    t0 = time.time()
    docs = CO.read_documents(spark, sf_dir)
    tok = A.tokens(docs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        run(jobs.full_matrix(docs, tok=tok))
    finally:
        tok.unpersist()
    times["full_matrix"] = round(time.time() - t0, 3)

    for k in HEADLINE:
        t = time.time()
        run(qs[k](spark, sf_dir))
        times[k] = round(time.time() - t, 3)

    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus,
                      "documents": n_docs, "docs_per_sec_full_matrix": round(n_docs / times["full_matrix"], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
