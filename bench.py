"""Headline queries, timed. Prints one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recollect.operators import index, ingest, maintain, retrieve, rewrite, search  # noqa: E402
from recollect.functions import rules  # noqa: E402
from recollect.plans import queries as Q  # noqa: E402
from recollect.session import local_session  # noqa: E402
from recollect.sources import corpus as C  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="run-bench-")
    spark = local_session(cores, "bench", **{"spark.checkpoint.dir": work, "spark.sql.shuffle.partitions": str(2 * int(cores)) if cores.isdigit() else "16"})
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, action):
        t = time.perf_counter()
        out = action()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    c = timed("index_build", lambda: index.staged_index(C.entries(spark, sf_dir)))
    timed("ingest_messages", lambda: run(ingest.message_rows(C.chat_messages(spark, sf_dir), C.handles(spark, sf_dir))))
    timed("ingest_documents", lambda: run(Q.QUERIES["ingest_documents_rows"](spark, sf_dir)))
    timed("ingest_unchanged_skip", lambda: run(Q.QUERIES["ingest_unchanged_skip"](spark, sf_dir)))
    timed("upsert_entries", lambda: run(Q.QUERIES["upsert_entries"](spark, sf_dir)))
    timed("fts_search_topk", lambda: search.search(c, Q.WORDS, 25).collect())
    timed("substring_search", lambda: search.substring_search(c.entries, Q.SUBSTRINGS, 25).collect())
    timed("finance_sweep", lambda: search.finance_sweep(c.entries).collect())
    timed("bank_source_filter", lambda: run(c.entries.where(rules.is_bank_text(rules.joined_text()))))
    timed("retrieve_relevant", lambda: retrieve.retrieve(c, Q.CHARGES).collect())
    timed("retrieve_recent", lambda: retrieve.retrieve(c, Q.CHARGES, sort_by=retrieve.RECENT).collect())
    timed("retrieve_monthly", lambda: retrieve.retrieve(c, Q.MONTHLY, 40).collect())
    timed("retrieve_cli", lambda: retrieve.retrieve_cli(c, Q.CHARGES).collect())
    timed("synonym_expand", lambda: run(Q.QUERIES["synonym_expand"](spark, sf_dir)))
    timed("term_vocab", lambda: run(rewrite.term_vocab(c.entries)))
    timed("prune", lambda: run(maintain.prune(c.entries)))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
