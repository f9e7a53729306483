"""Landed raw items -> availableNow stream -> committed snapshot."""

import json
import tempfile

from tenderlake.plans import store
from tenderlake.streaming.ingest import RAW_ITEM_SCHEMA, start


def _job(title, uri):
    return json.dumps({"job_overview": {"title": title, "company": "Oslo kommune", "description": None,
                                        "delivery_date": "2026-06-30", "job_uri": uri},
                       "description": "Python backend", "description_summarised": None, "platform": "Mercell"})


def test_stream_commits_one_version_per_batch(spark):
    base = tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")
    rows = [(1, "scraper", "Mercell", "https://m.example/jobs/1", _job("Data Engineer", "https://m.example/jobs/1"), "{}", None),
            (2, "scraper", "Mercell", "https://m.example/jobs/2", _job("Backend dev", "https://m.example/jobs/2"), "{}", None)]
    spark.createDataFrame(rows, RAW_ITEM_SCHEMA).write.parquet(f"{base}/landed")
    q = start(spark, f"{base}/landed", f"{base}/ckpt", root=base)
    q.awaitTermination(600)
    assert store.is_committed(spark, 0, base) and not store.is_committed(spark, 1, base)
    v, st = store.read_state(spark, base)
    assert v == 0 and st.raw.count() == 2 and st.links.count() == 2
    # replaying the same micro-batch id is skipped (idempotent sink)
    q2 = start(spark, f"{base}/landed", f"{base}/ckpt", root=base)
    q2.awaitTermination(600)
    assert store.last_commit(spark, base)[0] == 0
