from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

from newsdesk.plans import lifecycle
from newsdesk.streaming import demotion

SCHEMA = "source_id long, at timestamp, event_id long, action string, condition_keys array<string>"


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    rng = random.Random(8)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for k in range(240):
        at = start + timedelta(hours=rng.randrange(40 * 24))
        rows.append((k % 40, at, k, rng.choice(["demote"] * 8 + ["restore", "deactivate"]), rng.sample(["noisy", "low_trust", "low_priority"], rng.randrange(1, 4))))
    rows += [(1, rows[1][1], 900, "demote", ["noisy"]), (2, start, 901, "demote", []), (2, start + timedelta(days=7), 902, "demote", ["noisy"])]
    # Days come in order, what is within two days doesn't; then one that lets all others pass.
    rows.sort(key=lambda r: (r[1] - start).days // 2 + rng.random())
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[(99, start + timedelta(days=90), 999, "restore", [])], [(99, start + timedelta(days=91), 1000, "restore", [])]]
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = demotion.confirmed(stream, "4 days").writeStream.format("memory").queryName("confirmed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
        progress = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    finally:
        q.stop()
    want = sorted(tuple(r) for r in lifecycle.demotions(spark.createDataFrame(rows, SCHEMA)).collect())
    got = sorted(tuple(r) for r in spark.table("confirmed").select("source_id", "event_id", "at").collect())
    assert got == want and len(want) >= 10
    # What is kept shrinks to nothing but the last source's own once all demotions are too old.
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(sizes) > sizes[-1] and sizes[-1] <= 24
