"""Streams with timers: several triggers with a restart between give what the tables give, and state is freed."""

from __future__ import annotations

import random
from datetime import datetime, timedelta


from tessitura.sources.shared import shared_dir
from tessitura.streaming import progress as Z
from tessitura.streaming import timers as T

SCHEMA = "id long, job_id long, status string, step string, progress long, ts timestamp"
START = datetime(2024, 1, 1)


def made(spark, n=240):
    rnd, rows, at = random.Random(2), [], 0
    for k in range(n):
        at += rnd.choice([1, 20, 20, 40, 400])
        step = rnd.choice("ab")
        rows.append((k, rnd.randrange(6), rnd.choice(["running"] * 6 + ["completed", "failed"]), step, rnd.randrange(2), START + timedelta(seconds=at)))
    return rows, START + timedelta(seconds=at)


def streamed(spark, rows, build, parts=4):
    """The rows as files in order, one a trigger; the query is started anew for each."""
    source, out, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    size, left = -(-len(rows) // parts), []
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").outputMode("append").start(out)
        q.awaitTermination()
        left.append(next(p["stateOperators"][0]["numRowsTotal"] for p in reversed(q.recentProgress) if p["stateOperators"]))
    return sorted(tuple(r) for r in spark.read.parquet(out).collect()), left


def test_inactivity_rows_come_by_the_timer(spark):
    rows, end = made(spark)
    rows.append((999, 77, "running", "a", 0, end + timedelta(days=1)))  # moves the watermark past all others
    want = sorted(tuple(r) for r in Z.inactivity(spark.createDataFrame(rows, SCHEMA)).filter("job_id <> 77").collect())
    got, left = streamed(spark, rows, T.inactivity)
    assert got == want and len(want) > 20
    assert left[-1] <= 3  # only the last job's value and timer are held


def test_changes_and_ends_equal_their_tables(spark):
    rows, end = made(spark)
    rows.append((999, 77, "completed", "a", 0, end + timedelta(days=30)))
    table = spark.createDataFrame(rows, SCHEMA)
    got, left = streamed(spark, rows, lambda s: T.emit_on_change(s, 500), 3)
    assert got == sorted(tuple(r) for r in T.changes(table, 500).collect()) and len(got) > 100
    assert left[-1] <= 3
    got, left = streamed(spark, rows, lambda s: T.terminal_events(s, 10**7), 3)
    first = {}
    for i, job, status, _, _, _ in rows:
        if status != "running":
            first.setdefault(job, (job, i, status))
    assert got == sorted(first.values())


def test_inactivity_at_its_bounds_and_without_python(spark):
    at = lambda s: START + timedelta(seconds=s)
    # Just as late as the time-out: a new stretch; a moment before: the same; job 3 ends with the last event, job 4 before it.
    rows = [(1, 0), (1, 300), (2, 0), (2, 299.9999), (3, 1000), (4, 999.99), (9, 1300)]
    rows = [(k, job, "running", "a", 0, at(s)) for k, (job, s) in enumerate(rows)]
    want = [(1, at(0), at(300), 1), (1, at(300), at(600), 1), (2, at(0), at(599.9999), 2), (4, at(999.99), at(1299.99), 1)]
    assert streamed(spark, rows, T.inactivity, 1)[0] == want
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in Z.inactivity(table).filter("job_id IN (1, 2, 4)").collect()) == want
    plan = T.inactivity(table)._jdf.queryExecution().toString()
    assert "session_window" in plan and "Pandas" not in plan
