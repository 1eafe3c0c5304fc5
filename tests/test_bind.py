"""Tasks of the domain tables that grow in the task that makes them."""

from __future__ import annotations

from tessitura.plans import bind


def test_tasks_that_make_frames_follow_the_events(spark, monkeypatch):
    c = bind.Catalog(spark, "/root/testdata/sf0.001")
    whole = sorted(tuple(r) for r in c.rms_frames().collect())
    events = c.table("events").count()
    monkeypatch.setattr(bind, "EVENTS", 50)
    frames = c.rms_frames()
    assert "RepartitionByExpression [user_id" in frames._jdf.queryExecution().optimizedPlan().toString()
    assert frames.rdd.getNumPartitions() == -(-events // 50)
    assert sorted(tuple(r) for r in frames.collect()) == whole
