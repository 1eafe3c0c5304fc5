"""Several tables from one stream: stopped in the middle of a trigger and started again, nothing is lost, doubled or half read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessitura.sources.shared import shared_dir
from tessitura.streaming import sinks as S

MESSAGES = "id long, value string"


def parts(spark):
    vectors = {k: [float(k % 3 == j) for j in range(3)] for k in range(40)}
    audio = spark.createDataFrame([(k, v) for k, v in vectors.items()], "track_id long, vector array<double>")
    centroids = spark.createDataFrame([(10 + j, [float(j == i) * 0.5**0.5 for i in range(3)] * 2) for j in range(3)], "cluster_id long, centroid array<double>")
    payload = spark.createDataFrame([(k, "current_hit" if k % 2 else None) for k in range(30)], "track_id long, popularity_category string")
    return S.index_messages(audio, audio.filter("track_id < 35"), centroids, payload)


def test_a_killed_trigger_is_run_again(spark):
    split, source, checkpoint = parts(spark), shared_dir(spark), shared_dir(spark)
    tables = S.Tables(spark, shared_dir(spark))
    rows = [(k, json.dumps({"track_id": k % 38, "mp3_key": f"m{k}"}) if k % 7 else "{broken" if k % 2 else json.dumps({"track_id": k})) for k in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], MESSAGES).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)

    def dies(df):
        """The second trigger ends after its first tables."""
        out = split(df)
        if df.agg(F.min("id")).first()[0] == 30:
            out["dead"] = out["dead"].withColumn("error", F.raise_error(F.lit("killed")))
        return out

    with pytest.raises(Exception, match="killed"):
        S.drive(stream(), checkpoint, tables, dies)
    assert tables.read("audio", S.POINT).agg(F.max("trigger")).first()[0] == 0  # the half trigger isn't read
    S.drive(stream(), checkpoint, tables, split)
    S.drive(stream(), checkpoint, tables, split)  # nothing new
    good = {}
    for i, v in rows:
        if i % 7:
            good.setdefault(i // 30, {})[json.loads(v)["track_id"]] = i
    want = {(i, t, 10 + t % 3) for g in good.values() for t, i in g.items() if t < 35}
    got = [tuple(r) for r in tables.read("indexed", S.INDEXED).select("id", "track_id", "rec_cluster_id").collect()]
    assert len(got) == len(want) and set(got) == want
    dead = {r["id"]: r["error"] for r in tables.read("dead", S.DEAD).collect()}
    assert dead == {i: "broken" if i % 2 else "missing" for i, _ in rows if i % 7 == 0} | {i: "no vectors" for g in good.values() for t, i in g.items() if t >= 35}
    for name in ("audio", "lyrics"):
        points = S.newest(tables.read(name, S.POINT), "track_id").collect()
        assert sorted(p["track_id"] for p in points) == sorted({t for _, t, _ in want})
        assert all(p["status"] == "ready" and p["catalog_cluster_id"] == p["rec_cluster_id"] and p["popularity_category"] == ("current_hit" if p["track_id"] % 2 and p["track_id"] < 30 else "regular") for p in points)
    base = spark.createDataFrame([(10, 5), (99, 1)], "rec_cluster_id long, n long")
    n = {r["rec_cluster_id"]: r["n"] for r in S.counters(base, tables.read("indexed", S.INDEXED).groupBy("rec_cluster_id").agg(F.count("*").alias("n")), "rec_cluster_id").collect()}
    assert n == {99: 1} | {c: sum(x[2] == c for x in want) + 5 * (c == 10) for c in (10, 11, 12)}
