"""Versioned tables: merges touch their buckets only, a failed one changes nothing, older versions stay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessitura.sources.shared import shared_dir
from tessitura.sources.tables import KeyedTable

SCHEMA = "id long, name string, n int"


def rows(df):
    return {r["id"]: (r["name"], r["n"]) for r in df.collect()}


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_merges_equal_a_dictionary(spark):
    rnd, want, versions = random.Random(3), {}, []
    t = KeyedTable(spark, shared_dir(spark), SCHEMA, "id", 8)
    make = lambda ids, f: spark.createDataFrame([(i, *f(i)) for i in ids], SCHEMA)
    assert rows(t.read()) == {} and t.manifest() == (0, {})
    for k in range(4):
        new = {i: (f"v{k}", k) for i in rnd.sample(range(30), 9)}
        t.upsert(make(new, new.get))
        want |= new
        patches = {i: (None, 100 + k) if i % 2 else (f"p{k}", None) for i in rnd.sample(range(40), 7)}
        t.patch(make(patches, patches.get))
        want |= {i: (a or want[i][0], want[i][1] if b is None else b) for i, (a, b) in patches.items() if i in want}
        gone = rnd.sample(range(35), 4)
        t.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        want = {i: v for i, v in want.items() if i not in gone}
        versions.append((t.manifest()[0], dict(want)))
        assert rows(t.read()) == want
    assert [rows(t.read(v)) for v, _ in versions] == [w for _, w in versions]
    assert t.upsert(make([], None)) == versions[-1][0]
    t.delete(spark.createDataFrame([(i,) for i in range(50)], "id long"))
    assert rows(t.read()) == {}


def test_untouched_buckets_keep_their_files_and_a_failed_merge_changes_nothing(spark):
    t = KeyedTable(spark, shared_dir(spark), SCHEMA, "id", 16)
    t.upsert(spark.range(200).select("id", F.lit("a").alias("name"), F.lit(1).alias("n")))
    before, known = rows(t.read()), files(t.read())
    t.patch(spark.createDataFrame([(7, 5)], "id long, n int"))
    assert len(known - files(t.read())) == 1 and len(known & files(t.read())) == len(known) - 1
    version, now = t.manifest()[0], rows(t.read())
    assert now == before | {7: ("a", 5)}
    with pytest.raises(Exception, match="killed"):
        t.merge(spark.range(50).select("id"), lambda old, new: old.withColumn("name", F.when(F.col("id") == 31, F.raise_error(F.lit("killed"))).otherwise("half")))
    assert t.manifest()[0] == version and rows(t.read()) == now
    t.patch(spark.createDataFrame([(8, "b")], "id long, name string"))
    assert rows(t.read()) == now | {8: ("b", 1)}
