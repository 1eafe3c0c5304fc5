"""Each catalog query against its SQL on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from tessitura.plans import registry, registry_more, registry_pages, registry_text, registry_updates  # noqa: F401  the others add their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6) + 0.0
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(rows(got.astype(object)), rows(want.astype(object)), strict=True) if a != b]
    if bad:  # types of equal values may differ between the engines: 1 and 1.0
        cols = sorted(got.columns)
        key = lambda f: f[cols].astype(str).replace(r"\.0$", "", regex=True).sort_values(cols).reset_index(drop=True)
        assert key(got.round(6)).equals(key(want.round(6))), bad[:3]


def test_every_query_without_sql_runs(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.queries()[name](spark, SF).count() > 0
