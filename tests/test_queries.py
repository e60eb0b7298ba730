"""Every registered query runs; those with SQL equal it on the same tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from meshwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows(names, records):
    return sorted((tuple(plain(r[n]) for n in names) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, [dict(zip(want.columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert Path(__spark_entry__.__file__).exists()


def test_sinks(spark, sf_dir, tmp_path):
    import json

    from meshwork.plans import edition_queries as e
    from meshwork.sources import sinks

    features = catalog.queries()["evidence"](spark, sf_dir).collect()
    drawn = [json.loads(r.feature) for r in features]
    assert drawn and all(d["geometry"]["coordinates"][0][0] == d["geometry"]["coordinates"][0][-1] for d in drawn)
    export = catalog.queries()["csv_export"](spark, sf_dir)
    sinks.write_export(export, f"{tmp_path}/export")
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "export").glob("part-*"))).decode().split("\r\n")[:-1]
    assert lines == [r.line for r in export.orderBy("rank").collect()]
    sinks.write_change_log(f"{tmp_path}/log", e.ordered(spark, sf_dir), e.q_changes(spark, sf_dir), e.q_pair_changes(spark, sf_dir), e.q_counts(spark, sf_dir))
    assert spark.read.parquet(f"{tmp_path}/log/events").count() == e.q_counts(spark, sf_dir).count()
