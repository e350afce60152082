"""Every query of the library beside its SQL, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from vetra import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got = registry.queries()[name](spark, SF).toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    want = sql.sql(registry.oracle_sql()[name]).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stream_equals_the_fold(spark):
    from pyspark.sql import functions as F

    from vetra.plans.catalog import _millis
    from vetra.streaming import sessions

    got = {(r.session, r.seq): tuple(r)[2:] for r in registry.queries()["stream_stop_decisions"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string"), "event_id", _millis("ts"), "event_type", F.col("value") > 10)
    want = {r[:2]: r[2:] for r in sessions.fold([tuple(r) for r in e.collect()], window=3600 * 1000)}
    assert got == want


def test_ordered_streams_equal_plain_loops(spark):
    from vetra.plans import source_catalog

    rows = [tuple(r) for r in source_catalog.task_events(spark, SF).collect()]
    assert sorted(map(tuple, registry.queries()["stop_evaluations"](spark, SF).collect())) == sorted(source_catalog.evaluated(rows))
    assert sorted(map(tuple, registry.queries()["task_states"](spark, SF).collect())) == sorted(source_catalog.followed(rows))
