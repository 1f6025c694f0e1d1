"""Queries against their SQL on the smallest tables, where these are there."""

import numbers
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("event_type_classify", "feature_row_full", "feature_row_in_chunks", "window_counts_1h_1d_7d", "userday_rollup", "ecdf_by_type_with_fallback", "roc_auc", "best_f1_threshold", "policy_permit_first_match", "source_merge_places", "tamper_found", "laid_out_by_principal", "laid_out_by_resource", "chain_verify", "band_lookup_range_join", "insider_ranking_topk")


def test_each_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def tidy(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "null" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
