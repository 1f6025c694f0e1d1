"""Steps that several readers share are made once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import engines, lookup, models
from tidewatch.plans import chains
from tidewatch.streaming import online

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("query", "folds"), [(chains.ledger_admission, 1), (chains.tamper_simulation, 0), (chains.chain_build_verified, 0)])
def test_chains_are_folded_once(spark, query, folds):
    assert plan(query(spark, SF)).count("MapInPandas") == folds


def test_the_ledger_is_laid_out_without_a_join_by_event(spark, monkeypatch):
    got = []
    monkeypatch.setattr(chains, "_laid", {})
    monkeypatch.setattr(lookup, "lay_out", lambda records, path: got.append(records))
    chains.laid_out(spark, SF)
    assert not re.search(r"Join .*event_id", plan(got[0])) and {"resource", "seq", "hash"} <= set(got[0].columns)


def test_stream_and_replay_take_the_same_requests(spark, monkeypatch):
    calls, make = [], chains.requests
    monkeypatch.setattr(chains, "requests", lambda s, d: calls.append(d) or make(s, d))
    monkeypatch.setattr(chains, "decided", lambda s, base: online.replay(s.read.schema(online.REQUEST).parquet(f"{base}/in")))
    assert chains.stream_equals_batch(spark, SF).first()["different"] == 0 and len(calls) == 1


def test_an_engine_scores_its_rows_once(spark):
    net = models.Learning.new([2, 3, 2, 3, 2], np.zeros(2), np.ones(2), np.random.default_rng(0)).net
    rows = spark.range(60).select(F.lit("k").alias("kind"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    forest = models.fit_forest(rows, ["a", "b"], "kind", trees=3, size=20)
    engine = engines.calibrated_on(engines.Engine(forest, net, ("a", "b"), rows), rows)
    got = engines.score(engine, rows)
    assert "EvalPython" not in plan(engine.calibration) and "EvalPython" not in plan(got) and got.count() == 60
