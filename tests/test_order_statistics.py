"""Exact ranks of groups in rounds: outliers, ties, clusters at many scales, small groups, more groups than are broadcast."""

import numpy as np
import pytest
from deckloom.operators import order_statistics
from deckloom.operators.order_statistics import distribution
from pyspark.sql import functions as F

SHARES = (0, 5, 50, 99, 100)
RANKS = {f"r{p}": order_statistics.nearest_rank_index(p / 100) for p in SHARES}


def wanted(own, p):
    return own[max(0, min(len(own) - 1, round(p / 100 * len(own)) - 1))]


@pytest.mark.parametrize("groups, most", [(50_000, 1 << 16), (50_000, 100), (2, 100), (50_000, 1)])
def test_ranks_are_exact(spark, monkeypatch, groups, most):
    monkeypatch.setattr(order_statistics, "BROADCAST_GROUPS", groups)
    rng = np.random.default_rng(1)
    values = {
        "even": rng.normal(size=30_000), "outlier": np.append(rng.random(20_000), 1e15), "ties": rng.integers(0, 3, 10_000).astype(float),
        "scales": 10.0 ** rng.uniform(-300, 300, 5_000), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "few": rng.random(37), None: np.arange(500.0),
    }
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for keys in (["k"], []) if most != 1 else (["k"],):
        got = order_statistics.order_statistics(df, keys, "v", RANKS, cells=64, most=most).collect()
        assert len(got) == (len(values) if keys else 1)
        for r in got:
            own = np.sort(values[r.k] if keys else np.concatenate(list(values.values())))
            assert r.n == len(own)
            assert [r[f"r{p}"] for p in SHARES] == [wanted(own, p) for p in SHARES]
    assert distribution(df.filter(F.lit(False)), ["k"], "v", 0.5, "p", 3).count() == 0


def test_no_task_sorts_more_than_a_fixed_number_of_values(spark):
    """A million distinct values in one group, and half of it one value: brackets end small, whatever they began with."""
    df = spark.range(1_000_000).select(F.lit("g").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(0.25)).otherwise(F.expr("pow(id % 999983, 3) / 7")).alias("v"))
    base = df.select("k", F.col("v").alias("__v"))
    found, rounds = order_statistics.brackets(base, ["k"], list(RANKS.values()), order_statistics.CELLS, 5_000)
    row = found.first()
    assert 1 <= rounds <= 3
    assert all(row[f"__is_{k}"] or row[f"__m_{k}"] <= 5_000 for k in range(len(RANKS)))
    own = np.sort(np.array([r.v for r in df.select("v").collect()]))
    got = order_statistics.order_statistics(df, ["k"], "v", RANKS, most=5_000).first()
    assert [got[f"r{p}"] for p in SHARES] == [wanted(own, p) for p in SHARES]
