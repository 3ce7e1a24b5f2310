import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickweave.functions import quantiles


def expected(values, share):
    values = [v for v in values if v is not None and v == v]
    return float(np.quantile(values, share)) if values else None


def close(a, b):
    return (a is None and b is None) or abs(a - b) < 1e-9


@pytest.mark.parametrize("ranked", [1_000_000, 3])
def test_quantiles_of_keys_against_sorting(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantiles, "RANKED", ranked)
    monkeypatch.setattr(quantiles, "RANGES", 8 if ranked == 3 else 512)
    rng, rows = random.Random(1), []
    for key, n, draw in (("A", 3000, lambda: rng.gauss(0, 1)), ("B", 2000, lambda: float(rng.randrange(3))), (None, 57, rng.random), ("one", 1, lambda: 5.0), ("none", 4, lambda: None), ("two", 2, rng.random), ("!", 9, lambda: float("inf"))):
        rows += [(key, draw(), rng.random() if i % 2 else float("nan")) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, x double, y double").repartition(5)
    wanted = {"low": ("x", 0.05), "mid": ("x", 0.5), "top": (F.col("x"), 1.0), "first": ("x", 0.0), "other": ("y", 0.37)}
    got = {r.symbol: r for r in quantiles.exact_quantiles(df, wanted, ("symbol",)).collect()}
    assert len(got) == 7
    for key, row in got.items():
        for name, (_, share) in wanted.items():
            own = [(r[2] if name == "other" else r[1]) for r in rows if r[0] == key]
            if key == "!" and name != "other":
                assert row[name] == float("inf") or np.isnan(row[name])
            else:
                assert close(row[name], expected(own, share)), (key, name)


def test_without_keys_and_rows(spark):
    df = spark.range(1001).select((F.col("id") * 8 % 1001).cast("double").alias("x"))
    assert quantiles.exact_quantiles(df, {"m": ("x", 0.5), "q": ("x", 0.0005)}).first().asDict() == {"m": 500.0, "q": 0.5}
    assert quantiles.exact_quantiles(df.limit(0), {"m": ("x", 0.5)}).first().m is None
    assert quantiles.exact_quantiles(df.limit(0).withColumn("k", F.lit("a")), {"m": ("x", 0.5)}, ("k",)).count() == 0
