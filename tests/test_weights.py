"""Estimated match weights against those that made the pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from attesta.operators import weights

TESTS = tuple(f"t{i}" for i in range(9))
M = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.9, 0.75, 0.5])
U = np.array([0.02, 0.1, 0.05, 0.2, 0.3, 0.01, 0.15, 0.05, 0.1])


def planted(n=400_000, share=0.2, seed=3):
    rng = np.random.default_rng(seed)
    match = rng.random(n) < share
    agree = rng.random((n, 9)) < np.where(match[:, None], M, U)
    pattern, count = np.unique((agree << np.arange(9)).sum(axis=1), return_counts=True)
    return dict(zip(pattern.tolist(), count.tolist(), strict=True))


def test_recovers_planted_weights():
    found = weights.estimated(planted(), TESTS)
    assert np.abs(found.m - M).max() < 0.02 and np.abs(found.u - U).max() < 0.02 and abs(found.share - 0.2) < 0.02


def test_scores_and_patterns(spark):
    rows = [("a", "x", "t0"), ("a", "x", "t2"), ("a", "x", "t2"), ("a", "y", "t1"), ("b", "x", "other")]
    pairs = weights.agreement(spark.createDataFrame(rows, "row string, candidate string, test string"), TESTS)
    assert {(r.row, r.candidate): r.pattern for r in pairs.collect()} == {("a", "x"): 5, ("a", "y"): 2}
    assert {(r.pattern, r.n) for r in weights.patterns(pairs).collect()} == {(5, 1), (2, 1)}
    known = weights.Weights(TESTS, M, U, 0.2)
    by_hand = lambda p: sum(np.log2(M[i] / U[i]) if p >> i & 1 else np.log2((1 - M[i]) / (1 - U[i])) for i in range(9))
    for r in pairs.select("pattern", known.score().alias("s"), known.probability().alias("p")).collect():
        assert abs(r.s - by_hand(r.pattern)) < 1e-9 and abs(r.p - 1 / (1 + 4 * 2 ** -by_hand(r.pattern))) < 1e-9
    assert weights.fitted(pairs.limit(0), TESTS).share == 0.5


def test_a_changed_value_is_noticed(spark, tmp_path):
    import pytest

    from attesta.sources import sinks

    df = spark.createDataFrame([(1, "a", None, [1, 2], {"k": 1}), (2, None, "b", [], {}), (2, None, "b", [], {})], "i int, s string, t string, l array<int>, m map<string,int>")
    assert sinks.fingerprint(df) == sinks.fingerprint(df.repartition(3).orderBy(F.desc("i")))
    changed = [df.withColumn("s", F.when(F.col("i") == 1, "c").otherwise(F.col("s"))), df.select("i", F.col("t").alias("s"), F.col("s").alias("t"), "l", "m"), df.dropDuplicates(["i"]), df.withColumn("s", F.coalesce("s", F.lit("")))]
    assert all(sinks.fingerprint(x) != sinks.fingerprint(df) for x in changed)
    path = str(tmp_path / "t")
    assert sinks.write_checked(df, path, df.columns) == 3 and spark.read.parquet(path).count() == 3
    unsteady = df.withColumn("s", F.udf(lambda: str(random.random()), "string").asNondeterministic()())
    with pytest.raises(ValueError):
        sinks.write_checked(unsteady, path, df.columns)
    assert sinks.fingerprint(spark.read.parquet(path)) == sinks.fingerprint(df)
