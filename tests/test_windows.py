"""Boundary rules of the time windows on rows written by hand."""

import random

from riskweave.operators import windows as W
from riskweave.sources.storage import saved

H = W.HOUR
T = 1_700_000_000_000_000


def frame(spark, rows):
    full = [(i, r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else 0.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, identity long, client_id string, ts_us long, amount_usd double, risk_score double").selectExpr("*", "CASE WHEN client_id = 'b' THEN 'crypto' ELSE 'fiat' END AS modality", "event_id % 2 AS receiver")


def last(df, column):
    return df.orderBy("event_id").collect()[-1][column]


def test_bounds(spark):
    rows = [(1, "a", T - 168 * H, 1.0), (1, "a", T - 168 * H + 1, 1.0), (1, "a", T - 24 * H, 1.0), (1, "a", T - H, 1.0), (1, "a", T, 1.0)]
    r = W.velocity(frame(spark, rows)).orderBy("event_id").collect()[-1]
    assert (r["count_7d"], r["count_24h"], r["count_1h"]) == (4, 3, 2)


def test_build_up(spark):
    df = frame(spark, [(1, "a", T + i * 120_000_000, 500.0) for i in range(5)])
    r = W.velocity(df).orderBy("event_id").collect()[-1]
    assert r["count_1h"] == 5 and r["sum_1h"] == 2500.0
    assert last(W.baseline(df), "velocity_ratio") == 1.0


def test_first_event(spark):
    df = frame(spark, [(1, "a", T, 5.0)])
    r = W.cross_client(df).first()
    assert (r["institution_count"], r["cross_client_velocity"], r["cross_modal_pattern_detected"], r["amount_correlation"]) == (0, 0, 0, 0.0)
    assert W.time_since_other_client(df).first()["time_since_other_institution_sec"] is None


def test_cross_modal(spark):
    df = frame(spark, [(1, "a", T, 5.0), (1, "b", T + 900_000_000, 5.0), (1, "a", T + 1_000_000_000, 5.0)])
    r = W.cross_client(df).orderBy("event_id").collect()
    assert [(x["has_fiat_history"], x["has_crypto_history"]) for x in r] == [(0, 0), (1, 0), (1, 1)]
    assert r[1]["cross_client_velocity"] == 1
    assert W.time_since_other_client(df).orderBy("event_id").collect()[1]["time_since_other_institution_sec"] == 900.0
    assert [x["cross_modal_pattern_detected"] for x in W.cross_client(df, include_current=True).orderBy("event_id").collect()] == [0, 1, 1]


def test_ties_are_peers(spark):
    df = frame(spark, [(1, "a", T, 5.0), (1, "b", T, 5.0)])
    assert {x["count_1h"] for x in W.velocity(df).collect()} == {2}
    assert {x["cross_client_velocity"] for x in W.cross_client(df).collect()} == {0}


def test_islands(spark):
    df = frame(spark, [(1, c, T + i * 1_000_000, 1.0) for i, c in enumerate("AABBA")])
    got = [x["time_since_other_institution_sec"] for x in W.time_since_other_client(df).orderBy("event_id").collect()]
    assert got == [None, None, 1.0, 2.0, 1.0]


def test_one_exchange(spark):
    plan = W.cross_client(frame(spark, [(1, "a", T, 5.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranges_carry_a_hot_identity(spark):
    """One identity with all rows: cut into ranges, each a part of the rows, and equal to the plain windows."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, 1 if i % 50 else 2, rng.choice("aaaab" if i < 1500 else "c"), float(i % 7) if i % 9 else None, rng.randrange(40) * W.HOUR * 6 + rng.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, identity long, client_id string, amount_usd double, ts_us long")
    of = lambda d, *c: sorted(tuple(r) for r in d.select("event_id", *c).collect())
    gap = "time_since_other_institution_sec"
    assert of(W.time_since_other_client_ranges(df), gap) == of(W.time_since_other_client(df), gap)
    life = ("lifetime_count", "lifetime_volume", "lifetime_amount_ratio")
    got, want = of(W.lifetime_ranges(df), *life), of(W.lifetime(df), *life)
    assert [g for g, w in zip(got, want) if g != w and w[2] is not None] == []
    sizes = saved(df.repartitionByRange(4, "identity", "ts_us", "event_id").withColumn("_range", F.spark_partition_id()), "r").groupBy("_range").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 2000
