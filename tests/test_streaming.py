"""Streams run to their end over files, held against the batch forms."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import windows as W
from riskweave.sources import bindings as B
from riskweave.streaming import processors as P
from riskweave.streaming import stateful as T

DATA = "/root/testdata/sf0.001"


def run(stream, out, mode="append"):
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return f"{out}/rows"


FIELDS = ["event_id", "identity", "client_id", "amount_usd", "ts_us", "modality", "risk_score"]


def in_batches(df, out, n=3):
    """Files in time order, a micro-batch each."""
    cut = df.withColumn("q", F.ntile(n).over(Window.orderBy("ts_us")))
    for i in range(n):
        cut.where(F.col("q") == i + 1).drop("q").coalesce(1).write.parquet(f"{out}/part{i}")


def test_velocity_parity(spark, tmp_path):
    """With an identity that holds a third of all rows, its rows dense in time, and null amounts."""
    batch = B.txn(spark, DATA).select(*FIELDS)
    hot = F.col("event_id") % 3 == 0
    batch = batch.withColumns({"identity": F.when(hot, -1).otherwise(F.col("identity")), "amount_usd": F.when(F.col("event_id") % 11 > 0, F.col("amount_usd"))})
    in_batches(batch, str(tmp_path / "in"))
    s = P.stream_session(spark).readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = spark.read.parquet(run(P.streaming_velocity(s), str(tmp_path / "out"))).toPandas().set_index("event_id").sort_index()
    want = W.prior_high_risk(W.time_since_other_client(W.cross_client(W.baseline(W.velocity(batch))))).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(want)
    for c in got.columns:
        if c not in ("identity", "ts_us"):
            a, b = got[c].astype(float), want[c].astype(float)
            assert ((a - b).abs().fillna(0) < 0.002).all() and (a.isna() == b.isna()).all(), c


def test_velocity_holds_few_hours(spark, monkeypatch):
    """However many rows an identity has, features are worked out from the rows of an hour and of the hours in which windows begin."""
    import numpy as np

    held = []
    plain = P.Part.__init__
    monkeypatch.setattr(P.Part, "__init__", lambda self, rows, risk: (held.append(len(rows)), plain(self, rows, risk))[1])
    state = {}

    class Map:
        def __init__(self): self.d = {}
        def getValue(self, k): return self.d[k]
        def updateValue(self, k, v): self.d[k] = v
        def removeKey(self, k): self.d.pop(k, None)
        def iterator(self): return iter(list(self.d.items()))
        def exists(self): return "v" in self.d
        def get(self): return self.d["v"]
        def update(self, v): self.d["v"] = v

    class Handle:
        def getMapState(self, name, *_): return state.setdefault(name, Map())
        getValueState = getMapState
        def listTimers(self): return []
        def registerTimer(self, t): pass

    p = P.Velocity()
    p.init(Handle())
    n, rng = 6000, np.random.default_rng(1)
    import pandas as pd

    rows = pd.DataFrame({"event_id": range(n), "ts_us": np.sort(rng.integers(0, 400 * P.HOUR, n)), "client_id": rng.choice(list("abc"), n), "modality": "fiat", "amount_usd": 1.0, "risk_score": 0.1})
    out = pd.concat(p.handleInputRows((1,), iter(np.array_split(rows, 7)), None))
    assert len(out) == n and max(held) < 60
    assert len(state["rows"].d) <= 169 and set(state["rows"].d) == set(state["totals"].d)


class Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.n, self.states = 0, {}

    def state(self, name, *_):
        outer = self

        class State(dict):
            def exists(self): outer.n += 1; return "v" in self
            def get(self): outer.n += 1; return self["v"]
            def update(self, v): outer.n += 1; self["v"] = v
            def getValue(self, k): outer.n += 1; return self[k]
            def updateValue(self, k, v): outer.n += 1; self[k] = v
            def removeKey(self, k): outer.n += 1; self.pop(k, None)
            def iterator(self): outer.n += 1; return iter(list(self.items()))

        return self.states.setdefault(name, State())

    getMapState = getValueState = state

    def listTimers(self): self.n += 1; return []
    def deleteTimer(self, t): self.n += 1
    def registerTimer(self, t): self.n += 1


def test_velocity_of_few_rows_asks_little_of_the_state(spark):
    """An identity of few rows costs a few calls a batch, however many hours they lie in; its features are those by hours, also once it has grown."""
    import numpy as np
    import pandas as pd

    n, rng = 1500, np.random.default_rng(2)
    rows = pd.DataFrame({"event_id": range(n), "ts_us": np.sort(rng.integers(0, 900 * P.HOUR, n)), "client_id": rng.choice(list("abc"), n), "modality": rng.choice(["fiat", "crypto"], n), "amount_usd": rng.random(n) * 100, "risk_score": rng.random(n)})
    rows.loc[::9, "amount_usd"] = np.nan
    batches = [rows[:300], rows[300:400], rows[400:]]  # the last is more than FEW

    def over(p, calls):
        p.init(calls)
        out = []
        for i, b in enumerate(batches):
            out.append(pd.concat(p.handleInputRows((1,), iter([b[:150], b[150:]]), None)))
            assert i == 2 or p.FEW == 0 or calls.n <= 6 * (i + 1)
        return pd.concat(out).sort_values("event_id").reset_index(drop=True)

    few, slots = P.Velocity(), P.Velocity()
    slots.FEW = 0
    a, b = over(few, Calls()), over(slots, Calls())
    assert len(a) == n
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-3, rtol=0)


def test_answers_of_a_bucket_are_one_value(spark):
    """Many transactions cost a few calls to the state; of a batch's rows the earlier counts first, in whatever pieces they come; answers too old go."""
    import pandas as pd

    class Times:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    frame = lambda rows: pd.DataFrame(rows, columns=["transaction_id", "ts_us", "risk_score"])
    calls, p = Calls(), P.Answers(300 * P.SECOND)
    p.init(calls)
    late = frame([(f"t{i}", (400 + i) * P.SECOND, 0.3) for i in range(1000)])
    early = frame([(f"t{i}", (i + d) * P.SECOND, 0.1 + d / 1000) for i in range(1000) for d in (0, 100)])
    got = pd.concat(p.handleInputRows((7,), iter([late, early]), Times(0)))
    assert len(got) == 3000 and got["repeated"].sum() == 1000 and calls.n <= 4
    again = pd.concat(p.handleInputRows((7,), iter([frame([("t999", 1500 * P.SECOND, 0.9), (None, 1500 * P.SECOND, None)])]), Times(1200_000)))
    assert again[["transaction_id", "risk_score", "repeated"]].values.tolist()[0] == ["t999", 0.3, True] and again["risk_score"].isna().sum() == 1
    assert "t400" not in calls.states["last"]["v"][0] and "t999" in calls.states["last"]["v"][0]


def test_repeats_are_answered_over_batches(spark, tmp_path):
    rows = [[("a", 0, 0.1), ("b", 5, 0.2)], [("a", 299, 0.9), ("b", 400, 0.7), ("c", 401, 0.5)], [("a", 301, 0.8), ("b", 450, 0.6), ("a", 350, 0.3)]]
    for i, part in enumerate(rows):
        spark.createDataFrame([(k, (t + 1000) * P.SECOND, x) for k, t, x in part], "transaction_id string, ts_us long, risk_score double").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    s = P.stream_session(spark).readStream.schema("transaction_id string, ts_us long, risk_score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted((r[0], r[1] // P.SECOND - 1000, r[2], r[3]) for r in spark.read.parquet(run(P.answered(s), str(tmp_path / "out"))).collect())
    assert got == [("a", 0, 0.1, False), ("a", 299, 0.1, True), ("a", 301, 0.8, False), ("a", 350, 0.8, True), ("b", 5, 0.2, False), ("b", 400, 0.7, False), ("b", 450, 0.7, True), ("c", 401, 0.5, False)]


def test_late_rows_of_a_running_stream(spark, tmp_path):
    for i, part in enumerate([[(1, 0), (2, 5000)], [(3, 4000), (4, 4500), (5, 9000)], [(6, 8300), (7, 8500)]]):
        spark.createDataFrame([(k, t * P.SECOND) for k, t in part], "event_id long, ts_us long").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    s = P.stream_session(spark).readStream.schema("event_id long, ts_us long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r["event_id"]: r["late"] for r in spark.read.parquet(run(P.with_lateness(s), str(tmp_path / "out"))).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}


def test_node_store(spark, tmp_path):
    """Three batches, one repeated, one broken off: the store equals the totals of all rows."""
    from riskweave.operators import graph as G

    out = str(tmp_path / "store")
    t = B.txn(spark, DATA).select(F.col("identity").alias("src"), F.col("receiver").alias("dst"), F.col("amount_usd").alias("amount"), "ts_us")
    parts, write = [t.where(F.col("ts_us") % 3 == i) for i in range(3)], T.node_store(out, 5)
    write(parts[0], 0)
    write(parts[1], 1)
    write(parts[1], 1)
    G.node_totals(parts[2], exact=True).withColumns({"bucket": F.lit(1), "of": F.lit(1)}).write.partitionBy("of").parquet(f"{out}/store/batch=2")  # no mark: it broke off
    write(parts[2], 2)
    schema = G.node_totals(t, exact=True).withColumn("bucket", F.lit(0)).schema
    got = {r["id"]: tuple(r)[1:] for r in T.stored_nodes(spark, out, schema).select("id", "txn_count", "total_volume", "first_seen", "last_seen").collect()}
    assert got == {r["id"]: tuple(r)[1:] for r in G.node_totals(t, exact=True).collect()}


def test_greedy_limit_of_one_channel(spark, tmp_path):
    """Over the table cut at idle gaps, and over a stream of several batches: equal to the plain loop on a single channel."""
    import random

    rng, at, rows = random.Random(6), 0, []
    for i in range(1500):
        at += rng.choice([0, 1, 5, 20]) if i % 40 else rng.choice([59, 60, 61, 500])
        rows.append(("only", i, at * P.SECOND))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "channel string, alert_id long, ts_us long")
    times, want = [], {}
    for _, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        times, want[i] = P.greedy(times, ts, 4, 60 * P.SECOND)
    assert 0 < sum(want.values()) < len(want)
    assert {r["alert_id"]: r["accepted"] for r in P.alert_limit_table(df, 4, 60).collect()} == want
    assert P.busy_spells(df, 60 * P.SECOND).select("spell").distinct().count() > 20
    for i, (low, high) in enumerate(((0, 500), (500, 1000), (1000, 1500))):  # alerts of one time come together
        df.where(F.col("alert_id").between(low, high - 1)).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    s = P.stream_session(spark).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r["alert_id"]: r["accepted"] for r in spark.read.parquet(run(P.alert_limit(s, 4, 60), str(tmp_path / "out"))).collect()}
    assert got == want


def test_greedy_limit():
    times, accepted = [], []
    for ts in [*range(0, 59_000_000, 59_000_000 // 31), 61_000_000]:
        times, ok = P.greedy(times, ts, 30, 60_000_000)
        accepted.append(ok)
    assert sum(accepted[:31]) == 30 and accepted[-1]


def test_duplicates_and_fan_out(spark, tmp_path):
    s = B.scored(spark, DATA).select("transaction_id", "decision", F.col("ts").cast("timestamp").alias("ts"))
    s.unionByName(s).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.duplicate_guard(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(T.fan_out(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    results, alerts = spark.read.parquet(str(tmp_path / "out/results")), spark.read.parquet(str(tmp_path / "out/alerts"))
    assert results.count() == s.count() and alerts.count() == s.where("decision <> 'approve'").count()


def test_interval_join(spark, tmp_path):
    t = B.txn(spark, DATA).select("transaction_id", "identity", "modality", F.col("ts").cast("timestamp").alias("ts"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda m: spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")).where(f"modality = '{m}'")
    got = spark.read.parquet(run(T.interval_join(read("fiat"), read("crypto")), str(tmp_path / f"out{uuid.uuid4().hex}"))).count()
    from riskweave.operators.joins import fiat_crypto_pairs

    assert got == fiat_crypto_pairs(B.txn(spark, DATA)).count()
