"""Keyed state that outlives a micro-batch: answers to repeats, late rows, velocity by hour buckets, the alert limit.

All are stateful processors of ``transformWithStateInPandas``. Rows of a key come
in pieces (an Arrow batch each) and are put into map state by time slot before
anything is worked out, so a task holds a few slots of a key, never all its rows
of a batch. State lives in RocksDB (``stream_session``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
HOUR = 3600 * SECOND
WEEK = 168 * HOUR
LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, whose streams keep state in RocksDB; the caller's settings stay as they are."""
    other = spark.newSession()
    other.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    return other


def marked(stream: DataFrame, late: str | None = LATE) -> DataFrame:
    """``stream`` with a watermark by ``ts_us`` as ``_ts``."""
    return stream.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", late)


class Answers(StatefulProcessor):
    """The first answer to a transaction is kept and given to its repeats for so long; then it is scored anew.

    A key is a bucket of transactions, as calls to the state for each transaction
    cost far more than its rows. State: time and score of the last answers of a
    bucket. Those that no repeat could ask for any more go with the next rows, or
    by a timer.
    """

    def __init__(self, within_us: int):
        self.within = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "answers string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.exists()
        last = {t: (ts, score) for t, ts, score in json.loads(self.last.get()[0])} if before else {}
        every = pd.concat(list(rows), ignore_index=True)
        every = every[every["ts_us"].notna()].sort_values("ts_us", kind="stable")
        scores = [None if s != s else s for s in every["risk_score"].tolist()]
        out = []
        for name, ts, score in zip(every["transaction_id"].tolist(), every["ts_us"].astype("int64").tolist(), scores):
            held = last.get(name)
            again = held is not None and 0 <= ts - held[0] <= self.within
            if not again:
                held = last[name] = (ts, score)
            out.append((name, ts, held[1], again))
        yield pd.DataFrame(out, columns=["transaction_id", "ts_us", "risk_score", "repeated"]).astype({"risk_score": "float64"})
        self._keep(last, timerValues.getCurrentWatermarkInMs(), before)

    def _keep(self, last: dict, mark_ms: int, before: bool) -> None:
        live = [(t, ts, score) for t, (ts, score) in last.items() if ts + self.within >= mark_ms * 1000]
        if before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if live:
            self.last.update((json.dumps(live),))
            self.handle.registerTimer((max(ts for _, ts, _ in live) + self.within) // 1000 + 1)
        elif before:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


ANSWER = "transaction_id string, ts_us long, risk_score double, repeated boolean"


def answered(stream: DataFrame, seconds: int = 300, late: str = LATE, buckets: int = 2048) -> DataFrame:
    """``transaction_id, ts_us, risk_score, repeated``: each row's answer, the earlier one for a repeat within ``seconds``.

    Times are event times; rows of a transaction should arrive in time order. Of
    rows in one micro-batch the earlier counts first; a task holds those of one of
    ``buckets`` buckets at a time. Rows without a time drop out.
    """
    rows = marked(stream.select("transaction_id", "ts_us", "risk_score"), late).withColumn("_bucket", F.pmod(F.xxhash64("transaction_id"), F.lit(buckets)))
    return rows.groupBy("_bucket").transformWithStateInPandas(Answers(seconds * SECOND), ANSWER, "Append", "EventTime")


class Lateness(StatefulProcessor):
    """Whether a row is behind the stream's own watermark. No state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            yield pd.DataFrame({"event_id": frame["event_id"], "ts_us": frame["ts_us"], "late": frame["ts_us"] // 1000 < mark})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


def with_lateness(stream: DataFrame, late: str = LATE, spread: int = 64) -> DataFrame:
    """``event_id, ts_us, late``: every row of the stream, those behind the watermark of their micro-batch marked and kept.

    Operators with event time drop late rows unseen; here the time column with the
    watermark stays behind, so they arrive, and the watermark is asked for.
    """
    rows = marked(stream.select("event_id", "ts_us"), late).withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(spread))).drop("_ts")
    return rows.groupBy("_part").transformWithStateInPandas(Lateness(), "event_id long, ts_us long, late boolean", "Append", "EventTime")


class Slots:
    """A key's rows by time slot in map state, as bytes of one record type, in order of arrival."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: np.dtype, width: int):
        self.state, self.kind, self.width = handle.getMapState(name, "slot long", "rows binary"), kind, width

    def add(self, rows: np.ndarray, known: set[int]) -> set[int]:
        """Appends; ``known``: slots that have rows, which is all that is read. Returns the slots met."""
        slot = rows["ts"] // self.width
        met = set(np.unique(slot).tolist())
        for s in met:
            before = bytes(self.state.getValue((s,))[0]) if s in known else b""
            self.state.updateValue((s,), (before + rows[slot == s].tobytes(),))
        known |= met
        return met

    def of(self, slot: int, known: set[int]) -> np.ndarray:
        return np.frombuffer(bytes(self.state.getValue((slot,))[0]), self.kind) if slot in known else np.empty(0, self.kind)

    def remove(self, slot: int) -> None:
        self.state.removeKey((slot,))


ROW = np.dtype([("ts", "i8"), ("id", "i8"), ("amount", "f8"), ("risk", "f8"), ("client", "i4"), ("modality", "i1")])
#: Of one client in an hour: rows, sum and number of amounts, risky rows, fiat and crypto rows, first and last time.
TOTAL = np.dtype([("client", "i4"), ("n", "i8"), ("sum", "f8"), ("known", "i8"), ("risky", "i8"), ("fiat", "i8"), ("crypto", "i8"), ("first", "i8"), ("last", "i8")])
MODALITY = {"fiat": 1, "crypto": 2}


def hour_totals(rows: np.ndarray, risk: float) -> np.ndarray:
    out = np.zeros(len(clients := np.unique(rows["client"])), TOTAL)
    for k, c in enumerate(clients):
        r = rows[rows["client"] == c]
        out[k] = (c, len(r), np.nansum(r["amount"]), (~np.isnan(r["amount"])).sum(), (r["risk"] >= risk).sum(), (r["modality"] == 1).sum(), (r["modality"] == 2).sum(), r["ts"].min(), r["ts"].max())
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as in the batch form."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5 + 1e-9) / 10.0**digits


class Part:
    """Some rows in time order with prefix sums: what lies before a time, of all or of one client."""

    def __init__(self, rows: np.ndarray, risk: float):
        self.rows, self.ts = rows, rows["ts"]
        amount = rows["amount"]
        values = {"n": np.ones(len(rows)), "sum": np.nan_to_num(amount), "known": ~np.isnan(amount), "risky": rows["risk"] >= risk, "fiat": rows["modality"] == 1, "crypto": rows["modality"] == 2}
        self.sums = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in values.items()}
        self.clients: dict[int, Part] = {}

    def upto(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.sums[name][at]

    def of(self, client: int, risk: float) -> Part:
        if client not in self.clients:
            self.clients[client] = Part(self.rows[self.rows["client"] == client], risk)
        return self.clients[client]


class Velocity(StatefulProcessor):
    """Velocity, baseline and cross-client features of an identity's rows from hour buckets.

    State by hour: the rows, and totals by client with how many rows have been
    answered. A window of whole hours that ends at a row in hour h is the rows of h
    up to it, totals of the hours between, and rows of the one hour in which it
    begins: at most five hours' rows are in memory, whatever the identity. Hours
    older than a week go; an idle identity goes by a timer. An identity of at most
    ``FEW`` rows, a micro-batch's included, isn't cut by hours: its rows are one
    value, as calls to the state for each hour cost far more than the rows.
    """

    FEW = 1000

    SPANS = {"1h": (HOUR, 1), "6h": (6 * HOUR, 6), "24h": (24 * HOUR, 24), "7d": (WEEK - 1, 168)}

    def __init__(self, risk: float = 0.70, idle_days: int = 90):
        self.risk, self.idle = risk, idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = Slots(handle, "rows", ROW, HOUR)
        self.totals = handle.getMapState("totals", "slot long", "answered long, totals binary")
        self.kept = handle.getValueState("kept", "clients string, rows binary, cut boolean")

    def _records(self, frame: pd.DataFrame, clients: dict[str, int]) -> np.ndarray:
        out = np.zeros(len(frame), ROW)
        out["ts"], out["id"] = frame["ts_us"], frame["event_id"]
        out["amount"], out["risk"] = frame["amount_usd"].astype(float), frame["risk_score"].astype(float)
        out["client"] = [clients.setdefault("" if c is None else c, len(clients)) for c in frame["client_id"]]
        out["modality"] = [MODALITY.get(m, 0) for m in frame["modality"]]
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get() if self.kept.exists() else None
        clients: dict[str, int] = json.loads(kept[0]) if kept else {}
        old, cut = (np.frombuffer(bytes(kept[1]), ROW), kept[2]) if kept else (np.empty(0, ROW), False)
        named = len(clients) if cut else -1
        done = {s[0]: (int(v[0]), np.frombuffer(bytes(v[1]), TOTAL)) for s, v in self.totals.iterator()} if cut else {}
        known, met, few = set(done), set(), []
        for frame in rows:
            frame = frame[frame["ts_us"].notna()]
            if not len(frame):
                continue
            few.append(self._records(frame, clients))
            if not cut and len(old) + sum(map(len, few)) > self.FEW:
                cut = True
                for slot in self.slots.add(old, known):
                    held = self.slots.of(slot, known)
                    done[slot] = (len(held), hour_totals(held, self.risk))
                    self.totals.updateValue((slot,), (len(held), done[slot][1].tobytes()))
            if cut:
                for new in few:
                    met |= self.slots.add(new, known)
                few = []
        if few:
            fresh = np.concatenate(few)
            every = np.concatenate([old, fresh])
            yield self._features_of_few(key[0], fresh[np.lexsort((fresh["id"], fresh["ts"]))], every[np.lexsort((every["id"], every["ts"]))], len(clients))
            newest = int(every["ts"].max()) // HOUR
            self.kept.update((json.dumps(clients), every[every["ts"] // HOUR >= newest - 168].tobytes(), False))
            self._wait(newest, kept is not None)
            return
        if not met:
            return
        if len(clients) > named:
            self.kept.update((json.dumps(clients), b"", True))
        for slot in met:
            done[slot] = (done[slot][0] if slot in done else 0, hour_totals(self.slots.of(slot, known), self.risk))
        order = sorted(done)
        every = np.concatenate([done[s][1] for s in order])
        of_slot = np.repeat(np.array(order, np.int64), [len(done[s][1]) for s in order])
        cache: dict[int, Part] = {}

        def part(slot: int) -> Part:
            if slot not in cache:
                if len(cache) >= 8:
                    del cache[min(cache)]
                held = self.slots.of(slot, known)
                cache[slot] = Part(held[np.lexsort((held["id"], held["ts"]))], self.risk)
            return cache[slot]

        for slot in sorted(met):
            answered_, totals = done[slot]
            held = self.slots.of(slot, known)
            fresh = held[answered_:]
            yield self._features_in_slot(key[0], fresh[np.lexsort((fresh["id"], fresh["ts"]))], slot, part, (of_slot, every), len(clients))
            done[slot] = (len(held), totals)
            self.totals.updateValue((slot,), (len(held), totals.tobytes()))
        newest = max(done)
        for slot in [s for s in done if s < newest - 168]:
            self.totals.removeKey((slot,))
            self.slots.remove(slot)
        self._wait(newest, kept is not None)

    def _wait(self, newest: int, before: bool) -> None:
        """The timer of an idle identity, in place of an earlier one."""
        if before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + 1) * (HOUR // 1000) + self.idle)

    def _features_of_few(self, identity, fresh: np.ndarray, every: np.ndarray, n_clients: int) -> pd.DataFrame:
        now, risk, whole = fresh["ts"], self.risk, Part(every, self.risk)

        def within(name: str, width: int, hours: int, side: str, client: int | None = None) -> np.ndarray:
            rows = whole if client is None else whole.of(client, risk)
            return rows.upto(name, np.searchsorted(rows.ts, now, side)) - rows.upto(name, np.searchsorted(rows.ts, now - width, "left"))

        def last(client: int) -> np.ndarray:
            ts = whole.of(client, risk).ts
            at = np.searchsorted(ts, now, "left")
            found = np.where(at > 0, np.append(ts, 0)[np.maximum(at - 1, 0)], -1)
            return np.where(found >= now - WEEK, found, -1)

        return self._features(identity, fresh, n_clients, within, whole.ts[np.searchsorted(whole.ts, now - (WEEK - 1), "left")], last)

    def _features_in_slot(self, identity, fresh: np.ndarray, slot: int, part, totals: tuple[np.ndarray, np.ndarray], n_clients: int) -> pd.DataFrame:
        now, risk = fresh["ts"], self.risk
        here = part(slot)

        def between(hours: int) -> np.ndarray:
            """Totals by client of the whole hours within a window of so many."""
            low, high = np.searchsorted(totals[0], [slot - hours + 1, slot])
            some, out = totals[1][low:high], np.zeros(n_clients, TOTAL)
            for f in ("n", "sum", "known", "risky", "fiat", "crypto"):
                out[f] = np.bincount(some["client"], some[f], n_clients)
            out["first"], out["last"] = np.iinfo(np.int64).max, -1
            np.minimum.at(out["first"], some["client"], some["first"])
            np.maximum.at(out["last"], some["client"], some["last"])
            return out

        middle = {hours: between(hours) for hours in {1, 6, 24, 168}}

        def within(name: str, width: int, hours: int, side: str, client: int | None = None) -> np.ndarray:
            """Sum over the window of ``width`` up to each row (``side`` right: peers counted)."""
            low, top = part(slot - hours), here
            mid = middle[hours][name].sum() if client is None else middle[hours][name][client]
            if client is not None:
                low, top = low.of(client, risk), top.of(client, risk)
            begin = np.searchsorted(low.ts, now - width, "left")
            return low.upto(name, np.full(len(now), len(low.ts))) - low.upto(name, begin) + mid + top.upto(name, np.searchsorted(top.ts, now, side))

        low = part(slot - 168)
        begin = np.searchsorted(low.ts, now - (WEEK - 1), "left")
        first = np.minimum(middle[168]["first"].min(initial=np.iinfo(np.int64).max), here.ts[0])
        first = np.where(begin < len(low.ts), np.append(low.ts, 0)[np.minimum(begin, len(low.ts))], first)

        def last(client: int) -> np.ndarray:
            """The last row of this client: in this hour, in the hours between, or in the one where the week begins."""
            top, old = here.of(client, risk).ts, low.of(client, risk).ts
            at = np.searchsorted(top, now, "left")
            found = np.where(at > 0, np.append(top, 0)[np.maximum(at - 1, 0)], middle[168]["last"][client])
            oldest = old[-1] if len(old) else -1
            return np.where(found >= 0, found, np.where(oldest >= now - WEEK, oldest, -1))

        return self._features(identity, fresh, n_clients, within, first, last)

    def _features(self, identity, fresh: np.ndarray, n_clients: int, within, first: np.ndarray, last) -> pd.DataFrame:
        """``within``: sums over windows; ``first``: the first time of each row's 7 days; ``last``: of a client, its last time of a week before each row, or -1."""
        now = fresh["ts"]
        out: dict[str, np.ndarray] = {"event_id": fresh["id"], "identity": np.full(len(now), identity), "ts_us": now}
        for name, (width, hours) in self.SPANS.items():
            out[f"count_{name}"] = within("n", width, hours, "right").astype(np.int64)
            out[f"sum_{name}"] = np.where(within("known", width, hours, "right") > 0, rounded(within("sum", width, hours, "right"), 2), np.nan)
        days = np.maximum((now - first) / (24 * HOUR), 1.0)
        out["baseline_rate"] = rounded(out["count_7d"] / days, 4)
        known = within("known", WEEK - 1, 168, "right")
        out["baseline_amount"] = np.where(known > 0, rounded(within("sum", WEEK - 1, 168, "right") / np.maximum(known, 1) + 1e-9, 2), np.nan)
        out["velocity_ratio"] = rounded(out["count_24h"] / np.maximum(out["baseline_rate"], 0.1), 3)
        out["amount_ratio"] = rounded(fresh["amount"] / np.fmax(out["baseline_amount"], 1.0), 3)
        # Prior rows of 7 days and of an hour: all of the identity, less those of the own client.
        n, total, risky = (within(f, WEEK, 168, "left") for f in ("n", "sum", "risky"))
        recent, own = within("n", HOUR, 1, "left"), fresh["client"]
        institutions, gap = np.zeros(len(now), np.int64), np.full(len(now), np.nan)
        for c in range(n_clients):
            mine, count = own == c, within("n", WEEK, 168, "left", c)
            institutions += count > 0
            n, total, risky = n - mine * count, total - mine * within("sum", WEEK, 168, "left", c), risky - mine * within("risky", WEEK, 168, "left", c)
            recent = recent - mine * within("n", HOUR, 1, "left", c)
            before = last(c)
            gap = np.fmin(gap, np.where((before >= 0) & ~mine, (now - before) / 1e6, np.nan))
        mean = total / np.maximum(n, 1)
        close = np.nan_to_num(np.clip(1 - np.abs(fresh["amount"] - mean) / np.maximum(mean, 1.0), 0.0, 1.0))
        out["institution_count"], out["cross_client_velocity"] = institutions, recent.astype(np.int64)
        out["amount_correlation"] = rounded(np.where(n > 0, close, 0.0), 4)
        out["time_since_other_institution_sec"] = rounded(gap, 1)
        for kind in ("fiat", "crypto"):
            out[f"has_{kind}_history"] = (within(kind, WEEK, 168, "left") > 0).astype(int)
        out["cross_modal_pattern_detected"] = out["has_fiat_history"] * out["has_crypto_history"]
        out["prior_high_risk"] = (risky > 0).astype(int)
        return pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.slots.state, self.totals, self.kept):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


VELOCITY = """event_id long, identity long, ts_us long, count_1h long, sum_1h double, count_6h long, sum_6h double, count_24h long, sum_24h double, count_7d long, sum_7d double,
baseline_rate double, baseline_amount double, velocity_ratio double, amount_ratio double, institution_count int, cross_client_velocity long, amount_correlation double,
time_since_other_institution_sec double, has_fiat_history int, has_crypto_history int, cross_modal_pattern_detected int, prior_high_risk int"""


def streaming_velocity(events: DataFrame, late: str = LATE) -> DataFrame:
    """Velocity, baseline and cross-client features of each arriving row, equal to the batch windows for rows in time order.

    ``events``: ``event_id, identity, client_id, modality, amount_usd,
    risk_score, ts_us``. Rows more than ``late`` behind the watermark drop out
    (see ``with_lateness``).
    """
    return marked(events, late).groupBy("identity").transformWithStateInPandas(Velocity(), VELOCITY, "Append", "EventTime")


def greedy(times: list[int], ts: int, most: int, width: int) -> tuple[list[int], bool]:
    """Accepted times still within the window, and whether one more at ``ts`` is accepted."""
    live = [t for t in times if t > ts - width]
    return (live + [ts], True) if len(live) < most else (live, False)


ALERT = np.dtype([("ts", "i8"), ("id", "i8")])
LIMITED = "channel string, alert_id long, ts_us long, accepted boolean"


class Limit(StatefulProcessor):
    """The rolling alert limit of a channel. State: the accepted times of one window; a batch's rows go through time slots, so they are taken in time order a slot at a time."""

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times string")
        self.slots = Slots(handle, "waiting", ALERT, self.width)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times: list[int] = json.loads(self.times.get()[0]) if self.times.exists() else []
        known: set[int] = set()
        for frame in rows:
            new = np.zeros(len(frame), ALERT)
            new["ts"], new["id"] = frame["ts_us"], frame["alert_id"]
            self.slots.add(new, known)
        for slot in sorted(known):
            waiting = np.sort(self.slots.of(slot, known), order=["ts", "id"])
            accepted = []
            for ts in waiting["ts"].tolist():
                times, ok = greedy(times, ts, self.most, self.width)
                accepted.append(ok)
            self.slots.remove(slot)
            yield pd.DataFrame({"channel": key[0], "alert_id": waiting["id"], "ts_us": waiting["ts"], "accepted": accepted})
        self.times.update((json.dumps(times),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


def alert_limit(alerts: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """At most ``most`` accepted alerts of a channel in any rolling window, in time order, over a stream."""
    return alerts.groupBy("channel").transformWithStateInPandas(Limit(most, seconds * SECOND), LIMITED, "Append", "None")


def busy_spells(alerts: DataFrame, width: int) -> DataFrame:
    """``alerts`` with ``spell``: stretches of a channel without a gap of ``width`` or more.

    The rolling limit's state is empty after such a gap, so spells are limited one by
    one. Gaps are found between the slots of ``width`` that hold alerts, of which
    there are few, never by sorting a channel's rows.
    """
    from pyspark.sql import Window

    from ..operators.joins import lookup
    from ..sources.storage import saved

    slot = F.floor(F.col("ts_us") / F.lit(width)).cast("long")
    used = alerts.groupBy("channel", slot.alias("slot")).agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"))
    order = Window.partitionBy("channel").orderBy("slot")
    cut = used.withColumn("_cut", (F.col("low") - F.lag("high").over(order) >= width).cast("int"))
    spells = saved(cut.select("channel", "slot", F.sum(F.coalesce("_cut", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("spell")), "spells")
    return alerts.withColumn("slot", slot).join(lookup(spells), ["channel", "slot"]).drop("slot")


def alert_limit_table(alerts: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """The rolling limit over a table (``channel, alert_id, ts_us``): every busy spell of a channel is a task's sorted run of rows, held a batch at a time."""
    width = seconds * SECOND
    keys = ["channel", "spell"]
    placed = busy_spells(alerts.select("channel", "alert_id", "ts_us"), width).repartition(*keys).sortWithinPartitions(*keys, "ts_us", "alert_id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for frame in frames:
            accepted = []
            for channel, spell, ts in zip(frame["channel"], frame["spell"], frame["ts_us"].tolist()):
                if (channel, spell) != last:
                    last, times = (channel, spell), []
                times, ok = greedy(times, ts, most, width)
                accepted.append(ok)
            yield frame[["channel", "alert_id", "ts_us"]].assign(accepted=accepted)

    return placed.mapInPandas(work, LIMITED)
