"""Queries: model preparation, scoring, measures, gates, streaming forms in batch mode."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import graph as G
from ..operators import learning as L
from ..operators import metrics as E
from ..operators import windows as W
from ..operators.aggregates import newest_us
from ..operators.ordering import champion, temporal_split
from ..sources import bindings as B
from ..sources.storage import saved, shared_folder
from ..streaming import processors as P
from ..streaming import stateful as T
from . import features as _features_first  # noqa: F401  its SQL is used below
from .catalog import ORACLE_SQL, query

WEIGHTS, BIAS = {"amount_usd": 0.02, "count_24h": 0.3, "institution_count": 0.4, "balance_drain_ratio": 1.5}, -2.0


def _rows(spark, d):
    t = B.txn(spark, d)
    return t.select("event_id", "is_fraud", "amount_usd", (F.col("k") % 9).cast("double").alias("count_24h"), (F.col("k") % 4).cast("double").alias("institution_count"), (F.col("k") / F.lit(100).cast("double")).alias("balance_drain_ratio"), "risk_score", "client_id", "modality", "event_type", "ts_us")


_ROWS = f"{B.TXN}, r AS (SELECT event_id, is_fraud, amount_usd, (k % 9)::DOUBLE AS count_24h, (k % 4)::DOUBLE AS institution_count, k / 100::DOUBLE AS balance_drain_ratio, risk_score FROM txn)"
_CURVE = """g AS (SELECT {keys} s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {part}) AS pos, sum(n) OVER (PARTITION BY {part}) AS neg FROM g WINDOW w AS (PARTITION BY {part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
_D = f"{B.TXN}, d AS (SELECT risk_score AS s, is_fraud AS y FROM txn), " + _CURVE.format(keys="1 AS one,", part="one")


@query("m1_one_hot", f"""WITH {B.TXN}, v AS (SELECT DISTINCT event_type FROM txn WHERE event_id % 2 = 0)
SELECT event_id, (event_type = 'click')::INTEGER AS event_type_click, (event_type = 'error')::INTEGER AS event_type_error, (event_type = 'purchase')::INTEGER AS event_type_purchase, (event_type = 'signup')::INTEGER AS event_type_signup, (event_type = 'view')::INTEGER AS event_type_view FROM txn""")
def m1(spark, d):
    t = B.txn(spark, d).select("event_id", "event_type")
    return L.one_hot(t, t.where("event_id % 2 = 0"), ["event_type"])


@query("m2_category_index", f"""WITH {B.TXN}, c AS (SELECT event_id, coalesce(CASE WHEN event_id % 6 <> 0 THEN client_id END, 'missing') AS v FROM txn), i AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS code FROM c GROUP BY v)
SELECT event_id, code::DOUBLE AS code FROM c JOIN i USING (v)""")
def m2(spark, d):
    from pyspark.ml.feature import StringIndexer

    t = B.txn(spark, d).select("event_id", F.coalesce(F.when(F.col("event_id") % 6 != 0, F.col("client_id")), F.lit("missing")).alias("v"))
    return StringIndexer(inputCol="v", outputCol="code", handleInvalid="keep").fit(t).transform(t).select("event_id", "code")


NUMERIC = ["amount_usd", "count_24h", "risk_score"]


def _splits(spark, d):
    s = temporal_split(_rows(spark, d), "ts_us", "event_id")
    return s.where("split = 'train'"), s.where("split <> 'train'")


_NUMERIC_SQL = "amount_usd", "count_24h", "risk_score"


@query("m3_standardised", f"""WITH {B.TXN}, r AS (SELECT event_id, amount_usd, (k % 9)::DOUBLE AS count_24h, risk_score, row_number() OVER (ORDER BY ts_us, event_id) - 1 AS pos, count(*) OVER () AS n FROM txn),
s AS (SELECT {', '.join(f'avg({c}) AS mean_{c}, stddev_samp({c}) AS dev_{c}' for c in _NUMERIC_SQL)} FROM r WHERE pos < floor(n * 0.8))
SELECT event_id, {', '.join(f'round(({c} - mean_{c}) / dev_{c}, 6) AS {c}' for c in _NUMERIC_SQL)} FROM r, s WHERE pos >= floor(n * 0.8)""")
def m3(spark, d):
    """Later rows in units of the training rows' mean and deviation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train, later = _splits(spark, d)
    x = vector_to_array(F.col("x"))
    made = Pipeline(stages=L.preparation(NUMERIC, [])).fit(train).transform(later)
    return made.select("event_id", *(F.round(x[i], 6).alias(c) for i, c in enumerate(NUMERIC)))


@query("m3_m4_m9_logistic_scores")
def m4(spark, d):
    train, test = _splits(spark, d)
    return L.scored_by(L.train(train, "logistic", NUMERIC, ["client_id", "modality"], "is_fraud", maxIter=30), test).select("event_id", "p")


@query("m5_boosted_scores")
def m5(spark, d):
    train, test = _splits(spark, d)
    return L.scored_by(L.train(train, "boosted", NUMERIC, ["client_id"], "is_fraud", maxIter=5, maxDepth=3), test).select("event_id", "p")


@query("m6_m7_tournament")
def m7(spark, d):
    """A forest, boosted trees and four random draws (with few trees); their rows are prepared and written once, trials run side by side."""
    train, test = _splits(spark, d)
    return L.tournament(train, test, _candidates(), NUMERIC, [], "is_fraud", sample=200_000)


def _candidates():
    fixed = {"forest": ("forest", {"numTrees": 5, "maxDepth": 3, "seed": 1}), "boosted": ("boosted", {"maxIter": 3, "maxDepth": 3, "seed": 1})}
    return {**fixed, **L.scaled_down(L.search_space(4), 3)}


@query("m9_kept_model", f"WITH {_ROWS}, n AS (SELECT count(*) AS n FROM r), o AS (SELECT event_id, row_number() OVER (ORDER BY ts_us, event_id) - 1 AS pos FROM txn) SELECT event_id, true AS same_score, true AS same_decision FROM o, n WHERE pos >= floor(n * 0.8)")
def m9(spark, d):
    """A model with its threshold and columns is kept, loaded as its newest version and scores the later rows as the fitted one does."""
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    train, later = _splits(spark, d)
    train, later = saved(train, "train"), saved(later, "later")
    kept = L.kept_model(train, later, "logistic", NUMERIC, ["client_id", "modality"], "is_fraud", maxIter=20)
    kept.save(folder)
    loaded = L.KeptModel.load(spark, folder)
    fitted = L.scored_by(kept.model, later).select("event_id", F.col("p").alias("q"))
    both = loaded.score(later).hint("merge").join(fitted, "event_id")
    return both.select("event_id", (F.col("p") == F.col("q")).alias("same_score"), (F.col("flagged") == (F.col("q") >= kept.threshold)).alias("same_decision"))


#: Runs of the tournament, measured on validation rows, stand for a tracker's; their measures have no SQL form.
@query("k15_m8_runs")
def k15r(spark, d):
    """The tournament's champion, and whether the best draw would replace the forest."""
    train, test = _splits(spark, d)
    runs = saved(L.tournament(train, test, _candidates(), NUMERIC, [], "is_fraud", sample=200_000), "runs")
    best = champion(runs, "pr_auc").select("champion", F.col("pr_auc").alias("champion_pr_auc"))
    return best.join(F.broadcast(L.promotion(runs, "forest", "draw_0").withColumnsRenamed({"champion": "forest", "challenger": "draw_0"})))  # a row on either side


@query("m16_importance")
def m16(spark, d):
    train, _ = _splits(spark, d)
    return L.importance(L.train(train, "logistic", NUMERIC, ["client_id"], "is_fraud", maxIter=20), train)


_RUNS = f"{B.TXN}, runs AS (SELECT client_id AS run, round(avg(risk_score), 6) AS pr_auc FROM txn GROUP BY client_id)"


def _runs(spark, d):
    return B.txn(spark, d).groupBy(F.col("client_id").alias("run")).agg(F.round(F.avg("risk_score"), 6).alias("pr_auc"))


@query("k15_champion", f"WITH {_RUNS} SELECT run AS champion, pr_auc FROM runs ORDER BY pr_auc DESC, run LIMIT 1")
def k15(spark, d):
    return champion(_runs(spark, d), "pr_auc")


@query("m8_promotion", f"""WITH {_RUNS}, x AS (SELECT max(pr_auc) FILTER (run = 'neobank') AS champion, max(pr_auc) FILTER (run = 'cryptoex') AS challenger FROM runs)
SELECT champion, challenger, challenger >= champion AS promote_trained, challenger - champion > 0.005 AS promote_live FROM x""")
def m8(spark, d):
    return L.promotion(_runs(spark, d), "neobank", "cryptoex")


@query("m10_average_precision", f"WITH {_D} SELECT round(sum(p / pos * (tp / (tp + fp))), 6) AS average_precision FROM c")
def m10(spark, d):
    return E.average_precision(B.txn(spark, d), "risk_score", "is_fraud")


@query("m11_roc_auc", f"WITH {_D} SELECT round(sum(p * (neg - fp + n / 2)) / (any_value(pos) * any_value(neg)), 6) AS roc_auc FROM c")
def m11(spark, d):
    return E.roc_auc(B.txn(spark, d), "risk_score", "is_fraud")


_RATES = """round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 6) AS f1,
  round(5 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (4 * (tp / (tp + fp + 1e-9)) + tp / (tp + fn + 1e-9) + 1e-9), 6) AS f2, round((tp + tn) / (tp + fp + fn + tn + 1e-9), 6) AS accuracy, round(fp / (fp + tn + 1e-9), 6) AS fpr, round(fn / (fn + tp + 1e-9), 6) AS fnr"""


@query("m12_confusion", f"""WITH {B.TXN}, x AS (SELECT count(*) FILTER (risk_score >= 0.6 AND is_fraud = 1) AS tp, count(*) FILTER (risk_score >= 0.6 AND is_fraud = 0) AS fp, count(*) FILTER (risk_score < 0.6 AND is_fraud = 1) AS fn, count(*) FILTER (risk_score < 0.6 AND is_fraud = 0) AS tn FROM txn)
SELECT tp, fp, fn, tn, {_RATES} FROM x""")
def m12(spark, d):
    return E.confusion(B.txn(spark, d), "risk_score", "is_fraud", 0.6)


@query("m13_precision_at_recall", f"WITH {_D} SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM c WHERE tp >= 0.90 * pos ORDER BY s DESC LIMIT 1")
def m13(spark, d):
    return E.at_recall(B.txn(spark, d), "risk_score", "is_fraud")


@query("m14_j13_f2_threshold", f"""WITH {B.TXN}, t AS (SELECT round(0.05 + i * 0.01, 2)::DOUBLE AS threshold FROM range(90) r(i)),
x AS (SELECT threshold, count(*) FILTER (floor(risk_score * 100 + 1e-9) >= round(threshold * 100) AND is_fraud = 1) AS tp, count(*) FILTER (floor(risk_score * 100 + 1e-9) >= round(threshold * 100) AND is_fraud = 0) AS fp, count(*) FILTER (floor(risk_score * 100 + 1e-9) < round(threshold * 100) AND is_fraud = 1) AS fn FROM txn, t GROUP BY threshold),
f AS (SELECT threshold, round(5 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (4 * (tp / (tp + fp + 1e-9)) + tp / (tp + fn + 1e-9) + 1e-9), 6) AS f2 FROM x)
SELECT threshold, f2 FROM f ORDER BY f2 DESC, threshold LIMIT 1""")
def m14(spark, d):
    return E.best_threshold(B.txn(spark, d), "risk_score", "is_fraud")


_STEP = f"{B.TXN}, e AS (SELECT event_id % 7 + 1 AS step, risk_score AS s, is_fraud AS y FROM txn), d AS (SELECT e.* FROM e WHERE step IN (SELECT step FROM e GROUP BY step HAVING count(*) FILTER (y = 1) >= 5 AND count(*) FILTER (y = 0) >= 5)), " + _CURVE.format(keys="step,", part="step")
_STEPS = _STEP + ", steps AS (SELECT step, round(sum(p / pos * (tp / (tp + fp))), 6) AS average_precision, round(sum(p * (neg - fp + n / 2)) / (any_value(pos) * any_value(neg)), 6) AS roc_auc, CASE WHEN step <= 3 THEN 'early' ELSE 'late' END AS period FROM c GROUP BY step)"


def _steps(spark, d):
    return E.by_step(B.txn(spark, d).withColumn("step", F.col("event_id") % 7 + 1), "risk_score", "is_fraud", "step", early=3)


@query("m15_metrics_by_step", f"WITH {_STEPS} SELECT * FROM steps")
def m15(spark, d):
    return _steps(spark, d)


@query("m15_step_drift", f"""WITH {_STEPS}, m AS (SELECT avg(average_precision) FILTER (period = 'early') AS e, avg(average_precision) FILTER (period = 'late') AS l FROM steps)
SELECT round(e, 4) AS early, round(l, 4) AS late, (SELECT step FROM steps ORDER BY average_precision DESC, step LIMIT 1) AS best_step, (SELECT step FROM steps ORDER BY average_precision, step LIMIT 1) AS worst_step, CASE WHEN e - l > 0.05 THEN 'strong' WHEN e - l > 0.02 THEN 'mild' ELSE 'none' END AS drift FROM m""")
def m15d(spark, d):
    return E.step_drift(_steps(spark, d))


_CONTRIB = f"""{_ROWS}, u AS (SELECT event_id, risk_score, unnest(['amount_usd', 'count_24h', 'institution_count', 'balance_drain_ratio']) AS feature,
  unnest([round(0.02 * (amount_usd - 50), 6), round(0.3 * (count_24h - 4), 6), round(0.4 * (institution_count - 1.5), 6), round(1.5 * (balance_drain_ratio - 0.5), 6)]::DOUBLE[]) AS contribution FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(contribution) DESC, feature) AS n FROM u)"""
_MEANS = {"amount_usd": 50.0, "count_24h": 4.0, "institution_count": 1.5, "balance_drain_ratio": 0.5}


@query("m17_k7_explanations", f"WITH {_CONTRIB} SELECT event_id, max(feature) FILTER (n = 1) AS first, max(feature) FILTER (n = 2) AS second FROM o WHERE risk_score > 0.70 OR event_id % 5 = 0 GROUP BY event_id")
def m17(spark, d):
    r = _rows(spark, d).where("risk_score > 0.70 OR event_id % 5 = 0")
    top = D.top_contributions(L.contributions(r, WEIGHTS, _MEANS), 2)
    return r.select("event_id", top.alias("t")).select("event_id", F.col("t")[0]["feature"].alias("first"), F.col("t")[1]["feature"].alias("second"))


@query("m18_flag_summary", f"""WITH {B.TXN} SELECT count(*) FILTER (risk_score >= 0.9) AS at_90, count(*) FILTER (risk_score >= 0.8) AS at_80, count(*) FILTER (risk_score >= 0.7) AS at_70, count(*) FILTER (risk_score >= 0.5) AS at_50,
  count(*) FILTER (risk_score >= 0.85) AS high, count(*) FILTER (risk_score >= 0.70 AND k % 2 = 1) AS flagged_adjacent FROM txn""")
def m18(spark, d):
    return E.flag_summary(B.txn(spark, d).withColumn("has_illicit_neighbour", F.col("k") % 2), "risk_score")


@query("m18_flag_rate_by_step", f"WITH {B.TXN} SELECT event_id % 49 AS step, count(*) AS n, round(avg((risk_score >= 0.70)::INTEGER), 6) AS flag_rate FROM txn GROUP BY step ORDER BY flag_rate DESC, step LIMIT 10")
def m18b(spark, d):
    return E.flag_rate_by_step(B.txn(spark, d).withColumn("step", F.col("event_id") % 49), "risk_score", "step")


SCORER = {
    "amount_usd": 0.01, "count_1h": 0.15, "count_6h": 0.05, "count_24h": 0.1, "velocity_ratio": 0.12, "amount_ratio": 0.2, "balance_drain_ratio": 1.5, "is_first_time_receiver": 0.8,
    "sender_account_age_days": -0.0005, "sender_lifetime_txn_count": -0.01, "fan_in_ratio": 0.3, "receiver_in_degree": 0.05, "sender_out_degree": 0.04,
}
SCORER_BIAS = -3.5
_MADE = {
    "amount_usd": "amount_usd", "count_1h": "k % 5", "count_6h": "k % 9", "count_24h": "k % 17", "velocity_ratio": "(k % 13) / {two}", "amount_ratio": "amount_usd / {fifty}", "balance_drain_ratio": "k / {hundred}", "is_first_time_receiver": "k % 2",
    "sender_account_age_days": "k * 10", "sender_lifetime_txn_count": "identity % 40", "fan_in_ratio": "(receiver % 7) / {three}", "receiver_in_degree": "receiver % 11", "sender_out_degree": "identity % 20",
}
_NUMBERS = {"two": 2, "three": 3, "fifty": 50, "hundred": 100}


def _features(spark, d):
    """Model inputs made of whole-table columns."""
    numbers = {k: f"CAST({v} AS DOUBLE)" for k, v in _NUMBERS.items()}
    return B.txn(spark, d).select("event_id", "is_fraud", *(F.expr(f"CAST({e.format(**numbers)} AS DOUBLE)").alias(c) for c, e in _MADE.items()))


_FEATURES = f"{B.TXN}, r AS (SELECT event_id, is_fraud, " + ", ".join(f"({e.format(**{k: f'{v}::DOUBLE' for k, v in _NUMBERS.items()})})::DOUBLE AS {c}" for c, e in _MADE.items()) + " FROM txn)"


def _logit(values: dict[str, str]) -> str:
    """SQL of the linear score, in the order in which the operator sums."""
    z = f"({SCORER_BIAS}::DOUBLE)"
    for c, w in SCORER.items():
        z = f"({z} + {values.get(c, c)} * ({w}::DOUBLE))"
    return f"1 / (1 + exp(-{z}))"


def _strategy_sql() -> str:
    out = []
    for name, sets in E.STRATEGIES.items():
        values = {c: "(SELECT m FROM legit)" if v == E.LEGIT else f"{v}::DOUBLE" for c, v in sets.items()}
        out.append(f"SELECT '{name}' AS strategy, {_logit(values)} AS p, sender_out_degree AS o, fan_in_ratio AS f, sender_account_age_days AS a FROM r WHERE is_fraud = 1")
    return " UNION ALL ".join(out)


@query("m19_red_team", f"""WITH {_FEATURES}, legit AS (SELECT quantile_cont(balance_drain_ratio, 0.5) AS m FROM r WHERE is_fraud = 0), p AS ({_strategy_sql()}),
g AS (SELECT strategy, count(*) AS n, round(avg((p < 0.5)::INTEGER), 6) AS evasion_rate, avg(p) AS m, round(avg(o) FILTER (p >= 0.5), 4) AS caught_sender_out_degree, round(avg(o) FILTER (p < 0.5), 4) AS evaded_sender_out_degree,
  round(avg(f) FILTER (p >= 0.5), 4) AS caught_fan_in_ratio, round(avg(f) FILTER (p < 0.5), 4) AS evaded_fan_in_ratio, round(avg(a) FILTER (p >= 0.5), 4) AS caught_sender_account_age_days, round(avg(a) FILTER (p < 0.5), 4) AS evaded_sender_account_age_days FROM p GROUP BY strategy)
SELECT * EXCLUDE (m), round(m, 6) AS mean_score, round((SELECT m FROM g WHERE strategy = 'baseline') - m, 6) AS score_drop FROM g""")
def m19(spark, d):
    return E.red_team(_features(spark, d), SCORER, SCORER_BIAS)


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


def _drift_sql() -> str:
    out = []
    for name, sets in E.DRIFTS.items():
        values = {}
        for c, v in sets.items():
            low, high = v if isinstance(v, tuple) else (v, v)
            u = f"{_hash_sql('event_id', repr(name), repr(c))} / 4294967296::DOUBLE"
            values[c] = f"(floor({u} * {high - low}) + {low})::DOUBLE" if isinstance(high, int) else f"({u} * {high - low!r}::DOUBLE + {low!r}::DOUBLE)"
        out.append(f"SELECT '{name}' AS scenario, event_id, rank, n, own, round({_logit(values)}, 9) AS new FROM pairs")
    return " UNION ALL ".join(out)


_MIX = f"""{_FEATURES}, legit AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql('event_id')}, event_id) - 1 AS at, count(*) OVER () AS legits, round({_logit({})}, 9) AS score FROM r WHERE is_fraud = 0),
bad AS (SELECT event_id, row_number() OVER (ORDER BY {_hash_sql('event_id')}, event_id) - 1 AS rank, count(*) OVER () AS n, round({_logit({})}, 9) AS own FROM r WHERE is_fraud = 1),
pairs AS (SELECT bad.event_id, rank, n, own, {', '.join(f'legit.{c}' for c in SCORER)} FROM bad JOIN legit ON bad.rank % (SELECT max(legits) FROM legit) = legit.at),
drifted AS ({_drift_sql()}), f AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0]::DOUBLE[]) AS fraction),
d AS (SELECT scenario, fraction, CASE WHEN rank < floor(n * fraction + 1e-9) THEN new ELSE own END AS s, 1 AS y FROM drifted, f UNION ALL SELECT scenario, fraction, score, 0 FROM legit, f, (SELECT DISTINCT scenario FROM drifted)),
""" + _CURVE.format(keys="scenario, fraction,", part="scenario, fraction") + """,
ap AS (SELECT scenario, fraction, round(sum(p / pos * (tp / (tp + fp))), 6) AS average_precision FROM c GROUP BY scenario, fraction),
mix AS (SELECT scenario, fraction, average_precision, round(100 * (b - average_precision) / b, 4) AS drop_percent FROM ap JOIN (SELECT scenario, average_precision AS b FROM ap WHERE fraction = 0) USING (scenario))"""


def _mix(spark, d):
    return E.drift_mix(_features(spark, d), "event_id", "is_fraud", SCORER, SCORER_BIAS)


@query("m20_drift_mix", f"WITH {_MIX} SELECT * FROM mix")
def m20(spark, d):
    return _mix(spark, d)


@query("m20_drift_alerts", f"""WITH {_MIX} SELECT scenario, min(fraction) FILTER (drop_percent >= 5) AS first_fraction, round(max(average_precision) FILTER (fraction = 0) * 0.95, 4) AS alert_at, round(max(average_precision) FILTER (fraction = 0) * 0.90, 4) AS critical_at FROM mix GROUP BY scenario""")
def m20a(spark, d):
    return E.drift_alerts(_mix(spark, d))


@query("m21_drop_pivot", f"WITH {_MIX} SELECT scenario, " + ", ".join(f"max(drop_percent) FILTER (fraction = {f}::DOUBLE) AS f_{round(100 * f)}" for f in E.FRACTIONS) + " FROM mix GROUP BY scenario")
def m21(spark, d):
    return E.drop_pivot(_mix(spark, d))


def _z_sql(c: str) -> str:
    return f"sqrt(-2 * ln(({_hash_sql('event_id', repr(c), '42', '1')} + 1) / 4294967297::DOUBLE)) * cos(6.283185307179586::DOUBLE * {_hash_sql('event_id', repr(c), '42', '2')} / 4294967296::DOUBLE)"


@query("m22_noise", f"""WITH {B.TXN}, r AS (SELECT event_id, is_fraud, amount_usd, k AS count_1h, hour(ts)::DOUBLE AS hour_of_day, (isodow(ts) - 1)::DOUBLE AS day_of_week, 3.0::DOUBLE AS velocity_ratio, event_type AS transfer_type, CASE event_id % 3 WHEN 0 THEN 'elliptic_real' WHEN 1 THEN 'simulator' END AS source FROM txn),
c AS (SELECT *, is_fraud = 1 AND coalesce(source <> 'elliptic_real', true) AS chosen FROM r), sd AS (SELECT stddev_pop(amount_usd) AS a, stddev_pop(count_1h) AS k FROM c WHERE chosen),
p AS (SELECT event_id, row_number() OVER (ORDER BY {_hash_sql('event_id', '42')}, event_id) - 1 AS pos, count(*) OVER () AS n FROM c WHERE chosen), flips AS (SELECT event_id FROM p WHERE pos < floor(n * 0.1::DOUBLE + 1e-9))
SELECT event_id, round(CASE WHEN chosen THEN greatest(amount_usd + {_z_sql('amount_usd')} * 0.2::DOUBLE * a, 0) ELSE amount_usd END, 4) AS amount_usd, CASE WHEN chosen THEN trunc(greatest(count_1h + {_z_sql('count_1h')} * 0.2::DOUBLE * sd.k, 0))::BIGINT ELSE count_1h END AS count_1h,
  round(CASE WHEN chosen THEN least(greatest(hour_of_day + {_z_sql('hour_of_day')} * 3.0::DOUBLE, 0), 23) ELSE hour_of_day END, 4) AS hour_of_day, round(CASE WHEN chosen THEN least(greatest(day_of_week + {_z_sql('day_of_week')} * 1.0::DOUBLE, 0), 6) ELSE day_of_week END, 4) AS day_of_week, velocity_ratio,
  CASE WHEN event_id IN (SELECT event_id FROM flips) THEN ['ach', 'wire', 'p2p', 'rtp'][({_hash_sql('event_id', "'transfer_type'")} % 4 + 1)::INTEGER] ELSE transfer_type END AS transfer_type FROM c, sd""")
def m22(spark, d):
    t, i = B.txn(spark, d), F.col("event_id")
    source = F.when(i % 3 == 0, "elliptic_real").when(i % 3 == 1, "simulator")
    r = t.select("event_id", "is_fraud", "amount_usd", F.col("k").alias("count_1h"), F.hour("ts").cast("double").alias("hour_of_day"), F.weekday("ts").cast("double").alias("day_of_week"), F.lit(3.0).alias("velocity_ratio"), F.col("event_type").alias("transfer_type"), source.alias("source"))
    n = E.with_noise(r, "event_id")
    return n.select("event_id", *(F.round(c, 4).alias(c) for c in ("amount_usd", "hour_of_day", "day_of_week")), "count_1h", "velocity_ratio", "transfer_type")


#: A gate for every receiver: labels and drift of its own rows. All severities and decisions occur.
_GATES = f"""{B.TXN}, g AS (SELECT receiver, count(*) AS new_labels, max(k) % 21 AS age_days, CASE receiver % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'none' END AS psi, CASE WHEN avg(risk_score) < 0.40 THEN 'critical' WHEN avg(risk_score) < 0.42 THEN 'high' ELSE 'none' END AS auc,
  CASE WHEN max(k) % 21 >= 14 THEN 'critical' ELSE 'none' END AS age, receiver % 7 = 3 AS force, receiver % 5 = 2 AS dry FROM txn GROUP BY receiver),
s AS (SELECT *, CASE WHEN 'critical' IN (psi, auc, age) THEN 'critical' WHEN 'high' IN (psi, auc, age) THEN 'high' WHEN 'medium' IN (psi, auc, age) THEN 'medium' ELSE 'none' END AS severity FROM g)"""


def _gates(spark, d):
    k, r, low = F.max("k") % 21, F.col("receiver"), F.avg("risk_score")
    g = B.txn(spark, d).groupBy("receiver").agg(F.count(F.lit(1)).alias("new_labels"), k.alias("age_days"), F.when(low < 0.40, "critical").when(low < 0.42, "high").otherwise("none").alias("auc"))
    psi = F.when(r % 4 == 0, "medium").when(r % 4 == 1, "high").otherwise("none")
    return g.withColumns({"psi": psi, "severity": D.drift_severity(psi, F.col("auc"), D.age_severity(F.col("age_days"))), "force": r % 7 == 3, "dry": r % 5 == 2})


@query("m23_drift_severity", f"WITH {_GATES} SELECT receiver, severity FROM s")
def m23(spark, d):
    return _gates(spark, d).select("receiver", "severity")


@query("m24_retrain_gate", f"""WITH {_GATES} SELECT receiver, CASE WHEN NOT force AND new_labels < 60 THEN 'waiting' WHEN NOT force AND severity = 'medium' THEN 'scheduled' WHEN NOT force AND severity = 'none' THEN 'stable' WHEN dry THEN 'dry_run' ELSE 'retrain' END AS decision FROM s""")
def m24(spark, d):
    return _gates(spark, d).select("receiver", D.retrain_gate(F.col("new_labels"), F.col("severity"), F.col("dry"), F.col("force"), 60).alias("decision"))


@query("m25_auc_drop", f"WITH {B.TXN}, g AS (SELECT receiver, avg(risk_score) AS auc FROM txn GROUP BY receiver) SELECT receiver, CASE WHEN 0.45 - auc > 0.10 THEN 'critical' WHEN 0.45 - auc > 0.05 THEN 'high' ELSE 'none' END AS verdict FROM g")
def m25(spark, d):
    g = B.txn(spark, d).groupBy("receiver").agg(F.avg("risk_score").alias("auc"))
    return g.select("receiver", D.auc_drop(F.col("auc"), F.lit(0.45)).alias("verdict"))


def _stream(spark, d):
    """The events' files as a stream. A pattern, as a stream reads folders or patterns, and the table may be one file."""
    return B.txn_of(spark.readStream.schema(B.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]"))


_BATCH_FEATURES = ["count_1h", "sum_1h", "count_6h", "sum_6h", "count_24h", "sum_24h", "count_7d", "sum_7d", "baseline_rate", "baseline_amount", "velocity_ratio", "amount_ratio", "institution_count", "cross_client_velocity", "amount_correlation", "time_since_other_institution_sec", "has_fiat_history", "has_crypto_history", "cross_modal_pattern_detected", "prior_high_risk"]


@query("st1_stateful_velocity", "WITH " + ", ".join(f"x{i} AS ({ORACLE_SQL[n]})" for i, n in enumerate(("w1_velocity", "w2_w4_baseline", "w5_w9_cross_client", "w8_time_since_other_client", "w10_prior_high_risk"))) + f" SELECT event_id, {', '.join(_BATCH_FEATURES)} FROM x0 JOIN x1 USING (event_id) JOIN x2 USING (event_id) JOIN x3 USING (event_id) JOIN x4 USING (event_id)")
def st1(spark, d):
    """A stream over the table's files, run to its end."""
    found = P.streaming_velocity(_stream(P.stream_session(spark), d).select("event_id", "identity", "client_id", "modality", "amount_usd", "risk_score", "ts_us"))
    return spark.read.schema(found.schema).parquet(T.run_to_end(found, shared_folder(spark))).select("event_id", *_BATCH_FEATURES)


@query("st1_embeddings", f"""WITH {B.TXN} SELECT t.event_id, (v.vec_id IS NOT NULL)::INTEGER AS embedding_hit, round(coalesce(v.embedding[1]::DOUBLE, 0), 6) AS first FROM txn t LEFT JOIN embeddings v ON t.identity = v.vec_id""")
def st1e(spark, d):
    both = T.with_embeddings(_stream(spark, d).select("event_id", "identity"), B.nodes_vec(spark, d), 64).select("event_id", "embedding_hit", F.round(F.col("embedding")[0], 6).alias("first"))
    return spark.read.schema(both.schema).parquet(T.run_to_end(both, shared_folder(spark)))


@query("st4_duplicate_guard", f"WITH {B.TXN} SELECT transaction_id FROM txn")
def st4(spark, d):
    """Every event arrives twice."""
    once = _stream(spark, d).select("transaction_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = T.duplicate_guard(once.unionByName(once)).select("transaction_id")
    return spark.read.schema(kept.schema).parquet(T.run_to_end(kept, shared_folder(spark)))


#: An event arrives again 100 s later (answered as before) and 400 s later (scored anew), each time with another score.
_REPEATS = ((0, 0.0), (100, 0.125), (400, 0.25))


@query("st4_answered_repeats", f"""WITH {B.TXN} SELECT transaction_id, ts_us + x.after * 1000000 AS ts_us, round(risk_score + x.score, 6) AS risk_score, x.again AS repeated
FROM txn, (VALUES (0, 0.0::DOUBLE, false), (100, 0.0::DOUBLE, true), (400, 0.25::DOUBLE, false)) x(after, score, again)""")
def st4a(spark, d):
    """The repeat within 300 s gets the first answer, a later one its own."""
    once, rows = _stream(P.stream_session(spark), d).select("transaction_id", "ts_us", "risk_score"), None
    for after, more in _REPEATS:
        part = once.select("transaction_id", (F.col("ts_us") + after * 1_000_000).alias("ts_us"), (F.col("risk_score") + more).alias("risk_score"))
        rows = part if rows is None else rows.unionByName(part)
    found = P.answered(rows)
    return spark.read.schema(found.schema).parquet(T.run_to_end(found, shared_folder(spark))).withColumn("risk_score", F.round("risk_score", 6))


@query("st5_graph_batches", f"""WITH {B.EDGES_TXN}, b AS (SELECT src AS id, amount, ts_us FROM edges UNION ALL SELECT dst, amount, ts_us FROM edges)
SELECT id, count(*) AS txn_count, round(sum(amount::DECIMAL(18,4))::DOUBLE, 2) AS total_volume, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM b GROUP BY id""")
def st5(spark, d):
    """The events in three parts, about a micro-batch each, added to the stored totals."""
    out = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    t = B.txn(spark, d).select(F.col("identity").alias("src"), F.col("receiver").alias("dst"), F.col("amount_usd").alias("amount"), "ts_us")
    for part in range(3):
        t.where(F.col("ts_us") % 3 == part).write.parquet(f"{out}/in/part={part}")
    files = max(1, len(spark.read.parquet(f"{out}/in").inputFiles()) // 3)
    edges = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/in/*")
    T.run_to_end(edges, out, T.node_store(f"{out}/nodes"))
    totals = G.node_totals(t, exact=True).withColumn("bucket", F.lit(0)).schema
    n = T.stored_nodes(spark, f"{out}/nodes", totals)
    return n.select("id", "txn_count", F.round(F.col("total_volume").cast("double"), 2).alias("total_volume"), "first_seen", "last_seen")


#: The rolling limit as a recursion over each channel's alerts in time order, with the accepted times of the last hour.
_GREEDY = f"""WITH RECURSIVE {B.TXN}, a AS MATERIALIZED (SELECT client_id AS channel, event_id AS alert_id, ts_us, row_number() OVER (PARTITION BY client_id ORDER BY ts_us, event_id) AS n FROM txn WHERE risk_score >= 0.30),
walk(channel, n, alert_id, ts_us, times, accepted) AS (
  SELECT channel, n, alert_id, ts_us, [ts_us], true FROM a WHERE n = 1
  UNION ALL
  SELECT a.channel, a.n, a.alert_id, a.ts_us, CASE WHEN len(x.live) < 3 THEN list_append(x.live, a.ts_us) ELSE x.live END, len(x.live) < 3
  FROM walk w JOIN a ON a.channel = w.channel AND a.n = w.n + 1, LATERAL (SELECT [t FOR t IN w.times IF t > a.ts_us - 3600000000] AS live) x
) SELECT channel, alert_id, ts_us, accepted FROM walk"""


def _alerts(t):
    return t.where("risk_score >= 0.30").select(F.col("client_id").alias("channel"), F.col("event_id").alias("alert_id"), "ts_us")


@query("st6_alert_limit_greedy", _GREEDY)
def st6g(spark, d):
    """The rolling limit as a running stream, alerts of a client as its channel; 3 in any hour, so that it is met at this table's rate."""
    limited = P.alert_limit(_alerts(_stream(P.stream_session(spark), d)), 3, 3600)
    return spark.read.schema(limited.schema).parquet(T.run_to_end(limited, shared_folder(spark)))


@query("st6_alert_limit_spells", _GREEDY)
def st6s(spark, d):
    """The same over the table, every channel cut where it is idle for an hour."""
    return P.alert_limit_table(_alerts(B.txn(spark, d)), 3, 3600)


@query("st7_io8_fan_out", f"""WITH {B.SCORED} SELECT 'alerts' AS sink, transaction_id FROM scored WHERE decision IN ('block', 'review') UNION ALL SELECT 'results', transaction_id FROM scored UNION ALL SELECT 'analytics', transaction_id FROM scored""")
def st7(spark, d):
    out = f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    scored = _stream(spark, d).select("transaction_id", D.decide(F.col("risk_score"), 0.30, 0.80).alias("decision"))
    T.run_to_end(scored, out, T.fan_out(out))
    parts = [spark.read.schema(scored.schema).parquet(f"{out}/{sink}/batch=*").select(F.lit(sink).alias("sink"), "transaction_id") for sink in ("results", "alerts", "analytics")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("st8_embedding_refresh", f"WITH RECURSIVE {B.NODES_VEC}, {B.EDGES_VEC}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst), walk(id, distance) AS (SELECT id, 0 FROM nodes WHERE step = (SELECT max(step) FROM nodes) UNION SELECT u.dst, distance + 1 FROM walk JOIN u ON walk.id = u.src WHERE distance < 2) SELECT DISTINCT id, 16::BIGINT AS size, 0.0::DOUBLE AS error FROM walk JOIN nodes USING (id)")
def st8(spark, d):
    """The nodes of the newest step arrive as a stream, their features doubled since the projection was kept; new embeddings of their
    two-hop neighbourhood are written. ``error``: the largest distance from the whole graph worked out anew by the same projection."""
    out = f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}"
    nodes, edges = B.nodes_vec(spark, d), B.edges_vec(spark, d)
    G.propagated_embeddings(edges, nodes, 16, projections=f"{out}/projections")
    newest = newest_us(nodes, "step")
    changed = nodes.withColumn("features", F.when(F.col("step") == newest, F.transform("features", lambda x: 2 * x)).otherwise(F.col("features")))
    rows = spark.readStream.schema(B.table(spark, d, "embeddings").schema).parquet(f"{d}/embeddings.parque[t]").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 49 + 1).alias("step"))
    T.run_to_end(rows.where(F.col("step") == newest), out, T.refresh_embeddings(f"{out}/store", changed, edges, f"{out}/projections"))
    whole = G.projected(G.load_projection(spark, f"{out}/projections"), G.hop_features(edges, changed)).withColumnRenamed("embedding", "whole")
    both = spark.read.schema("id long, embedding array<double>, batch int").parquet(f"{out}/store").hint("merge").join(whole, "id")
    error = F.aggregate(F.zip_with("embedding", "whole", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y))
    return both.select("id", F.size("embedding").cast("long").alias("size"), F.round(error, 6).alias("error"))


@query("st9_interval_join", f"""WITH {B.TXN} SELECT f.identity, f.transaction_id AS fiat_id, c.transaction_id AS crypto_id FROM txn f JOIN txn c ON f.identity = c.identity AND f.modality = 'fiat' AND c.modality = 'crypto' AND c.ts_us BETWEEN f.ts_us AND f.ts_us + 15 * 60000000""")
def st9(spark, d):
    legs = lambda m: _stream(spark, d).where(F.col("modality") == m).select("transaction_id", "identity", F.col("ts").cast("timestamp").alias("ts"))
    pairs = T.interval_join(legs("fiat"), legs("crypto"))
    return spark.read.schema(pairs.schema).parquet(T.run_to_end(pairs, shared_folder(spark)))


@query("st10_late_rows", f"WITH {B.TXN}, m AS (SELECT max(ts_us) AS top FROM txn WHERE event_id % 2 = 0) SELECT event_id, event_id % 2 = 1 AND ts_us // 1000 < top // 1000 - 600000 AS late FROM txn, m")
def st10(spark, d):
    """A running stream over two files: even events arrive first, odd ones in a second micro-batch, most of them behind the watermark by then."""
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    t = B.txn(spark, d).select("event_id", "ts_us")
    for part in (0, 1):
        t.where(F.col("event_id") % 2 == part).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    stream = P.stream_session(spark).readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    found = P.with_lateness(stream)
    return spark.read.schema(found.schema).parquet(T.run_to_end(found, folder)).select("event_id", "late")


@query("io7_stream_dead_letters", f"WITH {B.TXN} SELECT 'rows' AS part, transaction_id AS item FROM txn WHERE event_id % 50 <> 0 UNION ALL SELECT 'dead', '{{broken ' || event_id FROM txn WHERE event_id % 50 = 0")
def io7s(spark, d):
    """The events as JSON lines, one in 50 broken, through a stream with a dead-letter branch."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("transaction_id", "amount_usd")))
    T.run_to_end(T.parsed_stream(_stream(spark, d).select(line.alias("json")), "transaction_id string, amount_usd double"), folder, T.dead_letters(folder, "row.transaction_id IS NOT NULL"))
    rows = spark.read.schema("transaction_id string, amount_usd double").parquet(f"{folder}/rows/batch=*").select(F.lit("rows").alias("part"), F.col("transaction_id").alias("item"))
    return rows.unionByName(spark.read.schema("json string").parquet(f"{folder}/dead/batch=*").select(F.lit("dead").alias("part"), F.col("json").alias("item")))


@query("st2_sliding_stats", f"""WITH {B.SCORED}, w AS (SELECT s.ts_us, decision, risk_score, unnest(range(s.ts_us // 60000000 - 4, s.ts_us // 60000000 + 1)) AS m FROM scored s)
SELECT m * 60000000 AS start_us, count(*) AS n, count(*) FILTER (decision = 'block') AS blocked, round(avg(risk_score), 4) AS mean_score FROM w GROUP BY m""")
def st2(spark, d):
    s = T.live_windows(B.scored(spark, d), "5 minutes", "1 minute")
    return s.select(B.micros("w.start").alias("start_us"), "n", "blocked", "mean_score")


@query("st3_hourly_windows", f"WITH {B.SCORED} SELECT ts_us // {W.HOUR} * {W.HOUR} AS start_us, client_id, count(*) AS n, count(*) FILTER (decision = 'block') AS blocked FROM scored GROUP BY ALL")
def st3(spark, d):
    return T.hourly_windows(B.scored(spark, d)).select(B.micros("w.start").alias("start_us"), "client_id", "n", "blocked")


@query("st6_alert_limit_tumbling", f"""WITH {B.SCORED} SELECT event_id AS alert_id, row_number() OVER (PARTITION BY client_id, ts_us // 3600000000 ORDER BY ts_us, event_id) <= 3 AS accepted FROM scored WHERE decision <> 'approve'""")
def st6(spark, d):
    # Hours in place of minutes, so that the cap is met at this table's rate.
    a = B.scored(spark, d).where("decision <> 'approve'").select(F.col("client_id").alias("channel"), F.col("event_id").alias("alert_id"), F.concat(F.floor(F.col("ts_us") / F.lit(W.HOUR)).cast("string")).cast("long").alias("h"), "ts_us")
    limited = T.alert_limit_tumbling(a.withColumn("ts_us", F.col("h") * 60_000_000 + F.floor(F.pmod(F.col("ts_us"), F.lit(W.HOUR)) / 60).cast("long")), 3)
    return limited.select("alert_id", "accepted")


@query("st11_session_bursts", f"""WITH {B.TXN}, l AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY identity ORDER BY ts_us, event_id) >= 600000000, true)::INTEGER AS fresh FROM txn),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY identity ORDER BY ts_us, event_id) AS session FROM l)
SELECT identity, min(ts_us) AS start_us, count(*) AS n, round(sum(amount_usd::DECIMAL(18,4))::DOUBLE, 2) AS volume FROM s GROUP BY identity, session""")
def st11(spark, d):
    return T.session_bursts(B.txn(spark, d)).select("identity", B.micros("w.start").alias("start_us"), "n", "volume")
