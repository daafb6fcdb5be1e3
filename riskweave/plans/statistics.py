"""Queries: grouped statistics, drift, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import aggregates as A
from ..operators import ordering as K
from ..sources import bindings as B
from .catalog import query

DAY = 86_400_000_000
M = "::DECIMAL(18,4)"


@query("a1_sender_degree", f"WITH {B.EDGES_ORDER} SELECT src, count(DISTINCT coalesce(dst, '')) AS out_degree, round(sum(amount{M})::DOUBLE, 2) AS total_sent FROM edges GROUP BY src")
def a1(spark, d):
    return A.sender_stats(B.edges_order(spark, d))


@query("a2_a3_receiver_degree", f"WITH {B.EDGES_ORDER} SELECT dst, count(DISTINCT src) AS in_degree, round(sum(amount{M})::DOUBLE / count(amount), 4) AS mean_received FROM edges GROUP BY dst")
def a2(spark, d):
    return A.receiver_stats(B.edges_order(spark, d))


@query("a4_degrees_mapped", f"""WITH {B.EDGES_TXN}, o AS (SELECT src, count(DISTINCT dst) AS out_degree, round(sum(amount{M})::DOUBLE, 2) AS total_sent FROM edges GROUP BY src),
i AS (SELECT dst, count(DISTINCT src) AS in_degree, round(sum(amount{M})::DOUBLE / count(amount), 4) AS mean_received FROM edges GROUP BY dst)
SELECT edge_id, out_degree, in_degree, total_sent, mean_received, round(in_degree / (out_degree + 1), 6) AS fan_in_ratio FROM edges JOIN o USING (src) JOIN i USING (dst)""")
def a4(spark, d):
    return A.with_degrees(B.edges_txn(spark, d)).select("edge_id", "out_degree", "in_degree", "total_sent", "mean_received", "fan_in_ratio")


_NODES = f"""o AS (SELECT src AS id, count(*) AS out_degree, sum(amount{M})::DOUBLE AS s, max(is_fraud) AS label FROM edges GROUP BY src),
i AS (SELECT dst AS id, count(*) AS in_degree, sum(amount{M})::DOUBLE AS r FROM edges GROUP BY dst),
stats AS (SELECT id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, round(coalesce(s / out_degree, 0), 4) AS avg_out, round(coalesce(s, 0), 2) AS sum_out,
  round(coalesce(r / in_degree, 0), 4) AS avg_in, round(coalesce(in_degree, 0) / (coalesce(out_degree, 0) + 1), 6) AS fan_in, round(coalesce(s, 0) / (coalesce(out_degree, 0) + 1), 4) AS volume_per_txn, coalesce(label, 0) AS label
  FROM o FULL JOIN i USING (id))"""


@query("a5_a6_node_statistics", f"WITH {B.EDGES_ORDER}, {_NODES} SELECT * FROM stats")
def a5(spark, d):
    return A.node_stats(B.edges_order(spark, d))


@query("p23_scaled_node_features", f"""WITH {B.EDGES_TXN}, {_NODES} SELECT id, round(least(out_degree / 1000.0::DOUBLE, 1), 6) AS out_degree, round(least(in_degree / 1000.0::DOUBLE, 1), 6) AS in_degree, round(least(avg_out / 100000.0::DOUBLE, 1), 6) AS avg_out,
  round(least(sum_out / 1000000.0::DOUBLE, 1), 6) AS sum_out, round(least(avg_in / 100000.0::DOUBLE, 1), 6) AS avg_in, round(least(fan_in / 100.0::DOUBLE, 1), 6) AS fan_in, round(least(volume_per_txn / 100000.0::DOUBLE, 1), 6) AS volume_per_txn FROM stats""")
def p23(spark, d):
    return A.node_stats(B.edges_txn(spark, d)).select("id", *(F.round(R.scaled_node(c), 6).alias(c) for c in R.NODE_SCALES))


_SNAP = f"""count(*) AS n, count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (decision = 'block') AS blocked,
  round(count(*) FILTER (decision = 'block') / count(*), 4) AS block_rate, round(count(*) FILTER (decision = 'review') / count(*), 4) AS review_rate, round(avg(risk_score), 4) AS mean_score, round(avg(k * 3), 2) AS mean_latency_ms, round(sum(amount_usd{M})::DOUBLE, 2) AS volume"""


@query("a7_live_snapshot", f"WITH {B.SCORED} SELECT client_id, {_SNAP} FROM scored GROUP BY ROLLUP (client_id)")
def a7(spark, d):
    return A.live_snapshot(B.scored(spark, d).withColumn("latency_ms", F.col("k") * 3))


@query("a8_hourly_by_client", f"""WITH {B.SCORED} SELECT ts_us // 3600000000 AS hour, client_id, count(*) AS n, count(*) FILTER (decision = 'block') AS blocked, count(*) FILTER (decision = 'review') AS reviewed,
  round(avg(risk_score), 4) AS mean_score, round(sum(amount_usd{M})::DOUBLE, 2) AS volume FROM scored, latest WHERE ts_us >= now - 24 * 3600000000 GROUP BY ALL""")
def a8(spark, d):
    s = B.scored(spark, d)
    return A.hourly(s, B.at(A.newest_us(s) - 24 * 3_600_000_000))


@query("a9_block_rate_drift", f"""WITH {B.SCORED}, r AS (SELECT
  coalesce(nullif(count(*) FILTER (now - ts_us <= 7 * {DAY} AND decision = 'block') / nullif(count(*) FILTER (now - ts_us <= 7 * {DAY}), 0), 0), 0.005)::DOUBLE AS c,
  coalesce(nullif(count(*) FILTER (now - ts_us > 7 * {DAY} AND now - ts_us <= 37 * {DAY} AND decision = 'block') / nullif(count(*) FILTER (now - ts_us > 7 * {DAY} AND now - ts_us <= 37 * {DAY}), 0), 0), 0.005)::DOUBLE AS b FROM scored, latest)
SELECT round(c, 6) AS current_rate, round(b, 6) AS baseline_rate, round(c / greatest(b, 0.001), 4) AS ratio, CASE WHEN c / greatest(b, 0.001) >= 3 THEN 'critical' WHEN c / greatest(b, 0.001) >= 2 THEN 'high' ELSE 'none' END AS severity FROM r""")
def a9(spark, d):
    s = B.scored(spark, d)
    return A.block_rate_drift(s, A.newest(s))


@query("a10_mean_shift_drift", f"""WITH {B.SCORED}, u AS (SELECT now - ts_us AS age, 'amount_usd' AS feature, amount_usd::DOUBLE AS v FROM scored, latest UNION ALL SELECT now - ts_us, 'k', k FROM scored, latest UNION ALL SELECT now - ts_us, 'risk_score', risk_score FROM scored, latest),
g AS (SELECT feature, avg(v) FILTER (age <= 7 * {DAY}) AS mc, avg(v) FILTER (age > 7 * {DAY} AND age <= 37 * {DAY}) AS mr, stddev_samp(v) FILTER (age > 7 * {DAY} AND age <= 37 * {DAY}) AS sr FROM u GROUP BY feature),
s AS (SELECT feature, CASE WHEN sr IS NULL OR sr = 0 THEN 1 ELSE least(abs(mc - mr) / greatest(sr, 1e-9) / 3, 1) END AS x FROM g)
SELECT feature, round(x, 4) AS drift, CASE WHEN x > 0.25 THEN 'high' WHEN x > 0.10 THEN 'medium' ELSE 'none' END AS severity FROM s""")
def a10(spark, d):
    s = B.scored(spark, d)
    return A.mean_shift_drift(s, A.newest(s), ["amount_usd", "k", "risk_score"])


@query("a10_binned_psi", f"""WITH {B.SCORED}, e AS (SELECT min(amount_usd) AS lo, max(amount_usd) AS hi FROM scored),
h AS (SELECT least(floor((amount_usd - lo) / greatest(hi - lo, 1e-12) * 10), 9) AS b, count(*) FILTER (event_id % 4 = 0) AS c, count(*) FILTER (event_id % 4 <> 0) AS r FROM scored, e GROUP BY b),
t AS (SELECT sum(c) AS tc, sum(r) AS tr FROM h), p AS (SELECT greatest(c / tc, 1e-6) AS p, greatest(r / tr, 1e-6) AS q FROM h, t)
SELECT round(sum((p - q) * ln(p / q)), 4) AS psi FROM p""")
def a10b(spark, d):
    return A.binned_psi(B.scored(spark, d), "amount_usd", F.col("event_id") % 4 == 0)


@query("a11_cohens_d", f"""WITH {B.TXN}, u AS (SELECT is_fraud, 'amount_usd' AS feature, amount_usd::DOUBLE AS v FROM txn UNION ALL SELECT is_fraud, 'k', k FROM txn UNION ALL SELECT is_fraud, 'risk_score', risk_score FROM txn),
g AS (SELECT feature, avg(v) FILTER (is_fraud = 1) AS m1, avg(v) FILTER (is_fraud = 0) AS m0, stddev_samp(v) FILTER (is_fraud = 1) AS s1, stddev_samp(v) FILTER (is_fraud = 0) AS s0, count(*) FILTER (is_fraud = 1) AS n1, count(*) FILTER (is_fraud = 0) AS n0 FROM u GROUP BY feature),
e AS (SELECT feature, abs(m1 - m0) / (sqrt((s1 ** 2 + s0 ** 2) / 2) + 1e-9) AS x FROM g WHERE n1 >= 10 AND n0 >= 10)
SELECT feature, round(x, 4) AS effect, CASE WHEN x > 1 THEN 'artefact' WHEN x > 0.5 THEN 'moderate' ELSE 'ok' END AS verdict FROM e""")
def a11(spark, d):
    return A.cohens_d(B.txn(spark, d), ["amount_usd", "k", "risk_score"], "is_fraud")


@query("a12_bhattacharyya", f"""WITH {B.TXN}, e AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM txn),
h AS (SELECT least(floor((risk_score - lo) / (hi - lo + 1e-10) * 10), 9) AS b, count(*) FILTER (is_fraud = 1) AS p, count(*) FILTER (is_fraud = 0) AS q FROM txn, e GROUP BY b),
t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM h), c AS (SELECT sum(sqrt(p / tp * (q / tq))) AS c FROM h, t)
SELECT round(c, 4) AS overlap, CASE WHEN c < 0.25 THEN 'separable' WHEN c < 0.40 THEN 'partial' ELSE 'overlapping' END AS band FROM c""")
def a12(spark, d):
    return A.bhattacharyya(B.txn(spark, d), "risk_score", "is_fraud")


@query("a13_log_normal_fit", f"WITH {B.TXN} SELECT client_id, round(avg(ln(greatest(amount_usd, 1.0))), 6) AS mu, round(stddev_samp(ln(greatest(amount_usd, 1.0))), 6) AS sigma FROM txn GROUP BY client_id")
def a13(spark, d):
    return A.log_normal_fit(B.txn(spark, d), "amount_usd", "client_id")


@query("a14_median_ratio", f"WITH {B.TXN} SELECT round(quantile_cont(amount_usd, 0.5) FILTER (is_fraud = 1) / quantile_cont(amount_usd, 0.5) FILTER (is_fraud = 0), 6) AS ratio, round(quantile_cont(amount_usd, 0.5) FILTER (is_fraud = 1), 6) AS median_1, round(quantile_cont(amount_usd, 0.1) FILTER (is_fraud = 1), 6) AS p10_1 FROM txn")
def a14(spark, d):
    return A.median_ratio(B.txn(spark, d), "amount_usd", "is_fraud")


@query("a15_burst_stats", f"""WITH {B.TXN}, p AS (SELECT identity, count(*) AS n, (max(ts_us) - min(ts_us)) / 3600000000::DOUBLE AS span FROM txn GROUP BY identity)
SELECT round(quantile_cont(n, 0.1), 4) AS n_p10, round(quantile_cont(n, 0.9), 4) AS n_p90, round(avg(span), 4) AS mean_span_hours FROM p""")
def a15(spark, d):
    return A.burst_stats(B.txn(spark, d))


@query("a16_hour_distribution", f"""WITH {B.TXN}, h AS (SELECT (ts_us // 3600000000 % 24)::INTEGER AS hour, count(*) AS n FROM txn GROUP BY ALL)
SELECT hour, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, hour) <= 3 AS is_top FROM h""")
def a16(spark, d):
    return A.hour_distribution(B.txn(spark, d))


@query("a17_archetypes", f"""WITH {B.TXN}, f AS (SELECT round(avg(ln(greatest(amount_usd, 1.0))), 6) AS mu, round(stddev_samp(ln(greatest(amount_usd, 1.0))), 6) AS sigma FROM txn),
o AS (SELECT * FROM (VALUES ('student', -1.0::DOUBLE, 0.8::DOUBLE), ('worker', 0.0, 1.0), ('business', 2.0, 1.3)) v(archetype, o, s))
SELECT archetype, round(f.mu + o.o, 4) AS mu, round(f.sigma * o.s, 4) AS sigma, round(exp(f.mu + o.o), 2) AS median FROM f, o""")
def a17(spark, d):
    return A.archetypes(A.log_normal_fit(B.txn(spark, d), "amount_usd"), {"student": (-1.0, 0.8), "worker": (0.0, 1.0), "business": (2.0, 1.3)})


@query("a18_data_summary", f"""WITH {B.TXN} SELECT client_id, event_type, count(*) AS n, sum(is_fraud)::BIGINT AS fraud, round(avg(is_fraud), 6) AS fraud_rate, round(quantile_cont(amount_usd, 0.75), 4) AS p75, round(quantile_cont(amount_usd, 0.95), 4) AS p95
FROM txn GROUP BY ROLLUP (client_id, event_type)""")
def a18(spark, d):
    return A.data_summary(B.txn(spark, d))


@query("a18_cross_modal_totals", f"WITH {B.TXN} SELECT count(*) AS transactions, count(DISTINCT receiver) AS sequences FROM txn WHERE k % 5 = 0 AND receiver IS NOT NULL")
def a18c(spark, d):
    return A.cross_modal_totals(B.txn(spark, d).withColumn("sequence", F.when(F.col("k") % 5 == 0, F.col("receiver"))), "sequence")


_SPLIT = """ranked AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) - 1 AS r, count(*) OVER () AS n FROM txn),
split AS (SELECT *, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query("a19_split_report", f"""WITH {B.TXN}, {_SPLIT}, g AS (SELECT split, count(*) AS n, avg(is_fraud) AS f, min(ts_us) AS first_us, round(100 * avg((k % 3 > 0)::INTEGER), 4) AS embedding_percent FROM split GROUP BY split)
SELECT split, n, round(100 * f, 4) AS fraud_percent, first_us, embedding_percent, (SELECT abs(max(f) FILTER (split = 'train') - max(f) FILTER (split = 'test')) * 100 > 5 FROM g) AS fraud_shift FROM g""")
def a19(spark, d):
    return A.split_report(K.temporal_split(B.txn(spark, d).withColumn("hit", (F.col("k") % 3 > 0).cast("int")), "ts_us", "event_id"), "hit")


@query("a19_source_mix", f"WITH {B.TXN}, {_SPLIT} SELECT split, client_id, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS percent FROM split GROUP BY split, client_id")
def a19m(spark, d):
    return A.source_mix(K.temporal_split(B.txn(spark, d), "ts_us", "event_id"), "client_id")


@query("a20_class_weights", f"WITH {B.TXN} SELECT count(*) FILTER (is_fraud = 1) AS n_pos, count(*) FILTER (is_fraud = 0) AS n_neg, round(count(*) FILTER (is_fraud = 0) / count(*) FILTER (is_fraud = 1), 6) AS weight FROM txn")
def a20(spark, d):
    return A.class_weights(B.txn(spark, d))


@query("a21_rate_correction", f"""WITH {B.TXN}, a AS (SELECT avg(is_fraud) AS a FROM txn) SELECT event_id, round(CASE WHEN is_fraud = 0 AND a > 0.005 THEN 0.005::DOUBLE / 0.995::DOUBLE * (1 - a) / a ELSE 1 END, 6)::DOUBLE AS sample_weight FROM txn, a""")
def a21(spark, d):
    return A.rate_corrected(B.txn(spark, d)).select("event_id", "sample_weight")


@query("a22_mean_one_weights", f"WITH {B.TXN}, w AS (SELECT event_id, coalesce(CASE WHEN event_id % 9 <> 0 THEN k::DOUBLE END, 0.001) AS w FROM txn) SELECT event_id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def a22(spark, d):
    t = B.txn(spark, d).select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("k").cast("double")).alias("w"))
    return A.mean_one_weights(t, "w").select("event_id", "weight")


@query("a23_label_sources", f"WITH {B.TXN}, {B.LABELS} SELECT source, count(*) AS n FROM labels_tbl GROUP BY source")
def a23(spark, d):
    return B.labels_tbl(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a24_embedding_diagnostics", f"""WITH {B.NODES_VEC}, u AS (SELECT class, unnest(features) AS x, generate_subscripts(features, 1) AS dim FROM nodes WHERE class IN ('1', '2')),
g AS (SELECT dim, avg(x) FILTER (class = '1') AS ma, avg(x) FILTER (class = '2') AS mb, var_pop(x) FILTER (class = '1') AS va, var_pop(x) FILTER (class = '2') AS vb FROM u GROUP BY dim)
SELECT round(sqrt(sum((ma - mb) ** 2)), 4) AS distance, round(avg(va), 4) AS variance_a, round(avg(vb), 4) AS variance_b FROM g""")
def a24(spark, d):
    return A.embedding_diagnostics(B.nodes_vec(spark, d), "1", "2")


@query("a25_quality_rules", f"""WITH {B.TXN}, g AS (SELECT count(*)::DOUBLE AS n, avg(is_fraud) AS f, count(DISTINCT identity)::DOUBLE AS i FROM txn)
SELECT 'rows' AS rule, n AS value, n > 0 AS passed FROM g UNION ALL SELECT 'fraud_rate', round(f, 6), f > 0.005 AND f < 0.15 FROM g UNION ALL SELECT 'identities', i, i >= 100000 FROM g""")
def a25(spark, d):
    v = F.col("value")
    return A.quality_rules(B.txn(spark, d), {"rows": (F.count(F.lit(1)), v > 0), "fraud_rate": (F.avg("is_fraud"), (v > 0.005) & (v < 0.15)), "identities": (F.countDistinct("identity"), v >= 100_000)})


@query("a26_latency_report", f"""WITH {B.TXN} SELECT event_type, count(*) AS n, round(quantile_cont(amount_usd, 0.5), 4) AS p50, round(quantile_cont(amount_usd, 0.75), 4) AS p75, round(quantile_cont(amount_usd, 0.95), 4) AS p95,
  round(quantile_cont(amount_usd, 0.99), 4) AS p99, round(quantile_cont(amount_usd, 0.999), 4) AS p999, round(100 * avg((k % 10 = 0)::INTEGER), 4) AS failed_percent FROM txn GROUP BY event_type HAVING count(*) >= 5""")
def a26(spark, d):
    return A.latency_report(B.txn(spark, d), "event_type", "amount_usd", F.col("k") % 10 == 0)


@query("a26_slow_requests", f"WITH {B.TXN} SELECT event_id FROM txn WHERE k * 3 > 200 AND NOT k % 10 = 0")
def a26s(spark, d):
    return A.slow_requests(B.txn(spark, d).withColumn("latency_ms", F.col("k") * 3), "latency_ms", F.col("k") % 10 == 0).select("event_id")


@query("a27_alert_outcomes", f"WITH {B.SCORED} SELECT CASE WHEN decision = 'approve' THEN 'skipped' WHEN k % 20 = 0 THEN 'failed' ELSE 'sent' END AS outcome, count(*) AS n FROM scored GROUP BY outcome")
def a27(spark, d):
    outcome = F.when(F.col("decision") == "approve", "skipped").when(F.col("k") % 20 == 0, "failed").otherwise("sent")
    return B.scored(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("k1_temporal_split", f"WITH {B.TXN}, {_SPLIT} SELECT event_id, split FROM split")
def k1(spark, d):
    return K.temporal_split(B.txn(spark, d), "ts_us", "event_id").select("event_id", "split")


@query("k2_stratified_split", f"""WITH {B.TXN}, r AS (SELECT event_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY (event_id * 7919 + 104729) % 1000003, event_id) - 1 AS r, count(*) OVER (PARTITION BY is_fraud) AS n FROM txn)
SELECT event_id, CASE WHEN r / n < 0.70 THEN 'train' WHEN r / n < 0.85 THEN 'val' ELSE 'test' END AS split FROM r""")
def k2(spark, d):
    return K.stratified_split(B.txn(spark, d), "is_fraud", "event_id").select("event_id", "split")


@query("k3_step_split", f"WITH {B.NODES_VEC} SELECT id, CASE WHEN step / (SELECT max(step) FROM nodes) <= 0.70 THEN 'train' WHEN step / (SELECT max(step) FROM nodes) <= 0.85 THEN 'val' ELSE 'test' END AS split FROM nodes")
def k3(spark, d):
    return K.step_split(B.nodes_vec(spark, d), "step").select("id", "split")


_H = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT"


@query("k4_hash_split", f"WITH {B.NODES_VEC} SELECT id, CASE WHEN {_H.format('id')} % 100 < 70 THEN 'train' WHEN {_H.format('id')} % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM nodes")
def k4(spark, d):
    return B.nodes_vec(spark, d).select("id", K.hash_split(F.col("id")).alias("split"))


@query("k5_subsample", f"WITH {B.TXN} SELECT event_id, amount_usd FROM txn ORDER BY {_H.format('event_id')}, event_id LIMIT 500")
def k5(spark, d):
    return K.subsample(B.txn(spark, d).select("event_id", "amount_usd"), "event_id", 500)


@query("k6_recent_decisions", f"WITH {B.SCORED} SELECT transaction_id, decision, ts_us FROM scored ORDER BY ts_us DESC, event_id DESC LIMIT 100")
def k6(spark, d):
    return K.recent(B.scored(spark, d)).select("transaction_id", "decision", "ts_us")


_STORE = """store AS (SELECT transaction_id, event_id, source, (CASE WHEN confidence >= 0.85 THEN 1.0 WHEN confidence >= 0.70 THEN 0.7 ELSE 0.4 END)::DOUBLE AS weight, event_id % 15 = 0 AS included_in_training,
  CASE WHEN source = 'chargeback' THEN is_fraud END AS chargeback_label, CASE WHEN source = 'human' THEN 1 - is_fraud END AS human_label, CASE WHEN source = 'llm' AND event_id % 4 <> 0 THEN is_fraud END AS llm_label,
  CASE WHEN event_id % 25 = 0 THEN 'no json' ELSE '{"amount_usd": ' || k || ', "modality": "m"}' END AS features_json FROM labels_tbl JOIN txn USING (transaction_id, event_id)),
cand AS (SELECT *, coalesce(chargeback_label, human_label, llm_label) AS label FROM store WHERE weight >= 0.4 AND NOT included_in_training AND coalesce(chargeback_label, human_label, llm_label) IS NOT NULL)"""


def _store(spark, d):
    from ..functions.decisions import label_weight

    labels = B.labels_tbl(spark, d).select("transaction_id", "event_id", "source", "confidence", F.col("llm_label").alias("y"))
    k = B.txn(spark, d).select("transaction_id", "k")
    of = lambda s, y: F.when(F.col("source") == s, y).cast("int")
    i = F.col("event_id")
    return labels.hint("merge").join(k, "transaction_id").select(
        "transaction_id", "event_id", "source", label_weight(F.col("confidence")).alias("weight"), (i % 15 == 0).alias("included_in_training"), of("chargeback", F.col("y")).alias("chargeback_label"), of("human", 1 - F.col("y")).alias("human_label"),
        of("llm", F.when(i % 4 != 0, F.col("y"))).alias("llm_label"), F.when(i % 25 == 0, "no json").otherwise(F.format_string('{"amount_usd": %d, "modality": "m"}', F.col("k"))).alias("features_json"),
    )


@query("k8_label_candidates", f"WITH {B.TXN}, {B.LABELS}, {_STORE} SELECT transaction_id, weight, label, CASE source WHEN 'chargeback' THEN 1 WHEN 'human' THEN 2 ELSE 3 END AS priority FROM cand WHERE event_id % 10 <> 0 ORDER BY priority, weight DESC, transaction_id")
def k8(spark, d):
    labels = _store(spark, d)
    return K.label_candidates(labels, labels.where("event_id % 10 = 0")).select("transaction_id", "weight", "label", "priority")


@query("k9_merge_training", f"""WITH {B.TXN}, {B.LABELS}, {_STORE}, new AS (SELECT transaction_id, k::DOUBLE AS amount_usd, 'm' AS modality, label AS is_fraud, weight AS sample_weight, source AS label_source FROM cand JOIN txn USING (transaction_id) WHERE features_json <> 'no json' AND (SELECT count(*) FROM cand) >= 100)
SELECT * FROM new UNION ALL SELECT transaction_id, amount_usd, modality, is_fraud, NULL, NULL FROM txn WHERE transaction_id NOT IN (SELECT transaction_id FROM new)""")
def k9(spark, d):
    return K.ingest_labels(B.txn(spark, d).select("transaction_id", "amount_usd", "modality", "is_fraud"), _store(spark, d))[0]


@query("k9_labels_used", f"WITH {B.TXN}, {B.LABELS}, {_STORE} SELECT transaction_id, included_in_training OR (transaction_id IN (SELECT transaction_id FROM cand) AND (SELECT count(*) FROM cand) >= 100) AS included_in_training FROM store")
def k9u(spark, d):
    return K.ingest_labels(B.txn(spark, d).select("transaction_id", "amount_usd", "modality", "is_fraud"), _store(spark, d))[1].select("transaction_id", "included_in_training")


@query("k10_union_by_name", f"WITH {B.TXN} SELECT transaction_id, amount_usd, NULL::VARCHAR AS modality FROM txn WHERE event_id % 2 = 0 UNION ALL SELECT transaction_id, NULL, modality FROM txn WHERE event_id % 2 = 1")
def k10(spark, d):
    t = B.txn(spark, d)
    return K.aligned_union(t.where("event_id % 2 = 0").select("transaction_id", "amount_usd"), t.where("event_id % 2 = 1").select("modality", "transaction_id"))
