"""Queries: records, scalar functions, window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import records as R
from ..operators import windows as W
from ..operators.aggregates import newest_us
from ..operators.ordering import first_by
from ..sources import bindings as B
from .catalog import ORACLE_SQL, query

H = 3_600_000_000
WK = 168 * H


@query("flagship_hourly_velocity", f"""WITH {B.SCORED}, v AS (
  SELECT *, count(*) OVER (PARTITION BY identity ORDER BY ts_us RANGE BETWEEN {24 * H} PRECEDING AND CURRENT ROW) AS c24 FROM scored)
SELECT ts_us // {H} AS hour, client_id, count(*) AS n, count(*) FILTER (decision = 'block') AS blocked, max(c24) AS max_count_24h, round(sum(amount_usd::DECIMAL(18,4))::DOUBLE, 2) AS volume
FROM v GROUP BY ALL""")
def flagship(spark, d):
    v = W.velocity(B.scored(spark, d))
    hour = F.floor(F.col("ts_us") / F.lit(H)).cast("long")
    return v.groupBy(hour.alias("hour"), "client_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "block").alias("blocked"), F.max("count_24h").alias("max_count_24h"), F.round(F.sum(F.col("amount_usd").cast("decimal(18,4)")).cast("double"), 2).alias("volume"))


@query("p1_identity_hash", f"WITH {B.TXN} SELECT transaction_id, sha256(identity::VARCHAR || 'salt') AS identity_hash FROM txn")
def p1(spark, d):
    return B.txn(spark, d).select("transaction_id", R.salted_hash(F.col("identity"), "salt").alias("identity_hash"))


_RAW = """raw AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE 'evt_' || event_id END AS transaction_id, CASE WHEN event_id % 13 = 0 THEN -1.0 WHEN event_id % 47 = 0 THEN 50000000.0 ELSE value END AS amount_usd,
    CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 'neobank' END AS client_id, CASE WHEN event_id % 19 = 0 THEN 'cash' ELSE 'fiat' END AS modality,
    CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'bad' ELSE sha256(user_id::VARCHAR) END AS identity_hash, CASE WHEN event_id % 29 = 0 OR event_id % 41 = 0 THEN '' ELSE sha256('s' || user_id) END AS sender_hash,
    CASE WHEN event_id % 43 = 0 THEN upper(sha256('e' || user_id)) END AS user_email_hash, props, user_id, ts FROM events)"""


def _raw(spark, d):
    e, i = B.table(spark, d, "events"), F.col("event_id")
    return e.select(
        "event_id", F.when(i % 11 == 0, "x").otherwise(F.concat(F.lit("evt_"), i.cast("string"))).alias("transaction_id"), F.when(i % 13 == 0, -1.0).when(i % 47 == 0, 5e7).otherwise(F.col("value")).alias("amount_usd"),
        F.when(i % 17 == 0, "other").otherwise("neobank").alias("client_id"), F.when(i % 19 == 0, "cash").otherwise("fiat").alias("modality"),
        F.when(i % 41 == 0, "").when(i % 23 == 0, "bad").otherwise(R.salted_hash(F.col("user_id"))).alias("identity_hash"),
        F.when((i % 29 == 0) | (i % 41 == 0), "").otherwise(F.sha2(F.concat(F.lit("s"), F.col("user_id").cast("string")), 256)).alias("sender_hash"),
        F.when(i % 43 == 0, F.upper(F.sha2(F.concat(F.lit("e"), F.col("user_id").cast("string")), 256))).alias("user_email_hash"), F.lit(None).cast("string").alias("sender_wallet_hash"),
        F.when(i % 31 == 0, "soon").when(i % 37 == 0, "2100-01-01 00:30:01").when(i % 59 == 0, "2100-01-01 00:30:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), "props", "user_id", "ts",
    )


@query("p2_validation", f"""WITH {_RAW}, r AS (SELECT event_id, [x FOR x IN [
  CASE WHEN length(transaction_id) NOT BETWEEN 5 AND 128 THEN 'transaction_id' END, CASE WHEN amount_usd <= 0 OR amount_usd >= 50000000 THEN 'amount' END,
  CASE WHEN client_id NOT IN ('neobank', 'cryptoex', 'finbridge') THEN 'client' END, CASE WHEN modality NOT IN ('fiat', 'crypto') THEN 'modality' END,
  CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'timestamp' END, CASE WHEN identity_hash = '' AND sender_hash = '' AND user_email_hash IS NULL THEN 'identity' END,
  CASE WHEN identity_hash <> '' AND NOT regexp_matches(identity_hash, '^[0-9a-f]{{64}}$') THEN 'identity_hash' END,
  CASE WHEN NOT regexp_matches(user_email_hash, '^[0-9a-f]{{64}}$') THEN 'user_email_hash' END] IF x IS NOT NULL] AS reasons FROM raw)
SELECT event_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS valid FROM r""")
def p2(spark, d):
    now = F.to_timestamp(F.lit("2100-01-01 00:00:00"))
    return _raw(spark, d).withColumn("r", R.rejection_reasons(now)).select("event_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("valid"))


@query("p3_pii_scan", r"""SELECT doc_id, array_to_string([x FOR x IN [
  CASE WHEN regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') THEN 'text:email' END,
  CASE WHEN regexp_matches(text, '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b') THEN 'text:phone' END,
  CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'text:ssn' END] IF x IS NOT NULL], ',') AS fields FROM documents""")
def p3(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(R.pii_fields(["text"]), ",").alias("fields"))


@query("p4_normalise", """SELECT event_id, epoch_us(ts) AS ts_us, lower(trim('  ' || upper(event_type) || ' ')) AS transfer_type FROM events""")
def p4(spark, d):
    e = B.table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    t = R.normalised_time(text, F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    return e.select("event_id", F.unix_micros(t).alias("ts_us"), F.lower(F.trim(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))).alias("transfer_type"))


@query("p5_p6_canonical_identity", f"""WITH {_RAW}, c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE identity_hash END AS a, sender_hash AS b FROM raw)
SELECT event_id, coalesce(nullif(a, ''), nullif(b, '')) AS identity, CASE WHEN coalesce(nullif(a, ''), nullif(b, '')) IS NULL THEN 'missing_identity_hash' END AS feature_error FROM c""")
def p5(spark, d):
    r = _raw(spark, d).withColumn("a", F.when(F.col("event_id") % 2 != 0, F.col("identity_hash")))
    out = r.select("event_id", R.canonical_identity("a", "sender_hash").alias("identity"))
    return out.withColumn("feature_error", R.identity_error(F.col("identity")))


@query("p7_temporal_features", """SELECT event_id, hour(ts)::INTEGER AS hour_of_day, (isodow(ts) - 1)::INTEGER AS day_of_week, (isodow(ts) > 5)::INTEGER AS is_weekend,
  (hour(ts) < 6 OR hour(ts) >= 23)::INTEGER AS is_unusual_hour, (hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5)::INTEGER AS is_business_hours FROM events""")
def p7(spark, d):
    return B.table(spark, d, "events").select("event_id", *(c.alias(k) for k, c in R.temporal("ts").items()))


@query("p8_passthrough_defaults", """SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, -1.0) AS amount_usd, coalesce(CASE WHEN event_id % 4 <> 0 THEN event_type END, 'unknown') AS sender_kyc_status,
  coalesce(CASE WHEN event_id % 5 <> 0 THEN 0.25 END, 0.5)::DOUBLE AS source_confidence, CASE WHEN event_id % 6 = 0 THEN -1 ELSE event_id % 900 END::INTEGER AS sender_account_age_days, CASE WHEN event_id % 7 = 0 THEN 'BTC' ELSE '' END AS cryptocurrency,
  -1::INTEGER AS receiver_wallet_age_days, 'unknown' AS sender_archetype, 0::INTEGER AS is_first_time_receiver, -1.0::DOUBLE AS balance_drain_ratio, -1.0::DOUBLE AS sender_balance_before, 'fiat' AS modality, 'unknown' AS transfer_type, 'unknown' AS transfer_network,
  'unknown' AS client_id, 0::INTEGER AS known_mixer_interaction, 'unknown' AS receiver_wallet_type, '' AS blockchain, -1::INTEGER AS gas_price_gwei, 0::INTEGER AS is_real_data FROM events""")
def p8(spark, d):
    e, i = B.table(spark, d, "events"), F.col("event_id")
    r = e.select(
        "event_id", F.when(i % 3 != 0, F.col("value")).alias("amount_usd"), F.when(i % 4 != 0, F.col("event_type")).alias("sender_kyc_status"), F.when(i % 5 != 0, 0.25).alias("source_confidence"),
        F.when(i % 6 != 0, i % 900).alias("sender_account_age_days"), F.when(i % 7 == 0, "BTC").alias("cryptocurrency"), F.lit("old").alias("receiver_wallet_age_days"),
    )
    return R.passthrough(r)


@query("p9_leakage_drop", f"WITH {B.TXN} SELECT event_id, client_id, amount_usd, is_fraud FROM txn")
def p9(spark, d):
    t = B.txn(spark, d).select("event_id", "client_id", "amount_usd", "is_fraud", *(F.lit(i).alias(c) for i, c in enumerate(R.LEAKAGE)))
    return R.without_leakage(R.without_leakage(t, R.LEAKAGE_EARLY))


@query("p10_contract_merge", """SELECT event_id, event_id % 4 = 1 AS flag, CASE WHEN event_id % 3 <> 0 THEN value ELSE 0 END AS amount, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'unknown' END AS kind, CASE WHEN event_id % 7 <> 0 THEN event_id::VARCHAR ELSE '' END AS ref FROM events""")
def p10(spark, d):
    i = F.col("event_id")
    r = B.table(spark, d, "events").select("event_id", F.when(i % 4 == 1, 1.0).when(i % 4 == 2, 0.0).alias("flag"), F.when(i % 3 != 0, F.col("value").cast("string")).otherwise("n/a").alias("amount"), F.when(i % 5 != 0, F.col("event_type")).alias("kind"), F.when(i % 7 != 0, i.cast("string")).alias("ref"))
    return R.contract(r, ["flag"], ["amount"], ["kind"], ["ref"])


@query("p11_contract_features", """SELECT vec_id, label % 2 = 1 AS is_weekend, false AS graph_only, label > 4 AS has_fiat_history, (CASE WHEN vec_id % 3 <> 0 THEN vec_id * 0.1 END)::FLOAT::DOUBLE AS velocity_ratio,
  (CASE WHEN vec_id % 5 <> 0 THEN vec_id + 0.5 END)::FLOAT::DOUBLE AS amount_crypto, (CASE WHEN vec_id % 7 = 0 THEN 0 ELSE embedding[1] END)::FLOAT::DOUBLE AS gnn_emb_0, (CASE WHEN vec_id % 2 = 0 THEN 0 ELSE embedding[2] END)::FLOAT::DOUBLE AS gnn_emb_1,
  CASE WHEN vec_id % 4 = 0 OR vec_id % 4 = 1 THEN '' ELSE 'k' || label END AS blockchain, CASE WHEN vec_id % 4 = 0 THEN 'nan' END AS timestamp FROM embeddings""")
def p11(spark, d):
    v, e = F.col("vec_id"), F.col("embedding")
    r = B.table(spark, d, "embeddings").select(
        "vec_id", F.when(F.col("label") % 2 == 1, "True").alias("is_weekend"), F.lit(None).cast("boolean").alias("graph_only"), F.when(F.col("label") > 4, 2.0).when(F.col("label") > 2, 0.0).alias("has_fiat_history"),
        F.when(v % 3 != 0, v * F.lit(0.1)).alias("velocity_ratio"), F.when(v % 5 == 0, "x").otherwise((v + F.lit(0.5)).cast("string")).alias("amount_crypto"),
        F.when(v % 7 == 0, float("nan")).otherwise(e[0]).alias("gnn_emb_0"), F.when(v % 2 == 1, e[1]).alias("gnn_emb_1"),
        F.when(v % 4 == 0, "nan").when(v % 4 != 1, F.concat(F.lit("k"), F.col("label").cast("string"))).alias("blockchain"), F.when(v % 4 == 0, "nan").alias("timestamp"),
    )
    out = R.feature_contract(r)
    return out.withColumns({c: F.col(c).cast("double") for c in ("velocity_ratio", "amount_crypto", "gnn_emb_0", "gnn_emb_1")})


@query("p12_decision", f"WITH {B.SCORED} SELECT transaction_id, decision, CASE decision WHEN 'approve' THEN 0 WHEN 'block' THEN 2 ELSE 1 END AS decision_code FROM scored")
def p12(spark, d):
    return B.scored(spark, d).select("transaction_id", "decision", D.decision_code(F.col("decision")).alias("decision_code"))


_NAMES = [*D.FEATURE_TEXTS, "k"]
_TEXT = """CASE WHEN isnan(v) THEN f || ': nan' || CASE WHEN f = 'k' THEN ' (↑ risk)' ELSE '' END WHEN f = 'velocity_ratio' THEN format('Velocity {:.1f}× above baseline', v) WHEN f = 'cross_modal_pattern_detected' THEN 'Cross-institutional laundering pattern'
  WHEN f = 'amount_ratio' THEN format('Amount {:.1f}× above user average', v) WHEN f = 'institution_count' THEN format('Appeared at {} institutions', trunc(v)::BIGINT) WHEN f = 'balance_drain_ratio' THEN format('Balance drain: {:.0f}%', v * 100)
  WHEN f = 'known_mixer_interaction' THEN 'Interaction with known crypto mixer' WHEN f = 'is_first_time_receiver' THEN 'First-time receiver' WHEN f = 'receiver_wallet_age_days' THEN format('Receiver wallet {} days old', trunc(v)::BIGINT)
  WHEN f = 'count_1h' THEN format('{} transactions in the past hour', trunc(v)::BIGINT) WHEN f = 'fan_in_ratio' THEN format('Fan-in ratio {:.2f} (aggregator pattern)', v)
  WHEN f = 'time_since_other_institution_sec' THEN format('Same identity at other institution {:.0f}m ago', v / 60) WHEN f = 'sender_account_age_days' THEN format('Account only {} days old', trunc(v)::BIGINT)
  ELSE f || ': ' || format('{:.4g}', v) || CASE WHEN v > 0 THEN ' (↑ risk)' ELSE ' (↓ risk)' END END"""


@query("p13_reasons", f"""WITH {B.TXN}, n AS (SELECT {_NAMES!r} AS names), x AS (SELECT event_id, transaction_id, k, modality, names[((event_id + j) % 13 + 1)::INTEGER] AS f, j,
  CASE WHEN event_id % 53 = 0 THEN 'nan'::DOUBLE ELSE (event_id % 3 - 1) * pow(10::DOUBLE, (event_id % 11 - 5)::DOUBLE) * (amount_usd + j) / 7.313::DOUBLE END AS v FROM txn, n, range(3) r(j)),
t AS (SELECT event_id, transaction_id, k, modality, list({_TEXT} ORDER BY j) AS texts FROM x GROUP BY ALL)
SELECT transaction_id, array_to_string((CASE WHEN modality = 'crypto' THEN ['Fiat→crypto laundering pattern detected'] ELSE [] END || CASE WHEN k % 3 = 1 THEN ['Known cryptocurrency mixer interaction'] ELSE [] END || texts)[1:5], '; ') AS reasons FROM t""")
def p13(spark, d):
    names, i = F.array(*map(F.lit, _NAMES)), F.col("event_id")

    def feature(j: int):
        value = F.when(i % 53 == 0, float("nan")).otherwise((i % 3 - 1) * F.pow(F.lit(10.0), (i % 11 - 5).cast("double")) * (F.col("amount_usd") + j) / F.lit(7.313))
        return F.struct(F.element_at(names, ((i + j) % 13 + 1).cast("int")).alias("feature"), value.alias("value"))

    # A fourth feature is never shown.
    top = F.array(*map(feature, range(4)))
    return B.txn(spark, d).select("transaction_id", F.array_join(D.reasons(top, F.col("k") % 3 == 1, F.col("modality") == "crypto"), "; ").alias("reasons"))


@query("p14_alert_eligibility", f"WITH {B.SCORED} SELECT transaction_id, decision <> 'approve' AND amount_usd >= 100 AND (decision <> 'review' OR risk_score >= 0.60) AS eligible FROM scored")
def p14(spark, d):
    return B.scored(spark, d).select("transaction_id", D.alert_eligible(F.col("decision"), F.col("risk_score"), F.col("amount_usd")).alias("eligible"))


_G = "format('{{:.4g}}', {0})"


@query("p15_alert_message", f"""WITH {B.SCORED} SELECT transaction_id, CASE decision WHEN 'block' THEN '🚨 Fraud Alert — BLOCK' WHEN 'review' THEN '⚠️ Fraud Alert — REVIEW' ELSE '✅ Fraud Alert — APPROVE' END AS title,
  CASE decision WHEN 'block' THEN '#E53E3E' WHEN 'review' THEN '#DD6B20' ELSE '#38A169' END AS color, substr(transaction_id, 1, 24) AS id, client_id AS client, format('{{:.4f}}', risk_score) AS score, format('${{:.2f}}', round(k * 1.25::DOUBLE, 2)) AS amount,
  CASE WHEN modality = 'crypto' THEN '• Fiat→crypto laundering pattern detected' || chr(10) || '• First-time receiver' WHEN k % 2 = 0 THEN '• First-time receiver' ELSE '• (no reasons)' END AS reasons,
  CASE WHEN event_id % 4 = 0 THEN '• (no explanation available)' ELSE '• amount usd: `' || {_G.format("amount_usd / 7.313::DOUBLE")} || '` (' || CASE WHEN risk_score - 0.5 > 0 THEN '↑' ELSE '↓' END || ' fraud)' || chr(10) || '• count 1h: `' || {_G.format("k::DOUBLE")} || '` (↓ fraud)' END AS features FROM scored""")
def p15(spark, d):
    s = B.scored(spark, d)
    crypto = F.col("modality") == "crypto"
    known = F.array(F.struct(F.lit("is_first_time_receiver").alias("feature"), F.lit(1.0).alias("value")))
    why = D.reasons(F.when(crypto | (F.col("k") % 2 == 0), known).otherwise(F.slice(known, 1, 0)), F.lit(False), crypto)
    part = lambda name, value, contribution: F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"), contribution.cast("double").alias("contribution"))
    parts = F.array(part("amount_usd", F.col("amount_usd") / F.lit(7.313), F.col("risk_score") - 0.5), part("count_1h", F.col("k"), F.lit(0.0)))
    told = F.when(F.col("event_id") % 4 == 0, F.slice(parts, 1, 0)).otherwise(parts)
    m = D.alert_message(F.col("decision"), F.col("transaction_id"), F.col("client_id"), F.round(F.col("k") * 1.25, 2), F.col("risk_score"), why, told)
    return s.select("transaction_id", m.alias("m")).select("transaction_id", "m.*")


@query("p16_dashboard_event", f"WITH {B.SCORED} SELECT transaction_id FROM scored WHERE decision IN ('block', 'review') AND risk_score > 0.5")
def p16(spark, d):
    return B.scored(spark, d).where(D.dashboard_event(F.col("decision"), F.col("risk_score"))).select("transaction_id")


@query("p17_review_prompt", f"""WITH {B.SCORED}, x AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN (k % 2)::INTEGER END AS first, k * 0.25::DOUBLE AS ratio FROM scored WHERE decision = 'review')
SELECT transaction_id, 'TRANSACTION REVIEW REQUEST' || chr(10) || chr(10) || 'Transaction ID: ' || transaction_id || chr(10) || 'Institution:    ' || client_id || chr(10) || 'Model score:    ' || format('{{:.4f}}', risk_score) || ' (REVIEW zone: 0.30-0.80)'
  || chr(10) || chr(10) || 'TRANSACTION FEATURES:' || chr(10) || '{{' || chr(10) || array_to_string([p FOR p IN ['  "modality": "' || modality || '"', '  "is_first_time_receiver": ' || first, '  "balance_drain_ratio": ' || ratio, '  "hour_of_day": ' || hour(ts)] IF p IS NOT NULL], ',' || chr(10)) || chr(10) || '}}'
  || chr(10) || chr(10) || 'MODEL EXPLANATION (strongest features):' || chr(10) || '  balance_drain_ratio: value=' || format('{{:.4f}}', ratio) || ', contribution=' || CASE WHEN k >= 50 THEN '+' ELSE '' END || format('{{:.4f}}', (k - 50) / 8::DOUBLE) || CASE WHEN k > 50 THEN ' (↑ fraud)' ELSE ' (↓ fraud)' END
  || chr(10) || chr(10) || 'Is this FRAUD (1) or LEGITIMATE (0)?' AS prompt FROM x""")
def p17(spark, d):
    s = B.scored(spark, d).where("decision = 'review'")
    s = s.select("transaction_id", "client_id", "risk_score", "modality", "event_id", F.when(F.col("event_id") % 5 != 0, (F.col("k") % 2).cast("int")).alias("is_first_time_receiver"), (F.col("k") * 0.25).alias("balance_drain_ratio"), F.hour("ts").alias("hour_of_day"), F.lit(None).cast("int").alias("count_1h"), "k")
    s = s.withColumn("why", F.array(F.struct(F.lit("balance_drain_ratio").alias("feature"), F.col("balance_drain_ratio").alias("value"), ((F.col("k") - 50) / F.lit(8.0)).alias("contribution"))))
    return s.select("transaction_id", D.review_prompt(s, "transaction_id", "client_id", "risk_score", "why").alias("prompt"))


@query("p18_parse_label", f"""WITH {B.TXN} SELECT transaction_id, CASE WHEN k % 4 < 2 AND k <= 100 THEN (k % 4)::INTEGER END AS label, CASE WHEN k % 4 < 2 AND k <= 100 THEN k / 100::DOUBLE END AS confidence FROM txn""")
def p18(spark, d):
    answer = F.format_string('```json\n{"label": %s, "confidence": %s, "reason": "r"}\n```', (F.col("k") % 4).cast("string"), (F.col("k") / F.lit(100).cast("double")).cast("string"))
    t = B.txn(spark, d).withColumn("p", D.parse_label(answer))
    return t.select("transaction_id", "p.label", "p.confidence")


@query("p19_label_weight", f"WITH {B.TXN}, {B.LABELS} SELECT transaction_id, (CASE WHEN confidence >= 0.85 THEN 1.0 WHEN confidence >= 0.70 THEN 0.7 ELSE 0.4 END)::DOUBLE AS weight FROM labels_tbl WHERE confidence >= 0.70")
def p19(spark, d):
    return B.labels_tbl(spark, d).where("confidence >= 0.70").select("transaction_id", D.label_weight(F.col("confidence")).alias("weight"))


_SOURCES = ["simulator", "elliptic_real", "elliptic_seeded", "alchemy_real", "alchemy_legit", "finbridge_prod", "alchemy_tornado_cash", None]


@query("p20_source_confidence", """WITH s AS (SELECT event_id, ['simulator', 'elliptic_real', 'elliptic_seeded', 'alchemy_real', 'alchemy_legit', 'finbridge_prod', 'alchemy_tornado_cash', NULL][(event_id % 8 + 1)::INTEGER] AS source FROM events)
SELECT event_id, (CASE source WHEN 'simulator' THEN 0.50 WHEN 'elliptic_real' THEN 1.00 WHEN 'elliptic_seeded' THEN 0.85 WHEN 'alchemy_real' THEN 0.75 WHEN 'alchemy_legit' THEN 0.70 WHEN 'finbridge_prod' THEN 0.55 ELSE 0.50 END)::DOUBLE AS source_confidence FROM s""")
def p20(spark, d):
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("event_id") % 8 + 1).cast("int"))
    return B.table(spark, d, "events").select("event_id", R.source_confidence(source).alias("source_confidence"))


@query("p21_usd_repair", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, value * 2800) AS amount_usd FROM events")
def p21(spark, d):
    return B.table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.col("value") * 2800).alias("amount_usd"))


@query("p22_positive_dedupe", f"""WITH {B.TXN}, p AS (SELECT event_id, identity * 1000 + k AS hash, amount_usd - 20 AS amount_usd FROM txn)
SELECT hash, min(event_id) AS event_id FROM p WHERE amount_usd > 0 GROUP BY hash""")
def p22(spark, d):
    t = B.txn(spark, d).select("event_id", (F.col("identity") * 1000 + F.col("k")).alias("hash"), (F.col("amount_usd") - 20).alias("amount_usd"))
    return first_by(t, "hash", "event_id").select("hash", "event_id")


@query("p24_embedding_columns", "SELECT vec_id, embedding[1]::DOUBLE AS gnn_emb_0, embedding[2]::DOUBLE AS gnn_emb_1, embedding[64]::DOUBLE AS gnn_emb_63 FROM embeddings")
def p24(spark, d):
    v = R.embedding_or_zero(F.col("embedding").cast("array<double>"), 64)
    return B.table(spark, d, "embeddings").select("vec_id", *(v[i].alias(f"gnn_emb_{i}") for i in (0, 1, 63)))


@query("p25_pad_vectors", "SELECT vec_id, len(embedding) + 6 AS size, embedding[3]::DOUBLE AS third, 0.0::DOUBLE AS last FROM embeddings")
def p25(spark, d):
    v = R.padded(F.col("embedding").cast("array<double>"), 70)
    return B.table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("size"), v[2].alias("third"), v[69].alias("last"))


@query("p26_json_number", f"WITH {B.TXN} SELECT event_id, k::DOUBLE AS k FROM txn WHERE k IS NOT NULL")
def p26(spark, d):
    return B.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k")).where("k IS NOT NULL")


@query("p27_boolish", """SELECT event_id, (CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END)::DOUBLE AS is_weekend, (CASE WHEN event_id % 4 = 0 THEN -1 WHEN event_id % 4 = 1 THEN 1 ELSE 0 END)::DOUBLE AS is_real_data,
  CASE WHEN event_id % 7 = 0 THEN -1 ELSE value END AS amount_usd, -1.0::DOUBLE AS absent FROM events""")
def p27(spark, d):
    i = F.col("event_id")
    word = F.when(i % 6 == 0, "True").when(i % 6 == 1, "true").when(i % 6 == 2, "False").when(i % 6 == 3, "maybe").when(i % 6 == 4, "TRUE")
    e = B.table(spark, d, "events").select("event_id", word.alias("is_weekend"), F.when(i % 4 != 0, i % 4 == 1).alias("is_real_data"), F.when(i % 7 != 0, F.col("value")).alias("amount_usd"), F.lit(1).alias("unknown_to_the_model"))
    return R.aligned(e, ["is_weekend", "is_real_data", "amount_usd", "absent"], keep=["event_id"])


@query("p28_nan_to_zero", "SELECT vec_id, round(list_sum([CASE WHEN x > 0 THEN x ELSE 0 END FOR x IN embedding::DOUBLE[]]), 4) AS total FROM embeddings")
def p28(spark, d):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0, x).otherwise(float("nan")))
    return B.table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(R.no_nan(v), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("p29_alignment_report", f"""WITH {B.TXN} SELECT count(*) AS n, 5 AS expected, (5 - len(missing))::INTEGER AS present, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'pass' WHEN len(missing) <= 5 THEN 'warn' ELSE 'fail' END AS verdict
FROM txn, (SELECT [x FOR x IN [CASE WHEN count(amount_usd) = 0 THEN 'amount_usd' END, CASE WHEN count(k) = 0 THEN 'k' END, 'count_1h', CASE WHEN count(CASE WHEN k > 1000 THEN k END) = 0 THEN 'large_k' END] IF x IS NOT NULL] AS missing FROM txn) GROUP BY missing""")
def p29(spark, d):
    t = B.txn(spark, d).withColumn("large_k", F.when(F.col("k") > 1000, F.col("k")))
    return R.alignment_report(t, ["amount_usd", "k", "risk_score", "count_1h", "large_k"]).withColumn("missing", F.array_join("missing", ","))


@query("p30_human_routing", f"WITH {B.SCORED} SELECT transaction_id, decision = 'review' AND amount_usd >= 60 AS human FROM scored")
def p30(spark, d):
    return B.scored(spark, d).select("transaction_id", D.needs_human(F.col("decision"), F.col("amount_usd"), 60.0).alias("human"))


@query("p31_binary_decision", f"WITH {B.TXN} SELECT transaction_id, CASE WHEN risk_score >= 0.62 THEN 'block' ELSE 'approve' END AS decision FROM txn")
def p31(spark, d):
    return B.txn(spark, d).select("transaction_id", D.binary_decision(F.col("risk_score"), 0.62).alias("decision"))


def _range(name: str, width: int) -> str:
    over = f"OVER (PARTITION BY identity ORDER BY ts_us RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"
    return f"count(*) {over} AS count_{name}, round(sum(amount_usd::DECIMAL(18,6)) {over}::DOUBLE, 2) AS sum_{name}"


@query("w1_velocity", f"WITH {B.TXN} SELECT event_id, {_range('1h', H)}, {_range('6h', 6 * H)}, {_range('24h', 24 * H)}, {_range('7d', WK - 1)} FROM txn")
def w1(spark, d):
    v = W.velocity(B.txn(spark, d))
    return v.select("event_id", *(f"{k}_{n}" for n in ("1h", "6h", "24h", "7d") for k in ("count", "sum")))


@query("w2_w4_baseline", f"""WITH {B.TXN}, a AS (SELECT event_id, amount_usd, count(*) OVER d1 AS c24, count(*) OVER w AS n7, min(ts_us) OVER w AS t0, ts_us, round(sum(amount_usd::DECIMAL(18,4)) OVER w::DOUBLE / count(amount_usd) OVER w + 1e-9, 2) AS baseline_amount FROM txn
  WINDOW w AS (PARTITION BY identity ORDER BY ts_us RANGE BETWEEN {WK - 1} PRECEDING AND CURRENT ROW), d1 AS (PARTITION BY identity ORDER BY ts_us RANGE BETWEEN {24 * H} PRECEDING AND CURRENT ROW)),
b AS (SELECT *, round(n7 / greatest((ts_us - t0) / {24 * H}::DOUBLE, 1.0), 4) AS baseline_rate FROM a)
SELECT event_id, baseline_rate, baseline_amount, round(c24 / greatest(baseline_rate, 0.1), 3) AS velocity_ratio, round(amount_usd / greatest(baseline_amount, 1.0), 3) AS amount_ratio FROM b""")
def w2(spark, d):
    return W.baseline(B.txn(spark, d)).select("event_id", "baseline_rate", "baseline_amount", "velocity_ratio", "amount_ratio")


@query("w5_w9_cross_client", f"""WITH {B.TXN}, p AS (
  SELECT a.event_id, any_value(a.amount_usd) AS amount_usd, count(DISTINCT b.client_id) AS institution_count,
    count(*) FILTER (b.client_id <> a.client_id AND b.ts_us >= a.ts_us - {H}) AS cross_client_velocity,
    count(*) FILTER (b.client_id <> a.client_id) AS n, sum(b.amount_usd::DECIMAL(18,4)) FILTER (b.client_id <> a.client_id) AS s,
    coalesce(max((b.modality = 'fiat')::INTEGER), 0) AS has_fiat_history, coalesce(max((b.modality = 'crypto')::INTEGER), 0) AS has_crypto_history
  FROM txn a LEFT JOIN txn b ON a.identity = b.identity AND b.ts_us >= a.ts_us - {WK} AND b.ts_us < a.ts_us GROUP BY a.event_id)
SELECT event_id, institution_count::INTEGER AS institution_count, cross_client_velocity, has_fiat_history, has_crypto_history,
  round(CASE WHEN n > 0 THEN least(greatest(1 - abs(amount_usd - s::DOUBLE / n) / greatest(s::DOUBLE / n, 1.0), 0), 1) ELSE 0 END, 4) AS amount_correlation,
  has_fiat_history * has_crypto_history AS cross_modal_pattern_detected FROM p""")
def w5(spark, d):
    c = W.cross_client(B.txn(spark, d))
    return c.select("event_id", "institution_count", "cross_client_velocity", "has_fiat_history", "has_crypto_history", "amount_correlation", "cross_modal_pattern_detected")


@query("w8_time_since_other_client", f"""WITH {B.TXN} SELECT a.event_id, round((a.ts_us - max(b.ts_us)) / 1000000::DOUBLE, 1) AS time_since_other_institution_sec
FROM txn a LEFT JOIN txn b ON a.identity = b.identity AND a.client_id <> b.client_id AND b.ts_us < a.ts_us AND b.ts_us >= a.ts_us - {WK} GROUP BY a.event_id, a.ts_us""")
def w8(spark, d):
    return W.time_since_other_client(B.txn(spark, d)).select("event_id", "time_since_other_institution_sec")


@query("w10_prior_high_risk", f"""WITH {B.TXN} SELECT a.event_id, coalesce(max((b.risk_score >= 0.70)::INTEGER), 0) AS prior_high_risk
FROM txn a LEFT JOIN txn b ON a.identity = b.identity AND a.client_id <> b.client_id AND b.ts_us < a.ts_us AND b.ts_us >= a.ts_us - {WK} GROUP BY a.event_id""")
def w10(spark, d):
    return W.prior_high_risk(B.txn(spark, d)).select("event_id", "prior_high_risk")


@query("w11_lifetime", f"""WITH {B.TXN}, a AS (SELECT event_id, amount_usd, count(*) OVER w AS lifetime_count, sum(amount_usd::DECIMAL(18,4)) OVER w::DOUBLE AS v FROM txn
  WINDOW w AS (PARTITION BY identity ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, lifetime_count, round(v, 2) AS lifetime_volume, round(amount_usd / greatest(v / lifetime_count, 1.0), 3) AS lifetime_amount_ratio FROM a""")
def w11(spark, d):
    return W.lifetime(B.txn(spark, d)).select("event_id", "lifetime_count", "lifetime_volume", "lifetime_amount_ratio")


@query("w12_first_time_receiver", f"WITH {B.TXN} SELECT event_id, (row_number() OVER (PARTITION BY identity, receiver ORDER BY ts_us, event_id) = 1)::INTEGER AS is_first_time_receiver FROM txn")
def w12(spark, d):
    return W.first_time_receiver(B.txn(spark, d)).select("event_id", "is_first_time_receiver")


@query("w13_balance_drain", """SELECT o_orderkey, round(CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal ELSE 0 END, 4) AS balance_drain_ratio, greatest(c_acctbal - o_totalprice, 0) AS balance_after
FROM orders JOIN customer ON o_custkey = c_custkey""")
def w13(spark, d):
    o = B.table(spark, d, "orders").hint("merge").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", *(c.alias(k) for k, c in W.balance_drain("o_totalprice", "c_acctbal").items()))


@query("w14_latest_snapshot", f"""WITH {B.TXN}, r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY ts_us DESC, event_id DESC) AS n FROM txn)
SELECT identity, ts_us, event_id, client_id, amount_usd, round(risk_score, 6) AS risk_score FROM r WHERE n = 1 AND ts_us >= (SELECT max(ts_us) FROM txn) + 89 * {24 * H} + 23 * {H} - 90 * {24 * H}""")
def w14(spark, d):
    """As seen 89 days and 23 hours after the newest event, so that identities idle for more than an hour then have run out."""
    t = B.txn(spark, d)
    return W.latest_snapshot(t, F.lit(newest_us(t) + 89 * 24 * H + 23 * H)).withColumn("risk_score", F.round("risk_score", 6))


@query("w1_velocity_slots", f"WITH {B.TXN} SELECT event_id, {_range('1h', H)}, {_range('6h', 6 * H)}, {_range('24h', 24 * H)}, {_range('7d', WK - 1)} FROM txn")
def w1s(spark, d):
    """The exact windows with every identity cut into slots of a week, so that a hot identity is no single task."""
    v = W.in_slots(B.txn(spark, d), W.velocity)
    return v.select("event_id", *(f"{k}_{n}" for n in ("1h", "6h", "24h", "7d") for k in ("count", "sum")))


@query("w5_w9_cross_client_slots", ORACLE_SQL["w5_w9_cross_client"])
def w5s(spark, d):
    c = W.in_slots(B.txn(spark, d), W.cross_client)
    return c.select("event_id", "institution_count", "cross_client_velocity", "has_fiat_history", "has_crypto_history", "amount_correlation", "cross_modal_pattern_detected")


@query("w1_hour_buckets", f"""WITH {B.TXN}, b AS (SELECT identity, ts_us // {H} AS hour, count(*) AS n, sum(amount_usd::DECIMAL(18,4)) AS v FROM txn GROUP BY ALL)
SELECT identity, hour, sum(n) OVER w::BIGINT AS count_hours, round(sum(v) OVER w::DOUBLE, 2) AS sum_hours FROM b WINDOW w AS (PARTITION BY identity ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def w1b(spark, d):
    return W.hour_buckets(B.txn(spark, d))


@query("w8_time_since_other_client_ranges", ORACLE_SQL["w8_time_since_other_client"])
def w8r(spark, d):
    """Every identity cut by ranges; the last row at another client is carried from range to range."""
    return W.time_since_other_client_ranges(B.txn(spark, d)).select("event_id", "time_since_other_institution_sec")


@query("w11_lifetime_ranges", ORACLE_SQL["w11_lifetime"])
def w11r(spark, d):
    return W.lifetime_ranges(B.txn(spark, d)).select("event_id", "lifetime_count", "lifetime_volume", "lifetime_amount_ratio")
