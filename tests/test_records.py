from pyspark.sql import functions as F

from riskweave.functions import decisions as D
from riskweave.functions import records as R


def test_rejections(spark):
    ok = "a" * 64
    columns = "transaction_id string, amount_usd double, client_id string, modality string, timestamp string, identity_hash string, sender_hash string, user_email_hash string, sender_wallet_hash string"
    rows = [
        ("t12345", 1.0, "neobank", "fiat", "2024-01-01T00:00:00Z", ok, None, None, None),
        ("t1", 1.0, "neobank", "fiat", "2024-01-01T00:00:00Z", ok, None, None, None),
        ("t12345", 0.0, "who", "cash", "soon", "", "", None, None),
        ("t12345", 1.0, "neobank", "fiat", "2099-01-01T00:00:00Z", "XYZ", None, None, None),
        (None, None, None, None, None, None, None, None, None),
    ]
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    got = [r["r"] for r in spark.createDataFrame(rows, columns).select(R.rejection_reasons(now).alias("r")).collect()]
    assert got[0] == [] and got[1] == ["transaction_id"]
    assert set(got[2]) == {"amount", "client", "modality", "timestamp", "identity"}
    assert set(got[3]) == {"timestamp", "identity_hash"}
    assert {"transaction_id", "amount", "client", "modality", "timestamp", "identity"} == set(got[4])


def test_pii(spark):
    df = spark.createDataFrame([("write to a@b.com", "555-123-4567", "123-45-6789"), ("clean", None, "a@b.com"), ("5551234567", "555 123 4567", ""), ("a1234567890", "a@b", "x"), ("123-45-6789", "555.123.4567 x+y.z@d-e.f", "")], "text string, phone string, _private string")
    want = [["text:email", "phone:phone"], [], ["text:phone", "phone:phone"], [], ["text:ssn", "phone:email", "phone:phone"]]
    assert [r["f"] for r in df.select(R.pii_fields(df.columns).alias("f")).collect()] == want


def test_source_confidence(spark):
    want = {"simulator": 0.5, "elliptic_real": 1.0, "elliptic_seeded": 0.85, "alchemy_real": 0.75, "alchemy_legit": 0.7, "finbridge_prod": 0.55, "alchemy_tornado_cash": 0.5, None: 0.5}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r[0]: r[1] for r in df.select("s", R.source_confidence(F.col("s"))).collect()} == want


def test_tables():
    assert (len(R.PASSTHROUGH), len(R.LEAKAGE), len(set(R.LEAKAGE)), len(R.FLAGS), len(R.NUMBERS), len(D.FEATURE_TEXTS), len(D.PROMPT_FEATURES)) == (19, 30, 30, 13, 11, 12, 24)


def test_numbers_round_their_exact_value(spark):
    """Halves to even and by the exact value, not by the shortest digits; minus zero keeps its sign."""
    values = [0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 0.15, 0.25, 0.35, 1.005, -0.0, 0.0, -0.04, 123456.5, 1234.5, 1235.5, 0.00012345, 12345.0, 1e5, 1.5e-7, 9999.5, 99995.0, 1048575.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(*(D.fixed(F.col("v"), k) for k in (0, 1, 2, 4)), D.fixed(F.col("v"), 4, sign=True), D.short_number(F.col("v"))).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(f"{v:{f}}" for f in (".1f", ".2f", ".4f", "+.4f", ".4g")) for v in values]
    assert [r[0] for r in got] == [f"{v:.0f}" for v in values]
    told = lambda name, v: df.limit(1).select(D.feature_text(F.lit(name), F.lit(v))).first()[0]
    assert told("time_since_other_institution_sec", 30.0) == "Same identity at other institution 0m ago"
    assert told("velocity_ratio", 0.25) == "Velocity 0.2× above baseline" and told("k", -0.0) == "k: -0 (↓ risk)"


def test_short_numbers(spark):
    values = [0.0, 1.0, -1.0, 12345.6, 0.00012346, 0.000012346, 9999.6, 999.96, 1e-9, 3.0e20, 123.0, 100.0, 1000.0, 0.1, 7.7777777, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(D.short_number(F.col("v"))).collect()] == [f"{v:.4g}" for v in values]


def test_reasons(spark):
    rows = [([("velocity_ratio", 3.21), ("balance_drain_ratio", 0.876), ("odd_one", -12345.6), ("count_1h", 9.0)], True, True), ([("time_since_other_institution_sec", 930.0)], False, None), ([("count_1h", float("nan"))], None, False)]
    df = spark.createDataFrame(rows, "f array<struct<feature: string, value: double>>, mixer boolean, cross boolean")
    got = [r[0] for r in df.select(D.reasons(F.col("f"), F.col("mixer"), F.col("cross"))).collect()]
    assert got[0] == ["Fiat→crypto laundering pattern detected", "Known cryptocurrency mixer interaction", "Velocity 3.2× above baseline", "Balance drain: 88%", "odd_one: -1.235e+04 (↓ risk)"]
    assert got[1] == ["Same identity at other institution 16m ago"] and got[2] == ["count_1h: nan"]


def test_alert_amounts(spark):
    empty = F.array().cast("array<struct<feature: string, value: double, contribution: double>>")
    m = D.alert_message(F.lit("hold"), F.lit("t" * 40), F.lit("c"), F.lit(1234567.891), F.lit(0.5), F.array().cast("array<string>"), empty)
    r = spark.range(1).select(m.alias("m")).first()["m"]
    assert (r["amount"], r["id"], r["title"], r["color"], r["reasons"]) == ("$1,234,567.89", "t" * 24, "❓ Fraud Alert — HOLD", "#718096", "• (no reasons)")


def test_decision_edges(spark):
    s = spark.createDataFrame([(0.2999,), (0.30,), (0.80,), (0.8001,)], "s double")
    assert [r[0] for r in s.select(D.decide(F.col("s"), 0.30, 0.80)).collect()] == ["approve", "review", "review", "block"]
    assert [r[0] for r in s.select(D.decide(F.col("s"), 0.80, 0.30)).collect()][:2] == ["approve", "approve"]


def test_alert_edges(spark):
    rows = [("block", 0.9, 99.99, False), ("block", 0.9, 100.0, True), ("review", 0.5999, 200.0, False), ("review", 0.60, 200.0, True), ("approve", 0.9, 200.0, False), (None, 0.9, 200.0, False)]
    df = spark.createDataFrame(rows, "d string, s double, a double, want boolean")
    assert all(r[0] == r[1] for r in df.select(D.alert_eligible(F.col("d"), F.col("s"), F.col("a")), "want").collect())


def test_label_answers(spark):
    rows = [('```json\n{"label": 1, "confidence": 0.9}\n```', 1), ('{"label": 2, "confidence": 0.9}', None), ('{"label": 0, "confidence": 1.5}', None), ("no json", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, want int")
    assert all(r[0] == r[1] for r in df.select(D.parse_label(F.col("a"))["label"], "want").collect())


def test_contract(spark):
    df = spark.createDataFrame([("true", "x", "nan", None), ("0", "1.5", None, "7"), (None, None, "k", "nan")], "b string, f string, c string, i string")
    got = [tuple(r) for r in R.contract(df, ["b"], ["f"], ["c"], ["i"]).collect()]
    assert got == [(True, 0.0, "unknown", ""), (False, 1.5, "unknown", "7"), (False, 0.0, "k", "")]


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2, None, "True"), (1, 3, None, "no")], "a int, b int, c int, d string")
    assert R.alignment_report(df, ["a", "b"]).first()["verdict"] == "pass"
    warn = R.alignment_report(df, ["a", "z", "c"]).first()
    assert (warn["verdict"], warn["missing"], warn["present"], warn["n"]) == ("warn", ["z", "c"], 1, 2)
    assert R.alignment_report(df, list("uvwxyz")).first()["verdict"] == "fail"
    assert sorted(map(tuple, R.aligned(df, ["b", "z", "d"]).collect())) == [(2.0, -1.0, 1.0), (3.0, -1.0, -1.0)]
