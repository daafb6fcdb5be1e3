"""Validation, normalisation and typing of transaction records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "^[0-9a-f]{64}$"
# Patterns of personal data.
PII = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
# Trust in the sources of training rows.
SOURCE_CONFIDENCE = {
    "simulator": 0.50,
    "elliptic_real": 1.00,
    "elliptic_seeded": 0.85,
    "alchemy_real": 0.75,
    "alchemy_legit": 0.70,
    "finbridge_prod": 0.55,
}
# What stands for an absent input of the model.
PASSTHROUGH = {
    "amount_usd": -1.0,
    "sender_account_age_days": -1,
    "sender_kyc_status": "unknown",
    "sender_archetype": "unknown",
    "is_first_time_receiver": 0,
    "balance_drain_ratio": -1.0,
    "sender_balance_before": -1.0,
    "modality": "fiat",
    "transfer_type": "unknown",
    "transfer_network": "unknown",
    "client_id": "unknown",
    "known_mixer_interaction": 0,
    "receiver_wallet_age_days": -1,
    "receiver_wallet_type": "unknown",
    "cryptocurrency": "",
    "blockchain": "",
    "gas_price_gwei": -1,
    "source_confidence": 0.5,
    "is_real_data": 0,
}
# Columns that would tell a model the label, and identifiers.
LEAKAGE = [
    "transaction_id", "sender_hash", "receiver_hash", "identity_hash",
    "user_email_hash", "sender_wallet_hash", "receiver_wallet_hash",
    "sender_device_hash", "sender_ip_hash", "transaction_hash",
    "fraud_network_id", "cross_modality_fraud_id", "linked_fiat_transaction",
    "fraud_type", "cross_modality_pattern",
    "timestamp", "source", "source_address", "source_label",
    "node", "entity", "entity_base", "entity_cluster", "amount_bucket", "hour",
    "elliptic_feature_2", "elliptic_feature_3", "elliptic_feature_4",
    "immediate_withdrawal", "known_mixer_interaction",
]
# Those of them that are dropped before features are built.
LEAKAGE_EARLY = [
    "fraud_type", "fraud_network_id", "cross_modality_fraud_id", "cross_modality_pattern",
    "transaction_id", "transaction_hash", "linked_fiat_transaction",
]
# The flags and numbers of the feature table.
FLAGS = [
    "is_first_time_receiver", "is_unusual_hour", "is_weekend",
    "is_business_hour", "known_mixer_interaction", "immediate_withdrawal",
    "has_fiat_history", "has_crypto_history", "cross_modal_pattern_detected",
    "prior_high_risk_event", "receiver_is_recycled_address",
    "is_real_data", "graph_only",
]
NUMBERS = [
    "amount_usd", "amount_crypto", "balance_drain_ratio",
    "velocity_ratio", "amount_ratio", "source_confidence",
    "fan_in_ratio", "sender_out_degree", "receiver_in_degree",
    "sender_total_volume_graph", "receiver_avg_incoming",
]


def salted_hash(value: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)


def rejection_reasons(now: Column, clients: Iterable[str] = ("neobank", "cryptoex", "finbridge"), hashes: Iterable[str] = ("identity_hash", "sender_hash", "user_email_hash", "sender_wallet_hash")) -> Column:
    """Names of the rules that a record breaks; empty for a valid record."""
    hashes = list(hashes)
    size, amount, ts = F.length("transaction_id"), F.col("amount_usd"), F.try_to_timestamp(F.col("timestamp"))
    broken = {
        "transaction_id": size.isNull() | ~size.between(5, 128),
        "amount": amount.isNull() | F.isnan(amount) | (amount <= 0) | (amount >= 50_000_000),
        "client": F.col("client_id").isNull() | ~F.col("client_id").isin(*clients),
        "modality": F.col("modality").isNull() | ~F.col("modality").isin("fiat", "crypto"),
        "timestamp": ts.isNull() | (ts > now + F.expr("INTERVAL 1800 SECONDS")),
        "identity": F.coalesce(*(F.nullif(F.col(h), F.lit("")) for h in hashes)).isNull(),
        **{h: F.col(h).isNotNull() & (F.col(h) != "") & ~F.col(h).rlike(HASH) for h in hashes},
    }
    return F.array_compact(F.array(*(F.when(cond, reason) for reason, cond in broken.items())))


def pii_fields(columns: Iterable[str]) -> Column:
    """``column:kind`` for each kind of personal data found in each column; names that begin with _ are left out."""
    return F.array_compact(F.array(*(F.when(F.col(c).rlike(p), f"{c}:{kind}") for c in columns if not c.startswith("_") for kind, p in PII.items())))


def canonical_identity(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def identity_error(identity: Column) -> Column:
    return F.when(identity.isNull(), "missing_identity_hash")


def normalised_time(text: Column, now: Column) -> Column:
    """UTC time of an ISO text (without offset: UTC); ``now`` if it can't be read."""
    return F.coalesce(F.try_to_timestamp(text), now)


def temporal(ts: str) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour, "day_of_week": day, "is_weekend": (day >= 5).cast("int"), "is_unusual_hour": ((hour < 6) | (hour >= 23)).cast("int"),
        "is_business_hours": (hour.between(9, 17) & (day < 5)).cast("int"),
    }


def contract(df: DataFrame, bools: Iterable[str] = (), floats: Iterable[str] = (), categories: Iterable[str] = (), ids: Iterable[str] = (), times: Iterable[str] = (), category_null: str = "unknown") -> DataFrame:
    """Typed columns: bool from number or word (null false), float null 0, category and id texts ("nan" counts as missing), times null if unreadable."""
    def flag(c: str) -> Column:
        word = F.lower(F.col(c).cast("string"))
        return F.coalesce(F.when(word.isin("true", "false"), word == "true").otherwise(F.try_to_number(word, F.lit("999999999999.999")) != 0) if df.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double") != 0, F.lit(False))

    def text(c: str, missing: str) -> Column:
        word = F.col(c).cast("string")
        return F.coalesce(F.when(F.lower(word) != "nan", word), F.lit(missing))

    made = {c: flag(c) for c in bools} | {c: F.coalesce(F.nanvl(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)), F.lit(0.0)) for c in floats}
    made |= {c: text(c, category_null) for c in categories} | {c: text(c, "") for c in ids} | {c: F.try_to_timestamp(F.col(c).cast("string")) for c in times}
    return df.withColumns(made) if made else df


def passthrough(df: DataFrame) -> DataFrame:
    """The inputs of ``PASSTHROUGH``: absent columns and nulls as their defaults, in the defaults' types."""
    kinds = {int: "int", float: "double", str: "string"}
    made = {}
    for name, default in PASSTHROUGH.items():
        kind = kinds[type(default)]
        value = F.lit(default).cast(kind)
        made[name] = F.coalesce(F.expr(f"try_cast(`{name}` AS {kind})"), value) if name in df.columns else value
    return df.withColumns(made)


def without_leakage(df: DataFrame, names: Iterable[str] = LEAKAGE) -> DataFrame:
    """The columns that a model may see; names that ``df`` lacks are no error."""
    return df.drop(*names)


def feature_contract(df: DataFrame) -> DataFrame:
    """Types of a feature table: its ``FLAGS`` null false, ``NUMBERS`` as float (unreadable null), ``gnn_emb_*`` null 0, texts "nan" and null as "" (``timestamp`` stays)."""
    here = set(df.columns)
    flags = [c for c in FLAGS if c in here]
    df = contract(df, bools=flags)
    made = {c: F.expr(f"try_cast(`{c}` AS float)") for c in NUMBERS if c in here}
    made |= {c: F.coalesce(F.nanvl(F.col(c).cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float")) for c in df.columns if c.startswith("gnn_emb_")}
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in {*made, "timestamp"}]
    made |= {c: F.coalesce(F.when(F.col(c) != "nan", F.col(c)), F.lit("")) for c in texts}
    return df.withColumns(made) if made else df


def source_confidence(source: Column, default: float = 0.5) -> Column:
    table = F.create_map(*(c for k, v in SOURCE_CONFIDENCE.items() for c in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(table, source), F.lit(default))


def boolish(value: Column) -> Column:
    """1 for True, "True" and "true", 0 for False in these writings; other texts and null -1."""
    word = value.cast("string")
    return F.when(word.isin("true", "True"), 1).when(word.isin("false", "False"), 0).otherwise(-1)


def aligned(df: DataFrame, features: Iterable[str], missing: float = -1.0, keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the named feature columns, in order: words of ``boolish`` as 1 and 0, other texts, nulls and absent columns as ``missing``; before them the columns ``keep``."""
    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(missing)
        c = F.col(name)
        if df.schema[name].dataType.simpleString() in ("string", "boolean"):
            c = F.when(boolish(c) >= 0, boolish(c))
        return F.coalesce(c.cast("double"), F.lit(missing))

    return df.select(*keep, *(number(f).alias(f) for f in features))


def alignment_report(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """``n, expected, present, missing, verdict`` in one row: a feature is present if some row of the table has a value of it.

    Pass without missing ones, warn up to five, else fail. One pass over the named columns.
    """
    features = list(features)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(f).alias(f"_{i}") for i, f in enumerate(features) if f in df.columns))
    absent = [F.when(F.col(f"_{i}") == 0, f) if f in df.columns else F.lit(f) for i, f in enumerate(features)]
    out = counts.select("n", F.array_compact(F.array(*absent)).alias("missing"))
    size = F.size("missing")
    verdict = F.when(size == 0, "pass").when(size <= 5, "warn").otherwise("fail")
    return out.select("n", F.lit(len(features)).alias("expected"), (F.lit(len(features)) - size).alias("present"), "missing", verdict.alias("verdict"))


def padded(vector: Column, size: int) -> Column:
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)


def embedding_or_zero(vector: Column, size: int) -> Column:
    """The vector if it has ``size`` components, else zeros."""
    return F.when(F.size(vector) == size, vector).otherwise(F.array_repeat(F.lit(0.0), size))


def no_nan(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


# What each node feature is divided by.
NODE_SCALES = {"out_degree": 1000.0, "in_degree": 1000.0, "avg_out": 1e5, "sum_out": 1e6, "avg_in": 1e5, "fan_in": 100.0, "volume_per_txn": 1e5}


def scaled_node(name: str) -> Column:
    return F.least(F.col(name) / NODE_SCALES[name], F.lit(1.0))
