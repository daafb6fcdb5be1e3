"""Decisions, reasons and alerts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts for the strongest features of a decision. v: the value, iv: its whole part, pct: 100 times, min: a sixtieth.
FEATURE_TEXTS = {
    "velocity_ratio": "Velocity {v:.1f}× above baseline",
    "cross_modal_pattern_detected": "Cross-institutional laundering pattern",
    "amount_ratio": "Amount {v:.1f}× above user average",
    "institution_count": "Appeared at {iv} institutions",
    "balance_drain_ratio": "Balance drain: {pct:.0f}%",
    "known_mixer_interaction": "Interaction with known crypto mixer",
    "is_first_time_receiver": "First-time receiver",
    "receiver_wallet_age_days": "Receiver wallet {iv} days old",
    "count_1h": "{iv} transactions in the past hour",
    "fan_in_ratio": "Fan-in ratio {v:.2f} (aggregator pattern)",
    "time_since_other_institution_sec": "Same identity at other institution {min:.0f}m ago",
    "sender_account_age_days": "Account only {iv} days old",
}
MIXER_TEXT = "Known cryptocurrency mixer interaction"
CROSS_MODAL_TEXT = "Fiat→crypto laundering pattern detected"
# Sign and colour of a decision in an alert.
ALERT_SIGNS = {"block": "🚨", "review": "⚠️", "approve": "✅"}
ALERT_COLORS = {"block": "#E53E3E", "review": "#DD6B20", "approve": "#38A169"}
# What a reviewer is shown of a transaction.
PROMPT_FEATURES = [
    "amount_usd", "modality", "transfer_network", "sender_account_age_days",
    "sender_archetype", "sender_kyc_status", "is_first_time_receiver",
    "balance_drain_ratio", "count_1h", "count_6h", "velocity_ratio",
    "velocity_baseline_daily", "amount_ratio", "institution_count",
    "cross_modal_pattern_detected", "known_mixer_interaction",
    "receiver_wallet_age_days", "receiver_wallet_type",
    "sender_out_degree", "receiver_in_degree", "fan_in_ratio",
    "hour_of_day", "prior_high_risk_event", "time_since_other_institution_sec",
]


def fixed(value: Column, digits: int, grouped: bool = False, sign: bool = False) -> Column:
    """``%.<digits>f`` of a double as Python and DuckDB give it: the exact value rounded, halves to even.

    ``format_string`` rounds the shortest digits and halves up. It still writes what isn't finite, and null as "null".
    """
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    text = F.format_number(value, digits)
    text = text if grouped else F.replace(text, F.lit(","), F.lit(""))
    text = F.concat(F.when(F.startswith(text, F.lit("-")), "").otherwise("+"), text) if sign else text
    return F.when(finite, text).otherwise(F.format_string(f"%{'+' if sign else ''}.{digits}f", value))


def short_number(value: Column) -> Column:
    """Four significant digits without trailing zeros, with an exponent beyond 10^-4 and 10^4 (``%.4g``)."""
    trim = lambda text: F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    bare = lambda text: F.regexp_replace(trim(text), r"\.$", "")
    scientific = lambda x: F.call_function("format_number", x, F.lit("0.000E0"))
    whole = (F.abs(value) < 2.0**53) & (value == F.rint(value))  # Java rounds whole doubles half up, whole decimals to even
    science = F.when(whole, scientific(F.when(whole, value).cast("decimal(16,0)"))).otherwise(scientific(value))
    power = F.substring_index(science, "E", -1).cast("int")
    plain = F.lit(None).cast("string")
    for k in range(-4, 4):
        plain = F.when(power == k, fixed(value, 0) if k == 3 else bare(fixed(value, 3 - k))).otherwise(plain)
    return (
        F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(value == 0, fixed(value, 0))
        .otherwise(F.coalesce(plain, F.concat(bare(F.substring_index(science, "E", 1)), F.lit("e"), F.format_string("%+03d", power))))
    )


def feature_text(feature: Column, value: Column) -> Column:
    """The text of a feature with its value filled in; features without one by name, value and direction."""
    from string import Formatter

    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    filled = {"v": value, "iv": value.cast("long"), "pct": value * 100, "min": value / 60}
    up = F.when(value > 0, "↑").otherwise("↓")
    out = F.concat(feature, F.lit(": "), short_number(value), F.lit(" ("), up, F.lit(" risk)"))
    for name, template in FEATURE_TEXTS.items():
        parts = []
        for text, field, spec, _ in Formatter().parse(template):
            parts.append(F.lit(text))
            if field:
                parts.append(fixed(filled[field], int(spec[1:-1])) if spec else filled[field].cast("string"))
        text = F.concat(*parts)
        out = F.when(feature == name, F.when(finite, text).otherwise(F.concat(feature, F.lit(": "), short_number(value)))).otherwise(out)
    return out


def decide(score: Column, approve: float, block: float) -> Column:
    """Below ``approve``: approve (tested first); above ``block``: block; both bounds themselves: review."""
    return F.when(score < approve, "approve").when(score > block, "block").otherwise("review")


def decision_code(decision: Column) -> Column:
    return F.when(decision == "approve", 0).when(decision == "block", 2).otherwise(1)


def binary_decision(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, "block").otherwise("approve")


def reasons(features: Column, mixer: Column, cross_modal: Column, most: int = 5) -> Column:
    """Texts of the first three features (structs ``feature, value``, strongest first); before them cross-modal, then mixer; five at most."""
    texts = F.transform(F.slice(features, 1, 3), lambda f: feature_text(f["feature"], f["value"].cast("double")))
    first = F.array_compact(F.array(F.when(cross_modal, CROSS_MODAL_TEXT), F.when(mixer, MIXER_TEXT)))
    return F.slice(F.concat(first, texts), 1, most)


def alert_eligible(decision: Column, score: Column, amount: Column, least_amount: float = 100.0, review_score: float = 0.60) -> Column:
    """Never approved ones; at least the amount; reviews only from the score on. Nulls are not eligible."""
    return F.coalesce((decision != "approve") & (amount >= least_amount) & ((decision != "review") | (score >= review_score)), F.lit(False))


def dashboard_event(decision: Column, score: Column) -> Column:
    return decision.isin("block", "review") & (score > 0.5)


def label_weight(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, 1.0).when(confidence >= 0.70, 0.7).otherwise(0.4)


def needs_human(decision: Column, amount: Column, limit: float = 50_000.0) -> Column:
    return (decision == "review") & (amount >= limit)


def top_contributions(contributions: Column, k: int = 5) -> Column:
    """The k structs (``feature``, ``contribution``) of the largest absolute contribution, ties by name."""
    order = lambda a, b: (
        F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    )
    return F.slice(F.array_sort(contributions, order), 1, k)


def _by_decision(decision: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(c for k, v in table.items() for c in (F.lit(k), F.lit(v)))), decision), F.lit(other))


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, "↑ fraud").otherwise("↓ fraud")


def alert_message(decision: Column, transaction_id: Column, client: Column, amount: Column, score: Column, why: Column, explanations: Column) -> Column:
    """Struct of an alert's parts: title with a sign, colour, id of 24 letters, client, score, amount, three reasons, five explanation lines.

    ``explanations``: structs ``feature, value, contribution``. Without reasons
    or explanations a line says so.
    """
    reason_lines = F.transform(F.slice(why, 1, 3), lambda r: F.concat(F.lit("• "), r))
    lines = F.transform(
        F.slice(explanations, 1, 5),
        lambda x: F.concat(F.lit("• "), F.replace(x["feature"], F.lit("_"), F.lit(" ")), F.lit(": `"), short_number(x["value"].cast("double")), F.lit("` ("), direction(x["contribution"]), F.lit(")")),
    )
    some = lambda lines, none: F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(none)
    return F.struct(
        F.concat(_by_decision(decision, ALERT_SIGNS, "❓"), F.lit(" Fraud Alert — "), F.upper(decision)).alias("title"),
        _by_decision(decision, ALERT_COLORS, "#718096").alias("color"), F.substring(transaction_id, 1, 24).alias("id"), client.alias("client"),
        fixed(score, 4).alias("score"), F.concat(F.lit("$"), fixed(amount, 2, grouped=True)).alias("amount"),
        some(reason_lines, "• (no reasons)").alias("reasons"), some(lines, "• (no explanation available)").alias("features"),
    )


def review_prompt(df: DataFrame, transaction_id: str, client: str, score: str, explanations: str) -> Column:
    """Text for a reviewer: header with the score, the ``PROMPT_FEATURES`` that ``df`` has as JSON (nulls drop out), five explanation lines.

    ``explanations``: a column of structs ``feature, value, contribution``.
    """
    here = [c for c in PROMPT_FEATURES if c in df.columns]
    json = lambda c: F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)")
    pairs = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'  "{c}": '), json(c))) for c in here))) if here else F.array().cast("array<string>")
    features = F.when(F.size(pairs) > 0, F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}"))).otherwise("{}")
    lines = F.transform(
        F.slice(F.col(explanations), 1, 5),
        lambda x: F.format_string("  %s: value=%s, contribution=%s (%s)", x["feature"], fixed(x["value"].cast("double"), 4), fixed(x["contribution"].cast("double"), 4, sign=True), direction(x["contribution"])),
    )
    # Headings and closing question of the prompt.
    return F.concat(
        F.lit("TRANSACTION REVIEW REQUEST\n\nTransaction ID: "), F.coalesce(F.col(transaction_id).cast("string"), F.lit("?")), F.lit("\nInstitution:    "), F.coalesce(F.col(client).cast("string"), F.lit("?")),
        F.lit("\nModel score:    "), fixed(F.col(score), 4), F.lit(" (REVIEW zone: 0.30-0.80)\n\nTRANSACTION FEATURES:\n"), features,
        F.lit("\n\nMODEL EXPLANATION (strongest features):\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("  (none available)"), F.lit("\n\nIs this FRAUD (1) or LEGITIMATE (0)?"),
    )


def parse_label(response: Column) -> Column:
    """Struct ``label, confidence, reason`` of a JSON answer, code fences stripped; null unless label is 0 or 1 and confidence within 0 and 1."""
    body = F.regexp_replace(F.trim(response), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(body, "label int, confidence double, reason string")
    return F.when(parsed["label"].isin(0, 1) & parsed["confidence"].between(0.0, 1.0), parsed)


def drift_severity(*severities: Column) -> Column:
    """The worst of none, medium, high and critical."""
    rank = lambda s: F.when(s == "critical", 3).when(s == "high", 2).when(s == "medium", 1).otherwise(0)
    worst = F.greatest(*map(rank, severities)) if len(severities) > 1 else rank(severities[0])
    return F.element_at(F.array(*map(F.lit, ("none", "medium", "high", "critical"))), worst + 1)


def age_severity(age_days: Column, most: int = 14) -> Column:
    """A model of ``most`` days or more has to be trained anew, whatever drifts."""
    return F.when(age_days >= most, "critical").otherwise("none")


def retrain_gate(new_labels: Column, severity: Column, dry_run: Column, force: Column | None = None, least: int = 100) -> Column:
    """What the retraining gate decides, first rule that holds; ``severity``: the worst of all, the model's age included. ``force`` passes over missing labels and missing drift."""
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    due = forced | severity.isin("high", "critical")
    return F.when(~forced & (new_labels < least), "waiting").when(~due & (severity == "medium"), "scheduled").when(~due, "stable").when(dry_run, "dry_run").otherwise("retrain")


def auc_drop(current: Column, baseline: Column) -> Column:
    return F.when(baseline - current > 0.10, "critical").when(baseline - current > 0.05, "high").otherwise("none")
