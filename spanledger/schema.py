"""Table schemas and fixed value lists of the subscription-lifecycle data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_S, _D, _I, _B, _TS = T.StringType(), T.DateType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()

ACCOUNTS = _struct(
    ("account_id", _S, False),
    ("account_name", _S, False),
    ("industry", _S, False),
    ("country", _S, False),
    ("signup_date", _D, False),
    ("referral_source", _S, False),
    ("plan_tier", _S, False),
    ("seats", _I, False),
    ("is_trial", _B, False),
    ("churn_flag", _B, False),
)

# end_date NULL means "still open"; it is never imputed.
SUBSCRIPTIONS = _struct(
    ("subscription_id", _S, False),
    ("account_id", _S, False),
    ("start_date", _D, False),
    ("end_date", _D, True),
    ("plan_tier", _S, False),
    ("seats", _I, False),
    ("mrr_amount", T.DecimalType(12, 2), False),
    ("arr_amount", T.DecimalType(12, 2), False),
    ("is_trial", _B, False),
    ("upgrade_flag", _B, False),
    ("downgrade_flag", _B, False),
    ("churn_flag", _B, False),
    ("billing_frequency", _S, False),
    ("auto_renew_flag", _B, False),
)

# usage_id is not unique, so nothing may de-duplicate on it.
FEATURE_USAGE = _struct(
    ("usage_id", _S, False),
    ("subscription_id", _S, False),
    ("usage_date", _D, False),
    ("feature_name", _S, False),
    ("usage_count", _I, False),
    ("usage_duration_secs", _I, False),
    ("error_count", _I, False),
    ("is_beta_feature", _B, False),
)

SUPPORT_TICKETS = _struct(
    ("ticket_id", _S, False),
    ("account_id", _S, False),
    ("submitted_at", _TS, False),
    ("closed_at", _TS, False),
    ("resolution_time_hours", T.DecimalType(10, 2), False),
    ("priority", _S, False),
    ("first_response_time_minutes", _I, False),
    ("satisfaction_score", T.DecimalType(3, 1), True),
    ("escalation_flag", _B, False),
)

CHURN_EVENTS = _struct(
    ("churn_event_id", _S, False),
    ("account_id", _S, False),
    ("churn_date", _D, False),
    ("reason_code", _S, False),
    ("refund_amount_usd", T.DecimalType(10, 2), False),
    ("preceding_upgrade_flag", _B, False),
    ("preceding_downgrade_flag", _B, False),
    ("is_reactivation", _B, False),
    ("feedback_text", _S, True),
)

TABLES = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": FEATURE_USAGE,
    "support_tickets": SUPPORT_TICKETS,
    "churn_events": CHURN_EVENTS,
}

# Domains that appear as result columns.
PLAN_TIERS = ("Basic", "Pro", "Enterprise")
PRIORITIES = ("low", "medium", "high", "urgent")

# Declared keys, foreign keys and inventoried fields.
PRIMARY_KEYS = {
    "accounts": "account_id",
    "subscriptions": "subscription_id",
    "support_tickets": "ticket_id",
    "churn_events": "churn_event_id",
}
FOREIGN_KEYS = (
    ("subscriptions", "accounts", "account_id"),
    ("feature_usage", "subscriptions", "subscription_id"),
    ("support_tickets", "accounts", "account_id"),
    ("churn_events", "accounts", "account_id"),
)
CATEGORY_FIELDS = (
    ("referral_source", "accounts", "referral_source"),
    ("plan_tier (accounts)", "accounts", "plan_tier"),
    ("plan_tier (subscriptions)", "subscriptions", "plan_tier"),
    ("reason_code", "churn_events", "reason_code"),
    ("priority", "support_tickets", "priority"),
)
