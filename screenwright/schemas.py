"""Table schemas, and conforming older tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMPTS = (
    "request_id string, user_id string, sub_user string, tool string, browser_name string, prompt string, "
    "testing boolean, ts timestamp"
)
ORGANIZATIONS = "org_id int, org_name string"
USERS = "user_id string, display_name string, role string, org_id int, created_at timestamp"
POLICIES = (
    "id int, user_id string, sub_user string, keyword_list string, allow_col boolean, redacted_col boolean, "
    "critical_col boolean, block_col boolean, prompt_col string"
)
AUDIT = (
    "id string, user_id string, tool string, browser_name string, original_prompt string, redacted_prompt string, "
    "highest_risk_type string, risk_score int, risk_level string, action string, action_reason string, "
    "processing_time_ms bigint, tokens_used int, tokens_saved int, cost_used double, cost_saved double, "
    "created_at timestamp"
)
HEARTBEATS = (
    "userId string, subUser string, browserName string, extensionVersion string, status string, timestamp string"
)
HEARTBEATS_NORMAL = "org_label string, subUser string, browserName string, ts timestamp"
ALERTS = "type string, userId string, message string, timestamp string"

AUDIT_COLUMNS = tuple(field.split()[0] for field in AUDIT.split(", "))

# What a column missing from an older table is filled with, and how old columns were spelt.
AUDIT_DEFAULTS = {
    "browser_name": ("string", "Unknown"),
    "tokens_used": ("int", 0),
    "tokens_saved": ("int", 0),
    "cost_used": ("double", 0.0),
    "cost_saved": ("double", 0.0),
}
USER_DEFAULTS = {"org_id": ("int", None)}
POLICY_RENAMES = {"critial_col": "critical_col"}


def conform(df: DataFrame, defaults: dict[str, tuple[str, object]], renames: dict[str, str] | None = None) -> DataFrame:
    """Rename misspelt columns and add the missing ones with their default. Existing columns keep their values."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = {
        name: F.lit(value).cast(kind) for name, (kind, value) in defaults.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def conform_audit(df: DataFrame) -> DataFrame:
    return conform(df, AUDIT_DEFAULTS)


def conform_users(df: DataFrame) -> DataFrame:
    return conform(df, USER_DEFAULTS)


def conform_policies(df: DataFrame) -> DataFrame:
    return conform(df, {}, POLICY_RENAMES)
