"""Column functions: money, time, text and keys. All of them stay inside Spark's built-ins."""

from merchlake.functions.keys import stable_id
from merchlake.functions.money import as_double, exact_mean, from_minor, line_total, mean, money, to_minor
from merchlake.functions.text import (
    first_reason, hmac_sha512, missing, missing_number, normalise_email, role_name, trimmed,
)
from merchlake.functions.time import bucket, month_label, since, timestamp_text, today, week_label

__all__ = [
    "as_double", "bucket", "exact_mean", "first_reason", "from_minor", "hmac_sha512", "line_total", "mean",
    "missing", "missing_number", "money", "month_label", "normalise_email", "role_name", "since",
    "stable_id", "timestamp_text", "to_minor", "today", "trimmed", "week_label",
]
