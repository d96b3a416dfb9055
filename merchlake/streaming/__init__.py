"""Structured Streaming jobs over the payment feed, the cart log and the order lines.

All sinks are safe to repeat: a micro-batch that runs again after a failure overwrites only the
files under its own batch id. Checkpoints and outputs belong in a folder that all executors share.
"""

from merchlake.streaming.jobs import (
    cart_feed, daily_sales, dedup_payments, ingest_payments, latest_days, run_to_end,
)

__all__ = ["cart_feed", "daily_sales", "dedup_payments", "ingest_payments", "latest_days", "run_to_end"]
