"""Sources and sinks: declared tables, payment events, snapshots and the test-data binding."""

from merchlake.sources.payments import expand_lines, parse_payment_events, payment_lines, signature_is_valid
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import changed, published, publish, with_defaults, write_snapshot
from merchlake.sources.tables import conform, load

__all__ = [
    "Shop", "changed", "conform", "expand_lines", "load", "parse_payment_events", "payment_lines",
    "publish", "published", "signature_is_valid", "with_defaults", "write_snapshot",
]
