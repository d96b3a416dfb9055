"""All SQL counterparts by query key."""

from oracle.changes import CHANGES
from oracle.reports import REPORTS

ORACLES: dict[str, str] = {**REPORTS, **CHANGES}
