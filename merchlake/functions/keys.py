"""Keys made from the row itself, so a retried task writes the same row again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*natural_key: Column, key_type: str = "string") -> Column:
    """UUID-shaped text from the SHA-256 of the natural key.

    For tables with whole-number keys it is the first 60 bits as a number. Text keys are the ones
    to use at scale; among some hundred million numbers of 60 bits, two may meet.
    """
    digest = F.sha2(F.concat_ws("|", *[part.cast("string") for part in natural_key]), 256)
    if key_type != "string":
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast(key_type)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)
