"""Text checks, reject reasons and event signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.schemas import ROLE_NAMES

_SHA512_BLOCK = 128


# Fixed value: what counts as blank at the ends of a text.
_BLANKS = " \t\n\r\v\f\u00a0\ufeff"


def trimmed(value: Column) -> Column:
    """Text without blanks at its ends; empty for null."""
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(_BLANKS))


def missing(value: Column) -> Column:
    """Not given: null or empty text."""
    return value.isNull() | (value == "")


def missing_number(value: Column) -> Column:
    """Not given: null or zero."""
    return value.isNull() | (value == 0)


def normalise_email(email: Column) -> Column:
    return F.lower(trimmed(email))


def role_name(role_id: Column) -> Column:
    pairs = list(ROLE_NAMES.items())
    expr = F.when(role_id == pairs[0][0], pairs[0][1])
    for number, name in pairs[1:]:
        expr = expr.when(role_id == number, name)
    return expr


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Message of the first check that fails the row, null for a good row."""
    return F.coalesce(*[F.when(failed, F.lit(message)) for failed, message in checks])


def hmac_sha512(body: Column, secret: str) -> Column:
    """HMAC-SHA-512 of a text column in lower-case hex (RFC 2104, over the built-in ``sha2``)."""
    key = secret.encode("utf-8")
    if len(key) > _SHA512_BLOCK:
        key = hashlib.sha512(key).digest()
    key = key.ljust(_SHA512_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.sha2(F.concat(inner_pad, F.encode(body, "UTF-8")), 512)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 512)
