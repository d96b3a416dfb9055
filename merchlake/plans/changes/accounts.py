"""Sign-up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import missing, role_name, stable_id
from merchlake.operators import first_request, reject_split
from merchlake.plans.changes.outcome import Outcome, rejected
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults

CUSTOMER_ROLE = 2


def signup(shop: Shop, requests: DataFrame, as_of: dt.datetime | None = None) -> Outcome:
    """New users with a customer row each. The first request of an unknown e-mail succeeds.

    The password is only checked for presence; it is neither stored nor returned. The customer row
    has no city, state and country: an order asks for them before it is accepted.
    """
    blank = F.col("name"), F.col("email"), F.col("password")
    incomplete = missing(blank[0]) | missing(blank[1]) | missing(blank[2])
    complete, blanks = reject_split(requests, F.when(incomplete, "Please enter all fields"))
    known = shop.users.select(F.col("email").alias("_known"))
    accepted = first_request(complete, "email").join(known, F.col("email") == F.col("_known"), "left_anti")
    refused = complete.join(accepted.select("request_id"), "request_id", "left_anti")

    user_id = stable_id(F.lit("user"), F.col("email"), key_type=shop.key_type("users", "id"))
    members = accepted.select(
        "name", "email", F.lit(CUSTOMER_ROLE).alias("role_id"),
        role_name(F.lit(CUSTOMER_ROLE)).alias("role_name"),
    )
    new_users = with_defaults(members, "users", user_id, as_of)
    addresses = accepted.select("email", user_id.alias("user_id"), "phonenumber", "address")
    customer_id = stable_id(F.lit("customer"), F.col("email"), key_type=shop.key_type("customers", "id"))
    new_customers = with_defaults(addresses, "customers", customer_id, as_of)
    return Outcome(
        {"users": shop.users.unionByName(new_users), "customers": shop.customers.unionByName(new_customers)},
        blanks.select("request_id", "reason").unionByName(rejected(refused, "User already exists")),
        new_users,
    )
