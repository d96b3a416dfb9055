"""Address changes.

Requests are written as if applied one by one in order of ``request_id``. The end of such a run can
be told from a few figures per user and per address (last flagged request, number of addresses, first
removal), so no user's requests have to be gathered and replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import first_reason, stable_id
from merchlake.operators import reject_split
from merchlake.plans.changes.outcome import Outcome, rejected
from merchlake.plans.quality import address_is_incomplete
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults

_PLACE = ["address", "city", "state", "country"]
_INCOMPLETE = "All address fields are required"


def _flagged() -> Column:
    return F.coalesce(F.col("is_default"), F.lit(False))


def add_addresses(shop: Shop, requests: DataFrame) -> Outcome:
    """New address rows. The last flagged one becomes the default and clears the others; without
    a flagged one, the first address of a user who had none is the default.
    """
    valid, incomplete = reject_split(requests, F.when(address_is_incomplete(), _INCOMPLETE))
    had = shop.customers.groupBy(F.col("user_id").alias("_owner")).agg(F.count("*").alias("_had"))
    per_user = valid.groupBy(F.col("user_id").alias("_user")).agg(
        F.max(F.when(_flagged(), F.col("request_id"))).alias("_last_flagged"),
        F.min("request_id").alias("_first"),
    )
    defaults = per_user.join(had, F.col("_user") == F.col("_owner"), "left").select(
        "_user",
        F.coalesce("_last_flagged", F.when(F.col("_had").isNull(), F.col("_first"))).alias("_default_request"),
    )
    new_default = defaults.filter(F.col("_default_request").isNotNull())
    row_id = stable_id(F.lit("address"), F.col("request_id"), key_type=shop.key_type("customers", "id"))
    # The default request is one row, so the new rows are matched by its id and not by user.
    marks = new_default.select(F.col("_default_request").alias("_mark"))
    rows = valid.join(marks, F.col("request_id") == F.col("_mark"), "left").select(
        "request_id", "user_id", *_PLACE, F.lit("").alias("phonenumber"),
        F.col("_mark").isNotNull().alias("is_default_address"), F.col("requested_at").alias("created_at"),
    )
    added = with_defaults(rows, "customers", row_id)
    changed_users = new_default.select("_user")
    old = shop.customers.join(changed_users, F.col("user_id") == F.col("_user"), "left").withColumn(
        "is_default_address", F.col("is_default_address") & F.col("_user").isNull()
    ).drop("_user")
    return Outcome(
        {"customers": old.unionByName(added)}, incomplete.select("request_id", "reason"), added
    )


def update_addresses(shop: Shop, requests: DataFrame) -> Outcome:
    """Change own addresses. A flagged change makes the address the only default; an unflagged one
    takes the flag from its own address.
    """
    rows = shop.customers.select(F.col("id").alias("_id"), F.col("user_id").alias("_owner"))
    own = (F.col("address_id") == F.col("_id")) & (F.col("user_id") == F.col("_owner"))
    valid, refused = reject_split(requests.join(rows, own, "left"), first_reason(
        (address_is_incomplete(), _INCOMPLETE), (F.col("_id").isNull(), "Address not found")
    ))
    order = F.col("request_id")
    per_address = valid.groupBy("_id").agg(
        F.max_by(F.struct(*_PLACE), order).alias("_new"), F.max(order).alias("_last")
    )
    per_user = valid.filter(_flagged()).groupBy(F.col("user_id").alias("_user")).agg(
        F.max(order).alias("_last_flagged")
    )
    joined = shop.customers.join(per_address, F.col("id") == F.col("_id"), "left").join(
        per_user, F.col("user_id") == F.col("_user"), "left"
    )
    # After the last flagged change of a user only its address is the default, unless a later
    # unflagged change of that address took the flag away.
    default = (
        F.when(F.col("_last_flagged").isNotNull(), F.coalesce(F.col("_last") == F.col("_last_flagged"), F.lit(False)))
        .when(F.col("_last").isNotNull(), False)
        .otherwise(F.col("is_default_address"))
    )
    touched = F.col("_last").isNotNull()
    state = joined.withColumns({
        **{part: F.when(touched, F.col(f"_new.{part}")).otherwise(F.col(part)) for part in _PLACE},
        "is_default_address": default,
        "_touched": touched,
    })
    columns = shop.customers.columns
    return Outcome(
        {"customers": state.select(columns)},
        refused.select("request_id", "reason"),
        state.filter("_touched").select(columns),
    )


def delete_addresses(shop: Shop, requests: DataFrame) -> Outcome:
    """Remove own addresses, but never a user's only one. When a default is removed, the newest
    other address becomes the default.

    Of several removals of one address the first counts. If all addresses of a user are to go, the
    one whose removal comes last stays.
    """
    rows = shop.customers.select(F.col("id").alias("_id"), F.col("user_id").alias("_owner"))
    own = (F.col("address_id") == F.col("_id")) & (F.col("user_id") == F.col("_owner"))
    known, unknown = reject_split(
        requests.join(rows, own, "left"), F.when(F.col("_id").isNull(), "Address not found")
    )
    firsts = known.groupBy("_id", "_owner").agg(F.min("request_id").alias("_first"))
    had = shop.customers.groupBy(F.col("user_id").alias("_user")).agg(F.count("*").alias("_had"))
    asked = firsts.groupBy(F.col("_owner").alias("_asker")).agg(
        F.count("*").alias("_asked"), F.max("_first").alias("_final")
    )
    spared = asked.join(had, F.col("_asker") == F.col("_user")).filter(F.col("_asked") >= F.col("_had")).select(
        F.col("_final").alias("_spared")
    )
    judged = firsts.join(spared, F.col("_first") == F.col("_spared"), "left")
    removed = judged.filter(F.col("_spared").isNull()).select(F.col("_id").alias("_gone"), "_first")
    kept_last = judged.filter(F.col("_spared").isNotNull()).select(F.col("_id").alias("_kept"))

    gone_rows = shop.customers.join(removed.select("_gone"), F.col("id") == F.col("_gone"), "left_semi")
    orphaned = gone_rows.filter("is_default_address").select(F.col("user_id").alias("_heirless")).distinct()
    rest = shop.customers.join(removed.select("_gone"), F.col("id") == F.col("_gone"), "left_anti")
    # Each removal of a default promotes the newest row left, so the last one promoted is the
    # newest of the rows that stay.
    newest = F.struct(F.col("created_at").isNotNull(), "created_at")
    latest = (
        rest.join(orphaned, F.col("user_id") == F.col("_heirless"), "left_semi")
        .groupBy(F.col("user_id").alias("_heir_user")).agg(F.max(newest).alias("_newest"))
    )
    heirs = (
        rest.join(latest, (F.col("user_id") == F.col("_heir_user")) & (newest == F.col("_newest")))
        .groupBy("user_id").agg(F.min("id").alias("_heir")).select("_heir")
    )
    promoted = rest.join(heirs, F.col("id") == F.col("_heir"), "left").withColumn(
        "is_default_address", F.col("is_default_address") | F.col("_heir").isNotNull()
    )

    # A request fails if it names the spared address, or comes after the removal it repeats.
    done = removed.select(F.col("_first").alias("request_id"))
    failed = known.join(done, "request_id", "left_anti").join(kept_last, F.col("_id") == F.col("_kept"), "left")
    message = F.when(
        F.col("_kept").isNotNull(), "Cannot delete the only address. Please add another address first."
    ).otherwise("Address not found")
    return Outcome(
        {"customers": promoted.drop("_heir")},
        unknown.select("request_id", "reason").unionByName(rejected(failed, message)),
        promoted.filter(F.col("_heir").isNotNull()).drop("_heir"),
    )
