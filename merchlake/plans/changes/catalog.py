"""Changes of categories and products."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import first_reason, missing, missing_number, stable_id
from merchlake.operators import first_request, last_given, reject_split, validate
from merchlake.plans.changes.outcome import Outcome, per_request, rejected
from merchlake.plans.quality import product_rules
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults

Time = dt.datetime | None


def _stamp(as_of: Time) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def create_categories(shop: Shop, requests: DataFrame, as_of: Time = None) -> Outcome:
    """The first request for a new name succeeds; names differ by case."""
    named, blanks = reject_split(requests, F.when(missing(F.col("name")), "category name is empty"))
    known = shop.categories.select(F.col("name").alias("_known"))
    accepted = first_request(named, "name").join(known, F.col("name") == F.col("_known"), "left_anti")
    refused = named.join(accepted.select("request_id"), "request_id", "left_anti")
    row_id = stable_id(F.lit("category"), F.col("name"), key_type=shop.key_type("categories", "id"))
    created = with_defaults(accepted.select("name"), "categories", row_id, as_of)
    return Outcome(
        {"categories": shop.categories.unionByName(created)},
        blanks.select("request_id", "reason").unionByName(rejected(refused, "category name already exists")),
        created,
    )


def update_categories(shop: Shop, requests: DataFrame, as_of: Time = None) -> Outcome:
    """Rename categories and set their status where it is given; the last request counts.

    A name is taken if another category holds it before the batch, or if another category's
    earlier request in the batch claims it.
    """
    named, blanks = reject_split(requests, F.when(missing(F.col("name")), "Category name is required"))
    # The verdict depends only on (category, name), so it is found once per pair, however often it
    # is asked for.
    pairs = named.groupBy("category_id", "name").agg(F.min("request_id").alias("_first"))
    ids = shop.categories.select(F.col("id").alias("_id"))
    holders = shop.categories.groupBy(F.col("name").alias("_name")).agg(
        F.min("id").alias("_low"), F.max("id").alias("_high")
    )
    category = F.col("category_id")
    checked = (
        pairs.join(ids, category == F.col("_id"), "left")
        .join(holders, F.col("name") == F.col("_name"), "left")
        .withColumn("_reason", first_reason(
            (F.col("_id").isNull(), "Category not found"),
            ((F.col("_low") != category) | (F.col("_high") != category), "Category name already exists"),
        ))
        .select("category_id", "name", "_first", "_reason")
    )
    free = F.col("_reason").isNull()
    claims = checked.filter(free).groupBy(F.col("name").alias("_name")).agg(
        F.min_by("category_id", "_first").alias("_holder")
    )
    late = free & (F.col("_holder") != category)
    verdicts = checked.join(claims, F.col("name") == F.col("_name"), "left").select(
        F.col("category_id").alias("_category"), F.col("name").alias("_wanted"),
        F.when(late, "Category name already exists").otherwise(F.col("_reason")).alias("reason"),
    )
    judged = named.join(verdicts, (category == F.col("_category")) & (F.col("name") == F.col("_wanted")))
    order = F.col("request_id")
    updates = judged.filter(F.col("reason").isNull()).groupBy("_category").agg(
        last_given(F.col("name"), order).alias("_new_name"),
        last_given(F.col("status"), order).alias("_new_status"),
    )
    touched = F.col("_category").isNotNull()
    state = shop.categories.join(updates, F.col("id") == F.col("_category"), "left").select(
        "id",
        F.coalesce("_new_name", "name").alias("name"),
        F.coalesce("_new_status", "status").alias("status"),
        "created_at",
        F.when(touched, _stamp(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        touched.alias("_touched"),
    )
    refused = judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return Outcome(
        {"categories": state.drop("_touched")},
        blanks.select("request_id", "reason").unionByName(refused),
        state.filter("_touched").drop("_touched"),
    )


def delete_categories(shop: Shop, requests: DataFrame) -> Outcome:
    """Delete categories with their products and those products' images. Orders stay."""
    wanted = requests.select(F.col("category_id").alias("_category")).distinct()
    categories = shop.categories.join(wanted, F.col("id") == F.col("_category"), "left_anti")
    gone = shop.categories.join(wanted, F.col("id") == F.col("_category"), "left_semi")
    known = gone.select(F.col("id").alias("_known"))
    doomed = shop.products.join(known, F.col("category_id") == F.col("_known"), "left_semi")
    doomed_ids = doomed.select(F.col("id").alias("_doomed"))
    return Outcome(
        {
            "categories": categories,
            "products": shop.products.join(known, F.col("category_id") == F.col("_known"), "left_anti"),
            "images": shop.images.join(doomed_ids, F.col("product_id") == F.col("_doomed"), "left_anti"),
        },
        per_request(requests, "category_id", known, "Category not found"),
        gone,
    )


def create_products(shop: Shop, requests: DataFrame, as_of: Time = None) -> Outcome:
    """New products from form text, with one image row per address given.

    A price or stock that is no finite number, or does not fit the column, falls back to the table's default.
    """
    valid, invalid = validate(requests, product_rules())
    product_id = stable_id(F.lit("product"), F.col("request_id"), key_type=shop.key_type("products", "id"))
    image_type = shop.key_type("images", "id")
    price, stock = F.col("price").try_cast("double"), F.col("total_stock").try_cast("double")
    creator = [F.col("user_id")] if "user_id" in valid.columns and "user_id" in shop.products.columns else []
    rows = valid.select(
        *creator,
        F.col("product_name").alias("name"),
        F.when(F.abs(price) < F.lit(float("inf")), price).alias("price"),
        "description", "category_id",
        F.when(F.abs(stock) < 2.0**31, F.floor(stock)).try_cast("int").alias("total_stock"),
        *[F.when(~missing(F.col(name)), F.col(name)).alias(name) for name in ("benefits", "ingredients", "howtouse")],
        "request_id",
    )
    products = with_defaults(rows, "products", product_id, as_of)
    images = valid.select("request_id", F.posexplode("images").alias("place", "image_url")).select(
        stable_id(F.lit("image"), F.col("request_id"), F.col("place"), key_type=image_type).alias("id"),
        product_id.alias("product_id"), "image_url",
    )
    return Outcome(
        {"products": shop.products.unionByName(products), "images": shop.images.unionByName(images)},
        rejected(invalid, F.array_join("errors", "; ")),
        products,
    )


# The fields of a product that a change may carry, by kind.
_TEXT_FIELDS = ["name", "description", "category_id", "benefits", "howtouse", "ingredients"]
_NUMBER_FIELDS = ["price", "total_stock"]


def _apply(shop: Shop, updates: DataFrame, fields: list[str], as_of: Time) -> DataFrame:
    """Products with the last given value of each field."""
    order = F.col("request_id")
    given = {
        name: ~missing(F.col(name)) if name in _TEXT_FIELDS
        else ~missing_number(F.col(name)) if name in _NUMBER_FIELDS
        else F.col(name).isNotNull()
        for name in fields
    }
    latest = updates.groupBy(F.col("product_id").alias("_product")).agg(
        *[last_given(F.col(name), order, condition).alias(f"_{name}") for name, condition in given.items()]
    )
    joined = shop.products.join(latest, F.col("id") == F.col("_product"), "left")
    changes = {name: F.coalesce(F.col(f"_{name}"), F.col(name)) for name in fields}
    changes["updated_at"] = F.when(F.col("_product").isNotNull(), _stamp(as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(shop.products.columns)


def _written(products: DataFrame, updates: DataFrame) -> DataFrame:
    """The new rows of the products that the updates name."""
    named = updates.select(F.col("product_id").alias("_named")).distinct()
    return products.join(named, F.col("id") == F.col("_named"), "left_semi")


def update_products(shop: Shop, requests: DataFrame, as_of: Time = None) -> Outcome:
    """Change the given fields of products; the last given value of each field counts.

    Blank text and zero numbers count as not given. A request may add an image.
    """
    fields = [f for f in [*_TEXT_FIELDS, *_NUMBER_FIELDS, "status"] if f in requests.columns]
    ids = shop.products.select(F.col("id").alias("_known"))
    same = F.col("product_id") == F.col("_known")
    state = {"products": _apply(shop, requests, fields, as_of)}
    if "image_url" in requests.columns:
        pictured = requests.filter(~missing(F.col("image_url"))).join(ids, same, "left_semi")
        image_id = stable_id(F.lit("update"), F.col("request_id"), key_type=shop.key_type("images", "id"))
        state["images"] = shop.images.unionByName(pictured.select(image_id.alias("id"), "product_id", "image_url"))
    unknown = requests.join(ids, same, "left_anti")
    return Outcome(state, rejected(unknown, "Product not found"), _written(state["products"], requests))


def replace_products(shop: Shop, requests: DataFrame, as_of: Time = None) -> Outcome:
    """Full update: name, price, description, category and stock are all needed.

    The status changes only to active. An unknown product is no error; nothing is updated.
    """
    needed = ["name", "price", "description", "category_id", "total_stock"]
    absent = F.lit(False)
    for name in needed:
        absent = absent | (missing_number if name in _NUMBER_FIELDS else missing)(F.col(name))
    complete, blanks = reject_split(requests, F.when(absent, "Please enter all fields"))
    active = complete.withColumn("status", F.when(F.col("status"), True))
    products = _apply(shop, active, [*needed, "status"], as_of)
    return Outcome({"products": products}, blanks.select("request_id", "reason"), _written(products, active))


def delete_products(shop: Shop, requests: DataFrame) -> Outcome:
    """Remove products. Their orders and images stay."""
    wanted = requests.select(F.col("product_id").alias("_product")).distinct()
    ids = shop.products.select(F.col("id").alias("_known"))
    return Outcome(
        {"products": shop.products.join(wanted, F.col("id") == F.col("_product"), "left_anti")},
        per_request(requests, "product_id", ids, "Product not found"),
        shop.products.join(wanted, F.col("id") == F.col("_product"), "left_semi"),
    )
