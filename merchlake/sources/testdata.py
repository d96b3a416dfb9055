"""The shop's tables and its change logs, bound to the TPC-H-like test files.

Each logical table is a projection, join or grouping of whole test tables, so it grows with them.
The rules that give rows their variety (which field is blank, which key is unknown) are arbitrary
but fixed; they stand for the mix of good and bad requests a shop receives.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions import hmac_sha512, to_minor
from merchlake.session import stored_bytes
from merchlake.sources.shop import Shop
from merchlake.sources.tables import conform

TEST_SECRET = "test-secret"
UNKNOWN = 1_000_000_000


# The columns of the test files that are read. A declared schema saves a job that
# would look into the files for it.
FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(FILES[name]).parquet(f"{folder}/{name}.parquet")


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of the test files that the shop's tables are made of."""
    return stored_bytes(spark, *[f"{folder}/{name}.parquet" for name in FILES])


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test file as a stream; the source takes a pattern, not a single file."""
    return spark.readStream.schema(FILES[name]).parquet(f"{folder}/{name}.parq*")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _days_after_1995(days: Column) -> Column:
    return F.date_add(F.lit("1995-01-01").cast("date"), days.cast("int")).cast("timestamp")


def categories(spark: SparkSession, folder: str) -> DataFrame:
    brands = _read(spark, folder, "part").select("p_brand").distinct()
    number = F.substring("p_brand", 7, 10).cast("int")
    created = _days_after_1995(number)
    return brands.select(
        F.col("p_brand").alias("id"),
        F.col("p_brand").alias("name"),
        (number % 5 != 0).alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    created = _days_after_1995(F.col("p_partkey") % 2400)
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("category_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("total_stock"),
        (F.col("p_partkey") % 10 != 0).alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _read(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(
        F.concat(F.lit("i"), _text("l_partkey"), F.lit("-"), _text("l_suppkey")).alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("img/"), _text("l_partkey"), F.lit("/"), _text("l_suppkey")).alias("image_url"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (checkout, product).

    The join key is also a grouping key. Joined by shuffle, the rows already lie as the grouping
    needs them, so there is one exchange of the lines in all; a broadcast would save none.
    """
    lines = _read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", F.col("l_extendedprice").cast("decimal(12,2)").alias("price")
    )
    # One branch per level: a filter on the status then folds to one on the file's own column.
    unpaid = F.when(F.col("o_orderpriority") == "5-LOW", "declined").otherwise("initiated")
    open_or_unpaid = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(unpaid)
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise(open_or_unpaid)
    orders = _read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    grouped = joined.groupBy("l_orderkey", "l_partkey", "o_custkey", "status", "created_at").agg(
        F.sum("l_quantity").cast("long").alias("quantity"), F.sum("price").alias("amount")
    )
    return grouped.select(
        F.concat(_text("l_orderkey"), F.lit("-"), _text("l_partkey")).alias("id"),
        F.col("l_orderkey").alias("reference"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("Part#"), _text("l_partkey")).alias("product_name"),
        F.concat(F.lit("Customer#"), F.lpad(_text("o_custkey"), 9, "0")).alias("customer_name"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        F.col("o_custkey").alias("user_id"),
        "quantity",
        "status",
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """Each checkout with its time."""
    return _read(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_custkey") == 0, 1).otherwise(2).alias("role_id"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Address rows; every third user has a second one, which is not the default."""
    nation, region = _read(spark, folder, "nation"), _read(spark, folder, "region")
    placed = (
        _read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    first, second = F.array(F.lit(True)), F.array(F.lit(True), F.lit(False))
    rows = placed.withColumn("is_first", F.explode(F.when(F.col("c_custkey") % 3 == 0, second).otherwise(first)))
    is_first = F.col("is_first")
    return rows.select(
        F.concat(F.when(is_first, "a").otherwise("b"), _text("c_custkey")).alias("id"),
        F.col("c_custkey").alias("user_id"),
        F.lpad(_text("c_custkey"), 10, "0").alias("phonenumber"),
        F.concat("c_name", F.when(is_first, " street").otherwise(" second")).alias("address"),
        F.col("c_mktsegment").alias("city"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("country"),
        is_first.alias("is_default_address"),
        F.when(is_first, F.lit("1995-01-01")).otherwise("1996-01-01").cast("timestamp").alias("created_at"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Paid checkouts only, so left joins have misses."""
    paid = _read(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    homes = customers(spark, folder).filter("is_default_address").drop("id", "created_at")
    rest = F.col("o_orderkey") % 3
    return paid.join(homes, F.col("o_custkey") == F.col("user_id")).select(
        F.col("o_orderkey").alias("order_id"),
        "address", "city", "state", "country",
        F.when(rest == 0, "delivered").when(rest == 1, "sentout").otherwise("pending").alias("status"),
    )


def blogs(spark: SparkSession, folder: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp")
    created = start + F.make_interval(mins=F.col("doc_id").cast("int"))
    return _read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("cover_image"),
        F.col("text").alias("text_content"),
        (F.col("doc_id") % 2 == 0).alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def cart_log_rows(events: DataFrame) -> DataFrame:
    """The event feed as cart log; works on a batch or a stream of event rows."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").try_cast("long").alias("product_id"),
        (1 + F.floor("value").cast("long") % 10).alias("quantity"),
    )


def cart_log(spark: SparkSession, folder: str) -> DataFrame:
    return cart_log_rows(_read(spark, folder, "events"))


def carts(spark: SparkSession, folder: str) -> DataFrame:
    from merchlake.plans.changes.carts import cart_state

    return cart_state(cart_log(spark, folder))


TABLES = {
    "categories": categories, "products": products, "images": images, "order_lines": order_lines,
    "users": users, "customers": customers, "deliveries": deliveries, "blogs": blogs,
    "cart_log": cart_log, "carts": carts,
}


def bind(spark: SparkSession, folder: str) -> Shop:
    """The shop over one folder of test files."""

    def make(table: str) -> DataFrame:
        return conform(TABLES[table](spark, folder), table)

    return Shop({table: partial(make, table) for table in TABLES})


# --- change logs ---------------------------------------------------------------------------------


def signup_requests(spark: SparkSession, folder: str) -> DataFrame:
    """From sign-up events: new and known e-mails, repeats, and blank fields."""
    value, user = F.col("value"), _text("user_id")
    email = (
        F.when(value < 1, F.lit(None))
        .when(value >= 60, F.concat(F.lit("customer."), F.lpad(user, 9, "0"), F.lit("@example.com")))
        .otherwise(F.concat(F.lit("shopper."), user, F.lit("@example.com")))
    )
    return _read(spark, folder, "events").filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("request_id"),
        F.when(value < 3, "").otherwise(F.concat(F.lit("Shopper "), user)).alias("name"),
        email.alias("email"),
        F.when(value < 5, F.lit(None)).otherwise("given").alias("password"),
        F.lpad(user, 10, "0").alias("phonenumber"),
        F.concat(F.lit("Street "), user).alias("address"),
    )


def category_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A name per part: known brands, new types many times over, and blanks."""
    rest = F.col("p_partkey") % 3
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(rest == 0, F.col("p_brand")).when(rest == 1, F.col("p_type")).otherwise("").alias("name"),
    )


def category_updates(spark: SparkSession, folder: str) -> DataFrame:
    """A rename per part, with unknown categories, taken names and an optional status."""
    key = F.col("p_partkey")
    name = (
        F.when(key % 5 == 0, "")
        .when(key % 5 == 1, "Brand#1")
        .when(key % 5 == 2, F.col("p_type"))
        .otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    )
    return _read(spark, folder, "part").select(
        key.alias("request_id"),
        F.when(key % 7 == 0, "none").otherwise(F.col("p_brand")).alias("category_id"),
        name.alias("name"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("status"),
    )


def category_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """All inactive categories, each twice, and region names, which are no category."""
    known = categories(spark, folder).filter(~F.col("status")).select(F.col("id").alias("category_id"))
    asked = known.union(known).union(_read(spark, folder, "region").select("r_name"))
    # Numbered by content; the order among equal requests does not matter.
    order = Window.partitionBy("category_id").orderBy("category_id")
    return asked.select(F.concat_ws("#", "category_id", F.row_number().over(order)).alias("request_id"), "category_id")


def product_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A new product per part, as form text: some blank, some not a number, some without images."""
    key = F.col("p_partkey")
    count = F.col("p_size") % 4
    urls = F.transform(F.sequence(F.lit(1), count), lambda n: F.concat_ws("/", F.lit("new"), key, n))
    return _read(spark, folder, "part").select(
        key.alias("request_id"),
        F.when(key % 11 == 0, "").otherwise(F.col("p_name")).alias("product_name"),
        F.when(key % 13 == 0, "").when(key % 17 == 0, "n/a")
        .otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("category_id"),
        F.when(key % 19 == 0, "many").otherwise(_text("p_size")).alias("total_stock"),
        F.when(key % 2 == 0, "Use daily").alias("howtouse"),
        F.lit(None).cast("string").alias("benefits"),
        F.lit(None).cast("string").alias("ingredients"),
        F.when(count > 0, urls).alias("images"),
    )


def product_updates(spark: SparkSession, folder: str) -> DataFrame:
    """A partial update per event: several per product, zeros, and unknown products."""
    kind, value = F.col("event_type"), F.col("value")
    whole = F.floor("value").cast("long")
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(value < 0.5, -1).otherwise(F.get_json_object("props", "$.k").try_cast("long")).alias("product_id"),
        F.when(kind == "view", F.concat(F.lit("Renamed "), _text("event_id"))).alias("name"),
        F.when(kind == "click", whole.cast("double")).alias("price"),
        F.when(kind == "purchase", (whole % 20).cast("int")).alias("total_stock"),
        F.when(kind == "error", False).when(kind == "signup", True).alias("status"),
        F.when((kind == "view") & (value > 100), F.concat(F.lit("img/new/"), _text("event_id"))).alias("image_url"),
    )


def product_replacements(spark: SparkSession, folder: str) -> DataFrame:
    """A full update per part, some with a blank or zero field, some for unknown products."""
    key = F.col("p_partkey")
    return _read(spark, folder, "part").select(
        key.alias("request_id"),
        F.when(key % 23 == 0, key + UNKNOWN).otherwise(key).alias("product_id"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("New "), F.col("p_name"))).alias("name"),
        F.when(key % 7 == 0, 0.0).otherwise(F.col("p_retailprice") + 1).alias("price"),
        F.col("p_brand").alias("description"),
        F.col("p_brand").alias("category_id"),
        (F.col("p_size") - 1).alias("total_stock"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("status"),
    )


def product_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """All inactive products, some twice, and suppliers' keys moved out of range, which are no product, twice."""
    known = products(spark, folder).filter(~F.col("status")).select(F.col("id").alias("product_id"))
    again = known.filter(F.col("product_id") % 20 == 0)
    unknown = _read(spark, folder, "supplier").select((F.col("s_suppkey") + UNKNOWN).alias("product_id"))

    def sent(rows: DataFrame, time: int) -> DataFrame:
        return rows.select((F.col("product_id") * 2 + time).alias("request_id"), "product_id")

    return sent(known, 0).union(sent(again, 1)).union(sent(unknown, 0)).union(sent(unknown, 1))


def cart_adds(spark: SparkSession, folder: str) -> DataFrame:
    """An add per event: no product, unknown products, no quantity, short stock, repeats."""
    kind, product = F.col("event_type"), F.col("product_id")
    return cart_log(spark, folder).select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        "user_id",
        F.when(kind == "signup", F.lit(None)).when(kind == "error", product + UNKNOWN)
        .otherwise(product).alias("product_id"),
        F.when(kind == "purchase", 0).otherwise(F.col("quantity")).alias("quantity"),
    )


def cart_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """A quantity change per event, some for another user's cart row, some below one."""
    cart_id = F.concat(F.lit("c"), _text("user_id"), F.lit("-"), _text("product_id"))
    return cart_log(spark, folder).select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        F.when(F.col("event_type") == "error", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        cart_id.alias("cart_id"),
        F.when(F.col("event_type") == "view", F.col("quantity") - 5).otherwise(F.col("quantity") * 4).alias("quantity"),
    )


def cart_removals(spark: SparkSession, folder: str) -> DataFrame:
    """A removal per event: most name no cart row, some another user's, some nothing, some an unknown row."""
    kind = F.col("event_type")
    cart_id = F.concat(F.lit("c"), _text("user_id"), F.lit("-"), _text("product_id"))
    return cart_log(spark, folder).select(
        F.col("event_id").alias("request_id"),
        F.when(kind == "purchase", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(kind == "signup", F.lit(None)).when(kind == "error", F.lit("no such row"))
        # Of those who click, every fourth takes the product back.
        .when((kind == "click") & (F.col("event_id") % 4 != 0), F.lit(""))
        .otherwise(cart_id).alias("cart_id"),
    )


def address_adds(spark: SparkSession, folder: str) -> DataFrame:
    """An address per event; sign-ups come from users who have none yet."""
    value, kind = F.col("value"), F.col("event_type")
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.when(kind == "signup", F.col("user_id") + UNKNOWN).otherwise(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("Road "), _text("event_id")).alias("address"),
        F.concat(F.lit("City "), _text("user_id")).alias("city"),
        kind.alias("state"),
        F.when(value < 2, "").otherwise("Home").alias("country"),
        F.when(value > 30, value > 100).alias("is_default"),
    )


def address_updates(spark: SparkSession, folder: str) -> DataFrame:
    """A change per event, of the own first or second address or of a neighbour's."""
    value, kind, user = F.col("value"), F.col("event_type"), F.col("user_id")
    address_id = (
        F.when(kind.isin("view", "click"), F.concat(F.lit("a"), user.cast("string")))
        .when(kind.isin("purchase", "signup"), F.concat(F.lit("b"), user.cast("string")))
        .otherwise(F.concat(F.lit("a"), (user + 1).cast("string")))
    )
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        "user_id",
        address_id.alias("address_id"),
        F.concat(F.lit("Road "), _text("event_id")).alias("address"),
        F.concat(F.lit("City "), user.cast("string")).alias("city"),
        kind.alias("state"),
        F.when(value < 2, F.lit(None)).otherwise("Home").alias("country"),
        F.when(value > 30, value > 90).alias("is_default"),
    )


def address_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """A removal per event: of the own first or second address, a neighbour's, an unknown one, or none."""
    kind, user = F.col("event_type"), F.col("user_id")
    address_id = (
        F.when(kind == "signup", F.concat(F.lit("a"), user.cast("string")))
        .when(kind == "error", F.concat(F.lit("b"), user.cast("string")))
        .when(kind == "purchase", F.concat(F.lit("a"), (user + 1).cast("string")))
        .when(kind == "view", F.concat(F.lit("z"), user.cast("string")))
    )
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), "user_id", address_id.alias("address_id")
    )


def order_json(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each checkout as one JSON array, as a client posts them."""
    line = F.struct(_text("product_id").alias("productId"), F.col("quantity").cast("int").alias("quantity"))
    return (
        bind(spark, folder).order_lines.groupBy(F.col("reference").alias("order_key"))
        .agg(F.to_json(F.collect_list(line)).alias("lines"))
    )


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Signed events of each checkout. Every seventh is sent twice: alike, or first without address, with an
    unknown user or failed, and then right. Some are forged, unpaid or incomplete, some references are no key."""
    shop = bind(spark, folder)
    reference, user, product = F.col("reference"), F.col("user_id"), F.col("product_id")
    camel = reference % 2 == 0
    name = F.when(product % 13 != 0, F.col("product_name"))
    line = F.struct(
        F.when(camel, product.cast("string")).alias("productId"),
        F.when(camel, name).alias("productName"),
        F.when(camel, F.col("amount")).alias("productTotal"),
        F.when(~camel, product.cast("string")).alias("product_id"),
        F.when(~camel, name).alias("name"),
        F.when(~camel, F.col("amount")).alias("product_total"),
        F.col("quantity").alias("quantity"),
    )
    checkouts = shop.order_lines.groupBy("reference", "user_id", "status", "created_at").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.sum("amount").alias("total")
    )
    # Homes are joined to the keys of checkouts and then by reference, so the lines stay where their grouping left them;
    # the user, compared so that it is no join key, keeps apart those whose reference is the same.
    buyers = _read(spark, folder, "orders").select(F.col("o_orderkey").alias("_reference"), F.col("o_custkey").alias("_buyer")).distinct()
    homes = shop.customers.filter("is_default_address").select(F.col("user_id").alias("_home"), "address", "city", "state", "country")
    placed = buyers.join(homes, F.col("_buyer") == F.col("_home")).drop("_home")
    own = (reference == F.col("_reference")) & (user <= F.col("_buyer")) & (user >= F.col("_buyer"))
    first = F.col("sending") == 1
    paid = (F.col("status") == "success") & ~((reference % 49 == 0) & first)
    name_of = F.when(reference % 23 == 0, F.concat(F.lit("no-key-"), reference.cast("string"))).otherwise(reference.cast("string"))
    no_user, no_country = (user % 19 == 0) | ((reference % 35 == 0) & first), (user % 17 == 0) | ((reference % 21 == 0) & first)
    body = F.struct(F.struct(
        name_of.alias("reference"),
        F.when(paid, "success").otherwise("failed").alias("status"),
        F.when(paid, "Approved").when(F.col("status") == "declined", "Declined").alias("gateway_response"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("paid_at"),
        F.lit("card").alias("channel"),
        to_minor(F.col("total")).alias("amount"),
        F.struct(F.concat(F.lit("payer."), user.cast("string"), F.lit("@example.com")).alias("email")).alias("customer"),
        F.struct(
            F.lit("visa").alias("card_type"), F.lit("Test Bank").alias("bank"),
            F.lpad((reference % 10000).cast("string"), 4, "0").alias("last4"),
        ).alias("authorization"),
        F.struct(
            F.when(no_user, user + UNKNOWN).otherwise(user).cast("string").alias("userId"),
            F.struct(
                F.col("lines").alias("productDescriptions"),
                F.struct(
                    "address", "city", "state",
                    F.when(~no_country, F.col("country")).alias("country"),
                ).alias("deliveryDetails"),
            ).alias("products"),
        ).alias("metadata"),
    ).alias("data"))
    sendings = F.when(reference % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    sent = checkouts.join(placed, own).withColumn("sending", F.explode(sendings))
    bodies = sent.select(
        reference, "sending", F.col("created_at").alias("sent_at"), F.to_json(body).alias("body")
    )
    signature = hmac_sha512(F.col("body"), TEST_SECRET)
    forged = F.when(reference % 11 == 0, F.concat(F.lit("x"), F.substring(signature, 2, 127)))
    return bodies.select(
        F.concat_ws("#", "reference", "sending").alias("event_id"), "sent_at",
        F.coalesce(forged, signature).alias("signature"), "body"
    )


def stored_orders(shop: Shop) -> DataFrame:
    """Checkouts the shop had already booked before the payment feed was replayed."""
    return shop.order_lines.filter(F.col("created_at") < F.lit("1998-01-01").cast("timestamp"))


def customer_forms(spark: SparkSession, folder: str) -> DataFrame:
    """A sign-up form per customer, with each field wrong in some of them."""
    key, text = F.col("c_custkey"), _text("c_custkey")
    return _read(spark, folder, "customer").select(
        key.alias("form_id"),
        F.when(key % 7 == 0, "  ").when(key % 7 == 1, " ab ").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 5 == 0, "no-mail").when(key % 5 == 1, F.concat(F.lit("a b@x.com")))
        .when(key % 5 == 2, F.concat(F.lit("User"), text, F.lit("@Example.COM")))
        .otherwise(F.concat(F.lit("u"), text, F.lit("@example.com"))).alias("email"),
        F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("Street "), text)).alias("address"),
        F.when(key % 3 == 0, F.lpad(text, 10, "0")).when(key % 3 == 1, F.lpad(text, 9, "0"))
        .otherwise("").alias("phonenumber"),
        F.when(key % 4 == 0, "short").otherwise(F.concat(F.lit("password"), text)).alias("password"),
        F.when(key % 6 == 0, "").when(key % 6 == 1, "other-password")
        .otherwise(F.concat(F.lit("password"), text)).alias("confirm_password"),
    )


def blog_forms(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    return _read(spark, folder, "documents").select(
        key.alias("request_id"),
        F.when(key % 5 == 0, " ").when(key % 5 == 1, "ab").otherwise(F.concat(F.lit("Post "), key.cast("string"))).alias("title"),
        F.when(key % 7 == 0, "  ").otherwise(F.col("source")).alias("cover_image"),
        F.when(key % 9 == 0, "").otherwise(F.col("text")).alias("text_content"),
    )


def blog_toggles(spark: SparkSession, folder: str) -> DataFrame:
    """A toggle per label row, a second one for toxic ones, and unknown blogs for those of quality."""
    labels = _read(spark, folder, "labels")
    doc = F.col("doc_id")
    targets = F.array_compact(F.array(
        doc, F.when(F.col("toxic") == 1, doc), F.when(F.col("quality") == 1, doc + UNKNOWN)
    ))
    return labels.select("doc_id", F.posexplode(targets).alias("_n", "blog_id")).select(
        (F.col("doc_id") * 3 + F.col("_n")).alias("request_id"), "blog_id"
    )
