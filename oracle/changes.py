"""SQL of the change flows, quality rules and streams: windows where the Spark code aggregates."""

from oracle.base import number_key, stamp, trimmed, uuid, value, with_base

NOW = "'2001-08-01 00:00:00'"


def state(table: str, key: str, shown: str, rest: str) -> str:
    return f"select '{table}' as section, cast({key} as varchar) as key, {shown} as value {rest}"


def rejects(source: str, where: str = "reason is not null", reason: str = "reason") -> str:
    return f"select 'rejected' as section, {reason} as key, cast(count(*) as varchar) as value from {source} where {where} group by 2"


def joined(*parts: str) -> str:
    return " union all ".join(parts)


PRODUCT = [
    "name", "cast(price as decimal(18,2))", "description", "category_id", "total_stock", "howtouse", "status",
]
ADDRESS = ["user_id", "address", "city", "state", "country", "is_default_address"]
ORDER = f"""select reference, product_id, product_name, customer_name, cast(amount as double) as amount, user_id, quantity,
    'success' as status, {stamp('created_at')} as created_at from new_orders"""

# First request per e-mail that no user holds.
NEW_USERS = """(select * from (select *, row_number() over (partition by email order by request_id) as place
    from signups where name <> '' and email is not null and value >= 5) f
    where place = 1 and email not in (select email from shop_users))"""
CATEGORY_NAMES = """(select p_partkey as request_id, case p_partkey % 3 when 0 then p_brand when 1 then p_type else '' end as name from part)"""
NEW_CATEGORIES = f"(select distinct name from {CATEGORY_NAMES} where name <> '' and name not in (select name from shop_categories))"
RENAMES = """(select p_partkey as request_id, case when p_partkey % 7 = 0 then 'none' else p_brand end as category_id,
    case p_partkey % 5 when 0 then '' when 1 then 'Brand#1' when 2 then p_type else p_brand || ' ' || p_type end as name,
    case p_partkey % 3 when 0 then true when 1 then false end as status from part)"""
# A name goes to the category whose request for it comes first among those that may have it.
RENAME_VERDICTS = f"""(select v.*, case when early is not null then early
        when category_id <> first_value(category_id) over (partition by name, early is null order by request_id)
        then 'Category name already exists' end as reason
    from (select r.*, case when name = '' then 'Category name is required'
            when not exists (select 1 from shop_categories c where c.id = r.category_id) then 'Category not found'
            when exists (select 1 from shop_categories c where c.name = r.name and c.id <> r.category_id)
            then 'Category name already exists' end as early
        from {RENAMES} r) v)"""


def latest(column: str, source: str, key: str, match: str, condition: str) -> str:
    return f"(select u.{column} from {source} u where u.{key} = {match} and {condition} order by u.request_id desc limit 1)"


def change(column: str) -> str:
    given = latest(column, "product_changes", "product_id", "p.id", f"u.{column} is not null")
    return f"coalesce({given}, p.{column}) as {column}"


def form(column: str, condition: str = "true") -> str:
    given = latest(column, "product_forms", "product_id", "p.id", f"not u.incomplete and {condition}")
    return f"coalesce({given}, p.{column}) as {column}"


ADDED = """(select a.*, min(request_id) over (partition by user_id) as first_one,
    max(case when flagged then request_id end) over (partition by user_id) as last_flagged,
    exists (select 1 from shop_customers c where c.user_id = a.user_id) as had
    from address_forms a where not incomplete)"""
ADD_DEFAULT = "coalesce(request_id = coalesce(last_flagged, case when not had then first_one end), false)"
GOOD_CHANGES = "(select * from address_change_verdicts where reason is null)"


def address_part(column: str) -> str:
    return f"coalesce((select u.{column} from {GOOD_CHANGES} u where u.address_id = c.id order by u.request_id desc limit 1), c.{column}) as {column}"


LAST_FLAG = f"(select max(u.request_id) from {GOOD_CHANGES} u where u.user_id = c.user_id and u.flagged)"
LAST_CHANGE = f"(select max(u.request_id) from {GOOD_CHANGES} u where u.address_id = c.id)"
LEFT = "(select * from shop_customers c where not exists (select 1 from removed_addresses r where r.address_id = c.id))"
LOST_DEFAULT = """(select r.user_id from removed_addresses r join shop_customers c on c.id = r.address_id where c.is_default_address)"""

BLOG_FORMS = """(select doc_id as request_id,
    case doc_id % 5 when 0 then ' ' when 1 then 'ab' else 'Post ' || doc_id end as title,
    case when doc_id % 7 = 0 then '  ' else source end as cover_image,
    case when doc_id % 9 = 0 then '' else text end as text_content from documents)"""
BLOG_VERDICTS = f"""(select *, concat_ws('; ',
        case when request_id % 5 = 0 then 'Customer title is empty' end,
        case when request_id % 5 in (0, 1) then 'title  must be at least 3 characters long' end,
        case when {trimmed('cover_image')} = '' then 'coverImage is empty' end,
        case when {trimmed('text_content')} = '' then 'textContent is required' end) as errors
    from {BLOG_FORMS})"""
TOGGLES = """(select doc_id as blog_id from labels union all select doc_id from labels where toxic = 1
    union all select doc_id + 1000000000 from labels where quality = 1)"""
CART_PAYMENTS = """(select l.*, u.id % 4 = 3 as failed from shop_users u join (
        select c.id as cart_id, c.user_id, c.quantity, p.id as product_id, p.name as product_name, p.price
        from shop_carts c join shop_products p on p.id = c.product_id) l on l.user_id = u.id)"""

BODIES: dict[str, str] = {
    "ch_signup": joined(
        state("users", "id", value("name", "email", "role_id", "null", "'false'", "'deactivated'"), "from shop_users"),
        state("users", number_key("'user|' || email"), value("name", "email", "2", "'USER'", "'false'", "'deactivated'"), f"from {NEW_USERS}"),
        state("customers", "id", value("user_id", "phonenumber", "address", "city", "is_default_address"), "from shop_customers"),
        state("customers", uuid("'customer|' || email"), value(
            number_key("'user|' || email"), "lpad(cast(user_id as varchar), 10, '0')", "'Street ' || user_id", "null", "'false'"),
            f"from {NEW_USERS}"),
        rejects("signups", "name = '' or email is null or value < 5", "'Please enter all fields'"),
        rejects("signups", f"not (name = '' or email is null or value < 5) and request_id not in (select request_id from {NEW_USERS})",
                "'User already exists'"),
    ),
    "ch_category_create": joined(
        state("categories", "id", value("name", "status", stamp("created_at")), "from shop_categories"),
        state("categories", uuid("'category|' || name"), value("name", "'true'", NOW), f"from {NEW_CATEGORIES}"),
        rejects(CATEGORY_NAMES, "name = ''", "'category name is empty'"),
        f"""select 'rejected', 'category name already exists', cast(count(*) - (select count(*) from {NEW_CATEGORIES}) as varchar)
            from {CATEGORY_NAMES} where name <> ''""",
    ),
    "ch_category_update": f"with verdicts as {RENAME_VERDICTS}, good as (select * from verdicts where reason is null) " + joined(
        state("categories", "id", value(
            "coalesce((select g.name from good g where g.category_id = c.id order by request_id desc limit 1), c.name)",
            "coalesce((select g.status from good g where g.category_id = c.id and g.status is not null order by request_id desc limit 1), c.status)",
            f"case when exists (select 1 from good g where g.category_id = c.id) then {NOW} else {stamp('c.created_at')} end"),
            "from shop_categories c"),
        rejects("verdicts"),
    ),
    "ch_category_delete": joined(
        state("categories", "id", value("name"), "from shop_categories where status"),
        state("products", "id", value("category_id"), "from shop_products where category_id not in (select id from shop_categories where not status)"),
        state("images", "id", value("product_id"), """from shop_images where product_id in (select id from shop_products
            where category_id not in (select id from shop_categories where not status))"""),
        """select 'rejected', 'Category not found', cast((select count(*) from region)
            + (select count(*) from shop_categories where not status) as varchar)""",
    ),
    "ch_product_create": joined(
        state("products", "id", value(*PRODUCT, stamp("created_at")), "from shop_products"),
        state("products", number_key("'product|' || request_id"), value(
            "product_name", "cast(coalesce(try_cast(price as double), 0) as decimal(18,2))", "description", "category_id",
            "coalesce(try_cast(total_stock as int), 1)",
            "case when request_id % 2 = 0 then 'Use daily' else 'Apply this product' end", "'true'", NOW),
            "from judged_products where reason is null"),
        state("images", "id", value("product_id", "image_url"), "from shop_images"),
        state("images", uuid("'image|' || request_id || '|' || (n - 1)"), value(
            number_key("'product|' || request_id"), "'new/' || request_id || '/' || n"),
            "from judged_products, (values (1), (2), (3)) numbers(n) where reason is null and n <= image_count"),
        rejects("judged_products"),
    ),
    "ch_product_update": f"""with changed as (
            select p.id, {change('name')}, {change('price')}, p.description, p.category_id, {change('total_stock')},
                p.howtouse, {change('status')}, case when exists (select 1 from product_changes u where u.product_id = p.id)
                then {NOW} else {stamp('p.created_at')} end as updated_at
            from shop_products p) """ + joined(
        state("products", "id", value(*PRODUCT, "updated_at"), "from changed"),
        state("images", "id", value("product_id", "image_url"), "from shop_images"),
        state("images", uuid("'update|' || request_id"), value("product_id", "image_url"),
              "from product_changes where image_url is not null and product_id in (select id from shop_products)"),
        rejects("product_changes", "product_id not in (select id from shop_products)", "'Product not found'"),
    ),
    "ch_product_replace": f"""with changed as (
            select p.id, {form('name')}, {form('price')},
                coalesce({latest('category_id', 'product_forms', 'product_id', 'p.id', 'not u.incomplete')}, p.description) as description,
                {form('category_id')}, {form('total_stock')}, p.howtouse,
                p.status or exists (select 1 from product_forms u where u.product_id = p.id and not u.incomplete and u.activate) as status,
                case when exists (select 1 from product_forms u where u.product_id = p.id and not u.incomplete)
                then {NOW} else {stamp('p.created_at')} end as updated_at
            from shop_products p) """ + joined(
        state("products", "id", value(*PRODUCT, "updated_at"), "from changed"),
        rejects("product_forms", "incomplete", "'Please enter all fields'"),
    ),
    "ch_product_delete": joined(
        state("products", "id", value("name"), "from shop_products where status"),
        """select 'rejected', 'Product not found', cast(2 * (select count(*) from supplier)
            + (select count(*) from shop_products where not status and id % 20 = 0) as varchar)""",
    ),
    "ch_cart_apply": f"""with last_add as (
            select * from (select *, row_number() over (partition by user_id, product_id order by request_id desc) as place
                from cart_verdicts where reason is null) where place = 1) """ + joined(
        state("carts", "c.id", value("c.user_id", "c.product_id", "coalesce(a.quantity, c.quantity)", stamp("c.created_at"),
              stamp("coalesce(a.ts, c.created_at)")),
              "from shop_carts c left join last_add a on a.user_id = c.user_id and a.product_id = c.product_id"),
        state("carts", uuid("'cart|' || user_id || '|' || product_id"), value("user_id", "product_id", "quantity", stamp("ts"), stamp("ts")),
              "from last_add a where not exists (select 1 from shop_carts c where a.user_id = c.user_id and a.product_id = c.product_id)"),
        rejects("cart_verdicts"),
    ),
    "ch_cart_set_quantity": f"""with last_set as (
            select * from (select *, row_number() over (partition by cart_id order by request_id desc) as place
                from quantity_verdicts where reason is null) where place = 1) """ + joined(
        state("carts", "c.id", value("c.user_id", "c.product_id", "coalesce(s.quantity, c.quantity)", stamp("c.created_at"),
              stamp("coalesce(s.ts, c.created_at)")), "from shop_carts c left join last_set s on s.cart_id = c.id"),
        rejects("quantity_verdicts"),
    ),
    "ch_cart_remove": """with hits as (select r.request_id, c.id, row_number() over (partition by c.id order by r.request_id) as tries
            from removal_requests r left join shop_carts c on c.id = r.cart_id and c.user_id = r.user_id) """ + joined(
        state("carts", "id", value("user_id", "product_id", "quantity"),
              "from shop_carts where id not in (select id from hits where id is not null)"),
        rejects("hits", "id is null or tries > 1", "'Cart item not found'"),
    ),
    "ch_address_add": joined(
        state("customers", "c.id", value("c.user_id", "c.address", "c.city", "c.state", "c.country",
              f"c.is_default_address and not exists (select 1 from {ADDED} a where a.user_id = c.user_id and a.flagged)"),
              "from shop_customers c"),
        state("customers", uuid("'address|' || request_id"), value("user_id", "address", "city", "state", "country", ADD_DEFAULT), f"from {ADDED}"),
        rejects("address_forms", "incomplete", "'All address fields are required'"),
    ),
    "ch_address_update": f"""with changed as (
            select c.id, c.user_id, {address_part('address')}, {address_part('city')}, {address_part('state')}, {address_part('country')},
                case when {LAST_FLAG} is not null then coalesce({LAST_CHANGE} = {LAST_FLAG}, false)
                    when {LAST_CHANGE} is not null then false else c.is_default_address end as is_default_address
            from shop_customers c) """ + joined(
        state("customers", "id", value(*ADDRESS), "from changed"),
        rejects("address_change_verdicts"),
    ),
    "ch_address_delete": f"""with changed as (
            select c.*, c.is_default_address or (c.user_id in {LOST_DEFAULT}
                and row_number() over (partition by c.user_id order by c.created_at desc, c.id) = 1) as now_default
            from {LEFT} c),
        verdicts as (select r.request_id, case when s.request_id is null then 'Address not found'
                when d.request_id is not null then null
                when exists (select 1 from removed_addresses g where g.address_id = r.address_id) then 'Address not found'
                else 'Cannot delete the only address. Please add another address first.' end as reason
            from address_removals r left join removal_steps s on s.request_id = r.request_id
            left join removed_addresses d on d.request_id = r.request_id) """ + joined(
        state("customers", "id", value("user_id", "address", "city", "state", "country", "now_default"), "from changed"),
        rejects("verdicts"),
    ),
    "ch_blog_create": joined(
        state("blogs", "id", value("title", "cover_image", "text_content", "status", "0"), "from shop_blogs"),
        state("blogs", number_key("'blog|' || request_id"), value(
            "title", trimmed("cover_image"), trimmed("text_content"), "'true'", "0"), f"from {BLOG_VERDICTS} where errors = ''"),
        rejects(BLOG_VERDICTS, "errors <> ''", "errors"),
    ),
    "ch_blog_toggle": joined(
        state("blogs", "id", value(f"case when (select count(*) from {TOGGLES} t where t.blog_id = b.id) % 2 = 1 then not status else status end"),
              "from shop_blogs b"),
        f"select 'rejected', 'blog not found', cast(count(*) as varchar) from {TOGGLES} where blog_id not in (select id from shop_blogs)",
    ),
    "ch_orders_from_payment": joined(
        f"select 'order_lines' as section, cast(reference as varchar) as key, {value('product_id', 'product_name', 'customer_name', 'cast(amount as decimal(18,2))', 'user_id', 'quantity', 'status', 'created_at')} as value from ({ORDER})",
        rejects("judged_events", "reason is not null and reason <> 'passed over'"),
    ),
    "ch_stock_decrement": """
        select p.id, cast(p.total_stock - coalesce(s.q, 0) as int) as total_stock, p.total_stock < coalesce(s.q, 0) as oversold
        from shop_products p left join (select product_id, sum(quantity) as q from paid group by 1) s on s.product_id = p.id""",
    "ch_cart_clear": f"""
        select id, user_id, product_id, quantity, {stamp('created_at')} as created_at from shop_carts
        where user_id not in (select user_id from paid where created_at >= timestamp '2001-02-01')""",
    "ch_delivery_create": f"""
        select a.reference as order_id, c.address, c.city, c.state, c.country, cast(0 as double) as delivery_fee,
            'pending' as status, {stamp('a.created_at')} as created_at
        from accepted a join shop_customers c on c.user_id = a.user_id and c.is_default_address""",
    "ch_orders_from_cart": joined(
        state("order_lines", "user_id + 1000000000", value("product_id", "product_name",
              "'Customer#' || lpad(cast(user_id as varchar), 9, '0')", "cast(cast(price as decimal(18,2)) * quantity as decimal(18,2))",
              "user_id", "quantity", "'success'", NOW), f"from {CART_PAYMENTS} where not failed"),
        state("carts", "id", value("quantity"), "from shop_carts where user_id % 4 = 3"),
        rejects("shop_users", "id % 4 = 3", "'Payment verification failed'"),
    ),
    "ch_conform_customers": f"""
        select id, user_id, phonenumber, address, cast(null as varchar) as city, cast(null as varchar) as state,
            cast(null as varchar) as country, false as is_default_address, {stamp('created_at')} as created_at
        from shop_customers""",
    "dq_customer": """
        select form_id, case k % 5 when 0 then 'no-mail' when 1 then 'a b@x.com' when 2 then 'user' || t || '@example.com'
                else 'u' || t || '@example.com' end as email, concat_ws('; ',
            case when k % 7 = 0 then 'Customer name is empty' end,
            case when k % 7 in (0, 1) then 'Customer name must be at least 3 characters long' end,
            case when k % 5 in (0, 1) then 'Invalid email address' end,
            case when k % 11 = 0 then 'Address is required' end,
            case when k % 3 = 2 then 'Phone number is required' end,
            case when k % 3 <> 0 then 'Phone number must be a valid 10-digit number' end,
            case when k % 4 = 0 then 'Password must be at least 8 characters long' end,
            case when k % 6 = 0 then 'Confirm password is required' end,
            case when k % 4 = 0 or k % 6 in (0, 1) then 'Passwords do not match' end) as errors
        from customer_forms""",
    "dq_blog": f"select request_id, errors from {BLOG_VERDICTS}",
    "dq_product": "select request_id, coalesce(reason, '') as errors from judged_products",
    "dq_payment_line": """
        select e.event_id, l.product_id, case when l.product_id % 13 = 0 then 'productName is missing' else '' end as errors
        from events_sent e join shop_lines l on l.reference = e.reference""",
    "dq_delivery_address": """
        select event_id, case when user_id % 17 = 0 or (n = 1 and reference % 21 = 0) then
            'Delivery address details are incomplete. Please provide complete address information.' else '' end as errors
        from events_sent""",
    "dq_orphans": """
        select 'images without product' as "check", count(*) as row_count from shop_images where product_id not in (select id from shop_products)
        union all select 'orders without product', count(*) from shop_lines where product_id not in (select id from shop_products)
        union all select 'orders without user', count(*) from shop_lines where user_id not in (select id from shop_users)
        union all select 'products without category', count(*) from shop_products where category_id not in (select id from shop_categories)""",
    "dq_enum_domain": """
        select 'orders' as "check", count(*) as row_count from shop_lines where status not in ('success', 'declined', 'pending', 'initiated')
        union all select 'deliveries', count(*) from shop_deliveries where status not in ('sentout', 'delivered', 'pending', 'initiated')
        union all select 'users', count(*) from shop_users where 'deactivated' not in ('deactivated')""",
    "dq_signature": "select event_id, reference % 11 <> 0 as signature_ok from events_sent",
    "dq_unique_email": """
        select email, count(*) as row_count
        from (select email from shop_users union all select email from signups where email is not null) group by email having count(*) > 1""",
    "st_payment_ingest": joined(
        f"select 'order_lines' as section, cast(reference as varchar) as key, {value('product_id', 'product_name', 'customer_name', 'cast(amount as decimal(18,2))', 'user_id', 'quantity', 'status', 'created_at')} as value from ({ORDER})",
        state("deliveries", "a.reference", value("c.address", "c.city", "c.state", "c.country", "'pending'"),
              "from accepted a join shop_customers c on c.user_id = a.user_id and c.is_default_address"),
        state("products", "p.id", value("p.total_stock - coalesce(n.q, 0)", "p.total_stock < coalesce(n.q, 0)"),
              "from shop_products p left join (select product_id, sum(quantity) as q from new_orders group by 1) n on n.product_id = p.id"),
        state("carts", "id", value("user_id", "product_id", "quantity"), "from shop_carts where user_id not in (select user_id from accepted)"),
        rejects("judged_events", "reason is not null and reason <> 'passed over'"),
    ),
    "st_payment_dedup": """
        select reference, 'success' as payment_status,
            cast(total * 100 as bigint) as amount_minor, 'payer.' || user_id || '@example.com' as customer_email
        from checkouts where status = 'success' and reference % 11 <> 0 and reference % 23 <> 0 and created_at >= timestamp '1998-01-01'""",
    "st_cart_state": f"select user_id, product_id, quantity, {stamp('created_at')} as created_at from shop_carts",
    "st_daily_sales": """
        select cast(o_orderdate as date) as day, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as total
        from lineitem join orders on l_orderkey = o_orderkey group by 1""",
}


def change_rows(flow: str, table: str, before: str) -> str:
    """The rows of a table in which the state that a flow shows differs from the shop's."""
    return f"""select case when o.key is null then 'insert' when n.key is null then 'delete' else 'update' end as operation,
            coalesce(o.key, n.key) as key, o.value as before, n.value as after
        from (select cast(id as varchar) as key, {before} as value from shop_{table}) o
        full join (select key, value from ({BODIES[flow]}) where section = '{table}') n on n.key = o.key
        where o.value is distinct from n.value"""


def _statement(body: str) -> str:
    """The base tables come before the query's own ones in one list."""
    sql = with_base(body)
    if body.startswith("with ") and sql != body:
        return sql[: -len(body)].rstrip() + ", " + body[len("with "):]
    return sql


CREATED = stamp("created_at")
BODIES |= {
    "ch_rows_users": change_rows("ch_signup", "users", value("name", "email", "role_id", "null", "'false'", "'deactivated'")),
    "ch_rows_categories": change_rows("ch_category_update", "categories", value("name", "status", CREATED)),
    "ch_rows_products": change_rows("ch_product_update", "products", value(*PRODUCT, CREATED)),
    "ch_rows_images": change_rows("ch_category_delete", "images", value("product_id")),
    "ch_rows_carts": change_rows("ch_cart_set_quantity", "carts", value("user_id", "product_id", "quantity", CREATED, CREATED)),
    "ch_rows_customers": change_rows("ch_address_delete", "customers", value(*ADDRESS)),
    "ch_rows_blogs": change_rows("ch_blog_toggle", "blogs", value("status")),
}
CHANGES = {key: _statement(body) for key, body in BODIES.items()}
