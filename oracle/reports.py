"""SQL of the reports. Written with correlated subqueries and windows where the Spark code
aggregates before it joins, so that one mistake does not pass on both sides."""

from oracle.base import money, stamp, with_base

P = f"""p.id as product_id, p.name as product_name, p.category_id, p.price, p.status, p.total_stock, p.description,
    p.benefits, p.howtouse, p.ingredients, {stamp('p.created_at')} as created_at, c.name as category_name"""
SHORT = f"""p.id as product_id, p.name as product_name, p.category_id, p.price, p.status, p.total_stock, p.description,
    {stamp('p.created_at')} as created_at, c.name as category_name"""
FROM = "from shop_products p join shop_categories c on c.id = p.category_id"
UNITS = "(select coalesce(sum(o.quantity), 0) from paid o where o.product_id = p.id)"


def images(key: str) -> str:
    return f"coalesce((select string_agg(i.image_url, '|' order by i.image_url) from shop_images i where i.product_id = {key}), '') as images"


def period(unit: str, alias: str = "o") -> str:
    return f"cast(date_trunc('{unit}', {alias}.created_at) as date)"


def period_totals(unit: str, where: str = "true") -> str:
    return f"""select {period(unit)} as {unit}, count(distinct o.id) as order_count, cast(sum(o.quantity) as bigint) as items_sold,
        cast(sum(o.amount) as double) as revenue, count(distinct o.user_id) as unique_customers
        from paid o where {where} group by 1"""


def period_names(unit: str, where: str = "true") -> str:
    return f"""select {period(unit)} as {unit}, p.name as product_name, cast(sum(o.quantity) as bigint) as quantity_sold,
        cast(sum(o.amount) as double) as revenue
        from paid o join shop_products p on p.id = o.product_id where {where} group by 1, 2"""


def twelve_places(whole: str) -> str:
    """A whole number of units of the twelfth decimal place as a double, through text and thus without an error."""
    unit = "cast(1000000000000 as hugeint)"
    return f"cast(({whole}) // {unit} || '.' || lpad(cast(({whole}) % {unit} as varchar), 12, '0') as double)"


WEEKS12 = "o.created_at >= timestamp '2001-08-01' - interval 84 day"
MONTHS = """select date_trunc('month', created_at) as m, count(distinct id) as n, sum(quantity) as q, sum(amount) as r
    from paid group by 1"""
PLACE = "d.address, d.city, d.state, d.country, d.status as delivery_status"
LINE = f"""o.id, o.reference, o.product_id, o.product_name, o.customer_name, cast(o.amount as double) as amount,
    o.quantity, o.status, {stamp('o.created_at')} as created_at"""
BY_REFERENCE = f"""select o.id, o.reference, o.product_id, p.name as product_name, o.customer_name,
    cast(o.amount as double) as amount, o.status, {stamp('o.created_at')} as created_at,
    {stamp('o.created_at')} as updated_at, p.total_stock, {images('p.id')}, {PLACE}
    from shop_lines o join shop_products p on p.id = o.product_id left join shop_deliveries d on d.order_id = o.reference"""
LINE_TOTAL = f"({money('p.price')} * c.quantity)"

BODIES: dict[str, str] = {
    "rp_product_catalog": f"select {P}, {images('p.id')} {FROM} order by p.created_at desc, p.id limit 10",
    "rp_category_products": f"select {SHORT}, {images('p.id')} {FROM}",
    "rp_product_detail": f"select {P}, {images('p.id')} {FROM}",
    "rp_product_with_images": f"""
        select p.id, p.category_id, p.name, p.description, p.howtouse, p.ingredients, p.benefits, p.price,
            cast(null as bigint) as user_id, p.total_stock, p.status, {stamp('p.created_at')} as created_at,
            {stamp('p.created_at')} as updated_at, {images('p.id')}
        from shop_products p""",
    "rp_best_selling": f"""
        select {P}, {images('p.id')}, cast({UNITS} as bigint) as total_sold,
            (select count(*) from paid o where o.product_id = p.id) as order_count
        {FROM} where p.status and {UNITS} > 0 order by total_sold desc, order_count desc, p.id limit 10""",
    "rp_new_products": f"""
        select {P}, {images('p.id')}, cast({UNITS} as bigint) as total_sold
        {FROM} where p.status order by p.created_at desc, p.id limit 10""",
    "rp_almost_sold_out": f"""
        select {P}, {images('p.id')}, cast({UNITS} as bigint) as total_sold,
            case when p.total_stock <= 5 then 'Low Stock' when p.total_stock <= 10 then 'Medium Stock' else 'In Stock' end as stock_status
        {FROM} where p.status and p.total_stock <= 10""",
    "rp_insights": """
        select 'sales_by_date' as type, cast(cast(created_at as date) as varchar) as category, cast(sum(amount) as double) as value
        from shop_lines group by 2
        union all select 'sales_by_product', any_value(p.name), cast(sum(o.amount) as double)
        from shop_lines o join shop_products p on p.id = o.product_id group by p.id
        union all select 'sales_by_user', any_value(u.name), cast(sum(o.amount) as double)
        from shop_lines o join shop_users u on u.id = o.user_id group by u.id
        union all select 'sales_by_category', c.name, cast(sum(o.amount) as double)
        from shop_lines o join shop_products p on p.id = o.product_id join shop_categories c on c.id = p.category_id group by c.name
        union all select 'order_summary', 'Total Orders', cast(count(*) as double) from paid
        union all select 'order_summary', 'Total Revenue', cast(sum(amount) as double) from paid
        union all select 'status_distribution', status, cast(count(*) as double) from shop_lines group by status""",
    "rp_sales_by_product": """
        select p.id as product_id, p.name as product_name, cast(sum(o.amount) as double) as total_sales,
            cast(sum(o.quantity) as bigint) as total_quantity
        from shop_lines o join shop_products p on p.id = o.product_id group by p.id, p.name""",
    "rp_dashboard": f"""
        select (select count(*) from shop_products) as total_products,
            (select cast(sum(total_stock) as bigint) from shop_products) as total_stock,
            (select count(*) from shop_products where total_stock <= 5) as low_stock_count,
            (select count(*) from shop_products where status) as active_products,
            (select cast(sum({money('price')}) as double) / count(price) from shop_products) as average_price,
            (select count(*) from shop_categories) as total_categories,
            (select count(*) from shop_categories where status) as active_categories,
            count(distinct id) as total_orders, cast(sum(quantity) as bigint) as total_items_sold,
            cast(sum(amount) as double) as total_revenue, count(distinct user_id) as unique_customers,
            cast(sum(amount) as double) / count(*) as average_order_value
        from paid""",
    "rp_dashboard_top_products": f"""
        select p.id, p.name, p.price, p.total_stock as stock, cast({UNITS} as bigint) as total_sold,
            (select coalesce(cast(sum(o.amount) as double), 0) from paid o where o.product_id = p.id) as total_revenue
        from shop_products p order by total_sold desc, p.id limit 5""",
    "rp_dashboard_low_stock": """
        select p.id, p.name, p.total_stock as stock, c.name as category_name
        from shop_products p join shop_categories c on c.id = p.category_id
        where p.total_stock <= 5 order by p.total_stock, p.id limit 5""",
    "rp_dashboard_category_sales": """
        select c.id, c.name, count(distinct o.id) as order_count, cast(coalesce(sum(o.quantity), 0) as bigint) as items_sold,
            coalesce(cast(sum(o.amount) as double), 0) as revenue
        from shop_categories c left join shop_products p on p.category_id = c.id left join paid o on o.product_id = p.id
        group by c.id, c.name""",
    "rp_monthly_sales": f"""
        select *, revenue / order_count as average_order_value from ({period_totals('month')})""",
    "rp_monthly_product_sales": f"""
        select {period('month')} as month, p.name as product_name, p.id as product_id,
            cast(sum(o.quantity) as bigint) as quantity_sold, cast(sum(o.amount) as double) as revenue,
            count(distinct o.id) as order_count
        from paid o join shop_products p on p.id = o.product_id group by 1, 2, 3""",
    "rp_monthly_category_sales": f"""
        select {period('month')} as month, c.name as category_name, c.id as category_id, count(distinct o.id) as order_count,
            cast(sum(o.quantity) as bigint) as items_sold, cast(sum(o.amount) as double) as revenue
        from paid o join shop_products p on p.id = o.product_id join shop_categories c on c.id = p.category_id group by 1, 2, 3""",
    "rp_monthly_summary": f"""
        select count(*) as total_months, cast(sum(n) as bigint) as total_orders, cast(sum(q) as bigint) as total_items_sold,
            cast(sum(r) as double) as total_revenue, {twelve_places('(2 * sum(a) + count(*)) // (2 * count(*))')} as overall_average_order_value
        from (select *, (2 * cast(r * 100 as hugeint) * 10000000000 + n) // (2 * n) as a from ({MONTHS}))""",
    "rp_weekly_sales": period_totals("week", WEEKS12),
    "rp_weekly_product_sales": period_names("week", WEEKS12),
    "rp_yearly_sales": period_totals("year"),
    "rp_yearly_product_sales": period_names("year"),
    "rp_yearly_category_sales": f"""
        select {period('year')} as year, c.name as category_name, count(distinct o.id) as order_count,
            cast(sum(o.quantity) as bigint) as items_sold, cast(sum(o.amount) as double) as revenue
        from paid o join shop_products p on p.id = o.product_id join shop_categories c on c.id = p.category_id group by 1, 2""",
    "rp_chart_monthly": f"""
        select strftime(min(o.created_at), '%b') as month, {period('month')} as month_date, count(distinct o.id) as order_count,
            cast(sum(o.amount) as double) as revenue
        from paid o where o.created_at >= timestamp '2001-02-01' group by 2""",
    "rp_chart_product_performance": f"""
        select t.product_name, w.week_date, w.week_number, cast(coalesce(s.q, 0) as bigint) as quantity_sold
        from (
            select p.name as product_name from paid o join shop_products p on p.id = o.product_id
            where o.created_at >= timestamp '2001-07-04' group by 1 order by sum(o.quantity) desc, 1 limit 3
        ) t cross join (
            select distinct {period('week')} as week_date,
                lpad(cast((dayofyear(o.created_at) - 1) // 7 + 1 as varchar), 2, '0') as week_number
            from paid o where o.created_at >= timestamp '2001-07-04'
        ) w left join (
            select p.name as product_name, {period('week')} as week_date,
                lpad(cast((dayofyear(o.created_at) - 1) // 7 + 1 as varchar), 2, '0') as week_number, sum(o.quantity) as q
            from paid o join shop_products p on p.id = o.product_id
            where o.created_at >= timestamp '2001-07-04' group by 1, 2, 3
        ) s on s.product_name = t.product_name and s.week_date = w.week_date and s.week_number = w.week_number""",
    "rp_chart_category_share": """
        select c.name as category_name, cast(sum(o.amount) as double) as total_revenue,
            round(cast(sum(o.amount) as double) * 100 / cast(sum(sum(o.amount)) over () as double), 2) as percentage
        from paid o join shop_products p on p.id = o.product_id join shop_categories c on c.id = p.category_id group by c.name""",
    "rp_category_counts": f"""
        select c.id as category_id, c.name as category_name, c.status, count(p.id) as product_count, {stamp('c.created_at')} as created_at
        from shop_categories c left join shop_products p on p.category_id = c.id group by c.id, c.name, c.status, c.created_at""",
    "rp_category_page": f"""
        select c.id as category_id, c.name as category_name, c.status, count(p.id) as product_count, {stamp('c.created_at')} as created_at
        from shop_categories c left join shop_products p on p.category_id = c.id group by c.id, c.name, c.status, c.created_at
        order by c.created_at, c.id limit 10 offset 10""",
    "rp_products_json_images": f"""
        select p.id as product_id, p.name as product_name, p.price as product_price, p.description as product_description,
            p.status as product_status, {stamp('p.created_at')} as created_at,
            coalesce((select string_agg(i.id || ':' || i.image_url, '|' order by i.id) from shop_images i where i.product_id = p.id), '') as images
        from shop_products p order by p.created_at, p.id limit 10 offset 5""",
    "rp_orders_page": f"""
        select {LINE}, o.user_id, u.email as user_email, {PLACE}
        from shop_lines o left join shop_users u on u.id = o.user_id left join shop_deliveries d on d.order_id = o.reference
        order by o.created_at desc, o.id limit 10 offset 10""",
    "rp_order_details": f"""
        select {LINE}, u.email as user_email, {PLACE}, p.description, p.total_stock, {images('o.product_id')}
        from shop_lines o left join shop_users u on u.id = o.user_id left join shop_deliveries d on d.order_id = o.reference
        left join shop_products p on p.id = o.product_id""",
    "rp_my_orders": f"""
        select {LINE}, {PLACE}
        from (select *, row_number() over (partition by user_id order by created_at desc, id) as place from shop_lines) o
        left join shop_deliveries d on d.order_id = o.reference where o.place <= 10""",
    "rp_customers_page": f"""
        select c.id as customer_id, c.user_id, c.phonenumber as phone_number, c.address, {stamp('c.created_at')} as created_at,
            u.name as user_name, u.email as user_email, count(o.id) as order_count
        from shop_customers c join shop_users u on u.id = c.user_id left join shop_lines o on o.user_id = c.user_id
        group by c.id, c.user_id, c.phonenumber, c.address, c.created_at, u.name, u.email
        order by c.created_at desc, c.id limit 10""",
    "rp_addresses": f"""
        select id, address, city, state, country, is_default_address, {stamp('created_at')} as created_at from shop_customers""",
    "rp_cart_view": f"""
        select c.id as cart_id, c.quantity, {stamp('c.created_at')} as created_at, {stamp('c.created_at')} as updated_at,
            p.id as product_id, p.name as product_name, p.price, p.description, p.total_stock, p.status, {images('p.id')},
            cast(sum({LINE_TOTAL}) over (partition by c.user_id) as double) as cart_total
        from shop_carts c join shop_products p on p.id = c.product_id""",
    "rp_checkout_quote": f"""
        select u.id as user_id, case when reason is null then cast(total * 100 as bigint) end as amount_minor,
            case when reason is null then lines end as lines, case when reason is null then a.address end as address,
            case when reason is null then a.city end as city, case when reason is null then a.state end as state,
            case when reason is null then a.country end as country, reason
        from shop_users u left join shop_customers a on a.user_id = u.id and a.is_default_address
        left join (
            select c.user_id as buyer, sum({LINE_TOTAL}) as total,
                string_agg(concat_ws(':', p.id, p.name, c.quantity, {money('p.price')}, cast({LINE_TOTAL} as decimal(18,2))), '|' order by p.id) as lines,
                first(p.name order by p.id) filter (where p.total_stock < c.quantity) as lacking
            from shop_carts c join shop_products p on p.id = c.product_id group by c.user_id
        ) b on b.buyer = u.id
        cross join lateral (select case when a.id is null then 'No default address found. Please add an address first.'
            when b.buyer is null then 'Cart is empty' when lacking is not null then 'Not enough stock for ' || lacking end as reason) r""",
    "rp_orders_by_reference": BY_REFERENCE,
    "rp_order_payment_details": f"""
        select b.*, 'success' as payment_status, b.created_at as paid_at, 'card' as channel,
            cast(k.total as double) as paid_amount, 'payer.' || k.user_id || '@example.com' as customer_email,
            'visa' as card_type, 'Test Bank' as bank, lpad(cast(b.reference % 10000 as varchar), 4, '0') as last4
        from ({BY_REFERENCE}) b join checkouts k on k.reference = b.reference
        where k.status = 'success' and k.reference % 11 <> 0 and k.reference % 23 <> 0""",
    "rp_json_order_quote": f"""
        select o.reference as order_key, p.id as product_id, p.name, p.description, p.price, o.quantity,
            cast({money('p.price')} * o.quantity as double) as product_total,
            cast(sum({money('p.price')} * o.quantity) over (partition by o.reference) as double) as total_price
        from shop_lines o join shop_products p on p.id = o.product_id""",
    "rp_page_envelope": """
        select entity, total_items, cast(ceil(total_items / 10.0) as bigint) as total_pages, 1 as current_page, 10 as items_per_page,
            case when entity not in ('categories', 'blogs') then total_items > 10 end as has_next_page,
            case when entity not in ('categories', 'blogs') then false end as has_prev_page
        from (
            select 'orders' as entity, count(*) as total_items from shop_lines
            union all select 'my_orders:' || user_id, count(*) from shop_lines group by user_id
            union all select 'customers', count(*) from shop_customers
            union all select 'categories', count(distinct id) from shop_categories
            union all select 'blogs', count(distinct id) from shop_blogs)""",
    "rp_blogs_page": f"""
        select id as blog_id, title as blog_title, status, cover_image, text_content, {stamp('created_at')} as created_at,
            {stamp('created_at')} as updated_at from shop_blogs order by shop_blogs.created_at, id limit 10""",
    "rp_blogs_all": f"""
        select id as blog_id, title as blog_title, status, cover_image, text_content, {stamp('created_at')} as created_at,
            {stamp('created_at')} as updated_at from shop_blogs""",
}

# The same reports for given keys.
ENDS = "in (select unnest([min({0}), max({0})]) from {1})"
RANGE = "between timestamp '1996-03-10' and timestamp '1998-08-20'"
BODIES |= {
    "rp_category_products_one": f"{BODIES['rp_category_products']} where p.category_id = (select max(category_id) from shop_products)",
    "rp_products_json_images_one": BODIES["rp_products_json_images"].replace(
        "from shop_products p order by p.created_at, p.id limit 10 offset 5",
        "from shop_products p where p.category_id = (select max(category_id) from shop_products) order by p.created_at, p.id limit 10 offset 2"),
    "rp_product_detail_keys": f"{BODIES['rp_product_detail']} where p.id {ENDS.format('id', 'shop_products')}",
    "rp_product_with_images_keys": f"{BODIES['rp_product_with_images']} where p.id {ENDS.format('id', 'shop_products')}",
    "rp_order_details_keys": f"{BODIES['rp_order_details']} where o.reference = (select max(reference) from shop_lines)",
    "rp_orders_by_reference_keys": f"{BY_REFERENCE} where o.reference {ENDS.format('reference', 'shop_lines')}",
    "rp_my_orders_one": BODIES["rp_my_orders"].replace(
        "where o.place <= 10", "where o.place between 6 and 10 and o.user_id = (select max(user_id) from shop_lines)"),
    "rp_orders_deep_page": f"""select * exclude (place, middle) from (
        select {LINE}, o.user_id, u.email as user_email, {PLACE},
            row_number() over (order by o.created_at desc, o.id) as place, count(*) over () // 20 * 10 as middle
        from shop_lines o left join shop_users u on u.id = o.user_id left join shop_deliveries d on d.order_id = o.reference)
        where place > middle and place <= middle + 10""",
    "rp_my_orders_deep": BODIES["rp_my_orders"].replace(
        "where o.place <= 10", "where o.place between 9 and 12 and o.user_id = (select max(user_id) from shop_lines)"),
    "rp_my_orders_deep_all": BODIES["rp_my_orders"].replace("where o.place <= 10", "where o.place between 19 and 24"),
    "rp_addresses_one": f"""{BODIES['rp_addresses']}
        where user_id = (select max(user_id) from shop_customers where not is_default_address)""",
    "rp_cart_view_one": f"{BODIES['rp_cart_view']} where c.user_id = (select max(user_id) from shop_carts)",
    "rp_monthly_sales_range": f"select *, revenue / order_count as average_order_value from ({period_totals('month', f'o.created_at {RANGE}')})",
    "rp_monthly_product_sales_range": BODIES["rp_monthly_product_sales"].replace("group by", f"where o.created_at {RANGE} group by"),
    "rp_monthly_category_sales_range": BODIES["rp_monthly_category_sales"].replace("group by", f"where o.created_at {RANGE} group by"),
    "rp_monthly_summary_range": BODIES["rp_monthly_summary"].replace(MONTHS, MONTHS.replace("group by", f"where created_at {RANGE} group by")),
}


BODIES |= {
    "st_rollup_product_sales": BODIES["rp_monthly_product_sales"],
    "st_rollup_category_sales": BODIES["rp_yearly_category_sales"],
    "st_rollup_customers": f"select *, true as sketch_is_close from ({period_totals('week')})",
}


def figures(section: str, report: str, *fields: str) -> str:
    """The fields of a one-row report as a row each."""
    listed = ", ".join(f"{{'field': '{name}', 'number': cast({name} as double)}}" for name in fields)
    return f"""select '{section}' as section, v.field as field, cast(0 as int) as place, cast(null as varchar) as text, v.number as number
        from (select unnest([{listed}]) as v from ({BODIES[report]}))"""


def entries(section: str, report: str, order: str, texts: list[str], numbers: list[str]) -> str:
    """The fields of a list's rows as a row each, with the row's place in the list."""
    listed = ", ".join(
        [f"{{'field': '{name}', 'text': cast({name} as varchar), 'number': cast(null as double)}}" for name in texts]
        + [f"{{'field': '{name}', 'text': null, 'number': cast({name} as double)}}" for name in numbers])
    return f"""select '{section}', v.field, place, v.text, v.number from (select place, unnest([{listed}]) as v
        from (select *, cast(row_number() over (order by {order}) - 1 as int) as place from ({BODIES[report]})))"""


def drawn(section: str, field: str, place: str, text: str, number: str, rows: str) -> str:
    return f"""select '{section}' as section, {field} as field, cast({place} - 1 as int) as place,
        cast({text} as varchar) as text, cast({number} as double) as number from ({rows})"""


BY_MONTH, BY_SHARE = "row_number() over (order by month_date)", "row_number() over (order by total_revenue desc, category_name)"
WEEKLY, SHARES = BODIES["rp_chart_product_performance"], BODIES["rp_chart_category_share"]
BODIES |= {
    "rp_dashboard_document": " union all ".join([
        figures("productMetrics", "rp_dashboard", "total_products", "total_stock", "low_stock_count", "active_products", "average_price"),
        figures("categoryMetrics", "rp_dashboard", "total_categories", "active_categories"),
        figures("salesMetrics", "rp_dashboard", "total_orders", "total_items_sold", "total_revenue", "unique_customers", "average_order_value"),
        entries("topProducts", "rp_dashboard_top_products", "total_sold desc, id", ["name"], ["id", "price", "stock", "total_sold", "total_revenue"]),
        entries("lowStockProducts", "rp_dashboard_low_stock", "stock, id", ["name", "category_name"], ["id", "stock"]),
        entries("categorySales", "rp_dashboard_category_sales", "revenue desc, id", ["id", "name"], ["order_count", "items_sold", "revenue"]),
    ]),
    "rp_charts_document": " union all ".join([
        drawn("monthlySales", "'labels'", BY_MONTH, "month", "null", BODIES["rp_chart_monthly"]),
        drawn("monthlySales", "'Revenue'", BY_MONTH, "null", "revenue", BODIES["rp_chart_monthly"]),
        drawn("monthlySales", "'Orders'", BY_MONTH, "null", "order_count", BODIES["rp_chart_monthly"]),
        drawn("productPerformance", "'labels'", "row_number() over (order by first)", "'Week ' || week_number", "null",
              f"select week_number, min(week_date) as first from ({WEEKLY}) group by 1"),
        drawn("productPerformance", "product_name", "row_number() over (partition by product_name order by week_date, week_number)",
              "null", "quantity_sold", WEEKLY),
        drawn("categoryDistribution", "'labels'", BY_SHARE, "category_name", "null", SHARES),
        drawn("categoryDistribution", "'data'", BY_SHARE, "null", "percentage", SHARES),
    ]),
}

REPORTS = {key: with_base(body) for key, body in BODIES.items()}
