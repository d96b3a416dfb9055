"""The shop's tables and request logs as SQL over the test tables, and the text forms of values."""

from __future__ import annotations

import re

UNKNOWN = 1_000_000_000
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def trimmed(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {BLANKS})"


def uuid(expr: str) -> str:
    h = f"sha256({expr})"
    return "concat_ws('-', " + ", ".join(
        f"substr({h}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def number_key(expr: str) -> str:
    return f"cast('0x' || substr(sha256({expr}), 1, 15) as bigint)"


def value(*exprs: str) -> str:
    """Columns as one text, absent ones as a tilde."""
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({e} as varchar), '~')" for e in exprs) + ")"


def money(expr: str) -> str:
    return f"cast({expr} as decimal(18,2))"


BASE: dict[str, str] = {
    "shop_categories": """
        select p_brand as id, p_brand as name, any_value(cast(substr(p_brand, 7) as int)) % 5 <> 0 as status,
            timestamp '1995-01-01' + to_days(any_value(cast(substr(p_brand, 7) as int))) as created_at
        from part group by p_brand""",
    "shop_products": """
        select p_partkey as id, p_brand as category_id, p_name as name, p_type as description,
            p_retailprice as price, p_size as total_stock, p_partkey % 10 <> 0 as status,
            timestamp '1995-01-01' + to_days(cast(p_partkey % 2400 as int)) as created_at,
            'Apply this product' as howtouse, cast(null as varchar) as benefits, cast(null as varchar) as ingredients
        from part""",
    "shop_images": """
        select distinct 'i' || l_partkey || '-' || l_suppkey as id, l_partkey as product_id,
            'img/' || l_partkey || '/' || l_suppkey as image_url
        from lineitem""",
    "shop_lines": """
        select l_orderkey || '-' || l_partkey as id, l_orderkey as reference, l_partkey as product_id,
            'Part#' || l_partkey as product_name, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') as customer_name,
            o_custkey as user_id, cast(sum(l_quantity) as bigint) as quantity,
            sum(cast(l_extendedprice as decimal(12,2))) as amount,
            case when o_orderstatus = 'F' then 'success' when o_orderstatus = 'P' then 'pending'
                when o_orderpriority = '5-LOW' then 'declined' else 'initiated' end as status,
            o_orderdate as created_at
        from lineitem join orders on l_orderkey = o_orderkey
        group by l_orderkey, l_partkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate""",
    "paid": "select * from shop_lines where status = 'success'",
    "shop_users": """
        select c_custkey as id, c_name as name, lower(replace(c_name, '#', '.')) || '@example.com' as email,
            case when c_custkey = 0 then 1 else 2 end as role_id
        from customer""",
    "shop_customers": """
        select 'a' || c_custkey as id, c_custkey as user_id, lpad(cast(c_custkey as varchar), 10, '0') as phonenumber,
            c_name || ' street' as address, c_mktsegment as city, n_name as state, r_name as country,
            true as is_default_address, timestamp '1995-01-01' as created_at
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        union all
        select 'b' || c_custkey, c_custkey, lpad(cast(c_custkey as varchar), 10, '0'),
            c_name || ' second', c_mktsegment, n_name, r_name, false, timestamp '1996-01-01'
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where c_custkey % 3 = 0""",
    "shop_deliveries": """
        select o_orderkey as order_id, a.address, a.city, a.state, a.country,
            case when o_orderkey % 3 = 0 then 'delivered' when o_orderkey % 3 = 1 then 'sentout' else 'pending' end as status
        from orders join shop_customers a on a.user_id = o_custkey and a.is_default_address
        where o_orderstatus = 'F'""",
    "shop_blogs": """
        select doc_id as id, source || ' ' || lang || ' ' || doc_id as title, source as cover_image, text as text_content,
            doc_id % 2 = 0 as status, timestamp '2024-01-01' + to_minutes(cast(doc_id as int)) as created_at
        from documents""",
    "cart_log": """
        select event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as product_id,
            1 + cast(floor(value) as bigint) % 10 as quantity
        from events""",
    "shop_carts": """
        select 'c' || user_id || '-' || product_id as id, user_id, product_id, quantity, ts as created_at
        from (
            select *, row_number() over (partition by user_id, product_id order by ts desc, event_id desc) as place
            from cart_log where event_type in ('click', 'error')
        ) s
        where place = 1 and event_type = 'click' and not exists (
            select 1 from cart_log p where p.event_type = 'purchase' and p.user_id = s.user_id
                and (p.ts > s.ts or (p.ts = s.ts and p.event_id > s.event_id)))""",
    # One row per checkout with what its payment event says.
    "checkouts": """
        select reference, any_value(user_id) as user_id, any_value(status) as status,
            any_value(created_at) as created_at, sum(amount) as total,
            count(*) filter (where product_id % 13 <> 0) as complete_lines
        from shop_lines group by reference""",
    "events_sent": """
        select reference || '#' || n as event_id, n, c.*
        from checkouts c, (values (1), (2)) sendings(n) where n = 1 or reference % 7 = 0""",
    # What is wrong with an event that is genuine, paid and new.
    "faulty_events": """
        select *, n = 1 and reference % 49 = 0 as failed_first, case
            when user_id % 17 = 0 or (n = 1 and reference % 21 = 0) then
                'Delivery address details are incomplete. Please provide complete address information.'
            when user_id % 19 = 0 or (n = 1 and reference % 35 = 0) then 'User not found'
            when complete_lines = 0 then 'No valid orders were created' end as fault
        from events_sent""",
    "judged_events": """
        select *, case
            when reference % 11 = 0 then 'Invalid signature'
            when status = 'declined' then 'Payment verification failed: Declined'
            when status <> 'success' or failed_first then 'Payment verification failed: Unknown error'
            when reference % 23 = 0 then 'Invalid payment reference'
            when created_at < timestamp '1998-01-01' or n > first_good then 'passed over'
            else fault end as reason
        from (select *, min(case when fault is null and not failed_first then n end) over (partition by reference) as first_good
            from faulty_events)""",
    "accepted": "select * from judged_events where reason is null",
    "new_orders": """
        select l.* from shop_lines l where product_id % 13 <> 0 and reference in (select reference from accepted)""",
    # Request logs.
    "signups": """
        select event_id as request_id, user_id, value, case when value < 3 then '' else 'Shopper ' || user_id end as name,
            case when value < 1 then null when value >= 60 then 'customer.' || lpad(cast(user_id as varchar), 9, '0') || '@example.com'
                else 'shopper.' || user_id || '@example.com' end as email
        from events where event_type = 'signup'""",
    "new_products": """
        select p_partkey as request_id, case when p_partkey % 11 = 0 then '' else p_name end as product_name,
            case when p_partkey % 13 = 0 then '' when p_partkey % 17 = 0 then 'n/a'
                else cast(cast(p_retailprice as decimal(12,2)) as varchar) end as price,
            case when p_partkey % 19 = 0 then 'many' else cast(p_size as varchar) end as total_stock,
            p_type as description, p_brand as category_id, p_size % 4 as image_count
        from part""",
    "judged_products": """
        select *, case when product_name = '' or price = '' then
                'Please enter all required fields (productName, price, description, categoryId, totalStock)'
            when image_count = 0 then 'Please provide at least one image' end as reason
        from new_products""",
    "product_changes": """
        select event_id as request_id, case when value < 0.5 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as product_id,
            case when event_type = 'view' then 'Renamed ' || event_id end as name,
            case when event_type = 'click' and floor(value) <> 0 then floor(value) end as price,
            case when event_type = 'purchase' and cast(floor(value) as bigint) % 20 <> 0 then cast(floor(value) as bigint) % 20 end as total_stock,
            case when event_type = 'error' then false when event_type = 'signup' then true end as status,
            case when event_type = 'view' and value > 100 then 'img/new/' || event_id end as image_url
        from events""",
    "product_forms": f"""
        select p_partkey as request_id, case when p_partkey % 23 = 0 then p_partkey + {UNKNOWN} else p_partkey end as product_id,
            'New ' || p_name as name, p_retailprice + 1 as price, p_brand as category_id, p_size - 1 as total_stock,
            p_partkey % 3 = 0 as activate,
            p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_size = 1 as incomplete
        from part""",
    "cart_requests": f"""
        select event_id as request_id, ts, user_id,
            case event_type when 'signup' then null when 'error' then product_id + {UNKNOWN} else product_id end as product_id,
            case when event_type = 'purchase' then 0 else quantity end as quantity
        from cart_log""",
    "cart_verdicts": """
        select r.*, case when r.product_id is null or r.quantity = 0 then 'Product ID and quantity are required'
            when p.id is null then 'Product not found'
            when p.total_stock < r.quantity then 'Not enough stock available' end as reason
        from cart_requests r left join shop_products p on p.id = r.product_id""",
    "quantity_verdicts": """
        select r.*, case when r.quantity < 1 then 'Valid quantity is required'
            when c.id is null then 'Cart item not found'
            when p.total_stock < r.quantity then 'Not enough stock available' end as reason
        from (
            select event_id as request_id, ts, case when event_type = 'error' then user_id + 1 else user_id end as user_id,
                'c' || user_id || '-' || product_id as cart_id,
                case when event_type = 'view' then quantity - 5 else quantity * 4 end as quantity
            from cart_log
        ) r left join shop_carts c on c.id = r.cart_id and c.user_id = r.user_id
        left join shop_products p on p.id = c.product_id""",
    "removal_requests": """
        select event_id as request_id, case when event_type = 'purchase' then user_id + 1 else user_id end as user_id,
            case when event_type = 'signup' then null when event_type = 'error' then 'no such row'
                when event_type = 'click' and event_id % 4 <> 0 then '' else 'c' || user_id || '-' || product_id end as cart_id
        from cart_log""",
    "address_forms": f"""
        select event_id as request_id, ts, case when event_type = 'signup' then user_id + {UNKNOWN} else user_id end as user_id,
            'Road ' || event_id as address, 'City ' || user_id as city, event_type as state, 'Home' as country,
            value > 100 as flagged, value < 2 as incomplete
        from events""",
    "address_changes": """
        select event_id as request_id, user_id, case when event_type in ('view', 'click') then 'a' || user_id
                when event_type in ('purchase', 'signup') then 'b' || user_id else 'a' || (user_id + 1) end as address_id,
            'Road ' || event_id as address, 'City ' || user_id as city, event_type as state, 'Home' as country,
            value > 90 as flagged, value < 2 as incomplete
        from events""",
    "address_change_verdicts": """
        select r.*, case when incomplete then 'All address fields are required'
            when c.id is null then 'Address not found' end as reason
        from address_changes r left join shop_customers c on c.id = r.address_id and c.user_id = r.user_id""",
    "address_removals": """
        select event_id as request_id, user_id, case event_type when 'signup' then 'a' || user_id when 'error' then 'b' || user_id
            when 'purchase' then 'a' || (user_id + 1) when 'view' then 'z' || user_id end as address_id
        from events""",
    # The n-th distinct own address a user asks to remove goes while another one is left.
    "removal_steps": """
        select request_id, address_id, user_id, tries,
            case when tries = 1 then row_number() over (partition by user_id, tries order by request_id) end as step, held
        from (
            select r.*, row_number() over (partition by address_id, r.user_id order by request_id) as tries,
                (select count(*) from shop_customers o where o.user_id = r.user_id) as held
            from address_removals r join shop_customers c on c.id = r.address_id and c.user_id = r.user_id
        ) x""",
    "removed_addresses": "select address_id, user_id, request_id from removal_steps where tries = 1 and step < held",
    "customer_forms": """
        select c_custkey as form_id, c_custkey as k, cast(c_custkey as varchar) as t, c_name from customer""",
}


def with_base(body: str) -> str:
    """The query with the common table expressions it needs, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BASE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BASE[name])

    visit(body)
    parts = [f"{name} as ({BASE[name]})" for name in BASE if name in needed]
    return f"with {', '.join(parts)} {body}" if parts else body
