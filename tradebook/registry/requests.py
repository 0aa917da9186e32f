"""Request operators and change application on batches derived from the whole tables.

The tables after a batch and its refused requests come back together, the latter with a reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.operators import requests
from tradebook.operators.apply import apply_changes
from tradebook.operators.audit import audit_rows
from tradebook.operators.rules import RuleOptions, accepted_changes, apply_rules
from tradebook.plans.batch import settle
from tradebook.registry.audits import update_text_sql
from tradebook.registry.rows import ORDER_DATE_SQL, UPDATE_SQL, as_of, update_sql
from tradebook.schema import KEYS, SCHEMAS
from tradebook.sources.testdata import AS_OF, delete_batch, load_tables, oracle, update_batch, view

BATCH_ID = "b1"

# Request frames; the texts mean the same in Spark and in the checking database.
_CREATE_SELLERS = """
    select seq, case when customer_state = 'SA' then '  ' when customer_state = 'SB' then null
                     else ' '||customer_zip_code_prefix||' ' end zip_code,
           case when customer_state = 'SC' then '' else customer_city||' ' end city,
           case when customer_state = 'SD' then 'SPX' when customer_state = 'SE' then null
                when customer_state = 'SF' then 'Ã' when customer_state = 'SG' then 'é '
                else lower(customer_state) end state
    from k_customers"""
_UPDATE_SELLERS = """
    select seq, case when order_item_id = 6 then substr(seller_id,1,31) when order_item_id = 7 then null
                     else ' '||seller_id end seller_id,
           case when order_item_id = 1 then ' '||substr(order_id,28) when order_item_id = 5 then ' ' end new_zip_code,
           case when order_item_id in (2,4) then 'city '||substr(product_id,30)||' ' end new_city,
           case when order_item_id = 3 and price < 20000 then 'tx' when order_item_id = 4 then 'abc' end new_state
    from k_order_items"""
_DELETE_SELLERS = """
    select seq, case when seller_state < 'SF' then ' '||seller_id||' ' when seller_state < 'SK' then substr(seller_id,1,31)
                     when seller_state < 'SP' then md5(seller_id) end seller_id
    from k_sellers"""
_CREATE_ORDERS = """
    select seq, case when order_status = 'created' then md5(customer_id) when order_status = 'invoiced' then substr(customer_id,1,31)
                     when order_status = 'unavailable' then null else ' '||customer_id end customer_id,
           case when order_status = 'shipped' then null
                when order_status = 'processing' then cast(order_estimated_delivery_date as date)
                when order_status = 'canceled' then date '2024-06-01'
                else cast(order_estimated_delivery_date + interval '30' year as date) end estimated_delivery
    from k_orders"""
_UPDATE_ORDERS = """
    select seq, case when order_item_id = 4 then substr(order_id,1,31) else order_id||'  ' end order_id,
           case when order_item_id = 1 then ' delivered ' when order_item_id = 3 then 'canceled' end new_status,
           case when order_item_id in (2,3) then shipping_limit_date end delivered_date
    from k_order_items"""
_DELETE_ORDERS = """
    select seq, case when order_status in ('created','canceled') then order_id||' ' when order_status = 'processing' then substr(order_id,1,31)
                     when order_status = 'shipped' then null else md5(order_id) end order_id
    from k_orders"""


def _with_rejected(outcome: requests.Outcome, contents: DataFrame, table: str, columns: dict[str, str | None]) -> DataFrame:
    """Rows after all changes that were asked for, then refused requests, under common column names."""
    # New rows have ids of their own, so they only follow the others.
    added = contents.unionByName(outcome.changes[table].select("new.*")) if table not in outcome.after else None
    kept = outcome.after.get(table, added).select(*columns, F.lit(None).cast("string").alias("reason"))
    types = dict(kept.dtypes)
    shown = [
        (F.lit(None) if source is None else F.col(source)).cast(types[name]).alias(name)
        for name, source in columns.items()
    ]
    return kept.unionByName(outcome.rejected.select(*shown, "reason"))


_SELLER_COLUMNS = {
    "seller_id": None,
    "seller_zip_code_prefix": "zip_code",
    "seller_city": "city",
    "seller_state": "state",
}
_PATCH_COLUMNS = {
    "seller_id": "seller_id",
    "seller_zip_code_prefix": "new_zip_code",
    "seller_city": "new_city",
    "seller_state": "new_state",
}
_ORDER_COLUMNS = {
    "order_id": None,
    "customer_id": "customer_id",
    "order_status": None,
    "order_purchase_timestamp": None,
    "order_estimated_delivery_date": "estimated_delivery",
}


def _create_sellers(spark, sf_dir):
    sellers = load_tables(spark, sf_dir, "sellers").sellers
    outcome = requests.create_sellers(view(spark, sf_dir, _CREATE_SELLERS), BATCH_ID)
    return _with_rejected(outcome, sellers, "sellers", _SELLER_COLUMNS)


def _find_sellers(spark, sf_dir):
    return requests.find_sellers(load_tables(spark, sf_dir, "sellers").sellers, " S_1 ", " sb ")


def _update_sellers(spark, sf_dir):
    sellers = load_tables(spark, sf_dir, "sellers").sellers
    outcome = requests.update_sellers(sellers, view(spark, sf_dir, _UPDATE_SELLERS))
    return _with_rejected(outcome, sellers, "sellers", _PATCH_COLUMNS)


def _delete_sellers(spark, sf_dir):
    sellers = load_tables(spark, sf_dir, "sellers").sellers
    outcome = requests.delete_sellers(sellers, view(spark, sf_dir, _DELETE_SELLERS))
    return _with_rejected(outcome, sellers, "sellers", {"seller_id": "seller_id", "seller_state": None})


def _create_orders(spark, sf_dir):
    tables = load_tables(spark, sf_dir, "orders", "customers")
    wanted = view(spark, sf_dir, _CREATE_ORDERS)
    outcome = requests.create_orders(tables.customers, wanted, as_of(), BATCH_ID)
    return _with_rejected(outcome, tables.orders, "orders", _ORDER_COLUMNS)


def _find_orders(spark, sf_dir):
    return requests.find_orders(load_tables(spark, sf_dir, "orders").orders, status=" shipped ")


def _update_orders(spark, sf_dir):
    orders = load_tables(spark, sf_dir, "orders").orders
    outcome = requests.update_orders(orders, view(spark, sf_dir, _UPDATE_ORDERS))
    shown = {
        "order_id": "order_id",
        "order_status": "new_status",
        "order_delivered_customer_date": "delivered_date",
    }
    return _with_rejected(outcome, orders, "orders", shown)


def _delete_orders_cascade(spark, sf_dir):
    tables = load_tables(spark, sf_dir, *requests.CASCADE)
    outcome = requests.delete_orders_cascade(tables, view(spark, sf_dir, _DELETE_ORDERS))

    def counted(part: str, frames: dict[str, DataFrame]) -> list[DataFrame]:
        return [
            df.agg(F.lit(table).alias("table_name"), F.lit(part).alias("part"), F.count("*").alias("row_count"))
            for table, df in frames.items()
        ]

    parts = counted("remaining", outcome.after) + counted("removed", outcome.changes)
    return reduce(DataFrame.unionByName, parts + counted("rejected", {"orders": outcome.rejected}))


def _audited(outcome: requests.Outcome, contents: DataFrame, table: str, options: RuleOptions) -> DataFrame:
    """What a batch of requests leaves: rows, audit texts, changes that break a rule, refused requests."""
    after, checked = settle(contents, outcome.changes[table], table, as_of(), options)
    key = KEYS[table][0]
    logged = audit_rows(checked, table, as_of(), BATCH_ID)
    broken = checked.where(F.col("reason").isNotNull())
    shown = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _SHOWN[table]])
    parts = [
        ("row", after, key, shown),
        ("audit", logged, F.col("seq").cast("string"), "action_desc"),
        ("broken rule", broken, f"new.{key}", "reason"),
        ("refused", outcome.rejected, key, "reason"),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            df.select(
                F.lit(part).alias("part"),
                (F.col(name) if isinstance(name, str) else name).alias("name"),
                (F.col(text) if isinstance(text, str) else text).alias("text"),
            )
            for part, df, name, text in parts
        ],
    )


_SHOWN = {
    "sellers": ("seller_zip_code_prefix", "seller_city", "seller_state"),
    "orders": ("order_status", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"),
}


def _update_sellers_audited(image: str):
    def query(spark, sf_dir):
        sellers = load_tables(spark, sf_dir, "sellers").sellers
        outcome = requests.update_sellers(sellers, view(spark, sf_dir, _UPDATE_SELLERS))
        return _audited(outcome, sellers, "sellers", RuleOptions(seller_location_image=image))

    return query


def _update_orders_audited(check: bool):
    def query(spark, sf_dir):
        orders = load_tables(spark, sf_dir, "orders").orders
        outcome = requests.update_orders(orders, view(spark, sf_dir, _UPDATE_ORDERS))
        return _audited(outcome, orders, "orders", RuleOptions(order_status_check=check))

    return query


_LATER = 1_000_000_000_000


def _apply_changes(table: str, deleted: str):
    """Accepted updates of the whole table, then the removal of some of its rows."""

    def query(spark, sf_dir):
        removals = delete_batch(spark, sf_dir, table).where(deleted).withColumn("seq", F.col("seq") + _LATER)
        checked = apply_rules(update_batch(spark, sf_dir, table).unionByName(removals), table, as_of())
        return apply_changes(getattr(load_tables(spark, sf_dir, table), table), accepted_changes(checked), table)

    return query


QUERIES = {
    "create_sellers": _create_sellers,
    "find_sellers": _find_sellers,
    "update_sellers": _update_sellers,
    "delete_sellers": _delete_sellers,
    "create_orders": _create_orders,
    "find_orders": _find_orders,
    "update_orders": _update_orders,
    "delete_orders_cascade": _delete_orders_cascade,
    "update_sellers_audited": _update_sellers_audited("old"),
    "update_orders_audited": _update_orders_audited(True),
    "update_orders_audited_any_status": _update_orders_audited(False),
    "apply_changes_orders": _apply_changes("orders", "old.order_status = 'canceled'"),
    "apply_changes_geolocation": _apply_changes("geolocation", "old.geolocation_state = 'SC'"),
}


def _has_length(column: str, size: int) -> str:
    return f"ifnull(octet_length(encode(trim({column}))) = {size}, false)"


_CREATE_SELLERS_REASON = f"""case
    when ifnull(trim(zip_code), '') = '' then 'Input Validation Failed: Zip Code prefix cannot be null or empty.'
    when ifnull(trim(city), '') = '' then 'Input Validation Failed: City name cannot be null or empty.'
    when not {_has_length("state", 2)}
    then 'Input Validation Failed: State must be a valid 2-character abbreviation (e.g., SP).' end"""
_UPDATE_SELLERS_REASON = f"""case
    when not {_has_length("seller_id", 32)}
    then 'Validation Error: Invalid Seller ID. Must be a non-null 32-character hex string.'
    when trim(new_zip_code) = '' or trim(new_city) = '' or trim(new_state) = ''
    then 'Validation Error: New modification properties cannot be blank text blocks.'
    when new_state is not null and not {_has_length("new_state", 2)}
    then 'Validation Error: Target modification state code must be exactly 2 characters.' end"""
_DELETE_SELLERS_REASON = f"""case when not {_has_length("seller_id", 32)}
    then 'Validation Error: Deletion halted. Target Seller ID must be exactly 32 characters.' end"""
_CREATE_ORDERS_REASON = f"""case
    when not {_has_length("customer_id", 32)}
    then 'Validation Error: Customer ID must be a non-null 32-character hex hash.'
    when estimated_delivery is null or estimated_delivery < date '2024-06-01'
    then 'Validation Error: Estimated delivery date cannot be empty or in the past.'
    when trim(customer_id) not in (select customer_id from x_customers)
    then 'Integrity Error: Provided Customer ID does not exist in the database.' end"""
_UPDATE_ORDERS_REASON = f"""case when not {_has_length("order_id", 32)}
    then 'Validation Error: Targeted Order ID must be exactly 32 characters.' end"""
_DELETE_ORDERS_REASON = f"""case when not {_has_length("order_id", 32)}
    then 'Validation Error: Target deletion hash length is invalid.' end"""


def _checked(text: str, reason: str) -> str:
    return f"(select *, {reason} as reason from ({text}) r)"


def _given(value: str) -> str:
    return f"arg_max(trim({value}), seq) filter (where {value} is not null)"


_NO_REASON = "cast(null as varchar) as reason"
_DELETED_IDS = f"(select trim(order_id) from {_checked(_DELETE_ORDERS, _DELETE_ORDERS_REASON)} c where reason is null)"
_COUNTS = " union all ".join(
    f"""select '{t}' as table_name, 'remaining' as part, cast(count(*) as bigint) as row_count
        from x_{t} where order_id not in {_DELETED_IDS} union all
        select '{t}', 'removed', cast(count(*) as bigint) from x_{t} where order_id in {_DELETED_IDS}"""
    for t in requests.CASCADE
)
_KEPT_ORDER_COLUMNS = ", ".join(
    f"case when u.reason is null then u.{c} else o.{c} end as {c}" for c in SCHEMAS["orders"].fieldNames()
)
_KEPT_GEO_COLUMNS = ", ".join(
    f"case when reason is null then {c} else old_{c} end as {c}" for c in SCHEMAS["geolocation"].fieldNames()
)


def _audited_sql(table: str, requests_sql: str, reason: str, patched: dict[str, str], rule: str | None = None) -> str:
    """What a batch of updates leaves, in the shape of ``_audited``."""
    key, names = KEYS[table][0], SCHEMAS[table].fieldNames()
    values, rule_of_table = UPDATE_SQL[table]
    text, logged = update_text_sql(table)
    given = ", ".join(f"{value} as patch_{c}" for c, value in patched.items())
    images = ", ".join(f"{c} as old_{c}, {f'ifnull(patch_{c}, {c})' if c in patched else c} as new_{c}" for c in names)
    ruled = ", ".join(f"{values.get(c, 'new_' + c)} as {c}, old_{c}" for c in names)
    shown = [f"case when r.{key} is not null and r.reason is null then r.{c} else t.{c} end" for c in _SHOWN[table]]
    return f"""with checked as {_checked(requests_sql, reason)},
        patch as (select trim({key}) target, max(seq) seq, {given} from checked where reason is null group by 1),
        changed as (select seq, {images} from x_{table} join patch on {key} = target),
        ruled as (select seq, {ruled}, {rule or rule_of_table} as reason from changed)
        select 'row' as part, t.{key} as name,
            concat_ws('|', {', '.join(f"ifnull(cast({c} as varchar), '-')" for c in shown)}) as text
        from x_{table} t left join ruled r on t.{key} = r.{key}
        union all select 'audit', cast(seq as varchar), {text} from ruled where reason is null and {logged}
        union all select 'broken rule', {key}, reason from ruled where reason is not null
        union all select 'refused', {key}, reason from checked where reason is not null"""


_SELLER_PATCH = {
    "seller_zip_code_prefix": _given("new_zip_code"),
    "seller_city": _given("new_city"),
    "seller_state": f"upper({_given('new_state')})",
}
_ORDER_PATCH = {
    "order_status": _given("new_status"),
    "order_delivered_customer_date": "arg_max(delivered_date, seq) filter (where delivered_date is not null)",
}

ORACLES = {
    name: oracle(text)
    for name, text in {
        "create_sellers": f"""select seller_id, seller_zip_code_prefix, seller_city, seller_state, {_NO_REASON}
            from x_sellers union all
            select case when reason is null then md5('{BATCH_ID}:' || cast(seq as varchar)) end,
                   case when reason is null then trim(zip_code) else zip_code end,
                   case when reason is null then trim(city) else city end,
                   case when reason is null then upper(trim(state)) else state end, reason
            from {_checked(_CREATE_SELLERS, _CREATE_SELLERS_REASON)} c""",
        "find_sellers": """select seller_id, seller_zip_code_prefix, seller_city, seller_state from x_sellers
            where seller_id like '%S_1%' and seller_state = 'SB'""",
        "update_sellers": f"""with checked as {_checked(_UPDATE_SELLERS, _UPDATE_SELLERS_REASON)},
            patch as (select trim(seller_id) target, {_given("new_zip_code")} zip, {_given("new_city")} city,
                             upper({_given("new_state")}) state
                      from checked where reason is null group by 1)
            select seller_id, ifnull(zip, seller_zip_code_prefix) as seller_zip_code_prefix,
                   ifnull(city, seller_city) as seller_city, ifnull(state, seller_state) as seller_state, {_NO_REASON}
            from x_sellers left join patch on seller_id = target
            union all select seller_id, new_zip_code, new_city, new_state, reason from checked
            where reason is not null""",
        "delete_sellers": f"""with checked as {_checked(_DELETE_SELLERS, _DELETE_SELLERS_REASON)}
            select seller_id, seller_state, {_NO_REASON} from x_sellers
            where seller_id not in (select trim(seller_id) from checked where reason is null)
            union all select seller_id, null, reason from checked where reason is not null""",
        "create_orders": f"""select order_id, customer_id, order_status, order_purchase_timestamp,
                   order_estimated_delivery_date, {_NO_REASON} from x_orders union all
            select case when reason is null then md5('{BATCH_ID}:' || cast(seq as varchar)) end,
                   case when reason is null then trim(customer_id) else customer_id end,
                   case when reason is null then 'created' end,
                   case when reason is null then timestamp '{AS_OF}' end,
                   cast(estimated_delivery as timestamp), reason
            from {_checked(_CREATE_ORDERS, _CREATE_ORDERS_REASON)} c""",
        "find_orders": """select order_id, customer_id, order_status, order_purchase_timestamp,
                   order_delivered_customer_date, order_estimated_delivery_date
            from x_orders where order_status = 'shipped' order by order_id limit 100""",
        "update_orders": f"""with checked as {_checked(_UPDATE_ORDERS, _UPDATE_ORDERS_REASON)},
            patch as (select trim(order_id) target, {_given("new_status")} status,
                             arg_max(delivered_date, seq) filter (where delivered_date is not null) delivered
                      from checked where reason is null group by 1)
            select order_id, ifnull(status, order_status) as order_status,
                   ifnull(delivered, order_delivered_customer_date) as order_delivered_customer_date, {_NO_REASON}
            from x_orders left join patch on order_id = target
            union all select order_id, new_status, delivered_date, reason from checked where reason is not null""",
        "delete_orders_cascade": f"""{_COUNTS} union all select 'orders', 'rejected', cast(count(*) as bigint)
            from {_checked(_DELETE_ORDERS, _DELETE_ORDERS_REASON)} c where reason is not null""",
        "update_sellers_audited": _audited_sql("sellers", _UPDATE_SELLERS, _UPDATE_SELLERS_REASON, _SELLER_PATCH),
        "update_orders_audited": _audited_sql("orders", _UPDATE_ORDERS, _UPDATE_ORDERS_REASON, _ORDER_PATCH),
        "update_orders_audited_any_status": _audited_sql(
            "orders", _UPDATE_ORDERS, _UPDATE_ORDERS_REASON, _ORDER_PATCH, f"case {ORDER_DATE_SQL} end"
        ),
        "apply_changes_orders": f"""select {_KEPT_ORDER_COLUMNS} from x_orders o
            join ({update_sql("orders")}) u on o.order_id = u.order_id where o.order_status <> 'canceled'""",
        "apply_changes_geolocation": f"""select {_KEPT_GEO_COLUMNS}
            from ({update_sql("geolocation", old_images=True)}) u where old_geolocation_state <> 'SC'""",
    }.items()
}
