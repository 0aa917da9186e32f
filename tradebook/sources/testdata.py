"""The given star-schema tables seen as the retail model.

Each view is one SQL text that means the same in Spark and in the checking database. ``k_<t>``
is the model table plus ``seq``, a number unique per row that comes from the source keys;
``x_<t>`` is the model table, ``i_<t>`` a batch of rows to insert, ``u_<t>`` a batch of updates
with ``old_`` and ``new_`` images. Every view covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tradebook.schema import SCHEMAS, Tables

AS_OF = "2024-06-01 00:00:00"

# Schemas are given so that building a query starts no job to infer them.
SOURCE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}

_MODEL = {
    "k_customers": """
        select c_custkey seq, lpad(cast(c_custkey as string),32,'C') customer_id,
               lpad(cast(c_custkey as string),32,'U') customer_unique_id,
               lpad(cast(c_custkey as string),5,'0') customer_zip_code_prefix,
               case when c_custkey%31<>0 then lower(c_mktsegment) end customer_city,
               case when c_custkey%29<>0 then 'S'||chr(65+c_nationkey) end customer_state
        from {customer}""",
    "k_sellers": """
        select s_suppkey seq, lpad(cast(s_suppkey as string),32,'S') seller_id,
               lpad(cast(s_suppkey as string),5,'0') seller_zip_code_prefix,
               lower(n_name) seller_city, 'S'||chr(65+s_nationkey) seller_state
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "k_products": """
        select p_partkey seq, lpad(cast(p_partkey as string),32,'P') product_id,
               case when p_size = 40 then null
                    else lower(p_type)||'_'||cast(p_size%12 as string) end product_category_name,
               cast(length(p_name) as int) product_name_length, p_size*10 product_description_length,
               p_size%6 product_photos_qty, cast(floor(p_retailprice) as int) product_weight_g,
               p_size product_length_cm, p_size%20 product_height_cm, p_size%30 product_width_cm
        from {part}""",
    "k_order_items": """
        select l_orderkey*1000+order_item_id seq, lpad(cast(l_orderkey as string),32,'O') order_id,
               order_item_id, lpad(cast(l_partkey as string),32,case when l_partkey%41=0 then 'X' else 'P' end) product_id,
               lpad(cast(l_suppkey as string),32,case when l_suppkey%37=0 then 'X' else 'S' end) seller_id, l_shipdate shipping_limit_date,
               cast(l_extendedprice as decimal(10,2)) price,
               case when l_tax > 0 then cast(cast(l_quantity as int) as decimal(10,2)) end freight_value
        from (select *, cast(row_number() over (partition by l_orderkey
                        order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                                 l_discount, l_tax, l_shipdate) as int) order_item_id
              from {lineitem}) numbered""",
    "k_orders": """
        select o_orderkey seq, lpad(cast(o_orderkey as string),32,'O') order_id,
               lpad(cast(o_custkey as string),32,case when o_custkey%43=0 then 'X' else 'C' end) customer_id,
               case when o_orderstatus='F' then 'delivered' when o_orderstatus='P' then 'shipped'
                    when o_orderpriority like '1%' then 'canceled' when o_orderpriority like '2%' then 'created'
                    when o_orderpriority like '3%' then 'processing' when o_orderpriority like '4%' then 'invoiced'
                    else 'unavailable' end order_status,
               o_orderdate order_purchase_timestamp,
               case when o_orderkey%11=0 then null else o_orderdate + interval '1' day end order_approved_at,
               case when o_orderstatus='O' then null else o_orderdate + interval '3' day end order_delivered_carrier_date,
               case when o_orderstatus='F' and o_orderkey%17<>0
                    then o_orderdate + interval '1' day * cast(10+o_orderkey%31 as int)
               end order_delivered_customer_date,
               o_orderdate + interval '20' day order_estimated_delivery_date
        from {orders}""",
    "k_order_payments": """
        select o_orderkey*10+1 seq, lpad(cast(o_orderkey as string),32,'O') order_id, 1 payment_sequential,
               case o_orderkey%4 when 0 then 'credit_card' when 1 then 'boleto'
                                 when 2 then 'voucher' else 'debit_card' end payment_type,
               case when o_orderkey%4=0 then cast(1+o_orderkey%10 as int) else 1 end payment_installments,
               cast(o_totalprice as decimal(10,2)) payment_value
        from {orders}
        union all
        select o_orderkey*10+2, lpad(cast(o_orderkey as string),32,'O'), 2, 'voucher', 1,
               cast(o_orderkey%5000 as decimal(10,2))
        from {orders} where o_orderpriority = '1-URGENT'""",
    "k_order_reviews": """
        select o_orderkey*10+number seq, lpad(cast(o_orderkey*10+number as string),32,'R') review_id,
               lpad(cast(o_orderkey as string),32,case when o_orderkey%59=0 then 'X' else 'O' end) order_id,
               case when o_orderkey%23=0 then null else cast(1+(o_orderkey*7+o_custkey+number)%5 as int) end review_score,
               case when o_orderpriority = '5-LOW' then null
                    else 'title '||cast(o_orderkey%9 as string) end review_comment_title,
               o_orderpriority review_comment_message, o_orderdate + interval '25' day review_creation_date,
               o_orderdate + interval '28' day review_answer_timestamp
        from (select *, 1 number from {orders} where o_orderstatus <> 'P' union all
              select *, 2 number from {orders} where o_orderstatus <> 'P' and o_orderkey%6=0 union all
              select *, 3 number from {orders} where o_orderkey%30=0) reviewed""",
    "k_geolocation": """
        select c_custkey seq, lpad(cast(c_custkey as string),5,'0') geolocation_zip_code_prefix,
               cast(c_custkey*37%18000 as double)/100.7-89 geolocation_lat,
               cast(c_custkey*53%36000 as double)/100.3-179 geolocation_lng,
               lower(c_mktsegment) geolocation_city, 'S'||chr(65+c_nationkey) geolocation_state
        from {customer}""",
    "k_product_category_name_translation": """
        select min(seq) seq, product_category_name, upper(product_category_name) product_category_name_english
        from k_products where product_category_name is not null group by product_category_name""",
}

# Rows to insert: the model row with these columns made unclean.
_INSERT = {
    "customers": {"customer_state": "lower(customer_state)"},
    "sellers": {"seller_state": "lower(seller_state)"},
    "order_items": {
        "price": "case when order_item_id = 3 then -price else price end",
        "freight_value": "case when order_item_id = 2 then -freight_value else freight_value end",
    },
    "order_payments": {
        "payment_sequential": "case when payment_type = 'boleto' then -payment_sequential else payment_sequential end",
        "payment_installments": "case when payment_type = 'voucher' then -payment_installments else payment_installments end",
        "payment_value": "case when payment_type = 'debit_card' then -payment_value else payment_value end",
    },
    "products": {
        "product_name_length": "case when product_photos_qty = 0 then -product_name_length else product_name_length end",
        "product_description_length": "case when product_photos_qty = 1 then -product_description_length else product_description_length end",
        "product_photos_qty": "case when product_height_cm = 5 then null else -product_photos_qty end",
        "product_weight_g": "case when product_photos_qty = 2 then -product_weight_g else product_weight_g end",
        "product_length_cm": "case when product_photos_qty = 3 then -product_length_cm else product_length_cm end",
        "product_height_cm": "case when product_photos_qty = 4 then -product_height_cm else product_height_cm end",
        "product_width_cm": "case when product_photos_qty = 5 then -product_width_cm else product_width_cm end",
    },
    "orders": {
        "order_status": "case when order_status = 'processing' then null else order_status end",
        "order_purchase_timestamp": "case when order_status = 'created' then null else order_purchase_timestamp end",
        "order_estimated_delivery_date": "case when order_status = 'unavailable' then null else order_estimated_delivery_date end",
    },
    "geolocation": {
        "geolocation_lat": "case when geolocation_city = 'building' then geolocation_lat*2 when geolocation_city = 'household' then null else geolocation_lat end",
        "geolocation_lng": "case when geolocation_city in ('building','furniture') then geolocation_lng*2 else geolocation_lng end",
        "geolocation_state": "lower(geolocation_state)",
    },
    "order_reviews": {},
    "product_category_name_translation": {},
}

# Updates: columns whose old or new image differs from the model row.
_UPDATE_OLD = {
    "sellers": {"seller_zip_code_prefix": "case when seller_state = 'SC' then null else seller_zip_code_prefix end"},
    "products": {"product_weight_g": "case when product_photos_qty = 4 then null else product_weight_g end"},
    "order_reviews": {"review_comment_message": "case when review_score = 2 then null else review_comment_message end"},
}
_UPDATE_NEW = {
    "customers": {
        "customer_unique_id": "case when customer_city = 'building' then null when customer_city = 'household' then md5(customer_unique_id) else customer_unique_id end",
        "customer_zip_code_prefix": "case when customer_city in ('machinery','household') then '00000' else customer_zip_code_prefix end",
        "customer_state": "case when customer_city = 'machinery' and customer_state < 'SH' then null when customer_city = 'furniture' then null else lower(customer_state) end",
    },
    "sellers": {
        "seller_city": "case when seller_state < 'SK' then 'austin' else seller_city end",
        "seller_state": "case when seller_state < 'SF' then 'tx' when seller_state = 'SX' then null else lower(seller_state) end",
    },
    "order_items": {
        "product_id": "case when order_item_id = 1 then md5(product_id) else product_id end",
        "seller_id": "case when order_item_id = 4 then md5(seller_id) else seller_id end",
        "shipping_limit_date": "case when order_item_id = 2 then shipping_limit_date + interval '1' day else shipping_limit_date end",
        "price": "case when order_item_id = 3 then -price when order_item_id <= 2 then cast(price + 1 as decimal(10,2)) else price end",
        "freight_value": "case when order_item_id = 5 then -freight_value when order_item_id = 1 then cast(7.5 as decimal(10,2)) else freight_value end",
    },
    "order_payments": {
        "payment_installments": "case when payment_type = 'boleto' then -payment_installments when payment_type = 'credit_card' then payment_installments + 1 else payment_installments end",
        "payment_value": "case when payment_sequential = 2 then -payment_value when payment_type = 'voucher' then cast(payment_value + 10 as decimal(10,2)) when payment_type = 'credit_card' and payment_installments = 5 then null else payment_value end",
    },
    "products": {
        "product_category_name": "case when product_photos_qty = 5 then null when product_photos_qty = 3 then 'test' else product_category_name end",
        "product_name_length": "case when product_photos_qty = 0 then -product_name_length - 1 else product_name_length end",
        "product_description_length": "case when product_photos_qty = 1 then -666 else product_description_length end",
        "product_photos_qty": "case when product_height_cm = 5 then null else product_photos_qty end",
        "product_weight_g": "case when product_photos_qty = 1 then -product_weight_g - 1 else product_weight_g end",
        "product_length_cm": "case when product_photos_qty = 2 then product_length_cm + 1 else product_length_cm end",
        "product_height_cm": "case when product_photos_qty = 2 then product_height_cm + 2 else product_height_cm end",
        "product_width_cm": "case when product_photos_qty = 2 then -product_width_cm else product_width_cm end",
    },
    "orders": {
        "order_status": "case when order_status = 'processing' then 'test status' when order_status = 'invoiced' then 'Shipped' when order_status = 'created' then null else order_status end",
        "order_approved_at": "case when order_status = 'shipped' then order_purchase_timestamp + interval '2' day else order_approved_at end",
        "order_delivered_carrier_date": "case when order_status = 'delivered' and order_approved_at is null then null else order_delivered_carrier_date end",
        "order_delivered_customer_date": "case when order_status in ('shipped','unavailable') then order_estimated_delivery_date + interval '1' day when order_estimated_delivery_date < order_delivered_customer_date then order_estimated_delivery_date else order_delivered_customer_date end",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "case when geolocation_state = 'SB' then '99999' else geolocation_zip_code_prefix end",
        "geolocation_lat": "case when geolocation_city = 'building' then geolocation_lat*2 else geolocation_lat end",
        "geolocation_lng": "case when geolocation_city in ('building','furniture') then geolocation_lng*2 else geolocation_lng end",
        "geolocation_city": "case when geolocation_state = 'SC' then null when geolocation_state < 'SH' then 'test city' else geolocation_city end",
        "geolocation_state": "case when geolocation_state = 'SD' then 'tt' else lower(geolocation_state) end",
    },
    "order_reviews": {
        "review_score": "case when review_score = 1 then 777 when review_score = 3 then null else review_score end",
        "review_comment_title": "case when review_score = 1 then '777' else review_comment_title end",
        "review_comment_message": "case when review_score = 1 then '777' when review_score = 2 then repeat(review_comment_message||' ', 40) else review_comment_message end",
        "review_creation_date": "case when review_score in (1,4) then review_creation_date + interval '90' minute else review_creation_date end",
        "review_answer_timestamp": "case when review_score = 1 then review_answer_timestamp + interval '1' hour else review_answer_timestamp end",
    },
    "product_category_name_translation": {"product_category_name_english": "'888'"},
}


def _columns(table: str) -> list[str]:
    return SCHEMAS[table].fieldNames()


def _views() -> dict[str, str]:
    views = dict(_MODEL)
    for table in SCHEMAS:
        names = _columns(table)
        old, new, dirty = _UPDATE_OLD.get(table, {}), _UPDATE_NEW[table], _INSERT[table]
        views[f"x_{table}"] = f"select {', '.join(names)} from k_{table}"
        inserted = ", ".join(f"{dirty.get(c, c)} as {c}" for c in names)
        views[f"i_{table}"] = f"select seq, {inserted} from k_{table}"
        images = ", ".join(f"{old.get(c, c)} as old_{c}, {new.get(c, c)} as new_{c}" for c in names)
        views[f"u_{table}"] = f"select seq, {images} from k_{table}"
    return views


VIEWS = _views()
_VIEW_NAME = re.compile(r"\b[kxiu]_(?:" + "|".join(sorted(SCHEMAS, key=len, reverse=True)) + r")\b")


def views_used(text: str) -> list[str]:
    """The views a text needs, each after those it is built on."""
    found: list[str] = []
    for name in _VIEW_NAME.findall(text):
        for needed in [*views_used(VIEWS[name]), name]:
            if needed not in found:
                found.append(needed)
    return found


def oracle(text: str) -> str:
    """A complete statement for the checking database: the views as CTEs, then the text."""
    names = {table: table for table in SOURCE_SCHEMAS}
    ctes = [f"{name} as ({VIEWS[name].format(**names)})" for name in views_used(text)]
    if not ctes:
        return text
    return f"with {', '.join(ctes)}, " + text[5:] if text.startswith("with ") else f"with {', '.join(ctes)} {text}"


# Folders that hold the model tables as files, made by ``materialise`` in this process.
_MATERIALISED: set[str] = set()
ROWS_PER_FILE = 50_000


def materialise(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Write the model tables below ``folder``, which then serves as ``sf_dir`` in this process.

    Timings over it leave out the mapping of the given tables to the model.
    """
    for table in SCHEMAS:
        df = view(spark, sf_dir, VIEWS[f"k_{table}"]).selectExpr("cast(seq as bigint) as seq", *_typed(table))
        df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{folder}/k_{table}")
    _MATERIALISED.add(folder)
    return folder


def _base_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if sf_dir in _MATERIALISED and name.startswith("k_"):
        schema = T.StructType([T.StructField("seq", T.LongType()), *SCHEMAS[name[2:]].fields])
        return spark.read.schema(schema).parquet(f"{sf_dir}/{name}")
    return view(spark, sf_dir, VIEWS[name])


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The result of a text over the views and the given tables."""
    inner = set(_VIEW_NAME.findall(text))
    text = _VIEW_NAME.sub(lambda m: "{" + m.group(0) + "}", text)
    frames = {name: _base_view(spark, sf_dir, name) for name in inner}
    for source, schema in SOURCE_SCHEMAS.items():
        if "{" + source + "}" in text:
            frames[source] = spark.read.schema(schema).parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(text, **frames)


def _typed(table: str, prefix: str = "") -> list[str]:
    return [f"cast({prefix}{f.name} as {f.dataType.simpleString()}) as {f.name}" for f in SCHEMAS[table].fields]


def _image(table: str, prefix: str = "") -> str:
    fields = [f"'{f.name}', cast({prefix}{f.name} as {f.dataType.simpleString()})" for f in SCHEMAS[table].fields]
    return f"named_struct({', '.join(fields)})"


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """The named model tables (all when none is named)."""
    frames = {}
    for table in names or SCHEMAS:
        frames[table] = view(spark, sf_dir, VIEWS[f"x_{table}"]).selectExpr(*_typed(table))
    return Tables(**frames)


def _changes(df: DataFrame, op: str, old: str, new: str) -> DataFrame:
    return df.selectExpr(f"'{op}' as op", "cast(seq as bigint) as seq", f"{old} as old", f"{new} as new")


def _nothing(table: str) -> str:
    return f"cast(null as {SCHEMAS[table].simpleString()})"


def insert_batch(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _changes(view(spark, sf_dir, VIEWS[f"i_{table}"]), "I", _nothing(table), _image(table))


def update_batch(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = view(spark, sf_dir, VIEWS[f"u_{table}"])
    return _changes(df, "U", _image(table, "old_"), _image(table, "new_"))


def delete_batch(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _changes(_base_view(spark, sf_dir, f"k_{table}"), "D", _image(table), _nothing(table))


def all_changes(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Insert, update and delete batches of a table in one change frame, by one pass over the rows of the table."""

    def image(values: dict[str, str]) -> str:
        fields = [f"'{f.name}', cast({values.get(f.name, f.name)} as {f.dataType.simpleString()})" for f in SCHEMAS[table].fields]
        return f"named_struct({', '.join(fields)})"

    batches = [
        ("I", _nothing(table), image(_INSERT[table])),
        ("U", image(_UPDATE_OLD.get(table, {})), image(_UPDATE_NEW[table])),
        ("D", image({}), _nothing(table)),
    ]
    rows = ", ".join(f"named_struct('op', '{op}', 'seq', cast(seq as bigint), 'old', {old}, 'new', {new})" for op, old, new in batches)
    return _base_view(spark, sf_dir, f"k_{table}").selectExpr(f"inline(array({rows}))")
