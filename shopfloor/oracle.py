"""DuckDB oracle SQL for every registered query.

Each query is plain SQL over the driver's tables; the retail views it uses
are prepended as CTEs (same definitions as ``sources.fixtures``).
"""

from __future__ import annotations

import re

# Retail views over the driver tables, in dependency order (DuckDB dialect).
VIEWS: dict[str, str] = {
    "v_item": """SELECT p_partkey AS id, concat('SKU_', cast(p_partkey AS VARCHAR)) AS sku, p_name AS name,
        p_type AS category, p_brand AS description,
        CASE p_partkey % 3 WHEN 0 THEN 'FurnitureEntity' WHEN 1 THEN 'RetailProductEntity' ELSE 'RawMaterialEntity' END AS dtype,
        p_size AS length, p_partkey % 40 + 1 AS width, p_partkey % 25 + 1 AS height,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 17 = 0 END AS isdeleted FROM part""",
    "v_subtype": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL
        WHEN p_partkey % 2 = 0 THEN concat('p', cast(p_partkey AS VARCHAR), '.jpg')
        ELSE concat('/img/products/', cast(p_partkey AS VARCHAR), '.jpg') END AS imageurl FROM part""",
    "v_country": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_id FROM nation",
    "v_item_country": """SELECT l_partkey AS item_id, s_nationkey AS country_id, max(l_extendedprice) AS retailprice
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 7 <> 0 GROUP BY l_partkey, s_nationkey""",
    "v_warehouse": "SELECT s_suppkey AS id, concat('WH ', s_name) AS warehousename, s_nationkey AS country_id FROM supplier",
    "v_store": """SELECT s_suppkey AS id, concat('Store ', s_name) AS name, s_nationkey AS country_id,
        s_suppkey - s_suppkey % 2 AS warehouse_id FROM supplier""",
    "v_supplier": "SELECT s_suppkey AS id, s_name AS suppliername, s_nationkey AS country_id FROM supplier",
    "v_storagebin": """SELECT s_suppkey * 2 AS id, 'Inbound' AS type, s_suppkey AS warehouse_id FROM supplier WHERE s_suppkey % 10 <> 9
        UNION ALL SELECT s_suppkey * 2 + 1, 'Outbound', s_suppkey FROM supplier""",
    "v_facility": "SELECT n_nationkey AS id, concat('Facility ', n_name) AS name FROM nation",
    "v_office": "SELECT r_regionkey AS id, concat('Office ', r_name) AS name FROM region",
    "v_line": """SELECT cast(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS id,
        l_partkey AS item_id, cast(l_quantity AS BIGINT) AS quantity, l_orderkey AS order_id,
        l_suppkey * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS bin_id FROM lineitem""",
    "v_sale": """SELECT o_orderkey AS id, o_custkey AS member_id, o_orderdate AS createddate, o_totalprice AS amountdue,
        o_totalprice AS amountpaid, 'SGD' AS currency FROM orders""",
    "v_delivery": """SELECT o_orderkey AS salerecord_id, o_custkey AS member_id, c_name AS name, c_mktsegment AS delivery_address
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0""",
    "v_purchaseorder": """SELECT o_orderkey AS id, o_orderdate AS createddate, o_orderdate + INTERVAL 14 DAY AS expecteddate,
        CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Submitted' ELSE 'Completed' END AS status,
        o_orderkey % 10 AS supplier_id, o_custkey % 10 AS destination_id FROM orders WHERE o_orderkey % 2 = 0""",
    "v_shippingorder": """SELECT o_orderkey AS id, o_orderdate AS createddate, o_orderdate + INTERVAL 14 DAY AS expecteddate,
        CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_orderdate + INTERVAL 3 DAY END AS shippeddate,
        CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Submitted' WHEN 2 THEN 'Shipped' WHEN 3 THEN 'Completed'
        ELSE 'Unfulfillable' END AS status, o_orderkey % 10 AS origin_id, o_custkey % 10 AS destination_id
        FROM orders WHERE o_orderkey % 2 = 1""",
    "v_promotion": """SELECT DISTINCT l_partkey AS item_id, l_suppkey % 25 AS country_id, l_discount AS discountrate,
        l_shipdate AS startdate, l_shipdate + INTERVAL 30 DAY AS enddate FROM lineitem WHERE l_discount > 0.085""",
    "v_supplier_item": """SELECT l_suppkey AS supplier_id, l_partkey AS item_id, min(l_extendedprice) AS costprice,
        l_partkey % 21 + 1 AS leadtime, l_partkey % 5 + 1 AS lotsize FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "v_staff": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "v_member": """SELECT c_custkey AS id, concat(lower(replace(c_name, '#', '.')), '@example.com') AS email, c_name AS name,
        concat('6', lpad(cast(c_custkey AS VARCHAR), 7, '0')) AS phone, c_mktsegment AS city,
        concat('Block ', cast(c_custkey % 500 AS VARCHAR)) AS address,
        lpad(cast(c_custkey % 1000000 AS VARCHAR), 6, '0') AS zipcode FROM customer""",
    "v_staff_role": """SELECT c_custkey AS staff_id, c_custkey % 11 + 1 AS role_id FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, cast(c_nationkey % 11 + 1 AS BIGINT) FROM customer WHERE c_custkey % 4 = 0""",
    "v_accessright": """SELECT c_custkey AS staff_id, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 25 END AS facility_id,
        CASE WHEN c_custkey % 6 = 1 THEN c_custkey % 5 END AS office_id,
        CASE WHEN c_custkey % 6 IN (1, 2) THEN c_custkey % 10 END AS store_id,
        CASE WHEN c_custkey % 6 = 3 THEN c_custkey % 10 END AS warehouse_id FROM customer WHERE c_custkey % 6 <> 5""",
    "v_cart": """SELECT user_id AS session, cast(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts
        FROM events WHERE event_type = 'click'""",
}

# Shared sub-results used by several oracle queries (may use the views above).
SHARED: dict[str, str] = {
    "x_wh_stock": """SELECT sb.warehouse_id, l.item_id, sum(l.quantity) AS stock
        FROM v_line l JOIN v_storagebin sb ON sb.id = l.bin_id JOIN v_warehouse w ON w.id = sb.warehouse_id
        WHERE sb.type = 'Outbound' GROUP BY sb.warehouse_id, l.item_id""",
    "x_store_stock": """SELECT s.id AS store_id, x.item_id, x.stock FROM v_store s JOIN x_wh_stock x ON x.warehouse_id = s.warehouse_id""",
}

_NAME = re.compile(r"\b([vx]_[a-z_]+)\b")


def _deps(sql: str) -> set[str]:
    return {m for m in _NAME.findall(sql) if m in VIEWS or m in SHARED}


def with_views(sql: str) -> str:
    """Prepend the retail views (and shared sub-results) a query uses as CTEs."""
    needed: set[str] = set()
    todo = list(_deps(sql))
    while todo:
        name = todo.pop()
        if name in needed:
            continue
        needed.add(name)
        body = VIEWS.get(name) or SHARED[name]
        todo.extend(_deps(body) - needed)
    ordered = [n for n in list(VIEWS) + list(SHARED) if n in needed]
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS.get(n) or SHARED[n]})" for n in ordered)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
