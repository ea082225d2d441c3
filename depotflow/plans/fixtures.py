"""Input tables derived from the star-schema Parquet files.

Each text runs unchanged on Spark SQL and on DuckDB, so queries and their SQL
checks read the same rows. `USES` lists the tables a text reads that are
themselves in this module.
"""

# Declared, so that opening a table starts no job to look its columns up.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}
TABLES = tuple(SCHEMAS)

# Orders are dispatched in days of 240, so more customers mean more days of the
# same size.
SQL = {
    "movement": """
SELECT CAST(l.l_shipdate AS DATE) AS move_date,
       CASE WHEN l.l_orderkey % 89 = 0 THEN NULL ELSE
         lpad(CAST(8 + (l.l_orderkey + l.l_linenumber) % 12 AS STRING), 2, '0') || ':' ||
         lpad(CAST(l.l_partkey % 60 AS STRING), 2, '0') || ':' ||
         lpad(CAST(l.l_suppkey % 60 AS STRING), 2, '0') END AS move_time,
       'PLANT_' || CAST(l.l_suppkey % 4 AS STRING) AS plant_code,
       CASE WHEN l.l_returnflag = 'N' OR (l.l_returnflag = 'A' AND l.l_linestatus = 'O') THEN 'OUTBOUND'
            WHEN l.l_returnflag = 'A' THEN 'PURCHASE'
            WHEN l.l_linestatus = 'F' THEN 'RETURN'
            WHEN l.l_orderkey % 9 = 0 THEN 'SPECIAL_OUTBOUND'
            WHEN l.l_orderkey % 9 = 1 THEN 'OUTBOUND_CANCEL'
            WHEN l.l_orderkey % 9 = 2 THEN 'CARRIED_SALES'
            WHEN l.l_orderkey % 9 = 3 THEN 'PLANT_TRANSFER'
            WHEN l.l_orderkey % 9 = 4 THEN 'RTP'
            WHEN l.l_orderkey % 9 = 5 THEN 'POST'
            WHEN l.l_orderkey % 9 = 6 THEN 'SCRAP'
            WHEN l.l_orderkey % 9 = 7 THEN 'ADJ_MINUS'
            ELSE 'ADJ_PLUS' END AS move_type,
       CASE WHEN l.l_partkey % 13 = 0 THEN 'GI-ZONE'
            ELSE 'LOC-' || lpad(CAST(l.l_partkey % 40 AS STRING), 3, '0') END AS storage_loc,
       n.n_name AS partner_name,
       r.r_name || ' ' || n.n_name || ' ' || c.c_mktsegment AS partner_address,
       CAST(l.l_partkey AS STRING) AS product_code,
       CASE WHEN l.l_partkey % 211 = 0 THEN NULL ELSE p.p_name END AS product_name,
       'B_' || lpad(CAST(l.l_suppkey AS STRING), 5, '0') AS batch,
       CASE WHEN l.l_orderkey % 97 = 0 THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END AS qty,
       CAST(ROUND(l.l_extendedprice) AS BIGINT) AS amount,
       'INV' || CAST(l.l_orderkey AS STRING) AS ref_no
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN {part} p ON l.l_partkey = p.p_partkey
""",
    "delivery_orders": """
SELECT c.c_custkey AS order_id,
       CAST(FLOOR(c.c_custkey / 240) AS INT) AS route_day,
       c.c_name AS name,
       CASE WHEN c.c_custkey % 41 = 0 THEN '  '
            ELSE r.r_name || ' ' || n.n_name || ' ' || c.c_mktsegment END AS address,
       CASE WHEN c.c_custkey % 41 = 0 THEN 'NO_ADDRESS'
            WHEN c.c_custkey % 50 = 0 THEN 'NOT_FOUND'
            WHEN c.c_custkey % 77 = 0 THEN 'ERROR:timeout, retry'
            ELSE '128.' || lpad(CAST((c.c_custkey * 7919) % 10000 AS STRING), 4, '0') || ',35.' ||
                 lpad(CAST((c.c_custkey * 104729) % 10000 AS STRING), 4, '0') END AS coord,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(c.c_custkey % 20 AS DOUBLE) END AS box_qty,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 15 AS DOUBLE) END AS bag_qty
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
""",
    "vehicles": """
SELECT CAST(s.s_suppkey AS INT) AS vehicle_id,
       'V' || lpad(CAST(s.s_suppkey + 1 AS STRING), 2, '0') AS vehicle_name,
       CASE WHEN s.s_suppkey = 4 THEN NULL
            ELSE '128.' || lpad(CAST((s.s_suppkey * 911) % 10000 AS STRING), 4, '0') || ',35.' ||
                 lpad(CAST((s.s_suppkey * 577) % 10000 AS STRING), 4, '0') END AS start_coord,
       CASE WHEN s.s_suppkey = 3 THEN NULL ELSE 8.0 + CAST(s.s_suppkey % 4 AS DOUBLE) END AS efficiency
FROM {supplier} s
""",
    "vehicle_zone": """
SELECT CAST(n.n_nationkey % 11 AS INT) AS vehicle_id, n.n_name AS keyword
FROM {nation} n WHERE n.n_nationkey NOT IN (0, 2) AND n.n_nationkey < 20
UNION ALL
SELECT CAST((n.n_nationkey + 5) % 11 AS INT) AS vehicle_id, n.n_name AS keyword
FROM {nation} n WHERE n.n_nationkey % 3 = 0 AND n.n_nationkey NOT IN (0, 2) AND n.n_nationkey < 20
""",
    "scans": """
SELECT l_orderkey AS scan_group, l_linenumber AS scan_no, l_suppkey AS operator_id, l_shipdate AS scan_ts,
       CASE (l_orderkey + l_linenumber) % 11
         WHEN 0 THEN '0' || lpad(CAST(l_orderkey AS STRING), 9, '0')
         WHEN 1 THEN '880' || lpad(CAST(l_partkey AS STRING), 10, '0')
         WHEN 2 THEN '010880' || lpad(CAST(l_partkey AS STRING), 10, '0')
         WHEN 3 THEN '(01)0880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '(21)S' || CAST(l_suppkey AS STRING)
         WHEN 4 THEN '010880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '21S' || CAST(l_suppkey AS STRING) || '<GS>1726123110LOT7'
         WHEN 5 THEN '011880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '21S' || CAST(l_suppkey AS STRING) || ']d217261231'
         WHEN 6 THEN '011880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '10LOT7[gs]21S' || CAST(l_suppkey AS STRING)
         WHEN 7 THEN '011880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '10LOT7<GS>1726123121S' || CAST(l_suppkey AS STRING)
         WHEN 8 THEN '011880' || lpad(CAST(l_partkey AS STRING), 10, '0') || '1726123121SER1<gs>10LOT7'
         WHEN 9 THEN '   '
         ELSE 'X' || CAST(l_partkey AS STRING) END AS raw
FROM {lineitem}
""",
    "return_list": """
SELECT '880' || lpad(CAST(l_partkey AS STRING), 10, '0') AS gtin, 'LOT7' AS batch,
       DATE '2026-12-31' AS expiry, COUNT(*) + l_partkey % 2 AS expected_qty
FROM {lineitem}
WHERE (l_orderkey + l_linenumber) % 11 IN (4, 6, 7, 8) AND l_partkey % 17 <> 0
GROUP BY l_partkey
""",
    "stock": """
SELECT plant_code, storage_loc, product_code, product_name, batch,
       CAST(SUM(CASE WHEN move_type = 'PURCHASE' THEN qty ELSE -qty END) AS BIGINT) AS qty
FROM {movement}
WHERE move_type IN ('PURCHASE', 'OUTBOUND')
GROUP BY plant_code, storage_loc, product_code, product_name, batch
""",
    "return_stock": """
SELECT '880' || lpad(product_code, 10, '0') AS gtin, 'LOT7' AS batch, qty
FROM {stock}
""",
    "geo_reference": """
SELECT address, MIN(coord) AS coord
FROM {delivery_orders}
WHERE coord LIKE '128.%' AND trim(address) <> '' AND address NOT LIKE '%MACHINERY'
GROUP BY address
""",
}

USES = {
    "stock": ("movement",),
    "return_stock": ("stock",),
    "geo_reference": ("delivery_orders",),
}


# The joins of a text in an order for tables that all must be shuffled: partners are joined to orders, of which there are
# fewer, and a row of the result moves twice, not three times. Inner joins give the same rows in any order.
LARGE = {
    "movement": """FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN ({orders} o JOIN ({customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
                       JOIN {region} r ON n.n_regionkey = r.r_regionkey) ON o.o_custkey = c.c_custkey)
  ON l.l_orderkey = o.o_orderkey
""",
}


def fixture(spark, sf_dir, name, large=False):
    """A derived table as a DataFrame over the Parquet files in `sf_dir`; `large` joins as `LARGE` says."""
    text = SQL[name]
    if large:
        text = text[:text.index("FROM {lineitem}")] + LARGE[name]
    inputs = {t: spark.read.schema(SCHEMAS[t]).parquet(f"{sf_dir}/{t}.parquet")
              for t in TABLES if f"{{{t}}}" in text}
    inputs |= {t: fixture(spark, sf_dir, t) for t in USES.get(name, ())}
    return spark.sql(text, **inputs)


def fixture_ctes(*names):
    """WITH-clause entries for the named tables and what they use, each once."""
    done = {}

    def add(name):
        for used in USES.get(name, ()):
            add(used)
        names_as_is = {t: t for t in (*TABLES, *SQL)}
        done.setdefault(name, f"{name} AS ({SQL[name].format(**names_as_is)})")

    for name in names:
        add(name)
    return list(done.values())
