"""Queries over the movement table: filters, searches, KPIs and rankings."""

from ..operators import filters as f
from ..operators import kpi, ranking
from ..schema import OUTBOUND, PLANTS, PURCHASE, RETURN
from .registry import query, sql_with

KPI_ARGS = ([PURCHASE, OUTBOUND], PLANTS, "2000-01-01", "2001-06-30")
KPI_WHERE = """move_type IN ('PURCHASE', 'OUTBOUND')
  AND plant_code IN ('PLANT_0', 'PLANT_1', 'PLANT_2', 'PLANT_3')
  AND move_date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'"""
DAILY = f"""daily AS (
  SELECT move_date, plant_code, CAST(SUM(amount) AS BIGINT) AS total_amount,
         CAST(SUM(qty) AS BIGINT) AS total_qty, COUNT(DISTINCT ref_no) AS invoice_count,
         strftime(move_date, '%Y-%m') AS year_month
  FROM movement WHERE {KPI_WHERE} GROUP BY move_date, plant_code)"""
MONTHLY = """monthly AS (
  SELECT year_month, plant_code,
         CAST(COALESCE(SUM(total_amount), 0) AS BIGINT) AS total_amount,
         CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS total_qty,
         CAST(SUM(invoice_count) AS BIGINT) AS invoice_count
  FROM daily GROUP BY year_month, plant_code)"""


def over_movement(select, *ctes):
    return sql_with(["movement"], select, ctes)


@query("date_range_filter", "P1 S1", over_movement(
    "SELECT * FROM movement WHERE move_date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31'"))
def _(t):
    return f.date_range_filter(t.movement, "2000-03-01", "2000-03-31")


@query("date_range_open", "P1", over_movement(
    "SELECT plant_code, COUNT(*) AS n FROM movement GROUP BY plant_code"))
def _(t):
    return f.date_range_filter(t.movement, "2000-03-01").groupBy("plant_code").count() \
        .withColumnRenamed("count", "n")


@query("in_filter", "P2 P3", over_movement(
    "SELECT * FROM movement WHERE CAST(qty AS VARCHAR) IN ('7', '50')"))
def _(t):
    return f.in_filter(f.in_filter(t.movement, "qty", [7, "50"]), "plant_code", [])


@query("like_filter_wildcard", "P4", over_movement(
    "SELECT * FROM movement WHERE batch LIKE '%B_0000_%'"))
def _(t):
    return f.like_filter(t.movement, "batch", "B_0000_")


@query("like_filter_backslash", "P4", over_movement(
    r"SELECT * FROM movement WHERE ref_no || '\100%' LIKE '%7\1_0%'"))
def _(t):
    marked = t.movement.selectExpr("*", r"ref_no || '\\100%' AS marked")
    return f.like_filter(marked, "marked", r"7\1_0").drop("marked")


@query("eq_filter", "P5", over_movement(
    "SELECT * FROM movement WHERE partner_name = 'NATION_7' AND product_name = 'small ring'"))
def _(t):
    found = f.eq_filter(f.eq_filter(t.movement, "partner_name", "NATION_7"), "plant_code")
    return f.eq_filter(found, "product_name", "small ring")


SEARCH_SQL = over_movement("""
SELECT * FROM movement
WHERE plant_code IN ('PLANT_1', 'PLANT_2') AND move_type IN ('OUTBOUND', 'RTP', 'RETURN')
  AND move_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' AND batch LIKE '%0_%'
ORDER BY move_date DESC NULLS LAST, move_time DESC NULLS LAST, plant_code NULLS LAST,
  move_type NULLS LAST, storage_loc NULLS LAST, partner_name NULLS LAST,
  partner_address NULLS LAST, product_code NULLS LAST, product_name NULLS LAST,
  batch NULLS LAST, qty NULLS LAST, amount NULLS LAST, ref_no NULLS LAST
LIMIT 5000""")


@query("search_movements", "P6 P9 K4", SEARCH_SQL)
def _(t):
    return f.search_movements(
        t.movement, "1999-01-01", "2001-12-31", ["PLANT_1", "PLANT_2"],
        ["OUTBOUND", "RTP", "RETURN"], batch="0_", limit=5000)


@query("search_movements_all_filters", "P6 P9", over_movement("""
SELECT * FROM movement
WHERE plant_code IN ('PLANT_0', 'PLANT_3') AND move_type = 'OUTBOUND' AND batch LIKE '%B_%'
  AND ref_no LIKE '%INV1%' AND partner_name = 'NATION_3' AND product_name = 'red gear'"""))
def _(t):
    return f.search_movements(
        t.movement, None, "2001-12-31", ["PLANT_0", "PLANT_3"], [OUTBOUND], "B_", "INV1",
        "NATION_3", "red gear", limit=None)


@query("datetime_range_filter", "P7", over_movement("""
SELECT * FROM movement
WHERE (move_date > DATE '2000-05-02' OR (move_date = DATE '2000-05-02' AND move_time >= '10:30:00'))
  AND (move_date < DATE '2000-05-20' OR (move_date = DATE '2000-05-20' AND move_time <= '15:00:00'))
"""))
def _(t):
    return f.datetime_range_filter(t.movement, "2000-05-02 10:30:00", "2000-05-20 15:00:00")


@query("outbound_shipments", "K5 P7 P9", over_movement("""
SELECT move_date, move_time, plant_code, partner_name, partner_address, product_code,
       product_name, batch, qty, amount, ref_no
FROM movement
WHERE move_type = 'OUTBOUND' AND plant_code = 'PLANT_2'
  AND (move_date > DATE '2000-01-10' OR (move_date = DATE '2000-01-10' AND move_time >= '09:00:00'))
  AND (move_date < DATE '2000-04-10' OR (move_date = DATE '2000-04-10' AND move_time <= '18:00:00'))
"""))
def _(t):
    return f.outbound_shipments(t.movement, "PLANT_2", "2000-01-10 09:00:00", "2000-04-10 18:00:00")


@query("distinct_partners", "A8", over_movement("SELECT DISTINCT partner_name FROM movement"))
def _(t):
    return kpi.distinct_values(t.movement, "partner_name")


@query("distinct_products", "A8", over_movement("SELECT DISTINCT product_name FROM movement"))
def _(t):
    return kpi.distinct_values(t.movement, "product_name")


@query("plant_daily_kpi", "A1 K7 X1", over_movement("SELECT * FROM daily", DAILY))
def _(t):
    return kpi.plant_daily_kpi(t.movement, *KPI_ARGS)


@query("plant_monthly_kpi", "A2", over_movement("SELECT * FROM monthly", DAILY, MONTHLY))
def _(t):
    return kpi.plant_monthly_kpi(kpi.plant_daily_kpi(t.movement, *KPI_ARGS))


@query("monthly_invoices_exact", "A2", over_movement(f"""
SELECT strftime(move_date, '%Y-%m') AS year_month, plant_code,
       COUNT(DISTINCT ref_no) AS invoice_count
FROM movement WHERE {KPI_WHERE} GROUP BY ALL"""))
def _(t):
    return kpi.monthly_invoices_exact(t.movement, *KPI_ARGS)


def _pivot_sql(measure):
    columns = ", ".join(
        f"CAST(COALESCE(SUM({measure}) FILTER (WHERE plant_code = '{p}'), 0) AS BIGINT) AS \"{p}\""
        for p in PLANTS)
    return over_movement(
        f"SELECT year_month, {columns} FROM monthly GROUP BY year_month", DAILY, MONTHLY)


def _register_pivot(name, measure):
    @query(name, "A3", _pivot_sql(measure))
    def _(t):
        monthly = kpi.plant_monthly_kpi(kpi.plant_daily_kpi(t.movement, *KPI_ARGS))
        return kpi.monthly_pivot(monthly, measure)


_register_pivot("monthly_pivot_amount", "total_amount")
_register_pivot("monthly_pivot_qty", "total_qty")
_register_pivot("monthly_pivot_invoices", "invoice_count")

SUMS = "CAST(SUM(qty) AS BIGINT) AS total_qty, CAST(SUM(amount) AS BIGINT) AS total_amount"


@query("totals_by_product", "A4", over_movement(
    f"SELECT product_code, product_name, {SUMS} FROM movement GROUP BY ALL"))
def _(t):
    return kpi.totals_by(t.movement, "product_code", "product_name")


@query("totals_by_partner", "A4", over_movement(
    f"SELECT partner_name, {SUMS} FROM movement GROUP BY ALL"))
def _(t):
    return kpi.totals_by(t.movement, "partner_name")


def _top_sql(keys, move_type, n, where="TRUE"):
    return over_movement(f"""
SELECT {keys}, {SUMS} FROM movement
WHERE move_type = '{move_type}' AND plant_code = 'PLANT_1' AND {where}
GROUP BY {keys}
ORDER BY total_amount DESC NULLS LAST, {keys.replace(',', ' NULLS LAST,')} NULLS LAST LIMIT {n}""")


IN_2000 = "move_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"


@query("top_products_outbound", "K1 A4", _top_sql("product_code, product_name", OUTBOUND, 30))
def _(t):
    return ranking.top_products(t.movement, OUTBOUND, "PLANT_1")


@query("top_products_purchase", "K1 A4", _top_sql(
    "product_code, product_name", PURCHASE, 30, IN_2000))
def _(t):
    return ranking.top_products(t.movement, PURCHASE, "PLANT_1", "2000-01-01", "2000-12-31")


@query("top_partners_outbound", "K2 A4", _top_sql("partner_name", OUTBOUND, 10))
def _(t):
    return ranking.top_partners(t.movement, OUTBOUND, "PLANT_1")


@query("top_partners_return", "K2 A4", _top_sql("partner_name", RETURN, 10, IN_2000))
def _(t):
    return ranking.top_partners(t.movement, RETURN, "PLANT_1", "2000-01-01", "2000-12-31")


def _top_by_plant_sql(keys, types, n):
    return over_movement(f"""
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY plant_code, move_type
    ORDER BY total_amount DESC NULLS LAST, {keys.replace(',', ' NULLS LAST,')} NULLS LAST)
    AS INT) AS rank
  FROM totals) WHERE rank <= {n}""", f"""totals AS (
  SELECT plant_code, move_type, {keys}, {SUMS} FROM movement
  WHERE move_type IN {types} GROUP BY plant_code, move_type, {keys})""")


@query("top_products_by_plant", "K3", _top_by_plant_sql(
    "product_code, product_name", (OUTBOUND, PURCHASE), 30))
def _(t):
    return ranking.top_products_by_plant(t.movement)


@query("top_partners_by_plant", "K3", _top_by_plant_sql("partner_name", (OUTBOUND, RETURN), 10))
def _(t):
    return ranking.top_partners_by_plant(t.movement)
