"""Demand forecast queries. The SQL states them as filtered aggregates over literal windows."""

import datetime as dt

from ..operators.forecast import KEY_ITEMS, demand_forecast, forecast_scenarios
from ..operators.forecast_history import forecast_dates, sales_history
from .registry import query, sql_with

AS_OF = dt.date(2001, 6, 15)
SCENARIO_LOOKBACKS = (1, 2, 3, 4, 5, 6)


#: First day of the window of recent months before June 2001, by its number of months.
RECENT_FROM = {1: "2001-05-01", 2: "2001-04-01", 3: "2001-03-01", 4: "2001-02-01", 5: "2001-01-01", 6: "2000-12-01"}
RECENT = "move_date >= since AND move_date < DATE '2001-06-01'"
YEAR_AGO = "move_date >= DATE '2000-06-01' AND move_date < DATE '2000-07-01'"
THIS_MONTH = "move_date >= DATE '2001-06-01' AND move_date < DATE '2001-07-01'"


def _forecast_sql(lookbacks, hybrids, drop="", partners=None, recent="AVG(qty) FILTER ({})"):
    """Named products are one group with a filtered aggregate for each window; unnamed ones a row for each window."""
    windows = ", ".join(f"({n}, DATE '{RECENT_FROM[n]}')" for n in lookbacks)
    settings = ", ".join(f"({h})" for h in hybrids)
    chosen = f"AND partner_name IN {tuple(partners)}" if partners else ""
    measures = {"recent_qty": (RECENT, recent.format(f"WHERE {RECENT}")),
                "year_ago_qty": (YEAR_AGO, f"SUM(qty) FILTER (WHERE {YEAR_AGO})"),
                "month_qty": (THIS_MONTH, f"SUM(qty) FILTER (WHERE {THIS_MONTH})")}

    def unnamed(name):
        window, value = measures[name]
        columns = ", ".join(f"{value if m == name else 'NULL'} AS {m}" for m in measures)
        return f"""SELECT lookback, partner_name, NULL AS product_name, {columns}, NULL AS price
  FROM outgoing WHERE product_name IS NULL AND {window} GROUP BY lookback, partner_name"""

    named = ", ".join(f"{value} AS {m}" for m, (_, value) in measures.items())
    rows = " UNION ALL ".join(map(unnamed, measures))
    ctes = [
        f"setting(hybrid) AS (VALUES {settings})",
        f"""outgoing AS MATERIALIZED (
  SELECT m.*, w.* FROM movement m, (VALUES {windows}) AS w(lookback, since)
  WHERE move_type = 'OUTBOUND' AND partner_name IS NOT NULL {chosen})""",
        f"""seen AS (
  SELECT lookback, partner_name, product_name, {named},
         AVG(amount / qty) FILTER (WHERE qty > 0) AS price
  FROM outgoing WHERE product_name IS NOT NULL GROUP BY lookback, partner_name, product_name
  HAVING COUNT(*) FILTER (WHERE ({RECENT}) OR ({YEAR_AGO}) OR ({THIS_MONTH})) > 0
  UNION ALL {rows})""",
        """inputs AS (
  SELECT lookback, partner_name, product_name,
         CAST(ROUND(COALESCE(recent_qty, 0), 1) AS DOUBLE) AS avg_recent,
         CAST(COALESCE(year_ago_qty, 0) AS DOUBLE) AS last_year_qty,
         CAST(COALESCE(month_qty, 0) AS DOUBLE) AS current_qty,
         ROUND(COALESCE(price, 0), 0) AS unit_price
  FROM seen)""",
        """forecast AS (
  SELECT *, ROUND_EVEN(CASE WHEN NOT hybrid OR last_year_qty = 0 THEN avg_recent
         ELSE avg_recent * 0.4 + last_year_qty * 0.6 END, 1) AS forecast_qty
  FROM inputs, setting)""",
        """suggested AS (
  SELECT *, GREATEST(forecast_qty - current_qty, 0.0) AS suggested_qty
  FROM forecast WHERE forecast_qty > 0)""",
        """valued AS (
  SELECT *, CAST(TRUNC(suggested_qty * unit_price) AS BIGINT) AS extra_revenue FROM suggested)""",
    ]
    return sql_with(["movement"], f"""
SELECT * {drop}, ROW_NUMBER() OVER (PARTITION BY lookback, hybrid, partner_name
         ORDER BY extra_revenue DESC, product_name ASC NULLS LAST) <= {KEY_ITEMS} AS is_key_item
FROM valued""", ctes)


ONE = "EXCLUDE (lookback, hybrid)"


@query("demand_forecast", "F1 A5 A6 A7 J1 J2 J3 P8 W1 K6", _forecast_sql(
    [3], [False], ONE))
def _(t):
    return demand_forecast(t.movement, AS_OF)


@query("demand_forecast_hybrid", "F1 W1 K6", _forecast_sql([3], [True], ONE))
def _(t):
    return demand_forecast(t.movement, AS_OF, hybrid=True)


@query("demand_forecast_two_partners", "F1", _forecast_sql(
    [6], [True], ONE, ("NATION_3", "NATION_11")))
def _(t):
    return demand_forecast(
        t.movement, AS_OF, lookback=6, hybrid=True, partners=["NATION_3", "NATION_11"])


@query("demand_forecast_monthly_basis", "F1 A5", _forecast_sql(
    [3], [False], ONE, recent="SUM(qty) FILTER ({}) / 3"))
def _(t):
    return demand_forecast(t.movement, AS_OF, recent_basis="month")


@query("forecast_scenarios", "F2", _forecast_sql(
    SCENARIO_LOOKBACKS, [False, True]))
def _(t):
    return forecast_scenarios(t.movement, AS_OF, SCENARIO_LOOKBACKS)


#: 24 days of reference, two years from September 1999 on, at the start, middle and end of months.
DATES = tuple(dt.date(1999 + (8 + i) // 12, (8 + i) % 12 + 1, (1, 15, 28)[i % 3]) for i in range(24))


def _dates_sql(hybrids):
    """Each date's windows by date arithmetic, and a filtered aggregate over all its movements."""
    days = ", ".join(f"(DATE '{day}')" for day in DATES)
    settings = ", ".join(f"({h})" for h in hybrids)
    named = "product_name IS NOT NULL"
    ctes = [
        f"setting(hybrid) AS (VALUES {settings})",
        f"""day AS (
  SELECT as_of, CAST(date_trunc('month', as_of) AS DATE) AS month_start,
         CAST(date_trunc('month', CAST(date_trunc('month', as_of) AS DATE) - 90) AS DATE) AS since,
         CAST(date_trunc('month', as_of) + INTERVAL 1 MONTH AS DATE) AS month_end
  FROM (VALUES {days}) AS d(as_of))""",
        """outgoing AS (
  SELECT partner_name, product_name, move_date, qty, amount FROM movement
  WHERE move_type = 'OUTBOUND' AND partner_name IS NOT NULL)""",
        """placed AS (
  SELECT as_of, o.*,
         CASE WHEN move_date >= since AND move_date < month_start THEN 'recent'
              WHEN move_date >= month_start AND move_date < month_end THEN 'month'
              WHEN move_date >= month_start - INTERVAL 1 YEAR AND move_date < month_end - INTERVAL 1 YEAR
              THEN 'year_ago' END AS place
  FROM outgoing o, day)""",
        "price AS (SELECT partner_name, product_name, AVG(amount / qty) FILTER (WHERE qty > 0) AS price "
        f"FROM outgoing WHERE {named} GROUP BY partner_name, product_name)",
        f"""seen AS (
  SELECT as_of, partner_name, product_name, AVG(qty) FILTER (WHERE place = 'recent') AS recent_qty,
         SUM(qty) FILTER (WHERE place = 'year_ago') AS year_ago_qty,
         SUM(qty) FILTER (WHERE place = 'month') AS month_qty, ANY_VALUE(price) AS price
  FROM placed LEFT JOIN price USING (partner_name, product_name) WHERE place IS NOT NULL
  GROUP BY as_of, partner_name, product_name, CASE WHEN {named} THEN '' ELSE place END)""",
        """inputs AS (
  SELECT as_of, partner_name, product_name,
         CAST(ROUND(COALESCE(recent_qty, 0), 1) AS DOUBLE) AS avg_recent,
         CAST(COALESCE(year_ago_qty, 0) AS DOUBLE) AS last_year_qty,
         CAST(COALESCE(month_qty, 0) AS DOUBLE) AS current_qty,
         ROUND(COALESCE(price, 0), 0) AS unit_price
  FROM seen)""",
        """forecast AS (
  SELECT *, 3 AS lookback, ROUND_EVEN(CASE WHEN NOT hybrid OR last_year_qty = 0 THEN avg_recent
         ELSE avg_recent * 0.4 + last_year_qty * 0.6 END, 1) AS forecast_qty
  FROM inputs, setting)""",
        """valued AS (
  SELECT *, GREATEST(forecast_qty - current_qty, 0.0) AS suggested_qty,
         CAST(TRUNC(GREATEST(forecast_qty - current_qty, 0.0) * unit_price) AS BIGINT) AS extra_revenue
  FROM forecast WHERE forecast_qty > 0)""",
    ]
    return sql_with(["movement"], f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, hybrid, partner_name
         ORDER BY extra_revenue DESC, product_name ASC NULLS LAST) <= {KEY_ITEMS} AS is_key_item
FROM valued""", ctes)


@query("forecast_by_date", "F1 F2 W1 A5", _dates_sql([False, True]))
def _(t):
    return forecast_dates(sales_history(t.movement), DATES, (3,), (False, True))
