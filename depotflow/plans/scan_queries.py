"""Queries over barcode scans, purchase returns and stock."""

from pyspark.sql import functions as F

from ..operators import gs1, returns, scans, stock
from .registry import query, sql_with

# Classification as nested SQL: repaired text `t`, delimiter position `i`, place behind it `e`.
CLASSIFIED = r"""
bare AS (
  SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN ''
                 ELSE replace(replace(raw, '(', ''), ')', '') END AS b FROM scans),
fixed AS (
  SELECT * EXCLUDE (b), CASE
    WHEN length(b) >= 16 AND substr(b, 4, 13) IN ('8806469024613', '8806469024729', '8806469024910')
      THEN substr(b, 1, 16) || '21' || substr(b, 17)
    WHEN length(b) >= 16 AND substr(b, 4, 13) = '8806520009521' THEN replace(b, '11241010', '')
    ELSE b END AS t FROM bare),
delimited AS (
  SELECT *, CASE WHEN contains(lower(t), ']d2') THEN ']d2'
                 WHEN contains(lower(t), '<gs>') THEN '<gs>'
                 WHEN contains(lower(t), '[gs]') THEN '[gs]' ELSE '' END AS d FROM fixed),
placed AS (
  SELECT *, CASE WHEN d = '' THEN 0 ELSE strpos(lower(t), d) - 1 END AS i FROM delimited),
behind AS (
  SELECT *, i + length(d) AS e, '(' || substr(t, 1, 2) || ')' || substr(t, 3, 14) AS head FROM placed),
typed AS (
  SELECT *, CASE
    WHEN raw IS NULL OR trim(raw) = '' THEN 'EMPTY'
    WHEN regexp_matches(t, '^(0.{9}|[81].{8}|5.{7})$') THEN 'OBD'
    WHEN i = 0 AND length(t) <= 17 AND regexp_matches(t, '^(01088|188|088|88)') THEN 'GENERAL_SPECIAL'
    WHEN i = 0 AND regexp_matches(t, '^(01088|88|3|.88)') THEN 'GENERAL'
    WHEN i >= 18 AND t LIKE '010%' THEN 'GENERAL'
    WHEN i = 0 AND regexp_matches(t, '^(00[0-9]|01[1-9])') THEN 'BUNDLE'
    WHEN i >= 18 AND regexp_matches(t, '^(00[0-9]|01[1-9])') THEN 'COMPOSITE'
    ELSE 'UNKNOWN' END AS kind FROM behind),
rebuilt AS (
  SELECT *, CASE
    WHEN kind <> 'COMPOSITE' THEN t
    WHEN substr(t, 17, 2) = '21' THEN head || '(21)' || substr(t, 19, i - 18)
    WHEN substr(t, 17, 2) NOT IN ('17', '10') THEN t
    WHEN length(t) < 26 THEN NULL
    WHEN substr(t, 25, 2) = '21' THEN CASE WHEN length(t) >= i + 6
      THEN head || '(' || substr(t, 23, 2) || ')' || substr(t, 25, i - 18) END
    WHEN length(t) < e + 2 THEN NULL
    WHEN substr(t, e + 1, 2) = '21' THEN head || '(21)' || substr(t, e + 3)
    WHEN substr(t, e + 1, 2) = '17' THEN CASE WHEN length(t) >= e + 10
      THEN head || '(' || substr(t, e + 9, 2) || ')' || substr(t, e + 11) END
    ELSE t END AS v FROM typed),
classified AS (
  SELECT scan_group, scan_no, operator_id, scan_ts, raw,
         CASE WHEN kind <> 'COMPOSITE' THEN kind WHEN v IS NULL THEN 'PARSE_ERROR'
              ELSE 'BUNDLE' END AS type,
         COALESCE(v, t) AS value FROM rebuilt)"""

# GS1 fields by cutting the text at its separators and reading each piece.
EXTRACTED = r"""
pieces AS (
  SELECT *, string_split(regexp_replace(t, '\]d2|<gs>|\[gs\]', chr(29), 'gi'), chr(29)) AS p FROM fixed),
fields AS (
  SELECT *, p[1] AS head_piece, regexp_matches(p[1], '^01[0-9]{14}') AS has_code,
         list_prepend(substr(p[1], 17), p[2:]) AS q FROM pieces),
read AS (
  SELECT *, list_filter(list_transform(q, lambda x: regexp_extract(x, '^17([0-9]{6})', 1)), lambda x: x <> '') AS dates,
         list_transform(q, lambda x: regexp_replace(x, '^17[0-9]{6}', '')) AS tails FROM fields),
extracted AS (
  SELECT scan_group, scan_no, operator_id, scan_ts, raw,
         CASE WHEN has_code THEN substr(head_piece, 4, 13)
              WHEN regexp_matches(t, '^[0-9]{13}$') THEN t END AS gtin,
         CASE WHEN has_code THEN substr(list_filter(tails, lambda x: x LIKE '10_%')[1], 3) END AS batch,
         CASE WHEN has_code THEN CAST(try_strptime('20' || dates[1], '%Y%m%d') AS DATE) END AS expiry,
         CASE WHEN has_code THEN substr(list_filter(tails, lambda x: x LIKE '21_%')[1], 3) END AS serial
  FROM read)"""
FIXED = CLASSIFIED[:CLASSIFIED.index(",\ndelimited")]


@query("classify_scans", "D1 X14", sql_with(["scans"], "SELECT * FROM classified", [CLASSIFIED]))
def _(t):
    return scans.classify_scans(t.scans)


@query("extract_gs1", "D2", sql_with(["scans"], "SELECT * FROM extracted", [FIXED, EXTRACTED]))
def _(t):
    return scans.extract_gs1(t.scans)


# Every field of a text, one recursion step a field, over the table of identifiers.
_IDENTIFIERS = ", ".join(f"('{two}', {digits}, {size})" for two, digits, size in gs1.IDENTIFIERS)
GS1_WALK = rf"""
identifiers(two, digits, size) AS (VALUES {_IDENTIFIERS}),
texts AS (
  SELECT row_number() OVER () AS rid, scan_group, scan_no, regexp_replace(regexp_replace(t, '\]d2|<gs>|\[gs\]', chr(29), 'gi'),
                                             '^(\x1d|\][A-Za-z][0-9])+', '') AS text FROM fixed),
walk AS (
  SELECT rid, scan_group, scan_no, ltrim(text, chr(29)) AS rest, '' AS found, CASE WHEN text = '' THEN 'NO_TEXT' END AS reason, 0 AS n FROM texts
  UNION ALL
  SELECT rid, scan_group, scan_no, CASE WHEN why IS NULL THEN ltrim(substr(body, length(v) + 1), chr(29)) ELSE rest END,
         CASE WHEN why IS NULL AND NOT contains(found, '|' || ai || '=') THEN found || '|' || ai || '=' || v ELSE found END, why, n + 1
  FROM (SELECT *, CASE
          WHEN size IS NULL OR NOT regexp_full_match(ai, '[0-9]+') OR length(ai) < digits THEN 'UNKNOWN_IDENTIFIER:' || substr(rest, 1, 2)
          WHEN size > 0 AND length(v) < size THEN 'TOO_SHORT:' || ai
          WHEN size > 0 AND NOT regexp_full_match(v, '[0-9]+') THEN 'NOT_DIGITS:' || ai
          WHEN v = '' THEN 'EMPTY:' || ai END AS why
        FROM (SELECT *, CASE WHEN size > 0 THEN substr(body, 1, size) ELSE string_split(body, chr(29))[1] END AS v
              FROM (SELECT w.*, i.digits, i.size, substr(rest, 1, coalesce(i.digits, 2)) AS ai, substr(rest, coalesce(i.digits, 2) + 1) AS body
                    FROM walk w LEFT JOIN identifiers i ON i.two = substr(w.rest, 1, 2)
                    WHERE w.reason IS NULL AND w.rest <> ''))))"""


@query("gs1_fields", "D2", sql_with(["scans"], """
SELECT scan_group, scan_no, found[2:] AS fields, reason FROM walk
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC) = 1""", [FIXED, GS1_WALK], recursive=True))
def _(t):
    read = gs1.gs1_fields(t.scans)
    listed = F.array_join(F.transform(F.map_entries("fields"), lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|")
    return read.select("scan_group", "scan_no", listed.alias("fields"), "reason")


@query("count_scans", "A12", sql_with(["scans"], """
SELECT gtin, batch, expiry, COUNT(*) AS scanned_qty FROM extracted
WHERE gtin IS NOT NULL GROUP BY ALL""", [FIXED, EXTRACTED]))
def _(t):
    return scans.count_scans(t.scans)


@query("scan_type_profile", "A13", sql_with(
    ["scans"], "SELECT type, COUNT(*) AS scan_count FROM classified GROUP BY type", [CLASSIFIED]))
def _(t):
    return scans.scan_type_profile(t.scans)


MATCHED = """
counts AS (
  SELECT gtin, batch, COUNT(*) AS n FROM extracted
  WHERE gtin IS NOT NULL AND batch IS NOT NULL GROUP BY ALL),
matched AS (
  SELECT COALESCE(r.gtin, c.gtin) AS gtin, COALESCE(r.batch, c.batch) AS batch,
         r.expected_qty, COALESCE(c.n, 0) AS scanned_qty, s.stock_qty,
         CASE WHEN r.expected_qty IS NULL THEN 'NOT_LISTED'
              WHEN COALESCE(c.n, 0) >= r.expected_qty THEN 'COMPLETE' ELSE 'OPEN' END AS status
  FROM return_list r
  FULL OUTER JOIN counts c ON r.gtin = c.gtin AND r.batch = c.batch
  LEFT JOIN (SELECT gtin, batch, CAST(SUM(qty) AS BIGINT) AS stock_qty
             FROM return_stock GROUP BY ALL) s
    ON COALESCE(r.gtin, c.gtin) = s.gtin AND COALESCE(r.batch, c.batch) = s.batch)"""
RETURN_TABLES = ["scans", "return_list", "return_stock"]


def _over_returns(select):
    return sql_with(RETURN_TABLES, select, [FIXED, EXTRACTED, MATCHED])


def _matched(t):
    return returns.match_returns(scans.extract_gs1(t.scans), t.return_list, t.return_stock)


@query("match_returns", "J7", _over_returns("SELECT * FROM matched"))
def _(t):
    return _matched(t)


@query("unmatched_scans", "J7", sql_with(["scans"], """
SELECT *, CASE WHEN gtin IS NULL THEN 'NO_PRODUCT_CODE' ELSE 'NO_BATCH' END AS reason
FROM extracted WHERE gtin IS NULL OR batch IS NULL""", [FIXED, EXTRACTED]))
def _(t):
    return returns.unmatched_scans(scans.extract_gs1(t.scans))


@query("completed_returns", "J8", _over_returns(
    "SELECT * FROM matched WHERE status = 'COMPLETE'"))
def _(t):
    return returns.completed_returns(_matched(t))


@query("open_returns", "J8", _over_returns("""
SELECT * FROM return_list WHERE (gtin, batch) IN (
  SELECT (gtin, batch) FROM matched WHERE status = 'OPEN')"""))
def _(t):
    return returns.open_returns(t.return_list, returns.completed_returns(_matched(t)))


CLEAN = """clean AS (
  SELECT DISTINCT * FROM stock WHERE storage_loc IS NULL OR storage_loc NOT LIKE '%GI-ZONE%')"""


def _over_stock(select, *ctes):
    return sql_with(["stock"], select, ctes)


@query("clean_stock", "P14", _over_stock("SELECT * FROM clean", CLEAN))
def _(t):
    return stock.clean_stock(t.stock)


@query("dedupe_stock", "A11", _over_stock(
    "SELECT DISTINCT plant_code, storage_loc, product_code FROM stock"))
def _(t):
    return stock.dedupe_stock(t.stock.select("plant_code", "storage_loc", "product_code"))


@query("stock_by_product", "A10", _over_stock(
    "SELECT product_code, CAST(SUM(qty) AS BIGINT) AS qty FROM clean GROUP BY ALL", CLEAN))
def _(t):
    return stock.stock_by_product(stock.clean_stock(t.stock))


@query("stock_sheet_full", "D3 K8", _over_stock(
    "SELECT *, '' AS counted_by, '' AS keyed_by, '' AS approved_by FROM clean", CLEAN))
def _(t):
    return stock.stock_sheet(t.stock, "full")


@query("stock_sheet_upload", "D3 K8", _over_stock("""
SELECT product_code, storage_loc, CAST(SUM(qty) AS BIGINT) AS qty FROM clean GROUP BY ALL""", CLEAN))
def _(t):
    return stock.stock_sheet(t.stock, "upload")


@query("stock_sheet_daily", "D3 K8", _over_stock("""
SELECT storage_loc, product_code, product_name, CAST(SUM(qty) AS BIGINT) AS qty
FROM clean GROUP BY ALL""", CLEAN))
def _(t):
    return stock.stock_sheet(t.stock, "daily")
