"""The same results in SQL, written apart from the library: name -> one query for DuckDB."""

from __future__ import annotations

from qualframe import model as M

# --- the views with planted flaws --------------------------------------------------------------

SPACE = r"e' \t\n\r'"

DIRTY_ORDERS = """
dirty_orders_once AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
    CASE WHEN o_orderkey % 20 < 11 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 20 < 17 THEN strftime(o_orderdate, '%d/%m/%Y')
         ELSE strftime(o_orderdate, '%d %B %Y') END AS order_date,
    CASE o_orderkey % 50 WHEN 0 THEN 'pending' WHEN 1 THEN 'TBD' WHEN 2 THEN 'N/A' WHEN 3 THEN '-'
         ELSE format('{:,.2f}', o_totalprice) END AS revenue,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 4 * 5 AS VARCHAR) END AS discount,
    CASE WHEN o_orderkey % 8 < 5 THEN '' WHEN o_orderkey % 8 = 5 THEN 'Bulk order'
         WHEN o_orderkey % 8 = 6 THEN 'Gift' ELSE 'Repeat' END AS notes,
    'USD' AS currency,
    printf('%.2f', CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 100 ELSE o_totalprice END) AS unit_price
  FROM orders),
dirty_orders AS (
  SELECT * FROM dirty_orders_once UNION ALL
  SELECT * FROM dirty_orders_once WHERE CAST(order_key AS BIGINT) % 25 = 0)"""

DIRTY_CUSTOMERS = """
dirty_customers_spelt AS (
  SELECT c_custkey AS k, c_name,
    CASE WHEN c_custkey % 9 = 0 THEN lower(c_mktsegment)
         WHEN c_custkey % 7 = 0 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
         ELSE c_mktsegment END AS spelt FROM customer),
dirty_customers AS (
  SELECT CAST(k AS VARCHAR) AS cust_key,
    CASE WHEN k % 13 = 0 THEN '  ' || spelt || chr(9) ELSE spelt END AS segment,
    CASE WHEN k % 14 = 0 THEN 'user' || k || '@' ELSE 'user' || k || '@example.com' END AS email,
    CASE WHEN k % 17 = 0 THEN 'call me'
         ELSE '+1 (555) ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone,
    c_name AS name FROM dirty_customers_spelt)"""

DIRTY_DOCUMENTS = """
dirty_documents AS (
  SELECT doc_id, text, n_chars,
    CASE WHEN doc_id % 5 = 0 THEN upper(lang) WHEN doc_id % 11 = 0 THEN upper(lang[1]) || lower(lang[2:]) ELSE lang END AS lang,
    CASE WHEN doc_id % 7 = 0 THEN upper(source) WHEN doc_id % 13 = 0 THEN source || ' ' ELSE source END AS source
  FROM documents)"""

DIRTY_EVENTS = """
dirty_events AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 15 = 0 THEN 'N/A' ELSE printf('%.2f', value) END AS value,
    CASE WHEN event_id % 16 = 0 THEN '' ELSE event_type END AS event_type FROM events)"""


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


KINDS = _sql_list(M.MENU)
MENUS = "MAP {" + ", ".join(f"'{k}': {_sql_list(v)}" for k, v in M.MENU.items()) + "}"
WEIGHTS = "MAP {'low': 1.0, 'medium': 2.5, 'high': 5.0, 'critical': 10.0}"
DIMENSIONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.DIMENSION.items()) + "}"

ISSUE_LOG = f"""
issue_log AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
    kind || ':c' || (o_orderkey % 100) AS issue_id, kind AS issue_type,
    CASE WHEN kind <> 'duplicate_rows' THEN 'c' || (o_orderkey % 100) END AS "column",
    (['low', 'medium', 'high', 'critical'])[(o_orderkey + j) % 4 + 1] AS severity,
    'Finding in c' || (o_orderkey % 100) AS title, o_orderpriority AS detail,
    (o_orderkey * 7 + j) % 1000 AS affected_rows,
    ((o_orderkey * 7 + j) % 1000) / 10 AS affected_pct,
    o_orderstatus || '|' || o_orderpriority AS evidence,
    CASE WHEN kind = 'missing_values' THEN o_orderkey % 2 = 0 END AS numeric_text,
    CASE WHEN kind = 'outliers' AND o_orderkey % 4 > 0 THEN 0.0 END AS lower_bound,
    o_orderkey AS k, j
  FROM (SELECT *, ({KINDS})[(o_orderkey + j) % 9 + 1] AS kind
        FROM orders, (VALUES (0), (4), (8)) AS t(j)))"""

DECISION_LOG = f"""
decision_log AS (
  SELECT run_id, CASE WHEN k % 17 = 0 THEN 'unknown:c0' ELSE issue_id END AS issue_id,
    k % 4 > 0 AS approved,
    CASE WHEN k % 11 = 0 THEN 'drop_column'
         ELSE ({MENUS})[issue_type][(k // 9) % len(({MENUS})[issue_type]) + 1] END AS strategy,
    CASE WHEN k % 5 = 0 THEN 'X' WHEN k % 5 = 1 THEN '' END AS fill_value, issue_type
  FROM issue_log WHERE k % 3 < 2)"""

RULE_STRATEGY = """CASE issue_type
    WHEN 'missing_values' THEN CASE WHEN affected_pct >= 60 THEN 'none'
      WHEN affected_pct <= 5 AND NOT coalesce(numeric_text, false) THEN 'fill_mode'
      WHEN numeric_text THEN 'fill_median' ELSE 'fill_mode' END
    WHEN 'duplicate_rows' THEN 'drop_duplicates' WHEN 'mixed_types' THEN 'coerce_numeric'
    WHEN 'inconsistent_dates' THEN 'normalize_dates' WHEN 'whitespace' THEN 'trim_whitespace'
    WHEN 'inconsistent_casing' THEN 'standardize_case_title' WHEN 'invalid_format' THEN 'blank_invalid'
    ELSE 'none' END"""
RULES = f"rules AS (SELECT *, {RULE_STRATEGY} AS r_strategy FROM issue_log)"

# Which replies of the log hold: fenced, wrapped and plain ones.
GOOD_REPLY = "k % 7 IN (0, 1, 6)"

RUN_LOG = """
run_log AS (
  SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_name AS filename, c_custkey AS k,
    (['queued', 'analyzing', 'awaiting_approval', 'applying', 'completed', 'failed'])[c_custkey % 6 + 1]
      AS status,
    't' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS created_at,
    50.0 + c_custkey % 40 AS score_before, 50.0 + c_custkey % 40 + c_custkey % 10 + 0.5 AS score_after
  FROM customer)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# --- cell tests ------------------------------------------------------------------------------------

BLANK_WORDS = "('', 'na', 'n/a', 'n.a.', 'n/a.', 'nan', 'null', 'none', 'nil', '-', '--', '?', '#n/a')"
NUMBER = r"^-?[\d,]*\.?\d+%?$"
DATE = (
    r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}/\d{1,2}/\d{4}$|^\d{1,2}-\d{1,2}-\d{4}$|^\d{4}/\d{1,2}/\d{1,2}$"
    r"|^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$"
    r"|^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"
)
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
PHONE = r"^[+()\-.\s\d]{7,20}$"


def _strip(c: str) -> str:
    return f"trim({c}, {SPACE})"


def _blank(c: str) -> str:
    return f"(lower({_strip(c)}) IN {BLANK_WORDS})"


def _cells(source: str, columns: list[str]) -> str:
    """Long form with one flag per cell test."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {source}" for c in columns
    )
    return f"""
cells AS (
  SELECT col, v, s, blank, NOT blank AND regexp_matches(replace(replace(replace(s, '$', ''), '€', ''), '£', ''),
      '{NUMBER}') AS is_number,
    NOT blank AND regexp_matches(s, '{DATE}') AS is_date
  FROM (SELECT col, v, {_strip('v')} AS s, {_blank('v')} AS blank FROM ({parts})))"""


LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
PROFILED = {
    "profile_lineitem": {
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice"
        " l_discount l_tax l_returnflag l_linestatus l_shipdate",
    },
    "profile_events": {"events": "event_id ts user_id event_type value props"},
    "profile_dimensions": {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "pages": "page_id url html",
    },
}
ORDER_COLUMNS = ["order_key", "order_date", "revenue", "discount", "notes", "currency", "unit_price"]
CUSTOMER_COLUMNS = ["cust_key", "segment", "email", "phone", "name"]


def _classes(cte: str | None, source: str, columns: list[str]) -> str:
    return _with(*[c for c in (cte, _cells(source, columns)) if c]) + f"""
SELECT col AS "column", count(*) AS rows, count_if(blank)::BIGINT AS blanks,
  count_if(blank AND s <> '')::BIGINT AS placeholders, count_if(is_number)::BIGINT AS numeric_like,
  count_if(is_date)::BIGINT AS date_like, count_if(NOT blank AND v <> s)::BIGINT AS padded,
  count_if(NOT blank AND ((col = 'email' AND NOT regexp_matches(s, '{EMAIL}'))
    OR (col = 'phone' AND NOT regexp_matches(s, '{PHONE}'))))::BIGINT AS invalid,
  count_if(NOT blank AND regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$'))::BIGINT
    AS strict_numbers
FROM cells GROUP BY col"""


# --- findings ----------------------------------------------------------------------------------------


def _shares(inner: str, extra: str = "") -> str:
    """Add the share of rows to (.., n, total) rows."""
    return f"SELECT * EXCLUDE (n, total), n AS affected_rows, round(100.0 * n / total, 2) AS affected_pct {extra} FROM ({inner})"


def _missing(table: str, cte: str, columns: list[str]) -> str:
    cells = _cells(table, columns).strip().removeprefix("cells AS (").removesuffix(")")
    return f"""SELECT '{table.removeprefix('dirty_')}' AS table_name, col, count_if(blank)::BIGINT AS n,
      count(*) AS total, count_if(is_number) / count_if(NOT blank) >= 0.8 AS num FROM ({cells}) GROUP BY col"""


def _outliers(name: str, source: str, column: str, value: str) -> str:
    return f"""
SELECT '{name}' AS table_name, '{column}' AS "column", 'medium' AS severity, n AS affected_rows,
  round(100.0 * n / total, 2) AS affected_pct, 'none' AS default_strategy,
  round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
FROM (SELECT count_if(v < lo OR v > hi)::BIGINT AS n, count(*) AS total, count(v) AS present,
        any_value(lo) AS lo, any_value(hi) AS hi, any_value(iqr) AS iqr
      FROM (SELECT {value} AS v FROM {source}),
        (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi, q3 - q1 AS iqr
         FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
               FROM (SELECT {value} AS v FROM {source}))))
WHERE n > 0 AND iqr > 0 AND present >= 20"""


PLAIN = r"'^\d+\.\d+$'"
UNIT_PRICE = "CAST(unit_price AS DOUBLE)"
BOUNDS = f"""
bounds AS (
  SELECT round(q1 - 3 * (q3 - q1), 4) AS lo, round(q3 + 3 * (q3 - q1), 4) AS hi
  FROM (SELECT quantile_cont({UNIT_PRICE}, 0.25) AS q1, quantile_cont({UNIT_PRICE}, 0.75) AS q3
        FROM dirty_orders))"""
REVENUE = "TRY_CAST(replace(revenue, ',', '') AS DOUBLE)"

# The dates of the view are day-first, as its slashed dates show.
ISO_DATE = """CASE WHEN order_date LIKE '%/%' THEN strftime(strptime(order_date, '%d/%m/%Y'), '%Y-%m-%d')
  WHEN order_date LIKE '% %' THEN strftime(strptime(order_date, '%d %B %Y'), '%Y-%m-%d')
  ELSE order_date END"""

DUPLICATE_ROWS = """SELECT 'orders' AS table_name, CAST(NULL AS VARCHAR) AS "column", n, total FROM
  (SELECT sum(k - 1)::BIGINT AS n, sum(k)::BIGINT AS total FROM
    (SELECT *, count(*) AS k FROM dirty_orders GROUP BY ALL))
 UNION ALL SELECT 'texts', NULL, n, total FROM
  (SELECT sum(k - 1)::BIGINT AS n, sum(k)::BIGINT AS total FROM
    (SELECT count(*) AS k FROM documents GROUP BY text, lang, source, n_chars))"""

CASING = """
groups AS (
  SELECT lower(s) AS low, count(DISTINCT s) AS k, count(*) AS n,
    array_to_string(list_sort(list(DISTINCT s)), ' / ') AS names
  FROM (SELECT trim(segment, e' \\t') AS s FROM dirty_customers) GROUP BY 1 HAVING count(DISTINCT s) > 1)"""



def _casing(name: str, source: str, column: str) -> str:
    return f"""
SELECT '{name}' AS table_name, '{column}' AS "column", 'medium' AS severity, affected_rows,
  round(100.0 * affected_rows / total, 2) AS affected_pct, clashing_groups, evidence
FROM (SELECT sum(n) FILTER (k > 1)::BIGINT AS affected_rows, sum(n) AS present, sum(k) AS spellings,
    count(*) FILTER (k > 1) AS clashing_groups,
    array_to_string(list(names ORDER BY low) FILTER (k > 1)[1:3], '; ') AS evidence
  FROM (SELECT lower(s) AS low, count(DISTINCT s) AS k, count(*) AS n,
      array_to_string(list_sort(list(DISTINCT s))[1:4], ' / ') AS names
    FROM (SELECT {_strip(column)} AS s FROM {source} WHERE NOT coalesce({_blank(column)}, true)) GROUP BY 1)),
  (SELECT count(*) AS total FROM {source})
WHERE clashing_groups > 0 AND present >= 5 AND spellings <= 0.5 * present"""


# Findings of the whole orders view, each by its own rule.
ORDER_FINDINGS = f"""
findings AS (
  SELECT 'missing_values:notes' AS issue_id, 'critical' AS severity, count_if(notes = '')::BIGINT AS n FROM dirty_orders
  UNION ALL SELECT 'missing_values:discount',
    CASE WHEN 100.0 * count_if(discount = '') / count(*) >= 20 THEN 'high' ELSE 'medium' END,
    count_if(discount = '')::BIGINT FROM dirty_orders
  UNION ALL SELECT 'mixed_types:revenue', 'high', count_if(revenue IN ('pending', 'TBD'))::BIGINT FROM dirty_orders
  UNION ALL SELECT 'inconsistent_dates:order_date', 'high', (sum(k) - max(k))::BIGINT FROM (
    SELECT count(*) AS k FROM dirty_orders
    GROUP BY CASE WHEN order_date LIKE '%/%' THEN 1 WHEN order_date LIKE '% %' THEN 2 ELSE 3 END)
  UNION ALL SELECT 'duplicate_rows:rows', 'medium', sum(k - 1)::BIGINT FROM (
    SELECT *, count(*) AS k FROM dirty_orders GROUP BY ALL)
  UNION ALL SELECT 'outliers:unit_price', 'medium', count_if({UNIT_PRICE} NOT BETWEEN lo AND hi)::BIGINT
    FROM dirty_orders, bounds
  UNION ALL SELECT 'constant_column:currency', 'low', count(*) FROM dirty_orders)"""

CUSTOMER_FINDINGS = f"""
findings AS (
  SELECT 'inconsistent_casing:segment' AS issue_id, 'medium' AS severity, sum(n)::BIGINT AS n FROM groups
  UNION ALL SELECT 'whitespace:segment', 'low', count_if(segment LIKE ' %')::BIGINT FROM dirty_customers
  UNION ALL SELECT 'invalid_format:email', 'high', count_if(NOT regexp_matches(email, '{EMAIL}'))::BIGINT
    FROM dirty_customers
  UNION ALL SELECT 'invalid_format:phone', 'high', count_if(NOT regexp_matches(phone, '{PHONE}'))::BIGINT
    FROM dirty_customers)"""


def _points(severity: str = "severity", pct: str = "affected_pct") -> str:
    return f"CAST(({WEIGHTS})[{severity}] AS DOUBLE) * least(1.0, {pct} / 100 * 3 + 0.15)"


def _scores(source: str, group: str, places: tuple[int, int], keep_grade: bool = True) -> str:
    def dimension(name: str) -> str:
        lost = f"coalesce(sum(points) FILTER (dim = '{name}'), 0.0)"
        return f"round(greatest(0.0, 100.0 - 2.5 * {lost}), {places[0]}) AS {name}"

    grade = """CASE WHEN round(score, 1) >= 95 THEN 'Excellent' WHEN round(score, 1) >= 85 THEN 'Good'
      WHEN round(score, 1) >= 70 THEN 'Fair' WHEN round(score, 1) >= 50 THEN 'Poor' ELSE 'Critical' END AS grade"""
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""SELECT *, {grade} FROM (SELECT {head}
      round(greatest(0.0, 100.0 - coalesce(sum(points), 0.0)), {places[0]}) AS score,
      {", ".join(dimension(n) for n in M.DIMENSIONS)}, count(*) AS issue_count,
      round(coalesce(sum(points), 0.0), {places[1]}) AS penalty FROM {source} {tail})"""


def _orders(select: str, *more: str) -> str:
    return _with(DIRTY_ORDERS, *more) + select


def _customers(select: str, *more: str) -> str:
    return _with(DIRTY_CUSTOMERS, *more) + select


def _events(select: str) -> str:
    return _with(DIRTY_EVENTS) + select


def _log(select: str, *more: str) -> str:
    return _with(ISSUE_LOG, RULES, *more) + select


CLEAN_STEPS = f"""
SELECT * EXCLUDE (currency) REPLACE (
    {ISO_DATE} AS order_date,
    {REVENUE} AS revenue,
    coalesce(TRY_CAST(discount AS DOUBLE), (SELECT median(TRY_CAST(discount AS DOUBLE)) FROM dirty_orders)) AS discount,
    CASE WHEN notes = '' THEN 'none given' ELSE notes END AS notes)
FROM (SELECT DISTINCT * FROM dirty_orders), bounds WHERE {UNIT_PRICE} BETWEEN lo AND hi"""


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["preview_customers"] = _customers("SELECT * FROM dirty_customers ORDER BY cust_key LIMIT 20")
    q["preview_orders_with_total"] = _orders(
        """SELECT *, (SELECT count(*) FROM dirty_orders) AS total_rows FROM dirty_orders
        ORDER BY order_key, unit_price LIMIT 5"""
    )
    q["delimited_round_trip"] = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, CAST(doc_id AS VARCHAR) AS doc_id,
        coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars FROM documents"""
    q["delimiter_choice"] = _customers(
        "SELECT dirty_customers.*, delimiter FROM dirty_customers, (VALUES (','), (chr(9)), (';'), ('|')) AS t(delimiter)"
    )
    q["cell_classes_orders"] = _classes(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS)
    q["cell_classes_customers"] = _classes(DIRTY_CUSTOMERS, "dirty_customers", CUSTOMER_COLUMNS)
    q["cell_classes_documents"] = _classes(None, "documents", ["text", "lang", "source"])
    q["number_readings"] = _orders(
        f"""SELECT count_if(regexp_matches(revenue, {PLAIN}))::BIGINT AS strict_revenue,
        count({REVENUE}) AS lenient_revenue, max({REVENUE}) AS max_revenue,
        count(*) AS strict_unit_price, count(*) AS lenient_unit_price, max({UNIT_PRICE}) AS max_unit_price
        FROM dirty_orders"""
    )
    q["date_layouts"] = _orders(
        """SELECT 'order_date' AS "column", regexp_replace(regexp_replace(order_date, '\\d+', '#', 'g'),
        '[A-Za-z]+', 'A', 'g') AS shape, count(*) AS n FROM dirty_orders GROUP BY 2"""
    )
    q["day_first_reading"] = _orders(
        """SELECT count_if(a > 12)::BIGINT AS first_over_12, count_if(b > 12)::BIGINT AS second_over_12,
        bool_or(a > 12) AND NOT bool_or(b > 12) AS day_first
        FROM (SELECT CAST(split_part(order_date, '/', 1) AS INT) AS a,
          CAST(split_part(order_date, '/', 2) AS INT) AS b FROM dirty_orders WHERE order_date LIKE '%/%')"""
    )
    q["title_case_names"] = """SELECT p_partkey, array_to_string(list_transform(
        regexp_extract_all(p_type, '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), '') AS spelt
        FROM part"""

    missing = " UNION ALL ".join(
        _missing(t, c, cols)
        for t, c, cols in (
            ("dirty_orders", DIRTY_ORDERS, ORDER_COLUMNS),
            ("dirty_customers", DIRTY_CUSTOMERS, CUSTOMER_COLUMNS),
            ("dirty_events", DIRTY_EVENTS, ["value", "event_type"]),
        )
    )
    q["detect_missing_values"] = _with(DIRTY_ORDERS, DIRTY_CUSTOMERS, DIRTY_EVENTS) + f"""
        SELECT table_name, col AS "column", CASE WHEN pct >= 40 THEN 'critical' WHEN pct >= 20 THEN 'high'
          ELSE 'medium' END AS severity, n AS affected_rows, round(pct, 2) AS affected_pct,
          CASE WHEN num THEN 'fill_median' ELSE 'fill_mode' END AS default_strategy,
          round(pct, 2) AS null_pct, num AS numeric
        FROM (SELECT *, 100.0 * n / total AS pct FROM ({missing})) WHERE pct >= 5"""
    q["detect_duplicate_rows"] = _orders(
        _shares(
            DUPLICATE_ROWS,
            """, CASE WHEN 100.0 * n / total >= 5 THEN 'high' ELSE 'medium' END AS severity,
            'drop_duplicates' AS default_strategy""",
        )
    )
    entries = "CASE WHEN event_id % 2 = 0 THEN '{type -> ' || event_type || ', user -> ' || u ELSE '{user -> ' || u || ', type -> ' || event_type END || '}'"
    said = """'{"type":"' || event_type || '","user":' || u || '}'"""
    q["detect_duplicates_nested"] = f"""
        WITH e AS (SELECT event_id, event_type, CAST(user_id % 40 AS VARCHAR) AS u, {entries.replace('u ', 'CAST(user_id % 40 AS VARCHAR) ').replace('|| u ||', '|| CAST(user_id % 40 AS VARCHAR) ||')} AS facts FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY u, event_type ORDER BY event_id) AS copy FROM e),
        shown AS (SELECT event_id, concat('user=', u, ' | inside=', left('{{1, ' || facts || '}}', 20), ' | list=',
            left('[' || facts || ', ' || CASE WHEN u::INT % 3 = 0 THEN '{{x -> y}}' ELSE 'null' END || ']', 20),
            ' | said=', left({said}, 20)) AS line FROM n WHERE copy > 1 ORDER BY event_id LIMIT 3)
        SELECT 'ordered' AS table_name, count(*) AS affected_rows, (SELECT string_agg(line, chr(10) ORDER BY event_id) FROM shown) AS evidence
        FROM n WHERE copy > 1 UNION ALL SELECT 'unordered', count(*), NULL FROM n WHERE copy > 1"""
    line = " || ' | ' || ".join(f"'{c}=' || left({c}, 20)" for c in ORDER_COLUMNS)
    later = "(SELECT *, count(*) OVER (PARTITION BY order_key) AS k FROM dirty_orders_once)"
    q["duplicates_hashed"] = _orders(
        f"""SELECT 'orders' AS table_name, sum(k - 1)::BIGINT AS copies, (SELECT string_agg(line, chr(10) ORDER BY {", ".join(ORDER_COLUMNS)})
          FROM (SELECT *, {line} AS line FROM g WHERE k > 1 ORDER BY {", ".join(ORDER_COLUMNS)} LIMIT 3)) AS evidence FROM g
        UNION ALL SELECT 'ordered', sum(k - 1)::BIGINT, (SELECT string_agg(line, chr(10) ORDER BY order_key)
          FROM (SELECT *, {line} AS line FROM g WHERE k > 1 ORDER BY order_key LIMIT 3)) FROM g
        UNION ALL SELECT 'documents', (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM documents
          GROUP BY text, lang, source, n_chars)), NULL""",
        "g AS (SELECT *, count(*) AS k FROM dirty_orders GROUP BY ALL)",
    )
    q["drop_copies_hashed_ordered"] = f"""
        SELECT min(event_id) AS place, CAST(u AS BIGINT) AS user, {said} AS said
        FROM (SELECT event_id, event_type, CAST(user_id % 40 AS VARCHAR) AS u FROM events) GROUP BY u, event_type"""
    q["forward_fill_buckets"] = _events(
        """SELECT * REPLACE (last_value(CASE WHEN event_type <> '' THEN event_type END IGNORE NULLS)
        OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type) FROM dirty_events"""
    )
    q["delimited_fill_and_copies"] = _orders(
        """SELECT row, order_key, last_value(CASE WHEN discount <> '' THEN discount END IGNORE NULLS)
          OVER (ORDER BY row ROWS UNBOUNDED PRECEDING) AS discount
        FROM (SELECT min(row) AS row, order_key, any_value(discount) AS discount FROM
          (SELECT *, row_number() OVER (ORDER BY order_key) - 1 AS row FROM dirty_orders) GROUP BY order_key)"""
    )
    q["median_narrowed"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, quantile_cont({c}::DOUBLE, 0.25) AS q1,
        quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem"""
        for c in LINE_NUMBERS
    )
    middle = "(SELECT {f} FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM w WHERE {c} IS NOT NULL) WHERE i IN ((n - 1) // 2, n // 2))"
    q["fix_fill_median_wide"] = f"""
        WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN l_orderkey + 9007199254740993 END AS wide,
          CASE WHEN l_linenumber <> 2 THEN (l_orderkey::HUGEINT + 12345678901234567890) * 125 END AS eighths FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(coalesce(wide::HUGEINT, {middle.format(f="(sum(v) + count(v) - 1) // count(v)", c="wide")}) AS VARCHAR) AS wide,
          CAST(CAST(coalesce(eighths, {middle.format(f="(sum(v) + count(v) - 1) // count(v)", c="eighths")}) AS DECIMAL(36,0)) * 0.001 AS VARCHAR) AS exact FROM w"""
    q["detect_mixed_types"] = _orders(
        """SELECT 'revenue' AS "column", 'high' AS severity, n AS affected_rows,
        round(100.0 * n / total, 2) AS affected_pct, round(100.0 * (present - n) / present, 2) AS numeric_pct,
        'TBD / pending' AS evidence
        FROM (SELECT count_if(revenue IN ('pending', 'TBD'))::BIGINT AS n, count(*) AS total,
          count_if(revenue NOT IN ('N/A', '-')) AS present FROM dirty_orders)"""
    )
    q["detect_inconsistent_dates"] = _orders(
        """SELECT 'orders' AS table_name, 'order_date' AS "column", 'high' AS severity, n AS affected_rows,
        round(100.0 * n / total, 2) AS affected_pct, 'normalize_dates' AS default_strategy, formats
        FROM (SELECT (sum(k) - max(k))::BIGINT AS n, sum(k)::BIGINT AS total, count(*) AS formats FROM
          (SELECT count(*) AS k FROM dirty_orders
           GROUP BY regexp_replace(regexp_replace(order_date, '\\d+', '#', 'g'), '[A-Za-z]+', 'A', 'g')))"""
    )
    written = "CASE WHEN regexp_matches({c}, '^-?\\d+(\\.\\d+)?$') THEN CAST({c} AS DOUBLE) END"
    numbers = {
        "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
        "events": ("event_id", "user_id", "value"),
        "documents": ("doc_id", "n_chars"),
        "lineitem": LINE_NUMBERS,
        "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"),
        "part": ("p_partkey", "p_size", "p_retailprice"),
    }
    q["detect_outliers"] = _with(DIRTY_ORDERS) + " UNION ALL ".join(
        [_outliers("orders", "dirty_orders", c, written.format(c=c)) for c in ("order_key", "revenue", "discount", "unit_price")]
        + [
            _outliers("given_orders" if t == "orders" else t, t, c, f"CAST({c} AS DOUBLE)")
            for t, columns in numbers.items()
            for c in columns
        ]
    )
    q["detect_whitespace"] = _customers(
        """SELECT 'customers' AS table_name, 'segment' AS "column", 'low' AS severity, n AS affected_rows,
        round(100.0 * n / total, 2) AS affected_pct, 'trim_whitespace' AS default_strategy
        FROM (SELECT count_if(segment LIKE ' %')::BIGINT AS n, count(*) AS total FROM dirty_customers)"""
    )
    q["detect_inconsistent_casing"] = _with(DIRTY_CUSTOMERS, DIRTY_DOCUMENTS, DIRTY_ORDERS) + " UNION ALL ".join(
        _casing(name, source, column)
        for name, source, columns in (
            ("customers", "dirty_customers", CUSTOMER_COLUMNS),
            ("documents", "dirty_documents", ["text", "lang", "source"]),
            ("orders", "dirty_orders", ORDER_COLUMNS),
            ("given_orders", "orders", ["o_orderstatus", "o_orderpriority"]),
        )
        for column in columns
    )
    q["detect_invalid_format"] = _customers(
        " UNION ALL ".join(
            f"""SELECT 'customers' AS table_name, '{c}' AS "column", 'high' AS severity, n AS affected_rows,
            round(100.0 * n / total, 2) AS affected_pct, 'blank_invalid' AS default_strategy, '{label}' AS expected
            FROM (SELECT count_if(NOT regexp_matches({c}, '{rule}'))::BIGINT AS n, count(*) AS total
                  FROM dirty_customers)"""
            for c, rule, label in (("email", EMAIL, M.EMAIL), ("phone", PHONE, M.PHONE))
        )
    )
    q["detect_constant_columns"] = _orders(
        """SELECT 'orders' AS table_name, 'currency' AS "column", 'low' AS severity, count(*) AS affected_rows,
        100.0::DOUBLE AS affected_pct, 'none' AS default_strategy FROM dirty_orders"""
    )
    shares = "round(100.0 * n / (SELECT count(*) FROM dirty_{}), 2) AS affected_pct"
    q["detect_all_orders"] = _orders(
        f"""SELECT CAST(row_number() OVER (ORDER BY ({WEIGHTS})[severity] DESC, affected_pct DESC, issue_id)
        AS INTEGER) AS place, issue_id, severity, affected_rows, affected_pct
        FROM (SELECT issue_id, severity, n AS affected_rows, {shares.format('orders')} FROM findings)""",
        BOUNDS,
        ORDER_FINDINGS,
    )
    q["detect_all_customers"] = _customers(
        f"SELECT issue_id, severity, n AS affected_rows, {shares.format('customers')} FROM findings",
        CASING,
        CUSTOMER_FINDINGS,
    )
    q["issues_worst_first"] = _log("SELECT run_id, issue_id, severity FROM issue_log")
    q["issues_to_ask_about"] = _log(
        f"""SELECT run_id, issue_id FROM issue_log QUALIFY row_number() OVER (PARTITION BY run_id
        ORDER BY ({WEIGHTS})[severity] DESC, affected_pct DESC, issue_id) <= 2"""
    )

    q["profile_orders"] = _with(DIRTY_ORDERS, _cells("dirty_orders", ORDER_COLUMNS)) + """
        SELECT col AS name, 'string' AS dtype, count_if(NOT blank)::BIGINT AS non_null,
          count_if(blank)::BIGINT AS null_count, 100.0 * count_if(blank) / count(*) AS null_pct,
          count(DISTINCT v) FILTER (NOT blank) AS unique_count,
          100.0 * count_if(is_number) / count_if(NOT blank) AS numeric_like_pct,
          100.0 * count_if(is_date) / count_if(NOT blank) AS date_like_pct,
          min(v) FILTER (NOT blank) AS min_value, max(v) FILTER (NOT blank) AS max_value,
          sum(strlen(v))::BIGINT AS bytes FROM cells GROUP BY col"""
    q["profile_documents"] = _with(_cells("documents", ["doc_id", "text", "lang", "source", "n_chars"])) + """
        SELECT col AS name, count_if(NOT blank)::BIGINT AS non_null, count_if(blank)::BIGINT AS null_count,
          count(DISTINCT v) FILTER (NOT blank) AS unique_count,
          100.0 * count_if(is_number) / count_if(NOT blank) AS numeric_like_pct,
          100.0 * count_if(is_date) / count_if(NOT blank) AS date_like_pct FROM cells GROUP BY col"""
    for name, tables in PROFILED.items():
        q[name] = " UNION ALL ".join(
            "SELECT * FROM (" + _with(_cells(t, columns.split())) + f"""
            SELECT '{t}' AS table_name, col AS name, count_if(NOT blank)::BIGINT AS non_null,
              count_if(blank)::BIGINT AS null_count, count(DISTINCT v) FILTER (NOT blank) AS unique_count
            FROM cells GROUP BY col)"""
            for t, columns in tables.items()
        )
    q["profile_samples"] = _with(DIRTY_CUSTOMERS) + """
        SELECT col AS "column", array_to_string(list(v ORDER BY k)[:5], '|') AS sample_values
        FROM (SELECT cust_key AS k, unnest(["cust_key", "segment", "email", "phone", "name"]) AS v,
          unnest(['cust_key', 'segment', 'email', 'phone', 'name']) AS col FROM dirty_customers) GROUP BY col"""
    q["value_range_lineitem"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
        {f'avg({c})' if c in LINE_NUMBERS else 'CAST(NULL AS DOUBLE)'} AS mean_value FROM lineitem"""
        for c in (*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")
    )
    q["profile_table_orders"] = _with(DIRTY_ORDERS, _cells("dirty_orders", ORDER_COLUMNS)) + """
        SELECT (SELECT count(*) FROM dirty_orders) AS rows, count(DISTINCT col) AS columns,
        sum(strlen(v))::BIGINT AS bytes FROM cells"""
    q["context_line_orders"] = """SELECT '''orders'' with ' || format('{:,}', count(*)) || ' rows and 6 columns: '
        || 'o_orderkey (bigint), o_custkey (bigint), o_orderstatus (string), o_totalprice (double), '
        || 'o_orderdate (timestamp_ntz), o_orderpriority (string).' AS context FROM orders"""
    q["score_orders"] = _orders(
        _scores("pointed", "", (1, 2)),
        BOUNDS,
        ORDER_FINDINGS,
        f"""pointed AS (SELECT {_points(pct='pct')} AS points, ({DIMENSIONS})[split_part(issue_id, ':', 1)] AS dim
        FROM (SELECT *, round(100.0 * n / (SELECT count(*) FROM dirty_orders), 2) AS pct FROM findings))""",
    )
    pointed = f"pointed AS (SELECT *, {_points()} AS points, ({DIMENSIONS})[issue_type] AS dim FROM issue_log)"
    q["score_runs"] = _log(_scores("pointed", "run_id", (6, 6)), pointed)
    q["issue_penalties"] = _log(
        "SELECT run_id, issue_id, round(points, 6) AS penalty, dim AS dimension FROM pointed", pointed
    )

    q["fix_none"] = _customers("SELECT * FROM dirty_customers")
    q["fix_drop_rows_missing"] = _orders("SELECT * FROM dirty_orders WHERE notes <> ''")
    q["fix_drop_rows_invalid"] = _customers(
        "SELECT * FROM dirty_customers WHERE email LIKE '%@example.com'"
    )
    number = "TRY_CAST(discount AS DOUBLE)"
    q["fix_fill_mean"] = _orders(
        f"""SELECT * REPLACE (coalesce({number}, (SELECT round(avg({number}), 4) FROM dirty_orders)) AS discount)
        FROM dirty_orders"""
    )
    q["fix_fill_median"] = _orders(
        f"""SELECT * REPLACE (coalesce({REVENUE}, (SELECT round(median({REVENUE}), 4) FROM dirty_orders)) AS revenue)
        FROM dirty_orders"""
    )
    q["fix_fill_mode"] = _events(
        """SELECT * REPLACE (CASE WHEN event_type = '' THEN (SELECT event_type FROM dirty_events
          WHERE event_type <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE event_type END AS event_type)
        FROM dirty_events"""
    )
    q["fix_fill_constant"] = _orders(
        "SELECT * REPLACE (CASE WHEN notes = '' THEN 'Unknown' ELSE notes END AS notes) FROM dirty_orders"
    )
    q["fix_forward_fill"] = _events(
        """SELECT event_id, user_id, value, last_value(nullif(event_type, '') IGNORE NULLS) OVER (ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM dirty_events"""
    )
    q["fix_drop_duplicates"] = _orders("SELECT DISTINCT * FROM dirty_orders")
    q["fix_coerce_numeric"] = _orders(f"SELECT * REPLACE ({REVENUE} AS revenue) FROM dirty_orders")
    q["fix_normalize_dates"] = _orders(f"SELECT * REPLACE ({ISO_DATE} AS order_date) FROM dirty_orders")
    segment = "trim(segment, e' \\t')"
    q["fix_trim_whitespace"] = _customers(f"SELECT * REPLACE ({segment} AS segment) FROM dirty_customers")
    q["fix_case_title"] = _customers(
        f"""SELECT * REPLACE (upper({segment}[1]) || lower({segment}[2:]) AS segment) FROM dirty_customers"""
    )
    q["fix_case_upper"] = _customers(f"SELECT * REPLACE (upper({segment}) AS segment) FROM dirty_customers")
    q["fix_case_lower"] = _customers(f"SELECT * REPLACE (lower({segment}) AS segment) FROM dirty_customers")
    q["fix_clip_outliers"] = _orders(
        f"SELECT * EXCLUDE (lo, hi) REPLACE (greatest(least({UNIT_PRICE}, hi), lo) AS unit_price) "
        "FROM dirty_orders, bounds",
        BOUNDS,
    )
    q["fix_clip_outliers_typed"] = """SELECT events.* EXCLUDE (value), greatest(least(value, hi), lo) AS value FROM events,
        (SELECT round(q1 - 3 * (q3 - q1), 4) AS lo, round(q3 + 3 * (q3 - q1), 4) AS hi
         FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""
    q["fix_remove_outlier_rows"] = _orders(
        f"SELECT * EXCLUDE (lo, hi) FROM dirty_orders, bounds WHERE {UNIT_PRICE} BETWEEN lo AND hi", BOUNDS
    )
    q["fix_blank_invalid_format"] = _customers(
        f"SELECT * REPLACE (CASE WHEN regexp_matches(phone, '{PHONE}') THEN phone END AS phone) FROM dirty_customers"
    )
    q["fix_blank_invalid_numbers"] = _orders(
        "SELECT * REPLACE (CASE WHEN revenue NOT IN ('pending', 'TBD') THEN revenue END AS revenue) FROM dirty_orders"
    )
    q["fix_drop_column"] = _orders("SELECT * EXCLUDE (currency) FROM dirty_orders")
    q["fix_all_in_order"] = _orders(CLEAN_STEPS.replace("EXCLUDE (currency)", "EXCLUDE (currency, lo, hi)"), BOUNDS)
    q["change_records"] = _orders(
        f"""SELECT issue_id, strategy, true AS applied, changed::BIGINT AS rows_changed, removed::BIGINT AS rows_removed,
          dropped::BIGINT AS columns_removed FROM (
        SELECT 'constant_column:currency' AS issue_id, 'drop_column' AS strategy, 0 AS changed, 0 AS removed, 1 AS dropped
        UNION ALL SELECT 'duplicate_rows:rows', 'drop_duplicates', 0, sum(k - 1), 0
          FROM (SELECT *, count(*) AS k FROM dirty_orders GROUP BY ALL)
        UNION ALL SELECT 'outliers:unit_price', 'remove_outlier_rows', 0, count(*), 0
          FROM (SELECT DISTINCT * FROM dirty_orders), bounds WHERE {UNIT_PRICE} NOT BETWEEN lo AND hi
        UNION ALL SELECT 'missing_values:discount', 'fill_median', count_if(discount = ''), 0, 0 FROM dirty_orders
        UNION ALL SELECT 'missing_values:notes', 'fill_constant', count_if(notes = ''), 0, 0 FROM dirty_orders
        UNION ALL SELECT 'mixed_types:revenue', 'coerce_numeric', count_if(revenue IN ('pending', 'TBD')), 0, 0
          FROM dirty_orders
        UNION ALL SELECT 'inconsistent_dates:order_date', 'normalize_dates',
          count_if(order_date LIKE '%/%' OR order_date LIKE '% %'), 0, 0 FROM dirty_orders)""",
        BOUNDS,
    )
    q["legal_decisions"] = _log(
        f"""SELECT run_id, issue_id, strategy, problem IS NULL AS legal, problem FROM (
        SELECT d.run_id, d.issue_id, d.strategy, CASE WHEN i.issue_type IS NULL THEN 'unknown issue'
          WHEN NOT list_contains(({MENUS})[i.issue_type], d.strategy) THEN 'not on the menu'
          WHEN d.strategy = 'fill_constant' AND d.fill_value IS NULL THEN 'value needed'
          WHEN d.strategy IN ('fill_mean', 'fill_median') AND NOT coalesce(i.numeric_text, true)
            THEN 'column holds text'
          WHEN d.strategy IN ('clip_outliers', 'remove_outlier_rows') AND i.lower_bound IS NULL
            THEN 'no range recorded' END AS problem
        FROM decision_log d LEFT JOIN issue_log i USING (run_id, issue_id))""",
        DECISION_LOG,
    )
    q["clean_customers"] = _customers(
        f"""SELECT 'before' AS phase, issue_id, n AS affected_rows FROM findings
        UNION ALL SELECT 'after', 'missing_values:' || c, n FROM (
          SELECT 'email' AS c, count_if(NOT regexp_matches(email, '{EMAIL}'))::BIGINT AS n FROM dirty_customers
          UNION ALL SELECT 'phone', count_if(NOT regexp_matches(phone, '{PHONE}'))::BIGINT FROM dirty_customers)
        WHERE 100.0 * n / (SELECT count(*) FROM dirty_customers) >= 5""",
        CASING,
        CUSTOMER_FINDINGS,
    )

    q["rule_advice"] = _log(
        "SELECT run_id, issue_id, r_strategy AS strategy, 0.6::DOUBLE AS confidence, 'rule' AS source FROM rules"
    )
    q["reply_advice"] = _log(
        f"""SELECT run_id, issue_id, ({MENUS})[issue_type][2] AS strategy, 'because of ' || detail AS reasoning,
        round((k % 101) / 100, 3) AS confidence, CAST(NULL AS VARCHAR) AS fill_value, 'llm' AS source
        FROM issue_log WHERE {GOOD_REPLY}"""
    )
    second = "SELECT * FROM issue_log WHERE j = 4"
    q["reply_errors"] = _log(
        f"""SELECT run_id, nth::INTEGER AS nth, message FROM (
        SELECT run_id, 1 AS nth, 'The reply holds no JSON array.' AS message FROM ({second}) WHERE k % 7 = 5
        UNION ALL SELECT run_id, 1, 'Unknown issue id unknown:c0' FROM ({second}) WHERE k % 7 = 2
        UNION ALL SELECT run_id, 2, 'Missing 1 ids, first ' || issue_id FROM ({second}) WHERE k % 7 IN (2, 3)
        UNION ALL SELECT run_id, 1, 'rewrite_all is not allowed for ' || issue_id FROM ({second}) WHERE k % 7 = 3
        UNION ALL SELECT run_id, 1, 'Missing 1 ids, first ' || issue_id FROM issue_log WHERE j = 8 AND k % 7 = 4)"""
    )
    q["issue_payload"] = _log(
        f"""SELECT run_id, issue_id AS id, affected_rows, evidence AS examples,
        array_to_string(({MENUS})[issue_type], '|') AS allowed FROM issue_log"""
    )
    combined = f"""combined AS (
      SELECT run_id, issue_id, CASE WHEN use THEN ({MENUS})[issue_type][2] ELSE r_strategy END AS strategy,
        CASE WHEN use THEN round((k % 101) / 100, 3) ELSE 0.6 END AS confidence,
        CASE WHEN use THEN 'llm' ELSE 'rule' END AS source, place > 2 AS by_cap, NOT use AND place <= 2 AS by_failure
      FROM (SELECT *, {GOOD_REPLY} AND place <= 2 AS use FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id
          ORDER BY ({WEIGHTS})[severity] DESC, affected_pct DESC, issue_id) AS place FROM rules)))"""
    q["combined_advice"] = _log("SELECT * FROM combined", combined)
    q["fallback_warnings"] = _log(
        """SELECT run_id, count_if(by_failure) || ' recommendations came from the built-in rules.' AS warning
        FROM combined GROUP BY run_id HAVING count_if(by_failure) > 0
        UNION ALL SELECT run_id, count_if(by_cap) || ' lower-priority issues were advised by the built-in rules.'
        FROM combined GROUP BY run_id HAVING count_if(by_cap) > 0""",
        combined,
    )
    auto = "SELECT run_id, issue_id, r_strategy <> 'none' AS approved, r_strategy AS strategy"
    q["auto_decisions"] = _log(f"{auto}, CAST(NULL AS VARCHAR) AS fill_value FROM rules")
    q["default_decisions"] = _log(
        """SELECT r.run_id, r.issue_id, coalesce(d.approved, r.r_strategy <> 'none') AS approved,
        coalesce(d.strategy, r.r_strategy) AS strategy, nullif(d.fill_value, '') AS fill_value
        FROM rules r LEFT JOIN decision_log d USING (run_id, issue_id)""",
        DECISION_LOG,
    )
    bulk = "SELECT run_id, issue_id, {} AS approved, r_strategy AS strategy FROM rules"
    q["bulk_approve_all"] = _log(bulk.format("r_strategy <> 'none'"))
    q["bulk_approve_none"] = _log(bulk.format("false"))
    q["bulk_approve_safe"] = _log(bulk.format("r_strategy NOT IN ('none', 'drop_duplicates')"))
    q["result_view"] = _log(
        """SELECT r.run_id, r.issue_id, r.r_strategy AS advised, d.strategy AS decided, d.approved AS approved,
        CASE WHEN d.approved THEN d.strategy <> 'none' END AS applied
        FROM rules r LEFT JOIN decision_log d USING (run_id, issue_id)""",
        DECISION_LOG,
    )

    q["overview_runs"] = """SELECT count(*) AS runs, sum(c_custkey % 13)::BIGINT AS issues_found,
        sum(c_custkey % 7)::BIGINT AS fixes_applied,
        round(avg(c_custkey % 10 + 0.5) FILTER (c_custkey % 6 = 4), 6)::DOUBLE AS average_score_lift FROM customer"""
    q["newest_runs"] = _with(RUN_LOG) + (
        "SELECT run_id, filename, status, created_at FROM run_log ORDER BY k DESC LIMIT 50"
    )
    q["find_run"] = _with(RUN_LOG) + "SELECT run_id, filename, status FROM run_log WHERE run_id = '77'"
    head = [
        "'# What was done to ' || filename",
        "''",
        "'- Run ' || run_id",
        "'- Begun ' || created_at",
        "'- Ended ' || CASE WHEN k % 6 > 3 THEN 'u' || created_at[2:] ELSE 'still open' END",
        "'- State: ' || status",
        "'- Advice from rules (built-in), ' || (k % 3) || ' model calls, ' || (k % 500 + k % 300) || ' tokens'",
        "''",
        "'## Before and after'",
        "''",
        "'| Measure | At first | Now |'",
        "'|---|---|---|'",
        "'| Score | ' || printf('%.1f', score_before) || ' | ' || printf('%.1f', score_after) || ' |'",
        "'| Rows | ' || format('{:,}', k * 3) || ' | ' || format('{:,}', k * 2) || ' |'",
        "'| Columns | ' || (k % 20) || ' | ' || (k % 19) || ' |'",
        "'| Issues | ' || (k % 13) || ' | ' || (SELECT count(*) FROM issue_log i WHERE i.run_id = run_log.run_id "
        "AND i.k % 2 = 0) || ' |'",
        "''",
        "'## Repairs'",
        "''",
    ]
    done = [
        "'### ' || title",
        "''",
        "'- Repair: `' || strategy || '`'",
        "'- Carried out: ' || CASE WHEN strategy <> 'none' THEN 'yes' ELSE 'no' END",
        "'- Outcome: Changed by ' || strategy",
        "'- Advised by: rule'",
        "''",
    ]
    trail = ["'## Log'", "''", "'| Time | Actor | Step | Note |'", "'|---|---|---|---|'"]
    q["audit_report"] = _log(
        f"""SELECT run_id, 0 AS part, 0::BIGINT AS "at", unnest([{", ".join(head)}]) AS line FROM run_log
        UNION ALL SELECT run_id, 1, "at"::BIGINT, unnest([{", ".join(done)}]) FROM fixed
        UNION ALL SELECT run_id, 1, 0, unnest(['_Nothing was repaired._', '']) FROM run_log
          WHERE run_id NOT IN (SELECT run_id FROM fixed)
        UNION ALL SELECT run_id, 2, 0, unnest([{", ".join(trail)}]) FROM run_log
        UNION ALL SELECT CAST(user_id AS VARCHAR), 3, event_id, '| e' || lpad(CAST(event_id AS VARCHAR), 12, '0') || ' | '
          || (['system', 'detector', 'ai', 'human'])[event_id % 4 + 1] || ' | ' || event_type || ' | a\\|b ' || props || ' |'
          FROM events WHERE user_id IN (SELECT k FROM run_log)""",
        DECISION_LOG,
        RUN_LOG,
        f"""fixed AS (SELECT d.run_id, i.title, d.strategy, list_position({KINDS}, i.issue_type) AS "at"
          FROM decision_log d JOIN issue_log i USING (run_id, issue_id)
          WHERE d.approved AND d.run_id IN (SELECT run_id FROM run_log))""",
    )
    return q
