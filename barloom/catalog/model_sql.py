"""The data model of `sources.market` stated as SQL common table expressions, for the side-by-side check."""

BARS = """
day AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, sum(l_quantity) AS qty,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS delivered
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
lagged AS (SELECT *, lag(value / qty) OVER (PARTITION BY symbol ORDER BY date) AS before FROM day),
bars AS (SELECT symbol, date, (high + low) / 2 AS open, high, low, value / qty AS close,
  CASE WHEN (symbol * 7 + (date - DATE '1970-01-01')) % 997 = 0 THEN before / 2 ELSE before END AS prev_close,
  CAST(qty AS BIGINT) AS volume, value / 400.0 AS turnover, 100 * delivered / qty AS deliv FROM lagged),
benchmark_series AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1)"""

CHANGES = BARS + """,
moved AS (SELECT *, CASE WHEN prev_close > 0 AND close > 0 AND (close - prev_close) / prev_close * 100 >= -100
    THEN round(close - prev_close, 2) END AS change,
  CASE WHEN prev_close > 0 AND close > 0 AND (close - prev_close) / prev_close * 100 >= -100
    THEN round((close - prev_close) / prev_close * 100, 2) END AS change_pct FROM bars),
latest AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""

MASTER = """
master AS (SELECT s_suppkey AS symbol, s_name AS company_name,
  CASE WHEN s_suppkey % 13 = 12 THEN 'etf' WHEN s_suppkey % 11 = 10 THEN 'unclassified' ELSE 'operating_equity' END AS instrument_class,
  CASE WHEN s_suppkey % 9 <> 8 THEN n_name END AS sector_source_label, r_name AS sector_group,
  DATE '2001-11-04' - CAST(s_suppkey % 63 AS INTEGER) AS last_confirmed
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 17 <> 16)"""

RATIOS = """
per_symbol AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v,
  max(CAST(o_orderdate AS DATE)) AS fetched FROM orders GROUP BY 1),
unit AS (SELECT c.*, fetched, v / (n * 10000) AS u FROM customer c LEFT JOIN per_symbol ON c_custkey = o_custkey),
ratios AS (SELECT c_custkey AS symbol, c_name AS company_name, CASE WHEN c_custkey % 5 <> 4 THEN c_mktsegment END AS sector,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 4 = 1 THEN -u ELSE u END AS pe,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 6 = 5 THEN -u / 10 ELSE u / 10 END AS pb,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal / 200 END AS roe, c_acctbal / 300 AS roce,
  CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 500 END AS roa, CASE WHEN c_custkey % 19 = 0 THEN 0.0::DOUBLE ELSE u / 2 END AS ev_ebitda, fetched FROM unit)"""

TICKS = """
ticks AS (SELECT user_id AS key, event_id AS seq, (epoch_us(ts) // 1000) AS recv_ms,
  CASE WHEN event_id % 41 = 0 THEN -1.0 ELSE (100 + value) * (CASE WHEN event_id % 31 = 0 THEN 1.5 ELSE 1.0 END)::DOUBLE END AS ltp,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN (epoch_us(ts) // 1000) + 120000 WHEN event_id % 37 = 0 THEN (epoch_us(ts) // 1000) - 86400000
    ELSE (epoch_us(ts) // 1000) - 500 END AS ltt,
  CASE WHEN event_id % 3 <> 0 THEN CAST(100 + user_id % 20 AS DOUBLE) END AS cp, (epoch_us(ts) // 1000) // 28800000 AS connection_id,
  CAST(ts + INTERVAL 330 MINUTE AS DATE) AS session_date FROM events)"""

YEARS = """
years AS (SELECT o_custkey AS symbol, year(o_orderdate) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
  count(*) AS lines, max(CAST(o_orderdate AS DATE)) AS fetched FROM orders GROUP BY 1, 2)"""

QUARTERS = """
quarters AS (SELECT o_custkey AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS profit FROM orders GROUP BY 1, 2),
nation_quarters AS (SELECT c_nationkey AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS profit
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

HOLDINGS = """
holdings AS (SELECT o_custkey AS symbol, make_date(year(o_orderdate), 12, 31) AS period_end,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'promoters' WHEN '2-HIGH' THEN 'fii' WHEN '3-MEDIUM' THEN 'other_dii'
    WHEN '4-NOT SPECIFIED' THEN 'mutual_funds' WHEN '5-LOW' THEN 'retail_other' END AS category,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS shares FROM orders GROUP BY 1, 2, 3)"""

INSTRUMENTS = """
instruments AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 19 = 0 THEN 'BSE_EQ' ELSE 'NSE_EQ' END AS segment,
  CASE WHEN p_partkey % 101 <> 0 THEN 'NSE_EQ|' || (CASE WHEN p_partkey % 67 = 0 THEN p_partkey - 1 ELSE p_partkey END) END AS instrument_key,
  CASE WHEN p_partkey % 7 = 0 THEN upper(replace(p_name, ' ', '-')) WHEN p_partkey % 53 = 0 THEN 'bad sym ' || p_partkey
    ELSE upper(substr(p_type, 1, 3)) || p_partkey END AS trading_symbol,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'XX' || p_partkey
    ELSE 'INE' || lpad(CAST(CASE WHEN p_partkey % 43 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 9, '0') END AS isin,
  CASE WHEN p_partkey % 23 = 0 THEN 'PCA' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'NORMAL' END AS security_type,
  CASE WHEN p_partkey % 3 = 2 THEN 'BE' ELSE 'EQ' END AS instrument_type,
  CASE WHEN p_partkey % 37 = 0 THEN p_name || ' ETF' ELSE p_name END AS name, p_brand AS brand, p_type AS type FROM part)"""


def half_even(text: str) -> str:
    """Spell every round(x[, n]) out as half-even on the scaled value: engines differ in how they break ties."""
    out, rest = "", text
    while "round(" in rest:
        head, rest = rest.split("round(", 1)
        depth, args, start, i = 1, [], 0, 0
        while depth:
            ch = rest[i]
            depth += (ch == "(") - (ch == ")")
            if (ch == "," and depth == 1) or depth == 0:
                args.append(rest[start:i].strip())
                start = i + 1
            i += 1
        rest = rest[i:]
        scale = f"{10 ** int(args[1]) if len(args) > 1 else 1}::DOUBLE"
        x = f"(({half_even(args[0])}) * {scale})"
        out += f"{head}(CASE WHEN abs({x} - trunc({x})) = 0.5 THEN 2 * Round({x} / 2) ELSE Round({x}) END / {scale})"
    return out + rest


def sql(body: str, *models: str) -> str:
    text = "WITH " + ",\n".join(m.strip() for m in models) + "\n" + body.strip() if models else body.strip()
    return half_even(text).replace("Round(", "round(")
