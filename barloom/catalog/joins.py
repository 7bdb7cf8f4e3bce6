"""Joins over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.model_sql import BARS, CHANGES, HOLDINGS, MASTER, RATIOS, YEARS, sql
from barloom.catalog.registry import query
from barloom.functions.values import rnd, slug
from barloom.operators import joins as J
from barloom.operators import market as M
from barloom.operators import windows as W
from barloom.sources import market as S
from barloom.sources.market import bars, table


def _members(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("P"), k).alias("symbol"), F.when(k % 6 != 0, F.concat(F.lit("IN"), F.lpad(k.cast("string"), 10, "0"))).alias("isin"), F.col("p_name").alias("name"))


def _served(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").where(k % 4 != 0).select(F.concat(F.lit("P"), k).alias("symbol"), F.concat(F.lit("IN"), F.lpad(F.when(k % 10 == 0, k + 1).otherwise(k).cast("string"), 10, "0")).alias("isin"),
                                                            F.when(k % 3 != 0, F.upper("p_name")).alias("name"))


MEMBERS = """
members AS (SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 6 <> 0 THEN 'IN' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS isin, p_name AS name FROM part),
served AS (SELECT 'P' || p_partkey AS symbol, 'IN' || lpad(CAST(CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 ELSE p_partkey END AS VARCHAR), 10, '0') AS isin, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_name) END AS name FROM part WHERE p_partkey % 4 <> 0),
matched AS (SELECT m.symbol, s.isin AS sisin, coalesce(s.name, m.name) AS sname, CASE WHEN s.symbol IS NULL THEN 'not_in_instruments' WHEN m.isin <> s.isin THEN 'isin_differs' END AS reason FROM members m LEFT JOIN served s USING (symbol))"""


@query("join_universe_match", sql("SELECT symbol, CASE WHEN reason IS NULL THEN sisin END AS isin, CASE WHEN reason IS NULL THEN sname END AS name, reason FROM matched", MEMBERS))
def _(spark, d):
    return J.universe_match(_members(spark, d), _served(spark, d))


@query("join_exclude", sql("SELECT symbol, isin FROM served WHERE symbol NOT IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_quantity >= 49)", MEMBERS))
def _(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("P"), "l_partkey").alias("symbol"))
    return J.exclude(_served(spark, d), gone).select("symbol", "isin")


def master(spark, d):
    return S.sector_master(spark, d).withColumn("sector_key", slug("sector_source_label"))


BUCKETED = CHANGES + "," + MASTER + """,
bucketed AS (SELECT l.*, m.sector_source_label, m.last_confirmed, lower(replace(m.sector_source_label, '_', '-')) AS sector_key, CASE WHEN m.symbol IS NULL THEN 'not_in_master' WHEN instrument_class = 'etf' THEN 'etf'
  WHEN instrument_class <> 'operating_equity' THEN 'unclassified' WHEN sector_source_label IS NULL THEN 'operating_missing_sector' ELSE 'in_sector' END AS bucket FROM latest l LEFT JOIN master m ON l.symbol = m.symbol)"""


def sector_rows(spark, d):
    return J.sector_bucketed(M.latest_rows(W.change_1d(bars(spark, d))), master(spark, d))


@query("join_sector_reconcile", sql("SELECT bucket, count(*) AS n FROM bucketed GROUP BY 1", BUCKETED))
def _(spark, d):
    return sector_rows(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("join_relative_strength", sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, round(close / first_value(close) OVER w / (bc / first_value(bc) OVER w) * 100, 6) AS rs FROM
 (SELECT b.symbol, b.date, b.close, s.close AS bc FROM bars b JOIN benchmark_series s ON b.date = s.date) WINDOW w AS (PARTITION BY symbol ORDER BY date)""", BARS))
def _(spark, d):
    return J.relative_strength(bars(spark, d), S.benchmark(spark, d)).select("symbol", "date", rnd("rs", 6).alias("rs"))


def _asof_sql():
    parts = ", ".join(f"arg_max(close, date) FILTER (date <= last - to_months({m})) AS b{k}" for k, m in J.RETURN_MONTHS.items())
    outs = ", ".join(f"round((close / b{k} - 1) * 100, 6) AS ret_{k.lower()}" for k in J.RETURN_MONTHS)
    return sql(f"""SELECT symbol, CAST(as_of AS VARCHAR) AS as_of, close, {outs} FROM (SELECT symbol, max(last) AS as_of, arg_max(close, date) AS close, {parts}
      FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM bars) GROUP BY symbol)""", BARS)


@query("asof_return", _asof_sql())
def _(spark, d):
    r = J.asof_return(bars(spark, d))
    return r.select("symbol", "as_of", "close", *[rnd(c, 6).alias(c) for c in r.columns if c.startswith("ret_")])


def _perf_cte(name, source):
    hits = ", ".join(f"max(date) FILTER (date <= last - {n}) AS on_{k}, arg_max(close, date) FILTER (date <= last - {n}) AS base_{k}" for k, n in J.PERF_DAYS.items())
    outs = ", ".join(f"CASE WHEN (as_of - {n}) - on_{k} <= 7 THEN (close / base_{k} - 1) * 100 END AS {k}" for k, n in J.PERF_DAYS.items())
    return f"""{name} AS (SELECT symbol, as_of, close, CASE WHEN as_of - prev_on <= 7 THEN (close / prev - 1) * 100 END AS d1, {outs} FROM (SELECT symbol, max(last) AS as_of, arg_max(close, date) AS close,
      max(date) FILTER (date < last) AS prev_on, arg_max(close, date) FILTER (date < last) AS prev, {hits}, count(*) AS n FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM {source}) GROUP BY symbol) WHERE n >= 2)"""


PERF_COLS = ("d1", "w1", "d30", "d90")


@query("asof_window_perf", sql("SELECT symbol, CAST(as_of AS VARCHAR) AS as_of, close, " + ", ".join(f"round({c}, 6) AS {c}" for c in PERF_COLS) + " FROM perf", BARS, _perf_cte("perf", "bars")))
def _(spark, d):
    return J.asof_window_perf(bars(spark, d)).select("symbol", "as_of", "close", *[rnd(c, 6).alias(c) for c in PERF_COLS])


@query("join_relative_perf", sql("SELECT p.symbol, " + ", ".join(f"round(p.{c} - b.{c}, 6) AS rel_{c}" for c in PERF_COLS) + " FROM perf p, bench_perf b", BARS, _perf_cte("perf", "bars"),
                                 _perf_cte("bench_perf", "(SELECT 'BENCH' AS symbol, date, close FROM benchmark_series)")))
def _(spark, d):
    bench = J.asof_window_perf(S.benchmark(spark, d).withColumn("symbol", F.lit("BENCH")))
    return J.relative_perf(J.asof_window_perf(bars(spark, d)), bench).select("symbol", *[rnd(f"rel_{c}", 6).alias(f"rel_{c}") for c in PERF_COLS])


def _days(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where(F.unix_date("date") % 11 != 0)


def _holidays(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where((F.day("date") == 26) & (F.month("date") == 1)).distinct()


GAPS = """
file_days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE (CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 11 <> 0),
holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) = 26 AND month(o_orderdate) = 1),
gaps AS (SELECT date FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM file_days), (SELECT max(date) FROM file_days), INTERVAL 1 DAY)) AS DATE) AS date)
  WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM file_days) AND date NOT IN (SELECT date FROM holidays))"""


@query("join_calendar_gaps", sql("SELECT CAST(date AS VARCHAR) AS date FROM gaps", GAPS))
def _(spark, d):
    return J.calendar_gaps(_days(spark, d), _holidays(spark, d))


@query("join_gap_evidence", sql("""SELECT placed, count(*) AS n FROM (SELECT CASE WHEN date IN (SELECT date FROM holidays) THEN 'known_holiday' WHEN date IN (SELECT date FROM file_days) THEN 'has_a_valid_file'
 WHEN date NOT IN (SELECT date FROM gaps) THEN 'outside_loaded_range' ELSE 'gap' END AS placed FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem)) GROUP BY 1""", GAPS))
def _(spark, d):
    days, hol = _days(spark, d), _holidays(spark, d)
    rec = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return J.gap_evidence(rec, days, hol, J.calendar_gaps(days, hol)).groupBy("placed").agg(F.sum("n").alias("n"))


@query("join_xbrl_pairs", """SELECT 'in:Details' || o_orderpriority || 'Axis' AS axis, 'H' || o_custkey AS member, CAST(year(o_orderdate) AS VARCHAR) AS period, 'Holder ' || o_custkey AS holder_name,
 CAST(min(o_orderkey) AS VARCHAR) AS shares, NULL::VARCHAR AS pct, count(DISTINCT o_orderkey) > 1 AS conflict FROM orders GROUP BY o_orderpriority, o_custkey, year(o_orderdate)""")
def _(spark, d):
    o = table(spark, d, "orders")
    f = o.select(F.concat(F.lit("in:Details"), "o_orderpriority", F.lit("Axis")).alias("axis"), F.concat(F.lit("H"), "o_custkey").alias("member"), F.year("o_orderdate").cast("string").alias("period"),
                 F.inline(F.array(F.struct(F.lit("NameOfTheShareholder").alias("name"), F.concat(F.lit("Holder "), "o_custkey").alias("text")),
                                  F.struct(F.lit("NumberOfFullyPaidUpEquityShares").alias("name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("text")))))
    return J.xbrl_pairs(f).withColumn("shares", F.col("shares").cast("bigint").cast("string"))


def _ledger(spark, d):
    return S.year_values(spark, d).select("symbol", F.make_date("fy", F.lit(12), F.lit(31)).alias("period_end"), F.when(F.col("symbol") % 3 == 0, "standalone").otherwise("consolidated").alias("basis"),
                                          F.col("value").alias("revenue"), F.col("lines").cast("double").alias("profit"))


@query("join_cross_source", sql("""SELECT * FROM (SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, basis, 'value_difference' AS type, 'revenue' AS field, revenue AS ledger, revenue + 1 AS published FROM led WHERE symbol % 5 = 0 AND symbol % 8 <> 0
 UNION ALL SELECT symbol, CAST(period_end AS VARCHAR), 'other', 'no_common_period', NULL, NULL, NULL FROM led WHERE symbol % 8 = 0)""", YEARS, "led AS (SELECT symbol, make_date(fy, 12, 31) AS period_end, CASE WHEN symbol % 3 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis, value AS revenue FROM years)"))
def _(spark, d):
    led, s = _ledger(spark, d), F.col("symbol")
    pub = led.withColumns({"basis": F.when(s % 8 == 0, "other").otherwise(F.col("basis")), "revenue": F.when(s % 5 == 0, F.col("revenue") + 1).otherwise(F.col("revenue") + 0.001)})
    return J.cross_source(led, pub, ["revenue", "profit"])


def shares_pct(h):
    total = h.groupBy("symbol", "period_end").agg(F.sum(F.col("shares").cast("decimal(18,2)")).cast("double").alias("total"))
    return h.join(total, ["symbol", "period_end"]).withColumn("pct", F.col("shares") / F.col("total") * 100)


@query("join_category_check", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, round(max(abs(pct - pb)), 6) AS max_diff, count(*) AS categories, CASE WHEN max(abs(pct - pb)) <= 0.05 THEN 'match' ELSE 'differs' END AS verdict FROM
 (SELECT *, pct + CASE WHEN symbol % 4 = 0 AND category = 'fii' THEN 0.25::DOUBLE ELSE 0.01::DOUBLE END AS pb FROM pcts) GROUP BY symbol, period_end""", HOLDINGS,
 "pcts AS (SELECT *, shares / (CAST(sum(CAST(shares AS DECIMAL(18,2))) OVER (PARTITION BY symbol, period_end) AS DOUBLE)) * 100 AS pct FROM holdings)"))
def _(spark, d):
    a = shares_pct(S.holdings(spark, d))
    b = a.withColumn("pct", F.col("pct") + F.when((F.col("symbol") % 4 == 0) & (F.col("category") == "fii"), 0.25).otherwise(0.01))
    return J.category_check(a, b).withColumn("max_diff", rnd("max_diff", 6))


@query("join_isin_check", sql("""SELECT symbol, record_isin, CASE WHEN uni IS NULL THEN 'canonical_unavailable' WHEN listed > 1 THEN 'ambiguous_listed_twice' WHEN dir <> uni THEN 'ambiguous_directory_disagrees' WHEN record_isin IS NULL THEN 'record_has_no_isin'
  WHEN record_isin <> uni THEN 'differs' ELSE 'matched' END AS verdict FROM (SELECT m.symbol, m.isin AS record_isin, s.isin AS uni, g.listed, g.dir FROM members m LEFT JOIN served s USING (symbol)
  LEFT JOIN (SELECT 'P' || l_partkey AS symbol, 2 AS listed, min('IN' || lpad(CAST(l_partkey AS VARCHAR), 10, '0')) AS dir FROM lineitem WHERE l_quantity = 50 GROUP BY 1 UNION ALL
   SELECT 'P' || p_partkey, 1, 'IN' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) g USING (symbol))""", MEMBERS))
def _(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.concat(F.lit("IN"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isin"))
    again = table(spark, d, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("P"), "l_partkey").alias("symbol"), F.concat(F.lit("IN"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("isin")).distinct()
    return J.isin_check(_members(spark, d).select("symbol", "isin"), _served(spark, d), own.unionByName(again))


@query("join_observations", sql("""SELECT s_suppkey AS symbol, coalesce(fl, pl) AS label, fl IS NOT NULL AS answered, s_suppkey % 3 = 0 AS attempted, CASE WHEN fund AND coalesce(fl, pl) IS NOT NULL THEN 'unclassified' WHEN fund THEN 'etf'
 WHEN coalesce(fl, pl) IS NOT NULL THEN 'operating_equity' ELSE 'unclassified' END AS instrument_class FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN n_name END AS fl, CASE WHEN s_suppkey % 5 = 0 THEN 'old ' || n_name END AS pl, s_suppkey % 13 = 12 AS fund
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""))
def _(spark, d):
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    s = s.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))            # fixed list of countries
    fetched = s.where(k % 3 == 0).select(k.alias("symbol"), F.when(k % 4 != 0, F.col("n_name")).alias("label"))
    prev = s.where(k % 5 == 0).select(k.alias("symbol"), F.concat(F.lit("old "), "n_name").alias("label"))
    return J.observations(s.select(k.alias("symbol")), fetched, prev, s.where(k % 13 == 12).select(k.alias("symbol")))


@query("batch_drift", """SELECT *, removed <= previous * 0.1 AS drop_ok, added <= previous * 0.25 AS growth_ok FROM (SELECT count(*) FILTER (p_partkey % 20 <> 19) AS previous, count(*) FILTER (p_partkey % 15 <> 14) AS current,
 count(*) FILTER (p_partkey % 20 <> 19 AND p_partkey % 15 = 14) AS removed, count(*) FILTER (p_partkey % 20 = 19 AND p_partkey % 15 <> 14) AS added, count(*) FILTER (p_partkey % 20 <> 19 AND p_partkey % 15 <> 14 AND p_partkey % 33 = 0) AS renamed FROM part)""")
def _(spark, d):
    k = F.col("p_partkey")
    old = table(spark, d, "part").where(k % 20 != 19).select(k.alias("isin"), F.col("p_name").alias("symbol"))
    new = table(spark, d, "part").where(k % 15 != 14).select(k.alias("isin"), F.when(k % 33 == 0, F.concat("p_name", F.lit("X"))).otherwise(F.col("p_name")).alias("symbol"))
    return J.drift(old, new)


@query("compare_stocks", sql("""SELECT metric, max(v) FILTER (slot = 1) AS "1", max(v) FILTER (slot = 2) AS "2", max(v) FILTER (slot = 3) AS "3", max(v) FILTER (slot = 4) AS "4", max(v) FILTER (slot = 5) AS "5" FROM (SELECT slot, metric, v FROM (SELECT s.slot, r.roe, r.roce, r.pe, (r.symbol IS NOT NULL)::INT::DOUBLE AS known FROM
 (SELECT * FROM (SELECT (SELECT min(c_custkey) FROM customer) AS symbol, 1 AS slot UNION ALL SELECT (SELECT max(c_custkey) FROM customer), 2 UNION ALL SELECT -1, 3 UNION ALL SELECT (SELECT min(c_custkey) + 1 FROM customer), 4 UNION ALL SELECT (SELECT max(c_custkey) - 1 FROM customer), 5)) s LEFT JOIN ratios r ON r.symbol = s.symbol),
 LATERAL (VALUES ('roe', roe), ('roce', roce), ('pe', pe), ('known', known)) t(metric, v)) GROUP BY metric""", RATIOS))
def _(spark, d):
    ends = table(spark, d, "customer").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"))
    chosen = ends.select(F.inline(F.array(*[F.struct(c.cast("bigint").alias("symbol"), F.lit(i).alias("slot")) for i, c in ((1, F.col("a")), (2, F.col("b")), (3, F.lit(-1)), (4, F.col("a") + 1), (5, F.col("b") - 1))])))
    return J.compare_symbols(S.ratios(spark, d), F.broadcast(chosen), ["roe", "roce", "pe"])     # five rows
