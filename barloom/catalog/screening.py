"""Screener, search, coverage and work lists over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.joins import _perf_cte
from barloom.catalog.model_sql import BARS, QUARTERS, RATIOS, YEARS, sql
from barloom.catalog.registry import query
from barloom.functions import values as V
from barloom.functions.values import rnd
from barloom.operators import coverage as C
from barloom.operators import joins as J
from barloom.operators import screen as X
from barloom.sources import market as S
from barloom.sources.market import bars, table

NOT_COMPARABLE = "(coalesce(pb < 0, false) OR coalesce(pe < 0 AND roe > 0, false))"


def today():
    return F.lit("2001-08-05").cast("date")


@query("screen_filter", sql(f"SELECT symbol, pe, pb, roe FROM ratios WHERE pe > 0 AND pe BETWEEN 10 AND 30 AND pb > 0 AND roe >= 10 AND NOT {NOT_COMPARABLE} AND sector = 'BUILDING' UNION ALL SELECT symbol, pe, pb, roe FROM ratios WHERE pe < 0", RATIOS))
def _(spark, d):
    r = S.ratios(spark, d)
    a = X.screen_filter(r, pe=(10, 30), pb_mode="positive", min_roe=10, sector="BUILDING")
    return a.unionByName(X.screen_filter(r, pe=(None, 5), pe_mode="negative")).select("symbol", "pe", "pb", "roe")


@query("roe_not_comparable", sql(f"SELECT symbol, {NOT_COMPARABLE} AS flag FROM ratios", RATIOS))
def _(spark, d):
    return S.ratios(spark, d).select("symbol", X.roe_not_comparable().alias("flag"))


@query("column_coverage_gate", sql("SELECT symbol, sector, NULL::DOUBLE AS roa FROM ratios", RATIOS))
def _(spark, d):
    r = S.ratios(spark, d).select("symbol", "sector", "roa")
    return X.column_coverage_gate(X.column_coverage_gate(r, "sector"), "roa")


@query("section_status", sql("""SELECT symbol, CASE WHEN fetched IS NOT NULL AND pe IS NOT NULL THEN 'last updated ' || fetched WHEN fetched IS NOT NULL THEN 'not returned by the source' WHEN symbol % 6 = 0 THEN 'not in the source list' WHEN symbol % 4 = 0 THEN 'last request failed' ELSE 'not yet fetched' END AS status FROM ratios""", RATIOS))
def _(spark, d):
    s = F.col("symbol")
    return S.ratios(spark, d).select("symbol", X.section_status(s % 6 != 0, F.col("fetched"), F.when(s % 4 == 0, "HTTP 500"), F.col("pe")).alias("status"))


@query("publish_rows_with_hold", sql("SELECT symbol, symbol % 10 = 3 AS held, CASE WHEN symbol % 10 = 3 THEN pe - 1 ELSE pe END AS pe, CASE WHEN symbol % 10 = 3 THEN roe - 1 ELSE roe END AS roe FROM ratios", RATIOS))
def _(spark, d):
    now = S.ratios(spark, d).select("symbol", "pe", "roe")
    before = now.select("symbol", (F.col("pe") - 1).alias("pe"), (F.col("roe") - 1).alias("roe"))
    return X.publish_rows_with_hold(now, before, table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("symbol")), ["pe", "roe"])


@query("zero_multiple_is_null", sql("SELECT symbol, nullif(pe, 0) AS pe, nullif(pb, 0) AS pb, nullif(ev_ebitda, 0) AS ev_ebitda, roe FROM ratios", RATIOS))
def _(spark, d):
    return X.zero_multiple_is_null(S.ratios(spark, d)).select("symbol", "pe", "pb", "ev_ebitda", "roe")


TIER = "CASE WHEN pe > 0 THEN 0 WHEN pe < 0 THEN 1 ELSE 2 END"


@query("screen_sort", sql(f"SELECT symbol, pe, row_number() OVER (ORDER BY {TIER}, CASE WHEN {TIER} = 2 THEN 0 ELSE -pe END, symbol) AS position FROM ratios", RATIOS))
def _(spark, d):
    return X.screen_sort(S.ratios(spark, d).select("symbol", "pe"), "pe", descending=True)


@query("stalest_first", sql("SELECT symbol, CAST(fetched AS VARCHAR) AS fetched, row_number() OVER (ORDER BY coalesce(CAST(fetched AS VARCHAR), ''), symbol) AS position FROM ratios", RATIOS))
def _(spark, d):
    return X.stalest_first(S.ratios(spark, d).select("symbol", "fetched"), "fetched")


def _search_sql(q):
    w = q.split()
    return f"""SELECT '{q}' AS q, symbol, tier, rank FROM (SELECT *, row_number() OVER (ORDER BY tier, symbol) AS rank FROM (SELECT symbol, CASE WHEN s = '{q}' OR replace(s, ' ', '') = '{q.replace(' ', '')}' THEN 1 WHEN n = '{q}' THEN 2 WHEN starts_with(s, '{q}') THEN 3 WHEN starts_with(n, '{q}') THEN 4
     WHEN contains(n, ' {q}') THEN 5 WHEN contains(s, '{q}') THEN 6 WHEN contains(n, '{q}') THEN 7 WHEN {len(w)} > 1 AND {' AND '.join(f"contains(n, '{x}')" for x in w)} THEN 8 END AS tier FROM
     (SELECT upper(substr(p_type, 1, 3)) || '-' || p_partkey AS symbol, lower(substr(p_type, 1, 3)) || ' ' || p_partkey AS s, p_name AS n FROM part)) WHERE tier IS NOT NULL) WHERE rank <= 50"""


QUERIES_TO_TRY = ("red", "widget red", "eco 17", "ring", "in")


@query("search_symbols", " UNION ALL ".join(_search_sql(q) for q in QUERIES_TO_TRY))
def _(spark, d):
    p = table(spark, d, "part").select(F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), "p_partkey").alias("symbol"), F.initcap("p_name").alias("company_name"))
    out = None
    for q in QUERIES_TO_TRY:
        one = X.search_symbols(p, q.upper()).select(F.lit(q).alias("q"), "symbol", "tier", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("join_stock360", sql("""SELECT c.c_custkey AS symbol, c_name AS company_name, p.as_of AS price_as_of, p.close AS price_close, round(p.w1, 6) AS price_w1, r.pe AS ratios_pe, r.roe AS ratios_roe, y.fy AS annual_fy, y.value AS annual_value FROM customer c LEFT JOIN (SELECT * REPLACE (CAST(as_of AS VARCHAR) AS as_of) FROM perf) p ON p.symbol = c_custkey
 LEFT JOIN ratios r ON r.symbol = c_custkey LEFT JOIN (SELECT * FROM years QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) = 1) y ON y.symbol = c_custkey""", BARS, _perf_cte("perf", "bars"), RATIOS, YEARS))
def _(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("company_name"))
    price = J.asof_window_perf(bars(spark, d)).select("symbol", "as_of", "close", rnd("w1", 6).alias("w1"))
    y = S.year_values(spark, d).groupBy("symbol").agg(F.max("fy").alias("fy"), F.max_by("value", "fy").alias("value"))
    return X.stock360(base, {"price": price, "ratios": S.ratios(spark, d).select("symbol", "pe", "roe"), "annual": y})


@query("checklist_status", sql("""SELECT symbol, CASE WHEN pe IS NULL THEN 'Unavailable' WHEN symbol % 10 = 0 OR pb < 0 THEN 'Needs review' WHEN roe IS NULL THEN 'Data insufficient' ELSE 'Available' END AS status FROM ratios""", RATIOS))
def _(spark, d):
    return S.ratios(spark, d).select("symbol", X.checklist_status(F.col("pe"), F.col("symbol") % 10 == 0, F.coalesce(F.col("pb") < 0, F.lit(False)), F.col("roe").isNotNull()).alias("status"))


# ---------------------------------------------------------------- coverage
def classed(spark, d, age, module):
    s = F.col("symbol")
    r = S.ratios(spark, d)
    k = C.state_class(F.col("fetched"), F.when(s % 21 == 0, "bad"), today(), age, unverified=s % 34 == 0)
    return r.select(F.lit(module).alias("module"), "symbol", F.when(s % 25 == 24, "not_applicable").otherwise(k).alias("class"))


def _class_sql(age, module):
    return f"""SELECT '{module}' AS module, CASE WHEN symbol % 25 = 24 THEN 'not_applicable' WHEN fetched IS NULL THEN 'missing' WHEN symbol % 21 = 0 OR DATE '2001-08-05' < fetched THEN 'invalid' WHEN symbol % 34 = 0 THEN 'unverified' WHEN DATE '2001-08-05' - fetched > {age} THEN 'stale' ELSE 'valid' END AS class FROM ratios"""


def _module_sql(source):
    n = lambda c: f"count(*) FILTER (class = '{c}')"
    return f"""SELECT module, count(*) AS denominator, {', '.join(f'{n(c)} AS {c}' for c in C.CLASSES)}, round(100.0::DOUBLE * ({n('valid')} + {n('stale')}) / count(*), 2) AS coverage_pct, round(100.0::DOUBLE * ({n('valid')} + {n('stale')}) / nullif(count(*) - {n('not_applicable')}, 0), 2) AS coverage_pct_of_applicable,
     round(100.0::DOUBLE * {n('valid')} / count(*), 2) AS fresh_pct, true AS adds_up FROM ({source}) GROUP BY 1"""


@query("coverage_module", sql(_module_sql(_class_sql(200, "fundamentals")), RATIOS))
def _(spark, d):
    return C.coverage_module(classed(spark, d, 200, "fundamentals"))


STATES = (("fundamentals_state", 7), ("quarterly_state", 30), ("financials_state", 30))
for _name, _age in STATES:
    @query(f"cov_{_name}", sql(_module_sql(_class_sql(_age, _name)), RATIOS))
    def _(spark, d, name=_name, age=_age):
        return C.coverage_module(classed(spark, d, age, name))


@query("cell_counter", sql(" UNION ALL ".join(f"SELECT '{m}' AS field, count({m}) AS present, count(*) - count({m}) AS \"null\", count(*) FILTER ({m} = 0) AS zero FROM ratios" for m in ("pe", "pb", "roe", "roce", "roa", "ev_ebitda")), RATIOS))
def _(spark, d):
    return C.cell_counter(S.ratios(spark, d), ["pe", "pb", "roe", "roce", "roa", "ev_ebitda"])


@query("stats_min_med_max", "SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def _(spark, d):
    return C.stats_min_med_max(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag")


@query("age_buckets", sql("SELECT bucket, count(*) AS stocks FROM (SELECT CASE WHEN fetched IS NULL OR DATE '2001-08-05' < fetched THEN NULL WHEN DATE '2001-08-05' - fetched <= 6 THEN '0-6' WHEN DATE '2001-08-05' - fetched <= 13 THEN '7-13' WHEN DATE '2001-08-05' - fetched <= 29 THEN '14-29' ELSE '30+' END AS bucket FROM ratios) GROUP BY 1", RATIOS))
def _(spark, d):
    return S.ratios(spark, d).groupBy(C.age_bucket(F.datediff(today(), "fetched")).alias("bucket")).agg(F.count(F.lit(1)).alias("stocks"))


METRICS = ("pe", "pb", "roe", "roce", "roa", "ev_ebitda")


def _fc_sql():
    filled = " + ".join(f"({m} IS NOT NULL)::INT" for m in METRICS)
    kind = "CASE WHEN p AND symbol % 8 = 0 THEN 'published_not_listed' WHEN p THEN 'published_listed' WHEN symbol % 9 = 0 THEN 'held_isin_change' WHEN symbol % 8 = 0 THEN 'not_in_source' WHEN symbol % 7 = 0 THEN 'invalid' WHEN symbol % 5 = 0 THEN 'failed' ELSE 'not_yet_fetched' END"
    names = ("published_listed", "published_not_listed", "held_isin_change", "not_in_source", "invalid", "failed", "not_yet_fetched")
    return sql(f"""SELECT count(*) AS universe, count(*) FILTER (p AND f = 6) AS complete, count(*) FILTER (p AND f BETWEEN 1 AND 5) AS partial, count(*) FILTER (p AND f = 0) AS none, {', '.join(f'count(*) FILTER (p AND {m} IS NOT NULL) AS has_{m}' for m in METRICS)},
      {', '.join(f"count(*) FILTER (k = '{n}') AS {n}" for n in names)} FROM (SELECT *, {filled} AS f, {kind} AS k FROM (SELECT *, fetched IS NOT NULL AND symbol % 4 <> 0 AS p FROM ratios))""", RATIOS)


@query("fundamentals_coverage", _fc_sql())
def _(spark, d):
    s = F.col("symbol")
    r = S.ratios(spark, d).withColumns({"published": F.col("fetched").isNotNull() & (s % 4 != 0), "listed": s % 8 != 0, "held": s % 9 == 0, "invalid": s % 7 == 0, "error": F.when(s % 5 == 0, "x")})
    return C.fundamentals_coverage(r, METRICS)


@query("quarterly_coverage", sql("SELECT CAST(latest AS VARCHAR) AS latest, count(*) AS stocks FROM (SELECT symbol, max(quarter_end) AS latest FROM quarters GROUP BY 1) GROUP BY 1", QUARTERS))
def _(spark, d):
    return C.quarterly_coverage(S.quarter_values(spark, d))


@query("run_tally_status", "SELECT CAST(day AS VARCHAR) AS day, done, failed, CASE WHEN done = 0 AND failed > 0 THEN 'failed' WHEN failed > 0 OR pending > 3 THEN 'incomplete' ELSE 'complete' END AS status FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS failed, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY 1)")
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)).alias("failed"),
                                                                                    F.count_if(F.col("o_orderstatus") == "O").alias("pending"))
    return t.select("day", "done", "failed", C.run_tally_status(F.col("done"), F.col("failed"), F.greatest(F.col("pending") - 3, F.lit(0))).alias("status"))


@query("flow_latest", """SELECT CAST(date AS VARCHAR) AS date, max(b) FILTER (s = 'FII') AS fii_buy, max(v) FILTER (s = 'FII') AS fii_sell, max(b - v) FILTER (s = 'FII') AS fii_net, max(b) FILTER (s = 'DII') AS dii_buy, max(v) FILTER (s = 'DII') AS dii_sell, max(b - v) FILTER (s = 'DII') AS dii_net FROM (SELECT CAST(l_shipdate AS DATE) AS date,
 CASE WHEN l_linestatus = 'O' THEN 'FII' ELSE 'DII' END AS s, sum(l_quantity) FILTER (l_returnflag = 'R') AS b, sum(l_quantity) FILTER (l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1, 2) WHERE date = (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) GROUP BY 1""")
def _(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linestatus") == "O", "FII").otherwise("DII").alias("category")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("buy"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("sell"))
    text = f.select("category", F.date_format("date", "dd-MMM-yyyy").alias("date"), F.format_number("buy", 2).alias("buy"), F.format_number("sell", 2).alias("sell"))
    parsed = text.select("category", V.date_parse("date").alias("date"), V.num_parse("buy").alias("buy"), V.num_parse("sell").alias("sell"))
    return C.flow_latest(parsed.withColumn("net", F.col("buy") - F.col("sell")))


@query("ltp_change", sql("""SELECT symbol, CAST(CASE WHEN n = 2 THEN as_of END AS VARCHAR) AS as_of, CASE WHEN n = 2 THEN a END AS ltp, CASE WHEN n = 2 AND b > 0 THEN round((a / b - 1) * 100, 6) END AS change_pct FROM (SELECT symbol, max(date) AS as_of, count(*) AS n, max(close) FILTER (k = 1) AS a, max(close) FILTER (k = 2) AS b FROM
 (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE (symbol + (date - DATE '1970-01-01')) % 3 <> 0) WHERE k <= 2 GROUP BY 1)""", BARS))
def _(spark, d):
    c = bars(spark, d).select("symbol", "date", F.when((F.col("symbol") + F.unix_date("date")) % 3 != 0, F.col("close")).alias("close"))
    return C.ltp_change(c).withColumn("change_pct", rnd("change_pct", 6))


@query("session_ohlc_latest_summary", sql("""SELECT label, CAST(date AS VARCHAR) AS date, close, CASE WHEN date - pd <= 7 THEN p END AS previous_close, CASE WHEN date - pd <= 7 AND p > 0 THEN round((close / p - 1) * 100, 6) END AS change_pct FROM (SELECT *, lag(close) OVER w AS p, lag(date) OVER w AS pd FROM
 (SELECT l_returnflag || l_linestatus AS label, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY label ORDER BY date)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY date DESC) = 1"""))
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("label"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"))
    return C.session_summary(s, "label").withColumn("change_pct", rnd("change_pct", 6))


# ---------------------------------------------------------------- states and work lists
def states(spark, d):
    s = F.col("symbol")
    r = S.ratios(spark, d)
    return r.select("symbol", (s % 8 != 7).alias("listed"), (s % 27 == 5).alias("isin_changed"), F.when(s % 4 == 1, "HTTP 500").alias("last_error"), (s % 7).cast("int").alias("failures"), F.date_sub(today(), (s % 9).cast("int")).alias("last_attempt"),
                    (s % 16 == 2).alias("invalid"), F.when(s % 10 != 3, F.date_sub(today(), (s % 12).cast("int"))).alias("ratios_fetched"), F.date_sub(today(), (s % 100).cast("int")).alias("profile_fetched"))


@query("refresh_state", """SELECT symbol, CASE WHEN symbol % 8 = 7 THEN 'not_listed' WHEN symbol % 27 = 5 THEN 'isin_held' WHEN e AND symbol % 9 < least(30, pow(2, greatest(symbol % 7, 1) - 1)) THEN 'failed_backoff' WHEN symbol % 16 = 2 THEN 'invalid' WHEN symbol % 10 = 3 AND e THEN 'failed_due' WHEN symbol % 10 = 3 THEN 'missing'
 WHEN symbol % 12 >= 7 OR symbol % 100 >= 90 THEN CASE WHEN e THEN 'failed_due' ELSE 'stale' END ELSE 'fresh' END AS state FROM (SELECT c_custkey AS symbol, c_custkey % 4 = 1 AS e FROM customer)""")
def _(spark, d):
    return states(spark, d).select("symbol", C.refresh_state(today()).alias("state"))


@query("results_pending", sql("""SELECT symbol, inside, checked IS NULL OR CASE WHEN inside THEN age >= 2 ELSE age >= 30 END AS due FROM (SELECT symbol, last_day(q + INTERVAL 3 MONTH) + 10 <= DATE '2001-08-05' AND DATE '2001-08-05' <= last_day(q + INTERVAL 3 MONTH) + 100 AS inside, symbol % 40 AS age, CASE WHEN symbol % 6 <> 0 THEN 1 END AS checked
 FROM (SELECT symbol, max(quarter_end) AS q FROM quarters GROUP BY 1))""", QUARTERS))
def _(spark, d):
    q = S.quarter_values(spark, d).groupBy("symbol").agg(F.max("quarter_end").alias("q"))
    inside, due = C.results_pending(F.col("q"), F.when(F.col("symbol") % 6 != 0, F.date_sub(today(), (F.col("symbol") % 40).cast("int"))), today())
    return q.select("symbol", inside.alias("inside"), due.alias("due"))


def items(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("symbol"), F.when(k % 4 != 0, F.date_sub(today(), (k % 60).cast("int"))).alias("fetched"), (k % 5 + 1).alias("cost"), (k % 3 == 0).alias("recheck"))


ITEMS = "items AS (SELECT c_custkey AS symbol, CASE WHEN c_custkey % 4 <> 0 THEN DATE '2001-08-05' - CAST(c_custkey % 60 AS INTEGER) END AS fetched, c_custkey % 5 + 1 AS cost, c_custkey % 3 = 0 AS recheck FROM customer)"


@query("worklist_budget_cut", sql("""SELECT symbol, position, spent FROM (SELECT *, min(CASE WHEN spent > 500 THEN position END) OVER () AS cut FROM (SELECT symbol, row_number() OVER w AS position, CAST(sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM items WINDOW w AS (ORDER BY coalesce(CAST(fetched AS VARCHAR), ''), symbol))) WHERE cut IS NULL OR position < cut""", ITEMS))
def _(spark, d):
    i = items(spark, d).select("symbol", "fetched", "cost")
    return C.worklist_budget_cut(i, [F.coalesce(F.col("fetched").cast("string"), F.lit("")), F.col("symbol")], "cost", 500).select("symbol", "position", "spent")


@query("worklist_due_first", sql("SELECT symbol, CAST(fetched AS VARCHAR) AS fetched, rank FROM (SELECT *, row_number() OVER (ORDER BY fetched NULLS FIRST, symbol) AS rank FROM items WHERE fetched IS NULL OR DATE '2001-08-05' - fetched >= 30) WHERE rank <= 600", ITEMS))
def _(spark, d):
    return C.worklist_due_first(items(spark, d).select("symbol", "fetched"), today(), 30, 600)


@query("worklist_share", sql("""SELECT symbol, recheck, position FROM (SELECT *, CASE WHEN recheck AND p <= half THEN p WHEN NOT recheck THEN half + p ELSE least(k, 900 - half) + p END AS position FROM (SELECT *, least(450, r) AS half FROM (SELECT symbol, recheck, row_number() OVER (PARTITION BY recheck ORDER BY symbol) AS p, count(*) FILTER (recheck) OVER () AS r, count(*) FILTER (NOT recheck) OVER () AS k FROM items)))
 WHERE CASE WHEN recheck THEN position <= 900 ELSE p <= least(k, 900 - half) END""", ITEMS))
def _(spark, d):
    return C.worklist_share(items(spark, d).select("symbol", "recheck"), 900)


@query("batch_partition", sql("SELECT (position - 1) // 500 + 1 AS batch, count(*) AS symbols, sha256(string_agg(CAST(symbol AS VARCHAR), chr(10) ORDER BY position)) AS hash FROM (SELECT symbol, row_number() OVER (ORDER BY NOT recheck, symbol) AS position FROM items) GROUP BY 1", ITEMS))
def _(spark, d):
    return C.batch_partition(items(spark, d), [F.when(F.col("recheck"), 0).otherwise(1), F.col("symbol")])


@query("batch_cost", sql("SELECT batch, n AS nominal_calls, w AS worst_calls, CAST(ceil(n / 120.0) AS BIGINT) AS runs, round(n * 2.3::DOUBLE / 3600, 2) AS hours FROM (SELECT symbol // 100 AS batch, 3 * count(*) AS n, 3 * count(*) + 3 * count(*) FILTER (fetched IS NULL) AS w FROM items GROUP BY 1)", ITEMS))
def _(spark, d):
    b = items(spark, d).groupBy(F.floor(F.col("symbol") / 100).alias("batch")).agg(F.count_if(F.col("fetched").isNull()).alias("missing"), F.count_if(F.col("fetched").isNotNull() & (F.col("symbol") % 2 == 0)).alias("stale"), F.count_if(F.col("fetched").isNotNull() & (F.col("symbol") % 2 == 1)).alias("invalid"))
    return C.batch_cost(b, 2.3, 120)


@query("plan_reconcile", sql("SELECT batch, r AS remaining FROM (SELECT symbol // 10 AS batch, count(*) FILTER (fetched IS NULL OR fetched < DATE '2001-06-20') AS r FROM items GROUP BY 1) WHERE batch % 3 <> 0 AND r > 0", ITEMS))
def _(spark, d):
    b = F.floor(F.col("symbol") / 10)
    now = items(spark, d).groupBy(b.alias("batch")).agg(F.count_if(F.col("fetched").isNull() | (F.col("fetched") < "2001-06-20")).alias("remaining")).withColumn("complete", F.col("remaining") == 0)
    before = items(spark, d).select(b.alias("batch")).distinct().withColumn("complete", F.col("batch") % 3 != 0)
    return C.plan_reconcile(before, now)


@query("attempts_update", sql("""SELECT symbol, CASE WHEN symbol % 2 = 0 THEN symbol % 4 ELSE 0 END + CASE WHEN symbol % 3 = 0 THEN 1 ELSE 0 END AS count, CASE WHEN symbol % 3 = 0 THEN '2001-08-05' ELSE '2001-07-01' END AS last FROM items WHERE (symbol % 2 = 0 OR symbol % 3 = 0) AND NOT (symbol % 3 = 0 AND symbol % 5 = 0)""", ITEMS))
def _(spark, d):
    i, s = items(spark, d), F.col("symbol")
    old = i.where(s % 2 == 0).select("symbol", (s % 4).alias("count"), F.lit("2001-07-01").cast("date").alias("last"))
    return C.attempts_update(old, i.where(s % 3 == 0).select("symbol", (s % 5 == 0).alias("gained"), today().alias("day")))
