"""Statements, growth and ownership over documents derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.joins import shares_pct
from barloom.catalog.model_sql import HOLDINGS, QUARTERS, RATIOS, YEARS, sql
from barloom.catalog.registry import query
from barloom.functions.values import layout_class, rnd, weekdays_between
from barloom.operators import joins as J
from barloom.operators import ownership as O
from barloom.operators import statements as T
from barloom.session import parts_for
from barloom.sources import market as S
from barloom.sources.market import bars, table, table_path


def _history(period, value, dup):
    cell = F.struct(period.alias("period"), value.alias("value"))
    return F.flatten(F.collect_list(F.when(dup, F.array(cell, cell)).otherwise(F.array(cell))))


def _period():
    s = F.col("symbol")
    return F.concat(F.when((s % 19 == 0) & (F.col("fy") >= 1999), "Mar ").otherwise("Dec "), "fy")


def year_parts(spark, d):
    """Over how many tasks the customers of `orders` are dealt: a megabyte of the table unfolds to some thirty of responses."""
    return parts_for(spark, table_path(d, "orders"), 2)


def _year_lines(spark, d):
    """Per customer and year what the responses list, with the function that makes a history of one column. The orders are placed by customer once, before
    they are added up, so years and responses need no exchange of their own and no task adds up more than its part."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.year("o_orderdate").alias("fy"), "o_totalprice").repartition(year_parts(spark, d), "symbol")
    y = o.groupBy("symbol", "fy").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("rev"), F.max("o_totalprice").alias("mx"), F.min("o_totalprice").alias("mn"), F.count(F.lit(1)).cast("double").alias("n"))
    dup = (F.col("symbol") % 29 == 0) & (F.col("fy") == 1997)
    return y, lambda v: _history(_period(), v, dup)


def annual_docs(spark, d):
    """One nested yearly response per customer: a changed year-end, repeated labels, repeated periods, non-yearly responses, lenders with lines of
    their own, unknown sectors and summaries that are missing or differ."""
    y, hist = _year_lines(spark, d)
    s = F.col("symbol")
    net = F.when(s % 13 != 6, F.col("mn") + F.when(s % 4 == 0, 0.005).otherwise(0.0) + F.when(s % 11 == 5, 2.0).otherwise(0.0))
    g = y.groupBy("symbol").agg(hist(F.col("rev")).alias("h_rev"), hist(F.col("mx")).alias("h_mx"), hist(F.col("mn")).alias("h_mn"), hist(F.col("n")).alias("h_n"),
                                hist(F.col("rev") + F.when(s % 3 == 0, 1.0).otherwise(0.0)).alias("s_rev"), hist(net).alias("s_mn"))
    line = lambda label, h: F.struct(F.lit(label).alias("particular"), F.col(h).alias("history"))
    cat = lambda label, h: F.struct(F.lit(label).alias("category"), F.col(h).alias("history"))
    lines = [line("Revenue", "h_rev"), line("Total  Revenue", "h_rev"), line("Profit Before Tax", "h_mx"), line("Profit after tax.", "h_mn"), line("EPS (Basic)", "h_n")]
    bank = [line("Interest  Earned", "h_n"), line("Provisions", "h_mn")]
    full = F.when(s % 31 == 0, F.array(*lines, line("revenue", "h_mx"))).otherwise(F.array(*lines))
    own = F.when(s % 14 == 0, F.array(*bank, line("PROVISIONS", "h_mx"))).when(s % 7 == 0, F.array(*bank)).otherwise(F.slice(F.array(*bank), 1, 0))
    return g.select("symbol", F.when(s % 23 == 0, "quarterly").when(s % 5 == 1, None).otherwise("Yearly").alias("time_period"),
                    layout_class(F.when(s % 7 == 0, "Private Bank").when(s % 7 == 1, " ").otherwise("Machinery")).alias("layout"), F.concat(full, own).alias("full_statement"),
                    F.array(cat("revenue", "s_rev"), cat("operating_profit", "h_mx"), cat("net_profit", "s_mn")).alias("income_statement"))


def cash_docs(spark, d):
    """One nested cash flow response per customer: repeated categories and periods, quarterly responses, changed year-ends with and without a known month,
    one, two or no total line of capital expenditure."""
    y, hist = _year_lines(spark, d)
    s = F.col("symbol")
    g = y.groupBy("symbol").agg(hist(F.col("rev")).alias("op"), hist(-F.col("mx")).alias("inv"), hist(F.col("mn")).alias("fin"), hist(F.col("n")).alias("n"), hist(-F.col("n")).alias("capex"))
    line = lambda label, h: F.struct(F.lit(label).alias("particular"), F.col(h).alias("history"))
    cat = lambda label, h: F.struct(F.lit(label).alias("category"), F.col(h).alias("history"))
    cats = [cat("Operating", "op"), cat("investing", "inv"), cat("financing", "fin")]
    full = (F.when(s % 5 == 0, F.array(line("Capital Expenditure", "capex"), line("Sale of fixed assets", "n"))).when(s % 5 == 1, F.array(line("CapEx", "capex"), line("Purchase of Fixed Assets", "n")))
            .otherwise(F.array(line("Purchase of Intangible Assets", "capex"))))
    return g.select("symbol", F.when(s % 23 == 0, "Quarterly").when(s % 5 != 1, "yearly").alias("time_period"), F.when(s % 38 == 0, 3).alias("fy_month"), full.alias("full_statement"),
                    F.when(s % 31 == 0, F.array(*cats, cat("operating", "n"))).otherwise(F.array(*cats)).alias("cash_flow"))


ANNUAL = """
yv AS (SELECT o_custkey AS symbol, year(o_orderdate) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS rev, max(o_totalprice) AS mx, min(o_totalprice) AS mn, count(*)::DOUBLE AS n,
  year(o_orderdate) * 12 + CASE WHEN o_custkey % 19 = 0 AND year(o_orderdate) >= 1999 THEN 3 ELSE 12 END AS m, CASE WHEN o_custkey % 19 = 0 AND year(o_orderdate) >= 1999 THEN 3 ELSE 12 END AS mo
  FROM orders GROUP BY ALL),
sw AS (SELECT *, CASE WHEN lag(mo) OVER w <> mo THEN 1 ELSE 0 END AS switch, m - lag(m) OVER w AS gap FROM yv WINDOW w AS (PARTITION BY symbol ORDER BY m)),
isl AS (SELECT *, sum(switch) OVER (PARTITION BY symbol) AS switches, sum(CASE WHEN switch = 0 AND gap <> 12 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS uneven, sum(switch) OVER (PARTITION BY symbol ORDER BY m) AS after FROM sw),
jdg AS (SELECT *, CASE WHEN switches > 1 OR (switches = 1 AND (uneven > 0 OR full_after = 0)) THEN 'mixed_month_ends' END AS problem FROM (SELECT *, sum(CASE WHEN after = 1 AND switch = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS full_after FROM isl)),
annual AS (SELECT symbol, fy, CASE WHEN symbol % 31 <> 0 THEN rev END AS revenue, rev AS total_revenue, mx AS profit_before_tax, mn AS profit_after_tax, n AS eps_basic, NULL::DOUBLE AS eps_diluted,
  CASE WHEN symbol % 7 > 1 THEN symbol % 3 <> 0 END AS revenue_check, CASE WHEN symbol % 7 > 1 THEN true END AS pbt_check, CASE WHEN symbol % 13 <> 6 THEN symbol % 11 <> 5 END AS pat_check,
  CASE WHEN symbol % 7 = 0 THEN 'Interest Earned=' || CAST(n * 100 AS BIGINT) || CASE WHEN symbol % 14 <> 0 THEN ';Provisions=' || CAST(round(mn * 100) AS BIGINT) ELSE '' END ELSE '' END AS other_lines, NULL::VARCHAR AS problem
  FROM jdg WHERE problem IS NULL AND (switches = 0 OR (after = 1 AND switch = 0)) AND NOT (symbol % 29 = 0 AND fy = 1997) AND symbol % 23 <> 0)"""


def annual(spark, d):
    return T.annual_parse(annual_docs(spark, d))


@query("annual_parse", sql("""SELECT * FROM annual UNION ALL BY NAME SELECT DISTINCT o_custkey AS symbol, 'not_yearly' AS problem FROM orders WHERE o_custkey % 23 = 0
 UNION ALL BY NAME SELECT DISTINCT symbol, coalesce(problem, 'no_data') AS problem FROM jdg WHERE symbol % 23 <> 0 AND symbol NOT IN (SELECT symbol FROM annual)""", ANNUAL))
def _(spark, d):
    shown = F.array_join(F.transform("other_lines", lambda x: F.concat(x["label"], F.lit("="), F.rint(x["value"] * 100).cast("bigint"))), ";")
    return annual(spark, d).withColumn("other_lines", shown)


@query("annual_cashflow", sql("""SELECT symbol, fy, op AS operating_cash_flow, -mx AS investing_cash_flow, mn AS financing_cash_flow, capex, round(op - capex, 2) AS free_cash_flow, NULL::VARCHAR AS problem FROM flows
 UNION ALL BY NAME SELECT symbol, CASE WHEN symbol % 23 = 0 THEN 'quarterly' WHEN symbol % 38 <> 0 AND count(DISTINCT mo) > 1 THEN 'mixed_month_ends' ELSE 'no_data' END AS problem FROM yv WHERE symbol NOT IN (SELECT symbol FROM flows) GROUP BY symbol""", ANNUAL,
  """flows AS (SELECT *, CASE WHEN symbol % 31 = 0 THEN n ELSE rev END AS op, CASE WHEN symbol % 5 = 0 THEN n END AS capex FROM (SELECT *, min(mo) OVER (PARTITION BY symbol) <> max(mo) OVER (PARTITION BY symbol) AS mixed FROM yv)
  WHERE symbol % 23 <> 0 AND NOT (symbol % 29 = 0 AND fy = 1997) AND CASE WHEN symbol % 38 = 0 THEN mo = 3 ELSE NOT mixed END)"""))
def _(spark, d):
    return T.annual_cashflow(cash_docs(spark, d))


@query("year_end_change", sql("SELECT symbol, fy * 100 + mo AS period, problem FROM jdg WHERE problem IS NOT NULL OR switches = 0 OR (after = 1 AND switch = 0)", ANNUAL))
def _(spark, d):
    docs = annual_docs(spark, d)
    periods = docs.select("symbol", F.explode(F.element_at("full_statement", 2)["history"]).alias("h")).select("symbol", T.period_parse("h.period").alias("period_end"))
    out = T.year_end_change(periods)
    return out.select("symbol", (F.year("period_end") * 100 + F.month("period_end")).alias("period"), "problem")


@query("src_statement_lines", sql("""SELECT symbol, label, fy, value FROM (SELECT symbol, fy, 'revenue' AS label, rev AS value FROM yv WHERE symbol % 31 <> 0 UNION ALL SELECT symbol, fy, 'total revenue', rev FROM yv UNION ALL SELECT symbol, fy, 'profit before tax', mx FROM yv
 UNION ALL SELECT symbol, fy, 'profit after tax', mn FROM yv UNION ALL SELECT symbol, fy, 'eps basic', n FROM yv UNION ALL SELECT symbol, fy, 'interest earned', n FROM yv WHERE symbol % 7 = 0 UNION ALL SELECT symbol, fy, 'provisions', mn FROM yv WHERE symbol % 14 = 7) WHERE NOT (symbol % 29 = 0 AND fy = 1997)
 UNION ALL SELECT symbol, l, fy, NULL FROM yv, (VALUES ('revenue'), ('total revenue'), ('profit before tax'), ('profit after tax'), ('eps basic'), ('interest earned'), ('provisions')) t(l) WHERE symbol % 29 = 0 AND fy = 1997 AND NOT (l = 'revenue' AND symbol % 31 = 0)
  AND NOT (l = 'interest earned' AND symbol % 7 <> 0) AND NOT (l = 'provisions' AND symbol % 14 <> 7)""", ANNUAL))
def _(spark, d):
    return T.statement_lines(annual_docs(spark, d), year_parts(spark, d)).select("symbol", "label", F.year("period_end").alias("fy"), "value")


@query("reconcile_flags", sql("""SELECT symbol, fy, CASE WHEN warnings <> '' THEN 'mismatch' WHEN revenue_check OR pbt_check OR pat_check THEN 'matched' ELSE 'not_checked' END AS reconciliation, warnings FROM (SELECT *, concat_ws(',', CASE WHEN NOT pat_check THEN 'pat_check' END,
  CASE WHEN NOT pbt_check THEN 'pbt_check' END, CASE WHEN NOT revenue_check THEN 'revenue_check' END) AS warnings FROM annual)""", ANNUAL))
def _(spark, d):
    rec, warn = T.reconcile_flags(["revenue_check", "pbt_check", "pat_check"])
    return annual(spark, d).where("problem IS NULL").select("symbol", "fy", rec.alias("reconciliation"), warn.alias("warnings"))


@query("income_latest", sql("""SELECT symbol, fy, total_revenue, profit_after_tax, s IS NOT DISTINCT FROM total_revenue AS check, CASE WHEN s = total_revenue THEN ch END AS growth FROM (SELECT a.*, a.total_revenue + CASE WHEN a.symbol % 3 = 0 THEN 1 ELSE 0 END AS s, n AS ch
 FROM annual a JOIN yv USING (symbol, fy) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) = 1)""", ANNUAL))
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("rev"), F.count(F.lit(1)).cast("double").alias("change"))
    change = o.select("symbol", "fy", (F.col("rev") + F.when(F.col("symbol") % 3 == 0, 1.0).otherwise(0.0)).alias("s_revenue"), "change")
    return T.income_latest(annual(spark, d).where("problem IS NULL"), change)


@query("balance_latest", """SELECT symbol, a AS total_assets, l AS total_liabilities, Q AS total_equity, CASE WHEN Q > 0 THEN R END AS liabilities_to_equity, NULL::DOUBLE AS total_debt FROM (SELECT *, round((a - l) * 100) / 100 AS Q, rint_ratio AS R FROM (SELECT *, NULL::DOUBLE AS rint_ratio FROM (SELECT o_custkey AS symbol, max(o_totalprice) AS a, min(o_totalprice) * 3 AS l FROM orders GROUP BY 1)))""".replace(
    "rint_ratio AS R", "l / (round((a - l) * 100) / 100) AS R0").replace("THEN R END", "THEN CASE WHEN abs(R0 * 100 - trunc(R0 * 100)) = 0.5 THEN 2 * round(R0 * 50) ELSE round(R0 * 100) END / 100 END"))
def _(spark, d):
    return T.balance_latest(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_totalprice").alias("total_assets"), (F.min("o_totalprice") * 3).alias("total_liabilities")))


@query("cashflow_latest", sql("""SELECT symbol, CAST(make_date(fy, 12, 31) AS VARCHAR) AS period_end, value AS operating, CASE WHEN symbol % 5 = 0 THEN lines::DOUBLE END AS capex, CASE WHEN symbol % 5 = 0 THEN round(value - lines, 2) END AS free_cash_flow,
 CASE symbol % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'partial_only' WHEN 3 THEN 'none' ELSE 'no_value_for_period' END AS capex_status FROM years""", YEARS))
def _(spark, d):
    y, m = S.year_values(spark, d), F.col("symbol") % 5
    flows = y.select("symbol", F.make_date("fy", F.lit(12), F.lit(31)).alias("period_end"), F.col("value").alias("operating"), "lines")
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"))
    n = -F.col("lines")
    sets = (F.when(m == 0, F.array(row("Capital Expenditure", n), row("Sale of fixed assets", n))).when(m == 1, F.array(row("CapEx", n), row("Purchase of Fixed Assets", n))).when(m == 2, F.array(row("Purchase of Intangible Assets", n)))
            .when(m == 3, F.array(row("Dividends", n))).otherwise(F.array(row("capital expenditure", F.lit(None)))))
    return T.cashflow_latest(flows.drop("lines"), flows.select("symbol", "period_end", F.inline(sets)))


@query("quarterly_parse", sql("""SELECT symbol, CAST(quarter_end AS VARCHAR) AS quarter_end, coalesce(dr, revenue) AS revenue, NULL::DOUBLE AS total_revenue, NULL::DOUBLE AS operating_profit, NULL::DOUBLE AS profit_before_tax, coalesce(dp, profit) AS profit_after_tax,
  CASE WHEN dr IS NOT NULL THEN 'full_statement' ELSE 'summary' END AS revenue_source FROM quarters q LEFT JOIN (SELECT symbol, quarter_end, revenue + 0.5 AS dr, profit AS dp FROM det JOIN usable USING (symbol)) x USING (symbol, quarter_end)""", QUARTERS,
  "det AS (SELECT * FROM quarters WHERE (symbol % 7 = 0 AND month(quarter_end) = 12) OR (symbol % 7 <> 0 AND symbol % 2 = 0))",
  """usable AS (SELECT d.symbol FROM (SELECT symbol, count(*) AS n, count(DISTINCT month(quarter_end)) AS k FROM det GROUP BY 1) d JOIN (SELECT symbol, count(*) AS n, count(DISTINCT month(quarter_end)) AS k FROM quarters GROUP BY 1) s USING (symbol)
   WHERE NOT (d.n >= 2 AND d.k = 1) AND NOT (s.n >= 2 AND s.k >= 2 AND NOT (d.n >= 2 AND d.k >= 2)))"""))
def _(spark, d):
    q, s = S.quarter_values(spark, d), F.col("symbol")
    cell = lambda v: F.collect_list(F.struct(F.date_format("quarter_end", "MMM yyyy").alias("period"), v.alias("value")))
    keep = F.when(s % 7 == 0, F.month("quarter_end") == 12).otherwise(s % 2 == 0)
    det = lambda v: F.filter(F.collect_list(F.when(keep, F.struct(F.date_format("quarter_end", "MMM yyyy").alias("period"), v.alias("value")))), lambda x: x.isNotNull())
    g = q.groupBy("symbol").agg(cell(F.col("revenue")).alias("sr"), cell(F.col("profit")).alias("sp"), det(F.col("revenue") + 0.5).alias("dr"), det(F.col("profit")).alias("dp"))
    docs = g.select("symbol", F.lit("quarterly").alias("time_period"), F.array(F.struct(F.lit("Revenue").alias("particular"), F.col("dr").alias("history")), F.struct(F.lit("Profit after tax").alias("particular"), F.col("dp").alias("history"))).alias("full_statement"),
                    F.array(F.struct(F.lit("revenue").alias("category"), F.col("sr").alias("history")), F.struct(F.lit("net_profit").alias("category"), F.col("sp").alias("history"))).alias("income_statement"))
    return T.quarterly_parse(docs)


@query("basis_fallback", sql("""SELECT symbol, CASE WHEN alone THEN 'standalone' ELSE 'consolidated' END AS basis, CASE WHEN alone THEN sf ELSE cf END AS fy, CASE WHEN alone THEN sv ELSE cv END AS value FROM (SELECT *, cf IS NULL OR (cf < 2000 AND coalesce(sf, 0) > cf) AS alone FROM
 (SELECT symbol, max(fy) FILTER (fy % 2 = 0) AS cf, max(fy) FILTER (fy % 2 = 1) AS sf, arg_max(value, fy) FILTER (fy % 2 = 0) AS cv, arg_max(value, fy) FILTER (fy % 2 = 1) AS sv FROM years GROUP BY 1))""", YEARS))
def _(spark, d):
    y = S.year_values(spark, d).withColumn("basis", F.when(F.col("fy") % 2 == 0, "consolidated").otherwise("standalone"))
    newest = y.groupBy("symbol", "basis").agg(F.max("fy").alias("fy"), F.max_by("value", "fy").alias("value"))
    return T.basis_fallback(newest, 2001)


@query("ratio_merge_guard", sql("""SELECT symbol, usable, CASE WHEN lost THEN 'pe' ELSE '' END AS lost, usable AND NOT lost AS accepted, CASE WHEN usable AND NOT lost THEN npe ELSE pe END AS pe, CASE WHEN usable AND NOT lost THEN nroe ELSE roe END AS roe FROM (SELECT *, npe IS NOT NULL OR nroe IS NOT NULL AS usable,
 pe IS NOT NULL AND npe IS NULL AND symbol % 8 <> 0 AS lost FROM (SELECT symbol, pe, roe, CASE WHEN symbol % 4 <> 0 THEN pe + 1 END AS npe, coalesce(roe, 5) AS nroe FROM ratios))""", RATIOS))
def _(spark, d):
    old, s = S.ratios(spark, d).select("symbol", "pe", "roe"), F.col("symbol")
    new = old.select("symbol", F.when(s % 4 != 0, F.col("pe") + 1).alias("pe"), F.coalesce("roe", F.lit(5.0)).alias("roe"), F.when(s % 8 == 0, F.array(F.lit("pe"))).otherwise(F.array().cast("array<string>")).alias("explicit"))
    return T.ratio_merge_guard(old, new, ["pe", "roe"])


GROWTH = ", ".join(f"CASE WHEN {p}.{f} > 0 THEN round((q.{f} - {p}.{f}) / {p}.{f} * 100, 2) END AS {n}_{f}" for f in ("revenue", "profit") for p, n in (("y", "yoy"), ("k", "qoq")))


@query("yoy_qoq_growth", sql(f"""SELECT q.symbol, CAST(q.quarter_end AS VARCHAR) AS quarter_end, {GROWTH} FROM nation_quarters q LEFT JOIN nation_quarters y ON y.symbol = q.symbol AND last_day(y.quarter_end + INTERVAL 12 MONTH) = q.quarter_end
 LEFT JOIN nation_quarters k ON k.symbol = q.symbol AND last_day(k.quarter_end + INTERVAL 3 MONTH) = q.quarter_end""", QUARTERS))
def _(spark, d):
    return T.yoy_qoq_growth(S.quarter_values(spark, d, "c_nationkey"), ["revenue", "profit"])


@query("annual_change", sql("""SELECT symbol, fy, value, CASE WHEN lag(fy) OVER w = fy - 1 AND lag(value) OVER w <> 0 AND NOT (symbol % 10 = 0 AND fy = 1998) THEN round((value - lag(value) OVER w) / abs(lag(value) OVER w) * 100, 6) END AS change_pct FROM years WINDOW w AS (PARTITION BY symbol ORDER BY fy)""", YEARS))
def _(spark, d):
    r = T.annual_change(S.year_values(spark, d), (F.col("symbol") % 10 == 0) & (F.col("fy") == 1998))
    return r.withColumn("change_pct", rnd("change_pct", 6))


@query("cagr_fixed_window", sql("""SELECT symbol, n, CASE WHEN n >= 3 AND good = n + 1 THEN round((pow(b / a, 1.0::DOUBLE / n) - 1) * 100, 6) END AS cagr_pct FROM (SELECT symbol, max(2000 - s) AS n, count(*) FILTER (fy BETWEEN s AND 2000 AND value > 0) AS good, max(value) FILTER (fy = s) AS a, max(value) FILTER (fy = 2000) AS b
 FROM (SELECT *, CASE symbol % 3 WHEN 0 THEN 1996 WHEN 1 THEN 1997 ELSE 1998 END AS s FROM years) GROUP BY 1)""", YEARS))
def _(spark, d):
    start = F.when(F.col("symbol") % 3 == 0, 1996).when(F.col("symbol") % 3 == 1, 1997).otherwise(1998)
    return T.cagr_fixed_window(S.year_values(spark, d), start, F.lit(2000)).withColumn("cagr_pct", rnd("cagr_pct", 6))


@query("fiscal_gaps", sql("""SELECT symbol, basis, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS gaps FROM (SELECT symbol, basis, unnest(range(min(fy), max(fy))) AS y FROM yb GROUP BY 1, 2) e WHERE NOT EXISTS (SELECT 1 FROM yb WHERE yb.symbol = e.symbol AND yb.basis = e.basis AND fy = y) GROUP BY 1, 2""", YEARS,
                          "yb AS (SELECT symbol, fy, CASE WHEN symbol % 3 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis FROM years)"))
def _(spark, d):
    y = S.year_values(spark, d).withColumn("basis", F.when(F.col("symbol") % 3 == 0, "standalone").otherwise("consolidated"))
    return T.fiscal_gaps(y).withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


@query("quarter_gaps", sql("SELECT symbol, CAST(quarter_end AS VARCHAR) AS older, CAST(nx AS VARCHAR) AS newer FROM (SELECT *, lead(quarter_end) OVER (PARTITION BY symbol ORDER BY quarter_end) AS nx FROM quarters) WHERE nx <> last_day(quarter_end + INTERVAL 3 MONTH)", QUARTERS))
def _(spark, d):
    return T.quarter_gaps(S.quarter_values(spark, d))


@query("expected_quarters", sql("""SELECT symbol, CAST(qe AS VARCHAR) AS quarter_end FROM (SELECT symbol, last_day(CAST(unnest(generate_series(DATE '1998-03-01', CAST(date_trunc('month', max(quarter_end)) AS DATE), INTERVAL 3 MONTH)) AS DATE)) AS qe FROM quarters GROUP BY 1 HAVING max(quarter_end) >= DATE '1998-03-31') e
 WHERE NOT EXISTS (SELECT 1 FROM quarters q WHERE q.symbol = e.symbol AND q.quarter_end = qe)""", QUARTERS))
def _(spark, d):
    return T.expected_quarters(S.quarter_values(spark, d), "1998-03-31")


@query("weekdays_behind", """SELECT symbol, CAST(last AS VARCHAR) AS last, n AS weekdays_behind, n >= 3 AS late FROM (SELECT symbol, last, (SELECT count(*) FROM range(CAST(DATE '2001-11-09' - last AS BIGINT)) r(i) WHERE isodow(last + 1 + CAST(i AS INTEGER)) < 6) AS n
 FROM (SELECT l_suppkey AS symbol, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1))""")
def _(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.max(F.to_date("l_shipdate")).alias("last"))
    behind = weekdays_between(F.col("last"), F.lit("2001-11-09").cast("date"))
    return last.select("symbol", "last", behind.alias("weekdays_behind"), (behind >= 3).alias("late"))


# ---------------------------------------------------------------- ownership
def category_facts(spark, d):
    """Member rows per customer and year: new or old format, percent or fraction, absent promoters, trusts and share conflicts by key."""
    h = shares_pct(S.holdings(spark, d))
    w = h.groupBy("symbol", "period_end").agg(F.max("total").alias("total"), *[F.coalesce(F.max(F.when(F.col("category") == c, F.col("shares"))), F.lit(0.0)).alias(c) for c in O.CATEGORIES])
    s, m = F.col("symbol"), O.MEMBERS
    k = F.when(s % 2 == 0, 1.0).otherwise(100.0)
    row = lambda name, v, skip=None: F.when(F.lit(True) if skip is None else ~skip, F.struct(F.lit(m[name]).alias("member"), v.alias("shares"), (v / F.col("total") * k).alias("pct")))
    new, inst = s % 3 != 0, F.col("other_dii") + F.col("mutual_funds")
    wrong = F.when(s % 11 == 0, F.col("fii") * 0.5).otherwise(F.col("fii"))
    fact = lambda name, shares, v, cond: F.when(cond, F.struct(F.lit(m[name]).alias("member"), shares.alias("shares"), (v / F.col("total") * k).alias("pct")))
    rows = [fact("total", F.col("total"), F.when(s % 13 == 0, F.lit(None)).otherwise(F.col("total")), F.lit(True)), fact("promoter", F.col("promoters"), F.col("promoters"), s % 7 != 0),
            fact("public", F.col("total"), F.when(s % 14 == 0, F.col("total")).otherwise(F.col("total") - F.col("promoters")), F.lit(True)), fact("mf", F.col("mutual_funds"), F.col("mutual_funds"), F.lit(True)),
            fact("nonins", F.col("retail_other"), F.col("retail_other"), F.lit(True)), fact("foreign", wrong, F.col("fii"), new), fact("domestic", inst, inst, new),
            fact("inst_old", inst + F.col("fii"), inst + F.col("fii"), ~new), fact("fpi_old", wrong, F.col("fii"), ~new)]
    return w.select("symbol", "period_end", F.inline(F.array_compact(F.array(*rows))))


def _own_sql():
    return """
wide AS (SELECT symbol, period_end, CAST(sum(CAST(shares AS DECIMAL(18,2))) AS DOUBLE) AS total, """ + ", ".join(f"coalesce(max(shares) FILTER (category = '{c}'), 0) AS {c}" for c in O.CATEGORIES) + """ FROM holdings GROUP BY 1, 2),
own0 AS (SELECT *, CASE WHEN symbol % 2 = 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS k, CASE WHEN symbol % 2 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS f, symbol % 7 = 0 AND (symbol % 14 = 0 OR (total - promoters) / total * 100 >= 99.5) AS absent,
  (other_dii + mutual_funds) AS inst FROM wide),
own1 AS (SELECT *, CASE WHEN absent THEN 0.0::DOUBLE WHEN symbol % 7 <> 0 THEN promoters / total * k * f END AS p, fii / total * k * f AS fi, mutual_funds / total * k * f AS mf, retail_other / total * k * f AS re,
  CASE WHEN symbol % 3 <> 0 THEN inst / total * k * f - mutual_funds / total * k * f ELSE (inst + fii) / total * k * f - fii / total * k * f - mutual_funds / total * k * f END AS od FROM own0),
own2 AS (SELECT *, round(p, 2) AS promoters2, round(fi, 2) AS fii2, round(od, 2) AS other2, round(mf, 2) AS mf2, round(re, 2) AS re2, CASE WHEN symbol % 11 = 0 THEN fii * 0.5 ELSE fii END AS sf FROM own1),
own3 AS (SELECT *, round(promoters2 + fii2 + other2 + mf2 + re2, 2) AS total_pct, round(greatest(abs(fii2 - round(sf / total * 100, 2)), CASE WHEN symbol % 3 = 0 THEN abs(other2 - round((inst + fii - sf - mutual_funds) / total * 100, 2)) ELSE 0 END,
  coalesce(abs(promoters2 - CASE WHEN absent THEN 0 WHEN symbol % 7 <> 0 THEN round(promoters / total * 100, 2) END), 0)), 2) AS off FROM own2)"""


OWN_SELECT = """SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, {v} AS promoters, CASE WHEN symbol % 13 = 0 AND symbol % 2 = 0 THEN NULL ELSE fii2 END AS fii FROM own3"""


@query("shareholding_categories", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, CASE WHEN known THEN promoters2 END AS promoters, CASE WHEN known THEN fii2 END AS fii, CASE WHEN known THEN other2 END AS other_dii, CASE WHEN known THEN mf2 END AS mutual_funds, CASE WHEN known THEN re2 END AS retail_other,
 CASE WHEN symbol % 3 <> 0 THEN 'new' ELSE 'old' END AS format, CASE WHEN NOT known THEN NULL WHEN symbol % 2 = 0 THEN 'fraction' ELSE 'percent' END AS unit,
 CASE WHEN known THEN 'none' END AS trust_mode, CASE WHEN known THEN absent END AS promoter_absent, CASE WHEN known THEN total_pct END AS total_pct, CASE WHEN known AND off > 1.0 THEN off END AS conflict_pp, CASE WHEN known THEN array_to_string(list_filter([CASE WHEN p IS NULL THEN 'row_missing:promoters' END, CASE WHEN abs(total_pct - 100) > 0.25 THEN 'sum_off' END, CASE WHEN off > 1.0 THEN 'conflict' END], lambda x: x IS NOT NULL), ',') END AS flags,
 CASE WHEN NOT known THEN 'unit_unknown' END AS problem FROM (SELECT *, symbol % 13 <> 0 AS known FROM own3)""", HOLDINGS, _own_sql()))
def _(spark, d):
    return O.shareholding_categories(category_facts(spark, d))


AXES = ["in-bse:DetailsOfSharesHeldByMutualFundsOrUTIAxis", "in-bse:DetailsOfSharesHeldByInsuranceCompaniesAxis", "in-bse:DetailsOfSharesHeldByForeignDirectInvestmentAxis", "in-bse:DetailsOfShareholdersActingAsPersonsInConcertForPublicAxis", "in-bse:OtherNonInstitutionsAxis"]
AXIS_KEYS = ["mutualfundsoruti", "insurancecompanies", "foreigndirectinvestment", "shareholdersactingaspersonsinconcertforpublic", "othernoninstitutions"]


def holder_pairs(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    axis = F.element_at(F.array(*[F.lit(a) for a in AXES]), (k % 5 + 1).cast("int"))
    facts = o.select(axis.alias("axis"), F.concat(F.lit("M"), k).alias("member"), F.concat(F.col("o_custkey"), F.lit("|"), F.year("o_orderdate")).alias("period"), F.inline(F.array_compact(F.array(
        F.struct(F.lit("NameOfTheShareholder").alias("name"), F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("Holder "), k)).alias("text")),
        F.struct(F.lit("NumberOfFullyPaidUpEquityShares").alias("name"), F.when(k % 43 == 0, F.lit("0")).otherwise((k + 10).cast("string")).alias("text")),
        F.when(k % 47 == 0, F.struct(F.lit("NumberOfFullyPaidUpEquityShares").alias("name"), F.lit("7").alias("text"))),
        F.struct(F.lit("ShareholdingAsAPercentageOfTotalNumberOfShares").alias("name"), ((k % 120) / 1).cast("string").alias("text"))))))
    pairs = J.xbrl_pairs(facts)
    return pairs.withColumns({"symbol": F.substring_index("period", "|", 1).cast("bigint"), "period_end": F.make_date(F.substring_index("period", "|", -1).cast("int"), F.lit(12), F.lit(31))})


def holders(spark, d):
    return O.named_holders(holder_pairs(spark, d)).select("symbol", "period_end", "axis", "member", "holder_name", "shares", "percentage", "section", "category", "label", "excluded")


HOLDERS = """
holders AS (SELECT o_custkey AS symbol, make_date(year(o_orderdate), 12, 31) AS period_end, ['""" + "', '".join(AXES) + """'][1 + o_orderkey % 5] AS axis, 'M' || o_orderkey AS member, CASE WHEN o_orderkey % 41 = 0 THEN ' ' ELSE 'Holder ' || o_orderkey END AS holder_name,
  CASE WHEN o_orderkey % 43 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 47 = 0 AND CAST(o_orderkey + 10 AS VARCHAR) > '7' THEN 7.0::DOUBLE ELSE o_orderkey + 10.0::DOUBLE END AS shares, CASE WHEN o_orderkey % 120 <= 100 THEN CAST(o_orderkey % 120 AS DOUBLE) END AS percentage,
  ['mutual_funds', 'insurance_companies', 'foreign_direct_investment', NULL, NULL][1 + o_orderkey % 5] AS section, ['DII', 'DII', 'Foreign Investor', NULL, NULL][1 + o_orderkey % 5] AS category, ['DII – Mutual Fund', 'DII – Insurance', 'FDI', NULL, NULL][1 + o_orderkey % 5] AS label,
  CASE WHEN o_orderkey % 47 = 0 THEN 'conflicting_facts' WHEN o_orderkey % 5 = 3 THEN 'persons_in_concert' WHEN o_orderkey % 5 = 4 THEN 'unmapped_axis' WHEN o_orderkey % 41 = 0 THEN 'no_name' WHEN o_orderkey % 43 = 0 THEN 'no_shares' END AS excluded FROM orders)"""


@query("named_holders", sql("SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, axis, member, holder_name, CASE WHEN o % 43 = 0 AND o % 47 = 0 THEN 0.0::DOUBLE ELSE shares END AS shares, percentage, section, category, label, excluded FROM (SELECT *, CAST(substr(member, 2) AS BIGINT) AS o FROM holders)", HOLDERS))
def _(spark, d):
    return holders(spark, d)


@query("named_holder_totals", sql("""SELECT symbol, section, named_shares, named_count, category_total, coalesce(named_shares > category_total + 1, false) AS exceeds FROM (SELECT symbol, section, sum(shares) AS named_shares, count(*) AS named_count, CASE WHEN symbol % 2 = 0 THEN 10000.0::DOUBLE END AS category_total
 FROM holders WHERE excluded IS NULL GROUP BY 1, 2)""", HOLDERS))
def _(spark, d):
    agg = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("symbol"), F.explode(F.array(*[F.lit(s) for s in ("mutual_funds", "insurance_companies", "foreign_direct_investment")])).alias("section"), F.lit(10000.0).alias("shares"))
    return O.named_holder_totals(holders(spark, d), agg)


@query("top_holders", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, holder_name, percentage, shares, section, row_number() OVER (PARTITION BY symbol ORDER BY percentage DESC NULLS LAST, shares DESC, holder_name, axis, member) AS rank FROM holders h WHERE excluded IS NULL
 AND period_end = (SELECT max(period_end) FROM holders x WHERE x.symbol = h.symbol AND x.excluded IS NULL) QUALIFY rank <= 10""", HOLDERS))
def _(spark, d):
    return O.top_holders(holders(spark, d).where("excluded IS NULL")).select("symbol", "period_end", "holder_name", "percentage", "shares", "section", "rank")


@query("ownership_latest", sql("""SELECT symbol, CAST(max(period_end) AS VARCHAR) AS newest_on_file, CAST(max(period_end) FILTER (ok) AS VARCHAR) AS as_of, """ + ", ".join(f"(arg_max({{'v': {c}}}, period_end) FILTER (ok)).v AS {c}" for c in O.CATEGORIES) + """ FROM (SELECT *, year(period_end) % 4 <> symbol % 4 AS ok FROM
 (SELECT symbol, period_end, """ + ", ".join(f"max(shares) FILTER (category = '{c}') AS {c}" for c in O.CATEGORIES) + " FROM holdings GROUP BY 1, 2)) GROUP BY 1", HOLDINGS))
def _(spark, d):
    h = S.holdings(spark, d)
    q = h.groupBy("symbol", "period_end").agg(*[F.max(F.when(F.col("category") == c, F.col("shares"))).alias(c) for c in O.CATEGORIES])
    return O.ownership_latest(q.withColumn("status", F.when(F.year("period_end") % 4 != F.col("symbol") % 4, "available").otherwise("unavailable")))
