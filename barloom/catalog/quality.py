"""Data-quality gates over derived tables with faults planted by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.cleaning import RAW, raw_rows
from barloom.catalog.joins import sector_rows
from barloom.catalog.market import LINE_SQL, _list_sql
from barloom.catalog.model_sql import BARS, CHANGES, HOLDINGS, QUARTERS, RATIOS, YEARS, sql
from barloom.catalog.reference import FEW, SECTORS
from barloom.catalog.registry import query
from barloom.functions.values import slug
from barloom.operators import cleaning as C
from barloom.operators import market as M
from barloom.operators import quality as Q
from barloom.operators import reference as R
from barloom.operators import sectors as X
from barloom.operators import windows as W
from barloom.rules import Rules
from barloom.session import cut_lineage
from barloom.sources import market as S
from barloom.sources.market import bars, table


def faults(*cases):
    """unnest(...) over (condition, name) cases."""
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases) + "], lambda x: x IS NOT NULL)) AS problem"


SMALL_DAY = Rules().but(min_universe=50, max_invalid_share=0.001)


@query("dq_market_gate", sql("""SELECT CAST(latest AS VARCHAR) AS latest, """ + faults(
    ("error: saved data is stale", "DATE '2001-11-12' - latest > 5"), ("error: too few symbols", "n < 50"), ("error: universe changed too much", "p > 0 AND abs((n - p) / p::DOUBLE) > 0.1"), ("error: too many unusable rows", "ic / eq::DOUBLE > 0.001"), ("error: too many conflicts", "cd / eq::DOUBLE > 0.01"), ("error: no EQ rows", "eq = 0"),
    ("warning: invalid_volume on the latest day", "iv > 0"), ("warning: invalid_delivery_pct on the latest day", "idp > 0"), ("warning: invalid_price_field on the latest day", "ip > 0"), ("warning: missing_prev_close on the latest day", "mp > 0"), ("warning: conflicting_duplicate_symbols on the latest day", "cd > 0"), ("warning: duplicate_identical on the latest day", "di > 0"))
    + """ FROM (SELECT max(date) AS latest, arg_max(ur, date) AS n, min_by_ur AS p, arg_max(eq, date) AS eq, arg_max(ic, date) AS ic, arg_max(cd, date) AS cd, arg_max(iv, date) AS iv, arg_max(idp, date) AS idp, arg_max(ip, date) AS ip, arg_max(mp, date) AS mp, arg_max(di, date) AS di FROM (SELECT *, first_value(ur) OVER (ORDER BY date) AS min_by_ur FROM
    (SELECT date, CAST(sum(copies) AS BIGINT) AS eq, count(*) FILTER (ok) AS ur, count(*) FILTER (NOT conflict AND bad_close) AS ic, count(*) FILTER (conflict) AS cd, count(*) FILTER (ok AND bad_volume) AS iv, count(*) FILTER (ok AND bad_deliv) AS idp, count(*) FILTER (ok AND (bad_high OR bad_low OR bad_open OR crossed)) AS ip, count(*) FILTER (ok AND bad_prev) AS mp,
     coalesce(sum(copies - 1) FILTER (NOT conflict), 0) AS di FROM (SELECT *, NOT conflict AND NOT bad_close AS ok FROM judged) GROUP BY 1 ORDER BY 1 DESC LIMIT 2)) GROUP BY min_by_ur)""", RAW))
def _(spark, d):
    return Q.market_gate(C.clean_counts(raw_rows(spark, d)), "2001-11-12", "2001-11-12", SMALL_DAY)


MOVERS = "movers AS (" + _list_sql(LINE_SQL, [("gainers", "latest", "turnover >= 100 AND change_pct > 0", "change_pct DESC, symbol", 50), ("losers", "latest", "turnover >= 100 AND change_pct < 0", "change_pct, symbol", 50)]) + ")"


@query("dq_market_outputs", sql("SELECT list, rank, symbol, " + faults(("rank is not its position", "rank <> pos"), ("not in order", "k < pk"), ("differs from the symbol table", "changed")) + """ FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rank) AS pos, k, lag(k) OVER (PARTITION BY list ORDER BY rank) AS pk FROM
 (SELECT list, symbol, CASE WHEN symbol % 7 = 0 THEN rank + 100 ELSE rank END AS rank, symbol % 5 = 0 AS changed, CASE WHEN list = 'gainers' THEN -1 ELSE 1 END * (change_pct + CASE WHEN symbol % 5 = 0 THEN 1 ELSE 0 END) AS k FROM movers))""", CHANGES, MOVERS))
def _(spark, d):
    latest = M.latest_rows(W.change_1d(bars(spark, d)))
    s = F.col("symbol")
    lists = M.top_movers(latest).withColumns({"rank": F.when(s % 7 == 0, F.col("rank") + 100).otherwise(F.col("rank")), "change_pct": F.col("change_pct") + F.when(s % 5 == 0, 1).otherwise(0)})
    return Q.market_outputs(lists, latest, {"gainers": -F.col("change_pct"), "losers": F.col("change_pct")})


@query("dq_candles", sql("""SELECT symbol, CAST(dt AS VARCHAR) AS date, problem FROM (SELECT symbol, dt, """ + faults(("not strictly ascending", "dt <= lag_dt"), ("dated in the future", "dt > DATE '2001-11-05'"), ("impossible prices", "i % 37 = 0"), ("non-positive volume", "i % 41 = 0")) + """ FROM
 (SELECT *, lag(dt) OVER (PARTITION BY symbol ORDER BY date) AS lag_dt FROM (SELECT *, symbol + (date - DATE '1970-01-01') AS i, CASE WHEN (symbol + (date - DATE '1970-01-01')) % 53 = 0 THEN date - 40 WHEN date = DATE '2001-11-04' THEN DATE '2001-11-20' ELSE date END AS dt FROM bars))
 UNION ALL SELECT symbol, m, 'latest candle is too old' FROM (SELECT symbol, max(CASE WHEN (symbol + (date - DATE '1970-01-01')) % 53 = 0 THEN date - 40 WHEN date = DATE '2001-11-04' THEN DATE '2001-11-20' ELSE date END) AS m FROM bars GROUP BY 1) WHERE DATE '2001-11-05' - m > 7)""", BARS))
def _(spark, d):
    i = F.col("symbol") + F.unix_date("date")
    b = bars(spark, d).withColumns({"seq": F.unix_date("date"), "high": F.when(i % 37 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(i % 41 == 0, F.lit(0).cast("bigint")).otherwise(F.col("volume"))})
    moved = F.when(i % 53 == 0, F.date_sub("date", 40)).when(F.col("date") == "2001-11-04", F.lit("2001-11-20").cast("date")).otherwise(F.col("date"))
    return Q.candles(b.withColumn("date", moved), "2001-11-05")


@query("dq_financials", "SELECT symbol, " + faults(("equity is not assets minus liabilities", "symbol % 7 = 0"), ("ratio without positive equity", "e <= 0"), ("ratio is not liabilities over equity", "symbol % 11 = 0 OR (symbol % 7 = 0 AND e <> 0 AND abs(l / (a - l) - l / e) > 0.011)"), ("free cash flow without capex", "symbol % 13 = 0"),
    ("free cash flow is not operating minus capex", "symbol % 13 <> 0 AND symbol % 17 = 0"), ("growth without a check", "symbol % 19 = 0"), ("warning: revenue and other income differ from the total", "symbol % 23 = 0"))
    + " FROM (SELECT *, a - l + CASE WHEN symbol % 7 = 0 THEN 5 ELSE 0 END AS e FROM (SELECT o_custkey AS symbol, max(o_totalprice) AS a, min(o_totalprice) / 2 AS l FROM orders GROUP BY 1))")
def _(spark, d):
    s = F.col("symbol")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_totalprice").alias("total_assets"), (F.min("o_totalprice") / 2).alias("total_liabilities"))
    a, l = F.col("total_assets"), F.col("total_liabilities")
    rows = o.withColumns({"total_equity": a - l + F.when(s % 7 == 0, 5).otherwise(0), "liabilities_to_equity": l / (a - l) + F.when(s % 11 == 0, 1).otherwise(0), "operating": a, "capex": F.when(s % 13 != 0, l), "free_cash_flow": a - l + F.when(s % 17 == 0, 1).otherwise(0),
                          "growth": F.lit(1.0), "check": s % 19 != 0, "revenue": a, "other_income": l, "total_revenue": a + l + F.when(s % 23 == 0, 2).otherwise(0)})
    return Q.financials(rows)


METRICS = ["pe", "pb", "roe", "roa"]


@query("dq_fundamentals", sql("SELECT symbol, 'missing list is not exact' AS problem FROM ratios, (VALUES (1), (2)) t(c) WHERE (c = 1 OR symbol % 25 = 0) AND symbol % 15 = 0 AND (pe IS NULL OR pb IS NULL OR roe IS NULL OR roa IS NULL) UNION ALL SELECT symbol, 'listed more than once' FROM ratios WHERE symbol % 25 = 0", RATIOS))
def _(spark, d):
    s = F.col("symbol")
    r = S.ratios(spark, d).select("symbol", *METRICS)
    r = r.withColumn("missing", F.when(s % 15 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in METRICS]))))
    return Q.fundamentals(r.unionByName(r.where(s % 25 == 0)), METRICS)


@query("dq_sector_outputs", sql("SELECT sector_key, " + faults(("parts do not equal counted", "h % 2 = 0 OR h % 3 = 0"), ("counted exceeds members", "h % 3 = 0 AND counted + 100 > member_count"), ("eligible without figures", "eligible AND h % 5 = 0"), ("ineligible with figures", "false"), ("ineligible without a reason", "NOT eligible AND h % 2 = 1"), ("figures implausible", "(median_1d_pct NOT BETWEEN -100 AND 1000 AND h % 5 <> 0) OR mean_1d_pct NOT BETWEEN -100 AND 1000"))
    + " FROM (SELECT *, CAST(split_part(sector_key, '-', 2) AS INTEGER) AS h FROM sectors)", SECTORS))
def _(spark, d):
    h = F.split("sector_key", "-")[1].cast("int")
    s = X.sector_performance(sector_rows(spark, d), FEW)
    s = s.withColumns({"advances": F.col("advances") + F.when(h % 2 == 0, 1).otherwise(0), "counted": F.col("counted") + F.when(h % 3 == 0, 100).otherwise(0), "median_1d_pct": F.when(h % 5 != 0, F.col("median_1d_pct")), "reason": F.when(h % 2 == 0, F.col("reason"))})
    return Q.sector_outputs(s)


@query("dq_annual_ledger", sql("""SELECT symbol, fy, basis, problem FROM (SELECT symbol, fy, basis, """ + faults(("fy does not match period", "symbol % 7 = 0"), ("bad basis", "basis = 'mixed'"), ("missing list is not exact", "symbol % 6 = 0"), ("period end is not a month end", "symbol % 11 = 0"), ("free cash flow identity", "symbol % 13 = 0")) + """ FROM yb, (VALUES (1), (2)) c(c) WHERE c = 1 OR (symbol + fy) % 50 = 0
  UNION ALL SELECT symbol, fy, basis, 'key repeats' FROM yb WHERE (symbol + fy) % 50 = 0)""", YEARS, "yb AS (SELECT *, CASE WHEN symbol % 9 = 0 THEN 'mixed' ELSE 'standalone' END AS basis FROM years)"))
def _(spark, d):
    s = F.col("symbol")
    y = S.year_values(spark, d).select("symbol", "fy", F.when(s % 9 == 0, "mixed").otherwise("standalone").alias("basis"), F.make_date(F.col("fy") + F.when(s % 7 == 0, 1).otherwise(0), F.lit(12), F.when(s % 11 == 0, 30).otherwise(31)).alias("period_end"), F.when(s % 6 != 0, F.col("value")).alias("revenue"),
                                       F.col("value").alias("profit"), F.array().cast("array<string>").alias("missing"), F.col("value").alias("operating"), F.lit(1.0).alias("capex"), (F.col("value") - 1 + F.when(s % 13 == 0, 1).otherwise(0)).alias("free_cash_flow"))
    return Q.annual_ledger(y.unionByName(y.where((s + F.col("fy")) % 50 == 0)))


@query("dq_shareholding", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, """ + faults(("not a quarter end", "symbol % 7 = 0"), ("not a percentage", "symbol % 11 = 0 AND f IS NOT NULL"), ("null category without a flag", "ok AND symbol % 2 = 0 AND (p IS NULL OR f IS NULL)"), ("unavailable with values", "NOT ok AND coalesce(p, f) IS NOT NULL"), ("unavailable without a reason", "NOT ok AND symbol % 2 = 1"), ("bad status", "symbol % 13 = 5"))
    + """ FROM (SELECT symbol, CASE WHEN symbol % 7 = 0 THEN period_end - 31 ELSE period_end END AS period_end, max(shares) FILTER (category = 'promoters') AS p, max(shares) FILTER (category = 'fii') AS f, symbol % 13 <> 5 AND symbol % 10 <> 3 AS ok FROM holdings GROUP BY ALL)""", HOLDINGS))
def _(spark, d):
    s = F.col("symbol")
    q = S.holdings(spark, d).groupBy("symbol", "period_end").agg(F.max(F.when(F.col("category") == "promoters", F.lit(10.0))).alias("promoters"), F.max(F.when(F.col("category") == "fii", F.when(s % 11 == 0, 200.0).otherwise(20.0))).alias("fii"))
    q = q.withColumns({"period_end": F.when(s % 7 == 0, F.date_sub("period_end", 31)).otherwise(F.col("period_end")), "flags": F.when(s % 2 == 0, "").otherwise("row_missing:x"), "status": F.when(s % 13 == 5, "odd").when(s % 10 == 3, "unavailable").otherwise("available"),
                       "reason": F.when(s % 2 == 0, "why"), "other_dii": F.coalesce("promoters", "fii"), "mutual_funds": F.coalesce("promoters", "fii"), "retail_other": F.coalesce("promoters", "fii")})
    return Q.shareholding(q)




@query("dq_master", """WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE 'INE' END || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS isin, 'S' || CASE WHEN s_suppkey % 14 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS sym FROM supplier)
SELECT isin, problem FROM (SELECT isin, """ + faults(("invalid ISIN", "k % 7 = 0"), ("sector key does not match the label", "k % 5 = 0 AND k % 9 <> 8"), ("a fund must not carry a sector", "k % 13 = 12 AND k % 9 <> 8"), ("classified without class and sector", "k % 13 = 12 OR k % 9 = 8"), ("current symbol in its history", "k % 10 = 0"))
    + """ FROM m UNION ALL SELECT min(isin), 'symbol belongs to two ISINs' FROM m GROUP BY sym HAVING count(*) > 1)""")
def _(spark, d):
    k = F.col("s_suppkey")
    lab = F.when(k % 9 != 8, F.col("s_name"))
    m = table(spark, d, "supplier").select(F.when(k % 7 == 0, F.concat(F.lit("x"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))).alias("isin"), F.concat(F.lit("S"), F.when(k % 14 == 1, k - 1).otherwise(k)).alias("symbol"),
                                           F.when(k % 10 == 0, F.array(F.concat(F.lit("S"), F.when(k % 14 == 1, k - 1).otherwise(k)))).otherwise(F.array().cast("array<string>")).alias("symbol_history"), F.when(k % 13 == 12, "etf").otherwise("operating_equity").alias("instrument_class"),
                                           lab.alias("label"), F.when(k % 5 == 0, F.concat(slug(lab), F.lit("-x"))).otherwise(slug(lab)).alias("sector_key"), F.lit("classified").alias("status"))
    return Q.master(m)


def entries(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.when(k % 40 == 0, F.concat(F.lit("P "), k)).when(k % 31 == 0, F.concat(F.lit("P"), k - 1)).otherwise(F.concat(F.lit("P"), k)).alias("symbol"),
                                          F.when(k % 50 == 7, "bad").otherwise(F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))).alias("isin"), F.when(k % 60 == 1, " ").otherwise(F.col("p_name")).alias("name"))


@query("dq_directory", """WITH e AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN 'P ' || p_partkey WHEN p_partkey % 31 = 0 THEN 'P' || (p_partkey - 1) ELSE 'P' || p_partkey END AS symbol, CASE WHEN p_partkey % 50 = 7 THEN 'bad' ELSE 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isin, CASE WHEN p_partkey % 60 = 1 THEN ' ' ELSE p_name END AS name FROM part)
SELECT symbol, """ + faults(("symbol", "contains(symbol, ' ')"), ("isin", "isin = 'bad'"), ("name", "name = ' '")) + """ FROM e UNION ALL SELECT symbol, 'symbol listed twice' FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT min(symbol), 'isin listed twice' FROM e GROUP BY isin HAVING count(*) > 1 UNION ALL SELECT '', 'count differs'""")
def _(spark, d):
    e = cut_lineage(entries(spark, d), "entries")
    true_hash = R.group_hash(e.select(F.lit("directory").alias("g"), F.concat_ws("|", "symbol", "isin", "name").alias("line")), "g", "line")
    return Q.directory(e, true_hash.select((F.col("rows") + 1).alias("rows"), "hash"))


@query("dq_quarterly", sql("""SELECT symbol, CAST(quarter_end AS VARCHAR) AS quarter_end, problem FROM (SELECT symbol, quarter_end, """ + faults(("identity differs", "symbol % 9 = 0"), ("empty quarter", "symbol % 4 = 0"), ("not newest first", "quarter_end >= pq"), ("not a month end", "false")) + """ FROM (SELECT *, lag(quarter_end) OVER (PARTITION BY symbol ORDER BY seq) AS pq FROM qd)
 UNION ALL SELECT symbol, quarter_end, 'duplicate quarter' FROM qd GROUP BY 1, 2 HAVING count(*) > 1)""", QUARTERS, "qd AS (SELECT *, CASE WHEN symbol % 5 = 0 THEN (quarter_end - DATE '1970-01-01') ELSE -(quarter_end - DATE '1970-01-01') END * 2 + c AS seq FROM quarters, (VALUES (0), (1)) t(c) WHERE c = 0 OR (symbol + year(quarter_end)) % 40 = 0)"))
def _(spark, d):
    s = F.col("symbol")
    q = S.quarter_values(spark, d).withColumn("c", F.explode(F.when((s + F.year("quarter_end")) % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    q = q.select("symbol", "quarter_end", F.concat(F.lit("I"), s).alias("isin"), F.when(s % 4 != 0, F.col("revenue")).alias("revenue"), F.when(s % 4 != 0, F.col("profit")).alias("profit"),
                 (F.when(s % 5 == 0, F.unix_date("quarter_end")).otherwise(-F.unix_date("quarter_end")) * 2 + F.col("c")).alias("seq"))
    ident = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 9 == 0, "other").otherwise(F.concat(F.lit("I"), "c_custkey")).alias("isin"))
    return Q.quarterly(q, ident, ["revenue", "profit"])


@query("dq_universe", """SELECT * FROM (SELECT symbol, """ + faults(("symbol", "k % 40 = 0"), ("isin", "k % 50 = 7")) + """ FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 = 0 THEN 'P ' || p_partkey ELSE 'P' || p_partkey END AS symbol FROM part WHERE p_partkey % 6 <> 0)) UNION ALL SELECT '', 'too many vanished'""")
def _(spark, d):
    k = F.col("p_partkey")
    u = table(spark, d, "part").select(k, F.when(k % 40 == 0, F.concat(F.lit("P "), k)).otherwise(F.concat(F.lit("P"), k)).alias("symbol"), F.when(k % 50 == 7, "bad").otherwise(F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))).alias("isin"))
    return Q.universe(u.where(k % 6 != 0).select("symbol", "isin"), u.select("symbol", "isin"), minimum=1)


@query("dq_batch", """SELECT CAST(symbol AS VARCHAR) AS symbol, problem FROM (SELECT symbol, """ + faults(("no final outcome", "symbol % 10 = 9"), ("success with an error", "good AND symbol % 7 = 0"), ("success not fetched in this batch", "good AND symbol % 11 = 0"), ("failed without an error", "symbol % 10 = 8 AND symbol % 7 <> 0"), ("published under another ISIN", "symbol % 13 = 0"))
    + """ FROM (SELECT c_custkey AS symbol, c_custkey % 10 < 8 AS good FROM customer)) UNION ALL SELECT '', 'failure rate too high'""")
def _(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.cast("string").alias("symbol"), k.alias("k"))
    s = F.col("k")
    planned = c.select("symbol", F.when(s % 10 == 9, "pending").when(s % 10 == 8, "failed").when(s % 10 < 5, "ok").otherwise("partial").alias("outcome"))
    records = c.select("symbol", F.when(s % 7 == 0, "HTTP 500").alias("error"), (s % 11 != 0).alias("fetched_in_batch"), F.lit("I1").alias("isin"))
    return Q.batch(planned, records, c.select("symbol", F.when(s % 13 == 0, "I2").otherwise("I1").alias("isin")))


# ---------------------------------------------------------------- classes of each symbol of the remaining coverage modules
from barloom.operators import coverage as V  # noqa: E402


def _classes(name, klass, sql_class, source, models):
    cols = ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in V.CLASSES)
    pct = lambda n, den: f"round(100.0::DOUBLE * {n} / {den}, 2)"
    vs = "count(*) FILTER (class IN ('valid', 'stale'))"
    text = f"""SELECT '{name}' AS module, count(*) AS denominator, {cols}, {pct(vs, 'count(*)')} AS coverage_pct, {pct(vs, "nullif(count(*) - count(*) FILTER (class = 'not_applicable'), 0)")} AS coverage_pct_of_applicable,
      {pct("count(*) FILTER (class = 'valid')", 'count(*)')} AS fresh_pct, true AS adds_up FROM (SELECT {sql_class} AS class FROM {source})"""

    @query(f"cov_{name}", sql(text, *models))
    def _(spark, d):
        return V.coverage_module(klass(spark, d).withColumn("module", F.lit(name)))


def _cust(spark, d, df):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"))
    return c.join(df, "symbol", "left")


TODAY = "2001-08-05"


def _now():
    return F.lit(TODAY).cast("date")


_classes("directory", lambda sp, d: entries(sp, d).select(F.when(~F.col("symbol").rlike(R.SYMBOL), "invalid").when(~F.col("isin").rlike(R.ISIN), "missing").when(F.trim("name") == "", "unverified").otherwise("valid").alias("class")),
         "CASE WHEN p_partkey % 40 = 0 THEN 'invalid' WHEN p_partkey % 50 = 7 THEN 'missing' WHEN p_partkey % 60 = 1 THEN 'unverified' ELSE 'valid' END", "part", [])
_classes("fundamentals", lambda sp, d: S.ratios(sp, d).select(F.when(F.col("fetched").isNull(), "missing").when(F.coalesce("pe", "pb", "roe").isNull(), "invalid").when(F.datediff(_now(), "fetched") > 180, "stale").otherwise("valid").alias("class")),
         f"CASE WHEN fetched IS NULL THEN 'missing' WHEN coalesce(pe, pb, roe) IS NULL THEN 'invalid' WHEN DATE '{TODAY}' - fetched > 180 THEN 'stale' ELSE 'valid' END", "ratios", [RATIOS])
_classes("growth", lambda sp, d: _cust(sp, d, S.year_values(sp, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))).select(F.when(F.col("n").isNull(), "missing").when(F.col("n") < 2, "not_applicable").otherwise("valid").alias("class")),
         "CASE WHEN n IS NULL THEN 'missing' WHEN n < 2 THEN 'not_applicable' ELSE 'valid' END", "customer LEFT JOIN (SELECT symbol, count(*) AS n FROM years GROUP BY 1) ON symbol = c_custkey", [YEARS])
_classes("financial_history", lambda sp, d: _cust(sp, d, S.year_values(sp, d).groupBy("symbol").agg(F.max("fy").alias("fy"))).select(F.when(F.col("fy").isNull(), "missing").when(F.col("fy") < 2000, "stale").otherwise("valid").alias("class")),
         "CASE WHEN fy IS NULL THEN 'missing' WHEN fy < 2000 THEN 'stale' ELSE 'valid' END", "customer LEFT JOIN (SELECT symbol, max(fy) AS fy FROM years GROUP BY 1) ON symbol = c_custkey", [YEARS])
_classes("candles", lambda sp, d: table(sp, d, "supplier").select(F.col("s_suppkey").alias("symbol")).join(bars(sp, d).groupBy("symbol").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("n")), "symbol", "left").select(
    F.when(F.col("n").isNull(), "missing").when(F.col("n") < 20, "invalid").when(F.datediff(F.lit("2001-11-05"), "last") > 7, "stale").otherwise("valid").alias("class")),
    "CASE WHEN n IS NULL THEN 'missing' WHEN n < 20 THEN 'invalid' WHEN DATE '2001-11-05' - last > 7 THEN 'stale' ELSE 'valid' END", "supplier LEFT JOIN (SELECT symbol, max(date) AS last, count(*) AS n FROM bars GROUP BY 1) ON symbol = s_suppkey", [BARS])
_classes("sector", lambda sp, d: table(sp, d, "supplier").select(F.col("s_suppkey").alias("symbol")).join(S.sector_master(sp, d), "symbol", "left").select(
    F.when(F.col("instrument_class").isNull(), "missing").when(F.col("instrument_class") == "etf", "not_applicable").when(F.col("sector_source_label").isNull(), "unverified").when(F.datediff(F.lit("2001-11-04"), "last_confirmed") > 60, "stale").otherwise("valid").alias("class")),
    "CASE WHEN s_suppkey % 17 = 16 THEN 'missing' WHEN s_suppkey % 13 = 12 THEN 'not_applicable' WHEN s_suppkey % 9 = 8 THEN 'unverified' WHEN s_suppkey % 63 > 60 THEN 'stale' ELSE 'valid' END", "supplier", [])
_classes("shareholding", lambda sp, d: _cust(sp, d, S.holdings(sp, d).groupBy("symbol", "period_end").agg(F.count(F.lit(1)).alias("k")).groupBy("symbol").agg(F.max("period_end").alias("last"), F.max_by("k", "period_end").alias("k"))).select(
    F.when(F.col("last").isNull(), "missing").when(F.col("k") < 2, "invalid").when(F.col("last") < "2000-12-31", "stale").otherwise("valid").alias("class")),
    "CASE WHEN last IS NULL THEN 'missing' WHEN k < 2 THEN 'invalid' WHEN last < DATE '2000-12-31' THEN 'stale' ELSE 'valid' END", "customer LEFT JOIN (SELECT symbol, max(period_end) AS last, arg_max(k, period_end) AS k FROM (SELECT symbol, period_end, count(*) AS k FROM holdings GROUP BY 1, 2) GROUP BY 1) ON symbol = c_custkey", [HOLDINGS])


# ---------------------------------------------------------------- growth events
@query("growth_event_validity", """SELECT event_id, CASE WHEN k = 0 THEN st0 IS NULL OR (st0 = 'announced' AND event_id % 3 = 0) WHEN k = 1 THEN st0 IS NULL WHEN k = 2 THEN st0 IS NULL OR st0 = ['completed', 'approved', 'planned'][1 + event_id % 3] WHEN k = 3 THEN st0 IS NULL OR (event_id % 2 = 0 AND st0 IN ('planned', 'approved', 'announced')) OR (event_id % 2 = 1 AND st0 = 'completed')
 ELSE event_id % 9 <> 0 END AND value > 0 AND event_id % 10 <> 0 AND event_id % 15 <> 1 AS valid FROM (SELECT *, user_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN 'announced' WHEN 1 THEN 'completed' WHEN 2 THEN 'approved' WHEN 3 THEN 'planned' END AS st0 FROM events)""")
def _(spark, d):
    i, k = F.col("event_id"), F.col("user_id") % 5
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", pick(["order", "order_book", "capex", "capacity", "business"], k).alias("event_type"),
        F.when(k == 0, pick(["order_announced", "order_inflow", "deal_value_tcv"], i % 3)).when(k == 1, "order_book").when(k == 2, pick(["capex_actual", "capex_approved", "capex_planned"], i % 3)).when(k == 3, pick(["capacity_planned", "capacity_operational"], i % 2)).when(i % 9 == 0, "order_book").alias("measure"),
        F.when(i % 5 != 4, pick(["announced", "completed", "approved", "planned", ""], i % 5)).alias("status"), "value", F.lit("INR").alias("currency"), F.when(i % 15 != 1, "crore").alias("unit"), F.lit("Title").alias("title"), F.lit("TCS").alias("symbol"),
        F.when(i % 20 == 0, "2026-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(i % 20 == 10, "http://x.com").otherwise("https://x.com/a?b=1").alias("source_url"), F.lit("Company").alias("source_name"), F.lit("quote").alias("evidence_quote"))
    return e.select("event_id", Q.growth_event_valid().alias("valid"))
