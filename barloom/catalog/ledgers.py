"""Ledger merges and no-loss checks over "before" and "after" versions derived from the supplied tables by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.model_sql import BARS, HOLDINGS, RATIOS, YEARS, sql
from barloom.catalog.registry import query
from barloom.catalog.statements import HOLDERS, holders
from barloom.operators import ledger as L
from barloom.sources import market as S
from barloom.sources.market import bars, table



def day(text="2001-08-05"):
    return F.lit(text).cast("date")


def _basis():
    return F.when(F.col("symbol") % 3 == 0, "standalone").otherwise("consolidated")


def _revs(cond):
    one = F.array(F.struct(F.lit("2001-01-01").cast("date").alias("superseded_on"), F.create_map(F.lit("revenue"), F.lit(1.0)).alias("values")))
    return F.when(cond, one).otherwise(F.array().cast(L.REVISION))


def old_years(spark, d):
    s, y = F.col("symbol"), S.year_values(spark, d)
    return y.where((s + F.col("fy")) % 7 != 0).select("symbol", "fy", _basis().alias("basis"), F.when(s % 9 == 0, "official").otherwise("api").alias("provider"), F.when(s % 13 == 0, 3).otherwise(12).alias("month"),
                                                      F.col("value").alias("revenue"), F.when(s % 6 != 0, F.col("lines").cast("double")).alias("profit"), _revs(s % 10 == 0).alias("revisions"))


def new_years(spark, d):
    s, y = F.col("symbol"), S.year_values(spark, d)
    return y.where("fy >= 1998").select("symbol", "fy", _basis().alias("basis"), F.lit("api").alias("provider"), F.lit(12).alias("month"), (F.col("value") + F.when(s % 5 == 0, 10.0).otherwise(0.0)).alias("revenue"),
                                        F.when(s % 4 != 0, F.col("lines").cast("double")).alias("profit"))


VERSIONS = YEARS + """,
v AS (SELECT *, CASE WHEN symbol % 3 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis, (symbol + fy) % 7 <> 0 AS has_old, fy >= 1998 AS has_new, CASE WHEN symbol % 6 <> 0 THEN lines::DOUBLE END AS old_profit,
  CASE WHEN symbol % 4 <> 0 THEN lines::DOUBLE END AS new_profit, value + CASE WHEN symbol % 5 = 0 THEN 10 ELSE 0 END AS new_revenue FROM years),
m AS (SELECT *, has_old AND has_new AND symbol % 9 = 0 AS skipped, has_old AND has_new AND symbol % 13 = 0 AS refused FROM v WHERE has_old OR has_new),
t AS (SELECT *, has_new AND NOT skipped AND NOT refused AS take FROM m)"""


@query("merge_annual_ledger", sql("""SELECT symbol, fy, basis, CASE WHEN has_old AND symbol % 9 = 0 THEN 'official' ELSE 'api' END AS provider, CASE WHEN take THEN new_revenue ELSE value END AS revenue, CASE WHEN take THEN coalesce(new_profit, CASE WHEN has_old THEN old_profit END) ELSE old_profit END AS profit,
 CASE WHEN NOT has_new THEN 'untouched' WHEN skipped THEN 'skipped_other_provider' WHEN refused THEN 'refused_year_end' WHEN NOT has_old THEN 'created' WHEN symbol % 5 = 0 THEN 'revised' WHEN old_profit IS NULL AND new_profit IS NOT NULL THEN 'filled' ELSE 'confirmed' END AS event,
 (has_old AND symbol % 10 = 0)::INT + (has_old AND take AND symbol % 5 = 0)::INT AS revisions, CASE WHEN has_old AND take AND symbol % 5 = 0 THEN value WHEN has_old AND symbol % 10 = 0 THEN 1.0::DOUBLE END AS last_superseded FROM t""", VERSIONS))
def _(spark, d):
    m = L.merge_annual(old_years(spark, d), new_years(spark, d), ["revenue", "profit"], day())
    return m.select("symbol", "fy", "basis", "provider", "revenue", "profit", "event", F.size("revisions").alias("revisions"), F.try_element_at("revisions", F.lit(-1))["values"]["revenue"].alias("last_superseded"))


@query("merge_official", sql("""SELECT symbol, fy, basis, CASE WHEN NOT has_old THEN 'official' WHEN symbol % 9 = 0 THEN 'official' ELSE 'api' END AS provider, CASE WHEN k IN ('created', 'revised', 'confirmed') THEN new_revenue ELSE value END AS revenue, k AS event, CASE WHEN k IN ('created', 'revised', 'confirmed') THEN CASE WHEN new_profit IS NULL THEN 'revenue' ELSE 'profit,revenue' END ELSE '' END AS sourced
 FROM (SELECT *, CASE WHEN NOT has_new THEN 'untouched' WHEN has_old AND symbol % 9 <> 0 THEN 'kept_other_provider' WHEN NOT has_old THEN 'created' WHEN symbol % 5 = 0 THEN 'revised' ELSE 'confirmed' END AS k FROM (SELECT * REPLACE (has_new AND symbol IN (SELECT symbol FROM v WHERE has_old) AS has_new) FROM v) WHERE has_old OR has_new)""", VERSIONS))
def _(spark, d):
    old = old_years(spark, d).withColumn("fields", F.create_map().cast("map<string,string>"))
    off = new_years(spark, d).withColumn("source", F.lit("annual report"))
    m = L.merge_official(old, off, ["revenue", "profit"], day())
    return m.select("symbol", "fy", "basis", "provider", "revenue", "event", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("sourced"))


@query("merge_quarterly", sql("""SELECT symbol, CAST(make_date(fy, 12, 31) AS VARCHAR) AS quarter_end, CASE WHEN symbol % 9 = 0 AND has_any THEN 'standalone' ELSE 'consolidated' END AS basis, CASE WHEN has_new THEN new_revenue ELSE value END AS revenue,
 CASE WHEN NOT has_new THEN 'untouched' WHEN NOT o THEN 'added' WHEN symbol % 5 = 0 OR (old_profit IS NULL AND new_profit IS NOT NULL) THEN 'changed' ELSE 'unchanged' END AS event, (o AND has_new AND symbol % 5 = 0)::INT AS revisions
 FROM (SELECT *, has_old AND NOT (symbol % 9 = 0 AND has_any) AS o FROM (SELECT *, bool_or(has_new) OVER (PARTITION BY symbol) AS has_any FROM v)) WHERE o OR has_new""", VERSIONS))
def _(spark, d):
    qe = F.make_date("fy", F.lit(12), F.lit(31)).alias("quarter_end")
    old = old_years(spark, d).select("symbol", qe, F.lit("consolidated").alias("basis"), "revenue", "profit", F.array().cast("array<struct<field:string,previous:double,changed_on:date>>").alias("revisions"))
    new = new_years(spark, d).select("symbol", qe, F.when(F.col("symbol") % 9 == 0, "standalone").otherwise("consolidated").alias("basis"), "revenue", "profit")
    m = L.merge_quarterly(old, new, ["revenue", "profit"], day())
    return m.select("symbol", "quarter_end", "basis", "revenue", "event", F.size("revisions").alias("revisions"))


def wide_holdings(spark, d):
    return S.holdings(spark, d).groupBy("symbol", "period_end").agg(*[F.max(F.when(F.col("category") == c, F.col("shares"))).alias(c) for c in ("promoters", "fii")])


WIDE = HOLDINGS + """,
wide AS (SELECT symbol, year(period_end) AS fy, period_end, max(shares) FILTER (category = 'promoters') AS p, max(shares) FILTER (category = 'fii') AS f FROM holdings GROUP BY 1, 2, 3),
sh AS (SELECT *, (symbol + fy) % 7 <> 0 AS o, fy >= 1998 AS n, symbol % 8 <> 1 AS o_ok, symbol % 11 <> 2 AS n_ok, CASE WHEN symbol % 6 <> 0 THEN p END AS np, f + CASE WHEN symbol % 5 = 0 THEN 1 ELSE 0 END AS nf FROM wide),
ev AS (SELECT *, CASE WHEN NOT n THEN 'untouched' WHEN NOT o THEN 'added' WHEN o_ok AND NOT n_ok THEN 'kept-existing' WHEN NOT o_ok AND n_ok THEN 'resurrected' WHEN NOT o_ok THEN 'refreshed' WHEN (symbol % 5 = 0 AND f IS NOT NULL) OR symbol % 12 = 0 THEN 'revised' WHEN p IS NOT NULL AND np IS NULL THEN 'refreshed' ELSE 'unchanged' END AS event FROM sh WHERE o OR n)"""


@query("merge_shareholding", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, event, CASE WHEN event IN ('added', 'resurrected', 'refreshed', 'revised') THEN CASE WHEN event = 'resurrected' OR NOT o THEN np WHEN o_ok THEN coalesce(np, p) ELSE np END ELSE CASE WHEN o_ok THEN p END END AS promoters,
 CASE WHEN event IN ('added', 'resurrected', 'refreshed', 'revised') THEN CASE WHEN NOT n_ok THEN NULL ELSE nf END WHEN o_ok THEN f END AS fii, (event IN ('resurrected', 'revised'))::INT AS revisions FROM (SELECT * REPLACE (CASE WHEN n_ok THEN np END AS np) FROM ev)""", WIDE))
def _(spark, d):
    s, w = F.col("symbol"), wide_holdings(spark, d)
    o_ok, n_ok = s % 8 != 1, s % 11 != 2
    old = w.where((s + F.year("period_end")) % 7 != 0).select("symbol", "period_end", F.when(o_ok, "available").otherwise("unavailable").alias("status"), F.lit("r1").alias("record_id"), F.when(o_ok, None).otherwise("old reason").alias("reason"),
                                                              *[F.when(o_ok, F.col(c)).alias(c) for c in ("promoters", "fii")], F.lit(0).alias("revisions"))
    new = w.where(F.year("period_end") >= 1998).select("symbol", "period_end", F.when(n_ok, "available").otherwise("unavailable").alias("status"), F.when(s % 12 == 0, "r2").otherwise("r1").alias("record_id"), F.when(n_ok, None).otherwise("new reason").alias("reason"),
                                                       F.when(n_ok & (s % 6 != 0), F.col("promoters")).alias("promoters"), F.when(n_ok, F.col("fii") + F.when(s % 5 == 0, 1.0).otherwise(0.0)).alias("fii"))
    m = L.merge_shareholding(old, new, ["promoters", "fii"], day())
    return m.select("symbol", "period_end", "event", "promoters", "fii", "revisions")


@query("relabel_fill_holders", sql("SELECT symbol, member, CASE WHEN section IS NULL THEN 'old section' ELSE section END AS section, CASE WHEN section IS NULL THEN 'old label' ELSE label END AS label FROM holders", HOLDERS))
def _(spark, d):
    h = holders(spark, d).withColumns({"section": F.lit("old section"), "category": F.lit("old category"), "label": F.lit("old label")})
    return L.relabel_holders(h).select("symbol", "member", "section", "label")


@query("fill_holders", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, CASE WHEN symbol % 4 = 0 THEN 'kept' WHEN fy < 1998 THEN 'named-unavailable' WHEN symbol % 5 = 0 AND f IS NOT NULL THEN 'named-skipped' ELSE 'named-added' END AS event FROM wide""", WIDE))
def _(spark, d):
    s, w = F.col("symbol"), wide_holdings(spark, d)
    stored = w.withColumn("holders", F.when(s % 4 == 0, "stored"))
    reread = w.where(F.year("period_end") >= 1998).select("symbol", "period_end", "promoters", (F.col("fii") + F.when(s % 5 == 0, 1.0).otherwise(0.0)).alias("fii"), F.lit("read").alias("holders"))
    return L.fill_holders(stored, reread, ["promoters", "fii"]).select("symbol", "period_end", "event")


@query("normalise_ledger", sql("""SELECT y.symbol, y.fy, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'financial' ELSE 'standard' END AS layout, CASE WHEN y.symbol % 4 = 0 AND y.symbol % 6 = 0 THEN 'incomplete' ELSE 'verified' END AS status,
 CASE WHEN y.symbol % 4 = 0 AND y.symbol % 6 = 0 THEN 'revenue,profit' WHEN y.symbol % 4 = 0 THEN 'revenue' WHEN y.symbol % 6 = 0 THEN 'profit' ELSE '' END AS missing FROM years y JOIN customer ON c_custkey = y.symbol""", YEARS))
def _(spark, d):
    s = F.col("symbol")
    y = S.year_values(spark, d).groupBy("symbol").agg(F.collect_list(F.struct("fy", F.struct(F.when(s % 4 != 0, F.col("value")).alias("revenue"), F.when(s % 6 != 0, F.col("lines").cast("double")).alias("profit")).alias("values"))).alias("years"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_mktsegment") == "FURNITURE", "Bank").otherwise(F.col("c_mktsegment")).alias("sector"))
    n = L.normalise_ledger(y.join(c, "symbol"), ["revenue", "profit"])
    return n.select("symbol", "layout", F.explode("years").alias("y")).select("symbol", "y.fy", "layout", "y.status", F.array_join("y.missing", ",").alias("missing"))


@query("seed_from_saved", sql("""SELECT symbol, CASE WHEN symbol % 3 = 0 THEN 'saved' WHEN symbol % 4 = 0 THEN 'working' WHEN symbol % 5 = 0 THEN 'saved' ELSE 'working' END AS v, CASE WHEN symbol % 3 = 0 THEN 'added' WHEN symbol % 4 = 0 THEN 'kept_working' WHEN symbol % 5 = 0 THEN 'from_saved' ELSE 'kept_working' END AS outcome FROM (SELECT c_custkey AS symbol FROM customer)"""))
def _(spark, d):
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    work = c.where(k % 3 != 0).select(k.alias("symbol"), F.lit("working").alias("v"), day().alias("stamp"))
    saved = c.where((k % 4 != 0) | (k % 3 == 0)).select(k.alias("symbol"), F.lit("saved").alias("v"), F.when(k % 5 == 0, day("2001-09-01")).otherwise(day()).alias("stamp"))
    return L.seed_from_saved(work, saved, ["symbol"], ["v"], "stamp").select("symbol", "v", "outcome")


@query("merge_state_parts", sql("""SELECT symbol, CASE WHEN symbol % 2 = 0 THEN pe + 1 ELSE pe END AS pe, CASE WHEN symbol % 3 = 0 THEN roe + 1 ELSE roe END AS roe, false AS added FROM ratios""", RATIOS))
def _(spark, d):
    s = F.col("symbol")
    r = S.ratios(spark, d).select("symbol", "pe", day().alias("pe_on"), "roe", day().alias("roe_on"))
    dur = r.select("symbol", (F.col("pe") + 1).alias("pe"), F.when(s % 2 == 0, day("2001-08-06")).otherwise(day()).alias("pe_on"), (F.col("roe") + 1).alias("roe"), F.when(s % 3 == 0, day("2001-08-06")).alias("roe_on"))
    return L.merge_state_parts(r, dur, "symbol", {"pe_on": ["pe"], "roe_on": ["roe"]}).select("symbol", "pe", "roe", "added")


MASTERS = """
k AS (SELECT s_suppkey AS k, n_name, s_suppkey % 6 <> 5 AS o, s_suppkey % 7 <> 6 AS n, 'S' || s_suppkey AS os, 'S' || s_suppkey || CASE WHEN s_suppkey % 10 = 0 THEN 'N' ELSE '' END AS ns, CASE WHEN s_suppkey % 9 <> 0 THEN n_name END AS ol, CASE WHEN s_suppkey % 4 = 0 THEN n_name WHEN s_suppkey % 4 = 1 THEN 'New' END AS nl,
  s_suppkey % 4 = 2 AS ans, s_suppkey % 8 = 3 AS att, CASE WHEN s_suppkey % 13 = 12 THEN 'etf' ELSE 'operating_equity' END AS kl FROM supplier JOIN nation ON s_nationkey = n_nationkey),
mm AS (SELECT *, CASE WHEN NOT n THEN ol WHEN nl IS NOT NULL THEN nl WHEN ans THEN NULL WHEN o THEN ol END AS label FROM k WHERE o OR n)"""


def masters(spark, d):
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))            # fixed list of countries
    old = b.where(k % 6 != 5).select(k.alias("isin"), F.concat(F.lit("S"), k).alias("symbol"), F.array().cast("array<string>").alias("symbol_history"), F.lit("operating_equity").alias("instrument_class"), F.when(k % 9 != 0, F.col("n_name")).alias("label"), day("2001-01-01").alias("last_confirmed"),
                                     F.lit("classified").alias("status"), F.array().cast(L.MASTER_REVISION).alias("revisions"))
    seen = b.where(k % 7 != 6).select(k.alias("isin"), F.concat(F.lit("S"), k, F.when(k % 10 == 0, "N").otherwise("")).alias("symbol"), F.when(k % 13 == 12, "etf").otherwise("operating_equity").alias("instrument_class"),
                                      F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, "New").alias("label"), (k % 4 == 2).alias("answered"), (k % 8 == 3).alias("attempted"))
    return old, seen


@query("merge_sector_master", sql("""SELECT k AS isin, CASE WHEN n THEN ns ELSE os END AS symbol, CASE WHEN o AND n AND os <> ns THEN os ELSE '' END AS history, label, CASE WHEN NOT n THEN 'absent' WHEN o AND nl IS NULL AND NOT ans AND att AND ol IS NOT NULL AND kl = 'operating_equity' THEN 'unconfirmed' WHEN kl = 'etf' THEN 'etf' WHEN label IS NOT NULL THEN 'classified' ELSE 'unclassified' END AS status,
 CASE WHEN o AND n THEN (os <> ns)::INT + (kl <> 'operating_equity')::INT + (ol IS DISTINCT FROM label)::INT ELSE 0 END AS revisions FROM mm""", MASTERS))
def _(spark, d):
    m = L.merge_sector_master(*masters(spark, d), day())
    return m.select("isin", "symbol", F.array_join("symbol_history", ",").alias("history"), "label", "status", F.size("revisions").alias("revisions"))


@query("no_loss_master", sql("""SELECT *, array_to_string(list_filter([CASE WHEN vanished > 0 THEN 'vanished' END, CASE WHEN old_labelled > 0 AND new_labelled < old_labelled * 0.9 THEN 'classified_fell' END, CASE WHEN old_labelled > 0 AND cleared > old_labelled * 0.1 THEN 'labels_cleared' END], lambda x: x IS NOT NULL), ',') AS problems FROM
 (SELECT count(*) FILTER (o AND NOT n) AS vanished, count(*) FILTER (o AND ol IS NOT NULL) AS old_labelled, count(*) FILTER (n AND kl = 'operating_equity' AND nl IS NOT NULL) AS new_labelled, count(*) FILTER (o AND n AND ol IS NOT NULL AND nl IS NULL) AS cleared FROM k)""", MASTERS))
def _(spark, d):
    return L.no_loss_master(*masters(spark, d))


@query("hold_isin_change", sql("""SELECT symbol, outcome, CASE WHEN outcome = 'kept' THEN pe WHEN outcome = 'restored' THEN 9.0::DOUBLE END AS pe FROM (SELECT symbol, pe, CASE WHEN symbol % 10 = 7 AND symbol % 3 = 0 THEN 'restored' WHEN symbol % 10 = 7 THEN 'still_held' WHEN symbol % 3 = 1 AND fetched IS NOT NULL THEN 'held' ELSE 'kept' END AS outcome FROM ratios)""", RATIOS))
def _(spark, d):
    s, r = F.col("symbol"), S.ratios(spark, d)
    h = s % 10 == 7
    rec = r.select("symbol", F.when(~h, F.lit("I1")).alias("isin"), F.when(~h, F.col("fetched")).alias("fetched"), F.when(~h, F.col("pe")).alias("pe"), F.when(h, F.struct(F.lit("I0").alias("isin"), day().alias("fetched"), F.lit(9.0).alias("pe"))).alias("held"))
    listed = r.select("symbol", F.when(h & (s % 3 == 0), "I0").when(~h & (s % 3 == 1), "I2").otherwise("I1").alias("isin"))
    return L.hold_isin_change(rec, listed, ["pe"]).select("symbol", "outcome", "pe")


@query("observe_upsert", """SELECT CAST(d AS VARCHAR) AS requested, CASE WHEN n AND i % 4 = 0 THEN 'b' ELSE 'a' END AS answer, CASE WHEN n AND (NOT o OR i % 4 = 0) THEN '2001-08-05' ELSE '2001-07-01' END AS first_seen, CASE WHEN n THEN '2001-08-05' ELSE '2001-07-02' END AS last_checked,
 CASE WHEN NOT n THEN i % 3 + 1 WHEN o AND i % 4 <> 0 THEN least(3, i % 3 + 2) ELSE 1 END AS checks FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS i, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 2 = 0 AS o, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 5 <> 0 AS n FROM orders) WHERE o OR n""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("requested")).distinct()
    i = F.unix_date("requested")
    old = o.where(i % 2 == 0).select("requested", F.lit("a").alias("answer"), day("2001-07-01").alias("first_seen"), day("2001-07-02").alias("last_checked"), (i % 3 + 1).alias("checks"))
    return L.observe_upsert(old, o.where(i % 5 != 0).select("requested", F.when(i % 4 == 0, "b").otherwise("a").alias("answer"), day().alias("day")))


@query("no_loss_annual", sql("""SELECT symbol, fy, basis, unnest(list_filter([CASE WHEN NOT here THEN 'record removed' END, CASE WHEN here AND symbol % 9 = 0 THEN 'provider changed' END, CASE WHEN here AND symbol % 30 = 0 THEN 'revision history changed' END, CASE WHEN here AND symbol % 5 = 0 AND symbol % 4 <> 0 THEN 'revenue changed without a revision' END,
 CASE WHEN here AND symbol % 6 <> 0 AND symbol % 4 = 0 THEN 'profit: a value was lost' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT *, fy < 2000 OR symbol % 2 = 1 OR symbol % 5 = 0 AS here FROM v WHERE has_old)""", VERSIONS))
def _(spark, d):
    s = F.col("symbol")
    old = old_years(spark, d)
    new = old.where((F.col("fy") < 2000) | (s % 2 == 1) | (s % 5 == 0)).withColumns({
        "provider": F.when(s % 9 == 0, "api").otherwise(F.col("provider")), "revenue": F.col("revenue") + F.when(s % 5 == 0, 10.0).otherwise(0.0), "profit": F.when(s % 4 != 0, F.col("profit")),
        "revisions": F.concat(F.when(s % 30 == 0, F.array().cast(L.REVISION)).otherwise(F.col("revisions")), F.when((s % 5 == 0) & (s % 4 == 0), F.array(F.struct(day().alias("superseded_on"), F.create_map(F.lit("revenue"), F.col("revenue")).alias("values")))).otherwise(F.array().cast(L.REVISION)))})
    new = new.withColumn("revisions", F.when((s % 30 == 0) & (s % 4 == 0), F.concat(F.array(F.struct(F.lit("1999-01-01").cast("date").alias("superseded_on"), F.create_map(F.lit("revenue"), F.lit(2.0)).alias("values"))), F.col("revisions"))).otherwise(F.col("revisions")))
    return L.no_loss_annual(old, new, ["revenue", "profit"])


@query("no_loss_shareholding", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, unnest(list_filter([CASE WHEN NOT here THEN 'record removed' END, CASE WHEN here AND symbol % 8 = 3 THEN 'an available quarter became unavailable' END, CASE WHEN here AND symbol % 17 = 4 THEN 'source record id was removed' END, CASE WHEN here AND symbol % 12 = 5 AND symbol % 17 <> 4 THEN 'record id changed without a revision' END,
 CASE WHEN here AND symbol % 10 = 2 AND symbol % 17 <> 4 AND symbol % 12 <> 5 THEN 'named holders were lost' END, CASE WHEN here AND p IS NOT NULL AND symbol % 6 = 0 THEN 'promoters: a value was lost' END, CASE WHEN here AND f IS NOT NULL AND symbol % 5 = 0 THEN 'fii changed without a revision' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT *, fy <> 1999 OR symbol % 2 = 0 AS here FROM wide)""", WIDE))
def _(spark, d):
    s, w = F.col("symbol"), wide_holdings(spark, d)
    old = w.select("symbol", "period_end", F.lit("available").alias("status"), F.lit("r1").alias("record_id"), F.lit("h").alias("holders"), F.lit(1).alias("revisions"), "promoters", "fii")
    new = old.where((F.year("period_end") != 1999) | (s % 2 == 0)).withColumns({"status": F.when(s % 8 == 3, "unavailable").otherwise("available"), "record_id": F.when(s % 17 == 4, None).when(s % 12 == 5, "r2").otherwise("r1"),
                                                                              "holders": F.when(s % 10 != 2, "h"), "promoters": F.when(s % 6 != 0, F.col("promoters")), "fii": F.col("fii") + F.when(s % 5 == 0, 1.0).otherwise(0.0)})
    return L.no_loss_shareholding(old, new, ["promoters", "fii"])


@query("no_loss_candles", sql("""SELECT symbol, lost_days, CAST(first_lost AS VARCHAR) AS first_lost, altered_days FROM (SELECT symbol, count(*) FILTER (i % 50 = 0) AS lost_days, min(date) FILTER (i % 50 = 0) AS first_lost, count(*) FILTER (i % 50 <> 0 AND i % 20 = 7 AND date < last - 30) AS altered_days FROM (SELECT symbol, date, symbol + (date - DATE '1970-01-01') AS i, max(date) OVER (PARTITION BY symbol) AS last FROM bars) GROUP BY 1) WHERE lost_days > 0 OR altered_days > 0""", BARS))
def _(spark, d):
    b, i = bars(spark, d), F.col("symbol") + F.unix_date("date")
    return L.no_loss_candles(b, b.where(i % 50 != 0).withColumn("close", F.when(i % 20 == 7, F.col("close") + 1).otherwise(F.col("close"))))


@query("no_loss_snapshot", """SELECT CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS published_as_of, CAST(max(CAST(l_shipdate AS DATE)) FILTER (l_quantity = 17 AND l_suppkey % 3 = 0) AS VARCHAR) AS as_of, count(DISTINCT l_suppkey) AS published_count, count(DISTINCT l_suppkey) FILTER (l_quantity = 17 AND l_suppkey % 3 = 0) AS universe_count,
 concat_ws(',', CASE WHEN max(CAST(l_shipdate AS DATE)) FILTER (l_quantity = 17 AND l_suppkey % 3 = 0) < max(CAST(l_shipdate AS DATE)) THEN 'older_than_published' END, 'universe_shrank') AS problems FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    snap = lambda df: df.agg(F.max(F.to_date("l_shipdate")).alias("as_of"), F.count_distinct("l_suppkey").alias("universe_count"))
    return L.no_loss_snapshot(snap(li), snap(li.where("l_quantity = 17 AND l_suppkey % 3 = 0")))


@query("no_loss_parts", sql("""SELECT symbol, unnest(list_filter([CASE WHEN symbol % 20 = 0 THEN 'missing from the new state' END, CASE WHEN symbol % 20 <> 0 AND symbol % 3 = 0 AND fetched IS NOT NULL THEN 'ratios_on moved backwards' END, CASE WHEN symbol % 20 <> 0 AND symbol % 7 = 0 AND fetched IS NOT NULL THEN 'profile_on moved backwards' END,
 CASE WHEN symbol % 20 <> 0 AND symbol % 5 <> 0 AND symbol % 4 = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = symbol) THEN 'quarters lost' END, CASE WHEN symbol % 20 <> 0 AND symbol % 5 = 0 AND (symbol % 2 = 1 OR fetched IS NULL) THEN 'basis changed without a newer check' END], lambda x: x IS NOT NULL)) AS problem FROM ratios""", RATIOS))
def _(spark, d):
    s = F.col("symbol")
    quarters = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.array_sort(F.collect_set(F.trunc("o_orderdate", "quarter"))).alias("quarters"))     # a year has four
    old = S.ratios(spark, d).select("symbol", F.col("fetched").alias("ratios_on"), F.col("fetched").alias("profile_on"), F.col("fetched").alias("checked_on"), F.lit("consolidated").alias("basis")).join(quarters, "symbol", "left")
    new = old.where(s % 20 != 0).withColumns({
        "ratios_on": F.when(s % 3 == 0, F.date_sub("ratios_on", 1)).otherwise(F.date_add("ratios_on", 1)), "profile_on": F.when(s % 7 != 0, F.col("profile_on")),
        "quarters": F.when(s % 4 != 1, F.col("quarters")).when(F.size("quarters") > 1, F.slice("quarters", F.lit(2), F.size("quarters"))), "basis": F.when(s % 5 == 0, "standalone").otherwise(F.col("basis")),
        "checked_on": F.when(s % 2 == 0, F.date_add("checked_on", 1)).otherwise(F.col("checked_on"))})
    return L.no_loss_parts(old, new, "symbol", ["ratios_on", "profile_on"], "quarters", "basis", "checked_on")


@query("except_lost_keys", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 2 = 1 AND a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey)")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return L.except_lost_keys(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), ["l_suppkey", "l_partkey"])


@query("intersect_common_keys", "SELECT p_partkey, p_name AS before, p_name || ' 2' AS after FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 = 0")
def _(spark, d):
    p, k = table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey")
    return L.intersect_common_keys(p.where(k % 3 != 0), p.where(k % 4 != 0).withColumn("p_name", F.when(k % 5 == 0, F.concat("p_name", F.lit(" 2"))).otherwise(F.col("p_name"))), "p_partkey", "p_name")


@query("union_by_date", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN i % 3 = 0 THEN close + 1 ELSE close END AS close FROM (SELECT *, symbol + (date - DATE '1970-01-01') AS i FROM bars) WHERE i % 2 = 0 OR i % 3 = 0", BARS))
def _(spark, d):
    b, i = bars(spark, d).select("symbol", "date", "close"), F.col("symbol") + F.unix_date("date")
    return L.union_by_date(b.where(i % 2 == 0), b.where(i % 3 == 0).withColumn("close", F.col("close") + 1), ["symbol", "date"])


@query("union_universe_extend", "SELECT name, min(src) AS src FROM (SELECT p_name AS name, 1 AS src FROM part UNION ALL SELECT p_type, 2 FROM part UNION ALL SELECT p_name, 2 FROM part) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    both = p.select(F.col("p_name").alias("name"), F.lit(1).alias("src")).union(p.select("p_type", F.lit(2))).union(p.select("p_name", F.lit(2)))
    return both.groupBy("name").agg(F.min("src").alias("src"))


@query("trim_keep_days", sql("SELECT symbol, CAST(date AS VARCHAR) AS date FROM (SELECT *, max(date) OVER () AS e FROM bars) WHERE date >= e - 800", BARS))
def _(spark, d):
    b = bars(spark, d).select("symbol", "date")
    end = table(spark, d, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("_end"))
    return b.join(F.broadcast(end), F.col("date") >= F.date_sub("_end", 800)).drop("_end")          # one row


@query("verify_run", sql("""SELECT symbol, CASE WHEN lost > 0 THEN 'regressed' WHEN a IS NOT NULL AND b IS NULL THEN 'improved' WHEN a > b THEN 'refreshed' WHEN symbol % 3 = 0 AND symbol % 5 + 1 >= 3 THEN 'needs_review' WHEN symbol % 3 = 0 THEN 'retryable_failed' ELSE 'not_reached' END AS outcome FROM (SELECT symbol, count(*) FILTER (bb AND NOT aa) AS lost, max(date) FILTER (bb) AS b, max(date) FILTER (aa) AS a FROM
 (SELECT symbol, date, symbol % 11 <> 0 AND (symbol % 2 = 0 OR date < DATE '2001-01-01') AS bb, (symbol % 7 <> 0 OR date > DATE '1996-01-01') AND (symbol % 2 = 0 OR symbol % 4 = 1 OR date < DATE '2001-01-01') AS aa FROM bars) GROUP BY 1 HAVING bool_or(bb) OR bool_or(aa) OR symbol % 3 = 0)""", BARS))
def _(spark, d):
    b, s, dt = bars(spark, d).select("symbol", "date"), F.col("symbol"), F.col("date")
    before = b.where((s % 11 != 0) & ((s % 2 == 0) | (dt < "2001-01-01")))
    after = b.where(((s % 7 != 0) | (dt > "1996-01-01")) & ((s % 2 == 0) | (s % 4 == 1) | (dt < "2001-01-01")))
    tries = b.select("symbol").distinct().where(s % 3 == 0).select("symbol", (s % 5).alias("before_count"), (s % 5 + 1).alias("after_count"))
    return L.verify_run(before, after, tries)


@query("metric_loss", sql("""SELECT symbol, metric FROM (SELECT symbol, unnest(list_filter([CASE WHEN pe IS NOT NULL AND symbol % 2 = 0 AND NOT (symbol % 4 = 0 AND symbol % 3 = 0) THEN 'pe' END, CASE WHEN roe IS NOT NULL AND symbol % 5 = 0 THEN 'roe' END], lambda x: x IS NOT NULL)) AS metric FROM ratios WHERE fetched IS NOT NULL)""", RATIOS))
def _(spark, d):
    s = F.col("symbol")
    r = S.ratios(spark, d).where("fetched IS NOT NULL").select("symbol", "pe", "roe", "fetched")
    after = r.select("symbol", F.when(s % 2 != 0, F.col("pe")).alias("pe"), F.when(s % 5 != 0, F.col("roe")).alias("roe"), F.when(s % 3 == 0, F.date_add("fetched", 1)).otherwise(F.col("fetched")).alias("fetched"),
                     F.when(s % 4 == 0, F.array(F.lit("pe"))).otherwise(F.array().cast("array<string>")).alias("explicit"))
    return L.metric_loss(r, after, ["pe", "roe"])
