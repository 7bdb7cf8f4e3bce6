"""Cleaning, de-duplication and small projections over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.model_sql import BARS, CHANGES, sql
from barloom.catalog.registry import query
from barloom.functions import values as V
from barloom.functions.values import rnd
from barloom.operators import cleaning as C
from barloom.operators import market as M
from barloom.operators import windows as W
from barloom.sources.market import bars, table


def raw_rows(spark, d):
    """Raw daily text rows derived from lineitem: repeats, other series, and impossible values by key."""
    k, e = F.col("l_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)")
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    li = table(spark, d, "lineitem").withColumn("copy", F.explode(F.when(k % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    ln = F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").cast("string").alias("SYMBOL"), F.when(ln == 7, " BE").otherwise("EQ ").alias("SERIES"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("DATE1"),
        F.when(k % 89 == 0, "-").otherwise(text(e - F.col("l_quantity").cast("decimal(18,2)") * 100)).alias("PREV_CLOSE"), text(e).alias("OPEN_PRICE"),
        text(F.when(k % 83 == 0, e - 500).otherwise(e + ln)).alias("HIGH_PRICE"), text(F.when(k % 79 == 0, -e).otherwise(e - ln)).alias("LOW_PRICE"),
        F.when(k % 97 == 0, "NA").otherwise(text(e)).alias("CLOSE_PRICE"), text(F.when(k % 73 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("TTL_TRD_QNTY"),
        text(F.col("l_quantity") * 10).alias("TURNOVER_LACS"), text(F.when(F.col("l_partkey") % 71 == 0, F.lit(150)).otherwise(F.col("l_linenumber") * 10)).alias("DELIV_PER"))


RAW = """
lines AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS e FROM lineitem CROSS JOIN (VALUES (1), (2)) c(copy) WHERE copy = 1 OR l_orderkey % 50 = 0),
raw_rows AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_linenumber = 7 THEN 'BE' ELSE 'EQ' END AS series, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_orderkey % 89 <> 0 THEN CAST(e - CAST(l_quantity AS DECIMAL(18,2)) * 100 AS DOUBLE) END AS prev_close, CAST(e AS DOUBLE) AS open,
  CAST(CASE WHEN l_orderkey % 83 = 0 THEN e - 500 ELSE e + l_linenumber END AS DOUBLE) AS high, CAST(CASE WHEN l_orderkey % 79 = 0 THEN -e ELSE e - l_linenumber END AS DOUBLE) AS low,
  CASE WHEN l_orderkey % 97 <> 0 THEN CAST(e AS DOUBLE) END AS close, CASE WHEN l_orderkey % 73 = 0 THEN -l_quantity ELSE l_quantity END AS volume,
  l_quantity * 10 AS turnover, CASE WHEN l_partkey % 71 = 0 THEN 150.0::DOUBLE ELSE CAST(l_linenumber * 10 AS DOUBLE) END AS deliv FROM lines),
grouped AS (SELECT symbol, date, count(*) AS copies, count(DISTINCT (coalesce(prev_close, -1e300), open, high, low, coalesce(close, -1e300), volume, turnover, deliv)) > 1 AS conflict,
  any_value(prev_close) AS prev0, any_value(open) AS open0, any_value(high) AS high0, any_value(low) AS low0, any_value(close) AS close0, any_value(volume) AS volume0, any_value(turnover) AS turnover0, any_value(deliv) AS deliv0
  FROM raw_rows WHERE series = 'EQ' GROUP BY 1, 2),
judged AS (SELECT *, close0 IS NULL OR close0 <= 0 AS bad_close, prev0 IS NULL OR prev0 <= 0 AS bad_prev, volume0 < 0 AS bad_volume, high0 <= 0 AS bad_high, low0 <= 0 AS bad_low, open0 <= 0 AS bad_open,
  deliv0 > 100 AS bad_deliv, high0 > 0 AND low0 > 0 AND high0 < low0 AS crossed FROM grouped),
clean AS (SELECT symbol, date, CASE WHEN NOT bad_prev THEN prev0 END AS prev_close, CASE WHEN NOT bad_open THEN open0 END AS open, CASE WHEN NOT bad_high AND NOT crossed THEN high0 END AS high,
  CASE WHEN NOT bad_low AND NOT crossed THEN low0 END AS low, close0 AS close, CASE WHEN NOT bad_volume THEN CAST(volume0 AS BIGINT) END AS volume, turnover0 AS turnover, CASE WHEN NOT bad_deliv THEN deliv0 END AS deliv
  FROM judged WHERE NOT conflict AND NOT bad_close)"""


@query("clean_bars", sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM clean", RAW))
def _(spark, d):
    return C.clean_bars(raw_rows(spark, d))


@query("clean_counts", sql("""SELECT CAST(r.date AS VARCHAR) AS date, r.raw_rows, r.other_series, coalesce(eq_rows, 0) AS eq_rows, coalesce(di, 0) AS duplicate_identical, coalesce(cd, 0) AS conflicting_duplicate_symbols,
  coalesce(ic, 0) AS invalid_close, coalesce(mp, 0) AS missing_prev_close, coalesce(iv, 0) AS invalid_volume, coalesce(it, 0) AS invalid_turnover, coalesce(ip, 0) AS invalid_price_field, coalesce(idp, 0) AS invalid_delivery_pct,
  coalesce(ec, 0) AS extreme_change, coalesce(ur, 0) AS usable_rows FROM
  (SELECT date, count(*) AS raw_rows, count(CASE WHEN series <> 'EQ' THEN 1 END) AS other_series FROM raw_rows GROUP BY 1) r LEFT JOIN
  (SELECT date, CAST(sum(copies) AS BIGINT) AS eq_rows, CAST(sum(CASE WHEN NOT conflict THEN copies - 1 END) AS BIGINT) AS di, count(CASE WHEN conflict THEN 1 END) AS cd, count(CASE WHEN NOT conflict AND bad_close THEN 1 END) AS ic,
    count(CASE WHEN ok AND bad_prev THEN 1 END) AS mp, count(CASE WHEN ok AND bad_volume THEN 1 END) AS iv, count(CASE WHEN ok AND turnover0 < 0 THEN 1 END) AS it,
    CAST(sum(CASE WHEN ok THEN bad_high::INT + bad_low::INT + bad_open::INT + crossed::INT END) AS BIGINT) AS ip, count(CASE WHEN ok AND bad_deliv THEN 1 END) AS idp,
    count(CASE WHEN ok AND NOT bad_prev AND round((close0 - prev0) / prev0 * 100, 2) NOT BETWEEN -50 AND 50 AND (close0 - prev0) / prev0 * 100 >= -100 THEN 1 END) AS ec, count(CASE WHEN ok THEN 1 END) AS ur
   FROM (SELECT *, NOT conflict AND NOT bad_close AS ok FROM judged) GROUP BY 1) g ON r.date = g.date""", RAW))
def _(spark, d):
    return C.clean_counts(raw_rows(spark, d))


@query("dedup_exact", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, close, volume, count(*) AS copies FROM raw_rows GROUP BY ALL", RAW))
def _(spark, d):
    r = raw_rows(spark, d).select(F.col("SYMBOL").alias("symbol"), V.date_parse("DATE1").alias("date"), V.num_parse("CLOSE_PRICE").alias("close"), V.num_parse("TTL_TRD_QNTY").alias("volume"))
    return C.dedup_exact(r)


@query("dedup_conflict_gate", """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) > 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return C.conflicts(li, ["l_orderkey", "l_linenumber"])


@query("dedup_keep_last", """SELECT l_suppkey AS symbol, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_extendedprice AS close FROM lineitem WHERE l_orderkey % 40 <> 0
QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("open"),
                                            F.col("l_extendedprice").alias("high"), F.when(F.col("l_orderkey") % 40 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("low"),
                                            F.col("l_extendedprice").alias("close"), "l_orderkey", "l_linenumber")
    out = C.dedup_keep_last(li, ["symbol", "date"], F.struct("l_orderkey", "l_linenumber", "close"), C.candle_valid())
    return out.select("symbol", "date", "close")


@query("dedup_keep_none", "SELECT p_name, any_value(p_partkey) AS p_partkey, any_value(p_brand) AS p_brand FROM (SELECT p_name || ' ' || p_size AS p_name, p_partkey, p_brand FROM part) GROUP BY 1 HAVING count(*) = 1")
def _(spark, d):
    return C.dedup_keep_none(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("p_name"), "p_partkey", "p_brand"), "p_name")


@query("liquid_filter", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, turnover FROM bars WHERE turnover >= 100", BARS))
def _(spark, d):
    return bars(spark, d).where(M.liquid()).select("symbol", "date", "turnover")


@query("num_parse", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price,
CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS pct FROM lineitem""")
def _(spark, d):
    li, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    t = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(k % 14 == 0, "--").when(k % 7 == 0, " N/A ").otherwise(F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))).alias("p"),
                  F.when(k % 22 == 0, "Infinity").when(k % 11 == 0, "abc").otherwise(F.concat(F.format_number("l_discount", 2), F.lit(" %"))).alias("q"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", V.num_parse("p").alias("price"), V.num_parse("q").alias("pct"))


@query("date_parse_nse", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""")
def _(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 26 == 0, "31-Feb-2020").when(k % 13 == 0, F.col("o_orderdate").cast("string")).otherwise(F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))).alias("a"),
                 F.upper(F.date_format(F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")) * 86400 + k % 86400), "dd-MMM-yyyy HH:mm:ss")).alias("b"))
    return t.select("o_orderkey", V.date_parse("a").alias("day"), V.stamp_parse("b").alias("stamp"))


@query("period_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS fy, CASE WHEN o_orderkey % 9 <> 0 THEN month(o_orderdate) END AS month,
CASE WHEN o_orderkey % 9 <> 0 THEN CAST(last_day(o_orderdate) AS VARCHAR) END AS period_end FROM orders""")
def _(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 18 == 0, "Xyz 2001").when(k % 9 == 0, "FY01").otherwise(F.date_format("o_orderdate", "MMM yyyy")).alias("p"))
    end = V.period_parse("p")
    return t.select("o_orderkey", F.year(end).alias("fy"), F.month(end).alias("month"), end.alias("period_end"))


@query("stale_copy_verdict", """SELECT CAST(requested AS VARCHAR) AS requested, file, verdict, CAST(CASE WHEN verdict = 'stale_copy' THEN lo END AS VARCHAR) AS served FROM (SELECT *,
 CASE WHEN undated = 0 AND lo = hi AND lo = requested THEN 'match' WHEN undated = 0 AND lo = hi AND isodow(requested) < 6 AND isodow(lo) < 6 AND lo < requested AND requested - lo <= 10 THEN 'stale_copy' ELSE 'mismatch' END AS verdict
 FROM (SELECT requested, 'f' || requested AS file, min(found) AS lo, max(found) AS hi, count(*) - count(found) AS undated FROM (SELECT CAST(o_orderdate AS DATE) AS requested,
  CASE WHEN (CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 5 = 0 THEN CAST(o_orderdate AS DATE) - 2 WHEN (CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 7 = 0 THEN CAST(o_orderdate AS DATE) - 15
   WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS found FROM orders) GROUP BY 1))""")
def _(spark, d):
    day, n = F.to_date("o_orderdate"), F.unix_date(F.to_date("o_orderdate"))
    rows = table(spark, d, "orders").select(day.alias("requested"), F.concat(F.lit("f"), day.cast("string")).alias("file"), F.when(n % 5 == 0, F.date_sub(day, 2)).when(n % 7 == 0, F.date_sub(day, 15))
                                            .when(F.col("o_orderkey") % 101 == 0, None).otherwise(day).alias("found"))
    return C.stale_copy_verdict(rows)


@query("response_kind", """SELECT event_id, CASE s WHEN 404 THEN 'not_found' WHEN 401 THEN 'access_denied' WHEN 403 THEN 'access_denied' WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'server_error' WHEN 302 THEN 'http_error'
 ELSE CASE WHEN event_type = 'error' THEN 'undecodable' WHEN event_type = 'view' THEN 'invalid_response' ELSE 'data' END END AS kind FROM (SELECT *, [200, 404, 401, 403, 429, 503, 302][1 + event_id % 7] AS s FROM events)""")
def _(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 401, 403, 429, 503, 302)]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", C.response_kind(s, F.col("event_type") != "view", F.col("event_type") != "error").alias("kind"))


LABELS = ["Purchase of Fixed Assets", "Sale of Investments", "Purchase of Intangible Assets", "Capital Work-in-Progress", "Proceeds from Borrowings", "CapEx", "Payment for PPE & Others", "Dividend paid", "Acquisition of Property, Plant", "Other income"]
CLASS_OF = ["total", None, "partial", "partial", None, "total", "partial", None, "partial", None]


@query("capex_line_class", "SELECT l_orderkey, l_linenumber, l_partkey, [" + ", ".join("NULL" if c is None else f"'{c}'" for c in CLASS_OF) + "][1 + l_partkey % 10] AS capex_class FROM lineitem")
def _(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.capex_line_class(label).alias("capex_class"))


@query("label_normalise", "SELECT brand, label, any_value(p_partkey) AS p_partkey FROM (SELECT p_partkey, p_brand AS brand, lower(p_type) || ' ' || p_name AS label FROM part) GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), V.label_normalise(F.concat(F.col("p_type"), F.lit(" :  "), F.initcap("p_name"), F.lit("."))).alias("label"))
    one = p.groupBy("brand", "label").agg(F.count(F.lit(1)).alias("n"), F.first("p_partkey").alias("p_partkey"))
    return one.where("n = 1").select("brand", "label", "p_partkey")


@query("sector_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) AS slug FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", V.slug(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" - "))).alias("slug"))


@query("layout_class", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unclassified' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'financial' ELSE 'standard' END AS layout FROM customer")
def _(spark, d):
    seg = F.when(F.col("c_custkey") % 10 == 0, " ").when(F.col("c_mktsegment") == "BUILDING", "Private Banks").when(F.col("c_mktsegment") == "MACHINERY", "Housing Finance").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", V.layout_class(seg).alias("layout"))


@query("mask_private_column", "SELECT c_custkey, CASE WHEN c_custkey IN (1, 5, 9) OR c_nationkey = 3 THEN c_mktsegment END AS sector FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey").isin(1, 5, 9) | (F.col("c_nationkey") == 3), F.col("c_mktsegment")).alias("sector"))


@query("timeframe_slice", sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, round(mean, 6) AS sma20, months FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last, min(date) OVER (PARTITION BY symbol) AS first,
  CASE WHEN count(*) OVER w = 20 THEN CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER w AS DOUBLE) / 20000000 END AS mean FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), (VALUES (6), (60), (120)) m(months)
  WHERE date >= last - to_months(CAST(months AS INTEGER)) AND (months < 36 OR first <= last - to_months(CAST(months AS INTEGER)))""", BARS))
def _(spark, d):
    full = W.roll_mean(bars(spark, d), 20, "sma20")
    cut = lambda m: C.timeframe_slice(full, m, m >= 36).select("symbol", "date", rnd("sma20", 6).alias("sma20"), F.lit(m).alias("months"))
    return M.union_all([cut(m) for m in (6, 60, 120)])


@query("stale_series_label", sql("SELECT symbol, CAST(date AS VARCHAR) AS last_date, CASE WHEN date < m THEN 'as of ' || date ELSE 'current' END AS label FROM latest, (SELECT max(date) AS m FROM bars)", CHANGES))
def _(spark, d):
    last = bars(spark, d).groupBy("symbol").agg(F.max("date").alias("last_date"))
    market = table(spark, d, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("market_date"))
    return C.stale_series_label(last, market).drop("market_date")
