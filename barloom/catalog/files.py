"""Sources and sinks exercised on files that Spark writes from the supplied tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.market import GUARDED, sma_sql
from barloom.catalog.model_sql import BARS, CHANGES, HOLDINGS, INSTRUMENTS, TICKS, YEARS, sql
from barloom.catalog.registry import query
from barloom.catalog.statements import ANNUAL, annual_docs
from barloom.functions import values as V
from barloom.functions.values import rnd
from barloom.operators import calendar as D
from barloom.operators import market as M
from barloom.operators import statements as T
from barloom.operators import windows as W
from barloom.plans import market_day as P
from barloom.rules import WIDE
from barloom.session import cut_lineage, fresh_dir, parts_for
from barloom.sources import files as S
from barloom.sources import sinks as K
from barloom.sources.market import bars, holdings, instruments, table, ticks, year_values
from barloom.streaming.ticks import run_to_table

COLUMNS = ["SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS", "DELIV_PER"]


def landed_bhav(spark, d):
    """Monthly files named after a month end: wrong dates, missing columns, ragged rows and bad names by month number."""
    day = F.last_day("l_shipdate")
    m = F.year(day) * 12 + F.month(day)
    li = table(spark, d, "lineitem").select(
        F.when(m % 17 == 0, F.concat(F.lit("bhav_x"), F.date_format(day, "yyyyMMdd"))).otherwise(F.concat(F.lit("bhav_"), F.date_format(day, "yyyyMMdd"))).alias("file"), m.alias("m"),
        F.concat_ws(", ", "l_suppkey", F.when(F.col("l_linenumber") == 7, "BE").otherwise("EQ"), F.date_format(F.when(m % 13 == 0, F.date_sub(day, 2)).otherwise(day), "dd-MMM-yyyy"), F.lit("1.00"), *[F.col("l_quantity").cast("bigint").cast("string")] * 7).alias("row"),
        (F.col("l_orderkey") % 20 == 0).alias("short"), F.col("l_orderkey").alias("ord"))
    body = li.select("file", F.when((F.col("m") % 11 == 0) & F.col("short"), F.lit("torn,line")).otherwise(F.col("row")).alias("value"), F.col("ord"))
    head = F.when(F.col("m") % 7 == 0, " , ".join(c for c in COLUMNS if c != "CLOSE_PRICE") + " ,X").otherwise(" , ".join(COLUMNS))
    heads = li.select("file", "m").distinct().select("file", head.alias("value"), F.lit(-1).cast("bigint").alias("ord"))
    path = fresh_dir(spark, "bhav")
    body.unionByName(heads).repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    for name in ("bhav_20300102", "bhav_20300103"):                                            # one file without a byte, one that is no text
        _raw(spark, f"{path}/file={name}/part-00000.txt", b"" if name.endswith("2") else b"SYMBOL, SERIES\n\xff\xfe\x00\x81\n")
    return S.landed_lines(spark, path, F.regexp_extract("_metadata.file_path", "file=([^/]+)/", 1)), S.empty_files(spark, path, "file=([^/]+)/")


def _raw(spark, path: str, content: bytes) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


MONTHS = """
mo AS (SELECT last_day(l_shipdate) AS day, year(l_shipdate) * 12 + month(l_shipdate) AS m, * FROM lineitem),
verdicts AS (SELECT CASE WHEN m % 17 = 0 THEN 'bhav_x' ELSE 'bhav_' END || strftime(day, '%Y%m%d') AS file, m, day, count(*) FILTER (NOT (m % 11 = 0 AND l_orderkey % 20 = 0)) AS rows, count(*) FILTER (l_linenumber <> 7 AND NOT (m % 11 = 0 AND l_orderkey % 20 = 0)) AS eq_rows,
  CASE WHEN m % 17 = 0 THEN 'bad_file_name' WHEN m % 7 = 0 THEN 'missing_columns' WHEN m % 11 = 0 AND count(*) FILTER (l_orderkey % 20 = 0) / count(*)::DOUBLE > 0.01 THEN 'malformed' WHEN m % 13 = 0 THEN 'date_mismatch' WHEN isodow(day) > 5 THEN 'weekend_file' WHEN day > DATE '2001-06-15' THEN 'future_date'
   WHEN count(*) FILTER (l_linenumber <> 7 AND NOT (m % 11 = 0 AND l_orderkey % 20 = 0)) < 500 THEN 'partial' ELSE 'ok' END AS status FROM mo GROUP BY day, m)"""


@query("src_bhav_file_verdict", sql("""SELECT file, CASE WHEN m % 17 <> 0 THEN CAST(day AS VARCHAR) END AS date, status, rows, eq_rows, CASE WHEN status = 'date_mismatch' AND isodow(day) < 6 AND isodow(day - 2) < 6 THEN CAST(day - 2 AS VARCHAR) END AS stale_copy_of FROM verdicts UNION ALL VALUES ('bhav_20300102', '2030-01-02', 'empty', 0, 0, NULL), ('bhav_20300103', '2030-01-03', 'malformed', 0, 0, NULL)""", MONTHS))
def _(spark, d):
    lines, empty = landed_bhav(spark, d)
    return S.bhav_verdicts(lines, "2001-06-15", empty=empty)


@query("src_bhav_csv", sql("SELECT file, l_suppkey AS symbol, CASE WHEN l_linenumber = 7 THEN 'BE' ELSE 'EQ' END AS series, CAST(mo.day AS VARCHAR) AS date, l_quantity AS close, count(*) AS n FROM mo JOIN verdicts v ON v.day = mo.day WHERE status = 'ok' AND NOT (mo.m % 11 = 0 AND l_orderkey % 20 = 0) GROUP BY ALL", MONTHS))
def _(spark, d):
    lines, _ = landed_bhav(spark, d)
    rows = S.bhav_rows(lines, S.bhav_verdicts(lines, "2001-06-15"))
    typed = rows.select("file", F.col("SYMBOL").cast("bigint").alias("symbol"), F.col("SERIES").alias("series"), V.date_parse("DATE1").alias("date"), V.num_parse("CLOSE_PRICE").alias("close"))
    return typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("n"))


def _landed_csv(df, label):
    """Files of the same list whose columns stand in different orders."""
    path = fresh_dir(df.sparkSession, label)
    turned = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(2)) == 0
    df.where(turned).write.option("header", True).csv(path)
    df.where(~turned).select(*[f"`{c}`" for c in reversed(df.columns)]).write.mode("append").option("header", True).csv(path)
    return path


@query("src_index_csv", "SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 5 <> 0 THEN 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isin, p_name AS name FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 40 <> 0")
def _(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.col("p_name").alias("Company Name"), F.concat(F.when(k % 40 == 0, " p $").otherwise(" p"), k, F.lit(" ")).alias(" Symbol"), F.when(k % 3 == 2, "BE").otherwise("EQ").alias("Series"),
                                       F.when(k % 5 != 0, F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))).otherwise("none").alias("ISIN Code"))
    return S.read_index_csv(spark, _landed_csv(p, "index"))


@query("src_reference_csv", "SELECT CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isin, 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'EQ' ELSE 'BE' END AS series FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("SYMBOL"), F.when(k % 2 == 0, "eq").otherwise("be").alias(" SERIES"), F.when(k % 6 == 0, "XX1").otherwise(F.concat(F.lit("ine"), F.lpad(k.cast("string"), 9, "0"))).alias(" ISIN NUMBER"))
    return S.read_reference_csv(spark, _landed_csv(p, "reference"))


@query("src_etf_list_csv", "SELECT DISTINCT upper(p_name) AS symbol, true AS exhaustive FROM part")
def _(spark, d):
    return S.read_etf_list_csv(spark, _landed_csv(table(spark, d, "part").select(F.concat(F.col("p_name"), F.lit(" ")).alias("Symbol "), "p_brand"), "etf"), exhaustive=True)


@query("src_instruments_json", sql("""SELECT symbol, isin, name FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY instrument_type = 'EQ' DESC, row_id DESC) AS k FROM (SELECT upper(trim(p_brand || p_size)) AS symbol, i.* FROM instruments i JOIN part ON p_partkey = row_id WHERE segment = 'NSE_EQ' AND i.isin IS NOT NULL)) WHERE k = 1""", INSTRUMENTS))
def _(spark, d):
    i = instruments(spark, d).drop("trading_symbol").join(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat("p_brand", "p_size").alias("trading_symbol")), "row_id").select("row_id", "segment", "instrument_key", "trading_symbol", "isin", "security_type", "instrument_type", "name")
    path = fresh_dir(spark, "instruments")
    # one ordered gz file per range of rows: the order of the lines is the order of the list
    i.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id").write.option("compression", "gzip").json(path)
    return S.read_instruments_json(spark, path)


@query("src_holidays_text", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    path = fresh_dir(spark, "holidays")
    table(spark, d, "orders").select(F.concat_ws("  ", F.when(k % 3 == 0, F.lit("2020-13-01")).otherwise(day), F.lit("# note"), F.lit("20200101"))).write.text(path)
    return S.read_holidays(spark, path)


OBS = """
od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
ob AS (SELECT d, d - DATE '1970-01-01' AS i, CASE WHEN (d - DATE '1970-01-01') % 9 = 0 THEN 12 WHEN isodow(d) = 1 THEN 3 ELSE 1 END AS back, CASE WHEN (d - DATE '1970-01-01') % 8 = 0 THEN 2 ELSE 5 END AS seen, CASE WHEN (d - DATE '1970-01-01') % 10 = 0 THEN 3 ELSE 14 END AS span, (d - DATE '1970-01-01') % 4 AS checks FROM od)"""


@query("src_observation_text", sql("""SELECT CAST(d AS VARCHAR) AS requested, checks, CASE WHEN i % 7 = 3 THEN 'expected_5_fields' WHEN checks = 0 THEN 'bad_field' WHEN isodow(d) > 5 THEN 'requested_weekend' WHEN isodow(d - CAST(back AS INTEGER)) > 5 THEN 'served_weekend' WHEN back > 10 THEN 'served_too_old' WHEN checks = 1 THEN 'one_check_two_dates' WHEN span < (checks - 1) * 7 THEN 'checks_too_close' WHEN seen <= 3 THEN 'seen_too_soon' END AS problem
 FROM (SELECT * REPLACE (CASE WHEN i % 7 = 3 THEN NULL WHEN checks = 0 THEN NULL ELSE checks END AS checks), checks AS c0 FROM ob) WHERE true""".replace("checks = 0 THEN 'bad_field'", "c0 = 0 THEN 'bad_field'"), OBS))
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    i = F.unix_date("d")
    back = F.when(i % 9 == 0, 12).when(F.weekday("d") == 0, 3).otherwise(1)
    first = F.date_add("d", F.when(i % 8 == 0, 2).otherwise(5))
    last = F.date_add(first, F.when(i % 10 == 0, 3).otherwise(14))
    line = F.concat_ws(" ", *[x.cast("string") for x in (F.col("d"), F.date_sub("d", back), first, last)], F.when(i % 7 != 3, (i % 4).cast("string")))
    path = fresh_dir(spark, "observations")
    o.select(F.explode(F.array(F.lit("# comment"), line))).write.text(path)
    return S.read_observations(spark, path).select("requested", "checks", "problem")


@query("src_failure_text", sql("""SELECT CAST(d AS VARCHAR) AS requested, kind, CASE WHEN a > CASE WHEN kind = 'rate_limited' OR kind = 'odd' THEN 8 ELSE 4 END OR a = 0 THEN 'bad_field' WHEN kind = 'odd' THEN 'unknown_kind' WHEN isodow(d) > 5 THEN 'requested_weekend' WHEN a = 1 THEN 'one_check_two_dates' WHEN span < a - 1 THEN 'checks_too_close' WHEN seen <= 3 THEN 'seen_too_soon' END AS problem
 FROM (SELECT *, i % 10 AS a, CASE i % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'access_denied' ELSE 'odd' END AS kind FROM ob)""", OBS))
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    i = F.unix_date("d")
    first = F.date_add("d", F.when(i % 8 == 0, 2).otherwise(5))
    last = F.date_add(first, F.when(i % 10 == 0, 3).otherwise(14))
    line = F.concat_ws(" ", F.col("d").cast("string"), F.when(i % 3 == 0, "rate_limited").when(i % 3 == 1, "access_denied").otherwise("odd"), first.cast("string"), last.cast("string"), (i % 10).cast("string"))
    path = fresh_dir(spark, "failures")
    o.select(line).write.text(path)
    return S.read_failures(spark, path).select("requested", "kind", "problem")


@query("src_candles_json", sql("""SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(date AS VARCHAR) AS date, open, high, low, close, CASE WHEN i % 43 <> 0 THEN volume END AS volume FROM (SELECT *, symbol + (date - DATE '1970-01-01') AS i FROM bars) WHERE i % 37 <> 0 AND i % 41 <> 0""", BARS))
def _(spark, d):
    i = F.col("symbol") + F.unix_date("date")
    b = bars(spark, d)
    row = F.array(F.concat(F.col("date").cast("string"), F.lit("T00:00:00+05:30")), F.when(i % 41 != 0, F.col("open").cast("string")), F.when(i % 37 == 0, F.lit("0.01")).otherwise(F.col("high").cast("string")), F.col("low").cast("string"), F.col("close").cast("string"),
                  F.when(i % 43 == 0, F.lit("-5")).otherwise(F.col("volume").cast("string")))
    path = fresh_dir(spark, "candles")
    b.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.collect_list(row).alias("candles")).write.json(path)          # one row per day at most
    return S.read_candles_json(spark, path)


@query("src_statement_json", sql("SELECT CAST(symbol AS VARCHAR) AS symbol, label, fy, value FROM (SELECT symbol, fy, 'total revenue' AS label, rev AS value FROM yv UNION ALL SELECT symbol, fy, 'profit before tax', mx FROM yv) WHERE NOT (symbol % 29 = 0 AND fy = 1997)", ANNUAL))
def _(spark, d):
    path = fresh_dir(spark, "statements")
    annual_docs(spark, d).withColumn("symbol", F.col("symbol").cast("string")).write.json(path)
    lines = T.statement_lines(S.read_statement_json(spark, path), parts_for(spark, path, 32)).where("label IN ('total revenue', 'profit before tax')")
    return lines.select("symbol", "label", F.year("period_end").alias("fy"), "value").where("value IS NOT NULL")


@query("src_xbrl_facts", sql("""SELECT symbol, CAST(period_end AS VARCHAR) AS period, category AS member, CASE WHEN symbol % 7 = 0 THEN least(shares, 1.0) ELSE shares END AS shares, CASE WHEN symbol % 5 <> 0 THEN round(shares / 1000, 2) END AS pct, symbol % 7 = 0 AS conflict FROM (SELECT symbol, period_end, replace(category, '_', '') AS category, shares FROM holdings) WHERE category <> 'fii'""", HOLDINGS))
def _(spark, d):
    h = holdings(spark, d)
    s, c = F.col("symbol"), F.concat_ws("_", F.lit("C"), "symbol", F.year("period_end"), "category")
    axis = F.when(F.col("category") == "fii", "in:OtherAxis").otherwise("in:CategoryOfShareholdersAxis")
    member = F.concat(F.lit("in:s"), "symbol", F.lit("x"), F.regexp_replace(F.initcap("category"), "_", ""), F.lit("Member"))
    xml = [F.format_string('<context id="%s"><period><instant>%s</instant></period><scenario><explicitMember dimension="%s">%s</explicitMember></scenario></context>', c, F.col("period_end").cast("string"), axis, member),
           F.format_string('<NumberOfFullyPaidUpEquityShares contextRef="%s">%s</NumberOfFullyPaidUpEquityShares>', c, F.col("shares").cast("decimal(18,2)").cast("string")),
           F.when(s % 7 == 0, F.format_string('<NumberOfFullyPaidUpEquityShares contextRef="%s">1.00</NumberOfFullyPaidUpEquityShares>', c)),
           F.when(s % 5 != 0, F.format_string('<ShareholdingAsAPercentageOfTotalNumberOfShares contextRef="%s">%s</ShareholdingAsAPercentageOfTotalNumberOfShares>', c, rnd(F.col("shares") / 1000, 2).cast("string")))]
    path = fresh_dir(spark, "xbrl")
    part = F.concat_ws("-", F.year("period_end"), s % 16)
    body = h.select(part.alias("part"), F.explode(F.array_compact(F.array(*xml))).alias("value"), F.lit(1).alias("ord"))
    root = h.select(part.alias("part")).distinct().select("part", F.inline(F.array(F.struct(F.lit("<xbrl>").alias("value"), F.lit(0).alias("ord")), F.struct(F.lit("</xbrl>").alias("value"), F.lit(2).alias("ord")))))
    body.unionByName(root).repartition("part").sortWithinPartitions("part", "ord").select("part", "value").write.partitionBy("part").text(path)
    f = S.read_xbrl_facts(spark, path)
    return f.select(F.regexp_extract("member", r"^s(\d+)x", 1).cast("bigint").alias("symbol"), "period", F.regexp_replace("member", r"^s\d+x", "").alias("member"), "shares", "pct", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("src_filing_index", """SELECT symbol, CAST(day AS VARCHAR) AS day, record_id, CASE WHEN day IS NULL THEN 'unparsable_date' WHEN day <> last_day(day) OR month(day) % 3 <> 0 THEN 'off_cycle' WHEN day < DATE '1996-01-01' THEN 'before_window' WHEN row_number() OVER (PARTITION BY symbol, day ORDER BY stamp DESC, CAST(record_id AS BIGINT) DESC) > 1 THEN 'superseded' END AS reason FROM
(SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) ELSE last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) END AS day, CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_orderdate AS DATE) AS stamp FROM orders)""")
def _(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    q = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    path = fresh_dir(spark, "filings")
    table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.when(k % 31 == 0, "n/a").otherwise(F.date_format(F.when(k % 11 == 0, day).otherwise(q), "dd-MMM-yyyy")).alias("date"), k.cast("string").alias("recordId"),
                                     F.when(k % 2 == 0, F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy HH:mm:ss"))).otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("broadcastDate")).write.json(path)
    return S.read_filing_index(spark, path, "1996-01-01").select("symbol", "day", "record_id", "reason")


@query("src_tick_recording", sql("SELECT key, seq, recv_ms, ltp, ltt, cp, CAST(session_date AS VARCHAR) AS session_date FROM ticks", TICKS))
def _(spark, d):
    path = fresh_dir(spark, "recording")
    ticks(spark, d).write.json(path)
    return run_to_table(S.tick_recording(spark, path), "recorded", spark).select("key", "seq", "recv_ms", "ltp", "ltt", "cp", "session_date")


@query("src_call_log", "SELECT CAST(user_id AS VARCHAR) AS run, max(event_id) AS calls FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def _(spark, d):
    i = F.col("event_id")
    line = F.when(i % 20 == 0, F.concat(F.lit('{"run": "'), "user_id", F.lit('", "ca'))).when(i % 10 == 0, F.concat(F.lit('{"run": "'), "user_id", F.lit('"}'))).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("run"), i.alias("calls"))))
    path = fresh_dir(spark, "calls")
    table(spark, d, "events").select(line).write.text(path)
    return S.read_call_log(spark, path)


@query("src_growth_events", "SELECT event_id, event_id % 4 <> 0 AS valid FROM events")
def _(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.array(F.struct(F.lit("TCS").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("order").alias("event_type"), i.cast("string").alias("title"), F.when(i % 4 == 0, "order_book").otherwise("order_inflow").alias("measure"),
                                                          F.lit("Co").alias("source_name"), F.lit("https://x.com/a").alias("source_url"), F.lit("q").alias("evidence_quote"))).alias("events"))
    path = fresh_dir(spark, "growth")
    e.write.json(path)
    return S.read_growth_events(spark, path, multi_line=False).select(F.col("title").cast("bigint").alias("event_id"), "valid")


@query("src_official_records", sql("SELECT CAST(symbol AS VARCHAR) AS symbol, fy, value AS revenue, CASE WHEN symbol % 4 = 0 THEN 'profit' ELSE '' END AS unsourced, symbol % 4 <> 0 AS sound FROM years", YEARS))
def _(spark, d):
    s = F.col("symbol")
    note = F.create_map(F.lit("page"), F.lit("7"))
    rec = year_values(spark, d).select(F.array(F.struct(s.cast("string").alias("symbol"), F.lit("Co").alias("company"), F.col("fy"), F.concat(F.lit("Dec "), "fy").alias("period"), F.lit("standalone").alias("basis"),
        F.create_map(F.lit("revenue"), F.col("value"), F.lit("profit"), F.col("lines").cast("double")).alias("values"),
        F.when(s % 4 == 0, F.create_map(F.lit("revenue"), note)).otherwise(F.create_map(F.lit("revenue"), note, F.lit("profit"), note)).alias("fields"))).alias("records"))
    path = fresh_dir(spark, "official")
    rec.write.json(path)
    r = S.read_official_records(spark, path, multi_line=False)
    return r.select("symbol", "fy", F.col("values")["revenue"].alias("revenue"), F.array_join("unsourced", ",").alias("unsourced"), "sound")


@query("src_company_profiles", "SELECT c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'About ' || c_name END AS description FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    path = fresh_dir(spark, "profiles")
    c.where("c_custkey % 3 = 0").select(F.array(F.struct(F.col("c_custkey").cast("string").alias("symbol"), F.concat(F.lit("About "), "c_name").alias("description"), F.lit("Co").alias("source_name"))).alias("companies")).write.json(path)
    p = S.read_company_profiles(spark, path, multi_line=False).select(F.col("symbol").cast("bigint").alias("symbol"), "description")
    return c.select(F.col("c_custkey").alias("symbol")).join(p, "symbol", "left")


# ---------------------------------------------------------------- sinks
SAFE_DAYS = " + ".join(f"(SELECT count(*) FILTER (status = 'safe' AND symbol = (SELECT max(symbol) FROM latest)) FROM (SELECT * FROM sma_{n} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1))" for n in (20, 50, 200))


@query("sink_market_docs", sql(f"""SELECT 'published' AS step, 'breadth' AS what, 2 AS rows UNION ALL SELECT 'published', 'dma_breadth', 3 UNION ALL SELECT 'published', 'dma', 3 * count(*) FROM latest UNION ALL SELECT 'published', 'movers', least(50, count(*) FILTER (change_pct > 0 AND turnover >= 100)) + least(50, count(*) FILTER (change_pct < 0 AND turnover >= 100)) FROM latest
 UNION ALL SELECT 'published', 'activity', least(100, count(*) FILTER (turnover > 0)) + least(100, count(*) FILTER (volume > 0)) FROM latest UNION ALL SELECT 'damaged', 'breadth counted_is_not_the_sum 1', NULL UNION ALL SELECT 'damaged', 'dma symbols_are_not_the_universe 3', NULL
 UNION ALL SELECT 'damaged', 'dma_breadth differs_from_the_symbols ' || n, NULL FROM (SELECT {SAFE_DAYS} AS n) WHERE n > 0 UNION ALL SELECT 'halved', 'breadth universe_shrunk 1', NULL""", GUARDED, *[sma_sql(n, 20.0) for n in (20, 50, 200)]))
def _(spark, d):
    """Published once; then a version that breaks its rules and one of half the symbols are refused, and readers still see the first."""
    latest = cut_lineage(P.newest_measured(bars(spark, d), WIDE), "latest")
    friday = lambda docs: docs | {"breadth": docs["breadth"].withColumn("as_of", F.date_sub("as_of", F.greatest(F.weekday("as_of") - 4, F.lit(0))))}
    docs, base = friday(P.documents(latest, WIDE)), fresh_dir(spark, "market-docs")
    P.publish_documents(docs, base, "2001-11-04")
    last = latest.agg(F.max("symbol").alias("symbol"))
    damaged = docs | {"breadth": docs["breadth"].withColumn("counted", F.col("counted") + F.when(F.col("scope") == "liquid", 1).otherwise(0)), "dma": docs["dma"].join(F.broadcast(last), "symbol", "left_anti")}
    refused = []
    for step, version in (("damaged", damaged), ("halved", friday(P.documents(latest.where("symbol % 2 = 0"), WIDE)))):
        try:
            P.publish_documents(version, base, "2001-11-04")
        except K.NotPublished as why:
            refused += [(step, line, None) for line in why.problems]
    seen = [K.read_published(spark, base, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("published").alias("step"), F.lit(n).alias("what"), "rows") for n in docs]
    return M.union_all([*seen, spark.createDataFrame(refused, "step string, what string, rows bigint")])


@query("sink_per_symbol", sql("SELECT 'bars' AS kind, CAST(symbol AS VARCHAR) AS symbol, true AS stored, count(*) AS rows FROM bars GROUP BY 2", BARS))
def _(spark, d):
    path = fresh_dir(spark, "per-symbol")
    K.write_per_symbol(bars(spark, d).select(F.col("symbol").cast("string").alias("symbol"), "date", "close"), path, "bars")
    back = spark.read.parquet(path + "/data/kind=bars").groupBy("symbol").agg(F.count(F.lit(1)).alias("found"))
    return K.symbol_index(spark, path).join(back, "symbol").select("kind", "symbol", ((F.col("bytes") > 0) & (F.col("found") == F.col("rows"))).alias("stored"), "rows")


@query("sink_history_append_dedup", "SELECT seq, symbol, price FROM (SELECT min(l_orderkey) AS seq, l_suppkey AS symbol, l_quantity AS price FROM lineitem GROUP BY 2, 3)")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.struct("l_orderkey", (-F.col("l_suppkey")).alias("s"), (-F.col("l_quantity")).alias("q")).alias("at"), F.col("l_suppkey").alias("symbol"), F.col("l_quantity").alias("price"))
    k = F.col("at.l_orderkey")
    return K.append_dedup(li.where(k % 4 < 2), li.where(k % 4 >= 2), "at").select(F.col("at.l_orderkey").alias("seq"), "symbol", "price")


@query("sink_keyed_append", "SELECT day, side, seq FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS side, max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, max(o_orderkey) FILTER (o_orderkey % 2 = 1) AS b, coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 0), max(o_orderkey)) AS seq FROM orders GROUP BY 1, 2)")
def _(spark, d):
    o = table(spark, d, "orders")
    side = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("side")).agg(F.max("o_orderkey").alias("seq"))
    return K.keyed_append(side(0), side(1), ["day", "side"], "seq")


@query("sink_delta_handoff", sql("SELECT symbol, true AS changed, round(sum(CASE WHEN symbol % 4 = 1 AND volume = 50 THEN 1 ELSE 0 END)) AS marks FROM bars WHERE symbol % 4 = 1 GROUP BY 1 HAVING bool_or(volume = 50) UNION ALL SELECT symbol, true, 0 FROM bars WHERE symbol % 10 = 9 AND symbol % 4 <> 1 GROUP BY 1", BARS))
def _(spark, d):
    s = F.col("symbol")
    old = bars(spark, d).select("date", "volume", F.lit(0).alias("mark"), "symbol")
    path = fresh_dir(spark, "handoff")
    old.where(s % 10 != 9).repartition("symbol").write.partitionBy("symbol").parquet(path)
    now = old.withColumn("mark", F.when((s % 4 == 1) & (F.col("volume") == 50), 1).otherwise(0)).where((s % 7 != 0) | (s % 10 == 9) | (s % 4 == 1))
    changed = K.install_delta(path, now, "symbol")
    after = spark.read.schema(now.schema).parquet(path).groupBy("symbol").agg(F.sum("mark").cast("double").alias("marks"))
    return changed.join(after, "symbol").select("symbol", F.lit(True).alias("changed"), "marks").where((s % 10 != 9) | (s % 4 != 1) | (F.col("marks") > 0))


@query("sink_gated_publish", "SELECT 'approved' AS site, n_name AS sector, count(*) AS members FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'withdrawn', 'nothing published', count(*) FROM supplier")
def _(spark, d):
    """Two sites: on one an approved version stays through a failed check; on the other the approval is gone, and with it what was published."""
    s = table(spark, d, "supplier")
    t = s.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("sector")).agg(F.count(F.lit(1)).alias("members"))   # fixed list of countries
    everyone = s.count()
    whole = lambda new: [] if new["sectors"].agg(F.sum("members")).first()[0] == everyone else ["members_are_not_all"]
    kept, gone = fresh_dir(spark, "approved"), fresh_dir(spark, "withdrawn")
    for base in (kept, gone):
        K.publish_gated({"sectors": t}, base, "true", whole)
    refused = False
    try:
        K.publish_gated({"sectors": t.withColumn("members", F.col("members") + 1)}, kept, "true", whole)
    except K.NotPublished:
        refused = True
    K.publish_gated({"sectors": t}, gone, "True", whole)
    on = K.read_published(spark, kept, "sectors").where(F.lit(refused)).select(F.lit("approved").alias("site"), "sector", "members")
    off = s.agg(F.count(F.lit(1)).alias("members")).where(F.lit(K.published_version(spark, gone) is None))
    return on.unionByName(off.select(F.lit("withdrawn").alias("site"), F.lit("nothing published").alias("sector"), "members"))


# ---------------------------------------------------------------- scalar groups
@query("scalar_string", """SELECT p_partkey, upper(p_name) || '-' || p_partkey AS bad_symbol_kept, CASE WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey END AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isin, 'mutualfundsoruti' || p_partkey AS axis, p_partkey % 4 = 0 AS https_ok FROM part""")
def _(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    return p.select(k, F.concat(F.upper("p_name"), F.lit("-"), k).alias("bad_symbol_kept"), V.symbol_norm(F.concat(F.when(k % 2 == 0, " p").otherwise(" p !"), k)).alias("symbol"), V.isin_norm(F.concat(F.when(k % 3 == 0, "ine").otherwise("in"), F.lpad(k.cast("string"), 9, "0"))).alias("isin"),
                    V.axis_key(F.concat(F.lit("in-bse:DetailsOfSharesHeldByMutualFundsOrUTI"), k, F.lit("Axis"))).alias("axis"), F.concat(F.when(k % 4 == 0, "https://").otherwise("http://"), F.lit("x.com")).rlike("^https://").alias("https_ok"))


@query("scalar_date", """SELECT o_orderkey, isodow(d) < 6 AS is_weekday, CAST(x AS VARCHAR) AS expected_day, (SELECT count(*) FROM range(x + 1, DATE '2001-08-06', INTERVAL 1 DAY) r(s) WHERE isodow(s) < 6 AND day(s) <> 1) AS sessions_since, greatest(0, ceil((DATE '2001-08-05' - d + 1) / 360.0))::BIGINT AS windows, CAST(last_day(d + INTERVAL 1 MONTH) AS VARCHAR) AS next_month_end, CAST(CAST(d - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_back, DATE '2001-08-05' - d AS age, CAST(CAST(t + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS ist_date FROM
(SELECT *, list_filter([e, e - 1, e - 2, e - 3, e - 4, e - 5], lambda y: isodow(y) < 6 AND day(y) <> 1)[1] AS x FROM (SELECT *, CASE WHEN hour(t) * 60 + minute(t) >= 1230 THEN d ELSE d - 1 END AS e FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + to_minutes(o_orderkey % 1440) AS t FROM orders)))""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    t = F.timestamp_seconds(F.unix_date(day) * 86400 + F.col("o_orderkey") % 1440 * 60)
    o, today = table(spark, d, "orders"), F.lit("2001-08-05").cast("date")
    span = o.agg(F.min(day).alias("first"), F.greatest(F.max(day), today).alias("last"))
    firsts = span.select(F.explode(F.sequence(F.trunc("first", "MM"), F.col("last"), F.expr("interval 1 month"))).alias("date"))          # the first of every month is a holiday here
    calendar = cut_lineage(D.trading_calendar(span, firsts), "calendar")
    o = D.sessions_between(D.with_expected_day(o.withColumn("_today", today), t, calendar), "expected_day", "_today", calendar, "sessions_since")
    split = D.date_windows(o.select("o_orderkey", day.alias("a"), "_today"), "a", "_today").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("windows"))
    return o.join(split, "o_orderkey", "left").select("o_orderkey", (F.weekday(day) < 5).alias("is_weekday"), "expected_day", "sessions_since", F.coalesce("windows", F.lit(0)).alias("windows"), F.last_day(F.add_months(day, 1)).alias("next_month_end"), F.add_months(day, -1).alias("month_back"),
                                            F.datediff(F.lit("2001-08-05").cast("date"), day).alias("age"), F.to_date(t + F.expr("interval 330 minutes")).alias("ist_date"))


@query("scalar_math", sql("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 2) AS r2, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio, CAST(least(30, pow(2, greatest(l_linenumber, 1) - 1)) AS BIGINT) AS backoff FROM lineitem"))
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rnd(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("r2"), F.try_divide("l_discount", "l_tax").alias("ratio"), V.backoff_days(F.col("l_linenumber")).alias("backoff"))


@query("scalar_array_map", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS flags, CASE WHEN NOT bool_or(o_orderstatus = 'P') THEN 'P' ELSE '' END AS missing, least(count(*), 50) AS kept FROM orders GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("n"))              # three statuses at most
    return g.select("o_custkey", F.array_join(F.array_sort("s"), ",").alias("flags"), F.array_join(F.array_compact(F.array(F.when(~F.array_contains("s", "P"), "P"))), ",").alias("missing"), F.least("n", F.lit(50)).alias("kept"))


@query("scalar_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN event_id % 7 <> 0 THEN value END AS clean FROM events")
def _(spark, d):
    v = F.when(F.col("event_id") % 14 == 0, F.lit("NaN").cast("double")).when(F.col("event_id") % 7 == 0, F.lit("Infinity").cast("double")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), V.finite(v).alias("clean"))
