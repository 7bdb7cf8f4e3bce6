"""The market data model read from the supplied tables (see README, "Data model")."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNOVER_UNIT = 400.0       # value traded per unit of turnover
EVENT_EVERY = 997           # one symbol-day in this many opens on a halved reference price


def table_path(d: str, name: str) -> str:
    return f"{d.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(d, name))


def cents(c: str):
    return F.rint(F.col(c) * 100).cast("bigint")


def _value(c: str):
    return F.sum(cents(c)) / 100      # whole hundredths: exact whatever the order of the rows, and cheap to add


def _daily(lines: DataFrame, *keys) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.where("l_quantity > 0").groupBy(*keys).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), _value("l_extendedprice").alias("value"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("delivered"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """One clean bar per (symbol, date). A symbol holds at most one row per calendar day, which bounds every per-symbol window."""
    day = _daily(table(spark, d, "lineitem"), F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
    close = F.col("value") / F.col("qty")
    before = F.lag(close).over(Window.partitionBy("symbol").orderBy("date"))
    split = (F.col("symbol") * 7 + F.unix_date("date")) % EVENT_EVERY == 0
    return day.select(
        "symbol", "date", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", close.alias("close"),
        F.when(split, before / 2).otherwise(before).alias("prev_close"), F.col("qty").cast("bigint").alias("volume"),
        (F.col("value") / TURNOVER_UNIT).alias("turnover"), (100 * F.col("delivered") / F.col("qty")).alias("deliv"))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The market series: the same daily aggregate without the symbol (one row per day)."""
    day = _daily(table(spark, d, "lineitem"), F.to_date("l_shipdate").alias("date"))
    return day.select("date", "high", "low", (F.col("value") / F.col("qty")).alias("close"), F.col("qty").cast("bigint").alias("volume"))


def sector_master(spark: SparkSession, d: str) -> DataFrame:
    """Supplier = instrument, nation = sector, region = group. Every 9th has no label, every 13th is a fund, every 17th is left out."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (s.where(key % 17 != 16)
            .join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), s.s_nationkey == n.n_nationkey)   # fixed lists of countries
            .select(key.alias("symbol"), F.col("s_name").alias("company_name"),
                    F.when(key % 13 == 12, "etf").when(key % 11 == 10, "unclassified").otherwise("operating_equity").alias("instrument_class"),
                    F.when(key % 9 != 8, F.col("n_name")).alias("sector_source_label"), F.col("r_name").alias("sector_group"),
                    F.date_sub(F.lit("2001-11-04").cast("date"), (key % 63).cast("int")).alias("last_confirmed")))


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """Six ratios per customer from its orders; some missing, negative or exactly zero."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), _value("o_totalprice").alias("v"), F.max(F.to_date("o_orderdate")).alias("fetched"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    unit = F.col("v") / (F.col("n") * 10000)
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        k.alias("symbol"), F.col("c_name").alias("company_name"), F.when(k % 5 != 4, F.col("c_mktsegment")).alias("sector"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(0.0)).when(k % 4 == 1, -unit).otherwise(unit).alias("pe"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 6 == 5, -unit / 10).otherwise(unit / 10).alias("pb"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_acctbal") / 200).alias("roe"),
        (F.col("c_acctbal") / 300).alias("roce"), F.when(k % 3 == 0, F.col("c_acctbal") / 500).alias("roa"),
        F.when(k % 19 == 0, F.lit(0.0)).otherwise(unit / 2).alias("ev_ebitda"), "fetched")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Decoded ticks in receive order. The exchange time lags the receive time and is missing, late or in the future for some; a
    price jump, a bad price, a missing previous close and a reconnect every eight hours are part of the data."""
    return ticks_from(table(spark, d, "events"))


def ticks_from(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    recv = F.unix_millis(F.col("ts").cast("timestamp"))
    price = (100 + F.col("value")) * F.when(i % 31 == 0, F.lit(1.5)).otherwise(F.lit(1.0))
    return e.select(
        F.col("user_id").alias("key"), i.alias("seq"), recv.alias("recv_ms"),
        F.when(i % 41 == 0, F.lit(-1.0)).otherwise(price).alias("ltp"),
        F.when(i % 23 == 0, F.lit(None)).when(i % 29 == 0, recv + 120000).when(i % 37 == 0, recv - 86400000).otherwise(recv - 500).alias("ltt"),
        F.when(i % 3 != 0, 100 + (F.col("user_id") % 20).cast("double")).alias("cp"),
        F.floor(recv / 28_800_000).alias("connection_id"),
        F.to_date(F.col("ts") + F.expr("interval 330 minutes")).alias("session_date"))


def year_values(spark: SparkSession, d: str) -> DataFrame:
    """Annual statement values: customer, calendar year, sum of order values (the basis follows the customer key)."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.year("o_orderdate").alias("fy")).agg(
        _value("o_totalprice").alias("value"), F.count(F.lit(1)).alias("lines"),
        F.max(F.to_date("o_orderdate")).alias("fetched"))


def quarter_values(spark: SparkSession, d: str, by: str = "o_custkey") -> DataFrame:
    """Quarterly values per customer, or per nation where a dense series is needed."""
    o = table(spark, d, "orders")
    if by == "c_nationkey":
        c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
        o = o.groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("qs"), "o_orderstatus").agg(
            F.sum(cents("o_totalprice")).alias("v"))                # combine first: the join then moves one row per customer-quarter
        o = o.join(c, o.o_custkey == c.c_custkey)
    else:
        o = o.select("o_custkey", F.trunc("o_orderdate", "quarter").alias("qs"), "o_orderstatus", cents("o_totalprice").alias("v"))
    end = F.last_day(F.add_months("qs", 2))
    return o.groupBy(F.col(by).alias("symbol"), end.alias("quarter_end")).agg(
        (F.sum("v") / 100).alias("revenue"), (F.sum(F.when(F.col("o_orderstatus") == "F", F.col("v"))) / 100).alias("profit"))


# The five order priorities stand for the five holder categories. Fixed values.
CATEGORY_OF = {"1-URGENT": "promoters", "2-HIGH": "fii", "3-MEDIUM": "other_dii", "4-NOT SPECIFIED": "mutual_funds", "5-LOW": "retail_other"}


def holdings(spark: SparkSession, d: str) -> DataFrame:
    """Shares per (symbol, period end, category) in long form."""
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])
    return table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("symbol"), F.last_day(F.add_months(F.trunc("o_orderdate", "year"), 11)).alias("period_end"),
        names[F.col("o_orderpriority")].alias("category")).agg(_value("o_totalprice").alias("shares"))


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """Instrument rows from `part`: repeated names, several series, missing and malformed identifiers."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("row_id"), F.when(k % 19 == 0, "BSE_EQ").otherwise("NSE_EQ").alias("segment"),
        F.when(k % 101 != 0, F.concat(F.lit("NSE_EQ|"), F.when(k % 67 == 0, k - 1).otherwise(k))).alias("instrument_key"),
        F.when(k % 7 == 0, F.upper(F.regexp_replace("p_name", " ", "-")))
         .when(k % 53 == 0, F.concat(F.lit("bad sym "), k)).otherwise(F.concat(F.upper(F.substring("p_type", 1, 3)), k)).alias("trading_symbol"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 31 == 0, F.concat(F.lit("XX"), k))
         .otherwise(F.concat(F.lit("INE"), F.lpad(F.when(k % 43 == 0, k - 1).otherwise(k).cast("string"), 9, "0"))).alias("isin"),
        F.when(k % 23 == 0, "PCA").when(k % 5 == 0, F.lit(None)).otherwise("NORMAL").alias("security_type"),
        F.when(k % 3 == 2, "BE").otherwise("EQ").alias("instrument_type"),
        F.when(k % 37 == 0, F.concat("p_name", F.lit(" ETF"))).otherwise(F.col("p_name")).alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
