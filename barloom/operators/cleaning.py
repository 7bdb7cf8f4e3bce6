"""Cleaning of raw daily rows and the de-duplication family. Raw columns are text; nothing unreliable is kept or guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import date_parse, num_parse
from barloom.operators.windows import change_1d
from barloom.rules import Rules

# Columns of a raw daily file.
REQUIRED = ("SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "HIGH_PRICE", "CLOSE_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS")
OPTIONAL = ("OPEN_PRICE", "LOW_PRICE", "DELIV_PER")


def symbol_days(raw: DataFrame) -> DataFrame:
    """EQ rows per (symbol, day): how many, whether they all agree, and their parsed fields. Two 64-bit hashes of the raw text stand for a row, so
    the whole group is a handful of numbers combined before the exchange, however many copies it holds; where all rows agree the
    largest value of a field is the field."""
    eq = raw.where(F.trim("SERIES") == "EQ")
    text = [F.coalesce(F.trim(c), F.lit("\0")) for c in REQUIRED + OPTIONAL]        # a hash skips nulls, so that a value could move unseen
    num = {c: num_parse(src) for c, src in (("close", "CLOSE_PRICE"), ("prev_close", "PREV_CLOSE"), ("volume", "TTL_TRD_QNTY"), ("turnover", "TURNOVER_LACS"),
                                            ("high", "HIGH_PRICE"), ("low", "LOW_PRICE"), ("open", "OPEN_PRICE"), ("deliv", "DELIV_PER"))}
    rows = eq.select(F.trim("SYMBOL").alias("symbol"), date_parse("DATE1").alias("date"), F.xxhash64(*text).alias("_h"), F.xxhash64(F.lit(17), *text).alias("_k"), *[v.alias(c) for c, v in num.items()])
    g = rows.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("copies"), F.min("_h").alias("_h1"), F.max("_h").alias("_h2"), F.min("_k").alias("_k1"), F.max("_k").alias("_k2"), *[F.max(c).alias(c) for c in num])
    return g.withColumn("conflict", (F.col("_h1") != F.col("_h2")) | (F.col("_k1") != F.col("_k2"))).drop("_h1", "_h2", "_k1", "_k2")


def _verdicts(groups: DataFrame) -> DataFrame:
    """Parsed fields with one flag per cleaning rule."""
    f = groups
    neg = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    low = lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))
    f = f.withColumns({"bad_close": F.col("close").isNull() | (F.col("close") <= 0), "bad_prev": F.col("prev_close").isNull() | (F.col("prev_close") <= 0),
                       "bad_volume": neg("volume"), "bad_turnover": neg("turnover"), "bad_high": low("high"), "bad_low": low("low"), "bad_open": low("open"),
                       "bad_deliv": F.coalesce(~F.col("deliv").between(0, 100), F.lit(False))})
    crossed = ~F.col("bad_high") & ~F.col("bad_low") & F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    f = f.withColumns({"crossed": crossed, "usable": ~F.col("conflict") & ~F.col("bad_close") & (F.col("symbol") != "")})
    keep = lambda c, *bad: F.when(~F.greatest(*[F.col(b) for b in bad]) if len(bad) > 1 else ~F.col(bad[0]), F.col(c))
    return f.withColumns({"prev_close": keep("prev_close", "bad_prev"), "volume": keep("volume", "bad_volume").cast("bigint"), "turnover": keep("turnover", "bad_turnover"),
                          "high": keep("high", "bad_high", "crossed"), "low": keep("low", "bad_low", "crossed"), "open": keep("open", "bad_open"), "deliv": keep("deliv", "bad_deliv")})


def clean_bars(raw: DataFrame) -> DataFrame:
    """One clean bar per symbol-day: identical repeats collapse, conflicting ones drop the symbol-day, impossible fields become NULL."""
    return _verdicts(symbol_days(raw)).where("usable").select("symbol", "date", "prev_close", "open", "high", "low", "close", "volume", "turnover", "deliv")


def clean_counts(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The counters of every cleaning rule per day."""
    v = change_1d(_verdicts(symbol_days(raw)))
    live = ~F.col("conflict") & (F.col("symbol") != "")
    ok = F.col("usable")
    n = lambda cond, what=None: F.coalesce(F.sum(F.when(cond, F.lit(1) if what is None else what)), F.lit(0))
    eq = v.groupBy("date").agg(
        F.sum("copies").alias("eq_rows"), n(live, F.col("copies") - 1).alias("duplicate_identical"), n(F.col("conflict")).alias("conflicting_duplicate_symbols"),
        n(live & F.col("bad_close")).alias("invalid_close"), n(ok & F.col("bad_prev")).alias("missing_prev_close"), n(ok & F.col("bad_volume")).alias("invalid_volume"),
        n(ok & F.col("bad_turnover")).alias("invalid_turnover"),
        n(ok, F.col("bad_high").cast("int") + F.col("bad_low").cast("int") + F.col("bad_open").cast("int") + F.col("crossed").cast("int")).alias("invalid_price_field"),
        n(ok & F.col("bad_deliv")).alias("invalid_delivery_pct"), n(ok & (F.abs("change_pct") > rules.extreme_change_pct)).alias("extreme_change"), n(ok).alias("usable_rows"))
    all_rows = raw.groupBy(date_parse("DATE1").alias("date")).agg(F.count(F.lit(1)).alias("raw_rows"), n(F.trim("SERIES") != "EQ").alias("other_series"))
    return all_rows.join(eq, "date", "left").na.fill(0)


def dedup_exact(df: DataFrame) -> DataFrame:
    """Each distinct row once, with the number of copies it had."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat with different values."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(rest).alias("_a"), F.max(rest).alias("_b"))
    return g.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "copies")


def dedup_conflict_gate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The de-duplicated rows, or a failed job if any key repeats with different values (decided by one small aggregate)."""
    bad = conflicts(df, keys).limit(1).count()
    if bad:
        raise ValueError(f"{keys} repeats with different values")
    return df.dropDuplicates(list(keys))


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Column, valid: Column) -> DataFrame:
    """Invalid rows go first; then the later row wins per key."""
    from barloom.plans.order import latest_by
    return latest_by(df.where(valid), keys, order)


def dedup_keep_none(df: DataFrame, key: str) -> DataFrame:
    """A key claimed more than once keeps no claimant: a combined aggregate picks the single claims, no window over hot keys."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    return one.where("_n = 1").select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def candle_valid() -> Column:
    ok = F.lit(True)
    for c in ("open", "high", "low", "close"):
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    return ok & (F.col("high") >= F.col("low"))


def stale_copy_verdict(rows: DataFrame, max_gap: int = 10) -> DataFrame:
    """Per (requested day, file): match, stale_copy (every row is dated one earlier, believable weekday) or mismatch. Input:
    requested DATE, file, found DATE NULL."""
    g = rows.groupBy("requested", "file").agg(F.min("found").alias("lo"), F.max("found").alias("hi"), F.count_if(F.col("found").isNull()).alias("undated"))
    one = (F.col("undated") == 0) & (F.col("lo") == F.col("hi"))
    believable = (F.weekday("requested") < 5) & (F.weekday("lo") < 5) & (F.col("lo") < F.col("requested")) & (F.datediff("requested", "lo") <= max_gap)
    verdict = F.when(one & (F.col("lo") == F.col("requested")), "match").when(one & believable, "stale_copy").otherwise("mismatch")
    return g.select("requested", "file", verdict.alias("verdict"), F.when(verdict == "stale_copy", F.col("lo")).alias("served"))


def response_kind(status: Column, has_symbol_header: Column, decodable: Column) -> Column:
    return (F.when(status == 404, "not_found").when(status.isin(401, 403), "access_denied").when(status == 429, "rate_limited")
            .when(status.between(500, 599), "server_error").when(status != 200, "http_error").when(~decodable, "undecodable")
            .when(~has_symbol_header, "invalid_response").otherwise("data"))


def timeframe_slice(bars: DataFrame, months: int, needs_full: bool) -> DataFrame:
    """The last `months` of each symbol's rows (indicators must already be computed on the full history). Long frames only where
    the history reaches back to their start."""
    w = Window.partitionBy("symbol")
    df = bars.withColumns({"_last": F.max("date").over(w), "_first": F.min("date").over(w)})
    start = F.add_months("_last", -months)
    keep = (F.col("date") >= start) & ((F.col("_first") <= start) if needs_full else F.lit(True))
    return df.where(keep).drop("_last", "_first")


def stale_series_label(last_dates: DataFrame, market_date: DataFrame) -> DataFrame:
    """Label a series whose last date is older than the market date (a one-row frame)."""
    j = last_dates.crossJoin(F.broadcast(market_date))
    return j.withColumn("label", F.when(F.col("last_date") < F.col("market_date"), F.concat(F.lit("as of "), F.col("last_date").cast("string"))).otherwise("current"))
