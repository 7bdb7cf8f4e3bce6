"""Per-symbol series metrics.

Every function uses one window specification (partition by symbol, order by date), so a job that chains them pays for one
exchange and one sort. Sums run as exact whole-number prefix totals (frame total = total now - total n rows ago) and
extremes by doubling, so the cost per row does not grow with the length of the frame. A symbol has at most one row per
calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import rnd
from barloom.rules import ADJUST, INSUFFICIENT, SAFE, UNAVAILABLE, Rules

MICRO = 1_000_000


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def micro(c: Column) -> Column:
    """A price as whole millionths: exact to add, in any order."""
    return rnd(c * MICRO).cast("bigint")


def valid_change(prev: Column, close: Column) -> Column:
    return (prev > 0) & (close > 0) & ((close - prev) / prev * 100 >= -100)


def change_1d(bars: DataFrame) -> DataFrame:
    """One-day change against the source's own previous close; NULL when either price is unusable."""
    prev, close = F.col("prev_close"), F.col("close")
    ok = valid_change(prev, close)
    return bars.withColumns({"change": F.when(ok, rnd(close - prev, 2)), "change_pct": F.when(ok, rnd((close - prev) / prev * 100, 2))})


def own_previous(bars: DataFrame) -> DataFrame:
    return bars.withColumn("own_prev", F.lag("close").over(by_symbol()))


def event_ratio(rules: Rules) -> Column:
    ratio = F.col("prev_close") / F.col("own_prev")
    return F.when((F.col("prev_close") > 0) & (F.col("own_prev") > 0) & (F.abs(ratio - 1) > rules.event_threshold), ratio)


def adjustment_events(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Days whose reference price differs from the symbol's own last close by more than the threshold."""
    return own_previous(bars).select("symbol", "date", rnd(event_ratio(rules), 4).alias("ratio")).where("ratio IS NOT NULL")


def with_series(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Row number, date of the last adjustment so far, and the prefix totals the metrics below share."""
    marked = own_previous(bars).withColumn("event_on", F.when(event_ratio(rules).isNotNull(), F.col("date")))
    return marked.withColumns({
        "rn": F.row_number().over(by_symbol()), "last_event": F.max("event_on").over(so_far()),
        "cum_close": F.sum(micro(F.col("close"))).over(so_far()), "cum_volume": F.sum("volume").over(so_far()),
        "cum_no_volume": F.sum(F.when(F.col("volume").isNull(), 1).otherwise(0)).over(so_far())})


def back(c: str, n: int, default=None) -> Column:
    return F.lag(c, n, default).over(by_symbol())


def sma_guarded(series: DataFrame, n: int, rules: Rules = Rules()) -> DataFrame:
    """Average of the last n closes with its status and the close's position against it. Input: `with_series`."""
    first = back("date", n - 1)
    total = F.col("cum_close") - F.coalesce(back("cum_close", n), F.lit(0))
    status = (F.when((F.col("rn") < n) | (F.datediff("date", first) > n * rules.sma_span_factor), INSUFFICIENT)
              .when(F.col("last_event") > first, ADJUST).otherwise(SAFE))
    out = series.withColumns({f"sma_{n}_status": status, f"_mean_{n}": rnd(total / (n * MICRO), 2)})
    value = F.when(F.col(f"sma_{n}_status") == SAFE, F.col(f"_mean_{n}"))
    side = (F.when(F.col("close") > value, "above").when(F.col("close") < value, "below").when(value.isNotNull(), "equal"))
    return out.withColumns({f"sma_{n}": value, f"sma_{n}_position": side}).drop(f"_mean_{n}")


def trailing_max(df: DataFrame, values: dict[str, Column], n: int) -> DataFrame:
    """Largest value of the previous n rows (current excluded). The reach grows fourfold per step: about log4(n) steps of three
    look-backs instead of n comparisons per row, and all values share each step."""
    reach = {into: f"_reach_{into}" for into in values}
    df = df.withColumns({reach[into]: v for into, v in values.items()})
    size = 1
    while size * 4 <= n:
        df = df.withColumns({c: F.greatest(F.col(c), *[back(c, size * i) for i in (1, 2, 3)]) for c in reach.values()})
        size *= 4
    starts = sorted({1 + size * i for i in range(n // size)} | {n - size + 1})
    pick = lambda c: F.greatest(*[back(c, s) for s in starts]) if len(starts) > 1 else back(c, 1)
    return df.withColumns({into: pick(c) for into, c in reach.items()}).drop(*reach.values())


def high_low_52w(series: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Close against the highest high and lowest low of the previous `extreme_rows` rows, with the last day each was reached."""
    n = rules.extreme_rows
    bad = lambda c: F.sum(F.when(F.col(c).isNull() | (F.col(c) <= 0), 1).otherwise(0)).over(so_far())
    df = series.withColumns({"_bad_high": bad("high"), "_bad_low": bad("low")})
    df = trailing_max(df, {"_top": F.struct(F.col("high").alias("v"), F.col("date").alias("d")),
                           "_bottom": F.struct((-F.col("low")).alias("v"), F.col("date").alias("d"))}, n)
    first = back("date", n)
    status = (F.when((F.col("rn") < n + 1) | (F.datediff("date", first) > rules.extreme_span), INSUFFICIENT)
              .when(F.col("last_event") > first, ADJUST))
    ok = lambda c: back(c, 1) - F.coalesce(back(c, n + 1), F.lit(0)) == 0
    df = df.withColumns({"_status": status, "_high_ok": ok("_bad_high"), "_low_ok": ok("_bad_low")})
    safe_high, safe_low = F.col("_status").isNull() & F.col("_high_ok"), F.col("_status").isNull() & F.col("_low_ok")
    close, top, low = F.col("close"), F.col("_top.v"), -F.col("_bottom.v")
    near = rules.near_pct / 100
    return df.withColumns({
        "extreme_status": F.coalesce("_status", F.when(F.col("_high_ok") | F.col("_low_ok"), SAFE).otherwise(UNAVAILABLE)),
        "prior_high": F.when(safe_high, top), "prior_high_date": F.when(safe_high, F.col("_top.d")),
        "high_state": F.when(safe_high, F.when(close > top, "new_high").when(close >= top * (1 - near), "near_high").otherwise("away")),
        "high_distance_pct": F.when(safe_high, rnd((close / top - 1) * 100, 2)),
        "prior_low": F.when(safe_low, low), "prior_low_date": F.when(safe_low, F.col("_bottom.d")),
        "low_state": F.when(safe_low, F.when(close < low, "new_low").when(close <= low * (1 + near), "near_low").otherwise("away")),
        "low_distance_pct": F.when(safe_low, rnd((close / low - 1) * 100, 2)),
    }).drop("_bad_high", "_bad_low", "_top", "_bottom", "_status", "_high_ok", "_low_ok")


def volume_multiple(series: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Volume against the average of the previous `vol_period` rows."""
    n = rules.vol_period
    first = back("date", n)
    total = back("cum_volume", 1) - F.coalesce(back("cum_volume", n + 1), F.lit(0))
    gaps = back("cum_no_volume", 1) - F.coalesce(back("cum_no_volume", n + 1), F.lit(0))
    df = series.withColumns({"_total": total, "_status": F.when(F.col("volume").isNull() | (F.col("rn") < n + 1), INSUFFICIENT)
                             .when(gaps > 0, UNAVAILABLE).when(F.datediff("date", first) > rules.vol_span, INSUFFICIENT)
                             .when(F.col("last_event") > first, ADJUST).when(total <= 0, UNAVAILABLE).otherwise(SAFE)})
    safe = F.col("_status") == SAFE
    return df.withColumns({"volume_status": F.col("_status"), "avg_volume": F.when(safe, rnd(F.col("_total") / n)),
                           "volume_multiple": F.when(safe, rnd(F.col("volume") / (F.col("_total") / n), 2))}).drop("_total", "_status")


def roll_mean(bars: DataFrame, n: int, into: str) -> DataFrame:
    df = bars.withColumn("_cum", F.sum(micro(F.col("close"))).over(so_far()))
    full = (F.col("_cum") - F.coalesce(back("_cum", n), F.lit(0))) / (n * MICRO)
    return df.withColumn(into, F.when(F.row_number().over(by_symbol()) >= n, full)).drop("_cum")


def roll_prev_mean(bars: DataFrame, value: str, n: int, min_rows: int, into: str) -> DataFrame:
    """Mean of the previous n rows (current excluded) once `min_rows` of them hold a value."""
    v, whole = F.col(value), dict(bars.dtypes)[value] in ("int", "bigint")              # whole numbers are summed as they are
    df = bars.withColumns({"_cum": F.coalesce(F.sum(v if whole else micro(v)).over(so_far()), F.lit(0)), "_cnt": F.count(v).over(so_far())})
    total = back("_cum", 1) - F.coalesce(back("_cum", n + 1), F.lit(0))
    seen = back("_cnt", 1) - F.coalesce(back("_cnt", n + 1), F.lit(0))
    return df.withColumn(into, F.when(seen >= min_rows, total / (seen * (1 if whole else MICRO)))).drop("_cum", "_cnt")


def roll_prev_max(bars: DataFrame, value: str, n: int, min_rows: int, into: str) -> DataFrame:
    df = bars.withColumn("_cnt", F.count(value).over(so_far()))
    df = trailing_max(df, {"_top": F.col(value)}, n)
    seen = back("_cnt", 1) - F.coalesce(back("_cnt", n + 1), F.lit(0))
    return df.withColumn(into, F.when(seen >= min_rows, F.col("_top"))).drop("_cnt", "_top")


def return_rows(bars: DataFrame, n: int, into: str) -> DataFrame:
    base = back("close", n)
    return bars.withColumn(into, F.when(base != 0, (F.col("close") / base - 1) * 100))


def _cross_state() -> Column:
    f, s, c = F.col("dma_fast"), F.col("dma_slow"), F.col("close")
    return (F.when(s.isNull(), "Not enough history")
             .when((F.col("_pf") <= F.col("_ps")) & (f > s), "Golden cross today")
             .when((F.col("_pf") >= F.col("_ps")) & (f < s), "Death cross today")
             .when((c > f) & (c > s), "Above both").when((c < f) & (c < s), "Below both").otherwise("Between the two"))


def crosses(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """State of the fast against the slow average; a cross also needs the averages of the day before."""
    df = roll_mean(roll_mean(bars, fast, "dma_fast"), slow, "dma_slow")
    df = df.withColumns({"_pf": back("dma_fast", 1), "_ps": back("dma_slow", 1)})
    return df.withColumn("dma_state", _cross_state()).drop("_pf", "_ps")


def scan_columns(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """All technical-scan columns at once: prefix totals in one window step, look-backs in the next, so the number of passes over a symbol's
    rows does not grow with the number of columns. Same values as the single functions above."""
    total = lambda c: F.coalesce(F.sum(micro(F.col(c))).over(so_far()), F.lit(0))
    volume = F.coalesce(F.sum("volume").over(so_far()), F.lit(0))                        # whole: no scaling that could overflow
    df = bars.withColumns({"_rn": F.row_number().over(by_symbol()), "_c": total("close"), "_v": volume, "_vn": F.count("volume").over(so_far()), "_d": total("deliv"),
                           "_dn": F.count("deliv").over(so_far()), "_hn": F.count("high").over(so_far())})
    upto = lambda c, n: F.col(c) - F.coalesce(back(c, n), F.lit(0))
    before = lambda c, n: back(c, 1) - F.coalesce(back(c, n + 1), F.lit(0))
    mean = lambda c, cnt, n, least, scale=MICRO: F.when(before(cnt, n) >= least, before(c, n) / (before(cnt, n) * scale))
    base = back("close", 63)
    df = df.withColumns({"dma_fast": F.when(F.col("_rn") >= fast, upto("_c", fast) / (fast * MICRO)), "dma_slow": F.when(F.col("_rn") >= slow, upto("_c", slow) / (slow * MICRO)),
                         "vol20": mean("_v", "_vn", 20, 20, 1), "deliv20": mean("_d", "_dn", 20, 10), "ret63": F.when(base != 0, (F.col("close") / base - 1) * 100), "_seen": before("_hn", 252)})
    df = trailing_max(df, {"_top": F.col("high")}, 252)
    df = df.withColumns({"_pf": back("dma_fast", 1), "_ps": back("dma_slow", 1), "high252": F.when(F.col("_seen") >= 150, F.col("_top"))})
    return df.withColumn("dma_state", _cross_state()).drop("_rn", "_c", "_v", "_vn", "_d", "_dn", "_hn", "_seen", "_top", "_pf", "_ps")


def longest_gap_days(bars: DataFrame) -> DataFrame:
    gaps = bars.select("symbol", F.datediff(F.lead("date").over(by_symbol()), "date").alias("gap"))
    return gaps.groupBy("symbol").agg(F.max("gap").alias("longest_gap_days"), F.count(F.lit(1)).alias("rows"))
