"""Market-wide aggregates and ranked lists over bars that already carry their one-day change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import rnd
from barloom.plans.order import latest_by, mid_rank_share, top_rows
from barloom.rules import ADJUST, INSUFFICIENT, SAFE, Rules


def liquid(rules: Rules = Rules()) -> Column:
    return F.coalesce(F.col("turnover") >= rules.liquid_turnover, F.lit(False))


def latest_rows(bars: DataFrame) -> DataFrame:
    """The newest bar of every symbol."""
    return latest_by(bars, ["symbol"], F.col("date"))


def last_day(bars: DataFrame) -> DataFrame:
    """Only the bars of the newest date (a one-row maximum, joined back)."""
    newest = bars.agg(F.max("date").alias("date"))
    return bars.join(F.broadcast(newest), "date", "left_semi")          # one row


def _breadth_columns(where: Column, prefix: str = "") -> list[Column]:
    ok = F.col("change").isNotNull() & where
    adv, dec = F.count_if(ok & (F.col("change") > 0)), F.count_if(ok & (F.col("change") < 0))
    return [adv.alias(prefix + "advancing"), dec.alias(prefix + "declining"), F.count_if(ok & (F.col("change") == 0)).alias(prefix + "unchanged"),
            F.count_if(ok).alias(prefix + "counted"), rnd(F.try_divide(adv, dec), 2).alias(prefix + "ad_ratio")]


def breadth(changed: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Advancing, declining and unchanged rows with a valid change; no ratio (and a note) without decliners."""
    out = changed.groupBy(*by).agg(*_breadth_columns(F.lit(True)))
    note = (F.when(F.col("declining") > 0, None).when(F.col("advancing") > 0, "no declining stocks, so the ratio is not defined")
            .otherwise("no stock with a valid change, so the ratio is not defined"))
    return out.withColumn("ad_ratio_note", note)


def breadth_scopes(changed: DataFrame, rules: Rules = Rules(), by: Sequence[str] = ("date",)) -> DataFrame:
    """The same counts for all rows and for the liquid ones, in one pass."""
    return changed.groupBy(*by).agg(*_breadth_columns(F.lit(True), "all_"), *_breadth_columns(liquid(rules), "liquid_"))


def scan_breadth(scan: DataFrame) -> DataFrame:
    """One row over the liquid rows of the scan day."""
    share = lambda cond: rnd(100 * F.count_if(cond) / F.count(F.lit(1)), 1)
    return scan.agg(F.count_if(F.col("chg") > 0).alias("advancing"), F.count_if(F.col("chg") < 0).alias("declining"),
                    F.count_if(F.col("chg") == 0).alias("unchanged"), share(F.col("close") > F.col("dma_fast")).alias("above_50dma_pct"),
                    share(F.col("close") > F.col("dma_slow")).alias("above_200dma_pct"), F.count_if(F.col("close") > F.col("high252")).alias("new_52w_highs"))


def dma_breadth(latest: DataFrame, periods: Sequence[int] = (20, 50, 200)) -> DataFrame:
    """Share of symbols above their guarded average; only safe averages count, the rest are exclusions by reason. One pass for all periods."""
    def counts(n):
        s = F.coalesce(F.col(f"sma_{n}_status"), F.lit(INSUFFICIENT))
        return F.struct(F.lit(n).alias("period"), F.count_if((s == SAFE) & (F.col(f"sma_{n}_position") == "above")).alias("numerator"),
                        F.count_if(s == SAFE).alias("denominator"), F.count_if(s == INSUFFICIENT).alias("insufficient"), F.count_if(s == ADJUST).alias("adjust"))
    out = latest.agg(F.array(*[counts(n) for n in periods]).alias("c")).select(F.inline("c"))
    status = (F.when(F.col("denominator") > 0, SAFE).when((F.col("adjust") > 0) & (F.col("insufficient") == 0), ADJUST).otherwise(INSUFFICIENT))
    return out.withColumns({"pct": rnd(F.try_divide(F.col("numerator"), F.col("denominator")) * 100, 2), "status": status})


def breadth_document(latest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The newest rows' breadth, a row a scope, with the newest date and the number of symbols."""
    names = ("advancing", "declining", "unchanged", "counted", "ad_ratio")
    row = latest.agg(F.max("date").alias("as_of"), F.count(F.lit(1)).alias("universe"), *_breadth_columns(F.lit(True), "all_"), *_breadth_columns(liquid(rules), "liquid_"))
    scope = lambda s: F.struct(F.lit(s).alias("scope"), *[F.col(f"{s}_{n}").alias(n) for n in names])
    return row.select("as_of", "universe", F.inline(F.array(scope("all"), scope("liquid"))))


def dma_document(latest: DataFrame, periods: Sequence[int] = (20, 50, 200)) -> DataFrame:
    """Every symbol's guarded averages, a row a period."""
    each = lambda n: F.struct(F.lit(n).alias("period"), F.col(f"sma_{n}").alias("value"), F.least(F.col("rn"), F.lit(n)).cast("int").alias("observations"),
                              F.col(f"sma_{n}_status").alias("state"), F.col(f"sma_{n}_position").alias("position"))
    return latest.select("symbol", F.inline(F.array(*[each(n) for n in periods])))


def high_low_counts(latest: DataFrame) -> DataFrame:
    s = F.col("extreme_status")
    return latest.agg(F.count_if(F.col("high_state") == "new_high").alias("new_highs"), F.count_if(F.col("low_state") == "new_low").alias("new_lows"),
                      F.count_if(s == SAFE).alias("denominator"), F.count_if(s == INSUFFICIENT).alias("insufficient"), F.count_if(s == ADJUST).alias("adjust"),
                      F.count_if(s == "unavailable").alias("unavailable"),
                      F.when(F.count_if(s == SAFE) > 0, SAFE).when((F.count_if(s == ADJUST) > 0) & (F.count_if(s == INSUFFICIENT) == 0), ADJUST)
                      .otherwise(INSUFFICIENT).alias("status"))


def metric_status(latest: DataFrame) -> DataFrame:
    """One status per published metric. Whole-market 30 and 90 day performance always needs adjusted closes, which raw bars are not."""
    has = lambda cond: F.when(F.count_if(cond) > 0, SAFE).otherwise(INSUFFICIENT)
    row = latest.agg(has(F.col("change").isNotNull()).alias("one_day"), has(F.col("sma_50_status") == SAFE).alias("dma_50"),
                     has(F.col("sma_200_status") == SAFE).alias("dma_200"), has(F.col("extreme_status") == SAFE).alias("high_low_52w"),
                     has(F.col("volume_status") == SAFE).alias("volume"), F.lit(ADJUST).alias("performance_30d"), F.lit(ADJUST).alias("performance_90d"))
    return row.unpivot([], row.columns, "metric", "status")


LINE = ("symbol", "close", "prev_close", "change", "change_pct", "volume", "turnover", "deliv")


def ranked(df: DataFrame, label: str, order: Sequence[Column], rows: int) -> DataFrame:
    return top_rows(df, order, rows).withColumn("list", F.lit(label))


def ranked_lists(df: DataFrame, lists: Sequence[tuple[str, Column, Column, int]], columns: Sequence[str], value: str | None = None) -> DataFrame:
    """Several ranked lists in one pass over `df`: (name, which rows, key with the best largest, length), ties by symbol. A row is exploded into the
    lists it belongs to; each task keeps only its own best rows of each list before the exchange."""
    entry = lambda name, cond, key, n: F.when(cond, F.struct(F.lit(name).alias("list"), key.cast("double").alias("_key"), F.lit(n).alias("_n")))
    rows = df.select(*columns, F.inline(F.array_compact(F.array(*[entry(*x) for x in lists]))))
    w = Window.partitionBy("list").orderBy(F.desc_nulls_last("_key"), F.asc("symbol"))
    best = rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= max(x[3] for x in lists)) & (F.col("rank") <= F.col("_n")))
    if value:
        flip = F.col("list").isin(*[x[0] for x in lists if x[0] in ASCENDING])
        best = best.withColumn(value, F.when(flip, -F.col("_key")).otherwise(F.col("_key")))
    return best.drop("_key", "_n")


ASCENDING = ("losers", "new_low", "near_low")        # lists whose best row has the smallest value


def top_movers(latest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    pct = F.col("change_pct")
    return ranked_lists(latest.where(liquid(rules)), [("gainers", pct > 0, pct, rules.rows_movers), ("losers", pct < 0, -pct, rules.rows_movers)], LINE)


def most_active(latest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    t, v = F.col("turnover"), F.col("volume")
    return ranked_lists(latest, [("by_value", t > 0, t, rules.rows_active), ("by_volume", v > 0, v, rules.rows_active)], LINE)


def volume_shockers(latest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Liquid rows with a safe baseline whose volume is a multiple of it; also those that moved with it."""
    hot = latest.where(liquid(rules) & (F.col("volume_status") == SAFE) & (F.col("volume") > 0) & (F.col("volume_multiple") >= rules.vol_multiple))
    m, pct, n = F.col("volume_multiple"), F.col("change_pct"), rules.rows_volume
    return ranked_lists(hot, [("shockers", F.lit(True), m, n), ("high_volume_gain", pct >= rules.gain_pct, m, n), ("high_volume_loss", pct <= rules.loss_pct, m, n)],
                        ("symbol", "close", "change_pct", "volume", "avg_volume", "volume_multiple", "turnover", "deliv"))


def high_low_lists(latest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """New and near highs and lows by distance, each with its full count. `latest` is read twice (lists and counts)."""
    safe = latest.where(F.col("extreme_status") == SAFE)
    high = F.col("list").isin("new_high", "near_high")
    lists = [(n, F.col(f"{k}_state") == n, F.col(f"{k}_distance_pct") * (1 if k == "high" else -1), rules.rows_extremes) for n, k in (("new_high", "high"), ("near_high", "high"), ("new_low", "low"), ("near_low", "low"))]
    top = ranked_lists(safe, lists, ("symbol", "close", "prior_high", "prior_high_date", "high_distance_pct", "prior_low", "prior_low_date", "low_distance_pct"))
    states = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond, _, _ in lists]))
    totals = safe.select(F.explode(states).alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("full_count"))
    pick = lambda c: F.when(high, F.col(c.format("high"))).otherwise(F.col(c.format("low")))
    return top.join(F.broadcast(totals), "list").select("list", "symbol", "close", pick("prior_{}").alias("prior_extreme"), pick("prior_{}_date").alias("prior_date"), pick("{}_distance_pct").alias("distance_pct"), "rank", "full_count")      # four rows


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scan_frame(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Liquid rows of the scan day with unrounded change, volume multiple and the 1..99 strength rating. Input: latest rows of
    bars carrying dma_fast, dma_slow, dma_state, vol20, deliv20, high252 and ret63."""
    t = rows.where(liquid(rules)).withColumns({"chg": (F.try_divide(F.col("close"), F.col("prev_close")) - 1) * 100,
                                               "volx": F.try_divide(F.col("volume"), F.col("vol20"))})
    return rs_rating(t)


def rs_rating(scan: DataFrame) -> DataFrame:
    """Average-tie share rank of the 63-row return, stretched to 1..99."""
    shared = mid_rank_share(scan, "ret63", "_share")
    return shared.withColumn("rs", rnd(F.col("_share") * 98 + 1)).drop("_share")


def scan_lists(scan: DataFrame) -> DataFrame:
    """The seven scans as one long table (list, rank, symbol, value)."""
    c = F.col
    lists = [("gainers", c("chg").isNotNull(), c("chg"), 25), ("losers", c("chg").isNotNull(), -c("chg"), 25), ("volume_gainers", (c("chg") > 0) & (c("volx") >= 2), c("volx"), 25),
             ("high_52w", c("close") > c("high252"), c("chg"), 25), ("delivery", (c("deliv") > c("deliv20") * 1.3) & (c("chg") > 0), c("deliv"), 25),
             ("dma", c("dma_state") != "Not enough history", c("rs"), 500), ("relative_strength", c("rs").isNotNull(), c("rs"), 100)]
    return ranked_lists(scan, lists, ("symbol", "close"), value="value")


def scan_events(scan: DataFrame) -> DataFrame:
    """Facts of the day, each (type, symbol) once: one pass, one row exploded into the facts that hold."""
    facts = F.array_compact(F.array(
        F.when(F.col("close") > F.col("high252"), "New 52-week high"), F.when(F.abs(rnd("chg", 2)) >= 5, "Large move"),
        F.when(rnd("volx", 2) >= 2, "Unusual volume"), F.when(F.col("dma_state") == "Golden cross today", "50-day crossed above 200-day"),
        F.when(F.col("dma_state") == "Death cross today", "50-day crossed below 200-day")))
    return scan.select(F.explode(facts).alias("type"), "symbol").distinct()
