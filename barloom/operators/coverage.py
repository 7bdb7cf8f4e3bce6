"""Coverage counts, freshness classes and work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import backoff_days, rnd
from barloom.plans.order import group_medians, running_position, top_rows

CLASSES = ("valid", "stale", "missing", "invalid", "not_applicable", "unverified")


def coverage_module(classed: DataFrame, by: str = "module") -> DataFrame:
    """Counts per class that add up to the rows, with coverage and freshness shares."""
    g = classed.groupBy(by).agg(F.count(F.lit(1)).alias("denominator"), *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])
    covered = F.col("valid") + F.col("stale")
    return g.select(by, "denominator", *CLASSES, rnd(100 * covered / F.col("denominator"), 2).alias("coverage_pct"), rnd(100 * F.try_divide(covered, F.col("denominator") - F.col("not_applicable")), 2).alias("coverage_pct_of_applicable"),
                    rnd(100 * F.col("valid") / F.col("denominator"), 2).alias("fresh_pct"), (F.col("denominator") == sum((F.col(c) for c in CLASSES), F.lit(0))).alias("adds_up"))


def state_class(fetched: Column, problem: Column, today: Column, max_age: int, unverified: Column | None = None) -> Column:
    age = F.datediff(today, fetched)
    base = F.when(fetched.isNull(), "missing").when(problem.isNotNull() | (age < 0), "invalid")
    if unverified is not None:
        base = base.when(unverified, "unverified")
    return base.when(age > max_age, "stale").otherwise("valid")


def cell_counter(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Present, null and zero per field in one aggregate."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.count(f).alias("present"), F.count_if(F.col(f).isNull()).alias("null"), F.count_if(F.col(f) == 0).alias("zero")) for f in fields])
    return df.agg(cells.alias("c")).select(F.inline("c"))


def stats_min_med_max(df: DataFrame, value: str, by: str) -> DataFrame:
    g = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
    return g.join(group_medians(df, by, value, "median"), by, "left")


def age_bucket(days: Column) -> Column:
    return F.when(days.isNull() | (days < 0), None).when(days <= 6, "0-6").when(days <= 13, "7-13").when(days <= 29, "14-29").otherwise("30+")


def fundamentals_coverage(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Completeness and the seven exclusive categories over the universe in one pass. Input per symbol: published, listed, held, invalid, error, metrics."""
    filled = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    p = F.col("published")
    kind = (F.when(p & ~F.col("listed"), "published_not_listed").when(p, "published_listed").when(F.col("held"), "held_isin_change").when(~F.col("listed"), "not_in_source").when(F.col("invalid"), "invalid")
            .when(F.col("error").isNotNull(), "failed").otherwise("not_yet_fetched"))
    r = rows.withColumns({"_f": filled, "_k": kind})
    names = ("published_listed", "published_not_listed", "held_isin_change", "not_in_source", "invalid", "failed", "not_yet_fetched")
    return r.agg(F.count(F.lit(1)).alias("universe"), F.count_if(p & (F.col("_f") == len(metrics))).alias("complete"), F.count_if(p & F.col("_f").between(1, len(metrics) - 1)).alias("partial"), F.count_if(p & (F.col("_f") == 0)).alias("none"),
                 *[F.count_if(p & F.col(m).isNotNull()).alias(f"has_{m}") for m in metrics], *[F.count_if(F.col("_k") == n).alias(n) for n in names])


def quarterly_coverage(q: DataFrame) -> DataFrame:
    newest = q.groupBy("symbol").agg(F.max("quarter_end").alias("latest"))
    return newest.groupBy("latest").agg(F.count(F.lit(1)).alias("stocks"))


def run_tally_status(done: Column, failed: Column, remaining: Column) -> Column:
    return F.when((done == 0) & (failed > 0), "failed").when((failed > 0) | (remaining > 0), "incomplete").otherwise("complete")


def flow_latest(flows: DataFrame) -> DataFrame:
    """Buy, sell and net per side on the newest date of the table; a side without that date is absent, never mixed in from an older day."""
    newest = flows.agg(F.max("date").alias("date"))
    f = flows.join(F.broadcast(newest), "date", "left_semi")                                       # one row
    side = lambda s: [F.sum(F.when(F.col("category") == s, F.col(c))).alias(f"{s.lower()}_{c}") for c in ("buy", "sell", "net")]
    return f.groupBy("date").agg(*side("FII"), *side("DII"))


def ltp_change(candles: DataFrame) -> DataFrame:
    """Last valid close and its change against the previous valid one; one valid row has neither."""
    v = candles.where((F.col("close") > 0) | (F.col("close") <= 0)).select("symbol", "date", "close").where(F.col("date").isNotNull())
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    last2 = v.withColumn("k", F.row_number().over(w)).where("k <= 2")
    g = last2.groupBy("symbol").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("b"), F.max("date").alias("as_of"), F.count(F.lit(1)).alias("n"))
    two = F.col("n") == 2
    return g.select("symbol", F.when(two, F.col("as_of")).alias("as_of"), F.when(two, F.col("a")).alias("ltp"), F.when(two & (F.col("b") > 0), (F.col("a") / F.col("b") - 1) * 100).alias("change_pct"))


def session_summary(series: DataFrame, label: str, max_days: int = 7) -> DataFrame:
    """Last close, previous close (at most a week old) and change of each labelled series."""
    w = Window.partitionBy(label).orderBy("date")
    s = series.select(label, "date", "close", F.lag("close").over(w).alias("prev"), F.lag("date").over(w).alias("prev_on"))
    g = s.groupBy(label).agg(F.max("date").alias("date"), F.max_by(F.struct("close", "prev", "prev_on"), "date").alias("r"))
    prev = F.when(F.datediff("date", F.col("r.prev_on")) <= max_days, F.col("r.prev"))
    return g.select(label, "date", F.col("r.close").alias("close"), prev.alias("previous_close"), F.when(prev > 0, (F.col("r.close") / prev - 1) * 100).alias("change_pct"))


def refresh_state(today: Column, ratios_age: int = 7, profile_age: int = 90) -> Column:
    """fresh / stale / missing / invalid / failed_due / failed_backoff / not_listed / isin_held. Columns: listed, isin_changed, last_error, failures,
    last_attempt, invalid, ratios_fetched, profile_fetched."""
    failed = F.col("last_error").isNotNull()
    waiting = failed & F.coalesce(F.datediff(today, "last_attempt") < backoff_days(F.col("failures")), F.lit(False))
    old = lambda c, n: F.col(c).isNull() | (F.datediff(today, F.col(c)) >= n)
    return (F.when(~F.col("listed"), "not_listed").when(F.col("isin_changed"), "isin_held").when(waiting, "failed_backoff").when(F.col("invalid"), "invalid")
            .when(F.col("ratios_fetched").isNull() & failed, "failed_due").when(F.col("ratios_fetched").isNull(), "missing")
            .when((old("ratios_fetched", ratios_age) | old("profile_fetched", profile_age)) & failed, "failed_due").when(old("ratios_fetched", ratios_age) | old("profile_fetched", profile_age), "stale").otherwise("fresh"))


def results_pending(newest_quarter: Column, last_checked: Column, today: Column) -> tuple[Column, Column]:
    """(inside the window in which the next result is expected, due to be asked for now)."""
    start = F.date_add(F.last_day(F.add_months(newest_quarter, 3)), 10)
    inside = F.coalesce((start <= today) & (today <= F.date_add(start, 90)), F.lit(False))
    age = F.datediff(today, last_checked)
    return inside, last_checked.isNull() | F.when(inside, age >= 2).otherwise(age >= 30)


def worklist_budget_cut(items: DataFrame, order: Sequence[Column], cost: str, budget: int, rows: int | None = None) -> DataFrame:
    """Items in order until the first one that would exceed the budget; nothing after it is taken, however cheap."""
    r = running_position(items, order, position="position", totals={"spent": F.col(cost)})
    over = r.agg(F.min(F.when(F.col("spent") > budget, F.col("position"))).alias("_cut"))
    j = r.crossJoin(F.broadcast(over))                                                              # one row
    take = F.coalesce(F.col("position") < F.col("_cut"), F.lit(True))
    return j.where(take & (F.col("position") <= rows) if rows else take).drop("_cut")


def worklist_due_first(items: DataFrame, today: Column, max_age: int, budget: int) -> DataFrame:
    """Never fetched, then oldest past the refresh age, at most `budget` of them."""
    due = items.where(F.col("fetched").isNull() | (F.datediff(today, "fetched") >= max_age))
    return top_rows(due, [F.asc_nulls_first("fetched"), F.asc("symbol")], budget)


def worklist_share(items: DataFrame, budget: int) -> DataFrame:
    """Rechecks take half of the budget, new keys the rest, then the remaining rechecks. Columns: symbol, recheck."""
    o = [F.when(F.col("recheck"), 0).otherwise(1), F.col("symbol")]
    r = running_position(items, o, position="_p")
    n = r.agg(F.count_if("recheck").alias("_r"), F.count_if(~F.col("recheck")).alias("_k"))
    j = r.crossJoin(F.broadcast(n))                                                                  # one row
    half = F.least(F.lit(budget // 2), F.col("_r"))
    new = F.least(F.col("_k"), F.lit(budget) - half)
    slot = F.when(F.col("recheck") & (F.col("_p") <= half), F.col("_p")).when(~F.col("recheck"), half + F.col("_p") - F.col("_r")).otherwise(new + F.col("_p"))
    ok = F.when(F.col("recheck"), slot <= budget).otherwise(F.col("_p") - F.col("_r") <= new)
    return j.where(ok).select(*items.columns, slot.alias("position"))


def batch_partition(items: DataFrame, order: Sequence[Column], size: int = 500, key: str = "symbol") -> DataFrame:
    """Ordered batches of at most `size` keys with the hash of each batch's key list."""
    r = running_position(items, order, position="position").withColumn("batch", F.floor((F.col("position") - 1) / size) + 1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), "\n")
    return r.groupBy("batch").agg(F.count(F.lit(1)).alias("symbols"), F.sha2(listed, 256).alias("hash"))              # at most `size` keys each


def batch_cost(batches: DataFrame, seconds: float, per_run: int) -> DataFrame:
    """Nominal and worst calls, runs and hours per batch from its counts of missing, stale and invalid keys."""
    nominal = F.col("missing") * 3 + F.col("stale") * 3 + F.col("invalid") * 3
    worst = F.col("missing") * 6 + F.col("stale") * 3 + F.col("invalid") * 3
    return batches.select("batch", nominal.alias("nominal_calls"), worst.alias("worst_calls"), F.ceil(nominal / per_run).alias("runs"), rnd(nominal * seconds / 3600, 2).alias("hours"))


def plan_reconcile(before: DataFrame, now: DataFrame) -> DataFrame:
    """Batches claimed complete before that are not complete now."""
    j = before.where("complete").select("batch").join(now.select("batch", "complete", "remaining"), "batch", "left")
    return j.where(~F.coalesce("complete", F.lit(False))).select("batch", "remaining")


def attempts_update(old: DataFrame, tried: DataFrame) -> DataFrame:
    """A key that gained nothing counts one more attempt, one that gained is removed. tried: symbol, gained, day."""
    j = old.select("symbol", "count", F.col("last").alias("_last")).join(tried, "symbol", "full")
    return j.where(~F.coalesce("gained", F.lit(False))).select("symbol", (F.coalesce("count", F.lit(0)) + F.col("gained").isNotNull().cast("int")).alias("count"), F.coalesce("day", "_last").alias("last"))
