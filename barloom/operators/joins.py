"""Joins of the market data model. Sides whose size is bounded by the calendar or by one row are broadcast; everything else is left
to the planner, which measures it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import by_symbol


def universe_match(members: DataFrame, instruments: DataFrame) -> DataFrame:
    """Every member with `reason` NULL when kept: the instrument must exist and its identifier agree when the list gives one."""
    i = instruments.select(F.col("symbol").alias("_s"), F.col("isin").alias("_isin"), F.col("name").alias("_name"))
    j = members.join(i, members.symbol == F.col("_s"), "left")
    reason = F.when(F.col("_s").isNull(), "not_in_instruments").when(F.col("isin") != F.col("_isin"), "isin_differs")
    kept = reason.isNull()
    return j.select("symbol", F.when(kept, F.col("_isin")).alias("isin"), F.when(kept, F.coalesce("_name", "name")).alias("name"), reason.alias("reason"))


def exclude(instruments: DataFrame, excluded: DataFrame) -> DataFrame:
    return instruments.join(excluded, "symbol", "left_anti")


def sector_bucketed(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Each row with its master record and the bucket it reconciles to."""
    m = master.withColumn("_in", F.lit(True))
    bucket = (F.when(F.col("_in").isNull(), "not_in_master").when(F.col("instrument_class") == "etf", "etf").when(F.col("instrument_class") != "operating_equity", "unclassified")
              .when(F.col("sector_key").isNull(), "operating_missing_sector").otherwise("in_sector"))
    return rows.join(m, "symbol", "left").withColumn("bucket", bucket).drop("_in")


def relative_strength(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """100 x (symbol rebased) / (benchmark rebased), both from the first date they share; symbols without one do not appear."""
    b = bench.select("date", F.col("close").alias("bench_close"))
    j = bars.select("symbol", "date", "close").join(F.broadcast(b), "date")                   # one row per calendar day
    first = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("rs", (F.col("close") / F.first("close").over(first)) / (F.col("bench_close") / F.first("bench_close").over(first)) * 100)


def _with_last(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol")
    return bars.select("symbol", "date", "close", F.max("date").over(w).alias("last"), F.min("date").over(w).alias("first"))


# Calendar look-backs of the return table, in months.
RETURN_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "3Y": 36, "5Y": 60}


def asof_return(bars: DataFrame) -> DataFrame:
    """Return since the last close on or before each calendar cutoff; NULL when the history starts after it. One exchange serves the
    window and the aggregate."""
    df = _with_last(bars)
    base = lambda m: F.max_by("close", F.when(F.col("date") <= F.add_months("last", -m), F.col("date")))
    g = df.groupBy("symbol").agg(F.max("last").alias("as_of"), F.max_by("close", "date").alias("close"), *[base(m).alias(f"b{k}") for k, m in RETURN_MONTHS.items()],
                                 *[F.max(F.when(F.col("date") <= F.add_months("last", -m), 1)).alias(f"h{k}") for k, m in RETURN_MONTHS.items()])
    return g.select("symbol", "as_of", "close", *[F.when(F.col(f"h{k}") == 1, (F.col("close") / F.col(f"b{k}") - 1) * 100).alias(f"ret_{k.lower()}") for k in RETURN_MONTHS])


PERF_DAYS = {"w1": 7, "d30": 30, "d90": 90}


def asof_window_perf(series: DataFrame, tolerance: int = 7) -> DataFrame:
    """1D against the previous row (at most `tolerance` days old) and calendar windows whose base may be at most `tolerance` days
    before its target."""
    df = _with_last(series)
    cut = {k: F.date_sub("last", n) for k, n in PERF_DAYS.items()}
    before = F.when(F.col("date") < F.col("last"), F.col("date"))
    aggs = [F.max("last").alias("as_of"), F.max_by("close", "date").alias("close"), F.max(before).alias("prev_on"), F.max_by("close", before).alias("prev"), F.count(F.lit(1)).alias("n")]
    for k, c in cut.items():
        hit = F.when(F.col("date") <= c, F.col("date"))
        aggs += [F.max(hit).alias(f"on_{k}"), F.max_by("close", hit).alias(f"base_{k}")]
    g = df.groupBy("symbol").agg(*aggs).where("n >= 2")
    pct = lambda base: (F.col("close") / F.col(base) - 1) * 100
    return g.select("symbol", "as_of", "close", F.when(F.datediff("as_of", "prev_on") <= tolerance, pct("prev")).alias("d1"),
                    *[F.when(F.datediff(F.date_sub("as_of", n), F.col(f"on_{k}")) <= tolerance, pct(f"base_{k}")).alias(k) for k, n in PERF_DAYS.items()])


def relative_perf(listed: DataFrame, bench: DataFrame, windows=("d1", "w1", "d30", "d90")) -> DataFrame:
    """A symbol's return minus the return of the one benchmark row, in percentage points."""
    b = bench.select(*[F.col(w).alias(f"bench_{w}") for w in windows])
    j = listed.crossJoin(F.broadcast(b))                                                       # one row
    return j.select("symbol", *[(F.col(w) - F.col(f"bench_{w}")).alias(f"rel_{w}") for w in windows])


def calendar_gaps(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays between the first and last date that hold no file and are not holidays (calendar-sized throughout)."""
    have = days.select("date").distinct()
    span = have.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return every.join(have, "date", "left_anti").join(holidays, "date", "left_anti")


def gap_evidence(records: DataFrame, days: DataFrame, holidays: DataFrame, gaps: DataFrame) -> DataFrame:
    """Observations or failures per requested day, placed on a gap or ignored with the reason."""
    tag = lambda df, name: df.select("date").distinct().withColumn(name, F.lit(True))
    j = records.join(tag(holidays, "_h"), "date", "left").join(tag(days, "_d"), "date", "left").join(tag(gaps, "_g"), "date", "left")
    place = F.when(F.col("_h"), "known_holiday").when(F.col("_d"), "has_a_valid_file").when(F.col("_g").isNull(), "outside_loaded_range").otherwise("gap")
    return j.withColumn("placed", place).drop("_h", "_d", "_g")


def xbrl_pairs(facts: DataFrame) -> DataFrame:
    """Long holder facts (axis, member, period, name, text) to one row per holder; an element repeated with other text is a conflict."""
    # Element names of the holder facts.
    elements = {"holder_name": "NameOfTheShareholder", "shares": "NumberOfFullyPaidUpEquityShares", "pct": "ShareholdingAsAPercentageOfTotalNumberOfShares"}
    pick = lambda e: F.when(F.col("name") == e, F.col("text"))
    clash = F.lit(False)
    aggs = []
    for out, e in elements.items():
        aggs += [F.min(pick(e)).alias(out), F.max(pick(e)).alias("_" + out)]
        clash = clash | F.coalesce(F.col(out) != F.col("_" + out), F.lit(False))
    g = facts.groupBy("axis", "member", "period").agg(*aggs)
    return g.withColumn("conflict", clash).drop(*["_" + o for o in elements])


def cross_source(ledger: DataFrame, published: DataFrame, fields: list[str], tolerance: float = 0.01) -> DataFrame:
    """Warnings where a published period is not in the ledger, or its values differ (same symbol, period and basis)."""
    keys = ["symbol", "period_end", "basis"]
    p = published.select(*keys, *[F.col(f).alias("p_" + f) for f in fields])
    j = p.join(ledger.select(*keys, *fields, F.lit(True).alias("_in")), keys, "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ledger"), F.col("p_" + f).alias("published")) for f in fields])
    missing = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("ledger"), F.lit(None).cast("double").alias("published")))
    rows = j.select(*keys, F.col("_in").isNull().alias("absent"), F.inline(F.when(F.col("_in").isNull(), missing).otherwise(pairs)))
    rows = rows.where(F.col("absent") | (F.abs(F.col("ledger") - F.col("published")) > tolerance))
    return rows.select(*keys, F.when(F.col("absent"), "no_common_period").otherwise("value_difference").alias("type"), "field", "ledger", "published")


def category_check(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Two providers' category percentages per (symbol, period): largest difference and whether they match."""
    j = a.select("symbol", "period_end", "category", F.col("pct").alias("pa")).join(b.select("symbol", "period_end", "category", F.col("pct").alias("pb")), ["symbol", "period_end", "category"])
    g = j.groupBy("symbol", "period_end").agg(F.max(F.abs(F.col("pa") - F.col("pb"))).alias("max_diff"), F.count(F.lit(1)).alias("categories"))
    return g.withColumn("verdict", F.when(F.col("max_diff") <= tolerance, "match").otherwise("differs"))


def isin_check(records: DataFrame, universe: DataFrame, directory: DataFrame) -> DataFrame:
    """Record identifier against the one canonical identifier of its symbol; contradiction or repetition means there is none."""
    d = directory.groupBy("symbol").agg(F.count(F.lit(1)).alias("_listed"), F.min("isin").alias("_dir"))
    j = records.select("symbol", F.col("isin").alias("record_isin")).join(universe.select("symbol", F.col("isin").alias("_uni")), "symbol", "left").join(d, "symbol", "left")
    verdict = (F.when(F.col("_uni").isNull(), "canonical_unavailable").when(F.col("_listed") > 1, "ambiguous_listed_twice").when(F.col("_dir") != F.col("_uni"), "ambiguous_directory_disagrees")
               .when(F.col("record_isin").isNull(), "record_has_no_isin").when(F.col("record_isin") != F.col("_uni"), "differs").otherwise("matched"))
    return j.select("symbol", "record_isin", verdict.alias("verdict"))


def live_liquid(latest_ticks: DataFrame, liquid: DataFrame) -> DataFrame:
    return latest_ticks.join(liquid.select("symbol"), "symbol", "left_semi")


def observations(instruments: DataFrame, fetched: DataFrame, previous: DataFrame, funds: DataFrame) -> DataFrame:
    """One observation per instrument: fetched label, else the previous one, with the class its evidence supports."""
    j = (instruments.join(fetched.select("symbol", F.col("label").alias("fetched_label"), F.lit(True).alias("attempted")), "symbol", "left")
         .join(previous.select("symbol", F.col("label").alias("previous_label")), "symbol", "left")
         .join(funds.select("symbol", F.lit(True).alias("_fund")), "symbol", "left"))
    label = F.coalesce("fetched_label", "previous_label")
    klass = sector_class(F.coalesce("_fund", F.lit(False)), label, F.lit(False))
    return j.select("symbol", label.alias("label"), F.col("fetched_label").isNotNull().alias("answered"), F.coalesce("attempted", F.lit(False)).alias("attempted"), klass.alias("instrument_class"))


def sector_class(on_list: Column, label: Column, exhaustive: Column) -> Column:
    has = label.isNotNull() & (label != "")
    return (F.when(on_list & has, "unclassified").when(on_list, "etf").when(has, "operating_equity").when(exhaustive, "operating_equity").otherwise("unclassified"))


def drift(old: DataFrame, new: DataFrame, max_drop: float = 0.10, max_growth: float = 0.25) -> DataFrame:
    """Removed, added and renamed keys between two directory versions and whether each stays within its limit."""
    j = old.select("isin", F.col("symbol").alias("_o")).join(new.select("isin", F.col("symbol").alias("_n")), "isin", "full")
    c = j.agg(F.count("_o").alias("previous"), F.count("_n").alias("current"), F.count_if(F.col("_n").isNull()).alias("removed"), F.count_if(F.col("_o").isNull()).alias("added"),
              F.count_if(F.col("_o") != F.col("_n")).alias("renamed"))
    return c.withColumns({"drop_ok": F.col("removed") <= F.col("previous") * max_drop, "growth_ok": F.col("added") <= F.col("previous") * max_growth})


def compare_symbols(metrics: DataFrame, chosen: DataFrame, names: list[str], slots: int = 5) -> DataFrame:
    """Metric x slot for the chosen symbols, two to five of them in `slots` slots; the metric `known` is 1 for a symbol that the metrics have and 0 for one they do not."""
    if not 2 <= slots <= 5:
        raise ValueError("two to five symbols can be compared")
    picked = chosen.join(metrics.select("symbol", *names, F.lit(True).alias("known")), "symbol", "left")
    values = F.array(F.struct(F.lit("known").alias("metric"), F.coalesce("known", F.lit(False)).cast("double").alias("value")), *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return picked.select("slot", F.inline(values)).groupBy("metric").pivot("slot", list(range(1, slots + 1))).agg(F.first("value"))
