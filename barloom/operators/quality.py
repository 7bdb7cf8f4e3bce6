"""Data-quality gates as tables: every check is a condition, every violation a row. Nothing is repaired here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import ISIN, SYMBOL, slug
from barloom.operators.ownership import CATEGORIES
from barloom.plans.order import ordered_lag
from barloom.rules import Rules


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Long (keys, problem) rows: one pass, however many rules."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("problem"))


def repeated(df: DataFrame, keys: Sequence[str], problem: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(problem).alias("problem"))


def market_gate(counts: DataFrame, expected: str, today: str, rules: Rules = Rules()) -> DataFrame:
    """Errors and warnings about the newest day from the per-day cleaning counters (a calendar-sized table; only its last two days matter)."""
    two = counts.orderBy(F.desc("date")).limit(2)
    row = two.agg(F.max("date").alias("latest"), F.max_by(F.struct(*counts.columns), "date").alias("c"), F.max_by("usable_rows", "date").alias("n"), F.min_by("usable_rows", "date").alias("p"), F.count(F.lit(1)).alias("days"))
    c = lambda f: F.col("c." + f)
    stale = F.datediff(F.lit(expected).cast("date"), "latest")
    share = lambda f: F.try_divide(c(f), c("eq_rows"))
    errors = {"latest date is in the future": F.col("latest") > F.lit(today).cast("date"), "saved data is stale": stale > rules.max_stale_days, "too few symbols": F.col("n") < rules.min_universe,
              "universe changed too much": (F.col("days") == 2) & (F.abs(F.try_divide(F.col("n") - F.col("p"), F.col("p"))) > rules.max_universe_change), "too many unusable rows": share("invalid_close") > rules.max_invalid_share,
              "too many conflicts": share("conflicting_duplicate_symbols") > rules.max_conflict_share, "no EQ rows": c("eq_rows") == 0}
    warns = {f"{f} on the latest day": c(f) > 0 for f in ("invalid_volume", "invalid_turnover", "invalid_delivery_pct", "invalid_price_field", "missing_prev_close", "conflicting_duplicate_symbols", "duplicate_identical")}
    warns["not yet the expected trading day"] = (stale > 0) & (stale <= rules.max_stale_days)
    return violations(row, ["latest"], {f"error: {k}": v for k, v in errors.items()} | {f"warning: {k}": v for k, v in warns.items()})


def market_outputs(lists: DataFrame, latest: DataFrame, rank_by: dict[str, Column]) -> DataFrame:
    """Ranked lists against the table of symbols: ranks 1..n, in order, unique symbols, percentages in range, values equal."""
    w = Window.partitionBy("list").orderBy("rank")                                            # a list has at most its configured rows
    key = F.coalesce(*[F.when(F.col("list") == n, k) for n, k in rank_by.items()])
    j = lists.join(latest.select("symbol", F.col("change_pct").alias("_pct"), F.col("close").alias("_close")), "symbol", "left")
    j = j.withColumns({"_k": key, "_rn": F.row_number().over(w), "_prev": F.lag(key).over(w), "_dup": F.count(F.lit(1)).over(Window.partitionBy("list", "symbol"))})
    return violations(j, ["list", "rank", "symbol"], {"rank is not its position": F.col("rank") != F.col("_rn"), "not in order": F.col("_k") < F.col("_prev"), "symbol listed twice": F.col("_dup") > 1,
                                                      "percent out of range": F.col("change_pct") < -100, "differs from the symbol table": ~F.col("change_pct").eqNullSafe(F.col("_pct")) | ~F.col("close").eqNullSafe(F.col("_close"))})


# The states a published metric can have.
STATES = ("safe", "insufficient_history", "requires_adjustment", "unavailable")


def list_rules(lists: DataFrame, best: dict[str, Column]) -> dict[str, Column]:
    """Rules of ranked lists; `best` is each list's key with the largest first. A list has at most its configured rows."""
    w = Window.partitionBy("list").orderBy("rank")
    key = F.coalesce(*[F.when(F.col("list") == n, k.cast("double")) for n, k in best.items()])
    return {"rank_not_position": F.col("rank") != F.row_number().over(w), "not_in_order": key.isNull() | (key > F.lag(key).over(w)),
            "listed_twice": F.count(F.lit(1)).over(Window.partitionBy("list", "symbol")) > 1, "no_symbol": F.col("symbol").isNull(),
            "delivery_out_of_range": ~F.col("deliv").between(0, 100), "negative_volume": F.col("volume") < 0, "negative_turnover": F.col("turnover") < 0,
            "not_a_gainer": (F.col("list") == "gainers") & ~F.coalesce(F.col("change_pct") > 0, F.lit(False)),
            "not_a_loser": (F.col("list") == "losers") & ~F.coalesce(F.col("change_pct") < 0, F.lit(False))}


def disagreements(counted: DataFrame, stated: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys under which two tables of counts differ, as a signed union: one side adds, the other takes away, and what is not zero is a fault. A key that
    one side lacks is a fault unless its counts are zero."""
    take = counted.select(*keys, *values).unionByName(stated.select(*keys, *[(-F.col(v)).alias(v) for v in values]))
    return take.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).where(F.greatest(*[F.abs(F.coalesce(F.col(v), F.lit(0))) for v in values]) != 0)


def market_documents(docs: dict[str, DataFrame], today: str, best: dict[str, Column]) -> DataFrame:
    """(doc, at, problem) of the market documents of one day. breadth: as_of, universe, scope (all, liquid) and its counts; dma_breadth: period and its counts;
    movers and activity: ranked lists; dma: symbol, period, value, observations, state, position."""
    b, d = docs["breadth"], docs["dma"]
    tag = lambda rows, doc, at: rows.select(F.lit(doc).alias("doc"), at.cast("string").alias("at"), "problem")
    off = lambda a, x: F.abs(a - x) > 0.011
    n = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("advancing", "declining", "unchanged")}
    ratio = F.rint(F.try_divide(n["advancing"], n["declining"]) * 100) / 100
    out = tag(violations(b, ["scope"], {
        "counts_invalid": F.least(*n.values()) < 0, "counted_is_not_the_sum": ~F.col("counted").eqNullSafe(n["advancing"] + n["declining"] + n["unchanged"]),
        "counts_exceed_universe": (F.col("scope") == "all") & (F.col("counted") > F.col("universe")), "ratio_without_decliners": (n["declining"] == 0) & F.col("ad_ratio").isNotNull(),
        "ratio_is_not_the_quotient": (n["declining"] > 0) & (F.col("ad_ratio").isNull() | off(F.col("ad_ratio"), ratio)), "no_universe": ~F.coalesce(F.col("universe") > 0, F.lit(False)),
        "no_date": F.col("as_of").isNull(), "dated_in_the_future": F.col("as_of") > F.lit(today).cast("date"), "dated_on_a_weekend": F.weekday("as_of") > 4}), "breadth", F.col("scope"))
    head = b.agg(F.count_if(F.col("scope") == "all").alias("a"), F.count_if(F.col("scope") == "liquid").alias("l"), F.count_distinct("as_of").alias("days"), F.count_distinct("universe").alias("sizes"))
    out = out.unionByName(tag(violations(head, [], {"scope_missing": (F.col("a") != 1) | (F.col("l") != 1), "more_than_one_date": F.col("days") > 1, "more_than_one_universe": F.col("sizes") > 1}), "breadth", F.lit(None)))
    m, of = F.col("denominator"), F.col("numerator")
    out = out.unionByName(tag(violations(docs["dma_breadth"], ["period"], {
        "counts_invalid": ~F.coalesce((of >= 0) & (of <= m), F.lit(False)), "unknown_state": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "percentage_without_denominator": (m == 0) & F.col("pct").isNotNull(),
        "percentage_is_not_the_quotient": (m > 0) & (F.col("pct").isNull() | off(F.col("pct"), F.rint(of / m * 10000) / 100))}), "dma_breadth", F.col("period")))
    for doc in ("movers", "activity"):
        rows = docs[doc].withColumns({"_" + name: c for name, c in list_rules(docs[doc], best).items()})
        names = [c[1:] for c in rows.columns if c.startswith("_")]
        out = out.unionByName(tag(violations(rows, ["list", "symbol"], {x: F.col("_" + x) for x in names}), doc, F.concat_ws(" ", "list", "symbol")))
    safe = F.coalesce(F.col("state") == "safe", F.lit(False))
    out = out.unionByName(tag(violations(d, ["symbol", "period"], {
        "unknown_state": ~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "safe_without_value": safe & (F.col("value").isNull() | ~F.col("observations").eqNullSafe(F.col("period"))),
        "value_but_not_safe": ~safe & F.col("value").isNotNull()}), "dma", F.concat_ws(" ", "symbol", "period")))
    counted = d.groupBy("period").agg(F.count_if(safe).alias("denominator"), F.count_if(safe & (F.col("position") == "above")).alias("numerator"))
    differ = disagreements(counted, docs["dma_breadth"], ["period"], ["denominator", "numerator"])
    out = out.unionByName(tag(differ.withColumn("problem", F.lit("differs_from_the_symbols")), "dma_breadth", F.col("period")))
    each = d.groupBy("period").agg(F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"))
    size = b.agg(F.max("universe").alias("universe"))                                                    # one row
    out = out.unionByName(tag(violations(each.join(F.broadcast(size)), ["period"], {"symbols_are_not_the_universe": (F.col("symbols") != F.col("universe")) | (F.col("rows") != F.col("universe"))}), "dma", F.col("period")))
    return out


def market_no_loss(new: DataFrame, old: DataFrame, most_lost: float = 0.1) -> DataFrame:
    """(doc, at, problem): a published day is never replaced by an older one or by a universe smaller by more than `most_lost`."""
    day = lambda b, p: b.agg(F.max("as_of").alias(p + "as_of"), F.max("universe").alias(p + "universe"))    # one row each
    rows = violations(day(new, "").join(F.broadcast(day(old, "_"))), ["as_of"], {"older_than_published": F.col("as_of") < F.col("_as_of"), "universe_shrunk": F.col("universe") < F.col("_universe") * (1 - most_lost)})
    return rows.select(F.lit("breadth").alias("doc"), F.col("as_of").cast("string").alias("at"), "problem")


def reasons(problems: DataFrame) -> list[str]:
    """One line per document and rule, with how many rows broke it: as many lines as rules at most."""
    return sorted(f"{r.doc} {r.problem} {r.n}" for r in problems.groupBy("doc", "problem").agg(F.count(F.lit(1)).alias("n")).collect())


def candles(rows: DataFrame, today: str, max_age: int = 7) -> DataFrame:
    """Row problems (order, repeats, prices, future dates) and one staleness row per symbol. Input carries `seq`, the order as stored; stored
    rows may repeat, so a symbol's rows are not assumed few."""
    now = F.lit(today).cast("date")
    j = ordered_lag(rows, "symbol", "seq", "date", "_prev")
    bad = violations(j, ["symbol", "date"], {"not strictly ascending": F.col("date") <= F.col("_prev"), "dated in the future": F.col("date") > now,
                                             "impossible prices": (F.least("open", "high", "low", "close") <= 0) | (F.col("high") < F.col("low")), "non-positive volume": F.col("volume") <= 0})
    old = rows.groupBy("symbol").agg(F.max("date").alias("date")).where(F.datediff(now, "date") > max_age)
    return bad.unionByName(old.withColumn("problem", F.lit("latest candle is too old")))


def financials(rows: DataFrame) -> DataFrame:
    near = lambda a, b, t=0.011: F.abs(a - b) > t
    return violations(rows, ["symbol"], {
        "equity is not assets minus liabilities": near(F.col("total_equity"), F.col("total_assets") - F.col("total_liabilities")), "ratio without positive equity": F.col("liabilities_to_equity").isNotNull() & ~F.coalesce(F.col("total_equity") > 0, F.lit(False)),
        "ratio is not liabilities over equity": near(F.col("liabilities_to_equity"), F.col("total_liabilities") / F.col("total_equity")), "free cash flow without capex": F.col("free_cash_flow").isNotNull() & F.col("capex").isNull(),
        "free cash flow is not operating minus capex": near(F.col("free_cash_flow"), F.col("operating") - F.col("capex")), "growth without a check": F.col("growth").isNotNull() & ~F.coalesce("check", F.lit(False)),
        "warning: revenue and other income differ from the total": F.abs(F.col("revenue") + F.col("other_income") - F.col("total_revenue")) > 1.5})


def fundamentals(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    want = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    bad = violations(rows, ["symbol"], {"missing list is not exact": F.col("missing") != want, "a value is not finite": F.greatest(*[F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False)) for m in metrics])})
    return bad.unionByName(repeated(rows, ["symbol"], "listed more than once"))


def sector_outputs(sectors: DataFrame) -> DataFrame:
    return violations(sectors, ["sector_key"], {
        "parts do not equal counted": F.col("advances") + F.col("declines") + F.col("unchanged") != F.col("counted"), "counted exceeds members": F.col("counted") > F.col("member_count"), "breadth out of range": ~F.col("breadth_pct").between(0, 100),
        "eligible without figures": F.col("eligible") & (F.col("median_1d_pct").isNull() | F.col("mean_1d_pct").isNull()), "ineligible with figures": ~F.col("eligible") & F.coalesce("median_1d_pct", "mean_1d_pct").isNotNull(),
        "ineligible without a reason": ~F.col("eligible") & F.col("reason").isNull(), "figures implausible": ~F.col("median_1d_pct").between(-100, 1000) | ~F.col("mean_1d_pct").between(-100, 1000)})


def annual_ledger(rows: DataFrame) -> DataFrame:
    keys = ["symbol", "fy", "basis"]
    want = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in ("revenue", "profit")]))
    bad = violations(rows, keys, {"fy does not match period": F.year("period_end") != F.col("fy"), "bad basis": ~F.col("basis").isin("consolidated", "standalone"), "missing list is not exact": F.col("missing") != want,
                                  "period end is not a month end": F.col("period_end") != F.last_day("period_end"), "free cash flow identity": F.abs(F.col("free_cash_flow") - (F.col("operating") - F.col("capex"))) > 0.011})
    return bad.unionByName(repeated(rows, keys, "key repeats"))


def shareholding(rows: DataFrame) -> DataFrame:
    off = F.greatest(*[F.coalesce(~F.col(c).between(0, 100.5), F.lit(False)) for c in CATEGORIES])
    null, some = F.greatest(*[F.col(c).isNull() for c in CATEGORIES]), F.coalesce(*[F.col(c) for c in CATEGORIES]).isNotNull()
    ok = F.col("status") == "available"
    return violations(rows, ["symbol", "period_end"], {
        "not a quarter end": (F.col("period_end") != F.last_day("period_end")) | (F.month("period_end") % 3 != 0), "not a percentage": off, "null category without a flag": ok & null & ~F.contains("flags", F.lit("row_missing")),
        "unavailable with values": ~ok & some, "unavailable without a reason": ~ok & F.col("reason").isNull(), "bad status": ~F.col("status").isin("available", "unavailable")})


def master(records: DataFrame) -> DataFrame:
    bad = violations(records, ["isin"], {
        "invalid ISIN": ~F.col("isin").rlike(ISIN), "sector key does not match the label": ~F.col("sector_key").eqNullSafe(slug("label")), "a fund must not carry a sector": (F.col("instrument_class") == "etf") & F.col("sector_key").isNotNull(),
        "classified without class and sector": (F.col("status") == "classified") & ~((F.col("instrument_class") == "operating_equity") & F.col("sector_key").isNotNull()), "current symbol in its history": F.array_contains("symbol_history", F.col("symbol")),
        "unknown class": ~F.col("instrument_class").isin("etf", "operating_equity", "unclassified")})
    now = records.where("status <> 'absent'")
    two = now.groupBy("symbol").agg(F.min("isin").alias("isin"), F.max("isin").alias("_b")).where(F.col("isin") != F.col("_b"))
    return bad.unionByName(two.select("isin", F.lit("symbol belongs to two ISINs").alias("problem")))


def directory(entries: DataFrame, stated: DataFrame) -> DataFrame:
    """Entry shape and repeats, plus the stated count and digest (one row: rows, hash) against the actual ones."""
    from barloom.operators.reference import group_hash
    bad = violations(entries, ["symbol"], {"symbol": ~F.col("symbol").rlike(SYMBOL), "isin": ~F.col("isin").rlike(ISIN), "name": F.trim("name") == ""})
    twice = repeated(entries, ["symbol"], "symbol listed twice").unionByName(entries.groupBy("isin").agg(F.count(F.lit(1)).alias("_n"), F.min("symbol").alias("symbol")).where("_n > 1").select("symbol", F.lit("isin listed twice").alias("problem")))
    actual = group_hash(entries.select(F.lit("directory").alias("g"), F.concat_ws("|", "symbol", "isin", "name").alias("line")), "g", "line")
    j = actual.crossJoin(stated.select(F.col("rows").alias("s_rows"), F.col("hash").alias("s_hash")))             # one row each
    head = violations(j.withColumn("symbol", F.lit("")), ["symbol"], {"count differs": F.col("rows") != F.col("s_rows"), "content hash differs": F.col("hash") != F.col("s_hash")})
    return bad.unionByName(twice).unionByName(head)


def quarterly(rows: DataFrame, identity: DataFrame, fields: Sequence[str]) -> DataFrame:
    j = ordered_lag(rows, "symbol", "seq", "quarter_end", "_prev").join(identity.select("symbol", F.col("isin").alias("_isin")), "symbol", "left")
    bad = violations(j, ["symbol", "quarter_end"], {"identity differs": ~F.col("isin").eqNullSafe(F.col("_isin")), "empty quarter": F.coalesce(*[F.col(f) for f in fields]).isNull(), "not newest first": F.col("quarter_end") >= F.col("_prev"),
                                                    "not a month end": F.col("quarter_end") != F.last_day("quarter_end")})
    return bad.unionByName(repeated(rows, ["symbol", "quarter_end"], "duplicate quarter"))


def universe(now: DataFrame, before: DataFrame, max_drop: float = 0.10, minimum: int = 0) -> DataFrame:
    bad = violations(now, ["symbol"], {"symbol": ~F.coalesce(F.col("symbol").rlike(SYMBOL), F.lit(False)), "isin": F.col("isin").isNotNull() & ~F.col("isin").rlike(ISIN)}).unionByName(repeated(now, ["symbol"], "listed twice"))
    gone = before.select("symbol").distinct().join(now, "symbol", "left_anti").agg(F.count(F.lit(1)).alias("gone"))
    row = gone.crossJoin(before.agg(F.count_distinct("symbol").alias("old"))).crossJoin(now.agg(F.count(F.lit(1)).alias("n"))).withColumn("symbol", F.lit(""))          # one row each
    return bad.unionByName(violations(row, ["symbol"], {"too many vanished": F.col("gone") > F.col("old") * max_drop, "fewer than the minimum": F.col("n") < minimum}))


def batch(planned: DataFrame, records: DataFrame, rows: DataFrame, max_failure: float = 0.10) -> DataFrame:
    """Outcomes against records, published rows against records, and the failure rate of the batch. planned: symbol, outcome; records: symbol, error,
    fetched_in_batch, isin; rows: symbol, isin."""
    j = planned.join(records, "symbol", "left").join(rows.select("symbol", F.col("isin").alias("_row_isin"), F.lit(True).alias("_pub")), "symbol", "left")
    good = F.col("outcome").isin("ok", "partial", "no_data")
    bad = violations(j, ["symbol"], {"no final outcome": ~F.col("outcome").isin("ok", "partial", "no_data", "failed", "not_listed", "isin_held"), "success with an error": good & F.col("error").isNotNull(),
                                     "success not fetched in this batch": good & ~F.coalesce("fetched_in_batch", F.lit(False)), "failed without an error": (F.col("outcome") == "failed") & F.col("error").isNull(),
                                     "published under another ISIN": F.col("_pub") & (F.col("_row_isin") != F.col("isin"))})
    rate = planned.agg(F.count_if(good).alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed")).withColumn("symbol", F.lit(""))
    return bad.unionByName(violations(rate, ["symbol"], {"no successful update": F.col("ok") == 0, "failure rate too high": F.try_divide(F.col("failed"), F.col("ok") + F.col("failed")) > max_failure}))


# What each kind of growth event may carry.
EVENT_MEASURES = {"order": ["order_announced", "order_inflow", "deal_value_tcv"], "order_book": ["order_book"], "capex": ["capex_actual", "capex_approved", "capex_planned"],
                  "capacity": ["capacity_planned", "capacity_operational"], "acquisition": [], "business": []}
MEASURE_STATUSES = {"order_announced": ["announced"], "order_inflow": [], "deal_value_tcv": [], "order_book": [], "capex_actual": ["completed"], "capex_approved": ["approved"], "capex_planned": ["planned"],
                    "capacity_operational": ["completed"], "capacity_planned": ["planned", "approved", "announced"]}
EVENT_STATUSES = ["announced", "completed", "approved", "planned"]


def growth_event_valid() -> Column:
    """Measure allowed for the kind, status allowed for the measure, required text, a real date, https source, positive finite value with its
    currency and unit."""
    kinds = F.create_map(*[x for k, v in EVENT_MEASURES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]).cast("array<string>"))])
    states = F.create_map(*[x for k, v in MEASURE_STATUSES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]).cast("array<string>"))])
    m, s = F.col("measure"), F.col("status")
    allowed = kinds[F.col("event_type")]
    measure_ok = F.when(m.isNull(), F.size(allowed) == 0).otherwise(F.array_contains(allowed, m))
    status_ok = F.when(s.isNull(), True).when(m.isNull(), s.isin(*EVENT_STATUSES)).otherwise(F.array_contains(states[m], s))
    v = F.col("value")
    value_ok = v.isNull() | ((v > 0) & (v < float("inf")) & ~F.isnan(v) & F.col("currency").isNotNull() & F.col("unit").isNotNull())
    text_ok = (F.trim("title") != "") & F.col("symbol").rlike(r"^(?=.*[A-Z])[A-Z0-9&._-]{1,20}$") & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    url_ok = F.col("source_url").rlike(r"^https://[A-Za-z0-9.-]+(:\d+)?(/[^\s]*)?$") & (F.trim("source_name") != "") & (F.trim("evidence_quote") != "")
    return F.coalesce(allowed.isNotNull() & measure_ok & status_ok & value_ok & text_ok & url_ok, F.lit(False))
