"""Company statements: nested responses to long values, annual and quarterly parsing, growth, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import capex_line_class, finite, label_normalise, period_parse, rnd

# Statement labels and their fields.
INCOME_FIELDS = {"revenue": "revenue", "total revenue": "total_revenue", "profit before tax": "profit_before_tax", "profit after tax": "profit_after_tax",
                 "eps basic": "eps_basic", "eps diluted": "eps_diluted"}
SUMMARY_FIELDS = ("revenue", "operating_profit", "net_profit")


def _symbol_lines(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per symbol with `lines`: (time_period, kind, label, usable, cells) for every line of its responses, detail lines and summary categories, with the
    cells (period_end, value) in it. A label listed twice is ambiguous, its line not usable; a period listed twice keeps no value. The compact responses are placed
    by symbol once and judged inside the symbol's row: no task holds more than the rows it is sent, whatever they unfold to. `parts` says over how many tasks
    they are dealt; without it the session's shuffle partitions do."""
    line = lambda kind, name: lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("label"), x["history"].alias("history"))
    none = F.array().cast("array<struct<kind:string,label:string,history:array<struct<period:string,value:double>>>>")
    both = F.concat(F.coalesce(F.transform("full_statement", line("detail", "particular")), none), F.coalesce(F.transform("income_statement", line("summary", "category")), none))
    void = lambda kind: F.lit(None).cast(kind)
    blank = F.array(F.struct(void("date").alias("period_end"), void("double").alias("value")))                        # what has no history still is a line
    cells = lambda history: F.when(F.size(history) > 0, F.transform(history, lambda h: F.struct(period_parse(h["period"]).alias("period_end"), h["value"].alias("value")))).otherwise(blank)
    one = lambda pos, kind, label, c: F.struct(F.col("time_period").alias("time_period"), pos.alias("pos"), kind.alias("kind"), label.alias("label"), c.alias("cells"))
    listed = F.transform("both", lambda x, i: one(i, x["kind"], label_normalise(x["label"]), cells(x["history"])))
    own = docs.select("symbol", "time_period", both.alias("both")).select("symbol", F.when(F.size("both") > 0, listed).otherwise(F.array(one(void("int"), void("string"), void("string"), blank))).alias("lines"))
    placed = own.repartition(parts, "symbol") if parts else own.repartition("symbol")
    d = placed.groupBy("symbol").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    key = lambda x, *names: F.struct(*[x[n].alias(n) for n in names])
    named = ("time_period", "kind", "label")

    def gathered(k):
        alike = F.filter("lines", lambda x: key(x, "kind", "label").eqNullSafe(key(k, "kind", "label")))
        cells = F.flatten(F.transform(F.filter("lines", lambda x: key(x, *named).eqNullSafe(k)), lambda x: x["cells"]))
        return F.struct(*[k[n].alias(n) for n in named], (k["label"].isNotNull() & (F.size(F.array_distinct(alike["pos"])) == 1)).alias("usable"), cells.alias("cells"))

    def single(g):
        hits = lambda end: F.filter(g["cells"], lambda c: c["period_end"].eqNullSafe(end))
        value = lambda end: F.when(F.size(hits(end)) == 1, F.get(hits(end), F.lit(0))["value"])
        cells = F.when(F.size(g["ends"]) == F.size(g["cells"]), g["cells"]).otherwise(F.transform(g["ends"], lambda end: F.struct(end.alias("period_end"), value(end).alias("value"))))
        return F.struct(*[g[n].alias(n) for n in (*named, "usable")], cells.alias("cells"))

    with_ends = lambda g: F.struct(*[g[n].alias(n) for n in (*named, "usable", "cells")], F.array_distinct(g["cells"]["period_end"]).alias("ends"))
    keys = F.array_distinct(F.transform("lines", lambda x: key(x, *named)))
    return d.select("symbol", F.transform(F.transform(F.transform(keys, gathered), with_ends), single).alias("lines"))


def statement_cells(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Nested responses to long (symbol, time_period, kind, label, period_end, value): detail lines and summary categories in one explode.
    A label listed twice is ambiguous and loses its cells, a period listed twice keeps no value; such cells and those without a readable period have an empty row."""
    lines = _symbol_lines(docs, parts).select("symbol", F.explode_outer("lines").alias("x"))
    cells = lines.select("symbol", "x", F.explode_outer("x.cells").alias("c"))
    usable = F.col("x.usable") & F.col("c.period_end").isNotNull()
    return cells.select("symbol", "x.time_period", F.when(usable, F.col("x.kind")).alias("kind"), F.when(usable, F.col("x.label")).alias("label"), F.when(usable, F.col("c.period_end")).alias("period_end"),
                        F.when(usable, F.col("c.value")).alias("value"))


def statement_lines(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The usable detail cells."""
    return statement_cells(docs, parts).where("kind = 'detail'").select("symbol", "label", "period_end", "value")


def same(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance)


CELLS = "array<struct<fy:int,month:int,value:double>>"


def _cells(history: Column) -> Column:
    """The entries of one history with a readable period."""
    dated = F.transform(history, lambda h: F.struct(period_parse(h["period"]).alias("end"), finite(h["value"]).alias("value")))
    cells = F.transform(F.filter(dated, lambda x: x["end"].isNotNull()),
                        lambda x: F.struct(F.year(x["end"]).alias("fy"), F.month(x["end"]).alias("month"), x["value"].alias("value")))
    return F.coalesce(cells, F.array().cast(CELLS))


def _at(cells: Column, fy: Column) -> Column:
    """The value of one year; a year listed twice has none."""
    hits = F.filter(cells, lambda x: x["fy"] == fy)
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["value"])


def _detail(lines: Column) -> Column:
    """Named lines as (key, label, cells)."""
    named = F.filter(lines, lambda x: F.coalesce(x["particular"], F.lit("")) != "")
    text = lambda x: F.substring(F.trim(F.regexp_replace(x["particular"], r"\s+", " ")), 1, 80)
    return F.transform(named, lambda x: F.struct(label_normalise(x["particular"]).alias("key"), text(x).alias("label"), _cells(x["history"]).alias("cells")))


def _category(categories: Column, name: str) -> Column:
    """Cells of a category; of one listed again the last counts."""
    last = F.try_element_at(F.filter(categories, lambda x: F.lower(x["category"]) == name), F.lit(-1))
    return F.coalesce(_cells(last["history"]), F.array().cast(CELLS))


def full_years(ends: Column) -> Column:
    """The month ends to keep, of an array of month indexes (year * 12 + month): all when they share the month; after one clean change of it (two runs,
    each twelve months apart) those from the second under the new month on; else NULL. A run is even when its span is twelve months a step."""
    return F.when(F.size(F.array_distinct(F.transform(ends, lambda m: m % 12))) <= 1, ends).otherwise(_after_change(ends))


def _after_change(ends: Column) -> Column:
    old = F.filter(ends, lambda m: m % 12 == F.array_min(ends) % 12)
    new = F.filter(ends, lambda m: m % 12 != F.array_min(ends) % 12)
    even = lambda run: F.array_max(run) - F.array_min(run) == 12 * (F.size(run) - 1)
    two = F.size(F.array_distinct(F.transform(ends, lambda m: m % 12))) == 2
    return F.when(two & (F.array_max(old) < F.array_min(new)) & even(old) & even(new) & (F.size(new) >= 2), F.filter(new, lambda m: m > F.array_min(new)))


def _years_or_reason(d: DataFrame, problem: Column, *keep: str) -> DataFrame:
    """One row per element of `years`, or one that has only the reason. The reason is a field of the exploded rows: a filter on it then stays above the
    explode, where below it would repeat all the work on the arrays."""
    fields = d.schema["years"].dataType.elementType.fields
    reason = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], problem.alias("problem")))
    years = F.transform("years", lambda y: F.struct(*[y[f.name].alias(f.name) for f in fields], F.lit(None).cast("string").alias("problem")))
    return d.select(*keep, F.explode_outer(F.when(problem.isNull(), years).otherwise(reason)).alias("y"))


def annual_parse(docs: DataFrame, most_other: int = 40) -> DataFrame:
    """Every fiscal year of yearly responses with its checks, or one row with the reason the response is refused (not_yearly, mixed_month_ends, no_data).
    A response is judged inside its row, so nothing is exchanged. A label listed twice is ambiguous and counts as absent, a period listed twice has no value.
    `layout` (absent: standard) decides what the summary can be checked against: revenue and profit before tax only for standard companies. Financial ones
    keep up to `most_other` further lines with a value, in the order of the response."""
    layout = F.col("layout") if "layout" in docs.columns else F.lit("standard")
    d = docs.select("symbol", F.coalesce(F.lower("time_period"), F.lit("yearly")).alias("kind"), layout.alias("layout"), _detail(F.col("full_statement")).alias("lines"), "income_statement")
    once = F.filter("lines", lambda x: F.size(F.filter("lines", lambda y: y["key"] == x["key"])) == 1)
    d = d.withColumn("lines", F.coalesce(once, F.filter("lines", lambda x: F.lit(False))))
    known = F.filter("lines", lambda x: x["key"].isin(*INCOME_FIELDS))
    line = lambda label: F.get(F.filter("lines", lambda x: x["key"] == label), F.lit(0))["cells"]
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform(known, lambda x: F.transform(x["cells"], lambda c: c["fy"] * 12 + c["month"])))))
    d = d.select("symbol", "kind", "layout", F.coalesce(ends, F.array().cast("array<int>")).alias("ends"), *[line(label).alias(f) for label, f in INCOME_FIELDS.items()],
                 *[_category(F.col("income_statement"), f).alias("s_" + f) for f in SUMMARY_FIELDS],
                 F.filter("lines", lambda x: (F.col("layout") == "financial") & ~x["key"].isin(*INCOME_FIELDS)).alias("others"))
    d = d.withColumn("kept", full_years(F.col("ends")))

    def year(m):
        fy = ((m - 1) / 12).cast("int")
        other = F.filter(F.transform("others", lambda x: F.struct(x["label"].alias("label"), _at(x["cells"], fy).alias("value"))), lambda x: x["value"].isNotNull())
        return F.struct(fy.alias("fy"), *[_at(F.col(f), fy).alias(f) for f in INCOME_FIELDS.values()], *[_at(F.col("s_" + f), fy).alias("s_" + f) for f in SUMMARY_FIELDS],
                        F.slice(other, 1, most_other).alias("other_lines"))

    years = F.filter(F.transform("kept", year), lambda y: F.coalesce(*[y[f] for f in INCOME_FIELDS.values()]).isNotNull())
    d = d.select("symbol", "kind", "layout", F.col("kept").isNull().alias("mixed"), years.alias("years"))
    problem = (F.when(F.col("kind") != "yearly", "not_yearly").when(F.col("mixed"), "mixed_month_ends").when(F.size("years") == 0, "no_data"))
    d = _years_or_reason(d, problem, "symbol", "layout")
    ordinary = lambda check: F.when(F.col("layout") == "standard", check)
    return d.select("symbol", "y.fy", *["y." + f for f in INCOME_FIELDS.values()], ordinary(same(F.col("y.s_revenue"), F.col("y.total_revenue"))).alias("revenue_check"),
                    ordinary(same(F.col("y.s_operating_profit"), F.col("y.profit_before_tax"))).alias("pbt_check"), same(F.col("y.s_net_profit"), F.col("y.profit_after_tax")).alias("pat_check"),
                    "y.other_lines", "y.problem")


# Cash flow categories and their fields.
CASH_FIELDS = {"operating": "operating_cash_flow", "investing": "investing_cash_flow", "financing": "financing_cash_flow"}


def annual_cashflow(docs: DataFrame) -> DataFrame:
    """Cash flow of every fiscal year, or one row with the reason the response is refused (quarterly, mixed_month_ends, no_data). `fy_month` (absent or NULL:
    unknown) is the year-end month of the income statement; other periods are then left out. Capital expenditure comes from the only total line, as a
    magnitude; free cash flow needs it and is never operating minus investing."""
    month = F.col("fy_month") if "fy_month" in docs.columns else F.lit(None).cast("int")
    d = docs.select("symbol", F.coalesce(F.lower("time_period"), F.lit("")).alias("kind"), month.alias("month"),
                    *[_category(F.col("cash_flow"), name).alias(name) for name in CASH_FIELDS], _detail(F.col("full_statement")).alias("lines"))
    mine = lambda name: F.filter(name, lambda c: F.col("month").isNull() | (c["month"] == F.col("month")))
    totals = F.filter("lines", lambda x: F.coalesce(capex_line_class(x["label"]) == "total", F.lit(False)))
    d = d.select("symbol", "kind", "month", *[mine(name).alias(name) for name in CASH_FIELDS], F.when(F.size(totals) == 1, F.get(totals, F.lit(0))["cells"]).alias("capex"))
    d = d.withColumn("all", F.concat(*CASH_FIELDS)).withColumn("fys", F.array_sort(F.array_distinct(F.transform("all", lambda c: c["fy"]))))
    newest = F.transform("fys", lambda fy: F.try_element_at(F.filter("all", lambda c: c["fy"] == fy), F.lit(-1))["month"])
    year = lambda fy: F.struct(fy.alias("fy"), *[_at(F.col(name), fy).alias(f) for name, f in CASH_FIELDS.items()], F.abs(_at(F.col("capex"), fy)).alias("capex"))
    years = F.filter(F.transform("fys", year), lambda y: F.coalesce(*[y[f] for f in CASH_FIELDS.values()]).isNotNull())
    d = d.select("symbol", "kind", (F.col("month").isNull() & (F.size(F.array_distinct(newest)) > 1)).alias("mixed"), years.alias("years"))
    problem = F.when(F.col("kind") == "quarterly", "quarterly").when(F.col("mixed"), "mixed_month_ends").when(F.size("years") == 0, "no_data")
    d = _years_or_reason(d, problem, "symbol")
    return d.select("symbol", "y.fy", *["y." + f for f in CASH_FIELDS.values()], "y.capex", rnd(F.col("y.operating_cash_flow") - F.col("y.capex"), 2).alias("free_cash_flow"), "y.problem")


def year_end_change(periods: DataFrame) -> DataFrame:
    """(symbol, period_end, problem): all periods of a symbol with one year-end month; with one clean change of it, the full years after the
    change; else its periods marked mixed_month_ends. A symbol's month ends are one sorted array, so one exchange."""
    ends = periods.where("period_end IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_set(F.year("period_end") * 12 + F.month("period_end"))).alias("ends"))
    judged = ends.withColumn("kept", full_years(F.col("ends")))
    rows = judged.select("symbol", F.explode(F.coalesce("kept", "ends")).alias("m"), F.when(F.col("kept").isNull(), "mixed_month_ends").alias("problem"))
    return rows.select("symbol", F.last_day(F.make_date(F.floor((F.col("m") - 1) / 12).cast("int"), (F.col("m") - 1) % 12 + 1, F.lit(1))).alias("period_end"), "problem")


def quarterly_parse(docs: DataFrame) -> DataFrame:
    """Quarter values: a detailed value wins over the summary; annual-looking detail is ignored; periods must share the month modulo 3.
    A symbol is judged inside its row; its quarters are exploded last."""
    d = _symbol_lines(docs.where(F.lower("time_period") == "quarterly"))
    known = lambda x: x["usable"] & F.when(x["kind"] == "detail", x["label"].isin(*INCOME_FIELDS)).otherwise(x["label"].isin(*[f.replace("_", " ") for f in SUMMARY_FIELDS]))
    dated = lambda x: F.struct(x["time_period"].alias("time_period"), x["kind"].alias("kind"), x["label"].alias("label"), F.filter(x["cells"], lambda c: c["period_end"].isNotNull()).alias("cells"))
    d = d.select("symbol", F.transform(F.filter("lines", known), dated).alias("lines"))
    alike = lambda x: F.filter("lines", lambda y: (y["kind"] == x["kind"]) & (y["label"] == x["label"]))
    months = lambda x: F.transform(F.flatten(F.transform(alike(x), lambda y: y["cells"]["period_end"])), lambda e: F.month(e))
    run = F.transform("lines", lambda x: F.struct((x["kind"] == "detail").alias("detail"), months(x).alias("months")))
    d = d.withColumn("runs", F.transform(run, lambda r: F.struct(r["detail"].alias("detail"), (F.size(r["months"]) >= 2).alias("many"), (F.array_min(r["months"]) == F.array_max(r["months"])).alias("one"))))
    any_of = lambda detail, one: F.exists("runs", lambda r: (r["detail"] == detail) & r["many"] & (r["one"] == one))
    trusted = ~any_of(True, True) & ~(any_of(False, False) & ~any_of(True, False))
    d = d.withColumn("trusted", trusted).select("symbol", F.filter("lines", lambda x: (x["kind"] != "detail") | F.col("trusted")).alias("lines"))
    phases = F.array_distinct(F.transform(F.flatten(F.col("lines")["cells"]), lambda c: F.month(c["period_end"]) % 3))
    fields = {f: ("detail", label) for label, f in INCOME_FIELDS.items()} | {"s_" + f: ("summary", f.replace("_", " ")) for f in SUMMARY_FIELDS}

    def response(tp):
        own = lambda x: x["time_period"].eqNullSafe(tp)
        cells = lambda kind, label: F.get(F.filter("lines", lambda x: own(x) & (x["kind"] == kind) & (x["label"] == label)), F.lit(0))["cells"]
        ends = F.array_distinct(F.flatten(F.transform(F.filter("lines", own), lambda x: x["cells"]["period_end"])))
        return F.struct(ends.alias("ends"), *[cells(*of).alias(f) for f, of in fields.items()])

    value = lambda r, f, end: F.get(r[f]["value"], (F.array_position(r[f]["period_end"], end) - 1).cast("int"))
    quarters = lambda r: F.transform(r["ends"], lambda end: F.struct(end.alias("quarter_end"), *[value(r, f, end).alias(f) for f in fields]))
    rows = F.flatten(F.transform(F.transform(F.array_distinct(F.col("lines")["time_period"]), response), quarters))
    j = d.select("symbol", F.explode_outer(F.when(F.size(phases) == 1, rows)).alias("q")).where("q IS NOT NULL").select("symbol", "q.*")
    return j.select("symbol", "quarter_end", F.coalesce("revenue", "s_revenue").alias("revenue"), "total_revenue", F.col("s_operating_profit").alias("operating_profit"), "profit_before_tax",
                    F.coalesce("profit_after_tax", "s_net_profit").alias("profit_after_tax"), F.when(F.col("revenue").isNotNull(), "full_statement").when(F.col("s_revenue").isNotNull(), "summary").alias("revenue_source"))


def income_latest(annual: DataFrame, summary_change: DataFrame) -> DataFrame:
    """Newest year's lines; growth only where the summary equals the detail line. `summary_change`: symbol, fy, s_revenue, change."""
    from barloom.plans.order import latest_by
    newest = latest_by(annual, ["symbol"], F.col("fy"))
    j = newest.join(summary_change, ["symbol", "fy"], "left")
    return j.select("symbol", "fy", "total_revenue", "profit_after_tax", same(F.col("s_revenue"), F.col("total_revenue")).alias("check"),
                    F.when(same(F.col("s_revenue"), F.col("total_revenue")), F.col("change")).alias("growth"))


def balance_latest(rows: DataFrame) -> DataFrame:
    """Equity is assets minus liabilities; the ratio only with positive equity; debt is never derived."""
    eq = rnd(F.col("total_assets") - F.col("total_liabilities"), 2)
    return rows.withColumn("total_equity", eq).withColumns({"liabilities_to_equity": F.when(F.col("total_equity") > 0, rnd(F.col("total_liabilities") / F.col("total_equity"), 2)), "total_debt": F.lit(None).cast("double")})


def cashflow_latest(flows: DataFrame, lines: DataFrame) -> DataFrame:
    """Operating cash flow with capex from exactly one total line. Inputs: flows(symbol, period_end, operating), lines(symbol, label,
    period_end, value) with one row per line and period."""
    c = lines.withColumn("klass", capex_line_class("label"))
    per = c.groupBy("symbol").agg(F.count_distinct(F.when(F.col("klass") == "total", F.col("label"))).alias("totals"), F.count_if(F.col("klass").isNotNull()).alias("candidates"))
    value = c.where("klass = 'total'").groupBy("symbol", "period_end").agg(F.max("value").alias("line_value"))
    j = flows.join(per, "symbol", "left").join(value, ["symbol", "period_end"], "left")
    one = F.col("totals") == 1
    status = (F.when(F.coalesce("candidates", F.lit(0)) == 0, "none").when(F.col("totals") == 0, "partial_only").when(F.col("totals") > 1, "ambiguous").when(F.col("line_value").isNull(), "no_value_for_period").otherwise("found"))
    capex = F.when(one, F.abs("line_value"))
    return j.select("symbol", "period_end", "operating", capex.alias("capex"), rnd(F.col("operating") - capex, 2).alias("free_cash_flow"), status.alias("capex_status"))


def basis_fallback(newest: DataFrame, this_year: int) -> DataFrame:
    """Consolidated unless it is missing, or more than one year behind while standalone is newer. Input: symbol, basis, fy, value."""
    pick = lambda b, c: F.max(F.when(F.col("basis") == b, F.col(c)))
    g = newest.groupBy("symbol").agg(*[pick(b, c).alias(f"{b}_{c}") for b in ("consolidated", "standalone") for c in ("fy", "value")])
    stale = (F.col("consolidated_fy") < this_year - 1) & (F.coalesce("standalone_fy", F.lit(0)) > F.col("consolidated_fy"))
    alone = F.col("consolidated_fy").isNull() | stale
    return g.select("symbol", F.when(alone, "standalone").otherwise("consolidated").alias("basis"), F.when(alone, F.col("standalone_fy")).otherwise(F.col("consolidated_fy")).alias("fy"),
                    F.when(alone, F.col("standalone_value")).otherwise(F.col("consolidated_value")).alias("value"))


def reconcile_flags(checks: list[str]) -> tuple[Column, Column]:
    """(reconciliation, sorted names of failed checks) from boolean check columns."""
    bad = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks])))
    good = F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in checks])
    return F.when(F.size(bad) > 0, "mismatch").when(good, "matched").otherwise("not_checked"), F.array_join(bad, ",")


def ratio_merge_guard(old: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """New ratios are accepted only if any has a value and none that had one is lost without an explicit "no value". `new` carries an
    `explicit` array of metric names."""
    j = old.select("symbol", *[F.col(m).alias("o_" + m) for m in metrics]).join(new.select("symbol", "explicit", *metrics), "symbol")
    lost = F.array_compact(F.array(*[F.when(F.col("o_" + m).isNotNull() & F.col(m).isNull() & ~F.array_contains("explicit", m), F.lit(m)) for m in metrics]))
    usable = F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    take = usable & (F.size(lost) == 0)
    return j.select("symbol", usable.alias("usable"), F.array_join(lost, ",").alias("lost"), take.alias("accepted"), *[F.when(take, F.col(m)).otherwise(F.col("o_" + m)).alias(m) for m in metrics])


def yoy_qoq_growth(q: DataFrame, fields: list[str]) -> DataFrame:
    """Growth against the stored quarter exactly 12 and 3 months earlier; NULL when that base is missing or not positive."""
    base = lambda n, p: q.select("symbol", F.last_day(F.add_months("quarter_end", n)).alias("quarter_end"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    j = q.join(base(12, "y"), ["symbol", "quarter_end"], "left").join(base(3, "q"), ["symbol", "quarter_end"], "left")
    pct = lambda f, p: F.when(F.col(f"{p}_{f}") > 0, rnd((F.col(f) - F.col(f"{p}_{f}")) / F.col(f"{p}_{f}") * 100, 2))
    return j.select("symbol", "quarter_end", *[pct(f, p).alias(f"{n}_{f}") for f in fields for p, n in (("y", "yoy"), ("q", "qoq"))])


def annual_change(years: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Percent change against the size of the previous value, consecutive fiscal years only; `excluded` marks boundaries never shown."""
    w = Window.partitionBy("symbol").orderBy("fy")
    prev, prev_fy = F.lag("value").over(w), F.lag("fy").over(w)
    skip = F.lit(False) if excluded is None else excluded
    return years.select("symbol", "fy", "value", F.when((prev_fy == F.col("fy") - 1) & (prev != 0) & ~skip, (F.col("value") - prev) / F.abs(prev) * 100).alias("change_pct"))


def cagr_fixed_window(years: DataFrame, start: Column, end: Column) -> DataFrame:
    """Compound growth over a fixed window: every year present and positive, at least three intervals; never shortened."""
    inside = F.col("fy").between(start, end)
    n = end - start
    g = years.withColumns({"_in": inside, "_s": start, "_e": end}).groupBy("symbol").agg(
        F.count_if(F.col("_in") & (F.col("value") > 0)).alias("good"), F.max(F.when(F.col("fy") == F.col("_s"), F.col("value"))).alias("a"), F.max(F.when(F.col("fy") == F.col("_e"), F.col("value"))).alias("b"), F.max(F.col("_e") - F.col("_s")).alias("n"))
    return g.select("symbol", "n", F.when((F.col("n") >= 3) & (F.col("good") == F.col("n") + 1), (F.pow(F.col("b") / F.col("a"), F.lit(1.0) / F.col("n")) - 1) * 100).alias("cagr_pct"))


def fiscal_gaps(years: DataFrame) -> DataFrame:
    """Missing fiscal years between the first and last per symbol and basis (a year set is at most a few dozen values)."""
    g = years.groupBy("symbol", "basis").agg(F.collect_set("fy").alias("have"))
    return g.select("symbol", "basis", F.array_sort(F.array_except(F.sequence(F.array_min("have"), F.array_max("have")), "have")).alias("gaps")).where(F.size("gaps") > 0)


def quarter_gaps(q: DataFrame) -> DataFrame:
    nxt = F.lead("quarter_end").over(Window.partitionBy("symbol").orderBy("quarter_end"))
    return q.select("symbol", F.col("quarter_end").alias("older"), nxt.alias("newer")).where(F.col("newer") != F.last_day(F.add_months("older", 3)))


def expected_quarters(q: DataFrame, start: str) -> DataFrame:
    """Quarter ends from `start` to the newest stored one that a symbol does not hold."""
    newest = q.groupBy("symbol").agg(F.max("quarter_end").alias("newest")).where(F.col("newest") >= F.lit(start).cast("date"))
    every = newest.select("symbol", F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc("newest", "month"), F.expr("interval 3 months"))).alias("m")).select("symbol", F.last_day("m").alias("quarter_end"))
    return every.join(q.select("symbol", "quarter_end"), ["symbol", "quarter_end"], "left_anti")
