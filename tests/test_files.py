"""Landed files of every shape: verdicts, ledgers, documents, and the all-or-nothing publication."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from barloom.catalog import QUERIES, files, statements
from barloom.operators import cleaning as C
from barloom.operators import quality as Q
from barloom.operators import statements as T
from barloom.rules import Rules
from barloom.session import parts_for
from barloom.sources import files as S
from barloom.sources import sinks as K

HEAD = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER"


def row(symbol, day="05-Oct-2026", series="EQ", close="101.5", prev="100", n=15, **kw):
    v = dict(o="100", h="102", l="99", vol='"1,000"', tov="250.5", dp="45.2") | kw
    return ",".join([symbol, series, day, prev, v["o"], v["h"], v["l"], close, close, close, v["vol"], v["tov"], "10", "450", v["dp"]][:n])


@pytest.fixture()
def landing(tmp_path):
    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if lines else ""))
    full = [row(f"S{i}") for i in range(5)]
    put("bhav_20261005.csv", "﻿" + HEAD, *full)
    put("bhav_20261006.csv", HEAD, *full)                                        # a stale copy of the 5th
    put("bhav_20261002.csv", HEAD.replace("CLOSE_PRICE", "X"), *full)
    put("bhav_20261001.csv", HEAD, row("A", "01-Oct-2026"), row("B", "01-Oct-2026", n=6))
    put("bhav_20261003.csv", HEAD, *[row(f"S{i}", "03-Oct-2026") for i in range(5)])
    put("bhav_20261230.csv", HEAD, *[row(f"S{i}", "30-Dec-2026") for i in range(5)])
    put("bhav_20260930.csv", HEAD)
    put("bhav_20260929.csv", HEAD, row("A", "29-Sep-2026"))
    put("bhav_latest.csv", HEAD, *full)
    put("bhav_20260928.csv")
    return str(tmp_path)


def test_bhav_verdicts_and_rows(spark, landing):
    lines = S.text_lines(spark, landing)
    v = S.bhav_verdicts(lines, "2026-10-10", Rules().but(min_eq_rows=3))
    got = {r.file: r.status for r in v.collect()}
    assert got == {"bhav_20261005": "ok", "bhav_20261006": "date_mismatch", "bhav_20261002": "missing_columns", "bhav_20261001": "malformed", "bhav_20261003": "weekend_file", "bhav_20261230": "future_date",
                   "bhav_20260930": "empty", "bhav_20260929": "partial", "bhav_latest": "bad_file_name"}
    assert str(v.where("file = 'bhav_20261006'").first().stale_copy_of) == "2026-10-05"
    assert [r.file for r in S.empty_files(spark, landing).collect()] == ["bhav_20260928"]
    clean = C.clean_bars(S.bhav_rows(lines, v)).orderBy("symbol").collect()
    assert len(clean) == 5 and (clean[0].close, clean[0].volume, clean[0].turnover, clean[0].deliv) == (101.5, 1000, 250.5, 45.2)


def test_files_without_content_or_text_have_a_verdict(spark, landing):
    import pathlib
    pathlib.Path(landing, "bhav_20260925.csv").write_bytes(HEAD.encode() + b"\n\xff\xfe\x81,1\n")
    lines = S.landed_lines(spark, landing)
    got = {r.file: r.status for r in S.bhav_verdicts(lines, "2026-10-10", Rules().but(min_eq_rows=3), S.empty_files(spark, landing)).collect()}
    assert (got["bhav_20260928"], got["bhav_20260925"], got["bhav_20260930"], got["bhav_20261005"], len(got)) == ("empty", "malformed", "empty", "ok", 11)


def test_lists_are_read_by_each_files_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Company Name,Symbol,Series,ISIN Code\n"Alpha, ""A"" Ltd",aaa,EQ,INE000000001\nB,bbb,BE,INE000000002\n')
    (tmp_path / "b.csv").write_text("ISIN Code, SYMBOL \nINE000000003,ccc\nINE000000009,aaa\n")
    got = sorted(map(tuple, S.read_index_csv(spark, str(tmp_path)).collect()))
    assert got == [("AAA", "INE000000001", 'Alpha, "A" Ltd'), ("CCC", "INE000000003", None)]
    assert sorted(r.isin for r in S.read_reference_csv(spark, str(tmp_path)).collect()) == [f"INE00000000{i}" for i in (1, 2, 3, 9)]
    (tmp_path / "c.csv").write_text("Symbol,Name\nX,y\n")
    with pytest.raises(ValueError, match="c.csv"):
        S.read_reference_csv(spark, str(tmp_path))
    assert sorted(r.symbol for r in S.read_etf_list_csv(spark, str(tmp_path), True).collect()) == ["AAA", "BBB", "CCC", "X"]


def test_clean_rules_by_hand(spark):
    cols = ["SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS", "DELIV_PER"]
    r = lambda s, c="100", p="99", h="101", l="98", v="10", t="5", dp="50", ser="EQ": (s, ser, "05-OCT-2026", p, "100", h, l, c, v, t, dp)
    raw = spark.createDataFrame([r("OK"), r("OK"), r("TWO"), r("TWO", c="101"), r("ZERO", c="0"), r("NANA", c="NaN"), r("PREV", p="-"), r("VOL", v="-1"), r("CROSS", h="90", l="95"), r("DEL", dp="101"), r("BE", ser="BE"), r("LOW", l="0")], cols)
    got = {x.symbol: x for x in C.clean_bars(raw).collect()}
    assert set(got) == {"OK", "PREV", "VOL", "CROSS", "DEL", "LOW"}
    assert got["PREV"].prev_close is None and got["VOL"].volume is None and (got["CROSS"].high, got["CROSS"].low) == (None, None) and got["DEL"].deliv is None and got["LOW"].low is None and got["LOW"].high == 101
    n = C.clean_counts(raw).first()
    assert (n.raw_rows, n.other_series, n.duplicate_identical, n.conflicting_duplicate_symbols, n.invalid_close, n.usable_rows) == (12, 1, 1, 1, 2, 6)


def test_conflict_gate_stops_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert C.dedup_conflict_gate(df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        C.dedup_conflict_gate(df.union(spark.createDataFrame([(2, "c")], "k int, v string")), ["k"])


def test_candles_keep_the_later_row(spark):
    rows = [("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1), ("2024-01-03", 1.0, 0.5, 2.0, 1.0, 2), ("2024-01-04", 0.0, 1.0, 1.0, 1.0, 3), ("2024-01-05", 1.0, 2.0, 1.0, 2.0, 4), ("2024-01-02", 9.0, 9.0, 9.0, 9.0, 5), ("2024-01-06", float("nan"), 1.0, 1.0, 1.0, 6)]
    df = spark.createDataFrame(rows, "date string, open double, high double, low double, close double, seq int").withColumn("open", F.nanvl("open", F.lit(None).cast("double")))
    got = C.dedup_keep_last(df, ["date"], F.col("seq"), C.candle_valid()).orderBy("date").collect()
    assert [(r.date, r.close) for r in got] == [("2024-01-02", 9.0), ("2024-01-05", 2.0)]


def test_observation_lines(spark, tmp_path):
    p = tmp_path / "obs.txt"
    p.write_text("# head\n2026-10-05 2026-10-02 2026-10-10 2026-10-10 1\n2026-10-05 2026-10-02 2026-10-10 2026-10-10 1\n2026-10-06 2026-10-02 2026-10-10 2026-10-10\n2026-10-07 2026-10-04 2026-10-12 2026-10-12 1\n2026-10-08 2026-10-05 2026-10-09 2026-10-09 1\n2026-10-09 2026-10-05 2026-10-14 2026-10-15 2\n")
    assert [r.problem for r in S.read_observations(spark, str(p)).orderBy("value").collect()] == [None, "listed_twice", "expected_5_fields", "served_weekend", "seen_too_soon", "checks_too_close"]


def test_instruments_gz_prefers_eq(spark, tmp_path):
    rows = [dict(segment="NSE_EQ", instrument_type="EQ", trading_symbol=" abc ", isin="I1", name="A"), dict(segment="NSE_EQ", instrument_type="BE", trading_symbol="ABC", isin="I2", name="B"),
            dict(segment="NSE_EQ", instrument_type="BE", trading_symbol="ONLY", isin="I3", name="C"), dict(segment="BSE", instrument_type="EQ", trading_symbol="X", isin="I4", name="D")]
    with gzip.open(tmp_path / "NSE.json.gz", "wt") as f:
        json.dump(rows, f)
    got = {r.symbol: r.isin for r in S.read_instruments_json(spark, str(tmp_path / "NSE.json.gz"), multiline=True).collect()}
    assert got == {"ABC": "I1", "ONLY": "I3"}


def test_curated_documents(spark, tmp_path):
    event = dict(symbol="TCS", date="2026-07-09", event_type="order", title="t", value=9.5, currency="USD", unit="billion", measure="deal_value_tcv", source_name="TCS", source_url="https://www.tcs.com/x.pdf", evidence_quote="q")
    bad = [dict(event, **x) for x in (dict(measure="order_book"), dict(value=0), dict(unit=None), dict(source_url="http://x.com/a"), dict(date="2026-02-30"), dict(measure=None), dict(event_type="bogus"), dict(status="announced"))]
    (tmp_path / "e.json").write_text(json.dumps({"events": [event] + bad}, indent=1))
    assert [r.valid for r in S.read_growth_events(spark, str(tmp_path / "e.json")).collect()] == [True] + [False] * len(bad)
    (tmp_path / "o.json").write_text(json.dumps({"records": [dict(symbol="A", fy=2024, values={"revenue": 1.0, "capex": None}, fields={"revenue": {"page": "1"}}), dict(symbol="B", fy=2024, values={"revenue": 1.0}, fields={})]}, indent=1))
    assert [r.sound for r in S.read_official_records(spark, str(tmp_path / "o.json")).orderBy("symbol").collect()] == [True, False]
    (tmp_path / "p.json").write_text(json.dumps({"companies": [dict(symbol="A", description="d", source_name="s")]}, indent=1))
    assert S.read_company_profiles(spark, str(tmp_path / "p.json")).first().description == "d"


def test_reference_list_without_isin_is_refused(spark, tmp_path):
    (tmp_path / "r.csv").write_text("SYMBOL,SERIES\nA,EQ\n")
    with pytest.raises(ValueError):
        S.read_reference_csv(spark, str(tmp_path / "r.csv"))


def test_publication_is_all_or_nothing(spark, tmp_path):
    base = str(tmp_path / "docs")
    one = spark.createDataFrame([(1,)], "a int")
    K.publish_together({"x": one, "y": one}, base)
    with pytest.raises(ValueError):
        K.publish_together({"x": one.union(one), "y": one}, base, lambda w: ["too many rows"] if w["x"].count() > 1 else [])
    assert K.read_published(spark, base, "x").count() == 1
    K.publish_together({"x": one.union(one), "y": one}, base)
    assert K.read_published(spark, base, "x").count() == 2


def test_year_end_change_shapes(spark):
    ends = lambda s, *ym: [(s, f"{y}-{m:02d}-28") for y, m in ym]
    rows = ends(1, (2020, 3), (2021, 3), (2022, 3)) + ends(2, (2019, 12), (2020, 12), (2021, 3), (2022, 3), (2023, 3)) + ends(3, (2019, 12), (2020, 12), (2021, 3)) + ends(4, (2019, 12), (2020, 3), (2020, 12), (2021, 3))
    df = spark.createDataFrame(rows, "symbol int, d string").select("symbol", F.last_day(F.to_date("d")).alias("period_end"))
    got = {}
    for r in T.year_end_change(df).collect():
        got.setdefault((r.symbol, r.problem), []).append(r.period_end.year)
    assert {k: sorted(v) for k, v in got.items()} == {(1, None): [2020, 2021, 2022], (2, None): [2022, 2023], (3, "mixed_month_ends"): [2019, 2020, 2021], (4, "mixed_month_ends"): [2019, 2020, 2020, 2021]}


CELL = "array<struct<period:string,value:double>>"
RESPONSE = f"symbol string, time_period string, layout string, full_statement array<struct<particular:string,history:{CELL}>>, income_statement array<struct<category:string,history:{CELL}>>"


def test_annual_responses_by_layout(spark):
    cells = lambda v, *periods: [(p, v) for p in periods or ("Mar 2023", "Mar 2024")]
    lines = [("Total Revenue", cells(10.0)), ("Profit Before Tax", cells(5.0)), ("Profit After Tax", cells(3.0)), ("", cells(1.0)), (None, None)]
    summary = [("revenue", cells(0.0)), ("Revenue", cells(99.0)), ("operating_profit", cells(5.0)), ("net_profit", cells(3.005))]
    many = [(f"Line  {i}", cells(float(i))) for i in range(45)] + [("Line 3", cells(7.0)), ("Void", [("Mar 2023", None), ("Mar 2024", float("nan"))])]
    rows = [("A", "Yearly", "standard", lines, summary), ("B", None, "financial", many + lines, summary), ("C", None, "unclassified", lines, summary), ("D", "quarterly", "standard", lines, summary),
            ("E", None, "standard", None, None), ("F", None, "standard", [("Total Revenue", cells(1.0, "Mar 2023", "Dec 2023", "Mar 2024"))], summary),
            ("G", None, "standard", [("Total Revenue", cells(1.0, "Mar 2023", "Mar 2024", "Mar 2024") + [None, ("soon", 2.0)])], []),
            ("H", None, "standard", [("Total Revenue", cells(1.0, "Dec 2020", "Mar 2022", "Mar 2023", "Mar 2024"))], [])]
    df = spark.createDataFrame(rows, RESPONSE)
    got = {}
    for r in T.annual_parse(df).collect():
        got.setdefault(r.symbol, []).append(r)
    assert {k: sorted(r.fy or 0 for r in v) for k, v in got.items()} == {"A": [2023, 2024], "B": [2023, 2024], "C": [2023, 2024], "D": [0], "E": [0], "F": [0], "G": [2023], "H": [2023, 2024]}
    checks = lambda k: (got[k][0].revenue_check, got[k][0].pbt_check, got[k][0].pat_check)
    assert checks("A") == (False, True, True) and checks("B") == (None, None, True) and checks("C") == (None, None, True)
    assert [x.label for x in got["B"][0].other_lines] == [f"Line {i}" for i in range(45) if i != 3][:40] and got["A"][0].other_lines == []
    assert {k: got[k][0].problem for k in "ADEF"} == {"A": None, "D": "not_yearly", "E": "no_data", "F": "mixed_month_ends"}
    assert T.annual_parse(df.drop("layout")).where("problem IS NULL AND symbol = 'B'").first().revenue_check is False
    assert len(T.annual_parse(df, most_other=100).where("symbol = 'B'").first().other_lines) == 44 and T.annual_parse(df.limit(0)).count() == 0


def test_annual_cash_flow(spark):
    cells = lambda v, *periods: [(p, v) for p in periods or ("Mar 2023", "Mar 2024")]
    cats = [("Operating", cells(10.0)), ("investing", cells(-4.0)), ("financing", cells(1.0))]
    both = [("operating", cells(10.0, "Dec 2022", "Mar 2023", "Mar 2024"))]
    one, two = [("Capital Expenditure", cells(-3.5)), ("Sale of fixed assets", cells(9.0))], [("CapEx", cells(-1.0)), ("Capital  expenditure", cells(-1.0))]
    rows = [("A", None, None, cats, one), ("B", "yearly", None, cats + [("operating", cells(2.0))], two), ("C", "Quarterly", None, cats, one), ("D", None, None, both, None), ("E", None, 3, both, None), ("F", None, None, None, one),
            ("G", None, None, [("operating", cells(1.0, "Mar 2023", "Mar 2023")), ("financing", cells(5.0, "Mar 2024"))], one)]
    df = spark.createDataFrame(rows, f"symbol string, time_period string, fy_month int, cash_flow array<struct<category:string,history:{CELL}>>, full_statement array<struct<particular:string,history:{CELL}>>")
    got = {(r.symbol, r.fy): r for r in T.annual_cashflow(df).collect()}
    assert {k: (r.operating_cash_flow, r.capex, r.free_cash_flow) for k, r in got.items() if r.problem is None} == {
        ("A", 2023): (10.0, 3.5, 6.5), ("A", 2024): (10.0, 3.5, 6.5), ("B", 2023): (2.0, None, None), ("B", 2024): (2.0, None, None), ("E", 2023): (10.0, None, None), ("E", 2024): (10.0, None, None), ("G", 2024): (None, 3.5, None)}
    assert {k[0]: r.problem for k, r in got.items() if r.problem} == {"C": "quarterly", "D": "mixed_month_ends", "F": "no_data"}
    assert T.annual_cashflow(df.limit(0)).count() == 0


def test_growth_rules(spark):
    y = spark.createDataFrame([(1, 2023, -5.0), (1, 2024, 10.0), (1, 2025, 0.0), (1, 2027, 4.0)], "symbol int, fy int, value double")
    assert [r.change_pct for r in T.annual_change(y).orderBy("fy").collect()] == [None, 300.0, -100.0, None]
    c = spark.createDataFrame([(1, 2022 + i, 100 * 1.1 ** i) for i in range(5)] + [(2, 2022, 1.0), (2, 2023, 2.0), (2, 2025, 3.0), (2, 2026, 4.0)], "symbol int, fy int, value double")
    got = {r.symbol: r.cagr_pct for r in T.cagr_fixed_window(c, F.lit(2022), F.lit(2026)).collect()}
    assert abs(got[1] - 10) < 1e-9 and got[2] is None


def test_violations_are_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "symbol int, x double")
    assert {(r.symbol, r.problem) for r in Q.violations(df, ["symbol"], {"negative": F.col("x") < 0, "missing": F.col("x").isNull()}).collect()} == {(2, "missing"), (3, "negative")}


def test_the_expected_day_moves_off_weekends_and_holidays(spark):
    from barloom.operators import calendar as D
    span = spark.sql("SELECT DATE '2024-01-20' AS first, DATE '2024-02-10' AS last")
    calendar = D.trading_calendar(span, spark.createDataFrame([("2024-01-26",), ("2024-01-29",)], "date string").select(F.to_date("date").alias("date")))
    asked = spark.createDataFrame([(1, "2024-01-25 20:30:00"), (2, "2024-01-26 23:00:00"), (3, "2024-01-30 20:29:00"), (4, "2024-01-30 20:31:00"), (5, "2030-01-01 00:00:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    got = D.with_expected_day(asked, F.col("t"), calendar)
    assert {r.k: str(r.expected_day) for r in got.collect()} == {1: "2024-01-25", 2: "2024-01-25", 3: "2024-01-25", 4: "2024-01-30", 5: "None"}
    since = D.sessions_between(got.withColumn("today", F.lit("2024-02-01").cast("date")), "expected_day", "today", calendar, "n")
    assert {r.k: r.n for r in since.collect()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: None}
    spans = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01', DATE '2024-12-25'), (DATE '2024-01-01', DATE '2024-12-26'), (DATE '2024-01-01', DATE '2023-01-01') t(a, b)")
    cut = sorted((str(r.b), str(r.window_start), str(r.window_end)) for r in D.date_windows(spans, "a", "b").collect())
    assert cut == [("2024-12-25", "2024-01-01", "2024-12-25"), ("2024-12-26", "2024-01-01", "2024-12-25"), ("2024-12-26", "2024-12-26", "2024-12-26")]


def cells_of(symbol, kind, detail=(), summary=()):
    history = lambda cells: [(p, float(v)) for p, v in cells]
    return symbol, kind, [(label, history(cells)) for label, cells in detail], [(label, history(cells)) for label, cells in summary]


CELLS_OF = "symbol string, time_period string, full_statement array<struct<particular:string,history:array<struct<period:string,value:double>>>>, income_statement array<struct<category:string,history:array<struct<period:string,value:double>>>>"


def test_cells_are_judged_inside_the_symbol(spark):
    docs = spark.createDataFrame([
        cells_of("A", "yearly", [("Revenue", [("Mar 2020", 1), ("Mar 2021", 2), ("Mar 2021", 3), ("junk", 4)]), ("Provisions", []), ("EPS", [("Mar 2020", 5)]), ("eps", [("Mar 2020", 6)])], [("revenue", [("Mar 2020", 7)])]),
        cells_of("B", "yearly", [("Revenue", [("Mar 2020", 1)])]), cells_of("B", "yearly", [("Revenue", [("Mar 2020", 2), ("Mar 2021", 3)])]), cells_of("B", "quarterly", [("Revenue", [("Mar 2020", 4)])]),
        cells_of("C", "yearly", [("Revenue", [("Mar 2020", 1)]), ("Profit after tax", [("Mar 2020", 2)])]), cells_of("C", "yearly", [("Profit after tax", [("Mar 2020", 3)])]),
        cells_of("D", "yearly")], CELLS_OF)
    got = T.statement_cells(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1 and plan.rindex("Generate") < plan.index("Aggregate")
    rows = sorted(((r.symbol, r.time_period, r.kind, r.label, r.period_end and str(r.period_end), r.value) for r in got.collect()), key=str)
    none = (None,) * 4
    assert rows == sorted([("A", "yearly", "detail", "revenue", "2020-03-31", 1.0), ("A", "yearly", "detail", "revenue", "2021-03-31", None), ("A", "yearly", *none), ("A", "yearly", *none), ("A", "yearly", *none),
                           ("A", "yearly", "summary", "revenue", "2020-03-31", 7.0), ("B", "yearly", "detail", "revenue", "2020-03-31", None), ("B", "yearly", "detail", "revenue", "2021-03-31", 3.0),
                           ("B", "quarterly", "detail", "revenue", "2020-03-31", 4.0), ("C", "yearly", "detail", "revenue", "2020-03-31", 1.0), ("C", "yearly", *none), ("D", "yearly", *none)], key=str)


def test_lines_of_statement_files_are_exchanged_once(spark, tmp_path):
    docs = spark.createDataFrame([cells_of(f"S{i}", "yearly", [("Revenue", [(f"Mar {y}", i + y) for y in range(2000, 2010)])]) for i in range(50)], CELLS_OF)
    docs.write.json(str(tmp_path / "s"))
    lines = T.statement_lines(S.read_statement_json(spark, str(tmp_path / "s")))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and plan.rindex("Generate") < plan.index("Exchange hashpartitioning")
    assert lines.count() == 500 and lines.agg(F.sum("value")).first()[0] == sum(i + y for i in range(50) for y in range(2000, 2010))


def test_parts_follow_the_stored_bytes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_bytes(b"x" * (10 << 20))
    cores = spark.sparkContext.defaultParallelism
    assert [parts_for(spark, str(tmp_path), mb) for mb in (1, 4, 1000)] == [30, max(8, cores), cores]
    assert parts_for(spark, str(tmp_path / "f*"), 1) == 30 and parts_for(spark, str(tmp_path / "f0"), 1) == max(10, cores) and parts_for(spark, str(tmp_path / "none*"), 1) == cores


def test_a_task_of_statements_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    day = F.timestamp_seconds(F.lit(800000000) + F.col("id") % 5 * 31557600)
    orders = spark.range(200).select((F.col("id") % 40).alias("o_custkey"), day.alias("o_orderdate"), (F.col("id") + 0.25).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    sized = []
    for module, n in ((statements, 13), (files, 23)):
        monkeypatch.setattr(module, "parts_for", lambda spark, path, mb, n=n: sized.append((path.rpartition("/")[2].partition("-")[0], mb)) or n)
    placed = lambda df: re.findall(r"hashpartitioning\((.*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    for docs in (statements.annual_docs(spark, str(tmp_path)), statements.cash_docs(spark, str(tmp_path))):
        assert [(k.partition("#")[0], n) for k, n in placed(docs)] == [("symbol", "13")] and docs.rdd.getNumPartitions() == 13
    lines = QUERIES["src_statement_json"](spark, str(tmp_path))
    assert [(k.partition("#")[0], n) for k, n in placed(lines)] == [("symbol", "23")] and ("statements", 32) in sized and ("orders.parquet", 2) in sized
    assert [n for _, n in placed(QUERIES["src_statement_lines"](spark, str(tmp_path)))] == ["13"]              # already in place: nothing is sent again
    first = orders.groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.year("o_orderdate").alias("fy")).agg(F.sum("o_totalprice").alias("total revenue"), F.max("o_totalprice").alias("profit before tax"))
    want = first.unpivot(["symbol", "fy"], ["total revenue", "profit before tax"], "label", "value").where("NOT (symbol % 29 = 0 AND fy = 1997)")
    assert sorted(map(tuple, lines.select("symbol", "fy", "label", "value").collect())) == sorted(map(tuple, want.collect()))


def test_quarters_are_judged_inside_the_symbol(spark):
    two = [("Mar 2020", 1), ("Jun 2020", 2)]
    docs = spark.createDataFrame([
        cells_of("A", "quarterly", [("Revenue", [("Mar 2020", 5)])], [("revenue", two)]), cells_of("B", "Quarterly", [("Revenue", two)], [("revenue", [("Mar 2020", 9)]), ("net_profit", two)]),
        cells_of("C", "quarterly", [("Revenue", [("Mar 2020", 1), ("Mar 2021", 2)])], [("revenue", two)]), cells_of("D", "quarterly", [("Revenue", [("Mar 2020", 1), ("May 2020", 2)])]),
        cells_of("E", "yearly", [("Revenue", two)]), cells_of("F", "quarterly", [("Revenue", two)]), cells_of("F", "Quarterly", [("Revenue", [("Sep 2020", 3)])])], CELLS_OF)
    out = T.quarterly_parse(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1 and plan.rindex("Generate") < plan.index("Aggregate")
    got = sorted((r.symbol, str(r.quarter_end), r.revenue, r.profit_after_tax, r.revenue_source) for r in out.collect())
    assert got == [("A", "2020-03-31", 1.0, None, "summary"), ("A", "2020-06-30", 2.0, None, "summary"), ("B", "2020-03-31", 1.0, 1.0, "full_statement"), ("B", "2020-06-30", 2.0, 2.0, "full_statement"),
                   ("C", "2020-03-31", 1.0, None, "summary"), ("C", "2020-06-30", 2.0, None, "summary"), ("F", "2020-03-31", 1.0, None, "full_statement"), ("F", "2020-06-30", 2.0, None, "full_statement"),
                   ("F", "2020-09-30", 3.0, None, "full_statement")]


def test_lines_of_daily_files_stay_where_they_are(spark, landing):
    lines, old = S.text_lines(spark, landing), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.bhav_verdicts(lines, "2026-10-10")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and plan.count("hashpartitioning") == 2
