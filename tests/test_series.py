"""Closed-form series: averages, extremes, volume, events, indicators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators import joins as J
from barloom.operators import market as M
from barloom.operators import windows as W
from barloom.rules import Rules

BAR = "symbol bigint, date date, prev_close double, open double, high double, low double, close double, volume bigint, turnover double, deliv double"
DAY = dt.date(2026, 1, 1)


def bars(spark, closes, symbol=1, prev=None, volume=None, step=1, spread=1.0):
    prev = prev or [None] + closes[:-1]
    rows = [(symbol, DAY + dt.timedelta(days=i * step), p, c, c + spread, c - spread, c, (volume or [1000] * len(closes))[i], 200.0, 50.0) for i, (c, p) in enumerate(zip(closes, prev))]
    return spark.createDataFrame(rows, BAR)


def last(df):
    return df.orderBy(F.desc("date")).first()


def test_change_needs_usable_prices(spark):
    df = spark.createDataFrame([(1, 100.0, 110.0), (2, 0.0, 5.0), (3, None, 5.0), (4, 100.0, None)], "symbol int, prev_close double, close double")
    got = {r.symbol: (r.change, r.change_pct) for r in W.change_1d(df).collect()}
    assert got == {1: (10.0, 10.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_sma_statuses(spark):
    ramp = [float(i) for i in range(1, 31)]
    r = last(W.sma_guarded(W.with_series(bars(spark, ramp)), 20))
    assert (r.sma_20, r.sma_20_status, r.sma_20_position) == (20.5, "safe", "above")
    assert last(W.sma_guarded(W.with_series(bars(spark, ramp[:19])), 20)).sma_20_status == "insufficient_history"
    assert last(W.sma_guarded(W.with_series(bars(spark, ramp, step=3)), 20)).sma_20_status == "insufficient_history"      # 57 days > 40
    split = [None] + ramp[:-1]
    split[20] = split[20] / 2
    s = W.sma_guarded(W.with_series(bars(spark, ramp, prev=split)), 20)
    assert last(s).sma_20_status == "requires_adjustment"
    assert W.adjustment_events(bars(spark, ramp, prev=split)).count() == 1


def test_extremes_exclude_today_and_keep_the_last_date(spark):
    rules = Rules().but(extreme_rows=5)
    r = last(W.high_low_52w(W.with_series(bars(spark, [10.0, 12.0, 11.0, 12.0, 10.0, 14.0])), rules))
    assert (r.high_state, r.prior_high, r.prior_high_date) == ("new_high", 13.0, DAY + dt.timedelta(days=3))
    r = last(W.high_low_52w(W.with_series(bars(spark, [10.0, 12.0, 11.0, 12.0, 10.0, 12.8])), rules))
    assert r.high_state == "near_high" and r.low_state == "away"
    assert last(W.high_low_52w(W.with_series(bars(spark, [1.0] * 5)), rules)).extreme_status == "insufficient_history"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 20, 21, 63, 64, 65])
def test_trailing_max_equals_brute_force(spark, n):
    values = [float((i * 7919) % 101) for i in range(90)]
    got = [r.m for r in W.trailing_max(bars(spark, values), {"m": F.col("close")}, n).orderBy("date").collect()]
    assert got == [max(values[max(0, i - n):i], default=None) for i in range(90)]


def test_volume_multiple(spark):
    v = [100] * 20 + [250]
    assert last(W.volume_multiple(W.with_series(bars(spark, [10.0] * 21, volume=v)))).volume_multiple == 2.5
    assert last(W.volume_multiple(W.with_series(bars(spark, [10.0] * 21, volume=[0] * 20 + [5])))).volume_status == "unavailable"
    assert last(W.volume_multiple(W.with_series(bars(spark, [10.0] * 21, volume=[None] + [1] * 20)))).volume_status == "unavailable"


def test_scan_columns_equal_single_functions(spark):
    closes = [100 + 10 * math.sin(i / 9) + i / 50 for i in range(300)]
    b = bars(spark, closes)
    a = W.scan_columns(b).orderBy("date").collect()
    s = W.return_rows(W.roll_prev_max(W.roll_prev_mean(W.roll_prev_mean(W.crosses(b), "volume", 20, 20, "vol20"), "deliv", 20, 10, "deliv20"), "high", 252, 150, "high252"), 63, "ret63").orderBy("date").collect()
    for c in ("dma_fast", "dma_slow", "dma_state", "vol20", "deliv20", "high252", "ret63"):
        assert [r[c] for r in a] == [r[c] for r in s], c


def test_breadth_without_decliners(spark):
    df = spark.createDataFrame([("d", 1.0, 1.0, 200.0), ("d", 0.0, 0.0, 50.0)], "date string, change double, change_pct double, turnover double")
    r = M.breadth(df).first()
    assert (r.advancing, r.declining, r.unchanged, r.ad_ratio) == (1, 0, 1, None) and r.ad_ratio_note.startswith("no declining")


def test_golden_and_death_cross(spark):
    b = bars(spark, [10.0] * 4 + [11.0, 9.0, 8.0])
    assert [r.dma_state for r in W.crosses(b, 2, 4).orderBy("date").collect()] == ["Not enough history"] * 3 + ["Between the two", "Golden cross today", "Below both", "Death cross today"]


# ---------------------------------------------------------------- recursive indicators
def series(*closes):
    return I.Series(*[np.concatenate([np.asarray(c, float) for c in closes])] * 3, np.cumsum([0, *map(len, closes)])[:-1])


def test_ema_seed_and_step():
    assert series([1, 2, 3, 4, 5]).smoothed([1, 2, 3, 4, 5], 3, 0.5).tolist()[2:] == [2, 3, 4]
    ramp = list(range(1, 61))
    got = series(ramp).smoothed(ramp, 12, 2 / 13)
    assert np.isnan(got[:11]).all() and got[11] == 6.5 and abs(got[12] - 7.5) < 1e-9


def one_by_one(values, n, weight, skip=0):
    """The recurrence as it is written."""
    out, state = [float("nan")] * len(values), None
    for i in range(skip, len(values)):
        if state is not None:
            state += weight * (values[i] - state)
        elif i == skip + n - 1:
            state = sum(values[skip:i + 1]) / n
        out[i] = float("nan") if state is None else state
    return out


def test_composed_maps_equal_the_recurrence():
    rng = np.random.default_rng(2)
    parts = [rng.uniform(1, 100, n) for n in (1, 9, 10, 11, 40, 1000, 2, 3000, 25, 26)]
    for n, weight, skip in ((12, 2 / 13, 0), (14, 1 / 14, 1), (9, 0.2, 25), (1, 0.5, 0)):
        want = np.concatenate([one_by_one(p.tolist(), n, weight, skip) for p in parts])
        got = series(*parts).smoothed(np.concatenate(parts), n, weight, skip)
        assert np.allclose(got, want, rtol=1e-13, atol=1e-12, equal_nan=True)
    level = series([100.0] * 500)
    assert (level.macd()["macd"][25:] == 0).all() and (level.rsi()["rsi14"][14:] == 50).all()


def test_symbols_are_cut_neither_by_batches_nor_by_each_other(spark):
    rng = np.random.default_rng(3)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), *sorted(rng.uniform(50, 150, 3).tolist(), reverse=True)) for k, n in ((1, 700), (2, 5), (3, 60), (4, 1), (5, 300)) for i in range(n)]
    df = spark.createDataFrame([(k, d, h, lo, c) for k, d, h, c, lo in rows], "symbol bigint, date date, high double, low double, close double")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cols = [c for names in I.FOLDS.values() for c in names]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        small = {(r.symbol, r.date): r for r in I.folded(df.repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(small) == len(rows)
    for k in range(1, 6):
        mine = [r for r in rows if r[0] == k]
        alone = I.Series([r[2] for r in mine], [r[4] for r in mine], [r[3] for r in mine])
        want = alone.ema() | alone.macd() | alone.rsi() | alone.atr() | alone.supertrend()
        for i, r in enumerate(mine):
            assert all((small[k, r[1]][c] is None) == bool(np.isnan(want[c][i])) and (small[k, r[1]][c] is None or abs(small[k, r[1]][c] - want[c][i]) < 1e-9) for c in cols)


def test_macd_on_a_ramp_is_seven(spark):
    rows = I.folded(bars(spark, [float(i) for i in range(1, 61)])).orderBy("date").collect()
    assert [r.macd is None for r in rows].index(False) == 25 and [r.signal is None for r in rows].index(False) == 33
    assert all(abs(r.macd - 7) < 1e-9 for r in rows[25:]) and all(abs(r.hist) < 1e-9 for r in rows[33:])


def test_macd_on_a_step(spark):
    rows = I.folded(bars(spark, [100.0] * 40 + [110.0] * 20)).orderBy("date").collect()
    at = lambda t: 10 * ((25 / 27) ** (t - 39) - (11 / 13) ** (t - 39))
    assert rows[39].macd == 0 and abs(rows[41].macd - at(41)) < 1e-9 and abs(rows[40].signal - 0.2 * at(40)) < 1e-9


def test_rsi_limits_and_known_example():
    closes = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 45.64]
    rsi = lambda c: series(c).rsi()["rsi14"]
    r = rsi(closes)
    assert np.isnan(r[:14]).all() and abs(r[14] - 70.53) < 0.1 and abs(r[15] - 66.32) < 0.1
    up = [float(i) for i in range(30)]
    assert rsi(up)[29] == 100 and rsi(up[::-1])[29] == 0 and rsi([5.0] * 20)[19] == 50


@pytest.mark.parametrize("extra, want", [([(20, 8, 18)], (5.0, 1.0)), ([(20, 8, 18), (20, 16, 19)], (8.7, 1.0)), ([(8, 6, 7)], (13.6, -1.0)), ([(18, 16, 17)], (9.2, 1.0)), ([], (16.0, -1.0))])
def test_supertrend_hand_cases(extra, want):
    rows = [(11, 9, 10)] * 10 + extra
    line, way = I.Series(*zip(*rows)).supertrend().values()
    assert abs(line[-1] - want[0]) < 1e-9 and way[-1] == want[1] and np.isnan(line[:9]).all()


@pytest.mark.parametrize("extra, want", [([(26, 10, 20)], 3.0), ([(26, 10, 20), (22, 18, 20)], 43 / 14), ([(8, 6, 7)], 30 / 14), ([(18, 16, 17)], 34 / 14)])
def test_atr_hand_cases(extra, want):
    rows = [(11, 9, 10)] * 14 + extra
    assert abs(I.Series(*zip(*rows)).atr()["atr14"][-1] - want) < 1e-9


def test_snapshot_of_a_straight_year(spark):
    start = dt.date(2025, 1, 1)
    rows = [(1, start + dt.timedelta(days=i), None, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1000 + i, 1.0, 1.0) for i in range(400)]
    r = I.indicator_snapshot(spark.createDataFrame(rows, BAR)).first()
    pct = lambda a, b: (a / b - 1) * 100
    want = {"ret_1m": pct(499, 468), "ret_3m": pct(499, 407), "ret_6m": pct(499, 315), "ret_1y": pct(499, 134), "to_dma_20": pct(499, 489.5), "to_dma_50": pct(499, 474.5), "to_dma_200": pct(499, 399.5), "vol_ratio": 1399 / 1388.5,
            "atr_pct": 2 / 499 * 100, "change_1d": pct(499, 498), "from_high": pct(499, 500), "from_low": pct(499, 133)}
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-9, k
    assert r.ret_3y is None and (r.high_52w, r.low_52w) == (500, 133)


def test_perf_windows_and_gaps(spark):
    r = J.asof_window_perf(bars(spark, [100.0 + i for i in range(100)])).first()
    assert abs(r.w1 - (199 / 192 - 1) * 100) < 1e-9 and abs(r.d90 - (199 / 109 - 1) * 100) < 1e-9
    gap = bars(spark, [100.0 + i for i in range(100)]).where((F.col("close") < 160) | (F.col("close") > 180))
    g = J.asof_window_perf(gap).first()
    assert g.w1 is not None and g.d30 is None and g.d90 is not None
    assert J.asof_window_perf(bars(spark, [5.0])).count() == 0


def test_relative_strength_rebases_on_first_common_date(spark):
    b = bars(spark, [100.0, 150.0, 200.0])
    bench = bars(spark, [1000.0, 1250.0, 1500.0]).drop("symbol")
    assert abs(last(J.relative_strength(b, bench)).rs - 200 / 150 * 100) < 1e-9
    later = bench.where("close > 1000")
    rows = J.relative_strength(b, later).orderBy("date").collect()
    assert len(rows) == 2 and rows[0].rs == 100 and abs(rows[1].rs - (200 / 150) / (1500 / 1250) * 100) < 1e-9


def test_lost_parts_and_basis(spark):
    from barloom.operators import ledger
    schema = "symbol int, got date, quarters array<int>, basis string, checked date"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    old = [(1, d1, [1, 2], "a", d1), (2, d1, [1, 2], "a", d1), (3, d1, [1, 2], "a", d1), (4, d2, [1], "a", None), (5, None, None, None, None), (6, d1, [1], "a", d1), (7, d1, [1], "a", None)]
    new = [(1, d1, [2, 3], "a", d2), (2, d1, [9], "b", d2), (3, d1, [9], "b", d1), (4, d1, None, "a", d1), (5, d1, [1], None, None), (7, d1, [], "b", d1), (8, d1, [1], "a", d1)]
    got = ledger.no_loss_parts(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "symbol", ["got"], "quarters", "basis", "checked").collect()
    assert sorted(map(tuple, got)) == [(1, "quarters lost"), (3, "basis changed without a newer check"), (4, "got moved backwards"), (4, "quarters lost"), (6, "missing from the new state")]
