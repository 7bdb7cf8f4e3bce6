"""Recursive indicators over the supplied tables; the SQL restates them as one recursive query over bar numbers."""

from __future__ import annotations

from barloom.catalog.model_sql import BARS, half_even, sql
from barloom.catalog.registry import query
from barloom.functions.values import rnd
from barloom.operators import indicators as I
from barloom.operators import joins as J
from barloom.operators.windows import roll_mean
from barloom.sources.market import bars

FOLD = "WITH RECURSIVE " + BARS.strip() + """,
numbered AS (SELECT symbol, date, close, high, low, row_number() OVER s AS rn, avg(close) OVER (s ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m12, avg(close) OVER (s ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS m26,
  close - lag(close) OVER s AS mv, CASE WHEN lag(close) OVER s IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) END AS tr FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
seeded AS (SELECT *, avg(greatest(mv, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mup, avg(greatest(-mv, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mdown,
  avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS t14, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS t10 FROM numbered),
steps AS (SELECT symbol, date, close, rn, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS sig, 0.0::DOUBLE AS msum, NULL::DOUBLE AS up, NULL::DOUBLE AS down, NULL::DOUBLE AS a14, NULL::DOUBLE AS a10, NULL::DOUBLE AS ub, NULL::DOUBLE AS lb, false AS rising FROM seeded WHERE rn = 1
 UNION ALL SELECT symbol, date, close, rn, e12, e26, CASE WHEN rn = 34 THEN msum / 9 WHEN rn > 34 THEN sig + 0.2::DOUBLE * (e12 - e26 - sig) END, msum, up, down, a14, a10, ub, lb, CASE WHEN a10 IS NULL THEN false WHEN rising THEN close >= lb ELSE close > ub END FROM (
  SELECT symbol, date, close, rn, e12, e26, sig, CASE WHEN rn BETWEEN 26 AND 34 THEN msum + e12 - e26 ELSE msum END AS msum, up, down, a14, a10, rising,
   CASE WHEN a10 IS NULL THEN NULL WHEN pub IS NOT NULL AND pclose <= pub THEN least((high + low) / 2 + 3 * a10, pub) ELSE (high + low) / 2 + 3 * a10 END AS ub,
   CASE WHEN a10 IS NULL THEN NULL WHEN plb IS NOT NULL AND pclose >= plb THEN greatest((high + low) / 2 - 3 * a10, plb) ELSE (high + low) / 2 - 3 * a10 END AS lb FROM (
   SELECT b.symbol, b.date, b.close, b.high, b.low, b.rn, p.sig, p.msum, p.rising, p.ub AS pub, p.lb AS plb, p.close AS pclose, CASE WHEN b.rn = 12 THEN b.m12 WHEN b.rn > 12 THEN p.e12 + 2.0::DOUBLE / 13 * (b.close - p.e12) END AS e12,
    CASE WHEN b.rn = 26 THEN b.m26 WHEN b.rn > 26 THEN p.e26 + 2.0::DOUBLE / 27 * (b.close - p.e26) END AS e26, CASE WHEN b.rn = 15 THEN b.mup WHEN b.rn > 15 THEN p.up + (greatest(b.mv, 0) - p.up) / 14 END AS up,
    CASE WHEN b.rn = 15 THEN b.mdown WHEN b.rn > 15 THEN p.down + (greatest(-b.mv, 0) - p.down) / 14 END AS down, CASE WHEN b.rn = 14 THEN b.t14 WHEN b.rn > 14 THEN p.a14 + (b.tr - p.a14) / 14 END AS a14,
    CASE WHEN b.rn = 10 THEN b.t10 WHEN b.rn > 10 THEN p.a10 + (b.tr - p.a10) / 10 END AS a10 FROM steps p JOIN seeded b ON b.symbol = p.symbol AND b.rn = p.rn + 1)))
"""


def fold_sql(select: str) -> str:
    return half_even(FOLD + f"SELECT symbol, CAST(date AS VARCHAR) AS date, {select} FROM steps").replace("Round(", "round(")


def _pick(spark, d, which):
    return I.folded(bars(spark, d), which).select("symbol", "date", *[rnd(c, 4).alias(c) for c in I.FOLDS[which]])


@query("ema", fold_sql("round(e12, 4) AS ema12, round(e26, 4) AS ema26"))
def _(spark, d):
    return _pick(spark, d, "ema")


@query("macd_12_26_9", fold_sql("CASE WHEN rn >= 26 THEN round(e12 - e26, 4) END AS macd, round(sig, 4) AS signal, round(e12 - e26 - sig, 4) AS hist"))
def _(spark, d):
    return _pick(spark, d, "macd")


@query("rsi_14", fold_sql("CASE WHEN up IS NULL THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE round(100 - 100 / (1 + up / down), 4) END AS rsi14"))
def _(spark, d):
    return _pick(spark, d, "rsi")


@query("atr_14_pct", fold_sql("round(a14 / close * 100, 4) AS atr_pct"))
def _(spark, d):
    df = I.folded(bars(spark, d), "atr")
    return df.select("symbol", "date", rnd(df.atr14 / df.close * 100, 4).alias("atr_pct"))


@query("supertrend_10_3", fold_sql("round(CASE WHEN a10 IS NULL THEN NULL WHEN rising THEN lb ELSE ub END, 4) AS supertrend, CASE WHEN a10 IS NULL THEN NULL WHEN rising THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction"))
def _(spark, d):
    return _pick(spark, d, "supertrend")


@query("sma", sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(*) OVER w = 5 THEN round(CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER w AS DOUBLE) / 5000000, 6) END AS sma5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", BARS))
def _(spark, d):
    return roll_mean(bars(spark, d), 5, "sma5").select("symbol", "date", rnd("sma5", 6).alias("sma5"))


RANGE = """
spans AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS last, min(date) OVER (PARTITION BY symbol) AS first FROM bars),
ranges AS (SELECT symbol, arg_max(close, date) AS close, CASE WHEN min(first) <= max(last) - 365 THEN max(high) FILTER (date >= last - 365) END AS high_52w, CASE WHEN min(first) <= max(last) - 365 THEN min(low) FILTER (date >= last - 365) END AS low_52w FROM spans GROUP BY 1)"""


@query("range_52w_strict", sql("SELECT symbol, high_52w, low_52w, round((close / high_52w - 1) * 100, 6) AS from_high, round((close / low_52w - 1) * 100, 6) AS from_low FROM ranges", BARS, RANGE))
def _(spark, d):
    r = I.range_52w_strict(bars(spark, d))
    return r.select("symbol", "high_52w", "low_52w", rnd("from_high", 6).alias("from_high"), rnd("from_low", 6).alias("from_low"))


@query("vol_ratio_20", sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(volume) OVER w = 20 AND sum(volume) OVER w > 0 THEN round(volume / (CAST(sum(volume) OVER w AS DOUBLE) / 20), 6) END AS vol_ratio FROM bars
 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", BARS))
def _(spark, d):
    return I.vol_ratio_20(bars(spark, d)).select("symbol", "date", rnd("vol_ratio", 6).alias("vol_ratio"))


SNAP_COLS = ["change_1d", "vol_ratio", "to_dma_20", "to_dma_50", "to_dma_200", "atr_pct", "ret_1m", "ret_3m", "ret_6m", "ret_1y", "ret_3y", "ret_5y", "from_high", "from_low"]


def _snapshot_sql():
    dma = ", ".join(f"CASE WHEN count(*) OVER d{n} = {n} THEN (close / (CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER d{n} AS DOUBLE) / {n * 1000000}) - 1) * 100 END AS to_dma_{n}" for n in (20, 50, 200))
    wins = ", ".join(f"d{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 50, 200))
    ret = ", ".join(f"(arg_max(close, date) / arg_max(close, date) FILTER (date <= last - to_months({m})) - 1) * 100 AS ret_{k.lower()}" for k, m in J.RETURN_MONTHS.items())
    text = FOLD + f""", {RANGE.strip()},
returns AS (SELECT symbol, {ret} FROM spans GROUP BY 1),
daily AS (SELECT symbol, date, close, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS change_1d, CASE WHEN count(volume) OVER w = 20 AND sum(volume) OVER w > 0 THEN volume / (CAST(sum(volume) OVER w AS DOUBLE) / 20) END AS vol_ratio, {dma}
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), {wins})
SELECT symbol, CAST(d.date AS VARCHAR) AS as_of, d.close, r.high_52w, r.low_52w, {', '.join(f'round({c}, 4) AS {c}' for c in SNAP_COLS)} FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) d
 JOIN returns USING (symbol) JOIN (SELECT symbol, high_52w, low_52w, (close / high_52w - 1) * 100 AS from_high, (close / low_52w - 1) * 100 AS from_low FROM ranges) r USING (symbol)
 JOIN (SELECT symbol, arg_max(a14, rn) / arg_max(close, rn) * 100 AS atr_pct FROM steps GROUP BY 1) a USING (symbol)"""
    return half_even(text).replace("Round(", "round(")


@query("indicator_snapshot", _snapshot_sql())
def _(spark, d):
    r = I.indicator_snapshot(bars(spark, d))
    return r.select("symbol", "as_of", "close", "high_52w", "low_52w", *[rnd(c, 4).alias(c) for c in SNAP_COLS])
