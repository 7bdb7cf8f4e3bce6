"""Series metrics, market aggregates and ranked lists over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.model_sql import BARS, CHANGES, sql
from barloom.catalog.registry import query
from barloom.functions.values import rnd
from barloom.operators import market as M
from barloom.operators import windows as W
from barloom.plans import market_day as D
from barloom.rules import WIDE, Rules
from barloom.session import cut_lineage
from barloom.sources.market import bars

# Every guard of the series metrics as SQL; {f}, {e} and {v} are the span settings.
GUARDED = CHANGES + """,
marked AS (SELECT *, lag(close) OVER s AS own_prev, row_number() OVER s AS rn FROM moved WINDOW s AS (PARTITION BY symbol ORDER BY date)),
evented AS (SELECT *, CASE WHEN prev_close > 0 AND own_prev > 0 AND abs(prev_close / own_prev - 1) > 0.05 THEN date END AS event_on FROM marked),
series AS (SELECT *, max(event_on) OVER (PARTITION BY symbol ORDER BY date) AS last_event FROM evented)"""


def sma_sql(n: int, factor: float, source: str = "series") -> str:
    return f"""sma_{n} AS (SELECT symbol, date, close,
  CASE WHEN cnt < {n} OR date - first_date > {n * factor} THEN 'insufficient_history' WHEN last_event > first_date THEN 'requires_adjustment' ELSE 'safe' END AS status, mean
  FROM (SELECT symbol, date, close, last_event, count(*) OVER w AS cnt, min(date) OVER w AS first_date,
    round(CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER w AS DOUBLE) / ({n} * 1000000), 2) AS mean FROM {source}
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)))"""


def extremes_sql(span: int, rows: int = 252) -> str:
    return f"""framed AS (SELECT *, count(*) OVER w AS cnt, min(date) OVER w AS first_date, max(high) OVER w AS top, min(low) OVER w AS bottom,
  arg_max(date, (high, date)) OVER w AS top_on, arg_max(date, (-low, date)) OVER w AS bottom_on FROM series
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)),
extremes AS (SELECT *, CASE WHEN cnt < {rows} OR date - first_date > {span} THEN 'insufficient_history' WHEN last_event > first_date THEN 'requires_adjustment' ELSE 'safe' END AS extreme_status FROM framed),
states AS (SELECT *, extreme_status = 'safe' AS ok,
  CASE WHEN extreme_status <> 'safe' THEN NULL WHEN close > top THEN 'new_high' WHEN close >= top * (1 - 2.0::DOUBLE / 100) THEN 'near_high' ELSE 'away' END AS high_state,
  CASE WHEN extreme_status <> 'safe' THEN NULL WHEN close < bottom THEN 'new_low' WHEN close <= bottom * (1 + 2.0::DOUBLE / 100) THEN 'near_low' ELSE 'away' END AS low_state,
  CASE WHEN extreme_status = 'safe' THEN round((close / top - 1) * 100, 2) END AS high_distance_pct,
  CASE WHEN extreme_status = 'safe' THEN round((close / bottom - 1) * 100, 2) END AS low_distance_pct FROM extremes)"""


def volume_sql(span: int, source: str = "series") -> str:
    return f"""vols AS (SELECT *, CASE WHEN vcnt < 20 OR date - vfirst > {span} THEN 'insufficient_history' WHEN last_event > vfirst THEN 'requires_adjustment'
  WHEN vsum <= 0 THEN 'unavailable' ELSE 'safe' END AS volume_status FROM (SELECT *, count(*) OVER v AS vcnt, min(date) OVER v AS vfirst, CAST(sum(volume) OVER v AS DOUBLE) AS vsum FROM {source}
  WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))"""


SCAN = BARS + """,
means AS (SELECT *, count(*) OVER w50 AS c50, count(*) OVER w200 AS c200, row_number() OVER s AS rn,
  CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER w50 AS DOUBLE) / 50000000 AS m50, CAST(sum(CAST(round(close * 1000000) AS BIGINT)) OVER w200 AS DOUBLE) / 200000000 AS m200,
  count(*) OVER p20 AS c20, CAST(sum(volume) OVER p20 AS DOUBLE) / 20 AS m20, CAST(sum(CAST(round(deliv * 1000000) AS BIGINT)) OVER p20 AS DOUBLE) / (count(deliv) OVER p20 * 1000000) AS md20,
  count(high) OVER p252 AS c252, max(high) OVER p252 AS h252, lag(close, 63) OVER s AS c63 FROM bars
  WINDOW s AS (PARTITION BY symbol ORDER BY date), w50 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
   w200 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), p20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
   p252 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
rolled AS (SELECT *, CASE WHEN c50 >= 50 THEN m50 END AS dma_fast, CASE WHEN c200 >= 200 THEN m200 END AS dma_slow, CASE WHEN c20 >= 20 THEN m20 END AS vol20,
  CASE WHEN c20 >= 10 THEN md20 END AS deliv20, CASE WHEN c252 >= 150 THEN h252 END AS high252, CASE WHEN c63 <> 0 THEN (close / c63 - 1) * 100 END AS ret63 FROM means),
crossed AS (SELECT *, CASE WHEN dma_slow IS NULL THEN 'Not enough history' WHEN pf <= ps AND dma_fast > dma_slow THEN 'Golden cross today'
  WHEN pf >= ps AND dma_fast < dma_slow THEN 'Death cross today' WHEN close > dma_fast AND close > dma_slow THEN 'Above both'
  WHEN close < dma_fast AND close < dma_slow THEN 'Below both' ELSE 'Between the two' END AS dma_state
  FROM (SELECT *, lag(dma_fast) OVER s AS pf, lag(dma_slow) OVER s AS ps FROM rolled WINDOW s AS (PARTITION BY symbol ORDER BY date)))"""

SCAN_DAY = SCAN + """,
newest AS (SELECT * FROM crossed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
scan0 AS (SELECT *, (close / prev_close - 1) * 100 AS chg, volume / vol20 AS volx FROM newest WHERE turnover >= 100),
scan AS (SELECT *, CASE WHEN ret63 IS NOT NULL THEN round(((rank() OVER (PARTITION BY ret63 IS NULL ORDER BY ret63) + (count(*) OVER (PARTITION BY ret63) - 1) / 2.0::DOUBLE)
   / count(ret63) OVER ()) * 98 + 1, 0) END AS rs FROM scan0)"""


@query("change_1d", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, close, prev_close, change, change_pct FROM moved", CHANGES))
def _(spark, d):
    return W.change_1d(bars(spark, d)).select("symbol", "date", "close", "prev_close", "change", "change_pct")


@query("adjustment_events", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(prev_close / own_prev, 4) AS ratio FROM series WHERE event_on IS NOT NULL", GUARDED))
def _(spark, d):
    return W.adjustment_events(bars(spark, d))


def _sma(spark, d, rules):
    df = W.with_series(bars(spark, d), rules)
    for n in (20, 50, 200):
        df = W.sma_guarded(df, n, rules)
    return df.select("symbol", "date", *[c for n in (20, 50, 200) for c in (f"sma_{n}", f"sma_{n}_status", f"sma_{n}_position")])


def _sma_sql(factor):
    pos = lambda n: (f"CASE WHEN s{n}.status = 'safe' THEN s{n}.mean END AS sma_{n}, s{n}.status AS sma_{n}_status, CASE WHEN s{n}.status <> 'safe' THEN NULL WHEN s{n}.close > s{n}.mean "
                     f"THEN 'above' WHEN s{n}.close < s{n}.mean THEN 'below' ELSE 'equal' END AS sma_{n}_position")
    return sql(f"SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(pos(n) for n in (20, 50, 200))} FROM sma_20 s20 JOIN sma_50 s50 USING (symbol, date) JOIN sma_200 s200 USING (symbol, date)",
               GUARDED, *[sma_sql(n, factor) for n in (20, 50, 200)])


@query("sma_guarded", _sma_sql(20.0))
def _(spark, d):
    return _sma(spark, d, WIDE)


@query("sma_guarded_default", _sma_sql(2.0))
def _(spark, d):
    return _sma(spark, d, Rules())


def _extremes(spark, d, rules):
    return W.high_low_52w(W.with_series(bars(spark, d), rules), rules).select(
        "symbol", "date", "extreme_status", "prior_high", "prior_high_date", "high_state", "high_distance_pct", "prior_low", "prior_low_date", "low_state", "low_distance_pct")


def _extremes_query(span):
    return sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, extreme_status, CASE WHEN ok THEN top END AS prior_high, CAST(CASE WHEN ok THEN top_on END AS VARCHAR) AS prior_high_date, high_state,
      high_distance_pct, CASE WHEN ok THEN bottom END AS prior_low, CAST(CASE WHEN ok THEN bottom_on END AS VARCHAR) AS prior_low_date, low_state, low_distance_pct FROM states""", GUARDED, extremes_sql(span))


@query("high_low_52w", _extremes_query(3000))
def _(spark, d):
    return _extremes(spark, d, WIDE)


@query("high_low_52w_default", _extremes_query(400))
def _(spark, d):
    return _extremes(spark, d, Rules())


@query("volume_multiple", sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, volume, volume_status, CASE WHEN volume_status = 'safe' THEN round(vsum / 20) END AS avg_volume,
  CASE WHEN volume_status = 'safe' THEN round(volume / (vsum / 20), 2) END AS volume_multiple FROM vols""", GUARDED, volume_sql(400)))
def _(spark, d):
    return W.volume_multiple(W.with_series(bars(spark, d), WIDE), WIDE).select("symbol", "date", "volume", "volume_status", "avg_volume", "volume_multiple")


@query("roll_mean_50_200", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(dma_fast, 6) AS dma50, round(dma_slow, 6) AS dma200 FROM rolled", SCAN))
def _(spark, d):
    df = W.roll_mean(W.roll_mean(bars(spark, d), 50, "dma50"), 200, "dma200")
    return df.select("symbol", "date", rnd("dma50", 6).alias("dma50"), rnd("dma200", 6).alias("dma200"))


@query("roll_prev_vol20", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(vol20, 6) AS vol20 FROM rolled", SCAN))
def _(spark, d):
    return W.roll_prev_mean(bars(spark, d), "volume", 20, 20, "vol20").select("symbol", "date", rnd("vol20", 6).alias("vol20"))


@query("roll_deliv20", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(deliv20, 6) AS deliv20 FROM rolled", SCAN))
def _(spark, d):
    return W.roll_prev_mean(bars(spark, d), "deliv", 20, 10, "deliv20").select("symbol", "date", rnd("deliv20", 6).alias("deliv20"))


@query("roll_high252", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, high252 FROM rolled", SCAN))
def _(spark, d):
    return W.roll_prev_max(bars(spark, d), "high", 252, 150, "high252").select("symbol", "date", "high252")


@query("ret63", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(ret63, 6) AS ret63 FROM rolled", SCAN))
def _(spark, d):
    return W.return_rows(bars(spark, d), 63, "ret63").select("symbol", "date", rnd("ret63", 6).alias("ret63"))


@query("golden_death_cross", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, dma_state FROM crossed", SCAN))
def _(spark, d):
    return W.crosses(bars(spark, d)).select("symbol", "date", "dma_state")


@query("rs_rating", sql("SELECT symbol, round(ret63, 6) AS ret63, rs FROM scan", SCAN_DAY))
def _(spark, d):
    return D.scan_day(bars(spark, d)).select("symbol", rnd("ret63", 6).alias("ret63"), "rs")


@query("longest_gap_days", sql("""SELECT symbol, max(gap) AS longest_gap_days, count(*) AS rows FROM (SELECT symbol, lead(date) OVER (PARTITION BY symbol ORDER BY date) - date AS gap FROM bars) GROUP BY 1""", BARS))
def _(spark, d):
    return W.longest_gap_days(bars(spark, d))


# ---------------------------------------------------------------- aggregates
BREADTH_COLS = """count(CASE WHEN {c} > 0 {w} THEN 1 END) AS {p}advancing, count(CASE WHEN {c} < 0 {w} THEN 1 END) AS {p}declining, count(CASE WHEN {c} = 0 {w} THEN 1 END) AS {p}unchanged,
  count(CASE WHEN {c} IS NOT NULL {w} THEN 1 END) AS {p}counted, round(count(CASE WHEN {c} > 0 {w} THEN 1 END)::DOUBLE / nullif(count(CASE WHEN {c} < 0 {w} THEN 1 END), 0), 2) AS {p}ad_ratio"""


@query("breadth", sql("SELECT *, CASE WHEN declining > 0 THEN NULL WHEN advancing > 0 THEN 'ratio_undefined_no_declines' ELSE 'ratio_undefined_no_changes' END AS ad_ratio_note FROM (SELECT CAST(date AS VARCHAR) AS date, "
                      + BREADTH_COLS.format(c="change", w="", p="") + " FROM moved GROUP BY 1)", CHANGES))
def _(spark, d):
    note = F.when(F.startswith("ad_ratio_note", F.lit("no declining")), "ratio_undefined_no_declines").when(F.col("ad_ratio_note").isNotNull(), "ratio_undefined_no_changes")
    return M.breadth(W.change_1d(bars(spark, d))).withColumn("ad_ratio_note", note)                             # the note as a code


@query("breadth_scopes", sql("SELECT CAST(date AS VARCHAR) AS date, " + BREADTH_COLS.format(c="change", w="", p="all_") + ", " + BREADTH_COLS.format(c="change", w="AND turnover >= 100", p="liquid_") + " FROM moved GROUP BY 1", CHANGES))
def _(spark, d):
    return M.breadth_scopes(W.change_1d(bars(spark, d)))


@query("scan_breadth", sql("""SELECT count(CASE WHEN chg > 0 THEN 1 END) AS advancing, count(CASE WHEN chg < 0 THEN 1 END) AS declining, count(CASE WHEN chg = 0 THEN 1 END) AS unchanged,
  round(100.0::DOUBLE * count(CASE WHEN close > dma_fast THEN 1 END) / count(*), 1) AS above_50dma_pct, round(100.0::DOUBLE * count(CASE WHEN close > dma_slow THEN 1 END) / count(*), 1) AS above_200dma_pct,
  count(CASE WHEN close > high252 THEN 1 END) AS new_52w_highs FROM scan""", SCAN_DAY))
def _(spark, d):
    return M.scan_breadth(D.scan_day(bars(spark, d)))


@query("dma_breadth", sql(" UNION ALL ".join(f"""SELECT {n} AS period, *, CASE WHEN denominator > 0 THEN 'safe' WHEN adjust > 0 AND insufficient = 0 THEN 'requires_adjustment' ELSE 'insufficient_history' END AS status FROM
  (SELECT count(CASE WHEN status = 'safe' AND close > mean THEN 1 END) AS numerator, count(CASE WHEN status = 'safe' THEN 1 END) AS denominator,
   round(count(CASE WHEN status = 'safe' AND close > mean THEN 1 END)::DOUBLE / nullif(count(CASE WHEN status = 'safe' THEN 1 END), 0) * 100, 2) AS pct,
   count(CASE WHEN status = 'insufficient_history' THEN 1 END) AS insufficient, count(CASE WHEN status = 'requires_adjustment' THEN 1 END) AS adjust
   FROM (SELECT * FROM sma_{n} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1))""" for n in (20, 50, 200)), GUARDED, *[sma_sql(n, 20.0) for n in (20, 50, 200)]))
def _(spark, d):
    df = W.with_series(bars(spark, d), WIDE)
    for n in (20, 50, 200):
        df = W.sma_guarded(df, n, WIDE)
    return M.dma_breadth(M.latest_rows(df))


NEWEST_STATES = "newest AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"


@query("high_low_counts", sql("""SELECT *, CASE WHEN denominator > 0 THEN 'safe' WHEN adjust > 0 AND insufficient = 0 THEN 'requires_adjustment' ELSE 'insufficient_history' END AS status FROM (SELECT
  count(CASE WHEN high_state = 'new_high' THEN 1 END) AS new_highs, count(CASE WHEN low_state = 'new_low' THEN 1 END) AS new_lows, count(CASE WHEN ok THEN 1 END) AS denominator,
  count(CASE WHEN extreme_status = 'insufficient_history' THEN 1 END) AS insufficient, count(CASE WHEN extreme_status = 'requires_adjustment' THEN 1 END) AS adjust,
  count(CASE WHEN extreme_status = 'unavailable' THEN 1 END) AS unavailable FROM newest)""", GUARDED, extremes_sql(3000), NEWEST_STATES))
def _(spark, d):
    return M.high_low_counts(M.latest_rows(W.high_low_52w(W.with_series(bars(spark, d), WIDE), WIDE)))


@query("metric_status", sql("""SELECT metric, CASE WHEN metric LIKE 'performance%' THEN 'requires_adjustment' WHEN n > 0 THEN 'safe' ELSE 'insufficient_history' END AS status FROM (
  SELECT 'one_day' AS metric, count(change) AS n FROM latest UNION ALL SELECT 'dma_50', count(CASE WHEN status = 'safe' THEN 1 END) FROM (SELECT * FROM sma_50 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
  UNION ALL SELECT 'dma_200', count(CASE WHEN status = 'safe' THEN 1 END) FROM (SELECT * FROM sma_200 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
  UNION ALL SELECT 'high_low_52w', count(CASE WHEN ok THEN 1 END) FROM newest UNION ALL SELECT 'volume', count(CASE WHEN volume_status = 'safe' THEN 1 END) FROM (SELECT * FROM vols QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
  UNION ALL SELECT 'performance_30d', 0 UNION ALL SELECT 'performance_90d', 0)""", GUARDED, sma_sql(50, 20.0), sma_sql(200, 20.0), extremes_sql(3000), NEWEST_STATES, volume_sql(400)))
def _(spark, d):
    return M.metric_status(D.newest_measured(bars(spark, d), WIDE))


# ---------------------------------------------------------------- ranked lists
def _list_sql(cols, lists):
    """UNION of ranked top lists: (name, source, filter, order, rows)."""
    return "\nUNION ALL ".join(f"SELECT '{name}' AS list, {cols}, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {src} WHERE {cond}) WHERE rank <= {n}" for name, src, cond, order, n in lists)


LINE_SQL = "symbol, close, prev_close, change, change_pct, volume, turnover, deliv"


@query("top_movers", sql(_list_sql(LINE_SQL, [("gainers", "latest", "turnover >= 100 AND change_pct > 0", "change_pct DESC, symbol", 50), ("losers", "latest", "turnover >= 100 AND change_pct < 0", "change_pct, symbol", 50)]), CHANGES))
def _(spark, d):
    return M.top_movers(M.latest_rows(W.change_1d(bars(spark, d))))


@query("most_active", sql(_list_sql(LINE_SQL, [("by_value", "latest", "turnover > 0", "turnover DESC, symbol", 100), ("by_volume", "latest", "volume > 0", "volume DESC, symbol", 100)]), CHANGES))
def _(spark, d):
    return M.most_active(M.latest_rows(W.change_1d(bars(spark, d))))


@query("volume_shockers", sql(_list_sql("symbol, close, change_pct, volume, avg_volume, volume_multiple, turnover, deliv", [
    (n, "hot", c, "volume_multiple DESC, symbol", 50) for n, c in (("shockers", "true"), ("high_volume_gain", "change_pct >= 3"), ("high_volume_loss", "change_pct <= -3"))]),
    GUARDED, volume_sql(400), """hot AS (SELECT * FROM (SELECT *, round(vsum / 20) AS avg_volume, round(volume / (vsum / 20), 2) AS volume_multiple FROM vols QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
      WHERE turnover >= 100 AND volume_status = 'safe' AND volume > 0 AND volume_multiple >= 2)"""))
def _(spark, d):
    df = W.volume_multiple(W.with_series(W.change_1d(bars(spark, d)), WIDE), WIDE)
    return M.volume_shockers(M.latest_rows(df), WIDE)


@query("high_low_lists", sql("SELECT * FROM (" + "\nUNION ALL ".join(f"""SELECT '{n}' AS list, symbol, close, {e} AS prior_extreme, CAST({e}_on AS VARCHAR) AS prior_date, {k}_distance_pct AS distance_pct, rank, full_count FROM
  (SELECT *, row_number() OVER (ORDER BY {k}_distance_pct {o}, symbol) AS rank, count(*) OVER () AS full_count FROM newest WHERE {k}_state = '{n}') WHERE rank <= 50"""
    for n, k, e, o in (("new_high", "high", "top", "DESC"), ("near_high", "high", "top", "DESC"), ("new_low", "low", "bottom", ""), ("near_low", "low", "bottom", ""))) + ")", GUARDED, extremes_sql(3000, 20), NEWEST_STATES))
def _(spark, d):
    rules = WIDE.but(extreme_rows=20)
    newest = cut_lineage(M.latest_rows(W.high_low_52w(W.with_series(bars(spark, d), rules), rules)), "extremes")
    return M.high_low_lists(newest, rules)


@query("scan_lists", sql("SELECT list, symbol, close, round(value, 6) AS value, rank FROM (" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS list, symbol, close, {v} AS value, rank FROM (SELECT *, row_number() OVER (ORDER BY {v} {o} NULLS LAST, symbol) AS rank FROM scan WHERE {c}) WHERE rank <= {k}" for n, v, o, c, k in (
        ("gainers", "chg", "DESC", "chg IS NOT NULL", 25), ("losers", "chg", "", "chg IS NOT NULL", 25), ("volume_gainers", "volx", "DESC", "chg > 0 AND volx >= 2", 25),
        ("high_52w", "chg", "DESC", "close > high252", 25), ("delivery", "deliv", "DESC", "deliv > deliv20 * 1.3 AND chg > 0", 25),
        ("dma", "rs", "DESC", "dma_state <> 'Not enough history'", 500), ("relative_strength", "rs", "DESC", "rs IS NOT NULL", 100))) + ")", SCAN_DAY))
def _(spark, d):
    return M.scan_lists(D.scan_day(bars(spark, d))).withColumn("value", rnd("value", 6))


@query("scan_events", sql(" UNION ".join(f"SELECT '{t}' AS type, symbol FROM scan WHERE {c}" for t, c in (
    ("New 52-week high", "close > high252"), ("Large move", "abs(round(chg, 2)) >= 5"), ("Unusual volume", "round(volx, 2) >= 2"),
    ("50-day crossed above 200-day", "dma_state = 'Golden cross today'"), ("50-day crossed below 200-day", "dma_state = 'Death cross today'"))), SCAN_DAY))
def _(spark, d):
    return M.scan_events(D.scan_day(bars(spark, d)))
