"""Ticks and snapshots over `events`; the SQL restates the sequential rules as one recursive query over tick numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.model_sql import TICKS, half_even
from barloom.catalog.registry import query
from barloom.functions import values as V
from barloom.functions.values import rnd
from barloom.rules import Rules
from barloom.session import cut_lineage
from barloom.sources.keyed import upsert_stream
from barloom.sources.market import table, ticks, ticks_from
from barloom.streaming import snapshots as S
from barloom.streaming import ticks as L

ASKED, LISTED = (1, 2, 4, 5, 8, 11, 13, 14), (2, 5, 8)          # configured lists: keys whose prices a snapshot carries, keys that are published


def instruments(spark, d):
    k = F.col("user_id")
    return table(spark, d, "events").select(k.alias("key")).distinct().where(F.col("key") % 13 != 7).select("key", F.when((F.col("key") % 10 == 0) & (F.col("key") < 80), "index").otherwise("equity").alias("kind"))


def liquid(spark, d):
    return instruments(spark, d).where("key % 3 <> 0 AND kind = 'equity'").select("key")


LIVE = "WITH RECURSIVE " + TICKS.strip() + """,
ins AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 10 = 0 AND user_id < 80 THEN 'index' ELSE 'equity' END AS kind FROM events WHERE user_id % 13 <> 7),
checked AS (SELECT t.*, i.kind, CASE WHEN i.key IS NULL THEN 'unknown_key' WHEN NOT (ltp > 0 AND ltp <= 1e7) THEN 'bad_ltp' WHEN ltt > recv_ms + 60000 THEN 'future_ltt' END AS reason FROM ticks t LEFT JOIN ins i USING (key)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY key, session_date ORDER BY seq) AS rn FROM checked WHERE reason IS NULL),
steps AS (SELECT key, session_date, rn, seq, recv_ms, connection_id, kind, 'accepted' AS outcome, ltp, ltt, cp, 1 AS n, NULL::DOUBLE AS pending FROM ordered WHERE rn = 1
 UNION ALL SELECT key, session_date, rn, seq, recv_ms, connection_id, kind, outcome, CASE WHEN outcome = 'accepted' THEN ltp ELSE s_ltp END, CASE WHEN outcome = 'accepted' THEN ltt ELSE s_ltt END, CASE WHEN outcome = 'accepted' THEN coalesce(cp, s_cp) ELSE s_cp END, n + (outcome = 'accepted')::INT,
  CASE outcome WHEN 'accepted' THEN NULL WHEN 'jump_pending' THEN ltp ELSE pend END FROM (SELECT *, CASE WHEN ltt < s_ltt THEN 'out_of_order' WHEN abs(ltp / s_ltp - 1) > 0.25 AND NOT coalesce(abs(ltp / pend - 1) <= 0.05, false) THEN 'jump_pending' ELSE 'accepted' END AS outcome FROM
  (SELECT t.*, s.ltp AS s_ltp, s.ltt AS s_ltt, s.cp AS s_cp, s.n, CASE WHEN t.connection_id <> s.connection_id THEN NULL ELSE s.pending END AS pend FROM steps s JOIN ordered t ON t.key = s.key AND t.session_date = s.session_date AND t.rn = s.rn + 1)))
"""
# Every snapshot from first principles: the intervals in which one starts, and for each of them and each key the newest accepted tick of the current connection.
STATE = """liq AS (SELECT key FROM ins WHERE key % 3 <> 0 AND kind = 'equity'),
frames AS (SELECT session_date, recv_ms // 5000 AS iv, max(recv_ms) AS fr, arg_max(connection_id, seq) AS conn FROM ticks GROUP BY 1, 2),
seen AS (SELECT session_date, recv_ms // 5000 AS iv, max(recv_ms) FILTER (kind = 'index') AS ix, max(recv_ms) FILTER (kind = 'equity') AS eq FROM steps WHERE outcome = 'accepted' GROUP BY 1, 2),
facts AS (SELECT * FROM frames LEFT JOIN seen USING (session_date, iv)),
ends AS (SELECT session_date, min(iv) AS a, max(iv) AS b FROM facts GROUP BY 1),
more AS (SELECT session_date, (fr + 10000) // 5000 AS iv FROM (SELECT *, lead(iv) OVER (PARTITION BY session_date ORDER BY iv) AS nx FROM facts) WHERE (fr + 10000) // 5000 < nx
 UNION SELECT session_date, (ix + 20000) // 5000 FROM (SELECT *, lead(iv) OVER (PARTITION BY session_date ORDER BY iv) AS nx FROM facts WHERE ix IS NOT NULL) WHERE nx IS NULL OR (ix + 20000) // 5000 < nx
 UNION SELECT session_date, CAST(ceil(((session_date - DATE '1970-01-01') * 86400000 - 19800000 + m * 60000) / 5000.0) AS BIGINT) - 1 FROM ends, (VALUES (540), (555), (930)) edges(m)),
every AS (SELECT session_date, iv, max(fr) AS fr, max(conn) AS conn, max(ix) AS ix, max(eq) AS eq FROM (SELECT * FROM facts UNION ALL BY NAME SELECT more.* FROM more JOIN ends USING (session_date) WHERE iv > a AND iv <= b) GROUP BY 1, 2),
pts AS (SELECT session_date, iv AS interval, coalesce(lead(iv) OVER w - 1, iv) AS until, (iv + 1) * 5000 AS now_ms, last_value(conn IGNORE NULLS) OVER u AS connection_id, last_value(fr IGNORE NULLS) OVER u AS fr,
 last_value(ix IGNORE NULLS) OVER u AS ix, last_value(eq IGNORE NULLS) OVER u AS eq FROM every WINDOW w AS (PARTITION BY session_date ORDER BY iv), u AS (PARTITION BY session_date ORDER BY iv ROWS UNBOUNDED PRECEDING)),
st AS (SELECT p.session_date, p.interval, s.key, any_value(s.kind) AS kind, arg_max(struct_pack(ltp := s.ltp, cp := s.cp, ltt := s.ltt), s.seq) AS t FROM pts p JOIN steps s ON s.outcome = 'accepted' AND s.session_date = p.session_date AND s.connection_id = p.connection_id
 AND s.recv_ms < p.now_ms GROUP BY 1, 2, 3),
cell AS (SELECT session_date, interval, key, kind, t.ltp AS ltp, t.cp AS cp, t.ltt AS ltt, (t.ltp / t.cp - 1) * 100 AS pct, round((t.ltp / t.cp - 1) * 100, 3) AS change_pct FROM st),
counts AS (SELECT session_date, interval, count(*) AS ticked, count(*) FILTER (round(ltp, 2) > round(cp, 2)) AS advances, count(*) FILTER (round(ltp, 2) < round(cp, 2)) AS declines, count(*) FILTER (round(ltp, 2) = round(cp, 2)) AS unchanged, count(cp) AS counted,
 count(*) FILTER (cp IS NOT NULL AND abs(pct) > 40 AND key IN (SELECT key FROM liq)) AS suspect FROM cell WHERE kind = 'equity' GROUP BY 1, 2),
ranked AS (SELECT *, CASE WHEN change_pct > 0 THEN 'gainers' ELSE 'losers' END AS list, row_number() OVER (PARTITION BY session_date, interval, change_pct > 0 ORDER BY abs(change_pct) DESC, key) AS rank FROM cell
 WHERE kind = 'equity' AND key IN (SELECT key FROM liq) AND abs(pct) <= 40 AND change_pct <> 0 QUALIFY rank <= 10),
lists AS (SELECT session_date, interval, string_agg(MOVED, ';' ORDER BY rank) FILTER (list = 'gainers') AS gainers, string_agg(MOVED, ';' ORDER BY rank) FILTER (list = 'losers') AS losers, count(*) FILTER (list = 'gainers') AS n_gainers FROM ranked GROUP BY 1, 2),
quotes AS (SELECT session_date, interval, string_agg(QUOTED, ';' ORDER BY key) FILTER (kind = 'index') AS indices, count(*) FILTER (kind = 'index') AS n_indices, string_agg(QUOTED, ';' ORDER BY key) FILTER (key IN ASKED_KEYS) AS prices,
 count(*) FILTER (key IN ASKED_KEYS) AS n_prices, string_agg(QUOTED, ';' ORDER BY key) FILTER (key IN LISTED_KEYS AND key IN ASKED_KEYS) AS listed FROM cell GROUP BY 1, 2),
known AS (SELECT count(*) FILTER (kind = 'equity') AS subscribed, count(*) FILTER (kind = 'index') AS expected FROM ins),
local AS (SELECT *, epoch_ms(now_ms + 19800000) AS ist FROM pts),
docs AS (SELECT p.session_date, p.interval, p.until, p.now_ms, CASE WHEN isodow(ist) > 5 OR CAST(ist AS DATE) = DATE '2024-01-26' THEN 'closed' WHEN hour(ist) * 60 + minute(ist) BETWEEN 555 AND 929 THEN 'open' WHEN hour(ist) * 60 + minute(ist) BETWEEN 540 AND 554 THEN 'pre_open' ELSE 'closed' END AS status,
 greatest(ix, eq) AS last_tick_ms, fr, ix, subscribed, expected, coalesce(ticked, 0) AS ticked, coalesce(ticked, 0) / subscribed::DOUBLE AS share, coalesce(advances, 0) AS advances, coalesce(declines, 0) AS declines, coalesce(unchanged, 0) AS unchanged, coalesce(counted, 0) AS counted,
 coalesce(suspect, 0) AS suspect, coalesce(gainers, '') AS gainers, coalesce(losers, '') AS losers, coalesce(n_gainers, 0) AS n_gainers, coalesce(indices, '') AS indices, coalesce(n_indices, 0) AS n_indices, coalesce(prices, '') AS prices, coalesce(n_prices, 0) AS n_prices, coalesce(listed, '') AS listed
 FROM local p LEFT JOIN counts USING (session_date, interval) LEFT JOIN lists USING (session_date, interval) LEFT JOIN quotes USING (session_date, interval) CROSS JOIN known),
snaps AS (SELECT *, round(share, 4) AS coverage, concat_ws(',', CASE WHEN interval % 700 = 0 THEN 'not_streaming' END, CASE WHEN now_ms - fr > 10000 THEN 'feed_silent' END, CASE WHEN status = 'open' AND (ix IS NULL OR now_ms - ix > 20000) THEN 'index_ticks_stale' END,
 CASE WHEN status = 'open' AND share < 0.3 THEN 'low_coverage' END, CASE WHEN expected > 0 AND n_indices = 0 THEN 'no_indices' END) AS reasons, CASE WHEN suspect > 0 THEN 'suspect_extreme_moves:' || suspect ELSE '' END AS warnings FROM docs)""".replace(
    "MOVED", "key || '|' || CAST(round(ltp, 4) AS DECIMAL(18,4)) || '|' || CAST(round(cp, 4) AS DECIMAL(18,4)) || '|' || CAST(change_pct AS DECIMAL(18,3)) || '|' || coalesce(CAST(ltt AS VARCHAR), '-')").replace(
    "QUOTED", "key || '|' || CAST(round(ltp, 4) AS DECIMAL(18,4)) || '|' || coalesce(CAST(CAST(round(cp, 4) AS DECIMAL(18,4)) AS VARCHAR), '-') || '|' || coalesce(CAST(CAST(change_pct AS DECIMAL(18,3)) AS VARCHAR), '-') || '|' || coalesce(CAST(ltt AS VARCHAR), '-')").replace(
    "ASKED_KEYS", str(ASKED)).replace("LISTED_KEYS", str(LISTED))


def live_sql(select: str, *more: str) -> str:
    return half_even(LIVE + "".join(", " + m for m in more) + "\n" + select).replace("Round(", "round(")


def valid(spark, d):
    return L.tick_validate(ticks(spark, d), instruments(spark, d)).where("reason IS NULL")


def steps(spark, d):
    return L.replay(valid(spark, d))


@query("tick_validate", live_sql("SELECT seq, reason FROM checked"))
def _(spark, d):
    return L.tick_validate(ticks(spark, d), instruments(spark, d)).select("seq", "reason")


@query("tick_out_of_order", live_sql("SELECT key, CAST(session_date AS VARCHAR) AS session_date, count(*) AS rejected FROM steps WHERE outcome = 'out_of_order' GROUP BY 1, 2"))
def _(spark, d):
    return L.outcomes(valid(spark, d)).where("outcome = 'out_of_order'").groupBy("key", "session_date").agg(F.count(F.lit(1)).alias("rejected"))


@query("tick_jump_hold", live_sql("SELECT seq, outcome, ltp, n FROM steps"))
def _(spark, d):
    return steps(spark, d).select("seq", "outcome", "ltp", "n")


@query("tick_prev_close", live_sql("SELECT seq, cp, cp IS NULL AS no_prev_close FROM steps WHERE outcome = 'accepted'"))
def _(spark, d):
    return steps(spark, d).where("outcome = 'accepted'").select("seq", "cp", F.col("cp").isNull().alias("no_prev_close"))


def events_as_stream(spark, d):
    """The table as a file stream (the pattern lets it be one file or a folder of them)."""
    path = f"{d.rstrip('/')}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100).parquet(path[:-1] + "[t]")


def event_stream(spark, d):
    return ticks_from(events_as_stream(spark, d))


@query("tick_latest", live_sql("SELECT key, CAST(session_date AS VARCHAR) AS session_date, seq, ltp, ltt, cp, n, CASE WHEN ltt IS NOT NULL THEN CAST(epoch_ms(ltt + 19800000) AS DATE) = session_date END AS traded_today FROM steps WHERE outcome = 'accepted' QUALIFY row_number() OVER (PARTITION BY key, session_date ORDER BY seq DESC) = 1"))
def _(spark, d):
    stream = L.fold_stream(L.tick_validate(event_stream(spark, d), instruments(spark, d)).where("reason IS NULL"))
    return L.tick_latest(L.run_to_table(stream, "ticks", spark))


@query("tick_windows", """SELECT s AS start_ms, key, ltp, cp, ticks FROM (SELECT epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) AS s, user_id AS key, arg_max(100 + value, event_id) AS ltp, arg_max(100 + CAST(user_id % 20 AS DOUBLE), event_id) AS cp, count(*) AS ticks FROM events GROUP BY 1, 2)""")
def _(spark, d):
    t = events_as_stream(spark, d).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (100 + F.col("value")).alias("ltp"), (100 + (F.col("user_id") % 20).cast("double")).alias("cp"))
    w = L.window_latest(t, "6 hours").withColumn("day", F.to_date(F.timestamp_millis("start_ms")))
    return upsert_stream(w, "windows", ["day", "start_ms", "key"], "day").drop("day")


@query("tick_coverage", live_sql("""SELECT connection_id, s.kind, count(DISTINCT s.key) AS covered, any_value(c.n) AS subscribed, round(count(DISTINCT s.key)::DOUBLE / any_value(c.n), 4) AS coverage FROM steps s JOIN (SELECT kind, count(*) AS n FROM ins GROUP BY 1) c ON c.kind = s.kind WHERE outcome = 'accepted' GROUP BY 1, 2"""))
def _(spark, d):
    return L.tick_coverage(L.outcomes(valid(spark, d)).where("outcome = 'accepted'"), instruments(spark, d))


@query("session_reset", live_sql("SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS keys, count(*) FILTER (outcome = 'accepted') AS first_accepted FROM steps WHERE rn = 1 GROUP BY 1"))
def _(spark, d):
    first = steps(spark, d).groupBy("key", "session_date").agg(F.min_by("outcome", "seq").alias("outcome"))
    return first.groupBy("session_date").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("outcome") == "accepted").alias("first_accepted"))


@query("segment_status", "SELECT 'SEG' || user_id % 3 AS segment, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def _(spark, d):
    return L.segment_status(table(spark, d, "events").select(F.concat(F.lit("SEG"), F.col("user_id") % 3).alias("segment"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


LOOSE = Rules().but(live_coverage=0.3)                               # a key here ticks about twice a day


def keys_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key bigint")


def snapshots(spark, d):
    """The documents of every session, five seconds apart; the relay is down in one interval of 700."""
    ins = instruments(spark, d)
    accepted = cut_lineage(steps(spark, d).where("outcome = 'accepted'").join(ins, "key"), "accepted")
    return S.snapshots(ticks(spark, d), accepted, liquid(spark, d), ins, keys_of(spark, ASKED), LOOSE, holidays=("2024-01-26",), relay=F.col("interval") % 700 != 0)


def lines(rows: str, *fields: tuple[str, int | None]):
    """A block's rows as text, numbers with a fixed count of decimals."""
    cell = lambda r, f, n: F.coalesce((r[f] if n is None else r[f].cast(f"decimal(18,{n})")).cast("string"), F.lit("-"))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws("|", *[cell(r, f, n) for f, n in fields])), ";").alias(rows)


PRICE = (("key", None), ("ltp", 4), ("cp", 4), ("change_pct", 3), ("ltt", None))


@query("live_snapshot", live_sql("""SELECT CAST(session_date AS VARCHAR) AS session_date, interval, until, now_ms, status, last_tick_ms, subscribed, ticked, coverage, expected AS indices_expected, indices, advances, declines, unchanged, counted,
 gainers, losers, prices, reasons = '' AS ok, reasons, warnings FROM snaps""", STATE))
def _(spark, d):
    return snapshots(spark, d).select(
        "session_date", "interval", "until", "now_ms", "market.status", "market.last_tick_ms", "scope.subscribed", "scope.ticked", "scope.coverage", "scope.indices_expected", lines("indices", *PRICE), "breadth.*",
        lines("gainers", *PRICE), lines("losers", *PRICE), lines("prices", *PRICE), "quality.ok", F.array_join("quality.reasons", ",").alias("reasons"), F.array_join("quality.warnings", ",").alias("warnings"))


@query("live_movers", live_sql("SELECT list, CAST(session_date AS VARCHAR) AS session_date, interval, key, ltp, cp, change_pct, rank FROM ranked", STATE))
def _(spark, d):
    s = snapshots(spark, d)
    named = lambda name: F.transform(name, lambda r: F.struct(F.lit(name).alias("list"), r.alias("r")))
    both = F.explode(F.concat(named("gainers"), named("losers"))).alias("m")
    return s.select("session_date", "interval", both).select("m.list", "session_date", "interval", "m.r.key", "m.r.ltp", "m.r.cp", "m.r.change_pct", "m.r.rank")


@query("live_indices", live_sql("SELECT CAST(session_date AS VARCHAR) AS session_date, interval, key, round(ltp, 4) AS ltp, round(cp, 4) AS cp, round(ltp - cp, 4) AS change, change_pct FROM cell WHERE kind = 'index'", STATE))
def _(spark, d):
    return snapshots(spark, d).select("session_date", "interval", F.explode("indices").alias("r")).select("session_date", "interval", "r.key", "r.ltp", "r.cp", "r.change", "r.change_pct")


@query("live_snapshot_check", live_sql("""SELECT CAST(session_date AS VARCHAR) AS session_date, interval, problem FROM (SELECT s.*, unnest(list_filter([CASE WHEN interval % 7 = 1 THEN 'breadth' END, CASE WHEN interval % 7 = 2 AND n_gainers > 0 THEN 'gainers_sign' END,
 CASE WHEN interval % 7 = 2 AND first_pct + first_change > 0.01 THEN 'gainers_change' END, CASE WHEN interval % 7 = 2 AND n_gainers > 1 THEN 'gainers_order' END, CASE WHEN interval % 7 = 3 THEN 'scope' END, CASE WHEN interval % 7 = 4 THEN 'quality' END,
 CASE WHEN interval % 7 = 5 THEN 'lists_differ' END, CASE WHEN interval % 7 = 6 THEN 'market' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT d.*, r.pct AS first_pct, r.change_pct AS first_change FROM docs d LEFT JOIN ranked r ON r.session_date = d.session_date AND r.interval = d.interval AND r.list = 'gainers' AND r.rank = 1) s)""", STATE))
def _(spark, d):
    s, m = snapshots(spark, d), F.col("interval") % 7
    turned = F.transform("gainers", lambda r: r.withField("change_pct", F.when(r["rank"] == 1, -r["change_pct"]).otherwise(r["change_pct"])))
    return S.check(s.withColumns({
        "breadth": F.when(m == 1, F.col("breadth").withField("counted", F.col("breadth.counted") + 1)).otherwise(F.col("breadth")), "gainers": F.when(m == 2, turned).when(m != 5, F.col("gainers")),
        "scope": F.when(m == 3, F.col("scope").withField("ticked", F.col("scope.subscribed") + 1)).otherwise(F.col("scope")), "quality": F.when(m == 4, F.col("quality").withField("ok", ~F.col("quality.ok"))).otherwise(F.col("quality")),
        "market": F.when(m == 6, F.col("market").withField("status", F.lit("shut"))).otherwise(F.col("market"))}))


@query("live_quality", live_sql("SELECT CAST(session_date AS VARCHAR) AS session_date, interval, coverage, reasons, warnings, reasons = '' AS ok FROM snaps", STATE))
def _(spark, d):
    return snapshots(spark, d).select("session_date", "interval", "scope.coverage", F.array_join("quality.reasons", ",").alias("reasons"), F.array_join("quality.warnings", ",").alias("warnings"), "quality.ok")


@query("live_accept", live_sql("""SELECT CAST(session_date AS VARCHAR) AS session_date, interval, why AS refused, why IS NULL AND expected > 0 AND n_indices = expected AS show_indices, why IS NULL AND coverage >= 0.3 AND counted > 0 AS show_breadth,
 why IS NULL AND coverage >= 0.3 AND counted > 0 AS show_movers, why IS NULL AND n_prices > 0 AS show_prices FROM
 (SELECT *, CASE WHEN reasons <> '' AND interval % 3 <> 0 THEN 'unhealthy' WHEN status <> 'open' THEN 'not_open' WHEN interval % 40 - 10 > 20 THEN 'old' WHEN interval % 40 - 10 < -5 THEN 'ahead' END AS why FROM snaps)""", STATE))
def _(spark, d):
    i = F.col("interval")
    s = snapshots(spark, d)
    s = s.withColumn("quality", F.col("quality").withField("ok", F.col("quality.ok") | (i % 3 == 0)))
    return S.accept(s, F.col("now_ms") + (i % 40 - 10) * 1000, LOOSE)


@query("public_view", live_sql("SELECT CAST(session_date AS VARCHAR) AS session_date, interval, 0 AS advances, 0 AS declines, 0 AS unchanged, 0 AS counted, true AS no_movers, indices, listed AS prices FROM docs", STATE))
def _(spark, d):
    s = S.public(snapshots(spark, d), keys_of(spark, LISTED))
    return s.select("session_date", "interval", "breadth.*", (F.col("gainers").isNull() & F.col("losers").isNull()).alias("no_movers"), lines("indices", *PRICE), lines("prices", *PRICE))


@query("join_live_liquid", live_sql("SELECT key, CAST(session_date AS VARCHAR) AS session_date, ltp FROM steps WHERE outcome = 'accepted' AND key IN (SELECT key FROM ins WHERE key % 3 <> 0 AND kind = 'equity') QUALIFY row_number() OVER (PARTITION BY key, session_date ORDER BY seq DESC) = 1"))
def _(spark, d):
    from barloom.operators.joins import live_liquid
    latest = L.tick_latest(steps(spark, d)).withColumnRenamed("key", "symbol")
    return live_liquid(latest, liquid(spark, d).withColumnRenamed("key", "symbol")).select(F.col("symbol").alias("key"), "session_date", "ltp")


@query("scalar_session", "SELECT event_id, CASE WHEN isodow(t) > 5 OR CAST(t AS DATE) = DATE '2024-01-26' THEN 'closed' WHEN event_id % 10 = 0 THEN 'open' WHEN event_id % 10 = 1 THEN 'pre_open' WHEN event_id % 10 = 2 THEN 'closed' WHEN m >= 555 AND m < 930 THEN 'open' WHEN m >= 540 AND m < 555 THEN 'pre_open' ELSE 'closed' END AS status FROM (SELECT *, hour(t) * 60 + minute(t) AS m FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events))")
def _(spark, d):
    t, i = F.col("ts") + F.expr("interval 330 minutes"), F.col("event_id")
    feed = F.when(i % 10 == 0, "NORMAL_OPEN").when(i % 10 == 1, "PRE_OPEN_END").when(i % 10 == 2, "NORMAL_CLOSE")
    return table(spark, d, "events").select("event_id", V.session_status(t, F.to_date(t) == "2024-01-26", feed).alias("status"))
