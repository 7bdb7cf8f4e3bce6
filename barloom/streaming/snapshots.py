"""Live snapshots of a session, one document for every few seconds, without a table of keys times intervals.

What changes is kept, not what stands: a key's price holds from the interval of its tick to that before its next one (a *run*). Counts are sums of changes, cumulated
over the intervals of a connection. Lists (movers, indices, asked prices) come from an index of runs: each run hangs on the few aligned blocks of 2^level intervals
that it fills, a block keeps no more than a list's length, and an interval reads the blocks it lies in. A document is stored once for all following intervals
in which it would say the same (`interval` to `until`): a new one starts where a frame comes, where silence passes its limit, and where the market opens or closes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import rnd, session_status
from barloom.plans.order import latest_by
from barloom.rules import Rules
from barloom.session import cut_lineage

WIDTH_MS, LEVELS = 5_000, 15           # blocks of up to 2**LEVELS intervals: a day of five seconds is fewer
IST_MS = 19_800_000
EDGES_MIN = (540, 555, 930)            # minutes of the day at which the market's state may change
QUOTES = "array<struct<key:bigint,ltp:double,cp:double,change:double,change_pct:double,ltt:bigint>>"
MOVERS = "array<struct<rank:int,key:bigint,ltp:double,cp:double,change_pct:double,ltt:bigint>>"
TICKED = ("ticked", "advances", "declines", "unchanged", "counted", "suspect")


def _at(ms: Column, width: int) -> Column:
    return F.floor(ms / width)


def intervals(ticks: DataFrame, accepted: DataFrame, rules: Rules = Rules(), width: int = WIDTH_MS) -> DataFrame:
    """The intervals of each session in which a document starts: session_date, interval, until, connection_id, last_frame_ms, last_index_ms, last_equity_ms.

    `ticks` are all received rows, `accepted` those that passed, with `kind`. A session has at most a day's intervals, so its windows are small."""
    day = ["session_date", "interval"]
    late = lambda c, ms: F.floor((F.col(c) + ms) / width)  # noqa: E731   the first interval whose end is more than ms after
    frames = ticks.withColumn("interval", _at(F.col("recv_ms"), width)).groupBy(*day).agg(F.max("recv_ms").alias("last_frame_ms"), F.max_by("connection_id", "seq").alias("connection_id"))
    seen = accepted.withColumn("interval", _at(F.col("recv_ms"), width)).groupBy(*day).agg(
        F.max(F.when(F.col("kind") == "index", F.col("recv_ms"))).alias("last_index_ms"), F.max(F.when(F.col("kind") != "index", F.col("recv_ms"))).alias("last_equity_ms"))
    facts = cut_lineage(frames.join(seen, day, "left"), "frames")
    order = Window.partitionBy("session_date").orderBy("interval")
    ends = facts.groupBy("session_date").agg(F.min("interval").alias("first"), F.max("interval").alias("last"))
    silent = facts.withColumn("next", F.lead("interval").over(order)).select("session_date", late("last_frame_ms", rules.frame_gap_ms).alias("interval"), "next").where("interval < next")
    stale = facts.where("last_index_ms IS NOT NULL").withColumn("next", F.lead("interval").over(order))
    stale = stale.select("session_date", late("last_index_ms", rules.index_stale_ms).alias("interval"), "next").where("next IS NULL OR interval < next")
    midnight = F.unix_date("session_date").cast("bigint") * 86_400_000 - IST_MS
    opens = ends.select("session_date", F.explode(F.array(*[F.ceil((midnight + m * 60_000) / width) - 1 for m in EDGES_MIN])).alias("interval"))
    more = reduce(DataFrame.unionByName, [silent.select(*day), stale.select(*day), opens]).join(ends, "session_date").where("interval > first AND interval <= last").select(*day)
    held = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    kept = ["connection_id", "last_frame_ms", "last_index_ms", "last_equity_ms"]
    points = facts.unionByName(more, allowMissingColumns=True).groupBy(*day).agg(*[F.max(c).alias(c) for c in kept])
    return points.select(*day, F.coalesce(F.lead("interval").over(order) - 1, F.col("interval")).alias("until"), *[held(c) for c in kept])


def runs(accepted: DataFrame, points: DataFrame, width: int = WIDTH_MS) -> DataFrame:
    """The last accepted tick of each key and interval, and from which interval to which it is the newest of its connection while that is the current one."""
    part = ["session_date", "connection_id"]
    spans = points.groupBy(*part).agg(F.max("until").alias("_end"))
    last = latest_by(accepted.select("key", *part, _at(F.col("recv_ms"), width).alias("start"), "seq", "kind", "ltp", "ltt", "cp"), ["key", *part, "start"], F.col("seq"))
    after = F.lead("start").over(Window.partitionBy("key", *part).orderBy("start"))
    return last.withColumn("_next", after).join(spans, part).withColumn("stop", F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_end"))).where("start <= stop").drop("_next", "_end")


def _pct() -> Column:
    return (F.col("ltp") / F.col("cp") - 1) * 100


def breadth(held: DataFrame, points: DataFrame, liquid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`points` with the counts of equities: ticked on this connection, advances, declines and unchanged (both prices rounded first), and liquid extreme moves."""
    part = ["session_date", "connection_id"]
    equity = held.where("kind = 'equity'").join(liquid.select("key", F.lit(True).alias("_liquid")), "key", "left")
    a, b, has = rnd("ltp", 2), rnd("cp", 2), F.col("cp").isNotNull()
    one = {"ticked": F.lit(True), "advances": has & (a > b), "declines": has & (a < b), "unchanged": has & (a == b), "counted": has, "suspect": has & F.col("_liquid").isNotNull() & (F.abs(_pct()) > rules.live_extreme_pct)}
    equity = equity.select(*part, "start", "stop", *[F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in one.items()])
    changes = equity.select(*part, F.explode(F.array(F.struct(F.col("start").alias("interval"), F.lit(1).alias("s")), F.struct((F.col("stop") + 1).alias("interval"), F.lit(-1).alias("s")))).alias("x"), *TICKED)
    changes = changes.groupBy(*part, "x.interval").agg(*[F.sum(F.col(n) * F.col("x.s")).alias(n) for n in TICKED])
    upto = Window.partitionBy(*part).orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    return points.join(changes, [*part, "interval"], "left").select(*points.columns, *[F.sum(F.coalesce(F.col(n), F.lit(0))).over(upto).alias(n) for n in TICKED])


def blocks(held: DataFrame) -> DataFrame:
    """Each run on the aligned blocks it fills: `level`, `node`. At most two a level; runs longer than the largest block hang on several of these."""
    start, stop = F.col("start"), F.col("stop")

    def of(level):
        low, high = F.shiftright(start + (1 << level) - 1, level), F.shiftright(stop + 1, level) - 1
        none = F.array().cast("array<bigint>")
        if level == LEVELS:
            return F.when(low <= high, F.sequence(low, high)).otherwise(none)
        up = lambda i: F.shiftright(i, 1)
        whole = lambda i: (F.shiftleft(up(i), level + 1) >= start) & (F.shiftleft(up(i) + 1, level + 1) - 1 <= stop)
        return F.filter(F.array_distinct(F.array(low, high)), lambda i: (low <= i) & (i <= high) & ~whole(i))
    on = lambda level: F.transform(of(level), lambda i: F.struct(F.lit(level).alias("level"), i.alias("node")))
    nodes = F.flatten(F.array(*[on(n) for n in range(LEVELS + 1)]))
    return held.withColumn("_b", F.explode(nodes)).select(*held.columns, "_b.level", "_b.node")


def standing(held: DataFrame, points: DataFrame, item: Column, lists: dict[str, Column], best: int | None = None) -> DataFrame:
    """session_date, connection_id, interval and each list, an array of the runs' items in order, for every interval in which the set of runs changes. With `best`
    only so many a list: a block keeps no more, so a long list costs no more than a short one."""
    part = ["session_date", "connection_id"]
    moves = held.select(*part, F.explode(F.array("start", F.col("stop") + 1)).alias("interval")).distinct().join(points.select(*part, "interval"), [*part, "interval"], "left_semi")
    cut = lambda c: F.slice(c, 1, best) if best else c
    kept = blocks(held.select(*part, "start", "stop", F.coalesce(*[F.when(where, n) for n, where in lists.items()]).alias("_list"), item.alias("_item")))
    if best:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*part, "_list", "level", "node").orderBy("_item"))).where(F.col("_r") <= best)
    kept = kept.groupBy(*part, "level", "node").agg(*[F.collect_list(F.when(F.col("_list") == n, F.col("_item"))).alias(n) for n in lists])
    asked = moves.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("interval", n).alias("node")) for n in range(LEVELS + 1)])).alias("_b")).select(*part, "interval", "_b.level", "_b.node")
    found = asked.join(kept, [*part, "level", "node"]).groupBy(*part, "interval").agg(*[cut(F.array_sort(F.flatten(F.collect_list(n)))).alias(n) for n in lists])
    return moves.join(found, [*part, "interval"], "left")


def movers(held: DataFrame, points: DataFrame, liquid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Gainers and losers among liquid equities wherever they change; the sign counts after rounding, extreme moves are left out, ties by key."""
    m = held.where("kind = 'equity' AND cp IS NOT NULL").join(liquid.select("key"), "key", "left_semi").where(F.abs(_pct()) <= rules.live_extreme_pct)
    m = m.withColumn("change_pct", rnd(_pct(), 3)).where("change_pct <> 0").withColumn("away", -F.abs("change_pct"))
    both = standing(m, points, F.struct("away", "key", "ltp", "cp", "change_pct", "ltt"), {"gainers": F.col("change_pct") > 0, "losers": F.col("change_pct") < 0}, rules.live_rows)
    ranked = lambda c: F.transform(c, lambda r, i: F.struct((i + 1).alias("rank"), *[r[f].alias(f) for f in ("key", "ltp", "cp", "change_pct", "ltt")]))
    return both.withColumns({c: F.coalesce(ranked(c), F.array().cast(MOVERS)) for c in ("gainers", "losers")})


def quoted(held: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """Price rows of a configured list of keys (indices, asked symbols) wherever one changes; the list is short by nature, so its rows are the output."""
    q = held.select("session_date", "connection_id", "start", "stop", "key", rnd("ltp", 4).alias("ltp"), rnd("cp", 4).alias("cp"), rnd(F.col("ltp") - F.col("cp"), 4).alias("change"), rnd(_pct(), 3).alias("change_pct"), "ltt")
    return standing(q, points, F.struct("key", "ltp", "cp", "change", "change_pct", "ltt"), {name: F.lit(True)}).withColumn(name, F.coalesce(name, F.array().cast(QUOTES)))


def snapshots(ticks: DataFrame, accepted: DataFrame, liquid: DataFrame, instruments: DataFrame, asked: DataFrame | None = None, rules: Rules = Rules(), width: int = WIDTH_MS,
              holidays: tuple[str, ...] = (), relay: Column | None = None, universe: str = "all") -> DataFrame:
    """The documents: session_date, interval, until, now_ms and the blocks market, scope, indices, breadth, gainers, losers, prices, quality.

    Only keys that ticked on the current connection count. Without a liquid list gainers and losers are NULL, never an unfiltered list, and a warning says so.
    `relay` says whether the relay streams (default: yes); `asked` lists the keys whose prices are wanted."""
    part = ["session_date", "connection_id"]
    points = cut_lineage(intervals(ticks, accepted, rules, width), "intervals")
    held = cut_lineage(runs(accepted, points, width), "runs")
    doc = breadth(held, points, liquid, rules)
    doc = doc.join(movers(held, points, liquid, rules), [*part, "interval"], "left").join(quoted(held.where("kind = 'index'"), points, "indices"), [*part, "interval"], "left")
    if asked is None:
        doc = doc.withColumn("prices", F.lit(None).cast(QUOTES))
    else:
        doc = doc.join(quoted(held.join(asked.select("key"), "key", "left_semi"), points, "prices"), [*part, "interval"], "left")
    upto = Window.partitionBy(*part).orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    empty = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.array().cast(doc.schema[c].dataType))
    doc = doc.withColumns({c: empty(c) for c in ("gainers", "losers", "indices", "prices")})
    known = instruments.agg(F.count_if(F.col("kind") == "equity").alias("_subscribed"), F.count_if(F.col("kind") == "index").alias("_indices"))
    doc = doc.crossJoin(F.broadcast(known.crossJoin(liquid.agg(F.count(F.lit(1)).alias("_liquid")))))              # one row of counts
    now = (F.col("interval") + 1) * width
    ist = F.timestamp_millis(now + IST_MS)
    status = session_status(ist, F.to_date(ist).cast("string").isin(*holidays) if holidays else F.lit(False), F.lit(None).cast("string"))
    ticking = F.greatest("last_index_ms", "last_equity_ms")
    share = F.coalesce(F.try_divide(F.col("ticked"), F.col("_subscribed")), F.lit(0.0))
    gap = lambda c, ms: F.col(c).isNull() | (now - F.col(c) > ms)
    is_open = status == "open"
    reasons = F.array_compact(F.array(
        F.when(~(F.lit(True) if relay is None else relay), "not_streaming"), F.when(gap("last_frame_ms", rules.frame_gap_ms), "feed_silent"), F.when(is_open & gap("last_index_ms", rules.index_stale_ms), "index_ticks_stale"),
        F.when(is_open & (share < rules.live_coverage), "low_coverage"), F.when((F.col("_indices") > 0) & (F.size("indices") == 0), "no_indices")))
    warnings = F.array_compact(F.array(F.when(F.col("_liquid") == 0, "liquid_list_unavailable"), F.when(F.col("suspect") > 0, F.concat(F.lit("suspect_extreme_moves:"), F.col("suspect")))))
    listed = lambda c: F.when(F.col("_liquid") > 0, F.col(c))
    return doc.select(
        "session_date", "interval", "until", now.alias("now_ms"), F.struct(status.alias("status"), "session_date", ticking.alias("last_tick_ms")).alias("market"),
        F.struct(F.lit(universe).alias("universe"), F.col("_subscribed").alias("subscribed"), "ticked", rnd(share, 4).alias("coverage"), F.col("_indices").alias("indices_expected")).alias("scope"), "indices",
        F.struct("advances", "declines", "unchanged", "counted").alias("breadth"), listed("gainers").alias("gainers"), listed("losers").alias("losers"), "prices",
        F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), warnings.alias("warnings")).alias("quality"))


def _list_rules(name: str, sign: int, off, rows: int) -> dict[str, Column]:
    c, after = F.col(name), F.slice(F.col(name), 2, rows + 1)
    later = lambda x, y: y.isNotNull() & ((y["change_pct"] * sign > x["change_pct"] * sign) | ((y["change_pct"] == x["change_pct"]) & (y["key"] < x["key"])))
    return {f"{name}_count": F.size(c) > rows, f"{name}_sign": F.exists(c, lambda r: r["change_pct"] * sign <= 0), f"{name}_change": F.exists(c, off),
            f"{name}_order": F.exists(F.zip_with(c, after, later), lambda x: x), f"{name}_rank": F.exists(F.transform(c, lambda r, i: r["rank"] != i + 1), lambda x: x)}


def check(docs: DataFrame, rows: int = 50, prices: int = 200) -> DataFrame:
    """Problems of documents (session_date, interval, problem): blocks whose numbers do not add up, rows whose change is not that of their prices, wrong signs, order."""
    off = lambda r: F.abs(r["change_pct"] - (r["ltp"] / r["cp"] - 1) * 100) > 0.01
    s, b, q = (F.col(c) for c in ("scope", "breadth", "quality"))
    rules = {
        "scope": (s["coverage"] < 0) | (s["coverage"] > 1) | (s["ticked"] < 0) | ((s["subscribed"] > 0) & (s["ticked"] > s["subscribed"])),
        "breadth": (b["advances"] + b["declines"] + b["unchanged"] != b["counted"]) | (F.least(b["advances"], b["declines"], b["unchanged"]) < 0) | (b["counted"] > s["ticked"]),
        "market": ~F.col("market.status").isin("open", "pre_open", "closed", "unknown"),
        "index_price": F.exists("indices", lambda r: r["ltp"].isNull() | (r["ltp"] <= 0) | (r["cp"] <= 0)), "index_change": F.exists("indices", lambda r: r["cp"].isNotNull() & (r["change_pct"].isNull() | off(r))),
        "indices_count": F.size("indices") > s["indices_expected"], "lists_differ": F.col("gainers").isNull() != F.col("losers").isNull(),
        "prices": (F.size("prices") > prices) | F.exists("prices", lambda r: r["ltp"].isNull()), "quality": q["ok"] != (F.size(q["reasons"]) == 0), "run": F.col("until") < F.col("interval"),
    }
    for name, sign in (("gainers", 1), ("losers", -1)):
        rules |= _list_rules(name, sign, off, rows)
    faults = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return docs.select("session_date", "interval", F.explode(faults).alias("problem"))


def accept(docs: DataFrame, client_ms: Column, rules: Rules = Rules(), private: str = "test_set") -> DataFrame:
    """Which blocks of a document a client may show at its time: session_date, interval, refused (a code, NULL = shown), show_indices, show_breadth, show_movers, show_prices."""
    age, s = client_ms - F.col("now_ms"), F.col("scope")
    why = (F.when(~F.col("quality.ok"), "unhealthy").when(F.col("market.status") != "open", "not_open").when(age > rules.max_age_ms, "old").when(age < -rules.skew_ms, "ahead").when(s["universe"] == private, "private"))
    fine, covered = why.isNull(), (s["coverage"] >= rules.live_coverage) & (F.col("breadth.counted") > 0)
    return docs.select("session_date", "interval", why.alias("refused"), (fine & (s["indices_expected"] > 0) & (F.size("indices") == s["indices_expected"])).alias("show_indices"), (fine & covered).alias("show_breadth"),
                       (fine & covered & F.col("gainers").isNotNull() & F.col("losers").isNotNull()).alias("show_movers"), (fine & (F.size("prices") > 0)).alias("show_prices"))


def public(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The published part: counts zeroed, movers NULL, prices of the listed keys only. The list is joined, not gathered, so it may be of any length."""
    rows = docs.select("session_date", "interval", F.explode("prices").alias("p")).join(listed.select(F.col("key").alias("_k")), F.col("p.key") == F.col("_k"), "left_semi")
    kept = rows.groupBy("session_date", "interval").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("advances", "declines", "unchanged", "counted")])
    none = lambda c: F.lit(None).cast(docs.schema[c].dataType).alias(c)
    out = docs.join(kept, ["session_date", "interval"], "left")
    return out.select(*[zero.alias(c) if c == "breadth" else none(c) if c in ("gainers", "losers") else F.coalesce("_p", F.array().cast(docs.schema[c].dataType)).alias(c) if c == "prices" else F.col(c) for c in docs.columns])
