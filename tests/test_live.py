"""Tick rules by hand, and the stream against the replay of the same ticks over many micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import fresh_dir
from barloom.sources.keyed import read_keyed, upsert, upsert_stream
from barloom.sources.market import ticks
from barloom.streaming import snapshots as S
from barloom.streaming import ticks as L

SF = "/root/testdata/sf0.001"


def run(*ticks):
    state, out = L.EMPTY, []
    for ltp, ltt, cp, conn in ticks:
        state, what = L.step(state, ltp, ltt, cp, conn, 0.25, 0.05)
        out.append(what)
    return state, out


@pytest.mark.parametrize("ticks, want", [
    ([(100, 10, 99, 1), (101, 9, 99, 1)], ["accepted", "out_of_order"]),
    ([(100, 10, 99, 1), (101, 10, 99, 1)], ["accepted", "accepted"]),
    ([(100, 10, 99, 1), (101, None, 99, 1), (102, 5, 99, 1)], ["accepted", "accepted", "accepted"]),
    ([(100, 1, 99, 1), (130, 2, 99, 1), (131, 3, 99, 1)], ["accepted", "jump_pending", "accepted"]),
    ([(100, 1, 99, 1), (130, 2, 99, 1), (160, 3, 99, 1), (161, 4, 99, 1)], ["accepted", "jump_pending", "jump_pending", "accepted"]),
    ([(100, 1, 99, 1), (130, 2, 99, 1), (101, 3, 99, 1), (130, 4, 99, 1)], ["accepted", "jump_pending", "accepted", "jump_pending"]),
    ([(100, 1, 99, 1), (130, 2, 99, 1), (131, 3, 99, 2)], ["accepted", "jump_pending", "jump_pending"]),
])
def test_steps(ticks, want):
    assert run(*ticks)[1] == want


def test_previous_close_is_kept_when_omitted():
    state, _ = run((100, 1, 98.0, 1), (101, 2, None, 1))
    assert state[:4] == (101, 2, 98.0, 2)


def test_validation_reasons(spark):
    rows = [(1, 100.0, 10, 10), (1, -1.0, 10, 10), (1, float("nan"), 10, 10), (1, 2e7, 10, 10), (1, 5.0, 10, 70_011), (9, 5.0, 10, 10), (1, 5.0, 10, None)]
    df = spark.createDataFrame(rows, "key bigint, ltp double, recv_ms bigint, ltt bigint").withColumn("cp", F.lit(-1.0))
    ins = spark.createDataFrame([(1, "equity")], "key bigint, kind string")
    got = [r.reason for r in L.tick_validate(df, ins).collect()]
    assert sorted(map(str, got)) == sorted(["None", "bad_ltp", "bad_ltp", "bad_ltp", "future_ltt", "unknown_key", "None"])


def test_stream_over_many_batches_equals_replay(spark, tmp_path):
    t = ticks(spark, SF)
    ins = t.select("key").distinct().withColumn("kind", F.lit("equity"))
    # eight files in receive order, one per micro-batch
    path = str(tmp_path / "frames")
    t.withColumn("part", F.ntile(8).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("seq"))).repartition(8, "part").write.partitionBy("part").parquet(path)
    import glob
    import os
    for i, f in enumerate(sorted(glob.glob(path + "/part=*/*.parquet"))):
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    key = ["seq", "outcome", "ltp", "ltt", "cp", "n"]
    got = L.run_to_table(L.fold_stream(L.tick_validate(stream, ins).where("reason IS NULL")), "test", spark).select(*key)
    want = L.replay(L.tick_validate(t, ins).where("reason IS NULL")).select(*key)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def one_by_one(spark, tmp_path, parts):
    """A file stream that takes these frames one a micro-batch, in this order."""
    import glob
    import os
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"f/{i}"))
        for f in glob.glob(str(tmp_path / f"f/{i}/*.parquet")):
            os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "f"))


def days_in_disorder(spark):
    t = ticks(spark, SF).withColumn("kind", F.lit("equity"))
    one, two = (t.where(F.col("session_date") == d).sort("seq") for d in ("2024-01-02", "2024-01-03"))
    half = lambda df: df.agg(F.percentile_approx("seq", 0.5)).first()[0]
    a, b = half(one), half(two)
    return [one.where(F.col("seq") <= a), two.where(F.col("seq") <= b), one.where(F.col("seq") > a), two.where(F.col("seq") > b)], one.unionByName(two)


@pytest.mark.parametrize("keep", [None, "3 days"])
def test_late_ticks_of_an_earlier_session_find_their_own_state(spark, tmp_path, keep):
    parts, whole = days_in_disorder(spark)
    ins = whole.select("key").distinct().withColumn("kind", F.lit("equity"))
    fine = lambda df: L.tick_validate(df.drop("kind"), ins).where("reason IS NULL")
    stream = one_by_one(spark, tmp_path, parts)
    key = ["session_date", "seq", "outcome", "ltp", "ltt", "cp", "n"]
    got = sorted(map(tuple, L.run_to_table(L.fold_stream(fine(stream), keep=keep), "late", spark).select(*key).collect()), key=str)
    assert got == sorted(map(tuple, L.replay(fine(whole)).select(*key).collect()), key=str) and len({r[0] for r in got}) == 2


def test_states_of_old_sessions_end(spark, tmp_path):
    t = ticks(spark, SF).where("session_date < '2024-01-12'")
    days = [t.where(F.col("session_date") == r[0]).sort("seq") for r in t.select("session_date").distinct().sort("session_date").collect()]
    base = fresh_dir(spark, "ended")
    ins = t.select("key").distinct().withColumn("kind", F.lit("equity"))
    stream = L.fold_stream(L.tick_validate(one_by_one(spark, tmp_path, days), ins).where("reason IS NULL"), keep="1 day")
    q = stream.writeStream.format("parquet").option("path", base + "/data").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    keys = t.select("key", "session_date").distinct().count()
    assert kept[-1] < keys / 2 and spark.read.parquet(base + "/data").count() == L.tick_validate(t, ins).where("reason IS NULL").count()


def test_states_of_a_session_lie_together(spark, tmp_path):
    rows = [(k, dt.date(2024, 1, 2), 10 * k + i, 1_704_200_000_000 + i, 100.0 + i, None, None, 1, "equity") for k in range(1, 601) for i in range(2)]
    t = spark.createDataFrame(rows, L.TICK + ", kind string").withColumn("cp", F.lit(99.0))
    parts = [t.where("seq % 10 = 0"), t.where("seq % 10 = 1")]
    stream, base = one_by_one(spark, tmp_path, parts), fresh_dir(spark, "together")
    q = L.fold_stream(stream, buckets=16).writeStream.format("parquet").option("path", base + "/data").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 16
    latest = L.tick_latest(spark.read.parquet(base + "/data")).collect()
    assert len(latest) == 600 and {(r.ltp, r.cp, r.n) for r in latest} == {(101.0, 99.0, 2)} and all(r.seq == 10 * r.key + 1 for r in latest)


def test_windows_of_a_stream_in_disorder_are_all_there(spark, tmp_path):
    parts, whole = days_in_disorder(spark)
    cols = lambda df: df.select(F.timestamp_millis("recv_ms").alias("at"), "seq", "key", "ltp", "cp")
    w = L.window_latest(cols(one_by_one(spark, tmp_path, parts)), "1 hour", "3 days").withColumn("day", F.to_date(F.timestamp_millis("start_ms")))
    got = upsert_stream(w, "windows", ["day", "start_ms", "key"], "day").drop("day")
    want = L.window_latest(cols(whole), "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_update_that_comes_again_changes_nothing(spark):
    base, schema = fresh_dir(spark, "keyed"), T.StructType.fromDDL("day string, key bigint, v bigint")
    table = lambda: sorted(map(tuple, read_keyed(spark, base, schema, "day").collect()), key=str)
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert table() == []
    upsert(make([("a", 1, 1), ("a", 2, 1), ("b", 1, 1), (None, 1, 1)]), base, ["day", "key"], "day", 0)
    upsert(make([("a", 1, 2), ("c", 1, 2)]), base, ["day", "key"], "day", 1)
    want = sorted([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), (None, 1, 1), ("c", 1, 2)], key=str)
    assert table() == want
    upsert(make([("a", 1, 2), ("c", 1, 2)]), base, ["day", "key"], "day", 1)
    assert table() == want
    make([("a", 1, 9)]).withColumn("_p", F.lit("a")).write.partitionBy("_p").parquet(f"{base}/data/{2:012d}")               # data of an update that never ended
    assert table() == want
    upsert(make([("a", 1, 3)]), base, ["day", "key"], "day", 2)
    upsert(make([("a", 1, 1), ("a", 2, 5)]), base, ["day", "key"], "day", 3, order="v")
    assert ("a", 1, 3) in table() and ("a", 2, 5) in table() and len(table()) == 5


QUOTE = "array<struct<key:bigint,ltp:double,cp:double,change:double,change_pct:double,ltt:bigint>>"
MOVER = "array<struct<rank:int,key:bigint,ltp:double,cp:double,change_pct:double,ltt:bigint>>"
DOCUMENT = f"""session_date date, interval bigint, until bigint, now_ms bigint, market struct<status:string,session_date:date,last_tick_ms:bigint>,
    scope struct<universe:string,subscribed:bigint,ticked:bigint,coverage:double,indices_expected:bigint>, indices {QUOTE}, breadth struct<advances:bigint,declines:bigint,unchanged:bigint,counted:bigint>,
    gainers {MOVER}, losers {MOVER}, prices {QUOTE}, quality struct<ok:boolean,reasons:array<string>,warnings:array<string>>"""
DAY = dt.date(2024, 1, 3)
NINE = int(dt.datetime(2024, 1, 3, tzinfo=dt.UTC).timestamp() * 1000) + 9 * 3_600_000 - 19_800_000            # nine o'clock of the session's day, Indian time


def documents(spark, rows, liquid, asked=(), **more):
    """Snapshots of (key, recv_ms, ltp, cp, connection) rows, all accepted; keys below 3 are indices."""
    ticks = spark.createDataFrame([(k, i, r, p, r - 5, c, conn, DAY) for i, (k, r, p, c, conn) in enumerate(rows)], "key bigint, seq bigint, recv_ms bigint, ltp double, ltt bigint, cp double, connection_id bigint, session_date date")
    accepted = ticks.withColumn("kind", F.when(F.col("key") < 3, "index").otherwise("equity"))
    ins = accepted.select("key", "kind").distinct()
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "key bigint")
    return S.snapshots(ticks, accepted, keys(liquid), ins, keys(asked), **more).orderBy("interval").collect()


def by_hand(rows, at, liquid, asked, kinds):
    """A snapshot at the end of interval `at`, straight from the rules."""
    now = (at + 1) * 5000
    past = [r for r in rows if r[1] < now]
    connection = past[-1][4]
    known = {}
    for k, r, p, c, conn in past:
        if conn == connection:
            known[k] = (p, c)
    equity = {k: v for k, v in known.items() if kinds[k] == "equity"}
    pct = {k: (p / c - 1) * 100 for k, (p, c) in equity.items() if c}
    sides = [(round(p, 2) > round(c, 2)) - (round(p, 2) < round(c, 2)) for p, c in equity.values() if c]
    m = sorted((-abs(round(v, 3)), k, round(v, 3)) for k, v in pct.items() if k in liquid and abs(v) <= 40 and round(v, 3))
    last_frame, last_index = past[-1][1], max((r for k, r, *_ in past if kinds[k] == "index"), default=None)
    minute = (now + 19_800_000) // 60_000 % 1440
    is_open, share = 555 <= minute < 930, len(equity) / sum(v == "equity" for v in kinds.values())
    reasons = [w for w, yes in (("feed_silent", now - last_frame > 10_000), ("index_ticks_stale", is_open and (last_index is None or now - last_index > 20_000)), ("low_coverage", is_open and share < 0.9),
                                ("no_indices", not any(kinds[k] == "index" for k in known))) if yes]
    return (len(equity), sides.count(1), sides.count(-1), sides.count(0), [(k, c) for _, k, c in m if c > 0][:10], [(k, c) for _, k, c in m if c < 0][:10], sorted(k for k in known if kinds[k] == "index"),
            sorted((k, known[k][0]) for k in known if k in asked), reasons, "open" if is_open else "pre_open" if minute >= 540 else "closed")


def test_every_five_seconds_equals_the_rules_by_hand(spark):
    rng = random.Random(7)
    rows, now, close = [], NINE + 13 * 60_000, {k: 100.0 + k for k in range(40)}
    for _ in range(260):
        now += rng.choice([0, 200, 900, 2500, 4000, 30_000])
        k = rng.randrange(40)
        rows.append((k, now, round(close[k] * (1 + rng.choice([0, 1e-6, rng.gauss(0, 0.05), rng.gauss(0, 0.05), 0.6])), 2), None if k % 9 == 8 else close[k], 1 + (len(rows) > 150)))
    liquid, asked = {k for k in range(3, 40) if k % 4}, {2, 5, 8, 17}
    docs = documents(spark, rows, liquid, asked)
    kinds = {k: "index" if k < 3 else "equity" for k in {r[0] for r in rows}}
    first, last = rows[0][1] // 5000, rows[-1][1] // 5000
    covered = [i for d in docs for i in range(d.interval, d.until + 1)]
    assert covered == list(range(first, last + 1))                                   # every interval once
    for d in docs:
        for i in range(d.interval, d.until + 1):
            b = d.breadth
            assert by_hand(rows, i, liquid, asked, kinds) == (
                d.scope.ticked, b.advances, b.declines, b.unchanged, [(r.key, r.change_pct) for r in d.gainers], [(r.key, r.change_pct) for r in d.losers], [r.key for r in d.indices],
                [(r.key, r.ltp) for r in d.prices], d.quality.reasons, d.market.status)


def test_without_a_liquid_list_there_are_no_movers(spark):
    docs = documents(spark, [(1, NINE, 10.0, 9.0, 1), (5, NINE + 100, 11.0, 10.0, 1)], [])
    assert [(d.gainers, d.losers, d.quality.warnings) for d in docs] == [(None, None, ["liquid_list_unavailable"])]


def test_movers_sign_after_rounding_and_extremes(spark):
    prices = {11: (100.0004, 100.0), 12: (103.0, 100.0), 13: (150.0, 100.0), 14: (97.0, 100.0), 15: (120.0, None), 16: (110.0, 100.0)}
    d = documents(spark, [(k, NINE, p, c, 1) for k, (p, c) in prices.items()], (11, 12, 13, 14, 15))[-1]
    assert [r.key for r in d.gainers] == [12] and [r.key for r in d.losers] == [14]
    assert (d.scope.ticked, d.breadth.advances, d.breadth.declines, d.breadth.unchanged, d.quality.warnings) == (6, 3, 1, 1, ["suspect_extreme_moves:1"])


def test_blocks_cover_each_interval_of_a_run_once(spark):
    spans = [(0, 0), (1, 1), (0, 7), (3, 17), (5, 5 + 70_000), (12_345, 29_999)]
    rows = S.blocks(spark.createDataFrame(spans, "start bigint, stop bigint")).collect()
    for a, b in spans:
        mine = sorted((r.node << r.level, ((r.node + 1) << r.level) - 1) for r in rows if (r.start, r.stop) == (a, b))
        assert mine[0][0] == a and mine[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(mine, mine[1:])) and len(mine) <= 2 * S.LEVELS + 3


def test_check_and_accept(spark):
    docs = documents(spark, [(1, NINE + 20 * 60_000, 10.0, 9.0, 1), (5, NINE + 20 * 60_000 + 6000, 11.0, 10.0, 1)], [5], [5])
    good = spark.createDataFrame(docs, DOCUMENT)
    assert S.check(good).count() == 0
    shown = {r.interval: r for r in S.accept(good, F.col("now_ms") + 3000).collect()}
    assert [shown[d.interval].refused for d in docs] == ["unhealthy" if not d.quality.ok else None for d in docs]
    last = shown[docs[-1].interval]
    assert (last.refused, last.show_indices, last.show_breadth, last.show_movers, last.show_prices) == (None, True, True, True, True)
    assert {r.refused for r in S.accept(good.where("quality.ok"), F.col("now_ms") + 30_000).collect()} == {"old"} and {r.refused for r in S.accept(good.where("quality.ok"), F.col("now_ms") - 6000).collect()} == {"ahead"}
    bad = good.withColumn("gainers", F.lit(None).cast(good.schema["gainers"].dataType)).withColumn("scope", F.col("scope").withField("ticked", F.lit(-1).cast("bigint")))
    assert {r.problem for r in S.check(bad).collect()} == {"scope", "breadth", "lists_differ"}
    only = S.public(good, spark.createDataFrame([(99,)], "key bigint")).collect()
    assert all(r.prices == [] and r.gainers is None and r.breadth.counted == 0 for r in only) and len(only) == len(docs)


def test_replay_walks_only_what_is_not_proven(spark):
    """A hot session over many parts, sessions of one to six ticks, repeated rows and gaps: the same rows as one walk, and most of a calm session needs no walk."""
    rnd = random.Random(11)
    rows, day = [], dt.date(2024, 1, 2)
    def session(key, day, n, wild):
        price, clock = 100.0, 1000
        for _ in range(n):
            clock += rnd.randint(0, 3)
            price *= 1 + rnd.uniform(-0.0002, 0.0002)
            shown = price * rnd.choice([1.4, 0.6, 1.42]) if rnd.random() < wild else price
            ltt = None if rnd.random() < 0.05 else clock - (500 if rnd.random() < wild else 0)
            rows.append((key, day, len(rows), clock, shown, ltt, rnd.choice([None, 99.0, 98.5]), len(rows) // 400))
    session(1, day, 4000, 0.002)
    session(1, day + dt.timedelta(1), 1500, 0.3)
    session(2, day, 800, 0.0)
    for k in range(3, 90):
        session(k, day, rnd.randint(1, 6), 0.4)
    rows += [rows[7], rows[4100]]                        # repeated rows
    df = spark.createDataFrame(rows, L.TICK)
    want, state, at = [], None, None
    for k, s, seq, recv, ltp, ltt, cp, conn in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if at != (k, s):
            at, state = (k, s), L.EMPTY
        state, what = L.step(state, ltp, ltt, cp, conn, 0.25, 0.05)
        want.append((k, s, seq, recv, conn, what, *state[:4]))
    got = [tuple(r) for r in L.replay(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[5] for r in got} == {"accepted", "out_of_order", "jump_pending"}
    marked = L.proofs(df)
    assert marked.where("key = 1").select("_bucket").distinct().count() > 1
    shares = {(r.key, r.session_date): r.walked for r in marked.groupBy("key", "session_date").agg(F.avg((~F.col("sure")).cast("int")).alias("walked")).collect()}
    assert shares[2, day] == 0 and shares[1, day] < 0.05
    assert L.replay(df.limit(0)).count() == 0
