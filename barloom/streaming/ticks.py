"""Live ticks: validation, the sequential rules per key, latest state, windows and coverage.

The sequential rules (late, held jump, stored previous close) are one small step function. Two drivers use it: a stateful stream, and a replay of whole
tables that first proves by window functions which ticks are accepted whatever came before them, and walks only the ticks between such proofs. A session
with a third of all ticks is ordered over many parts, and its stretches without proof are walked by many tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.values import finite, rnd
from barloom.plans.order import latest_by, running_values, spread
from barloom.rules import Rules
from barloom.session import cut_lineage, fresh_dir

TICK = "key bigint, session_date date, seq bigint, recv_ms bigint, ltp double, ltt bigint, cp double, connection_id bigint"
STEP = "key bigint, session_date date, seq bigint, recv_ms bigint, connection_id bigint, outcome string, ltp double, ltt bigint, cp double, n bigint"
STATE = "keys array<struct<key:bigint,ltp:double,ltt:bigint,cp:double,n:bigint,pending:double,connection:bigint>>"
EMPTY = (None, None, None, 0, None, None)
EPOCH = dt.date(1970, 1, 1)


def tick_validate(ticks: DataFrame, instruments: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add the instrument kind and the first reason to reject (NULL = goes on). Works on a stream or a table; the planner sizes the join."""
    j = ticks.join(instruments.select(F.col("key"), "kind"), "key", "left")
    price_ok = F.coalesce((finite(F.col("ltp")) > 0) & (F.col("ltp") <= rules.max_price), F.lit(False))
    ltt = F.when(F.col("ltt") >= 0, F.col("ltt"))
    reason = F.when(F.col("kind").isNull(), "unknown_key").when(~price_ok, "bad_ltp").when(ltt > F.col("recv_ms") + rules.future_ms, "future_ltt")
    return j.withColumns({"ltt": ltt, "cp": F.when(finite(F.col("cp")) > 0, F.col("cp")), "reason": reason})


def step(state: tuple, ltp: float, ltt, cp, connection: int, jump: float, confirm: float) -> tuple[tuple, str]:
    """One tick against the state of its key: the new state and what happened."""
    s_ltp, s_ltt, s_cp, n, pending, s_conn = state
    if s_conn is not None and connection != s_conn:
        pending = None                                   # a new connection forgets held jumps, never prices
    if s_ltp is not None:
        if ltt is not None and s_ltt is not None and ltt < s_ltt:
            return (s_ltp, s_ltt, s_cp, n, pending, connection), "out_of_order"
        if abs(ltp / s_ltp - 1) > jump and not (pending is not None and abs(ltp / pending - 1) <= confirm):
            return (s_ltp, s_ltt, s_cp, n, ltp, connection), "jump_pending"
    cp = cp if cp is not None else s_cp
    return (ltp, ltt, cp, n + 1, None, connection), "accepted"


def _rows(pdf: pd.DataFrame):
    values = []
    for c in ("key", "session_date", "seq", "recv_ms", "ltp", "ltt", "cp", "connection_id"):
        got = pdf[c].tolist()
        if c == "ltt":                                   # whole milliseconds: a column with gaps arrives as floating point
            got = [None if v is None or v != v else int(v) for v in got]
        elif c == "cp":
            got = [None if v is None or v != v else v for v in got]
        values.append(got)
    return zip(*values)


def _frame(rows: list) -> pd.DataFrame:
    names = ("key", "session_date", "seq", "recv_ms", "connection_id", "outcome", "ltp", "ltt", "cp", "n")
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(c, dtype="object" if n in ("session_date", "outcome", "ltt") else "float64" if n in ("ltp", "cp") else "int64") for n, c in zip(names, columns)})


def _line(key, session, seq, recv, connection, state, outcome):
    return (key, session, seq, recv, connection, outcome, state[0], state[1], state[2], state[3])


ORDER = ["seq", "recv_ms", "ltp", "ltt", "cp", "connection_id"]                # the rest after `seq` only makes repeated rows fall alike in every pass
PART = ["key", "session_date"]


def proofs(valid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every valid tick with `sure`, whether it is certainly accepted, and `segment`, the stretch it lies in (stored, in global order).

    A tick is known to be accepted if it is the first of its session, or not older than any tick before it and within the jump ratio of the lowest and
    the highest price before it: whichever of them is the state, no rule holds it back. So is one that confirms the tick before it on the same connection,
    if neither is older than any tick before them: that tick was accepted or is the held jump. After a tick that is surely accepted the state is
    that tick, so the next one is judged by the pair alone. A pair that fails leaves the ticks up to the next known one open."""
    placed = spread(valid.select(*[c.split()[0] for c in TICK.split(", ")]), [*PART, "seq"])
    ltp, ltt = F.col("ltp"), F.col("ltt")
    seen = running_values(placed, PART, ORDER, {"_newest": ("max", ltt), "_low": ("min", ltp), "_high": ("max", ltp), "before": ("last", F.struct("ltp", "ltt", "connection_id"))}, own=False)
    calm = lambda price: F.abs(ltp / price - 1) <= rules.jump_ratio
    in_time = lambda other: F.coalesce(ltt >= other, F.lit(True))
    held_on = F.coalesce(F.col("before.ltt") == F.col("_newest"), F.lit(True)) & F.col("before.connection_id").eqNullSafe(F.col("connection_id"))
    confirmed = held_on & (F.abs(ltp / F.col("before.ltp") - 1) <= min(rules.jump_confirm, rules.jump_ratio))
    known = F.col("before").isNull() | (in_time(F.col("_newest")) & ((calm(F.col("_low")) & calm(F.col("_high"))) | confirmed))
    pair = in_time(F.col("before.ltt")) & calm(F.col("before.ltp"))
    judged = seen.withColumn("_known", known).withColumn("_event", F.when(F.col("_known"), True).when(~pair, False)).drop("_newest", "_low", "_high")
    marked = running_values(judged, PART, ORDER, {"sure": ("last", F.col("_event")), "segment": ("sum", F.col("_known").cast("long"))})
    return cut_lineage(marked.drop("_known", "_event"), "proofs")


def outcomes(valid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every valid tick of whole tables with its outcome. Python sees only the ticks that `proofs` leaves open; each stretch of them starts from the surely
    accepted tick before it, so a session's stretches are walked apart. One stretch is walked by one task."""
    jump, confirm = rules.jump_ratio, rules.jump_confirm
    marked = proofs(valid, rules)
    plain = [c for c in marked.columns if c not in ("sure", "segment", "before")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, EMPTY
        for pdf in batches:
            out = []
            starts = zip(pdf["segment"].tolist(), pdf["_ltp"].tolist(), pdf["_ltt"].tolist(), pdf["_conn"].tolist())
            for (key, session, _, _, ltp, ltt, cp, conn), (segment, s_ltp, s_ltt, s_conn) in zip(_rows(pdf), starts):
                if (key, session, segment) != at:        # the first open tick of a stretch: the tick before it is the state
                    at, state = (key, session, segment), (s_ltp, None if s_ltt is None or s_ltt != s_ltt else int(s_ltt), None, 0, None, s_conn)
                state, outcome = step(state, ltp, ltt, cp, conn, jump, confirm)
                out.append(outcome)
            yield pdf[plain].assign(outcome=out)

    unsure = marked.where("NOT sure").select(*plain, "segment", F.col("before.ltp").alias("_ltp"), F.col("before.ltt").alias("_ltt"), F.col("before.connection_id").alias("_conn"))
    placed = unsure.repartition(*PART, "segment").sortWithinPartitions(*PART, "segment", *ORDER)
    walked = placed.mapInPandas(walk, f"{TICK}, _bucket int, outcome string")
    return marked.where("sure").select(*plain, F.lit("accepted").alias("outcome")).unionByName(walked)


def replay(valid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every valid tick of whole tables with its outcome and the stored state after it: the last accepted tick, the last previous close and the count so far."""
    done = cut_lineage(outcomes(valid, rules), "outcomes")
    ok = F.col("outcome") == "accepted"
    state = running_values(done, PART, ORDER, {"_last": ("last", F.when(ok, F.struct("ltp", "ltt"))), "_cp": ("last", F.when(ok, F.col("cp"))), "n": ("sum", ok.cast("long"))})
    return state.select(*PART, "seq", "recv_ms", "connection_id", "outcome", "_last.ltp", "_last.ltt", F.col("_cp").alias("cp"), "n")


def fold_stream(valid: DataFrame, rules: Rules = Rules(), keep: str | None = None, buckets: int = 128) -> DataFrame:
    """The same rules on a stream, with one state for each key and session, so that ticks of an earlier session that come late find their own state and leave the
    newer one alone. The states of a session lie together by the hash of their key in `buckets` groups (fixed for a checkpoint), since what a call costs
    does not depend on its rows: the calls grow with sessions and not with keys. With `keep` (such as "2 days") a session's states end once the newest tick
    seen is so much later than the session's end, and ticks that come later still are dropped by the watermark; without it they stay in the state store.
    What one call sorts is one group's part of one micro-batch."""
    jump, confirm = rules.jump_ratio, rules.jump_confirm

    def fold(group: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        states = {k: tuple(None if v is None or v != v else v for v in rest) for k, *rest in held.get[0]} if held.exists else {}          # an unset number may come back as NaN
        chunks = list(pdfs)
        out = []
        for k, session, seq, recv, ltp, ltt, cp, conn in _rows((chunks[0] if len(chunks) == 1 else pd.concat(chunks)).sort_values("seq")):
            state, outcome = step(states.get(k, EMPTY), ltp, ltt, cp, conn, jump, confirm)
            states[k] = state
            out.append(_line(k, session, seq, recv, conn, state, outcome))
        held.update(([(k, *state) for k, state in states.items()],))
        if keep:
            end = (group[0] - EPOCH).days * 86_400_000 + 86_400_000 - 19_800_000                                   # the session's midnight, Indian time
            held.setTimeoutTimestamp(max(end, held.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    cols = [c.split()[0] for c in TICK.split(", ")]
    if keep:
        valid = valid.withColumn("_at", F.timestamp_millis("recv_ms")).withWatermark("_at", keep)
        cols = [*cols, "_at"]
    grouped = valid.select(*cols, F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_bucket")).groupBy("session_date", "_bucket")
    return grouped.applyInPandasWithState(fold, STEP, STATE, "append", GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, label: str, spark: SparkSession) -> DataFrame:
    """Drain what is available into a table in the shared folder (exactly once through its checkpoint) and read it back."""
    base = fresh_dir(spark, label)
    q = stream.writeStream.format("parquet").option("path", base + "/data").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/data")


def tick_latest(steps: DataFrame) -> DataFrame:
    """Last accepted tick per key and session, how many were accepted, and whether it traded on its session day (IST)."""
    a = latest_by(steps.where("outcome = 'accepted'"), ["key", "session_date"], F.col("seq"))
    ist = F.to_date(F.timestamp_millis(F.col("ltt") + 19_800_000))
    return a.select("key", "session_date", "seq", "ltp", "ltt", "cp", "n", F.when(F.col("ltt").isNotNull(), ist == F.col("session_date")).alias("traded_today"))


def window_latest(accepted: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """Latest accepted tick per key in each tumbling window; on a stream the watermark closes windows. Input carries `at` TIMESTAMP."""
    w = accepted.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "key")
    return w.agg(F.max_by("ltp", "seq").alias("ltp"), F.max_by("cp", "seq").alias("cp"), F.count(F.lit(1)).alias("ticks")).select(F.unix_millis("w.start").alias("start_ms"), "key", "ltp", "cp", "ticks")


def tick_coverage(accepted: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Keys that ticked on each connection against the keys subscribed, per kind."""
    c = accepted.groupBy("connection_id", "key").agg(F.count(F.lit(1)).alias("n")).join(subscribed.select("key", "kind"), "key")
    g = c.groupBy("connection_id", "kind").agg(F.count(F.lit(1)).alias("covered"))
    total = subscribed.groupBy("kind").agg(F.count(F.lit(1)).alias("subscribed"))
    return g.join(F.broadcast(total), "kind").withColumn("coverage", rnd(F.col("covered") / F.col("subscribed"), 4))      # one row per kind


def segment_status(messages: DataFrame) -> DataFrame:
    return messages.groupBy("segment").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
