"""The distributed order, ranks, medians and digests against brute force; few and many parts give the same."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.operators.reference import group_hash
from barloom.operators.coverage import batch_partition, worklist_budget_cut
from barloom.plans import order as O


@pytest.fixture(scope="module")
def skewed():
    random.seed(3)
    return [(i, random.choice([7, 7, 7, random.randint(0, 50)]), random.choice(["hot", "hot", "a", "b"])) for i in range(2000)]


def test_running_position_and_totals(spark, skewed):
    df = spark.createDataFrame(skewed, "id int, v int, g string").repartition(6)
    got = {r.id: (r.position, r.total) for r in O.running_position(df, [F.col("v"), F.col("id")], totals={"total": F.col("v")}, buckets=5).collect()}
    run, want = 0, {}
    for p, (i, v, _) in enumerate(sorted(skewed, key=lambda r: (r[1], r[0])), 1):
        run += v
        want[i] = (p, run)
    assert got == want


def test_few_and_many_parts_agree(spark, skewed):
    df = spark.createDataFrame(skewed, "id int, v int, g string")
    key = [-F.col("v"), F.col("id")]
    a = {r.id: r.position for r in O.running_position(df, key, buckets=4).collect()}
    for parts in (2, 200):
        assert a == {r.id: r.position for r in O.running_position(df, key, buckets=parts).collect()}


def test_mid_rank_share_averages_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0), (5, None)], "id int, v double")
    assert {r.id: r.s for r in O.mid_rank_share(df, "v", "s").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}


def test_group_medians(spark, skewed):
    df = spark.createDataFrame([(g, float(v)) for _, v, g in skewed] + [("one", 4.0), ("two", 1.0), ("two", 2.0)], "g string, v double")
    groups = {}
    for g, v in [(g, float(v)) for _, v, g in skewed] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]:
        groups.setdefault(g, []).append(v)
    got = {r.g: r.median for r in O.group_medians(df, "g", "v").collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}


def tree(lines, leaf):
    level = [x + "\n" for x in sorted(lines)]
    for _ in range(2):
        level = [hashlib.sha256("".join(level[i:i + leaf]).encode()).hexdigest() + "\n" for i in range(0, len(level), leaf)]
    return hashlib.sha256("".join(level).encode()).hexdigest()


def test_group_hash_is_one_tree_at_every_size(spark, skewed):
    df = spark.createDataFrame([(g, f"line {v} {i}") for i, v, g in skewed] + [("dup", "x"), ("dup", "x")], "g string, line string")
    lines = {}
    for r in df.collect():
        lines.setdefault(r.g, []).append(r.line)
    for leaf in (10, 100, 1000):
        assert {r.g: r.hash for r in group_hash(df.repartition(7), "g", "line", leaf=leaf).collect()} == {g: tree(v, leaf) for g, v in lines.items()}


def test_budget_stops_at_the_first_item_that_does_not_fit(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9), ("d", 1)], "symbol string, cost int")
    assert [r.symbol for r in worklist_budget_cut(df, [F.col("symbol")], "cost", 8).orderBy("position").collect()] == ["a", "b"]


def test_batches_hash_their_own_order(spark):
    df = spark.createDataFrame([(f"S{i:03d}",) for i in range(7)], "symbol string")
    rows = batch_partition(df, [F.col("symbol")], size=3).orderBy("batch").collect()
    assert [r.symbols for r in rows] == [3, 3, 1] and rows[0].hash == hashlib.sha256(b"S000\nS001\nS002").hexdigest()


def test_ordered_lag_over_a_hot_part(spark, skewed):
    df = spark.createDataFrame(skewed, "id int, v int, g string")
    a = {r.id: r.p for r in O.ordered_lag(df, "g", "id", "v", "p", buckets=5).collect()}
    b = {r.id: r.p for r in O.ordered_lag(df, "g", "id", "v", "p").collect()}
    last, want = {}, {}
    for i, v, g in skewed:
        want[i] = last.get(g)
        last[g] = v
    assert a == b == want


def test_group_hash_splits_a_line_repeated_without_end(spark):
    df = spark.createDataFrame([("g", "same")] * 950 + [("g", "z")] * 3, "g string, line string")
    assert group_hash(df, "g", "line", leaf=400).first().hash == tree(["same"] * 950 + ["z"] * 3, 400)


def test_whole_volumes_do_not_overflow(spark):
    from barloom.operators.windows import roll_prev_mean
    bars = spark.range(1200).selectExpr("'I' as symbol", "date_add(date '2000-01-01', cast(id as int)) as date", "20000000000L as volume")
    assert roll_prev_mean(bars, "volume", 20, 20, "m").agg(F.max("m")).first()[0] == 2e10


def test_digest_sees_equal_rows_and_moved_values(spark):
    from barloom.sources.sinks import changed_keys
    frame = lambda *rows: spark.createDataFrame([("k", *r) for r in rows], "k string, a int, b int")
    for old, new in (([(1, 1), (1, 1)], [(2, 2), (2, 2)]), ([(1, None)], [(None, 1)])):
        assert changed_keys(frame(*old), frame(*new), "k").count() == 1
    assert changed_keys(frame((1, None), (2, 3)), frame((2, 3), (1, None)), "k").count() == 0


def test_null_fields_do_not_hide_a_conflict(spark):
    from barloom.operators.cleaning import OPTIONAL, REQUIRED, symbol_days
    fields = list(dict.fromkeys([*REQUIRED, *OPTIONAL, "SERIES", "SYMBOL", "DATE1"]))
    row = lambda **k: [{"SERIES": "EQ", "SYMBOL": "S", "DATE1": "01-Jan-2024", **k}.get(f) for f in fields]
    df = spark.createDataFrame([row(OPEN_PRICE="10"), row(LOW_PRICE="10")], ", ".join(f"{f} string" for f in fields))
    assert symbol_days(df).first().conflict
