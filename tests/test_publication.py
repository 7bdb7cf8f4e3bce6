"""Market documents, their output rules, and publication by one marker."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.plans import market_day as P
from barloom.sources import sinks as K


def _docs(spark, **changes):
    """Three symbols on a Friday, sound unless a document is replaced."""
    line = "list string, rank int, symbol string, change_pct double, volume bigint, turnover double, deliv double"
    rows = {
        "breadth": ([("2001-11-02", 3, "all", 2, 1, 0, 3, 2.0), ("2001-11-02", 3, "liquid", 1, 0, 0, 1, None)], "as_of string, universe int, scope string, advancing int, declining int, unchanged int, counted int, ad_ratio double"),
        "dma_breadth": ([(20, 1, 2, 50.0, "safe"), (50, 0, 0, None, "insufficient_history")], "period int, numerator int, denominator int, pct double, status string"),
        "movers": ([("gainers", 1, "A", 2.0, 5, 9.0, 50.0), ("gainers", 2, "B", 1.0, 5, 9.0, None), ("losers", 1, "C", -1.0, None, None, 0.0)], line),
        "activity": ([("by_value", 1, "C", None, 1, 9.0, None), ("by_value", 2, "A", None, 1, 8.0, None), ("by_volume", 1, "C", None, 1, 9.0, None)], line),
        "dma": ([("A", 20, 5.0, 20, "safe", "above"), ("B", 20, 5.0, 20, "safe", "below"), ("C", 20, None, 4, "insufficient_history", None)] + [(s, 50, None, 4, "insufficient_history", None) for s in "ABC"],
                "symbol string, period int, value double, observations int, state string, position string")}
    made = {n: spark.createDataFrame(changes.get(n, r), schema) for n, (r, schema) in rows.items()}
    return made | {"breadth": made["breadth"].withColumn("as_of", F.to_date("as_of"))}


def _faults(spark, **changes):
    return {(r.doc, r["at"], r.problem) for r in Q.market_documents(_docs(spark, **changes), "2001-11-04", P._best()).collect()}


def test_sound_documents_have_no_problem(spark):
    assert _faults(spark) == set()


def test_every_rule_of_breadth(spark):
    day = "2001-11-02"
    got = _faults(spark, breadth=[(day, 3, "all", 2, 1, 1, 3, 2.5), (day, 3, "liquid", 1, 0, 0, 1, 1.0)])
    assert got == {("breadth", "all", "counted_is_not_the_sum"), ("breadth", "all", "ratio_is_not_the_quotient"), ("breadth", "liquid", "ratio_without_decliners")}
    got = _faults(spark, breadth=[("2001-11-03", 3, "all", 4, 0, 0, 4, None), ("2001-11-05", 0, "liquid", -1, 0, None, None, None)])
    assert got == {("breadth", "all", "dated_on_a_weekend"), ("breadth", "all", "counts_exceed_universe"), ("breadth", "liquid", "dated_in_the_future"), ("breadth", "liquid", "counts_invalid"), ("breadth", "liquid", "no_universe"),
                   ("breadth", "liquid", "counted_is_not_the_sum"), ("breadth", None, "more_than_one_date"), ("breadth", None, "more_than_one_universe")}
    got = _faults(spark, breadth=[(None, 3, "all", 0, 0, 0, 0, None)])
    assert got == {("breadth", "all", "no_date"), ("breadth", None, "scope_missing")}


def test_every_rule_of_averages(spark):
    got = _faults(spark, dma_breadth=[(20, 2, 2, 50.0, "odd"), (50, 1, 0, 7.0, "safe"), (200, 0, 0, None, "safe")])
    assert got == {("dma_breadth", "20", "unknown_state"), ("dma_breadth", "20", "percentage_is_not_the_quotient"), ("dma_breadth", "20", "differs_from_the_symbols"), ("dma_breadth", "50", "counts_invalid"),
                   ("dma_breadth", "50", "percentage_without_denominator"), ("dma_breadth", "50", "differs_from_the_symbols")}
    got = _faults(spark, dma=[("A", 20, None, 20, "safe", "above"), ("B", 20, 5.0, 19, "safe", "below"), ("C", 20, 1.0, 4, None, None)] + [(s, 50, None, 4, "insufficient_history", None) for s in "AB"])
    assert got == {("dma", "A 20", "safe_without_value"), ("dma", "B 20", "safe_without_value"), ("dma", "C 20", "unknown_state"), ("dma", "C 20", "value_but_not_safe"), ("dma", "50", "symbols_are_not_the_universe")}


def test_every_rule_of_lists(spark):
    got = _faults(spark, movers=[("gainers", 1, "A", 1.0, -5, 9.0, 50.0), ("gainers", 2, "B", 2.0, 5, -9.0, 101.0), ("gainers", 4, "B", 0.0, 5, 9.0, None), ("losers", 1, None, 1.0, 5, 9.0, None)])
    assert got == {("movers", "gainers A", "negative_volume"), ("movers", "gainers B", "negative_turnover"), ("movers", "gainers B", "delivery_out_of_range"), ("movers", "gainers B", "not_in_order"), ("movers", "gainers B", "listed_twice"),
                   ("movers", "gainers B", "rank_not_position"), ("movers", "gainers B", "not_a_gainer"), ("movers", "losers", "no_symbol"), ("movers", "losers", "not_a_loser")}
    assert _faults(spark, activity=[("by_value", 1, "A", 1.0, 1, None, None)]) == {("activity", "by_value A", "not_in_order")}


def test_a_refused_version_is_never_seen(spark, tmp_path):
    base, day = str(tmp_path / "docs"), "2001-11-04"
    with pytest.raises(LookupError):
        K.read_published(spark, base, "dma")
    with pytest.raises(K.NotPublished):
        P.publish_documents(_docs(spark, activity=[("by_value", 2, "A", 1.0, 1, 1.0, None)]), base, day)
    assert K.published_version(spark, base) is None
    first = P.publish_documents(_docs(spark), base, day)
    older = [("2001-11-01", 2, "all", 2, 0, 0, 2, None), ("2001-11-01", 2, "liquid", 1, 0, 0, 1, None)]
    smaller = [r for r in [("A", 20, 5.0, 20, "safe", "above"), ("B", 20, 5.0, 20, "safe", "below"), ("A", 50, None, 4, "insufficient_history", None), ("B", 50, None, 4, "insufficient_history", None)]]
    with pytest.raises(K.NotPublished) as why:
        P.publish_documents(_docs(spark, breadth=older, dma=smaller), base, day)
    assert why.value.problems == ["breadth older_than_published 1", "breadth universe_shrunk 1"] and K.published_version(spark, base) == first
    assert K.read_published(spark, base, "dma").count() == 6
    assert P.publish_documents(_docs(spark), base, day) > first


def test_withdrawal_without_approval(spark, tmp_path):
    base, one = str(tmp_path / "site"), {"x": spark.createDataFrame([(1,)], "a int")}
    assert K.publish_gated(one, base, None) is None and K.published_version(spark, base) is None
    K.publish_gated(one, base, "true")
    with pytest.raises(K.NotPublished):
        K.publish_gated(one, base, "true", lambda new: ["bad"])
    assert K.read_published(spark, base, "x").count() == 1
    assert K.publish_gated(one, base, "TRUE") is None
    with pytest.raises(LookupError):
        K.read_published(spark, base, "x")
    K.publish_gated(one, base, "true")
    assert K.read_published(spark, base, "x").count() == 1


def test_disagreements_of_two_tables(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, n bigint, m bigint")
    got = Q.disagreements(make(("a", 1, 2), ("b", 3, 4), ("only", 1, 0), ("zero", 0, 0)), make(("a", 1, 2), ("b", 3, 5)), ["k"], ["n", "m"])
    assert {(r.k, r.n, r.m) for r in got.collect()} == {("b", 0, -1), ("only", 1, 0)}


def test_per_symbol_files_do_not_grow_with_symbols(spark, tmp_path):
    from barloom.sources import sinks as K
    path = str(tmp_path / "per")
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("S"), F.col("id") % 1500)).alias("symbol"), F.col("id").alias("v"))
    K.write_per_symbol(df, path, "x", buckets=4, rows_a_file=1000)
    files = spark.read.parquet(path + "/data/kind=x").select(F.input_file_name()).distinct().count()
    assert 4 <= files <= 4 + 3
    index = {r.symbol: (r.rows, r.bytes) for r in K.symbol_index(spark, path).collect()}
    assert index["HOT"][0] == 3000 and index[None][0] == 1 and sum(r for r, _ in index.values()) == 9000 and min(b for _, b in index.values()) > 0
    assert K.read_symbol(spark, path, "x", "HOT", 4).agg(F.sum("v")).first()[0] == sum(range(0, 9000, 3))
    assert [r.v for r in K.read_symbol(spark, path, "x", None, 4).collect()] == [1] and K.read_symbol(spark, path, "x", "none", 4).count() == 0
    K.write_per_symbol(df.limit(0), path, "empty", buckets=4)
    assert K.symbol_index(spark, path).where("kind = 'empty'").count() == 0
