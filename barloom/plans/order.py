"""Global positions and running totals without a single-task window.

A frame is written once, range partitioned, with its partition number as a column. What follows reads that table, so every stage and every
recomputation after a lost executor sees the same parts; nothing but the parts' totals (one row each) is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def _ranged(df: DataFrame, keys: Sequence[Column], buckets: int | None) -> DataFrame:
    """`df` in the order of `keys` over `_bucket`, stored."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn("_bucket", F.spark_partition_id()), "ranged")


def running_position(df: DataFrame, keys: Sequence[Column], position: str | None = "position",
                     totals: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """Add the 1-based global position and inclusive running totals in the order of `keys` (all ascending, non-null and
    unique together; pre-aggregate ties first so that no bucket can grow with a hot value)."""
    totals = totals or {}
    placed = _ranged(df, keys, buckets)
    sums = [F.count(F.lit(1)).alias("_n")] + [F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()]
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)      # at most `buckets` rows
    offsets = placed.groupBy("_bucket").agg(*sums).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])
    inside = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_bucket")                                   # bounded: one row per bucket
    added = [(F.count(F.lit(1)).over(inside) + F.col("_before")).alias(position)] if position else []
    added += [(F.sum(c).over(inside) + F.col(f"_before_{n}")).alias(n) for n, c in totals.items()]
    return out.select(*df.columns, *added)


def ordered_lag(df: DataFrame, part: str, order: str, value: str, into: str, buckets: int | None = None) -> DataFrame:
    """The value of the previous row of the same `part` in `order`. A part with a third of all rows spreads over many buckets; only the last
    row of each bucket is handed to the next one."""
    keys = [F.col(part), F.col(order)]
    placed = _ranged(df, keys, buckets)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    tails = placed.groupBy("_bucket").agg(F.max_by(F.struct(F.col(part).alias("p"), F.col(value).alias("v")), key).alias("_tail"))
    tails = tails.select("_bucket", F.lag("_tail").over(Window.orderBy("_bucket")).alias("_tail"))               # at most `buckets` rows
    w = Window.partitionBy("_bucket").orderBy(*keys)
    before = F.coalesce(F.lag(F.struct(F.col(part).alias("p"), F.col(value).alias("v"))).over(w), F.col("_tail"))
    out = placed.join(F.broadcast(tails), "_bucket").withColumn("_before", before)                              # bounded: one row per bucket
    return out.select(*df.columns, F.when(F.col("_before.p") == F.col(part), F.col("_before.v")).alias(into))


def spread(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """`df` stored in the order of `keys` with its part as `_bucket`, for `running_values`. Rows alike in `keys` share a bucket; a run of other rows may cross buckets."""
    return _ranged(df, [F.col(k) for k in keys], buckets)


_RUN = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda mine, held: F.coalesce(mine, F.lit(0)) + F.coalesce(held, F.lit(0))),
        "last": (lambda c: F.last(c, True), F.coalesce)}


def running_values(placed: DataFrame, part: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """Add running values in `order` within each `part`, of the rows up to this one (`own`) or before it: name -> (max, min, sum or last non-null, column).
    `placed` comes from `spread` by `part` and the first of `order`. A part that fills many buckets is worked on in all of them; only the totals of a
    bucket's last part, one row a bucket, are handed on."""
    key = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(part)])
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    total = lambda kind, c: F.max_by(c, F.when(c.isNotNull(), at)) if kind == "last" else _RUN[kind][0](c)
    span = placed.groupBy("_bucket").agg(F.min(key).alias("_head"), F.max(key).alias("_part"))
    last = placed.join(F.broadcast(span), "_bucket").where(key.eqNullSafe(F.col("_part")))                                        # bounded: one row per bucket
    sums = last.groupBy("_bucket").agg(F.first("_head").alias("_head"), F.first("_part").alias("_part"), *[total(kind, c).alias(n) for n, (kind, c) in values.items()])
    ends = sums.select("_bucket", "_head", F.struct("_part", *values).alias("_tail"))
    none = F.lit(None)
    edge = F.explode(F.array(F.struct(F.lit(0).alias("_end"), F.struct(F.col("_head").alias("_part"), *[none.cast(sums.schema[n].dataType).alias(n) for n in values]).alias("_of")),
                             F.struct(F.lit(1).alias("_end"), F.col("_tail").alias("_of")))).alias("_e")
    edges = ends.select("_bucket", edge).select("_bucket", "_e._end", "_e._of.*")
    before = Window.partitionBy("_part").orderBy("_bucket", "_end").rowsBetween(Window.unboundedPreceding, -1)           # at most two rows a bucket
    held = edges.select("_bucket", "_end", F.col("_part").alias("_head"), *[_RUN[kind][0](F.col(n)).over(before).alias(f"_held_{n}") for n, (kind, _) in values.items()]).where("_end = 0").drop("_end")
    w = Window.partitionBy("_bucket", *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = placed.join(F.broadcast(held), "_bucket")                                                                      # bounded: one row per bucket
    mine = key.eqNullSafe(F.col("_head"))
    return out.select(*placed.columns, *[_RUN[kind][1](_RUN[kind][0](c).over(w), F.when(mine, F.col(f"_held_{n}"))).alias(n) for n, (kind, c) in values.items()])


def mid_rank_share(df: DataFrame, value: str, into: str) -> DataFrame:
    """Share rank in (0, 1] with average ranks for ties, over all rows of `df`."""
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_ties")), "ties")
    ranked = running_position(counts, [F.col(value)], position=None, totals={"_upto": F.col("_ties")})
    n = counts.agg(F.sum("_ties").alias("_all"))
    share = ((F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_all")).alias(into)
    held = df.where(F.col(value).isNotNull()).join(ranked, value).crossJoin(F.broadcast(n)).select(*df.columns, share)   # n: one row
    return held.unionByName(df.where(F.col(value).isNull()).withColumn(into, F.lit(None).cast("double")))                # nulls need no join


def group_medians(df: DataFrame, group: str, value: str, into: str = "median") -> DataFrame:
    """Exact median of `value` per `group`. Values are counted first, so repeats cost nothing; the middle is found by
    position in a distributed order, not in one group's memory."""
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")), "medians")
    placed = running_position(counts, [F.col(group), F.col(value)], position=None, totals={"_upto": F.col("_n")})
    span = placed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    j = placed.join(span, group).withColumns({"_lo": F.col("_upto") - F.col("_n") - F.col("_start") + 1, "_hi": F.col("_upto") - F.col("_start")})
    mid = lambda p: (F.col("_lo") <= p) & (p <= F.col("_hi"))
    p1, p2 = F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)
    return j.where(mid(p1) | mid(p2)).groupBy(group).agg((F.sum(F.when(mid(p1), F.col(value))) / 2 + F.sum(F.when(mid(p2), F.col(value))) / 2).alias(into))


def top_rows(df: DataFrame, order: Sequence[Column], rows: int, rank: str = "rank") -> DataFrame:
    """The first `rows` rows of an ordering with ranks 1..n: each task keeps its own best rows, so at most `rows` per task move."""
    best = df.orderBy(*order).limit(rows)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))             # at most `rows` rows


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key as one map-side-combined aggregate (no sort, no group held in memory)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
