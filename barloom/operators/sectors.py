"""Sector performance over rows already matched to the sector master."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import rnd
from barloom.operators.market import liquid
from barloom.plans.order import group_medians
from barloom.rules import Rules
from barloom.session import cut_lineage


def sector_performance(bucketed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Equal-weight figures per sector. Median and mean only where enough rows have a valid change."""
    m = cut_lineage(bucketed.where("bucket = 'in_sector'").select("sector_key", "sector_source_label", "change", "change_pct", "volume"), "sector-members")     # read twice below
    g = m.groupBy("sector_key").agg(
        F.min("sector_source_label").alias("label"), F.count(F.lit(1)).alias("member_count"), F.count("change").alias("counted"),
        F.count_if(F.col("change") > 0).alias("advances"), F.count_if(F.col("change") < 0).alias("declines"), F.count_if(F.col("change") == 0).alias("unchanged"),
        F.sum(F.rint(F.col("change_pct") * 100).cast("bigint")).alias("_cents"), F.count("change_pct").alias("_n"), F.sum("volume").alias("volume"), F.count("volume").alias("volume_count"))
    reason = (F.when(F.col("counted") < rules.min_sector_members, "too_few_valid").when(F.col("counted") / F.col("member_count") < rules.min_counted_share, "too_many_invalid"))
    med = group_medians(m, "sector_key", "change_pct", "_median")
    j = g.join(med, "sector_key", "left").withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return j.select("sector_key", "label", "member_count", "counted", "advances", "declines", "unchanged", rnd(F.try_divide("advances", "counted") * 100, 2).alias("breadth_pct"),
                    F.when(ok, rnd("_median", 2)).alias("median_1d_pct"), F.when(ok, rnd(F.try_divide(F.col("_cents"), F.col("_n")) / 100, 2)).alias("mean_1d_pct"),
                    "volume", "volume_count", ok.alias("eligible"), "reason")


def sector_availability(bucketed: DataFrame, sectors: DataFrame, today, rules: Rules = Rules()) -> DataFrame:
    """One row: coverage of non-fund rows, freshness of the labels, eligible sectors, and the first reason that makes it unavailable."""
    inside = F.col("bucket") == "in_sector"
    age = F.datediff(F.lit(today).cast("date"), "last_confirmed")
    c = bucketed.agg(F.count(F.lit(1)).alias("eq_rows"), F.count_if(F.col("bucket") == "etf").alias("etf"), F.count_if(inside).alias("in_sector"),
                     F.count_if(inside & age.between(0, rules.label_max_age)).alias("fresh"), F.count_if(F.col("bucket") != "not_in_master").alias("in_master"))
    j = c.crossJoin(F.broadcast(sectors.agg(F.count_if("eligible").alias("eligible_sectors"))))           # one row
    coverage, fresh = F.coalesce(F.try_divide("in_sector", F.col("eq_rows") - F.col("etf")), F.lit(0.0)), F.coalesce(F.try_divide("fresh", "in_sector"), F.lit(0.0))
    reason = (F.when(F.col("in_master") == 0, "master_empty").when(coverage < rules.min_coverage, "coverage_too_low").when(fresh < rules.min_fresh_share, "labels_stale")
              .when(F.col("eligible_sectors") < rules.min_eligible_sectors, "too_few_sectors"))
    return j.select("eq_rows", "etf", "in_sector", rnd(coverage, 4).alias("coverage"), rnd(fresh, 4).alias("fresh_share"), "eligible_sectors", reason.isNull().alias("available"), reason.alias("reason"))


def sector_leaders(sectors: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Leaders and laggards by median (ties by key)."""
    from barloom.operators.market import ranked
    e = sectors.where("eligible").select("sector_key", "median_1d_pct", "member_count")
    up = ranked(e, "leaders", [F.desc("median_1d_pct"), F.asc("sector_key")], rules.sector_rows)
    return up.unionByName(ranked(e, "laggards", [F.asc("median_1d_pct"), F.asc("sector_key")], rules.sector_rows))


def sector_listings(bucketed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Best and worst liquid listings per sector. The rank limit is applied before the exchange, so a hot sector moves a few rows per task."""
    m = bucketed.where((F.col("bucket") == "in_sector") & liquid(rules) & F.col("change_pct").isNotNull()).select("sector_key", "symbol", "close", "change_pct", "volume")
    top = lambda order: Window.partitionBy("sector_key").orderBy(*order)
    best = m.withColumn("rank", F.row_number().over(top([F.desc("change_pct"), F.asc("symbol")]))).where(F.col("rank") <= rules.sector_rows).withColumn("list", F.lit("top"))
    worst = m.withColumn("rank", F.row_number().over(top([F.asc("change_pct"), F.asc("symbol")]))).where(F.col("rank") <= rules.sector_rows).withColumn("list", F.lit("bottom"))
    return best.unionByName(worst)
