"""Instruments, reference lists, directory and their digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import ISIN, SYMBOL
from barloom.plans.order import running_position

# Statuses in order of precedence; the first two are the candidates for the directory.
CANDIDATES = ("eligible_eq", "eligible_be")
LEAF_LINES = 1_000
FUND_NAME = r"(?i)\b(ETF|BEES|FUND|MUTUAL|INDEX\s+FUND|LIQUID)\b"


def reference_lists(lists: DataFrame) -> DataFrame:
    """Long reference rows (list, isin, symbol, series) to one row per identifier: the lists it is on, its series codes (a few), and whether
    a list gives it any symbol. Which symbols those are stays in rows, see `instrument_status`."""
    series = F.array_sort(F.collect_set(F.when(F.col("list") == "EQL", F.col("series"))))
    return lists.where(F.col("isin").isNotNull()).groupBy("isin").agg(
        *[F.max(F.when(F.col("list") == n, True)).alias(f"in_{n}") for n in ("SME", "ETF", "EQL")], series.alias("series"),
        *[F.max(F.when((F.col("list") == n) & (F.col("symbol") != ""), True)).alias(f"named_{n}") for n in ("SME", "ETF", "EQL")])


def instrument_status(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Status by first match, its reason, memberships and flags. Input rows: instrument_key, trading_symbol, isin, security_type."""
    up = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    r = rows.withColumns({"isin_raw": up("isin"), "symbol": up("trading_symbol"), "sec": up("security_type"), "key": F.coalesce("instrument_key", F.lit(""))})
    r = r.withColumn("isin", F.when(F.col("isin_raw").rlike(ISIN), F.col("isin_raw")))
    ref = reference_lists(lists)
    by_symbol = lists.where(F.col("symbol") != "").groupBy("symbol").agg(*[F.max(F.when(F.col("list") == n, True)).alias(f"s_{n}") for n in ("SME", "ETF", "EQL")])
    pairs = lists.groupBy("isin", "symbol").agg(*[F.max(F.when(F.col("list") == n, True)).alias(f"pair_{n}") for n in ("SME", "ETF", "EQL")])
    j = r.join(ref, "isin", "left").join(by_symbol, "symbol", "left").join(pairs, ["isin", "symbol"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    eql_tag = F.when(F.size("series") > 0, F.concat(F.lit("EQL:"), F.array_join("series", "/"))).otherwise("EQL")
    member = F.array_sort(F.array_compact(F.array(F.when(yes("in_SME"), "SME"), F.when(yes("in_ETF"), "ETF"), F.when(yes("in_EQL"), eql_tag), F.when(F.col("sec") == "PCA", "PCA"))))
    multi = yes("in_SME").cast("int") + yes("in_ETF").cast("int") + yes("in_EQL").cast("int") > 1
    flags = [F.when(F.col("isin_raw") == "", "no_isin"), F.when((F.col("isin_raw") != "") & F.col("isin").isNull(), "malformed_isin"), F.when(F.col("symbol") == "", "no_symbol"), F.when(multi, "multi_reference")]
    for n in ("SME", "ETF", "EQL"):
        differs = yes(f"in_{n}") & (F.col("symbol") != "") & yes(f"named_{n}") & ~yes(f"pair_{n}")
        flags += [F.when(differs, f"symbol_differs_from_{n}_record"), F.when(yes(f"s_{n}") & ~yes(f"in_{n}"), f"symbol_only_match_{n}")]
    one = lambda s: F.coalesce((F.size("series") == 1) & (F.element_at("series", 1) == s), F.lit(False))
    status = (F.when(F.col("key") == "", "review_structural").when(yes("in_SME"), "excluded_sme").when(yes("in_ETF"), "excluded_etf").when(F.coalesce(F.size("series") > 1, F.lit(False)), "review_conflict")
              .when(F.col("sec") == "PCA", "review_pca").when(one("BZ"), "excluded_bz").when(one("BE"), "eligible_be").when(one("EQ"), "eligible_eq").when(yes("in_EQL"), "review_other_series")
              .otherwise("review_unmatched"))
    return j.select("row_id", "key", F.coalesce("isin", F.lit("")).alias("isin"), "symbol", "instrument_type", "sec", "name", status.alias("status"), F.array_join(member, "+").alias("memberships"),
                    F.array_sort(F.array_compact(F.array(*flags))).alias("flags"))


def flag_duplicates(classified: DataFrame) -> DataFrame:
    """All rows kept; those sharing a symbol, identifier or key are flagged. Groups are counted, then joined back."""
    out = classified
    for kind, c in (("symbol", "symbol"), ("isin", "isin"), ("instrument_key", "key")):
        dup = classified.where(F.col(c) != "").groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(c, F.lit(f"duplicate_{kind}").alias(f"_d_{kind}"))
        out = out.join(dup, c, "left")
    marks = F.array_compact(F.array(*[F.col(f"_d_{k}") for k in ("symbol", "isin", "instrument_key")]))
    return out.withColumn("flags", F.array_sort(F.array_distinct(F.concat("flags", marks)))).drop("_d_symbol", "_d_isin", "_d_instrument_key")


def duplicate_groups(classified: DataFrame) -> DataFrame:
    """Repeated symbols, identifiers and keys with their sizes, in one pass over the exploded claims."""
    claims = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("symbol", "symbol"), ("isin", "isin"), ("instrument_key", "key"))])
    return classified.select(F.inline(claims)).where("value <> ''").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def eligible_equities(rows: DataFrame) -> DataFrame:
    """Each exchange-segment row with the first reason it is left out (NULL = eligible); double claims trust neither claimant."""
    sym = F.upper(F.trim(F.coalesce("trading_symbol", F.lit(""))))
    isin = F.upper(F.trim("isin"))
    reason = (F.when(F.coalesce("instrument_key", F.lit("")) == "", "no_instrument_key").when(~F.col("instrument_type").eqNullSafe("EQ"), F.concat(F.lit("instrument_type:"), F.coalesce("instrument_type", F.lit("None"))))
              .when(sym == "", "no_trading_symbol").when(~sym.rlike(SYMBOL), "symbol_not_accepted").when(F.col("security_type") != "NORMAL", F.concat(F.lit("security_type:"), "security_type"))
              .when(~F.coalesce(isin.rlike(ISIN), F.lit(False)), "no_valid_isin"))
    r = rows.where("segment = 'NSE_EQ'").withColumns({"symbol": sym, "reason": reason})
    c = r.where("reason IS NULL")
    twice = lambda k: c.groupBy(k).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(k, F.lit(True).alias(f"_twice_{k}"))
    j = r.join(twice("symbol"), "symbol", "left").join(twice("instrument_key"), "instrument_key", "left")
    late = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_twice_symbol"), "duplicate_symbol").when(F.col("_twice_instrument_key"), "duplicate_instrument_key")
    fund = F.coalesce(F.col("name"), F.lit("")).rlike(FUND_NAME) | F.col("symbol").rlike(FUND_NAME)
    return j.select("row_id", "symbol", late.alias("reason"), F.when(late.isNull() & fund, "name_looks_like_fund_or_etf").alias("flag"))


def group_hash(df: DataFrame, group: str, line: str, leaf: int = LEAF_LINES) -> DataFrame:
    """A tree digest of each group's sorted lines, of one construction at every size: SHA-256 over each `leaf` lines, over each `leaf` such digests, and
    over all of those, every line and digest ending in LF. No task ever holds more than `leaf` lines, not even of one line repeated without end."""
    lines = df.groupBy(group, line).agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_position(lines, [F.col(group), F.col(line)], position=None, totals={"_upto": F.col("_copies")})
    start = placed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_copies")).alias("_start"), F.sum("_copies").alias("rows"))
    p = placed.join(start.select(group, "_start"), group).select(group, line, (F.col("_upto") - F.col("_copies") - F.col("_start")).alias("_a"), (F.col("_upto") - F.col("_start")).alias("_b"))
    p = p.withColumn("_leaf", F.explode(F.sequence(F.floor(F.col("_a") / leaf), F.floor((F.col("_b") - 1) / leaf))))
    here = (F.least(F.col("_b"), (F.col("_leaf") + 1) * leaf) - F.greatest(F.col("_a"), F.col("_leaf") * leaf)).cast("int")
    text = lambda at, t: F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), t.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n"))
    digest = lambda at, t: F.sha2(text(at, t), 256)
    leaves = p.groupBy(group, "_leaf").agg(digest(F.col("_a"), F.array_join(F.array_repeat(F.col(line), here), "\n")).alias("_h"))
    nodes = leaves.groupBy(group, F.floor(F.col("_leaf") / leaf).alias("_node")).agg(digest(F.col("_leaf"), F.col("_h")).alias("_n"))
    roots = nodes.groupBy(group).agg(digest(F.col("_node"), F.col("_n")).alias("hash"))
    return roots.join(start, group).select(group, "rows", "hash")


def baseline_compare(current: DataFrame, baseline: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """PASS, PASS* (equal only as the merged unmatched bucket) or FAIL per status. Inputs: status, rows, hash."""
    b = baseline.select("status", F.col("rows").alias("want_rows"), F.col("hash").alias("want_hash"))
    j = b.join(current, "status", "left")
    same = lambda n, h: F.coalesce((F.col(h) == F.col("want_hash")) & (F.col("want_rows").isNull() | (F.col("want_rows") == F.col(n))), F.lit(False))
    if merged is not None:
        j = j.join(merged.select("status", F.col("rows").alias("m_rows"), F.col("hash").alias("m_hash")), "status", "left")
    star = same("m_rows", "m_hash") if merged is not None else F.lit(False)
    return j.select("status", F.coalesce("rows", F.lit(0)).alias("rows"), "want_rows", F.when(same("rows", "hash"), "PASS").when(star, "PASS*").otherwise("FAIL").alias("verdict"))


def status_partition(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def overlap_counts(classified: DataFrame) -> DataFrame:
    return classified.where("memberships <> ''").groupBy("memberships", "status").agg(F.count(F.lit(1)).alias("rows"))


def unmatched_strata(classified: DataFrame, sample: int = 5) -> DataFrame:
    """Unmatched rows per stratum with a small deterministic sample (the rank limit runs before the exchange)."""
    u = classified.where(F.col("status").isin("review_unmatched", "review_other_series", "review_structural")).select(
        F.coalesce("instrument_type", F.lit("(none)")).alias("instrument_type"), F.when(F.col("sec") == "", "(none)").otherwise(F.col("sec")).alias("security_type"),
        F.when(F.col("isin") != "", "has_isin").otherwise("no_isin").alias("has_isin"), "row_id")
    keys = ["instrument_type", "security_type", "has_isin"]
    n = u.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys).orderBy("row_id")
    picked = u.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample)
    return picked.join(n, keys)


def field_profile(rows: DataFrame, fields: Sequence[str], eligible: Column, max_values: int | None = None) -> DataFrame:
    """(field, value) -> eligible and excluded rows of every value; with `max_values` a field that has more is one row, its value `(n values)`."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("(none)")).alias("value")) for f in fields])
    c = rows.select(eligible.alias("_e"), F.inline(cells)).groupBy("field", "value").agg(F.count_if("_e").alias("eligible"), F.count_if(~F.col("_e")).alias("excluded"))
    if max_values is None:
        return c
    sizes = c.groupBy("field").agg(F.count(F.lit(1)).alias("_v"))
    many = F.when(F.col("_v") > max_values, F.concat(F.lit("("), "_v", F.lit(" values)"))).otherwise(F.col("value"))
    return c.join(sizes, "field").groupBy("field", many.alias("value")).agg(F.sum("eligible").alias("eligible"), F.sum("excluded").alias("excluded"))


def directory_build(classified: DataFrame) -> DataFrame:
    """Candidates with the reasons they are held (none = published)."""
    c = flag_duplicates(classified).where(F.col("status").isin(*CANDIDATES))
    why = F.array_compact(F.array(F.when(F.size("flags") > 0, F.array_join("flags", ",")), F.when(~F.col("symbol").rlike(SYMBOL), "symbol_not_accepted"), F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no_name"),
                                  F.when(F.col("isin") == "", "no_isin")))
    return c.select("row_id", "symbol", "isin", F.trim("name").alias("name"), "status", F.array_join(why, ";").alias("held"), (F.size(why) == 0).alias("published"))


def directory_gate(directory: DataFrame, conflicts: int, min_published: int, max_held: int) -> DataFrame:
    c = directory.agg(F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("held"))
    problems = F.array_compact(F.array(F.when(F.col("published") == 0, "nothing_published"), F.when(F.col("published") < min_published, "below_minimum"), F.when(F.col("held") > max_held, "too_many_held"),
                                       F.when(F.lit(conflicts) > 0, "conflicts_not_acknowledged")))
    return c.withColumns({"problems": F.array_join(problems, ";"), "passed": F.size(problems) == 0})


def index_resolve(labels: DataFrame, instruments: DataFrame) -> DataFrame:
    """A label resolves only when exactly one distinct key carries it (smallest = largest key: no list of candidates is kept)."""
    g = instruments.groupBy("name").agg(F.min("key").alias("_a"), F.max("key").alias("_b"))
    j = labels.join(g, labels.label == g.name, "left")
    return j.select("label", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("key"), F.when(F.col("_a").isNull(), "none").when(F.col("_a") != F.col("_b"), "ambiguous").otherwise("resolved").alias("outcome"))
