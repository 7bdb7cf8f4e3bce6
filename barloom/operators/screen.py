"""Screener, search, comparison rows and page-level status rules over ratio tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.values import finite, query_normalise
from barloom.plans.order import running_position, top_rows

MULTIPLES = ("pe", "pb", "ev_ebitda")


def zero_multiple_is_null(df: DataFrame, multiples: Sequence[str] = MULTIPLES) -> DataFrame:
    """A multiple of exactly zero is missing; a zero return is real."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in multiples})


def roe_not_comparable() -> Column:
    return F.coalesce(F.col("pb") < 0, F.lit(False)) | F.coalesce((F.col("pe") < 0) & (F.col("roe") > 0), F.lit(False))


def _multiple(name: str, low: float | None, high: float | None, mode: str) -> Column:
    x = finite(F.col(name))
    if mode == "negative":
        return F.coalesce(x < 0, F.lit(False))
    if mode == "any" and low is None and high is None:
        return F.lit(True)
    ok = x > 0
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.coalesce(ok, F.lit(False))


def screen_filter(df: DataFrame, pe: tuple = (None, None), pe_mode: str = "any", pb: tuple = (None, None), pb_mode: str = "any", min_roe: float = 0, sector: str | None = None) -> DataFrame:
    """AND of the chosen filters. Ranges are inclusive and match positive multiples only; a range is ignored in negative mode. ROE rows that
    cannot be compared never pass a ROE filter."""
    for low, high in (pe, pb):
        if (low is not None and low < 0) or (high is not None and high < 0):
            raise ValueError("a bound is a number of 0 or more")
        if low is not None and high is not None and low > high:
            raise ValueError("the minimum is higher than the maximum")
    out = df.where(_multiple("pe", *pe, pe_mode)).where(_multiple("pb", *pb, pb_mode))
    if min_roe:
        out = out.where(F.coalesce(finite(F.col("roe")) >= min_roe, F.lit(False)) & ~roe_not_comparable())
    return out if sector is None else out.where(F.col("sector") == sector)


def screen_sort(df: DataFrame, by: str, descending: bool, tie: str = "symbol") -> DataFrame:
    """Sort position. Numbers: positive multiples first, then negative, then missing or zero; the direction only turns the values."""
    x = finite(F.col(by))
    if by in MULTIPLES:
        tier = F.when(x > 0, 0).when(x < 0, 1).otherwise(2)
    else:
        tier = F.when(x.isNotNull(), 0).otherwise(2)
    key = F.coalesce(F.when(F.lit(descending), -x).otherwise(x), F.lit(0.0))
    return running_position(df, [tier, F.when(tier == 2, F.lit(0.0)).otherwise(key), F.col(tie)], position="position")


def stalest_first(df: DataFrame, done: str, tie: str = "symbol") -> DataFrame:
    """Never done first, oldest next, ties by symbol."""
    return running_position(df, [F.coalesce(F.col(done).cast("string"), F.lit("")), F.col(tie)], position="position")


def search_symbols(df: DataFrame, query: str, rows: int = 50) -> DataFrame:
    """Eight-tier match of the normalised query on symbol and company name."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()]
    q = " ".join(words)
    s, n = query_normalise("symbol"), F.coalesce(query_normalise("company_name"), F.lit(""))
    tier = (F.when((s == q) | (F.replace(s, F.lit(" "), F.lit("")) == "".join(words)), 1).when(n == q, 2).when(s.startswith(q), 3).when(n.startswith(q), 4).when(F.instr(n, " " + q) > 0, 5)
            .when(F.instr(s, q) > 0, 6).when(F.instr(n, q) > 0, 7))
    if len(words) > 1 and all(len(w) > 1 for w in words):
        every = F.lit(True)
        for w in words:
            every = every & (F.instr(n, w) > 0)
        tier = F.coalesce(tier, F.when(every, 8))
    if not q:
        return df.select("symbol", F.lit(0).alias("tier"), F.lit(0).alias("rank")).limit(0)
    return top_rows(df.select("symbol", tier.alias("tier")).where("tier IS NOT NULL"), [F.asc("tier"), F.asc("symbol")], rows)


def column_coverage_gate(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """The column is published only when at least `share` of the rows hold a value."""
    g = df.agg((F.count(column) >= share * F.count(F.lit(1))).alias("_publish"))
    return df.crossJoin(F.broadcast(g)).withColumn(column, F.when(F.col("_publish"), F.col(column))).drop("_publish")     # one row


def section_status(listed: Column, updated: Column, error: Column, value: Column) -> Column:
    return (F.when(updated.isNotNull() & value.isNotNull(), F.concat(F.lit("last updated "), updated.cast("string"))).when(updated.isNotNull(), "not returned by the source")
            .when(~listed, "not in the source list").when(error.isNotNull(), "last request failed").otherwise("not yet fetched"))


def publish_rows_with_hold(now: DataFrame, before: DataFrame, holds: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sound rows as they are; a row on hold serves the values and date from before the batch."""
    j = now.join(holds.select("symbol", F.lit(True).alias("_hold")), "symbol", "left").join(before.select("symbol", *[F.col(v).alias("_b_" + v) for v in values]), "symbol", "left")
    held = F.coalesce("_hold", F.lit(False))
    return j.select("symbol", held.alias("held"), *[F.when(held, F.col("_b_" + v)).otherwise(F.col(v)).alias(v) for v in values])


def stock360(base: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One wide row per symbol from per-symbol frames; what a part does not hold stays NULL."""
    out = base
    for prefix, df in parts.items():
        out = out.join(df.select("symbol", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "symbol"]), "symbol", "left")
    return out


def checklist_status(value: Column, basis_mixed: Column, contradicts: Column, enough: Column) -> Column:
    return (F.when(finite(value).isNull(), "Unavailable").when(basis_mixed | contradicts, "Needs review").when(~enough, "Data insufficient").otherwise("Available"))
