"""Trading calendar: which session day stands behind a calendar day, and how many sessions lie between two days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """day, session_day (the last session on or before it), ordinal (sessions up to it) for every calendar day of `span` (one row: first, last) and the two weeks before
    it. `holidays` has `date`. A row a calendar day: a century is 36,525 rows, so the window is small and the table may be sent to all tasks."""
    days = span.select(F.explode(F.sequence(F.date_sub("first", 14), F.col("last"))).alias("day"))
    closed = holidays.select(F.col("date").alias("day"), F.lit(True).alias("_closed")).distinct()
    held = (F.weekday("day") < 5) & F.col("_closed").isNull()
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    j = days.join(closed, "day", "left")
    return j.select("day", F.last(F.when(held, F.col("day")), ignorenulls=True).over(upto).alias("session_day"), F.count_if(held).over(upto).alias("ordinal"))


def with_expected_day(df: DataFrame, now_ist: Column, calendar: DataFrame, into: str = "expected_day") -> DataFrame:
    """Add the session whose end-of-day file should exist: today's from 20:30 on, else the one before, moved off weekends and holidays. NULL outside the calendar."""
    day = F.when(F.hour(now_ist) * 60 + F.minute(now_ist) >= 1230, F.to_date(now_ist)).otherwise(F.date_sub(F.to_date(now_ist), 1))
    known = calendar.select(F.col("day").alias("_day"), F.col("session_day").alias(into))
    return df.withColumn("_asked", day).join(F.broadcast(known), F.col("_asked") == F.col("_day"), "left").drop("_asked", "_day")          # a row a calendar day


def sessions_between(df: DataFrame, first: str, last: str, calendar: DataFrame, into: str) -> DataFrame:
    """Add the number of sessions after `first` up to and including `last`."""
    at = lambda name, c: calendar.select(F.col("day").alias(name), F.col("ordinal").alias(c))
    j = df.join(F.broadcast(at("_a", "_na")), F.col(first) == F.col("_a"), "left").join(F.broadcast(at("_b", "_nb")), F.col(last) == F.col("_b"), "left")    # a row a calendar day
    return j.withColumn(into, F.col("_nb") - F.col("_na")).drop("_a", "_na", "_b", "_nb")


def date_windows(df: DataFrame, first: str, last: str, days: int = 360) -> DataFrame:
    """One row for each consecutive window of at most `days` days of [first, last]: the columns of `df`, window_start, window_end; an empty span gives none."""
    some = df.where(F.col(first) <= F.col(last))
    starts = some.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.datediff(last, first) / days).cast("int"))))
    start = F.date_add(first, F.col("_k") * days)
    return starts.select(*df.columns, start.alias("window_start"), F.least(F.date_add(start, days - 1), F.col(last)).alias("window_end"))
