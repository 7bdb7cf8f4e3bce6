"""Small value rules: rounding, number and date text, identifiers. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column | str, digits: int = 0) -> Column:
    """Round half to even on the scaled double; stays inside generated code (the built-in goes through decimals)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rint(x) if digits == 0 else F.rint(x * F.lit(float(10 ** digits))) / F.lit(float(10 ** digits))


# Identifier patterns and words.
ISIN = r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
SYMBOL = r"^(?=.*[A-Z0-9])[A-Z0-9&\-_.]{1,30}$"
FINANCIAL_WORDS = ("financ", "bank", "insur", "nbfc", "invest", "brok", "asset manag", "wealth", "capital market")
CAPEX_EXCLUDES = ("sale", "disposal", "proceeds", "investment")
CAPEX_TOTALS = ("capital expenditure", "capital expenditures", "capex", "purchase of fixed assets", "purchase of property plant and equipment and intangible assets",
                "purchase of property plant and equipment and intangibles")
CAPEX_ASSETS = ("property plant", "ppe", "intangible", "capital work", "cwip", "fixed assets", "capital expenditure", "capex")
CAPEX_VERBS = ("purchase", "acquisition", "payment", "addition")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def num_parse(text: Column | str, digits: int | None = None) -> Column:
    """Text to a finite double. Thousands marks and percent signs are stripped; letters that only occur in words ("NaN", "Infinity", "NA") and type
    suffixes make it unreadable, so every no-number mark becomes NULL."""
    text = F.col(text) if isinstance(text, str) else text
    x = F.trim(F.translate(text, "NnIidDfF,%", "????????")).try_cast("double")
    x = F.when(F.abs(x) < F.lit(float("inf")), x)
    return x if digits is None else rnd(x, digits)


def date_parse(text: Column | str) -> Column:
    """dd-Mon-yyyy in any letter case to a date, else NULL."""
    return F.try_to_date(F.trim(F.col(text) if isinstance(text, str) else text), "dd-MMM-yyyy")


def stamp_parse(text: Column | str) -> Column:
    """dd-MON-yyyy HH:MM:SS to a timestamp; a bare date counts as midnight."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("dd-MMM-yyyy HH:mm:ss")), date_parse(t).cast("timestamp"))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def period_parse(text: Column | str) -> Column:
    """'Mar 2026' to the last day of that month, else NULL (year and month follow from it)."""
    t = F.initcap(F.trim(F.col(text) if isinstance(text, str) else text))
    ok = t.rlike(r"^[A-Z][a-z]+\s+[12]\d{3}$")
    return F.when(ok, F.last_day(F.try_to_date(F.concat(F.substring(t, 1, 3), F.lit(" "), F.substring_index(t, " ", -1)), "MMM yyyy")))


def symbol_norm(text: Column | str) -> Column:
    s = F.upper(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.when(s.rlike(SYMBOL), s)


def isin_norm(text: Column | str) -> Column:
    s = F.upper(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.when(s.rlike(ISIN), s)


def label_normalise(text: Column | str) -> Column:
    """Lower case, no punctuation, single spaces."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9& ]", " "), r"\s+", " "))


def query_normalise(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "))


def slug(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(""))


def layout_class(sector: Column | str) -> Column:
    t = F.lower(F.trim(F.col(sector) if isinstance(sector, str) else sector))
    return F.when(t.isNull() | (t == ""), "unclassified").when(t.rlike("|".join(FINANCIAL_WORDS)), "financial").otherwise("standard")


def capex_line_class(label: Column | str) -> Column:
    t = F.regexp_replace(label_normalise(label), " & ", " and ")
    asset = t.rlike("|".join(CAPEX_ASSETS))
    return (F.when(t.rlike("|".join(CAPEX_EXCLUDES)), None).when(t.isin(*CAPEX_TOTALS), "total")
            .when(asset & (t.rlike("^(" + "|".join(CAPEX_VERBS) + ")") | t.rlike("capital work|cwip")), "partial"))


def axis_key(axis: Column | str) -> Column:
    """Holder axis name without its namespace, the details prefix and the axis suffix."""
    t = F.col(axis) if isinstance(axis, str) else axis
    k = F.regexp_replace(F.lower(F.regexp_replace(t, "^.*:", "")), "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(k, "axis$", ""), "^(detailsofsharesheldby|detailsofthe|detailsof)", "")


def backoff_days(failures: Column, cap: int = 30) -> Column:
    """1, 2, 4, 8, 16, then the cap."""
    return F.least(F.lit(cap), F.pow(F.lit(2), F.greatest(failures, F.lit(1)) - 1)).cast("int")


def weekdays_between(first: Column, last: Column) -> Column:
    """Weekdays after `first` up to and including `last`, by arithmetic (no day list)."""
    upto = lambda day: F.floor((F.unix_date(day) + 3) / 7) * 5 + F.least((F.unix_date(day) + 3) % 7, F.lit(4))
    return F.greatest(F.lit(0), upto(last) - upto(first)).cast("int")


def session_status(ist: Column, holiday: Column, feed: Column) -> Column:
    """open / pre_open / closed from the local time, the holiday flag and, when given, the feed's own status."""
    minute = F.hour(ist) * 60 + F.minute(ist)
    return (F.when(holiday | (F.weekday(ist) >= 5), "closed").when(feed == "NORMAL_OPEN", "open")
            .when(feed.isin("PRE_OPEN_START", "PRE_OPEN_END"), "pre_open").when(feed.isin("NORMAL_CLOSE", "CLOSING_START", "CLOSING_END"), "closed")
            .when((minute >= 555) & (minute < 930), "open").when((minute >= 540) & (minute < 555), "pre_open").otherwise("closed"))
