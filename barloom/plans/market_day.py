"""The end-of-day job: bars -> one exchange by symbol -> every series metric -> newest row per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import market as M
from barloom.operators import quality as Q
from barloom.operators import windows as W
from barloom.rules import Rules
from barloom.session import cut_lineage
from barloom.sources.sinks import publish_together


def measured(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All guarded metrics on every bar, sharing one window specification."""
    df = W.with_series(W.change_1d(bars), rules)
    for n in (20, 50, 200):
        df = W.sma_guarded(df, n, rules)
    return W.volume_multiple(W.high_low_52w(df, rules), rules)


def newest_measured(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return M.latest_rows(measured(bars, rules))


def scanned(bars: DataFrame) -> DataFrame:
    """Technical-scan columns on every bar."""
    return W.scan_columns(bars)


def scan_day(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The scan rows of the newest day per symbol, stored once: every list and rating then starts from this small table."""
    return cut_lineage(M.scan_frame(cut_lineage(M.latest_rows(scanned(bars)).where(M.liquid(rules)), "scan"), rules), "rated")


def _best() -> dict[str, Column]:
    """Each ranked list's key, the largest first."""
    return {"gainers": F.col("change_pct"), "losers": -F.col("change_pct"), "by_value": F.col("turnover"), "by_volume": F.col("volume")}


def documents(latest: DataFrame, rules: Rules = Rules()) -> dict[str, DataFrame]:
    """The market documents of one day from the newest measured row of every symbol (stored by the caller: five frames read it)."""
    return {"breadth": M.breadth_document(latest, rules), "dma_breadth": M.dma_breadth(latest), "movers": M.top_movers(latest, rules),
            "activity": M.most_active(latest, rules), "dma": M.dma_document(latest)}


def publish_documents(docs: dict[str, DataFrame], base: str, today: str, most_lost: float = 0.1) -> str:
    """Stage the documents, judge the staged rows by the output rules and against what is published, and switch to them; else `sinks.NotPublished`."""
    return publish_together(docs, base, lambda new: Q.reasons(Q.market_documents(new, today, _best())),
                            lambda new, old: Q.reasons(Q.market_no_loss(new["breadth"], old["breadth"], most_lost)))
