"""Recursive indicators (each value needs the one before) over whole Arrow batches of many symbols.

A smoothing step y = q y + b is an affine map, and maps compose: after k doublings every row holds the composition of its last 2^k steps, so a batch takes as many
vector operations as its longest symbol has binary digits, and no loop over rows. Only the bands of supertrend, which are no such map, are walked. Rows of the last symbol
of a batch wait for the next batch; a symbol has one row per calendar day at most, however many trades it has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import asof_return
from barloom.operators.windows import back, by_symbol, micro, so_far


class Series:
    """Rows of several symbols in order: prices, each row's place in its symbol, and where symbols start."""

    def __init__(self, high, low, close, starts=(0,)):
        self.high, self.low, self.close = (np.asarray(x, dtype=float) for x in (high, low, close))
        self.starts = np.asarray(starts, dtype=np.int64)
        self.lengths = np.diff(np.append(self.starts, len(self.close)))
        self.place = np.arange(len(self.close)) - np.repeat(self.starts, self.lengths)

    def before(self, values: np.ndarray) -> np.ndarray:
        """Each row's previous value in its symbol; the first row's own."""
        return np.where(self.place > 0, np.append(values[:1], values[:-1]), values)

    def smoothed(self, values: np.ndarray, n: int, weight: float, skip: int = 0) -> np.ndarray:
        """Seed = plain mean of n values after `skip`; then prev + weight x (value - prev). NaN before the seed.

        What is composed is the gap to the value itself, which is nought on a level series, so that a level series stays exactly level."""
        values, seed = np.asarray(values, dtype=float), skip + n - 1
        seeds = self.starts[self.lengths > seed] + seed
        gap = (1 - weight) * (self.before(values) - values)
        gap[self.place <= seed] = 0.0
        if len(seeds):
            gap[seeds] = values[seeds[:, None] + np.arange(1 - n, 1)].mean(axis=1) - values[seeds]
        factor, step = 1 - weight, 1
        while len(seeds) and step < self.lengths.max() - seed:
            gap[step:] += np.where(self.place[step:] >= seed + step, factor * gap[:-step], 0.0)
            factor, step = factor * factor, 2 * step
        return np.where(self.place >= seed, values + gap, np.nan)

    def true_ranges(self) -> np.ndarray:
        prior = self.before(self.close)
        first = self.place == 0
        return np.where(first, self.high - self.low, np.maximum(self.high - self.low, np.maximum(np.abs(self.high - prior), np.abs(self.low - prior))))

    def ema(self) -> dict[str, np.ndarray]:
        return {"ema12": self.smoothed(self.close, 12, 2 / 13), "ema26": self.smoothed(self.close, 26, 2 / 27)}

    def macd(self) -> dict[str, np.ndarray]:
        e = self.ema()
        macd = e["ema12"] - e["ema26"]
        signal = self.smoothed(np.nan_to_num(macd), 9, 0.2, skip=25)
        return {"macd": macd, "signal": signal, "hist": macd - signal}

    def rsi(self, n: int = 14) -> dict[str, np.ndarray]:
        moves = self.close - self.before(self.close)
        up, down = self.smoothed(np.maximum(moves, 0), n, 1 / n, skip=1), self.smoothed(np.maximum(-moves, 0), n, 1 / n, skip=1)
        up, down = (np.where(np.abs(x) < 1e-300, 0.0, x) for x in (up, down))
        with np.errstate(divide="ignore", invalid="ignore"):
            level = np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down))
        return {"rsi14": np.where(np.isnan(up), np.nan, level)}

    def atr(self) -> dict[str, np.ndarray]:
        return {"atr14": self.smoothed(self.true_ranges(), 14, 1 / 14)}

    def supertrend(self, n: int = 10, multiple: float = 3.0) -> dict[str, np.ndarray]:
        """Line and direction: bands around the mid price that only tighten, flipped by a close beyond the opposite band."""
        span, mid = multiple * self.smoothed(self.true_ranges(), n, 1 / n), (self.high + self.low) / 2
        wide_up, wide_low, close = (mid + span).tolist(), (mid - span).tolist(), self.close.tolist()
        line, way = np.full(len(close), np.nan), np.full(len(close), np.nan)
        for start, length in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            upper = lower = up = None
            for i in range(start + n - 1, start + length):
                upper, lower = (wide_up[i], wide_low[i]) if upper is None else (
                    min(wide_up[i], upper) if close[i - 1] <= upper else wide_up[i], max(wide_low[i], lower) if close[i - 1] >= lower else wide_low[i])
                up = close[i] >= lower if up else close[i] > upper
                line[i], way[i] = (lower, 1.0) if up else (upper, -1.0)
        return {"supertrend": line, "direction": way}


FOLDS = {"ema": ("ema12", "ema26"), "macd": ("macd", "signal", "hist"), "rsi": ("rsi14",), "atr": ("atr14",), "supertrend": ("supertrend", "direction")}


def folded(bars: DataFrame, *which: str) -> DataFrame:
    """symbol, date, close and the columns of the named indicators (all of them by default) for every bar; only these are worked out."""
    which = which or tuple(FOLDS)
    names = [c for w in which for c in FOLDS[w]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            symbols = whole.column("symbol").to_numpy()
            cut = int(np.searchsorted(symbols, symbols[-1])) if len(symbols) else 0          # the last symbol may go on in the next batch
            rest = whole.slice(cut).combine_chunks().to_batches()[0] if len(symbols) > cut else None
            if cut:
                yield work(whole.slice(0, cut), symbols[:cut])
        if rest is not None:
            yield work(pa.Table.from_batches([rest]), rest.column(0).to_numpy())

    def work(rows: pa.Table, symbols: np.ndarray) -> pa.RecordBatch:
        series = Series(*(rows.column(c).to_numpy() for c in ("high", "low", "close")), np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])))
        out = {}
        for w in which:
            out |= getattr(series, w)()
        flat = lambda c: rows.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays([flat("symbol"), flat("date"), flat("close"), *[pa.array(out[n], mask=np.isnan(out[n])) for n in names]], names=["symbol", "date", "close", *names])

    placed = bars.select("symbol", "date", "high", "low", "close").repartition("symbol").sortWithinPartitions("symbol", "date")
    return placed.mapInArrow(fold, "symbol bigint, date date, close double, " + ", ".join(f"{c} double" for c in names))


def range_52w_strict(bars: DataFrame, days: int = 365) -> DataFrame:
    """Highest high and lowest low of the last calendar year, only when the history reaches back to its start."""
    w = Window.partitionBy("symbol")
    df = bars.select("symbol", "date", "high", "low", "close", F.max("date").over(w).alias("last"), F.min("date").over(w).alias("first"))
    inside = F.col("date") >= F.date_sub("last", days)
    g = df.groupBy("symbol").agg(F.max("last").alias("as_of"), F.min("first").alias("first"), F.max_by("close", "date").alias("close"), F.max(F.when(inside, F.col("high"))).alias("high"), F.min(F.when(inside, F.col("low"))).alias("low"))
    ok = F.col("first") <= F.date_sub("as_of", days)
    hi, lo = F.when(ok, F.col("high")), F.when(ok, F.col("low"))
    return g.select("symbol", hi.alias("high_52w"), lo.alias("low_52w"), ((F.col("close") / hi - 1) * 100).alias("from_high"), ((F.col("close") / lo - 1) * 100).alias("from_low"))


def vol_ratio_20(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over the mean of the previous n rows; NULL when one of them is missing or the mean is zero."""
    df = bars.withColumns({"_v": F.sum("volume").over(so_far()), "_c": F.count("volume").over(so_far()), "_rn": F.row_number().over(by_symbol())})
    total = back("_v", 1) - F.coalesce(back("_v", n + 1), F.lit(0))
    seen = back("_c", 1) - F.coalesce(back("_c", n + 1), F.lit(0))
    return df.withColumn("vol_ratio", F.when((seen == n) & (total > 0), F.col("volume") / (total / n))).drop("_v", "_c", "_rn")


def indicator_snapshot(bars: DataFrame) -> DataFrame:
    """One row per symbol: last close, 1D change, returns, 52-week range, distance to the averages, volume ratio and ATR share."""
    df = bars.withColumns({"_cum": F.sum(micro(F.col("close"))).over(so_far()), "_n": F.row_number().over(by_symbol()), "_prev": back("close", 1)})
    df = vol_ratio_20(df)
    for n in (20, 50, 200):
        mean = (F.col("_cum") - F.coalesce(back("_cum", n), F.lit(0))) / (n * 1_000_000)
        df = df.withColumn(f"to_dma_{n}", F.when(F.col("_n") >= n, (F.col("close") / mean - 1) * 100))
    row = F.struct("close", ((F.col("close") / F.col("_prev") - 1) * 100).alias("change_1d"), "vol_ratio", "to_dma_20", "to_dma_50", "to_dma_200")
    last = df.groupBy("symbol").agg(F.max_by(row, "date").alias("r")).select("symbol", "r.*")
    atr = folded(bars, "atr").groupBy("symbol").agg((F.max_by("atr14", "date") / F.max_by("close", "date") * 100).alias("atr_pct"))
    return last.join(asof_return(bars).drop("close"), "symbol").join(range_52w_strict(bars), "symbol").join(atr, "symbol")
