"""Writers. A version becomes visible only by a marker written after everything else, so a lost job leaves the old version in place."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class NotPublished(ValueError):
    """Nothing became visible; `problems` says why."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("not published: " + "; ".join(problems))
        self.problems = list(problems)


Check = Callable[[dict[str, DataFrame]], list[str]]
NoLoss = Callable[[dict[str, DataFrame], dict[str, DataFrame]], list[str]]
WITHDRAWN = "withdrawn"


def _mark(spark: SparkSession, base: str, version: str) -> str:
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{base}/published")
    return version


def _new_version(name: str | None = None) -> str:
    return f"{time.time_ns():020d}-{name or uuid.uuid4().hex[:8]}"


def published_version(spark: SparkSession, base: str) -> str | None:
    """The newest marked version; None before the first one and after a withdrawal."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/published")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    version = spark.read.schema("version string").parquet(f"{base}/published").agg(F.max("version")).first()[0]
    return None if version is None or version.endswith(WITHDRAWN) else version


def publish_together(frames: dict[str, DataFrame], base: str, check: Check | None = None, no_loss: NoLoss | None = None) -> str:
    """Write all result sets under a new version, judge what was written by itself and against the published version, then mark the version: all or
    nothing. A refused version is never marked, so readers keep the one before."""
    spark = next(iter(frames.values())).sparkSession
    version, before = _new_version(), published_version(spark, base)
    for name, df in frames.items():
        df.write.parquet(f"{base}/versions/{version}/{name}")
    stored = lambda v: {n: spark.read.schema(df.schema).parquet(f"{base}/versions/{v}/{n}") for n, df in frames.items()}
    problems = check(stored(version)) if check else []
    if no_loss and before:
        problems = problems + no_loss(stored(version), stored(before))
    if problems:
        raise NotPublished(problems)
    return _mark(spark, base, version)


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The named result set of the newest marked version."""
    version = published_version(spark, base)
    if version is None:
        raise LookupError(f"nothing is published under {base}")
    return spark.read.parquet(f"{base}/versions/{version}/{name}")


def publish_gated(frames: dict[str, DataFrame], base: str, approval: str | None, check: Check | None = None) -> str | None:
    """Publish only while the approval flag is exactly "true"; without it what was published is withdrawn (None is returned). With it a failed check
    raises and leaves the published version as it is."""
    spark = next(iter(frames.values())).sparkSession
    if approval == "true":
        return publish_together(frames, base, check)
    if published_version(spark, base):
        _mark(spark, base, _new_version(WITHDRAWN))
    return None


def _bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol.cast("string")), F.lit(buckets)).cast("int")


def write_per_symbol(df: DataFrame, path: str, kind: str, buckets: int = 64, rows_a_file: int = 1_000_000) -> None:
    """All rows of one kind in as many files as buckets, however many symbols there are; in a file rows lie by symbol, so that a reader of one symbol opens one
    bucket and skips its other row groups. A symbol of more than `rows_a_file` rows is spread over further files of its bucket. The index of
    symbols (bucket, rows, bytes of the rows as JSON) is written last. Rows without a symbol are a symbol of their own."""
    rows = df.select(*df.columns, _bucket(F.coalesce(F.col("symbol").cast("string"), F.lit("")), buckets).alias("bucket"))
    index = rows.groupBy("bucket", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes"))
    hot = index.where(F.col("rows") > rows_a_file).select(F.col("symbol").alias("_hot"), F.ceil(F.col("rows") / rows_a_file).alias("_files"))
    placed = rows.join(hot, F.col("symbol").eqNullSafe(F.col("_hot")), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_files")), F.lit(0)))
    placed = placed.repartition(buckets, "bucket", "_piece").sortWithinPartitions("bucket", "symbol").drop("_hot", "_files", "_piece")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/kind={kind}")
    index.write.mode("overwrite").parquet(f"{path}/index/kind={kind}")


def symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """kind, symbol, bucket, rows, bytes of everything stored, from the index alone."""
    return spark.read.parquet(f"{path}/index").select("kind", "symbol", "bucket", "rows", "bytes")


def read_symbol(spark: SparkSession, path: str, kind: str, symbol, buckets: int = 64) -> DataFrame:
    """The rows of one symbol: the partition filter leaves one bucket, the symbol filter reaches the row groups. `buckets` is the number they were written with."""
    here = _bucket(F.lit("" if symbol is None else str(symbol)), buckets)
    return spark.read.parquet(f"{path}/data/kind={kind}").where((F.col("bucket") == here) & F.col("symbol").eqNullSafe(F.lit(symbol))).drop("bucket")


def append_dedup(history: DataFrame, fresh: DataFrame, seq: str, keep: int | None = None) -> DataFrame:
    """History and new rows, exact repeats once (the earliest), all of them or the newest `keep` in order of arrival."""
    values = [c for c in history.columns if c != seq]
    once = history.unionByName(fresh).groupBy(*values).agg(F.min(seq).alias(seq))
    return once if keep is None else once.orderBy(F.desc(seq)).limit(keep)


def keyed_append(history: DataFrame, fresh: DataFrame, keys: Sequence[str], seq: str, keep: int | None = None) -> DataFrame:
    """Only rows whose key is unseen are added; all rows or the newest `keep` stay."""
    new = fresh.join(history.select(*keys), list(keys), "left_anti")
    both = history.unionByName(new.select(*history.columns))
    return both if keep is None else both.orderBy(F.desc(seq)).limit(keep)


def digest(df: DataFrame, key: str) -> DataFrame:
    """Order-free fingerprint of the rows of each key (combined before the exchange)."""
    rest = [c for c in df.columns if c != key]
    known = [x for c in rest for x in (F.isnull(c), F.col(c))]                       # a hash skips nulls, so that a value could move unseen
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *known).cast("decimal(38,0)"))    # equal rows must not cancel out
    return df.groupBy(key).agg(total(3).alias("h1"), total(17).alias("h2"), F.count(F.lit(1)).alias("rows"))


def changed_keys(saved: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that are new or whose rows differ from the saved copy; a key that is gone is not a change (nothing is deleted)."""
    a, b = digest(now, key), digest(saved, key).select(key, F.struct("h1", "h2", "rows").alias("_old"))
    return a.join(b, key, "left").where(~F.struct("h1", "h2", "rows").eqNullSafe(F.col("_old"))).select(key)


def install_delta(saved_path: str, now: DataFrame, key: str) -> DataFrame:
    """Export only the changed keys and install them by replacing just their partitions. Returns the changed keys."""
    spark = now.sparkSession
    saved = spark.read.schema(now.schema).parquet(saved_path)
    from barloom.session import cut_lineage
    changed = cut_lineage(changed_keys(saved, now, key), "changed")
    (now.join(changed, key, "left_semi").repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(saved_path))
    return changed


def trim_to(df: DataFrame, date: str, end: Column, days: int = 800) -> DataFrame:
    return df.where(F.col(date) >= F.date_sub(end, days))
