"""A keyed table that a stream can update: newest row per key, exactly once, one version visible at a time.

Rows lie in parts (a day, say). An update merges and rewrites only the parts its rows fall in, under its own version; then a manifest that names each part's version is
moved into place. Until then readers see the manifest before. An update that is repeated under the same number, as a stream does after a failure, starts from the
manifest before that number and writes the same again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import fresh_dir


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, base: str) -> list[int]:
    fs, where = _fs(spark, f"{base}/manifests")
    if not fs.exists(where):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(where))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _load(spark: SparkSession, base: str, number: int | None) -> dict[str, int]:
    if number is None:
        return {}
    fs, where = _fs(spark, f"{base}/manifests/{number:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _save(spark: SparkSession, base: str, number: int, parts: dict[str, int]) -> None:
    """Written beside, then moved: a reader finds the whole manifest or none."""
    fs, beside = _fs(spark, f"{base}/manifests/_{number:012d}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    _, place = _fs(spark, f"{base}/manifests/{number:012d}.json")
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"manifest {number} could not be moved into place")


def _read(spark: SparkSession, base: str, schema: T.StructType, part: str, parts: dict[str, int]) -> DataFrame:
    paths = [f"{base}/data/{v:012d}/_p={p}" for p, v in parts.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, base: str, schema: T.StructType, part: str) -> DataFrame:
    """The newest complete version; no rows before the first."""
    known = _manifests(spark, base)
    return _read(spark, base, schema, part, _load(spark, base, known[-1] if known else None))


def upsert(rows: DataFrame, base: str, keys: list[str], part: str, number: int, order: str | None = None) -> None:
    """Merge `rows` as update `number`. A row replaces the one of its key; with `order` only if its value is not smaller. Of rows of one key within the update the last by
    `order` counts (without it they must be one). Keys include the part; a null part is one of its own. The list of parts, not of keys, passes through the driver."""
    spark = rows.sparkSession
    before = [n for n in _manifests(spark, base) if n < number]
    parts = _load(spark, base, before[-1] if before else None)
    if part not in keys:
        raise ValueError("the part must be one of the keys")
    named = F.coalesce(F.col(part).cast("string"), F.lit("__null__"))
    touched = [r[0] for r in rows.select(named).distinct().collect()]                      # parts of one update
    old = _read(spark, base, rows.schema, part, {p: parts[p] for p in touched if p in parts})
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*([F.col(order)] if order else []), "_new")
    both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    placed = merged.select(*rows.columns, named.alias("_p")).hint("rebalance", "_p")       # large parts are split, small ones stay one file
    placed.write.mode("overwrite").partitionBy("_p").parquet(f"{base}/data/{number:012d}")
    _save(spark, base, number, parts | dict.fromkeys(touched, number))


def upsert_stream(stream: DataFrame, label: str, keys: list[str], part: str, order: str | None = None, base: str | None = None) -> DataFrame:
    """Drain what is available of a stream in update mode into a keyed table and read it; a batch that comes again after a failure changes nothing."""
    spark = stream.sparkSession
    base = base or fresh_dir(spark, label)
    query = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
             .foreachBatch(lambda rows, number: upsert(rows, base, keys, part, number, order)).start())
    query.awaitTermination()
    return read_keyed(spark, base, stream.schema, part)
