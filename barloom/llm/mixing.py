"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target over its share of the documents. Each document draws its own number of copies by inverting the
Poisson distribution at a number that a hash of the seed and its id gives, so the draw is the same on every run, machine and partitioning. The copies are dealt
out by a hash of id and copy number, which is a global shuffle in one exchange."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import free_name
from barloom.session import fresh_dir

SEED = "mix-1"
SENT_NUMBERS = 1 << 20                 # the table of sources is sent to every task up to so many 8-byte numbers, and joined by shuffle beyond
OWN = ("copy", "copies", "mix_order")   # columns added to the documents'
TEMPERATURE = 0.5                      # a source of n documents weighs n ** TEMPERATURE where no weights are given


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, ... copies, up to where double precision sees no more."""
    if not rate > 0:
        return [1.0]
    k = np.arange(int(rate + 12 * math.sqrt(rate) + 40))
    log = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k.tolist()])
    return np.cumsum(np.exp(log)).tolist()


def _cdfs(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([poisson_cdf(r) for r in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["src", "rate", "cdf"])


def _hash(seed: str, digits: int, *parts):
    """The leading hexadecimal digits of an MD5 over the seed and the parts, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, digits), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """(src, rate): mean copies of a document of each source, null being a source. `weights` has (source, weight), shared out among the sources that occur; sources
    without a weight get no copies."""
    counts = docs.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("w"))
        weighed = counts.join(given, F.col("src").eqNullSafe(F.col("_s")), "left").select("src", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return weighed.crossJoin(total).select("src", (share * (F.col("all_n") if size is None else F.lit(float(size))) / F.col("n")).alias("rate"))     # total: one row


def mixed(docs: DataFrame, weights: DataFrame | None = None, size: float | None = None, seed: str = SEED) -> DataFrame:
    """Copies of the rows of `docs`, globally shuffled: all its columns, copy (from 1), copies (drawn for the document), mix_order.

    `size` is the expected number of rows (default: as many as there are). Rows that repeat an id draw alike. A null source is one more source, a null id one
    more id; texts are never looked at. Clashing columns named copy, copies or mix_order are replaced. An empty table gives no rows."""
    kept = [c for c in docs.columns if c.lower() not in OWN]
    src, cdf, drawn_at = (free_name(docs.columns, c) for c in ("src", "cdf", "_u"))
    table = rates(docs, weights, size).mapInArrow(_cdfs, "src string, rate double, cdf array<double>").select(F.col("src").alias(src), F.col("cdf").alias(cdf))
    path = fresh_dir(docs.sparkSession, "rates")
    table.write.parquet(path)
    table = docs.sparkSession.read.parquet(path)
    numbers = table.agg(F.coalesce(F.sum(F.size(cdf) + 8), F.lit(0))).first()[0]
    table = F.broadcast(table) if numbers <= SENT_NUMBERS else table
    uniform = _hash(seed, 13, F.col("doc_id")) / F.lit(float(1 << 52))
    drawn = docs.select(*kept).join(table, F.col("source").eqNullSafe(F.col(src))).withColumn(drawn_at, uniform)
    drawn = drawn.withColumn("copies", F.size(F.filter(cdf, lambda c: c <= F.col(drawn_at))).cast("bigint")).filter("copies > 0")
    dealt = drawn.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"), "copies")
    dealt = dealt.withColumn("mix_order", _hash(seed, 15, F.col("doc_id"), F.col("copy")))
    return dealt.repartition("mix_order").sortWithinPartitions("mix_order", "doc_id", "copy")


SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (SELECT source, pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
steps AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM shares, LATERAL (SELECT unnest(generate_series(0, CAST(floor(rate + 12 * sqrt(rate) + 39) AS BIGINT))) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
drawn AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, count(*) AS copies FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY d.doc_id)
SELECT d.*, x.copy, c.copies, ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || x.copy), 1, 15))::BIGINT AS mix_order
FROM documents d JOIN counted c USING (doc_id), LATERAL (SELECT unnest(generate_series(1, c.copies)) AS copy) x
"""
