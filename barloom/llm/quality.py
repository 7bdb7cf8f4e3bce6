"""Document quality: random Fourier features of document statistics, ridge regression from partition-summed normal equations, isotonic calibration.

Statistics come from whole texts in one pass and are stored (16 numbers a document). The kernel is Gaussian over standardised statistics; its random features make
it linear, so that sums of outer products over partitions are all that a fit needs. A fold of its own turns ridge scores into probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import U64, blocks, char_table, code_points, mix, span_hashes, spans, string_lists
from barloom.session import cut_lineage

STATS = 16
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 11
MAX_FIT = 50_000                       # labelled documents at most that a model is fitted on, those of least hash
BINS = 2048                            # of ridge scores between -0.5 and 1.5, for calibration
PARTS = 8
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES.update({"word": char_table(str.isalnum), "alpha": char_table(str.isalpha), "upper": char_table(str.isupper), "digit": char_table(str.isdigit), "space": char_table(str.isspace)})
    return _TABLES


def statistics(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text of a block; an empty text has zeros."""
    t, (codes, offsets) = _tables(), code_points(texts)
    n, out = len(texts), np.zeros((len(texts), STATS))
    chars = np.maximum(np.diff(offsets) - 1, 0)
    at = np.minimum(offsets, len(codes))

    def share(mask):
        return np.diff(np.append(0, np.cumsum(mask))[at]) / np.maximum(chars, 1)
    space, word, alpha = t["space"][codes], t["word"][codes], t["alpha"][codes]
    sign = ~space & ~word
    inner = np.ones(len(codes), bool)
    inner[at[1:-1] - 1] = False                                     # line feeds between texts are nobody's
    starts, ends = spans(~space)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    hashes = span_hashes(codes, starts, ends)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, bool)

    def distinct(h, owner):
        key = np.sort((h >> U64(24)) | (owner.astype(U64) << U64(40)))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return np.bincount((key >> U64(40)).astype(np.int64), minlength=n)
    pair = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    pairs = mix(hashes[:-1] + mix(hashes[1:]))[pair] if len(doc) else hashes
    ends_sign = sign[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, bool)
    two = np.append(False, sign[1:] & sign[:-1])
    upper_word = np.append(0, np.cumsum(t["upper"][codes]))
    lower_left = np.append(0, np.cumsum(alpha & ~t["upper"][codes]))
    shout = (upper_word[ends] - upper_word[starts] >= 2) & (lower_left[ends] == lower_left[starts])
    alone = (ends - starts == 1) & ends_sign
    out[:, 0] = np.log1p(chars)
    out[:, 1] = np.log1p(np.bincount(doc, minlength=n))
    out[:, 2] = np.bincount(doc, ends - starts, n) / words
    for i, mask in enumerate((alpha, t["upper"][codes], t["digit"][codes], sign, two, space & inner, (codes == 10) & inner), 3):
        out[:, i] = share(mask)
    out[:, 10] = distinct(hashes, doc) / words
    out[:, 11] = np.bincount(doc, same, n) / words
    out[:, 12] = (distinct(pairs, doc[1:][pair]) + 1) / words if len(doc) else 0
    out[:, 13] = np.bincount(doc, ends_sign, n) / words
    out[:, 14] = np.bincount(doc, shout, n) / words
    out[:, 15] = np.bincount(doc, alone, n) / words
    out[chars == 0] = 0
    return out


def _stats(batches):
    for batch, texts in string_lists(batches, "text"):
        for a, b in blocks(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(statistics(texts[a:b])), pa.list_(pa.float64()))], names=["doc_id", "stats"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray                  # probability of each bin of ridge scores

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        random = np.random.default_rng(SEED)
        turn, shift = random.normal(size=(STATS, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(z), 1))])

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(((self.features(stats) @ self.weights + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def _rows(batches):
    for batch in batches:
        if batch.num_rows:
            yield np.array(batch.column(0).to_numpy(zero_copy_only=False), dtype=float), np.stack(batch.column(1).to_numpy(zero_copy_only=False))


def _summed(frame: DataFrame, make, size: int) -> np.ndarray:
    """The sum over (y, stats) rows of make(y, stats), one partial sum a partition, PARTS at most."""
    def run(batches):
        total = np.zeros(size)
        for y, stats in _rows(batches):
            total += make(y, stats).ravel()
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})
    parts = frame.coalesce(PARTS).mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(p.total) for p in parts), np.zeros(size))


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins: the non-decreasing rates nearest to the bins'. Bins without rows take their left neighbour's, or the first."""
    pools: list[list[float]] = []                                   # positives, rows, last bin
    for i in np.flatnonzero(count).tolist():
        pools.append([positive[i], count[i], i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, c, last = pools.pop()
            pools[-1][0] += p
            pools[-1][1] += c
            pools[-1][2] = last
    out = np.full(len(count), pools[-1][0] / pools[-1][1])
    start = 0
    for p, c, last in pools:
        out[start:last + 1] = p / c
        start = last + 1
    return out


def learnable():
    """Rows that labels may be learned from; the others are held out. A null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model | None:
    """None without examples of both classes. Of the rows to learn from, every fourth by hash calibrates."""
    marks = labels.filter(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).filter("y = other")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).select("doc_id", F.col("y").cast("double").alias("y"))
    rows = cut_lineage(stats.join(F.broadcast(marks), "doc_id").select("y", "stats", (F.xxhash64("doc_id", F.lit(7)) % 4 == 0).alias("calibrates")), "quality")     # max_fit rows of 16 bytes
    first, second = (rows.filter(c).select("y", "stats") for c in ("not calibrates", "calibrates"))
    sums = _summed(first, lambda y, s: np.concatenate([[len(y), y.sum()], s.sum(axis=0), (s ** 2).sum(axis=0)]), 2 + 2 * STATS)
    if not 0 < sums[1] < sums[0]:
        return None
    mean = sums[2:2 + STATS] / sums[0]
    model = Model(mean, np.sqrt(np.maximum(sums[2 + STATS:] / sums[0] - mean ** 2, 1e-8)), np.zeros(FEATURES + 1), np.zeros(BINS))

    def normal(y, s):
        z = model.features(s)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])
    m = FEATURES + 1
    system = _summed(first, normal, m * (m + 1)).reshape(m, m + 1)
    model.weights = np.linalg.solve(system[:, :m] + RIDGE * sums[0] / FEATURES * np.eye(m), system[:, m])

    def histogram(y, s):
        b = model.bins(s)
        return np.concatenate([np.bincount(b, y, BINS), np.bincount(b, minlength=BINS)])
    counts = _summed(second, histogram, 2 * BINS)
    counts = counts if counts[BINS:].sum() >= 20 else counts + _summed(first, histogram, 2 * BINS)
    model.steps = isotonic(counts[:BINS], counts[BINS:])
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted, stats.

    Null and empty texts have zero statistics and the score of such a text. Rows that repeat an id are scored by their own text. Labels of unknown ids, null
    labels and ids labelled both ways are passed over; without examples of both classes every score is 0.5. An empty table gives no rows."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    stats = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_stats, "doc_id bigint, stats array<double>"), "stats")
    sent = spark.sparkContext.broadcast(fit(stats, labels))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.steps[sent.value.bins(s)] if sent.value else np.full(len(s), 0.5))], names=["doc_id", "stats", "score"])
    return stats.mapInArrow(run, "doc_id bigint, stats array<double>, score double").select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "stats")
