"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's logit is a bias plus the weights of its features (hashed words and word beginnings); one without a weighted feature has no part, so that length alone
condemns no text. A document's probability is the noisy-or of its sentences'
probabilities. The weights are learned from document labels alone by gradient steps whose gradients are summed per partition; only features that stand in clearly
more toxic documents than chance allows have a weight, so that rare words of toxic documents explain nothing. Afterwards the sentence probabilities say where the
offence stands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import U64, blocks, char_table, code_points, mix, span_hashes, spans, string_lists
from barloom.session import discard, fresh_dir

BITS = 18                              # weights: 2**BITS
BEGINNINGS = (4, 5, 6, 7)           # word beginnings of so many characters are features beside the word
LONGEST = 24                           # words; a longer sentence is cut into pieces, each an instance
MAX_FIT = 16_000                       # labelled documents at most that a model is fitted on, those of least hash
STEPS, RATE, BIAS = 50, 0.35, -5.0
PRIOR = 0.25                           # inverse variance of a weight, against summed gradients
EVIDENCE = 3.4                         # standard errors by which a feature's toxic documents must exceed the base rate to have a weight
PARTS = 6                              # partitions that gradients are summed over

_ENDS = ".!?\n;:"
_WORD: list[np.ndarray] = []


def _word_table() -> np.ndarray:
    if not _WORD:
        _WORD.append(char_table(str.isalnum))
    return _WORD[0]


def instances(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of a block of texts: feature numbers, each feature's instance; each instance's document, first and one-past-last character in its lower-cased text."""
    codes, offsets = code_points([t.lower() for t in texts])
    starts, ends = spans(_word_table()[codes])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    enders = np.cumsum(np.isin(codes, [ord(c) for c in _ENDS]))[starts]
    new = np.concatenate(([True], enders[1:] != enders[:-1]))
    first = np.flatnonzero(new)
    within = np.arange(len(starts)) - first[np.cumsum(new) - 1]
    instance = np.cumsum(new | (within % LONGEST == 0)) - 1
    features, owner = [span_hashes(codes, starts, ends)], [instance]
    for k in BEGINNINGS:
        long = ends - starts > k
        features.append(mix(span_hashes(codes, starts[long], starts[long] + k) + U64(k)))
        owner.append(instance[long])
    edge = np.concatenate(([True], instance[1:] != instance[:-1]))
    last = np.concatenate((edge[1:], [True]))
    doc = np.searchsorted(offsets, starts[edge], "right") - 1
    return (np.concatenate(features) >> U64(64 - BITS)).astype(np.int64), np.concatenate(owner), doc, starts[edge] - offsets[doc], ends[last] - offsets[doc]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    chosen: np.ndarray                     # features that have a weight

    def logits(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each instance; of one without a weighted feature minus infinity, a probability of 0."""
        z = np.bincount(owner, self.weights[features], n) + self.bias
        z[np.bincount(owner, self.chosen[features], n) == 0] = -np.inf
        return z


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A document's probability that at least one instance is toxic; 0 without instances."""
    return -np.expm1(-np.bincount(doc, _softplus(logits), n))


def _bags(batches):
    """Labelled documents as packed features."""
    for _, ys, texts in ((b, b.column(0).to_pylist(), t) for b, t in string_lists(batches, "text")):
        for a, b in blocks(texts):
            features, owner, doc, _, _ = instances(texts[a:b])
            order = np.argsort(owner, kind="stable")
            yield pa.RecordBatch.from_pydict({
                "y": pa.array([np.array(ys[a:b], dtype=np.int8).tobytes()], pa.binary()), "features": pa.array([features[order].astype(np.int32).tobytes()], pa.binary()),
                "lengths": pa.array([np.bincount(owner, minlength=len(doc)).astype(np.int32).tobytes()], pa.binary()), "doc": pa.array([doc.astype(np.int32).tobytes()], pa.binary())})


def _unpacked(r: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(r[k], t) for k, t in (("y", np.int8), ("features", np.int32), ("lengths", np.int32), ("doc", np.int32)))


def _presence(batches):
    """Partition sums: in how many documents of each class a feature stands, and the documents of each class."""
    seen, docs = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches:
        for y, features, lengths, doc in map(_unpacked, batch.to_pylist()):
            pair = np.sort(np.repeat(doc, lengths).astype(np.int64) << BITS | features)
            pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
            for c in (0, 1):
                seen[c] += np.bincount((pair & ((1 << BITS) - 1))[y[pair >> BITS] == c], minlength=1 << BITS)
                docs[c] += int((y == c).sum())
    yield pa.RecordBatch.from_pydict({"seen": pa.array([seen.astype(np.int32).tobytes()], pa.binary()), "docs": pa.array([docs.tobytes()], pa.binary())})


def _chosen(place):
    """The same bags with the features that have a weight, each under its place among them."""
    def run(batches):
        for batch in batches:
            for y, features, lengths, doc in map(_unpacked, batch.to_pylist()):
                at = place.value[features]
                good = at >= 0
                owner = np.repeat(np.arange(len(lengths)), lengths)[good]
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (
                    ("y", y), ("features", at[good]), ("lengths", np.bincount(owner, minlength=len(lengths)).astype(np.int32)), ("doc", doc))})
    return run


def _gradient(model):
    """Partition sums: the gradient of the log-likelihood over weights and bias, and the number of documents."""
    def run(batches):
        size = len(model.value.weights)
        total, bias, docs = np.zeros(size), 0.0, 0
        for batch in batches:
            for y, features, lengths, doc in map(_unpacked, batch.to_pylist()):
                owner = np.repeat(np.arange(len(lengths)), lengths)
                z = model.value.logits(features, owner, len(lengths))
                clean = np.bincount(doc, _softplus(z), len(y))
                pull = np.where(y == 1, np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-9), -1.0)
                push = pull[doc] * np.exp(-_softplus(-z))
                total += np.bincount(features, push[owner], size)
                bias += push.sum()
                docs += len(y)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias]), "docs": pa.array([docs], pa.int64())})
    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, max_fit: int = MAX_FIT) -> DataFrame:
    """(y, text) of at most `max_fit` labelled documents that may be learned from, those of least hash; ids with a null label or both labels do not count."""
    marks = labels.filter(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).filter("y = other")
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).select("doc_id", F.col("y").cast("int").alias("y"))
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("y", "text")     # max_fit rows of 12 bytes


def fit(examples: DataFrame, steps: int = STEPS) -> Model:
    """A model from (y, text) rows; without examples of both classes every sentence and text scores 0."""
    spark = examples.sparkSession
    packed = "y binary, features binary, lengths binary, doc binary"
    whole_at, bags_at = fresh_dir(spark, "bags"), fresh_dir(spark, "bags")
    examples.repartition(PARTS).mapInArrow(_bags, packed).write.parquet(whole_at)
    whole = spark.read.parquet(whole_at).coalesce(PARTS)
    counts = whole.mapInArrow(_presence, "seen binary, docs binary").collect()                           # one sum a partition, PARTS at most
    seen = sum((np.frombuffer(c.seen, np.int32).reshape(2, -1) for c in counts), np.zeros((2, 1 << BITS), dtype=np.int64))
    docs = sum((np.frombuffer(c.docs, np.int64) for c in counts), np.zeros(2, dtype=np.int64))
    if not docs.all():
        return Model(np.zeros(1 << BITS), BIAS, np.zeros(1 << BITS, dtype=bool))
    rate, both = docs[1] / docs.sum(), seen.sum(axis=0)
    keep = seen[1] - both * rate >= EVIDENCE * np.sqrt(both * rate * (1 - rate) + 1)
    chosen = np.flatnonzero(keep)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = spark.sparkContext.broadcast(place)
    spark.read.parquet(whole_at).mapInArrow(_chosen(sent), packed).write.parquet(bags_at)
    sent.destroy()
    bags = spark.read.parquet(bags_at).coalesce(PARTS)
    every = np.ones(len(chosen), dtype=bool)
    model = Model(np.zeros(len(chosen)), BIAS, every)                  # only features with a weight travel between the driver and the steps
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(model)
        parts = bags.mapInArrow(_gradient(sent), "total binary, bias double, docs bigint").collect()      # likewise
        gradient = np.append(sum(np.frombuffer(p.total, np.float32).astype(np.float64) for p in parts) - PRIOR * model.weights, sum(p.bias for p in parts)) / docs.sum()
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
        model = Model(model.weights + move[:-1], model.bias + move[-1], every)
        sent.destroy()
    discard(spark, whole_at)
    discard(spark, bags_at)
    weights = np.zeros(1 << BITS)
    weights[chosen] = model.weights
    return Model(weights, model.bias, keep)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs`' doc_id with score, n_sentences, and the worst instance's probability and place (characters of the lower-cased text); texts without words score 0."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sent = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.chosen))

    def run(batches):
        for batch, texts in string_lists(batches, "text"):
            ids = batch.column(0)
            for a, b in blocks(texts):
                features, owner, doc, start, end = instances(texts[a:b])
                z = sent.value.logits(features, owner, len(doc))
                order = np.lexsort((-z, doc))
                worst = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))] if len(doc) else order
                place = [None] * (b - a)
                for i in worst.tolist():
                    place[doc[i]] = {"probability": float(np.exp(-_softplus(-z[i]))), "start": int(start[i]), "end": int(end[i])}
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(noisy_or(z, doc, b - a)), pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)),
                    pa.array(place, pa.struct([("probability", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))], names=["doc_id", "score", "n_sentences", "worst"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, n_sentences bigint, worst struct<probability: double, start: bigint, end: bigint>")


def learnable(column: str = "doc_id"):
    """Rows that labels may be learned from; the others are held out. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 != 1, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted, n_sentences, worst (where the most toxic sentence stands).

    Null, empty and wordless texts score 0. Rows that repeat an id are scored by their own text. Labels of unknown ids, null labels and ids labelled both ways
    are passed over; without usable labels every text scores 0. Other columns are ignored; an empty table gives no rows."""
    model = fit(labelled(docs, labels, "toxic", learnable()))
    return score(docs, model).select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score below the threshold, unchanged; one more pass over the texts, no join.

    Null, empty and wordless texts stay, and so do all rows without labels of both classes. Rows that repeat an id are judged by their own text; a text of any length
    goes only for pieces with weighted features. All columns pass, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    model = fit(labelled(docs, labels, "toxic", learnable()))
    sent = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.chosen))
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            low = []
            for a, b in blocks(texts):
                features, owner, doc, _, _ = instances(texts[a:b])
                low.append(noisy_or(sent.value.logits(features, owner, len(doc)), doc, b - a) < threshold)
            if low:
                yield batch.filter(pa.array(np.concatenate(low)))
    return docs.mapInArrow(run, docs.schema)
