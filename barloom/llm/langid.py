"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts become lower-case letters with one blank for anything between. Four-grams are counted per language over every document that may be learned from; lower
orders use continuation counts. For each four-gram seen anywhere the log-probability under every language is worked out once; arrays sorted by hash, with an
index on the leading bits, serve the tasks. The language of least cross-entropy per character wins; documents whose cross-entropy lies beyond nearly all of the
language's own are marked as not accepted.

Where the counts are too many for the driver, the same probabilities are worked out by joins on language and n-gram and stay in tables, and the documents' distinct
four-grams are joined with them. The order and the results are the same at every size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import U64, blocks, char_table, code_points, mix
from barloom.plans.order import running_position
from barloom.session import cut_lineage, fresh_dir

ORDER, DISCOUNT = 4, 0.75
HELD_AT_ONCE = 1 << 20                 # distinct four-grams a counting task holds before it hands them on
MAX_GRAMS = 8_000_000                  # (language, n-gram) counts that the driver takes; with more, probabilities stay in tables
CALIBRATION, ACCEPTED, LEAST_CHARS = None, 0.995, 20               # parts in which all learned documents are ordered for the limits; None: as the session's shuffles
ROUNDING = 1e-9                        # sums of the same terms in another order differ by less
EVIDENCE = 200                         # characters that a score may rest on
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(char_table(str.isalpha))
    return _LETTER[0]


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a block, 16 bits a character (others share numbers with their low bits), each one's text, and each text's letters."""
    codes, offsets = code_points([*(t.lower() for t in texts), ""])                # the last text ends in a blank too
    offsets = offsets[:-1]
    letter = letter_table()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][offsets[:-1] < len(codes)]] = True
    letters = np.diff(np.append(0, np.cumsum(letter))[np.minimum(offsets, len(codes))])
    doc = (np.searchsorted(offsets, np.flatnonzero(keep), "right") - 1).astype(np.int32)
    kept = np.where(letter[keep], codes[keep] & 0xFFFF, 32).astype(U64)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    kept, doc = np.insert(kept, first, U64(32)), np.insert(doc, first, doc[first])
    n = len(kept) - order + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int32), letters
    out = np.zeros(n, U64)
    for j in range(order):
        out = (out << U64(16)) | kept[j:j + n]
    same = (doc[:n] == doc[order - 1:]) & (letters[doc[:n]] > 0)
    return out[same], doc[:n][same], letters


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _count(order: int):
    def out(held):
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                for lang in sorted(set(langs[a:b])):
                    keys = np.sort(grams([t for t, g in zip(texts[a:b], langs[a:b], strict=True) if g == lang], order)[0])
                    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
                    old = held.get(lang, (np.zeros(0, U64), np.zeros(0, np.int64)))
                    held[lang] = _counted(np.concatenate([old[0], keys[edge]]), np.concatenate([old[1], np.diff(np.append(edge, len(keys)))]))
            if sum(len(k) for k, _ in held.values()) > HELD_AT_ONCE:
                yield from out(held)
                held = {}
        yield from out(held)
    return run


class Index:
    """Rows by 64-bit key: keys sorted by hash, and where each value of the leading hash bits begins."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys)
        self.order = np.argsort(h)
        self.hashes, self.bits = h[self.order], max(4, int(len(keys)).bit_length())
        self.begin = np.searchsorted(self.hashes, np.arange((1 << self.bits) + 1, dtype=U64) << U64(64 - self.bits)) if self.bits < 64 else None
        self.begin[-1] = len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in hash order, -1 where it is none."""
        h = mix(keys)
        lead = (h >> U64(64 - self.bits)).astype(np.int64)
        at, stop = self.begin[lead], self.begin[lead + 1]
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.hashes[at[open_]] == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out


@dataclass
class Tables:
    langs: list[str]
    logs: list[DataFrame]              # of orders 4, ..., 1: gram, and the log-probability under every language
    unseen: np.ndarray
    limits: np.ndarray


@dataclass
class Model:
    langs: list[str]
    order: int
    indexes: list[Index]               # of orders `order`, ..., 1
    tables: list[np.ndarray]           # log-probabilities, a row an n-gram and a column a language
    unseen: np.ndarray
    limits: np.ndarray

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the texts' letters."""
        keys, doc, letters = grams(texts, self.order)
        total, n = np.zeros((len(texts), len(self.langs))), np.bincount(doc, minlength=len(texts))
        if len(keys):
            logs = np.broadcast_to(self.unseen, (len(keys), len(self.langs))).astype(np.float32)
            left = np.arange(len(keys))
            for depth, (index, table) in enumerate(zip(self.indexes, self.tables, strict=True)):
                row = index.find(keys[left] & U64((1 << 16 * (self.order - depth)) - 1))
                logs[left[row >= 0]] = table[row[row >= 0]]
                left = left[row < 0]
                if not len(left):
                    break
            edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[edge]] = np.add.reduceat(logs, edge, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], letters


def _find(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return np.where(sorted_keys[at] == keys, values[at], 0) if len(sorted_keys) else np.zeros(len(keys))


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int, letters: int):
    """A function (order, n-grams) -> interpolated probabilities, from one language's counts of the highest order."""
    levels = {}
    for o in range(order, 0, -1):
        context, first = np.unique(keys >> U64(16), return_inverse=True)
        levels[o] = keys, counts, context, np.bincount(first, counts), np.bincount(first)
        tail = keys & U64((1 << 16 * (o - 1)) - 1)
        keys, counts = np.unique(tail, return_counts=True)

    def probability(o: int, grams_: np.ndarray) -> np.ndarray:
        if o == 0:
            return np.full(len(grams_), 1.0 / letters)
        keys, counts, context, total, types = levels[o]
        lower = probability(o - 1, grams_ & U64((1 << 16 * (o - 1)) - 1))
        t, k = _find(context, total, grams_ >> U64(16)), _find(context, types, grams_ >> U64(16))
        full = (np.maximum(_find(keys, counts, grams_) - DISCOUNT, 0) + DISCOUNT * k * lower) / np.maximum(t, 1e-300)
        return np.where(t > 0, full, lower)
    return probability


def build(counts: pd.DataFrame, order: int) -> Model | None:
    """The model from (lang, gram, n)."""
    langs = sorted(counts["lang"].unique())
    if not langs:
        return None
    every = [np.unique(counts["gram"].to_numpy().view(U64))]
    for o in range(order - 1, 0, -1):
        every.append(np.unique(every[-1] & U64((1 << 16 * o) - 1)))
    letters = len(every[-1]) + 1
    own = []
    for lang in langs:
        part = counts[counts["lang"] == lang]
        keys, sort = part["gram"].to_numpy().view(U64), np.argsort(part["gram"].to_numpy().view(U64))
        own.append(kneser_ney(keys[sort], part["n"].to_numpy()[sort].astype(np.float64), order, letters))
    indexes = [Index(k) for k in every]
    tables = [np.log(np.stack([p(order - d, k[i.order]) for p in own], axis=1)).astype(np.float32) for d, (k, i) in enumerate(zip(every, indexes, strict=True))]
    none = np.array([0xFFFF], dtype=U64)
    return Model(langs, order, indexes, tables, np.log(np.array([p(1, none)[0] for p in own])).astype(np.float32), np.full(len(langs), np.inf))


def _tail(gram, order: int):
    """The last `order` characters of an n-gram column."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1 if order < 4 else -1))


def build_tables(counts: DataFrame, langs: list[str], order: int) -> Tables:
    """The model of `build` from (lang, gram, n), as tables."""
    spark, own = counts.sparkSession, {order: counts}
    for o in range(order, 1, -1):
        own[o - 1] = cut_lineage(own[o].groupBy("lang", _tail("gram", o - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    names = spark.createDataFrame([(g,) for g in langs], "lang string")
    letters, logs, lower = own[1].select("gram").distinct().count() + 1, [], None
    for o in range(1, order + 1):
        context = own[o].groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        if o == 1:                                                                 # one context a language
            first = {r.lang: r for r in context.collect()}
        p = own[o].select("gram").distinct().crossJoin(F.broadcast(names)).join(own[o], ["lang", "gram"], "left").withColumn("context", F.shiftrightunsigned("gram", 16)).join(context, ["lang", "context"], "left")
        p = p.withColumn("lower", F.lit(1.0 / letters)) if o == 1 else p.withColumn("tail", _tail("gram", o - 1)).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        full = (F.greatest(F.coalesce("n", F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * F.col("types") * F.col("lower")) / F.col("total")
        lower = cut_lineage(p.select("lang", "gram", F.coalesce(full, "lower").alias("p")), "grams")
        row = F.array_sort(F.collect_list(F.struct("lang", F.log("p").cast("float").alias("log"))))                # one entry a language
        logs.append(cut_lineage(lower.groupBy("gram").agg(row.alias("row")).select("gram", F.col("row.log").alias("logs")), "grams"))
    unseen = np.log(np.array([DISCOUNT * first[g].types / letters / first[g].total for g in langs])).astype(np.float32)
    return Tables(langs, logs[::-1], unseen, np.full(len(langs), np.inf))


def learnable():
    """Rows that may be learned from; the others are held out. A null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))


def _learned(docs: DataFrame, order: int = ORDER) -> Model | Tables | None:
    """Probabilities from all documents with text and language that may be learned from, yet without limits; None without any such document."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    train = docs.filter(learnable() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    path = fresh_dir(spark, "grams")
    train.select("lang", "text").mapInArrow(_count(order), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).write.parquet(path)
    table = spark.read.parquet(path)
    if table.count() > MAX_GRAMS:
        return build_tables(table, sorted(r.lang for r in table.select("lang").distinct().collect()), order)
    return build(table.toPandas(), order)                                          # MAX_GRAMS rows at most


def _limits(scored: DataFrame, langs: list[str]) -> np.ndarray:
    """The cross-entropy that nearly all documents learned from, of some length and rightly named, keep to in each language. `scored` holds every one of them."""
    ties = scored.filter(f"lang = lang_pred and n_letters >= {LEAST_CHARS}").groupBy("lang_pred", "cross_entropy").agg(F.count("*").alias("n"))
    placed = running_position(ties, [F.col("lang_pred"), F.col("cross_entropy")], position=None, totals={"upto": F.col("n")}, buckets=CALIBRATION)
    span = placed.groupBy("lang_pred").agg(F.min(F.col("upto") - F.col("n")).alias("before"), F.sum("n").alias("of"))                       # one row a language
    own = placed.join(F.broadcast(span), "lang_pred").filter(F.col("upto") - F.col("before") >= F.ceil(F.lit(ACCEPTED) * F.col("of"))).groupBy("lang_pred").agg(F.min("cross_entropy").alias("c")).collect()
    return np.array([{r.lang_pred: r.c for r in own}.get(g, np.inf) for g in langs])


def fit(docs: DataFrame, order: int = ORDER) -> Model | Tables | None:
    """Counts and limits over all documents with text and language that may be learned from; None without any."""
    model = _learned(docs, order)
    if model is not None:
        model.limits = _limits(_scored(docs.filter(learnable() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), model, "lang"), model.langs)
    return model


RESULT = "lang_pred string, score double, cross_entropy double, n_letters bigint, accepted boolean"


def _verdicts(langs: list[str], limits: np.ndarray, entropy: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    """The columns of `RESULT` from each text's cross-entropy under every language, and its letters."""
    some, rows = letters > 0, np.arange(len(letters))
    arg = entropy.argmin(axis=1)
    best = entropy[rows, arg]
    weight = np.exp(-(entropy - best[:, None]) * np.minimum(letters, EVIDENCE)[:, None]).sum(axis=1)
    pred, accepted = [langs[i] if s else "und" for i, s in zip(arg, some, strict=True)], some & (best <= limits[arg] + ROUNDING)
    return [pa.array(pred, pa.string()), pa.array(np.where(some, 1 / weight, 0.0)), pa.array(np.where(some, best, np.nan), from_pandas=True), pa.array(letters.astype(np.int64)), pa.array(accepted, pa.bool_())]


def _scored(docs: DataFrame, model: Model | Tables | None, *more: str) -> DataFrame:
    kinds = dict(docs.dtypes)
    docs, out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more), f"doc_id bigint, {''.join(f'{c} {kinds[c]}, ' for c in more)}{RESULT}"
    names = [c.split()[0] for c in RESULT.split(", ")]
    if isinstance(model, Tables):
        return _joined(docs, model, out, names, *more)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts, columns = [t or "" for t in batch.column(1).to_pylist()], [batch.column(0), *batch.columns[2:]]
            for a, b in blocks(texts):
                m, k = sent.value, b - a
                entropy, letters = (np.zeros((k, 1)), np.zeros(k, np.int64)) if m is None else m.entropy(texts[a:b])
                found = _verdicts(["und"], np.zeros(1), entropy, letters) if m is None else _verdicts(m.langs, m.limits, entropy, letters)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, k) for c in columns], *found], names=["doc_id", *more, *names])
    return docs.mapInArrow(run, out)


def _text_grams(batches):
    """Each text's distinct four-grams with their counts, and its letters; a text without any has one row without a gram."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks(texts):
            keys, doc, letters = grams(texts[a:b])
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, int)
            bare = np.setdiff1d(np.arange(b - a), doc)
            of, n = np.append(doc[edge], bare).astype(np.int64), np.append(np.diff(np.append(edge, len(keys))), np.zeros(len(bare), int)).astype(np.int64)
            gram = pa.array(np.append(keys[edge], np.zeros(len(bare), U64)).view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + a)), gram, pa.array(n), pa.array(letters[of].astype(np.int64))], names=["k", "gram", "n", "letters"])


def _joined(docs: DataFrame, model: Tables, out: str, names: list[str], *more: str) -> DataFrame:
    """The same where the model is in tables: distinct four-grams find their row, each text's sums are taken once, and the verdicts go back by text."""
    key, langs, limits, size = F.unhex(F.sha2(F.col("text"), 256)), model.langs, model.limits, len(model.langs)
    texts = docs.select("text").filter("text is not null").select(key.alias("k"), "text").dropDuplicates(["k"])
    counts = cut_lineage(texts.mapInArrow(_text_grams, "k binary, gram bigint, n bigint, letters bigint"), "grams")
    rows = counts.filter("gram is not null").select("gram").distinct()
    for o, table in zip(range(ORDER, 0, -1), model.logs, strict=True):
        rows = rows.withColumn("_tail", _tail("gram", o)).join(table.select(F.col("gram").alias("_tail"), F.col("logs").alias(f"logs{o}")), "_tail", "left").drop("_tail")
    unseen = F.array(*[F.lit(float(x)).cast("float") for x in model.unseen])
    rows = rows.select("gram", F.coalesce(*[F.col(f"logs{o}") for o in range(ORDER, 0, -1)], unseen).alias("logs"))
    sums = [F.sum(F.col("n") * F.coalesce(F.col("logs")[i].cast("double"), F.lit(0.0))).alias(f"s{i}") for i in range(size)]     # a null only where n is 0
    totals = counts.join(rows, "gram", "left").groupBy("k").agg(*sums, F.sum("n").alias("n"), F.max("letters").alias("letters"))
    totals = totals.select("k", F.transform(F.array(*[f"s{i}" for i in range(size)]), lambda x: -x / F.greatest("n", F.lit(1))).alias("_entropy"), F.col("letters").alias("_letters"))

    def run(batches):
        for batch in batches:
            entropy = np.array([e or [0.0] * size for e in batch.column(0).to_pylist()], dtype=np.float64).reshape(-1, size)
            letters = np.array([n or 0 for n in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *_verdicts(langs, limits, entropy, letters)], names=["doc_id", *more, *names])
    return docs.withColumn("k", key).drop("text").join(totals, "k", "left").select("_entropy", "_letters", "doc_id", *more).mapInArrow(run, out)


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (0 to 1), cross_entropy (nats a character), n_letters, accepted.

    A null text or one without letters is `und` with score 0; so is every text if nothing could be learned. Ties go to the first language by name. Rows that
    repeat an id are judged by their own text. Other columns are ignored; an empty table gives no rows."""
    model, columns = _learned(docs), ["doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "cross_entropy", "n_letters"]
    if model is None:
        return _scored(docs, None).select(*columns, "accepted")
    scored = cut_lineage(_scored(docs.withColumn("_learn", learnable()), model, "lang", "_learn"), "languages")                      # each text is scored once, then judged by the limits
    limits = F.create_map(*[F.lit(x) for pair in zip(model.langs, (_limits(scored.filter("_learn"), model.langs) + ROUNDING).tolist(), strict=True) for x in pair])
    within = F.col("cross_entropy") <= F.try_element_at(limits, F.col("lang_pred"))
    return scored.select(*columns, (F.col("accepted") & F.coalesce(within, F.lit(False))).alias("accepted"))
