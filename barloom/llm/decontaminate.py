"""Benchmark decontamination by greedy string tiling: shared-word seeds find the pairs, running Karp-Rabin marks the longest matches first.

Words are runs of letters and digits, lower-cased. A seed is `MIN_MATCH` consecutive words. For a document and a test item with a common seed, tiles are found
longest first and never overlap, in whatever order the passages stand; the item is contained when tiles cover `COVERAGE` of its words.

Where the benchmark is small (its words are counted) it goes to every task and one pass over the documents does all. Beyond that, seeds are joined by shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import blocks, char_table, code_points, free_name, shingles, span_hashes, spans, U64

MIN_MATCH, COVERAGE = 5, 0.5
SENT_WORDS = 1_000_000                 # a benchmark of no more words (about 20 bytes each) is sent to every task
MATCH = "array<struct<item_id: bigint, coverage: double, matched_words: bigint, n_tiles: bigint, longest: bigint>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))
_WORD: list[np.ndarray] = []


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block of texts, and each text's first word (one more at the end)."""
    if not _WORD:
        _WORD.append(char_table(str.isalnum))
    codes, offsets = code_points([t.lower() for t in texts])
    starts, ends = spans(_WORD[0][codes])
    return span_hashes(codes, starts, ends), np.searchsorted(starts, offsets)


def _longest(item, text, at: int, where: np.ndarray, free_item, free_text, length: int) -> tuple[int, int]:
    """The longest free match of the item from `at` among text places, and the first such place."""
    for step in range(length):                                                     # the hash is checked word by word
        where = where[text[where + step] == item[at + step]]
    if not len(where):
        return 0, -1
    while at + length < len(item) and free_item[at + length]:
        on = where[where + length < len(text)]
        on = on[(text[on + length] == item[at + length]) & free_text[on + length]]
        if not len(on):
            break
        where, length = on, length + 1
    return length, int(where[0])


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of each tile, by running Karp-Rabin over ever shorter search lengths."""
    free_item, free_text, out = np.ones(len(item), bool), np.ones(len(text), bool), []
    length = max(least, min(len(item), len(text)))
    while length >= least:
        marked = False
        hi, ht = shingles(item, length), shingles(text, length)
        open_item = np.convolve(free_item, np.ones(length, int), "valid") == length if len(hi) else np.zeros(0, bool)
        open_text = np.concatenate(([0], np.cumsum(free_text)))
        open_text = open_text[length:] - open_text[:-length] == length if len(ht) else np.zeros(0, bool)
        spots = np.flatnonzero(open_text)
        spots = spots[np.isin(ht[spots], hi[open_item])]
        found = []
        for at in np.flatnonzero(open_item).tolist() if len(spots) else ():
            n, where = _longest(item, text, at, spots[ht[spots] == hi[at]], free_item, free_text, length)
            if n:
                found.append((n, at, where))
        for n, at, where in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[at:at + n].all() and free_text[where:where + n].all():
                free_item[at:at + n] = free_text[where:where + n] = False
                out.append((at, where, n))
                marked = True
        if not marked:
            length = length // 2 if length >= 2 * least else (least if length > least else 0)
    return out


class Bench:
    """Items as word hashes, and their seeds in order of hash."""

    def __init__(self, ids: list[int], words: list[np.ndarray], least: int):
        self.ids, self.words, self.least = ids, words, least
        seeds = [shingles(w, least) for w in words]
        seed, owner = np.concatenate([*seeds, np.zeros(0, U64)]), np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[order], owner[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seed >> U64(42)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, coverage: float, seeds: np.ndarray | None = None) -> list[dict]:
        """Items that the text contains. The words under shared seeds bound what tiles can cover, so most pairs need no tiling."""
        seeds = shingles(words, self.least) if seeds is None else seeds
        seeds = seeds[self.maybe[(seeds >> U64(42)).astype(np.int64)]]
        if not len(seeds):
            return []
        seeds = np.unique(seeds)
        lo, hi = np.searchsorted(self.seed, seeds, "left"), np.searchsorted(self.seed, seeds, "right")
        at = np.concatenate([*[np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)], np.zeros(0, int)]).astype(np.int64)
        out = []
        for o in np.unique(self.owner[at]).tolist():
            item = self.words[o]
            under = np.zeros(len(item) + 1, int)
            place = self.place[at[self.owner[at] == o]]
            np.add.at(under, place, 1)
            np.add.at(under, place + self.least, -1)
            if (np.cumsum(under)[:-1] > 0).sum() < coverage * len(item):
                continue
            found = tiles(item, words, self.least)
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(item):
                out.append({"item_id": self.ids[o], "coverage": covered / len(item), "matched_words": covered, "n_tiles": len(found), "longest": max(n for _, _, n in found)})
        return sorted(out, key=lambda m: (-m["coverage"], m["item_id"]))


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per item with a text; of rows that repeat an id each counts."""
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()


def _word_counts(batches):
    n = 0
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        n += sum(len(words_of(texts[a:b])[0]) for a, b in blocks(texts))
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def with_matches(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, sent_words: int = SENT_WORDS) -> tuple[DataFrame, str]:
    """`docs` with one more column, the items each text contains (never null), and that column's name.

    Null and empty texts contain nothing. An item of fewer than `least` words, or null, is contained in nothing. Rows that repeat an id are judged by their own
    text; all other columns pass. Empty tables are allowed on either side."""
    spark, name, items = docs.sparkSession, free_name(docs.columns, "matches"), _items(benchmark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    size = items.select("text").mapInArrow(_word_counts, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if size > sent_words:
        return _joined(docs, items, name, least, coverage), name
    rows = items.orderBy("item_id").collect()                                      # sent_words words at most
    sent = spark.sparkContext.broadcast(Bench([r.item_id for r in rows], [words_of([r.text])[0] for r in rows], least))
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            found = []
            for a, b in blocks(texts):
                words, first = words_of(texts[a:b])
                seeds = shingles(words, least)
                hit = np.concatenate(([0], np.cumsum(sent.value.maybe[(seeds >> U64(42)).astype(np.int64)])))
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    stop = max(i, j - least + 1)
                    found.append(sent.value.matches(words[i:j], coverage, seeds[i:stop]) if j - i >= least and hit[stop] > hit[i] else [])     # a shorter text has no place in `hit`
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _MATCH)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, `{name}` {MATCH}"), name


def _joined(docs: DataFrame, items: DataFrame, name: str, least: int, coverage: float) -> DataFrame:
    """The same where the benchmark is large: distinct seeds of both sides meet in a join, each pair of texts is tiled once, and the matches go back by text."""
    def seeds(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                words, first = words_of(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.unique(shingles(words[i:j], least)).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64()))], names=["k", "seeds"])

    def tile(batches):
        for batch in batches:
            found = []
            for k, i, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, item = words_of([doc])[0], words_of([text])[0]
                found += [(k, m) for m in Bench([i], [item], least).matches(words, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([m for _, m in found], _MATCH.value_type)], names=["k", "m"])

    key = F.unhex(F.sha2(F.col("text"), 256))
    texts = docs.select("text").filter("text is not null").select(key.alias("k"), "text").dropDuplicates(["k"])
    left = texts.mapInArrow(seeds, "k binary, seeds array<bigint>").select("k", F.explode("seeds").alias("seed"))
    right = items.select("item_id", "text").mapInArrow(seeds, "k bigint, seeds array<bigint>").select(F.col("k").alias("item_id"), F.explode("seeds").alias("seed"))
    pairs = left.join(right, "seed").select("k", "item_id").distinct()
    both = pairs.join(texts.withColumnRenamed("text", "doc"), "k").join(items, "item_id").select("k", "item_id", "doc", "text")
    found = both.mapInArrow(tile, f"k binary, m {MATCH[6:-1]}").groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.col("m.coverage")).alias("o"), F.col("m.item_id").alias("i"), "m"))).alias("ms"))
    found = found
    key_at, found_at = free_name(docs.columns, "_key"), free_name(docs.columns, "_found")
    found = found.select(F.col("k").alias(key_at), F.transform("ms", lambda x: x["m"]).alias(found_at))
    return docs.withColumn(key_at, key).join(found, key_at, "left").select(*docs.columns, F.coalesce(found_at, F.expr(f"cast(array() as {MATCH})")).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document and test item that it contains: doc_id, item_id, coverage, matched_words, n_tiles, longest. Clean documents have no row."""
    found, name = with_matches(docs.select("doc_id", "text"), benchmark, **settings)
    return found.select("doc_id", F.explode(name).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that contain no test item, unchanged."""
    found, name = with_matches(docs, benchmark, **settings)
    return found.filter(F.size(name) == 0).select(*docs.columns)
