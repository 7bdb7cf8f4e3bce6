"""Token ids in Parquet files: one list column, dictionary or delta encoded, in ascending order of document, with small metadata columns beside it.

A text is cut into the tokenizer's own pre-tokens by numpy over whole blocks; the tokenizers library encodes each distinct piece once per worker, and its ids
are put together by position. Texts with characters outside the table of learned classes are encoded whole. Files hold one range of ids each, so row groups and
page indexes let a reader fetch some documents, or only the metadata, without the rest."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.text import U64, blocks, span_hashes

END_ID = 0
KNOWN = 0x3000                         # characters whose class is learned from the tokenizer
MAX_PIECES = 1_000_000                 # pieces a worker remembers; then it starts anew
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true",
          "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes blocks of texts with a byte-level BPE of the tokenizers library. An added token's string in a text is its id, as the library has it, or with `ordinary`
    text like any other."""

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.added = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        whole = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
        self.classes = np.full(KNOWN + 1, _UNKNOWN, dtype=np.uint8)
        for i in range(KNOWN):
            c = chr(i)
            self.classes[i] = _LETTER if whole("a" + c) else _NUMBER if whole("1" + c) else _OTHER if whole("!" + c) else _SPACE
        self.forget()

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)      # sorted hashes and their pieces' numbers: 16 bytes a piece
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.first, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, codes: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. A space belongs to the letters, digits or signs after it; a longer run of white space leaves out its last character."""
        n = len(codes)
        begin = np.ones(n, dtype=bool)
        begin[1:] = kind[1:] != kind[:-1]
        start = np.zeros(n + 1, dtype=bool)
        start[offsets] = True
        begin |= start[:-1]
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~start[1:-1])                # white space before something else in the same text
        begin[last] = True
        begin[last[codes[last] == 32] + 1] = False
        quote = np.flatnonzero(begin & (codes == 39))
        if len(quote):
            pad, stop = np.append(codes, [0, 0, 0]), offsets[np.searchsorted(offsets, quote, "right")]
            one, two = pad[quote + 1], pad[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 2 <= stop)
            long = np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (quote + 3 <= stop)
            begin = np.append(begin, [True, True, True])
            begin[quote[short | long] + 1] = False
            begin[quote[short] + 2] = True
            begin[quote[long & ~short] + 3] = True
            begin = begin[:n]
        return np.flatnonzero(begin)

    def _learn(self, texts: list[str], hashes: np.ndarray) -> None:
        encoded = self.whole(texts)
        flat = np.fromiter((i for ids in encoded for i in ids), dtype=np.int32)
        lengths = np.array([len(ids) for ids in encoded])
        at, more = len(self.known), len(encoded)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + more > len(self.first):
            self.first, self.length = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.first[at:at + more], self.length[at:at + more] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(flat)
        where = np.searchsorted(self.known, hashes)
        self.known, self.number = np.insert(self.known, where, hashes), np.insert(self.number, where, np.arange(at, at + more))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and the number of ids of each."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        kind = self.classes[np.minimum(codes, KNOWN)]
        alone = [None] * len(texts)
        if (kind == _UNKNOWN).any() or any(a in joined for a in self.added):
            alone = [self.whole([t])[0] if t and (ord(max(t)) >= KNOWN or any(a in t for a in self.added)) else None for t in texts]
        if any(w is not None for w in alone):
            ids, counts = self.block(["" if w is not None else t for t, w in zip(texts, alone, strict=True)])
            cut = np.split(ids, np.cumsum(counts)[:-1])
            parts = [np.array(w, dtype=np.int32) if w is not None else c for c, w in zip(cut, alone, strict=True)]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        starts = self.pieces(codes, kind, offsets)
        ends = np.append(starts[1:], len(codes))
        hashes = span_hashes(codes, starts, ends)
        order = np.argsort(hashes)
        new = np.append(True, hashes[order][1:] != hashes[order][:-1])
        firsts = order[new]
        if len(self.known) + len(firsts) > MAX_PIECES:
            self.forget()
        unique = hashes[firsts]
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        missing = self.known[at] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
        if missing.any():
            self._learn([joined[a:b] for a, b in zip(starts[firsts[missing]].tolist(), ends[firsts[missing]].tolist(), strict=True)], unique[missing])
        place = self.number[np.searchsorted(self.known, unique)]
        piece = np.empty(len(hashes), dtype=np.int64)
        piece[order] = place[np.cumsum(new) - 1]
        lengths = self.length[piece]
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.first[piece] - before, lengths) + np.arange(int(lengths.sum()))]
        total = np.append(0, np.cumsum(lengths))
        edge = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(edge)


@lru_cache(maxsize=2)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder a worker, kept between tasks."""
    return Encoder(path, ordinary)


def _encode(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        tool, part, at, checked = encoder(path), TaskContext.get().partitionId(), 0, False
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, counts = tool.block(texts[a:b])
                if not checked:                                # one text a task against the library's own cut
                    checked = True
                    if ids[:counts[0]].tolist() != tool.whole(texts[a:a + 1])[0]:
                        raise RuntimeError("pieces do not give the ids of the whole text")
                edges = np.cumsum(counts)
                ids = np.insert(ids, edges, np.int32(end_id))
                counts = counts + 1
                edges = np.append(0, np.cumsum(counts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(b - a, part, dtype=np.int32)), batch.column(0).slice(a, b - a), pa.array(at + edges[:-1]), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], schema=schema)
                at += int(edges[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, delta: bool = False) -> None:
    """Write the ids of every text of `docs` to `path` in ascending order of doc_id (nulls first; rows that repeat an id in order of their text's hash).

    Each document ends with `end_id`; a null or empty text has no other. With `delta` the ids are delta instead of dictionary encoded. Other columns are not
    kept; an empty table gives files without rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    tie = F.xxhash64("text")
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    layout = dict(LAYOUT, **({"parquet.enable.dictionary": "false"} if delta else {}))
    placed.mapInArrow(_encode(tokenizer, end_id), "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids array<int>").write.options(**layout).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, part) of every document; the ids are not read."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens", "part")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids), of the given range of ids only if there is one; row groups and pages outside it are skipped."""
    df = _placed(spark, path).select("doc_id", "start", "n_tokens", "ids")
    df = df if low is None else df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before: a part's start comes from the parts' sizes, one row a part."""
    from pyspark.sql import Window
    files = spark.read.parquet(path)
    sizes = files.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(sizes.select("p", before.alias("before"))), F.col("part") == F.col("p")).withColumn("start", F.col("before") + F.col("start_in_part"))     # one row a file


def _crc(batches):
    for batch in batches:
        lists = batch.column(3)
        raw, edges = memoryview(lists.flatten().to_numpy().astype("<u4", copy=False)).cast("B"), np.diff(lists.offsets.to_numpy(), prepend=lists.offsets[0].as_py())
        edges = (np.cumsum(edges) * 4).tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
