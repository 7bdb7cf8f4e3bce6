"""Near-duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate pairs, exact confirmation.

1. One pass over the texts gives each document the set of its distinct word shingles as 64-bit hashes, the set's 64-bit name, and a signature: every hash
   falls into one of `BINS` bins by its leading bits and the bin keeps its least rest. An empty bin copies the bin that its own fixed random walk meets first
   (the same walk for every document). `ROWS` bins make a band; equal bands share a bucket.
2. Documents with one set form one class; only classes go on, so copies never meet in pairs.
3. A bucket's candidates form a star around one of its members, never all pairs. The first hub is the bucket's least class, so that a family has the same hub
   in all its buckets. Star pairs are confirmed on the full sets. `TURNS - 1` more turns draw other hubs (the class nearest to one of four constants, in small
   buckets to one of each bucket's own) for members whose component is still not the hub's. No pair is tried twice.
4. The rest is exact: where a bucket still holds several components, its members outside the largest one meet all members of other components, in blocks of
   bounded size, by sketches of 1,024 bits. Two sketches differ in no more bits than their sets differ in shingles, so a pair that they rule out cannot be alike.
   Of the pairs left each class first tries its nearest one, then all that are still unconnected are tried.
5. Components of the confirmed links; a class takes the least document id of its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.text import blocks, free_name, mix, shingles, span_hashes, spans, U64, utf8
from barloom.session import discard, fresh_dir

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
REST = U64((1 << 57) - 1)              # bin: the 7 leading bits; rest: the others
SHINGLE, PERCENT = 5, 75
TURNS, SMALL_BUCKET = 3, 8             # stars drawn for each bucket before the rest; buckets of more members share four hubs a turn
SKETCH = 1024                          # bits
OUTSIDE, INSIDE = 512, 4096            # members that meet in one block of the rest: about so many outside the largest component, and of all
_TOWARD = [0, *(int(x) for x in mix(np.arange(1, TURNS, dtype=U64) + U64(31)).view(np.int64))]

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def word_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle, one without words none."""
    codes, offsets = utf8(texts)
    codes = _LOWER[codes]
    starts, ends = spans(~_SEPARATOR[codes])
    words = span_hashes(codes, starts, ends)
    grams, first = shingles(words, k), np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(shingles(words[a:b], b - a) ^ U64(b - a) if b > a else grams[:0])
    return out


def _walks() -> np.ndarray:
    """For each attempt and bin, the bin to look at: a fixed random walk, then one step after another so that it always ends."""
    far = mix(np.arange(64 * BINS, dtype=U64)).reshape(64, BINS) % U64(BINS)
    near = (np.arange(BINS)[None, :] + np.arange(BINS)[:, None]) % BINS
    return np.concatenate([far.astype(np.int64), near])


_WALKS = _walks()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes of each set, one row a set; rows of empty sets mean nothing."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
    empty = U64(0xFFFFFFFFFFFFFFFF)
    flat = np.full(len(sets) * BINS, empty)
    np.minimum.at(flat, np.repeat(np.arange(len(sets)), sizes) * BINS + (every >> U64(57)).astype(np.int64), every & REST)
    bins = flat.reshape(-1, BINS)
    row, col = np.nonzero(bins == empty)
    source = bins.copy()
    for walk in _WALKS:
        if not len(row):
            break
        seen = source[row, walk[col]]
        bins[row, col] = seen
        left = seen == empty
        row, col = row[left], col[left]
    bands = np.zeros((len(sets), BANDS), dtype=U64)
    for r in range(ROWS):
        bands = mix(bands * U64(0x9E3779B97F4A7C15) + bins[:, r::ROWS] + U64(1))
    return bands ^ mix(np.arange(BANDS, dtype=U64) + U64(977))


def set_name(s: np.ndarray) -> int | None:
    """64 bits that stand for the whole set (of ten billion sets, about three pairs share a name by chance); None for the empty set."""
    return int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)) if len(s) else None


def _sets_of(batches, k: int):
    """Each batch's ids and, block by block, the word sets."""
    for batch in batches:
        texts = [(t or b"") for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts):
            yield batch.slice(a, b - a), word_sets(texts[a:b], k)


def _sign(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for rows, sets in _sets_of(batches, k):
            bands = signatures(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.int64()),
                pa.array([b if len(s) else None for b, s in zip(bands, sets, strict=True)], pa.list_(pa.int64()))], schema=schema)
    return run


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `SKETCH` bits for each set: the parity of the number of hashes that fall on the bit."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
    odd = np.bincount(row * SKETCH + (every % U64(SKETCH)).astype(np.int64), minlength=len(sets) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), SKETCH // 64)


def _list(k: int):
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for _, sets in _sets_of(batches, k):
            yield pa.RecordBatch.from_arrays([
                pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(list(sketches(sets)), pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)
    return run


def _store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _hub(turn: int):
    """A bucket's hub in a turn. By exclusive or with a constant, the least number names the class nearest to that constant."""
    if turn == 0:
        return F.min("sid")
    some = F.shiftleft(F.col("bucket").bitwiseAND(F.lit(3)), 61).bitwiseXOR(F.lit(_TOWARD[turn]))
    own = F.col("bucket").bitwiseXOR(F.lit(_TOWARD[turn]))
    return F.when(F.count(F.lit(1)) > SMALL_BUCKET, F.min(F.col("sid").bitwiseXOR(some)).bitwiseXOR(some)).otherwise(F.min(F.col("sid").bitwiseXOR(own)).bitwiseXOR(own))


def _star(members: DataFrame, turn: int, roots: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """New pairs (a, b) of a bucket's hub and members whose component is not known to be the hub's. A bucket of two has nothing to try after the first turn."""
    star = members.filter("size > 2") if turn else members
    hub = F.col(f"hub{turn}")
    star = star.filter(F.col("sid") != hub).select(F.least("sid", hub).alias("a"), F.greatest("sid", hub).alias("b")).distinct()
    if tried is not None:
        star = star.join(tried, ["a", "b"], "left_anti")
    return star if roots is None else _apart_still(star, roots)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, sid, root, main, inside, outside) of the buckets that still hold more than one component: main is the largest one's root, inside the bucket's
    members, outside those of other components than main."""
    placed = members.filter("size > 2").select("bucket", "sid").join(roots.toDF("sid", "root"), "sid", "left").select("bucket", "sid", F.coalesce("root", "sid").alias("root"))
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    return placed.join(several.filter("parts > 1").drop("parts"), "bucket")


def _apart():
    """Bits in which the sketches x and y differ."""
    return sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))


def _may_link(percent: int):
    """Whether sets of n and m shingles with sketches x and y can be alike: d shingles in one of them only mean a similarity of (n + m - d) / (n + m + d), and d is
    at least the difference of the sketches and of the sizes."""
    d = F.greatest(_apart().cast("bigint"), F.abs(F.col("n") - F.col("m")))
    return F.lit(100 + percent) * d <= F.lit(100 - percent) * (F.col("n") + F.col("m"))


def _rest(opened: DataFrame, sets: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """New pairs (a, b, ra, rb, apart) of the open buckets that lie in two components and may link: members outside the main component with all others."""
    drawn = opened.join(sets.select("sid", "n", "sketch"), "sid")
    rows, columns = F.ceil(F.col("outside") / OUTSIDE), F.ceil(F.col("inside") / INSIDE)

    def dealt(over):
        return F.pmod(F.xxhash64("sid"), over)

    def each(over):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), over - 1))
    hubs = drawn.filter("root != main").select("bucket", dealt(rows).alias("row"), each(columns).alias("column"), F.col("sid").alias("hub"), F.col("root").alias("its"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    ends = drawn.select("bucket", each(rows).alias("row"), dealt(columns).alias("column"), "sid", "root", "main", "n", F.col("sketch").alias("x"))
    once = (F.col("root") == F.col("main")) | (F.col("hub") < F.col("sid"))
    pairs = ends.join(hubs, ["bucket", "row", "column"]).filter(F.col("root") != F.col("its")).filter(once).filter(_may_link(percent))
    first = F.col("hub") < F.col("sid")
    pairs = pairs.select(
        F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b"), F.when(first, F.col("its")).otherwise(F.col("root")).alias("ra"),
        F.when(first, F.col("root")).otherwise(F.col("its")).alias("rb"), (_apart() / (F.col("n") + F.col("m"))).alias("apart"))
    return pairs.distinct().join(tried, ["a", "b"], "left_anti")


def _nearest(rest: DataFrame) -> DataFrame:
    """Each class's nearest partner."""
    both = rest.select("a", "b", F.col("a").alias("of"), "apart").unionByName(rest.select("a", "b", F.col("b").alias("of"), "apart"))
    return both.groupBy("of").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _apart_still(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in two components."""
    placed = pairs.select("a", "b").join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return placed.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _rerooted(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Roots after more links: the components of the roots that the links join."""
    ends = new.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    moved = components(ends, "ra", "rb").toDF("root", "to")
    nodes = roots.unionByName(ends.select(F.col("a").alias("node"), F.col("ra").alias("root"))).unionByName(ends.select(F.col("b").alias("node"), F.col("rb").alias("root"))).distinct()
    return nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; sets meet only where the sketches do not rule the pair out."""
    small = sets.select("sid", "n", "sketch")
    pairs = pairs.join(small.toDF("a", "n", "x"), "a").join(small.toDF("b", "m", "y"), "b").filter(_may_link(percent)).select("a", "b")
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both)).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, roots: DataFrame | None) -> DataFrame:
    """Roots after the pairs are tried."""
    new, _ = _store(_confirmed(pairs, sets, percent), "confirmed")
    if roots is None:
        return components(new, "a", "b")
    return roots if new.isEmpty() else _store(_rerooted(roots, new), "roots")[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least id reachable over links, its own included), kept (doc_id = component_id), text_key (a hash of the text).

    Null and empty texts and texts without words have no shingles and link with nothing. Rows that repeat an id are one node each by their set; a row without an
    id links like others but lends no id: its component_id is the least id of the others, or null. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    signed, _ = _store(plain.mapInArrow(_sign(k), "doc_id bigint, text_key bigint, n_shingles bigint, sid bigint, bands array<bigint>"), "signed")

    classes = signed.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "bands")).alias("c"))
    banded, banded_at = _store(classes.select("sid", "c.doc_id", F.explode("c.bands").alias("bucket")), "banded")
    hubs = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *[_hub(turn).alias(f"hub{turn}") for turn in range(TURNS)]).filter("size > 1")
    members, members_at = _store(banded.join(hubs, "bucket"), "members")
    discard(spark, banded_at)

    needed = members.select(F.col("doc_id").alias("needed")).distinct()
    texts = plain.select("doc_id", "text").join(needed, F.col("doc_id").eqNullSafe(F.col("needed")), "left_semi")
    sets, sets_at = _store(texts.mapInArrow(_list(k), "sid bigint, n bigint, sketch array<bigint>, shingles array<bigint>"), "sets")
    rows, names = sets.agg(F.count(F.lit(1)), F.count_distinct("sid")).first()
    if rows != names:                                          # rows that repeat an id
        sets, more_at = _store(sets.dropDuplicates(["sid"]), "sets")
        discard(spark, sets_at)
        sets_at = more_at

    roots = tried = None
    for turn in range(TURNS):
        pairs, _ = _store(_star(members, turn, roots, tried), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = _linked(pairs, sets, percent, roots)
    opened, opened_at = _store(_open(members, roots), "open")
    rest, rest_at = _store(_rest(opened, sets, tried, percent), "rest")
    if not rest.isEmpty():
        near, near_at = _store(_nearest(rest), "pairs")
        roots = _linked(near, sets, percent, roots)
        roots = _linked(_apart_still(rest.join(near, ["a", "b"], "left_anti"), roots), sets, percent, roots)
        discard(spark, near_at)
    discard(spark, rest_at)
    discard(spark, opened_at)
    discard(spark, sets_at)
    discard(spark, members_at)

    ids = signed.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    joined = ids.join(roots.withColumnRenamed("node", "sid"), "sid")
    least = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id")
    named = ids.join(least, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id"))
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "text_key", "n_shingles", "sid").join(named, "sid", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one of each group, that of least id (of rows that repeat this id the one of least text hash), and all texts without words."""
    rows, _ = _store(near_duplicates(docs), "groups")
    gone_at, key_at, text_at = (free_name(docs.columns, c) for c in ("_gone", "_key", "_text"))
    worded = rows.filter("n_shingles > 0")
    stay = worded.filter("kept").groupBy("component_id").agg(F.min("text_key").alias("least"))
    gone = worded.join(stay, worded["component_id"].eqNullSafe(stay["component_id"]), "left")
    gone = gone.filter(~F.col("kept") | (F.col("text_key") != F.col("least"))).select(F.col("doc_id").alias(gone_at), F.col("text_key").alias(key_at)).distinct()
    again = worded.filter("kept").groupBy(F.col("doc_id").alias(gone_at), F.col("text_key").alias(key_at)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(gone_at, key_at)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_at)) & (F.xxhash64("text") == F.col(key_at))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    key = F.xxhash64("text").alias(text_at)
    once = left.join(again, same, "left_semi").select("*", key).dropDuplicates(["doc_id", text_at]).drop(text_at)
    return left.join(again, same, "left_anti").unionByName(once)
