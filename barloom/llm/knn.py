"""Exact top-k search by a Voronoi kNN join.

The largest inner product is the least distance once each candidate x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and each query a zero; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Queries and candidates join the cell of their nearest pivot. Summaries of cells (how far their candidates lie from the pivot, and
the nearest of them) bound how far the k-th neighbour of any query of a cell can be; a cell of candidates is visited by a cell of queries only if its nearest
possible member lies within that bound. Cells are cut into chunks of bounded size, so that a cell of equal vectors is many tasks; each chunk answers for all its
visitors by one matrix product, and the k best of all chunks are merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

PIVOTS, CHUNK, QUERY_CHUNK = 32, 4096, 1024
SAMPLE = 2048                          # vectors of least hash that pivots are drawn from
SCALE, EVERY, TOP = 64, 20, 20
_EXACT = float(1 << 53)


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v) with v = floor(64 x); vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"),
                                       F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, pivots far from each other out of a sample of SAMPLE vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect()
    out = {}
    for dim in {r.dim for r in vectors.select("dim").distinct().collect()}:
        sample = np.array([r.v for r in rows if r.dim == dim] or [[0.0] * dim])
        chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
        while len(chosen) < min(PIVOTS, len(sample)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = sample[chosen]
    return out


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells(pivots, query: bool, most: dict[int, float]):
    """Each vector's nearest pivot and its distance; candidates carry the extra component that pivots and queries lack."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cell, gap = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, p = _matrix(batch.column(2).take(pa.array(at))), pivots.value[dim]
                norm = (x ** 2).sum(axis=1)
                apart = np.maximum(norm[:, None] - 2 * x @ p.T + (p ** 2).sum(axis=1), 0)
                cell[at] = apart.argmin(axis=1)
                gap[at] = np.sqrt(apart.min(axis=1) + (0 if query else np.maximum(most[dim] - norm, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=["vec_id", "dim", "v", "cell", "gap"])
    return run


def visits(pivots: dict[int, np.ndarray], ours: list, theirs: list, k: int, own: int = 1) -> list[tuple[int, int, int]]:
    """(dim, query cell, candidate cell) that must meet. `ours`: rows of query cells (dim, cell, radius); `theirs`: of candidate cells (dim, cell, nearest, radius, gaps),
    a gap for each id at most. `own`: in how many cells one query's id may stand."""
    out = []
    for dim, p in pivots.items():
        apart = np.sqrt(np.maximum((p ** 2).sum(axis=1)[:, None] - 2 * p @ p.T + (p ** 2).sum(axis=1), 0))
        cells = [t for t in theirs if t.dim == dim]
        for q in (o for o in ours if o.dim == dim):
            reach = sorted(q.radius + apart[q.cell, t.cell] + g for t in cells for g in t.gaps)
            bound = reach[k + own - 1] if len(reach) >= k + own else np.inf   # so many gaps may be of the query's own id
            out += [(dim, q.cell, t.cell) for t in cells if max(apart[q.cell, t.cell] - q.radius - t.radius, t.nearest - apart[q.cell, t.cell] - q.radius) <= bound * (1 + 1e-9) + 1e-6]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: in double precision while every partial sum is exact, else in Python's whole numbers, held to 64 bits."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(c) for c in r] for r in q], dtype=object) @ np.array([[int(c) for c in r] for r in x], dtype=object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _answer(k: int):
    def run(key, left, right):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        qs, xs = _matrix(left.column("v")), _matrix(right.column("v"))
        q_ids, x_ids, out = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), []
        for a in range(0, len(qs), 256):
            for q, row in zip(q_ids[a:a + 256].tolist(), products(qs[a:a + 256], xs), strict=True):
                other = np.flatnonzero(x_ids != q)
                at = other[best(row[other], x_ids[other], k)]
                out.append((np.full(len(at), q), x_ids[at], row[at]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i, n in enumerate(("query_id", "vec_id", "score"))})
    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is a multiple of `every`, the k rows of largest inner product, its own id left out.

    Ties go to the smaller id. Only vectors of equal length are compared. Rows that repeat an id are candidates each (a tie of equal rows), and one query by the
    row of least vector. Fewer candidates give fewer rows; an empty table, or one without valid vectors, gives none. Other columns are ignored."""
    spark = vectors.sparkSession
    table = cut_lineage(whole(vectors), "vectors")
    pivots = _pivots(table)
    most = {r.dim: r.m for r in table.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).collect()}      # a row a dimension count
    sent = spark.sparkContext.broadcast(pivots)
    shape = "vec_id bigint, dim int, v array<double>, cell int, gap double"
    candidates = cut_lineage(table.mapInArrow(_cells(sent, False, most), shape), "candidates")
    asked = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    queries = cut_lineage(asked.mapInArrow(_cells(sent, True, most), shape), "queries")

    ours = queries.groupBy("dim", "cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect()                 # PIVOTS rows
    sizes = candidates.groupBy("dim", "cell").agg(F.min("gap").alias("nearest"), F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    apart = candidates.filter(F.col("vec_id") % every == 0).select("vec_id", "dim", "cell").distinct().groupBy("vec_id", "dim").count()
    own = apart.agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]                                                                 # 1 where ids are unique, PIVOTS at most
    salted = candidates.groupBy("dim", "cell", "vec_id").agg(F.min("gap").alias("gap")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("dim", "cell", "salt").orderBy("gap"))).filter(F.col("r") <= k + own)
    gaps = near.groupBy("dim", "cell").agg(F.slice(F.array_sort(F.collect_list("gap")), 1, k + own).alias("gaps"))                  # 64 (k + own) numbers a cell
    theirs = sizes.join(gaps, ["dim", "cell"]).collect()                                                                            # PIVOTS rows
    meet = visits(pivots, ours, theirs, k, own)
    if not meet:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    parts = {(t.dim, t.cell): max(1, -(-t.n // CHUNK)) for t in theirs}
    groups = {(o.dim, o.cell): max(1, -(-o.n // QUERY_CHUNK)) for o in ours}
    plan = spark.createDataFrame([(d, q, c, parts[d, c], groups[d, q]) for d, q, c in meet], "dim int, qcell int, ccell int, parts int, groups int")     # PIVOTS^2 rows
    chunks = plan.select("dim", "qcell", "ccell", "groups", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent_queries = queries.join(F.broadcast(chunks.withColumnRenamed("dim", "d")), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("qcell")))
    sent_queries = sent_queries.select("dim", "ccell", "part", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int").alias("grp"), F.col("qcell"), "vec_id", "v")
    needed = plan.groupBy("dim", "ccell").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("qcell", "groups")).alias("from"))
    held = candidates.join(F.broadcast(needed.withColumnRenamed("dim", "d")), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("ccell")))
    held = held.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int"))
    wide = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.array_max(F.transform("from", lambda x: x["groups"])) - 1))).alias("grp")
    held = held.select("dim", "ccell", "part", wide, "vec_id", "v")
    left = sent_queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "ccell", "part", "grp")], "vec_id", "v").groupBy("q_dim", "q_ccell", "q_part", "q_grp")
    right = held.select(*[F.col(c).alias(f"c_{c}") for c in ("dim", "ccell", "part", "grp")], "vec_id", "v").groupBy("c_dim", "c_ccell", "c_part", "c_grp")
    pairs = left.cogroup(right)
    found = pairs.applyInArrow(_answer(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}
"""
