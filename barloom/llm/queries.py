"""Each operator as a named query over the given tables, with production parameters, and the SQL that states the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, decontaminate, knn, langid, licenses, main_text, merkle, mixing, near_dup, quality, token_files, toxicity, whitening
from barloom.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_files(spark, sf_dir):
    """Every text's token ids, written to files and read back."""
    path = fresh_dir(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, token_files.tokenizer_path())
    return token_files.digests(spark, path)


@_query
def op2_decontaminate(spark, sf_dir):
    """Documents that contain a benchmark item, with the item."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_near_dup(spark, sf_dir):
    """Near-duplicate groups."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark, sf_dir):
    """Toxicity of every text."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_mixing(spark, sf_dir):
    """Documents replicated to tempered source weights and shuffled."""
    return mixing.mixed(_table(spark, sf_dir, "documents"))


SQL["op9_mixing"] = mixing.SQL.strip()


@_query
def op3_quality(spark, sf_dir):
    """Quality of every text."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_language(spark, sf_dir):
    """Language of every text."""
    return langid.languages(_table(spark, sf_dir, "documents"))


@_query
def op4_knn(spark, sf_dir):
    """The 20 nearest by inner product of every twentieth vector."""
    return knn.top_k(_table(spark, sf_dir, "embeddings"))


SQL["op4_knn"] = knn.SQL.strip()


@_query
def op5_chat(spark, sf_dir):
    """Conversations formatted as tokens, read back."""
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path, tokenizer = fresh_dir(spark, "chat"), token_files.tokenizer_path()
    chat.format_turns(conversations.unionByName(chat.planted(spark)), path, tokenizer)
    return chat.digests(spark, path, tokenizer)


@_query
def op7_licenses(spark, sf_dir):
    """The licence of every document, its own or its directory's. A hundred ids of a source and language share a directory, with three folders below it; a document
    that ends in a notice is a licence file of the directory."""
    docs = _table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("bigint")
    above = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.floor(number / 100).cast("string"), F.lit("none")))
    ends = F.substring_index(F.rtrim("text"), "\n", -1).rlike(r"(?i)licen[cs]|all rights reserved")
    name = F.coalesce(number.cast("string"), F.lit("none"))
    path = F.when(ends, F.concat_ws("/", above, F.concat(F.lit("LICENSE-"), name))).otherwise(F.concat_ws("/", above, F.pmod(number, F.lit(3)).cast("string"), F.concat(name, F.lit(".txt"))))
    return licenses.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


@_query
def op11_whitening(spark, sf_dir):
    """Every vector on the 16 leading whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op12_main_text(spark, sf_dir):
    """Main text of every page."""
    return main_text.main_text(_table(spark, sf_dir, "pages"))


# What stands in the page's article element, block by block: the same rows by a plainer way, on pages that have one and nothing foreign in it.
SQL["op12_main_text"] = r"""
WITH parts AS (
    SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1), '</?(?:p|h1)>'), lambda s: trim(regexp_replace(
        replace(replace(replace(replace(regexp_replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&amp\b;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) AS blocks
    FROM pages)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(blocks, lambda s: s <> ''), chr(10)) AS text FROM parts)
""".strip()


@_query
def op13_merkle(spark, sf_dir):
    """Leaf, roots, proof and folded proof of every document."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


SQL["op13_merkle"] = """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
        CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
        CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
        (list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda crc, byte:
            list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::UBIGINT)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))) AS crc
    FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(head || translate(body, up, low)) ELSE sha256(head || body) END AS other FROM docs),
placed AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM leaves),
nodes AS (
    SELECT tree, 0 AS lvl, pos, leaf AS node, size FROM placed
    UNION ALL
    SELECT tree, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 15) // 16 FROM nodes WHERE size > 1 GROUP BY tree, lvl, pos // 16),
tops AS (SELECT tree, node FROM nodes WHERE size = 1),
crown AS (
    SELECT 0 AS lvl, row_number() OVER (ORDER BY tree) - 1 AS pos, tree, node, count(*) OVER () AS size FROM tops
    UNION ALL
    SELECT lvl + 1, pos // 16, NULL, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 15) // 16 FROM crown WHERE size > 1 GROUP BY lvl, pos // 16),
root AS (SELECT node AS root FROM crown WHERE size = 1),
beside AS (SELECT tree, lvl, pos, coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, size
    FROM (SELECT tree, lvl, pos, node, size FROM nodes UNION ALL SELECT 'crown', lvl, pos, node, size FROM crown)),
folds AS (
    SELECT p.tree, p.pos AS leaf_pos, p.tree AS at, 0 AS lvl, p.pos, p.other AS node, '' AS proof, false AS done FROM placed p
    UNION ALL
    SELECT f.tree, f.leaf_pos, CASE WHEN b.size = 1 THEN 'crown' ELSE f.at END, CASE WHEN b.size = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN b.size = 1 THEN c.pos ELSE f.pos // 16 END,
        CASE WHEN b.size = 1 THEN f.node ELSE sha256(b.l || f.node || b.r) END, CASE WHEN b.size = 1 THEN f.proof ELSE f.proof || b.l || b.r END, b.size = 1 AND f.at = 'crown'
    FROM folds f JOIN beside b ON f.at = b.tree AND f.lvl = b.lvl AND f.pos = b.pos LEFT JOIN crown c ON c.lvl = 0 AND c.tree = f.tree WHERE NOT f.done)
SELECT p.doc_id, p.leaf, t.node AS subroot, root.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM placed p JOIN folds f ON f.tree = p.tree AND f.leaf_pos = p.pos AND f.done JOIN tops t ON t.tree = p.tree CROSS JOIN root
""".strip()
