"""Cases that once went wrong: repeated ids in tight cells, added tokens' strings in texts, long clean texts, columns named like the operators' own."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import decontaminate, knn, mixing, near_dup, token_files, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_top_k_where_ids_repeat(spark):
    rng = np.random.default_rng(8)
    rows = [(20, [float(9 + rng.normal() / 9), 9.0, 0.0]) for _ in range(40)] + [(20, [-50.0, 3.0, 1.0]), (20, [60.0, -20.0, 1.0])]
    rows += [(i, [float(x) for x in rng.normal(size=3) * 8 + (9, 9, 0)]) for i in range(100, 400)] + [(40, [9.0, 9.0, float(i % 2)]) for i in range(30)]
    got = collections.defaultdict(list)
    for r in knn.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = [(i, tuple(np.floor(64 * np.array(v)).astype(int).tolist())) for i, v in rows]
    for q in {i for i, _ in whole if i % 20 == 0}:
        asked = min(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in whole if i != q)[:20]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]


def test_an_added_token_in_a_text_is_its_id():
    tool, ordinary = token_files.encoder(token_files.tokenizer_path()), token_files.encoder(token_files.tokenizer_path(), True)
    texts = ["a <|endoftext|> b", "plain", "", "<|endoftext|>", "x <|endof", "text|> y", "中 <|endoftext|>"]
    ids, counts = tool.block(texts)
    mine = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert mine == [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)] and mine[0] == [64, 220, 50256, 275]
    ids, counts = ordinary.block(texts)
    assert 50256 not in ids and counts[0] == 9


def test_length_alone_is_not_toxic(spark):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["good", "day", "tree", "house", "walk", "river"]) for _ in range(30)) + "." for _ in range(400)]
    long = " ".join(f"{rng.choice(plain)}" for _ in range(3000))
    docs = [(i, t) for i, t in enumerate(plain)] + [(1000 + i, plain[i] + " You vile rotten fool.") for i in range(100)] + [(5000, long), (5001, long + " You vile rotten fool.")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in docs if i < 5000], LABELS)
    assert toxicity.clean(df, labels.limit(0)).count() == len(docs)
    left = {r.doc_id for r in toxicity.clean(df, labels).collect()}
    assert left == {*range(400), 5000}
    assert {r.doc_id: r.score for r in toxicity.toxicity(df, labels).collect()}[5000] == 0


@pytest.fixture(scope="module")
def clashing(spark):
    """A table of documents with columns named like the operators' own."""
    names = ["src", "CDF", "_u", "copy", "copies", "mix_order", "_key", "_found", "_gone", "_text", "k", "matches", "seed", "sid", "score", "part", "ids"]
    rows = [(i, " ".join(f"w{i % 30}x{j}" for j in range(12)), "en", "ab"[i % 2], 60, *[f"{n}{i}" for n in names]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))


def test_columns_named_like_the_operators_own(spark, clashing):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    rows = {r.doc_id: tuple(r) for r in clashing.collect()}
    mixed = corpus_pipeline.mix_sources(spark, clashing, "")
    assert mixed.columns == clashing.columns and all(tuple(r) == rows[r.doc_id] for r in mixed.collect())
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(r.doc_id for r in mixing.mixed(plain).collect())
    left = near_dup.representatives(clashing)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in near_dup.representatives(plain).collect())
    items = spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string")
    for words in (decontaminate.SENT_WORDS, 0):
        kept = decontaminate.clean(clashing, items, sent_words=words)
        assert kept.columns == clashing.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows[i] for i in rows if i % 30 != 3)
