"""Each operator on small frames: against brute force or an exact round trip, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat, components, decontaminate, knn, langid, licenses, mixing, near_dup, quality, queries, token_files, toxicity
from barloom.session import fresh_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, matches string"
WORDS = ["ab", "cde", "fgh", "ij", "klm", "no", "pqr", "stu", "vw", "xyz", "Äö", "ñu"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts; columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, 3000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (5, long), (6, long + " more"), (7, "!!!"), (8, "it's 12'll  x\n\n y 😀 中文"), (9, long)]
    return spark.createDataFrame([(i, t, "en" if i != 4 else None, "a" if i != 7 else None, len(t or ""), 0.5, "m") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id bigint, quality int, toxic int"


# --- 6: near-duplicates ---------------------------------------------------------------------------------------------------------------------------------------

def sets_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_of(docs):
    sets, root = {i: sets_of(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng, docs = random.Random(5), []
    for family in range(25):
        base = prose(rng, rng.choice([3, 5, 7, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 5, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(["new", "Word", "other"])
            docs.append((len(docs) * 3 % 1009, " ".join(own)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups_of(docs)


def test_near_duplicates_follow_chains_whose_hubs_link_with_few(spark):
    words = [f"w{i}" for i in range(1200)]
    docs = [(i, " ".join(["common opening of all chains here"] * 2 + words[i * 6:i * 6 + 80])) for i in range(60)]
    docs += [(100 + i, " ".join(["common opening of all chains here"] * 2 + words[600 + i * 9:600 + i * 9 + 80])) for i in range(40)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups_of(docs)


@pytest.mark.parametrize("blocks", [(3, 7), (512, 4096)])
def test_near_duplicates_whose_stars_find_little(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dup, "OUTSIDE", blocks[0])
    monkeypatch.setattr(near_dup, "INSIDE", blocks[1])
    words = [f"w{i}" for i in range(900)]
    docs = [(i, " ".join(["common opening of all chains here"] * 2 + words[i * 6:i * 6 + 80])) for i in range(60)]
    docs += [(200 + i, f"{docs[i][1]} again") for i in range(0, 60, 4)]
    monkeypatch.setattr(near_dup, "TURNS", 1)
    found, rest = [], near_dup._rest

    def counted(*given):
        pairs = rest(*given)
        found.append(pairs.count())
        return pairs
    monkeypatch.setattr(near_dup, "_rest", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups_of(docs)
    assert found[0] > 0


def test_sketches_rule_no_alike_pair_out():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 5000):
        for share in (0.0, 0.05, 0.14, 0.3):
            a = np.unique(near_dup.mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
            b = np.unique(np.concatenate([a[int(n * share):], near_dup.mix(rng.integers(0, 1 << 60, int(n * share)).astype(np.uint64))]))
            x, y = near_dup.sketches([a, b]).view(np.uint64)
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_near_duplicates_on_odd_rows(odd, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()))
    assert got[:8] == [(0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, got[6][1], 5, True), (6, got[7][1], 5, False)]
    assert near_dup.near_duplicates(none).count() == 0
    left = near_dup.representatives(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 7, 8]


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 1), (7, 5), (9, 7), (3, 2)], []])
def test_components(spark, links):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    root = {x: x for ab in links for x in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- 2: decontamination ---------------------------------------------------------------------------------------------------------------------------------------

ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the tall old tree"


def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, "too short item", "x"), (3, None, "x"), (None, ITEM, "x"), (4, prose(random.Random(1), 30), "x")], "item_id bigint, text string, matches string")


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_contamination_finds_copies_and_reordered_passages(spark, odd, none, sent):
    words, rng = ITEM.split(), random.Random(2)
    texts = {10: f"{prose(rng, 40)} {ITEM.upper()} {prose(rng, 9)}", 11: " ".join(words[10:]) + " -- " + prose(rng, 5) + " -- " + " ".join(words[:10]), 12: prose(rng, 60), 13: " ".join(words[:6]), 14: None, 15: ""}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs, items(spark), sent_words=sent).collect()}
    assert set(got) == {(10, 1), (11, 1)} and got[10, 1].coverage == 1.0 and got[10, 1].n_tiles == 1 and got[11, 1].n_tiles == 2
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items(spark), sent_words=sent).collect()) == [12, 13, 14, 15]
    left = decontaminate.clean(odd, items(spark), sent_words=sent)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert decontaminate.clean(none, items(spark), sent_words=sent).count() == 0
    assert decontaminate.clean(docs, items(spark).limit(0), sent_words=sent).count() == 6


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_contamination_of_short_texts_at_the_end_of_a_block(spark, sent):
    """Texts of fewer words than a seed have none, wherever they stand in their block."""
    tail = ["", None, "one two three", "one two three four", "!!!", "one"]
    rows = [(1, f"{ITEM} {prose(random.Random(9), 50)}"), *enumerate(tail, 2)]
    for end in range(2, len(rows) + 1):
        docs = spark.createDataFrame(rows[:end], "doc_id bigint, text string").coalesce(1)
        assert [(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items(spark), sent_words=sent).collect()] == [(1, 1)]
        assert decontaminate.clean(docs, items(spark), sent_words=sent).count() == end - 1


def greedy(item, text, least):
    """Longest free common run first, by looking at every pair of places."""
    used_i, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in used_i and t + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -t))
        n, i, t = best[0], -best[1], -best[2]
        if n < least:
            return total
        used_i |= set(range(i, i + n))
        used_t |= set(range(t, t + n))
        total += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=24))
def test_tiles_do_not_overlap_and_start_with_the_longest(item, text):
    found = decontaminate.tiles(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64), 3)
    assert all(item[i:i + n] == text[t:t + n] for i, t, n in found)
    for side in (0, 1):
        taken = [x for f in found for x in range(f[side], f[side] + f[2])]
        assert len(taken) == len(set(taken))
    assert bool(found) == (greedy(item, text, 3) > 0)


# --- 8: toxicity, 3: quality, 10: language --------------------------------------------------------------------------------------------------------------------

def corpus(spark, n=500):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 7 == 0
        text = ". ".join(prose(rng, 8) for _ in range(rng.randrange(1, 6)))
        if toxic:
            text += f". You {rng.choice(['vilest', 'vilely', 'vileness'])} thing."
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()) if not toxic else text + " | | | ###" * 40
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, LABELS), labels


def test_toxicity_on_held_out_documents(spark, odd, none):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in truth if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    some = next(got[i] for i, q, t in truth if t and q)
    text = docs.filter(f"doc_id = {some.doc_id}").first().text.lower()
    assert "vile" in text[some.worst.start:some.worst.end]
    strange = spark.createDataFrame([(1, None, None), (None, 1, 1), (99999, 0, 1), (4, 0, 1), (4, 1, 0)], LABELS)
    assert toxicity.toxicity(odd, strange).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert [r.score for r in toxicity.toxicity(odd, labels.limit(0)).filter("doc_id in (1, 2, 3)").collect()] == [0, 0, 0]
    left = toxicity.clean(odd, labels.limit(0))
    assert left.columns == odd.columns and left.filter("doc_id < 5 or doc_id is null").count() == 6


def test_quality_on_held_out_documents(spark, odd, none):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q, _ in truth if got[i].held_out]) > 0.93
    assert quality.quality(odd, labels).count() == odd.count() and quality.quality(none, labels).count() == 0
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 5, 60).astype(float)
    positive = np.array([rng.integers(0, c + 1) for c in count.astype(int)], dtype=float)
    steps = quality.isotonic(positive, count)
    assert (np.diff(steps) >= 0).all() and math.isclose((steps * count).sum(), positive.sum())


def test_language(spark, odd, none):
    rng = random.Random(4)
    sounds = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[g]) for _ in range(3)) for _ in range(12)), g) for i in range(300) for g in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "12 !", "xx"), (902, "", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert all(got[i].lang_pred == g and got[i].score > 0.9 for i, _, g in rows)
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.languages(odd).count() == odd.count() and langid.languages(none).count() == 0


def sounded(n, share=2):
    """`n` documents of two languages; one in `share` is of the second."""
    rng, sounds = random.Random(4), {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ein"]}
    return [(i, " ".join("".join(rng.choice(sounds[g]) for _ in range(3)) for _ in range(12)), g) for i in range(n) for g in ["yy" if i % share == 0 else "xx"]]


def test_language_is_the_same_where_counts_stay_in_tables(spark, odd, none, monkeypatch):
    rows = [*sounded(200), (900, None, "xx"), (901, "12 !", "xx"), (902, "", None), (903, "a", None), (904, "qqq kato 中文 verein", None), (905, "zzzz", None), (904, "kato mire", "xx"), (906, "中文字中文", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    some = langid.fit(docs)
    want = sorted((tuple(r) for r in langid.languages(docs).collect()), key=str)
    monkeypatch.setattr(langid, "MAX_GRAMS", 10)
    assert isinstance(langid.fit(docs), langid.Tables) and some.order == langid.ORDER
    got = sorted((tuple(r) for r in langid.languages(docs).collect()), key=str)
    assert len(got) == len(want) == len(rows)
    for a, b in zip(got, want, strict=True):
        assert (a[:3], a[5:]) == (b[:3], b[5:]) and math.isclose(a[3], b[3], rel_tol=1e-9) and (a[4] == b[4] or math.isclose(a[4], b[4], rel_tol=1e-9))
    assert langid.languages(odd).count() == odd.count() and langid.languages(none).count() == 0


def test_rejection_is_calibrated_for_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION", 5)
    docs = spark.createDataFrame(sounded(400, 40), "doc_id bigint, text string, lang string")
    assert np.isfinite(langid.fit(docs).limits).all()


def test_limits_come_from_every_learned_document(spark):
    docs = spark.createDataFrame(sounded(30_000), "doc_id bigint, text string, lang string").repartition(8)
    model = langid.fit(docs)
    own = langid._scored(docs.filter(langid.learnable()), model, "lang").filter(f"lang = lang_pred and n_letters >= {langid.LEAST_CHARS}").toPandas()
    for lang, limit in zip(model.langs, model.limits, strict=True):
        values = own.cross_entropy[own.lang == lang].to_numpy()
        assert len(values) > 10_000 and limit == np.sort(values)[math.ceil(langid.ACCEPTED * len(values)) - 1]
    named = langid.languages(docs)
    assert named.count() == 30_000 and sorted(r.doc_id for r in named.filter("accepted").collect()) == sorted(r.doc_id for r in langid._scored(docs, model).filter("accepted").collect())


def test_grams_do_not_depend_on_the_texts_beside():
    for text in ["kato", "a", "", "ver ein!", "12"]:
        alone, (keys, doc, letters) = langid.grams([text]), langid.grams(["mire", text, "x"])
        assert (alone[0] == keys[doc == 1]).all() and len(alone[0]) == (doc == 1).sum() and alone[2][0] == letters[1]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc d"), 400))
    keys, counts = np.unique(langid.grams([text])[0], return_counts=True)
    letters = np.unique(keys & np.uint64(0xFFFF))
    p = langid.kneser_ney(keys, counts.astype(float), 4, len(letters))
    for context in np.unique(keys >> np.uint64(16))[:20]:
        assert math.isclose(p(4, (context << np.uint64(16)) | letters).sum(), 1.0, rel_tol=1e-9)


# --- 1: token files -------------------------------------------------------------------------------------------------------------------------------------------

TEXTS = st.text(st.sampled_from(list("ab'stlrevmd  \n\t\u00a0.,!?12éñß中😀<|>")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    tool = token_files.encoder(token_files.tokenizer_path())
    ids, counts = tool.block(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][:len(texts)] == tool.whole(texts)


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_round_trip(spark, odd, none, delta):
    path, tool = fresh_dir(spark, "tokens"), token_files.encoder(token_files.tokenizer_path())
    token_files.write_tokens(odd, path, token_files.tokenizer_path(), delta=delta)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    at = 0
    for r in rows:
        ids = np.array([*tool.whole([texts[r.doc_id]])[0], 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = token_files.read_tokens(spark, path, 5, 6)
    assert sorted(r.doc_id for r in some.collect()) == [5, 6]
    assert "ids" not in token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    empty = fresh_dir(spark, "tokens")
    token_files.write_tokens(none, empty, token_files.tokenizer_path())
    assert token_files.digests(spark, empty).count() == 0


# --- 9: mixing ------------------------------------------------------------------------------------------------------------------------------------------------

def test_mixing_reaches_the_weights(spark, odd, none):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'b', 'a') as source", "'t' as text", "7 as copy")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("zz", 4.0)], "source string, weight double")
    got = mixing.mixed(docs, weights)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["b"] - 4500) < 300 and abs(n["a"] - 1500) < 200                      # shares are among the sources that occur
    again = mixing.mixed(docs.repartition(5), weights)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    copies = collections.Counter(r.doc_id for r in got.collect())
    assert all(r.copies == copies[r.doc_id] and 1 <= r.copy <= r.copies for r in got.collect())
    assert mixing.mixed(none).count() == 0 and set(mixing.mixed(odd).columns) == {*odd.columns, "copy", "copies", "mix_order"}


# --- 4: nearest neighbours ------------------------------------------------------------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 700)]
    rows += [(700, None), (720, [1.0, None] * 4), (740, [float("nan")] * 8), (760, [float("inf")] * 8), (None, [1.0] * 8), (780, [1.0, 2.0]), (781, [1.0, 2.0]), (800, [])]
    got = collections.defaultdict(list)
    for r in knn.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = {i: [math.floor(float(np.float32(x)) * 64) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:20]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert knn.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_cells_that_are_too_far_are_not_visited(spark):
    from types import SimpleNamespace as Row
    pivots = {1: np.array([[0.0], [1000.0]])}
    theirs = [Row(dim=1, cell=c, nearest=0.0, radius=2.0, gaps=[0.0, 1.0, 2.0]) for c in (0, 1)]
    assert knn.visits(pivots, [Row(dim=1, cell=0, radius=3.0)], theirs, 2) == [(1, 0, 0)]


# --- 5: chat --------------------------------------------------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("\\</s>[INST]|im_endturn: ")), max_size=40))
def test_escapes_are_reversible_and_leave_no_mark(text):
    assert chat.unescape(chat.escape(text)) == text and not any(m in chat.escape(text) for m in chat.MARKS)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b\\[INST]"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, None, None, "x"), (None, 0, "assistant", "z 😀"), (3, 0, "assistant", "</s>"), (3, 0, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("x", "y")
    path, name = fresh_dir(spark, "chat"), token_files.tokenizer_path()
    chat.format_turns(df, path, name)
    got = {r.conv_id: r for r in chat.digests(spark, path, name).collect()}
    said = {1: ([("user", "a"), ("assistant", "b\\[INST]"), ("user", "")]), 2: [("", "x"), ("assistant", "")], None: [("assistant", "z 😀")], 3: [("assistant", "</s>")] * 2}
    for conv, turns in said.items():
        loss, r = "".join(t for role, t in turns if role == "assistant"), got[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- 7: licences ----------------------------------------------------------------------------------------------------------------------------------------------

def test_licences_are_inherited_from_the_nearest_directory(spark, none):
    gpl, mit = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the MIT License."
    rows = [(1, "r/LICENSE", gpl), (2, "r/a/b/x.py", "nothing here"), (3, "r/a/LICENSE", mit), (4, "r/a/y.py", f"some words\n{mit}\nmore words of prose"), (5, "q/z.py", "nothing"), (6, None, None), (7, "r/k.py", ""), (8, "r/a/b/c/d.py", None), (9, "top.py", "under the")]
    got = {r.file_id: (r.license, r.found) for r in licenses.scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert got == {1: ("GPL", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "own"), 4: ("MIT", "own"), 5: (None, "none"), 6: (None, "none"), 7: ("GPL", "inherited"), 8: ("MIT", "inherited"), 9: (None, "none")}
    assert licenses.scan(none.selectExpr("doc_id as file_id", "source as path", "text")).count() == 0


def test_notices_of_other_families(spark):
    bsd2 = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
    bsd3 = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
    want = {"All rights reserved.": "All-Rights-Reserved", "prose\nAll rights reserved.\nReleased under the MIT License.": "MIT", "# SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;": "GPL",
            "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0", "SPDX-License-Identifier: Zlib": "Zlib", "Licensed under the GNU Affero General Public License, version 3": "AGPL", "This software is proprietary and confidential.": "Proprietary",
            "This is free and unencumbered software released into the public domain.": "Unlicense", f"Copyright (c) 2020, A. Author\nAll rights reserved.\n\n{bsd2}": "BSD-2-Clause", f"Copyright (c) 2020, A. Author\nAll rights reserved.\n\n{bsd3}": "BSD-3-Clause",
            "the rights of all readers": None, "an identifier: none": None}
    rows = [(i, f"d{i}/x.txt", t) for i, t in enumerate([*want, *["plain words of prose here"] * 30])]
    got = {r.file_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_documents_below_a_licence_file_inherit(spark, tmp_path):
    rows = [(1, "prose\nReleased under the MIT License.", "en", "a"), (2, "prose", "en", "a"), (3, "prose", "fr", "a"), (104, "prose", "en", "a"), (5, None, "en", "a"), (None, "prose", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.found) for r in queries.op7_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 104: (None, "none"), 5: ("MIT", "inherited"), None: (None, "none")}
