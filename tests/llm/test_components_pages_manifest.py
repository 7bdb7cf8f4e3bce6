"""Whitening, main text and manifest: against brute force, and on nulls, empty and very long values, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from barloom.llm import main_text, merkle, whitening
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_main_text", "op13_merkle"])
def test_queries_equal_their_sql(spark, name):
    ok, message, _, _ = compare(name, spark, connect(SF), SF, entry.queries(), entry.oracle_sql())
    assert ok, message


# --- 11: whitening ----------------------------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "repeated", "diagonal", "equal", "zero", "tiny"])
def test_leading_vectors(size, kind):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    turn = np.linalg.qr(a)[0]
    m = {"full": a @ a.T, "repeated": turn @ np.diag(np.resize([5.0, 5.0, 2.0, 1e-7], size)) @ turn.T, "diagonal": np.diag(rng.integers(0, 3, size).astype(float)), "equal": np.eye(size) * 3,
         "zero": np.zeros((size, size)), "tiny": a @ a.T * 1e-30}[kind]
    values, vectors = whitening.leading((m + m.T) / 2, 16)
    want = np.linalg.eigvalsh((m + m.T) / 2)[::-1][:16]
    norm = max(abs(want).max(), 1e-300)
    assert abs(values - want).max() <= 1e-14 * size * norm
    assert abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert abs(m @ vectors - vectors * values).max() <= 1e-13 * norm


def brute_whiten(rows):
    rows = [(i, np.floor(64 * np.array(v, dtype=float)).astype(np.int64) + 1_000_000) for i, v in rows]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in rows}))
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    keep = np.argsort(-e)[:16]
    keep = keep[e[keep] > 1e-9 * e.max()]
    return n, e[keep] / np.trace(v), [(i, int(((n * x - s) ** 2).sum()), ((n * x - s) / n) @ u[:, keep] / np.sqrt(e[keep])) for i, x in rows]


def check_whiten(got, rows):
    n, explained, want = brute_whiten(rows)
    k = len(explained)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert all(r.identity_error <= 1e-9 and abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1] for r in got)
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    sign = None
    for i, deviation, w in want:
        mine = np.array([table[i, deviation][c + 1][0] for c in range(k)])
        sign = np.sign(mine * w) if sign is None and (abs(w) > 1e-3).all() else sign
        assert np.allclose(abs(mine), abs(w), atol=1e-8) and (sign is None or np.allclose(mine * sign, w, atol=1e-8))


def test_query_whitens_as_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whiten(entry.queries()["op11_whitening"](spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(4)
    good = [(i, [rng.choice([-3.0, 0.25, 1.5, 2.0]) + j for j in range(5)]) for i in range(60)]
    good += [(None, good[0][1]), (7, good[7][1]), *[(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200)]]
    odd = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 9, "x", 1.0) for i, v in good + odd], "vec_id bigint, embedding array<double>, n int, q string, deviation double")
    check_whiten(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 1000")).count() == 0                                          # one distinct vector: nothing varies
    flat = spark.createDataFrame([(i, [float(i), 2.0, 0.0]) for i in range(10)], "vec_id bigint, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}                                     # one direction varies


def test_deviation_beyond_a_long_is_null(spark):
    big = spark.createDataFrame([(i, [float(i * (1 << 30)), float(i % 3)]) for i in range(40)], "vec_id bigint, embedding array<double>")
    rows = whitening.whiten(big).collect()
    want = brute_whiten([(r.vec_id, [0.0, float(r.vec_id % 3)]) for r in rows if r.component == 1])
    assert any(r.deviation is None for r in rows) and {r.component for r in rows} == {1} and want[0] == 3
    assert all(r.deviation is None or r.deviation >= 0 for r in rows) and max(r.identity_error for r in rows) < 1e-9


# --- 12: main text ----------------------------------------------------------------------------------------------------------------------------------------------

def test_cut_is_the_best_of_all_labellings():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(1, 9)
        t = [rng.randint(-6, 6) for _ in range(n)]
        e = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 14))]

        def price(side):
            return sum(abs(x) for x, s in zip(t, side) if x and (x > 0) != bool(s)) + sum(w for a, b, w in e if side[a] != side[b])
        every = list(itertools.product([0, 1], repeat=n))
        best = min(map(price, every))
        got = main_text.cut(t, e)
        assert price(got) == best and sum(got) == max(sum(s) for s in every if price(s) == best)


def test_cut_of_a_long_chain():
    rng = random.Random(2)
    t = [rng.randint(-9, 9) for _ in range(20_000)]
    got = main_text.cut(t, [(i - 1, i, 4) for i in range(1, len(t))])
    cost = [0, 0]                                                                                               # the same by dynamic programming along the chain
    for i, x in enumerate(t):
        stay = [cost[s] if not i else min(cost[s], cost[1 - s] + 4) for s in (0, 1)]
        cost = [stay[0] + max(x, 0), stay[1] + max(-x, 0)]
    mine = sum(abs(x) for x, s in zip(t, got) if (x > 0) != s) + 4 * sum(a != b for a, b in zip(got, got[1:]))
    assert mine == min(cost)


NAV = "<header><a href=/>Site</a><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav></header>"
FOOT = "<aside class='side'><p>You may also like these other pages of ours.</p></aside><footer><p>&copy; 2020 Us. All rights reserved.</p></footer>"
ARTICLE = "<h1>A &lt;title&gt; &amp;amp; more</h1><p>First <b>bold</b> words &eacute;&#233;,\n two\t lines.<p>Short.</p><ul><li>item <a href=x>one</a><li>item two</ul>"
WANT = "A <title> &amp; more\nFirst bold words éé, two lines.\nShort.\nitem one\nitem two"
PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<article>{ARTICLE}</article>{FOOT}</body></html>", WANT),
    "main": (f"<body class='has-sidebar'>{NAV}<main>{ARTICLE}</main>{FOOT}", WANT),
    "words": (f"<body>{NAV}<div class='post-content'>{ARTICLE}</div>{FOOT}", WANT),
    "advert inside": (f"<body>{NAV}<article>{ARTICLE}<div class='adSlot big'>Buy our things now, they are cheap.</div></article>{FOOT}", WANT),
    "form inside": (f"<body>{NAV}<article>{ARTICLE}<form><label>Mail</label><input value='x'><button>Go</button></form></article>{FOOT}", WANT),
    "comments inside": (f"<body>{NAV}<article>{ARTICLE}<section id=comments><article><p>I liked this one a lot, thank you for it.</p></article></section></article>{FOOT}", WANT),
    "comments behind": (f"<body>{NAV}<article>{ARTICLE}</article><ol class='comment-list'><li><p>I liked this one a lot, thank you for it.</p></ol>{FOOT}", WANT),
    "notice before": (f"<body><div class='cookie-notice' role=alert>We use cookies for everything that we do.</div>{NAV}<article>{ARTICLE}</article>{FOOT}", WANT),
    "hidden": (f"<body>{NAV}<article>{ARTICLE}<p hidden>no</p><div style='display: none'>no</div><noscript>no</noscript><!-- <p>no</p> --></article>{FOOT}", WANT),
    "script": (f"<body>{NAV}<script>if (a < b) document.write('<article><p>no</p></article>')</script><article>{ARTICLE}</article>{FOOT}", WANT),
    "title in its header": (f"<body>{NAV}<article><header class='entry-header'><h1>Head</h1></header><p>Body of the article, as long as it is.</p></article>{FOOT}", "Head\nBody of the article, as long as it is."),
    "no marks": ("<body><div><a href=/>Home</a> | <a href=/a>About</a> | <a href=/b>Contact</a></div><div><h2>Head</h2><p>" + "Plain words go on and on. " * 9 + "</p><p>Short.</p><p>" + "More plain words follow them here. " * 9 + "</p></div><div><a href=/c>Next</a></div>",
                 "Head\n" + ("Plain words go on and on. " * 9).strip() + "\nShort.\n" + ("More plain words follow them here. " * 9).strip()),
    "plain": ("just text", "just text"), "empty": ("", ""), "stray": ("a < b > c </div></p> <3", "a < b > c\n<3"), "open tag": ("<p>text<div class='x", "text"), "open comment": ("<p>text<!-- no", "text"),
    "open quote": ("<p title='x>text</p><p>more</p>", "text\nmore"), "references": ("<p>&amp;lt; &nbsp; &#x41;&am &amp &unknown;</p>", "&lt; A&am & &unknown;"), "navigation only": (NAV, ""),
}


@pytest.fixture(scope="module")
def marked_pages(spark):
    rows = [(i, f"http://x/{k}", h) for i, (k, (h, _)) in enumerate(PAGES.items())] + [(900, None, None), (None, "u", "<p>y"), (0, "http://x/article", PAGES["article"][0])]
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id bigint, url string, html string, text string, n_chars int")


def test_main_text(marked_pages):
    got = [tuple(r) for r in main_text.main_text(marked_pages).collect()]
    want = [(i, f"http://x/{k}", t, len(t)) for i, (k, (_, t)) in enumerate(PAGES.items())] + [(900, None, "", 0), (None, "u", "y", 1), (0, "http://x/article", WANT, len(WANT))]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert main_text.main_text(marked_pages.limit(0)).count() == 0


def test_long_and_deep_pages():
    many = "<article>" + "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert main_text.extract(many, {}).count("\n") == 19_999
    assert main_text.extract("<div>" * 50_000 + "deep" + "</div>" * 50_000, {}) == "deep"
    assert main_text.extract("<a \"" * 20_000 + "<p>end</p>", {}) is not None and main_text.extract("<!--" * 20_000, {}) == ""


def test_classifier_counts_all_marked_blocks(spark, marked_pages):
    good, bad = [], []
    for h, _ in [*PAGES.values(), PAGES["article"], ("<p>y", "")]:
        for b in main_text.blocks_of(h):
            if b.mark:
                (good if b.mark > 0 else bad).append(set(main_text.features(b)))
    weights = main_text.odds(marked_pages)
    for f in {f for s in good + bad for f in s}:
        g, b = sum(f in s for s in good), sum(f in s for s in bad)
        assert math.isclose(weights[f], math.log((g + 1) / (len(good) + 8)) - math.log((b + 1) / (len(bad) + 8)))


# --- 13: manifest -----------------------------------------------------------------------------------------------------------------------------------------------

def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m.group().lower(), t)
    leaf = lambda r, text: digest("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, lower(r[4])), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:4])]) for s in names}
    crown = levels([trees[s][-1][0] for s in names])

    def beside(tree, i, node):
        out = []
        for line in tree[:-1]:
            run = range(i - i % 16, min(i - i % 16 + 16, len(line)))
            out += [line[j] for j in run if j != i]
            node, i = digest("".join(node if j == i else line[j] for j in run)), i // 16
        return out, node
    want = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:4])):
            tampered = x[4][0] is not None and zlib.crc32(str(x[4][0]).encode()) % 5 == 0
            first, top = beside(trees[s], i, x[3] if tampered else x[2])
            rest, top = beside(crown, k, top)
            want.append((x[4][0], x[2], trees[s][-1][0], crown[-1][0], digest("".join(first + rest)), top, top == crown[-1][0]))
    return want


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def manifest_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, node int")


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [256, 1], [257, 3], [700, 40, 1, 1, 16], [2] * 40])
def test_manifest_of_trees_of_any_size(spark, sizes):
    rows = [(i * 7 % 10_007, f"s{k}", "en", i, f"Text {i}") for k, size in enumerate(sizes) for i in range(size)]
    got = plain(merkle.manifest(manifest_frame(spark, rows)).collect())
    assert got == plain(brute_manifest(rows)) and any(r[-1] for r in got)


def test_manifest_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (3, "é", "fr", 3, "Ünïcode ABC"), (3, "é", "fr", 3, "Ünïcode ABC"), (3, "é", "fr", 4, "other"), (None, "é", None, None, "No id ABC"), (-5, "z", "en", 1, "A"),
            (10**15, "Z", "en", 1, "x" * 300_000), (7, None, "en", 0, "ABC"), *[(100 + i, "hot", "en", 1, "Upper") for i in range(600)], *[(5, "same", "en", 1, "EQUAL")] * 300]
    got = plain(merkle.manifest(manifest_frame(spark, rows).repartition(7)).collect())
    assert got == plain(brute_manifest(rows))
    assert any(not r[-1] for r in got) and all(r[-1] for r in got if r[0] is None)
    empty = merkle.manifest(manifest_frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_trees_fold_as_they_are_built():
    nodes = [digest(str(i)) for i in range(200)]
    tree = merkle.Tree(nodes, 2)
    for at in (0, 15, 16, 199):
        changed = [*nodes[:at], digest("new"), *nodes[at + 1:]]
        assert tree.fold(at, digest("new").encode()).decode() == merkle.Tree(changed, 2).top[0] and tree.fold(at, nodes[at].encode()).decode() == tree.top[0]
