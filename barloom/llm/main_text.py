"""Main text of web pages by minimum cut.

A page is a row of text blocks. What a classifier says of a block is the capacity of its edge to the content or to the boilerplate terminal, how near two blocks stand
in the page and in its element tree the capacity of the edge between them; the minimum cut is the labelling of least cost, found by maximum flow. The classifier joins
marks of the page's author (element names, words of class, id and role) with log-odds of plain text features, which are counted over all pages: blocks with a clear
mark teach what content and boilerplate look like. Two scans of the pages, one small exchange of counts; a page's graph lives in its task and grows with its blocks."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup: elements that stand in a line, that have no end, whose content is not text, and that end an open element of the same group.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title textarea noscript template iframe noframes xmp select svg math canvas object audio video".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"p": {"table", "button", "td", "th"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
BAD_TAGS = frozenset("nav footer aside form button dialog menu header head".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar
    sidenav rail footer header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription signup login signin popup popover modal
    overlay share sharing social related recommended recommendations teaser teasers comment comments disqus replies reply respond feedback pagination pager widget widgets toolbar copyright
    legal disclaimer paywall search searchbox complementary contentinfo dialog form skip""".split())
TOP_WORDS = frozenset("header masthead banner".split())                  # no mark of boilerplate inside an article
OPEN_WORDS = frozenset("ad ads advert advertisement cookie consent gdpr notice banner header masthead topbar alert skip".split())     # an article inside them is one all the same
GOOD_WORDS = frozenset("article content main post entry story articlebody".split())
TITLED_WORDS = GOOD_WORDS - {"content", "main"}                          # with them a header is the article's
WRAPPERS = frozenset("html body".split())
CLEAR, MARKED, WORDED, PLAIN, CLIP = 12.0, 8.0, 6.0, 1.0, 3.0           # costs in natural logarithms
NEXT, SAME_PARENT, SAME_GRANDPARENT = 0.25, 1.25, 0.5                   # smoothness of neighbours, and more by nearness in the tree
UNIT = 1000

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARKS = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*(?>"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_HUMP, _WORD = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"[a-z]+")
_ENDINGS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SILENT}


class Block:
    """A run of text: what its author marked it as (CLEAR and below zero for boilerplate, above for content), its elements, and its shape."""

    __slots__ = ("text", "mark", "parent", "grandparent", "links")

    def __init__(self, text, mark, parent, grandparent, links):
        self.text, self.mark, self.parent, self.grandparent, self.links = text, mark, parent, grandparent, links


def mark_of(name: str, attributes: str, inherited: float) -> float:
    """The mark of an element inside one with the inherited mark: boilerplate is kept, content may hold boilerplate."""
    words = set()
    if "=" in attributes:
        if _HIDDEN.search(attributes):
            return -CLEAR - 1
        if name not in WRAPPERS:
            for a, b, c in _MARKS.findall(attributes):
                for token in (a or b or c).split():
                    parts = _WORD.findall(_HUMP.sub(" ", token).lower())
                    words.update(parts if not parts or parts[0] not in ("has", "with", "no", "is") else ())
    elif "hidden" in attributes and _HIDDEN.search(attributes):
        return -CLEAR - 1
    bad = words & BAD_WORDS
    if inherited > 0 or bad <= TOP_WORDS and words & TITLED_WORDS:
        bad -= TOP_WORDS
    if name in GOOD_TAGS and not bad and (inherited >= 0 or inherited == -MARKED):
        return MARKED
    if inherited < 0:
        return inherited
    if (name in BAD_TAGS and not (name == "header" and inherited > 0)) or bad:
        return -MARKED if name not in BAD_TAGS and bad <= OPEN_WORDS else -CLEAR
    if words & GOOD_WORDS:
        return max(inherited, WORDED)
    return inherited


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order. Unclosed and stray tags, and text after a tag that never ends, are read as browsers do; nothing is nested recursively."""
    blocks, text, linked, in_link = [], [], 0, False
    stack, count = [("", 0.0, 0)], Counter()                             # name, mark, number
    numbers, at, pattern, size = 0, 0, _TAG, len(page)

    def flush():
        nonlocal text, linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                _, mark, number = stack[-1]
                blocks.append(Block(whole, mark, number, stack[-2][2] if len(stack) > 1 else -1, min(1.0, linked / len(whole))))
            text, linked = [], 0

    def say(part):
        nonlocal linked
        if part:
            part = html.unescape(part)
            text.append(part)
            if in_link:
                linked += len(part.strip())

    def pop():
        count[stack.pop()[0]] -= 1

    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        kind = page[start + 1:start + 2]
        if kind in ("!", "?"):
            say(page[at:start])
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            if comment and page.startswith(("<!-->", "<!--->"), start):
                end, comment = page.find(">", start), False
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        tag = pattern.match(page, start) if kind == "/" or kind.isalpha() else None
        if tag is None and (kind.isascii() and kind.isalpha() or kind == "/" and page[start + 2:start + 3].isalpha()):
            pattern = _PLAIN_TAG                                         # a quote that never ends: from here on quotes are ordinary
            tag = pattern.match(page, start)
            if tag is None:                                              # a tag that never ends swallows the rest
                say(page[at:start])
                break
        if tag is None:
            say(page[at:start + 1])
            at = start + 1
            continue
        say(page[at:start])
        at = tag.end()
        close, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        if close:
            if name == "a":
                in_link = False
            if name == "p" and not count["p"] and name not in INLINE:
                flush()
            if count[name]:
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in SILENT:
            text.append(" " if name in ("script", "style", "title") else "")
            if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                end = _ENDINGS[name].search(page, at)
                at = end.end() if end else size
            continue
        if name in INLINE:
            if name == "a":
                in_link = True
            mark = mark_of(name, attributes, stack[-1][1]) if attributes and name not in VOID else stack[-1][1]
            if mark >= 0 or mark == stack[-1][1]:
                continue
        else:
            flush()
            if name in VOID:
                continue
            _close(stack, count, {"p"}, SCOPE["p"])
            if name in ENDS:
                _close(stack, count, ENDS[name], SCOPE.get(name, frozenset()))
            mark = mark_of(name, attributes, stack[-1][1])
        if mark != stack[-1][1]:
            flush()
        numbers += 1
        stack.append((name, mark, numbers))
        count[name] += 1
    flush()
    return blocks


def _close(stack, count, names, borders) -> None:
    """End the innermost open element of these names, unless a border stands before it."""
    if not any(count[n] for n in names):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            while len(stack) > i:
                count[stack.pop()[0]] -= 1
            return
        if stack[i][0] in borders:
            return


# --- the classifier ---------------------------------------------------------------------------------------------------------------------------------------------

def features(block: Block) -> tuple[str, ...]:
    """What a block looks like, without its place."""
    words = block.text.count(" ") + 1
    digits = sum(c.isdigit() for c in block.text[:2000]) * 5 > min(len(block.text), 2000)
    return (f"words {min(words.bit_length(), 7)}", f"links {math.ceil(block.links * 3)}", f"ends {block.text[-1] in '.!?…:;。！？\"”»)'}",
            f"rights {'©' in block.text or 'rights reserved' in block.text.lower()}", f"digits {digits}", f"bars {block.text.count('|') + block.text.count('·') > 0}")


def _count(batches):
    """(feature, content blocks, boilerplate blocks) of a part, of blocks with a clear mark."""
    good, bad = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for b in blocks_of(page or ""):
                if b.mark:
                    (good if b.mark > 0 else bad).update(("", *features(b)))
    names = sorted(good.keys() | bad.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([good[n] for n in names], pa.int64()), pa.array([bad[n] for n in names], pa.int64())], names=["feature", "good", "bad"])


def odds(pages: DataFrame) -> dict[str, float]:
    """Log-odds of each feature for content, from all marked blocks of all pages; none without blocks of both kinds."""
    counts = {r.feature: (r.good, r.bad) for r in pages.select("html").mapInArrow(_count, "feature string, good bigint, bad bigint").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}    # some thirty features
    good, bad = counts.pop("", (0, 0))
    if not good or not bad:
        return {}
    return {f: math.log((g + 1) / (good + 8)) - math.log((b + 1) / (bad + 8)) for f, (g, b) in counts.items()}


def cost(block: Block, weights: dict[str, float]) -> float:
    """What it costs to call a block boilerplate, less what it costs to call it content."""
    learned = sum(weights.get(f, 0.0) for f in features(block)) / 2          # features that say the same count half
    plain = PLAIN if block.links < 2 / 3 else -2 * PLAIN
    return block.mark + plain + max(-CLIP, min(CLIP, learned))


# --- the cut ----------------------------------------------------------------------------------------------------------------------------------------------------

def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in the page, and blocks of one element with others between them."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            near = SAME_PARENT if a.parent == b.parent or a.grandparent == b.grandparent else SAME_GRANDPARENT if a.grandparent == b.parent or a.parent == b.grandparent else 0
            out.append((i - 1, i, round((NEXT + near) * UNIT)))
        before = last.get(b.grandparent)
        if before is not None and before < i - 1:
            out.append((before, i, round(SAME_GRANDPARENT * UNIT)))
        last[b.grandparent] = i
    return out


def cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Sides of a minimum cut: True for nodes held by the source, where terminal i > 0 is its edge from the source and < 0 its edge to the sink; of several minimum
    cuts the one with most nodes on the source's side.

    A node whose terminal outweighs all its other edges is on that side in every minimum cut (or can be, if equal); its edges go over to its neighbours' terminals. What
    is left is solved by maximum flow along shortest paths, a layer of them at a time."""
    n, side = len(terminals), [None] * len(terminals)
    left, links = list(terminals), [{} for _ in terminals]
    for a, b, w in edges:
        if w > 0 and a != b:
            links[a][b] = links[a].get(b, 0) + w
            links[b][a] = links[b].get(a, 0) + w
    reach = [sum(x.values()) for x in links]
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and (left[i] >= reach[i] or -left[i] > reach[i]):
            side[i] = left[i] >= reach[i]
            for j, w in links[i].items():
                if side[j] is None:
                    left[j] += w if side[i] else -w
                    reach[j] -= w
                    waiting.append(j)
            for j in links[i]:
                links[j].pop(i, None)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return side
    room = {i: dict(links[i]) for i in rest}
    while True:                                                          # distances to the sink, then all paths along them
        far, todo = {i: 1 for i in rest if left[i] < 0}, deque(i for i in rest if left[i] < 0)
        while todo:
            i = todo.popleft()
            for j in room[i]:
                if j not in far and room[j][i] > 0:
                    far[j] = far[i] + 1
                    todo.append(j)
        starts = [i for i in rest if left[i] > 0 and i in far]
        if not starts:
            break
        todo_edges = {i: list(room[i]) for i in rest}
        for s in starts:
            path = [s]
            while path and left[s] > 0:
                i = path[-1]
                if left[i] < 0:
                    push = min([left[s], -left[i], *(room[a][b] for a, b in zip(path, path[1:], strict=False))])
                    left[s] -= push
                    left[i] += push
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= push
                        room[b][a] += push
                    path = [s]
                    continue
                options = todo_edges[i]
                while options and not (room[i][options[-1]] > 0 and far.get(options[-1], -1) == far[i] - 1):
                    options.pop()
                if options:
                    path.append(options[-1])
                else:
                    path.pop()
                    if path:
                        todo_edges[path[-1]].pop()
    for i in rest:
        side[i] = i not in far
    return side


def extract(page: str, weights: dict[str, float]) -> str:
    """The content blocks of a page, one a line."""
    blocks = blocks_of(page)
    held = cut([round(cost(b, weights) * UNIT) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, h in zip(blocks, held, strict=True) if h)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    A null or empty page and one without content have the empty text. White space of any kind inside a block is one space, line breaks of the markup included; character
    references are decoded once. Repeated rows each get their own result; ids and urls may be null. A very long page is one graph in one task. Without pages that mark
    both content and boilerplate the marks and fixed costs decide alone. Of equal cuts the one with more content is taken. An empty table gives no rows; other columns
    are left out, whatever their names."""
    weights = pages.sparkSession.sparkContext.broadcast(odds(pages))             # some thirty numbers

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = [extract(p or "", weights.value) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
