"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block has a vector of
hashed tag-path words, a vector of hashed text words and a few densities.  A
bidirectional LSTM in numpy reads the whole sequence and says of every block
whether it belongs to the article.  It is trained on a bounded sample of pages,
whose blocks are labelled by what their markup says, and on pages drawn up here
whose parts are known.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import nets
from tesselark.llm import text as tx

#: Pages in the training sample, pages drawn up, words that fill those, and most blocks of a page to train on.
SAMPLE, DRAWN, WORDS, TRAINED_BLOCKS = 160, 320, 20_000, 400
#: Characters of a page to train on.
PAGE_CHARS = 1 << 18
#: Words whose vectors are looked up at a time.
TOGETHER = 1 << 20
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN, NUMBERS = 1024, 512, 12, 6, 14, 7

_TAG = re.compile(r"<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_PLAIN = re.compile(r"[^>\"']*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements whose own words are no text of the page; a block that starts in one ends it, as none can stand inside.
_SILENT = frozenset("svg select textarea iframe".split())
#: An element of the first kind ends open elements of the second when it starts, unless one of the third lies between.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS, _BOXES = ("ul", "ol", "table", "dl"), ("article", "section", "div", "td", "li", "blockquote")
_BLOCKS = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")


class Node:
    """An open element: its tag and names as path words, and the element around it."""

    __slots__ = ("count", "depth", "number", "parent", "words")

    def __init__(self, words: tuple[str, ...], parent: Node | None):
        self.words, self.parent, self.number = words, parent, -1
        self.depth = parent.depth + 1 if parent else 0
        self.count = len(words) + (parent.count if parent else 0)


class Block:
    """Text of a leaf block, the element it stands in and how much of it is links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: float):
        self.text, self.node, self.linked = text, node, linked

    @property
    def path(self) -> tuple[str, ...]:
        """All words from the page's root down to the block."""
        found, node = [], self.node
        while node:
            found.append(node.words)
            node = node.parent
        return tuple(w for words in reversed(found) for w in words)


class _Tags:
    """The tags of a page in order: (start, end, closes, name or None for what is no element, attributes).

    A tag ends at the first > outside quotes, or, where a quote never closes, at
    the first > of all.  Places from which no end was found are remembered, so
    the page is read a bounded number of times.
    """

    def __init__(self, page: str):
        self.page, self.dead, self.broken = page, set(), False

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag; -1 without any."""
        page, here, seen = self.page, at, []
        while here not in self.dead:
            seen.append(here)
            here = _PLAIN.match(page, here).end()
            if here == len(page):
                break
            if page[here] == ">":
                return here
            here = page.find(page[here], here + 1) + 1
            if not here:
                break
        self.dead.update(seen)
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            m = None if self.broken else _TAG.match(page, at)
            if m:
                closes, name, rest, end = m.group(1), m.group(2), m.group(3), m.end()
            elif named := _NAME.match(page, at):
                self.broken = True  # from here on the patient way, which a broken tag can't slow down
                end = self._end(named.end()) + 1
                if not end:  # the page ends inside the tag
                    yield at, len(page), False, None, ""
                    return
                closes, name, rest = named.group(1), named.group(2), page[named.end() : end - 1]
            elif page.startswith("<!--", at):
                empty = next((x for x in ("<!-->", "<!--->") if page.startswith(x, at)), None)
                last = None if empty else _COMMENT_END.search(page, at + 4)
                end = at + len(empty) if empty else (last.end() if last else len(page))
                yield at, end, False, None, ""
                at = end
                continue
            elif page.startswith(("<!", "<?", "</"), at):
                end = (page.find(">", at) + 1) or len(page)
                yield at, end, False, None, ""
                at = end
                continue
            else:
                at += 1
                continue
            name = name.lower()
            if name in _RAW_END and not closes:
                last = None if rest.rstrip().endswith("/") else _RAW_END[name].search(page, end)
                if last:
                    stop = page.find(">", last.end()) + 1
                    end = stop or len(page)
                elif not rest.rstrip().endswith("/"):
                    end = len(page)
                name = None
            yield at, end, bool(closes), name, rest
            at = end


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments, drawings and form fields are no text.

    Work and memory grow with the page's length, however deep its elements lie.
    """
    found: list[Block] = []
    stack: list[tuple[str, Node]] = []
    places: dict[str, list[int]] = {}  # of each tag the places in the stack
    root = Node((), None)
    parts: list[str] = []
    where, linked, silent = None, 0, 0

    def flush() -> None:
        nonlocal where, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append(Block(text, where or root, min(1.0, linked / len(text))))
        parts.clear()
        where, linked = None, 0

    def say(raw: str) -> None:
        nonlocal where, linked
        if not raw or silent:
            return
        if not raw.isspace():
            where = where or (stack[-1][1] if stack else root)
            if places.get("a"):
                linked += len(raw.strip())
        parts.append(raw)

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close_from(i: int) -> None:
        nonlocal silent
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            silent -= tag in _SILENT

    at = 0
    for start, end, closes, tag, rest in _Tags(page):
        say(page[at:start])
        at = end
        if tag is None:
            continue
        first_silent = min(places[t][0] for t in _SILENT if places.get(t)) if silent else len(stack)
        goes_out = tag in _BLOCKS or (closes and bool(places.get(tag)) and places[tag][-1] < first_silent)
        if tag not in _INLINE and tag not in _SILENT and (goes_out or not silent):
            flush()
        if closes:
            if places.get(tag):
                close_from(places[tag][-1])
            continue
        if tag in _BLOCKS:
            close_from(first_silent)
        if tag in _VOID:
            if tag in ("br", "hr"):
                say(" ")
            continue
        if tag not in _INLINE:  # a block ends an open paragraph
            if (i := last(("p",))) > last(_BOXES):
                close_from(i)
            for other in _ENDS.get(tag, ()):
                if (i := last((other,))) > last(_LISTS):
                    close_from(i)
        if not rest.rstrip().endswith("/"):
            names = " ".join(next(filter(None, g), "") for g in _NAMES.findall(rest)).lower()
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, Node(("<" + tag, *_PART.findall(names)), stack[-1][1] if stack else root)))
            silent += tag in _SILENT
    say(page[at:])
    flush()
    return found


#: Path words that say a block is not of the article (fixed values).
AWAY = frozenset(
    "<nav <header <footer <aside <form <button <title nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement sponsor sponsored promo banner"
    " cookie cookies consent notice alert popup modal comment comments reply replies disqus respond share sharing social related recommended breadcrumb breadcrumbs newsletter"
    " subscribe subscription login signup signin search form pagination pager copyright widget tags toolbar skip".split()
)
#: Path words of the article itself (fixed values).
ARTICLE = frozenset("<article <main article main content post entry story body text".split())


def marked(blocks: list[Block]) -> list[int]:
    """1 for the blocks that the markup itself places in the article, for training."""
    inside = any("<article" in b.path or "<main" in b.path for b in blocks)
    out = []
    for b in blocks:
        starts = [i for i, w in enumerate(b.path) if (w in ("<article", "<main") if inside else w in ARTICLE)]
        rest = b.path[starts[-1] + 1 :] if starts else ()
        # a heading's own header element may stand inside an article
        away = [w for w in b.path if w in AWAY and not (w == "<header" and w in rest)]
        wordy = inside or len(b.text.split()) >= 3
        out.append(int(bool(starts) and not away and wordy))
    return out


def drawn_page(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[str, int]]]:
    """A made-up page and, for each of its blocks in order, whether it is of the article.

    Layouts, class names and the order of the parts vary; so do sizes.
    """
    truth: list[tuple[str, int]] = []

    def say(n: int, keep: int, link: bool = False) -> str:
        s = " ".join(rng.choice(words) for _ in range(max(1, n)))
        truth.append((s, keep))
        s = html.escape(s)
        return f'<a href="/x">{s}</a>' if link else s

    def attribute(names: str) -> str:
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names.split())}{rng.choice(("", "", "-inner", " box", "-1"))}"'

    def links(names: str, tag: str) -> str:
        items = "".join(f"<li>{say(rng.randint(1, 3), 0, True)}</li>" for _ in range(rng.randint(3, 8)))
        return f"<{tag}{attribute(names) if tag == 'div' or rng.random() < 0.5 else ''}><ul>{items}</ul></{tag}>"

    def notes(names: str, tag: str, most: int = 3, size: tuple[int, int] = (3, 30)) -> str:
        p = rng.choice(("p", "p", "div", "span"))
        body = "".join(f"<{p}>{say(rng.randint(*size), 0)}</{p}>" if p != "span" else say(rng.randint(*size), 0) for _ in range(rng.randint(1, most) if p != "span" else 1))
        head = f"<h3>{say(rng.randint(1, 4), 0)}</h3>" if rng.random() < 0.4 else ""
        return f"<{tag}{attribute(names) if tag == 'div' or rng.random() < 0.5 else ''}>{head}{body}</{tag}>"

    def form() -> str:
        return f"<form action='/s'{attribute('search newsletter subscribe login')}><p>{say(rng.randint(2, 12), 0)}</p><input name=q><button>{say(1, 0)}</button></form>"

    def article() -> str:
        out = [f"<h1>{say(rng.randint(2, 10), 1)}</h1>"]
        if rng.random() < 0.2:
            out[0] = f"<header>{out[0]}</header>"
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            n = rng.choice((rng.randint(1, 4), rng.randint(5, 40), rng.randint(20, 120)))
            if kind < 0.75:
                out.append(f"<p>{say(n, 1)}</p>" if rng.random() < 0.8 else f"<p><b>{say(n, 1)}<br>")
            elif kind < 0.83:
                out.append(f"<h2>{say(rng.randint(1, 6), 1)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{say(rng.randint(1, 12), 1)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{say(n, 1)}</blockquote>")
            else:
                out.append(rng.choice((lambda: notes("ad advert promo sponsored", "div"), lambda: notes("related share social newsletter", "aside"), form))())
        return "".join(out)

    top = [lambda: links("nav menu navbar breadcrumb", rng.choice(("nav", "div"))), lambda: notes("header masthead banner", rng.choice(("header", "div")))]
    extra = [lambda: notes("ad ads advert banner sponsor", "div"), lambda: notes("cookie notice alert consent", "div"), lambda: notes("sidebar widget related", rng.choice(("aside", "div")), 4), form]
    end = [lambda: notes("comments comment reply disqus", rng.choice(("section", "div")) if rng.random() < 0 else "div", 5, (2, 60)), lambda: links("related tags share social", "div"), lambda: notes("sidebar", "aside", 4)]
    head = f"<!DOCTYPE html><html><head><title>{html.escape(' '.join(rng.choice(words) for _ in range(4)))}</title></head><body>"
    truth.append(("", -1))  # the title's block
    out = [head]
    for part in top + extra:
        if rng.random() < 0.55:
            out.append(part())
    opening, closing = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<div class="entry-content">', "</div>"), ('<div class="article-body">', "</div>")))
    out += [opening, article(), closing]
    for part in end + extra:
        if rng.random() < 0.4:
            out.append(part())
    out.append(notes("footer copyright bottom", rng.choice(("footer", "footer", "div")), 2))
    return "".join(out), truth


def drawn(count: int, words: list[str], seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of made-up pages; equal blocks of a page count as article if one of them does."""
    rng, found = random.Random(seed), []
    for _ in range(count):
        page, truth = drawn_page(rng, words)
        want: dict[str, int] = {}
        for s, keep in truth:
            want[s] = keep if s not in want else max(keep, want[s])
        blocks = blocks_of(page)
        labels = [max(0, want.get(b.text, 0)) for b in blocks]
        found.append((blocks, labels))
    return found


def vectors(pages: list[list[Block]]) -> dict[str, np.ndarray]:
    """Elements with hashed path words, hashed text words and densities of the blocks of some pages, end to end.

    An element's words are kept once, however many blocks stand in it.
    """
    blocks = [b for p in pages for b in p]
    nodes: list[Node] = []
    for b in blocks:
        chain, node = [], b.node
        while node and node.number < 0:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            node.number = len(nodes)
            nodes.append(node)
    at = np.array([b.node.number for b in blocks], np.int64)
    parent = np.array([n.parent.number if n.parent else -1 for n in nodes], np.int64)
    depth = np.array([n.depth for n in nodes], np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]
    for n in nodes:
        n.number = -1
    bucket = {w: zlib.crc32(w.encode()) % PATH_BUCKETS for w in {w for n in nodes for w in n.words}}
    own = np.array([bucket[w] for n in nodes for w in n.words], np.int16)
    texts = tx.texts_of(pa.array([b.text for b in blocks], pa.string()))
    data, ends = tx.bytes_of(texts)
    low = tx.lowered(data)
    starts, stops, owner = tx.words_of(low, ends)
    words = (tx.span_hashes(low, starts, stops) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    count = np.bincount(owner, minlength=len(blocks))
    size = np.maximum(np.diff(ends), 1)

    def rate(flags: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flags)])
        return (s[ends[1:]] - s[ends[:-1]]) / size

    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages]) if blocks else np.zeros(0)
    numbers = np.stack([np.log1p(count) / 4, np.array([b.linked for b in blocks]), rate((data == 46) | (data == 44)) * 10, rate((data >= 65) & (data <= 90)) * 5, place, (count <= 2) * 1.0, np.ones(len(blocks))], 1)
    tree = {"path": own, "own_n": np.array([len(n.words) for n in nodes], np.int64), "parent": parent, "levels": levels, "at": at, "path_n": np.array([b.node.count for b in blocks], np.int64)}
    return tree | {"word": words, "word_n": count, "numbers": numbers.astype(nets.F32)}


def _sums(table: np.ndarray, index: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each row the sum of its ``count`` looked-up vectors."""
    ends = np.cumsum(count)
    out = np.zeros((len(count), table.shape[1]))
    i = 0
    while i < len(count):  # so many rows at a time that the looked-up vectors stay small; a long row is one step
        first = int(ends[i] - count[i])
        j = max(i + 1, int(np.searchsorted(ends, first + TOGETHER, "right")))
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[index[first : ends[j - 1]]], 0, dtype=np.float64)])
        stop = ends[i:j] - first
        out[i:j] = sums[stop] - sums[stop - count[i:j]]
        i = j
    return out


def _mean(sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(count, 1)[:, None]).astype(nets.F32)


def path_means(table: np.ndarray, v: dict) -> np.ndarray:
    """The mean vector of all path words of each block: sums run down the tree of elements, level by level."""
    sums = _sums(table, v["path"], v["own_n"])
    for level in v["levels"]:
        sums[level] += sums[v["parent"][level]]
    return _mean(sums[v["at"]], v["path_n"])


def path_gradient(v: dict, d: np.ndarray) -> np.ndarray:
    """The gradient of the path table from that of :func:`path_means`: the way back up."""
    sums = np.zeros((len(v["own_n"]), d.shape[1]))
    np.add.at(sums, v["at"], d / np.maximum(v["path_n"], 1)[:, None])
    for level in reversed(v["levels"]):
        np.add.at(sums, v["parent"][level], sums[level])
    g = np.zeros((PATH_BUCKETS, d.shape[1]), nets.F32)
    np.add.at(g, v["path"], np.repeat(sums, v["own_n"], 0))
    return g


class Labeller:
    """Embeddings, both LSTM directions and the output layer."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 2) -> Labeller:
        rng = np.random.default_rng(seed)
        inputs = PATH_DIM + WORD_DIM + NUMBERS
        p = {"path": rng.normal(0, 0.5, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "d": rng.normal(0, 0.1, inputs), "ob": np.zeros(1)}
        for k in "fb":
            p[k + "w"] = rng.normal(0, inputs**-0.5, (inputs, 4 * HIDDEN))
            p[k + "u"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            p[k + "o"] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        return cls({k: v.astype(nets.F32) for k, v in p.items()})

    def _inputs(self, v: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([path_means(self.p["path"], v), _mean(_sums(self.p["word"], v["word"], v["word_n"]), v["word_n"]), v["numbers"]], 1)

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logit of every block; pages of different lengths share a batch under a mask."""
        steps, rows = int(sizes.max()), len(sizes)
        page = np.repeat(np.arange(rows), sizes)
        step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = (np.arange(steps)[:, None] < sizes).astype(nets.F32)
        grid = np.zeros((steps, rows, x.shape[1]), nets.F32)
        grid[step, page] = x
        logits, cache = x @ self.p["d"] + self.p["ob"], {"step": step, "page": page, "grid": grid, "mask": mask}
        for k in "fb":
            g, m = (grid, mask) if k == "f" else (grid[::-1], mask[::-1])
            states, kept = nets.lstm_forward(g @ self.p[k + "w"], m, self.p[k + "u"], keep)
            h = states[1:] if k == "f" else states[1:][::-1]
            logits = logits + h[step, page] @ self.p[k + "o"]
            cache[k] = (states, kept, h)
        return logits, cache

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are of the article."""
        found = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        i = 0
        while i < len(order):
            j, total = i, 0
            while j < len(order) and (j == i or (j - i + 1) * len(pages[order[j]]) <= 8192):
                j += 1
            part = order[i:j]
            v = vectors([pages[k] for k in part])
            sizes = np.array([len(pages[k]) for k in part])
            yes = self.run(self._inputs(v), sizes)[0] > 0
            for k, own in zip(part, np.split(yes, np.cumsum(sizes)[:-1]), strict=True):
                found[k] = own
            i = j
        return found


def fit(examples: list[tuple[list[Block], list[int]]], steps: int = 240, batch: int = 24, seed: int = 2) -> Labeller:
    """Backpropagation through the blocks of whole pages."""
    net, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    examples = [e for e in examples if e[0]]
    optimiser = nets.Adam(net.p, 0.02)
    for step in range(steps if examples else 0):
        part = [examples[i] for i in rng.integers(0, len(examples), batch)]
        v, y = vectors([b for b, _ in part]), np.array([x for _, labels in part for x in labels], nets.F32)
        sizes = np.array([len(b) for b, _ in part])
        x = net._inputs(v)
        logits, c = net.run(x, sizes, True)
        d = ((nets.sigmoid(logits) - y) / len(y)).astype(nets.F32)
        g = {"d": x.T @ d, "ob": d.sum(keepdims=True)}
        dx = d[:, None] * net.p["d"]
        for k in "fb":
            states, kept, h = c[k]
            g[k + "o"] = h[c["step"], c["page"]].T @ d
            ds = np.zeros_like(h)
            ds[c["step"], c["page"]] = d[:, None] * net.p[k + "o"]
            d_in, g[k + "u"] = nets.lstm_backward(ds if k == "f" else ds[::-1], states, kept, net.p[k + "u"])
            d_in = d_in if k == "f" else d_in[::-1]
            flat = d_in[c["step"], c["page"]]
            g[k + "w"] = x.T @ flat
            dx = dx + flat @ net.p[k + "w"].T
        g["path"], g["word"], n = path_gradient(v, dx[:, :PATH_DIM]), np.zeros_like(net.p["word"]), v["word_n"]
        np.add.at(g["word"], v["word"], np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(n, 1)[:, None], n, 0))
        optimiser.step(g, max(0.05, 1 - step / steps))
    return net


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", each: int = SAMPLE, made_up: int = DRAWN, words: int = WORDS, most_blocks: int = TRAINED_BLOCKS) -> Labeller:
    """A labeller fitted on at most ``each`` pages, chosen by a hash of their ids, and ``made_up`` drawn ones.

    Of pages that share an id the one with the least hash counts; pages of more
    than PAGE_CHARS characters or ``most_blocks`` blocks are not trained on.  The drawn pages are filled
    with at most ``words`` words of the sample, chosen by a hash.
    """
    ids = [r[0] for r in pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(each).collect()]
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    rows = own.where(F.col("id").isin(ids)).groupBy("id").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html")).where(F.length("html") <= PAGE_CHARS).orderBy("id").collect() if ids else []
    real = [b for b in (blocks_of(r[1]) for r in rows) if len(b) <= most_blocks]
    filling = sorted({w for p in real for b in p for w in b.text.split()}, key=lambda w: (zlib.crc32(w.encode()), w))[:words] or ["word", "other", "third"]
    return fit([(b, marked(b)) for b in real] + drawn(made_up, filling))


def extract(pages: DataFrame, net: Labeller, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text (article blocks joined by two newlines) and n_chars of each page.

    Reads the whole html, in time that grows with its length, however deep or
    broken it is; null counts as empty.  Character references are decoded, white
    space inside a block becomes one space.  A page without article blocks has
    the empty text.  Repeated rows and null columns stay; an empty table gives
    no rows; other columns are ignored.  ``keep`` may not hold text or n_chars.
    """
    if {"text", "n_chars"} & set(keep) or len(set(keep)) < len(keep):
        raise ValueError("keep must name different columns, other than text and n_chars")
    own = pages.select(*keep, F.col(html_col).alias("__html"))
    sent = pages.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(sent.value)
        for batch in batches:
            raw = tx.texts_of(batch.column(len(keep)))
            for i, j in tx.steps(raw):
                found = [blocks_of(h.decode()) for h in raw.slice(i, j - i).to_pylist()]
                text = ["\n\n".join(b.text for b, y in zip(p, yes, strict=True) if y) for p, yes in zip(found, net.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))
