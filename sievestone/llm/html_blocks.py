"""Main text of web pages: a recurrent labeller over the page's sequence of text blocks.

A page is cut into blocks (runs of text between block-level tags, with inline tags taken out
and character references decoded).  Each block becomes a vector: hashed tags, classes
and ids of its path, hashed words, and a few measures.  A bidirectional LSTM, in numpy, reads the
whole sequence and labels every block with what stands before and after it in view.

It is trained at the start of a run on synthetic pages of many templates (this module makes them)
and on at most TRAIN_PAGES pages of the table, each of at most TRAIN_CHARS characters, whose blocks are
labelled by the meaning of HTML's own sectioning tags.  Pages are labelled in batches of bounded size; one of more
than CELLS blocks is read in stretches that hand on the network's state.  No page is shortened.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import map_rows
from sievestone.session import table

#: The bounds on pages of the table that are trained on and on their length, and how many pages are made.
TRAIN_PAGES, TRAIN_CHARS, MADE_PAGES = 256, 200_000, 1200
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 96, 32, 7, 16
EPOCHS, RATE, PAGES_A_STEP, SEED = 7, 0.01, 32, 7
#: Blocks (with padding) that the network reads at once.
CELLS = 40_000

#: HTML's block-level elements, and those without an end tag.
BLOCKS = frozenset(
    (
        "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset "
        "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
        "option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text, to the end of the page if unclosed, ...
RAW = frozenset("script style".split())
#: ... and those whose content isn't shown; one that is closed in its own tag, or never, hides nothing.
UNSEEN = frozenset("iframe noembed noframes svg template canvas audio video".split())
#: Elements that end an open one of the same kind, up to the elements that hold them.
ITEM = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW | UNSEEN}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile("[a-z]+")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of what isn't text; comments and hidden elements have no name."""
    at, unclosed = 0, set()
    while at is not None:
        start, at = at, None
        for m in _TOKEN.finditer(page, start):
            name = (m[2] or "").lower()
            if m[1] == "" and name in _END and name not in unclosed and not (name in UNSEEN and m[3].endswith("/")):
                end = _END[name].search(page, m.end())
                if end or name in RAW:
                    at = end.end() if end else len(page)
                    yield m.start(), at, "", False, ""
                    break
                unclosed.add(name)
            yield m.start(), m.end(), name, bool(m[1]), m[3] or ""


class Place:
    """Where a block stands: the innermost open element, its tag and the words of its class, id and role, and the place that holds it."""

    __slots__ = ("element", "above", "depth")

    def __init__(self, element: tuple = (), above: Place | None = None):
        self.element, self.above, self.depth = element, above, above.depth + 1 if above else 0

    @property
    def tag(self) -> str:
        return self.element[0] if self.element else ""

    @property
    def path(self) -> tuple:
        """The elements from the outermost one."""
        out, at = [], self
        while at.above:
            out.append(at.element)
            at = at.above
        return tuple(reversed(out))


def moves(places: Iterator[Place]) -> Iterator[tuple[Place, int, list[Place]]]:
    """For each place in page order: it, how many elements it shares with the one before, and its further ones from the outermost.

    An element that a page has left doesn't come again, so all moves together take time with the page's length, however deep
    its elements lie in one another.
    """
    held: list[Place] = []
    for place in places:
        new, at = [], place
        while at.depth and (at.depth > len(held) or held[at.depth - 1] is not at):
            new.append(at)
            at = at.above
        del held[at.depth :]
        new.reverse()
        held += new
        yield place, at.depth, new


def blocks(page: str | None) -> list[tuple[Place, str, float]]:
    """(place, text, share of characters in links) of each block with text, in page order."""
    out: list[tuple[Place, str, float]] = []
    stack: list[Place] = [Place()]
    open_at: dict[str, list[int]] = {}  # where in the stack elements of a tag are open
    parts: list[str] = []
    linked, in_link, at = 0, False, 0
    page = page or ""

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1], text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop(i: int) -> None:
        close()
        while len(stack) > i:
            open_at[stack.pop().tag].pop()

    def last(tag: str) -> int:
        return own[-1] if (own := open_at.get(tag)) else 0

    for start, end, tag, ends, given in tags(page):
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        if ends:
            if i := last(tag):
                pop(i)
            else:
                close()
            in_link = False
            continue
        close()
        if tag in VOID or tag in UNSEEN:
            continue
        if stack[-1].tag == "p":
            pop(len(stack) - 1)
        if tag in ITEM and tag != "p" and (i := last(tag)) > max(map(last, ITEM[tag])):
            pop(i)
        names = _PART.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(given)).lower()) if given else ()
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Place((tag, *names), stack[-1]))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


class Vectors:
    """Blocks to the network's input, with caches of bounded size."""

    def __init__(self):
        self.elements: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def element(self, names: tuple) -> np.ndarray:
        """The signed counts of an element's hashed tag and names."""
        found = self.elements.get(names)
        if found is None:
            found = np.zeros(PATH_DIMS, dtype=np.int32)
            for i, name in enumerate(names):
                for seed in (b"a", b"b", b"c"):
                    h = zlib.crc32((f"{'t' if i == 0 else 'n'}:{name}").encode(), zlib.crc32(seed))
                    found[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
            if len(self.elements) > 20_000:
                self.elements = {}
            self.elements[names] = found
        return found

    def paths(self, places: Iterator[Place]) -> Iterator[np.ndarray]:
        """For each place in page order the sum over its elements; the two innermost count whole, the others less."""
        held: list[tuple] = []
        total = np.zeros(PATH_DIMS, dtype=np.int64)
        for _, shared, new in moves(places):
            for names in held[shared:]:
                total -= self.element(names)
            del held[shared:]
            for x in new:
                held.append(x.element)
                total += self.element(x.element)
            near = sum((self.element(names) for names in held[-2:]), np.zeros(PATH_DIMS, dtype=np.int64))
            yield (near + 0.7 * (total - near)).astype(np.float32)

    def block(self, path: np.ndarray, text: str, linked: float, place: float) -> np.ndarray:
        row = np.zeros(PATH_DIMS + WORD_DIMS + MEASURES, dtype=np.float32)
        row[:PATH_DIMS] = path
        words = text.split(" ")
        known, codes = self.words, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % (2 * WORD_DIMS)
                if len(known) > 200_000:
                    known.clear()
                known[w] = h
            codes.append(h)
        counts = np.bincount(codes, minlength=2 * WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = (counts[:WORD_DIMS] - counts[WORD_DIMS:]) / np.sqrt(len(words))
        n = len(text)
        stops, commas = sum(map(text.count, ".!?")) / len(words), text.count(",") / len(words)
        row[-MEASURES:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, linked, stops, commas, text[-1] in ".!?\"')", place)
        return row

    def page(self, found: list, first: int = 0, last: int | None = None) -> np.ndarray:
        """A row for each block, or for those from `first` up to `last`."""
        n, part = len(found), found[first:last]
        paths = self.paths(b[0] for b in part)
        return np.stack([self.block(path, *b[1:], (first + i) / n) for i, (b, path) in enumerate(zip(part, paths, strict=True))]) if part else np.zeros((0, PATH_DIMS + WORD_DIMS + MEASURES), dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, p: dict, keep: bool = False, state: tuple | None = None):
    """Hidden states (batch, steps, HIDDEN) of one direction, what training needs, and the state at the end."""
    n, steps, _ = x.shape
    given = x.reshape(n * steps, -1) @ p["w"] + p["b"]
    given = given.reshape(n, steps, 4 * HIDDEN)
    h, c = state or (np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32))
    out, past = np.empty((n, steps, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        z = given[:, t] + h @ p["u"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            past.append((i, f, o, g, before, tc, h_before))
    return out, past, (h, c)


def _back(x: np.ndarray, p: dict, past: list, dout: np.ndarray) -> dict:
    n, steps, d = x.shape
    dz_all = np.empty((n, steps, 4 * HIDDEN), dtype=np.float32)
    dh, dc, du = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32), np.zeros_like(p["u"])
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h_before = past[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dz_all[:, t] = dz
        du += h_before.T @ dz
        dh, dc = dz @ p["u"].T, dc * f
    flat = dz_all.reshape(n * steps, -1)
    return {"w": x.reshape(n * steps, d).T @ flat, "u": du, "b": flat.sum(axis=0)}


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sequence backwards; padding stays at its end."""
    steps = np.arange(x.shape[1])[None]
    at = np.where(steps < sizes[:, None], sizes[:, None] - 1 - steps, steps)
    return np.take_along_axis(x, at[..., None], axis=1)


class Labeller:
    """Two LSTM directions and a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng, d = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + MEASURES
        normal = lambda *shape: rng.normal(size=shape)
        one = lambda: {
            "w": (normal(d, 4 * HIDDEN) / np.sqrt(d)).astype(np.float32),
            "u": (normal(HIDDEN, 4 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32),
            "b": np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN),
        }
        out = {"w": lambda: (normal(2 * HIDDEN) / HIDDEN).astype(np.float32), "b": lambda: np.zeros(1, dtype=np.float32)}
        self.p = {"ahead": one(), "back": one(), "out": {k: f() for k, f in out.items()}}

    def logits(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ahead = _lstm(x, self.p["ahead"])[0]
        back = _turned(_lstm(_turned(x, sizes), self.p["back"])[0], sizes)
        return np.concatenate((ahead, back), axis=2) @ self.p["out"]["w"] + self.p["out"]["b"]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
        inside = (np.arange(x.shape[1])[None] < sizes[:, None]).astype(np.float32)
        rx = _turned(x, sizes)
        ahead, past_a, _ = _lstm(x, self.p["ahead"], True)
        rback, past_b, _ = _lstm(rx, self.p["back"], True)
        both = np.concatenate((ahead, _turned(rback, sizes)), axis=2)
        dz = (_sigmoid(both @ self.p["out"]["w"] + self.p["out"]["b"]) - y) * inside / inside.sum()
        dboth = dz[..., None] * self.p["out"]["w"]
        return {
            "ahead": _back(x, self.p["ahead"], past_a, dboth[..., :HIDDEN]),
            "back": _back(rx, self.p["back"], past_b, _turned(dboth[..., HIDDEN:], sizes)),
            "out": {"w": np.einsum("nt,ntk->k", dz, both), "b": np.array([dz.sum()], dtype=np.float32)},
        }

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam over batches of pages of like length; pages are (vectors, labels)."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[i : i + PAGES_A_STEP] for i in range(0, len(pages), PAGES_A_STEP)]
        mean = {k: {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in part.items()} for k, part in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 if epoch < epochs - 2 else 0.3)
            for b in rng.permutation(len(batches)):
                step += 1
                x, sizes = padded([p[0] for p in batches[b]])
                y = np.zeros(x.shape[:2], dtype=np.float32)
                for row, (_, label) in zip(y, batches[b], strict=True):
                    row[: len(label)] = label
                for k, part in self.gradients(x, sizes, y).items():
                    for n, g in part.items():
                        m, v = mean[k][n]
                        g = np.clip(g, -1, 1)
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        self.p[k][n] = (self.p[k][n] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is main text."""
        out: list = [np.zeros(0, dtype=bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            count = len(order)
            while count > 1 and count * len(pages[order[count - 1]]) > CELLS:
                count = max(1, min(count - 1, CELLS // len(pages[order[count - 1]])))
            x, sizes = padded([pages[i] for i in order[:count]])
            for i, row in zip(order[:count], self.logits(x, sizes), strict=True):
                out[i] = row[: len(pages[i])] > 0
            order = order[count:]
        return out


    def label(self, vectors: Vectors, found: list, cells: int = CELLS) -> np.ndarray:
        """As `labels`, for one page of blocks, with no more than `cells` of them as vectors at a time."""
        n, out = len(found), np.full(len(found), self.p["out"]["b"][0], dtype=np.float32)
        places = range(0, n, cells)
        for k, (way, order, turn) in enumerate((("ahead", places, 1), ("back", reversed(places), -1))):
            state = None
            for a in order:
                h, _, state = _lstm(vectors.page(found, a, a + cells)[None, ::turn], self.p[way], state=state)
                out[a : a + cells] += (h[0] @ self.p["out"]["w"][k * HIDDEN : (k + 1) * HIDDEN])[::turn]
        return out > 0


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), sizes.max(), pages[0].shape[1]), dtype=np.float32)
    for row, p in zip(x, pages, strict=True):
        row[: len(p)] = p
    return x, sizes


#: Tags and name words that say what a part of a page is for.
SIDE_TAGS = frozenset("nav header footer aside form head title dialog menu button select textarea option".split())
SIDE_NAMES = frozenset(
    (
        "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments respond reply cookie consent notice "
        "popup modal newsletter subscribe signup login promo promoted sponsor sponsored related recommended sidebar "
        "widget complementary contentinfo share social nav navbar navigation topnav menu footer header masthead topbar "
        "toolbar tags pagination pager search copyright legal alert disqus teaser"
    ).split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content post entry story main body text".split())


def by_meaning(found: list) -> np.ndarray:
    """Labels by the tags' meaning: main text stands in article or main, and in nothing that is there for another end."""
    out = np.zeros(len(found), dtype=np.float32)
    whole, told = has_main(found), [(False, False)]  # main and side at each depth of the place
    for k, ((_, _, linked), (place, shared, new)) in enumerate(zip(found, moves(p for p, *_ in found), strict=True)):
        del told[shared + 1 :]
        for x in new:
            (tag, *names), (main, side) = x.element, told[-1]
            if tag in MAIN_TAGS or not whole and MAIN_NAMES.intersection(names):
                main, side = True, False
            elif (tag in SIDE_TAGS and not (tag == "header" and main)) or SIDE_NAMES.intersection(names):
                side = True
            told.append((main, side))
        main, side = told[-1]
        out[k] = main and not side and (linked < 0.9 or place.tag == "p")
    return out


def has_main(found: list) -> bool:
    """Whether any block lies in an element that is there for main text."""
    return any(x.tag in MAIN_TAGS for _, _, new in moves(p for p, *_ in found) for x in new)


def _words(rng: random.Random, n: int, stock: list) -> str:
    text = " ".join(rng.choice(stock) for _ in range(n))
    text = text[:1].upper() + text[1:]
    return re.sub(r"(\w) (\w)", lambda m: m[0] if rng.random() > 0.05 else f"{m[1]}, {m[2]}", text)


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a random template, and its main blocks."""
    sounds = [a + b for a in ("", *"bcdfghklmnprstvz") for b in ("a", "e", "i", "o", "u", "an", "er", "on", "é", "ü", "ст", "αν")]
    stock = ["".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    main: list[str] = []
    say = lambda a, b: _words(rng, rng.randint(a, b), stock)
    link = lambda: f'<a href="/{rng.choice(stock)}">{say(1, 3)}</a>'

    def name(*choices: str) -> str:
        c = rng.choice(choices)
        c = rng.choice((c, f"{c}-{rng.choice(('box', 'wrap', 'area', 'inner', 'list', 'slot', 'bar', 'block', 'col', 'section'))}", f"{rng.choice(('site', 'page', 'main', 'top', 'js'))}-{c}" if c not in ("content", "main") else c))
        return rng.choice((f' class="{c}"', f' id="{c}"', f" class='{c} x{rng.randint(1, 9)}'"))

    def keep(text: str) -> str:
        main.append(text)
        shown = html.escape(text, quote=False)
        if rng.random() < 0.2 and " " in shown:
            a, b = shown.split(" ", 1)
            shown = f"<{(t := rng.choice(('b', 'i', 'em', 'span')))}>{a}</{t}> {b}"
        return shown

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        return rng.choice((
            f"<nav><ul>{items}</ul></nav>",
            f"<div{name('menu', 'nav', 'navbar', 'breadcrumb')}><ul>{items}</ul></div>",
            f"<header>{say(1, 3)}<nav>{items}</nav></header>",
            f"<div role=navigation>{link()}{link()}</div>",
            f"<div role=banner>{say(1, 4)}</div>",
            f"<p{name('menu', 'nav')}>{link()} | {link()} | {link()}</p>",
        ))

    def side() -> str:
        return rng.choice((
            f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{say(3, 30)}</div>",
            f"<aside><h3>{say(1, 4)}</h3><p>{say(4, 25)}</p><ul>{''.join(f'<li>{link()}</li>' for _ in range(3))}</ul></aside>",
            f"<div{name('sidebar', 'widget', 'related', 'recommended')}><h4>{say(1, 4)}</h4><p>{say(4, 25)}</p></div>",
            f"<div{name('cookie', 'consent', 'notice', 'alert', 'popup')}><p>{say(6, 30)}</p><button>{say(1, 2)}</button></div>",
            f"<form{name('newsletter', 'search', 'signup', 'login')}><label>{say(1, 3)}</label><input name=q><p>{say(3, 12)}</p><button>{say(1, 2)}</button></form>",
            f"<div{name('share', 'social', 'tags', 'pagination')}>{link()} {link()} {link()}</div>",
            f"<div role={rng.choice(('complementary', 'search', 'alert'))}><p>{say(3, 25)}</p>{link()}</div>",
        ))

    def talk() -> str:
        by = rng.choice((lambda: f"<b>{say(1, 2)}</b>", str))
        many = "".join(f"<div{rng.choice((name('comment', 'reply'), ' class=comment-body', ' class=comment-text'))}>{by()}<p>{say(4, 40)}</p></div>" for _ in range(rng.randint(1, 5)))
        return rng.choice((f"<section{name('comments', 'disqus', 'respond')}><h3>{say(1, 3)}</h3>{many}</section>", f"<div{name('comments', 'disqus', 'responses')}>{many}</div>", f"<ol{name('comments')}>{''.join(f'<li><p>{say(4, 40)}</p></li>' for _ in range(3))}</ol>"))

    body = []
    for k in range(rng.choice((1, 2, 3, 5, 8, 14))):
        if rng.random() < 0.15 and k:
            body.append(f"<h2>{keep(say(2, 8) + rng.choice(('', '.')))}</h2>")
        words = rng.choice((1, 2, 5, 15, 40, 90))
        text = keep(say(words, words) + rng.choice((".", ".", "!", "?", "")))
        body.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}<br>", f"<p><b>{text}<br>", f"<blockquote><p>{text}</p></blockquote>", f"<div>{text}</div>")))
        if rng.random() < 0.08:
            body.append("<ul>" + "".join(f"<li>{keep(say(2, 14))}</li>" for _ in range(3)) + "</ul>")
        if rng.random() < 0.08:
            body.append(side())
    title = say(2, 9)
    head = ""
    if rng.random() < 0.8:
        main.insert(0, title)
        head = f"<h1>{html.escape(title, quote=False)}</h1>"
        head = rng.choice((head, head, f"<header>{head}</header>"))
    inner = head + rng.choice(("{}", "{}", "<section>{}</section>")).format("".join(body))
    if rng.random() < 0.1:
        inner += f"<footer>{say(1, 6)}</footer>"
    if rng.random() < 0.25:
        inner += talk()
    whole = rng.choice((
        f"<article>{inner}</article>",
        f"<article>{inner}</article>",
        f"<main>{inner}</main>",
        f"<main><article{name('post', 'story')}>{inner}</article></main>",
        f"<div{name('content', 'article', 'post', 'entry', 'story')}>{inner}</div>",
        f"<div id={rng.choice(('primary', 'content'))}><div class={rng.choice(('entry-content', 'post-body', 'article-text'))}>{inner}</div></div>",
        "",
    ))
    before = [menu() for _ in range(rng.randint(0, 2))] + [side() for _ in range(rng.randint(0, 2))]
    after = [side() for _ in range(rng.randint(0, 2))] + ([talk()] if rng.random() < 0.2 else [])
    if not whole:  # a page laid out as a table
        cells = [f"<td class={rng.choice(('left', 'right', 'nav', 'menu', 'side'))}{rng.choice(('', 'col', 'bar'))}>{link()}<br>{link()}</td>" for _ in range(rng.randint(0, 2))]
        cells.insert(rng.randint(0, len(cells)), f"<td class={rng.choice(('maintext', 'content', 'bodytext', 'main', 'text'))}>{inner}</td>")
        top = f"<tr><td class={rng.choice(('top', 'topnav', 'banner', 'header'))}>{link()} | {link()} | {link()}</td></tr>"
        whole = f"<table width=100%>{rng.choice(('', top))}<tr>{''.join(cells)}</tr></table>"
    foot = rng.choice((
        f"<div role=contentinfo>{say(2, 12)}</div>",
        f"<center><font size=1>&copy; {say(2, 9)}</font></center>",
        f"<footer>&copy; {say(2, 20)} &middot; {say(2, 9)}</footer>",
        f"<footer><p>{say(3, 15)}</p>{link()}</footer>",
        f"<div{name('footer', 'copyright', 'legal')}>{say(3, 20)}</div>",
        "",
    ))
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}{whole}{''.join(after)}{foot}</body></html>", main


def made_sample(pages: int = MADE_PAGES, seed: int = SEED) -> list[tuple[list, np.ndarray]]:
    """(blocks, labels) of made pages."""
    rng, out = random.Random(seed), []
    for _ in range(pages):
        page, main = made_page(rng)
        found, at = blocks(page), 0
        label = np.zeros(len(found), dtype=np.float32)
        for i, (place, text, _) in enumerate(found):
            if at < len(main) and text == " ".join(main[at].split()) and place.tag not in ("", "title"):
                label[i], at = 1, at + 1
        out.append((found, label))
    return out


def train(pages: list[str], made: int = MADE_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted to made pages and to the given ones, labelled by the meaning of their tags."""
    vectors = Vectors()
    sample = [(vectors.page(found), label) for found, label in made_sample(made)]
    for page in pages:
        found = blocks(page)
        if has_main(found):
            sample.append((vectors.page(found), by_meaning(found)))
    return Labeller().fit(sample, epochs)


def _make(labeller: Labeller):
    def make():
        vectors = Vectors()

        def work(pages: list) -> dict:
            found = [blocks(p) for p in pages]
            kept = labeller.labels([vectors.page(f) if len(f) <= CELLS else vectors.page([]) for f in found])
            kept = [k if len(f) <= CELLS else labeller.label(vectors, f) for f, k in zip(found, kept, strict=True)]
            return {"text": ["\n".join(t for (_, t, _), k in zip(f, own, strict=True) if k) for f, own in zip(found, kept, strict=True)]}

        return work

    return make


def extract(pages: DataFrame, labeller: Labeller, page: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns `keep` and `text`: the main blocks in page order, joined by line feeds; null or no main block: empty.

    Each row stands for itself: repeated rows and equal ids have a row each, an empty table gives none.  Extra
    columns may have any name; a page of any length is read whole.
    """
    return map_rows(pages, page, "text string", _make(labeller), list(keep))


def sampled(pages: DataFrame, rows: int = TRAIN_PAGES) -> list[str]:
    """At most `rows` pages of at most TRAIN_CHARS characters, chosen by a hash of the id."""
    pages = pages.filter(F.length("html") <= TRAIN_CHARS)
    ids = [r[0] for r in pages.filter("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows).collect()]
    found = pages.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect() if ids else []
    return [r["html"] for r in found]


def op4_recurrent_blocks(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of `pages`; null pages have an empty text."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(sampled(pages))).withColumn("n_chars", F.length("text").cast("bigint"))
