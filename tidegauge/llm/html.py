"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, with the tags around
them. Features are the ancestors' tags, what their class, id and role words hint at, by distance, and the text's
length, links, punctuation and signs. The field has a weight for each feature and label and one for each pair of
neighbouring labels; it is trained by gradient ascent of the conditional likelihood (forward-backward) on
labelled pages and decoded by Viterbi. Labelled pages come from labelled_pages(), a generator of page
layouts, with wrappers whose names mislead: the tables have no labels. Their number is the stated bound of the
training set. Hand-written layouts of other make, which training never sees, measure it (tests/llm/layouts.py).

Cases: null html counts as empty; pages without text, or whose every block is furniture, give an empty
text; unclosed, stray and broken tags never fail; scripts, styles and comments are skipped as raw text;
a page of any length, nesting or number of broken tags is processed whole, in time in proportion to its length; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import lean, slices

#: Tags that stay inside a block, tags without an end, tags whose content isn't text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea select iframe object noembed noframes svg math audio video canvas".split())
#: Tags that end an open one of the same kind.
AGAIN = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
FLOW = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: What words of class, id and role attributes hint at.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "head": "header masthead topbar logo branding tagline hero site",
    "foot": "footer foot copyright legal colophon contentinfo imprint bottom",
    "side": "sidebar aside widget related recommended rail complementary secondary trending popular more teaser",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall dialog privacy warning",
    "form": "form subscribe subscription newsletter search login signup signin register contact feedback poll",
    "comment": "comment comments reply replies respond discussion discuss disqus reader readers thread review reviews",
    "share": "share sharing social follow tags tag meta byline author",
    "main": "content article post entry story main body text maincontent articlebody richtext prose",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Tags that features know: any other name is an ancestor without a feature.
KNOWN = FLOW | frozenset("article body button caption center dd details dt figcaption html label legend li menu option section summary tbody td tfoot th thead tr".split())
#: Open tags beyond which none is ended by another of its kind.
BARRIERS = frozenset("ul ol dl table div section article".split())


class Block:
    """A run of text: its innermost block tag, the distinct block tags and hints around it, and hints by distance."""

    __slots__ = ("text", "linked", "tag", "tags", "hints", "near")

    def __init__(self, text: str, linked: int, tag: str, tags: tuple[str, ...], hints: tuple[str, ...], near: tuple[str, ...] = ()):
        self.text, self.linked, self.tag, self.tags, self.hints, self.near = text, linked, tag, tags, hints, near


class Open:
    """Open tags. Each knows what features ask of all tags around it, so that a block costs the same at any depth, and where
    the last barrier stands; the places of each name are kept, so that a tag which ends nothing costs no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, str, tuple[str, ...], tuple[str, ...], tuple[tuple[str, ...], ...]]] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple:
        return self.stack[-1] if self.stack else ("", -1, "", (), (), ())

    def push(self, name: str, hints: tuple[str, ...]) -> None:
        _, barrier, tag, tags, known, recent = self.top()
        if hints and not set(hints) <= set(known):
            known = tuple(dict.fromkeys(known + hints))
        if name not in INLINE:
            tag, recent = name, (hints, *recent[:3])
            if name in KNOWN and name not in tags:
                tags = (*tags, name)
        at = len(self.stack)
        self.stack.append((name, at if name in BARRIERS else barrier, tag, tags, known, recent))
        self.places.setdefault(name, []).append(at)

    def last(self, names: tuple[str, ...], above: int = -1) -> int | None:
        found = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return found if found > above else None

    def cut(self, at: int) -> list[str]:
        """Ends the tags from a place on; their names."""
        gone = [e[0] for e in self.stack[at:]]
        for name in gone:
            self.places[name].pop()
        del self.stack[at:]
        return gone


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order, white space collapsed and character references decoded.

    Every character is passed a fixed number of times. A tag ends at the first > outside quotes; once a quote stays open to
    the page's end, quotes count no more from there on."""
    out: list[Block] = []
    tags = Open()
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, _, tag, around, hints, recent = tags.top()
                near = tuple(f"{d} {h}" for d, x in enumerate(recent) for h in x)  # by distance: names further out often speak of the whole site
                out.append(Block(text, linked, tag, around, hints, near))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    endless: set[str] = set()
    while at < size:
        start = page.find("<", at)
        if start < 0 or start == size - 1:
            add(page[at:])
            break
        sign = page[start + 1]
        if sign in "!?" or sign == "/" and (start > last or not _NAME.match(page, start + 2)):
            add(page[at:start])
            mark, shift = ("-->", 4) if page.startswith("<!--", start) else (">", 2)
            end = page.find(mark, start + shift) if start <= last else -1
            at = size if end < 0 else end + len(mark)
            continue
        close = sign == "/"
        m = _NAME.match(page, start + 1 + close) if start <= last else None
        if m is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        whole = _QUOTED_END.match(page, m.end()) if quotes else None
        quotes = quotes and whole is not None
        at = whole.end() if whole else page.find(">", m.end()) + 1
        if not at:  # the last > stands inside the quotes before
            add(page[start:])
            break
        name, attributes = m[0].lower(), page[m.end() : at - 1]
        if close:
            if name not in INLINE:
                flush()
            elif name == "a":
                links = max(0, links - 1)
            k = tags.last((name,))
            if k is not None and "a" in tags.cut(k)[1:]:
                links = 0
            continue
        if name in RAW:
            if name != "title":
                flush()
            end = None
            if name not in endless and (not attributes.endswith("/") or name in ("script", "style", "textarea")):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if end is None:
                    endless.add(name)
            at = end.end() if end else (size if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name not in INLINE:
            flush()
            k = tags.last(AGAIN.get(name, ()) + (("p",) if name in FLOW else ()), tags.top()[1])
            if k is not None and "a" in tags.cut(k):
                links = 0
        if name in VOID:
            continue
        hints = tuple(dict.fromkeys(h for v in _ATTRIBUTE.findall(attributes) for w in _WORD.findall(v) if (h := _HINT.get(w.lower())))) if attributes else ()
        tags.push(name, hints)
        links += name == "a"
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    rows = []
    for b in blocks:
        words = b.text.count(" ") + 1
        size = "1" if words < 3 else "3" if words < 6 else "6" if words < 12 else "12" if words < 25 else "25"
        share = b.linked / max(1, len(b.text))
        link = "0" if share < 0.05 else "1" if share < 0.4 else "2" if share < 0.9 else "3"
        row = [f"in {t}" for t in dict.fromkeys(b.tags)] + [f"hint {h}" for h in b.hints] + [f"near {h}" for h in b.near]
        row += [f"tag {b.tag or '-'}", f"last hint {b.hints[-1] if b.hints else '-'}", f"size {size}", f"link {link}", f"size link {size} {link}", "bias"]
        row += [f"hints {a} {c}" for a, c in zip(b.hints, b.hints[1:], strict=False)]
        row += [name for name, yes in (("stop", b.text[-1] in ".!?…\"”»"), ("comma", "," in b.text), ("sign", any(c in b.text for c in "©|·»›®™")), ("digits", sum(map(str.isdigit, b.text)) > len(b.text) / 5)) if yes]
        main = "main" in b.hints or "article" in b.tags or "main" in b.tags
        row.append(f"main {main} {size} {link}")
        rows.append(row)
    return rows


class Field:
    """Weights of features by label (0 furniture, 1 article) and of pairs of neighbouring labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, pairs

    def potentials(self, rows: list[list[str]]) -> np.ndarray:
        ids = [[i for f in row if (i := self.index.get(f)) is not None] for row in rows]
        return np.stack([self.weights[x].sum(0) for x in ids])

    def labels(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        scores = self.potentials(rows).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            x, y = (a + p00, b + p10), (a + p01, b + p11)
            back.append((x[1] > x[0], y[1] > y[0]))
            a, b = max(x) + s0, max(y) + s1
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def trained(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Adam on the mean conditional log-likelihood of whole label sequences; all pages advance together."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    n, longest = len(pages), max(len(rows) for rows, _ in pages)
    where = np.array([p * longest + t for p, (rows, _) in enumerate(pages) for t, row in enumerate(rows) for _ in row])
    what = np.array([index[f] for rows, _ in pages for row in rows for f in row])
    gold, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (rows, labels) in enumerate(pages):
        gold[p, : len(rows)], live[p, : len(rows)] = labels, True
    w, pairs = np.zeros((len(index), 2)), np.zeros((2, 2))
    m, v = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for step in range(1, rounds + 1):
        scores = np.stack([np.bincount(where, w[what, k], n * longest) for k in (0, 1)], -1).reshape(n, longest, 2)
        alpha, beta = scores.copy(), np.zeros_like(scores)
        for t in range(1, longest):
            alpha[:, t] = np.where(live[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, axis=1) + scores[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(pairs[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None], axis=2), 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        state = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        both = np.exp(alpha[:, :-1, :, None] + pairs + (scores + beta)[:, 1:, None] - total[:, None, None, None]) * live[:, 1:, None, None]
        diff = np.eye(2)[gold] * live[..., None] - state
        gw = np.stack([np.bincount(what, diff.reshape(-1, 2)[where, k], len(index)) for k in (0, 1)], -1) / n - decay * w
        seen = np.eye(2)[gold[:, :-1]][..., None] * np.eye(2)[gold[:, 1:]][:, :, None] * live[:, 1:, None, None]
        g = np.concatenate([gw.reshape(-1), ((seen - both).sum((0, 1)) / n - decay * pairs).reshape(-1)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[: w.size].reshape(w.shape), pairs + move[w.size :].reshape(2, 2)
    return Field(index, w, pairs)


def labelled_pages(count: int, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """Pages of many layouts with their article blocks, from a seeded generator."""
    rng = np.random.default_rng(seed)
    syllables = "ba con de er fi gra hu in ja ko lu men no or pa que ri sta ti un ver wo xe zy".split()

    def pick(*xs):
        return xs[int(rng.integers(len(xs)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high + 1))))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 18).capitalize() + pick(".", ".", ".", "!", "?") for _ in range(int(rng.integers(low, high + 1))))

    def marked(names: str, tag: str = "div") -> str:
        kind = pick(*names.split()) if rng.random() < 0.97 else words(1, 1)  # names that say nothing, too
        return f"{tag} {pick('class', 'class', 'id')}=\"{pick('', 'x-', 'page-', 'js ')}{kind}{pick('', '', '-box', ' wide', '2')}\""

    def around(inner: str) -> str:
        """A wrapper whose names speak of the whole site and say nothing of what is inside."""
        said = " ".join(pick(words(1, 1), f"has-{pick(*every)}", f"{pick(*every)}-{words(1, 1)}", f"no-{pick(*every)}") for _ in range(int(rng.integers(1, 4))))
        return wrap(f"{pick('div', 'div', 'section', 'main')} {pick('class', 'id')}=\"{said}\"", inner)

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))

    def furniture(kind: str) -> str:
        some = sentences(1, 2)
        if kind == "menu":
            return wrap(pick("nav", "nav", marked(HINTS["menu"]), marked(HINTS["menu"], "ul")), pick(wrap("ul", links(int(rng.integers(3, 9)))), links(5), " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(4))))
        if kind == "head":
            return wrap(pick("header", "header", marked(HINTS["head"])), pick(f'<a href="/">{words(1, 2)}</a><p>{words(3, 8)}</p>', f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 3)}</div><span>{words(2, 6)}</span>"))
        if kind == "foot":
            return wrap(pick("footer", "footer", marked(HINTS["foot"])), pick(f"&copy; {words(1, 3)} &middot; {some}", f"<p>&copy; 20{rng.integers(10, 30)} {words(1, 3)}</p><ul>{links(3)}</ul>", f"<p>{some}</p>", f"<div>{words(3, 9)} | <a href='/'>{words(1, 2)}</a></div>"))
        if kind == "side":
            return wrap(pick("aside", "aside", marked(HINTS["side"])), pick(f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>", f"<h2>{words(1, 3)}</h2><p>{some}</p>", f"<p>{some}</p><p>{sentences(1, 3)}</p>"))
        if kind == "ad":
            return wrap(marked(HINTS["ad"], pick("div", "div", "div", "section", "ins", "p")), pick(some, f"<p>{some}</p>", f"<a href='#'>{words(2, 8)}</a>", sentences(2, 4)))
        if kind == "notice":
            return wrap(marked(HINTS["notice"], pick("div", "div", "section", "p", "dialog")), pick(some, f"<p>{some}</p><button>{words(1, 2)}</button>", f"<span>{some}</span> <a href='/p'>{words(1, 3)}</a>"))
        if kind == "form":
            return wrap(pick('form action="/s"', "form", marked(HINTS["form"], "form")), pick(f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button>", f"<p>{some}</p><input type=email><button type=submit>{words(1, 2)}</button>", f"<fieldset><legend>{words(1, 3)}</legend>{words(2, 5)}<select><option>{words(1, 1)}</option></select></fieldset>"))
        if kind == "comment":
            each = "".join(wrap(pick("div", "li", "article", marked("comment reply", "div")), pick(f"<b>{words(1, 2)}</b><p>{sentences(1, 3)}</p>", f"<p>{sentences(1, 4)}</p>", f"<span>{words(1, 2)}</span>: {some}")) for _ in range(int(rng.integers(1, 5))))
            return wrap(marked(HINTS["comment"], pick("div", "section", "ol", "ul")), pick("", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 2)}</h3>") + each)
        return wrap(marked(HINTS["share"]), pick(f"<a href='#'>{words(1, 1)}</a> <a href='#'>{words(1, 1)}</a>", words(1, 4)))

    def spoken(text: str) -> str:
        at = text.split(" ")
        if len(at) > 4 and rng.random() < 0.3:
            k = int(rng.integers(len(at) - 2))
            at[k] = pick("<b>{}</b>", "<i>{}</i>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>").format(at[k])
        return pick(" ", "\n ", " ").join(at)

    def article() -> tuple[list[str], list[str]]:
        shown, texts = [], []
        odd = pick("", "", "", "", " | ", " * ", "© ", "%%% ", " » ", " 12 ")  # articles of listings, signs and figures
        for k in range(int(rng.integers(1, 12))):
            text = words(2, 12) if not k and rng.random() < 0.9 else pick(sentences(1, 6), sentences(1, 6), sentences(1, 1), words(1, 3).capitalize() + ".")
            if odd and rng.random() < 0.8:
                text = odd.join(text.split(" ")).strip()
            text = " ".join(text.split())
            texts.append(text)
            if not k and len(text) < 90:
                shown.append(wrap(pick("h1", "h1", "h1", "h2"), text))
            else:
                shown.append(pick(*[wrap("p", spoken(text))] * 6, f"<p><b>{spoken(text)}<br>", f"<p>{spoken(text)}", wrap("blockquote", text), wrap("div", text), f"<ul><li>{text}</li></ul>", wrap("h2", text), wrap("pre", text)))
        return shown, texts

    every = sorted(_HINT)
    kinds = ["menu", "head", "foot", "side", "ad", "notice", "form", "comment", "share"]
    for _ in range(count):
        shown, texts = article()
        for _ in range(int(rng.integers(0, 3))):
            inside = furniture(pick("ad", "ad", "notice", "share", "form", "side"))
            shown.insert(int(rng.integers(len(shown) + 1)), f"<div>{inside}</div>" if inside.startswith("<ins") else inside)  # ins alone would run on in an open p
        if rng.random() < 0.15:
            shown.append(furniture("comment"))
        body = wrap(pick("article", "article", "main", marked(HINTS["main"]), marked(HINTS["main"], "section"), "div", "main><article").split("><")[0], "".join(shown))
        before = "".join(furniture(k) for k in kinds[:7] if k != "foot" and rng.random() < 0.4)
        after = "".join(furniture(k) for k in ("side", "comment", "form", "ad", "notice", "menu", "foot") if rng.random() < 0.4)
        if rng.random() < 0.2:
            body = around(body)
        if rng.random() < 0.3:
            before, after = f'<div id="{pick("wrap", "page", "container")}">' + before, after + "</div>"
        if rng.random() < 0.1:
            before += wrap("table", "<tr><td>" + pick(" | ", " ", " &middot; ").join(f'<a href="/{words(1, 1)}">{words(1, 2)}</a>' for _ in range(4)) + "</td></tr>")
        shown_page = f"{before}<!-- {words(1, 2)} -->{body}{after}"
        if rng.random() < 0.25:
            shown_page = around(shown_page)
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{pick('', ' class=' + chr(34) + 'has-' + pick(*every) + chr(34))}>{shown_page}</body></html>", texts


@functools.lru_cache(maxsize=1)
def default_field(count: int = 700) -> Field:
    rows = []
    for page, texts in labelled_pages(count):
        blocks, k, labels = leaf_blocks(page), 0, []
        for b in blocks:
            labels.append(int(k < len(texts) and b.text == texts[k]))
            k += labels[-1]
        if k != len(texts):
            raise ValueError("a labelled page lost a block")
        rows.append((features(blocks), labels))
    return trained(rows)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, field.labels(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h or "", field) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
