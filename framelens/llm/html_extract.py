"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each has a hidden state, content or not; an element's features
(tag, hints in class, id and role, length, link share and form of its own text) depend on its state, and its
state depends on its parent's through a potential for the kind of element. Sum-product message passing, once
upward and once downward, gives each element's exact marginal; the own text of elements with a content
marginal of one half or more is the page's main text, in page order.

The potentials are smoothed counts over labelled pages (`fit`): pages whose elements carry `data-content`
"1" or "0" for themselves and what they hold. `labelled_pages` makes such pages from a seed, in many layouts;
a Spark-side model is fitted once on the driver from at most TRAIN_PAGES of them.

Defined cases: null or empty html has the text ""; unclosed, unopened and wrongly nested tags are closed where
their parent ends, an open head where something comes that can't stand in it; head, scripts, styles, templates and comments have no text; rows that repeat a page_id get
a row each; an empty table gives no rows; pages of any size and depth are handled without recursion, in time linear in
the page.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, SEED, SMOOTH = 600, 5, 0.5

# Element names of the HTML standard by how a reader must treat them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style template noscript svg math select option button textarea title iframe object canvas audio video map datalist xmp noembed noframes".split())
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCK = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
GOOD = frozenset("article content entry post story main text body page".split())
BAD = frozenset("nav navigation navbar menu header masthead footer sidebar aside ad ads advert advertisement sponsor sponsored promo banner comment comments reply replies share social related recommended cookie cookies consent notice alert popup modal subscribe newsletter signup login search widget breadcrumb breadcrumbs pagination pager copyright tags toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HINT = re.compile(r"[a-z]+")
BREAK = "\u0001"  # a line break inside a block


class Node:
    __slots__ = ("parent", "tag", "hint", "own", "links", "pieces", "label")

    def __init__(self, parent: int, tag: str, hint: str, label: int | None):
        self.parent, self.tag, self.hint, self.label = parent, tag, hint, label
        self.own, self.links, self.pieces = 0, 0, 0


def hints(attrs: dict[str, str]) -> str:
    words = set(HINT.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()))
    good, bad = not words.isdisjoint(GOOD), not words.isdisjoint(BAD)
    return "both" if good and bad else "good" if good else "bad" if bad else "none"


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents before children, and the text pieces (block, text) in page order."""
    nodes = [Node(-1, "html", "none", None)]
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block that holds their text
    places: dict[str, list[int]] = {}  # of each name's open elements in the stack, so that no tag has to search it

    def last(*tags: str) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    silent, links, at, n = 0, 0, 0, len(page)

    def say(raw: str) -> None:
        if stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if raw and not silent:
            t = _html.unescape(raw)
            node = nodes[stack[-1][1]]
            size = len(t.strip())
            node.own += size
            node.pieces += 1
            if links:
                node.links += size
            texts.append((stack[-1][1], t))

    def close(to: int) -> None:
        nonlocal silent, links
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"
            if tag in BLOCK and stack:
                texts.append((stack[-1][1], BREAK))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        end, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if tag is None:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if end:
            if where := last(tag):
                close(where)
            elif tag == "p" or tag == "br":
                texts.append((stack[-1][1], BREAK))
            continue
        if tag == "html" or tag == "body" and last("body"):
            continue
        if tag not in HEAD and (where := last("head")) and last("template") < where and (tag == "body" or last("noscript") < where):
            close(where)
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not silent and tag != "wbr":
                texts.append((stack[-1][1], BREAK))
            continue
        if tag in CLOSES_P:
            where = last("p")
            if where and last("td", "th", "table", "button", "object") < where:
                close(where)
        if tag in SELF_CLOSING and (where := last(*SELF_CLOSING[tag])) > last(*SCOPE[tag]):
            close(where)
        own = stack[-1][1]
        if tag in BLOCK and not silent:
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest else {}
            said = attrs.get("data-content")
            nodes.append(Node(own, tag, hints(attrs), nodes[own].label if said is None else int(said == "1")))
            own = len(nodes) - 1
            texts.append((own, BREAK))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, own))
        silent += tag in SILENT
        links += tag == "a"
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else n
        elif rest.endswith("/") and tag in ("svg", "math"):
            close(len(stack) - 1)
    return nodes, texts


def kind(tag: str) -> str:
    """Element kinds that have a potential of their own."""
    return tag if tag in ("article", "main", "nav", "aside", "header", "footer", "form", "section", "ul", "ol", "li", "p", "div", "table", "body", "figure", "blockquote", "pre", "h1", "h2") else "h" if tag[0] == "h" and tag[1:].isdigit() else "other"


def observed(node: Node, ending: str) -> tuple:
    """Features of an element: its kind with its hints, the length and link share of its own text, and whether that ends like a sentence."""
    n = node.own
    length = 0 if n == 0 else 1 if n < 20 else 2 if n < 80 else 3 if n < 250 else 4
    share = 0 if not node.links else 1 if node.links < 0.3 * n else 2 if node.links < 0.8 * n else 3
    k = kind(node.tag)
    return (("k", k), ("h", node.hint), ("l", length, share), ("e", ending if n else "-"))


def look(nodes: list[Node], texts: list[tuple[int, str]]) -> list[tuple]:
    last: dict[int, str] = {}
    for i, t in texts:
        if t != BREAK and (t := t.rstrip()):
            last[i] = t[-1]
    return [observed(x, "." if last.get(i, "") in ".!?…:;\"'»”" else "w") for i, x in enumerate(nodes)]


class Model:
    """Log-potentials: emit[feature] for content and not, and turn[kind][parent state][state]."""

    def __init__(self, emit: dict, unseen: dict, turn: dict, prior: tuple[float, float]):
        self.emit, self.unseen, self.turn, self.prior = emit, unseen, turn, prior

    def marginals(self, nodes: list[Node], seen: list[tuple]) -> list[float]:
        """Probability of content for each element, by sum-product on the tree."""
        n = len(nodes)
        score = []
        for fs in seen:
            a = b = 0.0
            for f in fs:
                x, y = self.emit.get(f) or self.unseen[f[0]]
                a += x
                b += y
            top = max(a, b)
            score.append((math.exp(a - top), math.exp(b - top)))
        other = self.turn["other"]
        turns = [self.turn.get(kind(x.tag), other) for x in nodes]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n  # message to the parent
        inner = list(score)  # own evidence times the messages of the children
        for i in range(n - 1, 0, -1):
            a, b = inner[i]
            (t00, t01), (t10, t11) = turns[i]
            m0, m1 = t00 * a + t01 * b, t10 * a + t11 * b
            z = m0 + m1
            up[i] = (m0 / z, m1 / z)
            p = nodes[i].parent
            x, y = inner[p][0] * up[i][0], inner[p][1] * up[i][1]
            z = x + y
            inner[p] = (x / z, y / z)
        out, outer = [0.0] * n, [self.prior] * n  # message from the parent
        for i in range(n):
            if i:
                p = nodes[i].parent
                a, b = inner[p][0] * outer[p][0] / max(up[i][0], 1e-300), inner[p][1] * outer[p][1] / max(up[i][1], 1e-300)
                (t00, t01), (t10, t11) = turns[i]
                m0, m1 = t00 * a + t10 * b, t01 * a + t11 * b
                z = m0 + m1
                outer[i] = (m0 / z, m1 / z)
            a, b = inner[i][0] * outer[i][0], inner[i][1] * outer[i][1]
            out[i] = b / (a + b)
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, texts = parse(page)
        content = self.marginals(nodes, look(nodes, texts))
        return " ".join("".join(" " if t == BREAK else t for i, t in texts if content[i] >= 0.5 or t == BREAK).split())


def fit(pages: list[str]) -> Model:
    """Smoothed counts over labelled pages."""
    emit: dict = {}
    turn: dict = {}
    totals = Counter()
    roots = [SMOOTH, SMOOTH]
    for page in pages:
        nodes, texts = parse(page)
        seen = look(nodes, texts)
        # an element with no label of its own is what most of the text that it holds is
        held = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if x.label is not None:
                held[i][x.label] += x.own
            if x.parent >= 0:
                held[x.parent][0] += held[i][0]
                held[x.parent][1] += held[i][1]
        state = [x.label if x.label is not None else int(held[i][1] >= held[i][0]) for i, x in enumerate(nodes)]
        roots[state[0]] += 1
        for i, (x, fs) in enumerate(zip(nodes, seen, strict=True)):
            totals[state[i]] += 1
            for f in fs:
                emit.setdefault(f, [0, 0])[state[i]] += 1
            if i:
                turn.setdefault(kind(x.tag), [[SMOOTH, SMOOTH], [SMOOTH, SMOOTH]])[state[x.parent]][state[i]] += 1
    width = Counter(f[0] for f in emit)
    logs = {f: tuple(math.log((c[s] + SMOOTH) / (totals[s] + SMOOTH * (width[f[0]] + 1))) for s in (0, 1)) for f, c in emit.items()}
    unseen = {k: tuple(math.log(SMOOTH / (totals[s] + SMOOTH * (width[k] + 1))) for s in (0, 1)) for k in ("k", "h", "l", "e")}
    rows = {k: tuple(tuple(v / sum(r) for v in r) for r in t) for k, t in turn.items()}
    rows.setdefault("other", ((0.9, 0.1), (0.1, 0.9)))
    return Model(logs, unseen, rows, (roots[0] / sum(roots), roots[1] / sum(roots)))


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages with labels, in layouts drawn at random: what holds the article, what stands around and inside it."""
    rng = random.Random(seed)
    letters = "aeiounrstlmdéüáñ"

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(k))

    def sentence() -> str:
        return words(rng.randint(1, 22)).capitalize() + rng.choice(".....!?,")

    def para() -> str:
        t = " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))
        return rng.choice((t, t, t, t.replace(" ", f" <b>{words(2)}</b> ", 1), t.replace(" ", f' <a href="/x">{words(2)}</a> ', 1), t + "<br>" + sentence()))

    def link_list(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(rng.randint(2, 9))) + f"</{tag}>"

    def mark(body: str, y: int, tag: str, cls: str = "") -> str:
        return f'<{tag} data-content="{y}"{cls and f" class={chr(34)}{cls}{chr(34)}"}>{body}</{tag}>'

    def junk() -> str:
        what = rng.randrange(9)
        text = " ".join(sentence() for _ in range(rng.randint(1, 4)))
        if what == 0:
            return mark(link_list(), 0, rng.choice(("nav", "div", "menu")), rng.choice(("", "menu", "navbar")) or "nav")
        if what == 1:
            return mark(text, 0, rng.choice(("div", "aside", "section")), rng.choice(("ad", "ads banner", "advert", "sponsored", "promo-box")))
        if what == 2:
            return mark(f"<h3>{words(2)}</h3>" + rng.choice((link_list(), f"<p>{text}</p>")), 0, rng.choice(("aside", "div")), "sidebar")
        if what == 3:
            return mark(f"<p>{text}</p>", 0, "div", rng.choice(("cookie-notice", "consent", "alert notice", "popup")))
        if what == 4:
            return mark(f"<p>{text}</p><label>{words(2)}</label><input name=q>", 0, "form", rng.choice(("", "newsletter", "search")))
        if what == 5:
            return mark(f"<h3>{words(1)}</h3>" + "".join(f"<{t}>{para()}</{t}>" for t in [rng.choice(("p", "li", "div"))] * rng.randint(1, 5)), 0, rng.choice(("section", "div", "ol", "aside")), rng.choice(("comments", "comment-list", "replies")))
        if what == 6:
            return mark(f"<h4>{words(2)}</h4>{link_list()}", 0, "div", rng.choice(("related", "recommended", "share social")))
        if what == 7:
            return mark(" / ".join(f"<a href=/>{words(1)}</a>" for _ in range(3)), 0, rng.choice(("div", "p")), "breadcrumbs")
        return mark(text, 0, "aside")

    def article() -> str:
        out = [f"<h1>{words(rng.randint(2, 9)).capitalize()}{rng.choice(('', '.', '!'))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            k = rng.random()
            out.append(
                f"<p>{para()}{rng.choice(('</p>', '</p>', ''))}" if k < 0.75 else f"<h2>{words(4)}</h2><p>{para()}</p>" if k < 0.82
                else "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>" if k < 0.87
                else f"<blockquote><p>{para()}</p></blockquote>" if k < 0.9 else f"<pre>{para()}</pre>" if k < 0.92
                else f"<table><tr><td>{words(2)}</td><td>{words(3)}</td></tr></table>" if k < 0.94
                else f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>" if k < 0.96 else f"<div>{para()}</div>" if k < 0.98 else junk()
            )
        if rng.random() < 0.2:
            out.insert(rng.randrange(len(out) + 1), junk())
        tag, cls = rng.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry-content"), ("section", "article-body"), ("div", "")))
        return mark("".join(out), 1, tag, cls)

    pages = []
    for _ in range(n):
        top = mark(rng.choice((f"<h2>{words(2)}</h2>", f"<div>{words(2)}</div>", "")) + rng.choice((link_list(), "", f"<p>{words(4)}</p>")), 0, "header", rng.choice(("", "site-header")))
        foot = mark(rng.choice((f"&copy; {words(2)} &middot; {sentence()}", f"<p>{sentence()}</p>", link_list(), f"{sentence()}")), 0, rng.choice(("footer", "footer", "div")), rng.choice(("footer", "copyright", "footer")))
        parts = [rng.choice((top, mark(link_list(), 0, "nav"), "")), *(junk() for _ in range(rng.randrange(3))), article(), *(junk() for _ in range(rng.randrange(3))), rng.choice((foot, foot, ""))]
        body = "".join(parts)
        for _ in range(rng.randrange(3)):
            body = f'<div{rng.choice(("", " class=wrapper", " id=page"))}>{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{body}</body></html>")
    return pages


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))  # a few hundred numbers

    def run(batches):
        for b in batches:
            texts = [shared.value.extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["i", "u", "t", "n"])

    base = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).alias("h"))
    out = base.mapInArrow(run, "i long, u string, t string, n long")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("t").alias("text"), F.col("n").alias("n_chars"))
