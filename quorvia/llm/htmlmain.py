"""Main text of web pages by minimum-cut labelling.

A page becomes its blocks of text in order. A logistic classifier prices each block as content and as
boilerplate, from the elements it stands in and their names, its links, length, punctuation and depth;
the two prices are capacities from the source and to the sink. Edges between blocks that follow each
other, and between blocks under the same element, are the price of labelling the two differently, smaller
the further they are apart in the tree. The minimum cut is the cheapest labelling; the blocks on the
source side are the main text. The classifier is fitted on ``TRAIN_PAGES`` made pages of known labels
(``labelled_pages``), unless others are given.

The flow is found without searching for paths where it can be: a block with at most two edges left is
replaced by the edge that carries what could flow through it, which takes linear time on a page, whose
edges don't cross. What other graphs have left goes to augmenting paths in layers.

Tags are read as the HTML standard's tokeniser reads them, quoted and unquoted attributes, comments and
cut-off tags included. Scripts, styles, the title, templates, form fields and the fallback of embedded
media have no text; formulas and the text of drawings stand in the line. A line break inside a block is
white space. Character references are decoded as browsers do, once. Edge cases: a null or empty page has
an empty text, as has a page of boilerplate alone; unclosed and stray tags are taken as browsers take
them as far as text goes; a page without any element around its text is content; each input row gives a
row, repeated or not; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import id_ddl, map_arrow, quiet_gc

TRAIN_PAGES, SEED = 400, 23
SMOOTHNESS = 1.0  # price of parting two blocks under one element, in units of log-odds
_ATTRIBUTE = r"(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))?+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(>|\Z)", re.S)
_ATTR = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|(?![\"'])([^\s>]*+)))?+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "noscript", "noframes", "noembed", "template", "textarea", "title", "iframe", "annotation", "annotation-xml", "select", "object", "canvas", "video", "audio", "xmp")}
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
_ENDS_P = _BLOCK - {"button", "label", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_KEEPS = frozenset("table ul ol dl div article section main aside nav header footer form body".split())
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
_EDGE = r"(?i)(?:^|[\s_-])(?:{})(?:$|[\s_-])"
_STRONG = re.compile(_EDGE.format(r"ads?|advert\w*|adsense|banner|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu|breadcrumbs?|pagination|pager|toolbar|sidebar|widget\w*|footer|masthead|copyright|comments?|disqus|respond"))
_WEAK = re.compile(_EDGE.format(r"promo\w*|notice|alert|search|share|sharing|social|side|related|recommend\w*|trending|header|legal|disclaimer|replies|reply|tags?|meta|byline|skip|hidden|print-only|toc"))
_GOOD = re.compile(_EDGE.format(r"article|content|entry|post|story|main|body|text|prose"))
_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an element tells about the text in it, as places in a tuple of counts.
STRONG, WEAK, GOOD, CHROME, ASIDE, HEADER, ARTICLE, ROLE, HIDDEN, SMALL = range(10)
_TELLS = {"nav": CHROME, "footer": CHROME, "form": CHROME, "menu": CHROME, "dialog": CHROME, "button": CHROME, "option": CHROME, "fieldset": CHROME, "aside": ASIDE, "header": HEADER, "article": ARTICLE, "main": ARTICLE, "label": SMALL, "address": SMALL}
_NOTHING = (0,) * 10
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block:
    __slots__ = ("text", "path", "links", "tells", "tag")


def _told(tells: tuple, name: str, attributes: str) -> tuple:
    """What the elements around tell, with one more element."""
    more = list(tells)
    at = _TELLS.get(name)
    if at is not None and (at != HEADER or not tells[ARTICLE]):
        more[at] += 1
    if attributes:
        for m in _ATTR.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id") and name not in ("html", "body", "article", "main"):
                more[STRONG] += bool(_STRONG.search(value))
                more[WEAK] += bool(_WEAK.search(value))
                more[GOOD] += bool(_GOOD.search(value))
            elif key == "role":
                more[ROLE] += value.lower() in _ROLE
                more[ARTICLE] += value.lower() in ("main", "article")
            elif key == "hidden" or key == "style" and _HIDING.search(value) or key == "aria-hidden" and value.lower() == "true":
                more[HIDDEN] += 1
    return tuple(more)


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order, with the elements they stand in."""
    out: list[Block] = []
    stack: list[tuple[str, int, tuple]] = []  # tag, number, what it tells: of all elements around
    parts: list[str] = []
    linked, in_link, number = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                b = Block()
                b.text, b.path, b.links = text, [s[1] for s in stack if s[0] in _BLOCK], min(1.0, linked / len(text))
                b.tells = stack[-1][2] if stack else _NOTHING
                b.tag = next((s[0] for s in reversed(stack) if s[0] in _BLOCK), "")
                out.append(b)
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        end = found.start() if found else n
        if end > at:
            run = page[at:end]
            parts.append(html.unescape(run) if "&" in run else run)
            if in_link:
                linked += len(run)
        if not found:
            break
        at = found.end()
        name = found.group(2)
        if not name or not found.group(4):  # no element, or cut off by the end of the page
            continue
        name = name.lower()
        if found.group(1):
            if name in _BLOCK:
                flush()
            elif name == "a":
                in_link = max(0, in_link - 1)
            elif name == "br":
                parts.append("\n")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in _KEEPS and stack[i][0] in _KEEPS:
                    break  # a stray end tag doesn't close what is around it
            continue
        if name in _RAW:
            if name in ("textarea", "title", "select"):
                flush()
            at = _RAW[name].search(page, at).end()
            continue
        if name in _BLOCK:
            flush()
            in_link = 0 if name in _KEEPS else in_link
            closes = _CLOSES.get(name) or (("p",) if name in _ENDS_P else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in _KEEPS:
                    break
        elif name == "br":
            parts.append("\n")
        elif name == "a":
            in_link = 1
        attributes = found.group(3)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        tells = stack[-1][2] if stack else _NOTHING
        if attributes or name in _TELLS:
            tells = _told(tells, name, attributes)
        number += 1
        stack.append((name, number, tells))
    flush()
    return out


def features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    plain = b.tag in _HEADS or b.tag in ("p", "blockquote", "pre")
    return [
        *(float(min(t, 2)) for t in b.tells), b.links, min(3.0, words / 12), float(b.text[-1] in ".!?…。"), float(plain),
        float(words < 4 and not plain and b.tag not in ("", "td")), min(len(b.path), 20) / 10, float(not b.path), 1.0,
    ]


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Made pages with the label of each of their blocks (is it content), from a seed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ta ne ro li su ke mo vi den gar sol per ing est".split()) for _ in range(r.randint(1, 3)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda a=6, b=60: some(a, b).capitalize() + r.choice(".....!?:")
    blurb = lambda a, b: prose(a, b) if r.random() < 0.4 else some(a, b)
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    strong = "ad ads advert cookie-notice cookie consent popup newsletter subscribe-box sidebar widget comments comment-list nav-links menu footer site-footer banner breadcrumb login".split()
    weak = "notice alert share social related recommended trending header legal tags meta byline reply side promo toc".split()
    good = "content entry post article-body story main-text body-text".split()
    some_class = lambda names: f' {r.choice(("class", "id"))}="{r.choice(names)}"'

    def story() -> list[tuple[str, list[bool]]]:
        out = [(f"<h1>{some(2, 9)}</h1>", [True])] if r.random() < 0.8 else []
        if out and r.random() < 0.2:
            out = [(f"<header>{out[0][0]}</header>", [True])]
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.06:  # lines that tell little by themselves
                n = r.randint(1, 4)
                out.append(("".join(f"<p>{link()}</p>" if r.random() < 0.5 else f"<p>{some(1, 3)}</p>" for _ in range(n)), [True] * n))
            elif kind < 0.62:
                out.append((f"<p>{prose(1 if r.random() < 0.15 else 6)}{link() + ' ' + prose() if r.random() < 0.25 else ''}</p>", [True]))
            elif kind < 0.70:
                out.append((f"<h{r.choice('234')}>{some(1, 6)}</h2>", [True]))
            elif kind < 0.78:
                n = r.randint(2, 5)
                out.append(("<ul>" + "".join(f"<li>{some(2, 14)}</li>" for _ in range(n)) + "</ul>", [True] * n))
            elif kind < 0.82:
                out.append((f"<blockquote><p>{prose()}</p></blockquote>", [True]))
            elif kind < 0.90:  # a part of the article under a name that boilerplate often has
                n = r.randint(1, 3)
                out.append((f"<div{some_class(weak)}>" + "".join(f"<p>{prose(8)}</p>" for _ in range(n)) + "</div>", [True] * n))
            elif kind < 0.93:
                out.append((f"<pre>{some(4, 20)}</pre>", [True]))
            elif kind < 0.97:
                out.append((f"<div{some_class(strong)}>{prose(4)}</div>", [False]))
            else:
                out.append((f"<div{some_class(weak)}>{link()} {link()}</div>", [False]))
        return out

    def chrome() -> tuple[str, list[bool]]:
        n, kind = r.randint(2, 9), r.randrange(12)
        links = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        if kind == 0:
            return f"<nav>{links}</nav>", [False] * n
        if kind == 1:
            return f"<header><div>{link()}</div><p>{some(2, 8)}</p></header>", [False] * 2
        if kind == 2:
            return f"<footer><p>&copy; {some(2, 9)}.</p>{links}</footer>", [False] * (n + 1)
        if kind == 3:
            return f"<aside><h3>{some(1, 4)}</h3>{links}<p>{blurb(5, 20)}</p></aside>", [False] * (n + 2)
        if kind in (4, 5):
            return f"<div{some_class(strong)}><p>{blurb(4, 30)}</p><p>{link()}</p></div>", [False] * 2
        if kind == 6:
            return f"<form><p>{blurb(3, 12)}</p><label>{word()}</label><button>{word()}</button></form>", [False] * 3
        if kind == 7:  # reader comments read like prose
            return f'<section{some_class(["comments", "comment-list", "disqus"])}><h3>{some(1, 3)}</h3>' + "".join(f"<div><b>{word()}</b><p>{prose(8)}</p></div>" for _ in range(n)) + "</section>", [False] * (2 * n + 1)
        if kind == 8:
            return f"<div{some_class(weak)}>{links}<p>{some(1, 6)}</p></div>", [False] * (n + 1)
        if kind == 9:
            return f'<div role="{r.choice(sorted(_ROLE))}"><p>{blurb(3, 20)}</p></div>', [False]
        if kind == 10:
            return f'<div style="display:none"><p>{prose(5, 30)}</p></div>', [False]
        return f"<div>{links}<p>{some(2, 12)}</p></div>", [False] * (n + 1)

    made = []
    for _ in range(count):
        if r.random() < 0.2:  # bare pages
            n, head = r.randint(1, 4), r.random() < 0.3
            body = (f"<h1>{some(1, 6)}</h1>" if head else "") + "".join(f"<p>{blurb(1 if r.random() < 0.5 else 6, 60 if r.random() < 0.5 else 8)}</p>" for _ in range(n))
            made.append(r.choice([(r.choice(("{}", "<body>{}</body>")).format(blurb(1, 60)), [True]), (body, [True] * (n + head)), (f"<body>{body}</body>", [True] * (n + head))]))
            continue
        wrap = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", f"<div{some_class(good)}>{{}}</div>", f"<div{some_class(good)}>{{}}</div>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "{}"))
        inner = story()
        pieces = [chrome() for _ in range(r.randint(0, 4))] + [(wrap.format("".join(h for h, _ in inner)), [x for _, part in inner for x in part])] + [chrome() for _ in range(r.randint(0, 4))]
        made.append(("<html><head><title>t</title></head><body>" + "".join(h for h, _ in pieces) + "</body></html>", [x for _, part in pieces for x in part]))
    return made


def fit(pages: list[tuple[str, list[bool]]]) -> np.ndarray:
    """Weights of the features, by Newton steps on the logistic loss with an L2 term."""
    x, y = [], []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"a page has {len(found)} blocks, not {len(labels)}")
        x += map(features, found)
        y += labels
    x, y = np.array(x), np.array(y, np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=1)
def default_weights() -> np.ndarray:
    return fit(labelled_pages())


def prices(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[float]]:
    """Costs of calling each block boilerplate, and of calling it content: negative log-likelihoods."""
    z = np.array([features(b) for b in found]) @ weights
    return np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist()


def _proximity(a: Block, b: Block) -> float:
    """Price of parting two blocks: by the elements between them."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        shared += 1
    return SMOOTHNESS / max(1, max(len(a.path), len(b.path)) - shared)


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between blocks under one element with others between them, unless
    they cross one that is there."""
    out = [(i, i + 1, _proximity(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    seen: list[int] = []  # blocks that no edge passes over, ascending
    for i, b in enumerate(found):
        parent = b.path[-2] if len(b.path) > 1 else 0
        before = last.get(parent, i - 1)
        if before != i - 1:
            k = len(seen)
            while k and seen[k - 1] > before:
                k -= 1
            if k and seen[k - 1] == before:
                del seen[k:]
                out.append((before, i, _proximity(found[before], b)))
        seen.append(i)
        last[parent] = i
    return out


def minimum_cut(sources: list[float], sinks: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source when the cheapest set of capacities is cut."""
    n = len(sources)
    pull = [a - b for a, b in zip(sources, sinks)]  # what flows straight through a node is spent
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        if u != v and c > 0:
            around[u][v] = around[u].get(v, 0.0) + c
            around[v][u] = around[v].get(u, 0.0) + c
    gone: list[tuple[int, float, list[tuple[int, float]]]] = []
    done = [False] * n
    ready = [i for i in range(n) if len(around[i]) <= 2]
    while ready:
        i = ready.pop()
        if done[i] or len(around[i]) > 2:
            continue
        done[i] = True
        near, p = list(around[i].items()), pull[i]
        gone.append((i, p, near))
        for j, _ in near:
            del around[j][i]
        if len(near) == 1:
            (j, c), = near
            pull[j] += min(max(p, -c), c)
        elif near:
            (j, a), (k, b) = near
            # cost of the best label of i for each pair of labels of j and k, less that of (0, 0)
            cost = lambda x, y: min(p + a * x + b * y, a * (1 - x) + b * (1 - y))  # noqa: E731,B023
            e00, e10, e01, e11 = cost(0, 0), cost(1, 0), cost(0, 1), cost(1, 1)
            through = max(0.0, (e10 + e01 - e00 - e11) / 2)
            pull[j] -= (e10 - e00 + e11 - e01) / 2
            pull[k] -= (e01 - e00 + e11 - e10) / 2
            if through > 1e-12:
                around[j][k] = around[j].get(k, 0.0) + through
                around[k][j] = around[k].get(j, 0.0) + through
        ready += [j for j, _ in near if len(around[j]) <= 2]
    stay = [False] * n
    core = [i for i in range(n) if not done[i]]
    if core:
        for i, keep in zip(core, _augment(core, pull, around)):
            stay[i] = keep
    for i, p, near in reversed(gone):
        stay[i] = p + sum(c if stay[j] else -c for j, c in near) > 0
    return stay


def _augment(core: list[int], pull: list[float], around: list[dict[int, float]]) -> list[bool]:
    """The same for the nodes that are left, by shortest augmenting paths in layers."""
    at = {v: i for i, v in enumerate(core)}
    s, t = len(core), len(core) + 1
    graph: list[dict[int, float]] = [{at[w]: c for w, c in around[v].items()} for v in core] + [{}, {}]
    for v, i in at.items():
        if pull[v] > 0:
            graph[s][i], graph[i][s] = pull[v], 0.0
        elif pull[v] < 0:
            graph[i][t], graph[t][i] = -pull[v], 0.0
    while True:
        layer, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-12 and v not in layer:
                    layer[v] = layer[u] + 1
                    queue.append(v)
        if t not in layer:
            return [i in layer for i in range(len(core))]
        todo = {u: list(graph[u]) for u in layer}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(graph[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= flow
                    graph[b][a] += flow
                path = [s]
                continue
            while todo[u] and (graph[u][todo[u][-1]] <= 1e-12 or layer.get(todo[u][-1], -1) != layer[u] + 1):
                todo[u].pop()
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    stay = minimum_cut(*prices(found, default_weights() if weights is None else weights), edges_of(found))
    return "\n".join(b.text for b, keep in zip(found, stay) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batch: pa.RecordBatch):
        quiet_gc()
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, f"page_id {id_ddl(pages, id_col)}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_chars bigint")
