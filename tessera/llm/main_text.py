"""Main text of web pages by minimum-cut labelling.

A page's blocks are labelled content or boilerplate at once. A logistic classifier of block features, elements and class
names among them, gives each block's odds; their logarithms, at a temperature at which the odds are calibrated, are the
capacities of its edges to the two terminals. Neighbouring blocks, and blocks that the same element holds, are joined by
smoothness edges that halve with every two steps between them in the document's tree, so a short line amid an article
stays with it, and a long one amid a footer goes. The minimum cut between the terminals, found by max-flow, is the
labelling of least cost.

The classifier is fitted here, on ``EXAMPLES`` invented pages (a fixed number) whose blocks are known; on a share of them
(``PLAIN``) elements and class names say nothing. Temperature and smoothness are set on further pages of that kind, which
the classifier has not seen. Before the flow, blocks whose own cost outweighs all their edges are settled, which leaves
the minimum as it is; so long pages stay cheap. Blocks are kept whole and in page order. Hidden elements are no part of
a page's text. A null or empty page, and one without content, gives an empty text. Repeated rows give the same text. A
page is one row: memory is bounded by the largest page.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_bytes, free_name
from tessera.llm.html_blocks import ARTICLE, BOILER, HEADER, HIDDEN, MARKED, Block, Page, read

#: Invented pages to fit the classifier on, and for temperature and smoothness; share of them without telling names.
EXAMPLES, FURTHER, PLAIN = 360, 160, 0.4
#: Temperatures and strengths of smoothness edges to choose from.
TEMPERATURES, STRENGTHS = (1.0, 1.4, 2.0, 2.8, 4.0), (0.3, 0.5, 0.8, 1.2, 1.8)
#: Cost of keeping what a page does not show.
UNSEEN = 50.0
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass(frozen=True)
class Labeller:
    """Weights of the features, temperature of the odds, strength of smoothness edges."""

    weights: tuple[float, ...]
    temperature: float
    strength: float


def features(b: Block, in_article: bool) -> list[float]:
    """in_article: whether the page has an article or main element at all."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    title = b.tag in HEADINGS
    return [
        1.0,
        min(4.0, math.log1p(words)),
        b.link_chars / n,
        float(bool(b.flags & ARTICLE)),
        float(in_article and not b.flags & ARTICLE),
        float(bool(b.flags & MARKED)),
        float(bool(b.flags & BOILER)),
        float(bool(b.flags & HEADER) and not (b.flags & ARTICLE and title)),
        float(title),
        float(b.tag == "p"),
        float(b.tag == "li"),
        float(b.text[-1] in ".!?:;\"'”»)"),
    ]


def example(r: random.Random) -> tuple[str, set[str]]:
    """An invented page and the texts of its content blocks."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    content: set[str] = set()
    plain = r.random() < PLAIN

    def keep(text: str) -> str:
        content.add(text)
        return text

    def box(tag: str, inner: str, names: str = "") -> str:
        """An element; on a plain page a div without a name."""
        return f"<div>{inner}</div>" if plain else f"<{tag}{names}>{inner}</{tag}>"

    body = [f"<h1>{keep(words(2, 9))}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 9)):
        x = r.random()
        if x < 0.75:
            body.append(f"<p>{keep(words(1, 80) + r.choice(['.', '.', '.', '?', '']))}</p>")
        elif x < 0.85:
            body.append(f"<h2>{keep(words(1, 5))}</h2>")
        else:
            body.append("<ul>" + "".join(f"<li>{keep(words(1, 12))}</li>" for _ in range(3)) + "</ul>")
        if r.random() < 0.08 and not plain:
            body.append(f'<div class="{r.choice(["ad", "share", "newsletter"])}">{words(2, 20)}.</div>')
    links = lambda n: "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n))
    before = [box(r.choice(["nav", "div"]), f"<ul>{links(4)}</ul>"), box("header", f"<p>{words(1, 6)}</p>")]
    after = [box("div", f"<p>{words(1, 4)}</p>"), f"<ul>{links(3)}</ul>", box("div", f'<a href="/y">{words(2, 8)}</a>', ' class="related"'), box("footer", f"<p>&copy; {words(1, 12)}</p>"), box("form", f"<p>{words(1, 6)}</p><input>")]
    if not plain:
        before += [f'<div class="{r.choice(["ad", "cookie-notice", "banner"])}">{words(3, 25)}.</div>', f'<div id="sidebar"><p>{words(3, 30)}.</p></div>', f"<header><h1>{words(1, 4)}</h1></header>"]
        after += [f'<div class="comments"><p>{words(2, 40)}.</p><p>{words(2, 40)}.</p></div>', f"<aside><p>{words(3, 40)}.</p></aside>", f"<footer><p>{words(4, 25)}.</p></footer>"]
    holder = r.choice(["article", "main", "div", "div", "section"])
    names = r.choice(["", " class=content"]) if holder == "div" else ""
    return "".join(r.sample(before, r.randint(0, min(3, len(before))))) + box(holder, "".join(body), names) + "".join(r.sample(after, r.randint(0, 3))), content


def known_blocks(pages: list[tuple[str, set[str]]]) -> tuple[list[Page], np.ndarray, np.ndarray]:
    """The pages read, and features and labels of all their blocks."""
    read_pages, rows, labels = [], [], []
    for source, content in pages:
        page = read(source)
        has = any(b.flags & ARTICLE for b in page.blocks)
        rows += [features(b, has) for b in page.blocks]
        labels += [b.text in content for b in page.blocks]
        read_pages.append(page)
    return read_pages, np.array(rows), np.array(labels, float)


@cache
def weights() -> Labeller:
    """Logistic regression over the blocks of the examples, by gradient steps; then temperature and strength on others."""
    r = random.Random(5)
    _, x, y = known_blocks([example(r) for _ in range(EXAMPLES)])
    w = np.zeros(x.shape[1])
    for _ in range(1500):
        w -= 0.8 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-3 * w)
    pages, x, y = known_blocks([example(r) for _ in range(FURTHER)])
    odds = x @ w
    temperature = min(TEMPERATURES, key=lambda t: float(np.logaddexp(0, np.where(y > 0, -odds, odds) / t).sum()))

    def wrong(strength: float) -> int:
        model = Labeller(tuple(w), temperature, strength)
        return int((np.concatenate([labels_of(p, model) for p in pages]) != y).sum())

    return Labeller(tuple(w), temperature, min(STRENGTHS, key=wrong))


def cost(b: Block, has_article: bool, w: Labeller) -> float:
    """Logarithm of the odds of content."""
    if b.flags & HIDDEN:
        return -UNSEEN
    return sum(a * c for a, c in zip(w.weights, features(b, has_article), strict=True)) / w.temperature


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: costs against the label plus the edges between labels."""
    n = len(costs)
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b, c in edges:
        near[a][b] += c
        near[b][a] += c
    label: list[bool | None] = [None] * n
    own = list(costs)
    # A node whose own cost outweighs its edges has that label in a minimum cut; its edges then become costs.
    ready = deque(range(n))
    while ready:
        i = ready.popleft()
        if label[i] is None and abs(own[i]) >= sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                if label[j] is None:
                    ready.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, kept in zip(rest, max_flow_side(rest, own, near), strict=True):
            label[i] = kept
    return [bool(x) for x in label]


def max_flow_side(rest: list[int], own: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm between source (content) and sink; whether each node is on the source's side."""
    s, t = -1, -2
    left: dict[int, dict[int, float]] = {s: {}, t: {}} | {i: dict(near[i]) for i in rest}
    for i in rest:
        if own[i] > 0:
            left[s][i] = own[i]
            left[i][s] = 0.0
        elif own[i] < 0:
            left[i][t] = -own[i]
            left[t][i] = 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return [i in level for i in rest]
        options, at = {i: list(left[i]) for i in level}, defaultdict(int)
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                pairs = list(zip(path, path[1:], strict=False))
                c = min(left[a][b] for a, b in pairs)
                for a, b in pairs:
                    left[a][b] -= c
                    left[b][a] = left[b].get(a, 0.0) + c
                path = path[: 1 + next(k for k, (a, b) in enumerate(pairs) if left[a][b] <= 1e-12)]
                continue
            while at[i] < len(options[i]) and not (left[i][j := options[i][at[i]]] > 1e-12 and level.get(j) == level[i] + 1):
                at[i] += 1
            if at[i] < len(options[i]):
                path.append(options[i][at[i]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def smoothness(page: Page, strength: float) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between blocks that follow each other in the same element."""
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        other = {i - 1, last.get(b.parent, -1)} - {-1}
        edges += [(j, i, strength * 2 ** (1 - page.distance(page.blocks[j], b) / 2)) for j in sorted(other)]
        last[b.parent] = i
    return edges


def labels_of(page: Page, w: Labeller) -> list[bool]:
    has = any(b.flags & ARTICLE for b in page.blocks)
    return minimum_cut([cost(b, has, w) for b in page.blocks], smoothness(page, w.strength))


def labelled(source: str, w: Labeller) -> tuple[list[Block], list[bool]]:
    page = read(source)
    return page.blocks, labels_of(page, w)


def main_text(source: str | None, w: Labeller) -> str:
    if not source:
        return ""
    blocks, keep = labelled(source, w)
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (columns of these names are replaced)."""
    batch_bytes(pages.sparkSession)
    w = weights()
    source = free_name(pages, "source_html")
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    slim = pages.select(*rest, F.col(html).alias(source))
    schema = slim.select(*rest, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py(), w) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*rest, "text"])

    return slim.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
