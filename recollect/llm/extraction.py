"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the hierarchy.

Each node gets features of its subtree (text, tags, links, density), attribute tokens, tag, depth and siblings. Boosted
trees, trained in numpy on a bounded sample of nodes with weak labels, rate how likely a node belongs to the article.
Decoding assigns every node one of three states so that the sum of ratings is greatest: outside (the article may begin
below), inside, or cut (boilerplate inside the article, with all that lies below it). A node inside a cut or a node
outside an article below can thus never contradict its ancestors.

Weak labels come from the pages themselves: nodes below article or main are text, unless they or a node between carry a
tag or token of boilerplate; nodes below nav, header, footer, aside, form or such tokens are not. Ratings never see
those ancestors' labels, only features.

Defined cases: a null or empty html has an empty text; broken markup is read as far as it goes; without any labelled
node (no sample), every block outside script and style counts as text; equal rows are extracted each by itself; an
empty table gives an empty result; other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.llm.dom import Tree
from recollect.llm.frames import arrow_map

#: Tags and attribute tokens of what isn't article text.
BOILER_TAGS = frozenset("nav header footer aside form button select head title label dialog menu".split())
BOILER_TOKENS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer
 header legal login menu modal nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar signup social sponsor
 sponsored subscribe toolbar widget""".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_TOKENS = frozenset("article body content entry main post story text".split())
TAGS = ["p", "div", "li", "ul", "ol", "a", "article", "main", "section", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "table", "td", "tr",
        "blockquote", "pre", "b", "i", "em", "strong", "span", "title", "head", "body", "button", "label", "input", "select"]
_TAG = {t: i + 1 for i, t in enumerate(TAGS)}


def features(tree: Tree) -> np.ndarray:
    """One row of features per node."""
    n = len(tree.tags)
    parents = tree.parents
    own, marks = [0] * n, [0] * n
    for node, run, _ in tree.runs:
        k = len(run.strip())
        own[node] += k
        marks[node] += run.count(".") + run.count(",")
    text, tags, links, punct = own[:], [1] * n, [0] * n, marks[:]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if tree.tags[i] == "a":
            links[i] = text[i]
        text[p] += text[i]
        tags[p] += tags[i]
        links[p] += links[i]
        punct[p] += punct[i]
    depth, place, children = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
    bad = [sum(w in BOILER_TOKENS for w in t) if t else 0 for t in tree.tokens]
    good = [sum(w in CONTENT_TOKENS for w in t) if t else 0 for t in tree.tokens]
    up = np.maximum(np.array(parents), 0)
    size, count, link, dots = (np.array(x, dtype=np.float64) for x in (text, tags, links, punct))
    kind = np.array([_TAG.get(t, 0) for t in tree.tags], dtype=np.float64)
    kids, child, deep = (np.array(x, dtype=np.float64) for x in (children, place, depth))
    spread = np.maximum(kids[up], 1)
    return np.stack([np.log1p(size), np.log1p(np.array(own)), np.log1p(count), size / count, link / np.maximum(size, 1), dots / np.maximum(size, 1),
                     deep, child, spread, child / spread, size / np.maximum(size[up], 1), np.log1p(size[up] / spread), np.log1p(kids), kind, kind[up],
                     np.array(bad), np.array(good), np.array([t in BOILER_TAGS for t in tree.tags]), np.array([t in CONTENT_TAGS for t in tree.tags]),
                     size[up] / count[up], link[up] / np.maximum(size[up], 1)], axis=1).astype(np.float32)


WIDTH = 21


def weak_labels(tree: Tree) -> list[int]:
    """1: article text, 0: boilerplate, -1: unknown."""
    out = [-1] * len(tree.tags)
    for i in range(1, len(tree.tags)):
        tag, tokens, above = tree.tags[i], tree.tokens[i], out[tree.parents[i]]
        if tag in BOILER_TAGS or any(w in BOILER_TOKENS for w in tokens):
            out[i] = 0
        elif tag in CONTENT_TAGS:
            out[i] = 1 if above != 0 else 0
        else:
            out[i] = above
    return out


@dataclass
class Boosted:
    """Regression trees as arrays: per tree the feature and threshold of each inner node, and the leaves' values."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def rate(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Logistic gradient boosting with quantile bins and second-order leaf values."""
    inner = (1 << depth) - 1
    feature, threshold = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf, dtype=np.float32)
    value = np.zeros((trees, inner + 1))
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    if not len(y):
        return Boosted(1.0, depth, feature, threshold, value)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    score = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            g, h, best = grad[rows], hess[rows], 1e-6
            for k in range(x.shape[1]) if len(rows) else ():
                n = len(edges[k]) + 1
                left_g, left_h = (np.cumsum(np.bincount(binned[rows, k], w, n))[:-1] for w in (g, h))
                gain = left_g ** 2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                if len(gain) and gain.max() > best:
                    best, feature[t, node], threshold[t, node] = gain.max(), k, edges[k][gain.argmax()]
            at[rows] = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        score += value[t][leaf]
    return Boosted(start, depth, feature, threshold, value)


def decode(tree: Tree, rating: np.ndarray) -> list[bool]:
    """Which nodes are inside the article: the states with the greatest sum, by one pass up and one down the tree.

    A node counts by the text of its own, so that wrappers don't outvote what they hold.
    """
    n = len(tree.tags)
    weight = [0.05] * n
    for node, run, _ in tree.runs:
        weight[node] += len(run.strip())
    gain = [r * w for r, w in zip(rating.tolist(), weight)]
    outside, inside, cut = [-g for g in gain], gain[:], [-g for g in gain]
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        outside[p] += max(outside[i], inside[i])
        inside[p] += max(inside[i], cut[i])
        cut[p] += cut[i]
    state = [0] * n  # 0 outside, 1 inside, 2 cut
    state[0] = 1 if inside[0] > outside[0] else 0
    for i in range(1, n):
        above = state[tree.parents[i]]
        state[i] = 2 if above == 2 else (1 if inside[i] >= cut[i] else 2) if above == 1 else (1 if inside[i] > outside[i] else 0)
    return [s == 1 for s in state]


def train(pages: DataFrame, nodes: int = 20_000, sample_pages: int = 600, id_col: str = "page_id", html_col: str = "html") -> Boosted:
    """Boosted trees from at most ``nodes`` labelled nodes of at most ``sample_pages`` pages, chosen by hashes."""
    keys = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("h")).distinct().orderBy("h").limit(sample_pages)
    chosen = pages.withColumn("h", F.xxhash64(html_col)).join(F.broadcast(keys), "h", "left_semi").select("h", F.col(html_col).cast("binary").alias("html"))

    def step(batch: pa.RecordBatch) -> dict:
        out = {"h": [], "y": [], "x": []}
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            tree = Tree(html.as_py().decode("utf-8", "replace"))
            x = features(tree)
            for i, y in enumerate(weak_labels(tree)):
                if y >= 0:
                    out["h"].append(h)
                    out["y"].append(y)
                    out["x"].append(x[i].tolist())
        return out

    found = arrow_map(chosen, step, "h bigint, y int, x array<float>").dropDuplicates()
    rows = found.orderBy(F.xxhash64("h", "y", "x"), "h", "y", "x").limit(nodes).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float32).reshape(-1, WIDTH)
    return boost(x, np.array([r["y"] for r in rows], dtype=np.float64))


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> dict:
        trees = [Tree((h.as_py() or b"").decode("utf-8", "replace")) for h in batch.column(2)]
        rated = shared.value.rate(np.concatenate([features(t) for t in trees])) if trees else ()
        texts, at = [], 0
        for t in trees:
            texts.append(t.text(decode(t, rated[at:at + len(t.tags)])))
            at += len(t.tags)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts}

    data = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    return arrow_map(data, step, "page_id bigint, url string, text string", rows=200)


def digest(texts: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
