"""Main text of web pages by a graphical model over the DOM tree.

Each DOM node is content or not. A node has a potential from its features (its kind, the
words in its class and id, the length, punctuation and links of the text below it), and an
edge to its parent has a potential that favours equal states, as strongly as was learnt
for the node's kind. Sum-product messages from the leaves to the root and back give exact
marginals, because the graph is a tree; text whose marginal is over a half is kept.

All potentials come from labelled pages by maximum likelihood, whose gradient the same
messages give. The labelled pages are made by ``html_pages.labelled_pages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.html_dom import LINK, NAMES, TEXT, WORD_NAMES, Dom, parse

#: Labelled pages that the model is fitted to, and the seed they are made with.
TRAINING_PAGES, TRAINING_SEED = 400, 1
STEPS = 100
RIDGE = 1.0
#: Code points of pages whose nodes are handled as one set of arrays.
CHUNK_CHARS = 2_000_000

_STOPS = re.compile(r"[.!?,;:]")


@dataclass
class Nodes:
    """The nodes of several pages, one after the other."""

    parent: np.ndarray
    group: np.ndarray
    depth: np.ndarray
    features: np.ndarray


def flatten(doms: list[Dom]) -> Nodes:
    size = np.array([len(d.parent) for d in doms])
    base = np.repeat(np.cumsum(size) - size, size)
    one = lambda name: np.fromiter((x for d in doms for x in getattr(d, name)), dtype=np.int64, count=size.sum())
    parent, group, depth, marks = one("parent"), one("group"), one("depth"), one("marks")
    parent = np.where(parent >= 0, parent + base, -1)
    texts = [t for d in doms for t in d.text]
    chars = np.array([len(t.strip()) if t else 0 for t in texts], dtype=np.float64)
    stops = np.array([len(_STOPS.findall(t)) if t else 0 for t in texts], dtype=np.float64)
    linked = np.zeros(len(parent), dtype=bool)
    levels = _levels(depth)
    for own in levels[1:]:
        linked[own] = linked[parent[own]] | (group[own] == LINK)
    sums = np.c_[chars, stops, np.where(linked, chars, 0), (chars > 0).astype(float)]
    for own in reversed(levels[1:]):
        np.add.at(sums, parent[own], sums[own])
    total, stop, link, parts = sums.T
    has = total > 0
    density = np.where(has, link / np.maximum(total, 1), 0)
    columns = [group[:, None] == np.arange(len(NAMES)), (marks[:, None] >> np.arange(len(WORD_NAMES))) & 1]
    log = np.log1p(total)
    rest = [log / 8, (log / 8) ** 2, density, density * (group == TEXT), np.minimum(stop / np.maximum(total / 40, 1), 2), np.log1p(stop) / 5, np.log1p(total / np.maximum(parts, 1)) / 6, has, (total < 30) & has, np.ones(len(group))]
    features = np.concatenate([*(c.astype(np.float64) for c in columns), np.stack(rest, axis=1).astype(np.float64)], axis=1)
    return Nodes(parent, group, depth, features)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Places of the nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


@dataclass
class PageModel:
    unary: np.ndarray  # of the features
    coupling: np.ndarray  # of each kind of node with its parent

    @classmethod
    def fit(cls, nodes: Nodes, label: np.ndarray, *, steps: int = STEPS, rate: float = 0.05, ridge: float = RIDGE) -> PageModel:
        """Maximum likelihood: Newton steps without edges first, then Adam steps with them.

        The gradient of a weight is what its feature sums to on the labels less what it sums
        to on the marginals; for a coupling it is the same of the product of two states.
        """
        x, n = nodes.features, len(label)
        w = np.zeros(x.shape[1])
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w += np.linalg.solve(hessian, x.T @ (label - p) - ridge * w)
        kinds = len(NAMES)
        weights = np.concatenate([w, np.full(kinds, 0.5)])
        child = np.flatnonzero(nodes.parent >= 0)
        state, kind = 2.0 * label - 1, nodes.group[child]
        agree = np.bincount(kind, state[child] * state[nodes.parent[child]], kinds)
        first, second = np.zeros(len(weights)), np.zeros(len(weights))
        for t in range(1, steps + 1):
            model = cls(weights[:-kinds], weights[-kinds:])
            odds, product = model._messages(nodes)
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            gradient = np.concatenate([x.T @ (label - p), agree - np.bincount(kind, product[child], kinds)]) - ridge * weights
            first = 0.9 * first + 0.1 * gradient / n
            second = 0.99 * second + 0.01 * (gradient / n) ** 2
            weights += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return cls(weights[:-kinds], weights[-kinds:])

    def _messages(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each node, and the mean product of its state (1 or -1) and its parent's."""
        odds = nodes.features @ self.unary
        coupling = self.coupling[nodes.group]
        pull = np.tanh(coupling)
        levels = _levels(nodes.depth)
        send = lambda own, odd: 2 * np.arctanh(np.clip(pull[own] * np.tanh(odd / 2), -1 + 1e-12, 1 - 1e-12))
        up, product = np.zeros(len(odds)), np.zeros(len(odds))
        for own in reversed(levels[1:]):
            up[own] = send(own, odds[own])
            np.add.at(odds, nodes.parent[own], up[own])
        for own in levels[1:]:
            cavity = odds[nodes.parent[own]] - up[own]
            both = np.tanh(cavity / 2) * np.tanh(odds[own] / 2)
            product[own] = (pull[own] + both) / (1 + pull[own] * both)
            odds[own] += send(own, cavity)
        return odds, product

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Log-odds of content of each node, by messages up and down the trees."""
        return self._messages(nodes)[0]


def main_text(dom: Dom, keep: np.ndarray) -> str:
    """The kept text: white space within a block made one space, blocks joined by a line feed."""
    out: list[list[str]] = []
    last = None
    for k in np.flatnonzero(keep).tolist():
        if dom.text[k] is not None:
            if dom.block[k] != last:
                out.append([])
                last = dom.block[k]
            out[-1].append(dom.text[k])
    lines = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(line for line in lines if line)


def extract(model: PageModel, pages: list[str]) -> list[str]:
    doms = [parse(p) for p in pages]
    if not doms:
        return []
    odds = model.marginals(flatten(doms))
    ends = np.cumsum([len(d.parent) for d in doms])
    return [main_text(d, own > 0) for d, own in zip(doms, np.split(odds, ends[:-1]), strict=True)]


@lru_cache(maxsize=1)
def trained_model(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> PageModel:
    from textmill.llm.html_pages import labelled_pages

    doms, labels = zip(*labelled_pages(pages, seed), strict=True)
    return PageModel.fit(flatten(list(doms)), np.concatenate(labels))


def extract_pages(pages: DataFrame, html_col: str = "html", model: PageModel | None = None) -> DataFrame:
    """``pages`` with a column ``text``: the main text of the whole HTML (replaced if it is there).

    Defined cases: null, empty or contentless HTML gives an empty text; markup that is cut
    off is read as far as it goes; an empty table gives an empty result; no other column is
    used, and all are kept.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    model = model or trained_model()
    pages = pages.drop("text")
    at = pages.columns.index(html_col)
    schema = StructType([*pages.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                end, chars, part = begin, 0, []
                while end < batch.num_rows and (not part or chars < CHUNK_CHARS):
                    part.append(batch.column(at)[end].as_py() or "")
                    chars += len(part[-1])
                    end += 1
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(extract(model, part), pa.string())], names=[*own.schema.names, "text"])
                begin = end

    return pages.mapInArrow(run, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
