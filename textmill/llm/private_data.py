"""Personal data: patterns, and a skip-chain conditional random field for what they miss.

Patterns find the plain forms (``base_spans``), in time linear in the text. The field labels
tokens, runs of characters between white space, as nothing or one of the four kinds. Tokens
that hold neither a digit nor an at sign, nor are part of a spelt-out address, have no other
label than nothing, so they are no nodes; tokens of pattern matches are nodes whose label is
known. Neighbouring nodes share a learned chain potential. Tokens of a document that are equal,
or that have the same digits or the same last seven of them, share a skip potential, however
far apart; each is linked with the one before it of its kind, so that links grow with the
text. Loopy sum-product message passing, a fixed number of sweeps over the nodes of many
documents at once, gives each token's marginals. Runs of tokens that are of one kind with
enough probability become spans.

Potentials are trained on made documents (``private_pages``) by the gradient of the
likelihood, whose expectations are the marginals of the same message passing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.private_pages import CUES, luhn, made_documents

KINDS = ("email", "ip", "card", "phone")
LABELS = (None, *KINDS)
#: Probability from which a token is of a kind; sweeps of message passing and their damping.
THRESHOLD, SWEEPS, DAMPING = 0.9, 12, 0.3
#: Made documents to train on, steps, and the strength of the prior.
TRAIN_DOCUMENTS, TRAIN_STEPS, PRIOR = 400, 100, 0.5
#: Log-potential of a known label; nodes whose messages are passed at once.
KNOWN, NODES_AT_ONCE = 30.0, 50_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits before the place would be part of the same match, so no match begins after one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, TOKEN, NODE = re.compile("[0-9]"), re.compile(r"\S+"), re.compile("[0-9@]")
# An address with its signs spelt out: the at in brackets, or an at and a dot as words.
SPELT = re.compile(r"(?:\S+\s*)?[(\[{]\s?at\s?[)\]}]\s*\S+(?:\s*[(\[{]\s?dot\s?[)\]}]\s*\S+|\s+dot\s+\S+)*|\S+ at \S+(?: dot \S+| ?[(\[{]dot[)\]}] ?\S+)+", re.IGNORECASE)
SPELT_HINTS = (" dot ", "dot)", "dot]", "dot}", "(at", "[at", "{at", "( at", "[ at", "{ at")
NOT_DIGIT = re.compile("[^0-9]+")


def _digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            yield start, last
        at = text.find("@", last if match else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain forms, by start and then kind."""
    found = [("email", *x) for x in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@dataclass
class Nodes:
    """The nodes of some documents in a row, their features and edges."""

    doc: list[int] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    known: list[int] = field(default_factory=list)  # a label, -1 if unknown
    features: list[list[int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # node, later node, kind: 0 chain, 1 equal, 2 similar


#: Places of the features; those of a token are followed by those of the run of nodes it is in.
SIZES = (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20)
_TOKEN_FEATURES = ["bias", "at", "at_dot", "plus", "open", "letters", "mixed", "colon", "equals", "slash", "money", "pure", "octets", "luhn", "first_zero", "bracket_at", "bracket_dot", "word_at", "word_dot", "host", "underscore", "quote", "hash", "long"]
_NAMES = _TOKEN_FEATURES + [f"{what}{k}" for what in ("dots", "dashes") for k in range(4)] + [f"digits{k}" for k in SIZES]
_NAMES += [f"run_{x}" for x in ("first", "last", "single", "plus", "luhn", "at", "octets", "open", "spelt", "phone_like", "zero")] + [f"run_digits{k}" for k in SIZES] + [f"run_nodes{k}" for k in range(6)] + [f"cue_{k}" for k in KINDS]
PLACE = {name: k for k, name in enumerate(_NAMES)}
CUE_OF = {word: kind for kind, words in CUES.items() for word in words}
AT_WORD, DOT_WORD = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.IGNORECASE), re.compile(r"[(\[{]\s?(?:dot|\.)\s?[)\]}]", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
PHONE_LIKE = re.compile(r"[(+]?[0-9]{1,5}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,5}[)]?)*[ ./-]{1,2}[0-9]{3,8}")


def _size(n: int) -> int:
    return max(k for k in SIZES if k <= n)


def _octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _token_features(core: str) -> list[str]:
    digits = _digits(core)
    letters = any(c.isalpha() for c in core)
    tests = {
        "at": "@" in core, "at_dot": "." in core.partition("@")[2], "plus": core.startswith("+"), "open": "(" in core, "letters": letters, "mixed": letters and bool(digits), "colon": ":" in core, "equals": "=" in core, "slash": "/" in core,
        "money": any(c in core for c in "$€£%,#"), "pure": digits == core, "octets": _octets(core), "luhn": 12 <= len(digits) <= 19 and luhn(digits), "first_zero": core.startswith("0"), "bracket_at": bool(AT_WORD.search(core)), "bracket_dot": bool(DOT_WORD.search(core)),
        "word_at": core.lower() == "at", "word_dot": core.lower() == "dot", "host": bool(HOST.fullmatch(core)), "underscore": "_" in core, "quote": '"' in core or "'" in core, "hash": letters and len(digits) > 5, "long": len(core) > 24,
    }
    return ["bias", *[name for name, held in tests.items() if held], f"dots{min(core.count('.'), 3)}", f"dashes{min(core.count('-'), 3)}", f"digits{_size(len(digits))}"]


def _core(token: str) -> tuple[int, int]:
    """Where a token begins and ends without the punctuation around it."""
    begin, end = len(token) - len(token.lstrip("\"'<,;:")), len(token.rstrip("\"'>,;:.!?"))
    for opened, closed in ("()", "[]", "{}"):
        core = token[begin:end]
        around = core.startswith(opened) and core.endswith(closed) and not (core[1:-1].isdigit() or core[1:-1].lower() in ("at", "dot", "@", "."))
        begin += core.startswith(opened) and (around or closed not in core)
        end -= core.endswith(closed) and (around or opened not in core)
    return (begin, end) if begin < end else (0, len(token))


def add_document(nodes: Nodes, doc: int, text: str, base: list[tuple[str, int, int]]) -> None:
    """Append a document's nodes, features and edges."""
    low = text.lower()
    spelt = [m.span() for m in SPELT.finditer(text)] if any(h in low for h in SPELT_HINTS) else []
    if not spelt and "@" not in text and not DIGIT.search(text):
        return
    tokens = [m.span() for m in TOKEN.finditer(text)]
    first = len(nodes.doc)
    run: list[int] = []
    own: list[tuple[int, str]] = []
    base_at = spelt_at = 0

    def close(after: int) -> None:
        """Features of a run of neighbouring nodes, each of which has its own already."""
        if not run:
            return
        cores = [own[k][1] for k in run]
        text_of = " ".join(cores)
        digits = _digits(text_of)
        before = own[run[0]][0] - 1
        cues = {CUE_OF.get(text[slice(*tokens[k])].strip(".,:;()").lower()) for k in (before, before - 1) if k >= 0} - {None}
        joined = "".join(cores)
        tests = {
            "run_plus": cores[0].startswith("+"), "run_luhn": 12 <= len(digits) <= 19 and luhn(digits), "run_at": "@" in text_of, "run_octets": _octets(DOT_WORD.sub(".", joined)), "run_open": cores[0].startswith("("),
            "run_spelt": bool(AT_WORD.search(text_of)) or " at " in f" {text_of.lower()} ", "run_phone_like": bool(len(text_of) < 40 and PHONE_LIKE.fullmatch(text_of)), "run_zero": cores[0].startswith("0"), "run_single": len(run) == 1,
        }
        shared = [name for name, held in tests.items() if held] + [f"run_digits{_size(len(digits))}", f"run_nodes{min(len(run), 5)}"] + [f"cue_{c}" for c in cues]
        for k in run:
            ends = ["run_first"] * (k == run[0]) + ["run_last"] * (k == run[-1])
            nodes.features[first + k] += [PLACE[x] for x in shared + ends]
        nodes.edges.extend((first + a, first + b, 0) for a, b in zip(run, run[1:], strict=False))
        run.clear()

    for k, (start, end) in enumerate(tokens):
        token = text[start:end]
        while base_at < len(base) and base[base_at][2] <= start:
            base_at += 1
        while spelt_at < len(spelt) and spelt[spelt_at][1] <= start:
            spelt_at += 1
        in_spelt = spelt_at < len(spelt) and spelt[spelt_at][0] < end
        if not in_spelt and not NODE.search(token):
            close(k)
            continue
        begin, stop = _core(token)
        core = token[begin:stop]
        label = next((KINDS.index(kind) + 1 for kind, s, e in base[base_at : base_at + 4] if s < start + stop and start + begin < e), -1)
        nodes.doc.append(doc)
        nodes.spans.append((start + begin, start + stop))
        nodes.known.append(label)
        nodes.features.append([PLACE[x] for x in _token_features(core)])
        run.append(len(own))
        own.append((k, core))
        if token[-1] in ",;!?" or token[-1] == "." and stop < len(token):
            close(k)
    close(len(tokens))
    last: dict[tuple[int, str], int] = {}
    for k, (_, core) in enumerate(own):
        digits, linked = _digits(core), set()
        keys = [(1, core.lower())] if len(core) > 3 else []
        keys += [(2, digits)] if len(digits) > 3 else []
        keys += [(3, digits[-7:])] if len(digits) > 6 else []
        keys += [(4, core.lower().partition("@")[0])] if len(core.partition("@")[0]) > 3 else []
        for key in keys:
            if key in last and last[key] not in linked:
                linked.add(last[key])
                nodes.edges.append((first + last[key], first + k, min(key[0], 2)))
            last[key] = k


@dataclass
class Weights:
    """Log-potentials: of features and labels, of a chain of two labels, and of equal labels by
    the two kinds of skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def pairwise(self) -> np.ndarray:
        return np.stack([self.chain, np.diag(self.skip[0]), np.diag(self.skip[1])])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Graph:
    """Arrays of some documents' nodes."""

    def __init__(self, nodes: Nodes):
        self.n = len(nodes.doc)
        self.node = np.repeat(np.arange(self.n), [len(f) for f in nodes.features])
        self.feature = np.array([x for f in nodes.features for x in f], dtype=np.int64)
        self.known = np.array(nodes.known, dtype=np.int64)
        edges = np.array(nodes.edges, dtype=np.int64).reshape(-1, 3)
        self.left, self.right, self.kind = edges.T
        # Each edge carries a message in either direction; the reverse of message k is (k + E) mod 2E.
        self.source, self.target = np.r_[self.left, self.right], np.r_[self.right, self.left]

    def unary(self, weights: Weights) -> np.ndarray:
        rows = weights.unary[self.feature]
        out = np.stack([np.bincount(self.node, rows[:, k], minlength=self.n) for k in range(len(LABELS))], axis=1)
        out[np.flatnonzero(self.known >= 0), self.known[self.known >= 0]] += KNOWN
        return out

    def _gathered(self, messages: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.target, messages[:, k], minlength=self.n) for k in range(len(LABELS))], axis=1)

    def marginals(self, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the labels of each node, and of each edge's pairs of labels."""
        unary, pairwise = self.unary(weights), weights.pairwise()
        n_edges, n_labels = len(self.left), len(LABELS)
        potentials = np.concatenate([pairwise[self.kind], pairwise[self.kind].transpose(0, 2, 1)])
        messages = np.zeros((2 * n_edges, n_labels))
        belief = unary
        for _ in range(SWEEPS if n_edges else 0):
            cavity = belief[self.source] - np.roll(messages, n_edges, axis=0)
            new = _log_sum(cavity[:, :, None] + potentials, axis=1)
            messages = DAMPING * messages + (1 - DAMPING) * (new - _log_sum(new, axis=1)[:, None])
            belief = unary + self._gathered(messages)
        of_node = np.exp(belief - _log_sum(belief, axis=1)[:, None])
        cavity = belief[self.source] - np.roll(messages, n_edges, axis=0)
        pairs = cavity[:n_edges, :, None] + cavity[n_edges:, None, :] + potentials[:n_edges]
        flat = pairs.reshape(n_edges, len(LABELS) ** 2)
        of_edge = np.exp(flat - _log_sum(flat, axis=1)[:, None]).reshape(pairs.shape)
        return of_node, of_edge


def train(documents: list[tuple[str, list[tuple[str, int, int]]]], steps: int = TRAIN_STEPS) -> Weights:
    """Weights from texts and their true (kind, start, end), by Adam on the penalised likelihood."""
    nodes, truth = Nodes(), []
    for k, (text, spans) in enumerate(documents):
        before = len(nodes.doc)
        add_document(nodes, k, text, base_spans(text))
        for start, end in nodes.spans[before:]:
            truth.append(next((KINDS.index(kind) + 1 for kind, s, e in spans if s < end and start < e), 0))
    graph, label = Graph(nodes), np.array(truth)
    label = np.where(graph.known >= 0, graph.known, label)
    n_labels = len(LABELS)
    target = np.eye(n_labels)[label]
    pair_target = target[graph.left][:, :, None] * target[graph.right][:, None, :]
    shapes = [(len(_NAMES), n_labels), (n_labels, n_labels), (2, n_labels)]
    flat = np.zeros(sum(a * b for a, b in shapes))
    cuts = np.cumsum([a * b for a, b in shapes])[:-1]
    shaped = lambda x: [p.reshape(s) for p, s in zip(np.split(x, cuts), shapes, strict=True)]
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        of_node, of_edge = graph.marginals(Weights(*shaped(flat)))
        miss, pair_miss = target - of_node, pair_target - of_edge
        unary = np.stack([np.bincount(graph.feature, miss[graph.node, k], minlength=len(_NAMES)) for k in range(n_labels)], axis=1)
        chain = pair_miss[graph.kind == 0].sum(axis=0)
        skip = np.stack([np.einsum("eii->i", pair_miss[graph.kind == k]) for k in (1, 2)])
        slope = (np.concatenate([unary.ravel(), chain.ravel(), skip.ravel()]) - PRIOR * flat) / len(documents)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        flat = flat + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Weights(*shaped(flat))


@lru_cache(maxsize=1)
def trained() -> Weights:
    return train(made_documents(TRAIN_DOCUMENTS, seed=1))


def _whole(kind: str, text: str) -> bool:
    """Whether a run of tokens has what its kind can't do without."""
    n = len(_digits(text))
    if kind == "email":
        return "@" in text or bool(AT_WORD.search(text)) or " at " in text.lower()
    return {"ip": _octets(DOT_WORD.sub(".", re.sub(r"\s+", "", text))), "card": 12 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def _added(text: str, spans: list[tuple[int, int]], labels: list[int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of tokens of one kind, with only white space between them, that no pattern has found."""
    out: list[tuple[str, int, int]] = []
    for (start, end), label in zip(spans, labels, strict=True):
        if label and out and out[-1][0] == LABELS[label] and not text[out[-1][2] : start].strip():
            out[-1] = out[-1][0], out[-1][1], end
        elif label:
            out.append((LABELS[label], start, end))
    kept, at = [], 0
    ends = sorted((s, e) for _, s, e in base)
    for kind, start, end in out:
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if not any(s < end and start < e for s, e in ends[at : at + 8]) and _whole(kind, text[start:end]):
            kept.append((kind, start, end))
    return kept


def find(texts: list[str], weights: Weights) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its pattern matches, and the spans that the field adds."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    nodes = Nodes()

    def decide() -> None:
        if not nodes.doc:
            return
        of_node, _ = Graph(nodes).marginals(weights)
        best = of_node.argmax(axis=1)
        labels = np.where((of_node.max(axis=1) >= THRESHOLD) & (np.array(nodes.known) < 0), best, 0).tolist()
        begin = 0
        while begin < len(labels):
            end, doc = begin, nodes.doc[begin]
            while end < len(labels) and nodes.doc[end] == doc:
                end += 1
            added[doc] = _added(texts[doc], nodes.spans[begin:end], labels[begin:end], base[doc])
            begin = end

    for k, text in enumerate(texts):
        add_document(nodes, k, text, base[k])
        if len(nodes.doc) >= NODES_AT_ONCE:
            decide()
            nodes = Nodes()
    decide()
    return list(zip(base, added, strict=True))


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_private_data(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): of each row's whole text the pattern matches and the further spans
    of the field, both as arrays of (kind, start, end) in code points, end exclusive, by start.

    Defined cases: a null or empty text has none; ids may be null or repeat, each row gives one
    row; equal texts have equal spans; an empty table gives an empty result; other columns
    aren't read.
    """
    weights = trained() if weights is None else weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found = find([t or "" for t in batch.column(1).to_pylist()], weights)
            shown = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own] for own in side], kind) for side in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *shown], names=["doc_id", "base", "added"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def _in_order(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are of the pattern matches."""
    found = find_private_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_number_of, KINDS), F.sha2(_in_order(F.col("base")), 256).alias("base_sha256"), _in_order(F.concat("base", "added")).alias("spans"))
