"""Alignment of two tokenizers' tokens by their bytes, with corpus-wide counts of id pairs.

Texts are cut at single blanks between two other characters, where tokens of both tokenizers
end, and each distinct cut is aligned once for a block of documents. All cuts of a block lie
in flat arrays: cumulated byte lengths are the tokens' ends, the ends that both sides share
(``intersect1d``) are the groups' borders, ``searchsorted`` labels each token with its group,
and links come from repeating every A token for each B token of its group.

A document is then a list of cuts. A block counts once per document the pairs that its cuts
link; these counts are added over the corpus in two stages, first by pair and salt, then by
pair. A block gets back the totals of its own pairs, in one row, and sums them over its
documents' links. So what is shuffled are pairs by block, never links or tokens by document.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table, written
from textmill.llm.packing import ByteTokenizer

#: Code points of a block of documents.
BLOCK_CHARS = 4_000_000
#: Cuts that are encoded in one call, links that are made at once, and salts of a pair's first count.
ENCODE_CUTS, LINKS_AT_ONCE, SALTS = 20_000, 1_000_000, 16

#: A pair of ids is below two to this power; a cut's number stands above it in a key.
PAIR_BITS = 31

#: A blank after and before a character that no library counts as white space.
CUT = re.compile(r" (?<=\S )(?=\S)")
SPACE = "▁"

_ALIGNED = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,"
    "cuts binary, n_cuts binary, links_of_cut binary, link_pair binary, link_times binary, a array<int>, b array<int>, docs array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


@dataclass
class Tokens:
    """The tokens of many cuts in a row: ids, the byte each ends at, and the cut each is of."""

    ids: np.ndarray
    ends: np.ndarray
    cut: np.ndarray


@dataclass
class Links:
    """Distinct (cut, pair of ids) with how often the cut links them, by ascending cut; a cut's
    numbers of A tokens, B tokens, groups and links; and its groups as text."""

    cut: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray
    shown: list[str]


class Aligner:
    """A byte-level BPE tokenizer (A) and a SentencePiece model (B)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.byte = ByteTokenizer(byte_path)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n_a, n_b = self.byte.encoding.n_vocab, self.piece.get_piece_size()
        self.bytes_a = [b""] * n_a
        for token in self.byte.encoding.token_byte_values():
            self.bytes_a[self.byte.encoding.encode_single_token(token)] = token
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.piece.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(map(self.piece.id_to_piece, range(n_b)))]
        self.length_a, self.length_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        self.n_b = n_b
        if not {bytes([k]) for k in range(256)} <= set(self.bytes_a) or n_a * n_b >= 1 << PAIR_BITS:
            raise ValueError("only byte-level vocabularies with a token for each byte, and fewer than 2**31 pairs of ids, are supported")
        # An id as text with what follows it: a comma, a bar after a group's last A id, a semicolon after its last B id.
        self.n_names = max(n_a, n_b)
        self.names = np.array([f"{k}{end}" for end in ",|;" for k in range(self.n_names)], dtype=object)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of blank + text by A and of text by B."""
        return np.frombuffer(self.byte.encode(" " + text), dtype="<u4").astype(np.int64), np.array(self.piece.encode(text), dtype=np.int64)

    def _spelt(self, text: str, b: np.ndarray) -> bool:
        """Whether B's tokens are the text's bytes; A's always are, as each byte has a token."""
        return b"".join(map(self.bytes_b.__getitem__, b.tolist())) == (" " + text).encode()

    def encode(self, cuts: list[str]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of both sides and, for each cut, whether both spell it."""
        plain = [k for k, c in enumerate(cuts) if not c[0].isspace() and not c[-1].isspace()]
        alone = sorted(set(range(len(cuts))) - set(plain))
        good = np.ones(len(cuts), dtype=bool)
        sizes = np.array([len(c.encode()) + 1 for c in cuts], dtype=np.int64)
        found: tuple[list, list] = ([], [])

        def add(part: list[int]) -> bool:
            text = " ".join([cuts[k] for k in part])
            ids = self._ids(text)
            ends = np.cumsum(sizes[part])
            own = []
            for side, lengths in zip(ids, (self.length_a, self.length_b), strict=True):
                own_ends = np.cumsum(lengths[side])
                if len(side) == 0 or own_ends[-1] != ends[-1] or (own_ends[np.searchsorted(own_ends, ends)] != ends).any():
                    return False
                own.append((side, np.array(part)[np.searchsorted(ends, own_ends)]))
            if not self._spelt(text, ids[1]):
                return False
            for out, one in zip(found, own, strict=True):
                out.append(one)
            return True

        for begin in range(0, len(plain), ENCODE_CUTS):
            part = plain[begin : begin + ENCODE_CUTS]
            if not add(part):
                alone += part
        for k in alone:
            good[k] = add([k])
        sides = []
        for own, lengths in zip(found, (self.length_a, self.length_b), strict=True):
            ids = np.concatenate([x[0] for x in own]) if own else np.zeros(0, np.int64)
            cut = np.concatenate([x[1] for x in own]) if own else np.zeros(0, np.int64)
            order = np.argsort(cut, kind="stable")
            sides.append(Tokens(ids[order], np.cumsum(lengths[ids[order]]), cut[order]))
        return *sides, good

    def align(self, cuts: list[str]) -> tuple[Links, np.ndarray]:
        """The links of all cuts, and which cuts both tokenizers spell; the others have none."""
        a, b, good = self.encode(cuts)
        borders = np.intersect1d(a.ends, b.ends, assume_unique=True)
        group_a, group_b = np.searchsorted(borders, a.ends), np.searchsorted(borders, b.ends)
        n_groups, n_cuts = len(borders), len(cuts)
        in_b = np.bincount(group_b, minlength=n_groups)
        start_b = np.cumsum(in_b) - in_b
        times = in_b[group_a]
        # A pair of ids is linked as often in a cut as there are token pairs; they are made for some tokens at a time.
        parts, upto, begin = [], np.cumsum(times), 0
        while begin < len(times):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + LINKS_AT_ONCE, side="right")))
            left = np.repeat(np.arange(begin, end), times[begin:end])
            first = np.cumsum(times[begin:end]) - times[begin:end]
            right = np.arange(len(left)) - np.repeat(first - start_b[group_a[begin:end]], times[begin:end])
            parts.append(_counted(a.cut[left] << PAIR_BITS | a.ids[left] * self.n_b + b.ids[right], np.ones(len(left), np.int64)))
            begin = end
        keys, n = _counted(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        del parts
        pairs = _distinct(keys & (1 << PAIR_BITS) - 1)
        pair = np.searchsorted(pairs, keys & (1 << PAIR_BITS) - 1)
        count = lambda cut, weights=None: np.bincount(cut, weights, minlength=n_cuts).astype(np.int64)
        last_a = np.flatnonzero(np.r_[group_a[1:] != group_a[:-1], True][: len(group_a)])
        sizes = np.stack([count(a.cut), count(b.cut), count(a.cut[last_a]), count(a.cut, times)])
        return Links(keys >> PAIR_BITS, pair, n, pairs, sizes, self._shown(a, b, group_a, group_b, n_cuts)), good

    def _shown(self, a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray, n_cuts: int) -> list[str]:
        group, side = np.r_[group_a, group_b], np.repeat([0, 1], [len(group_a), len(group_b)])
        order = np.lexsort((side, group))
        part = (2 * group + side)[order]
        ends = np.where(np.r_[part[1:] != part[:-1], True][: len(part)], side[order] + 1, 0)
        text = self.names[ends * self.n_names + np.r_[a.ids, b.ids][order]].tolist()
        upto = np.cumsum(np.bincount(np.r_[a.cut, b.cut], minlength=n_cuts)).tolist()
        return ["".join(text[begin:end]) for begin, end in zip([0, *upto], upto, strict=False)]


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def documents_of_pairs(cuts: np.ndarray, n_cuts: np.ndarray, links: Links) -> np.ndarray:
    """For each pair, in how many documents a cut links it; a document is ``n_cuts`` of ``cuts`` in a row."""
    per_cut = np.bincount(links.cut, minlength=links.sizes.shape[1])
    first = np.cumsum(per_cut) - per_cut
    found = np.zeros(len(links.pairs), dtype=np.int64)
    upto = np.cumsum(np.r_[0, per_cut[cuts]])[np.cumsum(n_cuts)]
    ends, doc = np.cumsum(n_cuts), 0
    while doc < len(n_cuts):
        last = max(doc + 1, int(np.searchsorted(upto, (upto[doc - 1] if doc else 0) + LINKS_AT_ONCE, side="right")))
        own = cuts[ends[doc - 1] if doc else 0 : ends[last - 1]]
        held = _distinct(np.repeat(np.arange(last - doc), n_cuts[doc:last]) * links.sizes.shape[1] + own)
        of_doc, cut = np.divmod(held, links.sizes.shape[1])
        times = per_cut[cut]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[cut], times)
        pairs = _distinct(np.repeat(of_doc, times) * len(links.pairs) + links.pair[at]) % max(1, len(links.pairs))
        found += np.bincount(pairs, minlength=len(links.pairs))
        doc = last
    return found


@lru_cache(maxsize=1)
def _loaded(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, after that number of bytes."""
    size = next(n for n in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _aligned(byte_path: str, piece_path: str):
    names = [x.split()[0] for x in _ALIGNED.split(",")]
    ints = pa.list_(pa.int64())
    types = [pa.int64(), ints, ints, ints, ints, ints, pa.list_(pa.string()), *[pa.binary()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32()), ints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _loaded(byte_path, piece_path)
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids, texts, chars, made = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal ids, texts, chars, made
            links, good = aligner.align(list(number))
            keep = [bool(len(t)) and bool(good[t].all()) for t in texts]
            texts = [t if k else t[:0] for t, k in zip(texts, keep, strict=True)]
            n_cuts = np.array([len(t) for t in texts], dtype=np.int64)
            cuts = np.concatenate(texts)
            ends = np.cumsum(n_cuts)
            sizes = np.diff(np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(links.sizes[:, cuts], axis=1)], axis=1)[:, np.r_[0, ends]], axis=1)
            shown = [hashlib.sha256("".join([links.shown[c] for c in t.tolist()])[:-1].encode()).hexdigest() if len(t) else "" for t in texts]
            docs = documents_of_pairs(cuts, n_cuts, links)
            packed = [_packed(x) for x in (cuts, n_cuts, np.bincount(links.cut, minlength=len(good)), links.pair, links.times)]
            row = [(TaskContext.get().partitionId() << 32) + made, ids, *sizes, shown, *packed, links.pairs // aligner.n_b, links.pairs % aligner.n_b, docs]
            number.clear()
            ids, texts, chars, made = [], [], 0, made + 1
            with contextlib.suppress(OSError, AttributeError):  # no C library that can: the memory stays with the worker
                ctypes.CDLL(None).malloc_trim(0)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(np.array([number[c] for c in CUT.split(text)] if text else [], dtype=np.int64))
                chars += len(text) + 64
                if chars >= BLOCK_CHARS:
                    yield block()
        if ids:
            yield block()

    return run


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents with the totals of its pairs summed over their links."""
    for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        flat = lambda name: _unpacked(column(name)[0].as_py())  # noqa: B023, E731
        cuts, n_cuts, per_cut, link_pair, times = flat("cuts"), flat("n_cuts"), flat("links_of_cut"), flat("link_pair"), flat("link_times")
        totals = np.zeros((2, int(link_pair.max(initial=-1)) + 1), dtype=np.int64)
        found = column("found").flatten()
        if len(found):
            totals[:, found.field(0).to_numpy()] = found.field(1).to_numpy(), found.field(2).to_numpy()
        of_link = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(totals[:, link_pair] * times, axis=1)], axis=1)
        of_cut = np.diff(of_link[:, np.r_[0, np.cumsum(per_cut)]], axis=1)
        of_doc = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(of_cut[:, cuts], axis=1)], axis=1)
        count_sum, n_best = np.diff(of_doc[:, np.r_[0, np.cumsum(n_cuts)]], axis=1)
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        yield pa.RecordBatch.from_arrays([*(column(c).flatten() for c in kept), pa.array(n_best), pa.array(count_sum)], names=[*kept, "n_best", "count_sum"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair of ids is linked, and 1 if no other pair
    of the A id has a higher count. Blocks that hold a frequent pair add it up by salt first."""
    pairs = aligned.select("block", F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    salted = pairs.groupBy("a", "b", "salt").agg(F.sum("docs").alias("count"))
    counts = salted.groupBy("a", "b").agg(F.sum("count").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: numbers of A and B tokens, groups and links, the SHA-256 of its
    groups, how many links are of a pair that is its A id's most frequent one (``n_best``), and
    the sum of all links' pair counts (``count_sum``).

    Defined cases: a text that is null or empty, or that the tokens of one side don't spell
    byte by byte (B has a plain blank for U+2581), has no tokens: zeros and an empty string.
    Repeated rows count each as a document; ids may be null; an empty table gives an empty
    result; other columns aren't read. A group's links are made LINKS_AT_ONCE at a time.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = written(source.mapInArrow(_aligned(byte_path, piece_path), _ALIGNED), "aligned")
    own = aligned.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("block", "at", "p.a", "p.b")
    found = own.join(pair_counts(aligned), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    return aligned.drop("a", "b", "docs").join(found, "block", "left").mapInArrow(_totalled, _RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    found = align_documents(table(spark, sf_dir, "documents"), known.path("byte_bpe_50k.json"), known.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
