"""SentencePiece BPE encoding and decoding by vectorised merge rounds in numpy.

The text is cut where no piece can span (before a run of U+2581, around a line feed), and
each distinct cut is encoded once for many documents: all their symbols lie in one flat
array. A round takes the smallest pair rank of each word (a segmented minimum), merges its
leftmost occurrences in all words at once, and drops what was merged and the words that
are done. A word's later occurrences wait for the next round if a merge to their left
makes a pair that ranks before them, so the order is that of a sequential merge.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table

SPACE = "▁"
NONE = np.int64(1) << 40
#: Entries that a task remembers of words it has encoded; it starts anew beyond that.
CACHE_WORDS = 200_000
#: Code points of documents that a task cuts into words at once.
CHUNK_CHARS = 1_000_000

# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class PieceModel:
    """A BPE model with byte fallback and identity normalisation, read from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = f.read()
        pieces, scores, types = [], [], []
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or USER_DEFINED in types or UNUSED in types:
            raise ValueError("only models with identity normalisation, a dummy prefix and no user-defined pieces are supported")
        self.pieces = pieces
        self.types = np.array(types)
        normal = [k for k, t in enumerate(types) if t == NORMAL]
        if any(SPACE in pieces[k].lstrip(SPACE) for k in normal):
            raise ValueError("a piece spans a word boundary")
        ids = {pieces[k]: k for k in normal}
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for k, t in enumerate(types):
            if t == BYTE:
                self.byte_ids[int(pieces[k][3:-1], 16)] = k
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for piece, k in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k
        # Equal scores share a rank: the leftmost of them goes first.
        rank = np.unique(-np.array(scores), return_inverse=True)[1]
        self.n = len(pieces)
        pairs = {}
        for piece, k in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = k
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.ranks = rank[self.merged].astype(np.int64)
        self.names = [str(k) for k in range(self.n)]
        self.shown = [p.replace(SPACE, " ") for p in pieces]
        barrier = "\n" if self.of_char[10] < 0 else ""
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{barrier}]+|{SPACE}+" + (f"|{barrier}" if barrier else ""))

    def words(self, text: str) -> list[str]:
        """The cuts of a text that are encoded each by itself; none for an empty text."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank NONE where no piece is made of the two."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words, and the number of ids of each word."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = self.of_char[code].astype(np.int64)
        symbol = np.where(symbol < 0, -1 - code, symbol)  # a character without a piece, to be spelt in bytes
        rank, result = self._pairs(symbol, word)
        done_word, done_symbol = [], []
        while len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(word)])
            best = np.repeat(least, sizes)
            live = best < NONE
            if not live.all():
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                word, symbol, rank, result, best = word[live], symbol[live], rank[live], result[live], best[live]
                if not len(word):
                    break
            chosen = self._leftmost(word, symbol, rank, result, best)
            symbol[chosen] = result[chosen]
            keep = np.ones(len(word), dtype=bool)
            keep[chosen + 1] = False
            touched = np.zeros(len(word), dtype=bool)
            touched[chosen] = True
            word, symbol, rank, result, touched = word[keep], symbol[keep], rank[keep], result[keep], touched[keep]
            at = np.flatnonzero(touched | np.r_[touched[1:], False])
            rank[at], result[at] = self._pairs(symbol, word, at)
        word, symbol = np.concatenate(done_word or [word]), np.concatenate(done_symbol or [symbol])
        order = np.argsort(word, kind="stable")
        return self._spell(word[order], symbol[order], len(words))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at ``at`` (everywhere by default)."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, result = self._lookup(symbol[at], symbol[after])
        return np.where((after > at) & (word[at] == word[after]), rank, NONE), result

    def _leftmost(self, word, symbol, rank, result, best) -> np.ndarray:
        """Where this round merges: of each word the leftmost pairs of the least rank that don't
        overlap, up to the first one whose merge makes a pair that must go before the others."""
        at = np.flatnonzero(rank == best)
        if (word[at[1:]] != word[at[:-1]]).all():
            return at
        run = np.cumsum(np.r_[True, (np.diff(at) > 1)])
        place = np.arange(len(at)) - np.searchsorted(run, run)
        at = at[place % 2 == 0]
        twice = np.r_[False, word[at[1:]] == word[at[:-1]]]
        merged, n = result[at], len(symbol)
        before = np.where(twice & (np.r_[-9, at[:-1]] == at - 2), np.r_[-1, merged[:-1]], symbol[np.maximum(at - 1, 0)])
        has_before = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        has_after = (at + 2 < n) & (word[np.minimum(at + 2, n - 1)] == word[at])
        left = np.where(has_before, self._lookup(before, merged)[0], NONE)
        right = np.where(has_after, self._lookup(merged, symbol[np.minimum(at + 2, n - 1)])[0], NONE)
        stop = np.minimum(left, right) <= best[at]
        # Nothing after a stop in the same word is merged in this round.
        total = np.cumsum(stop) - stop
        start = np.flatnonzero(~twice)
        return at[total == np.repeat(total[start], np.diff(np.r_[start, len(at)]))]

    def _spell(self, word: np.ndarray, symbol: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        bare = np.flatnonzero(symbol < 0)
        if len(bare):
            raws = [chr(-1 - c).encode() for c in symbol[bare].tolist()]
            times = np.ones(len(symbol), dtype=np.int64)
            times[bare] = [len(r) for r in raws]
            spelt = np.repeat(symbol < 0, times)
            word, symbol = np.repeat(word, times), np.repeat(symbol, times)
            symbol[spelt] = self.byte_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        return symbol, np.bincount(word, minlength=n_words)

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: bytes that make no character give U+FFFD each, control pieces
        nothing, and the first piece loses its dummy space."""
        out, raw = [], bytearray()

        def flush():
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for k in ids:
            kind = self.types[k]
            if kind == BYTE:
                raw.append(int(self.pieces[k][3:-1], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.shown[k]
            out.append(piece[1:] if first and piece.startswith(" ") and kind != UNKNOWN else piece)
            first = False
        flush()
        return "".join(out)

    def encode_words(self, words: list[str]) -> list[tuple[str, str]]:
        """For each word its ids, as decimals joined by commas, and the text they decode to."""
        ids, sizes = self.merge(words)
        ends = np.cumsum(sizes)
        in_bytes = np.add.reduceat(self.types[ids] == BYTE, ends - sizes).tolist() if len(ids) else []
        flat, begin, out = ids.tolist(), 0, []
        names, shown = self.names, self.shown
        for end, spelt in zip(ends.tolist(), in_bytes, strict=True):
            own = flat[begin:end]
            out.append((",".join([names[k] for k in own]), self.decode(own, first=False) if spelt else "".join([shown[k] for k in own])))
            begin = end
        return out


@lru_cache(maxsize=1)
def _loaded(path: str) -> tuple[PieceModel, dict[str, tuple[str, str]]]:
    """The model and the words encoded so far; a worker process keeps both from task to task."""
    return PieceModel(path), {}


def _encode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _loaded(path)

        def encoded(texts: list[str]):
            cuts = [model.words(t) for t in texts]
            new = list(set().union(*cuts) - known.keys())
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(set().union(*cuts))
            if new:
                known.update(zip(new, model.encode_words(new), strict=True))
            for words in cuts:
                found = [known[w] for w in words]
                yield ",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]

        for batch in batches:
            texts = batch.column(1)
            counts, ids_out, texts_out = [], [], []
            begin = 0
            while begin < batch.num_rows:
                end, chars, part = begin, 0, []
                while end < batch.num_rows and (not part or chars < CHUNK_CHARS):
                    part.append(texts[end].as_py() or "")
                    chars += len(part[-1])
                    end += 1
                for ids, decoded in encoded(part):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_out.append(hashlib.sha256(ids.encode()).hexdigest() if digests else [int(k) for k in ids.split(",")] if ids else [])
                    texts_out.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                begin = end
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_out, kind), pa.array(texts_out, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs``: the ids of its whole text and
    the text these decode to; with ``digests`` the SHA-256 of both in place of them, made where
    the ids are, so that they needn't leave the task.

    Defined cases: a null or empty text has no ids and decodes to an empty text; ids may be
    null or repeat, each row gives one row; an empty table gives an empty result; other
    columns aren't read.
    """
    kind = "string" if digests else "array<int>"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encode(model_path, digests), f"doc_id long, n_tokens long, ids {kind}, decoded string")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for rows of ids; null ids decode to an empty text."""

    def run(batches):
        model = PieceModel(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
