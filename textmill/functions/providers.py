"""Pluggable providers of text completions and embeddings, with deterministic defaults.

No model is available where this library runs, so the defaults are plain stand-ins: the
completer extracts, the embedder hashes words. They are Column expressions. A real service
is wrapped with ``BatchCompleter``, which calls it once for each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import strip

#: What a completer answers for a chunk without anything on the focus.
MARKER = "NOT RELEVANT"
#: Words of a batch that are counted at once.
WORDS_AT_ONCE = 1 << 16


class Completer(Protocol):
    """Three questions about text. Nothing is asked about a null text, and its answer is null; for
    any other a null answer means that the request failed."""

    def classify(self, focus: Column, chunk: Column, note: Column) -> Column: ...

    def extract(self, focus: Column, chunk: Column) -> Column: ...

    def combine(self, focus: Column, parts: Column) -> Column: ...


@dataclass(frozen=True)
class ExtractiveCompleter:
    """Relevant if a chunk contains ``term`` (or always); its summary is its first characters."""

    term: str | None = None
    chars: int = 80

    def classify(self, focus: Column, chunk: Column, note: Column) -> Column:
        found = F.lit(True) if self.term is None else F.contains(chunk, F.lit(self.term))
        return F.when(chunk.isNotNull(), F.when(found, "YES").otherwise("NO"))

    def extract(self, focus: Column, chunk: Column) -> Column:
        return strip(F.substring(chunk, 1, self.chars))

    def combine(self, focus: Column, parts: Column) -> Column:
        return parts


@dataclass(frozen=True)
class BatchCompleter:
    """A function from a list of prompts to answers (None for a failed request), made once for each task."""

    make: Callable[[], Callable[[list[str]], list[str | None]]]
    classify_prompt: str = "Answer YES or NO: does this text say anything about the focus?\n{note}\nFocus: {focus}\n\n{text}"
    extract_prompt: str = "Write down only what this text says about the focus. If there is nothing, answer " + MARKER + ".\nFocus: {focus}\n\n{text}"
    combine_prompt: str = "Merge these parts into one text about the focus, without adding anything.\nFocus: {focus}\n\n{text}"

    def _ask(self, prompt: str, focus: Column, text: Column, note: Column) -> Column:
        make = self.make

        @F.pandas_udf("string")
        def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            complete = make()
            for focuses, texts, notes in batches:
                asked = [None if t is None else prompt.format(focus=f, text=t, note=n) for f, t, n in zip(focuses, texts, notes, strict=True)]
                answers = iter(complete(own) if (own := [p for p in asked if p is not None]) else [])
                yield pd.Series([None if p is None else next(answers) for p in asked], dtype=object)

        # A model may answer differently each time: Catalyst must not evaluate it twice.
        return ask.asNondeterministic()(focus, text, note)

    def classify(self, focus: Column, chunk: Column, note: Column) -> Column:
        return self._ask(self.classify_prompt, focus, chunk, note)

    def extract(self, focus: Column, chunk: Column) -> Column:
        return self._ask(self.extract_prompt, focus, chunk, F.lit(""))

    def combine(self, focus: Column, parts: Column) -> Column:
        return self._ask(self.combine_prompt, focus, parts, F.lit(""))


class PageFetcher(Protocol):
    """Pages by address: a struct (html string, error string) with one of them null."""

    def fetch(self, url: Column) -> Column: ...


class CommandRunner(Protocol):
    """Runs of commands: a struct (exit_code int, stdout string, stderr string, error string); the
    first three are null where there is an error."""

    def run(self, command: Column) -> Column: ...


class Reachability(Protocol):
    """Whether the service that condenses can be reached just now."""

    def __call__(self) -> bool: ...


def is_reachable(probe: bool | Reachability) -> bool:
    """The probe's answer; one that fails counts as no."""
    if not callable(probe):
        return bool(probe)
    try:
        return bool(probe())
    except Exception:
        return False


def _looked_up(key: Column, stored: dict[str, tuple], fields: dict[str, str], missing: str) -> Column:
    """The struct that is stored under a key; the last field, the error, says that there is none."""
    struct = lambda values: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, fields.items(), strict=True)])
    *others, error = fields
    none = F.struct(*[F.lit(None).cast(fields[name]).alias(name) for name in others], F.concat(F.lit(missing), key).alias(error))
    if not stored:
        return none
    found = F.try_element_at(F.create_map(*[x for k, v in stored.items() for x in (F.lit(k), struct((*v, None)))]), key)
    return F.when(found.isNotNull(), found).otherwise(none)


@dataclass(frozen=True)
class StoredPages:
    """Pages that are at hand, by address. The default: no request leaves the cluster."""

    pages: dict[str, str]

    def fetch(self, url: Column) -> Column:
        return _looked_up(url, {k: (v,) for k, v in self.pages.items()}, {"html": "string", "error": "string"}, "no page is stored for ")


@dataclass(frozen=True)
class RecordedRuns:
    """Runs that were recorded, by command: (exit code, stdout, stderr). The default: nothing is run."""

    runs: dict[str, tuple[int, str, str]]

    def run(self, command: Column) -> Column:
        return _looked_up(command, self.runs, {"exit_code": "int", "stdout": "string", "stderr": "string", "error": "string"}, "no run is recorded of ")


@dataclass(frozen=True)
class BatchFetcher:
    """A function from an address to its page, made once for each task; what it raises becomes the error."""

    make: Callable[[], Callable[[str], str]]

    def fetch(self, url: Column) -> Column:
        make = self.make

        @F.pandas_udf("html string, error string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            get = make()
            for urls in batches:
                rows = []
                for at in urls:
                    try:
                        rows.append((None, "no address") if at is None else (get(at), None))
                    except Exception as wrong:
                        rows.append((None, str(wrong)))
                yield pd.DataFrame(rows, columns=["html", "error"], dtype=object)

        return ask.asNondeterministic()(url)


@dataclass(frozen=True)
class BatchRunner:
    """A function from a command to (exit code, stdout, stderr), made once for each task; what it
    raises, a timeout say, becomes the error."""

    make: Callable[[], Callable[[str], tuple[int, str, str]]]

    def run(self, command: Column) -> Column:
        make = self.make

        @F.pandas_udf("exit_code int, stdout string, stderr string, error string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            call = make()
            for commands in batches:
                rows = []
                for own in commands:
                    try:
                        rows.append((None, None, None, "no command") if own is None else (*call(own), None))
                    except Exception as wrong:
                        rows.append((None, None, None, str(wrong)))
                yield pd.DataFrame(rows, columns=["exit_code", "stdout", "stderr", "error"]).astype({"exit_code": "Int32"})

        return ask.asNondeterministic()(command)


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of hashed words, scaled to length 1. It compares words, not meanings."""

    dimensions: int = 64

    @property
    def name(self) -> str:
        return f"hashing-{self.dimensions}"

    def embed(self, text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
        kind, n = "short" if self.dimensions <= 1 << 15 else "int", self.dimensions
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast(kind))

        # Arrow's own arrays, and the words a run at a time: a batch takes little more than its bytes.
        @F.arrow_udf("array<float>")
        def scaled(batch: pa.Array) -> pa.Array:
            ends = np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            counts = np.zeros(len(batch) * n, dtype=np.int64)
            for at in range(0, len(flat), WORDS_AT_ONCE):
                own = flat[at : at + WORDS_AT_ONCE]
                row = np.searchsorted(ends, np.arange(at, at + len(own)), side="right")
                some = np.bincount((row - row[0]) * n + own)
                counts[row[0] * n : row[0] * n + len(some)] += some
            counts = counts.reshape(-1, n)
            norm = np.linalg.norm(counts, axis=1, keepdims=True)
            values = (counts / np.maximum(norm, 1)).astype(np.float32).ravel()
            return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, n, dtype=np.int32), values)

        return scaled(F.coalesce(places, F.array().cast(f"array<{kind}>")))


@dataclass(frozen=True)
class BatchEmbedder:
    """A function from a list of texts to their vectors, made once for each task."""

    name: str
    dimensions: int
    make: Callable[[], Callable[[list[str]], list[list[float]]]]

    def embed(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vectors = make()
            for texts in batches:
                yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors(texts.tolist())] if len(texts) else [], dtype=object)

        return run.asNondeterministic()(text)


def resolve_model(explicit: str | None, configured: str | None, loaded: list[str] | None) -> tuple[str | None, str | None]:
    """(model, error): the one asked for, else the configured one, else the only one loaded."""
    if explicit or configured:
        return explicit or configured, None
    if loaded is None:
        return None, "Error: the model service can't be reached."
    if not loaded:
        return None, "Error: no model is loaded."
    if len(loaded) > 1:
        return None, f"Error: several models are loaded ({', '.join(loaded)}); name one."
    return loaded[0], None


def resolved_model(explicit: Column, configured: Column, loaded: Column) -> Column:
    """The same for columns: a struct (model, error), one of them null; null ``loaded`` is a service that can't be reached."""
    asked = F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(configured, F.lit("")))
    error = (
        F.when(loaded.isNull(), "Error: the model service can't be reached.").when(F.size(loaded) == 0, "Error: no model is loaded.")
        .when(F.size(loaded) > 1, F.concat(F.lit("Error: several models are loaded ("), F.array_join(loaded, ", "), F.lit("); name one.")))
    )
    model = F.coalesce(asked, F.when(F.size(loaded) == 1, F.get(loaded, F.lit(0))))
    return F.struct(model.alias("model"), F.when(model.isNull(), error).alias("error"))


def describe_models(loaded: list[str] | None) -> str:
    if loaded is None:
        return "The model service can't be reached."
    return ", ".join(loaded) if loaded else "No model is loaded."
