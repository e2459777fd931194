"""Condensing texts by a gated map-reduce.

Scope the text, pass the size gates, cut it into chunks, ask which are relevant, extract
from those, drop empty answers, and combine what is left in order. Chunks are rows, so the
requests of one document run in parallel; the first failed chunk by position fails its
document. Only summaries are shuffled, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.providers import MARKER, CommandRunner, Completer, ExtractiveCompleter, PageFetcher
from textmill.functions.storage import checkpoint
from textmill.functions.text import char_chunks, combined_output, heading_boundary, looks_positional, main_content, strip, strip_tags
from textmill.operators.asked import Answers

CHUNK_CHARS = 12_000
SKIP_UNDER = 2_000
MAX_TOTAL = 2_000_000
POSITIONAL_WINDOW = 4_000

GENERAL_FOCUS = "Keep errors, warnings and whatever someone has to act on."
WEB_FOCUS = "Keep facts, figures, names and dates."


@dataclass(frozen=True)
class Limits:
    """``combine_chars`` is what one request that combines parts can take; without it all parts
    of a text go into one."""

    skip_if_under_chars: int = SKIP_UNDER
    chunk_chars: int = CHUNK_CHARS
    max_total_chars: int = MAX_TOTAL
    combine_chars: int | None = None

    def __post_init__(self):
        if self.chunk_chars < 1 or (self.combine_chars or 1) < 1:
            raise ValueError("a chunk needs at least one character")


def scope_chars(text: Column, focus: Column, max_chars: Column, chunk_chars: int = CHUNK_CHARS) -> Column:
    """Characters of the text to look at: an explicit limit; else, for a positional focus, up
    to the first heading, or a window where there is none; else null for all."""
    window = F.lit(min(chunk_chars, POSITIONAL_WINDOW))
    return F.coalesce(max_chars.cast("int"), F.when(looks_positional(focus), F.coalesce(heading_boundary(text), window)))


def truncate(text: Column, chars: Column) -> Column:
    """The first ``chars`` code points; a negative number leaves that many off the end; null keeps all."""
    n = F.when(chars >= 0, chars).otherwise(F.greatest(F.char_length(text) + chars, F.lit(0)))
    return F.when(chars.isNull(), text).otherwise(F.substring(text, F.lit(1), n.cast("int")))


def gate(length: Column, limits: Limits) -> Column:
    return F.when(length < limits.skip_if_under_chars, "unchanged").when(length > limits.max_total_chars, "error").otherwise("compress")


def parse_answer(answer: Column) -> Column:
    """True or false; null only for a failed request. What is neither yes nor no counts as yes."""
    low = F.upper(strip(answer))
    return F.when(answer.isNull(), F.lit(None).cast("boolean")).when(F.startswith(low, F.lit("YES")), True).when(F.startswith(low, F.lit("NO")), False).otherwise(True)


def is_marker(summary: Column) -> Column:
    """Whether a summary says that there was nothing."""
    up = F.upper(summary)
    return (up == f"[{MARKER}]") | ((F.char_length(summary) < 34) & F.contains(up, F.lit(MARKER)))


def ratio(original: Column, compressed: Column) -> Column:
    """Percent saved, halves to even; 0 for an empty original."""
    return F.when(original == 0, F.lit(0)).otherwise(F.rint(F.lit(100) * (F.lit(1) - compressed / original)).cast("int"))


def position_note(at: Column, n: Column, truncated: Column) -> Column:
    """What the classifier is told of a chunk's place: a part of several, the beginning of a text
    whose rest was left out, or all of it."""
    part = F.concat(F.lit("This is part "), at, F.lit(" of "), n, F.lit(" of a larger text, in its order: part 1 is the beginning, the last part the end."))
    beginning = "This is the beginning of a larger text. The rest was left out on purpose, the text doesn't end here."
    return F.when(n > 1, part).when(truncated, beginning).otherwise("This is the whole text.")


# Characters that Python doesn't print: controls, formats, unassigned ones, separators but for the blank.
_UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def python_repr(c: Column) -> Column:
    """A text in quotes as Python shows it: double quotes only if it has single ones alone,
    characters that aren't printed by their numbers."""
    safe = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        safe = F.replace(safe, F.lit(raw), F.lit(shown))

    def numbered(x: Column) -> Column:
        code = F.ascii(x)
        digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
        shown = F.when(code < 1 << 8, F.concat(F.lit("\\x"), digits(2))).when(code < 1 << 16, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))
        return F.when(x.rlike(_UNPRINTED), shown).otherwise(x)

    safe = F.when(safe.rlike(_UNPRINTED), F.array_join(F.transform(F.regexp_extract_all(safe, F.lit("(?s)."), F.lit(0)), numbered), "")).otherwise(safe)
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _labelled(parts: Column, first: Column, n: Column) -> Column:
    """Parts in order below their numbers, of which the first is ``first`` + 1."""
    return F.array_join(F.transform(parts, lambda s, k: F.concat(F.lit("[part "), first + k + 1, F.lit("/"), n, F.lit("]\n"), s)), "\n\n")


#: Characters that a part's number and the blank line after it take at most.
LABEL_CHARS = 24


def request_groups(sizes: list[int], most: int) -> list[int]:
    """The request that each part goes into, in order: as many parts as fit into ``most``
    characters, two at least, so that every round of requests leaves half as many parts at most."""
    groups, held, n = [], 0, 0
    for size in sizes:
        if n >= 2 and held + size > most:
            held = n = 0
            groups.append(groups[-1] + 1)
        else:
            groups.append(groups[-1] if groups else 0)
        held, n = held + size, n + 1
    return groups


def _combined(grouped: DataFrame, key: str, completer: Completer, limits: Limits, ask) -> DataFrame:
    """(key, _combined): the parts of each text made one in rounds of requests that fit the limit;
    null where a request failed. A round is written before the next one reads it."""
    most = limits.combine_chars or (1 << 62)

    @F.pandas_udf("array<int>")
    def groups_of(sizes: pd.Series) -> pd.Series:
        return pd.Series([request_groups(own, most) for own in sizes], dtype=object)

    level = checkpoint(grouped.where("_error IS NULL").select(key, "_focus", F.col("_kept").alias("_parts")))
    unfinished = (F.size("_parts") > 1) & ~F.exists("_parts", lambda p: p.isNull())
    while not level.where(unfinished).isEmpty():
        group = groups_of(F.transform("_parts", lambda p: F.char_length(p) + LABEL_CHARS))
        parts = level.where(unfinished).select(key, "_focus", F.size("_parts").alias("_n"), F.posexplode(F.arrays_zip(F.col("_parts").alias("p"), group.alias("g"))).alias("_at", "_x"))
        requests = parts.groupBy(key, F.col("_x.g").alias("_group")).agg(F.first("_focus").alias("_focus"), F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_at", F.col("_x.p").alias("p")))).alias("_own"))
        texts = F.transform("_own", lambda x: x["p"])
        requests = requests.withColumn("_text", F.when(F.size("_own") > 1, _labelled(texts, F.get("_own", F.lit(0))["_at"], F.col("_n"))))
        answered = ask("combine", requests, [F.col("_focus"), F.col("_text")], lambda: completer.combine(F.col("_focus"), F.col("_text")), F.col("_text").isNotNull())
        merged = F.when(F.col("_text").isNull(), F.get(texts, F.lit(0))).otherwise(strip("_answer"))
        after = answered.select(key, "_focus", "_group", merged.alias("_part")).groupBy(key).agg(F.first("_focus").alias("_focus"), F.array_sort(F.collect_list(F.struct("_group", "_part"))).alias("_x"))
        level = checkpoint(level.where(~unfinished).unionByName(after.select(key, "_focus", F.transform("_x", lambda x: x["_part"]).alias("_parts"))))
    return level.select(key, F.when(F.size("_parts") == 1, F.get("_parts", F.lit(0))).alias("_combined"))


def compress(rows: DataFrame, key: str, text: str, *, focus: str | Column = GENERAL_FOCUS, max_chars: int | Column | None = None, limits: Limits = Limits(), completer: Completer = ExtractiveCompleter(), answers: Answers | None = None) -> DataFrame:
    """``(key, result)`` for each row; result has status, original_len, compressed_len, n_chunks,
    n_skipped, ratio, auto_truncated, error and body.

    ``key`` must tell rows apart. A null text counts as empty. With ``answers`` each different
    question is asked once and its answer kept there, for later runs too; the completer's
    ``name`` is part of a question, if it has one. With that or with a limit of combining
    requests, the requests are made now, else when the result is read.
    """

    def ask(kind: str, frame: DataFrame, parts: list[Column], answer: Callable[[], Column], when: Column) -> DataFrame:
        if answers is None:
            return frame.withColumn("_answer", answer())
        own = F.lit(f"{kind}:{getattr(completer, 'name', type(completer).__name__)}")
        return answers.answered(frame, [own, *parts], lambda _: answer(), when)

    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    scoped = rows.select(
        F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), as_col(focus).alias("_focus"),
        (as_col(max_chars) if max_chars is not None else F.lit(None)).cast("int").alias("_max"),
    )
    scoped = scoped.withColumn("_scope", scope_chars(F.col("_text"), F.col("_focus"), F.col("_max"), limits.chunk_chars))
    scoped = scoped.select(
        key, "_focus", F.col("_scope").isNotNull().alias("_limited"), (F.col("_max").isNull() & F.col("_scope").isNotNull()).alias("_auto"),
        truncate(F.col("_text"), F.col("_scope")).alias("_text"),
    ).withColumn("_len", F.char_length("_text"))
    scoped = scoped.withColumn("_status", gate(F.col("_len"), limits))

    plain = scoped.where("_status <> 'compress'").select(
        key,
        F.struct(
            F.col("_status").alias("status"), F.col("_len").alias("original_len"), F.col("_len").alias("compressed_len"), F.lit(0).alias("n_chunks"), F.lit(0).alias("n_skipped"),
            F.lit(0).alias("ratio"), F.col("_auto").alias("auto_truncated"),
            F.when(F.col("_status") == "error", F.format_string(f"Error: the text has %d characters and the limit is {limits.max_total_chars}; nothing was left out, narrow the source.", F.col("_len"))).alias("error"),
            F.when(F.col("_status") == "unchanged", F.col("_text")).alias("body"),
        ).alias("result"),
    )

    chunked = scoped.where("_status = 'compress'").withColumn("_chunks", char_chunks("_text", limits.chunk_chars))
    chunks = chunked.select(key, "_focus", "_limited", "_auto", "_len", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_at", "_chunk"))
    chunks = chunks.withColumn("_at", F.col("_at") + 1)
    # Each question is asked once: its answer is a column of one branch, and what needs no answer
    # (texts with a limit, irrelevant chunks, single summaries) asks about a null text.
    note = position_note(F.col("_at"), F.col("_n"), F.col("_auto"))
    asked = F.when(~F.col("_limited"), F.col("_chunk"))
    answered = ask("classify", chunks.withColumn("_note", note), [F.col("_focus"), F.col("_chunk"), F.col("_note")], lambda: completer.classify(F.col("_focus"), asked, F.col("_note")), ~F.col("_limited"))
    answered = answered.withColumn("_yes", F.when(F.col("_limited"), True).otherwise(parse_answer(F.col("_answer")))).drop("_answer", "_note")
    wanted = F.when(F.col("_yes"), F.col("_chunk"))
    both = ask("extract", answered, [F.col("_focus"), F.col("_chunk")], lambda: completer.extract(F.col("_focus"), wanted), F.col("_yes")).withColumn("_summary", strip("_answer"))
    at = lambda what: F.format_string(f"Error: the {what} request failed on chunk %d of %d.", "_at", "_n")
    outcome = both.select(
        key, "_focus", "_auto", "_len", "_n", "_at",
        F.when(F.col("_yes").isNull(), at("relevance")).when(F.col("_yes") & F.col("_summary").isNull(), at("extraction")).alias("_error"),
        F.when(~is_marker(F.col("_summary")), F.col("_summary")).alias("_summary"),
    )
    grouped = outcome.groupBy(key).agg(
        F.first("_focus").alias("_focus"), F.first("_auto").alias("_auto"), F.first("_len").alias("_len"), F.first("_n").alias("_n"),
        F.min(F.when(F.col("_error").isNotNull(), F.struct("_at", "_error")))["_error"].alias("_error"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_summary").isNotNull(), F.struct("_at", "_summary")))), lambda x: x["_summary"]).alias("_kept"),
    )
    kept = F.size("_kept")
    parts = _labelled(F.col("_kept"), F.lit(0), kept)
    caveat = F.when(F.col("_auto"), " Only the beginning of the text was read.").otherwise("")
    grouped = grouped.withColumn(
        "_error",
        F.coalesce("_error", F.when(kept == 0, F.concat(F.lit("Error: none of the "), F.col("_n"), F.lit(" chunk(s) held anything on "), python_repr(F.col("_focus")), F.lit("."), caveat))),
    )
    many = F.col("_error").isNull() & (kept > 1)
    if answers is None and limits.combine_chars is None:
        grouped = grouped.withColumn("_combined", strip(completer.combine(F.col("_focus"), F.when(many, parts))))
    else:
        grouped = checkpoint(grouped)
        grouped = grouped.join(_combined(grouped, key, completer, limits, ask), key, "left")
    done = grouped.withColumn("_body", F.when(many, F.col("_combined")).otherwise(F.get("_kept", F.lit(0))))
    done = done.withColumn("_error", F.coalesce("_error", F.when(F.col("_body").isNull(), F.lit("Error: the request that combines the parts failed."))))
    ok = F.col("_error").isNull()
    size = F.char_length("_body")
    condensed = done.select(
        key,
        F.struct(
            F.when(ok, "compressed").otherwise("error").alias("status"), F.col("_len").alias("original_len"), F.when(ok, size).otherwise(0).alias("compressed_len"),
            F.col("_n").alias("n_chunks"), (F.col("_n") - kept).alias("n_skipped"), F.when(ok, ratio(F.col("_len"), size)).otherwise(0).alias("ratio"),
            F.col("_auto").alias("auto_truncated"), F.col("_error").alias("error"), F.when(ok, F.col("_body")).alias("body"),
        ).alias("result"),
    )
    return plain.unionByName(condensed)


def render(result: Column) -> Column:
    """One string: the unchanged text, the error, or a header line with the body."""
    skipped = F.when(result["n_skipped"] > 0, F.concat(F.lit(", "), result["n_skipped"], F.lit(" chunk(s) skipped as not relevant to the focus"))).otherwise("")
    note = F.when(result["auto_truncated"], F.concat(F.lit("\n(only the first "), result["original_len"], F.lit(" chars were read, as the focus asks for the beginning)"))).otherwise("")
    header = F.concat(
        F.lit("[compressed "), result["original_len"], F.lit(" -> "), result["compressed_len"], F.lit(" chars across "), result["n_chunks"], F.lit(" chunk(s)"), skipped,
        F.lit(", ~"), result["ratio"], F.lit("% smaller]"), note, F.lit("\n\n"),
    )
    return F.when(result["status"] == "unchanged", result["body"]).when(result["status"] == "error", result["error"]).otherwise(F.concat(header, result["body"]))


def page_text(html: Column, extracted: Column | None = None) -> Column:
    """An extractor's text where it isn't blank, else the page without its tags; null if empty."""
    plain = F.nullif(strip_tags(html), F.lit(""))
    return plain if extracted is None else F.coalesce(F.nullif(strip(extracted), F.lit("")), plain)


def with_exit_code(exit_code: Column, text: Column) -> Column:
    return F.concat(F.lit("[exit code "), exit_code.cast("string"), F.lit("]\n"), text)


def with_url(url: Column, raw_bytes: Column, text: Column) -> Column:
    return F.concat(F.lit("[fetched "), url, F.lit(", "), raw_bytes.cast("string"), F.lit(" raw bytes]\n"), text)


def compress_pages(rows: DataFrame, url: str, fetcher: PageFetcher | DataFrame, *, extract: Callable[[Column], Column] | None = main_content, focus: str = WEB_FOCUS, **options) -> DataFrame:
    """(url, text) of each distinct address: the page's condensed text below a line that names it,
    or an error. ``extract`` makes the main text of a page, None takes all of it; each page is fetched once.
    A table (url, html) of stored pages, each address once, is a fetcher as well."""
    asked = rows.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    if isinstance(fetcher, DataFrame):
        stored = fetcher.select(F.col("url").alias("_url"), "html", F.lit(True).alias("_stored"))
        missing = F.when(F.col("_stored").isNull(), F.concat(F.lit("no page is stored for "), F.col("url")))
        found = asked.join(stored, F.col("url") == F.col("_url"), "left").select("url", F.struct("html", missing.alias("error")).alias("page"))
    else:
        found = asked.withColumn("page", fetcher.fetch(F.col("url")))
    html = F.col("page.html")
    pages = checkpoint(found.select("url", F.col("page.error").alias("wrong"), F.octet_length(html).alias("raw_bytes"), page_text(html, extract(html) if extract else None).alias("text")))
    condensed = compress(pages, "url", "text", focus=focus, **options)
    failed = F.when(F.col("wrong").isNotNull(), F.concat(F.lit("Error: "), F.col("url"), F.lit(" wasn't fetched: "), F.col("wrong")))
    failed = failed.when(F.col("text").isNull(), F.concat(F.lit("Error: there is no text in "), F.col("url"), F.lit(".")))
    both = pages.select("url", "raw_bytes", failed.alias("failed")).join(condensed, "url")
    return both.select("url", F.coalesce("failed", with_url(F.col("url"), F.col("raw_bytes"), render(F.col("result")))).alias("text"))


def compress_commands(rows: DataFrame, command: str, runner: CommandRunner | DataFrame, **options) -> DataFrame:
    """(command, text) of each distinct command: its condensed output below its exit code, or an
    error; each is run once. A table (command, exit_code, stdout, stderr) of recorded runs, each
    command once, is a runner as well."""
    asked = rows.select(F.col(command).alias("command")).where(F.col("command").isNotNull()).distinct()
    if isinstance(runner, DataFrame):
        stored = runner.select(F.col("command").alias("_command"), "exit_code", "stdout", "stderr", F.lit(True).alias("_stored"))
        missing = F.when(F.col("_stored").isNull(), F.concat(F.lit("no run is recorded of "), F.col("command")))
        found = asked.join(stored, F.col("command") == F.col("_command"), "left").select("command", F.struct("exit_code", "stdout", "stderr", missing.alias("error")).alias("run"))
    else:
        found = asked.withColumn("run", runner.run(F.col("command")))
    runs = checkpoint(found.select("command", F.col("run.error").alias("wrong"), "run.exit_code", combined_output(F.col("run.stdout"), F.col("run.stderr")).alias("text")))
    condensed = compress(runs, "command", "text", **options)
    failed = F.when(F.col("wrong").isNotNull(), F.concat(F.lit("Error: the command wasn't run: "), F.col("wrong")))
    both = runs.select("command", "exit_code", failed.alias("failed")).join(condensed, "command")
    return both.select("command", F.coalesce("failed", with_exit_code(F.col("exit_code"), render(F.col("result")))).alias("text"))
