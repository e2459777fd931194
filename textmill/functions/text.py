"""Text expressions over columns, with the exact rules of Python's string methods.

All are built-in Spark expressions, so they stay in generated code and need no shuffle.
Lengths and offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python counts as white space, and its line separators.
SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# White space that ends no line.
BLANK_CLASS = r"[\t\x1f \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# Phrases that ask for the beginning of a text.
POSITIONAL_PHRASES = (
    "abstract", "beginning of", "first few paragraphs", "first paragraph", "first section", "intro paragraph",
    "intro section", "introduction", "lead section", "lede", "opening paragraph", "opening section", "start of the",
    "tl;dr", "tldr", "top of the document", "top of the page",
)

HEADING_MAX, NEIGHBOUR_MIN = 60, 80
MIN_BOUNDARY, MAX_BOUNDARY = 300, 20_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """The text without white space at both ends; in time that grows with what is taken off."""
    return F.btrim(_col(c), F.lit(SPACE))


def split_lines(c: str | Column) -> Column:
    """Lines at any Unicode line separator; an empty text has none, a last separator adds none."""
    parts = F.split(_col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_windows(lines: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` lines every ``size - overlap`` (at least 1), up to the first that
    reaches the last line: array of (content, start_line, end_line), blank ones left out."""
    if size < 1:
        raise ValueError("a window needs at least one line")
    step = max(size - overlap, 1)
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s < n) & ((s == 0) | (s - step + size < n)))
    windows = F.transform(
        starts,
        lambda s: F.struct(
            strip(F.array_join(F.slice(lines, s + 1, size), "\n")).alias("content"),
            (s + 1).cast("int").alias("start_line"),
            F.least(s + size, n).cast("int").alias("end_line"),
        ),
    )
    return F.filter(windows, lambda w: w["content"] != "")


def headings(lines: Column) -> Column:
    """Places of the lines whose first character that isn't white space is #."""
    n = F.size(lines)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return F.filter(places, lambda i: F.get(lines, i).rlike(rf"^{SPACE_CLASS}*#"))


def heading_sections(lines: Column, size: int, overlap: int, keep_preamble: bool = False) -> Column:
    """A section from each heading to the next; line windows where there are under two headings.

    Lines before the first heading aren't part of a section; ``keep_preamble`` makes them one.
    """
    n, at = F.size(lines), headings(lines)
    # Places and texts are made once each and zipped: a lambda that looked them up would make them anew for every section.
    texts = F.split(F.array_join(lines, "\n"), rf"\n(?={BLANK_CLASS}*#)", -1)
    preamble = F.get(at, F.lit(0)) > 0
    starts, texts = (
        (F.when(preamble, F.concat(F.array(F.lit(0)), at)).otherwise(at), texts) if keep_preamble
        else (at, F.when(preamble, F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts))
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    sections = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e"), texts.alias("t")),
        lambda x: F.struct(strip(x["t"]).alias("content"), (x["s"] + 1).cast("int").alias("start_line"), x["e"].cast("int").alias("end_line")),
    )
    return F.when(F.size(at) < 2, line_windows(lines, size, overlap)).otherwise(F.filter(sections, lambda w: w["content"] != ""))


def char_chunks(c: str | Column, size: int) -> Column:
    """Slices of ``size`` code points; an empty text is one empty slice."""
    if size < 1:
        raise ValueError("a chunk needs at least one character")
    text = _col(c)
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)))


def heading_boundary(c: str | Column, min_offset: int = MIN_BOUNDARY, max_offset: int = MAX_BOUNDARY) -> Column:
    """Offset of the first line that looks like a heading between two long paragraphs, or null.

    It has 1 to 59 characters, no closing punctuation, an offset within the bounds, and its
    neighbours have over 80 characters each.
    """
    lines = F.transform(F.split(_col(c), "\n", -1), lambda x: F.struct(F.char_length(x).alias("n"), strip(x).alias("text")))

    # One pass, line by line: a heading is known when the line after it has been seen.
    def step(acc: Column, line: Column) -> Column:
        size = F.char_length(line["text"])
        long = size > NEIGHBOUR_MIN
        fits = acc["after_long"] & (acc["offset"] >= min_offset) & (acc["offset"] <= max_offset) & (size > 0) & (size < HEADING_MAX) & ~line["text"].rlike(r"[.!?:)\],]\z")
        return F.struct(
            (acc["offset"] + line["n"] + 1).alias("offset"), long.alias("after_long"), F.when(fits, acc["offset"]).alias("heading"),
            F.coalesce(acc["found"], F.when(long, acc["heading"])).alias("found"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("offset"), F.lit(False).alias("after_long"), none.alias("heading"), none.alias("found"))
    return F.aggregate(lines, start, step)["found"]


def looks_positional(focus: str | Column) -> Column:
    """Whether a focus asks for the beginning of a text, by one of the phrases within it."""
    low = F.lower(_col(focus))
    found = F.lit(False)
    for phrase in POSITIONAL_PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    return found


def strip_tags(c: str | Column) -> Column:
    """Markup replaced by blanks, white space made one blank; script bodies stay."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", " "), rf"{SPACE_CLASS}+", " "))


# Elements that are no main text with all they hold, and elements that begin or end a block.
NO_TEXT = ("script", "style", "noscript", "template", "svg", "head", "nav", "header", "footer", "aside", "form", "select", "button", "textarea")
BLOCKS = "address|article|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
#: A block of main text has so many characters, of which links are half at most.
BLOCK_CHARS = 40


def main_content(html: str | Column) -> Column:
    """The main text of a page by the density of its blocks, a line each: those that are long
    enough and mostly no links. Empty if there is none (callers fall back to ``strip_tags``)."""
    page = F.regexp_replace(_col(html), "(?s)<!--.*?-->", " ")
    for tag in NO_TEXT:
        page = F.regexp_replace(page, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "\x01")
    blocks = F.split(F.regexp_replace(page, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\x01"), "\x01", -1)
    sized = F.transform(blocks, lambda b: F.struct(strip_tags(b).alias("text"), F.char_length(strip_tags(F.regexp_replace(b, r"(?is)<a(?:\s[^>]*)?>.*?</a\s*>", " "))).alias("unlinked")))
    dense = F.filter(sized, lambda b: (F.char_length(b["text"]) >= BLOCK_CHARS) & (2 * b["unlinked"] >= F.char_length(b["text"])))
    return F.array_join(F.transform(dense, lambda b: b["text"]), "\n")


def or_default(c: str | Column, default: str | Column) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), _col(default) if isinstance(default, Column) else F.lit(default))


def combined_output(stdout: Column, stderr: Column) -> Column:
    """Standard output, with standard error after a separator where there is any."""
    tail = F.when(F.coalesce(stderr, F.lit("")) != "", F.concat(F.lit("\n--- stderr ---\n"), stderr)).otherwise("")
    return F.concat(F.coalesce(stdout, F.lit("")), tail)


def preview(c: str | Column, chars: int = 200, one_line: bool = True) -> Column:
    text = F.substring(_col(c), 1, chars)
    return F.concat(F.replace(text, F.lit("\n"), F.lit(" ")) if one_line else text, F.lit("..."))


def csv_set(c: str | Column) -> Column:
    """Items between commas, trimmed, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(_col(c), ",", -1), strip), lambda x: x != ""))


def suffix(path: str | Column) -> Column:
    """The lower-cased extension of a path's last part with its dot; a leading dot starts none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))
