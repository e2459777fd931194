"""Text expressions against Python's own string methods."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.functions import text as T

SPACES = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k).isspace()]
SAMPLES = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "  # x\n y \n#z\n", "\n\n\n", "日本\n語", "".join(SPACES) + "x" + "".join(SPACES), "".join(SPACES)]


def rows(spark, texts, *cols):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *cols)
    return [r[1:] if len(r) > 2 else r[1] for r in sorted(df.collect())]


def windows(lines, size, overlap):
    step, out, at = max(size - overlap, 1), [], 0
    while at < len(lines):
        own = "\n".join(lines[at : at + size]).strip()
        if own:
            out.append((own, at + 1, min(at + size, len(lines))))
        if at + size >= len(lines):
            break
        at += step
    return out


def test_there_are_29_spaces():
    assert len(SPACES) == 29


def test_strip_and_split(spark):
    assert rows(spark, SAMPLES, T.strip("t")) == [s.strip() for s in SAMPLES]
    assert rows(spark, SAMPLES, T.split_lines("t")) == [s.splitlines() for s in SAMPLES]


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (3, 0), (3, 1), (3, 2), (3, 5), (2, -1)])
def test_line_windows(spark, size, overlap):
    texts = ["\n".join(f"l{k}" if k % 4 else "  " for k in range(n)) for n in range(9)]
    got = rows(spark, texts, T.line_windows(T.split_lines("t"), size, overlap).alias("w"))
    assert [[tuple(w) for w in ws] for ws in got] == [windows(t.splitlines(), size, overlap) for t in texts]


def test_line_windows_need_a_line(spark):
    with pytest.raises(ValueError, match="at least one"):
        T.line_windows(T.split_lines("t"), 0, 0)


def test_heading_sections(spark):
    texts = ["", "a\nb", "# a\nb", "x\n# a\nb\n # c\n\n#!d", "# a\n# b", "```\n# a\n```\n# b\nc"]
    got = rows(spark, texts, T.heading_sections(T.split_lines("t"), 2, 0).alias("w"))
    assert [[tuple(w) for w in ws] for ws in got] == [
        [], [("a\nb", 1, 2)], [("# a\nb", 1, 2)], [("# a\nb", 2, 3), ("# c", 4, 5), ("#!d", 6, 6)], [("# a", 1, 1), ("# b", 2, 2)], [("# a\n```", 2, 3), ("# b\nc", 4, 5)],
    ]
    kept = rows(spark, texts[3:4], T.heading_sections(T.split_lines("t"), 2, 0, keep_preamble=True).alias("w"))
    assert tuple(kept[0][0]) == ("x", 1, 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20), st.integers(1, 7))
def test_char_chunks_join_to_the_text(spark, texts, size):
    got = rows(spark, texts, T.char_chunks("t", size))
    for t, chunks in zip(texts, got, strict=True):
        assert "".join(chunks) == t
        assert chunks == ([t[k : k + size] for k in range(0, len(t), size)] or [""])


def test_heading_boundary(spark):
    long = "w" * 81
    at = lambda offset, heading, before=long, after=long: "x" * (offset - len(before) - 2) + "\n" + before + "\n" + heading + "\n" + after
    cases = [(at(299, "Head"), None), (at(300, "Head"), 300), (at(20_000, "Head"), 20_000), (at(20_001, "Head"), None), (at(400, "h" * 59), 400), (at(400, "h" * 60), None)]
    cases += [(at(400, f"Head{c}"), None) for c in ".!?:)],"] + [(at(400, "Head", before="w" * 80), None), (at(400, "Head", after="w" * 80), None), (at(400, "Head", after=""), None), ("", None)]
    assert rows(spark, [t for t, _ in cases], T.heading_boundary("t")) == [b for _, b in cases]


def test_positional_focus(spark):
    yes = ["The Introduction", "LEDE", "tl;dr", "an abstract class", "top of the page", *T.POSITIONAL_PHRASES]
    no = ["errors", "", "first", "intro"]
    assert rows(spark, yes + no, T.looks_positional("t")) == [True] * len(yes) + [False] * len(no)


def test_small_ones(spark):
    texts = [" a, b ,,a", "", "x/y.TAR.GZ", "x/.hidden", "x/.hidden.py", "noext"]
    assert rows(spark, texts[:2], T.csv_set("t")) == [["a", "b"], []]
    assert rows(spark, texts[2:], T.suffix("t")) == [".gz", "", ".py", ""]
    assert rows(spark, ["<p>a&amp;<b>b</b>\n</p>", "<script>x</script>"], T.strip_tags("t")) == ["a&amp; b", "x"]
    assert rows(spark, ["", "q"], T.or_default("t", "d")) == ["d", "q"]
    assert rows(spark, ["a\nb"], T.preview("t")) == ["a b..."]
    assert rows(spark, ["out"], T.combined_output(F.col("t"), F.lit("err"))) == ["out\n--- stderr ---\nerr"]
    assert rows(spark, ["out"], T.combined_output(F.col("t"), F.lit(None).cast("string"))) == ["out"]


def test_windows_cover_all_lines(spark):
    r = random.Random(3)
    texts = ["\n".join(f"line{k}" for k in range(r.randrange(1, 60))) for _ in range(20)]
    for t, ws in zip(texts, rows(spark, texts, T.line_windows(T.split_lines("t"), 7, 2)), strict=True):
        assert {k for w in ws for k in range(w["start_line"], w["end_line"] + 1)} == set(range(1, len(t.split("\n")) + 1))


def test_strip_takes_time_in_proportion(spark):
    import time

    blanks = F.repeat(F.lit(" \u2003\n\x85"), 250_000)
    df = spark.range(1).select(F.concat(blanks, F.lit("a"), blanks, F.lit("b"), blanks).alias("t"))
    df.select(F.char_length(T.strip("t"))).collect()
    began = time.time()
    assert df.select(F.char_length(T.strip("t"))).first()[0] == 1_000_002
    assert time.time() - began < 3
