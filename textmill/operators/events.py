"""Tool events: which are condensed, what of them, and how the result is written back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textmill.functions.providers import Reachability, is_reachable
from textmill.functions.settings import number_setting
from textmill.functions.text import combined_output

# Fixed value: tools whose output may be condensed.
TOOLS = ("Bash", "Grep", "WebFetch", "Glob", "WebSearch")
THRESHOLD_CHARS = 2_000
LEAF_CHARS = 200


def allowed(tool: Column, response: Column) -> Column:
    return tool.isin(*TOOLS) & response.isNotNull()


def command_of(tool_input: Column) -> Column:
    """The command of a JSON input, or an empty text."""
    return F.coalesce(F.get_json_object(tool_input, "$.command"), F.lit(""))


def bash_text(response: Column) -> Column:
    return combined_output(F.get_json_object(response, "$.stdout"), F.get_json_object(response, "$.stderr"))


def threshold_setting() -> int:
    """The threshold that the environment names, or the default."""
    return number_setting("TEXTMILL_THRESHOLD_CHARS", THRESHOLD_CHARS)


def bash_passes(response: Column, threshold: int | None = None) -> Column:
    threshold = threshold_setting() if threshold is None else threshold
    return F.char_length(bash_text(response)) >= threshold


def web_route(tool: Column, url: Column, prompt: Column, reachable: bool | Reachability) -> Column:
    """``allow``, or ``deny`` for fetches that a reachable provider should make instead.

    A probe is asked when the plan is made; a stream that must ask anew routes each micro-batch
    in ``foreachBatch``. One that fails counts as not reachable, so that the fetch goes on.
    """
    return F.when((tool == "WebFetch") & F.lit(is_reachable(reachable)), "deny").otherwise("allow")


def web_reason(url: Column, prompt: Column) -> Column:
    return F.concat(F.lit("Fetch "), url, F.lit(" with the condensing tool"), F.when(F.coalesce(prompt, F.lit("")) != "", F.concat(F.lit(", focus: "), prompt)).otherwise(""), F.lit("."))


def command_route(command: Column) -> Column:
    return F.when(F.coalesce(command, F.lit("")) == "", "allow").otherwise("deny")


#: JSON that is nested deeper isn't read: it has no leaves and is written back as it is.
MAX_DEPTH = 500
_JSON_STRING, _LONE_SURROGATE = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL), re.compile("[\ud800-\udfff]")


def parse_json(value: str | None) -> tuple[bool, object]:
    """(whether it is JSON of at most MAX_DEPTH levels, its value)."""
    if value is None:
        return False, None
    if value.count("[") + value.count("{") > MAX_DEPTH:
        depth = deepest = 0
        for sign in re.findall(r"[\[{\]}]", _JSON_STRING.sub("", value)):
            depth += 1 if sign in "[{" else -1
            deepest = max(deepest, depth)
        if deepest > MAX_DEPTH:
            return False, None
    try:
        return True, json.loads(value)
    except ValueError:
        return False, None


def text_leaves(value: str | None) -> list[tuple[list[str], str]]:
    """(path, leaf) of a JSON value's texts in the order of the document."""
    found: list[tuple[list[str], str]] = []
    todo: list[tuple[tuple[str, ...], object]] = [((), parse_json(value)[1])]
    while todo:
        path, node = todo.pop()
        if isinstance(node, str):
            found.append((list(path), node))
        elif isinstance(node, dict | list):
            items = node.items() if isinstance(node, dict) else enumerate(node)
            todo += [((*path, str(k)), v) for k, v in reversed(list(items))]
    return found


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, ordinal, leaf) of a JSON column.

    What isn't JSON, or is nested deeper than MAX_DEPTH, has no leaves. Half of a surrogate pair,
    which no text can hold, is U+FFFD in a leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda text: _LONE_SURROGATE.sub("\ufffd", text)
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            found = [(row, n, [shown(p) for p in path], shown(leaf)) for row, value in enumerate(batch.column(1).to_pylist()) for n, (path, leaf) in enumerate(text_leaves(value))]
            row, ordinal, path, leaf = zip(*found, strict=True) if found else ((), (), (), ())
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(path, pa.list_(pa.string())), pa.array(ordinal, pa.int32()), pa.array(leaf, pa.string())], names=[key, "path", "ordinal", "leaf"])

    source = rows.select(F.col(key), F.col(column).alias("_json"))
    schema = StructType([StructField(key, source.schema[key].dataType), StructField("path", ArrayType(StringType())), StructField("ordinal", IntegerType()), StructField("leaf", StringType())])
    return source.mapInArrow(run, schema)


def select_leaves(leaves: DataFrame, key: str, *, leaf: str = "leaf", ordinal: str = "ordinal", threshold: int | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Events with enough text in large leaves: total_chars, n_leaves, the first longest leaf's
    ordinal, and the large leaves in order with a blank line between."""
    threshold = threshold_setting() if threshold is None else threshold
    large = leaves.where(F.char_length(leaf) >= leaf_chars)
    found = large.groupBy(key).agg(
        F.sum(F.char_length(leaf)).alias("total_chars"), F.count("*").alias("n_leaves"),
        F.max_by(ordinal, F.struct(F.char_length(leaf), -F.col(ordinal))).alias("largest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(leaf).alias("t")))), lambda x: x["t"]), "\n\n").alias("body"),
    )
    return found.where(F.col("total_chars") >= threshold)


def rewrite(value: str | None, result: str | None, leaf_chars: int) -> str | None:
    """The longest large leaf (the first of equals) replaced, other large ones emptied; what
    isn't JSON, or is nested deeper than MAX_DEPTH, as it is."""
    known, root = parse_json(value)
    if not known or result is None:
        return value
    if isinstance(root, str):
        return json.dumps(result, ensure_ascii=False)
    # Depth first in the order of the document, as ``text_leaves`` numbers the leaves.
    places: list[tuple] = []
    todo: list[tuple] = [(None, None, root)]
    while todo:
        holder, k, node = todo.pop()
        if isinstance(node, str):
            places.append((holder, k, node))
        elif isinstance(node, dict | list):
            items = list(node.items() if isinstance(node, dict) else enumerate(node))
            todo += [(node, at, child) for at, child in reversed(items)]
    large = [x for x in places if len(x[2]) >= leaf_chars]
    if not large:
        return value
    best = max(large, key=lambda x: len(x[2]))
    for node, k, _ in large:
        node[k] = ""
    best[0][best[1]] = result
    # Half of a surrogate pair stays the escape that it was.
    return _LONE_SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(root, ensure_ascii=False))


def write_back(response: Column, result: Column, leaf_chars: int = LEAF_CHARS) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series, results: pd.Series) -> pd.Series:
        return pd.Series([rewrite(v, r, leaf_chars) for v, r in zip(values, results, strict=True)], dtype=object)

    return run(response, result)


def bash_write_back(response: Column, result: Column) -> Column:
    """stdout replaced, stderr emptied, other keys as they are; what isn't a JSON object stays, as
    does all where there is no result. The keys of the new object come in order."""
    node = F.try_parse_json(response).try_cast("map<string,variant>")
    others = F.map_filter(node, lambda k, _: ~k.isin("stdout", "stderr"))
    new = F.map_concat(others, F.create_map(F.lit("stdout"), result.cast("variant"), F.lit("stderr"), F.lit("").cast("variant")))
    return F.when(node.isNotNull() & result.isNotNull(), F.to_json(new)).otherwise(response)


def response_json(action: Column, payload: Column) -> Column:
    """The decision as one JSON text: action is unchanged, updated or deny."""
    return F.to_json(F.struct(action.alias("action"), payload.alias("payload")))


def failure_note(tool: Column, chars: Column, error: Column) -> Column:
    return F.concat(tool, F.lit(" output ("), chars.cast("string"), F.lit(" chars) was left unchanged: "), error)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    rows.write.mode("append").json(path)
