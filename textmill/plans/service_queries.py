"""Registered queries over pages, answers of services, models and collections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.functions.providers import ExtractiveCompleter, resolved_model
from textmill.operators import compress as condense
from textmill.operators import events, manifest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stripped(x: str) -> str:
    """SQL of ``strip_tags``, for texts whose white space is ASCII."""
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def _main_content_sql(html: str) -> str:
    page = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in text.NO_TEXT:
        page = rf"regexp_replace({page}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', chr(1), 'g')"
    blocks = rf"string_split(regexp_replace({page}, '(?i)</?(?:{text.BLOCKS})(?:\s[^>]*)?/?>', chr(1), 'g'), chr(1))"
    unlinked = _stripped(r"regexp_replace(b, '(?is)<a(?:\s[^>]*)?>.*?</a\s*>', ' ', 'g')")
    sized = f"list_transform({blocks}, lambda b: {{'t': {_stripped('b')}, 'u': length({unlinked})}})"
    dense = f"list_filter({sized}, lambda x: length(x.t) >= {text.BLOCK_CHARS} AND 2 * x.u >= length(x.t))"
    return f"array_to_string(list_transform({dense}, lambda x: x.t), chr(10))"


def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.main_content("html").alias("text"))


MAIN_CONTENT = f"SELECT page_id, {_main_content_sql('html')} AS text FROM pages"


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored page by its address and an address for each that isn't stored: fetched, its
    main text condensed, or an error. Of pages that repeat an address the first by page_id counts."""
    first = F.min(F.struct("page_id", "html"))
    pages = _table(spark, sf_dir, "pages").groupBy("url").agg(first.alias("page")).select("url", "page.html")
    urls = pages.select("url").union(pages.select(F.concat("url", F.lit("?gone"))))
    return condense.compress_pages(urls, "url", pages)


def _condensed_sql(source: str) -> str:
    """CTEs of condensing ``source(doc_id, text)`` by the defaults: a(doc_id, t)."""
    return f"""c AS (SELECT doc_id, text, unnest(range(0, length(text), 12000)) AS s FROM {source} WHERE length(text) BETWEEN 2000 AND 2000000),
  n AS (SELECT doc_id, s, length(text) AS o, trim(substring(text, s + 1, 80), ' ' || chr(10)) AS summary, count(*) OVER (PARTITION BY doc_id) AS m FROM c),
  g AS (SELECT doc_id, any_value(o) AS o, any_value(m) AS m,
    string_agg(CASE WHEN m > 1 THEN '[part ' || (s // 12000 + 1) || '/' || m || ']' || chr(10) ELSE '' END || summary, chr(10) || chr(10) ORDER BY s) AS body FROM n GROUP BY doc_id),
  a AS (SELECT doc_id, '[compressed ' || o || ' -> ' || length(body) || ' chars across ' || m || ' chunk(s), ~' ||
      CAST(round_even(100 * (1 - length(body) / o), 0) AS INT) || '% smaller]' || chr(10) || chr(10) || body AS t FROM g
    UNION ALL SELECT doc_id, text FROM {source} WHERE length(text) < 2000)"""


PAGE_TEXTS = f"""
WITH p AS (SELECT url AS doc_id, strlen(html) AS raw_bytes, coalesce(nullif({_main_content_sql('html')}, ''), {_stripped('html')}) AS text FROM (SELECT DISTINCT ON (url) url, html FROM pages)),
  {_condensed_sql('p')}
SELECT doc_id AS url, '[fetched ' || doc_id || ', ' || raw_bytes || ' raw bytes]' || chr(10) || t AS text FROM a JOIN p USING (doc_id)
UNION ALL SELECT doc_id || '?gone', 'Error: ' || doc_id || '?gone wasn''t fetched: no page is stored for ' || doc_id || '?gone' FROM p"""


def command_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs recorded of every document, asked for by their commands, and a command for each of
    which there is none."""
    runs = _table(spark, sf_dir, "documents").selectExpr("concat('show ', doc_id) AS command", "CAST(doc_id % 3 AS INT) AS exit_code", "text AS stdout", "CASE WHEN doc_id % 4 = 0 THEN source ELSE '' END AS stderr")
    asked = runs.select("command").union(runs.select(F.concat(F.lit("un"), "command")))
    return condense.compress_commands(asked, "command", runs)


COMMAND_TEXTS = f"""
WITH p AS (SELECT 'show ' || doc_id AS doc_id, doc_id % 3 AS exit_code, text || CASE WHEN doc_id % 4 = 0 AND source <> '' THEN chr(10) || '--- stderr ---' || chr(10) || source ELSE '' END AS text FROM documents),
  {_condensed_sql('p')}
SELECT doc_id AS command, '[exit code ' || exit_code || ']' || chr(10) || t AS text FROM a JOIN p USING (doc_id)
UNION ALL SELECT 'un' || doc_id, 'Error: the command wasn''t run: no run is recorded of un' || doc_id FROM p"""


def limited_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an explicit limit every chunk counts as relevant, whatever the classifier would say."""
    found = condense.compress(_table(spark, sf_dir, "documents"), "doc_id", "text", max_chars=F.when(F.col("doc_id") % 2 == 0, 3_000).otherwise(-100), limits=condense.Limits(chunk_chars=2_500), completer=ExtractiveCompleter("never there"))
    return found.select("doc_id", "result.status", "result.original_len", "result.n_chunks", "result.n_skipped", F.sha2("result.body", 256).alias("body_sha256"))


LIMITED_SCOPE = """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 3000) ELSE substring(text, 1, greatest(length(text) - 100, 0)) END AS text FROM documents),
  c AS (SELECT doc_id, length(text) AS o, text, unnest(range(0, length(text), 2500)) AS s FROM t WHERE length(text) >= 2000),
  n AS (SELECT *, trim(substring(text, s + 1, least(80, 2500)), ' ' || chr(10)) AS summary, count(*) OVER (PARTITION BY doc_id) AS m FROM c)
SELECT doc_id, 'compressed' AS status, CAST(any_value(o) AS INT) AS original_len, CAST(any_value(m) AS INT) AS n_chunks, 0 AS n_skipped,
  sha256(string_agg(CASE WHEN m > 1 THEN '[part ' || (s // 2500 + 1) || '/' || m || ']' || chr(10) ELSE '' END || summary, chr(10) || chr(10) ORDER BY s)) AS body_sha256 FROM n GROUP BY doc_id
UNION ALL SELECT doc_id, 'unchanged', CAST(length(text) AS INT), 0, 0, sha256(text) FROM t WHERE length(text) < 2000"""


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as it is written for people."""
    docs = _table(spark, sf_dir, "documents").withColumn("rel_path", F.concat_ws("/", "source", "doc_id"))
    return manifest.render_manifest(manifest.file_hashes(docs, "rel_path", "text"))


MANIFEST_LINES = """SELECT source || '/' || doc_id AS rel_path, '{"' || source || '/' || doc_id || '":"' || sha256(text) || '"}' AS value FROM documents ORDER BY rel_path"""


def command_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command of an event's input and what becomes of it; inputs without one and broken ones."""
    shown = "CASE user_id % 4 WHEN 0 THEN to_json(named_struct('command', concat('run ', event_type))) WHEN 1 THEN props WHEN 2 THEN '{broken' END"
    rows = _table(spark, sf_dir, "events").select("event_id", events.command_of(F.expr(shown)).alias("command"))
    return rows.select("event_id", "command", events.command_route(F.col("command")).alias("route"))


COMMAND_INPUT = """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'run ' || event_type ELSE '' END AS command, CASE WHEN user_id % 4 = 0 THEN 'deny' ELSE 'allow' END AS route FROM events"""


def quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in quotes, with quotes and characters that aren't printed put into them."""
    added = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "it's").when(F.col("doc_id") % 3 == 1, "it's \"so\"").otherwise(""), F.lit("\x7f\u200b\u3000\t\\"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(condense.python_repr(added), 256).alias("quoted_sha256"))


QUOTED_TEXT = r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN 'it''s' WHEN 1 THEN 'it''s "so"' ELSE '' END AS x FROM documents),
  s AS (SELECT doc_id, x, replace(replace(replace(replace(x, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '\x7f\u200b\u3000\t\\' AS safe FROM t)
SELECT doc_id, sha256(CASE WHEN contains(x, '''') AND NOT contains(x, '"') THEN '"' || safe || '"' ELSE '''' || replace(safe, '''', '\''') || '''' END) AS quoted_sha256 FROM s"""


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model asked for, the configured one, or the only one loaded, of settings made of events."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 5 = 0 THEN event_type WHEN user_id % 5 = 1 THEN '' END AS explicit", "CASE WHEN event_id % 7 = 0 THEN 'configured' END AS configured",
        "CASE event_id % 4 WHEN 0 THEN array() WHEN 1 THEN array(event_type) WHEN 2 THEN array(event_type, 'other') END AS loaded",
    )
    chosen = resolved_model(F.col("explicit"), F.col("configured"), F.col("loaded"))
    return rows.select("event_id", chosen["model"].alias("model"), chosen["error"].alias("error"))


MODEL_CHOICE = """
WITH r AS (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN event_type END AS explicit, CASE WHEN event_id % 7 = 0 THEN 'configured' END AS configured FROM events),
  m AS (SELECT *, coalesce(explicit, configured, CASE WHEN event_id % 4 = 1 THEN event_type END) AS model FROM r)
SELECT event_id, model, CASE WHEN model IS NULL THEN CASE event_id % 4 WHEN 0 THEN 'Error: no model is loaded.'
  WHEN 2 THEN 'Error: several models are loaded (' || event_type || ', other); name one.' ELSE 'Error: the model service can''t be reached.' END END AS error FROM m"""

#: name -> (query, SQL)
REGISTRY = {
    "main_content": (main_content, MAIN_CONTENT), "page_texts": (page_texts, PAGE_TEXTS), "command_texts": (command_texts, COMMAND_TEXTS), "limited_scope": (limited_scope, LIMITED_SCOPE), "manifest_lines": (manifest_lines, MANIFEST_LINES),
    "command_input": (command_input, COMMAND_INPUT), "quoted_text": (quoted_text, QUOTED_TEXT), "model_choice": (model_choice, MODEL_CHOICE),
}
