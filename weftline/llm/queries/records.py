"""Queries over pages and conversations: URL filters, tool-call linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..tools import link_tool_calls, parse_messages
from ..urls import filter_urls
from .oracles import OP7, OP10

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of urls: the document that a path names by number, blocked if it is of low quality or toxic."""
    pages = table(spark, sf_dir, "pages")
    number = F.try_to_number(F.regexp_extract(F.col("url"), r"://[^/?#]*/[a-z]+/([0-9]{1,15})", 1), F.lit("9" * 15))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    labels = labels.select("doc_id", F.when(bad, "block").otherwise("allow").alias("verdict"))
    labelled = pages.select("url", number.cast("long").alias("doc_id")).join(labels, "doc_id").select("url", "verdict")
    return filter_urls(pages, labelled, RULES)


#: Tools of the query: (name, parameter, type, required).
TOOLS = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True), ("count", "chars", "integer", True), ("count", "turn", "integer", True)]


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool calls, so its turns are written as such: a user's turn is a call, the assistant's next turn its result.

    The call's text decides on the tool and on what is wrong with the arguments. In every
    other conversation a call needs the one before it, else the next one or the next
    two, which stand later; some calls need themselves.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.concat(F.lit("c"), "conv_id"), turn)
    turn, size = F.col("turn"), F.length("text")
    tool = F.when(size % 7 == 0, "guess").when(size % 2 == 1, "count").otherwise("reply")
    json = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    note = F.when(size % 5 == 0, F.col("text"))
    counted = F.when(size % 3 == 0, json(chars=size.cast("string"), note=note, turn=turn)).otherwise(json(chars=size, note=note, turn=turn))
    arguments = F.when(tool == "guess", json(turn=turn)).when(tool == "count", counted).otherwise(json(prompt=F.col("text"), turn=turn))
    before = F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array())
    after = F.when(size % 13 == 0, F.array(name(turn))).when(F.col("conv_id") % 2 == 0, before).when(F.col("conv_id") % 4 == 1, F.array(name(turn + 2))).otherwise(F.array(name(turn + 2), name(turn + 4)))
    call = F.struct(name(turn).alias("id"), tool.alias("name"), F.parse_json(arguments).alias("arguments"), after.alias("after"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    told = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", told).otherwise(F.col("text"))
    calls, results = parse_messages(turns.select("conv_id", "turn", text.alias("text")))
    out = link_tool_calls(calls, results, spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean"))
    return out.select(F.col("conv").alias("conv_id"), "call_id", "level", "pos", "status", "errors", "n_calls", "n_results", F.sha2("json", 256).alias("json_sha256"))


QUERIES = {f.__name__: f for f in (op7_tool_call_linking, op10_url_filters)}
SQL = {"op7_tool_call_linking": OP7, "op10_url_filters": OP10}
