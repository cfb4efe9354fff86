"""Tool-call linking: calls and results joined by identifier, checked against schemas, ordered, in canonical JSON. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

_CALLS = "tool_calls array<struct<id string, name string, arguments variant, after array<string>>>, tool_call_id string, content variant"
#: JSON types of arguments by the type names that Spark gives to variants.
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages whose text is a JSON object with ``tool_calls`` or ``tool_call_id``; other texts give neither.

    calls: conv, pos, call_id, name, arguments (JSON), after (ids of calls that must come
    first). results: conv, pos, call_id, content (JSON). Calls and results without an id
    can't be linked and are left to the caller as plain messages.
    """
    own = messages.select(F.col(conv_col).alias("conv"), F.col(pos_col).alias("pos"), F.from_json(F.col(text_col), _CALLS).alias("m"))
    calls = own.select("conv", "pos", F.explode("m.tool_calls").alias("c")).where("c.id IS NOT NULL")
    calls = calls.select("conv", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.coalesce("c.after", F.array()).alias("after"))
    results = own.where("m.tool_call_id IS NOT NULL")
    return calls, results.select("conv", "pos", F.col("m.tool_call_id").alias("call_id"), F.to_json("m.content").alias("content"))


def canonical_json(json: Column) -> Column:
    """Keys in byte order at every level, no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def _quoted(name: str) -> Column:
    """A string column as a JSON string, or null."""
    json = F.to_json(F.array(name))
    return json.substr(F.lit(2), F.length(json) - 2)


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    out = F.lit("number")
    for kind, start in _TYPES.items():
        out = F.when(name.startswith(start), kind).otherwise(out)
    return out


def argument_errors(arguments: Column, params: Column) -> Column:
    """Sorted messages on arguments (JSON) against params, an array of (param, type, required); one message if there is no such tool."""
    parsed = F.try_parse_json(arguments)
    object_ = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.when(object_, parsed).otherwise(F.parse_json(F.lit("{}"))).cast("map<string,variant>")
    names = F.map_keys(given)
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))
    fits = lambda p: (p["type"] == _kind(F.try_element_at(given, p["param"]))) | ((p["type"] == "number") & (_kind(F.try_element_at(given, p["param"])) == "integer"))
    wrong = F.transform(F.filter(params, lambda p: F.array_contains(names, p["param"]) & ~fits(p)), lambda p: F.concat(F.lit("not "), p["type"], F.lit(" "), p["param"]))
    known = F.transform(params, lambda p: p["param"])
    extra = F.transform(F.filter(names, lambda n: ~F.array_contains(known, n)), lambda n: F.concat(F.lit("unknown "), n))
    found = F.array_sort(F.concat(missing, wrong, extra))
    return F.when(params.isNull(), F.array(F.lit("no such tool"))).when(~object_, F.array(F.lit("arguments are no object"))).otherwise(found)


def _anchored(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, call_id, up, dist) of the calls that need one other: where the run of such calls ends, and how far off.

    Every round doubles how far a call looks along its run, so there are as many as the
    longest conversation has binary digits; who still finds such a call then is on a
    cycle or behind one, and keeps it as ``up``.
    """
    alone = needs.groupBy("conv", "call_id").agg(F.count("*").alias("m"), F.min("need").alias("up")).where("m = 1")
    state = saved(alone.select("conv", "call_id", "up", F.lit(1).cast("long").alias("dist")))
    longest = calls.agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        ahead = state.select("conv", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        state = saved(state.join(ahead, ["conv", "up"], "left").select("conv", "call_id", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
    return state


def _placed(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, level) of the calls in ``ends`` that hang on no cycle: the longest way along ``edges(conv, call_id, need, dist)``.

    A round places the calls whose needs are all placed.
    """
    now = saved(ends.join(edges, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).cast("long").alias("level")))
    done, known, rounds = now, None, 0
    while not edges.isEmpty():
        met = edges.join(now.select("conv", F.col("call_id").alias("need"), "level"), ["conv", "need"])
        met = met.groupBy("conv", "call_id").agg(F.max(F.col("level") + F.col("dist")).alias("level"))
        known = saved(met if known is None else known.union(met).groupBy("conv", "call_id").agg(F.max("level").alias("level")))
        edges = saved(edges.join(now.select("conv", F.col("call_id").alias("need")), ["conv", "need"], "left_anti"))
        now = saved(known.join(edges, ["conv", "call_id"], "left_anti"))
        if now.isEmpty():
            break
        known = known.join(edges, ["conv", "call_id"], "left_semi")
        done, rounds = done.union(now), rounds + 1
        if rounds % 20 == 0:  # a plan stays short, whatever the number of rounds
            done = saved(done)
    return done


def _levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(conv, call_id, level, cyclic) of the calls in conversations where some call stands before one that it needs.

    Runs of calls that need one other each are passed by in one step, so rounds are as
    many as calls with several needs stand behind each other.
    """
    late = links.where("pos < need_pos").select("conv").distinct()
    sizes = calls.join(late, "conv", "left_semi").groupBy("conv").agg(F.count("*").alias("n"))
    left = saved(calls.select("conv", "call_id").join(sizes, "conv"))
    needs = saved(links.join(late, "conv", "left_semi").select("conv", "call_id", "need"))
    runs = _anchored(left, needs)
    ends = left.select("conv", "call_id").join(runs, ["conv", "call_id"], "left_anti")
    via = runs.select("conv", F.col("call_id").alias("need"), F.col("up").alias("end"), F.col("dist").alias("more"))
    edges = needs.join(ends, ["conv", "call_id"], "left_semi").join(via, ["conv", "need"], "left")
    edges = edges.groupBy("conv", "call_id", F.coalesce("end", "need").alias("need")).agg(F.max(1 + F.coalesce("more", F.lit(0))).alias("dist"))
    placed = _placed(saved(ends), saved(edges))
    behind = runs.join(placed.select("conv", F.col("call_id").alias("up"), "level"), ["conv", "up"]).select("conv", "call_id", (F.col("level") + F.col("dist")).alias("level"))
    out = left.join(placed.union(behind), ["conv", "call_id"], "left")
    return out.select("conv", "call_id", F.coalesce("level", "n").cast("int").alias("level"), F.col("level").isNull().alias("cyclic"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """One row per conversation and call id: conv, call_id, level, pos, status, errors, n_calls, n_results, json.

    ``calls(conv, pos, call_id, name, arguments, after)`` and ``results(conv, pos, call_id,
    content)`` are hash-joined by conversation and id; ``schemas(name, param, type,
    required)`` has a row per parameter. status is ``linked``, ``no result`` or ``no call``;
    errors lists what is wrong with the arguments and with ``after``; json has the call
    and its result with sorted keys and without spaces.

    (level, pos) is a topological order of a conversation: a call comes after those in
    its ``after``. Where the messages already stand in such an order all levels are 0;
    otherwise a level is the length of the longest chain of needs, and calls on a cycle or
    behind one come last with the error ``cycle``, at the level of their conversation's
    number of calls. Runs of calls that need one other each take rounds in the logarithm of their length;
    calls that need several take one round for each such call behind another. A conversation's rows are
    never gathered: sort the output to read them in order.

    Of several calls or results with one id the first by (pos, text) counts, and
    n_calls and n_results tell how many there were. A null conversation or id can't be
    linked: such calls and results are left out. A null name is no tool; null or broken
    arguments are no object and appear as null. Empty tables give an empty result.
    """
    calls = calls.where("conv IS NOT NULL AND call_id IS NOT NULL")
    first = F.min(F.struct("pos", "arguments", "name", "after")).alias("call")
    calls = saved(calls.groupBy("conv", "call_id").agg(first, F.count("*").alias("n_calls")))
    results = results.where("conv IS NOT NULL AND call_id IS NOT NULL")
    results = results.groupBy("conv", "call_id").agg(F.min(F.struct("pos", "content")).alias("result"), F.count("*").alias("n_results"))

    tools = schemas.where("name IS NOT NULL AND param IS NOT NULL").groupBy("name").agg(F.sort_array(F.collect_set(F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("params"))
    few = tools.limit(max_broadcast + 1).count() <= max_broadcast
    out = calls.join(results, ["conv", "call_id"], "full").withColumn("name", F.col("call.name"))
    out = out.join(F.broadcast(tools) if few else tools, "name", "left")

    at = calls.select("conv", F.col("call_id").alias("need"), F.col("call.pos").alias("need_pos"))
    wants = calls.select("conv", "call_id", F.col("call.pos").alias("pos"), F.explode(F.array_distinct("call.after")).alias("need"))
    wants = wants.where("need IS NOT NULL")
    links = wants.join(at, ["conv", "need"])
    # in order by position unless the other call stands later; a call that needs itself is a cycle
    links = links.withColumn("need_pos", F.when(F.col("need") == F.col("call_id"), F.col("pos") + 1).otherwise(F.col("need_pos")))
    levels = _levels(calls, links)
    unknown = wants.join(at, ["conv", "need"], "left_anti").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown call "), F.col("need")))).alias("unknown"))

    out = out.join(levels, ["conv", "call_id"], "left").join(unknown, ["conv", "call_id"], "left")
    none = F.array().cast("array<string>")
    errors = F.when(F.col("call").isNull(), none).otherwise(argument_errors(F.col("call.arguments"), F.col("params")))
    errors = F.concat(errors, F.coalesce("unknown", none), F.when(F.col("cyclic"), F.array(F.lit("cycle"))).otherwise(none))
    status = F.when(F.col("call").isNull(), "no call").when(F.col("result").isNull(), "no result").otherwise("linked")
    text = lambda c: F.coalesce(c, F.lit("null"))
    parts = (('{"arguments":', text(canonical_json(F.col("call.arguments")))), (',"id":', _quoted("call_id")), (',"name":', _quoted("name")), (',"result":', text(canonical_json(F.col("result.content")))))
    json = F.concat(*[x for name, value in parts for x in (F.lit(name), value)], F.lit("}"))
    return out.select(
        "conv", "call_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("call.pos", "result.pos").alias("pos"), status.alias("status"),
        F.array_join(errors, "; ").alias("errors"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), json.alias("json"),
    )
