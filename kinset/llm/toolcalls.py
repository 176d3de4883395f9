"""Tool-call linking in chats.

Calls and results are rows of a chat; they are joined by conversation and identifier,
never gathered by conversation. Calls name the calls whose results they need. A call's
level is the length of the longest chain of such calls before it, so sorting by level is
a topological order. Chains through one call each are shortened by pointer doubling;
arguments are checked against the tool's schema, and every call with its result is
written as one line of canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.operators.joins import attach
from kinset.plans.session import settle_counted

#: JSON types of a schema and how a parsed value of the type describes itself.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "(BIGINT|DOUBLE|DECIMAL.*)"}
SCHEMA = "tool string, params array<struct<param:string,type:string,required:boolean>>"


def tool_schemas(spark: SparkSession, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """A table of schemas from {tool: {parameter: (type, required)}}."""
    rows = [(t, [(p, kind, need) for p, (kind, need) in params.items()]) for t, params in tools.items()]
    return spark.createDataFrame(rows, SCHEMA)


def calls_of(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, tool, arguments, after) and results (conv_id, turn, call_id,
    result) of messages (conv_id, turn, role, content).

    An assistant's content may be {"tool_calls": [{"id", "name", "arguments", "after"}]}, a tool's
    {"tool_call_id", "content"}. Other contents, null or malformed ones, hold none.
    """
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:string>>>"
    calls = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.explode(F.from_json("content", kind)["tool_calls"]).alias("c")
    ).select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"),
        F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"),
    )
    kind = "struct<tool_call_id:string,content:string>"
    results = messages.where(F.col("role") == "tool").select(
        "conv_id", "turn", F.from_json("content", kind).alias("r")
    ).select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("result"))
    return calls, results


def first_of(rows: DataFrame, what: list[str]) -> DataFrame:
    """For each conversation and identifier the first row and the number of rows."""
    first = F.min(F.struct("turn", *what)).alias("_f")
    return rows.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        first, F.count(F.lit(1)).alias("times")
    ).select("conv_id", "call_id", "_f.*", "times")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls before each one along ``after``; null in a cycle.

    Pointer doubling: in every round each call looks twice as far ahead, so the rounds grow with
    the logarithm of the longest chain. A missing ``after`` call ends a chain.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("_there"))
    at, n = settle_counted(calls.select(*keys, "after"))
    at = attach(at, known, ["conv_id", "after"], n).select(
        *keys, F.when(F.col("_there"), F.col("after")).alias("to"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("level")
    )
    at, moving = settle_counted(at, F.col("to").isNotNull())
    reach = 1
    while moving and reach <= n:
        ahead = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        at = attach(at, ahead, ["conv_id", "to"], n).select(
            *keys, F.col("_to").alias("to"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")
        )
        at, moving = settle_counted(at, F.col("to").isNotNull())
        reach *= 2
    return at.select(*keys, F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def problems(arguments: Column, params: Column) -> Column:
    """What is wrong with arguments (JSON text) under a schema: missing, mistyped and unknown
    parameters, by name; one entry if they are no JSON object or the tool is unknown."""
    values = F.from_json(arguments, "map<string,variant>")
    of_type = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    kind = lambda p: F.schema_of_variant(values[p["param"]])
    wrong = F.transform(params, lambda p: F.when(
        ~F.array_contains(F.map_keys(values), p["param"]), F.when(p["required"], F.concat(F.lit("missing "), p["param"]))
    ).when(~F.rlike(kind(p), F.concat(F.lit("^"), of_type[p["type"]], F.lit("$"))), F.concat(F.lit("type of "), p["param"])))
    names = F.transform(params, lambda p: p["param"])
    unknown = F.transform(
        F.array_except(F.map_keys(values), names), lambda k: F.concat(F.lit("unknown "), k)
    )
    found = F.array_sort(F.concat(F.filter(wrong, lambda x: x.isNotNull()), unknown))
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))).when(
        values.isNull(), F.array(F.lit("no object"))
    ).otherwise(found)


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call of ``messages`` (conv_id, turn, role, content) linked with its result.

    Columns: conv_id, call_id, turn, tool, level, result_turn (null without a result), times
    (calls with this identifier; the first counts), valid, problems (joined by ";"), line (canonical
    JSON of arguments, id, name and result). ``schemas`` has the columns of ``tool_schemas``, one row
    per tool. Results without a call are left out; of several results the first counts. Rows with
    a null conversation are one conversation; calls with a null identifier are left out. Arguments
    that are no JSON stand in the line as text. Other columns of ``messages`` are not read.
    """
    calls, results = calls_of(messages.select("conv_id", "turn", "role", "content"))
    calls, n = settle_counted(first_of(calls, ["tool", "arguments", "after"]))
    results = first_of(results, ["result"]).select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), "result"
    )
    linked = attach(attach(calls, levels(calls), ["conv_id", "call_id"], n), results, ["conv_id", "call_id"], n)
    checked = linked.join(schemas, "tool", "left").withColumn("_p", problems(F.col("arguments"), F.col("params")))
    parsed = F.to_json(F.try_parse_json("arguments"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(parsed, quoted(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(quoted(F.col("tool")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(quoted(F.col("result")), F.lit("null")), F.lit("}"),
    )
    return checked.select(
        "conv_id", "call_id", "turn", "tool", "level", "result_turn", "times",
        (F.size("_p") == 0).alias("valid"), F.array_join("_p", ";").alias("problems"), line.alias("line"),
    )


def quoted(text: Column) -> Column:
    """A JSON string of a text; null of null."""
    inside = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}; {} of null
    return F.when(text.isNotNull(), F.substring(inside, F.lit(6), F.length(inside) - 6))


def as_tool_chat(conversations: DataFrame) -> DataFrame:
    """Messages with calls and results made of plain conversations (conv_id, turn, role, text).

    Each assistant turn becomes a call: the tool by the number of words, arguments of counts and
    the first word, some of them wrong on purpose, after the call two turns earlier unless the
    number of words is a multiple of 5. Each user turn is the result of the call one turn before.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^ \\t\\n\\r]+"))
    first = F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), "^([A-Za-z]*)", 1)
    call = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("count"), F.lit("rate"), F.lit("other")), (words % 4 + 1).cast("int"))
    limit = F.when(words % 7 == 0, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))
    arguments = F.when(words % 11 == 0, F.lit("none")).otherwise(F.concat(
        F.lit('{"query": "'), first, F.lit('"'), F.when(words % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(', "limit": '), limit)),
        F.when(words % 13 == 0, F.lit(', "deep": true')).otherwise(F.lit("")), F.lit("}"),
    ))
    after = F.when(words % 5 != 0, call(2))
    calls = F.to_json(F.struct(F.array(F.struct(
        call(0).alias("id"), tool.alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(call(1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    content = F.when(F.col("role") == "assistant", calls).when(F.col("role") == "user", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), content.alias("content"))
