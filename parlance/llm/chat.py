"""Operator 7, chat formatting with linked tool calls.

Calls meet their results by a hash join on conversation and identifier; each
result is placed right behind its call, and calls of one turn behind those
that their arguments name; arguments are checked against the tools'
schemas; every message, call and result is written as canonical JSON. A
conversation is never gathered in one row or one task: its rows are
numbered by the global order.

Native: DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, global_prefix, table

MESSAGES = "conv_id, turn, role, text"
CALLS = "conv_id, turn, call_no, call_id, name, arguments"
RESULTS = "conv_id, turn, call_id, content"
SCHEMAS = "name, param, type, required, minimum, maximum"


def quoted(text: Column) -> Column:
    """A string as a JSON string; null as JSON's null."""
    packed = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), "null").otherwise(F.substring(packed, F.lit(6), F.length(packed) - 6))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON: keys in order, no white space; the values are JSON."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


# Whether the JSON text of an argument, p.x, is what its schema, p.t, asks for.
_FITS = """case p.t.type
  when 'integer' then p.x rlike '^-?(0|[1-9][0-9]*)$'
  when 'number' then p.x rlike '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$'
  when 'boolean' then p.x in ('true', 'false')
  when 'string' then startswith(p.x, '"')
  when 'object' then startswith(p.x, '{')
  when 'array' then startswith(p.x, '[')
  else true end"""
_IN_RANGE = """p.t.type not in ('integer', 'number')
  or ((p.t.minimum is null or try_cast(p.x as double) >= p.t.minimum)
      and (p.t.maximum is null or try_cast(p.x as double) <= p.t.maximum))"""


def of_given(test: str) -> str:
    """A test of one given argument ``g`` under its schema, if it has one."""
    return f"""exists(array(struct(try_element_at(_params, g.key) as t, g.value.json as x)),
                      p -> p.t is not null and ({test}))"""


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``_problems`` (sorted) and ``_canonical`` arguments.

    Arguments are a JSON object; what else they hold is "not an object", and
    one that names a key twice, at any depth, has a "duplicate key". The
    values keep their JSON types in the canonical form, whether or not a
    schema knows them: keys in order at every depth, no white space, numbers
    in their shortest form. A null value counts as missing. Of several
    schema rows for one parameter the least counts; rows without a tool or a
    parameter name say nothing."""
    rules = schemas.where("name is not null and param is not null").groupBy("name", "param").agg(
        F.min(F.struct("type", "required", "minimum", "maximum")).alias("_rule"))
    tools = rules.groupBy(F.col("name").alias("_tool")).agg(
        F.map_from_entries(F.collect_list(F.struct("param", "_rule"))).alias("_params"))
    calls = calls.join(tools, F.col("name") == F.col("_tool"), "left") \
        .withColumn("_args", F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')")) \
        .withColumn("_given", F.expr("""coalesce(array_sort(map_entries(transform_values(
            map_filter(_args, (k, v) -> not is_variant_null(v)),
            (k, v) -> struct(cast(v as string) as value, to_json(v) as json)))),
            cast(array() as array<struct<key:string,value:struct<value:string,json:string>>>))""")) \
        .withColumn("_rules", F.expr("coalesce(map_entries(_params), array())")) \
        .withColumn("_twice", F.expr("try_parse_json(arguments) is null and from_json(arguments, 'map<string,string>') is not null"))
    problems = F.expr(f"""array_sort(flatten(array(
      if(_twice, array('duplicate key'), if(_args is null, array('not an object'), array())),
      if(_tool is null, array('unknown tool'), array()),
      transform(filter(_rules, e -> e.value.required and not _twice and not exists(_given, g -> g.key = e.key)),
                e -> concat('missing ', e.key)),
      if(_tool is null, array(), transform(filter(_given, g -> not map_contains_key(_params, g.key)),
                                           g -> concat('unknown ', g.key))),
      transform(filter(_given, g -> {of_given(f"not ({_FITS})")}), g -> concat('type ', g.key)),
      transform(filter(_given, g -> {of_given(f"({_FITS}) and not ({_IN_RANGE})")}),
                g -> concat('range ', g.key)))))""")
    body = F.array_join(F.transform("_given", lambda g: F.concat(quoted(g["key"]), F.lit(":"), g["value"]["json"])), ",")
    return calls.withColumn("_problems", F.filter(problems, lambda p: p.isNotNull())) \
        .withColumn("_canonical", F.when(F.col("_args").isNull(), quoted(F.col("arguments")))
                    .otherwise(F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}")))) \
        .withColumn("_given", F.transform("_given", lambda g: g["value"]["value"])) \
        .drop("_tool", "_params", "_args", "_rules", "_twice")


def leveled(scratch: Scratch, calls: DataFrame) -> DataFrame:
    """``calls`` with ``_level``: 0, or one more than the highest of the
    calls of the same turn that its arguments name as ``$call_id``; -1 for
    calls on or behind a cycle. One join per level, which ends when no call
    gets one any more."""
    key = ["conv_id", "turn", "call_id"]
    named = calls.select(*key, F.explode(F.filter("_given", lambda v: v.startswith("$"))).alias("_ref"))
    named = named.select("conv_id", "turn", "call_id", F.expr("substring(_ref, 2)").alias("_on"))
    known = calls.select("conv_id", "turn", F.col("call_id").alias("_on")).distinct()
    needs = scratch.write(named.join(known, ["conv_id", "turn", "_on"]).distinct(), "needs")
    base = calls.select(*key).where("call_id is not null").distinct()
    done = scratch.write(base.join(needs.select(*key).distinct(), key, "left_anti")
                         .withColumn("_level", F.lit(0)), "level-0")
    step = 0
    while True:
        step += 1
        on = done.select("conv_id", "turn", F.col("call_id").alias("_on"), F.col("_level").alias("_of"))
        ready = needs.join(on, ["conv_id", "turn", "_on"], "left").groupBy(*key).agg(
            (1 + F.max("_of")).alias("_level"), F.count(F.when(F.col("_of").isNull(), 1)).alias("_open"))
        ready = ready.where("_open = 0").select(*key, "_level").join(done.select(*key), key, "left_anti")
        new = scratch.write(ready, f"ready-{step}")
        if new.isEmpty():
            break
        done = scratch.write(done.union(new), f"level-{step}")
    return calls.join(done, key, "left").withColumn("_level", F.coalesce(
        "_level", F.when(F.col("call_id").isNull(), 0).otherwise(-1)))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row (conv_id, seq, kind, call_id, valid, problems, json) per row
    of the three tables. seq counts from 0 inside a conversation, in an
    order in which every result follows its call and every call those that
    it names: by turn; in a turn the message, then the calls by level, number
    and identifier, each with its result behind it.

    A result whose call is missing or comes later keeps its own turn
    ("orphan result"); a call without result is "unanswered"; of several
    calls or results of one identifier the first by turn is linked, the
    others are "duplicate". A null identifier links with nothing. Null texts
    become JSON's null. Rows repeated in full are one call or result, and as
    many messages as they are. Empty tables give no rows, and other columns
    are not read."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = calls.select("conv_id", "turn", "call_no", "call_id", "name", "arguments").distinct()
    results = results.select("conv_id", "turn", "call_id", "content").distinct()

    calls = scratch.write(checked(calls, schemas), "checked")
    calls = scratch.write(leveled(scratch, calls), "leveled")
    key = ["conv_id", "call_id"]
    first_call = calls.where("call_id is not null").groupBy(*key).agg(
        F.min(F.struct("turn", "call_no", "name", "arguments")).alias("_call"), F.max("_level").alias("_level_of"))
    first_result = results.where("call_id is not null").groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("_result"))
    linked = scratch.write(first_call.join(first_result, key, "full"), "linked")

    own = F.struct("turn", "call_no", "name", "arguments")
    calls = calls.join(linked, key, "left").withColumn("_first", own.eqNullSafe(F.col("_call")))
    answered = F.col("_first") & (F.col("_result.turn") >= F.col("turn"))
    call_problems = F.array_sort(F.concat("_problems", F.filter(F.array(
        F.when(~F.coalesce("_first", F.lit(False)) & F.col("call_id").isNotNull(), "duplicate"),
        F.when(F.coalesce("_first", F.lit(False)) & ~F.coalesce(answered, F.lit(False)), "unanswered"),
        F.when(F.col("_level") < 0, "cycle")), lambda p: p.isNotNull())))
    call_rows = calls.select(
        "conv_id", F.col("turn").alias("_turn"), F.lit(1).alias("_step"), F.col("_level"), "call_no",
        F.coalesce("call_id", F.lit("")).alias("_by"), F.lit(0).alias("_after"), F.lit("call").alias("kind"), "call_id",
        call_problems.alias("_problems"),
        json_object({"arguments": F.col("_canonical"), "id": quoted(F.col("call_id")),
                     "name": quoted(F.col("name")), "type": F.lit('"function"')}).alias("json"))

    results = results.join(linked, key, "left")
    first = F.struct("turn", "content").eqNullSafe(F.col("_result"))
    placed = F.coalesce(first & F.col("_call").isNotNull() & (F.col("turn") >= F.col("_call.turn")), F.lit(False))
    result_rows = results.select(
        "conv_id", F.when(placed, F.col("_call.turn")).otherwise(F.col("turn")).alias("_turn"),
        F.when(placed, 1).otherwise(2).alias("_step"), F.when(placed, F.col("_level_of")).otherwise(0).alias("_level"),
        F.when(placed, F.col("_call.call_no")).otherwise(0).alias("call_no"),
        F.coalesce("call_id", F.lit("")).alias("_by"), F.lit(1).alias("_after"), F.lit("result").alias("kind"), "call_id",
        F.filter(F.array(F.when(~placed & F.coalesce(~first & F.col("_call").isNotNull(), F.lit(False)), "duplicate")
                         .when(~placed, "orphan result")), lambda p: p.isNotNull()).alias("_problems"),
        json_object({"content": quoted(F.col("content")), "role": F.lit('"tool"'),
                     "tool_call_id": quoted(F.col("call_id"))}).alias("json"))
    message_rows = messages.select(
        "conv_id", F.col("turn").alias("_turn"), F.lit(0).alias("_step"), F.lit(0).alias("_level"),
        F.lit(0).alias("call_no"), F.lit("").alias("_by"), F.lit(0).alias("_after"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), F.array().cast("array<string>").alias("_problems"),
        json_object({"content": quoted(F.col("text")), "role": quoted(F.col("role"))}).alias("json"))
    rows = message_rows.unionByName(call_rows).unionByName(result_rows).withColumn("_one", F.lit(1).cast("long"))

    order = [F.col(c).asc_nulls_first() for c in
             ("conv_id", "_turn", "_step", "_level", "call_no", "_by", "_after", "json")]
    numbered = scratch.write(global_prefix(scratch, rows, order, {"_row": "_one"}), "numbered")
    starts = scratch.write(numbered.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_row").alias("_start")), "starts")
    return numbered.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", (F.col("_row") - F.col("_start")).alias("seq"), "kind", "call_id",
        (F.size("_problems") == 0).alias("valid"), F.array_join("_problems", "; ").alias("problems"), "json")


# -- the query's tool traffic ---------------------------------------------------

TOOL_ROWS = [
    ("search", "query", "string", True, None, None), ("search", "limit", "integer", True, 1.0, 100.0),
    ("search", "exact", "boolean", False, None, None),
    ("lookup", "query", "string", True, None, None), ("lookup", "limit", "integer", False, 0.0, 50.0),
    ("summarise", "text", "string", True, None, None),
]


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results out of plain conversations, which hold no
    tool traffic of their own: every assistant turn calls a tool with its
    text, some ask for a summary of that call's result as well (and name the
    second call first), and every later user turn answers the turn before
    it, whether or not that made a call."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    call_id = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    asking = conversations.where("role = 'assistant'")
    first = asking.select(
        "conv_id", "turn", F.lit(1).alias("call_no"), F.concat(call_id, F.lit("-a")).alias("call_id"),
        F.when(n % 7 == 0, "browse").when(n % 2 == 0, "search").otherwise("lookup").alias("name"),
        F.to_json(F.struct(F.when(n % 5 != 0, F.col("text")).alias("query"), (n % 120).alias("limit"),
                           F.when(n % 3 == 0, n % 2 == 0).alias("exact"))).alias("arguments"))
    second = asking.where(n % 3 == 0).select(
        "conv_id", "turn", F.lit(0).alias("call_no"), F.concat(call_id, F.lit("-b")).alias("call_id"),
        F.lit("summarise").alias("name"),
        F.to_json(F.struct(F.concat(F.lit("$"), call_id, F.lit("-a")).alias("text"))).alias("arguments"))
    before = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    answer = conversations.where("role = 'user' and turn > 0")
    results = answer.select("conv_id", "turn", F.concat(before, F.lit("-a")).alias("call_id"),
                            F.col("text").alias("content")) \
        .union(answer.where(n % 2 == 0).select("conv_id", "turn", F.concat(before, F.lit("-b")), "text"))
    return conversations, first.union(second), results


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(
        TOOL_ROWS, "name string, param string, type string, required boolean, minimum double, maximum double")
    return format_chats(*derived(table(spark, sf_dir, "conversations")), schemas)
