"""Tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import col

#: Schema of a tool's arguments: a subset of JSON Schema. ``type`` (string, number, integer, boolean, array,
#: object), ``enum``, ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, ``items``,
#: ``properties``, ``required`` and ``additionalProperties``.
Schema = dict[str, object]
LIMITS = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems"),
          "number": ("minimum", "maximum"), "integer": ("minimum", "maximum")}


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): steps from a call that follows none; null on or behind a cycle.

    ``calls`` has call_id and after. Each round every call jumps to where the call it points
    to has got, so a chain of n calls takes log2(n) rounds; each is checkpointed.
    A call named by many is joined, never gathered. A name that no call bears ends a
    chain. If rows of one id follow different calls, the smallest name counts.
    """
    ids = calls.where("call_id is not null").groupBy("call_id").agg(F.min("after").alias("after"))
    known = ids.select(F.col("call_id").alias("up"), F.lit(1).alias("step"))
    at = ids.where("after is not null").select("call_id", F.col("after").alias("up")).join(known, "up", "left").select(
        "call_id", F.when(F.col("step") == 1, F.col("up")).alias("up"),
        F.coalesce("step", F.lit(0)).cast("long").alias("level"))
    at = at.unionByName(ids.where("after is null").select(
        "call_id", F.col("after").alias("up"), F.lit(0).cast("long").alias("level")))
    at = cut(at)
    rounds = ceil(log2(max(2, at.count()))) + 1
    for _ in range(rounds):
        if at.where("up is not null").isEmpty():
            break
        ahead = at.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        # calls that have arrived stay out of the join, where they would all share the null key
        moved = at.where("up is not null").join(ahead, "up").select(
            "call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        at = cut(at.where("up is null").unionByName(moved))
    return at.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def path(field: str) -> str:
    return '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def of_type(value: Column, kind: str) -> Column:
    """Whether a variant (not null) is of a type; a number without a fraction is an integer, however written."""
    name = F.schema_of_variant(value)
    numeric = name.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return numeric & (number == F.floor(number))
    return {"number": numeric, "string": name == "STRING", "boolean": name == "BOOLEAN",
            "array": name.startswith("ARRAY"), "object": name.startswith("OBJECT")}[kind]


def broken(value: Column, schema: Schema, name: str, required: bool) -> Column:
    """What a value breaks, as an array: one problem of its own, then those of its fields in the schema's order,
    then fields that the schema does not know, by name."""
    kind = schema.get("type")
    absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
    own = F.when(absent, F.lit(f"{name}: missing" if required else None))
    if kind:
        own = own.when(~of_type(value, kind), F.lit(f"{name}: not {kind}"))
    if "enum" in schema:
        texts = [str(x) for x in schema["enum"]]
        known = F.try_variant_get(value, "$", "string").isin(*texts)
        own = own.when(~F.coalesce(known, F.lit(False)), F.lit(f"{name}: not one of {', '.join(texts)}"))
    if kind in LIMITS:
        size = F.char_length(F.try_variant_get(value, "$", "string")) if kind == "string" else F.size(
            F.try_variant_get(value, "$", "array<variant>")) if kind == "array" else F.try_variant_get(value, "$", "double")
        least, most = (schema.get(x) for x in LIMITS[kind])
        if least is not None:
            own = own.when(size < least, F.lit(f"{name}: under {least}"))
        if most is not None:
            own = own.when(size > most, F.lit(f"{name}: over {most}"))
    if "items" in schema:
        each = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"),
                                     lambda x: broken(x, schema["items"], f"{name}[]", True)))
        own = own.when(F.size(each) > 0, F.get(each, F.lit(0)))
    found = [F.array(own)]
    inside = of_type(value, "object")
    prefix = f"{name}." if name else ""
    fields = schema.get("properties", {})
    for field, inner in fields.items():
        child = broken(F.try_variant_get(value, path(field), "variant"), inner, prefix + field, field in schema.get("required", ()))
        found.append(F.when(inside, child))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        more = F.sort_array(F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>")))
        found.append(F.when(inside, F.transform(more, lambda k: F.concat(F.lit(prefix), k, F.lit(": unexpected")))))
    none = F.array().cast("array<string>")
    return F.array_compact(F.concat(*[F.coalesce(x, none) for x in found]))


def problems(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What a call's parsed arguments (a variant, null if malformed) break, joined by ``;``."""
    found = F.when(arguments.isNull(), F.array(F.lit("malformed"))).when(
        ~of_type(arguments, "object"), F.array(F.lit("not an object")))
    for tool, schema in schemas.items():
        found = found.when(name == tool, broken(arguments, schema, "", True))
    return F.array_join(found.otherwise(F.array(F.lit("unknown tool"))), ";")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per call, and one per identifier of results that no call bears.

    ``calls``: call_id, after (the call it follows, or null), name, arguments (JSON
    text). ``results``: call_id, place (their order), content. Other columns are ignored.

    Calls and results meet by a hash join on the identifier; of several results the
    first by place, then content, is the call's (a partial aggregate, so thousands of
    results of one call are a row per task) and ``n_results`` counts all. ``level``
    orders calls topologically: each stands above the call it follows. ``problems`` lists
    what the arguments break in the tool's schema (see ``Schema``); arguments with a doubled key are malformed. ``json`` has sorted keys and no blanks, numbers
    as JSON writes them.

    ``status``: ``cycle``, ``invalid``, ``unanswered``, ``ok`` (the first that holds), or
    ``orphan`` for results without a call. Calls without an id link to nothing and have
    level 0; results without an id are one orphan. Null, empty and malformed arguments
    are ``malformed`` and null in the JSON. Repeated calls are a row each and share their
    result. Long arguments are parsed whole. Empty tables give an empty one.
    """
    calls = calls.select("call_id", "after", "name", "arguments")
    answers = results.groupBy("call_id").agg(
        F.count("*").alias("n_results"), F.min(F.struct("place", "content")).alias("first"))
    level = levels(calls)
    linked = calls.join(answers, "call_id", "left").join(level, "call_id", "left").select(
        "call_id", "name", F.try_parse_json("arguments").alias("args"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("first.content").alias("content"),
        F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"))
    linked = linked.withColumn("problems", problems(F.col("name"), F.col("args"), schemas))
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("problems") != "", "invalid") \
        .when(F.col("n_results") == 0, "unanswered").otherwise("ok")
    linked = linked.withColumn("status", status)
    lone = answers.join(calls.select("call_id").dropna(), "call_id", "left_anti").select(
        "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("args"), "n_results",
        F.col("first.content").alias("content"), F.lit(None).cast("long").alias("level"),
        F.lit("").alias("problems"), F.lit("orphan").alias("status"))
    text = F.to_json(F.struct(
        F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("name"),
        F.col("content").alias("result"), F.col("status")), {"ignoreNullFields": "false"})
    columns = ["call_id", "name", "level", "n_results", "problems", "status"]
    return linked.unionByName(lone).select(*columns, text.alias("json"))


#: Schema of the calls that the query derives.
SCHEMAS: dict[str, Schema] = {"reply": {
    "type": "object", "additionalProperties": False, "required": ["meta", "mood", "tags", "text", "turn", "words"],
    "properties": {
        "meta": {"type": "object", "required": ["first"], "properties": {"first": {"type": "boolean"}}},
        "mood": {"type": "string", "enum": ["calm", "glad"]},
        "share": {"type": "number", "minimum": 0, "maximum": 1},
        "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2},
        "text": {"type": "string", "minLength": 20, "maxLength": 200},
        "turn": {"type": "integer", "minimum": 0},
        "words": {"type": "integer", "minimum": 5}}}}
WORD = "[^\\x20\\x09-\\x0D]+"
#: Conversations are dealt by id; each of these gets one field that the schema refuses, in the order of the fields.
CASES = 16
MALFORMED, LISTED, UNKNOWN, NESTED, NO_FIRST, MOOD, SHARE, SHARE_TEXT, TAG, TAGS, TURN, NO_WORDS, NOTE = range(1, 14)


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat turns: a user's turn calls ``reply``, an assistant's answers the turn before.

    A user's turn follows the user's turn two before it. Turns of any other or a null role are
    neither and are left out. By the conversation's id some calls are given what the schema refuses.
    """
    def name(back: int) -> Column:
        return F.concat(F.lit("c"), col("conv_id").cast("string"), F.lit("."), (col("turn") - back).cast("string"))

    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    case = F.col("conv_id") % CASES

    def field(given: str | Column, **other: tuple[int, str | None]) -> Column:
        value = F.lit(given) if isinstance(given, str) else given
        for at, text in other.values():
            value = F.when(case == at, F.lit(text)).otherwise(value)
        return value

    quoted = F.to_json(F.array("text"))
    parts = [
        field('"meta":{"first":true}', a=(NESTED, '"meta":1'), b=(NO_FIRST, '"meta":{"last":true}')),
        field('"mood":"calm"', a=(MOOD, '"mood":"odd"')),
        F.when(case == NOTE, '"note":null'),
        field('"share":0.5', a=(SHARE, '"share":1.5'), b=(SHARE_TEXT, '"share":"half"')),
        field('"tags":["a"]', a=(TAG, '"tags":["a",1]'), b=(TAGS, '"tags":["a","b","c"]')),
        F.concat(F.lit('"text":'), F.coalesce(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2), F.lit("null"))),
        F.concat(F.lit('"turn":'), F.when(case == TURN, F.concat(F.lit('"'), "turn", F.lit('"'))).otherwise(F.col("turn").cast("string"))),
        F.when(case != NO_WORDS, F.concat(F.lit('"words":'), words)),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    arguments = F.when(case == MALFORMED, F.lit("{")).when(case == LISTED, F.lit("[1]")).otherwise(whole)
    calls = turns.where("role = 'user'").select(
        name(0).alias("call_id"), F.when(F.col("turn") >= 2, name(2)).alias("after"),
        F.when(case == UNKNOWN, "answer").otherwise("reply").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        name(1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    return calls, results


SQL = r"""
WITH RECURSIVE calls AS (
  SELECT 'c' || conv_id || '.' || turn AS call_id, CASE WHEN turn >= 2 THEN 'c' || conv_id || '.' || (turn - 2) END AS after,
         text, turn, conv_id % 16 AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM conversations WHERE role = 'user'),
answers AS (
  SELECT call_id, count(*) AS n_results, arg_min(content, struct_pack(place, content)) AS content
  FROM (SELECT 'c' || conv_id || '.' || (turn - 1) AS call_id, turn AS place, text AS content
        FROM conversations WHERE role = 'assistant') GROUP BY call_id),
ids AS (SELECT call_id, min(after) AS after FROM calls GROUP BY call_id),
depth AS (
  SELECT call_id, 0::BIGINT AS level FROM ids WHERE after IS NULL OR after NOT IN (SELECT call_id FROM ids)
  UNION ALL SELECT ids.call_id, level + 1 FROM ids JOIN depth ON ids.after = depth.call_id),
linked AS (
  SELECT call_id, level, coalesce(n_results, 0) AS n_results, content, k,
         CASE WHEN k = 3 THEN 'answer' ELSE 'reply' END AS name,
         CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'not an object' WHEN 3 THEN 'unknown tool' ELSE concat_ws(';',
           CASE k WHEN 4 THEN 'meta: not object' WHEN 5 THEN 'meta.first: missing' END,
           CASE k WHEN 6 THEN 'mood: not one of calm, glad' END,
           CASE k WHEN 7 THEN 'share: over 1' WHEN 8 THEN 'share: not number' END,
           CASE k WHEN 9 THEN 'tags[]: not string' WHEN 10 THEN 'tags: over 2' END,
           CASE WHEN text IS NULL THEN 'text: missing' WHEN length(text) < 20 THEN 'text: under 20'
                WHEN length(text) > 200 THEN 'text: over 200' END,
           CASE k WHEN 11 THEN 'turn: not integer' END,
           CASE WHEN k = 12 THEN 'words: missing' WHEN words < 5 THEN 'words: under 5' END,
           CASE k WHEN 13 THEN 'note: unexpected' END) END AS problems,
         CASE k WHEN 1 THEN 'null' WHEN 2 THEN '[1]' ELSE '{' || concat_ws(',',
           CASE k WHEN 4 THEN '"meta":1' WHEN 5 THEN '"meta":{"last":true}' ELSE '"meta":{"first":true}' END,
           CASE k WHEN 6 THEN '"mood":"odd"' ELSE '"mood":"calm"' END, CASE k WHEN 13 THEN '"note":null' END,
           CASE k WHEN 7 THEN '"share":1.5' WHEN 8 THEN '"share":"half"' ELSE '"share":0.5' END,
           CASE k WHEN 9 THEN '"tags":["a",1]' WHEN 10 THEN '"tags":["a","b","c"]' ELSE '"tags":["a"]' END,
           '"text":' || coalesce(to_json(text)::VARCHAR, 'null'),
           '"turn":' || CASE k WHEN 11 THEN '"' || turn || '"' ELSE turn::VARCHAR END,
           CASE WHEN k <> 12 THEN '"words":' || words END) || '}' END AS args
  FROM calls LEFT JOIN answers USING (call_id) LEFT JOIN depth USING (call_id)),
rated AS (
  SELECT *, CASE WHEN level IS NULL THEN 'cycle' WHEN problems <> '' THEN 'invalid'
                 WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status FROM linked)
SELECT call_id, name, level, n_results, problems, status,
       '{"arguments":' || args || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":"' || name
         || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
FROM rated
UNION ALL
SELECT call_id, NULL, NULL, n_results, '', 'orphan',
       json_object('arguments', NULL, 'id', call_id, 'level', NULL, 'name', NULL, 'result', content, 'status', 'orphan')::VARCHAR
FROM answers WHERE call_id NOT IN (SELECT call_id FROM calls)
"""
