import json
import re
from collections import Counter

import duckdb

from billsift.llm import toolcalls
from billsift.llm.queries import op4_toolcalls, oracle_sql


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = op4_toolcalls(spark, folder)
    found = con.execute(oracle_sql()["op4_toolcalls"])
    assert got.columns == [d[0] for d in found.description]
    want = Counter(found.fetchall())
    assert Counter(map(tuple, got.collect())) == want
    assert len({r[5] for r in want}) >= 2
    said = {p for r in want for p in r[4].split(";")}
    assert said >= {"malformed", "not an object", "unknown tool", "meta: not object", "meta.first: missing", "share: over 1",
                    "mood: not one of calm, glad", "share: not number", "tags[]: not string", "tags: over 2", "text: over 200",
                    "turn: not integer", "words: missing", "note: unexpected"}


def test_null_and_short_texts_agree_with_sql(spark, tmp_path):
    rows = [(i, t, role, text) for i in range(16) for t, role, text in (
        (0, "user", None), (1, "assistant", None), (2, "user", "short"), (3, "assistant", "x"), (4, "user", "w " * 300),
        (6, "user", 'quotes " and \\ and \n é 😀 in five words'), (7, "system", "s"), (8, None, "n"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = Counter(map(tuple, op4_toolcalls(spark, str(tmp_path)).collect()))
    want = Counter(con.execute(oracle_sql()["op4_toolcalls"]).fetchall())
    assert got == want and any("text: missing" in r[4] for r in want)


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {
    "a": {"type": "integer"}, "b": {"type": "integer", "minimum": 3}}}}


def run(spark, calls, results):
    calls = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string, status string")
    results = spark.createDataFrame(results, "call_id string, place long, content string, level string")
    return toolcalls.link(calls, results, SCHEMAS)


def call(i, after=None, arguments='{"a": 1}', name="add"):
    return (i, after, name, arguments, "x")


def test_order_validation_and_edges(spark):
    calls = [call("c3", "c2"), call("c1"), call("c2", "c1"), call("x", "y"), call("y", "x"), call("z", "y"),
             call("lost", "nowhere"), call(None), call("bad", None, "{"), call("none", None, None), call("list", None, "[1]"),
             call("type", None, '{"a": "1", "b": 2}'), call("miss", None, '{"b": null}'), call("tool", None, "{}", "what"),
             call("twice"), call("twice")]
    results = [("c1", 2, "late", ""), ("c1", 1, "early", ""), ("c2", 1, None, ""), ("gone", 1, "r", ""), (None, 1, "n", "")]
    results += [("twice", 1, "same", "")] * 3
    rows = {}
    for r in run(spark, calls, results).collect():
        rows.setdefault(r.call_id, []).append(r)
    assert {i: r[0].level for i, r in rows.items() if i in ("c1", "c2", "c3", "x", "y", "z", "lost")} == {
        "c1": 0, "c2": 1, "c3": 2, "x": None, "y": None, "z": None, "lost": 0}
    status = {i: r[0].status for i, r in rows.items() if i}
    assert status == {"c1": "ok", "c2": "ok", "c3": "unanswered", "x": "cycle", "y": "cycle", "z": "cycle",
                      "lost": "unanswered", "bad": "invalid", "none": "invalid", "list": "invalid", "type": "invalid",
                      "miss": "invalid", "tool": "invalid", "twice": "ok", "gone": "orphan"}
    assert sorted(r.status for r in rows[None]) == ["orphan", "unanswered"]
    assert {i: rows[i][0].problems for i in ("bad", "none", "list", "type", "miss", "tool")} == {
        "bad": "malformed", "none": "malformed", "list": "not an object", "type": "a: not integer;b: under 3",
        "miss": "a: missing", "tool": "unknown tool"}
    assert len(rows["twice"]) == 2 and rows["twice"][0].n_results == 3
    assert json.loads(rows["c1"][0].json)["result"] == "early" and rows["c1"][0].n_results == 2
    assert run(spark, [], []).count() == 0


def test_canonical_json(spark):
    rows = run(spark, [call("q", None, ' {"b" : 1.50, "a": 2, "é\\u0041": "x\\ny", "n": {"z": [1, true], "k": null}} ')], [])
    assert rows.first().json == (
        '{"arguments":{"a":2,"b":1.5,"n":{"k":null,"z":[1,true]},"éA":"x\\ny"},"id":"q","level":0,"name":"add",'
        '"result":null,"status":"invalid"}')


def test_long_chain(spark):
    rows = run(spark, [call(f"{i:04}", f"{i - 1:04}" if i else None) for i in range(700)], []).collect()
    assert all(r.level == int(r.call_id) for r in rows)


def test_no_python_in_the_plan(spark, small):
    plan = op4_toolcalls(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def found(spark, schema, *arguments):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arguments)], "i int, a string")
    rows = df.select("i", toolcalls.problems(F.lit("t"), F.try_parse_json("a"), {"t": schema}).alias("p")).collect()
    return [r.p for r in sorted(rows)]


def test_types(spark):
    def one(kind, **more):
        return {"type": "object", "properties": {"x": {"type": kind, **more}}}

    values = ["1", "1.5", "1.0", "1e3", "-2", '"1"', "true", "[]", "[1]", "{}", "null"]
    texts = [f'{{"x": {v}}}' for v in values] + ["{}"]

    def good(kind):
        return [v for v, p in zip([*values, "absent"], found(spark, one(kind), *texts)) if p == ""]

    assert good("number") == ["1", "1.5", "1.0", "1e3", "-2", "null", "absent"]
    assert good("integer") == ["1", "1.0", "1e3", "-2", "null", "absent"]
    assert good("string") == ['"1"', "null", "absent"] and good("boolean") == ["true", "null", "absent"]
    assert good("array") == ["[]", "[1]", "null", "absent"] and good("object") == ["{}", "null", "absent"]


def test_limits_lists_and_enumerations(spark):
    schema = {"type": "object", "required": ["n"], "properties": {
        "n": {"type": "number", "minimum": 0, "maximum": 1.25},
        "l": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "number", "maximum": 9}},
        "e": {"enum": ["a", 2]}, "s": {"type": "string", "minLength": 2, "maxLength": 3}}}
    assert found(spark, schema, '{"n": 1.25}', '{"n": 1.26}', '{"n": -0.1}', '{"n": null}', '{"n": 1, "l": []}',
                 '{"n": 1, "l": [1, 2.5]}', '{"n": 1, "l": [1, "2", null]}', '{"n": 1, "l": [1, 10]}', '{"n": 1, "l": [1,2,3,4]}',
                 '{"n": 1, "e": 2}', '{"n": 1, "e": "b"}', '{"n": 1, "s": "é"}', '{"n": 1, "s": "abcd"}', '{"n": 1, "n": 2}') == [
        "", "n: over 1.25", "n: under 0", "n: missing", "l: under 1", "", "l[]: not number", "l[]: over 9", "l: over 3", "",
        "e: not one of a, 2", "s: under 2", "s: over 3", "malformed"]


def test_nested_objects_and_unknown_fields(spark):
    schema = {"type": "object", "additionalProperties": False, "required": ["o"], "properties": {
        "o": {"type": "object", "required": ["p"], "additionalProperties": False, "properties": {
            "p": {"type": "object", "required": ["q"], "properties": {"q": {"type": "boolean"}}}}}}}
    assert found(spark, schema, '{"o": {"p": {"q": true}}}', '{"o": {"p": {"q": 1, "r": 2}}}', '{"o": {"p": 5}}', '{"o": {}}',
                 '{"o": {"p": {"q": false}, "z": 1, "a.b": 2}, "y": null}', '{}', '[]', 'x') == [
        "", "o.p.q: not boolean", "o.p: not object", "o.p: missing", "o.a.b: unexpected;o.z: unexpected;y: unexpected",
        "o: missing", "not an object", "malformed"]


def test_long_arguments(spark):
    long = '{"a": 1, "t": "' + "word " * 200_000 + '"}'
    row = run(spark, [call("x", None, long)], [("x", 1, "r" * 100_000, "")]).first()
    assert row.status == "ok" and len(row.json) > 1_100_000
