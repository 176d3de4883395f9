import json

from kinset.llm.queries import TOOLS
from kinset.llm.toolcalls import link_tool_calls, tool_schemas

SCHEMA = "conv_id long, turn long, role string, content string, level int"


def call(i, name, arguments, after=None):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments, "after": after}]})


def result(i, text):
    return json.dumps({"tool_call_id": i, "content": text})


def linked(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return {(r.conv_id, r.call_id): r for r in link_tool_calls(df, tool_schemas(spark, TOOLS)).collect()}


def test_links_order_and_lines(spark):
    ok = '{"query": "é\\"x", "limit": 3}'
    got = linked(spark, [
        (1, 5, "assistant", call("c", "search", ok, "b")), (1, 3, "assistant", call("b", "search", ok, "a")),
        (1, 1, "assistant", call("a", "search", ok)), (1, 1, "assistant", call("a", "search", ok)),
        (1, 2, "tool", result("a", 'say "hi"\n')), (1, 4, "tool", result("a", "later")), (1, 9, "tool", result("zz", "no call")),
        (2, 1, "assistant", call("a", "rate", '{"query": 1, "more": {"b": 1, "a": [true, null]}}', "gone")),
        (2, 3, "assistant", call("p", "count", "none", "q")), (2, 4, "assistant", call("q", "nothing", "{}", "p")),
        (3, 1, "assistant", "plain text"), (3, 2, "assistant", None), (3, 3, "user", "hello"), (3, 4, None, "x"),
        (3, 5, "assistant", call(None, "search", ok)), (None, 1, "assistant", call("n", "search", '{"limit": true}')),
        (None, 2, "tool", result("n", None)),
    ])
    assert {k: got[1, k].level for k in "abc"} == {"a": 0, "b": 1, "c": 2}
    a = got[1, "a"]
    assert (a.turn, a.result_turn, a.times, a.valid, a.problems) == (1, 2, 2, True, "")
    assert a.line == '{"arguments":{"limit":3,"query":"é\\"x"},"id":"a","name":"search","result":"say \\"hi\\"\\n"}'
    assert got[1, "b"].result_turn is None and json.loads(got[1, "b"].line)["result"] is None
    # A missing call ends a chain, a cycle has no level.
    assert got[2, "a"].level == 0 and got[2, "p"].level is None and got[2, "q"].level is None
    assert got[2, "a"].problems == "type of query;unknown more"
    assert '"more":{"a":[true,null],"b":1}' in got[2, "a"].line
    assert got[2, "p"].problems == "no object" and got[2, "q"].problems == "unknown tool"
    assert got[None, "n"].problems == "missing query;type of limit" and got[None, "n"].result_turn == 2
    assert {k for k in got if k[0] == 3} == set()


def test_long_chain_and_empty(spark):
    rows = [(1, i, "assistant", call(str(i), "search", "{}", str(i - 1))) for i in range(300)]
    got = linked(spark, rows)
    assert all(got[1, str(i)].level == i for i in range(300))
    df = spark.createDataFrame([], SCHEMA)
    assert link_tool_calls(df, tool_schemas(spark, TOOLS)).collect() == []
