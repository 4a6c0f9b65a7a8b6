"""History, state, plans, prompts and completions."""

import json

import pytest
from pyspark.sql import functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions import text as tx
from stratadoc.operators import completion, conversation as conv, planning, prompts
from stratadoc.operators.numbering import dense_index


def history(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, created int, id long, role string, content string")


def test_window_and_current_message(spark):
    rows = [("a", i, i, "user", f"m{i}") for i in range(9)] + [("b", 1, 20, "user", "second"), ("b", 1, 10, "user", "first")]
    requests = spark.createDataFrame([("a", "now"), ("b", "hi"), ("c", "alone"), ("d", "")], "session_id string, message string")
    out = conv.chat_messages(conv.valid_requests(requests), history(spark, *rows), ["created", "id"])
    got = {r["session_id"]: [m["content"] for m in r["messages"]] for r in out.collect()}
    assert got == {"a": ["m3", "m4", "m5", "m6", "m7", "m8", "now"], "b": ["first", "second", "hi"], "c": ["alone"]}
    assert conv.last_turns(history(spark, *rows), "session_id", ["created", "id"], 2).groupBy("session_id").count().agg(F.max("count")).first()[0] == 2


def test_missing_session_gets_one(spark):
    df = spark.createDataFrame([(None, "x")], "session_id string, message string")
    assert len(conv.valid_requests(df).first()["session_id"]) == 36


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_dense_index_with_a_hot_leading_key(spark, ranges):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50:02d}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    got = [(r["n"], r["k"], r["i"]) for r in dense_index(df, ["k", "i"], "n", first=10, ranges=ranges).orderBy("n").collect()]
    assert got == [(10 + n, k, i) for n, (k, i) in enumerate(sorted(rows))]
    assert dense_index(df, ["k", "i"], "n").agg(F.max("n")).first()[0] == 900


def test_append_goes_on_after_the_largest_id(spark):
    old = spark.createDataFrame([(7, "a", "x")], "id long, session_id string, content string")
    new = spark.createDataFrame([("b", "y", 2), ("b", "z", 1)], "session_id string, content string, at int")
    got = [tuple(r) for r in conv.append_history(old, new, ["session_id", "at"]).orderBy("id").collect()]
    assert got == [(7, "a", "x"), (8, "b", "z"), (9, "b", "y")]


def test_new_turns_get_defaults(spark):
    row = conv.stamped_turns(spark.createDataFrame([("s",)], "session_id string")).first()
    assert row["metadata_"] == {} and row["created_at"] is not None


def test_feedback_scores(spark):
    df = spark.createDataFrame([("s", "u", 1, s, None) for s in (1, -1, 0, 2)], "session_id string, user_id string, message_id long, score int, comment string")
    assert sorted(r["score"] for r in conv.valid_feedback(df).collect()) == [-1, 1]


def test_state_reduction(spark):
    m = "array<struct<role:string,content:string>>"
    steps = spark.createDataFrame(
        [("q", 2, [("assistant", "b")], None, "two"), ("q", 1, [("user", "a")], ["d"], "one"), ("q", 3, None, None, None)],
        f"question_id string, seq int, messages {m}, documents array<string>, current_query string",
    )
    row = conv.reduce_states(steps).first()
    assert [x["content"] for x in row["messages"]] == ["a", "b"]
    assert (row["documents"], row["current_query"]) == (["d"], "two")


FALLBACK = ("Q", [fv.PLAN_FAILED], "", "")


PLANS = [
        ({"action": "retrieve", "refined_query": "r", "reasoning": "why"}, ("r", ["why"], "", "")),
        ({"action": "retrieve"}, ("Q", [fv.PLAN_DONE], "", "")),
        ({"action": "tool_use", "tool_choice": " t ", "tool_input": " i\n", "refined_query": "r"}, ("r", [fv.PLAN_DONE], "t", "i")),
        ({"action": "tool_use", "tool_choice": "t", "tool_input": " ", "refined_query": "r"}, ("r", [fv.PLAN_DONE], "t", "r")),
        ({"action": "tool_use", "tool_choice": "t"}, ("Q", [fv.PLAN_DONE], "t", "Q")),
        ({"action": "tool_use", "tool_choice": None, "tool_input": 0}, ("Q", [fv.PLAN_DONE], "", "Q")),
        ({"action": "direct_answer", "tool_choice": "t", "tool_input": "i"}, ("Q", [fv.PLAN_DONE], "", "")),
        ({"action": None, "refined_query": None, "reasoning": None}, (None, [None], "", "")),
        ({"refined_query": "r", "tool_choice": "t"}, FALLBACK),
        ({"action": "tool_use", "tool_choice": 5}, FALLBACK),
        ({"action": "retrieve", "tool_input": ["x"]}, FALLBACK),
        ('{"action":"retrieve"} trailing', FALLBACK),
        ('{"action":"retrieve"}, {"action":"retrieve"}', FALLBACK),
        ("{'action':'retrieve'}", FALLBACK),
        ('["action"]', FALLBACK),
        ("", FALLBACK),
        (None, FALLBACK),
    ]


def test_plan_normalisation(spark):
    texts = [json.dumps(p) if isinstance(p, dict) else p for p, _ in PLANS]
    df = spark.createDataFrame([(i, "Q", t) for i, t in enumerate(texts)], "i int, question string, plan string")
    rows = planning.normalise_plans(df).orderBy("i").collect()
    for row, (plan, expected) in zip(rows, PLANS):
        assert (row["current_query"], row["plan_steps"], row["tool_choice"], row["tool_input"]) == expected, plan


def test_route(spark):
    df = spark.createDataFrame([("t", "tool_use"), (" ", "direct_answer"), (None, "retrieve")], "tool_choice string, action string")
    assert [r[0] for r in df.select(planning.route()).collect()] == ["tool", "retriever", "retriever"]
    assert [r[0] for r in df.select(planning.route(action="action")).collect()] == ["tool", "responder", "retriever"]


def test_dispatch_and_tools(spark):
    rows = [
        (1, ["p"], "vector_search", "in", "q"), (2, ["p"], None, "", "q2"), (3, [], "vector_search", "", "q"),
        (4, ["p"], "other", "", "q"), (5, None, "x", "", "q"),
    ]
    df = spark.createDataFrame(rows, "question_id long, plan_steps array<string>, tool_choice string, tool_input string, current_query string")
    sent = planning.dispatch(df)
    got = {r["question_id"]: (r["branch"], r["tool_name"], r["tool_text"]) for r in sent.collect()}
    assert got == {
        1: ("vector_search", "vector_search", "in"), 2: ("calculator", "calculator", "q2"), 3: ("none", "vector_search", "q"),
        4: ("unknown", "other", "q"), 5: ("none", "x", "q"),
    }
    tools = {"vector_search": lambda d: d.withColumn("result", F.upper("tool_text"))}
    messages = {r["question_id"]: (r["role"], r["content"]) for r in planning.run_tools(sent, tools).collect()}
    assert messages == {
        1: ("user", "Tool Output: IN"), 2: ("user", "Tool Output: Unknown tool requested."), 3: ("system", "No tool selected."),
        4: ("user", "Tool Output: Unknown tool requested."), 5: ("system", "No tool selected."),
    }


def test_answer_source(spark):
    m = "array<struct<role:string,content:string>>"
    rows = [
        (1, [("user", "Tool Output: old"), ("user", "Tool Output: Tool Output: new \n"), ("assistant", "x")], "t", ["d1", "d2"]),
        (2, [("user", "Tool Output: old")], "", ["d1", "d2"]),
        (3, [("user", " Tool Output: no")], "t", None),
        (4, [("user", "Tool Output: \n")], "t", ["d"]),
    ]
    df = spark.createDataFrame(rows, f"id int, messages {m}, tool_choice string, documents array<string>")
    got = {r["id"]: (r["source_label"], r["source_content"]) for r in planning.answer_source(df).collect()}
    assert got == {
        1: ("tool output", "Tool Output: new"), 2: ("retrieved context", "d1\n\nd2"), 3: ("retrieved context", ""),
        4: ("retrieved context", "d"),
    }


def test_prompts_fill_their_places_only(spark):
    df = spark.createDataFrame([("a {question} {label}", "lab", "q?", [("user", "hi"), ("assistant", "yo")])],
                               "content string, label string, question string, history array<struct<role:string,content:string>>")
    row = df.select(
        prompts.answer_prompt("label", "content", "question").alias("answer"),
        prompts.rewrite_prompt("history", "question").alias("rewrite"),
        prompts.hyde_prompt("question").alias("hyde"),
        prompts.entity_prompt("question").alias("entity"),
        prompts.graph_prompt("content").alias("graph"),
        prompts.plan_messages("question").alias("plan"),
    ).first()
    assert row["answer"] == fv.ANSWER_PROMPT.format(label="lab", content="a {question} {label}", question="q?")
    assert row["rewrite"] == fv.REWRITE_PROMPT.format(history="user: hi\nassistant: yo", question="q?")
    assert row["hyde"] == fv.HYDE_PROMPT.format(question="q?")
    assert "Question: q?" in row["entity"] and '"entities": ["list", "of", "names"]' in row["entity"]
    assert "('Person', 'Organization'" in row["graph"] and '{"id": "Name", "type": "Label"}' in row["graph"]
    assert [m["role"] for m in row["plan"]] == ["system", "user"] and row["plan"][1]["content"] == "q?"


def test_completion_policies(spark):
    df = spark.createDataFrame([("ok",), ("flaky",), ("json",), ("empty",), ("dead",)], "prompt string").coalesce(1)

    def make():
        seen = {}

        def client(messages, temperature, json_mode):
            text = messages[-1]["content"]
            seen[text] = seen.get(text, 0) + 1
            if text == "dead" or (text == "flaky" and seen[text] < 3) or (text == "json" and json_mode):
                raise RuntimeError("failed " + text)
            return None if text == "empty" else f"{text} {seen[text]}"

        return client

    plain = {r["prompt"]: (r["completion"], r["_error"]) for r in completion.complete(df, make, mode="PERMISSIVE").collect()}
    assert plain == {
        "ok": ("ok 1", None), "flaky": ("flaky 3", None), "json": ("json 1", None), "empty": ("", None), "dead": (None, "failed dead"),
    }
    modes = completion.complete(df.where("prompt = 'json'"), make, json_mode=True).first()
    assert modes["completion"] == "json 2"
    with pytest.raises(Exception, match="failed dead"):
        completion.complete(df, make).collect()


def test_completions_from_a_table(spark):
    df = spark.createDataFrame([("p",), ("q",)], "prompt string")
    table = df.limit(1).select(F.md5("prompt").alias("prompt_id"), F.lit("c").alias("completion"))
    got = {r["prompt"]: r["completion"] for r in completion.completions_from(df, table).collect()}
    assert got == {"p": "c", "q": None}


def test_rewrite_and_hyde_fall_back(spark):
    df = spark.createDataFrame([(["h"], "q", " r "), ([], "q", "r"), (["h"], "q", None)], "h array<string>, q string, c string")
    assert [r[0] for r in df.select(prompts.rewritten_query("h", "q", "c")).collect()] == ["r", "q", "q"]
    assert [r[0] for r in df.select(prompts.hyde_query("c", "q")).collect()] == [" r ", "r", "q"]


def test_small_functions(spark):
    df = spark.createDataFrame([("/a/b.c.TXT", 3), (None, 4), ("", 5), ("plain", 6)], "path string, i int")
    names = df.select(tx.filename("path", "i").alias("f")).collect()
    assert [r["f"] for r in names] == ["b.c.TXT", "object_4", "object_5", "plain"]
    ext = df.select(tx.extension(F.coalesce("path", F.lit(""))).alias("e")).collect()
    assert [r["e"] for r in ext] == ["TXT", "bin", "bin", "bin"]
    row = spark.range(1).select(
        tx.strip(F.lit(" 　 x \n")).alias("s"), tx.random_id().alias("u"), tx.random_id(True).alias("h"),
        tx.now_iso().alias("t"), tx.merge_maps(F.expr("map('a','1','b','1')"), F.expr("map('b','2')")).alias("m"),
        tx.object_key(F.lit("u"), F.lit("id"), F.lit("x.pdf")).alias("k"),
    ).first()
    assert (row["s"], len(row["u"]), len(row["h"]), row["t"][10], row["m"]) == ("x", 36, 32, "T", {"a": "1", "b": "2"})
    assert row["k"] == "uploads/u/id.pdf"


def test_rewrite_sql_reads_every_earlier_turn_of_the_window():
    """A changed earlier turn changes the prompt that a question's rewriting is checked by; one before the window does not."""
    import duckdb

    from stratadoc.plans.oracle import ORACLE

    def prompt(changed):
        rows = [(1, t, "user" if t % 2 == 0 else "assistant", "other" if t == changed else f"text {t}") for t in range(9)]
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        return {r[0]: r[2] for r in con.execute(ORACLE["query_rewrite"]).fetchall()}["1-8"]

    same = prompt(None)
    assert [prompt(t) == same for t in range(8)] == [True, True] + [False] * 6
