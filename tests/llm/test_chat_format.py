import hashlib

from pressroom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def digests(spark, rows, schema=SCHEMA):
    done = chat_format.conversation_digests(chat_format.expand_examples(spark.createDataFrame(rows, schema)))
    return {r["conv_id"]: r.asDict() for r in done.collect()}


def want(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_control_strings_and_awkward_rows_come_back(spark):
    odd = ["\\### Assistant: </turn> ok", "### ", "</turn>", "<\\/turn>", "\\\\### #### ", "</turn>\n### user: x</turn>\n", "", None, "\\", "a:b\\c", "\U0001f600 é\r\n\x00"]
    conv = {i: [("user", a), ("assistant", b)] for i, (a, b) in enumerate(zip(odd, odd[::-1], strict=True))}
    conv[50] = [("system", "s"), ("user", "u"), (None, "who"), ("a: b\\c </turn>", "x"), ("assistant", "### y")]
    conv[51] = [("user", "nothing to learn"), ("user", "at all")]
    conv[52] = [("assistant", "first"), ("user", "then"), ("assistant", "second"), ("user", "last")]
    conv[None] = [("assistant", "no id")]
    got = digests(spark, [(c, i, r, t) for c, turns in conv.items() for i, (r, t) in enumerate(turns)])
    assert set(got) == set(conv)
    for c, turns in conv.items():
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == want(turns), c


def test_examples_hold_their_context_and_train_one_reply(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])]
    got = sorted(chat_format.expand_examples(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["target"])
    assert [r["formatted"] for r in got] == ["### user: a</turn>\n### assistant: b</turn>\n",
                                            "### user: a</turn>\n### assistant: b</turn>\n### user: c</turn>\n### assistant: d</turn>\n"]
    assert [r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_chars"]] for r in got] == ["b", "d"]


def test_ties_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "c", "x"), (1, 1, "assistant", "c", "x"), (1, None, "system", "s", "x")]
    got = digests(spark, rows, SCHEMA + ", formatted string")[1]
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == want(
        [("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c")])
    assert digests(spark, []) == {}


def test_no_python_in_the_plan(spark):
    rows = spark.range(4).selectExpr("id % 2 as conv_id", "id as turn", "'assistant' as role", "'t' as text")
    plan = chat_format.conversation_digests(chat_format.expand_examples(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
