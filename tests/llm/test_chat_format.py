import hashlib

import pytest
from pyspark.sql import functions as F

from cytolith.llm import op3_chat_format as op

ROWS = "conv_id long, turn long, role string, text string, formatted string"
HOSTILE = ["</turn>", "<turn assistant>", "&lt;turn&gt;", "</s>[INST] ok [/INST]", "&amp;lsqb;[[<&", "a\nb\r\n", "", "ü😀"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest(said), len(loss), digest(loss)


def test_round_trip_of_hostile_texts(spark):
    convs = {k: [("user", a), ("assistant", b), ("tool>x<y", a + b)] for k, (a, b) in enumerate(zip(HOSTILE, reversed(HOSTILE), strict=True))}
    rows = [(k, i, r, t, "x") for k, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got = {r["conv_id"]: r for r in op.report(spark.createDataFrame(rows[::-1], ROWS)).collect()}
    for k, turns in convs.items():
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == expected(turns)


def test_no_control_string_inside_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", " ".join(HOSTILE), "x")], ROWS)
    text = op.format_conversations(rows).first()["formatted"]
    assert text.count("<") == 2 and "[" not in text and text.startswith("<turn user>") and text.endswith(op.END)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "assistant", "b", "x"), (1, 0, "assistant", "b", "x"), (None, None, "user", "u", None), (None, 3, "assistant", None, None)]
    got = {r["conv_id"]: r for r in op.report(spark.createDataFrame(rows, ROWS)).collect()}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == expected([("", ""), ("assistant", "b"), ("assistant", "b")])[:2]
    assert (got[None]["n_turns"], got[None]["loss_chars"]) == (2, 0)
    assert op.report(spark.createDataFrame([], ROWS)).count() == 0


def test_records_of_all_layouts(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = {
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":7}': two,
        '{"conversation":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': two,
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': two,
        '{"prompt":"q","response":"a"}': two,
        '{"completion":"a","prompt":"q","score":1.5}': two,
        '{"system":"s","prompt":"q","response":"a"}': [("system", "s"), *two],
        '{"system":"","prompt":"q","response":"a"}': two,
        '{"instruction":"q","output":"a"}': two,
        '{"instruction":"q","input":"more","output":"a"}': [("user", "q"), ("user", "more"), ("assistant", "a")],
        '{"question":"q","answer":"a"}': two,
        '{"data":{"prompt":"q","response":"a"}}': two,
        '{"prompt":"q","response":null}': [("user", "q"), ("assistant", "")],
        '{"instruction":"q","input":"","output":"a","text":"all of it"}': two,
        '{"system":"s","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': [("system", "s"), *two],
        '{"system":"s","instruction":"q","output":"a"}': [("system", "s"), *two],
        '{"prompt":"q","messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': two,
        '{"role":"x","turn":1,"text":"t","messages":[{"content":"q"},{"role":"user"},null,{"role":"assistant","content":"a"}]}': [("", "q"), ("user", ""), ("assistant", "a")],
        '{"messages":[]}': None,
        "no json": None,
        '{"other":1}': None,
    }
    df = spark.createDataFrame([(k,) for k in records], "record string")
    for r in df.select("record", op.from_records(F.col("record")).alias("turns")).collect():
        assert (r["turns"] and [tuple(t) for t in r["turns"]]) == records[r["record"]], r["record"]


def test_typed_frames_and_fingerprints(spark):
    messages = spark.createDataFrame([([("user", "q"), ("assistant", None)], 1)], "messages array<struct<role:string,content:string>>, x int")
    assert [tuple(t) for t in op.from_frame(messages).first()["turns"]] == [("user", "q"), ("assistant", "")]
    nested = spark.createDataFrame([(("q", "a"),)], "data struct<prompt:string,response:string>")
    assert [tuple(t) for t in op.from_frame(nested).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    beside = spark.createDataFrame([([("user", "q"), ("assistant", "a")], "s", "x", "y", 1)], "messages array<struct<role:string,content:string>>, system string, text string, role string, turn int")
    assert [tuple(t) for t in op.from_frame(beside).first()["turns"]] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        op.from_frame(spark.createDataFrame([(1,)], "x int"))
    assert len(op.BY_FINGERPRINT) == len(op.LAYOUTS)
    paths = frozenset({"prompt", "response"})
    assert spark.range(1).select(F.xxhash64(F.lit("|".join(sorted(paths))))).first()[0] == op.fingerprint(paths)


def test_records_without_a_layout_are_counted(spark):
    df = spark.createDataFrame([('{"prompt":"q","response":"a"}', "x"), ('{"prompt":"q"}', "y"), ('{"prompt":"p","z":1}', "z"), (None, "n"), ("", "e")], "record string, paths string")
    done, rejects = op.format_records(df)
    assert [r["formatted"] for r in done.collect()] == ["<turn user>q</turn><turn assistant>a</turn>"]
    assert sorted(r["paths"] for r in rejects.collect()) == ["e", "n", "y", "z"]
    assert {tuple(r) for r in op.reject_counts(rejects, "_paths").collect()} == {("prompt", 2), ("", 2)}


def test_very_long_conversations(spark):
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("<ü>").alias("text"))
    long = spark.range(1).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("a[b&c "), 1_700_000).alias("text"))
    got = {r["conv_id"]: r for r in op.report(many.unionByName(long)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (100_000, 150_000, digest("<ü>" * 50_000))
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (1, digest("a[b&c " * 1_700_000))


def test_main_path_is_native(spark):
    plan = op.report(spark.createDataFrame([(1, 0, "user", "x", "x")], ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
