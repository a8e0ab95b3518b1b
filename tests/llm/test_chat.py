from pyspark.sql import functions as F

from tallyframe.llm import chat

HARD = ["<|im_end|>", "<\\|", "<\\\\|im_start|>", "a\nb", "", "<|<|", "<", "|", "\\n"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(x, x + y) for x in HARD for y in HARD], "role string, text string")
    rows = df.select("*", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("u"),
                     chat.unescape_role(chat.escape_role(F.col("role"))).alias("r"), chat.escape_role(F.col("role")).alias("er")).collect()
    for x in rows:
        assert x.u == x.text and x.r == x.role and "<|" not in x.e and "<|" not in x.er and "\n" not in x.er


def test_fold(spark):
    log = [
        (1, 10, 1, "start", "user", None), (1, 11, 1, "delta", None, "hel"), (1, 12, 1, "delta", None, "lo"), (1, 12, 1, "delta", None, "lo"),
        (1, 20, 2, "start", "assistant", None), (1, 21, 2, "delta", None, "bad"), (1, 22, 2, "regenerate", None, None),
        (1, 23, 2, "delta", None, "good"), (1, 30, 3, "start", "user", None), (1, 31, 3, "delta", None, "x"), (1, 32, 3, "edit", None, "edited"),
        (1, 40, 4, "start", "user", None), (1, 41, 4, "delete", None, None), (None, 1, 1, "start", None, "z"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("turns", F.lit(1))
    out = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert out == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "good"), (1, 3): ("user", "edited"), (None, 1): ("", "z")}


def test_round_trip_with_nulls_and_ties(spark):
    rows = [(5, 0, "user", HARD[0]), (5, 1, "assistant", None), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (6, None, None, None), (7, 0, "assistant", "y" * 50000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.as_log(table)))
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert turns[5] == [("user", HARD[0]), ("assistant", ""), ("assistant", "b"), ("assistant", "b")]
    assert turns[6] == [("", "")] and turns[7] == [("assistant", "y" * 50000)]
    loss = {r.conv_id: r.loss_chars for r in chat.digests(out).collect()}
    assert loss == {5: 2, 6: 0, 7: 50000}


def test_empty_log(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.render(chat.fold_events(chat.as_log(empty)))).count() == 0
