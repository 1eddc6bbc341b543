from pyspark.sql import functions as F

from conftest import plan_of
from tonelens.operators import requests


def test_message_rules(spark):
    texts = [None, "", " \t ", "x" * 2000, "x" * 2001, "  ok  ", " " * 2001]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.reject_reason for r in requests.check_messages(df).orderBy("i").collect()]
    assert got == ["missing", "empty", "blank", None, "too_long", None, "too_long"]
    assert [r.text[:4] for r in requests.admitted_messages(df).orderBy("i").collect()] == ["xxxx", "ok"]


def conversations(spark):
    rows = []
    for conv, n in (("one", 1), ("twenty", 20), ("over", 21), ("huge", 500)):
        rows += [(conv, t, f"m{t}") for t in range(n)]
    rows += [("blank", t, "  ") for t in range(3)] + [("mixed", t, " a " if t % 2 else " ") for t in range(20)]
    return spark.createDataFrame(rows, "conv_id string, turn long, text string")


def test_conversation_rules(spark):
    df = conversations(spark)
    reasons = {r.conv_id: (r.n_messages, r.n_valid, r.reject_reason) for r in requests.check_conversations(df).collect()}
    assert reasons == {
        "one": (1, 1, None), "twenty": (20, 20, None), "over": (21, 21, "too_many"), "huge": (500, 500, "too_many"),
        "blank": (3, 0, "blank"), "mixed": (20, 10, None),
    }
    kept = requests.admitted_conversations(df)
    assert {r.conv_id: r["count"] for r in kept.groupBy("conv_id").count().collect()} == {"one": 1, "twenty": 20, "mixed": 10}
    assert kept.filter(F.col("conv_id") == "mixed").select("text").distinct().collect()[0].text == "a"
    assert "WindowGroupLimit" in plan_of(kept) and plan_of(kept).count("Exchange hashpartitioning") == 1
