from pyspark.sql import functions as F

from conftest import plan_of
from tonelens.operators import conversation as C
from tonelens.operators.messages import score_messages

CALM, HOSTILE, LIE = "Nice weather today.", "Fine, whatever.", "I never said that. That's not what happened"


def table(spark, conversations):
    rows = [(conv, t, m) for conv, ms in conversations.items() for t, m in enumerate(ms)]
    return spark.createDataFrame(rows, "conv_id string, turn long, text string")


CASES = {
    "golden": [CALM, HOSTILE, HOSTILE],
    "single": [HOSTILE],
    "two": [HOSTILE, HOSTILE],
    "five": [HOSTILE, LIE, CALM, CALM, CALM],
    "six": [HOSTILE, CALM, CALM, CALM, CALM, CALM],
    "over": [HOSTILE] * 21,
    "blank": [" ", ""],
    "gaps": [HOSTILE, "  ", HOSTILE, " ", CALM, CALM],
}


def test_audit(spark):
    out = {r.conv_id: r for r in C.audit_conversations(table(spark, CASES), results=True).collect()}
    assert set(out) == set(CASES) - {"over", "blank"}
    g = out["golden"]
    assert (g.n_sincere, g.n_passive, g.pattern_detected, g.dominant_pattern) == (1, 2, True, "Passive-Aggressive")
    assert (g.escalation_detected, g.overall_severity, g.banner) == (True, "medium", "escalating")
    assert [m.message for m in g.individual_results] == CASES["golden"]
    assert g.individual_results[1].pattern_highlights == ["whatever", "fine, "]
    assert (out["single"].pattern_detected, out["single"].dominant_pattern, out["single"].overall_severity) == (False, "Passive-Aggressive", "high")
    assert (out["two"].pattern_detected, out["two"].escalation_detected, out["two"].banner) == (True, False, "pattern")
    assert out["five"].dominant_pattern == "Passive-Aggressive" and not out["five"].escalation_detected  # tie
    assert (out["six"].n_window, out["six"].dominant_pattern, out["six"].banner) == (5, "Sincere", "none")
    assert out["gaps"].n_window == 4 and "4 messages" in out["gaps"].context_note


def test_audit_shuffles_once(spark):
    assert plan_of(C.audit_conversations(table(spark, CASES))).count("Exchange hashpartitioning") == 1


def test_rolling_agrees_with_the_audit_of_every_prefix(spark):
    conv = {"a": [HOSTILE, CALM, LIE, CALM, HOSTILE, HOSTILE, CALM, CALM, LIE, CALM]}
    rolling = C.rolling_audit(table(spark, conv)).orderBy("turn").collect()
    prefixes = {f"{n:02d}": conv["a"][:n] for n in range(1, 11)}
    audits = C.audit_conversations(table(spark, prefixes)).orderBy("conv_id").collect()
    for r, a in zip(rolling, audits, strict=True):
        assert all(r[c] == a[c] for c in ("n_window", "n_toxic", "dominant_pattern", "escalation_detected", "overall_severity", "context_note"))


def test_rolling_in_chunks_is_the_same(spark):
    """One conversation with most rows, cut at any size, with gaps in the turn numbers."""
    hot = spark.range(400).filter("id % 7 != 3").select(
        F.lit("hot").alias("conv_id"), (F.col("id") * F.col("id") % 1009 + F.col("id") * 3).alias("turn"),
        F.element_at(F.array(*map(F.lit, (CALM, HOSTILE, LIE, CALM, " "))), (F.col("id") % 5 + 1).cast("int")).alias("text"),
    ).dropDuplicates(["turn"])
    df = hot.unionByName(table(spark, {k: CASES[k] for k in ("golden", "five", "gaps")}))
    whole = sorted(map(tuple, C.rolling_audit(df, chunk_turns=10**9).collect()))
    for size in (1, 3, 50, 700):
        assert sorted(map(tuple, C.rolling_audit(df, chunk_turns=size).collect())) == whole


def test_order_of_rows_does_not_matter(spark):
    df = table(spark, CASES)
    a = sorted(map(str, C.audit_conversations(df).collect()))
    assert a == sorted(map(str, C.audit_conversations(df.repartition(5).orderBy(F.rand(3))).collect()))


def test_texts_stay_where_they_are(spark):
    plan = plan_of(C.rolling_verdicts(score_messages(table(spark, CASES)), chunk_turns=None))
    shuffled = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l]
    assert len(shuffled) == 1
