import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tonelens.operators import conversation
from tonelens.operators.messages import score_messages
from tonelens.plans.workdir import work_path
from tonelens.streaming import accounting, conversations, messages, windows
from tonelens.streaming.sinks import read_file_stream, run_available, run_to_table

SCHEMA = "conv_id string, turn long, text string, ts timestamp"
T0 = datetime(2024, 1, 1)
LINES = ["Nice weather today.", "Fine, whatever.", "I never said that", "Sure, sure. whatever", " "]


def rows(conv, n, step=10, start=0):
    return [(conv, t, LINES[(t + len(conv)) % 5], T0 + timedelta(seconds=start + step * t)) for t in range(n)]


def write_batches(spark, folder, *batches):
    """One file per batch, in order of arrival."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
    return folder


def stream_of(spark, folder):
    return read_file_stream(spark, f"{folder}/part*", SCHEMA, max_files=1)


def columns(df):
    names = ["conv_id", "turn", "label", "n_window", "n_toxic", "dominant_pattern", "escalation_detected", "overall_severity", "context_note"]
    return sorted(tuple(r) for r in df.select(names).collect())


def test_stream_audit_over_many_batches_equals_batch(spark, tmp_path):
    everything = rows("aa", 23) + rows("b", 9) + rows("ccc", 4, start=15)
    everything.sort(key=lambda r: r[3])
    folder = write_batches(spark, str(tmp_path), everything[:5], everything[5:16], everything[16:])
    streamed = run_to_table(conversations.audit_stream(stream_of(spark, folder)), "audit")
    batch = conversation.rolling_audit(spark.createDataFrame(everything, SCHEMA))
    assert columns(streamed) == columns(batch)


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_into_batches_do_not_matter(spark, tmp_path, seed):
    """Random cuts, with idle gaps, against the same rule applied to all rows at once."""
    rng = random.Random(seed)
    everything = []
    for conv in ("aa", "b", "ccc"):
        at = T0
        for t in range(30):
            at += timedelta(seconds=rng.choice([5, 20, 20, 4000]))
            everything.append((conv, t, LINES[rng.randrange(4)], at))
    everything.sort(key=lambda r: (r[3], r[0]))
    cuts = sorted(rng.sample(range(1, len(everything)), 3))
    folder = write_batches(spark, str(tmp_path), *[everything[a:b] for a, b in zip([0, *cuts], [*cuts, len(everything)], strict=True)])
    got = {(r.conv_id, r.turn): r.n_window for r in run_to_table(conversations.audit_stream(stream_of(spark, folder)), "cuts").collect()}
    want = {}
    for conv in ("aa", "b", "ccc"):
        own = [r for r in everything if r[0] == conv]
        for i, r in enumerate(own):
            n = 1
            while n < 5 and i - n >= 0 and own[i - n + 1][3] - own[i - n][3] <= timedelta(hours=1):
                n += 1
            want[conv, r[1]] = n
    assert got == want


def test_a_late_turn_gets_the_window_of_its_own_time(spark, tmp_path):
    data = [r for r in rows("dd", 14) if r[2].strip()]
    late = data.pop(5)
    folder = write_batches(spark, str(tmp_path), data, [late])
    out = run_to_table(conversations.audit_stream(stream_of(spark, folder)), "late-turn")
    assert out.filter(F.col("turn") == late[1]).first().n_window == 5


def test_idle_conversations_are_forgotten(spark, tmp_path):
    first = rows("aa", 4)
    push = [("zz", 0, LINES[0], T0 + timedelta(hours=5))]
    later = [("aa", 10, LINES[1], T0 + timedelta(hours=6))]
    folder = write_batches(spark, str(tmp_path), first, push, later)
    out = run_to_table(conversations.audit_stream(stream_of(spark, folder)), "idle")
    assert out.filter("conv_id = 'aa' AND turn = 10").first().n_window == 1


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    push = [[("zz", i, LINES[0], T0 + timedelta(minutes=30 + i))] for i in range(2)]  # the mark takes effect a batch later
    late = [("aa", 99, LINES[1], T0 + timedelta(minutes=1))]
    folder = write_batches(spark, str(tmp_path), rows("aa", 3), *push, late)
    out = run_to_table(conversations.audit_stream(stream_of(spark, folder)), "late")
    assert out.filter("turn = 99").count() == 0 and out.count() == 4  # one of the three is blank


def test_scoring_sinks(spark, tmp_path):
    data = rows("aa", 5) + [("b", 0, "x" * 2001, T0), ("b", 1, None, T0), ("b", 2, "  Fine, whatever. ", T0)]
    folder = write_batches(spark, str(tmp_path), data[:4], data[4:])
    out = work_path(spark, "sinks")
    q = messages.start_scoring(stream_of(spark, folder), f"{out}/good", f"{out}/bad", f"{out}/cp", availableNow=True)
    q.awaitTermination()
    bad = {(r.conv_id, r.turn, r.reject_reason) for r in spark.read.parquet(f"{out}/bad").collect()}
    assert bad == {("b", 0, "too_long"), ("b", 1, "missing"), ("aa", 2, "blank")}
    good = spark.read.parquet(f"{out}/good")
    assert good.count() == 5 and good.filter("conv_id = 'b'").first().score_passive == 0.7407
    want = score_messages(spark.createDataFrame(data[:2], SCHEMA)).collect()
    got = {(r.conv_id, r.turn): r.label for r in good.collect()}
    assert all(got[(r.conv_id, r.turn)] == r.label for r in want)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    data = rows("aa", 60, step=60)
    folder = write_batches(spark, str(tmp_path), data[:30], data[30:])
    stream = stream_of(spark, folder).withColumn("label", F.lit("x"))
    counts = {r.window_start.minute: r.n for r in run_to_table(windows.tumbling_label_counts(stream, "15 minutes"), "w").collect()}
    assert counts == {0: 15, 15: 15, 30: 15}
    static = spark.createDataFrame(data, SCHEMA).withColumn("label", F.lit("x"))
    assert windows.sliding_label_counts(static, "30 minutes", "15 minutes").agg(F.sum("n")).first()[0] == 120
    sessions = windows.session_label_counts(static.filter("turn < 10 OR turn > 20"), "5 minutes", "conv_id")
    assert sorted(r.n for r in sessions.collect()) == [10, 39]


def test_accounts_add_up_to_the_input(spark, tmp_path):
    """Blank, late and audited rows of the audit; admitted and rejected ones of the scorer."""
    push = [[("zz", i, LINES[0], T0 + timedelta(minutes=30 + i))] for i in range(2)]
    late = [("aa", 90 + i, LINES[1], T0 + timedelta(minutes=1)) for i in range(3)] + [("zz", 9, LINES[2], T0 + timedelta(minutes=32))]
    folder = write_batches(spark, str(tmp_path), rows("aa", 3), *push, late)
    query, out = run_available(conversations.audit_stream(stream_of(spark, folder), account="audit"), "accounts")
    got = accounting.account(query, "audit_in", "audit_out")
    assert (got["n_input"], got["n_admitted"], got["n_blank"], got["n_late"], got["n_audited"]) == (9, 8, 1, 3, 5)
    assert got["n_input"] == got["n_blank"] + got["n_late"] + got["n_audited"] and out.count() == 5
    assert accounting.account(query, "audit_in", after=got["last_batch"]) == {"n_late": 0, "last_batch": got["last_batch"]}

    folder = write_batches(spark, str(tmp_path / "m"), rows("aa", 5), [("b", 0, "x" * 2001, T0), ("b", 1, None, T0), ("b", 2, "", T0)])
    paths = work_path(spark, "accounts-sinks")
    q = messages.start_scoring(stream_of(spark, folder), f"{paths}/good", f"{paths}/bad", f"{paths}/cp", availableNow=True)
    q.awaitTermination()
    table = {r.outcome: r.n for r in accounting.account_table(spark, q, messages.ACCOUNT).collect()}
    assert table == {"input": 8, "admitted": 4, "missing": 1, "empty": 1, "too_long": 1, "blank": 1, "late": 0}


def test_lost_progress_is_an_error():
    class Query:
        recentProgress = [SimpleNamespace(batchId=b, observedMetrics={}, stateOperators=[]) for b in (7, 8)]

    assert accounting.account(Query, after=6) == {"n_late": 0, "last_batch": 8}
    assert accounting.account(Query, first=7)["last_batch"] == 8
    for seen in (-1, 5):
        with pytest.raises(ValueError):
            accounting.account(Query, after=seen)


def test_stream_of_a_table_that_is_a_folder(spark, tmp_path):
    """A table of several files under its own name, next to another table and to one that is a single file."""
    everything = rows("aa", 23)
    spark.createDataFrame(everything, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame(rows("b", 4), SCHEMA).write.parquet(f"{tmp_path}/others.parquet")
    spark.createDataFrame(everything, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/whole")
    (file,) = (tmp_path / "whole").glob("*.parquet")
    for folder, pattern in ((tmp_path, "turns.parquet"), (f"{tmp_path}/whole", file.name)):
        got = run_to_table(read_file_stream(spark, str(folder), SCHEMA, pattern, max_files=1), "folder").collect()
        assert sorted(map(tuple, got)) == everything
