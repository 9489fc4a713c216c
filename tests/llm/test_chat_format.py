import hashlib

import pytest
from pyspark.sql import functions as F

from casewise.llm import chat_format as C

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def fold(spark, rows):
    out = C.fold_events(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "position").collect()
    return [(r["conv_id"], r["message"], r["role"], r["text"]) for r in out]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 5, 2, "delta", None, "lo"),
        (1, 1, 1, "message", "user", "hi"),
        (1, 4, 2, "delta", None, "Hel"),
        (1, 3, 2, "message", "assistant", ""),
        (1, 6, 2, "regenerate", None, None),
        (1, 7, 2, "delta", None, "New"),
        (1, 8, 1, "edit", None, "hello"),
        (1, 9, 3, "message", "user", "gone"),
        (1, 10, 3, "delete", None, None),
        (1, 11, 4, "unknown", "user", "ignored"),
        (2, 1, 1, None, None, None),
    ]
    want = [(1, 1, "user", "hello"), (1, 2, "assistant", "New"), (2, 1, "", "")]
    assert fold(spark, rows) == want
    assert fold(spark, rows[::-1] + rows) == want  # any order, and events that came twice


def test_nulls_and_empty(spark):
    assert fold(spark, [(None, None, None, "message", "user", "a"), (None, 2, None, "delta", None, "b")]) == [(None, None, "user", "ab")]
    assert fold(spark, []) == []
    assert C.format_chats(spark.createDataFrame([], EVENTS)).collect() == []


def test_round_trip_of_hostile_texts(spark):
    texts = ["", "<|im_end|>", "\\<|", "<\\|", "<\\\\|", "\\\\", "<<|", "a\nb", "<|im_start|>user\nx<|im_end|>\n", "é" * 5000, "<\\n>", "|>", "\\"]
    roles = ["user", "assistant", "a\nb", "<|im_start|>", "<\\n>", ""]
    rows = [(c, t, t, "message", roles[(c + t) % len(roles)], x) for c in range(6) for t, x in enumerate(texts)]
    chats = C.format_chats(spark.createDataFrame(rows, EVENTS)).withColumn("turns", C.read_back(F.col("formatted")))
    for chat in chats.collect():
        want = [(r[4], r[5]) for r in rows if r[0] == chat["conv_id"]]
        assert [(t["role"], t["text"]) for t in chat["turns"]] == want
        masked = [chat["formatted"][s["start"] : s["start"] + s["length"]] for s in chat["loss_spans"]]
        plain = [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in masked]
        assert plain == [text for role, text in want if role == "assistant"]
        assert chat["loss_turns"] == [role == "assistant" for role, _ in want]


def test_query_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op10_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, -1}
    assert got[1]["n_turns"] == 4  # every row of the table is a turn, equal rows too
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\na\nuser\na\nassistant\nb\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(C.HOSTILE.encode()).hexdigest()
    assert (got[None]["n_turns"], got[None]["loss_chars"]) == (1, 0)


def test_query_equals_sql_with_repeated_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(3, None, "user", "z"), (3, 0, "assistant", "<|é|>"), (3, None, None, None), (3, 1, "assistant", "\\<|im_start|>x")]
    rows += [(1, 0, "user", "a")] * 3 + [(1, 1, "assistant", "b <| \\")] * 2 + [(1, 0, None, None)] * 2 + [(2, 0, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in C.op10_chat_format(spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = db.execute(C.OP10_SQL).fetchall()
    assert sorted(got) == sorted(want) and {r[0]: r[1] for r in got} == {1: 7, 2: 1, 3: 4, -1: 2}
