import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tickloom.llm import chat

TEXTS = st.lists(st.sampled_from([*"ab\\<[|]>/ \n", "</s>", "[INST]", "<<SYS>>", "é"]), max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "a|b", "x\\", "<|", "Assistant"])


@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_round_trip(turns):
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for marker in ("[INST]", "[/INST]", "[ASST]", "</s>", "<<SYS>>"):
        assert all(marker not in chat.escape(t) for _, t in turns)


def test_fold():
    events = [("message", 0, "user", "hi"), ("message", 1, "assistant", "a"), ("delta", 1, None, "b"), ("regenerate", 1, None, None), ("delta", 1, None, "c"), ("delta", 1, None, "d"), ("edit", 0, None, "hello"), ("message", 2, "user", "x"), ("delete", 2, None, None), ("delta", 3, "assistant", "late")]
    assert chat.fold(events) == [("user", "hello"), ("assistant", "cd"), ("assistant", "late")]
    with pytest.raises(ValueError, match="unknown"):
        chat.fold([("message", 0, "user", ""), ("other", 0, "user", "")])


def test_log(spark):
    rows = [("c", 5, "delta", 1, None, "B"), ("c", 1, "message", 0, "user", "q"), ("c", 3, "message", 1, "assistant", "A"), ("c", 7, "edit", 0, None, "Q"), (None, 1, "message", 0, None, None)]
    log = spark.createDataFrame(rows, "conv_id string, seq long, kind string, msg long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.reconstruct(log).collect()}
    assert chat.parse(got["c"].formatted) == [("user", "Q"), ("assistant", "AB")]
    assert chat.parse(got[None].formatted) == [("", "")]


def test_query_reads_back(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = {}
    for r in conv.orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.query(conv).collect()}
    assert set(got) == set(rows)
    for k, turns in rows.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[k].formatted_chars == len(chat.render(turns)[0])


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, seq int, kind string"
    assert [r.conv_id for r in chat.query(spark.createDataFrame([], schema)).collect()] == [-1]
    rows = [(1, 0, "user", None, 9, "x"), (1, 0, "user", None, 9, "x"), (1, None, None, "y" * 200_000, 9, "x"), (None, 1, "assistant", "", 9, "x")]
    got = {r.conv_id: r for r in chat.query(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[None].loss_chars == 0


def test_one_long_conversation(spark):
    n = 20_000
    log = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id) AS text").repartition(8)
    got = [r for r in chat.query(log).collect() if r.conv_id == 7][0]
    assert got.n_turns == n and got.loss_chars == sum(len(f"t{k}") for k in range(1, n, 2))
