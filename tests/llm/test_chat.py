from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import chat

PIECES = st.sampled_from(["\\", "<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<<", "<", "|", "\n", "é", "\U0001f600", "a", "<s>"])
TEXT = st.one_of(st.none(), st.lists(PIECES, max_size=8).map("".join))


def table_of(turns) -> pa.Table:
    """Rows of (conversation or None, role, text); rows without one get a number each."""
    return pa.table({
        "conv_id": pa.array([t[0] for t in turns], pa.int64()),
        "own": pa.array([k if t[0] is None else None for k, t in enumerate(turns)], pa.int64()),
        "role": pa.array([t[1] for t in turns], pa.string()), "text": pa.array([t[2] for t in turns], pa.string())})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), TEXT, TEXT), min_size=1, max_size=12), st.integers(1, 5), st.sampled_from([1, 60, 1 << 20]))
def test_round_trip_over_any_batches_and_pieces(turns, size, piece_bytes):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    out = [r for b in chat.format_batches(iter(table_of(turns).to_batches(max_chunksize=size)), piece_bytes) for r in b.to_pylist()]
    whole = []
    for r in out:
        if r["piece"] == 0:
            whole.append((r["conv_id"], []))
        assert r["conv_id"] == whole[-1][0] and r["n_turns"] == len(chat.read_turns(r["formatted"])) > 0
        whole[-1][1].extend(chat.read_turns(r["formatted"]))
    mine = [(None, [(a or "", b or "")]) for c, a, b in turns if c is None]
    mine += [(c, [(a or "", b or "") for d, a, b in turns if d == c]) for c in sorted({t[0] for t in turns if t[0] is not None})]
    assert whole == mine
    if piece_bytes == 1 << 20:
        assert all(r["piece"] == 0 for r in out)


def test_controls_are_broken_and_loss_is_the_assistants_text():
    tricky = "</s>[INST] ok [/INST] \\ <|im_end|>"
    table = table_of([(1, "user", tricky), (1, "assistant", tricky), (1, "assistant", "é")])
    r = chat.assemble(table).to_pylist()[0]
    for mark in ("</s>", "[INST]", "[/INST]"):
        assert mark not in r["formatted"]
    assert r["formatted"].count("<|im_end|>") == 3
    assert chat.read_loss(r["formatted"], r["loss_starts"], r["loss_ends"]) == tricky + "é"


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (2, None, None, "first"), (2, 5, "user", ""), (2, 5, "user", ""),
            (3, 0, "assistant", "x" * 300_000), (2, 7, "assistant", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS formatted", "1 AS n_turns")
    rows = chat.format_chat(turns).collect()
    # without an id each row is a conversation
    assert sorted(chat.read_turns(r["formatted"]) for r in rows if r["conv_id"] is None) == [[("assistant", "")], [("user", "a")]]
    out = {r["conv_id"]: r for r in rows}
    assert chat.read_turns(out[2]["formatted"]) == [("", "first"), ("user", ""), ("user", ""), ("assistant", "end")]
    assert len(chat.read_loss(out[3]["formatted"], out[3]["loss_starts"], out[3]["loss_ends"])) == 300_000
    assert chat.format_chat(turns.limit(0)).collect() == []


def test_long_conversation_comes_in_pieces(spark):
    turns = spark.createDataFrame([(c, k, "user" if k % 2 else "assistant", f"{k} " + "x" * 199) for c in (1, 2) for k in range(2000)], "conv_id long, turn long, role string, text string")
    rows = chat.format_chat(turns, piece_bytes=150_000).collect()
    for c in (1, 2):
        mine = [r for r in rows if r["conv_id"] == c]
        assert [r["piece"] for r in mine] == list(range(len(mine))) and 2 <= len(mine) <= 4
        assert [int(t.split()[0]) for r in mine for _, t in chat.read_turns(r["formatted"])] == list(range(2000))
        assert sum(len(chat.read_loss(r["formatted"], r["loss_starts"], r["loss_ends"])) for r in mine) == sum(len(f"{k} ") + 199 for k in range(0, 2000, 2))
