"""Chat formatting: a conversation is rendered whole."""

from __future__ import annotations

from lattica.llm import chat_format


def test_a_preamble_stands_once_in_a_long_conversation(spark):
    turns = [{"role": "assistant" if i % 2 else "user", "text": f"turn {i}"} for i in range(150)]
    rows = spark.createDataFrame([(1, i, t["role"], t["text"]) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    template = lambda ts: "PREAMBLE" + chat_format.render(ts)
    got = chat_format.format_conversations(rows, template).collect()
    assert [(r["n_turns"], r["formatted_chars"], r["rewrites"]) for r in got] == [(150, len(template(turns)), 0)]
