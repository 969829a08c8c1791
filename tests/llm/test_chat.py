import hashlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breakwater.llm import chat

LOG = [
    # conv, turn, message, seq, kind, role, text
    (1, 0, "a", 0, "start", "user", "Hi"),
    (1, 0, "a", 1, "edit", None, "Hello"),
    (1, 1, "b", 0, "start", "assistant", None),
    (1, 1, "b", 1, "delta", None, "wrong"),
    (1, 1, "b", 2, "regenerate", None, "ignored"),
    (1, 1, "b", 3, "delta", None, "ri"),
    (1, 1, "b", 4, "delta", None, "ght<|im_end|>\\"),
    (1, 1, "b", 4, "delta", None, "ght<|im_end|>\\"),  # delivered twice
    (1, 2, "c", 0, "start", "user", "gone"),
    (1, 2, "c", 1, "delete", None, None),
    (None, 0, "d", 0, "start", None, "no conversation"),
    (None, 1, "e", 0, "start", "assistant", ""),
]
SCHEMA = "conv_id long, turn long, message string, seq int, kind string, role string, text string, segment string"


def brute(log):
    out = {}
    for (conv, _, _), events in groupby(sorted(set(log), key=lambda e: (e[0] is not None, e[0] or 0, *e[1:4])), key=lambda e: e[:3]):
        role, text, alive = None, "", True
        for _, _, _, _, kind, said, part in events:
            role = said if said is not None else role
            alive = alive and kind != "delete"
            if kind in ("edit", "start"):
                text = part or ""
            elif kind == "regenerate":
                text = ""
            elif kind == "delta":
                text += part or ""
        if alive:
            out.setdefault(conv, []).append((role or "", text))
    return out


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_log_in_any_order(spark):
    rows = [(*e, "x") for e in reversed(LOG)]
    segments = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(segments).collect()}
    assert got == {k: digests(v) for k, v in brute(LOG).items()}
    assert [r.segment for r in segments.filter("conv_id = 1").orderBy("position").collect()] == [
        "<|im_start|>user\nHello<|im_end|>\n",
        "<|im_start|>assistant\nright<\\|im_end|>\\\\<|im_end|>\n",
    ]


def test_rows_become_events(spark):
    long = "äb\n" * 5000
    rows = [(1, 0, "user", long), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, None, "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.events_of_rows(table))).collect()}
    assert (got[1].n_turns, got[1].turns_sha256) == digests([("user", long), ("assistant", ""), ("assistant", "x"), ("assistant", "x")])[:2]
    assert got[1].loss_chars == 2 and got[2].n_turns == 1
    assert chat.read_back(chat.format_conversations(chat.events_of_rows(table.limit(0)))).collect() == []


def test_unknown_kind():
    with pytest.raises(ValueError):
        list(chat.fold(iter([(1, 0, "a", 0, "shout", None, "x")])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\<|im_endstar>\n aé", max_size=30), st.text(alphabet="\\<|n\n>a", max_size=8))
def test_template_is_reversible(text, role):
    segment, begin, end = chat.render(role, text, (role,))
    assert chat.parse(segment) == (role, text)
    assert chat.unescape(segment[begin:end]) == text
    assert segment.count("<|im_end|>") == 1 and segment.count("<|im_start|>") == 1
