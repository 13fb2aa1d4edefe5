import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcast.llm import chat

TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<", "|>", "\\", "<\\\\|", "", "  \n\n two  spaces ", "🙂🙃 naïve 日本語 \u0301", "<|endoftext|>", "<|", "a<", "|im_end|>"]


@given(st.text(alphabet="<|\\> im_endsartp\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_mark(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and "<|" not in escaped


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_sep|>", ""]), st.sampled_from(TRICKY)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_round_trip(turns):
    _, text, ids, starts, ends, mask = chat.format_one("1", turns, chat.TOKENIZER)
    assert chat.read_turns(text) == turns
    assert chat.read_loss(text, starts, ends, mask) == "".join(t for r, t in turns if r == "assistant")
    assert len(ids) == len(starts) == len(ends) == len(mask)
    tokenizer = chat.load_tokenizer(chat.TOKENIZER)
    assert tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


def test_covered_matches_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(50):
        ends = np.cumsum(draw.integers(1, 4, 30))
        starts = np.concatenate([[0], ends[:-1]])
        edges = np.sort(draw.choice(np.arange(ends[-1]), 6, replace=False))
        spans = [(int(a), int(b)) for a, b in edges.reshape(-1, 2)] + [(int(ends[-1]), int(ends[-1]))]
        want = [any(a < y and x < b for x, y in spans) for a, b in zip(starts, ends)]
        assert chat.covered(starts, ends, spans).tolist() == want


def expect(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(32 + len(x) + len(re.findall(r"<\\*\|", x)) - 16 for _, _, r, t in turns for x in (r, t))
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.read_back(df).collect()}


def test_conversations_and_odd_input(spark):
    rows = [(i % 40, i // 40, ["user", "assistant", "system"][i % 3], TRICKY[i % len(TRICKY)]) for i in range(400)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "null id"), (500, None, "assistant", "no turn"), (500, 0, None, None), (500, 0, None, None), (501, 0, "assistant", None), (502, 1, "assistant", "word " * 40_000), (503, 0, "assistant", "a"), (503, 0, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS starts", "3 AS loss_mask").repartition(6)
    found = chat.format_conversations(frame)
    assert found.schema["conv_id"].dataType.typeName() == "long"
    assert got(found) == expect(rows)
    assert chat.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["string", "int"])
def test_other_id_types(spark, ids):
    frame = spark.createDataFrame([("7", 0, "assistant", "hi")], "conv_id string, turn int, role string, text string").selectExpr(f"cast(conv_id AS {ids}) AS conv_id", "turn", "role", "text")
    assert chat.format_conversations(frame).schema["conv_id"].dataType.simpleString() == ids
