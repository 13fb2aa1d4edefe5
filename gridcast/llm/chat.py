"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Text of this role is learned.
LEARNED = "assistant"

_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)

FORMATTED = "conv_id string, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
READ = T.StructType([T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()))])


def escape(text: str) -> str:
    """``text`` without ``<|``: a backslash is put into every ``<|``, ``<\\|``, ``<\\\\|`` and so on."""
    return _OPENS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one string, and where the texts to learn stand in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END]
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer with the three marks as special tokens and with offsets that cover every character."""
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in (START, SEP, END)])
    return tokenizer


def covered(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with a span. Tokens and spans are sorted; two binary searches per span."""
    mask = np.zeros(len(starts), dtype=bool)
    spans_ = np.array([s for s in spans if s[1] > s[0]], dtype=np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, spans_[:, 0], side="right")
    last = np.searchsorted(starts, spans_[:, 1], side="left")
    for a, b in zip(first, last, strict=True):
        mask[a:b] = True
    return mask


def format_one(conv_id: str | None, turns: list[tuple[str, str]], path: str) -> tuple:
    text, spans = render(turns)
    encoded = load_tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, dtype=np.int32).reshape(-1, 2)
    mask = covered(offsets[:, 0], offsets[:, 1], spans)
    return conv_id, text, np.array(encoded.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1], mask


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: conv_id, formatted, token_ids, starts, ends, loss_mask.

    A conversation is rendered whole, encoded once, and each token gets its offsets (code points of ``formatted``) and whether
    it is learned, i.e. shares a character with an assistant text. Marks are special tokens, and no text or role
    can hold one once escaped, so tokens never reach across the ends of a text.

    Turns are in the order of ``turn`` (null first), then role, then text; repeated rows are turns of their own. A
    null role or text is empty. Rows with a null conversation id are one conversation. Other columns are not read.
    An empty table gives none. ``tokenizer`` is the path of a byte-level BPE file that every executor can read.

    Rows are dealt by conversation and streamed in order; a task holds one batch and one conversation, whose
    text has to be together to be encoded.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[conv_col].dataType
    turns = rows.select(
        F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "formatted", "token_ids", "starts", "ends", "loss_mask"]
        current, held, begun = None, [], False
        for batch in batches:
            done = []
            for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if begun and conv_id != current:
                    done.append(format_one(current, held, tokenizer))
                    held = []
                current, begun = conv_id, True
                held.append((role, text))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if begun:
            yield pd.DataFrame([format_one(current, held, tokenizer)], columns=columns)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInPandas(run, FORMATTED).withColumn("conv_id", F.col("conv_id").cast(kind))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: neighbouring masked tokens make one stretch, and tokens that share a character count it once."""
    pieces, at, stretch = [], -1, []
    for a, b, on in zip(starts.tolist(), ends.tolist(), mask.tolist(), strict=True):
        if on:
            if stretch and a > at:
                pieces.append("".join(stretch))
                stretch = []
            stretch.append(formatted[max(a, at) : b])
            at = max(at, b)
    pieces.append("".join(stretch))
    return "".join(unescape(p) for p in pieces)


@F.pandas_udf(READ)
def _read(formatted: pd.Series, starts: pd.Series, ends: pd.Series, mask: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b, on in zip(formatted, starts, ends, mask, strict=True):
        turns, loss = read_turns(text), read_loss(text, a, b, on)
        whole = "".join(f"{role}\n{body}\n" for role, body in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return pd.DataFrame(rows, columns=READ.names)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output alone."""
    read: Column = _read("formatted", "starts", "ends", "loss_mask")
    found = formatted.select("conv_id", read.alias("r"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return found.select("conv_id", "r.*", "formatted_chars")
