"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by one template, encoded once with offsets, and the sorted spans of
its turns meet the spans of its tokens by binary search.  The template's two markers are single tokens and
the head's line feed ends a word, so no token lies across a turn's border.  Control strings inside texts get a backslash after their first
character (one more if they have some), which is undone when the output is read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What chat templates in public use treat as control strings.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)
BATCH_BYTES = 2 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's escaped text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        out += [head, body, f"{END}\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were before."""
    return [(_plain_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=4)
def chat_tokenizer(path: str):
    """A byte-level tokenizer with the template's markers as single tokens.

    What follows a marker is cut behind its first line feed before words are told apart, so that the
    one that ends a head never joins white space that begins a text.
    """
    from tokenizers import AddedToken, Regex, Tokenizer
    from tokenizers.pre_tokenizers import Sequence, Split

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, END)])
    head = Split(Regex(r"\A[^\n]*\n"), "isolated")
    tok.pre_tokenizer = head if tok.pre_tokenizer is None else Sequence([head, tok.pre_tokenizer])
    return tok


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie within one of the sorted ``spans``; empty spans hold none."""
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    turn = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    return (turn >= 0) & (offsets[:, 1] <= spans[np.maximum(turn, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the mask, one for each unbroken run of characters."""
    start, stop = offsets[mask, 0], offsets[mask, 1]
    if not len(start):
        return []
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return [unescape(formatted[a:b]) for a, b in zip(start[new].tolist(), reach[last].tolist(), strict=True)]


OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, token_ids array<int>, loss array<boolean>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_BYTES``, or one conversation."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _format(path: str, learned: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_tokenizer(path)
        for batch in _parts(batches):
            rendered = []
            for turns in batch.column(1).to_pylist():
                pairs = [(t["role"] or "", t["text"] or "") for t in turns]
                rendered.append((pairs, *render(pairs)))
            rows = []
            for conv, (pairs, formatted, spans), e in zip(batch.column(0).to_pylist(), rendered, tok.encode_batch([r[1] for r in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                wanted = np.array([s for s, (role, _) in zip(spans, pairs, strict=True) if role == learned], np.int64).reshape(-1, 2)
                mask = loss_mask(offsets, wanted)
                back = parse(formatted)
                loss = "".join(masked_text(formatted, offsets, mask))
                rows.append({
                    "conv_id": conv, "n_turns": len(back), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(formatted),
                    "formatted": formatted if with_text else None, "token_ids": e.ids if with_text else None, "loss": mask.tolist() if with_text else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return run


_OUT = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
])


def format_conversations(turns: DataFrame, tokenizer_path: str, learned: str = "assistant", with_text: bool = True) -> DataFrame:
    """One row per conversation: digests read back from the output, and (``with_text``) the output itself.

    Turns come in order of ``turn``, nulls first, ties by role and text.  Null texts and roles are empty
    ones; repeated rows are turns of their own.  Rows with a null ``conv_id`` belong to no conversation
    and are left out.  ``loss`` marks the tokens of ``learned`` turns' texts.  Other columns are ignored.
    An empty table gives an empty result.  A conversation is one unit of work, as it is rendered whole.
    """
    whole = (
        turns.filter("conv_id is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))).alias("turns"))
    )
    return whole.mapInArrow(_format(tokenizer_path, learned, with_text), OUT)
