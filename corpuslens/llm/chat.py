"""Chat formatting: offset-aligned masks.

A conversation is rendered as a whole, encoded once with offsets, and the sorted spans of the assistant's texts are intersected with
the tokens' spans by binary search. A turn is `<|turn|>` role `<|text|>` text `<|end|>`; the three marks are control tokens added to the
tokenizer, so no token spans a mark. In roles and texts a backslash becomes two and `<|` becomes `<\\|`, which undoes exactly.

A conversation may be of any length: rows come sorted by conversation and turn, a rendered part ends at a mark once it holds
PART_CHARS characters (marks always end a token, so the parts' ids are the whole's), and each part is a row of the output.

Nulls: a null text or role is empty. Rows with a null conv_id are one conversation. Turns in order of turn (null first), then role,
then text, so repeated turn numbers have a fixed order, and repeated rows stay. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, column, ints, typed

TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
PART_CHARS = 1 << 20
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@cache
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in MARKS])
    return made


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text and the spans of the assistant's texts, (n, 2) by rising offset."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{TURN}{escape(role)}{TEXT}"
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie inside a span: the last span that starts at a token's start or before must reach its end."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[np.maximum(at, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


PARTS = [("conv", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("last", pa.bool_())]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    for batch in batches:
        yield from zip(ints(batch, "conv").tolist(), column(batch, "role").to_pylist(), column(batch, "text").to_pylist(), strict=True)


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, part, ids array<int>, loss array<boolean>, last): the encoded conversations and their loss masks, in parts."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)

        def encoded(parts: list[tuple[int, int, list, bool]]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in PARTS]
            made = [render(x[2]) for x in parts]
            for (conv, part, _, last), (_, spans), e in zip(parts, made, tok.encode_batch([t for t, _ in made], add_special_tokens=False), strict=True):
                keep = mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), spans)
                for x, v in zip(out, (conv, part, np.array(e.ids, dtype=np.int32), keep, last), strict=True):
                    x.append(v)
            return typed(out, PARTS)

        ready, chars = [], 0
        conv, part, open_, size = None, 0, [], 0
        for c, role, text in _turns(batches):
            if open_ and (c != conv or size > PART_CHARS):
                ready.append((conv, part, open_, c != conv))
                part, open_, size = part + 1, [], 0
            if c != conv:
                conv, part = c, 0
            open_.append((role, text))
            size += len(text)
            chars += len(text)
            if chars > PART_CHARS:
                if ready:
                    yield encoded(ready)
                ready, chars = [], size
        if open_:
            ready.append((conv, part, open_, True))
        if ready:
            yield encoded(ready)

    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = dealt.mapInArrow(run, "conv long, part int, ids array<int>, loss array<boolean>, last boolean")
    return out.select(F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), "part", "ids", "loss", "last")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids and masks of format_chats alone; parts of a
    conversation must stand in order in one partition, as format_chats leaves them."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        state: list = []
        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in kinds]
                ids, keeps = column(part, "ids"), column(part, "loss")
                texts = tok.decode_batch(ids.to_pylist(), skip_special_tokens=False)
                masked = [[t for t, k in zip(a, b, strict=True) if k] for a, b in zip(ids.to_pylist(), keeps.to_pylist(), strict=True)]
                loss = tok.decode_batch(masked, skip_special_tokens=False)
                for conv, text, under, last in zip(column(part, "conv_id").to_pylist(), texts, loss, column(part, "last").to_pylist(), strict=True):
                    if not state:
                        state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for turn in text.split(TURN)[1:]:
                        role, _, body = turn.removesuffix(END).partition(TEXT)
                        state[0] += 1
                        state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    plain = unescape(under)
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                    state[4] += len(text)
                    if last:
                        for x, v in zip(out, (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                            x.append(v)
                        state = []
                yield typed(out, kinds)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
