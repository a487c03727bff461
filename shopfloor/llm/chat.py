"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered into one string, in which a turn is

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

Control strings inside roles and texts are escaped with a backslash after
their first character (and backslashes are doubled), so the rendering is
reversible and a text can never end its own turn.  The whole
string is encoded once, with character offsets; the markers are special
tokens, so no token crosses a turn's edge.  The loss mask is found by binary
search: the sorted spans of the trained role's texts against the sorted token
spans.

Scale.  One shuffle on the conversation id; a conversation is one output row
and is rendered whole.  The tokenizer's file is read on the driver and
broadcast (its size is fixed), so executors need no local copy.

Defined cases: null text or role is empty; turns are ordered by turn, then
role and text, nulls first; rows without a conversation id form one
conversation with a null id; repeated rows are turns of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_text_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Markers of the template, and other templates' control strings that are escaped too.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"

_CONTROL = re.compile("(?:" + "|".join(f"(?={re.escape(c)})" for c in CONTROLS) + ")(.)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)
_READY: dict[str, object] = {}

SCHEMA = (
    "conv_id long, formatted string, token_ids array<int>, offsets array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start: int, end: int>>"
)


def escape(text: str) -> str:
    """Double backslashes, and part every control string after its first character (overlapping ones too)."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the sorted spans (start, end) of the trained role's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: token offsets (start, end) against spans, both sorted."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = (at >= 0) & (offsets[:, 0] < spans[np.maximum(at, 0), 1])
    # a token that begins before a span may still reach into it
    following = np.minimum(at + 1, len(spans) - 1)
    reaches = (at + 1 < len(spans)) & (offsets[:, 1] > spans[following, 0]) & (spans[following, 0] < spans[following, 1])
    return inside | reaches


def loss_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of adjoining masked tokens as character spans."""
    out: list[tuple[int, int]] = []
    for start, end in offsets[mask].tolist():
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _tokenizer(spec: str):
    if spec not in _READY:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_str(spec)
        made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, SEP, END)])
        _READY.clear()
        _READY[spec] = made
    return _READY[spec]


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: the formatted text, its tokens with offsets (start, end, start, end, ...), mask and loss spans."""
    bound_text_batches(rows.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _tokenizer(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                convs = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
                coded = made.encode_batch([text for text, _ in convs], add_special_tokens=False)
                ids, offsets, masks, spans = [], [], [], []
                for (_, wanted), c in zip(convs, coded, strict=True):
                    place = np.array(c.offsets, np.int64).reshape(-1, 2)
                    mask = loss_mask(wanted, place)
                    ids.append(c.ids)
                    offsets.append(place.ravel())
                    masks.append(mask)
                    spans.append([{"start": a, "end": b} for a, b in loss_spans(place, mask)])
                yield pa.record_batch(
                    [
                        batch.column("conv_id"), pa.array([text for text, _ in convs], pa.string()), pa.array(ids, pa.list_(pa.int32())),
                        pa.array(offsets, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["conv_id", "formatted", "token_ids", "offsets", "loss_mask", "loss_spans"],
                )

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(encode, SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, seen, chars, loss, size = [], [], [], [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            n.append(len(turns))
            seen.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            chars.append(len(learned))
            loss.append(hashlib.sha256(learned.encode()).hexdigest())
            size.append(len(text))
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(seen), pa.array(chars, pa.int64()), pa.array(loss), pa.array(size, pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the output finds: turns, and the text under the loss mask."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
