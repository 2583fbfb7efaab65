"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, in turn order, encoded once with character offsets, and the sorted spans of
the assistant's texts are intersected with the token spans by binary search.

Template: each turn is ``<s>[INST]role[/INST]text</s>``. These four control strings are added to the tokenizer as
special tokens, so token borders and the borders of texts coincide. Inside roles and texts an escape character
(U+001A) is put after the first character of every control string, and doubled where it stands itself, so the
output reads back to exactly the input: ``unescape(escape(x)) == x``, and no text can fake a turn.

Defined results: a null role or text is empty; turns are ordered by turn, then role, then text (null turns
first), and rows that repeat a turn are turns of their own; a null conv_id makes one conversation of its rows.
A conversation is one row of output, so it is the unit that one task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import slices

ESCAPE = "\x1a"
#: The template's control strings.
BOS, ROLE_OPEN, ROLE_CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BOS, ROLE_OPEN, ROLE_CLOSE, EOS)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LEARNED_ROLE = "assistant"

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
_TURN = re.compile(
    re.escape(BOS + ROLE_OPEN) + "(.*?)" + re.escape(ROLE_CLOSE) + "(.*?)" + re.escape(EOS), re.DOTALL
)


def escape(text: str) -> str:
    doubled = text.replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, list[bool]]:
    """The formatted conversation, the [begin, end) of each turn's text in it, and which of them are learned."""
    parts, spans, learned, at = [], [], [], 0
    for role, text in turns:
        head, body = BOS + ROLE_OPEN + escape(role) + ROLE_CLOSE, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        learned.append(role == LEARNED_ROLE)
        parts += [head, body, EOS]
        at += len(head) + len(body) + len(EOS)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2), learned


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that lie inside one of the sorted, disjoint spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = at >= 0
    return inside & (offsets[:, 1] <= spans[np.maximum(at, 0), 1]) & (offsets[:, 0] < spans[np.maximum(at, 0), 1])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped; tokens that share a character count it once."""
    chosen = offsets[mask]
    if not len(chosen):
        return ""
    # A run goes on while the next token begins before or where the earlier ones end.
    reach = np.maximum.accumulate(chosen[:, 1])
    first = np.flatnonzero(np.concatenate(([True], chosen[1:, 0] > reach[:-1])))
    last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
    return "".join(unescape(formatted[int(chosen[a, 0]) : int(reach[b])]) for a, b in zip(first, last, strict=True))


_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        _loaded[path] = tokenizer
    return _loaded[path]


#: Characters of formatted text that are encoded in one call.
ENCODE_CHARS = 1 << 20

_SCHEMA = (
    "conv_id bigint, formatted string, token_ids array<int>, token_begins array<int>, token_ends array<int>,"
    " loss_mask array<boolean>"
)


def _format(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    names = ["conv_id", "formatted", "token_ids", "token_begins", "token_ends", "loss_mask"]
    for batch in slices(batches):
        ids, convs, begin = batch.column(0), batch.column(1).to_pylist(), 0
        while begin < len(convs):
            rendered, size = [], 0
            while begin + len(rendered) < len(convs) and (not rendered or size < ENCODE_CHARS):
                rendered.append(render([(t["role"], t["text"]) for t in convs[begin + len(rendered)]]))
                size += len(rendered[-1][0])
            out: list[list] = [[], [], [], [], []]
            for (text, spans, learned), enc in zip(
                rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True
            ):
                offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets, spans[np.array(learned, bool)])
                for column, value in zip(out, (text, enc.ids, offsets[:, 0], offsets[:, 1], mask), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(begin, len(rendered)),
                    pa.array(out[0], pa.string()),
                    *(pa.array(c, pa.list_(pa.int32())) for c in out[1:4]),
                    pa.array(out[4], pa.list_(pa.bool_())),
                ],
                names=names,
            )
            begin += len(rendered)


def format_conversations(conversations: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """One row per conversation: conv_id, formatted, token_ids, token_begins, token_ends, loss_mask."""
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role"), empty).alias("role"),
            F.coalesce(F.col("text"), empty).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(lambda batches: _format(batches, tokenizer_path), _SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in slices(batches):
        cols: list[list] = [[] for _ in names]
        for i in range(batch.num_rows):
            formatted = batch.column(1)[i].as_py()
            offsets = np.stack([batch.column(k)[i].values.to_numpy() for k in (2, 3)], axis=1)
            mask = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
            turns, loss = parse(formatted), masked_text(formatted, offsets, mask)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            row = (
                batch.column(0)[i].as_py(),
                len(turns),
                hashlib.sha256(said.encode()).hexdigest(),
                len(loss),
                hashlib.sha256(loss.encode()).hexdigest(),
                len(formatted),
            )
            for column, value in zip(cols, row, strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations and their masks say, taken from the output alone."""
    return formatted.select("conv_id", "formatted", "token_begins", "token_ends", "loss_mask").mapInArrow(
        _digest,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
