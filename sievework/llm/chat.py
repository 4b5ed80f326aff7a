"""Chat formatting: every assistant turn becomes an example of its own with all turns before it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template written here, and the control strings of other common
# templates. Inside roles and texts each gets a backslash after its first character.
TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled, then control strings broken, so no mark remains and nothing is lost."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text starts and ends in it."""
    head, body = TURN + escape(role) + SEP, escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


EXAMPLE = "conv_id long, example long, text string, loss_start long, loss_end long, n_turns long, last boolean"
FLUSH_CHARS = 4 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in EXAMPLE.split(", ")])


def prefix_examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row for each `trained_role` turn: the conversation up to and with it, formatted.

    Only characters loss_start to loss_end of `text` (that turn's text) count for the loss. Turns
    after the last trained one give a closing example without loss (loss_start = loss_end), so that
    no turn is lost. `n_turns` is the number of turns in the example; `last` marks the longest.

    Turns are sorted by turn, role and text inside a conversation and read as a stream; a task holds
    one conversation's prefix at a time. The examples of a conversation come out in order and next
    to each other. Cases: null roles and texts are empty; a null conversation id is one conversation;
    null turns come first; equal turns are ordered by role and text; repeated rows stay; a
    conversation without a trained turn is its closing example; an empty table gives no rows;
    columns beyond the four named ones are not read.
    """
    read = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        conv, begun, prefix, n, example = None, False, "", 0, 0
        pending: tuple | None = None  # the newest example; whether it is the last is known later

        def close() -> None:
            nonlocal pending, held
            if begun and (pending is None or pending[5] < n):
                if pending:
                    rows.append((*pending, False))
                pending = (conv, example, prefix, len(prefix), len(prefix), n)
            if pending:
                rows.append((*pending, True))
                held += len(pending[2])
            pending = None

        for batch in batches:
            for c, _, role, text in zip(*[col.to_pylist() for col in batch.columns]):
                if not begun or c != conv:
                    close()
                    conv, begun, prefix, n, example = c, True, "", 0, 0
                written, start, end = format_turn(role, text)
                at = len(prefix)
                prefix += written
                n += 1
                if role == trained_role:
                    if pending:
                        rows.append((*pending, False))
                        held += len(pending[2])
                    pending = (conv, example, prefix, at + start, at + end, n)
                    example += 1
                if held > FLUSH_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
        close()
        yield _batch(rows)

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(expand, EXAMPLE)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations, taken from the examples alone.

    Needs the rows as `prefix_examples` gives them: the examples of a conversation in order, next to
    each other, so nothing is shuffled again.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, _, text, start, end, _, last in zip(*[col.to_pylist() for col in batch.columns]):
                trained = unescape(text[start:end])
                loss.update(trained.encode())
                loss_chars += len(trained)
                chars += len(text)
                if last:
                    all_turns = parse(text)
                    whole = "".join(f"{r}\n{t}\n" for r, t in all_turns)
                    out.append((conv, len(all_turns), hashlib.sha256(whole.encode()).hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return examples.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
