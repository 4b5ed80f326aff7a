"""Token counts of sections: whole documents are encoded once and spans joined to sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.tokens import default_tokenizer, encoder

RULES = ("start", "end", "most")


def token_spans(data: bytes, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters of the UTF-8 text.

    Tokens cover bytes without gaps. A token that starts or ends inside a character counts that
    character as covered, so spans of neighbouring tokens may overlap by one character.
    """
    ends = np.cumsum(byte_lengths[ids])
    begins = ends - byte_lengths[ids]
    if len(data) == 0:
        return begins, ends
    # Number of characters that begin at or before each byte.
    upto = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return upto[begins] - 1, upto[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section of each token; section i covers characters edges[i] to edges[i + 1].

    A token that crosses a boundary goes whole to the section of its first character (`start`), of
    its last character (`end`), or to the one that holds most of its characters, the first at a tie
    (`most`).
    """
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, np.maximum(ends - 1, starts), "right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    two = np.flatnonzero(last == first + 1)
    edge = edges[last[two]]
    out[two] += ends[two] - edge > edge - starts[two]
    for i in np.flatnonzero(last > first + 1):
        share = [min(ends[i], edges[s + 1]) - max(starts[i], edges[s]) for s in range(first[i], last[i] + 1)]
        out[i] = first[i] + int(np.argmax(share))
    return out


def attribute_tokens(sections: DataFrame, id_col: str = "doc_id", sections_col: str = "sections", rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """Tokens of each section of a document whose sections are an array of strings.

    The document is its sections in a row, encoded as one text; an interval search joins the token
    spans to the sections, and `rule` (see `allocate`) settles tokens across a boundary. Returns
    doc_id, n_tokens, n_crossing (tokens over more than one section) and section_tokens (array, one
    count a section; their sum is n_tokens). Null sections count as empty, a null array as no
    section; an empty section gets 0. Ids may be null or repeat: rows are counted each on its own.
    Columns beyond the two named ones are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = [p or "" for p in parts.as_py() or []]
                text = "".join(parts)
                ids = np.frombuffer(enc.encode(text), "<u4")
                edges = np.cumsum([0, *map(len, parts)])
                starts, ends = token_spans(text.encode(), ids, enc.byte_lengths)
                kept = np.flatnonzero(np.diff(edges))  # sections with text; empty ones would shadow the next
                full = edges[np.r_[kept, len(edges) - 1]] if len(kept) else edges[-1:]
                counts = np.zeros(len(parts), np.int64)
                crossing = 0
                if len(ids):
                    counts[kept] = np.bincount(allocate(starts, ends, full, rule), minlength=len(kept))
                    crossing = int((allocate(starts, ends, full, "start") != allocate(starts, ends, full, "end")).sum())
                out.append((doc_id, len(ids), crossing, counts.tolist()))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_tokens", "n_crossing", "section_tokens"])

    return sections.select(F.col(id_col).cast("long"), F.col(sections_col)).mapInArrow(
        count, "doc_id long, n_tokens long, n_crossing long, section_tokens array<long>"
    )


def sentence_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sections): the text cut after every `.`, `!` or `?` with one white space behind it."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "(?<=[.!?][ \n])", -1)
    return docs.select(F.col(id_col).alias("doc_id"), parts.alias("sections"))


def sentence_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """Tokens of every sentence of whole documents, plus n_sections and max_section_tokens.

    The space between two sentences stands at the end of the first, while the token of the next
    word begins with it: `rule` decides. An empty or null text is one empty section with no token.
    """
    counted = attribute_tokens(sentence_sections(docs, id_col, text_col), rule=rule, tokenizer=tokenizer)
    return counted.select(
        "doc_id", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"),
        F.array_max("section_tokens").alias("max_section_tokens"), "section_tokens",
    )
