"""Packing of tokenized documents into fixed-length sequences by first-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.tokens import default_tokenizer, encoder


class TournamentTree:
    """Free room of bins 0..n-1; each inner node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take `need` from the first bin that has it; descends and updates in log2(bins) steps."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bin_no = node - self.leaves
        room[node] -= need
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
        return bin_no


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every length, which must come in falling order and fit in one bin."""
    tree, used, out = TournamentTree(len(lengths), capacity), {}, []
    for n in lengths:
        b = tree.place(n)
        at = used.get(b, 0)
        used[b] = at + n
        out.append((b, at))
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    max_tokens: int = 2048, end_id: int = 1, with_ids: bool = True,
) -> DataFrame:
    """Every document's ids and the end id, cut after each `max_tokens` ids.

    One row a piece: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), doc_tokens and, if wanted, ids. A null text counts as empty: it is the end id alone.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(path), 4 * max_tokens
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = enc.encode(text.as_py() or "") + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, part))
                held += len(data)
                if held > 8 << 20 and with_ids:
                    yield _piece_batch(rows, with_ids)
                    rows, held = [], 0
            yield _piece_batch(rows, with_ids)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def _piece_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
    if with_ids:
        sizes = np.cumsum([0, *(len(p) // 4 for p in cols[5])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(cols[5]), "<i4"), pa.int32())
        arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 8192, seed: int = 7, expected: int | None = None) -> DataFrame:
    """Assign `sequence_id` and `offset` to the rows of `token_pieces`; other columns stay as they are.

    Pieces fall into random groups by a hash; in each, first-fit decreasing runs over a tournament
    tree. A group is read as a sorted stream and starts anew after `2 * group_pieces` pieces, so no
    key, however frequent, makes a tree grow. `expected` is a rough number of pieces (their count if
    not given); it only sets the number of groups. Sequences of different groups never share an id.
    Ties are ordered by document, start and checksum; fully repeated rows are interchangeable.
    """
    n = pieces.count() if expected is None else expected
    groups = max(1, -(-n // group_pieces))
    names = pieces.columns
    key = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("_group", F.pmod(key, F.lit(groups)))
    order = ["_group", F.desc("length"), "doc_id", "start", "ids_crc32"]
    limit = 2 * group_pieces
    at_length, at_group = names.index("length"), len(names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows, group, first = 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_rows, first
            if not held_rows:
                return
            lengths = [x for b in held for x in b.column(at_length).to_pylist()]
            placed = first_fit_decreasing(lengths, capacity)
            at = 0
            for b in held:
                part = placed[at : at + b.num_rows]
                at += b.num_rows
                ids = pa.array([(group << 32) + first + x for x, _ in part], pa.int64())
                cols = [b.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, ids, pa.array([o for _, o in part], pa.int64())], names=[*names, "sequence_id", "offset"])
            first += 1 + max(x for x, _ in placed)
            held, held_rows = [], 0

        for batch in batches:
            marks = np.array(batch.column(at_group).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if marks[lo] != group:
                    yield from flush()
                    group, first = int(marks[lo]), 0
                while lo < hi:
                    take = min(hi - lo, limit - held_rows)
                    held.append(batch.slice(lo, take))
                    held_rows += take
                    lo += take
                    if held_rows == limit:
                        yield from flush()
        yield from flush()

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.repartition("_group").sortWithinPartitions(*order).mapInArrow(fit, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack whole documents.

    Cases: a null or empty text is one end id; a null id stays null; repeated rows are packed each;
    very long texts become full pieces and one rest; an empty table gives no rows; columns beyond
    the two named ones are not read, so their names cannot clash.
    """
    pieces = token_pieces(docs, id_col, text_col, tokenizer, max_tokens, end_id, with_ids)
    # Documents are counted, not pieces: full pieces need no search for room.
    return pack(pieces, max_tokens, expected=docs.count())
