"""Byte-level BPE of whole texts; each distinct space-delimited chunk is merged once per worker."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np

# Fixed value: the pattern that splits a text before the merges (it belongs to the vocabulary file).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes do not depend on the Unicode version; other chunks go to `tokenizers`.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027]*")
# A space after other white space: the chunks around it do not tokenize on their own.
MIXED_SPACE = re.compile(r"\s ")


def default_tokenizer() -> str:
    """The vocabulary file that the queries use unless told otherwise."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Token ids of texts under one byte-level BPE file.

    The pre-tokenizer always starts a token at a space that follows a character other than white
    space, so the ids of a text are those of its space-delimited chunks in a row. Chunks are encoded
    once and kept in a table that is emptied when full; that changes the time, never the ids. Texts
    with a special token's string or with a space after other white space are encoded whole. Where
    the file's ids follow its merge order, `tiktoken` applies the same merges to new chunks.
    """

    def __init__(self, path: str, room: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.room = room
        self.table: dict[str, bytes] = {}
        # Every character of a byte-level token stands for one byte; special tokens are plain text.
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.byte_lengths = np.zeros(max(sizes) + 1, np.int64)
        self.byte_lengths[list(sizes)] = list(sizes.values())
        self.ranks = self._ranks(path)

    def _ranks(self, path: str):
        """The vocabulary for `tiktoken`; None where ids do not rise with the merges."""
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))
        steps = model.get("pre_tokenizer") or {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"].get("merges", [])]
        made = [vocab[a + b] for a, b in merges]
        own = (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex", True), model.get("normalizer"))
        if own != ("ByteLevel", False, True, None) or made != sorted(made) or len(made) + 256 < len(vocab) - len(self.special):
            return None
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[x] for x in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("chunks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; an empty text has none."""
        if not text:
            return b""
        if MIXED_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *chunks = text.split(" ")
        found = list(map(self.table.get, chunks))
        if None in found:
            new = list({c for c, x in zip(chunks, found) if x is None})
            if len(self.table) + len(new) > self.room:
                self.table.clear()
                new = list(set(chunks))
            self._learn(new)
            found = [self.table[c] for c in chunks]
        return (self.whole(first) if first else b"") + b"".join(found)

    def _learn(self, chunks: list[str]) -> None:
        """Encode many new chunks in a few calls and cut the ids at the chunks' byte ends."""
        if "" in chunks:  # only a space, at the end of a text
            self.table[""] = self.whole(" ")
            chunks = [c for c in chunks if c]
        if not chunks:
            return
        if self.ranks:
            odd = [c for c in chunks if not PLAIN.fullmatch(c)]
            self.table.update((c, self.whole(" " + c)) for c in odd)
            skip = set(odd)
            chunks = [c for c in chunks if c not in skip]
        spaced = [" " + c for c in chunks]
        if self.ranks:
            ids = np.array(self.ranks.encode_ordinary("".join(spaced)), "<u4")
        else:
            joined = ["".join(spaced[i : i + 100]) for i in range(0, len(spaced), 100)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)] or [np.zeros(0, "<u4")])
        ends = np.cumsum(self.byte_lengths[ids])
        wanted = np.cumsum(np.fromiter((len(c.encode()) for c in spaced), np.int64, len(spaced)))
        cuts = (np.searchsorted(ends, wanted) + 1) * 4
        data, start = ids.tobytes(), 0
        for chunk, end in zip(chunks, cuts.tolist()):
            self.table[chunk] = data[start:end]
            start = end


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def text_slices(column, most: int = 1 << 20):
    """Runs of rows of an Arrow string column with about `most` bytes together, so that only they become Python strings."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, used = 0, 0
    for i, n in enumerate(sizes.tolist()):
        used += n
        if used >= most:
            yield slice(begin, i + 1)
            begin, used = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))
