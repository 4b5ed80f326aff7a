"""Fill-in-middle examples cut at the captures of one full match of a repeated unit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
# Characters turned into Python strings and back at a time (a longer text is a slice of its own).
SLICE = 1 << 20


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart in every output: no end of one may be the start of another."""
    for a in marks:
        for b in marks:
            shared = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or shared or (a != b and a in b) or len(set(marks)) < 3:
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def cut_places(text: str, pattern: regex.Pattern, draws: tuple[int, int]) -> tuple[int, int, int] | None:
    """(units, end of the prefix, end of the middle); None where the text is not a sequence of units.

    One full match of the repeated group keeps every repetition: the ends of its captures count the
    units and hold both cuts.
    """
    match = pattern.fullmatch(text)
    if match is None:
        return None
    ends = match.ends(1)
    low, high = sorted(d % (len(ends) + 1) for d in draws)
    return len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0


def draws_of(key: str, salt: str) -> list[int]:
    """The first four groups of 8 hex digits of the SHA-256 of `salt:key`."""
    digest = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def example(text: str, key: str, pattern: regex.Pattern, marks: tuple[str, str, str], salt: str, rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws_of(key, salt)
    found = cut_places(text, pattern, (h1, h2))
    if found is None:
        return None, "plain", None, None, text
    n, a, b = found
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = ".", marks: tuple[str, str, str] = MARKS,
    salt: str = "1", rate: int = 90, spm: int = 20,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of `docs`.

    `unit` is a pattern of the `regex` library (`.` also matches line ends): a code point by default,
    `\\X` for characters as read, or words with the space behind them. A text is matched whole and
    cut after two of its units, chosen by a hash of the id; `rate` per cent of ids are transformed,
    `spm` per cent of those with the suffix first. Lengths are in code points.

    Cases: a null text is empty; empty texts, texts that hold a mark and texts that are no sequence
    of units (n null) stay as they are, form `plain`; a null id hashes as an empty string; repeated
    rows give equal rows; ids need not be numbers; an empty table gives no rows; columns beyond the
    two named ones are not read. The match keeps about 60 bytes for each unit of one text at a time.
    """
    check_marks(marks)
    pattern = f"({unit})*"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern, regex.DOTALL | regex.V1)
        for batch in batches:
            ids, keys, texts = batch.columns
            start = size = 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size >= SLICE or i + 1 == batch.num_rows:
                    part = slice(start, i + 1)
                    made = [example(t or "", k or "", compiled, marks, salt, rate, spm) for t, k in zip(texts[part].to_pylist(), keys[part].to_pylist())]
                    n, form, prefix, middle, output = zip(*made)
                    yield pa.RecordBatch.from_arrays(
                        [ids[part], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    start, size = i + 1, 0

    key = F.col(id_col)
    read = docs.select(key.alias("doc_id"), key.cast("string").alias("key"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an example was made from, told from its output and form alone."""
    check_marks(marks)
    parts = F.split(output, "|".join("\\Q" + m + "\\E" for m in marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
