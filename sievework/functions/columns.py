"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_ID = "_row_id"
# Fixed value: signed decimal or integer, first match wins.
NUMERIC_PATTERN = r"[-+]?(?:\d*\.\d+|\d+)"
# The texts read as booleans.
TRUE_TEXTS = ["true", "1"]
FALSE_TEXTS = ["false", "0"]
# Separator and null token for row fingerprints; neither occurs in normal text.
FIELD_SEP = "\u0001"
NULL_TOKEN = "\u0002"


def c(name: str) -> Column:
    """Column by name; names may hold dots or parentheses."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean_text(col: Column) -> Column:
    return F.trim(col.cast("string"))


def extract_numeric(col: Column) -> Column:
    """First number inside the text as double, null where there is none."""
    found = F.regexp_extract(clean_text(col), NUMERIC_PATTERN, 0)
    return F.when(found != "", found.cast("double"))


def parse_boolean(col: Column) -> Column:
    low = F.lower(clean_text(col))
    return F.when(low.isin(TRUE_TEXTS), F.lit(True)).when(low.isin(FALSE_TEXTS), F.lit(False))


def parse_datetime(col: Column, formats: list[str] | None = None) -> Column:
    """Timestamp without zone from text; null where no format fits."""
    text = clean_text(col)
    if not formats:
        return F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def range_rule(col: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """True for nulls and for values inside the inclusive bounds; either bound may be absent."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (col >= F.lit(lo))
    if hi is not None:
        ok = ok & (col <= F.lit(hi))
    return col.isNull() | ok


def category_rule(col: Column, values: list) -> Column:
    """True for nulls and for the chosen values; blanks are ignored, no choice keeps all."""
    chosen = [v for v in values if v not in ("", None)]
    return col.isNull() | col.isin(chosen) if chosen else F.lit(True)


def date_rule(col: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive date window with null pass-through."""
    stamp = col.cast("timestamp_ntz")
    ok = F.lit(True)
    if start:
        ok = ok & (stamp >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ok = ok & (stamp <= F.lit(end).cast("timestamp_ntz"))
    return col.isNull() | ok


def clip_to_range(col: Column, lo, hi, dtype: str) -> Column:
    """Clamp to the observed bounds and restore the column type; nulls stay null."""
    value = F.round(col) if dtype in ("tinyint", "smallint", "int", "bigint") else col
    clipped = F.least(F.greatest(value, F.lit(lo)), F.lit(hi))
    return F.when(col.isNotNull(), clipped).cast(dtype)


def row_fingerprint(columns: list[str]) -> Column:
    """MD5 over all fields, separated, with an explicit null token."""
    parts = [F.coalesce(c(n).cast("string"), F.lit(NULL_TOKEN)) for n in columns]
    return F.md5(F.concat_ws(FIELD_SEP, *parts))


def seeded_hash(seed: int, *cols: Column) -> Column:
    """Order-independent pseudo-random 64-bit integer per row."""
    return F.xxhash64(*cols, F.lit(seed))


def seeded_uniform(seed: int, *cols: Column) -> Column:
    """Uniform value strictly inside (0, 1) derived from the row key."""
    top = F.shiftrightunsigned(seeded_hash(seed, *cols), 11).cast("double")
    return (top + 0.5) / F.lit(float(2**53))
