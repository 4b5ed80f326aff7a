"""Product codes of vectors, compared exactly through an integer Walsh-Hadamard transform."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut

# Vectors whose distances are held at a time.
BLOCK = 1 << 12
LIMB = 32


def small(width: int) -> int:
    """Components below this keep the sums of transformed squares within 64 bits."""
    return (1 << 30) >> max(0, width - 1).bit_length()


def sequency_hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows in the order of their sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """The transform of rows that are padded with zeros to a power of two; integers stay integers."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded @ sequency_hadamard(size).astype(x.dtype)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index.

    Squares of transformed differences add up to the squared distance times the padded size. They
    are added in sequency order; an entry leaves as soon as its sum exceeds the whole distance to the
    entry that looked best after the first coefficient, so most entries are never added up.
    """
    x, c = transformed(parts), transformed(entries)
    size = x.shape[1]
    n, k = len(x), len(c)
    sums = (x[:, :1] - c[:, 0]) ** 2
    guess = sums.argmin(1)
    bound = ((x - c[guess]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    so_far = sums[row, entry]
    for j in range(1, size):
        so_far = so_far + (x[row, j] - c[entry, j]) ** 2
        alive = so_far <= bound[row]
        if not alive.all():
            row, entry, so_far = row[alive], entry[alive], so_far[alive]
    best = np.full(n, k, np.int64)
    least = bound.copy()
    # The guess itself is always left, so every row has an entry; the bound falls to the least sum.
    order = np.lexsort((entry, row)) if len(row) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(order) else order
    if len(order):
        least[row[order][starts]] = np.minimum.reduceat(so_far[order], starts)
        hit = so_far == least[row]
        np.minimum.at(best, row[hit], entry[hit])
    return best, least // size


def scaled(values: pa.ListArray, scale: int, dim: int, width: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length; Python integers where 64-bit sums could overflow."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    low = np.floor(flat * scale)  # scale is a power of two: exact
    if not low.size or np.abs(low).max() < small(width):
        return low.astype(np.int64)
    return np.array([[int(v) for v in r] for r in low], object).reshape(-1, dim)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


class Codec:
    """Codebooks of equal parts: `books[part][entry]` is a list of integers."""

    def __init__(self, books: list[list[list[int]]], width: int):
        self.books, self.width = books, width

    @property
    def sha256(self) -> str:
        flat = [str(v) for book in self.books for entry in book for v in entry]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances), each rows x parts."""
        parts = split(vectors, len(self.books), self.width)
        index = np.zeros(parts.shape[:2], np.int64)
        error = np.zeros(parts.shape[:2], object if parts.dtype == object else np.int64)
        for p, book in enumerate(self.books):
            entries = np.array(book, object).reshape(len(book), self.width)
            exact = parts.dtype == object or max((abs(v) for v in entries.flat), default=0) >= small(self.width)
            kind = object if exact else np.int64
            index[:, p], found = nearest(parts[:, p].astype(kind), entries.astype(kind))
            if exact and error.dtype != object:
                error = error.astype(object)
            error[:, p] = found
        return index, error


def split(vectors: np.ndarray, parts: int, width: int) -> np.ndarray:
    """rows x parts x width; places beyond the end hold zero."""
    padded = np.zeros((len(vectors), parts * width), vectors.dtype)
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), parts, width)


def sums_of(vectors: DataFrame, codec: Codec, scale: int, dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (rows, component sums)} over all vectors.

    Each task adds up its rows; sums travel as signed limbs of 32 bits, so they are exact at any size,
    and Spark adds the limbs. At most parts x entries x width x a few rows reach the driver.
    """
    width, parts = codec.width, len(codec.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = scaled(batch.column(0)[at : at + BLOCK], scale, dim, width)
                index, _ = codec.assign(x)
                cells = split(x, parts, width)
                for p in range(parts):
                    for e in np.unique(index[:, p]).tolist():
                        rows = cells[index[:, p] == e, p]
                        total[p, e, -1] += len(rows)
                        for i, s in enumerate(rows.sum(0).tolist()):
                            total[p, e, i] += s
        out: list[list[int]] = [[], [], [], [], []]
        for (p, e, i), s in total.items():
            sign, left, limb = (-1 if s < 0 else 1), abs(s), 0
            while left or not limb:
                for column, v in zip(out, (p, e, i, limb, sign * (left & (1 << LIMB) - 1))):
                    column.append(v)
                left, limb = left >> LIMB, limb + 1
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "entry", "place", "limb", "value"])

    rows = vectors.select("v").mapInArrow(run, "part int, entry int, place int, limb int, value long")
    added: dict[tuple[int, int], list[int]] = {}
    for r in rows.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        own = added.setdefault((r.part, r.entry), [0] * (width + 1))
        own[r.place] += r.value << (LIMB * r.limb) if r.value >= 0 else -(-r.value << (LIMB * r.limb))
    return {k: (v[-1], v[:-1]) for k, v in added.items()}


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[Codec, int]:
    """(codebooks after `rounds` rounds, dimension) of a frame (vec_id, v) of usable vectors."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = vectors.orderBy(*order).select("v").first()
    dim = len(first["v"]) if first else 0
    width = -(-dim // parts)
    if not dim:
        return Codec([[] for _ in range(parts)], width), dim
    same = vectors.filter(F.size("v") == dim)
    start = [r["v"] for r in same.orderBy(*order).select("v").limit(entries).collect()]
    x = scaled(pa.array(start, pa.list_(pa.float64())), scale, dim, width)
    cells = split(x.astype(object), parts, width)
    codec = Codec([[[int(v) for v in cells[e, p]] for e in range(len(cells))] for p in range(parts)], width)
    for _ in range(rounds):
        for (p, e), (count, sums) in sums_of(same, codec, scale, dim).items():
            codec.books[p][e] = [s // count for s in sums]
    return codec, dim


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """(vec_id, code, error, label, codebooks_sha256), one row for each usable vector.

    Components become floor(scale * x), `scale` a power of two. Vectors fall into `parts` equal parts
    (the last is padded with zeros if need be); codebooks start as the parts of the smallest ids and
    go through `rounds` rounds of assigning all parts and taking floored means; then all parts are
    assigned. `code` holds two hex digits a part (so at most 256 entries), `error` the squared
    distances. All arithmetic is on integers of any size; an error beyond 64 bits is null.

    Cases: null vectors and vectors with a null or non-finite component or no component are dropped;
    null ids come last in the start order, ties there go by the components; repeated rows count as
    often as they occur; the dimension is that of the smallest id, vectors of another length get a
    null code and error; fewer vectors than entries give smaller codebooks; an empty table gives no
    rows; columns beyond the three named ones are not read, and `label_col` may be missing.
    """
    if entries > 256 or scale & (scale - 1):
        raise ValueError("at most 256 entries, and a scale that is a power of two")
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = cut(rows.filter(usable(F.col("v"))))
    codec, dim = fit(kept, parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                fits = part.column(2).value_lengths().to_numpy(zero_copy_only=False) == dim
                index, error = codec.assign(scaled(part.column(2).filter(pa.array(fits)), scale, dim, codec.width))
                codes, errors = np.full(part.num_rows, None, object), np.full(part.num_rows, None, object)
                codes[fits] = ["".join(f"{e:02x}" for e in r) for r in index.tolist()]
                errors[fits] = [s if (s := sum(r)) < 1 << 63 else None for r in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    coded = kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(codec.sha256))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error: the errors of all rows of the same label, nulls being one label.

    Errors are added before the join, one row a label; a sum beyond 64 bits is null.
    """
    coded = cut(coded)
    sums = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(20, 0))) AS long)").alias("label_error"))
    own = sums.withColumnRenamed("label", "_of")
    return coded.join(own, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")
