"""Products of a graph's weighted adjacency matrix with vectors that are stored in blocks.

Vertices are numbered, and a row of a vector table holds the values of a block of numbers. Edges are
sorted by the block they read, then by the vertex they add to, and stored in chunks that stay where they
are. A product ships every block to the tasks that hold edges out of it and one sum for each vertex a chunk
adds to, so what travels follows the edges with a small factor and no edge is shuffled or sorted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.ordering import ordered_index
from sievework.session import cut, discard

# Values in a block of a vector table, edges in a stored chunk and edges that a task holds.
VALUES, CHUNK, TASK = 1 << 20, 1 << 20, 1 << 23
# Edges that are worth a task of their own as long as there are idle cores.
LEAST_TASK = 1 << 17

Arrays = list[np.ndarray]


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


class Matrix:
    """links (id, nbr, w): a product adds w times the value of id to nbr. Links of unknown vertices are left out."""

    def __init__(self, vertices: DataFrame, links: DataFrame, width: int = 1, weighted: bool = True):
        self.width, self.weighted = width, weighted
        self.size = max(1, VALUES >> max(0, width - 1).bit_length())
        self.numbers = cut(ordered_index(vertices.select("id"), [F.col("id")], "v"))
        self.n = self.numbers.count()
        self.blocks = -(-self.n // self.size)
        self._store(links)

    def _store(self, links: DataFrame) -> None:
        spark, weighted = links.sparkSession, self.weighted
        pairs = links.join(self.numbers.selectExpr("id", "v AS a"), "id").join(self.numbers.selectExpr("id AS nbr", "v AS d"), "nbr")
        pairs = cut(pairs.selectExpr(f"CAST(a DIV {self.size} AS INT) AS c", f"CAST(a % {self.size} AS INT) AS a", "d", *(["CAST(w AS DOUBLE) AS w"] if weighted else [])))
        m = pairs.count()
        tasks = max(1, -(-m // TASK), min(spark.sparkContext.defaultParallelism, -(-m // LEAST_TASK)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                c = batch.column(0).to_numpy()
                for part in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c)) + 1) if len(c) else []:
                    piece = batch.slice(part[0], len(part))
                    if held and (held[0].column(0)[0] != piece.column(0)[0] or sum(x.num_rows for x in held) >= CHUNK):
                        yield chunk(held)
                        held = []
                    held.append(piece)
            if held:
                yield chunk(held)

        def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            d = table.column("d").to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(d) != 0])
            w = _blob(table.column("w").to_numpy().astype("<f8")) if weighted else pa.nulls(1, pa.binary())
            return pa.RecordBatch.from_arrays(
                [table.column("c").combine_chunks().slice(0, 1), table.column("p").combine_chunks().slice(0, 1), _blob(table.column("a").to_numpy().astype("<i4")),
                 _blob(d[starts].astype("<i8")), _blob(starts.astype("<i4")), w], names=["c", "p", "a", "d", "starts", "w"])

        sorted_pairs = pairs.repartitionByRange(tasks, "c", "d", "a").sortWithinPartitions("c", "d").withColumn("p", F.spark_partition_id())
        chunks = cut(sorted_pairs.mapInArrow(run, "c int, p int, a binary, d binary, starts binary, w binary"))
        discard(pairs)
        # A task for each range and block it reads: at most one a range and one a block.
        slots = chunks.select("p", "c").distinct().orderBy("p", "c").collect()
        self.tasks = max(1, len(slots))
        keys = spread_keys(spark, self.tasks)
        places = spark.createDataFrame([(r.p, r.c, k) for r, k in zip(slots, keys)], "p int, c int, k long")
        self.places = cut(places.selectExpr("c AS b", "k"))
        self.chunks = chunks.join(F.broadcast(places), ["p", "c"]).drop("p", "c").repartition(self.tasks, "k").persist(StorageLevel.DISK_ONLY)
        self.chunks.count()  # only a filled cache tells the planner how it is partitioned

    def free(self) -> None:
        """Give the stored edges up; vectors that were stored can still be read."""
        self.chunks.unpersist()

    def length(self, b: int) -> int:
        return min(self.size, self.n - b * self.size)

    def full(self, value: float) -> DataFrame:
        """(b, x): the same value everywhere."""
        n, size, width = self.n, self.size, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), _blob(np.full((min(size, n - b * size), width), value))], names=["b", "x"])

        return self.numbers.sparkSession.range(self.blocks).mapInArrow(run, "b int, x binary")

    def gathered(self, values: DataFrame, columns: list[str]) -> DataFrame:
        """(b, x): columns of (v, ...), which has a row for every vertex, side by side."""
        rows = values.select(F.expr(f"CAST(v DIV {self.size} AS INT)").alias("b"), "v", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for batch in batches:
                b = batch.column(0).to_numpy()
                table = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)], axis=1)
                for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1) if len(b) else []:
                    if held and at != b[part[0]]:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), _blob(np.concatenate(held))], names=["b", "x"])
                        held = []
                    at = int(b[part[0]])
                    held.append(table[part])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), _blob(np.concatenate(held))], names=["b", "x"])

        return rows.repartition(max(1, self.blocks), "b").sortWithinPartitions("b", "v").mapInArrow(run, "b int, x binary")

    def step(self, state: DataFrame, update: Callable[[Arrays, np.ndarray], Arrays]) -> DataFrame:
        """The vectors after `update` saw those of a block, the first of them times the matrix.

        state is (b, x, ...); update gets its vectors and the product and returns as many vectors.
        """
        n, size, width, names = self.n, self.size, self.width, state.columns

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, a, d, starts, w = (None if v is None else v.as_buffer() for v in (batch.column(j)[i] for j in range(5)))
                    got = np.frombuffer(x, "<f8").reshape(-1, width)[np.frombuffer(a, "<i4")]
                    if w is not None:
                        got = got * np.frombuffer(w, "<f8")[:, None]
                    sums = np.add.reduceat(got, np.frombuffer(starts, "<i4"), axis=0)
                    d = np.frombuffer(d, "<i8")
                    for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d // size)) + 1):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d[part[0]] // size], pa.int32()), _blob((d[part] % size).astype("<i4")), _blob(sums[part])], names=["b", "at", "y"])

        sent = state.select("b", "x").join(F.broadcast(self.places), "b").select("k", "x").repartition(self.tasks, "k")
        came = self.chunks.join(sent.hint("shuffle_hash"), "k").selectExpr("x", "a", "d", "starts", "IF(length(w) >= 0, w, NULL) AS w").mapInArrow(send, "b int, at binary, y binary")
        met = state.selectExpr("*", "CAST(NULL AS BINARY) AS at", "CAST(NULL AS BINARY) AS y").unionByName(
            came.selectExpr("b", *[f"CAST(NULL AS BINARY) AS {c}" for c in names[1:]], "at", "y"))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, old, y = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    b = batch.column(0)[i].as_py()
                    if b != at:
                        if at is not None:
                            yield done(at, old, y)
                        at, old, y = b, None, np.zeros((min(size, n - b * size), width))
                    if batch.column(len(names))[i].is_valid:
                        y[np.frombuffer(batch.column(len(names))[i].as_buffer(), "<i4")] += np.frombuffer(batch.column(len(names) + 1)[i].as_buffer(), "<f8").reshape(-1, width)
                    else:
                        old = [np.frombuffer(batch.column(j)[i].as_py(), "<f8").reshape(len(y), -1) for j in range(1, len(names))]
            if at is not None:
                yield done(at, old, y)

        def done(b: int, old: Arrays, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[_blob(x) for x in update(old, y)]], names=names)

        ordered = met.repartition(max(1, self.blocks), "b").sortWithinPartitions("b")
        return ordered.mapInArrow(fold, ", ".join(["b int", *[f"{c} binary" for c in names[1:]]]))

    def map(self, state: DataFrame, update: Callable[[Arrays], Arrays], names: list[str]) -> DataFrame:
        """(b, names...): vectors made from those of the same block."""
        n, size = self.n, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = batch.column(0)[i].as_py()
                    old = [np.frombuffer(batch.column(j)[i].as_py(), "<f8").reshape(min(size, n - b * size), -1) for j in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[_blob(x) for x in update(old)]], names=["b", *names])

        return state.mapInArrow(run, ", ".join(["b int", *[f"{c} binary" for c in names]]))

    def total(self, state: DataFrame, measure: Callable[[Arrays], np.ndarray]) -> np.ndarray:
        """Sum over the blocks of a few numbers that `measure` tells of each."""
        n, size = self.n, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = batch.column(0)[i].as_py()
                    old = [np.frombuffer(batch.column(j)[i].as_py(), "<f8").reshape(min(size, n - b * size), -1) for j in range(1, batch.num_columns)]
                    found = np.ravel(measure(old)).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["i", "s"])

        rows = state.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        return np.array([r.s for r in rows])

    def by_id(self, x: DataFrame, names: list[str]) -> DataFrame:
        """(id, names...): the columns of the vector x (b, x) by vertex."""
        size, width = self.size, len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = batch.column(0)[i].as_py()
                    values = np.frombuffer(batch.column(1)[i].as_py(), "<f8").reshape(-1, width)
                    for a in range(0, len(values), 1 << 16):
                        part = values[a : a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(b * size + a + np.arange(len(part))), *[pa.array(np.ascontiguousarray(part[:, j])) for j in range(width)]], names=["v", *names])

        rows = x.select("b", "x").mapInArrow(run, ", ".join(["v long", *[f"{c} double" for c in names]]))
        return self.numbers.join(rows, "v").select("id", *names)


def spread_keys(spark, tasks: int) -> list[int]:
    """One key for each of so many hash partitions, so that no two slots share a task."""
    part, found = F.pmod(F.hash("id"), F.lit(tasks)), []
    draws = 16 * tasks
    while len(found) < tasks:
        found = spark.range(draws).groupBy(part.alias("p")).agg(F.min("id").alias("k")).orderBy("p").collect()
        draws *= 4
    return [r.k for r in found]
