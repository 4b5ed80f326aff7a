"""Approximate nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Queries whose candidates are marked at a time.
QUERIES = 1024


class PrefixForest:
    """Sorted arrays of hash strings, one a tree; a string's bits are signs of random projections.

    Rows get one more component that gives all of them the norm of the longest, and queries a zero,
    so that the nearest by angle are the largest by inner product.
    """

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] + 1, bits)).astype(np.float32)
        squares = (vectors * vectors).sum(1)
        codes = self.hash(np.column_stack([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))]))
        self.order = codes.argsort(axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def hash(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows): each hash string as an integer, its first bit highest."""
        low = rows.astype(np.float32) / np.float32(max(1e-30, np.abs(rows).max(initial=0)))
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.float32)
        return np.stack([((low @ p > 0) @ weights).astype(np.int32) for p in self.planes])

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """(queries, rows): the rows that share a prefix with each query at its own depth.

        Each query starts at its longest matches and ascends in all trees at once until they hold
        `wanted` rows, a row counting once a tree. Matches of a prefix are a run of the sorted array;
        its length is read from running counts of the strings.
        """
        codes = self.hash(np.column_stack([queries, np.zeros(len(queries))]))
        matches = np.zeros((self.bits + 1, len(queries)), np.int64)
        runs = np.zeros(((1 << self.bits) + 1), np.int32)
        for code, own in zip(codes, self.sorted):
            np.cumsum(np.bincount(own, minlength=1 << self.bits), out=runs[1:])
            for depth in range(self.bits + 1):
                shift = self.bits - depth
                low = code >> shift << shift
                matches[depth] += runs[low + (1 << shift)] - runs[low]
        depths = np.maximum(0, (matches >= wanted).sum(0) - 1)
        shift = self.bits - depths
        hit = np.zeros((len(queries), len(self.vectors)), bool)
        flat = hit.reshape(-1)
        base = np.arange(len(queries), dtype=np.int64) * len(self.vectors)
        for code, own, order in zip(codes, self.sorted, self.order):
            low = code >> shift << shift
            a, b = own.searchsorted(low), own.searchsorted(low + (1 << shift))
            n = b - a
            ends = np.cumsum(n)
            at = np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            flat[np.repeat(base, n) + order[at]] = True
        return hit


def top_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of distinct ids, ties to the smaller id."""
    if len(scores) > 4 * k:
        enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k])
    else:
        enough = np.arange(len(scores))
    order = enough[np.lexsort((ids[enough], -scores[enough]))]
    _, first = np.unique(ids[order], return_index=True)
    if len(first) < min(k, len(np.unique(ids))):  # repeated ids filled the places
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def usable(vector: Column) -> Column:
    """No null, non-finite or missing component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    trees: int = 448, bits: int = 14, wanted: int = 10_000, block_rows: int = 4096, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query by inner product.

    Every row is indexed: rows fall by a hash of their id into blocks of about `block_rows`, each with
    a prefix forest of its own, and queries, in chunks of the same size, visit every block. A query's
    candidates are those that share its prefixes where the trees hold `wanted` matches in all, in each
    block its part of that number; the number does not grow with the table. Scores are computed in
    double precision from the vectors as given. A block's best k meet in a ranking by query.

    Cases: rows without id or with an unusable vector take no part; rows that repeat the query's id
    are its own; a repeated id appears once, with its best score; ties go to the smaller id; vectors
    of another length than the query's are not compared with it; an empty table gives no rows;
    columns beyond the two named ones are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))

    data, asked = clean(vectors), clean(queries)
    blocks = max(1, -(-data.count() // block_rows))
    chunks = max(1, -(-asked.count() // block_rows))
    salt = F.xxhash64(F.lit(seed), "id", "v")
    rows = data.select("id", "v", F.size("v").alias("dim"), F.pmod(salt, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    wants = asked.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(salt, F.lit(chunks)).cast("int").alias("chunk"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            ids, x = left.column("id").to_numpy(), _matrix(left, dim)
            forest = PrefixForest(x, trees, bits, seed)
            asked_ids, q = right.column("id").to_numpy(), _matrix(right, dim)
            for at in range(0, len(q), QUERIES):
                hits = forest.candidates(q[at : at + QUERIES], math.ceil(wanted / blocks))
                for i, query in enumerate(asked_ids[at : at + QUERIES].tolist(), at):
                    found = np.flatnonzero(hits[i - at])
                    found = found[ids[found] != query]
                    scores = np.einsum("ij,j->i", x[found], q[i])
                    best = top_k(ids[found], scores, k)
                    out[0] += [query] * len(best)
                    out[1] += ids[found][best].tolist()
                    out[2] += scores[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["dim", "block", "chunk"]
    met = rows.groupBy(*keys).cogroup(wants.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # An id appears at most once a block and query unless its rows differ; keep the best.
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    flat = rows.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
