"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import min_label_components
from sievework.session import cut, discard

# Words or shingles handled at a time.
BLOCK = 1 << 15
# Parity bits kept of a set, and bits of its signature kept for estimates.
PARITY = 1024
U32, U64 = np.uint32, np.uint64
# Odd factors of the two mixing permutations.
MIX64 = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
MIX32 = (0x7FEB352D, 0x846CA68B)
TURN = (0x9E3779B1, 0x85EBCA77)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `width` words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. Fewer words are one
    shingle; no word gives an empty set. Words are hashed by XXH3, shingles mix the words' hashes.
    """
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for ws in words for w in ws]), ">u8").astype(U64)
    ends = np.cumsum(counts)
    longest = max(0, len(flat) - width + 1)
    mixed = np.full(longest, width, U64)
    for i in range(width):
        mixed = (mixed + flat[i : i + longest]) * U64(MIX64[0])
        mixed ^= mixed >> U64(29)
    mixed = _finish(mixed)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            h = np.sort(mixed[end - n : end - width + 1])
            sets.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif n:
            one = np.full(1, n, U64)
            for w in flat[end - n : end]:
                one = (one + w) * U64(MIX64[0])
                one ^= one >> U64(29)
            sets.append(_finish(one))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _finish(h: np.ndarray) -> np.ndarray:
    h = h * U64(MIX64[1])
    return h ^ (h >> U64(32))


def signatures(sets: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """(sets, size) minima; empty sets get the largest value.

    Elements lie on a circle of 2^32 places. The first permutation, a keyed bijective mix, spreads
    them; the second, also a bijection, is turned by k places for coordinate k. A coordinate is the
    smallest place that the elements of a set take.
    """
    out = np.full((len(sets), size), 0xFFFFFFFF, U32)
    pieces: list[np.ndarray] = []
    owners: list[int] = []
    held = 0
    for i, s in enumerate(sets):
        for at in range(0, len(s), BLOCK):
            pieces.append(s[at : at + BLOCK])
            owners.append(i)
            held += len(pieces[-1])
            if held >= BLOCK:
                _minima(pieces, owners, out, seed)
                pieces, owners, held = [], [], 0
    if pieces:
        _minima(pieces, owners, out, seed)
    return out


def _minima(pieces: list[np.ndarray], owners: list[int], out: np.ndarray, seed: int) -> None:
    h = np.concatenate(pieces)
    starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    x = (h ^ (h >> U64(32))).astype(U32) ^ U32(seed & 0xFFFFFFFF)
    for shift, factor in ((16, MIX32[0]), (15, MIX32[1])):
        x ^= x >> U32(shift)
        x *= U32(factor)
    x ^= x >> U32(16)
    # The turned permutation z -> mix(z - k) starts with a product, so turning is one subtraction.
    x *= U32(TURN[0])
    y, z = np.empty_like(x), np.empty_like(x)
    low = np.empty((out.shape[1], len(starts)), U32)
    for k in range(out.shape[1]):
        np.subtract(x, U32(k * TURN[0] & 0xFFFFFFFF), out=y)
        np.right_shift(y, U32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, U32(TURN[1]), out=y)
        np.minimum.reduceat(y, starts, out=low[k])
    for i, piece in zip(owners, low.T):
        np.minimum(out[i], piece, out=out[i])


def band_hashes(sigs: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands): a 64-bit hash of each band's coordinates and its number."""
    rows = sigs.reshape(len(sigs), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), rows.shape[:2])
    for r in range(rows.shape[2]):
        h = (h + rows[:, :, r]) * U64(MIX64[0])
        h = h ^ (h >> U64(29))
    return _finish(h).view(np.int64)


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of a batch of about BLOCK words, as bytes."""
    texts = batch.column(column).cast(pa.large_binary())
    start, size = 0, 0
    for i in range(batch.num_rows):
        size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if size >= 8 * BLOCK or i + 1 == batch.num_rows:
            yield slice(start, i + 1), [t or b"" for t in texts[start : i + 1].to_pylist()]
            start, size = i + 1, 0


def _key(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def prints(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n, k1, k2, bands) of each text: size and 128-bit hash of its set, its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batches(batch, 1):
                sets = shingle_sets(texts, width)
                hashes = band_hashes(signatures(sets, bands * rows, seed), bands)
                k1, k2 = zip(*map(_key, sets))
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(hashes.ravel()))],
                    names=["doc_id", "n", "k1", "k2", "bands"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, size: int, seed: int) -> DataFrame:
    """(node, n, shingles, sketch, parity) of the classes in `nodes` (node, low, k1, k2).

    The texts of each class's smallest id are read again; of rows that share an id, those of the
    class's own set stay. `sketch` holds the lowest bit of each coordinate, `parity` the parities of
    the set's elements in 1024 cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batches(batch, 3):
                sets = shingle_sets(texts, width)
                own = list(zip(batch.column(1)[part].to_pylist(), batch.column(2)[part].to_pylist()))
                hit = [i for i, s in enumerate(sets) if _key(s) == own[i]]
                sets = [sets[i] for i in hit]
                sketch = np.packbits((signatures(sets, size, seed) & U32(1)).astype(np.uint8), axis=1)
                parity = [np.packbits((np.bincount((s >> U64(20)).astype(np.int64) & PARITY - 1, minlength=PARITY) & 1).astype(np.uint8)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part].take(pa.array(hit, pa.int64())), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array([r.tobytes() for r in parity], pa.binary())],
                    names=["node", "n", "shingles", "sketch", "parity"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(nodes, F.col("doc_id").eqNullSafe(F.col("low")))
    # Rows repeated in full become one before their texts are cut up again.
    once = met.groupBy("node", "k1", "k2", F.xxhash64("text").alias("_text")).agg(F.first("text").alias("text"))
    return once.select("node", "k1", "k2", "text").mapInArrow(run, "node long, n long, shingles array<long>, sketch binary, parity binary")


class Filter:
    """Which pairs of sets may reach the similarity, told from their sketches.

    Parities never err: two sets differ in at least as many elements as their parities in cells, and
    the sizes and that number bound the similarity. The signature's lowest bits estimate it; the
    limit lies six standard deviations beyond what the similarity asked for gives.
    """

    def __init__(self, percent: int, size: int):
        p = (1 - percent / 100) / 2
        self.percent, self.limit = percent, math.floor(size * p + 6 * math.sqrt(size * p * (1 - p)))

    def near(self, one: int, others, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(differing sketch bits, whether the pair may link) of a row with others of `held`."""
        n, sketch, parity = held
        bits = np.bitwise_count(sketch[others] ^ sketch[one]).sum(1, dtype=np.int64)
        apart = np.bitwise_count(parity[others] ^ parity[one]).sum(1, dtype=np.int64)
        total = n[others] + n[one]
        apart = np.maximum(apart, np.abs(n[others] - n[one]))
        return bits, (bits <= self.limit) & (self.percent * (total + apart) <= 100 * (total - apart))


def _held(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, sketch, parity = cols
    wide = lambda c: np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1)
    pad = -wide(sketch).shape[1] % 8
    return n, np.pad(wide(sketch), ((0, 0), (0, pad))).view(U64), wide(parity).view(U64)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that share the first `keys` columns, of sorted batches."""
    rest: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)] if rest else cols
        change = np.zeros(max(0, len(cols[0]) - 1), bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        bounds = np.r_[0, np.flatnonzero(change) + 1].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield [c[a:b] for c in cols]
        rest = [c[bounds[-1] :] for c in cols]
    if rest and len(rest[0]):
        yield rest


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], names=["a", "b"])


def closest_links(rows: DataFrame, judge: Filter, cell: int) -> DataFrame:
    """(a, b): in each bucket a tree of closest neighbours, without the branches that cannot link.

    A bucket of more than `cell` rows is dealt into parts; each grows a tree of its own. The trees only
    save work: `other_links` looks at everything they leave apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, node, *cols in _runs(batches, 2):
            if len(node) < 2:
                continue
            held, found = _held(cols), []
            left, least, by = np.arange(1, len(node)), np.full(len(node), 1 << 30), np.zeros(len(node), np.int64)
            may, at = np.zeros(len(node), bool), 0
            while len(left):
                bits, link = judge.near(at, left, held)
                closer = bits < least[left]
                least[left[closer]], by[left[closer]], may[left[closer]] = bits[closer], at, link[closer]
                k = int(least[left].argmin())
                at = int(left[k])
                left = np.delete(left, k)
                if may[at]:
                    found.append((int(node[by[at]]), int(node[at])))
            yield _pairs(found)

    part = F.when(F.col("members") > cell, F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / cell))).otherwise(0).alias("part")
    dealt = rows.select("bucket", part, "node", "n", "sketch", "parity")
    keys = ["bucket", "part"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long").distinct()


def other_links(rows: DataFrame, judge: Filter, cell: int) -> DataFrame:
    """(a, b): pairs of a bucket that lie in different components and may link.

    In each bucket the rows outside its largest component meet all rows; the largest component is not
    compared with itself. Buckets beyond `cell` become a grid in which every part of the former meets
    every part of the latter.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"))
    mixed = top.filter(F.col("members") > F.col("top.n")).select(
        "bucket", F.col("top.component").alias("largest"),
        F.ceil((F.col("members") - F.col("top.n")) / cell).cast("int").alias("hp"), F.ceil(F.col("members") / cell).cast("int").alias("mp"))
    met = rows.drop("members").join(mixed, "bucket")
    salt = F.xxhash64("node")
    columns = ["component", "n", "sketch", "parity"]
    home = met.filter("component <> largest").select(
        "bucket", F.pmod(salt, F.col("hp")).cast("int").alias("i"), F.explode(F.expr("sequence(0, mp - 1)")).alias("j"), "node", F.lit(True).alias("home"), F.lit(False).alias("top"), *columns)
    member = met.select(
        "bucket", F.explode(F.expr("sequence(0, hp - 1)")).alias("i"), F.pmod(salt, F.col("mp")).cast("int").alias("j"), "node", F.lit(False).alias("home"), (F.col("component") == F.col("largest")).alias("top"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, node, is_home, top, component, *cols in _runs(batches, 3):
            held, found = _held(cols), []
            is_home, top = is_home.astype(bool), top.astype(bool)
            for h in np.flatnonzero(is_home).tolist():
                # Two homes meet twice; the smaller one tells.
                others = np.flatnonzero(~is_home & (component != component[h]) & (top | (node > node[h])))
                if len(others):
                    _, link = judge.near(h, others, held)
                    found += [(int(node[h]), int(v)) for v in node[others[link]]]
            yield _pairs(found)

    keys = ["bucket", "i", "j"]
    cells = home.unionByName(member)
    return cells.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs whose full sets reach the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return met.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select(
        F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85,
    bands: int = 40, rows: int = 8, cell: int = 2_000, seed: int = 7,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents link where 100 * |A & B| >= percent * |A | B| for their sets of distinct shingles of
    `width` words; component_id is the smallest doc_id that links reach, kept marks that document.
    Equal sets become one class first. Classes meet in buckets of equal bands; a pair at exactly the
    similarity misses all of them with probability (1 - J^rows)^bands, 3e-6 as set. Pairs are then
    confirmed on full sets (64-bit hashes of shingles): first those of closest-neighbour trees, then
    every pair still apart that the sketches do not rule out. No bucket is capped.

    Cases: null texts are empty; documents without a word have no shingles and link with nothing, not
    even each other; null ids take the id of their component (null if no member has one) and are not
    kept; rows that share an id but not a text are classes of their own, equal ids do not link them;
    repeated rows share a class, all of the smallest id are kept; an empty table gives no rows;
    columns beyond the two named ones are not read.
    """
    size = bands * rows
    judge = Filter(percent, size)
    found = cut(prints(docs, id_col, text_col, width, bands, rows, seed))
    classes = found.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = cut(spread.join(shared, "bucket"))
    nodes = classes.select("node", "low", "k1", "k2")
    sets = cut(full_sets(docs, nodes.join(met.select("node").distinct(), "node"), id_col, text_col, width, size, seed))
    sketched = cut(met.join(sets.select("node", "n", "sketch", "parity"), "node"))
    tried = cut(closest_links(sketched, judge, cell))
    links = cut(confirmed(tried, sets, percent))
    ends = lambda df: df.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    first = cut(min_label_components(ends(links), links))
    grouped = cut(sketched.join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    apart = cut(other_links(grouped, judge, cell).join(tried, ["a", "b"], "left_anti"))
    more = confirmed(apart, sets, percent)
    part = grouped.select("node", "component").distinct()
    joined = cut(more.join(part.select(F.col("node").alias("src"), F.col("component").alias("s")), "src").join(
        part.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
    last = min_label_components(ends(joined), joined).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    root = part.join(last, "component", "left").select("node", F.coalesce("whole", "component").alias("root"))
    labelled = classes.select("node", "low", "k1", "k2").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = cut(labelled.join(lows, "root").select("k1", "k2", "component_id"))
    discard(classes, met, sets, sketched, tried, links, first, grouped, apart, joined)
    linked = found.filter("n > 0").join(labels, ["k1", "k2"]).select("doc_id", "n", "component_id")
    alone = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
