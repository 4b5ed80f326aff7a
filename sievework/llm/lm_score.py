"""Context-tree weighting over the bytes of tokens, and a unigram score beside it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut, discard, shuffled

SPACE, END = b" ", b"\n"
# Texts are scored in blocks of about so many bytes, and their bytes are looked up in chunks; a
# task's tables are bounded by its block, whatever the corpus.
BLOCK_BYTES = 24 << 20
CHUNK_BYTES = 2 << 20


def stream(text: bytes) -> bytes:
    """A text's symbols: its words, each closed by a space, and the end token."""
    return text + SPACE + END if text else END


def symbol_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of every symbol, its `depth` bytes before it and itself, and where each text starts.

    A text is read as if `depth` spaces stood before it, so its symbols never see another text.
    """
    parts = [SPACE * depth + stream(t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data) - depth
    keys = data[:n].astype(np.int64)
    for k in range(1, depth + 1):
        keys = (keys << 8) | data[k : k + n]
    real = np.ones(len(data), bool)
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return keys[real[depth:]], np.cumsum(sizes - depth) - (sizes - depth)


def chunks(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about CHUNK_BYTES together."""
    begin, used = 0, 0
    for i, t in enumerate(texts):
        used += len(t)
        if used >= CHUNK_BYTES:
            yield slice(begin, i + 1)
            begin, used = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(block, doc_id, held_out, data): lower-cased words joined by spaces, stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, used = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            block, data = [], []
            for text in batch.column(2).cast(pa.binary()):
                words = SPACE.join((text.as_py() or b"").lower().split())
                if used and used + len(words) > BLOCK_BYTES:
                    number, used = number + 1, 0
                used += len(words)
                block.append(base + number)
                data.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["block", "doc_id", "held_out", "data"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col))
    return cut(read.mapInArrow(run, "block long, doc_id long, held_out boolean, data binary"))


def bucket_of(keys, buckets: int):
    """The bucket of symbol keys, in NumPy and in columns alike: a multiplicative hash below 2**31."""
    return keys % 2147483647 * 48271 % 2147483647 % buckets


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: sorted keys and small counts take few bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: bytes, size: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(-1)


ENTRIES = "block long, word binary, n long, bucket long, size long, keys binary, counts binary"


def _entries(blocks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """What each block holds: a row for each distinct word, and its distinct symbol keys packed by bucket.

    Both come with their training counts; a bucket's keys are sorted, so that a block that finds its
    keys again can match values sent to it in that order.
    """
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def keys_of(texts: list[bytes], trained: bool, found: list) -> None:
        for part in chunks(texts):
            keys, n = np.unique(symbol_keys(texts[part], depth)[0], return_counts=True)
            found.append((keys, n if trained else np.zeros(len(n), np.int64)))

    def of_block(block: int, train: Counter, other: set[bytes], found: list) -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in other if w not in train)]
        counts = [*train.values(), *[0] * (len(words) - len(train))]
        nulls, long, binary = pa.nulls, pa.int64(), pa.binary()
        m = len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, block), long), pa.array(words, binary), pa.array(counts, long), nulls(m, long), nulls(m, long), nulls(m, binary), nulls(m, binary)], names=names)
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
        mine = bucket_of(keys, buckets)
        order = np.argsort(mine, kind="stable")
        keys, n, mine = keys[order], n[order], mine[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(mine)) + 1, len(mine)].tolist()
        spans = list(zip(cuts[:-1], cuts[1:]))
        m = len(spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, block), long), nulls(m, binary), nulls(m, long), pa.array(mine[cuts[:-1]], long), pa.array([hi - lo for lo, hi in spans], long),
             pa.array([pack_numbers(keys[lo:hi]) for lo, hi in spans], binary), pa.array([pack_numbers(n[lo:hi]) for lo, hi in spans], binary)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, train, other, found = None, Counter(), set(), []
        for batch in batches:
            block, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                if block[lo] != current:
                    if current is not None:
                        yield from of_block(current, train, other, found)
                    current, train, other, found = int(block[lo]), Counter(), set(), []
                texts = batch.column(2).slice(lo, hi - lo).to_pylist()
                for trained in (True, False):
                    mine = [t for t, h in zip(texts, held[lo:hi]) if h != trained]
                    for t in mine:
                        (train if trained else other).update(t.split(SPACE) if t else [])
                    if mine:
                        train.update([END] * len(mine)) if trained else other.add(END)
                        keys_of(mine, trained, found)
        if current is not None:
            yield from of_block(current, train, other, found)

    return cut(blocks.select("block", "held_out", "data").mapInArrow(run, ENTRIES))


def _pairs(entries: DataFrame) -> DataFrame:
    """(key, n): training counts of the distinct symbol keys of all blocks, added up by bucket."""

    def add(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        keys = [unpack_numbers(k, m, "<i8") for k, m in zip(group.column("keys").to_pylist(), sizes)]
        counts = [unpack_numbers(c, m, "<i8") for c, m in zip(group.column("counts").to_pylist(), sizes)]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        return pa.table([pa.array(distinct), pa.array(n)], names=["key", "n"])

    packed = entries.filter("bucket IS NOT NULL").select("bucket", "size", "keys", "counts")
    return cut(packed.groupBy("bucket").applyInArrow(add, "key long, n long"))


def _values(entries: DataFrame, logp: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, size, packed): the log probabilities of each block's keys in their order."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, lp = right.column("key").to_numpy(), right.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, lp = keys[order], lp[order].astype("<f4")
        found = []
        for k, m in zip(left.column("keys").to_pylist(), left.column("size").to_pylist()):
            found.append(pack_numbers(lp[np.searchsorted(keys, unpack_numbers(k, m, "<i8"))]))
        return pa.table([left.column("block"), left.column("bucket"), left.column("size"), pa.array(found, pa.binary())], names=["block", "bucket", "size", "packed"])

    packed = entries.filter("bucket IS NOT NULL").select("block", "bucket", "size", "keys")
    placed = logp.select(bucket_of(F.col("key"), buckets).alias("bucket"), "key", "logp")
    return packed.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(look, "block long, bucket long, size long, packed binary")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function by Stirling's series at x + 8, to about 1e-13."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def _bits(rows: DataFrame, *keep: str) -> DataFrame:
    """Each byte as its 8 binary decisions: node (1 and the bits so far) and bit."""
    return rows.select(*keep, F.expr(
        "inline(transform(sequence(0, 7), k -> struct(shiftleft(1, k) | shiftright(byte, 8 - k) AS node, shiftright(byte, 7 - k) & 1 AS bit)))"))


def code_lengths(pairs: DataFrame, depth: int) -> DataFrame:
    """(key, logp): log10 probability of a byte after its context for each (key, n) of `pairs`.

    A tree for each of the 255 binary decisions of a byte: from the deepest contexts up, a node's
    weighted probability is the mean of its KT estimate and the product of its children's. Downwards
    the same weights mix the KT predictions of all depths for the frozen counts; a context never seen
    in training (n = 0) adds nothing to the mixture of the contexts above it.
    """
    split = pairs.select("key", "n", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte"))

    def shorter(d: int) -> Column:
        return F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1))

    kt = log_kt(F.col("n0"), F.col("n1"))
    rows = _bits(split, "ctx", "n").groupBy("ctx", "node").agg(
        F.sum(F.expr("if(bit = 0, n, 0L)")).alias("n0"), F.sum(F.expr("if(bit = 1, n, 0L)")).alias("n1"))
    levels = {depth: cut(rows.select("*", F.lit(1.0).alias("share"), kt.alias("weighted")))}
    for d in range(depth - 1, -1, -1):
        rows = levels[d + 1].groupBy(shorter(d).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        rows = rows.withColumn("kt", kt)
        # share: the weight of the node's own estimate against its children's.
        share = 1 / (1 + F.exp(F.least(F.col("below") - F.col("kt"), F.lit(700.0))))
        most = F.greatest("kt", "below")
        mean = most + F.log(F.exp(F.col("kt") - most) + F.exp(F.col("below") - most)) - math.log(2)
        levels[d] = cut(rows.select("ctx", "node", "n0", "n1", share.alias("share"), mean.alias("weighted")))
    state = None
    for d in range(depth + 1):
        n = F.col("n0") + F.col("n1")
        rows = levels[d].select("ctx", "node", "share", n.alias("n"), ((F.col("n1") + 0.5) / (n + 1)).alias("guess"))
        if state is None:
            rows = rows.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "above": F.lit(0.5)})
        else:
            up = state.select(F.col("ctx").alias("up"), "node", "mixed", "rest", F.col("stop").alias("above"))
            rows = rows.withColumn("up", shorter(d - 1)).join(shuffled(up), ["up", "node"]).drop("up")
        seen, before = F.col("n") > 0, state
        state = cut(rows.select(
            "ctx", "node",
            F.when(seen, F.col("mixed") + F.col("rest") * F.col("guess")).otherwise(F.col("above")).alias("stop"),
            F.when(seen, F.col("mixed") + F.col("rest") * F.col("share") * F.col("guess")).otherwise(F.col("above")).alias("mixed"),
            F.when(seen, F.col("rest") * (1 - F.col("share"))).otherwise(0.0).alias("rest")))
        discard(levels[d], *([before] if before else []))
    chance = F.when(F.col("bit") == 1, F.col("stop")).otherwise(1 - F.col("stop"))
    out = cut(_bits(split, "key", "ctx").join(shuffled(state.select("ctx", "node", "stop")), ["ctx", "node"]).groupBy("key").agg(F.sum(F.log10(chance)).alias("logp")))
    discard(state)
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, depth: int = 5) -> DataFrame:
    """Scores of whole texts under models of the rows that are not held out.

    A text is its lower-cased (A-Z) words and one end token. Returns doc_id, held_out, n_tokens,
    n_known (tokens seen in training), train_tokens, base_score (log10 of add-half unigram
    probabilities), score (log10 probability by context-tree weighting over the bytes of the tokens,
    each closed by a space, in contexts of up to `depth` bytes before them, across tokens) and
    bytes_scored, so that -score / log10(2) / bytes_scored is the code length per byte in bits.

    Cases: null and empty texts are the end token alone; null ids are never held out by the default
    rule; repeated rows count each; if nothing is left to train on, known counts are 0 and base_score
    is 0; an empty table gives no rows; columns beyond the two named ones are not read. Word and
    context tables are built by Spark at their full size; a task holds one block of text, or one bucket
    of keys. Code lengths of symbols travel as 32-bit numbers.
    """
    if held_out is None:
        held_out = default_held_out(F.col(id_col))
    blocks = _blocks(docs, id_col, text_col, held_out)
    # Two buckets a block: a bucket's task holds about half as many keys as a block's, at any size.
    buckets = 2 * max(4, blocks.select("block").distinct().count())
    entries = _entries(blocks, depth, buckets)
    words = cut(entries.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, vocabulary = int(total["n"]), int(total["v"])
    logp = code_lengths(_pairs(entries), depth)
    none = F.lit(None)
    tables = entries.filter("word IS NOT NULL").select("block", "word").join(shuffled(words), "word").select(
        "block", "word", F.col("c").alias("size"), none.cast("long").alias("bucket"), none.cast("binary").alias("packed"),
    ).unionByName(_values(entries, logp, buckets).withColumn("word", none.cast("binary")))
    floor = n_train + 0.5 * (vocabulary + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("word").is_valid()
        vocab = right.column("word").filter(is_word).to_pylist()
        counts = right.column("size").filter(is_word).to_numpy()
        sent = sorted(right.filter(pa.compute.invert(is_word)).select(["bucket", "size", "packed"]).to_pylist(), key=lambda r: r["bucket"])
        texts = left.column("data").to_pylist()
        # A chunk's distinct keys are looked up once; its symbols point at them. Both lie in arrays of
        # the block's size that are allotted once, so that chunks leave no gaps in the worker's memory.
        symbols = sum(len(stream(t)) for t in texts)
        place, distinct = np.empty(symbols, np.int32), np.empty(symbols, np.int64)
        looked, used, held = [], 0, 0
        for part in chunks(texts):
            wanted, starts = symbol_keys(texts[part], depth)
            own, at = np.unique(wanted, return_inverse=True)
            place[used : used + len(at)], distinct[held : held + len(own)] = at, own
            looked.append((part, slice(used, used + len(at)), slice(held, held + len(own)), starts))
            used, held = used + len(at), held + len(own)
            del wanted, own, at
        keys = np.unique(distinct[:held])
        lp = np.zeros(len(keys))
        lp[np.argsort(bucket_of(keys, buckets), kind="stable")] = np.concatenate([unpack_numbers(r["packed"], r["size"], "<f4") for r in sent])
        base = np.log10((counts + 0.5) / floor)
        index = {w: i for i, w in enumerate(vocab)}
        sums: list[list[np.ndarray]] = [[], [], [], []]
        for part, here, own, starts in looked:
            lists = [[*(t.split(SPACE) if t else []), END] for t in texts[part]]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            at = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            sums[0].append(sizes)
            sums[1].append(np.add.reduceat((counts[at] > 0).astype(np.int64), first))
            sums[2].append(np.add.reduceat(base[at], first))
            sums[3].append(np.add.reduceat(lp[np.searchsorted(keys, distinct[own])][place[here]], starts))
        sizes, known, unigram, tree = [np.concatenate(x) if x else np.zeros(0) for x in sums]
        lengths = np.fromiter((len(stream(t)) for t in texts), np.int64, len(texts))
        return pa.table([
            left.column("doc_id"), left.column("held_out"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), n_train, np.int64)),
            pa.array(unigram, pa.float64()), pa.array(tree, pa.float64()), pa.array(lengths),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bytes_scored"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes_scored long"
    return blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(score, schema)


def default_held_out(doc_id: Column) -> Column:
    """One row in five: crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1
