"""SimHash near-duplicates found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.components import min_label_components
from sievework.session import cut, shuffled

# Hashes whose bits are counted at a time, so that a very long text needs no more memory.
BLOCK = 1 << 15


def simhash64(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without a word.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles count as
    often as they occur. A text of fewer words is one shingle. A tie of votes gives 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * votes > len(starts)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, row_hash, fp): the fingerprint of each whole text as a long of the same 64 bits.

    Null texts are empty; row_hash is a hash of all columns and tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(t.as_py() or b"", shingle, seed) for t in batch.column(1).cast(pa.binary())]
            signed = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, batch.column(2)], names=["doc_id", "fp", "row_hash"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), row_hash(docs).alias("row_hash"))
    return read.mapInArrow(run, "doc_id long, fp long, row_hash long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which have no hash, go in as JSON text."""
    def plain(field: T.StructField) -> Column:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        return F.to_json(F.struct(value.alias("x"))) if "map<" in field.dataType.simpleString() else value

    return F.xxhash64(*[plain(f) for f in docs.schema.fields])


def anchor_rows(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home): every anchor within radius 2 of either 31-bit part of a fingerprint.

    Anchors are the code words of the perfect Hamming code of length 31: its covering radius is 1, so
    each part has one anchor within 1 (its home). Of two parts of fingerprints that differ in at most
    3 bits, one differs in at most 1, so the other fingerprint lies within 1 + 1 of that home. Code
    words within 2 follow from the syndrome s: the home, and one for each pair of places with i ^ j = s.
    """
    rows = []
    for part in (0, 1):
        x = F.shiftrightunsigned("fp", 31 * part).bitwiseAND(F.lit((1 << 31) - 1))
        rows.append(fps.select("fp", x.alias("x"), F.lit(part).alias("part")))
    parts = rows[0].unionByName(rows[1])
    syndrome: Column = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        parity = F.bit_count(F.col("x").bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
        syndrome = syndrome + F.shiftleft(parity, j)
    found = parts.withColumn("s", syndrome.cast("int"))
    home = F.expr("CASE WHEN s = 0 THEN x ELSE x ^ shiftleft(1L, s - 1) END")
    others = F.expr(
        "transform(filter(sequence(1, 31), i -> i < (i ^ s) AND i <> s),"
        " i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    )
    tagged = found.select("fp", "part", F.posexplode(F.concat(F.array(home), others)).alias("pos", "word"))
    anchor = F.shiftleft(F.col("part").cast("long"), 31).bitwiseOR(F.col("word"))
    return tagged.select(anchor.alias("anchor"), "fp", (F.col("pos") == 0).alias("home"))


def spanning_links(homes: np.ndarray, members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph home - member at `max_bits` or fewer differing bits.

    Both arrays are sorted unsigned 64-bit fingerprints; homes may be among the members. Each
    fingerprint is expanded once against those not yet reached, so a dense group of G near copies
    costs about G steps and gives G - 1 links.
    """
    is_home = dict.fromkeys(homes.tolist(), True)
    left, left_homes = np.union1d(homes, members), homes
    links: list[tuple[int, int]] = []
    for root in homes.tolist():
        if not is_home[root]:
            continue
        queue = [root]
        is_home[root] = False
        left = left[left != root]
        left_homes = left_homes[left_homes != root]
        while queue:
            f = queue.pop()
            pool = left if f in is_home else left_homes
            near = np.bitwise_count(pool ^ np.uint64(f)) <= max_bits
            if not near.any():
                continue
            new = pool[near]
            links += [(f, g) for g in new.tolist()]
            queue += new.tolist()
            for g in new.tolist():
                if g in is_home:
                    is_home[g] = False
            if pool is left:
                left = left[~near]
                left_homes = left_homes[~np.isin(left_homes, new)]
            else:
                left_homes = left_homes[~near]
                left = left[~np.isin(left, new)]
    return links


def links(fps: DataFrame, max_bits: int = 3, cell: int = 20_000) -> DataFrame:
    """(src, dst): links between distinct fingerprints, enough to connect all that are within reach.

    At an anchor its homes are compared with all fingerprints there. An anchor with more than `cell`
    rows is split into a grid of parts of its homes and parts of its members; every part of one meets
    every part of the other, so no comparison is lost.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two parts and radius 1 cover up to 3 differing bits")
    rows = anchor_rows(fps)
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    hot = counts.filter(F.col("n") > cell).select(
        "anchor", F.ceil(F.col("h") / cell).cast("int").alias("hp"), F.ceil(F.col("n") / cell).cast("int").alias("mp")
    )
    # At most one row for each `cell` rows. Without the hint Spark may broadcast the anchors, which it sizes
    # as if a fingerprint had one.
    spread = rows.join(F.broadcast(cut(hot)), "anchor", "left")
    normal = spread.filter("mp IS NULL").select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home", F.lit(True).alias("member"))
    split = spread.filter("mp IS NOT NULL AND hp > 0")
    salt = F.xxhash64("fp")
    as_home = split.filter("home").select(
        "anchor", F.pmod(salt, F.col("hp")).cast("int").alias("i"), F.explode(F.expr("sequence(0, mp - 1)")).alias("j"), "fp",
        F.lit(True).alias("home"), F.lit(False).alias("member"))
    as_member = split.select(
        "anchor", F.explode(F.expr("sequence(0, hp - 1)")).alias("i"), F.pmod(salt, F.col("mp")).cast("int").alias("j"), "fp",
        F.lit(False).alias("home"), F.lit(True).alias("member"))
    cells = normal.unionByName(as_home).unionByName(as_member)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell; the cell that a batch ends in goes on in the next.
        rest: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            whole = [np.concatenate([a, b]) for a, b in zip(rest, cols)] if rest else cols
            new = np.flatnonzero((np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0) | (np.diff(whole[2]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield _links_of([c[:last] for c in whole], new[:-1], max_bits)
            rest = [c[last:] for c in whole]
        if rest:
            yield _links_of(rest, np.zeros(0, np.int64), max_bits)

    order = ["anchor", "i", "j"]
    return cells.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(compare, "src long, dst long")


def _links_of(cols: list[np.ndarray], starts: np.ndarray, max_bits: int) -> pa.RecordBatch:
    fps, home, member = cols[3].astype(np.int64).view(np.uint64), cols[4].astype(bool), cols[5].astype(bool)
    bounds = np.r_[0, starts, len(fps)].astype(np.int64)
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
        s = slice(bounds[k], bounds[k + 1])
        homes = np.unique(fps[s][home[s]])
        if len(homes):
            out += spanning_links(homes, np.unique(fps[s][member[s]]), max_bits)
    both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["src", "dst"])


def components_of(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, n, component_id): each distinct fingerprint with its rows and the smallest doc_id it reaches."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    found = cut(links(classes.select("fp"), max_bits).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    nodes = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = min_label_components(nodes, found).select(F.col("id").alias("fp"), "component")
    labelled = classes.join(shuffled(roots), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return labelled.join(shuffled(lows), "root").select("fp", "n", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Fingerprints link at `max_bits` or fewer differing bits; component_id is the smallest doc_id that
    links reach. Cases: null and empty texts have fingerprint zero and link like any other; null ids
    get the id of their component (null if no member has one); repeated rows stay; an empty table
    gives no rows; columns beyond the two named ones are not read. Equal fingerprints are merged
    before anything is compared, so exact copies cost one comparison.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    labels = components_of(fps, max_bits).select("fp", "component_id")
    return fps.join(shuffled(labels), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """The rows of one document of each component: the one with the smallest id.

    Where rows repeat that id, the smallest by a hash of the row stays, once. Components without any
    id keep one row too. All columns come back as they were, whatever their names and types.
    """
    own = docs.columns
    # Columns beside the id and the text go under fresh names meanwhile, so none clashes with a helper.
    docs = docs.toDF(*[n if n in (id_col, text_col) else f"column_{i}" for i, n in enumerate(own)])
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    labels = components_of(fps, max_bits).select("fp", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("first")
    # Rows are reduced to one a fingerprint before the join, so a hot fingerprint is one row there.
    per_class = fps.groupBy("fp").agg(first).join(shuffled(labels), "fp")
    group = [F.col("component_id").isNull(), F.coalesce("component_id", "fp")]
    kept = per_class.groupBy(*group).agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_kept_id"), F.col("first.row_hash").alias("_kept_hash"))
    names = docs.columns
    marked = docs.withColumn("_hash", row_hash(docs))
    same = (F.col("_hash") == F.col("_kept_hash")) & F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id"))
    return marked.join(shuffled(kept), same, "left_semi").dropDuplicates(["_hash", id_col]).select(*["`" + n.replace("`", "``") + "`" for n in names]).toDF(*own)
