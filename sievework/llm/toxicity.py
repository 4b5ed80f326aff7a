"""Toxic spans tagged by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain as chain_lists

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.llm.tokens import text_slices
from sievework.session import cut, discard

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18  # hashed features: the model has this size whatever the corpus
AROUND = 12  # words on either side of a training window's middle
WINDOWS = 3  # training windows of a document
EQUALS, STAR = zlib.crc32(b"="), zlib.crc32(b"*")
CUES = 20_000  # units kept to label the tokens of toxic training documents


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: a constant, the word, its beginnings and its ends.

    Each is the CRC of `=word`, `beginning*` or `*end`, continued from the part they share.
    """
    crc, whole = zlib.crc32, word.encode("utf-8", "surrogatepass")
    cut_at = range(len(word) + 1)
    if len(whole) > len(word):
        cut_at = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in word)]).tolist()
    names = [0, crc(whole, EQUALS)]
    begun, at = 0, 0
    for k in range(3, min(6, len(word)) + 1):
        begun, at = crc(whole[at : cut_at[k]], begun), cut_at[k]
        names.append(crc(b"*", begun))
    names += [crc(whole[cut_at[-1 - k] :], STAR) for k in range(3, min(5, len(word)) + 1)]
    return [n % BUCKETS for n in names]


def units(word: str) -> list[str]:
    """What may mark a word as toxic: itself or a beginning of four to six letters."""
    return ["=" + word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Chain:
    """Weights of a two-state chain: emission of `toxic` against `clean`, start and transitions."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    # scores of: start as toxic, clean-toxic, toxic-clean, toxic-toxic (clean-clean is 0)
    links: np.ndarray = field(default_factory=lambda: np.zeros(4))
    # logistic weights over `summary`; None if there was nothing to learn from
    document: np.ndarray | None = None


def marginals(emitted: np.ndarray, lengths: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log ratios and P(toxic) for padded rows sorted by falling length.

    Ratios of toxic to clean are all that two states need, and they stay in range on any length.
    `emitted` holds steps by rows; a step works on the rows that are still running.
    """
    steps, rows = emitted.shape
    start, up, down, stay = links
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right") if steps else np.zeros(0, int)
    ahead, back = np.zeros((steps, rows)), np.zeros((steps, rows))
    if steps:
        ahead[0] = emitted[0] + start
    for t in range(1, steps):
        k = active[t]
        r = ahead[t - 1, :k]
        ahead[t, :k] = emitted[t, :k] + np.logaddexp(up, r + stay) - np.logaddexp(0.0, r + down)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        r = emitted[t + 1, :k] + back[t + 1, :k]
        back[t, :k] = np.logaddexp(down, r + stay) - np.logaddexp(0.0, r + up)
    return ahead, back, 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))


def fit_chain(windows: list[tuple[list[str], list[bool]]], rounds: int = 80, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
    """Maximise the penalised conditional likelihood of labelled token windows by Adam steps."""
    chain = Chain()
    windows = sorted(windows, key=lambda w: -len(w[0]))
    if not windows:
        return chain
    vocabulary: dict[str, int] = {}
    lengths = np.array([len(w) for w, _ in windows])
    steps, rows = int(lengths.max()), len(windows)
    word_at, wanted = np.zeros((steps, rows), np.int64), np.zeros((steps, rows))
    for j, (tokens, marks) in enumerate(windows):
        word_at[: len(tokens), j] = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens]
        wanted[: len(tokens), j] = marks
    real = np.arange(steps)[:, None] < lengths[None, :]
    lists = [features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.concatenate([np.array(x, np.int64) for x in lists])
    used, slot = np.unique(feature, return_inverse=True)
    both = real[1:]
    before, after = wanted[:-1], wanted[1:]
    seen = np.array([wanted[0].sum(), ((1 - before) * after * both).sum(), (before * (1 - after) * both).sum(), (before * after * both).sum()])
    theta = np.zeros(len(used) + 4)
    theta[-4:] = (-3.0, -3.0, 0.0, 0.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        words = np.bincount(owner, weights=theta[slot], minlength=len(lists))
        links = theta[-4:]
        emitted = np.where(real, words[word_at], 0.0)
        ahead, back, p = marginals(emitted, lengths, links)
        gap = np.where(real, wanted - p, 0.0)
        by_word = np.bincount(word_at.ravel(), weights=gap.ravel(), minlength=len(lists))
        # Pair marginals against clean-clean, then normalised.
        r, q = ahead[:-1], emitted[1:] + back[1:]
        logs = np.stack([links[1] + q, r + links[2], r + links[3] + q])
        norm = np.logaddexp(0.0, np.logaddexp(logs[0], np.logaddexp(logs[1], logs[2])))
        expected = (np.exp(logs - norm) * both).sum(axis=(1, 2))
        grad = np.concatenate([np.bincount(slot, weights=by_word[owner], minlength=len(used)), seen - np.concatenate([[p[0].sum()], expected])])
        grad = grad / rows - ridge * 1e-1 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    chain.emission[used] = theta[:-4]
    chain.links = theta[-4:].copy()
    return chain


def summary(total: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns for the document's logistic score: expected toxic words, the surest one, their share."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), np.log(total + 0.02), most, np.log(total / n + 1e-3), np.log(n)], axis=1)


def fit_document(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; calibrates scores on documents the chain did not see."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


class Tagger:
    """Applies a chain to texts; emissions of words are kept in two tables of at most `room` words.

    When the newer table is full it becomes the older one, so words in use are not worked out again.
    """

    def __init__(self, chain: Chain, room: int = 250_000):
        self.chain, self.room, self.newer, self.older = chain, room, {}, {}

    def emission(self, words: list[str]) -> np.ndarray:
        if len(self.newer) > self.room:
            self.newer, self.older = {}, self.newer
        table, older, new = self.newer, self.older, []
        for w in set(words):
            if w not in table:
                known = older.get(w)
                if known is None:
                    new.append(w)
                else:
                    table[w] = known
        if new:
            lists = [features(w) for w in new]
            starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
            table.update(zip(new, np.add.reduceat(self.chain.emission[list(chain_lists.from_iterable(lists))], starts).tolist()))
        return np.fromiter(map(table.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of every word of every text."""
        lists = [[w.lower() for w in WORD.findall(t)] for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(lists[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        at = 0
        while at < len(order):
            longest = max(1, len(lists[order[at]]))
            # Rows of like length together, so that padding at most doubles the words.
            upto = at + 1
            while upto < len(order) and 2 * len(lists[order[upto]]) >= longest:
                upto += 1
            part = order[at:upto]
            lengths = np.array([len(lists[i]) for i in part])
            emitted = np.zeros((int(lengths.max()), len(part)))
            for j, i in enumerate(part):
                emitted[: lengths[j], j] = self.emission(lists[i])
            p = marginals(emitted, lengths, self.chain.links)[2]
            for j, i in enumerate(part):
                out[i] = p[: lengths[j], j].copy()
            at = upto
        return out


_TAGGERS: list[Tagger] = []


def tagger_of(chain: Chain) -> Tagger:
    """One tagger per worker process, as long as the chain stays the same."""
    if not _TAGGERS or _TAGGERS[0].chain is not chain:
        _TAGGERS[:] = [Tagger(chain)]
    return _TAGGERS[0]


def spans_of(text: str, p: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Offsets (code points, end exclusive) of the runs of words that are likelier toxic than not."""
    hot = p >= threshold
    if not hot.any():
        return []
    out: list[tuple[int, int]] = []
    joins = False
    for flag, m in zip(hot.tolist(), WORD.finditer(text)):
        if flag and joins:
            out[-1] = (out[-1][0], m.end())
        elif flag:
            out.append((m.start(), m.end()))
        joins = flag
    return out


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def signature(words: list[str]) -> int:
    """The least hash of a text's three-word shingles: copies and most near copies share it."""
    if len(words) < 3:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(map(xxhash.xxh64_intdigest, map(" ".join, zip(words, words[1:], words[2:])))) >> 1


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, seed: int) -> DataFrame:
    """(sig, text, y): about `max_rows` labelled texts at most, one for each group of copies.

    The rows are chosen by a hash of the id. A document with several labels is toxic if one says so.
    """
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    n = named.count()
    share = min(1.0, max_rows / max(1, n))
    chosen = named.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 1) <= F.lit(min(2**63 - 1, int(share * 2**53) << 10)))
    # About `max_rows` pairs of numbers, a bound that does not grow with the tables.
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signature([w.lower() for w in WORD.findall(t)]) for t in _strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), batch.column(0), batch.column(1)], names=["sig", "text", "y"])

    signed = found.select("text", F.col("_y").alias("y")).mapInArrow(sign, "sig long, text string, y int")
    best = F.max_by("text", F.struct("y", F.length("text"), F.xxhash64("text")))
    return cut(signed.groupBy("sig").agg(best.alias("text"), F.max("y").alias("y")))


def find_cues(sample: DataFrame) -> set[str]:
    """Units far commoner in toxic than in clean documents of the sample (each counted once a document)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(_strings(batch.column(0)), batch.column(1).to_pylist()):
                words = {w.lower() for w in WORD.findall(text)}
                counts[1 if y else 0].update({u for w in words for u in units(w)} | {"#"})
        for y, c in enumerate(counts):
            rows = list(c.items())
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([n * y for _, n in rows], pa.int64()), pa.array([n * (1 - y) for _, n in rows], pa.int64())], names=["unit", "toxic", "clean"])

    counted = sample.select("text", "y").mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.filter("toxic >= 4")  # the marker of all documents is among them
    rows = kept.orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), "unit").limit(CUES).collect()
    totals = counted.filter("unit = '#'").first()
    if totals is None or not totals["toxic"]:
        return set()
    toxic, clean = totals["toxic"], max(1, totals["clean"])
    cues = set()
    for row in rows:
        a, b = row["toxic"], row["clean"]
        rate, pooled = (b + 0.5) / (clean + 1), (a + b) / (toxic + clean)
        spread = (pooled * (1 - pooled) * (1 / toxic + 1 / clean)) ** 0.5
        if row["unit"] != "#" and a / toxic > 5 * rate and spread > 0 and (a / toxic - b / clean) / spread > 5:
            cues.add(row["unit"])
    return cues


def training_windows(sample: DataFrame, cues: set[str]) -> list[tuple[list[str], list[bool]]]:
    """Token windows of the sample with labels: cue words of toxic documents are toxic, all else clean."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sig, text, y in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), batch.column(2).to_pylist()):
                words = [w.lower() for w in WORD.findall(text)]
                marks = [any(u in cues for u in units(w)) for w in words]
                hits = [i for i, m in enumerate(marks) if m]
                spots = hits[:: max(1, len(hits) // WINDOWS)][: WINDOWS - 1] + ([sig % len(words)] if words else [])
                last = -1
                for i in sorted(spots):
                    lo, hi = max(last + 1, i - AROUND), min(len(words), i + AROUND + 1)
                    if lo < hi:
                        rows.append((sig, lo, words[lo:hi], [m and y == 1 for m in marks[lo:hi]]))
                        last = hi - 1
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.bool_()))],
                names=["sig", "lo", "words", "marks"])

    rows = sample.select("sig", "text", "y").mapInArrow(windows_of, "sig long, lo int, words array<string>, marks array<boolean>").collect()
    return [(list(r["words"]), list(r["marks"])) for r in sorted(rows, key=lambda r: (r["sig"], r["lo"]))]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 16_000, seed: int = 11,
) -> Chain:
    """A chain and its document score, fitted on a sample of at most about `max_rows` labelled rows.

    Labels tell documents, so tokens are labelled through them: in toxic documents the words marked by
    a cue (a word or beginning of words far commoner in toxic documents), elsewhere none. Three
    quarters of the sample train the chain, the rest calibrates the document score. Copies count once.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, seed)
    apart = F.pmod(F.xxhash64("sig"), F.lit(4)) == 0
    parts = [sample.filter(~apart), sample.filter(apart)]
    cues = find_cues(parts[0])
    if not cues:
        discard(sample)
        return Chain()
    chain = fit_chain(training_windows(parts[0], cues))
    rows = summaries(parts[1], chain, "text", ["y"]).select("y", "_toxic_total", "_toxic_most", "_toxic_words").collect()
    discard(sample)
    if not any(r["y"] for r in rows):
        return chain
    rows.sort(key=tuple)
    data = np.array([tuple(r) for r in rows], np.float64)
    chain.document = fit_document(summary(data[:, 1], data[:, 2], data[:, 3]), (data[:, 0] > 0).astype(float))
    return chain


ADDED = "_toxic_total double, _toxic_most double, _toxic_words long, _toxic_score double, _toxic_spans string"


def summaries(docs: DataFrame, chain: Chain, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """Every row with the columns of ADDED: expected toxic words, the surest, words, score and spans.

    Only the columns of `keep` come back with them (all if not given).
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    docs = docs.drop(*added)
    if keep is not None:
        docs = docs.select(*[n for n in docs.columns if n in (*keep, text_col)])
    fields = docs.schema.fieldNames()
    at = fields.index(text_col)
    kept = [i for i, n in enumerate(fields) if keep is None or n in keep]
    docs = docs.toDF(*[f"c{i}" for i in range(len(fields))])  # names with dots do not pass mapInArrow
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(model.value)
        for batch in batches:
            for part in text_slices(batch.column(at)):
                own = batch.slice(part.start, part.stop - part.start)
                mine = _strings(own.column(at))
                tagged = tagger.tag(mine)
                total = np.array([p.sum() for p in tagged])
                most = np.array([p.max() if len(p) else 0.0 for p in tagged])
                n = np.array([len(p) for p in tagged])
                if model.value.document is None:
                    score = np.zeros(len(mine))
                else:
                    score = 1 / (1 + np.exp(-np.clip(summary(total, most, n) @ model.value.document, -30, 30)))
                spans = [",".join(f"{a}:{b}" for a, b in spans_of(t, p)) for t, p in zip(mine, tagged)]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i) for i in kept), pa.array(total), pa.array(most), pa.array(n, pa.int64()), pa.array(score), pa.array(spans, pa.string())], names=[*(f"c{i}" for i in kept), *added])

    schema = StructType([docs.schema.fields[i] for i in kept])
    for piece in ADDED.split(", "):
        name, kind = piece.split()
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema).toDF(*[fields[i] for i in kept], *added)


def score_documents(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with `_toxic_score` (0 to 1), `_toxic_spans` and the sums behind them.

    The model learns from labels whose row passes `train_on`, a condition over `id_col` (all rows if
    not given). `_toxic_spans` lists start:end in code points of runs of words whose forward-backward
    marginal is at least one half.

    Cases: null texts are empty and score like documents without toxic words; null ids and null labels
    are not learned from but scored; repeated rows are scored each and learned from once; without a
    toxic label to learn from, or without words that tell, every score is 0; an empty table gives no
    rows. Texts are tagged whole, whatever their length. Columns of the names added are replaced.
    """
    used = labels if train_on is None else labels.filter(train_on)
    return summaries(docs, fit(docs, used, id_col, text_col, label_col, max_rows), text_col, keep)


def default_held_out(doc_id: Column) -> Column:
    """One row in four: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxic_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`score_documents` that learns from the rows not held out, with held_out, score and predicted."""
    scored = score_documents(docs, labels, ~default_held_out(F.col("doc_id")), keep=keep)
    return scored.withColumns({"_toxic_held_out": default_held_out(F.col("doc_id")), "_toxic_predicted": (F.col("_toxic_score") >= 0.3).cast("int")})
