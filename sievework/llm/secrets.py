"""Secrets in whole texts: fixed patterns, and a character convolutional network over all other candidates."""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.llm.tokens import text_slices

# The base patterns, in the order of their kinds; the ASCII flag keeps case folding to A-Z.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# What the network judges: runs of token characters with a digit, or of mixed case beyond a capital.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
BEFORE, INSIDE, AFTER = 24, 64, 8  # characters of a window; long candidates take several windows
WIDTH, EMBED, FILTERS = 5, 8, 24
CLASSES = 100  # printable ASCII, other letters, other characters, line breaks, padding


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters that no base span touches."""
    out, i = [], 0
    ends = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and ends[i] <= a:
            i += 1
        if (i < len(base) and base[i][0] < b) or not MIXED.search(m.group()):
            continue
        out.append((a, b))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows that together hold the whole candidate, each with the text before and after it."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    out = []
    for at in range(start, end, INSIDE):
        lo = at if end - at >= 16 or at == start else max(start, end - INSIDE)  # no short rest alone
        out.append(before.rjust(BEFORE, "\0") + text[lo : min(end, lo + INSIDE)].ljust(INSIDE, "\0") + after.ljust(AFTER, "\0"))
    return out


TABLE = np.full(0x110000, 96, np.uint8)  # other characters
TABLE[32:127] = np.arange(95)
TABLE[0xC0:0x250] = 95  # other letters of Latin scripts
TABLE[[9, 10, 13]] = 97
TABLE[0] = 98


def encode(wins: list[str]) -> np.ndarray:
    """Character classes of windows, one row each."""
    codes = np.frombuffer("".join(wins).encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[codes].reshape(len(wins), BEFORE + INSIDE + AFTER)


@dataclass
class Network:
    """Embedding, one convolution, maxima and means inside the candidate and before it, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    threshold: float = 2.0
    slope: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.5, (CLASSES, EMBED)), rng.normal(0, 0.25, (WIDTH * (EMBED + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS + 1))

    def parts(self, x: np.ndarray) -> tuple:
        n, size = x.shape
        place = np.zeros((n, size, 1))
        place[:, BEFORE : BEFORE + INSIDE, 0] = 1.0
        seen = np.concatenate([self.embed[x], place], axis=2)
        unrolled = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, size - WIDTH + 1, -1)
        conv = np.maximum(unrolled @ self.kernel + self.bias, 0.0)
        inside = conv[:, BEFORE - 2 : BEFORE + INSIDE - 2]
        real = (x[:, BEFORE : BEFORE + INSIDE] != 98)[:, :, None]
        held = inside * real
        ahead = conv[:, : BEFORE - 2]
        length = real.sum(1)
        pooled = np.concatenate([held.max(1), held.sum(1) / length, ahead.max(1), np.ones((n, 1))], axis=1)
        return unrolled, conv, held, real, length, ahead, pooled

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.parts(x[i : i + 512])[-1] @ self.out for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        a, b = self.slope
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        unrolled, conv, held, real, length, ahead, pooled = self.parts(x)
        n = len(x)
        gap = (1 / (1 + np.exp(-np.clip(pooled @ self.out, -30, 30))) - y) / n
        back = gap[:, None] * self.out[None, :]
        d = np.zeros_like(conv)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        d[rows, held.argmax(1) + BEFORE - 2, cols] += back[:, :FILTERS]
        d[:, BEFORE - 2 : BEFORE + INSIDE - 2] += real * (back[:, FILTERS : 2 * FILTERS] / length)[:, None, :]
        d[rows, ahead.argmax(1), cols] += back[:, 2 * FILTERS : 3 * FILTERS]
        d *= conv > 0
        flat = d.reshape(-1, FILTERS)
        kernel = unrolled.reshape(len(flat), -1).T @ flat
        seen = (flat @ self.kernel.T).reshape(n, conv.shape[1], WIDTH, EMBED + 1)[..., :EMBED]
        embed = np.zeros_like(self.embed)
        for k in range(WIDTH):
            at = x[:, k : k + conv.shape[1]].ravel()
            values = seen[:, :, k].reshape(-1, EMBED)
            for e in range(EMBED):
                embed[:, e] += np.bincount(at, weights=values[:, e], minlength=CLASSES)
        return [embed, kernel, flat.sum(0), pooled.T @ gap]


def train(found: list[tuple[str, int]], recall: float = 0.95, epochs: int = 6, batch: int = 64, seed: int = 3) -> Network:
    """Fit on labelled windows; Platt scaling and the threshold come from a fifth that is kept apart.

    The threshold is the highest calibrated chance, one half at least, that still finds the share
    `recall` of the secrets kept apart; if one half finds fewer, it is lowered until they are found.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(found))
    x, y = encode([found[i][0] for i in order]), np.array([found[i][1] for i in order], float)
    kept = len(x) // 5
    net = Network.fresh(seed)
    weights = [net.embed, net.kernel, net.bias, net.out]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(np.arange(kept, len(x))), max(1, (len(x) - kept) // batch)):
            step += 1
            for w, g, a, b in zip(weights, net.gradients(x[part], y[part]), first, second):
                g = g + 1e-4 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    z, t = net.logits(x[:kept]), y[:kept]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        design = np.stack([z, np.ones_like(z)], 1)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, design.T @ (t - p) - 1e-2 * np.array([a - 1.0, b]))
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    net.slope = (a, b)
    chances = np.sort(net.chances(x[:kept])[t > 0])
    at = float(chances[int((1 - recall) * len(chances))]) if len(chances) else 2.0
    net.threshold = max(0.5, min(at, 0.9)) if at >= 0.5 else at
    return net


def invented(count: int, seed: int) -> list[tuple[str, int]]:
    """Labelled candidates from a seeded generator, half secrets of common formats, half look-alikes."""
    rng = np.random.default_rng(seed)

    def pick(letters: str, n: int) -> str:
        return "".join(rng.choice(list(letters), n))

    alnum, digits, low = string.ascii_letters + string.digits, string.digits, string.ascii_lowercase
    secret = [
        lambda: pick("0123456789ABCDEF", int(rng.integers(32, 65))), lambda: pick(alnum, int(rng.integers(20, 65))),
        lambda: base64.b64encode(rng.bytes(int(rng.integers(18, 60)))).decode(), lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk-" + pick(alnum, int(rng.integers(24, 49))), lambda: f"xoxb-{pick(digits, 11)}-{pick(alnum, 24)}",
        lambda: "eyJ" + pick(alnum + "_-", 30) + "." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 43), lambda: pick("0123456789abcdef", 31),
    ]
    syllables = ["the", "er", "ing", "tion", "an", "re", "lich", "ge", "ment", "eau", "que", "cion", "osa", "ado"]

    def word(n: int) -> str:
        return "".join(rng.choice(syllables, n))

    plain = [
        lambda: pick(digits, int(rng.integers(16, 24))), lambda: f"{word(2)}.{pick(digits, 2)}", lambda: ".".join(word(2) for _ in range(4)) + pick(digits, 1),
        lambda: "/" + "/".join(word(2) for _ in range(3)) + f"/{pick(digits, 4)}", lambda: f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}.{pick(digits, 6)}",
        lambda: word(4).capitalize() + word(3).capitalize() + word(2).capitalize(), lambda: "_".join(word(2) for _ in range(3)) + "_" + pick(digits, 2),
        lambda: "-".join(pick(digits, 4) for _ in range(4)), lambda: f"{word(3)}-{word(3)}.{word(1)}{pick(digits, 1)}.html", lambda: "=" * int(rng.integers(16, 40)) + pick(digits, 1),
        lambda: pick(digits, 3) + "." + pick(digits, 3) + "." + pick(digits, 3) + "." + pick(digits, 4), lambda: f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 1)}-{word(3)}-{pick(low, 3)}{pick(digits, 2)}",
    ]
    leads = ["", "key: ", "Authorization: Bearer ", "export AUTH=\"", f"{word(2)} {word(1)} ", "see ", "(", "credential '"]
    out = []
    for i in range(count):
        value = (secret if i % 2 == 0 else plain)[int(rng.integers(len(secret if i % 2 == 0 else plain)))]()
        text = f"{word(3)} {word(2)}. {leads[int(rng.integers(len(leads)))]}"
        whole = f"{text}{value} {word(2)}"
        out += [(w, int(i % 2 == 0)) for w in windows(whole, len(text), len(text) + len(value))]
    return out


def findings(docs: DataFrame, text_col: str, max_docs: int, seed: int) -> list[tuple[str, int]]:
    """Labelled windows of a hashed sample of about `max_docs` texts: base values, and what is none.

    Candidates outside base spans count as no secrets. Up to four windows of a finding are taken, and at
    most a quarter of `max_docs` windows of a label are kept, those of the smallest hash.
    """
    n = docs.count()
    share = min(1.0, max_docs / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for t in batch.column(0).to_pylist():
                base = base_spans(t)
                for a, b, kind in base:
                    if kind == 0:
                        a = b - len(ASSIGN.match(t, a).group(2))
                    rows |= {(w, 1) for w in windows(t, a, b)[:4]}
                for a, b in candidates(t, base):
                    rows |= {(w, 0) for w in windows(t, a, b)[:4]}
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32())], names=["window", "y"])

    text = F.col(text_col)
    # A millionth of the texts for each slot, and a finer hash for the fraction of a slot that is left.
    slots = int(share * 1_000_000)
    slot = F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(1_000_000))
    finer = F.pmod(F.xxhash64(F.lit(seed + 1), "t"), F.lit(1 << 40)) < int((share * 1_000_000 - slots) * (1 << 40))
    chosen = docs.filter(text.isNotNull()).select(text.alias("t")).filter((slot < slots) | ((slot == slots) & finer))
    rows = chosen.mapInArrow(run, "window string, y int").distinct()
    ranked = rows.withColumn("h", F.xxhash64(F.lit(seed), "window"))
    out = []
    for y in (0, 1):
        out += [(r["window"], y) for r in ranked.filter(F.col("y") == y).orderBy("h", "window").limit(max_docs // 4).collect()]
    return out


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 8000, made: int = 3000, recall: float = 0.95, seed: int = 3) -> Network:
    """A network trained on findings of a sample of about `max_docs` texts and `made` invented ones."""
    return train(findings(docs, text_col, max_docs, seed) + invented(made, seed), recall, seed=seed)


ADDED = "_n_assign long, _n_access long, _n_hex long, _n_learned long, _base_sha256 string, _spans string, _redacted string"
BLOCK = 4096  # windows judged at a time


def scan(docs: DataFrame, net: Network, text_col: str = "text", redact: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row with the columns of ADDED; `_redacted` is the text with all spans replaced, or null.

    Only the columns of `keep` come back with them (all if not given).
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    docs = docs.drop(*added)
    if keep is not None:
        docs = docs.select(*[n for n in docs.columns if n in (*keep, text_col)])
    names = docs.columns
    at = names.index(text_col)
    kept = [i for i, n in enumerate(names) if keep is None or n in keep]
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots do not pass mapInArrow
    model = docs.sparkSession.sparkContext.broadcast(net)

    def learned(texts: list[str], bases: list[list]) -> list[list[tuple[int, int, int]]]:
        """Candidates that pass the threshold, by text; each distinct window is judged once."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, int, int, list[str]]] = []
        size = 0

        def judge() -> None:
            distinct = list(dict.fromkeys(w for *_, ws in held for w in ws))
            chance = dict(zip(distinct, model.value.chances(encode(distinct)).tolist())) if distinct else {}
            for i, a, b, ws in held:
                if max(chance[w] for w in ws) >= model.value.threshold:
                    out[i].append((a, b, 3))
            held.clear()

        for i, (t, base) in enumerate(zip(texts, bases)):
            for a, b in candidates(t, base):
                held.append((i, a, b, windows(t, a, b)))
                size += len(held[-1][3])
                if size >= BLOCK:
                    judge()
                    size = 0
        judge()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(at)):
                own = batch.slice(part.start, part.stop - part.start)
                texts = [t or "" for t in own.column(at).to_pylist()]
                bases = [base_spans(t) for t in texts]
                counts = np.array([[sum(k == kind for *_, k in b) for kind in range(3)] for b in bases], np.int64).reshape(len(texts), 3)
                more = learned(texts, bases)
                spans = [b + m for b, m in zip(bases, more)]
                clean = [cover(t, s, redact) for t, s in zip(texts, spans)] if redact is not None else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i) for i in kept), *(pa.array(counts[:, k].copy()) for k in range(3)), pa.array([len(m) for m in more], pa.int64()),
                     pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b in bases], pa.string()), pa.array([join_spans(s) for s in spans], pa.string()), pa.array(clean, pa.string())],
                    names=[*(f"c{i}" for i in kept), *added])

    schema = StructType([docs.schema.fields[i] for i in kept])
    for piece in ADDED.split(", "):
        schema = schema.add(*piece.split())
    return docs.mapInArrow(run, schema).toDF(*[names[i] for i in kept], *added)


def cover(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by `mark`."""
    out, done = [], 0
    for a, b, _ in sorted(spans):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, text_col: str = "text", redact: str | None = None, max_docs: int = 8000, keep: list[str] | None = None) -> DataFrame:
    """Every row with counts of base spans by kind, a digest of them, all spans, and the redacted text.

    Base spans always stay; candidates elsewhere are added where the network's calibrated chance
    passes its threshold, over whole texts. Offsets are code points, ends exclusive; an assignment
    spans its name and value.

    Cases: a null text counts as empty (no spans; redacted to the empty text); very long candidates
    are judged in windows that together hold them whole; repeated rows are scanned each; ties in
    start go by kind; an empty table gives no rows; columns of the names added are replaced.
    """
    return scan(docs, fit(docs, text_col, max_docs), text_col, redact, keep)
