"""Fill-in-middle, circulant MinHash and vector codes against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sievework.llm import catalog, fill_middle, minhash, vector_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "naïve 🙂 text\n" * 30_000
EDGE = [(1, None), (2, ""), (3, "a"), (4, "has <S> inside"), (5, LONG), (6, "same"), (6, "same"), (None, "no id"), (7, "<P <S< M>"), (8, " \t\n")]


def frame(spark, rows=EDGE):
    own = [(i, t, "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(own, "doc_id long, text string, output string, n int, form string")


def plain_fill(doc_id, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_edge_rows(spark):
    made = fill_middle.fill_in_middle(frame(spark))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    got = sorted(map(tuple, made.withColumn("back", back).collect()), key=str)
    assert got == sorted([(i, *plain_fill(i, t), t or "") for i, t in EDGE], key=str)
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_by_words_and_marks(spark):
    rows = [(i, f"one  two\nthree {'x ' * i}") for i in range(40)] + [(99, "  starts with a blank")]
    made = fill_middle.fill_in_middle(frame(spark, rows), unit=r"\S+\s*", salt="s", rate=100)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    for r in made.withColumn("back", back).collect():
        text = dict(rows)[r.doc_id]
        assert r.back == text
        if r.doc_id == 99:
            assert (r.n, r.form, r.output) == (None, "plain", text)
        else:
            assert r.n == len(text.split())
            starts = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
            assert r.prefix_chars in starts and r.prefix_chars + r.middle_chars in starts
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(frame(spark), marks=("<a><", "<b>", "<c>"))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(frame(spark), marks=("<a>", "<a>", "<c>"))


def test_cut_places_keep_graphemes():
    pattern = regex.compile(r"(\X)*", regex.DOTALL | regex.V1)
    text = "éàb"
    for draws in itertools.product(range(4), repeat=2):
        n, a, b = fill_middle.cut_places(text, pattern, draws)
        assert n == 3 and {a, b} <= {0, 2, 4, 5}


def words_set(text, width=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_copies(rows, percent=85):
    sets = [words_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted([(d, len(s), low.get(find(i)), d is not None and d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def family(rng, start, copies, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(copies):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append((start + k, " ".join(own)))
    return out


def test_minhash_edge_rows(spark):
    rows = EDGE + [(20, "A b  c"), (21, "a B c"), (22, "a b c d"), (None, "no id"), (23, ""), (3, "another text with the id three"), (24, LONG + "x")]
    rows += [(None, "a text of which no row has an id at all")] * 2
    got = minhash.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_copies(rows)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [2_000, 16])
def test_minhash_families_near_the_limit(spark, cell):
    """Members differ from each other on both sides of the limit; small cells split every large bucket."""
    rng = random.Random(cell)
    rows = [r for f in range(4) for r in family(rng, 1000 * f, 70)]
    shared = " ".join(f"p{i}" for i in range(70))
    rows += [(9000 + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(50))) for i in range(60)]
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell)
    assert sorted(map(tuple, got.collect()), key=str) == plain_copies(rows)


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(400):
        pool = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
        sets += [pool[:600], pool[100:]]
    sigs = minhash.signatures(sets, 320, 7)
    same = (sigs[::2] == sigs[1::2]).mean(1)
    truth = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs(same.mean() - truth) < 0.005
    assert same.std() < 1.3 * math.sqrt(truth * (1 - truth) / 320)
    whole = np.unique(rng.integers(0, 2**63, 3 * minhash.BLOCK).astype(np.uint64))
    pieces = minhash.signatures([whole[i :: 4] for i in range(4)], 16, 7)
    assert (minhash.signatures([whole], 16, 7)[0] == pieces.min(0)).all()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, v) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(kept[0][2]) if kept else 0
    width = -(-dim // parts)
    grid = {}
    for k, (_, _, v) in enumerate(kept):
        if len(v) == dim:
            x = [math.floor(int(4096 * a) if float(a).is_integer() and abs(a) > 2**52 else 4096 * a) for a in v] + [0] * (width * parts - dim)
            grid[k] = [x[p * width : (p + 1) * width] for p in range(parts)]
    books = [[grid[k][p] for k in list(grid)[:entries]] for p in range(parts)]

    def pick(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for g in grid.values():
                groups.setdefault(pick(p, g[p])[1], []).append(g[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, sums = [], {}
    for k, (i, label, _) in enumerate(kept):
        if k not in grid:
            out.append([i, None, None, label])
            continue
        found = [pick(p, grid[k][p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append([i, "".join(f"{e:02x}" for _, e in found), error if error < 2**63 else None, label])
        if error < 2**63:
            sums[label] = sums.get(label, 0) + error
    flat = ",".join(str(v) for b in books for e in b for v in e)
    fits = lambda s: s if s is not None and s < 2**63 else None
    return sorted([(i, c, e, fits(sums.get(label)), hashlib.sha256(flat.encode()).hexdigest()) for i, c, e, label in out], key=str)


def coded(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string")
    return sorted(map(tuple, vector_codes.with_label_errors(vector_codes.compress(df, **more)).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_vector_codes_of_edge_rows(spark):
    rng = random.Random(3)
    rows = [(i // 2, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(20)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(5, rows[10][1], 1), (None, [0.5] * 20, 2), (3, None, 1), (4, [], 1), (4, [float("nan")] * 20, 1), (6, [None] + [1.0] * 19, 1), (7, [1.0] * 7, 1)]
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert coded(spark, rows) == plain_codes(as_float)
    few = as_float[:5]
    assert coded(spark, few) == plain_codes(few)
    assert coded(spark, []) == []


def test_vector_codes_of_huge_components(spark):
    big = [(i, [float(np.float32(x)) for x in (3e38, -1e30, i * 1e20, 5.0)], 1) for i in range(30)] + [(40, [1.0, 2.0, 3.0, 4.0], 2)]
    assert coded(spark, big, parts=2, entries=4, rounds=3) == plain_codes(big, 2, 4, 3)


def test_nearest_entry_ties_and_widths():
    rng = np.random.default_rng(5)
    for width in (1, 3, 8, 33):
        x, c = rng.integers(-3, 4, (500, width)), rng.integers(-3, 4, (16, width))
        whole = ((x[:, None] - c) ** 2).sum(2)
        index, error = vector_codes.nearest(x, c)
        assert (index == whole.argmin(1)).all() and (error == whole.min(1)).all()


def test_queries_match_plain_versions(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, catalog.QUERIES["op12_circulant_minhash"](spark, SF).collect()), key=str)
    assert got == plain_copies(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted([(i, *plain_fill(i, t)[:4], sha(plain_fill(i, t)[4]), sha(t or "")) for i, t in docs], key=str)
    assert sorted(map(tuple, catalog.QUERIES["op11_fill_middle"](spark, SF).collect()), key=str) == want
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op13_hadamard_codes"](spark, SF).collect()), key=str) == plain_codes(vectors)
