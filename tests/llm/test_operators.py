"""The training-data operators against plain versions, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sievework.llm import ann, chat, lm_score, mixing, packing, quality, secrets, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "x y"), (5, "wörd " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, t, "x") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, fp string")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def fingerprint(text):
    words = SPACES.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs):
    fps = {i: fingerprint(t) for i, t in texts(docs).items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, find(i)) for i, f in fps.items()}


def test_simhash_finds_every_planted_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        fp = int(rng.integers(0, 1 << 63))
        other = fp
        for b in rng.choice(64, 3, replace=False):
            other ^= 1 << int(b)
        rows += [(2 * k, fp), (2 * k + 1, other)]
    signed = [(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in rows]
    got = {r["fp"]: r["component_id"] for r in simhash.components_of(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert all(got[signed[2 * k][1]] == got[signed[2 * k + 1][1]] for k in range(300))


def test_simhash_edge_rows(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sorted(r["doc_id"] or -1 for r in simhash.drop_near_duplicates(edge).collect()) == [-1, 1, 3, 5]
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def recorded(monkeypatch, module):
    """The plans of everything that `module` stores."""
    plans, store = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df))[1])
    return plans


def test_simhash_sends_no_documents_to_the_driver(spark, monkeypatch):
    """Anchors are many rows for each fingerprint, which Spark sizes as one and used to broadcast."""
    plans = recorded(monkeypatch, simhash)
    docs = spark.createDataFrame([(i, f"a b c {i // 2} d e f") for i in range(40)], "doc_id long, text string")
    for df in (simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8
    # What is broadcast is at most one row for each `cell` anchors.
    assert all("BroadcastHashJoin [anchor" in line and "BuildRight" in line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line)


def test_mixing_meets_every_marginal():
    rng = np.random.default_rng(2)
    mass = rng.random((4, 3, 2)) + 0.1
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    raked = mass * mixing.rake(mass, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(raked.sum(axis=tuple(i for i in range(3) if i != axis)) / mass.sum(), goal, atol=1e-9)
    weights = mixing.rake(mass, goals)
    c = mixing.calibrate(mass, weights, 0.5)
    assert math.isclose(float((mass * np.minimum(1, c * weights)).sum()), 0.5 * mass.sum(), rel_tol=1e-9)


def test_raking_under_a_bound_on_weights():
    """Cut cells hand their tokens to others of the category while those have room; else it falls short."""
    mass = np.array([[8.0, 1.0], [90.0, 1.0]])
    goals = [np.array([0.3, 0.7]), np.array([0.9, 0.1])]
    free, cut = mixing.rake(mass, goals), mixing.rake(mass, goals, most=5.5)
    assert free.max() > 5.5 >= cut.max()
    for axis, goal in enumerate(goals):
        assert np.allclose((mass * cut).sum(axis=1 - axis) / 100, goal, atol=1e-6)
    assert math.isclose(float((mass * mixing.rake(mass, goals, most=2.0)).sum(axis=1)[0]), 18.0, rel_tol=1e-6)


def test_mixed_sample_meets_its_marginals(spark):
    """Whole documents table: cells and raking recomputed plainly, shares of the sample near the targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    rows = mixed.select("doc_id", "text", "source", "lang", "_tokens", "_cell_topic", "_weight", "_probability", "_copies", "_sampled").collect()
    names = [[*t, mixing.OTHER] for t in mixing.TARGETS.values()]
    mass, weight = np.zeros([len(n) for n in names]), np.zeros([len(n) for n in names])
    for r in rows:
        assert r["_tokens"] == len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
        at = tuple(n.index(v if v in n else mixing.OTHER) for n, v in zip(names, (r["source"], r["lang"], r["_cell_topic"])))
        mass[at] += r["_tokens"]
        weight[at] = r["_weight"]
        assert r["_sampled"] == (r["_copies"] > 0) and 0 <= r["_copies"] <= mixing.MOST_COPIES
        assert r["_copies"] in (math.floor(mixing.SHARE * r["_weight"]), math.floor(mixing.SHARE * r["_weight"]) + 1)
    for axis, (dim, goal) in enumerate(mixing.TARGETS.items()):
        got = (mass * weight).sum(axis=tuple(i for i in range(3) if i != axis)) / mass.sum()
        own = mass.sum(axis=tuple(i for i in range(3) if i != axis))
        rest, present = own[-1] / mass.sum(), sum(goal[n] for n, m in zip(names[axis], own) if n in goal and m > 0)
        for name, m, share in zip(names[axis], own, got):
            want = rest if name == mixing.OTHER else goal[name] / present * (1 - rest) if m > 0 else 0.0
            assert abs(share - want) < 1e-3, (dim, name, share, want)
    for r in mixing.report(mixed, mixing.TARGETS).collect():
        assert abs(r["raked"] - r["target"]) < 1e-3 and abs(r["sampled"] - r["raked"]) < 0.03, r
    assert abs(sum(r["_copies"] * r["_tokens"] for r in rows) / mass.sum() - mixing.SHARE) < 0.05
    assert all(r["sampled"] == 0 for r in mixing.report(mixing.mixed_documents(docs.limit(0)), mixing.TARGETS).collect())


def test_mixing_edge_rows(spark):
    rows = [(1, "a b", "src0", "en"), (2, None, None, None), (2, None, None, None), (None, "c " * 5000, "zzz", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS _weight")
    out = mixing.mixed_documents(df).collect()
    assert all(r["_weight"] > 0 for r in out)
    assert len(out) == 4 and len({r["_sampled"] for r in out if r["doc_id"] == 2}) == 1
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "bye\n"), (2, 0, None, ""), (None, 0, "assistant", "x" * 70_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS loss_start")
    examples = chat.prefix_examples(turns)
    assert sum(r["loss_end"] > r["loss_start"] for r in examples.collect()) == 3
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, None):
        mine = [((r or ""), (t or "")) for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.prefix_examples(turns.limit(0))).count() == 0


def plain_first_fit(lengths, room):
    bins, out = [], []
    for n in lengths:
        b = next((i for i, free in enumerate(bins) if free >= n), len(bins))
        if b == len(bins):
            bins.append(room)
        out.append((b, room - bins[b]))
        bins[b] -= n
    return out


def test_packing_tree_is_first_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 57, 300):
        lengths = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        assert packing.first_fit_decreasing(lengths, 100) == plain_first_fit(lengths, 100)


def test_packing_holds_every_id_once(docs, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for df in (docs.select("doc_id", "text"), edge):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            want[r["doc_id"], np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
        rows = packing.pack_documents(df).collect()
        by_sequence, by_doc = {}, {}
        for r in rows:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append(r)
        for parts in by_sequence.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
        assert sum(r["length"] for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
        for (doc, ids), n in want.items():
            if n == 1 and sum(k[0] == doc for k in want) == 1:
                joined = np.array([i for r in sorted(by_doc[doc], key=lambda r: r["start"]) for i in r["ids"]], "<u4").tobytes()
                assert joined == ids
    assert packing.pack_documents(edge.limit(0)).count() == 0


def test_token_counts_add_up(docs, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    whole = texts(docs)
    for r in token_counts.sentence_token_counts(docs).collect():
        n = len(tok.encode(whole[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_tokens"] == n == sum(r["section_tokens"])
    rows = token_counts.sentence_token_counts(edge).collect()
    assert len(rows) == len(EDGE) and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert token_counts.sentence_token_counts(edge.limit(0)).count() == 0


def test_secrets_base_and_learned(spark, docs):
    value = "sk-" + "Zx9QmT2vLr8KpW4sYb6NcJ1d"
    rows = [
        (1, 'api_key = "abcdefgh"'), (2, "Token:short token = 'longer_value'"), (3, "AKIA" + "A1" * 8), (4, "é" * 5 + "0a" * 20), (5, None), (6, ""),
        (7, f"use {value} for this"), (8, "passwd=" + "f" * 40), (9, "plain words only, and 2024-01-02"), (9, "plain words only, and 2024-01-02"), (10, "ſecret=abcdefgh"), (11, "w " * 100_000 + "AKIA" + "B" * 16),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS _spans")
    net = secrets.fit(docs, max_docs=400)
    got = {r["doc_id"]: r for r in secrets.scan(df, net, redact="#").collect()}
    assert [got[i]["_spans"] for i in (1, 2, 3, 4)] == ["assign:0:19", "assign:12:33", "access:0:20", "hex:5:45"]
    assert got[5]["_spans"] == got[6]["_spans"] == got[9]["_spans"] == got[10]["_spans"] == ""
    assert got[7]["_spans"] == f"learned:4:{4 + len(value)}" and got[7]["_redacted"] == "use # for this"
    assert got[8]["_spans"] == "assign:0:47,hex:7:47" and got[8]["_redacted"] == "#"
    assert got[11]["_spans"] == "access:200000:200020"
    assert got[5]["_base_sha256"] == hashlib.sha256(b"").hexdigest()
    held = secrets.invented(600, 77)
    chance = net.chances(secrets.encode([w for w, _ in held])) >= net.threshold
    truth = np.array([y for _, y in held]) == 1
    assert (chance & truth).sum() / truth.sum() >= 0.9 and (chance & ~truth).sum() / (~truth).sum() <= 0.1
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_secrets_gradients_are_those_of_the_loss():
    net = secrets.Network.fresh(5)
    found = secrets.invented(12, 4)
    x, y = secrets.encode([w for w, _ in found]), np.array([t for _, t in found], float)

    def loss():
        z = net.logits(x)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(x, y)
    for weights, grad, at in zip((net.embed, net.kernel, net.bias, net.out), grads, ((69, 2), (7, 3), (4,), (30,))):
        before, step = weights[at], 1e-5
        weights[at] = before + step
        up = loss()
        weights[at] = before - step
        down = loss()
        weights[at] = before
        assert math.isclose((up - down) / (2 * step), grad[at], rel_tol=1e-3, abs_tol=1e-6)


def plain_quality(text):
    words = SPACES.findall(text)
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs, edge):
    for df in (docs, edge):
        want = Counter((r["doc_id"], *plain_quality(r["text"] or "")) for r in df.collect())
        got = quality.quality(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality(edge.limit(0)).count() == 0


def test_chain_marginals_against_all_paths():
    rng = np.random.default_rng(6)
    links = rng.normal(0, 1, 4)
    lengths = np.array([6, 4, 1])
    emitted = np.zeros((6, 3))
    for j, n in enumerate(lengths):
        emitted[:n, j] = rng.normal(0, 1, n)
    p = toxicity.marginals(emitted, lengths, links)[2]
    jump = {(0, 0): 0.0, (0, 1): links[1], (1, 0): links[2], (1, 1): links[3]}
    for j, n in enumerate(lengths):
        total, hot = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            score = path[0] * links[0] + sum(s * emitted[t, j] for t, s in enumerate(path)) + sum(jump[x] for x in zip(path, path[1:]))
            total += math.exp(score)
            hot += np.array(path) * math.exp(score)
        assert np.allclose(p[:n, j], hot / total)


def test_toxicity_on_held_out_labels(spark):
    rng = np.random.default_rng(7)
    plain, bad = [f"word{i}" for i in range(300)], ["grubo" + e for e in ("la", "ter", "mis", "kan", "vu")]
    rows, labels = [], []
    for i in range(800):
        words = rng.choice(plain, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            for at in rng.choice(40, 4, replace=False):
                words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, None), (900, ""), (901, "grubozzz " * 30_000), (901, "grubozzz " * 30_000)]
    labels += [(None, 1), (900, None), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS _toxic_score")
    named = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxic_documents(docs, named).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 800 and r["_toxic_held_out"]:
            assert r["_toxic_predicted"] == (r["doc_id"] % 4 == 0)
        if r["text"] and "grubo" in r["text"]:
            a, b = map(int, r["_toxic_spans"].split(",")[0].split(":"))
            assert r["text"][a:b].startswith("grubo")
        if not r["text"]:
            assert r["_toxic_predicted"] == 0
    assert all(r["_toxic_score"] == 0 for r in toxicity.toxic_documents(docs.limit(5), named.limit(0)).collect())
    assert toxicity.toxic_documents(docs.limit(0), named).count() == 0


def plain_context_tree(trained, tested, depth):
    """Log10 probabilities by recursion over the same trees, one node at a time."""
    nodes = {}

    def symbols(data):
        s = b" " * depth + lm_score.stream(data)
        return [(s[i - depth : i], s[i]) for i in range(depth, len(s))]

    def bits(byte):
        return [(1 << k | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]

    for data in trained:
        for ctx, byte in symbols(data):
            for node, bit in bits(byte):
                for d in range(depth + 1):
                    nodes.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
    children = {}
    for ctx, node in nodes:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(n[0] + n[1] + 1)

    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(nodes[key])
            memo[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(map(weighted, children[key]))) - math.log(2)
        return memo[key]

    def predict(ctx, node, d):
        key = (ctx[depth - d :], node)
        n0, n1 = nodes[key]
        guess = (n1 + 0.5) / (n0 + n1 + 1)
        deeper = (ctx[depth - d - 1 :], node) if d < depth else None
        if d == depth:
            return guess
        share = math.exp(kt(nodes[key]) - math.log(2) - weighted(key))
        return share * guess + (1 - share) * (predict(ctx, node, d + 1) if deeper in nodes else guess)

    out = []
    for data in tested:
        total = 0.0
        for ctx, byte in symbols(data):
            for node, bit in bits(byte):
                p = predict(ctx, node, 0) if (b"", node) in nodes else 0.5
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_against_recursion(spark):
    from pyspark.sql import functions as F

    rows = [(1, "The cat sat"), (2, "the cat ran"), (3, "a cat"), (4, None), (5, ""), (6, "the dog sat"), (6, "the dog sat"), (7, "cat " * 30), (8, "zèbre")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block")
    got = lm_score.score_documents(df, held_out=F.col("doc_id") >= 6, depth=3).collect()
    clean = [b" ".join((t or "").lower().encode().split()) for _, t in rows]
    trained = [c for (i, _), c in zip(rows, clean) if i < 6]
    want = dict(zip([i for i, _ in rows], plain_context_tree(trained, clean, 3)))
    counts = Counter(w for c in trained for w in [*c.split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*clean[[i for i, _ in rows].index(r["doc_id"])].split(), b"\n"]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(t in counts for t in tokens) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-5), r["doc_id"]
    assert lm_score.score_documents(df.limit(0)).count() == 0


def test_context_tree_sends_no_table_to_the_driver(spark, monkeypatch):
    """Bits are eight rows for each symbol key, which Spark sizes as one and used to broadcast."""
    plans = recorded(monkeypatch, lm_score)
    scored = lm_score.score_documents(spark.createDataFrame([(i, f"the cat {i}") for i in range(20)], "doc_id long, text string"), depth=2)
    plans.append(scored._jdf.queryExecution().executedPlan().toString())
    assert scored.count() == 20 and sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_prefix_forest_recall(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(1500, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [None] * 16), (2060, [float("nan")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "0 AS score")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        exact = data @ data[q]
        exact[q] = -np.inf
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert all(math.isclose(s, exact[i], rel_tol=1e-9, abs_tol=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(np.argsort(-exact)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_prefix_forest_of_several_blocks_with_ties_and_repeats(spark):
    """Blocks and chunks smaller than the table; equal vectors, repeated ids, few rows, mixed lengths."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 8)) * rng.uniform(0.2, 2, size=(300, 1))
    rows = [(i, base[i // 2].tolist()) for i in range(600)] + [(40, base[150].tolist()), (41, base[20].tolist())]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(0, 50, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), block_rows=128, wanted=100_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i, _ in rows if i % 20 == 0]:
        best = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q and len(v) == len(own):
                    s = float(np.einsum("ij,j->i", np.array([v]), np.array(own))[0])
                    best[i] = max(s, best.get(i, -math.inf))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        found = sorted(got.get(q, []))
        assert [k for k, _, _ in found] == list(range(1, len(want) + 1))
        assert [i for _, i, _ in found] == [i for i, _ in want]


def test_prefix_forest_ascends_in_step():
    """Candidates are the matches at the deepest level that holds as many as wanted, in all trees."""
    x = np.random.default_rng(3).normal(size=(700, 24))
    forest = ann.PrefixForest(x, 30, 10, 11)
    codes = forest.hash(np.column_stack([x[:40], np.zeros(40)]))
    rows = np.zeros_like(forest.sorted)
    np.put_along_axis(rows, forest.order.astype(np.int64), forest.sorted, 1)
    for wanted in (1, 300, 10**9):
        hit = forest.candidates(x[:40], wanted)
        for i in range(40):
            same = {d: rows >> (10 - d) == (codes[:, i] >> (10 - d))[:, None] for d in range(11)}
            depth = max([d for d in same if same[d].sum() >= wanted], default=0)
            assert (hit[i] == same[depth].any(0)).all()
