import itertools
import random

import numpy as np
import pytest

from sievework.operators import graph as gg
from sievework.operators import graph_blocks as gb
from sievework.operators import graph_clean as gcl
from sievework.operators import graph_communities as gc
from sievework.operators import graph_features as gf
from sievework.operators import graph_lists
from sievework.operators import graph_motifs as gmo
from sievework.operators import graph_paths as gp
from sievework.operators import graph_rank as gr
from sievework.session import cut


def make(spark, edges, extra=(), directed=False):
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src int, dst int, _row_id long")
    v = spark.createDataFrame([(x,) for x in extra], "id int") if extra else None
    return gg.simple(gg.from_edges(e, directed, v))


BARBELL = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]


def parts(nodes, edges):
    left, comp = set(nodes), []
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            x = stack.pop()
            seen.add(x)
            for a, b in edges:
                for y in ((b,) if a == x else ()) + ((a,) if b == x else ()):
                    if y in left:
                        left.remove(y)
                        stack.append(y)
        comp.append(seen)
    return comp


def brute_bridges(nodes, edges):
    base = len(parts(nodes, edges))
    return {e for e in edges if len(parts(nodes, [x for x in edges if x != e])) > base}


def brute_cuts(nodes, edges):
    base = len(parts(nodes, edges))
    out = set()
    for v in nodes:
        rest = [e for e in edges if v not in e]
        lone = not any(v in e for e in edges)
        if len(parts([n for n in nodes if n != v], rest)) > base - (1 if lone else 0):
            out.add(v)
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 14, 16), (2, 18, 20), (3, 12, 22), (4, 20, 19)])
def test_bridges_and_cut_vertices_against_removal(spark, seed, n, m):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    nodes = sorted({x for e in edges for x in e})
    g = make(spark, edges)
    assert {(r.src, r.dst) for r in gb.bridges(g).collect()} == brute_bridges(nodes, edges)
    assert {r.id for r in gb.articulation_points(g).collect()} == brute_cuts(nodes, edges)
    got = {r.id: r.component for r in gg.connected_components(g).collect()}
    assert got == {x: min(c) for c in parts(nodes, edges) for x in c}


def test_blocks_of_a_long_path_with_a_ring_and_a_hub(spark):
    """Depth does not matter: a path of 2,000 vertices, a ring at its end, a star, a lone vertex."""
    path = [(i, i + 1) for i in range(2000)]
    ring = [(2000 + i, 2001 + i) for i in range(5)] + [(2000, 2005)]
    star = [(3000, 3001 + i) for i in range(300)]
    g = make(spark, path + ring + star, extra=[9999])
    assert {(r.src, r.dst) for r in gb.bridges(g).collect()} == set(path) | set(star)
    assert {r.id for r in gb.articulation_points(g).collect()} == set(range(1, 2001)) | {3000}


def test_blocks_without_edges(spark):
    g = make(spark, [(1, 1)], extra=[2])
    assert gb.bridges(g).count() == 0 and gb.articulation_points(g).count() == 0


def test_barbell_measures(spark):
    g = make(spark, BARBELL)
    assert {(r.src, r.dst) for r in gb.bridges(g).collect()} == {(2, 3)}
    assert {r.id for r in gb.articulation_points(g).collect()} == {2, 3}
    assert {r.id: r.triangles for r in gmo.triangles(g).collect()} == {i: 1 for i in range(6)}
    b = {r.id: r.betweenness for r in gp.betweenness(g).collect()}
    assert b[2] == pytest.approx(0.6) and b[0] == pytest.approx(0.0)
    s = gp.shortest_path_stats(g).first()
    assert s.diameter == 3 and s.radius == 2 and s.average_path_length == pytest.approx(27 / 15)
    for find in (gc.louvain, gc.greedy_communities):
        part = find(g)
        groups = {}
        for r in part.collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5]]
    assert {r.id: r.core_number for r in gr.core_number(g).collect()} == {i: 2 for i in range(6)}
    e = {r.id: r.local_efficiency for r in gp.local_efficiency(g).collect()}
    assert e[0] == pytest.approx(1.0) and e[2] == pytest.approx(1 / 3)


def test_louvain_ends_where_no_vertex_gains(spark):
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)})
    part = {r.id: r.community for r in gc.louvain(make(spark, edges, extra=[40]), tolerance=0).collect()}
    assert part[40] == 40 and all(c == min(v for v in part if part[v] == c) for c in part.values())
    deg = {v: sum(v in e for e in edges) for v in part}

    def q(p):
        inside = sum(p[a] == p[b] for a, b in edges) / len(edges)
        return inside - sum((sum(deg[v] for v in p if p[v] == c) / (2 * len(edges))) ** 2 for c in set(p.values()))

    # Merging two of the returned communities never gains, and the whole beats single vertices.
    names = sorted(set(part.values()))
    assert all(q({v: a if c == b else c for v, c in part.items()}) <= q(part) + 1e-9 for a in names for b in names if a < b)
    assert q(part) > q({v: v for v in part}) + 0.2


def test_star_and_path(spark):
    star = make(spark, [(0, i) for i in range(1, 8)], extra=[9])
    d = {r.id: r.degree for r in gg.degrees(star).collect()}
    assert d[0] == 7 and d[9] == 0
    assert {r.id: r.core_number for r in gr.core_number(star).collect()}[0] == 1
    path = make(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    c = {r.id: r.closeness for r in gp.closeness(path).collect()}
    assert c[2] == pytest.approx(4 / 6) and c[0] == pytest.approx(0.4)
    vec, lam = gr.laplacian_eigenvectors(path, 2)
    assert lam == pytest.approx([0.0, 0.381966], abs=1e-4)


def test_square_count_against_pairs(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(34)})
    nb = {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    want = {v: sum(len((nb[x] & nb[y]) - {v}) for x in nb[v] for y in nb[v] if x < y) for v in nb}
    assert {r.id: r.square_count for r in gmo.square_count(make(spark, edges)).collect()} == want


def test_strong_components(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)], directed=True)
    assert {r.id: r.component for r in gg.strong_components(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_cleaning_counters(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)]
    edges = [*ring, (1, 0), (0, 1), (3, 3), (10, 11), (11, 12), (20, 21)]
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src int, dst int, _row_id long")
    got = gcl.clean_graph(gg.from_edges(e, False, spark.createDataFrame([(99,)], "id int")))
    s = got.stats
    assert (s["self_loops_removed"], s["duplicate_edges_removed"], s["low_degree_nodes_removed"], s["disconnected_components_removed"]) == (1, 2, 1, 5)
    assert (s["final_nodes"], s["final_edges"]) == (6, 6)


def test_roles_and_walks(spark):
    g = make(spark, [(0, 1), (1, 2), (3, 1), (4, 1), (1, 5)], directed=True)
    roles = {r.id: r.label for r in gf.label_degree(g).collect()}
    assert roles[0] == "Source" and roles[2] == "Sink"
    pr = {r.id: r.pagerank for r in gr.pagerank(g, tol=1e-9).collect()}
    assert sum(pr.values()) == pytest.approx(1.0)
    for r in gf.random_walks(g, 4, 3).collect():
        steps = list(zip(r.path, r.path[1:]))
        assert all((int(a), int(b)) in {(0, 1), (1, 2), (3, 1), (4, 1), (1, 5)} for a, b in steps)


def test_paths_are_exact_above_a_thousand_vertices(spark):
    draw = random.Random(3)
    n = 1050
    edges = {(draw.randrange(max(1, i // 8)), i) for i in range(1, n)} | {(0, i) for i in range(1, n, 9)}
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    far, total, close = [], 0, {}
    for start in range(n):
        seen, edge, d, s = {start}, [start], 0, 0
        while edge:
            edge = list({y for x in edge for y in near[x]} - seen)
            seen |= set(edge)
            d += bool(edge)
            s += d * len(edge)
        far.append(d)
        total += s
        close[start] = (n - 1) / s
    s = gp.shortest_path_stats(make(spark, sorted(edges))).first()
    assert s.exact and s.diameter == max(far) and s.radius == min(far)
    assert s.average_path_length == pytest.approx(total / (n * (n - 1)))
    got = {r.id: r.closeness for r in gp.closeness(make(spark, sorted(edges))).collect()}
    assert got == pytest.approx(close)


def plain_search(nodes, edges, directed):
    """(reached, total, far, between) of every vertex by breadth-first searches."""
    out = {x: set() for x in nodes}
    for a, b in edges:
        out[a].add(b)
        if not directed:
            out[b].add(a)
    sums = {x: [0, 0, 0, 0.0] for x in nodes}
    for s in nodes:
        dist, sigma, order, before = {s: 0}, {s: 1}, [s], {s: []}
        for x in order:
            for y in out[x] - {x}:
                if y not in dist:
                    dist[y], sigma[y], before[y] = dist[x] + 1, 0, []
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    before[y].append(x)
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order[1:]):
            for x in before[y]:
                delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            r = sums[y]
            r[0], r[1], r[2], r[3] = r[0] + 1, r[1] + dist[y], max(r[2], dist[y]), r[3] + delta[y]
    return sums


@pytest.mark.parametrize("directed", [False, True])
def test_search_in_several_batches(spark, directed, monkeypatch):
    """Batches smaller than the graph, a hub of several neighbour lists, loops, and lone vertices."""
    from sievework.operators import graph_search as gs

    monkeypatch.setattr(gs, "LIST", 8)
    monkeypatch.setattr(gs, "WORDS", 64)
    rng = random.Random(7)
    edges = {tuple(rng.sample(range(90), 2)) for _ in range(120)} | {(0, i) for i in range(20, 60)} | {(5, 5)}
    edges = sorted(edges if directed else {(min(e), max(e)) for e in edges})
    nodes = list(range(95))
    g = make(spark, edges, nodes, directed)
    want = plain_search(nodes, edges, directed)
    got = {r.id: r for r in gs.path_sums(g, batch=64).collect()}
    for x in nodes:
        r = got[x]
        assert [r.reached, r.total, r.far] == want[x][:3]
        assert r.between == pytest.approx(want[x][3])
    assert {r.id: [r.reached, r.total, r.far] for r in gs.distance_sums(g, batch=64).collect()} == {x: w[:3] for x, w in want.items()}
    if directed:
        turned = plain_search(nodes, [(b, a) for a, b in edges], True)
        assert {r.id: r.eccentricity for r in gp.eccentricity(g).collect()} == {x: w[2] for x, w in turned.items()}


def test_components_share_the_numbers_of_their_sources(spark):
    """A star of 70 vertices, a path of 5, a ring of 3, a lone one: one batch of 128 serves all, and sampled sources too."""
    from sievework.operators import graph_search as gs

    edges = [(0, i) for i in range(1, 70)] + [(100 + i, 101 + i) for i in range(4)] + [(200, 201), (201, 202), (200, 202)]
    g = make(spark, edges, [300])
    numbers, most = gs._numbered(g, None)
    assert most == 70 and sorted(r["at"] for r in numbers.filter("id >= 100").collect()) == [0, 0, 0, 1, 1, 2, 2, 3, 4]
    assert gs._width(1024, most) == 128
    some = spark.createDataFrame([(3,), (101,), (104,), (300,)], "source int")
    assert gs._numbered(g, some)[1] == 2
    got = {r.id: (r.reached, r.total, r.far) for r in gs.distance_sums(g, some).collect()}
    assert got[101] == (1, 3, 3) and got[0] == (1, 1, 1) and got[200] == (0, 0, 0) and got[300] == (0, 0, 0)
    far = {r.id: r.far for r in gs.path_sums(g).collect()}
    assert far[7] == 2 and far[0] == 1 and far[102] == 2 and far[100] == 4 and far[201] == 1 and far[300] == 0


def test_triangles_send_the_lists_of_the_higher_ends(spark):
    """A star over a ring: no list of the hub's leaves travels, and edges count their triangles."""
    rng = random.Random(5)
    edges = {(0, i) for i in range(1, 30)} | {(i, i + 1) for i in range(1, 29)} | {tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}
    g = make(spark, sorted(edges))
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in range(30)}
    common = gmo.common_neighbors(g)
    assert {(r.src, r.dst): r.common for r in common.collect()} == {(a, b): len(near[a] & near[b]) for a, b in edges}
    assert "array_intersect" in common._jdf.queryExecution().toString()
    assert gmo.triangles(g).agg({"triangles": "sum"}).first()[0] == sum(len(near[a] & near[b]) for a, b in edges)


def test_sources_run_their_windows_once(spark, tmp_path):
    from sievework.catalog import graphs as cg

    spark.sql("SELECT 1L AS l_orderkey, id + 5 AS l_partkey, CAST(id AS INT) AS l_linenumber, 2D AS l_quantity, 3D AS l_extendedprice FROM range(3)").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = cg.parts(spark, str(tmp_path))
    assert "Window" not in g.vertices._jdf.queryExecution().toString()
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(5, 6), (6, 7)]


def test_search_of_empty_and_edgeless_graphs(spark):
    lone = make(spark, [], [1, 2])
    assert sorted(map(tuple, gp.path_measures(lone).collect())) == [(1, 0, 0, 0, 0.0), (2, 0, 0, 0, 0.0)]
    none = gg.simple(gg.from_edges(spark.createDataFrame([], "src int, dst int")))
    assert gp.path_measures(none).count() == 0 and gp.closeness(none).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_in_many_blocks_leave_the_edges_in_place(spark, monkeypatch):
    from sievework.operators import graph_matrix as gx

    for name, value in (("VALUES", 8), ("CHUNK", 4), ("TASK", 16), ("LEAST_TASK", 1)):
        monkeypatch.setattr(gx, name, value)
    edges = sorted({(i, (i * i + 3 * j) % 40) for i in range(40) for j in range(1, 5)} | {(0, i) for i in range(1, 30)})
    v = spark.createDataFrame([(i,) for i in range(42)], "id long")
    links = spark.createDataFrame([(a, b, 0.5 + a) for a, b in edges] + [(None, 3, 1.0)], "id long, nbr long, w double")
    m = gx.Matrix(v, links, 3)
    start = cut(m.gathered(m.numbers.selectExpr("v", "id AS a", "id * id AS b", "1 AS c"), ["a", "b", "c"]))
    got = m.step(start, lambda old, y: [old[0] + y])
    table = next(t for t in plan(got).split("ShuffledHashJoin")[1].split("\n") if ":-" in t or ": " in t)
    assert m.blocks > 3 and m.tasks > 3 and "Exchange" not in table
    a, x = np.zeros((42, 42)), np.array([(i, i * i, 1) for i in range(42)], float)
    for s, t in edges:
        a[t, s] = 0.5 + s
    rows = sorted(m.by_id(got, ["a", "b", "c"]).collect())
    assert np.allclose([[r.a, r.b, r.c] for r in rows], x + a @ x)
    monkeypatch.undo()
    g = gg.simple(gg.from_edges(spark.createDataFrame(edges, "src long, dst long")))
    both = np.zeros((40, 40))
    for s, t in edges:
        both[s, t] = both[t, s] = 1
    values, vectors = np.linalg.eigh(both)
    top = np.abs(vectors[:, -1])
    assert np.allclose([r.eigenvector for r in sorted(gr.eigenvector_centrality(g, tol=1e-9).collect())], top, atol=1e-5)
    katz = np.linalg.solve(np.eye(40) - 0.01 * both, np.ones(40))
    got = [r.katz for r in sorted(gr.katz_centrality(g, 0.01, tol=1e-10).collect())]
    assert np.allclose(got, katz / np.linalg.norm(katz), atol=1e-7)


def test_square_count_cuts_hubs_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(gmo, "WEDGES", 16)
    monkeypatch.setattr(gmo, "PIECE", 2)
    edges = [(0, i) for i in range(2, 30)] + [(1, i) for i in range(2, 30, 2)] + [(i, i + 3) for i in range(2, 20)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0)
    for u, w in itertools.combinations(near, 2):
        c = len(near[u] & near[w])
        for x in near[u] & near[w]:
            want[x] += c - 1
    assert {r.id: r.square_count for r in gmo.square_count(make(spark, edges)).collect()} == want


def test_components_and_tours_join_without_the_driver(spark):
    from sievework.operators.components import min_label_components

    g = make(spark, [(i, i + 1) for i in range(20)])
    forest, trees = gb.spanning_forest(g)
    found = [min_label_components(g.vertices, g.edges), gb._ranked_tour(forest, trees)]
    assert not any("BroadcastHashJoin" in plan(df) for df in found)
    assert {r.component for r in found[0].collect()} == {0}


@pytest.mark.parametrize("directed", [False, True])
def test_search_inside_tasks(spark, directed, monkeypatch):
    """Sparse and full products, hubs beyond the columns, narrow batches and several components, against a plain search; no level is a job."""
    from sievework.operators import graph_local as gl
    from sievework.operators import graph_search as gs

    monkeypatch.setattr(gs, "_fold", None)  # the search by shuffles
    rng = random.Random(9)
    edges = {tuple(rng.sample(range(90), 2)) for _ in range(500)} | {(0, i) for i in range(20, 60)} | {(5, 5)}
    edges |= {(100 + i, 101 + i) for i in range(30)} | {(i, 130) for i in range(100, 120, 3)}
    edges = sorted(edges if directed else {(min(e), max(e)) for e in edges})
    nodes = [*range(95), *range(100, 131)]
    g = make(spark, edges, nodes, directed)
    want = plain_search(nodes, edges, directed)
    got = {r.id: r for r in gs.path_sums(g).collect()}
    for x in nodes:
        assert [got[x].reached, got[x].total, got[x].far] == want[x][:3]
        assert got[x].between == pytest.approx(want[x][3])
    assert {r.id: [r.reached, r.total, r.far] for r in gs.distance_sums(g).collect()} == {x: w[:3] for x, w in want.items()}
    # The kernels again with other cuts of the same work.
    a, b = np.array([*edges, *([] if directed else [(y, x) for x, y in edges if x != y])]).T
    for chosen, rows, values in ((6, 4, 64), (10**9, 64, 1 << 20), (0, 1, 1 << 20)):
        monkeypatch.setattr(gl, "CHOSEN", chosen)
        monkeypatch.setattr(gl, "LEAST_ROWS", rows)
        monkeypatch.setattr(gl, "VALUES", values)
        at = np.arange(131)
        for kind, wide in ((gl.paths, 7), (gl.distances, 1)):
            sums = gl.search(kind, 131, a, b, directed, at, at, wide, range(-(-131 // wide)))
            for x in nodes:
                assert [s[x] for s in sums[:3]] == want[x][:3]
                assert kind is gl.distances or sums[3][x] == pytest.approx(want[x][3])


def test_greedy_merges_inside_tasks(spark, monkeypatch):
    """A star with 60 leaves, which takes a round a leaf, and random components: the same communities as by rounds of jobs."""
    from sievework.functions.merging import xxhash64

    rng = random.Random(4)
    long = "a name of more than thirty-two bytes, ä, for the long hash "
    edges = [(0, i) for i in range(1, 13)] + [(100 + i, 100 + j) for i, j in (rng.sample(range(14), 2) for _ in range(24))] + [(200, 201), (300, 300)]
    for kind in ("int", "long", "string"):
        e = spark.createDataFrame([(a, b, float(1 + (a * b) % 3), i) for i, (a, b) in enumerate(edges)], "src int, dst int, weight double, _row_id long")
        name = f"concat(IF({{0}} % 3 = 0, '{long}', 'p'), {{0}})" if kind == "string" else f"CAST({{0}} AS {kind})"
        g = gg.simple(gg.from_edges(e.selectExpr(f"{name.format('src')} AS src", f"{name.format('dst')} AS dst", "weight", "_row_id")))
        hashed = g.vertices.selectExpr("id", "xxhash64(id, id) AS h").collect()
        for r in hashed:
            raw = r.id.encode() if kind == "string" else r.id.to_bytes(4 if kind == "int" else 8, "little", signed=True)
            assert xxhash64(raw, xxhash64(raw)) == r.h % (1 << 64)
        if kind == "long":
            continue
        by_jobs = {r.id: r.community for r in gc.greedy_communities(g, held=0).collect()}
        assert {r.id: r.community for r in gc.greedy_communities(g, held=20).collect()} == by_jobs
        assert {r.id: r.community for r in gc.greedy_communities(g).collect()} == by_jobs
    star = gg.from_edges(spark.range(1, 400).selectExpr("0L AS src", "id AS dst"))
    rounds = []
    monkeypatch.setattr(gc, "_with_ends", lambda *x, f=gc._with_ends: rounds.append(1) or f(*x))
    gc.greedy_communities(star)
    assert len(rounds) == 1


def test_core_number_of_lists_in_parts(spark, monkeypatch):
    """Parts that exchange values find the cores of peeling; a long path needs more turns than a part takes at once."""
    rng = random.Random(5)
    dense = {(min(e), max(e)) for e in (rng.sample(range(60), 2) for _ in range(400)) if max(e) % 7 or min(e) < 9}
    path = [(i, i + 1) for i in range(1000, 3100)]
    near = {}
    for a, b in dense:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, k = {}, 0
    while near:
        v = min(near, key=lambda u: len(near[u]))
        k = max(k, len(near[v]))
        want[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    monkeypatch.setattr(graph_lists, "PART", 1200)
    monkeypatch.setattr(graph_lists, "SIZE", 500)
    got = {r.id: r.core_number for r in gr.core_number(make(spark, sorted(dense) + path, extra=[9999])).collect()}
    assert got == want | {i: 1 for i in range(1000, 3101)} | {9999: 0}


def test_louvain_weighs_moves_in_parts(spark, monkeypatch):
    """Moves weighed part by part, where the lists lie, are those of a plain search."""
    monkeypatch.setattr(graph_lists, "PART", 40)
    monkeypatch.setattr(graph_lists, "SIZE", 7)
    rng = random.Random(3)
    n, w = 30, {}
    for a, b in (rng.sample(range(n), 2) for _ in range(90)):
        w[min(a, b), max(a, b)] = float(rng.randrange(1, 9))
    for a in range(n - 1):
        w.setdefault((a, a + 1), 1.0)
    near = {v: {a + b - v: x for (a, b), x in w.items() if v in (a, b)} for v in range(n)}
    k, m2 = {v: sum(near[v].values()) for v in range(n)}, 2 * sum(w.values())
    at = {v: rng.randrange(6) for v in range(n)}
    total = {c: sum(k[v] for v in at if at[v] == c) for c in range(6)}
    moved, due = set(rng.sample(range(n), 3)), set(rng.sample(range(n), 2))
    lists = graph_lists.NeighbourLists(
        spark.createDataFrame([(*e, x) for (a, b), x in w.items() for e in ((a, b), (b, a))], "v long, nbr long, w double"), n)
    state = cut(spark.createDataFrame([(v, at[v], k[v], -v, v in due, v in moved) for v in range(n)], "v long, community long, k double, tie long, due boolean, moved boolean"))
    assert lists.lists.count() > 3 and lists.blocks == 5
    for every in (True, False):
        want = {}
        for v in range(n):
            if every or v in due | moved or moved & set(near[v]):
                value = lambda c: sum(x for u, x in near[v].items() if at[u] == c) - k[v] * (total[c] - k[v] * (c == at[v])) / m2
                best, c = max((round(value(c), 10), c) for c in {at[u] for u in near[v]} - {at[v]} | {-1} if c >= 0)
                if best > value(at[v]) + 1e-9:
                    want[v] = (c, round(best - value(at[v]), 6))
        got = gc._best_moves(lists, state, m2, every).collect()
        assert {r.v: (r.c, round(r.gain, 6)) for r in got} == want
        assert all((r.community, r.k, r.tie) == (at[r.v], k[r.v], -r.v) for r in got)
    lists.free()


def test_feature_group_that_fails_ends_the_job(spark, monkeypatch):
    def broken(g):
        raise ValueError("broken measure")

    g = make(spark, BARBELL)
    assert [c for c in gf.node_features_advanced(g, ("motif",)).columns if c.startswith("motif_")]
    monkeypatch.setattr(gmo, "square_count", broken)
    with pytest.raises(ValueError, match="broken measure"):
        gf.node_features_advanced(g, ("motif",))


def test_walk_features_of_an_empty_graph(spark):
    found = gf.node_features_advanced(make(spark, []), ("node2vec",), dim=3)
    assert found.columns == ["id", "node2vec_dim_0", "node2vec_dim_1", "node2vec_dim_2"] and found.isEmpty()


def test_path_stats_of_many_vertices(spark):
    """Pairs beyond 32 bits: a star of 50,000 vertices, whose sums are known without a search."""
    n = 50_000
    g = gg.Graph(spark.range(n), spark.range(1, n).selectExpr("0L AS src", "id AS dst"), False)
    sums = spark.range(n).selectExpr(
        "id", f"{n - 1}L AS reached", f"IF(id = 0, {n - 1}L, {2 * n - 3}L) AS total", "IF(id = 0, 1L, 2L) AS far", "0D AS between")
    found = gp.shortest_path_stats(g, measures=sums).first()
    assert found.connected and (found.diameter, found.radius) == (2, 1)
    assert found.average_path_length == pytest.approx(((n - 1) + (n - 1) * (2 * n - 3)) / (n * (n - 1)))
