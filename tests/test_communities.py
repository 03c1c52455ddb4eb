"""Communities against what the graphs were built of and against a sequential version; cycles, lineage and module graphs."""

import random
from collections import defaultdict

from sparquill.operators import communities as C


def clique(weight, *nodes):
    return [(a, b, weight) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


def found(spark, edges, nodes=(), **more):
    frame = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a string, b string, w double")
    extra = spark.createDataFrame([(n,) for n in nodes], "node string")
    out = defaultdict(set)
    for r in C.communities(frame, extra, **more).collect():
        out[r["community"]].add(r["node"])
    return dict(out)


def sequential(edges, resolution=1.0):
    """Plain local moves and contraction, one node after the other."""
    weight = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        weight[a][b] += w
        weight[b][a] += w
    member, graph = {n: {n} for n in weight}, {n: dict(weight[n]) for n in sorted(weight)}
    loops = dict.fromkeys(graph, 0.0)
    while True:
        degree = {n: sum(graph[n].values()) + 2 * loops[n] for n in graph}
        m2, home, moved = sum(degree.values()), {n: n for n in graph}, False
        total = dict(degree)
        again = True
        while again:
            again = False
            for n in sorted(graph):
                total[home[n]] -= degree[n]
                near = defaultdict(float)
                for o, w in graph[n].items():
                    near[home[o]] += w
                gain = lambda c: near.get(c, 0.0) - resolution * degree[n] * total[c] / m2  # noqa: B023, E731
                best = home[n]
                for c in sorted(near):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                again |= best != home[n]
                home[n] = best
                total[best] += degree[n]
            moved |= again
        groups = defaultdict(list)
        for n in sorted(graph):
            groups[home[n]].append(n)
        if not any(len(g) > 1 for g in groups.values()):
            return {frozenset(m) for m in member.values()}
        lead = {n: min(g) for g in groups.values() for n in g}
        member = {min(g): set().union(*(member[n] for n in g)) for g in groups.values()}
        merged = {k: defaultdict(float) for k in member}
        after = dict.fromkeys(member, 0.0)
        for n in graph:
            after[lead[n]] += loops[n]
            for o, w in graph[n].items():
                if lead[o] == lead[n]:
                    after[lead[n]] += w / 2
                else:
                    merged[lead[n]][lead[o]] += w
        graph, loops = {k: dict(v) for k, v in merged.items()}, after


A, B = ["a/1", "a/2", "a/3", "a/4"], ["b/1", "b/2", "b/3", "b/4"]
TWO = clique(3, *A) + clique(3, *B) + [("a/1", "b/1", 0.5)]


def test_cliques_isolates_and_numbers_that_stay(spark):
    first = found(spark, [*TWO, ("a/1", "a/1", 9)], ["lonely"], hub_percentile=100)
    assert first == {0: set(A), 1: set(B), 2: {"lonely"}}
    assert {frozenset(m) for m in first.values() if len(m) > 1} == sequential(TWO)
    previous = spark.createDataFrame([(n, 7) for n in A] + [(n, 0) for n in B], "node string, community bigint")
    assert found(spark, TWO, ["lonely"], hub_percentile=100, previous=previous) == {7: set(A), 0: set(B), 1: {"lonely"}}


def test_a_hub_is_held_out_and_joins_its_side(spark):
    edges = TWO + [("lib/logger", n, 3) for n in A + B[:3]] + [("lib/logger", "a/1", 3)]
    assert found(spark, edges, hub_percentile=85) == {0: {*A, "lib/logger"}, 1: set(B)}


def test_a_ring_of_cliques_and_a_split_of_what_is_too_large(spark):
    ring, edges = [[f"m{c:02d}/f{n}" for n in range(6)] for c in range(12)], []
    for c, nodes in enumerate(ring):
        edges += [*clique(2, *nodes), (nodes[0], ring[(c + 1) % 12][0], 0.5)]
    shuffled = edges[:]
    random.Random(1).shuffle(shuffled)
    out = found(spark, [(b, a, w) for a, b, w in shuffled], hub_percentile=100)
    assert {frozenset(m) for m in out.values()} == {frozenset(r) for r in ring} == sequential(edges)
    p, q = [f"p/{k}" for k in range(6)], [f"q/{k}" for k in range(6)]
    pair = clique(1, *p) + clique(1, *q) + [("p/0", "q/0", 4)]
    assert len(found(spark, pair, hub_percentile=100, resolution=0.3, most_share=0.4, least_split=4)) >= 1


def test_greedy_matching_by_rounds(spark):
    rng = random.Random(8)
    rows = list({(rng.randrange(12), rng.randrange(12)): rng.randrange(1, 5) for _ in range(60)}.items())
    want, olds, news = set(), set(), set()
    for (old, new), _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if old not in olds and new not in news:
            want.add((old, new))
            olds.add(old)
            news.add(new)
    frame = spark.createDataFrame([(o, n, c) for (o, n), c in rows], "old bigint, new bigint, n bigint")
    assert {(r["old"], r["new"]) for r in C.matched(frame).collect()} == want
    assert C.matched(frame.limit(0)).count() == 0


def test_numbers_that_are_taken_and_free(spark):
    found_ = spark.createDataFrame([(n, c) for c in range(6) for n in range(c * 10, c * 10 + 3)], "node bigint, community bigint")
    previous = spark.createDataFrame([(0, 3), (1, 3), (20, 1), (21, 1), (22, 3), (40, 0)], "node bigint, community bigint")
    out = {r["node"] // 10: r["community"] for r in C.kept_numbers(found_, previous).collect()}
    assert out == {0: 3, 2: 1, 4: 0, 1: 2, 3: 4, 5: 5}


def test_lineage(spark):
    frame = lambda rows: spark.createDataFrame(rows, "node string, community bigint, label string")
    before = frame([("a", 0, "x"), ("b", 0, "x"), ("c", 1, "y"), ("d", 2, "z")])
    after = frame([("a", 0, "x"), ("b", 1, "w"), ("c", 1, "w"), ("e", 3, "v")])
    out = {r["community"]: (r["state"], r["moved"]) for r in C.lineage(before, after).collect()}
    assert out == {0: ("kept", 0), 1: ("renamed", 1), 2: ("dissolved", 0), 3: ("new", 0)}


def test_module_edges(spark):
    t = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    imports = t([("m", "one"), ("m", "pkg"), ("n", "pkg"), ("n", "gone")], "file module")
    targets = t([("one", "x"), ("pkg", "p1"), ("pkg", "p2"), ("pkg", "p3")], "module file")
    references = t([("m", "f"), ("m", "common"), ("n", "other")], "file symbol")
    definers = t([("f", "p2"), *(("common", f"c{k}") for k in range(4))], "symbol file")
    out = {(r["a"], r["b"]): r["w"] / C.UNIT for r in C.undirected(C.module_edges(imports, targets, references, definers)).collect()}
    assert out == {("m", "x"): 3.0, ("m", "p2"): 4.0, ("n", "p1"): 1.0, ("n", "p2"): 1.0, ("n", "p3"): 1.0}


def test_modules_of_three_groups(spark):
    files = [f"{d}/{k}" for d in "abc" for k in range(4)]
    edges = [e for d in range(3) for e in clique(3.0, *files[4 * d : 4 * d + 4])] + [("a/0", "b/0", 1.0), ("b/1", "c/1", 1.0), ("a/0", "a/2", 2.0)]
    frame = spark.createDataFrame(edges, "a string, b string, w double")
    home = C.communities(frame, hub_percentile=100)
    rows = {r["hub"]: (r["size"], round(r["cohesion"], 3)) for r in C.labelled(home, frame).collect()}
    assert rows == {"a/0": (4, 1.0), "b/0": (4, 1.0), "c/1": (4, 1.0)}


def test_coupling_counts_and_cycles(spark):
    edges = [("h", f"x{k}") for k in range(4)] + [(f"x{k}", "lib") for k in range(4)] + [("lib", "std"), ("p", "q"), ("q", "p"), ("r", "s"), ("s", "t"), ("t", "r"), ("r", "r")]
    out = C.coupling(spark.createDataFrame(edges, "src string, dst string"), 4, 2, cycles=1).collect()
    rows = {(r["node"], r["category"], r["severity"], r["n"]) for r in out}
    assert rows == {("h", "fan-out", "warning", 4), ("lib", "fan-in", "warning", 4), ("p", "cycle", "warning", 2)}


def test_numbers_of_cities_follow_the_greedy_order(spark):
    from sparquill.plans import graphs

    sf = "/root/testdata/sf0.001"

    def numbered(until):
        home = {r["node"]: r["community"] for r in graphs.homes(spark, sf, until).collect()}
        sizes = defaultdict(int)
        for c in home.values():
            sizes[c] += 1
        number = {c: k for k, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
        return {n: number[c] for n, c in home.items()}

    old, new = numbered("2024-03-01 00:00:00"), numbered("2024-12-01 00:00:00")
    shared = defaultdict(int)
    for n in old.keys() & new.keys():
        shared[old[n], new[n]] += 1
    final, used = {}, set()
    for o, n in sorted(shared, key=lambda p: (-shared[p], p)):
        if o not in used and n not in final:
            final[n] = o
            used.add(o)
    for n in range(len(set(new.values()))):
        if n not in final:
            final[n] = next(k for k in range(10**6) if k not in used)
            used.add(final[n])
    out = {r["node"]: r["community"] for r in graphs.f16_numbers_that_stay(spark, sf).collect()}
    assert out == {n: final[c] for n, c in new.items()}


def test_first_moves_find_cliques(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(5) for j in range(i)]
    home = C.first_moves(spark.createDataFrame([*cliques, ("x0", "y0", 1.0)], "a string, b string, w double"))
    assert {tuple(r) for r in home.select("node", "community").collect()} == {(f"{c}{i}", f"{c}0") for c in "xy" for i in range(5)}
    assert C.first_moves(spark.createDataFrame([], "a string, b string, w double")).count() == 0
