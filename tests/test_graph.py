"""Cycles, depth, critical path and reach on small graphs with known answers and on random ones against plain searches."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakelineage.functions import lineage
from lakelineage.operators import graph as g

TWO_CYCLES = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("y", "x"), ("x", "z")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(pairs)], "source string, target string, edge_seq long")


def assets_of(spark, ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, seq long")


def pairs_of(df):
    return dict(tuple(r) for r in df.collect())


def closure(pairs):
    ids = {x for p in pairs for x in p}
    far = {x: set() for x in ids}
    for x in ids:
        todo = [t for s, t in pairs if s == x]
        while todo:
            y = todo.pop()
            if y not in far[x]:
                far[x].add(y)
                todo += [t for s, t in pairs if s == y]
    return far


def brute(pairs):
    """Components, edges on cycles, depths and reach by the closure."""
    far = closure(pairs)
    comp = {x: min({y for y in far if x in far[y] and y in far[x]} | {x}) for x in far}
    ring = {x: comp[x] for x in far if x in far[x]}
    links = {(comp[s], comp[t]) for s, t in pairs if comp[s] != comp[t]}

    def depth(c):
        return max((1 + depth(t) for s, t in links if s == c), default=0)

    return ring, {(s, t) for s, t in pairs if s in far[t] or s == t}, {x: depth(comp[x]) for x in far}, {x: len(far[x] - {x}) for x in far}


def test_two_cycles_and_what_lies_between(spark):
    edges = edges_of(spark, TWO_CYCLES)
    assets = assets_of(spark, "abcdexyzq")
    assert pairs_of(g.strong_components(edges)) == {"a": "a", "b": "a", "d": "d", "e": "d", "x": "x"}
    assert {tuple(r) for r in g.cycle_edges(edges).collect()} == {("a", "b"), ("b", "a"), ("d", "e"), ("e", "d"), ("x", "x")}
    assert pairs_of(g.dependency_depth(assets, edges).drop("seq")) == {"a": 2, "b": 2, "c": 1, "d": 0, "e": 0, "x": 1, "y": 2, "z": 0, "q": 0}
    assert pairs_of(g.critical_path(assets, edges)) == {0: "a", 1: "c", 2: "d"}


@pytest.mark.parametrize("pairs, cyclic", [([("a", "b"), ("b", "c"), ("c", "d")], False), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], False), ([("a", "b"), ("b", "c"), ("c", "a")], True), ([("a", "a")], True)])
def test_known_graphs(spark, pairs, cyclic):
    edges = edges_of(spark, pairs)
    ring, on, depth, reach = brute(pairs)
    ids = sorted(depth)
    assert bool(on) == cyclic and {tuple(r) for r in g.cycle_edges(edges).collect()} == on
    assert pairs_of(g.dependency_depth(assets_of(spark, ids), edges).drop("seq")) == depth
    assert pairs_of(g.blast_radius(assets_of(spark, ids), edges)) == reach


def test_random_graphs(spark):
    """Several graphs side by side, so that one run covers dense and thin ones, long chains of cycles and repeated edges."""
    rng = random.Random(4)
    pairs = []
    for k, (n, m) in enumerate([(6, 5), (8, 12), (12, 14), (12, 30), (20, 20)]):
        pairs += [(f"{k}.{rng.randrange(n)}", f"{k}.{rng.randrange(n)}") for _ in range(m)]
    for i in range(12):  # a chain of cycles of two
        pairs += [(f"c{i}", f"d{i}"), (f"d{i}", f"c{i}"), (f"d{i}", f"c{i + 1}"), (f"d{i}", f"c{i + 1}")]
    ring, on, depth, reach = brute(pairs)
    ids = sorted(depth)
    rng.shuffle(ids)
    edges, assets = edges_of(spark, pairs), assets_of(spark, ids)
    assert pairs_of(g.strong_components(edges)) == ring
    assert {tuple(r) for r in g.cycle_edges(edges).collect()} == on
    assert pairs_of(g.dependency_depth(assets, edges).drop("seq")) == depth
    assert pairs_of(g.blast_radius(assets, edges)) == reach
    path = [x for _, x in sorted(pairs_of(g.critical_path(assets, edges)).items())]
    assert len(path) == max(depth.values()) + 1 and [depth[x] for x in path] == list(range(max(depth.values()), -1, -1))
    assert depth[path[0]] == max(depth.values()) and all(y in closure(pairs)[x] for x, y in zip(path, path[1:], strict=False))


def test_empty_graph(spark):
    edges, assets = edges_of(spark, []), assets_of(spark, "ab")
    assert g.cycle_edges(edges).count() == 0
    assert pairs_of(g.dependency_depth(assets, edges).drop("seq")) == {"a": 0, "b": 0}
    assert pairs_of(g.blast_radius(assets, edges)) == {"a": 0, "b": 0}
    assert pairs_of(g.critical_path(assets, edges)) == {0: "a"}


def test_leaves_are_stored_twice_at_most(spark, monkeypatch):
    """Leaves, most of a graph, are stored as edges and with their numbers, and in no step after that."""
    pairs = [("top", f"m{i}") for i in range(20)] + [(f"m{i % 20}", f"leaf{i}") for i in range(400)]
    rows, cut, counted = [], g.cut, g.cut_counted

    def noted(df):
        done = cut(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(g, "cut", noted)
    monkeypatch.setattr(g, "cut_counted", lambda df, where=None: (lambda r: (rows.append(r[0].count()), r)[1])(counted(df, where)))
    far = closure(pairs)
    assert pairs_of(g.blast_radius(assets_of(spark, sorted(far)), edges_of(spark, pairs))) == {x: len(y) for x, y in far.items()}
    assert sum(rows) < 2.5 * len(pairs)


def test_many_roots_with_one_way_out(spark, monkeypatch):
    """Roots that share what follows them reach the same as one by one, with cycles among them and within a number of hops."""
    rng = random.Random(7)
    pairs = [(f"r{i}", f"m{i % 4}") for i in range(40)] + [("m0", "m1"), ("m1", "r3"), ("m2", "m0"), ("m3", "m3"), ("r5", "r6"), ("m1", "x")]
    edges = edges_of(spark, pairs)
    roots = spark.createDataFrame([(f"r{i}",) for i in range(40)] + [("m2",), ("x",), ("none",)], "id string")
    for most in (None, rng.randrange(2, 4)):
        found = []
        for many in (5, 1000):
            monkeypatch.setattr(g, "MANY_ROOTS", many)
            found.append(sorted(tuple(r) for r in g.reach(edges, roots, most).select("root", "id", "depth").collect()))
        assert found[0] == found[1] and len(found[0]) > 100


def test_ranks_over_all_rows(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 1.5, 2.0, 2.0, rng.random()]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    both = lineage.ranked(lineage.ranked(rows, "v", "r"), "v", "d", dense=True)
    want = rows.withColumn("r", F.rank().over(Window.orderBy(F.desc_nulls_last("v")))).withColumn("d", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("v"))))
    assert {tuple(r) for r in both.select("id", "v", "r", "d").collect()} == {tuple(r) for r in want.collect()}
    assert lineage.ranked(rows.limit(0), "v", "r").count() == 0


def test_components_spread_among_inner_ids_only(spark, monkeypatch):
    ties = [("m", f"{c}{i}") for c in "az" for i in range(30)] + [("p", "q"), ("m", "n"), ("n", "m2"), ("m2", "o"), ("s", "s"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")]
    seen = []
    spread = g.spread
    monkeypatch.setattr(g, "spread", lambda links, ids: seen.append({r.id for r in ids.collect()}) or spread(links, ids))
    got = {r.id: r.component for r in g.components(spark.createDataFrame([("x",), ("m",)], "id string"), spark.createDataFrame(ties, "source string, target string")).collect()}
    big = {"m", "n", "m2", "o", *[f"{c}{i}" for c in "az" for i in range(30)]}
    assert got == {i: "a0" for i in big} | {"p": "p", "q": "p", "x": "x", "s": "s", "c1": "c1", "c2": "c1", "c3": "c1"}
    assert seen == [{"m", "n", "m2", "p", "x", "s", "c1", "c2", "c3"}]
