"""Closure, layers, cycles and selections against plain searches."""

import random

from ferrule.operators import graphs
from ferrule.plans import publish as plan

SF = "/root/testdata/sf0.001"


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def by_search(nodes, needs):
    """(node -> layer) and (node -> cycle or None) by plain loops."""
    edges = {}
    for a, b in needs:
        if a in nodes and b in nodes:
            edges.setdefault(a, set()).add(b)
    layer = {}
    while True:
        ready = {a for a in nodes if a not in layer and all(b in layer for b in edges.get(a, ()))}
        if not ready:
            break
        n = max(layer.values(), default=-1) + 1
        layer |= dict.fromkeys(ready, n)
    left = nodes - set(layer)
    far = {a: reach(edges, a) for a in left}
    return layer, {a: min(b for b in far[a] if a in far.get(b, ())) if a in far[a] else None for a in left}


def test_layers_and_cycles_against_search(spark):
    """Chains, diamonds, cycles in and beside each other, loops of one node, nodes behind and before cycles, needs that are no nodes."""
    draw = random.Random(10)
    needs = [(f"a{n}", f"a{n - 1}") for n in range(1, 9)] + [("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("b3", "c1"), ("c1", "c2"), ("c2", "c1"), ("d", "b2"), ("c2", "a3"), ("e", "e"), ("f", "e"), ("g", "none"), ("a8", "g"), ("a5", "a1")]
    needs += [(f"r{draw.randrange(40)}", f"r{draw.randrange(40)}") for _ in range(45)]
    nodes = {n for e in needs for n in e if n != "none"} | {"alone"}
    placed, held = graphs.layers(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(needs, "node string, needs string"))
    layer, cycle = by_search(nodes, needs)
    assert {r.node: r.layer for r in placed.collect()} == layer and placed.count() == len(layer)
    assert {r.node: r.cycle for r in held.collect()} == cycle and held.count() == len(cycle)
    assert cycle["e"] == "e" and cycle["f"] is None and cycle["b2"] == "b1" and cycle["c2"] == "c1"
    assert graphs.cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dependency_queries(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    nodes, needs = {r.p_partkey for r in part.collect()}, [tuple(r) for r in plan.needs(part).collect()]
    layer, cycle = by_search(nodes, needs)
    assert {r.node: r.layer for r in plan.dependency_layers(spark, SF).collect()} == layer
    assert {r.node: r.cycle for r in plan.dependency_cycles(spark, SF).collect()} == cycle and any(v is not None for v in cycle.values())
    for a, b in needs:
        assert a not in layer or layer[b] < layer[a]


def test_selections_bring_what_they_start_from(spark):
    rows = [("strict", True, None), ("lever:a", True, None), ("lever:b", False, None), ("cum:1", True, "lever:a"), ("cum:2", True, None), ("cum:3", True, "x"), ("compliant", True, "cum:2"), ("x", True, "y"), ("y", True, None)]
    chosen = {1: ["lever:a"], 2: ["cum:2"], 3: ["compliant"], 4: ["x"], 5: ["lever:b", "nope"], 6: ["strict"]}
    variants = spark.createDataFrame([(j, n, k, a, c) for j in chosen for k, (n, a, c) in enumerate(rows)], "job int, name string, ord int, applies boolean, alias string")
    got = graphs.selection(variants, spark.createDataFrame([(j, n) for j, names in chosen.items() for n in names], "job int, name string")).orderBy("job", "ord").collect()
    want = {1: ["strict", "lever:a"], 2: ["strict", "lever:a", "cum:1", "cum:2", "cum:3", "compliant", "x", "y"], 3: ["strict", "lever:a", "cum:1", "cum:2", "compliant"], 4: ["strict", "x", "y"], 6: ["strict"]}
    assert {j: [r.name for r in got if r.job == j] for j in want} == want
    assert [(r.name, r.error) for r in got if r.job == 5] == [(None, "does not apply: lever:b; no such variant: nope")]
