import itertools
import random

from figloom.llm.flow import FlowGraph


def brute(arcs, nodes, amount):
    """Least cost of the most that can be sent, over all integer flows."""
    best = None
    for flow in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
        net = dict.fromkeys(nodes, 0)
        for f, (a, b, _, _) in zip(flow, arcs):
            net[a] -= f
            net[b] += f
        if all(net[n] == 0 for n in nodes if n not in "st") and 0 <= net["t"] <= amount:
            key = (-net["t"], sum(f * w for f, (_, _, _, w) in zip(flow, arcs)))
            best = min(best or key, key)
    return -best[0], best[1]


def test_against_all_flows():
    rng = random.Random(2)
    for _ in range(40):
        nodes = "sabt"
        arcs = [(a, b, rng.randrange(1, 3), rng.randrange(4)) for a, b in (("s", "a"), ("s", "b"), ("a", "b"), ("b", "a"), ("a", "t"), ("b", "t"), ("s", "t")) if rng.random() < 0.8]
        if not arcs:
            continue
        g = FlowGraph()
        for k, (a, b, c, w) in enumerate(arcs):
            g.arc(a, b, c, w, k)
        amount = rng.randrange(1, 6)
        sent = g.run("s", "t", amount)
        cost = sum(f * arcs[k][3] for k, f in g.flows().items())
        assert (sent, cost) == brute(arcs, nodes, amount)


def test_convex_arcs_balance():
    g = FlowGraph()
    for k in range(4):
        g.convex_arc("s", k, 100, 3, 1)
        g.arc(k, "t", 100 if k else 2, 0, k)
    assert g.run("s", "t", 20) == 20
    f = g.flows()
    assert f[0] == 2 and sum(f.values()) == 20 and max(f.values()) <= 9


def test_large_amounts_and_dead_ends():
    g = FlowGraph()
    g.arc("s", "a", 10**15, 1, "x")
    g.arc("a", "t", 10**14, 0)
    g.arc("s", "t", 7, 3, "y")
    assert g.run("s", "t", 10**16) == 10**14 + 7 and g.flows() == {"x": 10**14, "y": 7}
    assert FlowGraph().run("s", "t", 5) == 0
