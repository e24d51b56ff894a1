"""Filters of graphs by share and dependency against a plain version that removes one link after the other."""

import math
import random

from caseloom.operators import connected_graphs
from caseloom.operators.connected_graphs import FIRST, LAST, FollowsGraph


def reach(start, links):
    to = {}
    for u, v in links:
        to.setdefault(u, set()).add(v)
    seen, todo = {start}, [start]
    while todo:
        for y in to.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def linked(must, links):
    return must <= reach(FIRST, links) and must <= reach(LAST, [(v, u) for u, v in links])


def finished(links, counts):
    """Links and activities that ways from start to end pass."""
    good = reach(FIRST, links) & reach(LAST, [(v, u) for u, v in links])
    return {x: n for x, n in links.items() if set(x) <= good}, {a: n for a, n in counts.items() if a in good}


def plain_paths(links, counts, weight, open_links, keep_all):
    firm = set(links) - set(open_links)
    must = set(counts) if keep_all else {x for link in firm for x in link} - {FIRST, LAST}
    left = dict(links)
    for link in sorted(open_links, key=lambda x: (weight[x], x)):
        less = {x: n for x, n in left.items() if x != link}
        if linked(must, less):
            left = less
    return finished(left, counts)


def plain_activities(links, counts, share):
    order = sorted(counts, key=lambda a: (counts[a], a))
    low = order[: len(order) - math.ceil((len(order) - 1) * share) - 1]
    left, held = dict(links), dict(counts)
    for a in low:
        less = {x: n for x, n in left.items() if a not in x}
        if linked(set(order) - set(low), less):
            left = less
            del held[a]
    return finished(left, held)


def random_graph(seed, n, m, most):
    """Links of random cases, so that every activity has a way, with few different counts for ties."""
    rng = random.Random(seed)
    names = [chr(65 + i) for i in range(n)]
    links = {}
    for i in range(m):
        case = [FIRST, *rng.sample(names, rng.randint(2, min(n, 5))), LAST]
        if i < n:
            case.insert(1, names[i]) if names[i] not in case else None
        for x in zip(case, case[1:], strict=False):
            links[x] = rng.randint(1, most)
    counts = {a: rng.randint(1, most) for a in {x for link in links for x in link} - {FIRST, LAST}}
    return links, counts


def graph_of(spark, links, counts):
    edges = [(a, b, n) for (a, b), n in links.items() if a != FIRST and b != LAST]
    ends = "activity string, n long"
    return FollowsGraph(
        spark.createDataFrame(edges, "a string, b string, n long").repartition(3),
        spark.createDataFrame([(b, n) for (a, b), n in links.items() if a == FIRST], ends),
        spark.createDataFrame([(a, n) for (a, b), n in links.items() if b == LAST], ends),
        spark.createDataFrame(list(counts.items()), ends),
    )


def found(graph):
    rows = graph.rows().collect()
    return {(r.a, r.b): r.n for r in rows if r.kind != "activity"}, {r.a: r.n for r in rows if r.kind == "activity"}


def below(links, weight, share):
    order = sorted(links, key=lambda x: (weight[x], x))
    return order[: len(order) - math.ceil((len(order) - 1) * share) - 1]


def test_filters_equal_plain_removal(spark):
    links, counts = random_graph(2, 8, 5, 3)
    graph = graph_of(spark, links, counts)
    assert found(connected_graphs.by_activities(graph, 0.1)) == plain_activities(links, counts, 0.1)
    assert found(connected_graphs.by_paths(graph, 0.1)) == plain_paths(links, counts, links, below(links, links, 0.1), False)
    back = lambda a, b: links.get((b, a), 0)
    dependency = {(a, b): 1.0 if FIRST == a or LAST == b else (n - back(a, b)) / (n + back(a, b) + 1) for (a, b), n in links.items()}
    low = [x for x in links if dependency[x] < 0.7]
    assert found(connected_graphs.by_dependency(graph, 0.7)) == plain_paths(links, counts, dependency, low, False)
    links, counts = random_graph(3, 6, 9, 5)
    assert found(connected_graphs.by_paths(graph_of(spark, links, counts), 0.3, True)) == plain_paths(links, counts, links, below(links, links, 0.3), True)


def test_graphs_without_ways_and_small_ones(spark):
    # C has no way to the end: nothing can be removed, C itself goes as nothing passes it
    links = {(FIRST, "A"): 9, ("A", "B"): 5, ("B", LAST): 9, ("A", "C"): 8, ("B", "B"): 1}
    counts = {"A": 9, "B": 5, "C": 8}
    got = found(connected_graphs.by_paths(graph_of(spark, links, counts), 0.0, keep_all=True))
    assert got == ({x: n for x, n in links.items() if "C" not in x}, {"A": 9, "B": 5})
    lone = graph_of(spark, {(FIRST, "A"): 1, ("A", LAST): 1}, {"A": 1})
    assert found(connected_graphs.by_activities(lone, 0.0)) == ({(FIRST, "A"): 1, ("A", LAST): 1}, {"A": 1})
