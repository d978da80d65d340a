"""Shortest paths, chimers and bubbles against plain Python on random graphs."""

import heapq
import os

import numpy as np
import pytest

from helixframe.operators import pathgraph, walks
from helixframe.plans import store

EDGES = "src long, dst long, length long"


def random_edges(rng, nodes, n):
    return [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, nodes, n), rng.integers(0, nodes, n), rng.integers(1, 20, n), strict=True)]


def dijkstra(edges, start, bound):
    out, heap = {}, [(0, start)]
    ways = {}
    for a, b, w in edges:
        ways.setdefault(a, []).append((b, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for v, w in ways.get(u, ()):
            if v not in out and (bound is None or d + w <= bound):
                heapq.heappush(heap, (d + w, v))
    return out


@pytest.mark.parametrize("bound,delta", [(None, None), (25, 3), (40, 1000)])
def test_shortest_paths(spark, bound, delta):
    edges = random_edges(np.random.default_rng(3), 30, 70) + [(1, 1, 4)]
    starts = [0, 3, 7, 99]
    got = walks.shortest_paths(spark, spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in [*starts, 3]], "start long"), bound, delta).collect()
    want = {}
    for s in starts:
        far = dijkstra(edges, s, bound)
        for v, d in far.items():
            want[s, v] = (d, None if v == s else min(a for a, b, w in edges if b == v and a in far and far[a] + w == d))
    assert {(r.start, r.node): (r.dist, r.prev) for r in got} == want and len(got) == len(want)


def test_lengths_are_positive(spark):
    with pytest.raises(ValueError):
        walks.shortest_paths(spark, spark.createDataFrame([(1, 2, 0)], EDGES), spark.createDataFrame([(1,)], "start long"))


def mirrored(edges):
    return [*edges, *((-b, -a, w) for a, b, w in edges)]


def test_planted_chimers(spark):
    # two lines with a detour each, and an edge from the one to the other
    line = [(i, i + 1, 10) for i in range(1, 12)] + [(i, i + 2, 25) for i in range(1, 11)]
    other = [(a + 100, b + 100, w) for a, b, w in line]
    edges = spark.createDataFrame(mirrored(line + other + [(5, 107, 10)]), EDGES)
    assert sorted((r.src, r.dst) for r in walks.chimer_edges(spark, edges, 60).collect()) == [(-107, -5), (5, 107)]
    # where the sides are followed far enough, they meet: the lines join behind
    joined = spark.createDataFrame(mirrored(line + other + [(5, 107, 10), (12, 113, 10), (112, 113, 10), (200, 1, 10), (200, 101, 10)]), EDGES)
    assert walks.chimer_edges(spark, joined, 400).count() == 0
    assert walks.chimer_edges(spark, joined, 60).count() == 2


def plain_bubbles(paths, depth=48, width=16, most=500_000, tips=6):
    out = {}
    for p, a, b, w in paths:
        out.setdefault(a, []).append((b, p, w))
    ins = {}
    for _, _, b, _ in paths:
        ins[b] = ins.get(b, 0) + 1
    found = set()
    for start in out:
        if len(out[start]) < 2:
            continue
        far, seen, taken, ready, used = {start: 0}, {}, 0, [start], []
        for _ in range(depth):
            ways = [(u, *x) for u in ready for x in out.get(u, ())]
            if any(u not in out for u in ready) or any(x[1] == start for x in ways):
                break
            for u, v, p, w in ways:
                used.append(p)
                seen[v] = seen.get(v, 0) + 1
                far[v] = max(far.get(v, 0), far[u] + w)
            taken += len(ready)
            if any(-x in far for x in far):
                break
            ready = [v for v in {x[1] for x in ways} if seen[v] == ins[v]]
            open_ = [v for v in seen if seen[v] < ins[v]]
            if len(open_) + len(ready) >= tips or max(far.values()) > most or taken > depth * width or (taken > 10 and len(used) > width * taken):
                break
            if len(ready) == 1 and not open_ and len(used) > 1:
                found.add((start, ready[0], len(used), far[ready[0]], tuple(sorted(used))))
                break
    return found


@pytest.mark.parametrize("seed,limits", [(0, {}), (1, {"tips": 3}), (2, {"most_length": 30}), (3, {"depth": 2})])
def test_bubbles_by_frontier(spark, seed, limits):
    rng = np.random.default_rng(seed)
    rows, node = [], 1
    for _ in range(12):  # a chain of small graphs, many of them bubbles
        inner = int(rng.integers(1, 6))
        ids = list(range(node, node + inner + 2))
        for k, a in enumerate(ids[:-1]):
            for b in {int(x) for x in rng.choice(ids[k + 1 :], int(rng.integers(1, 4)))}:
                rows.append((a, b, int(rng.integers(1, 20))))
        node = ids[-1]
    rows += random_edges(rng, 40, 15)
    paths = [(i, a + 1, b + 1, w) for i, (a, b, w) in enumerate(rows)] + [(1000 + i, -b - 1, -a - 1, w) for i, (a, b, w) in enumerate(rows)]
    got = pathgraph.bubbles(spark, spark.createDataFrame(paths, "path long, src long, dst long, length long"), **limits).collect()
    names = {"most_length": "most"}
    want = plain_bubbles(paths, **{names.get(k, k): v for k, v in limits.items()})
    assert {(r.start, r.end, r.size, r.length, tuple(r.inside)) for r in got} == want and len(got) == len(want)
    assert seed or want


def test_table_functions(spark):
    from helixframe.functions import tables

    assert tables.worst_window("10=2X10=", 10) == (2, 2) and tables.worst_window("5=3I5=", 8) == (3, 0) and tables.worst_window("5=", 8) is None and tables.worst_window(None, 1) is None
    tables.register(spark)
    spark.createDataFrame([("a", "AC-G", "A-TG", 5), ("b", None, "A", 0)], "id string, q string, s string, at long").createOrReplaceTempView("aligned_rows")
    got = spark.sql("SELECT t.* FROM aligned_rows, LATERAL alignment_tags(q, s, at) t").collect()
    assert [tuple(r) for r in got] == [(5, 0, "A", -1, 0, "-"), (5, 1, "C", 5, 0, "A"), (6, 0, "-", 5, 1, "C"), (7, 0, "G", 6, 0, "-")]
    spark.createDataFrame([("a", "10=2X10="), ("b", "3="), ("c", "4D20=")], "id string, cigar string").createOrReplaceTempView("cigars")
    got = spark.sql("SELECT * FROM worst_windows(TABLE(SELECT id, cigar FROM cigars) PARTITION BY (id), 10)").collect()
    assert sorted(tuple(r) for r in got) == [("a", 2, 2), ("c", 4, 0)]


def test_contigs_of_the_line_are_stretches_of_the_documents(spark, sf_dir):
    from helixframe import catalogue
    from helixframe.plans.fixtures import reads

    bases = "".join(r.seq or "" for r in reads(spark, sf_dir).orderBy("read_id").collect())
    turned = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = catalogue.queries()["contigs"](spark, sf_dir).collect()
    assert out and max(r.n_reads for r in out) > 5 and all(r.length == len(r.seq) and (r.seq in bases or r.seq in turned) for r in out)


def plain_chimers(edges, bound):
    light = {}
    for a, b, w in edges:
        light[a, b] = min(w, light.get((a, b), w))
    outs, ins = [a for a, _ in light], [b for _, b in light]
    rows = [(a, b, w) for (a, b), w in light.items()]
    alone = set()
    for s, d in light:
        if outs.count(s) > 1 and ins.count(d) > 1:
            ours = {v for (a, x), w in light.items() if a == s and x != d and w <= bound for v in dijkstra(rows, x, bound - w)}
            if not ours & set(dijkstra(rows, d, bound)):
                alone.add((s, d))
    return sorted(e for e in alone if (-e[1], -e[0]) in alone)


@pytest.mark.parametrize("seed", range(3))
def test_chimers_against_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    edges = mirrored([(a + 1, b + 1, w) for a, b, w in random_edges(rng, 24, 34)] + [(3, 3, 2)])
    got = sorted((r.src, r.dst) for r in walks.chimer_edges(spark, spark.createDataFrame(edges, EDGES), 12).collect())
    want = plain_chimers(edges, 12)
    assert got == want and (want or seed)


def written(spark, name):
    """Passes on disk of the last operator call of that name."""
    root = [x for x in store._written[spark.sparkContext.applicationId] if f"/{name}-" in x][-1]
    return sorted(os.listdir(root.removeprefix("file://")))


def test_chimers_hold_one_pass_and_few_ways(spark):
    line = [(i, i + k, 10 * k + (k == 2)) for i in range(1, 40) for k in (1, 2, 3)]
    assert [(r.src, r.dst) for r in walks.chimer_edges(spark, spark.createDataFrame(mirrored(line + [(5, 35, 10)]), EDGES), 60).collect()]
    passes = written(spark, "chimers")
    assert [sum(x.endswith(f"-{label}") for x in passes) for label in ("state", "alone")] == [1, 1]
    # edges of the line are told apart before any way sets out
    root = [x for x in store._written[spark.sparkContext.applicationId] if "/chimers-" in x][-1]
    [doubtful] = [x for x in passes if x.endswith("-doubtful")]
    assert spark.read.parquet(f"{root}/{doubtful}").count() <= 12 < 2 * len(line)


def test_worst_windows_of_a_batch(monkeypatch):
    from helixframe.functions import tables

    rng = np.random.default_rng(5)
    cigars = ["".join(f"{n}{op}" for n, op in zip(rng.integers(0, 30, k).tolist(), rng.choice(list("=XID"), k), strict=True)) for k in rng.integers(0, 9, 400).tolist()]
    cigars += [None, "", "X", "5=x4X=", "12", "3 4=30X2", "100=7I", "1I99=", "40M20X=30="]
    for bases, width in ((1_000_000, 10), (50, 10), (1, 37)):
        monkeypatch.setattr(tables, "BASES", bases)
        want = [(i, *w) for i, c in enumerate(cigars) if (w := tables.worst_window(c, width)) is not None]
        assert [tuple(map(int, x)) for x in zip(*tables.worst_windows(cigars, width), strict=True)] == want


def test_worst_windows_in_sql_is_not_called_by_key(spark, sf_dir):
    from helixframe.plans import graph_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan(graph_queries.worst_error_window_in_sql(spark, sf_dir))
    by_key = plan(spark.sql("SELECT * FROM worst_windows(TABLE(SELECT string(id) AS id, '5=' AS cigar FROM range(9)) PARTITION BY (id), 2)"))
    assert "RepartitionByExpression" in by_key and "RepartitionByExpression" not in dealt


def test_shortest_paths_in_turns(spark):
    edges = random_edges(np.random.default_rng(8), 30, 70)
    starts = spark.createDataFrame([(s,) for s in range(12)], "start long")
    frames = [walks.shortest_paths(spark, spark.createDataFrame(edges, EDGES), starts, 30, None, n) for n in (100, 5)]
    # a turn leaves its last pass alone
    assert sum(x.endswith("-state") for x in written(spark, "shortest")) == 3
    whole, turns = (sorted(map(tuple, f.collect()), key=str) for f in frames)
    assert whole == turns and {r[0] for r in whole} == set(range(12))
